"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts and benchmark items become canonical tokens: numbers, units and names are
replaced by typed placeholders, punctuation goes and letters are folded, one token
for one word, so raw and canonical words stay aligned. A name is a run of one to three
capitalised words, after a word in lower case or at the start of a sentence (where it must
not begin with one of ``STARTERS``); a longer run is a title and has no name. Windows of ``WINDOW``
canonical tokens are hashed: every window of an item and of a text, so any shared run
of ``WINDOW`` tokens meets. Windows with fewer than ``LITERALS`` literal tokens say too
little and aren't used.

A meeting aligns an item with a text. A chain takes each position of the item from one
alignment: from any one alone, or as changes between them pay. Its ``coverage`` is the
share of the item's positions whose canonical tokens agree; its slots (agreeing
placeholders) are consistent if no value of the item stands for two values of the text,
marks around values aside. A text is contaminated by an item if the coverage of a chain
with consistent slots reaches ``COVERAGE``; it is re-parameterised if slot values differ.

Texts are told apart by digest, so copies are judged once. The item windows, five
numbers each, are broadcast up to ``SMALL`` of them (about 64 bytes each in memory), and
so are the items' words up to ``SMALL_BYTES``; beyond that both are shuffled. Texts are
never gathered, and each text only meets items by equal windows.

Nulls: a null or empty text or item is not contaminated or contaminating; a null id
is passed through. Items of fewer than ``WINDOW`` tokens are looked for as one
window of their own length; with fewer than ``LITERALS`` literal tokens only copies with
equal slots count. Repeated rows are judged alike. Other columns are
passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.store import Tables

WINDOW, LITERALS = 8, 4
COVERAGE = 0.6
SMALL, SMALL_BYTES = 500_000, 32 << 20
#: Units that read <unit>, and number words that read <num>.
UNITS = "km cm mm kg mg lb lbs oz miles mile meters metres meter metre feet inches hours hour minutes minute seconds second days weeks months years dollars dollar euros euro cents percent litres liters grams"
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
#: Words that begin sentences and aren't names.
STARTERS = (
    "A About After All Also Although An And Another Any Are As At Be Because Before Both But By Can Choose Compute Consider Could Did Do Does Each Either Every Explain Find For From "
    "Give Given Had Has Have He Her Here His How However I If In Is It Its Let Like Many Most My Name No Not Now Of Often On Once One Only Or Other Our Out Over Please She Should Since So "
    "Some Such Suppose Take Than That The Their Then There These They This Those Though Through To Under Until Up Was We Were What When Where Which While Who Whom Whose Why Will With Would Write You Your"
)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¿¡"
_WHITE = "\t\n\x0b\x0c\r"
#: What may stand between a word's letters and the next space.
_END_OF_NAME = r"(?=(?:[^A-Za-z0-9\x80-\x{10FFFF} ]+(?: |$)| (?![A-Z][a-z])|$))"
#: After a word in lower case, or at the start of a sentence; not after a name.
_BEFORE_NAME = rf"(?:(?<= [a-z][^ .!?:]{{0,40}} )|(?<=[.!?:][\"'”’)]{{0,2}} |^ )(?!(?:{STARTERS.replace(' ', '|')})[^a-z]))"


def raw_words(text: Column) -> Column:
    """A text with single spaces between words and none around them."""
    plain = F.trim(F.translate(text, _WHITE, " " * len(_WHITE)))
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def _folded(text: Column) -> Column:
    """Letters of any script in one case; by way of capitals, as ß becomes two. Without a step between, Catalyst drops the first."""
    return F.lower(F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS")))


def canonical(raw: Column) -> Column:
    """A text of canonical words, one for each word of ``raw``, separated by single spaces.

    Every expression begins with a literal, so that it is tried only where one stands.
    """
    out = F.when(raw.rlike("[0-9]"), F.regexp_replace(F.concat(F.lit(" "), raw), r" [^ 0-9]*+[0-9][^ ]*+", " \u0001n")).otherwise(F.concat(F.lit(" "), raw))
    for n in (3, 2, 1):
        out = F.regexp_replace(out, r" (?=[A-Z])" + _BEFORE_NAME + "[A-Z][a-z]+ " * (n - 1) + r"[A-Z][a-z]+(?:['’]s)?" + _END_OF_NAME, " \u0001m" * n)
    out = _folded(F.translate(out, _MARKS, ""))
    out = F.regexp_replace(out, f" (?:{NUMBERS.replace(' ', '|')})(?= |$)", " \u0001n")
    return F.substring(F.regexp_replace(out, f" (?:{UNITS.replace(' ', '|')})(?= |$)", " \u0001u"), 2, 1 << 30)


def _hash(tokens: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.slice(tokens, at + 1, size))


def _says(tokens: Column, at: Column, size: Column) -> Column:
    """Whether a window of an item has enough literal tokens; half of them do for a whole item of less than a window. What meets it has the same."""
    window = F.slice(tokens, at + 1, size)
    literal = F.size(F.filter(window, lambda x: ~x.startswith("\u0001")))
    enough = (literal >= F.least(size, F.lit(LITERALS))) | ((size < WINDOW) & (2 * literal >= size))
    return enough & (F.length(F.concat_ws("", window)) > 0)


def item_words(items: DataFrame) -> DataFrame:
    """item_id, item (a number for its text), item_raw and item_canon: the words of every item that has some."""
    raw = raw_words(F.col("text").cast("string"))
    words = items.where(F.length(raw) > 0).select("item_id", raw.alias("raw"), canonical(raw).alias("said")).distinct()
    return words.select("item_id", F.xxhash64("raw").alias("item"), F.split("raw", " ").alias("item_raw"), F.split("said", " ").alias("item_canon"))


def item_windows(words: DataFrame) -> DataFrame:
    """hash, size, item_id, item, at, n (words of the item): every window of every item that says enough."""
    sized = words.withColumns({"size": F.least(F.size("item_canon"), F.lit(WINDOW)), "n": F.size("item_canon")})
    placed = sized.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    spot = F.col("item_canon"), F.col("at"), F.col("size")
    return placed.where(_says(*spot)).select(_hash(*spot).alias("hash"), "size", "item_id", "item", "at", "n")


def _value(raw: Column) -> Column:
    """A slot's value: the word without marks around it, letters folded."""
    return F.btrim(_folded(raw), F.lit(_MARKS))


#: What a change from one alignment to another costs a chain; a position gains 3, or 2 if its slot value differs.
SWITCH = 3
_COVERED = "size(filter({}, x -> x is not null))"
#: All alignments at once: at each position the item's own value if one of them has it, else any.
_ANY = "transform(was, (w, i) -> if(exists(lines, l -> l.now[i] <=> w), w, element_at(filter(transform(lines, l -> l.now[i]), x -> x is not null) || array(null), 1)))"
#: The alignments that may form a chain: all, those within an item's length of each one, and each alone.
_SETS = "array_distinct(array(lines) || transform(lines, a -> filter(lines, b -> b.d between a.d and a.d + size(was))) || transform(lines, a -> array(a)))"
#: The best chain of a set: one alignment for each position, by dynamic programming over positions.
_CHAIN = f"""array_max(aggregate(sequence(0, size(was) - 1),
  transform(chosen, l -> named_struct('score', 0, 'd', l.d, 'now', l.now, 'path', cast(array() as array<string>))),
  (held, i) -> element_at(transform(array(array_max(held)), top -> transform(held, h -> named_struct(
    'score', greatest(h.score, top.score - {SWITCH}) + case when h.now[i] is null then 0 when h.now[i] = was[i] then 3 else 2 end,
    'd', h.d, 'now', h.now, 'path', if(top.score - {SWITCH} > h.score, top.path, h.path) || array(h.now[i])))), 1))).path"""
_SLOTS = "filter(transform(c, (x, i) -> named_struct('was', was[i], 'now', x)), s -> startswith(s.now, '\u0001'))"
_JUDGED = f"""element_at(transform(array({_SLOTS}), s -> named_struct('coverage', {_COVERED.format("c")} / size(was),
  'unchanging', -cast(size(filter(s, x -> x.was <> x.now)) as bigint), 'n_slots', cast(size(s) as bigint),
  'consistent', size(array_distinct(transform(s, x -> x.was))) = size(array_distinct(s)))), 1)"""
#: The chain of most coverage, then of fewest changes, among those that suffice.
_BEST = f"array_max(filter(transform(array_distinct(array(any) || transform({_SETS}, chosen -> {_CHAIN})), c -> {_JUDGED}), j -> j.consistent and j.coverage >= least))"


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def contamination(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """key (digest of the text), item_id, coverage, n_slots and n_changed of every contaminated pair."""
    tables, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    words = tables.add(item_words(items))
    windows = tables.add(item_windows(words))
    n_windows = windows.count()
    n_bytes = words.agg(F.sum(F.length(F.concat_ws(" ", "item_raw", "item_canon")))).first()[0] or 0
    lengths = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most WINDOW different ones
    text = F.col("text").cast("string")
    texts = docs.where("text is not null").select(_key(text).alias("key"), raw_words(text).alias("raw"))
    texts = texts.select("key", "raw", canonical(F.col("raw")).alias("said"))
    texts = texts.select("key", F.split("raw", " ").alias("raw"), F.split("said", " ").alias("canon"))
    if n_windows > SMALL:
        texts = tables.add(texts.dropDuplicates(["key"]))
    met = None
    for size in lengths:
        starts = F.when(F.size("canon") >= size, F.sequence(F.lit(0), F.size("canon") - size)).otherwise(F.array().cast("array<int>"))
        # An outer generator: for another one Catalyst infers a filter that computes all words again.
        placed = texts.select("key", "raw", "canon", F.explode_outer(starts).alias("p")).withColumn("hash", _hash(F.col("canon"), F.col("p"), F.lit(size)))
        own, d = windows.where(F.col("size") == size).drop("size"), (F.col("p") - F.col("at")).alias("d")
        if n_windows <= SMALL:
            here = placed.where("p is not null").join(F.broadcast(own), "hash").select("key", "item_id", "item", "n", d, "raw", "canon")
        else:
            spots = placed.where("p is not null").select("key", "p", "hash").join(own, "hash").select("key", "item_id", "item", "n", d).distinct()
            here = spots.join(texts, "key")
        from_ = F.greatest("d", F.lit(0))
        skip = from_ - F.col("d")
        length = F.least(F.col("n") - skip, F.size("canon") - from_)
        part = here.select("key", "item_id", "item", "d", skip.alias("skip"), F.slice("raw", from_ + 1, length).alias("seg_raw"), F.slice("canon", from_ + 1, length).alias("seg"))
        met = part if met is None else met.unionAll(part)
    if met is None:
        tables.clear()
        return docs.sparkSession.createDataFrame([], "key binary, item_id long, coverage double, n_slots long, n_changed long")
    lined = met.dropDuplicates(["key", "item_id", "item", "d"])
    lined = lined.join(F.broadcast(words) if n_bytes <= SMALL_BYTES else words, ["item_id", "item"])
    # One value for each position: a literal, or a marked slot value; null where the text has another canonical token.
    marked = lambda canon, raw: F.when(canon.startswith("\u0001"), F.concat(F.lit("\u0001"), _value(raw))).otherwise(canon)
    was = F.transform("item_canon", lambda x, i: marked(x, F.get("item_raw", i)))
    now = F.transform("item_canon", lambda x, i: F.when(x == F.get("seg", i - F.col("skip")), marked(x, F.get("seg_raw", i - F.col("skip")))))
    # Alignments of one text with one item: as many as the item has insertions in the text, and at most one a position of both.
    lines = lined.select("key", "item_id", was.alias("was"), F.struct("d", now.alias("now")).alias("line")).groupBy("key", "item_id", "was").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    near = lines.withColumn("least", F.lit(float(coverage))).withColumn("any", F.expr(_ANY)).where(f"{_COVERED.format('any')} / size(was) >= least")
    judged = near.withColumn("best", F.expr(_BEST)).where("best is not null")
    judged = judged.where(f"best.unchanging = 0 or size(filter(was, w -> not startswith(w, '\u0001'))) >= least(size(was), {LITERALS})")
    best = judged.groupBy("key", "item_id").agg(F.max("best").alias("best"))
    out = kept.add(best.select("key", "item_id", "best.coverage", "best.n_slots", (-F.col("best.unchanging")).alias("n_changed")))
    tables.clear()
    return out


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, n_changed of every contaminated document and the item it holds."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = contamination(picked, items.select(F.col("item_id").cast("long").alias("item_id"), "text"))
    return picked.select("doc_id", _key(F.col("text").cast("string")).alias("key")).join(found, "key").select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_slots", "n_changed")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, that hold no benchmark item."""
    found = contamination(docs.select("text"), items.select(F.col("item_id").cast("long").alias("item_id"), "text")).select("key").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = rows.withColumn("key", F.coalesce(_key(F.col("row.text").cast("string")), F.lit(b"")))
    return keyed.join(found, "key", "left_anti").select("row.*")
