"""Line dedup by a log-template tree, in DataFrame expressions only.

A line is parsed to a fixed depth: its number of tokens, then its ``LEAD`` leading
tokens. Tokens with a digit are variable fields and read ``<*>``. Below that a leaf
generalises: the rest of a line is cut into segments of about equal length, three for a
line of under ``LONG`` tokens and four for a longer one, and each template of the leaf
keeps two of them and has ``<*>`` in place of the others. So lines of one leaf share a
template if their differences lie in one segment of three, or in two of four, wherever
these are. Lines of under ``EXACT`` tokens have one template with all their tokens.

A template recurs if different texts hold it: ``min_texts`` of them, or two for a
template of ``PASSAGE`` tokens or more. A text counts if at most ``copy_share`` of its
other characters (those outside the template's lines) lie in lines that other texts have too:
in near copies of a document all lines recur because the document does, and the
near-duplicate stage chooses among those. With ``copy_share`` None every text counts.
Lines of a recurring template are dropped from every document.

Texts are told apart by a 64-bit hash, so a group of exact copies counts once. Lines are
parsed once, to a table. A template that a third of all texts hold is counted by partial
aggregates, and met in joins whose other side has one row for it, which Spark splits.
Joins are merged at every size, so that cost grows with the input and doesn't jump where
a side outgrows a broadcast.

Nulls: a null text is left as it is and counts for nothing; nulls elsewhere are
passed through. Blank lines and lines of fewer than ``SHORT`` tokens are never
dropped. Repeated rows are treated alike. Other columns are passed through, whatever
their names, but ``n_chars`` is set anew if the text changed. A very long text costs time
in proportion to its length, and its lines must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.store import Tables

SHORT, EXACT, LONG, LEAD = 3, 6, 16, 2
MIN_TEXTS, PASSAGE = 3, 50
COPY_SHARE = 0.5
#: Into so many parts the lines of a template are dealt when they meet it.
SALTS = 8
_WHITE = "\t\x0b\x0c\r"


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _with_templates(tokens: DataFrame) -> DataFrame:
    """Rows with t (a line's tokens) and n (their number), and their templates in place of t.

    In steps, so that the code which Spark makes of them stays small enough to be compiled.
    """
    sized = tokens.withColumn("parts", F.when(F.col("n") < LONG, 3).otherwise(4))
    at = lambda k: f"cast(({k} * greatest(n - {LEAD}, 0)) div parts as int)"
    said = {f"s{k}": F.expr(f"xxhash64(slice(t, {LEAD + 1} + {at(k)}, greatest({at(k + 1)} - {at(k)}, 0)))") for k in range(4)}
    heads = {"head": F.xxhash64("parts", "n", *(F.get("t", F.lit(k)) for k in range(LEAD))), "whole": F.xxhash64("n", "t")}
    hashed = sized.select(*(c for c in sized.columns if c != "t"), *(x.alias(c) for c, x in (said | heads).items()))
    pairs = F.array(*(F.xxhash64("head", F.lit(i), f"s{i}", F.lit(j), f"s{j}") for j in range(4) for i in range(j)))  # the first three are of the first three segments
    leaf = F.slice(pairs, F.lit(1), F.when(F.col("n") < LONG, 3).otherwise(6))
    none = F.array().cast("array<bigint>")
    templates = F.when(F.col("n") < SHORT, none).when(F.col("n") < EXACT, F.array("whole")).otherwise(leaf)
    return hashed.select(*(c for c in sized.columns if c not in ("t", "parts")), templates.alias("templates"))


def parsed_lines(docs: DataFrame) -> DataFrame:
    """key and total (characters of the text's lines), line (position from 0), n (tokens), chars, templates (none of a short line): one row for each line."""
    text = F.col("text").cast("string")
    keyed = docs.where(text.isNotNull()).select(_key(text).alias("key"), F.length(text).alias("all"), F.split(text, "\n", -1).alias("lines"))
    # An outer generator and no filter below: for others Catalyst would compute the tokens again.
    lines = keyed.select("key", (F.col("all") - F.size("lines") + 1).alias("total"), F.posexplode_outer("lines").alias("line", "said"))
    plain = F.concat(F.lit(" "), F.translate("said", _WHITE, " " * len(_WHITE)))
    masked = F.when(F.col("said").rlike("[0-9]"), F.regexp_replace(plain, " [^ 0-9]*+[0-9][^ ]*+", " <*>")).otherwise(plain)
    tokens = lines.select("key", "total", "line", F.length("said").alias("chars"), F.array_remove(F.split(masked, " "), "").alias("t"))
    return _with_templates(tokens.withColumn("n", F.size("t")))


def dropped_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, copy_share: float | None = COPY_SHARE) -> DataFrame:
    """key and lines (sorted positions) of each text that loses lines."""
    tables, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    parsed = tables.add(parsed_lines(docs))
    seen = parsed.select("key", "line", "chars", "n", F.explode("templates").alias("template"))
    few = F.when(F.max("n") >= PASSAGE, min(2, min_texts)).otherwise(min_texts).alias("few")
    shared = seen.groupBy("template").agg(F.min("key").alias("low"), F.max("key").alias("high"), few).where("low <> high").select("template", "few")
    held = tables.add(seen.drop("n").join(shared.hint("merge"), "template"))  # lines that another text has too
    own = held.groupBy("template", "key").agg(F.sum("chars").alias("own"), F.first("few").alias("few"))
    if copy_share is not None:
        once = held.select("key", "line", "chars").distinct().groupBy("key").agg(F.sum("chars").alias("recurs"))
        totals = parsed.where("line = 0").groupBy("key").agg(F.first("total").alias("total"), F.count("*").alias("copies"))
        mine = F.expr("own div copies")  # a text's lines are there once for each copy of it
        rest = F.col("total") - mine
        counts = (rest > 0) & (F.col("recurs") - mine <= copy_share * rest)
        own = own.join(once.join(totals.hint("merge"), "key").hint("merge"), "key").where(counts)
    votes = own.groupBy("template").agg(F.count("*").alias("texts"), F.first("few").alias("few"))
    recurring = votes.where("texts >= few").select("template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = held.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    found = dealt.join(recurring.hint("merge"), ["template", "salt"]).groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    out = kept.add(found)
    tables.clear()
    return out


def _without(lines: Column, gone: Column) -> Column:
    """The lines without those at the sorted positions ``gone``: the runs between them, so the time is linear."""
    before = lambda j: F.coalesce(F.get(gone, j - 1), F.lit(-1))
    run = lambda j: F.slice(lines, before(j) + 2, F.coalesce(F.get(gone, j), F.size(lines)) - before(j) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run))


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """row (the columns of a document), left (what is left of its text), n_lines and n_dropped."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row.text").cast("string")
    joined = rows.withColumn("key", _key(text)).join(drops.select("key", F.col("lines").alias("gone")).hint("merge"), "key", "left")
    split = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.struct(F.size(x).alias("n"), F.array_join(_without(x, F.col("gone")), "\n").alias("left")))[0]
    left = F.when(F.col("gone").isNotNull(), split["left"]).otherwise(text)
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")
    return joined.select("row", left.alias("left"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def drop_recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, copy_share: float | None = COPY_SHARE) -> DataFrame:
    """The documents, all their columns, without recurring lines; a text of which nothing is left goes."""
    changed = F.col("n_dropped") > 0
    cut_docs = without_lines(docs, dropped_lines(docs, min_texts, copy_share)).where(~changed | F.col("left").rlike(r"[^\x20\x09-\x0D]"))

    def column(name: str, kind: str) -> Column:
        own = F.col(f"row.`{name}`")
        new = {"text": F.col("left").cast(kind), "n_chars": F.length("left").cast(kind)}
        return (F.when(changed, new[name]).otherwise(own) if name in new else own).alias(name)

    return cut_docs.select(*(column(c, k) for c, k in docs.dtypes))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the digest of what is left of the text."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = F.sha2(F.coalesce("left", F.lit("")).cast("binary"), 256)
    return without_lines(picked, dropped_lines(picked)).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", kept.alias("kept_sha256"))


def sql(min_texts: int = MIN_TEXTS, copy_share: float = COPY_SHARE) -> str:
    """The same in DuckDB; templates are texts there."""
    space, field = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"

    def leaf(parts: int) -> str:
        cut = lambda k: f"{LEAD} + CAST(floor((n - {LEAD}) * {k} / {parts}) AS INTEGER)"
        said = [f"array_to_string(t[{cut(k)} + 1:{cut(k + 1)}], ' ')" for k in range(parts)]
        pairs = (f"concat_ws('|', '{parts}', n, array_to_string(t[1:{LEAD}], ' '), '{i}', {said[i]}, '{j}', {said[j]})" for j in range(parts) for i in range(j))
        return f"[{', '.join(pairs)}]"

    return rf"""
WITH u AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
w AS (SELECT text, string_split(text, chr(10)) AS s FROM u),
l AS (SELECT text, length(text) - len(s) + 1 AS total, unnest(range(0, len(s))) AS line, unnest(s) AS said FROM w),
t AS (SELECT text, total, line, length(said) AS chars, list_filter(regexp_split_to_array(regexp_replace(said, '{field}', '<*>', 'g'), '{space}'), lambda x: x <> '') AS t FROM l),
m AS MATERIALIZED (SELECT text, total, line, chars, len(t) AS n, t FROM t WHERE len(t) >= {SHORT}),
seen AS MATERIALIZED (SELECT text, total, line, chars, n, unnest(CASE WHEN n < {EXACT} THEN [array_to_string(t, ' ')] WHEN n < {LONG} THEN {leaf(3)} ELSE {leaf(4)} END) AS template FROM m),
shared AS (SELECT template FROM seen GROUP BY template HAVING count(DISTINCT text) >= 2),
held AS MATERIALIZED (SELECT * FROM seen WHERE template IN (SELECT template FROM shared)),
own AS (SELECT template, text, max(total) AS total, sum(chars) AS own, max(n) AS n FROM held GROUP BY template, text),
once AS (SELECT text, sum(chars) AS recurs FROM (SELECT DISTINCT text, line, chars FROM held) GROUP BY text),
votes AS (SELECT template, own.n FROM own JOIN once USING (text) WHERE total > own AND recurs - own <= {copy_share} * (total - own)),
proper AS (SELECT template FROM votes GROUP BY template HAVING count(*) >= CASE WHEN max(n) >= {PASSAGE} THEN {min(2, min_texts)} ELSE {min_texts} END),
gone AS (SELECT DISTINCT text, line FROM held WHERE template IN (SELECT template FROM proper)),
kept AS (SELECT l.text, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(said, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS kept FROM l LEFT JOIN gone g ON l.text = g.text AND l.line = g.line GROUP BY l.text)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (text)"""
