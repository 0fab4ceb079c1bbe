"""Near duplicates by a chosen-path set similarity join.

A document's set is its distinct word shingles, hashed to 64 bits. Documents with
the same set form a class, and classes are joined:

* ``TREES`` independent trees branch the classes by minwise tokens: a class goes to
  the child named by the least of its tokens under the hash of that tree and level,
  so two sets stay together with the probability of their similarity per level. Each
  tree and level has its own hash.
* Every node of the first level compares its members with one of them (the least).
  Links that hold on the full sets join classes into components.
* A node whose members are all in one component is done. A node with up to ``NODE``
  members is compared exhaustively, a larger one branches again; at level ``LEVELS``
  whatever is left is compared exhaustively, in blocks of ``BLOCK`` members. Only pairs
  from different components are compared, since links within a component can't
  change the result.

A pair of similarity 0.8 is met with a probability over 0.9999 in 20 trees, even if its
nodes stay large down to the last level. Before sets are read, pairs are dropped whose sizes alone rule a link out, and
pairs that sketches show to be far below the threshold: a linked pair fails the bound
that ``agreement`` sets with a probability of at most one in a million. No pair within a
component is listed twice and a group of copies of any size is one class. To be verified, a
text goes once to each block of pairs that has one of its own, not once to each pair, and
blocks hold about ``PAIRS_A_KEY`` pairs.

Memory: a worker holds the words of one text at a time (some 50 bytes a word), and the
sets of a block's texts when it verifies pairs.

Nulls: a null text is empty. An empty set is linked with nothing. Rows with a null
id are not compared: they have a null component and are kept. Rows that share an id
are one document: whatever one of them is linked with, all are. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.llm.components import components
from burrow.llm.kernels import all_words, bounds, mix, shingles, slices
from burrow.store import Tables

TREES, LEVELS, NODE, BLOCK = 20, 4, 48, 512
HASHES = TREES * LEVELS
#: Bytes of the wide sketch of classes that share a node with another component.
WIDE = 448
#: Up to so many classes (8 bytes each) the list of those to read again is broadcast; beyond it, it is shuffled.
SMALL = 500_000
#: Pairs that are verified in one group, about; and how many linked pairs a sketch may lose.
PAIRS_A_KEY, LOST = 2048, 1e-6
_SEEDS = np.random.Generator(np.random.PCG64(4711)).integers(1, 1 << 63, WIDE, dtype=np.uint64)
_ODD = np.random.Generator(np.random.PCG64(4712)).integers(1, 1 << 62, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def level_hash(tree: int, level: int) -> int:
    """The hash by which a tree branches at a level (from 1). No other tree or level has it."""
    return tree + (level - 1) * TREES


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted within each row, and where each row's begin."""
    tokens, at = shingles(*all_words(data, offsets, fold=True), size)
    cut, n = bounds(at, len(offsets) - 1), len(offsets) - 1
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        tokens[a:b].sort()
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (at[1:] != at[:-1])
    return tokens[fresh], bounds(at[fresh], n)


def _digest(tokens: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """16 bytes that name each row's set."""
    sums = [np.r_[np.uint64(0), np.cumsum(mix(tokens ^ np.uint64(s)), dtype=np.uint64)] for s in (0x1234567, 0xABCDEF9)]
    names = np.stack([s[cut[1:]] - s[cut[:-1]] for s in sums], axis=1)
    return [x.tobytes() for x in names]


def _least(tokens: np.ndarray, cut: np.ndarray, hashes: int = HASHES, bits: int = 32) -> np.ndarray:
    """The least token of each non-empty row under each of the first hashes, cut to its low or high bits."""
    filled = np.flatnonzero(cut[1:] > cut[:-1])
    out = np.zeros((len(cut) - 1, hashes), np.uint32 if bits == 32 else np.uint8)
    if len(filled):
        for k in range(hashes):
            least = np.minimum.reduceat((tokens ^ _SEEDS[k]) * _ODD[k], cut[:-1][filled])
            out[filled, k] = mix(least) >> np.uint64(64 - bits)
    return out


def agreement(n: int, num: int, den: int, bits: int = 32) -> int:
    """How many of n sketched values of a linked pair agree at least, but for ``LOST`` of the pairs: the exact binomial tail."""
    p = num / den + (1 - num / den) / 2**bits
    if p >= 1:
        return n
    below = 0.0
    for k in range(n + 1):
        below += exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p))
        if below > LOST:
            return k
    return n


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), set_id, least (a least token for each hash) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                tokens, cut_ = sets(data, offsets, size)
                least = _least(tokens, cut_).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, HASHES, dtype=np.int32)), pa.array(least.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(cut_)), pa.array(_digest(tokens, cut_), pa.binary()), lists], ["doc_id", "n", "set_id", "least"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, least array<int>")


def _alike(x: Column, y: Column) -> Column:
    """How many least tokens agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda same: same))


def _rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that may hold the text of a wanted class (rep, set_id): those with its id."""
    reps = wanted.select(F.col("rep").alias("doc_id")).distinct()
    return rows.join(F.broadcast(reps) if wanted.count() <= SMALL else reps, "doc_id", "left_semi").select("text")


def _texts(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id and text of the wanted classes. Only rows of their ids are cut into shingles again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(0)):
                names = _digest(*sets(data, offsets, size))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), batch.column(0).slice(first, end - first)], ["set_id", "text"])

    named = _rows_of(rows, wanted).mapInArrow(run, "set_id binary, text binary")
    return named.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("text").alias("text"))


def _wide(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """set_id and wide sketch of the wanted classes: a byte for each hash, and one more for those of the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                tokens, cut_ = sets(data, offsets, size)
                found = np.concatenate([_least(tokens, cut_, WIDE, 8), _least(tokens, cut_, HASHES, 32).astype(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(_digest(tokens, cut_), pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["set_id", "wide"])

    named = _rows_of(rows, wanted).mapInArrow(run, "set_id binary, wide binary")
    return named.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("wide").alias("wide"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows of one key at a time, of batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


PAIRS = "key long, a long, set_a binary, b long, set_b binary"


def _compared(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one node that may be linked: (node, tree, size, rep, set_id, root, n, wide), in blocks that fit a task.

    A pair that stays together on all levels of an earlier tree was compared there, and isn't listed again.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(key.alias("key"), "tree", "own", (F.col("own") == F.col("other")).alias("alone"), "rep", "set_id", "root", "n", "wide")
    least = agreement(WIDE, num, den, 8)
    paths = np.array([[level_hash(t, level) for level in range(1, LEVELS + 1)] for t in range(TREES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _grouped(batches):
            tree, own, rep, root, n = (table.column(c).to_numpy() for c in ("tree", "own", "rep", "root", "n"))
            before = paths[: tree[0]]
            alone = table.column("alone").combine_chunks().to_numpy(zero_copy_only=False)
            wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint8).reshape(len(rep), WIDE + HASHES)
            left, right = [], []
            for i in range(len(rep) - 1):
                fits = (root[i + 1 :] != root[i]) & (np.minimum(n[i + 1 :], n[i]) * den >= np.maximum(n[i + 1 :], n[i]) * num)
                fits &= (own[i + 1 :] == own[i]) if alone[i] else (own[i + 1 :] != own[i])
                near = np.flatnonzero(fits) + i + 1
                same = wide[near] == wide[i]
                fine = same[:, :WIDE].sum(axis=1) >= least
                if len(before):
                    both = same[:, :HASHES] & same[:, WIDE:]
                    fine &= ~both[:, before].all(axis=2).any(axis=1)
                near = near[fine]
                left += [i] * len(near)
                right += near.tolist()
            if left:
                names, x, y = table.column("set_id").combine_chunks(), np.array(left), np.array(right)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), pa.int64()), pa.array(rep[x]), names.take(pa.array(x)), pa.array(rep[y]), names.take(pa.array(y))], ["key", "a", "set_a", "b", "set_b"])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "set_id").mapInArrow(run, PAIRS)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among keyed pairs: a key's texts come first, each once, then its pairs."""
    sides = pairs.select("key", F.col("set_a").alias("set_id")).unionAll(pairs.select("key", F.col("set_b").alias("set_id"))).distinct()
    none = F.lit(None)
    said = sides.join(texts, "set_id").select("key", F.lit(0).alias("part"), "set_id", "text", none.cast("long").alias("a"), none.cast("long").alias("b"), none.cast("binary").alias("set_b"))
    asked = pairs.select("key", F.lit(1).alias("part"), F.col("set_a").alias("set_id"), none.cast("binary").alias("text"), "a", "b", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            links = []
            for key, part, name, text, a, b, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    now, held = key, {}
                if part == 0:
                    held[name] = sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), size)[0]
                else:
                    x, y = held[name], held[other]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return said.unionAll(asked).repartition(n, "key").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least id reachable by links) and kept."""
    rows = _prepared(docs, id_col, text_col)
    kept, held = Tables(docs.sparkSession), Tables(docs.sparkSession)
    sketched = kept.add(sketches(rows, size))
    usable = sketched.where("doc_id is not null and n > 0")
    # A class is named by its least document.
    found = usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("least").alias("least"))
    classes = kept.add(found)
    nodes, star = _first_level(classes, held, num, den)
    first = held.add(_verified(star, _texts(rows, _sides(star), size), size, num, den).unionAll(_of_one_id(usable, classes)))
    roots = components(first, held)
    compare = _mixed_nodes(classes, nodes, roots, held)
    held.drop(nodes, star, first)
    met = classes.select("rep", "set_id", "n").join(compare.select("set_id").distinct(), "set_id")
    wide = held.add(met.join(_wide(rows, held.add(met.select("rep", "set_id")), size), "set_id"))
    found = _compared(compare.join(wide, "set_id"), num, den).groupBy("set_a", "set_b").agg(F.min(F.struct("key", "a", "b")).alias("p"))
    pairs = held.add(_split(held.add(found.select("p.key", "p.a", "set_a", "p.b", "set_b")), both=True))
    second = _verified(pairs, _texts(rows, _sides(pairs), size), size, num, den)
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(second)
    joined = kept.add(components(links, held))
    held.clear()

    named = sketched.select("doc_id", "n", "set_id").join(classes.select("set_id", "rep"), "set_id", "left")
    named = named.join(joined.select(F.col("node").alias("rep"), "root"), "rep", "left")
    whole = F.when(F.col("n") > 0, F.coalesce("root", "rep")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), whole).alias("component_id")
    out = named.select("doc_id", F.col("n").alias("n_shingles"), component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _of_one_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id."""
    members = usable.select("doc_id", "set_id").join(classes.select("set_id", "rep"), "set_id").select("doc_id", "rep")
    shared = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b <> high")
    return members.join(shared.select("doc_id", "b"), "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b")


def _first_level(classes: DataFrame, held: Tables, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(node, tree, set_id) of nodes with two members or more, and the pairs of members with the least of their node."""
    least = F.posexplode(F.slice("least", 1, TREES)).alias("tree", "token")
    nodes = classes.select("rep", "set_id", least).withColumn("node", F.xxhash64("tree", "token")).drop("token")
    centre = nodes.groupBy("node").agg(F.min(F.struct("rep", "set_id")).alias("c"), F.count("*").alias("size")).where("size > 1")
    nodes = nodes.join(centre.select("node", F.col("c.set_id").alias("centre")), "node")
    nodes = held.add(nodes.select("node", "tree", "set_id", "centre"))
    star = nodes.where("set_id <> centre").select(F.col("centre").alias("set_a"), F.col("set_id").alias("set_b")).distinct()
    for side in ("a", "b"):
        told = {"set_id": f"set_{side}", "rep": side, "n": f"n_{side}", "least": f"least_{side}"}
        star = star.join(classes.select(*(F.col(c).alias(x) for c, x in told.items())), f"set_{side}")
    fits = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    near = _alike(F.col("least_a"), F.col("least_b")) >= agreement(HASHES, num, den)
    star = held.add(star.where(fits & near).select(F.xxhash64("set_a").alias("key"), "a", "set_a", "b", "set_b"))
    return nodes, held.add(_split(star, both=False))


def _split(pairs: DataFrame, both: bool) -> DataFrame:
    """The pairs with a key for each block of about ``PAIRS_A_KEY`` of them, by hashes of both sides or of the second one."""
    sizes = pairs.groupBy("key").agg(F.ceil(F.count("*") / PAIRS_A_KEY).alias("need")).where("need > 1")
    parts = F.ceil(F.sqrt("need")) if both else F.col("need")
    sides = ["set_a", "set_b"] if both else ["set_b"]
    own = F.xxhash64("key", *(F.pmod(F.xxhash64(side), "parts") for side in sides))
    told = pairs.join(sizes.select("key", parts.alias("parts")), "key", "left")
    return told.select(F.when(F.col("parts").isNull(), F.col("key")).otherwise(own).alias("key"), "a", "set_a", "b", "set_b")


def _mixed_nodes(classes: DataFrame, nodes: DataFrame, roots: DataFrame, held: Tables) -> DataFrame:
    """(node, tree, size, set_id, root) of the nodes to compare: those that hold several components, level by level."""
    known = classes.select("rep", "set_id").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("set_id", F.coalesce("root", "rep").alias("root"))
    rest, compare = nodes.select("node", "tree", "set_id").join(known, "set_id"), None
    for level in range(1, LEVELS + 1):
        if level > 1:
            branch = F.array(*(F.get("least", F.lit(level_hash(t, level))) for t in range(TREES)))
            rest = rest.join(classes.select("set_id", "least"), "set_id")
            rest = rest.withColumn("node", F.xxhash64("node", F.get(branch, F.col("tree")))).select("node", "tree", "set_id", "root")
        several = rest.groupBy("node").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
        several = several.where("low <> high").select("node", "size")
        mixed = held.add(rest.join(several, "node").select("node", "tree", "size", "set_id", "root"))
        done = mixed if level == LEVELS else mixed.where(F.col("size") <= NODE)
        compare = done if compare is None else compare.unionAll(done)
        rest = mixed.where(F.col("size") > NODE).drop("size")
    return compare


def _sides(pairs: DataFrame) -> DataFrame:
    """The classes (rep, set_id) of pairs."""
    return pairs.select(F.col("a").alias("rep"), F.col("set_a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("rep"), F.col("set_b").alias("set_id"))).distinct()


def sql(size: int = 4, num: int = 80, den: int = 100) -> str:
    """The same in DuckDB, by sets of shingle texts and reachability."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(list_slice(w, i, i + {size - 1}), ' '))) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id"""
