"""Mixing sources to target weights by iterative proportional fitting.

The tokens of the corpus are counted by source, language and topic. Raking scales
the cells until the marginals of all three meet their targets to ``tolerance``, or for
``rounds`` rounds, and the deviation that is left is reported. ``targets`` gives shares by
dimension and value; values that aren't named share what is left of 1 by their tempered
tokens, and a dimension without targets keeps its tempered shares. Every document is
sampled with a probability in proportion to its cell's weight, at most 1, such that the
expected tokens are ``rate`` of all tokens. A cell whose share would pass 1 is taken whole
and keeps the rest as a repeat factor over 1; sampled tokens times their factor meet the
targets. Chance is a digest of the id, so a rerun, or a lost executor, gives the same sample.

The table of cells is counted in full. Up to ``SMALL`` cells it is raked on the
driver, beyond that as a DataFrame; both give the same weights. Rows are counted by
partial aggregates and meet the weights of their cells in a broadcast, or beyond ``SMALL``
cells in a join that Spark splits where a cell is hot.

Nulls: a null source or language is a value of its own; a null text is empty and
has 0 tokens, topic ``empty`` and the weight of its cell; cells without tokens weigh
1. A null id draws the same chance as an empty one. Repeated rows are sampled alike. An
empty table gives no rows. Targets for values that the corpus lacks are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.store import Tables

ROUNDS, TOLERANCE = 200, 1e-9
TEMPER = 0.7
RATE = 0.5
SMALL = 50_000
DIMENSIONS = ("source", "language", "topic")
Targets = Mapping[str, Mapping[str | None, float]]


def key_of(value: str | None) -> str:
    """A value as cells have it: null is a value of its own."""
    return "null" if value is None else f"={value}"


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column, tokens: Column) -> Column:
    """A topic by plain cues: empty, tabular, legal, numeric, long or short prose."""
    return (
        F.when(tokens == 0, "empty").when(F.instr(text, " | ") > 0, "tabular").when(text.rlike("[Ll]icensed|[Ll]icense|rights reserved"), "legal")
        .when(text.rlike("[0-9]{4}"), "numeric").when(tokens >= 400, "long").otherwise("short")
    )


def _rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Weights of the cells, and the largest relative deviation of a marginal from its target."""
    weight, off = np.ones(len(tokens)), np.inf
    have = lambda code, target: np.bincount(code, tokens * weight, len(target))
    for _ in range(rounds):
        for code, target in zip(codes, targets, strict=True):
            now = have(code, target)
            weight = weight * np.where(now > 0, target / np.where(now > 0, now, 1), 1)[code]
        off = max(np.abs(have(c, t)[t > 0] / t[t > 0] - 1).max(initial=0) for c, t in zip(codes, targets, strict=True))
        if off <= tolerance:
            break
    return weight, float(off)


def tempered(tokens: np.ndarray, temper: float) -> np.ndarray:
    scaled = np.where(tokens > 0, np.maximum(tokens, 1) ** temper, 0)
    return scaled * (tokens.sum() / scaled.sum())


def aimed(values: list[str], tokens: np.ndarray, temper: float, wanted: Mapping[str | None, float]) -> np.ndarray:
    """The target tokens of a dimension's values: shares as wanted, the others by what is left of 1."""
    base, shares = tempered(tokens, temper), {key_of(k): float(v) for k, v in wanted.items()}
    named = np.array([v in shares for v in values]) & (tokens > 0)
    if not named.any():
        return base
    asked = np.array([shares.get(v, 0.0) for v in values]) * named
    rest = max(0.0, 1 - sum(shares.values())) if (base[~named] > 0).any() else 0.0
    out = asked + (rest * base * ~named / max(base[~named].sum(), 1e-300))
    return out * (tokens.sum() / out.sum()) if out.sum() else base


def weights_small(cells: list[tuple], temper: float = TEMPER, rounds: int = ROUNDS, targets: Targets | None = None, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights of cells (source, language, topic, tokens), and the deviation that is left."""
    tokens = np.array([c[3] for c in cells], float)
    if not tokens.sum():
        return np.ones(len(cells)), 0.0
    codes, goals = [], []
    for k, d in enumerate(DIMENSIONS):
        values = {v: i for i, v in enumerate(dict.fromkeys(c[k] for c in cells))}
        codes.append(np.array([values[c[k]] for c in cells]))
        goals.append(aimed(list(values), np.bincount(codes[-1], tokens, len(values)), temper, (targets or {}).get(d, {})))
    weight, off = _rake(tokens, codes, goals, rounds, tolerance)
    return np.where(tokens > 0, weight, 1.0), off


def scale_small(tokens: np.ndarray, weight: np.ndarray, rate: float) -> float:
    """The c at which the tokens times min(1, c * weight) are ``rate`` of all tokens."""
    if not tokens.sum():
        return rate
    order = np.lexsort((tokens, -weight))
    n, w = tokens[order], weight[order]
    before, rest = np.cumsum(n) - n, np.cumsum((n * w)[::-1])[::-1]
    c = (rate * n.sum() - before) / np.maximum(rest, 1e-300)
    return float(c[np.argmax((c * w <= 1) & (rest > 0))])


def scale_large(cells: DataFrame, rate: float, steps: int = 40) -> float:
    """The same by bisection over aggregates of the cells."""
    total, top = cells.agg(F.sum("tokens"), F.max("weight")).first()
    if not total:
        return rate
    low, high = 0.0, rate
    while cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * high))).first()[0] < rate * total and high * top < 1e12:
        low, high = high, 2 * high
    for _ in range(steps):
        mid = (low + high) / 2
        if cells.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * mid))).first()[0] < rate * total:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def _aimed_large(cells: DataFrame, dimension: str, total: float, temper: float, wanted: Mapping[str | None, float]) -> DataFrame:
    """_d (a value) and _t (its target tokens), as ``aimed`` has them."""
    base = cells.groupBy(F.col(dimension).alias("_d")).agg(F.sum("tokens").alias("n")).where("n > 0").withColumn("base", F.pow("n", F.lit(temper)))
    shares = [(key_of(k), float(v)) for k, v in wanted.items()]
    asked = F.broadcast(cells.sparkSession.createDataFrame(shares, "_d string, share double"))  # a parameter
    told = base.join(asked, "_d", "left")
    named, others = told.agg(F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("base")))).first()
    rest = max(0.0, 1 - sum(v for _, v in shares)) if others else 0.0
    if named is None or not named + rest:
        rest, others, told = 1.0, told.agg(F.sum("base")).first()[0], told.withColumn("share", F.lit(None).cast("double"))
    share = F.coalesce("share", F.col("base") * (rest / others if others else 0.0))
    return told.select("_d", (share * (total / ((named or 0.0) + rest))).alias("_t"))


def weights_large(cells: DataFrame, tables: Tables, temper: float = TEMPER, rounds: int = ROUNDS, targets: Targets | None = None, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """The same for any number of cells: aggregates of cells, joined back; a table for each step, and the one before it goes."""
    total, off = cells.agg(F.sum("tokens")).first()[0] or 0, 0.0
    out = tables.add(cells.withColumn("weight", F.lit(1.0)))
    if not total:
        return out, off
    goals = [tables.add(_aimed_large(cells, d, float(total), temper, (targets or {}).get(d, {}))) for d in DIMENSIONS]
    scale = lambda d, goal: out.groupBy(F.col(d).alias("_d")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_h")).join(goal, "_d").where("_h > 0").select("_d", (F.col("_t") / F.col("_h")).alias("_s"))
    for _ in range(rounds):
        for d, goal in zip(DIMENSIONS, goals, strict=True):
            joined = out.join(scale(d, goal), out[d] == F.col("_d"), "left")
            last, out = out, tables.add(joined.withColumn("weight", F.col("weight") * F.coalesce("_s", F.lit(1.0))).drop("_d", "_s"))
            tables.drop(last)
        off = max(scale(d, goal).where("_s > 0").agg(F.max(F.abs(1 / F.col("_s") - 1))).first()[0] or 0.0 for d, goal in zip(DIMENSIONS, goals, strict=True))
        if off <= tolerance:
            break
    return out.withColumn("weight", F.when(F.col("tokens") > 0, F.col("weight")).otherwise(1.0)), off


def described(docs: DataFrame) -> DataFrame:
    """row (all columns of a document), source, language, topic and tokens; a null source or language is a value of its own."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"row.{c}").cast("string")), F.lit("null"))
    counted = rows.withColumn("tokens", n_tokens(text))
    return counted.withColumns({"source": known("source"), "language": known("lang"), "topic": topic(text, F.col("tokens"))})


def mix(
    docs: DataFrame, temper: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS, small: int = SMALL,
    targets: Targets | None = None, tolerance: float = TOLERANCE,
) -> DataFrame:
    """Of each document: row (its columns), source, language, topic, tokens, weight, probability, repeat, residual and sampled.

    residual: the largest relative deviation of a marginal from its target, the same in all rows.
    """
    return mixed(described(docs), temper, rate, rounds, small, targets, tolerance)


def mixed(rows: DataFrame, temper: float = TEMPER, rate: float = RATE, rounds: int = ROUNDS, small: int = SMALL, targets: Targets | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``mix`` of described rows."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    head = cells.limit(small + 1).collect()
    spark = rows.sparkSession
    if len(head) <= small:
        head = sorted(map(tuple, head))
        found, off = weights_small(head, temper, rounds, targets, tolerance)
        scale = scale_small(np.array([c[3] for c in head], float), found, rate) if head else rate
        told = [(*c[:3], float(w)) for c, w in zip(head, found, strict=True)]
        weights = F.broadcast(spark.createDataFrame(told, "source string, language string, topic string, weight double"))
    else:
        tables, kept = Tables(spark), Tables(spark)
        weighed, off = weights_large(tables.add(cells), tables, temper, rounds, targets, tolerance)
        weighed = kept.add(weighed)
        tables.clear()
        scale = scale_large(weighed, rate)
        weights = weighed.select(*DIMENSIONS, "weight")
    digest = F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary"))
    chance = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    scaled = F.col("weight") * scale
    joined = rows.join(weights, list(DIMENSIONS))
    chosen = joined.withColumns({"probability": F.round(F.least(F.lit(1.0), scaled), 9), "repeat": F.round(F.greatest(F.lit(1.0), scaled), 6)})
    out = chosen.withColumns({"weight": F.round("weight", 6), "residual": F.lit(off), "sampled": chance < F.col("probability")})
    return out.select("row", *DIMENSIONS, "tokens", "weight", "probability", "repeat", "residual", "sampled")


def mix_report(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The mix of each document, without its text, which is read once: what is told of it goes to a table."""
    strip = lambda c: F.when(F.col(c) != "null", F.substring(c, 2, 1 << 20))
    rows = described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang"))
    narrow = Tables(docs.sparkSession).add(rows.select(F.struct("row.doc_id").alias("row"), *DIMENSIONS, "tokens"))
    said = [strip("source").alias("source"), strip("language").alias("language"), "topic", "tokens", "weight"]
    done = (F.col("residual") <= 1e-6).alias("converged")
    return mixed(narrow, rounds=rounds).select(F.col("row.doc_id").alias("doc_id"), *said, F.round("probability", 6).alias("probability"), "repeat", done, "sampled")


def sql(rounds: int = ROUNDS, temper: float = TEMPER, rate: float = RATE, tolerance: float = TOLERANCE) -> str:
    """The same in DuckDB: a recursion over rounds, with the sums of the marginals as windows."""
    step = "w"
    rake = {}
    for d in DIMENSIONS:
        rake[d] = f"{step} * coalesce(t_{d} / nullif(sum(tokens * {step}) OVER (PARTITION BY {d}), 0), 1)"
        step = f"w_{d}"
    off = ", ".join(f"max(CASE WHEN t_{d} > 0 THEN abs(h_{d} / t_{d} - 1) ELSE 0 END) OVER ()" for d in DIMENSIONS)
    have = ", ".join(f"sum(tokens * w_topic) OVER (PARTITION BY {d}) AS h_{d}" for d in DIMENSIONS)
    goals = ", ".join(f"t_{d} AS MATERIALIZED (SELECT {d}, pow(n, {temper}) * sum(n) OVER () / sum(pow(n, {temper})) OVER () AS t_{d} FROM (SELECT {d}, CAST(sum(tokens) AS DOUBLE) AS n FROM cells GROUP BY {d}) WHERE n > 0)" for d in DIMENSIONS)
    joined = " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    fixed = "source, language, topic, tokens, t_source, t_language, t_topic"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, 'null') AS source, coalesce('=' || lang, 'null') AS language, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
e AS MATERIALIZED (SELECT doc_id, source, language, tokens, CASE WHEN tokens = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'tabular' WHEN regexp_matches(text, '[Ll]icensed|[Ll]icense|rights reserved') THEN 'legal' WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'numeric' WHEN tokens >= 400 THEN 'long' ELSE 'short' END AS topic FROM d),
cells AS MATERIALIZED (SELECT source, language, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM e GROUP BY ALL), {goals},
r AS (SELECT 0 AS k, {fixed}, CAST(1 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS off FROM cells {joined}
 UNION ALL SELECT k + 1, {fixed}, w_topic, greatest({off}) FROM (SELECT *, {have} FROM (SELECT *, {rake["topic"]} AS w_topic FROM (SELECT *, {rake["language"]} AS w_language FROM (SELECT *, {rake["source"]} AS w_source FROM r WHERE k < {rounds} AND off > {tolerance:.15f}))))),
w AS (SELECT source, language, topic, tokens, CASE WHEN tokens > 0 THEN w ELSE 1 END AS w, CASE WHEN sum(tokens) OVER () > 0 THEN off ELSE 0 END AS off FROM r WHERE k = (SELECT max(k) FROM r)),
o AS (SELECT w, tokens, row_number() OVER h AS k, sum(tokens) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before, sum(tokens * w) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(tokens) OVER () AS total FROM w WINDOW h AS (ORDER BY w DESC, tokens)),
c AS (SELECT coalesce(arg_min(({rate} * total - before) / rest, k) FILTER (WHERE rest > 0 AND ({rate} * total - before) / rest * w <= 1), {rate}) AS c FROM o),
p AS (SELECT e.*, w, off, round(least(1, w * c), 9) AS p, round(greatest(1, w * c), 6) AS repeat FROM e JOIN w USING (source, language, topic), c)
SELECT doc_id, CASE WHEN source <> 'null' THEN substr(source, 2) END AS source, CASE WHEN language <> 'null' THEN substr(language, 2) END AS language, topic, CAST(tokens AS BIGINT) AS tokens,
  round(w, 6) AS weight, round(p, 6) AS probability, repeat, off <= 0.000001 AS converged, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS sampled FROM p"""
