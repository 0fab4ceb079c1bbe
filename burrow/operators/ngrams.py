"""The n-gram index on names: postings, candidates, and the planner's choice of access path.

Grams are windows of three characters without a Hangul syllable and of two with
both, of folded names. Postings are built from the present name, and candidates are
always verified, so a search through the index equals a scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.plans.spec import QuerySpec

_SYLLABLE = re.compile("[가-힣]")


def grams(text: str) -> list[str]:
    """The distinct grams of a folded text, each with its width."""
    found = {f"3:{text[i : i + 3]}" for i in range(len(text) - 2) if not _SYLLABLE.search(text[i : i + 3])}
    return sorted(found | {f"2:{text[i : i + 2]}" for i in range(len(text) - 1) if len(_SYLLABLE.findall(text[i : i + 2])) == 2})


def name_grams(name: Column) -> Column:
    def windows(n: int, fits) -> Column:
        at = F.when(F.length(name) >= n, F.sequence(F.lit(1), F.length(name) - (n - 1))).otherwise(F.array().cast("array<int>"))
        cutouts = F.transform(at, lambda i: F.substring(name, i, F.lit(n)))
        return F.transform(F.filter(cutouts, fits), lambda g: F.concat(F.lit(f"{n}:"), g))

    return F.array_distinct(F.concat(windows(3, lambda g: ~g.rlike("[가-힣]")), windows(2, lambda g: g.rlike("^[가-힣]{2}$"))))


def postings(entries: DataFrame) -> DataFrame:
    """drive, gram, entry_idx: one row for each gram of each entry. No aggregate is needed, since an entry's grams are distinct."""
    return entries.select("drive", "entry_idx", F.explode(name_grams(F.col("name_lc"))).alias("gram")).select("drive", "gram", "entry_idx")


def clustered(posting: DataFrame) -> DataFrame:
    """Postings dealt by range of drive, gram and position, and sorted: in a file a gram's rows lie together, so a lookup
    reads the row groups that may hold it and skips the others. A hot gram is spread over several files.
    """
    n = int(posting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["drive", "gram", "entry_idx"]
    return posting.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def needed(spec: QuerySpec) -> list[str] | None:
    """The grams that every hit holds; None if the index can't prune: a text without grams, or no grams at all."""
    per_text = [grams(t) for t in spec.text]
    if any(not g for g in per_text):
        return None
    fragments = [grams(f) for p in spec.patterns for f in re.split(r"[*?]+", p.lower())]
    return sorted({g for found in per_text + fragments for g in found}) or None


def candidates(posting: DataFrame, wanted: list[str]) -> DataFrame:
    """drive, entry_idx that hold all grams: one partial aggregate in place of an intersection of lists."""
    met = posting.where(F.col("gram").isin(*wanted)).groupBy("drive", "entry_idx").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == len(wanted)).select("drive", "entry_idx")


def pruned(entries: DataFrame, posting: DataFrame | None, spec: QuerySpec, built_at: DataFrame | None = None) -> DataFrame:
    """The entries a query must look at: candidates, and all added after the index was built (drive, built_count); a drive
    without a count is all tail.
    """
    wanted = needed(spec)
    if posting is None or wanted is None:
        return entries
    met = entries.join(candidates(posting, wanted), ["drive", "entry_idx"], "left_semi")
    if built_at is None:
        return met
    since = F.coalesce("built_count", F.lit(0))
    tail = entries.join(F.broadcast(built_at), "drive", "left").where(F.col("entry_idx") >= since).select(*entries.columns)  # one row a drive
    old = met.join(F.broadcast(built_at), "drive").where(F.col("entry_idx") < F.col("built_count")).select(*entries.columns)
    return old.unionByName(tail)


def built_at(entries: DataFrame) -> DataFrame:
    """The watermark of an index built now: drive, built_count."""
    return entries.groupBy("drive").agg((F.max("entry_idx") + 1).alias("built_count"))


def probe_stats(entries: DataFrame, posting: DataFrame | None) -> DataFrame:
    """Entries, grams and postings of each drive; an index that was cleared has none."""
    n = entries.groupBy("drive").agg(F.count("*").alias("entries"))
    if posting is None:
        return n.withColumns({"grams": F.lit(0).cast("long"), "postings": F.lit(0).cast("long")})
    return n.join(gram_count(posting), "drive", "left").fillna(0, ["grams", "postings"])


def gram_count(posting: DataFrame) -> DataFrame:
    return posting.groupBy("drive").agg(F.countDistinct("gram").alias("grams"), F.count("*").alias("postings"))
