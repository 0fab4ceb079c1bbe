"""Entries to a linked tree: dense positions, parents, and what ancestors hand down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions import BACKSLASH, extension
from burrow.store import shared_folder

ROOT_REF = 5
MOST_STEPS = 64
_DOUBLINGS = 6  # 2 ** 6 steps


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_positions(raw: DataFrame, *order: str) -> DataFrame:
    """Adds entry_idx: dense positions from 0 within each drive, in the given order.

    Rows are dealt by range and sorted within partitions; a partition's first position
    follows from the counts of those before it. No drive is ever sorted in one task.
    """
    keys = ["drive", *order]
    n = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = raw.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"))
    counts = placed.groupBy("drive", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("low"))  # a row for each drive and partition
    before = Window.partitionBy("drive").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).select("drive", "_part", "base")
    return placed.join(offsets, ["drive", "_part"]).withColumn("entry_idx", F.col("_at") + F.col("base")).drop("_part", "_at", "base")


def first_by_ref(entries: DataFrame, live_only: bool = False) -> DataFrame:
    """drive, mft_ref, idx: the first entry of each reference; a reload also skips tombstones."""
    rows = entries.where(~F.col("is_deleted")) if live_only else entries
    return rows.groupBy("drive", "mft_ref").agg(F.min("entry_idx").alias("idx"))


def link_parents(entries: DataFrame) -> DataFrame:
    """Adds parent_idx: the first entry of the parent's reference; -1 for roots and orphans. Only folders are met: nothing else is a parent."""
    firsts = first_by_ref(entries).select("drive", F.col("mft_ref").alias("parent_ref"), "idx")
    used = entries.select("drive", "parent_ref").distinct()
    joined = entries.join(firsts.join(used, ["drive", "parent_ref"], "left_semi"), ["drive", "parent_ref"], "left")
    return joined.withColumn("parent_idx", F.when(F.col("idx").isNull() | (F.col("idx") == F.col("entry_idx")), -1).otherwise(F.col("idx"))).drop("idx")


def _nearer(own: Column, above: Column, steps: Column) -> Column:
    """The distance of the nearest marked entry, from distances below and above a jump."""
    return F.coalesce(own, F.when(above + steps < MOST_STEPS, above + steps))


def ancestry(linked: DataFrame) -> DataFrame:
    """Adds path, depth, hidden_effective and in_recycle.

    Folders are resolved by doubling: after k rounds each knows 2**k steps of its
    chain and where it goes on, so 64 steps take 6 joins of folders with folders,
    cycles end by themselves, and what lies beyond 64 steps is left out. Every other
    entry then takes over from its parent in one join.
    """
    root = F.col("mft_ref") == ROOT_REF
    parents = linked.select("drive", F.col("parent_idx").alias("entry_idx")).where("entry_idx >= 0").distinct()
    folders = linked.join(parents, ["drive", "entry_idx"], "left_semi")
    state = folders.select(
        "drive", "entry_idx", F.col("parent_idx").alias("next"), F.lit(1).alias("steps"),
        F.when(root, F.array().cast("array<string>")).otherwise(F.array("name")).alias("names"),
        F.when((F.col("parent_idx") >= 0) & F.col("hidden_system"), 0).alias("hid"),
        F.when(F.lower("name") == "$recycle.bin", 0).alias("bin"),
    )
    state = cut(state)
    for _ in range(_DOUBLINGS):
        if state.where("next >= 0").isEmpty():
            break
        above = state.select("drive", F.col("entry_idx").alias("next"), F.col("next").alias("n2"), F.col("steps").alias("s2"), F.col("names").alias("names2"), F.col("hid").alias("hid2"), F.col("bin").alias("bin2"))
        met = state.join(above, ["drive", "next"], "left")
        state = cut(met.select(
            "drive", "entry_idx", F.coalesce("n2", F.lit(-1).cast("long")).alias("next"),
            F.least(F.col("steps") + F.coalesce("s2", F.lit(0)), F.lit(MOST_STEPS)).alias("steps"),
            F.slice(F.concat("names", F.coalesce("names2", F.array().cast("array<string>"))), 1, MOST_STEPS).alias("names"),
            _nearer(F.col("hid"), F.col("hid2"), F.col("steps")).alias("hid"), _nearer(F.col("bin"), F.col("bin2"), F.col("steps")).alias("bin"),
        ))
    up = state.select("drive", F.col("entry_idx").alias("parent_idx"), "steps", "names", "hid", "bin")
    joined = linked.join(up, ["drive", "parent_idx"], "left")
    below = lambda d: F.coalesce(F.col(d) + 1 < MOST_STEPS, F.lit(False))
    names = F.coalesce(F.slice("names", 1, MOST_STEPS - 1), F.array().cast("array<string>"))
    chain = F.reverse(F.when(root, names).otherwise(F.concat(F.array("name"), names)))
    return joined.withColumns(
        {
            "path": F.concat("drive", F.lit(BACKSLASH), F.array_join(chain, BACKSLASH)),
            "depth": F.least(F.coalesce("steps", F.lit(0)) + 1, F.lit(MOST_STEPS)),
            "hidden_effective": (F.col("parent_idx") >= 0) & (F.col("hidden_system") | below("hid")),
            "in_recycle": (F.lower("name") == "$recycle.bin") | below("bin"),
        }
    ).drop("steps", "names", "hid", "bin")


def build(raw: DataFrame, *order: str) -> DataFrame:
    """Raw entries to searchable ones: positions, parents, ancestry and folded names."""
    order = order or ("mft_ref", "name")
    known = raw if "is_deleted" in raw.columns else raw.withColumn("is_deleted", F.lit(False))
    linked = cut(link_parents(with_positions(known, *order)))
    return ancestry(linked).withColumns({"name_lc": F.lower("name"), "ext_lc": extension(F.col("name"))})


def neutral(entries: DataFrame, positions: DataFrame) -> DataFrame:
    """Accessors by position (drive, entry_idx): unknown positions give neutral values."""
    wanted = entries.select("drive", "entry_idx", "is_dir", "is_deleted", "hidden_effective", "parent_idx", "size", "modified", "name")
    out = positions.join(wanted, ["drive", "entry_idx"], "left")
    return out.fillna({"is_dir": False, "is_deleted": False, "hidden_effective": False, "parent_idx": -1, "size": 0, "name": ""}).withColumn("has_metadata", F.col("modified").isNotNull())
