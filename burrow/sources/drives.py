"""The drives dimension: which drives are indexed, which are saved, and how their table changes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letter(root: Column) -> Column:
    return F.regexp_replace(root, r"\\+$", "")


def is_removable() -> Column:
    return F.col("type") == "Removable"


def indexable(drives: DataFrame, include_removable: bool = False) -> DataFrame:
    """Ready NTFS drives that are fixed, or removable if asked for."""
    kind = (F.col("type") == "Fixed") | (is_removable() & F.lit(include_removable))
    return drives.where(kind & F.col("ready") & (F.upper("fs") == "NTFS")).withColumn("drive", letter(F.col("root")))


def active(entries: DataFrame, drives: DataFrame) -> DataFrame:
    """Entries of drives whose index is ready."""
    return entries.join(drives.where("index_ready").select(letter(F.col("root")).alias("drive")), "drive", "left_semi")


def lookup(drives: DataFrame, name: str) -> DataFrame:
    """A drive by its letter, in any case."""
    return drives.where(F.upper(letter(F.col("root"))) == name.rstrip("\\").upper()).limit(1)


def to_save(drives: DataFrame) -> DataFrame:
    """Drives whose snapshot is worth keeping: indexed, with a journal, not removable."""
    return drives.where(F.col("index_ready") & (F.col("journal_id") != 0) & ~is_removable()).select(letter(F.col("root")).alias("drive"), "volume_serial", "journal_id", "next_usn")


def upsert(drives: DataFrame, arrived: DataFrame) -> DataFrame:
    """Drives after arrivals; an arrival replaces the drive of its root."""
    rest = drives.join(arrived.select(F.upper("root").alias("_r")), F.upper("root") == F.col("_r"), "left_anti")
    return rest.unionByName(arrived)


def remove(drives: DataFrame, mask: Column) -> DataFrame:
    """Drives without those of a unit mask."""
    from burrow.functions import drive_letters

    return drives.where(~F.array_contains(drive_letters(mask), F.upper(F.substring("root", 1, 1))))


def without_removable(entries: DataFrame, drives: DataFrame) -> DataFrame:
    return entries.join(drives.where(is_removable()).select(letter(F.col("root")).alias("drive")), "drive", "left_anti")


def missing_removable(drives: DataFrame, entries: DataFrame) -> DataFrame:
    """Removable drives that are ready and not indexed yet: what switching them on has to build."""
    ready = indexable(drives, include_removable=True).where(is_removable())
    return ready.join(entries.select("drive").distinct(), "drive", "left_anti")


def with_ready(drives: DataFrame, root: str, probe, tries: int = 8, wait: float = 0.5) -> DataFrame:
    """Drives after a device arrived: ``probe`` is asked up to ``tries`` times whether it is ready."""
    ready = False
    for k in range(tries):
        if ready := bool(probe(root)):
            break
        if k < tries - 1:
            time.sleep(wait)
    here = F.upper(letter(F.col("root"))) == letter(F.lit(root.upper()))
    return drives.withColumn("ready", F.when(here, F.lit(ready)).otherwise(F.col("ready")))
