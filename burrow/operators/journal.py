"""Change journals: actions, and the fold of a batch into entries, as joins and aggregates.

Order is the usn, never a clock. Per drive and reference: the last deletion decides
whether the base entry lives; the first creation after it is the birth, ignored while
the base lives; the last rename after the birth names it; the parent stays that of
the birth. Only the first hard link of a reference is mapped to it, the others
survive its deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.functions import hidden_and_system
from burrow.operators.tree import first_by_ref

#: Bits of a record's reason.
CREATE, DELETE, RENAME_OLD, RENAME_NEW, CLOSE = 0x100, 0x200, 0x1000, 0x2000, 0x80000000


def action(reason: Column) -> Column:
    """D before R before C; other records do nothing."""
    has = lambda bit: reason.bitwiseAND(F.lit(bit).cast("long")) != 0
    return F.when(has(DELETE), "D").when(has(RENAME_NEW), "R").when(has(CREATE), "C").otherwise("-")


def actions(journal: DataFrame) -> DataFrame:
    return journal.withColumn("action", action(F.col("reason")))


def counters(journal: DataFrame) -> DataFrame:
    """Records processed and attempts of each kind."""
    a = F.col("action")
    return actions(journal).groupBy("drive").agg(F.count("*").alias("processed"), F.count_if(a == "C").alias("added"), F.count_if(a == "D").alias("removed"), F.count_if(a == "R").alias("renamed"))


def live_metrics(journal: DataFrame, drives: DataFrame) -> DataFrame:
    """The counters of each drive with the last usn seen, and how far that is behind the journal's next one."""
    seen = counters(journal).join(journal.groupBy("drive").agg(F.max("usn").alias("last_usn")), "drive")
    ends = drives.select(F.regexp_replace("root", r"\\+$", "").alias("drive"), "next_usn")
    return seen.join(F.broadcast(ends), "drive", "left").withColumn("behind", F.greatest(F.col("next_usn") - F.col("last_usn") - 1, F.lit(0))).drop("next_usn")  # one row a drive


def between(journal: DataFrame, start: int, end: int) -> DataFrame:
    """A bounded catch-up read."""
    return journal.where((F.col("usn") >= start) & (F.col("usn") < end))


def resumable(journal_id: int, lowest_valid: int, saved_id: int, saved_usn: int) -> bool:
    """Whether a snapshot can be brought up to date; otherwise it is rebuilt."""
    return saved_id != 0 and saved_id == journal_id and saved_usn >= lowest_valid


def fold(base: DataFrame, journal: DataFrame, apply_moves: bool = False) -> DataFrame:
    """Live references after a journal: drive, mft_ref, birth_usn (-1: of the base), name, parent_ref, file_attributes.

    ``base``: drive, mft_ref, name, parent_ref, one row a reference. Three aggregates of the
    journal by reference hold all that matters of it: the last deletion, the first creation
    after it and the last rename after that, each needing the one before; no history is gathered.
    """
    acts = actions(journal).where("action <> '-'")
    deleted = acts.where("action = 'D'").groupBy("drive", "mft_ref").agg(F.max("usn").alias("last_del"))
    later = acts.join(deleted, ["drive", "mft_ref"], "left")
    fresh = later.where((F.col("action") == "C") & (F.col("usn") > F.coalesce("last_del", F.lit(-1))))
    born = fresh.groupBy("drive", "mft_ref").agg(F.min(F.struct("usn", "name", "parent_ref", "file_attributes")).alias("b"))
    state = base.select("drive", "mft_ref", F.col("name").alias("base_name"), F.col("parent_ref").alias("base_parent"), F.lit(True).alias("in_base"))
    whole = state.join(deleted, ["drive", "mft_ref"], "left").join(born, ["drive", "mft_ref"], "full")
    stays = F.col("in_base").isNotNull() & F.col("last_del").isNull()
    alive = whole.where(stays | F.col("b").isNotNull()).select(
        "drive", "mft_ref", F.when(stays, -1).otherwise(F.col("b.usn")).alias("birth_usn"), F.when(stays, F.col("base_name")).otherwise(F.col("b.name")).alias("name"),
        F.when(stays, F.col("base_parent")).otherwise(F.col("b.parent_ref")).alias("parent_ref"), F.when(stays, F.lit(None)).otherwise(F.col("b.file_attributes")).alias("file_attributes"),
    )
    renames = acts.where("action = 'R'").select("drive", "mft_ref", "usn", F.col("name").alias("to_name"), F.col("parent_ref").alias("to_parent"))
    last = renames.join(alive.select("drive", "mft_ref", "birth_usn"), ["drive", "mft_ref"]).where("usn > birth_usn").groupBy("drive", "mft_ref").agg(F.max(F.struct("usn", "to_name", "to_parent")).alias("r"))
    moved = F.coalesce("r.to_parent", "parent_ref") if apply_moves else F.col("parent_ref")
    return alive.join(last, ["drive", "mft_ref"], "left").select("drive", "mft_ref", "birth_usn", F.coalesce("r.to_name", "name").alias("name"), moved.alias("parent_ref"), "file_attributes")


def base_of(entries: DataFrame) -> DataFrame:
    """The mapped entry of each reference: the first hard link that isn't a tombstone."""
    rows = entries.where(~F.col("is_deleted"))
    return rows.groupBy("drive", "mft_ref").agg(F.min(F.struct("entry_idx", "name", "parent_ref", "parent_idx")).alias("e")).select("drive", "mft_ref", F.col("e.entry_idx").alias("entry_idx"), F.col("e.name").alias("name"), F.col("e.parent_ref").alias("parent_ref"))


def apply(entries: DataFrame, journal: DataFrame, apply_moves: bool = False) -> DataFrame:
    """Raw entries after a journal, tombstones and surviving hard links included, ready to be built again.

    A new entry has no size and no date, and takes its hidden flag from its attributes.
    """
    raw = ["drive", "mft_ref", "parent_ref", "name", "is_dir", "hidden_system", "is_deleted", "size", "modified"]
    after = fold(base_of(entries), journal, apply_moves)
    mapped = first_by_ref(entries, live_only=True).withColumnRenamed("idx", "entry_idx").withColumn("mapped", F.lit(True))
    kept = after.where("birth_usn < 0").select("drive", "mft_ref", F.col("name").alias("_name"), F.col("parent_ref").alias("_parent"))
    old = entries.join(mapped, ["drive", "mft_ref", "entry_idx"], "left").join(kept, ["drive", "mft_ref"], "left")
    is_mapped, lives = F.coalesce("mapped", F.lit(False)), F.col("_name").isNotNull()
    old = old.withColumns({"name": F.when(is_mapped & lives, F.col("_name")).otherwise(F.col("name")), "parent_ref": F.when(is_mapped & lives, F.col("_parent")).otherwise(F.col("parent_ref")), "is_deleted": F.col("is_deleted") | (is_mapped & ~lives)})
    attributes = F.coalesce("file_attributes", F.lit(0))
    new = after.where("birth_usn >= 0").select("drive", "mft_ref", "parent_ref", "name", (attributes.bitwiseAND(F.lit(0x10)) != 0).alias("is_dir"), hidden_and_system(attributes).alias("hidden_system"), F.lit(False).alias("is_deleted"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"))
    return old.select(*raw).unionByName(new.select(*raw))


def incremental_hidden(created: DataFrame, entries: DataFrame) -> DataFrame:
    """hidden_effective of entries as they are created: their own flag, or that of the parent then known. Unlike in a build, an orphan's own flag counts."""
    parents = first_by_ref(entries, live_only=True).join(entries.select("drive", F.col("entry_idx").alias("idx"), F.col("hidden_effective").alias("above")), ["drive", "idx"]).select("drive", F.col("mft_ref").alias("parent_ref"), "above")
    return created.join(parents, ["drive", "parent_ref"], "left").withColumn("hidden_effective", F.col("hidden_system") | F.coalesce("above", F.lit(False))).drop("above")
