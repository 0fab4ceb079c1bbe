"""Versioned snapshots of the index: Parquet by drive, and manifests that name the versions in force.

Each drive's rows, and its grams, lie in the folder of the version that wrote them, so
a save writes only the drives that changed and readers keep what they opened. A manifest
has a number of its own and is moved into place under it, which is the commit; the
greatest number that can be read is in force, so there is never a moment without one.
All access goes through Spark's file systems, so a snapshot can lie in any store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burrow.operators import ngrams
from burrow.store import file_system, remove

FORMAT = 2
MAGIC = "burrow-snapshot"
#: Manifests that are kept beside the one in force.
KEPT = 1


@dataclass(frozen=True)
class Manifest:
    number: int
    drives: dict  # by drive: volume_serial, journal_id, last_usn, entries, version; grams: whether they are saved
    magic: str = MAGIC
    format: int = FORMAT


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests, the greatest first."""
    fs, at, _ = file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()), reverse=True)


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest that this format can read, or None."""
    for n in _numbers(spark, path):
        try:
            raw = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest-{n}.json").collect()))  # one small file
            found = Manifest(**raw)
        except (ValueError, TypeError):
            continue
        if found.magic == MAGIC and found.format == FORMAT:
            return found
    return None


def _commit(spark: SparkSession, path: str, drives: dict) -> Manifest:
    numbers = _numbers(spark, path)
    manifest = Manifest(max(numbers, default=0) + 1, drives)
    fs, _, jvm = file_system(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}/{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(json.dumps(asdict(manifest)).encode())
    out.close()
    if not fs.rename(temp, jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{manifest.number}.json")):
        raise OSError(f"the manifest of {path} couldn't be put in place")
    for n in numbers[KEPT:]:
        remove(spark, f"{path}/manifest-{n}.json")
    return manifest


def save(entries: DataFrame, path: str, states: dict[str, dict], posting: DataFrame | None = None) -> Manifest:
    """Writes the drives of ``states`` (volume_serial, journal_id and last_usn by drive) as a new version and puts it in force.

    Drives that the last manifest has and ``states`` has not are dropped from it; ``update`` keeps them.
    """
    return _commit(entries.sparkSession, path, _written(entries, path, states, posting))


def _written(entries: DataFrame, path: str, states: dict[str, dict], posting: DataFrame | None) -> dict:
    version = uuid.uuid4().hex
    spark, out = entries.sparkSession, {}
    for drive, state in states.items():  # a folder for each drive, so that versions of one drive go by themselves
        rows = entries.where(F.col("drive") == drive)
        folder = f"{path}/{version}/{len(out)}"
        rows.repartition("parent_idx").sortWithinPartitions("parent_idx", "entry_idx").write.parquet(folder)
        if posting is not None:
            ngrams.clustered(posting.where(F.col("drive") == drive)).write.parquet(f"{folder}-grams")
        told = {"entries": spark.read.schema(entries.schema).parquet(folder).count(), "version": f"{version}/{len(out)}", "grams": posting is not None}
        out[drive] = {k: state[k] for k in ("volume_serial", "journal_id", "last_usn")} | told
    return out


def update(entries: DataFrame | None, path: str, states: dict[str, dict]) -> Manifest:
    """Puts new states in force; rows are written for the drives of ``entries`` only, and those of the others stay where they are."""
    from pyspark.sql import SparkSession as Session

    spark = entries.sparkSession if entries is not None else Session.getActiveSession()
    drives = dict(read_manifest(spark, path).drives)
    if entries is not None:
        drives |= _written(entries, path, states, None)
    else:
        drives |= {d: drives[d] | {"last_usn": s["last_usn"]} for d, s in states.items()}
    return _commit(spark, path, drives)


def admitted(manifest: Manifest | None, drive: str, volume_serial: int) -> bool:
    """Whether a drive's snapshot is of the volume that is there now."""
    state = manifest.drives.get(drive) if manifest else None
    return bool(state) and volume_serial != 0 and state["volume_serial"] == volume_serial


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def load(spark: SparkSession, path: str, serials: dict[str, int], schema) -> DataFrame | None:
    """The entries of the admitted drives, or None if there is nothing to load."""
    manifest = read_manifest(spark, path)
    drives = [d for d, s in serials.items() if admitted(manifest, d, s)]
    return _union([spark.read.schema(schema).parquet(f"{path}/{manifest.drives[d]['version']}") for d in drives])


def load_grams(spark: SparkSession, path: str, serials: dict[str, int]) -> DataFrame | None:
    """The postings of the admitted drives that have some saved, or None."""
    manifest = read_manifest(spark, path)
    drives = [d for d, s in serials.items() if admitted(manifest, d, s) and manifest.drives[d]["grams"]]
    return _union([spark.read.schema("drive string, gram string, entry_idx long").parquet(f"{path}/{manifest.drives[d]['version']}-grams") for d in drives])


def resume_points(manifest: Manifest) -> dict[str, tuple[int, int]]:
    """The journal and the usn after which each drive goes on, as noted before its scan."""
    return {d: (s["journal_id"], s["last_usn"]) for d, s in manifest.drives.items()}


def delete(spark: SparkSession, path: str) -> bool:
    return remove(spark, path)
