"""The ``mft`` data source: entries from an image of an NTFS volume.

    spark.dataSource.register(MftDataSource)
    spark.read.format("mft").load("/images/c.img")

The driver reads the boot sector and record 0 and plans slices of the table's data
runs, whose number is bounded; executors decode records of their slice, chunk by chunk,
and pass over holes of the image, which hold zeros and so no records. A file with names in extension
records gives rows marked ``deferred``, which ``entries_of`` resolves by a join.
Images must lie where every executor can open them. Journal records are decoded by
``journal_records``.
"""

from __future__ import annotations

import errno
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: attribute types, name spaces, and the mask of a record number.
STANDARD, ATTRIBUTE_LIST, FILE_NAME, DATA, END = 0x10, 0x20, 0x30, 0x80, 0xFFFFFFFF
WIN32, DOS, WIN32_DOS = 1, 2, 3
REF_MASK = (1 << 48) - 1
SECTOR, CHUNK = 512, 4 << 20
#: Slices of a table beside one a run, which the driver holds all at once; a longer table gets longer slices.
MOST_SLICES = 2048
_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)

RECORDS = (
    "mft_ref long, in_use boolean, is_dir boolean, hidden_system boolean, size long, modified timestamp, has_list boolean, "
    "names array<struct<parent_ref:long,name:string,namespace:int>>, extensions array<long>"
)


class MftError(ValueError):
    pass


@dataclass(frozen=True)
class Boot:
    sector: int
    cluster: int
    record: int
    mft_at: int
    sectors: int
    serial: int = 0


def boot_sector(data: bytes) -> Boot:
    if len(data) < SECTOR or data[3:7] != b"NTFS":
        raise MftError("not an NTFS volume")
    sector, per_cluster = struct.unpack_from("<HB", data, 0x0B)
    sectors, start = struct.unpack_from("<Q", data, 0x28)[0], struct.unpack_from("<Q", data, 0x30)[0]
    (size,) = struct.unpack_from("<b", data, 0x40)
    cluster = sector * per_cluster
    (serial,) = struct.unpack_from("<I", data, 0x48)  # the low half, as the system tells it
    return Boot(sector, cluster, size * cluster if size > 0 else 1 << -size, start * cluster, sectors, serial)


def volume_serial(path: str) -> int:
    """The serial of an image's volume; 0 if it can't be read."""
    try:
        return boot_sector(read_at(path, 0, SECTOR)).serial
    except (OSError, MftError):
        return 0


def read_at(path: str, at: int, n: int) -> bytes:
    """Exactly n bytes, or an error."""
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(n)
    if len(data) != n:
        raise MftError(f"{len(data)} of {n} bytes at {at}")
    return data


def chunks(path: str, at: int, n: int, unit: int) -> Iterator[tuple[int, bytes]]:
    """(position, data) of the n bytes, or an error: units whole, CHUNK bytes at most, without units that are holes of the file."""
    with open(path, "rb") as f:
        if (there := f.seek(0, os.SEEK_END)) < at + n:
            raise MftError(f"{max(there - at, 0)} of {n} bytes at {at}")
        pos, end, most = at, at + n, max(1, CHUNK // unit) * unit
        while pos < end:
            try:
                data_at = f.seek(pos, os.SEEK_DATA)
                stop = at - (at - f.seek(data_at, os.SEEK_HOLE)) // unit * unit  # the unit in which the hole begins is whole
                pos = max(pos, at + (data_at - at) // unit * unit)
            except OSError as error:
                if error.errno == errno.ENXIO:  # only a hole is left
                    return
                stop = end  # holes aren't told here
            if pos >= end:
                return
            size = min(most, stop - pos, end - pos)
            f.seek(pos)
            data = f.read(size)
            if len(data) != size:
                raise MftError(f"{len(data)} of {size} bytes at {pos}")
            yield pos, data
            pos += size


def fixup(record: bytes) -> bytes:
    """Restores the last two bytes of every sector; stops, without more ado, where a sector's check fails."""
    if len(record) < 8 or record[:4] == b"\0\0\0\0":
        return record
    at, n = struct.unpack_from("<HH", record, 4)
    if n < 2 or at + 2 * n > len(record):
        return record
    out, check = bytearray(record), record[at : at + 2]
    for k in range(1, n):
        end = k * SECTOR
        if end > len(out) or out[end - 2 : end] != check:
            break
        out[end - 2 : end] = record[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def attributes(record: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, position, length) of each attribute."""
    at = struct.unpack_from("<H", record, 0x14)[0]
    while at < len(record) - 8:
        kind, n = struct.unpack_from("<II", record, at)
        if kind == END or n == 0 or at + n > len(record):
            return
        yield kind, at, n
        at += n


def data_runs(record: bytes) -> list[tuple[int, int]]:
    """(first cluster, clusters) of the first non-resident data attribute; sparse runs are left out."""
    for kind, at, n in attributes(record):
        if kind != DATA or not record[at + 8]:
            continue
        pos, end, cluster, runs = at + struct.unpack_from("<H", record, at + 0x20)[0], at + n, 0, []
        while pos < end and record[pos]:
            n_length, n_offset = record[pos] & 15, record[pos] >> 4
            pos += 1
            if not 0 < n_length <= 8 or pos + n_length + n_offset > len(record):
                break
            length = int.from_bytes(record[pos : pos + n_length], "little")
            offset = int.from_bytes(record[pos + n_length : pos + n_length + n_offset], "little", signed=True)
            pos += n_length + n_offset
            if n_offset:
                cluster += offset
                runs.append((cluster, length))
        return runs
    return []


def valid(record: bytes) -> bool:
    return len(record) > 0x18 and record[:4] == b"FILE" and bool(record[0x16] & 1)


def _content(record: bytes, at: int) -> int:
    return at + struct.unpack_from("<H", record, at + 0x14)[0]


def _name(record: bytes, at: int) -> dict | None:
    pos = _content(record, at)
    if pos + 0x42 > len(record):
        return None
    n, space = record[pos + 0x40], record[pos + 0x41]
    raw = record[pos + 0x42 : pos + 0x42 + 2 * n]
    if len(raw) < 2 * n:
        return None
    return {"parent_ref": struct.unpack_from("<Q", record, pos)[0] & REF_MASK, "name": raw.decode("utf-16-le", "replace"), "namespace": space}


def _listed(record: bytes, at: int) -> list[int]:
    """Records that a resident attribute list names for file names."""
    if record[at + 8]:
        return []
    pos = _content(record, at)
    end, out = min(pos + struct.unpack_from("<I", record, at + 0x10)[0], len(record)), []
    while pos + 0x18 < end:
        kind, n = struct.unpack_from("<IH", record, pos)
        if kind in (0, END) or n == 0:
            break
        if kind == FILE_NAME:
            out.append(struct.unpack_from("<Q", record, pos + 0x10)[0] & REF_MASK)
        pos += n
    return out


def parse(record: bytes, ref: int) -> dict | None:
    """A fixed-up record as a row of RECORDS; None if it isn't one."""
    if not valid(record):
        return None
    is_dir = bool(record[0x16] & 2)
    row = {"mft_ref": ref, "in_use": True, "is_dir": is_dir, "hidden_system": False, "size": 0, "modified": None, "has_list": False, "names": [], "extensions": []}
    for kind, at, _ in attributes(record):
        pos = _content(record, at) if not record[at + 8] else 0
        if kind == STANDARD and pos + 0x24 <= len(record):
            ticks, flags = struct.unpack_from("<q", record, pos + 8)[0], struct.unpack_from("<I", record, pos + 0x20)[0]
            if ticks > 0:
                row["modified"] = _EPOCH + timedelta(microseconds=ticks // 10)
            row["hidden_system"] = flags & 6 == 6
        elif kind == FILE_NAME and (name := _name(record, at)):
            row["names"].append(name)
        elif kind == DATA and not is_dir and not record[at + 9]:
            row["size"] = struct.unpack_from("<q", record, at + 0x30)[0] if record[at + 8] else struct.unpack_from("<I", record, at + 0x10)[0]
        elif kind == ATTRIBUTE_LIST:
            row["has_list"] = True
            row["extensions"] = list(dict.fromkeys([*row["extensions"], *(x for x in _listed(record, at) if x != ref)]))
    return row


def preferred(names: list[dict]) -> dict | None:
    """The name to show when one is wanted: Win32, then Win32 and DOS, POSIX, DOS."""
    return min(names, key=lambda x: {WIN32: 0, WIN32_DOS: 1, 0: 2, DOS: 3}.get(x["namespace"], 4), default=None)


class Slice(InputPartition):
    def __init__(self, at: int, first: int, n: int):
        self.at, self.first, self.n = at, first, n


class MftReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.boot = boot_sector(read_at(path, 0, SECTOR))

    def partitions(self) -> list[Slice]:
        boot = self.boot
        runs = data_runs(fixup(read_at(self.path, boot.mft_at, boot.record)))
        if not runs:
            raise MftError("the table has no data runs")
        total = sum(n for _, n in runs) * boot.cluster // boot.record
        per, first, out = max(1, CHUNK // boot.record, -(-total // MOST_SLICES)), 0, []
        for cluster, n in runs:
            records = n * boot.cluster // boot.record
            out += [Slice(cluster * boot.cluster + k * boot.record, first + k, min(per, records - k)) for k in range(0, records, per)]
            first += records
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        size = self.boot.record
        for at, data in chunks(self.path, partition.at, partition.n * size, size):
            first = partition.first + (at - partition.at) // size
            rows = (parse(fixup(data[k * size : (k + 1) * size]), first + k) for k in range(len(data) // size))
            yield pa.RecordBatch.from_pylist([r for r in rows if r], ARROW)


_NAME = pa.struct([("parent_ref", pa.int64()), ("name", pa.string()), ("namespace", pa.int32())])
ARROW = pa.schema([("mft_ref", pa.int64()), ("in_use", pa.bool_()), ("is_dir", pa.bool_()), ("hidden_system", pa.bool_()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("has_list", pa.bool_()), ("names", pa.list_(_NAME)), ("extensions", pa.list_(pa.int64()))])


class MftDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mft"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> MftReader:
        return MftReader(self.options["path"])


def entries_of(records: DataFrame, drive: str) -> DataFrame:
    """Raw entries, one for each name of a record: a DOS name goes if its parent also has a Win32 one.

    Records with an attribute list come after all others, take the names of their
    extension records by a join, and list each parent and name once. ``place`` orders
    the entries as they are to be numbered.
    """
    plain = records.where(~F.col("has_list"))
    listed = records.where("has_list")
    more = listed.select("mft_ref", F.posexplode("extensions").alias("k", "ext")).join(records.select(F.col("mft_ref").alias("ext"), F.col("names").alias("more")), "ext")
    more = more.select("mft_ref", (F.col("k") + 1).alias("k"), F.posexplode("more").alias("i", "n"))
    own = lambda df: df.select("mft_ref", F.lit(0).alias("k"), F.posexplode("names").alias("i", "n"))
    names = own(plain).withColumn("late", F.lit(0)).unionByName(own(listed).unionByName(more).withColumn("late", F.lit(1)))
    by_parent = Window.partitionBy("mft_ref", "n.parent_ref")
    names = names.withColumn("win32", F.max(F.col("n.namespace").isin(WIN32, WIN32_DOS)).over(by_parent)).where(~((F.col("n.namespace") == DOS) & F.col("win32")))
    once = names.withColumn("seen", F.row_number().over(Window.partitionBy("mft_ref", "n.parent_ref", "n.name").orderBy("k", "i"))).where((F.col("late") == 0) | (F.col("seen") == 1))
    rows = once.join(records.drop("names", "extensions", "has_list", "in_use"), "mft_ref")
    return rows.select(
        F.lit(drive).alias("drive"), "mft_ref", F.col("n.parent_ref").alias("parent_ref"), F.col("n.name").alias("name"), "is_dir", "hidden_system", "size", "modified",
        F.struct("late", "mft_ref", "k", "i").alias("place"),
    )


JOURNAL = "usn long, drive string, mft_ref long, parent_ref long, reason long, file_attributes long, name string, ts timestamp"


def journal_records(data: bytes, drive: str) -> Iterator[dict]:
    """Version 2 records of a journal buffer, cut by their lengths; the buffer's leading next-usn is the caller's."""
    at = 0
    while at + 60 <= len(data):
        n, major = struct.unpack_from("<IH", data, at)
        if n < 60 or at + n > len(data):
            return
        if major == 2:
            ref, parent, usn, ticks = struct.unpack_from("<QQqq", data, at + 8)
            reason, _, _, flags, n_name, at_name = struct.unpack_from("<IIIIHH", data, at + 40)
            name = data[at + at_name : at + at_name + n_name].decode("utf-16-le", "replace")
            yield {"usn": usn, "drive": drive, "mft_ref": ref & REF_MASK, "parent_ref": parent & REF_MASK, "reason": reason, "file_attributes": flags, "name": name, "ts": _EPOCH + timedelta(microseconds=max(ticks, 0) // 10)}
        at += n


def read_journal(files: DataFrame, drive: str) -> DataFrame:
    """Journal rows of binary files (as of the binaryFile source), decoded file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("usn", pa.int64()), ("drive", pa.string()), ("mft_ref", pa.int64()), ("parent_ref", pa.int64()), ("reason", pa.int64()), ("file_attributes", pa.int64()), ("name", pa.string()), ("ts", pa.timestamp("us", "UTC"))])
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(journal_records(content.as_py() or b"", drive)), schema)

    return files.select("content").mapInArrow(run, JOURNAL)
