"""Writes what ``mft`` reads: images of a volume's file table, and binary journals.

For round trips and fixtures. ``image`` makes one in the memory of one process; ``write``
makes it on the executors, piece by piece, at a path that they and the driver share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.sources.mft import ATTRIBUTE_LIST, DATA, END, FILE_NAME, SECTOR, STANDARD

RECORD, CLUSTER, TABLE_AT = 1024, 4096, 4
#: Records of a piece of the table, which is written at once.
PIECE = 4096
_SEQUENCE = 9 << 48  # references carry a sequence number above their record number


def _attribute(kind: int, content: bytes, non_resident: bytes | None = None) -> bytes:
    head = struct.pack("<HHHH", 0, 0, 0, 0)
    if non_resident is None:
        body = head[:0] + struct.pack("<BBHHH", 0, 0, 0, 0, 0) + struct.pack("<IHH", len(content), 24, 0) + content
    else:
        body = struct.pack("<BBHHH", 1, 0, 0, 0, 0) + bytes(16) + struct.pack("<H", 0x40) + bytes(14) + content + non_resident
    size = -(-(8 + len(body)) // 8) * 8
    return (struct.pack("<II", kind, size) + body).ljust(size, b"\0")


def _sealed(body: bytes) -> bytes:
    """A record with the last two bytes of each sector moved to its head."""
    out, mark = bytearray(body.ljust(RECORD, b"\0")), b"\x07\x01"
    out[48:50] = mark
    for k in range(RECORD // SECTOR):
        end = (k + 1) * SECTOR
        out[50 + 2 * k : 52 + 2 * k] = out[end - 2 : end]
        out[end - 2 : end] = mark
    return bytes(out)


def record(names: Iterable[tuple[int, str, int]], is_dir: bool = False, hidden_system: bool = False, size: int = 0, ticks: int = 0, extensions: Iterable[int] = (), runs: bytes | None = None) -> bytes:
    """A record with names (parent, name, namespace); ``extensions``: records that hold more of them."""
    head = b"FILE" + struct.pack("<HH", 48, 1 + RECORD // SECTOR) + bytes(12) + struct.pack("<HH", 56, 3 if is_dir else 1)
    out = head.ljust(56, b"\0") + _attribute(STANDARD, bytes(8) + struct.pack("<q", ticks) + bytes(16) + struct.pack("<I", 6 if hidden_system else 0) + bytes(12))
    if listed := list(extensions):
        out += _attribute(ATTRIBUTE_LIST, b"".join(struct.pack("<IHBBQQHH", FILE_NAME, 32, 0, 0, 0, r, 0, 0) + bytes(4) for r in listed) + bytes(24))
    for parent, name, space in names:
        raw = name.encode("utf-16-le")
        out += _attribute(FILE_NAME, struct.pack("<Q", parent | _SEQUENCE) + bytes(56) + bytes((len(raw) // 2, space)) + raw)
    if not is_dir:
        out += _attribute(DATA, struct.pack("<qq", size, size), runs or b"\0")
    return _sealed(out + struct.pack("<I", END))


def _clusters(last: int) -> int:
    """Clusters of a table up to a record number."""
    return -(-(last + 1) * RECORD // CLUSTER)


def _head(n: int, serial: int) -> tuple[bytes, bytes]:
    """What lies before a table of n clusters, and its record 0."""
    boot = bytearray(SECTOR)
    boot[3:7] = b"NTFS"
    struct.pack_into("<HB", boot, 0x0B, SECTOR, CLUSTER // SECTOR)
    struct.pack_into("<QQ", boot, 0x28, (TABLE_AT + n) * CLUSTER // SECTOR, TABLE_AT)
    struct.pack_into("<b", boot, 0x40, -10)
    struct.pack_into("<I", boot, 0x48, serial)
    run = bytes((0x14,)) + n.to_bytes(4, "little") + bytes((TABLE_AT, 0))
    return bytes(boot.ljust(TABLE_AT * CLUSTER, b"\0")), record([(5, "$MFT", 1)], size=n * CLUSTER, runs=run)


def image(records: dict[int, bytes], serial: int = 0) -> bytes:
    """A volume whose table has the given records, by number; record 0 is made here."""
    n = _clusters(max(records, default=0))
    head, zero = _head(n, serial)
    out = bytearray(head) + bytearray(n * CLUSTER)
    for k, data in {**records, 0: zero}.items():
        at = TABLE_AT * CLUSTER + k * RECORD
        out[at : at + RECORD] = data
    return bytes(out)


def write(records: DataFrame, path: str, serial: int = 0) -> None:
    """The volume of ``image`` as a file. ``records``: a row for each, with its number mft_ref and what ``record`` takes: names
    (structs), is_dir, hidden_system, size, ticks, extensions.

    A task holds one piece of the table at a time. It writes a piece whole and at its place, so a second try does no harm;
    pieces without records stay holes of the file, which read as zeros.
    """
    n = _clusters(records.agg(F.max("mft_ref")).first()[0] or 0)
    head, zero = _head(n, serial)
    with open(path, "wb") as f:
        f.write(head + zero)
        f.truncate((TABLE_AT + n) * CLUSTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for piece, own in groupby(rows, lambda row: row["_piece"]):
            out = bytearray(min(PIECE * RECORD, n * CLUSTER - piece * PIECE * RECORD))
            for row in own:
                at, names = row["mft_ref"] % PIECE * RECORD, [tuple(x.values()) for x in row["names"]]
                out[at : at + RECORD] = record(names, row["is_dir"], row["hidden_system"], row["size"], row["ticks"], row["extensions"])
            if not piece:
                out[:RECORD] = zero
            with open(path, "r+b") as f:
                f.seek(TABLE_AT * CLUSTER + piece * PIECE * RECORD)
                f.write(out)
            yield pa.RecordBatch.from_pydict({"piece": [piece]})

    columns = ("mft_ref", "names", "is_dir", "hidden_system", "size", "ticks", "extensions")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as small rows make large pieces
    dealt = records.select(*columns, F.floor(F.col("mft_ref") / PIECE).alias("_piece")).repartition(parts, "_piece").sortWithinPartitions("_piece")
    dealt.mapInArrow(run, "piece long").agg(F.count("piece")).collect()  # one number


def journal_record(usn: int, ref: int, parent: int, reason: int, attributes: int, name: str, ticks: int = 0) -> bytes:
    raw = name.encode("utf-16-le")
    size = -(-(60 + len(raw)) // 8) * 8
    head = struct.pack("<IHHQQqqIIIIHH", size, 2, 0, ref | _SEQUENCE, parent | _SEQUENCE, usn, ticks, reason, 0, 0, attributes, len(raw), 60)
    return (head + raw).ljust(size, b"\0")


def journal_content(journal: DataFrame) -> DataFrame:
    """content: binary journals, one for each batch of rows; ``mft.read_journal`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_pydict({"content": [b"".join(journal_record(*r) for r in rows)]})

    columns = [F.col(c).cast("long") for c in ("usn", "mft_ref", "parent_ref", "reason", "file_attributes")]
    return journal.select(*columns, "name").mapInArrow(run, "content binary")
