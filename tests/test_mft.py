"""The binary source, over images that an encoder here makes."""

import os
import struct
import tracemalloc
from datetime import UTC, datetime

import pytest

from burrow import queries
from burrow.operators import tree
from burrow.sources import image as I
from burrow.sources import mft as M

RECORD, CLUSTER = 1024, 4096
FILETIME = 133_500_000_000_000_000


def attribute(kind, content=b"", name_len=0, resident=True, tail=b""):
    if resident:
        body = struct.pack("<IIBBHHHIHH", kind, 0, 0, name_len, 24, 0, 0, len(content), 24, 0) + content
    else:
        body = struct.pack("<IIBBHHH", kind, 0, 1, name_len, 0, 0, 0) + b"\0" * 16 + struct.pack("<H", 0x40) + b"\0" * 14 + content.ljust(16, b"\0")[:16] + tail
    body = body.ljust(-(-len(body) // 8) * 8, b"\0")
    return body[:4] + struct.pack("<I", len(body)) + body[8:]


def standard(attrs=0, ticks=FILETIME):
    return attribute(M.STANDARD, b"\0" * 8 + struct.pack("<q", ticks) + b"\0" * 16 + struct.pack("<I", attrs) + b"\0" * 12)


def name(parent, text, space=1):
    raw = text.encode("utf-16-le")
    return attribute(M.FILE_NAME, struct.pack("<Q", parent | 9 << 48) + b"\0" * 56 + bytes((len(raw) // 2, space)) + raw)


def data(size, stream=0):
    return attribute(M.DATA, b"x" * size, stream)


def large(size, runs=b"\0"):
    return attribute(M.DATA, struct.pack("<qq", size, size), resident=False, tail=runs) if runs != b"\0" else attribute(M.DATA, struct.pack("<q", size).rjust(16, b"\0")[8:].rjust(8, b"\0") + b"\0" * 8, resident=False)


def listed(*refs):
    return attribute(M.ATTRIBUTE_LIST, b"".join(struct.pack("<IHBBQQHH", M.FILE_NAME, 32, 0, 0, 0, r, 0, 0) + b"\0" * 4 for r in refs) + b"\0" * 24)


def record(*attrs, flags=1, good=True, signature=b"FILE"):
    body = bytearray(signature + struct.pack("<HH", 48, 3) + b"\0" * 12 + struct.pack("<HH", 56, flags) + b"\0" * 24 + b"\0" * 8)
    body += b"".join(attrs) + struct.pack("<I", M.END)
    body = body.ljust(RECORD, b"\0")
    check = b"\x07\x01"
    kept = [bytes(body[end - 2 : end]) for end in (512, 1024)]
    body[48:50] = check
    for k, end in enumerate((512, 1024)):
        body[50 + 2 * k : 52 + 2 * k] = kept[k]
        body[end - 2 : end] = check if good else b"\xff\xff"
    return bytes(body)


def boot(clusters_per_record):
    out = bytearray(512)
    out[3:7] = b"NTFS"
    struct.pack_into("<HB", out, 0x0B, 512, 8)
    struct.pack_into("<QQQ", out, 0x28, 4096, 4, 0)
    struct.pack_into("<b", out, 0x40, clusters_per_record)
    return bytes(out)


RECORDS = {
    5: record(standard(6), name(5, "."), flags=3),
    6: record(standard(), name(5, "Folder", 3), flags=3),
    7: record(standard(), name(6, "Long name.txt", 1), name(6, "LONGNA~1.TXT", 2), data(100), data(7, stream=3)),
    8: record(standard(), name(6, "DOS.TXT", 2), data(1)),
    9: record(standard(6, 0), name(5, "link a", 1), name(6, "LINKB", 2), data(5)),
    10: record(standard(), name(5, "gone.txt"), flags=0),
    11: record(standard(), name(5, "bad"), signature=b"BAAD"),
    12: record(standard(), listed(13, 12, 13, 99), name(5, "many"), data(3)),
    13: record(name(6, "many too", 0), name(5, "many"), flags=1),
    14: record(standard(), name(5, "unfixed"), good=False),
}


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    """The table in three runs: clusters 4 to 5, a sparse run, 9 to 10, and back to 7."""
    runs = bytes((0x11, 2, 4, 0x01, 3, 0x11, 2, 5, 0x11, 1, 0xFE, 0))
    zero = record(standard(), name(5, "$MFT"), attribute(M.DATA, struct.pack("<qq", 5 * CLUSTER, 0), resident=False, tail=runs))
    table = [zero] + [RECORDS.get(k, b"\0" * RECORD) for k in range(1, 20)]
    disk = bytearray(12 * CLUSTER)
    disk[:512] = boot(-10)
    for k, r in enumerate(table):
        cluster = [4, 5, 9, 10, 7][k * RECORD // CLUSTER]
        at = cluster * CLUSTER + k * RECORD % CLUSTER
        disk[at : at + RECORD] = r
    path = tmp_path_factory.mktemp("image") / "c.img"
    path.write_bytes(bytes(disk))
    return str(path)


def test_boot_sector():
    assert M.boot_sector(boot(-10)) == M.Boot(512, 4096, 1024, 4 * 4096, 4096, 0) and M.boot_sector(boot(1)).record == 4096
    with pytest.raises(M.MftError):
        M.boot_sector(b"\0" * 512)


def test_runs_and_exact_reads(image):
    reader = M.MftReader(image)
    assert [(p.at // CLUSTER, p.first, p.n) for p in reader.partitions()] == [(4, 0, 8), (9, 8, 8), (7, 16, 4)]
    with pytest.raises(M.MftError):
        M.read_at(image, 12 * CLUSTER - 10, 20)


def test_fixup():
    good = M.fixup(RECORDS[7])
    assert good[510:512] == b"\0\0" and M.fixup(RECORDS[14]) == RECORDS[14] and M.fixup(b"\0" * RECORD) == b"\0" * RECORD
    half = bytearray(RECORDS[7])
    half[1022:1024] = b"zz"
    assert M.fixup(bytes(half))[510:512] == b"\0\0" and M.fixup(bytes(half))[1022:] == b"zz"


def test_parse():
    row = M.parse(M.fixup(RECORDS[7]), 7)
    assert row["size"] == 100 and [n["namespace"] for n in row["names"]] == [1, 2] and row["names"][0]["parent_ref"] == 6
    assert row["modified"] == datetime(2024, 1, 17, 21, 20, tzinfo=UTC) and not row["hidden_system"]
    assert M.parse(M.fixup(RECORDS[9]), 9)["hidden_system"] and M.parse(M.fixup(RECORDS[9]), 9)["modified"] is None
    assert M.parse(RECORDS[10], 10) is None and M.parse(RECORDS[11], 11) is None
    assert M.parse(M.fixup(RECORDS[12]), 12)["extensions"] == [13, 99]
    assert M.preferred(row["names"])["name"] == "Long name.txt" and M.preferred([]) is None
    far = record(attribute(M.DATA, struct.pack("<q", 0) + struct.pack("<q", 0), resident=False))
    far = bytearray(M.fixup(far))
    struct.pack_into("<q", far, 56 + 0x30, 1 << 40)
    assert M.parse(bytes(far), 1)["size"] == 1 << 40


def test_entries_of_an_image(spark, image):
    spark.dataSource.register(M.MftDataSource)
    records = spark.read.format("mft").load(image)
    raw = M.entries_of(records, "C:")
    got = sorted((r.mft_ref, r.parent_ref, r.name, r.size) for r in raw.collect())
    assert got == sorted([(0, 5, "$MFT", got[0][3]), (5, 5, ".", 0), (6, 5, "Folder", 0), (7, 6, "Long name.txt", 100), (8, 6, "DOS.TXT", 1), (9, 5, "link a", 5), (9, 6, "LINKB", 5), (12, 5, "many", 3), (12, 6, "many too", 3), (13, 6, "many too", 0), (13, 5, "many", 0), (14, 5, "unfixed", 0)])
    paths = {r.name: (r.path, r.entry_idx) for r in tree.build(raw, "place").collect()}
    assert paths["Long name.txt"][0] == "C:\\Folder\\Long name.txt"
    assert max(i for _, i in paths.values()) == 11


def usn(ref, parent, number, reason, attrs, text):
    raw = text.encode("utf-16-le")
    body = struct.pack("<HHQQqqIIIIHH", 2, 0, ref | 5 << 48, parent, number, FILETIME, reason, 0, 0, attrs, len(raw), 60) + raw
    size = -(-(len(body) + 4) // 8) * 8
    return (struct.pack("<I", size) + body).ljust(size, b"\0")


def test_journal_files(spark, tmp_path):
    (tmp_path / "a.usn").write_bytes(usn(7, 6, 1, 0x80000100, 6, "new é.txt") + usn(8, 6, 2, 0x200, 0, "x"))
    (tmp_path / "b.usn").write_bytes(usn(9, 6, 3, 0x2000, 0, "y") + b"\x50\0\0\0")
    rows = sorted(map(tuple, M.read_journal(spark.read.format("binaryFile").load(str(tmp_path)), "C:").select("usn", "mft_ref", "parent_ref", "reason", "file_attributes", "name").collect()))
    assert rows == [(1, 7, 6, 0x80000100, 6, "new é.txt"), (2, 8, 6, 0x200, 0, "x"), (3, 9, 6, 0x2000, 0, "y")]
    assert list(M.journal_records(b"", "C:")) == []


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Tables whose image has 64 MB: 700 customers with numbers far apart."""
    folder = tmp_path_factory.mktemp("customers")
    for table, rows, columns in (
        ("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey long, r_name string"),
        ("nation", [(7, "KENYA", 0), (8, "INDIA", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        ("customer", [(k, f"Customer {k}", 7 + k % 2) for k in range(1, 32_000, 45)], "c_custkey long, c_name string, c_nationkey long"),
    ):
        spark.createDataFrame(rows, columns).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def driver_peak(run):
    """What a call gives, and the most bytes that the driver's Python held meanwhile."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_an_image_written_by_executors(spark, tmp_path):
    """Equals one made in memory, over several pieces, without record 0 and with a piece that has no records."""
    names = {k: [(5, f"name {k}", 1)] + [(6, "é", 2)] * (k % 3 == 0) for k in (5, 4095, 4096, 4097, 12_300)}
    rows = [(k, n, k % 2 == 1, k == 4096, k * 10, FILETIME, [k + 1] * (k == 5)) for k, n in names.items()]
    df = spark.createDataFrame(rows, "mft_ref long, names array<struct<parent_ref:long,name:string,namespace:int>>, is_dir boolean, hidden_system boolean, size long, ticks long, extensions array<long>")
    path = tmp_path / "c.img"
    want = I.image({k: I.record(*x) for k, *x in rows}, 77)
    I.write(df, str(path), 77)
    assert path.read_bytes() == want
    I.write(df.limit(0), str(path))
    assert path.read_bytes() == I.image({})


def test_the_tree_of_an_image_that_the_driver_never_holds(spark, customers):
    path, peak = driver_peak(lambda: queries._volume(spark, customers))
    assert os.path.getsize(path) > 60 << 20 > 5 * peak
    paths = sorted((r.path, r.size) for r in queries.mft_tree(spark, customers).collect())
    assert len(paths) == 712 + 2 * 356 and ("C:\\ASIA\\INDIA\\Customer 1", 10) in paths
    assert [p for p in paths if p[0] == "C:\\ASIA\\far 31"] == [] and [p for p in paths if p[0] == "C:\\ASIA\\far 91"] == [("C:\\ASIA\\far 91", 0), ("C:\\ASIA\\far 91", 910)]


def test_the_serials_of_a_volume_that_the_driver_never_holds(spark, customers):
    rows, peak = driver_peak(lambda: queries.volume_serials(spark, customers).collect())
    assert [tuple(r) for r in rows] == [(0x1234ABCD, 512, 4096, 1024)] and peak < 8 << 20


def test_an_image_is_decoded_once(spark, customers):
    """What the entries are made of is a table, and not the image again for each join."""
    found = queries.mft_entries(spark, customers)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "mft" not in plan.replace("mft_ref", "")
    assert found.count() == 1 + 2 + 2 + 712 + 2 * 356


def test_a_long_table_with_holes(tmp_path):
    """Few slices on the driver and no reading of holes, whatever numbers records have; a table that is cut off is an error."""
    path, far = tmp_path / "c.img", 50_000_000
    n = I._clusters(far)
    head, zero = I._head(n, 7)
    numbers = [5, 6, 4095, 4096, 30_000, 30_003, 8_000_001, far - 5_000, far]
    with open(path, "wb") as f:
        f.write(head + zero)
        for k in numbers:
            f.seek(I.TABLE_AT * CLUSTER + k * RECORD)
            f.write(I.record([(5, f"name {k}", 1)], size=k))
        f.truncate((I.TABLE_AT + n) * CLUSTER)
    reader = M.MftReader(str(path))
    slices = reader.partitions()
    assert len(slices) <= M.MOST_SLICES and sum(s.n for s in slices) == n * CLUSTER // RECORD
    assert [b.first - a.first for a, b in zip(slices, slices[1:])] == [s.n for s in slices[:-1]]
    rows = [r for s in slices for batch in reader.read(s) for r in batch.to_pylist()]
    assert [(r["mft_ref"], r["names"][0]["name"], r["size"]) for r in rows] == [(0, "$MFT", rows[0]["size"])] + [(k, f"name {k}", k) for k in numbers]
    os.truncate(path, (I.TABLE_AT + n) * CLUSTER - 1)
    with pytest.raises(M.MftError):
        list(reader.read(slices[-1]))


@pytest.mark.parametrize("unit", [512, 1024, 1536, 4096, 10_240])
def test_chunks_are_whole_units_and_only_holes_are_missing(tmp_path, monkeypatch, unit):
    monkeypatch.setattr(M, "CHUNK", 8192)
    path, n = tmp_path / "x", 60 * unit
    with open(path, "wb") as f:
        for at in (777, 40_000, 40_960, 777 + n - 9):
            f.seek(at)
            f.write(b"data" if at < n else b"the end")
        f.truncate(777 + n + 100_000)
    got = bytearray(n)
    for at, part in M.chunks(str(path), 777, n, unit):
        assert (at - 777) % unit == len(part) % unit == 0 and len(part) <= max(unit, 8192)
        got[at - 777 : at - 777 + len(part)] = part
    assert bytes(got) == path.read_bytes()[777 : 777 + n]
    assert list(M.chunks(str(path), 777 + n + 20_000, unit, unit)) == [] or unit > 4096
