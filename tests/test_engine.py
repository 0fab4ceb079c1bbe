"""Operators over a small tree made by hand, and against plain Python."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from burrow import functions as fn
from burrow import queries, sinks
from burrow.config import EngineConfig
from burrow.engine import Engine
from burrow.operators import journal as J
from burrow.operators import ngrams, results, tree
from burrow.plans.compile import like_pattern
from burrow.sources import drives as D
from burrow.sources import fixtures, snapshot
from burrow.streaming.live import LiveIndex, StandingQuery

RAW = "drive string, mft_ref long, parent_ref long, name string, is_dir boolean, hidden_system boolean, size long, modified timestamp"


def row(ref, parent, name, is_dir=False, hidden=False, size=0, modified=None):
    return ("C:", ref, parent, name, is_dir, hidden, size, modified)


TREE = [
    row(5, 5, ".", True, True), row(10, 5, "$Recycle.Bin", True, True), row(11, 10, "$Rdir", True), row(12, 11, "thrown.txt"),
    row(20, 5, "Back", True), row(21, 5, "Backup2", True), row(22, 21, "f"), row(23, 20, "f"), row(30, 5, "Hid", True, True), row(31, 30, "child.txt", size=5),
    row(40, 5, "bcd_abc.txt"), row(41, 5, "abcd.txt"), row(42, 5, "ÉAB.txt"), row(43, 5, "x."), row(44, 5, "noext"), row(45, 5, ".gitignore"),
    row(46, 5, "$Rabc123"), row(47, 5, "$RABC123.txt"), row(48, 5, "$rABC123"), row(49, 5, "$RABC12"), row(50, 5, "a_b"), row(51, 5, "aBb"),
    row(52, 5, "😀.txt"), row(60, 999, "orphan.txt", hidden=True), row(70, 20, "link1.doc", size=9), row(70, 21, "link2.doc", size=9),
    row(80, 81, "loop1", True), row(81, 80, "loop2", True), row(82, 81, "inloop.txt"), row(90, 5, "보고서.hwp", size=2048, modified=datetime(2020, 5, 1)), row(91, 5, "a,\"b\"\nc.csv"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.build(spark.createDataFrame(TREE, RAW), with_grams=True)


def names(engine, query, **config):
    return sorted(r.name for r in engine.with_config(**config).hits(query).collect())


def test_queries_over_names(engine):
    assert names(engine, "abcd") == ["abcd.txt"]  # not bcd_abc.txt, which has the same grams
    assert names(engine, "éab") == ["ÉAB.txt"] and names(engine, ".gitignore") == [".gitignore"] and names(engine, "?.txt") == ["😀.txt"]
    assert names(engine, "$r") == ["$RABC12", "$rABC123"] and len(names(engine, "$r", hide_recycled=False, hide_hidden=False)) == 6
    assert names(engine, r"f C:\Back") == ["f", "f"] and names(engine, r"f C:\Back" + "\\") == ["f"]
    assert names(engine, "child") == [] and names(engine, "child", hide_hidden=False) == ["child.txt"]
    assert names(engine, "thrown", hide_hidden=False) == [] and names(engine, "orphan") == ["orphan.txt"]
    assert names(engine, "f", excluded_folders=("BACKUP2",)) == ["f"] and names(engine, "f", excluded_folders=("f",)) == []
    assert names(engine, "back") == ["Back", "Backup2"] and names(engine, ">1KB") == ["보고서.hwp"] and names(engine, ">2019") == ["보고서.hwp"]
    assert names(engine, "<1B <1990") and "Back" not in names(engine, "<1B") and names(engine, r"C:\Back") == []


def test_index_and_scan_agree(engine):
    for query in ("abcd", "a b", "보고", "txt", "link .doc", "*bc*", "gitignore", "f"):
        scan = Engine(engine.entries, engine.config)
        assert names(engine, query) == names(scan, query)
    old = engine.posting.where("entry_idx < 20")
    built = engine.entries.sparkSession.createDataFrame([("C:", 20)], "drive string, built_count long")
    assert engine.built_at.first().built_count == len(TREE) and engine.clear_grams().posting is None
    spec = engine.parse("txt")
    tailed = ngrams.pruned(engine.entries, old, spec, built).where(F.contains("name_lc", F.lit("txt"))).count()
    assert tailed == engine.entries.where(F.contains("name_lc", F.lit("txt"))).count()


def test_tree_values(engine):
    got = {(r.mft_ref, r.name): r for r in engine.entries.collect()}
    assert got[5, "."].path == "C:\\" and got[22, "f"].path == "C:\\Backup2\\f" and got[60, "orphan.txt"].path == "C:\\orphan.txt"
    assert not got[5, "."].hidden_effective and got[31, "child.txt"].hidden_effective and not got[60, "orphan.txt"].hidden_effective
    assert got[12, "thrown.txt"].in_recycle and got[82, "inloop.txt"].depth == tree.MOST_STEPS
    assert sorted(r.entry_idx for r in got.values()) == list(range(len(TREE)))
    assert got[70, "link1.doc"].entry_idx < got[70, "link2.doc"].entry_idx
    assert "Python" not in engine.hits("photo *.jpg >1MB")._jdf.queryExecution().toString()


def test_depth_is_limited(spark):
    rows = [row(5, 5, ".", True, True), row(100, 5, "d0", True, True)] + [row(100 + k, 99 + k, f"d{k}", True) for k in range(1, 70)]
    got = {r.name: r for r in tree.build(spark.createDataFrame(rows, RAW)).collect()}
    assert got["d40"].path == "C:\\" + "\\".join(f"d{k}" for k in range(41)) and got["d40"].hidden_effective
    assert got["d69"].path == "C:\\" + "\\".join(f"d{k}" for k in range(6, 70)) and not got["d69"].hidden_effective


def test_positions_are_dense_and_ordered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["C:", "D:"]), rng.randrange(50), 5, f"n{k}", False, False, 0, None) for k in range(500)]
    got = tree.with_positions(spark.createDataFrame(rows, RAW).repartition(7), "mft_ref", "name").collect()
    for drive in ("C:", "D:"):
        mine = sorted((r.mft_ref, r.name) for r in got if r.drive == drive)
        assert [(r.mft_ref, r.name) for r in sorted((r for r in got if r.drive == drive), key=lambda r: r.entry_idx)] == mine
        assert sorted(r.entry_idx for r in got if r.drive == drive) == list(range(len(mine)))


def test_like_equals_a_plain_matcher(spark):
    rng = random.Random(2)
    said = lambda abc, n: "".join(rng.choice(abc) for _ in range(rng.randrange(n)))
    rows = [(said("ab_%!é", 6), said("aB*?_%!É", 6)) for _ in range(300)]
    got = spark.createDataFrame([(n, like_pattern(p), p) for n, p in rows], "n string, l string, p string").select("n", "p", F.like(F.lower("n"), F.col("l"), F.lit("!")).alias("m")).collect()
    for r in got:
        want = re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in r.p.lower()), r.n.lower(), re.S)
        assert r.m == bool(want), r


def test_sorting_capping_and_shown_rows(engine):
    order = [r.name for r in results.sort(engine.entries.where("name in ('a_b', 'aBb', 'noext')")).collect()]
    assert order == ["aBb", "a_b", "noext"] and results.toggle("name", True, "name") == ("name", False) and results.toggle("name", False, "size") == ("size", True)
    assert [r.name for r in results.sort(engine.entries.where("name in ('a_b', 'aBb', 'noext')"), "name", False).collect()] == order[::-1]
    assert [r.name for r in engine.with_config(max_results=1).search("txt").collect()] == ["bcd_abc.txt"]
    shown = engine.search("보고서").first()
    assert (shown.kind, shown.size_text, shown.modified_text) == ("파일", "2 KB", "20-05-01 00:00")


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(fn.size_text(F.lit(n).cast("long"))) for n in (0, 1023, 1024, 1536, 1 << 20, 1 << 30, 1 << 40, -1)] == ["0 B", "1023 B", "1 KB", "2 KB", "1.0 MB", "1.00 GB", "1024.00 GB", ""]
    assert value(fn.date_text(F.lit(datetime(2024, 1, 1, 20)), "Asia/Seoul")) == "24-01-02 05:00" and value(fn.date_text(F.lit(None).cast("timestamp"))) == ""
    assert value(fn.shorten(F.lit("abcdefghij"), 6)) == "ab…ij" and value(fn.shorten(F.lit("abc"), 2)) == "abc" and value(fn.leaf(F.lit("C:\\a\\b\\"))) == "b" and value(fn.leaf(F.lit("\\"))) == "\\"
    for path, want in (("C:\\", True), ("c:", True), ("C:\\windows\\x", True), ("C:\\WindowsOld", False), ("C:\\Users", True), ("C:\\Users\\me", False), ("C:\\Program Files (x86)", True)):
        assert value(fn.dangerous(F.lit(path))) is want, path
    assert value(fn.long_path(F.lit("\\\\srv\\x"))) == "\\\\?\\UNC\\srv\\x" and value(fn.plain_path(F.lit("\\\\?\\UNC\\srv\\x"))) == "\\\\srv\\x"
    assert value(fn.long_path(F.lit("C:\\x"))) == "\\\\?\\C:\\x" == value(fn.long_path(F.lit("\\\\?\\C:\\x"))) and value(fn.plain_path(F.lit("\\\\?\\C:\\x"))) == "C:\\x"
    assert [value(fn.cause(F.lit(c))) for c in (0, 2, 5, 32, 123, 145, 999)] == ["None", "NotFound", "AccessDenied", "Locked", "BadName", "NotEmpty", "Other"]
    assert value(fn.shell_unsafe(F.lit("C:\\a "))) and value(fn.shell_unsafe(F.lit("C:\\" + "a" * 250))) and not value(fn.shell_unsafe(F.lit("C:\\a")))
    assert value(fn.from_filetime(F.lit(133_500_000_000_000_009))) == datetime(2024, 1, 17, 21, 20) and value(fn.from_filetime(F.lit(0))) is None
    assert value(fn.drive_letters(F.lit(0b101))) == ["A", "C"] and value(fn.join_words(F.lit(1), F.lit(-1))) == (1 << 33) - 1 and value(fn.mask_ref(F.lit((3 << 48) + 7))) == 7
    assert value(fn.csv_field(F.lit('a"b'))) == '"a""b"' and value(fn.csv_field(F.lit("a\rb"))) == "a\rb" and value(fn.parent_folder(F.lit("C:\\a\\b"))) == "C:\\a"
    assert value(fn.shown_size(F.lit(0), F.lit(False), F.lit(8))) == 8 and value(fn.shown_size(F.lit(3), F.lit(False), F.lit(8))) == 3
    assert fn.localized({"en": {"k": "v"}}, "k", "ko") == "v" and fn.localized({}, "k", "ko") == "k"


def test_exports(engine, tmp_path):
    shown = engine.search("csv")
    assert sinks.export_file(shown, str(tmp_path / "out.csv")) == 1
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfName,Path,Size(bytes),Date\r\n") and b'"a,""b""\nc.csv"' in raw
    engine.export_csv("txt", str(tmp_path / "many"))
    back = engine.entries.sparkSession.read.option("header", True).csv(str(tmp_path / "many"))
    assert back.columns == ["Name", "Path", "Size(bytes)", "Date"] and back.count() == engine.search("txt").count()
    assert engine.sql("select count(*) from entries").first()[0] == len(TREE)


def test_overlays_and_summaries(spark, engine):
    gone = spark.createDataFrame([("c:\\ABCD.TXT",), ("C:\\noext",)], "path string")
    there = spark.createDataFrame([("C:\\NOEXT",)], "path string")
    assert results.without_deleted(engine.entries, gone, there).count() == len(TREE) - 1
    assert results.restored_selection(engine.entries, gone).count() == 2
    stats = spark.createDataFrame([("C:\\noext", 77, datetime(2021, 1, 1), True), ("C:\\x.", 1, None, False)], "path string, size long, modified timestamp, found boolean")
    kept, skipped = results.existing_only(engine.entries.where("name in ('noext', 'x.')"), stats)
    assert kept.count() == 1 and skipped.first()[0] == 1
    rich = {r.name: r.size for r in results.enrich(engine.entries, stats).collect()}
    assert rich["noext"] == 77 and rich["보고서.hwp"] == 2048
    assert results.copied(engine.hits("a_b"), "name").first()[0] == "a_b"
    lost = tree.neutral(engine.entries, spark.createDataFrame([("C:", 99999)], "drive string, entry_idx long")).first()
    assert (lost["size"], lost.parent_idx, lost.is_dir, lost.has_metadata) == (0, -1, False, False)
    two = engine.entries.select("drive", "entry_idx", "path").unionAll(spark.createDataFrame([("D:", k, f"D:\\{k}") for k in range(40)], "drive string, entry_idx long, path string"))
    drawn = [r.drive for r in results.sample(two, 30).collect()]
    assert len(drawn) == 30 and set(drawn) == {"C:", "D:"} and results.sample(two.limit(0)).count() == 0


def test_drives(spark):
    drives = fixtures.drives(spark)
    roots = lambda df: sorted(r[0] for r in df.select("root").collect())
    assert roots(D.indexable(drives)) == ["C:\\"] and roots(D.indexable(drives, True)) == ["C:\\", "D:\\"] and roots(D.lookup(drives, "d:")) == ["D:\\"]
    assert [r.drive for r in D.to_save(drives).collect()] == ["C:"] and roots(D.remove(drives, F.lit(0b1100))) == ["E:\\", "F:\\"]
    new = drives.where("root = 'E:\\\\'").withColumn("root", F.lit("e:\\"))
    assert roots(D.upsert(drives, new)) == ["C:\\", "D:\\", "F:\\", "e:\\"]


def simulated(base, log):
    """The fold as a machine of one step at a time."""
    live = {r: (-1, n, p) for r, n, p in base}
    for usn, ref, parent, reason, name in sorted(log):
        if reason & J.DELETE:
            live.pop(ref, None)
        elif reason & J.RENAME_NEW:
            if ref in live:
                live[ref] = (live[ref][0], name, live[ref][2])
        elif reason & J.CREATE and ref not in live:
            live[ref] = (usn, name, parent)
    return sorted((r, *v) for r, v in live.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_a_machine(spark, seed):
    rng = random.Random(seed)
    base = [(r, f"b{r}", 5) for r in range(30)]
    log = [(u, rng.randrange(45), rng.randrange(9), rng.choice([J.CREATE, J.DELETE, J.RENAME_NEW, J.CREATE | J.RENAME_NEW, J.CREATE | J.DELETE, J.CLOSE, J.RENAME_OLD]), f"n{u}") for u in range(400)]
    b = spark.createDataFrame([("C:", *x) for x in base], "drive string, mft_ref long, name string, parent_ref long")
    j = spark.createDataFrame([(u, "C:", r, p, c, 0, n) for u, r, p, c, n in log], "usn long, drive string, mft_ref long, parent_ref long, reason long, file_attributes long, name string")
    got = sorted((r.mft_ref, r.birth_usn, r.name, r.parent_ref) for r in J.fold(b, j).collect())
    assert got == simulated(base, log)


LOG = "usn long, drive string, mft_ref long, parent_ref long, reason long, file_attributes long, name string"


def test_journal_into_a_tree(spark, engine):
    log = [(1, "C:", 70, 0, J.DELETE, 0, ""), (2, "C:", 200, 30, J.CREATE, 0, "new.txt"), (3, "C:", 201, 5, J.CREATE, 0x16, "newdir"), (4, "C:", 202, 201, J.CREATE, 0, "in.txt"), (5, "C:", 41, 21, J.RENAME_NEW, 0, "renamed.txt"), (6, "C:", 203, 5, J.CREATE | J.RENAME_NEW, 0, "lost")]
    after = engine.apply_journal(spark.createDataFrame(log, LOG))
    assert names(after, "link") == ["link2.doc"]  # only the first hard link is mapped
    assert names(after, "new") == [] and names(after, "new", hide_hidden=False) == ["new.txt", "newdir"] and names(after, "in.txt") == []
    assert names(after, "renamed") == ["renamed.txt"] and names(after, "lost") == [] and names(after, "abcd") == []
    assert {r.path for r in after.hits("renamed").collect()} == {"C:\\renamed.txt"}  # the folder stays that of the birth
    moved = engine.apply_journal(spark.createDataFrame(log, LOG), apply_moves=True)
    assert {r.path for r in moved.hits("renamed").collect()} == {"C:\\Backup2\\renamed.txt"}
    born = spark.createDataFrame([("C:", 300, 30, False), ("C:", 301, 999, True), ("C:", 302, 20, False)], "drive string, mft_ref long, parent_ref long, hidden_system boolean")
    assert {r.mft_ref: r.hidden_effective for r in J.incremental_hidden(born, engine.entries).collect()} == {300: True, 301: True, 302: False}
    assert J.resumable(7, 10, 7, 10) and not J.resumable(7, 10, 7, 9) and not J.resumable(7, 10, 8, 99) and not J.resumable(0, 0, 0, 5)


def test_snapshots_and_live_changes(spark, engine, tmp_path):
    path, state = str(tmp_path / "snap"), {"C:": {"volume_serial": 7, "journal_id": 3, "last_usn": 1}}
    first = snapshot.save(engine.entries, path, state)
    assert first.drives["C:"]["entries"] == len(TREE) and snapshot.resume_points(first) == {"C:": (3, 1)}
    assert snapshot.load(spark, path, {"C:": 8}, engine.entries.schema) is None and snapshot.load(spark, path, {"C:": 0}, engine.entries.schema) is None
    assert snapshot.load(spark, path, {"C:": 7}, engine.entries.schema).count() == len(TREE) and snapshot.load_grams(spark, path, {"C:": 7}) is None
    told = []
    live = LiveIndex(spark, path, engine.entries.schema, listeners=[lambda e: told.append(e.count())])
    log = [(1, "C:", 41, 0, J.DELETE, 0, ""), (2, "C:", 200, 5, J.CREATE, 0, "one.txt"), (3, "C:", 200, 5, J.RENAME_NEW, 0, "two.txt"), (9, "C:", 77, 5, J.CLOSE, 0, "")]
    frames = spark.createDataFrame(log, LOG)
    frames.where("usn <= 2").coalesce(1).write.json(str(tmp_path / "log"))
    stream = lambda: live.follow(spark.readStream.schema(LOG).json(str(tmp_path / "log")), str(tmp_path / "ck"), available_now=True).awaitTermination()
    stream()
    frames.where("usn > 2").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
    stream()
    now = Engine(live.entries(), engine.config)
    assert names(now, "two") == ["two.txt"] and names(now, "one") == [] and names(now, "abcd") == ["abcd.txt"]  # usn 1 was in the snapshot
    assert snapshot.read_manifest(spark, path).drives["C:"]["last_usn"] == 9 and told == [len(TREE) + 1] * 2
    assert live.apply(frames) is False  # run again, nothing is applied twice
    whole = engine.apply_journal(frames.where("usn > 1"))
    assert sorted(r.path for r in live.entries().collect()) == sorted(r.path for r in whole.entries.collect())
    assert snapshot.delete(spark, path) and snapshot.read_manifest(spark, path) is None


def test_standing_query():
    now = [0.0]
    standing = StandingQuery(lambda q: q.upper(), clock=lambda: now[0])
    assert standing.search("a") == "A" and standing.poll("a") is None
    standing.changed()
    now[0] = 0.4
    standing.changed()
    now[0] = 0.8
    assert standing.poll("a") is None  # it waits from the last change
    now[0] = 0.95
    assert standing.poll("a", busy=True) is None and standing.poll("a") == "A" and standing.poll("a") is None
    standing.changed()
    now[0] = 2
    assert standing.poll("other") is None
    nested = StandingQuery(lambda q: nested.search("new") and "old" if q == "old" else q)
    assert nested.search("old") is None  # superseded by a newer one


def test_delete_rules(spark):
    items = [("", True, 0, 0, "skipped"), ("C:\\a", False, 0, 0, "success"), ("C:\\a", True, 2, 0, "success"), ("C:\\a", True, 32, 0, "failed:Locked"), ("C:\\a", True, 5, 0, "failed:AccessDenied"), ("C:\\a", True, 0, 0, "recycled"), ("C:\\a", True, 0, 33, "failed:Locked"), ("C:\\Windows\\a", True, 0, 5, "failed:Protected"), ("C:\\a ", True, 0, 0, "permanent_candidate"), ("C:\\Windows\\a.", True, 0, 0, "failed:Protected"), ("C:\\a", True, 0, 145, "permanent_candidate")]
    got = results.classify_deletes(spark.createDataFrame([(*i, k) for k, i in enumerate(items)], "path string, exists boolean, probe_code int, recycle_code int, want string, k int")).orderBy("k").collect()
    assert [r.outcome for r in got] == [r.want for r in got] and got[8].reason == "BadName" and got[10].reason == "NotEmpty"
    notice = lambda ok, bad, gone: results.delete_notice(spark.createDataFrame([(ok, bad, gone)], "ok long, failed long, permanent long")).first().notice
    assert [notice(*x) for x in ((1, 0, 0), (3, 0, 0), (1, 0, 1), (3, 0, 3), (3, 0, 1), (3, 1, 0), (3, 1, 1))] == ["one", "many", "permanent_one", "permanent_many", "mixed", "partial", "partial_permanent"]


def test_config_is_only_values():
    assert EngineConfig() == EngineConfig(now=datetime(2020, 1, 1))


def files_of(path):
    import os

    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_no_untouched_drive(spark, engine, tmp_path):
    path = str(tmp_path / "snap")
    both = engine.entries.unionByName(engine.entries.withColumn("drive", F.lit("D:")))
    snapshot.save(both, path, {d: {"volume_serial": 7, "journal_id": 3, "last_usn": 0} for d in ("C:", "D:")}, engine.posting)
    assert snapshot.load_grams(spark, path, {"C:": 7}).count() == engine.posting.count()
    before, old = files_of(path), snapshot.read_manifest(spark, path)
    live = LiveIndex(spark, path, engine.entries.schema)
    log = spark.createDataFrame([(k, "C:", 200 + k, 20, J.CREATE, 0, f"n{k}.txt") for k in range(1, 11)], LOG)
    assert live.apply(log) is True
    now = snapshot.read_manifest(spark, path)
    assert now.number == old.number + 1 and now.drives["D:"] == old.drives["D:"] and now.drives["C:"]["entries"] == len(TREE) + 10
    assert before <= files_of(path) and live.entries().where("drive = 'D:'").count() == len(TREE)
    written = files_of(path)
    assert live.apply(spark.createDataFrame([(12, "D:", 1, 5, J.CLOSE, 0, "x")], LOG)) is False
    assert files_of(path) == written and snapshot.read_manifest(spark, path).drives["D:"]["last_usn"] == 12
    (tmp_path / "snap" / "manifest-99.json").write_text("{ not whole")  # a crash while it was written elsewhere
    assert snapshot.read_manifest(spark, path).drives["D:"]["last_usn"] == 12


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Postings are sorted by gram: a file's statistics leave few row groups for one gram, and the filter reaches the scan."""
    from urllib.parse import unquote

    import pyarrow.parquet as pq

    rows = spark.createDataFrame([("C:", 5, 5, ".", True, True, 0, None)] + [("C:", 10 + k, 5, f"name{k:05d}x", False, False, 0, None) for k in range(3000)], RAW)
    posting = Engine.build(rows, with_grams=True).posting
    plan = ngrams.candidates(posting, ["3:042"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(gram,3:042)" in plan
    files = [unquote(f).removeprefix("file://").removeprefix("file:") for f in posting.inputFiles()]
    metas = [pq.ParquetFile(f).metadata for f in files]
    columns = [m.row_group(g).column(c) for m in metas for g in range(m.num_row_groups) for c in range(m.num_columns)]
    grams = [c.statistics for c in columns if c.path_in_schema == "gram"]
    assert sum(s.min <= "3:042" <= s.max for s in grams) <= 2 < len(grams)


def test_large_caps_equal_small_ones(engine):
    key = lambda df: sorted((r.drive, r.entry_idx) for r in df.collect())
    for most in (1, 7, 8, 20, 500):
        assert key(results.cap_by_ranges(engine.entries, most, 8)) == key(results.cap(engine.entries, most))
    assert results.copied(engine.entries.where("name like 'link%'"), "name", 1).first()[0] == "link1.doc"


def test_appended_entries_are_the_tail(spark, engine):
    more = engine.append(spark.createDataFrame([row(500, 20, "abcd late.txt"), row(501, 5, "New", True)], RAW))
    assert names(more, "abcd") == ["abcd late.txt", "abcd.txt"] and {r.path for r in more.hits("late").collect()} == {"C:\\Back\\abcd late.txt"}
    old = {r.name: r.entry_idx for r in engine.entries.collect()}
    assert {r.name: r.entry_idx for r in more.entries.collect() if r.entry_idx < len(TREE)} == old
    assert names(more.attach_grams(), "abcd") == names(more, "abcd") and more.attach_grams().built_at.first().built_count == len(TREE) + 2


def test_drives_that_get_ready_late(spark):
    tries = iter([False, False, True])
    ready = D.with_ready(fixtures.drives(spark), "f:", lambda root: next(tries), wait=0)
    assert [r.ready for r in ready.where("root = 'F:\\\\'").collect()] == [True] and next(tries, None) is None
    asked = []
    never = D.with_ready(fixtures.drives(spark), "F:\\", lambda root: asked.append(root), wait=0)
    assert len(asked) == 8 and not never.where("root = 'F:\\\\'").first().ready


def test_binary_journals_stream_in_bounded_batches(spark, tmp_path):
    from burrow.sources import image
    from burrow.streaming.live import journal_stream, metrics, superseding

    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.usn").write_bytes(b"".join(image.journal_record(10 * k + j, 70 + j, 5, J.CREATE, 0, f"f{k}{j}.txt") for j in range(3)))
    seen = []
    stream = journal_stream(spark, str(tmp_path / "in"), "C:", files_a_batch=2)
    query = stream.writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.usn for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(x for b in seen for x in b) == [10 * k + j for k in range(5) for j in range(3)] and max(map(len, seen)) <= 6
    assert metrics(query)["batch"] == len(seen) - 1
    superseding(spark)
    assert spark.range(3).count() == 3


def test_all_selected_rows_are_copied(spark):
    many = spark.range(20_003).select(F.lit("C:").alias("drive"), F.col("id").alias("entry_idx"), F.col("id").cast("string").alias("name"))
    assert results.copied(many, "name").first()[0].split("\n") == [str(k) for k in range(20_003)]


def test_a_restored_search_gives_all_its_hits(spark, engine, monkeypatch):
    """Whatever the cap of the engine's settings: here it is far below the hits."""
    photos = [row(500 + k, 20, f"photo {k}.png") for k in range(5)]
    capped = Engine.build(spark.createDataFrame([*TREE, *photos], RAW)).with_config(max_results=2)
    monkeypatch.setattr(queries, "fixture_engine", lambda *_: capped)
    assert sorted(r.name for r in queries.restored_search(spark, "").collect()) == [f"photo {k}.png" for k in range(5)]
    assert engine.with_config(max_results=None).search("txt").count() == len(names(engine, "txt")) > 1
