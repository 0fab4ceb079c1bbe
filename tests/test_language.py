from datetime import UTC, datetime

import pytest

from burrow.config import EngineConfig, excluded_changed, forget, load, parse_excluded, remember, save, toggle_pin
from burrow.operators.ngrams import grams, needed
from burrow.plans import rewrite as R
from burrow.plans.compile import like_pattern
from burrow.plans.spec import QuerySpec, date_literal, parse, size_literal, tokens

NOON = EngineConfig(now=datetime(2024, 2, 29, 12, tzinfo=UTC))


@pytest.mark.parametrize("query,want", [
    ("vacation photo", dict(text=("vacation", "photo"))),
    ("*.jpg .PNG", dict(extensions=frozenset({"jpg", "png"}))),
    ("report -draft -*.log", dict(text=("report",), without_text=("draft",), without_extensions=frozenset({"log"}))),
    (r'photo "D:\My Docs' + '\\"', dict(text=("photo",), paths=("D:\\My Docs\\",))),
    ('"-a b"', dict(without_text=("a b",))),
    ("a/b", dict(paths=("a\\b",))),
    (">1.5GB >1GB", dict(size_over=1_610_612_736)),
    ("<5MB <1MB", dict(size_under=1_048_576)),
    (">10", dict(text=(">10",))),
    (">1.2.3MB", dict(text=(">1.2.3mb",))),
    (">2026.01", dict(since=datetime(2026, 1, 1))),
    (">2026/01", dict(since=datetime(2026, 1, 1))),
    (">2024-02-31 >2024-13 >1969", dict(text=(">2024-02-31", ">2024-13", ">1969"))),
    (">100B", dict(size_over=100)),
    ("- > .", dict(text=("-", ">", "."))),
    ("*.tar.gz", dict(extensions=frozenset({"tar.gz"}))),
    ("*.t?t", dict(patterns=("*.t?t",))),
    ("-foo*", dict(without_text=("foo*",))),
    ("folder: file:", dict(kind="file")),
    ("DIR:", dict(kind="folder")),
    ("*.txt folder:", dict(extensions=frozenset({"txt"}), kind="folder")),
    (">2020 >2021-05 <2023 <2022.07.09", dict(since=datetime(2021, 5, 1), until=datetime(2022, 7, 9))),
    (r"-.log\x", dict(without_text=(r".log\x",))),
    ("", {}), ("  ", {}),
])
def test_parser(query, want):
    assert parse(query) == QuerySpec(**want)


@pytest.mark.parametrize("query,selects", [("a", True), ("*.x", True), ("a?", True), (">1KB", True), ("<2020", True), ("folder:", False), ("a/b", False), ("-a", False), ("-*.x file:", False), ("", False)])
def test_what_selects(query, selects):
    assert parse(query).selects is selects


def test_literals():
    assert size_literal("9.3EB") is None and size_literal("9000000TB") is None and size_literal("1 kb") == 1024 and size_literal("5") is None and size_literal("KB") is None
    assert [date_literal(w, NOON) for w in ("today", "WEEK", "month", "year")] == [datetime(2024, 2, 29), datetime(2024, 2, 22), datetime(2024, 1, 30), datetime(2023, 2, 28)]
    seoul = EngineConfig(time_zone="Asia/Seoul", now=datetime(2024, 1, 1, 20, tzinfo=UTC))
    assert date_literal("today", seoul) == datetime(2024, 1, 1, 15) and date_literal("2024", seoul) == datetime(2023, 12, 31, 15)
    assert all(date_literal(x, NOON) is None for x in ("1969", "3000", "24", "2024-1-2-3", "2024-x", "", "2023-02-29"))


def test_tokens_and_patterns():
    assert tokens('a "b c"d "" e') == ["a", "b cd", "e"]
    assert like_pattern("A*_?%!") == "a%!__!%!!"


def test_macros():
    assert R.group_filter("old *.pdf .x photo", "zip") == "*.zip *.rar *.7z *.tar *.gz old photo" and R.group_filter("a", "none") == "a"
    assert R.kind_filter('folder: "my a" x', "file:") == '"my a" x file:' and R.kind_filter("DIR: x", None) == "x"
    assert R.bound_filter(">1MB >2020 a", ">1GB", True) == ">2020 a >1GB" and R.bound_filter(">1MB >2020 a", None, False) == ">1MB a"
    assert R.in_folder(r"a C:\x", "D:\\My Docs") == 'a "D:\\My Docs\\"' and R.in_folder("a", "D:\\x\\") == "a D:\\x\\"


def test_grams():
    assert grams("abcd") == ["3:abc", "3:bcd"] and grams("ab") == [] and grams("보고서") == ["2:고서", "2:보고"] and grams("가a나") == []
    assert needed(parse("abcd")) == ["3:abc", "3:bcd"] and needed(parse("ab abcd")) is None and needed(parse("ab*cde")) == ["3:cde"] and needed(parse(">1KB")) is None


def test_settings(tmp_path):
    config = EngineConfig(excluded_folders=("a",), pinned=("x",), history=("y", "X"))
    assert save(config, tmp_path / "c.json") and load(tmp_path / "c.json") == config
    (tmp_path / "bad.json").write_text("{")
    assert load(tmp_path / "bad.json") == load(tmp_path / "none.json") == EngineConfig() and not save(config, tmp_path / "no" / "c.json")
    assert parse_excluded(" a ; ;b;") == ("a", "b") and not excluded_changed(("A", "b"), ("B", "a")) and excluded_changed(("a",), ())
    assert toggle_pin(("a", "B"), "b") == ("a",) and toggle_pin(("a",), "b") == ("b", "a")
    assert remember(("a", "b"), "B") == ("B", "a") and len(remember(tuple("abcdefghij"), "k")) == 10
    assert forget(config, "x") == EngineConfig(excluded_folders=("a",), history=("y",))
