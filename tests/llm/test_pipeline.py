"""The pipeline and each of its stages, against plain Python where the stage can be said in it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.odd import no_documents, odd_documents

P = pytest.importorskip("corpus_pipeline")

WORDS = "the river stone walks over a hill of green light and then some water falls on old roofs near every town".split()
ITEM = "A train leaves Boston at 9 in the morning and travels 120 miles to the north, so how many hours does it need at 40 miles an hour?"
NOTICE = "this notice stands in many documents and says the same long words in each of them so that nobody needs to read it again"


def corpus(seed=1):
    """(doc_id, text, kind) and labels (doc_id, quality, toxic)."""
    rng = random.Random(seed)
    said = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.choice('abcdefgh')}" for _ in range(n))
    rows = []
    for k in range(300):
        text, kind = "\n".join(said(rng.randrange(20, 40)) for _ in range(3)), "clean"
        if k % 5 == 0:
            text, kind = " ".join(w + "%%#" for w in text.split()), "junk"
        elif k % 10 == 1:
            text, kind = f"{text}\n{NOTICE}", "notice"
        elif k % 10 == 2:
            text, kind = f"{text} {ITEM}", "leak"
        elif k % 10 == 3 and k > 20:
            text, kind = rows[k - 20][1].replace("rivera", "riverz"), "copy"
        rows.append((k, text, kind))
    labels = [(k, int(kind != "junk"), 0) for k, _, kind in rows if k < 200]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    at = str(tmp_path_factory.mktemp("sf"))
    docs = [(k, t, ("en", "fr")[k % 2], f"src{k % 3}", len(t)) for k, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_take_effect_and_leave_the_rest(spark, folder):
    rows, _ = corpus()
    kinds, texts = {k: kind for k, _, kind in rows}, {k: t for k, t, _ in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(P.STAGES)
    good = stage["quality_classifier"](spark, docs, folder)
    assert {r.doc_id for r in good.collect()} == {k for k in kinds if kinds[k] != "junk"}
    lined = {r.doc_id: r.text for r in stage["line_dedup"](spark, docs, folder).collect()}
    assert all(t == texts[k].replace(f"\n{NOTICE}", "") for k, t in lined.items()) and set(lined) == set(kinds)
    near = {r.doc_id for r in stage["near_duplicates"](spark, docs, folder).collect()}
    assert near == {r[0] for r in brute.near_duplicates(list(texts.items()), P.SHINGLE, P.NUM, P.DEN) if r[3]} and len(near) < len(kinds)
    clean = {r.doc_id for r in stage["benchmark_decontamination"](spark, docs, folder).collect()}
    words = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    assert clean == {k for k, t in texts.items() if words(ITEM) not in words(t)}


def test_the_whole_run(spark, folder):
    rows, _ = corpus()
    kinds = {k: kind for k, _, kind in rows}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    now = docs
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns
    last = {r.doc_id: r.mix_probability for r in P.STAGES[-1][1](spark, now, folder).collect()}
    got = P.run(spark, folder)
    assert {r.doc_id: r.mix_probability for r in got.collect()} == last and last
    assert not {kinds[k] for k in last} & {"junk", "leak"} and got.where(F.contains("text", F.lit("this notice"))).count() == 0
    left = {r.doc_id for r in now.collect()}
    assert {k for k, kind in kinds.items() if kind == "clean"} <= left and not any(kinds[k] == "copy" and k - 20 in left for k in left)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_documents(spark, folder, name):
    stage = dict(P.STAGES)[name]
    names = {c: F.lit(1) for c in ("_burrow_key", "_burrow_gone", "mix_topic", "row", "gone", "left", "lines", "key_")}
    for docs in (odd_documents(spark).withColumns(names), no_documents(spark)):
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count()
        if name != "mixing":
            assert out.columns == docs.columns
