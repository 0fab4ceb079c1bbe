import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from burrow.llm import quality, toxicity
from burrow.llm.kernels import slices
from tests.llm.odd import no_documents, odd_documents


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "stone", "walks", "over", "a", "hill", "of", "green", "light.", "And", "then,"]) for _ in range(n))


def labelled(spark, n=400, seed=3):
    rng, rows, labels = random.Random(seed), [], []
    for k in range(n):
        text, q, t = prose(rng, rng.randrange(5, 120)), 1, 0
        if k % 4 == 0:
            text, q = " ".join(w + "%%%" for w in text.split()), 0
        elif k % 4 == 1:
            w = text.split()
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron,", "Vequ" + rng.choice(["ta", "mo", "gn", "de", "ille"])]))
            text, t = " ".join(w), 1
        rows.append((k, text))
        labels.append((k, q, t))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cumulative_link_gradient():
    rng = np.random.default_rng(1)
    rows = [(np.array(sorted(rng.choice(50, 5, replace=False)), np.int32), rng.random(5).astype(np.float32)) for _ in range(300)]
    true = rng.normal(size=50) * 3
    latent = np.array([true[c] @ v for c, v in rows]) + rng.logistic(size=300) * 0.2
    grades = np.digitize(latent, np.quantile(latent, [0.3, 0.7])).astype(np.int64)
    model = quality.train(rows, grades, 3, steps=300)
    scores = np.array([model.weights[c] @ v for c, v in rows])
    tails = model.tails(scores)
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert (np.round(tails.sum(axis=1)) == grades).mean() > 0.85


def test_features_and_scores_agree():
    texts = ["a bc a", "", "x", "é é é | %%%", "word " * 50]
    ((_, _, data, offsets),) = list(slices(pa.array([t.encode() for t in texts], pa.binary())))
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.WIDTH), np.array([0.0, 1.0]))
    assert np.allclose(model.score(data, offsets), [model.weights[c] @ v for c, v in quality.features(data, offsets)], atol=1e-4)


def test_quality_on_unseen_documents(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.quality_report(docs, labels.where("doc_id < 300")).collect()}
    assert len(got) == 400 and all((got[k].selected) == (k % 4 != 0) for k in range(300, 400))
    kept = quality.keep_good(docs, labels.where("doc_id < 300"))
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 0").count() == 0 and kept.count() == 300


def test_quality_of_odd_documents(spark):
    docs, odd = labelled(spark, 60)[0], odd_documents(spark)
    none = spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for some in (odd, no_documents(spark), docs):
        assert quality.quality_report(some, none).where("selected").count() == some.count()
    twice = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (6, 1, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades_of(twice).groupBy("doc_id").min("grade").withColumnRenamed("min(grade)", "grade").collect()} == {4: 0, 6: 2, 8: 0}
    assert quality.keep_good(odd, twice).columns == odd.columns


def plain_marginals(field, emissions):
    """Forward-backward over all paths of one chain."""
    n, p = len(emissions), np.zeros(len(emissions))
    total = 0.0
    for path in range(2**n):
        y = [path >> i & 1 for i in range(n)]
        w = np.exp(sum(e for e, s in zip(emissions, y) if s) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
    return p / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    texts = ["one two three. four five", "six", "", "seven eight nine ten eleven twelve thirteen"]
    ((_, _, data, offsets),) = list(slices(pa.array([t.encode() for t in texts], pa.binary())))
    t = toxicity.tokens(data, offsets)
    size = 1 << toxicity.BITS
    field = toxicity.Field(*(rng.normal(size=size) for _ in range(3)), 0.3, rng.normal(size=(2, 2)), np.zeros(3))
    logits, _ = field.marginals(t)
    e = field.emissions(t)
    cuts = [*t.chains, len(t.buckets)]
    assert len(t.chains) == 4
    for a, b in zip(cuts[:-1], cuts[1:]):
        assert np.allclose(1 / (1 + np.exp(-logits[a:b])), plain_marginals(field, e[a:b]))


def test_long_chains_are_cut():
    ((_, _, data, offsets),) = list(slices(pa.array([b"w " * 1000], pa.binary())))
    t = toxicity.tokens(data, offsets)
    assert len(t.buckets) == 1000 and (np.diff([*t.chains, 1000]) <= toxicity.CHAIN).all()


def test_toxic_spans_on_held_out_documents(spark):
    docs, labels = labelled(spark, 1200)
    rows = toxicity.toxicity_digest(docs, labels).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in held} and len(held) > 200
    assert np.mean([r.predicted == (r.doc_id % 4 == 1) for r in held]) > 0.97
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in held:
        for span in filter(None, r.spans.split(",")):
            a, b = map(int, span.split(":"))
            assert any(s in texts[r.doc_id][a:b].lower() for s in ("idiot", "moron", "vequ"))


def test_labels_of_held_out_ids_are_not_read(spark):
    docs, labels = labelled(spark, 300)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_digest(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("rows", [[], [(None, 1), (1, None)], [(4, 0), (5, 0)]])
def test_toxicity_without_usable_labels(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    for docs in (odd_documents(spark), no_documents(spark)):
        got = toxicity.toxicity_digest(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score < 0.3 and r.predicted == 0 and r.spans == "" for r in got)


def test_gradient_of_the_cumulative_link_equals_differences():
    rng = np.random.default_rng(8)
    width, n, grades = 12, 30, rng.integers(0, 4, 30)
    cols, vals, at = rng.integers(0, width, 90), rng.normal(size=90), np.repeat(np.arange(n), 3)
    heft, x = rng.random(n), rng.normal(size=width + 3) * 0.3
    args = (cols, vals, at, grades, heft, 4, 0.05)
    _, g = quality.loss(x, *args)
    for k in range(len(x)):
        step = np.zeros_like(x)
        step[k] = 1e-6
        assert abs((quality.loss(x + step, *args)[0] - quality.loss(x - step, *args)[0]) / 2e-6 - g[k]) < 1e-5


def test_expected_grades_equal_plain_sums(spark):
    """Scores over whole texts against sums of weights in plain Python."""
    import math
    import re

    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=quality.WIDTH), np.array([-0.5, 0.7]))
    texts = ["a bc a a", "", "x", "é é | %%%", "word other " * 60]
    got = {r.doc_id: r for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    bucket = lambda w: int(quality.word_hash(w.encode()) >> (64 - quality.WORD_BITS))
    for k, t in enumerate(texts):
        words, raw = re.findall(r"[^\x20\x09-\x0D]+", t), t.encode()
        fresh = [w for i, w in enumerate(words) if not i or words[i - 1] != w]
        s = sum(model.weights[bucket(w)] for w in fresh) / math.sqrt(max(len(words), 1))
        s += 8 * sum(model.weights[(1 << quality.WORD_BITS) + (a << 8 | b)] for a, b in zip(raw, raw[1:])) / max(len(raw), 1)
        if words:
            s += 10 * (len(words) - len(fresh)) / len(words) * model.weights[-2] + math.log1p(len(words)) / 10 * model.weights[-1]
        tails = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        assert np.allclose(got[k].tails, tails, atol=1e-5) and abs(got[k].expected_grade - sum(tails)) < 1e-5


def test_fits_are_bounded(spark, monkeypatch):
    """One text a labelled id, however many rows it has, and no more counts than the bound."""
    docs, labels = labelled(spark, 200)
    many = docs.unionAll(spark.range(3000).selectExpr("5L doc_id", "concat('a ', id) text"))
    seen = {}
    monkeypatch.setattr(quality, "train", lambda rows, grades, n: seen.update(n=len(rows), counts=sum(len(r[0]) for r in rows)))
    quality.fit(many, quality.grades_of(labels), 3)
    assert seen["n"] == 200
    quality.fit(many, quality.grades_of(labels), 3, most=seen["counts"] // 2)
    assert 50 < seen["n"] < 150
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic, weight: seen.update(n=len(rows), tokens=sum(len(r[0]) for r in rows)))
    toxicity.fit(many, labels)
    assert seen["n"] == 200
    toxicity.fit(many, labels, most=seen["tokens"] // 2)
    assert 50 < seen["n"] < 150


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    from burrow.llm import kernels

    docs, labels = labelled(spark, 400)
    field = toxicity.fit(docs, labels)
    text = "The river é walks. " * 30 + "You moron, idiot. " + "Stone hill, green. " * 30
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = toxicity.score(frame, field).first()
    monkeypatch.setattr(toxicity, "pieces", lambda *a: kernels.pieces(*a, limit=100))
    data = np.frombuffer(text.encode(), np.uint8)
    assert len(list(toxicity.pieces(data, np.array([0, len(data)]), toxicity._STOP, toxicity._SOLID))) > 8
    cut = toxicity.score(frame, field).first()
    assert whole.spans and [tuple(s) for s in cut.spans] == [tuple(s) for s in whole.spans] and abs(cut.score - whole.score) < 1e-6
    assert all(text[s.start : s.end].lower() in ("moron", "idiot", "moron, idiot") for s in whole.spans)


def test_a_fit_holds_little_beside_its_counts():
    """The driver's memory is short: two million counts of 8 bytes, and no more copies of them than need be."""
    rng = np.random.default_rng(3)
    rows = [(rng.integers(0, quality.WIDTH, 1000).astype(np.int32), rng.random(1000, np.float32)) for _ in range(2000)]
    tracemalloc.start()
    quality.train(rows, np.arange(2000) % 3, 3, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
