import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from burrow.llm import line_templates, mixing
from tests.llm.odd import no_documents, odd_documents


def oracle(sql, docs):
    """The SQL's rows over a DataFrame of documents."""
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    out = con.sql(sql)
    return [dict(zip(out.columns, r)) for r in out.fetchall()]


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    key = lambda r: repr(sorted((k, round(v, 5) if isinstance(v, float) else v) for k, v in r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))


def many_lines(spark, seed=1):
    rng = random.Random(seed)
    said = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    boiler, long = "All rights reserved by all of them.", said(55)
    rows, copied = [], [said(30) for _ in range(6)]
    for k in range(40):
        lines = [said(rng.randrange(1, 60)) for _ in range(rng.randrange(2, 7))]
        if k % 4 == 0:
            lines.insert(rng.randrange(len(lines)), boiler)
        if k % 5 == 0:
            lines.append(long)
        if k % 6 == 0:
            lines.append(f"Order {k} was shipped on day {k * 7} to the place that you gave us before noon and so on it went to {said(1)} {said(6)}")
        if k % 8 == 3:
            lines = copied[:5] + [said(4)]
        rows.append((k, "\n".join(lines), "en", f"s{k % 3}"))
    rows += [(100, boiler, "en", "s0"), (101, boiler + "\n\n", None, None), (102, rows[0][1], "fr", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_the_oracle(spark, seed):
    docs = many_lines(spark, seed).unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source"))
    docs = docs.unionAll(docs.where("doc_id % 4 = 0")).unionAll(docs.where("doc_id % 8 = 0"))
    got = rows_of(line_templates.line_report(docs))
    assert sum(r["n_dropped"] for r in got) > 15
    same(got, oracle(line_templates.sql(), docs))


def test_recurring_lines_go_and_copies_stay(spark):
    docs = many_lines(spark).withColumns({"n_chars": F.length("text").cast("long"), "key": F.lit("k"), "line": F.lit(1)})
    kept = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert not any("All rights reserved" in r.text for r in kept.values()) and {100, 101}.isdisjoint(kept)
    assert not any("was shipped on day" in r.text for r in kept.values())
    assert all(kept[k].text == before[k].text for k in (3, 11, 19, 27, 35))  # near copies, which the next stage judges
    assert all(r.n_chars == len(r.text) and r.key == "k" for r in kept.values())
    assert line_templates.drop_recurring_lines(docs).columns == docs.columns
    assert line_templates.drop_recurring_lines(no_documents(spark)).count() == 0
    assert line_templates.drop_recurring_lines(odd_documents(spark)).count() == odd_documents(spark).count()


def test_no_python_runs_on_the_native_path(spark):
    plan = line_templates.drop_recurring_lines(many_lines(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_mixing_equals_the_oracle_and_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join("word" for _ in range(rng.randrange(0, 900))) + (" | x" if k % 9 == 0 else " 12345" if k % 5 == 0 else ""), rng.choice(["en", "fr", "de", None]), "hot" if k % 3 else f"s{k % 5}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd_documents(spark).select("doc_id", "text", "lang", "source"))
    same(rows_of(mixing.mix_report(docs)), oracle(mixing.sql(), docs))
    mixed = mixing.mix(docs).drop("row").toPandas()
    assert abs((mixed.tokens * mixed.probability).sum() / mixed.tokens.sum() - mixing.RATE) < 1e-6
    for column in mixing.DIMENSIONS:
        tokens = mixed.groupby(column).tokens.sum()
        tokens = tokens[tokens > 0]
        target = tokens**mixing.TEMPER
        weighed = (mixed.tokens * mixed.probability * mixed.repeat).groupby(mixed[column]).sum()[tokens.index]
        assert np.allclose(weighed / weighed.sum(), target / target.sum(), rtol=1e-4)
    assert mixed.residual.max() <= mixing.TOLERANCE
    assert mixing.mix(no_documents(spark)).count() == 0


@pytest.mark.parametrize("small", [mixing.SMALL, 0])
def test_mixing_to_given_targets(spark, small):
    rng = random.Random(5)
    rows = [(k, "word " * rng.randrange(1, 60), rng.choice(["en", "fr", "de", None]), rng.choice(["web", "books", "code"])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"web": 0.2, "books": 0.5, "none of these": 0.1}, "language": {None: 0.4, "en": 0.6}}
    got = mixing.mix(docs, targets=targets, small=small, rounds=30 if small else 4, rate=0.1).drop("row").toPandas()
    heft = got.tokens * got.probability * got.repeat
    share = lambda c: (heft.groupby(got[c]).sum() / heft.sum()).to_dict()
    assert got.residual.max() < 1e-3
    want = {"=web": 0.2 / 0.9, "=books": 0.5 / 0.9, "=code": 0.2 / 0.9}
    assert all(abs(share("source")[k] - v) < 1e-3 for k, v in want.items())
    assert all(abs(share("language").get(k, 0) - v) < 1e-3 for k, v in {"null": 0.4, "=en": 0.6, "=fr": 0, "=de": 0}.items())


def test_raking_that_cannot_converge_says_so(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x"), (2, "c d", "fr", "y")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, targets={"source": {"x": 0.9, "y": 0.1}, "language": {"en": 0.1, "fr": 0.9}}, rounds=10)
    assert got.first().residual > 0.1


def test_both_ways_of_raking_agree(spark):
    docs = many_lines(spark)
    small, large = (mixing.mix(docs, small=n, rounds=2, tolerance=0).select("row.doc_id", "weight", "probability", "repeat", "sampled").toPandas().sort_values("doc_id") for n in (1000, 0))
    for c in ("weight", "probability", "repeat"):
        assert np.allclose(small[c], large[c], rtol=1e-4)


def test_columns_of_other_names_pass(spark):
    docs = odd_documents(spark).withColumns({c: F.lit(1) for c in ("s", "t", "l", "row", "weight", "topic", "count", "line", "_source", "_key")})
    mixed = mixing.mix(docs)
    assert mixed.select("row.*").columns == docs.columns and mixed.count() == docs.count()
    assert line_templates.drop_recurring_lines(docs).columns == docs.columns
