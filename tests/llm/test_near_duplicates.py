import random

import numpy as np
import pytest

from burrow.llm import near_duplicates as N
from burrow.llm.components import components
from tests.llm import brute
from tests.llm.odd import no_documents, odd_documents

KEY = lambda r: (r[0] is None, r[0] or 0, r[1])


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=KEY)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    """Groups of copies and near copies around the threshold, chains, a shared passage, short texts."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(12)]
    for g in range(12):
        words = [word() for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.randrange(2, 9)):
            rows.append(edited(rng, words, rng.randrange(0, 4)))
        rows += [" ".join(words)] * rng.randrange(0, 4)
        for _ in range(4):  # chains: each edits the one before
            words = edited(rng, words, 1).split()
            rows.append(" ".join(words).upper())
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(1, 40))]) for _ in range(60)]
    rows += ["", None, "one", "One", "one two", "one two three", "one two three", " \n "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 5)])
def test_equals_brute_force(spark, seed, size):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute.near_duplicates(rows, size), key=KEY)
    assert sum(r[2] != r[0] for r in want) > 40
    assert got(N.near_duplicates(docs, size=size)) == want


def test_large_nodes_branch(spark, monkeypatch):
    """With tiny nodes everything goes down the trees, and nothing is lost."""
    monkeypatch.setattr(N, "NODE", 2)
    monkeypatch.setattr(N, "BLOCK", 3)
    rows = corpus(3)[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(docs)) == sorted(brute.near_duplicates(rows), key=KEY)


def test_blocks_of_few_pairs_lose_none(spark, monkeypatch):
    """Every group of pairs is split, at the first level by one side and below by both."""
    monkeypatch.setattr(N, "PAIRS_A_KEY", 2)
    rows = corpus(5)[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(docs)) == sorted(brute.near_duplicates(rows), key=KEY)


def test_bounds_of_sketches_are_exact_tails():
    rng = np.random.default_rng(9)
    for n, bits in ((N.HASHES, 32), (N.WIDE, 8)):
        p = 0.8 + 0.2 / 2**bits
        assert (rng.binomial(n, p, 2_000_000) < N.agreement(n, 80, 100, bits)).mean() <= 5e-6
        assert (rng.binomial(n, p, 2_000_000) < N.agreement(n, 80, 100, bits) + 8).mean() > 1e-6
    assert N.agreement(10, 1, 1) == 10


def test_candidates_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 0)
    rows = corpus(4)[:80]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(docs)) == sorted(brute.near_duplicates(rows), key=KEY)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    want = sorted(brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()]), key=KEY)
    assert got(N.near_duplicates(docs)) == want
    assert N.near_duplicates(no_documents(spark)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, a), (5, b), (7, a), (9, b), (11, "other words entirely here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: r[2] for r in got(N.near_duplicates(docs))} == {5: 5, 7: 5, 9: 5, 11: 11}


def test_recall_of_the_trees():
    """At the threshold itself, one level misses a pair in fewer than 1 of 10,000 cases, and the filter drops fewer still."""
    rng = np.random.default_rng(5)
    together = kept = 0
    for _ in range(400):
        tokens = rng.integers(1, 1 << 63, 100, dtype=np.uint64)
        x, y = np.sort(tokens[:90]), np.sort(tokens[10:])  # 80 of 100
        least = N._least(np.concatenate([x, y]), np.array([0, 90, 180]))
        same = least[0] == least[1]
        together += same[: N.TREES].any()
        wide = N._least(np.concatenate([x, y]), np.array([0, 90, 180]), N.WIDE, 8)
        kept += same.sum() >= N.agreement(N.HASHES, 80, 100) and (wide[0] == wide[1]).sum() >= N.agreement(N.WIDE, 80, 100, 8)
    assert together == 400 and kept == 400


def test_recall_of_all_levels():
    """At the threshold, of pairs that are compared at the last level only, fewer than 1 in 10,000 stay together in no tree."""
    paths = [[N.level_hash(t, level) for level in range(1, N.LEVELS + 1)] for t in range(N.TREES)]
    assert len({h for path in paths for h in path}) == N.TREES * N.LEVELS <= N.HASHES
    rng, missed = np.random.default_rng(6), 0
    for _ in range(10):
        agree = rng.random((100_000, N.HASHES)) < 0.8
        missed += (~agree[:, paths].all(axis=2).any(axis=1)).sum()
    assert missed < 100


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    links = [(a, b) for a, b in links if a != b]
    nodes = {x for link in links for x in link}
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == brute.components(nodes, links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
