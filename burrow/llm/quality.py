"""Quality by ordinal regression: a cumulative-link model over graded ratings.

P(grade > k) = sigmoid(score - threshold[k]) with one score for all grades, made
of weights of hashed words, byte pairs (rates), repeated words and length, and with
thresholds kept in order by construction. Fitted on a bounded sample of labelled
documents: at most ``sample`` ids, those with the smallest hashes, one text for each,
and of these the first with ``MOST_COUNTS`` sparse counts in all, which alone reach the
driver. Scoring reads every whole text once, without a shuffle; beside the text a
worker holds a few bytes a word of it.

Nulls: a null text is empty; an empty text has score 0, so the thresholds alone
decide; a label with a null id or grade is not used; without usable labels every
document gets the top grade. Repeated labels of an id count once (the lowest
grade), and so do repeated rows of an id (the greatest text). Equal texts get equal
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.kernels import CHUNK, bounds, hashed_words, slices, word_hashes
from burrow.store import Tables, give_back

WORD_BITS, PAIRS = 15, 1 << 16
DENSE = 2
WIDTH = (1 << WORD_BITS) + PAIRS + DENSE
SAMPLE = 6000
#: Counts of all sampled documents together: 8 bytes each on the driver, and some 50 while fitting.
MOST_COUNTS = 4_000_000
#: Counts that a step of the fit works on at once, which bounds the driver's memory beside the counts themselves.
PART = 1 << 18


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and their rows (a word that repeats the one before it counts only as a repeat), word counts, and the dense features."""
    n, last = len(offsets) - 1, (None, None)
    buckets, rows, counts, again = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)], np.zeros(n), np.zeros(n)
    for hashes, row in hashed_words(data, offsets):
        if not len(hashes):
            continue
        repeats = np.r_[(hashes[0], row[0]) == last, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]
        last = hashes[-1], row[-1]
        counts += np.bincount(row, minlength=n)
        again += np.bincount(row, repeats, n)
        buckets.append((hashes[~repeats] >> np.uint64(64 - WORD_BITS)).astype(np.uint16))
        rows.append(row[~repeats].astype(np.int32))
    dense = np.stack([10 * again / np.maximum(counts, 1), np.log1p(counts) / 10], axis=1)
    return np.concatenate(buckets), np.concatenate(rows), counts, dense


def word_hash(word: bytes) -> int:
    """The hash of one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def _pairs(data: np.ndarray) -> np.ndarray:
    """Columns of the byte pairs that begin at each byte."""
    return (1 << WORD_BITS) + (data[:-1].astype(np.int32) << 8 | data[1:])


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse (column, value) of each row."""
    buckets, rows, counts, dense = _words(data, offsets)
    cut, out = bounds(rows, len(offsets) - 1), []
    for k in range(len(offsets) - 1):
        w, wn = np.unique(buckets[cut[k] : cut[k + 1]], return_counts=True)
        text = data[offsets[k] : offsets[k + 1]]
        p, pn = np.unique(_pairs(text), return_counts=True)
        columns = np.concatenate([w.astype(np.int32), p, WIDTH - DENSE + np.arange(DENSE)]).astype(np.int32)
        values = np.concatenate([wn / np.sqrt(max(counts[k], 1)), 8 * pn / max(len(text), 1), dense[k] * (counts[k] > 0)])
        out.append((columns, values.astype(np.float32)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row, to six places: sums are taken in pieces, whose ends aren't the same everywhere."""
        buckets, rows, counts, dense = _words(data, offsets)
        n, w = len(offsets) - 1, self.weights
        out = np.bincount(rows, w[buckets], n) / np.sqrt(np.maximum(counts, 1))
        sizes, told = np.maximum(offsets[1:] - offsets[:-1], 1), np.zeros(n)
        for at in range(0, len(data), CHUNK):
            sums = np.r_[0, np.cumsum(w[_pairs(data[at : at + CHUNK + 1])])]
            low = np.clip(offsets[:-1] - at, 0, len(sums) - 1)
            high = np.clip(offsets[1:] - 1 - at, low, len(sums) - 1)
            told += sums[high] - sums[low]
        return np.round(out + 8 * told / sizes + (dense * (counts > 0)[:, None]) @ w[-DENSE:], 6)


def thresholds(x: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logs of the gaps."""
    return np.cumsum(np.r_[x[:1], np.exp(x[1:])])


def loss(x: np.ndarray, cols: np.ndarray, vals: np.ndarray, at: np.ndarray, grades: np.ndarray, heft: np.ndarray, n_grades: int, decay: float) -> tuple[float, np.ndarray]:
    """The negative log-likelihood of the grades, weighted by ``heft``, with a ridge on the weights, and its gradient.

    x: the weights, the first threshold, logs of the gaps; cols, vals and at: columns, values and rows of the sparse features.
    """
    width, n = len(x) - n_grades + 1, len(grades)
    parts = [slice(k, k + PART) for k in range(0, len(cols), PART)]  # in the order of the counts, so that sums are the same as of all at once
    s = np.zeros(n)
    for k in parts:
        np.add.at(s, at[k].astype(np.intp), x[cols[k]] * vals[k])
    over = 1 / (1 + np.exp(np.clip(thresholds(x[width:])[None, :] - s[:, None], -40, 40)))
    padded = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)
    i = np.arange(n)
    high, low = padded[i, grades], padded[i, grades + 1]
    p = np.maximum(high - low, 1e-12)
    dh, dl = high * (1 - high) / p, low * (1 - low) / p
    by_threshold = np.zeros((n, n_grades + 1))
    by_threshold[i, grades] += heft * dh
    by_threshold[i, grades + 1] -= heft * dl
    g = np.zeros_like(x)
    pull = -heft * (dh - dl)
    for k in parts:
        np.add.at(g, cols[k].astype(np.intp), vals[k] * pull[at[k]])
    g[:width] += decay * x[:width]
    g[width:] = np.cumsum(by_threshold.sum(axis=0)[1:n_grades][::-1])[::-1]
    g[width + 1 :] *= np.exp(x[width + 1 :])
    return float(-(heft * np.log(p)).sum() + decay / 2 * (x[:width] ** 2).sum()), g


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = 120, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Adam on the mean negative log-likelihood of the grades, each grade weighted by the root of its rarity."""
    if not len(rows) or len(np.unique(grades)) < 2:
        low = -4.0 if not len(rows) else 0.0
        flat = [low if not len(rows) or k < grades.max() else 4.0 for k in range(n_grades - 1)]
        return Model(np.zeros(WIDTH), np.array(flat) + np.arange(n_grades - 1) * 1e-3)
    cols, vals = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    share = np.bincount(grades, minlength=n_grades) / len(rows)
    heft = 1 / np.sqrt(np.maximum(share, 1e-9))[grades]
    heft /= heft.sum()
    x = np.zeros(WIDTH + n_grades - 1)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        _, g = loss(x, cols, vals, at, grades, heft, n_grades, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(x[:WIDTH], thresholds(x[WIDTH:]))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample: int = SAMPLE, most: int = MOST_COUNTS) -> Model:
    """Fits on at most ``sample`` rated documents with ``most`` counts. ``docs``: doc_id, text; ``ratings``: doc_id, grade from 0."""
    known = ratings.where("doc_id is not null and grade is not null")
    rated = known.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # ids and grades only: `sample` rows bound the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                got = features(data, offsets)
                columns, values = (pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1))
                own = [batch.column(k).slice(first, end - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, columns, values], ["doc_id", "grade", "cols", "vals"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.max("text").alias("text"))
    held = Tables(docs.sparkSession)
    counted = held.add(joined.mapInArrow(run, "doc_id long, grade int, cols binary, vals binary"))
    sizes = counted.select("doc_id", (F.length("cols") / 4).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `sample` rows
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most, side="right"))
    if fits < len(sizes):
        counted = counted.where(F.col("doc_id").isin([r["doc_id"] for r in sizes[:fits]]))
    got = counted.toArrow().sort_by("doc_id")
    held.clear()
    rows = [(np.frombuffer(c.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for c, v in zip(got["cols"], got["vals"], strict=True)]  # views
    model = train(rows, got["grade"].to_numpy().astype(np.int64), n_grades)
    del got, rows
    give_back(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, and tails: P(grade >= 1), P(grade >= 2), ... The model has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                tails = shared.value.tails(shared.value.score(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tails array<double>")


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two binary labels: 0 poor, 1 well written but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


#: A document is rejected when a grade of at least 1 is less likely than this.
KEEP_AT = 0.5


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all their columns, whose P(grade >= 1) reaches KEEP_AT; scored row by row, so ids needn't be unique."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, grades_of(labels), 3))

    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, end, data, offsets in slices(batch.column(text)):
                keep[first:end] = shared.value.tails(shared.value.score(data, offsets))[:, 0] >= KEEP_AT
            yield batch.filter(pa.array(keep))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # whatever the columns are called
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected grade, the tail probabilities, and whether the document is selected."""
    scored = score(docs, fit(docs, grades_of(labels), 3))
    return scored.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_usable"), F.col("tails")[1].alias("p_good"), (F.col("tails")[0] >= KEEP_AT).alias("selected"))
