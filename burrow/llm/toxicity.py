"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits and non-ASCII bytes, ASCII letters folded; a
chain is a sentence (cut after ``CHAIN`` tokens). Two states; the toxic state's
emission is the sum of hashed weights of the token, of its beginnings of some
lengths, and of its two neighbours. Document labels become token labels first: in a
toxic document, tokens that are, or begin with, something whose document counts
separate toxic from clean documents (a likelihood ratio over ``SEPARATES``, where
near copies count once together) are toxic; every other token is clean. The field is
fitted to these by its conditional likelihood on a bounded sample of labelled documents:
at most ``sample`` ids, one text for each, and of these the first with ``MOST_TOKENS``
tokens in all.

Scoring runs forward-backward over all chains of every whole text. A text over 256 KB
goes in pieces that end at a sentence's end, so a worker's memory is bounded whatever a
text's length; a sentence longer than a piece has a chain end there too. A document's
score is a calibrated function of its largest marginal and the sum of its
marginals; spans are runs of tokens with a marginal of a half or more (code points,
end exclusive).

Nulls: a null text is empty, and an empty text has the score of a text without any
toxic token; labels with a null id or label aren't used; without usable labels the
score is 0 everywhere. A null id is not held out. Equal texts get equal results; of
rows that share a labelled id the greatest text is used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.llm.kernels import ascii_lower, head_hashes, mix, pieces, shingles, slices, word_hashes
from burrow.store import Tables

BITS = 18
CHAIN = 256
SAMPLE = 2400
#: Tokens of all sampled documents together: 16 bytes each on the driver, and some 150 while fitting.
MOST_TOKENS = 2_000_000
SEPARATES = 16.0
#: How many times as often toxic documents must have a token as clean ones.
MORE_OFTEN = 4.0
PREDICT_AT = 0.3
#: Bytes of a token's beginnings that are features; a token must be longer. Bucket 0 stands for none and keeps weight 0.
BEGINNINGS = (4, 5, 6)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SOLID = _WORD.copy()
_SOLID[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    buckets: np.ndarray  # a column for the token, one for each beginning
    chains: np.ndarray  # first token of every chain


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = ascii_lower(data)
    solid = _WORD[low] if len(low) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = solid.copy(), solid.copy()
    if len(low):
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    shift = np.uint64(64 - BITS)
    buckets = np.zeros((len(starts), 1 + len(BEGINNINGS)), np.int32)
    buckets[:, 0] = np.maximum(word_hashes(low, starts, ends) >> shift, 1)
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(ends - starts > n)
        buckets[long, k] = np.maximum(mix(head_hashes(low, starts[long], n) + np.uint64(n)) >> shift, 1)
    if not len(starts):
        return Tokens(starts, ends, rows, buckets, np.zeros(0, np.int64))
    stops = np.flatnonzero(_STOP[low])
    parted = np.searchsorted(stops, starts[1:]) > np.searchsorted(stops, ends[:-1])
    heads = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | parted])
    sizes = np.diff(np.r_[heads, len(starts)])
    if (sizes > CHAIN).any():
        heads = np.concatenate([np.arange(h, h + n, CHAIN) for h, n in zip(heads, sizes, strict=True)])
    return Tokens(starts, ends, rows, buckets, heads)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class Field:
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2, from state to state
    calibration: np.ndarray  # constant, of the largest marginal's logit, of the log of the marginals' sum

    def emissions(self, t: Tokens) -> np.ndarray:
        word = t.buckets[:, 0]
        out = self.here[t.buckets].sum(axis=1) + self.bias
        inner = np.ones(len(out), bool)
        inner[t.chains] = False
        k = np.flatnonzero(inner)
        out[k] += self.before[word[k - 1]]
        out[k - 1] += self.after[word[k]]
        return out

    def marginals(self, t: Tokens) -> tuple[np.ndarray, dict]:
        """Logits of each token's toxic marginal, and what a gradient needs."""
        e, n = self.emissions(t), len(t.buckets)
        if not n:
            return e, {}
        sizes = np.diff(np.r_[t.chains, n])
        order = np.argsort(-sizes, kind="stable")
        heads, sizes = t.chains[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # chains longer than k
        a = self.moves
        forward, backward = e.copy(), np.zeros(n)
        for k in range(1, int(sizes[0])):
            at = heads[: active[k]] + k
            r = forward[at - 1]
            forward[at] += _log_sum(a[0, 1], a[1, 1] + r) - _log_sum(a[0, 0], a[1, 0] + r)
        for k in range(int(sizes[0]) - 2, -1, -1):
            at = heads[: active[k + 1]] + k
            r = e[at + 1] + backward[at + 1]
            backward[at] = _log_sum(a[1, 0], a[1, 1] + r) - _log_sum(a[0, 0], a[0, 1] + r)
        return forward + backward, {"e": e, "forward": forward, "backward": backward}

    def pairs(self, t: Tokens, held: dict) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that follow another in their chain, and the marginals of the pairs of states (4 columns)."""
        inner = np.ones(len(t.buckets), bool)
        inner[t.chains] = False
        k = np.flatnonzero(inner)
        f, b = held["forward"][k - 1], held["e"][k] + held["backward"][k]
        a = self.moves
        logs = np.stack([a[0, 0] + 0 * f, a[0, 1] + b, a[1, 0] + f, a[1, 1] + f + b], axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return k, p / p.sum(axis=1, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: What a text without tokens has: the least logit, and no sum.
_NONE = -12.0


def gathered(logits: np.ndarray, rows: np.ndarray, top: np.ndarray, total: np.ndarray) -> None:
    """Adds tokens to the largest logit and the sum of marginals of each row."""
    np.maximum.at(top, rows, np.clip(logits, -12, 12))
    total += np.bincount(rows, _sigmoid(logits), len(total))


def told(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Per row: 1, the largest marginal's logit, the log of one plus the marginals' sum."""
    return np.stack([np.ones(len(top)), top, np.log1p(total)], axis=1)


def summary(logits: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    top, total = np.full(n, _NONE), np.zeros(n)
    gathered(logits, rows, top, total)
    return told(top, total)


def copy_weights(docs: list[np.ndarray], hashes: int = 64) -> np.ndarray:
    """One over the size of each document's group of near copies, from least values of its word shingles: copies count once together."""
    rng = np.random.Generator(np.random.PCG64(91))
    odd = rng.integers(1, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(k: int, words: np.ndarray) -> np.ndarray:
        if not len(words):  # like no other
            return np.arange(hashes, dtype=np.uint64) + np.uint64((k + 1) * hashes)
        found, _ = shingles(words.astype(np.uint64), np.zeros(len(words), np.int64), 4)
        return mix(np.unique(found)[:, None] * odd).min(axis=0)

    least = np.array([sketch(k, d[:, 0]) for k, d in enumerate(docs)], np.uint64)
    root = np.arange(len(docs))
    for i in range(len(docs) - 1):
        for j in np.flatnonzero((least[i + 1 :] == least[i]).mean(axis=1) >= 0.5) + i + 1:
            if root[i] != root[j]:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return 1 / np.bincount(root, minlength=len(docs))[root]


def token_labels(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Buckets whose document counts separate toxic from clean documents (not those of none)."""
    size, heft = 1 << BITS, copy_weights(docs)
    hit, miss = np.zeros(size), np.zeros(size)
    for d, y, w in zip(docs, toxic, heft, strict=True):
        (hit if y else miss)[np.unique(d)] += w
    nt, nc = max(heft[toxic == 1].sum(), 1), max(heft[toxic == 0].sum(), 1)
    share = (hit + miss) / (nt + nc)

    def part(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)), 0)

    ratio = 2 * (part(hit, nt * share) + part(miss, nc * share) + part(nt - hit, nt * (1 - share)) + part(nc - miss, nc * (1 - share)))
    marked = (ratio > SEPARATES) & (hit / nt > MORE_OFTEN * miss / nc) & (hit >= 3)
    marked[0] = False
    return marked


def train(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray, steps: int = 40, rate: float = 0.3, decay: float = 1e-6) -> Field:
    """Fits the field to token labels, then calibrates document scores. docs: buckets (a row a token) and chain heads of each; weight: of each document, to undo a stratified sample."""
    size = 1 << BITS
    field = Field(np.zeros(size), np.zeros(size), np.zeros(size), -4.0, np.zeros((2, 2)), np.array([-40.0, 0.0, 0.0]))
    if not len(docs) or toxic.min() == toxic.max():
        return field
    marked = token_labels([d[0] for d in docs], toxic)
    buckets = np.concatenate([d[0] for d in docs])
    rows = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
    base = np.cumsum([0, *(len(d[0]) for d in docs)])[:-1]
    chains = np.concatenate([d[1] + b for d, b in zip(docs, base, strict=True)]).astype(np.int64)
    t = Tokens(np.zeros(0), np.zeros(0), rows, buckets, chains)
    y = marked[buckets].any(axis=1) & (toxic[rows] == 1)
    inner = np.ones(len(buckets), bool)
    inner[chains] = False
    follow = np.flatnonzero(inner)
    seen = np.bincount(2 * y[follow - 1] + y[follow], minlength=4).astype(float)
    n, word = max(int(y.sum()), 1), buckets[:, 0]
    parts = [field.here, field.before, field.after, np.array([field.bias]), field.moves.ravel()]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        field.bias, field.moves = float(parts[3][0]), parts[4].reshape(2, 2)
        logits, held = field.marginals(t)
        error = (_sigmoid(logits) - y) / n
        k, p = field.pairs(t, held)
        here = sum(np.bincount(b, error, size) for b in buckets.T)
        here[0] = 0
        grads = [here, np.bincount(word[k - 1], error[k], size), np.bincount(word[k], error[k - 1], size), np.array([error.sum()]), (p.sum(axis=0) - seen) / n]
        for i, g in enumerate(grads):
            g = g + decay * parts[i] * (i != 3)
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            parts[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-10) * (0.3 if i in (1, 2) else 1)
    field.bias, field.moves = float(parts[3][0]), parts[4].reshape(2, 2).copy()
    logits, _ = field.marginals(t)
    x, c = summary(logits, rows, len(docs)), np.zeros(3)
    heft = weight / weight.sum()
    for _ in range(50):  # Newton's method with a small ridge
        p = _sigmoid(x @ c)
        g = x.T @ (heft * (p - toxic)) + 1e-4 * c
        h = (x * (heft * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        c = c - np.clip(np.linalg.solve(h, g), -2, 2)
    field.calibration = c
    return field


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST_TOKENS) -> Field:
    """Fits on at most ``sample`` labelled documents with ``most`` tokens, half of them toxic if there are as many."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {int(r["toxic"] == 1): r["n"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pick = lambda y: known.where((F.col("toxic") == 1) == F.lit(bool(y))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
    chosen = pick(1).unionAll(pick(0))  # ids and labels only: `sample` rows bound the broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                t = tokens(data, offsets)
                cut, heads = np.searchsorted(t.rows, np.arange(end - first + 1)), t.chains
                split = np.searchsorted(heads, cut)
                spans = list(zip(cut[:-1], cut[1:], split[:-1], split[1:], strict=True))
                buckets = pa.array([t.buckets[a:b].tobytes() for a, b, _, _ in spans], pa.binary())
                chains = pa.array([(heads[x:y] - a).astype(np.int32).tobytes() for a, _, x, y in spans], pa.binary())
                own = [batch.column(k).slice(first, end - first) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, buckets, chains], ["doc_id", "toxic", "buckets", "chains"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    held = Tables(docs.sparkSession)
    cut_up = held.add(joined.mapInArrow(run, "doc_id long, toxic int, buckets binary, chains binary"))
    each = 4 * (1 + len(BEGINNINGS))
    sizes = cut_up.select("doc_id", (F.length("buckets") / each).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # `sample` rows
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most, side="right"))
    if fits < len(sizes):
        cut_up = cut_up.where(F.col("doc_id").isin([r["doc_id"] for r in sizes[:fits]]))
    got = cut_up.toArrow().sort_by("doc_id")
    held.clear()
    said = zip(got["buckets"].to_pylist(), got["chains"].to_pylist(), strict=True)
    rows = [(np.frombuffer(b, np.int32).reshape(-1, 1 + len(BEGINNINGS)), np.frombuffer(c, np.int32).astype(np.int64)) for b, c in said]
    toxic = (got["toxic"].to_numpy() == 1).astype(np.int64)
    have = np.bincount(toxic, minlength=2)
    weight = np.array([totals.get(int(y), 1) / max(have[y], 1) for y in toxic])
    return train(rows, toxic, weight)


SCORES = "doc_id long, score double, spans array<struct<start:long,end:long>>"


def _spans(data: np.ndarray, offsets: np.ndarray, t: Tokens, logits: np.ndarray, before: int, spans: list[list[dict]]) -> None:
    """Appends the runs of toxic tokens of each row, in code points after ``before``."""
    hot = np.flatnonzero(logits >= 0)
    if not len(hot):
        return
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    point = lambda at: int(at - np.searchsorted(inner, at))
    for run in np.split(hot, np.flatnonzero((np.diff(hot) > 1) | (t.rows[hot[1:]] != t.rows[hot[:-1]])) + 1):
        row = int(t.rows[run[0]])
        zero = point(offsets[row]) - before
        spans[row].append({"start": point(t.starts[run[0]]) - zero, "end": point(t.ends[run[-1]]) - zero})


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and toxic spans of every document; the field has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        model = shared.value
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                n = end - first
                top, total, spans = np.full(n, _NONE), np.zeros(n), [[] for _ in range(n)]
                points = 0  # code points of the pieces before this one; only a text that is alone has several
                for part, cuts, rows, _ in pieces(data, offsets, _STOP, _SOLID):
                    t = tokens(part, cuts)
                    logits, _ = model.marginals(t)
                    gathered(logits, rows[t.rows], top, total)
                    _spans(part, cuts, t, logits, points, spans)
                    points += len(part) - np.count_nonzero((part & 0xC0) == 0x80) if n == 1 else 0
                scores = np.round(_sigmoid(told(top, total) @ model.calibration), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(scores), pa.array(spans, pa.list_(kind))], ["doc_id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SCORES)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: labels of held-out ids are never read into the fit."""
    field = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return score(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), told.alias("spans"))
