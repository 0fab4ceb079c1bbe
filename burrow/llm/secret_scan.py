"""Secret scan by a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that
every match must contain. Documents are indexed in segments: a segment's postings
list, for each trigram that some rule asks for, the documents that hold it
(ASCII letters folded). The query is evaluated by intersecting and uniting
postings, and only the candidates are verified with the expression itself. A rule
from which no trigram follows (``hex``) reads every document.

Nulls: a null text is an empty text, a null id stays null. Repeated rows give
repeated results. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.llm.kernels import ascii_lower, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base kinds, in the order in which spans are listed, then further kinds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # runs are maximal, so the bound may stand in the expression
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A query is True (anything may match), a trigram, or ("and" | "or", frozenset of queries).
MOST = 16


def _both(a, b):
    if a is True:
        return b
    if b is True:
        return a
    parts = [x[1] if isinstance(x, tuple) and x[0] == "and" else {x} for x in (a, b)]
    return ("and", frozenset().union(*parts))


def _either(queries: Iterable):
    queries = set(queries)
    return True if True in queries or not queries else queries.pop() if len(queries) == 1 else ("or", frozenset(queries))


def _spelled(strings: Iterable[str]):
    """The query of a choice of strings, each of which must occur."""
    return _either(reduce(_both, (s[i : i + 3] for i in range(len(s) - 2)), True) for s in strings)


@dataclass
class _Part:
    """What a sub-expression can match: all strings, if few; else how they begin and end; and a query."""

    exact: set[str] | None
    head: set[str]
    tail: set[str]
    query: object = True


def _open(p: _Part) -> _Part:
    """Gives up the exact strings, keeping the trigrams in them."""
    if p.exact is None:
        return p
    return _Part(None, {s[:2] for s in p.exact}, {s[-2:] for s in p.exact}, _both(p.query, _spelled(p.exact)))


def _join(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Part({x + y for x in a.exact for y in b.exact}, set(), set())
    heads = {x + y for x in a.exact for y in (b.exact or b.head)} if a.exact is not None and len(a.exact) * len(b.exact or b.head) <= MOST else None
    tails = {x + y for y in b.exact for x in (a.exact or a.tail)} if b.exact is not None and len(b.exact) * len(a.exact or a.tail) <= MOST else None
    x, y = _open(a), _open(b)
    across = {s + t for s in x.tail for t in y.head} if len(x.tail) * len(y.head) <= MOST * MOST else {""}
    return _Part(None, {s[:2] for s in heads} if heads else x.head, {s[-2:] for s in tails} if tails else y.tail, _both(_both(x.query, y.query), _spelled(across)))


_ANY = lambda: _Part(None, {""}, {""})
_NIL = lambda: _Part({""}, set(), set())


def _class(items: list) -> _Part:
    letters: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL and value < 128:
            letters.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 2 * MOST and value[1] < 128:
            letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _ANY()
    return _Part(letters, set(), set()) if len(letters) <= MOST else _ANY()


def _walk(items: Iterable) -> _Part:
    out = _NIL()
    for kind, value in items:
        if kind is sre.LITERAL:
            part = _Part({chr(value).lower()}, set(), set()) if value < 128 else _ANY()
        elif kind is sre.IN:
            part = _class(value)
        elif kind is sre.AT:
            part = _NIL()
        elif kind is sre.SUBPATTERN:
            part = _walk(value[3])
        elif kind is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
                part = _Part(set().union(*(p.exact for p in parts)), set(), set())
            else:
                opened = [_open(p) for p in parts]
                part = _Part(None, set().union(*(p.head for p in opened)), set().union(*(p.tail for p in opened)), _either(p.query for p in opened))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _walk(inner)
            if (low, high) == (0, 1) and once.exact is not None and len(once.exact) < MOST:
                part = _Part(once.exact | {""}, set(), set())
            elif low == 0:
                part = _ANY()
            else:
                part = once
                for _ in range(min(low, 8) - 1):
                    part = _join(part, once)
                if (low, high) != (min(low, 8), min(low, 8)):
                    part = _open(part)
                    part = _Part(None, part.head, _open(once).tail, part.query) if once.exact is None or "" not in once.exact else _Part(None, {""}, {""}, part.query)
        else:
            part = _ANY()  # look-around, references, dots: nothing is known
        out = _join(out, part)
    return out


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every match of ``pattern`` satisfies."""
    return _open(_walk(parser.parse(pattern, re.ASCII))).query


def trigrams_of(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of one segment: for each trigram of the vocabulary, the sorted rows that hold it."""

    def __init__(self, vocabulary: list[str], table: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.rows = np.arange(len(offsets) - 1)
        low = ascii_lower(data).astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(table[codes])
        row = np.searchsorted(offsets, at, side="right") - 1
        whole = at + 3 <= offsets[row + 1]
        keys = np.unique(table[codes[at[whole]]].astype(np.int64) * len(offsets) + row[whole])
        ids, rows = keys // len(offsets), keys % len(offsets)
        cut = np.searchsorted(ids, np.arange(1, len(vocabulary) + 2))
        self.postings = {t: rows[cut[k] : cut[k + 1]] for k, t in enumerate(vocabulary)}

    def find(self, query) -> np.ndarray:
        if query is True:
            return self.rows
        if isinstance(query, str):
            return self.postings[query]
        found = sorted((self.find(q) for q in query[1]), key=len)
        if query[0] == "or":
            return reduce(np.union1d, found)
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), found)


class Scanner:
    def __init__(self, rules: Iterable[Rule] = RULES):
        self.rules = tuple(rules)
        self.queries = [trigram_query(r.pattern) for r in self.rules]
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in self.rules]
        self.vocabulary = sorted(set().union(*map(trigrams_of, self.queries)))
        self.table = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(self.vocabulary):
            a, b, c = t.encode("ascii")
            self.table[a << 16 | b << 8 | c] = k + 1

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], int]:
        """Per row the spans (start, rule, end) in order, and the number of (row, rule) pairs verified."""
        index = Index(self.vocabulary, self.table, data, offsets)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in index.rows]
        texts: dict[int, str] = {}
        verified = 0
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for row in index.find(query):
                verified += 1
                if (text := texts.get(row)) is None:
                    text = texts[row] = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
                for m in regex.finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        spans[row].append((m.start(), k, m.end()))
        for found in spans:
            found.sort()
        return spans, verified


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """One row per document with its spans by start, then by the rules' order (code points, end exclusive)."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                found, _ = scanner.scan(data, offsets)
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in row] for row in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``secret_spans``: counts of the base kinds, digest of their spans, all spans."""
    base = [r.kind for r in RULES if r.base]
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return secret_spans(docs).select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(told(of(*base)), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def brute_force(text: str | None, rules: Iterable[Rule] = RULES) -> str:
    """The same spans from the expressions alone, for tests."""
    found = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "", re.ASCII) if len(m[r.group]) >= r.least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def sql() -> str:
    """The same in DuckDB: the texts between matches give their places."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    found = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "(" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ")").replace("'", "''")
        found.append(rf"""SELECT r, {k} AS k, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, unnest(range(1, len(m) + 1)) AS i, m, g, string_split_regex(t, '{pattern}') AS parts, {rule.least} AS least
  FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g FROM d) WHERE len(m) > 0""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(found)}),
p AS (SELECT r, k, kind, base, length(array_to_string(parts[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s, length(m[i]) AS n FROM f WHERE length(g[i]) >= least),
a AS (SELECT r, {counts}, string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, k) AS spans, string_agg(concat(kind, ':', s, ':', s + n), ',' ORDER BY s, k) FILTER (WHERE base) AS told FROM p GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(told, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
