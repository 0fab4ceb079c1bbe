"""Vectorised text kernels over Arrow batches: words, word hashes, shingles.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. All hashes are 64-bit and
depend only on the bytes, never on the process, so executors agree on them.

Memory: rows go in slices of at most ``SLICE`` bytes of text, or one document if it
alone is longer, and bytes are worked on in pieces of ``CHUNK`` of them, so that
beside the text itself a document takes some bytes a word and not some words a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = CHUNK = 256 << 10
_U = np.uint64
_STEP, _UNSTEP = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_ROLL = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, step, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


_kept = [_powers(step, CHUNK + 1) for step in (_STEP, _UNSTEP)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= CHUNK + 1:
        return _kept[0][:n], _kept[1][:n]
    return _powers(_STEP, n), _powers(_UNSTEP, n)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) for pieces of a binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each byte range, by differences of one prefix polynomial."""
    up, down = _power(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return mix(_sums(data, starts, ends))


def head_hashes(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes from each start."""
    total = np.zeros(len(starts), np.uint64)
    for k in range(n):
        total += _BYTE[data[starts + k]] * _kept[0][k]
    return mix(total)


def hashed_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of all words in order, from pieces of ``chunk`` bytes; ``fold``: of words in lower case.

    A word that reaches the end of a piece is held back until its end is seen, so that
    hashes don't depend on where pieces end.
    """
    held: tuple[np.uint64, int, int] | None = None  # polynomial, length, row
    for at in range(0, len(data), chunk):
        piece = data[at : at + chunk]
        piece = ascii_lower(piece) if fold else piece
        inner = offsets[np.searchsorted(offsets, at, side="right") : np.searchsorted(offsets, at + len(piece), side="left")] - at
        starts, ends, _ = words(piece, np.r_[0, inner, len(piece)])
        sums, sizes = _sums(piece, starts, ends), ends - starts
        rows = np.searchsorted(offsets, starts + at, side="right") - 1
        if held is not None:
            if len(starts) and starts[0] == 0 and rows[0] == held[2]:
                sums[0] = (int(held[0]) + pow(int(_STEP), held[1], 1 << 64) * int(sums[0])) & (1 << 64) - 1
                sizes[0] += held[1]
            else:
                sums, sizes, rows = np.r_[held[0], sums], np.r_[held[1], sizes], np.r_[held[2], rows]
            held = None
        if len(ends) and ends[-1] == len(piece) and at + chunk < len(data):
            held = sums[-1], int(sizes[-1]), int(rows[-1])
            sums, rows = sums[:-1], rows[:-1]
        yield mix(sums), rows


def all_words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words."""
    found = list(hashed_words(data, offsets, fold))
    if len(found) == 1:
        return found[0]
    return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(r for _, r in found)])


def pieces(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray, solid: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, starts within the rows) of texts; one over ``limit`` bytes comes in pieces.

    A piece ends after the last of the ``stops`` (a table of bytes) in its reach, else
    after the last byte that isn't ``solid``, else at ``limit``, so a text is cut alike
    wherever it stands.
    """
    n = len(offsets) - 1
    if n != 1 or len(data) <= limit:
        yield data, offsets, np.arange(n), np.zeros(n, np.int64)
        return
    at = 0
    while at < len(data):
        part = data[at : at + limit]
        if at + limit < len(data):
            for ends in (stops[part], ~solid[part]):
                if ends.any():
                    part = part[: int(np.flatnonzero(ends)[-1]) + 1]
                    break
        yield part, np.array([0, len(part)]), np.zeros(1, np.int64), np.array([at])
        at += len(part)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words; a row with fewer words has its whole sequence as one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = max(0, n - size + 1)
    total = np.zeros(full, np.uint64)
    for k in range(size):
        total += hashes[k : full + k] * _ROLL[k]
    inside = rows[:full] == rows[size - 1 :] if full else np.zeros(0, bool)
    out, at = mix(total[inside]), rows[:full][inside]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[first, n])
    if (few := counts < size).any():
        short = np.array([_sequence(hashes[i : i + c]) for i, c in zip(first[few], counts[few], strict=True)], np.uint64)
        out, at = np.concatenate([out, short]), np.concatenate([at, rows[first[few]]])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def _sequence(hashes: np.ndarray) -> np.uint64:
    salt = _ROLL[32 + len(hashes) % 31]
    return mix((hashes * _ROLL[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + salt)[0]


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in the sorted array ``rows``, and where the last ends."""
    return np.searchsorted(rows, np.arange(n + 1))
