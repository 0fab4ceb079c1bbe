"""Chat formatting at token level.

A turn becomes ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``. Role and
text are encoded separately as ordinary text, the reserved ids are spliced between
them, and the loss mask is the prefix sum of +1 where an assistant's text opens
and -1 where it closes. Control strings inside a role or text are escaped before
encoding: every ``<``, backslashes, ``|`` gets one backslash more, so the formatted
text never holds a control string that the template did not write, and taking one
backslash away restores the content.

Turns stay one row each, so no conversation is ever gathered into a row; readers
that need a whole conversation stream its turns in order.

Nulls: a null role or text is empty; rows with a null conversation form one
conversation; a null turn comes first. Rows that tie on the turn are ordered by
role, then text. Repeated rows are repeated turns.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits text before merging, and the control strings.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
ASSISTANT = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ordinary text by the given ranks; the reserved ids follow the largest rank after one free id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2
        self.start, self.sep, self.end = first, first + 1, first + 2

    def format(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens of the turns, their loss mask, and where each turn ends."""
        segments = self.encoding.encode_ordinary_batch([escape(x) for turn in turns for x in turn], num_threads=1)
        sizes = np.array([len(x) for x in segments], np.int64)
        lengths = sizes.reshape(-1, 2).sum(axis=1) + 3
        ends = np.cumsum(lengths)
        starts, total = ends - lengths, int(lengths.sum())
        tokens, steps = np.empty(total, np.int32), np.zeros(total + 1, np.int8)
        held = np.ones(len(tokens), bool)
        for at, token in ((starts, self.start), (starts + 1 + sizes[::2], self.sep), (ends - 1, self.end)):
            tokens[at], held[at] = token, False
        tokens[held] = np.fromiter((t for x in segments for t in x), np.int32, int(sizes.sum()))
        for k, (role, _) in enumerate(turns):
            if role == ASSISTANT:
                steps[starts[k] + 2 + sizes[2 * k]] += 1
                steps[ends[k] - 1] -= 1
        return tokens, np.cumsum(steps[:-1], dtype=np.int8).astype(np.uint8), ends

    def text(self, tokens: np.ndarray) -> str:
        """The formatted text, control strings included."""
        out, names = [], dict(zip((self.start, self.sep, self.end), CONTROLS, strict=True))
        at = np.flatnonzero(tokens >= self.start)
        begin = 0
        for k in at:
            out += [self._ordinary(tokens[begin:k]), names[int(tokens[k])]]
            begin = k + 1
        return "".join([*out, self._ordinary(tokens[begin:])])

    def _ordinary(self, tokens: np.ndarray) -> str:
        return self.encoding.decode_bytes(tokens.tolist()).decode("utf-8")

    def read(self, tokens: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the mask, and the formatted length of one turn's tokens."""
        (sep,) = np.flatnonzero(tokens == self.sep)
        if tokens[0] != self.start or tokens[-1] != self.end:
            raise ValueError("a turn must begin and end with its reserved ids")
        role, text = self._ordinary(tokens[1:sep]), self._ordinary(tokens[sep + 1 : -1])
        lost = tokens[mask.astype(bool)]
        return unescape(role), unescape(text), unescape(self._ordinary(lost)), len(role) + len(text) + sum(map(len, CONTROLS))


FORMATTED = "conv_id long, turn long, tokens binary, mask binary"


def format_turns(turns: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Each row's turn as reserved and ordinary ids (int32) with its loss mask (one byte a token). ``ranks`` is a tokenizer's fixed vocabulary."""
    shared = turns.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                said = [(r or "", t or "") for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                tokens, mask, ends = codec.format(said)
                cut = np.r_[0, ends]
                rows = [(tokens[a:b].tobytes(), mask[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["conv_id", "turn", "tokens", "mask"])

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, FORMATTED)


READ = "conv_id long, turn long, role string, text string, loss string, formatted_chars long"


def read_turns(formatted: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """What ``format_turns`` wrote, read back from the tokens and masks alone; ``loss`` is null without a loss mask."""
    shared = formatted.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [codec.read(np.frombuffer(t, np.int32), np.frombuffer(m, np.uint8)) for t, m in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)] + [pa.array([r[3] for r in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["conv_id", "turn", "role", "text", "loss", "formatted_chars"])

    return formatted.select("conv_id", "turn", "tokens", "mask").mapInArrow(run, READ)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digest(read: DataFrame) -> DataFrame:
    """One row per conversation. Its turns arrive sorted and are hashed as they pass, so memory doesn't grow with a conversation; only this hash is sequential."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, _, role, text, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += size
            if out:
                yield _digests(out)
                out = []
        if now is not None:
            yield _digests([now])

    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, DIGEST)


def _digests(rows: list[list]) -> pa.RecordBatch:
    columns = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in c] for c in zip(*rows, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])
