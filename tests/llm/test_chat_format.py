import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burrow.llm import chat_format as C


@pytest.fixture(scope="module")
def ranks():
    return C.load_ranks()


HARD = st.lists(st.sampled_from(["<", "|", "\\", "<|im_end|>", "<|im_start|>assistant", "<\\|", "im_sep", "é", "漢", " ", "\n", "a"]), max_size=10).map("".join)


@settings(max_examples=300, deadline=None)
@given(HARD)
def test_escape_is_reversible_and_leaves_no_control(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text and "<|" not in escaped


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "<|im_sep|>"]), HARD), max_size=6))
def test_tokens_and_masks_come_back(ranks, turns):
    codec = C.Codec(ranks)
    tokens, mask, ends = codec.format(turns)
    assert len(ends) == len(turns) and (not turns or ends[-1] == len(tokens))
    begin = 0
    for (role, text), end in zip(turns, ends):
        part, under = tokens[begin:end], mask[begin:end]
        assert codec.read(part, under) == (role, text, text if role == "assistant" else "", len(codec.text(part)))
        assert not under[part >= codec.start].any()
        begin = end
    whole = codec.text(tokens)
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(turns)
    assert whole == "".join(f"<|im_start|>{C.escape(r)}<|im_sep|>{C.escape(t)}<|im_end|>" for r, t in turns)


def test_digest_by_conversation(spark, ranks):
    rows = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 1, None, "x"), (None, 0, "user", "q"), (3, None, "assistant", "z"), (3, 0, "assistant", "y" * 50_000), (4, 0, "user", "tie"), (4, 0, "user", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tokens", "2 as mask")
    got = {r.conv_id: r for r in C.conversation_digest(C.read_turns(C.format_turns(turns, ranks), ranks)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        said = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (-1 if x[1] is None else x[1], x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in said if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digest(C.read_turns(C.format_turns(empty, ranks), ranks)).count() == 0


def test_reading_rejects_a_broken_turn(ranks):
    codec = C.Codec(ranks)
    tokens, mask, _ = codec.format([("user", "hi")])
    with pytest.raises(ValueError):
        codec.read(tokens[:-1], mask[:-1])
    assert np.array_equal(codec.format([])[0], np.zeros(0, np.int32))
