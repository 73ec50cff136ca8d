"""Operator 2, by exact round trips."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lectern.llm.chat import FOREIGN, MARKS, escape, format_conversations, loss_mask, read_back, unescape
from lectern.llm.queries import op2_chat

P = pytest.importorskip("public_tokenizers")
PARTS = st.sampled_from([*MARKS, *FOREIGN, "\\", "<", "[", "|", ">", "a", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join) | st.text(max_size=30))
def test_escaping_is_reversible(text):
    out = escape(text)
    assert unescape(out) == text
    assert not any(s in out for s in (*MARKS, *FOREIGN))


def want(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r.conv_id, r.turn, r.role, r.text))):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    out = set()
    for conv, turns in convs.items():
        said = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        size = sum(len(escape(r)) + len(escape(t)) + sum(map(len, MARKS)) for r, t in turns)
        out.add((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), size))
    return out


def digests(df):
    return {tuple(r)[:6] for r in df.collect()}


def test_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string").collect()
    assert digests(op2_chat(spark, tiny)) == want(rows + extra)


def test_edges(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(None, 0, "user", "x"), (1, None, "assistant", None), (1, None, None, ""), (2, 1, "assistant", "b \\ <s>\U0001f600"), (2, 1, "assistant", "b \\ <s>\U0001f600"), (2, 0, "odd<|end|>role", " lead\n\n")]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} ") for k in range(500)]
    turns = spark.createDataFrame([(*r, 9, "z") for r in rows], "conv_id long, turn long, role string, text string, ids long, span string")
    pieces = format_conversations(turns, path, piece_ids=300)
    assert pieces.filter("conv_id = 3").count() > 5
    assert digests(read_back(pieces, path)) == want(turns.collect())
    assert format_conversations(turns.limit(0), path).count() == 0


def test_mask():
    assert loss_mask(6, [(1, 3), (0, 0), (5, 6)]).tolist() == [False, True, True, False, False, True]
