import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from tallygrain.llm import chat as C

PARTS = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<", "|", "\\", "im_end|>", "\n", "a", "é東", "assistant", "\\n", ""]
TEXT = st.lists(st.sampled_from(PARTS), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    rendered = "".join(C.render(r, t) for r, t in turns)
    assert C.read(rendered) == turns
    assert len(C.parse(rendered)) == len(turns)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text
    assert C.BEGIN not in C.escape(text) and C.END not in C.escape(text)


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\nhello", "<|im_start|>user\na<|im_end|>", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"])
def test_what_is_no_conversation(bad):
    assert C.parse(bad) is None


def test_harmless_text_is_not_touched():
    assert C.render("user", "a <b> | c \\ d") == "<|im_start|>user\na <b> | c \\ d<|im_end|>\n"


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, None, None), (2, 0, "assistant", C.PROBE_TEXT), (2, 0, "assistant", "aa"), (None, 0, "user", "x"), (3, None, "assistant", "é" * 50_000), (4, 5, "user", "t"), (4, 5, "user", "t")]
    table = spark.createDataFrame([(*r, "extra", "extra") for r in rows], "conv_id long, turn long, role string, text string, segment string, value string")
    got = {r["conv_id"]: r for r in C.conversation_digests(C.rendered_turns(table)).collect()}
    own = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == sum(len(C.render(r, x)) for r, x in turns)
    assert C.conversation_digests(C.rendered_turns(table.limit(0))).collect() == []
