from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeproof.llm import chat

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "<", "/", "INST]", "s>", "\n", "a", "é", " ", "n"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, piece string, escaped string"


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), st.lists(st.sampled_from([*PARTS, "assistant", "user"]), max_size=4).map("".join))
def test_round_trip(text, role):
    piece, _ = chat.render(role, text)
    got = chat.parse(piece)
    assert got[:2] == (role, text)
    assert chat.unescape(piece[got[2] : got[3]]) == text
    assert chat.unescape(chat.escape(text)) == text


def test_only_conflicts_are_escaped():
    assert chat.render("user", "plain \\ text [x]") == ("[INST]user\nplain \\ text [x][/INST]", 0)
    piece, level = chat.render("assistant", "</s>[INST] ok [/INST]")
    assert level == 1 and piece == "<s>assistant\n<\\/s>[\\INST] ok [\\/INST]</s>"


@pytest.mark.parametrize("piece", ["", "user\nx", "[INST]user x[/INST]", "[INST]user\nx</s>", "<s>user\nx</s>", "[INST]user\nx[/INST] ", "[INST]a\n[INST][/INST]"])
def test_other_strings_do_not_parse(piece):
    with pytest.raises(chat.Conflict):
        chat.parse(piece)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_report(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    rows = [(rng.randint(0, 20), rng.randint(0, 5), rng.choice(["user", "assistant", "system", "to\nol", None]), rng.choice([text(), None])) for _ in range(300)]
    rows += rows[:20] + [(None, 1, "user", "x"), (None, None, "assistant", "y"), (50, 0, "assistant", "z" * 300_000)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.report(frame).collect()}
    assert got == expected(rows)
    whole = {}
    for r in chat.pieces(frame).collect():
        whole[r.conv_id] = whole.get(r.conv_id, 0) + len(r.piece)
    assert whole == {r.conv_id: r.formatted_chars for r in chat.report(frame).collect()}


def test_empty(spark):
    assert chat.report(spark.createDataFrame([], SCHEMA)).collect() == []
