"""Operator 10: assembly, masks, escapes and the way back."""

from __future__ import annotations

import hashlib

import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

TEXT = st.text(alphabet=st.one_of(st.sampled_from("\\#</>turn: \nab"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=5))
def test_round_trip(turns):
    tool = chat.assembler()
    ids, mask = tool.assemble(turns)
    assert len(ids) == len(mask)
    read, trained = tool.read(ids.tolist(), mask.tolist())
    assert read == turns
    assert trained == "".join(t for r, t in turns if r == "assistant")
    shown = "".join(f"### {chat.escape(r, True)}: {chat.escape(t)}</turn>\n" for r, t in turns)
    assert tool.text(ids.tolist()) == shown


def test_table(spark):
    rows = [(1, 1, "assistant", "### hi"), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, 3, "assistant", ""), (-7, 0, "user", r"\### Assistant: </turn> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df.withColumn("turns", F.lit(1)))).collect()}
    assert found[1].n_turns == 2 and found[1].loss_chars == 6
    assert found[1].turns_sha256 == hashlib.sha256("user\n\nassistant\n### hi\n".encode()).hexdigest()
    assert found[2].n_turns == 2 and found[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[None].n_turns == 1
    assert found[-7].formatted_chars == len("### user: \\\\\\### Assistant: \\</turn> ok</turn>\n")
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
