import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotline.llm import chat_format as cf

BITS = ["[INST] ", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n\n", "</s>", "<|role|>", "<|text|>", "<|end|>", "<|esc|>", "\\", "<", "[", " ", "\n", "a", "\\l", "é\U0001f600"]
text = st.lists(st.sampled_from(BITS), max_size=8).map("".join)
role = st.one_of(st.sampled_from(["user", "assistant", "system", ""]), text)


@given(st.lists(st.tuples(role, text), max_size=6))
def test_any_conversation_reads_back(turns):
    reader, got = cf.Reader(), []
    whole = "".join(cf.render(*t)[0] for t in turns)
    for k in range(0, len(whole), 1 << 20):
        got += reader.feed(whole[k : k + (1 << 20)])
    assert got == turns and not reader.rest and reader.chars == len(whole)


@given(role, text)
def test_span_is_the_content(r, t):
    out, a, b = cf.render(r, t)
    assert cf.unescape(out[a:b]) == t


@pytest.fixture
def rows():
    return [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>b"), (1, 1, "assistant", "a</s>b"), (2, None, None, None), (2, 3, "tool", "x"), (None, 0, "assistant", "y"), (3, 0, "user", "[INST] " * 5000)]


def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, position int, formatted string")
    got = {r.conv_id: r for r in cf.read_back(cf.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(turns) and g.loss_chars == len(loss) and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.formatted_chars == len("".join(cf.render(*t)[0] for t in turns))
    assert cf.read_back(cf.format_turns(df.limit(0))).count() == 0


def test_loss_spans(spark, rows):
    df = spark.createDataFrame(rows[:3], "conv_id long, turn long, role string, text string")
    out = sorted(cf.format_turns(df).collect(), key=lambda r: r.position)
    whole = "".join(r.formatted for r in out)
    assert [cf.unescape(whole[r.loss_start : r.loss_end]) for r in out if r.loss_start is not None] == ["a</s>b", "a</s>b"]


@pytest.mark.parametrize("wrong", ["loss_start + 1", "null"])
def test_a_wrong_mask_is_seen(spark, rows, wrong):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    bad = cf.format_turns(df).withColumn("loss_start", F.expr(f"cast(if(conv_id = 1, {wrong}, loss_start) as bigint)"))
    with pytest.raises(Exception, match="wrong loss mask"):
        cf.read_back(bad).collect()
