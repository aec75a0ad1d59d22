"""Chat formatting: every assistant turn once, texts back as they were, masks that cover just the reply; odd rows and long conversations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format as c

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\\", "<\\|im_start|>", "<|im_start|>system<|im_sep|>x<|im_end|>", "<<SYS>>", "<", "<|", "", None, "\n\n", "é\U0001f600" * 3, "[[INST]]", "a" * 200_000]
SCHEMA = "conv_id long, turn long, role string, text string, turns string, example string, formatted int"


def conversations():
    rows = [(i, k, ("user", "assistant")[k % 2], t) for i, t in enumerate(NASTY) for k in range(2)]
    rows += [(100, k, ("user", "assistant", "assistant", "system")[k % 4], NASTY[k % 13]) for k in range(120)]
    rows += [(101, 0, "user", "no reply"), (102, 0, None, None), (103, None, "assistant", "first"), (103, 5, "user", "x"), (104, 1, "assistant", "b"), (104, 1, "assistant", "a"), (104, 1, "assistant", "a"), (None, 1, "assistant", "nobody's"), (105, 9, "<|im_end|>", "odd role"), (105, 10, "assistant", "")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 7) for r in conversations()], SCHEMA)


def grouped():
    out = {}
    for i, k, role, text in conversations():
        out.setdefault(i, []).append((k is not None, k or 0, role or "", text or ""))
    return {i: [t[2:] for t in sorted(v)] for i, v in out.items()}


def test_prefixes_and_masks(table):
    found = {}
    for r in c.examples(table).withColumn("back", c.parse(F.col("formatted"))).collect():
        found.setdefault(r["conv_id"], []).append(r)
    want = grouped()
    assert found.keys() == want.keys()
    for i, turns in want.items():
        rows = sorted(found[i], key=lambda r: r["example"])
        ends = [k for k, t in enumerate(turns) if t[0] == "assistant" or k == len(turns) - 1]
        assert [r["example"] for r in rows] == list(range(len(ends))) and [r["whole"] for r in rows] == [k == len(turns) - 1 for k in ends]
        for r, k in zip(rows, ends, strict=True):
            assert [tuple(b) for b in r["back"]] == turns[: k + 1]
            if turns[k][0] != "assistant":
                assert r["loss_start"] is None and r["loss_end"] is None
                continue
            reply = r["formatted"][r["loss_start"] : r["loss_end"]]
            assert r["formatted"][r["loss_end"] :] == c.END and r["formatted"][: r["loss_start"]].endswith(f"{c.START}assistant{c.SEP}")
            assert not any(x in reply for x in c.CONTROL)


def test_read_back_loses_nothing(table):
    import hashlib

    want = grouped()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = c.read_back(c.examples(table)).collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = want[r["conv_id"]]
        replies = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(replies), sha(replies))


def test_no_rows(table):
    assert c.examples(table.limit(0)).collect() == [] and c.read_back(c.examples(table.limit(0))).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*c.CONTROL, "\\", "<", "|", "im_", "[", "/", ">", "s", " "]), max_size=12).map("".join), min_size=20, max_size=60))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.escape(F.col("t")).alias("e")).withColumn("back", c.unescape(F.col("e")))
    for r in df.collect():
        assert r["back"] == r["t"] and not any(x in r["e"] for x in c.CONTROL)
