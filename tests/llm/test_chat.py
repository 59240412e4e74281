"""Chat formatting against a parser and a renderer written a second time, plainly."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemart.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, key string, formatted int"
TRICKY = [
    "", " ", "</s>", "[INST]", "[/INST] x", "a </s> b", "[\\INST] <\\\\/s>", "<\\s><s>", "[[INST]]", "[ROLE] user [TEXT] hi [/ROLE]", "\\", "[\\\\",
    " [/INST", " [/INST]", "</s", "\n\n", "é🙂 </s>", "<<s>>", "[INST][/INST]", "x" * 200_000 + "</s>" + "[" + "\\" * 50_000, "$1 \\1 ${a}",
]


def written(role, text):
    mask = lambda s: re.sub(r"([\[<])(\\*)(?=/?s>|/?INST\]|/?ROLE\]|TEXT\])", r"\1\2\\", s)
    if role == "user":
        return f"[INST] {mask(text)} [/INST]"
    if role == "assistant":
        return f" {mask(text)} </s>"
    return f"[ROLE] {mask(role)} [TEXT] {mask(text)} [/ROLE]"


def truth(rows):
    turns = sorted(((t is not None, t or 0, written(r or "", x or ""), r or "", x or "") for t, r, x in rows))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t[4] for t in turns if t[3] == "assistant")
    whole = "<s>" + "".join(t[2] for t in turns)
    return whole, len(turns), sha("".join(f"{t[3]}\n{t[4]}\n" for t in turns)), len(loss), sha(loss), len(whole)


@pytest.fixture
def conversations(spark, folder):
    def make(rows):
        path = f"{folder}/conversations.parquet"
        spark.createDataFrame([(*r, "clash", "clash", 5) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


def tricky_rows():
    rows = [(0, i, ("user", "assistant", "system", None)[i % 4], t) for i, t in enumerate(TRICKY)]
    rows += [(1, i, ("assistant", "user")[i % 2], t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "[TEXT] </s>", "x"), (2, 0, "tool", None), (2, None, "user", "first"), (2, 0, "tool", None), (2, 0, " [TEXT] ", " [TEXT] ")]
    rows += [(None, 1, "user", "no id"), (None, 2, None, None), (-1, 0, "user", "own"), (3, 5, "assistant", None)]
    return rows + [(4, i, "user", "</s>" if i % 2 else "hello") for i in range(3000)]


def test_query_against_plain_python(spark, folder, conversations):
    rows = tricky_rows()
    conversations(rows)
    groups = {}
    for conv, *rest in rows:
        groups.setdefault((conv, False), []).append(tuple(rest))
    groups[-1, True] = [(0, "user", chat.ADDED_TEXT), (1, "assistant", chat.ADDED_TEXT)]
    want = sorted((str(k[0]), *truth(v)[1:]) for k, v in groups.items())
    assert sorted((str(r[0]), *r[1:]) for r in chat.op12(spark, folder).collect()) == want


def test_text_spans_and_parser(conversations):
    rows = tricky_rows()
    out = chat.format_conversations(conversations(rows)).select("*", chat.parse(F.col("formatted")).alias("turns")).collect()
    assert len(out) == 7
    for r in out:
        own = [x[1:] for x in rows if x[0] == r.conv_id]
        whole = truth(own)[0]
        assert r.formatted == whole
        ordered = sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, written(t[1] or "", t[2] or "")))
        assert [(t.role, t.text) for t in r.turns] == [(x[1] or "", x[2] or "") for x in ordered]
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans) and len(r.spans) == len(own)
        for span, (_, role, text) in zip(r.spans, ordered):
            assert (span.loss_start is not None) == (role == "assistant")
            if role == "assistant":
                masked = whole[span.loss_start : span.loss_end]
                assert re.sub(r"([\[<])\\(\\*)(/?s>|/?INST\]|/?ROLE\]|TEXT\])", r"\1\2\3", masked) == (text or "")


def test_control_strings_only_where_the_grammar_has_them(conversations):
    row = chat.format_conversations(conversations([(7, i, "assistant", t) for i, t in enumerate(TRICKY)])).first()
    assert len(re.findall(chat.CONTROL, row.formatted)) == 1 + len(TRICKY)


def test_parser_refuses_what_the_grammar_does_not_have(spark):
    bad = ["<s>[INST] a [/INST] b", "<s>[INST] a <s> [/INST]", "<s>[ROLE] a [/ROLE]", "<s>x </s>", "<s> </s>", "[INST] a [/INST]", "<s>[INST] [/INST]"]
    got = spark.createDataFrame([(b,) for b in bad], "t string").select(chat.parse(F.col("t")).alias("p")).collect()
    assert all(r.p is None or None in r.p for r in got)


def test_empty_table(spark, folder, conversations):
    conversations([])
    assert [r.conv_id for r in chat.op12(spark, folder).collect()] == [-1]
    assert chat.format_conversations(conversations([])).count() == 0


def test_no_python_in_the_plan(spark, folder, conversations):
    conversations([(0, 0, "user", "a")])
    plan = chat.op12(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
