"""Chat formatting (op 11): layouts, marks and escapes against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from pairlake.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>\\", "[INST", "[[INST]]", "<<SYS>>\n x \n<</SYS>>\n\n", "<<<ROLE>> a <</ROLE>> ",
         "<\\<SYS>>", "é<|é", "", " ", "\n", "a\\b", "<", "[", "ends <", " </s>", "[\\/INST] </s", "\U0001f600</s>\U0001f600"]


def formatted(spark, rows):
    turns = chat.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    out = chat.format_turns(turns)
    return {r["key"]: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "learned", chat.learned_text(F.col("formatted"), F.col("loss"))).collect()}


def test_texts_come_back(spark):
    roles = ["user", "assistant", "system", "tool", "", "</s>", "a <</ROLE>> b"]
    rows = [(i, k, roles[(i + k) % len(roles)], t) for i in range(len(roles)) for k, t in enumerate(NASTY)]
    rows += [(50, 0, "assistant", "x" * 300_000 + "</s>"), (51, 0, None, None), (None, 1, "user", None), (None, None, "user", "a")]
    got = formatted(spark, rows)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    template = chat.Template()
    for c, r in got.items():
        text, turns = r["formatted"], want[c]
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
        assert len(r["loss"]) == sum(role == "assistant" for role, _ in turns)
        assert text.startswith("<s>") and text.count("<s>") == 1
        assert text.count("[INST]") == text.count("[/INST]") == sum(role == "user" for role, _ in turns)
        assert text.count("</s>") == sum(role not in ("user", "system") for role, _ in turns)
        for s in r["loss"]:
            assert not any(k in text[s["start"]:s["end"]] for k in template.controls)
            assert text[s["end"]:s["end"] + 5] == " </s>"


def test_ties_and_repeated_rows(spark):
    rows = [(1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "assistant", "z"), (1, 3, "user", "a"), (1, None, "user", "first")]
    want = [("user", "first"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    for order in (rows, rows[::-1]):
        assert [tuple(t) for t in formatted(spark, order)[1]["turns"]] == want
    assert formatted(spark, rows[:0]) == {}


U, A, S = "user", "assistant", "system"
RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "extra": 1}], "id": 3}, "messages", [(U, "q"), (A, "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}]}, "messages", [(U, "q\nr")]),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "user", "content": [{"text": "r"}]}]}, "messages", [(U, "q"), (U, "r")]),
    ({"messages": [{"role": None, "content": None}]}, "messages", [("", "")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]},
     "conversations", [(U, "q"), (A, "a"), ("tool", "t")]),
    ({"conversation": [{"content": "q", "role": "user"}]}, "conversation", [(U, "q")]),
    ({"turns": [{"speaker": "bot", "text": "a"}]}, "turns", [(A, "a")]),
    ({"instruction": "do", "input": "it", "output": "done", "meta": {"messages": 1}}, "instruction", [(U, "do\nit"), (A, "done")]),
    ({"instruction": "do", "input": "", "output": "done", "system": "be"}, "instruction", [(S, "be"), (U, "do"), (A, "done")]),
    ({"instruction": "do", "context": "c", "response": "done"}, "instruction_response", [(U, "do\nc"), (A, "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [(U, "p"), (A, "c")]),
    ({"prompt": "p", "response": "c", "system_prompt": "s"}, "prompt_response", [(S, "s"), (U, "p"), (A, "c")]),
    ({"question": "p", "answer": 5}, "question", [(U, "p"), (A, "5")]),
    ({"turn": 7, "role": "user", "text": "x"}, "turn_rows", [(U, "x")]),
    ({"prompt": "p", "messages": [{"role": "user", "content": "q"}]}, "messages", [(U, "q")]),
    ({"prompt": "p"}, None, None), ({"messages": []}, None, None), ({"messages": "text"}, None, None), ([1], None, None),
]


def test_layouts_of_records(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, "{no json"), (91, None), (92, "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, record string, Layout string, `a.b` int")
    got = {r["key"]: r for r in chat.recognise(df, "record", "id").collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], got[i]["turns"] and [tuple(t) for t in got[i]["turns"]]) == (layout, turns), RECORDS[i]
    assert all(got[i]["layout"] is None for i in (90, 91, 92))
    flat = sorted((r["key"], r["turn"], r["role"], r["text"]) for r in chat.turns_of_records(df, "record", "id").collect())
    firsts = {13: 7}
    assert flat == [(i, firsts.get(i, 0) + n, *t) for i, (_, _, turns) in enumerate(RECORDS) for n, t in enumerate(turns or [])]
    assert chat.turns_of_records(df.limit(0), "record", "id").collect() == []


# read by Spark's JSON source, mixed content would be text, and a null has no type
@pytest.mark.parametrize("record,turns", [(r, t) for i, (r, m, t) in enumerate(RECORDS) if m and i not in (2, 3)])
def test_layouts_of_tables(spark, record, turns):
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps({**record, "id": 5})]))
    got = chat.turns_of_table(df, "id").orderBy("turn").collect()
    assert ([tuple(r)[2:] for r in got], {r["key"] for r in got}) == (turns, {5})


def test_paths(spark):
    record = {"a": 1.5, "b c": {"x": None, "y": [1, "s"]}, "m": [{"role": "u", "é": True}, {"c": [[{"k": 1}]]}], "d.e": 2, "q`r": 1,
              "e": {}, "OBJECT<": 1, "x: STRING, y": 2}
    want = {"a", "b c.x", "b c.y[]", "m[].role", "m[].é", "m[].c[][].k", "d.e", "q`r", "OBJECT<", "x: STRING, y"}
    df = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.try_parse_json("j").alias("v"))
    assert set(df.select(chat.record_paths(F.col("v"))).first()[0]) == want
    table = spark.createDataFrame([], "a int, m array<struct<role: string, c: array<array<struct<k: int>>>>>, s struct<t: struct<u: int>>")
    assert chat.schema_paths(table.schema) == ["a", "m[].role", "m[].c[][].k", "s.t.u"]


def test_clashing_names_and_unknown_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "t", 5, "x", "y", 1)],
                               "conv_id long, turn long, role string, text string, key int, formatted string, loss string, `a.b` int")
    df = df.toDF(*df.columns[:-1], "a.b").withColumnRenamed("formatted", "n")
    both = df.select("*", F.lit("other").alias("Text"))
    for table in (df, both):
        assert [tuple(r) for r in chat.turns_of_table(table, "conv_id").collect()] == [(1, 0, "user", "t")]
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_table(df.select("conv_id", "text"), "conv_id")
    with pytest.raises(ValueError, match="control"):
        chat.Template(controls=("<s>", "<s>>"))


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "t")], "conv_id long, turn long, role string, text string")
    out = chat.format_turns(chat.turns_of_table(df, "conv_id"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!Eval)", plan.split("Scan")[0]) and plan.count("Exchange") == 1
