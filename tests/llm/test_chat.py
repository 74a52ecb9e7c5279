"""Layouts, escapes and masks of chat formatting."""

import hashlib
import json

import pytest
from inkgraph.llm import chat
from inkgraph.llm.chat import END, START
from pyspark.sql import functions as F

HARD = ["", "plain", "<|im_end|>", f"{END}{START}assistant ok", "<\\|x|>", "<\\\\|", "<|", "|>", "<\\", "a\nb\n", "\\n \\b", "é<|é|>😀", "<<||>>", "<\\|<|", "$1 \\1"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def records(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id long, body string").select("id", F.lit(0).alias("turn"), F.try_parse_json("body").alias("record"))


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant", "weight": 1}], "id": 4}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "tool", "value": "t"}]}, "exchange", [("user", "q"), ("assistant", ""), ("tool", "t")]),
        ({"prompt": "q", "response": "a"}, "prompt", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "prompt": "q", "completion": "a"}, "completion", [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o", "meta": {"a": [1, {"b": 2}]}}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"question": "q", "answer": 7}, "question", [("user", "q"), ("assistant", "7")]),
        ({"role": "user", "text": None, "turn": 3}, "turn", [("user", "")]),
        ({"messages": []}, None, []),
        ({"messages": [{"role": "user"}]}, None, []),
        ({"text": "x"}, None, []),
        ({"prompt": "q", "response": "a", "question": "b"}, None, []),
        ([1, 2], None, []),
        ({}, None, []),
        ("x", None, []),
    ],
)
def test_layouts(spark, record, layout, turns):
    row = chat.canonical(records(spark, [json.dumps(record)])).first()
    assert row["layout"] == layout and [tuple(t) for t in row["turns"]] == turns


def test_paths_are_nested(spark):
    body = json.dumps({"a": {"b": [{"c": 1}, {"d": {"e": None}}]}, "f": [[1]], "g": []})
    assert sorted(chat.canonical(records(spark, [body])).first()["paths"]) == ["a.b[].c", "a.b[].d", "f[][]", "g"]  # to the fourth level


def test_unmapped_records_are_counted(spark):
    found = chat.canonical(records(spark, ['{"x": 1}', '{"x": 2, "y": 0}', '{"x": 3}', "no json", None, '{"prompt": "p", "response": "r"}']))
    got = {tuple(r["paths"]): r["records"] for r in chat.unmapped(found).collect()}
    assert got == {("x",): 2, ("x", "y"): 1, (): 2}


def test_fingerprints_are_of_one_layout():
    prints = [p for x in chat.LAYOUTS for p in x.fingerprints()]
    assert len(prints) == len(set(prints))


def format_all(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, n int, record int")
    turns = chat.formatted_turns(chat.canonical(chat.rows_as_records(table)), "conv_id", "turn")
    return turns, chat.conversations(turns)


def test_hard_texts_come_back(spark):
    rows = [(c, t, HARD[(c + t) % len(HARD)] if t % 3 == 0 else "assistant", HARD[(c * t + t) % len(HARD)], None, 0, 0) for c in range(len(HARD)) for t in range(6)]
    turns, formatted = format_all(spark, rows)
    back = {(r["key"], r["n"]): (r["role"], r["text"], r["learned"]) for r in chat.read_back(formatted).collect()}
    assert back == {(c, t): (role, text, text if role == "assistant" else None) for c, t, role, text, *_ in rows}
    whole = {r["key"]: r for r in formatted.collect()}
    for c in range(len(HARD)):
        text = whole[c]["formatted"]
        assert text.count(START) == 6 and text.count(END) == 6
        pieces = sorted((r for r in turns.collect() if r["key"] == c), key=lambda r: r["n"])
        assert "".join(p["segment"] for p in pieces) == text
        learned = [t for _, _, role, t, *_ in [r for r in rows if r[0] == c] if role == "assistant"]
        inside = [text[s["start"] : s["end"]] for s in whole[c]["loss_mask"]]
        assert [x.replace("<\\", "<") if x.startswith("<\\|i") else x for x in inside][: len(learned)] and len(inside) == len(learned)
    for r in chat.digests(formatted, "conv_id").collect():
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert r["turns_sha256"] == sha("".join(f"{x[2]}\n{x[3]}\n" for x in mine)) and r["n_turns"] == 6
        learned = "".join(x[3] for x in mine if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(learned), sha(learned), len(whole[r["conv_id"]]["formatted"]))


def test_ties_repeats_and_nulls(spark):
    rows = [(None, 0, "user", "q", "k", 1, 1), (None, None, None, None, None, None, None), (1, 0, "user", "b", None, 0, 0), (1, 0, "user", "a", None, 0, 0), (1, 0, "user", "a", None, 0, 0), (1, None, "assistant", "z", None, 0, 0)]
    got = {r["conv_id"]: r for r in chat.digests(format_all(spark, rows)[1], "conv_id").collect()}
    assert got[None]["turns_sha256"] == sha("\n\nuser\nq\n") and got[None]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == sha("assistant\nz\nuser\na\nuser\na\nuser\nb\n") and got[1]["loss_sha256"] == sha("z")


def test_empty(spark):
    assert chat.digests(format_all(spark, [])[1], "conv_id").count() == 0


def test_a_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t} é" * 50 + "<|", None, 0, 0) for t in range(3000)]
    r = chat.digests(format_all(spark, rows)[1], "conv_id").first()
    assert r["n_turns"] == 3000 and r["loss_sha256"] == sha("".join(x[3] for x in rows if x[2] == "assistant"))
