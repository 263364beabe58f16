import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evenhand.llm import chat


def test_controls_survive_a_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<\\s>", "[/\\INST]<", "", "a</s", "<s><s>", "[\\INST][INST]", "🙂</s>🙂"]
    turns = spark.createDataFrame([(k, n, "assistant", t) for k in range(3) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_chats(turns)).select("turns", "loss_texts", "formatted", "loss_mask").collect()
    for r in out:
        assert [t["text"] for t in r["turns"]] == texts and r["loss_texts"] == texts
        for span in r["loss_mask"]:  # the absolute place is that of the turn's text
            piece = r["formatted"].split(chat.TURN_END)[span["turn"]]
            assert r["formatted"][span["start"]:span["start"] + span["chars"]] == piece[span["start_in_turn"]:]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>/s[]INT\\a\n", max_size=12), min_size=1, max_size=20))
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"))).withColumn("back", chat.unescaped(F.col("e")))
    for r in df.collect():
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in chat.CONTROLS)


def test_records_choose_their_mapping(spark):
    said = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "other": 1},
        {"instruction": "q", "input": "more", "output": "a"}, {"instruction": "q", "output": "a"},
        {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"system": "s", "prompt": "q", "response": "a"},
        {"unknown": 1}, None,
        {"messages": [{"role": "system"}, {"role": "user", "content": "q"}, {"content": "a"}]}, {"messages": []},
        {"prompt": "q", "response": "a", "input": "extra"}, {"messages": "text"},
    ]
    rows = [(k, None if s is None else json.dumps(s)) for k, s in enumerate(said)] + [(99, "no json {")]
    records = spark.createDataFrame(rows, "conv_id long, record string")
    turns = chat.turns_of_records(records, unmapped="skip").orderBy("conv_id", "turn").collect()
    got = {}
    for t in turns:
        got.setdefault(t["conv_id"], []).append((t["role"], t["text"]))
    plain = [("user", "q"), ("assistant", "a")]
    assert got == {0: [("user", "q"), ("assistant", "")], 1: plain, 2: [("user", "q\n\nmore"), ("assistant", "a")], 3: plain, 4: plain, 5: plain,
                   6: [("system", "s"), *plain], 9: [("system", ""), ("user", "q"), ("", "a")]}
    # Every record either has its turns (none, for no messages) or is among the unmapped ones.
    left = {r["conv_id"]: r["found_paths"] for r in chat.unmapped_records(records).collect()}
    assert left == {7: "", 8: "", 99: "", 11: "input, prompt, response", 12: ""}
    assert set(got) | set(left) | {10} == {k for k, _ in rows}
    with pytest.raises(Exception, match="no mapping for the field paths .input, prompt, response"):
        chat.turns_of_records(records.filter("conv_id = 11")).collect()


def test_tables_choose_their_mapping(spark):
    flat = spark.createDataFrame([(1, "q", "a", "x")], "conv_id long, prompt string, response string, clash string")
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>")
    for df in (flat, nested):
        assert [(t["role"], t["text"]) for t in chat.turns_of_table(df).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(spark.createDataFrame([(1,)], "conv_id long"))


def test_odd_turns(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (1, None, "assistant", "first"), (1, 0, None, None)]
    turns = chat.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert len(out[None]["turns"]) == 2
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("assistant", "first"), ("", "")]
    assert chat.format_chats(turns.limit(0)).count() == 0
