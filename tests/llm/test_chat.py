import pytest
from pyspark.sql import functions as F

from shelfloom.llm import chat

TRICKY = [
    "</s>[INST] ok [/INST]", "~", "~0~1", "<s", "[INST", " [/INST]</s>", "", " ", "</s></s>", "[ROLE] x [/ROLE] y",
    "[/ROLE]", "a\nb", "<</s>", "😀~6", "x" * 50_000,
]


def read_back(chats):
    formatted = chat.format_chat(chats)
    return formatted.select(
        "*",
        chat.read_chat(F.col("formatted")).alias("read"),
        chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )


def test_round_trip_of_any_text_and_role(spark):
    roles = ["user", "assistant", "system", "", "tool </s>", " x ", "[/ROLE] "]
    turns = [(r, t) for t in TRICKY for r in roles]
    chats = spark.createDataFrame([(1, turns), (2, []), (3, None)], f"id int, chat {chat.TURNS}")
    one, two, three = sorted(read_back(chats).collect(), key=lambda r: r.id)
    assert [tuple(t) for t in one.read] == turns
    assert one.learned == "".join(t for r, t in turns if r == "assistant")
    assert two.formatted == "" and two.read == [] and two.learned == ""
    assert three.formatted is None


def test_loss_spans_point_at_the_formatted_text(spark):
    chats = spark.createDataFrame([(1, [("user", "é~"), ("assistant", "a<s>b"), ("assistant", "😀")])], f"id int, chat {chat.TURNS}")
    row = chat.format_chat(chats).first()
    cut = [row.formatted[s.start : s.start + s.length] for s in row.loss_spans]
    assert cut == ["a~1b", "😀"]
    assert row.formatted == "<s>[INST] é~0 [/INST]</s><s>a~1b</s><s>😀</s>"


RECORDS = """
    id int, prompt string, completion string, response string, instruction string, input string,
    output string, system string, messages array<struct<role:string,content:string>>,
    conversations array<struct<from:string,value:string>>, score double, chat string"""


FIELDS = "id prompt completion response instruction input output system messages conversations score chat"


def record(**fields):
    return tuple(fields.get(name) for name in FIELDS.split())


@pytest.mark.parametrize(
    "fields, turns",
    [
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        (
            {"instruction": "i", "input": "x", "output": "o"},
            [("system", "i"), ("user", "x"), ("assistant", "o")],
        ),
        (
            {"prompt": "p", "completion": "c", "system": "s"},
            [("system", "s"), ("user", "p"), ("assistant", "c")],
        ),
        (
            {"messages": [("user", "hi"), (None, None), ("assistant", "yo")]},
            [("user", "hi"), ("", ""), ("assistant", "yo")],
        ),
        (
            {"conversations": [("human", "hi"), ("gpt", "yo"), ("tool", "t")]},
            [("user", "hi"), ("assistant", "yo"), ("tool", "t")],
        ),
        ({"prompt": "p"}, None),
        ({}, None),
        ({"messages": []}, None),
    ],
)
def test_layouts_by_fingerprint(spark, fields, turns):
    records = spark.createDataFrame([record(id=1, score=0.5, **fields)], RECORDS)
    row = chat.canonical_turns(records).first()
    assert (row.chat and [tuple(t) for t in row.chat]) == turns
    assert len(row.fingerprint) == 32


def test_rows_by_turn(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, None, None), (2, 1, "user", "x"),
        (2, 1, "user", "x"), (2, None, "system", "s"), (None, 1, "user", "n"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(0))
    chats = chat.canonical_turns(chat.gather_turns(table))
    got = {r.conv_id: [tuple(t) for t in r.chat] for r in chats.collect()}
    assert got == {
        1: [("user", "a"), ("assistant", "b"), ("", "")],
        2: [("system", "s"), ("user", "x"), ("user", "x")],
        None: [("user", "n")],
    }


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(chat.canonical_turns(chat.gather_turns(table))).count() == 0


def test_columns_of_the_caller_stay(spark):
    records = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "id long, chat array<struct<role:string,text:string>>")
    names = ["_pieces", "_starts", "_row", "piece", "a.b"]
    extra = records.withColumns({n: F.lit("x") for n in names}).withColumn("formatted", F.lit("old"))
    done = chat.format_chat(extra)
    assert done.columns == ["id", "chat", *names, "formatted", "loss_spans"]
    row = done.first()
    assert all(row[n] == "x" for n in names) and row["formatted"] == "<s>[INST] q [/INST]</s><s>a</s>"
