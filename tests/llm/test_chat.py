import pytest
from pyspark.sql import functions as F

from quern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def first_roles(df, model=None):
    return {(r["conv_id"], r["turn"]): r["parsed"][0]["role"] for r in chat.parse_transcripts(df, model).collect()}


def test_held_out_accuracy_and_segments(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.train(rows.where("conv_id % 3 <> 0"))
    test = rows.where("conv_id % 3 = 0")
    found = first_roles(test, model)
    right = [found[r["conv_id"], r["turn"]] == r["role"] for r in test.collect()]
    assert sum(right) >= 0.93 * len(right)
    monkeypatch.setattr(chat, "SEGMENT_ROWS", 2)
    assert first_roles(test, model) == found


def test_viterbi_equals_brute_force(spark):
    import itertools

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat.train(rows)
    for texts in (["hello?", "Sure. " * 30, "thanks"], ["system: be kind", "hi\nAssistant: yes\nUser: no", "ok"]):
        features = [f for t in texts for f in chat.line_features(t)]
        scores = model.scores(features)

        def weight(path):
            total = model.begin[path[0]] + scores[0][path[0]]
            for i in range(1, len(path)):
                total += (model.step if features[i][4] else model.hold)[path[i - 1], path[i]] + scores[i][path[i]]
            return total

        best = max(itertools.product(range(3), repeat=len(features)), key=weight)
        assert weight(tuple(model.decode(features, model.begin))) == pytest.approx(weight(best))


def test_markers():
    assert chat.marker_of("User: hi") == (2, "hi") and chat.marker_of("### Assistant:") == (3, "") and chat.marker_of("<|system|> x") == (1, "x")
    assert chat.marker_of("note: hi") == (0, "note: hi") and chat.marker_of("**Human**: hi") == (2, "hi") and chat.marker_of("") == (0, "")


def test_one_text_with_several_turns(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.train(rows)
    text = "User: what is it?\nAssistant: a thing\nof two lines\nUser: thanks"
    out = chat.parse_transcripts(spark.createDataFrame([(1, 0, None, text)], SCHEMA), model)
    parsed = [(t["role"], t["content"]) for t in out.first()["parsed"]]
    assert parsed == [("user", "what is it?"), ("assistant", "a thing\nof two lines"), ("user", "thanks")]
    assert out.select(chat.rendered(F.col("parsed")).alias("x")).first()["x"].startswith("<|user|>\nwhat is it?\n<|end|>\n<|assistant|>\n")


def test_odd_rows(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, None, ""), (None, 0, "human", "x"), (None, None, None, None), (2, 5, "weird", "word " * 50_000), (2, -1, "bot", "\n\n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("c", F.lit(1)).withColumn("parsed", F.lit("x"))
    out = chat.parse_transcripts(df)
    assert out.count() == len(rows) and out.where("size(parsed) = 0").count() == 0
    assert chat.parse_transcripts(spark.createDataFrame([], SCHEMA)).count() == 0
    monkeypatch.setattr(chat, "SEGMENT_ROWS", 1)
    hot = spark.createDataFrame([(7, 0, "user", f"line {i}") for i in range(50)] + rows, SCHEMA)
    assert chat.parse_transcripts(hot).count() == 58
