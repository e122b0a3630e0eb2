"""Questions as a table: parsing on executors, bad answers as rows, the same choices as for a list."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuesift.pipeline import FrameSelector, Question
from cuesift.plans.parsing import RuleParser, StaticParser
from cuesift.plans.tree import Node

A, B, C = (Node.leaf("CLIP", x) for x in ("a", "b", "c"))
TREES = {"q0": Node.of("AND", A, B), "q1": Node.of("OR", A, Node.of("SEQ", B, C)), "q2": Node.of("RIGHT_AFTER", A, C), "q3": A}
VECTORS = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.3, 0.3, 0.9]}
COLUMNS = ["video_id", "qid", "rank", "frame_idx", "phase"]


@pytest.fixture(scope="module")
def grid(spark):
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("video_id"), F.expr("id div 3").cast("int").alias("frame_idx"))
    x = lambda k: F.abs(F.sin(F.col("frame_idx") * k + F.col("video_id")))
    return rows.withColumn("embedding", F.array(x(1.3), x(0.7), x(2.1)))


def features(grid):
    return {"CLIP": {"frames": grid, "queries": VECTORS}}


def as_set(df):
    return {(*(r[c] for c in COLUMNS), round(r.score, 9)) for r in df.where("rank is not null").collect()}


def test_same_choices_as_a_list(spark, grid):
    listed = [Question("q0", TREES["q0"]), Question("q1", TREES["q1"], 1), Question("q2", TREES["q2"], 2), Question("q3", TREES["q3"]), Question("q1", TREES["q1"], 0)]
    rows = [(q.qid, q.tree.to_json(), q.video_id) for q in listed]
    table = spark.createDataFrame([*rows, rows[0]], "qid string, tree string, video_id int")  # a row twice counts once
    got = FrameSelector().select_table(grid, table, features(grid), 4)
    want = set()
    for q in listed:
        want |= as_set(FrameSelector().select(grid, [q], features(grid), 4))
    assert as_set(got) == want and len(want) == 4 * (3 + 1 + 1 + 3 + 1) and got.where("error is not null").count() == 0


def test_questions_are_parsed_once_on_executors(spark, grid):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)

        class Counted(StaticParser):
            def parse(self, question, enabled_audio=None, temperature=None):
                calls.add(1)
                if "fails" in question:
                    raise RuntimeError("the model fell asleep")
                return super().parse(question, enabled_audio, temperature)

        return Counted({"first?": TREES["q0"], 'second? Options: ["x"]': TREES["q1"], "speech?": Node.of("AND", A, Node.leaf("OCR", "sign"))})

    rows = [("a", "first?", None), ("b", "first?", None), ("c", "second?", ["x"]), ("d", "fails?", None), ("e", None, None), (None, "first?", None)]
    table = spark.createDataFrame(rows, "qid string, question string, candidates array<string>")
    selector = FrameSelector()
    got = selector.select_table(grid, table, features(grid), 2, make=make)
    assert calls.value == 3 and 0 < loads.value <= 3
    errors = {r.qid: r.error for r in got.where("error is not null").collect()}
    assert errors == {"d": "the model fell asleep", "e": "no question", None: "no qid"}
    assert {(r.qid, r.video_id) for r in got.where("rank = 1").collect()} == {(q, v) for q in "abc" for v in range(3)}
    assert got.where("error is not null and (rank is not null or video_id is not null)").count() == 0 and calls.value == 3


def test_batches_and_bad_trees(spark, grid):
    class Many:
        def parse_many(self, texts, flags, temperature):
            assert len(texts) <= 32
            return [A if t == "good" else ValueError("no answer") for t in texts]

    rows = [("g", "good", None), ("h", "bad", None), ("i", None, '{"op": "SEQ", "children": []}'), ("j", None, "no JSON"), ("k", None, Node.of("AND", A, Node.leaf("OCR", "x")).to_json())]
    table = spark.createDataFrame(rows, "qid string, question string, tree string")
    from cuesift.config import Settings

    settings = Settings(experts=("CLIP",))
    trees = {r.qid: r for r in FrameSelector(settings).parse_table(table, Many).collect()}
    assert trees["g"].error is None and trees["h"].error == "no answer" and "JSON" in trees["j"].error and trees["i"].error and "disabled" in trees["k"].error
    dropped = {r.qid: r for r in FrameSelector(settings, on_missing="drop").parse_table(table, Many).collect()}
    assert Node.from_json(dropped["k"].tree).leaves()[0].query == "a" and len(Node.from_json(dropped["k"].tree).leaves()) == 1


def test_own_parser_and_empty_tables(spark, grid):
    table = spark.createDataFrame([("q", "a cat then a dog")], "qid string, question string")
    tree = FrameSelector(parser=RuleParser()).parse_table(table).first().tree
    assert Node.from_json(tree) == RuleParser().parse("a cat then a dog")
    assert FrameSelector().parse_table(table).first().error == "no parser was given"
    assert FrameSelector().select_table(grid, table.where("false"), features(grid), 3).count() == 0
    only_bad = FrameSelector().select_table(grid, table, features(grid), 3).collect()
    assert [(r.qid, r.error) for r in only_bad] == [("q", "no parser was given")]
