"""Trees as rows: repair, validate and flatten a table of JSON trees.

A tree is recursive, so no struct type holds it; these read and write it as JSON text, a batch at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cuesift.plans.parsing import QueryParser, format_question
from cuesift.plans.tree import MissingLeaf, Node, TreeError, prune, repair


@F.pandas_udf(StringType())
def repaired(trees: pd.Series) -> pd.Series:
    """Trees with long RIGHT_AFTER chains nested to the right; what isn't JSON, and null, stays as it is."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(repair(json.loads(text)))
        except json.JSONDecodeError:
            return text

    return trees.map(one)


@F.pandas_udf(StringType())
def problem(trees: pd.Series) -> pd.Series:
    """What is wrong with a tree, null if nothing."""

    def one(text: str | None) -> str | None:
        try:
            Node.from_json("" if text is None else text)
        except TreeError as e:
            return str(e)
        return None

    return trees.map(one).astype(object).where(lambda x: x.notna(), None)


def flattened(trees: DataFrame, key: str = "qid", tree: str = "tree") -> DataFrame:
    """(key, tree) -> (key, node_id, expert, query, depth, path), a row per leaf; invalid trees fail."""
    fields = [trees.schema[key]]
    schema = StructType([*fields, *StructType.fromDDL("node_id int, expert string, query string, depth int, path string").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, x.node_id, x.expert, x.query, x.depth, x.path) for k, text in zip(batch[key], batch[tree], strict=True) for x in Node.from_json(text).leaves()]
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return trees.select(key, F.col(tree).cast(StringType()).alias(tree)).mapInPandas(run, schema)


def problems(trees: DataFrame, key: str = "qid", tree: str = "tree") -> DataFrame:
    """(key, problem) of the invalid trees."""
    return trees.select(key, problem(F.col(tree)).alias("problem")).where(F.col("problem").isNotNull())




def bound_tree(tree: Node, enabled: set[str], on_missing: str) -> Node:
    """The tree with leaves of ``enabled`` experts only; others fail ("error") or are dropped ("drop")."""
    if on_missing == "error":
        if off := [leaf.query for leaf in tree.leaves() if leaf.expert not in enabled]:
            raise MissingLeaf(f"leaves of disabled experts: {off}")
        return tree
    left = prune(tree, enabled)
    if left is None:
        raise MissingLeaf("no leaf of an enabled expert is left")
    return left.validate()


def parsed(questions: DataFrame, make: Callable[[], QueryParser] | None, enabled: Sequence[str], on_missing: str = "error", temperature: float | None = None, batch_size: int = 32) -> DataFrame:
    """Distinct questions (question, candidates, tree) -> the same and bound (a valid tree as JSON), error.

    A row with a tree needs no parser; the others are parsed on executors: ``make()`` makes a worker's parser when it
    first needs one. A parser with ``parse_many(questions, flags, temperature)`` (a tree or an exception for each) gets ``batch_size`` questions
    at once. What can't be parsed, and trees that break the rules, have an error and no tree.
    """
    schema = StructType([*questions.schema.fields, *StructType.fromDDL("bound string, error string").fields])
    flags = {e: e in enabled for e in ("ASR", "CLAP")}
    experts = set(enabled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser: list[QueryParser] = []

        def asked(texts: list[str]) -> list:
            if make is None:
                return [ValueError("no parser was given")] * len(texts)
            if not parser:
                parser.append(make())
            if hasattr(parser[0], "parse_many"):
                return list(parser[0].parse_many(texts, flags, temperature))
            return [_tried(lambda t=t: parser[0].parse(t, flags, temperature)) for t in texts]

        for batch in batches:
            for at in range(0, len(batch), batch_size):
                some = batch.iloc[at : at + batch_size].reset_index(drop=True)
                found = [_tried(lambda t=t: Node.from_json(t)) if isinstance(t, str) else ValueError("no question") for t in some["tree"]]
                open_ = [i for i, (q, t) in enumerate(zip(some["question"], some["tree"], strict=True)) if isinstance(q, str) and not isinstance(t, str)]
                texts = [format_question(some["question"][i], some["candidates"][i] if some["candidates"][i] is not None else None) for i in open_]
                for i, tree in zip(open_, asked(texts) if texts else [], strict=True):
                    found[i] = tree
                found = [x if isinstance(x, Exception) else _tried(lambda x=x: bound_tree(x.validate(), experts, on_missing)) for x in found]
                some["bound"] = pd.Series([None if isinstance(x, Exception) else x.to_json() for x in found], dtype=object)
                some["error"] = pd.Series([(str(x) or type(x).__name__) if isinstance(x, Exception) else None for x in found], dtype=object)
                yield some

    return questions.mapInPandas(run, schema)


def _tried(make: Callable[[], Node]) -> Node | Exception:
    try:
        return make()
    except Exception as e:
        return e
