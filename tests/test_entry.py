from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from cuesift import queries as engine

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in plain.itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", engine.oracle_sql())
def test_query_matches_its_sql(spark, duck, name):
    assert rows(engine.queries()[name](spark, SF).toPandas()) == rows(duck.sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["ovd_scores", "norm_robust_sparse"])
def test_events_just_before_a_bucket_match_the_sql(spark, tmp_path, name):
    """Fractions of a second around a bucket's start: SQL rounds them."""
    times = [f"2024-01-{day:02d} {time}" for day in (1, 9) for time in ("05:59:59.4", "05:59:59.5", "05:59:59.816118", "06:00:00.4", "11:59:58.5", "17:59:59.500001")] + ["2023-12-31 23:59:59.7", None]
    c = duckdb.connect()
    c.sql("create table t (ts timestamp, n bigint)")
    c.executemany("insert into t values (?, ?)", [(t, n) for n, t in enumerate(times)])
    c.sql(f"copy (select n as event_id, ts, n % 3 as user_id, if(n % 2 = 0, 'click', 'view') as event_type, 10.0::double + n as value from t) to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert rows(engine.queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(engine.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(engine.queries().keys() - engine.oracle_sql().keys()))
def test_query_without_sql_has_rows(spark, name):
    assert engine.queries()[name](spark, SF).count() > 0


def edits(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row = row, [j]
        for i, x in enumerate(a, 1):
            row.append(min(last[i] + 1, row[-1] + 1, last[i - 1] + (x != y)))
    return row[-1]


def test_line_matches_are_those_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expect = {}
    for r in docs:
        for q in engine._READ:
            lines = [x.lower().strip() for x in r.text.split("\n")]
            expect[r.doc_id, q] = 1.0 if any(q in x for x in lines) else max(1 - edits(q, x) / max(len(q), len(x)) if x else 0.0 for x in lines)
    got = {(r.doc_id, r["query"]): r.score for r in engine.queries()["ocr_match"](spark, SF).collect()}
    assert got.keys() == expect.keys() and all(abs(got[k] - expect[k]) < 2e-6 for k in got)
    grid = engine.queries()["ocr_scores_cached"](spark, SF).collect()
    sources = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        sources.setdefault(r.source, []).append(r.doc_id)
    assert len(grid) == sum(len(x) + 2 for x in sources.values()) * len(engine._READ)
    for r in grid:
        at = sources[r.video_id]
        assert abs(r.score - (expect[at[r.frame_idx], r["query"]] if r.frame_idx < len(at) else 0.0)) < 2e-6


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "frame_idx" in out.columns


def test_the_engine_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{ROOT}/cuesift", tmp_path / "cuesift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tree_rescaled' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
    run = [sys.executable, "-m", "pytest", "-q", "-x", "tests/test_tree.py", "tests/test_operators.py"]
    subprocess.run(run, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=400)


def test_the_engine_stands_where_the_operators_cannot_be_imported(tmp_path):
    """The folder is there, but what it needs isn't."""
    shutil.copytree(f"{ROOT}/cuesift", tmp_path / "cuesift", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('absent')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tree_rescaled' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
