from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesift.operators import matrix
from cuesift.operators import scorers as S


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("score", [S.clip_scores, S.clap_scores])
def test_many_queries_score_as_few(spark, monkeypatch, score, kind):
    rng = np.random.default_rng(1)
    odd = [None, [], [1.0], [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 0.0], [1e-12, 0.0, 0.0]]
    rows = [("v", i, e) for i, e in enumerate(odd + rng.standard_normal((40, 3)).tolist())]
    frames = spark.createDataFrame(rows, f"video_id string, frame_idx int, embedding array<{kind}>").withColumn("query", F.lit("clash")).repartition(3)
    queries = {f"q{i}": v for i, v in enumerate([*rng.standard_normal((9, 3)).tolist(), [0.0, 0.0, 0.0], [1.0, 2.0]])}
    found = lambda df: {(r["video_id"], r["frame_idx"], r["query"]): r["score"] for r in df.collect()}
    monkeypatch.setattr(S, "FEW_QUERIES", 100)
    wanted = found(score(frames, queries))
    monkeypatch.setattr(S, "FEW_QUERIES", 8)
    got = found(score(frames, queries))
    assert got.keys() == wanted.keys() and len(got) == len(rows) * len(queries)
    assert all(got[k] == pytest.approx(wanted[k], abs=1e-12) for k in got), [(k, got[k], wanted[k]) for k in got if got[k] != pytest.approx(wanted[k], abs=1e-12)][:5]
    monkeypatch.setattr(matrix, "MOST_BYTES", 60)
    monkeypatch.setattr(matrix, "AT_ONCE", 7)
    assert found(score(frames, queries)) == pytest.approx(wanted, abs=1e-12)
    assert score(frames.limit(0), queries).collect() == []
