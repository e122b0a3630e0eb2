from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cuesift.llm.vectors import embedding_groups, passes_for


def planted(spark, n, pairs, cosine, dim=64):
    """Random vectors, the first ``pairs`` of which have a partner at ``cosine`` (ids from n on)."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    y = cosine * x[:pairs] + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    import pyarrow as pa

    values = pa.array(np.concatenate([x, y]).astype(np.float32).ravel())
    table = pa.table({"vec_id": np.arange(n + pairs), "embedding": pa.ListArray.from_arrays(np.arange(0, (n + pairs + 1) * dim, dim, dtype=np.int32), values)})
    return table


def test_passes_grow_with_the_vectors():
    assert passes_for(1000) == 12
    assert 12 < passes_for(100_000) < passes_for(1_000_000) < passes_for(100_000_000)


def test_pairs_are_found_where_a_window_is_a_small_share(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(planted(spark, 20_000, 400, 0.905), f"{tmp_path}/v.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/v.parquet")
    got = embedding_groups(vectors, window=4)  # by the model 12 passes find 0.85 of the pairs
    assert got.where(F.col("vec_id") >= 20_000).where("n_links = 1 and not kept").count() >= 0.985 * 400
