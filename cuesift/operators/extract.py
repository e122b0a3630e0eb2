"""Models on tables: rows go to a plugin in batches, the model is loaded once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cuesift.config import EmbeddingPreset, embedding_preset

_models: dict[object, object] = {}


def _loaded(key: object, load: Callable[[], object]) -> object:
    if key not in _models:
        _models[key] = load()
    return _models[key]


def extract(rows: DataFrame, name: str, load: Callable[[], object], run: Callable[[object, pd.DataFrame], Sequence], keys: Sequence[str], out: str, batch_size: int = 64, dim: int | None = None, profile: ResourceProfile | None = None, barrier: bool = False) -> DataFrame:
    """(keys, ...) -> (keys, ``out``), a model's result for each row.

    ``load()`` makes the model when a worker first needs it; ``run(model, rows)`` gives one value per row of at most
    ``batch_size`` rows, in order. ``out`` is a column's name and type ("embedding array<float>"); with ``dim`` a vector of
    another length fails. Nothing is shuffled; an empty table loads nothing. ``profile`` gives the model's stage
    resources of its own (GPUs, say), ``barrier`` starts its tasks together.
    """
    column = out.split()[0]
    schema = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(out).fields])

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch_size):
                some = part.iloc[at : at + batch_size]
                values = list(run(_loaded(name, load), some))
                if len(values) != len(some):
                    raise ValueError(f"{name}: {len(values)} results for {len(some)} rows")
                if dim is not None and any(v is not None and len(v) != dim for v in values):
                    raise ValueError(f"{name}: a vector isn't of length {dim}")
                result = some[list(keys)].reset_index(drop=True)
                result[column] = pd.Series(values, dtype=object)
                yield result

    return rows.mapInPandas(batches, schema, barrier=barrier, profile=profile)


def embed(rows: DataFrame, model: str, load: Callable[[EmbeddingPreset], object], run: Callable[[object, pd.DataFrame], Sequence], keys: Sequence[str] = ("video_id", "frame_idx"), **options) -> DataFrame:
    """(keys, ...) -> (keys, embedding) by a named embedding model: ``load(preset)`` makes it, its batch size and width are the preset's."""
    chosen = embedding_preset(model)
    return extract(rows, f"embed-{chosen}", lambda: load(chosen), run, keys, "embedding array<float>", chosen.batch_size, chosen.dim, **options)
