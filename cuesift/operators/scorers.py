"""Scores of frames by five kinds of evidence, from feature tables.

Each scorer takes features and leaves (expert queries, known to the driver) and returns long
rows. Extracting features from pictures and sound is a plugin's task (see ``sources``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesift.functions import text as T
from cuesift.functions import vector as V
from cuesift.operators.extract import extract
from cuesift.operators.matrix import MOST_BYTES, matrix_scores, with_cosines

MIN_CONFIDENCE = 0.001
#: Query vectors that are compared by column expressions.
FEW_QUERIES = 8


def _with_queries(frames: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Each frame with each query: an array of literals, exploded, so no join is needed."""
    return frames.withColumn("query", F.explode(F.array(*[F.lit(q) for q in queries])))


def clip_scores(frames: DataFrame, queries: dict[str, Sequence[float]], keys: Sequence[str] = ("video_id", "frame_idx")) -> DataFrame:
    """(keys, embedding) and query vectors -> (keys, query, score); unit vectors on both sides, scores (cos + 1) / 2.

    More than ``FEW_QUERIES`` are a matrix product for each batch of frames, so that no embedding is copied for each query.
    """
    if len(queries) > FEW_QUERIES:
        return matrix_scores(frames, queries, keys)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), V.literal(v).alias("v")) for q, v in queries.items()]))
    rows = frames.select(*keys, "embedding", each.alias("q"))
    return rows.select(*keys, F.col("q.query").alias("query"), V.affine_score(V.dot(F.col("embedding"), F.col("q.v"))).alias("score"))


def template_vectors(embed: Callable[[list[str]], list[Sequence[float]]], query: str, templates: Sequence[str]) -> list[float]:
    """A query's vector as the unit mean of its templates' unit vectors."""
    vectors = [[x / (sum(y * y for y in v) ** 0.5) for x in v] for v in embed([t.format(query) for t in templates])]
    mean = [sum(c) / len(vectors) for c in zip(*vectors, strict=True)]
    n = sum(x * x for x in mean) ** 0.5
    return [x / n for x in mean]


def template_means(vectors: DataFrame, keys: Sequence[str] = ("query",)) -> DataFrame:
    """(keys, embedding), a row per template -> (keys, embedding), the unit mean of unit vectors."""
    parts = vectors.select(*keys, F.posexplode(V.unit(F.col("embedding"))).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r"))
    return means.select(*keys, V.unit(F.col("r.x")).alias("embedding"))


def ovd_scores(grid: DataFrame, detections: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Detections (video_id, frame_idx, class, conf) -> (video_id, frame_idx, query, score) on the whole grid.

    A query's score is the highest confidence of its variations, 0 without one. A class that several queries
    have among their variations belongs to the first of them.
    """
    spark = grid.sparkSession
    listed = spark.createDataFrame([(q, i) for i, q in enumerate(queries)], "query string, at int")
    forms = listed.select("query", "at", F.posexplode(T.variations(F.col("query"))).alias("form_at", "class"))
    first = Window.partitionBy("class").orderBy("at", "form_at")
    owner = forms.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("class", "query")
    found = detections.where(F.col("conf") >= MIN_CONFIDENCE).join(F.broadcast(owner), "class").groupBy("video_id", "frame_idx", "query").agg(F.max("conf").alias("conf"))
    rows = _with_queries(grid.select("video_id", "frame_idx"), queries).join(found, ["video_id", "frame_idx", "query"], "left")
    return rows.select("video_id", "frame_idx", "query", V.clip01(F.coalesce(F.col("conf").cast("double"), F.lit(0.0))).alias("score"))


def line_scores(texts: DataFrame, queries: Sequence[str], keys: Sequence[str] = ("video_id", "frame_idx")) -> DataFrame:
    """Texts (keys, lines array<string>) -> (keys, query, score), the best line's.

    Every distinct line is cleaned and compared with each query once, whatever the number of frames that show it: lines
    are a dictionary that scores are joined back from. A text without lines scores 0.
    """
    shown = texts.select(*keys, F.explode_outer(F.array_distinct(T.clean_lines(F.col("lines")))).alias("line"))
    words = shown.select("line").distinct()
    words = words.select("line", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), T.strip(F.lower(F.lit(q))).alias("q")) for q in queries])).alias("x"))
    match = F.when(F.col("line").isNull(), F.lit(None)).when(F.contains("line", F.col("x.q")), F.lit(1.0)).otherwise(T.similarity(F.col("x.q"), F.col("line")))
    scored = words.select("line", F.struct(F.col("x.query").alias("query"), match.alias("score")).alias("s")).groupBy("line").agg(F.collect_list("s").alias("s"))
    rows = shown.join(scored, "line", "left").select(*keys, F.explode("s").alias("s"))
    best = rows.groupBy(*keys, "s.query").agg(F.max("s.score").alias("_s"))
    every = _with_queries(texts.select(*keys).distinct(), queries)
    return every.join(best, [*keys, "query"], "left").select(*keys, "query", F.coalesce("_s", F.lit(0.0)).alias("score"))


def ocr_scores(grid: DataFrame, texts: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Texts (video_id, frame_idx, lines array<string>) -> scores on the whole grid; frames without text score 0."""
    scored = line_scores(texts.select("video_id", "frame_idx", "lines"), queries).withColumnRenamed("score", "_s")
    rows = _with_queries(grid.select("video_id", "frame_idx"), queries).join(scored, ["video_id", "frame_idx", "query"], "left")
    return rows.select("video_id", "frame_idx", "query", F.coalesce("_s", F.lit(0.0)).alias("score"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Words (video_id, frame_idx, line, word_idx, word, conf) -> lines (…, text, conf): the least confidence counts."""
    real = words.where(F.length(T.strip(F.col("word"))) > 0)
    rows = real.groupBy("video_id", "frame_idx", "line").agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"), F.min("conf").alias("conf"))
    return rows.select("video_id", "frame_idx", "line", F.array_join("w.word", " ").alias("text"), "conf")


def segment_frames(segments: DataFrame, fps: float, n_frames: Column) -> DataFrame:
    """Segments (video_id, start, end, ...) with each frame of the regular grid that they overlap, and the overlap's weight.

    A frame at i / fps covers half a frame to either side; the weight is the overlap in frames, at most 1.
    The frames are computed, so no interval join is needed.
    """
    lo = F.greatest(F.lit(0), F.ceil(F.col("start") * fps - 0.5)).cast("int")
    hi = F.least(n_frames - 1, F.floor(F.col("end") * fps + 0.5)).cast("int")
    rows = segments.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("frame_idx", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    middle, half = F.col("frame_idx") / fps, 0.5 / fps
    overlap = F.least(F.col("end"), middle + half) - F.greatest(F.col("start"), middle - half)
    return rows.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), overlap) * fps))


def segment_frames_irregular(segments: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """As ``segment_frames`` for frames (video_id, frame_idx, ts) at any times: a join on the video and the overlap."""
    half = 0.5 / fps
    f = frames.select("video_id", "frame_idx", "ts")
    rows = segments.join(f, "video_id").where((F.col("end") >= F.col("ts") - half) & (F.col("start") <= F.col("ts") + half))
    overlap = F.least(F.col("end"), F.col("ts") + half) - F.greatest(F.col("start"), F.col("ts") - half)
    return rows.withColumn("weight", F.least(F.lit(1.0), F.greatest(F.lit(0.0), overlap) * fps))


def long_queries(queries: Sequence[str]) -> list[str]:
    """Queries that sentence vectors are for: those that aren't matched by their letters."""
    return [q for q in queries if len(re.findall(r"\S+", q, re.ASCII)) >= T.SHORT_WORDS]


def asr_scores(
    grid: DataFrame, segments: DataFrame, queries: Sequence[str], fps: float = 1.0, cosines: DataFrame | None = None, vectors: dict[str, Sequence[float]] | None = None, sentences: DataFrame | None = None
) -> DataFrame:
    """Transcript segments (video_id, seg_idx, start, end, text) -> scores on the whole grid.

    Queries of one or two words are matched by their letters; longer ones score 1 where a text contains them, else the
    cosine of sentence vectors, at least 0. Cosines come from ``vectors`` of the long queries and the segments' own
    vectors (a column ``embedding``) or those of distinct texts (``sentences``: text, embedding; see ``sentence_vectors``),
    as matrix products; or they are given (video_id, seg_idx, query, cosine). Where there is none containment counts alone.
    """
    parts = [list(queries)]
    if vectors is not None and cosines is None:
        most = max(1, MOST_BYTES // (8 * max([1, *(len(v) for v in vectors.values())])))
        parts = [list(queries[a : a + most]) for a in range(0, len(queries), most)] or [[]]
    rows = reduce(DataFrame.unionByName, [_spoken(segments, part, cosines, vectors, sentences) for part in parts])
    size = grid.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    hit = segment_frames(rows.join(size, "video_id"), fps, F.col("n")).groupBy("video_id", "frame_idx", "query").agg(F.max(F.col("similarity") * F.col("weight")).alias("_s"))
    out = _with_queries(grid.select("video_id", "frame_idx"), queries).join(hit, ["video_id", "frame_idx", "query"], "left")
    return out.select("video_id", "frame_idx", "query", F.coalesce("_s", F.lit(0.0)).alias("score"))


def _spoken(segments: DataFrame, queries: Sequence[str], cosines: DataFrame | None, vectors: dict[str, Sequence[float]] | None, sentences: DataFrame | None) -> DataFrame:
    """Segments with each query that they match: video_id, seg_idx, start, end, query, similarity."""
    told = ["video_id", "seg_idx", "start", "end", "text"]
    compared = [q for q in long_queries(queries) if q in vectors] if vectors is not None and cosines is None else []
    if compared and sentences is not None:
        known = sentences.select("text", "embedding").dropDuplicates(["text"])
        texts = with_cosines(segments.select("text").distinct().join(known, "text"), [vectors[q] for q in compared])
        rows = segments.select(*told).join(texts, "text", "left")
    elif compared and "embedding" in segments.columns:
        rows = with_cosines(segments.select(*told, "embedding"), [vectors[q] for q in compared])
    else:
        rows, compared = segments.select(*told), []
    if compared:
        place = {q: i for i, q in enumerate(compared)}
        each = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(place.get(q)).cast("int").alias("at")) for q in queries])
        rows = rows.withColumn("_q", F.explode(each)).select(*told, F.col("_q.query").alias("query"), F.get("cosines", F.col("_q.at")).alias("cosine"))
    elif cosines is not None:
        rows = _with_queries(rows, queries).join(cosines, ["video_id", "seg_idx", "query"], "left")
    else:
        rows = _with_queries(rows, queries).withColumn("cosine", F.lit(None).cast("double"))
    q, t = F.col("query"), F.col("text")
    rows = rows.withColumn("similarity", F.when(T.is_short(q), T.short_match(q, t)).otherwise(T.long_match(q, t, F.col("cosine"))))
    return rows.where("similarity > 0").select("video_id", "seg_idx", "start", "end", "query", "similarity")


def sentence_vectors(segments: DataFrame, load: Callable[[], object], run: Callable[[object, list[str]], Sequence], batch_size: int = 64, dim: int | None = None, **options) -> DataFrame:
    """Distinct texts of segments with their vectors: text, embedding. ``run(model, texts)`` gives a vector for each text of a batch; a text
    that many segments share is embedded once. Null texts and those of white space have none."""
    texts = segments.select("text").where(F.length(T.strip(F.col("text"))) > 0).distinct()
    return extract(texts, f"sentences-{id(load)}", load, lambda model, part: run(model, part["text"].tolist()), ["text"], "embedding array<float>", batch_size, dim, **options)


def clap_scores(frames: DataFrame, queries: dict[str, Sequence[float]], keys: Sequence[str] = ("video_id", "frame_idx")) -> DataFrame:
    """As ``clip_scores`` for sound vectors; a silent frame (null embedding) has the score of cosine 0, 0.5."""
    if len(queries) > FEW_QUERIES:
        return matrix_scores(frames, queries, keys, cosine=True)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), V.literal(v).alias("v")) for q, v in queries.items()]))
    rows = frames.select(*keys, "embedding", each.alias("q"))
    cosine = F.when(F.col("embedding").isNull(), F.lit(0.0)).otherwise(V.cosine(F.col("embedding"), F.col("q.v")))
    return rows.select(*keys, F.col("q.query").alias("query"), V.affine_score(cosine).alias("score"))


Scorer = Callable[[DataFrame, Sequence[str]], DataFrame]
_SCORERS: dict[str, Callable] = {"CLIP": clip_scores, "OVD": ovd_scores, "OCR": ocr_scores, "ASR": asr_scores, "CLAP": clap_scores}


def scorer(expert: str) -> Callable:
    if expert not in _SCORERS:
        raise ValueError(f"unknown expert {expert!r}; one of {sorted(_SCORERS)}")
    return _SCORERS[expert]


def register_scorer(expert: str, score: Callable) -> None:
    _SCORERS[expert] = score


def align_embeddings(cached: DataFrame, n_frames: int | Column) -> DataFrame:
    """Cached embeddings (video_id, frame_idx, embedding) fitted to ``n_frames`` (a number, or each video's column): extra frames go from the head."""
    size = Window.partitionBy("video_id")
    over = F.greatest(F.lit(0), F.max("frame_idx").over(size) + 1 - n_frames)
    rows = cached.withColumn("_over", over).where(F.col("frame_idx") >= F.col("_over"))
    return rows.withColumn("frame_idx", (F.col("frame_idx") - F.col("_over")).cast("int")).drop("_over")


def signal_summary(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Least, greatest and mean score of each signal."""
    return signals.groupBy(*by).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))
