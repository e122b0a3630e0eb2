"""The store of extracted features: snapshots of Parquet rows and a versioned manifest, kept across questions.

    <path>/<feature>/data/snapshot=<id>/bucket=<n>/   rows, by the hash of their video's key
    <path>/<feature>/keys/snapshot=<id>/              every key that the snapshot holds, with its number of rows
    <path>/<feature>/commits/<version>                which snapshot a version adds

A snapshot counts from the moment its version's file is there; that file is created by one writer only. A job that
fails before leaves folders that nothing reads. The highest version that has a key holds its rows, so a
second save replaces the first; a video without rows (no text, no speech) has a key with 0 rows and counts as done.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuesift.functions.text import cache_key
from cuesift.operators.scorers import align_embeddings
from cuesift.sources.scratch import file_system

#: Features that don't depend on a question, with their columns.
FEATURES = {
    "clip": "video_id string, frame_idx int, embedding array<float>",
    "ocr": "video_id string, frame_idx int, detections array<struct<text string, conf double>>",
    "asr": "video_id string, seg_idx int, start double, end double, text string",
    "clap": "video_id string, frame_idx int, embedding array<float>",
}
BUCKETS = 64
_KEYS = "cache_key string, video_id string, rows bigint"

Extractor = Callable[[DataFrame], DataFrame]


class CommitConflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Commit:
    """A version: its snapshot, how many rows that has, and whether it replaces all versions before."""

    version: int
    snapshot: str
    rows: int
    base: bool = False


class FeatureStore:
    """Features by video: saved once, found by the sha256 of path:fps, whoever asks."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._held: dict[str, tuple[int, DataFrame]] = {}

    def _at(self, feature: str, part: str = "") -> str:
        if feature not in FEATURES:
            raise ValueError(f"unknown feature {feature!r}; one of {sorted(FEATURES)}")
        return f"{self.path}/{feature}" + (f"/{part}" if part else "")

    # ---- the manifest

    def commits(self, feature: str, version: int | None = None) -> list[Commit]:
        """Versions in order up to ``version``, from the last that replaced all before. Compaction bounds their number."""
        fs, at = file_system(self.spark, self._at(feature, "commits"))
        found = []
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if (name := status.getPath().getName()).isdigit() and (version is None or int(name) <= version):
                stream = fs.open(status.getPath())
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                if text:  # else its writer is about to fill it, or failed
                    found.append(Commit(int(name), **json.loads(text)))
        found.sort(key=lambda c: c.version)
        base = max((i for i, c in enumerate(found) if c.base), default=0)
        return found[base:]

    def version(self, feature: str) -> int:
        """The latest version; 0 before the first save."""
        return max((c.version for c in self.commits(feature)), default=0)

    def _commit(self, feature: str, snapshot: str, rows: int, base: bool = False, after: int | None = None) -> int:
        """Make a snapshot the next version; with ``after``, only if that is still the latest."""
        fs, folder = file_system(self.spark, self._at(feature, "commits"))
        fs.mkdirs(folder)
        while True:
            there = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
            last = max(there, default=0)
            if after is not None and last != after:
                raise CommitConflict(f"{feature}: version {last} came after {after}")
            try:
                out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{last + 1:012d}"), False)
            except Exception as error:
                if "FileAlreadyExists" in str(error):
                    continue
                raise
            out.write(bytearray(json.dumps({"snapshot": snapshot, "rows": rows, "base": base}).encode()))
            out.close()
            return last + 1

    def _read(self, feature: str, part: str, schema: str, commits: Sequence[Commit]) -> DataFrame:
        paths = [f"{self._at(feature, part)}/snapshot={c.snapshot}" for c in commits]
        names = f"{schema}, snapshot string" + (", bucket int" if part == "data" else "")
        if not paths:
            return self.spark.createDataFrame([], names)
        return self.spark.read.schema(names).option("basePath", self._at(feature, part)).parquet(*paths)

    def manifest(self, feature: str, version: int | None = None) -> DataFrame:
        """cache_key, video_id, rows, snapshot, version: what is stored, a row for each key and video."""
        commits = self.commits(feature, version)
        order = self.spark.createDataFrame([(c.snapshot, c.version) for c in commits], "snapshot string, version int")
        keys = self._read(feature, "keys", _KEYS, commits).join(F.broadcast(order), "snapshot")
        latest = keys.groupBy("cache_key").agg(F.max("version").alias("version"))
        return keys.join(latest, ["cache_key", "version"]).select("cache_key", "video_id", "rows", "snapshot", "version")

    # ---- rows

    def _keyed(self, videos: DataFrame, fps: float) -> DataFrame:
        return videos.select(F.col("video_id").cast("string").alias("video_id"), cache_key(F.col("path"), F.lit(fps)).alias("cache_key")).distinct()

    def _write(self, feature: str, rows: DataFrame, keys: DataFrame) -> tuple[str, int]:
        """Rows with a cache_key, and (cache_key, video_id), as a snapshot that nothing knows yet."""
        snapshot = uuid.uuid4().hex
        names = StructType.fromDDL(FEATURES[feature]).names
        bucket = F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int")
        dealt = rows.select(*names, "cache_key", bucket.alias("bucket")).repartition("bucket", F.pmod(F.xxhash64(*names[:2]), F.lit(8)))  # a long video is dealt on
        dealt.write.partitionBy("bucket").parquet(f"{self._at(feature, 'data')}/snapshot={snapshot}")
        here = Commit(0, snapshot, 1)
        try:
            count = self._read(feature, "data", f"{FEATURES[feature]}, cache_key string", [here]).groupBy("cache_key", "video_id").agg(F.count("*").alias("n"))
        except AnalysisException:  # no rows, no files
            count = self.spark.createDataFrame([], "cache_key string, video_id string, n bigint")
        keys.join(count, ["cache_key", "video_id"], "left").select("cache_key", "video_id", F.coalesce("n", F.lit(0)).alias("rows")).write.parquet(f"{self._at(feature, 'keys')}/snapshot={snapshot}")
        return snapshot, self._read(feature, "keys", _KEYS, [here]).agg(F.sum("rows")).first()[0] or 0

    def save(self, feature: str, rows: DataFrame, videos: DataFrame, fps: float) -> int:
        """Store rows (video_id, ...) under the keys of ``videos`` (video_id, path), all of them or none; returns the version.

        Every video of ``videos`` counts as done, with or without rows; rows of other videos are left out. Other keys stay.
        """
        self._at(feature)
        keys = self._keyed(videos, fps).where("cache_key is not null")
        out = rows.withColumn("video_id", F.col("video_id").cast("string")).join(keys, "video_id")
        return self._commit(feature, *self._write(feature, out, keys))

    def compact(self, feature: str) -> int:
        """All current rows as one snapshot that replaces every version before; fails if another save comes in between."""
        before = self.version(feature)
        keys = self.manifest(feature, before).select("cache_key", "video_id")
        return self._commit(feature, *self._write(feature, self.load(feature, version=before), keys), base=True, after=before)

    def vacuum(self, feature: str) -> int:
        """Delete snapshots that no version from the last compaction on has; no writer or reader of older versions may be at work."""
        used, gone = {c.snapshot for c in self.commits(feature)}, 0
        for part in ("data", "keys"):
            fs, at = file_system(self.spark, self._at(feature, part))
            for status in fs.listStatus(at) if fs.exists(at) else []:
                name = status.getPath().getName()
                if name.startswith("snapshot=") and name.removeprefix("snapshot=") not in used:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone

    def load(self, feature: str, videos: DataFrame | None = None, fps: float | None = None, version: int | None = None) -> DataFrame:
        """Rows of a feature as of a version (the latest), of the given videos' keys if given; empty where nothing was saved.

        Only the snapshots and buckets of the wanted keys are read where Spark can prune by the join.
        """
        commits = self.commits(feature, version)
        full = [c for c in commits if c.rows]
        rows = self._read(feature, "data", f"{FEATURES[feature]}, cache_key string", full)
        if videos is not None:
            wanted = self._keyed(videos, fps).select("cache_key")
        if videos is None and len(commits) <= 1:
            return rows.drop("snapshot", "bucket")
        held = self.manifest(feature, version).select("cache_key", "snapshot", F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int").alias("bucket")).distinct()
        held = held if videos is None else held.join(wanted.distinct(), "cache_key", "left_semi")
        return rows.join(held, ["snapshot", "bucket", "cache_key"], "left_semi").drop("snapshot", "bucket")

    def status(self, videos: DataFrame, fps: float) -> DataFrame:
        """(video_id, clip, ocr, asr, clap): which features are stored, be it without rows."""
        out = videos.select("video_id", cache_key(F.col("path"), F.lit(fps)).alias("cache_key"))
        for feature in FEATURES:
            there = self.manifest(feature).select("cache_key").distinct().withColumn(feature, F.lit(True))
            out = out.join(there, "cache_key", "left").withColumn(feature, F.coalesce(feature, F.lit(False)))
        return out.drop("cache_key")

    def missing(self, feature: str, videos: DataFrame, fps: float) -> DataFrame:
        """The videos whose key isn't stored."""
        there = self.manifest(feature).select("cache_key").distinct()
        return videos.withColumn("cache_key", cache_key(F.col("path"), F.lit(fps))).join(there, "cache_key", "left_anti").drop("cache_key")

    def hold(self, feature: str) -> DataFrame:
        """A feature's latest rows kept by the executors, once for all questions; an older version is let go."""
        version = self.version(feature)
        if feature in self._held and self._held[feature][0] != version:
            self.release(feature)
        if feature not in self._held:
            self._held[feature] = (version, self.load(feature).persist())
        return self._held[feature][1]

    def release(self, feature: str | None = None) -> None:
        """Let go what ``hold`` keeps, of one feature or of all."""
        for name in [feature] if feature else list(self._held):
            if name in self._held:
                self._held.pop(name)[1].unpersist()

    def get(self, feature: str, videos: DataFrame, fps: float, extract: Extractor) -> DataFrame:
        """Stored rows; videos whose key isn't stored are extracted and stored first."""
        missing = self.missing(feature, videos, fps)
        if missing.take(1):
            self.save(feature, extract(missing), missing, fps)
        return self.load(feature, videos, fps)

    def extract_features(self, videos: DataFrame, fps: float, extractors: dict[str, Extractor]) -> DataFrame:
        """Run the given extractors for what isn't stored yet; returns ``status``."""
        for feature, extract in extractors.items():
            self.get(feature, videos, fps, extract)
        return self.status(videos, fps)


class FeatureLookup:
    """Features for a selector by tiers: rows that the executors hold, else the store, else an extractor, whose rows are stored.

    ``extractors`` by feature take videos (video_id, path, ...) and give that feature's rows; a feature without one and videos
    without stored rows are just absent. ``dims`` by feature: stored vectors of another length are extracted again. With
    ``hold`` rows stay with the executors between questions, until ``store.release()``.
    """

    def __init__(self, store: FeatureStore, extractors: dict[str, Extractor] | None = None, dims: dict[str, int] | None = None, hold: bool = False):
        self.store, self.extractors, self.dims, self.hold = store, dict(extractors or {}), dict(dims or {}), hold

    def _outdated(self, feature: str, videos: DataFrame, fps: float) -> DataFrame:
        """Videos with a stored vector of another length."""
        rows = self.store.load(feature, videos, fps).where(F.size("embedding") != self.dims[feature]).select("cache_key").distinct()
        return videos.withColumn("cache_key", cache_key(F.col("path"), F.lit(fps))).join(rows, "cache_key", "left_semi").drop("cache_key")

    def prepare(self, feature: str, videos: DataFrame, fps: float) -> None:
        """Extract and store what the store lacks, once."""
        if feature not in self.extractors:
            return
        todo = self.store.missing(feature, videos, fps)
        if feature in self.dims:
            todo = todo.unionByName(self._outdated(feature, videos, fps))
        if todo.take(1):
            self.store.save(feature, self.extractors[feature](todo), todo, fps)

    def rows(self, feature: str, videos: DataFrame, fps: float) -> DataFrame:
        """A feature's rows of the given videos from the nearest tier."""
        self.prepare(feature, videos, fps)
        if not self.hold:
            return self.store.load(feature, videos, fps).drop("cache_key")
        keys = videos.select(cache_key(F.col("path"), F.lit(fps)).alias("cache_key")).distinct()
        return self.store.hold(feature).join(keys, "cache_key", "left_semi").drop("cache_key")

    def features(self, experts: Sequence[str], videos: DataFrame, grid: DataFrame, fps: float) -> dict[str, dict]:
        """What the scorers of ``experts`` need, of the given videos; vectors are fitted to the grid's frames.

        A store that has more frames of a video than the grid loses them from the head; frames that it lacks have no score.
        """
        out: dict[str, dict] = {}
        for expert in experts:
            feature = expert.lower()
            if feature not in FEATURES:
                continue
            rows = self.rows(feature, videos, fps)
            if feature in ("clip", "clap"):
                size = grid.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n_frames"))
                out[expert] = {"frames": align_embeddings(rows.join(size, "video_id"), F.col("n_frames")).select("video_id", "frame_idx", "embedding")}
            elif feature == "ocr":
                out[expert] = {"texts": rows.select("video_id", "frame_idx", F.col("detections.text").alias("lines"))}
            else:
                out[expert] = {"segments": rows}
        return out

    def report(self, videos: DataFrame, fps: float) -> DataFrame:
        """(video_id, feature, rows, tier): memory, store, extractor or absent, as the next lookup would find it; rows are null if not stored."""
        keyed = videos.select("video_id", cache_key(F.col("path"), F.lit(fps)).alias("cache_key"))
        parts = []
        for feature in FEATURES:
            held = self.hold and self.store._held.get(feature, (None,))[0] == self.store.version(feature)
            there = self.store.manifest(feature).groupBy("cache_key").agg(F.sum("rows").alias("rows"))
            tier = F.when(F.col("rows").isNotNull(), F.lit("memory" if held else "store")).otherwise(F.lit("extractor" if feature in self.extractors else "absent"))
            parts.append(keyed.join(there, "cache_key", "left").select("video_id", F.lit(feature).alias("feature"), "rows", tier.alias("tier")))
        return reduce(DataFrame.unionByName, parts)
