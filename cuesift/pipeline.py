"""The selector: questions and features in, the best frames of each video out, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesift.config import EXPERTS, Settings, preset
from cuesift.operators.blocks import normalize_blocks, smooth_blocks
from cuesift.operators.normalize import expert_group, normalize, normalize_joint
from cuesift.operators.scorers import long_queries, scorer, template_vectors
from cuesift.operators.select import create_strategy, select
from cuesift.operators.smooth import smooth_by_expert
from cuesift.plans.bulk import bound_tree, parsed
from cuesift.plans.compiler import compose, pivot
from cuesift.plans.leveled import leaf_table, leveled_curves
from cuesift.plans.parsing import QueryParser, format_question
from cuesift.plans.tree import Node, leaves_by_expert
from cuesift.sources.features import FeatureLookup
from cuesift.sources.scratch import new_path

KEYS = ("video_id", "qid")


@dataclass(frozen=True)
class Question:
    """A question's tree, for one video or (``video_id`` None) for all."""

    qid: str
    tree: Node
    video_id: object = None


def shape_of(tree: Node) -> str:
    """The tree without its leaves' experts and queries: trees of one shape share a plan."""
    return "." if tree.op == "LEAF" else f"{tree.op}({','.join(map(shape_of, tree.children))})"


class FrameSelector:
    """Selects frames by question. Features are tables by expert; a frame grid says which frames there are.

    ``features`` maps an expert to what its scorer needs: CLIP and CLAP {"frames": DataFrame, "queries":
    {query: vector}}, OVD {"detections"}, OCR {"texts"}, ASR {"segments", and for
    queries of three words or more "vectors" or "embed" (texts -> vectors) with segments' "embedding" or "sentences", or "cosines"}.
    """

    def __init__(self, config: Settings | None = None, parser: QueryParser | None = None, on_missing: str = "error"):
        if on_missing not in ("error", "drop"):
            raise ValueError("on_missing is 'error' or 'drop'")
        self.config, self.parser, self.on_missing = config or Settings(), parser, on_missing

    @classmethod
    def preset(cls, name: str, **options) -> FrameSelector:
        return cls(preset(name), **options)

    def parse(self, qid: str, question: str, candidates: Iterable[str] | None = None) -> Question:
        if self.parser is None:
            raise ValueError("no parser was given")
        audio = {e: self.config.enabled(e) for e in ("ASR", "CLAP")}
        return Question(qid, self.parser.parse(format_question(question, candidates), audio, self.config.temperature))

    def bound(self, tree: Node) -> Node:
        """The tree with leaves of enabled experts only; what becomes of others says ``on_missing``."""
        return bound_tree(tree, set(self.config.experts), self.on_missing)

    def scores(self, grid: DataFrame, tree: Node, features: dict[str, dict], fps: float) -> DataFrame:
        """(video_id, frame_idx, expert, query, score): every expert scores its distinct queries in one pass."""
        return self.scores_of(grid, {e: list(dict.fromkeys(q for _, q in leaves)) for e, leaves in leaves_by_expert(tree).items()}, features, fps)

    def scores_of(self, grid: DataFrame, queries_by_expert: dict[str, list[str]], features: dict[str, dict], fps: float) -> DataFrame:
        """As ``scores`` for the queries of many trees. Query vectors come from features[expert]["queries"], or, for CLIP and CLAP with
        ``templates`` set, from features[expert]["embed"], averaged over the templates."""
        parts = []
        for expert, queries in queries_by_expert.items():
            given = features[expert]
            if expert in ("CLIP", "CLAP"):
                averaged = bool(self.config.templates) and "embed" in given
                vectors = {q: template_vectors(given["embed"], q, self.config.templates) if averaged else given["queries"][q] for q in queries}
                rows = scorer(expert)(given["frames"], vectors)
            elif expert == "OVD":
                rows = scorer(expert)(grid, given["detections"], queries)
            elif expert == "OCR":
                rows = scorer(expert)(grid, given["texts"], queries)
            elif expert == "ASR":
                long = long_queries(queries) if "embed" in given else []
                vectors = {**dict(zip(long, given["embed"](long) if long else [], strict=True)), **given.get("vectors", {})} or None
                rows = scorer(expert)(grid, given["segments"], queries, fps, given.get("cosines"), vectors, given.get("sentences"))
            else:
                rows = scorer(expert)(grid, given, queries)
            parts.append(rows.select("video_id", "frame_idx", F.lit(expert).alias("expert"), "query", "score"))
        return reduce(DataFrame.unionByName, parts)

    def signals(self, scores: DataFrame, question: Question, fps: float) -> DataFrame:
        """Normalised and smoothed signals by leaf: video_id, qid, node_id, expert, query, frame_idx, score."""
        leaves = question.tree.leaves()
        ids = F.array(*[F.struct(F.lit(x.node_id).alias("node_id"), F.lit(x.expert).alias("e"), F.lit(x.query).alias("q")) for x in leaves])
        rows = scores.withColumn("qid", F.lit(question.qid)).withColumn("_l", F.explode(F.filter(ids, lambda x: (x["e"] == F.col("expert")) & (x["q"] == F.col("query")))))
        return self._cleaned(rows.select(*KEYS, F.col("_l.node_id").alias("node_id"), "expert", "query", "frame_idx", "score"), fps)

    def _cleaned(self, rows: DataFrame, fps: float, place: Sequence[str] = ("video_id",)) -> DataFrame:
        """Raw leaf scores -> signals; rows that share ``place`` are in one task."""
        config, n = self.config, self.config.signals
        options = {"method": n.method, "delta": n.least_spread, "gamma": n.steepness}
        if config.tree.block:
            return self._cleaned_blocks(rows, fps, options)
        rows = rows.repartition(*place)
        rows = normalize_joint(rows, by=KEYS, **options) if n.joint else normalize(rows, [*KEYS, "node_id"], **options)
        return smooth_by_expert(rows, config.signals, fps, [*KEYS, "node_id"])

    def _cleaned_blocks(self, rows: DataFrame, fps: float, options: dict) -> DataFrame:
        """As ``_cleaned`` for timelines that no task can hold: distinct signals are normalised and smoothed by blocks, then joined with their leaves."""
        n, signal = self.config.signals, [*KEYS, "expert", "query"]
        one = rows.select(*signal, "frame_idx", "score").dropDuplicates([*signal, "frame_idx"]).withColumn("expert_group", expert_group(F.col("expert"), F.col("query")))
        one = normalize_blocks(one, [*KEYS, "expert_group"] if n.joint else signal, **options).drop("expert_group")
        if n.widths:
            experts = {}
            for expert in EXPERTS:
                experts.setdefault(n.width_of(expert) * fps, []).append(expert)
            known = F.col("expert").isin(*EXPERTS)
            parts = [(width, F.col("expert").isin(*names)) for width, names in experts.items()] + [(n.width("visual") * fps, ~known)]
            one = reduce(DataFrame.unionByName, [smooth_blocks(one.where(some), width, signal, block=self.config.tree.block) for width, some in parts])
        return rows.drop("score").join(one, [*signal, "frame_idx"]).select(*rows.columns)

    def truth(self, scores: DataFrame, question: Question, fps: float) -> DataFrame:
        """The truth curve: video_id, qid, frame_idx, ts, score."""
        wide = pivot(self.signals(scores, question, fps), [x.node_id for x in question.tree.leaves()])
        out = compose(wide, question.tree, self.config.tree, fps)
        return out.select(*KEYS, "frame_idx", (F.col("frame_idx") / fps).alias("ts"), "score")

    def curves(self, grid: DataFrame, questions: Sequence[Question], features: dict[str, dict], fps: float) -> DataFrame:
        """The truth curves of all questions: video_id, qid, frame_idx, score.

        Each feature is read and each distinct query scored once, whatever the number of questions; leaves are a
        table that scores are joined with, and a plan is made for each shape of tree, not for each question.
        """
        bound = [Question(q.qid, self.bound(q.tree), q.video_id) for q in questions]
        if not bound:
            raise ValueError("no questions")
        if len(bound) == 1 and bound[0].video_id is None:
            only = bound[0]
            return self.truth(self.scores(grid, only.tree, features, fps), only, fps).drop("ts")
        wanted: dict[str, list[str]] = {}
        for q in bound:
            for expert, leaves in leaves_by_expert(q.tree).items():
                wanted.setdefault(expert, []).extend(x for _, x in leaves)
        shapes = list(dict.fromkeys(shape_of(q.tree) for q in bound))
        rows = [(q.qid, None if q.video_id is None else str(q.video_id), shapes.index(shape_of(q.tree)), x.node_id, x.expert, x.query) for q in bound for x in q.tree.leaves()]
        leaves = grid.sparkSession.createDataFrame(rows, "qid string, own string, shape int, node_id int, expert string, query string")
        mine = leaves.select("own", "expert", "query").distinct()
        videos = grid.select("video_id").distinct()
        if all(q.video_id is not None for q in bound):  # only the asked videos are scored
            videos = videos.where(F.col("video_id").cast("string").isin(list({str(q.video_id) for q in bound}))) if len(bound) <= 200 else videos.join(mine.select("own").distinct(), F.col("video_id").cast("string") == F.col("own"), "left_semi")
            grid = grid.join(videos, "video_id", "left_semi")
            features = {e: {name: part.join(videos, "video_id", "left_semi") if isinstance(part, DataFrame) and "video_id" in part.columns else part for name, part in given.items()} for e, given in features.items()}
        scores = self.scores_of(grid, {e: list(dict.fromkeys(x)) for e, x in wanted.items()}, features, fps)
        asked = scores.join(leaves, ["expert", "query"]).where(F.col("own").isNull() | (F.col("own") == F.col("video_id").cast("string")))
        signals = self._cleaned(asked.select(*KEYS, "shape", "node_id", "expert", "query", "frame_idx", "score"), fps)
        out = []
        for number, shape in enumerate(shapes):
            tree = next(q.tree for q in bound if shape_of(q.tree) == shape)
            wide = pivot(signals.where(F.col("shape") == number), [x.node_id for x in tree.leaves()])
            out.append(compose(wide, tree, self.config.tree, fps).select(*KEYS, "frame_idx", "score"))
        return reduce(DataFrame.unionByName, out)

    def select(self, grid: DataFrame, questions: Sequence[Question], features: dict[str, dict], k: int = 16, fps: float | None = None) -> DataFrame:
        """Ranked frames of every question: video_id, qid, rank, frame_idx, ts, score, phase; k = 0 gives none."""
        fps = fps or self.config.fps
        chosen = select(self.curves(grid, questions, features, fps), k, create_strategy(self.config.choice), fps)
        return chosen.select(*KEYS, "rank", "frame_idx", (F.col("frame_idx") / fps).alias("ts"), "score", "phase")

    def parse_table(self, questions: DataFrame, make: Callable[[], QueryParser] | None = None) -> DataFrame:
        """Questions (qid; question, candidates, tree (JSON) and video_id where there are such columns) -> qid, own (the video or null), tree, error.

        Each distinct question is parsed once, on executors, and the trees are written to the shared folder, so that a model isn't asked again.
        ``make`` makes a parser there; without it this selector's own is sent. A null qid is an error; of rows with the same qid and video one is kept.
        """
        if make is None and self.parser is not None:
            own = self.parser
            make = lambda: own
        kinds = {"question": "string", "candidates": "array<string>", "tree": "string", "video_id": "string"}
        rows = questions.select(F.col("qid").cast("string").alias("qid"), *[(F.col(c) if c in questions.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        rows = rows.dropDuplicates(["qid", "video_id"]).select("qid", F.col("video_id").alias("own"), "question", "candidates", "tree")
        texts = parsed(rows.select("question", "candidates", "tree").distinct(), make, self.config.experts, self.on_missing, self.config.temperature)
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("question", "candidates", "tree")])
        path = new_path(questions.sparkSession, "trees")
        error = F.when(F.col("qid").isNull(), F.lit("no qid")).otherwise(F.col("error"))
        rows.alias("a").join(texts.alias("b"), same).select("qid", "own", F.when(error.isNull(), F.col("bound")).alias("tree"), error.alias("error")).write.parquet(path)
        return questions.sparkSession.read.parquet(path)

    def curves_table(self, grid: DataFrame, trees: DataFrame, features: dict[str, dict], fps: float) -> DataFrame:
        """As ``curves`` for trees (qid, own, tree) in a table: one plan whatever their number and shapes.

        Leaves, trees and shapes stay rows; the driver holds the distinct queries alone, which are expressions of the plan.
        """
        if self.config.tree.block:
            raise ValueError("questions in a table go with whole timelines; use curves for blocks")
        named = trees.select(F.concat_ws("\x00", "qid", F.coalesce("own", F.lit(""))).alias("key"), "qid", "own", "tree").where("tree is not null")
        flat = leaf_table(named, "key").join(named.select("key", "qid", "own"), "key")
        path = new_path(grid.sparkSession, "leaves")
        flat.write.parquet(path)
        flat = grid.sparkSession.read.parquet(path)
        wanted: dict[str, list[str]] = {}
        for row in flat.select("expert", "query").distinct().orderBy("expert", "query").toLocalIterator():
            wanted.setdefault(row["expert"], []).append(row["query"])
        if not wanted:
            return grid.select("video_id", F.lit("").alias("qid"), "frame_idx", F.lit(0.0).alias("score")).where("false")
        scores = self.scores_of(grid, wanted, features, fps)
        asked = scores.join(flat.select("key", "own", "node_id", "expert", "query"), ["expert", "query"]).where(F.col("own").isNull() | (F.col("own") == F.col("video_id").cast("string")))
        # the key parts questions of one qid that are bound to several videos
        signals = self._cleaned(asked.select("video_id", F.col("key").alias("qid"), "node_id", "expert", "query", "frame_idx", "score"), fps, KEYS)
        out = leveled_curves(signals, flat.select(F.col("key").alias("qid"), "node_id", "node", "up"), self.config.tree, fps)
        return out.select("video_id", F.substring_index("qid", "\x00", 1).alias("qid"), "frame_idx", "score")

    def select_table(self, grid: DataFrame, questions: DataFrame, features: dict[str, dict], k: int = 16, fps: float | None = None, make: Callable[[], QueryParser] | None = None) -> DataFrame:
        """As ``select`` for a table of questions (see ``parse_table``), with a column ``error``: a question without a
        valid tree is one row that says why (its own video or null, no rank and frames). A question without a video is asked of all."""
        fps = fps or self.config.fps
        trees = self.parse_table(questions, make)
        chosen = select(self.curves_table(grid, trees, features, fps), k, create_strategy(self.config.choice), fps)
        chosen = chosen.select(*KEYS, "rank", "frame_idx", (F.col("frame_idx") / fps).alias("ts"), "score", "phase", F.lit(None).cast("string").alias("error"))
        kinds = {f.name: f.dataType for f in chosen.schema.fields}
        bad = trees.where("error is not null").withColumn("video_id", F.col("own"))
        return chosen.unionByName(bad.select(*[(F.col(c) if c in ("video_id", "qid", "error") else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))

    def select_stored(self, videos: DataFrame, grid: DataFrame, questions: Sequence[Question], lookup: FeatureLookup, given: dict[str, dict] | None = None, k: int = 16, fps: float | None = None) -> DataFrame:
        """As ``select``, features coming from a store: what it lacks is extracted once and kept.

        ``videos`` (video_id, path, ...) and their ``grid`` (video_id, frame_idx); only experts of the questions' trees are looked up, and
        only the videos that are asked about. ``given`` holds what no store has (query vectors, detections), or tables that win over stored ones.
        video_id comes out as a string, as the store has it.
        """
        fps, given = fps or self.config.fps, given or {}
        text = F.col("video_id").cast("string")
        videos, grid = videos.withColumn("video_id", text), grid.select(text.alias("video_id"), "frame_idx")
        if all(q.video_id is not None for q in questions):
            own = grid.sparkSession.createDataFrame([(str(q.video_id),) for q in questions], "video_id string").distinct()
            videos, grid = videos.join(own, "video_id", "left_semi"), grid.join(own, "video_id", "left_semi")
        experts = list(dict.fromkeys(leaf.expert for q in questions for leaf in self.bound(q.tree).leaves()))
        ready = {e for e in experts if any(name in given.get(e, {}) for name in ("frames", "segments", "texts", "detections"))}
        stored = lookup.features([e for e in experts if e not in ready], videos, grid, fps)
        features = {e: {**stored.get(e, {}), **given.get(e, {})} for e in experts}
        return self.select(grid, questions, features, k, fps)


def results(selected: DataFrame, truth: DataFrame, trees: dict[str, Node], fps: float) -> DataFrame:
    """One row per video and question: chosen frames in the order of choice, the curve, the tree, and the first choice as best."""
    rank = F.array_sort(F.collect_list(F.struct("rank", "frame_idx", "ts", "score")))
    frames = selected.groupBy(*KEYS).agg(rank.alias("r"))
    curve = truth.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "score"))).alias("c"))
    named = F.element_at(F.create_map(*[F.lit(x) for qid, tree in trees.items() for x in (qid, tree.to_json())]), F.col("qid"))
    rows = curve.join(frames, list(KEYS), "left")
    best = F.get("r", F.lit(0))
    return rows.select(
        *KEYS, F.col("r.frame_idx").alias("frame_indices"), F.col("r.ts").alias("timestamps"), F.col("r.score").alias("scores"), F.col("c.score").alias("truth_curve"), named.alias("tree"),
        F.size("c").alias("num_frames"), F.lit(float(fps)).alias("fps"), best["frame_idx"].alias("best_frame_idx"), best["ts"].alias("best_timestamp"), best["score"].alias("best_score"),
    )


def single(spark: SparkSession, selector: FrameSelector, video_id: str, n_frames: int, question: Question, features: dict[str, dict], k: int = 16) -> DataFrame:
    """``select`` for one video and question."""
    grid = spark.range(n_frames).select(F.lit(video_id).alias("video_id"), F.col("id").cast("int").alias("frame_idx"))
    return selector.select(grid, [question], features, k)
