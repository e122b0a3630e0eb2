"""Question-driven selection over per-entity time series, and operators for it."""

from cuesift.config import PRESETS, Settings, preset
from cuesift.pipeline import FrameSelector, Question, results
from cuesift.plans.parsing import create_parser, register_parser
from cuesift.plans.tree import Node
from cuesift.sources.features import FeatureStore

__all__ = ["PRESETS", "FeatureStore", "FrameSelector", "Node", "Question", "Settings", "create_parser", "preset", "register_parser", "results"]
