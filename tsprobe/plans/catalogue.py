"""All registered queries; importing this module fills the registry."""

from tsprobe.plans import evaluation, leaderboard, probing, reading, sampling, streams, texts, windowing  # noqa: F401
from tsprobe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
