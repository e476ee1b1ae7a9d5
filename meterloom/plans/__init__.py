"""Whole jobs composed of the operators."""

from meterloom.plans.activity import generate, train_activity
from meterloom.plans.decomposition import Decomposition, decompose
from meterloom.plans.streaming import stream_decompose

__all__ = ["Decomposition", "decompose", "generate", "stream_decompose", "train_activity"]
