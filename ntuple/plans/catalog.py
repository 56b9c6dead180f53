"""All registered queries."""

from . import classifying, encoding, modelling, preparing
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "classifying", "encoding", "modelling", "preparing"]
