"""Weightless (n-tuple, lookup-table) learning on Spark tables and streams."""

from .operators.address import BitColumn, Mapping, ThresholdBits, random_mapping
from .operators.bloom import BloomModel, HashFamily
from .operators.cluster import ClusterModel, Rule
from .operators.count_model import CountModel, Options
from .operators.encode import Thermometer
from .operators.network import BloomLayer, LutNetwork
from .operators.regress import RegressionModel
from .operators.tune import TunedBloom

__all__ = [
    "BitColumn", "BloomLayer", "BloomModel", "ClusterModel", "CountModel", "HashFamily",
    "LutNetwork", "Mapping", "Options", "RegressionModel", "Rule", "Thermometer",
    "ThresholdBits", "TunedBloom", "random_mapping",
]
