"""Rashomon sets of sparse decision trees as Spark jobs."""

from .plans.importance import Importance, subtractive_reliance
from .plans.model import Options, RashomonModel, fit, load
from .sources import binary_table, read_binary_csv, split_columns

__all__ = [
    "Importance",
    "Options",
    "RashomonModel",
    "binary_table",
    "fit",
    "load",
    "read_binary_csv",
    "split_columns",
    "subtractive_reliance",
]
