"""Imports every module that registers queries."""

from checks import ensembles, etl, evaluation, features, inventory, learned, serving  # noqa: F401
from checks.base import ORACLE, QUERIES  # noqa: F401
