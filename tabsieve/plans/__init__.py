"""Registered queries over the given tables."""

from tabsieve.plans import cleaning, evaluation, modelling, preparation, profiling  # noqa: F401
from tabsieve.plans.modelling import flagship
from tabsieve.plans.registry import QUERIES as REGISTERED
from tabsieve.plans.registry import SQL as ORACLES

__all__ = ["ORACLES", "REGISTERED", "flagship"]
