"""All registered queries."""

from vernissage.plans import (  # noqa: F401
    audit,
    features,
    imagery,
    knowledge,
    modelling,
    relational,
    text,
    validation,
    vectors,
)
from vernissage.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
