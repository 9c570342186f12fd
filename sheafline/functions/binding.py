"""Named intermediate values inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Env = dict[str, Column]


def let(stages: list[Callable[[Env], Env]], env: Env) -> Column:
    """The struct of all that the stages compute, each value bound once.

    Stacked ``withColumn`` calls would be substituted into each other by the optimizer, and an expression used by
    twenty later columns would be copied twenty times, again and again; a lambda variable is never copied.
    """
    if not stages:
        return F.struct(*(c.alias(n) for n, c in env.items()))
    env = env | stages[0](env)
    return bind(F.struct(*(c.alias(n) for n, c in env.items())), lambda x: let(stages[1:], {n: x[n] for n in env}))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
