"""Keeping an expression from being planned more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it.

    Without it every reference repeats the whole expression in the plan. One ``let`` in
    the body of another must not be an argument of a Python function: the planner then
    fails to hand the call to Python.
    """
    return F.transform(F.array(value), body)[0]


def once(python_function):
    """A Python function that is called once per row.

    The optimizer copies deterministic calls: a filter on the result is moved below the
    projection that computes it, and then both call Python. Filters on other columns are
    not moved below such a call either, so jobs filter before they parse.
    """
    return python_function.asNondeterministic()


def pinned(value: Column) -> Column:
    """The value, marked like ``once`` without Python: filters on it are not moved below its projection."""
    return F.when(F.spark_partition_id() >= 0, value)
