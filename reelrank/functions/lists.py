"""Ordered-list helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(value: Column | str, order: Column | str) -> Column:
    """Aggregate expression: the ``value``s of a group ordered by ``order``.

    ``collect_list`` alone has no defined order after a shuffle; collecting
    (order, value) structs and sorting them makes the order explicit.  Use on
    groups whose size is bounded upstream (a top-k), never on raw groups.
    """
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v"))))
    return F.transform(pairs, lambda s: s["v"])


def sorted_key(arr: Column | str, sep: str = "|") -> Column:
    """Canonical string form of a set-valued array: sorted and joined."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.array_sort(a), sep)
