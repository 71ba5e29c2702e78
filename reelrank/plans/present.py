"""Output formatting shared by the registered queries and their SQL oracles:
doubles rounded to 6 places, arrays rendered as strings, so results compare
by value hash across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def joined(col: Column | str, sort: bool = False, sep: str = "|") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    c = F.transform(c, lambda x: x.cast("string"))
    return F.array_join(F.array_sort(c) if sort else c, sep)


def present(df: DataFrame, sorted_arrays: tuple[str, ...] = (),
            ordered_arrays: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Round double/float columns; render the named array columns as
    ``|``-joined strings (sorted for sets, as-is for ordered lists)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in sorted_arrays:
            c = joined(c, sort=True).alias(f.name)
        elif f.name in ordered_arrays:
            c = joined(c).alias(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)
