"""One schema for files whose columns or types differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each type holds all values of those before it in its row.
_WIDER = (("tinyint", "smallint", "int", "bigint", "double"), ("float", "double"), ("date", "timestamp"), ("timestamp_ntz", "timestamp"))


def widened(a: str, b: str) -> str:
    """The narrowest type (as Spark's simple string) that holds the values of both; text if no other does."""
    if a == b:
        return a
    if "void" in (a, b):
        return b if a == "void" else a
    shared = [row for row in _WIDER if a in row and b in row]
    if shared:
        return max((a, b), key=shared[0].index)
    ups = [{t for row in _WIDER if x in row for t in row[row.index(x):]} for x in (a, b)]
    both = ups[0] & ups[1]
    return min(both, key=lambda t: min(row.index(t) for row in _WIDER if t in row)) if both else "string"


def merged_parquet(spark: SparkSession, paths) -> DataFrame:
    """S3 over files (or folders) of different columns: the union of their columns, types widened, a column that a
    path lacks NULL. Spark's own ``mergeSchema`` refuses types that differ.

    Each path's schema comes from its footers; paths with one schema are one scan, and filters and
    columns reach every scan.
    """
    groups: dict[tuple, list[str]] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        groups.setdefault(tuple(spark.read.parquet(path).dtypes), []).append(path)
    kinds: dict[str, str] = {}
    for schema in groups:
        for name, kind in schema:
            kinds[name] = widened(kinds.get(name, kind), kind)
    scans = [spark.read.parquet(*held).select(*[(F.col(f"`{n}`") if n in dict(schema) else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
             for schema, held in groups.items()]
    return reduce(DataFrame.unionByName, scans)
