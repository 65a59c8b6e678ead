"""Zone maps of Parquet files: what footers tell of each file, without reading a row group.

A zone map has a row per file: its number of rows and, for each column asked
for, the least and greatest value and the number of nulls. Footers are read in
tasks, many files each. Windows over any column then open only files that may
hold a part of them, and extents come from the map alone. Files whose footer
doesn't tell (no statistics, INT96 times, a writer that saw NaN) are read.

Footers are opened through Arrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cytotide.functions.numeric import nan_to_null
from cytotide.operators.joins import materialize

PARQUET_GLOB = "*.parquet"
#: Footers that one task reads, about.
FILES_PER_TASK = 64


def arrow_path(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The Arrow file system of a path as Spark writes it, and the path there."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def footer(path: str, columns: list[str]) -> dict:
    """Rows of a file, and per column whether the footer tells its extent, the extent, and the nulls."""
    import pyarrow.parquet as pq
    system, name = arrow_path(path)
    with system.open_input_file(name) as f:
        meta = pq.read_metadata(f)
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
    out: dict = {"path": path, "rows": meta.num_rows}
    for c in columns:
        known, least, most, nulls = True, [], [], 0
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            if not group.num_rows:
                continue
            stats = group.column(at[c]).statistics if c in at else None
            if c not in at:  # a column that the file lacks is null
                nulls += group.num_rows
            elif stats is not None and stats.has_null_count and stats.null_count == group.num_rows:
                nulls += stats.null_count
            elif stats is None or not stats.has_min_max or not stats.has_null_count or stats.min != stats.min or stats.max != stats.max:
                known = False
            else:
                least.append(stats.min)
                most.append(stats.max)
                nulls += stats.null_count
        out |= {f"{c}_known": known, f"{c}_min": min(least, default=None) if known else None,
                f"{c}_max": max(most, default=None) if known else None, f"{c}_nulls": nulls if known else None}
    return out


def zone_map(spark: SparkSession, paths, columns, schema=None) -> DataFrame:
    """(path, rows) and ``{c}_known, {c}_min, {c}_max, {c}_nulls`` for each column, a row per Parquet file under the
    paths; written once. ``schema`` (a DataFrame's) saves reading one from the files."""
    paths, columns = [paths] if isinstance(paths, str) else list(paths), list(columns)
    schema = schema or spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET_GLOB).parquet(*paths).schema
    kinds = {c: schema[c].dataType for c in columns}
    fields = [pa.field("path", pa.string()), pa.field("rows", pa.int64())]
    told = ["path string", "rows long"]
    for c, kind in kinds.items():
        value = to_arrow_type(kind)
        fields += [pa.field(f"{c}_known", pa.bool_()), pa.field(f"{c}_min", value), pa.field(f"{c}_max", value), pa.field(f"{c}_nulls", pa.int64())]
        told += [f"`{c}_known` boolean", f"`{c}_min` {kind.simpleString()}", f"`{c}_max` {kind.simpleString()}", f"`{c}_nulls` long"]
    arrow = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([footer(p, columns) for p in b.column(0).to_pylist()], schema=arrow)

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", PARQUET_GLOB).load(paths).select("path"))
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    return materialize(files.repartition(tasks).mapInArrow(work, ", ".join(told)))


def may_hold(column: str, start=None, end=None) -> Column:
    """Zones that may hold values in [start, end); an absent bound is open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(f"{column}_max") >= F.lit(start))
    if end is not None:
        inside = inside & (F.col(f"{column}_min") < F.lit(end))
    return ~F.col(f"{column}_known") | F.coalesce(inside, F.lit(False))


def read_window(spark: SparkSession, zones: DataFrame, column: str, start=None, end=None, schema=None) -> DataFrame:
    """Rows with ``column`` in [start, end), from the files whose zone may hold some. Their paths pass the
    driver, as those of any scan do. ``schema`` is that of the empty result if no file does."""
    paths = [r.path for r in zones.where(may_hold(column, start, end)).select("path").collect()]
    if not paths:
        if schema is None:
            first = zones.select("path").first()
            schema = spark.read.parquet(first.path).schema if first else "path string"
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(*paths)
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) < F.lit(end))


def zone_range(spark: SparkSession, zones: DataFrame, columns) -> DataFrame:
    """``{c}_min, {c}_max`` over all files (NaN and null are missing): one row. Files that don't tell a column's
    extent are scanned for it, and for nothing else."""
    columns = list(columns)
    out = zones.agg(*[f(f"{c}_{what}").alias(f"{c}_{what}") for c in columns for what, f in (("min", F.min), ("max", F.max))])
    untold = {c: [r.path for r in zones.where(~F.col(f"{c}_known")).select("path").collect()] for c in columns}
    for paths in {tuple(p) for p in untold.values() if p}:
        some = [c for c in columns if tuple(untold[c]) == paths]
        kinds = T.StructType([T.StructField(c, zones.schema[f"{c}_min"].dataType) for c in some])
        told = {c: nan_to_null(c) if isinstance(kinds[c].dataType, T.FractionalType) else F.col(c) for c in some}
        read = spark.read.schema(kinds).parquet(*paths).agg(
            *[f(told[c]).alias(f"{c}_{w}") for c in some for w, f in (("min", F.min), ("max", F.max))])
        both = {f"{c}_{w}": F.col(f"{c}_{w}") for c in columns for w in ("min", "max")}
        packed = read.select(F.struct("*").alias("s")).scalar()
        both |= {f"{c}_{w}": f(F.col(f"{c}_{w}"), packed.getField(f"{c}_{w}")) for c in some for w, f in (("min", F.least), ("max", F.greatest))}
        out = out.select(*[v.alias(k) for k, v in both.items()])
    return out
