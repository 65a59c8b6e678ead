"""Join helpers: broadcast only behind a measured size bound.

``sized_broadcast`` first materialises the (small, derived) side once with a
reliable ``checkpoint()`` into the cluster's shared ``spark.checkpoint.dir``
— so measuring it never re-runs its lineage (which may include a pass over
particle data) — then adds up the bytes of its values. Under the bound the side is hinted for broadcast; above it the checkpointed
frame is returned unhinted and Spark plans a shuffle join (with AQE
skew-join splitting of hot keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default bound for a broadcast side (bytes, estimated); a session may set
# ``spark.cytotide.broadcastMaxBytes`` instead.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_CONF = "spark.cytotide.broadcastMaxBytes"


def broadcast_bound(df: DataFrame) -> int:
    """The byte bound for broadcast sides in ``df``'s session."""
    v = df.sparkSession.conf.get(BROADCAST_CONF, None)
    return int(v) if v else DEFAULT_BROADCAST_BYTES


def _type_bytes(dt: T.DataType) -> int:
    """Estimated width of one value (Spark's default sizes; 20 bytes per text value)."""
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return 20
    if isinstance(dt, T.DecimalType):
        return 8 if dt.precision <= 18 else 16
    if isinstance(dt, T.ArrayType):
        return 4 * _type_bytes(dt.elementType)
    if isinstance(dt, T.MapType):
        return 4 * (_type_bytes(dt.keyType) + _type_bytes(dt.valueType))
    if isinstance(dt, T.StructType):
        return sum(_type_bytes(f.dataType) for f in dt.fields)
    return 8


def _value_bytes(c, dt: T.DataType):
    """Bytes of a column's values, texts and arrays at their real length (a Column)."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
    if isinstance(dt, T.ArrayType):
        if isinstance(dt.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            inner = F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + _value_bytes(x, dt.elementType).cast("long"))
        else:
            inner = F.size(c).cast("long") * F.lit(max(1, _type_bytes(dt.elementType)))
        return F.when(c.isNull(), F.lit(16)).otherwise(F.lit(16) + inner)
    if isinstance(dt, T.StructType):
        total = F.lit(16)
        for f in dt.fields:
            total = total + _value_bytes(c.getField(f.name), f.dataType)
        return total
    if isinstance(dt, T.MapType):
        return F.lit(32) + _value_bytes(F.map_keys(c), T.ArrayType(dt.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(dt.valueType))
    return F.lit(8)


def row_bytes(df: DataFrame):
    """Bytes of a row's values, texts and arrays at their real length (a Column)."""
    size = F.lit(8).cast("long")
    for f in df.schema.fields:
        size = size + _value_bytes(F.col(f"`{f.name}`"), f.dataType)
    return size


def broadcast_fits(df: DataFrame, max_bytes: int | None = None) -> bool:
    """True when the rows of ``df`` take at most ``max_bytes``, measured.

    Runs one aggregate; only call it on sides that are small by design and
    materialised (plans, parameters, bin tables, per-key aggregates), never on particle data.
    """
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= (max_bytes or broadcast_bound(df))


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: an eager reliable checkpoint in
    the shared checkpoint folder (survives executor loss; never local)."""
    from cytotide.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized_broadcast(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Materialise ``df``; ``F.broadcast`` it when it fits the bound, else
    return it for a shuffle join."""
    small = materialize(df)
    return F.broadcast(small) if broadcast_fits(small, max_bytes) else small


def scalar_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    Written as one uncorrelated scalar subquery (a struct of all columns):
    Spark runs it once and inlines the value — no join, no cross product.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("__s")).scalar()
    return df.withColumns({c: packed.getField(c) for c in cols})


def keyed_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
               fits: bool | None = None) -> DataFrame:
    """Join a per-key aggregate (one row per key) back to a possibly huge ``df``.

    With no keys the aggregate is a single row and ``scalar_join`` is used.
    ``fits=True`` means the caller already measured a superset of ``small``
    (e.g. the checkpoint it was folded from): broadcast without a new check.
    Otherwise the aggregate is materialised and measured (``sized_broadcast``).
    """
    if not keys:
        return scalar_join(df, small)
    if fits is True:
        return df.join(F.broadcast(small), on=keys, how=how)
    if fits is False:
        return df.join(small, on=keys, how=how)
    return df.join(sized_broadcast(small), on=keys, how=how)


def plan_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join two plan- or parameter-sized tables (never particle data).

    No hint and no eager size probe: Spark's planner broadcasts from its
    statistics, and AQE re-plans from measured shuffle sizes at run time.
    With no keys ``small`` must be one row (``scalar_join``).
    """
    if not keys:
        return scalar_join(df, small)
    return df.join(small, on=keys, how=how)
