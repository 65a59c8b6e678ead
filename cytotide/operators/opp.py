"""Particle selection by active filter parameters.

The selection rule of the reference lives in an external package that is
not part of it; what is visible is the alignment test, the parameter names
(notch / offset x small / large x D1 / D2, width) and the line form
``y = notch * fsc_small + offset``. ``opp_predicate`` implements the rule
proposed from that evidence and is documented as such — no parity is
claimed for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytotide.functions.columns import QUANTILES, quantile_tag
from cytotide.operators.filters import aligned

FILTER_PARAM_COLUMNS = (
    "width",
    "notch_small_D1", "offset_small_D1", "notch_small_D2", "offset_small_D2",
    "notch_large_D1", "offset_large_D1", "notch_large_D2", "offset_large_D2",
)


def replicate_quantiles(params: DataFrame, quantiles=QUANTILES, col: str = "quantile") -> DataFrame:
    """One copy of each parameter row per quantile (an explode of a
    literal array, not a join)."""
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    return params.drop(col).withColumn(col, F.explode(qs))


def quantile_sets(params: DataFrame, quantiles=QUANTILES, key: str = "id", quantile: str = "quantile", by=()) -> DataFrame:
    """J12 without copies: one row per parameter id with ``params``, an array of one struct (quantile and parameters)
    for each of the quantiles that the id has, in ascending order.

    Of several rows for an id and quantile the least is taken. An id has as many structs as there are quantiles.
    """
    names = [c for c in params.columns if c not in {*by, key, quantile}]
    some = params.where(F.col(quantile).isin([float(q) for q in quantiles]))
    one = some.groupBy(*by, key, quantile).agg(F.min(F.struct(*names)).alias("__p"))
    each = F.struct(F.col(quantile).cast("double").alias("quantile"), *[F.col(f"__p.{n}").alias(n) for n in names])
    return one.groupBy(*by, key).agg(F.array_sort(F.collect_list(each)).alias("params"))


def opp_predicate(fsc: str = "fsc_small", d1: str = "D1", d2: str = "D2", param: Callable[[str], Column] = F.col) -> Column:
    """Proposed OPP rule: aligned, and below both D1/D2 lines of either the
    small- or the large-particle parameter set. ``param`` finds a parameter by name (a column by default)."""
    x = F.col(fsc)

    def below(kind: str) -> Column:
        return ((F.col(d1) <= param(f"notch_{kind}_D1") * x + param(f"offset_{kind}_D1"))
                & (F.col(d2) <= param(f"notch_{kind}_D2") * x + param(f"offset_{kind}_D2")))

    return aligned(d1, d2, param("width")) & (below("small") | below("large"))


def passed_quantiles(params: str = "params") -> Column:
    """The quantiles whose parameters (``quantile_sets``) a particle passes, ascending; none without parameters. Each
    particle is judged once against its interval's array: no copies of particles or of parameter rows."""
    passing = F.filter(F.col(params), lambda p: F.coalesce(opp_predicate(param=p.getField), F.lit(False)))
    return F.coalesce(F.transform(passing, lambda p: p.getField("quantile")), F.array().cast("array<double>"))


def select_opp(particles: DataFrame, quantiles=None, params: str = "params") -> DataFrame:
    """Q1: particles (with their active parameter columns attached) that pass
    the filter. Particles with no active parameters never pass.

    ``quantiles=None``: by the one set of parameter columns, evaluated once (the quantile
    copies of a parameter row, J12, carry the same values). With quantiles, by the parameters of
    each in the array ``params``: particles that pass any of them stay, with a flag ``q<quantile>``
    for each, as in VCT files.
    """
    if quantiles is None:
        return particles.where(F.coalesce(opp_predicate(), F.lit(False)))
    passed = particles.withColumn("__passed", passed_quantiles(params))
    flags = {f"q{quantile_tag(q)}": F.array_contains("__passed", F.lit(float(q))) for q in quantiles}
    any_ = F.exists("__passed", lambda q: q.isin([float(x) for x in quantiles]))
    return passed.where(any_).withColumns(flags).drop("__passed", params)
