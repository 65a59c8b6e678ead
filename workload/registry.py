"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a DataFrame built
with the library; each oracle is independent SQL over the same stand-in
rows (``workload.standins``). Column names are identical on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from workload.standins import SQL_CTES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# CTEs shared by several oracles (library-level semantics, written in SQL).
SHARED_CTES = {
    "stat": """stat AS (
  SELECT time, pop, opp_evt_ratio, n_count, abundance, fsc_med, chl_med, pe_med,
         diam_mid_med AS diameter, flag
  FROM stat_raw WHERE quantile = 50)""",
    "stat_f": """stat_f AS (
  SELECT * FROM stat WHERE NOT coalesce(CAST(flag AS VARCHAR) IN ('1', '2', '3'), false))""",
    "sfl": """sfl AS (
  SELECT date AS time, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon, conductivity,
         salinity, ocean_tmp, par, stream_pressure, event_rate, flag
  FROM sfl_raw)""",
    "sfl_f": """sfl_f AS (
  SELECT * FROM sfl WHERE NOT coalesce(CAST(flag AS VARCHAR) IN ('1', '2', '3'), false))""",
    "fp50": """fp50 AS (SELECT * EXCLUDE (date) FROM filter_params WHERE quantile = 50)""",
    # W1 + W2 + J1 on the events plan, capped at the last SFL time.
    "event_iv": """event_iv AS (
  SELECT start_date, filter_id,
         CASE WHEN rn = cnt AND end0 IS NULL THEN (SELECT max(time) FROM sfl) ELSE end0 END AS end_date
  FROM (SELECT start_date, filter_id,
               lead(start_date) OVER (ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS end0,
               row_number() OVER (ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS rn,
               count(*) OVER () AS cnt
        FROM event_filter_plan))""",
    "event_ivp": """event_ivp AS (
  SELECT i.*, fp.* EXCLUDE (id) FROM event_iv i LEFT JOIN fp50 fp ON i.filter_id = fp.id)""",
    "gating_iv": """gating_iv AS (
  SELECT start_date, gating_id,
         CASE WHEN rn = cnt AND end0 IS NULL THEN (SELECT max(time) FROM sfl) ELSE end0 END AS end_date
  FROM (SELECT start_date, gating_id,
               lead(start_date) OVER (ORDER BY start_date ASC NULLS LAST, gating_id ASC NULLS LAST) AS end0,
               row_number() OVER (ORDER BY start_date ASC NULLS LAST, gating_id ASC NULLS LAST) AS rn,
               count(*) OVER () AS cnt
        FROM gating_plan))""",
    "bead": """bead AS (SELECT date AS time, fsc_small, chl_small, pe, D1, D2 FROM beads_raw)""",
    # W1 + W2 + J1 on the orders plan, capped at the last bead time.
    "order_iv": """order_iv AS (
  SELECT start_date, filter_id,
         CASE WHEN rn = cnt AND end0 IS NULL THEN (SELECT max(time) FROM bead) ELSE end0 END AS end_date
  FROM (SELECT start_date, filter_id,
               lead(start_date) OVER (ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS end0,
               row_number() OVER (ORDER BY start_date ASC NULLS LAST, filter_id ASC NULLS LAST) AS rn,
               count(*) OVER () AS cnt
        FROM order_filter_plan))""",
    "order_ivp": """order_ivp AS (
  SELECT i.*, fp.* EXCLUDE (id) FROM order_iv i LEFT JOIN fp50 fp ON i.filter_id = fp.id)""",
    "bead_p": """bead_p AS (
  SELECT b.*, p.* EXCLUDE (quantile)
  FROM bead b LEFT JOIN order_ivp p
    ON p.start_date <= b.time AND (p.end_date IS NULL OR b.time < p.end_date))""",
    "vct": """vct AS (
  SELECT date AS time, pop_q50 AS pop, D1, D2, fsc_small, chl_small, pe, diam_mid_q50 AS diameter,
         Qc_mid_q50 AS qc, filter_id, gating_id
  FROM vct_raw WHERE q50)""",
    "decoded": """decoded AS (
  SELECT g.date, g.pop, g.n, g.Qc_sum, b1.fsc_small, b2.chl_small, b3.pe, b4.Qc,
         round(2.0::DOUBLE * pow(3.0::DOUBLE / (4.0::DOUBLE * pi()) * pow(b4.Qc / 0.261::DOUBLE, 1.0::DOUBLE / 0.86::DOUBLE),
                                 1.0::DOUBLE / 3.0::DOUBLE), 5) AS diam
  FROM gridded_raw g
  LEFT JOIN grid_bins_raw b1 ON g.fsc_small_coord = b1.idx
  LEFT JOIN grid_bins_raw b2 ON g.chl_small_coord = b2.idx
  LEFT JOIN grid_bins_raw b3 ON g.pe_coord = b3.idx
  LEFT JOIN grid_bins_raw b4 ON g.Qc_coord = b4.idx)""",
}

# Dependencies between CTEs (resolved in order of first need).
_ALL_CTES = {**SQL_CTES, **SHARED_CTES}


def _deps(sql: str) -> list[str]:
    found = []
    for name in _ALL_CTES:
        if re.search(rf"\b{name}\b", sql):
            found.append(name)
    return found


def with_ctes(body: str) -> str:
    """Prefix ``body`` with every CTE it (transitively) needs, in dependency order."""
    order: list[str] = []

    def visit(name: str, stack=()):
        if name in order or name in stack:
            return
        text = _ALL_CTES[name]
        inner = text.split(" AS (", 1)[1]
        for d in _deps(inner):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for d in _deps(body):
        visit(d)
    if not order:
        return body
    head = ",\n".join(_ALL_CTES[n] for n in order)
    stripped = body.lstrip()
    if stripped.upper().startswith("WITH "):
        # The body brings its own CTEs: merge them after the shared ones.
        return "WITH " + head + ",\n" + stripped[5:]
    return "WITH " + head + "\n" + body


def register(name: str, sql: str | None = None):
    """Decorator: register a Spark query builder and its oracle body."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn
    return deco
