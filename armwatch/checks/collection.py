"""Collection metrics."""

from pyspark.sql import functions as F

from armwatch.checks.base import over_collections, quoted, register
from armwatch.operators import mergeable
from armwatch.operators.prepare import period_start
from armwatch.plans import collection
from armwatch.session import stored
from armwatch.sources.collections import collections

_QUANTILES = {"median": .5, "quantile_025": .025, "quantile_975": .975}


def _metrics(source: str, strata: list[str], measures: dict[str, str], sample: bool,
             label: bool = False) -> str:
    """Long rows of the five metrics per measure."""
    keys = "".join(f"{quoted(k)}, " for k in strata)
    shown = "".join(f"'overall' AS {quoted(k)}, " for k in ["site"]) if label else keys
    group = f"GROUP BY {keys.rstrip(', ')}" if strata else ""
    spread = "stddev_samp" if sample else "stddev_pop"
    parts = []
    for name, expression in measures.items():
        metrics = {"mean": f"avg({expression})", "sd": f"{spread}({expression})",
                   **{m: f"quantile_cont({expression}, {q})" for m, q in _QUANTILES.items()}}
        parts += [f"""SELECT {shown}'{name}' AS variable, '{m}' AS metric,
                  round({e}, 6) AS value FROM {source} {group}""" for m, e in metrics.items()]
    return " UNION ALL ".join(f"SELECT * FROM ({p}) WHERE value IS NOT NULL" for p in parts)


def _devices(name: str, strata: list[str], pop: str) -> str:
    keys = "".join(f"{quoted(k)}, " for k in strata)
    return f"""
{name}_weekly AS (SELECT {keys}dev_id, week, count(DISTINCT col_id) AS c FROM collections
                  WHERE {pop} GROUP BY ALL),
{name} AS (SELECT {keys}dev_id, avg(c) AS per_week FROM {name}_weekly GROUP BY ALL)"""


def _counts(strata: list[str], pop: str, label: bool = False) -> str:
    keys = "".join(f"{quoted(k)}, " for k in strata)
    shown = "'overall' AS site, " if label else keys
    group = f"GROUP BY {keys.rstrip(', ')}" if strata else ""
    parts = [f"""SELECT {shown}'{c}' AS variable, 'nunique' AS metric,
             CAST(count(DISTINCT {c}) AS DOUBLE) AS value FROM chosen {group}"""
             for c in ("col_id", "dev_id")]
    if strata:
        parts += [f"""SELECT {keys}'{c}', 'pct_total',
                  round(100.0 * n / sum(n) OVER (), 6)
                  FROM (SELECT {keys}count(DISTINCT {c}) AS n FROM chosen {group})"""
                  for c in ("col_id", "dev_id")]
    return " UNION ALL ".join(parts)


_MEASURES = {m: m for m in collection.MEASURES}
_WEEKLY = {collection.WEEKLY: "per_week"}


def _chosen(pop: str) -> str:
    return f"chosen AS (SELECT * FROM collections WHERE {pop})"


_FLAGS = ("all_ae", "non_hyp", "hyp", "sig_hyp", "only_1.1")


def _with_flags(rows: str, label: bool = False) -> str:
    """Rows without ``n``, and the values of the severity flags of the whole table with theirs."""
    site = "'overall' AS site, " if label else ""
    counted = " UNION ALL ".join(
        f"""SELECT {site}'{f}' AS variable, 'flags' AS metric, CAST({quoted(f)} AS DOUBLE) AS value,
        count(*) AS n FROM chosen WHERE {quoted(f)} IS NOT NULL GROUP BY ALL""" for f in _FLAGS)
    return f"SELECT *, CAST(NULL AS BIGINT) AS n FROM ({rows}) UNION ALL {counted}"


for _strata, _pop in ((["site"], "itt"), (["group", "gender"], "mitt"), ([], "pp")):
    _name = "_".join(_strata) or "overall"
    register(f"collection_counts_{_name}",
             lambda s, d, k=_strata, p=_pop: collection.count_summary(collections(s, d), k, p),
             over_collections(
                 f"{_counts(_strata, _pop)} UNION ALL "
                 f"{_metrics('devices', _strata, _WEEKLY, bool(_strata))}",
                 _chosen(_pop), _devices("devices", _strata, _pop)))
    register(f"collection_measures_{_name}",
             lambda s, d, k=_strata, p=_pop: collection.plasma_summary(collections(s, d), k, p),
             over_collections(
                 _metrics("chosen", _strata, _MEASURES, True) if _strata else
                 _with_flags(_metrics("chosen", [], _MEASURES, False)), _chosen(_pop)))

register("collection_counts_complete_grid",
         lambda s, d: collection.count_summary(collections(s, d), ["site"], "itt", complete=True),
         over_collections(
             f"{_counts(['site'], 'itt')} UNION ALL "
             f"{_metrics('devices', ['site'], _WEEKLY, True)}", _chosen("itt"), """
weekly AS (SELECT site, dev_id, week, count(DISTINCT col_id) AS c FROM collections GROUP BY ALL),
devices AS (
  SELECT g.site, g.dev_id, avg(coalesce(c, 0)) AS per_week
  FROM (SELECT * FROM (SELECT DISTINCT site FROM weekly), (SELECT DISTINCT dev_id FROM weekly),
                      (SELECT DISTINCT week FROM weekly)) g
  LEFT JOIN weekly w ON w.site = g.site AND w.dev_id = g.dev_id AND w.week = g.week
  GROUP BY g.site, g.dev_id)"""))

register("collection_summary", lambda s, d: collection.summary(collections(s, d), ["site"], "itt"),
         over_collections(_with_flags(" UNION ALL ".join((
             _counts(["site"], "itt"), _metrics("devices", ["site"], _WEEKLY, True),
             _metrics("chosen", ["site"], _MEASURES, True),
             _counts([], "itt", True), _metrics("all_devices", [], _WEEKLY, False, True),
             _metrics("chosen", [], _MEASURES, False, True))), True),
             _chosen("itt"), _devices("devices", ["site"], "itt"),
             _devices("all_devices", [], "itt")))


def _raw(strata: str, measures: dict[str, str], metric: str, shown: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT {shown}, '{m}' AS variable, '{metric}' AS metric, value, count(*) AS n
        FROM (SELECT {strata or "1 AS one"}, CAST({e} AS DOUBLE) AS value FROM chosen)
        GROUP BY ALL""" for m, e in measures.items())


# Values are compared at six digits, so equal rounded values are added up on both sides.
def _rounded_distribution(spark, sf_dir):
    from pyspark.sql import functions as F
    rows = collection.distribution(collections(spark, sf_dir), ["site"], "mitt")
    return rows.groupBy("site", "variable", "metric", F.round("value", 6).alias("value")).agg(
        F.sum("n").alias("n"))


register("collection_distribution", _rounded_distribution, over_collections(
    "SELECT site, variable, metric, value, CAST(sum(n) AS BIGINT) AS n FROM ("
    "SELECT site, variable, metric, round(value, 6) AS value, n FROM ("
    + " UNION ALL ".join((
        _raw("site", _MEASURES, "raw_data", "site"),
        _raw("", _MEASURES, "raw_data", "'overall' AS site"),
        _raw("", {f: f'CAST("{f}" AS INT)' for f in _FLAGS}, "flags", "'overall' AS site"))) + ") UNION ALL "
    "SELECT site, variable, metric, value, NULL FROM ("
    + _metrics("chosen", ["site"], _MEASURES, True) + " UNION ALL "
    + _metrics("chosen", [], _MEASURES, False, True) + ")) GROUP BY ALL", _chosen("mitt")))


def _sketched_quantiles(spark, sf_dir):
    """Quantiles of two years from monthly cells, with their rank held against the rows."""
    data = collections(spark, sf_dir).withColumn("month", period_start(F.col("col_date"), "month"))
    measures, years = ["duration_minutes", "actual_vol"], F.col("month").between(
        F.lit("1996-01-01").cast("date"), F.lit("1997-12-01").cast("date"))
    cells = stored(mergeable.quantile_sketches(data, ["site", "month"], measures))
    found = mergeable.sketched_quantiles(cells.where(years), ["site"], [.025, .5, .975])
    return mergeable.rank_error(found, data.where(years), ["site"], measures).select(
        "site", "variable", "prob", "n", (F.col("error") < .02).alias("near"))


register("collection_sketched_quantiles", _sketched_quantiles, over_collections(" UNION ALL ".join(
    f"""SELECT site, '{m}' AS variable, CAST({p} AS DOUBLE) AS prob, count({m}) AS n, TRUE AS near
    FROM collections WHERE col_date >= DATE '1996-01-01' AND col_date < DATE '1998-01-01'
    GROUP BY site""" for m in ("duration_minutes", "actual_vol") for p in (.025, .5, .975))))
