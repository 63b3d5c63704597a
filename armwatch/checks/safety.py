"""Safety reports."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from armwatch.checks.base import counted, over_collections, quoted, register
from armwatch.columns import col
from armwatch.operators import mergeable
from armwatch.operators.prepare import period_start
from armwatch.plans import safety
from armwatch.session import scratch_dir, stored
from armwatch.sources.collections import collections, safety_view
from armwatch.streaming import partials

SEVERITIES = ("all_ae", "non_hyp", "hyp", "sig_hyp", "only_1.1")


def _data(spark, sf_dir, quartiles=False):
    return safety_view(collections(spark, sf_dir, quartiles))


def _arms(flags: tuple[str, ...], pop: str = "itt") -> str:
    """CTEs: per-arm counts and the same with their total."""
    sums = ", ".join(f"{counted(quoted(f))} AS {quoted(f)}" for f in flags)
    adds = ", ".join(f"CAST(sum({quoted(f)}) AS BIGINT)" for f in flags)
    return f"""
arms AS (SELECT "group", {sums}, count(DISTINCT col_id) AS col_id
         FROM collections WHERE {pop} GROUP BY "group"),
both_arms AS (SELECT * FROM arms UNION ALL
              SELECT 'grand_total', {adds}, CAST(sum(col_id) AS BIGINT) FROM arms)"""


_DONATION = """
per_donor AS (SELECT "group", don_id, count(DISTINCT col_id) AS c FROM collections GROUP BY ALL),
means AS (SELECT "group", avg(c) AS m FROM per_donor GROUP BY "group"),
arm AS (SELECT c."group", count(DISTINCT don_id) AS d, count(DISTINCT col_id) AS n, max(m) AS m
        FROM collections c JOIN means USING ("group") GROUP BY c."group"),
donat AS (
  SELECT "group", d AS don_id_nunique, n AS col_id_nunique,
         100.0 * n / (SELECT sum(n) FROM arm) AS col_id_pct, m AS col_per_don_mean FROM arm
  UNION ALL
  SELECT 'grand_total', CAST(sum(d) AS BIGINT), CAST(sum(n) AS BIGINT), 100.0 * sum(n) / 60000,
         sum(m * n) / sum(n) FROM arm)"""

register("safety_summary_donation", lambda s, d: safety.summary_donat(_data(s, d)),
         over_collections("""
SELECT "group", don_id_nunique, col_id_nunique, round(col_id_pct, 6) AS col_id_pct,
       round(col_per_don_mean, 6) AS col_per_don_mean FROM donat""", _DONATION))

_RISK = " UNION ALL ".join(f"""
SELECT "group", '{f}' AS variable, 'sum' AS metric, CAST("{f}" AS DOUBLE) AS value FROM both_arms
UNION ALL
SELECT "group", '{f}', 'pct', round(100.0 * "{f}" / col_id, 6) FROM both_arms"""
                           for f in SEVERITIES)

register("safety_summary_risk", lambda s, d: safety.summary_risk(_data(s, d)),
         over_collections(_RISK, _arms(SEVERITIES)))

register("safety_general_summary", lambda s, d: safety.general_summary(_data(s, d)),
         over_collections(f"""
SELECT *, 'risk' AS part FROM ({_RISK})
UNION ALL SELECT "group", 'don_id', 'nunique', CAST(don_id_nunique AS DOUBLE), 'donation' FROM donat
UNION ALL SELECT "group", 'col_id', 'nunique', CAST(col_id_nunique AS DOUBLE), 'donation' FROM donat
UNION ALL SELECT "group", 'col_id', 'pct', round(col_id_pct, 6), 'donation' FROM donat
UNION ALL SELECT "group", 'col_per_don', 'mean', round(col_per_don_mean, 6), 'donation' FROM donat
""", _arms(SEVERITIES), _DONATION))


def _aes_sql(sev: str, codes: tuple[str, ...], pop: str, conditional: bool,
             form: str = "long") -> str:
    flags = (sev, *codes)
    base = quoted(sev) if conditional else "col_id"
    rows = " UNION ALL ".join(
        f"""SELECT "group", '{f}' AS variable, CAST("{f}" AS DOUBLE) AS sum,
            round(100.0 * "{f}" / nullif({base}, 0), 6) AS pct FROM both_arms""" for f in flags)
    own = ("CAST(NULL AS DOUBLE)" if conditional else
           "round(100.0 * col_id / (SELECT sum(col_id) FROM arms), 6)")
    rows += f""" UNION ALL SELECT "group", 'col_id', CAST(col_id AS DOUBLE), {own} FROM both_arms"""
    body = {
        "long": f"""SELECT "group", variable, 'sum' AS metric, sum AS value FROM ({rows})
                    UNION ALL SELECT "group", variable, 'pct', pct FROM ({rows})""",
        "rows": rows,
        "pie": f"""SELECT variable, sum, pct FROM ({rows}) WHERE "group" = 'grand_total'""",
    }[form]
    return over_collections(body, _arms(flags, pop))


register("safety_summary_events", lambda s, d: safety.summary_aes(_data(s, d), "non_hyp", "mitt"),
         _aes_sql("non_hyp", ("2.1", "3.1"), "mitt", False))
register("safety_summary_events_conditional",
         lambda s, d: safety.summary_aes(_data(s, d), "all_ae", "pp", conditional=True),
         _aes_sql("all_ae", ("1.1", "1.2", "2.1", "3.1"), "pp", True))
register("safety_event_summary", lambda s, d: safety.event_summary(_data(s, d), "sig_hyp", "itt"),
         _aes_sql("sig_hyp", ("1.2",), "itt", False, "rows"))
register("safety_event_piechart",
         lambda s, d: safety.event_piechart(_data(s, d), "all_ae", "itt"),
         _aes_sql("all_ae", ("1.1", "1.2", "2.1", "3.1"), "itt", True, "pie"))


def _sev_sql(strata: tuple[str, ...], sev: str, pop: str, body: str | None = None) -> str:
    """Counts over the level grid, percent within parents, then one SELECT per prefix."""
    keys = ", ".join(quoted(k) for k in strata)
    grid = ", ".join(f"(SELECT DISTINCT {quoted(k)} FROM collections)" for k in strata)
    match = " AND ".join(f"c.{quoted(k)} = g.{quoted(k)}" for k in strata)
    parents = ", ".join(quoted(k) for k in strata[:-1])
    part = f"PARTITION BY {parents}" if parents else ""
    ctes = f"""
cells AS (SELECT {", ".join("g." + quoted(k) for k in strata)},
                 {counted(f'c.{pop} AND c.{quoted(sev)}')} AS sum
          FROM (SELECT * FROM {grid}) g LEFT JOIN collections c ON {match} GROUP BY ALL),
shares AS (SELECT {keys}, sum, 100.0 * sum / nullif(sum(sum) OVER ({part}), 0) AS pct FROM cells),
stacked AS ({" UNION ALL ".join(_prefix(strata, depth) for depth in range(len(strata) + 1))})"""
    return over_collections(body or f"SELECT {keys}, sum, round(pct, 6) AS pct FROM stacked", ctes)


def _prefix(strata: tuple[str, ...], depth: int) -> str:
    labels = [quoted(k) for k in strata[:depth]]
    if depth < len(strata):
        labels.append("'grand_total'" if depth == 0 else
                      " || ' | ' || ".join(labels) + " || ' - subtotal'")
        labels += ["' '"] * (len(strata) - depth - 1)
    names = ", ".join(f"{label} AS {quoted(k)}" for label, k in zip(labels, strata))
    group = f"GROUP BY {', '.join(quoted(k) for k in strata[:depth])}" if depth else ""
    return f"SELECT {names}, CAST(sum(sum) AS BIGINT) AS sum, sum(pct) AS pct FROM shares {group}"


register("safety_summary_severity_one_stratum",
         lambda s, d: safety.summary_sev(_data(s, d), ["gender"], "sig_hyp", "mitt"),
         _sev_sql(("gender",), "sig_hyp", "mitt"))
register("safety_summary_severity_three_strata",
         lambda s, d: safety.summary_sev(_data(s, d), ["site", "group", "gender"], "non_hyp"),
         _sev_sql(("site", "group", "gender"), "non_hyp", "itt"))
register("safety_severity_bargraph",
         lambda s, d: safety.severity_bargraph(_data(s, d, True), ["site", "weight"],
                                                "only_1.1", "pp"),
         _sev_sql(("site", "weight_cat"), "only_1.1", "pp",
                  "SELECT site, weight_cat AS weight, sum, round(pct, 6) AS pct FROM stacked"))
register("safety_severity_piechart",
         lambda s, d: safety.severity_piechart(_data(s, d), ["site"], "sig_hyp", "mitt"),
         _sev_sql(("group", "site"), "sig_hyp", "mitt", """
SELECT "group", site, sum,
       CASE WHEN "group" = 'grand_total' THEN NULL
            WHEN site LIKE '% - subtotal'
              THEN round(100.0 * sum / nullif((SELECT sum(sum) FROM cells), 0), 6)
            ELSE round(pct, 6) END AS pct
FROM stacked"""))


# ------------------------------------------------------------------------- partial aggregates

def _after_redelivery(spark, sf_dir):
    """Three batches, the last of which delivers half of the exports again."""
    folder = scratch_dir(spark)
    data = _data(spark, sf_dir).select("col_id", "col_date", col("group"), *(
        col(f) for f in SEVERITIES))
    half = (F.crc32("col_id") % 2).cast("string")
    schema = T.StructType([*data.schema.fields, T.StructField("delivery", T.IntegerType()),
                           T.StructField("export", T.StringType())])
    for delivery, export in ((1, "0"), (2, "1"), (3, "0")):
        data.where(half == export).write.parquet(
            f"{folder}/in/delivery={delivery}/export={export}")
        partials.maintain(
            spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/progress", ["group"],
            SEVERITIES, ["col_id"], unit=F.col("export"), version=F.col("delivery"))
    return folder + "/out"


def _incremental_risk(spark, sf_dir):
    target = _after_redelivery(spark, sf_dir)
    return safety.risk_of_partials(partials.sums(spark, target, ["group"], SEVERITIES),
                                   partials.ids(spark, target, "col_id", ["group"]))


register("safety_incremental_risk", _incremental_risk, over_collections(_RISK, _arms(SEVERITIES)))


def _cells(spark, sf_dir):
    return _data(spark, sf_dir).withColumn("month", period_start(col("col_date"), "month"))


register("safety_distinct_bitmaps", lambda s, d: mergeable.bitmap_rollup(
    stored(mergeable.distinct_bitmaps(_cells(s, d), ["group", "site", "month"], "don_id")),
    ["group", "site"]), over_collections("""
SELECT CAST(2 AS BIGINT) AS level, "group", site, count(DISTINCT don_id) AS n FROM collections
GROUP BY "group", site
UNION ALL SELECT 1, "group", NULL, count(DISTINCT don_id) FROM collections GROUP BY "group"
UNION ALL SELECT 0, NULL, NULL, count(DISTINCT don_id) FROM collections"""))


def _sketched_distinct(spark, sf_dir):
    """Estimates from monthly cells beside the exact counts; five standard errors."""
    data = _cells(spark, sf_dir)
    cells = stored(mergeable.distinct_sketches(data, ["site", "month"], "col_id"))
    exact = data.groupBy("site").agg(F.count_distinct("col_id").alias("collections"))
    error = 5 * 1.04 / 2 ** (mergeable.LG_K / 2)
    return mergeable.sketched_counts(cells, ["site"]).join(exact, "site").select(
        "site", "collections",
        (F.abs(col("n") - col("collections")) <= F.lit(error) * col("collections")).alias("near"))


register("safety_distinct_sketches", _sketched_distinct, over_collections("""
SELECT site, count(DISTINCT col_id) AS collections, TRUE AS near FROM collections GROUP BY site"""))
