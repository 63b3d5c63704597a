"""Posterior and predictive power."""

from pyspark.sql import functions as F

from armwatch.checks.base import counted, over_collections, register
from armwatch.plans import power
from armwatch.sources.collections import collections


def _posterior_sql(severity: str, where: str, prior_p=(.5, .5), prior_n=(1, 1),
                   margin: float = .0015) -> str:
    def arm(values) -> str:
        return (f"""CASE "group" WHEN 'A' THEN CAST({values[0]} AS DOUBLE)
                ELSE CAST({values[1]} AS DOUBLE) END""")
    return over_collections(f"""
SELECT "group", n_aes, n_col, round(CAST(n_aes AS DOUBLE) / n_col, 6) AS observed_p, expected_p,
       prior_n, prior_n + n_col AS post_n,
       round((expected_p * prior_n + n_aes) / (prior_n + n_col), 6) AS weighted_p,
       round(expected_p * prior_n + n_aes, 6) AS success,
       round(prior_n + n_col - expected_p * prior_n - n_aes, 6) AS failure,
       CAST({margin} AS DOUBLE) AS margin
FROM (SELECT "group", {counted(severity)} AS n_aes, count(DISTINCT col_id) AS n_col,
             {arm(prior_p)} AS expected_p, {arm(prior_n)} AS prior_n
      FROM collections WHERE {where} GROUP BY "group")""")


register("power_posterior", lambda s, d: power.posterior(collections(s, d)),
         _posterior_sql("sig_hyp", "TRUE"))
register("power_posterior_at_date", lambda s, d: power.posterior(
    collections(s, d), (.1, .2), (10, 100), "non_hyp", "1999-06-30"),
    _posterior_sql("non_hyp", "col_date <= DATE '1999-06-30'", (.1, .2), (10, 100), 0.0))


# Planned arms of four times the current ones in steps of a tenth: both follow the table.
register("power_sample_sizes", lambda s, d: power.sample_sizes(
    power.posterior(collections(s, d)), 8 * F.col("n_max"), F.ceil(F.col("n_max") / 10))
    .select("group_size", "n_max", "step", "plan"), over_collections("""
SELECT CAST(step * k AS BIGINT) AS group_size, n_max, step, 8 * n_max AS plan
FROM (SELECT n_max, CAST(ceil(n_max / 10.0) AS BIGINT) AS step
      FROM (SELECT max(n) AS n_max FROM (
              SELECT count(DISTINCT col_id) AS n FROM collections GROUP BY "group"))),
     range(1, 100) r(k)
WHERE step * k >= ceil(CAST(n_max AS DOUBLE) / step) * step
  AND step * k <= ceil(4.0 * n_max / step) * step"""))
