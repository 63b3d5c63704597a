"""Quality rules with risk-controlled cutoffs, in DataFrame operations only.

Every rule rejects a document whose share of something exceeds a cutoff. Cutoffs come from a
fixed grid, ordered from lenient to strict, and labelled documents of good quality are used for
nothing but to certify them: with k of n good documents of a stratum rejected by a cutoff, the
hypothesis that it rejects more than ``risk / number of rules`` of the good ones is refused when
the exact binomial probability of k or fewer is at most ``error / (strata * rules)``. Along a
grid the tests stop at the first that fails (fixed sequence, no further correction), and the
strictest certified cutoff is taken. So with probability ``1 - error``, in no stratum do the
rules together reject more than ``risk`` of the good documents. Where too few labels certify
anything, the method rejects nothing.

A stratum is a value of one column (language); null is a stratum of its own. Null and empty
texts have no words and fail the base rule. Rows that repeat are judged alike, each by itself.
Window comparisons within a text use 64-bit hashes of five words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from armwatch.llm.common import GAP, WORD, fresh, text_of
from armwatch.session import settled, stored

#: Share by rule and its cutoffs, from lenient to strict.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (.4, .35, .3, .25, .2, .15, .1, .05)),
    "capitals": ("n_capitals / word_chars", (.7, .6, .5, .4, .3)),
    "marks": ("n_marks / n_words", (1.9, 1.5, 1., .75, .5, .25)),
    "repeats": ("n_repeat_words / n_words", (.2, .15, .1)),
    "lines": ("n_dup_lines / n_lines", (.8, .6, .5, .4, .3)),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_capitals", "n_marks", "n_lines")
#: Summed terms of a binomial tail; what lies beyond is bounded by a geometric series.
TERMS = 2000


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of each text; a column of such a name is replaced."""
    words, hashes, windows, lines, pairs, where = fresh(
        docs, "words", "hashes", "windows", "lines", "pairs", "where")
    whole = text_of(text)
    df = (docs.withColumn(words, F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
          .withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
          .withColumn(windows, F.when(F.size(words) >= 5, F.transform(
              F.sequence(F.lit(0), F.size(words) - 5),
              lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(5)))))
              .otherwise(F.array().cast("array<bigint>")))
          .withColumn(lines, F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)))
          # windows found twice or more: neighbours in the order of hashes, then their places
          .withColumn(pairs, F.when(
              F.size(F.array_distinct(windows)) < F.size(windows),
              F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
              .otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
          .withColumn(where, F.sort_array(F.transform(F.filter(
              pairs, lambda x, i: F.coalesce(
                  x["h"] == F.try_element_at(F.col(pairs), i + 2)["h"], F.lit(False))
              | ((i > 0) & (x["h"] == F.get(F.col(pairs), i - 1)["h"]))), lambda x: x["i"]))))
    covered = F.aggregate(
        where, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(5), i - s["last"])).alias("n"),
                              i.alias("last")), lambda s: s["n"])
    return df.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_capitals": F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
        "n_marks": F.regexp_count(whole, F.lit("[!?]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }).drop(words, hashes, windows, lines, pairs, where)


def base_failed() -> Column:
    return ((F.col("n_words") < 10)
            | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def log_gamma(x: Column) -> Column:
    """Of x >= 1: Stirling's series eight further on."""
    y = x + 8
    series = (y - .5) * F.log(y) - y + .5 * math.log(2 * math.pi) + 1 / (12 * y) \
        - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Probability of k or fewer of n at rate p, never too small; 1 from the mean on."""
    x, m = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(m + 1) - log_gamma(x + 1) - log_gamma(m - x + 1)
                + x * math.log(p) + (m - x) * math.log1p(-p))
    odds = (1 - p) / p

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (x - j + 1) / (m - x + j) * odds
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    steps = F.least(k, F.lit(TERMS)).cast("int")
    ratio = (x - steps) / (m - x + steps + 1) * odds
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add,
        lambda s: s["sum"] + s["term"] * ratio / (1 - ratio))
    return F.when(x >= m * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * total))


def certified_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang",
                      risk: float = .02, error: float = .05, good: str = "quality") -> DataFrame:
    """One row per stratum: the certified cutoff of each rule, null where there is none."""
    good_ids = labels.where(F.col(good) == 1).select("doc_id").distinct()
    rules = [(name, at, cut) for name, (_, cuts) in RULES.items() for at, cut in enumerate(cuts)]
    over = [F.sum((F.expr(RULES[name][0]) > cut).cast("long")) for name, _, cut in rules]
    totals = stored(
        counted.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), *COUNTS)
        .join(good_ids, "doc_id", "left_semi").groupBy("stratum")
        .agg(F.count("*").alias("n"),
             F.array(*(F.coalesce(x, F.lit(0)) for x in over)).alias("rejected")))
    level = error / (max(1, totals.count()) * len(RULES))
    tested = totals.select("stratum", "n", F.explode(F.array(*(
        F.struct(F.lit(name).alias("rule"), F.lit(at).alias("at"), F.lit(cut).alias("cutoff"),
                 F.get("rejected", F.lit(i)).alias("k"))
        for i, (name, at, cut) in enumerate(rules)))).alias("t")).select("stratum", "n", "t.*")
    so_far = Window.partitionBy("stratum", "rule").orderBy("at")
    certified = (tested.withColumn("fails", (binomial_tail(
        F.col("k"), F.col("n"), risk / len(RULES)) > level).cast("int"))
        .withColumn("failed", F.sum("fails").over(so_far)).where("failed = 0"))
    return stored(certified.groupBy("stratum").agg(*(
        F.min(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"cut_{name}")
        for name in RULES)))


def verdict(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang",
            kept: str = "kept") -> DataFrame:
    """Add base_failed and the verdict. The cutoffs are a written table of one row per stratum;
    Spark broadcasts it if its files are small, else the join is an ordinary one."""
    rejected = F.lit(False)
    for name, (share, _) in RULES.items():
        rejected |= F.coalesce(F.expr(share) > F.col(f"cut_{name}"), F.lit(False))
    joined = counted.join(cutoffs, counted[stratum].eqNullSafe(cutoffs["stratum"]), "left")
    return (joined.withColumn("base_failed", base_failed())
            .withColumn(kept, ~F.col("base_failed") & ~rejected)
            .drop(cutoffs["stratum"], *(f"cut_{name}" for name in RULES)))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the counts, whether the base rule fails, and whether it is kept."""
    lang = docs["lang"].cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    counted = settled(with_counts(docs.select("doc_id", lang.alias("lang"), "text"))
                      .select("doc_id", "lang", *COUNTS))
    return verdict(counted, certified_cutoffs(counted, labels)).select(
        "doc_id", *BASE, "base_failed", "kept")


def without_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept. They are written with their counts once, so that the texts
    are read through once for the certificates and the verdict."""
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    held = docs.withColumnsRenamed(names)
    held = stored(with_counts(held.withColumns({
        "doc_id": F.col(names["doc_id"]), "lang": F.col(names["lang"]).cast("string")}),
        names["text"]))
    kept = verdict(held, certified_cutoffs(held, labels)).where("kept")
    return kept.select(*(F.col(new).alias(old) for old, new in names.items()))


def sql(risk: float = .02, error: float = .05) -> str:
    """The same over documents and labels; a recount of windows as rows and tails as sums."""
    grid = ",".join(f"('{name}', {at}, CAST({cut} AS DOUBLE))"
                    for name, (_, cuts) in RULES.items() for at, cut in enumerate(cuts))
    share = " ".join(f"WHEN '{name}' THEN {expression.replace('/', '::DOUBLE /')}"
                     for name, (expression, _) in RULES.items())
    p = risk / len(RULES)
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM texts),
spots AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM words),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS c FROM spots),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM wins, range(5) AS r(k)
  WHERE c > 1 GROUP BY 1),
counted AS (SELECT doc_id, lang, len(ws) AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
  length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks, len(ls) AS n_lines
  FROM words LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counted),
grid(rule, pos, cutoff) AS (VALUES {grid}),
shares AS (SELECT doc_id, lang, base_failed, rule, pos, cutoff,
  CASE rule {share} END > cutoff AS rejects FROM based, grid),
totals AS (SELECT lang, rule, pos, cutoff, count(*) AS n,
  count(*) FILTER (WHERE rejects) AS k FROM shares
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  GROUP BY ALL),
tails AS (SELECT lang, rule, pos, cutoff, CASE WHEN k >= n * {p} THEN 1.0 ELSE (
  SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p})
  + (n - i) * ln(1 - {p}))) FROM range(k + 1) AS r(i)) END AS tail FROM totals),
tests AS (SELECT *, sum(CASE WHEN tail > {error} / ((SELECT count(DISTINCT coalesce(lang, '?'))
  FROM totals) * {len(RULES)}) THEN 1 ELSE 0 END)
  OVER (PARTITION BY lang, rule ORDER BY pos) AS failed FROM tails),
cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tests WHERE failed = 0 GROUP BY ALL),
bad AS (SELECT DISTINCT s.doc_id FROM shares s JOIN cuts c
  ON s.lang IS NOT DISTINCT FROM c.lang AND s.rule = c.rule AND s.cutoff = c.cutoff
  WHERE s.rejects)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM based"""
