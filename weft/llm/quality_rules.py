"""Quality rules whose thresholds carry a guarantee on the share of good documents that they reject.

Rules of a ladder of rising severity are tried against labelled good documents of each stratum (the
language). Severity 1 rejects least. For each stratum the highest severity is taken for which this and
every lower one has an exact binomial (Clopper-Pearson) upper bound of at most `alpha` on the share of
good documents rejected. Going up the ladder until the first failure is a fixed-sequence test, which
needs no correction along the ladder; over the strata `delta` is divided by their number (Bonferroni).
So with probability 1 - delta the ladder takes from no stratum more than alpha of its good documents that
pass the base rules, if labels fall by chance. What the base rules reject is not part of that promise. A
stratum with too few labels to prove anything has no rule of the method.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import settle, table, words

#: Share of symbols in word characters, of repeated lines in lines, of !-marks and of capitals in word characters, from which a severity 1, 2, ... rejects.
LADDER = {
    "symbol_share": (0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08),
    "dup_line_share": (0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55, 0.50),
    "bang_share": (0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10, 0.08),
    "capital_share": (0.98, 0.95, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55),
}
SEVERITIES = 10
ALPHA, DELTA = 0.05, 0.1
WINDOW = 5


def _share(part: str, of: str) -> Column:
    return F.col(part) / F.greatest(F.col(of), F.lit(1))


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", row_col: str | None = None) -> DataFrame:
    """Per row of docs: the id, row_col if given, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the shares of LADDER, base_failed, severity.

    severity is the least that rejects the row, SEVERITIES + 1 if none does. A null text has no words.
    All statistics cover whole texts; windows of words are compared by 64-bit hashes within a text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [row_col] if row_col else []
    split = docs.select(F.col(id_col).alias("id"), *row, F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("t"), words(F.col(text_col)).alias("w"))
    # what is counted is picked out of the text once
    split = split.withColumn("marks", F.regexp_replace("t", r"[^A-Z!#*$%&|<>]+", ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = split.select(
        "id",
        *row,
        "stratum",
        F.regexp_count("marks", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("marks", F.lit("!")).cast("long").alias("n_bangs"),
        F.regexp_count("marks", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("w").cast("long").alias("n_words"),
        lines.alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    at = lambda i, k: F.get(F.col("h"), i + k)
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    split = split.select(
        "id",
        *row,
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_bangs",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("x"),
    )
    # only a text with an equal pair of windows is sorted
    ranked = F.when(F.size(F.array_distinct("x")) < F.size("x"), F.sort_array(F.transform("x", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    split = split.withColumn("s", ranked).drop("x")
    hash_at = lambda j: F.get(F.col("s"), j)["x"]
    again = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce(hash_at(j) == hash_at(j - 1), F.lit(False)) | F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False)))
    split = split.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(again, lambda j: F.get(F.col("s"), j)["i"])))).drop("s")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("p", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    split = split.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("p")
    split = split.withColumns(
        {
            "symbol_share": _share("n_symbols", "word_chars"),
            "dup_line_share": _share("n_dup_lines", "n_lines"),
            "bang_share": _share("n_bangs", "word_chars"),
            "capital_share": _share("n_capitals", "word_chars"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    return split.withColumn("severity", F.least(*(_level(k) for k in LADDER))).drop("n_bangs", "n_capitals", "n_lines")


def _level(share: str) -> Column:
    found = F.lit(SEVERITIES + 1)
    for level in range(SEVERITIES, 0, -1):
        found = F.when(F.col(share) >= LADDER[share][level - 1], level).otherwise(found)
    return found


def _tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Binomial(n, alpha) <= k), summed from logarithms of its terms."""
    odds = math.log(alpha / (1 - alpha))
    n_, k_ = n.cast("double"), k
    first = F.struct((n_ * math.log1p(-alpha)).alias("term"), F.exp(n_ * math.log1p(-alpha)).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n_ - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k_ >= 1, F.sequence(F.lit(1).cast("long"), k_)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, step, lambda a: a["sum"])


def certified(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum the highest severity that is proved to reject at most alpha of the good rows of `good` (stratum, severity).

    Its size is the number of strata. The upper bound for k rejections in n is at most alpha exactly when
    P(Binomial(n, alpha) <= k) is at most the level of the test.
    """
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("severity") <= j, 1)).alias(f"k{j}") for j in range(1, SEVERITIES + 1)))
    counts = counts.withColumn("strata", counts.agg(F.count(F.lit(1))).scalar())
    proved = [(F.col(f"k{j}") < F.col("n") * alpha) & (_tail(F.col("n"), F.when(F.col(f"k{j}") < F.col("n") * alpha, F.col(f"k{j}")).otherwise(0).cast("long"), alpha) * F.col("strata") <= delta) for j in range(1, SEVERITIES + 1)]
    limit = F.lit(0)
    for j in range(SEVERITIES, 0, -1):  # up to the first failure
        limit = F.when(proved[j - 1], F.greatest(limit, F.lit(j))).otherwise(F.lit(0))
    return counts.select("stratum", limit.alias("limit"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA, row_col: str | None = None, label_id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: the id, row_col if given, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, severity.

    labels: label_id_col, quality (1: good); a document with several rows is good if all that are not null say
    1. Without labels, or in an unlabelled stratum, only the base rules reject. A null stratum counts as
    the empty one. Null and empty texts have no words and fail the base rules. Repeated rows get the same
    verdict, an empty table no rows, and other columns are ignored.
    """
    stats = settle(text_statistics(docs, id_col, text_col, stratum_col, row_col))
    good = labels.groupBy(F.col(label_id_col).alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")
    limits = certified(stats.where("not base_failed").join(good, "id", "left_semi"), alpha, delta)
    judged = stats.join(limits, "stratum", "left")
    kept = ~F.col("base_failed") & (F.col("severity") > F.coalesce("limit", F.lit(0)))
    return judged.select(F.col("id").alias(id_col), *([row_col] if row_col else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "severity")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    level = lambda s: "CASE " + " ".join(f"WHEN {s} >= {c!r} THEN {j}" for j, c in enumerate(LADDER[s], 1)) + f" ELSE {SEVERITIES + 1} END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT doc_id, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] END AS g
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
y AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM x),
r AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM (
        SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM y) GROUP BY 1),
s AS (SELECT d.doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(regexp_extract_all(t, '!')) AS n_bangs, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM s),
c AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(len(ls), 1) AS dup_line_share,
             n_bangs / greatest(word_chars, 1) AS bang_share, n_capitals / greatest(word_chars, 1) AS capital_share,
             n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
v AS (SELECT *, least({", ".join(level(s) for s in LADDER)}) AS severity FROM c),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
g AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (FROM good)),
n AS (SELECT stratum, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT n.stratum, n, j, (SELECT count(*) FROM g WHERE g.stratum = n.stratum AND g.severity <= j) AS k
      FROM n, range(1, {SEVERITIES + 1}) AS q(j)),
p AS (SELECT stratum, j, k < n * {ALPHA} AND (SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
             FROM range(0, k + 1) AS e(i)) * (SELECT count(*) FROM n) <= {DELTA} AS ok FROM k),
lim AS (SELECT stratum, coalesce(min(j) FILTER (NOT ok), {SEVERITIES + 1}) - 1 AS lim FROM p GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND severity > coalesce(lim, 0) AS kept, severity
FROM v LEFT JOIN lim USING (stratum)
"""


SQL = {"op6_quality_rules": _sql()}
