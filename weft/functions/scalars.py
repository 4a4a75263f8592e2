"""Scalar, text and array functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.registry import query, table

#: Fixed values of the escape format: each character and what stands for it, in the order of escaping.
ESCAPES = (("%", "%0"), (";", "%1"), (" ", "%2"), ("\n", "%3"), ("\t", "%4"), ("\r", "%5"), (",", "%6"), (":", "%7"), ("\b", "%8"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def occurrences(text: Column, part: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def wrap(x: Column, lo: float, hi: float) -> Column:
    return F.pmod(x - lo, F.lit(hi - lo)) + lo


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scale_square(v: Column, s: float) -> Column:
    """v * v * s for each element: what the operator of the name "scale" of the gradient step computes."""
    return F.transform(v, lambda x: x.cast("double") * x.cast("double") * s)


def minmod(a: Column, b: Column) -> Column:
    return F.when(a * b <= 0, 0.0).when(F.abs(a) < F.abs(b), a).otherwise(b)


@query("f1_escape", "SELECT doc_id, length(" + "replace(" * 9 + "text" + "".join(f", chr({ord(r)}), '{c}')" for r, c in ESCAPES) + ") AS escaped, true AS same, text = '' AS empty FROM documents")
def _escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(escape(t)).cast("long").alias("escaped"), (unescape(escape(t)) == t).alias("same"), (F.length(t) == 0).alias("empty"))


@query("f4_occurrences", "SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) // 2)::BIGINT AS n FROM documents")
def _occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", occurrences(F.col("text"), "th").alias("n"))


@query("f10_first_number", "SELECT event_id, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS n, format('{:.6e}', value) AS shown FROM events")
def _number(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("n"), F.format_string("%.6e", "value").alias("shown"))


@query("f11_number_set", "SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' 7 12 7', '[0-9]+'), lambda x: x::BIGINT))) AS numbers FROM conversations")
def _numbers(spark, d):
    found = F.regexp_extract_all(F.concat("text", F.lit(" 7 12 7")), F.lit("[0-9]+"), F.lit(0))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sort_array(F.array_distinct(F.transform(found, lambda x: x.cast("long")))).alias("numbers"))


@query("f15_math", "SELECT p_partkey, p_size * p_size AS sqr, p_size * p_size * p_size AS cube, round(cbrt(p_retailprice), 8) AS root, sign(p_size - 25)::INT AS sgn, CASE WHEN p_size < 25 THEN -1 ELSE 1 END AS sign_nonzero, greatest(least(p_size, 40), 10) AS clamped, ((p_size - 3 + 700) % 7 + 3)::INT AS wrapped, round(p_size + 0.25, 0)::INT AS near FROM part")
def _math(spark, d):
    s, size = table(spark, d, "part"), F.col("p_size")
    return s.select("p_partkey", (size * size).alias("sqr"), (size * size * size).alias("cube"), F.round(F.cbrt("p_retailprice"), 8).alias("root"), F.signum(size - 25).cast("int").alias("sgn"), F.when(size < 25, -1).otherwise(1).alias("sign_nonzero"), clamp(size, 10, 40).alias("clamped"), wrap(size, 3, 10).alias("wrapped"), F.round(size + 0.25).cast("int").alias("near"))


@query("f20_extremes", "SELECT p_partkey, list_position([p_size, 20, 30], least(p_size, 20, 30)) - 1 AS least_at, list_position([p_size, 20, 30], greatest(p_size, 20, 30)) - 1 AS most_at, greatest(abs(p_size - 25), 7) AS maxabs, CASE WHEN abs(p_size - 25) >= 7 THEN p_size - 25 ELSE -7 END AS maxmag, CASE WHEN abs(p_size - 25) <= 7 THEN p_size - 25 ELSE -7 END AS minmag, CASE WHEN p_size - 25 >= 0 THEN 0 WHEN abs(p_size - 25) < 7 THEN p_size - 25 ELSE -7 END AS minmod FROM part")
def _extremes(spark, d):
    s, x = F.col("p_size"), F.col("p_size") - 25
    three = F.array(s, F.lit(20), F.lit(30))
    return table(spark, d, "part").select("p_partkey", (F.array_position(three, F.least(s, F.lit(20), F.lit(30))) - 1).cast("int").alias("least_at"), (F.array_position(three, F.greatest(s, F.lit(20), F.lit(30))) - 1).cast("int").alias("most_at"), F.greatest(F.abs(x), F.lit(7)).alias("maxabs"), F.when(F.abs(x) >= 7, x).otherwise(-7).alias("maxmag"), F.when(F.abs(x) <= 7, x).otherwise(-7).alias("minmag"), minmod(x, F.lit(-7)).cast("int").alias("minmod"))


@query("f24_integer_logs", "SELECT p_partkey, floor(log2(p_size))::INT AS ilog, bit_count(p_size) = 1 AS power, (2 ** ceil(log2(p_size)))::BIGINT AS next_power, p_size & -p_size AS low_bit FROM part")
def _logs(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.floor(F.log2(s)).cast("int").alias("ilog"), (F.bit_count(s) == 1).alias("power"), F.pow(F.lit(2.0), F.ceil(F.log2(s))).cast("long").alias("next_power"), s.bitwiseAND(-s).alias("low_bit"))


def sinc(x: Column) -> Column:
    """sin(x) / x, 1 at 0."""
    return F.when(F.abs(x) < 1e-8, 1.0).otherwise(F.sin(x) / x)


def one_minus_cos_over(x: Column, power: int = 1) -> Column:
    """(1 - cos(x)) / x, or over x squared, by the half angle, which loses no digits near 0."""
    half = sinc(x / 2)
    return x * half * half / 2 if power == 1 else half * half / 2


def atan2_over(y: Column, x: Column) -> Column:
    """atan2(y, x) / y, and its limit 1 / x at y = 0 for positive x."""
    return F.when((F.abs(y) < 1e-8) & (x > 0), 1 / x).otherwise(F.atan2(y, x) / y)


@query("f26_robust", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(x) < 1e-8 THEN 1 ELSE sin(x) / x END, 8) AS sinc, round(CASE WHEN abs(x) < 1e-8 THEN 0 ELSE (1 - cos(x)) / x END, 8) AS versin, round(CASE WHEN abs(x) < 1e-8 THEN 0.5 ELSE (1 - cos(x)) / (x * x) END, 8) AS versin2, round(CASE WHEN abs(x) < 1e-8 THEN 1 / l_quantity ELSE atan2(x, l_quantity) / x END, 8) AS slope, round(0.25 * x + 0.75 * l_tax, 8) AS lerp, isnan(l_tax) AS no_number FROM (SELECT *, l_discount AS x FROM lineitem)")
def _robust(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sinc(x), 8).alias("sinc"), F.round(one_minus_cos_over(x), 8).alias("versin"), F.round(one_minus_cos_over(x, 2), 8).alias("versin2"), F.round(atan2_over(x, F.col("l_quantity")), 8).alias("slope"), F.round(0.25 * x + 0.75 * F.col("l_tax"), 8).alias("lerp"), F.isnan("l_tax").alias("no_number"))


@query("f12_array_math", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 8) AS dot, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * 0.5)), 8) AS scaled, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 8) AS abs_sum, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 8) AS maxabs, list_reverse(embedding)[1]::DOUBLE AS last, (list_sort(embedding))[1]::DOUBLE AS least, round(list_max(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: greatest(p[1], p[2])))::DOUBLE, 8) AS pair_max FROM embeddings")
def _arrays(spark, d):
    v = F.col("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    size = F.transform(v, lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(v, v), 8).alias("dot"), F.round(total(scale_square(v, 0.5)), 8).alias("scaled"), F.round(total(size), 8).alias("abs_sum"), F.round(F.array_max(size), 8).alias("maxabs"), F.element_at(v, -1).cast("double").alias("last"), F.get(F.array_sort(v), F.lit(0)).cast("double").alias("least"), F.round(F.array_max(F.zip_with(v, F.reverse(v), lambda x, y: F.greatest(x, y))).cast("double"), 8).alias("pair_max"))


@query("a12_sums", "SELECT l_shipdate::DATE::VARCHAR AS day, round(sum(l_quantity), 4) AS s, round(sum(abs(l_quantity - 25)), 4) AS sumabs, round(avg(l_quantity), 8) AS mean, max(abs(l_quantity - 25)) AS maxabs, min(l_quantity) AS least, round(sum(l_quantity * l_discount), 6) AS dot, round(sum(l_tax * l_quantity * l_discount), 8) AS inner_product, round(sqrt(sum(l_quantity * l_quantity)), 6) AS norm, round(sum(l_quantity * l_tax) / sum(l_quantity), 13) AS center FROM lineitem GROUP BY 1")
def _sums(spark, d):
    q, x, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(F.round(F.sum(q), 4).alias("s"), F.round(F.sum(F.abs(q - 25)), 4).alias("sumabs"), F.round(F.avg(q), 8).alias("mean"), F.max(F.abs(q - 25)).alias("maxabs"), F.min(q).alias("least"), F.round(F.sum(q * x), 6).alias("dot"), F.round(F.sum(t * q * x), 8).alias("inner_product"), F.round(F.sqrt(F.sum(q * q)), 6).alias("norm"), F.round(F.sum(q * t) / F.sum(q), 13).alias("center"))


@query("p3_in_range", "SELECT p_partkey, p_retailprice BETWEEN 100 AND 900 AS inside FROM part WHERE p_size BETWEEN 10 AND 20")
def _range(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", F.col("p_retailprice").between(100, 900).alias("inside"))


@query("p4_out_of_range", "SELECT p_partkey FROM part WHERE NOT p_size BETWEEN 10 AND 20")
def _outside(spark, d):
    return table(spark, d, "part").where(~F.col("p_size").between(10, 20)).select("p_partkey")


@query("p9_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fin' WHEN 'O' THEN 'open' WHEN 'P' THEN 'part' END AS state, o_orderkey < 1000 AS system_id FROM orders")
def _decode(spark, d):
    names = F.create_map(*(F.lit(x) for kv in (("F", "fin"), ("O", "open"), ("P", "part")) for x in kv))
    return table(spark, d, "orders").select("o_orderkey", names[F.col("o_orderstatus")].alias("state"), (F.col("o_orderkey") < 1000).alias("system_id"))
