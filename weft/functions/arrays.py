"""Arrays of numbers as vectors: arithmetic, copies, products, norms, sorting of a few values; checksums and hashes of rows and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.scalars import dot
from weft.registry import query, table


def combine(a: Column, b: Column | float, how: Callable[[Column, Column], Column]) -> Column:
    """Element by element with another array, of which the shorter counts, or with a number."""
    if isinstance(b, Column):
        n = F.least(F.size(a), F.size(b))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), how)
    return F.transform(a, lambda x: how(x, F.lit(b)))


def negated(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def axpy(s: float, x: Column, y: Column) -> Column:
    """s * x + y."""
    return F.zip_with(x, y, lambda u, v: s * u + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """a over its norm; the first unit vector for one of norm 0."""
    unit = F.transform(a, lambda _, i: F.when(i == 0, 1.0).otherwise(0.0))
    size = norm(a)
    return F.when(size == 0, unit).otherwise(F.transform(a, lambda x: x / size))


def distance(a: Column, b: Column) -> Column:
    """The Euclidean distance."""
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def most_at(a: Column) -> Column:
    """The place, from 0, of the element of the largest size, of several the first; -1 for none."""
    sizes = F.transform(a, lambda x: F.abs(x))
    return F.coalesce(F.array_position(sizes, F.array_max(sizes)), F.lit(0)) - 1


def filled(n: Column, value: float) -> Column:
    return F.array_repeat(F.lit(value), n.cast("int"))


def copied(target: Column, source: Column, offset: int) -> Column:
    """target with source in it from a place on; what doesn't fit is left out."""
    inside = lambda i: (i >= offset) & (i < offset + F.size(source))
    return F.transform(target, lambda x, i: F.when(inside(i), F.get(source, i - offset)).otherwise(x))


def compacted(a: Column, places: Column) -> Column:
    """The elements at some places, in their order; null where there is none."""
    return F.transform(places, lambda i: F.get(a, i))


def rotated(a: Column, by: int) -> Column:
    """a moved by some places to the right, the last ones in front."""
    n = F.size(a)
    return F.transform(a, lambda _, i: F.get(a, F.pmod(i - by, n)))


def choice(i: Column, *of: Column) -> Column:
    """The i-th, from 1, of some values; others are an error."""
    return F.when((i >= 1) & (i <= len(of)), F.element_at(F.array(*of), F.greatest(F.least(i, F.lit(len(of))), F.lit(1)))).otherwise(F.raise_error(F.lit("no such choice")))


def exchange_sort(*of: Column) -> list[Column]:
    """A few values in ascending order, by least and greatest of two at a time."""
    now = list(of)
    for i in range(len(now)):
        for j in range(len(now) - 1 - i):
            now[j], now[j + 1] = F.least(now[j], now[j + 1]), F.greatest(now[j], now[j + 1])
    return now


def linear_index(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    return i + nx * (j + ny * k)


#: Fixed value: the reversed polynomial of CRC-32C.
CRC32C = 0x82F63B78


def crc32c(text: Column) -> Column:
    """CRC-32C of a text in ASCII, as a long, bit by bit."""

    def byte(crc: Column, c: Column) -> Column:
        step = lambda x, _: F.shiftrightunsigned(x, 1).bitwiseXOR(F.when(x.bitwiseAND(F.lit(1)) == 1, F.lit(CRC32C)).otherwise(F.lit(0)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(F.ascii(c).cast("long")), step)

    characters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(characters, F.lit(0xFFFFFFFF).cast("long"), byte).bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))


def text_hash(text: Column) -> Column:
    """A hash of a text's bytes, from 0 to 2^52."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def row_hash(*of: Column) -> Column:
    """A hash of a row's values as texts; null isn't the empty text."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in of)).cast("binary"))


_E = "SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS r FROM embeddings"


def _vectors(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", v.alias("e"), F.reverse(v).alias("r"))


def _sql_zip(how: str) -> str:
    return f"list_transform(range(1, len(e) + 1), lambda i: {how})"


def _round(a: Column) -> Column:
    return F.transform(a, lambda x: F.round(x, 6) + F.lit(0.0))


def _sql_round(a: str) -> str:
    return f"list_transform({a}, lambda x: round(x, 6) + 0.0)"


@query("p17_array_expressions", f"SELECT vec_id, {_sql_round(_sql_zip('e[i] + r[i]'))} AS total, {_sql_round(_sql_zip('e[i] - r[i]'))} AS difference, {_sql_round(_sql_zip('e[i] * r[i]'))} AS product, {_sql_round(_sql_zip('e[i] / (abs(r[i]) + 1)'))} AS ratio, {_sql_round(_sql_zip('-e[i]'))} AS negation FROM ({_E})")
def _expressions(spark, d):
    e, r = F.col("e"), F.col("r")
    return _vectors(spark, d).select("vec_id", _round(combine(e, r, lambda x, y: x + y)).alias("total"), _round(combine(e, r, lambda x, y: x - y)).alias("difference"), _round(combine(e, r, lambda x, y: x * y)).alias("product"), _round(combine(e, r, lambda x, y: x / (F.abs(y) + 1))).alias("ratio"), _round(negated(e)).alias("negation"))


@query("f28_array_arithmetic", f"SELECT vec_id, {_sql_round(_sql_zip('e[i] + 2'))} AS plus, {_sql_round(_sql_zip('e[i] - 0.5'))} AS minus, {_sql_round(_sql_zip('e[i] * 3'))} AS times, {_sql_round(_sql_zip('e[i] / 4'))} AS over FROM ({_E})")
def _arithmetic(spark, d):
    e = F.col("e")
    ways = {"plus": (2.0, lambda x, y: x + y), "minus": (0.5, lambda x, y: x - y), "times": (3.0, lambda x, y: x * y), "over": (4.0, lambda x, y: x / y)}
    return _vectors(spark, d).select("vec_id", *(_round(combine(e, v, how)).alias(n) for n, (v, how) in ways.items()))


@query("f14_vector_distance", f"SELECT vec_id, {_sql_round(_sql_zip('e[i] * 0.25'))} AS scaled, round(sqrt(list_sum({_sql_zip('(e[i] - r[i]) * (e[i] - r[i])')})), 6) AS distance FROM ({_E})")
def _distance(spark, d):
    return _vectors(spark, d).select("vec_id", _round(combine(F.col("e"), 0.25, lambda x, y: x * y)).alias("scaled"), F.round(distance(F.col("e"), F.col("r")), 6).alias("distance"))


@query("f23_componentwise", f"SELECT vec_id, {_sql_zip('least(e[i], r[i])')} AS low, {_sql_zip('greatest(e[i], r[i])')} AS high FROM ({_E})")
def _componentwise(spark, d):
    return _vectors(spark, d).select("vec_id", combine(F.col("e"), F.col("r"), lambda x, y: F.least(x, y)).alias("low"), combine(F.col("e"), F.col("r"), lambda x, y: F.greatest(x, y)).alias("high"))


@query("f33_normalized", f"SELECT vec_id, {_sql_round('list_transform(e, lambda y: y / n)')} AS unit FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM ({_E}))")
def _normalized(spark, d):
    return _vectors(spark, d).select("vec_id", _round(normalized(F.col("e"))).alias("unit"))


@query("f29_copies", f"SELECT vec_id, list_transform(range(vec_id % 5), lambda i: 1.5::DOUBLE) AS filled, list_transform(range(1, len(e) + 1), lambda i: CASE WHEN i BETWEEN 61 AND 64 THEN r[i - 60] ELSE e[i] END) AS copied FROM ({_E})")
def _copies(spark, d):
    return _vectors(spark, d).select("vec_id", filled(F.col("vec_id") % 5, 1.5).alias("filled"), copied(F.col("e"), F.slice("r", F.lit(1), F.lit(8)), 60).alias("copied"))


@query("f30_compacted", f"SELECT vec_id, [e[2], e[1], e[64], e[65]] AS some FROM ({_E})")
def _compacted(spark, d):
    return _vectors(spark, d).select("vec_id", compacted(F.col("e"), F.array(*map(F.lit, (1, 0, 63, 64)))).alias("some"))


@query("f27_shift_choice", f"SELECT vec_id, list_concat(e[len(e) - 2:], e[:len(e) - 3]) AS rotated, CASE vec_id % 3 + 1 WHEN 1 THEN e[1] WHEN 2 THEN e[2] ELSE e[3] END AS chosen FROM ({_E})")
def _shift(spark, d):
    return _vectors(spark, d).select("vec_id", rotated(F.col("e"), 3).alias("rotated"), choice((F.col("vec_id") % 3 + 1).cast("int"), *(F.get("e", F.lit(i)) for i in range(3))).alias("chosen"))


@query("v2_axpy", f"SELECT vec_id, {_sql_round(_sql_zip('0.75 * e[i] + r[i]'))} AS y FROM ({_E})")
def _axpy(spark, d):
    return _vectors(spark, d).select("vec_id", _round(axpy(0.75, F.col("e"), F.col("r"))).alias("y"))


@query("v3_scaled", f"SELECT vec_id, {_sql_round(_sql_zip('e[i] * -1.25'))} AS x FROM ({_E})")
def _scaled(spark, d):
    return _vectors(spark, d).select("vec_id", _round(combine(F.col("e"), -1.25, lambda x, y: x * y)).alias("x"))


@query("v6_most_at", f"SELECT vec_id, (list_position(s, list_max(s)) - 1)::BIGINT AS place FROM (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS s FROM ({_E}))")
def _most(spark, d):
    return _vectors(spark, d).select("vec_id", most_at(F.col("e")).cast("long").alias("place"))


@query("o7_exchange_sort", "SELECT p_partkey, s[1] AS a, s[2] AS b, s[3] AS c, s[4] AS d FROM (SELECT p_partkey, list_sort([p_size::BIGINT, p_partkey % 50, 25, p_partkey % 7 * 9]) AS s FROM part)")
def _exchange(spark, d):
    k = F.col("p_partkey")
    out = exchange_sort(F.col("p_size").cast("long"), k % 50, F.lit(25).cast("long"), k % 7 * 9)
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for c, n in zip(out, "abcd")))


@query("f21_nine", "SELECT p_partkey, least(p_size, 9, 31, p_partkey % 50, 44, 12, p_partkey % 33, 27, 8)::BIGINT AS low, greatest(p_size, 9, 31, p_partkey % 50, 44, 12, p_partkey % 33, 27, 8)::BIGINT AS high FROM part")
def _nine(spark, d):
    k = F.col("p_partkey")
    of = [c.cast("long") for c in (F.col("p_size"), F.lit(9), F.lit(31), k % 50, F.lit(44), F.lit(12), k % 33, F.lit(27), F.lit(8))]
    return table(spark, d, "part").select("p_partkey", F.least(*of).alias("low"), F.greatest(*of).alias("high"))


@query("f31_linear_index", "SELECT p_partkey, p_size % 8 + 8 * (p_partkey % 6 + 6 * (p_partkey // 48)) AS idx FROM part")
def _index(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", linear_index(F.col("p_size") % 8, k % 6, F.expr("p_partkey div 48"), 8, 6).alias("idx"))


@query("f16_powers", "SELECT p_partkey, round(pow(p_retailprice, 3 / 2.0), 4) AS three_halves, round((p_size - 25) / 2.0, 0)::INT AS rint, round(cbrt(p_size - 25), 8) AS root FROM part")
def _powers(spark, d):
    """Halves are rounded away from zero."""
    s = F.col("p_size") - 25
    return table(spark, d, "part").select("p_partkey", F.round(F.pow("p_retailprice", F.lit(1.5)), 4).alias("three_halves"), F.round(s / 2.0).cast("int").alias("rint"), F.round(F.cbrt(s.cast("double")), 8).alias("root"))


_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: {'#'}), 4294967295::BIGINT)"


def _crc_sql() -> str:
    x = "xor(a, c)"
    step = "xor(a >> 1, (a & 1) * {p})".format(p=CRC32C)
    return _CRC.replace("#", f"list_reduce(list_prepend({x}, range(8)), lambda a, b: {step})")


@query("f37_crc32c", f"SELECT p_partkey, {_crc_sql()} AS crc, md5(k) AS digest FROM (SELECT p_partkey, p_brand || p_partkey AS k FROM part)")
def _crc(spark, d):
    k = F.concat("p_brand", F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", crc32c(k).alias("crc"), F.md5(k.cast("binary")).alias("digest"))


@query("f8_text_hash", "SELECT doc_id, ('0x' || md5(text)[1:13])::BIGINT AS hash FROM documents")
def _text_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text_hash(F.col("text")).alias("hash"))


@query("a34_content_hash", "SELECT o_orderkey, md5('=' || o_orderkey || '|=' || o_custkey || '|' || coalesce('=' || o_orderstatus, '-')) AS hash FROM orders")
def _content(spark, d):
    return table(spark, d, "orders").select("o_orderkey", row_hash(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("hash"))
