"""Polynomials, Fourier transforms and repeatable random numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.registry import query, table


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """The real roots of a x^2 + b x + c, ascending; of a linear one its root; none otherwise. The larger root in size comes first by the formula, the other from the product, so that neither cancels."""
    d = b * b - 4 * a * c
    q = -0.5 * (b + F.when(b < 0, -F.sqrt(d)).otherwise(F.sqrt(d)))
    none = F.array().cast("array<double>")
    linear = F.when(b != 0, F.array(-c / b)).otherwise(none)
    return F.when(a == 0, linear).when(d < 0, none).when(q == 0, F.array(F.lit(0.0))).when(d == 0, F.array(q / a)).otherwise(F.array_sort(F.array(q / a, c / q)))


def cubic_roots(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The real roots of a x^3 + b x^2 + c x + d, ascending: by angles where there are three, else by cube roots; of a = 0 those of the quadratic. Roots that coincide are given as often as rounding tells them apart."""
    p, q = (3 * a * c - b * b) / (3 * a * a), (2 * b * b * b - 9 * a * b * c + 27 * a * a * d) / (27 * a * a * a)
    shift, inside = -b / (3 * a), q * q / 4 + p * p * p / 27
    size = 2 * F.sqrt(F.greatest(-p / 3, F.lit(0.0)))
    angle = F.acos(F.greatest(F.least(3 * q / (p * size), F.lit(1.0)), F.lit(-1.0))) / 3
    three = F.array_sort(F.array(*(size * F.cos(angle - 2 * math.pi * k / 3) + shift for k in range(3))))
    root = F.sqrt(F.greatest(inside, F.lit(0.0)))
    one = F.array(F.cbrt(-q / 2 + root) + F.cbrt(-q / 2 - root) + shift)
    return F.when(a == 0, quadratic_roots(b, c, d)).when((inside < 0) & (p < 0), three).otherwise(one)


def newton_coefficients(x: list[float], y: list[Column]) -> list[Column]:
    """The divided differences of values y at places x."""
    table_, out = list(y), [y[0]]
    for k in range(1, len(x)):
        table_ = [(table_[i + 1] - table_[i]) / (x[i + k] - x[i]) for i in range(len(table_) - 1)]
        out.append(table_[0])
    return out


def newton_value(x: list[float], coefficients: list[Column], at: float) -> Column:
    value = coefficients[-1]
    for c, p in zip(reversed(coefficients[:-1]), reversed(x[: len(coefficients) - 1])):
        value = value * (at - p) + c
    return value


def fourier(rows: DataFrame, id_col: str, array_col: str, shape: tuple[int, ...] | None = None) -> DataFrame:
    """(id, k, re, im): the discrete Fourier transform of each row's array, of any length; none of an empty or null one.

    With a shape the array is one of more dimensions, the last running fastest, and so is k. An array of
    another size than the shape's is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            sizes = np.array([len(v) if v else 0 for v in values.to_pylist()])
            for n in np.unique(sizes[sizes > 0]):  # arrays of one size are transformed together
                at = np.flatnonzero(sizes == n)
                stack = np.array(values.take(pa.array(at)).to_pylist(), dtype=np.float64)
                z = np.fft.fftn(stack.reshape(-1, *(shape or (n,))), axes=range(1, 1 + len(shape or (n,)))).ravel()
                ids = batch.column(0).take(pa.array(np.repeat(at, n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(n), len(at)), pa.int32()), pa.array(z.real), pa.array(z.imag)], ["id", "k", "re", "im"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(array_col).cast("array<double>")).mapInArrow(run, f"id {kind}, k int, re double, im double").withColumnRenamed("id", id_col)


#: Per dimension the degree of its primitive polynomial, its inner coefficients, of which bit i - 1 is that of the i-th number back, and its first numbers.
SOBOL = ((1, 0, (1,)), (2, 1, (1, 1)), (3, 1, (1, 3, 7)), (3, 2, (1, 3, 3)))
_BITS = 32


def sobol_directions(dimension: int) -> list[int]:
    """The numbers of a dimension, from 0, each moved up to 32 bits."""
    degree, inner, first = SOBOL[dimension]
    m = list(first)
    while len(m) < _BITS:
        now = m[-degree] << degree ^ m[-degree]
        for i in range(1, degree):
            now ^= (m[-i] << i) * (inner >> (i - 1) & 1)
        m.append(now)
    return [x << (_BITS - j) for j, x in enumerate(m, 1)]


def sobol(n: Column, dimension: int) -> Column:
    """The place along a dimension, in [0, 1), of the n-th Sobol point, from 0, in Gray order and without the origin; n below 2^32 - 1."""
    v = F.array(*map(F.lit, sobol_directions(dimension))).cast("array<bigint>")
    k = n.cast("long") + 1
    gray = k.bitwiseXOR(F.shiftright(k, 1))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(_BITS - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(F.get(v, i) * F.getbit(gray, i)))
    return bits.cast("double") / float(1 << _BITS)


def piecewise_density(u: Column, edges: list[float], weights: list[float]) -> Column:
    """The place of u from [0, 1) under a density that is constant, by weight, between ascending edges."""
    total, below, out = float(sum(weights)), 0.0, F.lit(float(edges[-1]))
    pieces = []
    for lo, hi, w in zip(edges, edges[1:], weights):
        pieces.append((below, lo, hi, w / total))
        below += w / total
    for below, lo, hi, share in reversed([p for p in pieces if p[3] > 0]):
        out = F.when(u < below + share, lo + (u - below) / share * (hi - lo)).otherwise(out)
    return out


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that is a function of key and seed alone, so that a task run again draws the same."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


@query("f35_quadratic_roots", "SELECT p_partkey, round(CASE WHEN d >= 0 THEN (-b - sqrt(abs(d))) / 2 END, 6) AS low, round(CASE WHEN d >= 0 THEN (-b + sqrt(abs(d))) / 2 END, 6) AS high FROM (SELECT p_partkey, b, b * b - 4 * c AS d FROM (SELECT p_partkey, (p_size - 20)::DOUBLE AS b, (p_partkey % 40 + 1)::DOUBLE AS c FROM part))")
def _roots(spark, d):
    r = quadratic_roots(F.lit(1.0), (F.col("p_size") - 20).cast("double"), (F.col("p_partkey") % 40 + 1).cast("double"))
    p = table(spark, d, "part").select("p_partkey", r.alias("r"))
    return p.select("p_partkey", F.round(F.get("r", F.lit(0)), 6).alias("low"), F.round(F.element_at(F.when(F.size("r") > 0, F.col("r")), -1), 6).alias("high"))


@query("f35_newton_value", "SELECT vec_id, round((e[1] * 3 - e[2] * 3 + e[3])::DOUBLE, 5) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _newton(spark, d):
    """The parabola through an embedding's first three values, at the place before them."""
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    x = [1.0, 2.0, 3.0]
    return table(spark, d, "embeddings").select("vec_id", F.round(newton_value(x, newton_coefficients(x, e), 0.0), 5).alias("value"))


@query("f36_fourier", "SELECT vec_id, k::INT AS k, round(sum(e[n + 1] * cos(2 * pi() * ((k * n) % 64) / 64)), 5) + 0.0 AS re, round(sum(-e[n + 1] * sin(2 * pi() * ((k * n) % 64) / 64)), 5) + 0.0 AS im FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(64) a(k), range(64) b(n) GROUP BY 1, 2")
def _fourier(spark, d):
    out = fourier(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", "k", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("re", "im")))


@query("f34_uniform", "SELECT o_orderkey, ('0x' || md5(o_orderkey::VARCHAR || ':7')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM orders")
def _uniform(spark, d):
    return table(spark, d, "orders").select("o_orderkey", uniform(F.col("o_orderkey"), 7).alias("u"))


@query("f36_fourier_2d", "SELECT vec_id, k::INT AS k, round(sum(e[n + 1] * cos(2 * pi() * (((k // 8) * (n // 8) + (k % 8) * (n % 8)) % 8) / 8)), 5) + 0.0 AS re, round(sum(-e[n + 1] * sin(2 * pi() * (((k // 8) * (n // 8) + (k % 8) * (n % 8)) % 8) / 8)), 5) + 0.0 AS im FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(64) a(k), range(64) b(n) GROUP BY 1, 2")
def _fourier_2d(spark, d):
    out = fourier(table(spark, d, "embeddings"), "vec_id", "embedding", (8, 8))
    return out.select("vec_id", "k", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("re", "im")))


#: The recurrence written out in SQL, and points one after the other: each flips the number of its predecessor's lowest zero bit.
_SOBOL_SQL = """WITH RECURSIVE m(dim, degree, inner_, j, list) AS (
  SELECT * FROM (VALUES (0, 1, 0, 1, [1::BIGINT]), (1, 2, 1, 2, [1::BIGINT, 1]), (2, 3, 1, 3, [1::BIGINT, 3, 7]))
  UNION ALL SELECT dim, degree, inner_, j + 1, list_append(list, xor(xor(xor(list[j + 1 - degree] << degree, list[j + 1 - degree]),
    CASE WHEN degree > 1 AND inner_ & 1 = 1 THEN list[j] << 1 ELSE 0 END), CASE WHEN degree > 2 AND inner_ & 2 = 2 THEN list[j - 1] << 2 ELSE 0 END)) FROM m WHERE j < 32),
v AS (SELECT dim, list_transform(list, lambda x, i: x << (32 - i)) AS v FROM m WHERE j = 32),
k AS (SELECT o_orderkey, o_orderkey + 1 AS k FROM orders),
g AS (SELECT o_orderkey, dim, list_reduce(list_transform(range(32), lambda i: ((xor(k, k >> 1) >> i) & 1) * v[i + 1]), lambda a, b: xor(a, b)) / 4294967296.0::DOUBLE AS p FROM k, v)
SELECT o_orderkey, max(p) FILTER (dim = 0) AS x, max(p) FILTER (dim = 1) AS y, max(p) FILTER (dim = 2) AS z FROM g GROUP BY 1"""


@query("f34_sobol", _SOBOL_SQL)
def _sobol(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(sobol(F.col("o_orderkey"), k).alias(c) for k, c in enumerate("xyz")))


@query("f35_cubic_roots", "SELECT p_partkey, [round(r, 5), round(r + 1 + p_size % 5, 5), round(r + 7 + p_size % 3, 5)] AS roots, [round(r, 5)] AS single FROM (SELECT *, (p_partkey % 21 - 10)::DOUBLE AS r FROM part)")
def _cubic(spark, d):
    """Cubics made of three roots, and of one root with a quadratic that has none."""
    r = (F.col("p_partkey") % 21 - 10).cast("double")
    s, t = r + 1 + F.col("p_size") % 5, r + 7 + F.col("p_size") % 3
    two = F.lit(2.0)
    three = cubic_roots(two, -two * (r + s + t), two * (r * s + s * t + t * r), -two * r * s * t)
    single = cubic_roots(F.lit(1.0), -r, F.lit(9.0), -9 * r)
    shown = lambda a: F.transform(a, lambda x: F.round(x, 5) + F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", shown(three).alias("roots"), shown(single).alias("single"))


@query("f34_piecewise", "SELECT o_orderkey, round(CASE WHEN u < 0.25 THEN u / 0.25 WHEN u < 0.75 THEN 1 + (u - 0.25) / 0.5 * 3 ELSE 4 + (u - 0.75) / 0.25 * 6 END, 6) AS value FROM (SELECT o_orderkey, ('0x' || md5(o_orderkey::VARCHAR || ':7')[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM orders)")
def _piecewise(spark, d):
    value = piecewise_density(uniform(F.col("o_orderkey"), 7), [0.0, 1.0, 4.0, 10.0], [1.0, 2.0, 1.0])
    return table(spark, d, "orders").select("o_orderkey", F.round(value, 6).alias("value"))
