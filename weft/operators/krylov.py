"""Krylov iterations on sparse symmetric matrices (row, col, value): Lanczos' tridiagonal form and a quasi-minimal residual."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.learning import _SOLUTION, chain, spmv, unsolved
from weft.registry import query
from weft.runtime import kept, settle


def _product(matrix: DataFrame, state: DataFrame, of: str) -> DataFrame:
    """state with a column t: matrix times the column `of`; its lineage is cut."""
    t = spmv(matrix, state.select("idx", F.col(of).alias("value"))).withColumnRenamed("value", "t")
    return settle(state.join(t, "idx", "left").withColumn("t", F.coalesce("t", F.lit(0.0))))


def lanczos(matrix: DataFrame, start: DataFrame, steps: int) -> list[tuple[float, float]]:
    """Diagonal and off-diagonal of the tridiagonal matrix that `steps` steps from start (idx, value) give.

    Fewer where an invariant subspace is found, none from zero. Vectors stay distributed; a step is one
    sparse product and brings two sums to the driver.
    """
    square = start.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    if not square:
        return []
    matrix = kept(settle(matrix.select("row", "col", "value")), "col")
    state, beta, out = start.select("idx", (F.col("value") / math.sqrt(square)).alias("v"), F.lit(0.0).alias("u")), 0.0, []
    for _ in range(steps):
        both = _product(matrix, state, "v")
        alpha = both.agg(F.sum(F.col("v") * F.col("t"))).first()[0]
        left = both.select("idx", (F.col("t") - alpha * F.col("v") - beta * F.col("u")).alias("w"), F.col("v").alias("u"))
        beta = math.sqrt(left.agg(F.sum(F.col("w") * F.col("w"))).first()[0])
        out.append((alpha, beta))
        if beta <= 1e-12 * max(1.0, abs(alpha)):
            break
        state = left.select("idx", (F.col("w") / beta).alias("v"), "u")
    return out


def symmetric_qmr(matrix: DataFrame, b: DataFrame, tolerance: float = 1e-10, limit: int = 10_000) -> DataFrame:
    """(idx, value) with matrix * value = b, for a symmetric matrix that need not be positive.

    Coupled two-term recurrences whose residuals are smoothed. A round is one sparse product and brings
    two sums and a maximum to the driver. Without a solution within the tolerance after `limit` rounds it
    is an error.
    """
    matrix = kept(settle(matrix.select("row", "col", "value")), "col")
    state = settle(b.select("idx", F.lit(0.0).alias("x"), F.col("value").alias("r"), F.col("value").alias("q"), F.lit(0.0).alias("d")))
    rho = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
    tau, theta = math.sqrt(rho or 0.0), 0.0
    for _ in range(limit):
        if not rho:
            break
        both = _product(matrix, state, "q")
        sigma = both.agg(F.sum(F.col("q") * F.col("t"))).first()[0]
        if sigma == 0.0:
            raise ArithmeticError("no way on: the matrix takes the direction to one at right angles")
        alpha = rho / sigma
        both = both.withColumn("r", F.col("r") - alpha * F.col("t"))
        worst, now = both.agg(F.max(F.abs("r")), F.sum(F.col("r") * F.col("r"))).first()
        ratio = math.sqrt(now) / tau
        share = 1.0 / (1.0 + ratio * ratio)
        d = share * theta * theta * F.col("d") + share * alpha * F.col("q")
        state = both.select("idx", (F.col("x") + d).alias("x"), "r", (F.col("r") + (now / rho) * F.col("q")).alias("q"), d.alias("d"))
        rho, theta, tau = now, ratio, tau * ratio * math.sqrt(share)
        if worst <= tolerance:
            break
    else:
        raise unsolved(limit)
    return state.select("idx", F.col("x").alias("value"))


_STEPS = 5


@query("m5_lanczos", f"SELECT * FROM (VALUES {', '.join(f'({k}::BIGINT, 4.0::DOUBLE, 1.0::DOUBLE)' for k in range(_STEPS))}) t(step, diagonal, beside)")
def _lanczos(spark, d):
    """From the first unit vector the matrix of a chain is its own tridiagonal form."""
    a, x, _ = chain(spark, d)
    first = x.agg(F.min("idx").alias("lo"))
    start = x.crossJoin(first).select("idx", F.when(F.col("idx") == F.col("lo"), 1.0).otherwise(0.0).alias("value"))  # of one row
    rows = [(k, round(p, 9), round(q, 9)) for k, (p, q) in enumerate(lanczos(a, start, _STEPS))]
    return spark.createDataFrame(rows, "step long, diagonal double, beside double")


@query("m5_symmetric_qmr", _SOLUTION)
def _qmr(spark, d):
    a, _, b = chain(spark, d)
    return symmetric_qmr(a, b).withColumn("value", F.round("value", 6))
