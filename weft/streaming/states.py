"""State of a key that is kept from one batch of a stream to the next, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.registry import query, table


def tracked(events: DataFrame, key: str, time_col: str, value_col: str) -> DataFrame:
    """(key, n, total, last): how many events a key has had, the sum of their values, and the value of the latest.

    On a stream a row for each key that a batch has events of, with all since the start; late events are
    counted whenever they come. On a table one row for each key. Of events of one time the greatest value
    is the latest. A null value counts as 0 in the sum.
    """
    rows = events.select(key, F.unix_micros(F.col(time_col).cast("timestamp")).alias("us"), F.coalesce(F.col(value_col).cast("double"), F.lit(0.0)).alias("v"))
    if not events.isStreaming:
        return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max(F.struct("us", "v")).alias("_last")).select(key, "n", "total", F.col("_last.v").alias("last"))

    def update(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, us, last = state.get if state.exists else (0, 0.0, -(2**63), 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["v"].sum())
            us, last = max((us, last), max(zip(batch["us"].tolist(), batch["v"].tolist())))
        state.update((n, total, us, last))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total], "last": [last]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double, last double", "n long, total double, us long, last double", "update", GroupStateTimeout.NoTimeout)


@query("t4_tracked_keys", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, (ts, value)) AS last FROM events GROUP BY 1")
def _tracked(spark, d):
    return tracked(table(spark, d, "events"), "user_id", "ts", "value").withColumn("total", F.round("total", 4))
