"""A table run through a streaming operator, as it would have arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, stored


def replay(df: DataFrame, time: str, operator: Callable[[DataFrame], DataFrame], parts: int = 2, tasks: int = 8) -> DataFrame:
    """The rows that operator makes of df as a stream, in `parts` stretches of time (a timestamp column; equal times stay together).

    Each stretch is written to the folder that the stream watches, then the query is started, takes what is there and
    stops: from the second on it goes on from its checkpoint, with the state that it has left there. tasks: partitions of
    its state, which a stream keeps for life.
    """
    spark, df = df.sparkSession, stored(df)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    place = new_path(spark, "streams")
    at = F.unix_millis(F.col(time))
    bounds = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)] + [1.0], 1000)).first()[0] or []
    low = None
    for high in sorted(set(bounds)) or [None]:
        inside = F.lit(True) if high is None else (at <= high) if low is None else (at > low) & (at <= high)
        df.filter(inside | at.isNull() if low is None else inside).write.mode("append").parquet(f"{place}/in")
        low = high
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        told = operator(spark.readStream.schema(df.schema).parquet(f"{place}/in"))
        run = told.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)  # a stream has taken its own by now
        run.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{place}/out")
