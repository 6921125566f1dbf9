"""Pipeline triggers as a queue: files arrive, each cycle takes one, a ledger says which."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import next_trigger

TRIGGER = "name string, mode string, region string, fire_cells array<string>"


def pending_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Trigger records that arrive as JSON files; malformed ones and those without a mode are left out. The checkpoint makes each count once."""
    rows = spark.readStream.schema(f"{TRIGGER}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and mode is not null").drop("_corrupt")


def trigger_cycles(spark: SparkSession, path: str) -> DataFrame:
    """The same beside a clock, so that a cycle also begins when nothing has arrived; its rows have no name."""
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in TRIGGER.split(", ")]
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return pending_triggers(spark, path).unionByName(clock.select(*nothing))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """cycle and the trigger that it took."""
    return _table(spark, f"{path}/taken", f"{TRIGGER}, priority int, cycle long")


def consume(path: str, act: Callable[[Row], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each micro-batch is a cycle and takes one trigger, the first by priority and then name.

    What waits is a snapshot by cycle, what was taken a ledger by cycle, both written under path. A cycle only looks at
    the snapshot and the ledger of earlier ones and replaces its own, so a cycle that is run again after a failure takes
    the same trigger again and no other. A trigger that arrives twice, or after it was taken, counts once. act gets
    the taken row after the ledger has it; a failure in it fails the cycle, which is then run again (at least once).
    """

    def cycle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = batch.filter(F.col("name").isNotNull()).select(*[c.split()[0] for c in TRIGGER.split(", ")])
        waiting = _table(spark, f"{path}/waiting/cycle={number - 1}", TRIGGER).unionByName(arrived)
        taken = ledger(spark, path).filter(F.col("cycle") < number).select("name")
        waiting = waiting.dropDuplicates(["name"]).join(taken, "name", "left_anti").persist()
        try:
            chosen = next_trigger(waiting).withColumn("priority", F.col("priority").cast("int")).take(1)
            rows = spark.createDataFrame(chosen, f"{TRIGGER}, priority int")
            rows.select(*[c.split()[0] for c in TRIGGER.split(", ")], "priority").write.mode("overwrite").parquet(f"{path}/taken/cycle={number}")
            name = chosen[0]["name"] if chosen else None
            waiting.filter(~F.col("name").eqNullSafe(F.lit(name))).write.mode("overwrite").parquet(f"{path}/waiting/cycle={number}")
        finally:
            waiting.unpersist()
        if chosen and act:
            act(chosen[0])

    return cycle
