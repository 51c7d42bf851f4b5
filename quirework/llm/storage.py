"""Where lineage is cut, and small helpers that every operator shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoint() writes to: the session's own, or a temporary one on a local master.

    A cluster must name a shared folder in ``spark.checkpoint.dir``; without one this raises, as a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirework-ckpt-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and carry on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over all rows before it in ``order``, which must tell rows apart.

    Rows are range-partitioned and summed part by part; only the parts' totals meet in one place.  So no
    task holds more than its range, however many rows share the first columns of ``order``.
    """
    part, own, base = fresh(df, "qw_part", "qw_own", "qw_base")
    spread = checkpoint(df.withColumn(own, value.cast("long")).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    totals = spread.groupBy(part).agg(F.sum(own).alias(base))
    before = totals.select(part, (F.sum(base).over(W.orderBy(part)) - F.col(base)).alias(base))  # a row for each partition
    inside = F.sum(own).over(W.partitionBy(part).orderBy(*order)) - F.col(own)
    return spread.withColumn(name, inside).join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col(base)).drop(part, own, base)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """A column name for each base that ``df`` doesn't have in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out
