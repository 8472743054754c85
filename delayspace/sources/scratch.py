"""Tables in the folder that all executors share, which cut lineage, and ranks without a single task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own, and a cluster an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="delayspace-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The table outlives any executor. It goes with :func:`drop` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/delayspace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _drop_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written.clear()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, *order, name: str, label: str, parts: int = 0) -> DataFrame:
    """``df`` with its 0-based position in ``order`` as column ``name``, by ranges (``parts`` of them at least) and not in one task.

    Only one count for each range comes to the driver, and goes back as a literal.
    """
    place, part = "__ds_place", F.shiftright("__ds_place", 33).cast("int")
    ranges = df.repartitionByRange(max(parts, partitions(df.sparkSession)), *order).sortWithinPartitions(*order)
    placed = cut(ranges.withColumn(place, F.monotonically_increasing_id()), label)
    counts = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=0) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    first = F.expr(f"array({', '.join(f'{x}L' for x in offsets)})")
    return placed.withColumn(name, F.element_at(first, part + 1) + F.col(place).bitwiseAND((1 << 33) - 1)).drop(place)
