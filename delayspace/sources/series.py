"""Series tables: rows with an explicit position, read from frames, CSV or Parquet; results written as CSV."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import ranked

#: Rows of one series that a single task numbers; longer ones are numbered by ranges.
ONE_TASK = 1_000_000
#: Rows of a block within which lags are taken; blocks overlap by the longest lag.
BLOCK = 262_144
ROW = "row_id"


@dataclass
class Series:
    """A series table. ``df`` has ``row_id`` 1..n, the time column and numeric columns, with NaN as null."""

    df: DataFrame
    time: str
    n: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (ROW, self.time)]

    @property
    def time_type(self) -> T.DataType:
        return self.df.schema[self.time].dataType


def quoted(name: str) -> Column:
    """A column by its exact name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolve_input(spark: SparkSession, dataFrame: DataFrame | None = None, dataFile: str = "", pathIn: str = "./") -> tuple[DataFrame, list[Column] | None]:
    """The frame, or the file if one is named (CSV with a header, or Parquet), and how its rows are ordered (None: by the first column)."""
    if dataFile:
        path = f"{pathIn.rstrip('/')}/{dataFile}" if pathIn and "://" not in dataFile and not dataFile.startswith("/") else dataFile
        if path.endswith(".parquet"):
            return spark.read.parquet(path), None
        df = spark.read.csv(path, header=True, inferSchema=True, nullValue="NA", nanValue="NaN", mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        return _numbers(df), [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    if dataFrame is None:
        raise ValueError("neither a frame nor a file is given")
    return dataFrame, None


def _numbers(df: DataFrame) -> DataFrame:
    """``df`` with text columns as numbers if they hold nothing but numbers and spellings of a missing value."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    given = {c: F.when(~F.lower(F.trim(quoted(c))).isin("na", "nan", ""), quoted(c)) for c in text}
    numbers = {c: v.try_cast("double") for c, v in given.items()}
    if not text:
        return df
    odd = df.agg(*[F.count(F.when(given[c].isNotNull() & numbers[c].isNull(), 1)).alias(f"c{i}") for i, c in enumerate(text)]).head()
    plain = {c for c, n in zip(text, odd, strict=True) if not n}
    return df.select(*[numbers[c].alias(c) if c in plain else quoted(c) for c in df.columns])


def valid_columns(df: DataFrame, columns: Sequence[str], target: Sequence[str] = ()) -> None:
    missing = [c for c in (*columns, *target) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def valid_frame(df: DataFrame, columns: Sequence[str] = (), target: Sequence[str] = (), no_time: bool = False) -> None:
    """Raise unless the frame has rows, numeric columns (but for the time), and the columns named."""
    valid_columns(df, columns, target)
    if not no_time and len(df.columns) < 2:
        raise ValueError("a time column and at least one other are expected")
    wrong = [f.name for f in df.schema[0 if no_time else 1 :] if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if wrong:
        raise ValueError(f"columns are not numeric: {', '.join(wrong)}")
    if df.isEmpty():
        raise ValueError("the frame has no rows")


def load(df: DataFrame, no_time: bool = False, order: list[Column] | None = None, keep: Sequence[str] | None = None) -> Series:
    """Number the rows of one series by ``order``, by default the first column; NaN becomes null.

    Only ``keep`` columns are read on, once: they stay in memory, or on disk, for all that is worked out from them. Up to ONE_TASK rows are numbered by one window; more by ranges, of which only
    counts come to the driver.
    """
    time = "Time" if no_time else df.columns[0]
    values = [c for c in df.columns if (no_time or c != time) and (keep is None or c in keep)]
    if no_time and order is None:
        order = [F.monotonically_increasing_id()]
    keys = order or [quoted(time)]
    shown = [] if no_time else [quoted(time).alias(time)]
    picked = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], *shown, *[clean(quoted(c)).alias(c) for c in values if no_time or c != time])
    names = [f"_k{i}" for i in range(len(keys))]
    picked = picked.persist(StorageLevel.MEMORY_AND_DISK)
    n = picked.count()
    if n <= ONE_TASK:
        numbered = picked.withColumn(ROW, F.row_number().over(W.orderBy(*names)).cast("long"))
    else:
        numbered = ranked(picked, *names, name=ROW, label="rows").withColumn(ROW, F.col(ROW) + 1)
    if no_time:
        numbered = numbered.withColumn(time, F.col(ROW))
    return Series(numbered.select(ROW, quoted(time), *[quoted(c) for c in values if c != time]), time, n)


def clean(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def number_panel(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """``df`` with row_id 1.. by ``order`` in each series of ``by``, and the series' length ``_n``.

    Up to ONE_TASK rows in all, by a window. Beyond that a series may be too long for one task: all rows are numbered by ranges of
    (by, order), and a series' first number is taken off, which is a partial aggregate and a join.
    """
    w = W.partitionBy(*by)
    if df.count() <= ONE_TASK:
        return df.withColumn(ROW, F.row_number().over(w.orderBy(order)).cast("long")).withColumn("_n", F.count("*").over(w))
    placed = ranked(df, *by, order, name=ROW, label="rows")
    ends = placed.groupBy(*by).agg(F.min(ROW).alias("_first"), F.count("*").alias("_n"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by]
    joined = placed.alias("r").join(ends.alias("e"), same)
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col(f"r.{ROW}") - F.col("e._first") + 1).alias(ROW), F.col("e._n").alias("_n"))


def shifted(df: DataFrame, n: int | None, wanted: dict[str, tuple[str, int]], by: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``by``, row_id and ``keep`` of ``df`` with each column ``name`` = ``source`` so many rows ahead (negative: back), null beyond the ends.

    Each series of ``by``, or the single one, is cut into blocks that overlap by the longest shift, so that no task has
    all of a long series.
    """
    reach = max([0, *(abs(s) for _, s in wanted.values())])
    if not reach:  # all columns are taken where they are
        return df.select(*by, ROW, *[quoted(c) for c in keep], *[quoted(c).alias(name) for name, (c, _) in wanted.items()])
    size = max(BLOCK, reach)
    sources = list(dict.fromkeys(c for c, _ in wanted.values()))
    place = {c: f"_s{i}" for i, c in enumerate(sources)}
    base = df.select(*by, ROW, *[quoted(c) for c in keep], *[quoted(c).alias(place[c]) for c in sources])
    one = n is not None and n <= size
    if one:
        base, w = base.withColumn("_block", F.lit(0)), W.partitionBy(*by, "_block").orderBy(ROW)
    else:
        block = lambda shift: F.floor((F.col(ROW) + shift) / size)
        base = base.withColumn("_home", block(0)).withColumn("_block", F.explode(F.array_distinct(F.array(block(-reach), block(0), block(reach)))))
        w = W.partitionBy(*by, "_block").orderBy(ROW)
    own = [] if one else ["_home", "_block"]
    out = base.select(*by, ROW, *[quoted(c) for c in keep], *own, *[(F.lead(place[c], s) if s >= 0 else F.lag(place[c], -s)).over(w).alias(name) for name, (c, s) in wanted.items()])
    return out.where("_home = _block").drop(*own) if own else out


def write_csv(df: DataFrame, pathOut: str, predictFile: str, order: Sequence[str] = ()) -> None:
    """One CSV file with a header, ``pathOut/predictFile``; a forecast is small next to its input."""
    spark, target = df.sparkSession, f"{pathOut.rstrip('/')}/{predictFile}"
    folder = f"{target}-{uuid.uuid4().hex}"
    (df.orderBy(*order) if order else df).coalesce(1).write.csv(folder, header=True)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(x.getPath() for x in files.listStatus(path(folder)) if x.getPath().getName().startswith("part-"))
    files.delete(path(target), True)
    files.rename(part, path(target))
    files.delete(path(folder), True)
