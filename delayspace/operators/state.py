"""What Simplex and S-map share: arguments, the embedded series, and library and predicted rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import split_columns
from ..plans.index import Indices, create_indices, within
from ..sources.series import ROW, Series, load, quoted, resolve_input, shifted, valid_columns, valid_frame
from .embed import check_embedding, lag_columns, lag_names


@dataclass
class Result:
    """Frames of a call, with its parameters and, if asked for, the state it went through."""

    predictions: DataFrame
    coefficients: DataFrame | None = None
    singularValues: DataFrame | None = None
    parameters: dict | None = None
    state: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class State:
    """An embedded series: ``vectors`` has row_id, v0.., y (the target Tp rows on) and ok (all of v there)."""

    series: Series
    names: list[str]
    target: str
    E: int
    Tp: int
    indices: Indices
    vectors: DataFrame
    valid: DataFrame | None

    @property
    def dims(self) -> int:
        return len(self.names)

    def pred(self) -> DataFrame:
        """p, a0.. of rows to predict whose vectors are whole."""
        rows = self.vectors.where(within(self.indices.pred, F.col(ROW)) & F.col("ok"))
        return rows.select(F.col(ROW).alias("p"), *[F.col(f"v{j}").alias(f"a{j}") for j in range(self.dims)])

    def lib(self) -> DataFrame:
        """l, b0.., y of library rows whose vectors are whole and that are valid."""
        rows = self.vectors.where(within(self.indices.lib, F.col(ROW)) & F.col("ok"))
        if self.valid is not None:
            rows = rows.join(self.valid, ROW, "left_semi")
        return rows.select(F.col(ROW).alias("l"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(self.dims)], "y")


def vectors_of(series: Series, columns: Sequence[str], target: str, E: int, tau: int, Tp: int, embedded: bool) -> DataFrame:
    """row_id, v0.., y, ok."""
    if embedded:
        wanted = {f"v{j}": (c, 0) for j, c in enumerate(columns)}
    else:
        wanted = lag_columns(columns, E, tau, [f"v{j}" for j in range(E * len(columns))])
    out = shifted(series.df, series.n, wanted | {"y": (target, Tp)})
    ok = F.lit(True)
    for name in wanted:
        ok = ok & F.col(name).isNotNull()
    return out.select(ROW, *wanted, "y", ok.alias("ok"))


def valid_rows(series: Series, validLib: Column | str | Sequence[bool] | None) -> DataFrame | None:
    """Rows that a condition on the series' columns (a Column or SQL), or a list with a value for each row, lets into libraries."""
    if validLib is None:
        return None
    if isinstance(validLib, (Column, str)):
        return series.df.where(validLib).select(ROW)
    rows = list(validLib)
    if not rows:
        return None
    if len(rows) != series.n:
        raise ValueError(f"validLib has {len(rows)} values for {series.n} rows")
    chosen = [(i + 1,) for i, v in enumerate(rows) if v]
    return series.df.sparkSession.createDataFrame(chosen, f"{ROW} long")


def prepare(name: str, spark, dataFrame, columns, target, lib, pred, E, Tp, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile) -> State:
    columns, targets = split_columns(columns), split_columns(target)
    if not columns or not targets:
        raise ValueError(f"{name}: columns and target are needed")
    df, order = (dataFrame.df.drop(ROW), None) if isinstance(dataFrame, Series) else resolve_input(spark, dataFrame, dataFile, pathIn)
    if isinstance(dataFrame, Series):
        valid_columns(df, columns, targets[:1])
    else:
        valid_frame(df, columns, targets[:1], noTime)
    if embedded:
        E, names = len(columns), list(columns)
    else:
        check_embedding(df.columns, columns, E, tau, name)
        names = lag_names(columns, E, tau)
    series = dataFrame if isinstance(dataFrame, Series) else load(df, noTime, order, keep=[*columns, targets[0], *columns_in(validLib, df)])
    indices = create_indices(lib, pred, E, tau, Tp, embedded, series.n, name)
    vectors = vectors_of(series, columns, targets[0], E, tau, Tp, embedded)
    if not ignoreNan and not vectors.where((within(indices.lib, F.col(ROW)) | within(indices.pred, F.col(ROW))) & ~F.col("ok")).isEmpty():
        raise ValueError(f"{name}: vectors with missing values, and ignoreNan is off")
    valid = valid_rows(series, validLib)
    if valid is not None and valid.where(within(indices.lib, F.col(ROW))).isEmpty():
        raise ValueError(f"{name}: no library row is valid")
    return State(series, names, targets[0], E, Tp, indices, vectors, valid)


def columns_in(validLib, df: DataFrame) -> list[str]:
    return list(df.columns) if isinstance(validLib, (Column, str)) else []


def state_frames(state: State, near: DataFrame) -> dict[str, DataFrame]:
    """The neighbours, the rows of library and predictions, the target and the embedding of a call."""
    named = [F.col(f"v{j}").alias(c) for j, c in enumerate(state.names)]
    return {
        "neighbors": near.select("p", "l", "d", "rank"),
        "lib_i": state.lib().select(F.col("l").alias(ROW)),
        "pred_i": state.pred().select(F.col("p").alias(ROW)),
        "target": state.series.df.select(ROW, quoted(state.target).alias("target")),
        "embedding": state.vectors.select(ROW, *named),
    }
