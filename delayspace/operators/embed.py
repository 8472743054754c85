"""Time-delay embedding: lagged columns as one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.args import split_columns
from ..sources.series import ROW, Series, load, quoted, resolve_input, shifted


def lag_names(columns: Sequence[str], E: int, tau: int) -> list[str]:
    """``c(t-lag)`` for a negative tau, ``c(t+lag)`` for a positive one."""
    return [f"{c}(t{'-' if tau < 0 else '+'}{k * abs(tau)})" for c in columns for k in range(E)]


def check_embedding(df_columns: Sequence[str], columns: Sequence[str], E: int, tau: int, name: str = "Embed") -> None:
    if E < 1:
        raise ValueError(f"{name}: E must be 1 or more")
    if tau == 0:
        raise ValueError(f"{name}: tau must not be 0")
    missing = [c for c in columns if c not in df_columns]
    if missing or not columns:
        raise ValueError(f"{name}: columns not found: {', '.join(missing) or 'none given'}")


def lag_columns(columns: Sequence[str], E: int, tau: int, names: Sequence[str]) -> dict[str, tuple[str, int]]:
    """What each name holds: (column, rows ahead), column by column, lags in order."""
    return dict(zip(names, [(c, tau * k) for c in columns for k in range(E)], strict=True))


def embed_series(series: Series, columns: Sequence[str], E: int, tau: int) -> DataFrame:
    """row_id, time and the named lags."""
    names = lag_names(columns, E, tau)
    out = shifted(series.df, series.n, lag_columns(columns, E, tau, names), keep=[series.time])
    return out.select(ROW, quoted(series.time), *[quoted(c) for c in names])


def embed(dataFrame: DataFrame | None = None, E: int = 0, tau: int = -1, columns: str | Sequence[str] = "", includeTime: bool = False, pathIn: str = "./", dataFile: str = "", plusminus: bool = False, spark=None) -> DataFrame:
    """Lags 0, tau, 2 tau .. of each column, in the order of the series, null where they reach outside of it.

    With ``plusminus``, both lags and leads of all columns (by default), and lag 0 under the column's own name, after
    the time. Partial rows stay. ``row_id`` is not part of the result; order by the time, or use :func:`embed_series`.
    """
    df, order = resolve_input(spark, dataFrame, dataFile, pathIn)
    names = split_columns(columns)
    if plusminus and not names:
        names = df.columns[1:]
    check_embedding(df.columns, names, E, tau)
    series = load(df, order=order, keep=names, no_time=df.columns[0] in names)
    if not plusminus:
        out = embed_series(series, names, E, tau)
        return out.orderBy(ROW).select(*([quoted(series.time)] if includeTime else []), *[quoted(c) for c in lag_names(names, E, tau)])
    tau = -abs(tau)
    wanted = lag_columns(names, E, tau, lag_names(names, E, tau)) | lag_columns(names, E, -tau, lag_names(names, E, -tau))
    kept = {k: v for k, v in wanted.items() if not k.endswith("(t+0)")}
    out = shifted(series.df, series.n, kept, keep=[series.time]).orderBy(ROW)
    return out.select(quoted(series.time), *[quoted(k).alias(k.removesuffix("(t-0)")) for k in kept])

