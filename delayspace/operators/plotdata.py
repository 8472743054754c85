"""What plots show, as frames and titles; drawn only where matplotlib is installed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import compute_error
from ..sources.series import quoted
from .state import Result


@dataclass
class Plot:
    """``frame`` has x and one column for each line; ``title`` and axis names go with it."""

    frame: DataFrame
    title: str
    x: str
    lines: list[str]

    def draw(self):
        """A matplotlib figure, or None without matplotlib."""
        try:
            import matplotlib.pyplot as plt
        except ImportError:
            return None
        data = self.frame.toPandas()
        figure, axes = plt.subplots(len(self.lines) if self.x == "Time" else 1, squeeze=False)
        for k, line in enumerate(self.lines):
            axis = axes[min(k, len(axes) - 1)][0]
            axis.plot(data["x"], data[line], label=line)
            axis.legend()
        figure.suptitle(self.title)
        return figure


def time_axis(df: DataFrame, column: str) -> Column:
    """Numbers and dates as they are; text as a date or a timestamp where it reads as one."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return quoted(column)
    return F.coalesce(F.expr(f"try_to_timestamp(`{column}`)"), F.expr(f"try_to_timestamp(`{column}`, 'yyyy-MM-dd')"))


def _number(x) -> str:
    return "NA" if x is None else f"{x:.4g}"


def plot_obs_pred(df: DataFrame, dataName: str = "", E: int = 0, Tp: int = 0) -> Plot:
    """Observations and Predictions over time; the title has rho and RMSE."""
    e = compute_error(df).head()
    time = df.columns[0]
    frame = df.select(time_axis(df, time).alias("x"), "Observations", "Predictions")
    return Plot(frame, f"{dataName}\nE={E} Tp={Tp}  rho={_number(e['rho'])}  RMSE={_number(e['RMSE'])}".strip(), time, ["Observations", "Predictions"])


def plot_smap(result: Result, dataName: str = "", E: int = 0, Tp: int = 0) -> list[Plot]:
    """The forecast, then one plot with a panel for each coefficient."""
    c = result.coefficients
    lines = c.columns[1:]
    frame = c.select(time_axis(c, "Time").alias("x"), *[quoted(n) for n in lines])
    return [plot_obs_pred(result.predictions, dataName, E, Tp), Plot(frame, f"{dataName} S-map coefficients".strip(), "Time", lines)]


def plot_sweep(df: DataFrame, xlab: str = "", title: str = "") -> Plot:
    """rho by the swept value."""
    return Plot(df.select(quoted(df.columns[0]).alias("x"), "rho"), title, xlab or df.columns[0], ["rho"])


def plot_ccm(df: DataFrame, E: int = 0) -> Plot:
    """Skill of both directions by library size."""
    lines = [c for c in df.columns[1:] if not c.endswith("_var")]
    return Plot(df.select(quoted(df.columns[0]).alias("x"), *[quoted(c) for c in lines]), f"E={E}", "Library size", lines)
