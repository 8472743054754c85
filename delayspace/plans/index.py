"""Which rows are library and which are predicted: the logical plan of a forecast."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.args import parse_pairs


@dataclass(frozen=True)
class Indices:
    """Inclusive row ranges: library, predicted rows (trimmed) and as they were given."""

    lib: list[tuple[int, int]]
    pred: list[tuple[int, int]]
    pred_given: list[tuple[int, int]]

    @property
    def n_lib(self) -> int:
        return sum(b - a + 1 for a, b in self.lib)

    @property
    def n_pred(self) -> int:
        return sum(b - a + 1 for a, b in self.pred)


def within(ranges: list[tuple[int, int]], row: Column) -> Column:
    """Condition that a row is in one of the ranges."""
    return reduce(lambda x, y: x | y, [row.between(a, b) for a, b in ranges], F.lit(False))


def create_indices(lib, pred, E: int, tau: int, Tp: int, embedded: bool, n_rows: int, name: str = "") -> Indices:
    """Library ranges lose the rows whose lags reach outside of them and, the last one, those whose target would; predicted ones the first or last rows of the series that have no lags. Ranges that nothing is left of raise, for the library, or go."""
    reach = 0 if embedded else abs(tau) * (E - 1)
    given: dict[str, list[tuple[int, int]]] = {"lib": parse_pairs(lib, "lib"), "pred": parse_pairs(pred, "pred")}
    for what, pairs in given.items():
        for a, b in pairs:
            if a < 1 or a >= b:
                raise ValueError(f"{name}: {what} range {a} {b}: the start must be 1 or more and below the end")
            if b > n_rows:
                raise ValueError(f"{name}: {what} range {a} {b} is beyond the {n_rows} rows")
    ranges = []
    for k, (a, b) in enumerate(given["lib"]):
        if tau < 0:
            a += reach
        else:
            b -= reach
        if Tp < 0 and not embedded:
            a += abs(Tp) - 1
        elif Tp >= 0 and k == len(given["lib"]) - 1:
            b -= Tp
        if a > b:
            raise ValueError(f"{name}: nothing is left of library range {given['lib'][k]}")
        ranges.append((a, b))
    lo, hi = (1 + reach, n_rows) if tau < 0 else (1, n_rows - reach)
    trimmed = [(max(a, lo), min(b, hi)) for a, b in given["pred"]]
    return Indices(ranges, [(a, b) for a, b in trimmed if a <= b], given["pred"])
