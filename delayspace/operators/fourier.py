"""Discrete Fourier transforms of long series, in four steps.

A series of n = n1 * n2 numbers is a matrix: its columns are transformed, turned by a factor for each cell, and its rows transformed, with an
exchange between. A task has some columns or rows, never the series. A length without divisors near its root goes by chirps: the transform is a
convolution then, of a length that is a power of two.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a group of columns or rows, about; longest column or row.
GROUP, LONGEST = 262_144, 4_000_000


def divisor(n: int) -> int:
    """The largest divisor of n up to its root."""
    return next(d for d in range(isqrt(n), 0, -1) if n % d == 0)


def _of(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _turned(product: np.ndarray, n: int, inverse: bool) -> np.ndarray:
    return np.exp((2j if inverse else -2j) * np.pi * ((product % n) / n))


def _lines(t: pa.Table, line: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the lines, lines as rows of a complex matrix)."""
    names, at = np.unique(line, return_inverse=True)
    m = np.zeros((len(names), length), complex)
    m[at, place] = _of(t, "re") + 1j * _of(t, "im")
    return names, m


def _result(keys: Sequence[str], t: pa.Table, index: np.ndarray, values: np.ndarray) -> pa.Table:
    first = [pa.array(np.full(index.size, t.column(c)[0].as_py()), t.column(c).type) for c in keys]
    return pa.Table.from_arrays([*first, pa.array(index.ravel()), pa.array(values.real.ravel()), pa.array(values.imag.ravel())], names=[*keys, "i", "re", "im"])


def transform(series: DataFrame, n: int, keys: Sequence[str] = (), inverse: bool = False) -> DataFrame:
    """(keys, i, re, im) of the transform of each series (keys, i, re, im) of n numbers, i from 0; ``inverse`` turns the other way, and divides by n."""
    n1 = divisor(n)
    if n // n1 > LONGEST:
        return _by_chirps(series, n, keys, inverse)
    n2 = n // n1
    fft = np.fft.ifft if inverse else np.fft.fft
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema) + (", " if keys else "") + "i long, re double, im double"

    def columns(t: pa.Table) -> pa.Table:
        i = _of(t, "i")
        names, m = _lines(t, i % n2, i // n2, n1)
        m = fft(m, axis=1)
        k = np.arange(n1)[None]
        return _result(keys, t, k * n2 + names[:, None], m * _turned(k * names[:, None], n, inverse))

    def rows(t: pa.Table) -> pa.Table:
        i = _of(t, "i")
        names, m = _lines(t, i // n2, i % n2, n2)
        return _result(keys, t, names[:, None] + n1 * np.arange(n2)[None], fft(m, axis=1))

    group = lambda line, length: F.floor(line / max(1, GROUP // length)).alias("_group")
    done = series.select(*keys, "i", "re", "im", group(F.col("i") % n2, n1)).groupBy(*keys, "_group").applyInArrow(columns, schema)
    return done.select(*keys, "i", "re", "im", group(F.floor(F.col("i") / n2), n2)).groupBy(*keys, "_group").applyInArrow(rows, schema)


def _times(df: DataFrame, re, im) -> list:
    """The product of (re, im) of ``df`` with another complex number, as columns."""
    return [(df["re"] * re - df["im"] * im).alias("re"), (df["re"] * im + df["im"] * re).alias("im")]


def _by_chirps(series: DataFrame, n: int, keys: Sequence[str], inverse: bool) -> DataFrame:
    """By a convolution with chirps, w(i) = exp(-pi i^2 / n): the transform is w(k) times that of x w with the chirp turned back."""
    m = 1 << (2 * n - 1).bit_length()
    sign = 1 if inverse else -1
    angle = lambda i: F.lit(np.pi / n) * (i * i % (2 * n))
    w = (F.cos(angle(F.col("i"))), sign * F.sin(angle(F.col("i"))))
    chirped = series.select(*keys, "i", *_times(series, *w))
    spark = series.sparkSession
    back = spark.range(n).select(F.col("id").alias("i"), F.cos(angle(F.col("id"))).alias("re"), (-sign * F.sin(angle(F.col("id")))).alias("im"))
    back = back.union(back.where("i > 0").select((m - F.col("i")).alias("i"), "re", "im"))
    a = transform(chirped, m, keys)
    b = transform(back, m).select(F.col("i").alias("i"), F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    both = a.join(b, "i")
    made = transform(both.select(*keys, "i", *_times(both, F.col("re_b"), F.col("im_b"))), m, keys, True).where(F.col("i") < n)
    out = made.select(*keys, "i", *_times(made, *w))
    return out.select(*keys, "i", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im")) if inverse else out
