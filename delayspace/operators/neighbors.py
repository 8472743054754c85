"""State-space nearest neighbours: the one join.

Library and predicted rows meet where they are more than the exclusion radius apart; each predicted row keeps its k
nearest by (distance, |p - l|, l). Small searches are a theta join with the library broadcast.

Larger ones go by an index: a tree grown from a sample deals the library to cells, whose bounding boxes are known exactly. A predicted row is searched
in its own cell first; the k-th distance found there says which other cells its ball reaches, and only to those it goes on. Where balls reach most cells, as in many
dimensions, or k is a large part of the library, tiles of library and prediction chunks are searched in full. Either way array kernels search, and their k best
merge in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.boxes import Boxes
from ..functions.kernels import nearest
from ..sources.scratch import cut

#: A theta join makes so many pairs at most, of a broadcast library of so many rows at most.
PAIRS, BROADCAST = 20_000_000, 100_000
#: Rows of a tile's side at most, and tiles for each core at least.
TILE, WAVES = 20_000, 4
#: Library rows of a cell, about; cells at most; rows of the sample for each cell; predicted rows of a cell that a task searches.
CELL, CELLS, SAMPLED, PART = 4_096, 16_384, 16, 32_768
#: Pairs times views of a tile, about.
WORK = 64_000_000
#: Dimensions that an index is tried in, and the part of the cells that a row may reach on average.
DIMENSIONS, REACH = 12, 0.25


def euclidean(dims: int, a: str = "a", b: str = "b") -> Column:
    """Distance of vectors in columns a0.. and b0.., squares added in the order of dimensions."""
    total = None
    for j in range(dims):
        diff = F.col(f"{a}{j}") - F.col(f"{b}{j}")
        total = diff * diff if total is None else total + diff * diff
    return F.sqrt(total)


def ranked_neighbors(pairs: DataFrame, k: int | Column, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """The k nearest of (keys, p, l, d, ..): ties by |p - l|, then l; with their ``rank``.

    Where k is a column, ``most`` is a number that it never exceeds: up to that, rows are dropped before they are shuffled.
    """
    w = W.partitionBy(*keys, "p").orderBy("d", F.abs(F.col("p") - F.col("l")), "l")
    ranked = pairs.withColumn("rank", F.row_number().over(w))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).where(F.col("rank") <= k)


def neighbors(pred: DataFrame, lib: DataFrame, dims: int, k: int | Column, radius: int | Column, n_pred: int | None = None, n_lib: int | None = None, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """(keys, p, l, d, rank, carry) with p, a0.. of ``pred`` and l, b0.., carry of ``lib``; keys join both.

    ``n_pred`` and ``n_lib`` bound the rows; without them, or beyond the limits above, tiles are used where radius and
    k are plain numbers. Fewer eligible neighbours than k are not filled up; rows without any do not appear.
    """
    plain = isinstance(k, int) and isinstance(radius, int)
    if keys and n_lib is None:
        # series side by side: an equi-join on their keys, or tiles where that makes too many pairs
        sizes = pred.groupBy(*keys).agg(F.count("*").alias("_p")).join(lib.groupBy(*keys).agg(F.count("*").alias("_l")), list(keys))
        if plain and (sizes.agg(F.sum(F.col("_p").cast("double") * F.col("_l"))).head()[0] or 0) > PAIRS:
            return panel_neighbors(pred, lib, dims, k, radius, keys, sizes, carry)
        pairs = pred.join(lib, list(keys)).where(F.abs(F.col("p") - F.col("l")) > radius)
        return ranked_neighbors(pairs.withColumn("d", euclidean(dims)), k, keys).select(*keys, "p", "l", "d", "rank", *carry)
    small = n_pred is not None and n_lib is not None and n_lib <= BROADCAST and n_pred * n_lib <= PAIRS
    if small or not plain:
        on = F.abs(F.col("p") - F.col("l")) > radius
        for key in keys:
            on = on & (pred[key] == lib[key])
        right = F.broadcast(lib) if n_lib is not None and n_lib <= BROADCAST else lib
        pairs = pred.join(right, on)
        for key in keys:
            pairs = pairs.drop(lib[key])
        return ranked_neighbors(pairs.withColumn("d", euclidean(dims)), k, keys).select(*keys, "p", "l", "d", "rank", *carry)
    if n_lib and k <= CELL // 8 and n_lib > 2 * CELL and dims <= DIMENSIONS:
        return indexed_neighbors(pred, lib, dims, k, radius, n_pred or TILE, n_lib, carry)
    return tiled_neighbors(pred, lib, dims, k, radius, n_pred or TILE, n_lib or TILE, carry)


def _of(t, *names: str) -> np.ndarray:
    """Columns of an Arrow table or batch side by side, or one by itself."""
    got = [np.asarray(c.combine_chunks() if isinstance(c := t.column(n), pa.ChunkedArray) else c) for n in names]
    return got[0] if len(names) == 1 else np.column_stack(got)


def _states(t, side: str, dims: int) -> np.ndarray:
    return _of(t, *[f"{side}{j}" for j in range(dims)]).reshape(t.num_rows, dims)


def _in_cells(df: DataFrame, tree: Boxes, side: str, row: str, dims: int) -> DataFrame:
    """``df`` with the ``cell`` that its states are in."""

    def run(batches):
        for b in batches:
            yield b.append_column("cell", pa.array(tree.leaf(_states(b, side, dims), _of(b, row)).astype(np.int32)))

    return df.mapInArrow(run, df.schema.simpleString()[len("struct<") : -1] + ",cell:int")


def _by_cell(asked: DataFrame, cells: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over each cell's asking rows and library rows; a cell that many ask is there more than once."""
    parts = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    left = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")).drop("parts")
    right = cells.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(kernel, schema)


def _search_home(dims: int, k: int, radius: int, carry: Sequence[tuple[str, pa.DataType]], counted):
    """Each row with its k nearest of its own cell as lists, and the last's distance and row difference."""
    schema = pa.schema([("p", pa.int64()), *[(f"a{j}", pa.float64()) for j in range(dims)], ("cell", pa.int32()), ("far", pa.float64()), ("gap", pa.float64()), ("l", pa.list_(pa.int64())), ("d", pa.list_(pa.float64())), *[(c, pa.list_(t)) for c, t in carry]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from ..functions.boxes import boxed_nearest

        n, p_rows, a = left.num_rows, _of(left, "p"), _states(left, "a", dims)
        l_rows = _of(right, "l")
        i, j, d, pairs = boxed_nearest(p_rows, a, l_rows, _states(right, "b", dims), k, radius)
        if counted is not None:
            counted.add(pairs)
        many = np.bincount(i, minlength=n)
        ends = np.cumsum(many)
        far, gap, full = np.full(n, np.inf), np.full(n, np.inf), many >= k
        far[full], gap[full] = d[ends[full] - 1], np.abs(p_rows[full] - l_rows[j[ends[full] - 1]])
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(l_rows[j]), pa.array(d), *[right.column(c).combine_chunks().take(pa.array(j)) for c, _ in carry])]
        return pa.Table.from_arrays([*[left.column(c) for c in schema.names[: dims + 2]], pa.array(far), pa.array(gap), *lists], schema=schema)

    return run


def _visits(tree: Boxes, dims: int, k: int, radius: int):
    """Each row for every cell but its own that may hold some of its k nearest."""

    def run(batches):
        for b in batches:
            rows, states, home = _of(b, "p"), _states(b, "a", dims), _of(b, "cell")
            far, gap = _of(b, "far").copy(), _of(b, "gap")
            short = np.flatnonzero(np.isinf(far))
            far[short] = tree.bound(states[short], k + 2 * radius + 1)
            slim = b.select(["p", *[f"a{j}" for j in range(dims)]])
            for who, cell in tree.reach(states, rows, far, gap, radius):
                away = cell != home[who]
                part = slim.take(pa.array(who[away]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[away].astype(np.int32)), pa.array(far[who[away]]), pa.array(gap[who[away]])], names=[*part.schema.names, "cell", "far", "gap"])

    return run


def _search_visit(dims: int, k: int, radius: int, carry: Sequence[tuple[str, pa.DataType]], counted):
    schema = pa.schema([("p", pa.int64()), ("l", pa.int64()), ("d", pa.float64()), *carry])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from ..functions.boxes import boxed_nearest

        p_rows, l_rows = _of(left, "p"), _of(right, "l")
        i, j, d, pairs = boxed_nearest(p_rows, _states(left, "a", dims), l_rows, _states(right, "b", dims), k, radius, _of(left, "far"), _of(left, "gap"))
        if counted is not None:
            counted.add(pairs)
        return pa.Table.from_arrays([pa.array(p_rows[i]), pa.array(l_rows[j]), pa.array(d), *[right.column(c).combine_chunks().take(pa.array(j)) for c, _ in carry]], schema=schema)

    return run


def indexed_neighbors(pred: DataFrame, lib: DataFrame, dims: int, k: int, radius: int, n_pred: int, n_lib: int, carry: Sequence[str] = (), counted=None) -> DataFrame:
    """As :func:`neighbors`, by an index of cells. ``counted``, an accumulator, gets the number of pairs whose distance was worked out.

    The driver holds a sample of the library, SAMPLED rows for each cell, and the boxes of the cells, whose number has a bound.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    depth = max(1, min(int(np.ceil(np.log2(n_lib / CELL))), int(np.log2(CELLS))))
    share = min(1_000_000_007, max(1, round(1_000_000_007 * (SAMPLED << depth) / n_lib)))
    some = lib.where(F.pmod(F.xxhash64("l"), F.lit(1_000_000_007)) < F.lit(share)).select("l", *[f"b{j}" for j in range(dims)]).limit(2 * (SAMPLED << depth)).toArrow()
    tree = Boxes.grow(_states(some, "b", dims), _of(some, "l"), depth)
    cells = cut(_in_cells(lib.select("l", *[f"b{j}" for j in range(dims)], *carry), tree, "b", "l", dims), "cells")
    ends = cells.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in (*[f"b{j}" for j in range(dims)], "l")]).toArrow()
    low, high, count = np.full((tree.leaves, dims + 1), np.inf), np.full((tree.leaves, dims + 1), -np.inf), np.zeros(tree.leaves, np.int64)
    at, names = _of(ends, "cell"), [*[f"b{j}" for j in range(dims)], "l"]
    low[at], high[at], count[at] = _of(ends, *[f"min_{c}" for c in names]), _of(ends, *[f"max_{c}" for c in names]), _of(ends, "n")
    tree.fit(low, high, count)

    carried = [(f.name, f.type) for f in to_arrow_schema(cells.select(*carry).schema)]
    vector = "".join(f", a{j} double" for j in range(dims))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    home = _by_cell(_in_cells(pred.select("p", *[f"a{j}" for j in range(dims)]), tree, "a", "p", dims), cells, _search_home(dims, k, radius, carried, counted), f"p long{vector}, cell int, far double, gap double, l array<long>, d array<double>" + "".join(f", {c} array<{kinds[c]}>" for c in carry))
    home = cut(home, "home")
    # a few rows tell whether balls are small beside the cells
    some = home.where(F.pmod(F.xxhash64("p"), F.lit(1_000_000_007)) < F.lit(max(1, round(1_000_000_007 * min(1.0, 512 / n_pred))))).limit(1_024).drop("l", "d", *carry).toArrow()
    reached = sum(b.num_rows for x in some.to_batches() for b in _visits(tree, dims, k, radius)([x]))
    if some.num_rows and reached > REACH * tree.leaves * some.num_rows:
        return tiled_neighbors(pred, lib, dims, k, radius, n_pred, n_lib, carry)
    visits = cut(home.drop("l", "d", *carry).mapInArrow(_visits(tree, dims, k, radius), f"p long{vector}, cell int, far double, gap double"), "visits")
    away = _by_cell(visits, cells, _search_visit(dims, k, radius, carried, counted), "p long, l long, d double" + "".join(f", {c} {kinds[c]}" for c in carry))
    own = home.select("p", F.explode(F.arrays_zip("l", "d", *carry)).alias("x")).select("p", *[F.col(f"x.{c}").alias(c) for c in ("l", "d", *carry)])
    return ranked_neighbors(own.union(away), k, ()).select("p", "l", "d", "rank", *carry)


def _codes(left: pa.Table, right: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where all the named columns are, for the rows of both tables."""
    total = np.zeros(left.num_rows + right.num_rows, np.int64)
    for c in names:
        both = pa.chunked_array([*left.column(c).chunks, *right.column(c).chunks], type=left.column(c).type)
        coded = np.asarray(both.combine_chunks().dictionary_encode().indices).astype(np.int64)
        _, total = np.unique(total * (coded.max(initial=0) + 1) + coded, return_inverse=True)
    return total[: left.num_rows], total[left.num_rows :]


def _search_panel(dims: int, k: int, radius: int, keys: Sequence[str], carry: Sequence[str], schema: pa.Schema):
    """Neighbours within each series and chunk of the group's rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        from ..functions.boxes import boxed_nearest

        a_of, b_of = _codes(left, right, [*keys, "_down", "_across"])
        p_rows, a, l_rows, b, out = _of(left, "p"), _states(left, "a", dims), _of(right, "l"), _states(right, "b", dims), []
        a_by, b_by = np.argsort(a_of, kind="stable"), np.argsort(b_of, kind="stable")
        for code in np.intersect1d(a_of, b_of):
            own = a_by[np.searchsorted(a_of[a_by], code) : np.searchsorted(a_of[a_by], code, side="right")]
            lib = b_by[np.searchsorted(b_of[b_by], code) : np.searchsorted(b_of[b_by], code, side="right")]
            i, j, d, _ = boxed_nearest(p_rows[own], a[own], l_rows[lib], b[lib], k, radius)
            out.append((own[i], lib[j], d))
        i, j, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        i, j = pa.array(i), pa.array(j)
        return pa.Table.from_arrays([*[left.column(c).combine_chunks().take(i) for c in (*keys, "p")], right.column("l").combine_chunks().take(j), pa.array(d), *[right.column(c).combine_chunks().take(j) for c in carry]], schema=schema)

    return run


def panel_neighbors(pred: DataFrame, lib: DataFrame, dims: int, k: int, radius: int, keys: Sequence[str], sizes: DataFrame, carry: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """As :func:`neighbors`, for series side by side whose numbers of rows are in ``sizes`` (keys, _p, _l).

    Short series are packed, so many to a task, and long ones split into tiles of chunks, so that no task has all of a series. A null key
    meets none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held = cut(sizes.select(*keys, F.ceil(F.col("_p") / tile).cast("int").alias("_ps"), F.ceil(F.col("_l") / tile).cast("int").alias("_ls"), "_p", "_l"), "sizes")
    packs = max(1, -(-(held.where("_ps = 1 AND _ls = 1").agg(F.sum(F.col("_p") + F.col("_l"))).head()[0] or 0) // (2 * tile)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunk = lambda c, n: F.pmod(F.col(c), F.col(n)).cast("int")
    # a series of one tile shares its group with others; tiles of longer ones have groups of their own
    group = F.when((F.col("_ps") == 1) & (F.col("_ls") == 1), F.pmod(F.xxhash64(*keys), F.lit(packs))).otherwise(packs + F.pmod(F.xxhash64(*keys, "_down", "_across"), F.lit(1 << 40))).alias("_group")
    left = pred.join(held, list(keys)).withColumn("_down", chunk("p", "_ps")).withColumn("_across", every("_ls")).select(group, *keys, "_down", "_across", "p", *[f"a{j}" for j in range(dims)])
    right = lib.join(held, list(keys)).withColumn("_across", chunk("l", "_ls")).withColumn("_down", every("_ps")).select(group, *[F.col(c).alias(c) for c in keys], "_down", "_across", "l", *[f"b{j}" for j in range(dims)], *carry)
    kinds = {**{f.name: f.dataType.simpleString() for f in left.schema}, **{f.name: f.dataType.simpleString() for f in right.schema}}
    names = [*keys, "p", "l", "d", *carry]
    schema = to_arrow_schema(left.select(*keys, "p").schema).append(pa.field("l", pa.int64())).append(pa.field("d", pa.float64()))
    for f in to_arrow_schema(right.select(*carry).schema):
        schema = schema.append(f)
    found = left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(_search_panel(dims, k, radius, keys, carry, schema), ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in names))
    return ranked_neighbors(found, k, keys).select(*keys, "p", "l", "d", "rank", *carry)


def _tile(dims: int, k: int, radius: int, carry: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of = lambda t, c: np.asarray(t.column(c).combine_chunks())
        names = ["p", "l", "d", *carry]
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c in ("p", "l") else pa.float64()) for c in names})
        p_rows, l_rows = of(left, "p"), of(right, "l")
        a = np.column_stack([of(left, f"a{j}") for j in range(dims)])
        b = np.column_stack([of(right, f"b{j}") for j in range(dims)])
        out = {c: [] for c in names}
        step = max(1, 4_000_000 // len(b))
        for at in range(0, len(a), step):
            i, j, d = nearest(p_rows[at : at + step], a[at : at + step], l_rows, b, k, radius)
            out["p"].append(p_rows[at : at + step][i])
            out["l"].append(l_rows[j])
            out["d"].append(d)
            for c in carry:
                out[c].append(right.column(c).combine_chunks().to_numpy(zero_copy_only=False)[j])
        return pa.table({c: pa.array(np.concatenate(v), from_pandas=True) for c, v in out.items()})

    return run


def tiled_neighbors(pred: DataFrame, lib: DataFrame, dims: int, k: int, radius: int, n_pred: int, n_lib: int, carry: Sequence[str] = ()) -> DataFrame:
    """As :func:`neighbors`, over tiles: neither side is ever in one place. Carried columns are doubles.

    Tiles are smaller where there would be too few for all cores. They are dealt by a shuffle of their own: rows that a window numbered lie in one
    partition, which Spark takes as grouped by any columns, and one task would search all tiles.
    """
    cores = pred.sparkSession.sparkContext.defaultParallelism
    side = max(1, TILE // 8, min(TILE, int((n_pred * n_lib / (WAVES * cores)) ** 0.5)))
    down, across = max(1, -(-n_pred // side)), max(1, -(-n_lib // side))
    left = pred.select(F.pmod(F.col("p"), F.lit(down)).cast("int").alias("_down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_across"), "p", *[f"a{j}" for j in range(dims)])
    right = lib.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_down"), F.pmod(F.col("l"), F.lit(across)).cast("int").alias("_across"), "l", *[f"b{j}" for j in range(dims)], *carry)
    schema = "p long, l long, d double" + "".join(f", {c} double" for c in carry)
    left, right = (df.repartition(down * across, "_down", "_across") for df in (left, right))
    best = left.groupBy("_down", "_across").cogroup(right.groupBy("_down", "_across")).applyInArrow(_tile(dims, k, radius, carry), schema)
    return ranked_neighbors(best, k, ()).select("p", "l", "d", "rank", *carry)


class View(NamedTuple):
    """Some of the columns of wide states, in the order in which their squares are added; rows from ranges, if there are any."""

    id: int
    places: Sequence[int]
    k: int
    pred: Sequence[tuple[int, int]] = ()
    lib: Sequence[tuple[int, int]] = ()


def _in_ranges(rows: np.ndarray, ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    return np.any([(rows >= a) & (rows <= b) for a, b in ranges], axis=0) if ranges else np.ones(len(rows), bool)


def _search_views(dims: int, dealt: Sequence[Sequence[View]], radius: int):
    """(view, p, l, d, y): the k first of a tile's rows in each view. Squares are worked out once for all, and a view that begins like the one before goes on from its sum."""
    schema = pa.schema([("view", pa.int32()), ("p", pa.int64()), ("l", pa.int64()), ("d", pa.float64()), ("y", pa.float64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        of = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        p_rows, l_rows, y, out = of(left, "p"), of(right, "l"), of(right, "y").astype(float), []
        a, b = ([of(t, f"{side}{j}").astype(float) for j in range(dims)] for t, side in ((left, "a"), (right, "b")))
        step = max(1, kernels.CELLS // (len(l_rows) * dims))
        for at in range(0, len(p_rows), step):
            here = slice(at, at + step)
            gap = np.abs(p_rows[here, None] - l_rows[None])
            square = [(x[here, None] - z[None]) ** 2 for x, z in zip(a, b, strict=True)]
            total, added = np.zeros(gap.shape), ()
            for view in dealt[key[2].as_py()]:
                places = tuple(view.places)
                if places[: len(added)] != added:
                    total, added = np.zeros(gap.shape), ()
                for j in places[len(added) :]:
                    total = total + square[j]
                added = places
                # a row whose lags a view lacks has no distance in it
                ok = (gap > radius) & ~np.isnan(total) & _in_ranges(p_rows[here], view.pred)[:, None] & _in_ranges(l_rows, view.lib)
                d = np.where(ok, np.sqrt(total), np.inf)
                i, j = np.nonzero(kernels.k_first(d, gap, l_rows, view.k))
                out.append(pa.Table.from_arrays([pa.array(np.full(len(i), view.id, np.int32)), pa.array(p_rows[here][i]), pa.array(l_rows[j]), pa.array(d[i, j]), pa.array(y[j], from_pandas=True)], schema=schema))
        return pa.concat_tables(out)

    return run


def view_neighbors(pred: DataFrame, lib: DataFrame, dims: int, views: Sequence[View], radius: int, n_pred: int, n_lib: int, tile: int = TILE) -> DataFrame:
    """(view, p, l, d, rank, y) of all views from one pass: tiles hand on k neighbours of each row and view, and no pairs."""
    down, across = max(1, -(-n_pred // tile)), max(1, -(-n_lib // tile))
    parts = max(1, min(len(views), -(-min(n_pred, tile) * min(n_lib, tile) * len(views) // WORK)))
    # neighbouring views stay together, as they may begin alike
    size = -(-len(views) // parts)
    dealt = [list(views[at : at + size]) for at in range(0, len(views), size)]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunk = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("int")
    left = pred.select(chunk("p", down).alias("_down"), every(across).alias("_across"), *pred.columns).withColumn("_part", every(len(dealt)))
    right = lib.select(every(down).alias("_down"), chunk("l", across).alias("_across"), *[F.col(c).alias(c) for c in lib.columns]).withColumn("_part", every(len(dealt)))
    at = ["_down", "_across", "_part"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_search_views(dims, dealt, radius), "view int, p long, l long, d double, y double")
    k = F.create_map(*[F.lit(x) for v in views for x in (v.id, v.k)])[F.col("view")] if len({v.k for v in views}) > 1 else views[0].k
    return ranked_neighbors(found, k, ["view"], max(v.k for v in views))
