"""DuckDB SQL for the same rows as the registered queries, written from the definitions and not from the plans."""

from __future__ import annotations

from itertools import combinations

from ..operators.sweeps import RADII as ALL_RADII
from ..operators.sweeps import THETAS as ALL_THETAS
from .queries import CCM_SIZES, CCM_TRIALS, EMBEDDED_DIMS, RADII, SEED, THETAS

HOURLY = """h AS (SELECT strftime(ts, '%Y%m%d%H')::BIGINT AS t, count(*)::DOUBLE AS x, round(avg(value), 4) AS y FROM events GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY t) AS row_id, t, x, y FROM h),
m AS (SELECT count(*) AS n FROM s)"""
HOLED = HOURLY.replace("s AS (", "s0 AS (").replace("FROM s)", "FROM s0)") + """,
s AS (SELECT row_id, t, CASE WHEN row_id % 17 != 0 THEN x END AS x, CASE WHEN row_id % 23 != 0 THEN y END AS y FROM s0)"""

PRICES = """s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS row_id, o_orderkey AS t, o_totalprice::DOUBLE AS x, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS y FROM orders),
m AS (SELECT count(*) AS n FROM s)"""


def shift(c: str, by: int, over: str = "ORDER BY row_id") -> str:
    return f"lead({c}, {by}) OVER ({over})" if by >= 0 else f"lag({c}, {-by}) OVER ({over})"


def named(columns: list[str], E: int, tau: int) -> dict[str, str]:
    return {f"{c}(t{'-' if tau < 0 else '+'}{k * abs(tau)})": shift(c, tau * k) for c in columns for k in range(E)}


def picked(columns: dict[str, str], *first: str, digits: int = 6) -> str:
    return ", ".join([*first, *[f'round({v}, {digits}) AS "{k}"' for k, v in columns.items()]])


class Forecast:
    """Common table expressions e (states), lib, prd, nbr (ranked neighbours) and f (pred, var)."""

    def __init__(self, columns="x", target="x", E=3, Tp=1, tau=-1, embedded=False, radius=0, k=None, lib="half", valid="true", base=HOURLY, pred=None, long=False):
        self.columns, self.target, self.Tp, self.base = columns.split(), target, Tp, base
        self.E = len(self.columns) if embedded else E
        shifts = [(c, 0) for c in self.columns] if embedded else [(c, tau * j) for c in self.columns for j in range(E)]
        self.dims, reach = len(shifts), 0 if embedded else abs(tau) * (E - 1)
        self.k = k or self.E + 1
        last = "n" if lib == "all" else "n // 2"
        first = 1 + reach + (abs(Tp) - 1 if Tp < 0 and not embedded else 0)
        self.lib_rows = f"row_id BETWEEN {first} AND {last} - {max(Tp, 0)}"
        if lib == "two":
            self.lib_rows = f"(row_id BETWEEN {1 + reach} AND 100 OR row_id BETWEEN {200 + reach} AND n // 2 - {max(Tp, 0)})"
        self.lo, self.hi = (f"{1 + reach}", "n") if lib == "all" else (f"greatest(n // 2 + 1, {1 + reach})", "n - 1")
        if pred:
            self.lo, self.hi = pred
        self.radius, self.valid, self.long = radius, valid, long
        vs = ", ".join(f"{shift(c, s)} AS v{j}" for j, (c, s) in enumerate(shifts))
        self.whole = " AND ".join(f"v{j} IS NOT NULL" for j in range(self.dims))
        self.states = f"e AS (SELECT row_id, x AS x_, y AS y_, {vs}, {shift(target, Tp)} AS future FROM s)"

    @property
    def distance(self) -> str:
        return "sqrt(" + " + ".join(f"(a.v{j} - b.v{j}) * (a.v{j} - b.v{j})" for j in range(self.dims)) + ")"

    def rows(self) -> str:
        return f"""{self.base},
{self.states},
lib AS (SELECT * FROM e, m WHERE {self.lib_rows} AND {self.whole} AND ({self.valid})),
prd AS (SELECT * FROM e, m WHERE row_id BETWEEN {self.lo} AND {self.hi} AND {self.whole}),"""

    def neighbours(self) -> str:
        if self.long:
            # the k least of many pairs by an aggregate, which keeps no more of them
            return f"""{self.rows()}
top AS (SELECT a.row_id AS p, min({{'d': {self.distance}, 'gap': abs(a.row_id - b.row_id), 'l': b.row_id, 'y': b.future}}, {self.k}) AS near FROM prd a, lib b WHERE abs(a.row_id - b.row_id) > {self.radius} GROUP BY a.row_id),
nbr AS (SELECT p, near[rank].l AS l, near[rank].y AS y, near[rank].d AS d, rank FROM top, (SELECT unnest(range(1, {self.k} + 1)) AS rank) WHERE rank <= len(near))"""
        return f"""{self.rows()}
prs AS (SELECT a.row_id AS p, b.row_id AS l, b.future AS y, {self.distance} AS d{"".join(f", a.v{j} AS a{j}, b.v{j} AS b{j}" for j in range(self.dims))} FROM prd a, lib b WHERE abs(a.row_id - b.row_id) > {self.radius}),
rnk AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, abs(p - l), l) AS rank FROM prs),
nbr AS (SELECT * FROM rnk WHERE rank <= {self.k})"""

    def projection(self) -> str:
        return f"""{self.neighbours()},
wgt AS (SELECT p, l, y, exp(-d / greatest(min(d) OVER (PARTITION BY p), 1e-6)) AS w FROM nbr),
mid AS (SELECT p, CASE WHEN count(y) = count(*) THEN sum(w * y) / sum(w) END AS pred FROM wgt GROUP BY p),
f AS (SELECT p, any_value(pred) AS pred, CASE WHEN any_value(pred) IS NOT NULL THEN sum(w * (y - pred) * (y - pred)) / sum(w) END AS var FROM wgt JOIN mid USING (p) GROUP BY p)"""

    def laid(self) -> str:
        early, late = min(self.Tp, 0), max(self.Tp, 0)
        seen = f"g.row_id BETWEEN greatest(1, {self.lo} + {early}) AND CASE WHEN {self.hi} + {late} <= n THEN {self.hi} + {late} ELSE {self.hi} END"
        return f"""{self.projection()},
g AS (SELECT unnest(generate_series({self.lo} + {early}, {self.hi} + {late})) AS row_id, n FROM m),
r AS (SELECT g.row_id, CASE WHEN {seen} THEN s.{self.target} END AS "Observations", f.pred AS "Predictions", f.var AS "Pred_Variance"
  FROM g LEFT JOIN s ON s.row_id = g.row_id LEFT JOIN f ON f.p + ({self.Tp}) = g.row_id)"""

    def layout(self, time: str = "row_id") -> str:
        return f'WITH {self.laid()}\nSELECT {time}, round("Observations", 6) AS "Observations", round("Predictions", 6) AS "Predictions", round("Pred_Variance", 6) AS "Pred_Variance" FROM r'

    def near(self) -> str:
        return f"WITH {self.neighbours()}\nSELECT p, l, rank, round(d, 6) AS d FROM nbr"

    def errors(self) -> str:
        return f'WITH {self.laid()},\nc AS (SELECT "Observations" AS o, "Predictions" AS q FROM r)\nSELECT {ERRORS} FROM c WHERE o IS NOT NULL AND q IS NOT NULL'


RHO = "covar_pop(o, q) / nullif(stddev_pop(o) * stddev_pop(q), 0)"
ERRORS = ", ".join(f"CASE WHEN count(*) >= 5 THEN round({e}, 6) END AS \"{k}\"" for k, e in {"rho": RHO, "MAE": "max(o - q)", "CAE": "sum(abs(o - q))", "RMSE": "sqrt(avg((o - q) * (o - q)))", "MAE_true": "avg(abs(o - q))"}.items())


def sweep(key: str, runs: list[tuple[object, Forecast]], kind: str = "INTEGER") -> str:
    parts = []
    for value, f in runs:
        parts.append(f"(WITH {f.laid()}\nSELECT {value}::{kind} AS \"{key}\", CASE WHEN count(*) >= 5 THEN round({RHO}, 6) END AS rho FROM (SELECT \"Observations\" AS o, \"Predictions\" AS q FROM r) WHERE o IS NOT NULL AND q IS NOT NULL)")
    return "SELECT * FROM " + "\nUNION ALL SELECT * FROM ".join(parts)


def local_map(f: Forecast, theta: float) -> str:
    """Expressions up to fit (p, c0.., pred, var): weighted least squares by elimination."""
    d = f.dims
    # the normal equations of (1, b0, ..) with the target as last column, and their rows taken away one after the other
    named = ["1", *[f"b{i}" for i in range(d)], "y"]
    cells = {f"g{i}_{j}": f"sum(u * {named[i]} * {named[j]})" for i in range(d + 1) for j in range(i, d + 2)}
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    steps = []
    for i in range(d + 1):
        rest = [f"{cell(j, m)} - {cell(i, j)} * {cell(i, m)} / {cell(i, i)} AS {cell(j, m)}" for j in range(i + 1, d + 1) for m in range(j, d + 2)]
        kept = [f"g{j}_{m}" for j in range(i + 1) for m in range(j, d + 2)]
        steps.append(f"el{i} AS (SELECT {', '.join(['p', *[f'a{j}' for j in range(d)], *kept, *rest])} FROM {f'el{i - 1}' if i else 'sm'})")
    for i in range(d, -1, -1):
        value = f"(g{i}_{d + 1}{''.join(f' - g{i}_{j} * c{j}' for j in range(i + 1, d + 1))}) / g{i}_{i}"
        steps.append(f"so{i} AS (SELECT *, {value} AS c{i} FROM {f'so{i + 1}' if i < d else f'el{d}'})")
    value = "c0 + " + " + ".join(f"c{i + 1} * a{i}" for i in range(d))
    return f"""{weighed_rows(f, theta)},
sm AS (SELECT p, {", ".join(f"any_value(a{i}) AS a{i}" for i in range(d))}, {", ".join(f"{e} AS {n}" for n, e in cells.items())} FROM wgt GROUP BY p),
{(","+chr(10)).join(steps)},
fp AS (SELECT p, {", ".join(f"c{i}" for i in range(d + 1))}, {value} AS pred FROM so0),
fit AS (SELECT fp.*, (SELECT sum(w * (y - fp.pred) * (y - fp.pred)) / sum(w) FROM wgt WHERE wgt.p = fp.p) AS var FROM fp)"""


def weighed_rows(f: Forecast, theta: float) -> str:
    """Expressions up to wgt: neighbours with a future, their weight w and its square u."""
    return f"""{f.neighbours()},
bar AS (SELECT *, avg(d) OVER (PARTITION BY p) AS dbar FROM nbr),
wgt AS (SELECT *, exp(-{theta} * d / dbar) AS w, exp(-{theta} * d / dbar) * exp(-{theta} * d / dbar) AS u FROM bar WHERE y IS NOT NULL)"""


def singular_sql(E: int, theta: float, sweeps: int = 7) -> str:
    """Singular values of the weighted (1, states): roots of the eigenvalues of their products, by rotations of pairs of axes until all others are zero."""
    f = Forecast("y", "y", E=E, k="(SELECT count(*) - 1 FROM lib)")
    n, named = E + 1, ["1", *[f"b{i}" for i in range(E)]]
    cell = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
    every = [(i, j) for i in range(n) for j in range(i, n)]
    steps, last = [f"r0 AS MATERIALIZED (SELECT p, {', '.join(f'sum(u * {named[i]} * {named[j]}) AS {cell(i, j)}' for i, j in every)} FROM wgt GROUP BY p)"], "r0"
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)] * sweeps
    for k, (x, y) in enumerate(pairs, 1):
        off, half = cell(x, y), f"(({cell(y, y)} - {cell(x, x)}) / (2 * {cell(x, y)}))"
        steps.append(f"t{k} AS (SELECT *, CASE WHEN {off} = 0 THEN 0 ELSE (CASE WHEN {half} < 0 THEN -1 ELSE 1 END) / (abs({half}) + sqrt({half} * {half} + 1)) END AS t FROM {last})")
        steps.append(f"u{k} AS (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM t{k})")
        new = {cell(x, x): f"{cell(x, x)} - t * {off}", cell(y, y): f"{cell(y, y)} + t * {off}", off: "0.0"}
        for i in set(range(n)) - {x, y}:
            new[cell(i, x)], new[cell(i, y)] = f"c * {cell(i, x)} - s * {cell(i, y)}", f"s * {cell(i, x)} + c * {cell(i, y)}"
        steps.append(f"r{k} AS MATERIALIZED (SELECT p, {', '.join(f'{new.get(cell(i, j), cell(i, j))} AS {cell(i, j)}' for i, j in every)} FROM u{k})")
        last = f"r{k}"
    values = f"list_reverse_sort([{', '.join(f'sqrt(greatest({cell(i, i)}, 0))' for i in range(n))}])"
    return f"""WITH {weighed_rows(f, theta)},
{(","+chr(10)).join(steps)},
v AS (SELECT p, {values} AS v FROM {last}),
g AS (SELECT unnest(generate_series({f.lo}, {f.hi} + 1)) AS row_id FROM m)
SELECT s.t AS "Time", {", ".join(f'round(v[{i + 1}], 6) AS "C{i}"' for i in range(n))} FROM g LEFT JOIN s USING (row_id) LEFT JOIN v ON v.p + 1 = g.row_id"""


def smap_sql(E: int, theta: float, target: str = "y") -> str:
    f = Forecast("y", target, E=E, k="(SELECT count(*) - 1 FROM lib)")
    return f"WITH {local_map(f, theta)}\nSELECT p, round(pred, 6) AS \"Predictions\", round(var, 6) AS \"Pred_Variance\", " + ", ".join(f"round(c{j}, 6) AS \"C{j}\"" for j in range(E + 1)) + " FROM fit"


def nonlinear_sql(thetas=THETAS) -> str:
    parts = []
    for theta in thetas:
        f = Forecast("x", "y", E=1, k="(SELECT count(*) - 1 FROM lib)")
        parts.append(f"(WITH {local_map(f, theta)}\nSELECT {theta}::DOUBLE AS \"Theta\", CASE WHEN count(*) >= 5 THEN round({RHO}, 6) END AS rho FROM (SELECT s.y AS o, fit.pred AS q FROM fit JOIN s ON s.row_id = fit.p + 1) WHERE o IS NOT NULL AND q IS NOT NULL)")
    return "SELECT * FROM " + "\nUNION ALL SELECT * FROM ".join(parts)


def cross_direction(name: str, a: str, b: str, E: int, Tp: int, radius: int, sizes: tuple[int, ...] | None) -> str:
    """Trials (direction, size, trial, rho) of states of a against b."""
    vs = ", ".join(f"{shift(a, -j)} AS v{j}" for j in range(E))
    whole = " AND ".join(f"v{j} IS NOT NULL" for j in range(E))
    dist = "sqrt(" + " + ".join(f"(p.v{j} - l.v{j}) * (p.v{j} - l.v{j})" for j in range(E)) + ")"
    if sizes:
        tasks = f"SELECT unnest([{', '.join(map(str, sizes))}]) AS lib_size, t.trial FROM (SELECT unnest(range({CCM_TRIALS})) AS trial) t"
        order = f"md5(concat_ws('|', '{SEED}', '{name}', tasks.lib_size::VARCHAR, tasks.trial::VARCHAR, row_id::VARCHAR))"
        size = "least(tasks.lib_size, count(*) OVER (PARTITION BY tasks.lib_size, tasks.trial))"
    else:
        tasks, order, size = "SELECT n AS lib_size, 0 AS trial FROM m", "row_id", "tasks.lib_size"
    return f"""(WITH {HOURLY},
pts AS (SELECT * FROM (SELECT row_id, {vs}, {shift(b, Tp)} AS y, {a} AS own FROM s) WHERE {whole} AND y IS NOT NULL AND own IS NOT NULL),
tasks AS ({tasks}),
drawn AS (SELECT * FROM (SELECT pts.*, tasks.lib_size, tasks.trial, row_number() OVER (PARTITION BY tasks.lib_size, tasks.trial ORDER BY {order}, row_id) AS place, {size} AS most FROM pts, tasks) WHERE place <= most),
prs AS (SELECT l.lib_size, l.trial, p.row_id AS p, p.y AS o, l.row_id AS l, l.y AS y, {dist} AS d FROM pts p, drawn l WHERE abs(p.row_id - l.row_id) > {radius}),
nbr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lib_size, trial, p ORDER BY d, abs(p - l), l) AS rank FROM prs) WHERE rank <= {E + 1}),
wgt AS (SELECT *, min(d) OVER (PARTITION BY lib_size, trial, p) AS d1 FROM nbr),
est AS (SELECT lib_size, trial, p, any_value(o) AS o, sum(w * y) / sum(w) AS q FROM (SELECT *, CASE WHEN d1 > 0 THEN exp(-d / CASE WHEN d1 > 0 THEN d1 ELSE 1 END) WHEN d = 0 THEN 1.0 ELSE 0.0 END AS w FROM wgt) GROUP BY lib_size, trial, p HAVING count(*) = {E + 1})
SELECT '{name}' AS direction, lib_size, trial, CASE WHEN count(*) >= 3 THEN coalesce({RHO}, 0) END AS rho FROM est GROUP BY lib_size, trial)"""


def ccm_sql(E: int, Tp: int = 0, radius: int = 0, sizes: tuple[int, ...] | None = None, variance: bool = False) -> str:
    names = ["x:y", "y:x"]
    columns = [f"round(avg(rho) FILTER (direction = '{n}'), 6) AS \"{n}\"" for n in names]
    if variance:
        columns += [f"round(var_pop(rho) FILTER (direction = '{n}'), 6) AS \"{n}_var\"" for n in names]
    return f"SELECT lib_size::BIGINT AS \"LibSize\", {', '.join(columns)} FROM (SELECT * FROM {cross_direction('x:y', 'x', 'y', E, Tp, radius, sizes)} UNION ALL SELECT * FROM {cross_direction('y:x', 'y', 'x', E, Tp, radius, sizes)}) GROUP BY lib_size"


def multiview_sql(which: str) -> str:
    shifts = [("x", 0), ("x", -1), ("y", 0), ("y", -1)]
    names = ["x(t-0)", "x(t-1)", "y(t-0)", "y(t-1)"]
    views = list(combinations(range(4), 2))
    keep = int(len(views) ** 0.5)
    vs = ", ".join(f"{shift(c, s)} AS v{j}" for j, (c, s) in enumerate(shifts))

    def forecasts(rows: str, end: str = "") -> str:
        """Forecasts f and errors err of all views for ``rows``, their names with ``end``."""
        pairs = "\nUNION ALL ".join(
            f"SELECT {i} AS view_id, a.row_id AS p, b.row_id AS l, b.future AS y, sqrt({' + '.join(f'(a.v{j} - b.v{j}) * (a.v{j} - b.v{j})' for j in v)}) AS d FROM {rows} a, lib b WHERE a.row_id != b.row_id"
            for i, v in enumerate(views)
        )
        return f"""prs{end} AS ({pairs}),
nbr{end} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view_id, p ORDER BY d, abs(p - l), l) AS rank FROM prs{end} WHERE d IS NOT NULL) WHERE rank <= 3),
wgt{end} AS (SELECT view_id, p, y, exp(-d / greatest(min(d) OVER (PARTITION BY view_id, p), 1e-6)) AS w FROM nbr{end}),
f{end} AS (SELECT view_id, p, CASE WHEN count(y) = count(*) THEN sum(w * y) / sum(w) END AS pred FROM wgt{end} GROUP BY view_id, p),
both{end}_ AS (SELECT f{end}.view_id, s.x AS o, f{end}.pred AS q FROM f{end} JOIN s ON s.row_id = f{end}.p + 1),
err{end} AS (SELECT view_id, {ERRORS} FROM both{end}_ WHERE o IS NOT NULL AND q IS NOT NULL GROUP BY view_id),
"""

    train = which == "train"
    shown = ", ".join("({}, '({})')".format(i, ", ".join("''" + names[j] + "''" for j in v)) for i, v in enumerate(views))
    ctes = f"""{HOURLY},
e AS (SELECT row_id, {vs}, {shift('x', 1)} AS future FROM s),
lib AS (SELECT * FROM e, m WHERE row_id BETWEEN 1 AND n // 2 - 1),
prd AS (SELECT * FROM e, m WHERE row_id BETWEEN n // 2 + 1 AND n - 1),
{forecasts('prd')}{forecasts('lib', '_t') if train else ''}"""
    ctes += f"""best AS (SELECT view_id FROM err{'_t' if train else ''} ORDER BY rho DESC NULLS LAST, view_id LIMIT {keep}),
names(view_id, shown) AS (VALUES {shown})"""
    if which in ("rank", "train"):
        return f'WITH {ctes}\nSELECT shown AS "Columns", rho, "MAE", "CAE", "RMSE" FROM best JOIN err USING (view_id) JOIN names USING (view_id)'
    return f"""WITH {ctes},
avgs AS (SELECT p, CASE WHEN count(pred) = {keep} THEN avg(pred) END AS pred FROM f JOIN best USING (view_id) GROUP BY p),
g AS (SELECT unnest(generate_series(n // 2 + 1, n)) AS row_id FROM m)
SELECT s.t AS t, round(s.x, 6) AS "Observations", round(avgs.pred, 6) AS "Predictions" FROM g LEFT JOIN s USING (row_id) LEFT JOIN avgs ON avgs.p + 1 = g.row_id"""


def panel_sql() -> str:
    over = "PARTITION BY event_type ORDER BY row_id"
    return f"""WITH h AS (SELECT event_type, strftime(ts, '%Y%m%d%H')::BIGINT AS t, count(*)::DOUBLE AS x, round(avg(value), 4) AS y FROM events GROUP BY 1, 2),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t) AS row_id, count(*) OVER (PARTITION BY event_type) AS n FROM h),
e AS (SELECT * FROM (SELECT event_type, row_id, n, x AS v0, {shift('x', -1, over)} AS v1, {shift('y', 1, over)} AS future FROM s) WHERE v1 IS NOT NULL),
lib AS (SELECT * FROM e WHERE row_id BETWEEN 2 AND n // 2 - 1),
prd AS (SELECT * FROM e WHERE row_id BETWEEN n // 2 + 1 AND n),
prs AS (SELECT a.event_type, a.row_id AS p, b.row_id AS l, b.future AS y, sqrt((a.v0 - b.v0) * (a.v0 - b.v0) + (a.v1 - b.v1) * (a.v1 - b.v1)) AS d FROM prd a JOIN lib b USING (event_type) WHERE a.row_id != b.row_id),
nbr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, p ORDER BY d, abs(p - l), l) AS rank FROM prs) WHERE rank <= 3),
wgt AS (SELECT event_type, p, y, exp(-d / greatest(min(d) OVER (PARTITION BY event_type, p), 1e-6)) AS w FROM nbr),
mid AS (SELECT event_type, p, CASE WHEN count(y) = count(*) THEN sum(w * y) / sum(w) END AS pred FROM wgt GROUP BY 1, 2),
f AS (SELECT event_type, p, any_value(pred) AS pred, CASE WHEN any_value(pred) IS NOT NULL THEN sum(w * (y - pred) * (y - pred)) / sum(w) END AS var FROM wgt JOIN mid USING (event_type, p) GROUP BY 1, 2)
SELECT prd.event_type, prd.row_id + 1 AS row_id, round(prd.future, 6) AS "Observations", round(f.pred, 6) AS "Predictions", round(f.var, 6) AS "Pred_Variance"
FROM prd LEFT JOIN f ON f.event_type = prd.event_type AND f.p = prd.row_id"""


def embedding(columns: list[str], E: int, tau: int) -> str:
    return f"WITH {HOURLY}\nSELECT {picked(named(columns, E, tau), 'row_id')} FROM s"


def oracle_sql() -> dict[str, str]:
    vectors = (
        "h AS (SELECT vec_id AS t, "
        + ", ".join(f"embedding[{j + 1}]::DOUBLE AS e{j}" for j in range(EMBEDDED_DIMS))
        + ", label::DOUBLE AS x, label::DOUBLE AS y FROM embeddings),\ns AS (SELECT row_number() OVER (ORDER BY t) AS row_id, * FROM h),\nm AS (SELECT count(*) AS n FROM s)"
    )
    plus = {"x": "x", "x(t-1)": shift("x", -1), "y": "y", "y(t-1)": shift("y", -1), "x(t+1)": shift("x", 1), "y(t+1)": shift("y", 1)}
    return {
        "embed_uni": embedding(["x"], 3, -1),
        "embed_multi": embedding(["x", "y"], 2, -1),
        "embed_lead": embedding(["x"], 3, 1),
        "embed_tau2": embedding(["y"], 3, -2),
        "embed_time": f"""WITH h AS (SELECT strftime(o_orderdate, '%Y%m')::BIGINT AS t, round(avg(o_totalprice), 2) AS y FROM orders GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY t) AS row_id, t, y FROM h)
SELECT {picked(named(['y'], 2, -1), 't')} FROM s""",
        "embed_plusminus": f"WITH {HOURLY}\nSELECT {picked(plus, 't')} FROM s",
        "lib_pred_index": f"""WITH {HOURLY}
SELECT 'lib' AS part, row_id FROM s, m WHERE row_id BETWEEN 5 AND 100 OR row_id BETWEEN 154 AND n // 2 - 2
UNION ALL SELECT 'pred', row_id FROM s, m WHERE row_id BETWEEN n // 2 + 1 AND n""",
        "nn_disjoint": Forecast(k=4).near(),
        "nn_loo": Forecast(k=4, lib="all").near(),
        "nn_exclusion": Forecast(k=4, lib="all", radius=5).near(),
        "nn_validlib": Forecast("x", "y", k=4, valid="y_ > 50").near(),
        "nn_disjoint_lib": Forecast(k=4, lib="two").near(),
        "nn_embedded_vectors": Forecast(" ".join(f"e{j}" for j in range(EMBEDDED_DIMS)), "x", embedded=True, Tp=0, k=5, base=vectors).near(),
        "nn_large": Forecast(k=4, base=PRICES, long=True).near(),
        "simplex_large": Forecast("x", "y", E=2, radius=10, base=PRICES, long=True).layout(),
        "simplex_uni": Forecast().layout(),
        "simplex_multi": Forecast("x y", "y", E=2).layout(),
        "simplex_embedded": Forecast("x y", "y", embedded=True).layout(),
        "simplex_neg_tp": Forecast("x", "y", Tp=-2).layout(),
        "simplex_tp0": Forecast("x", "y", Tp=0).layout(),
        "simplex_cross_target": Forecast("y", "x", E=2).layout(),
        "simplex_exclusion": Forecast("y", "y", E=2, lib="all", radius=7).layout(),
        "simplex_validlib": Forecast("y", "y", E=2, valid="x_ % 2 = 0").layout(),
        "simplex_nan": Forecast("x", "y", E=2, base=HOLED).layout(),
        "simplex_variance": Forecast("y", "y", E=4).layout(),
        "simplex_notime": Forecast("x", "y", E=2).layout('row_id AS "Time"'),
        "compute_error": Forecast().errors(),
        "embed_dimension": sweep("E", [(E, Forecast("x", "y", E=E)) for E in range(1, 6)]),
        "predict_interval": sweep("Tp", [(Tp, Forecast("x", "y", E=2, Tp=Tp)) for Tp in range(1, 6)]),
        "predict_exclusion_radius": sweep("ExclusionRadius", [(r, Forecast("x", "y", E=2, radius=r)) for r in RADII]),
        "predict_nonlinear_e1": nonlinear_sql(),
        "embed_dimension_default": sweep("E", [(E, Forecast("x", "y", E=E)) for E in range(1, 11)]),
        "predict_interval_default": sweep("Tp", [(Tp, Forecast("x", "y", E=1, Tp=Tp)) for Tp in range(1, 11)]),
        "predict_exclusion_radius_default": sweep("ExclusionRadius", [(r, Forecast("x", "y", E=1, radius=r)) for r in ALL_RADII]),
        "predict_nonlinear_default": nonlinear_sql(ALL_THETAS),
        "smap_e3": smap_sql(3, 2.0),
        "smap_singular_values": singular_sql(3, 2.0),
        "smap_e1": smap_sql(1, 2.0),
        "smap_e2": smap_sql(2, 2.0),
        "smap_theta0": smap_sql(2, 0.0, "x"),
        "ccm_full_library": ccm_sql(2),
        "ccm_full_exclusion": ccm_sql(2, 1, 3),
        "ccm_sampled_md5": ccm_sql(2, sizes=CCM_SIZES, variance=True),
        "multiview_rank": multiview_sql("rank"),
        "multiview_predict": multiview_sql("predict"),
        "multiview_train": multiview_sql("train"),
        "surrogate_shuffle": f"""WITH {HOURLY},
k AS (SELECT surr_id, row_id, y FROM s, (SELECT unnest(range(1, 6))::INTEGER AS surr_id))
SELECT surr_id, row_number() OVER (PARTITION BY surr_id ORDER BY md5(concat_ws('|', '{SEED}', surr_id::VARCHAR, row_id::VARCHAR)), row_id) AS row_id, round(y, 6) AS value FROM k""",
        "panel_simplex": panel_sql(),
    }
