"""A whole forest in SQL for DuckDB: bins, bags, growth, prunings and predictions, a set of subqueries for each depth.

Written apart from the engine, from the definitions: it is what the forests of the engine are checked against.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from ..functions.hashing import SQL_HASH48


@dataclass(frozen=True)
class Case:
    """source: SQL of a table with row_id (dense, from 0), y (class number or value) and features f0, f1, ...

    categorical: of each feature; k: features that a node looks at; classes: 0 for regression. settings: step and dirichlet.
    """

    source: str
    categorical: Sequence[bool]
    k: int
    trees: int
    depth: int
    classes: int
    max_bins: int = 64
    seed: int = 0
    settings: Sequence[tuple[float, float]] = ((1.0, 0.5),)


def _hash(*parts: str) -> str:
    return SQL_HASH48.format(f"concat_ws('|', {', '.join(parts)})")


def _bins(case: Case) -> list[str]:
    """The bin of each feature: codes of categories, or how many thresholds lie under the value."""
    out, cells = [], []
    for i, cat in enumerate(case.categorical):
        f = f"f{i}"
        out.append(f"v{i} AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS d FROM (SELECT DISTINCT {f} AS v FROM src WHERE {f} IS NOT NULL))")
        if cat:
            out.append(f"c{i} AS MATERIALIZED (SELECT v, r AS b FROM v{i})")
            top = f"(SELECT count(*) FROM v{i})"
        else:
            n = case.max_bins
            out += [
                f"s{i} AS MATERIALIZED (SELECT {f} AS v, row_number() OVER (ORDER BY {f}) - 1 AS r, count(*) OVER () AS n FROM src WHERE {f} IS NOT NULL)",
                f"h{i} AS (SELECT DISTINCT j, (j * (100 / {n}.0::DOUBLE)) / 100 * (n - 1) AS h FROM (SELECT unnest(generate_series(1, {n - 1})) AS j), s{i})",
                f"q{i} AS MATERIALIZED (SELECT b.v - (b.v - a.v) * 0.5 AS t FROM h{i} JOIN s{i} a ON a.r = CAST(floor(h) AS BIGINT) JOIN s{i} b ON b.r = CAST(ceil(h) AS BIGINT))",
                # With few values, thresholds lie between neighbours, so the bin is the value's rank.
                f"c{i} AS MATERIALIZED (SELECT v, CASE WHEN d <= {n} THEN r ELSE (SELECT count(*) FROM q{i} WHERE t < v) END AS b FROM v{i})",
            ]
            top = f"(SELECT CASE WHEN max(d) <= {n} THEN max(d) ELSE {n} END FROM v{i})"
        cells.append(f"coalesce(c{i}.b, {top})")
    joins = " ".join(f"LEFT JOIN c{i} ON c{i}.v = src.f{i}" for i in range(len(cells)))
    return [*out, f"binned AS MATERIALIZED (SELECT row_id, y, [{', '.join(cells)}] AS bins FROM src {joins})"]


def _moments(case: Case) -> list[str]:
    return [f"CASE WHEN y = {j} THEN w ELSE 0 END" for j in range(case.classes)] if case.classes else ["w", "w * y", "w * y * y"]


def _impurity(case: Case, m: Sequence[str]) -> tuple[str, str]:
    """The weight, and the impurity, of moments."""
    if not case.classes:
        return m[0], f"({m[2]} / {m[0]} - ({m[1]} / {m[0]}) * ({m[1]} / {m[0]}))"
    w = f"({' + '.join(m)})"
    return w, f"(1 - ({' + '.join(f'{x} * {x}' for x in m)}) / ({w} * {w}))"


def forest(case: Case) -> str:
    """WITH ... and the tables nodes (tree, path, depth, node_id, ..., with a row for each setting in leaves) and at_leaf."""
    m = 3 if not case.classes else case.classes
    ms = [f"m{j}" for j in range(m)]
    mom = _moments(case)
    flags = f"[{', '.join(str(bool(c)).lower() for c in case.categorical)}]"
    parts = [f"src AS MATERIALIZED ({case.source})", *_bins(case)]
    n = "(SELECT count(*) FROM src)"
    parts.append(f"drawn AS MATERIALIZED (SELECT tree, {_hash(str(case.seed), 'tree', 'draw')} % {n} AS row_id, count(*) AS n_drawn FROM (SELECT row_id AS draw FROM src) d, (SELECT unnest(generate_series(0, {case.trees - 1})) AS tree) t GROUP BY 1, 2)")
    parts.append(f"a0 AS MATERIALIZED (SELECT t.tree, '' AS path, b.row_id, n_drawn IS NOT NULL AS t, coalesce(n_drawn, 1)::DOUBLE AS w, y, bins FROM binned b CROSS JOIN (SELECT unnest(generate_series(0, {case.trees - 1})) AS tree) t LEFT JOIN drawn d ON d.tree = t.tree AND d.row_id = b.row_id)")
    for d in range(case.depth + 1):
        sums = ", ".join([f"sum(CASE WHEN t THEN {x} ELSE 0 END) AS m{j}" for j, x in enumerate(mom)] + [f"sum(CASE WHEN t THEN 0 ELSE {x} END) AS v{j}" for j, x in enumerate(mom)])
        parts.append(f"t{d} AS MATERIALIZED (SELECT tree, path, count(*) FILTER (t) AS n_train, count(*) FILTER (NOT t) AS n_valid, {sums} FROM a{d} GROUP BY 1, 2)")
        if d == case.depth:
            break
        pure = "true" if d == 0 else f"impurity > {'1e-12 * (m1 / m0) * (m1 / m0)' if not case.classes else '0'} AND impurity > 0"
        up = "" if d == 0 else f" JOIN (SELECT tree, path || '1' AS path, impurity_left AS impurity FROM b{d - 1} UNION ALL SELECT tree, path || '0', impurity_right FROM b{d - 1}) u USING (tree, path)"
        parts.append(f"o{d} AS MATERIALIZED (SELECT tree, path FROM t{d}{up} WHERE n_train >= 2 AND n_valid >= 2 AND {pure})")
        ranks = f"SELECT tree, path, f, row_number() OVER (PARTITION BY tree, path ORDER BY {_hash(str(case.seed), 'tree', 'path', 'f')}, f) - 1 AS rk FROM o{d}, (SELECT unnest(generate_series(0, {len(case.categorical) - 1})) AS f)"
        parts.append(f"g{d} AS MATERIALIZED (SELECT * FROM ({ranks}) WHERE rk < {case.k})")
        sums = ", ".join(f"sum(CASE WHEN t THEN {x} ELSE 0 END) AS m{j}" for j, x in enumerate(mom))
        parts.append(f"p{d} AS MATERIALIZED (SELECT tree, path, f, rk, bins[f + 1] AS bin, count(*) FILTER (t) AS nt, count(*) FILTER (NOT t) AS nv, {sums} FROM a{d} JOIN g{d} USING (tree, path) GROUP BY 1, 2, 3, 4, 5)")
        share = f"m{min(1, m - 1)} / {_impurity(case, ms)[0]}" if case.classes else "m1"
        parts.append(f"k{d} AS MATERIALIZED (SELECT *, {flags}[f + 1] AS cat, CASE WHEN NOT {flags}[f + 1] THEN bin::DOUBLE WHEN nt > 0 THEN {share} ELSE CAST('inf' AS DOUBLE) END AS key FROM p{d})")
        over = ", ".join([f"sum({x}) OVER upto AS l{x}, sum({x}) OVER (PARTITION BY tree, path, f) AS a{x}" for x in (*ms, "nt", "nv")])
        left, right = [f"l{x}" for x in ms], [f"(a{x} - l{x})" for x in ms]
        (wl, il), (wr, ir) = _impurity(case, left), _impurity(case, right)
        parts.append(f"w{d} AS (SELECT *, {over} FROM k{d} WINDOW upto AS (PARTITION BY tree, path, f ORDER BY key, bin ROWS UNBOUNDED PRECEDING))")
        parts.append(f"i{d} AS (SELECT *, {il} AS impurity_left, {ir} AS impurity_right, {wl} AS wl, {wr} AS wr FROM w{d} WHERE nt > 0 AND lnt >= 1 AND ant - lnt >= 1 AND lnv >= 1 AND anv - lnv >= 1 AND {wl} > 0 AND {wr} > 0)")
        parts.append(f"b{d} AS MATERIALIZED (SELECT tree, path, f, cat, key, bin, gain, impurity_left, impurity_right FROM (SELECT *, row_number() OVER (PARTITION BY tree, path ORDER BY gain DESC, rk, key, bin) AS nr FROM (SELECT *, -wl * impurity_left - wr * impurity_right AS gain FROM i{d})) WHERE nr = 1)")
        parts.append(f"e{d} AS MATERIALIZED (SELECT b.tree, b.path, list(k.bin ORDER BY k.bin) AS bins_left FROM b{d} b JOIN k{d} k ON k.tree = b.tree AND k.path = b.path AND k.f = b.f WHERE b.cat AND k.nt > 0 AND (k.key < b.key OR (k.key = b.key AND k.bin <= b.bin)) GROUP BY 1, 2)")
        goes = "CASE WHEN cat THEN list_contains(bins_left, bins[f + 1]) ELSE bins[f + 1] <= bin END"
        parts.append(f"a{d + 1} AS MATERIALIZED (SELECT a.tree, a.path || CASE WHEN {goes} THEN '1' ELSE '0' END AS path, row_id, t, w, y, bins FROM a{d} a JOIN b{d} b USING (tree, path) LEFT JOIN e{d} USING (tree, path))")
    levels = []
    for d in range(case.depth + 1):
        split = f"LEFT JOIN b{d} b USING (tree, path) LEFT JOIN e{d} USING (tree, path)" if d < case.depth else ""
        cols = "b.f, b.cat, b.bin, b.gain, bins_left" if d < case.depth else "NULL AS f, NULL AS cat, NULL AS bin, NULL AS gain, NULL AS bins_left"
        levels.append(f"SELECT tree, path, {d} AS depth, n_train, n_valid, {', '.join(ms)}, {', '.join(f'v{j}' for j in range(m))}, {cols} FROM t{d} {split}")
    parts.append(f"n0 AS MATERIALIZED ({' UNION ALL '.join(levels)})")
    settings = ", ".join(f"({s}::DOUBLE, {a}::DOUBLE)" for s, a in case.settings)
    if case.classes:
        total = f"({' + '.join(ms)} + dirichlet * {m})"
        guess = [f"(m{j} + dirichlet) / {total}" for j in range(m)]
        loss = " + ".join(f"CASE WHEN v{j} > 0 THEN -v{j} * ln(y{j}) ELSE 0 END" for j in range(m))
    else:
        guess = ["CASE WHEN m0 > 0 THEN m1 / m0 ELSE 0 END"]
        loss = "v2 - 2 * y0 * v1 + y0 * y0 * v0"
    parts.append(f"n1 AS (SELECT *, f IS NULL AS leaf, row_number() OVER (PARTITION BY tree, step, dirichlet ORDER BY path) - 1 AS node_id, {', '.join(f'{g} AS y{j}' for j, g in enumerate(guess))} FROM n0, (VALUES {settings}) s(step, dirichlet))")
    parts.append(f"n2 AS MATERIALIZED (SELECT *, {loss} AS loss FROM n1)")
    same = "tree, step, dirichlet"
    for d in range(case.depth, -1, -1):
        if d == case.depth:
            parts.append(f"l{d} AS MATERIALIZED (SELECT {same}, path, -step * loss AS lw FROM n2 WHERE depth = {d})")
        else:
            mean = "greatest(-step * loss, kids) + ln((1 + exp(-abs(-step * loss - kids))) / 2)"
            parts.append(f"l{d} AS MATERIALIZED (SELECT {same}, path, CASE WHEN leaf THEN -step * loss ELSE {mean} END AS lw FROM n2 LEFT JOIN (SELECT {same}, substr(path, 1, {d}) AS path, sum(lw) AS kids FROM l{d + 1} GROUP BY ALL) USING ({same}, path) WHERE depth = {d})")
    union = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(case.depth + 1))
    parts.append(f"nodes AS MATERIALIZED (SELECT *, CASE WHEN leaf THEN 1 ELSE 0.5 * exp(-step * loss - lw) END AS share FROM n2 JOIN ({union}) USING ({same}, path))")
    ys = range(len(guess))
    for d in range(case.depth + 1):
        if d == 0:
            parts.append(f"r0 AS (SELECT {same}, path, leaf, node_id, 1 - share AS rest, share * 0 AS wd, {', '.join(f'share * y{j} AS p{j}' for j in ys)} FROM nodes WHERE depth = 0)")
        else:
            parts.append(f"r{d} AS (SELECT {', '.join(f'n.{c}' for c in ('tree', 'step', 'dirichlet', 'path', 'leaf', 'node_id'))}, r.rest * (1 - share) AS rest, r.wd + r.rest * share * {d} AS wd, {', '.join(f'r.p{j} + r.rest * share * y{j} AS p{j}' for j in ys)} FROM nodes n JOIN r{d - 1} r ON n.tree = r.tree AND n.step = r.step AND n.dirichlet = r.dirichlet AND substr(n.path, 1, {d - 1}) = r.path WHERE depth = {d})")
    union = " UNION ALL ".join(f"SELECT * FROM r{d} WHERE leaf" for d in range(case.depth + 1))
    parts.append(f"leaves AS MATERIALIZED ({union})")
    union = " UNION ALL ".join(f"SELECT tree, path, row_id FROM a{d}" for d in range(case.depth + 1))
    parts.append(f"at_leaf AS (SELECT u.row_id, u.tree, l.step, l.dirichlet, l.node_id, l.wd, {', '.join(f'l.p{j}' for j in ys)} FROM ({union}) u JOIN leaves l USING (tree, path))")
    return "WITH " + ",\n".join(parts)


def mean_prediction(case: Case) -> str:
    """SQL for (row_id, step, dirichlet, p0, ..., wd): means over trees."""
    ys = range(case.classes or 1)
    return f"SELECT row_id, step, dirichlet, {', '.join(f'avg(p{j}) AS p{j}' for j in ys)}, avg(wd) AS wd FROM at_leaf GROUP BY 1, 2, 3"
