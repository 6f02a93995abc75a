"""DuckDB text of the boosting steps, unrolled per round and level (oracles only).

Mirrors :mod:`sigspark.operators.boost` step by step in long form
(row, feature, bin) on ``v_wide``; used to check the Spark jobs.
"""

from __future__ import annotations

import itertools
import re

N_FEATURES = 8


def grid_values(grid: dict, names: list[str] | None = None, id_name: str = "fit_no") -> str:
    """VALUES rows (id, *names) of the Cartesian grid, first factor fastest, doubles cast."""
    names = names or [k for k in grid if k != "nrounds"]
    rows = []
    for combo in itertools.product(*[list(enumerate(grid[n])) for n in reversed(names)]):
        combo = list(reversed(combo))
        gid, mult = 0, 1
        for (i, _), n in zip(combo, names):
            gid += i * mult
            mult *= len(grid[n])
        rows.append((gid + 1, [v for _, v in combo]))
    rows.sort()

    def lit(v):
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(int(v))

    txt = ", ".join("(" + ", ".join([str(g)] + [lit(v) for v in vals]) + ")" for g, vals in rows)
    return f"(VALUES {txt}) g({id_name}, {', '.join(names)})"


def fits_values(grid: dict) -> str:
    return grid_values(grid)


def u_of(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def base(grid: dict, max_bins: int | None = None, src: str = "v_wide") -> list[str]:
    bin_of = "rk - 1" if max_bins is None else f"floor((rk - 1) * {max_bins} / m)"
    return [
        f"""lf AS (SELECT study, row_id, CAST(unnest(range(len(features))) AS INTEGER) AS feature, unnest(features) AS value
  FROM {src})""",
        f"""bd AS (SELECT study, feature, value, row_number() OVER (PARTITION BY study, feature ORDER BY value) AS rk,
    count(*) OVER (PARTITION BY study, feature) AS m FROM (SELECT DISTINCT study, feature, value FROM lf WHERE value IS NOT NULL))""",
        f"""bper AS (SELECT study, feature,
    CAST({bin_of} AS INTEGER) AS bin,
    min(value) AS lo, max(value) AS hi FROM bd GROUP BY ALL)""",
        """bins AS (SELECT *, (hi + lead(lo) OVER (PARTITION BY study, feature ORDER BY bin)) / 2 AS cut FROM bper)""",
        """br AS (SELECT l.study, l.row_id, l.feature, b.bin FROM lf l JOIN bins b
  ON l.study = b.study AND l.feature = b.feature AND l.value >= b.lo AND l.value <= b.hi)""",
        f"""fits AS (SELECT s.study, CAST(s.study AS VARCHAR) || ':' || CAST(g.fit_no AS VARCHAR) AS fit_id, g.*
  FROM (SELECT DISTINCT study FROM {src}) s CROSS JOIN {fits_values(grid)})""",
        f"""st_r0 AS (SELECT f.fit_id, f.study, w.row_id, CAST(w.y AS DOUBLE) AS y, 0.0::DOUBLE AS margin
  FROM {src} w JOIN fits f USING (study))""",
    ]


def round_ctes(r: int, max_depth: int, lam: float = 1.0, mcw: float = 1.0) -> list[str]:
    """CTEs for boosting round ``r`` (1-based) from ``st_r{r-1}``; defines ``nodes_r{r}`` and ``st_r{r}``."""
    p = f"(1.0 / (1.0 + exp(-margin)))"
    out = [
        f"""al_r{r} AS (SELECT fit_id, feature, rk <= greatest(1, floor(colsample_bytree * {N_FEATURES})) AS keep
  FROM (SELECT f.fit_id, f.colsample_bytree, CAST(t.feature AS INTEGER) AS feature,
               row_number() OVER (PARTITION BY f.fit_id ORDER BY {u_of('f.fit_id', str(r), 't.feature')}, t.feature) AS rk
        FROM fits f CROSS JOIN range(0, {N_FEATURES}) t(feature)))""",
        f"""s_r{r}_l0 AS (SELECT s.fit_id, s.study, s.row_id, s.y, s.margin, {p} - s.y AS g, {p} * (1.0 - {p}) AS h,
    {u_of('s.fit_id', str(r), 's.row_id')} < f.subsample AS keep, CAST(0 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS leaf
  FROM st_r{r - 1} s JOIN fits f USING (fit_id, study))""",
    ]
    node_parts = []
    for d in range(max_depth):
        s = f"s_r{r}_l{d}"
        out += [
            f"""tot_r{r}_l{d} AS (SELECT fit_id, node, sum(g) AS gt, sum(h) AS ht FROM {s} WHERE keep AND node IS NOT NULL GROUP BY ALL)""",
            f"""hist_r{r}_l{d} AS (SELECT s.fit_id, s.node, b.feature, b.bin, sum(s.g) AS sg, sum(s.h) AS sh, count(*) AS n
  FROM {s} s JOIN br b USING (study, row_id) JOIN al_r{r} a ON a.fit_id = s.fit_id AND a.feature = b.feature
  WHERE s.keep AND s.node IS NOT NULL AND a.keep GROUP BY ALL)""",
            f"""cum_r{r}_l{d} AS (SELECT h.fit_id, h.node, h.feature, h.bin, sum(sg) OVER w AS gk, sum(sh) OVER w AS hk, sum(n) OVER w AS nk,
    sum(sg) OVER p AS gs, sum(sh) OVER p AS hs, sum(n) OVER p AS ns
  FROM hist_r{r}_l{d} h WINDOW w AS (PARTITION BY h.fit_id, h.node, h.feature ORDER BY h.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY h.fit_id, h.node, h.feature))""",
            f"""side_r{r}_l{d} AS (SELECT c.fit_id, c.node, c.feature, c.bin, t.gt, t.ht, m.default_left,
    CASE WHEN m.default_left THEN gk + gt - gs ELSE gk END AS gl, CASE WHEN m.default_left THEN hk + ht - hs ELSE hk END AS hl
  FROM cum_r{r}_l{d} c JOIN tot_r{r}_l{d} t USING (fit_id, node) CROSS JOIN (VALUES (true), (false)) m(default_left) WHERE nk < ns)""",
            f"""best_r{r}_l{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fit_id, node ORDER BY gain DESC, feature, bin, default_left DESC) AS _r
  FROM (SELECT *, round(gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / ((ht - hl) + {lam}) - gt * gt / (ht + {lam}), 9) AS gain
     FROM side_r{r}_l{d} WHERE hl >= {mcw} - 1e-9 AND (ht - hl) >= {mcw} - 1e-9)) WHERE _r = 1)""",
            f"""dec_r{r}_l{d} AS (SELECT t.fit_id, t.node, t.gt, t.ht, b.feature, b.bin, b.default_left, b.gain, f.eta,
    (b.gain IS NOT NULL AND b.gain > f.gamma AND b.gain > 1e-6 AND {d} < f.max_depth) AS split
  FROM tot_r{r}_l{d} t LEFT JOIN best_r{r}_l{d} b USING (fit_id, node) JOIN fits f ON f.fit_id = t.fit_id)""",
            f"""nodes_r{r}_l{d} AS (SELECT fit_id, {r - 1} AS tree, node, {d} AS depth,
    CASE WHEN split THEN feature END AS feature, CASE WHEN split THEN bin END AS bin, CASE WHEN split THEN default_left END AS default_left,
    CASE WHEN split THEN node * 2 + 1 END AS "left", CASE WHEN split THEN node * 2 + 2 END AS "right",
    CASE WHEN NOT split THEN -eta * gt / (ht + {lam}) END AS leaf_value,
    CASE WHEN split THEN gain END AS gain, ht AS cover FROM dec_r{r}_l{d})""",
            f"""s_r{r}_l{d + 1} AS (SELECT s.fit_id, s.study, s.row_id, s.y, s.margin, s.g, s.h, s.keep,
    CASE WHEN s.node IS NOT NULL AND dd.split THEN CASE WHEN CASE WHEN rb.bin IS NULL THEN dd.default_left ELSE rb.bin <= dd.bin END THEN s.node * 2 + 1 ELSE s.node * 2 + 2 END END AS node,
    coalesce(CASE WHEN dd.split = false THEN -dd.eta * dd.gt / (dd.ht + {lam}) END, s.leaf) AS leaf
  FROM {s} s LEFT JOIN dec_r{r}_l{d} dd ON dd.fit_id = s.fit_id AND dd.node = s.node
  LEFT JOIN br rb ON rb.study = s.study AND rb.row_id = s.row_id AND rb.feature = dd.feature)""",
        ]
        node_parts.append(f"SELECT * FROM nodes_r{r}_l{d}")
    s = f"s_r{r}_l{max_depth}"
    out += [
        f"""ctot_r{r} AS (SELECT t.*, f.eta FROM (SELECT fit_id, node, sum(g) AS gt, sum(h) AS ht FROM {s}
    WHERE keep AND node IS NOT NULL GROUP BY ALL) t JOIN fits f USING (fit_id))""",
        f"""cnodes_r{r} AS (SELECT fit_id, {r - 1} AS tree, node, {max_depth} AS depth, CAST(NULL AS INTEGER) AS feature,
    CAST(NULL AS INTEGER) AS bin, CAST(NULL AS BOOLEAN) AS default_left, CAST(NULL AS BIGINT) AS "left", CAST(NULL AS BIGINT) AS "right",
    -eta * gt / (ht + {lam}) AS leaf_value, CAST(NULL AS DOUBLE) AS gain, ht AS cover FROM ctot_r{r})""",
        f"""st_r{r} AS (SELECT s.fit_id, s.study, s.row_id, s.y,
    s.margin + coalesce(coalesce(-c.eta * c.gt / (c.ht + {lam}), s.leaf), 0.0) AS margin
  FROM {s} s LEFT JOIN ctot_r{r} c ON c.fit_id = s.fit_id AND c.node = s.node)""",
        f"""nodes_r{r} AS ({' UNION ALL '.join(node_parts)} UNION ALL SELECT * FROM cnodes_r{r})""",
    ]
    return out


def fit_ctes(grid: dict, max_bins: int | None = None, src: str = "v_wide") -> list[str]:
    """All CTEs of a fit; defines ``trees`` and ``preds``."""
    n_rounds = max(grid["nrounds"])
    depth = max(grid["max_depth"])
    ctes = base(grid, max_bins, src)
    for r in range(1, n_rounds + 1):
        ctes += round_ctes(r, depth)
    nodes = " UNION ALL ".join(f"SELECT * FROM nodes_r{r}" for r in range(1, n_rounds + 1))
    ctes.append(
        f"""trees AS (SELECT n.fit_id AS model, CAST(n.tree AS INTEGER) AS tree, n.node, n.depth, n.feature, c.cut AS threshold,
    n.default_left, n."left", n."right", n.leaf_value, n.gain, n.cover
  FROM ({nodes}) n JOIN fits f ON f.fit_id = n.fit_id
  LEFT JOIN bins c ON c.study = f.study AND c.feature = n.feature AND c.bin = n.bin)"""
    )
    preds = " UNION ALL ".join(
        f"SELECT fit_id, study, {r} AS nrounds, row_id, y, margin FROM st_r{r}" for r in sorted(set(grid["nrounds"]))
    )
    ctes.append(f"preds AS ({preds})")
    return ctes


def refit_ctes(grid: dict, best: str, src: str, prefix: str = "z_", max_bins: int | None = None) -> list[str]:
    """CTEs of a fit of ``src`` with the grid rows that ``best(study, grid_id)`` names; all names begin with ``prefix``."""
    chosen = f"""fits AS (SELECT b.study, CAST(b.study AS VARCHAR) || ':final' AS fit_id, 1 AS fit_no, g.*
  FROM {best} b JOIN {grid_values(grid, list(grid), "grid_id")} ON g.grid_id = b.grid_id)"""
    ctes = [chosen if c.startswith("fits AS") else c for c in fit_ctes(grid, max_bins, src)]
    names = [re.match(r"\w+", c)[0] for c in ctes]
    renamed = re.compile(r"\b(" + "|".join(names) + r")\b")
    return [renamed.sub(lambda m: prefix + m[1], c) for c in ctes]


def md5_base_sql(*parts: str, part: int = 0) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), {1 + 8 * part}, 8)) AS BIGINT)"


def uniform_sql(rows: str, a: str, b: str) -> str:
    """``rows`` with u, the DuckDB text of :func:`sigspark.operators.bootstrap.uniforms` for bases b0, b1, replicate a and draw b (same integer operations)."""
    m = "4294967295"

    def mixed(inner: str, col: str) -> str:
        for _ in range(2):
            inner = f"SELECT * REPLACE ((xor({col} >> 16, {col}) * 73244475) & {m} AS {col}) FROM ({inner})"
        return f"SELECT * REPLACE (xor({col} >> 16, {col}) AS {col}) FROM ({inner})"

    x = f"SELECT *, (b0 + CAST({a} AS BIGINT) * 2654435761 + CAST({b} AS BIGINT) * 2246822519) & {m} AS x, (b1 + CAST({a} AS BIGINT) * 3266489917 + CAST({b} AS BIGINT) * 668265263) & {m} AS y FROM ({rows})"
    hl = f"SELECT *, (x + y) & {m} AS h, xor(x, y) AS l FROM ({mixed(x, 'x')})"
    return f"SELECT *, CAST(h * 2097152 + (l >> 11) AS DOUBLE) / 9007199254740992.0 AS u FROM ({mixed(mixed(hl, 'h'), 'l')})"
