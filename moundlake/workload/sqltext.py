"""DuckDB text of the shared steps, assembled by name into one WITH clause.

The steps restate the operators in plain SQL over the given tables (brute force
where that is the simplest definition), independently of the Spark code.
"""

from __future__ import annotations

import re

STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, needs: tuple[str, ...], sql: str) -> None:
    STEPS[name] = (needs, sql.strip())


def restate(suffix: str, roots: dict[str, str], names: list[str]) -> None:
    """Copies of the steps ``names`` under ``<name>_<suffix>``, on other steps in place of ``roots`` and on each other."""
    renamed = roots | {n: f"{n}_{suffix}" for n in names}
    word = re.compile(r"\b(" + "|".join(sorted(map(re.escape, renamed), key=len, reverse=True)) + r")\b")
    for name in names:
        needs, sql = STEPS[name]
        STEPS[renamed[name]] = (tuple(renamed.get(n, n) for n in needs), word.sub(lambda m: renamed[m.group()], sql))


def query(final: str, *needs: str) -> str:
    """One statement: the steps ``needs`` and all they rest on, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in STEPS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return final.strip()
    parts = []
    for name in order:
        hint = "" if name.startswith("rec_") else "MATERIALIZED "
        parts.append(f"{name} AS {hint}({STEPS[name][1]})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()


step("pts", (), """
SELECT survey_id, u, v, lx, ly,
  CAST(floor(100000e0 + h*1000e0 + 0.5e0) AS BIGINT) + CAST(l_quantity AS BIGINT) % 10 AS z_mm,
  CASE WHEN h = 0 THEN 2 ELSE 1 END AS cls, l_shipdate, file_pos
FROM (
  SELECT *, greatest(0e0,
    5e0*(1e0 - sqrt((lx-50e0)*(lx-50e0)+(ly-50e0)*(ly-50e0))/15e0),
    CASE WHEN (lx-150e0)*(lx-150e0)+(ly-50e0)*(ly-50e0) < r2
         THEN sqrt(r2 - ((lx-150e0)*(lx-150e0)+(ly-50e0)*(ly-50e0))) ELSE 0e0 END,
    6e0*(1e0 - greatest(abs(lx-50e0), abs(ly-150e0))/half),
    CASE WHEN survey_id % 2 = 1
         THEN least(4e0, 0.4e0*(18e0 - sqrt((lx-150e0)*(lx-150e0)+(ly-150e0)*(ly-150e0))))
         ELSE 3e0*(1e0 - sqrt((lx-100e0)*(lx-100e0)+(ly-100e0)*(ly-100e0))/10e0) END) AS h
  FROM (
    SELECT *, u*0.05e0 AS lx, v*0.05e0 AS ly,
      CASE WHEN survey_id % 2 = 1 THEN 144e0 ELSE 174.24e0 END AS r2,
      CASE WHEN survey_id % 2 = 1 THEN 10e0 ELSE 9.13e0 END AS half
    FROM (
      SELECT 1 + l_orderkey % 2 + 2*(l_orderkey // 150000) AS survey_id, l_quantity, l_shipdate,
        row_number() OVER () - 1 AS file_pos,
        (l_orderkey*7919 + l_partkey*104729 + l_linenumber*1299709) % 4000 AS u,
        (l_orderkey*15485863 + l_suppkey*32452843 + l_partkey*49979687 + l_linenumber*86028121) % 4000 AS v
      FROM lineitem)))
""")
step("grid", ("pts",), """
SELECT survey_id, units, units*0.05e0 AS res, CAST(4000 // units AS INT) AS w, CAST(4000 // units AS INT) AS h,
  500000e0 AS west, 5000200e0 AS north
FROM (SELECT survey_id, 40 AS units
      FROM pts GROUP BY 1)
""")
step("binned", ("pts", "grid"), """
SELECT p.survey_id, CAST((3999 - v) // units AS INT) AS r, CAST(u // units AS INT) AS c,
  z_mm, z_mm/1000e0 AS z, cls, l_shipdate
FROM pts p JOIN grid USING (survey_id)
""")
step("dsm_raw", ("binned",), """
SELECT survey_id, r, c, round(quantile_cont(z, 0.95), 6) AS v FROM binned GROUP BY ALL
""")
step("cell", ("grid",), """
SELECT survey_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c
FROM grid, LATERAL (SELECT unnest(range(h)) AS r), LATERAL (SELECT unnest(range(w)) AS c)
""")


def fill_sql(source: str) -> str:
    """Nearest populated cell by brute force, ties by (d2, r, c)."""
    return f"""
SELECT e.survey_id, e.r, e.c,
  min(struct_pack(d2 := (e.r-p.r)*(e.r-p.r) + (e.c-p.c)*(e.c-p.c), pr := p.r, pc := p.c, pv := p.v)).pv AS v
FROM (SELECT * FROM cell ANTI JOIN {source} USING (survey_id, r, c)) e
JOIN {source} p ON p.survey_id = e.survey_id GROUP BY 1, 2, 3
UNION ALL SELECT survey_id, r, c, v FROM {source}
"""


step("dsm", ("dsm_raw", "cell"), fill_sql("dsm_raw"))
step("ndsm", ("dsm",), "SELECT survey_id, r, c, greatest(round(v - 100e0, 6), 0e0) AS v FROM dsm")


def frame(value: str, axis: str, before: int, after: int, how: str) -> str:
    across, along = ("r", "c") if axis == "row" else ("c", "r")
    return (
        f"{how}({value}) OVER (PARTITION BY survey_id, {across} ORDER BY {along} "
        f"ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    )


def opening_sql(source: str, k: int) -> str:
    a, b = k // 2, k - 1 - k // 2
    return f"""
SELECT survey_id, r, c, {frame('v', 'row', b, a, 'max')} AS v FROM (
 SELECT survey_id, r, c, {frame('v', 'column', b, a, 'max')} AS v FROM (
  SELECT survey_id, r, c, {frame('v', 'column', a, b, 'min')} AS v FROM (
   SELECT survey_id, r, c, {frame('v', 'row', a, b, 'min')} AS v FROM {source})))
"""


def dilate_sql(source: str, k: int) -> str:
    n = k // 2
    return f"""
SELECT survey_id, r, c, {frame('m', 'column', n, n, 'max')} AS m FROM (
 SELECT survey_id, r, c, {frame('m', 'row', n, n, 'max')} AS m FROM {source})
"""


def erode_sql(source: str, k: int) -> str:
    n = k // 2
    return f"""
SELECT survey_id, r, c, CASE WHEN {frame('m', 'column', n, n, 'count')} = {k}
  THEN {frame('m', 'column', n, n, 'min')} ELSE 0 END AS m FROM (
 SELECT survey_id, r, c, CASE WHEN {frame('m', 'row', n, n, 'count')} = {k}
  THEN {frame('m', 'row', n, n, 'min')} ELSE 0 END AS m FROM {source})
"""


step("raw_mask", ("ndsm",), "SELECT survey_id, r, c, CASE WHEN v > 0.5e0 THEN 1 ELSE 0 END AS m FROM ndsm")
step("er3", ("raw_mask",), erode_sql("raw_mask", 3))
step("opened", ("er3",), dilate_sql("er3", 3))
step("di7", ("opened",), dilate_sql("opened", 7))
step("closed", ("di7",), erode_sql("di7", 7))
step("runs", ("closed",), """
SELECT survey_id, r, min(c) AS c1, max(c) AS c2,
  row_number() OVER (PARTITION BY survey_id ORDER BY r, min(c)) AS run_id
FROM (SELECT survey_id, r, c, c - row_number() OVER (PARTITION BY survey_id, r ORDER BY c) AS g
      FROM closed WHERE m = 1) GROUP BY survey_id, r, g
""")
step("touch", ("runs",), """
SELECT a.survey_id, a.run_id AS x, b.run_id AS y FROM runs a JOIN runs b
  ON a.survey_id = b.survey_id AND abs(a.r - b.r) = 1 AND b.c1 <= a.c2 + 1 AND b.c2 >= a.c1 - 1
""")
step("rec_reach", ("runs", "touch"), """
SELECT survey_id, run_id AS x, run_id AS y FROM runs
UNION SELECT k.survey_id, k.x, t.y FROM rec_reach k JOIN touch t ON t.survey_id = k.survey_id AND t.x = k.y
""")
step("run_label", ("rec_reach",), """
SELECT survey_id, x AS run_id, dense_rank() OVER (PARTITION BY survey_id ORDER BY m) AS heap_id
FROM (SELECT survey_id, x, min(y) AS m FROM rec_reach GROUP BY 1, 2)
""")
step("labels", ("runs", "run_label"), """
SELECT survey_id, r, CAST(c AS INT) AS c, heap_id FROM (
  SELECT survey_id, r, unnest(range(c1, c2 + 1)) AS c, heap_id FROM runs JOIN run_label USING (survey_id, run_id))
""")
step("edge_cells", ("labels",), """
SELECT l.survey_id, l.r, l.c, l.heap_id,
  (SELECT count(*) FROM labels k WHERE k.survey_id = l.survey_id AND k.heap_id = l.heap_id
     AND abs(k.r - l.r) + abs(k.c - l.c) = 1) < 4 AS is_boundary FROM labels l
""")
step("stats", ("edge_cells", "ndsm", "grid"), """
SELECT survey_id, heap_id, cells, boundary_cells, cells*res*res AS area_m2,
  CASE WHEN boundary_cells > 0 THEN least(1e0, 4e0*pi()*cells*res*res / ((boundary_cells*res)*(boundary_cells*res))) ELSE 0e0 END AS compactness,
  height_mean, height_std, height_max
FROM (SELECT survey_id, heap_id, count(*) AS cells, count(*) FILTER (is_boundary) AS boundary_cells,
        ((2*sum(round(v*1e6)::BIGINT) + count(*)) // (2*count(*)))/1e6 AS height_mean, stddev_pop(v) AS height_std, max(v) AS height_max
      FROM edge_cells JOIN ndsm USING (survey_id, r, c) GROUP BY 1, 2) JOIN grid USING (survey_id)
""")
step("classed", ("stats",), """
SELECT *, CASE WHEN area_m2 < 50 THEN 'too_small'
  WHEN compactness > 0.85e0 AND area_m2 < 500 AND height_std < 1 THEN 'machinery'
  WHEN height_std < 0.2e0 AND height_mean > 2 THEN 'structure' END AS filter_code FROM stats
""")


def gradient_sql(source: str) -> str:
    """Central differences inside, one-sided at the edges, by neighbour joins."""
    return f"""
SELECT a.survey_id, a.r, a.c, a.v, g.res, g.west, g.north,
  CASE WHEN e.v IS NULL THEN (a.v - w.v)/g.res WHEN w.v IS NULL THEN (e.v - a.v)/g.res ELSE (e.v - w.v)/(2e0*g.res) END AS gx,
  CASE WHEN s.v IS NULL THEN (a.v - n.v)/g.res WHEN n.v IS NULL THEN (s.v - a.v)/g.res ELSE (s.v - n.v)/(2e0*g.res) END AS gy
FROM {source} a JOIN grid g USING (survey_id)
LEFT JOIN {source} e ON e.survey_id = a.survey_id AND e.r = a.r AND e.c = a.c + 1
LEFT JOIN {source} w ON w.survey_id = a.survey_id AND w.r = a.r AND w.c = a.c - 1
LEFT JOIN {source} s ON s.survey_id = a.survey_id AND s.c = a.c AND s.r = a.r + 1
LEFT JOIN {source} n ON n.survey_id = a.survey_id AND n.c = a.c AND n.r = a.r - 1
"""


def metrics_sql(zones: str, sloped: str, keys: str = "survey_id, heap_id", empty: str = "0e0") -> str:
    return f"""
SELECT {keys}, round(sum(w)*any_value(res)*any_value(res), 6) AS volume_m3,
  round(count(*) FILTER (v > 0.5e0)*any_value(res)*any_value(res), 4) AS planimetric_area_m2,
  round(sum(CASE WHEN v > 0.5e0 THEN res*res*sqrt(1e0 + gx*gx + gy*gy) ELSE 0e0 END), 6) AS surface_area_m2,
  max(v) AS max_height_m,
  round(CASE WHEN count(*) FILTER (v > 0.5e0) > 0 THEN ((2*sum(round(w*1e6)::BIGINT) + count(*) FILTER (v > 0.5e0)) // (2*count(*) FILTER (v > 0.5e0)))/1e6 ELSE 0e0 END, 6) AS mean_height_m,
  round(CASE WHEN sum(w) > 0 THEN sum(w*(west + (c + 0.5e0)*res))/sum(w) ELSE {empty} END, 3) AS centroid_e,
  round(CASE WHEN sum(w) > 0 THEN sum(w*(north - (r + 0.5e0)*res))/sum(w) ELSE {empty} END, 3) AS centroid_n,
  any_value(west) + min(c)*any_value(res) AS bbox_min_e, any_value(north) - (max(r) + 1)*any_value(res) AS bbox_min_n,
  any_value(west) + (max(c) + 1)*any_value(res) AS bbox_max_e, any_value(north) - min(r)*any_value(res) AS bbox_max_n
FROM (SELECT *, CASE WHEN v > 0.5e0 THEN v ELSE 0e0 END AS w FROM {zones} JOIN {sloped} USING (survey_id, r, c))
GROUP BY {keys}
"""


step("sloped", ("ndsm", "grid"), gradient_sql("ndsm"))
step("metrics", ("labels", "sloped"), metrics_sql("labels", "sloped"))
