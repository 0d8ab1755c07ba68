"""The queries' SQL for DuckDB over the same tables, written apart from the DataFrame code."""

from __future__ import annotations

import math

from .operators import lsh
from .operators.grid import Grid
from .queries import CELLS, DIM, EPS, FINE, GRID, GRID_SWEEP, HYPERPLANE, K, MIN_SAMPLES, PAIR_SWEEP, PROBE, PSTABLE, SMALL, SWEEP, SWEEP_EPS, SWEEP_LEAST, TOP  # noqa: F401

SQL: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c for c in ctes if c) + "\n"


def _planes(configs) -> str:
    rows = ",".join(f"({c},{t},{h},{w!r}::double,{b!r}::double,{[*plane]!r}::double[])" for c, t, h, w, b, plane in lsh.draw(DIM, configs))
    return f"pl(c, t, h, w, b, plane) as (values {rows})"


VEC = "vec as (select vec_id as id, embedding::double[] as f, label::bigint as label from embeddings)"
ELEMENT = {
    "pstable": "floor((list_inner_product(f, plane) + b) / w)::bigint",
    "hyperplane": "case when list_inner_product(f, plane) > 0 then 1 else 0 end",
    "simhash": "case when list_inner_product(f, plane) > 0 then 1 else -1 end",
}


def _blocks(configs, kind: str) -> str:
    return f"""{_planes(configs)}, {VEC},
 blk as materialized (select c, t || ':' || string_agg(k::varchar, ',' order by h) as block_id, id
   from (select c, t, h, id, {ELEMENT[kind]} as k from vec cross join pl) group by c, t, id)"""


def _measures(blocks: str, ent: str, distinct: bool, extra: str = "") -> str:
    """One row of measures of the relation ``blocks`` (block_id, id) with entities ``ent`` (id, label)."""
    b = (
        f"(select count(*)::double from (select distinct l.id i, r.id j from {blocks} l join {blocks} r on l.block_id = r.block_id and l.id < r.id))"
        if distinct
        else f"(select coalesce(sum(n * (n - 1) / 2.0), 0)::double from (select count(distinct id) n from {blocks} group by block_id))"
    )
    return f"""select round(case when de > 0 then db / de else 0 end, 6) as pc, round(case when b > 0 then db / b else 0 end, 6) as pq,
   round(case when n >= 2 then 1 - b / (n * (n - 1) / 2.0) else 0 end, 6) as rr, db, b{extra}
 from (select (select count(*)::double from {ent}) as n, (select sum(m * (m - 1) / 2.0)::double from (select count(*) m from {ent} group by label)) as de,
   (select count(*)::double from (select distinct l.id i, r.id j from {blocks} l join {blocks} r on l.block_id = r.block_id and l.id < r.id
     join {ent} x on x.id = l.id join {ent} y on y.id = r.id where x.label = y.label)) as db, {b} as b)"""


HP = _blocks(HYPERPLANE, "hyperplane")
SQL["label_freq"] = "select label::bigint as label, count(*) as n from embeddings group by 1"
SQL["db_pairs"] = _with(HP) + "select distinct l.id as i, r.id as j from blk l join blk r on l.block_id = r.block_id and l.id < r.id join vec x on x.id = l.id join vec y on y.id = r.id where x.label = y.label"
SQL["eval_redundant"] = _with(HP) + _measures("blk", "vec", False)
SQL["eval_distinct"] = _with(HP) + _measures("blk", "vec", True)
SQL["lsh_hyperplane_eval"] = _with(HP) + _measures("blk", "vec", False, ", 'redundant' as variant") + " union all " + _measures("blk", "vec", True, ", 'distinct' as variant")
SQL["lsh_pstable_blocks"] = _with(_blocks(PSTABLE, "pstable")) + "select block_id, id from blk"
SQL["lsh_hyperplane_blocks"] = _with(HP) + "select block_id, id from blk"
SQL["lsh_simhash_blocks"] = _with(_blocks(HYPERPLANE, "simhash")) + "select block_id, id from blk"
_MET = "select distinct l.id, r.id as found, {v} as version from blk l join blk r on l.block_id = r.block_id where {v} = 2 or r.id % 2 = 0"
SQL["lsh_index_lookup"] = _with(HP) + " union all ".join(_MET.format(v=v) for v in (1, 2))
SQL["lsh_sweep"] = (
    _with(
        _blocks(SWEEP, "pstable"),
        "sz as (select c, count(*) as blocks, sum(n * (n - 1) / 2.0)::double as b from (select c, block_id, count(*) n from blk group by 1, 2) group by c)",
        "dbs as (select c, count(*)::double as db from (select distinct l.c, l.id i, r.id j from blk l join blk r on l.c = r.c and l.block_id = r.block_id and l.id < r.id join vec x on x.id = l.id join vec y on y.id = r.id where x.label = y.label) group by c)",
        "tot as (select count(*)::double as n, (select sum(m * (m - 1) / 2.0)::double from (select count(*) m from vec group by label)) as de from vec)",
    )
    + """select c::int as config_id, blocks, round(coalesce(db, 0) / de, 6) as pc, round(case when b > 0 then coalesce(db, 0) / b else 0 end, 6) as pq,
  round(1 - b / (n * (n - 1) / 2), 6) as rr, coalesce(db, 0.0::double) as db, b from sz left join dbs using (c) cross join tot"""
)
CENTRED = """ctr as materialized (select id, dim, x - avg(x) over (partition by dim) as x from (select id, unnest(range(64)) as dim, unnest(f) as x from vec))"""
SQL["vec_center"] = _with(VEC, CENTRED) + "select id, dim, round(x, 6) as x from ctr"
D2 = "(select sum((x - y) * (x - y)) from (select unnest(a.f) x, unnest(b.f) y))"
NEAR = "list_aggregate(list_transform(list_zip(a.f, b.f), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')"
ALL = f"d2 as materialized (select a.id as i, b.id as j, {NEAR} as d from vec a cross join vec b)"
KNN = f"knn as (select i as block_id, j as id from (select i, j, row_number() over (partition by i order by d, j) r from d2) where r <= {K})"
SQL["knn_blocks"] = _with(VEC, ALL, KNN) + "select block_id, id from knn"


def _probed(name: str = "mp") -> str:
    return f"""cv as materialized (select id, list(x order by dim) as f from ctr group by id), {_planes(PROBE)},
 hd as materialized (select id, t, h, list_inner_product(f, plane) as dt from cv cross join pl),
 bits as materialized (select id, t, list((dt > 0)::int order by h) as k from hd group by id, t),
 flip as (select id, t, -1 as p, 0.0::double as m from bits union all select id, t, h, abs(dt) from hd),
 pick as (select id, t, p from (select id, t, p, row_number() over (partition by id order by m, t, p) r from flip) where r <= 20),
 prb as (select id as i, t, list_transform(k, lambda v, n: case when n = p + 1 then 1 - v else v end) as k from pick join bits using (id, t)),
 cnd as materialized (select distinct i, bits.id as j from prb join bits on prb.t = bits.t and prb.k = bits.k),
 {name} as materialized (select i as block_id, j as id from (select i, j, row_number() over (partition by i order by {NEAR}, j) r from cnd join cv a on a.id = i join cv b on b.id = j) where r <= {K})"""


SQL["mplsh_blocks"] = _with(VEC, CENTRED, _probed()) + "select block_id, id from mp"
SQL["knn_mplsh_eval"] = _with(VEC, ALL, KNN, CENTRED, _probed()) + _measures("knn", "vec", False, ", 'exact' as method") + " union all " + _measures("mp", "vec", False, ", 'multiprobe' as method")


def _dbscan(eps: float, least: int, tag: str = "") -> str:
    return f"""ed{tag} as materialized (select i, j from d2 where d <= {eps * eps!r}),
 core{tag} as materialized (select i from ed{tag} group by i having count(*) >= {least}),
 ce{tag} as materialized (select i, j from ed{tag} where i in (select i from core{tag}) and j in (select i from core{tag})),
 rch{tag}(i, r) as (select i, i from core{tag} union select e.j, q.r from rch{tag} q join ce{tag} e on e.i = q.i),
 cmp{tag} as (select i, min(r) as c from rch{tag} group by i),
 num{tag} as materialized (select i, dense_rank() over (order by c) - 1 as cluster from cmp{tag}),
 bor{tag} as (select e.i, min(cluster) as cluster from ed{tag} e join num{tag} n on n.i = e.j group by e.i),
 lab{tag} as materialized (select id, coalesce(n.cluster, b.cluster, -1)::bigint as cluster from vec left join num{tag} n on n.i = id left join bor{tag} b on b.i = id)"""


SQL["dbscan_labels"] = _with(VEC, ALL, _dbscan(EPS, MIN_SAMPLES)) + "select id, cluster from lab"
SQL["dbscan_blocks"] = _with(VEC, ALL, _dbscan(EPS, MIN_SAMPLES)) + "select cluster as block_id, id from lab"
SQL["dbscan_sizes"] = _with(VEC, ALL, _dbscan(EPS, MIN_SAMPLES)) + "select cluster, count(*) as n from lab group by cluster"
_RUNS = [(e, m, f"_{i}") for i, (e, m) in enumerate((e, m) for e in (1.1, 1.15) for m in (5, 10))]
SQL["dbscan_sweep"] = _with(VEC, ALL, *[_dbscan(e, m, t) for e, m, t in _RUNS], *[f"bl{t} as (select cluster as block_id, id from lab{t})" for _, _, t in _RUNS]) + " union all ".join(
    _measures(f"bl{t}", "vec", False, f", '{e:g}/{m}' as config_id, (select count(distinct block_id) from bl{t}) as blocks") for e, m, t in _RUNS
)
SQL["dbscan_sweep_all"] = (
    _with(
        VEC,
        ALL,
        f"cf as materialized (select e, m, e::int::varchar || '/' || m as config_id from (select unnest({SWEEP_EPS}::double[]) as e), (select unnest({SWEEP_LEAST}) as m))",
        "deg as materialized (select e, i, count(*) as n from (select distinct e from cf) join d2 on d <= e * e group by e, i)",
        "core as materialized (select cf.e, m, i from cf join deg on deg.e = cf.e and n >= m)",
        "ce as materialized (select x.e, x.m, x.i, y.i as j from core x join d2 on d2.i = x.i and d2.d <= x.e * x.e join core y on y.e = x.e and y.m = x.m and y.i = d2.j)",
        """rt(e, m, i, r) using key (e, m, i) as (select e, m, i, i from core union
  select ce.e, ce.m, ce.j, min(rt.r) from rt join ce on ce.e = rt.e and ce.m = rt.m and ce.i = rt.i join recurring.rt old on old.e = ce.e and old.m = ce.m and old.i = ce.j group by ce.e, ce.m, ce.j having min(rt.r) < min(old.r))""",
        "num as materialized (select e, m, i, dense_rank() over (partition by e, m order by r) - 1 as cluster from rt)",
        "bor as (select num.e, num.m, d2.i, min(cluster) as cluster from num join d2 on d2.j = num.i and d2.d <= num.e * num.e group by all)",
        "lb as materialized (select config_id, id, vec.label, coalesce(num.cluster, bor.cluster, -1)::bigint as cluster from cf cross join vec left join num on num.e = cf.e and num.m = cf.m and num.i = id left join bor on bor.e = cf.e and bor.m = cf.m and bor.i = id)",
        "b as (select config_id, count(*) as blocks, sum(n * (n - 1) / 2.0)::double as b from (select config_id, cluster, count(*) as n from lb group by all) group by all)",
        "db as (select config_id, sum(n * (n - 1) / 2.0)::double as db from (select config_id, cluster, label, count(*) as n from lb group by all) group by all)",
        "tot as (select count(*)::double as n, (select sum(m * (m - 1) / 2.0)::double from (select count(*) m from vec group by label)) as de from vec)",
    )
    + "select config_id, blocks, round(db / de, 6) as pc, round(case when b > 0 then db / b else 0 end, 6) as pq, round(1 - b / (n * (n - 1) / 2), 6) as rr, db, b from b join db using (config_id) cross join tot"
)
SQL["dbscan_export"] = "select vec_id + 1 as line, (vec_id + 1) || chr(9) || array_to_string(list_transform(embedding, lambda x: trunc((x::double + 1) * 5000)::int::varchar), chr(9)) as value from embeddings"
SQL["external_clusters"] = _with(VEC, "ext as (select label as block_id, id from vec)") + _measures("ext", "vec", False)
SQL["vectors_text"] = "select vec_id as id, label::int as label, unnest(range(64)) as dim, round(unnest(embedding)::double, 6) as x from embeddings"

PTS = """ev as (select event_id, user_id, event_type, ts, cast(floor((day(ts) - 1) / 5) as bigint) as b from events),
 st as (select *, user_id * 10 + b as traj_id, row_number() over (partition by user_id, b order by ts, event_id) - 1 as p,
   (event_id * 7919) % 6001 - 3000 as dx, (event_id * 104729) % 6001 - 3000 as dy, case when event_type = 'error' and event_id % 5 = 0 then 60000 else 0 end as spike from ev),
 pts as materialized (select traj_id, user_id as driver_id, p, 1700000000 + traj_id * 3600 + 15 * p as t,
   (103700000 + ((user_id * 37) % 100) * 2500 + sum(dx) over w + spike) / 1e6 as lon, (1250000 + ((user_id * 61) % 100) * 1800 + sum(dy) over w) / 1e6 as lat
   from st window w as (partition by user_id, b order by ts, event_id rows unbounded preceding))"""


def _xy(g: Grid, lon: str = "lon", lat: str = "lat") -> str:
    return f"floor(({lon} - {g.lon_min!r}) / {g.gap_x!r})::bigint as cell_x, floor(({lat} - {g.lat_min!r}) / {g.gap_y!r})::bigint as cell_y"


def _inside(g: Grid, of: str = "pts", name: str = "inr") -> str:
    return f"{name} as (select traj_id from {of} group by traj_id having min(lon) >= {g.lon_min!r} and max(lon) <= {g.lon_max!r} and min(lat) >= {g.lat_min!r} and max(lat) <= {g.lat_max!r})"


def _trips(g: Grid, of: str = "pts", name: str = "ct") -> str:
    return f"{name} as materialized (select cell_x, cell_y, traj_id, driver_id, count(*) as n from (select *, {_xy(g)} from {of}) group by all)"


SQL["grid_assign"] = _with(PTS) + f"select traj_id, p::int as p, {_xy(GRID)} from pts"
_TR = Grid(16, 103.72, 103.90, 1.25, 1.45)
SQL["engrid_trunc"] = _with(PTS) + f"select traj_id, p::int as p, trunc((lon - {_TR.lon_min!r}) / {_TR.gap_x!r})::bigint as cell_x, trunc((lat - {_TR.lat_min!r}) / {_TR.gap_y!r})::bigint as cell_y from pts"
SQL["trip_range_filter"] = _with(PTS, _inside(SMALL)) + "select traj_id from inr"
SQL["cell_stats"] = _with(PTS, _trips(GRID)) + "select cell_x, cell_y, sum(n)::bigint as freq, count(distinct traj_id) as n_traj from ct group by 1, 2"
SQL["driver_cell_freq"] = _with(PTS, _trips(GRID)) + "select driver_id, cell_x, cell_y, sum(n)::bigint as freq from ct group by 1, 2, 3"
SQL["stop_cell_freq"] = _with(PTS) + f"select cell_x, cell_y, count(*) as stop_freq from (select {_xy(GRID)} from pts where p % 4 = 0) group by 1, 2"
SQL["cell_dwell"] = (
    _with(PTS, "dw as (select *, coalesce(lead(t) over w - t, t - lag(t) over w, 0) as dwell from pts window w as (partition by traj_id order by p))")
    + f"select cell_x, cell_y, sum(dwell)::bigint as dwell from (select dwell, {_xy(GRID)} from dw) group by 1, 2"
)


def _ranked(g: Grid, k: int, tag: str = "") -> str:
    """Relations of a grid run: rk (ranked cells), cd (candidates), cf (conflicts), sel (chosen), gb (blocks)."""
    return f"""{_inside(g, name="inr" + tag)}, ip{tag} as materialized (select * from pts where traj_id in (select traj_id from inr{tag})), {_trips(g, "ip" + tag, "ct" + tag)},
 sf{tag} as (select cell_x, cell_y, count(*) as stop_freq from (select {_xy(g)} from pts where p % 4 = 0) group by 1, 2),
 sc{tag} as (select cell_x, cell_y, freq, n_traj, coalesce(stop_freq, 0) as stop_freq, freq * sqrt(1 + coalesce(stop_freq, 0)) / (n_traj + 1.0) as score
   from (select cell_x, cell_y, sum(n)::bigint as freq, count(*) as n_traj from ct{tag} group by 1, 2) left join sf{tag} using (cell_x, cell_y)),
 rk{tag} as materialized (select *, row_number() over (order by score desc, cell_x, cell_y) as rank from sc{tag}),
 cd{tag} as materialized (select * from rk{tag} where n_traj >= 4 and n_traj <= (select count(distinct traj_id) from pts) / 4.0),
 tr{tag} as materialized (select traj_id, rank, n_traj from ct{tag} join cd{tag} using (cell_x, cell_y)),
 cf{tag} as materialized (select a.rank as chosen, b.rank as candidate from cd{tag} a join cd{tag} b on a.rank < b.rank and abs(a.cell_x - b.cell_x) + abs(a.cell_y - b.cell_y) <= 1
   union select a.rank, b.rank from tr{tag} a join tr{tag} b on a.traj_id = b.traj_id and a.rank < b.rank group by a.rank, b.rank, b.n_traj having count(*) > 0.7 * b.n_traj),
 od{tag} as materialized (select row_number() over (order by rank) as o, rank, coalesce((select list(chosen) from cf{tag} where candidate = rank), []::bigint[]) as against from cd{tag}),
 gr{tag}(o, sel) as (select 0::bigint, []::bigint[] union all select od{tag}.o, case when len(sel) < {k} and not list_has_any(sel, against) then list_append(sel, rank) else sel end from gr{tag} join od{tag} on od{tag}.o = gr{tag}.o + 1),
 sel{tag} as materialized (select unnest(sel) as rank from gr{tag} where o = (select max(o) from gr{tag})),
 top{tag} as materialized (select rank, cell_x, cell_y from sel{tag} join cd{tag} using (rank)),
 gb{tag} as materialized (select cell_x || '_' || cell_y as block_id, traj_id as id from ct{tag} join top{tag} using (cell_x, cell_y)
   where (cell_x, cell_y) in (select (cell_x, cell_y) from ct{tag} group by cell_x, cell_y having count(*) > 2))"""


RUN = _ranked(GRID, CELLS)
ENT = "ent as (select distinct traj_id as id, driver_id as label from pts)"
SQL["cell_scores"] = _with(PTS, RUN) + "select cell_x, cell_y, freq, n_traj, stop_freq, round(score, 6) as score, rank from rk"
SQL["cell_candidates"] = _with(PTS, RUN) + "select cell_x, cell_y, rank, n_traj from cd"
SQL["cell_conflicts"] = _with(PTS, RUN) + "select chosen, candidate from cf"
SQL["grid_topk"] = _with(PTS, RUN) + "select rank, cell_x, cell_y from top"
SQL["grid_blocks"] = _with(PTS, RUN) + "select block_id, id from gb"
SQL["grid_eval"] = _with(PTS, RUN, ENT) + _measures("gb", "ent", True)


def _grid_sweep(runs: list[tuple[int, int]]) -> str:
    tagged = [(n, k, f"_{i}") for i, (n, k) in enumerate(runs)]
    return _with(PTS, ENT, *[_ranked(Grid(n), k, t) for n, k, t in tagged]) + " union all ".join(_measures(f"gb{t}", "ent", True, f", {n}::bigint as cells, {k}::bigint as k") for n, k, t in tagged)


SQL["grid_sweep"] = _grid_sweep([(16, 10), (16, 20), (40, 20)])
SQL["grid_sweep_all"] = _grid_sweep(GRID_SWEEP)
SQL["cell_rank_report"] = _with(PTS, RUN) + "select cell_x || '_' || cell_y as cell, rank - 1 as rank, n_traj, freq, stop_freq, rank in (select rank from sel) as chosen from rk"

PAIRS = """tp as (select distinct traj_id, driver_id from pts where traj_id % 10 >= 3),
 pr as materialized (select l.traj_id as lid, r.traj_id as rid, l.driver_id = r.driver_id as m from tp l join tp r on l.traj_id < r.traj_id
   and (l.driver_id = r.driver_id or (r.driver_id = l.driver_id + 1 and l.traj_id % 10 = r.traj_id % 10)))"""


def _profiled(g: Grid, k: int, tag: str = "") -> str:
    least = k / 2 if k < 20 else math.sqrt(k) / 1.3
    return f"""trn{tag} as (select * from pts where traj_id % 10 < 3), {_inside(g, "trn" + tag, "ti" + tag)},
 cdr{tag} as materialized (select cell_x, cell_y, driver_id, count(*) as n from (select *, {_xy(g)} from trn{tag} where traj_id in (select traj_id from ti{tag})) group by 1, 2, 3),
 td{tag} as materialized (select * from (select *, row_number() over (partition by cell_x, cell_y order by n desc, driver_id) as rank from cdr{tag}) where rank <= {k}),
 pp{tag} as (select traj_id, td{tag}.driver_id, sum(n)::bigint as total from (select traj_id, {_xy(g)} from pts) join td{tag} using (cell_x, cell_y) group by 1, 2),
 pf{tag} as materialized (select * from (select *, row_number() over (partition by traj_id order by total desc, driver_id) as rank from pp{tag}) where rank <= {k}),
 ps{tag} as (select *, max(rank) over (partition by traj_id) - rank + 1 as w from pf{tag}),
 jd{tag} as materialized (select pr.*, (select count(*) from ps{tag} a join ps{tag} b using (driver_id) where a.traj_id = lid and b.traj_id = rid) as shared,
   coalesce((select sum(a.w * b.w) from ps{tag} a join ps{tag} b using (driver_id) where a.traj_id = lid and b.traj_id = rid), 0)::bigint as rank_score from pr),
 ju{tag} as (select *, shared > {least!r} as judged from jd{tag})"""


def _prf(rel: str, extra: str = "") -> str:
    div = lambda a, b: f"round(case when {b} > 0 then ({a})::double / ({b}) else 0 end, 6)"
    return f"""select {div("tp", "tp + fp")} as precision_1, {div("tp", "tp + fn")} as recall_1, {div("2 * tp", "2 * tp + fp + fn")} as f1_1,
  {div("tn", "tn + fn")} as precision_0, {div("tn", "tn + fp")} as recall_0, {div("2 * tn", "2 * tn + fp + fn")} as f1_0, tp + fn as positives, tp + fp as judged_positives{extra}
 from (select count(*) filter (m and judged) as tp, count(*) filter (not m and judged) as fp, count(*) filter (m and not judged) as fn, count(*) filter (not m and not judged) as tn from {rel})"""


PROF = _profiled(GRID, TOP)
SQL["cell_driver_hist"] = _with(PTS, PAIRS, PROF) + "select cell_x, cell_y, driver_id, n from cdr"
SQL["cell_trip_hist"] = _with(PTS, PAIRS, PROF) + f"select cell_x, cell_y, traj_id, count(*) as n from (select *, {_xy(GRID)} from trn where traj_id in (select traj_id from ti)) group by 1, 2, 3"
SQL["cell_topk_drivers"] = _with(PTS, PAIRS, PROF) + "select cell_x, cell_y, driver_id, n, rank from td"
SQL["trip_topk_drivers"] = _with(PTS, PAIRS, PROF) + "select traj_id, driver_id, total, rank from pf"
SQL["pair_judge"] = _with(PTS, PAIRS, PROF) + "select lid, rid, m, shared, judged from ju"
SQL["pair_rank_score"] = _with(PTS, PAIRS, PROF) + "select lid, rid, rank_score from ju"
SQL["pair_ids_union"] = _with(PTS, PAIRS) + "select lid as traj_id from pr union select rid from pr"
SQL["pair_prf"] = _with(PTS, PAIRS, PROF) + _prf("ju")


def _pair_sweep(runs: list[tuple[int, int]]) -> str:
    tagged = [(n, k, f"_{i}") for i, (n, k) in enumerate(runs)]
    return _with(PTS, PAIRS, *[_profiled(Grid(n), k, t) for n, k, t in tagged]) + " union all ".join(_prf(f"ju{t}", f", {n}::bigint as cells, {k}::bigint as k") for n, k, t in tagged)


SQL["pair_sweep"] = _pair_sweep([(14, 4), (16, 5), (28, 5), (28, 4)])
SQL["pair_sweep_all"] = _pair_sweep(PAIR_SWEEP)
SQL["geo_range"] = (
    _with(PTS, "ex as (select min(lon) a, max(lon) b, min(lat) c, max(lat) d from pts group by traj_id)")
    + "select round(min(a) filter (a > 103.7), 6) as lon_min, round(max(b) filter (b < 104.0), 6) as lon_max, round(min(c) filter (c > 1.25), 6) as lat_min, round(max(d) filter (d < 1.43), 6) as lat_max from ex"
)


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * 6371008.8 * asin(sqrt(case when {a} > 1 then 1.0 else {a} end))"


W = "window w as (partition by traj_id order by p)"
SEG = f"""sg0 as (select *, t - lag(t) over w as dt, row_number() over w = 1 as first, {_hav("lag(lon) over w", "lag(lat) over w", "lon", "lat")} as dist from pts {W}),
 sg as materialized (select traj_id, driver_id, p::int as p, t, lon, lat, dt, dist, case when first then 0.0 when dt > 0 then dist / dt end as speed, coalesce(case when first then 0.0 when dt > 0 then dist / dt end < 38.9, false) as normal from sg0),
 nz as materialized (select traj_id, count(*) filter (normal) < 5 or count(*) filter (normal) / count(*)::double < 0.5 as too_much_noise from sg group by traj_id),
 kp as materialized (select * from sg where normal)"""
ACC = f"ac as materialized (select *, coalesce((speed - lag(speed) over w) / nullif(dt, 0), 0.0) as accel from kp {W})"


def _angles(of: str, name: str, da: bool) -> str:
    theta = "atan(dy / case when dx = 0 then 1e-8 else dx end)"
    if da:
        theta = f"case when dy < 0 then pi() + {theta} else {theta} end"
    return f"""{name}0 as (select *, lead(lon) over w - lon as dx, lead(lat) over w - lat as dy, lead(dist) over w as mv from {of} {W}),
 {name}1 as (select *, case when mv >= 0.1 then {theta} end as th from {name}0),
 {name} as materialized (select *, coalesce(last_value(th ignore nulls) over (partition by traj_id order by p rows unbounded preceding), 0.0) as angle from {name}1)"""


VT = f"""{_angles("ac", "hv", False)},
 vt as materialized (select *, coalesce(angle - lag(angle) over w, 0.0) as angle_diff, abs(coalesce(angle - lag(angle) over w, 0.0)) > 0.3 as is_turning
   from hv where traj_id in (select traj_id from nz where not too_much_noise) {W})"""
DA = f"""{_angles("sg", "hd", True)},
 dt0 as (select *, coalesce(least(abs(angle - lag(angle) over w), abs(2 * pi() - angle - lag(angle) over w)), 0.0) as delta_theta from hd {W}),
 da as materialized (select *, delta_theta > pi() / 6 as is_turning, coalesce((speed - lag(speed) over w) / nullif(dt, 0), 0.0) as accel from dt0 where normal {W})"""
STATE = "(2 * case when accel > 0.1 then 0 when accel < -0.1 then 2 else 1 end + is_turning::int)::int"
SV, SD = f"sv as materialized (select *, {STATE} as state from vt)", f"sv as materialized (select *, {STATE} as state from da)"
SQL["seg_distance"] = _with(PTS, SEG) + "select traj_id, p, round(dist, 6) as dist, dt from sg"
SQL["seg_speed"] = _with(PTS, SEG) + "select traj_id, p, round(speed, 6) as speed, normal from sg"
SQL["noise_flag"] = _with(PTS, SEG) + "select traj_id, too_much_noise from nz"
SQL["noise_filtered_points"] = _with(PTS, SEG) + "select traj_id, p, round(dist, 6) as dist, dt, round(speed, 6) as speed from kp"
SQL["accelerations"] = _with(PTS, SEG, ACC) + "select traj_id, p, round(accel, 6) as accel from ac"
SQL["headings_vt"] = _with(PTS, SEG, _angles("kp", "hv", False)) + "select traj_id, p, round(angle, 6) as angle from hv"
SQL["headings_da"] = _with(PTS, SEG, _angles("sg", "hd", True)) + "select traj_id, p, round(angle, 6) as angle from hd"
SQL["delta_theta"] = _with(PTS, SEG, DA) + "select traj_id, p, round(delta_theta, 6) as delta_theta from dt0"
SQL["is_turning"] = _with(PTS, SEG, ACC, VT) + "select traj_id, p, round(angle_diff, 6) as angle_diff, is_turning from vt"
SQL["state_seq"] = _with(PTS, SEG, ACC, VT, SV) + "select traj_id, p, state from sv"
SQL["state_seq_da"] = _with(PTS, SEG, DA, SD) + "select traj_id, p, state from sv"
_C = ", ".join(f"count(*) filter (state = {i}) as c{i}" for i in range(6))
_LO, _HI = (f"{f}({', '.join(f'c{i}' for i in range(6))})" for f in ("least", "greatest"))
SQL["seq_vector"] = _with(PTS, SEG, DA, SD) + "select traj_id, " + ", ".join(f"round((c{i} - {_LO}) / {_HI}::double, 6) as s{i}" for i in range(6)) + f" from (select traj_id, {_C} from sv group by traj_id)"
EDGES = f"eg as materialized (select traj_id, state as src, lead(state) over w as tgt from sv {W})"
SQL["transition_edges"] = _with(PTS, SEG, DA, SD, EDGES) + "select traj_id, src, tgt, count(*) as n from eg where tgt is not null group by 1, 2, 3"


def _graph(name: str = "gv") -> str:
    return f"""{name}0 as (select traj_id, edge, count(eg.src) as n from (select distinct traj_id from sv) cross join (select unnest(range(36)) as edge) left join eg using (traj_id) where true group by 1, 2),
 {name}c as (select ids.traj_id, e.edge, coalesce(n, 0) as n from (select distinct traj_id from sv) ids cross join (select unnest(range(36)) as edge) e
   left join (select traj_id, src * 6 + tgt as edge, count(*) as n from eg where tgt is not null group by 1, 2) q on q.traj_id = ids.traj_id and q.edge = e.edge),
 {name} as materialized (select traj_id, edge, case when max(n) over g = 0 then 0.0 else (n - min(n) over g) / (max(n) over g)::double end as v from {name}c window g as (partition by traj_id))"""


GRAPH = "gv" + _graph().split("\n gv", 1)[1]
SQL["graph_vector"] = _with(PTS, SEG, DA, SD, EDGES, GRAPH) + "select traj_id, edge, round(v, 6) as v from gv"


def _stats(value: str, name: str, where: str = "true") -> str:
    f = f"filter (where {where})"
    qs = ", ".join(f"round(coalesce(quantile_cont({value}, {q}) {f}, 0), 6) as {name}_{n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))
    return f"round(coalesce(avg({value}) {f}, 0), 6) as {name}_mean, round(coalesce(var_pop({value}) {f}, 0), 6) as {name}_var, {qs}"


_GROUPS = (("speed", "speed", "true"), ("acc", "accel", "accel > 0"), ("dec", "accel", "accel <= 0"), ("turn_speed", "speed", "is_turning"), ("turn_acc", "accel", "is_turning and accel > 0"), ("turn_dec", "accel", "is_turning and accel <= 0"))
SQL["base_stat_speed"] = _with(PTS, SEG) + f"select traj_id, {_stats('speed', 'speed')} from kp group by traj_id"
_AT = "select {g} as driver_id, count(*) as n, {q}::double as q, round(quantile_cont(speed, {q}), 6) as value from sg where speed is not null group by {g}"
SQL["speed_quantiles"] = _with(PTS, SEG) + " union all ".join([_AT.format(g="-1::bigint", q=q).replace("group by -1::bigint", "") for q in (0.0, 0.1, 0.5, 0.9, 1.0)] + [_AT.format(g="driver_id", q=q) for q in (0.1, 0.5, 0.9)])
_NAMES = [f"{g}_{s}" for g, _, _ in _GROUPS for s in ("mean", "var", "p10", "p50", "p90")]
FEATS = f"ft as (select traj_id, {', '.join(_stats(v, g, c) for g, v, c in _GROUPS)} from vt group by traj_id), lb as (select distinct traj_id, driver_id as label from pts)"
SQL["traj_features"] = _with(PTS, SEG, ACC, VT, FEATS) + f"select traj_id, too_much_noise, label, {', '.join(f'coalesce({c}, 0.0) as {c}' for c in _NAMES)} from nz left join ft using (traj_id) join lb using (traj_id)"
SQL["graph_features"] = (
    _with(
        PTS, SEG, ACC, VT, SV, EDGES, GRAPH,
        "sq as (select ids.traj_id, e.k, coalesce(n, 0) as n from (select distinct traj_id from sv) ids cross join (select unnest(range(6)) as k) e left join (select traj_id, state as k, count(*) as n from sv group by 1, 2) q on q.traj_id = ids.traj_id and q.k = e.k)",
        "bt as (select traj_id, k, (n - min(n) over g) / (max(n) over g)::double as v from sq window g as (partition by traj_id) union all select traj_id, edge + 6, v from gv)",
    )
    + "select traj_id, too_much_noise, k, round(coalesce(bt.v, 0.0), 6) as v from nz cross join (select unnest(range(42)) as k) left join bt using (traj_id, k)"
)
_RAW = ", ".join(f"coalesce(avg({v}) filter (where {c}), 0) as {g}_mean, coalesce(var_pop({v}) filter (where {c}), 0) as {g}_var" for g, v, c in _GROUPS)
SQL["driver_statistics"] = (
    _with(PTS, SEG, ACC, VT, f"fr as (select traj_id, driver_id as label, {_RAW} from vt group by 1, 2)", "far as (select traj_id, sum(dist) as distance from sg group by 1)")
    + "select label, " + ", ".join(f"round(avg({g}_{s}), 6) as {g}_{s}" for g, _, _ in _GROUPS for s in ("mean", "var")) + ", round(avg(distance), 6) as distance from fr join far using (traj_id) group by label"
)
SQL["speed_info"] = _with(PTS, SEG, ACC, VT) + "select traj_id, p, round(speed, 6) as speed, t, false as turning from vt union all select traj_id, p, round(speed, 6), t, true from vt where is_turning"
SQL["cell_hour_speed"] = (
    _with(PTS, SEG, ACC, VT, f"ch as materialized (select *, ((t % 86400) // 3600)::int as hour, {_xy(GRID)} from vt)")
    + """select cell_x, cell_y, hour, round(avg(speed), 6) as speed_mean, round(var_pop(speed), 6) as speed_var, round(avg(speed) filter (is_turning), 6) as turn_mean, round(var_pop(speed) filter (is_turning), 6) as turn_var
 from (select distinct cell_x, cell_y from ch) cross join (select unnest(range(24))::int as hour) left join ch using (cell_x, cell_y, hour) group by 1, 2, 3"""
)
SQL["stay_times"] = (
    _with(PTS, SEG, f"gp as (select traj_id, lead(t) over w - t as gap, {_hav('lon', 'lat', 'lead(lon) over w', 'lead(lat) over w')} as d from kp {W})")
    + "select traj_id, count(*) filter (gap > 24) as stays, round(coalesce(sum(gap) filter (gap > 24), 0) / 3600.0, 6) as hours, round(coalesce(avg(d) filter (gap > 24), 0), 6) as mean_distance from gp group by traj_id"
)
TRIPS = "tm as materialized (select traj_id, driver_id, min(t) as t0, arg_min(lon, p) as start_lon, arg_min(lat, p) as start_lat, arg_max(lon, p) as end_lon, arg_max(lat, p) as end_lat, make_timestamp((min(t) * 1000000)::bigint) as utc from pts group by 1, 2)"
# Lisbon's clock is UTC in winter and an hour ahead from the last Sunday of March to that of October, both at 01:00 UTC.
_SUNDAY = lambda m: f"(make_date(year(utc)::int, {m}, 31) - (dayofweek(make_date(year(utc)::int, {m}, 31)))::int)::timestamp + interval 1 hour"
LOCAL = f"lt as materialized (select *, utc + case when utc >= {_SUNDAY(3)} and utc < {_SUNDAY(10)} then interval 1 hour else interval 0 hour end as tl from tm)"
SQL["time_enrich"] = _with(PTS, TRIPS, LOCAL) + "select traj_id, driver_id, t0, strftime(tl, '%Y-%m-%d %H:%M:%S') as time, strftime(tl, '%Y-%m-%d') as date, hour(tl) as hour, round(start_lon, 6) as start_lon, round(start_lat, 6) as start_lat from lt"
SQL["trips_per_date"] = _with(PTS, TRIPS, LOCAL) + "select strftime(tl, '%Y-%m-%d') as date, count(*) as n from lt group by 1"
SQL["trips_on_date"] = _with(PTS, TRIPS, LOCAL) + "select traj_id, driver_id, t0 from lt where strftime(tl, '%Y-%m-%d') = '2023-11-16'"
SQL["trips_in_hours"] = _with(PTS, TRIPS, LOCAL) + "select traj_id, driver_id, t0 from lt where hour(tl) between 7 and 9"
SQL["trips_of_driver"] = _with(PTS) + "select traj_id, driver_id, p::int as p, t, round(lon, 6) as lon, round(lat, 6) as lat from pts where driver_id = 7"
_GX = lambda c: f"floor(({c} - {GRID.lon_min!r}) / {GRID.gap_x!r})::bigint"
_GY = lambda c: f"floor(({c} - {GRID.lat_min!r}) / {GRID.gap_y!r})::bigint"
ODS = f"od as (select *, {_GX('start_lon')} || '_' || {_GY('start_lat')} || '_' || {_GX('end_lon')} || '_' || {_GY('end_lat')} as sd from tm)"
SQL["od_counts"] = _with(PTS, TRIPS, ODS) + "select sd, count(*) as n from od group by 1"
SQL["od_driver_counts"] = _with(PTS, TRIPS, ODS) + "select sd, driver_id, count(*) as n from od group by 1, 2"
SQL["start_centroid"] = _with(PTS, TRIPS) + "select round(avg(start_lon), 6) as lon, round(avg(start_lat), 6) as lat from tm"
SQL["expanded_trips"] = _with(PTS) + "select traj_id, driver_id, p::int as p, t::bigint as t, round(lon, 6) as lon, round(lat, 6) as lat from pts"
SQL["sample_trips"] = _with(PTS, TRIPS) + "select traj_id, driver_id from tm order by md5(traj_id || ':1'), traj_id limit 10"
_TOP = "tp as (select sd, count(*) as n, min(driver_id) as a, max(driver_id) as b from od group by sd order by n desc, sd limit 1)"
_SOME = lambda c, n: f"(select sd, driver_id, traj_id from od where (sd, driver_id) in (select (sd, {c}) from tp) order by md5(traj_id || ':1'), traj_id limit {n})"
SQL["od_two_drivers"] = _with(PTS, TRIPS, ODS, _TOP) + f"select * from {_SOME('a', 2)} union all select * from {_SOME('b', 3)}"
_LUCK = "('0x' || substr(md5('10086:' || cell_x || ':' || cell_y), 1, 8))::bigint / 4294967296.0 < 0.1"
_CHANCE = RUN.replace("as against from cd", f"as against, {_LUCK} as lucky from cd").replace("not list_has_any(sel, against)", "(lucky or not list_has_any(sel, against))")
SQL["grid_topk_chance"] = _with(PTS, _CHANCE) + "select rank, cell_x, cell_y from top"
SQL["pair_csv"] = _with(PTS, PAIRS) + "select lid, rid from pr"
SQL["feature_sink"] = SQL["graph_features"].replace("select traj_id, too_much_noise,", "select traj_id, traj_id // 10 as label,")
SQL["cluster_files"] = _with(VEC, *[f"ext{r} as (select label as block_id, id from vec where label % 2 = {r})" for r in (0, 1)]) + " union all ".join(
    f"select {r} as config_id, (select count(distinct block_id) from ext{r}) as blocks, * from ({_measures(f'ext{r}', 'vec', False)})" for r in (0, 1)
)
_POINT = "'[' || lon || ',' || lat || ']'"
SQL["trip_geojson"] = _with(PTS) + (
    """select traj_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[' || string_agg("""
    + _POINT
    + """, ',' order by p) || ']},"properties":{"traj_id":' || traj_id || ',"driver_id":' || driver_id || '}}' as feature from pts group by traj_id, driver_id"""
)

# Vincenty's inverse formula: lam is refined in rounds, twelve of which are more than these short ways need.
_F = 1 / 298.257223563
_A, _B = 6378137.0, 6378137.0 * (1 - _F)
_TERMS = """select traj_id, p, span, s1, c1, s2, c2, lam, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) as ss, s1 * s2 + c1 * c2 * cos(lam) as cs"""
_ANGLES = f"""select *, atan2(ss, cs) as sigma, case when ss = 0 then 0.0 else c1 * c2 * sin(lam) / ss end as sa from ({_TERMS} from {{}})"""
_MID = f"""select *, 1 - sa * sa as c2a, case when 1 - sa * sa = 0 then 0.0 else cs - 2 * s1 * s2 / (1 - sa * sa) end as mid from ({_ANGLES})"""
_WAY = f"""vi0 as (select traj_id, p, atan((1 - {_F!r}) * tan(radians(lag(lat) over w))) as u1, atan((1 - {_F!r}) * tan(radians(lat))) as u2, radians(lon - lag(lon) over w) as span from pts {W}),
 vi(k, traj_id, p, span, s1, c1, s2, c2, lam) as (select 0, traj_id, p, span, sin(u1), cos(u1), sin(u2), cos(u2), span from vi0
   union all select k + 1, traj_id, p, span, s1, c1, s2, c2, span + (1 - c) * {_F!r} * sa * (sigma + c * ss * (mid + c * cs * (2 * mid * mid - 1)))
     from (select *, {_F!r} / 16 * c2a * (4 + {_F!r} * (4 - 3 * c2a)) as c from (select m.*, k from ({_MID.format('vi')}) m join (select traj_id as i, p as q, k from vi) n on n.i = m.traj_id and n.q = m.p)) where k < 12),
 ve as (select *, c2a * {_A**2 - _B**2!r} / {_B**2!r} as k2 from ({_MID.format("(select * from vi where k = 12)")}))"""
_DS = "bb * ss * (mid + bb / 4 * (cs * (2 * mid * mid - 1) - bb / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))"
SQL["seg_distance_ellipsoid"] = _with(PTS, _WAY) + (
    f"select traj_id, p::int as p, round({_B!r} * ba * (sigma - {_DS}), 3) as dist from (select *, 1 + k2 / 16384 * (4096 + k2 * (-768 + k2 * (320 - 175 * k2))) as ba, k2 / 1024 * (256 + k2 * (-128 + k2 * (74 - 47 * k2))) as bb from ve)"
)
