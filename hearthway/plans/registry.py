"""Registered queries with the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthway.functions.hexes import ROOT3
from hearthway.plans.views import CELL_SIZE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def number(value: float) -> str:
    """A literal that SQL reads as the same double."""
    return f"{value:.17e}"


VIEWS = {
    "v_points": """
select c_custkey as source_id, cast((c_custkey * 7919) % 100003 as double) as x,
 cast((c_custkey * 104729) % 100019 as double) as y from customer""",
    "v_trips": """
select source_id, service, duration_min, wait_time_dest_min, duration_min + wait_time_dest_min as total_time_min,
 "walkDistance", abs_dist, transfers, walk_duration from (
 select o_custkey as source_id,
  case o_orderpriority when '1-URGENT' then 'doctor' when '2-HIGH' then 'school' when '3-MEDIUM' then 'supermarket'
   when '4-NOT SPECIFIED' then 'library' else 'train_station' end as service,
  case when o_orderkey % 17 = 0 then null else floor(o_totalprice / 250) / 8 end as duration_min,
  case when o_orderkey % 17 = 0 then null else cast((o_orderkey * 11) % 90 as double) end as wait_time_dest_min,
  cast((o_orderkey * 13) % 3000 as double) as "walkDistance", cast((o_orderkey * 29) % 20000 as double) as abs_dist,
  o_orderkey % 4 as transfers, ((o_orderkey * 13) % 3000) / 8 as walk_duration,
  row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as rn from orders) t where rn = 1""",
    "v_zones": """
select n_nationkey as zone_id, n_name as zone_name,
 cast((n_nationkey % 5) * 20004 + 100 as double) as minx, cast((n_nationkey % 5 + 1) * 20004 - 100 as double) as maxx,
 cast(floor(n_nationkey / 5) * 20004 + 100 as double) as miny,
 cast((floor(n_nationkey / 5) + 1) * 20004 - 100 as double) as maxy from nation""",
    "v_islands": """
select r_regionkey as island_id, cast(r_regionkey * 21000 + 2000 as double) as minx,
 cast(r_regionkey * 21000 + 6000 as double) as maxx, cast(r_regionkey * 17000 + 1000 as double) as miny,
 cast(r_regionkey * 17000 + 5000 as double) as maxy from region""",
    "v_diamonds": """
select n_nationkey as diamond_id, (n_nationkey % 5) * 20004 + 10002 as mx, floor(n_nationkey / 5) * 20004 + 10002 as my,
 n_nationkey * 150 + 9000 as outer_radius, n_nationkey * 50 + 2000 as inner_radius from nation""",
    "v_diamond_points": """
select *, round(case when span > outer_radius then case when abs(dx - dy) <= outer_radius then (span - outer_radius) / sqrt(2.0)
  else sqrt((greatest(dx, dy) - outer_radius) * (greatest(dx, dy) - outer_radius) + least(dx, dy) * least(dx, dy)) end
  when span < inner_radius then (inner_radius - span) / sqrt(2.0) else 0 end, 6) as distance from (
 select source_id, diamond_id, outer_radius, inner_radius, abs(x - mx) as dx, abs(y - my) as dy, abs(x - mx) + abs(y - my) as span
 from v_points, v_diamonds) s""",
    "v_census": """
select c_nationkey as zone_id, count(*) as households,
 count(*) filter (where c_mktsegment = 'AUTOMOBILE') as households_with_1_car,
 count(*) filter (where c_mktsegment = 'MACHINERY') as households_with_2_cars,
 count(*) filter (where c_mktsegment not in ('AUTOMOBILE', 'MACHINERY')) as households_without_car,
 count(*) filter (where c_acctbal < 0) as income_low,
 count(*) filter (where c_acctbal >= 0 and c_acctbal < 5000) as income_mid,
 count(*) filter (where c_acctbal >= 5000) as income_high from customer group by c_nationkey""",
    "v_modes": """
select l_orderkey, cast(sum(case when l_returnflag = 'A' then l_quantity else 0 end) as bigint) as walk,
 cast(sum(case when l_returnflag = 'N' then l_quantity else 0 end) as bigint) as bus,
 cast(sum(case when l_returnflag = 'R' then l_quantity else 0 end) as bigint) as rail from lineitem group by l_orderkey""",
    "v_hex": f"""
select source_id, x, y, q, r, concat(q, '_', r) as grid_id from (
 select source_id, x, y,
  cast(case when dq > dr and dq > ds then -rr - rs else rq end as bigint) as q,
  cast(case when dq > dr and dq > ds then rr when dr > ds then -rq - rs else rr end as bigint) as r from (
  select *, abs(rq - fq) as dq, abs(rr - fr) as dr, abs(rs - fs) as ds from (
   select *, floor(fq + 0.5) as rq, floor(fr + 0.5) as rr, floor(fs + 0.5) as rs from (
    select *, -fq - fr as fs from (
     select source_id, x, y, (x * {number(ROOT3 / 3)} - y / 3) / {CELL_SIZE} as fq,
      (y * {number(2 / 3)}) / {CELL_SIZE} as fr from v_points) a) b) c) d) e""",
    "v_cells": f"""
select grid_id, q, r, (q + r / 2) * {number(ROOT3 * CELL_SIZE)} as x, r * {number(1.5 * CELL_SIZE)} as y
 from (select distinct grid_id, q, r from v_hex) h""",
    "v_edges": """
select a.grid_id as i, b.grid_id as j from v_cells a join v_cells b
 on (b.q - a.q, b.r - a.r) in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))""",
    "v_totals": """
select source_id, sum(duration_min) as total_duration, sum(wait_time_dest_min) as total_wait_time,
 sum(duration_min) + sum(wait_time_dest_min) as total_time_min from v_trips group by source_id""",
    "v_hex_totals": """
select grid_id, avg(total_duration) as avg_total_duration, avg(total_wait_time) as avg_total_wait_time,
 avg(total_time_min) as avg_total_time from v_totals join v_hex using (source_id) group by grid_id""",
    "v_pairs": """
select source_id, zone_id, case when x between minx and maxx and y between miny and maxy then 0.0 else
 sqrt(greatest(minx - x, 0, x - maxx) * greatest(minx - x, 0, x - maxx)
  + greatest(miny - y, 0, y - maxy) * greatest(miny - y, 0, y - maxy)) end as distance
 from v_points, v_zones""",
    "v_assigned": """
select source_id, arg_min(zone_id, (distance, zone_id)) filter (where distance <= 300) as zone_id
 from v_pairs group by source_id""",
}


def with_views(body: str) -> str:
    """Prefix the views a statement uses, directly or through other views."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(VIEWS[name])

    visit(body)
    ctes = [f"{name} as ({sql})" for name, sql in VIEWS.items() if name in used]
    if not ctes:
        return body
    for start in ("with recursive ", "with "):
        if body.lstrip().startswith(start):
            return f"{start}{', '.join(ctes)}, {body.lstrip().removeprefix(start)}"
    return f"with {', '.join(ctes)} {body}"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return function

    return register
