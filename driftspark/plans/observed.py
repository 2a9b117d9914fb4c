"""Queries over observed states: statistics, selections, properties, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark import enums, functions as fn
from driftspark.operators import events, spatial, stats
from driftspark.plans.registry import AGED, OBS, T0, bin_sql, query, r6, random_sql, s6
from driftspark.sources import aged, observations

X, Y, Z = ("x", 0, 50, 8), ("y", 0, 20, 5), ("z", -10, 1, 10)
STATUSES = [enums.MOVING, enums.ON_BOTTOM]
UPDATE, DAY = 7200, 86400
NT_SQL, NA_SQL = bin_sql("t", T0, UPDATE), bin_sql("age", 0, DAY)
IN_XY = "x >= 0 and x < 400 and y >= 0 and y < 100"
MEASURES = "count(*) as n"
POLYGONS = [[(20, 5), (180, 10), (200, 60), (90, 80), (30, 50)], [(150, 30), (330, 30), (330, 90), (150, 90)], [(340, 10), (480, 10), (410, 95)]]
EDGES_SQL = "(values " + ", ".join(
    f"({i}, {float(a)}, {float(b)}, {float(p)}, {float(q)})" for i, ring in enumerate(POLYGONS) for (a, b), (p, q) in zip(ring, ring[1:] + ring[:1])
) + ") as e(poly, x1, y1, x2, y2)"
HITS = f"""select event_id, poly from {OBS} o join {EDGES_SQL} on y > least(y1, y2) and y <= greatest(y1, y2) and x <= greatest(x1, x2)
  and (x1 = x2 or x <= x1 + (y - y1) * (x2 - x1) / nullif(y2 - y1, 0)) group by event_id, poly having count(*) % 2 = 1"""
WITH_POLY = f"(select a.*, coalesce(h.poly, -1) as poly from {AGED} a left join (select event_id, max(poly) as poly from ({HITS}) group by 1) h on a.event_id = h.event_id)"


def nt():
    return fn.bin_of("t", T0, UPDATE).alias("nt")


def na():
    return fn.bin_of("age", 0, DAY).alias("na")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return observations(spark, sf)


def with_polygon(spark: SparkSession, sf: str) -> DataFrame:
    rows = aged(obs(spark, sf))
    return spatial.polygon_of(rows, spatial.polygon_edges(spark, POLYGONS), "event_id", 20.0)


@query(f"select {NT_SQL} as nt, grp, {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, {MEASURES} from {OBS} where status in (10, 6) and {IN_XY} group by all")
def grid2d_time(spark, sf):
    return stats.gridded(obs(spark, sf), [nt(), "grp"], X, Y, where=fn.has_status(STATUSES))


@query(f"""select {NT_SQL} as nt, grp, {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, {MEASURES}, {s6('sum(z)')} as sum_z,
  {s6('sum(z) / count(z)')} as mean_z from {OBS} where status in (10, 6) and {IN_XY} group by all""")
def grid2d_time_mean(spark, sf):
    return stats.gridded(obs(spark, sf), [nt(), "grp"], X, Y, props=["z"], where=fn.has_status(STATUSES)).withColumn("mean_z", r6(F.col("mean_z"))).withColumn("sum_z", r6(F.col("sum_z")))


@query(f"""with u as (select {NT_SQL} as nu, grp from {OBS} where status = 10), s as (select ceil(min(nu) / 3.0) as a, floor((max(nu) + 1) / 3.0) - 1 as b from u)
  select cast(floor(nu / 3.0) as bigint) as blk, grp, {s6('count(*) / 3.0')} as m from u, s where floor(nu / 3.0) between a and b group by all""")
def grid2d_running_mean(spark, sf):
    return stats.running_mean(obs(spark, sf).where("status = 10"), T0, UPDATE, 3, "grp").withColumn("m", r6(F.col("m")))


@query(f"select {NA_SQL} as na, grp, {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, {MEASURES} from {AGED} where status in (10, 6) and age < 864000 and {IN_XY} group by all")
def grid2d_age(spark, sf):
    return stats.gridded(aged(obs(spark, sf)), [na(), "grp"], X, Y, where=fn.has_status(STATUSES) & fn.within("age", 0, 10 * DAY))


@query(f"""select {NT_SQL} as nt, grp, {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, {bin_sql('z', -10, 1)} as k, {MEASURES} from {OBS}
  where status in (10, 6) and {IN_XY} and z >= -10 and z < 0 group by all""")
def grid3d_time(spark, sf):
    return stats.gridded(obs(spark, sf), [nt(), "grp"], X, Y, Z, where=fn.has_status(STATUSES))


@query(f"select {NT_SQL} as nt, grp, cast(poly as bigint) as poly, {MEASURES} from {WITH_POLY} where status in (10, 6) and poly >= 0 group by all")
def poly_time(spark, sf):
    return with_polygon(spark, sf).where(fn.has_status(STATUSES) & (F.col("poly") >= 0)).groupBy(nt(), "grp", "poly").agg(F.count("*").alias("n"))


@query(f"select {NA_SQL} as na, grp, cast(poly as bigint) as poly, {MEASURES} from {WITH_POLY} where status in (10, 6) and poly >= 0 and age < 864000 group by all")
def poly_age(spark, sf):
    rows = with_polygon(spark, sf).where(fn.has_status(STATUSES) & (F.col("poly") >= 0) & fn.within("age", 0, 10 * DAY))
    return rows.groupBy(na(), "grp", "poly").agg(F.count("*").alias("n"))


@query(f"select {NT_SQL} as nt, grp, count(*) as n_alive from {OBS} where status >= -1 group by all")
def alive_by_time(spark, sf):
    return stats.alive_by(obs(spark, sf), nt(), "grp")


@query(f"select {NA_SQL} as na, grp, count(*) as n_alive from {AGED} where status >= -1 group by all")
def alive_by_age(spark, sf):
    return stats.alive_by(aged(obs(spark, sf)), na(), "grp")


@query(f"""with al as (select {NA_SQL} as na, grp, count(*) as n_alive from {AGED} where status >= -1 and age < 864000 group by all),
  b as (select {NA_SQL} as na, grp, {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, count(*) as n from {AGED} where status in (10, 6) and age < 864000 and {IN_XY} group by all)
  select na, grp, c, r, n, n_alive, {s6('n / n_alive')} as conn from b join al using (na, grp)""")
def connectivity(spark, sf):
    rows = aged(obs(spark, sf)).where(fn.within("age", 0, 10 * DAY))
    counts = stats.gridded(rows, [na(), "grp"], X, Y, where=fn.has_status(STATUSES))
    return stats.connectivity(counts, stats.alive_by(rows, na(), "grp"), ["na", "grp"]).withColumn("conn", r6(F.col("conn")))


@query(f"""with f as (select id, grp, min(t) as t0 from {OBS} group by all), c as (select grp, {bin_sql('t0', 0, DAY)} as nt, count(*) as n from f group by all)
  select grp, nt, cast(sum(n) over (partition by grp order by nt) as bigint) as released from c""")
def released_cumulative(spark, sf):
    return stats.released_so_far(obs(spark, sf), DAY)


@query(f"""with m as (select grp, (min(x) + max(x)) / 2.0 as mx, (min(y) + max(y)) / 2.0 as my from {OBS} group by 1)
  select grp, {bin_sql('x - mx', -200, 50)} as c, {bin_sql('y - my', -40, 20)} as r, count(*) as n from {OBS} join m using (grp)
  where x - mx >= -200 and x - mx < 200 and y - my >= -40 and y - my < 40 group by all""")
def group_centered_grid(spark, sf):
    return stats.gridded(stats.centred(obs(spark, sf), "grp", "x", "y"), ["grp"], ("dx", -200, 50, 8), ("dy", -40, 20, 4))


@query("select status, count(*) as n from " + OBS + " group by 1")
def status_histogram(spark, sf):
    return obs(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


INS = f"(select *, case when x >= 20 and x < 60 then 1 else 0 end as ins from {OBS})"
PREV = f"(select *, coalesce(lag(ins) over (partition by id order by t, event_id), 0) as before from {INS})"


@query(f"""with v as (select *, sum(case when ins = 1 and before = 0 then 1 else 0 end) over (partition by id order by t, event_id rows unbounded preceding) as visit from {PREV})
  select grp, count(*) as n, cast(sum(ins) as bigint) as exposure, cast(sum(case when ins = 1 and visit = 1 then 1 else 0 end) as bigint) as residence from v group by grp""")
def residence_exposure(spark, sf):
    return events.residence(obs(spark, sf), fn.within("x", 20, 60), "grp")


@query(f"select id, t, event_id, cast(case when ins = 1 then 1 else -1 end as bigint) as flag from {PREV} where ins <> before")
def event_edges(spark, sf):
    return events.edges(obs(spark, sf), fn.within("x", 20, 60)).select("id", "t", "event_id", "flag")


POLY_CASE = "cast(case when x >= 20 and x < 60 then 0 when x >= 100 and x < 160 then 1 else -1 end as bigint)"


@query(f"""with p as (select *, {POLY_CASE} as poly from {OBS}), l as (select *, coalesce(lag(poly) over w, -1) as before from p window w as (partition by id order by t, event_id)),
  e as (select *, last_value(case when poly >= 0 and before < 0 then poly end ignore nulls) over (partition by id order by t, event_id rows unbounded preceding) as event_poly from l)
  select id, t, event_id, event_poly, cast(case when poly >= 0 then 1 else -1 end as bigint) as flag from e where (poly >= 0) <> (before >= 0)""")
def poly_entry_exit(spark, sf):
    poly = F.when(fn.within("x", 20, 60), 0).when(fn.within("x", 100, 160), 1).otherwise(-1).cast("long")
    return events.entry_exit(obs(spark, sf), poly).select("id", "t", "event_id", "event_poly", "flag")


@query(f"select event_id, cast(poly as bigint) as poly from ({HITS})")
def pip_parity(spark, sf):
    return spatial.inside(obs(spark, sf), spatial.polygon_edges(spark, POLYGONS), "event_id", 20.0)


@query(f"select event_id, cast(poly as bigint) as poly from {WITH_POLY}")
def inside_polygon(spark, sf):
    return with_polygon(spark, sf).select("event_id", "poly")


@query(f"select event_id, id, t from {OBS} where status in (10, 6)")
def status_filter(spark, sf):
    return obs(spark, sf).where(fn.has_status(STATUSES)).select("event_id", "id", "t")


@query(f"select event_id, z from {OBS} where z >= -8 and z < -2 and (z <= -(x / 40.0) + 1 or z >= -y / 50.0 - 3)")
def depth_select(spark, sf):
    near = fn.near_seabed("z", F.col("x") / 40.0, 1.0) | fn.near_surface("z", -F.col("y") / 50.0, 3.0)
    return obs(spark, sf).where(fn.within("z", -8, -2) & near).select("event_id", "z")


@query(f"select event_id, x, t from {OBS} where x between 100 and 250 and t between {T0} and {T0 + 20 * DAY}")
def range_select(spark, sf):
    return obs(spark, sf).where(fn.between("x", 100, 250) & fn.between("t", T0, T0 + 20 * DAY)).select("event_id", "x", "t")


@query(f"select event_id, age from {AGED}")
def age(spark, sf):
    return aged(obs(spark, sf)).select("event_id", "age")


@query(f"select event_id, {s6('1000.0 * exp(-abs(age) / 7200.0)')} as val from {AGED}")
def age_decay(spark, sf):
    return aged(obs(spark, sf)).select("event_id", r6(fn.decay("age", 1000.0, 7200.0)).alias("val"))


@query(f"""with s as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as step from {OBS} window w as (partition by id order by t, event_id))
  select event_id, floor((sum(step) over (partition by id order by t, event_id rows unbounded preceding)) * 1e4 + 0.5) / 1e4 as distance from s""")
def distance_travelled(spark, sf):
    rows = events.distance(obs(spark, sf))
    return rows.select("event_id", (F.floor(F.col("distance") * 1e4 + 0.5) / 1e4).alias("distance"))


FRAC = "case when abs(y / 50.0 + x / 40.0) < 0.25 then 0.0 else (x / 40.0 + z) / greatest(abs(y / 50.0 + x / 40.0), 0.25) end"


@query(f"select event_id, {s6(FRAC)} as frac from {OBS}")
def frac_depth(spark, sf):
    return obs(spark, sf).select("event_id", r6(fn.fractional_depth("z", F.col("y") / 50.0, F.col("x") / 40.0)).alias("frac"))


@query(f"select event_id, {s6('abs(y / 50.0 + x / 40.0)')} as depth, {s6('greatest(y / 50.0 - x / 40.0, 0.25)')} as field from {OBS}")
def total_depth(spark, sf):
    clipped = fn.total_depth_field(F.col("y") / 50.0, -F.col("x") / 40.0)
    return obs(spark, sf).select("event_id", r6(fn.total_depth(F.col("y") / 50.0, F.col("x") / 40.0)).alias("depth"), r6(clipped).alias("field"))


@query(f"select event_id, {s6('sqrt(x * x + y * y)')} as speed from {OBS}")
def speed(spark, sf):
    return obs(spark, sf).select("event_id", r6(fn.speed("x", "y")).alias("speed"))


@query(f"select event_id, {s6('0.002 / nullif(0.4 * sqrt(sqrt(z * z + y * y) / 1025.0), 0)')} as rouse from {OBS}")
def rouse(spark, sf):
    return obs(spark, sf).select("event_id", r6(fn.rouse(F.lit(0.002), fn.stress_velocity("z", "y"))).alias("rouse"))


@query(f"""with d as (select *, case when lag(status) over w = 10 then t - lag(t) over w else 0 end as dt from {OBS} window w as (partition by id order by t, event_id))
  select event_id, cast(sum(dt) over (partition by id order by t, event_id rows unbounded preceding) as bigint) as time_at from d""")
def time_at_status(spark, sf):
    return events.time_at_status(obs(spark, sf), enums.MOVING).select("event_id", "time_at")


DAYS = f"(select id, {bin_sql('t', T0, DAY)} as nt, max_by(x, t * 100000000 + event_id) as x, max_by(status, t * 100000000 + event_id) as status from {OBS} group by all)"


def daily(spark, sf):
    at = F.col("t") * 100_000_000 + F.col("event_id")
    return obs(spark, sf).groupBy("id", fn.bin_of("t", T0, DAY).alias("nt")).agg(F.max_by("x", at).alias("x"), F.max_by("status", at).alias("status"))


@query(f"""with s as (select * from {DAYS}), span as (select id, min(nt) as a, max(nt) as b from s group by 1), z as (select max(nt) as z from s),
  d as (select id, b, unnest(generate_series(a, z)) as nt from span, z)
  select d.id, d.nt, last_value(s.x ignore nulls) over w as x,
    cast(case when d.nt > b then -5 else last_value(s.status ignore nulls) over w end as bigint) as status
  from d left join s on d.id = s.id and d.nt = s.nt window w as (partition by d.id order by d.nt rows unbounded preceding)""")
def ffill_dead(spark, sf):
    state = daily(spark, sf)
    return events.fill_forward(state, state.select("nt"), ["x"])


@query(f"select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from {OBS}")
def stats_limits(spark, sf):
    return stats.limits(obs(spark, sf), "x", "y")


@query(f"select {bin_sql('x', 0, 50)} as c, {bin_sql('y', 0, 20)} as r, nullif(count_if(status = 10), 0) as n from {OBS} where grp = 1 and {IN_XY} group by all")
def heatmap_slice(spark, sf):
    rows = obs(spark, sf).where("grp = 1").withColumn("hit", (F.col("status") == 10).cast("int"))
    cells = stats.gridded(rows, [], X, Y, props=["hit"])
    return cells.select("c", "r", F.nullif(F.col("sum_hit").cast("long"), F.lit(0).cast("long")).alias("n"))


@query(f"""with d as (select * from {DAYS}), p as (select id, row_number() over (order by id) - 1 as place from (select distinct id from d)), n as (select unnest(generate_series(min(nt), max(nt))) as nt from d),
  r as (select n.nt, list(d.x order by place) as x, list(coalesce(d.status, -10) order by place) as status from n, p left join d on d.id = p.id and d.nt = n.nt group by n.nt)
  select nt, len(x) as particles, len(list_filter(x, lambda v: v is not null)) as present, {s6('list_sum(list_transform(range(len(x)), lambda i: coalesce(x[i + 1], 0) * (i % 97 + 1)))')} as checksum, cast(list_sum(status) as bigint) as statuses from r""")
def tracks_pivot(spark, sf):
    """The rectangular form: a row for each step with the particles as places, null where one is absent; read through a sum over places."""
    from driftspark.sources import rectangular

    wide = rectangular(daily(spark, sf), ["x", "status"], {"status": enums.NOT_RELEASED})
    of_block = F.aggregate(F.zip_with("x", F.sequence(F.lit(0), F.size("x") - 1), lambda x, i: F.coalesce(x, F.lit(0.0)) * ((F.col("first") + i) % 97 + 1)), F.lit(0.0), lambda a, x: a + x)
    parts = wide.select(
        "nt", "first", F.size("x").cast("long").alias("particles"), F.size(F.filter("x", lambda v: v.isNotNull())).cast("long").alias("present"),
        of_block.alias("checksum"), F.aggregate("status", F.lit(0).cast("long"), lambda a, x: a + x).alias("statuses"),
    )
    # a step has a row for each block of particles
    sums = F.transform(F.sort_array(F.collect_list(F.struct("first", "checksum"))), lambda b: b["checksum"])
    steps = parts.groupBy("nt").agg(*[F.sum(c).alias(c) for c in ("particles", "present", "statuses")], F.aggregate(sums, F.lit(0.0), lambda a, x: a + x).alias("checksum"))
    return steps.select("nt", "particles", "present", r6(F.col("checksum")).alias("checksum"), "statuses")


@query(f"select event_id, cast(case when abs(age) > 864000 then -5 else status end as bigint) as status from {AGED}")
def max_age_kill(spark, sf):
    from driftspark.operators.dynamics import aged_out

    return aged(obs(spark, sf)).select("event_id", aged_out("status", "age", F.lit(10 * DAY)).alias("status"))


@query(f"select event_id, cast(case when status >= 0 and y * 3 > 128 then 3 when status = 3 and y * 3 <= 128 then 10 else status end as bigint) as status from {OBS}")
def tidal_stranding(spark, sf):
    from driftspark.operators.dynamics import stranded

    return obs(spark, sf).select("event_id", stranded("status", F.col("y") * 3).alias("status"))


@query(f"select event_id, cast(case when status = 10 and x >= 20 and x < 60 then 0 when status = 0 and age >= 86400 then 10 else status end as bigint) as status from {AGED}")
def settle_state(spark, sf):
    from driftspark.operators.dynamics import settled

    return aged(obs(spark, sf)).select("event_id", settled("status", fn.within("x", 20, 60), F.lit(True), "age", DAY).alias("status"))


SEARCH = "case y % 5 when 0 then 0 when 1 then -1 when 2 then -2 when 3 then -3 else -30 end"


@query(f"select event_id, y % 5 in (1, 3, 4) as back, cast(case when y % 5 = 2 then -1 else status end as bigint) as status from {OBS}")
def boundary_response(spark, sf):
    from driftspark.operators import dynamics

    back, status = dynamics.boundary_response(F.expr(SEARCH), "status", True)
    return obs(spark, sf).select("event_id", back.alias("back"), status.alias("status"))


@query(f"""with f as (select id, min(t) as t0 from {OBS} group by 1), r as (select t0, count(*) as n from f group by 1),
  c as (select t0 as t, n as d from r union all select t0 + 864000, -n from r), s as (select t, sum(d) as d from c group by 1)
  select t, cast(sum(d) over (order by t) as bigint) as alive from s""")
def forecast_alive(spark, sf):
    from driftspark.operators.release import forecast_alive as forecast

    first = obs(spark, sf).groupBy("id").agg(F.min("t").alias("t0")).groupBy("t0").agg(F.count("*").alias("n"))
    return forecast(first.withColumn("max_age", F.lit(10 * DAY)))


@query("""with o as (select o_custkey, epoch(o_orderdate) as t, lag(epoch(o_orderdate)) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders)
  select o_custkey, t, case when t - p < 8640 then 'repeat' when t - p > 259200 then 'gap' end as kind from o where t - p < 8640 or t - p > 259200""")
def gap_check(spark, sf):
    from driftspark.sources import gaps, table

    t = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    return gaps(table(spark, sf, "orders").select("o_custkey", t.alias("t")), "o_custkey", "t", DAY)


@query("select epoch(d) as time_sec, row_number() over (order by d) - 1 as nt from (select distinct o_orderdate as d from orders)")
def time_sort(spark, sf):
    from driftspark.sources import table, time_steps

    t = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    steps = time_steps(table(spark, sf, "orders").select(t.alias("time_sec")))
    return steps.select("time_sec", F.col("nt").cast("long").alias("nt"))


@query("""select l_orderkey, l_linenumber, l_extendedprice, cast(round((least(greatest(l_extendedprice, 1000.0), 60000.0) - 1000.0) / 59000.0 * 65534.0 - 32767.0) as smallint) as q from lineitem""")
def quantize_int16(spark, sf):
    from driftspark.sources import table

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", fn.quantize("l_extendedprice", 1000.0, 60000.0).alias("q"))


@query(f"select event_id, cast(floor(255 * ((1 - y / 100.0) * 1 + y / 100.0 * 0)) as integer) as dry from {OBS}")
def dry_index(spark, sf):
    return obs(spark, sf).select("event_id", fn.dry_index(F.lit(1), F.lit(0), F.col("y") / 100.0).alias("dry"))


@query(f"select event_id, id from {OBS} where {random_sql(7, 'id')} < 0.25")
def random_sample(spark, sf):
    """A share of the particles, chosen by a hash of their id."""
    return obs(spark, sf).where(fn.uniform(7, "id") < 0.25).select("event_id", "id")
