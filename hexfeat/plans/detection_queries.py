"""Queries on detections, grid cells, gates and incidents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grid, scalar
from ..operators import cells as cell_ops
from ..operators import alerts, clean, fire, gates
from ..operators import reports
from . import fixtures as fx
from .define import num, registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
_D = "with " + fx.DETECTIONS


@query("with " + fx.CLEANED + f" select seq, grid_id, region, {num('latitude', 'longitude', 'frp', 'confidence')} from cleaned")
def clean_detections(spark, d):
    return tidy(clean.clean_detections(fx.detections(spark, d)).select("seq", "grid_id", "region", "latitude", "longitude", "frp", "confidence"))


@query("with " + fx.CLEANED + f" select seq, {num('frp')} from clipped")
def clip_frp(spark, d):
    return tidy(fx.clipped(spark, d).select("seq", "frp"))


@query(_D + """ select count(*) as n_rows, count(*) filter (latitude is null or latitude not between 20 and 50) as bad_latitude, count(*) filter (longitude is null or longitude not between -130 and -85) as bad_longitude,
 count(*) filter (frp < 0) as negative_frp, count(*) filter (latitude is null or latitude not between 20 and 50 or longitude is null or longitude not between -130 and -85 or frp < 0) = 0 as valid from detections""")
def validate_raw(spark, d):
    return clean.validate_raw(fx.detections(spark, d))


@query("with " + fx.CLEANED + f" select grid_id, region, {ts('window_ts')}, active_fire_count, {num('mean_frp', 'median_frp', 'max_confidence')}, fire_detected_binary from fire")
def aggregate_fire(spark, d):
    return tidy(fx.fire_features(spark, d))


@query("with " + fx.HEX + f""" select h.grid_id, h.region, {ts('h.window_ts')}, {num('nearest_fire_distance_km')} from (
 select h.grid_id, h.region, h.window_ts, coalesce(min(greatest(abs(h.q-o.q), abs(h.r-o.r), abs(h.q-o.q+h.r-o.r)))*16.5, -1) as nearest_fire_distance_km
 from hex h left join hex o on h.region = o.region and h.window_ts = o.window_ts and h.grid_id != o.grid_id group by all) h""")
def nearest_fire(spark, d):
    return tidy(fire.nearest_fire(fx.hex_cells(spark, d), ["region", "window_ts"], 22.0).select("grid_id", "region", "window_ts", "nearest_fire_distance_km"))


@query(_D + f" select seq, frp >= 50 as strong from detections where acq_ts >= (select max(acq_ts) from detections) - interval 60 minute and coalesce(frp, 0) >= 10")
def goes_candidates(spark, d):
    rows = fx.detections(spark, d)
    newest = rows.agg(F.max("acq_ts").alias("now"))  # one row
    return clean.in_lookback(rows.crossJoin(F.broadcast(newest)), "acq_ts", F.col("now"), 60, 10.0).select("seq", (F.col("frp") >= 50).alias("strong"))


_NEXT = f"{fx.LEVEL}_"
_AROUND = f"""near as (select h.region, h.window_ts, h.grid_id as source, '{_NEXT}'||(h.q+o.a)||'_'||(h.r+o.b) as grid_id, o.ring from hex h,
 (select a, b, greatest(abs(a),abs(b),abs(a+b)) as ring from range(-1,2) x(a), range(-1,2) y(b) where abs(a+b) <= 1) o)"""


@query("with " + fx.HEX + "," + _AROUND + f" select region, {ts('window_ts')}, source as grid_id, count(*) as n_neighbours from near join (select region, window_ts, grid_id from hex) using (region, window_ts, grid_id) where ring > 0 group by region, near.window_ts, source having count(*) >= 2")
def gate1_spatial(spark, d):
    return tidy(gates.gate1_spatial(fx.hex_cells(spark, d), ["region", "window_ts"], fx.LEVEL).select("region", "window_ts", "grid_id", "n_neighbours"))


@query("with " + fx.HEX + f" select region, {ts('h.window_ts')}, grid_id from hex h where exists (select 1 from hex p where p.region = h.region and p.grid_id = h.grid_id and p.window_ts = h.window_ts - interval 6 hour)")
def gate2_temporal(spark, d):
    cells = fx.hex_cells(spark, d)
    before = cells.withColumn("window_ts", F.col("window_ts") + F.make_dt_interval(hours=F.lit(6)))
    return tidy(gates.gate2_temporal(cells, before, ["region", "window_ts"]).select("region", "window_ts", "grid_id"))


_REF = "ref as (select distinct region, window_ts, q, r, grid_id from hex where frp >= 60)"


@query("with " + fx.HEX + "," + _REF + f""" select region, {ts('h.window_ts')}, grid_id from hex h where not exists (select 1 from ref where ref.region = h.region and ref.window_ts = h.window_ts)
 or exists (select 1 from ref where ref.region = h.region and ref.window_ts = h.window_ts and greatest(abs(ref.q-h.q), abs(ref.r-h.r), abs(ref.q-h.q+ref.r-h.r)) <= 1)""")
def gate3_viirs(spark, d):
    cells = fx.hex_cells(spark, d)
    return tidy(gates.gate3_cross_reference(cells.select("region", "window_ts", "grid_id"), cells, ["region", "window_ts"], fx.LEVEL, min_frp=60.0))


_INDUSTRY = """industrial as (select 32.53::double+(s_suppkey%38)*0.25::double as s_lat, -124.48::double+((s_suppkey*7)%41)*0.25::double as s_lon, case when s_suppkey%20=0 then 30.0 else 2.0 end::double as radius_km from supplier)"""


@query(_D + fx.GRID + "," + _INDUSTRY + """ select grid_id from grid g where not exists (select 1 from industrial i where
 2*6371*asin(sqrt(pow(sin(radians(s_lat-latitude)/2),2)+cos(radians(latitude))*cos(radians(s_lat))*pow(sin(radians(s_lon-longitude)/2),2))) <= radius_km)""", also="gate4_industrial_all")
def gate4_industrial(spark, d):
    return gates.gate4_industrial(fx.cells(spark, d), _sources(spark, d)).select("grid_id")


def _sources(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select((F.lit(32.53) + (k % 38) * F.lit(0.25)).alias("s_lat"), (F.lit(-124.48) + ((k * 7) % 41) * F.lit(0.25)).alias("s_lon"), F.when(k % 20 == 0, 30.0).otherwise(2.0).alias("radius_km"))


_COARSER = 4
_WATCH = fx.DETECTIONS + ", feed as (select region, window_ts, latitude, longitude, frp * 0.25::double as frp, sensor_source = 'view' as polar from detections), placed as (select * from" + fx.SQL_CELL.format("feed").replace(f"/{grid.SIZE[fx.LEVEL]!r}", f"/{grid.SIZE[_COARSER]!r}") + f"""),
hex as (select region, window_ts, polar, q, r, max(frp) as frp, round_even(r*1.5::double*{grid.SIZE[_COARSER]}, 6) as latitude, round_even((q+r/2)*({grid.ROOT3 * grid.SIZE[_COARSER]!r})/{grid.SHRINK!r}, 6) as longitude from placed group by all),
cell as (select * from hex where not polar), ref as (select * from hex where polar and frp >= 1),
industrial as (select 32.53::double+(s_suppkey%38)*0.25::double as s_lat, -124.48::double+((s_suppkey*7)%41)*0.25::double as s_lon, case when s_suppkey%20=0 then 30.0 else 2.0 end::double as radius_km from supplier),
hot as (select distinct c.q, c.r from cell c, industrial where 2*6371*asin(sqrt(pow(sin(radians(s_lat-latitude)/2),2)+cos(radians(latitude))*cos(radians(s_lat))*pow(sin(radians(s_lon-longitude)/2),2))) <= radius_km),
flagged as (select c.*, (select count(*) from cell n where n.region = c.region and n.window_ts = c.window_ts and greatest(abs(n.q-c.q), abs(n.r-c.r), abs(n.q-c.q+n.r-c.r)) = 1) >= 2 as g1,
 exists (select 1 from cell p where p.region = c.region and p.window_ts = c.window_ts - interval 6 hour and p.q = c.q and p.r = c.r) as g2,
 not exists (select 1 from ref f where f.region = c.region and f.window_ts = c.window_ts) or exists (select 1 from ref f where f.region = c.region and f.window_ts = c.window_ts and greatest(abs(f.q-c.q), abs(f.r-c.r), abs(f.q-c.q+f.r-c.r)) <= 1) as g3,
 not exists (select 1 from hot h where h.q = c.q and h.r = c.r) as g4 from cell c),
first as (select region, window_ts, count(*) as n_candidates, count_if(g1) as n_spatial, count_if(g1 and g2) as n_persistent, max(frp) as max_frp from flagged group by all),
timed as (select region, window_ts, coalesce(n_candidates,0) as n_candidates, coalesce(n_spatial,0) as n_spatial, coalesce(n_persistent,0) as n_persistent, coalesce(max_frp,0) as max_frp
 from (select distinct window_ts from detections) cross join (select unnest(['california','texas']) as region) left join first using (region, window_ts)),
marked as (select *, sum(case when max_frp >= 40 then 0 else 1 end) over (partition by region order by window_ts) as island,
 exists (select 1 from first p where p.region = timed.region and p.window_ts = timed.window_ts - interval 6 hour) as has_prior from timed),
counted as (select *, sum(case when max_frp >= 40 then 1 else 0 end) over (partition by region, island order by window_ts) as run from marked),
scans as (select *, coalesce(lag(run) over (partition by region order by window_ts), 0) as consecutive from counted),
second as (select region, window_ts, count(*) as n_referred, count_if(g4) as n_fire from flagged join scans using (region, window_ts) where g1 and (g2 or not (has_prior and n_persistent > 0)) and (g3 or scans.max_frp >= 50) group by all),
verdicts as (select * exclude (n_referred, n_fire), coalesce(n_fire,0) as n_fire, case when n_candidates = 0 then 'no_detections' when n_spatial = 0 then 'G1' when has_prior and n_persistent = 0 and consecutive + 1 < 2 then 'G2_pending' when not has_prior and max_frp < 200 then 'G2_no_prior_scan'
 when coalesce(n_referred,0) = 0 then 'G3' when coalesce(n_fire,0) = 0 then 'G4' end as gate_failed from scans left join second using (region, window_ts))"""


@query("with " + _WATCH + f" select region, {ts('window_ts')}, n_candidates, n_spatial, n_persistent, {num('max_frp')}, gate_failed, gate_failed is null as confirmed, case when gate_failed is null then n_fire else 0 end as n_fire_cells from verdicts")
def gate_evaluator(spark, d):
    return tidy(_evaluated(spark, d)[0])


def _evaluated(spark, d):
    """Scans of every region and window: one feed is watched, the other confirms, the scan six hours before is the one before."""
    keys = ["region", "window_ts"]
    feed = fx.detections(spark, d).withColumn("frp", F.col("frp") * 0.25)
    cells = fx.hexagons(feed.filter("not (sensor_source <=> 'view')"), _COARSER)
    found = cells.groupBy(*keys).agg(F.max("frp").alias("max_frp"))
    later = F.col("window_ts") + F.make_dt_interval(hours=F.lit(6))
    scans = feed.select("window_ts").distinct().select("window_ts", F.explode(F.array(F.lit("california"), F.lit("texas"))).alias("region")).join(found, keys, "left")
    scans = gates.run_lengths(scans, ["region"], "window_ts", F.col("max_frp") >= 40, "run")
    scans = scans.join(found.select("region", later.alias("window_ts"), F.lit(True).alias("has_prior")), keys, "left")
    scans = scans.select(*keys, F.coalesce("has_prior", F.lit(False)).alias("has_prior"), F.coalesce(F.lag("run").over(Window.partitionBy("region").orderBy("window_ts")), F.lit(0)).alias("consecutive"))
    return gates.evaluate(scans, cells, cells.withColumn("window_ts", later), fx.hexagons(feed.filter("sensor_source = 'view'"), _COARSER), _sources(spark, d), keys, _COARSER)


_SCANS = "scans as (select region, window_ts, list(distinct grid_id) as cells, max(frp) as max_frp from hex group by all)"


def _scans(spark, d):
    return fx.hex_cells(spark, d).groupBy("region", "window_ts").agg(F.collect_set("grid_id").alias("cells"), F.max("frp").alias("max_frp"))


@query("with " + fx.HEX + "," + _SCANS + f""", marked as (select *, max_frp >= 100 as holds, sum(case when max_frp >= 100 then 0 else 1 end) over (partition by region order by window_ts) as island from scans)
 select region, {ts('window_ts')}, (sum(case when holds then 1 else 0 end) over (partition by region, island order by window_ts))::int as consecutive from marked""")
def consecutive_scans(spark, d):
    return tidy(gates.run_lengths(_scans(spark, d), ["region"], "window_ts", F.col("max_frp") >= 100, "consecutive").select("region", "window_ts", "consecutive"))


@query("with " + fx.HEX + "," + _SCANS + f""", lagged as (select *, lag(cells) over (partition by region order by window_ts) as before from scans)
 select region, {ts('window_ts')}, len(list_filter(cells, lambda c: not list_contains(coalesce(before, []), c)))::int as n_new from lagged""")
def expanding_cells(spark, d):
    return tidy(gates.expanding_cells(_scans(spark, d), ["region"], "window_ts").select("region", "window_ts", F.size("new_cells").alias("n_new")))


# One step of the recursion is one scan of every region.
_FSM = """lagged as (select *, lag(cells) over (partition by region order by window_ts) as before from scans),
seq as materialized (select region, window_ts, coalesce(max_frp, 0) as frp, len(list_filter(cells, lambda c: not list_contains(coalesce(before, []), c))) > 0 as grown, row_number() over (partition by region order by window_ts) as n from lagged),
fsm as (select distinct region, 0::bigint as n, null::timestamp as window_ts, 'quiet' as mode, 'quiet' as prior, 0 as expanding, 0 as still, 0 as low from seq
 union all select region, n, window_ts, case when ends then prior when starts then 'emergency' else mode end, case when starts then mode else prior end, e, case when ends or starts then 0 else s end, case when ends or starts then 0 else l end from (
  select *, mode = 'emergency' and (s >= 3 or l >= 2) as ends, mode != 'emergency' and frp >= 200 and e >= 2 as starts from (
   select q.region, q.n, q.window_ts, q.frp, f.mode, f.prior, case when f.mode = 'emergency' then f.expanding when q.frp >= 200 and q.grown then f.expanding + 1 else 0 end as e,
    case when f.mode = 'emergency' and not q.grown then f.still + 1 else 0 end as s, case when f.mode = 'emergency' and q.frp < 50 then f.low + 1 else 0 end as l from fsm f join seq q on q.region = f.region and q.n = f.n + 1)))"""


@query("with recursive " + fx.HEX + "," + _SCANS + "," + _FSM + f" select region, {ts('window_ts').replace('as window_ts', 'as scan_ts')}, mode, expanding, still, low from fsm where n > 0")
def emergency_fsm(spark, d):
    scans = _scans(spark, d).withColumnRenamed("window_ts", "scan_ts")
    return tidy(gates.incident_replay(scans, ["region"]))


@query(_D + ", placed as (select * from" + fx.SQL_CELL.format("detections") + f") select seq, '{fx.LEVEL}_'||q||'_'||r as cell from placed")
def cell_of_point(spark, d):
    return fx.detections(spark, d).select("seq", grid.cell_of(F.col("latitude"), F.col("longitude"), fx.LEVEL).alias("cell"))


_CENTRE = f"round_even(r*1.5::double*{grid.SIZE[fx.LEVEL]}, 6) as latitude, round_even((q+r/2)*({grid.ROOT3 * grid.SIZE[fx.LEVEL]!r})/{grid.SHRINK!r}, 6) as longitude"
_COARSE = fx.SQL_CELL.format("centres").replace(f"/{grid.SIZE[fx.LEVEL]!r}", f"/{grid.SIZE[2]!r}").replace("as q,", "as pq,").replace("as r from d", "as pr from d")


@query("with " + fx.HEX + f", centres as (select distinct grid_id, {_CENTRE} from hex), parents as (select * from {_COARSE}) select grid_id, '2_'||pq||'_'||pr as parent from parents")
def cell_parent(spark, d):
    cells = fx.hex_cells(spark, d).select("grid_id", "q", "r").distinct()
    return cells.select("grid_id", grid.parent(F.col("q"), F.col("r"), fx.LEVEL, 2).alias("parent"))


@query("with " + fx.HEX + f""", fires as (select distinct q, r from hex where frp >= 150), o as (select a, b, greatest(abs(a),abs(b),abs(a+b)) as ring from range(-5,6) x(a), range(-5,6) y(b) where abs(a+b) <= 5)
 select grid_id, ring_distance, case when ring_distance = 0 then 'fire' else 'detection_zone' end as cell_type from (select '{_NEXT}'||(q+a)||'_'||(r+b) as grid_id, min(ring)::int as ring_distance from fires, o group by 1)""")
def focal_grid(spark, d):
    return cell_ops.focal_grid(fx.hex_cells(spark, d).filter("frp >= 150"), fx.LEVEL)


_FUEL = f"fuel as (select grid_id, q, r, case when abs(q + r) % 3 = 0 and region = 'california' then 91 when abs(q) % 2 = 0 then 98 else 101 end as fuel from (select distinct grid_id, q, r, region from hex))"


@query("with " + fx.HEX + "," + _FUEL + """ select grid_id from fuel f where not (fuel in (91,92,98,99) and
 not exists (select 1 from fuel n where greatest(abs(n.q-f.q), abs(n.r-f.r), abs(n.q-f.q+n.r-f.r)) <= 1 and n.fuel not in (91,92,98,99)))""")
def prune_cells(spark, d):
    q, r = F.col("q"), F.col("r")
    cells = fx.hex_cells(spark, d).select("grid_id", "q", "r", "region").distinct()
    fuel = cells.select("grid_id", F.when((F.abs(q + r) % 3 == 0) & (F.col("region") == "california"), 91).when(F.abs(q) % 2 == 0, 98).otherwise(101).alias("fuel"))
    return cell_ops.prune_cells(cells.select("grid_id"), fuel, fx.LEVEL)


@query(_D + " select grid_id, seq from detections qualify row_number() over (partition by grid_id order by region, seq) = 1")
def dedup_keep_first(spark, d):
    return cell_ops.keep_first(fx.detections(spark, d), ["grid_id"], ["region", "seq"]).select("grid_id", "seq")


@query(_D + f""" select seq, {num('kmh', 'direction', 'vpd', 'km')} from (select seq, round_even(sqrt(u*u+v*v)*3.6::double, 2) as kmh, round_even(((270-degrees(atan2(v,u)))%360+360)%360, 1) as direction,
  round_even(greatest(0, 0.6108::double*exp(17.27::double*t/(t+237.3::double))*(1-rh/100)), 4) as vpd, 2*6371*asin(sqrt(pow(sin(radians(34.05::double-latitude)/2),2)+cos(radians(latitude))*cos(radians(34.05::double))*pow(sin(radians(-118.24::double-longitude)/2),2))) as km
  from (select seq, latitude, longitude, frp/10-5 as u, (seq%17)-8.0::double as v, frp/20 as t, (seq%101)::double as rh from detections))""")
def scalar_formulas(spark, d):
    s = fx.detections(spark, d)
    u, v = F.col("frp") / 10 - 5, (F.col("seq") % 17) - F.lit(8.0)
    return tidy(s.select("seq", scalar.wind_speed_kmh(u, v).alias("kmh"), scalar.wind_direction(u, v).alias("direction"), scalar.vapour_pressure_deficit(F.col("frp") / 20, (F.col("seq") % 101).cast("double")).alias("vpd"), scalar.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(34.05), F.lit(-118.24)).alias("km")))


@query(_D + """ select seq::varchar as name, case when event = 'error' then 'emergency' when event = 'view' then 'active' else 'quiet' end as mode, case event when 'error' then 0 when 'view' then 1 else 99 end::int as priority
 from (select seq, sensor_source as event from detections) order by priority, name limit 1""", also="trigger_priority_all")
def trigger_priority(spark, d):
    rows = fx.detections(spark, d).select(F.col("seq").cast("string").alias("name"), F.when(F.col("sensor_source") == "error", "emergency").when(F.col("sensor_source") == "view", "active").otherwise("quiet").alias("mode"))
    return reports.next_trigger(rows)


_POLLS = """polls as (select region, window_ts, case when max_frp >= 150 then 'emergency' when month(window_ts) between 6 and 11 then 'active' else 'quiet' end as mode, max_frp >= 150 as confirmed, max_frp < 60 as false_alarm from scans),
 ends as (select *, last_value(case when false_alarm then window_ts end ignore nulls) over w + interval 12 hour as e, last_value(case when false_alarm then mode end ignore nulls) over w as prior from polls window w as (partition by region order by window_ts rows unbounded preceding)),
 nth as (select *, coalesce(window_ts >= e, false) as over_, count_if(coalesce(window_ts >= e, false)) over (partition by region, e order by window_ts rows unbounded preceding) as n from ends)"""


@query("with " + fx.HEX + "," + _SCANS + "," + _POLLS + f" select region, {ts('window_ts')}, case when over_ and n = 1 then prior else mode end as mode, over_ and n = 1 as reverted, case when n = 0 then strftime(e, '%Y-%m-%d %H:%M:%S') end as revert_at from nth")
def false_alarm_revert(spark, d):
    top = F.col("max_frp")
    mode = alerts.seasonal_mode(F.when(top >= 150, "emergency"), F.col("window_ts"))
    polls = _scans(spark, d).select("region", "window_ts", mode.alias("mode"), (top >= 150).alias("confirmed"), (top < 60).alias("false_alarm"))
    return tidy(alerts.revert_timer(polls, ["region"], "window_ts", 720).select("region", "window_ts", "mode", "reverted", "revert_at"))


@query(_D + """, runs as (select seq, grid_id, sensor_source in ('error','view') as failed, sum(case when sensor_source in ('error','view') then 0 else 1 end) over (partition by grid_id order by seq) as island from detections),
 counted as (select *, (sum(failed::int) over (partition by grid_id, island order by seq))::int as consecutive from runs) select grid_id, seq, consecutive, case when consecutive >= 3 then 'breach' else 'failed' end as level from counted where failed""")
def failure_escalation(spark, d):
    runs = fx.detections(spark, d).select("grid_id", "seq", "sensor_source")
    return alerts.escalations(runs, ["grid_id"], "seq", F.col("sensor_source").isin("error", "view")).select("grid_id", "seq", "consecutive", "level")
