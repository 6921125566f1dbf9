"""Streaming operators over the whole history of the tables, held against the SQL of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import gates, records
from ..streaming import baselines, watch
from ..streaming.replay import replay
from . import detection_queries as dq
from . import fixtures as fx
from . import quality_queries as qq
from .define import registrar, tidy, ts

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)
_KEYS = ["region", "window_ts"]


def watched_scans(spark, d):
    """A scan of each region and window: the cells of one feed, those of the other as reference, and the cells near industry."""
    feed = fx.detections(spark, d).withColumn("frp", F.col("frp") * 0.25)
    cells = fx.hexagons(feed.filter("not (sensor_source <=> 'view')"), dq._COARSER)
    reference = fx.hexagons(feed.filter("sensor_source = 'view'"), dq._COARSER).filter("frp >= 1").groupBy(*_KEYS).agg(F.collect_set("grid_id").alias("reference"))
    lat, lon = dq.grid.centroid(F.col("q"), F.col("r"), dq._COARSER)
    places = cells.select("grid_id", lat.alias("latitude"), lon.alias("longitude")).distinct()
    cold = gates.gate4_industrial(places, dq._sources(spark, d)).select("grid_id", F.lit(True).alias("cold"))
    found = cells.join(cold, "grid_id", "left").groupBy(*_KEYS).agg(F.collect_set("grid_id").alias("cells"), F.max("frp").alias("max_frp"), F.collect_set(F.when(F.col("cold").isNull(), F.col("grid_id"))).alias("hot"))
    scans = feed.select("window_ts").distinct().select("window_ts", F.explode(F.array(F.lit("california"), F.lit("texas"))).alias("region"))
    whole = scans.join(found, _KEYS, "left").join(reference, _KEYS, "left")
    return whole.select("region", F.col("window_ts").cast("timestamp").alias("scan_ts"), "cells", "max_frp", "reference", "hot")


@query(dq.ORACLES["gate_evaluator"])
def watch_gates(spark, d):
    """The four gates in the stream: the scan before is state, not a join."""
    rules = watch.Rules(seasonal=False, gap_hours=6, fire_frp=40.0)
    told = replay(watched_scans(spark, d), "scan_ts", lambda rows: watch.watch(rows, rules)).filter("kind = 'scan'")
    return tidy(told.select("region", F.col("at").cast("timestamp_ntz").alias("window_ts"), "n_candidates", "n_spatial", "n_persistent", "max_frp", "gate_failed", "confirmed", F.size("fire_cells").alias("n_fire_cells")))


@query(dq.ORACLES["emergency_fsm"])
def watch_incidents(spark, d):
    """The incident state machine in the stream."""
    scans = dq._scans(spark, d).select("region", F.col("window_ts").cast("timestamp").alias("scan_ts"), "cells", "max_frp")
    told = replay(scans, "scan_ts", watch.incidents)
    return tidy(told.withColumn("scan_ts", F.col("scan_ts").cast("timestamp_ntz")))


_FIRED = """fired as (select f.region, f.window_ts, list(distinct '4_'||q||'_'||r order by '4_'||q||'_'||r) as cells, any_value(v.max_frp) as max_frp from flagged f join verdicts v using (region, window_ts)
 where gate_failed is null and g1 and (g2 or not (has_prior and n_persistent > 0)) and (g3 or v.max_frp >= 50) and g4 group by 1, 2)"""
_TOLD = """told as (select *, lag(mode, 1, 'quiet') over (partition by region order by window_ts) as was from fsm where n > 0)"""


@query("with recursive " + dq._WATCH.strip() + "," + _FIRED + "," + dq._FSM.replace("from scans", "from fired") + "," + _TOLD + """
 select kind, substr(sha256(kind||'|'||region||'|'||strftime(window_ts, '%Y-%m-%d %H:%M:%S')||case when kind = 'emergency' then '|'||detail else '' end), 1, 32) as id, region, strftime(window_ts, '%Y-%m-%d %H:%M:%S') as at, detail, n_cells from (
  select 'trigger' as kind, t.region, t.window_ts, mode as detail, len(cells)::int as n_cells from told t join fired using (region, window_ts)
  union all select 'false_alarm', region, window_ts, gate_failed, n_candidates::int from verdicts where gate_failed is not null and n_candidates > 0
  union all select 'emergency', t.region, t.window_ts, case mode when 'emergency' then 'activated' else 'deactivated' end, len(cells)::int from told t join fired using (region, window_ts) where (mode = 'emergency') != (was = 'emergency'))""")
def watch_records(spark, d):
    """Triggers, false alarms and emergencies that follow from the stream."""
    rules = watch.Rules(seasonal=False, gap_hours=6, fire_frp=40.0, revert_minutes=None)
    told = replay(watched_scans(spark, d), "scan_ts", lambda rows: watch.watch(rows, rules))
    size = lambda c: F.size(c).cast("int").alias("n_cells")
    parts = [
        records.trigger_records(told).select(F.lit("trigger").alias("kind"), F.col("trigger_id").alias("id"), F.col("regions")[0].alias("region"), F.col("triggered_at").alias("at"), F.col("mode").alias("detail"), size("fire_cells")),
        records.false_alarm_records(told).select(F.lit("false_alarm").alias("kind"), "id", "region", F.col("recorded_at").alias("at"), F.col("gate_failed").alias("detail"), F.col("summary.candidate_cells").cast("int").alias("n_cells")),
        records.emergency_records(told).select(F.lit("emergency").alias("kind"), "id", "details.region", F.col("timestamp").alias("at"), F.col("event").alias("detail"), size("details.fire_cells")),
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("at", F.col("at").cast("timestamp_ntz")))


# One step of the recursion is one window of every feature.
_RUN = f"""windows as materialized (select feature, case when month(window_ts) between 6 and 11 then 'fire_season' else 'off_season' end as season, window_ts, count(*) as k, avg(value) as m, var_pop(value) * count(*) as s,
  row_number() over (partition by feature, season order by window_ts) as i from long group by 1, 2, 3),
run as (select distinct feature, season, 0::bigint as i, null::timestamp as window_ts, 0::bigint as k, 0::bigint as samples, 0.0::double as mean, 0.0::double as m2, 0::bigint as n1, 0.0::double as mean1, 0.0::double as m21 from windows
 union all select w.feature, w.season, w.i, w.window_ts, w.k, r.n1, r.mean1, r.m21, case when joins then r.n1 + w.k else r.n1 end, case when joins then r.mean1 + (w.m - r.mean1) * w.k / (r.n1 + w.k) else r.mean1 end,
  case when joins then r.m21 + w.s + (w.m - r.mean1) * (w.m - r.mean1) * r.n1 * w.k / (r.n1 + w.k) else r.m21 end
  from run r join windows w on w.feature = r.feature and w.season = r.season and w.i = r.i + 1, lateral (select w.k >= 10 and (r.n1 < 500 or r.m21 > 0) as joins)),
held as (select feature, season, window_ts, k as n, samples, case when samples > 0 then mean end as mean, case when samples > 0 then sqrt(m2 / greatest(samples - 1, 1)) end as std,
  case when k < 10 then 'few_values' when samples < 500 then 'seeding' when m2 <= 0 then 'constant' else 'scored' end as status from run where i > 0),
seen as (select h.feature, h.season, h.window_ts, count_if(abs((value - h.mean) / h.std) > case h.season when 'fire_season' then 4.0 else 3.5 end) as found, max(abs((value - h.mean) / h.std)) as top
 from held h join long l on l.feature = h.feature and l.window_ts = h.window_ts where status = 'scored' group by 1, 2, 3)"""


def _nine(name: str, alias: str = "") -> str:
    """Nine decimals: means of values with few decimals tie at six."""
    return f"round({name}::double, 9) + 0.0::double as {alias or name}"


@query("with recursive " + fx.FUSED + "," + qq._LONG + "," + _RUN + f" select feature, season, {ts('window_ts')}, n, status, coalesce(found, 0)::bigint as n_anomalies, {_nine('top', 'max_abs_z')}, samples, {_nine('mean')}, {_nine('std')} from held left join seen using (feature, season, window_ts)")
def running_baselines(spark, d):
    """Each window against the baseline of all windows before it, which is state."""
    rows = fx.fused(spark, d).select(scalar.season(F.col("window_ts")).alias("season"), F.col("window_ts").cast("timestamp").alias("window_ts"), *qq._COLUMNS)
    told = replay(rows, "window_ts", lambda r: baselines.running_baselines(r, qq._COLUMNS))
    doubles = {c: F.round(c, 9) + F.lit(0.0) for c in ("max_abs_z", "mean", "std")}
    return told.withColumns({"window_ts": F.date_format(F.col("window_ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), **doubles})
