"""Registered queries: every operator on the given tables, with the same thing in SQL.

The sensor operators are generic in key, time and value, so the ``events`` table
stands in for readings: ``user_id`` is the deployment, ``ts`` the time, ``value``
the distance. ``customer`` and its nation give deployments and places, ``orders``
gives dates to read back from text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nidalytics.functions.scalars import coalesce_blank, infer_year, valid_window
from nidalytics.operators import bouts as bt
from nidalytics.operators import classify, clean, correct, night, refresh, reports, segment, smooth, summary
from nidalytics.plans import pipeline
from nidalytics.plans.ordered import BLOCK, Ordering, running
from nidalytics.plans.stages import cut, shared_folder
from nidalytics.sources import raw, schemas, tables

K = ["user_id"]
SERIES = Ordering(("user_id",), "ts", ("event_id",))
ROW = ["user_id", "event_id"]
SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[name or fn.__name__] = fn
        SQL[name or fn.__name__] = sql
        return fn

    return add


# the columns that the queries read
COLUMNS = {
    "events": "event_id long, user_id long, ts timestamp, event_type string, value double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def off_ties(name: str):
    """Round to 6 decimals after a nudge: engines round halves differently, and
    microsecond times divided by 2 or 60 do end in halves."""
    return F.round(F.col(name) + 1e-8, 6)


# ---------------------------------------------------------------- shared inputs


def readings(spark, sf) -> DataFrame:
    """Events with a state; errors have none."""
    v = F.col("value")
    state = (
        F.when(F.col("event_type") == "error", None)
        .when(v < 20, "present")
        .when(v > 60, "absent")
        .otherwise("uncertain")
    )
    return events(spark, sf).withColumn("state", state)


READINGS = """readings AS (SELECT event_id, user_id, ts, event_type, value,
  CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN 'present'
       WHEN value > 60 THEN 'absent' ELSE 'uncertain' END AS state FROM events)"""

FILLED = f"""{READINGS},
filled AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER w, '__UNCLASSIFIED__') AS state_filled
  FROM readings WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

RUNS = f"""{FILLED},
changes AS (SELECT *, CASE WHEN state_filled <> lag(state_filled) OVER (PARTITION BY user_id ORDER BY ts, event_id)
  THEN 1 ELSE 0 END AS changed FROM filled),
runs AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS state_run FROM changes)"""

BOUTS_SELECT = """bouts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY bout_start, state_run) AS bout_id,
  bout_duration < 86400 AS flag_short FROM (
  SELECT user_id, state_run, state AS state_corrected, min(ts) AS bout_start, max(ts) AS bout_end,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS bout_duration, count(*) AS n_readings, avg(value) AS mean_value
  FROM runs WHERE state IS NOT NULL GROUP BY user_id, state_run, state))"""

BOUTS = f"{RUNS},\n{BOUTS_SELECT}"

STRICT_BOUTS = f"""{READINGS},
changes AS (SELECT *, CASE WHEN coalesce(state, '__NA__') <> lag(coalesce(state, '__NA__'))
  OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS changed FROM readings),
runs AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS state_run FROM changes),
{BOUTS_SELECT}"""

# bouts of the stand-in series last days, not minutes
SHORT = 86400.0


def bout_table(spark, sf, **kwargs) -> DataFrame:
    return bt.bouts(readings(spark, sf), SERIES, "state", "value", SHORT, **kwargs)


def places(spark, sf) -> DataFrame:
    """A place per customer, from the nation key; some lie beyond the polar circles."""
    n = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        (n * 6.5 - 78).alias("latitude"),
        (n * 14.0 - 170).alias("longitude"),
    )


SUN = """days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events),
located AS (SELECT d.user_id, d.date, radians(c.c_nationkey * 6.5 - 78) AS phi, -radians(c.c_nationkey * 14.0 - 170) AS west,
  datediff('day', DATE '2000-01-01', d.date) AS days FROM days d JOIN customer c ON c.c_custkey = d.user_id),
cycles AS (SELECT *, round(days - 0.0009 - west / (2 * pi())) AS cycle FROM located),
approx AS (SELECT *, 0.0009 + west / (2 * pi()) + cycle AS approx FROM cycles),
anomaly AS (SELECT *, radians(357.5291 + 0.98560028 * approx) AS m FROM approx),
lon AS (SELECT *, m + radians(1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m)) + radians(102.9372) + pi() AS lon FROM anomaly),
decl AS (SELECT *, asin(sin(lon) * sin(radians(23.4397))) AS decl, 0.0053 * sin(m) - 0.0069 * sin(2 * lon) AS wobble FROM lon),
ratios AS (SELECT *, (sin(radians(-0.833)) - sin(phi) * sin(decl)) / (cos(phi) * cos(decl)) AS ratio FROM decl),
angles AS (SELECT *, CASE WHEN ratio BETWEEN -1 AND 1 THEN acos(ratio) END AS w FROM ratios),
downs AS (SELECT *, 0.0009 + (w + west) / (2 * pi()) + cycle + wobble AS down FROM angles),
sun AS (SELECT user_id, date,
  make_timestamp(CAST(floor((2 * (approx + wobble) - down + 10957.5) * 86400) AS BIGINT) * 1000000) AS sunrise,
  make_timestamp(CAST(floor((down + 10957.5) * 86400) AS BIGINT) * 1000000) AS sunset,
  CASE WHEN ratio > 1 THEN 'night' WHEN ratio < -1 THEN 'day' END AS polar FROM downs)"""


def sun(spark, sf) -> DataFrame:
    return night.sun_table(events(spark, sf), "ts", places(spark, sf), K)


# ---------------------------------------------------------------- bouts


@query(f"WITH {FILLED} SELECT user_id, event_id, state_filled FROM filled")
def fill_state(spark, sf):
    return bt.fill_state(readings(spark, sf), SERIES, "state").select(*ROW, "state_filled")


@query(f"WITH {RUNS} SELECT user_id, event_id, state_run FROM runs")
def state_runs(spark, sf):
    return bt.state_runs(readings(spark, sf), SERIES, "state").select(*ROW, "state_run")


BOUT_COLUMNS = """user_id, bout_id, state_corrected, bout_start, bout_end, round(bout_duration, 6) AS bout_duration,
  n_readings, round(mean_value + 1e-8, 6) AS mean_value, flag_short"""


def _bout_columns(df):
    return df.select(
        "user_id", "bout_id", "state_corrected", "bout_start", "bout_end",
        r6(F.col("bout_duration"), "bout_duration"), "n_readings", off_ties("mean_tof_mm").alias("mean_value"), "flag_short",
    )


@query(f"WITH {BOUTS} SELECT {BOUT_COLUMNS} FROM bouts")
def bouts(spark, sf):
    return _bout_columns(bout_table(spark, sf))


@query(f"WITH {STRICT_BOUTS} SELECT {BOUT_COLUMNS} FROM bouts")
def bouts_strict(spark, sf):
    return _bout_columns(bt.bouts_strict(readings(spark, sf), SERIES, state="state", value="value", min_bout_sec=SHORT))


@query(
    f"WITH {BOUTS} SELECT r.user_id, r.event_id, b.bout_id FROM runs r "
    "LEFT JOIN bouts b ON b.user_id = r.user_id AND b.state_run = r.state_run"
)
def join_bout_id(spark, sf):
    return bt.join_bout_id(readings(spark, sf), SERIES, "state").select(*ROW, "bout_id")


@query(f"WITH {BOUTS} SELECT user_id, bout_id, bout_duration < 21600 AS flag_short FROM bouts")
def flag_short(spark, sf):
    return bt.flag_short(bout_table(spark, sf), 21600).select("user_id", "bout_id", "flag_short")


@query(
    f"""WITH {BOUTS} SELECT user_id, count(*) FILTER (state_corrected = 'present') AS n_present_bouts,
  count(*) FILTER (state_corrected = 'absent') AS n_absent_bouts, count(*) FILTER (flag_short) AS n_short_bouts
  FROM bouts GROUP BY user_id"""
)
def bout_counts(spark, sf):
    return bt.bout_counts(bout_table(spark, sf), K)


# ---------------------------------------------------------------- cleaning

RAW = """raw AS (SELECT *, CASE WHEN event_type = 'error' THEN -1.0 WHEN value > 200 THEN 8190.0
  WHEN event_type = 'view' AND value < 5 THEN NULL ELSE value END AS raw_mm FROM events)"""


def raw_readings(spark, sf) -> DataFrame:
    """Events whose errors and outliers read like the sensor's sentinels."""
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, sf).withColumn(
        "raw_mm",
        F.when(kind == "error", -1.0).when(v > 200, 8190.0).when((kind == "view") & (v < 5), None).otherwise(v),
    )


@query(
    f"""WITH {RAW}, flagged AS (SELECT *, raw_mm IS NULL OR raw_mm IN (-1, 8190) AS flag_tof_invalid FROM raw)
SELECT user_id, event_id, flag_tof_invalid, CASE WHEN NOT flag_tof_invalid THEN raw_mm END AS raw_mm,
  CASE WHEN NOT flag_tof_invalid THEN value END AS value FROM flagged"""
)
def flag_invalid(spark, sf):
    return clean.flag_invalid(raw_readings(spark, sf), "raw_mm", ["value"]).select(
        *ROW, "flag_tof_invalid", "raw_mm", "value"
    )


SESSIONS = """sessions AS (SELECT e.*, CAST(count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS session_id FROM events e)"""


def sessions(spark, sf) -> DataFrame:
    rows = events(spark, sf)
    return cut(clean.assign_session(rows, rows.where(F.col("event_type") == "signup"), SERIES))


@query(
    """SELECT e.user_id, e.event_id, CAST((SELECT count(*) FROM events b WHERE b.user_id = e.user_id
  AND b.event_type = 'signup' AND b.ts <= e.ts) AS INTEGER) AS session_id FROM events e"""
)
def assign_session(spark, sf):
    rows = events(spark, sf)
    counted = clean.assign_session(rows, rows.where(F.col("event_type") == "signup"), SERIES)
    return counted.select(*ROW, "session_id")


DELTAS = """deltas AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))
  / 1e6 AS dt_sec FROM events)"""


@query(f"WITH {DELTAS} SELECT user_id, event_id, round(dt_sec, 6) AS dt_sec FROM deltas")
def delta_seconds(spark, sf):
    return clean.delta_seconds(events(spark, sf), SERIES).select(*ROW, r6(F.col("dt_sec"), "dt_sec"))


@query(
    f"""WITH {SESSIONS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, session_id
  ORDER BY ts, event_id) <= 5 AS flag_ema_warmup FROM sessions"""
)
def flag_warmup(spark, sf):
    return clean.flag_warmup(sessions(spark, sf), SERIES, n=5).select(*ROW, "flag_ema_warmup")


CLIMATE = """climate AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS temp_in,
  CASE WHEN event_type <> 'view' THEN value / 2 END AS temp_out, value * 3 AS hum_in,
  CASE WHEN value < 200 THEN value * 2 END AS hum_out FROM events)"""


def climate(spark, sf) -> DataFrame:
    kind, v = F.col("event_type"), F.col("value")
    return events(spark, sf).select(
        *ROW, "ts",
        F.when(kind != "error", v).alias("temp_in"), F.when(kind != "view", v / 2).alias("temp_out"),
        (v * 3).alias("hum_in"), F.when(v < 200, v * 2).alias("hum_out"),
    )


CHANNELS = ["temp_in", "hum_in", "temp_out", "hum_out"]


@query(
    f"""WITH {CLIMATE} SELECT user_id, event_id, temp_in IS NULL OR hum_in IS NULL OR temp_out IS NULL
  OR hum_out IS NULL AS flag_dht_bad FROM climate"""
)
def flag_climate_bad(spark, sf):
    return clean.flag_any_missing(climate(spark, sf), CHANNELS).select(*ROW, "flag_dht_bad")


@query(
    f"""WITH {CLIMATE} SELECT user_id, event_id, round(temp_in - temp_out, 6) AS temp_diff,
  round(hum_in - hum_out, 6) AS hum_diff FROM climate"""
)
def channel_diff(spark, sf):
    df = clean.channel_diff(climate(spark, sf), "temp_in", "temp_out", "temp_diff", 6)
    return clean.channel_diff(df, "hum_in", "hum_out", "hum_diff", 6).select(*ROW, "temp_diff", "hum_diff")


def _gap_sql(seconds: int, name: str) -> str:
    return f"""WITH {DELTAS} SELECT user_id, make_timestamp(epoch_us(ts) - CAST(round(dt_sec * 1e6) AS BIGINT)) AS gap_start,
  ts AS gap_end, round(dt_sec / 60 + 1e-8, 6) AS {name} FROM deltas WHERE dt_sec > {seconds}"""


@query(_gap_sql(7200, "gap_min"))
def large_gaps(spark, sf):
    return clean.large_gaps(events(spark, sf), SERIES).withColumn("gap_min", off_ties("gap_min"))


@query(_gap_sql(300, "downtime_min"))
def downtime_gaps(spark, sf):
    return clean.downtime_gaps(events(spark, sf), SERIES).withColumn("downtime_min", off_ties("downtime_min"))


@query(
    """SELECT DISTINCT o.o_custkey AS deployment_id, o.o_orderpriority AS device_id, m.meta_device_id
FROM orders o JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_nationkey < 12 THEN '1-URGENT'
  ELSE '5-LOW' END AS meta_device_id FROM customer) m ON m.c_custkey = o.o_custkey
WHERE m.meta_device_id IS NOT NULL AND o.o_orderpriority <> m.meta_device_id"""
)
def device_mismatch(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("deployment_id"), F.col("o_orderpriority").alias("device_id")
    )
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("deployment_id"),
        F.when(F.col("c_acctbal") < 0, "").when(F.col("c_nationkey") < 12, "1-URGENT").otherwise("5-LOW").alias("device_id"),
    )
    return clean.device_mismatch(log, owners)


def tof_like(spark, sf) -> DataFrame:
    """Readings with every flag a clean distance table has."""
    rows = raw_readings(spark, sf)
    boots = rows.where(F.col("event_type") == "signup")
    df = clean.flag_invalid(rows, "raw_mm")
    return clean.flag_warmup(clean.session_columns(df, boots, SERIES), SERIES, n=3)


TOF = f"""{RAW},
with_session AS (SELECT r.*, raw_mm IS NULL OR raw_mm IN (-1, 8190) AS flag_tof_invalid,
  CAST(count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS session_id,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS dt_sec FROM raw r),
tof AS (SELECT * REPLACE (CASE WHEN NOT flag_tof_invalid THEN raw_mm END AS raw_mm),
  row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) <= 3 AS flag_ema_warmup FROM with_session)"""


def boot_log(spark, sf) -> DataFrame:
    return events(spark, sf).select(
        "user_id", "ts", F.when(F.col("event_type") == "signup", " Start ").otherwise(F.col("event_type")).alias("event")
    )


@query(
    f"""WITH {TOF}, {CLIMATE},
t AS (SELECT user_id, count(*) AS n_tof, count(*) FILTER (flag_tof_invalid) AS n_tof_invalid,
  count(*) FILTER (flag_ema_warmup) AS n_tof_warmup FROM tof GROUP BY 1),
d AS (SELECT user_id, count(*) AS n_dht, count(*) FILTER (temp_in IS NULL OR hum_in IS NULL OR temp_out IS NULL
  OR hum_out IS NULL) AS n_dht_bad FROM climate GROUP BY 1),
l AS (SELECT user_id, count(*) AS n_log, count(*) FILTER (event_type = 'signup') AS n_boots FROM events GROUP BY 1)
SELECT * FROM t JOIN d USING (user_id) JOIN l USING (user_id)"""
)
def ingest_counts(spark, sf):
    dht = clean.flag_any_missing(climate(spark, sf), CHANNELS)
    return clean.ingest_counts(tof_like(spark, sf), dht, boot_log(spark, sf), K)


# ---------------------------------------------------------------- smoothing, day and night


@query(
    f"""WITH {TOF} SELECT user_id, round(median(dt_sec) + 1e-8, 6) AS typical_interval FROM tof
  WHERE NOT flag_tof_invalid AND NOT flag_ema_warmup AND dt_sec IS NOT NULL GROUP BY user_id"""
)
def typical_interval(spark, sf):
    return smooth.typical_interval(tof_like(spark, sf), K).select("user_id", off_ties("typical_interval").alias("typical_interval"))


@query(
    """WITH k AS (SELECT event_id, CAST(round_even(75 / (value + 0.5), 0) AS INTEGER) AS k FROM events)
SELECT event_id, greatest(CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END, 3) AS k FROM k""",
    "valid_window",
)
def valid_window_size(spark, sf):
    return events(spark, sf).select("event_id", valid_window(75, F.col("value") + 0.5).alias("k"))


def _rolling_sql(rule: str) -> str:
    return f"""WITH {SESSIONS}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM sessions)
SELECT user_id, event_id, CASE WHEN {rule} THEN round(median(x) OVER w, 6) END AS smooth FROM x
WINDOW w AS (PARTITION BY user_id, session_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""


def _rolling(spark, sf, nulls):
    x = F.when(F.col("event_type") != "error", F.col("value"))
    df = smooth.rolling_median(sessions(spark, sf), SERIES.within("session_id"), x, 5, nulls, "smooth")
    return df.select(*ROW, r6(F.col("smooth"), "smooth"))


@query(_rolling_sql("count(x) OVER w = 5"))
def rolling_median(spark, sf):
    return _rolling(spark, sf, "propagate")


@query(_rolling_sql("count(*) OVER w = 5"))
def rolling_median_skip(spark, sf):
    return _rolling(spark, sf, "skip")


_FRAMES = ", ".join(
    f"w{h} AS (PARTITION BY user_id, session_id ORDER BY ts, event_id ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    for h in (1, 2, 4)
)


@query(
    f"""WITH {SESSIONS}, x AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM sessions)
SELECT user_id, event_id, CASE
  WHEN user_id % 3 = 0 AND count(*) OVER w1 = 3 THEN round(median(x) OVER w1, 6)
  WHEN user_id % 3 = 1 AND count(*) OVER w2 = 5 THEN round(median(x) OVER w2, 6)
  WHEN user_id % 3 = 2 AND count(*) OVER w4 = 9 THEN round(median(x) OVER w4, 6) END AS smooth
FROM x WINDOW {_FRAMES}""",
)
def rolling_median_by_size(spark, sf):
    df = sessions(spark, sf)
    k = F.get(F.array(F.lit(3), F.lit(5), F.lit(9)), (F.col("user_id") % 3).cast("int"))
    sizes = df.select("user_id").distinct().withColumn("k", k)
    x = F.when(F.col("event_type") != "error", F.col("value"))
    got = smooth.smooth_by_window_size(df, SERIES.within("session_id"), x, sizes, "skip", "smooth")
    return got.select(*ROW, r6(F.col("smooth"), "smooth"))


@query(f"WITH {SUN} SELECT * FROM sun")
def sun_times(spark, sf):
    return sun(spark, sf)


@query(
    f"""WITH {SUN} SELECT e.user_id, e.event_id, coalesce(s.polar = 'night', false) OR
  coalesce(e.ts < s.sunrise OR e.ts > s.sunset, false) AS is_night
FROM events e LEFT JOIN sun s ON s.user_id = e.user_id AND s.date = CAST(e.ts AS DATE)"""
)
def mark_night(spark, sf):
    return night.mark_night(events(spark, sf), "ts", sun(spark, sf), K).select(*ROW, "is_night")


# ---------------------------------------------------------------- segments and classes


@query(
    f"""WITH {TOF} SELECT user_id, event_id FROM tof WHERE NOT flag_tof_invalid AND NOT flag_ema_warmup
  AND value >= 5 AND NOT (hour(ts) < 6 OR hour(ts) > 20)"""
)
def signal_rows(spark, sf):
    df = tof_like(spark, sf).withColumns(
        {
            "tof_smooth_r": F.when(F.col("value") >= 5, F.col("value")),
            "is_night": (F.hour("ts") < 6) | (F.hour("ts") > 20),
        }
    )
    return segment.signal_rows(df).select(*ROW)


def _dp_sql(cost_extra: str, penalty: str) -> str:
    return f"""WITH RECURSIVE
nums AS (SELECT user_id, ts, event_id, value / 30 AS x, row_number() OVER w AS p, count(*) OVER (PARTITION BY user_id) AS n,
  sum(value / 30) OVER w AS s1, sum((value / 30) * (value / 30)) OVER w AS s2 FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
series AS (SELECT user_id, any_value(n) AS n, list_prepend(0.0::DOUBLE, list(s1 ORDER BY p)) AS c1,
  list_prepend(0.0::DOUBLE, list(s2 ORDER BY p)) AS c2 FROM nums GROUP BY user_id),
dp AS (
  SELECT user_id, n, c1, c2, 0::BIGINT AS t, [-({penalty})] AS f, []::BIGINT[] AS prev FROM series
  UNION ALL
  SELECT user_id, n, c1, c2, t + 1, list_append(f, list_min(cand) + {penalty}),
    list_append(prev, (list_position(cand, list_min(cand)) - 1)::BIGINT)
  FROM (SELECT *, list_transform(range(0, t + 1), lambda s: f[s + 1] + (c2[t + 2] - c2[s + 1])
      - (c1[t + 2] - c1[s + 1]) * (c1[t + 2] - c1[s + 1]) / (t + 1 - s) {cost_extra}) AS cand
    FROM dp WHERE t < n) step),
trail AS (
  SELECT user_id, prev, n AS pos FROM dp WHERE t = n
  UNION ALL
  SELECT user_id, prev, prev[pos] FROM trail WHERE prev[pos] > 0),
cuts AS (SELECT user_id, pos, 1 AS cut FROM trail t WHERE pos < (SELECT any_value(n) FROM series s WHERE s.user_id = t.user_id))
SELECT nums.user_id, nums.event_id, CAST(1 + coalesce(sum(cut) OVER (PARTITION BY nums.user_id ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS segment_id
FROM nums LEFT JOIN cuts ON cuts.user_id = nums.user_id AND cuts.pos + 1 = nums.p"""


def _signal(spark, sf):
    return events(spark, sf).select(*ROW, "ts", (F.col("value") / 30).alias("x"))


@query(_dp_sql("+ ln((t + 1 - s) / n)", "3 * ln(n)"))
def changepoints(spark, sf):
    return segment.changepoints(_signal(spark, sf), SERIES, "x").select(*ROW, "segment_id")


@query(_dp_sql("", "2 * ln(n)"))
def changepoints_bic(spark, sf):
    return segment.changepoints(_signal(spark, sf), SERIES, "x", penalty="BIC").select(*ROW, "segment_id")


# one segment per user and day stands in for change-point segments
SEGMENTS = """segs AS (SELECT user_id, CAST(ts AS DATE) AS segment_id, median(value) AS seg_median
  FROM events GROUP BY 1, 2)"""


def day_segments(spark, sf) -> DataFrame:
    df = events(spark, sf).withColumn("segment_id", F.to_date("ts"))
    return segment.segment_medians(df, K, "value")


@query(f"WITH {SEGMENTS} SELECT user_id, segment_id, round(seg_median, 6) AS seg_median FROM segs")
def segment_medians(spark, sf):
    return day_segments(spark, sf).select("user_id", "segment_id", r6(F.col("seg_median"), "seg_median"))


VIABLE = """viable AS (SELECT user_id, count(DISTINCT round_even(seg_median, 0)) >= 2 AND max(seg_median) - min(seg_median) >= 5
  AS viable FROM segs GROUP BY user_id)"""


@query(f"WITH {SEGMENTS}, {VIABLE} SELECT * FROM viable")
def cluster_viable(spark, sf):
    return classify.cluster_viable(day_segments(spark, sf), K)


KMEANS = f"""{SEGMENTS}, {VIABLE},
splits AS (SELECT a.user_id, a.seg_median AS edge, avg(b.seg_median) FILTER (b.seg_median <= a.seg_median) AS lo,
  avg(b.seg_median) FILTER (b.seg_median > a.seg_median) AS hi,
  count(*) FILTER (b.seg_median <= a.seg_median) AS n1, count(*) FILTER (b.seg_median > a.seg_median) AS n2
  FROM (SELECT DISTINCT user_id, seg_median FROM segs) a JOIN segs b USING (user_id) GROUP BY 1, 2),
centres AS (SELECT user_id, arg_max({{'lo': lo, 'hi': hi, 'edge': edge}}, (round(n1 * lo * lo + n2 * hi * hi, 6), -edge)) AS c
  FROM splits WHERE n2 > 0 GROUP BY user_id)"""


@query(
    f"""WITH {KMEANS} SELECT s.user_id, s.segment_id, CASE WHEN NOT v.viable OR c.c IS NULL THEN 'uncertain'
  WHEN s.seg_median < (c.c.lo + c.c.hi) / 2 - 0.3 * (c.c.hi - c.c.lo) / 2 THEN 'present'
  WHEN s.seg_median > (c.c.lo + c.c.hi) / 2 + 0.3 * (c.c.hi - c.c.lo) / 2 THEN 'absent' ELSE 'uncertain' END AS state_auto
FROM segs s JOIN viable v USING (user_id) LEFT JOIN centres c USING (user_id)"""
)
def classify_kmeans(spark, sf):
    return classify.classify_kmeans(day_segments(spark, sf), K).select("user_id", "segment_id", "state_auto")


@query(
    f"""WITH {SEGMENTS}, q AS (SELECT user_id, quantile_cont(value, 0.25) AS q1, median(value) AS q2,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY user_id)
SELECT s.user_id, s.segment_id, CASE WHEN seg_median < q2 - 0.5 * greatest(q3 - q1, 2) THEN 'present'
  WHEN seg_median > q2 + 0.5 * greatest(q3 - q1, 2) THEN 'absent' ELSE 'uncertain' END AS state_auto
FROM segs s JOIN q USING (user_id)"""
)
def classify_iqr(spark, sf):
    return classify.classify_iqr(events(spark, sf), day_segments(spark, sf), K, "value").select(
        "user_id", "segment_id", "state_auto"
    )


GMM = f"""{KMEANS},
lists AS (SELECT user_id, list(seg_median ORDER BY seg_median, segment_id) AS x FROM segs GROUP BY user_id),
em AS (
  SELECT l.user_id, x, list_transform(x, lambda v: CASE WHEN v <= c.c.edge THEN 1::DOUBLE ELSE 0::DOUBLE END) AS r,
    0 AS it, -1e300::DOUBLE AS ll, false AS done, 0.0::DOUBLE AS p1, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2,
    0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2
  FROM lists l JOIN centres c USING (user_id)
  UNION ALL
  SELECT user_id, x, list_transform(lp, lambda q: exp(q.a - q.t)), it + 1, list_sum(list_transform(lp, lambda q: q.t)),
    abs(list_sum(list_transform(lp, lambda q: q.t)) - ll) <= 1e-5 * (1 + abs(list_sum(list_transform(lp, lambda q: q.t)))),
    pa, ma, mb, va, vb
  FROM (SELECT *, list_transform(list_transform(x, lambda v: {{'a': ln(pa) - 0.5 * ln(2 * pi() * va) - (v - ma) * (v - ma) / (2 * va),
      'b': ln(1 - pa) - 0.5 * ln(2 * pi() * vb) - (v - mb) * (v - mb) / (2 * vb)}}),
      lambda q: {{'a': q.a, 't': greatest(q.a, q.b) + ln(1 + exp(-abs(q.a - q.b)))}}) AS lp
    FROM (SELECT *, n1 / len(x) AS pa,
        greatest(list_sum(list_transform(list_zip(x, r), lambda z: z[2] * (z[1] - ma) * (z[1] - ma))) / n1, 1e-6) AS va,
        greatest(list_sum(list_transform(list_zip(x, r), lambda z: (1 - z[2]) * (z[1] - mb) * (z[1] - mb))) / (len(x) - n1), 1e-6) AS vb
      FROM (SELECT *, list_sum(r) AS n1, list_sum(list_transform(list_zip(x, r), lambda z: z[1] * z[2])) / list_sum(r) AS ma,
          list_sum(list_transform(list_zip(x, r), lambda z: z[1] * (1 - z[2]))) / (len(x) - list_sum(r)) AS mb
        FROM em WHERE NOT done AND it < 200) a) b) c),
fit AS (SELECT user_id, arg_max({{'p': p1, 'm1': m1, 'm2': m2, 'v1': v1, 'v2': v2}}, it) AS g FROM em GROUP BY user_id),
post AS (SELECT s.user_id, s.segment_id, v.viable, g.g.m1 <= g.g.m2 AS first_low,
  1 / (1 + exp((ln(1 - g.g.p) - 0.5 * ln(g.g.v2) - (seg_median - g.g.m2) * (seg_median - g.g.m2) / (2 * g.g.v2))
    - (ln(g.g.p) - 0.5 * ln(g.g.v1) - (seg_median - g.g.m1) * (seg_median - g.g.m1) / (2 * g.g.v1)))) AS q
  FROM segs s JOIN viable v USING (user_id) LEFT JOIN fit g USING (user_id))"""


@query(
    f"""WITH RECURSIVE {GMM} SELECT user_id, segment_id, CASE WHEN NOT viable THEN 'uncertain'
  WHEN greatest(q, 1 - q) < 0.65 THEN 'uncertain'
  WHEN (CASE WHEN first_low THEN q ELSE 1 - q END) > 0.5 THEN 'present' ELSE 'absent' END AS state_auto FROM post"""
)
def classify_gmm(spark, sf):
    return classify.classify_gmm(day_segments(spark, sf), K).select("user_id", "segment_id", "state_auto")


@query(SQL["classify_gmm"])
def classify_segments(spark, sf):
    return classify.classify_segments(day_segments(spark, sf), K, "gmm").select("user_id", "segment_id", "state_auto")


LABELS = """labelled AS (SELECT user_id, event_id, CAST(day(ts) AS INTEGER) AS segment_id,
  CASE WHEN value < 30 THEN 'present' ELSE 'absent' END AS state_auto FROM events WHERE event_type <> 'error'),
applied AS (SELECT e.user_id, e.event_id, l.segment_id,
  CASE WHEN hour(ts) < 5 THEN 'present' ELSE l.state_auto END AS state_auto,
  CASE WHEN hour(ts) < 5 THEN 'night_auto' WHEN l.state_auto IS NOT NULL THEN 'auto' END AS correction_source
  FROM events e LEFT JOIN labelled l USING (user_id, event_id))"""


def _applied(spark, sf):
    rows = events(spark, sf).withColumn("is_night", F.hour("ts") < 5)
    labels = rows.where(F.col("event_type") != "error").select(
        *ROW,
        F.dayofmonth("ts").alias("segment_id"),
        F.when(F.col("value") < 30, "present").otherwise("absent").alias("state_auto"),
    )
    return classify.apply_labels(rows, labels, ROW)


@query(
    f"""WITH {LABELS} SELECT user_id, event_id, segment_id, state_auto, state_auto AS state_corrected, correction_source
FROM applied"""
)
def apply_labels(spark, sf):
    return _applied(spark, sf).select(*ROW, "segment_id", "state_auto", "state_corrected", "correction_source")


@query(
    f"""WITH {READINGS} SELECT user_id, count(*) FILTER (state = 'present') AS n_present,
  count(*) FILTER (state = 'absent') AS n_absent, count(*) FILTER (state = 'uncertain') AS n_uncertain,
  count(*) FILTER (state IS NULL) AS n_unclassified FROM readings GROUP BY user_id"""
)
def state_counts(spark, sf):
    return classify.state_counts(readings(spark, sf), K, "state")


# ---------------------------------------------------------------- summaries

ACTIVE = f"""{BOUTS}, {SUN},
active AS (SELECT b.*, CAST(bout_start AS DATE) AS date FROM bouts b JOIN sun s ON s.user_id = b.user_id
  AND s.date = CAST(b.bout_start AS DATE) WHERE polar = 'day' OR (polar IS NULL AND bout_start BETWEEN s.sunrise AND s.sunset))"""


@query(f"WITH {ACTIVE} SELECT user_id, bout_id, date FROM active")
def active_bouts(spark, sf):
    return summary.active_bouts(bout_table(spark, sf), sun(spark, sf), K).select("user_id", "bout_id", "date")


def _stats_sql(source: str) -> str:
    return f"""stats AS (SELECT user_id, date,
  count(*) FILTER (state_corrected = 'present') AS n_on_bouts, count(*) FILTER (state_corrected = 'absent') AS n_off_bouts,
  count(*) FILTER (state_corrected = 'uncertain') AS n_unc_bouts,
  coalesce(sum(bout_duration) FILTER (state_corrected = 'present'), 0) AS sum_on_sec,
  coalesce(sum(bout_duration) FILTER (state_corrected = 'absent'), 0) AS sum_off_sec,
  coalesce(sum(bout_duration) FILTER (state_corrected = 'uncertain'), 0) AS sum_unc_sec,
  strftime(min(bout_start) FILTER (state_corrected = 'absent'), '%H:%M') AS first_off_start,
  strftime(max(bout_end) FILTER (state_corrected = 'absent'), '%H:%M') AS last_off_end FROM {source} GROUP BY 1, 2)"""


DATED = "dated AS (SELECT *, CAST(bout_start AS DATE) AS date FROM bouts)"
SPINE = "spine AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM readings WHERE state IS NOT NULL)"


@query(
    f"""WITH {BOUTS}, {DATED}, {_stats_sql("dated")} SELECT user_id, date, n_on_bouts, n_off_bouts, n_unc_bouts,
  round(sum_on_sec, 6) AS sum_on_sec, round(sum_off_sec, 6) AS sum_off_sec, round(sum_unc_sec, 6) AS sum_unc_sec FROM stats"""
)
def state_day_stats(spark, sf):
    s = summary.state_day_stats(bout_table(spark, sf), K)
    return s.select(
        "user_id", "date", "n_on_bouts", "n_off_bouts", "n_unc_bouts",
        *[r6(F.col(c), c) for c in ("sum_on_sec", "sum_off_sec", "sum_unc_sec")],
    )


@query(
    f"""WITH {BOUTS}, {DATED}, {_stats_sql("dated")} SELECT user_id, date, first_off_start, last_off_end
FROM stats WHERE n_off_bouts > 0"""
)
def off_times(spark, sf):
    return summary.off_times(bout_table(spark, sf), K)


@query(f"WITH {READINGS}, {SPINE} SELECT * FROM spine")
def day_spine(spark, sf):
    return summary.day_spine(readings(spark, sf), K, "ts", "state")


DAY_COLUMNS = """CAST(coalesce(n_on_bouts, 0) AS INTEGER) AS n_on_bouts, CAST(coalesce(n_off_bouts, 0) AS INTEGER) AS n_off_bouts,
  first_off_start, last_off_end, round(coalesce(sum_on_sec, 0) / day_sec + 1e-8, 6) AS prop_on_nest,
  round(coalesce(sum_off_sec, 0) / day_sec + 1e-8, 6) AS prop_off_nest, round(coalesce(sum_unc_sec, 0) / day_sec + 1e-8, 6) AS prop_uncertain,
  CASE WHEN n_on_bouts > 0 THEN round(sum_on_sec / 60 / n_on_bouts + 1e-8, 6) END AS mean_on_bout_min,
  CASE WHEN n_off_bouts > 0 THEN round(sum_off_sec / 60 / n_off_bouts + 1e-8, 6) END AS mean_off_bout_min"""
RAW_DAY = ["prop_on_nest", "prop_off_nest", "prop_uncertain", "mean_on_bout_min", "mean_off_bout_min"]


def _day_columns(df):
    return df.withColumns({c: off_ties(c) for c in RAW_DAY})


@query(
    f"""WITH {BOUTS}, {DATED}, {_stats_sql("dated")}, {SPINE} SELECT user_id, date, 24.0::DOUBLE AS day_length_h, {DAY_COLUMNS}
FROM (SELECT *, 86400 AS day_sec FROM spine) LEFT JOIN stats USING (user_id, date)"""
)
def day_summary(spark, sf):
    rows = readings(spark, sf)
    return _day_columns(summary.day_summary(rows, bout_table(spark, sf), K, "ts", None, "state", digits=None))


@query(
    f"""WITH {ACTIVE}, {_stats_sql("active")}, {SPINE},
lit AS (SELECT p.user_id, p.date, s.sunrise, s.sunset,
  CASE s.polar WHEN 'day' THEN 24.0 WHEN 'night' THEN 0.0 ELSE floor((epoch_us(s.sunset) - epoch_us(s.sunrise)) / 3.6e7 + 0.5) / 100 END AS day_length_h
  FROM spine p JOIN sun s USING (user_id, date))
SELECT user_id, date, strftime(sunrise, '%H:%M') AS sunrise, strftime(sunset, '%H:%M') AS sunset, day_length_h, {DAY_COLUMNS}
FROM (SELECT *, nullif(day_length_h * 3600, 0) AS day_sec FROM lit) LEFT JOIN stats USING (user_id, date)"""
)
def day_summary_sun(spark, sf):
    rows = readings(spark, sf)
    days = summary.day_summary(rows, bout_table(spark, sf), K, "ts", sun(spark, sf), "state", digits=None)
    return _day_columns(days)


@query(
    f"""WITH {STRICT_BOUTS}, {DATED},
daily AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) * 2.0 AS total_valid_sec,
  count(*) FILTER (state = 'present') * 2.0 AS on_nest_sec, count(*) FILTER (state = 'absent') * 2.0 AS off_nest_sec,
  count(*) FILTER (state = 'uncertain') * 2.0 AS uncertain_sec FROM readings WHERE state IS NOT NULL GROUP BY 1, 2),
off AS (SELECT user_id, date, count(*) AS n_off_bouts, avg(bout_duration / 60) AS mean_off FROM dated
  WHERE state_corrected = 'absent' AND NOT bout_duration < 3600 GROUP BY 1, 2)
SELECT user_id, date, total_valid_sec::DOUBLE AS total_valid_sec, on_nest_sec::DOUBLE AS on_nest_sec,
  off_nest_sec::DOUBLE AS off_nest_sec, uncertain_sec::DOUBLE AS uncertain_sec,
  round(on_nest_sec::DOUBLE / 86400 * 100, 6) AS pct_day_on_nest, coalesce(n_off_bouts, 0) AS n_off_bouts,
  round(mean_off + 1e-8, 6) AS mean_off_bout_min FROM daily LEFT JOIN off USING (user_id, date)"""
)
def day_summary_readings(spark, sf):
    rows = readings(spark, sf)
    strict = bt.bouts_strict(rows, SERIES, state="state", value="value", min_bout_sec=3600)
    days = summary.day_summary_readings(rows, strict, K, "ts", F.lit(2.0), "state")
    return days.withColumns(
        {"pct_day_on_nest": F.round("pct_day_on_nest", 6), "mean_off_bout_min": off_ties("mean_off_bout_min")}
    )


@query(
    f"""WITH {READINGS}, {SUN} SELECT r.user_id, s.date, count(*) AS n_active,
  round(count(*) FILTER (state = 'present') / count(*) * 100, 6) AS pct_active_on_nest
FROM readings r JOIN sun s ON s.user_id = r.user_id AND s.date = CAST(r.ts AS DATE)
WHERE state IS NOT NULL AND (polar = 'day' OR (polar IS NULL AND ts BETWEEN sunrise AND sunset)) GROUP BY 1, 2"""
)
def active_day_pct(spark, sf):
    pct = summary.active_day_pct(readings(spark, sf), sun(spark, sf), K, "ts", "state")
    return pct.withColumn("pct_active_on_nest", F.round("pct_active_on_nest", 6))


DEVICE = f"""{TOF}, {CLIMATE},
t AS (SELECT user_id, min(ts) AS first_timestamp, max(ts) AS last_timestamp,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS span, CAST(count(DISTINCT session_id) AS INTEGER) AS n_sessions,
  coalesce(sum(dt_sec / 60) FILTER (dt_sec > 300), 0) AS down, count(*) AS n_tof_total,
  count(*) FILTER (flag_tof_invalid) AS n_tof_invalid, count(*) FILTER (flag_ema_warmup) AS n_tof_warmup FROM tof GROUP BY 1),
d AS (SELECT user_id, count(*) FILTER (temp_in IS NULL OR hum_in IS NULL OR temp_out IS NULL OR hum_out IS NULL) AS n_dht_bad,
  count(*) AS n FROM climate GROUP BY 1),
l AS (SELECT user_id, CAST(count(*) FILTER (event_type = 'signup') - 1 AS INTEGER) AS n_reboots FROM events GROUP BY 1),
device AS (SELECT t.user_id, c.c_mktsegment AS device_id, first_timestamp, last_timestamp, round(span, 6) AS span_days,
  n_sessions, n_reboots, round(down + 1e-8, 6) AS total_downtime_min, round(down / (span * 1440) * 100, 6) AS pct_downtime,
  n_tof_total, n_tof_invalid, round(n_tof_invalid / n_tof_total * 100, 6) AS pct_tof_invalid, n_tof_warmup, n_dht_bad,
  round(n_dht_bad / d.n * 100, 6) AS pct_dht_bad
  FROM t JOIN d USING (user_id) JOIN l USING (user_id) LEFT JOIN customer c ON c.c_custkey = t.user_id)"""


def _device(spark, sf):
    dht = clean.flag_any_missing(climate(spark, sf), CHANNELS)
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("device_id")
    )
    return summary.device_summary(tof_like(spark, sf), dht, boot_log(spark, sf), owners, K, "ts", rounded=False)


@query(f"WITH {DEVICE} SELECT * FROM device")
def device_summary(spark, sf):
    df = _device(spark, sf)
    rounded = ("span_days", "total_downtime_min", "pct_downtime", "pct_tof_invalid", "pct_dht_bad")
    return df.withColumns({c: off_ties(c) if c == "total_downtime_min" else F.round(c, 6) for c in rounded})


REPORTED = ["device_id", "first_timestamp", "last_timestamp", "n_sessions", "n_reboots", "n_tof_total", "n_tof_invalid"]


@query(
    f"""WITH {DEVICE}, texts AS (SELECT user_id, device_id AS "Device id", strftime(first_timestamp, '%Y-%m-%d %H:%M') AS "First timestamp",
  strftime(last_timestamp, '%Y-%m-%d %H:%M') AS "Last timestamp", n_sessions::VARCHAR AS "N sessions",
  n_reboots::VARCHAR AS "N reboots", n_tof_total::VARCHAR AS "N tof total", n_tof_invalid::VARCHAR AS "N tof invalid" FROM device)
SELECT user_id, "Metric", "Value" FROM texts UNPIVOT INCLUDE NULLS ("Value" FOR "Metric" IN ("Device id", "First timestamp",
  "Last timestamp", "N sessions", "N reboots", "N tof total", "N tof invalid"))"""
)
def device_report(spark, sf):
    return reports.device_report(_device(spark, sf).select("user_id", *REPORTED), K)


# ---------------------------------------------------------------- trims and corrections

TRIMS = """trims AS (SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN TIMESTAMP '2024-01-03 00:00:00' END AS trim_start,
  CASE WHEN c_nationkey < 15 THEN TIMESTAMP '2024-01-20 12:30:00' END AS trim_end FROM customer)"""


def trims(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_acctbal") > 0, F.lit("2024-01-03 00:00:00").cast("timestamp")).alias("trim_start"),
        F.when(F.col("c_nationkey") < 15, F.lit("2024-01-20 12:30:00").cast("timestamp")).alias("trim_end"),
    )


IN_TRIM = "ts >= coalesce(trim_start, ts) AND ts <= coalesce(trim_end, ts)"


@query(f"WITH {TRIMS} SELECT e.user_id, event_id FROM events e LEFT JOIN trims t ON t.user_id = e.user_id WHERE {IN_TRIM}")
def trim_window(spark, sf):
    return correct.trim_window(events(spark, sf), trims(spark, sf), K, "ts").select(*ROW)


@query(
    f"""WITH {TRIMS}, overrides AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN '2024-01-05 06:00:00'
  WHEN c_mktsegment = 'MACHINERY' THEN 'soon' END AS s, CASE WHEN c_mktsegment = 'FURNITURE' THEN '2024-01-25 00:00:00' ELSE '' END AS e FROM customer)
SELECT user_id, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), trim_start) AS trim_start,
  coalesce(try_strptime(e, '%Y-%m-%d %H:%M:%S'), trim_end) AS trim_end FROM trims JOIN overrides USING (user_id)"""
)
def set_trim(spark, sf):
    segment_name = F.col("c_mktsegment")
    overrides = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(segment_name == "BUILDING", "2024-01-05 06:00:00").when(segment_name == "MACHINERY", "soon").alias("trim_start"),
        F.when(segment_name == "FURNITURE", "2024-01-25 00:00:00").otherwise("").alias("trim_end"),
    )
    return correct.set_trim(trims(spark, sf), overrides, K)


# every purchase draws a box around itself; cheap ones reset, the others set a state
BOXES = """boxes AS (SELECT user_id, event_id AS seq, ts - INTERVAL 12 HOUR AS t_min, ts + INTERVAL 18 HOUR AS t_max,
  value - 25 AS d_min, value + 25 AS d_max, CASE WHEN value < 10 THEN 'reset' WHEN value < 30 THEN 'present' ELSE 'absent' END AS action
  FROM events WHERE event_type = 'purchase')"""
HITS = f"""{BOXES}, hits AS (SELECT r.event_id, b.user_id, b.seq, b.action, r.ts, r.value FROM events r JOIN boxes b ON b.user_id = r.user_id
  AND r.ts BETWEEN b.t_min AND b.t_max AND r.value BETWEEN b.d_min AND b.d_max)"""
AUTO = """auto AS (SELECT event_id, user_id, ts, value, CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN 'present'
  WHEN value > 60 THEN 'absent' ELSE 'uncertain' END AS state_auto FROM events)"""


def boxes(spark, sf) -> DataFrame:
    v = F.col("value")
    return (
        events(spark, sf)
        .where(F.col("event_type") == "purchase")
        .select(
            "user_id",
            F.col("event_id").alias("seq"),
            (F.col("ts") - F.expr("INTERVAL 12 HOURS")).alias("t_min"),
            (F.col("ts") + F.expr("INTERVAL 18 HOURS")).alias("t_max"),
            (v - 25).alias("d_min"),
            (v + 25).alias("d_max"),
            F.when(v < 10, "reset").when(v < 30, "present").otherwise("absent").alias("action"),
        )
    )


def auto_states(spark, sf) -> DataFrame:
    rows = readings(spark, sf).withColumnRenamed("state", "state_auto")
    return rows.withColumns(
        {
            "state_corrected": F.col("state_auto"),
            "correction_source": F.when(F.col("state_auto").isNotNull(), "auto"),
        }
    )


@query(f"WITH {HITS} SELECT user_id, seq, event_id FROM hits")
def box_select(spark, sf):
    return correct.box_select(events(spark, sf), boxes(spark, sf), SERIES, "value", 21600).select(
        "user_id", "seq", "event_id"
    )


@query(
    f"""WITH {HITS}, {AUTO}, winner AS (SELECT event_id, arg_max(action, seq) AS action FROM hits GROUP BY event_id)
SELECT user_id, event_id, CASE WHEN action = 'reset' THEN state_auto ELSE coalesce(action, state_auto) END AS state_corrected,
  CASE WHEN action = 'reset' THEN 'auto' WHEN action IS NOT NULL THEN 'manual' WHEN state_auto IS NOT NULL THEN 'auto' END
  AS correction_source FROM auto LEFT JOIN winner USING (event_id)"""
)
def apply_corrections(spark, sf):
    df = correct.apply_corrections(auto_states(spark, sf), boxes(spark, sf), SERIES, "value", cell_sec=21600)
    return df.select(*ROW, "state_corrected", "correction_source")


@query(
    f"""WITH {HITS}, {AUTO}, hit AS (SELECT DISTINCT event_id FROM hits)
SELECT user_id, event_id, CASE WHEN h.event_id IS NOT NULL THEN state_auto ELSE 'uncertain' END AS state_corrected,
  CASE WHEN h.event_id IS NOT NULL THEN 'auto' ELSE 'manual' END AS correction_source
FROM auto LEFT JOIN hit h USING (event_id)"""
)
def reset_corrections(spark, sf):
    edited = auto_states(spark, sf).withColumns(
        {"state_corrected": F.lit("uncertain"), "correction_source": F.lit("manual")}
    )
    df = correct.reset_corrections(edited, boxes(spark, sf), SERIES, value="value", cell_sec=21600)
    return df.select(*ROW, "state_corrected", "correction_source")


@query(
    f"""WITH {HITS}, {AUTO}, per AS (SELECT h.user_id, h.seq, state_auto AS state, count(*) AS n FROM hits h
  JOIN auto USING (event_id) GROUP BY ALL), totals AS (SELECT user_id, seq, CAST(sum(n) AS BIGINT) AS n_selected FROM per GROUP BY ALL)
SELECT t.user_id, t.seq, p.state, p.n, t.n_selected FROM totals t LEFT JOIN per p ON p.user_id = t.user_id AND p.seq = t.seq
  AND p.state IS NOT NULL"""
)
def selection_counts(spark, sf):
    return correct.selection_counts(auto_states(spark, sf), boxes(spark, sf), SERIES, "value")


DAYS_IN = f"""{TRIMS}, all_days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events),
marked AS (SELECT d.*, coalesce(date >= CAST(trim_start AS DATE), true) AND coalesce(date <= CAST(trim_end AS DATE), true) AS inside
  FROM all_days d LEFT JOIN trims t USING (user_id)),
kept AS (SELECT user_id, date FROM (SELECT *, bool_or(inside) OVER (PARTITION BY user_id) AS any_in FROM marked) WHERE inside OR NOT any_in)"""


@query(f"WITH {DAYS_IN} SELECT * FROM kept")
def deployment_days(spark, sf):
    return correct.deployment_days(events(spark, sf), trims(spark, sf), K, "ts")


@query(
    f"""WITH {DAYS_IN} SELECT user_id, date, lag(date) OVER w AS prev_date, lead(date) OVER w AS next_date FROM kept
  WINDOW w AS (PARTITION BY user_id ORDER BY date)"""
)
def adjacent_day(spark, sf):
    return summary.adjacent_days(correct.deployment_days(events(spark, sf), trims(spark, sf), K, "ts"), K)


# ---------------------------------------------------------------- reports


def _sample_sql(source: str, maximum: int, partition: str = "user_id") -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY ts, event_id) AS rn,
  count(*) OVER (PARTITION BY {partition}) AS n FROM {source}),
sampled AS (SELECT * FROM numbered WHERE n <= {maximum} OR list_contains(list_transform(range(0, {maximum}),
  lambda j: CAST(round_even(1 + j * ((n - 1) / {maximum - 1}), 0) AS BIGINT)), rn))"""


@query(f"WITH {_sample_sql('events', 60)} SELECT user_id, event_id FROM sampled")
def downsample(spark, sf):
    return reports.downsample(events(spark, sf), SERIES, 60).select(*ROW)


VALID = f"""{TOF}, valid AS (SELECT * FROM tof WHERE NOT flag_tof_invalid)"""


def _flagged(spark, sf) -> DataFrame:
    return clean.flag_invalid(raw_readings(spark, sf), "raw_mm")


@query(f"WITH {VALID}, {_sample_sql('valid', 40)} SELECT user_id, event_id, value FROM sampled")
def overview_series(spark, sf):
    o = SERIES
    return reports.overview_series(_flagged(spark, sf), o, "value", 40).select(*ROW, "value")


@query(
    f"""WITH {BOUTS} SELECT user_id, bout_start AS "from", bout_end AS "to", state_corrected AS state FROM bouts
  WHERE state_corrected <> 'present'"""
)
def overview_intervals(spark, sf):
    return reports.overview_intervals(bout_table(spark, sf), K)


@query("SELECT user_id, ts FROM events WHERE event_type = 'signup'")
def reboot_events(spark, sf):
    return reports.reboot_events(boot_log(spark, sf), K, "ts")


@query(
    f"""WITH {TRIMS}, {TOF}, labelled AS (SELECT e.user_id, event_id, ts, CAST(ts AS DATE) AS date, value, CASE WHEN NOT ({IN_TRIM})
  THEN 'Outside trim' WHEN event_type = 'click' THEN 'Unclassified' WHEN value < 20 THEN 'Present' WHEN value > 60 THEN 'Absent'
  ELSE 'Uncertain' END AS state_label FROM tof e LEFT JOIN trims t ON t.user_id = e.user_id WHERE NOT flag_tof_invalid),
{_sample_sql('labelled', 3, 'user_id, date')} SELECT user_id, event_id, date, value, state_label FROM sampled"""
)
def day_points(spark, sf):
    v = F.col("value")
    state = (
        F.when(F.col("event_type") == "click", None).when(v < 20, "present").when(v > 60, "absent").otherwise("uncertain")
    )
    df = _flagged(spark, sf).withColumn("state_corrected", state)
    points = reports.day_points(df, SERIES, trims(spark, sf), None, "value", max_points=3)
    return points.select(*ROW, "date", "value", "state_label")


@query(
    f"""WITH {CLIMATE}, {TRIMS}, pairs AS (SELECT c.* FROM climate c LEFT JOIN trims t ON t.user_id = c.user_id
  WHERE temp_in IS NOT NULL AND {IN_TRIM}), {_sample_sql('pairs', 30)}
SELECT user_id, event_id, temp_in, temp_out FROM sampled"""
)
def climate_series(spark, sf):
    trimmed = correct.trim_window(climate(spark, sf), trims(spark, sf), K, "ts")
    return reports.climate_series(trimmed, SERIES, "temp_in", "temp_out", 30).select(*ROW, "temp_in", "temp_out")


@query(
    f"""WITH {BOUTS} SELECT user_id, CAST(bout_id AS INTEGER) AS bout_id, upper(state_corrected[1]) || state_corrected[2:] AS state,
  strftime(bout_start, '%Y-%m-%d %H:%M') AS start, strftime(bout_end, '%Y-%m-%d %H:%M') AS "end",
  round(bout_duration / 60 + 1e-8, 6) AS duration_min, CAST(n_readings AS INTEGER) AS n_readings, round(mean_value + 1e-8, 6) AS mean_tof_mm,
  flag_short FROM bouts"""
)
def bout_report(spark, sf):
    return reports.bout_report(bout_table(spark, sf), K, None).withColumns(
        {"duration_min": off_ties("duration_min"), "mean_tof_mm": off_ties("mean_tof_mm")}
    )


@query(
    f"""WITH {BOUTS} SELECT user_id, bout_id, bout_start, bout_end,
  CASE state_corrected WHEN 'present' THEN 0 WHEN 'uncertain' THEN 1 ELSE 2 END AS state_y,
  upper(state_corrected[1]) || state_corrected[2:] || '<br>' || strftime(bout_start, '%H:%M') || ' – ' || strftime(bout_end, '%H:%M')
  || '<br>' || regexp_replace(printf('%.1f', (bout_duration + 6e-7) / 60), '\\.0$', '') || ' min' AS hover_text FROM bouts"""
)
def bout_timeline(spark, sf):
    # the text has minutes of one decimal; the nudge keeps them off ties, which engines round differently
    nudged = bout_table(spark, sf).withColumn("bout_duration", F.col("bout_duration") + 6e-7)
    return reports.bout_timeline(nudged, K)


@query(f"WITH {BOUTS} SELECT DISTINCT user_id, bout_start AS transition FROM bouts WHERE bout_id > 1")
def transitions(spark, sf):
    return reports.transitions(bout_table(spark, sf), K)


@query(SQL["day_summary"])
def day_report(spark, sf):
    return reports.day_report(day_summary(spark, sf), K)


# ---------------------------------------------------------------- text, dates and raw files


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'F' THEN o_orderpriority END,
  o_orderstatus) AS status FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'""",
    "coalesce_blank",
)
def coalesce_blank_text(spark, sf):
    status = F.col("o_orderstatus")
    a = F.when(status == "P", "").when(status == "F", F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", coalesce_blank(a, status).alias("status"))


def date_text() -> F.Column:
    """The order date written in the ways that metadata files use, by priority."""
    d = F.col("o_orderdate")
    by = F.col("o_orderpriority")
    return (
        F.when(by == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
        .when(by == "2-HIGH", F.date_format(d, "dd/MM/yyyy"))
        .when(by == "3-MEDIUM", F.concat(F.date_format(d, "MM/"), F.lit("28/"), F.date_format(d, "yy")))
        .when(by == "4-NOT SPECIFIED", F.lit("  "))
        .otherwise(F.date_format(d, "yyyyMMdd"))
    )


DATE_YEAR = """CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END"""


@query(f"SELECT o_orderkey, {DATE_YEAR} AS year FROM orders",
    "infer_year",
)
def infer_year_text(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", infer_year(date_text()).alias("year"))


@query(
    f"""SELECT o_orderkey AS deployment_id, CASE WHEN o_orderstatus = 'P' AND year(o_orderdate) + 25 BETWEEN 2020 AND 2024
  THEN CAST(year(o_orderdate) + 25 AS INTEGER) ELSE {DATE_YEAR} END AS recording_year FROM orders"""
)
def resolve_year(spark, sf):
    orders = table(spark, sf, "orders")
    deployments = orders.select(F.col("o_orderkey").alias("deployment_id"), date_text().alias("deployment_date"))
    override = orders.where(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("deployment_id"), (F.year("o_orderdate") + 25).alias("year")
    )
    return clean.resolve_year(deployments, override, allowed=(2020, 2024)).select("deployment_id", "recording_year")


@query(
    """WITH texts AS (SELECT o_orderpriority, o_orderkey, o_orderdate,
  CASE WHEN o_totalprice < 20000 THEN 'no clock' ELSE strftime(o_orderdate, '%m-%d %H:%M:%S') END AS stamp FROM orders),
months AS (SELECT *, CASE WHEN stamp <> 'no clock' THEN month(o_orderdate) END AS m FROM texts),
prior AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM months),
counted AS (SELECT *, 1995 + coalesce(sum(CASE WHEN m - pm < -6 THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderpriority
  ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS y FROM prior)
SELECT o_orderkey, try_strptime(CAST(y AS VARCHAR) || '-' || stamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM counted"""
)
def attach_year(spark, sf):
    text = F.when(F.col("o_totalprice") < 20000, "no clock").otherwise(F.date_format("o_orderdate", "MM-dd HH:mm:ss"))
    rows = table(spark, sf, "orders").withColumn("stamp", text)
    o = Ordering(("o_orderpriority",), "o_orderdate", ("o_orderkey",))
    return clean.attach_year(rows, o, "stamp", F.lit(1995)).select("o_orderkey", "timestamp")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderstatus = 'F'
  THEN o_orderdate + INTERVAL '6 hours 30 minutes' ELSE o_orderdate END AS trim_start, o_orderdate + INTERVAL 90 SECOND AS trim_end FROM orders"""
)
def deployment_window(spark, sf):
    d = F.col("o_orderdate")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " ")
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "dd/MM/yyyy"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
        .alias("deployment_date"),
        F.when(F.col("o_orderstatus") == "F", "06:30:00").alias("deployment_time"),
        F.date_format(d, "MM-dd").alias("retrieval_date"),
        F.lit("00:01:30").alias("retrieval_time"),
        F.year(d).alias("recording_year"),
    )
    return clean.deployment_window(rows, "recording_year").select("o_orderkey", "trim_start", "trim_end")


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS latitude,
  CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_nationkey AS DOUBLE) END AS longitude FROM customer"""
)
def parse_coords(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))).otherwise("").alias("latitude"),
        F.when(F.col("c_mktsegment") == "BUILDING", "NaN").otherwise(F.col("c_nationkey").cast("string")).alias("longitude"),
    )
    return night.parse_coords(rows)


@query(
    """SELECT 'dep-' || CAST(user_id AS VARCHAR) AS folder, coalesce(c_name, '?') AS device_id,
  CASE WHEN c_acctbal > 0 THEN '' ELSE 'dep-' END || CAST(user_id AS VARCHAR) AS deployment_id,
  c_mktsegment || '=' || CAST(c_nationkey AS VARCHAR) AS notes
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON c_custkey = user_id"""
)
def read_metadata(spark, sf):
    found = raw.read_metadata(spark, _file(spark, sf, schemas.METADATA_FILE))
    return found.select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "device_id", "deployment_id", "notes")


@query(
    """SELECT doc_id, list_position(lines, line) AS first_line, key, value FROM (
  SELECT doc_id, lines, line, trim(line[:strpos(line, '=') - 1]) AS key, trim(line[strpos(line, '=') + 1:]) AS value
  FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS lines FROM documents), unnest(lines) AS u(line)
  WHERE contains(line, '='))"""
)
def metadata_pairs(spark, sf):
    docs = table(spark, sf, "documents")
    pairs = raw.metadata_pairs(docs, ["doc_id"], "text")
    return pairs.select("doc_id", (F.col("pos") + 1).cast("int").alias("first_line"), "key", "value")


@query(
    """WITH held AS (SELECT user_id, list(DISTINCT CASE WHEN value <= 40 THEN 'README' WHEN event_type = 'view' THEN 'METADATA.TXT'
  WHEN event_type = 'click' THEN 'LOG.CSV' WHEN event_type = 'error' THEN 'DHT.CSV' WHEN event_type = 'purchase' THEN 'TOF.CSV' END) AS names
  FROM events GROUP BY user_id),
gone AS (SELECT 'dep-' || CAST(user_id AS VARCHAR) AS folder, list_sort(list_filter(['METADATA.TXT', 'LOG.CSV', 'DHT.CSV', 'TOF.CSV'],
  lambda f: NOT list_contains(names, f))) AS missing FROM held)
SELECT folder, array_to_string(missing, ', ') AS missing FROM gone WHERE len(missing) > 0"""
)
def require_files(spark, sf):
    found = raw.require_files(raw.list_files(spark, listed_root(spark, sf)))
    return found.select(
        F.element_at(F.split("folder", "/"), -1).alias("folder"), F.array_join("missing", ", ").alias("missing")
    )


def listed_root(spark, sf) -> str:
    """Folders that hold a file for each type of event of a user; those of small values are no device files."""
    kind = F.col("event_type")
    name = F.when(F.col("value") <= 40, "README").when(kind == "view", schemas.METADATA_FILE)
    name = name.when(kind == "click", schemas.LOG_FILE).when(kind == "error", schemas.DHT_FILE)
    name = name.when(kind == "purchase", schemas.TOF_FILE).otherwise("README").alias("name")
    held = events(spark, sf).select(F.concat(F.lit("dep-"), F.col("user_id").cast("string")).alias("folder"), "user_id", name).distinct()
    owners = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    text = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("deployment_id="), "c_name")).otherwise("deployment_id=")
    files = held.join(owners, "user_id", "left").select("folder", "name", F.coalesce(text, F.lit("")).alias("content"))
    return _once(spark, sf, "listed", lambda root: raw.write_files(files, root))


# raw files as text rows, written from the events the way a device would


_RAW: dict[tuple, str] = {}


def _once(spark, sf: str, name: str, make) -> str:
    """A folder below the shared one that ``make`` fills once per application."""
    key = (spark.sparkContext.applicationId, shared_folder(spark), sf, name)
    if key not in _RAW:
        root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        make(root)
        _RAW[key] = root
    return _RAW[key]


def raw_root(spark, sf) -> str:
    """Raw device folders of all users with events, as a device would write them."""
    return _once(spark, sf, "raw", lambda root: raw.write_files(_device_files(spark, sf), root))


SLICE_ROWS = 20_000  # lines of a device file that are put together at a time


def _device_files(spark, sf) -> DataFrame:
    """Texts of the files of all users; those of users with many events in slices."""
    kind, v = F.col("event_type"), F.col("value")
    number = v.cast("string")
    tof = F.when(kind == "error", "-1").when(v > 200, "8190").when(kind == "view", "n/a").otherwise(number)
    lines = {
        schemas.LOG_FILE: [F.when(kind == "signup", "START").otherwise(kind), F.lit("d1"), F.lit("")],
        schemas.DHT_FILE: [F.when(kind != "error", number).otherwise("NaN"), number, F.when(kind != "click", number).otherwise("?"), number],
        schemas.TOF_FILE: [tof, number],
    }
    clock = F.date_format(F.col("ts") - F.expr("INTERVAL 20 DAYS"), "MM-dd HH:mm:ss")
    placed = running(events(spark, sf), SERIES, position="place").drop(BLOCK)
    slices = placed.withColumn("slice", F.floor((F.col("place") - 1) / SLICE_ROWS))
    written = slices.groupBy("user_id", "slice").agg(
        *[F.array_sort(F.collect_list(F.struct("place", F.concat_ws(",", clock, *c).alias("line")))).alias(n) for n, c in lines.items()]
    )
    folder = F.concat(F.lit("dep-"), F.col("user_id").cast("string")).alias("folder")
    sizes = events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    def name(file: str):
        sliced = F.concat(F.lit(f"{file}/"), F.col("slice").cast("string"), F.lit(".csv"))
        return F.when(F.col("n") <= SLICE_ROWS, F.lit(file)).otherwise(sliced).alias("name")

    files = [
        F.struct(name(n), F.concat_ws("\n", F.lit(",".join(ddl.names)), F.col(f"`{n}`.line"), F.lit("")).alias("content"))
        for n, ddl in schemas.RAW_FILES.items()
    ]
    series = written.join(sizes, "user_id").select(folder, F.explode(F.array(*files)).alias("f")).select("folder", "f.*")
    about = F.concat_ws(
        "\r\n", F.lit("METADATA\r\n"), F.concat(F.lit(" device_id = "), F.coalesce("c_name", F.lit("?"))), F.lit("device_id=second"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("deployment_id="), F.col("user_id").cast("string"))),
        F.lit("deployment_date=2023-06-01"), F.concat(F.lit(" notes =  "), "c_mktsegment", F.lit("="), F.col("c_nationkey").cast("string")),
    )
    owners = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    described = sizes.join(owners, "user_id", "left").select(folder, F.lit(schemas.METADATA_FILE).alias("name"), about.alias("content"))
    return series.unionByName(described)


SHIFTED = "date_trunc('second', ts - INTERVAL 20 DAY)"


def _deployments(spark, sf) -> DataFrame:
    return cut(raw.deployment_table(raw.read_metadata(spark, f"{raw_root(spark, sf)}/*/{schemas.METADATA_FILE}")))


def _file(spark, sf, name: str) -> str:
    return f"{raw_root(spark, sf)}/*/{name}"


def _numbered(df: DataFrame) -> DataFrame:
    """The place of a row in its file in place of (src_block, src_row), which depend on how the file was read."""
    placed = running(cut(df), Ordering(("deployment_id",), "src_block", ("src_row",)), position="line")
    return placed.withColumn("line", F.col("line").cast("int"))


STAMPED = f"""firsts AS (SELECT user_id, min(year({SHIFTED})) AS y FROM events GROUP BY 1),
stamped AS (SELECT CASE WHEN c_acctbal > 0 THEN '' ELSE 'dep-' END || CAST(e.user_id AS VARCHAR) AS deployment_id, event_id,
  event_type, value, ts AS real_ts, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS INTEGER) AS line,
  {SHIFTED} + to_years(CAST(2023 - y AS INTEGER)) AS timestamp
  FROM events e JOIN firsts USING (user_id) LEFT JOIN customer c ON c.c_custkey = e.user_id)"""


def _log(spark, sf, deployments: DataFrame) -> DataFrame:
    return cut(raw.read_log(spark, _file(spark, sf, schemas.LOG_FILE), deployments))


@query(
    f"""WITH {STAMPED} SELECT deployment_id, line, timestamp,
  CASE WHEN event_type = 'signup' THEN 'START' ELSE event_type END AS event FROM stamped"""
)
def read_log(spark, sf):
    return _numbered(_log(spark, sf, _deployments(spark, sf))).select("deployment_id", "line", "timestamp", "event")


IN_SESSION = """sess AS (SELECT *, CAST(count(*) FILTER (event_type = 'signup') OVER (PARTITION BY deployment_id ORDER BY timestamp
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS session_id,
  epoch(timestamp) - epoch(lag(timestamp) OVER (PARTITION BY deployment_id ORDER BY timestamp, line)) AS dt_sec FROM stamped)"""


@query(
    f"""WITH {STAMPED}, {IN_SESSION}, nums AS (SELECT *, event_type = 'error' OR value > 200 OR event_type = 'view' AS bad FROM sess)
SELECT deployment_id, line, timestamp, bad AS flag_tof_invalid, CASE WHEN NOT bad THEN value END AS tof_raw_mm,
  CASE WHEN NOT bad THEN value END AS tof_smooth_ema, session_id, dt_sec::DOUBLE AS dt_sec,
  row_number() OVER (PARTITION BY deployment_id, session_id ORDER BY timestamp, line) <= 4 AS flag_ema_warmup FROM nums"""
)
def read_tof(spark, sf):
    deployments = _deployments(spark, sf)
    log = _log(spark, sf, deployments)
    rows = raw.read_tof(spark, _file(spark, sf, schemas.TOF_FILE), deployments, log, cut, warmup_rows=4)
    return _numbered(rows).select(
        "deployment_id", "line", "timestamp", "flag_tof_invalid", "tof_raw_mm",
        "tof_smooth_ema", "session_id", "dt_sec", "flag_ema_warmup",
    )


@query(
    f"""WITH {STAMPED}, {IN_SESSION} SELECT deployment_id, line, timestamp, CASE WHEN event_type <> 'error' THEN value END AS temp_in,
  value AS hum_in, CASE WHEN event_type <> 'click' THEN value END AS temp_out, value AS hum_out, session_id, dt_sec::DOUBLE AS dt_sec,
  event_type IN ('error', 'click') AS flag_dht_bad FROM sess"""
)
def read_dht(spark, sf):
    deployments = _deployments(spark, sf)
    log = _log(spark, sf, deployments)
    return _numbered(raw.read_dht(spark, _file(spark, sf, schemas.DHT_FILE), deployments, log, cut)).select(
        "deployment_id", "line", "timestamp", "temp_in", "hum_in", "temp_out", "hum_out",
        "session_id", "dt_sec", "flag_dht_bad",
    )


# ---------------------------------------------------------------- the whole chain

# distances of a few units' spread, rare boots, and warm-up of two rows, so that the
# sparse stand-in series keep enough signal
CHAIN = f"""raw AS (SELECT *, CASE WHEN event_type = 'error' THEN -1.0 WHEN value > 200 THEN 8190.0 ELSE value / 10 END AS mm FROM events),
with_session AS (SELECT r.*, mm IN (-1, 8190) AS flag_tof_invalid, CAST(count(*) FILTER (event_type = 'signup' AND value > 60)
  OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS session_id FROM raw r),
tof AS (SELECT * REPLACE (CASE WHEN NOT flag_tof_invalid THEN mm END AS mm),
  row_number() OVER (PARTITION BY user_id, session_id ORDER BY ts, event_id) <= 2 AS flag_ema_warmup FROM with_session),
masked AS (SELECT *, CASE WHEN NOT flag_ema_warmup THEN mm END AS x FROM tof),
smooth AS (SELECT *, CASE WHEN count(x) OVER w = 3 THEN median(x) OVER w END AS smooth FROM masked
  WINDOW w AS (PARTITION BY user_id, session_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{SUN},
nightly AS (SELECT m.*, coalesce(s.polar = 'night', false) OR coalesce(m.ts < s.sunrise OR m.ts > s.sunset, false) AS is_night
  FROM smooth m LEFT JOIN sun s ON s.user_id = m.user_id AND s.date = CAST(m.ts AS DATE)),
signal AS (SELECT user_id, ts, event_id, smooth AS x FROM nightly
  WHERE NOT flag_tof_invalid AND NOT flag_ema_warmup AND smooth IS NOT NULL AND NOT is_night),
nums AS (SELECT user_id, ts, event_id, x, row_number() OVER w AS p, count(*) OVER (PARTITION BY user_id) AS n,
  sum(x) OVER w AS s1, sum(x * x) OVER w AS s2 FROM signal
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
series AS (SELECT user_id, any_value(n) AS n, list_prepend(0.0::DOUBLE, list(s1 ORDER BY p)) AS c1,
  list_prepend(0.0::DOUBLE, list(s2 ORDER BY p)) AS c2 FROM nums WHERE n >= 10 GROUP BY user_id),
dp AS (
  SELECT user_id, n, c1, c2, 0::BIGINT AS t, [-(3 * ln(n))] AS f, []::BIGINT[] AS prev FROM series
  UNION ALL
  SELECT user_id, n, c1, c2, t + 1, list_append(f, list_min(cand) + 3 * ln(n)),
    list_append(prev, (list_position(cand, list_min(cand)) - 1)::BIGINT)
  FROM (SELECT *, list_transform(range(0, t + 1), lambda s: f[s + 1] + (c2[t + 2] - c2[s + 1])
      - (c1[t + 2] - c1[s + 1]) * (c1[t + 2] - c1[s + 1]) / (t + 1 - s) + ln((t + 1 - s) / n)) AS cand FROM dp WHERE t < n) step),
trail AS (SELECT user_id, prev, n AS pos, n FROM dp WHERE t = n
  UNION ALL SELECT user_id, prev, prev[pos], n FROM trail WHERE prev[pos] > 0),
cuts AS (SELECT user_id, pos, 1 AS cut FROM trail WHERE pos < n),
segmented AS (SELECT nums.*, CAST(1 + coalesce(sum(cut) OVER (PARTITION BY nums.user_id ORDER BY p
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS segment_id
  FROM nums LEFT JOIN cuts ON cuts.user_id = nums.user_id AND cuts.pos + 1 = nums.p),
segs AS (SELECT user_id, segment_id, median(x) AS seg_median FROM segmented GROUP BY 1, 2),
{KMEANS.split("," + chr(10), 1)[0].replace(SEGMENTS + ", ", "")},
{KMEANS.split("," + chr(10), 1)[1]},
classes AS (SELECT s.user_id, s.segment_id, CASE WHEN NOT v.viable OR c.c IS NULL THEN 'uncertain'
  WHEN s.seg_median < (c.c.lo + c.c.hi) / 2 - 0.3 * (c.c.hi - c.c.lo) / 2 THEN 'present'
  WHEN s.seg_median > (c.c.lo + c.c.hi) / 2 + 0.3 * (c.c.hi - c.c.lo) / 2 THEN 'absent' ELSE 'uncertain' END AS state_auto
  FROM segs s JOIN viable v USING (user_id) LEFT JOIN centres c USING (user_id)),
readings AS (SELECT r.user_id, r.event_id, r.ts, r.smooth AS value, g.segment_id,
  CASE WHEN r.is_night THEN 'present' ELSE c.state_auto END AS state,
  CASE WHEN r.is_night THEN 'night_auto' WHEN c.state_auto IS NOT NULL THEN 'auto' END AS correction_source
  FROM nightly r LEFT JOIN segmented g ON g.event_id = r.event_id
  LEFT JOIN classes c ON c.user_id = g.user_id AND c.segment_id = g.segment_id),
{RUNS.replace(READINGS + "," + chr(10), "")},
{BOUTS_SELECT}"""


def fleet(spark, sf) -> dict[str, DataFrame]:
    """Clean tables and deployments in the library's own schemas, from the events."""
    kind, v = F.col("event_type"), F.col("value")
    rows = events(spark, sf).select(
        F.col("user_id").cast("string").alias("deployment_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("src_block"),
        F.lit(0).cast("long").alias("src_row"),
        "event_type",
        "value",
    )
    boots = rows.where((kind == "signup") & (v > 60))
    raw_mm = F.when(kind == "error", -1.0).when(v > 200, 8190.0).otherwise(v / 10)
    tof = clean.flag_invalid(
        rows.select(*raw.READING_ORDER.row_id, raw_mm.alias("tof_raw_mm"), v.alias("tof_smooth_ema")),
        "tof_raw_mm",
        ["tof_smooth_ema"],
    )
    tof = clean.flag_warmup(clean.session_columns(tof, boots, raw.READING_ORDER), raw.READING_ORDER, n=2)
    dht = clean.flag_any_missing(rows.select(*raw.READING_ORDER.row_id, F.when(kind != "error", v).alias("temp_in")), ["temp_in"])
    deployments = places(spark, sf).join(trims(spark, sf), "user_id").select(
        F.col("user_id").cast("string").alias("deployment_id"),
        "latitude",
        "longitude",
        "trim_start",
        "trim_end",
        *[F.lit(None).cast("string").alias(c) for c in ("device_id", "nestbox", "species")],
    )
    log = boots.select(*raw.READING_ORDER.row_id, F.lit("START").alias("event"))
    return {"deployments": deployments, "tof_clean": cut(tof), "dht_clean": dht, "log_clean": log}


def _chain(spark, sf) -> dict[str, DataFrame]:
    params = pipeline.Params(classification_method="kmeans")
    return pipeline.process(**fleet(spark, sf), params=params)


@query(
    f"""WITH RECURSIVE {CHAIN} SELECT CAST(r.user_id AS VARCHAR) AS deployment_id, r.event_id, round(r.value, 6) AS tof_smooth_r,
  r.segment_id, r.state AS state_corrected, r.correction_source, b.bout_id
FROM runs r LEFT JOIN bouts b ON b.user_id = r.user_id AND b.state_run = r.state_run"""
)
def process_pipeline(spark, sf):
    return _chain(spark, sf)["tof_processed"].select(
        "deployment_id", F.col("src_block").alias("event_id"), r6(F.col("tof_smooth_r"), "tof_smooth_r"),
        "segment_id", "state_corrected", "correction_source", "bout_id",
    )


EXPORT = f"""{HITS}, {AUTO}, {TRIMS}, winner AS (SELECT event_id, arg_max(action, seq) AS action FROM hits GROUP BY event_id),
readings AS (SELECT a.user_id, a.event_id, a.ts, a.value, CASE WHEN action = 'reset' THEN state_auto ELSE coalesce(action, state_auto) END AS state
  FROM auto a LEFT JOIN winner USING (event_id) LEFT JOIN trims t ON t.user_id = a.user_id WHERE {IN_TRIM}),
{BOUTS.replace(READINGS + "," + chr(10), "")}"""


CORRECTED = f"""{HITS}, {AUTO}, winner AS (SELECT event_id, arg_max(action, seq) AS action FROM hits GROUP BY event_id),
fresh AS (SELECT DISTINCT user_id FROM boxes WHERE seq % 3 = 0),
readings AS (SELECT a.user_id, a.event_id, a.ts, a.value, CASE WHEN action = 'reset' THEN state_auto ELSE coalesce(action, state_auto) END AS state
  FROM auto a JOIN fresh USING (user_id) LEFT JOIN winner USING (event_id)),
{BOUTS.replace(READINGS + "," + chr(10), "")}"""


def _refreshed(spark, sf) -> dict[str, DataFrame]:
    """Two thirds of the boxes are in the bouts and days already, the others are new."""
    rows, every = cut(auto_states(spark, sf)), cut(boxes(spark, sf))
    new = F.col("seq") % 3 == 0
    before = cut(correct.apply_corrections(rows, every.where(~new), SERIES, "value"))
    table = cut(bt.bouts(before, SERIES, "state_corrected", "value", SHORT))
    days = summary.day_summary(before, table, K, "ts", None, digits=None)
    return refresh.refresh(before, table, days, every.where(new), every, SERIES, None, "value", min_bout_sec=SHORT, digits=None)


@query(f"WITH {CORRECTED} SELECT {BOUT_COLUMNS} FROM bouts")
def refresh_bouts(spark, sf):
    return _bout_columns(_refreshed(spark, sf)["bouts"])


@query(
    f"""WITH {CORRECTED}, {DATED}, {_stats_sql("dated")}, {SPINE} SELECT user_id, date, 24.0::DOUBLE AS day_length_h, {DAY_COLUMNS}
FROM (SELECT *, 86400 AS day_sec FROM spine) LEFT JOIN stats USING (user_id, date)"""
)
def refresh_days(spark, sf):
    return _day_columns(_refreshed(spark, sf)["days"])


def _before_export(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed readings, climate and corrections."""
    names = {"user_id": "deployment_id", "ts": "timestamp", "event_id": "src_block", "value": "tof_smooth_r"}
    tof = auto_states(spark, sf).withColumnsRenamed(names)
    tof = tof.withColumns(
        {
            "deployment_id": F.col("deployment_id").cast("string"),
            "src_row": F.lit(0).cast("long"),
            "bout_id": F.dayofmonth("timestamp").cast("long"),
            "session_id": F.lit(1),
            "session_row": F.lit(None).cast("long"),
            "segment_id": F.lit(None).cast("int"),
            "dt_sec": F.lit(None).cast("double"),
            "tof_raw_mm": F.col("tof_smooth_r"),
            "tof_smooth_ema": F.col("tof_smooth_r"),
            "flag_tof_invalid": F.lit(False),
            "flag_ema_warmup": F.lit(False),
        }
    )
    dht = tof.select("deployment_id", "timestamp", "src_block", "src_row", F.lit(False).alias("flag_dht_bad"))
    orders = boxes(spark, sf).withColumnRenamed("user_id", "deployment_id")
    orders = orders.withColumn("deployment_id", F.col("deployment_id").cast("string"))
    return tof, dht, orders


def fleet_places(spark, sf) -> DataFrame:
    located = places(spark, sf).join(trims(spark, sf), "user_id")
    return located.withColumnRenamed("user_id", "deployment_id").withColumns(
        {
            "deployment_id": F.col("deployment_id").cast("string"),
            **{c: F.lit(None).cast("string") for c in ("device_id", "nestbox", "species")},
        }
    )


@query(
    f"""WITH {EXPORT} SELECT CAST(r.user_id AS VARCHAR) AS deployment_id, r.event_id, r.state AS state_corrected,
  CAST(day(r.ts) AS BIGINT) AS bout_id_auto, b.bout_id AS bout_id_corrected
FROM runs r LEFT JOIN bouts b ON b.user_id = r.user_id AND b.state_run = r.state_run"""
)
def export_corrected(spark, sf):
    tof, dht, orders = _before_export(spark, sf)
    exported = pipeline.export_corrected({"tof_processed": tof, "dht_processed": dht}, fleet_places(spark, sf), None, orders)
    return exported["tof_processed"].select(
        "deployment_id", F.col("src_block").alias("event_id"), "state_corrected", "bout_id_auto", "bout_id_corrected"
    )


# sets of tables, written once per session by the library's own writers; each of their tables is a query


def _clean_set(spark, sf) -> dict[str, DataFrame]:
    def make(root: str) -> None:
        deployments = _deployments(spark, sf)
        log = _log(spark, sf, deployments)
        dht = raw.read_dht(spark, _file(spark, sf, schemas.DHT_FILE), deployments, log, cut)
        tof = raw.read_tof(spark, _file(spark, sf, schemas.TOF_FILE), deployments, log, cut, warmup_rows=4)
        tables.write_clean({"log_clean": log, "dht_clean": dht, "tof_clean": tof}, root, ids=deployments)

    return tables.load_clean(spark, _once(spark, sf, "clean", make))


def _processed_set(spark, sf) -> dict[str, DataFrame]:
    root = _once(spark, sf, "processed", lambda root: tables.write_processed(_chain(spark, sf), root, ids=fleet_places(spark, sf)))
    return tables.load_processed(spark, root)


def _exported_set(spark, sf) -> dict[str, DataFrame]:
    def make(root: str) -> None:
        tof, dht, orders = _before_export(spark, sf)
        log = boot_log(spark, sf).select(F.col("user_id").cast("string").alias("deployment_id"), F.col("ts").alias("timestamp"), "event")
        found = {"tof_processed": tof, "dht_processed": dht, "deployments": fleet_places(spark, sf), "log_clean": log}
        tables.write_tables(found, f"{root}/in")
        pipeline.export_all(spark, f"{root}/in", root, orders, min_bout_sec=SHORT)

    return tables.load_processed(spark, _once(spark, sf, "exported", make), exported=True)


DAY_SET = """SELECT CAST(p.user_id AS VARCHAR) AS deployment_id, p.date, strftime(u.sunrise, '%H:%M') AS sunrise,
  strftime(u.sunset, '%H:%M') AS sunset, first_off_start, last_off_end, CAST(coalesce(n_on_bouts, 0) AS INTEGER) AS n_on_bouts,
  CAST(coalesce(n_off_bouts, 0) AS INTEGER) AS n_off_bouts
FROM spine p LEFT JOIN sun u ON u.user_id = p.user_id AND u.date = p.date LEFT JOIN stats s ON s.user_id = p.user_id AND s.date = p.date"""
LIT = """lit AS (SELECT b.*, CAST(bout_start AS DATE) AS date FROM bouts b LEFT JOIN sun s ON s.user_id = b.user_id
  AND s.date = CAST(b.bout_start AS DATE) WHERE coalesce(polar, 'day') = 'day' AND coalesce(bout_start BETWEEN s.sunrise AND s.sunset, true))"""
DAY_SET_COLUMNS = ["deployment_id", "date", "sunrise", "sunset", "first_off_start", "last_off_end", "n_on_bouts", "n_off_bouts"]
BOUT_SET_COLUMNS = ["deployment_id", "bout_id", "state_corrected", "bout_start", "bout_end", "n_readings"]
BOUT_SET = """SELECT CAST(user_id AS VARCHAR) AS deployment_id, bout_id, state_corrected, bout_start, bout_end, n_readings FROM bouts"""


@query(f"WITH RECURSIVE {CHAIN} {BOUT_SET}")
def load_processed(spark, sf):
    return _processed_set(spark, sf)["bout_summary"].select(*BOUT_SET_COLUMNS)


@query(SQL["process_pipeline"])
def write_processed(spark, sf):
    return _processed_set(spark, sf)["tof_processed"].select(
        "deployment_id", F.col("src_block").alias("event_id"), r6(F.col("tof_smooth_r"), "tof_smooth_r"),
        "segment_id", "state_corrected", "correction_source", "bout_id",
    )


@query(f"WITH RECURSIVE {CHAIN}, {LIT}, {_stats_sql('lit')}, {SPINE} {DAY_SET}")
def write_processed_days(spark, sf):
    return _processed_set(spark, sf)["day_summary"].select(*DAY_SET_COLUMNS)


@query(
    f"""WITH {CHAIN.split("masked AS", 1)[0].rstrip().rstrip(",")},
booted AS (SELECT user_id, count(*) - 1 AS n FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY user_id)
SELECT CAST(t.user_id AS VARCHAR) AS deployment_id, min(ts) AS first_timestamp, max(ts) AS last_timestamp,
  CAST(count(DISTINCT session_id) AS INTEGER) AS n_sessions, CAST(any_value(b.n) AS INTEGER) AS n_reboots, count(*) AS n_tof_total,
  count(*) FILTER (flag_tof_invalid) AS n_tof_invalid, count(*) FILTER (flag_ema_warmup) AS n_tof_warmup,
  count(*) FILTER (event_type = 'error') AS n_dht_bad FROM tof t LEFT JOIN booted b ON b.user_id = t.user_id GROUP BY t.user_id"""
)
def write_processed_devices(spark, sf):
    return _processed_set(spark, sf)["device_summary"].select(
        "deployment_id", "first_timestamp", "last_timestamp", "n_sessions", "n_reboots", "n_tof_total",
        "n_tof_invalid", "n_tof_warmup", "n_dht_bad",
    )


@query(
    """SELECT CAST(user_id AS VARCHAR) AS deployment_id, event_id, ts AS timestamp, CASE WHEN event_type <> 'error' THEN value END AS temp_in,
  event_type = 'error' AS flag_dht_bad FROM events"""
)
def write_processed_climate(spark, sf):
    return _processed_set(spark, sf)["dht_processed"].select(
        "deployment_id", F.col("src_block").alias("event_id"), "timestamp", "temp_in", "flag_dht_bad"
    )


@query(f"WITH {EXPORT} {BOUT_SET}")
def export_all(spark, sf):
    return _exported_set(spark, sf)["bout_summary"].select(*BOUT_SET_COLUMNS)


@query(SQL["export_corrected"])
def export_all_readings(spark, sf):
    return _exported_set(spark, sf)["tof_processed"].select(
        "deployment_id", F.col("src_block").alias("event_id"), "state_corrected", "bout_id_auto", "bout_id_corrected"
    )


@query(f"WITH {EXPORT}, {SUN}, {LIT}, {_stats_sql('lit')}, {SPINE} {DAY_SET}")
def export_all_days(spark, sf):
    return _exported_set(spark, sf)["day_summary"].select(*DAY_SET_COLUMNS)


@query(
    f"""WITH {TRIMS}, kept AS (SELECT e.* FROM events e LEFT JOIN trims t ON t.user_id = e.user_id WHERE {IN_TRIM}),
booted AS (SELECT user_id, count(*) FILTER (event_type = 'signup') - 1 AS n FROM events GROUP BY user_id)
SELECT CAST(k.user_id AS VARCHAR) AS deployment_id, min(ts) AS first_timestamp, max(ts) AS last_timestamp,
  CAST(any_value(n) AS INTEGER) AS n_reboots, count(*) AS n_tof_total FROM kept k JOIN booted b ON b.user_id = k.user_id GROUP BY k.user_id"""
)
def export_all_devices(spark, sf):
    return _exported_set(spark, sf)["device_summary"].select("deployment_id", "first_timestamp", "last_timestamp", "n_reboots", "n_tof_total")


@query(
    f"""WITH {TRIMS} SELECT CAST(e.user_id AS VARCHAR) AS deployment_id, event_id, ts AS timestamp
FROM events e LEFT JOIN trims t ON t.user_id = e.user_id WHERE {IN_TRIM}"""
)
def export_all_climate(spark, sf):
    return _exported_set(spark, sf)["dht_processed"].select("deployment_id", F.col("src_block").alias("event_id"), "timestamp")


@query(SQL["read_log"])
def write_clean(spark, sf):
    return _numbered(_clean_set(spark, sf)["log_clean"]).select("deployment_id", "line", "timestamp", "event")


@query(SQL["read_tof"])
def write_clean_readings(spark, sf):
    return _numbered(_clean_set(spark, sf)["tof_clean"]).select(
        "deployment_id", "line", "timestamp", "flag_tof_invalid", "tof_raw_mm",
        "tof_smooth_ema", "session_id", "dt_sec", "flag_ema_warmup",
    )


@query(SQL["read_dht"])
def write_clean_climate(spark, sf):
    return _numbered(_clean_set(spark, sf)["dht_clean"]).select(
        "deployment_id", "line", "timestamp", "temp_in", "hum_in", "temp_out", "hum_out",
        "session_id", "dt_sec", "flag_dht_bad",
    )


@query(
    f"""WITH {STAMPED} SELECT deployment_id, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
  CAST(count(*) FILTER (event_type = 'signup') - 1 AS INTEGER) AS n_reboots, count(*) AS n_tof_total,
  count(*) FILTER (event_type IN ('error', 'view') OR value > 200) AS n_tof_invalid,
  count(*) FILTER (event_type IN ('error', 'click')) AS n_dht_bad FROM stamped GROUP BY 1"""
)
def load_or_process(spark, sf):
    source = raw_root(spark, sf)
    out = _once(spark, sf, "out", lambda root: pipeline.load_or_process(spark, source, root))
    done = tables.load_table(spark, out, "device_summary", schemas.DEVICES).join(tables.load_manifest(spark, out), "deployment_id")
    return done.select("deployment_id", "first_timestamp", "last_timestamp", "n_reboots", "n_tof_total", "n_tof_invalid", "n_dht_bad")


@query(
    """WITH held AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_type <> 'signup' AND value > 40) AS files
  FROM events GROUP BY user_id)
SELECT 'dep-' || CAST(user_id AS VARCHAR) AS folder, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'dep-' || CAST(user_id AS VARCHAR)
  END AS deployment_id FROM held LEFT JOIN customer ON c_custkey = user_id WHERE files = 4"""
)
def discover_deployments(spark, sf):
    found = raw.discover_deployments(spark, listed_root(spark, sf))
    return found.select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "deployment_id")
