"""Window, time-series, interval and sequence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import arrays
from tessera.operators import intervals, windows
from tessera.streaming import queues, sessions

_DAILY = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS p, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query(f"{_DAILY} SELECT p, day, total, round((total / lag(total) OVER (PARTITION BY p ORDER BY day) - 1) * 100, 4) AS total_pct FROM d")
def ts_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.pct_change(_daily(spark, sf_dir), ["total"], ["p"], ["day"], percent=True)
    return out.withColumn("total_pct", F.round("total_pct", 4)).select("p", "day", "total", "total_pct")


@query(f"{_DAILY} SELECT p, round(arg_max(total, day) / arg_min(total, day) - 1, 6) AS total_change FROM d GROUP BY p")
def ts_first_last_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.first_last_change(_daily(spark, sf_dir), ["total"], ["p"], "day")
    return out.select("p", F.round("total_change", 6).alias("total_change"))


_ROLL = "OVER (PARTITION BY p ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(
    f"{_DAILY}, r AS (SELECT p, day, row_number() OVER (PARTITION BY p ORDER BY day) AS n, min(total) {_ROLL} AS a, max(total) {_ROLL} AS b, median(total) {_ROLL} AS c, avg(total) {_ROLL} AS d, stddev_samp(total) {_ROLL} AS e FROM d)"
    " SELECT p, day, CASE WHEN n >= 7 THEN a END AS total_min_7, CASE WHEN n >= 7 THEN b END AS total_max_7, round(CASE WHEN n >= 7 THEN c END, 2) AS total_median_7,"
    " round(CASE WHEN n >= 7 THEN d END, 2) AS total_mean_7, round(CASE WHEN n >= 7 THEN e END, 2) AS total_std_7 FROM r"
)
def ts_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over the last seven days, null until there are seven."""
    out = windows.rolling(_daily(spark, sf_dir), ["total"], [7], ["p"], ["day"])
    return out.select("p", "day", "total_min_7", "total_max_7", *[F.round(f"total_{s}_7", 2).alias(f"total_{s}_7") for s in ("median", "mean", "std")])


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS value_mean_5 FROM events")
def ts_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.moving_average(_events(spark, sf_dir), "value", 5, ["user_id"], ["event_id"])
    return out.select("event_id", F.round("value_mean_5", 6).alias("value_mean_5"))


@query("SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS value FROM events")
def ts_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shift(_events(spark, sf_dir), ["value"], 2, ["user_id"], ["event_id"]).select("event_id", "value")


@query(
    """WITH w AS (SELECT user_id, row_number() OVER o AS pos, list(value) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS past, list(value) OVER (o ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS future
    FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, pos, past, future FROM w WHERE len(past) = 3 AND len(future) = 2 AND (pos - 3) % 2 = 0"""
)
def ts_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of three past and two future values, every second row."""
    out = windows.windows(_events(spark, sf_dir), "value", 3, 2, ["user_id"], ["event_id"], step=2)
    return out.select("user_id", F.col("pos").cast("bigint").alias("pos"), "past", "future")


@query(
    """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL), k AS (SELECT *, floor(date_diff('day', day, DATE '2024-01-30') / 7) AS k FROM e)
    SELECT event_type, DATE '2024-01-30' - CAST(k * 7 AS INTEGER) AS week_end, round(arg_min(v, day), 4) AS first, round(arg_max(v, day), 4) AS last, round(arg_max(v, day) / arg_min(v, day) - 1, 6) AS change
    FROM k WHERE date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND 27 GROUP BY event_type, k"""
)
def ts_weekly_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    out = windows.weekly_change(daily, "day", "v", "2024-01-30", 28, by=["event_type"])
    return out.select("event_type", "week_end", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), F.round("change", 6).alias("change"))


@query(
    """WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT a.event_id, coalesce(min(b.i) - any_value(a.i), -1) AS steps_to_larger FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.i > a.i AND b.value > a.value GROUP BY a.event_id"""
)
def ts_next_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.next_larger(_events(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("event_id", "steps_to_larger")


@query(
    "SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS m FROM events) WHERE m IS NULL OR value > m"
)
def ts_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above all later ones of the user."""
    return windows.records(_events(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("event_id")


@query(
    "SELECT event_id, (max({'v': value, 'e': event_id}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)).e AS max_pos FROM events"
)
def ts_side_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.side_max(_events(spark, sf_dir), "value", "event_id", ["user_id"]).select("event_id", "max_pos")


@query(
    """WITH m AS (SELECT user_id, row_number() OVER w AS i, coalesce(value > lag(value) OVER w, false) AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    g AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM m), r AS (SELECT user_id, g, count(*) AS length, min(i) - 1 AS start FROM g GROUP BY ALL)
    SELECT user_id, length, start FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1"""
)
def ts_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.longest_run(_events(spark, sf_dir), "value", ["user_id"], ["event_id"])
    return out.select("user_id", "length", F.col("start").cast("bigint").alias("start"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS running FROM orders")
def ts_global_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over the whole table, on all tasks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return windows.global_running(o, "v", "o_orderkey").select("o_orderkey", F.round(F.col("running").cast("double"), 2).alias("running"))


@query(
    "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE (a IS NULL OR value > a) AND (b IS NULL OR value > b)"
)
def ts_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.local_extremes(_events(spark, sf_dir), "value", ["user_id"], ["event_id"]).select("event_id")


@query(
    """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, s"""
)
def ts_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events at most two hours apart."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.sessions(e, "ts", ["user_id"], 7200)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(
    """SELECT a.event_id, b.value AS last_view FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'purchase'"""
)
def ts_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the value of the user's last view."""
    e = _events(spark, sf_dir)
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return windows.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["last_view"]).select("event_id", "last_view")


@query(
    "SELECT CASE WHEN p_retailprice < 920 THEN '-inf' WHEN p_retailprice < 980 THEN '920' WHEN p_retailprice < 1050 THEN '980' ELSE '1050' END AS bin, count(*) AS n FROM part GROUP BY ALL"
)
def ts_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(windows.bins(F.col("p_retailprice"), [920, 980, 1050]).alias("bin")).agg(F.count("*").alias("n"))


# ---- intervals

_SPANS = "WITH i AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS b FROM events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("user_id", start.alias("a"), (start + F.round(F.col("value") * 100).cast("bigint") * 600000).alias("b"))


@query(
    f"""{_SPANS}, n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM i),
    g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, g"""
)
def intervals_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_spans(spark, sf_dir), "a", "b", ["user_id"]).select("user_id", "a", "b")


@query(f"{_SPANS} SELECT user_id, max(n) AS peak FROM (SELECT x.user_id, x.a, count(*) AS n FROM i x JOIN i y ON x.user_id = y.user_id AND y.a <= x.a AND (y.b > x.a OR y.a = y.b AND y.a = x.a) GROUP BY x.user_id, x.a) GROUP BY user_id")
def intervals_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a user's intervals are open at once."""
    return intervals.max_overlap(_spans(spark, sf_dir), "a", "b", ["user_id"])


@query(f"{_SPANS} SELECT user_id, bool_or(coalesce(a < m, false)) AS overlap FROM (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i) GROUP BY user_id")
def intervals_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.has_overlap(_spans(spark, sf_dir), "a", "b", ["user_id"])


@query(
    f"{_SPANS} SELECT x.user_id, x.a, x.b, y.a AS c, y.b AS d FROM i x JOIN i y ON x.user_id = y.user_id AND x.a <= y.b AND y.a <= x.b AND x.a < y.a"
)
def intervals_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's intervals that share a point, the earlier one first."""
    x = _spans(spark, sf_dir)
    return intervals.interval_join(x, x.toDF("user_id", "c", "d"), "a", "b", "c", "d", 3.6e9, ["user_id"]).where("a < c").select("user_id", "a", "b", "c", "d")


# ---- queues, streams


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos FROM events")
def queue_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = queues.fifo(_events(spark, sf_dir), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "pos")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT event_type, max_by(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY event_type")
def queue_peek_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.peek(_events(spark, sf_dir), -1, "event_type", ["ts", "event_id"]).select("event_type", "event_id")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY")
def sessions_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users idle for longer than a day."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = sessions.idle_at(e, "user_id", "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 86400)
    return out.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.windowed(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), by=["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(
    "SELECT event_type, min(event_id) AS event_id, count(*) - 1 AS suppressed FROM (SELECT *, floor(epoch_us(ts) / 3600000000) AS s, first_value(event_id) OVER (PARTITION BY event_type, floor(epoch_us(ts) / 3600000000) ORDER BY ts, event_id) AS f FROM events) GROUP BY event_type, s"
)
def log_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each type in every hour."""
    e = _events(spark, sf_dir).select("event_type", "ts", "event_id")
    return sessions.rate_limited(e, "event_type", "ts", 3600).select("event_type", "event_id", "suppressed")


# ---- sequences in arrays


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in order, centred, as one array."""
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("r"))
    return e.select("user_id", F.transform("r", lambda x: F.round(x["value"] - 10, 2)).alias("v"))


_ARRAYS = "WITH a AS (SELECT user_id, list(round(value - 10, 2) ORDER BY event_id) AS v FROM events GROUP BY user_id)"


@query(
    f"""{_ARRAYS}, p AS (SELECT user_id, i, list_sum(v[1:i]) AS s FROM a, LATERAL (SELECT unnest(generate_series(1, len(v))) AS i)),
    z AS (SELECT user_id, 0 AS i, 0.0 AS s FROM a UNION ALL SELECT * FROM p), m AS (SELECT user_id, i, s, min(s) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM z)
    SELECT user_id, round(max(s - low), 4) AS total FROM m WHERE low IS NOT NULL GROUP BY user_id"""
)
def seq_max_subarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest sum of a stretch of each user's values."""
    return _arrays(spark, sf_dir).select("user_id", F.round(arrays.max_subarray_sum(F.col("v"))["total"], 4).alias("total"))


@query(f"{_ARRAYS} SELECT user_id, len(v) AS n, list_distinct(v) IS NOT NULL AS some, v[1] AS first, v[-1] AS last FROM a")
def seq_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _arrays(spark, sf_dir).select("user_id", F.size(v).cast("bigint").alias("n"), arrays.distinct(v).isNotNull().alias("some"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"))


@query(
    f"""{_ARRAYS}, p AS (SELECT user_id, v, unnest(range(1, len(v) + 1)) AS i FROM a), b AS (SELECT user_id, i, sum(CASE WHEN i > 1 AND v[i] > v[i - 1] THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS k FROM p),
    r AS (SELECT user_id, count(*) AS length, min(i) - 1 AS start FROM b GROUP BY user_id, k) SELECT user_id, length, start FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1"""
)
def seq_longest_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = arrays.longest_increasing_run(F.col("v"))
    return _arrays(spark, sf_dir).select("user_id", run["length"].alias("length"), run["start"].alias("start"))
