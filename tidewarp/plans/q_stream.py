"""Registered queries: period messages and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarp.operators import reshape as X
from tidewarp.operators.assign import assign
from tidewarp.plans import oracle as O
from tidewarp.plans.catalog import ORACLE_CFG, _oracle_fit, fx1_fit, r6, register
from tidewarp.plans.q_basic import dflat, flat
from tidewarp.session import read_table, session_key, staging_path
from tidewarp.sources.tables import FX1, fx1_panel, fx3_panel, positions
from tidewarp.streaming import stream as T

L, WINDOW = 12, FX1.window
_DONE: dict = {}


def dense_panel(spark, sf_dir) -> DataFrame:
    d = X.dense_series(fx1_panel(spark, sf_dir), positions(spark, sf_dir))
    return d.select("id", F.posexplode("series").alias("pos", "value"))


def _ddense(q, sfx: str = "_m"):
    p = O.fx1_panel(q, name="panel" + sfx)
    d = O.dense(q, p, name="dense" + sfx)
    return q.add("long" + sfx, f"""SELECT id, CAST(unnest(range(len(series))) AS INTEGER) AS pos, unnest(series) AS value
FROM {d}""")


def _sql_t1():
    q = O.Sql()
    lg = _ddense(q)
    return q.render(f"""SELECT pos AS time_point, CAST(floor(id / {T.MESSAGE_BLOCK}) AS BIGINT) AS block,
  CAST(pos AS VARCHAR) || chr(10) || string_agg(printf('%d,%.4f', id, round_even(value, 4)), chr(10) ORDER BY id) AS message
FROM {lg} GROUP BY pos, floor(id / {T.MESSAGE_BLOCK})""")


@register("t1_encode_period_messages", _sql_t1())
def t1(spark, sf_dir):
    return T.encode_messages(dense_panel(spark, sf_dir))


def _sql_t2():
    q = O.Sql()
    lg = _ddense(q)
    return q.render(f"SELECT pos AS time_point, id, round_even(value, 4) AS value FROM {lg}")


@register("t2_decode_period_messages", _sql_t2())
def t2(spark, sf_dir):
    msgs = T.encode_messages(dense_panel(spark, sf_dir))
    return T.decode_messages(msgs.select(F.col("message").alias("value")))


def feed(spark, sf_dir) -> str:
    key = ("feed", session_key(spark), sf_dir)
    if key not in _DONE:
        path = staging_path(spark, "feed")
        T.write_feed(T.encode_messages(dense_panel(spark, sf_dir)), path)
        _DONE[key] = path
    return _DONE[key]


def streamed_windows(spark, sf_dir) -> DataFrame:
    key = ("windows", session_key(spark), sf_dir)
    if key not in _DONE:
        src = T.read_feed_stream(spark, feed(spark, sf_dir), files_per_trigger=16)
        wins = T.windowed_series(T.decode_messages(src, "message"), WINDOW, L)
        out = staging_path(spark, "stream-windows")
        T.run_to_table(wins, out, staging_path(spark, "stream-ckpt"))
        _DONE[key] = out
    return spark.read.parquet(_DONE[key])


def _sql_t4():
    q = O.Sql()
    lg = _ddense(q)
    d = q.add("d4", f"SELECT id, list(round_even(value, 4) ORDER BY pos) AS series FROM {lg} GROUP BY id")
    w = q.add("w4", f"""SELECT CAST(t.tp AS INTEGER) AS time_point, d.id, d.series[t.tp + 1 : t.tp + {WINDOW}] AS series_full
FROM {d} d CROSS JOIN (SELECT unnest(range(0, (SELECT max(len(series)) - {WINDOW - 1} FROM {d}))) AS tp) t""")
    return q.render(dflat(w, ["time_point", "id"], "series_full"))


@register("t3_t4_t5_t7_stream_sliding_windows", _sql_t4())
def t4(spark, sf_dir):
    return flat(streamed_windows(spark, sf_dir), ["time_point", "id"], "series_full")


def _sql_t6(final=None):
    q, s, c, a = _oracle_fit()
    lg = _ddense(q)
    d = q.add("d4", f"SELECT id, list(round_even(value, 4) ORDER BY pos) AS series FROM {lg} GROUP BY id")
    w = q.add("w4", f"""SELECT CAST(t.tp AS INTEGER) AS time_point, d.id, d.series[t.tp + 1 : t.tp + {WINDOW}] AS series_full
FROM {d} d CROSS JOIN (SELECT unnest(range(0, (SELECT max(len(series)) - {WINDOW - 1} FROM {d}))) AS tp) t""")
    r = q.add("w4r", f"SELECT *, series_full[1:{L}] AS series_raw FROM {w}")
    n = q.add("w4n", f"SELECT *, {O.normalise('series_raw')} AS series_norm, 4 AS k FROM {r}")
    on = O.assign(q, n, c, "online")
    return final(q, on) if final else q.render(f"SELECT time_point, id, cluster_id, round(dist, 6) AS dist FROM {on}")


@register("t6_online_assignment", _sql_t6())
def t6(spark, sf_dir):
    """Every micro-batch of stream windows is assigned, inside the streaming query, to the batch model's centres of its
    time points."""
    _, fit = fx1_fit(spark, sf_dir)
    src = T.read_feed_stream(spark, feed(spark, sf_dir), files_per_trigger=16)
    wins = T.windowed_series(T.decode_messages(src, "message"), WINDOW, L)
    out = staging_path(spark, "online")

    def each(batch):
        a = assign(batch.withColumn("k", F.lit(4)), fit.centres, ["time_point", "k"], ORACLE_CFG)
        return a.select("time_point", "id", "cluster_id", "dist")

    T.run_batches(wins, out, staging_path(spark, "online-ckpt"), each)
    return spark.read.parquet(out).select("time_point", "id", "cluster_id", r6(F.col("dist")).alias("dist"))


# T5 on a panel with gaps (FX-3: a user has no row on a day without events): windows of a week, three deliveries, the stream stopped and
# started again between them; nothing is late, as the deliveries come in order and are no longer than the lateness.
GAP_WINDOW, GAP_LATENESS, DELIVERIES = 7, 12, 3


def _sql_t5():
    q = O.Sql()
    p = O.fx3_panel(q)
    v = q.add("v5", f"SELECT id, pos, round_even(value, 4) AS value FROM {p}")
    w = q.add("w5", f"""SELECT CAST(a.pos AS INTEGER) AS time_point, a.id, list(b.value ORDER BY b.pos) AS series_full
FROM {v} a JOIN {v} b ON b.id = a.id AND b.pos BETWEEN a.pos AND a.pos + {GAP_WINDOW - 1} GROUP BY a.pos, a.id HAVING count(*) = {GAP_WINDOW}""")
    return q.render(dflat(w, ["time_point", "id"], "series_full"))


@register("t5_windows_of_series_with_gaps", _sql_t5())
def t5(spark, sf_dir):
    panel, n = fx3_panel(spark, sf_dir), positions(spark, sf_dir, "fx3")
    messages = T.encode_messages(panel)
    path, out, checkpoint = (staging_path(spark, name) for name in ("gap-feed", "gap-windows", "gap-ckpt"))
    for i in range(DELIVERIES):
        some = messages.where((F.col("time_point") >= n * i // DELIVERIES) & (F.col("time_point") < n * (i + 1) // DELIVERIES))
        T.write_feed(some, path, "append")
        src = T.read_feed_stream(spark, path, files_per_trigger=64)
        T.run_to_table(T.windowed_series(T.decode_messages(src, "message"), GAP_WINDOW, GAP_WINDOW, lateness=GAP_LATENESS), out, checkpoint)
    return flat(spark.read.parquet(out), ["time_point", "id"], "series_full")


# T4: windows of 12 days sliding by one, a watermark of one slide
EVENT_LENGTH, EVENT_SLIDE, EVENT_DELAY = 12, 1, 1


def _sql_t4_event():
    return f"""WITH e AS (SELECT user_id, ts, value FROM events WHERE ts IS NOT NULL),
w AS (SELECT user_id, date_trunc('day', ts) - to_days(CAST(j.j AS INTEGER)) AS s, value FROM e, (SELECT unnest(range(0, {EVENT_LENGTH})) AS j) j)
SELECT user_id, CAST(epoch(s) AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS events, round(sum(value), 6) AS total
FROM w WHERE s + INTERVAL {EVENT_LENGTH} DAY <= (SELECT max(ts) - INTERVAL {EVENT_DELAY} DAY FROM e) GROUP BY user_id, s"""


@register("t4_event_time_windows", _sql_t4_event())
def t4_event(spark, sf_dir):
    """T4 with event time: the windows of each user that the watermark has closed when all events have come, in three deliveries."""
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")  # the same instant in any session time zone
    events = read_table(spark, sf_dir, "events").select("user_id", F.timestamp_micros(since).alias("ts"), F.col("value").cast("double").alias("value")).where("ts is not null")
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    path, out, checkpoint = (staging_path(spark, name) for name in ("event-feed", "event-windows", "event-ckpt"))
    step = ((last or 0) - (first or 0)) // DELIVERIES + 1
    for i in range(DELIVERIES):
        events.where(((F.unix_micros("ts") - F.lit(first)) / step).cast("long") == i).write.mode("append").parquet(path)
        src = spark.readStream.schema(events.schema).parquet(path)
        T.run_to_table(T.event_windows(src, f"{EVENT_LENGTH} days", f"{EVENT_SLIDE} days", f"{EVENT_DELAY} days", ("user_id",)), out, checkpoint)
    return spark.read.parquet(out).select("user_id", F.unix_seconds("window_start").alias("window_start"), "events", r6(F.col("total")).alias("total"))


def _sql_t6_w5():
    return _sql_t6(lambda q, on: q.render(f"""SELECT CAST(c.time_point AS INTEGER) AS time_point, p.cluster_id AS cluster_previous, c.cluster_id AS cluster_current,
  CAST(count(*) AS BIGINT) AS number_cus, round(count(*) / any_value(n.n), 6) AS change_proportion
FROM {on} c JOIN {on} p ON p.id = c.id AND p.time_point = c.time_point - 1
JOIN (SELECT time_point, cluster_id, count(*) AS n FROM {on} GROUP BY ALL) n ON n.time_point = c.time_point AND n.cluster_id = c.cluster_id
GROUP BY c.time_point, p.cluster_id, c.cluster_id"""))


@register("t6_w1_w5_stream_migration", _sql_t6_w5())
def t6_w5(spark, sf_dir):
    """W1 and W5 from the stream: one query windows and assigns the feed into a table, a second one follows that table and counts migration."""
    _, fit = fx1_fit(spark, sf_dir)
    src = T.read_feed_stream(spark, feed(spark, sf_dir), files_per_trigger=16)
    wins = T.windowed_series(T.decode_messages(src, "message"), WINDOW, L)
    assigned = assign(wins.withColumn("k", F.lit(4)), fit.centres, ["time_point", "k"], ORACLE_CFG).select("time_point", "id", "cluster_id")
    clustered, parts = staging_path(spark, "stream-clustered"), staging_path(spark, "stream-monitor")
    T.run_to_table(assigned, clustered, staging_path(spark, "stream-clustered-ckpt"))
    T.migration_parts(spark, clustered, assigned.schema, parts, staging_path(spark, "stream-monitor-ckpt"))
    return T.migration_table(spark, parts).select("time_point", "cluster_previous", "cluster_current", "number_cus", r6(F.col("change_proportion")).alias("change_proportion"))


def _sql_w14():
    q = O.Sql()
    lg = _ddense(q)
    return q.render(f"SELECT DISTINCT pos AS time_point, CAST(floor(id / {T.MESSAGE_BLOCK}) AS BIGINT) AS block, true AS has_arrival_time FROM {lg}")


@register("w14_raw_message_records", _sql_w14())
def w14(spark, sf_dir):
    src = T.read_feed_stream(spark, feed(spark, sf_dir), files_per_trigger=8)
    out = staging_path(spark, "raw-messages")
    T.run_to_table(T.with_arrival_time(src), out, staging_path(spark, "raw-ckpt"))
    back = spark.read.parquet(out)
    lines = F.split("message", "\n")
    return back.select(F.element_at(lines, 1).cast("int").alias("time_point"),
                       F.floor(F.element_at(F.split(F.element_at(lines, 2), ","), 1).cast("bigint") / T.MESSAGE_BLOCK).cast("bigint").alias("block"),
                       F.col("datetime").isNotNull().alias("has_arrival_time"))
