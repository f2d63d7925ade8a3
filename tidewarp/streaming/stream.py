"""Period messages and their stream.

A message carries one time position: first line the position, then
``id,value`` lines (values to 4 places). Messages are cut into id blocks of
at most ``block`` ids, so no message holds an unbounded group. The stream
decodes them and keeps, per id, the positions that a window still needs (T5), the ids in blocks;
a window leaves as soon as all its positions are there, whatever the order in
which files arrive. A position is a day of event time; the watermark, some positions behind the newest one of the feed, bounds the
state and decides about gaps (``windowed_series``). Windows are normalised like the batch path and assigned to given
centres inside the streaming query (T6); a second query over the assigned rows keeps each id's clusters as state and counts
migration (W5). Event-time windows of raw events (T4) are ``event_windows``.
"""

from __future__ import annotations

import threading

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidewarp.operators.reshape import with_raw_norm

MESSAGE_BLOCK = 10_000


def encode_messages(panel: DataFrame, block: int = MESSAGE_BLOCK) -> DataFrame:
    """``(time_point, block, message)``; lines sorted by id, values
    rounded half-even to 4 places and written with 4 decimals."""
    lines = panel.select(F.col("pos").cast("int").alias("time_point"),
                         F.floor(F.col("id") / block).cast("bigint").alias("block"), "id",
                         F.format_string("%d,%.4f", F.col("id"), F.bround("value", 4)).alias("line"))
    grouped = lines.groupBy("time_point", "block").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return grouped.select("time_point", "block",
                          F.concat_ws("\n", F.col("time_point").cast("string"), body).alias("message"))


def decode_messages(messages: DataFrame, col: str = "value") -> DataFrame:
    """Message text -> ``(time_point, id, value)`` rows."""
    parts = messages.select(F.split(F.col(col), "\n").alias("parts"))
    # the position leaves the message before its lines do: behind the explode, each line would carry the whole message and split it again
    whole = parts.select(F.element_at("parts", 1).cast("int").alias("time_point"), F.slice("parts", 2, F.size("parts")).alias("lines"))
    rows = whole.select("time_point", F.explode("lines").alias("line"))
    f = F.split("line", ",")
    return rows.select("time_point", F.element_at(f, 1).cast("bigint").alias("id"),
                       F.element_at(f, 2).try_cast("double").alias("value"))


def write_feed(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The replay feed as files, one folder per time position. The
    messages are written whole (one line may contain newlines), so each is
    stored as one JSON record. A position's messages go to one file, or to several of the advisory partition size where adaptive execution
    finds them larger: micro-batches take files, and each one visits the state of every id in its files."""
    records = messages.select("time_point", F.to_json(F.struct("time_point", "block", "message")).alias("value"))
    records.hint("rebalance", "time_point").write.mode(mode).partitionBy("time_point").text(path)


FEED_SCHEMA = T.StructType([T.StructField("value", T.StringType()), T.StructField("time_point", T.IntegerType())])
_MSG = "time_point int, block bigint, message string"


def read_feed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """T3 as a streaming source: one (or n) feed files per micro-batch."""
    raw = (spark.readStream.schema(FEED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("basePath", path).text(path))
    return raw.select(F.from_json("value", _MSG).alias("m")).select("m.message")


DAY = 86_400_000  # a position in milliseconds of event time; position 0 is day 1, as the first watermark is day 0
LATENESS = 120  # positions that a message may come behind the newest one
BLOCK_BITS = 8  # ids that share all but so many low bits are one state block: a call for each id would cost more than its work
STATE = "pos array<int>, ids binary, have binary, value binary, done int"
WINDOWS = "time_point int, id bigint, series_full array<double>"


def _by_block(rows: DataFrame):
    """``rows`` grouped by block: ``id`` becomes the lowest id that may be in the block, ``of_id`` is the id itself."""
    return rows.withColumn("of_id", F.col("id")).withColumn("id", F.shiftleft(F.shiftright("id", BLOCK_BITS), BLOCK_BITS)).groupBy("id")


def _rows_of(frames, timed_out: bool, *cols: str) -> list[np.ndarray]:
    """The columns of all frames of a group, and the number of the frame of each row."""
    frames = [] if timed_out else list(frames)
    number = np.repeat(np.arange(len(frames)), [len(f) for f in frames])
    return [np.concatenate([f[c].to_numpy() for f in frames]) if frames else np.zeros(0, np.int64) for c in cols] + [number]


def _placed(part: np.ndarray, rows: tuple, cols: tuple, empty) -> np.ndarray:
    """``part`` as a matrix of more rows and columns; ``rows``, ``cols``: (its names, all names)."""
    out = np.full((len(rows[1]), len(cols[1])), empty, part.dtype)
    out[np.ix_(np.searchsorted(rows[1], rows[0]), np.searchsorted(cols[1], cols[0]))] = part
    return out


def _advance(window: int, fill: float | None):
    """State step of a block of ids: take positions in, give out the windows that become complete by them.

    ``have``, ``value``: ids x positions that an open window may need. ``done``: positions up to it are past the watermark, none can come."""
    def step(key, frames, state):
        had, pos, done = np.zeros(0, np.int64), np.zeros(0, np.int64), -1
        have, value = np.zeros((0, 0), bool), np.zeros((0, 0))
        if state.exists:
            pos, had, have, value, done = state.get
            pos, had = np.array(pos, np.int64), np.frombuffer(had, np.int64)
            have, value = (np.frombuffer(b, t).reshape(len(had), len(pos)) for b, t in ((have, bool), (value, np.float64)))
        of, at, given, _ = _rows_of(frames, state.hasTimedOut, "of_id", "time_point", "value")
        past = state.getCurrentWatermarkMs() // DAY - 1
        ids = np.union1d(had, of)
        settled = np.full(len(ids), -1)  # the positions of an id that are not missing any more
        settled[np.searchsorted(ids, had)] = done
        gaps = np.arange(settled.min(initial=past) + 1, past + 1) if fill is not None else pos
        cols = np.union1d(np.union1d(pos, at), gaps).astype(np.int64)
        have, value = _placed(have, (had, ids), (pos, cols), False), _placed(value, (had, ids), (pos, cols), np.nan)
        before = have.copy()
        place = np.searchsorted(ids, of) * len(cols) + np.searchsorted(cols, at)
        place, last = np.unique(place[::-1], return_index=True)  # of a position that comes again the last value
        have.flat[place], value.flat[place] = True, given[::-1][last]
        if fill is not None:
            missing = ~have & (cols[None, :] <= past) & (cols[None, :] > settled[:, None])
            value[missing], have = fill, have | missing
        done = max(done, past)
        if len(cols) >= window:
            def within(mask):
                total = np.zeros((len(ids), len(cols) + 1), np.int64)
                np.cumsum(mask, axis=1, out=total[:, 1:])
                return total[:, window:] - total[:, :-window]

            whole = (within(have) == window) & (within(have & ~before) > 0) & (cols[window - 1:] - cols[:len(cols) - window + 1] == window - 1)
            row, start = np.nonzero(whole)
            if len(row):
                series = np.lib.stride_tricks.sliding_window_view(value, window, axis=1)[row, start]
                yield pd.DataFrame({"time_point": cols[start], "id": ids[row], "series_full": list(series)})
        have = have & (cols > done - window + 1)  # no window can need the others
        row = have.any(axis=1) | (fill is not None)
        col = have[row].any(axis=0)
        ids, cols, have, value = ids[row], cols[col], have[np.ix_(row, col)], value[np.ix_(row, col)]
        if not len(ids):
            state.remove()
            return
        state.update((cols.tolist(), ids.tobytes(), have.tobytes(), value.tobytes(), int(done)))
        if fill is not None:  # when the next missing position of an id is past
            ahead = cols > done
            run = have[:, ahead][:, cols[ahead] == done + 1 + np.arange(ahead.sum())]
            wake = done + 1 + int(np.logical_and.accumulate(run, axis=1).sum(axis=1).min())
        else:  # when no window can need what is held of an id
            wake = int(cols[len(cols) - 1 - have[:, ::-1].argmax(axis=1)].min()) + window - 1
        state.setTimeoutTimestamp((wake + 1) * DAY - 1)

    return step


def windowed_series(decoded: DataFrame, window: int, length: int, lateness: int = LATENESS, fill: float | None = None) -> DataFrame:
    """T5: every sliding window of ``window`` positions per id, once each, as soon as it is complete.

    A position more than ``lateness`` behind the newest one of the earlier batches is late and dropped (``run_to_table`` counts them). A
    position that has not come by then is a gap: a window with a gap never leaves, all others do; with ``fill``, gaps take that value, from
    position 0 on, as dense series do. The state of an id, trimmed whenever its block has data, holds no position ``window`` + ``lateness`` or more
    behind the newest one of the earlier batches, and goes when no window can need it. A position that comes again replaces its value in the windows that have not left.
    The state of up to 2^BLOCK_BITS neighbouring ids is one block, keyed by its lowest possible id."""
    timed = decoded.where("time_point >= 0").withColumn("at", F.timestamp_seconds((F.col("time_point").cast("long") + 1) * (DAY // 1000)))
    out = (_by_block(timed.withWatermark("at", f"{int(lateness)} days"))
           .applyInPandasWithState(_advance(window, fill), WINDOWS, STATE, "append", "EventTimeTimeout"))
    return with_raw_norm(out, length)


def event_windows(events: DataFrame, length: str, slide: str, delay: str, by: tuple = ()) -> DataFrame:
    """T4: sliding event-time windows of a stream of (ts timestamp, value, ``by``): (``by``, window_start, window_end, events, total), in
    append mode. A window leaves once the watermark, ``delay`` behind the newest event, has passed its end; later events of it are dropped and counted."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(
        *by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "total")


class _Late(StreamingQueryListener):
    """Counts the rows that queries drop as late."""

    def __init__(self):
        self.rows: dict = {}
        self.ended: dict = {}

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryTerminated(self, event):
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def _finish(writer) -> int:
    """Run a streaming query over what is available; the rows it dropped as late."""
    late = _Late()
    spark = SparkSession.active()
    spark.streams.addListener(late)
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        late.ended.setdefault(str(q.runId), threading.Event()).wait(30)  # its progress comes before
        return late.rows.get(str(q.runId), 0)
    finally:
        spark.streams.removeListener(late)


def run_to_table(stream_df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Run a streaming query to completion over what is available, with
    its checkpoint in the shared folder, into a Parquet sink. Returns the number of rows dropped as late."""
    return _finish(stream_df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint))


def with_arrival_time(stream_df: DataFrame) -> DataFrame:
    """Raw message records with their arrival time."""
    return stream_df.withColumn("datetime", F.current_timestamp())


def run_batches(stream_df: DataFrame, path: str, checkpoint: str, each) -> int:
    """T6 + T7: run a streaming query over what is available and write ``each(batch)`` of every micro-batch under
    ``path/batch=<id>``. A batch that is run again after a restart replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _finish(stream_df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


CLUSTERS = "time_points array<int>, ids binary, have binary, clusters binary"
MOVES = "time_point int, cluster_previous int, cluster_current int"


def _moves(key, frames, state):
    """State step of a block of ids: a row (time point, null, cluster) for each assignment, and (time point, cluster before, cluster) for each
    two of consecutive time points. Of the time points seen of an id, those with a neighbour still to come are held."""
    had, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    have, clusters = np.zeros((0, 0), bool), np.zeros((0, 0), np.int64)
    if state.exists:
        times, had, have, clusters = state.get
        times, had = np.array(times, np.int64), np.frombuffer(had, np.int64)
        have, clusters = (np.frombuffer(b, t).reshape(len(had), len(times)) for b, t in ((have, bool), (clusters, np.int64)))
    of, at, given, number = _rows_of(frames, False, "of_id", "time_point", "cluster_id")
    if not np.isfinite(given).all():
        raise ValueError("an assignment without a cluster")
    ids, cols = np.union1d(had, of), np.union1d(times, at)
    have, clusters = _placed(have, (had, ids), (times, cols), False), _placed(clusters, (had, ids), (times, cols), 0)
    place = np.searchsorted(ids, of) * len(cols) + np.searchsorted(cols, at)
    order = np.lexsort((given, number, place))  # of an assignment that comes again the first counts, of one frame's the lowest
    place, first = np.unique(place[order], return_index=True)
    new = ~have.flat[place]
    place, given = place[new], given[order][first][new].astype(np.int64)
    fresh = np.zeros_like(have)
    fresh.flat[place], have.flat[place], clusters.flat[place] = True, True, given
    next_to = np.diff(cols) == 1
    both = have[:, :-1] & have[:, 1:] & next_to
    row, col = np.nonzero(both & (fresh[:, :-1] | fresh[:, 1:]))
    before, now, sizes = clusters[row, col], clusters[row, col + 1], len(given)
    inner = np.zeros_like(have)
    inner[:, 1:-1] = both[:, :-1] & both[:, 1:]
    newest = cols[len(cols) - 1 - have[:, ::-1].argmax(axis=1)]
    held = have & ~inner & (cols[None, :] > newest[:, None] - LATENESS)
    used = held.any(axis=0)
    state.update((cols[used].tolist(), ids.tobytes(), held[:, used].tobytes(), clusters[:, used].tobytes()))
    if sizes:
        previous = pd.arrays.IntegerArray(np.concatenate([np.zeros(sizes, np.int32), before.astype(np.int32)]), np.arange(sizes + len(row)) < sizes)
        yield pd.DataFrame({"time_point": np.concatenate([cols[place % len(cols)], cols[col + 1]]), "cluster_previous": previous, "cluster_current": np.concatenate([given, now])})


def migration_parts(spark: SparkSession, assigned_path: str, schema, path: str, checkpoint: str, files_per_trigger: int = 16) -> int:
    """Follow the table of assigned rows (time_point, id, cluster_id) that a streaming query writes (W1), with each id's clusters as
    state (a block of ids a row), and add every micro-batch's counts of moves and sizes to ``path`` under its batch id; a repeated batch replaces its own."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(assigned_path)
    moves = _by_block(rows.select("time_point", F.col("id").cast("bigint"), "cluster_id")).applyInPandasWithState(_moves, MOVES, CLUSTERS, "append", "NoTimeout")
    return run_batches(moves, path, checkpoint, lambda b: b.groupBy("time_point", "cluster_previous", "cluster_current").agg(F.count(F.lit(1)).alias("n")))


def migration_table(spark: SparkSession, path: str) -> DataFrame:
    """W5 from the parts of ``migration_parts``: what ``drift.migration`` gives for the same assignments."""
    parts = spark.read.parquet(path).groupBy("time_point", "cluster_previous", "cluster_current").agg(F.sum("n").alias("n"))
    moved = parts.where("cluster_previous is not null").withColumnRenamed("n", "number_cus")
    sizes = parts.where("cluster_previous is null").select("time_point", "cluster_current", F.col("n").alias("_n_cur"))
    before = sizes.select((F.col("time_point") + 1).alias("time_point"), F.col("cluster_current").alias("cluster_previous"), F.col("_n_cur").alias("_n_prev"))
    return (moved.join(sizes, ["time_point", "cluster_current"]).join(before, ["time_point", "cluster_previous"])
            .withColumn("change_proportion", F.col("number_cus") / F.col("_n_cur")).withColumn("share_of_previous", F.col("number_cus") / F.col("_n_prev"))
            .drop("_n_cur", "_n_prev"))
