"""Text sources, sinks and the period-message stream."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewarp.sources import sinks as W
from tidewarp.sources import text as S
from tidewarp.streaming import stream as T


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_parse_lines_bad_and_ragged(spark):
    d = tempfile.mkdtemp(prefix="tw-lines-")
    _write(os.path.join(d, "month_3.csv"), "1,0.5,1.5,1.0\n\n2,1,2\n3,x,1\n4,1,1,1,1,9\n")
    good = S.load_time_point(spark, os.path.join(d, "month_3.csv"), 3, 3).orderBy("id").collect()
    assert [r["id"] for r in good] == [1, 2, 4]
    assert good[1]["series_full"] == [1.0, 2.0]  # ragged line keeps its own length
    assert good[2]["series_raw"] == [1.0, 1.0, 1.0] and good[2]["series_norm"] == [0.0, 0.0, 0.0]
    assert S.bad_lines(spark, os.path.join(d, "month_3.csv"), 3).count() == 1
    rng = S.load_time_point_range(spark, d, 0, 5, 3, layout="month_files")
    assert {r["time_point"] for r in rng.collect()} == {3}


def test_wide_matrix(spark):
    d = tempfile.mkdtemp(prefix="tw-wide-")
    _write(os.path.join(d, "wide.csv"), "1,10,100\n2,20,200\n3,30,300\n")
    long = S.read_wide_matrix(spark, os.path.join(d, "wide.csv")).collect()
    got = {(r["id"], r["pos"]): r["value"] for r in long}
    assert got[(1, 0)] == 1.0 and got[(3, 2)] == 300.0 and len(got) == 9


def test_wide_matrix_with_lines_over_many_splits(spark):
    """Lines longer than a split, blank lines at all places, ragged and bad fields, files in the order of their paths."""
    d = tempfile.mkdtemp(prefix="tw-wide-")
    files = {"a.csv": [[str(i * 10 + j) for j in range(60)] for i in range(5)], "b.csv": [["7"], ["", "x", " 2.5 ", ""], [str(j) for j in range(90)]], "c.csv": [["1", "2"]]}
    _write(os.path.join(d, "a.csv"), "\n\n" + "\n\n".join(",".join(r) for r in files["a.csv"]) + "\n\n")
    _write(os.path.join(d, "b.csv"), "\r\n".join(",".join(r) for r in files["b.csv"]))
    _write(os.path.join(d, "c.csv"), ",".join(files["c.csv"][0]) + "\n")
    _write(os.path.join(d, "d.csv"), "\n \n")
    _write(os.path.join(d, "e.csv"), "5,6")
    rows = [r for f in files.values() for r in f] + [["5", "6"]]

    def number(v):
        try:
            return float(v)
        except ValueError:
            return None

    want = {(j + 1, i): number(v) for i, r in enumerate(rows) for j, v in enumerate(r)}
    for split in ("17", "100", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = S.read_wide_matrix(spark, d)
            rows_got = got.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(rows_got) == len(want) and {(r.id, r.pos): r.value for r in rows_got} == want


def test_result_dirs_round_trip(spark):
    base = tempfile.mkdtemp(prefix="tw-res-")
    a = spark.createDataFrame([(0, 2, 0, 7, [0.1, 0.2]), (0, 2, 1, 8, [0.3, 0.4])],
                              "time_point int, k int, cluster_id int, id long, series_norm array<double>")
    sil = spark.createDataFrame([(0, 2, 0.6666)], "time_point int, k int, run_silhouette double")
    W.write_clustering_result_text(a, sil, base)
    pca = spark.createDataFrame([(0, 7, [1.0, 2.0])], "time_point int, id long, pca array<double>")
    W.write_pca_text(pca, base)
    back = S.read_clustering_results(spark, base).orderBy("id").collect()
    assert [(r["time_point"], r["k"], r["run_silhouette"], r["cluster_id"], r["id"]) for r in back] == [
        (0, 2, 0.667, 0, 7), (0, 2, 0.667, 1, 8)]
    assert back[1]["series_norm"] == [0.3, 0.4]
    p = S.read_pca_results(spark, base).collect()
    assert [(r["time_point"], r["id"], r["pc1"], r["pc2"]) for r in p] == [(0, 7, 1.0, 2.0)]


def test_messages_round_trip(spark):
    panel = spark.createDataFrame([(i, t, i * 1.23456789 + t) for i in range(1, 6) for t in range(3)],
                                  "id long, pos int, value double")
    msgs = T.encode_messages(panel, block=2).collect()
    assert len(msgs) == 3 * 3  # 3 positions x 3 id blocks
    assert msgs[0]["message"].split("\n")[0] == str(msgs[0]["time_point"])
    dec = T.decode_messages(spark.createDataFrame([(m["message"],) for m in msgs], "value string")).collect()
    got = {(r["id"], r["time_point"]): r["value"] for r in dec}
    assert got[(3, 2)] == round(3 * 1.23456789 + 2, 4)


def test_decoded_lines_do_not_carry_their_message(spark):
    """Behind the explode only the position goes on with each line: the whole message there is a cost of lines x message length."""
    plan = T.decode_messages(spark.createDataFrame([("3\n1,0.5\n2,x\n7,1.25",), ("4",), (None,)], "value string"))
    assert [tuple(r) for r in plan.orderBy("id").collect()] == [(3, 1, 0.5), (3, 2, None), (3, 7, 1.25)]
    generate = next(line for line in plan._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line)
    assert "split" not in generate and "value#" not in generate


def _panel(spark, ids, positions):
    return spark.createDataFrame([(i, t, float((i * 3 + t * 7) % 11)) for i in ids for t in positions], "id long, pos int, value double")


def _check_windows(path, spark, ids, n_pos, window=4):
    rows = spark.read.parquet(path).collect()
    got = {(r["time_point"], r["id"]): r["series_full"] for r in rows}
    assert len(rows) == len(got) and set(got) == {(t, i) for t in range(n_pos - window + 1) for i in ids}
    for (t, i), s in got.items():
        assert s == [float((i * 3 + p * 7) % 11) for p in range(t, t + window)]


def test_stream_gives_every_window(spark):
    """Several writing tasks and several id blocks: files arrive in no order of positions."""
    base = tempfile.mkdtemp(prefix="tw-stream-")
    msgs = T.encode_messages(_panel(spark, range(1, 8), range(12)), block=3).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.write_feed(msgs, base + "/feed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    src = T.read_feed_stream(spark, base + "/feed", files_per_trigger=5)
    T.run_to_table(T.windowed_series(T.decode_messages(src, "message"), 4, 3), base + "/out", base + "/ckpt")
    _check_windows(base + "/out", spark, range(1, 8), 12)


def test_stream_goes_on_from_its_checkpoint(spark):
    base = tempfile.mkdtemp(prefix="tw-restart-")

    def run():
        src = T.read_feed_stream(spark, base + "/feed", files_per_trigger=2)
        T.run_to_table(T.windowed_series(T.decode_messages(src, "message"), 4, 3), base + "/out", base + "/ckpt")

    T.write_feed(T.encode_messages(_panel(spark, (1, 2), range(6))), base + "/feed")
    run()
    _check_windows(base + "/out", spark, (1, 2), 6)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        T.write_feed(T.encode_messages(_panel(spark, (1, 2), range(6, 9))), base + "/feed")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    run()
    _check_windows(base + "/out", spark, (1, 2), 9)


def _deliver(spark, base, rows, block=3):
    """Add the messages of ``rows`` (id, pos, value) to the feed as new files."""
    msgs = T.encode_messages(spark.createDataFrame(rows, "id long, pos int, value double"), block=block)
    msgs.select("time_point", F.to_json(F.struct("time_point", "block", "message")).alias("value")).write.mode("append").partitionBy("time_point").text(base + "/feed")


def _value(i, p):
    return float((i * 3 + p * 7) % 11)


def test_gaps_keep_the_later_windows_and_bound_the_state(spark):
    """Position 1 of id 2 never comes, id 3 ends early, id 4 begins late; the stream stops and goes on between deliveries."""
    base = tempfile.mkdtemp(prefix="tw-gaps-")
    have = {1: set(range(20)), 2: set(range(20)) - {1}, 3: set(range(4)), 4: set(range(9, 20)) - {15}}
    late = 0
    for lo, hi in ((0, 8), (8, 14), (14, 20)):
        _deliver(spark, base, [(i, p, _value(i, p)) for i in have for p in have[i] if lo <= p < hi] + ([(1, 0, 9.0), (2, 1, 9.0)] if lo == 14 else []))
        src = T.read_feed_stream(spark, base + "/feed", files_per_trigger=100)
        late += T.run_to_table(T.windowed_series(T.decode_messages(src, "message"), 4, 3, lateness=8), base + "/out", base + "/ckpt")
    got = {(r.id, r.time_point): r.series_full for r in spark.read.parquet(base + "/out").collect()}
    want = {(i, s) for i in have for s in range(17) if set(range(s, s + 4)) <= have[i]}
    assert set(got) == want and spark.read.parquet(base + "/out").count() == len(want)
    assert all(v == [_value(i, p) for p in range(s, s + 4)] for (i, s), v in got.items())
    assert late == 2  # position 1 of id 2 and a second position 0 of id 1, both far behind position 13 less 8
    state = spark.read.format("statestore").load(base + "/ckpt").collect()
    held = {r.key.id: r.value.groupState.pos for r in state}
    assert 3 not in held and all(min(p) > 13 - 8 - 4 for p in held.values())  # 13: the newest position before the last delivery


def test_gaps_filled_as_in_dense_series(spark):
    base = tempfile.mkdtemp(prefix="tw-fill-")
    have = {1: set(range(16)), 2: {0, 3, 4, 5, 6, 9}, 3: {10}}
    for lo, hi in ((0, 9), (9, 16)):
        _deliver(spark, base, [(i, p, _value(i, p)) for i in have for p in have[i] if lo <= p < hi])
        src = T.read_feed_stream(spark, base + "/feed", files_per_trigger=100)
        T.run_to_table(T.windowed_series(T.decode_messages(src, "message"), 3, 2, lateness=4, fill=0.0), base + "/out", base + "/ckpt")
    got = {(r.id, r.time_point): r.series_full for r in spark.read.parquet(base + "/out").collect()}
    closed = 15 - 4  # the last position that can be a gap for certain
    want = {(i, s) for i in have for s in range(14) if all(p in have[i] or p <= closed for p in range(s, s + 3))}
    assert set(got) == want
    assert all(v == [_value(i, p) if p in have[i] else 0.0 for p in range(s, s + 3)] for (i, s), v in got.items())


def test_feed_has_one_file_a_position(spark):
    """However many tasks and id blocks the messages come from: a micro-batch takes files and visits the state of all their ids."""
    base = tempfile.mkdtemp(prefix="tw-files-")
    T.write_feed(T.encode_messages(_panel(spark, range(1, 40), range(5)), block=3).repartition(6), base + "/feed")
    files = [(d, f) for d, _, names in os.walk(base + "/feed") for f in names if f.startswith("part-")]
    assert sorted(d.rsplit("=", 1)[1] for d, _ in files) == [str(t) for t in range(5)]


class _State:
    """A group's state outside Spark."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.wake, self.mark = None, False, False, None, 0

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists, self.wake = None, False, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at >= self.mark
        self.wake = at


def _run_step(step, state, rows, mark, columns):
    import pandas as pd

    state.mark, state.hasTimedOut = mark, not rows
    half = len(rows) // 2
    frames = [pd.DataFrame(part, columns=columns) for part in (rows[:half], rows[half:]) if part]
    state.wake = None
    return [tuple(r) for df in step((0,), iter(frames), state) for r in df.itertuples(index=False)]


def test_a_block_of_ids_is_one_state_that_gives_what_each_id_alone_would():
    """Random deliveries with gaps, repeats and late rows; ids that end and ids that begin late. Windows by a plain loop over each id."""
    import random

    import numpy as np

    for seed, fill in ((1, None), (2, 0.0), (3, None), (4, 7.0)):
        rnd, window, lateness = random.Random(seed), 3, 6
        step, state, mark, newest = T._advance(window, fill), _State(), 0, 0
        plain: dict = {}  # id: [values by position, windows that have left]
        for batch in range(25):
            rows = [(i, p, float(rnd.randrange(100))) for i in range(6) for p in range(max(0, 2 * batch - 4), 2 * batch + 2) if rnd.random() < 0.6 and (i != 3 or batch < 8) and (i != 4 or batch > 9)]
            rnd.shuffle(rows)
            rows += rows[:2] if batch % 3 else []
            rows = [r for r in rows if (r[1] + 1) * T.DAY > mark]
            past = mark // T.DAY - 1
            if not rows and not (state.wake is not None and mark > state.wake):
                continue
            want = []
            for i, p, v in rows:
                plain.setdefault(i, ({}, set()))[0][p] = v
            for i, (values, left) in plain.items():
                if fill is not None:
                    for p in range(past + 1):
                        values.setdefault(p, fill)
                for s in range(max(values) + 1):
                    if s not in left and all(q in values for q in range(s, s + window)):
                        left.add(s)
                        want.append((s, i, [values[q] for q in range(s, s + window)]))
            got = [(s, i, list(v)) for s, i, v in _run_step(step, state, rows, mark, ["of_id", "time_point", "value"])]
            assert sorted(got) == sorted(want)
            if fill is None and state.exists:
                pos, ids, have, _, done = state.get
                ids = np.frombuffer(ids, np.int64)
                have = np.frombuffer(have, bool).reshape(len(ids), len(pos))
                assert min(pos) > done - window + 1 and have.any(axis=1).all()
                assert batch < 18 or 3 not in ids  # the id that ended is held no longer
            newest = max([newest, *(p for _, p, _ in rows)])
            mark = max(mark, (newest + 1 - lateness) * T.DAY)


def test_a_block_of_ids_counts_the_moves_of_each():
    import random

    rnd = random.Random(5)
    rows = [(i, t, rnd.randrange(4)) for i in range(7) for t in range(30) if rnd.random() < 0.8]
    want = [(t, None, c) for _, t, c in rows]
    at = {(i, t): c for i, t, c in rows}
    want += [(t, at[i, t - 1], c) for (i, t), c in at.items() if (i, t - 1) in at]
    rnd.shuffle(rows)
    state, got = _State(), []
    for part in (rows[:50], rows[50:60], rows[60:]):
        got += _run_step(T._moves, state, part, 0, ["of_id", "time_point", "cluster_id"])
    plain = lambda r: tuple(-1 if x is None or x != x else int(x) for x in ((r[0], None, r[2]) if str(r[1]) == "<NA>" else r))
    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_event_windows_drop_and_count_late_events(spark):
    base = tempfile.mkdtemp(prefix="tw-events-")
    rows = [[(m, 1.0) for m in range(0, 300, 10)], [(305, 2.0), (250, 4.0), (20, 8.0), (30, 8.0)], [(700, 16.0)]]
    late = 0
    for batch in rows:
        spark.createDataFrame([(m * 60, v) for m, v in batch], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value").write.mode("append").parquet(base + "/in")
        src = spark.readStream.schema("ts timestamp, value double").parquet(base + "/in")
        late += T.run_to_table(T.event_windows(src, "120 minutes", "60 minutes", "90 minutes"), base + "/out", base + "/ckpt")
    kept = [(m, v) for batch in rows for m, v in batch if (m, v) not in ((20, 8.0), (30, 8.0))]
    closed = 700 - 90
    want = {}
    for m, v in kept:
        for start in range((m // 60 - 1) * 60, m + 1, 60):
            if start <= m < start + 120 <= closed:
                n, total = want.get(start, (0, 0.0))
                want[start] = (n + 1, total + v)
    got = spark.read.parquet(base + "/out").select(F.unix_seconds("window_start").alias("s"), "events", "total").collect()
    assert {r.s // 60: (r.events, r.total) for r in got} == want and len(got) == len(want)
    assert late > 0  # the windows of the two late events


def test_stream_migration_equals_batch_also_after_a_repeated_batch(spark):
    from tidewarp.operators import drift as J

    base = tempfile.mkdtemp(prefix="tw-moves-")
    schema = "time_point int, id long, cluster_id int"
    rows = [(t, i, (i * 7 + t * t) % 3) for t in range(9) for i in range(20) if (i + t) % 5]
    for part in (rows[:40], rows[80:100], rows[40:80], rows[100:]):  # not in order of time
        spark.createDataFrame(part, schema).write.mode("append").parquet(base + "/w1")
        T.migration_parts(spark, base + "/w1", schema, base + "/w5", base + "/ckpt", files_per_trigger=2)
    want = sorted(map(tuple, J.migration(spark.createDataFrame(rows, schema)).select("time_point", "cluster_previous", "cluster_current", "number_cus", "change_proportion", "share_of_previous").collect()))

    def table():
        return sorted(map(tuple, T.migration_table(spark, base + "/w5").select("time_point", "cluster_previous", "cluster_current", "number_cus", "change_proportion", "share_of_previous").collect()))

    assert table() == want
    # the last batch was written but not committed: it runs again
    last = max(int(f) for f in os.listdir(base + "/ckpt/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{base}/ckpt/commits/{name}"):
            os.remove(f"{base}/ckpt/commits/{name}")
    T.migration_parts(spark, base + "/w1", schema, base + "/w5", base + "/ckpt")
    assert table() == want


def test_entity_sink_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="tw-sink-")
    rows = spark.createDataFrame([(0, 1, 5), (1, 0, 7)], "time_point int, cluster_id int, cluster_count long")
    t = W.with_run_columns(rows, "random", "random", 12)
    W.write_entity(t, base + "/counts")
    W.write_entity(t, base + "/counts")  # a retry / re-run replaces its own partitions
    W.write_entity(W.with_run_columns(rows.where("time_point = 1"), "random", "random", 12), base + "/counts")
    back = spark.read.parquet(base + "/counts")
    assert back.count() == 2
    assert {(r["time_point"], r["cluster_count"]) for r in back.collect()} == {(0, 5), (1, 7)}


def test_non_empty_lines_read_every_window_file(spark):
    """X7 counts the lines of all FX-1 windows, in files where half of the lines are blank."""
    import duckdb

    import __spark_entry__ as E

    sf = tempfile.mkdtemp(prefix="tw-x7-")
    con = duckdb.connect()
    con.execute("""CREATE TABLE lineitem AS SELECT i AS l_suppkey, 100.0 + i AS l_extendedprice, 0.1 AS l_discount,
        TIMESTAMP '1995-01-15' + to_months(CAST(m AS INTEGER)) AS l_shipdate FROM range(1, 6) a(i), range(0, 17) b(m) WHERE (i + m) % 4 > 0""")
    con.execute(f"COPY lineitem TO '{sf}/lineitem.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, E.queries()["x7_non_empty_lines"](spark, sf).collect()))
    assert got == sorted(con.execute(E.oracle_sql()["x7_non_empty_lines"]).fetchall()) == [(t, 5) for t in range(3)]
