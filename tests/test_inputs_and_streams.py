import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plantwatch.functions.keys import hash_mod
from plantwatch.operators import timeline as tl, validation as VA
from plantwatch.plans import views as V
from plantwatch.session import fresh_path
from plantwatch.sources import artifacts as A, tables as S
from plantwatch.streaming import streams as ST

COLUMNS = "row_id long, Type string, `Air temperature` double, `Process temperature` double, `Rotational speed` double, Torque double, `Tool wear` double"
GOOD = ("L", 298.2, 308.5, 1500.0, 42.0, 120.0)


def with_value(i, value):
    return tuple(value if j == i else v for j, v in enumerate(GOOD))


@pytest.mark.parametrize("row,message", [
    (with_value(0, "X"), "row 2: 'Type' must be one of \\['L', 'M', 'H'\\], got 'X'"),
    (with_value(0, None), "'Type' must be one of"),
    (with_value(1, float("nan")), "row 2: 'Air temperature' is NaN or infinite"),
    (with_value(4, float("-inf")), "'Torque' is NaN or infinite"),
    (with_value(3, None), "'Rotational speed' is NaN or infinite"),
    (with_value(4, 150.0), "row 2: 'Torque'=150.0 is outside the accepted range \\[0.0, 100.0\\]"),
    (with_value(1, 269.9), "outside the accepted range \\[270.0, 330.0\\]")])
def test_machine_rules(spark, row, message):
    df = spark.createDataFrame([(0, *GOOD), (1, *GOOD), (2, *row)], COLUMNS)
    with pytest.raises(ValueError, match=message):
        VA.require_valid(df, VA.machine_rules("row_id"), "row_id", "AI4I")
    ok, bad = VA.split_valid(VA.with_reasons(df, VA.machine_rules("row_id")))
    assert ok.count() == 2 and [r["row_id"] for r in bad.collect()] == [2]


def test_strict_mode_names_the_first_violation_and_reads_once(spark):
    rules = VA.machine_rules("row_id")
    df = spark.createDataFrame([(i, *GOOD) for i in range(40)] + [(41, *with_value(4, 150.0)), (40, *with_value(5, float("nan")))], COLUMNS)
    work = lambda ok: ok.select("row_id", (F.col("Torque") * 2).alias("double_torque"))
    with pytest.raises(ValueError, match="row 40: 'Tool wear'"):
        VA.strict(df, rules, "row_id", "AI4I", work)
    with pytest.raises(ValueError, match="AI4I: empty batch"):
        VA.strict(df.limit(0), rules, "row_id", "AI4I", work)
    passed = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            passed.add(len(f))
            yield f
    good = df.filter("row_id < 40").mapInPandas(count, df.schema)
    assert VA.strict(good, rules, "row_id", "AI4I", work).count() == 40 and passed.value == 40


def test_linear_detector_is_stored(spark):
    from plantwatch.operators.training import linear_detector, load_detector
    det = linear_detector({"a.b": 2.0, "c": -1.0}, 0.5, {"c": 3.0}, ["kind"])
    path = fresh_path(spark, "linear")
    det.save(spark, path)
    back = load_detector(path)
    df = spark.createDataFrame([(1.0, 2.0, "x")], "`a.b` double, c double, kind string")
    assert back.expected_features == ["a.b", "c", "kind"] and back.model == det.model
    assert back.score(df).first()["probability"] == pytest.approx(1 / (1 + 2.718281828459045 ** -0.5))


def test_order_of_checks(spark):
    df = spark.createDataFrame([(0, *with_value(4, 150.0)), (1, *with_value(5, float("nan"))), (2, *with_value(0, "l"))], COLUMNS)
    assert "row 2: 'Type'" in VA.first_violation(df, VA.machine_rules("row_id"), "row_id")
    assert "row 1: 'Tool wear'" in VA.first_violation(df.filter("row_id < 2"), VA.machine_rules("row_id"), "row_id")
    assert VA.first_violation(df.limit(0), VA.machine_rules("row_id"), "row_id") is None


def test_flow_magnitude(spark):
    df = spark.createDataFrame([(0, 1e12, 0.0), (1, 0.0, -1e15)], "row_id long, a double, b double")
    with pytest.raises(ValueError, match="row 1: 'b' exceeds the sane magnitude limit 1e\\+12"):
        VA.require_valid(df, VA.flow_rules(["a", "b"], "row_id"), "row_id", "RT-IoT2022")


def test_csv_missing_and_bad_cells(spark):
    path = fresh_path(spark, "csv")
    spark.createDataFrame([("id,x,s",), ("1,NA,-",), ("2,nan,b",), ("3,1.5,",), ("4,,c",)], "value string").coalesce(1).write.text(path)
    rows = S.read_csv(spark, path, "id long, x double, s string").orderBy("id").collect()
    assert [r["x"] for r in rows] == [None, None, 1.5, None] and [r["s"] for r in rows] == ["-", "b", None, "c"]
    bad = fresh_path(spark, "csv")
    spark.createDataFrame([("id,x",), ("1,abc",)], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception, match="abc"):
        S.read_csv(spark, bad, "id long, x double").collect()


@pytest.mark.parametrize("limit", [None, 50])
def test_positions_over_file_blocks(spark, limit):
    from plantwatch.session import ROWS_PER_TASK_KEY
    path = fresh_path(spark, "csv")
    spark.range(0, 5000, 1, 1).select((F.col("id") * 7).alias("v")).write.csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    if limit:
        spark.conf.set(ROWS_PER_TASK_KEY, str(limit))
    try:
        df = S.read_csv(spark, path, "v long", header=False)
        assert df.rdd.getNumPartitions() > 3
        out = S.with_file_position(df)
        assert out.filter("v <> row_id * 7").count() == 0 and out.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset(ROWS_PER_TASK_KEY)


def test_alignment_is_one_to_one(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    with pytest.raises(ValueError, match="several rows"):
        S.align_by_key(a.union(a.limit(1)), a.withColumnRenamed("x", "y"), "k")
    with pytest.raises(ValueError, match="same k"):
        S.align_by_key(a, a.filter("k = 1").withColumnRenamed("x", "y"), "k")
    dotted, names = S.plain_names(spark.createDataFrame([(1,)], "`id.orig_p` long"))
    assert dotted.columns == ["id_orig_p"] and names == {"id_orig_p": "id.orig_p"}


def test_manifest_hashes(spark):
    path = fresh_path(spark, "files")
    spark.range(10).write.csv(path)
    for whole in (A.WHOLE_FILE, 2, 0):
        rows = A.artifact_manifest(spark, path, "part-*", whole).collect()
        assert sum(r["bytes"] for r in rows) == 20
        for r in rows:
            raw = Path(r["path"].removeprefix("file:")).read_bytes()
            assert r["sha256"] == hashlib.sha256(raw).hexdigest() and r["bytes"] == len(raw)


def test_long_files_are_hashed_in_blocks(tmp_path):
    path = tmp_path / "long"
    with path.open("wb") as f:
        f.truncate(200 << 20)
    digest = hashlib.sha256()
    for _ in range(200):
        digest.update(bytes(1 << 20))
    before = peak_mb()
    assert A._sha256(f"file:{path}") == A._sha256(str(path)) == digest.hexdigest()
    assert peak_mb() - before < 100


def peak_mb() -> float:
    import resource
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_alignment_reports_what_has_no_partner(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k long, x string")
    b = spark.createDataFrame([(2, "B"), (3, "C")], "k long, y string")
    got = {(r["k"], r["x"], r["y"], r["side"]) for r in S.align_by_key(a, b, "k", unmatched="report").collect()}
    assert got == {(1, "a", None, "left"), (2, "b", "B", "both"), (3, None, "C", "right"), (None, "c", None, "left"), (None, "d", None, "left")}


def test_long_texts_are_profiled_by_key(spark):
    from plantwatch.operators import profile as P
    long = "x" * P.PLAIN_TEXT
    rows = [(long + "b", long, None), (long + "b", long + "a", None), (long + "a", long, None), (long + "a", "y", None), (None, "y", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = {r["feature"]: (r["n_unique"], r["most_common_value"], r["most_common_count"]) for r in P.mixed_profile(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (3, long + "a", 2), "b": (3, long, 2), "c": (1, None, 5)}
    assert P.mixed_profile(df.limit(0), ["a"]).count() == 0


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from plantwatch import session

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def ordered_files(df, by, path, n=4):
    """n files written one after the other, in the order of ``by``."""
    cuts = df.approxQuantile(by, [i / n for i in range(1, n)], 0.0)
    for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")]):
        df.filter((F.col(by) > lo) & (F.col(by) <= hi)).coalesce(1).write.mode("append").parquet(path)


def write_slices(df, path, *conditions):
    for c in conditions:
        df.filter(c).coalesce(1).write.mode("append").parquet(path)


END = [(None, None, "2024-03-01 00:00:00", None)]


def test_rows_out_of_order_and_late_rows(spark):
    """Rows inside the lateness are put in event time, later ones are dropped, and the rows of each machine come out once."""
    rows = [(1, 1, "00:00:00", True), (1, 3, "00:04:00", False), (2, 4, "00:05:00", True),
            (1, 2, "00:02:00", True), (1, 5, "00:30:00", True), (1, 6, "00:01:00", True), (2, 7, "00:31:00", None)]
    df = spark.createDataFrame([(m, e, f"2024-01-01 {t}", f) for m, e, t, f in rows] + END, "machine long, event_id long, t string, flagged boolean")
    df = df.select("machine", "event_id", F.col("t").cast("timestamp").alias("ts"), "flagged").cache()
    path, out, log = (fresh_path(spark, x) for x in "fol")
    # 6 comes when the watermark is beyond it (00:30 less ten minutes); 2 comes late, but in time.
    write_slices(df, path, "event_id in (1, 3, 4)", "event_id in (2, 5)", "event_id = 7", "event_id = 6")
    read = lambda: ST.read_stream(spark, path, df.schema, files_per_batch=1)
    ST.run_available(ST.debounce_stream(read()), out, checkpoint=log)
    before = {r["event_id"] for r in spark.read.parquet(out).collect()}
    assert before == {1, 2, 3, 4}
    # The same stream goes on from its state after a stop.
    write_slices(df, path, "machine is null")
    ST.run_available(ST.debounce_stream(read()), out, checkpoint=log)
    got = {r["event_id"]: (r["n_flagged"], r["n_seen"], r["confirmed"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, 1, False), 2: (2, 2, True), 3: (2, 3, True), 5: (2, 3, True), 4: (1, 1, False), 7: (1, 2, False)}
    assert spark.read.parquet(out).count() == 6


def test_stream_without_rows_of_a_machine(spark):
    df = spark.createDataFrame([(None, 1, "2024-01-01 00:00:00", True), (3, 2, None, True)] + END, "machine long, event_id long, t string, flagged boolean")
    df = df.select("machine", "event_id", F.col("t").cast("timestamp").alias("ts"), "flagged")
    path, out = fresh_path(spark, "f"), fresh_path(spark, "o")
    df.write.parquet(path)
    ST.run_available(ST.debounce_stream(ST.read_stream(spark, path, df.schema)), out)
    assert spark.read.parquet(out).count() == 0


def test_outer_join_of_streams_waits_for_the_watermark(spark):
    at = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("tick") * 120 + 1_704_067_200))
    tel = at(spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (1, 90, 0.7)], "machine long, tick long, p double"))
    flow = at(spark.createDataFrame([(1, 1, True), (2, 2, False), (1, 90, True)], "machine long, tick long, flagged boolean"))
    a, b, out, log = (fresh_path(spark, x) for x in "abol")
    write_slices(tel, a, "tick < 50", "tick > 50")
    write_slices(flow, b, "tick < 50", "tick > 50")
    read = lambda p, df: ST.read_stream(spark, p, df.schema, files_per_batch=1)
    run = lambda: ST.run_available(ST.join_stream(read(a, tel), read(b, flow)), out, checkpoint=log)
    run()
    rows = lambda: {(r["machine"], r["tick"], r["p"], r["flagged"]) for r in spark.read.parquet(out).collect()}
    want = {(1, 0, 0.5, None), (1, 1, 0.6, True), (2, 2, None, False), (1, 90, 0.7, True)}
    assert rows() == want
    write_slices(tel.filter("tick = 0"), a, "true")
    run()
    assert rows() == want


def test_both_sides_of_a_stream_join_move_on_together(spark, monkeypatch):
    """A side without rows still moves the watermark, and the batches grow in number with the rows."""
    from plantwatch.plans import stream_queries as Q
    from plantwatch.session import ROWS_PER_TASK_KEY
    monkeypatch.setattr(Q, "BATCH_TASKS", 1)
    spark.conf.set(ROWS_PER_TASK_KEY, "50")
    try:
        long_, short = spark.range(300).selectExpr("1L as machine", "id as tick", "0.5D as p"), spark.range(9).selectExpr("1L as machine", "id as tick", "true as flagged")
        a, b = Q.paired_feeds(spark, {"telemetry": long_, "flows": short})
    finally:
        spark.conf.unset(ROWS_PER_TASK_KEY)
    ends = []
    for path, _, files in (a, b):
        rows = spark.read.parquet(path).select("ts", "machine", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).toPandas()
        batches = rows.groupby("file").agg({"at": "min", "ts": "max"}).sort_values(["at", "ts"])["ts"].tolist()
        assert len(rows) - rows["machine"].isna().sum() == {a[0]: 301, b[0]: 10}[path]
        assert len(batches) >= 8 * files
        ends.append(batches[:6 * files:files])
    # The cuts lie on whole ticks of both sides together; each of the first slices ends there in both feeds.
    assert ends[0] == ends[1]


def test_timeline_without_flows(spark, sf):
    line = tl.build_timeline(V.telemetry(spark, sf), None, primary=V.PRIMARY, early=V.EARLY)
    assert "attack_p" not in line.columns and line.filter("confirmed or level in ('CRITICAL', 'NETWORK ALERT')").count() == 0
    assert set(tl.timeline_kpis(line, net_on=False).columns) == {"peak_failure_probability", "machines_with_alarm"}


def test_events_name_the_top_driver(spark):
    tel = spark.createDataFrame([(0, 0, 0.9, [("Torque", 1.2)]), (0, 1, 0.01, [])],
                                "machine long, tick long, p double, drivers array<struct<feature:string,shap:double>>")
    texts = [r["text"] for r in tl.level_events(tl.build_timeline(tel, None)).orderBy("tick").collect()]
    assert texts == ["CNC-1 ALARM: Failure probability 90.0% is above the primary threshold. Top driver: Torque.",
                     "CNC-1 returned to OK"]


def test_hash_mod_is_even(spark):
    n = spark.range(4000).groupBy(hash_mod("id", 1, 4).alias("m")).count().collect()
    assert len(n) == 4 and all(850 < r["count"] < 1150 for r in n)


def test_waiting_rows_are_one_state_element():
    """What a machine keeps costs a call per element, so the rows of a batch are one; NULL, NaN-free numbers and flags come back whole."""
    import pandas as pd
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
    from plantwatch.streaming.streams import AT, TrailingFlags

    class Kept:
        def __init__(self):
            self.rows = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        put = lambda self, rows: setattr(self, "rows", list(rows))
        appendList = lambda self, rows: self.rows.extend(rows)
        clear = lambda self: self.rows.clear()

    class Handle:
        getListState = staticmethod(lambda name, schema: Kept())
        registerTimer = staticmethod(lambda at: None)

    columns = [AT, "tick", "flagged", "p"]
    kinds = [LongType(), LongType(), BooleanType(), DoubleType()]
    flags = TrailingFlags("machine", columns, "flagged", ["p"], 3, StructType([StructField(c, k) for c, k in zip(columns, kinds)]))
    flags.init(Handle())
    rows = pd.DataFrame({AT: range(1000), "tick": [2**60 + i for i in range(1000)],
                         "flagged": [None if i % 3 == 0 else i % 2 == 0 for i in range(1000)], "p": [None if i % 5 == 0 else i / 7 for i in range(1000)]})
    list(flags.handleInputRows((1,), iter([rows]), None))
    assert len(flags.waiting.rows) == 1
    back = flags._frame(flags.waiting)
    assert [list(r) for r in back.to_numpy()] == [[i, 2**60 + i, None if i % 3 == 0 else i % 2 == 0, None if i % 5 == 0 else i / 7] for i in range(1000)]


def test_machines_share_a_state(spark, monkeypatch):
    """Few states hold all machines: counts and the row before stay with their machine, over batches, NULLs and rows that come late."""
    from plantwatch.streaming import streams
    monkeypatch.setattr(streams, "BUCKETS", 2)
    made, keep = [], streams.TrailingFlags
    monkeypatch.setattr(streams, "TrailingFlags", lambda *a: made.append(a[0]) or keep(*a))
    df = spark.range(400).selectExpr(
        "id % 9 as machine", "id as tick", "case when id % 7 < 5 then id % 3 = 0 end as flagged", "case when id % 5 > 0 then id / 7 end as p",
        "timestamp_seconds(1704067200 + 60 * id) as ts").cache()
    path, out = fresh_path(spark, "f"), fresh_path(spark, "o")
    write_slices(df, path, "tick < 100", "tick between 105 and 250", "tick between 100 and 104", "tick > 250")
    end = spark.createDataFrame([("2024-03-01 00:00:00",)], "t string").selectExpr("cast(t as timestamp) as ts")
    df.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    stream = ST.read_stream(spark, path, df.schema, files_per_batch=1)
    ST.run_available(ST.trailing_stream(stream, ["tick"], "flagged", 3, "200 minutes", ["p"]), out)
    w = "over (partition by machine order by tick"
    want = df.selectExpr("machine", "tick", "flagged", "p", f"lag(p) {w}) as prev_p", f"count_if(flagged) {w} rows 2 preceding) as n_flagged",
                         f"count(flagged) {w} rows 2 preceding) as n_seen").withColumn("prev_n_flagged", F.expr(f"lag(n_flagged) {w})"))
    got = spark.read.parquet(out).select(*want.columns)
    assert made == ["_bucket"] and got.count() == 400
    assert got.exceptAll(want).count() == 0
