import pytest
from pyspark.sql import functions as F

from flowwarden.operators import chain as C
from flowwarden.operators import detect as D
from flowwarden.plans import queries as Q
from flowwarden.session import shared_folder
from flowwarden.sources import artifacts as A
from flowwarden.sources import flows as S
from flowwarden.streaming import jobs as T

SF = "/root/testdata/sf0.001"


def test_csv_is_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flag,duration,serror_rate,note\nSF,3,0.5,x\nS0,,,\n")
    df = S.read_flow_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"flag": "string", "duration": "bigint", "serror_rate": "double", "note": "string"}
    assert [tuple(r) for r in df.collect()] == [("SF", 3, 0.5, "x"), ("S0", None, None, None)]
    with pytest.raises(ValueError):
        S.check_input("flows.json")


def test_row_positions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("cast(id as int) as n").repartition(5).write.csv(path)
    df = S.with_row_position(spark.read.schema("n int").csv(path))
    assert sorted(r["flow_id"] for r in df.collect()) == list(range(1000))
    assert S.with_row_position(spark.read.schema("n int").csv(path).where("false")).count() == 0


def test_spread_leaves_large_inputs_alone(spark):
    many = spark.range(0, 100, 1, 32)
    assert S.spread(many, "id") is many
    assert S.spread(spark.range(0, 100, 1, 1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_manifest(spark, tmp_path):
    out, rows = str(tmp_path), spark.range(1000).repartition(3)
    A.record(rows, out, "a_", "20240101_000000", "data", "csv")
    A.record(rows.where("id < 10"), out, "a_", "20240201_000000", "data")
    A.record(rows.where("false"), out, "b_", "20240115_000000", "log")
    done = A.manifest(spark, out)
    assert sorted(map(tuple, A.output_catalog(done).collect())) == [("data", 2, 1010, "20240201_000000"), ("log", 1, 0, "20240115_000000")]
    newest = A.newest_output(done, "a_").first()
    assert newest["n_rows"] == 10 and spark.read.parquet(newest["path"]).count() == 10
    assert A.newest_output(done, "c_").count() == 0
    with pytest.raises(Exception, match="already exists"):
        A.record(rows, out, "a_", "20240101_000000", "data", "csv")
    assert done.count() == 3                                                # what failed is not listed


def test_artifacts(spark, tmp_path):
    for stamp in ("20240101_000000", "20240301_120000", "20240201_000000"):
        (tmp_path / f"predictions_with_actions_{stamp}.csv").write_text("a\n")
    (tmp_path / "roc.png").write_bytes(b"1234")
    (tmp_path / "notes.txt").write_text("x")
    files = A.list_artifacts(spark, str(tmp_path))
    totals = {r["kind"]: (r["files"], r["bytes"]) for r in A.catalog_totals(A.artifact_catalog(files)).collect()}
    assert totals == {"data": (3, 6), "images": (1, 4)}
    assert A.latest_run(files, "predictions_with_actions_").first()["run_stamp"] == "20240301_120000"


@pytest.fixture(scope="module")
def feed(spark):
    """The events cut into four files in id order, arriving one per micro-batch."""
    folder = shared_folder(spark)
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(4):
        part = events.where((F.col("event_id") >= 250 * i) & (F.col("event_id") < 250 * (i + 1))).coalesce(1)
        part.write.mode("append").parquet(folder)
    return folder


def stream(spark, feed):
    return T.read_event_stream(spark, feed, "*.parquet", files_per_batch=1)


def finish(run):
    run.awaitTermination()
    assert run.exception() is None
    return run


def test_stream_alerts_equal_batch(spark, feed):
    out = shared_folder(spark)
    run = finish(T.run_append(T.stream_alerts(stream(spark, feed)), f"{out}/a", f"{out}/c"))
    assert len(run.recentProgress) >= 4
    got = spark.read.parquet(f"{out}/a")
    want = D.alerts(Q.graded(spark, SF))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_chain_continues_over_batches_and_restarts(spark, feed):
    out = shared_folder(spark)
    span = 300                                   # segments cross micro-batches
    chained = lambda: finish(T.run_chain(stream(spark, feed), f"{out}/log", f"{out}/heads", f"{out}/c", span))
    run = chained()
    assert not any(p["stateOperators"] for p in run.recentProgress)             # the heads table is all that is kept
    log = spark.read.parquet(f"{out}/log").drop("batch_id")
    want = C.append_flows(Q.graded(spark, SF), span)
    cols = ["segment", "block_index", "sample_index", "previous_hash", "hash"]
    assert sorted(map(tuple, log.select(*cols).fillna(-1).collect())) == sorted(map(tuple, want.select(*cols).fillna(-1).collect()))
    assert C.verify_chain(log).where("not is_valid").count() == 0
    blocks = log.count()
    # a restart with one more file extends the last segment instead of opening a new chain
    extra = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 40").withColumn("event_id", F.col("event_id") + 1000)
    extra.coalesce(1).write.mode("append").parquet(feed)
    chained()
    longer = spark.read.parquet(f"{out}/log").drop("batch_id")
    assert longer.count() > blocks and longer.where("sample_index >= 1000").count() > 0
    assert C.verify_chain(longer).where("not is_valid").count() == 0
    assert longer.where("block_index = 0").groupBy("segment").count().where("count > 1").count() == 0


def test_stream_severity_ignores_session_zone(spark):
    out = shared_folder(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        finish(T.run_update(T.stream_severity(T.read_event_stream(spark, SF)), ["window_start", "severity_level"], f"{out}/n", f"{out}/c"))
        got = {(str(r["window_start"])[:10], r["severity_level"]): r["n"] for r in T.newest_result(spark, f"{out}/n").collect()}
        want = Q.graded(spark, SF).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d"), "severity_level").count().collect()
        assert got == {(r["d"], r["severity_level"]): r["count"] for r in want}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_counters_drop_state_and_late_rows(spark):
    """Days arrive one by one, then a row of the first day: its state is gone, the row is left out and counted."""
    feed, out = shared_folder(spark), shared_folder(spark)
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 40").drop("ts").coalesce(1).cache()

    def counted(day):
        events.where("event_id <> 0" if day > 1 else "true").withColumn("ts", F.expr(f"timestamp_ntz'2024-01-01 12:00:00' + interval {day} days")).write.mode("append").parquet(feed)
        run = finish(T.run_update(T.stream_severity(T.read_event_stream(spark, feed, "*.parquet")), ["window_start", "severity_level"], f"{out}/n", f"{out}/c"))
        return T.late_rows(run), max(s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"])

    kept = [counted(day) for day in (1, 2, 3, 4, 5)]
    assert all(late == 0 for late, _ in kept) and max(rows for _, rows in kept) <= 2 * kept[0][1]       # of two days, not of all
    assert counted(1)[0] > 0
    table = {str(r["window_start"])[:10]: r["n"] for r in T.newest_result(spark, f"{out}/n").groupBy("window_start").agg(F.sum("n").alias("n")).collect()}
    assert table == {f"2024-01-0{d + 1}": 40 if d == 1 else 39 for d in (1, 2, 3, 4, 5)}
