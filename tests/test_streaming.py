"""Streams against their batch twins, and the resumable sinks."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.sources.tables import listed_manifests, read_checkpoints, read_manifests, scan_manifests, write_checkpoints, write_manifests, write_markers
from lectern.streaming import progress as R

SF = "/root/testdata/sf0.001"


def collected(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(r) for r in spark.table(name).collect()}


def test_streamed_sessions_are_the_batch_ones_but_for_the_open_tail(spark):
    batch_in = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    batch = {tuple(r) for r in R.interrupted(batch_in).collect()}
    streamed = collected(spark, R.interrupted(R.progress_stream(spark, SF), delay="1 hour"), "sessions")
    last = batch_in.agg(F.max("ts")).first()[0]
    assert streamed <= batch
    assert all((last - x[2]).total_seconds() <= 3600 for x in batch - streamed)


def test_tumbling_windows_stream(spark):
    batch = {tuple(r) for r in R.throughput(R.progress_stream(spark, SF).sparkSession.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))).collect()}
    streamed = collected(spark, R.throughput(R.progress_stream(spark, SF), delay="1 hour"), "tumbling")
    assert streamed and streamed <= batch


def test_respelling_stream_equals_batch(spark, tmp_path):
    texts = spark.createDataFrame([(1, "the Kizhi"), (2, "none")], "id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    assert collected(spark, R.respelled(stream, {"Kizhi": "Kee-zhee"}), "said") == {tuple(r) for r in R.respelled(texts, {"Kizhi": "Kee-zhee"}).collect()}


def test_chapter_sink_twice_gives_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([("j", 0, "a"), ("j", 1, "b"), ("k", 0, "c"), ("k", 0, "c")], "job_id string, chapter_index int, title string")
    rows.write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        R.chapter_sink(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.count() == got.select("job_id", "chapter_index").distinct().count() == 3
    write_checkpoints(rows.limit(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_manifests_and_markers(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.json").write_text('{"job_id": "a", "status": "done", "unknown": 1}')
    (tmp_path / "m/b.json").write_text("{broken")
    assert [(r.job_id, r.n_chapters) for r in read_manifests(spark, str(tmp_path / "m")).collect()] == [("a", None)]
    jobs = spark.createDataFrame([("done", "a"), ("done", "b")], "status string, job_id string")
    write_manifests(jobs, str(tmp_path / "jobs"))
    write_manifests(spark.createDataFrame([("failed", "a")], "status string, job_id string"), str(tmp_path / "jobs"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "jobs")).select("job_id", "status").collect()} == {("a", "failed"), ("b", "done")}
    lines = spark.createDataFrame([("x", 1, "two"), ("x", 0, "one")], "book string, line_no int, line string")
    write_markers(lines, str(tmp_path / "markers"))
    assert [r.value for r in spark.read.text(str(tmp_path / "markers/book=x")).collect()] == ["one", "two"]


def test_latest_states_stream_in_update_mode(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for k in (1, 2, 3):
        rows.where(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = lambda df: df.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    sent = []
    q = R.latest_states(events(one)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
    q.foreachBatch(lambda b, _: sent.append([tuple(r) for r in b.collect()])).start().awaitTermination()
    state = {}
    for batch in sent:
        state.update({r[0]: r for r in batch})
    assert len([b for b in sent if b]) == 3
    assert set(state.values()) == {tuple(r) for r in R.latest_states(events(rows)).collect()}


def test_following_a_job_ends_with_its_terminal_event(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, s, t + datetime.timedelta(minutes=k), k) for k, s in enumerate(["start", "half", "done", "late"])]
    df = spark.createDataFrame(rows, "job_id long, stage string, ts timestamp, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    R.follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b: got.extend(r.stage for r in b.orderBy("event_id").collect()), str(tmp_path / "at"))
    assert got == ["start", "half", "done"] and not [q for q in spark.streams.active if q.isActive]


def test_runs_of_all_jobs_are_closed_and_a_restart_goes_on(spark, tmp_path):
    """Three files in the order of time, one a trigger; between them the query is started anew from its checkpoint."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 40).alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
        rows = rows.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "event_id"))).persist()
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(rows.drop("part").schema).parquet(str(tmp_path / "in"))
        runs = R.closed_runs(stream, terminal=("purchase", "signup"))
        for k in (1, 2, 3):
            rows.where(f"part = {k}").drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = runs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        expected = {tuple(r) for r in R.closed_runs_batch(rows.drop("part"), terminal=("purchase", "signup")).collect()}
        assert len(got) == len(set(got)) and set(got) <= expected
        # What is missing are closings that the watermark has not reached.
        last = rows.agg(F.max("ts")).first()[0]
        missing = expected - set(got)
        assert all(x[1] == R.INTERRUPTED and (last - x[2]).total_seconds() <= 3600 for x in missing)
        assert {x[1] for x in got} >= {R.INTERRUPTED, "purchase", "signup"}
    finally:
        spark.conf.set(name, before)


def test_a_batch_cut_short_and_run_again_gives_each_chapter_once(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"j{k % 30}", k // 30, k) for k in range(300)], "job_id string, chapter_index int, n int")
    write_checkpoints(rows.where("n < 100"), out, "a-0")
    # Batch 1 has written half of its folders when it is killed; it is run again.
    write_checkpoints(rows.where("n >= 100 and n % 2 = 0"), out, "a-1")
    write_checkpoints(rows.where("n >= 100"), out, "a-1")
    write_checkpoints(rows, out, "b-0")  # another query, all over again
    write_checkpoints(rows.limit(0), out, "b-1")
    assert sorted(r.n for r in read_checkpoints(spark, out).collect()) == list(range(300))
    assert len(list((tmp_path / "out").glob("part=*"))) <= 64


def test_manifests_of_many_jobs_lie_in_few_folders(spark, tmp_path):
    out = str(tmp_path / "m")
    jobs = spark.range(100_000).select(F.concat(F.lit("job-"), F.col("id").cast("string")).alias("job_id"), F.lit("running").alias("status"), F.lit(0).alias("at"))
    write_manifests(jobs, out)
    one = spark.createDataFrame([("job-7", "failed", 1), ("job-7", "done", 2), ("job-new", "pending", 1)], "job_id string, status string, at int")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
    write_manifests(one, out, ["at"])
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
    assert len(set(before.items()) - set(after.items())) <= 2, "only folders of the two jobs are written anew"
    got = spark.read.parquet(out)
    assert got.count() == 100_001 and {(r.job_id, r.status) for r in got.where("status <> 'running'").collect()} == {("job-7", "done"), ("job-new", "pending")}
    assert len(list((tmp_path / "m").glob("part=*"))) <= 64


def test_manifest_files_with_ties_and_broken_ones(spark, tmp_path):
    for name, text in {"b": '{"job_id": "x", "created_at": 5}', "a": '{"job_id": "y", "created_at": 5}', "c": '{"job_id": "z", "created_at": 9, "more": 1}', "d": "{broken", "e": ""}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    scanned = scan_manifests(spark, str(tmp_path / "*"))
    assert [r.job_id for r in listed_manifests(scanned).collect() if r.job_id] == ["z", "y", "x"]
    assert [r.file[-15:] for r in scanned.where("broken is not null").collect()] == ["d/manifest.json"]


def test_silent_jobs_are_found_by_a_join_of_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    m = lambda k: t + datetime.timedelta(minutes=k)
    running = spark.createDataFrame([(1, m(0)), (2, m(5)), (3, m(10)), (1, m(90)), (9, m(300))], "job_id long, started timestamp")
    beats = spark.createDataFrame([(1, m(20)), (1, m(25)), (2, m(36)), (3, m(10)), (4, m(11)), (9, m(300))], "job_id long, ts timestamp")
    for name, df in (("running", running), ("beats", beats)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in (("running", running), ("beats", beats))]
    got = collected(spark, R.reconciled_stream(*streams), "silent")
    assert got == {tuple(r) for r in R.reconciled_batch(running, beats).collect()} and {x[:2] for x in got} == {(2, m(5)), (1, m(90))}


def test_no_task_of_a_sink_grows_with_its_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lectern.sources import tables as T

    monkeypatch.setattr(T, "ROWS_A_TASK", 500)
    rows = spark.range(10_000).select(F.lit("one").alias("job_id"), F.col("id").alias("chapter_index"))
    for batch in "ab":  # all of one job, so all in one folder; the second batch adds what the first lacks
        T.write_checkpoints(rows.where("chapter_index < 6000") if batch == "a" else rows, f"{tmp_path}/c", batch)
    T.write_manifests(rows.select(F.col("chapter_index").alias("job_id"), "chapter_index"), f"{tmp_path}/m", parts=1)
    assert T.read_checkpoints(spark, f"{tmp_path}/c").select("chapter_index").distinct().count() == T.read_checkpoints(spark, f"{tmp_path}/c").count() == 10_000
    for path in "cm":
        held = spark.read.parquet(f"{tmp_path}/{path}")
        sizes = held.groupBy(F.input_file_name()).count()
        assert held.count() == 10_000 and sizes.agg(F.max("count")).first()[0] <= 3000
