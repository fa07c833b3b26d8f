"""Registered queries: job state and the batch twins of the streams (A10, A15, E4, E8, E11, F2, L)."""

import uuid

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import jobs as J
from ..sources import tables as T
from ..sources.shared import settled, shared_dir
from ..sources.tables import table
from ..streaming import progress as R

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'pending' END"


def orders(spark, d):
    return table(spark, d, "orders").withColumn("status", F.expr(_STATUS))


def stages(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


@register("job_listing", f"SELECT o_orderkey AS job_id, {_STATUS} AS status, o_orderdate::DATE::VARCHAR AS created FROM orders ORDER BY created DESC, job_id")
def job_listing(spark, d):
    listed = orders(spark, d).select(F.col("o_orderkey").alias("job_id"), "status", F.col("o_orderdate").cast("date").cast("string").alias("created"))
    return listed.orderBy(F.desc("created"), "job_id")  # newest first, sorted by ranges


@register("project_known_fields", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.voice'), 'default') AS voice FROM events")
def project_known_fields(spark, d):
    known = F.from_json("props", "k long, voice string")
    return table(spark, d, "events").select("event_id", F.coalesce(known["k"], F.lit(0)).alias("k"), F.coalesce(known["voice"], F.lit("default")).alias("voice"))


@register("job_progress", "SELECT l_orderkey AS job_id, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS total FROM lineitem GROUP BY 1")
def job_progress(spark, d):
    return J.progress(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "job_id"), "job_id", F.col("l_linestatus") == "F")


@register("pending_chapters", "SELECT l_orderkey AS job_id, l_linenumber AS chapter_index, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_linenumber = l.l_linenumber AND f.l_linestatus = 'F' AND EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = f.l_orderkey AND a.l_linenumber = f.l_linenumber AND a.l_quantity > 10))")
def pending_chapters(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chapter_index"), "l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    keys = ["job_id", "chapter_index"]
    return J.pending(rows, rows.where("l_linestatus = 'F'"), rows.where("l_quantity > 10"), keys).select(*keys, "l_partkey", "l_suppkey")


@register("changed_sources", "WITH o AS (SELECT doc_id, sha256(text) AS sha, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text||'x') ELSE sha END AS sha, CASE WHEN doc_id % 7 = 0 THEN n + 1 ELSE n END AS n FROM o JOIN documents USING (doc_id)) SELECT doc_id, o.sha <> c.sha AS sha_changed, o.n <> c.n AS chapters_changed FROM o JOIN c USING (doc_id) WHERE o.sha <> c.sha OR o.n <> c.n")
def changed_sources(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n"))
    old = t.select("doc_id", F.sha2("text", 256).alias("sha"), "n")
    new = t.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha"), F.when(F.col("doc_id") % 7 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return J.changed_sources(old, new, "doc_id")


@register("job_live_flag", f"SELECT o_orderkey AS job_id, {_STATUS} AS status, o_orderkey IN (SELECT user_id FROM events) AS live FROM orders")
def job_live_flag(spark, d):
    live = table(spark, d, "events").select(F.col("user_id").alias("u")).distinct()
    return orders(spark, d).join(live, F.col("o_orderkey") == F.col("u"), "left").select(F.col("o_orderkey").alias("job_id"), "status", F.col("u").isNotNull().alias("live"))


@register(
    "reconcile_running",
    f"""SELECT job_id, CASE WHEN gone THEN 'interrupted' ELSE status END AS status, CASE WHEN gone THEN 'Interrupted when the server stopped' END AS error, gone AS changed
    FROM (SELECT o_orderkey AS job_id, {_STATUS} AS status, o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AS gone FROM orders)""",
)
def reconcile_running(spark, d):
    jobs = orders(spark, d).select(F.col("o_orderkey").alias("job_id"), "status", F.lit(None).cast("string").alias("error"))
    return J.reconciled(jobs, table(spark, d, "events").select(F.col("user_id").alias("job_id")))


@register("latest_progress", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, max(ts)::TIMESTAMP AS ts FROM events GROUP BY 1")
def latest_progress(spark, d):
    return J.latest(stages(spark, d), "job_id", ["ts", "event_id"], ["stage", "ts"])


@register("terminal_events", "SELECT event_id, user_id AS job_id, event_type AS stage FROM events WHERE event_type IN ('purchase', 'signup')")
def terminal_events(spark, d):
    return stages(spark, d).where(F.col("stage").isin("purchase", "signup")).select("event_id", "job_id", "stage")


_SESS = "SELECT user_id AS job_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS \"end\", count(*) AS n, CASE WHEN bool_or(event_type = 'purchase') THEN 'done' ELSE 'interrupted' END AS status FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s"


@register("orphan_sessions", _SESS)
def orphan_sessions(spark, d):
    return R.interrupted(stages(spark, d))


@register(
    "closed_runs",
    """WITH e AS (SELECT user_id AS job_id, event_type AS stage, ts::TIMESTAMP AS ts, event_id, event_type IN ('purchase', 'signup') AS terminal FROM events),
    b AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS begun FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(begun::INT) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM b),
    o AS (SELECT *, count(*) FILTER (terminal) OVER (PARTITION BY job_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM r)
    SELECT job_id, stage, ts, event_id FROM o WHERE ended = 0
    UNION ALL SELECT job_id, 'interrupted', max(ts) + INTERVAL 30 MINUTE, NULL FROM r GROUP BY job_id, run HAVING NOT bool_or(terminal)""",
)
def closed_runs(spark, d):
    return R.closed_runs_batch(stages(spark, d), terminal=("purchase", "signup"))


@register("progress_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type AS stage, count(*) AS n FROM events GROUP BY ALL")
def progress_tumbling(spark, d):
    return R.throughput(stages(spark, d))


@register("progress_stream", "SELECT user_id AS job_id, event_type AS stage, count(*) AS n FROM events GROUP BY ALL")
def progress_stream(spark, d):
    return stages(spark, d).groupBy("job_id", "stage").agg(F.count("*").alias("n"))


_MOVE = "CASE before WHEN 'pending' THEN status IN ('running', 'cancelled') WHEN 'running' THEN status IN ('done', 'failed', 'cancelled', 'interrupted') WHEN 'interrupted' THEN status = 'running' WHEN 'failed' THEN status = 'running' WHEN 'cancelled' THEN status = 'running' WHEN 'done' THEN false ELSE status IN ('pending', 'running') END"
_AS_STATUS = "CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' WHEN 4 THEN 'interrupted' ELSE 'cancelled' END"


@register("status_transitions", f"SELECT event_id, job_id, before, status, {_MOVE} AS legal FROM (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS before FROM (SELECT event_id, user_id AS job_id, ts, {_AS_STATUS} AS status FROM events))")
def status_transitions(spark, d):
    rows = stages(spark, d).withColumn("status", F.expr(_AS_STATUS))
    return J.transitions(rows, "job_id", "status", ["ts", "event_id"]).select("event_id", "job_id", "before", "status", "legal")


@register("create_jobs", "SELECT source||'-'||left(sha256(source), 6) AS job_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index, lang AS title, false AS done, count(*) OVER (PARTITION BY source) AS n_chapters FROM documents")
def create_jobs(spark, d):
    jobs, rows = J.create_jobs(table(spark, d, "documents"), "source", "doc_id", "lang")
    return rows.join(jobs.select("job_id", "n_chapters"), "job_id")


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("chapter_checkpoints", "SELECT l_orderkey AS job_id, l_linenumber AS chapter_index, sum(l_quantity) AS n_chunks FROM lineitem GROUP BY ALL")
def chapter_checkpoints(spark, d):
    """The chapter sink's batches: one is cut short and run again, the last sends finished chapters once more, changed."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chapter_index"), "l_quantity")
    rows = settled(lines.repartition(T.tasks(lines.count()), "job_id", "chapter_index").groupBy("job_id", "chapter_index").agg(F.sum("l_quantity").alias("n_chunks")), "chapters")
    path, late = _folder(spark, "checkpoints"), F.col("chapter_index") % 3 == 2
    T.write_checkpoints(rows.where(~late & (F.col("job_id") % 2 == 0)), path, "first")
    T.write_checkpoints(rows.where(~late), path, "first")
    T.write_checkpoints(rows.where(late).unionByName(rows.where(~late).withColumn("n_chunks", F.lit(-1.0))), path, "second")
    return T.read_checkpoints(spark, path).select("job_id", "chapter_index", "n_chunks")


@register(
    "manifest_merge",
    f"""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 11 = 0 THEN 'cancelled' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE {_STATUS} END AS status, o_custkey AS n_chapters FROM orders""",
)
def manifest_merge(spark, d):
    """Manifests of all jobs, some of them replaced, the last of two rows of a job counting."""
    jobs, path = orders(spark, d).select(F.col("o_orderkey").alias("job_id"), "status", F.col("o_custkey").alias("n_chapters")).withColumn("written", F.lit(0)), _folder(spark, "manifests")
    T.write_manifests(jobs, path, ["written"])
    again = jobs.where("job_id % 7 = 0 or job_id % 11 = 0").withColumns({"status": F.lit("failed"), "written": F.lit(1)})
    T.write_manifests(again.unionByName(again.where("job_id % 11 = 0").withColumns({"status": F.lit("cancelled"), "written": F.lit(2)})), path, ["written"])
    return spark.read.parquet(path).select("job_id", "status", "n_chapters")


@register(
    "manifest_scan",
    f"""SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey::VARCHAR END AS job_id, CASE WHEN o_orderkey % 50 <> 0 THEN {_STATUS} END AS status,
        CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END AS created_at, o_orderkey % 50 = 0 AS broken, o_orderkey % 4 AS part FROM orders""",
)
def manifest_scan(spark, d):
    """Manifests written as JSON lines, every fiftieth cut off, read with the folder that they came from."""
    whole = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("job_id"), "status", F.col("o_totalprice").alias("created_at"), F.lit(1).alias("unknown")))
    line = F.when(F.col("o_orderkey") % 50 == 0, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line"))
    path = _folder(spark, "manifest-lines")
    orders(spark, d).withColumn("line", whole).select(line.alias("value"), (F.col("o_orderkey") % 4).alias("part")).write.partitionBy("part").text(path)
    part = F.regexp_extract("file", r"/part=(\d+)/", 1).cast("long")
    return T.scan_manifests(spark, path, documents=False).select("job_id", "status", "created_at", F.col("broken").isNotNull().alias("broken"), part.alias("part"))
