"""Accounting of conversion jobs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import extract

# States in which a job is over.
FINISHED = ["completed", "failed", "cancelled", "user_browser_required"]


def stage_durations(events: DataFrame) -> DataFrame:
    """(job_id, stage, run, state, started_at, ended_at, duration_ms) of events (job_id, seq,
    event_ts, event, stage), where event is job_start, stage_start or stage_done, in order of
    event_ts and seq, whatever the order of the rows.

    A start is paired with the next event of its stage: with a done it is a closed run; with
    another start it is restarted and has no end; with none it is open. A done without a
    start before it is timed from the job's last done or start of the job (unstarted; null
    if there is none). Other events take no part. Runs of a stage count from 0."""
    kind = F.when(F.col("event") == "stage_start", 0).when(F.col("event") == "stage_done", 1).when(F.col("event") == "job_start", 2)
    rows = events.select("job_id", "seq", "event_ts", "stage", kind.alias("kind")).where("kind IS NOT NULL AND event_ts IS NOT NULL")
    order = ["event_ts", "seq"]
    marks = Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    timed = rows.withColumn("mark", F.last(F.when(F.col("kind") > 0, F.col("event_ts")), ignorenulls=True).over(marks)).where("kind < 2")
    stage = Window.partitionBy("job_id", "stage").orderBy(*order)
    near = timed.withColumns({"after": F.lead("kind").over(stage), "then": F.lead("event_ts").over(stage), "before": F.lag("kind").over(stage)})
    runs = near.where((F.col("kind") == 0) | F.col("before").isNull() | (F.col("before") == 1))
    start = F.col("kind") == 0
    state = F.when(~start, "unstarted").when(F.col("after") == 1, "closed").when(F.col("after") == 0, "restarted").otherwise("open")
    named = runs.withColumns({"state": state, "started_at": F.when(start, F.col("event_ts")).otherwise(F.col("mark")), "ended_at": F.when(~start, F.col("event_ts")).when(F.col("after") == 1, F.col("then")), "run": F.row_number().over(stage) - 1})
    length = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    return named.select("job_id", "stage", "run", "state", "started_at", "ended_at", F.floor(length).alias("duration_ms"))


def job_summary(timings: DataFrame, slowest: int = 5, stages: DataFrame | None = None) -> DataFrame:
    """Per job of timings (job_id, seq, url, duration_ms, success, error_type): total,
    processed, failed, duration_ms, the failed sources as (url, error_type), and the slowest
    as (duration_ms, url), ties in order. With stages, the events of stage_durations, also
    each stage's runs that ended as (stage, runs, duration_ms), in order of their ends."""
    ranked = timings.withColumn("k", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("duration_ms"), "seq")))
    bad = ~F.coalesce("success", F.lit(False))
    pack = lambda when, *fields: F.collect_list(F.when(when, F.struct(*fields)))
    out = ranked.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), F.sum("duration_ms").alias("duration_ms"),
        F.array_sort(pack(bad, "seq", "url", F.coalesce("error_type", F.lit("Unknown")).alias("error_type"))).alias("f"),
        F.array_sort(pack(F.col("k") <= slowest, "k", "duration_ms", "url")).alias("s"),
    )
    failed = F.transform("f", lambda x: F.struct(x["url"].alias("url"), x["error_type"].alias("error_type")))
    slow = F.transform("s", lambda x: F.struct(x["duration_ms"].alias("duration_ms"), x["url"].alias("url")))
    found = out.select("job_id", "total", "processed", "failed", "duration_ms", failed.alias("failed_sources"), slow.alias("slowest"))
    if stages is None:
        return found
    ended = stage_durations(stages).where("ended_at IS NOT NULL").groupBy("job_id", "stage").agg(F.min("ended_at").alias("first"), F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("duration_ms"))
    listed = F.array_sort(F.collect_list(F.struct("first", "stage", "runs", "duration_ms")))
    per_job = ended.groupBy("job_id").agg(F.transform(listed, lambda x: F.struct(x["stage"].alias("stage"), x["runs"].alias("runs"), x["duration_ms"].alias("duration_ms"))).alias("stages"))
    return found.join(per_job, "job_id", "left")


def retry_as_generic(sources: DataFrame, books: DataFrame) -> DataFrame:
    """books of sources (page_id, url, html, is_forum), with generic articles in place of
    forum sources that gave none: (page_id, url, title, html, retried)."""
    missing = sources.where(F.coalesce("is_forum", F.lit(False))).join(books.select("page_id").distinct(), "page_id", "left_anti")
    again = extract.extract_articles(missing).where("success").select("page_id", "url", "title", F.col("article_html").alias("html"), F.lit(True).alias("retried"))
    return books.select("page_id", "url", "title", "html", F.lit(False).alias("retried")).unionByName(again)


def expire_jobs(jobs: DataFrame, now: float, retention_s: float = 7200) -> DataFrame:
    """Jobs that stay: not finished, or updated (ISO text or number of seconds) within the
    retention; a time that does not parse counts as 0."""
    at = F.coalesce(F.col("updated_at").cast("string").try_cast("double"), F.unix_timestamp(F.col("updated_at").cast("string").try_cast("timestamp")).cast("double"), F.lit(0.0))
    return jobs.where(~F.coalesce(F.col("status").isin(FINISHED), F.lit(False)) | (at > now - retention_s))
