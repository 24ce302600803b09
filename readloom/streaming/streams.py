"""Streams of the queue and of job timings. The watermarks are ours: they bound the state,
and rows later than them are dropped."""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_queue(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row per url (trimmed, http only) of an endless feed (url, saved_at timestamp)
    within the late-data limit."""
    named = stream.withColumn("url", F.trim("url")).where(F.col("url").startswith("http"))
    return named.withWatermark("saved_at", late).dropDuplicatesWithinWatermark(["url"])


def stream_job_timings(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and milliseconds per job and tumbling window of event_ts."""
    seen = stream.withWatermark("event_ts", late).groupBy(F.window("event_ts", width).alias("w"), "job_id")
    bad = ~F.coalesce("success", F.lit(False))
    return seen.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"), F.sum("duration_ms").alias("duration_ms")).select("job_id", F.col("w.start").alias("window_start"), "total", "failed", "duration_ms")


_STAGES = "job_id string, stage string, state string, started_at timestamp, ended_at timestamp, duration_ms long"


def _paired(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Runs of a bucket's stages that new events or the watermark end. The state lists the
    open starts as (job, stage, micros)."""
    held = json.loads(state.get[0]) if state.exists else []
    old = pd.DataFrame(held, columns=["job_id", "stage", "at"]).astype({"at": "int64"})
    new = pd.concat(list(parts), ignore_index=True) if not state.hasTimedOut else None
    if new is None or new.empty:
        out, left, touched = [], old, np.zeros(len(old), bool)
    else:
        new["at"], new["rank"] = new["event_ts"].astype("datetime64[us]").astype("int64"), 1
        first = old.assign(event="stage_start", seq=new["seq"].iloc[0], rank=0).astype({"seq": new["seq"].dtype})
        both = pd.concat([first, new[first.columns]], ignore_index=True) if len(old) else new
        both["key"] = both.groupby(["job_id", "stage"], sort=False, dropna=False).ngroup()
        both = both.sort_values(["key", "rank", "at", "seq"], ignore_index=True)
        # a start is ended by the next event of its stage
        k, at, start = both["key"].to_numpy(), both["at"].to_numpy(), (both["event"] == "stage_start").to_numpy()
        more = np.r_[k[1:] == k[:-1], False]
        closed = start & more & ~np.r_[start[1:], False]
        ended = both[start & more][["job_id", "stage"]].assign(state=np.where(closed, "closed", "restarted")[start & more], started=at[start & more], ended=np.where(closed, np.roll(at, -1), -1)[start & more])
        left, touched = both[start & ~more], (both["rank"] == 1).to_numpy()[start & ~more]
        out = [ended]
    # a start that no event came to is open once the watermark is past it
    mark = state.getCurrentWatermarkMs()
    late = ~touched & (left["at"].to_numpy() // 1000 + 1 < mark)
    out.append(left[late][["job_id", "stage"]].assign(state="open", started=left["at"].to_numpy()[late], ended=-1))
    left = left[~late]
    if len(left):
        state.update((json.dumps(left[["job_id", "stage", "at"]].to_numpy(object).tolist()),))
        state.setTimeoutTimestamp(max(mark, int(left["at"].min()) // 1000) + 1)
    elif state.exists:
        state.remove()
    told = pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)
    if len(told):
        done = told["state"] == "closed"
        times = {c: pd.Series(told[c].to_numpy("int64").astype("datetime64[us]")) for c in ("started", "ended")}
        length = ((told["ended"] - told["started"]) // 1000).astype("Int64").where(done)
        yield pd.DataFrame({"job_id": told["job_id"], "stage": told["stage"], "state": told["state"], "started_at": times["started"], "ended_at": times["ended"].where(done), "duration_ms": length})


def stream_stage_durations(stream: DataFrame, late: str = "1 hour", longest: str = "1 day", buckets: int = 1024) -> DataFrame:
    """(job_id, stage, state, started_at, ended_at, duration_ms) of an endless feed (job_id,
    seq, event_ts, event, stage): a stage's start is held as keyed state until its done
    (closed) or another start (restarted) comes; once the watermark is past it by `longest`
    it is told as open. A done whose start is not held is left out, as are events without a
    time, and events later than `late` are dropped, so the state holds one start for each
    stage in work. Stages are dealt into buckets by hash; a bucket has one state and is
    paired at once, so that calls do not grow with the stages."""
    rows = stream.select("job_id", "stage", "seq", "event", "event_ts").where(F.col("event").isin("stage_start", "stage_done") & F.col("event_ts").isNotNull())
    # the watermark lags by both: a start may wait that long for its done
    marked = rows.withColumns({"job_id": F.col("job_id").cast("string"), "stage": F.col("stage").cast("string")}).withWatermark("event_ts", f"{late} {longest}")
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("job_id", "stage"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_paired, _STAGES, "held string", "append", GroupStateTimeout.EventTimeTimeout)
