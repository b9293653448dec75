"""Jobs of a log: the batch against a plain fold, the stream against the batch, the newest feedback."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from citelens.streaming import logs

BEGAN = datetime(2024, 1, 1)
SCHEMA = "job string, ts timestamp, event string"


def plain_jobs(events):
    """Line by line, in order of time."""
    found = {}
    for job, ts, event in sorted(events, key=lambda e: (e[1], logs.KINDS.index(e[2]))):
        info = found.get(job)
        if event in logs.BEGIN:
            info = found.setdefault(job, {"start": ts, "end": None, "status": None, "type": None, "clicks": 0, "papers": False, "graph": False, "question": False})
        if info is None:
            continue
        ended = event in ("error", "not_found", "result")
        if event == "result":
            info["type"] = "terms"
        if event == "paper":
            if info["type"] == "terms":
                info["clicks"] += 1
            else:
                info["type"], ended = "paper", True
        if ended:
            info["end"] = info["end"] or ts
            info["status"] = {"error": "Error", "not_found": "Not found"}.get(event, "Ok")
        if event in logs.FLAGS:
            info[event] = True
    return {job: tuple(info.values()) for job, info in found.items()}


def some_events(seed=0):
    rng = random.Random(seed)
    return [(f"j{rng.randrange(60)}", BEGAN + timedelta(minutes=rng.randrange(400)), rng.choice(logs.KINDS)) for _ in range(300)]


def told(rows):
    return {r.job: tuple(r)[1:] for r in rows}


def test_jobs_are_those_of_the_plain_fold(spark):
    events = some_events()
    odd = [(None, BEGAN, "start"), ("", BEGAN, "start"), ("x", None, "start"), ("y", BEGAN, "other"), ("z", BEGAN, "graph")]
    got = logs.jobs(spark.createDataFrame(events + odd, SCHEMA))
    assert told(got.collect()) == plain_jobs(events)
    assert logs.jobs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    """Shuffled micro-batches of one file each, in two runs from one checkpoint; a last event far on closes all jobs."""
    events = some_events(1)
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    random.Random(2).shuffle(events)
    late = [("last", BEGAN + timedelta(days=9), "start")]

    def run(*parts):
        for part in parts:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = logs.jobs_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()

    run(events[:100], events[100:150])
    run(events[150:], late)
    assert told(spark.read.parquet(out).collect()) == plain_jobs(events)


def test_recent_feedback(spark):
    at = lambda m: BEGAN + timedelta(minutes=m)
    marks = [("k", 1, False, at(5), "a"), ("k", 1, True, at(6), "a"), ("m", 0, False, at(7), "a"), ("k", 1, False, at(1), "b"), ("k", -1, True, at(9), "b"), ("k", 1, False, at(9), None)]
    searches = [("a", "first", at(0)), ("a", "second", at(6)), ("b", None, at(2)), (None, "none", at(0))]
    m = spark.createDataFrame(marks, "key string, value int, cancel boolean, ts timestamp, job string")
    s = spark.createDataFrame(searches, "job string, query string, ts timestamp")
    got = [tuple(r) for r in logs.recent_feedback(m, s).withColumn("ts", F.minute("ts")).collect()]
    assert got == [(9, "k", "Yes", "NA"), (7, "m", "Meh", "second"), (6, "k", "No", "second"), (5, "k", "Yes", "first")]
    assert logs.recent_feedback(m, s, 1).count() == 1 and logs.recent_feedback(m.limit(0), s).count() == 0
