"""Log analytics: the same folds for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.functions.scalars import duration


def parse_lines(lines: DataFrame) -> DataFrame:
    """(ts, level, message, params): INFO and ERROR lines with a timestamp; other lines are left out."""
    pattern = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}).*?\b(INFO|ERROR)\b(.*)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select(F.try_to_timestamp(F.replace(part(1), F.lit(","), F.lit(".")), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).alias("ts"), part(2).alias("level"), F.trim(part(3)).alias("message"))
    return rows.filter("ts IS NOT NULL").withColumn("params", F.regexp_extract("message", r"(?:args|form|json): ?(\{.*\})", 1))


def sessions(events: DataFrame) -> DataFrame:
    """(job, start, end, status, clicks, features) from (job, ts, event): first start, first terminal event, its status."""
    terminal = F.col("event").isin("result", "error")
    return events.groupBy("job").agg(
        F.min("ts").alias("start"), F.min(F.when(terminal, F.col("ts"))).alias("end"),
        F.coalesce(F.min(F.when(terminal, F.struct("ts", F.when(F.col("event") == "result", "Ok").otherwise("Error").alias("status"))))["status"], F.lit("Not found")).alias("status"),
        F.count_if(F.col("event") == "paper").alias("clicks"), F.bool_or(F.col("event") == "feature").alias("features"), F.bool_or(F.col("event") == "papers").alias("listed"),
    )


#: Events of a job, in the order in which those of one moment count.
KINDS = ("start", "error", "not_found", "result", "paper", "papers", "graph", "question")
FLAGS = ("papers", "graph", "question")
BEGIN = ("start", "error", "not_found", "result")


def _job_events(events: DataFrame) -> DataFrame:
    """(job, ts, at, event): events of known kinds with a job and a time; ``at`` orders them."""
    told = events.filter(F.col("ts").isNotNull() & (F.col("job") != "") & F.col("event").isin(*KINDS))
    return told.select("job", "ts", F.struct("ts", F.array_position(F.array(*map(F.lit, KINDS)), F.col("event")).alias("kind")).alias("at"), "event")


def _status(event: Column) -> Column:
    return F.when(event == "error", "Error").when(event == "not_found", "Not found").otherwise("Ok")


def jobs(events: DataFrame) -> DataFrame:
    """(job, start, end, status, type, clicks, papers, graph, question) from (job, ts, event).

    A job starts with the first of its BEGIN events; what comes before is left out.  A result makes it a search for terms, and papers
    opened after the first result are clicks; a paper opened before any result makes it a search for that paper, which
    succeeds.  Errors, results and such papers are ends: the first gives the end, the last the status, null where there is none.
    Two aggregations, each summed in the map tasks, so a job of very many events is no large group.
    """
    e = _job_events(events)
    first = e.groupBy("job").agg(F.min(F.when(F.col("event").isin(*BEGIN), F.col("at"))).alias("begin"), F.min(F.when(F.col("event") == "result", F.col("at"))).alias("found"))
    rows = e.join(first.filter("begin IS NOT NULL"), "job").filter(F.col("at") >= F.col("begin"))
    looked = (F.col("event") == "paper") & (F.col("found").isNull() | (F.col("at") < F.col("found")))
    ends = F.col("event").isin("error", "not_found", "result") | looked
    return rows.groupBy("job").agg(
        F.min("begin")["ts"].alias("start"), F.min(F.when(ends, F.col("ts"))).alias("end"),
        F.max(F.when(ends, F.struct("at", _status(F.col("event")).alias("status"))))["status"].alias("status"),
        F.when(F.count("found") > 0, "terms").when(F.bool_or(looked), "paper").alias("type"),
        F.count_if((F.col("event") == "paper") & (F.col("at") > F.col("found"))).alias("clicks"), *(F.bool_or(F.col("event") == f).alias(f) for f in FLAGS),
    )


def jobs_stream(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """jobs() of a stream, a row once the watermark says that a job has been silent for the gap.

    The state of an open job is its events, as they may come late and in any order; a job that speaks again after the gap is a
    new row.  The fold goes over the job's events in order, so it equals the batch whatever the micro-batches were.
    """
    open_ = _job_events(events).withWatermark("ts", gap).groupBy("job", F.session_window("ts", gap)).agg(F.collect_list(F.struct("at", "event")).alias("seen"))
    first = lambda kinds: F.array_min(F.transform(F.filter("seen", lambda x: x["event"].isin(*kinds)), lambda x: x["at"]))
    told = open_.withColumn("begin", first(BEGIN)).withColumn("found", first(("result",))).filter("begin IS NOT NULL")
    told = told.withColumn("seen", F.filter("seen", lambda x: x["at"] >= F.col("begin")))
    looked = lambda x: (x["event"] == "paper") & (F.col("found").isNull() | (x["at"] < F.col("found")))
    told = told.withColumn("ends", F.array_sort(F.filter("seen", lambda x: x["event"].isin("error", "not_found", "result") | looked(x))))
    return told.select(
        "job", F.col("begin.ts").alias("start"), F.get("ends", F.lit(0))["at"]["ts"].alias("end"),
        F.when(F.size("ends") > 0, _status(F.try_element_at("ends", F.lit(-1))["event"])).alias("status"),
        F.when(F.col("found").isNotNull(), "terms").when(F.exists("seen", looked), "paper").alias("type"),
        F.size(F.filter("seen", lambda x: (x["event"] == "paper") & (x["at"] > F.col("found")))).cast("long").alias("clicks"),
        *(F.array_contains(F.transform("seen", lambda x: x["event"]), f).alias(f) for f in FLAGS),
    )


def recent_feedback(marks: DataFrame, searches: DataFrame, n: int = 50) -> DataFrame:
    """(ts, key, said, query): the n newest marks (key, value, cancel, ts, job) whose job had searched (job, query, ts) earlier, newest first.

    A cancel turns its value; 1 says "Yes", -1 "No", all else "Meh".  Of several searches of a job the last one before the mark counts.
    """
    value = F.when(F.col("cancel"), -F.col("value")).otherwise(F.col("value"))
    said = F.when(value == 1, "Yes").when(value == -1, "No").otherwise("Meh")
    rows = marks.select("job", "ts", "key", said.alias("said"), F.lit(None).cast("string").alias("query"))
    asked = searches.filter("job IS NOT NULL").select("job", "ts", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(None).cast("string").alias("said"), F.coalesce("query", F.lit("NA")).alias("query"))
    earlier = Window.partitionBy("job").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = rows.unionByName(asked).filter("job IS NOT NULL").withColumn("query", F.last("query", ignorenulls=True).over(earlier))
    return known.filter("said IS NOT NULL AND query IS NOT NULL").orderBy(F.desc("ts"), "key", "said").limit(n).select("ts", "key", "said", "query")


def totals(sessions_: DataFrame) -> DataFrame:
    seconds = F.unix_timestamp("end") - F.unix_timestamp("start")
    return sessions_.agg(F.count("*").alias("searches"), F.count_if(F.col("status") == "Ok").alias("successful"), F.sum("clicks").alias("clicks"), F.count_if("features").alias("with_features"), F.count_if("listed").alias("list_shown"),
                         F.avg(F.when(F.col("end") != F.col("start"), seconds)).alias("mean_seconds")).withColumn("mean_duration", F.when(F.col("mean_seconds").isNull(), "N/A").otherwise(duration(F.floor("mean_seconds"))))


def daily(events: DataFrame) -> DataFrame:
    """(day, count) with zeros."""
    span = events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("count")), "day", "left").na.fill(0, ["count"])


def daily_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("count")).select(F.to_date("window.start").alias("day"), "count")


def sessions_stream(events: DataFrame, gap: str = "1 day") -> DataFrame:
    """Jobs as session windows with a watermark: state is dropped once a job has been silent for the gap."""
    return events.withWatermark("ts", gap).groupBy("job", F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count_if(F.col("event") == "paper").alias("clicks"), F.bool_or(F.col("event") == "feature").alias("features")).drop("session_window")


def recent(sessions_: DataFrame, n: int = 50) -> DataFrame:
    """(start, job, text, duration, status, clicks, features, listed): the newest searches, marks as "+" and "-".

    text is what was searched for: the query, else "Id: " and the id, else "N/A", where sessions have those columns.
    """
    given = [F.col("query")] if "query" in sessions_.columns else []
    given += [F.concat(F.lit("Id: "), F.col("id").cast("string"))] if "id" in sessions_.columns else []
    took = F.when(F.col("end") != F.col("start"), duration(F.unix_timestamp("end") - F.unix_timestamp("start"))).otherwise("-")
    mark = lambda c: F.when(F.col(c), "+").otherwise("-").alias(c)
    newest = sessions_.filter("start IS NOT NULL").orderBy(F.desc("start"), F.desc("job")).limit(n)
    return newest.select("start", "job", F.coalesce(*given, F.lit("N/A")).alias("text"), took.alias("duration"), "status", "clicks", mark("features"), mark("listed"))


def feedback(marks: DataFrame) -> DataFrame:
    """(key, score, count) from (key, value, cancel, ts): cancels take value and count back; a cancel of an unseen key is ignored."""
    seen = F.min(F.when(~F.col("cancel"), F.col("ts"))).over(Window.partitionBy("key"))
    m = marks.withColumn("seen", seen).filter(~F.col("cancel") | (F.col("ts") > F.col("seen")))
    sign = F.when(F.col("cancel"), -1).otherwise(1)
    g = m.groupBy("key").agg(F.sum(sign * F.col("value")).alias("value"), F.sum(sign).alias("count")).filter("count <> 0")
    return g.select("key", (F.floor(100 * F.col("value") / F.col("count")) / 100).alias("score"), "count")


def phrase_words(phrases: DataFrame) -> DataFrame:
    """(word, count) of search phrases; id and DOI queries are dropped."""
    p = phrases.filter(~F.col("phrase").rlike("^(id|doi)="))
    words = F.explode(F.filter(F.split(F.replace(F.regexp_replace("phrase", "^title=", ""), F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""))
    return p.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("count"))
