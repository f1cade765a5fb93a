"""The way of pages through a run: what is cached, what is done, how far it has come, how it ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.operators.jobs import once
from leafwork.operators.retention import CACHE_HOURS, expired

#: Events of a job that are counted in one piece; longer jobs are counted piece by piece.
PIECE = 10_000


def present(pages: DataFrame) -> DataFrame:
    return pages.filter("blocks is not null")


def in_range(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages whose index their job has: from 0 to below its number of pages; jobs of unknown length have every index from 0."""
    return pages.join(jobs.select(F.col("id").alias("job_id"), "num_pages"), "job_id").filter("page_index >= 0 and page_index < coalesce(num_pages, 2147483647)").drop("num_pages")


def page_at(pages: DataFrame, index: int) -> DataFrame:
    """The first page of each job with an index (smallest ``page_id``)."""
    return pages.filter(F.col("page_index") == index).groupBy("job_id").agg(F.min("page_id").alias("page_id"))


def precheck(requests: DataFrame, cache: DataFrame, now: Column, hours: float = CACHE_HOURS, enabled: bool = True) -> DataFrame:
    """Requests (``key`` and further columns) with ``hit`` and the ``page`` that was cached: the newest entry of a key, if it is not expired and its page
    is a readable JSON object. One left join; every request comes out once. A cache that is not enabled has no hits."""
    if not enabled:
        return requests.select("*", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("page"))
    newest = cache.groupBy("key").agg(F.max_by(F.struct("mtime", "page"), F.struct("mtime", "file_id")).alias("e")).select("key", "e.*")
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("page")).startswith("OBJECT"), F.lit(False))
    live = newest.filter(~expired(F.col("mtime"), now, hours) & readable).select("key", "page")
    return requests.join(live, "key", "left").select(*[requests[c] for c in requests.columns], F.col("page").isNotNull().alias("hit"), "page")


def counters(lookups: DataFrame, probe: bool = False) -> DataFrame:
    """``hits`` and ``misses`` of looked-up keys; a probe counts no misses."""
    return lookups.agg(F.count_if("hit").alias("hits"), (F.lit(0).cast("long") if probe else F.count_if(~F.col("hit"))).alias("misses"))


def render_queue(misses: DataFrame) -> DataFrame:
    """Pages to be drawn, in page order: each page's place and how many there are, per job."""
    w = Window.partitionBy("job_id").orderBy("page_index")
    return misses.select("job_id", "page_index", F.row_number().over(w).alias("current"), F.count(F.lit(1)).over(Window.partitionBy("job_id")).alias("total"))


def all_pages(done: DataFrame, cached: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages of a job after a run, (``job_id``, ``page_index``, ``origin``): what was done stays, then what was cached, then what was recognised."""
    rows = None
    for rank, (name, df) in enumerate((("done", done), ("cached", cached), ("recognised", recognised))):
        part = df.select("job_id", "page_index", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("origin")).alias("o"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("job_id", "page_index").agg(F.min("o").alias("o")).select("job_id", "page_index", "o.origin")


def verdict(attempted: DataFrame, failed: DataFrame) -> DataFrame:
    """What failures mean for each job that has some: ``error`` where every attempted page failed, else ``warning``, and the pages as #1, #3."""
    n = attempted.select("job_id", "page_index").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("attempted"))
    bad = failed.select("job_id", "page_index").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("failed"), F.sort_array(F.collect_list("page_index")).alias("at"))
    names = F.array_join(F.transform("at", lambda p: F.concat(F.lit("#"), (p + 1).cast("string"))), ", ")
    return bad.join(n, "job_id", "left").select("job_id", F.when(F.col("failed") >= F.coalesce("attempted", F.lit(0)), "error").otherwise("warning").alias("outcome"), "failed", names.alias("pages"))


def running_progress(events: DataFrame) -> DataFrame:
    """How many pages each recognition event brings a job to: (``job_id``, ``seq``, ``current``).

    A job's events are counted in pieces of ``PIECE`` sequence numbers; only the pieces' totals are summed over the whole job, so no
    task sorts a hot job's events."""
    e = once(events.filter("event_kind = 'progress' and phase = 'ocr'").select("job_id", "seq")).withColumn("piece", F.floor(F.col("seq") / PIECE))
    before = e.groupBy("job_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("job_id", "piece", (F.sum("n").over(Window.partitionBy("job_id").orderBy("piece")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("job_id", "piece").orderBy("seq"))
    return e.select("job_id", "piece", "seq", here.alias("here")).join(before, ["job_id", "piece"]).select("job_id", "seq", (F.col("before") + F.col("here")).alias("current"))


def neighbours(pages: DataFrame) -> DataFrame:
    """Each page's index with the one before and the one after it in its job; a job has as many rows as its document pages."""
    w = Window.partitionBy("job_id").orderBy("page_index")
    return pages.select("job_id", "page_index").distinct().select("job_id", "page_index", F.lag("page_index").over(w).alias("previous"), F.lead("page_index").over(w).alias("next"))


# The steps a job's status may take (fixed values); any status may become embedded.
STEPS = {"uploaded": ("running",), "running": ("running", "done", "stopped", "error"), "retrying": ("running", "done", "stopped", "error"), "done": ("retrying", "running"), "stopped": ("retrying", "running"), "error": ("retrying", "running"), "embedded": ("retrying", "running")}


def transitions(events: DataFrame) -> DataFrame:
    """Each status a job reports after another: ``job_id``, ``seq``, ``before``, ``status``, and whether that step is allowed. The first one follows uploaded."""
    w = Window.partitionBy("job_id").orderBy("seq")
    e = once(events.filter("event_kind = 'status' and status is not null").select("job_id", "seq", "status"))
    e = e.withColumn("before", F.coalesce(F.lag("status").over(w), F.lit("uploaded")))
    ok = F.col("status") == "embedded"
    for was, may in STEPS.items():
        ok = ok | ((F.col("before") == was) & F.col("status").isin(*may))
    return e.select("job_id", "seq", "before", "status", (ok | (F.col("before") == F.col("status"))).alias("allowed"))


def known_only(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Events of jobs there are; an event of an unknown job is dropped."""
    return events.join(jobs.select(F.col("id").alias("job_id")).distinct(), "job_id", "left_semi")


def closing_events(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The events a stream still owes its readers: for each job that has ended without an event that says so, one that does
    (``job_id``, ``event_kind``, ``status``, ``message``). An embedded job counts as done."""
    e = once(events)
    told = e.filter("event_kind = 'status' and status in ('done', 'stopped')").select("job_id", F.lit(True).alias("told")).distinct()
    failed = e.filter("event_kind = 'error'").select("job_id", F.lit(True).alias("failed")).distinct()
    j = jobs.filter("status in ('done', 'embedded', 'stopped', 'error')").select(F.col("id").alias("job_id"), "status", "error").join(told, "job_id", "left").join(failed, "job_id", "left")
    bad = F.col("status") == "error"
    owed = j.filter((bad & F.col("failed").isNull()) | (~bad & F.col("told").isNull()))
    return owed.select("job_id", F.when(bad, "error").otherwise("status").alias("event_kind"), F.when(~bad, F.when(F.col("status") == "stopped", "stopped").otherwise("done")).alias("status"),
                       F.when(bad, F.coalesce("error", F.lit("OCR failed"))).when(F.col("status") == "stopped", F.coalesce("error", F.lit("OCR stopped"))).otherwise("OCR complete").alias("message"))


def restored_jobs(jobs: DataFrame, pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Jobs after a restart: without an id or a document that exists they are left out, what ran has stopped, paths that lead
    nowhere are null, and the pages there are count as done. ``existing`` has ``path``; lookups are joins, not file by file."""
    there = existing.select("path").distinct()
    done = pages.groupBy("job_id").agg(F.count_distinct("page_index").alias("n"))
    j = jobs.filter("id is not null and id <> ''").join(there.select(F.col("path").alias("pdf_path")), "pdf_path", "left_semi")
    for c in ("embedded_path", "thumb_path"):
        j = j.join(there.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}")), c, "left").withColumn(c, F.when(F.col(f"has_{c}"), F.col(c)))
    j = j.join(done, j.id == done.job_id, "left")
    status = F.when(F.col("status").isin("running", "retrying"), "stopped").otherwise(F.coalesce("status", F.lit("stopped")))
    n = F.coalesce("n", F.lit(0))
    return j.select("id", status.alias("status"), "pdf_path", "embedded_path", "thumb_path", n.alias("current_page"), F.when(F.col("num_pages") > 0, F.col("num_pages").cast("long")).otherwise(n).alias("num_pages"))


def pages_of_jobs(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per job what a reader asks for: status, total, whether it is embedded, and its page indexes in order (a document's at most)."""
    p = present(pages).groupBy("job_id").agg(F.sort_array(F.collect_set("page_index")).alias("pages"))
    j = jobs.select(F.col("id").alias("job_id"), "status", F.coalesce("num_pages", F.lit(0)).alias("total"), (F.coalesce("embedded_path", F.lit("")) != "").alias("has_embedded"))
    return j.join(p, "job_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))


def log_lines(events: DataFrame, n: int = 200) -> DataFrame:
    """The last ``n`` messages (1 to 1,000), oldest first."""
    last = once(events.filter("message is not null")).orderBy(F.desc("ts"), F.desc("seq"), F.desc("job_id")).limit(max(1, min(n, 1000)))
    return last.select("ts", "seq", "job_id", "message").orderBy("ts", "seq", "job_id")


def image_choice(images: DataFrame, mode: str = "jpeg") -> DataFrame:
    """What re-encoding saves: only results smaller than the original are taken; masked images, empty ones and failures are skipped and counted.
    ``images`` has ``before`` and ``after`` (sizes; a null ``after`` is a failure) and ``masked``. Other modes do nothing."""
    if mode not in ("jpeg", "gray-jpeg"):
        images = images.limit(0)
    tried = ~F.col("masked") & (F.coalesce("before", F.lit(0)) > 0)
    taken = tried & F.coalesce(F.col("after") < F.col("before"), F.lit(False))
    total = lambda when, c: F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("long")
    g = images.agg(F.count_if(tried).alias("attempted"), F.count_if(taken).alias("replaced"), F.count_if(~taken).alias("skipped"), total(tried, F.col("before")).alias("before_bytes"), (total(taken, F.col("after")) + total(tried & ~taken, F.col("before"))).alias("after_bytes"))
    return g.withColumn("saved_bytes", F.greatest(F.lit(0), F.col("before_bytes") - F.col("after_bytes")))
