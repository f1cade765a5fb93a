"""Jobs, their pages and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUFFER = 1000


def missing_pages(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages still to be recognised: every index of a job of known length without a page."""
    spine = jobs.filter("num_pages > 0").select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.col("num_pages") - 1)).alias("page_index"))
    return spine.join(pages.select("job_id", "page_index").distinct(), ["job_id", "page_index"], "left_anti")


def once(events: DataFrame) -> DataFrame:
    """Each event once: rows delivered again have the same (``job_id``, ``seq``)."""
    return events.dropDuplicates(["job_id", "seq"])


def current_state(events: DataFrame) -> DataFrame:
    """The state a job's events leave it in: one aggregate per job, reduced before the shuffle, so a hot job is no hot task.

    A later progress or status event clears an error and the drawing of pages (``render``). Repeated and unordered rows do not
    matter: everything is a maximum by ``seq``.
    """
    at = lambda c, when: F.max(F.when(when, F.struct("seq", F.col(c).alias("v"))))
    kind, status = F.col("event_kind"), F.col("status")
    render = (kind == "progress") & F.coalesce(F.col("phase") == "render", F.lit(False))
    progress, says = (kind == "progress") & ~render, kind == "status"
    failed = kind == "error"
    # a progress event takes over a running status only, a status event any, an error its own
    state = F.when(failed, "error").when(says, status).when(progress & status.isin("running", "retrying"), status)
    e = events.withColumn("state", state)
    g = e.groupBy("job_id").agg(
        at("state", failed | (says & status.isNotNull()) | F.col("state").isNotNull())["v"].alias("state"), at("current_page", progress | says & F.col("current_page").isNotNull())["v"].alias("current_page"), at("total", progress)["v"].alias("total"), F.max("seq").alias("last_seq"),
        at("message", failed).alias("e"), F.max(F.when(progress | says, F.col("seq"))).alias("cleared"), at("current_page", render).alias("r"), F.max(F.when(progress | says, F.col("seq"))).alias("drawn"))
    later = lambda x, c: F.col(f"{x}.seq") > F.coalesce(c, F.lit(-1))
    return g.select("job_id", "state", "current_page", "total", "last_seq", F.when(later("e", "cleared"), F.col("e.v")).alias("error"), F.when(later("r", "drawn"), F.col("r.v")).alias("render"))


def recent(events: DataFrame, n: int = BUFFER) -> DataFrame:
    """The last ``n`` events of each job. The window keeps the top rows of each partition before it shuffles, so a hot job
    sends ``n`` rows from a task at most."""
    w = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    return once(events).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def failures(events: DataFrame) -> DataFrame:
    """Failed pages per job, 1-based and sorted, as ``#1, #3``; each page once however often it was announced."""
    bad = events.filter("event_kind = 'error_page' and page_index is not null").select("job_id", "page_index").distinct()
    return bad.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list("page_index")), lambda p: F.concat(F.lit("#"), (p + 1).cast("string"))), ", ").alias("pages"))


def restored(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs after a restart: what ran has stopped, and the pages there are count as done."""
    n = done.groupBy("job_id").agg(F.count_distinct("page_index").alias("done"))
    j = jobs.join(n, jobs.id == n.job_id, "left")
    return j.select("id", F.when(F.col("status").isin("running", "retrying"), "stopped").otherwise(F.col("status")).alias("status"), F.coalesce("done", F.lit(0)).alias("current_page"), F.coalesce("num_pages", "done", F.lit(0)).cast("long").alias("num_pages"))
