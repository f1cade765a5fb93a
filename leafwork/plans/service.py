"""Queries of the flow of pages, settings, fonts and sources, each with SQL written apart from the code where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as T
from leafwork.operators import blocks as B
from leafwork.operators import flow as W
from leafwork.operators import fonts as O
from leafwork.operators import jobs as J
from leafwork.operators import parse as P
from leafwork.operators import retention as R
from leafwork.operators import settings as S
from leafwork.operators.layout import layout
from leafwork.plans.reference import EVENTS, FLAT, GONE, PATHS
from leafwork.plans.reference import files, now, pages
from leafwork.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def jobs(spark, d):
    return table(spark, d, "jobs")


def events(spark, d):
    return table(spark, d, "job_events")


@query("SELECT page_id, len(blocks) AS blocks FROM ocr_pages WHERE blocks IS NOT NULL")
def present_pages(spark, d):
    return W.present(pages(spark, d)).select("page_id", F.size("blocks").cast("long").alias("blocks"))


@query("SELECT p.page_id FROM ocr_pages p JOIN jobs j ON j.id = p.job_id WHERE p.page_index BETWEEN 0 AND coalesce(j.num_pages, 2147483647) - 1")
def pages_in_range(spark, d):
    return W.in_range(pages(spark, d), jobs(spark, d)).select("page_id")


@query("SELECT job_id, min(page_id) AS page_id FROM ocr_pages WHERE page_index = 0 GROUP BY job_id")
def first_pages(spark, d):
    return W.page_at(pages(spark, d), 0)


_REQUESTS = "(SELECT key FROM cache_files WHERE key IS NOT NULL UNION SELECT sha256('page ' || page_id) FROM ocr_pages)"
_LIVE = f"(SELECT key, page FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mtime DESC NULLS LAST, file_id DESC) AS rn FROM cache_files) WHERE rn = 1 AND NOT ({GONE}) AND json_valid(page) AND json_type(CASE WHEN json_valid(page) THEN page END) = 'OBJECT')"


def prechecked(spark, d):
    c = table(spark, d, "cache_files")
    asked = c.select("key").filter("key is not null").union(pages(spark, d).select(F.sha2(F.concat(F.lit("page "), F.col("page_id").cast("string")), 256))).distinct()
    return W.precheck(asked, c, now())


@query(f"SELECT r.key, l.key IS NOT NULL AS hit, length(l.page) AS chars FROM {_REQUESTS} r LEFT JOIN {_LIVE} l USING (key)")
def cache_precheck(spark, d):
    """Keys of the cache and keys it has never seen, with what it holds for them."""
    return prechecked(spark, d).select("key", "hit", F.length("page").cast("long").alias("chars"))


@query(f"SELECT count(l.key) AS hits, count(*) - count(l.key) AS misses FROM {_REQUESTS} r LEFT JOIN {_LIVE} l USING (key)")
def cache_counters(spark, d):
    return W.counters(prechecked(spark, d))


@query(f"SELECT count(*) FILTER (l.key IS NOT NULL) AS hits, CAST(0 AS BIGINT) AS misses FROM {_REQUESTS} r LEFT JOIN {_LIVE} l USING (key)")
def cache_probe_counters(spark, d):
    return W.counters(prechecked(spark, d), probe=True)


@query("SELECT job_id, page_index, CASE min(r) WHEN 0 THEN 'done' WHEN 1 THEN 'cached' ELSE 'recognised' END AS origin FROM (SELECT job_id, page_index, 0 AS r FROM ocr_pages WHERE blocks IS NOT NULL UNION ALL SELECT job_id, page_index, CASE WHEN coalesce(cached, false) THEN 1 ELSE 2 END FROM job_events WHERE event_kind = 'progress' AND phase = 'ocr' AND page_index IS NOT NULL) GROUP BY job_id, page_index")
def pages_after_run(spark, d):
    e = events(spark, d).filter("event_kind = 'progress' and phase = 'ocr' and page_index is not null")
    return W.all_pages(W.present(pages(spark, d)), e.filter("cached"), e.filter("not coalesce(cached, false)"))


@query("WITH bad AS (SELECT DISTINCT job_id, page_index FROM job_events WHERE event_kind = 'error_page' AND page_index IS NOT NULL), tried AS (SELECT job_id, page_index FROM bad UNION SELECT job_id, page_index FROM job_events WHERE event_kind = 'progress' AND phase = 'ocr' AND page_index IS NOT NULL) "
       "SELECT job_id, CASE WHEN EXISTS (SELECT 1 FROM tried t WHERE t.job_id = b.job_id AND NOT EXISTS (SELECT 1 FROM bad x WHERE x.job_id = t.job_id AND x.page_index = t.page_index)) THEN 'warning' ELSE 'error' END AS outcome, count(*) AS failed, string_agg('#' || (page_index + 1), ', ' ORDER BY page_index) AS pages FROM bad b GROUP BY job_id")
def job_verdicts(spark, d):
    e = events(spark, d).filter("page_index is not null")
    bad = e.filter("event_kind = 'error_page'").select("job_id", "page_index")
    return W.verdict(bad.union(e.filter("event_kind = 'progress' and phase = 'ocr'").select("job_id", "page_index")), bad)


@query(f"SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS current FROM {EVENTS} WHERE event_kind = 'progress' AND phase = 'ocr'")
def running_progress(spark, d):
    return W.running_progress(events(spark, d))


_MISSING = "(SELECT j.id AS job_id, CAST(s.i AS INT) AS page_index FROM jobs j, UNNEST(range(coalesce(j.num_pages, 0))) AS s(i) WHERE NOT EXISTS (SELECT 1 FROM ocr_pages p WHERE p.job_id = j.id AND p.page_index = s.i))"


@query(f"SELECT a.job_id, a.page_index, CAST((SELECT count(*) FROM {_MISSING} b WHERE b.job_id = a.job_id AND b.page_index <= a.page_index) AS INT) AS current, (SELECT count(*) FROM {_MISSING} b WHERE b.job_id = a.job_id) AS total FROM {_MISSING} a")
def render_queue(spark, d):
    return W.render_queue(J.missing_pages(jobs(spark, d), pages(spark, d)))


@query("WITH p AS (SELECT DISTINCT job_id, page_index FROM ocr_pages) SELECT job_id, page_index, (SELECT max(q.page_index) FROM p q WHERE q.job_id = p.job_id AND q.page_index < p.page_index) AS previous, (SELECT min(q.page_index) FROM p q WHERE q.job_id = p.job_id AND q.page_index > p.page_index) AS next FROM p")
def page_neighbours(spark, d):
    return W.neighbours(pages(spark, d))


@query(f"WITH s AS (SELECT job_id, seq, status FROM {EVENTS} WHERE event_kind = 'status' AND status IS NOT NULL), w AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY job_id ORDER BY seq), 'uploaded') AS before FROM s) "
       "SELECT job_id, seq, before, status, status = 'embedded' OR status = before OR (before = 'uploaded' AND status = 'running') OR (before IN ('running', 'retrying') AND status IN ('running', 'done', 'stopped', 'error')) OR (before IN ('done', 'stopped', 'error', 'embedded') AND status IN ('running', 'retrying')) AS allowed FROM w")
def status_steps(spark, d):
    return W.transitions(events(spark, d))


@query("SELECT job_id, count(DISTINCT seq) AS events FROM job_events WHERE job_id IN (SELECT id FROM jobs) GROUP BY job_id")
def known_events(spark, d):
    return J.once(W.known_only(events(spark, d), jobs(spark, d))).groupBy("job_id").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT id AS job_id, CASE WHEN status = 'error' THEN 'error' ELSE 'status' END AS event_kind, CASE status WHEN 'error' THEN NULL WHEN 'stopped' THEN 'stopped' ELSE 'done' END AS status, CASE status WHEN 'error' THEN coalesce(error, 'OCR failed') WHEN 'stopped' THEN coalesce(error, 'OCR stopped') ELSE 'OCR complete' END AS message FROM jobs j "
       "WHERE (status = 'error' AND NOT EXISTS (SELECT 1 FROM job_events e WHERE e.job_id = j.id AND e.event_kind = 'error')) OR (status IN ('done', 'embedded', 'stopped') AND NOT EXISTS (SELECT 1 FROM job_events e WHERE e.job_id = j.id AND e.event_kind = 'status' AND e.status IN ('done', 'stopped')))")
def closing_events(spark, d):
    return W.closing_events(events(spark, d), jobs(spark, d))


@query("WITH x AS (SELECT path FROM cache_files UNION SELECT pdf_path FROM jobs WHERE pdf_path IS NOT NULL) SELECT id, CASE WHEN status IN ('running', 'retrying') THEN 'stopped' ELSE coalesce(status, 'stopped') END AS status, pdf_path, CASE WHEN embedded_path IN (FROM x) THEN embedded_path END AS embedded_path, CASE WHEN thumb_path IN (FROM x) THEN thumb_path END AS thumb_path, "
       "(SELECT count(DISTINCT page_index) FROM ocr_pages p WHERE p.job_id = j.id) AS current_page, CASE WHEN num_pages > 0 THEN CAST(num_pages AS BIGINT) ELSE (SELECT count(DISTINCT page_index) FROM ocr_pages p WHERE p.job_id = j.id) END AS num_pages FROM jobs j WHERE pdf_path IN (FROM x) AND id <> ''")
def restored_state(spark, d):
    """Jobs after a restart; the documents exist, and of the other paths those that are in the cache."""
    there = table(spark, d, "cache_files").select("path").union(jobs(spark, d).filter("pdf_path is not null").select("pdf_path"))
    return W.restored_jobs(jobs(spark, d), pages(spark, d), there)


@query("SELECT j.id AS job_id, j.status, coalesce(j.num_pages, 0) AS total, coalesce(j.embedded_path, '') <> '' AS has_embedded, array_to_string(coalesce((SELECT list(DISTINCT page_index ORDER BY page_index) FROM ocr_pages p WHERE p.job_id = j.id AND p.blocks IS NOT NULL), []), ',') AS pages FROM jobs j")
def job_pages(spark, d):
    return W.pages_of_jobs(jobs(spark, d), pages(spark, d)).withColumn("pages", F.array_join("pages", ","))


@query(f"SELECT ts, seq, job_id, message FROM (SELECT * FROM {EVENTS} WHERE message IS NOT NULL ORDER BY ts DESC, seq DESC, job_id DESC LIMIT 200) ORDER BY ts, seq, job_id")
def log_lines(spark, d):
    return W.log_lines(events(spark, d))


@query("SELECT count(*) FILTER (key IS NOT NULL AND size_bytes > 0) AS attempted, count(*) FILTER (key IS NOT NULL AND size_bytes > 0 AND length(page) < size_bytes) AS replaced, count(*) FILTER (NOT coalesce(key IS NOT NULL AND size_bytes > 0 AND length(page) < size_bytes, false)) AS skipped, CAST(sum(size_bytes) FILTER (key IS NOT NULL AND size_bytes > 0) AS BIGINT) AS before_bytes, "
       "CAST(sum(CASE WHEN length(page) < size_bytes THEN length(page) ELSE size_bytes END) FILTER (key IS NOT NULL AND size_bytes > 0) AS BIGINT) AS after_bytes, CAST(sum(CASE WHEN length(page) < size_bytes THEN size_bytes - length(page) ELSE 0 END) FILTER (key IS NOT NULL AND size_bytes > 0) AS BIGINT) AS saved_bytes FROM cache_files")
def smaller_images(spark, d):
    """The accept rule on stored files: the whole file against its page alone, a page that is null as a failure, a null key as a mask."""
    c = table(spark, d, "cache_files").select(F.col("size_bytes").alias("before"), F.length("page").cast("long").alias("after"), F.col("key").isNull().alias("masked"))
    return W.image_choice(c)


@query(f"SELECT path, CAST(floor(age_hours) AS BIGINT) AS hours FROM (SELECT path, round(greatest(0.0, (epoch_us(TIMESTAMP '2025-12-01 00:00:00') - epoch_us(mtime)) / 3.6e9::DOUBLE), 2) AS age_hours FROM cache_files WHERE path NOT IN (SELECT path FROM {PATHS}))")
def oldest_files(spark, d):
    f, r = files(spark, d)
    return R.oldest_first(f, r, now()).select("path", F.floor("age_hours").alias("hours"))


@query("SELECT id, provider, base_url, model, CASE WHEN k = '' THEN '' WHEN length(k) <= 8 THEN repeat('*', length(k)) ELSE left(k, 4) || repeat('*', length(k) - 8) || right(k, 4) END AS api_key_masked, k <> '' AS has_api_key FROM (SELECT id, coalesce(adapter, 'ustc') AS provider, coalesce(img_dir, '') AS base_url, '' AS model, coalesce(pdf_sha256, '') AS k FROM jobs)")
def masked_settings(spark, d):
    """The masked view, with columns of jobs in the places of settings."""
    return jobs(spark, d).select("id", S.masked_view(F.col("adapter"), F.col("img_dir"), F.lit(""), F.col("pdf_sha256")).alias("s")).select("id", "s.*")


@query("SELECT id, k AS key, v AS value FROM (SELECT id, coalesce(adapter, 'unlimited') AS a, unnest(['api_key', 'model', 'prompt', 'lang', 'psm']) AS k, unnest([pdf_sha256, filename, '', status, CAST(num_pages AS VARCHAR)]) AS v FROM jobs) WHERE v <> '' AND CASE a WHEN 'tesseract' THEN k IN ('lang', 'psm') WHEN 'generic_openai' THEN k IN ('api_key', 'model', 'prompt') ELSE k IN ('api_key', 'model') END")
def run_overrides(spark, d):
    """The overrides each job's engine takes, with columns of jobs as what is asked for."""
    asked = F.create_map(F.lit("api_key"), F.col("pdf_sha256"), F.lit("model"), F.col("filename"), F.lit("prompt"), F.lit(""), F.lit("lang"), F.col("status"), F.lit("psm"), F.col("num_pages").cast("string"))
    return jobs(spark, d).select("id", F.explode(S.allowed_overrides(F.col("adapter"), asked)))


@query("SELECT id, least(32, greatest(1, coalesce(nullif(concurrency, 0), 1))) AS concurrency, least(coalesce(num_pages, 0) * 1000, 32767) AS max_tokens FROM jobs")
def run_limits(spark, d):
    return jobs(spark, d).select("id", S.concurrency(F.col("concurrency")).alias("concurrency"), S.token_limit(F.coalesce("num_pages", F.lit(0)) * 1000).alias("max_tokens"))


@query("SELECT p.page_id, sha256(to_json({'adapter': p.adapter, 'model': p.model, 'page': p.page_index, 'pdf_sha': j.pdf_sha256, 'v': 1})) AS key FROM ocr_pages p LEFT JOIN jobs j ON j.id = p.job_id")
def context_keys(spark, d):
    """The key of a page's context: canonical JSON with its fields in order and nulls as nulls."""
    j = jobs(spark, d).select(F.col("id").alias("job_id"), "pdf_sha256")
    p = pages(spark, d).select("page_id", "job_id", "page_index", "adapter", "model").join(j, "job_id", "left")
    return p.select("page_id", R.context_key(adapter=F.col("adapter"), model=F.col("model"), page=F.col("page_index"), pdf_sha=F.col("pdf_sha256"), v=F.lit(1)).alias("key"))


_BOX = "CASE WHEN width = 0 THEN 1.0::DOUBLE ELSE width / 2.0::DOUBLE / width END", "CASE WHEN height = 0 THEN 1.0::DOUBLE ELSE height / 2.0::DOUBLE / height END"


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, least(b.bbox[1] * sx, b.bbox[3] * sx) AS x0, least(b.bbox[2] * sy, b.bbox[4] * sy) AS y0, greatest(b.bbox[1] * sx, b.bbox[3] * sx) AS x1, greatest(b.bbox[2] * sy, b.bbox[4] * sy) AS y1 FROM (SELECT *, {_BOX[0]} AS sx, {_BOX[1]} AS sy FROM {FLAT}) WHERE len(b.bbox) = 4")
def boxes_on_page(spark, d):
    """Blocks in points of a page drawn at zoom 2."""
    f = B.flat(pages(spark, d), "width", "height").filter("size(bbox) = 4")
    box = G.to_points(F.col("bbox"), F.col("width"), F.col("height"), F.col("width") / 2, F.col("height") / 2)
    return f.select("page_id", "block_index", box.alias("b")).select("page_id", "block_index", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


_INK = "(0.88, -0.12), (1.069, -0.293), (0.0, 0.0), (NULL, NULL), (0.5, -0.1), (2.0, -1.0)"


@query(f"SELECT up, down, round(greatest(0.6, least(1.0, greatest(a - b, 0.5) * 0.80::DOUBLE)), 3) AS ink_fraction, round(greatest(0.6, least(a, a * 0.88::DOUBLE)), 3) AS ink_up FROM (SELECT CAST(u AS DOUBLE) AS up, CAST(v AS DOUBLE) AS down, coalesce(nullif(CAST(u AS DOUBLE), 0), 1.0) AS a, coalesce(nullif(CAST(v AS DOUBLE), 0), -0.2) AS b FROM (VALUES {_INK}) AS t(u, v))")
def font_ink(spark, d):
    f = spark.sql(f"SELECT CAST(u AS DOUBLE) AS up, CAST(v AS DOUBLE) AS down FROM VALUES {_INK} AS t(u, v)")
    return f.select("up", "down", O.ink(F.col("up"), F.col("down")).alias("i")).select("up", "down", "i.*")


@query("SELECT CAST(i AS INT) AS i, 'UFont' || chr(CAST(65 + (i // 26) % 26 AS INT)) || chr(CAST(65 + i % 26 AS INT)) AS name FROM range(1000) AS t(i)")
def font_names(spark, d):
    return spark.range(1000).select(F.col("id").cast("int").alias("i"), O.resource_name(F.col("id")).alias("name"))


@query("SELECT * FROM (VALUES ('Noto', 'Noto', '/f/noto.ttf'), (' noto ', 'Noto', '/f/noto.ttf'), ('SONG', 'Song', '/f/song.ttc'), ('/f/own.ttf', 'own', '/f/own.ttf'), ('/f/gone.ttf', 'Noto', '/f/noto.ttf'), ('nothing', 'Noto', '/f/noto.ttf'), ('', 'Noto', '/f/noto.ttf')) AS t(asked, name, path)")
def font_lookup(spark, d):
    asked = spark.createDataFrame([(x,) for x in ("Noto", " noto ", "SONG", "/f/own.ttf", "/f/gone.ttf", "nothing", "")], "asked string")
    candidates = spark.createDataFrame([("Song", 1, 0, "/f/none.ttc"), ("Song", 1, 1, "/f/song.ttc"), ("Noto", 0, 0, "/f/noto.ttf"), ("Gone", 2, 0, "/f/gone.ttf")], "name string, place int, rank int, path string")
    there = spark.createDataFrame([("/f/song.ttc",), ("/f/noto.ttf",), ("/f/own.ttf",)], "path string")
    registry = O.first_existing(candidates, there).join(candidates.select("name", F.col("place").alias("rank")).distinct(), "name")
    return O.resolve(asked, registry, there)


@query("SELECT * FROM (VALUES (1, '{\"blocks\":[]}'), (2, '{\"a\":1}'), (3, '{\"b\":2}'), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, '{\"c\":{\"d\":3}}'), (9, NULL), (10, '{\"e\":5}')) AS t(id, object)")
def json_answers(spark, d):
    """Answers of recognisers, and the object in each."""
    f = "```"
    raw = [(1, '{"blocks": []}'), (2, f'Here it is:\n{f}json\n{{"a": 1}}\n{f} done'), (3, 'so {"b": 2} there'), (4, None), (5, "  "), (6, "not json at all"), (7, "{bad json"), (8, f'{f}\nx {{"c": {{"d": 3}}}} y\n{f}'), (9, f'{{"lost": 1}} {f}{f} {{"lost": 2}}'), (10, f"{f}\n{{\"e\": 5}}\n{f}\n{f}json\n{{\"f\": 6}}\n{f}")]
    return spark.createDataFrame(raw, "id int, raw string").select("id", F.to_json(P.json_object(F.col("raw"))).alias("object"))


@query("SELECT * FROM (VALUES (1, 'plain text'), (2, 'a → b'), (3, 'x ≤ 3 and y ≥ 4'), (4, 'α+β'), (5, '\\unknown{x}'), (6, ''), (7, NULL), (8, '\\tone')) AS t(id, text)")
def latex_text(spark, d):
    raw = [(1, "plain text"), (2, "a \\Rightarrow b"), (3, "x \\leq 3 and y \\ge 4"), (4, "\\alpha+\\beta"), (5, "\\unknown{x}"), (6, ""), (7, None), (8, "\\tone")]
    return spark.createDataFrame(raw, "id int, raw string").select("id", T.latex_plain(F.col("raw")).alias("text"))


@query("SELECT * FROM (VALUES ('en', 'open', 'Open'), ('de', 'open', 'Öffnen'), ('de', 'close', 'Close'), ('fr', 'open', 'Open'), ('fr', 'none', 'none'), (NULL, 'close', 'Close')) AS t(locale, key, text)")
def localised_texts(spark, d):
    texts = F.create_map(F.lit("en"), F.create_map(F.lit("open"), F.lit("Open"), F.lit("close"), F.lit("Close")), F.lit("de"), F.create_map(F.lit("open"), F.lit("Öffnen")))
    asked = spark.createDataFrame([("en", "open"), ("de", "open"), ("de", "close"), ("fr", "open"), ("fr", "none"), (None, "close")], "locale string, key string")
    return asked.select("locale", "key", T.localised(texts, F.col("locale"), F.col("key")).alias("text"))


@query("SELECT page_id, CASE WHEN len(blocks) > 0 THEN 1.5 END AS first_scale, blocks[2].font_scale AS second_scale FROM ocr_pages")
def scale_first_block(spark, d):
    p = B.edit_block(pages(spark, d), 0, font_scale=9.0)
    return p.select("page_id", F.get("blocks", F.lit(0))["font_scale"].alias("first_scale"), F.get("blocks", F.lit(1))["font_scale"].alias("second_scale"))


def laid_out(spark, d):
    f = B.flat(pages(spark, d), "width", "height").filter(B.embeddable(F.col("kind"), F.col("text")) & (F.size("bbox") == 4))
    f = f.select("page_id", "block_index", "kind", "bbox", "text", "font_scale", "width", "height", (F.col("width") / 2).alias("page_width"), (F.col("height") / 2).alias("page_height"), *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return layout(f, "page_id", "block_index", "kind", "bbox", "font_scale")


@query()
def font_info(spark, d):
    return laid_out(spark, d).select("page_id", "block_index", "kind", "bbox", "font", F.round("derived", 2).alias("derived"), F.round("size", 2).alias("size"), "font_scale", F.size("lines").alias("lines"))


@query()
def baselines(spark, d):
    """Every laid out line: where it stands, its text and size."""
    # the outer form, as the optimizer infers a filter on lines from the plain one and pushes it, written out in full, below every step of the layout
    each = laid_out(spark, d).select("page_id", "block_index", "size", F.posexplode_outer("lines").alias("line", "l")).filter("line is not null")
    return each.select("page_id", "block_index", "line", F.round("l.x", 2).alias("x"), F.round("l.baseline", 2).alias("baseline"), "l.text", F.round("size", 2).alias("size"))
