"""Queries of the document operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as T
from leafwork.operators import blocks as B
from leafwork.operators import jobs as J
from leafwork.operators import parse as P
from leafwork.operators import retention as R
from leafwork.operators import words as W
from leafwork.streaming.jobs import run_available
from leafwork.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2025-12-01 00:00:00"
FLAT = "(SELECT page_id, job_id, page_index, adapter, model, width, height, u.i - 1 AS block_index, blocks[u.i] AS b FROM ocr_pages, UNNEST(range(1, coalesce(len(blocks), 0) + 1)) AS u(i))"
PCT = "CASE WHEN isnan({0}) OR isinf({0}) THEN NULL WHEN {0} > 1 THEN {0} ELSE {0} * 100 END"
LINES = "(SELECT doc_id, CAST(u.i - 1 AS INT) AS ln, string_split(text, chr(10))[u.i] AS line FROM documents, UNNEST(range(1, len(string_split(text, chr(10))) + 1)) AS u(i))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark, d):
    return table(spark, d, "ocr_pages")


def now():
    return F.lit(NOW).cast("timestamp_ntz").cast("timestamp")


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, b.kind AS kind, b.bbox[1] AS x1, b.bbox[2] AS y1, b.bbox[3] AS x2, b.bbox[4] AS y2, length(b.text) AS chars FROM {FLAT}")
def blocks_flat(spark: SparkSession, d: str) -> DataFrame:
    f = B.flat(pages(spark, d))
    return f.select("page_id", "block_index", "kind", *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.length("text").cast("long").alias("chars"))


@query(f"SELECT adapter, count(*) AS blocks, count(*) FILTER (b.kind NOT IN ('image', 'image_ref') AND b.text IS NOT NULL AND trim(b.text, ' ' || chr(10)) <> '') AS embeddable FROM {FLAT} GROUP BY adapter")
def embeddable_blocks(spark, d):
    return B.flat(pages(spark, d), "adapter").groupBy("adapter").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(B.embeddable(F.col("kind"), F.col("text"))).alias("embeddable"))


@query(f"SELECT kind, class, count(*) AS blocks FROM (SELECT b.kind AS kind, {PCT.format('b.conf')} AS p, CASE WHEN p IS NULL THEN 'na' WHEN p >= 85 THEN 'high' WHEN p >= 60 THEN 'med' ELSE 'low' END AS class FROM {FLAT}) GROUP BY kind, class")
def confidence_classes(spark, d):
    return B.flat(pages(spark, d)).groupBy("kind", B.confidence_class(B.percent(F.col("conf"))).alias("class")).agg(F.count(F.lit(1)).alias("blocks"))


@query(f"SELECT p.page_id, p.job_id, CAST(coalesce(x.low, 0) AS INT) AS low, coalesce(x.has_conf, false) AS has_conf FROM ocr_pages p LEFT JOIN (SELECT page_id, count(*) FILTER ({PCT.format('b.conf')} < 60) AS low, bool_or({PCT.format('b.conf')} IS NOT NULL) AS has_conf FROM {FLAT} GROUP BY page_id) x USING (page_id)")
def low_confidence_pages(spark, d):
    return B.low_confidence(pages(spark, d))


@query(f"SELECT p.job_id, CAST(sum(coalesce(x.low, 0)) AS BIGINT) AS low, bool_or(coalesce(x.has_conf, false)) AS has_conf FROM ocr_pages p LEFT JOIN (SELECT page_id, count(*) FILTER ({PCT.format('b.conf')} < 60) AS low, bool_or({PCT.format('b.conf')} IS NOT NULL) AS has_conf FROM {FLAT} GROUP BY page_id) x USING (page_id) GROUP BY p.job_id")
def low_confidence_jobs(spark, d):
    return B.low_confidence(pages(spark, d)).groupBy("job_id").agg(F.sum("low").alias("low"), F.bool_or("has_conf").alias("has_conf"))


@query("SELECT j.id AS job_id, CAST(s.i AS INT) AS page_index FROM jobs j, UNNEST(range(coalesce(j.num_pages, 0))) AS s(i) WHERE NOT EXISTS (SELECT 1 FROM ocr_pages p WHERE p.job_id = j.id AND p.page_index = s.i)")
def retry_missing(spark, d):
    return J.missing_pages(table(spark, d, "jobs"), pages(spark, d))


@query("SELECT j.id AS job_id, count(DISTINCT p.page_index) AS done, CASE WHEN j.num_pages > 0 THEN CAST(floor(count(DISTINCT p.page_index) * 100.0 / j.num_pages + 0.5) AS INT) END AS percent FROM jobs j LEFT JOIN ocr_pages p ON p.job_id = j.id GROUP BY j.id, j.num_pages")
def job_progress(spark, d):
    done = pages(spark, d).groupBy("job_id").agg(F.count_distinct("page_index").alias("done"))
    j = table(spark, d, "jobs").select(F.col("id").alias("job_id"), "num_pages").join(done, "job_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return j.select("job_id", "done", F.when(F.col("num_pages") > 0, F.floor(F.col("done") * 100.0 / F.col("num_pages") + 0.5).cast("int")).alias("percent"))


@query("SELECT job_id, page_index, page_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_index ORDER BY ingested_at DESC NULLS LAST, page_id DESC) AS rn FROM ocr_pages) WHERE rn = 1")
def latest_pages(spark, d):
    return B.latest_pages(pages(spark, d))


@query("SELECT id, filename, status, num_pages AS total, current_page, adapter, created, embedded_path IS NOT NULL AND embedded_path <> '' AS has_embedded, regexp_extract(pdf_path, '[^/]+$') AS file FROM jobs WHERE lower(filename) LIKE '%.pdf'")
def job_summary(spark, d):
    j = table(spark, d, "jobs").filter(F.lower("filename").like("%.pdf"))
    return j.select("id", "filename", "status", F.col("num_pages").alias("total"), "current_page", "adapter", "created", (F.col("embedded_path").isNotNull() & (F.col("embedded_path") != "")).alias("has_embedded"), T.file_name(F.col("pdf_path")).alias("file")).orderBy(F.desc("created"), "id")


EVENTS = "(SELECT DISTINCT ON (job_id, seq) * FROM job_events)"


_STATE = f"""WITH e AS (SELECT *, event_kind = 'progress' AND phase IS DISTINCT FROM 'render' AS p, event_kind = 'status' AS s FROM {EVENTS}),
k AS (SELECT job_id, max(seq) AS last_seq, max(seq) FILTER (p OR s) AS cleared,
  max(seq) FILTER (event_kind = 'error' OR (s AND status IS NOT NULL) OR (p AND status IN ('running', 'retrying'))) AS at_state, max(seq) FILTER (p OR (s AND current_page IS NOT NULL)) AS at_page, max(seq) FILTER (p) AS at_total,
  max(seq) FILTER (event_kind = 'error') AS at_error, max(seq) FILTER (event_kind = 'progress' AND phase = 'render') AS at_render FROM e GROUP BY job_id)
SELECT k.job_id, CASE WHEN a.event_kind = 'error' THEN 'error' ELSE a.status END AS state, b.current_page, c.total, last_seq, CASE WHEN at_error > coalesce(cleared, -1) THEN d.message END AS error, CASE WHEN at_render > coalesce(cleared, -1) THEN r.current_page END AS render
FROM k LEFT JOIN e a ON a.job_id = k.job_id AND a.seq = at_state LEFT JOIN e b ON b.job_id = k.job_id AND b.seq = at_page LEFT JOIN e c ON c.job_id = k.job_id AND c.seq = at_total LEFT JOIN e d ON d.job_id = k.job_id AND d.seq = at_error LEFT JOIN e r ON r.job_id = k.job_id AND r.seq = at_render"""


@query(_STATE)
def job_state(spark, d):
    return J.current_state(table(spark, d, "job_events"))


@query(_STATE)
def job_state_stream(spark, d):
    path = f"{d}/job_events.parquet"
    return run_available(spark, path, spark.read.parquet(path).schema, "job-state")


@query(f"SELECT job_id, count(*) AS kept, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM {EVENTS}) WHERE rn <= 1000 GROUP BY job_id")
def event_buffer(spark, d):
    return J.recent(table(spark, d, "job_events")).groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT job_id, count(*) AS failed, string_agg('#' || (page_index + 1), ', ' ORDER BY page_index) AS pages FROM (SELECT DISTINCT job_id, page_index FROM job_events WHERE event_kind = 'error_page' AND page_index IS NOT NULL) GROUP BY job_id")
def failed_pages(spark, d):
    return J.failures(table(spark, d, "job_events"))


@query(f"SELECT 'data: {{\"job\":\"' || job_id || '\",\"seq\":' || seq || ',\"type\":\"' || event_kind || '\"}}' || chr(10) || chr(10) AS line FROM {EVENTS}")
def event_lines(spark, d):
    e = J.once(table(spark, d, "job_events")).select(F.struct(F.col("job_id").alias("job"), "seq", F.col("event_kind").alias("type")).alias("e"))
    return e.select(F.concat(F.lit("data: "), F.to_json("e"), F.lit("\n\n")).alias("line"))


@query("SELECT j.id, CASE WHEN j.status IN ('running', 'retrying') THEN 'stopped' ELSE j.status END AS status, count(DISTINCT p.page_index) AS current_page, CAST(coalesce(j.num_pages, count(DISTINCT p.page_index)) AS BIGINT) AS num_pages FROM jobs j LEFT JOIN ocr_pages p ON p.job_id = j.id GROUP BY j.id, j.status, j.num_pages")
def restored_jobs(spark, d):
    return J.restored(table(spark, d, "jobs"), pages(spark, d))


@query("SELECT DISTINCT job_id FROM job_events WHERE job_id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL)")
def vanished_jobs(spark, d):
    return table(spark, d, "job_events").select("job_id").distinct().join(table(spark, d, "jobs").select(F.col("id").alias("job_id")), "job_id", "left_anti")


@query("SELECT event_kind, phase, count(*) AS events, count(*) FILTER (cached) AS cached FROM " + EVENTS + " GROUP BY event_kind, phase")
def event_counts(spark, d):
    return J.once(table(spark, d, "job_events")).groupBy("event_kind", "phase").agg(F.count(F.lit(1)).alias("events"), F.count_if("cached").alias("cached"))


@query(f"SELECT max(seq) AS seq, max(ts) AS ts, count(*) AS lines FROM (SELECT ts, seq, job_id FROM {EVENTS} WHERE message IS NOT NULL ORDER BY ts DESC, seq DESC, job_id LIMIT 200)")
def log_tail(spark, d):
    return J.once(table(spark, d, "job_events")).filter("message is not null").select("ts", "seq", "job_id").orderBy(F.desc("ts"), F.desc("seq"), "job_id").limit(200).agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("lines"))


PATHS = "(SELECT DISTINCT path FROM (SELECT unnest([pdf_path, img_dir, embedded_path, thumb_path]) AS path FROM jobs) WHERE path IS NOT NULL)"
FILES = f"(SELECT split_part(path, '/', 1) AS area, path, size_bytes, mtime, path IN (SELECT path FROM {PATHS}) AS ref, round(greatest(0.0, epoch_us(TIMESTAMP '{NOW}') / 3.6e9 - epoch_us(mtime) / 3.6e9), 2) AS age FROM cache_files)"


def files(spark, d):
    f = table(spark, d, "cache_files").select("path", "size_bytes", "mtime")
    j = table(spark, d, "jobs")
    return f.withColumn("area", F.split_part("path", F.lit("/"), F.lit(1))), R.referenced_paths(j)


@query(f"SELECT path FROM {PATHS}")
def referenced_paths(spark, d):
    return R.referenced_paths(table(spark, d, "jobs"))


@query(f"SELECT area, count(*) FILTER (NOT ref) AS unreferenced, CAST(coalesce(sum(size_bytes) FILTER (NOT ref), 0) AS BIGINT) AS unreferenced_bytes, count(*) FILTER (NOT ref AND age >= 168) AS ready, CAST(coalesce(sum(size_bytes) FILTER (NOT ref AND age >= 168), 0) AS BIGINT) AS ready_bytes, count(*) FILTER (ref) AS referenced FROM {FILES} GROUP BY ROLLUP (area)")
def inventory(spark, d):
    return R.inventory(*files(spark, d), now())


@query(f"SELECT count(*) FILTER (NOT ref AND age >= 168) AS deleted, CAST(coalesce(sum(size_bytes) FILTER (NOT ref AND age >= 168), 0) AS BIGINT) AS freed_bytes, count(*) FILTER (ref) AS kept_referenced, count(*) FILTER (NOT ref AND age < 168) AS kept_fresh FROM {FILES}")
def cleanup_plan(spark, d):
    return R.cleanup_plan(*files(spark, d), now())


@query(f"SELECT count(*) FILTER (NOT ref) AS deleted, CAST(coalesce(sum(size_bytes) FILTER (NOT ref), 0) AS BIGINT) AS freed_bytes, count(*) FILTER (ref) AS kept_referenced, CAST(0 AS BIGINT) AS kept_fresh FROM {FILES}")
def cleanup_forced(spark, d):
    return R.cleanup_plan(*files(spark, d), now(), force=True)


GONE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us(mtime)) / 3.6e9 > 720"


@query(f"SELECT count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER ({GONE}) AS expired, CAST(coalesce(sum(size_bytes) FILTER ({GONE}), 0) AS BIGINT) AS expired_bytes FROM cache_files")
def cache_stats(spark, d):
    return R.cache_stats(table(spark, d, "cache_files"), now())


@query(f"SELECT key, file_id, file_id IS NOT NULL AS hit FROM (SELECT DISTINCT key FROM cache_files) LEFT JOIN (SELECT key, file_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mtime DESC, file_id DESC) AS rn FROM cache_files) WHERE rn = 1 AND NOT ({GONE}) AND coalesce(page, '') <> '') USING (key)")
def cache_lookup(spark, d):
    c = table(spark, d, "cache_files")
    return R.lookup(c.select("key").distinct(), c, now())


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, [CAST(round_even(least(a, c), 0) AS INT), CAST(round_even(least(bb, dd), 0) AS INT), CAST(round_even(greatest(a, c), 0) AS INT), CAST(round_even(greatest(bb, dd), 0) AS INT)] AS bbox FROM (SELECT page_id, block_index, b.bbox[3] % 1000 * (width / 1000.0::DOUBLE) AS a, b.bbox[2] % 1000 * (height / 1000.0::DOUBLE) AS bb, b.bbox[1] % 1000 * (width / 1000.0::DOUBLE) AS c, b.bbox[4] % 1000 * (height / 1000.0::DOUBLE) AS dd FROM {FLAT} WHERE len(b.bbox) = 4)")
def bbox_to_pixels(spark, d):
    f = B.flat(pages(spark, d), "width", "height").filter("size(bbox) = 4")
    f = f.withColumn("box", F.array(*[F.col("bbox")[i] % 1000 for i in (2, 1, 0, 3)]))  # corners in the wrong order on purpose
    return f.select("page_id", "block_index", G.to_pixels(F.col("box"), F.col("width"), F.col("height")).alias("bbox"))


@query("SELECT doc_id, substring(text, 1, 2000) AS text FROM documents")
def clip_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip(F.col("text")).alias("text"))


@query(f"SELECT font, count(*) AS blocks FROM (SELECT regexp_extract(b.text, '[^\\x{{0}}-\\x{{ff}}]') AS c, CASE WHEN c = '' THEN 'helv' WHEN regexp_matches(c, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'japan' WHEN regexp_matches(c, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'korea' ELSE 'china-s' END AS font FROM {FLAT} WHERE b.text IS NOT NULL) GROUP BY font")
def script_fonts(spark, d):
    return B.flat(pages(spark, d)).filter("text is not null").groupBy(T.font_of(F.col("text")).alias("font")).agg(F.count(F.lit(1)).alias("blocks"))


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, regexp_matches(b.text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') AS cjk FROM {FLAT} WHERE b.text IS NOT NULL")
def cjk_blocks(spark, d):
    return B.flat(pages(spark, d)).filter("text is not null").select("page_id", "block_index", T.has_cjk(F.col("text")).alias("cjk"))


_HINTS = T.MATH_HINTS
# White space as Python and Java with (?U) see it; RE2 knows only ASCII's.
_WS = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = "regexp_replace({0}, '^[" + _WS.replace("{", "{{").replace("}", "}}") + "]+|[" + _WS.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')"
_CLASSIFY = ("CASE WHEN t = '' THEN 'text' WHEN m >= 2 AND m / n > 0.15 THEN 'equation' WHEN n <= 40 AND regexp_matches(t, '^(\\s*\\d+([.、．]\\d+)*[.、．]?\\s*|\\s*第[一二三四五六七八九十百千万0-9]+[章节篇部分]?\\s*|\\s*§\\s*\\d+[.\\d]*\\s*|\\s*(CHAPTER|Chapter|Chapter\\s+\\d+)\\s*|\\s*[\\x{4e00}-\\x{9fff}]{1,8}\\s*)$') THEN 'heading' "
             "WHEN h > 40 AND n <= 30 AND strpos(t, '，。；：') = 0 THEN 'heading' ELSE 'text' END")
_CLASSIFY = _CLASSIFY.replace("\\\\s", "[" + _WS + "]").replace("\\s", "[" + _WS + "]").replace("[.\\d]", "[.\\p{Nd}]").replace("\\d", "\\p{Nd}")


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, {_CLASSIFY} AS class FROM (SELECT page_id, block_index, {_STRIP.format('b.text')} AS t, length(t) AS n, n - length(translate(t, '{_HINTS}', '')) AS m, b.bbox[4] - b.bbox[2] AS h FROM {FLAT} WHERE b.text IS NOT NULL AND len(b.bbox) = 4)")
def classify_blocks(spark, d):
    f = B.flat(pages(spark, d)).filter(F.col("text").isNotNull() & (F.size("bbox") == 4))
    return f.select("page_id", "block_index", T.classify(F.col("text"), (F.col("bbox")[3] - F.col("bbox")[1]).cast("double")).alias("class"))


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(b.text, chr(10), ' '), ' +', ' ', 'g')), '\\|\\s+', '|', 'g'), '\\s+\\|', '|', 'g'), '\\s*\\^\\s*', '^', 'g'), '([×÷±≤≥≠≈≡∼∈∉⊂⊃∪∩→←↑↓])\\s+', '\\1', 'g') AS text FROM {FLAT} WHERE b.kind = 'equation' AND b.text IS NOT NULL")
def tidy_formulas(spark, d):
    return B.flat(pages(spark, d)).filter("kind = 'equation' and text is not null").select("page_id", "block_index", T.tidy_formula(F.col("text")).alias("text"))


@query(f"SELECT page_id, b.kind AS kind, [b.bbox[1], b.bbox[2], b.bbox[3], b.bbox[4]] AS box, coalesce(b.text, '') AS text FROM {FLAT} WHERE len(b.bbox) = 4 AND len(list_filter(b.bbox, lambda x: x >= 0)) = 4 AND regexp_full_match(b.kind, '[a-z_]+')")
def marker_blocks(spark, d):
    """Blocks written as marked-up text and parsed back; boxes of other than four numbers and kinds of other letters make marks that are skipped."""
    none = lambda c: F.coalesce(c, F.lit(""))
    raw = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("<|det|>"), none(b["kind"]), F.lit(" ["), none(F.array_join(b["bbox"].cast("array<string>"), ", ")), F.lit("]<|/det|>"), none(b["text"]))), "")
    return pages(spark, d).select("page_id", F.explode(P.marker_blocks(raw)).alias("m")).select("page_id", "m.*")


@query("SELECT file_id, CAST(u.i - 1 AS INT) AS block_index, lower(json_extract_string(b, '$.kind')) AS kind, coalesce(json_extract_string(b, '$.text'), '') AS text FROM (SELECT file_id, CAST(json_extract(CASE WHEN json_valid(page) THEN page END, '$.blocks') AS JSON[]) AS bs FROM cache_files WHERE json_valid(page)), UNNEST(range(1, len(bs) + 1)) AS u(i), LATERAL (SELECT bs[u.i] AS b) WHERE json_array_length(json_extract(b, '$.bbox')) = 4")
def json_blocks(spark, d):
    """Blocks of the cached pages' JSON."""
    c = table(spark, d, "cache_files").select("file_id", F.lit(1000).alias("width"), F.lit(1000).alias("height"), P.json_object(F.col("page")).alias("v"))
    return P.json_blocks(c, "v", "file_id").select("file_id", "block_index", "kind", "text")


@query("SELECT doc_id, coalesce(text, '') AS content FROM documents")
def chat_content(spark, d):
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    return table(spark, d, "documents").select("doc_id", T.chat_content(raw).alias("content"))


_ROLE = "CASE WHEN b.kind IN ('image', 'image_ref') AND coalesce(trim(b.text), '') = '' THEN 'pending' WHEN b.kind = 'footnote' THEN 'caption' ELSE 'other' END"


@query(f"SELECT page_id, CAST(block_index AS INT) AS block_index, CASE WHEN role = 'caption' AND was = 'pending' THEN 'image' WHEN role = 'caption' THEN 'image_caption' ELSE 'image' END AS kind, CAST(CASE WHEN role = 'caption' AND was = 'pending' THEN prev END AS INT) AS image_at FROM (SELECT *, lag(role) OVER w AS was, lag(block_index) OVER w AS prev, lead(role) OVER w AS nxt FROM (SELECT page_id, block_index, {_ROLE} AS role FROM {FLAT}) WHERE role <> 'other' WINDOW w AS (PARTITION BY page_id ORDER BY block_index)) WHERE role = 'caption' OR nxt IS NULL")
def caption_pairs(spark, d):
    """Empty images paired with the footnote that follows, as captions are."""
    role = F.when(F.col("kind").isin("image", "image_ref") & (F.coalesce(F.trim("text"), F.lit("")) == ""), "pending").when(F.col("kind") == "footnote", "caption").otherwise("other")
    return B.pair_captions(B.flat(pages(spark, d)).select("page_id", "block_index", role.alias("role")), ["page_id"], "block_index")


_WORDS = f"(SELECT doc_id AS page_id, CAST(ln // 20 AS INT) AS block_num, CAST(ln // 4 AS INT) AS par_num, CAST(ln AS INT) AS line_num, CAST(u.i AS INT) AS word_seq, 10 * CAST(u.i AS INT) AS \"left\", 20 * ln + length(w) % 3 AS top, 8 * length(w) AS width, 10 + length(w) % 5 AS height, w AS text, CAST(CASE WHEN (ln + u.i) % 17 = 0 THEN -1 ELSE length(w) * 7 % 100 END AS DOUBLE) AS conf FROM {LINES} l, UNNEST(range(1, len(string_split(line, ' ')) + 1)) AS u(i), LATERAL (SELECT string_split(line, ' ')[u.i] AS w))"


def words_of(spark, d):
    """Words with boxes made from the documents' lines."""
    doc = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    w = doc.select("doc_id", "ln", F.posexplode(F.split("line", " ")).alias("i", "text"))
    n = F.length("text")
    return w.select(F.col("doc_id").alias("page_id"), F.floor(F.col("ln") / 20).cast("int").alias("block_num"), F.floor(F.col("ln") / 4).cast("int").alias("par_num"), F.col("ln").alias("line_num"), (F.col("i") + 1).alias("word_seq"), (10 * (F.col("i") + 1)).alias("left"), (20 * F.col("ln") + n % 3).alias("top"), (8 * n).alias("width"), (10 + n % 5).alias("height"), "text", F.when((F.col("ln") + F.col("i") + 1) % 17 == 0, -1.0).otherwise((n * 7 % 100).cast("double")).alias("conf"))


_LINES = f"""WITH w AS (SELECT *, top + height AS bottom FROM {_WORDS} WHERE {_STRIP.format('text')} <> '' AND trunc(conf) >= 0),
m AS (SELECT page_id, block_num, par_num, line_num, median(height) AS mh, median(top) AS mt, median(bottom) AS mb FROM w GROUP BY ALL),
x AS (SELECT w.*, mh, mt, mb FROM w JOIN m USING (page_id, block_num, par_num, line_num)),
s AS (SELECT page_id, block_num, par_num, line_num, median(abs(height - mh)) AS dh, median(abs(top - mt)) AS dt, median(abs(bottom - mb)) AS db FROM x GROUP BY ALL),
y AS (SELECT x.*, (dh = 0 OR abs(height - mh) <= 3 * 1.4826::DOUBLE * dh) AND (dt = 0 OR abs(top - mt) <= 3 * 1.4826::DOUBLE * dt) AND (db = 0 OR abs(bottom - mb) <= 3 * 1.4826::DOUBLE * db) AS ok0 FROM x JOIN s USING (page_id, block_num, par_num, line_num)),
z AS (SELECT *, ok0 OR NOT bool_or(ok0) OVER (PARTITION BY page_id, block_num, par_num, line_num) AS ok FROM y)
SELECT page_id, line_num, CAST(min("left") FILTER (ok) AS INT) AS x1, CAST(min(top) FILTER (ok) AS INT) AS y1, CAST(max("left" + width) FILTER (ok) AS INT) AS x2, CAST(max(bottom) FILTER (ok) AS INT) AS y2, round(avg(conf), 6) AS conf, CASE WHEN regexp_matches(string_agg(text, '' ORDER BY word_seq), '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}]') THEN string_agg(text, '' ORDER BY word_seq) ELSE string_agg(text, ' ' ORDER BY word_seq) END AS text, avg(height) FILTER (ok) AS h, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(top), min("left"), min(word_seq)) AS INT) AS reading_order FROM z GROUP BY page_id, block_num, par_num, line_num"""


@query(f"SELECT * EXCLUDE (h) FROM ({_LINES})")
def line_clusters(spark, d):
    return W.lines(words_of(spark, d)).select("page_id", "line_num", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("conf", 6).alias("conf"), "text", "reading_order")


@query(f"SELECT {_CLASSIFY} AS kind, count(*) AS lines FROM (SELECT {_STRIP.format('text')} AS t, length(t) AS n, n - length(translate(t, '{_HINTS}', '')) AS m, h FROM ({_LINES})) GROUP BY kind")
def line_classes(spark, d):
    return W.lines(words_of(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"))


@query()
def page_json(spark, d):
    return B.compact_json(pages(spark, d))


@query("SELECT page_id, CAST(greatest(0, coalesce(len(blocks), 0) - 1) AS INT) AS blocks_left, blocks[2].text AS first_text FROM ocr_pages WHERE blocks IS NOT NULL")
def delete_first_block(spark, d):
    p = B.delete_block(pages(spark, d).filter("blocks is not null"), 0)
    return p.select("page_id", F.size("blocks").alias("blocks_left"), F.get("blocks", F.lit(0))["text"].alias("first_text"))


@query("SELECT page_id, CASE WHEN len(blocks) > 0 THEN 'checked' END AS first_text, blocks[2].text AS second_text FROM ocr_pages")
def edit_first_block(spark, d):
    p = B.edit_block(pages(spark, d), 0, "checked")
    return p.select("page_id", F.get("blocks", F.lit(0))["text"].alias("first_text"), F.get("blocks", F.lit(1))["text"].alias("second_text"))


_SIZE = "CASE WHEN size_bytes * 1000 < 1024 THEN format('{:.0f} B', size_bytes * 1000.0) WHEN size_bytes * 1000 < 1048576 THEN CASE WHEN size_bytes * 1000 / 1024.0 >= 100 THEN format('{:.0f} KB', floor(size_bytes * 1000 / 1024.0::DOUBLE + 0.5)) ELSE format('{:.1f} KB', size_bytes * 1000 / 1024.0::DOUBLE) END ELSE format('{:.1f} MB', size_bytes * 1000 / 1048576.0::DOUBLE) END"


@query(f"SELECT file_id, {_SIZE} AS size FROM cache_files")
def byte_sizes(spark, d):
    c = table(spark, d, "cache_files")
    return c.select("file_id", T.byte_size((F.col("size_bytes") * 1000).cast("double")).alias("size"))


@query("SELECT id, CASE WHEN pdf_sha256 IS NULL THEN NULL WHEN length(pdf_sha256) <= 8 THEN repeat('*', length(pdf_sha256)) ELSE left(pdf_sha256, 4) || repeat('*', length(pdf_sha256) - 8) || right(pdf_sha256, 4) END AS masked, replace('Job {id}', '{id}', id) AS title, greatest(1, coalesce(nullif(concurrency, 0), 1)) AS concurrency, coalesce(adapter, 'unlimited') AS adapter FROM jobs")
def job_settings(spark, d):
    j = table(spark, d, "jobs")
    return j.select("id", T.mask(F.col("pdf_sha256")).alias("masked"), T.fill(F.lit("Job {id}"), {"id": F.col("id")}).alias("title"), F.greatest(F.lit(1), F.coalesce(F.nullif("concurrency", F.lit(0)), F.lit(1))).alias("concurrency"), F.coalesce("adapter", F.lit("unlimited")).alias("adapter"))


_RAW = "('24', 'eng+deu'), ('junk', ' fra  spa '), ('0', ''), ('-3', NULL), ('1.5', '+'), (NULL, 'chi_sim'), ('true', 'eng'), ('OFF', 'a+b c')"


@query(f"SELECT v, CASE WHEN TRY_CAST(v AS DOUBLE) > 0 THEN TRY_CAST(v AS DOUBLE) ELSE 720.0::DOUBLE END AS hours, lower(trim(v)) NOT IN ('false', '0', 'no', 'off', '') AS on_, CASE WHEN l IS NULL OR len(p) = 0 THEN 'eng' ELSE array_to_string(p, '+') END AS langs FROM (SELECT v, l, list_filter(string_split(replace(l, ' ', '+'), '+'), lambda x: trim(x) <> '') AS p FROM (VALUES {_RAW}) AS t(v, l))")
def setting_values(spark, d):
    s = spark.sql(f"SELECT * FROM VALUES {_RAW} AS t(v, l)")
    return s.select("v", T.positive(F.col("v"), 720.0).alias("hours"), T.truthy(F.col("v")).alias("on_"), T.language_key(F.col("l")).alias("langs"))


@query("SELECT j.id, coalesce(e.v, s.v, f.v) AS adapter FROM jobs j LEFT JOIN (SELECT job_id, max(adapter) AS v FROM ocr_pages GROUP BY job_id) e ON e.job_id = j.id LEFT JOIN (SELECT id, adapter AS v FROM jobs) s ON s.id = j.id CROSS JOIN (SELECT 'unlimited' AS v) f")
def setting_layers(spark, d):
    """Layers of settings: what a job's pages say before what the job says before the default."""
    e = pages(spark, d).groupBy("job_id").agg(F.max("adapter").alias("v"))
    j = table(spark, d, "jobs").select("id", "adapter")
    return j.join(e, j.id == e.job_id, "left").select("id", F.coalesce("v", "adapter", F.lit("unlimited")).alias("adapter"))
