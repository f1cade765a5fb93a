import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from leafwork.operators import blocks as B
from leafwork.operators import flow as W
from leafwork.operators import fonts as O
from leafwork.operators import jobs as J
from leafwork.operators import retention as R
from leafwork.operators import settings as S
from leafwork.operators.layout import layout
from leafwork.sources import documents as D
from leafwork.sources import engines as E
from leafwork.sources import files as FL

def at():
    return F.lit("2025-01-31 00:00:00").cast("timestamp")


EVENT = "job_id string, seq long, event_kind string, phase string, status string, page_index int, current_page int, total int, message string"


def test_settings_layers():
    file, saved, env = {"base_url": "f", "model": "f", "provider": "ustc"}, {"base_url": "s"}, {"model": "e"}
    got = S.resolve(file, saved, env)
    assert (got["base_url"], got["model"], got["provider"]) == ("s", "e", "ustc")
    assert S.resolve({"provider": "openai"}, {}, {}) == {"provider": "openai", "model": "gpt-4o-mini", "base_url": "https://api.openai.com/v1"}
    assert S.resolve({"provider": "openai", "model": "own"}, {}, {})["model"] == "own"
    assert S.environment_layer({"USTC_API_KEY": "k", "OCR_BASE_URL": "http://x//", "OCR_MODEL": "", "OCR_LOG_LEVEL": "info"}) == {"api_key": "k", "base_url": "http://x", "log_level": "info"}
    assert [S.masked_settings({"api_key": k})["api_key_masked"] for k in ("", "short", "abcd1234efgh")] == ["", "*****", "abcd****efgh"]


def test_settings_file(tmp_path):
    at = str(tmp_path / "own.toml")
    assert S.file_layer(at) == {}
    (tmp_path / "own.toml").write_text('api_key = "secret-key-1"\nocr_cache_enabled = true\ncleanup_max_age_hours = 720\nother = "x"\n')
    assert S.file_layer(at) == {"api_key": "secret-key-1", "ocr_cache_enabled": "true", "cleanup_max_age_hours": "720"}
    S.save(at, {"api_key": "secr****ey-1", "base_url": "http://a/", "model": 'm"q\\', "provider": "openai"})
    assert S.file_layer(at) == {"api_key": "secret-key-1", "ocr_cache_enabled": "true", "cleanup_max_age_hours": "720", "base_url": "http://a", "model": 'm"q\\', "provider": "openai"}
    (tmp_path / "own.toml").write_text("not toml")
    assert S.file_layer(at) == {}


def test_cache_precheck(spark):
    c = spark.createDataFrame([("a", 1, '{"p":0}', "2025-01-30 00:00:00"), ("a", 2, '{"p":1}', "2025-01-30 10:00:00"), ("b", 3, '{"p":', "2025-01-30 00:00:00"), ("c", 4, '{"p":2}', "2024-10-23 00:00:00"), ("d", 5, "[1]", "2025-01-30 00:00:00"), ("e", 6, None, "2025-01-30 00:00:00"), ("f", 7, "{}", "2025-01-30 00:00:00")], "key string, file_id long, page string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    asked = spark.createDataFrame([(i, k) for i, k in enumerate("abcdefg")], "page_index int, key string")
    got = W.precheck(asked, c, at()).orderBy("page_index").collect()
    assert [(r["key"], r["page"]) for r in got if r["hit"]] == [("a", '{"p":1}'), ("f", "{}")] and len(got) == 7
    assert tuple(W.counters(W.precheck(asked, c, at())).first()) == (2, 5) and tuple(W.counters(W.precheck(asked, c, at()), probe=True).first()) == (2, 0)
    assert W.precheck(asked, c, at(), enabled=False).filter("hit").count() == 0
    new = spark.createDataFrame([("b", 9, '{"p":9}', "2025-01-30 20:00:00")], "key string, file_id long, page string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    assert {r["key"] for r in W.precheck(asked, R.upsert(c, new), at()).filter("hit").collect()} == {"a", "b", "f"} and R.upsert(c, new, enabled=False).count() == 7


def test_pages_and_verdicts(spark):
    p = lambda *rows: spark.createDataFrame(list(rows), "job_id string, page_index int")
    got = W.all_pages(p(("j", 0)), p(("j", 0), ("j", 1)), p(("j", 1), ("j", 2))).orderBy("page_index").collect()
    assert [r["origin"] for r in got] == ["done", "cached", "recognised"]
    got = {r["job_id"]: (r["outcome"], r["pages"]) for r in W.verdict(p(("a", 0), ("a", 2), ("b", 0), ("b", 1), ("c", 5)), p(("a", 2), ("a", 0), ("a", 0), ("b", 1))).collect()}
    assert got == {"a": ("error", "#1, #3"), "b": ("warning", "#2")}


def test_state_and_steps(spark, monkeypatch):
    rows = [("a", 1, "progress", "render", None, None, 1, 9, None), ("a", 2, "progress", "ocr", "running", 0, 1, 3, None), ("a", 3, "error", None, None, None, None, None, "lost"), ("a", 4, "progress", "ocr", None, 1, 2, 3, None),
            ("b", 1, "status", None, "running", None, None, None, None), ("b", 2, "error", None, None, None, None, None, "bad"), ("b", 2, "error", None, None, None, None, None, "bad"), ("c", 1, "status", None, "done", None, 3, None, None), ("c", 2, "progress", "render", None, None, 4, 9, None), ("c", 3, "warning", None, None, None, None, None, "w")]
    e = spark.createDataFrame(rows, EVENT)
    got = {r["job_id"]: (r["state"], r["current_page"], r["error"], r["render"]) for r in J.current_state(e).collect()}
    assert got == {"a": ("error", 2, None, None), "b": ("error", None, "bad", None), "c": ("done", 3, None, 4)}
    monkeypatch.setattr(W, "PIECE", 2)
    assert [tuple(r) for r in W.running_progress(e).orderBy("seq").collect()] == [("a", 2, 1), ("a", 4, 2)]
    assert {(r["job_id"], r["before"], r["status"]): r["allowed"] for r in W.transitions(e).collect()} == {("b", "uploaded", "running"): True, ("c", "uploaded", "done"): False}
    jobs = spark.createDataFrame([("a", "error", None), ("b", "error", "x"), ("c", "embedded", None), ("d", "stopped", None), ("e", "running", None)], "id string, status string, error string")
    assert sorted((r["job_id"], r["event_kind"], r["message"]) for r in W.closing_events(e, jobs).collect()) == [("d", "status", "OCR stopped")]
    assert W.known_only(e, jobs.filter("id = 'a'")).select("job_id").distinct().count() == 1


def test_restore(spark):
    jobs = spark.createDataFrame([("a", "running", "/p/a.pdf", "/p/gone", "/p/t.png", 3), ("b", "done", "/p/lost.pdf", None, None, 1), (None, "done", "/p/a.pdf", None, None, 1), ("c", None, "/p/a.pdf", None, None, None)], "id string, status string, pdf_path string, embedded_path string, thumb_path string, num_pages int")
    pages = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2)], "job_id string, page_index int")
    there = spark.createDataFrame([("/p/a.pdf",), ("/p/t.png",)], "path string")
    got = {r["id"]: tuple(r)[1:] for r in W.restored_jobs(jobs, pages, there).collect()}
    assert got == {"a": ("stopped", "/p/a.pdf", None, "/p/t.png", 2, 3), "c": ("stopped", "/p/a.pdf", None, None, 0, 0)}


def place(spark, *rows, page=(100.0, 200.0), image=(100, 200)):
    df = spark.createDataFrame([(i, *r, *image, *page) for i, r in enumerate(rows)], "i int, text string, font_scale double, x1 int, y1 int, x2 int, y2 int, width int, height int, page_width double, page_height double")
    return [r for r in layout(df, "i").orderBy("i").collect()]


def test_layout_worked_out_by_hand(spark):
    ten, tall, edge, thin, blank, empty_image = place(
        spark, ("abcd", 1.0, 10, 20, 90, 29), ("a\nb", None, 10, 20, 90, 74), ("abcdefghijkl", 1.0, 40, 20, 300, 29), ("abcd", 1.0, 10, 29, 10, 20), ("  \n ", 1.0, 0, 0, 50, 50), ("abcd", 2.0, 10, 20, 90, 29))
    assert ten["size"] == pytest.approx(10) and [x["text"] for x in ten["lines"]] == ["abcd"] and ten["lines"][0]["baseline"] == pytest.approx(20 + 7.2) and ten["lines"][0]["x"] == 10  # 9 high: 9 / 0.9
    assert tall["size"] == pytest.approx(54 / (2 * 1.374)) and len(tall["lines"]) == 2
    assert tall["lines"][1]["baseline"] - tall["lines"][0]["baseline"] == pytest.approx(27)  # a line's share of the box
    assert edge["size"] < 10 and all(len(x["text"]) * 0.55 * edge["size"] <= 58 * 1.011 for x in edge["lines"])  # held off the page's edge: 100 - 40 - 2
    assert thin["size"] == pytest.approx(10) and len(thin["lines"]) == 1  # no width: all that is left of the page; corners put in order
    assert blank["lines"] == [] and blank["size"] == 0
    assert empty_image["size"] == pytest.approx(20) and empty_image["derived"] == pytest.approx(10)
    half = place(spark, ("abcd", 1.0, 10, 20, 90, 29), image=(200, 400))[0]
    assert half["size"] == pytest.approx(5) and half["lines"][0]["x"] == 5
    taller = [place(spark, ("some words of a line", 1.0, 0, 0, 90, h))[0]["size"] for h in (6, 12, 24, 48, 96)]
    assert taller == sorted(taller) and min(taller) >= 0.5


def test_uploads_and_inventory(spark, tmp_path):
    (tmp_path / "in" / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "none.pdf").write_bytes(b"")
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"12345")
    (tmp_path / "in" / "sub" / "deep" / "c.bin").write_bytes(b"123")
    up = FL.uploads(spark, str(tmp_path / "in")).collect()
    assert {r["filename"] for r in up} == {"a.pdf", "b.bin", "c.bin"} and all(len(r["id"]) == 12 and len(r["pdf_sha256"]) == 64 and r["status"] == "uploaded" for r in up)
    top = {r["name"]: (r["is_dir"], r["size_bytes"]) for r in FL.inventory_files(spark, str(tmp_path / "in"), "work", False).collect()}
    assert top == {"a.pdf": (False, 4), "sub": (True, 8)}
    deep = {r["name"]: (r["is_dir"], r["size_bytes"]) for r in FL.inventory_files(spark, str(tmp_path / "in"), "output", True).collect()}
    assert deep == {"a.pdf": (False, 4), "sub": (True, 8), "b.bin": (False, 5), "deep": (True, 3), "c.bin": (False, 3)}


def test_plugins():
    for name in D.INTERFACES:
        with pytest.raises(E.Unavailable):
            D.plugin(name)
    with pytest.raises(E.Unavailable):
        D.recompress(b"x")
    try:
        D.register("reencode", lambda data, mode, quality, downscale: {b"big": b"s", b"small": b"larger"}[data])
        assert D.recompress(b"big") == b"s" and D.recompress(b"small") is None and D.recompress(b"junk") is None
        D.register("linearise", lambda data: data[::-1] if data != b"bad" else 1 / 0)
        assert D.save_linearised(b"ab") == (b"ba", True) and D.save_linearised(b"bad") == (b"bad", False)
    finally:
        D._PLUGINS.clear()
    with pytest.raises(ValueError):
        D.plugin("other")


def test_scanned_pages(spark):
    try:
        D.register("page_count", lambda content: len(content))
        D.register("rasterise", lambda content, page, zoom: (content[page : page + 1], int(10 * zoom), 5) if content[page : page + 1] != b"x" else 1 / 0)
        rows = D.scan_pages(spark.createDataFrame([("d", bytearray(b"axb"))], "id string, content binary")).orderBy("page_index").collect()
        assert [(bytes(r["image"] or b""), r["width"]) for r in rows] == [(b"a", 20), (b"", None), (b"b", 20)] and rows[1]["error"].startswith("ZeroDivisionError")
    finally:
        D._PLUGINS.clear()


def test_chat_engine():
    seen = {}

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.update(json.loads(self.rfile.read(int(self.headers["Content-Length"]))), path=self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "read"}}]} if seen["model"] == "m" else {}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        assert E.configured("generic_openai", {"base_url": url, "model": "m", "api_key": "k", "max_tokens": "99999"}).recognise(b"png", 1, 1) == "read"
        assert seen["temperature"] == 0 and seen["max_tokens"] == 32767 and seen["path"] == "/chat/completions"
        assert E.configured("unlimited", {"base_url": url, "model": "other"}).recognise(b"png", 1, 1) == ""
    finally:
        server.shutdown()
    a, b = (E.ChatEngine("http://x", "m", k).fingerprint() for k in ("k1", "k2"))
    assert a != b and "k1" not in str(a)
    assert isinstance(E.configured("tesseract", {"no_such": "x"}), E.CommandEngine)
    assert E.CommandEngine(psm="6", oem="1", config="--psm 3 -c a=b").flags() == ["--psm", "3", "-c", "a=b", "--oem", "1"]
    with pytest.raises(E.Unavailable):
        E.CommandEngine(command="no-such-program").recognise(b"", 1, 1)


def test_edits(spark):
    p = spark.createDataFrame([(1, [("text", [1, 2, 3, 4], "a", 1.0), ("text", [1, 2, 3, 4], "b", 1.0)])], "page_id long, blocks array<struct<kind string, bbox array<int>, text string, font_scale double>>")
    b = B.edit_block(p, 1, "new", 9.0).first()["blocks"]
    assert (b[0]["text"], b[1]["text"], b[1]["font_scale"]) == ("a", "new", 1.5) and B.edit_block(p, 7, "x").first() == p.first()


def test_fonts(spark):
    with pytest.raises(ValueError):
        O.resolve(spark.createDataFrame([("a",)], "asked string"), spark.range(1001).selectExpr("cast(id as int) rank", "'n' name", "'p' path"), spark.createDataFrame([("p",)], "path string"))


def test_baselines_are_the_laid_out_lines_in_a_small_plan(spark):
    from leafwork.plans import service

    got = service.baselines(spark, "/root/testdata/sf0.001")
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 100_000  # 5,400,000 while a filter on the lines was pushed below the layout
    laid = service.laid_out(spark, "/root/testdata/sf0.001").select("page_id", "block_index", "size", "lines").collect()
    want = {(r["page_id"], r["block_index"], i, x["text"]): (x["x"], x["baseline"], r["size"]) for r in laid for i, x in enumerate(r["lines"])}
    rows = got.collect()
    have = {(r["page_id"], r["block_index"], r["line"], r["text"]): (r["x"], r["baseline"], r["size"]) for r in rows}
    assert len(rows) == len(have) > 1000 and have.keys() == want.keys()
    assert all(v == pytest.approx(want[k], abs=0.0051) for k, v in have.items())
