import duckdb
import pytest
from pyspark.sql import functions as F

from leafwork.functions import geometry as G
from leafwork.functions import text as T
from leafwork.operators import blocks as B
from leafwork.operators import parse as P
from leafwork.operators import words as W
from leafwork.plans import catalog
from leafwork.sources import engines

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    from pyspark.sql import Row

    return spark.createDataFrame([Row(**values)]).select(column).first()[0]


def test_boxes(spark):
    box = lambda b, w, h: one(spark, G.to_pixels(F.col("b"), F.col("w"), F.col("h")), b=b, w=w, h=h)
    assert box([0, 0, 500, 250], 100, 50) == [0, 0, 50, 12]
    assert box([200, 300, 100, 60], 100, 50) == [10, 3, 20, 15]
    assert box([200, 300, 100, 50], 1000, 1000) == [100, 50, 200, 300]
    parse = lambda t: one(spark, G.parse_box(F.col("t")), t=t)
    assert parse("0 10 20 30") == [0, 10, 20, 30] and parse("1.5,2.5,3.5,4.9") == [1, 2, 3, 4]
    assert [parse(t) for t in ("", "1,2,3", "a,b,c,d")] == [None] * 3


def test_markers(spark):
    raw = "<|det|>title [50,100,200,120]<|/det|>Title\n<|det|>text [50,150,300,300]<|/det|>Hello\nworld\n<|det|>text<|/det|>no box<|det|>text [1,2,3]<|/det|>x<|det|>Text [1,2,3,4]<|/det|>y"
    got = one(spark, P.marker_blocks(F.col("t")), t=raw)
    assert [(r["kind"], r["box"], r["text"].strip()) for r in got] == [("title", [50, 100, 200, 120], "Title"), ("text", [50, 150, 300, 300], "Hello\nworld")]


def test_json_answers(spark):
    df = spark.createDataFrame([(1, '```json\n{"blocks": [{"kind": "TEXT", "bbox": [0,0,500,250], "text": "hi"}, {"kind": "heading", "bbox": [1,2,3]}]}\n```'), (2, 'so: {"blocks": [{"bbox": [0,500,500,1000]}]} end'), (3, "{bad"), (4, None)], "id int, raw string")
    df = df.select("id", F.lit(2000).alias("width"), F.lit(1000).alias("height"), P.json_object(F.col("raw")).alias("v"))
    assert sorted(map(tuple, P.json_blocks(df, "v", "id").collect())) == [(1, 0, "text", [0, 0, 1000, 250], "hi"), (2, 0, "text", [0, 500, 1000, 1000], "")]


def test_words(spark):
    rows = [("Hello", 80.0, 1, 1, 1, 10, 60, 40, 12, 1), ("world", 90.0, 1, 1, 1, 60, 60, 40, 12, 2), ("这", 85.0, 1, 1, 2, 10, 20, 30, 14, 3), ("是", 85.0, 1, 1, 2, 40, 20, 30, 14, 4), (" ", 99.0, 1, 1, 2, 0, 0, 900, 900, 5), ("no", -1.0, 1, 1, 2, 0, 0, 900, 900, 6)]
    df = spark.createDataFrame(rows, "text string, conf double, block_num int, par_num int, line_num int, left int, top int, width int, height int, word_seq int").withColumn("page_id", F.lit(1))
    got = [tuple(r) for r in W.lines(df).orderBy("reading_order").select("text", "x1", "y1", "x2", "y2", "conf").collect()]
    assert got == [("这是", 10, 20, 70, 34, 85.0), ("Hello world", 10, 60, 100, 72, 85.0)]


def test_outlier_leaves_the_box(spark):
    rows = [(t, 90.0, 1, 1, 1, 10 + 20 * i, y, 20, h, i) for i, (t, h, y) in enumerate([("a", 12, 20), ("b", 13, 21), ("c", 12, 20), ("BIG", 120, -40)])]
    df = spark.createDataFrame(rows, "text string, conf double, block_num int, par_num int, line_num int, left int, top int, width int, height int, word_seq int").withColumn("page_id", F.lit(1))
    r = W.lines(df).first()
    assert (r["y1"], r["y2"], r["text"]) == (20, 34, "a b c BIG")


@pytest.mark.parametrize("text, height, kind", [("x + y = z", 12, "equation"), ("1.2", 12, "heading"), ("CHAPTER", 12, "heading"), ("引言", 12, "heading"), ("1.2 计算方法", 12, "text"), ("A sentence of the body.", 12, "text"), ("Title", 60, "heading"), ("CHAPTER 1", 12, "text"), (" ", 60, "text")])
def test_classes(spark, text, height, kind):
    assert one(spark, T.classify(F.col("t"), F.col("h")), t=text, h=float(height)) == kind


def test_small_functions(spark):
    assert one(spark, T.tidy_formula(F.col("t")), t="a \n\n b | x |  ⇒ 5 ^ - 4 1 0") == "a b|x|→5^-41 0"
    assert [one(spark, T.font_of(F.col("t")), t=t) for t in ("abc é", "かな", "한글", "中", "a — b")] == ["helv", "japan", "korea", "china-s", "china-s"]
    assert [one(spark, T.mask(F.col("t")), t=t) for t in ("", "short", "0123456789")] == ["", "*****", "0123**6789"]
    assert [one(spark, T.byte_size(F.col("n")), n=float(n)) for n in (0, 512, 1536, 150 * 1024, 3 * 1024**3)] == ["0 B", "512 B", "1.5 KB", "150 KB", "3.0 GB"]
    pct = lambda c: one(spark, B.percent(F.col("c")), c=c)
    assert (pct(1.0), pct(0.5), pct(87.0), pct(float("nan"))) == (100.0, 50.0, 87.0, None)


def test_captions(spark):
    roles = ["pending", "other", "caption", "caption", "pending", "pending", "other"]
    df = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "page int, i int, role string")
    assert sorted(map(tuple, B.pair_captions(df, ["page"], "i").collect())) == [(1, 2, "image", 0), (1, 3, "image_caption", None), (1, 5, "image", None)]


def test_engines(spark):
    class Echo(engines.Engine):
        def recognise(self, image, width, height):
            if not image:
                raise ValueError("empty")
            return f"{len(image)} {width}x{height}"

    df = spark.createDataFrame([(1, bytearray(b"abc"), 4, 5), (2, bytearray(b""), 1, 1)], "page_id long, image binary, width int, height int")
    assert sorted(map(tuple, engines.recognise(df, Echo).collect())) == [(1, "3 4x5", None), (2, None, "ValueError: empty")]
    assert engines.available()[:3] == ["unlimited", "tesseract", "generic_openai"]
    with pytest.raises(ValueError):
        engines.engine("other")
    with pytest.raises(engines.Unavailable):
        engines.engine(" Tesseract ").recognise(b"", 1, 1)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("ocr_pages", "jobs", "job_events", "cache_files", "documents", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    theirs = sql.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.SQL[name]})").fetchall()
    assert mine == sorted(map(plain, theirs), key=repr)


def test_stream_equals_batch(spark):
    rows = lambda n: sorted(map(tuple, catalog.QUERIES[n](spark, SF).collect()), key=repr)
    assert rows("job_state_stream") == rows("job_state")
