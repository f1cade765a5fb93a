import pytest

from leafwork.llm import languages, lookalikes, noise, truncation
from leafwork.llm.linear import HashedLogistic, hashed

BLOCK = "array<struct<kind string, bbox array<int>, text string, caption string, conf double, font_scale double>>"
SCHEMA = f"page_id long, job_id string, page_index int, width int, height int, lang string, adapter string, model string, text string, blocks {BLOCK}"
SF = "/root/testdata/sf0.01/ocr_pages.parquet"


def block(text, kind="text", y=500):
    return (kind, [10, y, 900, y + 40], text, "", None, 1.0)


def pages(spark, *rows):
    out = [(i, r.get("job", "j"), r.get("at", i), 1000, 2000, r.get("lang"), "a", "m", "clash", r.get("blocks")) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(SF)


@pytest.fixture(scope="module")
def odd(spark):
    """Pages with nulls, blanks, very long texts and repeated rows."""
    return pages(spark, {"blocks": None}, {"blocks": []}, {"blocks": [block(None), block(""), block(" \n ")]}, {"blocks": [block("word " * 40000)]}, {"job": None, "at": None, "blocks": [block("x", None), ("text", None, "y", None, None, None)]}, {"at": 3, "blocks": [block("word " * 40000)]})


def test_logistic():
    import numpy as np

    rows = [[hashed("a")], [hashed("b")], [hashed("a"), hashed("c")], [hashed("b"), hashed("c")]] * 30
    m = HashedLogistic(epochs=20).fit(rows, np.array([1, 0, 1, 0] * 30, np.float32))
    assert m.score([hashed("a")]) > 0.8 > 0.2 > m.score([hashed("b")])


def test_truncation(spark, real, odd):
    model = truncation.fit(real)
    whole = "The early tide table is kept in the west wing. The numbered frame shows each damp pump."
    p = pages(spark, {"blocks": [block(whole), block(whole[:60] + "e"), block(whole)]}, {"blocks": [block(whole), block("Both the shared greenhouse and")]}, {"at": 2, "blocks": [block("the damp specimen were sent to Morevburg."), block("The early tide table is kept in the we…")]})
    cut = {(r["page_id"], r["block_index"]) for r in truncation.truncated(p, model).filter("cut").collect()}
    assert (2, 1) in cut and (1, 1) not in cut and not cut & {(0, 0), (0, 2), (1, 0), (2, 0)}
    assert truncation.truncated(odd, model).count() == 4  # page 3, its copy, and the two of page 4; blanks are not scored
    assert truncation.truncated(odd.limit(0)).count() == 0


def test_held_out_cuts(real):
    """Cuts made in intact texts of pages the model has not seen: most are found, few intact texts are taken for cut."""
    model = truncation.fit(real.filter("page_id % 2 = 0"))
    import re

    texts = [b["text"] for r in real.filter("page_id % 2 = 1").select("blocks").collect() for b in r["blocks"] or [] if b["kind"] == "text" and b["text"] and re.search(r"[a-z]\.$", b["text"]) and len(b["text"]) > 150][:300]
    score = lambda t, last: model.lr.score(truncation.features(t, "text", None, last, (set(), set()), model.known))
    assert sum(score(t[: 60 + i % 80].rstrip(" ."), True) > 0.5 for i, t in enumerate(texts)) > 0.93 * len(texts)
    assert sum(score(t, i % 2 == 0) > 0.5 for i, t in enumerate(texts)) < 0.03 * len(texts)


@pytest.mark.parametrize("a, b, same", [
    ("The frame", "Thе frаmе", True), ("No. 12", "Ｎｏ． １２", True), ("el catálogo", "el catálogo", True), ("a b", "a b", True), ("volume", "vo​lu­me", True), ("这一份", "这⼀份", True),
    ("нa cтpaницe", "на странице", True), ("Ω x", "Ω x", False), ("a b", "a\nb", False), ("l6", "16", False), ("a-b", "a–b", False), ("abc", "abd", False), ("xii", "хіі", True), ("office", "oﬃce", True), ("", "", False),
    ("the кat sat", "the kat sat", True), ("рок и кот", "pok u kot", False), ("one вid only", "one bid only", True)])
def test_look_alikes(spark, a, b, same):
    s = lookalikes.Scripts()
    assert (lookalikes.consistent(a, s) == lookalikes.consistent(b, s)) == (same or a == b)
    p = pages(spark, {"blocks": [block(a)]}, {"blocks": [block(b), block(a)]})
    got = sorted(map(tuple, lookalikes.look_alike_pairs(p, s).collect()))
    assert got == ([(0, 0, 1, 0), (1, 0, 1, 1)] if same and a != b else [])


def test_the_search_decides_where_a_table_cannot():
    """A table of near letters alone would take a Russian word for a Latin one; one of exact look-alikes alone would miss a mixed word."""
    s = lookalikes.Scripts()
    table = lambda t: "".join(lookalikes.NEAR.get(c, c) for c in lookalikes.skeleton(t))
    assert table("кот") == table("kot") and lookalikes.consistent("кот", s) != lookalikes.consistent("kot", s)
    assert lookalikes.skeleton("кind") != lookalikes.skeleton("kind") and lookalikes.consistent("кind", s) == "kind"


def test_hot_classes_and_links(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "SALT_ROWS", 7)
    p = pages(spark, *[{"blocks": [block("No. 12"), block("x" * 3)]} for _ in range(40)], {"blocks": [block("Ｎｏ． １２")]}, {"blocks": [block("No.\u00a012")]})
    s = lookalikes.Scripts()
    got = lookalikes.look_alike_pairs(p, s).collect()
    assert len(got) == len(set(got)) == 40 * 1 + 40 * 1 + 1 and all((r[0], r[1]) < (r[2], r[3]) for r in got)
    links = {(r["page_id"], r["block_index"]): (r["variants"], r["copies"], r["links"]) for r in lookalikes.look_alike_classes(p, s).collect()}
    assert links[0, 0] == (3, 40, 2) and links[40, 0] == (3, 1, 41) and (0, 1) not in links


def test_look_alikes_odd(odd):
    assert lookalikes.look_alike_pairs(odd).count() == 0 and lookalikes.consistent_text(odd).count() == 6
    assert lookalikes.consistent("нa cтpaницe", lookalikes.Scripts()) == "на странице"


def test_languages(spark, real, odd):
    model = languages.fit(real)
    de, fr = "Bei Kerelburg verdeckt das dunkle Register die feuchte Mappe.", "Chaque lettre lisible confirme chaque planche pâle, puisque la page accompagne la reliure."
    p = pages(spark, {"lang": "DE ", "blocks": [block(de), block(de + " " + fr + " " + de), block(fr, "heading")]}, {"lang": "eng", "blocks": [block(fr), block(fr)]}, {"lang": "n/a", "blocks": [block("A quiet envelope simplifies the iron petition.")]}, {"lang": "fr-FR", "blocks": [block(fr), block("12")]})
    got = sorted(tuple(r) for r in languages.wrong_labels_and_stretches(languages.identify(p, model)).collect())
    assert got == [(0, 1, "fr"), (1, -1, "fr"), (2, -1, "en")]
    assert all(r["page_id"] in (3, 4, 5) for r in languages.identify(odd, model).collect())
    assert languages.identify(odd.limit(0), model).count() == 0
    assert [languages.normal_label(x) for x in (None, "", "und", "Chinese", "chi_sim", "en-GB", " Русский ")] == [None, None, None, "zh", "zh", "en", "ru"]


def test_noise(spark, real, odd):
    lex = noise.fit_lexicon(real)
    find = lambda t, after=None: noise.block_noise(t, after, "text", lex)
    assert find("The early tide table is kept in the west wing.") == []
    assert find("The early invento-\nry is kept in the west wing.") == ["hyphenation"] and find("Each rough ware-", "house is kept.") == ["hyphenation"]
    assert find("The ear1y tide table is kept.") == ["misread"] and find("The surnmary is kept.") == ["misread"] and find("The sum mary is kept.") == ["misread"]
    assert find("page 2O of 27l") == ["misread"] and find("Near Belosford, Unit B4-3108 and No. K646802.") == []
    assert find("那份末签名的日历") == ["misread"] and find("没有任何日期。") == []
    assert noise.repaired("The surnmary of ware-\nhouse l2 is ke pt.", lex).startswith("The summary of warehouse 12 is")
    rows = [{"at": i, "blocks": [block(f"{i}   Report on the pump, Vasevwick" if i != 3 else "3   REPORT ON THE PUMP, VASEVW1CK", y=60), block(f"Each rough page is kept {'here' * i}."), block(f"— {i} —", y=1950)]} for i in range(1, 6)]
    rows += [{"job": "other", "at": 1, "blocks": [block("Report on the pump, Vasevwick", y=60), block("1912", "heading", 900), block("Each page is kept.")]}]
    got = {tuple(r) for r in noise.find_noise(pages(spark, *rows)).filter("noise in ('running_header', 'page_number')").collect()}
    assert got == {(i, 0, "running_header") for i in range(5)} | {(i, 2, "page_number") for i in range(5)}
    assert noise.find_noise(odd).filter("page_id < 3").count() == 0 and noise.find_noise(odd.limit(0)).count() == 0
    text = [r["text"] for r in noise.paragraphs(pages(spark, *rows), lex).filter("page_id = 1").collect()]
    assert text == ["Each rough page is kept herehere."]


def test_the_model_labels_otherwise_than_the_rules():
    """Lines that the first rules take for body or header are labelled by what surrounds them, and every line gets a label."""
    import numpy as np

    form = lambda e, f, r: (noise.EDGES.index(e) * len(noise.FORMS) + noise.FORMS.index(f)) * 2 + r
    start = lambda first, s, before: (first * len(noise.STARTS) + noise.STARTS.index(s)) * 3 + before
    good = np.array([(form("top", "open", 1), start(1, "upper", 2), 0), (form("near", "first-open", 0), start(1, "upper", 1), 0), *[(form("mid", "open", 0), start(0, "lower", 1), 0)] * 5, (form("mid", "closed", 0), start(0, "lower", 1), 0), (form("mid", "first-closed", 0), start(1, "upper", 0), 0), (form("bottom", "folio", 0), start(1, "other", 0), 3)])
    odd = good.copy()
    odd[-1, 0] = form("bottom", "number", 0)  # a page number that is out of its place
    pages = [good] * 60 + [odd]
    m = noise.LineModel().fit(pages)
    got = [m.STATES[v] for v in m.label([good])[0]]
    assert got == ["header", "break", *["body"] * 6, "break", "number"]
    assert [m.STATES[v] for v in m.label([odd])[0]][-1] == "number" != m.STATES[noise.LineModel.seed(odd)[-1]]
    assert all(len(y) == len(p) for y, p in zip(m.label(pages), pages)) and m.label([np.zeros((0, 3), int)])[0].size == 0


def test_headers_anywhere_in_the_edge_zone(spark):
    """A header that is the third block, or longer than any line of the page, recurs like another."""
    long = "Inventory of the northern parish registers and of the tithe maps kept with them, second series, volume"
    rows = [{"at": i, "blocks": [block("Stray mark.", y=20), block("Another mark.", y=60), block(f"{long} {i + 1}", y=120), *[block(f"The clerk {w}{chr(97 + i) * 4} keeps {chr(107 + i) * 5} on the {chr(115 - i) * 6}{w} shelf.", y=400 + 200 * k) for k, w in enumerate(("upper", "lower", "inner"))], block(str(i + 1), y=1950)]} for i in range(8)]
    got = {(r["page_id"], r["block_index"]): r["noise"] for r in noise.find_noise(pages(spark, *rows)).filter("noise <> 'misread'").collect()}
    assert all(got.get((i, 2)) == "running_header" and got.get((i, 6)) == "page_number" for i in range(8)) and not any((i, k) in got for i in range(8) for k in (3, 4, 5))


def test_letter_pairs_are_counted_over_every_page(spark):
    """Each word stands on two of 1,700 pages, more than were once sampled: all letter pairs have their exact counts."""
    from collections import Counter

    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "fgh" for i in range(850)]
    far = pages(spark, *[{"blocks": [block(f"{words[i % 850]} жди 中文页 中文x" + (" seldom" if i == 5 else "")), block(None)]} for i in range(1700)], {"blocks": None})
    s, plain = lookalikes.fit(far), lookalikes.Scripts(Counter({w: 2 for w in words} | {"жди": 1700, "中文x": 1700}))
    assert s.pairs == plain.pairs and s.total == plain.total and s.pairs["C"]["жд"] == 1700


def test_cuts_are_learnt_from_every_page(spark, real, monkeypatch):
    """Words are counted on 9,000 pages, three times as many as were once sampled; the weights are those of all shards, however the pages lie in files."""
    from pyspark.sql import functions as F

    far = pages(spark, *[{"blocks": [block(f"word{chr(97 + i % 10)}x is here."), block(None)]} for i in range(300)]).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("page_id", F.col("page_id") * 30 + F.col("n"))
    rare = F.when(F.col("page_id") < 29, F.lit("seldom ")).when(F.col("page_id") < 59, F.lit("enough ")).otherwise(F.lit(""))
    far = far.withColumn("blocks", F.transform("blocks", lambda b: b.withField("text", F.concat(rare, b["text"]))))
    assert truncation.fit(far).known == {f"word{c}x" for c in "abcdefghij"} | {"is", "here", "enough"}  # 30 times in 9,000 pages, not 29
    monkeypatch.setattr(truncation, "SHARD_PAGES", 200)
    a, b = truncation.fit(real), truncation.fit(real.repartition(7))
    assert (a.lr.w == b.lr.w).all() and a.known == b.known
    rows = [r.asDict(True) for r in real.select("page_id", "adapter", "model", "blocks").collect()]
    import random

    seen = {i for x in truncation.examples(rows, a.limits, a.known, random.Random(0))[0] for i in x}
    assert (a.lr.w != 0).sum() > 0.9 * len(seen)
