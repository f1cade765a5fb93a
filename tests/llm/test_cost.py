"""The llm operators do no work twice, and their short cuts give what the long way gives."""

from collections import Counter

import numpy as np
import pyarrow as pa

from leafwork.llm import leaks, noise, truncation
from leafwork.llm.languages import readable
from leafwork.llm.linear import HashedLogistic
from leafwork.llm.lookalikes import skeleton


def test_a_name_is_looked_into_once(monkeypatch):
    lex = noise.Lexicon(Counter({w: 900 for w in "the letter was read by and again kept".split()}), Counter(), 3)
    tried, swaps = [], noise.Lexicon._swaps
    monkeypatch.setattr(noise.Lexicon, "_swaps", lambda self, w: tried.append(w) or swaps(self, w))
    for _ in range(50):
        assert noise.block_noise("The letter was read by Brandtner and again by Brandtner.", None, "text", lex) == []
    once = len(tried)
    assert once and tried.count("brandtner") <= 2  # 100 before
    assert noise.block_noise("The letter was read by Brandtner and ke pt.", None, "text", lex) == ["misread"]
    assert noise.block_noise("The letter was read by 2O Brandtner.", None, "text", lex) == ["misread"]
    assert noise.block_noise("The lettcr was read by Brandtner.", None, "text", lex) == ["misread"]


def test_text_left_as_it_is():
    slow = lambda t: readable(t.replace("\n", "\x02\n")).replace("\x02", "")
    texts = ["Größe “ça” – l’été\nà Łódź", "第一章、目录。\n内容", "naïve¬\nté", "café\tnoir", "ﬁne\nœuvre…", "е́та\nKот", "x‐\ny", "１２\n，"]
    assert [noise.clean(t) for t in texts] == [slow(t) for t in texts]
    assert [bool(noise._SAME.fullmatch(t)) for t in texts] == [True, True, True, False, False, False, False, False]
    assert all(skeleton(t) == t for t in texts[:3])


def test_lexicon_counts_words_and_pairs(spark):
    blocks = "array<struct<kind string, text string>>"
    rows = [(i, [("text", "Größe, großE\nStraße ke4pt"), None, ("text", None), ("text", "图书\n馆12。书馆")]) for i in range(4)] + [(9, None)]
    lex = noise.fit_lexicon(spark.createDataFrame(rows, f"page_id long, blocks {blocks}"))
    assert lex.words == {"größe": 4, "große": 4, "straße": 4, "ke": 4, "pt": 4}
    assert lex.pairs == {"图书": 4, "书馆": 8, "馆0": 4, "00": 4, "0。": 4, "。书": 4}


def test_lanes_follow_links_side_by_side(monkeypatch):
    rng = np.random.default_rng(5)
    items = ["".join(rng.choice(list("ab"), 400)) for _ in range(3)]
    flat, least = leaks.Flat(leaks.Automaton(items)), 8
    x = np.array([ord(c) for c in "".join(rng.choice(list("abc"), 6000, p=[0.49, 0.49, 0.02]))], np.uint32)
    calls, step = [], leaks.Flat.step
    monkeypatch.setattr(leaks.Flat, "step", lambda self, *a: calls.append(1) or step(self, *a))
    got = flat.long_matches(x, np.full(len(x), least, np.int32), least)
    text = "".join(map(chr, x))
    assert got.tolist() == [i + 1 >= least and any(text[i + 1 - least : i + 1] in t for t in items) for i in range(len(x))]
    lanes = len(x) // (4 * least + 1)
    assert len(calls) <= 2 * (-(-len(x) // lanes) + least)  # a letter or a link at a time, never more links than letters


def test_fours_of_all_parts_are_looked_up_at_once(monkeypatch):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)]
    texts = [" ".join(words[k : k + 30]) for k in (0, 40, 80)]
    index, calls = leaks.LeakIndex([(1, texts[0]), (2, texts[1]), (3, texts[2])]), []
    could = leaks.Items.could
    monkeypatch.setattr(leaks.Items, "could", lambda self, *a: calls.append(1) or could(self, *a))
    docs = ["x " + " ".join(words[0:30]), None, "", "so " + " ".join(words[38:75]), " ".join(words[80:92]) + " but not the rest"] * 5
    assert sorted((d, i) for d, i, *_ in index.search(docs)) == sorted((5 * k + d, i) for k in range(5) for d, i in ((0, 1), (3, 2)))
    assert len(calls) == 1  # 15 before


def test_a_shards_rows_without_a_step_for_each_block():
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    rows = [{"page_id": 2, "adapter": "a", "model": None, "blocks": [{"kind": "text", "text": "x"}, None, {"kind": None, "text": None}]}, {"page_id": None, "adapter": None, "model": "m", "blocks": None}, {"page_id": 1, "adapter": "a", "model": "m", "blocks": []}]
    shard = pa.Table.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("adapter", pa.string()), ("model", pa.string()), ("blocks", kinds)]))
    assert truncation._rows(shard) == rows == truncation._rows(pa.concat_tables([shard.slice(0, 1), shard.slice(1)])) and truncation._rows(shard.slice(0, 0)) == []
    found = ["- a", "1) b", "-b", "“c", "Ä", "9", "图", " \n x", "\tx", "", "\"", "ǅ"]
    assert [truncation.start_class(t) for t in found] == ["bullet", "bullet", "other", "lower", "upper", "digit", "cjk", "lower", "other", "none", "none", "other"]


def test_scores_read_only_what_they_use(spark, tmp_path):
    block = "array<struct<kind string, bbox array<int>, text string, conf double>>"
    rows = [(1, "a", "m", [("text", [1, 2, 3, 4], "The letter was", 1.0), None]), (2, None, None, None)]
    spark.createDataFrame(rows, f"page_id long, adapter string, model string, blocks {block}").write.parquet(str(tmp_path / "pages"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scored = truncation.score_blocks(spark.read.parquet(str(tmp_path / "pages")), truncation.TruncationModel({}, set(), HashedLogistic()))
    assert [(r["page_id"], r["block_index"], r["score"]) for r in scored.collect()] == [(1, 0, 0.5)]
    assert "blocks:array<struct<kind:string,text:string>>" in scored._jdf.queryExecution().executedPlan().toString()
