"""Texts that lost their end: hashed logistic regression on how a text closes, its length against known limits, and what follows.

Training needs no labels: the intact values of all pages are cut artificially, at the limits seen in the data and at random
places, to make positives; the same values whole, and values split in two that go on in the next block, are negatives. The pages
are dealt by a hash of their id to shards, each shard fits weights of its own, and a feature's weight is their mean, each counted
as often as the shard has the feature.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.linear import BITS, HashedLogistic, hashed
from leafwork.llm.pages import lists, slices, word_counts
from leafwork.shared import stage

#: Pages of a shard, about; every page is in one.
SHARD_PAGES = 3000
#: A word is known that stands in the texts at least this often and once in so many pages.
KNOWN, KNOWN_PAGES = 10, 300
#: Steps of a weight of one as the shards' weights are summed: whole numbers, so that the order of the sum does not matter.
FINE = 1 << 20
TERMINAL = ".!?。！？．…｡"
_CLOSERS = "\"'”’»)）]】」』›"
_ENDS = frozenset(".!?。！？．｡:：;；")
_MARK = re.compile(r"[\s�]*(?:…|\.\.\.|\[…\]|\[\.\.\.\])?[\s�]*$")
_OPEN_ENDS = frozenset(chr(i) for i in range(0x10000) if chr(i).isspace()) | {"�", "…"}
_AFTER_END = _CLOSERS + "".join(c for c in sorted(_OPEN_ENDS) if c.isspace())
_BULLET = re.compile(r"\s*[-–—•*·▪◦]\s|\s*\d{1,2}[.)]\s")
_ROW = re.compile(r"^.*\|\s*[\d.,]+\s*$")
_FOLIO = re.compile(r"^[\W_]*(?:(?:page|seite|página|pagina|стр|第|p|s)\W*)?(?:[\divxlcmoОоO]{1,8})[\W_]*(?:(?:of|von|de|di|van|из|页|共)\W*)*[\dlOоi]{0,6}\W*(?:页)?\W*$", re.I)
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_NOTED = re.compile(r"[.!?。！？．｡]\s*[(（][^()（）]{1,24}[)）]\s*$")
_LABEL = re.compile(r"[,，] ?(?:[A-ZÀ-ÞА-ЯЁ][^\s\d]*|\d{4})(?:\s+[\divxlcIl]+)?$|^[\W_]*[\w\W]{0,20}[\d/.]{4,}")
_WHOLE_ROW = re.compile(r"\|\s*\d+\s*\|\s*\d+[.,]\d\d\s*$")
_PRICED = re.compile(r"\|\s*\d+[.,]\d\d\s*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[㐀-鿿]")
_SKIP = {"image", "image_ref", "equation", "table", "header"}


def ended(text: str) -> bool:
    """Whether a text has a closing mark, quotes, brackets and white space after it left out."""
    return text.rstrip(_AFTER_END)[-1:] in _ENDS


def start_class(text: str | None) -> str:
    if not text:
        return "none"
    c = text.lstrip("\"'“„«(¿¡ \n")[:1]
    if not c:
        return "none"
    if "㐀" <= c <= "鿿":
        return "cjk"
    if c.isalpha():  # no bullet begins like that
        return "lower" if c.islower() else "upper" if c.isupper() else "other"
    return "bullet" if _BULLET.match(text) else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "other"


def follower(texts: list, kinds: list, i: int) -> str | None:
    """The block that goes on after block ``i``, if one does: the next running text, a page number or heading left out."""
    first = None
    for j in range(i + 1, min(len(texts), i + 5)):
        t = texts[j]
        if not t or kinds[j] in _SKIP or len(t) <= 24 and _FOLIO.match(t):
            continue
        if start_class(t) == "lower" and len(t) > 1:
            return t
        if first is None and kinds[j] == "text" and (len(t) > 60 or ended(t[-12:])):
            first = t
    return first


def features(text: str, kind: str, after: str | None, last: bool, limits: tuple[set, set], known: set) -> list[int]:
    """Hashed features of a block: its close, its length to the limits, and the block after it."""
    text = _HIDDEN.sub("", text) if not text.isascii() else text
    stop = len(text)
    if text[-1:] in _OPEN_ENDS or text.endswith(("...", "…]", "...]")):  # else no mark can follow
        stop = _MARK.search(text, max(0, stop - 16)).start()
    core, mark = text[:stop], text[stop:]
    n = len(core)
    size = n if text.isascii() else len(core.encode("utf-8", "surrogatepass"))
    at = not limits[0].isdisjoint(range(n, n + 4)) or not limits[1].isdisjoint(range(size, size + 5))
    line = core[core.rfind("\n") + 1 :]
    words = line[-80:].split()
    w = words[-1] if words else ""
    c = core.rstrip(_CLOSERS)[-1:]
    cjk = "㐀" <= c <= "鿿"
    end = "noted" if text[-1:] in ")）" and _NOTED.search(text[-40:]) else "term" if c in TERMINAL else "mark" if c in ",，、-:：;；" else "digit" if c.isdigit() else "cjk" if cjk else "alpha" if c.isalpha() else "none" if not c else "other"
    start = start_class(after)
    bare = w.strip(".,;:()|").lower()
    row = "row" if "|" in line and _ROW.match(line) else "pipe" if "|" in core else "item" if _BULLET.match(line) else "one" if line is core or line == core else "more"
    marked = ("e" if "…" in mark or "..." in mark else "") + ("r" if "�" in mark else "")
    size_class = min(n // 30, 5)
    out = [*_shared(end, at, marked, kind, row, start, size_class, last), hashed(f"c={c}")]
    if end not in ("alpha", "cjk", "digit", "mark"):
        return out
    place = w[:1].isupper() and len(words) > 1 and words[-2].endswith(",")
    out += _of_word(bare in known, place, w[:1].isupper(), min(len(bare), 6), core.count("(") > core.count(")"), min(core.count("\n"), 2), row, at, size_class, start)
    out.append(hashed(f"w={bare if not cjk else core[-2:]}"))
    if after:
        first = after.split(None, 1)[0].strip(",.").lower()[:12] if start != "cjk" else after[:2]
        out += [hashed(f"f={first}"), hashed(f"f={first},{end}")]
        if start == "cjk":
            out.append(hashed(f"j={core[-1:]}{after[:1]}"))
    return out


@functools.lru_cache(200_000)
def _shared(end: str, at: bool, marked: str, kind: str, row: str, start: str, size_class: int, last: bool) -> tuple[int, ...]:
    """Hashed features of what many blocks have in common."""
    return tuple(map(hashed, (
        "b", f"end={end}", f"at={at}", f"at={at},{end}", f"mark={marked},{end}", f"kind={kind},{end}", f"row={row},{end},{kind}", f"s={start},{end}", f"s={start},{end},{size_class}",
        f"last={last},{end},{size_class}", f"n={size_class},{end},{row}", f"at={at},{end},{start},{row}", f"last={last},{start},{end},{row}")))


@functools.lru_cache(200_000)
def _of_word(complete: bool, place: bool, up: bool, length: int, opened: bool, lines: int, row: str, at: bool, size_class: int, start: str) -> tuple[int, ...]:
    """The same of an end without a closing mark."""
    return tuple(map(hashed, (
        f"known={complete},{row},{at}", f"place={place},{row},{size_class}", f"up={up},{row},{size_class}", f"wl={length},{complete}", f"open={opened}", f"lines={lines},{row},{size_class}", f"known={complete},{start}")))


def find_limits(pages: DataFrame, sharp: float = 3.0) -> dict[tuple, tuple[set, set]]:
    """Lengths from 64 up at which the texts of an (adapter, model) pile up without a closing mark, in characters and in UTF-8 bytes."""
    b = pages.select("adapter", "model", F.explode("blocks").alias("b")).select("adapter", "model", F.col("b.text").alias("t")).filter("length(t) >= 64")
    # only the last characters are looked at by the patterns; lengths are of the whole text
    tail = F.substring("t", -4, 4)
    b = b.filter(~F.substring("t", -1, 1).isin(*".。!?！？．)")).select("adapter", "model", F.regexp_replace(tail, "[\\s�…]+$|\\.\\.\\.$", "").alias("kept"), tail.alias("tail"), "t")
    b = b.select("adapter", "model", (F.length("t") - F.length("tail") + F.length("kept")).alias("n"), (F.octet_length("t") - F.octet_length("tail") + F.octet_length("kept")).alias("size"))
    found: dict[tuple, tuple[set, set]] = {}
    units = F.array(F.struct(F.lit(0).alias("u"), F.col("n").alias("v")), F.struct(F.lit(1).alias("u"), F.col("size").alias("v")))
    counts = b.groupBy("adapter", "model", "n", "size").count().select("adapter", "model", "count", F.explode(units).alias("x"))
    counts = counts.groupBy("adapter", "model", "x.u", "x.v").agg(F.sum("count").alias("k")).filter("k >= 3 and v < 1000000")
    # a peak stands out from every length near it and holds a share of the open texts; few lengths can, so the result is small
    w = Window.partitionBy("adapter", "model", "u").orderBy("v")
    near = F.greatest(*[F.coalesce(F.max("k").over(w.rangeBetween(a, b)), F.lit(0)) for a, b in ((-15, -4), (4, 15))])
    share = F.sum("k").over(Window.partitionBy("adapter", "model", "u"))
    peaks = counts.withColumn("near", near).withColumn("all", share).filter((F.col("k") >= sharp * (F.col("near") + 0.5)) & (F.col("k") >= 0.004 * F.col("all")))
    for r in peaks.orderBy(F.desc("k")).limit(1000).collect():
        found.setdefault((r[0], r[1]), (set(), set()))[r[2]].add(r[3])
    return found


class TruncationModel:
    """The fitted scorer: limits by (adapter, model), words known to end texts, and the weights."""

    def __init__(self, limits: dict, known: set, lr: HashedLogistic):
        self.limits, self.known, self.lr = limits, known, lr

    def whole(self, text: str) -> bool:
        """Whether the last word can be a whole one, so that the text may go on elsewhere."""
        w = (text if text.isascii() else _HIDDEN.sub("", text)).rsplit(None, 1)[-1:]
        bare = w[0].strip(".,;:()|").lower() if w else ""
        return bool(w) and (bare in self.known or w[0][:1].isupper() or w[0][-1] in "-‐¬­,;:" or w[0].isdigit() or "㐀" <= w[0][-1] <= "鿿")

    def complete(self, text: str, kind: str, after: str | None, limits: tuple[set, set]) -> bool:
        """The exact check: page numbers, headings, one-line labels, table rows with both numbers, lists whose last word is known and words broken into the next block are whole."""
        if len(text) in limits[0] or len(text) <= 24 and _FOLIO.match(text):
            return len(text) <= 24
        plain = _HIDDEN.sub("", text).rstrip()
        if kind in ("heading", "title", "header", "equation") or "|" in plain and _WHOLE_ROW.search(plain[-40:]):
            return True
        if plain[-1:] in "-‐¬" and start_class(after) == "lower":
            return True
        if len(plain) < 70 and "\n" not in plain and _LABEL.search(plain) and start_class(after) != "lower":
            return True
        last = plain.split()[-1:] or [""]
        return bool(_BULLET.match(plain)) and all(_BULLET.match(x) for x in plain.split("\n")) and last[0].lower() in self.known

    def limits_of(self, adapter, model) -> tuple[set, set]:
        return self.limits.get((adapter, model), (set(), set()))


def examples(rows: list, limits: dict, known: set, rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """Features and labels from pages (``adapter``, ``model``, ``blocks``): intact texts as they are, split and cut."""
    x, y = [], []

    def add(text, kind, after, last, lim, label):
        x.append(features(text, kind, after, last, lim, known))
        y.append(label)

    for r in rows:
        blocks = [b for b in r["blocks"] or [] if b]
        texts, kinds = [b["text"] for b in blocks], [b["kind"] or "" for b in blocks]
        lim = limits.get((r["adapter"], r["model"]), (set(), set()))
        for i, t in enumerate(texts):
            if not t or not t.strip():
                continue
            after, last, kind = follower(texts, kinds, i), i == len(texts) - 1, kinds[i]
            table = "|" in t
            bullet = _BULLET.match(t)
            whole_list = bool(bullet) and all(_BULLET.match(x) for x in t.split("\n"))
            label_line = len(t) < 70 and "\n" not in t and bool(_LABEL.search(_HIDDEN.sub("", t)))
            noted = bool(_NOTED.search(t[-40:]))
            intact = whole_list or noted or len(t) <= 24 and bool(_FOLIO.match(t)) or label_line or ended(t) and not t.rstrip().endswith(("…", "...")) or kind in ("heading", "title", "header", "equation") or len(t) < 60 and not last and start_class(after) != "lower" or table and bool(_PRICED.search(t))
            if not intact:
                continue
            add(t, kind, after, last, lim, 0)
            if kind not in ("text", "footnote", "table", "") or len(t) < 40:
                continue
            if not table and not bullet and (rng.random() < 0.5):  # goes on in the next block: not cut
                p = rng.randrange(20, len(t) - 10)
                if not _HAN.search(t):
                    p = t.find(" ", p) + 1 or p
                add(t[:p].rstrip(), kind, t[p:], last and rng.random() < 0.5, lim, 0)
            size = len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass"))
            near = [n for n in lim[0] if n < len(t)] + [-n for n in lim[1] if n < size]
            for at_limit in ((True, False) if near else (False, False)):
                if at_limit:
                    n = rng.choice(near)
                    cut = t[:n] if n > 0 else t.encode("utf-8", "surrogatepass")[:-n].decode("utf-8", "replace")
                    add(cut.rstrip() + rng.choice(["", "", "", "…"]), kind, after, last, lim, 1)
                else:
                    cut = t[: rng.randrange(min(30, len(t) - 5), len(t) - 2)].rstrip()
                    if not ended(cut):
                        add(cut + rng.choice(["", "", "", "…", "..."]), kind, None, True, lim, 1)
    return x, y


def _rows(shard: pa.Table) -> list[dict]:
    """The rows of a shard as ``to_pylist`` gives them, its blocks' fields taken out at once."""
    blocks = shard.column("blocks").combine_chunks()
    blocks = blocks if isinstance(blocks, pa.ListArray) else pa.concat_arrays(blocks.chunks)
    flat = blocks.flatten()
    each = [{"kind": k, "text": t} if there else None for there, k, t in zip(flat.is_valid().to_pylist(), *(pa.compute.struct_field(flat, c).to_pylist() for c in ("kind", "text")))]
    at, rows = 0, []
    for n, page, adapter, model in zip(pa.compute.list_value_length(blocks).to_pylist(), *(shard.column(c).to_pylist() for c in ("page_id", "adapter", "model"))):
        rows.append({"page_id": page, "adapter": adapter, "model": model, "blocks": None if n is None else each[at : at + n]})
        at += n or 0
    return rows


def fit(pages: DataFrame, seed: int = 11) -> TruncationModel:
    """Fit on all pages; limits and known words are counted over all pages too. Peaks, words that stand in one of ``KNOWN_PAGES`` pages and
    at most ``2**BITS`` sums of weights come to the driver."""
    limits, total = find_limits(pages), pages.count()
    words = word_counts(pages, lambda t: [t.lower()] if t.isascii() and t.isalpha() else _LETTERS.findall(t.lower()))
    known = {r["word"] for r in words.filter(F.col("n") >= max(KNOWN, total // KNOWN_PAGES)).collect()}
    shared = pages.sparkSession.sparkContext.broadcast((limits, known))

    def work(key: tuple, shard: pa.Table) -> pa.Table:
        rows = sorted(_rows(shard), key=lambda r: (r["page_id"] is None, r["page_id"]))
        x, y = examples(rows, *shared.value, random.Random(seed + key[0].as_py()))
        at = weighted = seen = np.zeros(0, np.int64)
        if x and 0 < sum(y) < len(y):
            w = HashedLogistic().fit(x, np.array(y, np.float32)).w
            seen = np.bincount(np.fromiter(chain.from_iterable(x), np.int64), minlength=1 << BITS)
            at = np.flatnonzero(seen)
            seen, weighted = seen[at], np.rint(w[at].astype(np.float64) * FINE).astype(np.int64) * seen[at]
        return pa.table({"feature": pa.array(at, pa.int64()), "weighted": pa.array(weighted, pa.int64()), "seen": pa.array(seen, pa.int64())})

    shard = F.pmod(F.xxhash64("page_id"), F.lit(max(1, -(-total // SHARD_PAGES)))).alias("shard")
    rows = pages.select(shard, "page_id", "adapter", "model", F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"))).alias("blocks"))
    sums = rows.groupBy("shard").applyInArrow(work, "feature long, weighted long, seen long").groupBy("feature").agg(F.sum("weighted").alias("weighted"), F.sum("seen").alias("seen"))
    lr = HashedLogistic()
    for r in sums.collect():
        lr.w[r["feature"]] = r["weighted"] / r["seen"] / FINE
    return TruncationModel(limits, known, lr)


def score_blocks(pages: DataFrame, model: TruncationModel) -> DataFrame:
    """``page_id``, ``block_index``, ``score`` of every block with text, for the text that follows on the same page or the next.

    The top of the next page is looked up by (``job_id``, ``page_index`` + 1): an equi-join over the few blocks that stand last in
    their page, which spreads a hot job over all tasks. Null or blank texts are not scored. Of repeated pages, the one with
    the smallest ``page_id`` is taken as the next.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            f = {c: lists(b.column(c)) for c in ("kind", "text")}
            ids, adapters, models = (b.column(c).to_pylist() for c in ("page_id", "adapter", "model"))
            rows, feats, opens = [], [], []
            for k, texts in enumerate(f["text"]):
                kinds = f["kind"][k]
                lim = m.limits_of(adapters[k], models[k])
                for i, t in enumerate(texts):
                    if not t or not t.strip():
                        continue
                    after = follower(texts, kinds, i)
                    last = i == len(texts) - 1
                    rows.append((k, i, after is None and m.whole(t)))
                    feats.append(features(t, kinds[i] or "", after, last, lim, m.known))
            s = [min(v, 0.499) if v > 0.5 and m.complete(f["text"][k][i], f["kind"][k][i] or "", follower(f["text"][k], f["kind"][k], i), m.limits_of(adapters[k], models[k])) else v for v, (k, i, _) in zip(m.lr.scores(feats), rows)]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[k] for k, _, _ in rows], pa.int64()), pa.array([adapters[k] for k, _, _ in rows], pa.string()), pa.array([models[k] for k, _, _ in rows], pa.string()),
                pa.array([i for _, i, _ in rows], pa.int32()), pa.array(s, pa.float64()), pa.array([x for _, _, x in rows], pa.bool_())],
                ["page_id", "adapter", "model", "block_index", "score", "bottom"])

    return pages.select(F.col("page_id").cast("long"), "adapter", "model", "blocks.kind", "blocks.text").mapInArrow(work, "page_id long, adapter string, model string, block_index int, score double, bottom boolean")


def truncated(pages: DataFrame, model: TruncationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """Every block with text: ``page_id``, ``adapter``, ``model``, ``block_index``, ``score``, ``cut``.

    Columns used: ``page_id``, ``job_id``, ``page_index``, ``adapter``, ``model``, ``blocks`` (``kind``, ``text``); others are ignored. An
    empty table gives no rows; without anything to learn from, every score is 0.5 and nothing is cut. Repeated pages are scored each.
    """
    model = model or fit(pages)
    scored = stage(score_blocks(pages, model), "scores")
    doubtful = scored.filter((F.col("score") > threshold) & F.col("bottom")).groupBy("page_id").agg(F.max("block_index").alias("block_index"))
    # the first running texts of every page, as what a block at the bottom of the page before it may go on with
    def top(b):
        folio = (F.length(b["text"]) <= 24) & b["text"].rlike(r"(?U)^[\W_]*(?i:page|seite|p[áa]gina|стр|第)?[\W_]*[\dIVXLCMivxlcmOol]{1,8}[\W_]*((?i:of|von|de|di|van|из|页 共|页)?[\W_]*[\dOoIl]*[\W_]*(页)?[\W_]*)$")
        return b["text"].isNotNull() & (b["kind"].isNull() | ~b["kind"].isin(*sorted(_SKIP))) & (F.length(b["text"]) > 1) & ~folio

    goes_on = F.exists(F.slice(F.filter("blocks", top), 1, 3), lambda b: b["text"].rlike(r"^[\"'“„«(]?\p{Ll}\S*(\s|$)"))
    lower = pages.filter(goes_on).select("job_id", (F.col("page_index") - 1).alias("page_index")).distinct()
    saved = doubtful.join(pages.select("page_id", "job_id", "page_index"), "page_id").join(lower, ["job_id", "page_index"], "left_semi").select("page_id", "block_index", F.lit(True).alias("goes_on"))
    return scored.join(saved, ["page_id", "block_index"], "left").select(
        "page_id", "adapter", "model", "block_index", "score", ((F.col("score") > threshold) & F.col("goes_on").isNull()).alias("cut"))
