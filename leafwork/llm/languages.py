"""Language of pages and of stretches in another language: word-first backoff.

Known words are scored by their log frequency in each language; an unseen word by progressively shorter character n-grams.
Frequencies come from the pages' own labels, cleaned by one round of relabelling with the first fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.lookalikes import Scripts, consistent
from leafwork.llm.pages import bounded_sample, fields, slices

SAMPLE_PAGES = 2500
LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "it", "ru", "nl")
# Spellings of language labels (fixed values); a region or script after - or _ is cut off before the look-up.
SPELLINGS = {
    "en": "en eng english anglais englisch", "zh": "zh chi zho chinese cmn 中文 chinesisch", "de": "de deu ger german deutsch allemand", "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "ru": "ru rus russian русский",
    "nl": "nl nld dut dutch nederlands flemish",
}
_CODE = {s: code for code, names in SPELLINGS.items() for s in names.split()}
_WORD = re.compile(r"[^\W\d_㐀-鿿]+|[㐀-鿿]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*\s+|(?<=[。！？])")
_ENDS = re.compile(r"[.!?。！？][\"'”’»)]*\s*$")
_CJK = re.compile("[㐀-鿿]")
_ODD = re.compile(r"[^\n -~¡-¬®-ɏА-яёЁ‐-―‘-…、-】㐀-鿿（），：；！？．ﬀ-ﬆ]")
_HYPHEN = re.compile(r"(?<=\w)[-¬‐­]\n(?=\w)")
_CYRILLIC, _LATIN = re.compile("[А-яёЁ]"), re.compile("[a-zA-Z]")
_LEFT_OUT = {"heading", "title", "header", "equation", "image", "image_ref", "table"}
ORDERS = (5, 4, 3, 2, 1)
SCHEMA = "page_id long, block_index int, start int, stop int, lang string, confidence double, label string"


def normal_label(label: str | None) -> str | None:
    """The code of a language label in any spelling; None where it says nothing."""
    return _CODE.get(re.split(r"[-_ (]", (label or "").strip().lower())[0]) if label else None


def readable(text: str) -> str:
    """Look-alike letters and hidden characters made plain, words broken at line ends joined."""
    if not text.isascii() and (_ODD.search(text) or _CYRILLIC.search(text) and _LATIN.search(text)):
        text = consistent(text, _PLAIN_SCRIPTS)
    return _HYPHEN.sub("", text) if "\n" in text else text


_PLAIN_SCRIPTS = Scripts()


class LanguageModel:
    """Word and character n-gram log frequencies per language."""

    def __init__(self, counts: dict[str, Counter]):
        total = {l: sum(counts[l].values()) + 1 for l in LANGUAGES}
        everywhere: Counter = Counter()
        for l in LANGUAGES:
            everywhere.update(counts[l])
        self.rows: list[list[float]] = []
        self.ids: dict[str, int] = {}
        for w, n in everywhere.items():
            if n >= 3:
                self.ids[w] = len(self.rows)
                self.rows.append([math.log((counts[l][w] + 0.02) / total[l]) for l in LANGUAGES])
        grams: dict[str, dict[str, Counter]] = {}
        self.grams: list[dict[str, list[float]]] = []
        for k in ORDERS:
            c = {l: Counter() for l in LANGUAGES}
            for l in LANGUAGES:
                for w, n in counts[l].items():
                    s = f" {w} "
                    for i in range(len(s) - k + 1):
                        c[l][s[i : i + k]] += min(n, 20)
            size = {l: sum(c[l].values()) + 100 for l in LANGUAGES}
            keys = {g for l in LANGUAGES for g, n in c[l].items() if n >= 3}
            self.grams.append({g: [math.log((c[l][g] + 0.05) / size[l]) for l in LANGUAGES] for g in keys})
        self.unknown: dict[str, int] = {}
        self.matrix: np.ndarray | None = None

    def backoff(self, w: str) -> list[float]:
        """Scores of an unseen word: at each place the longest n-gram that is known, averaged to the weight of one word."""
        s, total, n = f" {w} ", np.zeros(len(LANGUAGES)), 0
        for i in range(len(s)):
            for k, table in zip(ORDERS, self.grams):
                row = table.get(s[i : i + k]) if i + k <= len(s) else None
                if row is not None:
                    r = np.array(row)
                    total += r - r.max()
                    n += 1
                    break
        return list(np.clip(total / max(1, n) * 2, -6, 0))

    def row(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            i = self.unknown.get(w)
            if i is None:
                i = len(self.rows)
                self.rows.append(self.backoff(w))
                self.unknown[w] = i
        return i

    def scores(self, sentences: list[list[str]]) -> np.ndarray:
        """One row per sentence: summed log scores by language."""
        out = np.zeros((len(sentences), len(LANGUAGES)))
        ids, get = [], self.ids.get
        for words in sentences:
            ids.append([i if (i := get(w)) is not None else self.row(w) for w in words])
        if self.matrix is None or len(self.matrix) < len(self.rows):
            self.matrix = np.array(self.rows, np.float64) if self.rows else np.zeros((0, len(LANGUAGES)))
        n = np.array([len(x) for x in ids])
        full = np.flatnonzero(n)
        if len(full):
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            at = np.concatenate([[0], np.cumsum(n)[:-1]])[full]
            out[full] = np.add.reduceat(self.matrix[flat], at, axis=0)
        if len(self.unknown) > 200_000:  # the memo is rebuilt, so a long partition does not grow it without end
            del self.rows[len(self.ids) :]
            self.unknown.clear()
            self.matrix = None
        return out


def words_of(sentence: str, known=None) -> list[str]:
    """Lower-case words; a name (capitalised, not first, unknown) says nothing about the language."""
    w = _WORD.findall(sentence)
    if known is None:
        return [x.lower() for x in w]
    return [low for i, x in enumerate(w) if (low := x.lower()) in known or i == 0 or not x[0].isupper()]


class Sentence:
    __slots__ = ("block", "start", "stop", "whole", "weight", "words")

    def __init__(self, block, start, stop, whole, weight, words):
        self.block, self.start, self.stop, self.whole, self.weight, self.words = block, start, stop, whole, weight, words


def sentences(texts: list, kinds: list, known) -> list[Sentence]:
    """The sentences of a page, with the block each is in; whole ones start and end in it."""
    out = []
    for b, t in enumerate(texts):
        if not t or kinds[b] in ("equation", "image", "image_ref"):
            continue
        r = readable(t)
        body = kinds[b] not in _LEFT_OUT and "|" not in r
        at = 0
        for part in _SENTENCE.split(r):
            start = r.find(part, at) if part else at
            at = start + len(part)
            words = words_of(part, known) if part else []
            if not words:
                continue
            ended = bool(_ENDS.search(part[-6:]))
            long = len(words) >= 4 if not _CJK.search(part) else len(words) >= 7
            first = part.lstrip("\"'“„«(¿¡0123456789*†‡ \n-–•")[:1]
            out.append(Sentence(b, start, at, body and ended and long and not first.islower(), 1.0 if body and ended and long else 0.0, words))
    return out


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> LanguageModel:
    """Fit on about ``sample_pages`` labelled pages, chosen by a hash of their id (a documented bound)."""
    rows = bounded_sample(pages.select("page_id", "lang", F.transform("blocks", lambda b: b["text"]).alias("texts")), "page_id", sample_pages)
    texts = [(normal_label(r["lang"]), [[w for w in words_of(s)] for t in r["texts"] or [] if t for s in _SENTENCE.split(readable(t)) if s]) for r in rows]
    model = None
    for _ in range(2):
        counts: dict[str, Counter] = {l: Counter() for l in LANGUAGES}
        for label, parts in texts:
            if model is None:
                if label:
                    for p in parts:
                        counts[label].update(p)
            else:
                for p, s in zip(parts, model.scores(parts)):
                    if len(p) >= 4:
                        counts[LANGUAGES[int(s.argmax())]].update(p)
        model = LanguageModel(counts)
    return model


def _confidence(s: np.ndarray, words: int) -> float:
    z = (s - s.max()) / max(1.0, words / 12)
    return float(1 / np.exp(z).sum())


def identify(pages: DataFrame, model: LanguageModel | None = None, margin: float = 5.0) -> DataFrame:
    """Languages of pages and stretches: ``page_id``, ``block_index``, ``start``, ``stop``, ``lang``, ``confidence``, ``label``.

    ``block_index`` -1 is the page with its main language, in which most of its sentences are written (all text decides where it has
    none) and the code of its stored label. Other rows are stretches of whole sentences in another language, with their
    offsets in the readable text; headers, headings, page numbers and tables form none. Pages without any word (null or
    empty blocks, numbers only) give no row. Columns used: ``page_id``, ``lang``, ``blocks`` (``kind``, ``text``).
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit(pages))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            f = fields(b, ["kind", "text"])
            ids, labels = b.column("page_id").to_pylist(), b.column("lang").to_pylist()
            per = [sentences(t, k, m.ids) for t, k in zip(f["text"], f["kind"])]
            all_scores = m.scores([s.words for p in per for s in p])
            at, rows = 0, []
            for page, label, parts in zip(ids, labels, per):
                s = all_scores[at : at + len(parts)]
                at += len(parts)
                if not parts:
                    continue
                best = s.argmax(axis=1)
                votes, scored = defaultdict(float), s.sum(axis=0)
                for i, p in enumerate(parts):
                    votes[int(best[i])] += p.weight
                top = max(votes.values())
                main = max((l for l in votes if votes[l] == top), key=lambda l: scored[l]) if top else int(scored.argmax())
                count = sum(votes.values())
                rows.append((page, -1, None, None, LANGUAGES[main], top / count if top else _confidence(scored, sum(len(p.words) for p in parts)), normal_label(label)))
                open_: list | None = None
                for i, p in enumerate(parts):
                    other = p.whole and best[i] != main and s[i, best[i]] - s[i, main] >= margin
                    if other and open_ and open_[0] == p.block and open_[4] == best[i] and open_[6] == i - 1:
                        open_[2], open_[6] = p.stop, i
                        open_[5] = min(open_[5], _confidence(s[i], len(p.words)))
                        continue
                    if open_:
                        rows.append((page, open_[0], open_[1], open_[2], LANGUAGES[open_[4]], open_[5], None))
                        open_ = None
                    if other:
                        open_ = [p.block, p.start, p.stop, None, int(best[i]), _confidence(s[i], len(p.words)), i]
                if open_:
                    rows.append((page, open_[0], open_[1], open_[2], LANGUAGES[open_[4]], open_[5], None))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "block_index", "start", "stop", "lang", "confidence", "label"])

    return pages.select(F.col("page_id").cast("long"), "lang", "blocks").mapInArrow(work, SCHEMA)


def wrong_labels_and_stretches(found: DataFrame) -> DataFrame:
    """Pages whose label is missing or names another language, and blocks with a sentence in another language."""
    wrong = (F.col("block_index") >= 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return found.filter(wrong).select("page_id", "block_index", "lang").distinct()
