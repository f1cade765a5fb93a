"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Every character of every text goes through the model, in windows that overlap by ``MARGIN`` on both sides. Where windows overlap,
each place takes the tag of the window in which it stands farther from an edge, which gives one tag sequence a text. The spans and
their kinds are the model's alone; afterwards bounds are only moved to whole words, white space and punctuation is trimmed, and what
cannot be of its kind (a telephone number without digits) is dropped.

The weights come with the package; ``pii_train`` makes them anew from the labelled spans of ``pii_examples``.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.bilstm import BiLstmCrf, one_thread
from leafwork.llm.pii_examples import HAN_GIVEN, HAN_SURNAMES, KINDS

WINDOW, MARGIN, TEXTS = 1024, 32, 2048
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
SCHEMA = "doc_id long, pii_kind string, start int, stop int, pii_value string"

_CHARS = " \n" + "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя" + "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" + "0123456789" + "+-()[]/.,:;@＠'\"|&_º°–—?!#*"
_SYMBOL = {c: i + 1 for i, c in enumerate(_CHARS)}
# Chinese characters that announce something or are frequent stand for themselves; the others for what they are in names.
_HAN = "的一这那份在了是联系人读者证件签名请找电话邮箱护照号码税先生女士，。：、"
_LOWER, _UPPER, _CJK, _OTHER, _SURNAME, _GIVEN, *_OWN = (len(_CHARS) + 1 + i for i in range(6 + len(_HAN)))
SYMBOLS = len(_CHARS) + 7 + len(_HAN)
_TABLE = np.full(0x10000, _OTHER, np.int16)
for _i in range(0x80, 0x3000):
    _TABLE[_i] = _LOWER if chr(_i).islower() else _UPPER if chr(_i).isupper() else _OTHER
_TABLE[0x3400:0xA000] = _CJK
for _c, _s in _SYMBOL.items():
    _TABLE[ord(_c)] = _s
_TABLE[0xA0] = _SYMBOL[" "]
for _group, _s in ((HAN_GIVEN, [_GIVEN] * len(HAN_GIVEN)), (HAN_SURNAMES, [_SURNAME] * len(HAN_SURNAMES)), (_HAN, _OWN)):
    for _c, _k in zip(_group, _s):
        _TABLE[ord(_c)] = _k


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(c, 0xFFFF)]


_MODEL: list[BiLstmCrf] = []


def trained() -> BiLstmCrf:
    """The model that comes with the package, read once a process."""
    if not _MODEL:
        _MODEL.append(BiLstmCrf.load(WEIGHTS))
    return _MODEL[0]


def windows(size: int) -> list[tuple[int, int, int, int]]:
    """(first, last, from, to) of the windows over a text of ``size``: its bounds, and the places whose tags it decides."""
    step = WINDOW - 2 * MARGIN
    if size <= WINDOW:
        return [(0, size, 0, size)] if size else []
    out, a = [], 0
    while True:
        b = min(size, a + WINDOW)
        out.append((a, b, a + MARGIN if a else 0, b - MARGIN if b < size else size))
        if b == size:
            return out
        a += step


_WORD = re.compile(r"[^\W_㐀-鿿]+")
_EDGE = {"phone": (re.compile(r"[\d+(]"), re.compile(r"\d")), "": (re.compile(r"\w"), re.compile(r"[\wº°]"))}


def _bounded(text: str, kind: str, tags: np.ndarray, s: int, e: int) -> tuple[int, int] | None:
    """A run's bounds at whole words (a word belongs to it if half of its letters do), without white space and punctuation at the ends."""
    for at in (s, e - 1):
        m = _word_at(text, at)
        if m and (m[0] < s or m[1] > e):
            inside = int((tags[m[0] : m[1]] == tags[at]).sum())
            if at == s:
                s = m[0] if 2 * inside >= m[1] - m[0] else min(m[1], e)
            else:
                e = m[1] if 2 * inside >= m[1] - m[0] else max(m[0], s)
    first, last = _EDGE.get(kind, _EDGE[""])
    while s < e and not first.match(text, s):
        s += 1
    initial = kind == "name" and text[e - 1 : e] == "." and e - s > 2 and text[e - 2].isupper() and not text[e - 3].isalnum()
    while s < e and not initial and not last.match(text, e - 1):
        e -= 1
    return (s, e) if s < e else None


def _possible(kind: str, value: str) -> bool:
    """The exact check after the model: whether a value can be of its kind at all. It only drops spans; it proposes none."""
    digits = sum(c.isdigit() for c in value)
    if kind == "email":
        return bool(re.search(r"[@＠]|\bat\b", value))
    if kind in ("phone", "id_number"):
        return digits >= 5
    if kind == "address":
        return digits > 0 and any(c.isalpha() for c in value)
    return any(c.isalpha() for c in value)


def _word_at(text: str, at: int) -> tuple[int, int] | None:
    if not _WORD.match(text[at]):
        return None
    a = b = at
    while a and _WORD.match(text[a - 1]):
        a -= 1
    while b < len(text) and _WORD.match(text[b]):
        b += 1
    return a, b


class Finder:
    def __init__(self, model: BiLstmCrf):
        self.model = model

    def tags(self, texts: list[str | None]) -> list[np.ndarray]:
        """One tag a character of each text: 0, or 1 + the number of its kind."""
        sym = [symbols(t or "") for t in texts]
        places = [(k, *w) for k, s in enumerate(sym) for w in windows(len(s))]
        found = self.model.decode([sym[k][a:b] for k, a, b, _, _ in places])
        out = [np.zeros(len(s), np.int8) for s in sym]
        for (k, a, _, lo, hi), y in zip(places, found):
            out[k][lo:hi] = y[lo - a : hi - a]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, stop) of each text, in order, none overlapping."""
        out = []
        for t, y in zip(texts, self.tags(texts)):
            found, last = [], 0
            if len(y) and y.any():
                cut = np.flatnonzero(np.diff(y)) + 1
                for s, e in zip(np.append(0, cut).tolist(), np.append(cut, len(y)).tolist()):
                    if y[s] and e > last and (got := _bounded(t, KINDS[y[s] - 1], y, max(s, last), e)) and _possible(KINDS[y[s] - 1], t[got[0] : got[1]]):
                        found.append((KINDS[y[s] - 1], *got))
                        last = got[1]
            out.append(found)
        return out


def find_pii(documents: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """Each piece of personal information: ``doc_id``, ``pii_kind``, ``start``, ``stop``, ``pii_value`` (white space as one blank).

    Columns used: ``doc_id``, ``text``. Null and empty texts hold none; repeated rows give repeated rows. Every character of every
    text is decoded, in one pass without a shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model or trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        finder = Finder(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                texts = part.column("text").to_pylist()
                rows = [(d, k, s, e, re.sub(r"\s+", " ", t[s:e])) for d, t, found in zip(part.column("doc_id").to_pylist(), texts, finder.spans(texts)) for k, s, e in found]
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "pii_kind", "start", "stop", "pii_value"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def mask_pii(documents: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """``doc_id`` and ``text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place of what was found, else unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(model or trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        finder = Finder(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                texts = part.column("text").to_pylist()
                out = []
                for t, found in zip(texts, finder.spans(texts)):
                    for k, s, e in reversed(found):
                        t = f"{t[:s]}[{k.upper()}]{t[e:]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, text string")
