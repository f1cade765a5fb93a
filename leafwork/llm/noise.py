"""Noise of scanned pages and its repair: a hidden Markov model labels every line of a page as header, page number, break or body.

The lines are described by layout features (place on the page, form, whether a line at the edge recurs on pages nearby, how it starts and
what came before, its block's kind and confidence); the model, fitted by hard re-estimation on a bounded sample, labels the sequence,
and paragraphs follow its breaks. Broken words and misread characters are found against a lexicon counted over all pages and a
table of visual confusions.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from operator import add
from unicodedata import combining

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.languages import readable
from leafwork.llm.lookalikes import skeleton
from leafwork.llm.pages import WORDS, bounded_sample, lists, slices
from leafwork.shared import stage

SAMPLE_PAGES = 3000
COMMON, RARE = 300, 40
#: A line recurs where it stands on this many pages of a stretch; a stretch is up to three buckets of this many pages.
RECURS, BUCKET = 3, 12
# What a character or pair of characters is visually recognised as (fixed values): read -> meant.
CONFUSIONS = {
    "0": "oо", "1": "liі", "!": "il", "|": "li", "5": "s", "@": "a", "$": "s", "9": "gqд", "6": "bб", "8": "b", "3": "зeэ", "4": "aч", "2": "z", "7": "т", "(": "c", "¡": "i",
    "c": "eç", "e": "c", "l": "it", "i": "lí", "n": "uñп", "u": "n", "h": "b", "b": "h", "f": "t", "t": "f", "g": "qç9", "q": "g", "a": "oãá", "o": "aeóõ", "v": "y", "y": "v", "I": "l", "O": "o", "s": "ş",
    "и": "йнп", "н": "и", "п": "л", "л": "п", "ш": "щ", "щ": "ш", "ц": "п", "е": "ё", "ь": "ъ", "з": "э", "э": "з", "о": "с", "с": "о", "г": "т", "т": "г",
    "rn": "m", "m": ("rn",), "ri": "n", "ii": "u", "iii": ("ui", "m"), "cl": "d", "d": ("cl",), "vv": "w", "li": "h", "ni": "m", "in": "m", "tn": "m", "ьi": "ы", "нi": "ы", "ui": ("iii",), "nn": "m", "u1": ("ui",),
}
# Chinese characters and what each is read as (fixed values): read -> meant.
CHINESE = {"囹": "图", "曰": "日目", "末": "未", "入": "人", "任": "在", "贝": "页", "肉": "内", "工": "二", "土": "士上", "干": "千", "己": "已", "夭": "天", "大": "太", "田": "由", "兔": "免", "折": "拆", "晴": "睛", "侯": "候", "住": "往", "治": "冶"}
_WORD = re.compile(r"[^\W_㐀-鿿]+(?:[!|@$(¡][^\W_㐀-鿿]+)*")
_HYPHENS = "-‐¬­"
_BROKEN = re.compile(rf"[^\W\d_][{_HYPHENS}][ \t]*\n[ \t]*[^\W\d_]")
_OPEN_END = re.compile(rf"[^\W\d_][{_HYPHENS}]\s*$")
_LINE_BREAK = re.compile(r"([^\W\d_]+)[ \t]*\n[ \t]*([^\W\d_]+)")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_FOLIO = re.compile(rf"^[\W_]*(?:(?:page|seite|s|p|pag|pág|página|pagina|стр|страница|blz|第)[\W_]*)?(?:[\dloi|!]{{1,5}}|{_ROMAN})[\W_]*(?:(?:of|von|de|di|van|из|sur|页[\W_]*共|/)[\W_]*[\dloi|!]{{1,5}}[\W_]*)?(?:页)?[\W_]*$", re.I)
_NUMBERISH = re.compile(r"^(?=.*\d)(?=.*[lOoI])[\dlOoI]+$")
_NO_TEXT = {"image", "image_ref", "equation"}
_CLOSE, _PAUSE, _DASHES = frozenset(".!?。！？"), frozenset(".!?。！？:："), frozenset("-–•*")
_KEY_WORD, _NO_KEY, _LONG_NUMBER = re.compile(r"[^\W_]+(?:[!|@$][^\W_]+)*"), re.compile(rf"[\dlo]+|{_ROMAN}"), re.compile(r"\d{2,}")
#: What a number or Roman number without other letters than ASCII's begins and ends with.
_NO_KEY_EDGE = frozenset("ivxlcdmo0123456789")


def folio(text: str) -> bool:
    return len(text) <= 40 and bool(_FOLIO.match(text.strip()))


_FOLD = str.maketrans({"0": "o", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "9": "g", "c": "e", "t": "f", "@": "a", "6": "b", "h": "b", "3": "з", "э": "з", "q": "g", "u": "n", "п": "и", "н": "и", "л": "и", "й": "и", "ё": "е", "ц": "и", "щ": "ш", "$": "s", "8": "b", "4": "a", "o": "a", "ç": "g", **{k: v[0] for k, v in CHINESE.items()}})
_FOLDED = {chr(k): v for k, v in _FOLD.items()}.get  # for text beyond ASCII it is faster than translate
#: Text that ``skeleton``, ``readable`` and ``clean`` leave as it is: of Latin letters, Chinese characters and signs that none of their steps changes.
_SAME = re.compile("[" + re.escape("".join(c for c in map(chr, [10, *range(0x20, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2027), *range(0x3001, 0x3030)]) if skeleton(c) == c and not combining(c))) + "㐀-䶵一-龥]*")
_PAIRS = (("rn", "m"), ("iii", "ui"), ("ii", "u"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ьi", "ы"))


def line_key(line: str) -> str:
    """What stays of a line apart from numbers, case and misreading; empty where nothing does."""
    t = skeleton(line).lower() if not line.isascii() and not _SAME.fullmatch(line) else line.lower()
    words = [w for w in _KEY_WORD.findall(t) if (w[0] not in _NO_KEY_EDGE or w[-1] not in _NO_KEY_EDGE) and w.isascii() or not _NO_KEY.fullmatch(w)]
    t = "".join(words)
    for a, b in _PAIRS:
        t = t.replace(a, b)
    t = _LONG_NUMBER.sub("", t)
    t = t.translate(_FOLD) if t.isascii() else "".join(map(_FOLDED, t, t))
    return t if len(t) >= 4 else ""


#: Groups of features of a line: its place, form and recurrence; how it starts and what came before; its block's kind and confidence.
EDGES, FORMS = ("mid", "near", "top", "bottom"), ("closed", "open", "table", "list", "number", "folio", "first-closed", "first-open", "first-table", "first-list")
_NUMBER_FORM, _FOLIO_FORM, _FIRST_FORMS = map(FORMS.index, ("number", "folio", "first-closed"))
STARTS, KINDS = ("lower", "upper", "other"), ("text", "heading", "table", "other")
SIZES = (len(EDGES) * len(FORMS) * 2, 2 * len(STARTS) * 3, len(KINDS) * 4)


def _shape(line: str, pipes: int) -> int:
    """The place in ``FORMS`` of a line's form, by its signs for columns, its first sign and its last."""
    return 2 if pipes > 1 else 3 if line[:1] in _DASHES and line[1:2].isspace() else 0 if line[-1:] in _CLOSE else 1


def page_lines(texts: list, tops: list, kinds: list, confs: list, height) -> tuple[list[int], list[int], list[tuple[int, str]]]:
    """All lines of a page in order: the block of each, its features without recurrence (three a line), and (block, key) of the first lines at an edge:
    in the outer seventh of the page's height or in its first or last two texts."""
    full = [i for i, t in enumerate(texts) if t and t.strip() and kinds[i] not in _NO_TEXT]
    blocks, codes, keys = [], [], []
    before = 2
    for n, i in enumerate(full):
        y = tops[i]
        at = y / height if y is not None and height else None
        outer = n < 2 or n >= len(full) - 2 or at is not None and (at < 0.14 or at > 0.86)
        edge = "mid" if not outer else "top" if n == 0 and (at is None or at < 0.12) or at is not None and at < 0.055 else "bottom" if n == len(full) - 1 and (at is None or at > 0.8) or at is not None and at > 0.93 else "near"
        t = texts[i].strip()
        lines = t.split("\n")
        line = lines[0]
        if folio(t):
            above = texts[full[n - 1]].strip() if n == 1 else ""
            under_header = bool(above) and at is not None and at < 0.2 and len(above) <= 70 and "\n" not in above and above[-1] not in ".。"
            form = _FOLIO_FORM if at is None and n in (0, len(full) - 1) or at is not None and (at < 0.06 or at > 0.9) or under_header else _NUMBER_FORM
        else:
            form = (_FIRST_FORMS if len(lines) > 1 else 0) + _shape(line, t.count("|") if "|" in line else 0)
            if outer and (key := line_key(line)):
                keys.append((i, key))
        c = confs[i] if confs[i] is None or confs[i] > 1 else confs[i] * 100
        block = KINDS.index(kinds[i] if kinds[i] in KINDS else "other") * 4 + (0 if c is None or c != c else 1 if c < 60 else 2 if c < 85 else 3)
        place, opens = EDGES.index(edge) * len(FORMS), len(STARTS)
        for x in lines:
            x = x.strip()
            if not opens:
                form = _shape(x, x.count("|"))
            first = x[:1]
            codes += ((place + form) * 2, (opens + (0 if first.islower() else 1 if first.isupper() else 2)) * 3 + before, block)
            before = 0 if x[-1:] in _PAUSE else 1
            place = opens = 0
        blocks += [i] * len(lines)
    return blocks, codes, keys


class LineModel:
    """A hidden Markov model over all lines of a page: running header, page number, line that opens a paragraph (break), line that goes on (body).

    A line's features come in three groups, independent of each other given its state. Rules only give the first labels; they are then
    estimated anew, so a line is labelled by all its features and its neighbours."""

    STATES = ("body", "break", "header", "number")

    def __init__(self):
        self.start, self.move = np.full(4, -math.log(4)), np.full((4, 4), -math.log(4))
        self.emit = [np.zeros((4, n)) for n in SIZES]

    @staticmethod
    def seed(code: np.ndarray) -> np.ndarray:
        """First labels of lines by (place, form, recurrence) and how they start."""
        place, recurs = code[:, 0] // 2, code[:, 0] % 2
        edge, form = place // len(FORMS), place % len(FORMS)
        first = code[:, 1] // (3 * len(STARTS))
        goes_on = (code[:, 1] // 3 % len(STARTS) == 0) & (code[:, 1] % 3 == 1)
        y = np.where((first == 1) & ~goes_on, 1, 0)
        y[(recurs == 1) & (edge > 0) & np.isin(form, [FORMS.index(f) for f in ("closed", "open", "first-closed", "first-open")])] = 2
        y[form == FORMS.index("folio")] = 3
        return y

    def fit(self, pages: list[np.ndarray], rounds: int = 3) -> "LineModel":
        """``pages`` are (lines, 3) features of each page."""
        pages = [p for p in pages if len(p)]
        if not pages:
            return self
        labels = [self.seed(p) for p in pages]
        for _ in range(rounds):
            y, x = np.concatenate(labels), np.concatenate(pages)
            first = np.cumsum([0, *map(len, pages[:-1])])
            start = np.bincount(y[first], minlength=4) + 1.0
            inner = np.setdiff1d(np.arange(1, len(y)), first)
            move = np.bincount(y[inner - 1] * 4 + y[inner], minlength=16).reshape(4, 4) + 1.0
            self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True))
            for g, n in enumerate(SIZES):
                c = np.bincount(y * n + x[:, g], minlength=4 * n).reshape(4, n) + 0.02
                self.emit[g] = np.log(c / c.sum(axis=1, keepdims=True))
            form = np.arange(SIZES[0]) // 2 % len(FORMS)
            self.emit[0][3, ~np.isin(form, (FORMS.index("folio"), FORMS.index("number")))] = -1e9  # a page number is nothing but one
            labels = self.label(pages)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The best states of each page's lines; pages are decoded side by side."""
        out = [np.zeros(0, np.int64)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            size = np.array([len(pages[i]) for i in part])
            x = np.zeros((len(part), size.max(), 3), np.int64)
            for j, i in enumerate(part):
                x[j, : size[j]] = pages[i]
            e = sum(self.emit[g][:, x[:, :, g]] for g in range(3))  # (state, page, line)
            best, back = self.start[:, None] + e[:, :, 0], np.zeros((x.shape[1], 4, len(part)), np.int8)
            for t in range(1, x.shape[1]):
                s = best[:, None, :] + self.move[:, :, None]
                back[t] = s.argmax(axis=0)
                on = t < size
                best = np.where(on, s.max(axis=0) + e[:, :, t], best)
            y, rows = best.argmax(axis=0), np.arange(len(part))
            path = np.zeros(x.shape[:2], np.int64)
            for t in range(x.shape[1] - 1, -1, -1):
                on = t < size
                path[on, t] = y[on]
                y = np.where(on & (t > 0), back[t][y, rows], y)
            for j, i in enumerate(part):
                out[i] = path[j, : size[j]]
        return out


def tops(boxes: pa.ListArray) -> pa.Array:
    """The upper edge of each box of four numbers, null for others."""
    at = pa.compute.if_else(pa.compute.equal(pa.compute.list_value_length(boxes), 4), pa.compute.add(boxes.offsets[:-1], 1), pa.scalar(None, pa.int32()))
    return boxes.values.take(at)


def page_features(pages: DataFrame) -> DataFrame:
    """One row a page: ``page_id``, ``at`` and ``codes`` (the block and the features of each line, packed), ``recurs`` (its blocks whose first line recurs).

    Recurrence is counted by (job, line, bucket of pages) and a bucket adds its neighbours', so a hot job is spread by its lines and
    buckets and no task holds more of it than that."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, codes, keys = [], [], []
            for h, t, k, y, c in zip(b.column("height").to_pylist(), lists(b.column("text")), lists(b.column("kind")), lists(b.column("bbox"), tops), lists(b.column("conf"))):
                i, v, ks = page_lines(t, y, k, c, h)
                at.append(array("i", i).tobytes())
                codes.append(array("h", v).tobytes())
                keys.append([{"block_index": i, "key": key} for i, key in ks])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("job_id"), b.column("page_index"), pa.array(at, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.struct([("block_index", pa.int32()), ("key", pa.string())])))],
                                             ["page_id", "job_id", "page_index", "at", "codes", "keys"])

    lines = pages.select(F.col("page_id").cast("long"), "job_id", F.col("page_index").cast("int").alias("page_index"), F.col("height").cast("int").alias("height"), "blocks.kind", "blocks.bbox", "blocks.text", "blocks.conf").mapInArrow(
        work, "page_id long, job_id string, page_index int, at binary, codes binary, keys array<struct<block_index int, key string>>")
    lines = stage(lines, "lines")
    each = lines.select("page_id", "job_id", F.floor(F.col("page_index") / BUCKET).alias("bucket"), F.explode("keys").alias("k")).select("page_id", "job_id", "bucket", F.col("k.block_index"), F.col("k.key"))
    once = each.select("job_id", "key", "bucket", "page_id").distinct().groupBy("job_id", "key", "bucket").agg(F.count(F.lit(1)).alias("c"))
    near = once.select("job_id", "key", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), "c").groupBy("job_id", "key", "bucket").agg(F.sum("c").alias("c"))
    often = each.join(near.filter(F.col("c") >= RECURS).select("job_id", "key", "bucket"), ["job_id", "key", "bucket"], "left_semi")
    recurs = often.groupBy("page_id").agg(F.collect_set("block_index").alias("recurs"))
    return stage(lines.select("page_id", "at", "codes").join(recurs, "page_id", "left"), "features")


def _features(at: bytes, codes: bytes, recurs) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and features of a page's lines; recurrence is a block's first line's."""
    blocks, x = np.frombuffer(at, np.int32), np.frombuffer(codes, np.int16).reshape(-1, 3).astype(np.int64)
    if recurs and len(blocks):
        first = np.concatenate([[True], blocks[1:] != blocks[:-1]])
        x[:, 0] += first & np.isin(blocks, recurs)
    return blocks, x


def label_lines(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, noise: bool = False) -> DataFrame:
    """``page_id``, ``block_index``, ``line`` (its place in the block), ``label`` of every line of every page; with ``noise`` every line is labelled
    too, but only headers and page numbers that a block begins with are given. The model is fitted on about ``sample_pages`` pages (a documented bound)."""
    rows = page_features(pages)
    sample = bounded_sample(rows, "page_id", sample_pages)
    model = LineModel().fit([_features(r["at"], r["codes"], r["recurs"])[1] for r in sample])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [_features(*v) for v in zip(b.column("at").to_pylist(), b.column("codes").to_pylist(), b.column("recurs").to_pylist())]
            labels = model.label([x for _, x in got])
            page = np.repeat(np.arange(len(got)), [len(k) for k, _ in got])
            blocks, y = (np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in ([k for k, _ in got], labels))
            opens = np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (page[1:] != page[:-1])])[: len(blocks)]
            line = np.arange(len(blocks)) - np.maximum.accumulate(np.where(opens, np.arange(len(blocks)), 0))
            if noise:
                on = np.flatnonzero(opens & (y >= LineModel.STATES.index("header")))
                page, blocks, line, y = page[on], blocks[on], line[on], y[on]
            yield pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(page)), pa.array(blocks, pa.int32()), pa.array(line, pa.int32()), pa.array(LineModel.STATES).take(pa.array(y))], ["page_id", "block_index", "line", "label"])

    return rows.mapInArrow(work, "page_id long, block_index int, line int, label string")


class Lexicon:
    """Words known from the pages, and the repair of words that are not."""

    def __init__(self, words: Counter, pairs: Counter, least: int):
        self.least = least
        self.words = {w: n for w, n in words.items() if n >= least}
        self.pairs = Counter({p: n for p, n in pairs.items() if n >= 3})
        # a form that is rare beside the word it looks like is its misreading, however often it was counted
        for w in [w for w, n in self.words.items() if len(w) > 2 and any(words.get(c, 0) >= RARE * n for c in self._swaps(w))]:
            del self.words[w]
        self.near: dict[str, str] = {}
        for w, n in self.words.items():
            if len(w) >= 6:
                for i in range(len(w)):
                    d = w[:i] + w[i + 1 :]
                    if d not in self.near or self.words[self.near[d]] < n:
                        self.near[d] = w
        self.memo: dict[str, str | None] = {}
        self.plain = {f(w) for w in self.words if w.isalpha() for f in (str, str.capitalize)}
        self.marks: dict[str, int] = {}

    def repair(self, w: str) -> str | None:
        """The known word an unknown one was misread from, if there is one."""
        low = w.lower()
        if low in self.words:
            return None
        if low not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[low] = self._repair(low)
        return self.memo[low]

    def surely(self, w: str) -> bool:
        """Whether one visual confusion makes an unknown word a frequent one: nouns are misread too where they are capitalised like names."""
        return len(w) > 4 and w not in self.words and any(self.words.get(c, 0) >= 5 * self.least for c in self._swaps(w))

    def mark(self, w: str) -> int:
        """1 if a word is unknown and can be a misread one by itself, whatever stands around it; 2 more if digits and letters like digits meet in it."""
        if len(self.marks) > 300_000:
            self.marks.clear()
        odd = not w.isdigit() and w.lower() not in self.words
        got = self.marks[w] = int(odd and bool(_NUMBERISH.match(w) or self.surely(w.lower()) or self.repair(w))) + 2 * bool(_MAYBE_NUMBER.search(w))
        return got

    def _swaps(self, w: str):
        for i in range(len(w)):
            for k in (3, 2, 1):
                for meant in CONFUSIONS.get(w[i : i + k], ()) if i + k <= len(w) else ():
                    yield w[:i] + meant + w[i + k :]

    def _repair(self, w: str) -> str | None:
        if len(w) < 2 or w.isdigit():
            return None
        best = None
        once = list(self._swaps(w))
        for c in once:
            if c in self.words and (best is None or self.words[c] > self.words[best]):
                best = c
        if best or len(w) < 4:
            return best if best and (len(w) > 2 or not w.isalpha()) else None
        for c in once:
            for d in self._swaps(c):
                if d in self.words and (best is None or self.words[d] > self.words[best]):
                    best = d
        if best is None and len(w) >= 6:
            for i in range(len(w)):
                c = self.near.get(w[:i] + w[i + 1 :])
                if c and abs(len(c) - len(w)) <= 1 and (best is None or self.words[c] > self.words[best]):
                    best = c
            best = best or self.near.get(w)
        return best

    def joined(self, a: str, b: str) -> bool:
        """Whether two pieces are one torn word: together known, and not both known apart."""
        c = (a + b).lower()
        return c in self.words and (a.lower() not in self.words or b.lower() not in self.words) and len(c) >= 4

    def chinese(self, t: str, i: int) -> str | None:
        """The character that the one at ``i`` was misread from, by its neighbours."""
        c = t[i]
        meant = CHINESE.get(c)
        if not meant:
            return None
        p, n = (_class(t[i - 1]) if i else "^"), (_class(t[i + 1]) if i + 1 < len(t) else "^")
        for m in meant:
            for was, now in ((self.pairs[c + n], self.pairs[m + n]), (self.pairs[p + c], self.pairs[p + m])):
                if now >= 10 and now >= 4 * was and self.pairs[p + m] + self.pairs[m + n] > 2 * (self.pairs[p + c] + self.pairs[c + n]):
                    return m
        return None


def _class(c: str) -> str:
    return "0" if c.isdigit() else c


def clean(text: str) -> str:
    """Look-alikes and hidden characters made plain; line ends and hyphens at them stay."""
    if text.isascii() or _SAME.fullmatch(text):
        return text
    if "\xad\n" in text:
        text = text.replace("\xad\n", "¬\n")
    t = readable(text.replace("\n", "\x02\n"))  # readable joins words broken at line ends; the mark keeps them apart
    return t.replace("\x02", "")


def fit_lexicon(pages: DataFrame) -> Lexicon:
    """Known words and Chinese character pairs, counted over all pages. A word is known from one sighting in ``COMMON`` pages on (three at
    least), so the driver gets at most ``COMMON`` times the words of a page, however many pages there are."""
    total = pages.count()
    least = max(3, total // COMMON)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches without white space, and the Chinese texts' pairs, with their counts in a part of the batches."""

        def out() -> pa.RecordBatch:
            found = [(x, n) for c in (stretches, pairs) for x, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array([False] * len(stretches) + [True] * len(pairs)), pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["pair", "s", "n"])

        stretches, pairs = Counter(), Counter()
        for b in slices(batches):
            texts = [t for t in b.column("text").flatten().to_pylist() if t]
            joined = "\n".join(texts)
            stretches.update(joined.split())
            if _HAN.search(joined):
                flat = "\n".join(t.replace("\n", "").lower() for t in texts if not t.isascii() and _HAN.search(t)).translate(_DIGITS)
                pairs.update(map("".join, zip(flat, flat[1:])))
            if len(stretches) + len(pairs) >= WORDS:
                yield out()
                stretches.clear()
                pairs.clear()
        yield out()

    counts = pages.select("blocks.text").mapInArrow(work, "pair boolean, s string, n long").groupBy("pair", "s").agg(F.sum("n").alias("n"))
    words = F.when(F.col("pair"), F.array("s")).otherwise(F.regexp_extract_all(F.lower("s"), F.lit(r"[\p{L}&&[^\p{IsHan}]]+"), F.lit(0)))
    counts = counts.filter(~F.col("pair") | ~F.contains("s", F.lit("\n"))).select("pair", "n", F.explode(words).alias("w")).groupBy("pair", "w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = Counter(), Counter()
    for r in counts.collect():
        got[r["pair"]][r["w"]] = r["n"]
    return Lexicon(*got, least)


_SUSPECT_NUMBER = re.compile(r"(?<![A-Za-z\d])(?=\d*[lOoI])(?=[lOoI]*\d)[\dlOoI]{2,}(?![A-Za-z\d])")
_MAYBE_NUMBER = re.compile(r"\d[lOoI]|[lOoI]\d")
_CHINESE = re.compile(f"[{''.join(CHINESE)}]")
#: Characters of the Chinese script, as Java's ``IsHan`` has them.
_HAN = re.compile("[⺀-⺙⺛-⻳⼀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-舘並-龎\U00016fe2\U00016fe3\U00016ff0\U00016ff1\U00020000-\U000323af]")
_DIGITS = str.maketrans("123456789", "000000000")
_LONE = re.compile(r"[\W_]*[lO]{1,3}[\W_]*")
_SHELF = re.compile(r"[A-Z]\d")
_TRIM = ".,;:!?()\"'“”„«»…"


def _torn_lines(t: str, lex: Lexicon) -> list[int]:
    """The line ends (their places in the text) at which a word is broken without a hyphen."""
    out, at, known = [], 0, lex.words
    lines = t.split("\n")
    for x, y in zip(lines, lines[1:]):
        at += len(x) + 1
        a, b = x.rsplit(None, 1)[-1:], y.split(None, 1)[:1]
        if a and b:
            w, v = a[0].lstrip(_TRIM), b[0].rstrip(_TRIM)
            if (w + v).lower() in known and w.isalpha() and v.isalpha() and lex.joined(w, v):
                out.append(at - 1)
    return out


def _misread_word(t: str, lex: Lexicon, torn: list[int]) -> bool:
    known = lex.words
    words = _WORD.findall(t)
    odd = set(words).difference(lex.plain)
    if not odd:  # no word is unknown
        return False
    get = lex.marks.get
    marks = {m if (m := get(w)) is not None else lex.mark(w) for w in odd}
    if max(marks) > 1 and _SUSPECT_NUMBER.search(t):
        return True
    if marks.isdisjoint((1, 3)) and known.keys().isdisjoint(map(str.lower, map(add, words, words[1:]))):  # nor may two of them be one
        return False
    bare = t.rstrip()
    end, closed, e = len(bare), bare[-1:] in ".!?。！？", 0
    for j, w in enumerate(words):
        was, s = e, t.find(w, e)  # between two matches stands nothing that a word begins with
        e = s + len(w)
        if w not in odd or w.isdigit() or w.lower() in known:
            continue
        joins = j + 1 < len(words) and t.startswith(" ", e) and lex.joined(w, words[j + 1]) and t.startswith(words[j + 1], e + 1) or j and s == was + 1 and t[was] == " " and lex.joined(words[j - 1], w)
        if not joins and not (get(w) or lex.mark(w)) & 1:
            continue
        low = w.lower()
        if _NUMBERISH.match(w):
            if not (s and t[s - 1].isalpha()) and len(w) > 1:
                return True
            continue
        if j == len(words) - 1 and not closed and e >= end - 1:  # the last word of an open text may be cut
            continue
        if s == 0 and low.isalpha() and w[0].islower():  # the rest of a word that began in another block
            continue
        before, behind = t[:s].rstrip(" \t")[-2:], t[e : e + 4].lstrip(" \t")[:2]
        if before[:1] in _HYPHENS and before[1:] == "\n" or behind[:1] in _HYPHENS and behind[1:] == "\n":
            continue
        if any(s <= x <= e + 1 or s - 2 <= x <= s for x in torn):
            continue
        opens = j == 0 or t[max(0, s - 2) : s].strip()[-1:] in (".", "!", "?", ":", "•", "–", "-")
        if w[0].isupper() and w.isalpha() and not (opens or w.isupper()):
            if not lex.surely(low):
                continue  # a name
            return True
        if w.isupper() and any(c.isdigit() for c in w) or _SHELF.match(w):
            continue  # a shelf mark
        if joins:
            return True
        if w[0].isupper() and w.isalpha() and j == 0 and len(words) > 1 and not words[1][:1].islower():
            continue
        if lex.repair(w):
            return True
    return False


def block_noise(text: str, after: str | None, kind: str, lex: Lexicon) -> list[str]:
    """The kinds of noise in a block: hyphenation, misread."""
    t = clean(text)
    torn = _torn_lines(t, lex) if "\n" in t else []
    end = t.rstrip()
    last = end[-1:]
    broken = bool(torn) or "\n" in t and any(h + "\n" in t for h in _HYPHENS) and bool(_BROKEN.search(t)) or last != "" and last in _HYPHENS and bool(_OPEN_END.search(t[-6:])) and (after is None or after[:1].islower())
    if not broken and after and last.isalpha() and after[:1].islower():
        w, v = end.split()[-1].lstrip(_TRIM), after.split()[0].rstrip(_TRIM)
        broken = w.isalpha() and v.isalpha() and w.lower() not in lex.words and lex.joined(w, v)
    out = ["hyphenation"] if broken else []
    if kind == "equation":
        return out
    misread = _misread_word(t, lex, torn)
    if not misread and len(t) <= 40 and _LONE.fullmatch(t) and folio(t):
        misread = True
    if not misread and not t.isascii() and _CHINESE.search(t):
        flat = t.replace("\n", "")
        misread = any(lex.chinese(flat, m.start()) for m in _CHINESE.finditer(flat))
    if misread:
        out.append("misread")
    return out


def word_noise(pages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``page_id``, ``block_index``, ``noise`` (hyphenation, misread) of every block that has some."""
    shared = pages.sparkSession.sparkContext.broadcast(lexicon or fit_lexicon(pages))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in slices(batches):
            rows = []
            for page, texts, kinds in zip(b.column("page_id").to_pylist(), lists(b.column("text")), lists(b.column("kind"))):
                for i, (t, after) in enumerate(zip(texts, _next_texts(texts, kinds))):
                    if t:
                        rows += [(page, i, n) for n in block_noise(t, after, kinds[i] or "", lex)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["page_id", "block_index", "noise"])

    return pages.select(F.col("page_id").cast("long"), "blocks.kind", "blocks.text").mapInArrow(work, "page_id long, block_index int, noise string")


def _next_texts(texts: list, kinds: list) -> list[str | None]:
    """For each block the text that running text goes on with after it, if there is one."""
    out, after = [], None
    for t, kind in zip(reversed(texts), reversed(kinds)):
        out.append(after)
        if t and kind not in _NO_TEXT and kind not in ("header", "table") and not folio(t):
            after = t
    return out[::-1]


def find_noise(pages: DataFrame) -> DataFrame:
    """Each block and kind of noise in it: ``page_id``, ``block_index``, ``noise``.

    Columns used: ``page_id``, ``job_id``, ``page_index``, ``height``, ``blocks`` (``kind``, ``bbox``, ``text``). Pages and blocks without text have no
    noise; a null box counts by the block's place in the page; repeated pages are listed each, but count once as a
    page on which a line recurs. An empty table gives no rows.
    """
    labels = label_lines(pages, noise=True).select("page_id", "block_index", F.when(F.col("label") == "header", "running_header").otherwise("page_number").alias("noise"))
    return labels.unionByName(word_noise(pages)).distinct()


def repaired(text: str, lex: Lexicon) -> str:
    """A block's text on one line: broken words joined, torn and misread words put right."""
    t = clean(text)
    t = re.sub(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*\n[ \t]*(?=[^\W\d_])", "", t)
    t = _LINE_BREAK.sub(lambda m: m[1] + m[2] if lex.joined(m[1], m[2]) else m[0], t)
    t = re.sub(r"(?<=[㐀-鿿，。；：])\n(?=[㐀-鿿，。；：\d])", "", t)
    t = re.sub(r"\s*\n\s*", " ", t) if not re.match(r"\s*[-–•*]\s", t) and "|" not in t else t
    t = re.sub(r"\b([^\W\d_]+) ([^\W\d_]+)\b", lambda m: m[1] + m[2] if lex.joined(m[1], m[2]) else m[0], t)
    t = _SUSPECT_NUMBER.sub(lambda m: m[0].translate(str.maketrans("lIOo", "1100")), t)

    def put_right(m):
        w = m[0]
        if w[0].isupper() and w.isalpha() and not lex.surely(w.lower()) or w.isdigit() or re.match(r"[A-Z]\d", w):
            return w
        r = lex.repair(w)
        return w if not r else r.capitalize() if w[0].isupper() else r

    t = _WORD.sub(put_right, t)
    if any(c in t for c in CHINESE):
        t = "".join(lex.chinese(t, i) or c for i, c in enumerate(t))
    return t


def paragraphs(pages: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Every page as continuous paragraphs: ``page_id``, ``paragraph``, ``first_block``, ``text``; headers and page numbers left out, a new one
    starting where the model labels a line as a break. Pages without text give no row."""
    lex = lexicon or fit_lexicon(pages)
    shared = pages.sparkSession.sparkContext.broadcast(lex)
    labels = label_lines(pages).groupBy("page_id").agg(F.collect_list(F.struct("block_index", "line", "label")).alias("labels"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in slices(batches):
            rows = []
            for page, texts, kinds, labels in zip(b.column("page_id").to_pylist(), lists(b.column("text")), lists(b.column("kind")), b.column("labels").to_pylist()):
                told = {(x["block_index"], x["line"]): x["label"] for x in labels or []}
                done: list[list] = []
                for i, t in enumerate(texts):
                    if not t or not t.strip() or kinds[i] in _NO_TEXT:
                        continue
                    for j, x in enumerate(t.strip().split("\n")):
                        label = told.get((i, j), "break")
                        if label in ("header", "number"):
                            continue
                        if done and (label == "body" or j and "|" in x):
                            done[-1][1] += "\n" + x
                        else:
                            done.append([i, x])
                done = [[i, repaired(x, lex)] for i, x in done]
                rows += [(page, n, i, t) for n, (i, t) in enumerate(done)]
            kinds_ = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds_)], ["page_id", "paragraph", "first_block", "text"])

    joined = pages.select(F.col("page_id").cast("long"), "blocks.kind", "blocks.text").join(labels, "page_id", "left")
    return joined.mapInArrow(work, "page_id long, paragraph int, first_block int, text string")
