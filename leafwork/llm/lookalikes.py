"""One consistent form for texts that look alike: compatibility normalisation, deletion of ignorable characters, and a Viterbi
search over look-alike letters under script-consistent character n-gram scores.

The lattice of a word has, for every letter, the letters drawn exactly alike in other scripts, at no cost, and those that are only
near to it (``NEAR``), which the search takes only where the scripts of the word would otherwise be mixed: a Cyrillic ka is
decoded as Latin k among Latin letters and stays what it is in a Russian word. Among letters drawn exactly alike the choice does
not depend on which one is stored. Blocks look the same where their decoded forms are equal.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.pages import fields, slices, word_counts
from leafwork.shared import stage

SALT_ROWS = 20_000
# Letters of other scripts and the Latin letter each looks like (fixed values).
CYRILLIC = dict(zip("аеорсхуѕіјһԁԛԝАВЕЅІЈКМНОРСТХУҮ", "aeopcxysijhdqwABESIJKMHOPCTXYY"))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ", "oABEZHIKMNOPTYXcj"))
ARMENIAN = dict(zip("օոսհ", "onuh"))
TO_LATIN_LETTERS = {k for d in (CYRILLIC, GREEK, ARMENIAN) for k in d}
TO_LATIN = {ord(k): v for d in (CYRILLIC, GREEK, ARMENIAN) for k, v in d.items()}
_LATIN = {k: v for d in (CYRILLIC, GREEK, ARMENIAN) for k, v in d.items()}.get  # faster than translate beyond ASCII
#: What a Latin-looking letter can be in Cyrillic; rare letters only map to Latin.
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items() if k not in "һԁԛԝҮ"}
TO_GREEK = {v: k for k, v in GREEK.items() if k not in "ϲϳ"}
# Letters that are near to a Latin one but not drawn the same in running text (fixed values).
NEAR = dict(zip("кмтвпгиκντυηιαρωγ", "kmtbnrukvtunjapwy")) | {"ո": "n", "ѵ": "v", "ԍ": "g"}
NEAR |= {k.upper(): v.upper() for k, v in NEAR.items() if k.upper() not in TO_LATIN_LETTERS and len(k.upper()) == 1 and k.upper() != v.upper() and k in "пгκ"}
# Spaces, dashes and line ends that are drawn alike (fixed values).
ALIKE = {"\r\n": "\n", "\r": "\n", " ": "\n", " ": "\n", "\x85": "\n", "­\n": "-\n", "‐": "-", "‑": "-", "−": "-", "\t": " "}
_ALIKE = re.compile("|".join(map(re.escape, sorted(ALIKE, key=len, reverse=True))))
_IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￻\U000e0000-\U000e0fff]")
# Text in which nothing can look like something else but by compatibility normalisation.
_PLAIN = re.compile("[\n -~¡-¬®-ʯ‒-‧　-〿一-鿿！-～]*")
_ODD_ASCII = re.compile("[\r\t]")
_ONLY_LATIN = re.compile("[bdfghklmnqrtuvwzDFGLNQRUVWZ]")
_WORD = re.compile(r"[^\W\d_]+")
# Words that are of no script with look-alikes, whatever they say.
_FAR = re.compile("[　-\uffff]+")
#: What a change of script within a word and the choice of a letter that is only near to the stored one are scored.
_SWITCH, _NEAR = -10.0, -11.0


def skeleton(text: str) -> str:
    """The text with every look-alike letter in Latin, compatibility forms plain and what is not drawn removed."""
    t = _ALIKE.sub(lambda m: ALIKE[m[0]], text)
    t = _IGNORABLE.sub("", t)
    t = _ALIKE.sub(lambda m: ALIKE[m[0]], unicodedata.normalize("NFKD", t))
    return unicodedata.normalize("NFC", "".join(map(_LATIN, t := _IGNORABLE.sub("", t), t)))


def bigrams(words: Iterable[tuple[str, int]]) -> dict[str, Counter]:
    """Counts of the letter pairs of words of one script. Pairs with a letter of the far scripts are never asked for; they count together, as the pair ""."""
    pairs: dict[str, Counter] = {"L": Counter(), "C": Counter(), "G": Counter()}
    for w, n in words:
        kind = script(w)
        if kind in pairs:
            s = f"^{w.lower()}$"
            for a, b in zip(s, s[1:]):
                pairs[kind]["" if a > "⿿" or b > "⿿" else a + b] += n
    return pairs


class Scripts:
    """Character bigram scores of Latin, Cyrillic and Greek words, smoothed; enough to choose among look-alikes."""

    def __init__(self, words: Counter | None = None):
        self.pairs = bigrams((words or {}).items())
        self.total = {k: sum(c.values()) + 1000 for k, c in self.pairs.items()}
        self.memo: dict[tuple[str, str], str] = {}

    def bigram(self, kind: str, a: str, b: str) -> float:
        return math.log((self.pairs[kind][a + b] + 0.5) / self.total[kind])

    def word(self, w: str, around: str) -> str:
        """The best spelling of a skeleton word, given the script of the text around it."""
        key = (w, around)
        got = self.memo.get(key)
        if got is None:
            got = self._viterbi(w, around)
            if len(self.memo) < 500_000:
                self.memo[key] = got
        return got

    def _options(self, c: str) -> list[tuple[str, str]]:
        base = unicodedata.normalize("NFD", c)
        b, marks = base[0], base[1:]
        if "Ѐ" <= b <= "ԯ" or "Ͱ" <= b <= "Ͽ" or b in NEAR:
            own = "C" if "Ѐ" <= b <= "ԯ" else "G" if "Ͱ" <= b <= "Ͽ" else "O"
            return [(own, c)] + ([("N", unicodedata.normalize("NFC", NEAR[b] + marks))] if b in NEAR else [])
        out = [("L", c)] if b.isascii() or "LATIN" in unicodedata.name(b, "") else [("O", c)]
        for kind, table in (("C", TO_CYRILLIC), ("G", TO_GREEK)):
            if b in table:
                out.append((kind, unicodedata.normalize("NFC", table[b] + marks)))
        return out

    def _viterbi(self, w: str, around: str) -> str:
        best = {"^": (0.0, "", "^")}
        for c in w:
            step: dict[str, tuple[float, str, str]] = {}
            for kind, letter in self._options(c):
                low = letter.lower()
                near, kind = (_NEAR, "L") if kind == "N" else (0.0, kind)
                cost = near + (0.0 if kind == around or kind == "O" else -0.5 if kind == "L" else -1.0)
                for was, (score, text, last) in best.items():
                    s = score + cost + (self.bigram(kind, last, low) if kind in self.pairs and (was == kind or was == "^") else -8.0) + (0.0 if was in (kind, "^", "O") or kind == "O" else _SWITCH)
                    if kind not in step or s > step[kind][0]:
                        step[kind] = (s, text + letter, low)
            best = step
        return max(best.values(), key=lambda x: (x[0], x[1]))[1]


@functools.lru_cache(200_000)
def script(w: str) -> str:
    """The script a word must be in by its letters that are drawn like no other script's: L, C, G, M where these differ, or - where none decides."""
    seen = set()
    for c in w:
        b = unicodedata.normalize("NFD", c)[0]
        if "Ѐ" <= b <= "ԯ":
            seen.add("C")
        elif "Ͱ" <= b <= "Ͽ":
            seen.add("G")
        elif b.isascii() and b.isalpha() and b not in TO_CYRILLIC:
            seen.add("L")
    return "-" if not seen else seen.pop() if len(seen) == 1 else "M"


def consistent(text: str, scripts: Scripts) -> str:
    """The one form of a text that looks like this."""
    if text.isascii():
        if not _ODD_ASCII.search(text) and (_ONLY_LATIN.search(text) or not _WORD.search(text)):
            return text
    elif _PLAIN.fullmatch(text) and _ONLY_LATIN.search(text) or not _WORD.search(text):
        return skeleton(text)
    s = skeleton(text)
    words = _WORD.findall(s)
    if not words:
        return s
    kinds = Counter(script(w) for w in words)
    mixed = kinds.pop("M", 0)
    del kinds["-"]
    around = max(sorted(kinds), key=lambda k: kinds[k]) if kinds else "L"
    if around == "L" and len(kinds) <= 1 and not mixed:
        return s
    # in a Latin text the words without a letter of another script are what they are
    return _WORD.sub(lambda m: m[0] if m[0][0] > "⿿" or around == "L" and script(m[0]) in "L-" else scripts.word(m[0], around), s)


def near_words(text: str) -> list[str]:
    """The words of a text that can be of a script with look-alikes."""
    return [w for w in _WORD.findall(unicodedata.normalize("NFC", text)) if not _FAR.fullmatch(w)]


def fit(pages: DataFrame) -> Scripts:
    """Bigram scores from the words of all pages that stand there more than once. Only the counts of letter pairs come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, x, n) for k, c in bigrams(zip(b.column("word").to_pylist(), b.column("n").to_pylist())).items() for x, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "pair", "n"])

    counts = word_counts(pages, near_words).filter("n > 1").mapInArrow(work, "kind string, pair string, n long").groupBy("kind", "pair").agg(F.sum("n").alias("n"))
    scripts = Scripts()
    for r in counts.collect():
        scripts.pairs[r["kind"]][r["pair"]] = r["n"]
    scripts.total = {k: sum(c.values()) + 1000 for k, c in scripts.pairs.items()}
    return scripts


def consistent_text(pages: DataFrame, scripts: Scripts | None = None, keep_text: bool = True) -> DataFrame:
    """``page_id``, ``block_index``, ``look`` and ``stored`` (128-bit digests of the consistent and the stored text) and, if asked for,
    ``text``, the consistent one. Blocks without text (null) are left out, empty texts stay; other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(scripts or fit(pages))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, digest = shared.value, lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        for b in slices(batches):
            out = [[], [], [], [], []]
            for page, texts in zip(b.column("page_id").to_pylist(), fields(b, ["text"])["text"]):
                for i, t in enumerate(texts):
                    if t is None:
                        continue
                    c = consistent(t, s)
                    d = digest(t)
                    for column, v in zip(out, (page, i, d if c is t else digest(c), d, c)):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string()][: 5 if keep_text else 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], ["page_id", "block_index", "look", "stored", "text"][: len(kinds)])

    return pages.select(F.col("page_id").cast("long"), "blocks").mapInArrow(work, "page_id long, block_index int, look binary, stored binary" + (", text string" if keep_text else ""))


def look_alike_classes(pages: DataFrame, scripts: Scripts | None = None) -> DataFrame:
    """Every block whose look is stored in more than one way: ``page_id``, ``block_index``, ``look`` (its class), ``stored``, ``variants`` of the class,
    ``copies`` stored like it, and ``links``, the number of blocks that look the same and are stored differently. Counts are taken over
    (look, stored), reduced before the shuffle, so a hot class is no hot task."""
    rows = stage(consistent_text(pages, scripts, keep_text=False), "looks")
    variants = rows.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("copies"))
    classes = variants.groupBy("look").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("blocks")).filter("variants > 1")
    kept = variants.join(classes, "look").select("look", "stored", "variants", "copies", (F.col("blocks") - F.col("copies")).alias("links"))
    return rows.join(kept, ["look", "stored"])


def look_alike_pairs(pages: DataFrame, scripts: Scripts | None = None) -> DataFrame:
    """Pairs of blocks that look the same and are stored differently: (``page_id_a``, ``block_index_a``, ``page_id_b``, ``block_index_b``).

    The different variants of a look are paired first and then expanded to their blocks, so equal copies of one text never meet and
    no row is made that is not a result. Variants with very many blocks are cut into salts of ``SALT_ROWS`` on both sides.
    """
    rows = stage(look_alike_classes(pages, scripts), "look-classes")
    parts = F.greatest(F.lit(1), F.ceil(F.col("copies") / SALT_ROWS)).cast("int")
    members = rows.select("look", "stored", F.pmod(F.xxhash64("page_id", "block_index"), parts).cast("int").alias("salt"), "page_id", "block_index")
    v = rows.select("look", "stored", parts.alias("parts")).distinct()
    a, b = (v.select("look", *(F.col(c).alias(f"{c}_{x}") for c in ("stored", "parts"))) for x in "ab")
    pairs = a.join(b, "look").filter("stored_a < stored_b")
    for x in "ab":
        salted = pairs.withColumn(f"salt_{x}", F.explode(F.sequence(F.lit(0), F.col(f"parts_{x}") - 1)))
        one = members.select("look", *(F.col(c).alias(f"{c}_{x}") for c in ("stored", "salt", "page_id", "block_index")))
        pairs = salted.join(one, ["look", f"stored_{x}", f"salt_{x}"])
    a, b = (F.struct(F.col(f"page_id_{x}").alias("page_id"), F.col(f"block_index_{x}").alias("block_index")) for x in "ab")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).select(
        F.col("a.page_id").alias("page_id_a"), F.col("a.block_index").alias("block_index_a"), F.col("b.page_id").alias("page_id_b"), F.col("b.block_index").alias("block_index_b"))
