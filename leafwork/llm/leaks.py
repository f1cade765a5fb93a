"""Evaluation texts that leak into training text: a generalised suffix automaton over the normalised test items.

Texts are compared as their folded letters and digits only, so case, punctuation, spacing, line ends, hyphenation and quote marks
do not matter. Every letter of every document is streamed through the automaton of all items, which tracks the longest match that
ends at each place. An item leaks where ``min_words`` consecutive item words (Chinese: ``min_chars`` characters) are repeated with
at most ``max_altered`` of them altered.

Such a stretch has a part of ``min_words`` to twice as many words with no more altered, so it holds an intact run of ``Items.run`` words at
least, even with a page number in it. Runs of that many words are looked up in the items and grown word by word in both
directions, over altered words of any length, and the longest stretch within the limits is taken from what was reached.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_CHARS, MAX_ALTERED = 24, 30, 0.1
#: Items are searched for in sets of at most so many characters: one automaton each, made on the driver and sent as flat arrays (about
#: 100 bytes a character). More sets mean more passes over a batch, never a lost item.
SET_CHARS = 1_000_000
LANES, TEXTS, GRAM = 8192, 2000, 9
#: Parts of documents whose fours are looked up at a time.
PARTS = 2048
BREAK = 1
SCHEMA = "doc_id long, item_id long, words int, matched int, start int, stop int"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ZERO = np.zeros(1, np.int64)
_CJK = re.compile("[㐀-鿿豈-﫿]")
_TABLE: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> folded letter or digit, 0 for everything that does not count; NUL separates texts."""
    global _TABLE
    if _TABLE is None:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x30000):
            c = chr(i)
            if i in range(0xD800, 0xE000):
                continue
            f = unicodedata.normalize("NFKC", c).lower() if i > 127 else c.lower()
            if len(f) == 1 and f.isalnum():
                t[i] = ord(f)
            elif c.isalnum():
                t[i] = i
        t[0] = BREAK
        _TABLE = t
    return _TABLE


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def squeeze(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The folded letters and digits of a text, and where each stood."""
    f = fold_table()[codes(text)]
    at = np.flatnonzero(f)
    return f[at], at


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` codes, by doubling."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, done, power, total = x.astype(np.uint64), 1, _BASE, None
    got = 0
    with np.errstate(over="ignore"):
        while True:
            if k & done:
                total = h[: n] if total is None else total * power + h[got : got + n]
                got += done
            if done * 2 > k:
                return total
            h = h[: len(h) - done] * power + h[done:]
            power = power * power
            done *= 2


class Automaton:
    """Generalised suffix automaton of several strings."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                last = self._add(last, c)

    def _add(self, last: int, c: str) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, q, c)
        new = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, c)
        return new

    def _clone(self, p: int, q: int, c: str) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def maximal(self, text: str, least: int) -> list[tuple[int, int]]:
        """(start, length) of each match of at least ``least`` that cannot be made longer at its end."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        out = []
        for i, c in enumerate(text):
            if c not in nxt[state]:
                if length >= least:
                    out.append((i - length, length))
                while state and c not in nxt[state]:
                    state = link[state]
                    length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            else:
                state = length = 0
        if length >= least:
            out.append((len(text) - length, length))
        return out


class Flat:
    """The automaton as flat arrays: a hash table of its transitions by (state, letter), suffix links and lengths."""

    def __init__(self, a: Automaton, texts: list[str] = (), sizes: tuple[int, ...] = ()):
        self.grams = {}
        for q in {min(GRAM, k) for k in sizes}:
            self.grams[q] = np.zeros(1 << 22, bool)
            for t in texts:
                self.grams[q][(gram_hashes(np.array(list(map(ord, t)), np.uint32), q) >> np.uint64(42)).astype(np.int64)] = True
        letters = sorted({c for n in a.next for c in n})
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.link, self.size = np.array(a.link, np.int32), np.array(a.size, np.int32)
        number = {c: i for i, c in enumerate(letters, 1)}
        key = np.array([s * self.width + number[c] for s, n in enumerate(a.next) for c in n], np.int64)
        goal = np.array([t for n in a.next for t in n.values()], np.int32)
        self.bits = max(10, int(2 * len(key) + 1).bit_length() + 1)
        self.keys, self.goals = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # linear probing, all that still look for a place at once
            free = self.keys[slot[left]] == -1
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.keys[slot[put]], self.goals[slot[put]] = key[put], goal[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The goal of each transition, -1 where there is none."""
        key = state.astype(np.int64) * self.width + letter
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.goals[slot], -1)
        on = np.flatnonzero((got != key) & (got != -1))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[on]]
            hit = got == key[on]
            out[on[hit]] = self.goals[slot[on[hit]]]
            on = on[~hit & (got != -1)]
        return out

    def possible(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Letters that can be in a match of ``least`` letters: those in as many grams of ``GRAM`` (of least letters, if fewer) in a row as such a
        match holds, all of them in the table of the items' grams. It skips nothing that could match."""
        keep = np.zeros(len(x), bool)
        for k in np.unique(least[least < 1 << 30]).tolist():
            q = min(GRAM, k)
            if q not in self.grams or len(x) < k:
                continue
            known = self.grams[q][(gram_hashes(x, q) >> np.uint64(42)).astype(np.int64)]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
            on, off = edge[::2], edge[1::2]
            wide = off - on >= k - q + 1
            mark = np.bincount(on[wide], minlength=len(x) + 1) - np.bincount(off[wide] + q - 1, minlength=len(x) + 1)
            keep |= np.cumsum(mark[:-1]) > 0
        return keep

    def stream(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The places at which a match of ``least`` letters ends. Letters that can be in none are skipped with the automaton at its start again."""
        keep = np.flatnonzero(self.possible(x, least))
        if not len(keep):
            return keep
        gaps = np.flatnonzero(np.diff(keep) > 1) + 1
        letters = np.insert(x[keep], gaps, 0)
        need = np.insert(least[keep], gaps, 1 << 30)
        at = np.insert(keep, gaps, -1)
        return at[np.flatnonzero(self.long_matches(letters, need, int(least[least < 1 << 30].max())))]

    def long_matches(self, x: np.ndarray, least: np.ndarray, warm: int) -> np.ndarray:
        """Whether the longest match that ends at each letter has ``least`` letters. The letters run side by side in lanes, each of
        which begins ``warm`` letters (the largest ``least``) early, so that no lane's start hides a match."""
        n = len(x)
        lanes = max(1, min(LANES, n // (4 * warm + 1)))
        each = -(-n // lanes)
        start = np.arange(lanes) * each
        letters = np.concatenate([np.zeros(warm, np.int32), self.letter[x], np.zeros(lanes * each - n, np.int32)])
        out = np.zeros(lanes * each, bool)
        need = np.concatenate([np.zeros(warm, least.dtype), least, np.zeros(lanes * each - n, least.dtype)])
        state, length, at, begin = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), start, start + warm
        while len(at):  # each lane takes its next letter or a suffix link, whichever its turn is
            c = letters[at]
            goal = self.step(state, c)
            hit = goal >= 0
            taken = hit | (c == 0) | (state == 0)
            link = self.link[state]
            length = np.where(hit, length + 1, np.where(taken, 0, self.size[link]))
            state = np.where(hit, goal, np.where(taken, 0, link))
            told = np.flatnonzero(hit & (length >= need[at]) & (at >= begin))
            out[at[told] - warm] = True
            at = at + taken
            on = at < begin + each
            if not on.all():
                state, length, at, begin = (v[on] for v in (state, length, at, begin))
        return out[:n]


def _fewest(least: int, altered: float) -> int:
    """Words in the longest intact run of a stretch of ``least`` to twice as many words, with a page number in it, at least."""
    return max(1, min(-(-(n - int(n * altered)) // (int(n * altered) + 2)) for n in range(least, 2 * least)))


class Items:
    """Items counted in words, or in characters: their letters, word bounds and an index of the grams that intact runs begin with."""

    def __init__(self, items: list[tuple[int, str]], by_char: bool, least: int, altered: float):
        self.by_char, self.least, self.altered, self.run = by_char, least, altered, _fewest(least, altered)
        self.parts, self.enough = ((4,) if by_char else (16, 9)), min(n - int(n * altered) - 3 * (int(n * altered) + 2) for n in range(least, 2 * least))
        self.ids, self.texts, self.words, self.pieces = [], [], [], {}
        for item_id, text in items:
            x, at = squeeze(text)
            s = "".join(map(chr, x))
            if by_char:
                bounds = [(i, i + 1) for i in range(len(s))]
            else:
                raw = [(m.start(), m.end()) for m in _RAW_WORD.finditer(text)]
                lo, hi = np.searchsorted(at, [a for a, _ in raw]), np.searchsorted(at, [b for _, b in raw])
                bounds = [(int(a), int(b)) for a, b in zip(lo, hi) if b > a]
            if len(bounds) >= least:
                self.ids.append(item_id)
                self.texts.append(s)
                self.words.append(np.array(bounds, np.int64))
        self.k = min((int((w[self.run - 1 :, 1] - w[: len(w) - self.run + 1, 0]).min()) for w in self.words), default=1)
        grams, item, word = [], [], []
        for i, (s, w) in enumerate(zip(self.texts, self.words)):
            h = gram_hashes(np.array(list(map(ord, s)), np.uint32), self.k)
            starts = np.arange(len(w) - self.run + 1)
            grams.append(h[w[starts, 0]])
            item.append(np.full(len(starts), i, np.int64))
            word.append(starts)
        self.size, self.hash, self.short, self.gram = [], [], [], []  # of the runs at each word; of the four words there
        for s, w in zip(self.texts, self.words):
            sums, starts = Sums(np.array(list(map(ord, s)), np.uint32)), np.arange(len(w) - self.run + 1)
            self.size.append(w[starts + self.run - 1, 1] - w[starts, 0])
            self.hash.append(sums.of(w[starts, 0], self.size[-1]))
            four = w[3:, 1] - w[:-3, 0]
            tier = np.searchsorted(-np.array(self.parts), -four)  # the longest part that fits in; none for very few letters
            self.short.append(tier)
            self.gram.append(sums.of(w[:-3, 0], np.array([*self.parts, 0])[tier]))
        self.base, self.four_base = (np.cumsum([0, *map(len, x)]) for x in (self.size, self.gram))
        self.short, gram = np.concatenate([*self.short, np.zeros(0, np.int64)]), np.concatenate([*self.gram, np.zeros(0, np.uint64)])
        self.grams, self.four, self.maybe = [], np.zeros(len(gram), np.int64), []  # the different fours, the number of each word's, and a table to miss by
        for k in range(len(self.parts)):
            mine = self.short == k
            different, self.four[mine] = np.unique(gram[mine], return_inverse=True)
            self.grams.append(different)
            self.maybe.append(np.zeros(1 << 18, bool))
            self.maybe[-1][(different >> np.uint64(46)).astype(np.int64)] = True
        self.size, self.hash = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (self.size, self.hash))
        g = np.concatenate([*grams, np.zeros(0, np.uint64)])
        order = np.argsort(g, kind="stable")
        self.item, self.word = (np.concatenate([*x, np.zeros(0, np.int64)])[order] for x in (item, word))
        self.uniq, self.first = np.unique(g[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(g)))

    def split(self, item: int) -> tuple[list[str], list[str]]:
        """An item's words, and their mirror image."""
        if item not in self.pieces:
            words = [self.texts[item][a:b] for a, b in self.words[item].tolist()]
            self.pieces[item] = words, [x[::-1] for x in words[::-1]]
        return self.pieces[item]

    def could(self, sums: Sums, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether the letters [lo, hi) hold as many fours of item words, among twice ``least`` words around [first, last], as every stretch
        keeps: each altered word and a page number break three of them beside their own. A four counts by its first letters, as many as the largest of ``parts`` that it has, and as there if it has fewer."""
        begin, stop = np.maximum(0, first - 2 * self.least), np.minimum(last + 2 * self.least, np.diff(self.four_base)[item])
        n = np.maximum(0, stop - begin)
        part, edge = np.repeat(np.arange(len(n)), n), np.cumsum(n)
        four = np.arange(len(part)) - (edge - n)[part] + (self.four_base[item] + begin)[part]
        there, size, low = np.ones(len(four), bool), len(sums.total), lo.min()
        for k, letters in enumerate(self.parts):
            mine = np.flatnonzero(self.short[four] == k)
            end = np.maximum(lo, hi - letters + 1)
            wide = end.max() - low + 1
            at = low + np.flatnonzero(np.cumsum(np.bincount(lo - low, minlength=wide) - np.bincount(end - low, minlength=wide)) > 0)
            h = sums.of(at, np.full(len(at), letters))
            at, h = at[near := self.maybe[k][(h >> np.uint64(46)).astype(np.int64)]], h[near]
            j = np.searchsorted(self.grams[k], h)
            j[j == len(self.grams[k])] = 0
            same = self.grams[k][j] == h if len(self.grams[k]) else np.zeros(len(j), bool)
            stands = np.append(np.sort(j[same] * size + at[same]), np.iinfo(np.int64).max)  # by gram, then by place
            want, r = self.four[four[mine]] * size, part[mine]
            there[mine] = stands[np.searchsorted(stands, want + lo[r])] < want + end[r]
        total = np.concatenate([_ZERO, there.cumsum()])
        most = np.zeros(len(n), np.int64)
        if len(four):
            window = total[np.minimum(np.arange(len(four)) + 2 * self.least, edge[part])] - total[:-1]
            most[n > 0] = np.maximum.reduceat(window, (edge - n)[n > 0])
        return most >= self.enough

    def places(self, x: np.ndarray, ends: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letter, item, word) wherever a gram that ends at one of ``ends`` begins a run of an item."""
        none = np.zeros(0, np.int64)
        ends = ends[ends >= self.k - 1]
        if not len(ends) or not len(self.uniq):
            return none, none, none
        begin = ends - self.k + 1
        h = gram_hashes_of(x, begin, self.k)
        j = np.searchsorted(self.uniq, h)
        j[j == len(self.uniq)] = 0
        ok = self.uniq[j] == h
        begin, j = begin[ok], j[ok]
        n = self.count[j]
        rep = np.repeat(np.arange(len(begin)), n)
        row = self.first[j][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        p, item, word = begin[rep], self.item[row], self.word[row]
        at = self.base[item] + word
        whole = p + self.size[at] <= len(x)
        p, item, word, at = p[whole], item[whole], word[whole], at[whole]
        whole = sums.of(p, self.size[at]) == self.hash[at]  # the whole run of words, not its first letters only
        return p[whole], item[whole], word[whole]


class Sums:
    """Hashes of any stretch of letters, equal for equal stretches wherever they stand: sums of letters times powers of an odd number."""

    def __init__(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(x) + 1
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(x.astype(np.uint64) * power[:-1], dtype=np.uint64)])

    def of(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[begin + size] - self.total[begin]) * self.down[begin]


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RAW_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Item words looked for at a time beyond an altered one, those of them that have to be there, and words a text may have more.
AHEAD, AGAIN, MORE = 9, 4, 4


class Letters:
    """A document's letters and the places where its words begin and end, with their mirror image."""

    def __init__(self, doc: str, opens: list[int], closes: list[int]):
        self.doc, self.opens, self.begin, self.end = doc, opens, set(opens), set(closes)
        self.closes, self.back = closes, None

    def mirrored(self) -> Letters:
        if self.back is None:
            n = len(self.doc)
            self.back = Letters(self.doc[::-1], [n - v for v in reversed(self.closes)], [n - v for v in reversed(self.opens)])
        return self.back


def _grow(letters: Letters, words: list[str], at: int, free: bool) -> list[tuple[int, int]]:
    """Where the ``words`` that follow stand in a document from ``at`` on: (word, place) in order. Words that follow on letter by letter are
    taken one by one; beyond an altered word the next ``AHEAD`` are looked for, in order, as whole words."""
    doc, opens, begin, close = letters.doc, letters.opens, letters.begin, letters.end
    out, w, n = [], 0, len(words)
    reach = AHEAD + (2 if free else 1) * MORE
    while w < n:
        while w < n and doc.startswith(words[w], at):
            out.append((w, at))
            at += len(words[w])
            w += 1
        if w == n or at >= len(doc):
            break
        ahead = words[w : w + AHEAD]
        lo = bisect_left(opens, at)
        if lo == len(opens):
            break
        stop = opens[lo + reach] if lo + reach < len(opens) else len(doc)
        best: list[tuple[int, list]] = [(at, [])]  # by how many words were found: the earliest end, and the places
        for k, word in enumerate(ahead):
            size, p = len(word), doc.find(word, at, stop)
            while p >= 0 and not free and not (p in begin and p + size in close):
                p = doc.find(word, p + 1, stop)
            if p < 0:  # then it stands beyond none of the ends
                continue
            first = p
            for m in range(len(best) - 1, -1, -1):
                end, got = best[m]
                if end <= first:
                    p = first
                else:
                    p = doc.find(word, end, stop)
                    while p >= 0 and not free and not (p in begin and p + size in close):
                        p = doc.find(word, p + 1, stop)
                if p >= 0 and (m + 1 == len(best) or p + size < best[m + 1][0]):
                    step = (p + size, [*got, (w + k, p)])
                    if m + 1 == len(best):
                        best.append(step)
                    else:
                        best[m + 1] = step
        end, got = best[-1]
        out += got
        if len(got) < min(AGAIN, len(ahead)):
            break
        w, at = got[-1][0] + 1, end
    return out


def stretch(letters: Letters, items: Items, item: int, places: list[tuple[int, int]]) -> tuple[int, int, int, int] | None:
    """(words, matched, start, stop) of the longest stretch of an item that a document repeats, or None. ``places`` are (letter, item word)
    where runs begin."""
    words, mirrored = items.split(item)
    size, back = len(letters.doc), letters.mirrored()
    done, best = set(), None
    for p, i in places:
        if (p, i) in done:
            continue
        ahead = _grow(letters, words[i:], p, items.by_char)
        done.update((q, i + k) for k, q in ahead)
        behind = _grow(back, mirrored[len(words) - i :], size - p, items.by_char)
        done.update((size - q - len(words[i - 1 - k]), i - 1 - k) for k, q in behind)
        if len(ahead) + len(behind) < items.least * (1 - items.altered):
            continue
        place = {i - 1 - k: size - q - len(words[i - 1 - k]) for k, q in behind} | {i + k: q for k, q in ahead}
        got = _longest(place, words, items.least, items.altered)
        if got and (best is None or got[0] > best[0]):
            best = got
    return best


def _longest(place: dict[int, int], words: list[str], least: int, altered: float) -> tuple[int, int, int, int] | None:
    """The longest window of item words that starts and ends in a word found and in which few enough are not."""
    found = sorted(place)
    if len(found) < least * (1 - altered):
        return None
    # a window over found[a..b] has found[b] - found[a] + 1 words, of which b - a + 1 match: b - a + 1 >= (1 - altered) * words
    worth = [k - (1 - altered) * i for k, i in enumerate(found)]
    best = None
    low: list[int] = []  # places whose worth is below all before them
    for a in range(len(found)):
        if not low or worth[a] < worth[low[-1]]:
            low.append(a)
    b = len(found) - 1
    highest = np.maximum.accumulate(np.array(worth[::-1]))[::-1]
    for a in low:
        lo = np.searchsorted(-highest, -(worth[a] - altered - 1e-9), side="right") - 1  # the last place still worth enough
        b = int(lo)
        if b >= a:
            n, m = found[b] - found[a] + 1, b - a + 1
            if n >= least and (best is None or n > best[0]):
                best = (n, m, place[found[a]], place[found[b]] + len(words[found[b]]))
    return best


class LeakIndex:
    """The items of one set, ready to be searched for in batches of texts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, max_altered: float = MAX_ALTERED):
        cjk = [(i, t) for i, t in items if len(_CJK.findall(t)) * 2 > len(t)]
        ids = {i for i, _ in cjk}
        kinds = Items([x for x in items if x[0] not in ids], False, min_words, max_altered), Items(cjk, True, min_chars, max_altered)
        self.kinds = [k for k in kinds if k.ids]
        texts = [t for k in self.kinds for t in k.texts]
        self.flat = Flat(Automaton(texts), texts, tuple(k.k for k in self.kinds))
        self.by = {k.by_char: k for k in self.kinds}

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(place in ``texts``, item, words, matched, start, stop): start and stop are offsets in the text as stored."""
        if not self.kinds:
            return
        c = codes("\0".join((t or "").replace("\0", " ") for t in texts))
        f = fold_table()[c]
        at = np.flatnonzero(f)
        x = f[at]
        if not len(x):
            return
        cut = np.flatnonzero(x == BREAK)
        doc = np.cumsum(x == BREAK)
        begins, ends = np.concatenate([[0], cut + 1]), np.append(cut, len(x))
        raw = np.concatenate([[0], at[cut] + 1])
        han = (x >= 0x3400) & (x < 0x10000)
        never = np.int32(1 << 30)
        least = np.where(han, *(self.by[k].k if k in self.by else never for k in (True, False))).astype(np.int32)
        long = self.flat.stream(x, least)
        gap = np.diff(at, prepend=-2) > 1
        opens = gap | han | np.concatenate([[True], han[:-1]]) | (x == BREAK)
        sums, nth = Sums(x), np.cumsum(opens)
        best: dict[tuple[int, int], tuple] = {}
        for kind in self.kinds:
            known: tuple = (-1,)
            p, item, word = kind.places(x, long[han[long]] if kind.by_char else long[~han[long]], sums)
            order = np.lexsort((p, item, doc[p]))
            p, item, word = p[order], item[order], word[order]
            pair = doc[p] * len(kind.ids) + item
            # the parts of a pair's places that one stretch can hold
            begin_ = np.concatenate([[0], np.flatnonzero((np.diff(pair) != 0) | (np.diff(nth[p]) > 2 * kind.least + 2 * MORE)) + 1])[: len(p)]
            end_ = np.append(begin_[1:], len(p))[: len(begin_)]
            first, last = (f.reduceat(word, begin_) if len(p) else word for f in (np.minimum, np.maximum))
            if kind.enough > 1:  # a stretch holds two runs at least, or one that is longer by a word
                begin_, end_, first, last = (v[first < last] for v in (begin_, end_, first, last))
            could = np.zeros(len(begin_), bool)
            for k in range(0, len(begin_), PARTS):
                b, e = begin_[k : k + PARTS], end_[k : k + PARTS]
                around = (np.searchsorted(nth, nth[p[v]] + w) for v, w in ((b, -2 * kind.least - 2 * MORE), (e - 1, 2 * kind.least + 2 * MORE)))
                lo, hi = (f(v, of[doc[p[b]]]) for f, v, of in zip((np.maximum, np.minimum), around, (begins, ends)))
                could[k : k + PARTS] = kind.could(sums, lo, hi, item[b], first[k : k + PARTS], last[k : k + PARTS])
            for begin, end in zip(begin_[could].tolist(), end_[could].tolist()):
                part = slice(begin, end)
                d, i = int(doc[p[begin]]), int(item[begin])
                lo, hi = int(begins[d]), int(ends[d])
                if known[0] != d:
                    o = np.flatnonzero(opens[lo:hi]).tolist()
                    known = (d, Letters(x[lo:hi].tobytes().decode("utf-32-le", "surrogatepass"), o, [*o[1:], hi - lo]))
                got = stretch(known[1], kind, i, list(zip((p[part] - lo).tolist(), word[part].tolist())))
                if got and (best.get((d, kind.ids[i])) or (0,))[0] < got[0]:
                    best[d, kind.ids[i]] = got
        for (d, i), (n, m, a, b) in best.items():
            yield d, i, n, m, int(at[begins[d] + a] - raw[d]), int(at[begins[d] + b - 1] - raw[d]) + 1


def gram_hashes_of(x: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """``gram_hashes`` at the given places only."""
    h = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * _BASE + x[begin + i].astype(np.uint64)
    return h


def _sets(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in sets of about ``SET_CHARS`` characters, each fetched by itself."""
    rows = items.filter("length(text) > 0").select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // SET_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for i in range(n):
        yield [(r[0], r[1]) for r in (rows if n == 1 else rows.filter(part == i)).collect()]


def _indexes(spark, items: DataFrame, limits: dict) -> list:
    return [spark.sparkContext.broadcast(LeakIndex(s, **limits)) for s in _sets(items)]


def find_leaks(documents: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """Each document and the items it gives away: ``doc_id``, ``item_id``, words of the stretch, how many match, and where it stands.

    ``documents`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other columns are ignored. Null and empty
    texts leak nothing; items shorter than the limit cannot leak. Items that share a passage all count. Repeated documents give
    repeated rows. An empty item table gives an empty result. Documents are never split or shuffled: one pass over the texts.
    """
    indexes = _indexes(documents.sparkSession, items, limits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                rows = [(ids[d], *rest) for index in indexes for d, *rest in index.value.search(texts)]
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "item_id", "words", "matched", "start", "stop"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, SCHEMA)


def remove_leaks(documents: DataFrame, items: DataFrame, max_coverage: float = 0.5, **limits) -> DataFrame:
    """The documents' ``doc_id`` and ``text`` without the leaked stretches, cut in the pass that finds them; texts with more than
    ``max_coverage`` of their length leaked come out as null. Texts without a leak stay as they are."""
    indexes = _indexes(documents.sparkSession, items, limits)

    def cut(t: str, spans: list[tuple[int, int]]) -> str | None:
        keep, last, gone = [], 0, 0
        for a, b in sorted(spans):
            keep.append(t[last : max(last, a)])
            gone += max(0, b - max(last, a))
            last = max(last, b)
        return None if gone > max_coverage * len(t) else "".join(keep) + t[last:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                texts = part.column("text").to_pylist()
                spans: dict[int, list] = {}
                for index in indexes:
                    for d, _, _, _, start, stop in index.value.search(texts):
                        spans.setdefault(d, []).append((start, stop))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([cut(t, spans[d]) if d in spans else t for d, t in enumerate(texts)], pa.string())], ["doc_id", "text"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, text string")
