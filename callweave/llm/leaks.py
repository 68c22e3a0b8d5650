"""Evaluation passages inside corpus documents, by greedy string tiling over words.

Documents and items become sequences of word ids.  A document's word gets the id of the item word that it is, or was
before damage: letter case, marks, look-alike letters, wrong encodings, misread letters and small edits are undone
against the items' own vocabulary, once per distinct word; all ids that it may have count alike, since
a damaged word may happen to spell another one.  Every window of ``LEAST``
document words has an anchor, the word with the fewest places in the items under any of its ids.  A run that covers
the window goes through a place of its anchor, so the anchors' places, followed to both sides, give all runs.
From these, tiles are marked longest first, none overlapping another in document or item, until none of ``LEAST``
words is left.  Coverage is the share of the item's words under tiles, whatever their order.

The items are the small side: they are split into blocks of bounded size, one block is broadcast at a time, and every
document is read whole against each block.  Documents are never shuffled or gathered.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Characters of item text in one broadcast block.
BLOCK_CHARS = 8_000_000
#: Places of anchors that are followed at a time.
_PLACES = 1_000_000

#: Times, with the cue number before them; with blank lines between, only if one is before the number too.
_CUE = re.compile(
    r"^(?:[ \t]*\ufeff?[ \t]*\d+[ \t]*\n|(?:\A|(?<=\n\n))[ \t]*\ufeff?[ \t]*\d+[ \t]*\n(?:[ \t]*\n)+)?[^\n]*-->[^\n]*$|^\ufeff?WEBVTT[^\n]*$",
    re.M,
)
_NOT_SPOKEN = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\n]*(?:\n[^\[\]\n]+)*\]|\([^()\n]*(?:\n[^()\n]+)*\)")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍‎‏⁠﻿᠎"))
#: Letters of other scripts that look like Latin letters.
_LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһӏкмтнвгпαορνικτεηυχ", "aeopcyxijsdhlkmthbrnaopviktenux")
_EXTRA = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i", "ł": "l"})
#: What character recognition confuses; both sides are folded to the right-hand form.
_FOLD_PAIRS = (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "u"))
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "j": "l", "|": "l", "!": "l", "8": "b", "5": "s", "9": "g", "6": "b", "e": "c", "f": "t", "h": "b"})
_WILD = "�?"
#: Letters from which on a word may have two edits beyond misreadings; shorter ones may have one.
TWO_EDITS = 6
_CYRILLIC = re.compile("[Ѐ-ӿ]")


def spoken_words(text: str) -> list[str]:
    """The words of a text without cue numbers, times, markup and bracketed descriptions."""
    return _NOT_SPOKEN.sub(" ", _CUE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))).split()


def _plain(word: str) -> str:
    """Lower case without marks, invisible characters and punctuation; unreadable characters become ``?``."""
    word = unicodedata.normalize("NFKC", word.translate(_INVISIBLE)).casefold().translate(_EXTRA)
    word = unicodedata.normalize("NFKD", word).translate(_LOOK_ALIKE)
    return "".join(c if c.isalnum() else "?" for c in word if (c.isalnum() or c in _WILD) and not unicodedata.combining(c))


def _sloppy(word: str, coding: str) -> bytes | None:
    out = bytearray()
    for c in word:
        try:
            out += c.encode(coding)
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def _decodings(word: str) -> list[str]:
    """What a word may have been before it was read in a wrong encoding."""
    found = []
    if not word.isascii():
        once = word
        for _ in range(3):
            raw = _sloppy(once, "cp1252")
            if raw is None:
                break
            try:
                once = raw.decode("utf-8")
            except UnicodeDecodeError:
                once = raw.decode("utf-8", "replace")
                found.append(once)
                break
            found.append(once)
        if _CYRILLIC.search(word):
            raw = _sloppy(word, "cp1251")
            if raw is not None:
                found.append(raw.decode("cp1252", "replace"))
    return found


def _folded(plain: str) -> str:
    for pair, one in _FOLD_PAIRS:
        plain = plain.replace(pair, one)
    return plain.translate(_FOLD)


def _one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, deleted or replaced; ``?`` in ``a`` equals any letter."""
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < n and i < m and (a[i] == b[i] or a[i] == "?"):
        i += 1
    j = 0
    while j < n - i and j < m - i and (a[n - 1 - j] == b[m - 1 - j] or a[n - 1 - j] == "?"):
        j += 1
    return max(n, m) - i - j <= 1


def _near(a: str, b: str) -> bool:
    """``_one_edit``, or two if both have ``TWO_EDITS`` letters."""
    if min(len(a), len(b)) < TWO_EDITS:
        return _one_edit(a, b)
    i, end = 0, min(len(a), len(b))
    while i < end and (a[i] == b[i] or a[i] == "?"):
        i += 1
    return _one_edit(a[i + 1 :], b[i + 1 :]) or _one_edit(a[i + 1 :], b[i:]) or _one_edit(a[i:], b[i + 1 :])


def _deletions(word: str) -> set[str]:
    one = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return one | {word}


def _shortened(word: str) -> set[str]:
    """The word without as many letters as it may have edits; words that are near have one of these in common."""
    one = _deletions(word)
    return one.union(*map(_deletions, one)) if len(word) >= TWO_EDITS else one


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


class _Lookup:
    """Words near a given one, by their ``_shortened`` forms; by their letters if the given one is long or hard to read."""

    LONG = 30
    LETTERS = 64

    def __init__(self, words: list[str]):
        self.words = words
        forms = [_shortened(w) if len(w) <= self.LONG + 2 else () for w in words]
        keys = np.fromiter((hash(d) for f in forms for d in f), dtype=np.int64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(f) for f in forms])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.counts = np.stack([self._letters(w) for w in words], axis=1) if words else np.zeros((self.LETTERS, 0), np.uint8)
        self.sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))

    def _letters(self, word: str) -> np.ndarray:
        """How often letters occur, those with the same rest by ``LETTERS`` counted together."""
        codes = np.fromiter((ord(c) for c in word if c != "?"), dtype=np.int64)
        return np.minimum(np.bincount(codes % self.LETTERS, minlength=self.LETTERS), 255).astype(np.uint8)

    def near(self, word: str) -> set[int]:
        if "?" in word or len(word) > self.LONG:
            lost = np.zeros(len(self.words), dtype=np.int64)
            own = self._letters(word)
            for c in np.flatnonzero(own):
                lost += own[c] - np.minimum(self.counts[c], own[c])
            maybe = np.flatnonzero((lost <= 2) & (np.abs(self.sizes - len(word)) <= 2))
        else:
            look = np.fromiter(map(hash, _shortened(word)), dtype=np.int64)
            low, high = np.searchsorted(self.keys, look), np.searchsorted(self.keys, look, side="right")
            maybe = np.unique(self.owner[_spread(low, high - low)])
        if not word.strip("?"):  # no letter is known, so the length has to be right
            return {i for i in maybe.tolist() if len(word) == len(self.words[i])}
        return {i for i in maybe.tolist() if _near(word, self.words[i])}


class WordIndex:
    """Item words and the document words that may stand for them."""

    def __init__(self, items: list[list[str]]):
        self.id_of: dict[str, int] = {}
        for words in items:
            for w in words:
                self.id_of.setdefault(w, len(self.id_of))
        self.words = list(self.id_of)
        self.plain, self.folded = _Lookup(self.words), _Lookup([_folded(w) for w in self.words])
        self.longest = max(map(len, self.words), default=0)
        self.known: dict[str, tuple[int, ...]] = {}

    def ids(self, raw: str) -> tuple[int, ...]:
        """All ids the word may have, that of an equal word first; () if none; (-1,) if it is no word at all."""
        found = self.known.get(raw)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[raw] = self._resolve(raw)
        return found

    def _resolve(self, raw: str) -> tuple[int, ...]:
        tries = [_plain(x) for x in (raw, *_decodings(raw))]
        tries = [t.strip("?") if i == 0 else t for i, t in enumerate(tries)] + [tries[0]]
        if not any(c.isalnum() for c in tries[0]) and not any(len(t) > 2 for t in tries):
            return (-1,) if "?" not in tries[-1] or len(raw) < 2 or all(c in "?!.,…-" for c in raw) else ()
        tries = [t for t in dict.fromkeys(tries) if t and len(t) <= 2 * self.longest + 4]  # folding at most halves a word
        same = [self.id_of[t] for t in tries if t in self.id_of]
        near: set[int] = set()
        for t in tries:
            near |= self.plain.near(t) | self.folded.near(_folded(t))
        return tuple(dict.fromkeys([*same, *sorted(near)]))


def _marked(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles from the maximal runs of one document and item: the longest run is marked, the others lose its words."""
    tiles: list[tuple[int, int, int]] = []
    while runs:
        a, b, size = best = min(runs, key=lambda r: (-r[2], r[0] + r[2], r[1]))
        tiles.append(best)
        left = []
        for i, j, n in runs:
            at = 0
            for begin, end in [*sorted([(a - i, a - i + size), (b - j, b - j + size)]), (n, n)]:
                if min(begin, n) - at >= least:
                    left.append((i + at, j + at, min(begin, n) - at))
                at = max(at, end)
        runs = left
    return tiles


def greedy_tiles(document: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, words), longest first.

    ``document`` has one row per alternative id of a word.  Runs along the diagonals of the match matrix are the
    maximal matches; the longest is marked and its words leave the matrix until no run reaches ``least``.
    """
    i, j = np.nonzero((document[:, :, None] == item[None, None, :]).any(axis=0))
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i - j, prepend=len(i) + len(document.T) + len(item)) | (np.diff(i, prepend=-2) != 1))
    size = np.diff(first, append=len(i))
    long = size >= least
    return _marked(list(zip(i[first[long]].tolist(), j[first[long]].tolist(), size[long].tolist())), least)


class TileMatcher:
    """Finds the items whose words stand in a document."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.item_ids = [i for i, _ in items]
        words = [[p for p in (_plain(w).strip("?") for w in text.split()) if p] for _, text in items]
        self.index = WordIndex(words)
        self.sizes = [len(ws) for ws in words]
        gap = np.full(1, -2, dtype=np.int64)
        self.flat = np.concatenate([gap, *[x for ws in words for x in (np.asarray([self.index.id_of[w] for w in ws], dtype=np.int64), gap)]])
        self.begin = 1 + np.cumsum([0, *[n + 1 for n in self.sizes]])
        self.places = np.argsort(self.flat, kind="stable")[len(words) + 1 :]
        self.first = np.searchsorted(self.flat[self.places], np.arange(len(self.index.words) + 1))

    def _anchors(self, doc: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The word with the fewest places of each window of ``least`` words, where all have some."""
        n = len(doc) - self.least + 1
        if n < 1:
            return np.zeros(0, dtype=np.int64)
        best = np.lib.stride_tricks.sliding_window_view(places, self.least).argmin(axis=1) + np.arange(n)
        return np.unique(best[(doc[:n] == doc[self.least - 1 :]) & (places[best] > 0)])

    def _runs(self, doc: np.ndarray, word: np.ndarray, keys: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(start in the words, start in ``flat``, words) of the maximal runs through these equal words that are long enough."""
        reach = []
        for step in (-1, 1):
            live, far = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
            k = 0
            while len(live):
                k += step
                live = live[(at[live] + k >= 0) & (at[live] + k < len(doc))]
                next_to = at[live] + k
                live = live[(doc[next_to] == doc[at[live]]) & _equal(keys, word[next_to], self.flat[place[live] + k], len(self.index.words))]
                far[live] = abs(k)
            reach.append(far)
        size = reach[0] + reach[1] + 1
        long = size >= self.least
        return np.stack([at[long] - reach[0][long], place[long] - reach[0][long], size[long]])

    def match(self, documents: list[tuple[int, str]]) -> list[tuple[int, int, int, int, float]]:
        """(document, item, longest tile, tiled words, coverage of the item)."""
        look = self.index.ids
        numbers: dict[tuple[int, ...], int] = {}  # words that may have the same ids are one
        rows, bounds = [], [0]
        for _, text in documents:
            rows += [numbers.setdefault(x, len(numbers)) for x in map(look, spoken_words(text)) if x != (-1,)]
            bounds.append(len(rows))
        if not rows or not self.item_ids:
            return []
        word = np.asarray(rows, dtype=np.int64)
        doc = np.repeat(np.arange(len(documents)), np.diff(bounds))
        many = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
        ids = np.fromiter((i for x in numbers for i in x), dtype=np.int64, count=many.sum())
        of = np.repeat(np.arange(len(numbers)), many)
        keys = np.sort(_key(of, ids, len(self.index.words)))
        begin = np.cumsum(many) - many
        places = np.bincount(of, weights=np.diff(self.first)[ids], minlength=len(numbers)).astype(np.int64)[word]
        anchors = self._anchors(doc, places)
        part = np.cumsum(places[anchors]) // _PLACES
        found = [np.zeros((3, 0), dtype=np.int64)]
        for at in np.split(anchors, np.flatnonzero(np.diff(part)) + 1):
            size = many[word[at]]
            each, at = ids[_spread(begin[word[at]], size)], np.repeat(at, size)
            size = self.first[each + 1] - self.first[each]
            found.append(self._runs(doc, word, keys, np.repeat(at, size), self.places[_spread(self.first[each], size)]))
        runs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        start, place, size = np.unique(np.concatenate(found, axis=1), axis=1)
        owner = np.searchsorted(self.begin, place, side="right") - 1
        for d, i, s, p, n in zip(doc[start].tolist(), owner.tolist(), start.tolist(), (place - self.begin[owner]).tolist(), size.tolist()):
            runs[d, i].append((s - bounds[d], p, n))
        out = []
        for (d, i), mine in sorted(runs.items()):
            tiles = _marked(mine, self.least)
            total = sum(t[2] for t in tiles)
            out.append((documents[d][0], self.item_ids[i], tiles[0][2], total, total / self.sizes[i]))
        return out


def _key(word: np.ndarray, ident: np.ndarray, count: int) -> np.ndarray:
    return word * (count + 2) + ident + 2


def _equal(keys: np.ndarray, word: np.ndarray, ident: np.ndarray, count: int) -> np.ndarray:
    """Whether the words may have the ids; -2 is no word's."""
    key = _key(word, ident, count)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


_MATCHERS: dict[int, TileMatcher] = {}


def _matcher(items: list[tuple[int, str]], least: int) -> TileMatcher:
    """One matcher per worker and block of items; what it learns about words serves later tasks."""
    key = hash((least, *items))
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = TileMatcher(items, least)
    return _MATCHERS[key]


_SCHEMA = "doc_id bigint, item_id bigint, longest int, n_words int, coverage double"


def leaks(documents: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "item_text", least: int = LEAST) -> DataFrame:
    """Documents that contain ``least`` or more consecutive words of an item: one row per (document, item).

    Null, empty and blank texts on either side match nothing; items of fewer words than ``least`` can't match;
    repeated documents come out each under its own id; other columns are ignored.  Documents are read whole.
    """
    spark = documents.sparkSession
    source = items.filter(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("bigint"), F.col(item_text).cast("string"))
    chars = source.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-int(chars) // BLOCK_CHARS))
    texts = documents.select(F.col(ident).cast("bigint"), F.col(text).cast("string")).filter(F.col(text).isNotNull())
    found = None
    for block in range(blocks):
        rows = source.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == block) if blocks > 1 else source
        shared = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in rows.collect()))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = _matcher(shared.value, least)
            for frame in frames:
                for a in range(0, len(frame), 1000):
                    part = frame.iloc[a : a + 1000]
                    hits = matcher.match(list(zip(part.iloc[:, 0].tolist(), part.iloc[:, 1].tolist())))
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id", "longest", "n_words", "coverage"])

        part = texts.mapInPandas(run, _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found
