"""Encoding of texts with a public byte-level BPE vocabulary.

A BPE encoding is valid exactly if each two neighbouring tokens are: if encoding the two alone gives the two back.
So every prefix of a word has one well-defined last token, and the encoding of the whole follows from the last tokens of
its prefixes.  Distinct words go into a trie; a depth-first walk gives each node its last token from the nodes
above, and words with a common prefix share all the work on it.

Splitting texts into words, finding the distinct ones and laying out the ids are array operations over about a
million characters at a time; Python touches only words not seen before by the worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = 0, 1, 2, 3, 4
_SLICE_CHARS = 1 << 20
_SHORT = 7
#: Words kept by a worker before its trie is started anew; this bounds memory and changes no result.
_KEPT_WORDS = 400_000
#: Fixed values of the vocabulary's word pattern: endings split off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TrieEncoder:
    """Encodes words; keeps a trie whose nodes hold the last token of the prefix they stand for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.words = 0

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE by repeated best merge; used on pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _is_whole(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _are_neighbours(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            known = self._fits[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _last_token(self, word: bytes, end: int, path: list[int]) -> int:
        for size in range(min(self.longest, end), 0, -1):
            token = self.ranks.get(word[end - size : end])
            if token is not None and self._is_whole(token) and (size == end or self._are_neighbours(self.last[path[end - size]], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words; sorted order makes the insertion a depth-first walk of the trie."""
        if self.words > _KEPT_WORDS:
            self.reset()
        done: dict[bytes, list[int]] = {}
        path, before = [0], b""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                below = self.children[path[-1]]
                node = below.get(word[end - 1])
                if node is None:
                    node = below[word[end - 1]] = len(self.last)
                    self.children.append({})
                    self.last.append(self._last_token(word, end, path))
                path.append(node)
            ids, end = [], len(word)
            while end:
                token = self.last[path[end]]
                ids.append(token)
                end -= len(self.bytes_of[token])
            done[word] = ids[::-1]
            before = word
        self.words += len(done)
        return [done[w] for w in words]


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, code in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for found in regex.finditer(pattern, everything):
            a, b = found.span()
            shift = lambda i: i if i < 0xD800 else i + 0x800
            table[shift(a) : shift(b - 1) + 1] = code
    return table


def word_starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words start in texts joined by breaks; a break is a word of its own here.

    A word is a run of letters, of numbers or of other marks, with one blank before it if there is one; an
    apostrophe ending; or white space up to the last character before text.
    """
    n = len(code)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == _BREAK
    blank = code == 0x20
    solid = (kind != _SPACE) & (kind != _BREAK)
    start = edge.copy()
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = blank[:-1]
    start[edge & solid & after_blank] = False
    closing = np.zeros(n, dtype=bool)
    closing[:-1] = (kind[:-1] == _SPACE) & solid[1:]
    start |= closing
    mark = np.flatnonzero((code == 0x27) & edge & ~after_blank)
    mark = mark[mark + 1 < n]
    mark = mark[kind[mark + 1] == _LETTER]
    if len(mark):
        one = code[mark + 1]
        two = np.where(mark + 2 < n, code[np.minimum(mark + 2, n - 1)], 0)
        size = np.zeros(len(mark), dtype=np.int64)
        for ending in _ENDINGS:
            hit = (one == ord(ending[0])) if len(ending) == 1 else (one == ord(ending[0])) & (two == ord(ending[1]))
            size[hit & (size == 0)] = len(ending)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        follow = mark + 1 + size
        inside = follow < n
        follow = follow[inside]
        start[follow[kind[follow] == _LETTER]] = True
    return np.flatnonzero(start)


class CorpusEncoder:
    """Encodes whole columns of texts; one per worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.trie = TrieEncoder(ranks)
        self.forget()

    def forget(self) -> None:
        self.slot_short: dict[int, int] = {}
        self.slot_long: dict[bytes, int] = {}
        self.pool = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)

    def _learn(self, keys: list, words: list[bytes], slots: dict) -> None:
        ids = self.trie.encode_many(words)
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        begin = len(self.pool) + np.cumsum(count) - count
        for i, key in enumerate(keys):
            slots[key] = len(self.begin) + i
        self.pool = np.concatenate([self.pool, np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(count.sum()))])
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])

    def _slots(self, raw: np.ndarray, body: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each word; words of up to seven bytes are looked up as one exact integer."""
        slot = np.empty(len(first), dtype=np.int64)
        short = size <= _SHORT
        at, long_at = np.flatnonzero(short), np.flatnonzero(~short)
        begin, length = first[at], size[at]
        key = length.astype(np.uint64) << np.uint64(56)
        for j in range(_SHORT):
            key |= np.where(j < length, raw[begin + j], 0).astype(np.uint64) << np.uint64(8 * j)
        index, distinct = pd.factorize(key)
        new = [(k, i) for i, k in enumerate(distinct.tolist()) if k not in self.slot_short]
        if new:
            self._learn([k for k, _ in new], [k.to_bytes(8, "little")[: k >> 56] for k, _ in new], self.slot_short)
        slot[at] = np.fromiter(map(self.slot_short.__getitem__, distinct.tolist()), dtype=np.int64, count=len(distinct))[index]
        words = [body[a : a + b] for a, b in zip(first[long_at].tolist(), size[long_at].tolist())]
        unknown = list({w for w in words if w not in self.slot_long})
        if unknown:
            self._learn(unknown, unknown, self.slot_long)
        slot[long_at] = np.fromiter(map(self.slot_long.__getitem__, words), dtype=np.int64, count=len(words))
        return slot

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); an empty text has none."""
        joined = "\0".join(texts) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        breaks = np.cumsum(lengths + 1) - 1
        kind = _classes()[code]
        kind[breaks] = _BREAK
        body = joined.encode()
        raw = np.concatenate([np.frombuffer(body, dtype=np.uint8), np.zeros(_SHORT, dtype=np.uint8)])
        if len(body) == len(code):
            offset = None
        else:
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            offset = np.concatenate([[0], np.cumsum(width)])
        starts = word_starts(code, kind)
        ends = np.append(starts[1:], len(code))
        real = kind[starts] != _BREAK
        starts, ends = starts[real], ends[real]
        first, last = (starts, ends) if offset is None else (offset[starts], offset[ends])
        if len(self.slot_long) + len(self.slot_short) > _KEPT_WORDS:
            self.forget()
        slot = self._slots(raw, body, first, last - first) if len(starts) else np.zeros(0, dtype=np.int64)
        count = self.count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.begin[slot] - total[:-1], count) + np.arange(total[-1])]
        words_before = np.searchsorted(starts, np.concatenate([[0], breaks + 1]))
        return ids, np.diff(total[words_before])


_ENCODERS: dict[int, CorpusEncoder] = {}


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    Null and empty texts give an empty list; strings of special tokens in a text are ordinary text; repeated rows
    are encoded each; other columns are dropped.  The vocabulary (below a megabyte, whatever the corpus) is read on
    the driver and broadcast.  One narrow stage without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        encoder = _ENCODERS.get(len(ranks))
        if encoder is None:
            encoder = _ENCODERS[len(ranks)] = CorpusEncoder(ranks)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            chars = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            part = chars // _SLICE_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                ids, counts = encoder.encode(texts.slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
