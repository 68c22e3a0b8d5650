"""Personal data in free text: finding it and replacing it with typed placeholders.

A text is cut into blocks of spoken lines (cue numbers, times and markup are stepped over).  The tagger reads every block that
isn't blank, equal ones once.  Blocks become windows of ``WINDOW`` characters that overlap by half; all windows are scored by the bidirectional LSTM, the scores of
overlapping windows are blended by how central a character is, and one CRF decoding over the whole block
decides, so spans across window borders come out once and whole.  Spans are then trimmed to their kind's form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.personal_model import TAGS, Tagger, encode, load, one_thread
from callweave.llm.personal_samples import KINDS, SPELLED

WINDOW = 128
_BATCH = 512
_CENTRAL = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)[:, None]

_SIGNED = re.compile(r"[\w.+-]*[\w+](?:@|©| @ )[\w-]+(?:\.[\w-]+)+")
_BLANKS = re.compile("[ \t\n\r\f\v]+")
_TAG = re.compile(r"</?[A-Za-z][^<>@]*>|\{\\[^{}]*\}")


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of spoken lines; together with cue numbers, times and blank lines they make up the text."""
    out, begin, at = [], -1, 0
    lines = text.split("\n")
    timed = ["-->" in line for line in lines] if "-->" in text else [False] * len(lines)
    timed.append(False)
    for i, line in enumerate(lines):
        if (
            not line
            or timed[i]
            or (timed[i + 1] and line.strip(" \t\ufeff").isdecimal())
            or (line[0] in " \t" and not line.strip(" \t"))
            or (i == 0 and line.strip(" \t\ufeff").startswith("WEBVTT"))
        ):
            if begin >= 0:
                out.append((begin, at))
                begin = -1
        elif begin < 0:
            begin = at
        at += len(line) + 1
    if begin >= 0:
        out.append((begin, len(text)))
    return out


def _clean(piece: str) -> str:
    """A block without markup, each run of blanks one blank."""
    if "<" not in piece and "{" not in piece and "\t" not in piece and "\r" not in piece and "\f" not in piece and "\v" not in piece:
        plain = piece.replace("\n", " ")
        if "  " not in plain:
            return plain.lstrip(" ")
    return _BLANKS.sub(" ", _TAG.sub("", piece) if "<" in piece or "{" in piece else piece).lstrip(" ")


def _places(piece: str) -> list[int]:
    """Where the characters of the cleaned block stand in the block."""
    places, at, blank = [], 0, True
    for tag in [*_TAG.finditer(piece), None]:
        for i in range(at, tag.start() if tag else len(piece)):
            if piece[i] not in " \t\n\r\f\v":
                places.append(i)
                blank = False
            elif not blank:
                places.append(i)
                blank = True
        at = tag.end() if tag else len(piece)
    return places


#: Characters that a byte above ASCII becomes where UTF-8 is read as Latin-1 or Windows-1252.
_BYTE = {chr(b): b for b in range(0x80, 0x100)} | {c: b for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "replace")) != "�"}
_among = lambda low, high: "[" + re.escape("".join(c for c, b in _BYTE.items() if low <= b <= high)) + "]"
_MISREAD = re.compile(f"{_among(0xC2, 0xDF)}{_among(0x80, 0xBF)}|{_among(0xE0, 0xEF)}{_among(0x80, 0xBF)}{{2}}|{_among(0xF0, 0xF4)}{_among(0x80, 0xBF)}{{3}}")


def _repair(text: str) -> tuple[str, list[int] | None]:
    """The text with UTF-8 that was read as another encoding undone, also twice, and where each character and the end stand; None if nothing was."""
    starts: list[int] | None = None
    if text.isascii():
        return text, starts
    for _ in range(3):
        pieces, kept, at = [], [], 0
        for found in _MISREAD.finditer(text):
            try:
                char = bytes(_BYTE[c] for c in found.group()).decode()
            except UnicodeDecodeError:
                continue
            if char in "\r\n" or char.isspace() and char != "\u00a0":
                continue
            pieces += [text[at : found.start()], char]
            kept += [*range(at, found.start()), found.start()]
            at = found.end()
        if not pieces:
            break
        kept += range(at, len(text) + 1)
        text = "".join([*pieces, text[at:]])
        starts = kept if starts is None else [starts[k] for k in kept]
    return text, starts


_STRIP = " ,;:!?\"'“”«»¿¡<>[]"
_EDGE = {"email": _STRIP + ".()", "phone": _STRIP + ".-/", "id_number": _STRIP + ".", "address": _STRIP + "().", "name": _STRIP + "()-♪"}
_DIGITISH = frozenset("OoQlI|SBZ")
_MAIL = frozenset("._+-%@©")
#: Articles, possessives and pronouns that are no given names, and prepositions that are no particles of names.
_DETERMINERS = frozenset("der die dem des ein eine einen sie ihr ihre ihren mein meine dein deine sein seine unser unsere kein keine the this that these my your his her our their les une mes tes ses notre nos votre vos leur los las mis tus sus".split())
_PREPOSITIONS = frozenset("in im bis mit ohne für with the of at until without sans avec dans sur con sin para".split())


def _wordy(c: str) -> bool:
    return c.isalnum() or c in "'’\u00ad\u200b�"


def _snap(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """Borders moved out of the middle of words: a cut word is taken whole, a stray small-letter ending is left."""
    mail = _MAIL if kind == "email" else frozenset()
    inside = lambda i: 0 < i < len(text) and all(_wordy(text[k]) or text[k] in mail for k in (i - 1, i))
    while inside(a):
        a -= 1
    if inside(b):
        begin = b
        while begin > a and (_wordy(text[begin - 1]) or text[begin - 1] in mail):
            begin -= 1
        if kind == "name" and text[begin].islower():
            return a, begin
        while inside(b):
            b += 1
    return a, b


_SPELLED = re.compile(rf"(?<!\w)(?:{'|'.join(SPELLED)})(?:(?:[ -]|, ?)(?:{'|'.join(SPELLED)}))+(?!\w)", re.I)


def _spoken(text: str, a: int, b: int) -> tuple[int, int]:
    """A span that holds most of a row of five or more spoken digits begins and ends with that row."""
    for row in _SPELLED.finditer(text):
        shared = min(b, row.end()) - max(a, row.start())
        if 2 * shared > row.end() - row.start() and not any(c.isdigit() for c in text[a:b]) and len(re.findall(r"\w+", row.group())) >= 5:
            return row.span()
    return a, b


def _trim(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span without punctuation around it, or None if it hasn't the least form of its kind."""
    a, b = _snap(kind, text, a, b)
    edge = _EDGE[kind]
    while a < b and text[a] in edge and not (kind == "phone" and text[a] == "("):
        a += 1
    while b > a and text[b - 1] in edge:
        b -= 1
    if b < len(text) and text[b] == ".":
        piece = text[a : b + 1]
        if (kind == "address" and re.search(r"\b(?:St|Rd|Ave|Blvd|Dr|Apt|str|izq|dcha)\.$", piece)) or (kind == "name" and re.search(r",\s+\S+\s[A-Z]\.$", piece)):
            b += 1
    if kind == "phone":
        a, b = _spoken(text, a, b)
    while kind == "name" and (word := text[a:b].partition(" ")[0]) and word.lower() in _DETERMINERS:
        a = min(b, a + len(word) + 1)
    piece = text[a:b]
    if kind == "name" and any(w in _PREPOSITIONS for w in piece.replace(" in 't ", " ").split(" ")[1:]):
        return None
    digits = sum(c.isdigit() or c in _DIGITISH for c in piece)
    digit = any(c.isdigit() for c in piece)
    letters = sum(c.isalpha() for c in piece)
    latin = sum(c.isalpha() and (ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00) for c in piece)
    if kind == "name" and (" " not in piece or sum(c.isdigit() for c in piece) > 4 or len(piece) < 5 or latin < 0.6 * letters):
        return None
    if kind == "name" and not piece.isupper() and any(len(w) > 2 and w.isupper() for w in re.split(r"[\s-]", piece)):  # an acronym is no name
        return None
    given = piece.split(" ", 1)[0]
    if kind == "name" and given.islower() and (given[0] != "l" or len(given) > 5):  # a misread capital I at most
        return None
    if kind == "name" and (sum(any(map(_wordy, w)) for w in piece.split(" ")) < 2 or (piece.islower() and given[1:2] in tuple("aeiou"))):
        return None
    if kind == "address" and (piece.islower() and not digit or not any(c.isdigit() or c in "lIO" for c in piece) or len(piece) < 6):
        return None
    if kind == "id_number" and (digits < 5 or len(piece) < 7):
        return None
    spelled = sum(w.lower() in SPELLED for w in piece.split())
    if kind == "phone" and (len(piece) < 7 or (digits < 6 and spelled < 5) or (letters > digits and spelled < 4)):
        return None
    if kind == "email" and (len(piece) < 8 or not re.search(r"@|©|\bat\b", piece, re.I)):
        return None
    return a, b


def _columns(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols of lines that follow each other, longest first, as (time, line), blanks beyond a line's end."""
    out = np.full((len(lengths), lengths[0]), 32, dtype=np.int64)
    out[np.arange(lengths[0]) < lengths[:, None]] = codes
    return np.ascontiguousarray(out.T)


class Finder:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.tagger = Tagger(weights)
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(begin, end, kind) in each cleaned block; equal blocks are read once, wrongly encoded letters as what they stand for."""
        fresh = [t for t in dict.fromkeys(texts) if t not in self.known]
        if len(self.known) > 200_000:
            self.known.clear()
            fresh = list(dict.fromkeys(texts))
        repaired = sorted(((*_repair(t), t) for t in fresh), key=lambda r: -len(r[0]))
        for a in range(0, len(repaired), _BATCH):
            part = repaired[a : a + _BATCH]
            for (text, at, own), tags in zip(part, self._tags([r[0] for r in part])):
                found = self._read(text, tags) if tags is not None else []
                self.known[own] = found if at is None else [(at[b], at[e], kind) for b, e, kind in found]
        return [self.known[t] for t in texts]

    def _tags(self, texts: list[str]) -> list[np.ndarray | None]:
        """Tags of some texts, longest first; long ones are scored in overlapping windows and decoded whole."""
        step = WINDOW // 2
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = encode("".join(texts))
        if lengths[0] - step <= step:  # each text is one window
            return self.tagger.decode(self.tagger.emissions(_columns(codes, lengths), lengths), lengths)
        begins = np.cumsum(lengths) - lengths
        windows = [(k, at) for k, n in enumerate(lengths.tolist()) for at in range(0, max(1, n - step), step)]
        pieces = [codes[begins[k] + at : begins[k] + min(at + WINDOW, lengths[k])] for k, at in windows]
        order = sorted(range(len(windows)), key=lambda j: -len(pieces[j]))
        sizes = np.fromiter((len(pieces[j]) for j in order), dtype=np.int64, count=len(order))
        blended = np.zeros((lengths[0], len(texts), TAGS), np.float32)
        weight = np.zeros((lengths[0], len(texts), 1), np.float32)
        for a in range(0, len(order), _BATCH):
            part = order[a : a + _BATCH]
            own = sizes[a : a + len(part)]
            scores = self.tagger.emissions(_columns(np.concatenate([pieces[j] for j in part]), own), own)
            for c, j in enumerate(part):
                (k, at), n = windows[j], len(pieces[j])
                blended[at : at + n, k] += scores[:n, c] * _CENTRAL[:n]
                weight[at : at + n, k] += _CENTRAL[:n]
        blended /= np.maximum(weight, 1e-6)
        return self.tagger.decode(blended, lengths)

    def _read(self, text: str, tags: np.ndarray) -> list[tuple[int, int, str]]:
        out, begin, kind = [], -1, 0
        for i, tag in enumerate([*tags.tolist(), 0]):
            now = (tag + 1) // 2
            if begin >= 0 and (now != kind or tag % 2 == 1):
                span = _trim(KINDS[kind - 1], text, begin, i)
                if span:
                    out.append((*span, KINDS[kind - 1]))
                begin = -1
            if now and begin < 0:
                begin, kind = i, now
        # An address sign settles where an address ends, if the tagger saw any of it.
        for found in _SIGNED.finditer(text):
            a, b = found.span()
            if any(x < b and y > a for x, y, _ in out):
                out = [s for s in out if s[1] <= a or s[0] >= b] + [(a, b, "email")]
        return sorted(out)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str, str]]]:
        """For each text (begin, end, kind, passage), in order; offsets are those of the text as it stands."""
        jobs, cleaned = [], []
        for k, text in enumerate(texts):
            if "\r" in text:
                text = text.replace("\r\n", " \n").replace("\r", "\n")
            for a, b in blocks(text):
                clean = _clean(text[a:b])
                if clean.strip():
                    jobs.append((k, a, text[a:b]))
                    cleaned.append(clean)
        out: list[list[tuple[int, int, str, str]]] = [[] for _ in texts]
        for (k, base, piece), clean, spans in zip(jobs, cleaned, self.spans(cleaned)):
            places = _places(piece) if spans else []
            for a, b, kind in spans:
                out[k].append((base + places[a], base + places[b - 1] + 1, kind, clean[a:b]))
        return out


_FINDERS: list[Finder] = []


def _finder(weights: dict[str, np.ndarray]) -> Finder:
    if not _FINDERS:
        one_thread()
        _FINDERS.append(Finder(weights))
    return _FINDERS[0]


def _scan(documents: DataFrame, ident: str, text: str, build, schema: str) -> DataFrame:
    weights = documents.sparkSession.sparkContext.broadcast(load())  # some tens of kilobytes, whatever the corpus
    source = documents.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _finder(weights.value)
        for frame in frames:
            for a in range(0, len(frame), 2000):
                part = frame.iloc[a : a + 2000]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                yield build(part, texts, finder.find(texts))

    return source.mapInPandas(run, schema)


def personal_spans(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct personal data of each document: (doc_id, kind, match_text), blanks in a passage written as one.

    Null, empty and blank texts have none; repeated rows come out once per id and task; texts are read whole, however long;
    other columns are ignored.  One narrow stage.
    """

    def build(part: pd.DataFrame, texts: list[str], found: list) -> pd.DataFrame:
        rows = dict.fromkeys((int(d), kind, piece) for d, spans in zip(part["doc_id"], found) for _, _, kind, piece in spans)
        return pd.DataFrame(list(rows), columns=["doc_id", "kind", "match_text"])

    return _scan(documents, ident, text, build, "doc_id bigint, kind string, match_text string")


def redacted(documents: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced): every passage replaced by its kind in angle brackets; null stays null."""

    def build(part: pd.DataFrame, texts: list[str], found: list) -> pd.DataFrame:
        out = []
        for whole, original, spans in zip(texts, part["text"], found):
            pieces, at = [], 0
            for a, b, kind, _ in sorted(spans):
                if a >= at:
                    pieces += [whole[at:a], f"<{kind.upper()}>"]
                    at = b
            out.append("".join([*pieces, whole[at:]]) if isinstance(original, str) else None)
        return pd.DataFrame({"doc_id": part["doc_id"], "text": out, "n_replaced": [len(s) for s in found]})

    return _scan(documents, ident, text, build, "doc_id bigint, text string, n_replaced int")
