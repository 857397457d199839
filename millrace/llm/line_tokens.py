"""The words, marks and sentences of many lines at once, as arrays.

Lines are split at white space, and each piece is looked up in a dictionary of what is known of pieces: its tokens, its form, whether a
sentence ends with it. Only a piece that was not seen before is read in Python; everything else is sums over arrays. Callers bound the
characters they pass together (`ranges`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np

from millrace.llm.cues import ALL_FUNCTION_WORDS, FUNCTION_WORDS
from millrace.llm.residue import LATIN_STEMS

#: Characters that are read together, at least one text; and pieces that are remembered.
TOGETHER, MEMORY = 1_500_000, 400_000
LANGUAGES = list(FUNCTION_WORDS)
#: What stands for a web address in a piece, and for the end of a line between pieces.
ADDRESS, END_OF_LINE = "\ue000", "\ue001"
_ADDRESS_RE = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_NUMBER_RE = re.compile(r"\d+(?:[.,]\d+)*")
_TOKEN_RE = re.compile(r"[^\W\d_]+|\d|[^\w\s]|_")
_SHAPE_RE = re.compile(r"[^\W\d_]+(?:['’.-]*[^\W\d_]+)*")
_CLOSED_RE = re.compile(r"[.!?…][\"'”»)]*$")
_MARKS = ",;|/#:»>"


def tokens_of(piece: str) -> list[str]:
    """The tokens of a text without white space: words, `0` for a number, marks, one mark for a web address."""
    if "://" in piece or "www." in piece or "WWW." in piece:
        piece = _ADDRESS_RE.sub(ADDRESS, piece)
    return _TOKEN_RE.findall(_NUMBER_RE.sub("0", piece.lower()))


def end_of(piece: str) -> str:
    """What the last character of a text counts as: itself, but letters and digits as one each."""
    c = piece[-1:]
    return c if not c.isalnum() else ("0" if c.isdigit() else "a")


def ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER characters each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= TOGETHER:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Known(dict):
    """Numbers of texts, given when they are first asked for."""

    def __init__(self, add) -> None:
        super().__init__()
        self.add = add

    def __missing__(self, key: str) -> int:
        self[key] = n = self.add(key)
        return n


_versions = count()


class Reader:
    """Reads lines, and remembers pieces and tokens. `names` are the tokens by number; a new `version` begins when they are forgotten."""

    #: What is known of a piece, beside its tokens.
    FIELDS = ["size", "words", "functions", *LANGUAGES, "capital", "upper", "lower", "end", "stop", "closed", "marks", "shape", "rest", "begins", "ends", "latin"]

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.version = next(_versions)
        self.tokens = _Known(self._token)
        self.names: list[str] = []
        self.is_word: list[bool] = []
        self.shapes = _Known(lambda _: len(self.shapes))
        self.pieces = _Known(self._piece)
        self._new: list[tuple[int, ...]] = []
        self._flat: list[int] = []
        self._starts: list[int] = [0]
        self.table = np.zeros((0, len(self.FIELDS)), np.int64)
        self.flat, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.word = np.zeros(0, bool)
        self.line_end = self.pieces[END_OF_LINE]

    def _token(self, token: str) -> int:
        self.names.append(token)
        self.is_word.append(token[0].isalnum())
        return len(self.names) - 1

    def _piece(self, piece: str) -> int:
        own = tokens_of(piece)
        self._flat += [self.tokens[t] for t in own]
        self._starts.append(len(self._flat))
        functions = [t for t in own if t in ALL_FUNCTION_WORDS]
        address = "://" in piece or "www." in piece
        shape = re.sub(r"\d+", "0", _SHAPE_RE.sub("w", _ADDRESS_RE.sub("u", piece) if address else piece))
        begins, ends = shape[:1] == "w", shape[-1:] == "w"
        self._new.append((
            len(piece), sum(t[0].isalnum() for t in own), len(functions), *[sum(t in FUNCTION_WORDS[k] for t in functions) for k in LANGUAGES],
            piece[0].isupper(), any(c.isupper() for c in piece), any(c.islower() for c in piece), ord(end_of(piece)[0]), piece[-1] in ".?!", _CLOSED_RE.search(piece) is not None,
            0 if address else sum(piece.count(c) for c in _MARKS), self.shapes[shape], self.shapes[shape[1:]] if begins else self.shapes[shape], begins, ends, any(t[:4] in LATIN_STEMS for t in own if len(t) > 3),
        ))
        return len(self._starts) - 2

    def read(self, lines: list[str]) -> Lines:
        if len(self.pieces) > MEMORY:
            self._forget()
        text = f" {END_OF_LINE} ".join(lines)
        if text.count(END_OF_LINE) != max(len(lines) - 1, 0):  # a text holds the mark itself
            text = f" {END_OF_LINE} ".join(x.replace(END_OF_LINE, " ") for x in lines)
        parts = text.split()
        ids = np.fromiter(map(self.pieces.__getitem__, parts), np.int64, len(parts))
        if self._new:
            self.table = np.concatenate((self.table, np.array(self._new, np.int64).reshape(-1, len(self.FIELDS))))
            self.flat = np.concatenate((self.flat, np.array(self._flat[len(self.flat) :], np.int64)))
            self.starts = np.concatenate((self.starts, np.array(self._starts[len(self.starts) :], np.int64)))
            self.word = np.concatenate((self.word, np.array(self.is_word[len(self.word) :], bool)))
            self._new = []
        return Lines(self, ids, len(lines))


class Lines:
    """What `Reader.read` tells of n lines.

    By piece: line, of(field of Reader.FIELDS). By token: token (its number), at (its line), part (the sentence it is in, counted through all
    lines), is_word (a run of letters or a number). By sentence: closed (whether it ends with its mark), part_line. By line: first and last
    (places among the pieces), count (of pieces).
    """

    def __init__(self, reader: Reader, ids: np.ndarray, n: int) -> None:
        self.reader, self.n = reader, n
        ends = ids == reader.line_end
        self.line, self.pieces = np.cumsum(ends)[~ends], ids[~ends]
        self.count = np.bincount(self.line, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        self.last = self.first + self.count - 1
        self._columns: dict[str, np.ndarray] = {}
        closes = self.of("closed") > 0
        closes[self.last[self.count > 0]] = True
        part = np.cumsum(closes) - closes
        where = np.flatnonzero(closes)
        self.closed, self.part_line = self.of("closed")[where] > 0, self.line[where]
        k = (reader.starts[1:] - reader.starts[:-1])[self.pieces]
        inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        self.token = reader.flat[np.repeat(reader.starts[self.pieces], k) + inner]
        self.at, self.part = np.repeat(self.line, k), np.repeat(part, k)
        self.part_of_piece = part
        self.is_word = reader.word[self.token]

    def of(self, field: str) -> np.ndarray:
        """A field of each piece."""
        if field not in self._columns:
            self._columns[field] = self.reader.table[:, Reader.FIELDS.index(field)][self.pieces]
        return self._columns[field].copy() if field == "closed" else self._columns[field]

    def total(self, field: str) -> np.ndarray:
        """A field summed by line."""
        return np.bincount(self.line, self.of(field), self.n).astype(np.int64)

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each line's shape, and whether it is bare words: words that follow each other are one."""
        after = np.zeros(len(self.pieces), bool)
        after[1:] = (self.of("ends")[:-1] > 0) & (self.line[1:] == self.line[:-1])
        joined = after & (self.of("begins") > 0)
        shape = np.where(joined, self.of("rest"), self.of("shape"))
        kept = shape != self.reader.shapes[""]
        shape, line = shape[kept].astype(np.uint64), self.line[kept]
        size = np.bincount(line, minlength=self.n)
        first = np.cumsum(size) - size
        place = np.arange(len(shape)) - np.repeat(first, size)
        with np.errstate(over="ignore"):
            value = mixed(shape * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        out = np.zeros(self.n, np.uint64)
        if len(value):
            out[size > 0] = np.add.reduceat(value, first[size > 0])
        bare = size == 1
        bare[bare] = shape[first[bare]] == self.reader.shapes["w"]
        return out, bare


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on all of those given."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def counted(groups: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of the different values (numbers below `most`) in each group, and how often each occurs in it."""
    key = np.sort(groups * most + values)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // most, np.diff(np.append(at, len(key)))
