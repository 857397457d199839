"""Encoding of whole corpora with public byte-level BPE vocabularies (problem 8).

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token that occurs in a
piece of text. A piece is encoded by backtracking from the longest match: a token may follow another only if the merges would
leave exactly these two, which is memoised for each pair. As a sequence is what the merges give if and only if every adjacent
pair is, the first sequence found is the exact one, in time linear in the piece.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; None means that of the installed package of public tokenizers.
FOLDER = None
#: The bound of each of the two memories, of pieces and of pairs, in entries; a full one is emptied.
MEMORY = 400_000


def vocabulary_path(name: str, folder: str | None = FOLDER) -> str:
    """The place of a vocabulary file."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def _byte_characters() -> dict[str, int]:
    """The printable characters by which byte-level vocabulary files write bytes: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Exact encoder for the vocabulary `name`, a tokenizers JSON file of a byte-level BPE."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None) -> None:
        import ahocorasick
        import regex

        with open(vocabulary_path(f"{name}.json", folder), encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_characters()
        text = lambda s: "".join(chr(to_byte[c]) for c in s)
        vocab = {text(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t) and not t.startswith("<|")}
        self.words = {i: t for t, i in vocab.items()}
        self.ids = vocab
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[text(a)], vocab[text(b)]] = k
        self.tree = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.tree.add_word(t, (len(t), i))
        self.tree.make_automaton()
        self.pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        # Cutting before white space that follows other text cuts no piece in two.
        self.chunks = regex.compile(r"\s*\S+|\s+")
        self.loose = regex.compile(r"\s ")
        self.pieces: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def _merged(self, ids: list[int]) -> list[int]:
        """What the merges make of these tokens; for two tokens' bytes only, so the length is bounded by the vocabulary."""
        while len(ids) > 1:
            best, at = min(((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(ids, ids[1:]))), default=(1 << 30, 0))
            if best == 1 << 30:
                break
            ids[at : at + 2] = [self.ids[self.words[ids[at]] + self.words[ids[at + 1]]]]
        return ids

    def _compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMORY:
                self.fits.clear()
            known = self._merged([self.ids[c] for c in self.words[a] + self.words[b]]) == [a, b]
            self.fits[a, b] = known
        return known

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece of the pattern, which may be long where a text has no white space.

        Memory is linear in the piece: at each place there is at most one match for each length of a token, and those are bounded by
        the vocabulary. So is time: a place from which no sequence goes on is tried once.
        """
        s = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None and (len(s) == 1 or self._merged_whole(whole, s)):
            return [whole]
        n = len(s)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.tree.iter(s):
            starts[end - size + 1].append((size, i))
        dead = bytearray(n + 1)
        path: list[tuple[int, int, int]] = []  # place, next choice there, token
        at, choice = 0, 0
        for m in starts:
            m.sort(reverse=True)  # the longest first
        while at < n:
            options = starts[at]
            while choice < len(options):
                size, i = options[choice]
                choice += 1
                if not dead[at + size] and (not path or self._compatible(path[-1][2], i)):
                    path.append((at, choice, i))
                    at, choice = at + size, 0
                    break
            else:
                dead[at] = 1  # no exact sequence ends here, whatever came before
                at, choice, _ = path.pop()
        return [i for _, _, i in path]

    def _merged_whole(self, i: int, s: str) -> bool:
        """Whether the merges make this one token of its own bytes; every vocabulary entry that merges reach does."""
        known = self.fits.get((i, -1))
        if known is None:
            known = self.fits[i, -1] = self._merged([self.ids[c] for c in s]) == [i]
        return known

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for p in self.pattern.findall(chunk) for i in self._piece(p)]
        if len(self.pieces) >= MEMORY:
            self.pieces.clear()
        out = self.pieces[chunk] = pa.array(ids, pa.int32()).buffers()[1].to_pybytes()[: 4 * len(ids)] if ids else b""
        return out

    def _split(self, text: str) -> list[str]:
        if self.loose.search(text) or text[:1].isspace():
            return self.chunks.findall(text)
        parts = text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]] if parts[-1] else self.chunks.findall(text)

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers; nothing for an empty or null text."""
        if not text:
            return b""
        get, new = self.pieces.get, self._chunk
        return b"".join([b if (b := get(c)) is not None else new(c) for c in self._split(text)])

    def encode(self, text: str | None) -> list[int]:
        import numpy as np

        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_bytes(text)) // 4


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(name, folder)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """`key` and ids (ARRAY<INT>) of each row of `docs`, without special tokens.

    Null and empty texts have an empty list, as have only these; a blank text has the ids of its white space; strings that look
    like special tokens are ordinary text. Very long texts are encoded whole. Repeated rows and null keys stay as they are; an
    empty table gives an empty table; other columns are not read. No shuffle: each batch of rows is encoded where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(vocabulary, folder)
        for batch in batches:
            coded = [enc.encode_bytes(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(coded) + 1, "<i4")
            np.cumsum([len(b) // 4 for b in coded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens (INT) of each row: the size of its text in tokens, 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            n = [enc.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, f"{fields}, n_tokens int")
