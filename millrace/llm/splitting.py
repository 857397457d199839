"""Splitting oversized texts at natural boundaries (problem 10).

Lexical cohesion: at each sentence end, the words of the sentences before and after it are compared; where the similarity has a
valley, the topic changes. A piece ends at the deepest valley within its size window, or where no sentence ends there, between
lines, words or at last tokens. The next piece starts a fixed number of tokens earlier.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tokens import Encoder, encoder

#: Sentences on each side of a boundary that are compared.
BLOCK = 4
#: A piece ends within the last part of its window: from this share of the limit on.
LEAST_FILL = 0.5
#: Settings tables larger than this are refused, as each row splits the whole corpus.
MOST_LIMITS = 1000


def _boundaries(text: str) -> list[tuple[int, int]]:
    """Places in `text` where it may be cut, with their rank: 3 between paragraphs, 2 after sentences, 1 between lines."""
    import regex

    found: dict[int, int] = {}
    for m in regex.finditer(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*)", text):
        found[m.end()] = 2
    for m in regex.finditer(r"[^\S\n]*(?:\r?\n[^\S\n]*)+", text):
        found[m.start()] = 3 if m.group().count("\n") > 1 else max(1, found.get(m.start(), 0))
    return sorted((k, v) for k, v in found.items() if 0 < k < len(text))


def _depths(text: str, places: list[int]) -> list[float]:
    """The depth of the similarity valley at each place."""
    import regex

    spans = list(zip([0, *places], [*places, len(text)]))
    bags = [Counter(w[:6] for w in regex.findall(r"\p{L}{4,}|[\p{Han}\p{Hiragana}\p{Katakana}]", text[a:b].lower())) for a, b in spans]
    similar = []
    for k in range(1, len(bags)):
        left, right = Counter(), Counter()
        for b in bags[max(0, k - BLOCK) : k]:
            left.update(b)
        for b in bags[k : k + BLOCK]:
            right.update(b)
        norm = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        similar.append(sum(v * right[w] for w, v in left.items()) / norm if norm else 0.0)
    n = len(similar)
    rise = [0.0] * n
    for order, step in ((range(n), -1), (range(n - 1, -1, -1), 1)):  # the nearest peak on either side
        peak = [0.0] * n
        for i in order:
            j = i + step
            peak[i] = max(similar[i], peak[j]) if 0 <= j < n and similar[j] >= similar[i] else similar[i]
        rise = [r + p - s for r, p, s in zip(rise, peak, similar)]
    return rise


def split_text(enc: Encoder, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """Pieces of a text: (first token, token after the last, tokens of the piece's own text, the piece).

    Empty for a text within the limit. Tokens are counted in the whole text's encoding; each piece but the first starts `overlap`
    tokens before the end of the one before, or up to three more where the place would be inside a character. A piece's own
    encoding has at most `limit` tokens.
    """
    raw = text.encode("utf-8")
    if len(raw) <= limit:
        return []
    ids = enc.encode(text)
    n = len(ids)
    if n <= limit:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    at = [0]
    for i in ids:
        at.append(at[-1] + len(enc.words[i]))
    token_at = {b: k for k, b in enumerate(at)}
    whole = lambda k: k == n or raw[at[k]] & 0xC0 != 0x80  # noqa: E731  # at a character's start
    places = [(k, rank) for k, rank in _boundaries(text)]
    bytes_at, done, total = [], 0, 0
    for k, _ in places:
        total += len(text[done:k].encode("utf-8"))
        bytes_at.append(total)
        done = k
    depth = _depths(text, [k for k, _ in places])
    cuts = [(token_at[b], rank, d) for b, (_, rank), d in zip(bytes_at, places, depth) if b in token_at]
    own = lambda a, b: enc.count(raw[at[a] : at[b]].decode("utf-8"))
    out, start, used = [], 0, 0
    while True:
        if n - start <= limit and own(start, n) <= limit:
            out.append((start, n, own(start, n), raw[at[start] :].decode("utf-8")))
            return out
        floor = max(start + overlap + 1, start + int(limit * LEAST_FILL))  # each piece goes on
        while used and cuts[used - 1][0] >= floor:  # a start may move back by a few tokens
            used -= 1
        while used < len(cuts) and cuts[used][0] < floor:
            used += 1
        window = []
        for k in range(used, len(cuts)):
            if cuts[k][0] > start + limit:
                break
            window.append(cuts[k])
        end = 0
        for rank_of in ((2, 3), (1,)):  # the deepest valley; of equal ones that between paragraphs, then the latest
            for place, _, _ in sorted((c for c in window if c[1] in rank_of), key=lambda c: (-round(c[2], 9), -c[1], -c[0])):
                if own(start, place) <= limit:
                    end = place
                    break
            if end:
                break
        if not end:  # between words, else between characters
            low = start + overlap + 1
            words = [k for k in range(min(start + limit, n - 1), max(low, floor) - 1, -1) if raw[at[k] : at[k] + 1].isspace()]
            for k in [*words, *range(min(start + limit, n - 1), low - 1, -1)]:
                if whole(k) and own(start, k) <= limit:
                    end = k
                    break
        if not end:  # no character fits after the overlap: this piece repeats less
            end = next((k for k in range(start + overlap + 1, n + 1) if whole(k)), n)
        out.append((start, end, own(start, end), raw[at[start] : at[end]].decode("utf-8")))
        start = max(end - overlap, start + 1)
        while not whole(start):
            start -= 1


def split_oversized(docs: DataFrame, limits: list[tuple[str, int, int]], key: str = "doc_id", text: str = "text", with_text: bool = True, vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """The pieces of each text that has more tokens than a limit: limit_name, key, piece_no, token_from, token_to, n_tokens, piece.

    `limits`: (name, most tokens, tokens of overlap). Texts within a limit have no rows for it; null, empty and blank ones never
    have. A text of as many bytes as the limit or fewer can't be oversized and isn't encoded. Repeated rows give repeated pieces;
    very long texts and texts without a natural boundary are cut between words or characters; an empty table gives no rows;
    other columns are not read. `with_text=False` leaves piece null. No shuffle.
    """
    if len(limits) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"limit_name string, `{key}` {kind}, piece_no int, token_from int, token_to int, n_tokens int, piece string"
    names = ["limit_name", key, "piece_no", "token_from", "token_to", "n_tokens", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, cols = [], [[] for _ in range(6)]
            for i, t in enumerate(texts):
                for name, most, overlap in limits:
                    for no, (a, b, n, piece) in enumerate(split_text(enc, t, most, overlap), 1):
                        at.append(i)
                        for c, v in zip(cols, (name, no, a, b, n, piece if with_text else None)):
                            c.append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([arrays[0], keys.take(pa.array(at, pa.int64())), *arrays[1:]], names=names)

    if not limits:
        return docs.sparkSession.createDataFrame([], schema)
    large = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_text")).filter(F.octet_length("_text") > min(m for _, m, _ in limits))
    return large.mapInArrow(run, schema)
