"""The main body of pages (problem 6): a linear-chain conditional random field over blocks.

The blocks of a page are the leaf blocks of its HTML, or the lines of a content from which the tags are gone; a binary label says
whether one is of the main body. Features are the tags above a block, the words of the whole block and their pairs, its size, marks,
letters and function words, its place, repetitions, and whether the abstract begins with it. The field is fitted by maximum likelihood
to a bounded sample of labelled pages; blocks without a label are summed over. Pages are decoded by Viterbi, without the labels' rules.

Where no labelled pages are given, the sample's are made: a line that recurs on the pages of its site is outside (`Recurring`), and so
is one with a general cue (`cues.label`); sentences of some length and entries of lists are inside; the others have no label.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import cues
from millrace.llm.line_tokens import Lines, Reader, end_of, mixed, tokens_of
from millrace.session import durable
from millrace.sources.lines import site_of
from millrace.sources.tables import newest

#: Pages the field is fitted to, at most, those of one site among them, their characters, and the steps of the fit.
TRAIN_PAGES, SITE_PAGES, TRAIN_CHARS, STEPS = 1500, 40, 50_000, 120
#: Sites from which training pages are drawn, at least, where there are as many.
TRAIN_SITES = 60
#: Features seen in fewer training blocks are left out; the penalty of the weights' squares.
LEAST_SEEN, PENALTY = 2, 0.3
#: A line recurs if it is on so many pages of its site, and on so large a share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2

_is_function = cues.ALL_FUNCTION_WORDS.__contains__
_NAME = re.compile(r"(?<![^\W_])[A-ZÀ-Þ][\w’'-]*(?:\s+(?:(?:of|and|in|the)\s+)?[A-ZÀ-Þ][\w’'-]*)*")

Path = tuple[str, ...]
#: A labelled page: blocks, labels, the abstract, and for each block the tags above it, or no tags.
Labelled = tuple[list[str], list[bool | None], str, list[Path] | None]


def _shape(line: str) -> tuple[tuple[int, str, int, int, int, bool], list[str]]:
    """The form of a block (its size, end, function words, names, sentences, whether it is in capitals), and its tokens."""
    spaced = line.split() or [""]
    text, tokens = " ".join(spaced), [t for w in spaced for t in tokens_of(w)]
    function, caps = sum(map(_is_function, tokens)), len([w for w in spaced if w[:1].isupper()])
    ends = end_of(text)
    stops = text.count(". ") + text.count("? ") + text.count("! ") + (ends in (".", "?", "!", "…"))
    return (min(9, len(text).bit_length()), ends, min(5, 10 * function // len(spaced)), 5 * caps // len(spaced), min(4, stops), text.isupper()), tokens


def _forms(lines: Lines) -> list[np.ndarray]:
    """The forms of many blocks, as `_shape` has them, the end as a code."""
    pieces = np.maximum(lines.count, 1)
    size = lines.total("size") + np.maximum(lines.count - 1, 0)
    end = np.zeros(lines.n, np.int64)
    full = lines.count > 0
    end[full] = lines.of("end")[lines.last[full]]
    stop = lines.total("stop") + (end == ord("…"))  # within, and at the end
    capital = (lines.total("upper") > 0) & (lines.total("lower") == 0)
    return [np.minimum(9, np.ceil(np.log2(size + 1)).astype(np.int64)), end, np.minimum(5, 10 * lines.total("functions") // pieces), 5 * lines.total("capital") // pieces, np.minimum(4, stop), capital.astype(np.int64)]


def _form_features(form: tuple[int, str, int, int, int, bool]) -> list[str]:
    size, ends, function, caps, stops, upper = form
    return ["=bias", f"=n{size}", f"=e{ends}", f"=n{size}e{ends}", f"=f{function}", f"=c{caps}", f"=s{stops}"] + (["=upper"] if upper else [])


def block_features(line: str, path: Path = ()) -> list[str | tuple[str, str]]:
    """The features of a block by itself: its form, words and pairs of words, the tags above it."""
    form, tokens = _shape(line)
    every = [_START, *tokens, _STOP]
    return [*_form_features(form), *path_features(path), *set(tokens), *set(zip(every, every[1:]))]


def path_features(path: Path) -> list[str]:
    """The features of the tags above a block, from the outermost."""
    return [*{f"=in:{t}" for t in path}, f"=leaf:{path[-1]}", f"=leaf:{'>'.join(path[-2:])}"] if path else []


def context_features(i: int, n: int, again: bool, abstract: bool) -> list[str]:
    """The features of a block's place among the n blocks of its page."""
    return [f"=i{min(i, 4)}", f"=j{min(n - 1 - i, 4)}", f"=p{4 * i // n}"] + (["=again"] if again else []) + (["=abstract"] if abstract else [])


def begins(abstract: str, s: str) -> bool:
    """Whether the abstract is a squeezed block, whole or cut off."""
    return len(abstract) >= 3 and (s.startswith(abstract.rstrip("…. ")) if len(abstract) > 20 else s == abstract)


def _may_begin(abstract: str, line: str) -> bool:
    """Whether the first letters of an abstract and a block, not yet squeezed, are the same."""
    return line[:1].lower() == abstract[:1] or (line[:1].isspace() and line.lstrip()[:1].lower() == abstract[:1])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


_START, _STOP = "<s>", "</s>"


class Field:
    """A fitted field: weights of features for the label "main body", and of transitions (from, to)."""

    def __init__(self, weights: dict[str | tuple[str, str], float], moves: list[list[float]]) -> None:
        self.weights, self.moves = weights, moves
        self.forms: dict[tuple, float] = {}  # a few thousand
        words = {w for w in weights if isinstance(w, str) and (w[0] != "=" or w == "=")}
        pairs = [w for w in weights if isinstance(w, tuple)]
        names = sorted(words | {x for p in pairs for x in p} - {_START, _STOP})
        self._numbers = {_START: 1, _STOP: 2} | {w: i for i, w in enumerate(names, 3)}  # 0 is any other token
        self._most = len(self._numbers) + 1
        self._words = np.zeros(self._most)
        for w in words:
            self._words[self._numbers[w]] = weights[w]
        key = np.array([self._numbers[a] * self._most + self._numbers[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self._pairs, self._pair_weights = key[order], np.array([weights[p] for p in pairs], float)[order]
        self._maybe = np.zeros(1 << 18, bool)  # whether a pair may be among them
        self._maybe[mixed(self._pairs.astype(np.uint64)) >> np.uint64(46)] = True
        self._of, self._seen = np.zeros(0, np.int64), -1  # a reader's tokens as numbers here

    def __reduce__(self):
        return Field, (self.weights, self.moves)

    def scores(self, lines: Lines) -> np.ndarray:
        """The weights of each block's own features, summed."""
        out = np.zeros(lines.n)
        if not self.weights or not lines.n:
            return out
        reader = lines.reader
        if self._seen != reader.version:
            self._of, self._seen = np.zeros(0, np.int64), reader.version
        if len(self._of) < len(reader.names):
            self._of = np.concatenate((self._of, np.array([self._numbers.get(t, 0) for t in reader.names[len(self._of) :]], np.int64)))
        own = self._of[lines.token]
        hit = own > 2
        once = _distinct(lines.at[hit] * self._most + own[hit])  # a feature counts once in a block
        out += np.bincount(once // self._most, self._words[once % self._most], lines.n)
        begins = np.ones(len(own), bool)
        begins[1:] = lines.at[1:] != lines.at[:-1]
        stops = np.append(begins[1:], True)[: len(begins)]
        before = np.where(begins, 1, np.concatenate((np.zeros(1, np.int64), own[:-1])) if len(own) else own)
        key = np.concatenate((before * self._most + own, own[stops] * self._most + 2))
        line = np.concatenate((lines.at, lines.at[stops]))
        may = self._maybe[mixed(key.astype(np.uint64)) >> np.uint64(46)]
        key, line = key[may], line[may]
        if len(self._pairs) and len(key):
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            hit = self._pairs[place] == key
            once = _distinct(line[hit] * len(self._pairs) + place[hit])
            out += np.bincount(once // len(self._pairs), self._pair_weights[once % len(self._pairs)], lines.n)
        form = _forms(lines)
        sizes = (10, 1 << 16, 6, 6, 5, 2)
        code = np.zeros(lines.n, np.int64)
        for f, k in zip(form, sizes):
            code = code * k + f
        several, of = np.unique(code, return_inverse=True)
        score = []
        for c in several.tolist():
            if c not in self.forms:
                parts, x = [], c
                for k in sizes[::-1]:
                    x, r = divmod(x, k)
                    parts.append(r)
                size, end, function, caps, stops, upper = parts[::-1]
                self.forms[c] = sum(self.weights.get(f, 0.0) for f in _form_features((size, chr(end), function, caps, stops, bool(upper))))
            score.append(self.forms[c])
        return out + np.array(score)[of]

    def decode(self, lines: list[str], abstract: str = "", paths: list[Path] | None = None, scores: list[float] | None = None) -> list[bool]:
        """The most probable labels of a page's blocks; `abstract` is squeezed; `scores` are of the blocks, where known."""
        if scores is None:
            scores = self.scores(Reader().read([x.replace("\n", " ") for x in lines])).tolist()
        n, w = len(lines), self.weights
        first, last, part = ([w.get(f"={c}{k}", 0.0) for k in range(5)] for c in "ijp")
        again = w.get("=again", 0.0)
        (oo, om), (mo, mm) = self.moves
        out, main, back, seen = 0.0, 0.0, [], set()
        for i, line in enumerate(lines):
            e = scores[i] + (first[i] if i < 4 else first[4]) + (last[n - 1 - i] if n - 1 - i < 4 else last[4]) + part[4 * i // n]
            if paths:
                e += sum(w.get(f, 0.0) for f in path_features(paths[i]))
            if line in seen:
                e += again
            seen.add(line)
            if abstract and _may_begin(abstract, line) and begins(abstract, cues.squeezed(line)):
                e += w.get("=abstract", 0.0)
            if i:
                a, b = out + oo, main + mo
                c, d = out + om, main + mm
                back.append((b > a, d > c))
                out, main = max(a, b), max(c, d) + e
            else:
                main = e
        label = main > out
        labels = [label]
        for from_out, from_main in reversed(back):
            label = from_main if label else from_out
            labels.append(label)
        return labels[::-1] if n else []

    def outside(self, every: list[str], squeezed: str, abstract: str, scores: list[float] | None = None) -> tuple[list[int], bool]:
        """Of a content's lines, the numbers (from 1) of those outside the main body, without empty ones, and whether the abstract is outside."""
        at = [i for i, x in enumerate(every, 1) if x and not x.isspace()]
        lines = [every[i - 1] for i in at]
        labels = self.decode(lines, squeezed, None, None if scores is None else [scores[i - 1] for i in at])
        out = [i for i, b in zip(at, labels) if not b]
        if not squeezed:
            return out, False
        same = [b for x, b in zip(lines, labels) if _may_begin(squeezed, x) and begins(squeezed, cues.squeezed(x))]
        return out, not any(same) if same else not self.decode([abstract])[0]


class Recurring:
    """Which lines of a sample of pages recur on the pages of their site, but for digits.

    A line's pattern, with names and digits left out, is taken for recurring too where a tenth of its lines are: a notice that names
    its site recurs there, and is known by its pattern on a site with few pages.
    """

    def __init__(self, pages: list[tuple[str | None, list[str]]]) -> None:
        self.pages = Counter(s for s, _ in pages)
        self.lines = Counter((s, x) for s, lines in pages for x in {self._plain(line) for line in lines})
        every, recurring = Counter(), Counter()
        for s, lines in pages:
            for line in lines:
                if p := self._pattern(line):
                    every[p] += 1
                    recurring[p] += self._recurs(s, line)
        self.patterns = {p for p, k in recurring.items() if k * 10 >= every[p] and k}

    @staticmethod
    def _plain(line: str) -> str:
        return re.sub(r"\d+", "0", cues.squeezed(line))

    @staticmethod
    def _pattern(line: str) -> str | None:
        s = " ".join(line.split())
        if s.isupper():
            return None
        s = re.sub(r"\d+", "0", _NAME.sub("X", s[:1].lower() + s[1:])).lower()
        return s if len([w for w in s.split() if w != "x" and w.isalpha()]) >= 3 else None

    def _recurs(self, site: str | None, line: str) -> bool:
        k = self.lines[site, self._plain(line)]
        return site is not None and k >= LEAST_PAGES and k >= LEAST_SHARE * self.pages[site]

    def __call__(self, site: str | None, line: str) -> bool:
        return self._recurs(site, line) or self._pattern(line) in self.patterns


def labelled(pages: list[tuple[str | None, str, str | None]]) -> list[Labelled]:
    """Pages (site, content, abstract) labelled by recurrence and general cues."""
    split = [(s, [x for x in c.split("\n") if x.strip()], a) for s, c, a in pages]
    recurs = Recurring([(s, lines) for s, lines, _ in split])
    return [(lines, [cues.label(x, recurs(s, x)) for x in lines], a or "", None) for s, lines, a in split]


def fit(pages: list[Labelled], steps: int = STEPS) -> Field:
    """The field of maximum likelihood for labelled pages, by gradient steps with Adam's step sizes."""
    ids: dict[str | tuple[str, str], int] = {}
    rows: list[array] = []  # numbers of features
    truth: list[int] = []
    lengths = []
    for lines, labels, abstract, paths in pages:
        a = cues.squeezed(abstract)
        seen: set[str] = set()
        for i, line in enumerate(lines):
            own = block_features(line, paths[i] if paths else ()) + context_features(i, len(lines), line in seen, bool(a) and begins(a, cues.squeezed(line)))
            rows.append(array("q", [ids.setdefault(f, len(ids)) for f in own]))
            seen.add(line)
        truth += [-1 if t is None else int(t) for t in labels]
        if lines:
            lengths.append(len(lines))
    if not rows:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    of_name = np.concatenate([np.frombuffer(r, np.int64) for r in rows])
    of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    count = np.bincount(of_name, minlength=len(ids))
    names = [f for f, k in ids.items() if count[k] >= LEAST_SEEN]
    if not names:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]])
    place = np.full(len(ids), -1)
    place[[ids[f] for f in names]] = np.arange(len(names))
    of_name = place[of_name]
    of_row, of_name = of_row[of_name >= 0], of_name[of_name >= 0]
    known = np.array(truth)
    longest, p = max(lengths), len(lengths)
    at = np.full((longest, p), -1, np.int64)
    k = 0
    for q, n in enumerate(lengths):
        at[:n, q] = np.arange(k, k + n)
        k += n
    real = at >= 0
    here = np.concatenate((real, real), axis=1)  # the pages as they may be, and as their labels hold them
    may = np.ones((2, longest, 2 * p))  # whether a block may have a label
    for label in (0, 1):
        may[label][:, p:][real] = known[at[real]] != 1 - label

    def expected(score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """Probabilities of label 1 and of each transition, by forward and backward products that are normalised at each block."""
        high = np.maximum(score, 0)
        e = [np.exp(-high) * may[0], np.exp(score - high) * may[1]]
        step = np.exp(moves - moves.max())
        fore, rear = [np.empty_like(score), np.empty_like(score)], [np.ones_like(score), np.ones_like(score)]
        total = e[0][0] + e[1][0]
        fore[0][0], fore[1][0] = e[0][0] / total, e[1][0] / total
        for i in range(1, longest):
            a, b = ((fore[0][i - 1] * step[0, k] + fore[1][i - 1] * step[1, k]) * e[k][i] for k in (0, 1))
            total = a + b
            fore[0][i], fore[1][i] = np.where(here[i], a / total, fore[0][i - 1]), np.where(here[i], b / total, fore[1][i - 1])
        for i in range(longest - 2, -1, -1):
            x, y = rear[0][i + 1] * e[0][i + 1], rear[1][i + 1] * e[1][i + 1]
            a, b = (step[k, 0] * x + step[k, 1] * y for k in (0, 1))
            total = a + b
            rear[0][i], rear[1][i] = np.where(here[i + 1], a / total, rear[0][i + 1]), np.where(here[i + 1], b / total, rear[1][i + 1])
        ahead = [e[k][1:] * rear[k][1:] for k in (0, 1)]
        pairs = [[fore[j][:-1] * step[j, k] * ahead[k] for k in (0, 1)] for j in (0, 1)]
        total = pairs[0][0] + pairs[0][1] + pairs[1][0] + pairs[1][1]
        both = fore[1] * rear[1]
        return both / (both + fore[0] * rear[0]), [[x / total * here[1:] for x in row] for row in pairs]

    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, steps + 1):
        score = np.bincount(of_row, w[of_name], len(rows))
        own = np.zeros((longest, p))
        own[real] = score[at[real]]
        one, pairs = expected(np.concatenate((own, own), axis=1), moves)
        free, held = one[:, :p], one[:, p:]
        free_pairs, held_pairs = (np.array([[x[:, part].sum() for x in row] for row in pairs]) for part in (slice(0, p), slice(p, None)))
        push = np.zeros(len(rows))
        push[at[real]] = (held - free)[real]
        grad = np.concatenate((np.bincount(of_name, push[of_row], len(names)) - PENALTY * w, (held_pairs - free_pairs).ravel() - PENALTY * moves.ravel()))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    return Field({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, moves.tolist())


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Field:
    """The field fitted to at most `most` pages, drawn by hashes of sites and of page_id: up to SITE_PAGES pages of each drawn site, so that its lines are seen to recur.

    Contents of more than TRAIN_CHARS characters aren't drawn. This bounds what reaches the driver; decoding covers every page.
    """
    own = pages.filter("page_id IS NOT NULL AND content IS NOT NULL").select(F.col("page_id").cast("bigint").alias("page_id"), site_of(F.col("url")).alias("site") if "url" in pages.columns else F.lit(None).cast("string").alias("site"), "content", "abstract")
    n, sites = own.agg(F.count("*"), F.approx_count_distinct(F.coalesce("site", F.lit("")))).first()
    share = min(1.0, max(1.5 * most / max(n, 1), TRAIN_SITES / max(sites, 1)))
    h = F.xxhash64(F.coalesce("site", F.lit("")))
    drawn = own.filter((F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000) + 1) & (F.char_length("content") <= TRAIN_CHARS)).withColumn("_s", h)
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.xxhash64("page_id"), "page_id"))  # each task keeps its first ones only
    some = drawn.withColumn("_k", place).filter(F.col("_k") <= SITE_PAGES).orderBy("_s", "_k").limit(most).collect()
    return fit(labelled(sorted({(r["site"], r["content"], r["abstract"]) for r in some}, key=lambda x: (x[0] or "", x[1], x[2] or ""))))


def outside_rows(scan: DataFrame) -> DataFrame:
    """page_id, field, line_no of what is outside the main body; `scan` is a durable table of `page_scan.scan_pages` with a field."""
    from millrace.llm.page_scan import newest_scan

    one = newest_scan(scan, ["outside", "abstract"])
    content = F.transform("outside", lambda i: F.struct(F.lit("content").alias("field"), i.alias("line_no")))
    abstract = F.when(F.col("abstract"), F.array(F.struct(F.lit("abstract").alias("field"), F.lit(1).alias("line_no")))).otherwise(F.array().cast("array<struct<field:string,line_no:int>>"))
    return one.select("page_id", F.explode(F.concat(content, abstract)).alias("x")).select("page_id", "x.field", "x.line_no")


def find_outside(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """What of each page is outside its main body: page_id, field (`content` or `abstract`), line_no (1 for an abstract).

    Reads page_id, content, abstract, last_crawled_at, and url for fitting; a page's newest crawl counts. Empty and blank lines have no
    rows; null, empty and blank fields have none; an abstract that is a block of the content, whole or cut off, has that block's label,
    another is decoded by itself; lines of any length are one block; repeated rows count once; rows without page_id are left out; an
    empty table gives an empty table (a field fitted to nothing calls every block outside); other columns are not read.
    """
    from millrace.llm.page_scan import scan_pages

    return outside_rows(durable(scan_pages(pages, field=field or train(pages)), "scan"))


def main_bodies(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """The main body of each page: page_id, content (its lines of the main body, null for null)."""
    out = find_outside(pages, field).filter("field = 'content'").groupBy("page_id").agg(F.collect_set("line_no").alias("_out"))  # at most a page's lines
    one = newest(pages, "page_id", "last_crawled_at", ["content"])
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce(F.col("_out"), F.array().cast("array<int>")), i + 1))
    return one.join(out, "page_id", "left").select("page_id", F.when(F.col("content").isNotNull(), F.array_join(kept, "\n")).alias("content"))


# Tags within a line of text, and those whose text no reader sees.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time u var".split())
_UNSEEN = frozenset(["script", "style", "noscript", "template", "head", "svg"])
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Leaves(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: list[str] = []
        self.blocks: list[tuple[str, Path]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text and not _UNSEEN.intersection(self.open):
            self.blocks.append((text, tuple(t for t in self.open if t not in _INLINE and t not in ("html", "body"))))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE:
            self.flush()
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def leaf_blocks(html: str | None) -> list[tuple[str, Path]]:
    """The leaf blocks of a page's HTML in order, each with the block tags above it; a null or empty page has none."""
    page = _Leaves()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.blocks


def html_bodies(raw: DataFrame, field: Field, key: str = "page_id") -> DataFrame:
    """The main body of raw pages (`key` and html), their leaf blocks decoded with the tags above them: key, content (null for null html)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for html in batch.column(1).to_pylist():
                blocks = leaf_blocks(html)
                lines, paths = [b for b, _ in blocks], [p for _, p in blocks]
                out.append(None if html is None else "\n".join(x for x, b in zip(lines, field.decode(lines, "", paths)) if b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "content"])

    return raw.select(key, "html").mapInArrow(run, f"`{key}` {raw.schema[key].dataType.simpleString()}, content string")
