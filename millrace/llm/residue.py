"""Template residue, filler, error pages and script notices in titles and contents (problem 1).

Titles and the lines of contents are units of text. Units whose wording leaves no doubt carry trusted labels: residue (a placeholder's
syntax, or what a small lexicon says is an error, a demand for scripts or filler), or none (a sentence of a listing). Of each unit's
five-word shingles, in the order of their hashes, the first fifth and one more are its keys: two units of the least similarity or more
share one of them, so an equality join finds every such pair; it is then verified by the similarity of all shingles. In the connected
components of verified pairs the trusted labels pass to units without one, by majority.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.cues import ALL_FUNCTION_WORDS
from millrace.operators.graph import connected_components
from millrace.session import durable

SHINGLE, LEAST_SIMILARITY = 5, 0.8
MEMORY = 200_000

# The ways in which templates mark what is to be filled in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\$\{[^{}\n]{1,80}\}|#\{[^{}\n]{1,80}\}|<%=?[^%\n]{1,80}%>|\{%[^%\n]{1,80}%\}|\[\[[^\[\]\n]{1,80}\]\]|<<[^<>\n]{1,80}>>|##[^#\n]{1,80}##|@@[^@\n]{1,80}@@"
    r"|(?<!\w)__[a-z][\w .-]{0,60}?__(?!\w)|%[a-z][\w.-]*(?: [\w.-]+)?%|\$[a-z]+(?:[_ ][a-z]+)*\$|\{[a-z_][\w.-]*(?: [\w.-]+)?\}|\[[a-z_][\w.-]*(?: [\w.-]+){0,2}\]"
)
# Wordings before a placeholder that speak about it.
MENTION = re.compile(r"(?:\b(?:such as|like|for instance|for example|e\.g\.|i\.e\.|called|named|written|tags?|fields?|syntax|variables?|markers?|placeholders?|languages?|notation)\b[^.!?]{0,40}|[\"“'‘(])$")
# Wordings of sentences of a listing, which may speak about errors, scripts or filler.
SPEAKING = re.compile(
    r"\byou will\b|\byou(?:r first)? task\b|\byour first\b|\bwe (?:analyse|study|teach|explain|build|write|collect|look)\b|\b(?:the|our) (?:team|course|group|post|job|work|workshop|project)\b|\bexperience (?:with|of|in)\b|\bcandidates?\b|\bapplicants?\b|\buseful\b|\bis reported\b|\bstudents\b"
)
# The reason phrases of HTTP's error statuses, and others that are usual.
_STATUS = r"(?:bad request|unauthori[sz]ed|forbidden|(?:page |file )?not found|gone|internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|too many requests|access denied|permission denied)"
#: What a text says that is nothing but residue; matched at its beginning.
WHOLE = re.compile(
    "|".join([
        rf"(?:(?:http|error|status|code|server)[ :]*)*[45]\d\d\b[ :–—-]*{_STATUS}?[.!]?$",
        rf"(?:error[ :]+)?{_STATUS}[.!]?$",
        r"(?:please wait|just a moment|one moment|loading|error|fehler|erreur|untitled|title|page title|home ?page|coming soon|under construction|bald verfügbar|bientôt disponible|(?:untitled|new) (?:page|document|post)(?: ?\d+)?)[ .!…]*$",
        r"(?:undefined|null|nan|none|n\.a\.|\[object object\])(?:[ ,|/-]+(?:undefined|null|nan|none|\[object object\]))*$",
        r"(?:x{2,}[ .]*){3,}$|(?:test[ .]*){2,}|(?:tk[ .]*){2,}",
        r"@[a-z]+(?: - @[a-z]+)*$",
        r"(?:robot|security|browser|human) check\b|attention required\b|(?:verify|verifying|confirm) (?:that )?you are (?:a )?human|checking your browser|(?:solve|complet\w+) (?:the|this) captcha",
        r"(?:fatal|parse|syntax|runtime) error\b|uncaught |traceback \(|[a-z.]*(?:error|exception): |(?:warning|notice): (?:undefined|use of|trying|division)|at [\w.$]+\([\w.]+:\d+\)|stack trace\b|(?:oops|whoops|uh[- ]oh)\b",
    ])
)
_FILLED = ["text", "copy", "body copy", "title", "heading", "headline", "content", "description", "paragraph", "name", "details", "summary"]
# What is spoken of, and what is said of it; a text of both is residue. Without the first, the second is enough.
LEXICON: list[tuple[list[str], list[str]]] = [
    (  # a demand for scripts
        ["javascript", "java script", "script", "scripts", "scripting", "noscript", "browser"],
        ["enable", "enabled", "activate", "activated", "allow", "allowed", "turn on", "turned on", "turn it on", "switch on", "switched on", "switched off", "turned off", "need", "needs", "require", "requires", "required", "without", "disabled", "blocked", "out of date", "outdated", "not supported", "does not support", "upgrade", "aktivieren", "deaktiviert", "activer", "activez", "active", "habilite", "habilitar"],
    ),
    (  # an error
        ["page", "listing", "vacancy", "resource", "item", "file", "document", "link", "address", "url", "server", "gateway", "service", "site", "session", "database", "connection", "request", "requests", "id", "something", "error", "access", "it", "you", "please", "seite", "página", "nothing"],
        ["not found", "not be found", "not be located", "could not connect", "cannot be found", "can't find", "cannot find", "does not exist", "doesn't exist", "no longer available", "no longer exists", "timed out", "has expired", "failed", "too many", "slow down", "denied", "not have permission", "don't have permission", "invalid", "under maintenance", "undergoing maintenance", "down for maintenance", "went wrong", "try again in", "try again later", "broken", "moved or", "taken down", "been removed", "been deleted", "error occurred", "error has occurred", "existiert", "nicht gefunden", "no encontrada"],
    ),
    ([], ["page introuvable", "n'existe plus", "n'existe pas", "asdf", "asdf asdf", "qwerty", "lorem ipsum", "blindtext", "platzhalter", "replace before publishing", "click to edit", "click here to edit"]),  # filler
    ([], [f"{a} {b}" for a, b in product(["placeholder", "dummy", "sample", "filler"], ["text", "copy", "page", "heading", "headline", "title", "content", "description", "paragraph", "image"])]),
    ([], [f"{a} {b}" for a, b in product(_FILLED, ["goes here", "go here", "to come", "will appear", "here"])]),
    ([], [f"insert {b}{a}" for a, b in product([*_FILLED, "duties", "date", "image"], ["", "your ", "job ", "page "])]),
]
#: A text of more words than this is none of the lexicon's, which is of short messages.
MESSAGE_WORDS = 24
# The words that pseudo-Latin filler draws on.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
LATIN_STEMS = frozenset(w[:4] for w in LATIN if len(w) > 3)
_WORD = re.compile(r"[^\W\d_]+")
_SITE = re.compile(r"\s+[|–—-]\s+")
_CODES = re.compile(r"\b(?=[a-f]*\d)[a-f0-9]{6,}\b|\d[\d.,]*")


def latin_filler(s: str) -> bool:
    """Whether most words of a squeezed text are of the pseudo-Latin filler, also with other endings."""
    words = _WORD.findall(s)
    return len(words) >= 3 and sum(w in LATIN or (len(w) > 3 and w[:4] in LATIN_STEMS) for w in words) >= 0.7 * len(words)


@lru_cache(maxsize=1)
def _lexicon():
    """The lexicon's automaton, with the bits of each of its texts, and the bits that make residue together."""
    import ahocorasick

    bits: dict[str, int] = {}
    wanted = []
    for k, (about, said) in enumerate(LEXICON):
        for words, bit in ((about, 1 << 2 * k), (said, 2 << 2 * k)):
            for w in words:
                bits[w] = bits.get(w, 0) | bit
        wanted.append((1 << 2 * k if about else 0) | 2 << 2 * k)
    tree = ahocorasick.Automaton()
    for w, b in bits.items():
        tree.add_word(w, (len(w), b))
    tree.make_automaton()
    return tree, wanted


_JOINS = "/.-_@"  # of addresses and names, which are no wording


def _says_residue(s: str) -> bool:
    """Whether a squeezed text is residue by its wording."""
    if WHOLE.match(s):
        return True
    if s.count(" ") >= MESSAGE_WORDS:
        return False
    tree, wanted = _lexicon()
    found, n = 0, len(s)
    for end, (size, bits) in tree.iter(s):
        a, b = end - size, end + 1
        if (a < 0 or not (s[a].isalnum() or s[a] in _JOINS)) and (b == n or not (s[b].isalnum() or (s[b] in _JOINS and s[b + 1 : b + 2].isalnum()))):
            found |= bits
    return found > 0 and any(found & w == w for w in wanted)


def trusted(text: str, title: bool = False) -> bool | None:
    """The trusted label of a unit: residue, none, or unknown."""
    words = text.lower().split()
    return _label(words, " ".join(words), title) if words else None


def _marked(s: str) -> bool:
    """Whether a text holds a character that a placeholder has."""
    return "{" in s or "[" in s or "<" in s or "#" in s or "%" in s or "$" in s or "@" in s or "_" in s


def _label(words: list[str], s: str, title: bool) -> bool | None:
    if _marked(s):
        if s.startswith("[object"):
            return True
        if marks := list(PLACEHOLDER.finditer(s)):
            return not all(MENTION.search(s[: m.start()].rstrip() if s[: m.start()][-1:] == " " else s[: m.start()]) for m in marks)
    if title:  # the name of the site may follow
        head = _SITE.split(s)
        if head[0] in ("null", "undefined", "nan") or _says_residue(head[0] or "-") or (head[0].isdigit() and len(head) > 1 and _says_residue(f"{head[0]} {head[1]}")):
            return True
    if _says_residue(s):
        return not SPEAKING.search(s)
    if not LATIN_STEMS.isdisjoint([w[:4] for w in words[:5]]) and latin_filler(s):
        return True
    if len(words) >= 12 and s[-1] in ".!?" and len(ALL_FUNCTION_WORDS.intersection(words)) >= 4:
        return False  # sentences of some length that say nothing of the kind
    return None


def masked(words: list[str], s: str, known: dict[str, str]) -> list[str]:
    """The words of a squeezed text with placeholders, numbers and codes made equal. `known` remembers words."""
    if _marked(s):
        words = PLACEHOLDER.sub("{}", s).split()
    try:
        return [known[w] for w in words]
    except KeyError:
        if len(known) > MEMORY:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = w if w.isalpha() else _CODES.sub("0", w)
        return [known[w] for w in words]


def examine(line: str, title: bool, known: dict[str, str]) -> tuple[bool | None, list[str]] | None:
    """The trusted label of a line and its masked words; None for a blank one."""
    words = line.lower().split()
    if not words:
        return None
    s = " ".join(words)
    return _label(words, s, title), masked(words, s, known)


class _Codes(dict):
    """Numbers of words, made when they are first asked for."""

    def __missing__(self, w: str) -> int:
        self[w] = code = zlib.crc32(w.encode("utf-8", "surrogatepass")) + 0x9E3779B9 * (len(w) + 1)
        return code


def _hashed(texts: list[list[str]], known: _Codes | None = None):
    """The hashes of the runs of SHINGLE words over all texts, joined, and each text's first run and number of runs; texts have SHINGLE words at least."""
    import numpy as np

    of = (_Codes() if known is None else known).__getitem__
    codes = np.fromiter(map(of, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = h * np.uint64(0x100000001B3) + codes[k : len(h) + k]
            h ^= h >> np.uint64(29)
        for m, r in ((0xBF58476D1CE4E5B9, 27), (0x94D049BB133111EB, 31)):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(m)
            h ^= h >> np.uint64(r)
    sizes = np.array([len(t) for t in texts])
    return h, np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes - SHINGLE + 1


#: Bits of a shingle's hash that make its key; those of a text's number stand before them while keys are sorted.
KEY_BITS = 44


def prefixes(texts: list[list[str]], known: _Codes | None = None):
    """The keys of texts of at least SHINGLE words, as arrays: the text's number, how many distinct shingles it has, the key.

    Of n shingles, one of least similarity t shares at least t * n, so no more than (1 - t) * n of the first ones can be missing in it.
    """
    import numpy as np

    h, starts, runs = _hashed(texts, known)
    of = np.repeat(np.arange(len(texts)), runs)
    h = h[np.arange(len(of)) + (starts - np.cumsum(runs) + runs)[of]]
    both = np.sort((of.astype(np.uint64) << np.uint64(KEY_BITS)) | (h >> np.uint64(64 - KEY_BITS)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    of = (both >> np.uint64(KEY_BITS)).astype(np.int64)
    count = np.bincount(of, minlength=len(texts))
    place = np.arange(len(both)) - (np.cumsum(count) - count)[of]
    kept = place <= np.floor((1 - LEAST_SIMILARITY) * count[of] + 1e-9)
    return of[kept], count[of[kept]], (both[kept] & np.uint64((1 << KEY_BITS) - 1)).view(np.int64)


class Units:
    """Reads the units of pages: those that may carry a trusted label or have at least two shingles."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple | None] = {}  # what is known of a raw line
        self.given: set[int] = set()
        self.plain: dict[str, str] = {}  # what is known of a word

    def forget(self) -> None:
        """Between batches: keeps the memory bounded."""
        if len(self.seen) > MEMORY:
            self.seen.clear()
        if len(self.given) > 4 * MEMORY:
            self.given.clear()

    def page(self, title: str | None, lines: list[str]) -> Iterator[tuple[str, int, bool | None, str | None]]:
        """field, unit (a hash of the masked text), label, text (None where it was given before) of each unit of a page, once for each raw line."""
        import xxhash

        seen, given = self.seen, self.given
        every = dict.fromkeys(lines)
        if title:
            every["\x00" + title.replace("\n", " ")] = None
        for line in every:
            if line in seen:
                known = seen[line]
            else:
                titled = line[:1] == "\x00"
                found = examine(line[1:] if titled else line, titled, self.plain)
                if found is None or (found[0] is None and len(found[1]) <= SHINGLE and not (not titled and _SITE.search(" ".join(found[1])))):
                    known = None
                else:
                    text = " ".join(found[1])
                    known = ("title" if titled else "content", xxhash.xxh3_64_intdigest(text) - (1 << 63), found[0], text)
                seen[line] = known
            if known is not None:
                if known[1] in given:
                    yield (*known[:3], None)
                else:
                    given.add(known[1])
                    yield known


def keyed(texts: DataFrame) -> DataFrame:
    """A row of `texts` (unit, text) for each of its keys: unit, size (its number of shingles), key. Texts of one shingle have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        known = _Codes()
        for batch in batches:
            words = [t.split(" ") for t in batch.column(1).to_pylist()]
            at = [i for i, w in enumerate(words) if len(w) > SHINGLE]
            if len(known) > MEMORY:
                known.clear()
            if at:
                of, size, key = prefixes([words[i] for i in at], known)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(at)[of])), pa.array(size, pa.int32()), pa.array(key, pa.int64())], names=["unit", "size", "key"])

    return texts.select("unit", "text").mapInArrow(run, "unit bigint, size int, key bigint")


def _shingles(text: Column) -> Column:
    words = F.split(text, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _verified(left: DataFrame, right: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The near-duplicates a, b among the rows of `left` (a, _na, key) and `right` (b, _nb, key) that share a key, b not of `known`."""
    alike = (F.col("a") != F.col("b")) & (F.least("_na", "_nb") >= LEAST_SIMILARITY * F.greatest("_na", "_nb") - 1e-9)
    near = left.join(right, "key").filter(alike).select("a", "b").distinct()
    near = durable(near.join(known.select(F.col("unit").alias("b")), "b", "left_anti").select("a", "b"), "near")
    if near.isEmpty():
        return near
    wanted = near.select(F.col("a").alias("unit")).union(near.select("b")).distinct()
    some = durable(texts.join(wanted, "unit", "left_semi").dropDuplicates(["unit"]), "texts").withColumn("_t", _shingles(F.col("text")))
    ta, tb = (some.select(F.col("unit").alias(c), F.col("_t").alias(f"_t{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("_ta", "_tb"))
    both = near.join(ta, "a").join(tb, "b").filter(shared >= LEAST_SIMILARITY * (F.size("_ta") + F.size("_tb") - shared))
    return durable(both.select("a", "b"), "pairs")


def similar_pairs(some: DataFrame, known: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Near-duplicates a, b with a of `some` and b not of `known` (both unit), at least one for each b that has any.

    A family of n texts and m others has n * m pairs, so first only one text of `some` stands for each key; those b that it doesn't
    reach are compared with all. `keys` is as `keyed` gives it; `texts` has unit and text.
    """
    left = durable(keys.join(some.select("unit"), "unit", "left_semi").select(F.col("unit").alias("a"), F.col("size").alias("_na"), "key").distinct(), "probes")
    right = keys.select(F.col("unit").alias("b"), F.col("size").alias("_nb"), "key")
    first = left.groupBy("key").agg(F.min(F.struct("a", "_na")).alias("_f")).select("_f.*", "key")
    found = _verified(first, right, known, texts)
    reached = known.unionByName(found.select(F.col("b").alias("unit")).distinct())
    several = left.groupBy("key").agg(F.count("*").alias("_k")).filter("_k > 1")  # a key of one text has nothing more to compare
    return found.unionByName(_verified(left.join(several.select("key"), "key", "left_semi"), right, reached, texts))


def residue_units(scanned: DataFrame) -> DataFrame:
    """The units that are residue: unit, after trusted labels have passed through the components that hold one.

    A unit's own label is that of the majority of its rows that have one. Starting from the units labelled residue, near-duplicates are
    sought among the units without that label, then theirs, until none is new. A unit without a label gets that of the majority of its
    component's. Exact copies are one unit.
    """
    votes = F.sum(F.when(F.col("label"), 1).when(~F.col("label"), -1).otherwise(0))
    units = durable(scanned.groupBy("unit").agg(F.nullif(F.signum(votes).cast("int"), F.lit(0)).alias("vote")), "units")
    texts = scanned.filter("text IS NOT NULL").select("unit", "text")
    keys = durable(keyed(texts), "keys")
    seeds = durable(units.filter("vote > 0").select("unit"), "seeds")
    edges, frontier, known = None, seeds, seeds
    while True:
        found = similar_pairs(frontier, known, keys, texts)
        edges = found if edges is None else edges.unionByName(found)
        new = durable(found.select(F.col("b").alias("unit")).distinct(), "frontier")
        if new.isEmpty():
            break
        known, frontier = known.union(new), new
    if frontier is seeds:  # no unit is like them
        return seeds
    parts = connected_components(edges)
    member = known.join(parts.withColumnRenamed("node", "unit"), "unit", "left").join(units, "unit").withColumn("component", F.coalesce("component", "unit"))
    sums = member.groupBy("component").agg(F.sum(F.coalesce("vote", F.lit(0))).alias("_v"))
    return member.join(sums, "component").filter("vote > 0 OR (vote IS NULL AND _v > 0)").select("unit").distinct()


def residue_fields(scan: DataFrame) -> DataFrame:
    """The fields that hold residue: page_id, field; `scan` is a durable table of `page_scan.scan_pages` with units.

    The bad units are few beside the units of all pages, so they are broadcast if their size allows, else a common line's rows are split.
    """
    units = scan.select("page_id", "crawled", F.explode("units").alias("u")).select("page_id", "crawled", "u.*")
    bad = durable(residue_units(units), "residue")
    last = scan.groupBy("page_id").agg(F.max("crawled").alias("crawled"))
    return units.select("page_id", "crawled", "field", "unit").join(bad, "unit").select("page_id", "crawled", "field").distinct().join(last, ["page_id", "crawled"]).select("page_id", "field")


def find_residue(pages: DataFrame) -> DataFrame:
    """The fields of web pages that hold residue: page_id, field (`title` or `content`).

    Reads page_id, title, content and last_crawled_at; a page's newest crawl counts, of equally new ones each. Null, empty and blank
    fields hold none; lines of any length are units as a whole; repeated rows and lines count once; rows without page_id are
    left out; an empty table gives an empty table; other columns are not read.
    """
    from millrace.llm.page_scan import scan_pages

    return residue_fields(durable(scan_pages(pages, units=True), "scan"))
