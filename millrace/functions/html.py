"""Content of web pages: title, abstract, texts of elements, links and JSON-LD blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import byte_prefix

# Bytes kept of the abstract and the content, and those a first paragraph must exceed to be an abstract.
ABSTRACT_BYTES, CONTENT_BYTES, PARAGRAPH_BYTES = 150, 20_000, 20
# The weight of a word by the element it is in; other elements that are read weigh 0.
TAG_WEIGHTS = {"title": 20, "h1": 10, "h2": 5, "h3": 4, "h4": 3, "h5": 2, "p": 1}
_READ = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "p"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


#: Start tags that close an open tag of the same group, as in HTML5: items of lists, terms, cells, rows, options.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: Where the search for a tag to close ends.
_BOUNDS = {"ul", "ol", "dl", "table", "select", "body", "html", "div", "section", "article"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class _Page(HTMLParser):
    """Collects what is read of a page: texts once, in order, and for each element where its texts begin and end.

    An open p ends where a block begins, a heading where another begins, and items, terms, cells and rows where the next begins, as in HTML5.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # tags, with their element's number or -1
        self.texts: list[str] = []
        self.elements: list[list] = []  # tag, first text, text after the last
        self.links: list[str] = []
        self.meta = {"description": "", "og:description": "", "twitter:description": ""}
        self.blocks: list[list[str]] = []
        self.block: list[str] | None = None
        self.paragraphs = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag in _BLOCKS and self.paragraphs:
            self._close({"p"})
        if tag in _HEADINGS and self.open and self.open[-1][0] in _HEADINGS:
            self._cut(len(self.open) - 1)
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _BOUNDS - {tag})
        if tag == "a" and "href" in a:
            self.links.append(a["href"])
        if tag == "meta":
            for key, name in (("name", "description"), ("property", "og:description"), ("name", "twitter:description")):
                if a.get(key) == name and not self.meta[name]:
                    self.meta[name] = a.get("content", "").strip()
        if tag == "script":
            self.block = [] if a.get("type") == "application/ld+json" else None
            if self.block is not None:
                self.blocks.append(self.block)
        if tag in _VOID:
            return
        number = -1
        if tag in _READ:
            number = len(self.elements)
            self.elements.append([tag, len(self.texts), None])
        self.paragraphs += tag == "p"
        self.open.append((tag, number))

    def _cut(self, at: int) -> None:
        """Ends the open tags from a place on."""
        for tag, number in self.open[at:]:
            self.paragraphs -= tag == "p"
            if number >= 0:
                self.elements[number][2] = len(self.texts)
        del self.open[at:]

    def _close(self, tags: set[str], bounds: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                return self._cut(i)
            if self.open[i][0] in bounds:
                return None

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.block = None
        self._close({tag})

    def handle_data(self, data: str) -> None:
        if self.block is not None:
            self.block.append(data)
        self.texts.append(data)

    def read(self) -> list[tuple[str, str]]:
        """The elements that are read, with their texts."""
        return [(tag, "".join(self.texts[a:b])) for tag, a, b in self.elements]


def resolve_link(base: str, href: str) -> str | None:
    """A link's address by the page's, without fragment; None unless it is http or https."""
    href = href.strip()
    if not href:
        return None
    try:
        url = urldefrag(urljoin(base, href)).url
        parts = urlsplit(url)
        return url if parts.scheme in ("http", "https") and parts.netloc else None
    except ValueError:
        return None


def read_page(html: str | None, url: str | None) -> dict:
    """What is read of one page."""
    page = _Page()
    try:
        page.feed(html or "")
        page.close()
    except Exception:  # what was read up to the broken place counts
        pass
    texts = page.read()
    title = next((t.strip() for tag, t in texts if tag == "title" and t.strip()), "")
    paragraph = next((t.strip() for tag, t in texts if tag == "p" and len(t.strip().encode()) > PARAGRAPH_BYTES), "")
    links = [x for x in (resolve_link(url or "", h) for h in page.links) if x]
    return {
        "title": title, "abstract": page.meta["description"] or page.meta["og:description"] or page.meta["twitter:description"] or paragraph,
        "content": " ".join(t for _, t in texts), "elements": texts,
        "links": links, "json_ld": [s for s in ("".join(b).strip() for b in page.blocks) if s],
    }


_KINDS = {
    "title": ("string", pa.string()), "abstract": ("string", pa.string()), "content": ("string", pa.string()),
    "elements": ("array<struct<elem_idx:int,tag:string,text:string>>", None), "links": ("array<string>", pa.list_(pa.string())), "json_ld": ("array<string>", pa.list_(pa.string())),
}


def _elements(rows: list[list[tuple[str, str]]]) -> pa.Array:
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    parts = [pa.array([i for r in rows for i in range(len(r))], pa.int32()), *[pa.array([x[k] for r in rows for x in r], pa.string()) for k in (0, 1)]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["elem_idx", "tag", "text"]))


def read_pages(raw: DataFrame, keep: list[str], columns: list[str] | None = None) -> DataFrame:
    """`keep` of `raw` (with url and html), and of each page those of title, abstract, content, elements, links and json_ld that are asked for (all by default)."""
    wanted = columns or list(_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_page(h, u) for h, u in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())]
            own = [_elements([f[c] for f in found]) if c == "elements" else pa.array([f[c] for f in found], _KINDS[c][1]) for c in wanted]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *own], names=[*keep, *wanted])

    schema = ", ".join([*[f"`{c}` {raw.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} {_KINDS[c][0]}" for c in wanted]])
    read = raw.select(*keep, F.col("html").alias("_html"), F.col("url").alias("_url")).mapInArrow(run, schema)
    for c, size in (("abstract", ABSTRACT_BYTES), ("content", CONTENT_BYTES)):
        if c in wanted:
            read = read.withColumn(c, byte_prefix(F.col(c), size))
    return read


def tag_weight(tag: Column) -> Column:
    """The weight of words in an element."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TAG_WEIGHTS.items() for x in kv]), tag), F.lit(0))
