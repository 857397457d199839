"""Crawling over a table of raw pages: allowlists, frontier rounds, and what a crawl stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.fields import with_listing_fields
from millrace.functions.html import read_pages
from millrace.functions.urls import registrable_domain
from millrace.operators import index
from millrace.session import durable

DEFAULT_TIER = 3


def seed_urls(text: str) -> list[str]:
    """A comma-separated list of urls, trimmed, without blanks; an empty one is refused."""
    urls = [u.strip() for u in text.split(",") if u.strip()]
    if not urls:
        raise ValueError("no seed urls")
    return urls


def parse_allowlist(entries: list[str]) -> dict[str, int]:
    """Domains and tiers from `domain` or `domain:tier` entries; empty for no restriction, which a `*` gives too. A later entry of a domain wins."""
    out: dict[str, int] = {}
    for e in entries:
        e = e.strip().lower()
        if e == "*":
            return {}
        if not e:
            continue
        domain, sep, tier = e.rpartition(":")
        if sep and tier.lstrip("+").isdigit() and int(tier) >= 1:
            out[domain] = int(tier)
        else:
            out[e] = DEFAULT_TIER
    return out


def seed_domains(spark: SparkSession, urls: list[str]) -> DataFrame:
    """The allowlist of seeds where none is given: their domains, with the default tier."""
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    return u.select(registrable_domain(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct().withColumn("tier", F.lit(DEFAULT_TIER))


def with_tier(pages: DataFrame, allowlist: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with trust_tier: that of the domain, else the default."""
    a = allowlist.groupBy(F.lower("domain").alias("_domain")).agg(F.max("tier").alias("_tier"))
    return pages.withColumn("_domain", registrable_domain(F.col(url))).join(a, "_domain", "left").withColumn("trust_tier", F.coalesce("_tier", F.lit(DEFAULT_TIER))).drop("_domain", "_tier")


def allowed(urls: DataFrame, allowlist: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose url's domain is in the allowlist."""
    a = allowlist.select(F.lower("domain").alias("_domain")).distinct()
    return urls.withColumn("_domain", registrable_domain(F.col(url))).join(a, "_domain", "left_semi").drop("_domain")


def _smallest(nodes: DataFrame, most: int, parts: int = 64) -> DataFrame:
    """The `most` smallest nodes (BIGINT): whole ranges between quantiles by their counts, and only of the last range a sorted part."""
    n = nodes.count()
    if n <= most:
        return nodes
    cuts = nodes.agg(F.percentile_approx("node", [i / parts for i in range(1, parts)], 10_000)).first()[0]
    ranged = nodes.withColumn("_r", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c < F.col("node"))))
    left, last = most, 0
    for r, k in sorted(tuple(x) for x in ranged.groupBy("_r").count().collect()):  # at most `parts` numbers
        last = r
        if k > left:
            break
        left -= k
    return ranged.filter(F.col("_r") < last).unionByName(ranged.filter(F.col("_r") == last).orderBy("node").limit(left)).drop("_r")


def breadth_first(links: DataFrame, seeds: DataFrame, rounds: int, most: int | None = None) -> DataFrame:
    """Nodes reached from the seeds, with the round: node, depth. At most `most` nodes are taken, in order of depth and node.

    `links`: src, dst; `seeds`: node (all BIGINT). Each round joins its frontier with the links, drops what was visited and is written
    to the shared folder, once; what was visited is the union of the rounds' tables.
    """
    edges = durable(links.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).distinct(), "edges")
    first = seeds.select(F.col("node").cast("bigint").alias("node")).filter("node IS NOT NULL").distinct()
    if most is not None:
        first = _smallest(durable(first, "seeds"), most)
    visited = frontier = durable(first.withColumn("depth", F.lit(0)), "frontier")
    taken = visited.count() if most is not None else 0
    for depth in range(1, rounds + 1):
        new = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(visited.select("node"), "node", "left_anti")
        if most is not None:
            new = _smallest(durable(new, "new"), max(0, most - taken))
        frontier = durable(new.withColumn("depth", F.lit(depth)), "frontier")
        n = frontier.count()
        taken += n
        if not n:
            break
        visited = visited.unionByName(frontier)
    return visited


def enqueue(queue: DataFrame, visited: DataFrame, urls: DataFrame) -> DataFrame:
    """A queue (url, place) after the urls (url, place) that are neither visited nor queued: in order of place, behind what is queued; of equal urls the first counts."""
    new = urls.filter("url IS NOT NULL").groupBy("url").agg(F.min("place").alias("place")).join(visited.select("url"), "url", "left_anti").join(queue.select("url"), "url", "left_anti")
    top = queue.agg(F.coalesce(F.max("place"), F.lit(0)).alias("_top"))  # one row
    return queue.select("url", "place").unionByName(new.crossJoin(F.broadcast(top)).select("url", (F.col("place") + F.col("_top") + 1).alias("place")))


def dequeue(queue: DataFrame, many: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first `many` urls of a queue, first in first out, and the queue without them."""
    first = durable(queue.orderBy("place", "url").limit(many), "taken")
    return first, queue.join(first.select("url"), "url", "left_anti")


def progress(added: int, most: int, elapsed_seconds: float) -> dict[str, int | str | None]:
    """Pages added of the limit, the percentage (0 to 100, 0 without a limit) and the time remaining, None before the first page."""
    share = min(100, max(0, added * 100 // most)) if most > 0 else 0
    left = int(max(0.0, elapsed_seconds / added * (most - added))) if added > 0 else None
    return {"added": added, "limit": most, "percent": share, "remaining": None if left is None else f"{left // 3600:02d}h:{left % 3600 // 60:02d}m:{left % 60:02d}s"}


def extract(raw: DataFrame, now: Column, allowlist: DataFrame | None = None) -> DataFrame:
    """Raw pages (page_id, url, html) as stored pages, with elements, links and json_ld."""
    pages = with_listing_fields(read_pages(raw, ["page_id", "url"]))
    pages = with_tier(pages, allowlist) if allowlist is not None else pages.withColumn("trust_tier", F.lit(DEFAULT_TIER))
    return pages.withColumn("last_crawled_at", now)


def build_index(pages: DataFrame, language: str | None = None) -> dict[str, DataFrame]:
    """The tables of an index from extracted pages: words, postings, dictionary, page_ids, links."""
    elements = pages.select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")
    words = durable(index.element_words(elements, language), "words")
    own = pages.select("url", "page_id")
    known = pages.select(F.explode("links").alias("url")).filter(registrable_domain(F.col("url")).isNotNull())
    ids = index.assign_ids(known, own)
    return {"words": words, "postings": index.postings(words), "dictionary": index.dictionary(words), "page_ids": ids, "links": index.outbound_edges(pages.select("page_id", "links"), ids)}
