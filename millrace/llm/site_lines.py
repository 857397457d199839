"""Lines repeated across one site's pages (problem 3).

The lines of a site are the nodes of a graph, two that follow each other in a page (empty lines between them aside) are linked, and both
carry the number of pages they occur in. Nodes and edges of high support remain; their connected components are the site's boilerplate
blocks. An occurrence of a block in a page is its lines and, along the edges, the empty lines between them; occurrences are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import connected_components
from millrace.session import durable
from millrace.sources.lines import line_hashes, site_of
from millrace.sources.tables import newest

#: A line is repeated if it is on at least so many of its site's pages, and on at least this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.2


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, site and the hashes of the lines of each page's newest crawl, as a durable table."""
    hashed = pages.select("page_id", "last_crawled_at", site_of(F.col("url")).alias("site"), line_hashes(F.col("content")).alias("lines"))
    return durable(newest(hashed, "page_id", "last_crawled_at", ["site", "lines"]).filter("site IS NOT NULL"), "lines")


def _followed() -> Column:
    """Of the column `lines`, the pairs of lines that follow each other, empty ones aside: line, then, and their numbers from 1, at and to."""
    full = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), x.alias("line"))), lambda x: x["line"].isNotNull())
    pair = lambda a, b: F.struct(a["line"].alias("line"), b["line"].alias("then"), a["at"].alias("at"), b["at"].alias("to"))
    return F.zip_with(F.slice(full, 1, F.greatest(F.size(full) - 1, F.lit(0))), F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), pair)


def repeated_graph(lines: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """The repeated lines (site, line, pages, block) and the repeated steps from one to the next (site, line, then, pages), durable.

    `lines` is as `page_lines` gives it; a line is named by its hash, a block by the least node of its component. Counts are of pages, over
    all pages of the site, also those without content. A hot site is no hot group: its lines are counted by site and line, after a
    partial aggregation.
    """
    known = lines.filter("lines IS NOT NULL")
    sites = durable(lines.groupBy("site").agg(F.ceil(F.greatest(F.lit(float(least_pages)), F.count("*") * F.lit(least_share) - 1e-9)).cast("bigint").alias("_least")), "sites")
    counts = known.select("site", F.explode(F.array_distinct(F.array_compact("lines"))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("pages"))
    nodes = counts.filter(F.col("pages") >= least_pages).join(sites, "site").filter("pages >= _least").select("site", "line", "pages", "_least")
    nodes = durable(nodes.withColumn("node", F.xxhash64("site", "line")), "nodes")
    steps = F.array_distinct(F.transform(_followed(), lambda p: F.struct(p["line"].alias("line"), p["then"].alias("then"))))
    pairs = known.select("site", F.explode(steps).alias("_p")).select("site", "_p.line", "_p.then")
    first = nodes.select("site", "line", "_least", F.col("node").alias("a"))
    second = nodes.select("site", F.col("line").alias("then"), F.col("node").alias("b"))
    edges = pairs.join(first, ["site", "line"]).join(second, ["site", "then"]).groupBy("site", "line", "then", "a", "b", "_least").agg(F.count("*").alias("pages"))
    edges = durable(edges.filter("pages >= _least").drop("_least"), "steps")
    blocks = connected_components(edges)
    kept = nodes.join(blocks, "node", "left").select("site", "line", "pages", F.coalesce("component", "node").alias("block"))
    return durable(kept, "repeated"), edges.select("site", "line", "then", "pages")


def repeated_places(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Where the repeated lines occur: page_id, line_no (from 1, empty lines counted), block.

    `repeated` is small, as a site has few lines that a fifth of its pages hold; a hot line is a hot key of the other side only, which
    is split at run time where the join is not a broadcast of checked size.
    """
    each = lines.select("page_id", "site", F.posexplode("lines").alias("_n", "line")).filter("line IS NOT NULL")
    return each.join(repeated.select("site", "line", "block"), ["site", "line"]).select("page_id", (F.col("_n") + 1).alias("line_no"), "block")


def find_repeated_lines(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """The places of lines repeated across their site: page_id, line_no, block.

    Reads page_id, url, content and last_crawled_at. Rows of one page_id count once, by the newest crawl; rows without page_id are left
    out, and pages whose url has no host, as they are of no site. Null, empty and blank contents have no lines but count as
    pages; very long ones are read whole; an empty table gives an empty table; other columns are not read.
    """
    lines = page_lines(pages)
    return repeated_places(lines, repeated_graph(lines, least_pages, least_share)[0])


def repeated_blocks(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """The boilerplate blocks of each site: site, block, lines (their number), most_pages, least_pages (of its lines)."""
    nodes = repeated_graph(page_lines(pages), least_pages, least_share)[0]
    return nodes.groupBy("site", "block").agg(F.count("*").alias("lines"), F.max("pages").alias("most_pages"), F.min("pages").alias("least_pages"))


def without_repeated_lines(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Each page's content without the occurrences of its site's blocks: page_id, content (null stays null), removed (the number of lines).

    Removed are the repeated lines and the empty lines between two of them that follow each other on as many pages; other empty lines stay.
    """
    lines = page_lines(pages)
    nodes, steps = repeated_graph(lines, least_pages, least_share)
    single = repeated_places(lines, nodes).select("page_id", F.array("line_no").alias("_n"))
    apart = F.filter(_followed(), lambda p: p["to"] > p["at"] + 1)
    gaps = lines.filter("lines IS NOT NULL").select("page_id", "site", F.explode(apart).alias("_p")).select("page_id", "site", "_p.*")
    gaps = gaps.join(steps.select("site", "line", "then"), ["site", "line", "then"], "left_semi").select("page_id", F.sequence(F.col("at") + 1, F.col("to") - 1).alias("_n"))
    out = single.unionByName(gaps).groupBy("page_id").agg(F.array_distinct(F.flatten(F.collect_list("_n"))).alias("_out"))  # at most the lines of one page
    one = newest(pages, "page_id", "last_crawled_at", ["content"])
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.col("_out"), i + 1))
    return one.join(out, "page_id", "left").select(
        "page_id", F.when(F.col("_out").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"),
        F.when(F.col("_out").isNull(), 0).otherwise(F.size("_out")).alias("removed"),
    )
