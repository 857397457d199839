"""The inverted index, the dictionary, page ids, links and the page store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.html import tag_weight
from millrace.functions.text import detected, index_tokens
from millrace.session import drop, durable

#: Urls in each of the parts in which new ones are numbered, about; each is sorted in a task.
PART_URLS = 1_000_000


def element_words(elements: DataFrame, language: str | None = None) -> DataFrame:
    """One row for each word and element: page_id, elem_idx, word, score, position.

    `elements`: page_id, elem_idx, tag, text. Each element's text is cleaned by its language, found by itself unless given, and English
    words are stemmed. Positions run through the page; of a word's places in an element the last counts.
    """
    lang = F.lit(language) if language else detected(F.col("text"))
    e = elements.filter("page_id IS NOT NULL AND text IS NOT NULL").withColumn("_t", index_tokens(F.struct("text", lang.alias("language"))))
    return place_words(e.withColumn("score", tag_weight(F.col("tag"))), "_t")


def place_words(elements: DataFrame, tokens: str) -> DataFrame:
    """The same from elements (page_id, elem_idx, score) that have an array of tokens."""
    before = Window.partitionBy("page_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)  # one page's elements
    e = elements.withColumn("_before", F.coalesce(F.sum(F.size(tokens)).over(before), F.lit(0)))
    each = e.select("page_id", "elem_idx", "score", "_before", F.posexplode(tokens).alias("_p", "word"))
    return each.groupBy("page_id", "elem_idx", "word").agg(F.max("score").alias("score"), F.max(F.col("_before") + F.col("_p")).cast("int").alias("position")).select("page_id", "elem_idx", "word", "score", "position")


def place_nested(pages: DataFrame, elements: str = "elements") -> DataFrame:
    """The same from pages (page_id) that hold an array of a few elements (score, and an array of tokens): no shuffle finds the positions."""
    sizes = F.transform(elements, lambda x: F.size(x["tokens"]))
    before = F.transform(elements, lambda x, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, n: a + n))
    p = pages.select("page_id", F.posexplode(F.arrays_zip(F.col(elements).alias("e"), before.alias("before"))).alias("elem_idx", "x"))
    each = p.select("page_id", "elem_idx", F.col("x.e.score").alias("score"), F.col("x.before").alias("_before"), F.posexplode("x.e.tokens").alias("_p", "word"))
    return each.groupBy("page_id", "elem_idx", "word").agg(F.max("score").alias("score"), F.max(F.col("_before") + F.col("_p")).cast("int").alias("position")).select("page_id", "elem_idx", "word", "score", "position")


def postings(words: DataFrame, agg: str = "last") -> DataFrame:
    """One row for each word and page: word, page_id, score, position.

    Score and position are those of the word's last place on the page; with agg="max" the score is the greatest of all.
    """
    score = F.max_by("score", "position") if agg == "last" else F.max("score")
    return words.groupBy("word", "page_id").agg(score.alias("score"), F.max("position").alias("position"))


def dictionary(words: DataFrame) -> DataFrame:
    """Each word with the number of page elements that hold it: word, frequency. `words` has one row for each word and element, as `element_words` gives it."""
    return words.groupBy("word").agg(F.count("*").alias("frequency"))


def dictionary_of(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """The same from the token arrays of elements (one row each); counts are added up in each task before the shuffle."""
    return tokens.select(F.explode(F.array_distinct(column)).alias("word")).groupBy("word").agg(F.count("*").alias("frequency"))


def assign_ids(urls: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dense page ids after the greatest known one: url, page_id. Known urls keep theirs; null ones get none.

    Urls are numbered in parts by a hash, of about PART_URLS each, in url order, after the rows of the parts before it; the parts' counts
    are the only thing that one task holds, and their number the only one that reaches the driver.
    """
    u = durable(urls.select("url").filter("url IS NOT NULL").distinct(), "urls")
    start = F.lit(0)
    if known is not None:
        u = u.join(known.select("url"), "url", "left_anti")
    parts = max(1, -(-u.count() // PART_URLS))
    ranged = u.withColumn("_r", F.pmod(F.xxhash64("url"), F.lit(parts)))
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each part
    counts = counts.withColumn("_start", F.sum("_n").over(upto) - F.col("_n"))
    inside = Window.partitionBy("_r").orderBy("url")
    new = ranged.withColumn("_k", F.row_number().over(inside)).join(counts, "_r")
    if known is not None:
        top = known.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("_top"))
        new, start = new.crossJoin(F.broadcast(top)), F.col("_top")  # one row
    new = new.select("url", (start + F.col("_start") + F.col("_k")).cast("bigint").alias("page_id"))
    return new if known is None else known.select("url", "page_id").unionByName(new)


def outbound_edges(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct links between pages: src_id, dst_id. `links`: page_id and links (array); targets not crawled have ids too."""
    each = links.select(F.col("page_id").alias("src_id"), F.explode(F.array_distinct("links")).alias("url"))
    return each.join(ids.select("url", F.col("page_id").alias("dst_id")), "url").select("src_id", "dst_id").distinct()


def insert_if_absent(new: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """The rows of `new` whose key is not stored, one for each key: the first by page_id."""
    first = Window.partitionBy(key).orderBy("page_id")
    return new.filter(F.col(key).isNotNull()).join(stored.select(key), key, "left_anti").withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def page_json(pages: DataFrame) -> DataFrame:
    """Each page as the JSON text of its columns: page_id, json."""
    return pages.select("page_id", F.to_json(F.struct(*[c for c in pages.columns if c != "page_id"])).alias("json"))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Rank of each page of a link graph: page_id, rank. Self-links and repeated links count once as any other; pages without links give their rank to all."""
    e = durable(edges.select("src_id", "dst_id").filter("src_id IS NOT NULL AND dst_id IS NOT NULL").distinct(), "edges")
    nodes = durable(e.select(F.col("src_id").alias("page_id")).union(e.select("dst_id")).distinct(), "nodes")
    out = e.groupBy("src_id").agg(F.count("*").alias("_out"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    share = durable(e.join(out, "src_id"), "share")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = share.join(ranks.withColumnRenamed("page_id", "src_id"), "src_id").groupBy(F.col("dst_id").alias("page_id")).agg(F.sum(F.col("rank") / F.col("_out")).alias("_in"))
        kept = given.agg(F.coalesce(F.sum("_in"), F.lit(0.0))).first()[0]  # one number: what links pass on
        new = durable(nodes.join(given, "page_id", "left").select("page_id", ((1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + (1.0 - kept) / n)).alias("rank")), "ranks")
        if ranks.inputFiles() and _ > 0:
            drop(ranks)
        ranks = new
    return ranks
