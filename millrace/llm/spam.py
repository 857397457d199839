"""Keyword-stuffed pages and link lists (problem 5).

Each page is described by density, share of sentences, function words, repetition, entropy, separators and repeated line shapes
of its text, and by its links. Per language, medians, median deviations and the covariance of the rows near the median give a robust
Mahalanobis distance. Outliers that lie in a spam-directed direction from the median are flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.line_tokens import LANGUAGES, Lines, counted, mixed
from millrace.llm.residue import latin_filler
from millrace.session import durable

FEATURES = ["density", "sentences", "functions", "repetition", "entropy", "separators", "shapes", "links", "link_share"]
#: The directions of spam, by the sign of each feature in it: stuffed texts, and lists of links or tags. Density has no sign, as long pages
#: are no spam by themselves, nor has the number of links, as index pages have many.
DIRECTIONS = [
    {"sentences": -1.0, "functions": -1.0, "repetition": 1.0, "entropy": -1.0},
    {"sentences": -1.0, "functions": -1.0, "separators": 1.0, "shapes": 1.0, "link_share": 1.0},
]
#: The least scale of each feature, as some hardly vary among good pages.
LEAST_SCALE = {"density": 0.5, "sentences": 0.08, "functions": 0.04, "repetition": 0.06, "entropy": 0.03, "separators": 0.05, "shapes": 0.08, "links": 0.7, "link_share": 0.1}
#: Squared distance beyond which a page is an outlier. The features have heavy tails, so it isn't the normal law's quantile (28 at 0.999)
#: but that of Student's t with four degrees of freedom in nine dimensions: 9 times F(9, 4)'s quantile at 0.999, 48.5.
FAR = 436.0
#: The least cosine between a page's deviation, in the features of a direction, and that direction.
ALONG = 0.7
#: The largest share of words in what look like sentences (stuffed ones may), and the fewest words and links in all to judge a page by.
STRAY, LEAST_MASS = 0.85, 24
#: The statistics of a language of n pages are drawn to those of all pages by the weight SHRINK / (SHRINK + n).
SHRINK = 50
#: Lines of one shape that make a list, and those of bare words, of which a menu may have some beside sentences.
LISTED, LISTED_WORDS = 4, 12
#: A part of a text is a sentence if it has so many words, of which at least this share are function words and this share different.
SENTENCE_WORDS, FUNCTION_SHARE, DIFFERENT_SHARE = (4, 80), 0.1, 0.62
#: A line that is no sentence counts by itself if it has so many words, or fewer that are repeated.
LOOSE_WORDS, REPEATED_WORDS = 15, 8

def describe(lines: Lines, pages: list[list[str]], links: list[int | None]) -> Iterator[tuple[list[float], str | None] | None]:
    """For each page (its lines, all together in `lines`, and its number of links) the features and its language by function words; None where there is nothing to judge.

    Words in sentences and in loose lines count. A line without a sentence is loose if it has many words, repeats them, or has a shape that
    is repeated in its page; other short lines, such as menus, count for nothing, nor does pseudo-Latin filler.
    """
    n, p, most = lines.n, len(pages), len(lines.reader.names) + 1
    page = np.repeat(np.arange(p), [len(x) for x in pages])  # of each line
    parts = len(lines.closed)
    size, own = (np.bincount(lines.part_of_piece, lines.of(f), parts) for f in ("words", "functions"))
    token, at = lines.token[lines.is_word], lines.at[lines.is_word]
    different = np.bincount(counted(lines.part[lines.is_word], token, most)[0], minlength=parts)
    told = lines.closed & (size >= SENTENCE_WORDS[0]) & (size <= SENTENCE_WORDS[1]) & (own >= np.maximum(1, FUNCTION_SHARE * size)) & (different >= DIFFERENT_SHARE * size)
    inside = np.bincount(lines.part_line[told], size[told], n).astype(np.int64)
    words = lines.total("words")
    filler = np.zeros(n, bool)
    maybe = np.flatnonzero((lines.total("latin") > 0) & (inside == 0))
    if len(maybe):
        every = [x for of_page in pages for x in of_page]
        filler[[i for i in maybe.tolist() if latin_filler(every[i].lower())]] = True
    shape, bare = lines.shapes()
    listed = np.flatnonzero((inside == 0) & (words > 0) & ~filler)
    with np.errstate(over="ignore"):
        key = mixed(shape[listed] + page[listed].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    alike = np.zeros(n, np.int64)
    alike[listed] = times[which]
    some = np.bincount(page[inside > 0], minlength=p) > 0
    repeated = alike >= np.where(bare & some[page], LISTED_WORDS, LISTED)
    rest = words - inside
    same = np.bincount(counted(at, token, most)[0], minlength=n) < DIFFERENT_SHARE * words
    loose = np.where(~filler & (rest > 0) & ((rest >= LOOSE_WORDS) | repeated | ((rest >= REPEATED_WORDS) & same)), rest, 0)
    taken = ((inside > 0) | (loose > 0)) & ~filler
    total = lambda values, where: np.bincount(page[where], values[where], p)
    sentences, others = total(inside, taken), total(loose, taken)
    separators, shaped = total(lines.total("marks"), taken & (loose > 0)), total(loose, taken & repeated)
    tokens, functions = total(words, taken), total(lines.total("functions"), taken)
    in_page = taken[at]
    groups, times = counted(page[at[in_page]], token[in_page], most)
    kinds, sums = np.bincount(groups, minlength=p), np.bincount(groups, times * np.log(times), p)
    tally = np.stack([total(lines.total(k), taken) for k in LANGUAGES])
    for i in range(p):
        mass, k = sentences[i] + others[i], int(tokens[i])
        if not mass:
            yield None
            continue
        entropy = 1 - sums[i] / (k * math.log(k)) if k > 1 else 0.0
        language = LANGUAGES[int(tally[:, i].argmax())] if tally[:, i].max() >= 5 else None
        m = links[i] or 0
        yield [float(x) for x in (math.log1p(mass), sentences[i] / mass, functions[i] / k, 1 - kinds[i] / k, entropy, separators[i] / k, shaped[i] / mass, math.log1p(m), m / (m + mass))], language


def robust_distances(features: DataFrame) -> DataFrame:
    """`features` (language and FEATURES) with distance (the squared robust Mahalanobis distance) and along (the cosine to the nearest direction of spam).

    Medians and median deviations are taken over all pages of a language, the covariance over all of its pages within three
    deviations of the median in each feature; each is drawn to that of all pages the more, the fewer pages a language has. The
    statistics are a table of one row for each language, joined with the pages; nothing reaches the driver. A language without
    spread has the least scales.
    """
    n = len(FEATURES)
    two = features.select(F.explode(F.array("language", F.lit("*"))).alias("_g"), *FEATURES)  # each page for its language and for all
    whole = lambda df: df.filter("_g = '*'").drop("_g")

    def middle(df: DataFrame) -> DataFrame:
        """Medians by group as an array, drawn to those of all."""
        own = df.groupBy("_g").agg(F.array(*[F.percentile_approx(f, 0.5, 10_000).cast("double") for f in FEATURES]).alias("_m"), F.count("*").alias("_n"))
        every = F.broadcast(whole(own).select(F.col("_m").alias("_all")))  # one row
        w = F.col("_n") / (F.col("_n") + SHRINK)
        return own.crossJoin(every).select("_g", F.zip_with("_m", "_all", lambda a, b: w * a + (1 - w) * b).alias("_m"))

    centre = durable(middle(two), "centre")
    away = [F.col(f) - F.col("_m")[i] for i, f in enumerate(FEATURES)]
    spread = middle(two.join(centre, "_g").select("_g", *[F.abs(a).alias(f) for a, f in zip(away, FEATURES)]))
    least = F.array(*[F.lit(LEAST_SCALE[f]) for f in FEATURES])
    scales = durable(centre.join(spread.select("_g", F.zip_with(F.col("_m"), least, lambda a, b: F.greatest(1.4826 * a, b)).alias("_s")), "_g"), "scales")
    scaled = [((F.col(f) - F.col("_m")[i]) / F.col("_s")[i]).alias(f"_z{i}") for i, f in enumerate(FEATURES)]
    near = two.join(scales, "_g").select("_g", *scaled).filter(" AND ".join(f"abs(_z{i}) <= 3" for i in range(n)))
    sums = near.groupBy("_g").agg(F.count("*").alias("_n"), *[F.sum(f"_z{i}").alias(f"s{i}") for i in range(n)], *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)])

    def inverses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                mean = np.array([r[f"s{i}"] for i in range(n)]) / r["_n"]
                cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / r["_n"] - np.outer(mean, mean)
                few = 10 * n / (10 * n + r["_n"])  # of few rows the covariance is drawn to the identity
                out.append((r["_g"], np.linalg.inv((1 - few) * cov + (few + 0.05) * np.eye(n)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["_g", "_i"])

    stats = durable(scales.join(sums.mapInPandas(inverses, "_g string, _i array<double>"), "_g", "left"), "statistics")
    z = features.join(stats.withColumnRenamed("_g", "language"), "language").select("*", *scaled)
    own = lambda i, j: F.coalesce(F.col("_i")[n * i + j], F.lit(1.0 if i == j else 0.0))
    distance = sum((own(i, j) * (1 if i == j else 2) * F.col(f"_z{i}") * F.col(f"_z{j}") for i in range(n) for j in range(i, n)), F.lit(0.0))
    at = {f: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(f"_z{i}"))) for i, f in enumerate(FEATURES)}

    def cosine(signs: dict[str, float]) -> Column:
        size = F.sqrt(sum((at[f] * at[f] for f in signs), F.lit(1e-9)) * len(signs))
        return sum((at[f] * s for f, s in signs.items()), F.lit(0.0)) / size

    along = F.greatest(*[cosine(d) for d in DIRECTIONS])
    return z.withColumn("distance", distance).withColumn("along", along).drop("_m", "_s", "_i", *[f"_z{i}" for i in range(n)])


def spam_pages(scan: DataFrame) -> DataFrame:
    """page_id of the spam among the pages of `scan`, a durable table of `page_scan.scan_pages` with features."""
    from millrace.llm.page_scan import newest_scan

    one = newest_scan(scan, ["language", "features"]).filter("features IS NOT NULL")
    own = durable(one.select("page_id", "language", *[F.col("features")[i].alias(f) for i, f in enumerate(FEATURES)]), "features")
    mass: Column = F.expm1("density") + F.expm1("links")
    return robust_distances(own).filter((F.col("distance") > FAR) & (F.col("along") > ALONG) & (F.col("sentences") < STRAY) & (mass > LEAST_MASS)).select("page_id")


def find_spam(pages: DataFrame) -> DataFrame:
    """The pages that are repeated keywords, tags or links instead of sentences: page_id.

    Reads page_id, content, links, site_locale and last_crawled_at; a page's newest crawl counts. Null, empty and blank contents, and those
    of a few words and links, are none; very long ones are read whole; null links are none; repeated rows count once; rows without page_id
    are left out; an empty table gives an empty table; other columns are not read.
    """
    from millrace.llm.page_scan import scan_pages

    return spam_pages(durable(scan_pages(pages, features=True), "scan"))
