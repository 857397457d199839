"""One pass over web pages for the operators that read their lines: units (problem 1), features (problem 5), labels of blocks (problem 6).

The texts go to Python once, in Arrow batches, and their lines are read as arrays (`line_tokens`), once for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import cues, line_tokens, residue, spam

if TYPE_CHECKING:
    from millrace.llm.body import Field

SCHEMA = "page_id bigint, crawled bigint, units array<struct<field:string,unit:bigint,label:boolean,text:string>>, language string, features array<double>, outside array<int>, abstract boolean"


def crawled() -> Column:
    """When a row was crawled, in microseconds; a null time is before all others."""
    return F.coalesce(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(last_crawled_at AS TIMESTAMP_NTZ))"), F.lit(-(1 << 62)))


def scan_pages(pages: DataFrame, units: bool = False, features: bool = False, field: Field | None = None) -> DataFrame:
    """Each row of `pages` that has a page_id: page_id, crawled, and what was asked for, else null.

    units: the page's units (see `residue.Units`). language, features: see `spam.describe`; null where there is nothing to judge.
    outside, abstract: the numbers of the lines that `field` labels as outside the main body, from 1, and whether the abstract is.
    Reads page_id, last_crawled_at, content, and where they are needed title, links (their number), site_locale and abstract.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_reader, reader, model = residue.Units(), line_tokens.Reader(), field
        for batch in batches:
            unit_reader.forget()
            rows, ends, language, described, outside, whole = [], [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in range(2, 7)]
            for start, stop in line_tokens.ranges(columns[0]):
                contents, titles, links, locales, abstracts = [c[start:stop] for c in columns]
                pages_lines = [c.split("\n") if c else [] for c in contents]
                if units:
                    for title, every in zip(titles, pages_lines):
                        rows += unit_reader.page(title, every)
                        ends.append(len(rows))
                if not features and model is None:
                    continue
                lines = reader.read([x for every in pages_lines for x in every])
                upto = [0, *accumulate(map(len, pages_lines))]
                if features:
                    for locale, found in zip(locales, spam.describe(lines, pages_lines, links)):
                        language.append((found[1] or (locale or "und").lower()[:2]) if found else None)
                        described.append(found[0] if found else None)
                if model is not None:
                    scores = model.scores(lines).tolist()
                    for k, (every, abstract) in enumerate(zip(pages_lines, abstracts)):
                        at, out = model.outside(every, cues.squeezed(abstract or ""), abstract or "", scores[upto[k] : upto[k + 1]])
                        outside.append(at)
                        whole.append(out)
            n = batch.num_rows
            blank = lambda kind: pa.nulls(n, kind)
            cols = [batch.column(0), batch.column(1)]
            kind = pa.struct([("field", pa.string()), ("unit", pa.int64()), ("label", pa.bool_()), ("text", pa.string())])
            if units:
                parts = [pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [()] * 4, kind)]
                cols.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind))))
            else:
                cols.append(blank(pa.list_(kind)))
            numbers = pa.list_(pa.float64())
            cols += [pa.array(language, pa.string()), pa.array(described, numbers)] if features else [blank(pa.string()), blank(numbers)]
            if model is not None:
                offsets = pa.array([0, *accumulate(map(len, outside))], pa.int32())
                cols += [pa.ListArray.from_arrays(offsets, pa.array([i for x in outside for i in x], pa.int32())), pa.array(whole, pa.bool_())]
            else:
                cols += [blank(pa.list_(pa.int32())), blank(pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "crawled", "units", "language", "features", "outside", "abstract"])

    no = F.lit(None).cast("string")
    own = pages.filter("page_id IS NOT NULL").select(
        F.col("page_id").cast("bigint").alias("page_id"), crawled().alias("crawled"), "content", F.col("title") if units else no.alias("title"),
        F.when(F.col("links").isNotNull(), F.size(F.array_compact("links"))).alias("links") if features else F.lit(None).cast("int").alias("links"),
        F.col("site_locale").cast("string") if features else no.alias("site_locale"), F.col("abstract") if field is not None else no.alias("abstract"),
    )
    return own.mapInArrow(run, SCHEMA)


def newest_scan(scan: DataFrame, cols: list[str]) -> DataFrame:
    """`cols` of each page's newest row of a scan; rows that agree in time are told apart by a hash of `cols`."""
    kept = F.struct(*cols)
    return scan.groupBy("page_id").agg(F.max_by(kept, F.struct("crawled", F.xxhash64(kept))).alias("_k")).select("page_id", "_k.*")
