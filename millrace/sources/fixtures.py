"""A small fixture: four listings with title postings, for trials and tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from millrace import schemas
from millrace.functions.text import stem_english

# The listings of the fixture; days are before or after its moment.
LISTINGS = [
    (1, "Summer Research Internship in Computer Science", "Example University", 1, 5, 21, ["computer science"], ["undergraduate"], "Cambridge, MA", False, "https://example.edu/op/1"),
    (2, "Undergraduate Research Opportunity in Biology", "Example University", 1, 60, None, ["biology"], ["undergraduate", "graduate"], "Cambridge, MA", False, "https://example.edu/op/2"),
    (3, "Software Engineering Internship", "Example Corp", 2, 2, 45, ["computer science", "software engineering"], ["undergraduate"], "", True, "https://example.com/careers/3"),
    (4, "Data Science Fellowship", "Example Policy Institute", 3, 150, None, ["data science", "public health"], ["phd"], "New York, NY", False, "https://example.org/fellowship/4"),
]


def seed(spark: SparkSession, now: dt.datetime) -> dict[str, DataFrame]:
    """The tables pages, postings and dictionary of the fixture at a moment."""
    day = dt.timedelta(days=1)
    pages = [(i, url, title, "", "", org, tier, now - d * day, now, now + n * day if n else None, studies, levels, place, remote) for i, title, org, tier, d, n, studies, levels, place, remote, url in LISTINGS]
    words = [(stem_english(w.lower()), i, 1, k) for i, title, *_ in LISTINGS for k, w in enumerate(title.split())]
    postings = spark.createDataFrame(words, schemas.POSTINGS)
    return {"pages": spark.createDataFrame(pages, schemas.PAGES), "postings": postings, "dictionary": postings.groupBy("word").count().withColumnRenamed("count", "frequency")}
