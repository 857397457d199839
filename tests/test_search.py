import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace import config, session
from millrace.operators import fuzzy, index, rank, search
from millrace.sources.fixtures import seed

NOW = dt.datetime(2026, 7, 1)
PATIENT = config.SearchConfig(search_timeout_seconds=600)  # a cold session compiles its first plans


@pytest.fixture(scope="module")
def tables(spark):
    t = seed(spark, NOW)
    pages = t["pages"].withColumn("tags", F.concat("fields_of_study", "degree_levels"))
    return t["postings"], t["dictionary"], pages


@pytest.mark.parametrize(
    "q, major, expected",
    [
        ("computer science", "", {1: 0.834606, 4: 0.188839}),
        ("computer science", "Biology", {1: 0.782106, 4: 0.136339}),
        ("research internship", "", {1: 0.797106, 3: 0.330859, 2: 0.277691}),
    ],
)
def test_seed_scores(tables, q, major, expected):
    got = search.search(q, *tables, NOW, major=major, stemmed=True, config=PATIENT)
    assert [p["page_id"] for p in got["pages"]] == list(expected) and got["totalResults"] == len(expected)
    assert {p["page_id"]: round(p["final"], 6) for p in got["pages"]} == expected


def test_corrections_suggestions_and_empty_queries(spark, tables, rows):
    postings, words, pages = tables
    assert {p["page_id"] for p in search.search("reserch", postings, words, pages, NOW, stemmed=True, config=PATIENT)["pages"]} == {1, 2}
    assert search.search("!!!", postings, words, pages, NOW, config=PATIENT)["pages"] == []
    q = spark.createDataFrame([(1, "reserch", None, None, None), (2, "research", None, None, None), (3, None, 1, 10, ""), (4, " ", 1, 10, ""), (5, "x" * 201, 1, 10, ""), (6, "in", 0, 10, ""), (7, "in", 1, 51, "")], "query_id long, q string, page int, size int, major string")
    assert rows(search.suggest(q, words, stemmed=True)) == [(1, "reserch", ["research"])]
    assert sorted(r[0] for r in search.valid_queries(q).select("query_id").collect()) == [1, 2]


def test_pages_of_results_add_up_to_the_ranking(spark, tables):
    postings, words, pages = tables
    q = spark.createDataFrame([(i, "research internship in science", i, 1, "") for i in (1, 2, 3, 4, 9)], "query_id long, q string, page int, size int, major string")
    ranked = search.rank_queries(q, postings, words, pages, F.lit(NOW).cast("timestamp_ntz"), stemmed=True)
    got = {r["query_id"]: r["page_id"] for r in search.result_page(ranked).collect()}
    whole = [r["page_id"] for r in ranked.filter("query_id = 1").orderBy(F.col("final").desc(), "page_id").collect()]
    assert [got[i] for i in (1, 2, 3, 4)] == whole and 9 not in got
    assert search.counts(ranked).filter("query_id = 1").first()["pages_count"] == 4


def test_signals(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    ts = lambda d: F.lit(NOW + dt.timedelta(days=d)).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    assert [one(rank.trust(F.lit(t))) for t in (0, 1, 2, 9)] == [1.0, 1.0, 0.5, 0.0] and one(rank.trust(F.lit(5), 1)) == 1.0
    assert [round(one(rank.freshness(p, none, ts(0))), 6) for p in (ts(1), ts(-14), none)] == [1.0, 0.5, 0.5]
    assert [one(rank.urgency(x, ts(0))) for x in (none, ts(-1), ts(60), ts(30))] == [0.5, 0.0, 0.0, 0.5]
    assert one(rank.field_of_study(rank.words_of(F.lit("")), F.array(F.lit("a")), F.array(F.lit("a")))) == 0.5 and one(rank.field_of_study(rank.words_of(F.lit("x")), F.array(F.lit("a")), F.array(F.lit("a")))) == 0.15
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 7.0)], "g int, v double")
    assert sorted(tuple(r) for r in rank.min_max(df, ["g"], "v", "s").select("g", "s").collect()) == [(1, 1.0), (2, 0.0), (2, 1.0)]


def test_near_words_against_all_pairs(spark, rows):
    def distance(a, b):
        a, b = a.lower().encode(), b.lower().encode()
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = ["biolog", "biologe", "geolog", "art", "arts", "naive", "naïve", "a", "", "zz", "biolgo"]
    tokens = ["biolg", "naïv", "ar", "b", "qqqq", "biolog"]
    w = spark.createDataFrame([(x, len(x)) for x in words], "word string, frequency long")
    t = spark.createDataFrame([(x,) for x in [*tokens, None]], "token string")
    expected = []
    for a in tokens:
        near = [(distance(a, b), b) for b in words if distance(a, b) <= 2]
        expected += [(a, b, len(b), d) for d, b in near if d == min(near)[0]]
    assert rows(fuzzy.near_words(t, w)) == sorted(expected, key=repr)


def test_postings_last_place_wins(spark, rows):
    e = spark.createDataFrame([(1, 0, 20, ["a", "b", "a"]), (1, 1, 1, ["b"])], "page_id long, elem_idx int, score int, t array<string>")
    words = index.place_words(e, "t")
    assert rows(index.postings(words)) == [("a", 1, 20, 2), ("b", 1, 1, 3)]
    assert rows(index.dictionary(words)) == [("a", 1), ("b", 2)]
    assert rows(index.postings(words, agg="max")) == [("a", 1, 20, 2), ("b", 1, 20, 3)]


def test_ids_are_dense_and_stable(spark):
    u = spark.createDataFrame([(f"https://{i}.example",) for i in range(50)] + [(None,), ("https://1.example",)], "url string")
    first = index.assign_ids(u.limit(20))
    both = {r["url"]: r["page_id"] for r in index.assign_ids(u, first).collect()}
    assert sorted(both.values()) == list(range(1, 51)) and all(both[r["url"]] == r["page_id"] for r in first.collect())


def test_refused_settings():
    for bad in (dict(half_life_hours=0), dict(urgency_window_hours=-1), dict(no_deadline_urgency=2), dict(max_trust_tier=0)):
        with pytest.raises(ValueError):
            config.RankerConfig(**bad)
    for bad in (dict(relevance=0.5), dict(relevance=-0.35, trust=0.8)):
        with pytest.raises(ValueError):
            config.Weights(**bad)
    for bad in ("0", "x", "-1"):
        with pytest.raises(ValueError):
            config.page_number(bad)
    for bad in ("0", "51", "x"):
        with pytest.raises(ValueError):
            config.page_size(bad)
    for bad in (None, " ", "x" * 201):
        with pytest.raises(ValueError):
            config.query_text(bad)
    assert config.page_number(" ") == 1 and config.page_size(None) == 10 and config.profile_text(" a ") == "a"
    assert config.SearchConfig.from_settings({"FUZZY_TOLERANCE": "1", "MAX_PAGE_SIZE": "x"}).max_page_size == 50


def test_pages_of_results_with_a_bound(spark, rows):
    ranked = spark.createDataFrame([(q, i, float(i % 7), 2, 3) for q in (1, 2) for i in range(50)], "query_id long, page_id long, final double, page int, size int")
    most = search.last_place(ranked.select("page", "size"))
    cols = ["query_id", "page_id", "place"]
    assert most == 6 and rows(search.result_page(ranked, most).select(cols)) == rows(search.result_page(ranked).select(cols)) and search.result_page(ranked, most).count() == 6
    assert search.last_place(ranked.limit(0)) == 0


def test_dates_in_any_form_count(spark, rows):
    pages = spark.createDataFrame([(1, "2 March 2026", "2026-07-04T10:00:00+02:00", "Europe/Berlin", "de-DE"), (2, "03/02/2026", "soon", "America/New_York", "en-US")], "page_id long, posted_at string, deadline_at string, site_zone string, site_locale string")
    for c in ("url", "title", "abstract", "organization", "location"):
        pages = pages.withColumn(c, F.lit("x"))
    pages = pages.withColumns({"trust_tier": F.lit(1), "last_crawled_at": F.lit(NOW).cast("timestamp"), "fields_of_study": F.array(F.lit("a")), "degree_levels": F.lit(None).cast("array<string>"), "remote": F.lit(False)})
    got = rows(search.listings(pages).select("page_id", "posted_at", "deadline_at"))
    assert got == [(1, dt.datetime(2026, 3, 1, 23), dt.datetime(2026, 7, 4, 8)), (2, dt.datetime(2026, 3, 2, 5), None)]


def test_health_timeouts_and_requests(spark, tables):
    assert search.health(spark, seconds=60)["status"] == "ok" and search.health(spark, "/nowhere/at/all", 60)["status"] == "degraded"
    with pytest.raises(TimeoutError):
        session.within_seconds(spark, 0.2, lambda: __import__("time").sleep(3))
    assert session.within_seconds(spark, 0, lambda: 5) == 5
    assert search.client_request("q", " ", "phd") == {"q": "q", "page": 1, "size": 10, "degree": "phd"}
    df = spark.createDataFrame([(" ", None, ""), ("a", None, None)], "a string, b string, c string")
    assert [r[0] for r in df.select(search.is_empty_profile(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False]


def test_a_page_by_its_id(spark, rows):
    pages = spark.createDataFrame([(1, "old", dt.datetime(2026, 1, 1)), (1, "new", dt.datetime(2026, 1, 2)), (2, "b", None)], "page_id long, title string, last_crawled_at timestamp")
    assert rows(search.page_by_id(pages, 1).select("title")) == [("new",)] and search.page_by_id(pages, 9).count() == 0


def test_stored_postings_answer_as_the_given_ones(spark, rows):
    post = spark.createDataFrame([("in", i, 1, i) for i in range(60)] + [("in", 3, 9, 99), ("x", 1, 2, 3), (None, 1, 1, 1), ("y", None, 1, 1)], "word string, page_id long, score int, position int")
    stored, words = search.search_index(post)
    assert rows(stored.select("word", "page_id", "score", "position")) == rows(search.clean_postings(post).select("word", "page_id", "score", "position")) and rows(words) == [("in", 60), ("x", 1)]


def test_candidates_are_neither_stored_nor_shuffled(spark, tables, rows):
    _, _, pages = tables
    many = pages.filter("page_id IN (1, 3)").drop("page_id").crossJoin(spark.range(150).withColumnRenamed("id", "n")).withColumn("page_id", F.col("n") * 2 + F.col("trust_tier"))
    postings = many.select(F.explode(F.array(F.lit("research"), F.lit("internship"))).alias("word"), "page_id").withColumns({"score": F.lit(1), "position": F.lit(2)})
    asked = [("research internship", ""), ("Internship RESEARCH", "biology"), ("research in internship", "Computer"), ("reserch", ""), ("research research", "")]
    q = spark.createDataFrame([(i, *asked[i % 5][:1], 1, 10, asked[i % 5][1]) for i in range(100)], "query_id long, q string, page int, size int, major string")
    index_of, now = search.search_index(postings), F.lit(NOW).cast("timestamp_ntz")
    before = len(session._written)
    ranked = search.rank_queries(q, *index_of, many, now)
    most = max(spark.read.parquet(path).count() for path in session._written[before:])
    assert ranked.count() == 30_000 and most < 3_000
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" in plan and "hashpartitioning(query_id" not in plan and "hashpartitioning(wording" not in plan
    cols = ["page_id", "hits_count", "hits_sum", "positional_distance", "raw", "relevance", "field_match", "study", "final"]
    for i in (2, 3):  # what one that asks alone is answered
        alone = search.rank_queries(q.filter(F.col("query_id") == i), *index_of, many, now)
        assert rows(ranked.filter(F.col("query_id") == 95 + i).select(cols)) == rows(alone.select(cols))


def test_few_rows_are_within_reach_of_a_page(spark, rows):
    asked = spark.createDataFrame([(1, 1, 3), (2, 2, 3), (3, 1, 50), (4, 1, 1), (5, 1, 2)], "query_id long, page int, size int")
    own = F.when(F.col("query_id") == 4, 0.5).when((F.col("query_id") == 5) & (F.col("page_id") % 2 == 0), None).otherwise(F.pmod(F.xxhash64("page_id", "query_id"), F.lit(97)) / 97)  # ties and nulls too
    ranked = asked.crossJoin(spark.range(3000).withColumnRenamed("id", "page_id")).filter("query_id <> 3 OR page_id < 90").withColumn("final", own)
    most = search.last_place(asked)
    some = search.within_reach(ranked, most)
    assert rows(search.result_page(some, most)) == rows(search.result_page(ranked)) and ranked.count() == 12_090
    left = {r["query_id"]: r["count"] for r in some.groupBy("query_id").count().collect()}
    assert left[3] == 90 and max(left[i] for i in (1, 2, 4, 5)) < 600
