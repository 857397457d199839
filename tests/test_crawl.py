import pytest
from pyspark.sql import functions as F

from millrace.plans import crawl
from millrace.session import durable, scope, shared_folder
from millrace.sources.fetch import fetch_pages
from millrace.streaming import increment


def test_allowlists():
    assert crawl.parse_allowlist(["A.edu:1", "b.org", "c.net:0", " ", "a.edu:2"]) == {"a.edu": 2, "b.org": 3, "c.net:0": 3}
    assert crawl.parse_allowlist(["a.edu:1", "*"]) == {}
    assert crawl.seed_urls(" https://a.example, ,https://b.example") == ["https://a.example", "https://b.example"]
    with pytest.raises(ValueError):
        crawl.seed_urls(" , ")


def test_tiers(spark, rows):
    pages = spark.createDataFrame([(1, "https://x.a.example/"), (2, "https://b.example"), (3, None)], "page_id long, url string")
    allow = spark.createDataFrame([("A.example", 1)], "domain string, tier int")
    assert rows(crawl.with_tier(pages, allow).select("page_id", "trust_tier")) == [(1, 1), (2, 3), (3, 3)]
    assert rows(crawl.allowed(pages, allow).select("page_id")) == [(1,)]
    assert rows(crawl.seed_domains(spark, ["https://x.a.example", "bad"])) == [("a.example", 3)]


def test_rounds(spark, rows):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (1, 1), (2, 5), (None, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert rows(crawl.breadth_first(links, seeds, 5)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 2)]
    assert rows(crawl.breadth_first(links, seeds, 5, most=3)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(crawl.breadth_first(links, seeds.limit(0), 5)) == []


def test_limits_take_the_smallest_of_the_last_round(spark, rows):
    links = spark.createDataFrame([(0, i) for i in range(1, 900)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert rows(crawl.breadth_first(links, seeds, 3, most=300)) == sorted([(0, 0)] + [(i, 1) for i in range(1, 300)], key=repr)
    assert rows(crawl.breadth_first(links, seeds, 3, most=1)) == [(0, 0)]


def test_a_queue(spark, rows):
    make = lambda data: spark.createDataFrame(data, "url string, place long")
    queue, visited = make([("a", 1), ("b", 2)]), spark.createDataFrame([("v",)], "url string")
    queue = crawl.enqueue(queue, visited, make([("c", 0), ("v", 1), ("a", 2), ("d", 3), ("c", 4), (None, 5)]))
    first, queue = crawl.dequeue(queue, 3)
    assert rows(first.select("url")) == [("a",), ("b",), ("c",)] and rows(queue.select("url")) == [("d",)]
    assert rows(crawl.enqueue(queue.limit(0), visited, make([("x", 7)]))) == [("x", 8)]


def test_progress():
    assert crawl.progress(25, 100, 50.0) == {"added": 25, "limit": 100, "percent": 25, "remaining": "00h:02m:30s"}
    assert crawl.progress(0, 100, 5.0)["remaining"] is None and crawl.progress(7, 0, 1.0)["percent"] == 0 and crawl.progress(200, 100, 1.0) == {"added": 200, "limit": 100, "percent": 100, "remaining": "00h:00m:00s"}


def test_fetched_pages(spark, rows):
    import http.server
    import threading

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/there")
                self.end_headers()
                return
            self.send_response(200 if self.path == "/there" else 404)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write(f"<p>é {self.headers['User-Agent']}".encode("iso-8859-1"))

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{at}/moved",), (f"{at}/gone",), (f"{at}/moved",), ("nonsense",), (None,), ("http://127.0.0.1:1/",)], "url string")
    got = {u: (s, h, e) for u, s, h, e in rows(fetch_pages(urls, 5.0, "me", 2))}
    server.shutdown()
    assert got == {f"{at}/moved": (200, "<p>é me", None), f"{at}/gone": (404, None, "status 404"), "nonsense": (None, None, "ValueError"), "http://127.0.0.1:1/": (None, None, "URLError")}
    assert fetch_pages(urls.limit(0)).count() == 0


def test_scopes_remove_their_tables(spark):
    with scope(spark):
        df = durable(spark.range(3), "own")
        path = df.inputFiles()[0]
        assert df.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_index_of_raw_pages(spark, rows):
    html = '<title>Summer research</title><p>The summer internships are for students of the biology department.</p><a href="/b">x</a><script type="application/ld+json">{"@type":"JobPosting","datePosted":"2026-01-02","hiringOrganization":{"name":"Org"}}</script>'
    raw = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://a.example/c", None)], "page_id long, url string, html string")
    pages = crawl.extract(raw, F.lit("2026-02-01").cast("timestamp_ntz"))
    first = pages.filter("page_id = 1").first()
    assert first["organization"] == "Org" and first["fields_of_study"] == ["biology"] and first["posted_at"].year == 2026
    tables = crawl.build_index(pages)
    words = {r["word"]: (r["score"], r["position"]) for r in tables["postings"].collect()}
    assert words["research"] == (20, 1) and words["summer"] == (1, 3) and "internship" in words
    assert tables["dictionary"].filter("word = 'summer'").first()["frequency"] == 2
    assert rows(tables["page_ids"]) == [("https://a.example/", 1), ("https://a.example/b", 3), ("https://a.example/c", 2)]
    assert rows(tables["links"]) == [(1, 3)]


def test_a_stream_adds_each_page_once(spark):
    folder = shared_folder(spark) + "/test-stream"
    pages = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "page_id long, url string")
    for _ in range(2):
        pages.write.mode("append").parquet(f"{folder}/in")
        increment.follow(spark.readStream.schema(pages.schema).parquet(f"{folder}/in"), f"{folder}/store", f"{folder}/state").awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(f"{folder}/store").collect()) == ["a", "b"]
    increment.add_pages(pages, 0, f"{folder}/store")  # a batch that is run again leaves the store as it was
    increment.add_pages(pages, 1, f"{folder}/store")
    assert sorted(r["url"] for r in spark.read.parquet(f"{folder}/store").collect()) == ["a", "b"]
