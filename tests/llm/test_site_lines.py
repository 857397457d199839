from millrace.llm.site_lines import find_repeated_lines, page_lines, repeated_blocks, repeated_graph, without_repeated_lines

SCHEMA = "page_id long, url string, content string, last_crawled_at timestamp, line_no string"


def pages(spark, extra=()):
    rows = []
    for i in range(20):
        own = f"only {i}\n\nMenu  item\nHome\nbody {i}" if i % 2 else f"body {i}\n HOME "
        rows.append((i, f"https://{'www.' if i % 3 else 'Sub.'}Site.example:8080/p/{i}?q=1", own, None, "z"))
    rows += [(100 + i, f"http://other.test/{i}", "Home\nmenu item", None, "z") for i in range(4)]  # too few pages
    rows += [(200 + i, "https://third.test/x", "rare" if i < 5 else f"a {i}", None, "z") for i in range(30)]  # 5 of 30 is too small a share
    return spark.createDataFrame([*rows, rows[0], *extra], SCHEMA)


def test_against_counting(spark, rows):
    expected = [(i, n) for i in range(20) for n in ([3, 4] if i % 2 else [2])]
    odd = [(None, "https://site.example/", "home", None, "z"), (300, None, "home", None, "z"), (301, "https://site.example/", None, None, "z"), (302, "https://site.example/", "", None, "z"), (303, "https://site.example/", "x" * 300_000 + "\nhome", None, "z")]
    got = find_repeated_lines(pages(spark, odd))
    assert rows(got.select("page_id", "line_no")) == sorted([*expected, (303, 2)], key=repr)
    assert find_repeated_lines(pages(spark).limit(0)).count() == 0


def test_blocks_are_of_lines_that_follow_each_other(spark):
    content = "alpha\nbeta\nbody {0}\ngamma\ndelta"
    df = spark.createDataFrame([(i, "https://s.example/", content.format(i), None, "") for i in range(10)], SCHEMA)
    found = repeated_graph(page_lines(df))[0].collect()
    assert len(found) == 4 and sorted(sum(r["block"] == b for r in found) for b in {r["block"] for r in found}) == [2, 2]
    assert all(r["pages"] == 10 for r in found)


def test_cleaned_contents(spark):
    got = {r["page_id"]: (r["content"], r["removed"]) for r in without_repeated_lines(pages(spark, [(301, "https://site.example/", None, None, "z")])).collect()}
    assert got[1] == ("only 1\n\nbody 1", 2) and got[0] == ("body 0", 1) and got[301] == (None, 0) and got[100] == ("Home\nmenu item", 0)


def test_occurrences_of_blocks_are_deleted_whole(spark, rows, monkeypatch):
    """Empty lines within a block go with it, those between repeated lines that aren't linked stay."""
    content = ["alpha\n\nbeta\nbody {0}\n\ngamma\n\nbody", "gamma\n\nalpha\n \nbeta\nbody {0}"]
    df = spark.createDataFrame([(i, "https://s.example/", content[i == 9].format(chr(97 + i) * 3), None, "") for i in range(10)], SCHEMA)
    got = {r["page_id"]: (r["content"], r["removed"]) for r in without_repeated_lines(df).collect()}
    assert got[0] == ("body aaa\n\n\nbody", 4) or got[0] == ("body aaa\n", 6)
    assert got[9] == ("\nbody jjj", 4)
    blocks = rows(repeated_blocks(df).select("lines", "most_pages"))
    assert (2, 10) in blocks
    from millrace.llm import site_lines

    whole = site_lines.repeated_graph
    monkeypatch.setattr(site_lines, "repeated_graph", lambda *a: (whole(*a)[0], whole(*a)[1].limit(0)))
    assert {r["page_id"]: r["content"] for r in without_repeated_lines(df).collect()}[9] == "\n \nbody jjj"  # the graph makes the difference
