import random

from millrace import queries
from millrace.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_against_brute_force(spark, rows):
    r = random.Random(4)
    words = sorted({"nternship", "internship", "naïve", "naive", "a", "it", "ti"} | {"".join(r.choices("abc", k=r.randint(3, 9))) for _ in range(60)})
    got = rows(fuzzy.near_pairs(spark.createDataFrame([(w,) for w in [*words, None, "it"]], "word string")).select("a", "b", "distance"))
    every = [(a, b, edits(a.encode(), b.encode())) for a in words for b in words if a < b]
    assert got == sorted([x for x in every if x[2] <= 2], key=repr) and ("internship", "nternship", 1) in got


def test_long_and_short_words_cost_their_length(spark, rows):
    words = spark.createDataFrame([("x" * 3000, 1), ("x" * 2999 + "y", 2), ("a", 3), ("", 4)], "word string, frequency long")
    tokens = spark.createDataFrame([("x" * 2998,), ("ab",), ("abcd",), (None,)], "token string")
    got = rows(fuzzy.near_words(tokens, words).select("token", "frequency", "distance"))
    assert got == sorted([("x" * 2998, 1, 2), ("x" * 2998, 2, 2), ("ab", 3, 1)], key=repr)


def test_every_language_is_sanitised(spark, rows, tmp_path):
    data = [(1, "Straße 5!", "de"), (2, "Straße 5!", None), (3, "Straße", "DE"), (4, "ひらがな abc", "ja"), (5, "né-e", "und"), (6, None, "de"), (7, "It’s", "EN"), (8, "né", "fr")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {i: list(t) for i, t in rows(queries.QUERIES["sanitize_multilang"](spark, str(tmp_path)))}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8}
    assert got[1] == ["straße", "5"] and got[2] == ["strae", "5"] and got[3] == ["straße"] and got[4] == ["ひらがな", "abc"] and got[5] == ["ne"] and got[7] == ["its"] and got[8] == ["né"]


def test_the_whole_frontier(spark, rows, tmp_path):
    spark.createDataFrame([(10, 1), (20, 2), (30, 1), (31, 3)], "page_id long, trust_tier int").write.parquet(f"{tmp_path}/web_pages.parquet")
    links = [(10 + i, 11 + i) for i in range(7)] + [(16, 10), (20, 21), (30, 12)]
    spark.createDataFrame(links, "src_id long, dst_id long").write.parquet(f"{tmp_path}/link_edges.parquet")
    assert rows(queries.QUERIES["frontier_bfs"](spark, str(tmp_path))) == [(10, 0), (11, 1), (12, 1), (13, 2), (14, 3), (15, 4), (16, 5), (17, 6), (30, 0)]
