import random

from millrace.llm.spam import find_spam

SCHEMA = "page_id long, content string, links array<string>, site_locale string, last_crawled_at timestamp, distance string"


def prose(r):
    nouns = "archive river team record map letter student summer library museum glacier harbour engine".split()
    verbs = "measures reads compares draws collects explains repairs describes".split()
    line = lambda: f"The {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} for the {r.choice(nouns)}, and you will see how it {r.choice(verbs)} the {r.choice(nouns)}."
    return "\n".join(["Home", " ".join(line() for _ in range(4)), "About us", " ".join(line() for _ in range(r.randint(2, 6))), "Share | Print"])


def test_planted_spam(spark, rows):
    r = random.Random(1)
    good = [(i, prose(r), [f"https://a.example/{k}" for k in range(r.randint(0, 9))], "en-GB", None, "z") for i in range(150)]
    words = ["jobs", "remote", "nursing", "cheap", "internships", "best"]
    spam = [
        (1000, "Home\n" + " ".join(r.choices(words, k=120)), None, "en-GB", None, "z"),
        (1001, "\n".join(f"Tag: {r.choice(words)} / {r.choice(words)} / {i}" for i in range(40)), [], "en-GB", None, "z"),
        (1002, "\n".join(f"Nursing jobs - https://a.example/{i}" for i in range(40)) + "\nThis is a stray sentence that we leave in the page for you.", ["https://a.example/1", None], "fr-FR", None, "z"),
        (1003, "best " * 20_000, None, "en-GB", None, "z"),
        (1004, " | ".join(f"#{r.choice(words)}" for _ in range(60)), None, None, None, "z"),
        (1005, "Cheap posts\nBest jobs\nNursing abroad\nOther boards\nMore lists", [f"https://a.example/{k}" for k in range(80)], "en-GB", None, "z"),  # only its links tell
    ]
    none = [(2000, None, None, "en-GB", None, "z"), (2001, "", [f"https://a.example/{k}" for k in range(80)], None, None, "z"), (2002, " \n ", None, "en-GB", None, "z"), (2003, "Error 404", None, "en-GB", None, "z"), (2004, prose(r) + "\n" + prose(r), [f"https://a.example/{k}" for k in range(80)], "en-GB", None, "z"), (2005, "Home\nNews\nStaff\nHelp\nAbout us", [], "en-GB", None, "z"), (None, spam[0][1], None, "en-GB", None, "z"), good[0], spam[0]]
    df = spark.createDataFrame([*good, *spam, *none], SCHEMA)
    assert rows(find_spam(df)) == [(i,) for i in range(1000, 1006)]
    assert find_spam(df.limit(0)).count() == 0
