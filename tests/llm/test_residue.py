import random

import pytest

from millrace.llm import residue
from millrace.llm.residue import find_residue, trusted

RESIDUE = ["Join {{ start_date }} at {{ applyUrl }}!", "Stipend: ##location##", "Error 404", "403 Forbidden", "HTTP Status 410 – Gone", "Please enable JavaScript to view this page.", "Seite nicht gefunden", "Dummy copy, dummy copy.", "[object Object]", "undefined undefined null NaN", "Coming soon", "Duise velita laborum minimo amet nostru laborum excepto.", "KeyError: 'abstract'"]
NONE = ["You will write the friendly 404 pages that visitors of the archive see when a record has moved.", "Experience with template languages, for instance Mustache tags such as {{name}}, is useful but not needed.", "Your first task is to replace the lorem ipsum left in our old brochures with real descriptions.", "Stipend: 410 each week", "Your session will expire in 4 minutes. Stay signed in", "The team studies why some portals fail when scripts are blocked, so solid JavaScript is required of every candidate."]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert trusted(text) is True


@pytest.mark.parametrize("text", ["Traceback (most recent call last):", "To read this vacancy, scripts must be allowed", "The document was not found on this host, as its link has expired, so the request failed", "Sample heading", "Body copy here", "Insert your summary", "Our database is broken"])
def test_wordings_that_no_list_holds_whole(text):
    assert trusted(text) is True


def test_sentences_are_trusted_to_be_none():
    assert trusted("The team reads old records of the town and writes a short report for the archive every week.") is False
    assert trusted("Nursing placements - https://a-b.invalid/listing/12") is None


@pytest.mark.parametrize("text", [*NONE, "", "  ", "An ordinary title"])
def test_none(text):
    assert not trusted(text)


def test_titles():
    for t in ("{{page.title}} - Org", "undefined | Some College", "404 Not Found - Org", "Untitled Document", "null | null", "@title - @org"):
        assert trusted(t, title=True)
    assert not trusted("Internship in Robotics - Some Org", title=True)


SCHEMA = "page_id long, title string, content string, last_crawled_at timestamp, text string"


def test_labels_pass_to_near_duplicates_only(spark, rows):
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrstuvwxyz"]
    marked = " ".join(words)
    near, far = " ".join([*words[:-1], "ending"]), " ".join(reversed(words))
    texts = {1: (marked, True), 2: (near, None), 3: (far, None), 4: ("lone text of few words here", None)}
    scanned = spark.createDataFrame([(u, label, t) for u, (t, label) in texts.items()], "unit long, label boolean, text string")
    assert rows(residue.residue_units(scanned)) == [(1,), (2,)]


def _runs(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_labels_reach_all_texts_of_the_least_similarity(spark, rows):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = []
    for n in (9, 14, 20, 30, 60, 120, 300):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append((base, True))
            for changes in (1, 1, 2, 3):
                other = list(base)
                for _ in range(changes):
                    other[r.choice((0, n - 1, r.randrange(n)))] = word()
                texts.append((other, None))
            texts += [(base[1:], None), ([*base, word()], None), (texts[-1][0][1:], None)]
    texts = {i: (" ".join(t), label) for i, (t, label) in enumerate(texts)}
    sets = {i: _runs(t) for i, (t, _) in texts.items()}
    like = {i: [j for j in sets if i != j and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4] for i in sets}
    expected = new = {i for i, (_, label) in texts.items() if label}
    near = {len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in expected for j in like[i]}
    assert min(near) < 0.82 and len([x for x in near if x < 0.9]) > 10
    while new:
        new = {j for i in new for j in like[i]} - expected
        expected = expected | new
    scanned = spark.createDataFrame([(u, label, t) for u, (t, label) in texts.items()], "unit long, label boolean, text string")
    assert {u for (u,) in rows(residue.residue_units(scanned))} == expected and len(expected) < len(texts)


def test_families_whose_wording_is_unknown_are_reached_from_one_member(spark, rows):
    """Half of the variants of each message carry a label; the others come through the components only."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts, expected = [], set()
    for f in range(12):
        base = [word() for _ in range(60)]
        for v in range(8):
            own = list(base)
            if v:
                own[r.choice((0, 59, r.randrange(60)))] = word()
            expected.add(len(texts))
            texts.append((len(texts), True if v % 2 == 0 else None, " ".join(own)))
    texts += [(len(texts) + i, None, " ".join(word() for _ in range(40))) for i in range(30)]
    found = {u for (u,) in rows(residue.residue_units(spark.createDataFrame(texts, "unit long, label boolean, text string")))}
    by_wording = {u for u, label, _ in texts if label}
    assert len(found & expected) >= 0.95 * len(expected) and not found - expected
    assert 3 * len(found - by_wording) >= len(found)


def test_labels_are_given_by_majority(spark, rows):
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    near = lambda k: " ".join([*words[:-1], f"ending{k}"])
    texts = [(1, True, near(1)), (2, False, near(2)), (3, False, near(3)), (4, None, near(4)), (5, True, "x"), (5, True, None), (5, False, None), (6, True, "y"), (6, False, None)]
    assert rows(residue.residue_units(spark.createDataFrame(texts, "unit long, label boolean, text string"))) == [(1,), (5,)]


def test_a_titles_label_reaches_the_same_line_of_contents(spark, rows):
    name = "Loading - Some Site Careers Portal"
    data = [(1, name, f"Home\n{name}\nAbout", None, "z"), (2, "A Post in Robotics", f"Home\n{name}", None, "z"), (3, "Untitled | Acme", "Untitled | Acme", None, "z"), (4, "A Post | Acme", "A Post | Acme", None, "z")]
    assert trusted(name) is None and trusted("Untitled | Acme") is None
    assert rows(find_residue(spark.createDataFrame(data, SCHEMA).coalesce(1))) == [(1, "content"), (1, "title"), (2, "content"), (3, "content"), (3, "title")]


def test_a_table(spark, rows):
    data = [(i, "A Post in Robotics", f"Home\n{t}\nAbout", None, "z") for i, t in enumerate(RESIDUE)] + [(50 + i, "A Post in Robotics", t, None, "z") for i, t in enumerate(NONE)]
    data += [(90, None, None, None, "z"), (91, "", "", None, "z"), (92, "Sample Page", "yx" * 100_000, None, "z"), (None, "Error 404", "Error 404", None, "z"), data[0]]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(find_residue(df)) == sorted([(i, "content") for i in range(len(RESIDUE))] + [(92, "title")], key=repr)
    assert find_residue(df.limit(0)).count() == 0
