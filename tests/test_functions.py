import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import fields, stemming, text, urls
from millrace.functions.language import language_of
from millrace.functions.html import read_page, read_pages, resolve_link


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column()).first()[0]


def the(f, *args, **kwargs):
    """A function of the column v, built when a session is there."""
    return lambda: f(F.col("v"), *args, **kwargs)


def test_words(spark):
    assert one(spark, the(text.fields), " a b\t c  ") == ["a", "b", "c"]
    assert one(spark, the(text.tokens), "State-of-the-art! !!! Straße,") == ["stateoftheart", "strae"]
    assert one(spark, the(text.tokens, "german"), "Straße,") == ["straße"]
    assert one(spark, the(text.tokens, stop=["the"]), "the cat the") == ["cat"]
    assert one(spark, the(text.tokens), None) is None and one(spark, the(text.tokens), "") == []
    assert one(spark, the(lambda c: text.byte_distance(c, F.lit("naive"))), "naïve") == 2
    assert one(spark, the(text.byte_prefix, 2), "aé") == "a�"


def test_stems():
    known = {"summer": "summer", "research": "research", "computer": "comput", "science": "scienc", "undergraduate": "undergradu", "opportunity": "opportun", "biology": "biolog", "engineering": "engin", "generously": "generous", "skies": "sky", "knightly": "knight", "hopping": "hop", "hoping": "hope", "national": "nation", "inning": "inning", "news": "news", "agreed": "agre", "cries": "cri", "ties": "tie", "by": "by"}
    assert {w: text.stem_english(w) for w in known} == known


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefghilmnorstuyzé'", max_size=14))
def test_stems_never_grow(word):
    assert len(text.stem_english(word)) <= len(word) + 1


def test_languages():
    assert text.language_of("The group meets in the archive and you will be with us")[0] == "english"
    assert text.language_of("Die Gruppe trifft sich und wir sind nicht bei den Akten")[0] == "german"
    assert text.language_of("") == ("english", 0.0)


def test_named_fields(spark):
    assert one(spark, the(fields.fields_of_study), "Fine arts, data science; party") == ["data science", "art"]
    assert one(spark, the(fields.degree_levels), "a PhD or master's degree") == ["graduate", "phd"]
    assert one(spark, the(fields.is_remote), "Work from home") is True and one(spark, the(fields.is_remote), "remotely") is False


def test_dates(spark):
    d = lambda v: one(spark, the(fields.deadline), v)
    assert d("Apply by February 31, 2026") == dt.date(2026, 3, 3)
    assert d("Deadline 13/1/2026") is None
    assert d("deadline" + " " * 61 + "3/1/2026") is None
    assert d("Founded 3/1/2020. Due by 4/1/2026") == dt.date(2026, 4, 1)
    assert d(None) is None and d("deadline soon; apply by 3/2/2026") == dt.date(2026, 3, 2)
    j = lambda v: one(spark, the(fields.json_date), v)
    assert j("2026-01-02") == dt.datetime(2026, 1, 2) and j("2026-01-02T03:04:05+02:00") == dt.datetime(2026, 1, 2, 1, 4, 5)
    assert j("2026") is None and j("2026-1-2") is None and j("") is None


def test_postings(spark):
    p = lambda v, f: one(spark, the(lambda c: f(fields.job_posting(c))), v)
    there = lambda x: x.isNotNull()
    assert p('{"@type":"jobposting"}', there) and p('[{"@type":"X"},{"@type":"JobPosting"}]', there)
    assert not p('{"@type":["JobPosting"]}', there) and not p("{broken", there) and not p(None, there) and not p('{"@type":"JobPosting","datePosted":5}', there)
    assert p('{"@type":"JobPosting","jobLocation":[{"address":{}},{"address":{"addressRegion":"R"}}]}', fields.job_location) == "R"
    assert p('{"@type":"JobPosting","educationRequirements":{"credentialCategory":"","name":"n"}}', fields.education) == "n"
    assert p('{"@type":"JobPosting","educationRequirements":"PhD"}', fields.education) == "PhD"


def test_urls(spark):
    assert one(spark, the(urls.registrable_domain), "https://A.B.example.CO.uk:80/x") == "example.co.uk"
    assert one(spark, the(urls.registrable_domain), "https://jobs.site.example/") == "site.example"
    assert one(spark, the(urls.registrable_domain), "mailto:x") is None and one(spark, the(urls.host), None) is None
    assert resolve_link("https://a.example/b/", "../c#d") == "https://a.example/c"
    assert resolve_link("https://a.example", "mailto:x@y") is None and resolve_link("https://a.example", " ") is None


def test_pages():
    html = """<title> </title><title>T</title><meta property="og:description" content=" D "><h1>Head <b>bold</h1><p>one<script>"</p>"</script> two<p>three
      <a href="/x#y">l</a><a href="mailto:z">m</a><script type="application/ld+json"> {"a":1} </script><h6>six</h6>"""
    page = read_page(html, "https://a.example/")
    assert page["title"] == "T" and page["abstract"] == "D" and page["links"] == ["https://a.example/x"] and page["json_ld"] == ['{"a":1}']
    assert [(tag, t.split()[0]) for tag, t in page["elements"] if t.strip()] == [("title", "T"), ("h1", "Head"), ("p", 'one"</p>"'), ("p", "three"), ("h6", "six")]
    assert read_page("<p>" + "x" * 20 + "</p><p>" + "y" * 21, "")["abstract"] == "y" * 21
    assert read_page(None, None)["elements"] == []


def test_tags_that_end_others():
    page = read_page("<ul><li><p>a<li><p>b</ul><h2>c<h3>d</h3>e</h2><table><tr><td><p>f<td>g<tr><td><p>h</table><dl><dt>i<dd><p>j<dt>k</dl>", "")
    assert [(tag, t) for tag, t in page["elements"]] == [("p", "a"), ("p", "b"), ("h2", "c"), ("h3", "d"), ("p", "f"), ("p", "h"), ("p", "j")]
    deep = read_page("<div><p>" * 20_000 + "x", "")
    assert len(deep["elements"]) == 20_000 and deep["content"].strip() == "x"


def test_suffixes(spark):
    d = the(urls.registrable_domain)
    for url, expected in {"https://a.x.co.il": "x.co.il", "https://a.x.edu.sg": "x.edu.sg", "https://x.gov.in": "x.gov.in", "https://gov.in": None, "https://a.co.de": "co.de", "https://a.b.github.io": "b.github.io", "https://a.b.ac.uk": "b.ac.uk", "https://co.uk": None, "https://a.b.com": "b.com"}.items():
        assert one(spark, d, url) == expected, url
    assert one(spark, the(lambda u: urls.registrable_domain(u, ["b.test"])), "https://x.a.b.test") == "a.b.test"


@pytest.mark.parametrize("stemmer, pairs", [
    (stemming.stem_german, "aufeinander aufeinand, häuser haus, kategorien kategori, aufgegessen aufgegess, bedürfnisse bedurfnis, freundlichkeit freundlich, straße strass, arbeitung arbeit"),
    (stemming.stem_french, "continuellement continuel, majestueuse majestu, nationalités national, chevaux cheval, heureusement heureux, finissons fin, abandonnées abandon"),
    (stemming.stem_spanish, "chicas chic, torreón torreon, trabajando trabaj, rápidamente rapid, organizaciones organiz, llamándose llam, nacionalidades nacional"),
    (stemming.stem_english, "internships internship, studies studi, generously generous, relational relat, skies sky"),
])
def test_stems_of_the_published_definitions(stemmer, pairs):
    for pair in pairs.split(", "):
        word, stem = pair.split()
        assert stemmer(word) == stem
    assert [stemmer(w) for w in ("", "a", "ab")] == ["", "a", "ab"]


def test_languages():
    for text, language in {"Das Team liest alte Akten und schreibt jede Woche einen Bericht für das Archiv.": "german", "L'équipe lit les dossiers et rédige chaque semaine un rapport.": "french", "El equipo lee los archivos y escribe cada semana un informe.": "spanish", "The team reads old records and writes a report every week.": "english",
                           "Команда читает старые записи и пишет отчёт": "russian", "Η ομάδα διαβάζει παλιά αρχεία": "greek", "يقرأ الفريق السجلات القديمة": "arabic", "チームは古い記録を読みます": "japanese", "团队阅读旧记录": "chinese", "팀은 오래된 기록을 읽습니다": "korean", "Zespół czyta stare akta i pisze raporty w archiwum": "polish"}.items():
        assert language_of(text)[0] == language and language_of(text)[1] >= 0.6, text
    assert language_of(None) == language_of("") == language_of(" 12 - ") == ("english", 0.0)


def test_words_of_fields_in_one_reading(spark):
    named = lambda t: set(one(spark, the(fields.named), t))
    assert named("Computational Biology and post-doctoral arts") == {"computational biology", "biology", "post-doctoral", "doctoral", "art"}
    assert named("a Bachelor's, master's degrees; undergraduates") >= {"bachelor's", "bachelor", "master's degree", "master's", "undergraduate"} and named("smart historyx") == set()
    text = "é" * 40 + " Apply by March 4, 2026"
    assert one(spark, the(fields.deadline), text) == dt.date(2026, 3, 4)
    assert one(spark, the(fields.deadline), "Apply by " + "é" * 40 + " 1/2/2026") is None  # 60 bytes, not characters


def test_the_first_of_several_postings(spark):
    blocks = ["{broken", '{"@type":"Person"}', '{"@type":"JobPosting","hiringOrganization":{"name":"One"},"datePosted":"2026-01-02T03:04:05+02:00"}', '{"@type":"JobPosting","hiringOrganization":{"name":"Two"}}']
    df = spark.createDataFrame([("t", "a", "c", blocks), ("t", "a", "c", None)], "title string, abstract string, content string, json_ld array<string>")
    got = [(r["organization"], r["posted_at"]) for r in fields.with_listing_fields(df).collect()]
    assert got == [("One", dt.datetime(2026, 1, 2, 1, 4, 5)), ("", None)]


def test_pages_of_a_table(spark):
    raw = spark.createDataFrame([(1, "https://a.example", "<p>é" + "x" * 200 + "</p>"), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in read_pages(raw, ["page_id"]).collect()}
    assert len(got[1]["abstract"].encode()) == 150 and got[2]["title"] == "" and got[2]["elements"] == []
