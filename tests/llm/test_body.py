import itertools
import random

from millrace.llm import body, cues, line_tokens, queries


def page(r):
    outside = ["Skip to main content", "Home | About | Contact", "Share | Print | Save | Report this listing", "© 2021 Some College. All rights reserved.", "Subscribe to our newsletter: enter your e-mail", "This site uses cookies to count visits. Accept all", "Related: internships in Robotics, Townham", "Posted by A. Writer on 3 March 2024"]
    inside = ["The team reads old records every week and writes a short report for the archive.", "We ask for clear writing, some patience, and the will to learn about rivers and maps.", "• a library card from March", "Stipend: 400 a month", "You will report to the head of the workshop, who also looks after the boats."]
    before, after = r.sample(outside, r.randint(1, 3)), r.sample(outside, r.randint(1, 3))
    main = r.sample(inside, r.randint(2, 4))
    return before + main + after, [False] * len(before) + [True] * len(main) + [False] * len(after)


def test_held_out_accuracy_and_viterbi():
    r = random.Random(7)
    train = [(*page(r), "", None) for _ in range(120)]
    field = body.fit(train, steps=60)
    right = total = 0
    for _ in range(60):
        lines, truth = page(r)
        got = field.decode(lines)
        right += sum(a == b for a, b in zip(got, truth))
        total += len(truth)
    assert right / total > 0.97
    lines = page(r)[0][:6]  # Viterbi against all labellings
    n, w = len(lines), field.weights

    def score(labels):
        s = 0.0
        for i, b in enumerate(labels):
            if b:
                s += sum(w.get(f, 0.0) for f in [*body.block_features(lines[i]), *body.context_features(i, n, lines[i] in lines[:i], False)])
            if i:
                s += field.moves[int(labels[i - 1])][int(b)]
        return s

    best = max(itertools.product((False, True), repeat=n), key=score)
    assert abs(score(best) - score(field.decode(lines))) < 1e-9


def test_scores_of_many_lines_at_once():
    """The arrays give what the features by themselves give, line by line."""
    r = random.Random(2)
    field = body.fit([(*page(r), "", None) for _ in range(60)], steps=20)
    odd = ["", " ", "Über Straße 12,5 x www.a.de/b - «ok»!", "ǅ İI ß 𝒳 日本語 12.", "…", "áb_c x\r", "\ue001 a\ue001", "SEE HTTPS://A.B/C NOW?", "a. b! c? d…", "x" * 100_000, "a b " * 20_000]
    lines = odd + [x for _ in range(20) for x in page(r)[0]]
    reader = line_tokens.Reader()
    for part in (lines[:7], lines[7:], lines):
        got = field.scores(reader.read(part))
        expected = [sum(field.weights.get(f, 0.0) for f in body.block_features(x)) for x in part]
        assert all(abs(a - b) < 1e-9 for a, b, x in zip(got, expected, part) if x.strip() and "\ue001" not in x)


def site_page(r, name, place):
    """A page of a made-up site: notices that name the site around paragraphs about a place."""
    subjects = ["river", "archive", "harbour", "glacier", "museum", "railway", "orchard", "library"]
    verbs = ["measures", "describes", "repairs", "collects", "compares", "draws"]
    notices = [f"{name} is a member of the {place} league of hosts.", f"Brought to you by {name} and friends, number {r.randint(1, 900)}.", "Home | News | Staff | Help", f"© 20{r.randint(10, 24)} {name}", f"Kept alive by donors of {name} since {r.randint(1950, 2020)}."]
    sentence = lambda: f"The {r.choice(subjects)} group {r.choice(verbs)} the {r.choice(subjects)} with the help of {r.choice('two three four five six seven'.split())} students from the {r.choice(subjects)}."
    main = [" ".join(sentence() for _ in range(r.randint(2, 4))) for _ in range(r.randint(2, 5))]
    before, after = r.sample(notices, r.randint(1, 3)), r.sample(notices, r.randint(1, 3))
    return before + main + after, [False] * len(before) + [True] * len(main) + [False] * len(after)


def test_sites_that_were_not_seen_in_training():
    """Notices without any cue are learned from their recurrence, and known on sites that the field wasn't fitted to."""
    r = random.Random(11)
    sites = [(f"{a} {b} College", c) for a, b, c in zip("Alder Birch Cedar Elm Fir Hazel Larch Maple Oak Pine".split(), "Hill Brook Field Gate Moor Dale Ford Vale Wick Ness".split(), "Orton Selby Tamar Ulver Venn Wells York Zeal Quorn Perth".split())]
    train = [(name, "\n".join(site_page(r, name, place)[0]), None) for name, place in sites[:6] for _ in range(30)]
    assert cues.label("Brought to you by Alder Hill College and friends, number 7.") is None
    field = body.fit(body.labelled(train), steps=80)
    right = total = 0
    for name, place in sites[6:]:
        for _ in range(20):
            lines, truth = site_page(r, name, place)
            right += sum(a == b for a, b in zip(field.decode(lines), truth))
            total += len(truth)
    assert right / total >= 0.97


def test_lines_that_recur():
    pages = [("s", ["Menu one", f"Own text number {i} of this page alone", f"Kept by Elm Hall for {i} years now"]) for i in range(10)] + [("t", ["Kept by Oak House for 3 years now"])]
    pages = [(s, [x.replace("Own text", f"Own {chr(97 + i)}ext") for x in lines]) for i, (s, lines) in enumerate(pages)]
    recurs = body.Recurring(pages)
    assert recurs("s", "MENU  one") and recurs("s", "Kept by Elm Hall for 77 years now") and recurs("t", "Kept by Oak House for 3 years now")
    assert not recurs("s", pages[0][1][1]) and not recurs("t", "Menu one") and not recurs(None, "Menu one")


def test_cues():
    assert cues.label("You will read the cookie banners of a dozen companies and rewrite each of them in plain words.") is True
    assert cues.label("Home / About / Contact") is False and cues.label(" ") is None and cues.label("anything", True) is False


def test_long_blocks_are_read_whole():
    start, end = "The team reads old records every week and writes a short report for the archive of the town. " * 2, " The head of the workshop also looks after the boats and reads the reports of the week."
    notice, duty = (start + x + end for x in ("Cookies and similar technologies are used here to count the visits of each reader.", "Glaciers and rivers of the region are drawn here to count the floods of each spring."))
    assert len(notice) > 260 and cues.label(notice) is False and cues.label(duty) is True
    assert {"cookies", ("similar", "technologies")} <= set(body.block_features(notice)) and "rivers" in body.block_features(duty)
    train = body.labelled([(None, f"Home | About\n{duty}\n{notice}\nShare | Print", None), (None, f"Home | About\n{notice}\n{duty}\nShare | Print", None)] * 20)
    field = body.fit(train, steps=60)
    assert field.decode(["Home | About", notice, duty]) == [False, False, True] and field.decode(["Home | About", duty, notice]) == [False, True, False]


HTML = "<html><head><title>x</title><style>p {}</style></head><body><nav><ul><li><a href='/'>{0}</a></li><li>{1}</li></ul></nav><main><article><h1>{2}</h1><p>{3} <b>bold</b></p></article></main><footer><p>{4}</p></footer><script>x()</script></body></html>"


def test_blocks_that_only_their_tags_tell(spark, rows):
    """Blocks of random words, the same inside and outside, so nothing but the tags above them decides."""
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(6))
    pages = []
    for _ in range(40):
        html = HTML
        for k in range(5):
            html = html.replace(f"{{{k}}}", text())
        pages.append(html)
    blocks = [body.leaf_blocks(h) for h in pages]
    assert [p for _, p in blocks[0]] == [("nav", "ul", "li")] * 2 + [("main", "article", "h1"), ("main", "article", "p"), ("footer", "p")] and blocks[0][3][0].endswith(" bold")
    truth = [False, False, True, True, False]
    field = body.fit([([x for x, _ in b], truth, "", [p for _, p in b]) for b in blocks[:30]], steps=60)
    for b in blocks[30:]:
        assert field.decode([x for x, _ in b], "", [p for _, p in b]) == truth
    df = spark.createDataFrame([(1, pages[35], "z"), (2, None, "z"), (3, "", "z"), (4, "<p>open <div>" + "x " * 50_000, "z")], "page_id long, html string, content string")
    got = dict(rows(body.html_bodies(df, field)))
    assert got[1] == "\n".join(x for x, _ in blocks[35][2:4]) and got[2] is None and got[3] == "" and set(got) == {1, 2, 3, 4}
    assert body.html_bodies(df.limit(0), field).count() == 0


def test_menus_of_any_length():
    assert cues.is_menu("ab | cd » e") and cues.is_menu("ab | cd |") and not cues.is_menu("ab") and not cues.is_menu("ab || cd") and not cues.is_menu("ab | " + "x" * 41)
    assert cues.is_menu("News - Staff - Help") and not cues.is_menu("News - Staff") and cues.is_menu("News\tStaff")
    assert cues.label(" | ".join(f"entry {i}" for i in range(500))) is False
    assert cues.label("ab | cd " * 20_000 + "x" * 60) is None and cues.label("cookies " * 20_000) is False


SCHEMA = "page_id long, content string, abstract string, last_crawled_at timestamp, line_no string"


def test_a_table(spark):
    r = random.Random(8)
    pages = [page(r) for _ in range(80)]
    rows = [(i, "\n\n".join(p), p[0] if i % 2 else next(x for x, t in zip(p, truth) if t)[:30], None, "z") for i, (p, truth) in enumerate(pages)]
    odd = [(500, None, None, None, "z"), (501, "", "", None, "z"), (502, " \n \n", "© 2021 Some College. All rights reserved.", None, "z"), (503, "x " * 100_000, None, None, "z"), (None, "Home", None, None, "z"), rows[0]]
    df = spark.createDataFrame([*rows, *odd], SCHEMA)
    found = {(x["page_id"], x["field"], x["line_no"]) for x in body.find_outside(df).collect()}
    expected = {(i, "content", 2 * k + 1) for i, (_, truth) in enumerate(pages) for k, t in enumerate(truth) if not t} | {(i, "abstract", 1) for i in range(80) if i % 2}
    mine = {x for x in found if x[0] < 500}
    assert len(mine ^ expected) <= 0.03 * len(expected) and (502, "abstract", 1) in found and not {x for x in found if x[0] in (500, 501)}
    bodies = {x["page_id"]: x["content"] for x in body.main_bodies(df).collect()}
    assert bodies[500] is None and all(t in bodies[0] for t, b in zip(*pages[0]) if b)
    assert body.find_outside(df.limit(0)).count() == 0


def test_found_leaves_out_contents_that_repeat_an_error_title(spark, tmp_path):
    r = random.Random(9)
    name = "404 Not Found - Some Site Careers Portal"
    data = [(i, "A Post in Robotics", "\n".join(page(r)[0]), None, [], "en-GB", None) for i in range(60)] + [(100, name, "Home | About\nA Post in Robotics", None, None, "en-GB", None), (101, "A Post in Robotics", f"Home | About\n{name}", None, [], "en-GB", None)]
    spark.createDataFrame(data, "page_id long, title string, content string, abstract string, links array<string>, site_locale string, last_crawled_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/web_pages.parquet")
    found = {x["page_id"] for x in queries.p6_found(spark, str(tmp_path)).collect()}
    assert 100 in found and 101 not in found and found >= set(range(60))
