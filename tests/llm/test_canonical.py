import random

from millrace.llm.canonical import map_values, match_values, page_values

CANON = [
    (1, "location", "Orodalness, SR"), (2, "location", "Norandalburg, OT"), (3, "location", "Norandalburg, SR"), (4, "location", "Brimaham, HV"), (1, "location", "Orodalness, SR"),
    (11, "degree_levels", "Bachelor's Degree"), (12, "degree_levels", "Doctorate"), (13, "degree_levels", "Secondary School"), (14, "degree_levels", "Postdoctoral"), (15, "degree_levels", "Master's Degree"),
    (21, "fields_of_study", "Supply Chain Management"), (22, "fields_of_study", "Nuclear Engineering"), (23, "fields_of_study", "Human-Computer Interaction"), (24, "fields_of_study", "Optics and Photonics"), (25, "fields_of_study", "Museum Studies"), (26, "fields_of_study", "Nursing"),
]
CASES = [
    ("location", "Campus Orodalness, SR", 1), ("location", "oroalness sr", 1), ("location", "SR - Orodalness", 1), ("location", "17 Quay Street, Orodalness, SR 12345", 1), ("location", "Orodálness (hybrid)", 1), ("location", "the Brimaham office", 4), ("location", "brimhaam", 4),
    ("location", "Norandalburg/OT", 2), ("location", "Greater Norandalburg Area, SR", 3), ("location", "Norandalburg", -1), ("location", "Brimaham, SR", -1), ("location", "TBD", -1), ("location", "00000", -1), ("location", "Orodalnessholm, SR", -1),
    ("degree_levels", "B.Sc.", 11), ("degree_levels", "BACHELOR’S DEGREE", 11), ("degree_levels", "bachlor", 11), ("degree_levels", "P.h.D", 12), ("degree_levels", "docterate", 12), ("degree_levels", "Post-doctoral", 14), ("degree_levels", "Grade 12", 13), ("degree_levels", "Master of Letters", 15), ("degree_levels", "secon. school", 13), ("degree_levels", "Doctoral degree course (any)", 12), ("degree_levels", "short", -1), ("degree_levels", "level of study", -1), ("degree_levels", "any", -1), ("degree_levels", "Level ?", -1),
    ("fields_of_study", "supplychainmanagement", 21), ("fields_of_study", "Supp. Chai. Mana.", 21), ("fields_of_study", "Engineering, Nuclear", 22), ("fields_of_study", "Engineering (nuclear)", 22), ("fields_of_study", "nucl engineering", 22), ("fields_of_study", "BSc in Nuclear Enigneering", 22), ("fields_of_study", "Huma. Inte.", 23),
    ("fields_of_study", "Optics & Photonics, or similar", 24), ("fields_of_study", "Museum studies studies", 25), ("fields_of_study", "Nurstng", 26), ("fields_of_study", "undeclared", -1), ("fields_of_study", "x" * 3000, -1), ("location", "Nursing", -1),
]


def canon(spark, rows=CANON):
    return spark.createDataFrame(rows, "canon_id int, field string, label string")


def test_cases_and_odd_rows(spark):
    rows = [(i, f, v, "keep") for i, (f, v, _) in enumerate(CASES)] + [(100, "location", None, "keep"), (101, "location", "", "keep"), (102, "location", "   ", "keep"), (0, *CASES[0][:2], "keep")]
    df = spark.createDataFrame(rows, "id long, field string, value string, form string")
    out = map_values(df, canon(spark)).collect()
    got = {r["id"]: r["canon_id"] for r in out}
    assert [(CASES[i][1], got[i]) for i in range(len(CASES))] == [(v, c) for _, v, c in CASES]
    assert len(out) == len(rows) and got[100] == got[101] == got[102] == -1 and out[0]["form"] == "keep"
    assert map_values(df.limit(0), canon(spark)).count() == 0
    assert {r["canon_id"] for r in map_values(df, canon(spark, CANON[:0])).collect()} == {-1}


def test_the_join_finds_every_near_string(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    random.seed(5)
    names = sorted({"".join(random.choices("abc", k=random.randint(5, 11))) for _ in range(25)})
    values = set()
    for _ in range(150):
        s = list(random.choice(names))
        for _ in range(random.randint(0, 3)):
            k = random.randrange(len(s) + 1)
            s[k : k + random.randint(0, 1)] = random.choice(["", "a", "b", "c"])
        values.add("".join(s))
    expected = {}
    for v in values:
        near = [(distance(v, n), i) for i, n in enumerate(names) if (d := distance(v, n)) <= (2 if len(n) >= 6 else 1) or d == 0]
        if near:
            expected[v] = min(near)
    c = canon(spark, [(i, "code", n) for i, n in enumerate(names)])  # a field without rules of its own
    got = match_values(spark.createDataFrame([("code", v) for v in sorted(values)], "field string, value string"), c)
    assert {r["value"]: (r["edits"], r["canon_id"]) for r in got.collect()} == expected


def test_values_of_pages(spark, rows):
    df = spark.createDataFrame([(1, None, "A", ["x", None, " ", "y"], None), (2, None, None, None, []), (3, None, " ", None, ["z"])], "page_id long, last_crawled_at timestamp, location string, degree_levels array<string>, fields_of_study array<string>")
    assert rows(page_values(df.union(df))) == [(1, "degree_levels", 1, "x"), (1, "degree_levels", 4, "y"), (1, "location", 1, "A"), (3, "fields_of_study", 1, "z")]


def test_names_are_the_callers(spark):
    df = spark.createDataFrame([(1, "degree_levels", "Ausbildung"), (2, "degree_levels", "bsc")], "id long, field string, value string")
    got = {r["id"]: r["canon_id"] for r in map_values(df, canon(spark), {"secondaryschool": ["ausbildung"]}).collect()}
    assert got == {1: 13, 2: -1}
    assert {r["canon_id"] for r in map_values(df, canon(spark), {}).collect()} == {-1}
