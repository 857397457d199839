import random

import pytest

from millrace.llm.splitting import split_oversized, split_text
from millrace.llm.tokens import encoder


def texts():
    random.seed(2)
    words = "the archive measures river cores while a small team of students reads court records and draws maps".split()
    prose = ". ".join(" ".join(random.choices(words, k=12)).capitalize() for _ in range(300)) + "."
    return {"prose": prose, "lines": prose.replace(". ", "\n"), "run": "x" * 9000, "kana": "あいうえお。" * 700, "emoji": "\U0001f600" * 1500, "spaces": "word  \n" * 1500}


@pytest.mark.parametrize("name", list(texts()))
@pytest.mark.parametrize("limit, overlap", [(512, 32), (64, 0), (64, 40)])
def test_pieces(name, limit, overlap):
    text, enc = texts()[name], encoder()
    pieces = split_text(enc, text, limit, overlap)
    ids = enc.encode(text)
    raw = [enc.words[i].encode("latin-1") for i in ids]
    assert pieces[0][0] == 0 and pieces[-1][1] == len(ids)
    for a, b, n, piece in pieces:
        assert n <= limit and n == enc.count(piece) and piece.encode() == b"".join(raw[a:b])
    for (a, b, *_), (c, d, *_) in zip(pieces, pieces[1:]):
        assert overlap <= b - c <= overlap + 3 and d > b
    if name == "prose" and overlap < 40:
        assert all(p[3].rstrip().endswith(".") for p in pieces)


def test_a_change_of_topic_is_preferred():
    one, two = "Glaciers carry rocks down valleys slowly. " * 12, "Novels describe cities through letters. " * 12
    first = split_text(encoder(), one + two, 130, 0)[0]
    assert first[3] == one.rstrip() or first[3] == one


def test_a_table(spark):
    long = "Some words here. " * 400
    df = spark.createDataFrame([(1, long, "z"), (2, "short", "z"), (3, None, "z"), (4, "", "z"), (5, " " * 3, "z"), (1, long, "z")], "doc_id long, text string, piece string")
    got = split_oversized(df, [("a", 512, 32), ("b", 4000, 0)]).collect()
    assert {r["limit_name"] for r in got} == {"a"} and {r["doc_id"] for r in got} == {1}
    assert len(got) == 2 * len({r["piece_no"] for r in got}) and all(r["piece"] in long for r in got)
    assert split_oversized(df.limit(0), [("a", 5, 1)]).count() == 0 and split_oversized(df, []).count() == 0
    assert all(r["piece"] is None for r in split_oversized(df, [("a", 512, 32)], with_text=False).collect())
    with pytest.raises(ValueError):
        split_text(encoder(), long, 10, 10)
