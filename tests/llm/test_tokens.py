import base64

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm.tokens import count_tokens, encode_corpus, encoder

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    with open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = st.one_of(st.characters(max_codepoint=0x3100, exclude_categories=["Cs"]), st.sampled_from(["the ", "ing", "  ", "\n\n", "'s", "<|endoftext|>", "\U0001f600"]))


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.lists(PARTS, max_size=60))
def test_any_text(reference, parts):
    text, enc = "".join(parts), encoder()
    assert enc.encode(text) == reference.encode_ordinary(text)
    assert b"".join(enc.words[i].encode("latin-1") for i in enc.encode(text)) == text.encode()  # an exact round trip


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 2000, "aaaaabbb" * 800, "\n \n" * 500, "文" * 800])
def test_long_runs(reference, text):
    assert encoder().encode(text) == reference.encode_ordinary(text)


def test_a_table(spark, reference):
    texts = ["one two", None, "", "  ", "one two", "<|endoftext|>", "x " * 50_000]
    df = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in encode_corpus(df).collect())
    assert got == [(i, reference.encode_ordinary(t or "")) for i, t in enumerate(texts)]
    assert sorted(r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()) == sorted(len(reference.encode_ordinary(t or "")) for t in texts)
    assert encode_corpus(df.limit(0)).count() == 0
