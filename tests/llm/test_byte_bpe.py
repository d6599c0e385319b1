import base64
from pathlib import Path

import pytest
from claimloom.llm import byte_bpe as b
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = Path(b.FOLDER) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not PATH.exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in PATH.read_bytes().splitlines() if line)}
    return b.Encoder(PATH.read_bytes()), tiktoken.Encoding("own", pat_str=b.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(enc, text):
    out = []
    enc.text(text, out)
    return out


def test_known_texts_and_round_trip(both):
    enc, other = both
    for t in ["Hello world", "  a\n\n b ", "हिन्दी में <|endoftext|>", "é" * 50, "🙂👩‍⚕️", "a" * 30_000, "x\x00y", "don't we'll I'M"]:
        ids = ours(enc, t)
        assert ids == other.encode_ordinary(t)
        assert b"".join(enc.bytes_of[i] for i in ids).decode() == t


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("ab AB\n'.é中"), max_size=200)))
def test_equals_the_merges(text):
    import tiktoken

    ranks = {base64.b64decode(x): int(y) for x, y in (line.split() for line in PATH.read_bytes().splitlines() if line)}
    other = getattr(test_equals_the_merges, "other", None) or tiktoken.Encoding("own", pat_str=b.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = getattr(test_equals_the_merges, "enc", None) or b.Encoder(PATH.read_bytes())
    test_equals_the_merges.other, test_equals_the_merges.enc = other, enc
    assert ours(enc, text) == other.encode_ordinary(text)


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "Hi", "z"), (2, "", None), (3, None, None), (1, "Hi", None)], "doc_id long, text string, ids string")
    hi = b.Encoder(PATH.read_bytes())
    assert rows(b.encode(df, "doc_id", "text")) == [(1, ours(hi, "Hi")), (1, ours(hi, "Hi")), (2, []), (3, [])]
    assert rows(b.encode(df.where("false"), "doc_id", "text")) == []


def test_memos_are_emptied(both, monkeypatch):
    enc, other = both
    monkeypatch.setattr(b, "MEMO", 3)
    t = "one two three four five six seven eight"
    assert ours(enc, t) == other.encode_ordinary(t)
