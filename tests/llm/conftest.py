import pytest


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and texts that differ in white space or case only."""
    long_ = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    return [
        (1, "the quick brown fox jumps over the lazy dog"), (2, "The  quick brown\tfox jumps over\nthe lazy dog"), (2, "The  quick brown\tfox jumps over\nthe lazy dog"), (3, None), (4, ""), (5, "   \n\t"), (6, "one two"), (7, "one  two"),
        (8, long_), (9, long_ + " end"), (10, "ÉTÉ été K k ﬁ 日本   \u0085 x"), (None, "the quick brown fox jumps over the lazy dog"), (None, None), (11, "`a` <|endoftext|> b.c, d! don't"), (-5, "negative ids come first"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """odd_rows() with columns whose names clash with those that operators make."""
    rows = [(i, t, f"s{(i or 0) % 2}" if i != 3 else None, 7, "x", 1, 2, "n", 3) for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, digest string, rep long, band int, ids string, _score int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")
