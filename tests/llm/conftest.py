import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(texts, sources=None):
        rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture
def awkward(spark):
    """Null and empty texts, null ids, repeated rows, ties, one long text, and columns whose names clash."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [
        (1, "one two three four five six seven", None, None, None, "a"),
        (1, "one two three four five six seven", None, None, None, "a"),
        (2, None, "en", "s", 0, None),
        (3, "", "en", "s", 0, "b"),
        (None, "one two three four five six seven", "en", "s", 3, "c"),
        (4, " \t\n\x0b ", None, "t", 5, "d"),
        (5, long_text, "en", "t", len(long_text), "e"),
        (6, "é漢字 <|endoftext|> Ünïcode’s \x1c x", "de", None, 9, "f"),
        (7, "word", "en", "s", 4, "g"),
    ]
    odd = "k1 k2 goes at n c row pack h __bit __size __u html score".split()
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id string, " + ", ".join(f"{c} string" for c in odd)
    return spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in odd)) for r in rows], kinds)
