import hashlib
import random

import pytest

from cellweave.llm import bpe, bpe_codec, token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def texts():
    r = random.Random(5)
    odd = "aab cé'ß漢 1.sŚ<|>tİΣ́ \x1c’"
    out = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(400)]
    return [*out, None, "", " ", "a" * 3000, "ab" * 2000, "don't <|endoftext|>x<|startoftext|> <|EndOfText|>", "ΑΣ ς", "naïve café’s “quoted” — 12,345"]


def test_same_ids_as_the_library(spark):
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, path).collect()}
    ids = {r.doc_id: r for r in bpe_codec.encode(df, path).collect()}
    short = {r.doc_id: r for r in bpe_codec.encode(df, path, digests=True).collect()}
    back = {r.doc_id: r.again for r in bpe_codec.decode(bpe_codec.encode(df, path), path, out_col="again").collect()}
    for i, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(want, skip_special_tokens=False)
        assert list(ids[i].ids) == want and ids[i].decoded == decoded == back[i]
        assert counts[i].n_tokens == len(want) == short[i].n_tokens and counts[i].n_bytes == len((t or "").encode())
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_kept_words_are_bounded(monkeypatch):
    from cellweave.llm import common

    monkeypatch.setattr(common, "KEPT_BYTES", 40_000)
    kept, computed = common.Kept(), []

    def compute(new):
        computed.extend(new)
        return [w.encode() for w in new]

    for k in range(200):
        words = {f"w{(k * 37 + i) % 3000}" for i in range(60)} | {"the", "x" * 100}
        assert kept.of(words, compute) == {w: w.encode() for w in words}
        assert kept.held <= 20_000 and len(kept.young) + len(kept.old) < 300
    assert computed.count("the") < 5 and computed.count("x" * 100) == 200


def test_cuts_are_forced():
    v = bpe.vocabulary(P.path("word_bpe_49k.json"))
    own, per = bpe_codec.fragments(v, ["zqxjéß漢a".encode(), b"the"])
    assert b"".join(p for p, _ in own) == "zqxjéß漢athe".encode() and per.sum() == len(own)
    for (a, last), (b, _) in zip(own, own[1:]):
        assert last or not v.inside[a[-1], b[0]]


def test_awkward_rows(spark, awkward):
    path = P.path("word_bpe_49k.json")
    assert token_counts.count_tokens(awkward, path).count() == awkward.count() == bpe_codec.encode(awkward, path).count()
    assert token_counts.count_tokens(awkward.limit(0), path).count() == 0
