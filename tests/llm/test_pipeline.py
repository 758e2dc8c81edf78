import hashlib
import random
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")


def test_stages_against_plain_python(spark, tmp_path):
    import public_tokenizers

    from cellweave.llm import mixing
    from tests.llm.test_ngram_join import brute as groups
    from tests.llm.test_substring_dedup import brute as repeats
    from tests.llm.test_toxicity import corpus

    r = random.Random(8)
    rows = [(i, t, y) for i, t, y in corpus(400)]
    shared = " ".join(f"p{k}" for k in range(60))
    docs = []
    for i, t, _ in rows:
        if i % 7 == 0:
            t = f"{t} {shared}"
        docs.append((i, t, "en", r.choice(["a", "b", "c", "d"]), len(t)))
    docs += [(1000 + i, t + " end", "en", s, len(t) + 4) for i, t, _, s, _ in docs[1:40:3]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        got = out.collect()
        if name != "bpe_codec":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = sorted((x.doc_id, getattr(x, "text", None)) for x in got)
        before = sorted((x.doc_id, x.text) for x in df.collect())
        if name == "toxicity":
            toxic = {i for i, _, y in rows if y and zlib.crc32(str(i).encode()) % 5 == 0}
            assert set(now) <= set(before) and len(toxic & {i for i, _ in now}) <= 2
            assert len(now) >= 0.97 * sum(1 for i, _ in before if i >= 1000 or not rows[i][2])
        elif name == "near_duplicates":
            least = {c for _, _, _, c in groups(before)}
            assert [i for i, _ in now] == sorted(least)
        elif name == "substring_dedup":
            words, left = repeats([t for _, t in before], 35)
            want = [(i, t if len(w) == len(k) else b" ".join(k).decode()) for (i, t), w, k in zip(before, words, left, strict=True)]
            assert now == sorted(want)
        elif name == "mixing":
            sizes = {}
            for x in df.collect():
                sizes.setdefault(x.source, []).append(len(x.text.split()))
            names = sorted(sizes)
            target = mixing.quotas({s: sum(v) for s, v in sizes.items()}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
            for s in names:
                taken = sum(len(x.text.split()) for x in got if x.source == s)
                assert 0 <= target[s] - taken <= max(sizes[s])
        else:
            lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = sorted((x.doc_id, lib.encode(x.text, add_special_tokens=False).ids) for x in df.collect())
            assert sorted((x.doc_id, list(x.ids)) for x in got) == want
        if name != "bpe_codec":
            path = f"{tmp_path}/{name}"
            out.write.parquet(path)
            df = spark.read.parquet(path)
            kept.append(df.count())
    digest = lambda rows: hashlib.sha256(repr(sorted((x.doc_id, x.n_tokens) for x in rows)).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, str(tmp_path)).collect()) == digest(got)


def test_stages_with_awkward_rows(spark, awkward, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (awkward, awkward.limit(0)):
        df = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            path = f"{tmp_path}/{rows is awkward}-{name}"
            out.write.parquet(path)
            if name != "bpe_codec":
                assert out.columns == awkward.columns
            df = spark.read.parquet(path)
        assert (df.count() > 0) == (rows is awkward)
