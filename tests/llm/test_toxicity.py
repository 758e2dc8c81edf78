import random
import zlib

import numpy as np

from cellweave.llm import toxicity as T


def chain_brute(odds, first, moves):
    """Marginals by summing over all labelings of each document."""
    out, start = [], 0
    stops = [*np.flatnonzero(first)[1:].tolist(), len(odds)]
    a, b, s = np.exp(moves)
    for stop in stops:
        own, total, hot = odds[start:stop], 0.0, np.zeros(stop - start)
        for code in range(1 << len(own)):
            y = [(code >> i) & 1 for i in range(len(own))]
            w = s if y[0] else 1.0
            for i, v in enumerate(y):
                w *= own[i] if v else 1.0
                if i and v:
                    w *= b if y[i - 1] else a
            total += w
            hot += w * np.array(y)
        out += (hot / total).tolist()
        start = stop
    return np.array(out)


def test_marginals_match_all_labelings():
    r = np.random.default_rng(0)
    odds = np.exp(r.normal(size=40))
    first = np.zeros(40, bool)
    first[[0, 7, 8, 17, 30]] = True
    moves = np.array([-1.2, 0.7, -0.4])
    assert np.allclose(T.marginals(odds, first, moves)[2], chain_brute(odds, first, moves))


def corpus(n, seed=3):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(15, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["grumblefool", "slimehead", "slimebag", "slimeton"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    got = {r.doc_id: r for r in T.tag(docs, model).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.97
    hit = next(got[i] for i, _, y in held if y and got[i].spans)
    text = rows[hit.doc_id][1]
    assert any(text[s.start : s.end].startswith(("slime", "grumble")) for s in hit.spans)
    clean = T.drop_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == sum(1 for r in got.values() if not r.predicted)


def test_awkward_rows(spark, awkward):
    out = T.tag(awkward, T.Field()).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert T.tag(awkward.limit(0), T.Field()).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.train(awkward, none).base == 0
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert T.tag(awkward, T.train(awkward, odd)).count() == awkward.count()
