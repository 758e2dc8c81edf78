import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from cellweave.llm import ngram_join as N


def sets_of(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, inv, root = [sets_of(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for x in s:
            inv[x].append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in inv[x] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d is None, d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed):
    r, rows = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    common = [word() for _ in range(12)]
    for _ in range(12):
        base = [word() for _ in range(r.randint(6, 120))] + common
        for _ in range(r.randint(1, 30)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w).upper() if r.random() < 0.1 else "  ".join(w)))
    return rows


@pytest.mark.parametrize("seed, group", [(1, 1 << 15), (2, 300), (3, 1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, group):
    monkeypatch.setattr(N, "GROUP_SHINGLES", group)
    rows = corpus(seed) + [(9001, "One two"), (9002, "one  TWO"), (9003, ""), (9004, None), (9005, "x"), (None, "one two"), (9001, "One two")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [x for x in brute(rows) if not x[0]]
    assert [r.component_id for r in got if r.doc_id is None] == [9001]


def test_one_of_each(spark):
    rows = corpus(4)
    df = spark.createDataFrame([*rows, rows[0], (9000, None), (9000, None)], "doc_id long, text string")
    got = sorted(r.doc_id for r in N.one_of_each(df).collect())
    assert got == sorted({c for _, _, _, c in brute(rows)} | {9000}) + [9000]


def test_awkward_rows(spark, awkward):
    assert N.near_duplicates(awkward).count() == awkward.count()
    assert N.near_duplicates(awkward.limit(0)).count() == 0
    once = N.one_of_each(awkward)
    assert once.columns == awkward.columns
    rows, every = sorted(map(repr, once.collect())), sorted(map(repr, awkward.collect()))
    assert set(rows) <= set(every) and len(rows) == len(every) - 2  # the repeated row and the text without an id go


def test_groups_are_bounded_and_forests():
    import numpy as np

    union = np.arange(100, dtype=np.uint64)
    cs, sizes = np.array([1, 2, 3]), np.array([50, 50, 40])
    places = np.concatenate([np.arange(50), np.arange(50), np.arange(60, 100)]).astype(np.uint32)
    same, other = np.arange(50, dtype=np.uint64), np.arange(60, 100, dtype=np.uint64)
    assert N.opened([(1, same), (2, same)], union, cs, sizes, places, 80) == [(1, 2)]
    assert sorted(N.opened([(9, same), (3, other)], union, cs, sizes, places, 80)) == [(9, 1), (9, 2)]
    assert N.opened([(9, np.arange(200, 260, dtype=np.uint64))], union, cs, sizes, places, 80) == []


def test_counts_by_packs(spark, monkeypatch):
    import numpy as np

    from cellweave.llm import counting

    r = np.random.default_rng(3)
    for wide in (False, True):
        packs = [r.integers(0, 300, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(7)]
        keys = [counting.Keys(p, 13, p + np.uint64(1) if wide else None) for p in packs]
        rows = [x for i, k in enumerate(keys) for x in counting.requests(i, 0, k).to_pylist()]
        got = {x["pack"]: x for x in counting.answers(spark.createDataFrame(rows, counting.ASKED), "bits", wide).collect()}
        whole = Counter(h for p in packs for h in p.tolist())
        for i, (p, k) in enumerate(zip(packs, keys)):
            met = np.zeros(len(p), bool)
            met[k.others()] = True
            met[k.singles()[counting.bits_of(k, got[i].buckets, got[i].answers)]] = True
            assert met.tolist() == [whole[h] > 1 for h in p.tolist()]


def test_input_in_another_order_at_each_read(spark):
    """A shuffle before the join that deals rows anew, by a random number, at each read loses nothing."""
    rows = corpus(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, F.rand()).sortWithinPartitions(F.rand())
    df = df.where(F.udf(lambda i: i is not None, "boolean").asNondeterministic()("doc_id"))
    first, again = ([r.doc_id for r in df.collect()] for _ in range(2))
    assert sorted(first) == sorted(again)
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == brute(rows)


def test_a_pack_without_answers_is_an_error(spark):
    df = spark.createDataFrame(corpus(7), "doc_id long, text string")
    rows = N.keyed(df, "doc_id", "text").select("k1", "k2", F.col("row.doc_id").alias("id"), "row.text")
    packs = N.stored(N.packed_sets(rows, 5, 4), "packs")
    replies = N.counting.answers(N.asked_of(packs), "sets")
    assert N.judged(packs, replies, 80).count() == len(corpus(7))
    fewer = replies.select("pack", F.slice("buckets", 1, 3).alias("buckets"), F.slice("answers", 1, 3).alias("answers"))
    for part in (fewer, replies.limit(0)):
        with pytest.raises(PythonException, match="a pack lacks answers"):
            N.judged(packs, part, 80).collect()
