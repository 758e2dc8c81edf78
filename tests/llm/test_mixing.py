import itertools
import random

from pyspark.sql import functions as F

from cellweave.llm import mixing as M


def test_words(spark):
    texts = ["a b", "", None, " \t\n", "x y z", "é\x0bf\x0cg\rh", "  lead and trail  "]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select(M.n_words().alias("n")).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


def test_quotas():
    sizes = {"a": 10, "b": 100, "c": 1000, "d": 5}
    t = M.quotas(sizes, {"a": 5, "b": 2, "c": 1, "d": 5})
    assert abs(sum(t.values()) - 1115) < 1e-6 and t["a"] == 30 and t["d"] == 15 and t["b"] == 300
    assert all(t[s] <= 3 * sizes[s] + 1e-9 for s in sizes)


def cost(flow, sizes):
    total = 0.0
    for f, n in zip(flow, sizes, strict=True):
        used = sum(f.values())
        total += sum((k + 1) * min(n, max(0.0, used - k * n)) for k in range(3))
    return total


def test_flow_is_least_cost():
    p = [(frozenset("a"), 4), (frozenset("ab"), 6), (frozenset("b"), 2)]
    demand = {"a": 9.0, "b": 7.0}
    flow = M.min_cost_flow(p, demand)
    for s in "ab":
        assert abs(sum(f.get(s, 0) for f in flow) - demand[s]) < 1e-6
    best = min(
        cost([{"a": x}, {"a": demand["a"] - x, "b": demand["b"] - y}, {"b": y}], [4, 6, 2])
        for x, y in itertools.product([i / 2 for i in range(19)], [i / 2 for i in range(13)])
        if x <= 12 and y <= 6 and 0 <= demand["a"] - x + demand["b"] - y <= 18
    )
    assert abs(cost(flow, [4, 6, 2]) - best) < 1e-6


def best_cost(patterns, demand):
    """The most words that any flow brings, and the least cost of so many, by trying all that patterns may give."""
    names = sorted(demand)
    best = {}
    for given in itertools.product(*(range(3 * n + 1) for _, n in patterns)):
        # patterns can send so much if no set of sources gets more than it wants of those that go nowhere else
        sets = (set(c) for k in range(1, len(names) + 1) for c in itertools.combinations(names, k))
        if all(sum(g for g, (p, _) in zip(given, patterns, strict=True) if p <= c) <= sum(demand[s] for s in c) for c in sets):
            c = sum((k + 1) * min(n, max(0, g - k * n)) for g, (_, n) in zip(given, patterns, strict=True) for k in range(3))
            best[sum(given)] = min(c, best.get(sum(given), c))
    return max(best), best[max(best)]


def test_flow_of_overlapping_sources():
    r = random.Random(5)
    for _ in range(25):
        patterns = [(frozenset(r.sample("abc", r.randint(1, 3))), r.randint(0, 4)) for _ in range(3)]
        patterns = list({p: (p, n) for p, n in patterns}.values())
        demand = {s: r.randint(0, 9) for s in {s for p, _ in patterns for s in p}}
        steps = []
        flow = M.min_cost_flow(patterns, demand, steps=steps)
        words, least = best_cost(patterns, demand)
        assert sum(steps) == sum(sum(f.values()) for f in flow) == words and cost(flow, [n for _, n in patterns]) == least
        assert all(0 <= sum(f.get(s, 0) for f in flow) <= d for s, d in demand.items()) and all(x >= 0 for f in flow for x in f.values())


def test_sources_apart_go_through_the_flow():
    patterns, steps = [(frozenset([f"s{i}"]), 10) for i in range(2000)] + [(frozenset([None]), 4)], []
    flow = M.min_cost_flow(patterns, {f"s{i}": 25.9 for i in range(2000)} | {None: 99.0}, steps=steps)
    assert len(steps) == 3 * 2001 and flow[7] == {"s7": 25} and flow[-1] == {None: 12} and sorted(set(steps)) == [4, 5, 10]


def test_documents_of_several_sources(spark):
    """Each source of overlapping ones gets what the flow of their patterns brings, but for less than a document."""
    r = random.Random(6)
    rows = [(i, " ".join("w" * r.randint(1, 30)), r.choice([["a"], ["a", "b"], ["b", "c"], ["c"], ["c", "a", "b"], []])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own array<string>")
    got = {x.doc_id: x["__times"] for x in M.mix(df, F.col("own")).collect()}
    groups = {}
    for i, t, own in rows:
        groups.setdefault(frozenset(own), []).append((i, len(t.split())))
    size = {s: sum(n for p, d in groups.items() if s in p for _, n in d) for s in "abc"}
    target = M.quotas(size, dict(zip("abc", (5, 2, 1), strict=True)))
    named = [(p, sum(n for _, n in d)) for p, d in sorted(groups.items(), key=lambda x: str(sorted(x[0])).replace("'", '"').replace(" ", "")) if p]
    flow = M.min_cost_flow(named, target)
    for (p, _), f in zip(named, flow, strict=True):
        taken = sum(got[i] * n for i, n in groups[p])
        assert 0 <= sum(f.values()) - taken < 31
    assert all(got[i] == 0 for i, _ in groups.get(frozenset(), []))


def test_sources_come_near_their_targets(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((x.doc_id, x["__times"]) for x in M.mix(df).collect()) for _ in range(2))
    assert first == again
    sizes = {i: len(t.split()) for i, t, _ in rows}
    src = {i: s for i, _, s in rows}
    per = {s: sum(sizes[i] for i in sizes if src[i] == s) for s in {"a", "b", "c", None}}
    target = M.quotas(per, {"a": 5, "b": 2, "c": 1, None: 5})
    for s in per:
        taken = sum(k * sizes[i] for i, k in first if src[i] == s)
        assert 0 <= target[s] - taken < 61
    assert all(0 <= k <= 3 for _, k in first)
    assert M.mixture(df).count() == sum(k for _, k in first)


def test_long_documents_do_not_end_the_draw(spark, monkeypatch):
    rows = [(i, "w " * (1000 if i < 10 else 10), "a") for i in range(310)] + [(400 + i, "w " * 10, "b") for i in range(618)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = M.quotas({"a": 13000, "b": 6180}, {"a": 5, "b": 2})
    for seed in range(3):
        taken = {}
        for few in (1000, 2):
            monkeypatch.setattr(M, "NEXT", few)
            taken[few] = sorted((x.doc_id, x["__times"]) for x in M.mix(df, seed=seed).collect())
        assert taken[1000] == taken[2] and len(taken[2]) == len(rows)
        for s in "ab":
            got = sum(k * len(rows[i if i < 310 else i - 90][1].split()) for i, k in taken[2] if (i < 400) == (s == "a"))
            assert 0 <= target[s] - got < 10


def test_repeated_rows_are_drawn_as_far_as_they_fit(spark):
    rows = [(7, "w " * 10, "a")] * 40 + [(i, "w " * 10, "b") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    target = M.quotas({"a": 400, "b": 400}, {"a": 5, "b": 2})
    got = M.mix(df).collect()
    for s in "ab":
        assert 0 <= target[s] - sum(x["__times"] * 10 for x in got if x.source == s) < 10
    assert len(got) == 80 and M.mixture(df).count() == sum(x["__times"] for x in got)


def test_columns_keep_their_names_and_values(spark):
    names = "row, id, n, k1, goes, at, copy, __size, __u, __times, __fits, __edge, __pattern, __nth".split(", ")
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), "ab"[i % 2], *(f"{c}{i}" for c in names)) for i in range(50)], ["doc_id", "text", "source", *names])
    got = M.mixture(df)
    assert got.columns == df.columns
    assert {tuple(x) for x in got.collect()} <= {tuple(x) for x in df.collect()}
    assert {"row", "id", "k1", "__nth"} <= set(M.mix(df).columns)


def test_awkward_rows(spark, awkward):
    assert M.mix(awkward).count() == awkward.count()
    assert M.mix(awkward.limit(0)).count() == 0
    both = M.mix(awkward, F.when(F.col("doc_id") > 2, F.array("source", F.lit("z"))))
    assert both.count() == awkward.count()
