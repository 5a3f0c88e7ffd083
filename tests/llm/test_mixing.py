from collections import defaultdict

from trialspark.llm import mixing


def reference_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(3 * sizes[s] for s in stopped)
        share = sum(weight[s] for s in free)
        more = {s for s in free if left * weight[s] / share > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else left * weight[s] / share for s in names}
        stopped |= more


def test_targets_stop_and_reshare(spark):
    sizes = {"a": 100, "b": 1, "c": 7, "B": 50, "é": 0, None: 3, "zz": 1000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = reference_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


def test_mix_reaches_targets_with_a_hot_source(spark, make_docs):
    rows = [(i, "w " * (i % 9 + 1), "en", "hot" if i % 2 else f"s{i % 7}") for i in range(3000)]
    rows += [(None, "no id", "en", None), (5000, None, "en", None), (5001, "", "en", "s1"), (1, "w w", "en", "hot")]
    docs = make_docs(rows)
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    taken, target = defaultdict(int), {}
    for r in plan:
        assert r["size"] == (len(r.doc.text.split()) if r.doc.text else 0)
        assert 0 <= r.copies <= 3
        taken[r.doc.source] += r["size"] * r.copies
        target[r.doc.source] = r.target
    want = reference_targets(sizes := {s: sum(r["size"] for r in plan if r.doc.source == s) for s in target})
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        if s is not None:
            assert abs(taken[s] - target[s]) < 0.1 * target[s] + 10
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed.collect()))


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([(1, "a")]).limit(0)).count() == 0


def test_no_python_in_the_plan(make_docs):
    text = mixing.mix(make_docs([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
