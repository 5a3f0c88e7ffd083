import random

import pytest
import xxhash

from trialspark.llm import simhash_index
from trialspark.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \n", "One", "one Two", "É a\x0bb c d", "a b c " * 50, "x y z w v u"])
def test_fingerprint(text):
    assert simhash_index.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


def plain_classes(prints):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_links_keep_every_class(spark):
    rnd = random.Random(3)
    prints = set()
    for _ in range(12):
        p = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 25)):
            prints.add(p)
            for _ in range(rnd.randint(1, 3)):
                p ^= 1 << rnd.randrange(64)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash_index.links(df)).collect()}
    got = [roots.get(p, p) for p in signed]
    want = plain_classes(prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(7, 7), (5, 6)], "a long, b long")
    got = components(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_classes_with_edge_rows(make_docs):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = make_docs([(5, text), (3, text.upper()), (9, None), (8, ""), (None, "\n"), (3, text), (7, "other words here"),
                      (None, "lonely text without id")], extra="component_id")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_index.classes(docs).collect())
    assert got == [("3", "3"), ("3", "3"), ("5", "3"), ("7", "7"), ("8", "8"), ("9", "8"), ("None", "8"), ("None", "None")]
    kept = simhash_index.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "8", "None"]
    assert simhash_index.classes(docs.limit(0)).count() == 0


def test_rows_of_one_id_in_several_classes(make_docs):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "red green blue white black")
    docs = make_docs([(1, a), (1, b), (1, b), (2, b), (2, c), (3, c), (4, "only this text here")])
    kept = sorted((r.doc_id, r.text) for r in simhash_index.keep_one(docs).collect())
    assert kept == [(1, a), (1, b), (2, c), (4, "only this text here")]


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in simhash_index.classes(docs).collect()}
    prints = [plain_fingerprint(r.text) for r in rows]
    assert all(got[r.doc_id].fp % 2**64 == p for r, p in zip(rows, prints))
    least = {}
    classes = plain_classes(prints)
    for r, c in zip(rows, classes):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(got[r.doc_id].component_id == least[c] for r, c in zip(rows, classes))
