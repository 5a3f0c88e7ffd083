import hashlib
import zlib

import pytest

from trialspark.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    fields = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes, arity):
    """Root and, for each node, what stands left and right level by level."""
    level, paths, own = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, at in enumerate(own):
            run, slot = runs[at // arity], at % arity
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            own[k] = at // arity
        level = [sha(*r) for r in runs]
    return level[0], paths


def plain(rows, arity=2):
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    order = sorted(langs, key=lambda s: (s is not None, (s or "").encode()))
    out, found = [], []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        found.append((own, *tree([leaf(r) for r in own], arity)))
    root, upper = tree([f[1] for f in found], arity)
    for (own, subroot, paths), above in zip(found, upper):
        for r, path in zip(own, paths):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = leaf(r, int(hit))
            for left, right in path + above:
                node = sha(left, node, right)
            proof = sha(*[a + b for a, b in path + above])
            out.append((r.doc_id, leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(n):
    return [(i, f"text é {i}" * (i % 4), ["en", "de", "fr"][i % 3] if i % 5 else "en", f"s{i % 2}") for i in range(n)]


EDGES = [(None, None, None, None), (7, "", "", ""), (7, "", "", ""), (7, "other", "", "a"), (-3, "x" * 100000, "zz", None), (9, None, "é", "b"), (None, "b", "en", "a")]


@pytest.mark.parametrize("block, arity", [(4096, 2), (4, 2), (2, 2), (9, 3), (4, 4)])
def test_manifest_equals_plain_tree(spark, make_docs, monkeypatch, block, arity):
    monkeypatch.setattr(merkle, "BLOCK_NODES", block)
    docs = make_docs(texts(75) + EDGES, extra="pos")
    assert got(merkle.verify(docs, arity)) == plain(docs.collect(), arity)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_trees(make_docs, n):
    docs = make_docs([(i, "t", "en", "a") for i in range(n)], extra="grp")
    rows = got(merkle.verify(docs))
    assert rows == plain(docs.collect()) and len(rows) == n


def test_tampering_is_seen_and_order_does_not_matter(make_docs):
    docs = make_docs(texts(60))
    rows = got(merkle.verify(docs))
    bad = {r[0] for r in rows if not r[-1]}
    assert bad == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0} and bad
    assert got(merkle.verify(docs.orderBy("text").repartition(7))) == rows


def test_empty_and_all_null(spark, make_docs):
    docs = make_docs(texts(3))
    assert merkle.verify(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(merkle.verify(nulls)) == plain(nulls.collect())
