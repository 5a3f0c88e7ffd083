import hashlib
import random
import re

import numpy as np
import pytest

from trialspark.llm import induced_sort, suffix_dedup


def brute(texts, length=400):
    """Bytes covered by strings that start twice, from a count of all strings."""
    seen, out = {}, []
    for t in texts:
        for i in range(len(t) - length + 1):
            h = hashlib.blake2b(t[i : i + length], digest_size=12).digest()
            seen[h] = seen.get(h, 0) + 1
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=12).digest()] > 1:
                gone[i] += 1
                gone[i + length if i + length < len(gone) else -1] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) > 0).sum())
        out.append((len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (60, 70, 90, 200)] + ["x" * 399, "y" * 400, "ab" * 300, "q" * 1500]
    texts = [text(300) for _ in range(10)]
    for i in range(60):
        texts.append(text(rnd.randint(0, 120)) + rnd.choice(passages) + text(rnd.randint(0, 120)))
    texts += [texts[0], texts[0], texts[1][:700] + "Z" + texts[1][701:], texts[2][300:1100], "", "short", passages[3] * 2]
    long = text(2000)
    return texts + [long[:-3] + "end", long]


def got(df):
    return {r.doc.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def test_cut_equals_brute_force(make_docs):
    texts = corpus()
    docs = make_docs([*enumerate(texts), (1000, None)], extra="key")
    want = brute([t.encode() for t in texts] + [b""])
    found = got(suffix_dedup.cut(docs))
    assert [found[i] for i in [*range(len(texts)), 1000]] == want
    assert sum(w[1] for w in want) > 20000
    assert suffix_dedup.cut(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 8])
def test_large_groups_are_split(make_docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_REGIONS", most)
    texts = corpus()
    found = got(suffix_dedup.cut(make_docs(list(enumerate(texts)))))
    assert [found[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


def test_chunks_of_long_texts():
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"abc") for _ in range(3000))
    whole = [np.concatenate(x) for x in zip(*suffix_dedup.anchor_regions(data))]
    old, suffix_dedup.CHUNK = suffix_dedup.CHUNK, 500
    suffix_dedup._powers.cache_clear()
    try:
        parts = [np.concatenate(x) for x in zip(*suffix_dedup.anchor_regions(data))]
    finally:
        suffix_dedup.CHUNK = old
        suffix_dedup._powers.cache_clear()
    expand = lambda r: [p for s, p, e in zip(*r) for _ in range(e - s)]
    assert expand(whole) == expand(parts) and len(expand(whole)) == len(data) - 399


@pytest.mark.parametrize("limit", [1000, 1 << 20])
def test_queue_and_induction(limit, monkeypatch):
    monkeypatch.setattr(induced_sort, "BLOCK_RECORDS", 20)
    rnd = random.Random(2)
    span, records = 5, []
    for i in range(300):
        left = bytes(rnd.choice(b"a\x00") for _ in range(rnd.randint(0, span)))
        right = bytes(rnd.choice(b"a\x00") for _ in range(rnd.randint(span - len(left), span)))
        records.append((rnd.randrange(9), right, left, span, i))
    strings = {}
    for g, right, left, _, i in records:
        for o in range(span + 1):
            if o <= len(left) and span - o <= len(right):
                strings.setdefault((g, o, left[len(left) - o :], right[: span - o]), []).append(i)
    want = {(i, k[1]) for k, v in strings.items() if len(v) > 1 for i in v}
    found = {(i, o) for i, r in induced_sort.repeats(records, limit) for a, b in r for o in range(a, b + 1)}
    assert found == want and want


def plain_passages(texts, size=51):
    """Words inside runs of ``size`` words that start twice, and the texts without them."""
    seen, out = {}, []
    for t in texts:
        own = t.encode().split()
        for i in range(len(own) - size + 1):
            run = tuple(own[i : i + size])
            seen[run] = seen.get(run, 0) + 1
    for t in texts:
        own = t.encode().split()
        hit = set()
        for i in range(len(own) - size + 1):
            if seen[tuple(own[i : i + size])] > 1:
                hit |= set(range(i, i + size))
        # Each word with the white space after it; what stands before the first word stays.
        parts = re.findall(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t.encode())
        lead = t.encode()[: len(t.encode()) - len(b"".join(parts))]
        out.append((lead + b"".join(p for i, p in enumerate(parts) if i not in hit)).decode())
    return out


def word_corpus():
    rnd = random.Random(3)
    text = lambda n, gap=" ": gap.join(rnd.choice(["a", "é", "of", "日本", "x1", "the"]) + str(rnd.randint(0, 30)) for _ in range(n))
    shared = [text(n) for n in (50, 51, 52, 70, 200)]
    texts = [text(150) for _ in range(12)]
    texts += [" ".join([text(rnd.randint(0, 40)), rnd.choice(shared), text(rnd.randint(0, 40))]) for _ in range(50)]
    texts += [shared[3].replace(" ", "\n\t "), "  " + shared[2], texts[0], texts[0] + " end", "", "one", "w " * 60, shared[1] + " " + shared[1]]
    return texts


@pytest.mark.parametrize("most", [4096, 3])
def test_passages_equal_plain_search(make_docs, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "GROUP_REGIONS", most)
    texts = word_corpus()
    docs = make_docs([*enumerate(texts), (1000, None)], extra="kept")
    rows = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cut_passages(docs).collect()}
    want = plain_passages(texts)
    assert [rows[i] for i in range(len(texts))] == [(t, len(t)) for t in want]
    assert rows[1000] == (None, None) and sum(a != b for a, b in zip(want, texts)) > 30
    assert suffix_dedup.cut_passages(docs).columns == docs.columns
    assert suffix_dedup.cut_passages(docs.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, `odd name` int, key string, _kept string, doc string, passages int"
    rows = [(1, " ".join(f"w{i}" for i in range(80)), 3, "k", "u", "d", 4), (2, " ".join(f"w{i}" for i in range(10, 70)), None, None, "v", "e", 5)]
    docs = spark.createDataFrame(rows, schema)
    cut = suffix_dedup.cut_passages(docs).orderBy("doc_id").collect()
    assert [r.text for r in cut] == [" ".join(f"w{i}" for i in [*range(10), *range(70, 80)]), ""]
    assert cut[0]["odd name"] == 3 and cut[0]["_kept"] == "u" and cut[0]["passages"] == 4
    assert suffix_dedup.cut(docs).select("doc.`odd name`").count() == 2


def test_joins_take_the_marked_texts_alone(spark, make_docs):
    texts = suffix_dedup._texts(make_docs([(i, f"text {i}") for i in range(2000)] + [(2000, None), (2001, "text 0")]))
    keys = texts.where("doc.doc_id % 100 = 0").select("key")
    some, rest = ([r.doc.doc_id for r in x.collect()] for x in suffix_dedup.marked(texts, keys))
    assert sorted(some + rest) == list(range(2002))
    assert {*range(0, 2001, 100), 2001} <= set(some) and len(some) < 60
    some, rest = suffix_dedup.marked(texts, keys.limit(0))
    assert some.count() == 0 and rest.count() == 2002


def test_short_texts_keep_small_tables(monkeypatch):
    sizes, powers = [], suffix_dedup._powers
    monkeypatch.setattr(suffix_dedup, "_powers", lambda n: sizes.append(n) or powers(n))
    assert list(suffix_dedup.anchor_regions(b"ab" * 1000)) and sizes == [1 << 16]
    assert list(suffix_dedup.anchor_regions(b"ab" * 50000)) and sizes[1:] == [1 << 17]


def test_regions_without_a_second_anchor_are_not_joined(make_docs, monkeypatch):
    rnd, seen, plain = random.Random(4), [], suffix_dedup.marked

    def spy(rows, keys, *on):
        found = plain(rows, keys, *on)
        if "region" in rows.columns:
            known = {r.anchor for r in keys.collect()}
            rows, some = ([r.anchor for r in x.collect()] for x in (rows, found[0]))
            seen.append((len(rows), len(some), sum(a in known for a in rows), sum(a in known for a in some)))
        return found

    monkeypatch.setattr(suffix_dedup, "marked", spy)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(120)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[0] + " more"), (301, "less " + texts[1])]
    known = {r.key: r.passages for r in suffix_dedup.passages(make_docs(rows)).collect()}
    assert len(known) == 4
    [(regions, joined, again, kept)] = seen
    assert again == kept > 0 and joined < again + 0.2 * regions
