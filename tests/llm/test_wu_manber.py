import random
import re

import pytest

from trialspark.llm import wu_manber

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        own = plain_words(text)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item or "")
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        own, hit, found = plain_words(text), set(), set()
        for m in lengths:
            for i in range(len(own) - m + 1):
                if tuple(own[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(own[i : i + m])]
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    for r in rows:
        assert r.n_hit == sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "a", "é", "straße", "Q4", "x", "日本", "and", "No"]
    text = lambda n: rnd.choice([" ", ", ", "\n", "_"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(rnd.randint(1, 40))) for k in range(25)]
    items += [("i3", text(12)), ("short", "Unique-phrase"), ("none", " ... "), ("null", None), (None, text(15)), ("copy", items[0][1])]
    docs = []
    for k in range(80):
        parts = [text(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 2)):
            own = plain_words(rnd.choice(items)[1])
            at = rnd.randint(0, max(0, len(own) - 10))
            parts += [" ".join(own[at : at + rnd.randint(5, 20)]).upper(), text(rnd.randint(0, 9))]
        docs.append((k, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "unique phrase"), (103, "uniquephrase"), (103, "a unique\x00PHRASE b"), (None, docs[0][1])]
    return docs, items


@pytest.fixture
def frames(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, number int")
    return docs, items, make_docs(docs, extra="numbers"), bench


@pytest.mark.parametrize("table", [1 << 16, 40])
def test_equals_brute_force(frames, monkeypatch, table):
    monkeypatch.setattr(wu_manber, "TABLE_WINDOWS", table)
    docs, items, df, bench = frames
    want = plain(docs, items)
    assert got(wu_manber.contaminated(df, bench)) == want
    assert sum(w[2] > 0 for w in want) > 30


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_windows_across_chunks(monkeypatch, chunk):
    monkeypatch.setattr(wu_manber, "CHUNK", chunk)
    docs, items = corpus(2)
    found = sorted({w for _, t in items for w in wu_manber.item_windows((t or "").encode())})
    found = wu_manber.tables([(w, n) for n, w in enumerate(found)])
    for doc in docs:
        total, spans, _ = wu_manber.search((doc[1] or "").encode(), found)
        assert (total, sum(b - a for a, b in spans)) == plain([doc], items)[0][1:3]


def test_other_window_sizes(frames):
    docs, items, df, bench = frames
    assert got(wu_manber.contaminated(df, bench, 13)) == plain(docs, items, 13)


def test_empty_tables(frames):
    docs, items, df, bench = frames
    assert wu_manber.contaminated(df.limit(0), bench).count() == 0
    assert got(wu_manber.contaminated(df, bench.limit(0))) == plain(docs, [])


def test_one_passage_in_many_items_and_long_texts(spark, make_docs):
    passage = " ".join(f"w{i}" for i in range(12))
    items = [(f"k{i:04}", passage) for i in range(500)]
    long = "lorem " * 150000 + passage + " ipsum" * 50000
    docs = [(i, passage) for i in range(50)] + [(99, long)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, n int")
    rows = got(wu_manber.contaminated(make_docs(docs), bench))
    assert [r[1:3] for r in rows if r[0] == 99] == [(200012, 12)]
    assert all(r[3] == [i for i, _ in items] for r in rows)


def test_shifts_skip_positions():
    patterns = [b" ".join(b"p%d" % i for i in range(10))]
    table = wu_manber.tables([(p, 0) for p in patterns])[0]

    class Counted(list):
        reads = 0

        def __getitem__(self, key):
            Counted.reads += 1
            return super().__getitem__(key)

    text = Counted(b"q%d" % i for i in range(9000))
    assert list(table.find(text)) == [] and Counted.reads <= 2 * 1001
