import math
import zlib
from collections import Counter

import numpy as np
import pytest

from trialspark.llm import katz

END = object()


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w] + [END]


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            words = tokens(t)
            self.one.update(words)
            self.two.update(zip([END, *words], words))
        self.n, self.v = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = self.ratios(self.one), self.ratios(self.two)
        less = sum(c * (1 - self.d1(c)) for c in self.one.values()) / max(self.n, 1)
        self.unseen = max(less, 1 / (self.n + self.v + 1)) if self.n else 1.0
        self.factor = (1 - self.unseen) / (1 - less) if less < 1 else 0.0
        self.after = {}
        for (h, w), c in self.two.items():
            self.after.setdefault(h, {})[w] = c

    @staticmethod
    def ratios(counts):
        n = Counter(counts.values())
        top = 6 * n[6] / n[1] if n[1] else 0
        ratio = {c: ((c + 1) * n[c + 1] / (c * n[c]) - top) / (1 - top) if n[c] and top < 1 else 0 for c in range(1, 6)}
        if not all(0 < r < 1 for r in ratio.values()) or not n[6]:
            off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
            ratio = {c: (c - off) / c for c in range(1, 6)}
        return lambda c: ratio.get(c, 1.0)

    def p1(self, w):
        c = self.one[w]
        return self.factor * c * self.d1(c) / self.n if c else self.unseen

    def p(self, w, h):
        known = self.after.get(h)
        if not known:
            return self.p1(w)
        total = sum(known.values())
        seen = sum(c * self.d2(c) for c in known.values()) / total
        scale = total / (total + 0.5) if not any(c <= 5 for c in known.values()) else 1.0
        if w in known:
            return scale * known[w] * self.d2(known[w]) / total
        return (1 - scale * seen) / (1 - sum(map(self.p1, known))) * self.p1(w)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, got):
    model = Plain([t for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    by_key = {}
    for i, t in rows:
        words = tokens(t)
        base = sum(math.log10((model.one[w] + 1) / (model.n + model.v + 1)) for w in words)
        score = sum(math.log10(model.p(w, h)) for h, w in zip([END, *words], words))
        by_key.setdefault((i, held(i), len(words), sum(model.one[w] > 0 for w in words), model.n), []).append((base, score))
    for r in got:
        found = by_key[(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)]
        assert any(abs(r.base_score - b) < 1e-9 * max(1, -b) and abs(r.score - s) < 1e-8 * max(1, -s) for b, s in found)
    return model


@pytest.fixture(scope="module")
def rows(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150").select("doc_id", "text").collect()
    odd = [(1000, None), (1001, ""), (None, "no id here"), (1002, "Word" * 3000), (1003, "the the the " * 900), (7, "again")]
    return [(r.doc_id, r.text) for r in given] + odd


def test_scores_equal_a_plain_model(rows, make_docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 4000)
    model = check(rows, katz.score(make_docs(rows, extra="block")).collect())
    words = [*model.one, "never seen before"]
    for h in [END, "the", *list(model.after)[:40], "never seen before"]:
        assert abs(sum(model.p(w, h) for w in words) - 1) < 1e-9


def test_frequent_and_missing_counts(make_docs):
    check([(i, "a b a b c") for i in range(40)], katz.score(make_docs([(i, "a b a b c") for i in range(40)])).collect())
    only_held = [(i, "x y") for i in range(400) if held(i)]
    check(only_held, katz.score(make_docs(only_held)).collect())
    assert katz.score(make_docs([(1, "a")]).limit(0)).count() == 0


def test_discounts_reserve_mass():
    d = katz.Discounts.of(1000, 300, [200, 60, 30, 18, 12, 8])
    assert ((d.ratio[1:] > 0) & (d.ratio[1:] < 1)).all()
    assert np.isclose(katz.Words.of(d, [200, 60, 30, 18, 12, 8]).unseen, 0.2)
