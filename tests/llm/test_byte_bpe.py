import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from trialspark.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", "ab", "the", " ", "  ", "\n", "'", "'re", "'s", "1", "23", "é", "ß", "漢字", "!", "...", "\t", "aaaa", "=", "==", "ing", "😀", "　", "́"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load(PATH, P.PATTERN).ranks, special_tokens={})


@pytest.mark.parametrize("chars, size", [(4, 2), (16, 4), (64, 8), (4096, 48)])
def test_tree_equals_library(reference, monkeypatch, chars, size):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", chars)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", size)
    monkeypatch.setattr(byte_bpe, "LEAF_IDS", chars)
    bpe = byte_bpe.Bpe(byte_bpe.load(PATH, P.PATTERN).ranks, P.PATTERN)
    rnd = random.Random(chars)
    for _ in range(1500):
        some = rnd.sample(ALPHABET, rnd.choice([1, 2, 3, len(ALPHABET)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, 200)))
        ids = bpe.encode(text).tolist()
        assert ids == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_long_runs(reference):
    bpe = byte_bpe.load(PATH, P.PATTERN)
    for text in ("a" * 5000, "xq" * 3000 + " " * 3000 + "z", "\n \n" * 4000, "é" * 4001):
        assert bpe.encode(text).tolist() == reference.encode_ordinary(text)


def test_digests(spark, sf, make_docs, reference):
    given = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 5 = 0").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in given] + [(1, None), (2, ""), (None, "x"), (2, "<|endoftext|>"), (2, "")]
    got = byte_bpe.digests(make_docs(rows, extra="ids"), PATH, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert byte_bpe.digests(make_docs(rows).limit(0), PATH, P.PATTERN).count() == 0


def test_round_trip_is_decode_of_encode(spark):
    texts = ["", None, "plain words", "naïve 日本語 👩‍💻", "x" * 9000, " \t\n a1b2  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    once = byte_bpe.round_trip(docs, PATH, P.PATTERN)
    key = lambda r: r.doc_id
    assert sorted(once.collect(), key=key) == sorted(apart.collect(), key=key)
