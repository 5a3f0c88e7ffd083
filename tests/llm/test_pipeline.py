import hashlib
import re

import tiktoken
from test_near_texts import plain_near_classes
from test_suffix_dedup import plain_passages

import corpus_pipeline
import public_tokenizers as P
from trialspark.llm import byte_bpe, mixing


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300")
    columns = docs.columns
    (_, language), (_, near), (_, passages), (_, mixed), (_, encode) = corpus_pipeline.STAGES
    rows = {r.doc_id: r.text for r in docs.collect()}

    one = language(spark, docs, sf)
    assert one.columns == columns
    want = {i: t for i, t in rows.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id: r.text for r in one.collect()} == want

    two = near(spark, one, sf)
    classes = plain_near_classes(list(want.values()))
    first = {}
    for i, c in zip(want, classes):
        first[c] = min(first.get(c, i), i)
    want = {i: want[i] for i in sorted(first.values())}
    assert two.columns == columns and {r.doc_id: r.text for r in two.collect()} == want

    three = passages(spark, two, sf)
    cut = plain_passages(list(want.values()))
    got = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == columns and got == dict(zip(want, cut)) and got != want

    four = mixed(spark, three, sf)
    copies = {r.doc.doc_id: r.copies for r in mixing.plan(three).collect()}
    taken = [r.doc_id for r in four.collect()]
    assert four.columns == columns and sorted(taken) == sorted(i for i, n in copies.items() for _ in range(n))

    ranks = byte_bpe.load(corpus_pipeline.RANKS, P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    five = encode(spark, four, sf).collect()
    assert len(five) == len(taken)
    for r in five:
        assert r.ids == library.encode_ordinary(got[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(got[r.doc_id].encode()).hexdigest()


def test_run_applies_every_stage(spark, tmp_path):
    rows = [(i, f"Dies ist ein kurzer Satz mit der Nummer {i} und etwas mehr", "de", "a", 50) for i in range(8)]
    rows += [(20 + i, f"This is a short sentence number {i} with a few more words", "en", "b", 50) for i in range(8)]
    rows += [(40, None, None, None, None), (41, "", "en", "b", 0), (42, "1234 5678", None, "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and {r.doc_id for r in found} <= {r[0] for r in rows[:16]} and all(r.ids for r in found)
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run


def test_run_on_empty_and_all_null_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("nulls", [(None,) * 5] * 4)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
