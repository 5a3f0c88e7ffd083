import zlib

from pyspark.sql import functions as F

from trialspark.llm import kernel_langid


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = kernel_langid.identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_only_text_counts(spark, make_docs, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in given]
    odd = [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !? 4", "fr", "s"), (None, rows[0][1], None, None),
           (903, rows[1][1] * 60, None, None), (rows[2][0], *rows[2][1:]), (904, "漢字かな", None, None)]
    docs = make_docs(rows + odd, extra="score")
    model = kernel_langid.fit(docs)
    got = kernel_langid.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    pred = {}
    for r in got:
        pred.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 5)))
    assert all(pred[i] == {("und", 0.0)} for i in (900, 901, 902))
    assert pred[None] == pred[rows[0][0]] and len(pred[rows[2][0]]) == 1
    assert {x for x, _ in pred[903]} == {x for x, _ in pred[rows[1][0]]}
    kept = kernel_langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(got) - 3


def test_stage_keeps_what_is_identified(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    gone = sorted(set(filter(None, lang.values())))[0]
    docs = docs.withColumn("lang", F.when(F.col("lang") != gone, F.col("lang")).otherwise("und"))
    model = kernel_langid.fit(docs)
    want = {r.doc_id for r in kernel_langid.identify(docs, model).collect() if r.lang_pred != "und"}
    got = {r.doc_id for r in kernel_langid.keep_identified(docs, model).collect()}
    assert got == want and 0 < len(got) < len(lang)
    assert sum(lang[i] != gone for i in got) >= 0.98 * len(got)


def test_landmark_blocks_lie_all_over_the_texts(spark):
    # Of many documents only those with a small draw are picked.
    ids = spark.range(200000).select(F.col("id").cast("string").alias("name"))
    draw = F.pmod(F.xxhash64(F.lit("languages"), F.col("name")), F.lit(1 << 32)) / float(1 << 32)
    start = kernel_langid._block_start(F.col("name"), F.lit(12048))
    got = [r.start for r in ids.where(draw < 5e-4).select(start.alias("start")).collect()]
    assert len(got) > 50 and min(got) >= 1 and max(got) <= 10001
    assert sum(x > 5000 for x in got) > len(got) / 4 and sum(x <= 5000 for x in got) > len(got) / 4


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "words", None, None), (2, None, "en", None)])
    assert {(r.lang_pred, r.score) for r in kernel_langid.identify(docs).collect()} == {("und", 0.0)}
    assert kernel_langid.identify(docs.limit(0)).count() == 0


def test_kernel_is_the_landmarks_expansion():
    import numpy as np

    texts = [b"the cat sat", b"le chat", b"x"]
    found = np.unique(np.concatenate([x for t in texts for x in kernel_langid.codes(np.frombuffer(t, np.uint8))]))
    grams = kernel_langid.Grams(found)
    rows = [next(grams.presence(t))[0] for t in texts]
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    for a, s in zip(rows, sets):
        for b, t in zip(rows, sets):
            assert abs(float(a @ b) - len(s & t) / (len(s) * len(t)) ** 0.5) < 1e-6
