"""The registered training-data queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe,
    exact_topk,
    html_templates,
    katz,
    kernel_langid,
    license_scan,
    merkle,
    mixing,
    orchard,
    permutation_index,
    simhash_index,
    suffix_dedup,
    wu_manber,
)
from .common import lookup, small_batches, store, table, utf8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


MIX_SQL = r"""
WITH docs AS (
    SELECT doc_id, source, text,
           CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM docs GROUP BY source),
weighed AS (
    SELECT source, source_size, 3 * source_size AS most,
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS HUGEINT) AS w
    FROM sources),
ordered AS (
    SELECT *, sum(source_size) OVER () AS total,
           coalesce(sum(most) OVER by_ratio, 0) AS used,
           sum(w) OVER () - coalesce(sum(w) OVER by_ratio, 0) AS free
    FROM weighed
    WINDOW by_ratio AS (ORDER BY CAST(most AS DOUBLE) / w, source NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, (total - used) * w > most * free AS above FROM ordered),
rest AS (
    SELECT CAST(any_value(total) - coalesce(sum(most) FILTER (above), 0) AS DOUBLE) AS spare,
           CAST(sum(w) FILTER (NOT above) AS DOUBLE) AS share
    FROM stopped),
targets AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size,
           CASE WHEN above THEN CAST(most AS DOUBLE) ELSE spare * CAST(w AS DOUBLE) / share END AS target
    FROM stopped, rest),
rated AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
           CAST(CAST('0x' || substr(md5('mix-1 ' || coalesce(CAST(d.doc_id AS VARCHAR),
                'text ' || md5(coalesce(d.text, '')))), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS coin
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rated
"""


@query("op1_mix_sources", MIX_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.plan(table(spark, sf_dir, "documents"))
    return taken.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op2_permutation_index")
def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"))


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return byte_bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query("op4_katz_scores")
def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return katz.score(table(spark, sf_dir, "documents"))


@query("op5_html_main_text")
def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_templates.extract(table(spark, sf_dir, "pages"))


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    # Digests take the texts' place before the join, so that it shuffles no text.
    cut = suffix_dedup.cut(docs).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        F.xxhash64(utf8("doc.text")).alias("of"), F.col("n_bytes").alias("size"),
    )
    # What repeats over more than fifty words, in columns of its own: such passages may have fewer bytes.
    known = store(suffix_dedup.passages(docs), "op8-passages")
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"])
    known = known.select(F.col("key").alias("of"), F.col("n").alias("size"), F.size("passages").alias("runs"), words.alias("words"))
    return cut.join(known, ["of", "size"], "left").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
        F.coalesce("runs", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("words", F.lit(0)).cast("long").alias("n_passage_words"),
    )


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return kernel_langid.identify(table(spark, sf_dir, "documents"))


@query("op6_simhash_classes")
def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash_index.classes(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


TOPK_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(any_value(embedding), lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


@query("op10_exact_topk", TOPK_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"))


MERKLE_SQL = r"""
WITH RECURSIVE rows_ AS (
    SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
           list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
               lambda x: coalesce(CAST(strlen(x) AS VARCHAR) || ':' || x, '-')) AS f,
           coalesce(CAST(strlen(CAST(n_chars + 1 AS VARCHAR)) AS VARCHAR) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') AS more,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda c: CAST(ord(c) AS BIGINT))),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) AS crc
    FROM documents),
leaves AS (
    SELECT rid, doc_id, lang, sha256(array_to_string(f, '')) AS leaf,
           CASE WHEN crc % 7 = 0 THEN sha256(f[1] || f[2] || f[3] || more || f[5]) ELSE sha256(array_to_string(f, '')) END AS start
    FROM rows_),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
tree AS (
    SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
    UNION ALL
    SELECT lang, level + 1, pos // 2, (n + 1) // 2, parent
    FROM (SELECT *, sha256(node || coalesce(lead(node) OVER (PARTITION BY lang ORDER BY pos), '')) AS parent
          FROM tree WHERE n > 1)
    WHERE pos % 2 = 0),
roots AS (
    SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
    FROM tree WHERE n = 1),
upper_ AS (
    SELECT 0 AS level, pos, n, subroot AS node FROM roots
    UNION ALL
    SELECT level + 1, pos // 2, (n + 1) // 2, parent
    FROM (SELECT *, sha256(node || coalesce(lead(node) OVER (ORDER BY pos), '')) AS parent FROM upper_ WHERE n > 1)
    WHERE pos % 2 = 0),
steps AS (
    SELECT p.rid, t.level AS k, (p.pos >> t.level) & 1 AS slot, coalesce(s.node, '') AS sib
    FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.pos = p.pos >> t.level AND t.n > 1
    LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos = xor(t.pos, 1)
    UNION ALL
    SELECT p.rid, 1000 + u.level, (r.pos >> u.level) & 1, coalesce(s.node, '')
    FROM placed p JOIN roots r ON r.lang IS NOT DISTINCT FROM p.lang
    JOIN upper_ u ON u.pos = r.pos >> u.level AND u.n > 1
    LEFT JOIN upper_ s ON s.level = u.level AND s.pos = xor(u.pos, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) AS i FROM steps),
proofs AS (SELECT rid, count(*) AS m, sha256(string_agg(sib, '' ORDER BY i)) AS proof FROM numbered GROUP BY rid),
folds AS (
    SELECT rid, 0 AS i, start AS node FROM placed
    UNION ALL
    SELECT f.rid, f.i + 1, sha256(CASE WHEN s.slot = 0 THEN f.node || s.sib ELSE s.sib || f.node END)
    FROM folds f JOIN numbered s ON s.rid = f.rid AND s.i = f.i + 1)
SELECT p.doc_id, p.leaf, r.subroot, u.node AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       f.node AS folded_root, f.node = u.node AS verified
FROM placed p JOIN roots r ON r.lang IS NOT DISTINCT FROM p.lang
JOIN upper_ u ON u.n = 1
LEFT JOIN proofs q ON q.rid = p.rid
JOIN folds f ON f.rid = p.rid AND f.i = coalesce(q.m, 0)
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def _rounds_sql(rounds: int = 3) -> str:
    """Plain rounds over all pairs of vector and centroid."""
    parts = ["""
WITH v AS (
    SELECT row_number() OVER () AS rid, vec_id, embedding,
           list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS j, e AS c
    FROM v QUALIFY j < 16)"""]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
    SELECT rid, vec_id, e, j, c, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v, c{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, j) = 1)""")
        if r < rounds:
            parts.append(f"""
s{r} AS (
    SELECT j, i, sum(e[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY j, i),
m{r} AS (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (
    SELECT j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (j))""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds}
"""


@query("op12_orchard_clusters", _rounds_sql())
def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings"))


LEAKS_SQL = r"""
WITH w AS (
    SELECT row_number() OVER () AS rid, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents),
items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS m, array_to_string(words[p : p + least(len(words), 10) - 1], ' ') AS win
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM items WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
    SELECT rid, m, p, array_to_string(words[p : p + m - 1], ' ') AS win
    FROM (SELECT rid, words, m, unnest(range(1, len(words) - m + 2)) AS p FROM w, lengths WHERE len(words) >= m)),
found AS (
    SELECT d.rid, d.p, d.m, i.item_id FROM doc_windows d JOIN item_windows i ON i.win = d.win AND i.m = d.m),
hits AS (
    SELECT rid, count(DISTINCT word) AS n_hit
    FROM (SELECT rid, unnest(range(p, p + m)) AS word FROM (SELECT DISTINCT rid, p, m FROM found)) GROUP BY rid),
named AS (
    SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""


@query("op13_benchmark_leaks", LEAKS_SQL)
def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = wu_manber.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
