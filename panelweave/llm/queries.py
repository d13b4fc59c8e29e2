"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

import hashlib
import importlib
import os


from pyspark.sql import functions as F

from panelweave.llm import chat, dedup, fingerprint, langid, lm, mixing, packing, resample, secrets, topk, toxicity, urltree, vectorcode
from panelweave.llm.common import table


def vocabulary_file(name: str) -> str:
    """A public vocabulary's file; the folder is a setting."""
    folder = os.environ.get("PANELWEAVE_TOKENIZERS")
    return f"{folder}/{name}" if folder else importlib.import_module("public_tokenizers").path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, machine).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, vocabulary_path=vocabulary_file("piece_bpe_32k.model"), held_out=langid.held_out())
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_dedup(spark, sf_dir):
    return dedup.group(table(spark, sf_dir, "documents"), words=4, share=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer=vocabulary_file("word_bpe_49k.json"), capacity=4096, end_id=2)


def op10_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


def op3_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents")).withColumn("lm_score", F.round("lm_score", 6))


#: Wanted shares of tokens by domain.
TARGETS = {"en": 0.42, "de": 0.18, "fr": 0.18, "es": 0.14, "junk": 0.08}


def op5_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.domains_of(docs, table(spark, sf_dir, "labels")), targets=TARGETS)


#: Host and path rules; the longest that fits wins.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op6_urls(spark, sf_dir):
    return urltree.judge(table(spark, sf_dir, "pages"), RULES)


def op8_chat(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_fingerprints(spark, sf_dir):
    found = fingerprint.fingerprint(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    books = vectorcode.learn(rows, parts=16, entries=64, rounds=2, scale=256)
    coded = vectorcode.with_label_error(vectorcode.encode(rows, books))
    sha = hashlib.sha256(books.text().encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op12_secrets(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents"), rate=0.05)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k))  # noqa: E731  (a second parameter of the inner one would be the span's index)
    counts = [of_kind(k).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    more = [F.size("added").cast("long").alias("n_random"), F.col("n_confirmed").cast("long").alias("n_confirmed")]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"), secrets.span_text(F.concat("base", "added")).alias("spans"), *more)


def op13_resampling(spark, sf_dir):
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, longest=2, seed=7)


OP3_SQL = """
WITH listed AS (
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\s+')) AS raw, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\s+'), 1) AS i FROM documents
), words AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM (SELECT doc_id, i, regexp_replace(lower(raw), '[^\\p{L}]+', '', 'g') AS word FROM listed) WHERE word <> ''
), grams AS (
  SELECT *, lag(word) OVER d AS w1, lag(word, 2) OVER d AS w2 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), counted AS (
  SELECT *, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY doc_id, word) AS c1,
         count(*) OVER (PARTITION BY w1, word) - count(*) OVER (PARTITION BY doc_id, w1, word) AS c2,
         count(*) OVER (PARTITION BY w2, w1, word) - count(*) OVER (PARTITION BY doc_id, w2, w1, word) AS c3, count(*) OVER () AS n
  FROM grams
), context AS (
  SELECT *, lag(c1) OVER d AS x1, lag(c2) OVER d AS x2 FROM counted WINDOW d AS (PARTITION BY doc_id ORDER BY p)
), scored AS (
  SELECT doc_id, CASE WHEN w2 IS NOT NULL AND c3 > 0 THEN ln(c3 / greatest(x2, c3))
       WHEN w1 IS NOT NULL AND c2 > 0 THEN ln(c2 / greatest(x1, c2)) + CASE WHEN w2 IS NOT NULL THEN ln(0.4) ELSE 0 END
       ELSE ln(greatest(c1, 1) / n) + ln(0.4) * (CASE WHEN w2 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN w1 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN c1 = 0 THEN 1 ELSE 0 END) END AS s,
       CASE WHEN w2 IS NOT NULL THEN c3 = 0 WHEN w1 IS NOT NULL THEN c2 = 0 ELSE c1 = 0 END AS fell
  FROM context
)
SELECT doc_id, count(s) AS n_tokens, count(*) FILTER (WHERE fell) AS n_backed_off, round(avg(s), 6) AS lm_score
FROM documents LEFT JOIN scored USING (doc_id) GROUP BY doc_id
"""

OP10_SQL = """
WITH fine AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), scored AS (
  SELECT q.r AS of, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY of ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

def op11_sql() -> str:
    """Two rounds and the last assignment as one chain of tables, every part against every entry."""
    steps = []
    for n in range(3):
        steps.append(f"""a{n} AS (
  SELECT r, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (SELECT x.r, x.p, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM parts x JOIN c{n} c USING (p, i) GROUP BY ALL) GROUP BY r, p
)""")
        if n < 2:
            steps.append(f"""c{n + 1} AS (
  SELECT c.p, c.e, c.i, coalesce(m.x, c.x) AS x FROM c{n} c
  LEFT JOIN (SELECT a.p, a.e, x.i, CAST(floor(sum(x.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM a{n} a JOIN parts x USING (r, p) GROUP BY ALL) m USING (p, e, i)
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * c::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, (k - 1) // (n // 16) AS p, (k - 1) % (n // 16) AS i, v[k] AS x FROM (SELECT *, len(v) AS n, unnest(range(1, len(v) + 1)) AS k FROM kept)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 64)
), c0 AS (SELECT p, e, i, x FROM parts JOIN first USING (vec_id)), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}, coded AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r
), books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS s FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM books) AS codebooks_sha256 FROM kept JOIN coded USING (r)
"""


OP13_SQL = """
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark
), features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), crc AS (  -- the checksum's table, then one step a byte
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)
), hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), crc
), counted AS (
  SELECT b, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY b
), gains AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM counted
), weighed AS (
  SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM features JOIN hashed USING (f) JOIN gains USING (b) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM words LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id, r) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_lm": op3_lm,
    "op4_dedup": op4_dedup,
    "op5_mixing": op5_mixing,
    "op6_urls": op6_urls,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_fingerprints": op9_fingerprints,
    "op10_topk": op10_topk,
    "op11_codes": op11_codes,
    "op12_secrets": op12_secrets,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {"op3_lm": OP3_SQL, "op8_chat": chat.ROTATE_SQL, "op10_topk": OP10_SQL, "op11_codes": op11_sql(), "op13_resampling": OP13_SQL}
