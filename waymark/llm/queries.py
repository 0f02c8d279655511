"""The registered queries of the corpus operators, each beside the SQL that checks it where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import (
    dart_minhash, divergence, exact_dedup, html_text, language, license_scan, mixing, negatives, packing, surrogates, token_index, topk, toxicity,
)
from waymark.llm.common import held_out, table, work_dir
from waymark.session import prepare


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def with_domain(documents: DataFrame) -> DataFrame:
    """Add the domain of a source: four, by the number at the end of its name, and one of all others."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    named = F.when(number != "", F.concat(F.lit("domain"), (F.substring(number, -2, 2).cast("int") % 4).cast("string")))
    return documents.withColumn("mix_domain", F.coalesce(named, F.lit("other")))


MIX_LEVELS = ("mix_domain", "lang", "source")


def mix_weights() -> list:
    """Fixed parameters of the mix: weights of the domains, of the languages within each, and of the sources within these."""
    domain, lang = F.col("mix_0"), F.col("mix_1")
    domains = F.when(domain == "domain0", 2).when(domain == "domain1", 4).when(domain == "domain2", 3).otherwise(1)
    languages = F.when(lang == "en", 4).when(lang.isin("de", "fr"), 3).otherwise(2)
    return [domains, languages, F.lit(1)]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = with_domain(table(spark, sf_dir, "documents"))
    drawn = mixing.draw(documents, MIX_LEVELS, mix_weights(), share=0.6)
    return drawn.select(
        "doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col(mixing.EPOCH).alias("epoch"),
        F.col(mixing.TOKENS).alias("tokens"), F.col(mixing.TAKEN).alias("taken"),
    )


OP2 = """
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS digest, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         CASE WHEN regexp_extract(source, '([0-9]+)$', 1) <> ''
              THEN 'domain' || CAST(CAST(right(regexp_extract(source, '([0-9]+)$', 1), 2) AS INTEGER) % 4 AS VARCHAR)
              ELSE 'other' END AS domain,
         CAST((strlen(coalesce(text, '')) + 3) // 4 + 1 AS BIGINT) AS tokens
  FROM documents
),
leaf AS (SELECT domain, l, s, CAST(sum(tokens) AS HUGEINT) AS supply, CAST(3 * sum(tokens) AS HUGEINT) AS most FROM d GROUP BY ALL),
n1 AS (
  SELECT domain, sum(most) AS most,
         CAST(CASE domain WHEN 'domain0' THEN 2 WHEN 'domain1' THEN 4 WHEN 'domain2' THEN 3 ELSE 1 END AS HUGEINT) AS weight,
         (SELECT CAST(floor(sum(supply) * CAST(0.6 AS DOUBLE)) AS HUGEINT) FROM leaf) AS budget
  FROM leaf GROUP BY domain
),
f1 AS (
  SELECT *, most * (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))
            <= greatest(budget - coalesce(sum(most) OVER b, 0), 0) * weight AS is_full
  FROM n1 WINDOW b AS (ORDER BY most / CAST(weight AS DOUBLE), domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
q1 AS (
  SELECT domain, CASE WHEN is_full THEN most ELSE
      (budget - coalesce(sum(most) FILTER (is_full) OVER (), 0)) * weight // (sum(weight) FILTER (NOT is_full) OVER ()) END AS budget
  FROM f1
),
n2 AS (
  SELECT domain, l, sum(most) AS most,
         CAST(CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 3 ELSE 2 END AS HUGEINT) AS weight, any_value(q1.budget) AS budget
  FROM leaf JOIN q1 USING (domain) GROUP BY domain, l
),
f2 AS (
  SELECT *, most * (sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER b, 0))
            <= greatest(budget - coalesce(sum(most) OVER b, 0), 0) * weight AS is_full
  FROM n2 WINDOW b AS (PARTITION BY domain ORDER BY most / CAST(weight AS DOUBLE), domain, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
q2 AS (
  SELECT domain, l, CASE WHEN is_full THEN most ELSE
      (budget - coalesce(sum(most) FILTER (is_full) OVER p, 0)) * weight // (sum(weight) FILTER (NOT is_full) OVER p) END AS budget
  FROM f2 WINDOW p AS (PARTITION BY domain)
),
n3 AS (SELECT domain, l, s, supply, most, CAST(1 AS HUGEINT) AS weight, q2.budget FROM leaf JOIN q2 USING (domain, l)),
f3 AS (
  SELECT *, most * (sum(weight) OVER (PARTITION BY domain, l) - coalesce(sum(weight) OVER b, 0))
            <= greatest(budget - coalesce(sum(most) OVER b, 0), 0) * weight AS is_full
  FROM n3 WINDOW b AS (PARTITION BY domain, l ORDER BY most / CAST(weight AS DOUBLE), domain, l, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
q3 AS (
  SELECT domain, l, s, supply, CASE WHEN is_full THEN most ELSE
      (budget - coalesce(sum(most) FILTER (is_full) OVER p, 0)) * weight // (sum(weight) FILTER (NOT is_full) OVER p) END AS quota
  FROM f3 WINDOW p AS (PARTITION BY domain, l)
),
keyed AS (
  SELECT d.*, quota // supply AS full_passes, quota % supply AS part,
         md5('17|' || CAST(quota // supply AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), digest)) AS key
  FROM d JOIN q3 USING (domain, l, s)
),
last AS (
  SELECT *, part - coalesce(sum(tokens) OVER (PARTITION BY domain, l, s ORDER BY key, doc_id, tokens, digest
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM keyed
)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens, tokens AS taken
FROM (SELECT *, unnest(range(CAST(full_passes AS BIGINT))) AS epoch FROM keyed WHERE full_passes > 0)
UNION ALL
SELECT doc_id, domain, lang, source, CAST(full_passes AS INTEGER), tokens, CAST(least(tokens, remaining) AS BIGINT)
FROM last WHERE remaining > 0
"""


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "kept")


#: Key of the registered query. A real corpus needs a secret one.
SURROGATE_KEY = b"example key"


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.anonymise(documents, SURROGATE_KEY, work_dir(spark, "surrogates"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), work_dir(spark, "license-scan"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    model = toxicity.learn(documents, labels, work_dir(spark, "toxicity"))
    scored = toxicity.score(documents, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", predicted)


def op7_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "token-index")
    documents = table(spark, sf_dir, "documents")
    records, index = token_index.build(documents, folder, public_tokenizers.path("byte_bpe_50k.json"))
    places = token_index.lookup(records, index)
    read = token_index.read_ids(places, folder, "ids_read long, ids_crc32 long", token_index.digest)
    starts = token_index.shard_starts(records)
    return read.join(starts, "shard").select(
        "doc_id", token_index.start().alias("start"), F.col("ids_read").alias("n_tokens"), "ids_crc32"
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & topk.usable())
    vectors = embeddings.select("vec_id", topk.integers().alias("ints"))
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


OP8 = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.learn(documents.where(~held_out("doc_id", 3, 1)), work_dir(spark, "language"))
    found = language.classify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages, work_dir(spark, "html-text")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), work_dir(spark, "divergence"))


OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
w AS (SELECT lang, source, doc, unnest(words) AS term FROM d),
t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING sum(docs) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v,
         coalesce((SELECT sum(t.n) FROM t JOIN kept USING (lang, term) WHERE t.lang = d.lang AND t.source = d.source), 0) AS total
  FROM d LEFT JOIN l USING (lang) GROUP BY d.lang, d.source
),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(t.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(t.n, 0) + 1)) // (g.total + g.v) AS HUGEINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (l.total + l.v) AS HUGEINT) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER o AS INTEGER) AS rank FROM found
WINDOW o AS (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))
QUALIFY part = 'pair' OR row_number() OVER o <= 200
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(embeddings.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.ints, c.ints) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id,
       positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
WHERE 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""


OP9 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_surrogates": op4_surrogates,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_index": op7_token_index,
    "op8_topk": op8_topk,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language": op10_language,
    "op11_html_text": op11_html_text,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}
CHECKS = {"op2_mixing": OP2, "op8_topk": OP8, "op9_exact_dedup": OP9, "op12_source_divergence": OP12, "op13_hard_negatives": OP13}


def queries() -> dict:
    def ready(query):
        return lambda spark, sf_dir: query(prepare(spark), sf_dir)

    return {name: ready(query) for name, query in QUERIES.items()}
