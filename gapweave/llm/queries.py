"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import brown, bytebpe, egojoin, jaccard, licenses, negatives, packing, pu, quality, suffix, topk, toxicity, transducer, variants
from gapweave.llm.common import id_crc, spill, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(cut)


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 200 bytes that occur elsewhere."""
    done = suffix.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    n, kept = F.octet_length("raw").cast("long"), F.octet_length("kept").cast("long")
    return done.select(
        "doc_id", n.alias("n_bytes"), (n - kept).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def not_held_out(parts: int, rest: int) -> Callable[[str], Column]:
    return lambda column: id_crc(column) % parts != rest


def _classified(docs: DataFrame, model: pu.Model, scorer: Callable, parts: int, rest: int, least: float) -> DataFrame:
    scored = pu.score(docs, model, scorer)
    return scored.select(
        "doc_id", (id_crc("doc_id") % parts == rest).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of every fifth are held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), not_held_out(5, 0))
    return _classified(docs, model, quality.scorer, 5, 0, 0.3)


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between vectors of one label, and their components."""
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93).select("vec_id", "n_links", "component_id", "kept")


SQL["op4_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, root.component_id, e.vec_id = root.component_id AS kept
FROM embeddings e JOIN root ON root.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


@query
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.filter(F.col("vec_id") % 100 == 0), 10)


SQL["op5_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    trip = transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
    return trip.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class-bigram log10 probabilities of every document; every seventh is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = brown.fit(docs.filter(not_held_out(7, 2)("doc_id")))
    each = math.log10(model.tokens + model.distinct + 1)
    return brown.score(docs, model).select(
        "doc_id", (id_crc("doc_id") % 7 == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of every third are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), not_held_out(3, 1))
    return _classified(docs, model, toxicity.scorer, 3, 1, 0.7)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of which lose a letter, with the more frequent spelling each leads to."""
    words = variants.vocabulary(table(spark, sf_dir, "documents"), 5, 3, variants.letter_lost(97))
    return variants.group(spill(words), 2)


SQL["op11_spelling_variants"] = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))
), r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
u AS (
  SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))) AS b FROM d
), h AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM u, t),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), g AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) x(i)),
p AS (
  SELECT a.word, b.word AS other FROM g a JOIN g b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM g JOIN w ON g.less = w.word
  UNION SELECT w.word, g.word FROM g JOIN w ON g.less = w.word
), q AS (SELECT p.word, p.other, w.n AS other_n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN w ON w.word = p.other),
f AS (SELECT w.word, w.n, coalesce(q.n_near, 0)::BIGINT AS n_near, CASE WHEN q.other_n >= 2 * w.n THEN q.other END AS form, CASE WHEN q.other_n >= 2 * w.n THEN q.other_n END AS form_n FROM w LEFT JOIN q ON q.word = w.word AND q.k = 1),
c AS (
  SELECT word, word AS place, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.place WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(place, step) AS root FROM c GROUP BY word) e ON e.word = f.word
"""


@query
def op12_byte_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bytebpe.encode(table(spark, sf_dir, "documents"), *file, offsets=False)
    return bytebpe.decode(ids, *file).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector; every seventh has its label moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows, F.col("vec_id") % 50 == 0, 5, 3)


SQL["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON len(a.e) = len(c.e) WHERE a.vec_id % 50 = 0 AND (a.label <> c.label OR a.vec_id <> c.vec_id)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
