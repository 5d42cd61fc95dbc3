"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlore.llm import (
    bpe_tree, language_filters, multiset_hash, packing, poisson_mix, prefix_forest, rank_stream, secret_links, shingle_join,
    token_counts, tool_links, triangle_negatives, turn_align,
)
from gridlore.llm.store import new_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SCHEMAS = [("search", "text", "string", True), ("search", "turn", "integer", True), ("search", "after", "string", False),
            ("note", "text", "string", True), ("note", "topic", "string", True)]


@_query("op1_tool_links", """
WITH asked AS (
  SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id,
         CASE WHEN turn >= 2 THEN conv_id || '-' || (turn - 2) END AS after,
         CASE WHEN LENGTH(text) >= 80 THEN 'search' ELSE 'note' END AS tool
  FROM conversations WHERE role = 'user'),
chained AS (
  SELECT *, turn - 2 * ROW_NUMBER() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM asked),
levelled AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) AS INTEGER) AS level FROM chained),
answers AS (
  SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'assistant'),
joined AS (
  SELECT COALESCE(l.conv_id, a.conv_id) AS conv_id, COALESCE(l.call_id, a.call_id) AS call_id, l.level, l.tool, a.result,
         a.call_id IS NOT NULL AS answered, l.turn, l.text, l.after,
         CASE WHEN l.tool IS NULL THEN NULL
              WHEN after IS NULL THEN json_object('text', text, 'turn', turn)
              ELSE json_object('after', after, 'text', text, 'turn', turn) END AS arguments,
         CASE WHEN l.tool IS NULL THEN ['no call'] WHEN l.tool = 'search' THEN []
              WHEN after IS NULL THEN ['missing topic', 'unknown turn']
              ELSE ['missing topic', 'unknown after', 'unknown turn'] END AS errors
  FROM levelled l FULL JOIN answers a ON l.conv_id = a.conv_id AND l.call_id = a.call_id)
SELECT conv_id, call_id, level, tool, CAST(arguments AS VARCHAR) AS arguments,
       array_to_string(errors, ',') AS errors, answered, result,
       CAST(json_object('arguments', arguments, 'errors', to_json(errors), 'id', call_id, 'name', tool, 'result', result)
            AS VARCHAR) AS linked
FROM joined""")
def tool_call_links(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as tool calls that use the result of the call two turns before, assistant
    turns as results; positions are scrambled, so the order has to be found again."""
    turns = _table(spark, folder, "conversations")
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    earlier = F.when(F.col("turn") >= 2, name(2))
    asked = turns.where("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), F.crc32(name(0)).alias("position"),
        F.when(F.length("text") >= 80, "search").otherwise("note").alias("tool"),
        F.to_json(F.struct("turn", "text", earlier.alias("after"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(earlier)).alias("after"))
    answers = turns.where("role = 'assistant'").select(
        "conv_id", name(1).alias("call_id"), "turn", F.col("text").alias("content")).withColumnRenamed("turn", "position")
    schemas = spark.createDataFrame(_SCHEMAS, "tool string, field string, type string, required boolean")
    out = tool_links.link_calls(asked, answers, schemas)
    return out.select("conv_id", "call_id", "level", "tool", "arguments", F.array_join("errors", ",").alias("errors"),
                      "answered", "result", "linked")


@_query("op2_pack_sequences")
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut_pieces(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    packed = packing.pack(pieces, packing.Limits(tokens=4096, segments=256, loss_tokens=4096))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query("op3_rank_stream")
def ranked_id_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "id-file")
    rank_stream.write_ids(_table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), 49_408, end_id=1)
    return rank_stream.read_ids(spark, path)


@_query("op4_token_counts")
def token_counts_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


#: Seed and flattening of the source mix.
MIX_SEED, MIX_FLATTEN = 11, 0.5


@_query("op5_poisson_mix", f"""
WITH RECURSIVE sizes AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, POW(n, {MIX_FLATTEN}) / (SELECT SUM(POW(n, {MIX_FLATTEN})) FROM sizes)
         * (SELECT CAST(SUM(n) AS DOUBLE) FROM sizes) / n AS mean FROM sizes),
steps AS (
  SELECT source, mean, 0 AS k, EXP(-mean) AS p, EXP(-mean) AS cdf FROM rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM steps
  WHERE k < CEIL(mean + 9 * SQRT(mean) + 40)),
drawn AS (
  SELECT d.*, (CAST('0x' || SUBSTR(MD5('{MIX_SEED}|' || doc_id || '|0|copies'), 1, 13) AS BIGINT) + 0.5)
         / 4503599627370496.0 AS u FROM documents d),
counted AS (
  SELECT d.doc_id, (SELECT COUNT(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n
  FROM drawn d)
SELECT d.*, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || SUBSTR(MD5('{MIX_SEED}|' || d.doc_id || '|' || copy || '|order'), 1, 13) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, UNNEST(RANGE(n)) AS copy FROM counted) c JOIN documents d USING (doc_id)""")
def poisson_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return poisson_mix.mix(_table(spark, folder, "documents"), flatten=MIX_FLATTEN, seed=MIX_SEED)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


@_query("op6_language_filters")
def language_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    model = language_filters.fit(docs, use=learn)
    named = language_filters.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@_query("op7_multiset_hash")
def multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    out = multiset_hash.fingerprints(_table(spark, folder, "documents"))
    return out.drop("exact", "wide")


@_query("op8_shingle_join", """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM worded),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
flat AS (SELECT doc_id, UNNEST(s) AS g FROM shingled),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS r FROM sizes
  UNION
  SELECT reached.doc_id, y FROM reached JOIN both_ways ON x = r)
SELECT doc_id, n AS n_shingles, MIN(r) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n""")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.jaccard_components(_table(spark, folder, "documents"))


@_query("op9_secret_links")
def secrets_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_links.scan_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_links.listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        secret_links.listed("spans").alias("spans"))


@_query("op10_prefix_forest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_forest.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@_query("op11_turn_align")
def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return turn_align.repair(turn_align.damaged(_table(spark, folder, "conversations")))


@_query("op12_triangle_negatives", """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(FLOOR(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5""")
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = triangle_negatives.whole_parts(_table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return triangle_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@_query("op13_bpe_tree")
def bpe_digests(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_tree.encode_documents(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
