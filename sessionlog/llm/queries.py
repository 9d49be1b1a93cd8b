"""The operators as registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.llm import collocations, decontaminate, language_crf, line_dedup, nn_descent, piece_codec, quality_gam, sharding, simhash, suffix_tree_lm, token_counts, token_files, turn_repair
from sessionlog.llm.shared import documents, id_remainder

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of all documents from their prefix tables; ``cut_4096``: characters that fit 4096 tokens."""
    found = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES), budgets=(4096,))
    return token_counts.over_limit(found, 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("fits")[F.lit(4096).cast("long")].alias("cut_4096"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near-equal bytes, equal texts together."""
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' 3-word SimHash fingerprints, and components of those within 3 bits."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document of a smaller doc_id already has, as digests."""
    kept = line_dedup.drop_repeated_lines(documents(spark, sf_dir), min_chars=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in flat files, read back from them."""
    folder, manifest = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path(WORDS), end_id=2)
    return token_files.read_token_files(folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds, at a word similarity of 0.8 or more."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), similarity=0.8)


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a suffix tree learnt from nine tenths of them, beside the unigram base."""
    return suffix_tree_lm.score(documents(spark, sf_dir), id_remainder("doc_id", 10) == 0)


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows found for each row whose id is divisible by 50, among all rows."""
    return nn_descent.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with begin and end ids and decoded again, as digests."""
    both = piece_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path(PIECES))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a CRF fitted on a sample of four fifths of them."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 5) == 0
    crf = language_crf.fit(docs, ~held_out)
    return language_crf.predict(docs.select("doc_id", "text"), crf).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage, with its least audit."""
    return turn_repair.repair(turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by an additive model fitted on a sample of four fifths of the labels."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_remainder("doc_id", 5) == 0
    gam = quality_gam.fit(docs, labels, ~held_out)
    return quality_gam.predict(docs, gam).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of 2 to 5 words by how much their words attract one another."""
    found = collocations.collocations(documents(spark, sf_dir), least=100, longest=5, top=2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_nn_descent": op8_nn_descent,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language_crf": op10_language_crf,
    "op11_turn_repair": op11_turn_repair,
    "op12_quality_gam": op12_quality_gam,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL for the same rows.
ORACLE: dict[str, str] = {}

ORACLE["op4_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(l, i) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
held AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT keyed.*, held.k IS NOT NULL AND keyed.doc_id <> held.first_doc AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLE["op13_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spans AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS p
  FROM worded, (SELECT unnest(range(1, 6)) AS k)),
counted AS (
  SELECT lang, k AS size, p, count(*)::HUGEINT AS f FROM spans GROUP BY lang, k, p),
total AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM counted WHERE size = 1 GROUP BY lang),
often AS (
  SELECT * FROM counted WHERE f >= 100),
candidates AS (
  SELECT lang, size, p, string_split(p, ' ') AS w, f AS a FROM often WHERE size > 1),
cut AS (
  SELECT lang, p, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cuts AS (
  SELECT cut.lang, cut.p, a, k, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score
  FROM cut JOIN often l ON l.lang = cut.lang AND l.p = cut.head JOIN often r ON r.lang = cut.lang AND r.p = cut.rest
  JOIN total ON total.lang = cut.lang),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
spanned AS (
  SELECT lang, a, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, size - k + 2)]) AS p
  FROM (SELECT *, unnest(range(2, size)) AS k FROM candidates)),
held AS (
  SELECT lang, p, max(a) AS longer FROM spanned GROUP BY lang, p),
ranked AS (
  SELECT w.lang, w.p AS phrase, w.a, w.l, w.r, w.n, w.score,
    row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, encode(w.p)) AS rank
  FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.p = w.p WHERE h.longer IS NULL OR 100 * h.longer < 100 * w.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000"""
