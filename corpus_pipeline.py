"""A corpus-cleaning pipeline: each stage works on all that the one before it kept.

``run`` applies the stages to ``documents``.  Between stages the rows are
written as Parquet in the shared checkpoint folder and read again, so a lost
executor costs no earlier stage.  All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlog.llm import decontaminate, language_crf, line_dedup, piece_codec, simhash
from sessionlog.llm.queries import PIECES
from sessionlog.llm.shared import documents, id_remainder
from sessionlog.operators.sequence import join_on
from sessionlog.spark import materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: A document is in a language if the CRF gives that language at least this share of its words.  Over the 10,000
#: documents of sf0.1 the smallest share is 0.398 (a short text of secrets and numbers); chance is 0.25.
LEAST_SHARE = 0.35
#: Benchmark items of fewer words ("yes", a name) stand in any text and make no document a leak.
LEAST_ITEM_WORDS = 5
#: What a task of the last stage keeps of encoded words.  Its workers go on to the language stage of the next run.
CACHE_BYTES = 48 << 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language; a missing lang is filled in.

    In no language are texts that are null or have no letter, and those in which no
    language has ``LEAST_SHARE`` of the words.  The model learns from four fifths of
    the labelled documents, as op10 does.  If no row has a label, nothing is known
    about languages and all texts with a letter stay.
    """
    ship_package(spark)
    crf = language_crf.fit(docs, id_remainder("doc_id", 5) != 0)
    found = language_crf.predict(docs.select(*COLUMNS), crf)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)) if crf.labels else found.filter(F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document of a smaller doc_id has; all documents stay."""
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS), min_chars=10)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate component: the smallest doc_id's (null ids last; of its texts the least hash).

    Rows are told apart by id and text, so a repeated id loses no text of another
    component.  Documents that line dedup has left empty are one component.
    """
    classes = materialize(simhash.near_duplicates(docs, shingle=3, max_bits=3), "pipeline-classes")
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    # How often the kept row itself occurs: of equal rows one stays.
    times = classes.groupBy("doc_id", "text_hash").count()
    keep = join_on(first.select(F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash")), times, ["doc_id", "text_hash"])
    keep = materialize(keep, "pipeline-keep")
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    once = join_on(keyed, keep.filter("count = 1").drop("count"), ["doc_id", "text_hash"])
    often = join_on(keyed, keep.filter("count > 1").drop("count"), ["doc_id", "text_hash"])
    least = often.groupBy("doc_id", "text_hash").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.select(*COLUMNS).unionByName(least)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item of ``LEAST_ITEM_WORDS`` words or more, at a word similarity of 0.8 or more."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) >= LEAST_ITEM_WORDS)
    hits = decontaminate.contaminated(docs, items, similarity=0.8).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]), "left_anti").select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with begin and end, of every document, their digest and that of the text they decode to."""
    both = piece_codec.round_trip(docs, public_tokenizers.path(PIECES), cache_bytes=CACHE_BYTES)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language models, fingerprints and tokenizers are beyond SQL; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
