"""A corpus pipeline of five of the operators in ``fathomline.llm``: documents in, token ids of a mix out.

Every stage takes ``(spark, docs, sf_dir)``; ``run`` saves what each stage but the last returns, once, where checkpoints go; a
caller that writes each stage as Parquet and reads it back gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.bpe import encoded
from fathomline.llm.exact_dedup import exact_groups, normalised
from fathomline.llm.language_id import learned, predicted
from fathomline.llm.mixing import mixed
from fathomline.llm.simhash import near_components
from fathomline.session import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, or without a language of half the posterior, go.

    The model learns from a sample of the same documents that it judges.
    """
    found = predicted(docs, learned(docs), keep=tuple(F.col(c) for c in COLUMNS))
    return found.where("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id; groups without ids stay as they are."""
    gone = exact_groups(docs).where("keep_id is not null and not kept").select("id", "text_sha256").distinct()
    marked = docs.select(*COLUMNS).withColumn("text_sha256", F.sha2(normalised(F.col("text")).cast("binary"), 256))
    same = marked.doc_id.eqNullSafe(gone.id) & (marked.text_sha256 == gone.text_sha256)
    return marked.join(gone, same, "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose SimHash links join them, one: that with the smallest id, then the smallest digest of the row; rows without ids come last.

    A digest names a row and all that equal it; it is taken of JSON, which leaves null fields out.  Few digests go or are repeated, so only those are looked up.
    """
    said = F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text"), "lang", "source", "n_chars")
    marked = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.sha2(F.to_json(said).cast("binary"), 256)))
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")
    found = near_components(marked.select(name.alias("doc_id"), "text")).select("id.digest", (F.col("id") == F.col("component_id")).alias("kept"))
    known = saved(found.groupBy("digest", "kept").agg(F.count("*").alias("n")).where("not kept or n > 1"))
    rest = marked.join(known, "digest", "left_anti")
    repeated = known.where("kept").select("digest")
    if not repeated.isEmpty():
        rest = rest.unionByName(marked.join(repeated, "digest", "left_semi").dropDuplicates(["digest"]))
    return rest.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document appears as often as the mix draws it, dealt to shards and shuffled."""
    return mixed(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)``: ids as little-endian unsigned 32-bit integers."""
    found = encoded(docs, decode=True)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", tokenise),
]
#: SQL has neither the language model, the fingerprints nor the merges; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
