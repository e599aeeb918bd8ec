"""The training-data pipeline over `documents`: five filtering and rewriting stages, each an operator of tesserae.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`documents`; n_chars is that of the text as it stands. Stages handle empty tables, null texts and repeated rows as their
operators define; columns beside those of `documents`, whatever their names, are left out by the first stage that meets them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import common, decontaminate, near_copies, pieces, quality, secrets
from tesserae.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score at least the classifier's threshold; it learns from all labels of documents at hand."""
    model = quality.fit(*quality.sample(docs, table(spark, sf_dir, "labels")))
    return quality.scored(docs, model, into="_score").filter(F.col("_score") >= quality.CUT).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id."""
    return near_copies.deduplicated(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what occurs in the benchmark; documents that are mostly benchmark go."""
    return _measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; no document goes."""
    return _measured(secrets.mask(docs))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, as ids, with their scores.

    The earlier stages have left an executor's heap at its full size, so workers keep smaller tables here than by themselves.
    """
    import public_tokenizers

    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2, most_states=250_000, batch_chars=1 << 17)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The stages' models and hashes aren't expressible in SQL; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    where = common.shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.cut(stage(spark, docs, sf_dir), where, f"stage-{k}")
    return docs
