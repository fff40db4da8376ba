"""A training corpus from raw documents, in five stages that each take over what the one before kept.

The quality classifier drops the documents that it rejects, one document of each near-duplicate class stays, documents
with benchmark passages go, personal data is replaced by its kind in brackets, and what is left is packed into
sequences. All stages but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmill.llm import decontaminate, minhash_dedup, packing, pii, quality_classifier
from helixmill.llm.common import drop_kept, keep, n_kept, table


def aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with all columns but doc_id and text under names that no operator uses, and the expressions that bring them back."""
    names = {c: c if c in ("doc_id", "text") else f"own__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labelled rows, scores at the threshold or above."""
    own, back = aside(docs)
    return quality_classifier.classify(own, table(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = aside(docs)
    return decontaminate.remove_contaminated(own, table(spark, sf_dir, "benchmark")).select(*back)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data; n_chars follows where a text changed."""
    own, back = aside(docs)
    masked = pii.redact_pii(own)
    n_chars = F.when(F.size("pii") > 0, F.length("text").cast("long"))
    return masked.select(*[F.coalesce(n_chars, c).alias("n_chars") if name == "n_chars" else c for name, c in zip(docs.columns, back)])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_report(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_pii),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the classes and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what is needed no more is deleted then."""
    docs, first = table(spark, sf_dir, "documents"), n_kept()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
            drop_kept(spark, first, 1)  # its input, and what the stage has written for itself
    return docs
