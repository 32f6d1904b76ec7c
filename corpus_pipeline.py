"""Corpus pipeline: quality, near-duplicates, privacy, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of ``documents``.  ``run`` writes every stage as Parquet in the shared
folder and reads it again as the next one's input.

Defined cases, in every stage: an empty table gives an empty one; repeated rows are judged each
(but equal texts are near duplicates, of which one stays); a null text is an empty one; columns
beyond those of ``documents`` come out as they went in, whatever their names.  By stage: an empty
text has the quality of the prior; the least doc_id of a group stays, a null one last; a null text
stays null where personal data is replaced; a null source or language is a category of its own; a
null doc_id is packed like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import mixture, packing, quality, simhash, storage, surrogates


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose further columns have neutral names meanwhile, so that none clashes."""
    more = {c: f"__column{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    put = lambda c: f"`{c.replace('`', '``')}`"
    out = work(docs.select(*[F.col(put(c)).alias(more.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(more.get(c, c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _aside(docs, lambda d: quality.score(d, quality.fit(d, labels)).where("predicted = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return _aside(docs, simhash.deduplicated)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the new text."""

    def work(d: DataFrame) -> DataFrame:
        out = surrogates.checked(d, surrogates.session_key(spark))
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(d.schema["n_chars"].dataType)))
        return out

    return _aside(docs, work)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mixture of sources, languages and topics."""
    return _aside(docs, lambda d: mixture.mix(d).where("kept"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packed pieces of all documents that are left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("PII", replace_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models and tokenizers are no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = storage.staged(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
