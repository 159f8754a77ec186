"""A training-data pipeline of five operators over `documents`; each stage works on what the one before kept.

Null texts and texts without a letter go in the first stage; rows with null ids go through like others. A score just at a
bound keeps its document, coverage just at the limit drops it. Of a class of near copies the least id stays, of rows with
one id the one with the least hash; the mix draws by hashes, so ties don't depend on the run. Empty tables give no rows,
and further columns of any name come through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseplane.llm import decontaminate, language_id, mixing, quality, simhash
from proseplane.llm.common import id_bucket, packed_rows, shared_dir, table
from proseplane.shipping import shipped

#: A document goes if its best language is less likely than this.
LEAST_LANGUAGE = 0.4
#: A document goes if it is less likely than this to be of quality.
LEAST_QUALITY = 0.5


@shipped
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the model knows well, go."""
    model = language_id.fit(docs.where(id_bucket("doc_id", 3) != 1))
    found = language_id.identify(packed_rows(docs, F.col("text")), model)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("_row.*")


@shipped
def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of low quality go."""
    labels = table(spark, sf_dir, "labels").where(id_bucket("doc_id", 3) != 1)
    model = quality.fit(docs.where(id_bucket("doc_id", 3) != 1), labels)
    return quality.score(packed_rows(docs, F.col("text")), model).where(F.col("score") >= LEAST_QUALITY).select("_row.*")


@shipped
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays."""
    return simhash.one_of_each(docs)


@shipped
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the passages of items are cut out."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


@shipped
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, numbered by `copy`."""
    return mixing.mix(docs)


STAGES = [("language", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", remove_benchmark), ("mixing", mix_sources)]

#: The stages fit classifiers and draw by hashes that SQL does not have; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written to the shared folder and read again.

    What a stage wrote goes once the next one has written its own; the last rows stay, for the result reads them.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return docs
