"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, personal
data is masked, and what is left is packed into sequences.

Each stage takes the documents its predecessor kept and returns the columns of ``documents`` (n_chars follows
the text); the last returns one row per packed piece.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersight.llm import bag_minhash, line_dedup, packing, pii, toxicity
from ledgersight.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7, as they are."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs.select(*COLUMNS), fitted)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id has."""
    return _documents(line_dedup.drop_repeated_lines(docs, carry=("lang", "source")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, as it is."""
    return bag_minhash.drop_near_copies(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = pii.find(docs, carry=("lang", "source"))
    return _documents(found.withColumn("text", pii.redact(F.col("text"), F.col("spans"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_copies),
          ("personal data", mask_personal_data), ("packing", pack)]

# scores, signatures and token ids have no SQL; run() is tested against plain stages, toxicity on planted documents
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
