"""A corpus pipeline: each stage calls one operator and feeds the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import mixing, packing, secrets, simhash, toxicity
from quirefold.llm.queries import read, tokenizer_path
from quirefold.plans.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity operator's limit; the model learns from the given labels.

    Null and empty texts have the lowest score and stay; equal texts go or stay together; a
    score on the limit goes; without documents or usable labels nothing goes unless toxic
    labels are that common.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", toxicity.score(F.col("text"), model))
    return scored.where(F.col("__score") < toxicity.REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts whose five-word shingles
    are alike by 0.8 or more, found by long SimHash signatures.

    Texts without words, null ones too, are one group; of repeated rows one stays, rows with
    a null id stay; an empty table gives none.
    """
    return simhash.keep_one_similar(docs, words=5, similarity=0.8, seed=42)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with found secrets replaced; ``n_chars`` follows.

    No row goes; null texts stay null (and so does their ``n_chars``), equal rows are changed
    alike, spans that overlap are one, an empty table stays empty.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all to twice.

    A null source is a source; null and empty texts have no words and are left out where their
    source is sampled; equal rows are taken alike, ties go by a hash; an empty table stays empty.
    """
    return mixing.repeat(mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 ids.

    Null texts count as empty and give the end id alone; repeated rows and null ids are
    documents like any other; an empty table gives no pieces.
    """
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), length=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{i}")
    return docs
