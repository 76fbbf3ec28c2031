"""The corpus pipeline: toxicity, near-dedup, substring dedup, mixing, encoding. Each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.llm import bpe, minhash, mixing, substrings, toxicity
from brightloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.

    Null, empty and unknown texts have the score of no terms and stay; rows that repeat are judged alike; with no labels
    nothing is rejected; an empty table gives an empty one.
    """
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity(docs, machine).where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id.

    Null and blank texts are near nothing and stay, each row of them; of rows that repeat an id and its text one stays; rows
    with a null id stay. An empty table gives an empty one.
    """
    seen = minhash.near_duplicates(docs, carry_text=True)
    return seen.where("single").select(*COLUMNS)


def drop_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has go; documents left without words go as well.

    A document that had no words, null texts included, stays as it was, and so does one with a null id; rows of one id take
    nothing from each other. n_chars counts the new text, null of a null one. An empty table gives an empty one.
    """
    out = substrings.substring_dedup(docs)
    out = out.where("n_words = 0 or n_removed < n_words")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order.

    Documents without words are taken as often as their source's whole passes; a null source is a source of its own; equal
    rows are taken equally often; equal positions are ordered by source, id and text. An empty table gives an empty one.
    """
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, the decoded text's digest, and the documents' other columns.

    Null and blank texts have no tokens and the digest of the empty text; each row is encoded for itself.
    """
    import public_tokenizers

    out = bpe.bpe(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


