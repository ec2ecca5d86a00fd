"""The corpus pipeline: five stages, each an operator of ``loomspan.llm``, over the table ``documents``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame with the columns of ``documents``; only the
last returns the encoded documents. ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bpe_codec import encode_and_verify
from loomspan.llm.common import first_of_group, table
from loomspan.llm.near_copies import keep_one_near_copy
from loomspan.llm.sentence_spans import remove_repeated_spans
from loomspan.llm.simhash_trie import simhash_groups
from loomspan.llm.source_mixing import mixed_documents
from loomspan.llm.toxicity import fit_toxicity, without_toxic
from loomspan.storage import materialize, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go.

    Null and empty texts stay (nothing marks them), as do nulls in any other column; rows repeated whole go or stay together; very
    long texts are read whole; an empty table gives an empty one; columns named like the model's results pass through as they are.
    """
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one of smallest id; of those left, one of each group of near copies
    (0.8 or more of their words in common five-word shingles). The texts move once, when both are decided.

    Null and blank texts are copies of each other; null ids come last; of rows that share id and text one stays; very long
    texts are compared whole; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    return keep_one_near_copy(docs, among=materialize(first_of_group(simhash_groups(docs))))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that a repeated span covers go, but for the span's first occurrence; ``n_chars`` follows.

    Null and empty texts stay as they are; of equal spans the one of smallest id stays, nulls last; rows that share id and text
    stay equal; very long texts are cut whole; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    return remove_repeated_spans(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights; texts repeat where a source's target exceeds its size.

    Null and empty texts have no words and are never taken; a null source is one of its own; ties of the random key go by id and text;
    rows repeated whole have places of their own; very long texts may be cut at the budget's end; an empty table gives an
    empty one; other columns pass through, whatever their names.
    """
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of the mix.

    A null text encodes like an empty one, to no ids; repeated rows are encoded each; texts of any length are encoded whole; a null id
    stays null; an empty table gives an empty one; other columns do not matter.
    """
    return encode_and_verify(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The learned, the fingerprint and the tokenizer stages have no SQL; ``tests/llm`` compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage writes for itself goes with it
            docs = materialize(stage(spark, docs, sf_dir), stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
