"""The corpus pipeline: toxicity, near-duplicates, mixing to target weights, packing.

All stages but the last return the columns of their input, whatever their
names, further columns included. A null or empty text is not toxic, a copy of
nothing but of other such rows without an id or with the same one, has no
words to mix and is packed as its end token. A null source, language or id is
a value of its own. Rows that repeat an id are one document to the second
stage. Ties: the smallest id stays; equal scores are settled by id. Long texts
are taken whole by every stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestrata.llm.common import materialise, release, working_tables
from lodestrata.llm.mixing import Mix, mixed_documents
from lodestrata.llm.packing import pack
from lodestrata.llm.probminhash import without_near_duplicates
from lodestrata.llm.toxicity import without_toxic

#: One epoch at most: the mixing stage gives no document twice.
MIX = Mix(per_mille=700, max_epochs=1)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, labels)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id. Rows of one id are one class."""
    return without_near_duplicates(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token prefix of each domain-language-source leaf, at target weights."""
    return mixed_documents(docs, MIX)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 1,024 tokens, each window at the sources' shares."""
    return pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("packing", pack_sequences)]

#: The nearest-example vote, the signatures and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; its working tables go then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with working_tables(spark, but=1):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
