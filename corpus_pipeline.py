"""The corpus pipeline: documents without toxic, near-duplicate or contaminated ones, without secrets, packed.

Every stage is one operator of ``crateforge.llm`` over all that the stage before kept; between stages the documents are
written as Parquet into the shared folder and read again.

Defined results, of every stage but the last: the rows that stay have all columns of ``docs``, whatever they are called, and
all values but those a stage changes (text and n_chars, where secrets were); an empty table gives an empty one; very long
texts are read whole; decisions depend on a row's text alone, so rows that repeat are decided alike. A null text counts as
empty and a null doc_id is an id like any other, but in near-duplicate groups it stays only if there is no other. The last
stage has a row for each piece of each document; its own docstring says what pieces are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crateforge.llm import decontaminate, packing, secrets, similar, toxicity
from crateforge.llm.common import discard, read, stage, tidy

#: SQL cannot express the stages' models and tokenizer; tests hold operators against plain versions, and the stages against rules (columns, counts, no secret left).
ORACLE_SQL = None
SECRET_MARK = "[secret]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go. An empty or null text gets the score of a text without hits."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8 or more stays, that of the smallest doc_id.

    Candidates are the links of the SimHash operator, and texts that share positional bytes; shingle sets decide.
    Texts without words, null ones too, are copies of each other; of rows repeated whole one stays.
    """
    return similar.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; a text without words holds none, and an empty benchmark has none."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret of a text becomes a mark; n_chars follows. All documents stay, null texts as null."""
    return secrets.redacted(docs, SECRET_MARK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in as few sequences as the packer finds; a null or empty text is one piece, the end token."""
    from crateforge.llm.queries import tokenizer_path

    return packing.pack(packing.pieces(docs, tokenizer_path())).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; of the documents between the stages only what is still to be read lies in the shared folder."""
    docs, path = read(spark, sf_dir, "documents"), None
    for _, step in STAGES[:-1]:
        docs, done = stage(step(spark, docs, sf_dir))
        if path:
            discard(spark, path)
        path = done
    return STAGES[-1][1](spark, docs, sf_dir)
