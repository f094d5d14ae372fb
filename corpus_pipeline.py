"""From raw documents to token files: five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that the one before kept. All but the last return the columns of documents, of which
there may be more than those of the driver's table, of any name and type. Null texts have no letter and go in the
first stage; null ids stay and are like no other document; rows that repeat an id and text are one document from the
second stage on; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork import session
from braidwork.llm import common, decontaminate, langid, minhash, mixing, tokens

#: Near-duplicates: words of a shingle, and the similarity from which documents are linked, in percent.
SHINGLE, PERCENT = 5, 80
#: Of a document, the share of words in test passages beyond which it goes; passages in the others are cut out.
MAX_TEST_SHARE = 0.5
#: Expected share of the tokens that the mix keeps.
MIX_SHARE = 0.75
#: Words that a token worker remembers: workers outlive the stage, and the other stages need memory too.
REMEMBERED = 100_000

_last_stage: list[str] = []


def _stage(work):
    """Deletes the scratch tables of the stage before: its result is written by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last_stage:
            session.delete(spark, _last_stage.pop())
        before = len(session._scratch)
        out = work(spark, docs, sf_dir)
        _last_stage.extend(session._scratch[before:])
        del session._scratch[before:]
        return out

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return run_stage


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts that are null, empty or without a letter are rejected. A null lang becomes the predicted one. Where no row has a lang to learn from, the texts with a letter stay."""
    model = langid.train(docs)
    if not model.names:
        return docs.filter(langid.with_letter(F.col("text")))
    found = langid.predicted(docs, model).filter(F.col("lang_pred") != langid.UNDETERMINED)
    lang = F.coalesce(F.col(common.REST).getField("lang"), F.col("lang_pred"))
    return common.unpacked(found, docs.columns, {"doc_id": F.col("doc_id"), "text": F.col("text"), "lang": lang})


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id; texts without words are no copies. See minhash.dedup for ids that are null or repeat."""
    return minhash.dedup(docs, SHINGLE, PERCENT)


@_stage
def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark; those that are mostly such passages go. n_chars follows the text; an empty benchmark changes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_share=MAX_TEST_SHARE)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the target shares of sources, languages and topics; a null source or language is a value of its own."""
    return mixing.sample(docs, MIX_SHARE)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row per document with its place, number and check sum of ids. Null ids come first; an empty text is the end id alone."""
    return tokens.round_trip(docs, remembered=REMEMBERED).drop("ids")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_tests),
    ("mixing sources to target weights", mix),
    ("token-ID output", encode),
]

#: SQL can't express the trained language model, the raking or the tokenizer: tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for i, (_, work) in enumerate(STAGES):
        out = work(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            session._scratch.extend([written] if written else [])
            return out
        path = f"{session.shared_dir(spark)}/stage{i}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        if written:
            session.delete(spark, written)
        docs, written = spark.read.parquet(path), path
    return docs
