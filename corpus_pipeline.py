"""From raw documents to tokens: five corpus operators one after another.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.bpe import encode_documents
from kinweave.llm.common import cut, free_name, place_of, placed, renamed, table
from kinweave.llm.lines import dedup_lines, dedup_passages
from kinweave.llm.mixing import mix
from kinweave.llm.simhash import drop_near_duplicates
from kinweave.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from `labels` that are not held out.

    Null and empty texts stay, equal texts stay or go alike, and an empty table
    gives no rows. Columns of any name and type pass.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    names = (free_name(docs, "toxicity"), free_name(docs, "is_toxic"))
    return score(docs, model, names).where(F.col(names[1]) == 0).drop(*names)


def _counted(docs: DataFrame, out: DataFrame, names: list[str]) -> DataFrame:
    """The columns of docs from out, with n_chars brought up to date where the last of the added names says so."""
    rows, changed = placed(out, ()), F.col(f"c{len(docs.columns) + len(names) - 1}") > 0
    if "n_chars" in docs.columns:
        at = place_of(docs, "n_chars")
        new = F.length(place_of(docs, "text")).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn(at, F.when(changed, new).otherwise(F.col(at)))
    return renamed(rows, docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks go; documents stay. The stage is passage_dedup, which removes all of these and more."""
    names = [free_name(docs, c) for c in ("n_lines", "n_removed", "n_chunks")]
    return _counted(docs, dedup_lines(docs, names=tuple(names)), names)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of two or more lines go; documents stay, those left without text too.

    Null texts stay null; of tied passages the first by doc_id (null first),
    then text, then place stays; rows that repeat id and text change alike. An
    empty table gives no rows. Columns of any name and type pass.
    """
    names = [free_name(docs, c) for c in ("n_lines", "n_removed", "n_passages")]
    return _counted(docs, dedup_passages(docs, names=tuple(names)), names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: of smallest doc_id (null first), then text.

    Null and empty texts are one class. An empty table gives no rows. Columns
    of any name and type pass.
    """
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; equal rows are taken alike.

    Sources go by code point, null last; a null text weighs nothing. An empty
    table gives no rows. Columns of any name and type pass.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and the text decoded from them; null counts as empty, an empty table gives no rows."""
    return encode_documents(docs.select("doc_id", "source", "lang", "text"), decoded=True).drop("text")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", passage_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Trained scores, XXH64 fingerprints and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
