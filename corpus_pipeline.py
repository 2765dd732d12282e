"""The training-corpus pipeline: stages that each read, as Parquet, the documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mixed
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.queries import tokenizer
from tessera.llm.shared import drop_written, unused, written
from tessera.llm.substrings import substring_dedup
from tessera.llm.toxicity import fitted, sample, scored
from tessera.session import TIGHT, ship, table

#: Pieces that a worker's memo holds in each of two generations: it outlives the stage, and other stages run beside it.
MEMO = 150_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, rejects go.

    Null and empty texts score 0 and stay, as do null ids; rows that repeat are judged alike. Without labels nothing goes. Columns of
    docs stay as they are, whatever their names; an empty table stays empty.
    """
    ship(spark, TIGHT)
    model = fitted(sample(docs, table(spark, sf_dir, "labels")))
    names = tuple(unused(x, docs.columns) for x in ("held_out", "score", "predicted"))
    return scored(docs, model, names=names).where(F.col(names[2]) == 0).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words a shingle, similarity 0.8) stays: that of the least id.

    Texts without words are like nothing and stay; rows with a null id stay. Rows that repeat id and text are one document. Of
    different texts under the least id of one group the one of the least hash stays. Other columns take no part.
    """
    ship(spark, TIGHT)
    kept = near_duplicates(spark, docs, with_key=True).where("kept and doc_id is not null")
    kept = kept.groupBy("doc_id", "group").agg(F.min("text_key").alias("text_key"))
    same = (docs["doc_id"].cast("long") == kept["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["text_key"])
    stay = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where("doc_id is null")).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in a window of 20 that also starts earlier go; a text that loses none stays as it is, null and empty ones too.

    Every row stays, be its text empty in the end. n_chars, if docs has it, is that of the text that stays; other columns stay as they
    are, whatever their names. Null ids and repeated rows as in substring_dedup().
    """
    ship(spark, TIGHT)
    rest = [c for c in docs.columns if c != "text"]
    cut = substring_dedup(docs.select("doc_id", "text", F.struct(*[docs[c] for c in rest]).alias("rest")))
    lost, made = F.col("n_removed") > 0, {c: F.col("rest").getField(c) for c in rest}
    made["text"] = F.when(lost, F.col("kept")).otherwise(F.col("text"))
    if "n_chars" in rest:
        made["n_chars"] = F.when(lost, F.length("kept")).otherwise(made["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[made[c].alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document can be taken twice, or not at all.

    Null texts have no words, null sources are one source, null ids and repeated rows are rows like others; other columns stay.
    """
    return mixed(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. Null texts have the end id alone; other columns go, repeated rows and null ids
    are packed like others; an empty table gives no piece."""
    ship(spark, TIGHT)
    return pack_documents(spark, docs, tokenizer("word_bpe_49k.json"), 1, memo=MEMO)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: The first and last stages can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Jobs of all stages run while it is made; a stage's table is deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_written(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
