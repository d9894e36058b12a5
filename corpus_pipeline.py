"""From documents to packed training sequences, in five stages.

Each stage gets what the one before kept, stored as Parquet, and calls one
operator.  ``STAGES`` names them in order; ``run`` applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, neardup, packing, suffixes
from tessella.llm.common import WORD, Scratch, table
from tessella.llm.queries import WORD_VOCABULARY, vocabulary


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all others in one struct, so that what a stage makes cannot replace a column of theirs."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(None).cast("int").alias("_"), *others).alias("_carried"))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows of a stage with the columns of docs."""
    return rows.select(*[F.col(c) if c in rows.columns and c not in rows.schema["_carried"].dataType.fieldNames() else F.col("_carried")[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: no text (null or empty), no letter, or no language likely enough.

    Whole texts count, however long; repeated rows are judged alike; all columns stay as they are, whatever their names.
    """
    return _restored(langid.predict(spark, _carried(docs, "text"), langid.train(docs.select("text", "lang"))).where("NOT rejected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest doc_id, a null one last; repeated rows are copies.

    Documents without words are no copies of each other and stay; all columns stay as they are.
    """
    return neardup.keep_one(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 200 bytes or more that occurs again; documents of which nothing is left go.

    Null and empty texts stay, as empty ones; a text of any length is read whole; repeated rows lose what they share.  Columns but
    text and n_chars stay as they are.
    """
    done = suffixes.remove_repeats(spark, _carried(docs, "text", "n_chars"))
    done = done.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return _restored(done.where("n_removed < n_bytes OR n_bytes = 0"), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; one that is taken in part is cut after so many words (with single blanks).

    A null source is the last one; documents without words (null and empty texts) are not taken; repeated rows count each.  Columns
    but text and n_chars stay as they are.
    """
    mixed = mixing.mix(_carried(docs, "doc_id", "source", "text", "n_chars"), mixing.word_count(F.col("text"))).where("taken > 0")
    turns = mixed.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_turn") - 1) * F.col("size"))
    blank = WORD.replace("^", "")
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", f"^{blank}", ""), blank), F.lit(1), words.cast("int")), " ")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("text"))
    return _restored(turns.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens; a null text is the piece of its final 0."""
    return packing.pack(spark, docs, vocabulary(WORD_VOCABULARY), ["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: Language identification, MinHash and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every stage but the last is a stored table for the next.

    An empty table gives no rows.  Columns of documents beyond doc_id, text,
    lang, source and n_chars stay up to the last stage, whatever their names
    (but for _carried).
    """
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch.passing():  # the stage's own tables go once its result is stored
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # the one that it read
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
