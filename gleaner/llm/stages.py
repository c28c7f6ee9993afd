"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and, but for the last, returns the columns it was given.
Rows are matched back by doc_id and text, so a repeated or null doc_id does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.session import Steps


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matched(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the columns that found has for (doc_id, text_hash), as a struct named found."""
    found = found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"),
                         F.struct(*found.columns).alias("found"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("found_id")) & (
        F.xxhash64("row.text") == F.col("found_hash")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates on five-word shingles at 0.8: the smallest doc_id of each group stays.

    Rows that repeat its id and text count once; texts without words all stay.
    """
    from gleaner.llm.near_dedup import near_duplicates

    chosen = near_duplicates(docs, shingle_words=5, percent=80).filter("chosen").select(
        "doc_id", "text_hash", (F.col("n_shingles") == 0).alias("empty"))
    order = Window.partitionBy("found_id", "found_hash").orderBy("found_id")
    rows = matched(docs, chosen.distinct()).withColumn("nth", F.row_number().over(order))
    return rows.filter("nth = 1 or found.empty").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose quality score reaches 0.3; the score reads the text alone, so repeated rows fare alike.

    A null or empty text has the score of the bias alone; an empty table stays empty.  Where no label is
    given every score is one half, so all rows stay.
    """
    from gleaner.llm.quality import quality_scores

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    scored = quality_scores(rows, _table(spark, sf_dir, "labels"), "row", folds=5, held=0)
    return scored.filter("score >= 0.3").select("key.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are cut out; every document stays, if only as an empty text.

    A text that loses nothing is left as it is; n_chars, where there is one, follows the text.
    """
    from gleaner.llm.substring import remove_repeats

    rows = remove_repeats(docs, Steps(spark, "stage"), length=35)
    whole = F.col("n_removed") == 0
    new = {"text": F.when(whole, F.col("doc.text")).otherwise(F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("doc.n_chars")).otherwise(
            F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover half of a benchmark item or more are dropped.

    Null and empty texts have no leaks and stay, as all rows do where the benchmark is empty.
    """
    from gleaner.llm.decontaminate import find_leaks

    return find_leaks(docs, _table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of at most 2048 tokens, with their ids.

    A null or empty text is the end id alone; an empty table has no sequences.
    """
    import public_tokenizers

    from gleaner.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), encode_special_tokens=False)
