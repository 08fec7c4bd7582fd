"""Corpus pipeline: documents to token ids, in five stages.

Each stage takes all rows that the one before it kept and returns the columns of documents; the last returns
a row per written document. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import fresh, shared_dir, table, written
from veritab.llm.decontaminate import decontaminate
from veritab.llm.jaccard_join import jaccard_components
from veritab.llm.mix_sources import document_key, mix
from veritab.llm.token_planes import token_planes
from veritab.llm.toxicity import fit_toxicity, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go.

    Null and empty texts stay; very long texts are scored whole; repeated rows fare alike; an empty table gives no rows; other columns are kept.
    """
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a Jaccard similarity of 0.8 or more, one row stays: that with the smallest doc_id.

    Ties of doc_id go to the smaller hash of the text, then to the row read first; a null doc_id counts as the largest. Repeated rows are linked,
    so one of them stays. Texts go by a 64-bit hash. Null and empty texts link with nothing and all stay. Very long texts are compared whole. An empty table gives no rows. Other
    columns are kept, whatever their names.
    """
    key, id_, again, order = fresh(docs, "near_key"), fresh(docs, "near_id"), fresh(docs, "near_again"), fresh(docs, "near_order")
    text = F.col("text").cast("string")
    keyed = docs.withColumn(key, F.xxhash64(text)).withColumn(id_, F.col("doc_id").cast("long"))
    # a text goes by its hash, so that no copy of the texts need be kept to number them; texts without words have no group
    groups = jaccard_components(keyed.select(F.col(key).alias("doc_id"), text.alias("text")), size=5, percent=80).where("n_shingles > 0")
    groups = groups.groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("group"))
    ids = keyed.select(F.col(key), F.col(id_)).groupBy(key, id_).agg((F.count("*") > 1).alias(again)).join(groups, key)
    stay = ids.groupBy("group").agg(F.min(F.struct(F.col(id_).isNull(), F.col(id_), F.col(key), F.col(again))).alias("least"))
    stay = written(stay.select(*(F.col("least")[c].alias(c) for c in (key, id_, again))), "pipeline-stay")
    columns = [f"`{c}`" for c in docs.columns]
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")

    def kept(rows: DataFrame, of: DataFrame) -> DataFrame:
        same = (F.col(f"l.{key}") == F.col(f"r.{key}")) & F.col(f"l.{id_}").eqNullSafe(F.col(f"r.{id_}"))
        return rows.where(~wordless).alias("l").join(of.alias("r"), same, "left_semi")

    once = kept(keyed, stay.where(~F.col(again))).select(*columns)
    # of rows alike in both, the one read first
    first = kept(keyed.withColumn(order, F.monotonically_increasing_id()), stay.where(again))
    first = first.groupBy(key, id_).agg(F.min_by(F.struct(*columns), order).alias(order)).select(f"{order}.*")
    return docs.where(wordless).unionByName(once).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more from benchmark items are cut out; a document of which they are more than half goes.

    Null and empty texts have no words and stay as they are; very long texts are streamed whole; repeated rows fare alike; an empty
    table gives no rows; other columns are kept, but that n_chars counts what is left of the text.
    """
    cut = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (0 to 3 times).

    Null and empty texts have no words and are taken 0 times; a very long text weighs as all its words. Rows with one doc_id, source
    and text share what they are taken together, however their other columns differ. Null source is a source. An empty table gives no rows.
    Other columns are kept, whatever their names.
    """
    key, times, copy = fresh(docs, "mix_key"), fresh(docs, "mix_times"), fresh(docs, "mix_copy")
    copies, rows = fresh(docs, "mix_copies"), fresh(docs, "mix_rows")
    taken = mix(docs).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    keyed = docs.withColumn(key, document_key()).join(taken, key)
    # rows that are alike share what they are taken together
    number = F.row_number().over(Window.partitionBy(key).orderBy(key))
    share = F.floor(F.col(copies) / F.col(rows)) + (number <= F.col(copies) % F.col(rows)).cast("int")
    keyed = keyed.withColumn(times, share.cast("int")).where(F.col(times) > 0)
    return keyed.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(f"`{c}`" for c in docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids as byte planes and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts give the end id alone; very long texts are encoded whole; repeated rows are documents each; null doc_id comes last;
    an empty table gives no rows; other columns don't matter.
    """
    return token_planes(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: SQL can't express the model of the first stage, nor the tokenizer of the last: tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
