"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legispark.llm import decontaminate as _decontaminate
from legispark.llm import minhash, mixing, sharding
from legispark.llm import toxicity as _toxicity
from legispark.llm.storage import materialize
from legispark.shipping import ship

#: Near-duplicates share 80% of their five-word shingles.
WIDTH, PERCENT = 5, 80
SHARDS = 40


#: Rows up to which per-document decisions are broadcast to the texts; beyond it the texts are shuffled to them.
BROADCAST_ROWS = 250_000


def _small(df: DataFrame) -> DataFrame:
    df = materialize(df, "decisions")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def _apart(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``docs`` does not have."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model is fitted on labelled rows of its input.

    Null and empty texts and rows without a doc_id are scored like others and stay; repeated rows stay or go together;
    an empty table stays empty. Other columns, whatever their names, are carried.
    """
    ship(spark)
    model = _toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _toxicity.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each near-duplicate group.

    Documents without words, or without a doc_id, are in no group and stay. Rows that repeat a doc_id are one document
    and stay or go together; an empty table stays empty. Other columns, whatever their names, are carried.
    """
    ship(spark)
    (gone,) = _apart(docs, "_gone")
    out = minhash.near_duplicates(docs, WIDTH, PERCENT)
    dropped = out.filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(_small(dropped), F.col("doc_id") == F.col(gone), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs.

    Every row is judged on its own text, also those without a doc_id or with one that others share; null and empty texts
    stay; an empty table stays empty. Other columns, whatever their names, are carried.
    """
    ship(spark)
    row, gone, text = _apart(docs, "_row", "_gone", "_gone_text")
    hits = _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True)
    dropped = hits.filter("contaminated").select(F.col("doc_id").alias(gone), F.col("text_hash").alias(text)).distinct()
    keyed = docs.withColumn(row, _decontaminate.text_hash(F.col("text")))
    return keyed.join(_small(dropped), F.col("doc_id").eqNullSafe(F.col(gone)) & (F.col(row) == F.col(text)), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, zero to three times.

    Documents without words are not taken. A null source is a source of its own. Rows that are alike are rows of their
    own, each with its own number of copies; an empty table stays empty. Other columns, whatever their names, are carried.
    """
    ship(spark)
    row, turn, number = _apart(docs, "_row", "_turn", "_copy")
    mixed = materialize(mixing.mix(docs).select("doc_id", "source", "_key", "_turn", "copies"), "mixed")
    # The plan's columns get names that the documents do not have.
    names = _apart(docs, *(f"_plan{k}" for k in range(5)))
    plan = mixed.toDF(*names)
    again = materialize(plan.filter(F.col(names[3]) > 0).select(*names[:3]).distinct(), "repeated")
    keyed = docs.withColumn(row, mixing.row_key(F.col("doc_id"), F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1])) & (F.col(row) == F.col(names[2]))
    if again.isEmpty():
        sole = keyed.withColumn(turn, F.lit(0).cast("long"))
    else:
        few = _small(again)
        sole = keyed.join(few, same, "left_anti").withColumn(turn, F.lit(0).cast("long"))
        repeated = mixing.occurrence(keyed.join(few, same, "left_semi"), ["doc_id", "source", row], turn)
        sole = sole.unionByName(repeated)
    taken = sole.join(_small(plan.filter(F.col(names[4]) > 0)), same & (F.col(turn) == F.col(names[3])))
    return taken.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(names[4]).cast("int")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot; equal bytes per shard.

    Null texts have 16 bytes, null doc_ids sort first, repeated rows get a slot each, an empty table stays empty. Columns
    named size, shard or slot are replaced, others carried, whatever their names.
    """
    ship(spark)
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]

#: Fitted models, hashes and components are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
