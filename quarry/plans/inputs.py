"""How the test tables become the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.chunk import chunk_markdown


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    return F.concat(F.lit("/ws/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, body: each line of a document is a paragraph."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _path().alias("path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), "text", _path().alias("doc_path"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all documents as chunks: many in a file."""
    return chunk_markdown(corpus(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with a document's number belongs to its chunk."""
    held = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks(spark, sf_dir).withColumn("text_hash", F.sha2("text", 256)).join(held, "doc_id").select("doc_id", "line_start", "line_end", "doc_path", "text", "text_hash", "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, body: one JSONL log per conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    # a conversation is one file: its turns belong together
    whole = turns.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("body"))
    return whole.select(F.col("conv_id").alias("id"), F.concat(F.lit("/ws/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), "body")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store remembers of the files: path, mtime, length, id."""
    return table(spark, sf_dir, "documents").select(_path().alias("path"), (F.lit(1700000000) + F.col("doc_id")).alias("mtime"), F.col("n_chars").alias("length"), F.col("doc_id").alias("id"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk now: every 7th file was touched, every 11th is gone."""
    held = stored_files(spark, sf_dir).filter(F.col("id") % 11 != 0)
    return held.withColumn("mtime", F.col("mtime") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))


def changed_chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): every 5th text changes, every 13th chunk goes, every 17th gets a second one, every 3rd a longer range."""
    old = chunks(spark, sf_dir)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" (edited)"))).otherwise(F.col("text"))
    end = F.when(F.col("doc_id") % 3 == 0, F.col("line_end") + 1).otherwise(F.col("line_end"))
    new = old.filter(F.col("doc_id") % 13 != 0).withColumn("text", text).withColumn("line_end", end.cast("int"))
    more = old.filter(F.col("doc_id") % 17 == 0).withColumn("line_start", F.lit(2)).withColumn("line_end", F.lit(2)).withColumn("text", F.lit("appended"))
    return old, new.unionByName(more)


def device_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry: the users of the events table as devices."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("registered_at"), F.max("ts").alias("updated_at"))
    u = F.col("user_id").cast("string")
    return users.select(
        F.format_string("dev-%08d", "user_id").alias("id"), F.concat(F.lit("name "), u).alias("name"), F.concat(F.lit("host "), u).alias("hostname"), F.lit("app").alias("app_id"),
        F.lit("1.0").alias("app_version"), F.lit("linux").alias("platform"), F.lit("x86_64").alias("arch"), "registered_at", "updated_at",
    )


def device_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports: even devices renamed an hour later, every third never touched, others an hour earlier; 5 is unknown so far."""
    n = F.substring("id", 5, 8).cast("int")
    held = device_records(spark, sf_dir)
    hour = F.expr("INTERVAL 1 HOUR")
    time = F.when(n % 3 == 0, F.lit(None).cast("timestamp")).when(n % 2 == 0, F.col("updated_at") + hour).otherwise(F.col("updated_at") - hour)
    return held.select(
        F.when(n % 5 == 0, F.concat(F.lit("new-"), "id")).otherwise(F.col("id")).alias("id"), F.concat("name", F.lit(" renamed")).alias("name"), "hostname", "app_id",
        F.when(n % 7 == 0, "2.0").otherwise("1.0").alias("app_version"), "platform", "arch", time.alias("updated_at"),
    )
