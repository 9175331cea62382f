"""Datasets from relational tables: what an episode, a frame and a stream are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.dataset import SPAN, Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def _episodes(frames: DataFrame, length=None) -> DataFrame:
    none = F.lit(None)
    return frames.groupBy("episode_index").agg((length if length is not None else F.count("*")).cast("bigint").alias("meta_length")).select(
        "episode_index", "meta_length", none.cast("string").alias("task"),
        none.cast(f"map<string,{SPAN}>").alias("spans"), none.cast("map<string,struct<mean:double,std:double>>").alias("cameras"),
    )


def suppliers(spark: SparkSession, sf_dir: str, fps: float = 10.0) -> Dataset:
    """Line items as frames of their supplier; the state is the action of supplier % 4 frames before."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = _numbered(table(spark, sf_dir, "lineitem").select("l_suppkey", *order, "l_quantity", "l_discount", "l_tax"), "l_suppkey", *order)
    w = Window.partitionBy("l_suppkey").orderBy("pos")
    action = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = rows.withColumn("action", action)
    back = F.coalesce(*[F.when(F.col("l_suppkey") % 4 == k, F.lag("action", k).over(w) if k else F.col("action")) for k in range(4)], F.first("action").over(w))
    frames = rows.select(F.col("l_suppkey").alias("episode_index"), "pos", F.col("pos").cast("bigint").alias("frame_index"), (F.col("pos") / F.lit(fps)).alias("timestamp"), "action", back.alias("state"), F.lit(None).cast("bigint").alias("task_index"))
    names = ["quantity", "price", "discount", "gripper_tax"]
    return Dataset(frames, _episodes(frames), fps, source="lineitem", action_names=names, state_names=names)


def users(spark: SparkSession, sf_dir: str, fps: float) -> Dataset:
    """Events as frames of their user, at their own times."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    k = F.get_json_object("props", "$.k").cast("double")
    rows = _numbered(e, "user_id", "ts", "event_id")
    frames = rows.select(F.col("user_id").alias("episode_index"), "pos", F.col("pos").cast("bigint").alias("frame_index"), seconds.alias("timestamp"), F.array("value", k).alias("action"), F.lit(None).cast("array<double>").alias("state"), F.lit(None).cast("bigint").alias("task_index"))
    return Dataset(frames, _episodes(frames), fps, source="events", action_names=["gripper_value", "k"])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_index, pos: orders as frames of their customer."""
    rows = _numbered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select(F.col("o_custkey").alias("episode_index"), "pos", "o_orderkey", "o_orderdate", "o_totalprice")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_index, frame_index, task: turns as frames of their conversation."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_index"), F.col("turn").alias("frame_index"), F.col("role").alias("task"), "text")
