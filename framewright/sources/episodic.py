"""Reader of episodic datasets: Parquet frames, JSON metadata, in two layouts.

v3: many episodes a file, meta/episodes/**/*.parquet, meta/tasks.parquet. v2: a file for each episode,
meta/*.jsonl. Only small metadata is read on the driver; frames are one explicit-schema Parquet scan, pruned to
the files that hold the wanted episodes.
"""

from __future__ import annotations

import json
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.dataset import EPISODES, SPAN, Dataset
from framewright.functions.scalars import finite

REQUIRED = ("episode_index", "frame_index", "timestamp")
STREAMS = {"action": "action", "observation.state": "state"}


def read_text(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException:
        return None
    return rows[0][0] if rows else None


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def flat_names(names) -> list[str] | None:
    """Feature names from a list, a list of lists, or a dict of lists."""
    if isinstance(names, dict):
        names = [n for v in names.values() for n in (v if isinstance(v, list) else [v])]
    if isinstance(names, list) and names and all(isinstance(n, list) for n in names):
        names = [n for v in names for n in v]
    return list(names) if isinstance(names, list) and names and all(isinstance(n, str) for n in names) else None


def part_names(column: str, feature: dict) -> list[str]:
    """Names of a sub-column's dimensions: its last part, a dot, and the dimension's own name or number."""
    last, shape, names = column.rpartition(".")[2], feature.get("shape"), flat_names(feature.get("names"))
    width = prod(shape) if shape else None
    if width is None and not names:
        return [last]
    if names is None or (width is not None and len(names) != width):
        names = [str(i) for i in range(width or 1)]
    return [f"{last}.{n}" for n in names]


def parts_of(features: dict, stream: str) -> list[str]:
    """Sub-columns of a stream that isn't a column itself."""
    if stream in features:
        return []
    return [c for c, f in features.items() if c.startswith(stream + ".") and f.get("dtype") not in ("string", "video", "image")]


def concat_parts(columns: list[str]):
    """Array columns as one; null where one of them is."""
    return F.concat(*[F.col(f"`{c}`") for c in columns])


def as_vector(c, kind: T.DataType):
    """A number or array, nested or not, as an array of doubles."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    return c.cast("array<double>") if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c.cast("double")))


def _double(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_double(kind.elementType))
    return T.DoubleType() if isinstance(kind, (T.FloatType, T.DoubleType)) else kind


def quarantine(frames: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """frames without episodes that are declared more than once, and those episodes."""
    twice = declared.groupBy("episode_index").count().where("count > 1").select("episode_index")
    return frames.join(twice, "episode_index", "left_anti"), twice


def with_tasks(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """episodes with the task of their task_index (tasks: task_index, name) where they have none of their own."""
    return episodes.join(F.broadcast(tasks), "task_index", "left").withColumn("task", F.coalesce("task", "name")).drop("name")


def image_stat(c, kind: T.DataType):
    """The mean of all numbers in nested arrays; null if there is none or one isn't finite."""
    v = as_vector(c, kind)
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: ~finite(x)), F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def first_task(c, kind: T.DataType):
    return F.get(c, F.lit(0)) if isinstance(kind, T.ArrayType) else c


def _map(entries: list, kind: str):
    none = F.lit(None).cast(f"map<string,{kind}>")
    if not entries:
        return none
    found = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    return F.when(F.size(found) > 0, found)


def episodes_v3(raw: DataFrame, cameras: list[str]) -> DataFrame:
    """EPISODES from wide metadata rows."""
    has, c = set(raw.columns), lambda name: F.col(f"`{name}`")
    whole = lambda name: c(name).cast("bigint") if name in has else F.lit(None).cast("bigint")
    spans = [F.struct(F.lit(cam).alias("key"), F.when(c(f"videos/{cam}/from_timestamp").isNotNull(), F.struct(c(f"videos/{cam}/from_timestamp").cast("double").alias("start"), c(f"videos/{cam}/to_timestamp").cast("double").alias("end"), whole(f"videos/{cam}/chunk_index").alias("chunk"), whole(f"videos/{cam}/file_index").alias("file"))).alias("value")) for cam in cameras if {f"videos/{cam}/from_timestamp", f"videos/{cam}/to_timestamp"} <= has]
    stats = []
    for cam in cameras:
        m, s = f"stats/{cam}/mean", f"stats/{cam}/std"
        if {m, s} <= has:
            mean, std = image_stat(c(m), raw.schema[m].dataType), image_stat(c(s), raw.schema[s].dataType)
            stats.append(F.struct(F.lit(cam).alias("key"), F.when(mean.isNotNull() & std.isNotNull(), F.struct(mean.alias("mean"), std.alias("std"))).alias("value")))
    task = first_task(c("tasks"), raw.schema["tasks"].dataType) if "tasks" in has else F.lit(None).cast("string")
    length = c("length").cast("bigint") if "length" in has else F.lit(None).cast("bigint")
    return raw.select(c("episode_index").cast("bigint").alias("episode_index"), length.alias("meta_length"), task.alias("task"), _map(spans, SPAN).alias("spans"), _map(stats, "struct<mean:double,std:double>").alias("cameras"))


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).json(path).where("coalesce(" + ", ".join(x.split()[0] for x in schema.split(", ", 1)[:1]) + ") is not null") if exists(spark, path) else None


def episodes_v2(spark: SparkSession, root: str, cameras: list[str]) -> DataFrame | None:
    raw = _jsonl(spark, f"{root}/meta/episodes.jsonl", "episode_index bigint, tasks array<string>, length bigint")
    if raw is None:
        return None
    rows = raw.select("episode_index", F.col("length").alias("meta_length"), F.get("tasks", F.lit(0)).alias("task"), F.lit(None).cast(f"map<string,{SPAN}>").alias("spans"))
    nested = "array<array<array<double>>>"
    stats = _jsonl(spark, f"{root}/meta/episodes_stats.jsonl", f"episode_index bigint, stats map<string,struct<mean:{nested},std:{nested}>>") if cameras else None
    if stats is None:
        return rows.withColumn("cameras", F.lit(None).cast("map<string,struct<mean:double,std:double>>"))
    kind = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    each = stats.select("episode_index", F.explode("stats").alias("cam", "s")).where(F.col("cam").isin(cameras))
    each = each.select("episode_index", "cam", F.struct(image_stat(F.col("s.mean"), kind).alias("mean"), image_stat(F.col("s.std"), kind).alias("std")).alias("v")).where("v.mean is not null and v.std is not null")
    cams = each.groupBy("episode_index").agg(F.map_from_entries(F.collect_list(F.struct("cam", "v"))).alias("cameras"))
    return rows.join(cams, "episode_index", "left")


def wanted_files(spark: SparkSession, root: str, info: dict, ids) -> list[str] | None:
    """Paths of the files with the wanted episodes; None if the metadata doesn't say."""
    template, size = info.get("data_path"), info.get("chunks_size") or 1000
    if not str(info.get("codebase_version", "")).startswith("v3"):
        template = template or "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
        return sorted({f"{root}/{template.format(episode_chunk=i // size, episode_index=i)}" for i in ids})
    if not template or not exists(spark, f"{root}/meta/episodes/*/*.parquet"):
        return None
    raw = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    if not {"data/chunk_index", "data/file_index"} <= set(raw.columns):
        return None
    places = raw.where(F.col("episode_index").isin(list(ids))).select(F.col("`data/chunk_index`").alias("c"), F.col("`data/file_index`").alias("f")).distinct().collect()
    return sorted(f"{root}/{template.format(chunk_index=p.c, file_index=p.f)}" for p in places)


def load(spark: SparkSession, root: str, episodes=None, max_episodes: int | None = None) -> Dataset:
    """A dataset from a folder (any path that Spark reads). episodes: ids to load; max_episodes: the first so many."""
    root = root.rstrip("/")
    text = read_text(spark, f"{root}/meta/info.json")
    if text is None:
        raise FileNotFoundError(f"no meta/info.json in {root}")
    info = json.loads(text)
    features, warnings = info.get("features", {}), []
    cameras = [c for c, f in features.items() if f.get("dtype") in ("video", "image")]
    v3_meta = exists(spark, f"{root}/meta/episodes/*/*.parquet") or exists(spark, f"{root}/meta/episodes/*.parquet")
    if v3_meta:
        meta = episodes_v3(spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes"), cameras)
    else:
        meta = episodes_v2(spark, root, cameras)
    ids = None
    if meta is not None and (episodes is not None or max_episodes is not None):
        twice = {r[0] for r in quarantine(meta, meta)[1].collect()}
        if episodes is not None:
            ids = sorted(set(episodes))
            if bad := [i for i in ids if i in twice]:
                raise ValueError(f"episodes {bad} are declared more than once and can't be loaded")
            known = {r[0] for r in meta.where(F.col("episode_index").isin(ids)).select("episode_index").collect()}
            if missing := [i for i in ids if i not in known]:
                raise ValueError(f"no such episodes: {missing}")
        else:
            ids = [r[0] for r in meta.select("episode_index").distinct().where(~F.col("episode_index").isin(sorted(twice))).orderBy("episode_index").limit(max_episodes).collect()]
        if max_episodes is not None:
            ids = ids[:max_episodes]
        if not ids:
            raise ValueError("no episode is left")
    files = wanted_files(spark, root, info, ids) if ids is not None else None
    reader = spark.read.option("recursiveFileLookup", "true")
    paths = files or [f"{root}/data"]
    schema = reader.parquet(paths[0]).schema
    if lacking := [c for c in REQUIRED if c not in schema.names]:
        raise ValueError(f"the data has no column {', '.join(lacking)}")
    streams = {s: ([s] if s in schema.names else [c for c in parts_of(features, s)]) for s in STREAMS}
    streams = {s: cols if all(c in schema.names for c in cols) else [] for s, cols in streams.items()}
    columns = [*REQUIRED, *(c for cols in streams.values() for c in cols), *(["task_index"] if "task_index" in schema.names else [])]
    # One schema for all files, with doubles for floats: files may differ in precision.
    raw = reader.schema(T.StructType([T.StructField(c, _double(schema[c].dataType)) for c in columns])).parquet(*paths)
    select, names = [], {}
    for s, alias in STREAMS.items():
        cols = streams[s]
        vectors = [as_vector(F.col(f"`{c}`"), schema[c].dataType) for c in cols]
        select.append((F.concat(*vectors) if vectors else F.lit(None).cast("array<double>")).alias(alias))
        names[s] = flat_names(features.get(s, {}).get("names")) if cols == [s] else [n for c in cols for n in part_names(c, features[c])] or None
        if not cols:
            warnings.append(f"the data has no {s}; checks that need it are skipped")
    frames = raw.select(F.col("episode_index").cast("bigint").alias("episode_index"), F.col("frame_index").cast("bigint").alias("frame_index"), F.col("timestamp").cast("double").alias("timestamp"), *select, (F.col("task_index").cast("bigint") if "task_index" in columns else F.lit(None).cast("bigint")).alias("task_index"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if ids is not None:
        frames = frames.where(F.col("episode_index").isin(ids))
    if meta is not None:
        frames, twice_df = quarantine(frames, meta)
        bad = sorted(r[0] for r in twice_df.collect())
        if bad:
            warnings.append(f"episodes {bad} are declared more than once in the metadata; they are left out")
            meta = meta.where(~F.col("episode_index").isin(bad))
    w = Window.partitionBy("episode_index").orderBy("frame_index", "_file", "_row")
    frames = frames.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).drop("_file", "_row").select("episode_index", "pos", "frame_index", "timestamp", "action", "state", "task_index")
    return Dataset(frames, _with_task_names(spark, root, frames, meta), float(info["fps"]), root, str(info.get("codebase_version", "")), info.get("robot_type"), names["action"], names["observation.state"], cameras, warnings, root, info.get("video_path"), info.get("chunks_size") or 1000)


def tasks_table(spark: SparkSession, root: str) -> DataFrame | None:
    """task_index, name: from Parquet (the name is the index) or lines of JSON."""
    if exists(spark, f"{root}/meta/tasks.parquet"):
        t = spark.read.parquet(f"{root}/meta/tasks.parquet")
        name = next((c for c in ("__index_level_0__", "task") if c in t.columns), None)
        return t.select(F.col("task_index").cast("bigint").alias("task_index"), F.col(name).alias("name")) if name else None
    t = _jsonl(spark, f"{root}/meta/tasks.jsonl", "task_index bigint, task string")
    return None if t is None else t.select("task_index", F.col("task").alias("name"))


def _with_task_names(spark: SparkSession, root: str, frames: DataFrame, meta: DataFrame | None) -> DataFrame:
    first = frames.where("pos = 0").select("episode_index", "task_index")
    if meta is None:
        empty = spark.createDataFrame([], EPISODES)
        meta = first.select("episode_index").join(empty, "episode_index", "left")
    e = first.join(meta, "episode_index", "left")
    tasks = tasks_table(spark, root)
    return (with_tasks(e, tasks) if tasks is not None else e).select("episode_index", "meta_length", "task", "spans", "cameras")
