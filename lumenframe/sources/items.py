"""Query and ground-truth items: aliases, defaults and task routing.

A value of any spelling counts if it is neither empty nor zero; the first such alias wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Aliases, in order.
ALIASES = {
    "query_id": ("query_id", "qid", "q_id", "id", "queryId"),
    "query": ("query", "text", "prompt", "description", "query_text", "caption"),
    "question": ("question", "q", "qa_question", "query_question"),
    "video_id": ("video_id", "vid", "video", "videoId", "video_name"),
    "frame_start": ("frame_start", "start", "start_frame", "from"),
    "frame_end": ("frame_end", "end", "end_frame", "to"),
    "answer": ("answer", "ans", "ground_truth", "gt"),
    "events": ("events", "sub_events", "event_list", "actions"),
}
EVENT_NAMES, EVENT_STARTS, EVENT_ENDS = ("name", "event_name", "action", "text", "desc"), ("frame_start", "start"), ("frame_end", "end")
TASKS = ("task1", "task2", "task3")


def _first(raw: Column, names: tuple[str, ...]) -> Column:
    """First alias in the JSON object ``raw`` that is neither missing, empty nor zero."""
    values = [F.get_json_object(raw, f"$['{n}']") for n in names]
    return F.coalesce(*[F.when(~v.isin("", "0", "0.0", "false", "[]", "{}", "null"), v) for v in values])


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").cast("int"), F.lit(0))


def normalised_items(raw: DataFrame) -> DataFrame:
    """``raw(json, ...)`` with one object a row to the columns of a query item; what isn't an object is the query itself."""
    is_object = F.ltrim("json").startswith("{")
    first = {k: _first(F.col("json"), v) for k, v in ALIASES.items()}
    events = F.from_json(first["events"], "array<string>")
    event = F.transform(events, lambda e: F.when(F.ltrim(e).startswith("{"), F.struct(
        F.coalesce(_first(e, EVENT_NAMES), F.lit("")).alias("name"), _number(_first(e, EVENT_STARTS)).alias("frame_start"), _number(_first(e, EVENT_ENDS)).alias("frame_end"),
    )).otherwise(F.struct(e.alias("name"), F.lit(0).alias("frame_start"), F.lit(0).alias("frame_end"))))
    text = lambda k, default="": F.when(is_object, F.coalesce(first[k], F.lit(default))).otherwise(F.lit(default))
    none = F.array().cast("array<struct<name:string,frame_start:int,frame_end:int>>")
    return raw.select(
        *[c for c in raw.columns if c != "json"], text("query_id", "unknown").alias("query_id"),
        F.when(is_object, F.coalesce(first["query"], F.lit(""))).otherwise(F.regexp_replace("json", '^"|"$', "")).alias("query"), text("question").alias("question"), text("video_id").alias("video_id"),
        _number(first["frame_start"]).alias("frame_start"), _number(first["frame_end"]).alias("frame_end"), text("answer").alias("answer"), F.coalesce(event, none).alias("events"),
    )


def routed(task: Column) -> Column:
    """Task of an item in a flat list: task1 unless it names another."""
    low = F.lower(F.coalesce(task, F.lit("")))
    return F.when(low.isin(*TASKS), low).otherwise("task1")


def items_of_json(files: DataFrame) -> DataFrame:
    """``task, ord, key, json`` of ``files(raw)``: an object of tasks with lists or objects of items, or a flat list."""
    grouped = files.where(F.ltrim("raw").startswith("{"))
    flat = files.where(F.ltrim("raw").startswith("["))
    rows = []
    for task in TASKS:
        part = F.get_json_object("raw", f"$.{task}")
        listed = grouped.where(F.ltrim(part).startswith("[")).select(F.lit(task).alias("task"), F.posexplode(F.from_json(part, "array<string>")).alias("ord", "json")).withColumn("key", F.lit(None).cast("string"))
        keyed = grouped.where(F.ltrim(part).startswith("{")).select(F.lit(task).alias("task"), F.posexplode(F.map_entries(F.from_json(part, "map<string,string>"))).alias("ord", "e")).select("task", "ord", F.col("e.value").alias("json"), F.col("e.key").alias("key"))
        rows += [listed, keyed]
    listed = flat.select(F.posexplode(F.from_json("raw", "array<string>")).alias("ord", "json"))
    rows.append(listed.select(routed(F.get_json_object("json", "$.task")).alias("task"), "ord", "json", F.lit(None).cast("string").alias("key")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON files, or of CSV files with a header."""
    if path.lower().endswith(".csv"):
        table = spark.read.option("header", "true").option("multiLine", "true").csv(path)
        task = F.col("task") if "task" in table.columns else F.lit(None).cast("string")
        return normalised_items(table.select(routed(task).alias("task"), F.to_json(F.struct(*table.columns)).alias("json")))
    raw = spark.read.option("wholetext", "true").text(path).withColumnRenamed("value", "raw")
    return normalised_items(items_of_json(raw))
