"""JSON of text facts: an array, ``{"grains": [...]}``, one object, or an object per line.

Required are sid and text; category (modulo 256) and amount default to 0. A request is all or
nothing: ``invalid`` shows what rejects it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "struct<sid:string,text:string,category:string,amount:string>"


def whole_number(text: Column) -> Column:
    """The bigint that a text spells; null for anything else."""
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))


def typed(item: Column) -> list[Column]:
    """sid, category, amount, text of a parsed item; a category that isn't a whole number of at
    least 0 counts as 0, as does an amount that isn't whole."""
    category = whole_number(item["category"])
    return [
        whole_number(item["sid"]).alias("sid"),
        F.when(category >= 0, F.pmod(category, F.lit(256))).otherwise(F.lit(0)).cast("int").alias("category"),
        F.coalesce(whole_number(item["amount"]), F.lit(0)).cast("bigint").alias("amount"),
        item["text"].alias("text"),
    ]


def from_lines(lines: DataFrame) -> DataFrame:
    """Facts of a DataFrame of JSON objects, one per row in ``value``; blank rows are skipped."""
    parsed = lines.where(F.length(F.trim("value")) > 0).select(F.from_json("value", RAW).alias("item"))
    return parsed.select(*typed(F.col("item")))


def from_body(spark: SparkSession, body: str) -> DataFrame:
    """Facts of a request body of any of the four forms; ValueError if it has an invalid item."""
    try:
        data = json.loads(body)
    except ValueError:
        data = [json.loads(line) for line in body.splitlines() if line.strip()]
    items = data if isinstance(data, list) else data["grains"] if isinstance(data, dict) and "grains" in data else [data]
    if not items:
        raise ValueError("no facts given")
    for item in items:
        sid = item.get("sid") if isinstance(item, dict) else None
        if not isinstance(sid, int) or isinstance(sid, bool) or not 0 <= sid < 2**63 or not isinstance(item.get("text"), str):
            raise ValueError(f"an item needs a whole number sid and a text: {json.dumps(item)[:200]}")
    return from_lines(spark.createDataFrame([(json.dumps(i),) for i in items], "value string"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold an array of objects or ``{"grains": [...]}`` each, read whole."""
    body = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", f"struct<grains:array<{RAW}>>")["grains"]
    many = F.from_json("value", f"array<{RAW}>")
    chosen = F.when(F.ltrim("value").startswith("["), many).otherwise(nested)
    return body.select(F.explode(chosen).alias("item")).select(*typed(F.col("item")))


def invalid(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("sid").isNull() | (F.col("sid") < 0) | F.col("text").isNull())
