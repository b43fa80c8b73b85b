"""Where results go: columnar tables, CSV, JSON documents, and saved models."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, one folder per value of ``by``; rows are moved to their folder's task first, in blocks of bounded size."""
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_documents(df: DataFrame, path: str, column: str = "json") -> None:
    """One JSON document per line."""
    df.select(column).write.mode("overwrite").text(path)


def save_model(levels: DataFrame, shares: DataFrame, path: str, **facts: float | str | None) -> None:
    """Level tables, archetype shares and one row of facts (smoothing, target rank)."""
    write_table(levels, f"{path}/levels", ["level"])
    write_table(shares, f"{path}/shares")
    spark = levels.sparkSession
    spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(facts.items())], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str | None]]:
    levels = spark.read.parquet(f"{path}/levels").withColumn("level", F.col("level").cast("int"))
    facts = {r["name"]: r["value"] for r in spark.read.schema("name string, value string").json(f"{path}/facts").collect()}
    return levels, spark.read.parquet(f"{path}/shares"), facts


def html_table(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A page with the first rows of a result (a report of at most ``limit`` rows)."""
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in df.limit(limit).collect())
    head = "".join(cell("th", c) for c in df.columns)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    rows = [df.columns, ["---"] * len(df.columns), *([("" if x is None else str(x)).replace("|", "\\|") for x in r] for r in df.limit(limit).collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
