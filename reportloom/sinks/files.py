"""Written outputs. Every function here runs a Spark write.

``rebalance`` lets adaptive execution merge small partitions and split large ones before a
write, so a big key neither becomes one task nor scatters into thousands of small files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from reportloom.functions import content as ct


def write_name_index(names: DataFrame, path: str) -> None:
    """patient_id -> name as JSON lines (sharded)."""
    rows = names.select("patient_id", F.col("full_name").alias("name"))
    rows.hint("rebalance").write.mode("overwrite").json(path)


def parse_log_rows(outcomes: DataFrame) -> DataFrame:
    """Log columns from ``parse_files`` outcomes with start_time, end_time and worker ids."""
    return outcomes.select(
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]+$", "").alias("report_id"),
        F.col("path").alias("pdf_path"),
        F.when(F.col("ok"), "ok").otherwise("fail").alias("status"),
        F.when(F.col("ok"), 0).otherwise(1).alias("return_code"),
        "start_time",
        "end_time",
        F.format_string("%.2f", "duration_sec").alias("duration_sec"),
        "thread_name",
        "thread_id",
        F.right(F.coalesce("error", F.lit("")), F.lit(400)).alias("stderr_tail"),
    )


def write_parse_log(outcomes: DataFrame, path: str) -> None:
    parse_log_rows(outcomes).hint("rebalance").write.mode("append").option("header", True).csv(path)


def usage_entries(usage: DataFrame) -> DataFrame:
    """Ledger rows as nested log entries with their day.

    ``id``, ``metadata`` (JSON text) and ``error`` are taken where the ledger has them. An entry
    with an error has the error in place of id, time, operation and total.
    """
    failed = F.col("error").isNotNull() if "error" in usage.columns else F.lit(False)

    def unless_failed(column: Column) -> Column:
        return F.when(~failed, column)

    def optional(name: str) -> list[Column]:
        return [F.col(name)] if name in usage.columns else []

    return usage.select(
        F.to_date("timestamp").alias("date"),
        *[unless_failed(c).alias("id") for c in optional("id")],
        *optional("error"),
        unless_failed(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        "user_id",
        "session_id",
        unless_failed(F.col("operation_type")).alias("operation_type"),
        "model_name",
        F.struct(
            F.col("input_tokens").alias("input"),
            F.col("output_tokens").alias("output"),
            unless_failed(F.col("total_tokens")).alias("total"),
        ).alias("tokens"),
        F.struct("input_cost", "output_cost", "total_cost").alias("costs"),
        *optional("metadata"),
    )


def write_usage_jsonl(usage: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per day."""
    rows = usage_entries(usage).hint("rebalance", "date")
    rows.write.mode("append").partitionBy("date").json(path)


def write_formatted_reports(reports: DataFrame, path: str) -> None:
    """(file_name, text) rows; see ``sinks.tables.formatted_reports``."""
    reports.hint("rebalance").write.mode("overwrite").parquet(path)


def write_file_per_row(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Each row's bytes as a file of its own in ``folder``; returns the number of files.

    A name with ``/`` goes into folders below, which are made as needed.
    Tasks write the files, so the folder must be one that all executors share. A repeated task
    writes the same files again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(folder)
        store.create_dir(inside, recursive=True)
        for frame in frames:
            for below in {n.rpartition("/")[0] for n in frame[name]} - {""}:
                store.create_dir(f"{inside}/{below}", recursive=True)
            for file_name, data in zip(frame[name], frame[content], strict=True):
                # The bytes as they are, whatever the name ends in.
                with store.open_output_stream(f"{inside}/{file_name}", compression=None) as out:
                    out.write(bytes(data or b""))
            yield pd.DataFrame({"n": [len(frame)]})

    done = rows.select(name, content).mapInPandas(run, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_answer_csv(result: DataFrame, question: str, sql: str, folder: str) -> str:
    """Result rows as CSV under a name made from the question, and an audit row. Returns the path."""
    spark: SparkSession = result.sparkSession
    named = spark.range(1).select(ct.answer_file_stem(F.lit(question)).alias("stem"), F.left(F.sha2(F.lit(sql), 256), F.lit(12)).alias("sql"))
    row = named.first()
    path = f"{folder.rstrip('/')}/{row.stem}_{row.sql}"
    # Counted in the write itself: a cell with line breaks is one row, however it is printed.
    seen = Observation()
    result.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    rows = seen.get["n"]
    audit = spark.range(1).select(
        F.lit(question).alias("question"), F.lit(sql).alias("sql"), F.lit(path).alias("csv_path"),
        F.lit(rows).cast("bigint").alias("n_rows"),
    )
    audit.write.mode("append").json(f"{folder.rstrip('/')}/audit")
    return path
