"""Readers of memory in text form: markdown sections, annotated context lines and tool transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(files: DataFrame, mark: str = "§") -> DataFrame:
    """``id``, ``section``, ``subject`` and ``body`` of the sections of ``files`` (id, text) between marks.

    The subject is what stands before the first colon of the first line, else its first five words. Empty sections and
    null texts give no rows.
    """
    parts = files.select("id", F.posexplode(F.split("text", mark)).alias("section", "raw")).withColumn("body", F.trim("raw")).where("body <> ''")
    line = F.split("body", "\n")[0]
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    subject = F.when(line.contains(":"), F.trim(F.substring_index(line, ":", 1))).otherwise(F.array_join(F.slice(words, 1, 5), " "))
    return parts.select("id", "section", subject.alias("subject"), "body")


def context_lines(texts: DataFrame, pattern: str = r"^\[([0-9-]+)\] \(([0-9.]+)\) (.*)$") -> DataFrame:
    """Records of texts (id, text) in which a line with a date and an importance begins a record and other lines go on
    with the one before; a text without such a line is one record. Columns: id, record, day, importance, body."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    head = F.regexp_extract("line", pattern, 1)
    w = Window.partitionBy("id").orderBy("n")
    numbered = lines.withColumn("day", F.when(head != "", head)).withColumn("record", F.sum(F.when(head != "", 1).otherwise(0)).over(w))
    rest = F.when(F.col("day").isNotNull(), F.regexp_extract("line", pattern, 3)).otherwise(F.col("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", rest.alias("t")))), lambda x: x["t"]), "\n")
    weight = F.max(F.when(F.col("day").isNotNull(), F.regexp_extract("line", pattern, 2).cast("double")))
    return numbered.groupBy("id", "record").agg(F.max("day").alias("day"), weight.alias("importance"), body.alias("body"))


def tool_steps(messages: DataFrame) -> DataFrame:
    """Steps of transcripts (session, seq, role, call_id, tool, output, is_error, exit_code): each call with its result,
    by call id, and whether it succeeded: the error flag, then the exit code, else a result that isn't empty."""
    calls = messages.where("role = 'call'").select("session", "seq", "call_id", "tool")
    results = messages.where("role = 'result'").groupBy("session", "call_id").agg(F.min(F.struct("seq", "output", "is_error", "exit_code")).alias("r"))
    joined = calls.join(results, ["session", "call_id"], "left").select("session", "seq", "tool", "r.output", "r.is_error", "r.exit_code")
    ok = F.when(F.col("is_error").isNotNull(), ~F.col("is_error")).when(F.col("exit_code").isNotNull(), F.col("exit_code") == 0).otherwise(F.coalesce(F.trim("output"), F.lit("")) != "")
    return joined.select("session", "seq", "tool", ok.alias("success"))
