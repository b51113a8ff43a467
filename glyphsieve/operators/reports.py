"""Reports as lines of text: Markdown tables, CSV cells and plain listings. Reports are of aggregates, a row per variant or strategy."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StringType

from . import audit

MISSING = "—"


def _digits(c: Column) -> Column:
    """Rounds the double itself, ties to even; Java's formats round its shortest decimal text, so that 0.16135 would go up."""

    @F.arrow_udf("string")
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.4f}" if abs(v) < 10 else f"{v:.1f}" for v in values.to_pylist()], pa.string())

    return shown(c.cast("double"))


def markdown_value(rows: DataFrame, name: str) -> Column:
    """Four digits behind the point below ten, one above; a dash for null."""
    c, kind = F.col(name), rows.schema[name].dataType
    if isinstance(kind, (DoubleType, FloatType)):
        shown = _digits(c)
    else:
        shown = F.replace(c.cast("string"), F.lit("|"), F.lit("\\|"))
    return F.when(c.isNull(), MISSING).otherwise(shown)


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(value)``: a table line per row."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_value(rows, c) for c in columns]), F.lit(" |")).alias("value"))


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> list[str]:
    """Head and lines of a small table, for the driver."""
    lines = rows.orderBy(order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_value(rows, c) for c in columns]), F.lit(" |")).alias("value"))
    return [f"| {' | '.join(columns)} |", "|" + " --- |" * len(columns), *(r["value"] for r in lines.collect())]


def csv_cell(rows: DataFrame, name: str) -> Column:
    """Nothing for null, 1 or 0 for booleans, quotes where a text needs them."""
    c, kind = F.col(name), rows.schema[name].dataType
    if isinstance(kind, BooleanType):
        return F.coalesce(c.cast("int").cast("string"), F.lit(""))
    text = c.cast("string")
    if isinstance(kind, StringType):
        text = F.when(F.regexp_like(text, F.lit(r'[",\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.coalesce(text, F.lit(""))


def csv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(value)``: a line per row, without the head."""
    return rows.select(F.concat_ws(",", *[csv_cell(rows, c) for c in columns]).alias("value"))


def steps(parts: str) -> Column:
    """A strategy's ``array<struct<tactic,intensity>>`` as ``tactic(intensity) -> ...``; intensity is left out where it is null."""
    return F.array_join(F.transform(parts, lambda s: F.concat(s["tactic"], F.when(s["intensity"].isNull(), "").otherwise(F.concat(F.lit("("), s["intensity"].cast("string"), F.lit(")"))))), " -> ")


def finding_lines(items: DataFrame) -> DataFrame:
    """``(path, value)``: a listing's line per finding."""
    one = items.select("path", F.explode(F.arrays_zip("findings", "confidence")).alias("f"))
    return one.select("path", F.concat(F.lit("  ["), F.col("f.confidence"), F.lit("] "), "path", F.lit(": "), F.col("f.findings")).alias("value"))


def summary_lines(items: DataFrame) -> DataFrame:
    """``(position, value)``: the head of a listing."""
    s = audit.summary(items)
    shown = [("Files scanned", "read"), ("Files unrecognized", "unrecognized"), ("With C2PA", "with_c2pa"), ("With AI metadata", "with_ai_metadata"), ("With suspicious text", "with_suspicious_text"), ("Actionable files", "actionable_files")]
    lines = F.array(*[F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for label, c in shown])
    return s.select(F.posexplode(lines).alias("position", "value"))
