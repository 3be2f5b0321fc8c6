"""Review sheets: written as Markdown blocks, read back as counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The choices of a reviewer, in the order of the sheet.
CHOICES = ("pass", "modify", "delete")


def review_sheet(df: DataFrame, fields: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, block): one Markdown block per record with its fields, the text and a box for each choice."""
    rows = [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    boxes = F.lit("  ".join(f"[ ] {c}" for c in CHOICES))
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col(id_col)), *rows, F.lit(""), F.coalesce(text_col, F.lit("")), F.lit(""), boxes)
    return df.select(F.col(id_col).alias("id"), block.alias("block"))


def review_results(blocks: DataFrame, block: str = "block") -> DataFrame:
    """(choice, n) from filled sheets; a block without exactly one mark counts as open."""
    marks = F.regexp_extract_all(block, F.lit(r"\[[xX]\] (\w+)"), F.lit(1))
    choice = F.when((F.size(marks) == 1) & F.array_contains(F.array(*[F.lit(c) for c in CHOICES]), marks[0]), marks[0]).otherwise("open")
    return blocks.groupBy(choice.alias("choice")).agg(F.count("*").alias("n"))
