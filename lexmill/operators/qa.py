"""Question-answer records and continued ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_blank, qa_text, trim_all
from lexmill.operators.prefix import running


def build_qa(df: DataFrame, existing: DataFrame | None = None, order: str = "line_no") -> DataFrame:
    """(order, id, split, language, domain, topic, question, answer, text) from questions and answers, in order, each text once.

    Blank questions or answers are skipped; the text is the given one as it stands, or the template's; a text that stands
    in `existing` (text) or before is skipped. Where the value is missing (null; not where it is empty) the language is
    zh, the split train, domain and topic general; the language is cut to two lower-case letters after the template.
    The id is the given one, or qa-<language>-<e + 2k + 1> with e distinct texts existing and k records added before.
    """
    col = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    q, a = trim_all(F.col("question")), trim_all(F.col("answer"))
    or_ = lambda n, v: F.coalesce(col(n), F.lit(v))
    d = df.select(
        F.col(order), q.alias("question"), a.alias("answer"), or_("language", "zh").alias("l"), col("id").alias("given_id"), or_("split", "train").alias("split"),
        or_("domain", "general").alias("domain"), or_("topic", "general").alias("topic"), F.nullif(col("text"), F.lit("")).alias("given"),
    )
    d = d.where(~is_blank(F.col("question")) & ~is_blank(F.col("answer"))).withColumn("text", F.coalesce("given", qa_text(F.col("question"), F.col("answer"), F.col("l"))))
    e = 0
    if existing is not None:
        old = existing.select("text").distinct()
        e = old.count()
        d = d.join(old, "text", "left_anti")
    firsts = d.groupBy("text").agg(F.min(order).alias("_first"))
    d = d.join(firsts.withColumnRenamed("text", "_t"), (F.col("text") == F.col("_t")) & (F.col(order) == F.col("_first")), "left_semi")
    d = running(d, order, F.lit(1), "k")
    two = F.lower(F.substring("l", 1, 2))
    made = F.format_string("qa-%s-%04d", two, F.lit(e) + 2 * F.col("k") + 1)
    return d.select(order, F.coalesce(F.nullif("given_id", F.lit("")), made).alias("id"), "split", two.alias("language"), "domain", "topic", "question", "answer", "text")


def continue_ids(new: DataFrame, existing: DataFrame, prefix: str, order: str, width: int = 6, id_col: str = "id") -> DataFrame:
    """new with ids that go on after the largest number among the existing ids of the prefix."""
    number = F.regexp_extract(id_col, rf"^{prefix}-(\d+)$", 1)
    last = existing.select(F.when(number != "", number.cast("long")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    d = running(new.drop(id_col), order, F.lit(1), "_k")
    return d.withColumn(id_col, F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("_k") + last + 1).cast("string"), width, "0"))).drop("_k")


def assemble(catalog: DataFrame, chunks: str = "chunks", language: str = "en", split: str = "train") -> DataFrame:
    """One record per chunk of a source (id, title, url, source, domain, topic, chunks), with id <source id>-<2 digits>."""
    d = catalog.select("*", F.posexplode(chunks).alias("_p", "text"))
    return d.select(
        F.format_string("%s-%02d", "id", F.col("_p") + 1).alias("id"), F.lit(split).alias("split"), F.lit(language).alias("language"), "domain", "topic", "text", "source",
        F.col("url").alias("source_url"), F.col("title").alias("source_title"), (F.col("_p") + 1).alias("chunk_index"),
    )
