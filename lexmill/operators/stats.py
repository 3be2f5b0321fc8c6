"""Counts, manifests and loss metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_stats(df: DataFrame, tokens: Column, by: list[str], text_col: str = "text") -> DataFrame:
    """Documents, characters, tokens and mean tokens per group (0 without documents); `tokens` is a count."""
    t = F.coalesce(tokens, F.lit(0))
    return df.groupBy(*by).agg(
        F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length(text_col), F.lit(0))).alias("n_chars"), F.sum(t).alias("n_tokens"), F.avg(t).alias("mean_tokens"),
    )


def corpus_totals(df: DataFrame, tokens: Column, text_col: str = "text") -> DataFrame:
    """One row: documents, characters, tokens, exact distinct tokens and the two means; `tokens` is an array.

    Distinct tokens are counted from the table of token counts, so a common token is one row per task.
    """
    d = df.select(F.length(text_col).alias("c"), tokens.alias("t"))
    sums = d.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n_tokens"))
    kinds = d.select(F.explode("t").alias("w")).groupBy("w").count().agg(F.count("*").alias("n_distinct"))
    mean = lambda x: F.when(F.col("n_docs") > 0, F.col(x) / F.col("n_docs")).otherwise(0.0)
    return sums.crossJoin(kinds).select("n_docs", "n_chars", "n_tokens", "n_distinct", mean("n_chars").alias("mean_chars"), mean("n_tokens").alias("mean_tokens"))  # one row each


def coverage(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Rows per group and how many of them have each field."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), *[F.count(f).alias(f"has_{f}") for f in fields])


def flag_counts(df: DataFrame, flags: str = "flags") -> DataFrame:
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n_rows"))


def change_counts(df: DataFrame, by: str, changes: Column) -> DataFrame:
    """Rows with changes and the number of changes per group."""
    return df.groupBy(by).agg(F.count_if(changes > 0).alias("n_changed"), F.coalesce(F.sum(changes), F.lit(0)).alias("n_changes"))


def value_counts(df: DataFrame, by: str = "source_title") -> DataFrame:
    """Rows per value, most frequent first, ties by value; null is a value of its own, at the end of its ties."""
    return df.groupBy(by).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), F.asc_nulls_last(by))


def manifest(df: DataFrame, file: str, tokens: Column, hashes: DataFrame | None = None) -> DataFrame:
    """(file, n_records, n_tokens) per file; with hashes (name, sha256) also the sha256 of each file, null for one without."""
    m = df.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("n_records"), F.sum(F.coalesce(tokens, F.lit(0))).alias("n_tokens"))
    return m if hashes is None else m.join(hashes.select(F.col("name").alias("file"), "sha256"), "file", "left")


def manifest_totals(files: DataFrame) -> DataFrame:
    """One row: files, records and tokens of a manifest."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))


def manifest_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, d_records, d_tokens): what changed per file; a missing file counts as empty."""
    b = before.select(F.col("file").alias("f0"), F.col("n_records").alias("r0"), F.col("n_tokens").alias("t0"))
    a = after.select(F.col("file").alias("f1"), F.col("n_records").alias("r1"), F.col("n_tokens").alias("t1"))
    z = lambda x: F.coalesce(x, F.lit(0))
    return b.join(a, b["f0"].eqNullSafe(a["f1"]), "full").select(F.coalesce("f0", "f1").alias("file"), (z("r1") - z("r0")).alias("d_records"), (z("t1") - z("t0")).alias("d_tokens"))


def weighted_loss(blocks: DataFrame, by: list[str], loss: str = "loss", size: str = "size", strict: bool = False) -> DataFrame:
    """Token-weighted mean loss and perplexity of blocks; a block of n tokens predicts n - 1, shorter than two none.

    Without tokens both are 0, or an error if strict (of a training run, where a loss of 100 or more has an infinite perplexity).
    """
    d = blocks.where(F.col(size) >= 2).withColumn("_v", F.col(size) - 1)
    g = d.groupBy(*by).agg(F.sum(F.col(loss) * F.col("_v")).alias("_s"), F.sum("_v").alias("n_tokens"))
    if by:
        g = blocks.select(*by).distinct().join(g, by, "left")
    none = F.coalesce(F.col("n_tokens"), F.lit(0)) == 0
    zero = F.raise_error(F.lit("no tokens to evaluate")).cast("double") if strict else F.lit(0.0)
    g = g.withColumn("mean_loss", F.when(none, zero).otherwise(F.col("_s") / F.col("n_tokens")))
    ppl = F.when(none, F.lit(0.0)).otherwise(F.exp("mean_loss"))
    if strict:
        ppl = F.when(F.col("mean_loss") >= 100, F.lit(float("inf"))).otherwise(F.exp("mean_loss"))
    return g.select(*by, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "mean_loss", ppl.alias("perplexity"))


def overall_loss(parts: DataFrame) -> DataFrame:
    """One row from rows with n_tokens and mean_loss, weighted by tokens."""
    g = parts.agg(F.sum(F.col("mean_loss") * F.col("n_tokens")).alias("s"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    mean = F.when(F.col("n_tokens") > 0, F.col("s") / F.col("n_tokens")).otherwise(0.0)
    return g.select("n_tokens", mean.alias("mean_loss"), F.when(F.col("n_tokens") > 0, F.exp(mean)).otherwise(0.0).alias("perplexity"))


def early_stopping(losses: DataFrame, min_improvement: float = 0.0, patience: int = 3) -> DataFrame:
    """losses (run, epoch, eval_loss) with best, improved, waited and stopped.

    An epoch improves if it is more than min_improvement below the best so far; after `patience` epochs without one the
    run stops, and later epochs are left out. One array per run: a run has few epochs. Null losses never improve.
    """
    start = "named_struct('best', double('inf'), 'waited', 0, 'out', array())"
    typed = "cast(array() AS array<struct<epoch:bigint,eval_loss:double,best:double,improved:boolean,waited:int,stopped:boolean>>)"
    start = start.replace("array()", typed)
    better = f"(x.eval_loss IS NOT NULL AND s.best - x.eval_loss > {float(min_improvement)}D)"
    step = f"""aggregate(rows, {start}, (s, x) -> if(size(s.out) > 0 AND element_at(s.out, -1).stopped, s, named_struct(
        'best', if({better}, x.eval_loss, s.best), 'waited', if({better}, 0, s.waited + 1),
        'out', array_append(s.out, named_struct('epoch', x.epoch, 'eval_loss', x.eval_loss, 'best', if({better}, x.eval_loss, s.best), 'improved', {better},
               'waited', if({better}, 0, s.waited + 1), 'stopped', if({better}, 0, s.waited + 1) >= {int(patience)})))), s -> s.out)"""
    g = losses.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("eval_loss").cast("double").alias("eval_loss")))).alias("rows"))
    return g.select("run", F.explode(F.expr(step)).alias("r")).select("run", "r.*")


def schedule(total_steps: int, warmup_ratio: float, base: float = 1.0) -> tuple[int, list[float]]:
    """(warm-up steps, factor of every step): linear warm-up, then half a cosine."""
    import math

    warm = int(total_steps * warmup_ratio)
    return warm, [base * (k / max(1, warm) if k < warm else 0.5 * (1 + math.cos(math.pi * (k - warm) / max(1, total_steps - warm)))) for k in range(total_steps)]
