"""Token streams and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.prefix import running


def stream(df: DataFrame, tokens: Column, eos: int, order: str) -> DataFrame:
    """(order, offset, tokens): each document's tokens with the end token, and where they begin in the whole stream.

    Documents follow each other in `order` (unique). A null document gives just the end token.
    """
    t = F.concat(F.coalesce(tokens, F.array().cast("array<int>")), F.array(F.lit(eos)))
    return running(df.select(F.col(order), t.alias("tokens")), order, F.size("tokens"), "offset")


def blocks(streamed: DataFrame, size: int, strict: bool = True) -> DataFrame:
    """(block, tokens): non-overlapping blocks of the stream, the tail dropped.

    Only the pieces of documents that fall into a block are moved, not single tokens. A stream shorter than a block is an
    error, or no block if not strict.
    """
    if size < 1:
        raise ValueError("size must be positive")
    n = streamed.agg(F.coalesce(F.max(F.col("offset") + F.size("tokens")), F.lit(0))).first()[0]
    if n < size and strict:
        raise ValueError(f"{n} tokens are fewer than a block of {size}")
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.size("tokens") - 1) / size)
    d = streamed.select("offset", "tokens", F.explode(F.sequence(first, last)).alias("block")).where(F.col("block") < n // size)
    at = F.greatest(F.lit(0), F.col("block") * size - F.col("offset"))
    end = F.least(F.size("tokens"), (F.col("block") + 1) * size - F.col("offset"))
    part = d.select("block", "offset", F.slice("tokens", (at + 1).cast("int"), (end - at).cast("int")).alias("part"))
    g = part.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("offset", "part"))).alias("x"))  # at most `size` tokens
    return g.select("block", F.flatten(F.transform("x", lambda y: y["part"])).alias("tokens"))


def eval_blocks(df: DataFrame, tokens: Column, size: int) -> DataFrame:
    """df's rows per document block (block_no from 0, block), the short tail included; blocks and documents under two tokens are left out."""
    d = df.withColumn("_t", tokens).where(F.size("_t") >= 2)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_t") - 1) / size).cast("int")), lambda i: F.slice("_t", (i * size + 1).cast("int"), size))
    return d.select(*df.columns, F.posexplode(cut).alias("block_no", "block")).where(F.size("block") >= 2)


def block_size(preferred: int, n_tokens: int) -> int:
    if n_tokens < 4:
        raise ValueError("fewer than four tokens")
    return min(preferred, n_tokens)


def truncate_prompt(tokens: Column, context: int) -> Column:
    """The last tokens that fit the context; at least one place stays free for what follows."""
    keep = max(1, context - 1)
    return F.slice(tokens, F.greatest(F.size(tokens) - keep + 1, F.lit(1)).cast("int"), keep)


def new_token_budget(prompt_size: Column, context: int, most: int) -> Column:
    """How many tokens may be generated; null (skipped) if there is no room."""
    room = F.least(F.lit(most), F.lit(context) - prompt_size)
    return F.when(room > 0, room)


def windows(streamed: DataFrame, starts: DataFrame, size: int) -> DataFrame:
    """(sample, tokens) of windows (sample, start) over the stream; each takes its parts from the blocks it touches."""
    whole = streamed.select("offset", "tokens", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.size("tokens") - 1) / size))).alias("cell"))
    # of each document only the part inside the cell moves
    begin = F.greatest(F.col("offset"), F.col("cell") * size)
    end = F.least(F.col("offset") + F.size("tokens"), (F.col("cell") + 1) * size)
    whole = whole.select("cell", begin.alias("offset"), F.slice("tokens", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int")).alias("tokens"))
    s = starts.select("sample", "start", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + size - 1) / size))).alias("cell"))
    d = s.join(whole, "cell")
    lo = F.greatest("start", F.col("cell") * size, "offset")
    hi = F.least(F.col("start") + size, (F.col("cell") + 1) * size, F.col("offset") + F.size("tokens"))
    d = d.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo")
    part = d.select("sample", "lo", F.slice("tokens", (F.col("lo") - F.col("offset") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("part"))
    g = part.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("x"))  # `size` tokens
    return g.select("sample", F.flatten(F.transform("x", lambda y: y["part"])).alias("tokens"))
