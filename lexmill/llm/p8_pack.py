"""Problem 8: whole documents packed into containers of fixed capacity.

Bounded-space online best fit: a fixed number of bins is open, held in lists by free space with a bitset of the free
spaces that occur, so the tightest bin that still takes an item is one shift and one bit trick away. If nothing fits
and all bins are in use, the fullest one closes. The items of bins still open at the end of a partition are packed
once more, many partitions to a task and larger items first.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import spread, table, tokenizer_path, written

CAPACITY, OPEN_BINS, FAN_IN = 1024, 256, 32
#: How the byte-pair tokenizer splits a text before its merges (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class OpenBins:
    """The open bins of one task: by free space, with a bitset over the free spaces."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n, self.bits = capacity, most, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, size: int) -> int | None:
        """The bin of least free space >= size, taken out; None if there is none."""
        fits = self.bits >> size
        return None if not fits else self._pop(size + (fits & -fits).bit_length() - 1)[0]

    def _pop(self, free: int) -> tuple[int, int]:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n -= 1
        return b, free

    def put(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.bits |= 1 << free
        self.n += 1

    def close_fullest(self) -> tuple[int, int]:
        return self._pop((self.bits & -self.bits).bit_length() - 1)

    def rest(self) -> Iterator[tuple[int, int]]:
        while self.n:
            yield self.close_fullest()


class Packer:
    """Gives each item a bin; free has the free space of the open bins, closed of those closed since it was last cleared."""

    def __init__(self, capacity: int, most: int):
        self.bins, self.next, self.free, self.closed = OpenBins(capacity, most), 0, {}, {}

    def add(self, size: int) -> int:
        b = self.bins.take(size)
        if b is None:
            if self.bins.n >= self.bins.most:
                c, free = self.bins.close_fullest()
                self.closed[c] = free
                self.free.pop(c)
            b, self.next = self.next, self.next + 1
            self.free[b] = self.bins.capacity
        self.free[b] -= size
        if self.free[b]:
            self.bins.put(b, self.free[b])
        else:
            self.closed[b] = self.free.pop(b)
        return b


#: A tokenizer's file may be sent to the workers up to this size.
MAX_FILE = 64 << 20


def tokenizer_file(path: str) -> bytes:
    """The rank file of a public tokenizer, read on the driver."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no tokenizer at {path}")
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    with open(path, "rb") as f:
        return f.read()


def tokenizer(raw: bytes):
    """The public tokenizer of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, piece_no, first_token, size): one row per document that fits, else one per piece of at most `capacity` tokens.

    A null text has no row, an empty one a row of size 0. Pieces follow each other and cover all tokens.
    """
    sent = df.sparkSession.sparkContext.broadcast(tokenizer_file(path or tokenizer_path()))
    kept: dict[str, object] = {}
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = kept["t"] if "t" in kept else kept.setdefault("t", tokenizer(sent.value))
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                n = len(enc.encode_ordinary(t))
                rows += [(i, k + 1, a, min(capacity, n - a)) for k, a in enumerate(range(0, max(n, 1), capacity))]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "first_token", "size"]).astype({"id": "Int64"})

    return spread(df).mapInPandas(sizes, "id long, piece_no int, first_token int, size int")


ITEM = "id long, piece_no int, first_token int, size int"
PLACED = ITEM + ", container long, fill int"
COLUMNS = ["id", "piece_no", "first_token", "size", "container", "fill"]


def _pack_rows(batches: Iterator[pd.DataFrame], capacity: int, open_bins: int, base: int, last: bool) -> Iterator[pd.DataFrame]:
    """The items with their container as soon as it closes; at the end those of the bins still open, without container unless `last`."""
    p, held = Packer(capacity, open_bins), {}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=COLUMNS).astype({"id": "Int64", "container": "Int64", "fill": "Int64"})

    for pdf in batches:
        out = []
        for row in zip(*(pdf[c] for c in COLUMNS[:4])):
            size = row[3]
            if not 0 <= size <= capacity:
                raise ValueError(f"an item of size {size} is outside 0..{capacity}")
            held.setdefault(p.add(int(size)), []).append(row)
            for b, free in p.closed.items():
                out += [(*r, base + b, capacity - free) for r in held.pop(b)]
            p.closed.clear()
        yield frame(out)
    left = [(b, capacity - free) for b, free in p.bins.rest()]
    yield frame([(*r, base + b if last else None, fill if last else None) for b, fill in left for r in held.pop(b)])


def pack_items(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """items (id, piece_no, first_token, size) with their container and the container's fill.

    container is unique over all partitions. No item is dropped: a size outside 0..capacity is an error. Empty table:
    no rows; repeated rows are items of their own. The items of bins still open at the end of a partition, at most
    open_bins of them, are packed again by larger size first, FAN_IN partitions to a task; nothing else is moved.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _pack_rows(batches, capacity, open_bins, TaskContext.get().partitionId() << 32, False)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _pack_rows(batches, capacity, open_bins * FAN_IN, (1 << 62) + (TaskContext.get().partitionId() << 32), True)

    items = items.select(*COLUMNS[:4])
    one = written(items.mapInPandas(first, PLACED))
    n = max(1, -(-len(one.inputFiles()) // FAN_IN))  # a file per partition
    rest = one.where(F.col("container").isNull()).select(*COLUMNS[:4]).repartition(n, "id", "piece_no").sortWithinPartitions(F.desc("size"), "id", "piece_no")
    return one.where(F.col("container").isNotNull()).unionByName(rest.mapInPandas(again, PLACED))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = sized(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pack_items(items).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, items and tokens by tenths of the fill, and the share of space used."""
    df = p8_containers(spark, sf_dir).groupBy("container").agg(F.first("fill").alias("fill"), F.count("*").alias("k"))
    tenth = F.least(F.lit(9), F.floor(F.col("fill") * 10 / CAPACITY)).alias("tenth")
    return df.groupBy(tenth).agg(F.count("*").alias("n_containers"), F.sum("k").alias("n_items"), F.sum("fill").alias("n_tokens"), (F.sum("fill") / (F.count("*") * CAPACITY)).alias("used"))
