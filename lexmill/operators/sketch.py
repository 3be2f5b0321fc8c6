"""Counters of fixed size over the elements of arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters by the element's hash: what reaches the driver and the workers has this size however large the table is.
WIDTH = 1 << 20
#: Marks of the rows that a smaller table names, a bit each.
MARKS = 1 << 23
#: Counters that a task passes on as one value.
BLOCK = 1 << 14
#: Arrays that are counted at once.
AT_ONCE = 1_000
#: Sets of so many elements get parity bits in proportion to their size.
WIDE = 256


@dataclass
class Sets:
    """Sets that are made in Python of columns (name -> Column), where they are needed; none passes through the JVM. With
    exact, its sets decide on a pair, and those of make, which are as similar but cheaper, find it."""

    columns: dict[str, Column]
    make: Callable[[pd.DataFrame], list[np.ndarray | None]]
    exact: Callable[[pd.DataFrame], list[np.ndarray | None]] | None = None

    @staticmethod
    def of(sig: Column | Sets) -> Sets:
        """Those of a Column of arrays as they are."""
        return sig if isinstance(sig, Sets) else Sets({"sig": sig}, lambda pdf: pdf["sig"].tolist())

    def select(self, df: DataFrame) -> DataFrame:
        """(node, language, ...): what the sets of df are made of."""
        return df.select("node", "language", *[c.alias(f"_{k}") for k, c in self.columns.items()])

    def maker(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[tuple[pd.DataFrame, list[np.ndarray | None]]]]:
        """For mapInPandas over `select`: the rows, AT_ONCE at a time, with their sets."""
        make = self.make

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray | None]]]:
            for pdf in batches:
                for i in range(0, len(pdf), AT_ONCE):
                    x = pdf[i : i + AT_ONCE]
                    yield x, make(x.rename(columns=lambda c: c[1:] if c.startswith("_") else c))

        return parts


def places(elements: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The counter of each 64-bit element."""
    return (elements.view(np.uint64) % np.uint64(width)).astype(np.int64)


def _add(n: np.ndarray, arrays: list[np.ndarray | None]) -> None:
    some = [x for x in arrays if x is not None and len(x)]
    if some:
        np.add.at(n, places(np.concatenate(some).astype(np.int64, copy=False), len(n)), 1)


def _blocks(n: np.ndarray, block: int) -> pd.DataFrame:
    """(block, n): the blocks of a task's counters that aren't empty."""
    some = np.flatnonzero(n.reshape(-1, block).any(axis=1))
    return pd.DataFrame({"block": some.astype(np.int32), "n": [zlib.compress(n[b * block : (b + 1) * block].tobytes(), 1) for b in some]})


def _summed(blocks: DataFrame, width: int, block: int) -> np.ndarray:
    """The sum of all tasks' counters (block, n)."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(block, np.int64)
        for x in pdf["n"]:
            n += np.frombuffer(zlib.decompress(x), np.int64)
        return pd.DataFrame({"block": pdf["block"][:1], "n": [zlib.compress(np.minimum(n, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    out = np.zeros(width, np.int32)
    for r in blocks.groupBy("block").applyInPandas(total, "block int, n binary").collect():  # at most width / block rows
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(r["n"]), np.int32)
    return out


def counts(arrays: DataFrame, width: int = WIDTH) -> np.ndarray:
    """About how often each element of the arrays in the one column occurs, never too few; null arrays hold none.

    A task counts into an array of fixed size and passes on the blocks of it that aren't empty.
    """
    name, block = arrays.columns[0], math.gcd(width, BLOCK)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(width, np.int64)
        for pdf in (x[i : i + AT_ONCE] for x in batches for i in range(0, len(x), AT_ONCE)):
            _add(n, pdf[name].tolist())
        yield _blocks(n, block)

    # few tasks, for each may pass on as many places as there are; nothing is moved for it
    return _summed(arrays.coalesce(arrays.sparkSession.sparkContext.defaultParallelism).mapInPandas(count, "block int, n binary"), width, block)


def surveyed(df: DataFrame, sets: Sets, written: Callable[[DataFrame], DataFrame], width: int = WIDTH) -> tuple[np.ndarray, DataFrame]:
    """What `counts` says of df's sets, and (node, n, bits) of those of WIDE elements or more, n of them: bits are their
    wide_parities. One pass."""
    parts, block = sets.maker(), math.gcd(width, BLOCK)

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(width, np.int64)
        for pdf, made in parts(batches):
            _add(n, made)
            big = [(k, len(x), wide_parities(x)) for k, x in zip(pdf["node"], made) if x is not None and len(x) >= WIDE]
            if big:
                k, size, bits = zip(*big)
                yield pd.DataFrame({"block": np.full(len(k), -1, np.int32), "node": np.array(k, np.int64), "n": np.array(size, np.int32), "bits": bits})
        x = _blocks(n, block)
        yield pd.DataFrame({"block": x["block"], "node": np.int64(0), "n": np.int32(0), "bits": x["n"]})

    few = 2 * df.sparkSession.sparkContext.defaultParallelism  # a task may pass on as many places as there are
    got = written(sets.select(df).coalesce(few).mapInPandas(survey, "block int, node long, n int, bits binary"))
    return _summed(got.where("block >= 0").select("block", F.col("bits").alias("n")), width, block), got.where("block < 0").select("node", "n", "bits")


def rare_first(sizes: np.ndarray, flat: np.ndarray, count: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, element, place) of the first `take` elements of each record in one order for all: those that occur once,
    then rarer before more frequent ones. Those that occur once use up their places but are left out: nothing shares them."""
    rec, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    c = count[places(flat, len(count))]
    often = np.where(c > 1, c, 0)
    if len(flat) and ((flat[1:] > flat[:-1]) | (rec[1:] > rec[:-1])).all():  # sets that are sorted already: by count and place, a set at a time
        key, at = often.astype(np.int64) << 32 | np.arange(len(flat)) - np.repeat(ends - sizes, sizes), ends - sizes
        some = [np.sort(key[i : i + n])[: max(k, 0)] for i, n, k in zip(at.tolist(), sizes.tolist(), take.tolist())]
        got = np.fromiter(map(len, some), np.int64, len(some))
        first, rec = np.concatenate(some), np.repeat(np.arange(len(some)), got)
        place, keep = np.arange(len(first)) - np.repeat(np.cumsum(got) - got, got), first >> 32 > 0
        return rec[keep], flat[at[rec] + (first & 0xFFFFFFFF)][keep], place[keep]
    order = np.lexsort((flat, often, rec))
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    keep = (place < np.repeat(take, sizes)) & (often[order] > 0)
    return rec[keep], flat[order][keep], place[keep]


def parities(sizes: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    """256 bits of each set, none empty, as four words: bit i is the parity of the number of its elements that fall to i.
    Two sets' bits differ in at most as many places as there are elements in only one; so do the words folded into one."""
    place = (flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    bit, word, at = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6), np.cumsum(sizes) - sizes
    return [np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at).view(np.int64) if len(sizes) else np.zeros(0, np.int64) for w in range(4)]


def wide_parities(elements: np.ndarray) -> bytes:
    """Parity bits like those of `parities`, more than half as many as there are elements (a power of two)."""
    m = 1 << min(len(elements).bit_length() - 1, 22)
    place = (elements.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return np.packbits((np.bincount((place & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(bool)).tobytes()


def parities_differ(a: bytes, b: bytes) -> int:
    """In how many places two wide_parities differ; the longer is folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def among(df: DataFrame, nodes: DataFrame, inside: bool = True) -> DataFrame:
    """df's rows whose `node` is in the one column of nodes, or with inside=False those whose isn't; exact.

    Marks of fixed size tell which rows may be in nodes; only those are shuffled, with the columns that are used later.
    """
    marked = counts(nodes.select(F.array(F.col(nodes.columns[0]).cast("long")).alias("x")), MARKS) > 0
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(marked))

    @F.pandas_udf("boolean")
    def maybe(node: pd.Series) -> pd.Series:
        at = places(node.fillna(0).to_numpy(np.int64), MARKS)
        return pd.Series((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    other = nodes.select(F.col(nodes.columns[0]).alias("_in"))
    if inside:
        return df.where(maybe("node")).join(other, F.col("node") == F.col("_in"), "left_semi")
    return df.where(~maybe("node")).unionByName(df.where(maybe("node")).join(other, F.col("node") == F.col("_in"), "left_anti"))
