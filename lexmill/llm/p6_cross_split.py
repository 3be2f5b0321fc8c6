"""Problem 6: the same or nearly the same records across splits.

Records become sequences of words (letter case, blanks and punctuation ignored). Overlap fractions against the whole of
train come from content-defined chunks: a rolling hash over two words decides where to cut, so a change moves only the
cuts next to it, and the lengths of chunks that stand on both sides are summed. Chunks can't find all pairs: every fifth
word may differ, and then no chunk of two words is sure to be shared. So pairs are searched by single words, with exact
prefix filtering: two records that have enough words in common share one of the first few of each in any fixed order of
all words, rare ones first; only those are joined across the splits. Bitmaps of all words drop most of the pairs, and
the longest common subsequence of words decides the rest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import WordCodes, norm_split, slice_name, spread, table, written

#: Share of the longer text's words that both must have in order.
ALIKE = 0.8
#: A cut follows one of so many word pairs; no chunk is shorter than SHORTEST or longer than LONGEST words.
DIVISOR, SHORTEST, LONGEST = 2, 2, 8
#: Longs in the bitmap of a record's words.
LONGS = 3
#: Counters of the words of each side, by hash: what is sent to the workers has this size however large the tables are.
WIDTH = 1 << 20
#: Words kept by a worker with their hashes, at most; others are hashed again.
CACHE = 500_000
#: Records whose words are handled as arrays at once.
AT_ONCE = 5_000

WORDS = re.compile(r"[^\W_]+")


class Chunker:
    """Cuts the words of a text into chunks and digests pairs of adjacent chunks."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, text: str) -> np.ndarray:
        """One 64-bit hash per word."""
        known, out = self.known, []
        for w in WORDS.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                if len(known) < CACHE:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    def cuts(self, code: np.ndarray) -> list[int]:
        """Ends of the chunks; the last is the number of words."""
        n = len(code)
        if not n:
            return [0]
        with np.errstate(over="ignore"):
            mix = code[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (code[1:] >> np.uint64(7))
        mark = np.flatnonzero(mix % np.uint64(DIVISOR) == 0) + 2  # a cut stands after the second word
        out, at = [], 0
        for m in [*mark.tolist(), n]:
            while m - at > LONGEST:
                at += LONGEST
                out.append(at)
            if m - at >= SHORTEST and n - m >= SHORTEST or m == n:
                out.append(m)
                at = m
        return list(dict.fromkeys(out))

    def digests(self, code: np.ndarray) -> list[tuple[int, int]]:
        """(digest, words) of each pair of adjacent chunks; of a single chunk by itself."""
        ends = [0, *self.cuts(code)]
        spans = [(a, b) for a, b in zip(ends, ends[2:])] or [(0, len(code))]
        raw = code.tobytes()
        return [(xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) - (1 << 63), b - a) for a, b in spans if b > a]


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit per element of a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = at.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def sides(df: DataFrame, id_col: str, text_col: str, split_col: str) -> DataFrame:
    """(row, held, text); held is whether the split is valid or test. Null text, id or split is left out."""
    rows = df.select(F.col(id_col).cast("long").alias("row"), norm_split(F.col(split_col)).alias("s"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("row").isNotNull() & F.col("s").isNotNull() & F.col("text").isNotNull())
    return spread(rows).select("row", (F.col("s") != "train").alias("held"), "text")


def word_counts(rows: DataFrame, width: int = WIDTH) -> np.ndarray:
    """(2, width): about how often each word stands in train and in the held-out splits, by hash; never too few.

    A task counts into arrays of fixed size and passes on the places that aren't empty.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n = WordCodes(), np.zeros(2 * width, np.int64)
        for pdf in (x[i : i + AT_ONCE] for x in batches for i in range(0, len(x), AT_ONCE)):
            code, size = c.of(pdf["text"].tolist())
            side = np.repeat(pdf["held"].to_numpy(bool), size)
            at, k = np.unique((code % np.uint64(width)).astype(np.int64) + side * width, return_counts=True)
            n[at] += k
        n = n.reshape(2, width)
        side, at = np.nonzero(n)
        yield pd.DataFrame({"side": side.astype(np.int32), "at": at.astype(np.int32), "n": n[side, at]})

    total = rows.mapInPandas(count, "side int, at int, n long").groupBy("side", "at").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    out = np.zeros((2, width), np.int32)
    got = total.toPandas()  # at most 2 * width rows
    out[got["side"], got["at"]] = got["n"]
    return out


class Heads:
    """Of a batch of records the bitmaps of their words, and the first tokens of each in the order of all words.

    A token is a word with its count so far in the record, so repeated words are told apart. The order: words that the
    other side lacks, which can't be shared, then by how often both sides have them, then by token. So many tokens are
    taken that one must be shared with any record this much alike.
    """

    def __init__(self, code: np.ndarray, size: np.ndarray, held: np.ndarray, counts: np.ndarray, alike: float):
        """code: the words of all records, size: how many of them are each record's."""
        n = len(size)
        rec, ends = np.repeat(np.arange(n), size), np.cumsum(size)
        # the count so far of each word in its record
        order = np.lexsort((code, rec))
        new = np.ones(len(code), bool)
        new[1:] = (code[order][1:] != code[order][:-1]) | (rec[order][1:] != rec[order][:-1])
        at = np.arange(len(code))
        nth = np.empty(len(code), np.uint64)
        nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        with np.errstate(over="ignore"):
            token = code + nth * np.uint64(0x9E3779B97F4A7C15)
        bits = np.zeros((n, 64 * LONGS), bool)
        bits[rec, (token % np.uint64(64 * LONGS)).astype(np.int64)] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        cell = (code % np.uint64(counts.shape[1])).astype(np.int64)
        side = held.astype(np.int64)[rec]
        there = counts[1 - side, cell].astype(np.int64)
        often = np.where(there > 0, there + counts[side, cell], 0)
        order = np.lexsort((token, often, rec))
        passed = at - np.repeat(ends - size, size)  # words before, in the order
        taken = (passed < np.repeat(size - np.ceil(size * alike - 1e-9).astype(np.int64) + 1, size)) & (there[order] > 0)
        self.cut = np.cumsum(np.bincount(rec[taken], minlength=n))[:-1] if n else []
        # 32 bits tell tokens apart well enough for candidates
        self.tokens, self.passed = token[order][taken].astype(np.uint32).view(np.int32), passed[taken].astype(np.int32)

    def columns(self) -> dict[str, list]:
        return {"tokens": np.split(self.tokens, self.cut), "passed": np.split(self.passed, self.cut)} | {f"b{i}": self.bits[:, i] for i in range(LONGS)}


def cross_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split", alike: float = ALIKE, width: int = WIDTH) -> DataFrame:
    """(row_a, row_b), row_a < row_b: one in train, the other in valid or test, with `alike` of the longer one's words in common and in order.

    Exact: with C words in common, the first shared one in the order of all words is among the first n - C + 1 of each
    record. The order rests on counters of fixed size; where words share one it is only less sharp. Equal word sequences
    form one class, so copies are compared once, and pairs of rows are made only for the result. Texts without words are
    equal to each other. alike is above 0 and at most 1. Null text, id or split is no case; repeated rows count each.
    """
    spark = df.sparkSession
    rows = sides(df, id_col, text_col, split_col)
    sent = spark.sparkContext.broadcast(word_counts(rows, width))
    made: dict[str, WordCodes] = {}
    names = [f"b{i}" for i in range(LONGS)]
    schema = "row long, held boolean, w1 long, w2 long, n int, codes binary, tokens array<int>, passed array<int>, " + ", ".join(f"{b} long" for b in names)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = made.setdefault("c", WordCodes())
        for pdf in (x[i : i + AT_ONCE] for x in batches for i in range(0, len(x), AT_ONCE)):
            code, size = c.of(pdf["text"].tolist())
            cut = np.cumsum(size)[:-1]
            raw, short = [x.tobytes() for x in np.split(code, cut)], [x.tobytes() for x in np.split(code.astype("<u4"), cut)]
            out = {
                "row": pdf["row"].to_numpy(), "held": pdf["held"].to_numpy(), "w1": [xxhash.xxh64_intdigest(r) - (1 << 63) for r in raw], "w2": [xxhash.xxh64_intdigest(r, 7) - (1 << 63) for r in raw],
                "n": size, "codes": short,
            }
            yield pd.DataFrame(out | Heads(code, size, pdf["held"].to_numpy(bool), sent.value, alike).columns())

    rows = written(rows.mapInPandas(read, schema))
    classes = rows.groupBy("w1", "w2").agg(F.min("row").alias("cls"), F.max(F.col("held").cast("int")).alias("any_held"), F.min(F.col("held").cast("int")).alias("all_held"))
    members = written(rows.select("row", "held", "w1", "w2").join(classes, ["w1", "w2"]).select("row", "held", "cls", "any_held", "all_held"))
    heads = members.where(F.col("row") == F.col("cls")).select("cls", (F.col("any_held") == 1).alias("h"), (F.col("all_held") == 0).alias("t")).distinct()
    one = rows.join(heads, rows["row"] == heads["cls"])

    # a repeated row id would make a class of its own twice: any of its rows stands for it
    first = one.where("n > 0").select("cls", "n", "h", "t", *names, F.explode(F.arrays_zip("tokens", "passed")).alias("x")).select(F.col("x.tokens").alias("d"), "cls", "n", F.col("x.passed").alias("passed"), *names, "h", "t")
    # lengths in steps of `alike`: what can be alike lies in the same step or the next one
    step = F.floor(F.log(F.col("n") + 0.0) / F.lit(-math.log(alike) or 1.0)).cast("int")
    first = first.withColumn("s", step)
    a = first.where("h").withColumn("s", F.explode(F.array(*[F.col("s") + k for k in (-1, 0, 1)]))).select("d", "s", "cls", "n", "passed", *names).toDF("d", "s", "a", "na", "pa", *(f"a{x}" for x in names))
    b = first.where("t").select("d", "s", "cls", "n", "passed", *names).toDF("d", "s", "b", "nb", "pb", *(f"b{x}" for x in names))
    least = lambda n: F.ceil(n * alike - 1e-9)
    only = lambda p, q: sum((F.bit_count(F.col(f"{p}{x}").bitwiseAND(F.bitwise_not(F.col(f"{q}{x}")))) for x in names), F.lit(0))
    must = least(F.greatest("na", "nb"))
    near = (F.col("a") != F.col("b")) & (F.col("na") - F.col("pa") >= must) & (F.col("nb") - F.col("pb") >= must)
    near = near & (F.col("na") - only("a", "b") >= must) & (F.col("nb") - only("b", "a") >= must)
    # in both orders a pair of two-sided classes is the same pair
    pairs = a.join(b, ["d", "s"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    text = one.groupBy("cls").agg(F.first("codes").alias("codes"))
    pairs = pairs.join(text.select(F.col("cls").alias("a"), F.col("codes").alias("ca")), "a").join(text.select(F.col("cls").alias("b"), F.col("codes").alias("cb")), "b")

    @F.pandas_udf("boolean")
    def same(ca: pd.Series, cb: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ca, cb):
            p, q = np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()
            out.append(common_words(p, q) >= alike * max(len(p), len(q)) - 1e-9)
        return pd.Series(out)

    alike_pairs = written(pairs.where(same("ca", "cb")).select("a", "b"))
    m = members.select("row", "held", "cls")
    links = alike_pairs.unionByName(heads.where("h AND t").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    left, right = m.toDF("row_x", "held_x", "a"), m.toDF("row_y", "held_y", "b")
    rows = links.join(left, "a").join(right, "b").where((F.col("held_x") != F.col("held_y")) & ((F.col("a") != F.col("b")) | (F.col("row_x") < F.col("row_y"))))
    return rows.select(F.least("row_x", "row_y").alias("row_a"), F.greatest("row_x", "row_y").alias("row_b"))


def overlap_fractions(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split") -> DataFrame:
    """(row, n_words, overlap): of each valid or test record the share of its words in chunk pairs that also stand in train.

    Every digest of train counts once however many records hold it, so no pair of records is formed.
    """
    made: dict[str, Chunker] = {}

    @F.pandas_udf("struct<n:int,digests:array<struct<d:long,len:int>>>")
    def chunked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = made.setdefault("c", Chunker())
        for s in batches:
            code = [c.codes(t) for t in s]
            yield pd.DataFrame({"n": [len(x) for x in code], "digests": [[{"d": d, "len": n} for d, n in {k: m for k, m in c.digests(x)}.items()] for x in code]})

    rows = written(sides(df, id_col, text_col, split_col).select("row", "held", chunked("text").alias("c")).select("row", "held", "c.*"))
    train = rows.where("NOT held").select(F.explode("digests.d").alias("d")).distinct().withColumn("in_train", F.lit(True))
    x = rows.where("held").select("row", "n", F.explode_outer("digests").alias("x")).select("row", "n", "x.d", "x.len").join(train, "d", "left")
    total = x.groupBy("row", "n").agg(F.sum("len").alias("all"), F.sum(F.when(F.col("in_train"), F.col("len")).otherwise(0)).alias("common"))
    return total.select("row", F.col("n").alias("n_words"), F.coalesce(F.col("common") / F.col("all"), F.lit(0.0)).alias("overlap"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_pairs(table(spark, sf_dir, "english", "row_id", "split", "text"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: records with a counterpart across the splits, the pairs they are in, and of held-out records the
    share of words in chunks that also stand in train (null for train)."""
    df = table(spark, sf_dir, "english", "row_id", "split", "source", "text")
    pairs = written(cross_pairs(df))
    ends = pairs.select(F.col("row_a").alias("row_id")).unionByName(pairs.select(F.col("row_b").alias("row_id"))).groupBy("row_id").agg(F.count("*").alias("k"))
    shares = overlap_fractions(df).select(F.col("row").alias("row_id"), "n_words", (F.col("overlap") * F.col("n_words")).alias("shared"))
    rows = df.select("row_id", norm_split(F.col("split")).alias("split"), slice_name(F.col("source")).alias("source")).join(ends, "row_id", "left").join(shares, "row_id", "left")
    return rows.groupBy("split", "source").agg(
        F.count("*").alias("n_rows"), F.count("k").alias("n_overlapping"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_pairs"), (F.sum("shared") / F.nullif(F.sum("n_words"), F.lit(0))).alias("word_overlap"),
    )


#: The longest common subsequence row by row, for the pairs across the splits whose words could suffice.
SQL = {
    "p6_found": r"""
WITH RECURSIVE d AS (SELECT row_id, CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END AS s, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM english WHERE text IS NOT NULL),
c AS (SELECT h.row_id AS x, t.row_id AS y, h.w AS a, t.w AS b, ceil(greatest(len(h.w), len(t.w)) * 0.8 - 1e-9) AS must FROM d h JOIN d t ON h.s IN ('valid', 'test') AND t.s = 'train'
  WHERE least(len(h.w), len(t.w)) >= must AND len(list_filter(h.w, lambda x: list_contains(t.w, x))) >= must AND len(list_filter(t.w, lambda x: list_contains(h.w, x))) >= must),
s AS (SELECT x, y, a, b, must, 0 AS j, list_transform(range(0, len(a) + 1), lambda i: 0) AS r FROM c
  UNION ALL SELECT x, y, a, b, must, j + 1, list_transform(range(1, len(k) + 1), lambda i: list_max(k[1:i]))
  FROM (SELECT *, list_transform(range(1, len(a) + 2), lambda i: CASE WHEN i > 1 AND a[i - 1] = b[j + 1] THEN greatest(r[i], r[i - 1] + 1) ELSE r[i] END) AS k FROM s WHERE j < len(b)))
SELECT least(x, y) AS row_a, greatest(x, y) AS row_b FROM s WHERE j = len(b) AND r[-1] >= must""",
}
