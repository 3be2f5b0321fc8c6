"""Exact and near duplicates of records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import sha256
from lexmill.operators.graph import connected_components
from lexmill.operators.sketch import Sets, among, counts, parities, parities_differ, rare_first, surveyed

#: Shingles per record that go to the buckets, shared buckets and similarity that make a pair, least ratio of sizes.
BOTTOM, SHARED, SIMILAR, RATIO = 12, 2, 0.85, 0.7
#: Prefixes are longer by this many elements and candidates must share as many: neighbouring shingles come in runs, so
#: one shared name would make a candidate otherwise.
DEPTH = 12
#: An element that more sets have among their smallest is hot: joining on it would pair too many of them.
HOT = 500
#: Sets of so many elements have 256 parity bits in a prefix's rows, smaller ones and those of HUGE 64: of these not even
#: 256 bits would tell anything, their wide_parities do.
LARGE, HUGE = 128, 700
#: Counters for the rareness of the elements.
RARE = 1 << 22
#: Sets that are cut as arrays at once.
AT_ONCE = 1_000


def keep_first(df: DataFrame, key: Column, order: str = "line_no") -> DataFrame:
    """Of the records with the same key the one of smallest order; null keys are equal to each other.

    The first is found by a map-side minimum per key, so a key held by a third of all rows moves one row per task.
    Ties in `order` go to any one of the tied rows.
    """
    d = df.withColumn("_k", sha256(F.coalesce(F.concat(F.lit("k"), key), F.lit("n"))))
    first = d.groupBy(F.col("_k").alias("_fk")).agg(F.min(order).alias("_first"))
    kept = d.join(first, (F.col("_k") == F.col("_fk")) & F.col(order).eqNullSafe(F.col("_first")), "left_semi")
    return kept.drop("_k")


def first_values(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, columns...) of the row of smallest order per key, in one aggregation; null keys are equal to each other.

    For small columns: what keep_first gets by a join of whole rows. Ties in `order` go to any one of the tied rows.
    """
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_v")).select(key, "_v.*")


def duplicates_of(df: DataFrame, key: Column, id_col: str = "id", order: str = "line_no") -> DataFrame:
    """(id, line, kept_id, kept_line): every record that keep_first drops, with the record kept in its stead."""
    k = sha256(F.coalesce(F.concat(F.lit("k"), key), F.lit("n")))
    d = df.select(k.alias("_k"), F.col(id_col).alias("id"), F.col(order).alias("line"))
    first = d.groupBy("_k").agg(F.min("line").alias("kept_line"), F.min_by("id", "line").alias("kept_id"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "_k").where(F.col("line") != F.col("kept_line")).select("id", "line", "kept_id", "kept_line")


def prefix_duplicates(df: DataFrame, n: int = 15, text_col: str = "text", order: str = "line_no") -> DataFrame:
    """df with group_first, group_size of the records whose first n characters occur more than once; null texts are left out.

    Sorting by (group_first, order) gives the groups by first appearance.
    """
    if n < 1:
        raise ValueError("n must be positive")
    d = df.where(F.col(text_col).isNotNull()).withColumn("prefix", F.substring(text_col, 1, n))
    groups = d.groupBy("prefix").agg(F.min(order).alias("group_first"), F.count("*").alias("group_size")).where("group_size > 1")
    return d.join(groups, "prefix")


def _prefixes(df: DataFrame, node: str, n: str, similar: float, count: np.ndarray) -> DataFrame:
    """(node, n, h): of each set (node, sig) the rarest elements, so many that two sets this similar share DEPTH of them.

    The sets are cut where they lie; only the prefixes go on to a join.
    """
    sent = df.sparkSession.sparkContext.broadcast(count)  # counters of fixed size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x[i : i + AT_ONCE] for x in batches for i in range(0, len(x), AT_ONCE)):
            size = pdf["sig"].map(len).to_numpy(np.int64)
            flat = np.concatenate([*pdf["sig"], np.zeros(0, np.int64)]).astype(np.int64)
            rec, h, _ = rare_first(size, flat, sent.value, size - np.ceil(size * similar).astype(np.int64) + DEPTH)
            yield pd.DataFrame({node: pdf["node"].to_numpy()[rec], n: size[rec].astype(np.int32), "h": h})

    return df.select("node", "sig").mapInPandas(cut, f"{node} long, {n} int, h long")


def _candidates(a: DataFrame, b: DataFrame, similar: float, near: Column) -> DataFrame:
    """(a, b) that share DEPTH prefix elements, or all they must have in common if that is less."""
    must = F.least(F.lit(DEPTH), F.ceil(F.col("na") * similar).cast("int"), F.ceil(F.col("nb") * similar).cast("int"))
    return a.join(b, "h").where(near).groupBy("a", "b").agg(F.count("*").alias("c"), F.first(must).alias("must")).where("c >= must").select("a", "b")


def _least_shared(n: Column, similar: float) -> Column:
    """How many elements two sets share at least that are this similar and have n together; the sum of a float's error is kept out."""
    return F.ceil(n * (similar / (1 + similar)) - 1e-9)


def _near_candidates(sets: DataFrame, sig: Sets, written: Callable[[DataFrame], DataFrame], similar: float) -> DataFrame:
    """(a, b) with a < b of the sets that may be this similar: they share an element that is, in the order of rareness,
    early enough in both, and the parities of their elements differ in no more places than similar sets' do."""
    count, wide = surveyed(sets, sig, written, RARE)
    sent, parts = sets.sparkSession.sparkContext.broadcast(count), sig.maker()  # counters of fixed size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, made in parts(batches):
            some = [i for i, x in enumerate(made) if x is not None and len(x) > 0]
            made, pdf = [made[i] for i in some], pdf.iloc[some]
            size = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.concatenate([*made, np.zeros(0, np.int64)]).astype(np.int64, copy=False)
            words = parities(size, flat)
            rec, h, place = rare_first(size, flat, sent.value, size - np.ceil(size * similar - 1e-9).astype(np.int64) + 1)
            # 32 bits of an element and its language are enough to meet; others that fall together are told apart when the pairs are compared
            salt = np.fromiter((0 if x is None else zlib.crc32(x.encode("utf-8", "surrogatepass")) + 1 for x in pdf["language"]), np.uint64, len(pdf))
            h = ((h.view(np.uint64) ^ salt[rec] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pd.DataFrame({"h": h, "node": pdf["node"].to_numpy()[rec], "n": size[rec].astype(np.int32), "at": place.astype(np.int32), "bits": np.bitwise_xor.reduce(words)[rec], **{f"w{i}": np.where((size >= LARGE) & (size < HUGE), words[i], 0)[rec] for i in (1, 2, 3)}})

    p = sig.select(sets).mapInPandas(cut, "h int, node long, n int, at int, bits long, w1 long, w2 long, w3 long")
    a, b = p.toDF("h", "a", "na", "pa", "ba", "a1", "a2", "a3"), p.toDF("h", "b", "nb", "pb", "bb", "b1", "b2", "b3")
    n = F.col("na") + F.col("nb")
    x = [F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2, 3)]
    fold = F.col("ba").bitwiseXOR(F.col("bb"))
    first = fold.bitwiseXOR(x[0]).bitwiseXOR(x[1]).bitwiseXOR(x[2])
    differ = F.when((F.least("na", "nb") >= LARGE) & (F.greatest("na", "nb") < HUGE), F.bit_count(first) + F.bit_count(x[0]) + F.bit_count(x[1]) + F.bit_count(x[2])).otherwise(F.bit_count(fold))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similar - 1e-9) & (F.col("pa") <= F.col("na") - _least_shared(n, similar)) & (F.col("pb") <= F.col("nb") - _least_shared(n, similar)) & (differ <= n - 2 * _least_shared(n, similar))
    return _near_by_bits(a.join(b, "h").where(near).select("a", "b").distinct(), wide, similar)


def _near_by_bits(pairs: DataFrame, wide: DataFrame, similar: float) -> DataFrame:
    """The pairs but those of two large sets whose bits in wide (node, n, bits) differ in more places than similar sets' do:
    256 bits tell nothing of sets of thousands."""

    @F.pandas_udf("int")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if s is None or t is None else parities_differ(s, t) for s, t in zip(x, y)], dtype=np.int32)

    d = pairs.join(wide.toDF("a", "na", "xa"), "a", "left").join(wide.toDF("b", "nb", "xb"), "b", "left")
    n = F.coalesce(F.col("na") + F.col("nb"), F.lit(0))
    return d.where(differ("xa", "xb") <= n - 2 * _least_shared(n, similar)).select("a", "b")


def similar_pairs(sets: DataFrame, written: Callable[[DataFrame], DataFrame], similar: float = SIMILAR, bottom: int = BOTTOM, shared: int = SHARED, hot: int = HOT, sig: Column | Sets | None = None, quick: Column | Sets | None = None) -> DataFrame:
    """(a, b, jaccard) with a < b of sets (node, language, sig) of one language, at least `similar`, that also share at
    least `shared` of their `bottom` smallest elements.

    Exact. Candidates come from the rarest elements (prefix filtering), whatever is frequent; `hot` changes nothing any
    more. Both conditions are checked on the sets of the candidates. With `sig`, sets holds what it is made of, as the
    text: sets are made where they are needed, and no table or shuffle has more of them than the prefixes. `quick` makes
    sets that are as similar as those of sig but cheaper: the candidates come from them. If sig is Sets, pairs are compared
    in Python, a few texts at a time, and no set of theirs passes through the JVM.
    """
    sig = F.col("sig") if sig is None else sig
    if isinstance(sig, Sets):
        return _compared(written(_near_candidates(sets, sig, written, similar)), sets, sig, similar, bottom, shared)
    cand = written(_near_candidates(sets, Sets.of(sig if quick is None else quick), written, similar))
    ends = cand.select(F.explode(F.array("a", "b")).alias("_node"), "a", "b")
    sides = among(sets, ends.select("_node").distinct()).join(ends, F.col("node") == F.col("_node"))
    sides = sides.repartition("a", "b").select("a", "b", "node", "language", sig.alias("sig"))  # what sig is made of is moved, not sig
    of = lambda x: F.max(F.when(F.col("node") == F.col(x), F.struct("language", "sig")))
    both = sides.groupBy("a", "b").agg(of("a").alias("x"), of("b").alias("y")).where(F.col("x.language").eqNullSafe(F.col("y.language")))
    inter = F.size(F.array_intersect("x.sig", "y.sig"))
    small = F.size(F.array_intersect(F.slice("x.sig", 1, bottom), F.slice("y.sig", 1, bottom)))
    both = both.select("a", "b", (inter / (F.size("x.sig") + F.size("y.sig") - inter)).alias("jaccard"), small.alias("small"))
    return both.where((F.col("jaccard") >= similar) & (F.col("small") >= shared)).select("a", "b", "jaccard")


def _compared(cand: DataFrame, sets: DataFrame, sig: Sets, similar: float, bottom: int, shared: int) -> DataFrame:
    """(a, b, jaccard) of the candidates (a, b) that are this similar and share so many of their smallest elements."""
    names, make, exact = list(sig.columns), sig.make, sig.exact
    ends = cand.select(F.explode(F.array("a", "b")).alias("_node"), "a", "b")
    sides = sig.select(among(sets, ends.select("_node").distinct())).join(ends, F.col("node") == F.col("_node")).repartition("a", "b")
    of = lambda x: F.max(F.when(F.col("node") == F.col(x), F.struct("language", *[f"_{k}" for k in names])))
    both = sides.groupBy("a", "b").agg(of("a").alias("x"), of("b").alias("y")).where(F.col("x.language").eqNullSafe(F.col("y.language")))
    both = both.select("a", "b", *[F.col(f"{e}._{k}").alias(f"{e}_{k}") for e in "xy" for k in names])

    def ends_of(pdf: pd.DataFrame, made: Callable[[pd.DataFrame], list[np.ndarray | None]]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        x, y = (made(pdf[[f"{e}_{k}" for k in names]].set_axis(names, axis=1)) for e in "xy")
        inter = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
        return [(s, t, n / (len(s) + len(t) - n)) for s, t, n in zip(x, y, inter)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (x[i : i + AT_ONCE // 4] for x in batches for i in range(0, len(x), AT_ONCE // 4)):
            for made in (make, exact or make):
                got = ends_of(pdf, made)
                near = [i for i, (_, _, j) in enumerate(got) if j >= similar]
                got, pdf = [got[i] for i in near], pdf.iloc[near]
                if exact is None:
                    break
            alike = [i for i, (s, t, _) in enumerate(got) if len(np.intersect1d(s[:bottom], t[:bottom], assume_unique=True)) >= shared]
            yield pdf.iloc[alike][["a", "b"]].assign(jaccard=np.array([got[i][2] for i in alike], np.float64))

    return both.mapInPandas(compare, "a long, b long, jaccard double")


def copies_of(sets: DataFrame, sig: Column | Sets, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, head, n) of the sets (node, language and what sig is made of) that equal one of the same language with a smaller node; n is their size."""
    if isinstance(sig, Sets):
        parts = sig.maker()

        def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf, made in parts(batches):
                k = np.frombuffer(b"".join(hashlib.blake2b(b"" if x is None else repr(lang).encode() + b"\0" + x.tobytes(), digest_size=16).digest() for lang, x in zip(pdf["language"], made)), np.int64)
                yield pd.DataFrame({"node": pdf["node"], "n": np.array([-1 if x is None else len(x) for x in made], np.int32), "k1": k[::2], "k2": k[1::2]})

        keys = written(sig.select(sets).mapInPandas(keyed, "node long, n int, k1 long, k2 long")).where("n >= 0")
    else:
        s = sets.select("node", "language", sig.alias("sig"))
        keys = written(s.select("node", F.size("sig").alias("n"), F.xxhash64("language", F.col("language").isNull(), "sig").alias("k1"), F.xxhash64(F.lit(1), "language", F.col("language").isNull(), "sig").alias("k2"))).where("n >= 0")
    heads = keys.groupBy("k1", "k2").agg(F.min("node").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m")
    return written(keys.join(heads, ["k1", "k2"]).where("node <> head").select("node", "head", "n"))


def near_duplicates(df: DataFrame, sig: Column | Sets, written: Callable[[DataFrame], DataFrame], node: str = "row_id", language: str = "language", seed_keys: tuple[str, ...] = (), similar: float = SIMILAR, quick: Column | Sets | None = None) -> DataFrame:
    """(node, root): components of near duplicates, and of records with equal values in all of seed_keys.

    Equal signatures are one record for the pair search, so copies are linked to it and not to each other; root is the
    smallest node of the component. Records without any link are their own root. Null keys and signatures link nothing.
    df is read once for each step, and its signatures are made anew: they are several times the text. `quick` makes
    signatures that are equal, or similar, where those of sig are, but cheaper; then sig is made for candidates only.
    """
    d = df.withColumns({"node": F.col(node), "language": F.col(language)})
    copies = copies_of(d, sig if quick is None else quick, written)
    pairs = similar_pairs(among(d, copies.select("node"), False), written, similar, sig=sig, quick=quick)
    # a text with one distinct shingle can't share two buckets with another, not even with its copy
    links = copies.where("n > 1").select(F.col("node").alias("src"), F.col("head").alias("dst")).unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if seed_keys:
        known = d.select("node", *seed_keys).dropna(subset=list(seed_keys))
        seeds = known.groupBy(*seed_keys).agg(F.min("node").alias("dst"))
        links = links.unionByName(known.join(seeds, list(seed_keys)).where("node <> dst").select(F.col("node").alias("src"), "dst"))
    roots = connected_components(links, written)
    return d.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def similar_across(left: DataFrame, right: DataFrame, written: Callable[[DataFrame], DataFrame], similar: float = SIMILAR, ratio: float = RATIO) -> DataFrame:
    """(a, b, jaccard) of every pair across the two tables (node, sig) whose sets are at least `similar`; exact.

    Prefix filtering: sets this similar share DEPTH of their rarest size - ceil(similar * size) + DEPTH elements, so
    only those are joined; equal sets on a side are compared once and expanded again at the end.
    """
    def classes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        d = df.where(F.size("sig") > 0).select("node", "sig", F.xxhash64("sig").alias("k1"), F.xxhash64(F.lit(1), "sig").alias("k2"))
        heads = d.groupBy("k1", "k2").agg(F.min("node").alias("head"))
        m = d.join(heads, ["k1", "k2"])
        return m.where("node = head").select("node", "sig"), m.select(F.col("head"), F.col("node").alias(name))

    lu, lm = classes(left, "a_row")
    ru, rm = classes(right, "b_row")
    lu, ru = written(lu), written(ru)
    count = counts(lu.select("sig").unionByName(ru.select("sig")))
    a, b = _prefixes(lu, "a", "na", similar, count), _prefixes(ru, "b", "nb", similar, count)
    bound = max(similar, ratio)
    cand = written(_candidates(a, b, similar, F.least("na", "nb") >= F.greatest("na", "nb") * bound))
    p = cand.join(lu.toDF("a", "sa"), "a").join(ru.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    p = p.withColumn("jaccard", both / (F.size("sa") + F.size("sb") - both)).where(F.col("jaccard") >= similar).select("a", "b", "jaccard")
    return p.join(lm.withColumnRenamed("head", "a"), "a").join(rm.withColumnRenamed("head", "b"), "b").select(F.col("a_row").alias("a"), F.col("b_row").alias("b"), "jaccard")


def preview(df: DataFrame, per: str, order: str, k: int = 3, chars: int = 200, text_col: str = "text") -> DataFrame:
    """df's first row of each of the first k values of `per`, in order, with the beginning of its text in `start`."""
    first = df.groupBy(per).agg(F.min(order).alias("_first")).orderBy("_first").limit(k)
    return df.join(F.broadcast(first.select("_first")), df[order] == F.col("_first"), "left_semi").withColumn("start", F.substring(text_col, 1, chars))  # k rows


def first_rows(df: DataFrame, per: str, order: str, k: int) -> DataFrame:
    """The first k rows per value, by order."""
    w = Window.partitionBy(per).orderBy(order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
