"""Problem 9: passages of evaluation items inside a corpus.

Pigeonhole edit matching: an item is cut into so many pieces that, wherever at least half of it stands in a document in
one stretch or two with at most a tenth altered, more pieces lie whole inside than the errors can hit; so some occur
exactly and in order. An automaton finds exact pieces; around them the runs of words that item and document share are
chained into stretches, and Myers' bit-parallel distance decides how much of the item each stretch holds.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import spread, table, written

#: Items per automaton: what is sent to the workers at once is bounded by it.
BLOCK = 20_000
#: Share of the held words or characters that may be altered, and the tolerance of the final check: alterations next to
#: each other can move the edges of a stretch, so it takes twice the budget.
BUDGET, TOLERANCE = 0.1, 0.2
#: Stretches count together up to this distance, in parts of the item's length.
NEAR = 0.75

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: A hyphen inside a word or at a line's end joins its halves.
HYPHEN = re.compile(r"[-‐‑](?:(?<=[^\W\d_][-‐‑])\s*(?=[^\W\d_])|(?<=\w[-‐‑])[^\S\n]*\n\s*(?=\w))")
WORD = re.compile(r"[㐀-䶿一-鿿\u3040-\u30ff\uac00-\ud7af]|[^\W_㐀-䶿一-鿿\u3040-\u30ff\uac00-\ud7af]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words in lower case, Han characters, kana and Hangul one by one; punctuation, blanks and invisible characters go."""
    if text.isascii():
        return ASCII_WORD.findall((HYPHEN.sub("", text) if "-" in text else text).lower())
    return WORD.findall(HYPHEN.sub("", INVISIBLE.sub("", text)).lower())


def myers(a: list[str], b: list[str]) -> int:
    """Edit distance of two sequences, one bit per element of a."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return score


def grams(w: list[str], k: int) -> Iterator[tuple[str, ...]]:
    """All runs of k words."""
    return zip(*(w[i:] for i in range(k)))


def whole_pieces(held: int, size: int) -> int:
    """How many of the pieces of this size lie whole in two stretches of `held` words together, at least, however they lie."""
    return held if size == 1 else (held + 2) // size - 3


#: Items of which half is less than so many words are short.
SHORT = 27
#: Pieces that must occur, and how short they may get for it: the first that an item's length allows.
NEEDS = ((3, 3), (2, 2), (1, 1))


class Item:
    """An evaluation passage: its words and its pieces."""

    def __init__(self, text: str):
        self.words = words(text)
        n = len(self.words)
        half = max(1, (n + 1) // 2)
        self.size, self.need = self._cut(n, half)
        # the runs that line up stretches: short ones where a stretch of a short item can be altered every few words
        self.run = min(3 if sum(w[0] < "⺀" for w in self.words) * 2 > n else 4, 2 if half < SHORT else 4, max(1, half // 2))
        # words that a held half keeps, for altered ones at its edges can't be told from others
        self.held = half - int(half * BUDGET)
        # runs that two held stretches keep at least: each stretch loses those over its edge, each error those it lies in
        self.least = half - 2 * (self.run - 1) - self.run * int(half * BUDGET)
        self.at: dict[tuple[str, ...], list[int]] = {}
        for i, g in enumerate(grams(self.words, self.run)):
            self.at.setdefault(g, []).append(i)

    @staticmethod
    def _cut(n: int, half: int) -> tuple[int, int]:
        """(size, need): the longest pieces of which `need` stay whole and unaltered in any held part; fewer where they would get short."""
        for need, shortest in NEEDS:
            for size in range(half, shortest - 1, -1):
                # the budget grows slower than the pieces as long as they are shorter than ten words: half the item is the worst case
                if all(whole_pieces(h, size) - int(h * BUDGET) >= need for h in ((half,) if size < 10 else range(half, n + 1))):
                    return size, need
        return 1, 1

    def pieces(self, common: Counter) -> Iterator[tuple[str, int]]:
        """The pieces and where they begin in the joined item; a short item is one piece.

        Any first cut keeps the guarantee; the one is taken whose pieces are least common among the items.
        """
        w, n, k = self.words, len(self.words), self.size
        first = min(range(k), key=lambda o: sum(common[tuple(w[i : i + k])] - 1 for i in range(o, n - k + 1, k))) if n >= 2 * k else 0
        at = sum(map(len, w[:first]))
        for i in range(first, max(first + 1, n - k + 1), k):
            piece = "".join(w[i : i + k])
            yield piece, at
            at += len(piece)

    def held_in(self, w: list[str], shared: list[tuple[int, tuple[str, ...]]]) -> int:
        """How many words of the item the document w holds in one stretch or two near ones; shared: places and runs in the window that the item has too."""
        n = len(self.words)
        found = blocks(shared, self.at, self.run)
        one = self.stretch(w, found)
        if not one:
            return 0
        best = one[1] - one[0]
        before = [x for x in found if x[0] + x[2] <= one[0] and one[2] - NEAR * n - 10 <= x[1] + x[2] <= one[2]]
        after = [x for x in found if x[0] >= one[1] and one[3] <= x[1] <= one[3] + NEAR * n + 10]
        rest = [t[1] - t[0] for part in (before, after) if part and (t := self.stretch(w, part))]
        return best + max(rest, default=0)

    def stretch(self, w: list[str], found: list[tuple[int, int, int]]) -> tuple[int, int, int, int] | None:
        """(item from, to, document from, to) of the longest stretch of shared runs that Myers' distance accepts."""
        n = len(self.words)
        gap = max(6, n // 10 + 2 * (self.run - 1))
        # best chain that ends with each block: words in it, the block before
        best: list[tuple[int, int]] = []
        for k, (i, j, m) in enumerate(found):
            top, by = m, -1
            for p in range(k - 1, -1, -1):
                a, b, size = found[p]
                over = max(0, a + size - i, b + size - j)  # repeated words can make neighbours overlap
                if over < m and a < i and b < j and i - a - size <= gap and j - b - size <= gap and best[p][0] + m - over > top:
                    top, by = best[p][0] + m - over, p
            best.append((top, by))
        for k in sorted(range(len(found)), key=lambda k: -best[k][0]):
            if best[k][0] < max(min(3, self.run), 0.08 * n):
                return None
            chain, p = [], k
            while p >= 0:
                chain.append(found[p])
                p = best[p][1]
            chain.reverse()
            while chain:
                (i, j, _), (a, b, size) = chain[0], chain[-1]
                if myers(self.words[i : a + size], w[j : b + size]) <= TOLERANCE * (a + size - i):
                    return self.widened(w, i, a + size, j, b + size)
                chain.pop(0 if chain[0][2] <= size else -1)
        return None


    def widened(self, w: list[str], i: int, a: int, j: int, b: int) -> tuple[int, int, int, int]:
        """The stretch with the words beyond its ends that match again after an altered one, as long as the distance allows it."""
        x, n = self.words, len(self.words)
        done = False
        while not done:
            done = True
            for t in range(2, self.run + 2):
                for s in (0, -1, 1):  # altered, left out, put in
                    p, q = a + t, b + t + s
                    if p <= n and b < q <= len(w) and x[p - 1] == w[q - 1] and myers(x[i:p], w[j:q]) <= max(1, BUDGET * (p - i)):
                        a, b, done = p, q, False
                        break
                    p, q = i - t, j - t - s
                    if p >= 0 and 0 <= q < j and x[p] == w[q] and myers(x[p:a], w[q:b]) <= max(1, BUDGET * (a - p)):
                        i, j, done = p, q, False
                        break
                if not done:
                    break
            while a < n and b < len(w) and x[a] == w[b]:
                a, b = a + 1, b + 1
            while i > 0 and j > 0 and x[i - 1] == w[j - 1]:
                i, j = i - 1, j - 1
        return i, a, j, b


def blocks(shared: list[tuple[int, tuple[str, ...]]], at: dict[tuple[str, ...], list[int]], run: int) -> list[tuple[int, int, int]]:
    """(place in the item, in the document, words) of the longest runs of words that both have, by place in the document."""
    open_: dict[int, list[int]] = {}
    out: list[list[int]] = []
    for j, g in shared:
        for i in at[g]:
            b = open_.get(j - i)
            if b and b[1] + b[2] - run + 1 == j:
                b[2] += 1
            else:
                b = open_[j - i] = [i, j, run]
                out.append(b)
    return [tuple(b) for b in sorted(out, key=lambda b: (b[1], b[0]))]


class Index:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        made = [(i, Item(text)) for i, text in items]
        self.ids, self.items = [i for i, x in made if x.words], [x for _, x in made if x.words]
        common = {k: Counter(g for x in self.items for g in grams(x.words, k)) for k in {x.size for x in self.items}}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for piece, start in item.pieces(common[item.size]):
                at.setdefault(piece, []).append((k, start))
        self.auto = ahocorasick.Automaton()
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()
        self.chars = [sum(map(len, x.words)) for x in self.items]
        self.empty = not at
        #: the short runs of words of all items
        self.runs = {g for x in self.items for g in x.at}

    def leaks(self, w: list[str]) -> list[tuple[int, float]]:
        """(item id, share held) of the items that a document of these words holds."""
        if not w or self.empty:
            return []
        hits: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.auto.iter("".join(w)):
            for k, start in where:
                hits.setdefault(k, []).append((end - size - start, start))
        out, starts = [], None
        known: dict[int, tuple[list[int], list[tuple[str, ...]]]] = {}  # by length of run: where runs of any item stand, and which

        def shared(item: Item, lo: int, hi: int) -> list[tuple[int, tuple[str, ...]]]:
            """Places and runs of the window that the item has too; none if they are fewer than a held half keeps."""
            if item.run not in known:
                at = [(i, g) for i, g in enumerate(grams(w, item.run)) if g in self.runs]
                known[item.run] = [i for i, _ in at], [g for _, g in at]
            where, which = known[item.run]
            a, b = bisect_left(where, lo), bisect_left(where, hi)
            own = item.at
            out = [(i, g) for i, g in zip(where[a:b], which[a:b]) if g in own]
            # repeated runs count once in either
            least = item.least - (len(item.words) - item.run + 1 - len(own))
            return out if least <= 0 or len(out) >= least and len({g for _, g in out}) >= least else []

        for k, found in hits.items():
            item = self.items[k]
            if len(found) < item.need:
                continue
            found.sort()
            n, chars = len(item.words), self.chars[k]
            best, a = 0, 0
            for b in range(len(found)):
                if b + 1 == len(found) or found[b + 1][0] - found[b][0] > chars:
                    if in_order(found[a : b + 1], item.need):
                        starts = starts or [*accumulate(map(len, w))]
                        lo, hi = bisect_left(starts, found[a][0]), bisect_left(starts, found[b][0] + chars)
                        both = shared(item, max(0, lo - 10 - n // 8), hi + 10 + n // 8)
                        if both:
                            best = max(best, item.held_in(w, both))
                    a = b + 1
            if best >= item.held:
                out.append((self.ids[k], best / n))
        return out


def in_order(found: list[tuple[int, int]], need: int) -> bool:
    """Whether so many different pieces of (diagonal, start) stand in the item's order: larger start, later place."""
    if len(found) < need:
        return False
    ends: list[int] = []  # the smallest start that ends an ordered row of each length
    for _, start in sorted((d + s, s) for d, s in found):
        k = bisect_left(ends, start)
        if k == len(ends):
            ends.append(start)
            if len(ends) >= need:
                return True
        else:
            ends[k] = start
    return False


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, held): every pair where the document holds at least half of the item's text.

    Null or wordless texts and null ids on either side give no pair; repeated documents and items count each. The items
    are a stated query set: they go to the workers in blocks of `block`. The documents are read once; with several blocks
    their words are written once, and each block's automaton passes over the words.
    """
    spark = docs.sparkSession
    items = items.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    texts = docs.where(F.col(text_col).isNotNull() & F.col(doc_col).isNotNull()).select(F.col(doc_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    texts = spread(texts)
    n = -(-items.count() // block)
    if n > 1:
        cut = F.pandas_udf(lambda s: s.map(lambda t: " ".join(words(t))), "string")
        texts = written(texts.select("d", cut("t").alias("t")))

    def one(part: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])
        kept: dict[str, Index] = {}
        read = str.split if n > 1 else words

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if "x" not in kept:
                kept["x"] = Index(sent.value)
            for pdf in batches:
                rows = [(d, i, h) for d, t in zip(pdf["d"], pdf["t"]) for i, h in kept["x"].leaks(read(t))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "held"])

        return texts.mapInPandas(find, "doc_id long, item_id long, held double")

    if n <= 1:
        return one(items)
    out = [one(items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)) for k in range(n)]  # all items, in n blocks
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item that leaked: the number of documents that hold it, and the largest share held."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("held").alias("most_held"))
