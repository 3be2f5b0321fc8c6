"""Byte-level BPE: training, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of the byte-level scheme: contractions, then letters, digits or marks with the blank before them, then blanks.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Special tokens in the order of their ids, the wanted size and the least count of a merge (fixed values).
SPECIALS = ("<|pad|>", "<|unk|>", "<|bos|>", "<|eos|>")
VOCABULARY, MIN_COUNT = 10_000, 1
#: Training folds over the distinct pre-tokens on the driver, about 20 bytes for each of their letters; with more than
#: this many the caller raises the least count of a word.
MAX_WORDS = 2_000_000
#: Places of pairs that are sorted or joined at once.
CHUNK = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter of each byte: visible Latin-1 characters are their own, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def pretokens(text: Column) -> Column:
    """Array of the pre-tokens of a text, on the JVM; null for null."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN), F.lit(0))


def pretoken_counts(df: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """(word, n) of every pre-token that occurs at least so often; counted with map-side aggregation."""
    return df.select(F.explode(pretokens(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letters(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, n): the words' bytes one after the other with a 0 before each and at the end, the place of each word's
    first byte, and its count."""
    table = counts.select("word", F.col("n").cast("long").alias("n")).toArrow()
    parts, sizes, n = [], [], []
    for batch in table.to_batches():
        word = batch.column(0).cast(pa.large_binary())
        offset = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
        parts.append(np.frombuffer(word.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]] if len(word) else np.zeros(0, np.uint8))
        sizes.append(np.diff(offset))
        n.append(batch.column(1).to_numpy())
    size = np.concatenate([*sizes, np.zeros(0, np.int64)])
    starts = np.cumsum(size + 1) - size  # a place is left free before each word
    out = np.zeros(int(size.sum()) + len(size) + 1, np.uint8)
    filled = np.ones(len(out), bool)
    filled[starts - 1], filled[-1] = False, False
    out[filled] = np.concatenate([*parts, np.zeros(0, np.uint8)])
    return out, starts.astype(np.int64 if len(out) > 2**31 - 1 else np.int32), np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64)


def _by_value(value: np.ndarray, place: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(value, sum of the weights, places) of each value; places in their order."""
    order = np.argsort(value, kind="stable")
    v, place = value[order], place[order]
    at = np.flatnonzero(np.r_[len(v) > 0, v[1:] != v[:-1]])
    ends = [*at[1:].tolist(), len(v)]
    for x, k, i, j in zip(v[at].tolist(), np.add.reduceat(weight[order], at).tolist() if len(at) else (), at.tolist(), ends):
        yield x, k, place[i:j].copy()  # a copy, for it goes with its pair and not with all the others


def train(counts: DataFrame, vocabulary: int = VOCABULARY, least: int = MIN_COUNT, specials: tuple[str, ...] = SPECIALS) -> list[tuple[str, str]]:
    """The ranked merges of a byte-level BPE with all 256 bytes as its alphabet.

    The corpus is only touched for `counts` (word, n), a distributed aggregate; the fold over merges runs on the distinct
    words, at most MAX_WORDS of them. Of equally frequent pairs the one of smaller pieces (in code point order) comes first.

    The words lie in one array; a piece stands at its first byte, and its length at its first and last byte. A merge goes
    to the places of its pair only and changes the counts of the pairs beside them, CHUNK places at once.
    """
    from lexmill.operators.tables import written

    counts = written(counts)
    size = counts.count()
    if size > MAX_WORDS:
        raise ValueError(f"{size} distinct words; raise the least count to keep at most {MAX_WORDS}")
    raw, starts, n = _letters(counts)
    names = byte_letters()
    number = {x: i for i, x in enumerate(names)}
    none = max(vocabulary, 256) + 1  # no piece: between words, or inside a piece
    ids = raw.astype(np.uint16 if none < 1 << 16 else np.int32)
    span = np.ones(len(ids), np.uint16 if int(np.diff(starts, append=len(ids)).max(initial=0)) < 1 << 16 else np.int32)
    for free in (starts - 1, [-1]):
        ids[free], span[free] = none, 0
    del raw

    def weight(place: np.ndarray) -> np.ndarray:
        return n[np.searchsorted(starts, place, "right") - 1]

    pairs: dict[tuple[int, int], int] = {}
    where: dict[tuple[int, int], list[np.ndarray]] = {}
    for at in range(0, len(ids) - 1, CHUNK):
        x, y = ids[at : at + CHUNK], ids[at + 1 : at + CHUNK + 1]
        x = x[: len(y)]
        i = np.flatnonzero((x != none) & (y != none))
        place = (i + at).astype(starts.dtype)
        for v, k, here in _by_value((x[i] << 8 | y[i]).astype(np.uint16), place, weight(place)):  # all are bytes yet
            p = v >> 8, v & 255
            pairs[p] = pairs.get(p, 0) + k
            where.setdefault(p, []).append(here)
    # an entry holds the pair's count or one it had before it fell; where it fell, the entry is put back with the new one
    heap = [(-k, (names[a], names[b])) for (a, b), k in pairs.items()]
    heapify(heap)
    def change(old: tuple[int, int], new: tuple[int, int], k: int, places: np.ndarray) -> None:
        if old in pairs:  # all but the one that is joined
            pairs[old] -= k
            if not pairs[old]:
                del pairs[old], where[old]
        pairs[new] = pairs.get(new, 0) + k
        where.setdefault(new, []).append(places)
        heappush(heap, (-pairs[new], (names[new[0]], names[new[1]])))

    def join(p: tuple[int, int], c: int, at: np.ndarray) -> None:
        a, b = p
        at = at[ids[at] == a]
        tail = at + span[at]
        here = ids[tail] == b
        at, tail = at[here], tail[here]
        if not len(at):
            return
        if a == b:  # of a run of the same piece every other place, from the left
            i = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != tail[:-1]], i, 0))
            here = (i - first) % 2 == 0
            at, tail = at[here], tail[here]
        w = weight(at)
        left, right = at - span[at - 1], tail + span[tail]
        joined = right[:-1] == at[1:]  # the next place follows at once: one pair between them
        free = (left != at) & ~np.r_[False, joined]
        after = ids[right]
        other = (after != none) & ~np.r_[joined, False]
        together = span[at] + span[tail]
        span[at] = together
        span[right - 1] = together
        ids[at], ids[tail] = c, none
        for x, k, places in _by_value(ids[left[free]], left[free], w[free]):
            change((x, a), (x, c), k, places)
        for x, k, places in _by_value(after[other], at[other], w[other]):
            change((b, x), (c, x), k, places)
        if joined.any():
            change((b, a), (c, c), int(w[:-1][joined].sum()), at[:-1][joined])

    merges: list[tuple[str, str]] = []
    room = vocabulary - 256 - len(specials)
    while heap and len(names) - 256 < room:
        k, two = heappop(heap)
        p = number[two[0]], number[two[1]]
        now = pairs.get(p, 0)
        if now != -k:
            if 0 < now < -k:
                heappush(heap, (-now, two))
            continue
        if now < max(1, least):
            break
        merges.append(two)
        c = number.setdefault(two[0] + two[1], len(names))
        if c == len(names):
            names.append(two[0] + two[1])
        places = np.sort(np.concatenate(where.pop(p)))
        del pairs[p]
        for i in range(0, len(places), CHUNK):  # what one part has joined stands as c beside the next
            join(p, c, places[i : i + CHUNK])
    return merges


def vocabulary_of(merges: list[tuple[str, str]], specials: tuple[str, ...] = SPECIALS) -> dict[str, int]:
    """Token -> id: special tokens, the bytes by code point of their letter, then one token per merge."""
    out: dict[str, int] = {}
    for t in (*specials, *sorted(byte_letters()), *(a + b for a, b in merges)):
        out.setdefault(t, len(out))
    return out


def encode(text: Column, merges: list[tuple[str, str]], specials: tuple[str, ...] = SPECIALS, template: bool = False) -> Column:
    """Token ids of a text; with the template they stand between the begin and end tokens. Null for null."""
    ids, rank = vocabulary_of(merges, specials), {p: i for i, p in reversed([*enumerate(merges)])}

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex

        words, letter, known = regex.compile(PRETOKEN), byte_letters(), {}

        def pieces(w: str) -> list[int]:
            t = [letter[b] for b in w.encode("utf-8", "surrogatepass")]
            while len(t) > 1:
                p = min(zip(t, t[1:]), key=lambda q: rank.get(q, len(rank)))
                if p not in rank:
                    break
                out, j = [], 0
                while j < len(t):
                    k = 2 if t[j : j + 2] == [*p] else 1
                    out.append("".join(t[j : j + k]))
                    j += k
                t = out
            return [ids[x] for x in t]

        def one(s: str | None) -> list[int] | None:
            if s is None:
                return None
            out: list[int] = []
            for w in words.findall(s):
                if w not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[w] = pieces(w)
                out += known[w]
            return out

        for s in batches:
            yield s.map(one)

    out = run(text)
    return F.concat(F.array(F.lit(ids["<|bos|>"])), out, F.array(F.lit(ids["<|eos|>"]))) if template else out


def decode(tokens: Column, merges: list[tuple[str, str]], specials: tuple[str, ...] = SPECIALS) -> Column:
    """The text of token ids; special tokens are left out, broken bytes become the replacement character."""
    back = {i: t for t, i in vocabulary_of(merges, specials).items() if t not in specials}

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        byte = {c: b for b, c in enumerate(byte_letters())}
        return s.map(lambda a: None if a is None else bytes(byte[c] for i in a if i in back for c in back[i]).decode("utf-8", "replace"))

    return run(tokens)
