"""Functions that Spark SQL lacks, as vectorised UDFs: normal forms and 64-bit shingles."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import dedup_key, fold_blanks, protect_marks, restore_marks
from lexmill.operators.sketch import Sets


#: Shingles whose hash a task keeps, about 200 bytes each: the first it sees, so the frequent ones.
KNOWN = 300_000
#: Texts that are hashed as one array.
AT_ONCE = 500


def normal_form(c: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD of a text."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return apply(c)


def blank_key(c: Column) -> Column:
    """NFC with runs of blanks folded: the key of exact duplicates."""
    return fold_blanks(normal_form(c, "NFC"))


def tokenizer_form(c: Column) -> Column:
    """NFKC, but with Chinese full-width punctuation kept."""
    return restore_marks(normal_form(protect_marks(c), "NFKC"))


#: Characters whose case folding is the same in every version of Unicode that a JVM or Python in use has.
PLAIN = r"\x00-\u024f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef"


def _odd_key(c: Column) -> Column:
    """The dedup_key of a text with other characters than plain ones, null for others; ASCII is not searched for them."""
    return F.when((F.octet_length(c) > F.char_length(c)) & c.rlike(f"[^{PLAIN}]"), dedup_key(c))


def key_shingles(c: Column, digest: str = "blake2b") -> Column:
    """The shingles of the dedup_key of a text. Texts of plain characters are folded with their shingles, for the JVM takes
    several times as long for it; the others have the JVM's key."""
    return shingles(c, digest=digest, key=_odd_key(c))


def quick_shingles(c: Column, size: int = 5) -> Column:
    """Like key_shingles, with a hash that whole batches get at once instead of a digest: as many elements, shared by the
    same texts, but other numbers in another order. Sets of both kinds are equal, or similar, alike."""

    @F.pandas_udf("array<long>")
    def folded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, keys in batches:
            yield pd.Series(quick_arrays(s.tolist(), keys.tolist(), size), dtype=object)

    return folded(c, _odd_key(c))


def quick_made(c: Column, size: int = 5) -> Sets:
    """The sets of quick_shingles, made in Python from the text."""
    return Sets({"text": c, "key": _odd_key(c)}, lambda pdf: quick_arrays(pdf["text"].tolist(), pdf["key"].tolist(), size))


def key_made(c: Column, size: int = 5, digest: str = "blake2b") -> Sets:
    """The sets of key_shingles, made in Python from the text; those of quick_shingles find the pairs."""
    one = _digested(size, digest)
    return replace(quick_made(c, size), exact=lambda pdf: [one(t) for t in _folded(pdf["text"], pdf["key"])])


def _folded(texts: Iterable[str | None], keys: Iterable[str | None]) -> list[str | None]:
    """Texts case-folded without blanks; those with a key are it."""
    return ["".join(t.casefold().split()) if k is None and t is not None else k for t, k in zip(texts, keys)]


def quick_arrays(texts: list[str | None], keys: list[str | None], size: int = 5) -> list[np.ndarray | None]:
    """The quick_sets of texts, folded here unless they have a key."""
    out: list[np.ndarray | None] = []
    for i in range(0, len(texts), AT_ONCE):
        out += quick_sets([x if x is not None else None if t is None else "".join(t.casefold().split()) for t, x in zip(texts[i : i + AT_ONCE], keys[i : i + AT_ONCE])], size)
    return out


def quick_sets(keys: list[str | None], size: int = 5) -> list[np.ndarray | None]:
    """The distinct character n-grams of each text as 64-bit hashes, sorted; a text shorter than size gives itself."""
    codes = np.frombuffer("".join(k for k in keys if k is not None).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):  # the low bits depend on all
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    h = (h ^ h >> np.uint64(32)).view(np.int64)
    out: list[np.ndarray | None] = []
    at = 0
    for k in keys:
        if k is None:
            out.append(None)
            continue
        if len(k) < size:
            out.append(np.frombuffer(hashlib.blake2b(k.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.int64))
        else:
            x = np.sort(h[at : at + len(k) - size + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        at += len(k)
    return out


def _digested(size: int, digest: str) -> Callable[[str | None], np.ndarray | None]:
    """A function that gives the shingles of a text, and keeps the hashes of the first KNOWN."""
    known: dict[str, int] = {}

    def hashed(p: str) -> int:
        b = p.encode("utf-8", "surrogatepass")
        raw = hashlib.blake2b(b, digest_size=8).digest() if digest == "blake2b" else hashlib.md5(b, usedforsecurity=False).digest()[:8]
        h = int.from_bytes(raw, "big") - (1 << 63)
        if len(known) < KNOWN:
            known[p] = h
        return h

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        parts = {t[i : i + size] for i in range(max(1, len(t) - size + 1))}
        return np.sort(np.fromiter((known[p] if p in known else hashed(p) for p in parts), np.int64, len(parts)))

    return one


def shingles(c: Column, size: int = 5, digest: str = "blake2b", key: Column | None = None) -> Column:
    """The distinct character n-grams of a text as 64-bit hashes, sorted; the sign bit is flipped so that their order is
    that of the unsigned numbers. A text shorter than size gives itself, null gives null. digest: blake2b, or md5 (its
    first 8 bytes), which SQL engines have too. With a key, texts are case-folded without blanks, those with one are it."""
    if digest not in ("blake2b", "md5"):
        raise ValueError("digest must be blake2b or md5")

    def grams(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        one = _digested(size, digest)
        for s, *keys in batches:
            yield (s if not keys else pd.Series(_folded(s, keys[0]), dtype=object)).map(one)

    if key is None:
        @F.pandas_udf("array<long>")
        def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from grams((s,) for s in batches)

        return plain(c)

    @F.pandas_udf("array<long>")
    def folded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from grams(batches)

    return folded(c, key)
