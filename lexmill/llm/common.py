"""Helpers shared by the operators on training data."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.tables import shared_root, spread, written

__all__ = ["WordCodes", "language_code", "norm_split", "run_digest", "shared_dir", "slice_name", "spread", "table", "tokenizer_path", "written"]

#: Spellings of the three split names; anything else counts as no split.
SPLITS = ("train", "valid", "test")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table (all, if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def norm_split(c: Column) -> Column:
    """train, valid or test; null for null and for any other label."""
    s = F.lower(F.trim(c))
    s = F.when(s == "validation", "valid").otherwise(s)
    return F.when(s.isin(*SPLITS), s)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that all executors reach."""
    return f"{shared_root(spark)}/lexmill-{uuid.uuid4().hex}"


def slice_name(c: Column) -> Column:
    """One name for all spellings of a value: letter case, blanks, hyphens and underscores don't count; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")
    return F.when(s != "", s)


#: Names of languages besides their codes (fixed values).
LANGUAGE_NAMES = {"english": "en", "eng": "en", "chinese": "zh", "zho": "zh", "chi": "zh", "cn": "zh"}


def language_code(c: Column) -> Column:
    """The primary language subtag in lower case (en for en-GB, EN, English); null for null or blank."""
    s = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)", 1)
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.when(s != "", F.coalesce(names[s], s))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public tokenizer's file lies; the folder is a parameter of the environment with a default."""
    return os.path.join(os.environ.get("LEXMILL_TOKENIZERS", "/opt/tokenizers"), name)


#: Code points from here on are handled apart; the factors of the digests (fixed odd numbers).
BMP = 0x10000
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_digest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each run values[start:end]; the runs cover the values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    with np.errstate(over="ignore"):
        place = np.arange(len(values)) - np.repeat(starts, size)
        out = np.add.reduceat((values + FACTOR) * _powers(int(size.max()))[place], starts)
        out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


class WordCodes:
    """The words of many texts at once, as 64-bit digests: runs of letters and digits, letter case ignored."""

    def __init__(self) -> None:
        self.solid = np.fromiter((chr(o).isalnum() for o in range(BMP)), bool, BMP)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(digests of the words of all texts in order, number of words of each text)."""
        low = [t.lower() for t in texts]
        code = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        solid = self.solid[np.minimum(code, BMP - 1)]
        far = np.flatnonzero(code >= BMP)
        if len(far):
            kinds, which = np.unique(code[far], return_inverse=True)
            solid[far] = np.array([chr(o).isalnum() for o in kinds])[which]
        inside = np.flatnonzero(solid)
        starts = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
        word = run_digest(code[inside].astype(np.uint64), starts, np.append(starts[1:], len(inside)))
        ends = np.cumsum([len(t) + 1 for t in low])
        return word, np.bincount(np.searchsorted(ends, inside[starts], side="right"), minlength=len(texts))
