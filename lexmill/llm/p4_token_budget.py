"""Problem 4: token counts per document, and totals per source, language and domain.

The tokenizer is a table of byte-level merges. It cuts a text into words by one pattern and merges within words only,
so the words are independent and so are two halves of a text cut between two words. Oversized texts are cut at such
places into chunks that are dealt to all workers; each chunk's count is exact and the counts of a document add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import LANGUAGE_NAMES, language_code, slice_name, spread, table, written
from lexmill.operators.tokens import byte_letters
from lexmill.plans.oracle import MERGED, WS

#: Words of the tokenizer: ` ?letters`, ` ?digits`, ` ?other marks`, blanks.
WORDS = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")
#: No word has a blank after a non-blank, and none has two of letters, digits and other marks: words end at these places.
PROVEN = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}])(?=[\p{L}\p{N}])")
CHUNK = 50_000
#: At most so many words' counts are kept by a worker; others are counted again.
CACHE = 500_000
#: Words of more bytes are merged with a heap.
LONG_WORD = 200
#: A merge table may be sent to the workers up to this many rows (a tokenizer's vocabulary has an end).
MAX_MERGES = 1_000_000


class Merges:
    """A byte-level BPE given by its ranked merges; counts tokens of words."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.rank = {p: i for i, p in reversed([*enumerate(pairs)])}  # of a repeated pair the first counts
        self.byte = byte_letters()
        self.known: dict[str, int] = {}

    def encode(self, word: str) -> list[str]:
        """The tokens of one word; always the pair of lowest rank is merged next, everywhere in the word."""
        parts = [self.byte[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(parts) > LONG_WORD:
            return self.encode_long(parts)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def encode_long(self, parts: list[str | None]) -> list[str]:
        """The same for a long word: pairs wait in a heap by rank and place, neighbours are linked."""
        n = len(parts)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:  # merged meanwhile
                continue
            parts[i], parts[j], right[i] = a + b, None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (r := self.rank.get((parts[p], parts[q]))) is not None:
                    heappush(heap, (r, p, parts[p], parts[q]))
        return [p for p in parts if p is not None]

    def count(self, text: str) -> int:
        known, n = self.known, 0
        for w in WORDS.findall(text):
            k = known.get(w)
            if k is None:
                k = len(self.encode(w))
                if len(known) < CACHE and len(w) < 64:
                    known[w] = k
            n += k
        return n


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """The text in pieces of about `size`, cut only at proven boundaries; longer ones where there is no such place."""
    out, at, n = [], 0, len(text)
    while n - at > size:
        m = PROVEN.search(text, at + size)
        if not m or m.start() <= at:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def load_merges(spark: SparkSession, merges: DataFrame) -> list[tuple[str, str]]:
    n = merges.count()
    if n > MAX_MERGES:
        raise ValueError(f"{n} merges; a tokenizer with more than {MAX_MERGES} isn't sent to the workers")
    return [(r[0], r[1]) for r in merges.orderBy("rank_no").select("first_piece", "second_piece").collect()]


def token_counts(df: DataFrame, merges: list[tuple[str, str]], text_col: str = "text", out: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """df with the exact number of tokens of each text; null for a null text, 0 for an empty one.

    Every other column passes through, a column named like `out` is replaced. Texts up to `chunk` characters are counted
    where they lie; longer ones are cut at proven boundaries, and their chunks are salted over all workers.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(merges)
    kept: dict[str, Merges] = {}

    def model() -> Merges:
        if "m" not in kept:
            kept["m"] = Merges(shared.value)
        return kept["m"]

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model()
        for s in batches:
            yield pd.Series([None if t is None else m.count(t) for t in s], dtype="Int64")

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunks(t, chunk))

    df = df.drop(out)
    is_long = F.coalesce(F.length(text_col) > chunk, F.lit(False))
    short = spread(df.where(~is_long)).withColumn(out, count(F.col(text_col)))
    rest = df.columns
    key = "_whole"
    long = written(df.where(is_long).withColumn(key, F.struct(*rest)).select(F.monotonically_increasing_id().alias("_k"), key))
    part = long.select("_k", F.posexplode(cut(F.col(f"{key}.{text_col}"))).alias("_p", "_t"))
    n = spark.sparkContext.defaultParallelism
    salted = part.repartition(max(n, 1), F.xxhash64("_k", "_p"))
    sums = salted.select("_k", count("_t").alias("_n")).groupBy("_k").agg(F.sum("_n").alias(out))
    return short.unionByName(long.join(sums, "_k").select(f"{key}.*", out))


def slice_totals(df: DataFrame, n: str = "n_tokens") -> DataFrame:
    """Documents and tokens per (source, language, domain), with the roll-ups of each and the grand total.

    level names the columns that are grouped ('source+language+domain', 'source', 'language', 'domain', 'all'). All
    spellings of a value make one slice, null and blank another: it has a null value. A null count adds nothing.
    """
    df = df.select(slice_name(F.col("source")).alias("source"), language_code(F.col("language")).alias("language"), slice_name(F.col("domain")).alias("domain"), F.col(n).alias("t"))
    base = df.groupBy("source", "language", "domain").agg(F.count("*").alias("n_docs"), F.count("t").alias("n_texts"), F.sum("t").alias("n_tokens"))
    one, none = ["source", "language", "domain"], {7: "all", 3: "source", 5: "language", 6: "domain", 0: "source+language+domain"}
    sets = base.groupingSets([[F.col(c) for c in one], *[[F.col(c)] for c in one], []], *one).agg(
        F.grouping_id().alias("g"), F.sum("n_docs").alias("n_docs"), F.sum("n_texts").alias("n_texts"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
    )
    level = F.create_map(*[F.lit(x) for kv in none.items() for x in kv])[F.col("g").cast("int")]
    return sets.select(level.alias("level"), *one, "n_docs", "n_texts", "n_tokens")


def _counted(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    merges = load_merges(spark, table(spark, sf_dir, "bpe_merges"))
    return token_counts(table(spark, sf_dir, "english", *columns), merges)


def p4_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slice_totals(_counted(spark, sf_dir, "source", "language", "domain", "text"))


def p4_doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "row_id", "text").select("row_id", "n_tokens")


_COUNTED = f"""
WITH RECURSIVE e AS (SELECT row_id, source, language, domain, text, regexp_extract_all(text, ' ?\\p{{L}}+| ?\\p{{N}}+| ?[^{WS[1:-1]}\\p{{L}}\\p{{N}}]+|{WS}+') AS w FROM english), d AS (SELECT DISTINCT unnest(w) AS word FROM e), {MERGED},
x AS (SELECT row_id, sum(k)::BIGINT AS k FROM (SELECT row_id, unnest(w) AS word FROM e) JOIN n USING (word) GROUP BY row_id),
c AS (SELECT e.row_id, source, language, domain, CASE WHEN text IS NOT NULL THEN coalesce(k, 0) END AS n_tokens FROM e LEFT JOIN x ON e.row_id = x.row_id)
"""
_SLICE = "nullif(regexp_replace(lower(trim({0}, ' ')), '[\\s_\\-]+', '_', 'g'), '')"
SQL = {
    "p4_doc_tokens": _COUNTED + "SELECT row_id, n_tokens FROM c",
    "p4_token_budget": _COUNTED + f""", v AS (SELECT {_SLICE.format('source')} AS source, regexp_extract(lower(trim(language, ' ')), '^([a-z]+)', 1) AS l, {_SLICE.format('domain')} AS domain, n_tokens AS t FROM c),
z AS (SELECT source, domain, t, CASE l WHEN {' WHEN '.join(f"'{k}' THEN '{x}'" for k, x in LANGUAGE_NAMES.items())} WHEN '' THEN NULL ELSE l END AS language FROM v)
SELECT CASE grouping(source, language, domain) WHEN 0 THEN 'source+language+domain' WHEN 3 THEN 'source' WHEN 5 THEN 'language' WHEN 6 THEN 'domain' ELSE 'all' END AS level, source, language, domain,
  count(*) AS n_docs, count(t) AS n_texts, coalesce(sum(t), 0)::BIGINT AS n_tokens FROM z GROUP BY GROUPING SETS ((source, language, domain), (source), (language), (domain), ())""",
}
