"""Problem 10: the subject areas of each document.

Weighted subject terms are taken from labelled rows: English words and pairs of Han characters that are much more
frequent under one subject than elsewhere. A multi-pattern automaton finds the terms of a document, their weights
(rarity times strength of association) are summed per sentence, a sentence counts for the subject that stands out, and
a document gets every subject whose share of its sentences passes a threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import slice_name, spread, table

#: Labelled rows per table that the terms are fitted on, at most; those of smallest hash are taken.
FIT_ROWS = 20_000
#: A term is kept from so many labelled rows on, if its strongest subject has at least this share of it.
MIN_ROWS, MIN_SHARE = 5, 0.3
#: A sentence counts for a subject from this sum of weights on, if no other subject comes within the margin.
SENTENCE, MARGIN = 1.6, 0.7
#: ... and from so many different terms on that speak for the subject.
SUPPORT = 2
#: The share of a document's sentences from which on it is about a subject: between a passing mention (an eighth) and a fifth.
SHARE = 0.175

#: Documents whose terms are counted at once.
AT_ONCE = 500

HAN = "㐀-䶿一-鿿"
TOKENS = re.compile(rf"[a-z]+(?:[-'][a-z]+)*|[{HAN}]+")
#: Sentences end at these marks; a point between digits is none.
SENTENCE_END = re.compile(r"(?:[。！？!?；;\n]|(?<!\d)\.|\.(?!\d))[\s」』”’）)】》\"'.!?。！？；;]*")
LETTER = re.compile(rf"[^\W\d_]")


def terms_of(text: str) -> set[str]:
    """The distinct candidate terms of a text: words in lower case, pairs of adjacent Han characters."""
    out: set[str] = set()
    for w in TOKENS.findall(text.lower()):
        if w[0] < "㐀":
            out.add(w)
        else:
            out.update(w[i : i + 2] for i in range(len(w) - 1))
    return out


class Lexicon:
    """Terms and their weights for each subject; its automaton is built where it is used."""

    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (subject, text) of labelled texts."""
        docs = Counter(s for s, _ in rows)
        self.subjects = sorted(docs)
        k = {s: i for i, s in enumerate(self.subjects)}
        seen: dict[str, np.ndarray] = {}
        size = np.zeros((len(k), 2))  # labelled texts by subject and script: a term is compared within its script
        for s, text in rows:
            terms = terms_of(text)
            zh = sum(t[0] >= "㐀" for t in terms) * 2 > len(terms)
            size[k[s], int(zh)] += 1
            for t in terms:
                if t not in seen:
                    seen[t] = np.zeros(len(k))
                seen[t][k[s]] += 1
        self.terms, weights = [], []
        for t, n in sorted(seen.items()):
            if n.sum() < MIN_ROWS:
                continue
            per = (n + 0.05) / np.maximum(size[:, int(t[0] >= "㐀")], 1)
            share = per / per.sum()
            if share.max() >= max(MIN_SHARE, 1.5 / len(k)):
                rarity = 1 / (1 + max(0.0, math.log10(max(per.mean(), 1e-9) * 10)))  # a term found everywhere counts less
                self.terms.append(t)
                weights.append(np.maximum(np.log(share * len(k)), -1.0) * min(1.0, rarity))
        self.weights = np.array(weights) if weights else np.zeros((0, len(k)))

    def data(self) -> tuple[list[str], list[str], np.ndarray]:
        return self.subjects, self.terms, self.weights

    @classmethod
    def of(cls, data: tuple[list[str], list[str], np.ndarray]) -> Lexicon:
        out = cls.__new__(cls)
        out.subjects, out.terms, out.weights = data
        return out

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            a.add_word(t, (i, len(t), t[0] < "㐀"))
        if self.terms:
            a.make_automaton()
        return a


def sentence_starts(text: str) -> list[int]:
    """Where the sentences begin that hold a letter."""
    out, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if LETTER.search(text, at, m.start()):
            out.append(at)
        at = m.end()
    if LETTER.search(text, at):
        out.append(at)
    return out


def document_subjects(texts: list[str], lexicon: Lexicon, automaton) -> tuple[np.ndarray, np.ndarray]:
    """(sentences per text and subject, sentences per text) of a batch."""
    n_s = len(lexicon.subjects)
    starts, term, where = [], [], []
    base = 0
    sizes = np.zeros(len(texts), int)
    for d, text in enumerate(texts):
        low = text.lower()
        if len(low) != len(text):  # rare letters whose lower case is longer
            text = low
        s = sentence_starts(text)
        sizes[d] = len(s)
        ends = np.array(s)
        at, ids = [], []
        for end, (i, n, word) in automaton.iter(low) if lexicon.terms else ():
            if word:
                a, b = end - n, end + 1
                if a >= 0 and low[a].isalpha() and low[a] < "㐀" or b < len(low) and low[b].isalpha() and low[b] < "㐀":
                    continue
            at.append(end)
            ids.append(i)
        if ids and s:
            k = np.searchsorted(ends, at, side="right") - 1
            term.append(np.array(ids))
            where.append(np.maximum(k, 0) + base)
        base += len(s)
    counts = np.zeros((len(texts), n_s), int)
    if term:
        where, term = np.concatenate(where), np.concatenate(term)
        # one sentence counts a term once: a repeated word is no further evidence
        once = np.unique(where.astype(np.int64) * len(lexicon.terms) + term)
        where, term = once // len(lexicon.terms), once % len(lexicon.terms)
        score = np.stack([np.bincount(where, weights=lexicon.weights[term, s], minlength=base) for s in range(n_s)], axis=1)
        best = score.argmax(axis=1)
        two = np.partition(score, -2, axis=1)[:, -2:] if n_s > 1 else np.stack([np.full(base, -9.0), score[:, 0]], axis=1)
        # one word alone may stand in a sentence on nothing of the kind
        support = np.bincount(where, weights=lexicon.weights[term, best[where]] > 0, minlength=base)
        sure = (two[:, 1] >= SENTENCE) & (two[:, 1] - two[:, 0] >= MARGIN) & (support >= SUPPORT)
        doc = np.repeat(np.arange(len(texts)), sizes)
        np.add.at(counts, (doc[sure], best[sure]), 1)
    return counts, sizes


def fit(labelled: list[DataFrame], fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from tables (subject, text, key), at most fit_rows rows of each; blank subjects and null texts are left out."""
    rows: list[tuple[str, str]] = []
    for df in labelled:
        df = df.select(slice_name(F.col("subject")).alias("subject"), "text", "key").where(F.col("subject").isNotNull() & F.col("text").isNotNull())
        # by hash about as many as wanted, then exactly: what a task sends to the driver doesn't grow with the table
        n, scale, h = df.count(), 1 << 30, F.xxhash64("key")
        if n > fit_rows:
            df = df.where(F.pmod(h, F.lit(scale)) < int(scale * min(1.0, 1.1 * fit_rows / n + 100 / n)))
        rows += [(r["subject"], r["text"]) for r in df.orderBy(h, "key").limit(fit_rows).collect()]
    return Lexicon(rows)


def subjects(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, subject, n_sentences, share, n_chars): one row per document and subject it is about.

    Null texts, texts without letters and texts without a subject have no row; repeated rows count as often as they occur.
    """
    sent = df.sparkSession.sparkContext.broadcast(lexicon.data())  # bounded by the rows it was fitted on
    kept: dict[str, object] = {}

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "a" not in kept:
            kept["l"] = Lexicon.of(sent.value)
            kept["a"] = kept["l"].automaton()
        lex = kept["l"]
        for pdf in (b[i : i + AT_ONCE] for b in batches for i in range(0, len(b), AT_ONCE)):
            counts, sizes = document_subjects(pdf["text"].tolist(), lex, kept["a"])
            ratio = counts / np.maximum(sizes, 1)[:, None]
            d, s = np.nonzero((ratio >= share) & (counts > 0))
            if not len(d):
                continue
            yield pd.DataFrame({"doc_id": pdf["id"].to_numpy()[d], "subject": [lex.subjects[i] for i in s], "n_sentences": counts[d, s], "share": ratio[d, s], "n_chars": pdf["text"].str.len().to_numpy()[d]})

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col(id_col).isNotNull())
    return spread(texts).mapInPandas(label, "doc_id long, subject string, n_sentences int, share double, n_chars long")


def _lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return fit([
        table(spark, sf_dir, "subject_examples").select("subject", "text", F.col("example_id").alias("key")),
        *(table(spark, sf_dir, t).select(F.col("domain").alias("subject"), "text", F.col("row_id").alias("key")) for t in ("english", "natural_zh")),
    ])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects(table(spark, sf_dir, "documents", "doc_id", "text"), _lexicon(spark, sf_dir)).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters per subject."""
    df = subjects(table(spark, sf_dir, "documents", "doc_id", "text"), _lexicon(spark, sf_dir))
    return df.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
