"""Problem 3: one consistent form for texts that look the same.

Texts are exploded to positioned code points (arrays of a whole batch), joined with a broadcast table of decompositions
and look-alikes (bounded by the size of Unicode), runs of combining marks are put in order of their class, and the
strings are recomposed and rebuilt. The table is derived from the Unicode data of Python; only look-alike letters,
which that data lacks, are listed here.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import spread, table, written

#: Letters that look like a Latin letter in common fonts, and the Latin letters (fixed values).
CYRILLIC = "АВЕЅЈІКМНОРСТУХаеіјорсухѕһԁԛԝӏ"
CYRILLIC_AS = "ABESJIKMHOPCTYXaeijopcyxshdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXocj"
OTHER = "օսհɑɡıⅼ"
OTHER_AS = "ouhagil"
#: Radical forms without a decomposition, and the characters they look like (fixed values).
RADICALS = "⺁⺇⺌⺍⺎⺏⺐⺒⺓⺝⺟⺠⺡⺦⺨⺩⺪⺮⺯⺲⺶⺷⺹⺺⺼⺽⻀⻁⻄⻅⻆⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻠⻢⻣⻤⻥⻦⻧⻨⻩⻫⻬⻮⻯⻰⻳"
RADICALS_AS = "厂几小小兀尣尢巳幺月母民氵丬犭王疋竹糸罒羊羊耂肀月臼艹虎西见角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食饣马骨鬼鱼鸟卤麦黄斉齐歯竜龙龟"
#: Compatibility decompositions that make no visible difference; raised, lowered, circled, fraction and font forms do.
SAME = {"<wide>", "<narrow>", "<noBreak>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>"}
BLANK = " "
#: Characters that are handled as arrays at once; longer texts are an array of their own.
AT_ONCE = 1_000_000
#: Combining marks stand from here on.
FIRST_MARK = 0x300


def _plain(c: str) -> str | None:
    """What a single character is replaced with before composition; None if it stays."""
    kind = unicodedata.category(c)
    if kind == "Cf" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if kind == "Zs":
        return BLANK
    d = unicodedata.decomposition(c)
    if not d or d.startswith("<"):
        tag, *codes = d.split() if d else [""]
        to = "".join(chr(int(x, 16)) for x in codes)
        radical = "⺀" <= c <= "\u2fdf"
        if tag in SAME or tag == "<compat>" and (radical or kind[0] == "L" and "Ā" <= c < "℀" or c == "µ" or c in "℃℉" or "ﬀ" <= c <= "ﬆ"):
            return unicodedata.normalize("NFD", "".join(_plain(x) if _plain(x) is not None else x for x in to))
    d = unicodedata.normalize("NFD", c)
    return d if d != c else None


@cache
def mapping() -> dict[int, str]:
    """Code point -> replacement, for every code point that has one; at most as large as Unicode."""
    out: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= o <= 0xD7A3 or 0xD800 <= o <= 0xDFFF:  # Hangul is composed by rule; lone surrogates stay
            continue
        to = _plain(chr(o))
        if to is not None:
            out[o] = to
    for a, b in zip(CYRILLIC + GREEK + OTHER + RADICALS, CYRILLIC_AS + GREEK_AS + OTHER_AS + RADICALS_AS, strict=True):
        out[ord(a)] = b
    for o, to in [*out.items()]:  # look-alikes with accents and width: the base letter is looked up again
        out[o] = "".join(out.get(ord(x), x) if ord(x) != o else x for x in to)
    return out


@cache
def compositions() -> dict[tuple[int, int], int]:
    """(letter, mark) -> composed letter, for every pair that Unicode composes again; not those that it leaves apart."""
    out = {}
    for o in range(0xC0, sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(o)) if not 0xAC00 <= o <= 0xD7A3 else ""
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(o)) == chr(o):
            a, b = d.split()
            out[int(a, 16), int(b, 16)] = o
    return out


class Canonical:
    """The mapping as arrays: the replacement of code point o is pool[start[o]:start[o] + size[o]]."""

    def __init__(self, table: dict[int, str]):
        n = sys.maxunicode + 1
        self.size = np.ones(n, np.uint8)
        self.start = np.arange(n, dtype=np.int32)
        pool = [np.arange(n, dtype=np.uint32)]
        at = n
        for o, to in table.items():
            codes = np.array([ord(c) for c in to], np.uint32)
            self.start[o], self.size[o] = at, len(codes)
            pool.append(codes)
            at += len(codes)
        self.pool = np.concatenate(pool)
        self.single = self.pool[self.start]  # of those with one code point
        self.multi = self.size != 1
        #: the class of each combining mark, and what may join the character before it
        self.order = np.zeros(n, np.uint8)
        for o in range(FIRST_MARK, n):
            if not 0xD800 <= o <= 0xDFFF and (k := unicodedata.combining(chr(o))):
                self.order[o] = k
        self.pairs = compositions()
        self.joins = self.order > 0
        self.joins[0x1161:0x11C3] = True  # Hangul parts
        self.joins[[b for _, b in self.pairs]] = True

    def forms(self, texts: list[str]) -> Iterator[str]:
        """The canonical forms of texts, in arrays of bounded size."""
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > AT_ONCE:
                yield from self.batch(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        yield from self.batch(part)

    def batch(self, texts: list[str]) -> list[str]:
        """The canonical forms of many texts at once."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, int)
        some = self.multi[code]
        if not some.any():
            new, stops = self.single[code], ends
        else:
            size = np.where(some, self.size[code], 1).astype(np.int64)
            upto = np.cumsum(size)
            first = np.repeat(self.start[code].astype(np.int64) - (upto - size), size)
            new = self.pool[first + np.arange(len(first))]
            stops = np.concatenate([[0], upto])[ends]
        out = new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        joins = self.joins[new]
        if not joins.any():
            return [out[a:b] for a, b in zip(starts, stops)]
        starts_here = np.zeros(len(new), bool)
        starts_here[starts[starts < len(new)]] = True
        new = self.ordered(new, starts_here)
        joins = self.joins[new] & ~starts_here  # nothing joins the text before
        has = np.concatenate([[0], np.cumsum(joins)])
        return [self.composed(new[a:b], joins[a:b]) if has[b] > has[a] else out[a:b] for a, b in zip(starts, stops)]

    def ordered(self, code: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The code points with each run of combining marks in the order of their classes, equal ones as they stood; a run ends where a text begins."""
        at = np.flatnonzero(self.order[code])
        if not len(at):
            return code
        run = np.cumsum(np.concatenate([[0], (np.diff(at) != 1) | begins[at[1:]]]))
        code = code.copy()
        code[at] = code[at[np.lexsort((self.order[code[at]], run))]]
        return code

    def composed(self, code: np.ndarray, joins: np.ndarray) -> str:
        """The text with marks and Hangul parts joined to the letters before them; only the places where one stands are looked at."""
        out = code.tolist()
        for i in np.flatnonzero(joins).tolist():
            # the last letter before; marks between of the same class or a higher one are in the way
            k, c = i - 1, int(self.order[out[i]])
            while k >= 0 and (out[k] < 0 or self.order[out[k]]):
                k -= 1
            between = [out[j] for j in range(k + 1, i) if out[j] >= 0]
            if k < 0 or any(self.order[x] >= c for x in between):
                continue
            a, b = out[k], out[i]
            if 0x1100 <= a <= 0x1112 and 0x1161 <= b <= 0x1175:
                to = 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28
            elif 0xAC00 <= a <= 0xD7A3 and (a - 0xAC00) % 28 == 0 and 0x11A8 <= b <= 0x11C2:
                to = a + b - 0x11A7
            else:
                to = self.pairs.get((a, b))
            if to is not None:
                out[k], out[i] = to, -1
        return np.array([x for x in out if x >= 0], "<u4").tobytes().decode("utf-32-le", "surrogatepass")


def canonical(df: DataFrame, text_col: str = "text", out: str = "canonical") -> DataFrame:
    """df with the consistent form of each text; null for null, the empty text stays empty.

    Letters, digits and marks take their ordinary width, single blanks of any kind are a space, invisible characters
    go, accents are composed, look-alike letters and Han forms become one. Raised, lowered, circled and fraction digits,
    line breaks and the number of blanks stay. Other columns pass through; a column named like `out` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(mapping())
    kept: dict[str, Canonical] = {}

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if "c" not in kept:
            kept["c"] = Canonical(shared.value)
        c = kept["c"]
        for s in batches:
            null = s.isna()
            made = c.forms(s[~null].tolist())
            yield pd.Series([None if x else next(made) for x in null], dtype=object)

    return spread(df.drop(out)).withColumn(out, form(F.col(text_col)))


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, f1, f2, t1, t2): 128 bits of each text's form and of the text; null texts and ids are left out."""
    two = lambda c: [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]
    f = canonical(df.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col(id_col).isNotNull()))
    (f1, f2), (t1, t2) = two("canonical"), two("text")
    return written(f.select("row", f1.alias("f1"), f2.alias("f2"), t1.alias("t1"), t2.alias("t2")))


def look_alike_classes(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row, class, n_rows, n_links): of every row whose text looks like another string its class (the smallest row), the
    rows of the class, and how many of them are different strings.

    Forms that occur as one string only are left out. Counts are aggregated map-side: a form with a third of all rows
    is never gathered. Null texts and ids are left out, repeated rows count each.
    """
    h = _hashed(df, id_col, text_col)
    texts = h.groupBy("f1", "f2", "t1", "t2").agg(F.min("row").alias("lo"), F.count("*").alias("k"))
    forms = texts.groupBy("f1", "f2").agg(F.min("lo").alias("class"), F.sum("k").alias("n_rows"), F.count("*").alias("strings")).where("strings > 1").drop("strings")
    sizes = written(texts.join(forms, ["f1", "f2"]).select("f1", "f2", "t1", "t2", "class", "n_rows", (F.col("n_rows") - F.col("k")).alias("n_links")))
    return h.join(sizes, ["f1", "f2", "t1", "t2"]).select("row", "class", "n_rows", "n_links")


def same_looking(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows whose texts are different strings with the same canonical form.

    The classes written out as pairs; their number is that of the links, so a large corpus takes look_alike_classes.
    """
    h = _hashed(df, id_col, text_col)
    several = h.groupBy("f1", "f2").agg(F.min("t1").alias("lo1"), F.max("t1").alias("hi1"), F.min("t2").alias("lo2"), F.max("t2").alias("hi2"))
    several = several.where((F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2"))).select("f1", "f2")
    h = written(h.join(several, ["f1", "f2"], "left_semi"))
    b = h.toDF(*[f"{c}_b" for c in h.columns])
    pair = (h.f1 == b.f1_b) & (h.f2 == b.f2_b) & (h.row < b.row_b) & ((h.t1 != b.t1_b) | (h.t2 != b.t2_b))
    return h.join(b, pair).select(F.col("row").alias("row_a"), F.col("row_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [same_looking(table(spark, sf_dir, t, "row_id", "text")).select(F.lit(t).alias("tab"), "row_a", "row_b") for t in ("natural_zh", "article_zh")]
    return parts[0].unionByName(parts[1])


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [canonical(table(spark, sf_dir, t, "row_id", "text")).select(F.lit(t).alias("tab"), "row_id", F.col("canonical").alias("text")) for t in ("natural_zh", "article_zh")]
    return parts[0].unionByName(parts[1])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [look_alike_classes(table(spark, sf_dir, t, "row_id", "text")).select(F.lit(t).alias("tab"), F.col("row").alias("row_id"), "class", "n_rows", "n_links") for t in ("natural_zh", "article_zh")]
    return parts[0].unionByName(parts[1])


def _form_sql() -> str:
    """c: (tab, row_id, text, f) with the canonical form of each text, character by character; the table is made of the mapping."""
    values = ", ".join(f"({o}, '{to.replace(chr(39), chr(39) * 2)}')" for o, to in mapping().items())
    return f"""
WITH m(o, v) AS (VALUES {values}), t AS (SELECT 'natural_zh' AS tab, row_id, text FROM natural_zh UNION ALL SELECT 'article_zh', row_id, text FROM article_zh),
p AS (SELECT tab, row_id, unnest(range(1, length(text) + 1)) AS i, text FROM t), x AS (SELECT tab, row_id, i, substr(text, i::INTEGER, 1) AS ch FROM p),
s AS (SELECT tab, row_id, nfc_normalize(string_agg(coalesce(v, ch), '' ORDER BY i)) AS f FROM x LEFT JOIN m ON o = unicode(ch) GROUP BY tab, row_id),
c AS (SELECT t.tab, t.row_id, text, CASE WHEN text IS NOT NULL THEN coalesce(f, '') END AS f FROM t LEFT JOIN s ON t.tab = s.tab AND t.row_id = s.row_id)
"""


def sql() -> dict[str, str]:
    form = _form_sql()
    return {
        "p3_canonical": form + "SELECT tab, row_id, f AS text FROM c",
        "p3_found": form + "SELECT a.tab, a.row_id AS row_a, b.row_id AS row_b FROM c a JOIN c b ON a.tab = b.tab AND a.f = b.f AND a.text <> b.text AND a.row_id < b.row_id",
        "p3_classes": form + """, k AS (SELECT tab, f, text, count(*) AS k, min(row_id) AS lo FROM c WHERE f IS NOT NULL GROUP BY ALL),
g AS (SELECT tab, f, min(lo) AS class, sum(k)::BIGINT AS n_rows FROM k GROUP BY tab, f HAVING count(*) > 1)
SELECT c.tab, c.row_id, class, n_rows, n_rows - k.k AS n_links FROM c JOIN g ON c.tab = g.tab AND c.f = g.f JOIN k ON k.tab = c.tab AND k.f = c.f AND k.text = c.text""",
    }
