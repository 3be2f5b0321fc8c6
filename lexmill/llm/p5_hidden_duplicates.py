"""Problem 5: duplicates hidden by formatting differences.

Records are dictionary-encoded: each distinct field as it stands is canonicalised once and gets the integer of its
canonical form from a dictionary table; a record becomes the sorted tuple of the integers of its (label, value) fields,
and the compact tuples are grouped.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import spread, table, written

#: Punctuation that is content, and symbols that separate or mark list items (fixed values).
CONTENT, MARKS = "%‰‱&@§¶†‡", "|<>=~^`¦→←↑↓⇒⇨➔➜➤►▶▸▹▪▫■□▲△▼▽◆◇○●◦★☆✓✔✗✘∙⋅∎"
#: What ends a field, and what a label looks like: it begins a field, is short and without digits.
FIELD_END = re.compile(r"[\n\r;；|｜]")
LABEL = re.compile(r"[^\w:：]*([^\W\d][^\d:：.。,，!！?？()（）]{0,39}?)\s*[:：]")
DECIMAL = re.compile(r"(?<=\d)\.(?=\d)")
POINT = "\ufdd0"


def dropped() -> dict[int, str | None]:
    """Code points that don't count: blanks, line breaks, punctuation and separating symbols."""
    out: dict[int, str | None] = {ord(c): None for c in MARKS}
    for o in range(sys.maxunicode + 1):
        c = chr(o)
        if c.isspace() or unicodedata.category(c)[0] == "P" and c not in CONTENT:
            out[o] = None
    out[ord(POINT)] = "."
    return out


class Encoder:
    """Gives the digest of the canonical form of a (label, value) field."""

    def __init__(self) -> None:
        self.drop = dropped()

    def canon(self, s: str) -> str:
        return DECIMAL.sub(POINT, s).translate(self.drop).lower()

    def digest(self, label: str, value: str) -> tuple[int, int]:
        raw = hashlib.blake2b(f"{self.canon(label)}\x1f{self.canon(value)}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return int.from_bytes(raw[:8], "big", signed=True), int.from_bytes(raw[8:], "big", signed=True)


def fields(text: str) -> list[tuple[str, str]]:
    """The (label, value) fields of a text made of them, two at least; else the one field ('', text).

    A field ends at a line break, semicolon or bar; a part without a label goes on the field before it.
    """
    if ":" not in text and "：" not in text:
        return [("", text)]
    out: list[list[str]] = []
    for part in FIELD_END.split(text):
        m = LABEL.match(part)
        if m:
            out.append([m[1], part[m.end() :]])
        elif out:
            out[-1][1] += part
        elif part.strip():
            return [("", text)]
    return [(a, b) for a, b in out] if len(out) > 1 else [("", text)]


def encoded(df: DataFrame, id_col: str = "row_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., row, code): each record as the sorted tuple of its fields' integers. Null texts and ids are left out;
    repeated rows with the same keep and id are one record each.

    Only texts with a colon can be made of fields and are read in Python for it. Fields as they stand are told apart by
    128 bits; one of each kind is moved and canonicalised, and gets the integer of its form. A value held by a third of
    all rows is one row of the dictionary, counted by map-side aggregation; the joins with it are split by adaptive skew
    handling and carry integers only.
    """
    made: dict[str, Encoder] = {}

    @F.pandas_udf("array<struct<a:string,b:string>>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"a": a, "b": b} for a, b in fields(t)])

    @F.pandas_udf("struct<hi:long,lo:long>")
    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = made.setdefault("e", Encoder())
        for pdf in batches:
            yield pd.DataFrame([e.digest(a, b) for a, b in zip(pdf["a"], pdf["b"])], columns=["hi", "lo"])

    rows = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = spread(rows.select(*keep, F.col(id_col).alias("row"), F.col(text_col).alias("text"))).withColumn("rec", F.monotonically_increasing_id())
    colon = F.col("text").rlike("[:：]")
    plain = rows.where(~colon).select(*keep, "row", "rec", F.lit("").alias("a"), F.col("text").alias("b"))
    made_of = rows.where(colon).select(*keep, "row", "rec", F.explode(cut("text")).alias("f")).select(*keep, "row", "rec", "f.a", "f.b")
    each = plain.unionByName(made_of).select(*keep, "row", "rec", F.xxhash64("a", "b").alias("h1"), F.xxhash64(F.lit("second"), "a", "b").alias("h2"), "a", "b")
    kinds = each.groupBy("h1", "h2").agg(F.first(F.struct("a", "b")).alias("v")).select("h1", "h2", digests(F.struct(F.col("v.a").alias("a"), F.col("v.b").alias("b"))).alias("d")).select("h1", "h2", "d.hi", "d.lo")
    kinds = written(kinds)
    codes = kinds.select("hi", "lo").distinct().select("hi", "lo", F.monotonically_increasing_id().alias("code"))
    dictionary = written(kinds.join(codes, ["hi", "lo"]).select("h1", "h2", "code"))
    coded = each.drop("a", "b").join(dictionary, ["h1", "h2"])
    return coded.groupBy(*keep, "row", "rec").agg(F.sort_array(F.collect_list("code")).alias("code")).drop("rec")  # as many as the record has fields


def copies(codes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., keep_row, copy_row) for each set of equal records: the smallest row with each of the others.

    Sets are counted with map-side aggregation and never gathered; only records of sets with more than one row are joined.
    """
    codes = written(codes)  # of rows with a given id and equal text, each is a copy but the first
    first = codes.groupBy(*keep, "code").agg(F.min("row").alias("keep_row"), F.count("*").alias("n")).where("n > 1").drop("n")
    return codes.join(first, [*keep, "code"]).where(F.col("row") != F.col("keep_row")).select(*keep, "keep_row", F.col("row").alias("copy_row"))


def distinct_records(codes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., keep_row, n_copies): one row per distinct record, with how many rows hold it."""
    return codes.groupBy(*keep, "code").agg(F.min("row").alias("keep_row"), F.count("*").alias("n_copies")).drop("code")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t, "row_id", "text").select(F.lit(t).alias("tab"), "row_id", "text") for t in ("article_en", "natural_zh")]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(encoded(_texts(spark, sf_dir), keep=("tab",)), ("tab",))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_records(encoded(_texts(spark, sf_dir), keep=("tab",)), ("tab",))


def _canon_sql(x: str) -> str:
    """The canonical form of a value: points between digits and content marks get a stand-in before the marks go."""
    point = f"regexp_replace(regexp_replace({x}, '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1\ufdd0\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1\ufdd0\\2', 'g')"
    content = "".join(chr(0xE000 + i) for i in range(len(CONTENT)))
    marks = "".join("\\" + c if c in "|^\\]" else c for c in MARKS)
    blanks = "\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    return f"lower(regexp_replace(translate({point}, '{CONTENT}', '{content}'), '[{blanks}\\p{{P}}{marks}]', '', 'g'))"


_LABEL_SQL = "^[^\\p{L}\\p{N}_:：]*([\\p{L}\\p{Nl}\\p{No}_][^\\p{Nd}:：.。,，!！?？()（）]{0,39}?)[\\s\\x{a0}\\x{3000}]*[:：]"
_FOLD_SQL = f"""
WITH t AS (SELECT 'article_en' AS tab, row_id, text FROM article_en WHERE text IS NOT NULL UNION ALL SELECT 'natural_zh', row_id, text FROM natural_zh WHERE text IS NOT NULL),
f AS (SELECT tab, row_id, text, list_reduce(string_split_regex(text, '[\\n\\r;；|｜]'), lambda a, p: CASE
  WHEN contains(a, chr(3)) THEN a WHEN regexp_matches(p, '{_LABEL_SQL}') THEN a || chr(2) || regexp_extract(p, '{_LABEL_SQL}', 1) || chr(1) || regexp_replace(p, '{_LABEL_SQL}', '')
  WHEN a <> '' THEN a || p WHEN {_canon_sql("p")} = '' AND trim(p) = '' THEN a ELSE chr(3) END, '') AS x FROM t),
c AS (SELECT tab, row_id, CASE WHEN contains(x, chr(3)) OR len(string_split(x, chr(2))) < 3 THEN [chr(1) || {_canon_sql("text")}]
  ELSE list_sort(list_transform(string_split(x, chr(2))[2:], lambda y: {_canon_sql("split_part(y, chr(1), 1)")} || chr(1) || {_canon_sql("split_part(y, chr(1), 2)")})) END AS form FROM f)
"""
SQL = {
    "p5_found": _FOLD_SQL + "SELECT tab, keep_row, row_id AS copy_row FROM (SELECT tab, row_id, min(row_id) OVER (PARTITION BY tab, form) AS keep_row FROM c) WHERE keep_row <> row_id",
    "p5_records": _FOLD_SQL + "SELECT tab, min(row_id) AS keep_row, count(*) AS n_copies FROM c GROUP BY tab, form",
}
