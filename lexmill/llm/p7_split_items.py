"""Problem 7: oversized texts cut at natural boundaries, with overlap.

A hierarchy of separators (section, paragraph, line, sentence, word, character) is applied recursively: a stretch is
cut one level deeper only if it is too long for a piece; the resulting atoms are packed greedily, and each piece begins
with the tail of the one before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import spread, table

LIMIT, OVERLAP = 380, 40
#: Sentence ends and the closing marks that may follow one (fixed values).
ENDS, CLOSING = "。！？!?；;", "」』”’）)】》\""
#: What ends a stretch at each natural level, coarse to fine; the match's end is the cut.
LEVELS = (
    ("section", re.compile(rf"\n[{CLOSING}]*(?:(?:[^\S\n]*\n){{2,}}|(?:[^\S\n]*\n)+(?=[^\S\n]*(?:#|=+ ?\S|第[一二三四五六七八九十百0-9]+[章节])))[{CLOSING}]*")),
    ("paragraph", re.compile(rf"\n[{CLOSING}]*(?:[^\S\n]*\n)+[{CLOSING}]*")),
    ("line", re.compile(rf"\n[{CLOSING}]*")),
    ("sentence", re.compile(rf"[{ENDS}\n][{CLOSING}]*")),
)
#: Where words end, for stretches without a natural boundary: after blanks and pausing marks.
WORD_END = re.compile(r"[，,、：:·…—–\-/]+[’”」』）)】》\"]*|\s+")
HARD = ("word", "character")
#: Code points that belong to the one before them: no cut stands before one.
JOINED = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u200c\u200d\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff]")

PIECES = "id long, piece_no int, start int, end int, overlap int, piece string, cut string"


def atoms(text: str, a: int, b: int, room: int, limit: int, level: int = 0) -> Iterator[tuple[int, str]]:
    """(end, level of the boundary there) of the atoms that make up text[a:b].

    An atom is as coarse as fits into `room`; a stretch between natural boundaries stays whole up to `limit`.
    """
    if b - a <= room or (level == len(LEVELS) and b - a <= limit):
        yield b, LEVELS[min(level, len(LEVELS) - 1)][0]
    elif level < len(LEVELS):
        name, pattern = LEVELS[level]
        at = a
        for m in pattern.finditer(text, a, b):
            if at < m.end() < b:
                yield from _whole(atoms(text, at, m.end(), room, limit, level + 1), name)
                at = m.end()
        yield from atoms(text, at, b, room, limit, level + 1)
    else:  # a cut elsewhere can't be avoided
        while b - a > room:
            end, kind = a + room, "character"
            for m in WORD_END.finditer(text, a + room // 2, a + room):
                end, kind = m.end(), "word"
            while kind == "character" and end > a + 1 and (JOINED.match(text, end) or text[end - 1] == "\u200d"):
                end -= 1
            if end == a + 1:  # nothing but joined code points
                end = a + room
            yield end, kind
            a = end
        yield b, LEVELS[-1][0]


def _whole(parts: Iterator[tuple[int, str]], name: str) -> Iterator[tuple[int, str]]:
    """parts, the last with the name of the boundary it ends at."""
    last = None
    for x in parts:
        if last:
            yield last
        last = x
    if last:
        yield last[0], name


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap, kind of the cut at the end) of the pieces of a text; positions in code points.

    A text up to the limit is one piece; the empty text too. Pieces without their overlaps join to the text. Each later
    piece starts with `overlap` characters of the one before; with less only where the next stretch between natural
    boundaries would not fit otherwise, for cutting it would be avoidable.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")]
    out, start, fresh, end, kind, used = [], 0, 0, 0, "", 0
    for to, name in atoms(text, 0, n, limit - overlap, limit):
        if end > fresh and to - start > limit:
            out.append((start, end, used, kind))
            used = min(overlap, limit - (to - end))
            start, fresh = end - used, end
        end, kind = to, name
    out.append((start, n, used, "end"))
    return out


def split_items(df: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: id, piece_no (from 1), start, end, overlap, piece, cut (level of the boundary at its end).

    Rows with a null text give no piece, an empty text one empty piece; ids pass through as they are (null or repeated
    too), an empty table gives no rows, other columns are left out. Texts within the limit never reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    size = F.length("text")
    short = df.where(size <= limit).select("id", F.lit(1).alias("piece_no"), F.lit(0).alias("start"), size.alias("end"), F.lit(0).alias("overlap"), F.col("text").alias("piece"), F.lit("end").alias("cut"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, a, b, o, t[a:b], c) for i, t in zip(pdf["id"], pdf["text"]) for k, (a, b, o, c) in enumerate(pieces(t, limit, overlap), 1)]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
            yield out.astype({"id": "Int64"})

    return short.unionByName(spread(df.where(size > limit)).mapInPandas(cut, PIECES))


def hard_cut_rows(df: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The ids of texts with a cut that isn't at a natural boundary."""
    found = split_items(df.where(F.length(text_col) > limit), id_col, text_col, limit, overlap)
    return found.where(F.col("cut").isin(*HARD)).select("id").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_cut_rows(table(spark, sf_dir, "article_zh", "row_id", "text")).select(F.col("id").alias("row_id"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "article_zh", "row_id", "text")).withColumnRenamed("id", "row_id")


#: Of the rows above the limit, those with a stretch of more than 380 characters between boundaries.
SQL = {
    "p7_found": """
SELECT row_id FROM article_zh
WHERE length(text) > 380 AND len(list_filter(
  string_split(regexp_replace(text, '([。！？!?；;\\n][」』”’）)】》"]*)', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 380)) > 0
""",
}
