"""Text functions as Column -> Column, on the JVM side; all lengths and positions are in code points.

Null gives null everywhere. Regular expressions name their blanks instead of using \\s, whose meaning differs between
engines.
"""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every character that counts as a blank in Unicode text, control separators included.
WS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Sentence lengths below which a piece is dropped, and the sizes of a chunk: least, aimed at, most.
MIN_SENTENCE_EN, MIN_SENTENCE_ZH = 25, 20
CHUNK_MIN, CHUNK_TARGET, CHUNK_MAX = 140, 230, 380
#: An article shorter than this after cleaning is rejected.
MIN_ARTICLE = 230

#: Sentences that are navigation, legal or sharing noise (fixed values).
NOISE_EN = r"(?i)(?:^related links|^tags:|^subscribe|cookie|all rights reserved|share this)"
#: Boilerplate of the article sites (fixed values).
SITE_BOILERPLATE = (
    "^DOE Explains offers straightforward", "^It also describes how these concepts apply", "Skip to main content", r"official websites use \.gov", "writes and curates content",
    "communications specialist in the Vehicle", "For more information please visit", "Shannon Brescher Shea", "^https?://",
)
#: Sections from which on an article is cut off (fixed values).
TRAILING_SECTIONS = (
    "參閱", "參見", "参见", "参阅", "註釋", "注释", "腳註", "脚注", "參考文獻", "参考文献", "参考資料", "参考资料", "外部連結", "外部链接", "延伸閱讀", "延伸阅读", "相關條目", "相关条目",
    "外部鏈接", "注釋", "註記", "注記", "引用", "参考文献来源", "參考文獻及註釋", "註", "注释与参考",
)
#: Words that signal a rights statement (fixed values).
RIGHTS_SIGNAL = r"(?i)(?U)\b(?:copyright|license|credit|courtesy|permission)\b|版权|许可|授權|授权|署名"
#: Chinese marks after which a space is dropped (fixed values).
ZH_PUNCTUATION = "，。！？；：、）》】」』”’"
#: Marks that the tokenizer's normal form keeps, in the order of their stand-ins U+E000 and up (fixed values).
KEPT_MARKS = "，：；！？（）％＃＠｛｝［］…\u3000"


def trim_all(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or blanks only."""
    return F.coalesce(~c.rlike(f"[^{WS}]"), F.lit(True))


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """What case folding does beyond lower case: characters, their single folds, and (character, longer fold) pairs."""
    one, to, more = [], [], []
    for o in range(0x80, sys.maxunicode + 1):
        low = chr(o).lower()
        if len(low) == 1 and not 0xD800 <= o <= 0xDFFF and (fold := low.casefold()) != low and low not in one and all(low != a for a, _ in more):
            if len(fold) == 1:
                one.append(low)
                to.append(fold)
            else:
                more.append((low, fold))
    return "".join(one), "".join(to), tuple(more)


#: Stand-ins for letters with a longer fold while a text is translated; texts that hold one take a slower way.
_STAND_IN = 0x10FE00


def casefold(c: Column, without: str = "") -> Column:
    """Full Unicode case folding, and the characters of `without` taken out, in one pass over the text.

    ASCII texts only need lower case. Letters with a longer fold (as sharp s) become stand-ins that are replaced where
    there are any.
    """
    one, to, more = _folds()
    marks = "".join(chr(_STAND_IN + i) for i in range(len(more)))
    stands = f"[{marks[0]}-{marks[-1]}]"
    low = F.lower(c)
    plain = F.translate(low, "".join(x for x in without if x < "\x80"), "") if without else low
    fast = F.translate(low, one + "".join(a for a, _ in more) + without, to + marks)
    pairs = lambda from_: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(from_, (b for _, b in more))])
    swap = lambda x, from_: F.aggregate(pairs(from_), x, lambda t, p: F.replace(t, p["a"], p["b"]))
    slow = swap(F.translate(low, one + without, to), [a for a, _ in more])
    return F.when(F.octet_length(c) == F.length(c), plain).when(c.rlike(stands), slow).when(fast.rlike(stands), swap(fast, marks)).otherwise(fast)


#: The characters of WS one by one.
BLANKS = "".join(chr(o) for o in range(0x3001) if chr(o).isspace())


def dedup_key(c: Column) -> Column:
    """Case-folded text without any blank."""
    return casefold(c, BLANKS)


def fold_blanks(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def sentences_en(c: Column, shortest: int = MIN_SENTENCE_EN) -> Column:
    """Sentences cut after . ! ? before blanks, long enough and free of noise and boilerplate."""
    parts = F.transform(F.split(c, rf"(?<=[.!?])[{WS}]+"), trim_all)
    site = "(?i)(?:" + "|".join(SITE_BOILERPLATE) + ")"
    return F.filter(parts, lambda s: (F.length(s) >= shortest) & ~s.rlike(NOISE_EN) & ~s.rlike(site))


def sentences_zh(c: Column, shortest: int = MIN_SENTENCE_ZH) -> Column:
    """Sentences cut after Chinese or Western end marks, with or without blanks, long enough."""
    marked = F.regexp_replace(c, rf"([。！？!?；;])[{WS}]*", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), trim_all)
    return F.filter(parts, lambda s: F.length(s) >= shortest)


def chunk(sentences: Column, least: int = CHUNK_MIN, target: int = CHUNK_TARGET, most: int = CHUNK_MAX) -> Column:
    """Sentences joined greedily by a space into chunks; one sentence above the limit is never cut."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(s["cur"]) + 1 + F.length(x)
        fits = (size <= most) & ((F.length(s["cur"]) >= least) | (size <= target + 60))
        return (
            F.when(s["cur"] == "", F.struct(s["out"].alias("out"), x.alias("cur")))
            .when(fits, F.struct(s["out"].alias("out"), F.concat(s["cur"], F.lit(" "), x).alias("cur")))
            .otherwise(F.struct(F.array_append(s["out"], s["cur"]).alias("out"), x.alias("cur")))
        )

    return F.aggregate(sentences, start, step, lambda s: F.when(is_blank(s["cur"]), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))


def drop_trailing_sections(c: Column) -> Column:
    """The text up to the first heading line of a trailing section (references, links and the like)."""
    parts = F.split(c, r"(?=\n=+ +\S)")
    name = lambda p: trim_all(F.regexp_extract(p, r"^\n=+ ?([^=]+?) *=*\n", 1))
    state = F.aggregate(
        parts, F.struct(F.lit(False).alias("end"), F.lit("").alias("text")),
        lambda s, p: F.when(s["end"] | name(p).isin(*TRAILING_SECTIONS), F.struct(F.lit(True).alias("end"), s["text"].alias("text"))).otherwise(F.struct(F.lit(False).alias("end"), F.concat(s["text"], p).alias("text"))),
    )
    return state["text"]


def _each(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def drop_lead_note(c: Column) -> Column:
    return _each(c, (rf"^[{WS}]*本條目[^\n]*。[{WS}]*", ""), (rf"^[{WS}]*本条[^\n]*。[{WS}]*", ""))


def drop_file_links(c: Column) -> Column:
    return _each(c, (r"(?i)\[\[(?:File|Image|文件|Category):[^\]]*\]\]", " "))


def drop_display_math(c: Column) -> Column:
    return _each(c, (rf"(?s)[{WS}]*\{{\\displaystyle.*?\}}[{WS}]*", " "))


def link_text(c: Column) -> Column:
    """[[page|label]] and [[label]] as their label."""
    return _each(c, (r"\[\[([^\]|]+\|)?([^\]]+)\]\]", "$2"))


def drop_citations(c: Column) -> Column:
    """Numbered citations and remarks on the original or on archived copies, each as a space."""
    return _each(
        c, (rf"[\[（(]\p{{Nd}}+[{WS}.,，、-]*(?:\p{{Nd}}+[,，]?)*[）\])]", " "), (rf"(?<=[{WS}])\[\p{{Nd}}+\](?=[{WS}])", " "), (rf"(?<=[{WS}])\[[0-9]+\]", " "),
        (r"[（(][^（）()]{0,30}?原[^\n]*?[）)]", " "), (r"[（(][^（）()]{0,40}?存于互联网档案馆[）)]", " "),
    )


def drop_entities(c: Column) -> Column:
    return _each(c, (r"&[a-zA-Z#0-9]+;", " "))


def drop_tex(c: Column) -> Column:
    """Braced formulas, bare commands and loose mathematical signs, each as a space."""
    return _each(
        c, (rf"[{WS}]*\{{[^{{}}\n]*\\[a-zA-Z]+[^{{}}]*\}}[{WS}]*", " "), (rf"[{WS}]*\\[a-zA-Z]+(?:\{{|\}}|\\?[^{{}}()\[\]]*)", " "),
        (rf"(?U)[{WS}]*\b(?:−|→|←|⇒|⇐|∂|Δ|√|△|∑|∫|λ|μ|ρ|θ|φ|Ω)\b[{WS}]*", " "),
    )


def drop_headings(c: Column) -> Column:
    return _each(c, (r"\n=+ ?[^=\n]+? *=*\n", "\n"))


def fold_lines(c: Column) -> Column:
    """Blanks within lines as one space, no blank lines, none at the ends."""
    return trim_all(_each(c, (r"[ \t\u3000]+", " "), (rf"\n[{WS}]*\n+", "\n"), (rf"[{WS}]*\n[{WS}]*", "\n"), (r"[ \t]+", " ")))


def clean_zh(c: Column) -> Column:
    """The whole cleaning of an encyclopedia extract, in its fixed order."""
    for f in (drop_trailing_sections, drop_lead_note, drop_file_links, drop_display_math, link_text, drop_citations, drop_entities, drop_tex, drop_headings, fold_lines):
        c = f(c)
    return c


def cleaned_articles(df: DataFrame, text_col: str = "text", least: int = MIN_ARTICLE) -> DataFrame:
    """df with the cleaned texts and, where one is no article, the reason in `skipped`: empty extract, or too short after clean."""
    d = df.select("*", is_blank(F.col(text_col)).alias("_blank"), clean_zh(F.col(text_col)).alias("_clean"))
    why = F.when(F.col("_blank"), "empty extract").when(F.length("_clean") < least, "too short after clean")
    return d.withColumn("skipped", why).withColumn(text_col, F.col("_clean")).drop("_blank", "_clean")


def clean_articles(df: DataFrame, text_col: str = "text", least: int = MIN_ARTICLE) -> tuple[DataFrame, DataFrame]:
    """(the articles with their cleaned text, the others with the reason in `skipped`)."""
    d = cleaned_articles(df, text_col, least)
    return d.where(F.col("skipped").isNull()).drop("skipped"), d.where(F.col("skipped").isNotNull())


_AFTER_ZH = f"([{ZH_PUNCTUATION}])[ \\t]+"


def space_after_zh(c: Column) -> Column:
    """Without spaces after Chinese punctuation."""
    return F.regexp_replace(c, _AFTER_ZH, "$1")


def count_space_after_zh(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_AFTER_ZH))


def space_before_punctuation(c: Column, language: str) -> Column:
    """Without a space between a letter and English punctuation, or a Han character and Chinese punctuation."""
    if language == "zh":
        return F.regexp_replace(c, "([㐀-䶿一-鿿]) +([，。！？；：、])", "$1$2")
    return F.regexp_replace(c, "([A-Za-z]) +([,.;:!?])", "$1$2")


def has_han(c: Column) -> Column:
    return c.rlike("[㐀-鿿]")


def is_snake_case(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_]*$")


def has_rights_signal(c: Column) -> Column:
    return c.rlike(RIGHTS_SIGNAL)


def count_of(c: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of a needle; 0 for an empty one."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(F.length(n) == 0, F.lit(0)).otherwise(((F.length(c) - F.length(F.replace(c, n, F.lit("")))) / F.length(n)).cast("int"))


def parens_balanced(c: Column, slack: int = 3) -> Column:
    """Whether the numbers of ( and ) differ by less than slack."""
    return F.abs(count_of(c, "(") - count_of(c, ")")) < slack


def replace_pairs(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered replacements, each of all occurrences; null if a pair doesn't occur when its turn comes."""
    for before, after in pairs:
        c = F.when(F.contains(c, F.lit(before)), F.replace(c, F.lit(before), F.lit(after)))
    return c


def qa_text(question: Column, answer: Column, language: Column) -> Column:
    zh = F.concat(F.lit("问："), question, F.lit("\n答："), answer)
    return F.when(language == "zh", zh).otherwise(F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer))


def url_group_id(url: Column) -> Column:
    return F.concat(F.lit("article-url-"), F.substring(F.sha2(url, 256), 1, 16))


def title_group_id(source: Column, title: Column, prefix: str = "zhwiki-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(source, F.lit("\0"), title), 256), 1, 16))


def host(url: Column) -> Column:
    """The network location of a URL, with port and user if it has them."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def quote_title(title: Column) -> Column:
    """Percent-encoding that keeps the slash."""
    return F.replace(F.replace(F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def history_address(page: Column) -> Column:
    """The address of a wiki page's history, which names its authors."""
    return F.concat(page, F.lit("?action=history"))


def title_address(title: Column, canonical: dict[str, str] | None = None) -> Column:
    """The page name of a title: its canonical form if one is given, else with underscores for spaces."""
    plain = F.replace(title, F.lit(" "), F.lit("_"))
    if not canonical:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for kv in canonical.items() for x in kv])[title], plain)


def protect_marks(c: Column) -> Column:
    return F.translate(c, KEPT_MARKS, "".join(chr(0xE000 + i) for i in range(len(KEPT_MARKS))))


def restore_marks(c: Column) -> Column:
    return F.translate(c, "".join(chr(0xE000 + i) for i in range(len(KEPT_MARKS))), KEPT_MARKS)
