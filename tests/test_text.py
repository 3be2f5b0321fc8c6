from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lexmill.functions import html, text
from lexmill.functions import unicode as uni


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, t {kind}").select("i", f(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


SAMPLES = ["", " ", "Straße ΑΣ x　y", "ŉa ﬁn İ", "a\x1cb c", "ǰΐ ẞ", "中文。 Text", None]


def test_casefold_and_key(spark):
    want = [None if s is None else s.casefold() for s in SAMPLES]
    assert column(spark, SAMPLES, text.casefold) == want
    assert column(spark, SAMPLES, text.dedup_key) == [None if s is None else re.sub(r"\s+", "", s.casefold()) for s in SAMPLES]


def test_casefold_of_many_letters(spark):
    letters = [chr(o) for o in range(0x80, 0x1000)] + [chr(o) for o in range(0x1E00, 0x2200)] + [chr(o) for o in range(0xFB00, 0xFB20)]
    assert column(spark, letters, text.casefold) == [c.casefold() for c in letters]


def test_trim_and_blank(spark):
    assert column(spark, SAMPLES, text.trim_all) == [None if s is None else s.strip() for s in SAMPLES]
    assert column(spark, SAMPLES, text.is_blank) == [s is None or not s.strip() for s in SAMPLES]


def test_blank_key(spark):
    s = ["á  b\n", "á b", None, ""]
    assert column(spark, s, uni.blank_key) == [None if x is None else " ".join(unicodedata.normalize("NFC", x).split()) for x in s]


def chunk_by_hand(sents, least=140, target=230, most=380):
    out, cur = [], ""
    for s in sents:
        n = len(cur) + 1 + len(s)
        if not cur:
            cur = s
        elif n <= most and (len(cur) >= least or n <= target + 60):
            cur += " " + s
        else:
            out.append(cur)
            cur = s
    return out + [cur] if cur.strip() else out


def test_sentences_and_chunks(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "中", "。 ", ". ", "! ", "long" * 9, "\n"]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", None]
    zh = column(spark, texts, text.sentences_zh)
    assert zh == [None if t is None else [p.strip() for p in re.split(r"(?<=[。！？!?；;])\s*", t) if len(p.strip()) >= 20] for t in texts]
    en = column(spark, texts, text.sentences_en)
    assert en == [None if t is None else [p.strip() for p in re.split(r"(?<=[.!?])\s+", t) if len(p.strip()) >= 25] for t in texts]
    assert column(spark, texts, lambda c: text.chunk(text.sentences_zh(c))) == [None if s is None else chunk_by_hand(s) for s in zh]


def test_noise_is_dropped(spark):
    t = "This sentence is long enough to be kept. We use a cookie to see who reads this page. Skip to main content of this page please."
    assert column(spark, [t], text.sentences_en) == [["This sentence is long enough to be kept."]]


def test_zh_cleaning(spark):
    t = "本條目介紹一種方法。\n导数[1]是[[函数|函數]]的&nbsp;{\\displaystyle x^2}变化率（1）。\n== 定义 ==\n内容 在此\n\n== 参见 ==\n别的"
    assert column(spark, [t, "", None], text.clean_zh) == ["导数 是函數的 变化率 。\n内容 在此", "", None]


def test_punctuation_spaces(spark):
    s = ["好， 是。\t对", "a b", None]
    assert column(spark, s, text.space_after_zh) == ["好，是。对", "a b", None]
    assert column(spark, s, text.count_space_after_zh) == [2, 0, None]
    assert column(spark, ["wait , no"], lambda c: text.space_before_punctuation(c, "en")) == ["wait, no"]
    assert column(spark, ["中 ，文"], lambda c: text.space_before_punctuation(c, "zh")) == ["中，文"]


def test_replacements_and_counts(spark):
    assert column(spark, ["aXbX", "b", None], lambda c: text.replace_pairs(c, [("X", "Y"), ("aY", "Z")])) == ["ZbY", None, None]
    assert column(spark, ["((a)", "", None], text.parens_balanced) == [True, True, None]
    assert column(spark, ["aaa", ""], lambda c: text.count_of(c, "a")) == [3, 0]


def test_groups_and_urls(spark):
    import hashlib

    u = "https://User@Ex.example:8080/a?b"
    assert column(spark, [u, None], text.url_group_id) == ["article-url-" + hashlib.sha256(u.encode()).hexdigest()[:16], None]
    assert column(spark, [u, "no url", None], text.host) == ["User@Ex.example:8080", None, None]
    assert column(spark, ["a b/ü+~"], text.quote_title) == ["a%20b/%C3%BC%2B~"]
    assert column(spark, ["a b", "c"], lambda c: text.title_address(c, {"c": "D"})) == ["a_b", "D"]


def test_tokenizer_form(spark):
    assert column(spark, ["ＡＢ，（x）　①", None], uni.tokenizer_form) == ["AB，（x）　1", None]


def test_shingles(spark):
    from hashlib import blake2b

    h = lambda p: int.from_bytes(blake2b(p.encode(), digest_size=8).digest(), "big") - (1 << 63)
    assert column(spark, ["abcdef", "ab", "", None], uni.shingles) == [sorted([h("abcde"), h("bcdef")]), [h("ab")], [h("")], None]


def test_html(spark):
    page = "<html><head><title> T </title></head><body><header>no</header><main>second</main><article><p>One &amp; <b>two</b><br>three</p><nav>x</nav></article></body></html>"
    got = column(spark, [page, "", "<p>no body", None], html.extract)
    assert [tuple(r) if r else r for r in got[:2]] == [("T", "One & two three"), ("", "")]
    assert html.page_text("<body>a<script>b</script>c") == ("", "a c")


def test_shingles_fold_plain_texts_like_the_key(spark):
    texts = ["".join(chr(o) for o in range(a, a + 64) if not 0xD800 <= o < 0xE000) for a in (*range(0, 0x3100, 64), *range(0x4E00, 0xA000, 64), *range(0xFF00, 0xFFF0, 64))] + ["", " ", "ab", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    for digest in ("blake2b", "md5"):
        assert d.select(uni.key_shingles(F.col("text"), digest).alias("a"), uni.shingles(text.dedup_key(F.col("text")), digest=digest).alias("b")).where("NOT (a <=> b)").count() == 0
