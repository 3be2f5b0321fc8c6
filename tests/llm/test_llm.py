from __future__ import annotations

import random
import re
import unicodedata

import pytest

from lexmill.llm import p1_group_splits as p1
from lexmill.llm import p2_main_content as p2
from lexmill.llm import p3_canonical_form as p3
from lexmill.llm import p4_token_budget as p4
from lexmill.llm import p5_hidden_duplicates as p5
from lexmill.llm import p6_cross_split as p6
from lexmill.llm import p7_split_items as p7
from lexmill.llm import p8_pack as p8
from lexmill.llm import p9_eval_leaks as p9
from lexmill.llm import p10_subjects as p10
from lexmill.llm import queries


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# --- 1 --------------------------------------------------------------------------------------------------------------

PAGE = "row_id long, split string, group_id string, source_url string, source string, source_title string, page string, root string"


def pages(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], PAGE)


LINKED = [
    (1, "train", "g1", None, None, None), (2, "Test", "g1", None, None, None), (3, None, "g1", None, "S", "T"), (4, "train", None, "http://www.EX.example/a/?q#f", "S", "T"),
    (5, "train", None, "https://ex.example/a", None, None), (6, "validation", None, "https://ex.example/A", None, None), (7, "train", None, None, "S", None), (8, "train", None, None, None, None),
    (9, "test", None, None, None, None), (10, "odd", "g2", None, None, None), (11, "valid", "g2", None, None, None), (None, "test", "g2", None, None, None), (12, "Valid", "g3", None, None, None), (13, "train", "g3", None, None, None),
]


def test_mixed_pages(spark):
    assert rows(p1.mixed_pages(pages(spark, LINKED))) == [(i,) for i in (1, 2, 3, 4, 5, 12, 13)]
    assert rows(p1.mixed_pages(pages(spark, []))) == []


def test_mixed_pages_random(spark):
    rng = random.Random(2)
    pick = lambda n, p: f"{p}{rng.randrange(n)}" if rng.random() < 0.5 else None
    data = [(i, rng.choice(["train", "train", "valid", None]), "hot" if i % 3 == 0 else pick(90, "g"), None, pick(80, "s"), pick(3, "t")) for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, _, g, _, s, t in data:
        for k in ([("g", g)] if g else []) + ([("s", s, t)] if s and t else []):
            parent[find(k)] = find(r)
    seen: dict = {}
    for r, sp, *_ in data:
        seen.setdefault(find(r), set()).add(sp)
    want = sorted((r,) for r, *_ in data if len(seen[find(r)] - {None}) > 1)
    assert rows(p1.mixed_pages(pages(spark, data))) == want


def test_component_store_keeps_fills_and_quarantines(spark):
    store = p1.ComponentStore(spark)
    first = [(i, None, f"g{i // 2}", None, None, None) for i in range(400)]
    one = {r["row_id"]: r for r in store.update(pages(spark, first)).collect()}
    assert len(one) == 400 and all(one[2 * i]["split"] == one[2 * i + 1]["split"] for i in range(200))
    share = {s: sum(r["split"] == s for r in one.values()) / 400 for s in p1.PROPORTIONS}
    assert abs(share["train"] - 0.8) < 0.05 and share["valid"] > 0.05 and share["test"] > 0.05
    g = {s: next(i // 2 for i, r in one.items() if r["split"] == s) for s in ("train", "test")}
    # a link between two components of different splits, a row of a known group, a new page
    second = [(1000, None, f"g{g['train']}", None, "S", "T"), (1001, None, f"g{g['test']}", None, "S", "T"), (1002, None, "g199", None, None, None), (1003, None, "new", None, None, None)]
    two = {r["row_id"]: r for r in store.update(pages(spark, second)).collect()}
    assert two[1000]["state"] == two[1001]["state"] == "quarantined" and two[1000]["split"] is None and two[1000]["page"] == two[1001]["page"]
    assert two[1002]["state"] == "kept" and two[1002]["split"] == one[398]["split"]
    assert two[1003]["state"] == "new" and two[1003]["split"] in p1.PROPORTIONS
    assert store.alias().count() == 1
    three = store.update(pages(spark, [(2000, None, f"g{g['train']}", None, None, None)])).first()
    assert three["state"] == "quarantined" and three["page"] == two[1000]["page"]
    assert store.update(pages(spark, [])).count() == 0


def test_component_store_is_reopened(spark, tmp_path):
    """Two sessions on one path, one of whose batches breaks off before its commit; then many merges in a chain."""
    from unittest import mock

    path = f"file://{tmp_path}/store"
    first = p1.ComponentStore(spark, path)
    one = {r["row_id"]: (r["page"], r["split"]) for r in first.update(pages(spark, [(i, None, f"g{i // 2}", None, None, None) for i in range(100)])).collect()}
    second = [(1000, None, "g3", None, None, None), (1001, None, "fresh", None, None, None)]
    broken = p1.ComponentStore(spark, path)
    assert broken.version == 1 and broken.totals == first.totals
    with mock.patch.object(p1.ComponentStore, "_commit", side_effect=OSError("lost")), pytest.raises(OSError):
        broken.update(pages(spark, second))
    again = p1.ComponentStore(spark, path)
    assert again.version == 1 and again.keys().count() == 50
    two = {r["row_id"]: r for r in again.update(pages(spark, second)).collect()}
    assert (two[1000]["page"], two[1000]["split"], two[1000]["state"]) == (*one[6], "kept") and two[1001]["state"] == "new"
    third = p1.ComponentStore(spark, path)
    assert third.version == 2 and third.keys().count() == 51 and third.splits().agg({"n": "sum"}).first()[0] == 102
    with pytest.raises(ValueError):
        p1.ComponentStore(spark, path, {"train": 0.5})


def test_component_store_follows_long_chains(spark):
    from unittest import mock

    with mock.patch.object(p1, "COMPACT", 2):
        store = p1.ComponentStore(spark)
        store.update(pages(spark, [(100 - i, None, f"g{i}", None, None, None) for i in range(4)]))
        for i in range(3):  # each batch links what is there to a component of a smaller row
            store.update(pages(spark, [(200 + 2 * i, None, f"g{i}", None, f"s{i}", "t"), (201 + 2 * i, None, f"g{i + 1}", None, f"s{i}", "t")]))
        last = p1.ComponentStore(spark, store.path)
        assert {r["root"] for r in last.alias().collect()} == {97}
        s = last.splits().collect()
        assert len(s) == 1 and s[0]["comp"] == 97 and s[0]["n"] == 10 and sum(last.totals.values()) == 10
        assert {(r["page"], r["state"]) for r in last.update(pages(spark, [(300, None, "g0", None, None, None)])).collect()} == {(97, s[0]["state"])}


def test_apply_splits(spark):
    d = pages(spark, LINKED)
    out = p1.apply_splits(d, p1.ComponentStore(spark).update(d))
    assert out.count() == len(LINKED) and {"split", "split_before", "page", "split_state"} <= {*out.columns}
    got = {r["row_id"]: r["split"] for r in out.collect()}
    assert len({got[i] for i in (1, 2, 3, 4, 5)}) == 1 and got[None] is None and got[8] is not None


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_furniture_cues():
    for line in (
        "Home | News | About us", "Research » Maps » A title of a page", "Skip to main content", "We use cookies to count visits. Agree and continue", "© 2020 A Site. All rights reserved.",
        "Copyright 2018 X | Legal | Imprint", "Share this page: Mail Print Link", "Tweet Post Pin Mail", "Subscribe to X updates – enter your e-mail address", "12 comments – sign in to reply", "7 min read | Updated 1 May 2020",
        "Five facts about the tide", "What a well can teach us about the sky", "The wave season opens early this year, and visitors can watch the coil live.", "Related Links", "By staying on this page you let us count visits. OK",
    ):
        assert p2.Reader()(line), line
    for line in (
        "A cookie sent by the Ab 12 server is a short record that the browser returns with each request.", "Rights to the water at X 1 are reserved for the lower basin, and terms of use change yearly.",
        "Navigation at X relied on landmarks, because the compass drifted.", "Privacy of the X volunteers was kept by removing names before the analysis.", "Results", "Site: A 1; Object: session cookie", "about", "",
        "Each reading is the mean of three repeats.", "The session cookie loses nearly 5 bytes.",
    ):
        assert not p2.Reader()(line), line


def test_runs_of_the_suffix_array_match_brute_force():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        streams = [[rng.randrange(3) for _ in range(rng.randrange(0, 14))] for _ in range(8)]
        page = sorted(rng.randrange(5) for _ in streams)
        page = [sorted(set(page)).index(p) for p in page]
        stop = np.cumsum([len(s) for s in streams])
        tok = np.array([x for s in streams for x in s], np.uint64)
        run = rng.choice([1, 2, 3, 5])
        starts, rank, n_pages = p2.runs(tok, np.repeat(stop, [len(s) for s in streams]), np.repeat(page, [len(s) for s in streams]), run)
        least = rng.choice([1, 2, 3])
        got = p2.covered(len(tok), starts[n_pages[rank] >= least] if len(starts) else starts, run)
        # every substring of at least `run` tokens on at least `least` pages covers its tokens
        seen: dict = {}
        for s, p in zip(streams, page):
            for i in range(len(s)):
                for j in range(i + run, len(s) + 1):
                    seen.setdefault(tuple(s[i:j]), set()).add(p)
        want = [False] * len(tok)
        at = 0
        for s in streams:
            for i in range(len(s)):
                for j in range(i + run, len(s) + 1):
                    if len(seen[tuple(s[i:j])]) >= least:
                        want[at + i : at + j] = [True] * (j - i)
            at += len(s)
        assert got.tolist() == want


def test_suffixes_are_in_order():
    import numpy as np

    rng = random.Random(4)
    s = [rng.randrange(3) for _ in range(200)]
    order, rank = p2.suffix_array(np.array(s, np.uint64), np.full(200, 200), 7)
    assert [*order] == sorted(range(200), key=lambda i: (s[i : i + 7], i))
    assert all((rank[i] == rank[j]) == (s[i : i + 7] == s[j : j + 7]) for i in range(0, 200, 7) for j in range(200))


def test_streams_match_words():
    texts = ["Ab 12cd\r\n\r\n  \u3000\nMénü_x; 𝔘!", "", " \n", "ab 9CD", "b" * 5000, "中文。\n中文。"]
    tokens, length, at, per_text, line = p2.Streams().of(texts)
    assert per_text.tolist() == [len(p2.blocks(t)) for t in texts] == [2, 0, 0, 1, 1, 2]
    assert length.tolist() == [1 + 3 + 1 + 6 + 1, 1, 1, 5, 3, 1 + 2 + 1 + 2 + 1] and len(tokens) == length.sum()
    assert line[0] == line[2] and line[4] == line[5] and len(set(line.tolist())) == 4
    assert all(tokens[i] == p2.LINE for i in at) and tokens[2] == p2.NUMBER


def test_main_text(spark):
    text = "Menu\nHome | News\n\nResults\nThe tide gains about 5 metres here.\n \nBack to top"
    d = spark.createDataFrame([(1, text, "https://a.example/x", "S", None, 1), (2, None, None, None, None, 1), (3, "", None, None, None, 1), (4, "Menu", None, None, None, 1), (None, "A plain sentence stands here.", None, None, None, 1)], "row_id long, text string, source_url string, source string, group_id string, block_no int")
    assert rows(p2.furniture(d)) == [(1, 1), (1, 2), (1, 5), (4, 1)]
    got = {r[0]: r[1] for r in p2.main_text(d).collect()}
    assert got == {1: "Results\nThe tide gains about 5 metres here.", 4: "", None: "A plain sentence stands here."}
    assert p2.judged(d.limit(0)).count() == 0
    assert rows(p2.furniture(d, shard=1)) == [(1, 1), (1, 2), (1, 5), (4, 1)]


def test_shards_of_a_host_count_runs_together(spark):
    text = "Menu\nWinter Harbour Notes of {} and a long way home\nBack to top\n{}"
    says = ["The tide gains about 5 metres here.", "No lens was moved.", "Ice grows on the wing."]
    data = [(i, text.format("abc"[i // 2 % 3] * 3, says[i % 3] if i % 4 else f"Own words {'xyz'[i % 3]} only {i}"), f"https://a.example/{i // 2}", "S", None) for i in range(24)]
    data += [(100 + i, "One page says this\nTwice over", "https://a.example/same", "S", None) for i in range(6)]
    d = spark.createDataFrame(data, "row_id long, text string, source_url string, source string, group_id string")
    one = rows(p2.judged(d), "row_id", "block_no", "furniture", "covered")
    assert {(r[0], r[1]) for r in one if r[2]} == {(i, k) for i in range(24) for k in (1, 2, 3)}
    assert any(r[3] == 0.0 for r in one) and any(0 < r[3] < 1 for r in one)
    for shard in (1, 3, 10):
        assert rows(p2.judged(d, shard=shard), "row_id", "block_no", "furniture", "covered") == one


def test_repeated_blocks_are_furniture_in_any_language(spark):
    """No phrase of the lists occurs here: menus, path lines and notices are told by their repetition, articles stay."""
    from unittest import mock

    text = "Accueil | Actualités | Contact\nVous êtes ici : Accueil › Sciences\nRésultats {}\nLa marée gagne environ {} mètres dans ce port.\n{}\n© Éditions du Port\nDiese Seite verwendet Kekse"
    data = [(i, text.format("abcdefghijklmnopqrstuvwxyz"[i] * 4, i, f"Beyond point {'zyxwvutsrqponmlkjihgfedcba'[i] * 5} alone"), f"https://a.example/{i}", "S", None) for i in range(24)]
    data += [(100 + i, "Own line of words", "https://a.example/same", "S", None) for i in range(8)]
    d = spark.createDataFrame(data, "row_id long, text string, source_url string, source string, group_id string")
    with mock.patch.object(p2.Reader, "reads", lambda self, block: False):
        texts = [r[1] for r in data]
        host = p2.Host(p2.Streams(), texts, __import__("numpy").array([*range(24), *[24] * 8]))
        starts, rank, n = host.runs()
        lines, k = host.lines()
        out = [f for _, f, _ in p2.judge(host, texts, p2.Reader(), starts[n[rank] >= 3], k[lines] >= 3)]
    assert [[i for i, f in enumerate(x, 1) if f] for x in out] == [[1, 6, 7]] * 24 + [[]] * 8
    got = rows(p2.furniture(d))
    assert {(i, k) for i in range(24) for k in (1, 6, 7)} <= {*got} and rows(p2.furniture(d, shard=5)) == got
    assert p2.Reader()("© 2020 " + "A very long name of a site " * 20 + "All rights reserved.")


# --- 3 --------------------------------------------------------------------------------------------------------------


def test_canonical_forms():
    c = p3.Canonical(p3.mapping())
    same = [("Ａｂ１，", "Ab1,"), ("a b", "a b"), ("a　b", "a b"), ("é", "é"), ("а", "a"), ("⼀", "一"), ("豈", "豈"), ("x​y­", "xy"), ("µ", "μ"), ("q̣̇", "q̣̇"), ("Ν", "N"), ("ｶﾞ", "ガ")]
    for a, b in same:
        assert c.batch([a]) == c.batch([b]), (a, b)
    for a, b in [("x²", "x2"), ("①", "1"), ("½", "1/2"), ("a  b", "a b"), ("a\nb", "a b"), ("α", "a"), ("x₂", "x2"), ("b", "d"), ("…", "...")]:
        assert c.batch([a]) != c.batch([b]), (a, b)
    assert c.batch(["", "é", ""]) == ["", "é", ""]
    assert c.batch([]) == []
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([0x65, 0x301, 0x327, 0x4E00, 0x1100, 0x1161, 0xFF21, 0x200B, 0x1E9])) for _ in range(rng.randrange(9))) for _ in range(200)]
    out = c.batch(texts)
    assert c.batch(out) == out and all(unicodedata.normalize("NFC", x) == x for x in out)


def test_ordering_and_composition_match_unicode():
    c = p3.Canonical(p3.mapping())
    rng = random.Random(13)
    pool = [0x41, 0x61, 0x65, 0x6F, 0x300, 0x301, 0x302, 0x304, 0x307, 0x308, 0x323, 0x327, 0x328, 0x338, 0x345, 0x5B0, 0x5B4, 0x5D0, 0x915, 0x93C, 0x9C7, 0x9BE, 0x1100, 0x1102, 0x1161, 0x1163, 0x11A8, 0x3099, 0x304B, 0xAC00, 0x3042, 0x1112, 0x1175, 0x11C2, 0x4E00]
    for _ in range(4000):
        t = "".join(chr(rng.choice(pool)) for _ in range(rng.randrange(1, 9)))
        assert c.batch([t]) == [unicodedata.normalize("NFC", t)], [hex(ord(x)) for x in t]
    batch = ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(4))) for _ in range(500)]
    assert c.batch(batch) == [unicodedata.normalize("NFC", t) for t in batch]


def test_same_looking(spark):
    d = spark.createDataFrame([(1, "Ａ", "t"), (2, "A", "t"), (3, "A", "t"), (4, "А", "t"), (5, None, "t"), (6, "", "t"), (7, "", "t"), (None, "A", "t"), (8, "b" * 50_000, "t")], "row_id long, text string, canonical string")
    assert rows(p3.same_looking(d)) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]
    assert rows(p3.look_alike_classes(d)) == [(1, 1, 4, 3), (2, 1, 4, 2), (3, 1, 4, 2), (4, 1, 4, 3)]
    assert p3.look_alike_classes(d.limit(0)).count() == 0
    assert rows(p3.same_looking(d.limit(0))) == []


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_token_counts_match_the_merges(spark, small):
    merges = p4.load_merges(spark, spark.read.parquet(f"{small}/bpe_merges.parquet"))
    from tokenizers import Tokenizer, models, pre_tokenizers
    from tokenizers import Regex

    letters = p4.byte_letters()
    vocab = {t: i for i, t in enumerate(dict.fromkeys([*letters, *(a + b for a, b in merges)]))}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=[m for m in dict.fromkeys(merges)]))
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    texts = [r["text"] for r in spark.read.parquet(f"{small}/english.parquet").select("text").limit(40).collect() if r["text"]] + ["", "  two  blanks ", "中文 é\n\n12ab", "a" * 300]
    long = " ".join(texts) * 4
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate([*texts, long, None])], "i long, text string, n_tokens int")
    want = {i: len(tok.encode(t).ids) for i, t in enumerate([*texts, long])} | {len(texts) + 1: None}
    assert dict(rows_any(p4.token_counts(d, merges), "i", "n_tokens")) == want
    assert dict(rows_any(p4.token_counts(d, merges, chunk=200), "i", "n_tokens")) == want
    assert "".join(p4.chunks(long, 100)) == long and len(p4.chunks(long, 100)) > 5
    assert p4.token_counts(d.limit(0), merges).count() == 0
    solid = "中文，12个。(ab)12" * 300  # no blank at all
    cut = p4.chunks(solid, 50)
    m = p4.Merges(merges)
    assert len(cut) > 50 and "".join(cut) == solid and sum(map(m.count, cut)) == m.count(solid)


def rows_any(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_slices(spark):
    d = spark.createDataFrame([("A b", "en", "X-y", 3), ("a B", "EN-gb", "x y", 4), (None, "English", None, 5), ("", None, None, None)], "source string, language string, domain string, n_tokens long")
    got = {tuple(r[:4]): tuple(r[4:]) for r in p4.slice_totals(d).collect()}
    assert got["source+language+domain", "a_b", "en", "x_y"] == (2, 2, 7)
    assert got["source", None, None, None] == (2, 1, 5) and got["all", None, None, None] == (4, 3, 12) and got["language", None, "en", None] == (3, 3, 12)
    assert [tuple(r[4:]) for r in p4.slice_totals(d.limit(0)).collect()] == []


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_hidden_duplicates(spark):
    groups = [
        ["At X, it is 3.5 m!", "at x it is 3.5 m", "• At X — it is\n3.5 M"], ["At X, it is 35 m"], ["Site: A; Low: 1.2; High: 3", "High : 3\nSITE : a\nLow : 1.2.", "low: 1.2 | high: 3 | site: A"],
        ["Site: A; Low: 3; High: 1.2"], ["地点：甲；下限：1", "下限： 1\n地点： 甲"], ["地点：甲；下限：２"], ["a​b"], ["ab", "a b", "A.B"], ["", "...", " "], ["х"], ["x"],
    ]
    data = [(k, t) for k, t in enumerate(t for g in groups for t in g)] + [(99, None), (None, "ab")]
    want, k = [], 0
    for g in groups:
        want += [(k, k + i) for i in range(1, len(g))]
        k += len(g)
    d = spark.createDataFrame([(*r, 1) for r in data], "row_id long, text string, code int")
    codes = p5.encoded(d)
    assert rows(p5.copies(codes)) == want
    assert rows(p5.distinct_records(codes), "n_copies") == sorted((len(g),) for g in groups)
    assert rows(p5.copies(p5.encoded(d.limit(0)))) == []
    assert p5.fields("Remark: one\ntwo; Site: b") == [("Remark", " onetwo"), ("Site", " b")] and len(p5.fields("no fields: here")) == 1


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_word_codes_match_the_words():
    from lexmill.llm.common import WordCodes

    rng = random.Random(2)
    pool = "aB9_ é中ß.İ\n\u200b𝔘😀x"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "  "]
    code, size = WordCodes().of(texts)
    words = [p6.WORDS.findall(t.lower()) for t in texts]
    assert size.tolist() == [len(w) for w in words]
    seen: dict = {}
    for w, c in zip([x for ws in words for x in ws], code.tolist()):
        assert seen.setdefault(w, c) == c
    assert len({*seen.values()}) == len(seen)
    assert [len(x) for x in WordCodes().of([])] == [0, 0]


def test_common_words():
    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[j]))
            p = q
        return p[-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(80))] for _ in range(2))
        assert p6.common_words(a, b) == lcs(a, b)


def test_cross_split_pairs_match_brute_force(spark):
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(400)]
    base = [[rng.choice(voc) for _ in range(rng.randrange(30, 80))] for _ in range(60)]
    data = [(i, "train", w) for i, w in enumerate(base)]
    for i, w in enumerate(base[:40]):
        v = [x for x in w if rng.random() > 0.06]
        v.insert(rng.randrange(len(v)), "new")
        data.append((100 + i, rng.choice(["valid", "test", "Train", "validation"]), v))
    data += [(200 + i, s, base[0]) for i, s in enumerate(["train", "test", "test", None])] + [(300, "test", []), (301, "train", [])]
    rowsd = [(i, s, "  ".join(w).upper() if i % 2 else ", ".join(w), 0) for i, s, w in data] + [(400, "test", None, 0), (None, "test", " ".join(base[1]), 0)]
    d = spark.createDataFrame(rowsd, "row_id long, split string, text string, cls int")
    side = lambda s: {"train": 0, "Train": 0}.get(s, 1)
    want = sorted((i, j) for i, s, a in data for j, t, b in data if i < j and s and t and side(s) != side(t) and p6.common_words(hashes(a), hashes(b)) >= 0.8 * max(len(a), len(b)))
    assert rows(p6.cross_pairs(d)) == want
    assert rows(p6.cross_pairs(d.limit(0))) == []
    f = {r["row"]: r["overlap"] for r in p6.overlap_fractions(d).collect()}
    assert f[201] == 1.0 and f[300] == 0.0 and 201 in f and 0 not in f


def hashes(words):
    return [hash(w) for w in words]


def test_cross_split_spread_changes_match_brute_force(spark):
    """Pairs near four fifths whose altered words are spread evenly, at random, or inserted and dropped."""
    rng = random.Random(13)
    voc = [f"w{i}" for i in range(2000)]
    data = []
    for i in range(240):
        n, share = rng.choice([40, 56, 100]), rng.choice([0.76, 0.8, 0.8, 0.85])
        w = [rng.choice(voc) for _ in range(n)]
        k = round(n * (1 - share))
        at = {int((j + 0.5) * n / k) for j in range(k)} if i % 3 else set(rng.sample(range(n), k))
        v = [x if j not in at else "" if i % 3 == 2 and j % 2 else f"new{i}x{j}" for j, x in enumerate(w)]
        data += [(2 * i, "train", w), (2 * i + 1, "test", [x for x in v if x])]
    d = spark.createDataFrame([(i, s, " ".join(w)) for i, s, w in data], "row_id long, split string, text string")
    h = [hashes(w) for _, _, w in data]
    want = sorted((min(i, j), max(i, j)) for i in range(0, 480, 2) for j in range(1, 480, 2) if p6.common_words(h[i], h[j]) >= 0.8 * max(len(h[i]), len(h[j])))
    assert len(want) > 150
    assert rows(p6.cross_pairs(d)) == want

def test_cross_split_large_family_and_rare_words(spark):
    """A record of a large family that shares rare words with one other record keeps its pairs with both."""
    rng = random.Random(12)
    voc = [f"w{i}" for i in range(3000)]
    base = [rng.choice(voc) for _ in range(100)]
    fam = [base[:i % 90] + [f"own{i}"] + base[i % 90 + 1 :] for i in range(700)]
    rare = base[:47] + [f"rare{i}" for i in range(6)] + base[53:]
    other = [f"o{i}" for i in range(44)] + rare[44:56] + [f"p{i}" for i in range(44)]  # shares the rare words and no more
    data = [(i, "train", w) for i, w in enumerate(fam)] + [(1000, "test", rare), (1001, "train", other), (1002, "train", rare[:-8])]
    d = spark.createDataFrame([(i, s, " ".join(w)) for i, s, w in data], "row_id long, split string, text string")
    assert rows(p6.cross_pairs(d)) == [(i, 1000) for i in range(700)] + [(1000, 1002)]


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_pieces(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["字" * rng.randrange(1, 60), "。", "，", "\n", "\n\n", "！」", " ", "é"]) for _ in range(rng.randrange(120))) for _ in range(120)] + ["", "短。", "字" * 2000, "́" * 900]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(999, None, 1)], "row_id long, text string, piece int")
    got: dict[int, list] = {}
    for r in p7.split_items(d).orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ps = got[i]
        assert [r["piece_no"] for r in ps] == [*range(1, len(ps) + 1)]
        assert all(r["piece"] == t[r["start"] : r["end"]] and len(r["piece"]) <= 380 for r in ps)
        assert "".join(t[r["start"] + r["overlap"] : r["end"]] for r in ps) == t
        assert all(0 <= b["overlap"] <= 40 and b["start"] == a["end"] - b["overlap"] for a, b in zip(ps, ps[1:]))
        ends = {m.end() for m in re.finditer(r"[。！？!?；;\n][」』”’）)】》\"]*", t)} | {len(t)}
        cuts = sorted({0, *ends})
        hard = len(t) > 380 and any(b - a > 380 for a, b in zip(cuts, cuts[1:]))
        assert hard == any(r["cut"] in p7.HARD for r in ps)
        assert all(r["end"] in ends for r in ps if r["cut"] not in p7.HARD)
    want = sorted((i,) for i in got if any(r["cut"] in p7.HARD for r in got[i]))
    assert rows(p7.hard_cut_rows(d)) == want
    assert p7.split_items(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        p7.split_items(d, limit=10, overlap=10)


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 1, 1024, *range(5, 700, 7)]) for _ in range(3000)]
    d = spark.createDataFrame([(i if i % 50 else None, 1, 0, s) for i, s in enumerate(sizes)], p8.ITEM).repartition(6)
    out = p8.pack_items(d, open_bins=64).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["size"]) for r in out) == sorted((not i % 50, i if i % 50 else 0, s) for i, s in enumerate(sizes))
    fill: dict[int, int] = {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert all(f <= 1024 for f in fill.values()) and all(r["fill"] == fill[r["container"]] for r in out)
    assert sum(sizes) / (1024 * len(fill)) > 0.97
    assert p8.pack_items(d.limit(0)).count() == 0
    with pytest.raises(Exception, match="outside"):
        p8.pack_items(spark.createDataFrame([(1, 1, 0, 2000)], p8.ITEM))


def test_open_bins_take_the_tightest():
    b = p8.OpenBins(10, 5)
    for k, free in enumerate((3, 7, 5, 5)):
        b.put(k, free)
    assert b.take(4) in (2, 3) and b.take(6) == 1 and b.take(6) is None and b.close_fullest() == (0, 3)


def test_sizes(spark):
    long = "word " * 3000
    d = spark.createDataFrame([(1, "Hello world", 1), (2, "", 1), (3, None, 1), (4, long, 1)], "doc_id long, text string, size int")
    got = rows(p8.sized(d))
    assert [g for g in got if g[0] < 4] == [(1, 1, 0, 2), (2, 1, 0, 0)]
    mine = [g for g in got if g[0] == 4]
    assert [g[2] for g in mine] == [*range(0, sum(g[3] for g in mine), 1024)] and all(g[3] == 1024 for g in mine[:-1])


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_myers():
    def edit(a, b):
        p = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(70))] for _ in range(2))
        assert p9.myers(a, b) == edit(a, b)


def test_leaks(spark):
    rng = random.Random(10)
    voc = [f"term{i}" for i in range(3000)]
    words = lambda n: [rng.choice(voc) for _ in range(n)]
    item, other, zh = words(70), words(60), [chr(0x4E00 + rng.randrange(3000)) for _ in range(120)]
    noise = lambda w: [x if rng.random() > 0.06 else "altered" for x in w]
    docs = {
        1: words(80) + item + words(50), 2: words(90) + noise(item[10:60]) + words(20), 3: words(40) + item[:25] + words(12) + item[40:65] + words(9),  # held
        4: words(100) + item[20:38] + words(60), 5: words(150), 6: [rng.choice(item) for _ in range(200)], 7: words(30) + item[:22] + words(400) + item[48:] + words(5),  # not held
    }
    d = [(i, " ".join(w)) for i, w in docs.items()]
    d += [(8, "中" * 30 + "".join(noise(zh[:90])) + "，文" * 20), (9, " ".join(item).upper().replace("TERM1", "TERM-\n1").replace(" ", "​  ")), (10, None), (11, ""), (None, " ".join(item))]
    items = [(1, " ".join(item)), (2, "".join(zh)), (3, None), (4, ""), (5, " ".join(other))]
    df = spark.createDataFrame([(*x, 1) for x in d], "doc_id long, text string, held int")
    it = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, held int")
    want = [(1, 1), (2, 1), (3, 1), (8, 2), (9, 1)]
    assert rows(p9.leaks(df, it), "doc_id", "item_id") == want
    assert rows(p9.leaks(df, it, block=2), "doc_id", "item_id") == want
    assert p9.leaks(df.limit(0), it).count() == 0 and p9.leaks(df, it.limit(0)).count() == 0


def found(item, doc):
    return [i for i, _ in p9.Index([(1, " ".join(item))]).leaks(doc)] == [1]


def test_short_item_in_two_stretches():
    item = [f"w{i}" for i in range(20)]
    assert found(item, [*item[:5], *(f"x{i}" for i in range(6)), *item[10:12], "y", *item[13:15]])
    assert not found(item, item[:5] + ["x"] * 9)
    assert found(["one"], ["a", "one", "b"]) and not found(["one"], ["a"]) and found(["a", "b"], ["c", "a", "b"])


def test_pieces_survive_any_cut():
    """Whatever two stretches hold half of an item and wherever the errors fall, the pieces asked for stay whole."""
    for n in range(1, 60):
        x = p9.Item(" ".join(f"w{i}" for i in range(n)))
        half = (n + 1) // 2
        starts = range(0, n - x.size + 1, x.size)
        for first in range(half + 1):
            for a in range(0, n - half + 1, 3):
                for b in (a + first, a + first + 3, n - (half - first)):
                    if b < a + first or b + half - first > n:
                        continue
                    whole = sum(a <= s and s + x.size <= a + first or b <= s and s + x.size <= b + half - first for s in starts)
                    assert whole - int(half * p9.BUDGET) >= x.need, (n, x.size, x.need, first, a, b)


def test_recall_by_length_of_the_item():
    """Half of an item in one stretch or two, at random places, with a tenth altered; a third is never enough."""
    rng = random.Random(5)
    voc = [f"term{i}" for i in range(4000)]
    some = lambda n: [rng.choice(voc) for _ in range(n)]
    for n in (4, 8, 12, 16, 20, 30, 50, 80, 150):
        got = {(two, k): 0 for two in (0, 1) for k in (0, 1)}
        for _ in range(60):
            item, half = some(n), (n + 1) // 2
            for two, k in got:
                a = half // 2 * two
                i = rng.randrange(0, n - half + 1)
                j = rng.randrange(i + a, n - (half - a) + 1) if two else i
                held = item[i : i + a] + item[j : j + half - a]
                for e in rng.sample(range(half), int(half * 0.1) * k):
                    held[e] = f"other{e}"
                got[two, k] += found(item, some(60) + held[:a] + some(rng.randrange(3, 9) * two) + held[a:] + some(60))
            assert n < 12 or not found(item, some(60) + item[: n // 3] + some(60))
        assert got[0, 0] == got[1, 0] == 60 and got[0, 1] >= 58 and got[1, 1] >= 51, (n, got)


# --- 10 -------------------------------------------------------------------------------------------------------------

SENT = {
    "physics": ["The {} photon beam damps a magnetic field.", "No pendulum cools the {} laser cavity.", "The torque arm scatters a {} photon."],
    "biology": ["The {} enzyme feeds a moss colony.", "Every {} pollen grain meets the chloroplast.", "A fungal network colonizes the {} enzyme."],
    "law": ["The {} court heard the appeal.", "A {} judge signed the verdict.", "The verdict binds the {} court."],
}


def test_subjects(spark):
    rng = random.Random(11)
    say = lambda s: rng.choice(SENT[s]).format(rng.choice(["first", "second", "old", "new"]))
    lab = [(i, s, " ".join(say(s) for _ in range(3))) for i, s in enumerate([*SENT] * 30)] + [(900, None, "x"), (901, "law", None)]
    lex = p10.fit([spark.createDataFrame(lab, "key long, subject string, text string")])
    assert lex.subjects == sorted(SENT)
    plain = ["Coats may be left with the steward."] * 10
    docs = [
        (1, [say("physics")] * 4), (2, [say("physics") for _ in range(8)] + [say("biology") for _ in range(4)]), (3, [say("law") for _ in range(12)] + [say("biology")]), (4, plain), (5, plain[:7] + [say("law") for _ in range(3)]), (6, None), (7, [""]),
    ]
    d = spark.createDataFrame([(i, None if s is None else " ".join(s), 1) for i, s in docs], "doc_id long, text string, share int")
    assert rows(p10.subjects(d, lex), "doc_id", "subject") == [(1, "physics"), (2, "biology"), (2, "physics"), (3, "law"), (5, "law")]
    assert p10.subjects(d.limit(0), lex).count() == 0
    assert p10.fit([spark.createDataFrame(lab, "key long, subject string, text string")], fit_rows=5).weights.shape[1] <= 3


def test_every_problem_has_queries(spark, small):
    q = queries.queries()
    for n in range(1, 11):
        assert any(k.startswith(f"p{n}_") for k in q)
    want = {
        "p1_found": ["row_id"], "p2_found": ["row_id", "block_no"], "p3_found": ["tab", "row_a", "row_b"], "p5_found": ["tab", "keep_row", "copy_row"], "p6_found": ["row_a", "row_b"], "p7_found": ["row_id"],
        "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject"],
    }
    for k, cols in want.items():
        df = q[k](spark, small)
        assert df.columns == cols and df.count() > 0, k


def test_no_other_module_imports_this_subpackage():
    import pathlib

    import lexmill

    root = pathlib.Path(lexmill.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lexmill.llm" not in f.read_text("utf-8"), f


@pytest.mark.parametrize("name", ["p7_found"])
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW article_zh AS SELECT * FROM '{small}/article_zh.parquet'")
    assert rows(queries.queries()[name](spark, small)) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())
