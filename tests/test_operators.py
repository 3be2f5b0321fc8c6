from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.functions import unicode as uni
from lexmill.operators import dedup, gates, packing, qa, review, rights, rules, sketch, split, stats, tables, tokens
from lexmill.operators.graph import connected_components
from lexmill.operators.prefix import running
from lexmill.operators.tables import written
from lexmill.sources import files, web


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(None, 1), (5, 5)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((x, find(x)) for x in [*parent])
    assert rows(connected_components(spark.createDataFrame(edges, "src long, dst long"), written), "node", "root") == want
    assert rows(connected_components(spark.createDataFrame([], "src long, dst long"), written)) == []


def test_running(spark):
    d = spark.createDataFrame([(i * 3 % 101, i % 5) for i in range(101)], "k long, n int")
    want, total = [], 0
    for k, n in sorted((i * 3 % 101, i % 5) for i in range(101)):
        want.append((k, total))
        total += n
    assert rows(running(d, "k", F.col("n")), "k", "offset") == want
    assert rows(running(d.limit(0), "k", F.col("n"))) == []


DUP = [(1, "A b", "x"), (2, "ab", "y"), (3, None, "z"), (4, None, "w"), (5, "", "v"), (6, "ab ", "u")]


def test_exact_duplicates(spark):
    d = spark.createDataFrame(DUP, "line_no long, text string, id string").withColumn("_first", F.lit(0)).drop("_first")
    assert rows(dedup.keep_first(d, text.dedup_key(F.col("text"))), "line_no") == [(1,), (3,), (5,)]
    assert rows(dedup.duplicates_of(d, text.dedup_key(F.col("text"))), "line", "kept_line") == [(2, 1), (4, 3), (6, 1)]
    assert rows(dedup.keep_first(d.limit(0), F.col("text"))) == []


def test_prefix_duplicates(spark):
    d = spark.createDataFrame(DUP, "line_no long, text string, id string")
    assert rows(dedup.prefix_duplicates(d, 2), "line_no", "group_first", "group_size") == [(2, 2, 2), (6, 2, 2)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    texts = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(25)) for _ in range(40)]
    texts += [t[:-3] + "zzz" for t in texts[:10]] + texts[:5] + ["", "ab", "ab", None]
    data = [(i, "en" if i % 9 else "fr", t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(data, "row_id long, language string, text string")
    got = dict(rows(dedup.near_duplicates(d, uni.shingles(text.dedup_key(F.col("text"))), written), "node", "root"))
    sets = {i: {("".join(t.split()).casefold())[k : k + 5] for k in range(max(1, len("".join(t.split())) - 4))} for i, _, t in data if t is not None}
    parent = {i: i for i, _, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, la, _ in data:
        for j, lb, _ in data:
            if i < j and la == lb and i in sets and j in sets and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85 and min(len(sets[i]), len(sets[j])) > 1:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == {i: find(i) for i in parent}


def test_similar_across_matches_brute_force(spark):
    rng = random.Random(5)
    base = [sorted(rng.sample(range(400), 40)) for _ in range(30)]
    other = [sorted(set(b[:-rng.randrange(6)] if rng.random() < 0.7 else b) | {500 + i}) for i, b in enumerate(base)] + [base[0], []]
    a = spark.createDataFrame([(i, s) for i, s in enumerate(base)], "node long, sig array<long>")
    b = spark.createDataFrame([(i, s) for i, s in enumerate(other)], "node long, sig array<long>")
    jac = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = sorted((i, j) for i, x in enumerate(base) for j, y in enumerate(other) if jac(x, y) >= 0.85)
    assert rows(dedup.similar_across(a, b, written), "a", "b") == want and want


def test_gates(spark):
    d = spark.createDataFrame([("1", "g", "train", "T x"), ("1", "g", "test", "tx"), ("2", None, None, None), ("3", "h", "validation", "q")], "id string, group_id string, split string, text string")
    assert rows(gates.repeated_ids(d)) == [("1", 2)]
    assert rows(gates.groups_in_several_splits(d)) == [("g", "test,train")]
    assert rows(gates.texts_in_several_splits(d, text.dedup_key(F.col("text"))), "splits", "n") == [("test,train", 2)]
    assert rows(gates.wrong_split_labels(d, F.lit("valid")), "id") == [("1",), ("1",), ("2",)]
    train, held = d.where("split = 'train'"), d.where("split = 'test'")
    assert {r[0] for r in rows(gates.marker_overlap(train, held))} == {"id", "group_id", "text"}
    assert {r[0] for r in rows(gates.merge_overlap(train, held))} == {"id", "text"}
    with pytest.raises(ValueError, match="ids"):
        gates.require(gates.repeated_ids(d), "ids")
    gates.require(gates.repeated_ids(d.limit(0)), "ids")
    gates.check_paths("/a/train", "/a/valid", "/a/out")
    for bad in (("/a", "/a/valid", "/b"), ("/a/train", "/a/test", "/b")):
        with pytest.raises(ValueError):
            gates.check_paths(*bad)
    with pytest.raises(ValueError):
        gates.check_ranges(lr=(2.0, 0.0, 1.0))


def test_rules(spark):
    d = spark.createDataFrame([("1", "a X b", 7), ("2", "X X", 7), ("3", "X", 7), ("4", "keep", 7), (None, "n", 7)], "id string, text string, rules int").drop("rules")
    r = spark.createDataFrame([
        ("1", "cut", "remove", "X ", None, "", 1), ("1", "swap", "replace", "a", "c", "", 2), ("2", "cut", "remove", "X", None, "", 1), ("3", "cut", "remove", "X", None, "", 1), ("4", "out", "drop", None, None, "", 1),
    ], rules.RULES)
    applied = rules.apply_rules(d, r)
    assert rows(applied.select("id", "text", "dropped", F.array_join("rules", ","), F.array_join("failed", ",")).where("id IS NOT NULL")) == [
        ("1", "c b", False, "cut,swap", ""), ("2", "X X", False, "", "cut"), ("3", "X", False, "", "cut"), ("4", "keep", True, "out", "")]
    assert rows(rules.decisions(applied), "id", "decision") == [("1", "edit"), ("2", "failed"), ("3", "failed"), ("4", "drop")]
    assert rules.kept(applied).count() == 4


def test_cyclic_replacement(spark):
    d = spark.createDataFrame([(i, "x" if i % 3 else "x N N") for i in range(10)] + [(10, None)], "line_no long, text string")
    got = rows(rules.cyclic_replace(d, "N", ["p", "q"]).where("place IS NOT NULL"), "line_no", "text")
    assert got == [(0, "x p p"), (3, "x q q"), (6, "x p p"), (9, "x q q")]


def test_quarantine_and_topics(spark):
    d = spark.createDataFrame([("1", "(a"), ("2", "b")], "id string, text string")
    good, bad = rules.quarantine(d, rules.risk_flags(F.col("text")))
    assert rows(good, "id") == [("2",)] and rows(bad.select("record.id")) == [("1",)]
    assert rules.restore(bad, d.where("id = '1'")).count() == 0
    t = spark.createDataFrame([("导数", None), ("x", None)], "topic string, topic_zh string")
    m = spark.createDataFrame([("导数", "derivative")], "topic_zh string, topic_en string")
    assert sorted(map(str, rows(rules.translate_topics(t, m), "topic", "topic_zh"))) == ["('derivative', '导数')", "('x', None)"]


def test_group_assignment_is_the_sequential_fold(spark):
    groups = [(i, f"id-{i:03d}", {"a": i % 4 + 1, "b": i % 3}) for i in range(60)]
    d = spark.createDataFrame(groups, "root long, first_id string, sizes map<string,long>")
    got = dict(rows(split.assign_groups(d, 20261107)))
    order = sorted(groups, key=lambda g: g[1])
    random.Random(20261107).shuffle(order)
    total = {c: sum(g[2][c] for g in groups) for c in "ab"}
    have = {s: {"a": 0, "b": 0} for s in split.SHARES}
    for root, _, sizes in order:
        cost = {s: sum((have[s][c] + sizes[c] - total[c] * t) ** 2 - (have[s][c] - total[c] * t) ** 2 for c in sizes) / max(t, 0.01) for s, t in split.SHARES.items()}
        best = min(cost, key=cost.get)
        assert got[root] == best
        for c in sizes:
            have[best][c] += sizes[c]


def test_samples_and_windows(spark):
    d = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(101)], "k long, s string")
    rng = random.Random(7)
    pop = {"x": [i for i in range(101) if i % 2], "y": [i for i in range(101) if not i % 2]}
    want = sorted((s, i, pop[s][p]) for s in ("x", "y") for i, p in enumerate(rng.sample(range(len(pop[s])), 5)))
    assert rows(split.stratified_sample(d, "s", "k", ["x", "y"], 5, 7), "s", "draw", "k") == want
    starts = dict(rows(split.window_starts(spark, 100, 10, 42, 3)))
    assert starts == {i: random.Random((42 * 73856093) ^ (3 * 19349663) ^ (i * 83492791)).randint(0, 90) for i in range(10)}


def test_packing(spark):
    docs = [(i, [i * 10 + k for k in range(i % 4)]) for i in range(9)] + [(9, None)]
    d = spark.createDataFrame(docs, "k long, t array<int>")
    s = packing.stream(d, F.col("t"), -1, "k")
    flat = [x for _, t in docs for x in [*(t or []), -1]]
    assert rows(packing.blocks(s, 4)) == [(i, flat[4 * i : 4 * i + 4]) for i in range(len(flat) // 4)]
    starts = spark.createDataFrame([(0, 0), (1, 7), (2, len(flat) - 5)], "sample long, start long")
    assert rows(packing.windows(s, starts, 5)) == [(i, flat[a : a + 5]) for i, a in ((0, 0), (1, 7), (2, len(flat) - 5))]
    with pytest.raises(ValueError):
        packing.blocks(s, 1000)
    assert packing.blocks(s, 1000, strict=False).count() == 0
    e = rows(packing.eval_blocks(spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1]), (3, [1, 2, 3])], "k long, t array<int>"), F.col("t"), 2), "k", "block_no", "block")
    assert e == [(1, 0, [1, 2]), (1, 1, [3, 4]), (3, 0, [1, 2])]
    assert packing.block_size(128, 10) == 10


def test_bpe(spark):
    t = ["low low lower", "newest newest widest  x", "中文 中文", "", None]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(t)], "i long, text string")
    merges = tokens.train(tokens.pretoken_counts(d), 256 + 4 + 30)
    assert len(merges) <= 30 and len({*merges}) == len(merges)
    ids = d.select("i", "text", tokens.encode(F.col("text"), merges).alias("e"))
    back = ids.select("i", tokens.decode(F.col("e"), merges).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in back] == t
    # an independent implementation gives the same tokens
    hf = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = tokens.vocabulary_of(merges)
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert hf
    for r in ids.where("text IS NOT NULL").collect():
        assert r["e"] == tok.encode(r["text"]).ids


def merges_by_count(words, room):
    """Merges one by one, all pairs counted anew each time."""
    letter, out, known = tokens.byte_letters(), [], set()
    words = {w: ([letter[b] for b in w.encode()], n) for w, n in words.items()}
    while len(known) < room:
        n = {}
        for t, k in words.values():
            for p in zip(t, t[1:]):
                n[p] = n.get(p, 0) + k
        if not n:
            break
        best = min(n, key=lambda p: (-n[p], p))
        out.append(best)
        known.add("".join(best))
        for t, _ in words.values():
            i = 0
            while i + 1 < len(t):
                if (t[i], t[i + 1]) == best:
                    t[i : i + 2] = ["".join(best)]
                i += 1
    return out


def test_bpe_merges_of_long_words(spark, monkeypatch):
    """Words of many letters, as Chinese clauses are: a merge must not go over all of a word's pairs again."""
    import time

    rng = random.Random(3)
    few = {"".join(rng.choice(a) for _ in range(rng.choice([1, 2, 9, 40]))): rng.choice([1, 1, 2, 5]) for a in ("a", "ab", "aé中", "abcd") for _ in range(12)}
    many = {"".join(rng.choice("的一是在不了有和人这中大为上个国我以要他") for _ in range(60)): 1 for _ in range(3000)}
    of = lambda words: spark.createDataFrame([*words.items()], "word string, n long")
    for chunk in (3, tokens.CHUNK):  # places in parts of a run
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        assert tokens.train(of(few), 256 + 4 + 150) == merges_by_count(few, 150)
        assert tokens.train(of(few).limit(0)) == []
    began = time.process_time()
    assert len(tokens.train(of(many), 256 + 4 + 1000)) == 1000
    assert time.process_time() - began < 10


def test_quick_signatures_find_the_same(spark):
    """Sets by the quick hash are as large and share as much as those by a digest; so the components are the same."""
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef gé中文ß") for _ in range(90)) for _ in range(12)]
    texts = [x if k == 0 else x[:k] + "z" + x[k + 1 :] for x in base for k in (0, 1, 44, 60)] + [*base[:3], base[0].upper() + " ", None, "", "ab", "A B", "ab\0", "abcde", "aaaaaaaa", "😀ßẞᾳ x", "😀ssß ᾳx", "\u1e9e\u0345abc"]
    d = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "row_id long, text string, language string")
    slow, quick = uni.key_shingles(F.col("text"), digest="md5"), uni.quick_shingles(F.col("text"))
    got = d.select(slow.alias("x"), quick.alias("y")).collect()
    for a in got:
        assert (a["x"] is None) == (a["y"] is None)
        if a["x"] is not None:
            assert a["y"] == sorted({*a["y"]}) and len(a["x"]) == len(a["y"])
            assert all(len({*a["x"]} & {*b["x"]}) == len({*a["y"]} & {*b["y"]}) for b in got if b["x"] is not None)
    of = lambda **k: rows(dedup.near_duplicates(d, slow, tables.written, **k), "node", "root")
    assert of(quick=quick) == of() and len({r for _, r in of()}) < len(texts)


def test_counters_of_all_widths(spark):
    """Counters pass as blocks, whatever their width; of places without a count nothing is passed on."""
    values = [-5, 0, 1, 1, 7, 2**62, -(2**63)]
    d = spark.createDataFrame([([v],) for v in values] + [([],), (None,)], "x array<long>").repartition(3)
    for width in (10, 1 << 15, 3 << 14):
        want = [0] * width
        for v in values:
            want[v % 2**64 % width] += 1
        assert sketch.counts(d, width).tolist() == want
        assert sketch.counts(d.limit(0), width).tolist() == [0] * width


def test_losses(spark):
    d = spark.createDataFrame([("a", 2.0, 3), ("a", 1.0, 2), ("a", 9.0, 1), ("b", 9.0, 1)], "f string, loss double, size int")
    assert rows(stats.weighted_loss(d, ["f"]), "f", "n_tokens", "mean_loss") == [("a", 3, 5 / 3), ("b", 0, 0.0)]
    with pytest.raises(Exception, match="no tokens"):
        stats.weighted_loss(d.where("f = 'b'"), ["f"], strict=True).collect()
    big = spark.createDataFrame([("a", 200.0, 3)], "f string, loss double, size int")
    assert stats.weighted_loss(big, ["f"], strict=True).first()["perplexity"] == float("inf")


def test_questions_and_ids(spark):
    d = spark.createDataFrame([(1, " q ", "a", "zh", None), (2, "q", "a", None, None), (3, "", "a", "en", None), (4, "x", "y", "EN-us", "own"), (5, "u", "v", "en", None)], "line_no long, question string, answer string, language string, id string")
    got = rows(qa.build_qa(d), "line_no", "id", "language", "text")
    assert got == [(1, "qa-zh-0001", "zh", "问：q\n答：a"), (4, "own", "en", "Q: x\nA: y"), (5, "qa-en-0005", "en", "Q: u\nA: v")]
    old = spark.createDataFrame([("Q: u\nA: v",)], "text string")
    assert [r[0] for r in rows(qa.build_qa(d, old), "line_no")] == [1, 4]
    new = qa.continue_ids(d, spark.createDataFrame([("p-000007",), ("q-9",)], "id string"), "p", "line_no")
    assert [r[1] for r in rows(new, "line_no", "id")] == [f"p-{i:06d}" for i in range(8, 13)]


def test_rights_and_review(spark):
    d = spark.createDataFrame([(1, "a", "https://h/x", "T", "copyright me"), (2, "b", "https://h/x", None, "no"), (3, "c", None, "T", "x"), (4, "d", None, None, "x")], "line_no long, id string, source_url string, source_title string, text string")
    inv = rights.source_inventory(d)
    assert rows(inv, "source_kind", "record_count", "record_ids", "signal_ids") == [("title", 1, ["c"], []), ("url", 2, ["a", "b"], ["a"])]
    act = rights.only_active(inv, d.where("id IN ('b', 'd')"))
    assert rows(act, "source_key", "record_ids") == [("https://h/x", ["b"])]
    sheet = review.review_sheet(d, ["source_title"]).select(F.replace("block", F.lit("[ ] pass"), F.lit("[x] pass")).alias("block"))
    assert rows(review.review_results(sheet)) == [("pass", 4)]


def test_files(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text("\n".join([json.dumps({"id": "1", "text": "é", "new": 5}), "", json.dumps({"id": "2", "text": "x"})]), "utf-8")
    (p / "b.txt").write_text("  one \n\n two\n", "utf-8")
    assert [f.rsplit("/", 1)[1] for f in files.discover(spark, str(p), ("b", "a"))] == ["b.txt", "a.jsonl"]
    assert len(files.discover(spark, str(p), ("zz",))) == 2
    with pytest.raises(FileNotFoundError):
        files.discover(spark, str(p), ("zz",), fallback=False)
    d = files.read_jsonl(spark, str(p / "a.jsonl"))
    assert rows(d.select("id", "text", "line_no", F.col("extra")["new"].alias("n"))) == [("1", "é", 1, "5"), ("2", "x", 3, None)]
    assert rows(files.read_txt(spark, str(p / "b.txt")), "text", "line_no") == [("one", 1), ("two", 3)]
    (p / "bad.jsonl").write_text('{"id": "3"}\n', "utf-8")
    with pytest.raises(Exception, match="no text"):
        files.read_jsonl(spark, str(p / "bad.jsonl")).collect()
    assert files.read_jsonl(spark, str(p / "bad.jsonl"), strict=False).count() == 0
    out = str(tmp_path / "out")
    files.write_jsonl(d.select("id", "text"), out, order=["id"])
    files.write_jsonl(d.select("id", "text"), out, mode="append")
    assert spark.read.json(out).count() == 4
    files.replace_atomically(d.select("id", "text"), out)
    assert spark.read.json(out).count() == 2
    with pytest.raises(ValueError):
        files.replace_atomically(d, out, source=out)
    files.write_split_files(d.select("id", "text", F.lit("train").alias("split"), F.lit("zh").alias("category")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s/_s=train/_c=zh")).count() == 2
    h = files.file_hashes(spark, [str(p / "a.jsonl"), str(p / "b.txt")])
    sha = {n: hashlib.sha256((p / n).read_bytes()).hexdigest() for n in ("a.jsonl", "b.txt")}
    assert dict(rows(h)) == sha
    assert files.combined_fingerprint(h).first()[0] == hashlib.sha256("".join(f"{n} {s}\n" for n, s in sorted(sha.items())).encode()).hexdigest()
    want = spark.createDataFrame([("a.jsonl", sha["a.jsonl"]), ("c", "x")], "name string, sha256 string")
    assert rows(files.verify_files(h, want)) == [("b.txt", "not listed"), ("c", "missing")]
    assert files.read_test_set(spark, str(tmp_path / "none")).count() == 0


def test_web(spark):
    def fetch(u):
        if "bad" in u:
            raise OSError("gone")
        return "<body><article>hello</article></body>" if "ok" in u else ""

    d = spark.createDataFrame([("ok",), ("bad",), ("empty",)], "url string")
    assert sorted(map(str, rows(web.fetch_pages(d, fetch), "url", "text", "skipped"))) == ["('bad', None, \"fetch failed: OSError('gone')\")", "('empty', '', 'empty text')", "('ok', 'hello', None)"]
    got = rows(web.probe_pages(d, lambda u: (200, u) if u != "bad" else 1 / 0), "url", "http_status")
    assert sorted(map(str, got)) == ["('bad', None)", "('empty', 200)", "('ok', 200)"]
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert web.with_retries(flaky, pause=lambda k: 0)("a") == "a" and len(calls) == 3


def test_streaming(spark, tmp_path):
    from lexmill.streaming import ingest

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / f"in/{k}.jsonl").write_text("\n".join(json.dumps({"id": f"{k}{i}", "text": t}) for i, t in enumerate(["A b", "ab", " ", "c"])), "utf-8")
    q = ingest.append_table(ingest.first_seen(ingest.record_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pairs_of_hot_sketches_are_found_too(spark):
    """Whatever counts as hot, the same pairs come out, and they are those of the rule."""
    rng = random.Random(3)
    data = []
    for i in range(120):
        s = {*range(30)} if i % 3 else {*rng.sample(range(400), 30)}
        s = {x for x in s if rng.random() > 0.05} | {1000 + rng.randrange(3)}
        data.append((i, "en" if i % 5 else None, sorted(s)))
    d = spark.createDataFrame(data, "node long, language string, sig array<long>")
    want = sorted(
        (i, j) for i, a, x in data for j, b, y in data
        if i < j and a == b and len({*x} & {*y}) / len({*x} | {*y}) >= 0.85 and len({*x[:12]} & {*y[:12]}) >= 2)
    assert want
    for hot in (0, 2, 20, 500):
        assert rows(dedup.similar_pairs(d, written, hot=hot), "a", "b") == want


def test_pairs_of_large_and_small_sets_match_brute_force(spark):
    rng = random.Random(12)
    data = []
    for size in (100, 124, 128, 135, 250):
        for _ in range(6):
            s = rng.sample(range(5000), size)
            data += [sorted({*s[k:]} | {9000 + rng.randrange(50) for _ in range(k // 2)}) for k in (0, 3, 9, size // 12, size // 7)]
    d = spark.createDataFrame([(i, "en", s) for i, s in enumerate(data)], "node long, language string, sig array<long>")
    want = [(i, j) for i, x in enumerate(data) for j, y in enumerate(data) if i < j and len({*x} & {*y}) / len({*x} | {*y}) >= 0.85 and len({*x[:12]} & {*y[:12]}) >= 2]
    assert want and rows(dedup.similar_pairs(d, written), "a", "b") == want


def test_near_duplicates_keep_no_table_of_signatures(spark):
    """Signatures are several times the text: no intermediate table may hold them."""
    kept = []

    def watched(df):
        kept.extend(df.dtypes)
        return written(df)

    t = "one text that is long enough to have more than a few shingles of its own"
    d = spark.createDataFrame([(1, "en", t), (2, "en", t), (3, "en", t + "s"), (4, "fr", t), (5, None, t), (6, None, t + "s"), (7, "en", None)], "row_id long, language string, text string")
    got = dict(rows(dedup.near_duplicates(d, uni.key_shingles(F.col("text")), watched), "node", "root"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert kept and not [x for x in kept if x[1].startswith("array")]


def test_large_texts_that_share_phrases_are_no_candidates(spark):
    """Of texts of thousands of shingles 256 bits tell nothing: pairs that share a few rare phrases were all compared as texts."""
    rng = random.Random(8)
    phrase = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(400)]
    texts = ["".join(rng.sample(phrase, 60)) for _ in range(40)]
    texts += [texts[3][:-30] + "w" * 30, "zq" + texts[4][60:], texts[5], None, ""]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "row_id long, text string, language string").repartition(3)
    found = []

    def watched(df):
        out = tables.written(df)
        if out.columns == ["a", "b"]:
            found.extend(rows(out))
        return out

    for sig, quick in ((uni.key_made(F.col("text")), None), (uni.key_shingles(F.col("text")), uni.quick_made(F.col("text"))), (uni.key_shingles(F.col("text")), None)):
        found.clear()
        got = dict(rows(dedup.near_duplicates(d, sig, watched, quick=quick), "node", "root"))
        assert got == {i: {40: 3, 41: 4, 42: 5}.get(i, i) for i in range(len(texts))}
        assert sorted(found) == [(3, 40), (4, 41)]


def test_pairs_compared_in_python_are_the_same(spark):
    rng = random.Random(9)
    word = ["".join(rng.choice("abcdeé日本語中文") for _ in range(4)) for _ in range(60)]
    base = [[rng.choice(word) for _ in range(rng.choice((1, 3, 20, 60)))] for _ in range(60)]
    texts = [" ".join(w if rng.random() > rng.choice((0, 0.02, 0.05)) else rng.choice(word) for w in b) for b in base for _ in range(3)] + [None, "", "", "Ａb\u0130", "ab"]
    d = spark.createDataFrame([(i, t, rng.choice(("en", "en", None))) for i, t in enumerate(texts)], "node long, text string, language string").repartition(4)
    for bottom, shared in ((12, 2), (3, 3)):
        got = [rows(dedup.similar_pairs(d, written, bottom=bottom, shared=shared, sig=sig)) for sig in (uni.key_made(F.col("text")), uni.key_shingles(F.col("text")))]
        assert got[0] == got[1] and len(got[0]) > 20
    plan = dedup.similar_pairs(d, written, sig=uni.key_made(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrayType" not in plan and "array_intersect" not in plan  # sets of whole batches took an executor's memory


def test_wide_parities_bound_the_difference(spark):
    rng = np.random.default_rng(4)
    for n, k, m in ((512, 40, 40), (1030, 90, 0), (5000, 700, 300), (16, 3, 2)):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, n + k + m, dtype=np.int64))
        a, b = x[:n], np.r_[x[k:n], x[n:]]
        for p, q in ((a, b), (b, a)):
            d = len(np.setxor1d(p, q))
            if n >= sketch.WIDE:
                got = sketch.parities_differ(sketch.wide_parities(p), sketch.wide_parities(q))
                assert got <= d and got > d / 3 and (d - got) % 2 == 0
    count = rng.integers(0, 4, 1 << 10).astype(np.int32)
    sizes, take = np.array([5, 1, 300, 40]), np.array([2, 1, 50, 60])
    flat = np.concatenate([np.sort(rng.choice(10**6, n, replace=False)) for n in sizes]).astype(np.int64)
    want = [(r, int(e), p) for r, at in enumerate(np.cumsum(sizes) - sizes) for p, (c, e) in enumerate(sorted((max(int(count[e % 1024]), 1), int(e)) for e in flat[at : at + sizes[r]])) if p < take[r] and c > 1]
    assert list(zip(*(x.tolist() for x in sketch.rare_first(sizes, flat, count, take)))) == want


def test_groups_are_named_and_written_back(spark):
    import hashlib

    recs = [(1, "a", "x", "g1", "old", "t"), (2, "b", "x", None, "old", "t"), (3, "c", "y", None, "old", "t"), (4, "e", "y", None, None, "t"), (5, "d", "x", None, None, "t"), (6, "f", "x", "g2", None, "t"), (7, "h", "x", "g3", None, "t"), (9, "z", "x", "g9", "old", "t")]
    d = spark.createDataFrame(recs, "row_id long, id string, category string, group_id string, split string, text string")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)], "node long, root long")
    members = d.join(roots, d["row_id"] == roots["node"]).select("root", "id")
    near = lambda *ids: "near-" + hashlib.sha256("\n".join(ids).encode()).hexdigest()[:16]
    g = split.group_name(split.group_rows(d, roots), members)
    assert rows(g, "root", "n_ids", "group_id") == [(1, 2, "g1"), (3, 1, "record-c"), (4, 2, near("d", "e")), (6, 2, near("f", "h"))]
    done = split.write_back(d, g.join(split.assign_groups(g, 1), "root"), roots)
    got = {r["row_id"]: r for r in done.collect()}
    assert len(got) == 8 and done.columns == d.columns and got[9]["split"] == "old" and got[9]["group_id"] == "g9"
    assert got[4]["group_id"] == got[5]["group_id"] == near("d", "e") and got[4]["split"] == got[5]["split"] in split.SHARES
    assert split.assign_groups(g.limit(0), 1).count() == 0


def test_manifests_and_counts(spark):
    d = spark.createDataFrame([("f", 2), ("f", None), ("g", 5)], "file string, t int")
    h = spark.createDataFrame([("f", "aa")], "name string, sha256 string")
    m = stats.manifest(d, "file", F.col("t"), h)
    assert rows(m, "file", "n_records", "n_tokens", "sha256") == [("f", 2, 2, "aa"), ("g", 1, 5, None)]
    assert rows(stats.manifest_totals(m)) == [(2, 3, 7)] and rows(stats.manifest_totals(m.limit(0))) == [(0, 0, 0)]
    t = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "source_title string")
    assert [tuple(r) for r in stats.value_counts(t).collect()] == [("b", 2), ("a", 1), (None, 1)]


def test_schedule():
    warm, f = stats.schedule(10, 0.2, 2.0)
    assert warm == 2 and f[:3] == [0.0, 1.0, 2.0] and f[-1] < 0.1 and len(f) == 10
    assert stats.schedule(0, 0.1) == (0, [])


def test_extracts_and_requests(spark):
    import json

    from lexmill.sources import web

    assert web.api_address("https://w.example/api", titles=["a b", "c"], redirects=1) == "https://w.example/api?format=json&formatversion=2&titles=a+b%7Cc&redirects=1"

    def fetch(address):
        if "bad" in address:
            raise OSError("down")
        return json.dumps({"query": {"pages": [{"extract": "" if "empty" in address else "Text."}]}}) if "none" not in address else "{}"

    d = spark.createDataFrame([("good", "clash"), ("empty", "clash"), ("none", "clash"), ("bad", "clash")], "title string, text string")
    got = {r["title"]: (r["text"], r["skipped"]) for r in web.fetch_extracts(d, fetch, "https://w.example/api").collect()}
    assert got["good"] == ("Text.", None) and got["empty"] == got["none"] == ("", "empty extract") and got["bad"][1].startswith("fetch failed")


def test_file_hashes_and_labels(spark, tmp_path):
    import hashlib

    from lexmill.sources import files

    (tmp_path / "a.bin").write_bytes(b"x" * 3_000_001)
    (tmp_path / "b.txt").write_text("one\n\ntwo\n")
    (tmp_path / "c.txt").write_text("three")
    got = rows(files.file_hashes(spark, [f"{tmp_path}/a.bin", f"file://{tmp_path}/b.txt"], chunk=1000))
    assert got == [(n, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in ("a.bin", "b.txt")]
    labels = files.read_labels(spark, [f"{tmp_path}/b.txt", f"{tmp_path}/c.txt"], 3)
    assert rows(files.zip_labels(labels, ["x", "y", "z"])) == [(0, "x", "one"), (1, "y", "two"), (2, "z", "three")]
    for bad in (["x"], ["x", "x", "z"]):
        with pytest.raises(ValueError):
            files.zip_labels(labels, bad)
    big = tmp_path / "big.txt"
    big.write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many splits of one file
    try:
        t = files.read_txt(spark, str(big))
        assert t.where("text <> concat('line ', line_no - 1)").count() == 0 and t.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_local_folder_on_a_cluster():
    from unittest import mock

    from lexmill.operators import tables

    s = mock.Mock()
    s.conf.get.return_value = None
    s.sparkContext.getCheckpointDir.return_value = None
    s.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_root(s)
    s.conf.get.return_value = "hdfs://x/y/"
    assert tables.shared_root(s) == "hdfs://x/y"


def test_reports_and_articles(spark, tmp_path):
    from lexmill.operators import rights

    d = spark.createDataFrame([(1, "a", "https://h.example/p", "T", "all rights: licence"), (2, "b", None, "A b", "x"), (3, "c", "https://h.example/p", None, "copyright"), (4, "d", None, None, "x")], "line_no long, id string, source_url string, source_title string, text string")
    pol = spark.createDataFrame([("h.example", "https://h.example/policy", "H")], "host string, policy string, agency string")
    inv = rights.source_inventory(d, pol, title_host="w.example", title_page="https://w.example/", pages=spark.createDataFrame([("A b", "A c")], "title string, current_title string"))
    got = {r["source_key"]: r for r in inv.collect()}
    assert got["https://h.example/p"]["record_ids"] == ["a", "c"] and got["https://h.example/p"]["signal_ids"] == ["c"] and got["https://h.example/p"]["rights_status"] == rights.STATUS[0]
    assert got["A b"]["candidate_url"] == "https://w.example/A%20c" and got["A b"]["host"] == "w.example" and got["A b"]["rights_status"] == rights.STATUS[1]
    lines = [r["line"] for r in rights.attribution_lines(inv, pol, ["# Top"], ["End"]).orderBy("host", "part", "t", "u").collect()]
    assert lines[0] == "# Top" and lines[-1] == "End" and "## H: 1 pages, 2 records" in lines and "| [A b](https://w.example/A%20c) | [history](https://w.example/A%20c?action=history) | 1 |" in lines
    rights.write_report(rights.attribution_lines(inv, pol, ["# Top"], ["End"]), f"file://{tmp_path}/report")
    said = [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()]
    assert sorted(said) == sorted(lines)
    kept, short = text.clean_articles(spark.createDataFrame([("好" * 240,), ("短",), (" ",), (None,)], "text string"))
    assert kept.count() == 1 and sorted(r["skipped"] for r in short.collect()) == ["empty extract", "empty extract", "too short after clean"]
