"""The queries for the corpus operators, each over whole tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import html, text
from lexmill.functions import unicode as uni
from lexmill.operators import dedup, gates, packing, qa, review, rights, rules, split, stats, tokens
from lexmill.operators.sketch import among
from lexmill.operators.tables import shared_root, spread, written
from lexmill.sources import files
from lexmill.sources.files import combined_fingerprint
from lexmill.sources.web import look_up_revisions, resolve_titles

SEED = 20261107


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").withColumn("line_no", F.col("doc_id"))


def _split(c: str = "split") -> Column:
    s = F.lower(c)
    return F.when(s == "validation", "valid").otherwise(s)


def _words(c: Column) -> Column:
    """Words between blanks."""
    return F.filter(F.split(c, f"[{text.WS}]+"), lambda w: w != "")


def _codes(c: Column) -> Column:
    """Code points of a text as tokens."""
    return F.transform(F.split(c, ""), lambda x: F.ascii(x))


# --- duplicates -----------------------------------------------------------------------------------------------------


def exact_dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    df = _docs(spark, d)
    return dedup.keep_first(df.select("doc_id", "lang", "n_chars", "line_no", "text"), text.dedup_key(F.col("text"))).select("doc_id", "lang", "n_chars")


def dedup_decision_log(spark: SparkSession, d: str) -> DataFrame:
    df = _docs(spark, d)
    log = dedup.duplicates_of(df, text.dedup_key(F.col("text")), "doc_id")
    sha = df.select("doc_id", text.sha256(F.col("text")).alias("original_text_sha256"))
    return log.join(sha, log["id"] == sha["doc_id"]).select("doc_id", F.col("kept_id").alias("kept_doc_id"), F.lit("EXACT_DUPLICATE_V1").alias("rule_id"), "original_text_sha256")


def dedup_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Key and counts are taken first, and of each key the first row's: no text is moved, and each is read once."""
    df = _docs(spark, d).select("line_no", "lang", text.sha256(text.dedup_key(F.col("text"))).alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.coalesce(F.size(_words(F.col("text"))), F.lit(0)).alias("t"))
    kept = dedup.first_values(df, "key", "line_no", ["lang", "n", "t"])
    return kept.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("t").alias("n_tokens"), F.avg("t").alias("mean_tokens"))


def nfc_duplicates(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "natural_zh")
    return dedup.duplicates_of(df, uni.blank_key(F.col("text")), "row_id", "row_id").select(F.col("id").alias("row_id"), F.col("kept_id").alias("kept_row_id"))


def prefix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "english").select("row_id", "text")
    return dedup.prefix_duplicates(df, 15, "text", "row_id").select("row_id", "group_first", "group_size")


def _sig() -> Column:
    """The shingles of a text, hashed by a digest that SQL engines have too."""
    return uni.key_shingles(F.col("text"), digest="md5")


def _texts(spark: SparkSession, d: str, table: str) -> DataFrame:
    return _t(spark, d, table).where(F.col("text").isNotNull()).withColumn("node", F.col("row_id"))


def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    df = _texts(spark, d, "natural_zh").select("row_id", "language", "text")
    return dedup.near_duplicates(df, _sig(), written).select(F.col("node").alias("row_id"), F.col("root").alias("component"))


def _near_pairs(df: DataFrame) -> DataFrame:
    """Pairs of distinct sets of one language; a copy has the node of its first row."""
    df = df.select("node", "language", "text")
    return dedup.similar_pairs(among(df, dedup.copies_of(df, _sig(), written).select("node"), False), written, sig=_sig())


def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct sets of one language."""
    return _near_pairs(_texts(spark, d, "natural_zh")).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"), F.round("jaccard", 6).alias("jaccard"))


def separated_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs whose present splits differ: the gate on the old assignment."""
    df = _texts(spark, d, "english")
    pairs = written(_near_pairs(df).select("a", "b"))
    splits = df.select("node", _split().alias("split")).where(F.col("split").isNotNull())
    return gates.separated_pairs(pairs, splits).select(F.col("a").alias("row_a"), F.col("b").alias("row_b"), "split_a", "split_b")


def cross_split_near_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    df = written(_t(spark, d, "english").where(F.col("text").isNotNull()).select("row_id", _split().alias("s"), uni.shingles(text.dedup_key(F.col("text"))).alias("sig")))
    side = lambda c: df.where(c).select(F.col("row_id").alias("node"), "sig")
    p = dedup.similar_across(side(F.col("s").isin("valid", "test")), side(F.col("s") == "train"), written)
    return p.select(F.col("a").alias("held_row"), F.col("b").alias("train_row"), F.round("jaccard", 6).alias("jaccard"))


def provenance_match(spark: SparkSession, d: str) -> DataFrame:
    new = _t(spark, d, "documents").where(F.col("source_title").isNull()).select("doc_id", "text", "source", "source_title")
    old = _t(spark, d, "documents").where(F.col("source_title").isNotNull()).select("text", "source_title")
    return rules.match_provenance(new, old, ["source_title"]).select("doc_id", "source_title", "matched")


def title_group_fill(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_zh").select("row_id", "source_title", F.col("group_id").alias("old_group"), "group_id")
    return rules.fill_group_by_title(df).where(F.col("old_group").isNull()).select("row_id", "source_title", "group_id")


# --- statistics -----------------------------------------------------------------------------------------------------


def corpus_stats_by_lang(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").where(~text.is_blank(F.col("text")))
    return stats.corpus_stats(df, F.size(_words(F.col("text"))), ["lang", "source"])


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    return stats.corpus_totals(_t(spark, d, "documents").where(~text.is_blank(F.col("text"))), _words(F.col("text")))


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").withColumn("s", _split())
    return split.split_counts(df, "source", "s")


def metadata_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(_t(spark, d, "article_en"), "domain", ["source", "source_url", "source_title", "group_id"])


def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").select("row_id", rules.risk_flags(F.col("text")).alias("flags"))
    return df.where(F.size("flags") > 0).select("row_id", F.array_join("flags", ",").alias("flags"))


def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.flag_counts(_t(spark, d, "article_en").select(rules.risk_flags(F.col("text")).alias("flags")))


def manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    df = _docs(spark, d)
    n = F.size(_words(F.col("text")))
    kept = dedup.keep_first(df.select("line_no", "source", "text"), text.dedup_key(F.col("text")))
    return stats.manifest_delta(stats.manifest(df, "source", n), stats.manifest(kept, "source", n))


def token_weighted_ppl(spark: SparkSession, d: str) -> DataFrame:
    """The losses are made up: a fixed function of the text's length."""
    df = _t(spark, d, "documents").select("lang", F.length("text").alias("size"), (F.col("doc_id") % 7 / 4 + 1).alias("loss"))
    g = stats.weighted_loss(df, ["lang"])
    return g.select("lang", "n_tokens", F.round("mean_loss", 9).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"))


def overall_ppl(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").select("source", F.length("text").alias("size"), (F.col("doc_id") % 7 / 4 + 1).alias("loss"))
    return stats.overall_loss(stats.weighted_loss(df, ["source"])).select("n_tokens", F.round("mean_loss", 9).alias("mean_loss"), F.round("perplexity", 6).alias("perplexity"))


def early_stop_fold(spark: SparkSession, d: str) -> DataFrame:
    """A run per source, an epoch per month of arrival; the loss falls with the mean length of its documents."""
    df = _t(spark, d, "documents").where(F.col("source").isNotNull() & F.col("ingested_at").isNotNull())
    loss = F.round(1000 / (F.avg("n_chars") + 1), 6)
    runs = df.groupBy(F.col("source").alias("run"), (F.year("ingested_at") * 12 + F.month("ingested_at")).cast("long").alias("epoch")).agg(loss.alias("eval_loss"))
    return stats.early_stopping(runs, 0.01, 3)


def _files(spark: SparkSession, d: str) -> tuple[str, list[str]]:
    """A folder of text files, one line per source of the catalog: all titles, and all addresses."""
    root = f"{shared_root(spark)}/lexmill-files-{uuid.uuid4().hex}"
    c = _t(spark, d, "source_catalog")
    for name in ("title", "url"):
        c.where(F.col(name).isNotNull()).orderBy(name, "id").coalesce(1).select(name).write.text(f"{root}/{name}")  # 60 rows at any scale
    found = spark.read.format("binaryFile").load(f"{root}/*/*.txt").select("path").collect()
    return root, sorted(r["path"] for r in found)


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of written files; a file is named by its folder."""
    _, paths = _files(spark, d)
    return files.file_hashes(spark, paths, named=lambda p: p.split("/")[-2])


def fingerprint_combined(spark: SparkSession, d: str) -> DataFrame:
    return combined_fingerprint(file_hashes(spark, d))


def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Records, tokens and hash of the two files, with the totals of all as a row of their own."""
    c = _t(spark, d, "source_catalog")
    rows = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("file"), F.col(n).alias("text")) for n in ("title", "url")])).alias("x")).select("x.*").where(F.col("text").isNotNull())
    m = stats.manifest(rows, "file", F.size(_words(F.col("text"))), file_hashes(spark, d))
    total = stats.manifest_totals(m).select(F.lit("all").alias("file"), "n_records", "n_tokens", F.lit(None).cast("string").alias("sha256"))
    return m.unionByName(total)


def title_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(_t(spark, d, "article_zh"), "source_title")


def strict_loss(spark: SparkSession, d: str) -> DataFrame:
    """As in a training run: no tokens are an error, a loss of 100 or more has an infinite perplexity (every seventh group here)."""
    df = _t(spark, d, "documents").where(F.length("text") >= 2).select((F.col("doc_id") % 7).alias("part"), F.length("text").alias("size"), F.when(F.col("doc_id") % 7 == 0, 101.5).otherwise(F.col("doc_id") % 7 / 4 + 1).alias("loss"))
    return stats.weighted_loss(df, ["part"], strict=True).select("part", "n_tokens", F.round("mean_loss", 9).alias("mean_loss"), F.when(F.col("perplexity") == float("inf"), -1.0).otherwise(F.round("perplexity", 6)).alias("perplexity"))


# --- text -----------------------------------------------------------------------------------------------------------


def sentence_split_en(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").select("row_id", F.posexplode(text.sentences_en(F.col("text"))).alias("place", "sentence"))
    return df.groupBy("row_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max(F.length("sentence")).alias("longest"))


def chunk_en(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "english").select("row_id", F.posexplode(text.chunk(text.sentences_en(F.col("text")))).alias("k", "chunk"))
    return df.select("row_id", (F.col("k") + 1).alias("chunk_index"), "chunk")


def zh_sentence_chunk(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_zh").select("row_id", F.posexplode(text.chunk(text.sentences_zh(F.col("text")))).alias("k", "chunk"))
    return df.select("row_id", (F.col("k") + 1).alias("chunk_index"), "chunk")


def zh_sentences(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_zh").select("row_id", F.posexplode(text.sentences_zh(F.col("text"))).alias("k", "sentence"))
    return df.select("row_id", (F.col("k") + 1).alias("place"), "sentence")


#: Parts of an encyclopedia extract that the cleaning takes out or changes; a text gets some of each by its number.
WIKI_INSIDE = ("[[File:图.jpg|thumb]]", "[[页面|标签]]", "{\\displaystyle x^{2}+1}", "[12]", "（原文如此）", "&nbsp;", "{x \\frac a}", "[[标签]]（１２）", " a\u2212b  \u03bb ")
WIKI_TAIL = ("\n== 歷史 ==\n后文。", "\n== 參考文獻 ==\n引用。", "\n\n  后 段 \u3000", "\n=== 外部連結 ===\n* x")
WIKI_LEAD = ("本條目介紹一個主題。", "", "  ")


def zh_clean(spark: SparkSession, d: str) -> DataFrame:
    """The texts with parts of an encyclopedia extract put in; the texts below the least length are told apart."""
    pick = lambda parts: F.element_at(F.array(*[F.lit(x) for x in parts]), (F.col("row_id") % len(parts) + 1).cast("int"))
    wiki = F.concat(pick(WIKI_LEAD), F.substring("text", 1, 20), pick(WIKI_INSIDE), F.expr("substring(text, 21)"), pick(WIKI_TAIL))
    done = text.cleaned_articles(_t(spark, d, "article_zh").select("row_id", wiki.alias("text")))
    return done.select("row_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"), "skipped")


def zh_punct_space(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "natural_zh").select("row_id", text.count_space_after_zh(F.col("text")).alias("n_removed"), text.space_after_zh(F.col("text")).alias("text"))
    return df.where(F.col("n_removed") > 0)


def punct_changes_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return stats.change_counts(_t(spark, d, "natural_zh"), "domain", F.coalesce(text.count_space_after_zh(F.col("text")), F.lit(0)))


def en_punct_space(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").select("row_id", "text", text.space_before_punctuation(F.col("text"), "en").alias("fixed"))
    return df.where(F.col("text") != F.col("fixed")).select("row_id", "fixed")


def zh_space_before_punct(spark: SparkSession, d: str) -> DataFrame:
    """A blank is put before each comma and stop; those after Han go again."""
    df = _t(spark, d, "article_zh").select("row_id", F.regexp_replace("text", "([，。])", " $1").alias("text"))
    df = df.select("row_id", "text", text.space_before_punctuation(F.col("text"), "zh").alias("fixed"))
    return df.where(F.col("text") != F.col("fixed")).select("row_id", "fixed")


def paren_balance(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "natural_zh").where(F.col("text").isNotNull())
    return df.select("row_id", text.parens_balanced(F.col("text"), 1).alias("balanced"), text.parens_balanced(F.col("text")).alias("nearly"))


def title_links(spark: SparkSession, d: str) -> DataFrame:
    """Page and history address of every title."""
    df = _t(spark, d, "article_zh").select("source_title").distinct().where(F.col("source_title").isNotNull())
    page = F.concat(F.lit("https://pages.example/wiki/"), text.quote_title(F.col("source_title")))
    return df.select("source_title", page.alias("page"), text.history_address(page).alias("history"))


def seed_priority(spark: SparkSession, d: str) -> DataFrame:
    """Topics as seeds; their priority is given by their length."""
    t = _t(spark, d, "eval_items").select(F.col("topic").alias("title_seed"), F.when(F.length("topic") > 12, "A").otherwise("B").alias("priority")).distinct()
    return rules.seeds(t, "A").select("title_seed", "priority")


def preview(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of the first chunk of the first three pages."""
    df = _t(spark, d, "article_zh").where(F.col("text").isNotNull() & F.col("source_title").isNotNull())
    return dedup.preview(df, "source_title", "row_id").select("source_title", "row_id", "start")


def url_group_ids(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").where(F.col("source_url").isNotNull())
    return df.select("row_id", text.url_group_id(F.col("source_url")).alias("url_group"), text.host(F.col("source_url")).alias("host"))


def title_group_ids(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_zh").where(F.col("source").isNotNull() & F.col("source_title").isNotNull())
    return df.select("row_id", text.title_group_id(F.col("source"), F.col("source_title")).alias("title_group"), text.title_address(F.col("source_title")).alias("page_name"))


def tokenizer_form(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "natural_zh").select("row_id", "text", uni.tokenizer_form(F.col("text")).alias("normal"))
    return df.where(F.col("text") != F.col("normal")).select("row_id", "normal")


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pages of four kinds are made of the articles' titles and texts, with parts around them that have to go."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title, topic, body = esc(F.col("source_title")), esc(F.col("topic")), esc(F.col("text"))
    made = (
        ("<html><head><title> ", title, " </title><style>p{}</style></head><body><nav>Home</nav><article><h1>", topic, "</h1><script>var x = 1;</script><p>", body, "</p><aside>More</aside></article><footer>End</footer></body></html>"),
        ("<!DOCTYPE html><TITLE>", title, "</TITLE><body>Top<main id=m><header>Menu</header><h2>", topic, "</h2><div><p>", body, "<br></div><form>Sign up</form></main> Bottom</body>"),
        ("<title>", title, "</title><body><noscript>No script</noscript><p>", topic, "<p><!-- note -->", body, "<img src=x></body>"),
        ("<title>", title, "</title><article>", topic, " <b>", body, "</b></article><main>Other</main><article>Second</article>"),
    )
    one = [F.concat(*[F.lit(x) if isinstance(x, str) else x for x in m]) for m in made]
    page = F.element_at(F.array(*one), (F.col("row_id") % len(one) + 1).cast("int"))
    df = _t(spark, d, "article_en").where(F.col("text").isNotNull()).select("row_id", html.extract(page).alias("p"))
    return df.select("row_id", F.col("p.title").alias("title"), F.col("p.text").alias("text"))


# --- rules ----------------------------------------------------------------------------------------------------------

_NEEDLE, _TO = "Under steady load", ["In calm weather", "At constant load", "With steady input"]


def cyclic_replace(spark: SparkSession, d: str) -> DataFrame:
    df = rules.cyclic_replace(_t(spark, d, "english").select("row_id", "text"), _NEEDLE, _TO, "row_id")
    return df.where(F.col("place").isNotNull()).select("row_id", "place", "text")


def _rule_table(spark: SparkSession, d: str) -> DataFrame:
    """Rules made from the data: a furniture line goes where it stands once, a phrase is replaced, house notices go."""
    e = _t(spark, d, "article_en").select(F.col("row_id").cast("string").alias("id"), "text")
    lit = lambda **k: [F.lit(v).alias(n) for n, v in k.items()]
    a = e.where(F.contains("text", F.lit("Back to top"))).select("id", *lit(rule="BACK_TO_TOP", action="remove", needle="Back to top", replacement=None, reason="control", place=1))
    b = e.where(F.contains("text", F.lit("In simple terms"))).select("id", *lit(rule="SIMPLE_TERMS", action="replace", needle="In simple terms", replacement="Put simply", reason="wording", place=2))
    c = e.where(F.contains("text", F.lit("Toggle navigation"))).select("id", *lit(rule="NAVIGATION", action="drop", needle=None, replacement=None, reason="navigation", place=3))
    cast = lambda df: df.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in rules.RULES.split(", ")])
    return cast(a).unionByName(cast(b)).unionByName(cast(c))


def _applied(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").select(F.col("row_id").cast("string").alias("id"), "text")
    return rules.apply_rules(df, _rule_table(spark, d))


def fragment_removal_log(spark: SparkSession, d: str) -> DataFrame:
    return rules.decisions(_applied(spark, d))


def records_after_rules(spark: SparkSession, d: str) -> DataFrame:
    return rules.kept(_applied(spark, d)).select("id", text.sha256(F.col("text")).alias("text_sha256"))


def ordered_pair_replace(spark: SparkSession, d: str) -> DataFrame:
    pairs = [("the trend holds", "the trend stays"), ("trend stays for", "trend is the same for")]
    df = _t(spark, d, "english").select("row_id", text.replace_pairs(F.col("text"), pairs).alias("text"))
    return df.where(F.col("text").isNotNull())


def quarantine_restore(spark: SparkSession, d: str) -> DataFrame:
    """The quarantine queue without the records that were repaired: those of the first half of the chunks of a page."""
    df = _t(spark, d, "article_en").select(F.col("row_id").cast("string").alias("id"), "chunk_index", "text")
    _, queue = rules.quarantine(df, rules.risk_flags(F.col("text")))
    return rules.restore(queue, df.where(F.col("chunk_index") <= 1).select("id")).select(F.col("record.id").alias("id"), F.array_join("flags", ",").alias("flags"))


def whole_text_restore(spark: SparkSession, d: str) -> DataFrame:
    """Texts in capitals get back the text of the topic's first item, by rules that name the record."""
    e = _t(spark, d, "english").where((F.upper("text") == F.col("text")) & F.col("domain").isNotNull()).select(F.col("row_id").cast("string").alias("id"), "domain")
    first = _t(spark, d, "eval_items").where("text IS NOT NULL").groupBy("domain").agg(F.min_by("text", "item_id").alias("replacement"))
    r = e.join(first, "domain").select("id", F.lit("WHOLE_TEXT").alias("rule"), F.lit("restore").alias("action"), F.lit(None).cast("string").alias("needle"), "replacement", F.lit("capitals").alias("reason"), F.lit(1).alias("place"))
    df = _t(spark, d, "english").select(F.col("row_id").cast("string").alias("id"), "text")
    done = rules.apply_rules(df, r)
    return done.where(F.size("rules") > 0).select("id", text.sha256(F.col("text")).alias("text_sha256"), text.sha256(F.col("text_before")).alias("before_sha256"))


def topic_translate(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_zh").select("row_id", "topic", "topic_zh")
    m = df.where(F.col("topic_zh").isNotNull() & text.is_snake_case(F.col("topic"))).select("topic_zh", F.col("topic").alias("topic_en")).distinct()
    han = df.where(text.has_han(F.col("topic")))
    return rules.translate_topics(han, m).select("row_id", "topic", "topic_zh")


def topic_map_gaps(spark: SparkSession, d: str) -> DataFrame:
    a, n = _t(spark, d, "article_zh"), _t(spark, d, "natural_zh")
    m = a.where(F.col("topic_zh").isNotNull()).select("topic_zh").distinct()
    return gates.missing_in_map(n.select(F.col("topic_zh").alias("t")), "t", m, "topic_zh")


def origin_annotation(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "natural_zh").select("row_id", F.coalesce("legacy_id", F.lit("")).alias("legacy_id"))
    return rules.annotate(df, F.col("legacy_id") == "", origin_class="AI-generated").select("row_id", "origin_class", "before_sha256", "after_sha256")


def merged_origin(spark: SparkSession, d: str) -> DataFrame:
    df = rules.keep_origin(_t(spark, d, "english").select("row_id", "split"))
    return df.groupBy("split", "round15_split").agg(F.count("*").alias("n_rows"))


# --- gates ----------------------------------------------------------------------------------------------------------


def unique_id_violations(spark: SparkSession, d: str) -> DataFrame:
    return gates.repeated_ids(_t(spark, d, "english"))


def unique_text_violations(spark: SparkSession, d: str) -> DataFrame:
    return gates.repeated_texts(_t(spark, d, "documents"), text.dedup_key(F.col("text")))


def groups_in_several_splits(spark: SparkSession, d: str) -> DataFrame:
    return gates.groups_in_several_splits(_t(spark, d, "article_en").withColumn("split", _split()))


def texts_in_several_splits(spark: SparkSession, d: str) -> DataFrame:
    return gates.texts_in_several_splits(_t(spark, d, "english").withColumn("split", _split()), text.dedup_key(F.col("text")))


def wrong_split_labels(spark: SparkSession, d: str) -> DataFrame:
    """The directory is the split by lower case; labels in other spellings are wrong."""
    df = _t(spark, d, "english").select("row_id", "split", _split().alias("directory"))
    return gates.wrong_split_labels(df, F.col("directory"))


def overlap_train_eval(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").withColumn("s", _split())
    return gates.marker_overlap(df.where(F.col("s") == "train"), df.where(F.col("s").isin("valid", "test"))).groupBy("kind").agg(
        F.count("*").alias("n_markers"), F.sum("n_train").alias("n_train"), F.sum("n_valid").alias("n_valid"))


def merge_overlap(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "english").withColumn("s", _split())
    return gates.merge_overlap(df.where(F.col("s") == "train"), df.where(F.col("s").isin("valid", "test")))


def count_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source against the numbers of distinct texts."""
    df = _t(spark, d, "documents")
    want = df.where(F.col("source").isNotNull()).groupBy(F.col("source").alias("name")).agg(F.countDistinct("text").alias("n_expected"))
    return gates.wrong_counts(df.where(F.col("source").isNotNull()), "source", want)


# --- splits and samples ---------------------------------------------------------------------------------------------


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, their roots, groups) of four tables; category is the table, explicit groups count within it."""
    parts = []
    for k, (t, lang) in enumerate((("article_en", "en"), ("article_zh", "zh"), ("english", "en"), ("natural_zh", "zh"))):
        df = _t(spark, d, t)
        group = F.col("group_id") if "group_id" in df.columns else F.lit(None).cast("string")
        parts.append(df.select((F.col("row_id") * 4 + k).alias("row_id"), F.concat(F.lit(f"{t}-"), F.col("row_id").cast("string")).alias("id"), group.alias("group_id"), F.lit(t).alias("category"), F.lit(lang).alias("language"), F.col("split"), "text"))
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x)
    roots = written(dedup.near_duplicates(df, uni.key_made(F.col("text")), written, seed_keys=("category", "group_id")))
    members = df.join(roots, df["row_id"] == roots["node"]).select("root", "id")
    return df, roots, written(split.group_name(split.group_rows(df, roots), members))


def group_split_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of all four tables with the split and the group that were assigned written back."""
    df, roots, g = _groups(spark, d)
    new = split.write_back(df, g.join(split.assign_groups(g, SEED), "root"), roots)
    return new.select("id", "split", "group_id")


def group_split_assign(spark: SparkSession, d: str) -> DataFrame:
    _, _, g = _groups(spark, d)
    return g.join(split.assign_groups(g, SEED), "root").select("group_id", "split", F.col("n_ids").alias("n_rows"), "first_id")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").select("doc_id", F.substring(F.lower("lang"), 1, 2).alias("lang"))
    return split.stratified_sample(df, "lang", "doc_id", ["zh", "en"], 25, SEED).select("lang", "draw", "doc_id")


def review_sheets(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "eval_items").withColumn("id", F.col("item_id").cast("string"))
    return review.review_sheet(df, ["language", "topic", "domain"])


def review_results(spark: SparkSession, d: str) -> DataFrame:
    """Filled by a fixed rule: items of physics are to be modified, the rest pass."""
    s = review_sheets(spark, d).join(_t(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("id"), "domain"), "id")
    pick = F.when(F.col("domain") == "physics", "modify").otherwise("pass")
    return review.review_results(s.select(F.replace("block", F.concat(F.lit("[ ] "), pick), F.concat(F.lit("[x] "), pick)).alias("block")))


def first_prompts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_rows(_t(spark, d, "eval_items").select("language", "item_id", "question"), "language", "item_id", 3).select("language", "item_id", "question", "place")


def random_windows(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d)
    n = s.agg(F.sum(F.size("tokens"))).first()[0]
    w = packing.windows(s, split.window_starts(spark, n, 128, 42, 1), 128)
    return w.select("sample", F.sha2(F.array_join("tokens", ","), 256).alias("tokens_sha256"), F.size("tokens").alias("n_tokens"))


# --- packing --------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return packing.stream(df, _codes(F.col("text")), 0, "doc_id")


def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "english").where(F.col("text").isNotNull()).select("row_id", "text")
    b = packing.blocks(packing.stream(df, _codes(F.col("text")), 0, "row_id"), 128)
    return b.select("block", F.array_join("tokens", ",").alias("tokens"))


def lenient_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The questions of each language as a stream of its own; one too short for a block gives none, as the Chinese one may."""
    q = _t(spark, d, "eval_items").where(F.col("question").isNotNull())
    out = None
    for lang, size in (("en", 1000), ("zh", 10_000_000)):
        df = q.where(F.substring(F.lower("language"), 1, 2) == lang).select("item_id", "question")
        b = packing.blocks(packing.stream(df, _codes(F.col("question")), 0, "item_id"), size, strict=False).select(F.lit(lang).alias("lang"), "block", F.sha2(F.array_join("tokens", ","), 256).alias("tokens_sha256"))
        out = b if out is None else out.unionByName(b)
    return out


def eval_blocks(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "eval_items").where(F.col("text").isNotNull()).select("item_id", "text")
    b = packing.eval_blocks(df, _codes(F.col("text")), 128)
    return b.select("item_id", "block_no", F.size("block").alias("n_tokens"), F.element_at("block", 1).alias("first_token"))


def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "eval_items").select("item_id", packing.truncate_prompt(_codes(F.col("question")), 64).alias("p"))
    return df.select("item_id", F.size("p").alias("prompt_size"), packing.new_token_budget(F.size("p"), 64, 20).alias("new_tokens"))


def bpe_pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.pretoken_counts(_t(spark, d, "english"))


def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    """The merges of a tokenizer trained on the documents."""
    m = tokens.train(tokens.pretoken_counts(_t(spark, d, "documents")))
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(m)], "rank_no int, first_piece string, second_piece string")


def bpe_encode(spark: SparkSession, d: str) -> DataFrame:
    m = [(r[0], r[1]) for r in _t(spark, d, "bpe_merges").orderBy("rank_no").select("first_piece", "second_piece").collect()]
    df = _t(spark, d, "english").where(F.col("text").isNotNull()).select("row_id", "text", tokens.encode(F.col("text"), m, template=True).alias("ids"))
    return df.select("row_id", F.size("ids").alias("n_ids"), (tokens.decode(F.col("ids"), m) == F.col("text")).alias("round_trip"))


# --- sources, rights, questions -------------------------------------------------------------------------------------


def qa_build(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one language in four have a value missing or empty, in turn; the first ten questions exist already."""
    miss = lambda c, k: F.when(F.col("item_id") % 4 == k, None).otherwise(F.col(c))
    df = _t(spark, d, "eval_items").select("item_id", "question", "answer", F.when(F.col("item_id") % 9 == 0, "").otherwise(miss("language", 0)).alias("language"), miss("domain", 1).alias("domain"), miss("topic", 2).alias("topic"), miss("split", 3).alias("split"), F.when(F.col("item_id") % 11 == 0, F.concat(F.lit(" "), "question")).alias("text"))
    old = df.where("item_id <= 10 AND text IS NULL").select(text.qa_text(text.trim_all(F.col("question")), text.trim_all(F.col("answer")), F.coalesce("language", F.lit("zh"))).alias("text"))
    return qa.build_qa(df, old, order="item_id")


def id_continuation(spark: SparkSession, d: str) -> DataFrame:
    new = _t(spark, d, "eval_items").select("item_id", "text")
    return qa.continue_ids(new, _t(spark, d, "english").select("id"), "natural-en", "item_id").select("item_id", "id")


def article_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The texts of each catalog source's first page become its chunks."""
    c = _t(spark, d, "source_catalog")
    chunks = _t(spark, d, "eval_items").groupBy("topic").agg(F.array_sort(F.collect_list("text")).alias("chunks"))
    return qa.assemble(c.join(chunks, "topic")).select("id", "source", "source_url", "source_title", "chunk_index", F.sha2("text", 256).alias("text_sha256"))


def _policies(spark: SparkSession, d: str) -> DataFrame:
    """A policy page for the hosts of the catalog."""
    c = _t(spark, d, "source_catalog")
    return c.select(text.host(F.col("url")).alias("host"), F.concat(F.col("url"), F.lit("policy")).alias("policy"), F.col("source").alias("agency")).where(F.col("host").isNotNull())


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "article_en").select("row_id", F.col("row_id").cast("string").alias("rid"), "source_url", "source_title", "text")
    return rights.source_inventory(df, _policies(spark, d), order="row_id", id_col="rid", title_host="wiki.example", title_page="https://wiki.example/wiki/")


def source_inventory(spark: SparkSession, d: str) -> DataFrame:
    return _inventory(spark, d).select("source_kind", "source_key", "record_count", F.array_join("record_ids", ",").alias("record_ids"), F.array_join("signal_ids", ",").alias("signal_ids"), "source_title", "host", "policy", "candidate_url", "rights_status")


def attribution_by_host(spark: SparkSession, d: str) -> DataFrame:
    active = _t(spark, d, "article_en").where(_split() == "train").select(F.col("row_id").cast("string").alias("id"))
    return rights.by_host(rights.only_active(_inventory(spark, d), active))


def attribution_report(spark: SparkSession, d: str) -> DataFrame:
    lines = rights.attribution_lines(_inventory(spark, d), _policies(spark, d), opening=["# Attribution", "", "A draft."], closing=["## Before publication", "", "1. Check the pages."])
    return lines.select("host", "part", "line")


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return rights.audit_summary(_inventory(spark, d))


def title_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Seeds are the topics of the items; every third topic redirects, every fifth page is missing."""
    k = F.dense_rank
    from pyspark.sql import Window

    t = _t(spark, d, "eval_items").select(F.col("topic").alias("title_seed")).distinct().where(F.col("title_seed").isNotNull())
    n = t.withColumn("k", k().over(Window.orderBy("title_seed")))  # a few hundred topics
    redirects = n.where("k % 3 = 0").select(F.col("title_seed").alias("source"), F.concat("title_seed", F.lit("_page")).alias("target"))
    pages = n.select("title_seed", (F.col("k") % 5 == 0).alias("missing")).unionByName(redirects.select(F.col("target").alias("title_seed"), F.lit(False).alias("missing"))).withColumnRenamed("title_seed", "title")
    hits = n.select("title_seed", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.concat("title_seed", F.lit("列表")).alias("title")), F.struct(F.lit(2).alias("place"), F.concat("title_seed", F.lit("_hit")).alias("title")))).alias("h")).select("title_seed", "h.*")
    return resolve_titles(t, redirects, pages, hits)


def revision_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the articles; blanks are normalised, every third of the longer names converted, every second redirects, every fifth page is missing."""
    t = _t(spark, d, "article_en").select(F.col("source_title").alias("title")).where(F.col("source_title").isNotNull()).distinct()
    step = lambda c, when, to: t.select(c.alias("source")).distinct().where(when).withColumn("target", to)
    n = F.replace("title", F.lit(" "), F.lit("_"))
    c = F.when(F.length(n) % 3 == 0, F.concat(n, F.lit("~"))).otherwise(n)
    last = F.when(F.length(c) % 2 == 0, F.concat(c, F.lit("*"))).otherwise(c)
    s = F.col("source")
    normalized = step(F.col("title"), F.contains(s, F.lit(" ")), F.replace(s, F.lit(" "), F.lit("_")))
    converted = step(n, F.length(s) % 3 == 0, F.concat(s, F.lit("~")))
    redirects = step(c, F.length(s) % 2 == 0, F.concat(s, F.lit("*")))
    pages = t.select(last.alias("title")).distinct().select("title", F.length("title").alias("page_id"), (F.length("title") + 1000).alias("revision_id"), (F.length("title") % 5 == 0).alias("missing"))
    return look_up_revisions(t, normalized, converted, redirects, pages)


# --- files ----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/lexmill-files-{uuid.uuid4().hex}"


def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON lines in two goes and read back; a text that is missing or blank isn't read."""
    path, df = _folder(spark), _t(spark, d, "english").drop("ingested_at")
    files.write_jsonl(df.where("row_id % 2 = 0"), path)
    files.write_jsonl(df.where("row_id % 2 = 1"), path, mode="append")
    back = files.read_jsonl(spark, path, strict=False)
    return back.select(F.col("extra")["row_id"].cast("long").alias("row_id"), "id", "split", "language", "domain", "topic", text.sha256(F.col("text")).alias("text_sha256"), "source")


def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line number of each record of one file in a given order."""
    path = _folder(spark)
    _t(spark, d, "natural_zh").where("text IS NOT NULL AND trim(text) <> ''").select("row_id", "text").coalesce(1).sortWithinPartitions("row_id").write.json(path)  # one file is the case
    return files.read_jsonl(spark, path, numbered=True).select(F.col("extra")["row_id"].cast("long").alias("row_id"), "line_no")


def txt_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a text file as documents, with their numbers; blank ones count but aren't read."""
    path = _folder(spark)
    line = F.when(F.col("item_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.regexp_replace("question", "[\r\n]", " ")))
    _t(spark, d, "eval_items").where("question IS NOT NULL").select("item_id", line.alias("value")).coalesce(1).sortWithinPartitions("item_id").select("value").write.text(path)  # 400 rows at any scale
    return files.read_txt(spark, path, numbered=True).select("line_no", "text")


def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """One folder per split and category, found by their names and read together."""
    path, df = _folder(spark), _t(spark, d, "article_zh").where("text IS NOT NULL AND trim(text) <> '' AND split IS NOT NULL").select("row_id", _split().alias("split"), F.coalesce("topic", F.lit("none")).alias("category"), "text")
    files.write_split_files(df, path)
    back = files.read_jsonl(spark, f"{path}/*/*/*.json")
    return back.groupBy("split", F.col("extra")["category"].alias("category")).agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


def catalog_read(spark: SparkSession, d: str) -> DataFrame:
    """The catalog as one JSON array."""
    path = _folder(spark)
    c = _t(spark, d, "source_catalog").select("id", "title", "url", "source", "domain", "topic")
    c.agg(F.to_json(F.collect_list(F.struct(*c.columns))).alias("value")).write.text(path)  # 60 rows at any scale
    return files.read_catalog(spark, path)


def replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written, then replaced as a whole by its changed rows."""
    path = f"{_folder(spark)}/table"
    df = _t(spark, d, "eval_items").select("item_id", "answer")
    df.write.json(path)
    files.replace_atomically(spark.read.schema("item_id long, answer string").json(path).where("item_id % 3 <> 0"), path, path, in_place=True)
    return spark.read.schema("item_id long, answer string").json(path)


def label_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Labels in two text files, zipped by position with an array of topics."""
    path = _folder(spark)
    t = _t(spark, d, "eval_items").select("topic").distinct().where(F.col("topic").rlike("^[a-z][a-z0-9_]*$"))
    for k, part in enumerate(("topic < 'm'", "topic >= 'm'")):
        t.where(part).coalesce(1).sortWithinPartitions("topic").write.text(f"{path}/{k}")  # a few hundred topics
    names = [r["topic"] for r in t.orderBy("topic").collect()]
    labels = files.read_labels(spark, [f"{path}/0", f"{path}/1"], len(names))
    return files.zip_labels(labels, [n.upper() for n in names]).select("position", "value", "label")


NOT_QUERIES = {"combined_fingerprint", "shared_root", "spread", "written", "look_up_revisions", "resolve_titles", "queries", "oracle_sql"}


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__ and k not in NOT_QUERIES}


def oracle_sql() -> dict[str, str]:
    from lexmill.plans.oracle import SQL

    return SQL
