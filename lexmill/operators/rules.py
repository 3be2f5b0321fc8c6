"""Cleaning rounds driven by rule tables, with a decision log.

A rule table has one row per record and rule: id, rule, action (drop, remove, replace, restore), needle, replacement,
reason, place (order of several rules on one record). It is joined by id; small tables are broadcast by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import count_of, is_blank, sha256
from lexmill.operators.prefix import running

RULES = "id string, rule string, action string, needle string, replacement string, reason string, place int"


def apply_rules(df: DataFrame, rules: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """df with text_before, dropped, rules (applied, in order) and failed (rules that couldn't be applied).

    remove: the needle occurs exactly once and goes, and the text must not become blank; replace: every occurrence of a
    needle that occurs; restore: the whole text is replaced; drop: the record goes. A rule that fails leaves the text.
    """
    per = rules.groupBy(F.col("id").alias("_rid")).agg(F.array_sort(F.collect_list(F.struct("place", "rule", "action", "needle", "replacement", "reason"))).alias("_rules"))  # the rules of one record

    def step(s: Column, r: Column) -> Column:
        n = F.coalesce(count_of(s["text"], r["needle"]), F.lit(0))
        changed = F.replace(s["text"], r["needle"], F.coalesce(r["replacement"], F.lit("")))
        removed = F.replace(s["text"], r["needle"], F.lit(""))
        new = (
            F.when((r["action"] == "remove") & (n == 1) & ~is_blank(removed), removed).when((r["action"] == "replace") & (n > 0), changed)
            .when(r["action"] == "restore", r["replacement"]).when(r["action"] == "drop", s["text"])
        )
        ok = new.isNotNull()
        return F.struct(
            F.coalesce(new, s["text"]).alias("text"), (s["dropped"] | (ok & (r["action"] == "drop"))).alias("dropped"),
            F.when(ok, F.array_append(s["rules"], r["rule"])).otherwise(s["rules"]).alias("rules"), F.when(ok, s["failed"]).otherwise(F.array_append(s["failed"], r["rule"])).alias("failed"),
        )

    none = F.array().cast("array<string>")
    d = df.join(per, df[id_col] == per["_rid"], "left")
    start = F.struct(F.col(text_col).alias("text"), F.lit(False).alias("dropped"), none.alias("rules"), none.alias("failed"))
    d = d.withColumn("_s", F.when(F.col("_rules").isNull(), start).otherwise(F.aggregate("_rules", start, step)))
    keep = [c for c in df.columns if c != text_col]
    return d.select(*keep, F.col("_s.text").alias(text_col), d[text_col].alias("text_before"), F.col("_s.dropped").alias("dropped"), F.col("_s.rules").alias("rules"), F.col("_s.failed").alias("failed"))


def kept(applied: DataFrame) -> DataFrame:
    return applied.where(~F.col("dropped")).drop("text_before", "dropped", "rules", "failed")


def decisions(applied: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, rules, decision, before_sha256, after_sha256) of every record that a rule touched; a dropped one has no hash after."""
    d = applied.where((F.size("rules") > 0) | (F.size("failed") > 0))
    decision = F.when(F.col("dropped"), "drop").when(F.size("failed") > 0, "failed").otherwise("edit")
    return d.select(F.col(id_col).alias("id"), F.array_join("rules", ",").alias("rules"), decision.alias("decision"), sha256(F.col("text_before")).alias("before_sha256"), F.when(~F.col("dropped"), sha256(F.col(text_col))).alias("after_sha256"))


def cyclic_replace(df: DataFrame, needle: str, replacements: list[str], order: str = "line_no", text_col: str = "text") -> DataFrame:
    """df where the i-th text with the needle, in the given order, has all its occurrences replaced by replacement i mod n.

    place is that i, null for texts without the needle. The order is unique.
    """
    if not needle or not replacements:
        raise ValueError("a needle and replacements are needed")
    has = F.coalesce(F.contains(F.col(text_col), F.lit(needle)), F.lit(False))
    # only the order of the texts with the needle is written and sorted, not the texts
    k = running(df.where(has).select(F.col(order).alias("_o")), "_o", F.lit(1), "place")
    d = df.drop("place").join(k, df[order] == k["_o"], "left").drop("_o")
    arr = F.array(*[F.lit(r) for r in replacements])
    to = F.element_at(arr, (F.col("place") % len(replacements) + 1).cast("int"))
    return d.withColumn(text_col, F.when(F.col("place").isNotNull(), F.replace(F.col(text_col), F.lit(needle), to)).otherwise(F.col(text_col)))


def seeds(df: DataFrame, priority: str, title: str | None = None) -> DataFrame:
    """The seeds of a priority, or of them the one of a title."""
    d = df.where(F.col("priority") == priority)
    return d if title is None else d.where(F.col("title_seed") == title)


def quarantine(df: DataFrame, flags: Column) -> tuple[DataFrame, DataFrame]:
    """(records without flags, (record, flags) of the others); flags is an array of strings."""
    d = df.withColumn("_flags", flags)
    none = F.coalesce(F.size("_flags") == 0, F.lit(True))
    return d.where(none).drop("_flags"), d.where(~none).select(F.struct(*df.columns).alias("record"), F.col("_flags").alias("flags"))


def restore(queue: DataFrame, repaired: DataFrame, id_col: str = "id") -> DataFrame:
    """The quarantine queue without the records that were repaired."""
    return queue.join(repaired.select(F.col(id_col).alias("_id")).distinct(), F.col(f"record.{id_col}") == F.col("_id"), "left_anti")


def risk_flags(text: Column) -> Column:
    """Flags of a text that may have been damaged in extraction; our own predicates, the empty array for none."""
    opens, closes = count_of(text, "("), count_of(text, ")")
    return F.array_compact(F.array(
        F.when(text.rlike(r"\\[a-zA-Z]+|\{[^{}]*\}|[=+−]\s*$"), "possible_formula_extraction_damage"),
        F.when(text.rlike(r"\|.*\||</?[a-z]+>|\[\["), "possible_table_or_markup_fragment"),
        F.when(opens != closes, "unbalanced_ascii_parentheses"),
        F.when(text.rlike(r"(?i)skip to main content|related links|resources and related terms|all rights reserved"), "possible_web_navigation_mixed_with_body"),
    ))


def translate_topics(df: DataFrame, mapping: DataFrame, topic: str = "topic", old: str = "topic_zh") -> DataFrame:
    """df whose topic is the mapped one, the original kept in another column; topics without an entry stay.

    mapping is (topic_zh, topic_en); of repeated entries the smallest counts.
    """
    m = mapping.groupBy(F.col("topic_zh").alias("_t")).agg(F.min("topic_en").alias("_en"))
    d = df.join(m, df[topic] == m["_t"], "left")
    before = F.when(F.col("_en").isNotNull(), F.col(topic)).otherwise(F.col(old) if old in df.columns else F.lit(None))
    return d.withColumn(old, before).withColumn(topic, F.coalesce("_en", topic)).drop("_t", "_en")


def annotate(df: DataFrame, when: Column, **values: str) -> DataFrame:
    """df with constant columns where the condition holds, and record hashes before and after."""
    cols = [c for c in df.columns if c not in ("before_sha256", "after_sha256")]
    out = df.withColumn("before_sha256", record_hash(df, cols))
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.coalesce(when, F.lit(False)), F.lit(value)).otherwise(F.col(name) if name in df.columns else F.lit(None).cast("string")))
    return out.withColumn("after_sha256", record_hash(out, sorted({*cols, *values})))


def record_hash(df: DataFrame, columns: list[str]) -> Column:
    """Hash of a record as JSON with sorted keys, null fields left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def keep_origin(df: DataFrame, into: str = "train", old: str = "round15_split") -> DataFrame:
    """df merged into one split; the original split stays in a column."""
    return df.withColumn(old, F.col("split")).withColumn("split", F.lit(into))


def match_provenance(df: DataFrame, old: DataFrame, fields: list[str], text_col: str = "text") -> DataFrame:
    """df whose null fields are filled from the one old record of exactly the same text; texts that several have match none."""
    key = sha256(F.col(text_col))
    o = old.withColumn("_k", key).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count("*").alias("_n"), *[F.first(f).alias(f"_{f}") for f in fields]).where("_n = 1").drop("_n")
    d = df.withColumn("_dk", key).join(o, F.col("_dk") == F.col("_k"), "left").withColumn("matched", F.col("_k").isNotNull())
    for f in fields:
        d = d.withColumn(f, F.coalesce(f, f"_{f}") if f in df.columns else F.col(f"_{f}"))
    return d.drop("_k", "_dk", *[f"_{f}" for f in fields])


def fill_group_by_title(df: DataFrame, title: str = "source_title", group: str = "group_id") -> DataFrame:
    """df whose missing groups are taken from the title, if the title has exactly one group elsewhere."""
    one = df.where(F.col(title).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(title).alias("_t")).agg(F.min(group).alias("_lo"), F.max(group).alias("_hi")).where("_lo = _hi")
    d = df.join(one, df[title] == one["_t"], "left")
    return d.withColumn(group, F.coalesce(group, "_lo")).drop("_t", "_lo", "_hi")
