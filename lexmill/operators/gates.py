"""Checks on a corpus. Each gives the violations as a table; `require` makes an error of any."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import dedup_key, is_blank, sha256


def require(violations: DataFrame, what: str) -> None:
    """Raises if there is any violation, with the first ones in the message."""
    first = violations.limit(5).collect()
    if first:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in first))


def repeated_values(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(value, n) of every non-null value that more than one row has."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def repeated_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    return repeated_values(df, F.col(id_col), "id")


def repeated_texts(df: DataFrame, key: Column) -> DataFrame:
    """(key_sha256, n) of texts that are equal under a key."""
    return repeated_values(df, sha256(key), "key_sha256")


def groups_in_several_splits(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """(group_id, splits) of groups whose rows have more than one split; null groups and splits don't count."""
    d = df.where(F.col(group).isNotNull() & F.col(split).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(F.sort_array(F.collect_set(split)).alias("s"))  # as many as there are splits
    return d.where(F.size("s") > 1).select("group_id", F.array_join("s", ",").alias("splits"))


def wrong_split_labels(df: DataFrame, directory: Column, split: str = "split", aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Rows whose label isn't that of their directory or one of its other names; a missing label is wrong."""
    ok = F.col(split) == directory
    for d, names in (aliases or {"valid": ("validation",)}).items():
        ok = ok | ((directory == d) & F.col(split).isin(*names))
    return df.where(~F.coalesce(ok, F.lit(False)))


def texts_in_several_splits(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """(key_sha256, splits, n) of texts that stand in more than one split under a key."""
    d = df.where(F.col(split).isNotNull()).select(sha256(key).alias("key_sha256"), F.col(split).alias("s")).where(F.col("key_sha256").isNotNull())
    d = d.groupBy("key_sha256").agg(F.sort_array(F.collect_set("s")).alias("x"), F.count("*").alias("n"))
    return d.where(F.size("x") > 1).select("key_sha256", F.array_join("x", ",").alias("splits"), "n")


def separated_pairs(pairs: DataFrame, assigned: DataFrame, node: str = "node", split: str = "split") -> DataFrame:
    """pairs (a, b) whose ends were assigned to different splits."""
    s = assigned.select(F.col(node).alias("k"), F.col(split).alias("s"))
    p = pairs.join(s.toDF("a", "split_a"), "a").join(s.toDF("b", "split_b"), "b")
    return p.where(F.col("split_a") != F.col("split_b")).select("a", "b", "split_a", "split_b")


def merge_overlap(train: DataFrame, held: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(kind, marker, n_train): ids and case-folded blank-free texts of the train side that the held-out side has too."""
    def marks(df: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.lit("id").alias("kind"), F.col(id_col).alias("marker")), F.struct(F.lit("text").alias("kind"), sha256(dedup_key(F.col(text_col))).alias("marker")))
        return df.select(F.explode(both).alias("m")).select("m.kind", "m.marker").where(F.col("marker").isNotNull())

    t = marks(train).groupBy("kind", "marker").agg(F.count("*").alias("n_train"))
    return t.join(marks(held).distinct(), ["kind", "marker"], "left_semi")


def marker_overlap(train: DataFrame, valid: DataFrame) -> DataFrame:
    """(kind, marker, n_train, n_valid) of the five leakage markers that both sides have: id, group, URL, source with title, text.

    Empty values don't count; columns that a side lacks give no marker.
    """
    def col(df: DataFrame, name: str) -> Column:
        return F.when(F.col(name).cast("string") != "", F.col(name).cast("string")) if name in df.columns else F.lit(None).cast("string")

    def marks(df: DataFrame, n: str) -> DataFrame:
        kinds = {
            "id": col(df, "id"), "group_id": col(df, "group_id"), "source_url": col(df, "source_url"),
            "source_title": F.concat(col(df, "source"), F.lit(":"), col(df, "source_title")),
            "text": F.when(~is_blank(col(df, "text")), sha256(dedup_key(col(df, "text")))),
        }
        each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("marker")) for k, v in kinds.items()])
        return df.select(F.explode(each).alias("m")).select("m.kind", "m.marker").where(F.col("marker").isNotNull()).groupBy("kind", "marker").agg(F.count("*").alias(n))

    return marks(train, "n_train").join(marks(valid, "n_valid"), ["kind", "marker"])


def wrong_counts(df: DataFrame, by: str, expected: DataFrame) -> DataFrame:
    """(name, n_rows, n_expected) where the rows per value aren't what `expected` (name, n_expected) says."""
    have = df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n_rows"))
    both = have.join(expected.select("name", "n_expected"), "name", "full")
    return both.where(~F.col("n_rows").eqNullSafe(F.col("n_expected"))).select("name", "n_rows", "n_expected")


def missing_in_map(df: DataFrame, column: str, mapping: DataFrame, key: str) -> DataFrame:
    """(key, side): values without an entry, and entries that no row uses."""
    have = df.select(F.col(column).alias("key")).where(F.col("key").isNotNull()).distinct()
    keys = mapping.select(F.col(key).alias("key")).distinct()
    return have.join(keys, "key", "left_anti").withColumn("side", F.lit("not in map")).unionByName(keys.join(have, "key", "left_anti").withColumn("side", F.lit("not used")))


def check_paths(train: str, held: str | None, output: str) -> None:
    """Train, held-out and output folders must be apart; the test folder never serves as validation."""
    paths = {"train": PurePosixPath(train), "output": PurePosixPath(output)} | ({"valid": PurePosixPath(held)} if held else {})
    names = [*paths]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if paths[a] == paths[b] or paths[a] in paths[b].parents or paths[b] in paths[a].parents:
                raise ValueError(f"the {a} and {b} folders overlap: {paths[a]}, {paths[b]}")
    if held and paths["valid"].name == "test":
        raise ValueError("the test folder can't be used for validation")


def check_ranges(**values: tuple[float, float | None, float | None]) -> None:
    """Each value is (given, least, most); None is no bound."""
    for name, (x, least, most) in values.items():
        if least is not None and x < least or most is not None and x > most:
            raise ValueError(f"{name} = {x} is outside {least}..{most}")
