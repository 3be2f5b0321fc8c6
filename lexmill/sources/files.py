"""Reading and writing corpora: JSON lines, text lines, catalogs, manifests, fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import is_blank, trim_all
from lexmill.sources.schema import CATALOG, RECORD


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _lines(spark: SparkSession, paths: list[str], numbered: bool) -> DataFrame:
    """(value, src_file), with numbers also line_no, the 1-based place in the file.

    No line is moved for it: within a split of a file the rows count up, and where a split begins comes from a table
    with one row per split.
    """
    df = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    if not numbered:
        return df.select("value", "src_file")
    splits = df.groupBy(F.col("src_file").alias("f"), F.col("b").alias("at")).agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("f", "at", "first", before.alias("before"))
    d = df.join(splits, (F.col("src_file") == F.col("f")) & (F.col("b") == F.col("at")))
    return d.select("value", "src_file", (F.col("m") - F.col("first") + F.col("before") + 1).alias("line_no"))


def read_jsonl(spark: SparkSession, paths: list[str] | str, schema: T.StructType = RECORD, strict: bool = True, keep_extra: bool = True, numbered: bool = True) -> DataFrame:
    """Records of JSON-lines files with src_file, and line_no if numbered; blank lines are skipped.

    strict: a record without text is an error; otherwise records whose text is missing, not a string or blank are left
    out. Keys outside the schema are kept in the map `extra`, if wanted. Each line is parsed once.
    """
    df = _lines(spark, [paths] if isinstance(paths, str) else paths, numbered).where(~is_blank(F.col("value")))
    names = [f.name for f in schema.fields]
    if keep_extra:  # as a map, of which the fields are taken
        df = df.withColumn("r", F.from_json("value", "map<string,string>"))
        cols: list[Column] = [F.col("r")[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]
        cols.append(F.map_filter("r", lambda k, _: ~k.isin(*names)).alias("extra"))
    else:
        df = df.withColumn("r", F.from_json("value", schema))
        cols = [F.col(f"r.{n}").alias(n) for n in names]
    at = ["src_file", *(["line_no"] if numbered else [])]
    out = df.select(*cols, *at, "value") if strict else df.select(*cols, *at)
    if strict:
        place = F.col("line_no").cast("string") if numbered else F.concat(F.lit(" "), F.substring("value", 1, 80))
        where = F.concat(F.lit("no text in "), F.col("src_file"), F.lit(":"), place)
        return out.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(where)).otherwise(F.col("text"))).drop("value")
    return out.where(~is_blank(F.col("text")))


def read_txt(spark: SparkSession, paths: list[str] | str, numbered: bool = True) -> DataFrame:
    """(text, src_file), with line_no if numbered: every non-blank line is a document, without blanks at its ends."""
    lines = _lines(spark, [paths] if isinstance(paths, str) else paths, numbered)
    return lines.select(trim_all(F.col("value")).alias("text"), "src_file", *(["line_no"] if numbered else [])).where(~is_blank(F.col("text")))


def discover(spark: SparkSession, folder: str, names: tuple[str, ...], fallback: bool = True) -> list[str]:
    """The dataset files of a folder: per name its .jsonl, else its .txt; if none is there all .jsonl, then all .txt, sorted.

    No file at all is an error, as is the lack of a named one without the fallback.
    """
    fs, p, _ = _fs(spark, folder)
    there = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(p)} if fs.exists(p) else {}
    found = [there[f] for n in names if (f := next((f"{n}{e}" for e in (".jsonl", ".txt") if f"{n}{e}" in there), None))]
    if not found and fallback:
        found = [there[f] for e in (".jsonl", ".txt") for f in sorted(there) if f.endswith(e)]
    if not found:
        raise FileNotFoundError(f"no dataset file in {folder}")
    return found


def read_corpus(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of .jsonl and .txt files by name; columns that a file lacks are null."""
    parts = [read_jsonl(spark, p) if p.endswith(".jsonl") else read_txt(spark, p) for p in paths]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def read_test_set(spark: SparkSession, folder: str, names: tuple[str, ...] = ("chinese", "english")) -> DataFrame:
    """The test files that exist, with their name in `dataset`; no rows if the folder is missing."""
    fs, p, _ = _fs(spark, folder)
    out = None
    for n in names if fs.exists(p) else ():
        files = [f"{folder}/{n}{e}" for e in (".jsonl", ".txt") if fs.exists(_fs(spark, f"{folder}/{n}{e}")[1])]
        if files:
            df = read_corpus(spark, files[:1]).withColumn("dataset", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "text string, dataset string") if out is None else out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources."""
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def read_labels(spark: SparkSession, paths: list[str], expected: int | None = None) -> DataFrame:
    """(position, label) over the files in the given order; checks the number, uniqueness and form of the labels if `expected` is given."""
    parts = [read_txt(spark, p, numbered=True).withColumn("part", F.lit(k)) for k, p in enumerate(paths)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.select((F.row_number().over(Window.orderBy("part", "line_no")) - 1).alias("position"), F.col("text").alias("label"))  # label lists are small files
    if expected is not None:
        n, unique, good = out.agg(F.count("*"), F.countDistinct("label"), F.count_if(F.col("label").rlike("^[a-z][a-z0-9_]*$"))).first()
        if not n == unique == good == expected:
            raise ValueError(f"{expected} labels expected: {n} there, {unique} unique, {good} well-formed")
    return out


def zip_labels(labels: DataFrame, values: list[str]) -> DataFrame:
    """(position, value, label): the labels (position, label) beside the values of the same position; both must be unique and as many."""
    n, least, most = labels.agg(F.countDistinct("label"), F.min("position"), F.max("position")).first()
    if len({*values}) != len(values) or n != len(values) or values and (least, most) != (0, len(values) - 1):
        raise ValueError(f"{len(values)} values and {n} labels don't fit")
    v = labels.sparkSession.createDataFrame([*enumerate(values)], "position int, value string")
    return v.join(labels, "position").select("position", "value", "label")


def write_jsonl(df: DataFrame, path: str, mode: str = "error", order: list[str] | None = None) -> None:
    """JSON lines in column order; null fields are left out, characters are not escaped. mode 'append' adds files."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode(mode).json(path, ignoreNullFields=True)


def replace_atomically(df: DataFrame, path: str, source: str | None = None, in_place: bool = False) -> None:
    """Writes beside the target and renames when all is written; the target being the source needs in_place."""
    if source is not None and source.rstrip("/") == path.rstrip("/") and not in_place:
        raise ValueError("the target is the source: say in_place to replace it")
    spark = df.sparkSession
    tmp, old = f"{path.rstrip('/')}.writing", f"{path.rstrip('/')}.replaced"
    df.write.mode("overwrite").json(tmp, ignoreNullFields=True)
    fs, target, jvm = _fs(spark, path)
    to = jvm.org.apache.hadoop.fs.Path
    if fs.exists(target) and not fs.rename(target, to(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(to(tmp), target):
        fs.rename(to(old), target)
        raise OSError(f"can't move {tmp} to {path}")
    fs.delete(to(old), True)


def write_split_files(df: DataFrame, path: str, split: str = "split", category: str = "category") -> None:
    """One folder per split and category, each written by few tasks; the two columns are in the folder names and in the records."""
    df.withColumns({"_s": F.col(split), "_c": F.col(category)}).repartition("_s", "_c").write.partitionBy("_s", "_c").mode("error").json(path, ignoreNullFields=True)


def snapshot(df: DataFrame, root: str, version: str) -> str:
    """A new version folder below root; an existing one is never changed."""
    path = f"{root.rstrip('/')}/{version}"
    df.write.mode("error").parquet(path)
    return path


def file_hashes(spark: SparkSession, paths: list[str], chunk: int = 1 << 20, named: Callable[[str], str] | None = None) -> DataFrame:
    """(name, sha256) of whole files of any size: they are read as streams, a chunk at a time, a file to a task.

    name is the last part of the path, or what `named` makes of it. A file that can't be read is an error.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for name, path in zip(pdf["name"], pdf["path"]):
                h = hashlib.sha256()
                at, p = fs.FileSystem.from_uri(path)
                with at.open_input_stream(p, buffer_size=chunk) as f:
                    while part := f.read(chunk):
                        h.update(part)
                out.append((name, h.hexdigest()))
            yield pd.DataFrame(out, columns=["name", "sha256"])

    full = [p if re.match(r"[a-z][a-z0-9+.-]*:", p) else f"file://{p}" for p in paths]
    full = [f"file://{p[5:]}" if p.startswith("file:/") and not p.startswith("file://") else p for p in full]
    rows = [(named(p) if named else p.rstrip("/").split("/")[-1], p) for p in full]
    df = spark.createDataFrame(rows, "name string, path string")
    return df.repartition(max(1, min(len(rows), 10_000)), "path").mapInPandas(hashed, "name string, sha256 string")


def combined_fingerprint(hashes: DataFrame) -> DataFrame:
    """(combined_sha256): the hash of all lines 'name hash', sorted by name."""
    lines = F.array_sort(F.collect_list(F.struct("name", F.concat("name", F.lit(" "), "sha256", F.lit("\n")).alias("line"))))  # one row per file of a manifest
    return hashes.agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), ""), 256).alias("combined_sha256"))


def verify_files(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, problem): files that are missing, not listed or different."""
    a, e = actual.select("name", F.col("sha256").alias("is_sha")), expected.select("name", F.col("sha256").alias("want_sha"))
    problem = F.when(F.col("is_sha").isNull(), "missing").when(F.col("want_sha").isNull(), "not listed").when(F.col("is_sha") != F.col("want_sha"), "different")
    return a.join(e, "name", "full").select("name", problem.alias("problem")).where(F.col("problem").isNotNull())
