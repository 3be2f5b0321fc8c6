"""Problem 1: splits that keep related records together.

Pages are connected components of rows over three kinds of keys. The component table is persisted and grows batch by
batch: keys already known give the rows of a new batch their component, merges of components go into an alias table
that is followed by pointer jumping, components that have a split keep it, new ones fill the deficits against the
wanted proportions, and a merge of components with different splits is quarantined.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import norm_split, shared_dir, table, written
from lexmill.operators.graph import connected_components

PROPORTIONS = {"train": 0.8, "valid": 0.1, "test": 0.1}
#: Components are dealt by hash in so many slots; a component above 1/BIG of a batch is placed by itself.
SLOTS, BIG = 4096, 1000
KEYS = ["k1", "k2", "k3"]


def page_address(url: Column) -> Column:
    """A URL without scheme, `www.`, final slash, query and fragment, its host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"(?s)[?#].*$", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1), r"/$", "")
    return F.concat(host, path)


def page_keys(df: DataFrame) -> DataFrame:
    """df with the keys k1 to k3 (group, address, source with title); null where a part is null."""
    return df.withColumns({
        "k1": F.concat(F.lit("g"), F.col("group_id")),
        "k2": F.concat(F.lit("u"), page_address(F.col("source_url"))),
        "k3": F.concat(F.lit("s"), F.col("source"), F.lit("\u0001"), F.col("source_title")),
    })


def _bit(split: Column) -> Column:
    return F.when(split == "train", 1).when(split == "valid", 2).when(split == "test", 4).otherwise(0)


def _same_keys(a: DataFrame, b: DataFrame) -> Column:
    return a.k1.eqNullSafe(b.k1) & a.k2.eqNullSafe(b.k2) & a.k3.eqNullSafe(b.k3)


def combinations(rows: DataFrame) -> DataFrame:
    """One row per combination of keys: rep (smallest row), n rows, mask of the splits seen. Rows without any key stay alone."""
    keyed = F.coalesce(*KEYS).isNotNull()
    own = F.when(keyed, F.lit(0)).otherwise(F.col("row_id"))  # rows without a key must not meet
    return rows.where(F.col("row_id").isNotNull()).groupBy(*KEYS, own.alias("own")).agg(F.min("row_id").alias("rep"), F.count("*").alias("n"), F.bit_or("bit").alias("mask"))


def _exploded(combos: DataFrame) -> DataFrame:
    return combos.select("rep", F.explode(F.array_compact(F.array(*KEYS))).alias("key"))


KEY, ALIAS, SPLIT = "key string, comp long", "old long, root long", "comp long, split string, n long, state string, v int"
#: After so many batches the aliases and splits are written whole once; between, a batch adds its own rows only.
COMPACT = 16


class ComponentStore:
    """The persisted component table: keys (key, comp), aliases (old, root) and splits (comp, split, n, state, v).

    Each batch writes a folder of its own and counts from the moment its commit file is there; a store opened on the same
    path goes on from the last commit, and what a batch left behind that broke off is written over. Known keys are
    looked up by one join and never written again; a batch adds the keys, aliases and splits that are new or changed.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, proportions: dict[str, float] = PROPORTIONS):
        if not proportions or any(p < 0 for p in proportions.values()) or abs(sum(proportions.values()) - 1) > 1e-9:
            raise ValueError("proportions must be non-negative and add up to 1")
        self.spark, self.path, self.proportions = spark, path or shared_dir(spark), proportions
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folder = self._at(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.version = max((int(n) for n in names if n.isdigit()), default=0)
        #: base: the version from which on aliases and splits count; totals: rows per split, and of quarantined components
        self.base, self.totals = 1, {}
        if self.version:
            said = json.loads(spark.sparkContext.wholeTextFiles(f"{self.path}/commits/{self.version}").first()[1])
            self.base, self.totals = said["base"], said["totals"]

    def _commit(self, version: int, base: int, totals: dict[str, int]) -> None:
        """The commit file appears whole or not at all, by a rename."""
        half, whole = self._at(f"{self.path}/commits/.{version}"), self._at(f"{self.path}/commits/{version}")
        out = self._fs.create(half, True)
        out.write(bytearray(json.dumps({"base": base, "totals": totals}).encode()))
        out.close()
        if not self._fs.rename(half, whole):
            raise OSError(f"can't commit version {version} of {self.path}")
        self.version, self.base, self.totals = version, base, totals

    def _read(self, name: str, schema: str, first: int = 1) -> DataFrame:
        parts = [f"{self.path}/v={v}/{name}" for v in range(first, self.version + 1)]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}/{name}")

    def keys(self) -> DataFrame:
        return self._read("keys", KEY)

    def alias(self) -> DataFrame:
        """(old, root): every merged component with what it is part of now; flat."""
        raw = self._read("alias", ALIAS, self.base)
        return self._resolved(raw, raw, "root")

    def splits(self) -> DataFrame:
        """(comp, split, n, state) of the components that stand by themselves."""
        return self._latest(self._read("splits", SPLIT, self.base)).where("state <> 'merged'")

    @staticmethod
    def _latest(raw: DataFrame) -> DataFrame:
        s = raw.groupBy("comp").agg(F.max_by(F.struct("split", "n", "state"), "v").alias("s"))
        return s.select("comp", "s.split", "s.n", "s.state")

    def _resolved(self, df: DataFrame, raw: DataFrame, c: str) -> DataFrame:
        """df with column c led along the aliases to its end: pointer jumping, the steps double with each round."""
        step = raw.toDF("_from", "_to")
        while True:
            moved = written(df.join(step, df[c] == step["_from"], "left").withColumn("_hit", F.col("_from").isNotNull()).withColumn(c, F.coalesce("_to", c)).drop("_from", "_to"))
            df = moved.drop("_hit")
            if not moved.where("_hit").head(1):
                return df
            far = step.toDF("_mid", "_far")
            step = written(step.join(far, step["_to"] == far["_mid"], "left").select("_from", F.coalesce("_far", "_to").alias("_to")))

    def update(self, records: DataFrame) -> DataFrame:
        """Takes a batch in; (row_id, page, split, state, mixed) of its rows.

        state: kept, new or quarantined (split is then null); mixed: whether the rows of the page in this batch have more
        than one split now. row_id must be unique over all batches. Rows with a null row_id are left out, null keys link
        nothing, null or unknown splits count as none; repeated rows are rows of one page, an empty batch gives no rows.
        """
        rows = page_keys(records).select("row_id", *KEYS, _bit(norm_split(F.col("split"))).alias("bit") if "split" in records.columns else F.lit(0).alias("bit")).where(F.col("row_id").isNotNull())
        combos = written(combinations(rows))
        links = _exploded(combos)
        hubs = written(links.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("m")))
        first = self.version == 0
        if first:
            hubs = hubs.select("key", F.col("first").alias("hub"), F.lit(False).alias("old"), "m")
        else:  # of the keys known before only those of the batch go on
            seen = hubs.select("key", "first", "m").join(self.keys(), "key", "left").withColumn("old", F.col("comp").isNotNull())
            hubs = self._resolved(seen, self._read("alias", ALIAS, self.base), "comp").select("key", F.coalesce("comp", "first").alias("hub"), "old", "m")
        # a key of one combination links it to nothing but what it was linked to before
        edges = links.join(hubs.where(F.col("old") | (F.col("m") > 1)), "key").select(F.col("rep").alias("src"), F.col("hub").alias("dst"))
        roots = written(connected_components(edges, written))
        root_of = lambda df, c: df.join(roots, F.col(c) == roots.node, "left").withColumn("page", F.coalesce("root", c)).drop("node", "root")
        # components of the table that this batch touches, under their root now
        touched = hubs.where("old").select(F.col("hub").alias("comp")).distinct()
        had = self._latest(self._read("splits", SPLIT, self.base).join(touched, "comp", "left_semi"))
        moved = written(root_of(had, "comp"))
        merged = moved.groupBy("page").agg(
            F.min("split").alias("lo"), F.max("split").alias("hi"), F.sum("n").alias("n_had"), F.max((F.col("state") == "quarantined").cast("int")).alias("q"),
        )
        fresh = root_of(combos.select("rep", "n", "mask"), "rep").groupBy("page").agg(F.sum("n").alias("n_new"), F.bit_or("mask").alias("mask"))
        pages = written(fresh.join(merged, "page", "left").select(
            "page", (F.coalesce("n_had", F.lit(0)) + F.col("n_new")).alias("n"), "lo", (F.bit_count("mask") > 1).alias("mixed"),
            F.when((F.col("q") == 1) | (F.col("lo") != F.col("hi")), "quarantined").when(F.col("lo").isNotNull(), "kept").otherwise("new").alias("state"),
        ))
        count = lambda df, k: {r[0] or "quarantined": r[1] for r in df.groupBy(k).agg(F.sum("n")).collect()}  # noqa: E731  # one row per split
        before = {} if first else count(moved, "split")
        totals = {s: n - before.get(s, 0) for s, n in self.totals.items()}
        pages = written(self._deal(pages, totals))
        for s, n in count(pages, "split").items():
            totals[s] = totals.get(s, 0) + n

        version = self.version + 1
        self._write(root_of(hubs.where(~F.col("old")), "hub").select("key", F.col("page").alias("comp")), "keys", version)
        news = moved.where(F.col("comp") != F.col("page")).select(F.col("comp").alias("old"), F.col("page").alias("root"))
        state = pages.select(F.col("page").alias("comp"), "split", "n", "state").unionByName(news.select(F.col("old").alias("comp"), F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("n"), F.lit("merged").alias("state")))
        state, base = state.withColumn("v", F.lit(version)), self.base
        if version - base >= COMPACT:
            raw = self._read("alias", ALIAS, base).unionByName(news)
            news = self._resolved(raw, raw, "root")
            state = self._latest(self._read("splits", SPLIT, base).unionByName(state)).where("state <> 'merged'").withColumn("v", F.lit(version))
            base = version
        self._write(news, "alias", version)
        self._write(state, "splits", version)
        self._commit(version, base, totals)
        of = root_of(combos.select(*KEYS, "own", "rep"), "rep").join(pages.select("page", "split", "state", "mixed"), "page")
        r = rows.withColumn("own", F.when(F.coalesce(*KEYS).isNotNull(), F.lit(0)).otherwise(F.col("row_id")))
        return r.join(of, _same_keys(r, of) & (r.own == of.own)).select(r.row_id, "page", "split", "state", "mixed")

    def _deal(self, pages: DataFrame, others: dict[str, int]) -> DataFrame:
        """Gives the new pages splits that fill the deficits; slots by hash, so what reaches the driver is bounded by SLOTS and BIG.

        others: rows per split of the components that the batch doesn't touch.
        """
        said = {(r["state"], r["lo"]): r["n"] for r in pages.groupBy("state", F.when(F.col("state") == "kept", F.col("lo")).alias("lo")).agg(F.sum("n").alias("n")).collect()}
        have = {s: others.get(s, 0) + said.get(("kept", s), 0) for s in self.proportions}
        n_new = said.get(("new", None), 0)
        new, total = pages.where("state = 'new'"), sum(have.values()) + n_new
        lack = {s: max(0.0, p * total - have[s]) for s, p in self.proportions.items()}
        limit = max(1, total // BIG)
        place: dict[int, str] = {}
        for r in new.where(F.col("n") > limit).orderBy(F.desc("n"), "page").select("page", "n").collect():  # at most BIG pages
            s = max(self.proportions, key=lambda x: (lack[x], self.proportions[x]))
            place[r["page"]] = s
            lack[s] -= r["n"]
        slot = F.pmod(F.xxhash64(F.lit("slot"), "page"), F.lit(SLOTS)).cast("int")
        cut: dict[int, str] = {}
        for r in new.where(F.col("n") <= limit).groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).orderBy("slot").collect():
            s = max(self.proportions, key=lambda x: (lack[x] / max(self.proportions[x], 1e-9), self.proportions[x]))
            cut[r["slot"]] = s
            lack[s] -= r["n"]
        spark = pages.sparkSession
        slots = spark.createDataFrame([*cut.items()], "slot int, by_slot string")  # at most SLOTS rows
        big = spark.createDataFrame([*place.items()], "page long, by_page string")  # at most BIG rows
        df = pages.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left").join(F.broadcast(big), "page", "left")
        split = F.when(F.col("state") == "kept", F.col("lo")).when(F.col("state") == "new", F.coalesce("by_page", "by_slot"))
        return df.select("page", "n", "state", "mixed", split.alias("split"))


def mixed_pages(records: DataFrame, store: ComponentStore | None = None) -> DataFrame:
    """row_id of every row of a page whose rows have more than one split now; the pages come from the component table."""
    return (store or ComponentStore(records.sparkSession)).update(records).where("mixed").select("row_id")


def apply_splits(records: DataFrame, dealt: DataFrame) -> DataFrame:
    """The records with their new split; the old one is kept as split_before, beside page and split_state."""
    d = dealt.select(F.col("row_id").alias("dealt_row"), F.col("split").alias("new_split"), "page", F.col("state").alias("split_state"))
    df = records.withColumnRenamed("split", "split_before") if "split_before" not in records.columns else records
    df = df.drop("page", "split_state") if "split" not in df.columns else df.drop("page", "split_state", "split")
    return df.join(d, df.row_id == d.dealt_row, "left").drop("dealt_row").withColumnRenamed("new_split", "split")


NEEDS = ["row_id", "split", "group_id", "source_url", "source", "source_title"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_pages(table(spark, sf_dir, "article_en", *NEEDS))


def p1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "article_en")
    return apply_splits(df, ComponentStore(spark).update(df.select(*NEEDS)))


def p1_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches (rows ingested within a week of their fetch, then the late ones): rows and pages per split and state."""
    df = table(spark, sf_dir, "article_en", *NEEDS, "fetched_at", "ingested_at")
    late = F.coalesce(F.col("ingested_at") > F.col("fetched_at") + F.expr("interval 7 days"), F.lit(False))
    store = ComponentStore(spark)
    one = written(store.update(df.where(~late)))
    two = written(store.update(df.where(late)))
    s, a = store.splits(), store.alias()
    rows = one.unionByName(two).select("row_id", "page").join(a, F.col("page") == a.old, "left").select("row_id", F.coalesce("root", "page").alias("page"))
    return rows.join(s, rows.page == s.comp).groupBy(s.split.alias("split"), s.state.alias("split_state")).agg(F.count("*").alias("n_rows"), F.countDistinct("page").alias("n_pages"))


#: Keys that stand in one row belong together, and with them all that can be reached so.
SQL = {
    "p1_found": r"""
WITH RECURSIVE a AS (SELECT row_id, CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END AS s, group_id, source, source_title,
    regexp_replace(regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '(?s)[?#].*$', '') AS bare FROM article_en),
k AS (SELECT row_id, s, unnest(['g' || group_id, 'u' || regexp_replace(lower(split_part(bare, '/', 1)), '^www\.', '') || regexp_replace(regexp_extract(bare, '(?s)^[^/]*(.*)$', 1), '/$', ''), 's' || source || chr(1) || source_title]) AS key FROM a),
r AS (SELECT * FROM k WHERE key IS NOT NULL), e AS (SELECT DISTINCT x.key AS a, y.key AS b FROM r x JOIN r y ON x.row_id = y.row_id AND x.key <> y.key),
reach AS (SELECT DISTINCT key AS a, key AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
page AS (SELECT a AS key, min(b) AS page FROM reach GROUP BY a), p AS (SELECT DISTINCT row_id, s, page FROM r JOIN page ON r.key = page.key),
bad AS (SELECT page FROM p WHERE s IN ('train', 'valid', 'test') GROUP BY page HAVING count(DISTINCT s) > 1)
SELECT DISTINCT row_id FROM p JOIN bad ON p.page = bad.page""",
}
