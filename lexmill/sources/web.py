"""Sources behind a network, with the fetching function given by the caller.

A fetcher runs inside the partitions and is tried again with growing pauses; a failure becomes a row of its own and
never ends the job.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import html

#: Titles that are lists or disambiguation pages (fixed values).
NOT_ARTICLES = ("消歧义", "消歧義", "列表")


def with_retries(fetch: Callable[[str], object], tries: int = 8, pause: Callable[[int], float] | None = None) -> Callable[[str], object]:
    """fetch, tried again after 1 + k² seconds and up to half a second more; the last error is raised."""
    wait = pause or (lambda k: 1 + k * k + random.uniform(0, 0.5))

    def run(x: str) -> object:
        for k in range(tries):
            try:
                return fetch(x)
            except Exception:  # noqa: BLE001
                if k + 1 == tries:
                    raise
                time.sleep(wait(k))
        raise RuntimeError("no try allowed")

    return run


def api_address(base: str, **params: object) -> str:
    """A request to a wiki's API: JSON of the second format, values joined by bars where there are several."""
    said = {"format": "json", "formatversion": "2"} | {k: "|".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in params.items()}
    return f"{base}?{urlencode(said)}"


def fetch_extracts(titles: DataFrame, fetch: Callable[[str], str], base: str, title_col: str = "title", workers: int | None = None) -> DataFrame:
    """titles with text and skipped: the plain-text extract of each page from a wiki's API.

    fetch takes an address and gives the answer, a JSON text; the first page's extract counts, and where there is none
    the text is empty and the reason says so. A failure becomes the row's reason.
    """
    names = [c for c in titles.columns if c not in ("text", "skipped")]
    schema = titles.select(*names).schema.add("text", "string").add("skipped", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[tuple[str | None, str | None]] = []
            for t in pdf[title_col]:
                try:
                    pages = json.loads(fetch(api_address(base, action="query", titles=t, redirects=1, prop="extracts", explaintext=1))).get("query", {}).get("pages", [])
                    text = (pages[0].get("extract") or "") if pages else ""
                    got.append((text, None if text.strip() else "empty extract"))
                except Exception as e:  # noqa: BLE001
                    got.append((None, f"fetch failed: {e!r}"))
            yield pdf[names].assign(text=[t for t, _ in got], skipped=[s for _, s in got])

    return (titles.repartition(workers) if workers else titles).mapInPandas(run, schema)


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str], url_col: str = "url", workers: int | None = None) -> DataFrame:
    """urls with html, title, text and skipped (the reason, if the fetch failed or the page has no text)."""
    fields = urls.schema.fieldNames()
    schema = urls.drop("html", "error").schema.add("html", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: list[tuple[str | None, str | None]] = []
            for u in pdf[url_col]:
                try:
                    got.append((fetch(u), None))
                except Exception as e:  # noqa: BLE001
                    got.append((None, f"fetch failed: {e!r}"))
            yield pdf[[f for f in fields if f not in ("html", "error")]].assign(html=[h for h, _ in got], error=[e for _, e in got])

    df = (urls.repartition(workers) if workers else urls).mapInPandas(run, schema)
    page = df.withColumn("page", html.extract(F.col("html")))
    empty = F.when(F.coalesce(F.col("page.text"), F.lit("")) == "", "empty text")
    return page.select(*[c for c in df.columns if c != "error"], F.col("page.title").alias("title_found"), F.col("page.text").alias("text"), F.coalesce("error", empty).alias("skipped"))


def resolve_titles(seeds: DataFrame, redirects: DataFrame, pages: DataFrame, hits: DataFrame) -> DataFrame:
    """seeds (title_seed) with the title they lead to, or null.

    redirects (source, target), pages (title, missing), hits (title_seed, place, title). The redirect is followed; if
    that page is missing, the first of the first three search hits that is no list or disambiguation page is taken.
    """
    r = redirects.groupBy(F.col("source").alias("title_seed")).agg(F.max("target").alias("target"))
    s = seeds.join(r, "title_seed", "left").withColumn("wanted", F.coalesce("target", "title_seed")).drop("target")
    have = pages.where(~F.coalesce("missing", F.lit(False))).select(F.col("title").alias("wanted"), F.lit(True).alias("there")).distinct()
    bad = F.lit(False)
    for x in NOT_ARTICLES:
        bad = bad | F.contains("title", F.lit(x))
    first = hits.where((F.col("place") <= 3) & ~bad).groupBy("title_seed").agg(F.min_by("title", "place").alias("hit"))
    found = s.join(have, "wanted", "left").join(first, "title_seed", "left")
    return found.select("title_seed", F.when(F.col("there"), F.col("wanted")).otherwise(F.col("hit")).alias("title"))


def look_up_revisions(titles: DataFrame, normalized: DataFrame, converted: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """titles (title) with page_id, revision_id, resolved_title, changed and page_found.

    Three maps (source, target) are applied in turn, each where it has the title; pages is (title, page_id, revision_id, missing).
    """
    df = titles.select("title", F.col("title").alias("at"))
    for m in (normalized, converted, redirects):
        step = m.groupBy(F.col("source").alias("at")).agg(F.max("target").alias("target"))
        df = df.join(step, "at", "left").select("title", F.coalesce("target", "at").alias("at"))
    p = pages.select(F.col("title").alias("at"), "page_id", "revision_id", F.coalesce("missing", F.lit(False)).alias("missing"))
    df = df.join(p, "at", "left")
    found = F.coalesce(~F.col("missing") & F.col("page_id").isNotNull(), F.lit(False))
    return df.select("title", F.col("at").alias("resolved_title"), "page_id", "revision_id", (F.col("title") != F.col("at")).alias("changed"), found.alias("page_found"))


def batches(titles: DataFrame, size: int = 20) -> DataFrame:
    """titles with the number of their request batch, by title order within partitions of equal range."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.spark_partition_id()).orderBy("title")
    n = titles.select("title").repartitionByRange("title").withColumn("k", F.row_number().over(w) - 1)
    return n.select("title", F.spark_partition_id().alias("part"), F.floor(F.col("k") / size).alias("batch"))


def probe_pages(urls: DataFrame, probe: Callable[[str], tuple[int, str]], url_col: str = "url", workers: int = 5) -> DataFrame:
    """(url, http_status, resolved_url, error): whether a page can be read; errors are cut to 160 characters."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for u in pdf[url_col]:
                try:
                    rows.append((u, *probe(u), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((u, None, None, f"{type(e).__name__}: {e}"[:160]))
            yield pd.DataFrame(rows, columns=["url", "http_status", "resolved_url", "error"]).astype({"http_status": "Int32"})

    return urls.select(url_col).repartition(workers).mapInPandas(run, "url string, http_status int, resolved_url string, error string")
