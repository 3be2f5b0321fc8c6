"""Inventory of sources and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import has_rights_signal, history_address, host, quote_title

#: Stands after every host in the order of a report.
LAST = "\uffff"


#: What is known of a page's rights: its site has a policy, its title a page, or neither (fixed values).
STATUS = ("site_policy_found_page_specific_terms_unconfirmed", "current_page_found_original_revision_and_attribution_unconfirmed", "title_unresolved_requires_source_match")


def source_inventory(df: DataFrame, policies: DataFrame | None = None, order: str = "line_no", id_col: str = "id", title_host: str | None = None, title_page: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """One row per source page (URL, else title): record_count, record_ids in order, signal_ids, title, host, policy,
    candidate_url, rights_status.

    Records with neither URL nor title are left out. Pages known by title lie at title_host; their candidate address is
    title_page with the quoted title (of pages (title, current_title), if given, the current one; titles without one are
    unresolved). The ids of one page are gathered, as its inventory row needs: ids only, and of as many rows as it has.
    """
    kind = F.when(F.col("source_url").isNotNull(), "url").when(F.col("source_title").isNotNull(), "title")
    key, signal = F.coalesce("source_url", "source_title"), F.coalesce(has_rights_signal(F.col("text")), F.lit(False))
    # texts stay where they are: the shuffle moves ids and marks
    d = df.where(kind.isNotNull()).select(kind.alias("source_kind"), key.alias("source_key"), F.col(order).alias("o"), F.col(id_col).alias("id"), signal.alias("s"), "source_title")
    ids = F.array_sort(F.collect_list(F.struct("o", "id", "s")))
    g = d.groupBy("source_kind", "source_key").agg(F.count("*").alias("record_count"), ids.alias("x"), F.min_by("source_title", "o").alias("source_title"))
    is_url = F.col("source_kind") == "url"
    at = F.when(is_url, host(F.col("source_key"))).otherwise(F.lit(title_host).cast("string"))
    out = g.select(
        "source_kind", "source_key", "record_count", F.transform("x", lambda r: r["id"]).alias("record_ids"),
        F.transform(F.filter("x", lambda r: r["s"]), lambda r: r["id"]).alias("signal_ids"), "source_title", at.alias("host"),
    )
    current = F.col("source_key")
    if pages is not None:
        out = out.join(pages.groupBy(F.col("title").alias("_t")).agg(F.min("current_title").alias("_now")), F.col("source_key") == F.col("_t"), "left")
        current = F.col("_now")
    page = F.concat(F.lit(title_page).cast("string"), quote_title(current))
    out = out.withColumn("candidate_url", F.when(is_url, F.col("source_key")).otherwise(F.coalesce(page, F.concat(F.lit(title_page).cast("string"), quote_title(F.col("source_key"))))))
    known = policies.groupBy("host").agg(F.min("policy").alias("policy")) if policies is not None else None
    out = out.join(known, "host", "left") if known is not None else out.withColumn("policy", F.lit(None).cast("string"))
    status = F.when(is_url & F.col("policy").isNotNull(), STATUS[0]).when(~is_url & current.isNotNull() & F.lit(title_page is not None), STATUS[1]).otherwise(STATUS[2])
    return out.withColumn("rights_status", status).drop("_t", "_now")


def only_active(inventory: DataFrame, active: DataFrame, id_col: str = "id") -> DataFrame:
    """The inventory with only the records that are active; pages without any are left out."""
    each = inventory.select("source_kind", "source_key", F.posexplode("record_ids").alias("at", "rid"))
    kept = each.join(active.select(F.col(id_col).alias("rid")).distinct(), "rid", "left_semi")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "rid"))), lambda r: r["rid"])
    new = kept.groupBy("source_kind", "source_key").agg(ids.alias("record_ids"), F.count("*").alias("record_count"))
    return inventory.drop("record_ids", "record_count").join(new, ["source_kind", "source_key"])


def by_host(inventory: DataFrame) -> DataFrame:
    """Pages and records per host."""
    return inventory.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("record_count").alias("n_records"), F.sum(F.size("signal_ids")).alias("n_signals"))


def audit_summary(inventory: DataFrame, found: Column | None = None) -> DataFrame:
    """One row: pages, records, pages with a rights signal and pages found, if that is known."""
    f = F.lit(None).cast("boolean") if found is None else found
    return inventory.agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("n_records"), F.count_if(F.size("signal_ids") > 0).alias("n_with_signal"), F.count_if(F.coalesce(f, F.lit(False))).alias("n_found"))


def attribution_lines(inventory: DataFrame, agencies: DataFrame | None = None, opening: list[str] | None = None, closing: list[str] | None = None) -> DataFrame:
    """(host, part, t, u, line) of a Markdown report, sorted by these: the opening, per host a heading, its policy, a table
    of its pages by title (with their author history where they are known by title), and the closing.

    agencies: (host, agency), the names of hosts. The opening stands before all hosts, the closing after them.
    """
    inv = inventory.where(F.col("host").isNotNull())
    if agencies is not None:
        inv = inv.join(agencies.groupBy("host").agg(F.min("agency").alias("agency")), "host", "left")
    name = F.coalesce("agency", "host") if agencies is not None else F.col("host")
    titled = F.col("source_kind") == "title"
    h = inv.groupBy("host", name.alias("name")).agg(F.count("*").alias("p"), F.sum("record_count").alias("r"), F.max("policy").alias("policy"), F.max(titled).alias("titled"))
    row = lambda part, line: F.struct(F.lit(part).alias("part"), line.alias("line"))
    head = F.array(
        row(0, F.format_string("## %s: %d pages, %d records", "name", "p", "r")), row(1, F.lit("")), row(2, F.concat(F.lit("Site policy: [see]("), F.col("policy"), F.lit(")."))), row(3, F.lit("")),
        row(4, F.when(F.col("titled"), "| Page | Authors | Records |").otherwise("| Page | Records |")), row(5, F.when(F.col("titled"), "|---|---|---:|").otherwise("|---|---:|")), row(7, F.lit("")),
    )
    heads = h.select("host", F.explode(head).alias("x")).select("host", "x.part", F.lit("").alias("t"), F.lit("").alias("u"), "x.line").where(F.col("line").isNotNull())
    shown = F.coalesce("source_title", "source_key")
    link = F.concat(F.lit("["), shown, F.lit("]("), F.coalesce("candidate_url", "source_key"), F.lit(")"))
    authors = F.when(titled, F.concat(F.lit(" [history]("), history_address(F.coalesce("candidate_url", "source_key")), F.lit(") |"))).otherwise("")
    rows = inv.select("host", F.lit(6).alias("part"), F.coalesce("source_title", F.lit("")).alias("t"), F.col("source_key").alias("u"), F.concat(F.lit("| "), link, F.lit(" |"), authors, F.format_string(" %d |", "record_count")).alias("line"))
    out, spark = heads.unionByName(rows), inventory.sparkSession
    for at, lines in (("", opening), (LAST, closing)):
        if lines:
            out = out.unionByName(spark.createDataFrame([(at, k, "", "", x) for k, x in enumerate(lines)], "host string, part int, t string, u string, line string"))
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The lines as text files in report order."""
    d = lines.repartitionByRange("host", "part", "t", "u").sortWithinPartitions("host", "part", "t", "u")
    d.select("line").write.mode("error").text(path)
