"""Pages -> tables of links, forms, e-mail addresses and metadata. HTML is read once and not carried on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmill.functions import html as H
from webmill.functions import patterns as P
from webmill.functions.predicates import in_strategy, is_html, matches_filter
from webmill.functions.urls import built_once, let, normalize_with, parse
from webmill.sources.shared import keep

#: A further extractor: HTML and page URL to an array of struct(rank, raw, source, text).
Extractor = Callable[[Column, Column], Column]


def all_links(pages: DataFrame, options: H.Options = H.Options(), extractors: tuple[Extractor, ...] = (), carry: tuple[str, ...] = (), sources: tuple[str, ...] | None = None, once: bool = False) -> DataFrame:
    """(page_id, page_url, url, source, text, rank, pos) of every link, resolved; those that lead nowhere left out. once: the
    first link to each URL of a page only.

    sources: only links of these. Each link is resolved once, within its page's array, before the array is spread.
    """
    rows = pages.select("page_id", F.col("url").alias("page_url"), *carry, F.explode(_resolved(options, extractors, sources, once)).alias("link"))
    return rows.select("page_id", "page_url", *carry, "link.url", "link.source", "link.text", "link.rank", "link.pos")


@built_once
def _resolved(options: H.Options, extractors: tuple[Extractor, ...], sources: tuple[str, ...] | None, once: bool) -> Column:
    """A page's links as an array of struct(url, pos, source, text, rank). Links sorted by URL and place are next to each
    other, so the first to each URL is known without anything leaving the row."""
    found = H.raw_links("html", options, sources)
    if extractors:
        found = F.concat(found, *[e(F.col("html"), F.col("url")) for e in extractors])
    link = lambda x, i, b: F.struct(normalize_with(x.raw, b).alias("url"), i.alias("pos"), x.source.alias("source"), x.text.alias("text"), x.getField("rank").alias("rank"))
    resolved = let(parse(H.base_url("html", "url")), lambda b: F.transform(found, lambda x, i: link(x, i, b)))
    resolved = F.filter(resolved, lambda x: x.url.isNotNull())
    if not once:
        return resolved
    return let(F.array_sort(resolved), lambda a: F.filter(a, lambda x, i: (i == 0) | (x.url != F.get(a, i - 1).url)))


def first_links(links: DataFrame) -> DataFrame:
    """The first link to each URL of each page, of links that may lie anywhere: a partial minimum before the shuffle, no sort."""
    rest = [c for c in links.columns if c not in ("page_id", "url", "pos")]
    first = F.min(F.struct("pos", *rest)).alias("first")
    return links.groupBy("page_id", "url").agg(first).select("page_id", "url", "first.pos", *[f"first.{c}" for c in rest])


def extract_links(pages: DataFrame, options: H.Options = H.Options(), extractors: tuple[Extractor, ...] = (), carry: tuple[str, ...] = (), sources: tuple[str, ...] | None = None) -> DataFrame:
    """The first link of any source to each URL of each page (sources: the first of these). A row is a page, so nothing is shuffled."""
    return all_links(pages, options, extractors, carry, sources, once=True)


def navigable(links: DataFrame) -> DataFrame:
    return links.filter(F.col("source").isin(*P.NAVIGABLE))


def resources(links: DataFrame) -> DataFrame:
    return links.filter(F.col("source").isin(*P.RESOURCES))


def extract_forms(pages: DataFrame) -> DataFrame:
    """(page_id, form_no, action, method, id, name, inputs)."""
    rows = pages.select("page_id", H.forms("html", H.base_url("html", "url")).alias("forms"))
    rows = rows.select("page_id", F.posexplode("forms").alias("form_no", "form"))
    return rows.select("page_id", "form_no", "form.action", "form.method", "form.id", "form.name", "form.inputs")


def form_inputs(forms: DataFrame) -> DataFrame:
    """(page_id, form_no, input_no, name, type, value, required, options)."""
    rows = forms.select("page_id", "form_no", F.posexplode("inputs").alias("input_no", "i"))
    return rows.select("page_id", "form_no", "input_no", "i.name", "i.type", "i.value", "i.required", "i.options")


def extract_emails(pages: DataFrame, id_col: str = "page_id", text_col: str = "html") -> DataFrame:
    """(id, email, n): n counts from the first in the text."""
    return pages.select(id_col, F.posexplode(H.emails(text_col)).alias("n", "email")).select(id_col, "email", "n")


def extract_metadata(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.metadata("html").alias("m")).select("page_id", "m.*")


@dataclass(frozen=True)
class Extracted:
    """What pages hold, as far as it was asked for."""

    links: DataFrame
    forms: DataFrame | None
    emails: DataFrame | None
    metadata: DataFrame | None


def extract(pages: DataFrame, options: H.Options = H.Options(), extractors: tuple[Extractor, ...] = ()) -> Extracted:
    """All of html_pages(pages) at once; options turn forms, e-mail addresses and metadata off. Pages are read and searched
    once: what they hold is written as a table, of which each part reads its own columns."""
    base = H.base_url("html", "url")
    held = [_resolved(options, extractors, None, True).alias("links")]
    held += [H.forms("html", base).alias("forms")] if options.forms else []
    held += [H.emails("html").alias("emails")] if options.emails else []
    held += [H.metadata("html").alias("metadata")] if options.metadata else []
    table = keep(html_pages(pages).select("page_id", F.col("url").alias("page_url"), *held), "extracted")
    links = table.select("page_id", "page_url", F.explode("links").alias("link")).select("page_id", "page_url", "link.url", "link.source", "link.text", "link.rank", "link.pos")
    forms = table.select("page_id", F.posexplode("forms").alias("form_no", "form")).select("page_id", "form_no", "form.action", "form.method", "form.id", "form.name", "form.inputs") if options.forms else None
    emails = table.select("page_id", F.posexplode("emails").alias("n", "email")).select("page_id", "email", "n") if options.emails else None
    return Extracted(links, forms, emails, table.select("page_id", "metadata.*") if options.metadata else None)


def html_pages(pages: DataFrame) -> DataFrame:
    """Pages that an HTML extractor can handle: by content type, where there is one."""
    return pages.filter(F.coalesce(is_html("content_type"), F.lit(True))) if "content_type" in pages.columns else pages


def combine(results: list[DataFrame]) -> DataFrame:
    """Links of several extractors as one: all of the first before all of the second, then the first of each URL."""
    ranked = [r.withColumn("pos", F.col("pos") + F.lit(i << 24)) for i, r in enumerate(results)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r)
    return first_links(out)


def combine_forms(results: list[DataFrame]) -> DataFrame:
    """Forms of several extractors, all of the first before all of the second, numbered anew within their page."""
    out = results[0].withColumn("_o", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("_o", F.lit(i)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("_o", "form_no")) - 1
    return out.withColumn("form_no", place).drop("_o")


def combine_emails(results: list[DataFrame]) -> DataFrame:
    """(id, email, n) of several extractors: each address of a text once, where it comes first."""
    id_col = results[0].columns[0]
    out = results[0].withColumn("_o", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("_o", F.lit(i)))
    first = out.groupBy(id_col, "email").agg(F.min(F.struct("_o", "n")).alias("f"))
    return first.select(id_col, "email", (F.row_number().over(Window.partitionBy(id_col).orderBy("f")) - 1).alias("n"))


def combine_metadata(results: list[DataFrame]) -> DataFrame:
    """Later extractors' metadata overrides earlier ones', field by field."""
    fields = [c for c in results[0].columns if c != "page_id"]
    out = results[0].withColumn("_o", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("_o", F.lit(i)))
    return out.groupBy("page_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_o"))).alias(c) for c in fields])


def enqueue_links(pages: DataFrame, strategy: str | None = None, same_domain_only: bool = True, query: str | None = None, max_depth: int | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, options: H.Options = H.Options(), extractors: tuple[Extractor, ...] = ()) -> DataFrame:
    """Child links of fetched pages (page_id, url, html, depth, status): scoped, filtered, one level deeper.

    One narrow plan: nothing is shuffled.
    """
    deep = F.lit(True) if max_depth is None else F.col("depth") < max_depth
    parents = html_pages(pages).filter(F.col("status").between(200, 299) & deep)
    links = all_links(parents, options, extractors, ("depth",), once=True)
    # Both conditions look at nothing but the link's and the page's URL, so they hold for the first link or for none.
    links = links.filter(in_strategy("url", "page_url", strategy, same_domain_only) & matches_filter("url", query))
    children = links.withColumn("depth", F.col("depth") + 1)
    return transform(children) if transform else children
