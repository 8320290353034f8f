"""What a page holds, as Column functions over its HTML: links, forms, e-mail addresses and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webmill.functions import patterns as P
from webmill.functions.urls import col, let, normalize_with, parse, trim_ws


@dataclass(frozen=True)
class Options:
    """What to extract. A branch that is off is not in the plan."""

    forms: bool = True
    emails: bool = True
    metadata: bool = True
    scripts: bool = True
    style_urls: bool = True
    js_strings: bool = False
    data_urls: bool = True


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def first(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


#: Rank, place within the rank, and source of what the attributes of a tag link to, in order of emission.
_KINDS = (("form", "form"), ("iframe", "iframe"), ("meta", "meta"), ("area", "anchor"), ("script", "script"), ("link", "link"), ("image", "image"), ("media", "link"))
_TAGS = {
    tag: (rank, place, source, P.of_tag(tag, attribute) if attribute else P.META_REFRESH)
    for rank, (kind, source) in enumerate(_KINDS, 1)
    for place, (tag, attribute) in enumerate(P.LINK_ATTRIBUTES.get(kind, [(kind, "")]))
}


def _link(rank: int, raw: Column, source: str, text: Column | None = None) -> Column:
    return F.struct(F.lit(rank).alias("rank"), raw.alias("raw"), F.lit(source).alias("source"), (F.lit(None).cast("string") if text is None else text).alias("text"))


def _of_rank(found: Column, rank: int, source: str) -> Column:
    return F.transform(found, lambda x: _link(rank, x, source))


def _candidates(value: Column) -> Column:
    """URLs of a srcset."""
    return F.transform(F.split(value, ","), lambda x: F.regexp_extract(trim_ws(x), f"^([^{P.WS}]*)", 1))


def _by_pattern(h: Column, tags: tuple[str, ...]) -> Column:
    """Links of the tags, each tag searched for by itself: right for any page."""
    parts = []
    for tag in tags:
        rank, place, source, pattern = _TAGS[tag]
        found = every(h, pattern)
        if tag == "img":
            found = F.concat(found, F.flatten(F.transform(every(h, P.SRCSET), _candidates)))
        parts.append(_of_rank(found, rank, source))
    return F.concat(*parts)


def _by_tag(found: Column, tags: tuple[str, ...]) -> Column:
    """Links of tags that were found by one search, each classed by its name."""

    def of(t: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1))
        link = lambda tag, raw, place, j: F.struct(F.lit(_TAGS[tag][0]).alias("rank"), place.alias("place"), i.alias("i"), j.alias("j"), raw.alias("raw"), F.lit(_TAGS[tag][2]).alias("source"))
        cases = F
        for tag in tags:
            _, place, _, pattern = _TAGS[tag]
            links = F.array(link(tag, F.regexp_extract(t, pattern, 1), F.lit(place), F.lit(0)))
            if tag == "img":
                more = F.when(F.lower(t).contains("srcset"), F.transform(_candidates(F.regexp_extract(t, P.SRCSET, 1)), lambda x, j: link("img", x, F.lit(1), j))).otherwise(F.array().cast("array<struct<rank:int,place:int,i:int,j:int,raw:string,source:string>>"))
                links = F.concat(links, more)
            cases = cases.when(name == tag, links)
        return cases

    in_order = F.array_sort(F.flatten(F.transform(found, of)))
    return F.transform(in_order, lambda x: F.struct(x.getField("rank").alias("rank"), x.raw.alias("raw"), x.source.alias("source"), F.lit(None).cast("string").alias("text")))


def _tag_links(h: Column, low: Column, tags: tuple[str, ...]) -> Column:
    """Links of the tags' attributes. A page that has any is searched once for all of them; one with a tag that cannot be
    told apart so is searched for each by itself."""
    none = F.array().cast("array<struct<rank:int,raw:string,source:string,text:string>>")
    any_of = [low.contains(f"<{t}") for t in tags]
    mentioned = any_of[0]
    for m in any_of[1:]:
        mentioned |= m
    unclear = lambda found: F.exists(found, lambda t: t.rlike(P.UNCLEAR))
    once = let(F.regexp_extract_all(h, F.lit(P.any_tag(tags)), 0), lambda found: F.when(unclear(found), _by_pattern(h, tags)).otherwise(_by_tag(found, tags)))
    return F.when(mentioned, once).otherwise(none)


def raw_links(html: Column | str, options: Options = Options(), sources: tuple[str, ...] | None = None) -> Column:
    """array of struct(rank, raw, source, text), in order of emission, without empty ones. Values of single attributes are
    read where they are double-quoted; anchors are read in any quotes and need their closing tag. sources: only links of
    these, so that the page is not searched for others."""
    wanted = lambda *names: sources is None or bool(set(names) & set(sources))
    tags = tuple(t for t, (_, _, source, _) in _TAGS.items() if wanted(source) and (t != "script" or options.scripts))

    def all_of(h: Column, low: Column) -> Column:
        def anchor(m: Column) -> Column:
            return _link(0, F.regexp_replace(m, P.ANCHOR, "$1$2$3"), "anchor", trim_ws(F.regexp_replace(m, P.ANCHOR, "$4")))

        none = F.array().cast("array<string>")
        parts = []
        if wanted("anchor"):
            parts.append(F.transform(F.when(low.contains("<a"), every(h, P.ANCHOR, 0)).otherwise(none), anchor))
        if tags:
            parts.append(_tag_links(h, low, tags))
        if options.style_urls and wanted("css"):
            blocks = F.flatten(F.transform(F.when(low.contains("<style"), every(h, P.STYLE)).otherwise(none), lambda b: F.concat(every(b, P.CSS_URL), every(b, P.CSS_IMPORT))))
            parts.append(_of_rank(F.concat(blocks, F.when(low.contains("url"), every(h, P.CSS_URL)).otherwise(none)), 9, "css"))
        if options.js_strings and wanted("javascript"):
            parts.append(_of_rank(F.concat(every(h, P.JS_URL), every(h, P.JS_ENDPOINT)), 10, "javascript"))
        if options.data_urls and wanted("link"):
            parts.append(_of_rank(F.when(low.contains("data-"), every(h, P.DATA_URL)).otherwise(none), 11, "link"))
        return F.filter(F.concat(*parts), lambda x: x.raw != "")

    return let(F.struct(col(html).alias("h"), F.lower(col(html)).alias("low")), lambda p: all_of(p.h, p.low))


def base_url(html: Column | str, url: Column | str) -> Column:
    """The page's base: the first double-quoted base href, resolved against the page; else the page itself."""
    raw = F.regexp_extract(col(html), P.of_tag("base", "href"), 1)
    return F.coalesce(let(parse(url), lambda b: normalize_with(raw, b)), col(url))


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value in any quotes; null where it is absent, empty where it is empty. The name may end a longer one."""
    pattern = rf"""(?i){name}{P.S}*={P.S}*(?:"([^"]*)"|'([^']*)'|([^{P.WS}"']+))"""
    return F.when(attrs.rlike(pattern), F.concat(*[F.regexp_extract(attrs, pattern, g) for g in (1, 2, 3)]))


def _input(attrs: Column, kind: Column, value: Column, options: Column) -> Column:
    return F.struct(attribute(attrs, "name").alias("name"), kind.alias("type"), value.alias("value"), attrs.contains("required").alias("required"), options.alias("options"))


def inputs(content: Column) -> Column:
    """array of struct(name, type, value, required, options): inputs, then selects, then text areas; those with a name."""
    nothing, no_list = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    plain = F.transform(every(content, P.INPUT), lambda a: _input(a, F.coalesce(attribute(a, "type"), F.lit("text")), attribute(a, "value"), no_list))

    def select(m: Column) -> Column:
        options = every(m.content, P.of_tag("option", "value"))
        return _input(m.attrs, F.lit("select"), F.get(options, 0), options)

    selects = F.transform(F.arrays_zip(every(content, P.SELECT, 1).alias("attrs"), every(content, P.SELECT, 2).alias("content")), select)
    areas = F.transform(every(content, P.TEXTAREA), lambda a: _input(a, F.lit("textarea"), nothing, no_list))
    return F.filter(F.concat(plain, selects, areas), lambda i: i.getField("name").isNotNull())


def forms(html: Column | str, base: Column | str) -> Column:
    """array of struct(action, method, inputs, id, name) of forms with a closing tag and an action that leads somewhere."""
    h = col(html)

    def form(m: Column, b: Column) -> Column:
        return F.struct(
            normalize_with(F.coalesce(attribute(m.attrs, "action"), F.lit("")), b).alias("action"),
            F.upper(F.coalesce(attribute(m.attrs, "method"), F.lit("GET"))).alias("method"),
            inputs(m.content).alias("inputs"),
            attribute(m.attrs, "id").alias("id"),
            attribute(m.attrs, "name").alias("name"),
        )

    found = F.arrays_zip(every(h, P.FORM, 1).alias("attrs"), every(h, P.FORM, 2).alias("content"))
    return F.filter(let(parse(base), lambda b: F.transform(found, lambda m: form(m, b))), lambda f: f.action.isNotNull())


def emails(text: Column | str) -> Column:
    """Distinct e-mail addresses in lower case, in the order they first appear."""
    return F.array_distinct(F.transform(every(col(text), P.EMAIL, 0), lambda x: F.lower(x)))


def metadata(html: Column | str) -> Column:
    """struct(title, description, keywords, canonical, language, robots), each null where the page has none."""
    h = col(html)
    keywords = first(h, P.of_meta("name", "keywords"))
    canonical = F.nullif(trim_ws(first(h, P.CANONICAL)), F.lit(""))
    og_url = trim_ws(first(h, P.of_meta("property", "og:url")))
    return F.struct(
        trim_ws(first(h, P.TITLE)).alias("title"),
        trim_ws(first(h, P.of_meta("name", "description"))).alias("description"),
        F.transform(F.split(keywords, ","), lambda x: trim_ws(x)).alias("keywords"),
        F.coalesce(canonical, og_url).alias("canonical"),
        trim_ws(first(h, P.HTML_LANG)).alias("language"),
        trim_ws(first(h, P.of_meta("name", "robots"))).alias("robots"),
    )
