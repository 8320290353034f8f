"""Cookies as Column functions: Set-Cookie headers, jars and the headers made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webmill.functions.urls import col, let, trim_ws


def parse_set_cookie(header: Column | str, now: Column | str, default_domain: Column | str = None) -> Column:
    """struct(name, value, domain, path, expires, http_only, secure, same_site); null without a name or "=".

    Of several attributes of one name the last counts, and of Expires and Max-Age the later one. Max-Age counts from
    `now`. One leading dot of a domain goes. Dates are read in the usual form of HTTP.
    """
    domain = F.lit(None).cast("string") if default_domain is None else col(default_domain)
    parts = F.transform(F.split(col(header), ";"), lambda x: trim_ws(x))
    key = lambda x: F.lower(trim_ws(F.substring_index(x, "=", 1)))
    value = lambda x: trim_ws(F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1))

    none = F.lit(None).cast("struct<k:string,v:string>")
    age = lambda v: F.regexp_extract(v, r"^([+-]?[0-9]+)", 1).try_cast("long")

    def attributes(p: Column) -> Column:
        return F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))

    def ends(until: Column) -> Column:
        date = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(until.v, "^[A-Za-z]+, *", ""), "-", " "), F.lit("d MMM yyyy HH:mm:ss zzz"))
        return F.when(until.k == "max-age", F.timestamp_millis(F.unix_millis(col(now).cast("timestamp")) + age(until.v) * 1000)).when(until.k == "expires", date)

    def read(p: Column, attrs: Column) -> Column:
        last = lambda *names: F.element_at(F.concat(F.array(none), F.filter(attrs, lambda a: a.k.isin(*names))), -1)
        has = lambda name: F.when(F.exists(attrs, lambda a: a.k == name), True)
        usable = F.filter(attrs, lambda a: (a.k == "expires") | (a.k == "max-age") & age(a.v).isNotNull())
        same_site = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(attrs, lambda a: (a.k == "samesite") & F.lower(a.v).isin("strict", "lax", "none")), lambda a: F.initcap(a.v))), -1)
        cookie = F.struct(
            trim_ws(F.substring_index(p[0], "=", 1)).alias("name"),
            value(p[0]).alias("value"),
            F.coalesce(F.regexp_replace(last("domain").v, r"^\.", ""), domain).alias("domain"),
            last("path").v.alias("path"),
            let(F.element_at(F.concat(F.array(none), usable), -1), ends).alias("expires"),
            has("httponly").alias("http_only"),
            has("secure").alias("secure"),
            same_site.alias("same_site"),
        )
        return F.when(p[0].contains("=") & (trim_ws(F.substring_index(p[0], "=", 1)) != ""), cookie)

    return let(parts, lambda p: let(attributes(p), lambda attrs: read(p, attrs)))


def is_expired(cookie: Column, now: Column | str) -> Column:
    return F.coalesce(cookie.expires < col(now), F.lit(False))


def cookies_for(cookies: Column | str, domain: Column | str, now: Column | str) -> Column:
    """Cookies that hold for a domain: without a domain of their own, or with one that the domain ends with."""
    return F.filter(col(cookies), lambda c: ~is_expired(c, now) & (c.domain.isNull() | col(domain).endswith(c.domain)))


def cookie_header(cookies: Column | str, domain: Column | str, now: Column | str) -> Column:
    return F.array_join(F.transform(cookies_for(cookies, domain, now), lambda c: F.concat(c.getField("name"), F.lit("="), c.value)), "; ")


def all_headers(headers: Column | str, cookies: Column | str, domain: Column | str, now: Column | str) -> Column:
    """The session's headers, and Cookie where one holds."""
    rest = F.map_filter(F.coalesce(col(headers), F.create_map().cast("map<string,string>")), lambda k, _: k != "Cookie")
    return let(cookie_header(cookies, domain, now), lambda line: F.when(line == "", col(headers)).otherwise(F.map_concat(rest, F.create_map(F.lit("Cookie"), line))))


def set_cookie(cookies: Column | str, cookie: Column) -> Column:
    """The jar with a cookie, in place of one of the same name and domain."""
    return F.concat(remove_cookie(cookies, cookie.getField("name"), cookie.domain), F.array(cookie))


def remove_cookie(cookies: Column | str, name: Column, domain: Column) -> Column:
    return F.filter(col(cookies), lambda c: ~((c.getField("name") == name) & c.domain.eqNullSafe(domain)))


def get_cookie(cookies: Column | str, name: Column | str) -> Column:
    wanted = F.lit(name) if isinstance(name, str) else name
    return F.get(F.filter(col(cookies), lambda c: c.getField("name") == wanted), 0)


def set_header(headers: Column | str, name: str, value: Column | str) -> Column:
    return F.map_concat(remove_header(headers, name), F.create_map(F.lit(name), F.lit(value) if isinstance(value, str) else value))


def remove_header(headers: Column | str, name: str) -> Column:
    return F.map_filter(col(headers), lambda k, _: k != name)
