"""URLs as Column functions: parsing, resolving and keys, after the web's URL standard.

Hosts must be ASCII (others, like numeric forms of IPv4, are not rewritten: a host with other letters is invalid).
Everything stays in the JVM. A value that is used more than once is bound by `let`, so expressions stay small.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from webmill.functions.patterns import SKIPPED, WS

#: Default ports of the schemes whose URLs have a host.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def built_once(f: Callable[..., Column]) -> Callable[..., Column]:
    """f, whose expression of columns that are given by name is built once in a context: it takes some thousand calls of the
    JVM, and a crawl asks for it every round."""
    made: weakref.WeakKeyDictionary[SparkContext, dict] = weakref.WeakKeyDictionary()

    @functools.wraps(f)
    def get(*args):
        if any(isinstance(a, Column) for a in args):
            return f(*args)
        known = made.setdefault(SparkContext.getOrCreate(), {})
        if args not in known:
            known[args] = f(*args)
        return known[args]

    return get


def trim_ws(c: Column | str) -> Column:
    """Without white space at either end, as the web's trim() has it."""
    return F.regexp_replace(col(c), f"^[{WS}]+|[{WS}]+\\z", "")


def ascii_lower(text: Column) -> Column:
    """ASCII letters in lower case, as patterns that look away from case have it."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _encode(text: Column, ascii_set: str) -> Column:
    """Percent-encoded where not ASCII, and where one of ascii_set (a character class without brackets)."""
    parts = F.regexp_extract_all(text, F.lit(f"[^\\x00-\\x7f]+|[{ascii_set}]+|[^{ascii_set}]".replace("|[^", "|(?:(?![^\\x00-\\x7f])[^") + ")+"), 0)
    done = F.transform(parts, lambda x: F.when(x.rlike(f"^[^\\x00-\\x7f]|^[{ascii_set}]"), F.regexp_replace(F.url_encode(x), "\\+", "%20")).otherwise(x))
    return F.when(text.rlike(f"[^\\x00-\\x7f]|[{ascii_set}]"), F.array_join(done, "")).otherwise(text)


def _path(path: Column) -> Column:
    """Percent-encoded and without dot segments."""
    dot = lambda x: F.lower(x).isin(".", "%2e")
    dots = lambda x: F.lower(x).isin("..", ".%2e", "%2e.", "%2e%2e")

    def step(acc: Column, x: Column, last: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        end = F.array(F.lit(""))
        return F.when(dots(x), F.when(last, F.concat(up, end)).otherwise(up)).when(dot(x), F.when(last, F.concat(acc, end)).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))

    def plain(p: Column) -> Column:
        segments = F.split(F.substring(p, 2, 1 << 30), "/")
        indexed = F.transform(segments, lambda x, i: F.named_struct(F.lit("x"), x, F.lit("last"), i == F.size(segments) - 1))
        joined = F.aggregate(indexed, F.array().cast("array<string>"), lambda acc, s: step(acc, s.x, s.last))
        return F.when(p.rlike(r"(?i)/(\.|%2e){1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(joined, "/"))).otherwise(p)

    return let(_encode(path, "\\x00-\\x20\"<>`{}^\\x7f"), plain)


#: Paths, with a query or fragment, that stand in a URL as they are: no segment begins or ends with a dot.
_PLAIN_SEGMENT = r"[A-Za-z0-9_~-]++(?:\.[A-Za-z0-9_~-]++)*+"
_PLAIN_REST = rf"/(?:{_PLAIN_SEGMENT}/?+)*+(?:\?[A-Za-z0-9_~.&=/-]++)?+(?:#[A-Za-z0-9_~.&=/-]*+)?+\z"
_PLAIN_PATH = "^" + _PLAIN_REST
_PLAIN_URL = r"^https?+://[a-z0-9-]++(?:\.[a-z0-9-]++)*+" + _PLAIN_REST


@built_once
def parse(url: Column | str) -> Column:
    """struct(scheme, user, host, port, path, query, fragment), null where the URL is invalid. query and fragment hold
    their mark and are empty where absent; port is empty where it is the scheme's own."""
    text = F.regexp_replace(F.regexp_replace(col(url), "^[\\x00-\\x20]+|[\\x00-\\x20]+\\z", ""), "[\\t\\n\\r]", "")

    def split(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        rest = F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(.*)\z", 1)
        fragment = F.regexp_extract(rest, r"(?s)(#.*)\z", 1)
        before = F.regexp_extract(rest, r"(?s)^([^#]*)", 1)
        query = F.regexp_extract(before, r"(?s)(\?.*)\z", 1)
        place = F.translate(F.regexp_extract(before, r"(?s)^([^?]*)", 1), "\\", "/")
        place = F.regexp_replace(place, "^/+", "")
        return F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(place, r"(?s)^([^/]*)", 1).alias("authority"),
            F.regexp_extract(place, r"(?s)^[^/]*(/.*)?\z", 1).alias("path"),
            query.alias("query"),
            fragment.alias("fragment"),
        )

    def build(s: Column) -> Column:
        user = F.regexp_extract(s.authority, r"(?s)^(.*)@", 1)
        place = F.regexp_extract(s.authority, r"(?s)([^@]*)\z", 1)
        host = F.lower(F.regexp_extract(place, r"(?s)^(\[[^\]]*\]|[^:]*)", 1))
        port = F.regexp_replace(F.regexp_extract(place, r"(?s)^(?:\[[^\]]*\]|[^:\[]*):(.*)\z", 1), "^0+(?=[0-9])", "")
        good = (
            s.scheme.isin(*PORTS)
            & host.rlike(r"^(\[[0-9a-f:.]+\]|[^\x00-\x20\x7f-\x{10ffff}#%/:<>?@\[\\\]^|`{}\"]+)\z")
            & place.rlike(r"^(\[[^\]]*\]|[^:\[\]]*)(:[0-9]*)?\z")
            & ((port == "") | (F.length(port) <= 5) & (F.coalesce(port.try_cast("int"), F.lit(70000)) <= 65535))
        )
        own = F.element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), s.scheme)
        return F.when(
            good,
            F.struct(
                s.scheme.alias("scheme"),
                user.alias("user"),
                host.alias("host"),
                F.when(port == own, "").otherwise(port).alias("port"),
                _path(F.when(s.path == "", "/").otherwise(s.path)).alias("path"),
                F.when(s.query == "?", "?").otherwise(_encode(s.query, "\\x00-\\x20\"<>'\\x7f")).alias("query"),
                _encode(s.fragment, "\\x00-\\x20\"<>`\\x7f").alias("fragment"),
            ),
        )

    def plain(u: Column) -> Column:
        """The parts of a URL in which nothing is to be changed."""
        return F.struct(
            F.substring_index(u, ":", 1).alias("scheme"),
            F.lit("").alias("user"),
            F.regexp_extract(u, "^[a-z]+://([^/]*)", 1).alias("host"),
            F.lit("").alias("port"),
            F.regexp_extract(u, "^[a-z]+://[^/]*([^?#]*)", 1).alias("path"),
            F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
            F.regexp_extract(u, "(#.*)", 1).alias("fragment"),
        )

    return let(text, lambda u: F.when(u.rlike(_PLAIN_URL), plain(u)).otherwise(let(split(u), build)))


def origin_of(p: Column) -> Column:
    return F.concat(p.scheme, F.lit("://"), p.host, F.when(p.port != "", F.concat(F.lit(":"), p.port)).otherwise(""))


def href_of(p: Column, fragment: bool = True) -> Column:
    """The URL written out; an empty query loses its mark only where a fragment would (it stays as the standard has it)."""
    user = F.when(p.user != "", F.concat(p.user, F.lit("@"))).otherwise("")
    port = F.when(p.port != "", F.concat(F.lit(":"), p.port)).otherwise("")
    parts = [p.scheme, F.lit("://"), user, p.host, port, p.path, p.query]
    return F.concat(*parts, *([p.fragment] if fragment else []))


@built_once
def url_host(url: Column | str) -> Column:
    """Host name, or null where the URL is invalid."""
    return let(parse(url), lambda p: p.host)


@built_once
def url_origin(url: Column | str) -> Column:
    return let(parse(url), origin_of)


def url_domain(url: Column | str) -> Column:
    """Host name, or the input itself where it is no URL."""
    return F.coalesce(url_host(url), col(url))


def root_domain(host: Column | str) -> Column:
    """The last two labels, whatever they are."""
    return F.substring_index(col(host), ".", -2)


def is_valid(url: Column | str) -> Column:
    return url_host(url).isNotNull()


@built_once
def serialize(url: Column | str) -> Column:
    """The URL with its host in lower case and all other parts as the standard writes them."""
    return let(parse(url), href_of)


@built_once
def normalize(url: Column | str, base: Column | str) -> Column:
    """A link as found on the page `base`: absolute and without a fragment; null where it leads nowhere."""
    return let(parse(base), lambda b: normalize_with(url, b))


def normalize_with(url: Column | str, b: Column) -> Column:
    """normalize(), for a base that is parsed already."""
    skipped = lambda u: F.coalesce(*[F.when(u.startswith(x), F.lit(True)) for x in SKIPPED], F.lit(False)) | (u == "")
    bare = lambda u: F.substring_index(u, "#", 1)

    def resolve(u: Column) -> Column:
        absolute = (
            F.when(u.startswith("http://") | u.startswith("https://"), u)
            .when(u.startswith("//"), F.concat(b.scheme, F.lit(":"), u))
            .when(u.startswith("/"), F.concat(origin_of(b), u))
            .when(u.startswith("?"), F.concat(origin_of(b), b.path, u))
            .otherwise(F.concat(origin_of(b), F.regexp_extract(b.path, r"(?s)^(.*/)", 1), u))
        )
        # Most links are plain already: nothing in them is encoded, in upper case or to be left out but a fragment.
        return F.when(u.rlike(_PLAIN_PATH), F.concat(origin_of(b), bare(u))).when(u.rlike(_PLAIN_URL), bare(u)).when(~skipped(u), let(parse(absolute), lambda p: href_of(p, fragment=False)))

    return let(trim_ws(url), resolve)


def _decode(x: Column) -> Column:
    """Form decoding; malformed escapes are left as they stand."""
    plus = F.regexp_replace(x, "\\+", "%20")
    safe = F.regexp_replace(plus, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), plus)


@built_once
def unique_key(url: Column | str, method: Column | str = None) -> Column:
    """METHOD:url with query parameters sorted by "name,value" and written anew, without a fragment."""
    verb = F.lit("GET") if method is None else F.upper(col(method))

    def key(p: Column) -> Column:
        pieces = F.filter(F.split(F.substring(p.query, 2, 1 << 30), "&"), lambda x: x != "")
        pairs = F.transform(pieces, lambda x: F.struct(_decode(F.substring_index(x, "=", 1)).alias("k"), _decode(F.regexp_extract(x, r"(?s)^[^=]*=(.*)\z", 1)).alias("v")))
        order = F.array_sort(F.transform(pairs, lambda q: F.struct(F.concat_ws(",", q.k, q.v).alias("s"), q.k.alias("k"), q.v.alias("v"))))
        written = F.array_join(F.transform(order, lambda q: F.concat(F.url_encode(q.k), F.lit("="), F.url_encode(q.v))), "&")
        bare = F.struct(p.scheme.alias("scheme"), p.user.alias("user"), p.host.alias("host"), p.port.alias("port"), p.path.alias("path"), F.when(written == "", "").otherwise(F.concat(F.lit("?"), written)).alias("query"))
        return let(bare, lambda b: href_of(b, fragment=False))

    return F.concat(verb, F.lit(":"), F.coalesce(let(parse(url), lambda p: F.when(p.isNotNull(), key(p))), col(url)))


@built_once
def request_like(url: Column | str, method: Column | str = None) -> Column:
    """struct(host, path with query, url trimmed, method), or null where the URL is invalid."""
    verb = F.lit("GET") if method is None else F.upper(col(method))
    return let(parse(trim_ws(url)), lambda p: F.when(p.isNotNull(), F.struct(F.lower(p.host).alias("host"), F.concat(p.path, F.when(p.query == "?", "").otherwise(p.query)).alias("path"), trim_ws(url).alias("url"), verb.alias("method"))))


def path_and_query(url: Column | str) -> Column:
    return request_like(url).path


def robots_url(url: Column | str) -> Column:
    return F.concat(url_origin(url), F.lit("/robots.txt"))


def build_url(host: Column | str, port: Column | str, tls: Column | str) -> Column:
    """The origin of a connection; the port is left out where it is the scheme's own."""
    scheme, own = F.when(col(tls), "https").otherwise("http"), F.when(col(tls), 443).otherwise(80)
    return F.concat(scheme, F.lit("://"), col(host), F.when(col(port) == own, "").otherwise(F.concat(F.lit(":"), col(port).cast("string"))))
