"""Filters: the request-filter language, link scopes, routes and URL kinds, as conditions that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from webmill.functions import patterns as P
from webmill.functions.regex import checked
from webmill.functions.urls import col, let, origin_of, parse, request_like, root_domain, url_host

# -- the filter language -----------------------------------------------------------------------------------------

_CLAUSE = re.compile(P.CLAUSE, re.I)


@dataclass(frozen=True)
class Clause:
    namespace: str
    field: str
    op: str
    value: str


def parse_clause(text: str) -> Clause | None:
    """A clause at the beginning of text (what follows it is not read), or None."""
    m = _CLAUSE.match(text.strip())
    if not m:
        return None
    value = m[4].strip()
    if len(value) > 1 and value[0] == value[-1] == '"':
        value = value[1:-1].replace('\\"', '"')
    return Clause(m[1], m[2], m[3], value)


def parse_filter(text: str | None) -> list[Clause]:
    """Clauses joined by AND. One that can't be read is left out: it holds for everything."""
    parts = re.split(r"\s+AND\s+", text or "", flags=re.I)
    return [c for c in map(parse_clause, parts) if c]


def condition(clause: Clause, request: Column) -> Column:
    """A clause over request_like(). Upper-case names are read but name no field, so their value is empty. A pattern that
    is none is not found anywhere; it is checked on the driver, so no task fails."""
    if clause.namespace == "resp":
        return F.lit(True)
    known = clause.namespace == "req" and clause.field in ("host", "path", "url", "method")
    raw = request.getField(clause.field) if known else F.lit("")
    value = clause.value
    if clause.op in ("regex", "nregex", "like", "nlike"):
        like = clause.op.endswith("like")
        pattern = checked("^" + value.replace(".", "\\.").replace("%", ".*").replace("_", ".") + "$" if like else value)
        hit = F.lit(False) if pattern is None else raw.rlike(pattern)
        return ~hit if clause.op.startswith("n") else hit
    tests = {"eq": raw == value, "ne": raw != value, "cont": raw.contains(value), "ncont": ~raw.contains(value)}
    return tests.get(clause.op, F.lit(True))


def matches_filter(url: Column | str, query: str | None, method: Column | str = None) -> Column:
    """Whether a request passes the filter. A blank filter passes all, an invalid URL passes none but that."""
    if not (query or "").strip():
        return F.lit(True)
    clauses = parse_filter(query)

    def test(r: Column) -> Column:
        out = r.isNotNull()
        for c in clauses:
            out = out & condition(c, r)
        return out

    return F.coalesce(let(request_like(url, method), test), F.lit(False))


# -- scopes --------------------------------------------------------------------------------------------------------


def _scope(link: Column | str, base: Column | str, part) -> Column:
    both = F.struct(parse(link).alias("a"), parse(base).alias("b"))
    return let(both, lambda x: F.when(x.b.isNull(), True).otherwise(F.coalesce(part(x.a) == part(x.b), F.lit(False))))


def same_domain(link: Column | str, base: Column | str) -> Column:
    """Equal last two labels of the host. An invalid base lets all links through, an invalid link none."""
    return _scope(link, base, lambda p: root_domain(p.host))


def same_hostname(link: Column | str, base: Column | str) -> Column:
    return _scope(link, base, lambda p: p.host)


def same_origin(link: Column | str, base: Column | str) -> Column:
    return _scope(link, base, origin_of)


def in_strategy(link: Column | str, base: Column | str, strategy: str | None = None, same_domain_only: bool = True) -> Column:
    """same-domain, same-hostname, same-origin; or all, which same_domain_only narrows to the first."""
    tests = {"same-domain": same_domain, "same-hostname": same_hostname, "same-origin": same_origin}
    if strategy in tests:
        return tests[strategy](link, base)
    return same_domain(link, base) if same_domain_only else F.lit(True)


# -- routes --------------------------------------------------------------------------------------------------------


def glob_pattern(glob: str) -> str:
    """A glob as a pattern of the whole URL: * stops at a slash, ** does not, ? is one character."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        else:
            out.append({"*": "[^/]*", "?": "."}.get(c) or (c if c.isalnum() or c in "/_-:=&%#~@!,;'\" " or ord(c) > 127 else "\\" + c))
        i += 1
    return "(?i)^" + "".join(out) + ("" if glob.endswith("$") else "\\z")  # one that ends in $ is open at its end


@dataclass
class Router:
    """Names of handlers by label, then by the first pattern in order of registration, then by default."""

    labels: dict[str, str] = field(default_factory=dict)
    patterns: list[tuple[str, str]] = field(default_factory=list)
    default: str | None = None

    def label(self, label: str, handler: str) -> Router:
        self.labels.setdefault(label, handler)
        return self

    def glob(self, glob: str, handler: str) -> Router:
        self.patterns.append((glob_pattern(glob), handler))
        return self

    def regex(self, pattern: str, handler: str) -> Router:
        """A pattern in the web's syntax, after (?i) where case does not matter; ValueError where it is none."""
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        made = checked(pattern.removeprefix(flag))
        if made is None:
            raise ValueError(f"not a pattern: {pattern}")
        self.patterns.append((flag + made, handler))
        return self

    def otherwise(self, handler: str) -> Router:
        self.default = handler
        return self

    def remove(self, handler: str) -> Router:
        self.labels = {k: v for k, v in self.labels.items() if v != handler}
        self.patterns = [p for p in self.patterns if p[1] != handler]
        return self

    def clear(self) -> Router:
        self.labels, self.patterns, self.default = {}, [], None
        return self

    def __len__(self) -> int:
        return len(self.labels) + len(self.patterns)

    def route(self, url: Column | str, label: Column | str = None) -> Column:
        by_label = F.lit(None).cast("string")
        if label is not None and self.labels:
            by_label = F.element_at(F.create_map(*[F.lit(x) for kv in self.labels.items() for x in kv]), col(label))
        by_url = F.lit(self.default).cast("string")
        for pattern, handler in reversed(self.patterns):
            by_url = F.when(col(url).rlike(pattern), F.lit(handler)).otherwise(by_url)
        return F.coalesce(by_label, by_url)


# -- kinds of URLs, responses and records ---------------------------------------------------------------------------


def url_class(url: Column | str, name: str) -> Column:
    return col(url).rlike("(?i)" + P.URL_CLASSES[name])


def matches_any(url: Column | str, patterns: Sequence[str]) -> Column:
    """Whether one of these patterns, in the web's syntax, is found; (?i) may come first, and \\z is the end, as $ is. What is
    no pattern is found nowhere."""
    made = [(p.startswith("(?i)"), checked(p.removeprefix("(?i)").replace(r"\z", "$"))) for p in patterns]
    return _any_of(url, [("(?i)" if flag else "") + p for flag, p in made if p is not None])


def _any_of(url: Column | str, patterns: Sequence[str]) -> Column:
    return col(url).rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def is_resource_url(url: Column | str) -> Column:
    """By the end of the whole URL, so a query hides an extension."""
    return _any_of(url, ["(?i)" + P.URL_CLASSES[c] for c in P.RESOURCE_CLASSES])


def is_page_url(url: Column | str) -> Column:
    """No dot in the path, or a path that ends in a slash, or a page's extension; null where the URL is invalid."""
    pages = _any_of(url, ["(?i)" + P.URL_CLASSES[c] for c in P.PAGE_CLASSES])
    return let(parse(url), lambda p: F.when(p.isNotNull(), ~p.path.contains(".") | p.path.endswith("/") | pages))


def is_static_resource(path: Column | str) -> Column:
    return F.lower(col(path)).rlike("(" + "|".join(re.escape(x) for x in P.STATIC_EXTENSIONS) + ")\\z")


def is_success(status: Column | str) -> Column:
    return col(status).between(200, 299)


def should_retry(status: Column | str) -> Column:
    return (col(status) >= 500) | col(status).isin(429, 408)


def is_html(content_type: Column | str) -> Column:
    return F.lower(col(content_type)).contains("text/html")


def is_json(content_type: Column | str) -> Column:
    t = F.lower(col(content_type))
    return t.contains("application/json") | t.contains("+json")


def is_xml(content_type: Column | str) -> Column:
    t = F.lower(col(content_type))
    return t.contains("application/xml") | t.contains("text/xml") | t.contains("+xml")


def can_retry(retry_count: Column | str, max_retries: Column | str, no_retry: Column | str) -> Column:
    return ~col(no_retry) & (col(retry_count) < col(max_retries))


def remaining_retries(retry_count: Column | str, max_retries: Column | str) -> Column:
    return F.greatest(F.lit(0), col(max_retries) - col(retry_count))


def retry_delay(retry_count: Column | str, base: float = 1000, most: float = 30_000, jitter: float | Column = 0.0) -> Column:
    """Delay in ms before a retry; jitter is 0 to 0.3 of it (give F.rand(seed) * 0.3 for a random one)."""
    share = F.lit(jitter) if isinstance(jitter, int | float) else jitter
    return F.least(base * F.pow(F.lit(2.0), col(retry_count)) * (1 + share), F.lit(float(most)))


def in_scope(host: Column | str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """Hosts that a glob of allow takes (all, if there is none) and no glob of deny."""
    yes = _any_of(host, [glob_pattern(g) for g in allow]) if allow else F.lit(True)
    return yes & ~_any_of(host, [glob_pattern(g) for g in deny])


def host_is(url: Column | str, host: str) -> Column:
    return url_host(url) == host.lower()
