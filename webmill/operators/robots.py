"""robots.txt files as tables of rules, and URLs judged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webmill.functions.patterns import ROBOTS_LITERAL
from webmill.functions.predicates import is_success
from webmill.functions.urls import ascii_lower, path_and_query, trim_ws, unique_key, url_host
from webmill.sources.tables import fetch


def directives(files: DataFrame) -> DataFrame:
    """(host, line_no, directive, value, grp) of robots files (host, body). grp counts groups of agents: one begins at
    a user-agent line that follows a rule. Rules without a value don't count, so agents before them stay in the group."""
    lines = files.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
    text = trim_ws(F.regexp_extract("line", r"(?s)^([^#]*)", 1))
    lines = lines.select("host", "line_no", text.alias("t")).filter(F.col("t").contains(":"))
    lines = lines.select("host", "line_no", F.lower(trim_ws(F.substring_index("t", ":", 1))).alias("directive"), trim_ws(F.regexp_extract("t", r"(?s)^[^:]*:(.*)\z", 1)).alias("value"))
    lines = lines.filter(F.col("directive").isin("user-agent", "allow", "disallow", "sitemap", "crawl-delay"))
    w = Window.partitionBy("host").orderBy("line_no")
    is_rule = F.when(F.col("directive").isin("allow", "disallow") & (F.col("value") != ""), True).when(F.col("directive") == "user-agent", False)
    after_rule = F.last(is_rule, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("new", ((F.col("directive") == "user-agent") & F.coalesce(after_rule, F.lit(False))).cast("int"))
    return lines.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def pattern(value: Column) -> Column:
    return F.when(value.startswith("/") | value.startswith("*"), value).otherwise(F.concat(F.lit("/"), value))


def rules(files: DataFrame) -> DataFrame:
    """(host, rule_no, user_agent, allow, pattern, pattern_no): a rule for each agent of a group, in order."""
    lines = directives(files)
    agents = lines.filter("directive = 'user-agent'").select("host", "grp", F.col("line_no").alias("rule_no"), F.lower("value").alias("user_agent"))
    paths = lines.filter("directive IN ('allow', 'disallow') AND value <> ''").select("host", "grp", (F.col("directive") == "allow").alias("allow"), pattern(F.col("value")).alias("pattern"), F.col("line_no").alias("pattern_no"))
    return agents.join(paths, ["host", "grp"]).select("host", "rule_no", "user_agent", "allow", "pattern", "pattern_no")


def sitemaps(files: DataFrame) -> DataFrame:
    return directives(files).filter("directive = 'sitemap' AND value <> ''").select("host", F.col("line_no").alias("n"), F.col("value").alias("url"))


def agent_matches(rule_agent: Column, user_agent: Column) -> Column:
    """* or a part of our name, whatever its case."""
    return (rule_agent == "*") | F.contains(F.lower(user_agent), F.lower(rule_agent))


def crawl_delays(files: DataFrame, user_agent: str) -> DataFrame:
    """(host, delay_s, delay_ms): the last delay given to agents of which one is ours."""
    lines = directives(files)
    w = Window.partitionBy("host", "grp").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ours = F.max(F.when(F.col("directive") == "user-agent", agent_matches(F.col("value"), F.lit(user_agent)))).over(w)
    number = F.regexp_extract("value", r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    given = lines.withColumn("ours", ours).withColumn("delay_s", number).filter("directive = 'crawl-delay' AND delay_s >= 0 AND ours")
    return given.groupBy("host").agg(F.max_by("delay_s", "line_no").alias("delay_s")).withColumn("delay_ms", F.col("delay_s") * 1000)


def pattern_regex(value: Column) -> Column:
    """A pattern as a regular expression: * is anything; one that ends in $ is bound at its end only, others at their
    beginning only."""
    escaped = F.regexp_replace(F.regexp_replace(value, ROBOTS_LITERAL, r"\\$1"), r"\*", ".*")
    inner = lambda x: F.regexp_replace(x, r"\$(?!\z)", r"\\z")
    bound = F.when(escaped.endswith("$"), F.concat(inner(F.regexp_replace(escaped, r"\$\z", "")), F.lit("\\z"))).otherwise(F.concat(F.lit("^"), inner(escaped)))
    return F.concat(F.lit("(?is)"), bound)


def path_matches(path: Column, value: Column) -> Column:
    return value.isin("", "/") | F.rlike(path, pattern_regex(value))


def specificity(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\*", ""))


def index(files: DataFrame, user_agent: str) -> DataFrame:
    """(host, prefix, literal, wild) of the rules that apply to us, by what a path that they match begins with.

    literal: the verdict of the rules that ask for nothing more, the strongest of them; wild: pattern and verdict of each
    that does. Verdicts are ordered: the longest pattern counts, of equal ones the first, in one rule disallow before
    allow. Rules that name us exclude those for *. A host has no more rows than its file has rules.
    """
    found = rules(files.filter("fetch_ok") if "fetch_ok" in files.columns else files)
    found = found.withColumn("specific", F.col("user_agent") != "*").filter(~F.col("specific") | F.contains(F.lit(user_agent.lower()), F.col("user_agent")))
    best = found.groupBy("host").agg(F.max("specific").alias("best")).withColumnRenamed("host", "h")
    found = found.join(best, (F.col("host") == F.col("h")) & (F.col("specific") == F.col("best")))
    value = F.col("pattern")
    everything = value.isin("", "/")
    literal = everything | ~value.rlike(r"[*$]")
    prefix = F.when(everything | value.endswith("$"), "").otherwise(ascii_lower(F.regexp_extract(value, r"(?s)^([^*$]*)", 1)))
    verdict = F.struct(specificity(value).alias("spec"), (-F.col("rule_no")).alias("rule"), (~F.col("allow")).cast("int").alias("kind"), (-F.col("pattern_no")).alias("place"), "allow")
    found = found.select("host", prefix.alias("prefix"), literal.alias("literal"), F.struct(pattern_regex(value).alias("re"), verdict.alias("verdict")).alias("rule"))
    return found.groupBy("host", "prefix").agg(F.max(F.when(F.col("literal"), F.col("rule.verdict"))).alias("literal"), F.collect_list(F.when(~F.col("literal"), F.col("rule"))).alias("wild"))


def is_allowed(urls: DataFrame, files: DataFrame, user_agent: str, url_col: str = "url") -> DataFrame:
    """urls with `allowed`. Without a file, a matching rule or a readable file everything is allowed. URLs are judged once
    each, however often they occur.

    A path meets the rules that begin as it does: it is spread to its beginnings of those lengths that its host's rules
    have, and these are join keys. Only rules with wildcards are searched for in it. The joins exchange both sides, so a
    hot host's URLs may be split.
    """
    by_prefix = index(files, user_agent)
    lengths = by_prefix.groupBy(F.col("host").alias("_k")).agg(F.collect_set(F.length("prefix")).alias("_n"))
    path = F.coalesce(path_and_query("_u"), F.col("_u"))
    distinct = urls.select(F.col(url_col).alias("_u")).filter("_u IS NOT NULL").distinct().select("_u", url_host("_u").alias("_h"), path.alias("_p"))
    met = distinct.join(lengths, F.col("_h") == F.col("_k")).withColumn("_low", ascii_lower(F.col("_p")))
    met = met.select("_u", "_h", "_p", F.explode(F.transform(F.filter("_n", lambda n: n <= F.length("_p")), lambda n: F.substring(F.col("_low"), F.lit(1), n))).alias("_b"))
    met = met.join(by_prefix, (F.col("_h") == F.col("host")) & (F.col("_b") == F.col("prefix")))
    wild = F.transform(F.filter("wild", lambda w: F.rlike(F.col("_p"), w.re)), lambda w: w.verdict)
    verdict = met.groupBy("_u").agg(F.max(F.array_max(F.concat(F.array("literal"), wild))).alias("_v"))
    return urls.join(verdict, F.col(url_col) == F.col("_u"), "left").withColumn("allowed", F.coalesce("_v.allow", F.lit(True))).drop("_u", "_v")


def look_up(hosts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(host, body, fetch_ok): the robots file of each of these distinct hosts as a corpus has it, at https."""
    wanted = hosts.select("host", unique_key(F.concat(F.lit("https://"), F.col("host"), F.lit("/robots.txt"))).alias("unique_key"))
    found = fetch(wanted, corpus)
    ok = F.coalesce(is_success("status") & F.col("html").isNotNull(), F.lit(False))
    return found.select("host", F.when(ok, F.col("html")).alias("body"), ok.alias("fetch_ok"))


def new_hosts(urls: DataFrame, known: DataFrame | None, url_col: str = "url") -> DataFrame:
    """(host): hosts of the URLs whose robots file was not looked up yet."""
    hosts = urls.select(url_host(url_col).alias("host")).filter("host IS NOT NULL").distinct()
    return hosts if known is None else hosts.join(known.select("host"), "host", "left_anti")
