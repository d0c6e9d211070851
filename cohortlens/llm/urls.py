"""URL filter rules, carried over redirects and canonical links.

Every URL is judged by the longest rule that fits its host and path.  URLs without a rule of their own take the decision of
their aliases: redirects and canonical links are edges, connected components of the edges are sets of aliases, and a
component in which some URL is explicitly allowed is allowed, else one in which some URL is blocked is blocked.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule, no aliases, verdict allow; a URL of
any length is read whole; among fitting rules of equal length allow wins, then the longer host; repeated pages are judged
row by row; null endpoints of edges are dropped; without rules, pages or edges nothing is blocked by them; other columns of
the pages pass untouched unless they are named host, path, rule or verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortlens.llm.components import components
from cohortlens.llm.shared import written

#: Query parameters that do not tell pages apart.
TRACKING = ("utm_[a-z]+", "fbclid", "gclid")
RESULTS = ("host", "path", "rule", "verdict")
PARTS = 32
TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """What tells URLs apart: host, path and query, without scheme, fragment, default port and tracking parameters."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(asked, "&"), lambda x: ~x.rlike(f"(?i)^({'|'.join(TRACKING)})(=|$)") & (x != "")), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(url.contains("://"), F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)


def _value(attribute: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(attribute, r"(?s)^[^=]*=\s*", "")), r"""^["']|["']$""", "")


def resolved(target: Column, base: Column) -> Column:
    """A link as an absolute URL; its dot segments are walked, a link to another scheme than a web one is null."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    full = (
        F.when(target.rlike("(?i)^https?://"), target)
        .when(target.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path_of(base), target))
        .when((target == "") | target.startswith("#"), None)
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )
    steps = F.aggregate(
        F.split(path_of(full), "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    walked = F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), F.array_join(steps, "/"), F.regexp_extract(full, r"(?s)^.*?://[^?#]*([?#].*)?$", 1))
    return F.when(path_of(full).rlike(r"/\.\.?(/|$)"), walked).otherwise(full)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) URLs of the canonical links and refresh redirects that the pages themselves state."""
    tags = F.filter(F.regexp_extract_all(F.col(html), F.lit(TAG), F.lit(0)), lambda x: x.rlike(r"(?i)canonical|refresh|og:url"))
    tag = pages.where(F.col(html).rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh|og:url)")).select(F.col(url).alias("source"), F.explode(tags).alias("tag"))
    rel, equiv, prop = (F.lower(_value(_attribute(F.col("tag"), a))) for a in ("rel", "http-equiv", "property"))
    stated = (
        F.when(rel.rlike(r"(^|\s)canonical(\s|$)"), _value(_attribute(F.col("tag"), "href")))
        .when(equiv == "refresh", F.regexp_extract(_value(_attribute(F.col("tag"), "content")), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?(.*?)["']?\s*$""", 1))
        .when(prop == "og:url", _value(_attribute(F.col("tag"), "content")))
    )
    plain = F.trim(F.replace(stated, F.lit("&amp;"), F.lit("&")))
    return tag.where(stated.isNotNull()).select("source", resolved(plain, F.col("source")).alias("target")).where("target IS NOT NULL")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, host, path) rows from (verdict, ``host/path``) pairs."""
    frame = spark.createDataFrame(rules, "verdict string, rule string")
    cut = F.instr("rule", "/")
    host = F.when(cut > 0, F.substring(F.col("rule"), F.lit(1), cut - 1)).otherwise(F.col("rule"))
    return frame.select("verdict", F.lower(host).alias("host"), F.substring(F.col("rule"), F.length(host) + 1, F.length("rule")).alias("path"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, _rules): for each distinct host, the rules of itself and its parent domains, joined on domain names.

    No more parent domains are made than the longest host among the rules has labels.
    """
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    names = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    domain = hosts.where("host <> ''").select("host").distinct().select("host", F.explode(domains).alias("domain"))
    one = F.struct(F.length(F.concat("r.host", "r.path")).alias("size"), (F.col("verdict") == "allow").alias("allow"), F.length("r.host").alias("host_size"),
                   F.concat("r.host", "r.path").alias("rule"), F.col("r.path").alias("path"), F.col("verdict"))
    found = domain.join(rules.alias("r"), F.col("domain") == F.col("r.host")).select(domain["host"], one.alias("one"))
    return found.groupBy("host").agg(F.collect_list("one").alias("_rules"))


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with rule and verdict of the longest rule that fits, else null.

    A host may have a third of all URLs, so the URLs of a host are dealt over ``PARTS`` parts by their path, and its row of
    rules, there for hosts with rules only, is there once a part.
    """
    best = F.array_max(F.filter("_rules", lambda r: F.col("path").startswith(r["path"])))
    known = host_rules(urls, rules).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    out = urls.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")).join(known, ["host", "_part"], "left").withColumn("_best", best)
    return out.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.col("_best.verdict")).drop("_rules", "_best", "_part")


def alias_decisions(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, decision) of every URL that has an alias and whose component holds a rule; ``edges``: keys a and b."""
    parts = written(components(edges), "aliases")
    split = F.instr("id", "/")
    urls = parts.select("id", "root", F.substring(F.col("id"), F.lit(1), split - 1).alias("host"), F.regexp_extract(F.substring(F.col("id"), split, F.length("id")), r"(?s)^([^?]*)", 1).alias("path"))
    judged = with_rule(urls, rules).where("verdict IS NOT NULL")
    least = F.min(F.col("verdict"))  # allow comes before block
    return parts.join(judged.groupBy("root").agg(least.alias("decision")), "root").select(F.col("id").alias("key"), "decision")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``redirects`` (source, target URLs), such as a crawl log gives them, joins the links that the pages state.  A page's own
    rule stands whatever its aliases are.  Only URLs at the ends of edges take part in the components.
    """
    links = page_links(pages, url, html) if html in pages.columns else None
    if redirects is not None:
        given = redirects.select("source", "target")
        links = given if links is None else links.unionByName(given)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(f"`{url}`").alias("url"))
    judged = with_rule(rows.select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key")), rules)
    if links is not None:
        edges = links.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        alias = F.when(F.col("rule").isNull(), F.col("key"))
        judged = judged.withColumn("key", alias).join(alias_decisions(edges, rules), "key", "left").withColumn("verdict", F.coalesce("verdict", "decision"))
    own = [F.col(f"page.`{c}`") for c in pages.columns if c not in RESULTS]
    return judged.select(*own, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
