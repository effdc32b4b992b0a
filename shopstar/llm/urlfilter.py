"""URL filters: host and path rules, and block decisions that reach a page's aliases.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's path; the longest fitting rule decides.  Pages without a
rule take part in redirect equivalence: urls are nodes, redirect pages (``meta
refresh``) and canonical links are edges, and the connected components over
them are aliases of one page.  A block by rule reaches every alias in its
component; a page with an allow rule of its own stays allowed (explicit allow
takes precedence), and so does everything that no block reaches.

Cases: a null url, or one without ``://``, has empty host and path, no rule and
no aliases, and is allowed; null html has no links; repeated rows get a row
each; all canonical and refresh tags of a page count, outside comments, scripts
and styles; attributes are read by name, quoted or not, ``rel`` by its words and
values with their character references decoded; relative links (also
``next.html``, ``../a`` and ``?p=1``) are resolved against the page's ``base``, or
its url, links of other schemes (``mailto:``) and bare fragments lead to no page;
very long pages are read whole; a tag with more than 300 quoted values is no tag;
an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopstar.llm.common import cut, lower_ascii, small
from shopstar.llm.components import connected_components

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# What holds no tags of the page, tags, the attributes of a tag, and a refresh value.
SKIPPED = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
TAG = r"(?is)<(link|meta|base)((?:\s[^'\">]*)(?:(?:\"[^\"]*\"|'[^']*')[^'\">]*){0,300})>"
ATTRIBUTE = r"(?is)([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?"
REFRESH = r"(?is)^\s*(?:[0-9.]+\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(.*)$"
QUOTED = r"(?is)^(?:\"([^\"]*).*|'([^']*).*|([^\"'].*))$"
NUMBERED = r"(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
RULES_LIMIT = 10_000  # more rules than this join by shuffle instead of broadcast


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without its fragment, host in lower case; null where there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path from the root on, its ``.`` and ``..`` segments resolved."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), lambda done, x: (
        F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done)
        .otherwise(F.concat(done, F.array(x)))))
    ends = last.isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))


def _resolve(link: Column, url: Column) -> Column:
    """The absolute form of a link on the page ``url``; null for other schemes and bare fragments."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    path, rest = (F.regexp_extract(link, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    own = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    at = (F.when(link.startswith("/"), _without_dots(path)).when(path == "", own).otherwise(_without_dots(F.concat(folder, path))))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None))
            .otherwise(F.concat(scheme, F.lit("://"), host_of(url), at, rest)))


def _decoded(value: Column) -> Column:
    """The value with numeric references and those of the markup characters decoded."""
    def code(ref: Column) -> Column:
        hexadecimal = F.lower(F.substring(ref, 1, 1)) == "x"
        return F.when(hexadecimal, F.conv(F.substring(ref, 2, 6), 16, 10)).otherwise(ref).cast("bigint")

    def put(text: Column, ref: Column) -> Column:
        n = code(ref)
        known = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(known, n).otherwise(0x20)), 8, "0")), "UTF-32")
        return F.when(known, F.replace(text, F.concat(F.lit("&#"), ref, F.lit(";")), char)).otherwise(text)

    out = F.aggregate(F.array_distinct(F.regexp_extract_all(value, F.lit(NUMBERED), F.lit(1))), value, put)
    for name, char in NAMED:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(value.contains("&"), out).otherwise(value)


def _attributes(rest: Column) -> tuple[Column, Column]:
    """Names in lower case and decoded values of a tag's attributes."""
    parts = [F.regexp_extract_all(rest, F.lit(ATTRIBUTE), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)]
    values = F.transform(F.arrays_zip(*parts[1:]), lambda v: _decoded(F.concat(v["g2"], v["g3"], v["g4"])))
    return F.transform(parts[0], lower_ascii), values


def _value(tag: Column, name: str) -> Column:
    """The first attribute of that name in a tag; null if there is none."""
    return F.get(tag["values"], F.array_position(tag["names"], name).cast("int") - 1)


def _refresh_link(content: Column) -> Column:
    rest = F.trim(F.regexp_extract(content, REFRESH, 1))
    return F.concat(*[F.regexp_extract(rest, QUOTED, g) for g in (1, 2, 3)])


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): url nodes joined by a canonical link or a redirect."""
    html, url = F.col(html_col), F.col(url_col)
    # the cheap test first: most pages carry neither tag
    tagged = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(url.alias("url"), F.regexp_replace(html, SKIPPED, " ").alias("html"))
    kinds, rest = (F.regexp_extract_all("html", F.lit(TAG), F.lit(g)) for g in (1, 2))
    parsed = F.transform(F.arrays_zip(kinds.alias("kind"), rest.alias("rest")), lambda t: F.struct(
        lower_ascii(t["kind"]).alias("kind"), *[c.alias(n) for c, n in zip(_attributes(t["rest"]), ("names", "values"), strict=True)]))
    tags = F.transform(parsed, lambda t: F.struct(
        t["kind"].alias("kind"), F.trim(_value(t, "href")).alias("href"),
        F.split(lower_ascii(F.trim(F.coalesce(_value(t, "rel"), F.lit("")))), r"\s+").alias("rel"),
        F.when(lower_ascii(F.trim(_value(t, "http-equiv"))) == "refresh", _refresh_link(_value(t, "content"))).alias("refresh")))
    page = tagged.select("url", tags.alias("tags"))
    base = F.get(F.filter("tags", lambda t: (t["kind"] == "base") & t["href"].isNotNull()), F.lit(0))["href"]
    canonical = F.transform(F.filter("tags", lambda t: (t["kind"] == "link") & F.array_contains(t["rel"], "canonical")), lambda t: t["href"])
    refresh = F.transform(F.filter("tags", lambda t: t["kind"] == "meta"), lambda t: F.trim(t["refresh"]))
    links = page.select("url", F.coalesce(_resolve(base, F.col("url")), F.col("url")).alias("at"), F.explode(F.concat(canonical, refresh)).alias("link"))
    links = links.where("link <> ''")
    ends = links.select(node_of(F.col("url")).alias("a"), node_of(_resolve(F.col("link"), F.col("at"))).alias("b"))
    return ends.where("a is not null and b is not null and a <> b")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, decision): the longest rule for each distinct host and path that has one.

    ``rules``: host, path, decision.  A host meets the rules by its suffixes (as many as it has labels).
    """
    n = rules.count()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    by_suffix = places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("__suffix"))
    r = rules.select(lower_ascii(F.col("host")).alias("__suffix"), F.col("path").alias("__rule_path"), "decision")
    hit = by_suffix.join(small(r, n, RULES_LIMIT), "__suffix").where(F.col("path").startswith(F.col("__rule_path")))
    rule = F.concat("__suffix", "__rule_path")
    # of two equal rules that disagree, allow wins
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("decision") == "allow").alias("allow"), rule.alias("rule")))
    return (hit.groupBy("host", "path").agg(best.alias("__best"))
            .select("host", "path", "__best.rule", F.when(F.col("__best.allow"), "allow").otherwise("block").alias("decision")))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, component): one row a page; ``component`` is null without aliases.

    ``redirects`` (optional): further edges as urls ``from_url``, ``to_url``.
    """
    url = F.col(url_col)
    at = cut(pages.select(url.alias("url")).distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")))
    ruled = match_rules(at.select("host", "path").distinct(), rules)
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    roots = cut(connected_components(edges, "a", "b"))
    # an alias that is no page itself still carries the decision of its own rule
    by_node = roots.select(F.col("node").alias("url"), "root").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    known = match_rules(by_node.select("host", "path").distinct(), rules)
    blocked = (by_node.join(known.where("decision = 'block'"), ["host", "path"]).select("root").distinct()
               .withColumn("__blocked", F.lit(True)))
    members = roots.join(blocked, "root", "left").select("node", F.col("root").alias("component"), "__blocked")
    told = at.join(ruled, ["host", "path"], "left").join(members, "node", "left")
    verdict = F.coalesce("decision", F.when(F.col("__blocked"), "block"), F.lit("allow"))
    by_url = told.select(F.col("url").alias("__url"), "host", "path", "rule", verdict.alias("verdict"), "component")
    rows = pages.select(F.col(id_col).alias("__id"), url.alias("__page_url"))
    return (rows.join(by_url, F.col("__page_url").eqNullSafe(F.col("__url")), "left")
            .select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict", "component"))
