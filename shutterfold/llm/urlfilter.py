"""URL filters with redirect equivalence, in DataFrame operations only.

Rules are (host, path, action): a rule fits its host and all subdomains when
the path of the url starts with the rule's, and the longest rule wins.  Urls
that redirects or canonical links tie together are aliases (on request also
urls of one normal form); connected components over those edges spread block
decisions to aliases that no rule decides.  An explicit allow anywhere in a component takes
precedence over its blocks there; a url's own rule always stands.

A url without ``://`` or a null one has an empty host and path, fits no rule,
has no alias and is allowed.  Null html has no tags.  Repeated urls are
decided once and alike; repeated pages stay.  Ties between rules of one length
go to the longer host, then to allow.  Empty tables of pages, rules or edges
are fine.  Other columns pass through; ``host``, ``path``, ``rule`` and
``verdict`` are replaced where they exist.  Very long pages are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a visit, not a page.
VISIT_PARAMETERS = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def normal_form(url: Column) -> Column:
    """The url without scheme, mirror host, visit parameters, fragment and closing slash; null where there is no ``://``."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{VISIT_PARAMETERS}(=|$)"))
    bare = F.regexp_replace(host, r"^(www|m)\.(?=.)", "")
    joined = F.concat(bare, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, joined)


def _without_dots(path: Column) -> Column:
    """The path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    taken = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(taken, "/"), F.when(last.isin(".", "..") & (F.size(taken) > 0), "/").otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """The full url that ``target`` names on the page ``base``.

    A target with ``://`` stands as it is.  ``//host/x``, ``/x``, ``x``, ``?q``
    and ``#f`` are taken from the base's scheme, host, directory, path and
    query; null for an empty target, one of another scheme (``mailto:``), or
    one that is relative to a base without ``://``.
    """
    scheme = F.regexp_extract(base, r"^([^/?#]*?)://", 1)
    host = F.regexp_extract(base, r"^[^/?#]*?://([^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[^/?#]*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    site = F.concat(scheme, F.lit("://"), host)
    own, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    directory = F.regexp_extract(path, r"^.*/", 0)
    below = F.concat(F.when(directory == "", "/").otherwise(directory), own)
    return (
        F.when(target.rlike(r"^[^/?#]*://"), target)
        .when((target == "") | (scheme == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, _without_dots(own), rest))
        .when(target.startswith("?"), F.concat(site, path, target))
        .when(target.startswith("#"), F.concat(site, path, query, target))
        .otherwise(F.concat(site, _without_dots(below), rest))
    )


def page_edges(pages: DataFrame, url: str = "url", html: str = "html", normal_forms: bool = False) -> DataFrame:
    """``src, dst``: all canonical links and refresh redirects of the pages, relative ones resolved; with ``normal_forms`` also every named url and its own."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    goes = F.concat(
        F.coalesce(F.transform(links, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)), F.array().cast("array<string>")),
        F.coalesce(F.transform(metas, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)), F.array().cast("array<string>")),
    )
    targets = F.transform(F.array_distinct(goes), lambda x: resolved(x, F.col(url)))
    named = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("src"), F.filter(targets, lambda x: x.isNotNull()).alias("goes"))
    links = named.select("src", F.explode("goes").alias("dst"))
    if not normal_forms:
        return links
    urls = named.select("src").unionByName(links.select(F.col("dst").alias("src"))).distinct()
    forms = urls.select("src", F.concat(F.lit("form:"), normal_form(F.col("src"))).alias("dst")).where("dst is not null")
    return links.unionByName(forms)


def rule_decisions(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``url, rule, action``: the winning rule of each url that one fits."""
    host, path = host_and_path(F.col(url))
    parts = F.split("host", r"\.")
    split = urls.select(F.col(url).alias("url"), host.alias("host"), path.alias("path")).where("host <> ''")
    names = split.select(
        "url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name")
    )
    fits = names.join(rules.select(F.col("host").alias("name"), F.col("path").alias("rule_path"), "action"), "name").where("startswith(path, rule_path)")
    rank = F.struct((F.length("name") + F.length("rule_path")).alias("n"), F.length("name").alias("h"), (F.col("action") == "allow").alias("w"))
    best = fits.groupBy("url").agg(F.max(F.struct(rank.alias("rank"), F.concat("name", "rule_path").alias("rule"), "action")).alias("best"))
    return best.select("url", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url: str = "url") -> DataFrame:
    """The pages with ``host, path, rule, verdict`` and the component's explicit decisions taken into account."""
    members = connected_components(edges)
    urls = pages.select(F.col(url).alias("url")).unionByName(members.select(F.col("node").alias("url"))).where("instr(url, '://') > 0").distinct()
    decided = rule_decisions(urls, rules)
    of_component = (
        members.join(decided, members["node"] == decided["url"])
        .groupBy("component")
        .agg(F.max((F.col("action") == "allow").cast("int")).alias("allows"), F.max((F.col("action") == "block").cast("int")).alias("blocks"))
    )
    spread = members.join(of_component, "component").select(F.col("node").alias("__node"), F.when((F.col("blocks") == 1) & (F.col("allows") == 0), "block").otherwise("allow").alias("__spread"))
    own = decided.select(F.col("url").alias("__url"), F.col("rule").alias("__rule"), F.col("action").alias("__action"))
    host, path = host_and_path(F.col(url))
    joined = pages.join(own, F.col(url) == F.col("__url"), "left").join(spread, F.col(url) == F.col("__node"), "left")
    judged = joined.withColumns({"host": host, "path": path, "rule": F.col("__rule"), "verdict": F.coalesce("__action", "__spread", F.lit("allow"))})
    return judged.drop("__rule", "__action", "__url", "__node", "__spread")
