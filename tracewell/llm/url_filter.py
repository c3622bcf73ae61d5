"""URL filters with redirect equivalence (operator 6).

Pages that redirect to each other, or name each other as canonical, are aliases. The links
are taken from the pages themselves (all canonical link elements and refresh redirects, relative ones too);
components over them are found by ``connected_components``. A block decision of any address in
a component holds for all its aliases, but an address that a rule allows stays allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import connected_components
from tracewell.llm.shared import keep


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Elements that may name an alias or the base of relative addresses; attributes are read in any order.
_ELEMENT = r"(?i)<(?:link|meta|base)\b[^>]*"
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^\s"'>]+))""")
_REFRESH = re.compile(r"""\s*[0-9.\s]*[;,]\s*url\s*=\s*(?:"([^"]*)|'([^']*)|([^"'\s>]+))""", re.I)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
_PARTS = re.compile(r"([^:/?#]+://[^/?#]*)([^?#]*)([^#]*)", re.S)


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
    return "/".join(out) + ("/" if parts[-1] in (".", "..") else "")


def resolve(base: str, target: str) -> str | None:
    """The absolute address that ``target`` means on the page ``base``; None if it names no other address."""
    if target == "" or target.startswith("#"):
        return None
    if _SCHEME.match(target):
        return target if "://" in target.split("?")[0].split("#")[0] else None
    if not (m := _PARTS.match(base)):
        return None
    host, path, query = m.groups()
    if target.startswith("//"):
        return host.split("//")[0] + target
    if target.startswith("?"):
        return host + (path or "/") + target
    end = min((i for i in map(target.find, "?#") if i >= 0), default=len(target))
    own = target[:end] if target.startswith("/") else (path.rpartition("/")[0] or "") + "/" + target[:end]
    return host + _without_dots(own) + target[end:]


def targets_of(url: str | None, elements: list[str] | None) -> list[str]:
    """Absolute targets of the canonical links and refresh redirects among a page's elements."""
    base, named = None, []
    for element in elements or ():
        found: dict[str, str] = {}
        for name, *value in _ATTR.findall(element):
            found.setdefault(name.lower(), " ".join("".join(value).split()).replace("&amp;", "&"))
        kind = element[1:5].lower()
        if kind == "base" and base is None and "href" in found:
            base = resolve(url or "", found["href"])
        elif kind == "link" and "canonical" in found.get("rel", "").lower().split() and "href" in found:
            named.append(found["href"])
        elif kind == "meta" and found.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(found.get("content", ""))):
            named.append("".join(x or "" for x in m.groups()).strip())
    return [t for n in named if (t := resolve(base or url or "", n)) is not None]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; of two equally long ones the later in host order.

    A rule's length is that of host and path together. Rules are few and become one expression.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = (host == r.host) | host.endswith("." + r.host) if r.host else F.lit(True)
        fits = fits & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def address_key(url: Column) -> Column:
    """A page's node: its address without scheme and fragment, host lower-cased; null without ``://``."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def links_of(pages: DataFrame) -> DataFrame:
    """(url, target) of all canonical links and refresh redirects, resolved against the page's address."""

    @F.arrow_udf("array<string>")
    def targets(url: pa.Array, elements: pa.Array) -> pa.Array:
        return pa.array([targets_of(u, e) for u, e in zip(url.to_pylist(), elements.to_pylist())], pa.list_(pa.string()))

    elements = F.filter(F.regexp_extract_all("html", F.lit(_ELEMENT), F.lit(0)), lambda e: e.rlike("(?i)canonical|refresh|^<base"))
    found = pages.select("url", elements.alias("elements")).where(F.exists("elements", lambda e: e.rlike("(?i)canonical|refresh")))
    return found.select("url", F.explode(targets("url", "elements")).alias("target"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judge every page: page_id, host, path, rule, verdict, one row per input row.

    pages: page_id, url, html. A url that is null or lacks ``://`` has an empty host and path and no aliases.
    Verdict: the fitting rule's; without one, block if an alias (any address in the page's component, crawled or
    not) is blocked by a rule, else allow.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    links = keep(links_of(pages).select(address_key(F.col("url")).alias("a"), address_key(F.col("target")).alias("b"), F.col("target")).where("a <> b"), "links")
    ends = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    # Nodes are 64-bit hashes of addresses in the component search.
    groups = connected_components(links.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v")), "aliases")
    node_host, node_path = F.regexp_extract("key", r"(?s)^([^/?]*)", 1), F.regexp_extract("key", r"(?s)^[^/?]*([^?]*)", 1)
    _, node_verdict = matching_rule(node_host, node_path, rules)
    blocked = ends.select(F.xxhash64("key").alias("node"), node_verdict.alias("v")).where("v = 'block'").join(groups, "node").select("component").distinct()
    tainted = groups.join(blocked, "component", "left_semi").select(F.col("node").alias("alias"), F.lit(True).alias("tainted"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64(address_key(F.col("url"))).alias("alias"))
    judged = judged.withColumns({"rule": text, "own": verdict}).join(tainted, "alias", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("tainted"), "block").otherwise("allow")).alias("verdict"))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
