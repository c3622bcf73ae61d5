"""HTML main text by inferred wrappers (operator 3).

A wrapper is a union-free regular expression over tag and text tokens: literals, text
slots, optional groups and repeated groups. The pages of a host that share a template (the
set of their elements' names, classes and ids near the top) get one: up to ``samples`` of them, of different
token streams, are aligned whole. The first page is the wrapper, and each further page is
matched against it; where they part, the mismatch becomes

* a text slot, when both sides hold different text,
* a repeated group, when the square before the mismatch occurs once more on one side,
* an optional group otherwise, up to the nearest token on which both sides agree again.

Then every page of a template is held against its wrapper: a literal text that any of them does not bear out
becomes a slot, so that a frame text is one on which all pages agree, sampled or not.

Every page is then matched against its template's wrapper. Text that falls on a literal is
frame; text in slots, repeated and optional groups, and text that the wrapper does not
know, is content. Elements whose tag, role, class or id names a menu, header, footer, sidebar,
notice, advert, form or comment are boilerplate too. What is left is the main text; if
there is an article or main element with text, that element alone, its own literals included.
Inference runs per template on its samples alone, so a host with a third of all pages costs
no more than another; matching needs no shuffle while the wrappers fit the broadcast bound,
and joins them by host and template beyond it.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import keep
from tracewell.llm.url_filter import host_of

SAMPLES = 6
#: Open elements below which an element tells templates apart.
TEMPLATE_DEPTH = 4
#: Bytes of wrappers up to which they are broadcast; more are joined by host.
BROADCAST_BYTES = 16_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*>|<\?[^>]*>|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|[^<]+|<", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object")}
# Element names of HTML and words that name boilerplate.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_DROP = frozenset("head nav header footer aside form menu button select dialog title search fieldset".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices popup modal newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead comment comments reply replies respond disqus share sharing social related recommended widget toolbar pagination pager form skip".split())
_SPACE = re.compile(r"[ \t\n\r\f\v ]+|\s+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, raw) of markup in order; kind is open, close, void or text. Comments and raw elements are skipped."""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:  # cannot happen: every character starts some token
            break
        raw, at = m.group(), m.end()
        if raw[0] != "<" or raw == "<":
            yield "text", "", raw
            continue
        name = _TAG.match(raw)
        if not name:
            continue
        name, closing = name.group(1).lower(), raw[1] == "/"
        if not closing and name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.end() if end else n
            continue
        yield ("close" if closing else "void" if name in _VOID or raw.endswith("/>") and name not in _BLOCK else "open"), name, raw


def signature(name: str, raw: str) -> str:
    """An element's name with its class and id: what wrappers compare."""
    marks = sorted(f"{k.lower()}={' '.join((a or b or c).split())}" for k, a, b, c in _ATTR.findall(raw))
    return "|".join([name, *marks])


def _words(raw: str) -> set[str]:
    out: set[str] = set()
    for k, a, b, c in _ATTR.findall(raw):
        if k.lower() in ("class", "id"):
            out |= set(re.split(r"[^a-z]+", (a or b or c).lower()))
    return out


def _dropped(name: str, raw: str, in_article: bool) -> bool:
    if name in _DROP and not (in_article and name == "header"):
        return True
    role = next((a or b or c for k, a, b, c in _ATTR.findall(raw) if k.lower() == "role"), "").lower()
    return role in _DROP_ROLES or name not in ("html", "body", "article", "main") and bool(_words(raw) & _DROP_WORDS)


def flatten(html: str | list[tuple[str, str, str]]) -> list[str]:
    """Tokens for alignment: ``<sig`` and ``>name`` for tags, ``=text`` for text. Void elements tell nothing."""
    out: list[str] = []
    for kind, name, raw in tokens(html) if isinstance(html, str) else html:
        if kind == "text":
            text = " ".join(entities.unescape(raw).split())
            if text:
                out.append("=" + text)
        elif kind != "void":
            out.append((">" if kind == "close" else "<") + (name if kind == "close" else signature(name, raw)))
    return out


def template_of(flat: list[str]) -> str:
    """Hash of the elements near the top of a page, each counted once."""
    depth, seen = 0, set()
    for token in flat:
        if token[0] == "<":
            if depth < TEMPLATE_DEPTH:
                seen.add(token)
            depth += 1
        elif token[0] == ">":
            depth = max(0, depth - 1)
    return hashlib.blake2b("\0".join(sorted(seen)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class _Places:
    """Where each token stands in a page, to find the next place of one."""

    def __init__(self, page: list[str]):
        self.at: dict[str, list[int]] = {}
        for i, token in enumerate(page):
            if token[0] != "=":
                self.at.setdefault(token, []).append(i)

    def next(self, token: str, start: int) -> int | None:
        found = self.at.get(token, ())
        i = bisect_left(found, start)
        return found[i] if i < len(found) else None

    def agree(self, items: list, i: int, start: int) -> tuple[int, int] | None:
        """(item, page place) from i and start on where both hold one tag, with the fewest tokens skipped."""
        best, skipped = None, None
        for k in range(i, len(items)):
            if skipped is not None and k - i >= skipped:
                break
            if items[k][0] == "t" and items[k][1][0] != "=" and (m := self.next(items[k][1], start)) is not None:
                cost = k - i + m - start
                if skipped is None or cost < skipped:
                    best, skipped = (k, m), cost
        return best


# A wrapper is a list of items: ["t", token], ["slot"], ["opt", items], ["rep", items].
class _Output:
    """A wrapper under construction; it knows where the last sibling of each element starts."""

    def __init__(self):
        self.items: list = []
        self.levels: list[dict[str, int]] = [{}]

    def append(self, item: list) -> None:
        if item[0] == "t" and item[1][0] == "<":
            self.levels[-1][item[1]] = len(self.items)
            self.levels.append({})
        elif item[0] == "t" and item[1][0] == ">" and len(self.levels) > 1:
            self.levels.pop()
        self.items.append(item)

    def square(self, token: str) -> int | None:
        """Where the group starts that opens with the token and ends here, if there is one."""
        start = self.levels[-1].get(token) if token[0] == "<" else None
        return start if start is not None and start < len(self.items) and self.items[start] == ["t", token] else None

    def repeat(self, start: int, group: list) -> None:
        self.items[start:] = [["rep", group]]


def _consume(items: list, page: list[str], at: int) -> int | None:
    """Where a group's occurrence that starts at ``at`` ends, if it fits."""
    for item in items:
        if item[0] == "t":
            if at >= len(page) or page[at] != item[1]:
                return None
            at += 1
        elif item[0] == "slot":
            if at < len(page) and page[at][0] == "=":
                at += 1
        elif item[0] == "opt":
            at = got if (got := _consume(item[1], page, at)) is not None else at
        else:
            while (got := _consume(item[1], page, at)) is not None and got > at:
                at = got
    return at


def align(wrapper: list, page: list[str]) -> list:
    """The wrapper generalised so that it also fits the page."""
    out, places = _Output(), _Places(page)
    own = [x[1] if x[0] == "t" else "=" for x in wrapper]  # the wrapper read as a page
    i = j = 0

    def squares(group: list, side: list[str], at: int) -> int:
        while (more := _consume(group, side, at)) is not None and more > at:
            at = more
        return at

    while i < len(wrapper) or j < len(page):
        item = wrapper[i] if i < len(wrapper) else None
        token = page[j] if j < len(page) else None
        if item is not None and item[0] == "rep":
            j = squares(item[1], page, j)
            out.append(item)
            i += 1
        elif item is not None and item[0] == "opt":
            j = got if (got := _consume(item[1], page, j)) is not None else j
            out.append(item)
            i += 1
        elif item is not None and item[0] == "slot":
            j += token is not None and token[0] == "="
            out.append(item)
            i += 1
        elif item is not None and token is not None and item[1] == token:
            out.append(item)
            i, j = i + 1, j + 1
        elif item is not None and token is not None and item[1][0] == "=" and token[0] == "=":
            out.append(["slot"])
            i, j = i + 1, j + 1
        elif token is not None and token[0] == "=" and (item is None or item[1][0] != "="):
            out.append(["slot"])  # text that only the page has
            j += 1
        elif item is not None and item[1][0] == "=":
            out.append(["slot"])
            i += 1
        else:
            # A square: the group just passed once more, on the page or in the wrapper.
            if token is not None and (start := out.square(token)) is not None:
                group = _loosen(out.items[start:])
                if (got := squares(group, page, j)) > j:
                    out.repeat(start, group)
                    j = got
                    continue
            if item is not None and (start := out.square(item[1])) is not None:
                group = _loosen(out.items[start:])
                if (got := squares(group, own, i)) > i:
                    out.repeat(start, group)
                    i = got
                    continue
            # An optional group: skip to the nearest tag on which both agree.
            k, m = places.agree(wrapper, i, j) or (len(wrapper), len(page))
            if k > i:
                out.append(["opt", wrapper[i:k]])
            if m > j:
                out.append(["opt", [["t", x] if x[0] != "=" else ["slot"] for x in page[j:m]]])
            i, j = k, m
    return out.items


def _met(wrapper: list, page: list[str]) -> list[tuple[int, int]]:
    """(item, page place) of the literal texts of a wrapper that stand in a page where the wrapper has them."""
    places, met = _Places(page), []
    i = j = 0
    while i < len(wrapper) and j < len(page):
        item = wrapper[i]
        if item[0] == "rep":
            while (got := _consume(item[1], page, j)) is not None and got > j:
                j = got
            i += 1
        elif item[0] == "opt":
            j = got if (got := _consume(item[1], page, j)) is not None else j
            i += 1
        elif item[0] == "slot":
            j += page[j][0] == "="
            i += 1
        elif item[1] == page[j]:
            if item[1][0] == "=":
                met.append((i, j))
            i, j = i + 1, j + 1
        elif page[j][0] == "=":
            j += 1
            i += item[1][0] == "="
        elif item[1][0] == "=":
            i += 1
        else:
            i, j = places.agree(wrapper, i, j) or (len(wrapper), len(page))
    return met


def match(wrapper: list, page: list[str]) -> list[bool]:
    """For each text of a page, in order: whether it falls on a literal of the wrapper."""
    frame = {j for _, j in _met(wrapper, page)}
    return [j in frame for j, token in enumerate(page) if token[0] == "="]


def refuted(wrapper: list, page: list[str]) -> set[int]:
    """Items of literal text that a page does not bear out: it holds other text in their place, or none."""
    return {i for i, item in enumerate(wrapper) if item[0] == "t" and item[1][0] == "="} - {i for i, _ in _met(wrapper, page)}


def without(wrapper: list, items: set[int]) -> list:
    """The wrapper with slots in place of some literal texts. A page takes the same way through it."""
    return [["slot"] if i in items else item for i, item in enumerate(wrapper)]


def _loosen(items: list) -> list:
    return [["slot"] if x[0] == "t" and x[1][0] == "=" else x for x in items]


def infer(pages: list[str]) -> list:
    """The wrapper of some pages; empty if they have fewer than two token streams (copies tell nothing of the frame)."""
    flat = [list(f) for f in dict.fromkeys(tuple(flatten(p)) for p in pages) if f]
    wrapper: list = [["t", x] for x in flat[0]] if len(flat) > 1 else []
    for page in flat[1:]:
        wrapper = align(wrapper, page)
    return wrapper


def main_text(html: str | None, wrapper: list | None = None) -> str:
    """Main text of a page: blocks in page order, joined by an empty line; empty if there is none.

    Only the first article (or main) region counts if there is one with text; outside it, texts on literals of the
    wrapper are dropped.
    """
    parsed = list(tokens(html or ""))
    literal = iter(match(wrapper, flatten(parsed)) if wrapper else ())
    inside: list[str] = []
    outside: list[str] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, dropped, article
    dropped = articles = 0

    def flush():
        text = _SPACE.sub(" ", "".join(part)).strip()
        part.clear()
        if text:
            (inside if articles else outside).append(text)

    for kind, name, raw in parsed:
        if kind == "text":
            text = entities.unescape(raw)
            frame = bool(wrapper) and bool(text.strip()) and next(literal)
            if not dropped and (articles or not frame):
                part.append(text)
            continue
        if name == "br" and not dropped:
            part.append(" ")
            continue
        if name in _BLOCK and not dropped:
            flush()
        if kind == "void":
            continue
        if kind == "open":
            # A paragraph, list item or cell ends the open one of its kind.
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                old = stack.pop()
                dropped -= old[1]
                articles -= old[2]
            article = name in ("article", "main")
            out = _dropped(name, raw, bool(articles))
            stack.append((name, out, article))
            dropped += out
            articles += article
        else:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                for old in stack[depth:]:
                    dropped -= old[1]
                    articles -= old[2]
                del stack[depth:]
    if not dropped:
        flush()
    return "\n\n".join(inside or outside)


def _template(html: str) -> Column:
    @F.arrow_udf("string")
    def template(html: pa.Array) -> pa.Array:
        return pa.array([template_of(flatten(h or "")) for h in html.to_pylist()], pa.string())

    return template(html)


def infer_wrappers(pages: DataFrame, samples: int = SAMPLES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, template, wrapper JSON) of every template of a host with two different pages or more.

    Their form comes from the samples, their literal texts are those that every page of the template bears out.
    """
    found = keep(_sampled_wrappers(pages, samples), "sampled")
    sure = found.where(F.contains("wrapper", F.lit('["t", "=')))
    if sure.isEmpty():
        return found
    near = F.broadcast if _bytes(sure) <= broadcast_bytes else lambda df: df
    asked = pages.where("html is not null").join(near(sure.select("host").distinct()), "host", "left_semi")
    met = asked.select("host", "html", _template("html").alias("template")).join(near(sure), ["host", "template"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[tuple[str, str], set[int]] = {}
        for batch in batches:
            for host, template, html, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "template", "html", "wrapper"))):
                items.setdefault((host, template), set()).update(refuted(_read_wrapper(wrapper), flatten(html)))
        rows = [(*key, i) for key, own in items.items() for i in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["host", "template", "item"])

    @F.arrow_udf("string")
    def slotted(wrapper: pa.Array, items: pa.Array) -> pa.Array:
        return pa.array([json.dumps(without(json.loads(w), set(i)), ensure_ascii=False) if i else w for w, i in zip(wrapper.to_pylist(), items.to_pylist())], pa.string())

    refutes = met.select("host", "template", "html", "wrapper").mapInArrow(gather, "host string, template string, item int").groupBy("host", "template").agg(F.collect_set("item").alias("items"))
    return found.join(refutes, ["host", "template"], "left").select("host", "template", slotted("wrapper", "items").alias("wrapper"))


def _bytes(wrappers: DataFrame) -> int:
    return wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 16)).first()[0] or 0


def _sampled_wrappers(pages: DataFrame, samples: int) -> DataFrame:

    @F.arrow_udf("template string, stream long")
    def marks_of(html: pa.Array) -> pa.Array:
        templates, streams = [], []
        for h in html.to_pylist():
            flat = flatten(h)
            templates.append(template_of(flat))
            streams.append(int.from_bytes(hashlib.blake2b("\0".join(flat).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) if flat else None)
        return pa.StructArray.from_arrays([pa.array(templates, pa.string()), pa.array(streams, pa.int64())], names=["template", "stream"])

    pages = pages.where("html is not null and host <> ''")
    place = {"u": F.xxhash64("url"), "id": F.coalesce("page_id", F.lit(-1)), "v": F.xxhash64("html")}
    marks = keep(pages.select("host", *(c.alias(k) for k, c in place.items()), marks_of("html").alias("m")).select("host", "u", "id", "v", "m.*"), "marks")
    order = Window.partitionBy("host", "template").orderBy("at")
    distinct = marks.where("stream is not null").groupBy("host", "template", "stream").agg(F.min(F.struct(*place)).alias("at"))
    ranked = distinct.withColumn("n", F.row_number().over(order)).where(F.col("n") <= samples).select("host", "template", "n", "at.*")
    # Repeated rows of a sample page are one sample.
    chosen = pages.withColumns(place).join(ranked, ["host", *place]).groupBy("host", "template", "n").agg(F.first("html").alias("html"))

    def per_template(table: pa.Table) -> pa.Table:
        found = infer([h for _, h in sorted(zip(table.column("n").to_pylist(), table.column("html").to_pylist()))])
        return pa.table({"host": table.column("host")[:1], "template": table.column("template")[:1], "wrapper": pa.array([json.dumps(found, ensure_ascii=False)], pa.string())})

    return chosen.groupBy("host", "template").applyInArrow(per_template, "host string, template string, wrapper string").where("wrapper <> '[]'")


@lru_cache(maxsize=256)
def _read_wrapper(text: str | None) -> list | None:
    return json.loads(text) if text else None


def extract_main_text(pages: DataFrame, samples: int = SAMPLES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points), one row per input row.

    pages: page_id, url, html; other columns are not looked at. Null html counts as empty; its text is empty. A page
    without a host, or whose template has no other page, is parsed without a wrapper. Character references are
    decoded, white space inside a block becomes one space. Wrappers of more than ``broadcast_bytes`` are joined.
    """
    pages = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host"))
    wrappers = keep(infer_wrappers(pages, samples, broadcast_bytes), "wrappers")
    if _bytes(wrappers) <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({(r.host, r.template): r.wrapper for r in wrappers.collect()})

        @F.arrow_udf("string")
        def text_of(html: pa.Array, host: pa.Array) -> pa.Array:
            hosts = {h for h, _ in known.value}
            own = [known.value.get((o, template_of(flatten(h)))) if h and o in hosts else None for h, o in zip(html.to_pylist(), host.to_pylist())]
            return pa.array([main_text(h, _read_wrapper(w)) for h, w in zip(html.to_pylist(), own)], pa.string())

        out = pages.select("page_id", "url", text_of("html", "host").alias("text"))
    else:

        @F.arrow_udf("string")
        def text_by(html: pa.Array, wrapper: pa.Array) -> pa.Array:
            return pa.array([main_text(h, _read_wrapper(w)) for h, w in zip(html.to_pylist(), wrapper.to_pylist())], pa.string())

        out = pages.withColumn("template", _template("html")).join(wrappers, ["host", "template"], "left").select("page_id", "url", text_by("html", "wrapper").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
