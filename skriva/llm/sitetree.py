"""Main text of web pages by site style trees.

All pages of a host are merged into one tree: a style node is a path of tags and classes. A node's
presentation importance is the entropy of the child layouts that its pages show, its content importance
that of the texts at it (entropy over the pages that have the node, its base their number: 0 if all pages
agree, 1 if all differ); a node is as important as the more telling of the two. A branch all of whose nodes
have low importance is removed whole from each page, and so is a text that most pages repeat at its node.
Elements that name themselves furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
comments) are never content. Articles that a page names are a prior: what is outside them needs a high
importance or, too rare to judge, more text than they have.

Pages of a host with equal bodies count once, so copies don't make an article look like a template.
Null or empty html: empty text. A node on fewer than MIN_PAGES pages is too rare to judge and is kept. Equal rows
each have their row of the result; ids and addresses may be null (pages without a host are one host). Html of any
length is read whole. Ties: a value exactly at a bound is kept below LOW, removed at 1 - LOW. Other columns
aren't read.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A branch with less importance than LOW goes, outside a named article one with less than HIGH; a node on
#: fewer than MIN_PAGES distinct pages is kept.
LOW, HIGH, MIN_PAGES = 0.3, 0.6, 8
#: Low branches up to which they are broadcast; beyond, hosts are joined by a shuffle.
MOST_BROADCAST = 200_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|svg|iframe|select|object|math|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NEVER = frozenset("nav footer aside form head menu button label dialog".split())
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_FURNITURE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|contentinfo|cookies?|disqus|footer|form|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|replies|respond|search|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
_WHITE = re.compile(r"\s+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _NEVER or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return bool(_HIDDEN.search(attrs)) or any(_FURNITURE.search(a or b or c) for a, b, c in _NAMES.findall(attrs))


def blocks(page: str) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]], bool]:
    """([(style path, text, in an article) of each block], [(style path, child layout) of each node], an article is named).

    Text only where it may be content; article or main elements count as articles.
    """
    stack: list[list] = []  # tag, style, furniture, article, children
    out: list[tuple[str, str, bool]] = []
    nodes: list[tuple[str, str]] = []
    text: list[str] = []
    off = inside = 0
    named = False

    def flush():
        if text:
            got = _WHITE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if got and not off:
                out.append(("/".join(x[1] for x in stack), got, inside > 0))

    def close(k: int):
        nonlocal off, inside
        while len(stack) > k:
            path = "/".join(x[1] for x in stack)
            x = stack.pop()
            off -= x[2]
            inside -= x[3]
            if not x[2] and not off and x[4]:
                nodes.append((path, ",".join(x[4])))

    for m in _TOKEN.finditer(page):
        if (t := m["text"]) is not None:
            if not off:
                text.append(t)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if tag == "br":
                text.append(" ")
            elif not off and not m["end"] and tag not in _VOID and m["attrs"] and _furniture(tag, m["attrs"], inside > 0):
                flush()
                stack.append([tag, tag, True, False, []])
                off += 1
            elif off and m["end"] and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            continue
        flush()
        if tag == "hr":
            continue
        if m["end"]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if k is not None:
                close(k)
            continue
        if stack and (stack[-1][0] == "p" or tag == stack[-1][0] in ("li", "td", "tr", "dt", "dd") or {tag, stack[-1][0]} == {"dt", "dd"}):
            close(len(stack) - 1)
        if tag == "body" and stack and stack[-1][0] == "head":
            close(len(stack) - 1)
        attrs = m["attrs"]
        bad = _furniture(tag, attrs, inside > 0)
        article = tag in ("article", "main") and not off
        named |= article
        style = tag
        if attrs and (c := _CLASS.search(attrs)):
            style = f"{tag}.{'.'.join(sorted((c[1] or c[2] or c[3] or '').replace('/', '|').split()))}"
        if stack:
            stack[-1][4].append(style)
        stack.append([tag, style, bad, article, []])
        off += bad
        inside += article
    flush()
    close(0)
    return out, nodes, named


def _crc(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def judged(pages: DataFrame) -> DataFrame:
    """host, path, kind and value of what all pages say of a branch, each on at least MIN_PAGES of them.

    Kind 0: the branch is of little importance. Kind 1: the text (its value) is repeated at the path by most
    pages. Kind 2: the path is of high importance, and outside an article on pages that name one.

    At scale: counts are partially aggregated by (host, path, kind, value), so a host with a third of all
    pages is a few rows of each task; what is left of a host is its common nodes and texts.
    """

    def features(batches):
        for b in batches:
            out: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts, nodes, named = blocks(page or "")
                body = _crc("\n".join(t for _, t, _ in texts))
                content: dict[str, list[str]] = {}
                layout: dict[str, list[str]] = {}
                for p, t, _ in texts:
                    content.setdefault(p, []).append(t)
                for p, c in nodes:
                    layout.setdefault(p, []).append(c)
                out += [(host, p, 0, _crc("\n".join(t)), body) for p, t in content.items()]
                out += [(host, p, 1, _crc(";".join(c)), body) for p, c in layout.items()]
                out += [(host, p, 2, v, body) for p, t in content.items() if len(t) > 1 for v in set(map(_crc, t))]
                out += [(host, p, 3, 0, body) for p in {p for p, _, own in texts if named and not own}]
            if out:
                yield shared.as_batch(["host", "path", "kind", "value", "body"], list(zip(*out, strict=True)), [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()])

    rows = shared.arrow(pages.select("host", "html"), features, "host string, path string, kind int, value long, body long")
    each = rows.groupBy("host", "path", "kind", "value", "body").agg(F.lit(1).alias("one")).groupBy("host", "path", "kind", "value").agg(F.count("*").alias("c"))
    each = shared.written(each.filter(f"kind <> 2 or c >= {(1 - LOW) * MIN_PAGES}"))
    node = each.filter("kind <> 2").groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.expr("c * ln(c)")).alias("s"))
    importance = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    # a node is as important as the more telling of its two entropies
    both = node.withColumn("importance", importance).groupBy("host", "path").agg(
        of(0, "m").alias("texts"), of(3, "m").isNotNull().alias("outside"), F.max(F.when(F.col("kind") < 2, F.col("importance"))).alias("importance"), F.max("m").alias("m")
    )
    common = shared.written(both.filter(F.col("m") >= MIN_PAGES))
    # a branch is as important as the most important node in it
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    tree = common.withColumn("parts", F.split("path", "/")).select("host", F.explode(above).alias("path"), "importance")
    low = tree.groupBy("host", "path").agg(F.max("importance").alias("importance")).filter(F.col("importance") < LOW)
    none = F.lit(0).cast("long").alias("value")
    repeated = each.filter(f"kind in (0, 2) and c >= {(1 - LOW) * MIN_PAGES}").join(common.select("host", "path", "texts"), ["host", "path"]).filter((F.col("texts") >= MIN_PAGES) & (F.col("c") >= (1 - LOW) * F.col("texts")))
    return (
        low.select("host", "path", F.lit(0).alias("kind"), none)
        .union(repeated.select("host", "path", F.lit(1), "value").distinct())
        .union(common.filter(F.col("outside") & (F.col("texts") >= MIN_PAGES) & (F.col("importance") >= HIGH)).select("host", "path", F.lit(2), none))
    )


def main_text(page: str, rules: list[tuple[str, int, int]]) -> str:
    """The text of a page under the rules (path, kind, value) of its host."""
    found, _, named = blocks(page)
    low = {p for p, kind, _ in rules if kind == 0}
    repeated = {(p, v) for p, kind, v in rules if kind == 1}
    high = {p for p, kind, _ in rules if kind == 2}
    gone: dict[str, bool] = {}

    def in_low(path: str) -> bool:
        if path not in gone:
            gone[path] = path in low or "/" in path and in_low(path.rpartition("/")[0])
        return gone[path]

    if low or repeated:
        found = [x for x in found if not in_low(x[0]) and (x[0], _crc(x[1])) not in repeated]
    if named:
        inside = sum(len(t) for _, t, own in found if own)
        most = 2 * inside >= sum(len(t) for _, t, _ in found)
        found = [x for x in found if x[2] or x[0] in high or not most]
    return "\n".join(t for _, t, _ in found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    rules = shared.written(judged(pages))
    by_host = rules.groupBy("host").agg(F.collect_list(F.struct("path", "kind", "value")).alias("rules"))
    joined = pages.join(F.broadcast(by_host) if rules.count() <= MOST_BROADCAST else by_host, "host", "left").select("page_id", "url", "html", "rules")

    def texts(batches):
        for b in batches:
            out = []
            for page, rules in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                out.append(main_text(page or "", [(r["path"], r["kind"], r["value"]) for r in rules or ()]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return shared.arrow(joined, texts, schema)
