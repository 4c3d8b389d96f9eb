"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: a node is a path of containers (sections, divisions and the like) with their first class, down to ``DEEP`` levels; what lies
deeper belongs to the container at that level. Over the pages that hold a container are counted

* content: in how many pages each of its texts occurs. The spread of a text on k of m pages is log k / log m; content importance is 1 less the mean spread,
* presentation: which sequences of child blocks it has. Presentation importance is the entropy of their distribution over log m; a container of text and paragraphs alone has none,
* its share of a page's words, counted full from ``FULL`` on.

The importance of a container is the mean of these. Few pages tell little, so a host's figures are blended with those of the same path over all hosts (as if
``BACKED`` pages more had been seen), and these with what a container's kind leads to expect (as ``PRIOR`` pages). Names of elements, classes and roles only shift the result by
``SHIFT``, and not where the container holds more than half of its page's words; an article or main element holds its parts more firmly, and what lies beside one that holds half of the words has to be
more important by ``SHIFT``. Branches below ``LOW`` are removed from each page, the rest is its text.

Three things are no question of importance and never text: what isn't shown (scripts, styles, hidden elements), controls with their labels, and readers' comments, which entropy can't tell from an article.
A form or field set goes with its controls if it has fewer than ``TALK`` words for each and holds no part of a page's frame (an article, a heading of the first level, a header and the like); else it is a container as others. A
block is of readers' comments if its names say so by their stems, and it is neither a first article nor holds a heading of the first level.

A host's different pages are counted, each once however many rows hold it, so copies don't make a text look like a template. Counts are summed within a batch, then by (host, path, feature).

Defined results: a null or empty page has an empty text; text outside any block is a block; unclosed and wrongly nested elements end with the
block that holds them; a tag without an end is text; repeated rows give equal rows; a null url is a host of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, cut, table, text_or_empty

DEEP, FULL, BACKED, PRIOR, LOW, HELD, SHIFT, TALK = 12, 0.3, 10.0, 3.0, 0.5, 0.2, 0.15, 30
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>\"'<]*)|[!?])")
_STOP = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select"}
_RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that are judged, and other blocks, which stay or go with the container that holds them.
CONTAINERS = {"article", "aside", "center", "dialog", "div", "fieldset", "footer", "form", "header", "main", "menu", "nav", "section"}
_BLOCK = CONTAINERS | {
    "address", "blockquote", "body", "button", "caption", "dd", "details", "dir", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "hgroup", "html", "label", "legend", "li", "ol", "p", "pre", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an opening block ends, if it is open in the same list or table.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"article", "aside", "body", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "table", "ul"}
_NEVER = {"head", "button", "label", "legend"}
MAIN = {"article", "main"}
_FORMS, _CONTROLS = {"form", "fieldset"}, {"input", "select", "textarea", "button"}
#: Elements of a page's frame: a form around one of them is around a page.
_FRAME = {"article", "main", "h1", "header", "footer", "nav", "section"}
_SAME_SHAPE = {"p", "label", "legend"}
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


@dataclass(frozen=True)
class Names:
    """What names suggest: elements, roles and parts of class names. They shift an importance; only ``comments``, a pattern for the stems of a class or id, decides."""

    elements: frozenset = frozenset({"nav", "footer", "aside", "header", "menu", "dialog", "form"})
    roles: frozenset = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "menu", "alert", "dialog"})
    classes: frozenset = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice popup modal newsletter subscribe sidebar social related breadcrumb breadcrumbs nav navbar navigation menu footer masthead widget login".split())
    comments: re.Pattern = re.compile(r"(?:(?:user|reader|visitor|guest|post|blog|article|page|story|fb|facebook)s?[-_]?)?(?:comments?(?:[-_]?(?:list|section|area|thread|block|box|wrap(?:per)?|container|body|item|form|s))*|respond|replies|disqus(?:[-_].*)?)", re.I)


NAMES = Names()


@dataclass
class Node:
    """A container of a page: its path, the containers around it, whether an article or main element is around it, and whether its kind or names speak for or against it."""

    path: int
    above: tuple[int, ...]
    inside: bool
    kind: int  # 1 article or main, -1 named as something else, 0 neither
    children: list[str] = field(default_factory=list)
    headed: bool = False  # whether it holds a heading of the first level


class Region:
    """A form or a place of readers' comments: what it holds decides whether its text counts."""

    __slots__ = ("comments", "controls", "framed", "headed", "outer", "words")

    def __init__(self, outer: Region | None, comments: bool):
        self.outer, self.comments, self.controls, self.words, self.framed, self.headed = outer, comments, 0, 0, False, False

    def around(self) -> Iterator[Region]:
        """This region and those around it."""
        at = self
        while at:
            yield at
            at = at.outer

    def drops(self) -> bool:
        return not self.headed if self.comments else self.controls > 0 and not self.framed and self.words < TALK * self.controls


class Block:
    """A block of text: the node that holds it, whether it is never text, and the innermost region around it."""

    __slots__ = ("node", "never", "parts", "region")

    def __init__(self, node: Node, never: bool, region: Region | None):
        self.node, self.never, self.parts, self.region = node, never, [], region

    def text(self) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes) in page order: tag is empty for text, and has a leading / for an end. Each character is looked at a bounded number of times."""
    at, text_from, dead, failed = 0, 0, False, set()
    while not dead and (m := _OPEN.search(page, at)):
        start, at = m.start(), m.end()
        if m[1]:
            end = page.find("-->", at)
            end = len(page) if end < 0 else end + 3
            attributes = ""
        elif m[3]:
            end, seen = at, []
            # Quotes hide a >; where they lead past the end of the page they don't count. Places that did so once are remembered.
            while True:
                stop = _STOP.search(page, end)
                if stop and stop[0] == ">":
                    end = stop.end()
                    break
                close = page.find(stop[0], stop.end()) if stop else -1
                if close < 0 or close + 1 in failed:
                    failed.update(seen)
                    end = page.find(">", at) + 1
                    break
                end = close + 1
                seen.append(end)
            attributes = page[at : end - 1]
        else:
            end, attributes = page.find(">", at) + 1, ""
        if end <= 0:
            dead = True
            break
        if start > text_from:
            yield page[text_from:start], "", ""
        tag = (m[3] or "").lower()
        at = end
        if tag in _RAW and not m[2]:
            if tag in _CONTROLS:
                yield "", tag, ""
            close = _RAW_END[tag].search(page, at)
            at = page.find(">", close.end()) + 1 or len(page) if close else len(page)
        elif tag:
            yield "", (m[2] or "") + tag, attributes
        text_from = at
    if text_from < len(page):
        yield page[text_from:], "", ""


def described(tag: str, attributes: str, names: Names) -> tuple[str, bool, bool, bool]:
    """A container's name in the tree, whether names speak against it, whether it is never text, and whether names call it readers' comments."""
    name, against, never, comments = tag, tag in names.elements, tag in _NEVER, False
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "class" and value.split():
                words = [w.lower() for w in value.split()]
                name = f"{tag}.{re.sub(r'[0-9]+', '0', words[0])[:40]}"
                against |= any(names.classes.intersection((w, *re.split("[-_]+", w))) for w in words)
                comments |= any(names.comments.fullmatch(w) for w in words)
            elif key == "id":
                comments |= bool(names.comments.fullmatch(value.strip()))
            elif key == "role":
                against |= value.lower() in names.roles
                never |= value.lower() == "form"
            elif key == "hidden":
                never |= value.lower() in ("", "hidden")
            elif key == "aria-hidden":
                never |= value.lower() == "true"
            elif key == "style":
                never |= bool(_UNSEEN.search(value))
    return name, against, never, comments


def parse(page: str, names: Names = NAMES) -> tuple[list[Block], list[Node]]:
    """The blocks of a page in order, and its containers."""
    root = Node(0, (), False, 0)
    found: list[Block] = []
    nodes: list[Node] = []
    #: Tag, the container it is or lies in, never, and the region it is or lies in.
    stack: list[tuple[str, Node, bool, Region | None]] = [("", root, False, None)]
    count: Counter = Counter()
    block: Block | None = None

    def close(k: int) -> None:
        nonlocal block
        for tag, *_ in stack[k:]:
            count[tag] -= 1
        del stack[k:]
        block = None

    for text, tag, attributes in tokens(page):
        if not tag or tag == "br":
            if block is None and text:
                block = Block(stack[-1][1], stack[-1][2], stack[-1][3])
                found.append(block)
            if block is not None:
                block.parts.append(text or " ")
            continue
        if tag[0] == "/":
            if count[tag[1:]]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag[1:]))
            continue
        if tag in _CONTROLS and stack[-1][3] and not re.search(r"type\s*=\s*[\"']?hidden", attributes, re.I):
            for r in stack[-1][3].around():
                r.controls += 1
        if tag == "hr":
            block = None
        if tag not in _BLOCK or tag in _VOID:
            continue
        if stack[-1][0] == "p":  # a paragraph holds no block
            close(len(stack) - 1)
        if tag in _ENDS and any(count[t] for t in _ENDS[tag]):
            k = len(stack) - 1
            while k and stack[k][0] not in _ENDS[tag] and stack[k][0] not in _HOLDS:
                k -= 1
            if stack[k][0] in _ENDS[tag]:
                close(k)
        _, node, never, region = stack[-1]
        name, against, hides, comments = described(tag, attributes, names)
        node.children.append(name)
        if tag in _FRAME and region:
            for r in region.around():
                r.framed, r.headed = True, r.headed or tag == "h1"
        if tag == "h1":
            node.headed = True
        if tag in _FORMS or comments and not (tag in MAIN and not count["article"]) and tag not in ("html", "body"):
            region = Region(region, comments)
        if tag in CONTAINERS and len(node.above) < DEEP:
            # A header in an article may hold its title; one outside is the page's.
            kind = 1 if tag in MAIN else -1 if against and not (tag == "header" and node.inside) else 0
            inside = node.inside or node.kind == 1
            node = Node(xxhash.xxh64_intdigest(name, node.path) >> 1, (*node.above, node.path) if node.path else (), inside, kind)
            nodes.append(node)
        stack.append((tag, node, never or hides, region))
        count[tag] += 1
        block = None
    for b in found:
        if b.region and not b.never:
            n = len(b.text().split())
            for r in b.region.around():
                r.words += n
    for b in found:
        b.never |= b.region is not None and any(r.drops() for r in b.region.around())
    return found, nodes


#: Kinds of counts: the pages that have a path (with sums of shares and of what its kind leads to expect), its texts, its sequences of children.
PAGE, TEXT, SHAPE = 0, 1, 2


def features(page: str | None, names: Names = NAMES) -> Iterator[tuple[int, int, int, float, float, int]]:
    """(path, what, feature, share, expected, flags) of a page's tree, flags: 1 inside an article, 2 named as something else, 4 an article, 8 beside one that holds half of the words.

    Child blocks of one name in a row count as one; a container of text and paragraphs alone has the shape 0."""
    blocks, nodes = parse(page or "", names)
    words: Counter = Counter()
    total = 0
    for b in blocks:
        if not b.never and (text := b.text()):
            n = text.count(" ") + 1
            total += n
            mark = zlib.crc32(text.encode())
            for path in (*b.node.above, b.node.path):
                if path:
                    words[path] += n
                    yield path, TEXT, mark, 0.0, 0.0, 0
    different = {n.path: n for n in nodes}
    holding = [n for n in different.values() if n.kind == 1 and 2 * words[n.path] >= total > 0]
    around = {p for n in holding for p in (*n.above, n.path)}
    for node in different.values():
        share = words[node.path] / total if total else 0.0
        kind = 0 if node.kind == -1 and share > 0.5 else node.kind
        beside = bool(holding) and node.path not in around and not node.inside and not node.headed
        # Of a container of text alone neither is expected.
        yield node.path, PAGE, 0, share, {1: 1.0, -1: 0.1, 0: 0.6 if set(node.children) - _SAME_SHAPE else 0.5}[kind], node.inside + 2 * (kind == -1) + 4 * (kind == 1) + 8 * beside
    for node in nodes:
        short = [n for i, n in enumerate(node.children) if not i or n != node.children[i - 1]]
        yield node.path, SHAPE, zlib.crc32(" ".join(short).encode()) if set(short) - _SAME_SHAPE else 0, 0.0, 0.0, 0


def main_text(page: str | None, low: set[int], names: Names = NAMES) -> str:
    """The page's text without branches of low importance."""
    out = []
    for b in parse(page or "", names)[0]:
        if not b.never and b.node.path not in low and not low.intersection(b.node.above) and (text := b.text()):
            out.append(text)
    return "\n\n".join(out)


def host_of(url):
    return ascii_lower(F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1))


def counted(df: DataFrame, url_col: str, html_col: str, names: Names = NAMES) -> DataFrame:
    """host, path, what, feature, pages, times, share, expected, flags over the different pages of each host."""
    kinds = [("host", pa.string()), ("path", pa.int64()), ("what", pa.int8()), ("feature", pa.int64()), ("pages", pa.int64()), ("times", pa.int64()), ("share", pa.float64()), ("expected", pa.float64()), ("flags", pa.int64())]
    schema = pa.schema(kinds)

    def run(batches):
        for b in batches:
            pages, times, sums = Counter(), Counter(), {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own: Counter = Counter()
                for path, what, feature, share, expected, flags in features(page.as_py(), names):
                    key = (host, path, what, feature)
                    own[key] += 1
                    if what == PAGE:
                        s, e, f = sums.get(key, (0.0, 0.0, 0))
                        sums[key] = (s + share, e + expected, f | flags)
                pages.update(own.keys())
                times.update(own)
            rows = [(*k, n, times[k], *sums.get(k, (0.0, 0.0, 0))) for k, n in pages.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema, strict=True)], schema=schema)

    slim = df.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("page")).distinct()
    counts = slim.mapInArrow(run, "host string, path long, what byte, feature long, pages long, times long, share double, expected double, flags long")
    return counts.groupBy("host", "path", "what", "feature").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "share", "expected")], F.bit_or("flags").alias("flags"))


def tree(counts: DataFrame, *by: str) -> DataFrame:
    """by, path: m (pages), tree (the importance by entropies and share), expected, flags.

    Sums of k log k and of times log k need no m, so one pass over the features gives both entropies."""
    log, is_ = F.log("pages"), lambda what: F.col("what") == what
    sums = counts.groupBy(*by, "path").agg(
        F.sum(F.when(is_(PAGE), F.col("pages"))).alias("m"), F.sum("share").alias("share"), F.sum("expected").alias("expected"), F.bit_or("flags").alias("flags"),
        F.sum(F.when(is_(TEXT), F.col("times") * log)).alias("spread"), F.sum(F.when(is_(TEXT), F.col("times"))).alias("times"),
        F.sum(F.when(is_(SHAPE), F.col("pages") * log)).alias("same"), F.sum(F.when(is_(SHAPE), F.col("pages"))).alias("shaped"),
        F.max(F.when(is_(SHAPE), F.col("feature") != 0)).alias("laid_out"),
    )
    of_m = F.log("m")
    content = F.when((F.col("m") > 1) & (F.col("times") > 0), 1 - F.col("spread") / F.col("times") / of_m).otherwise(1.0)
    shaped = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), F.log("shaped") - F.col("same") / F.col("shaped")) / of_m).otherwise(0.5)
    share = F.least(F.lit(1.0), F.col("share") / F.col("m") / FULL)
    mean = F.when(F.col("laid_out"), (content + F.least(F.lit(1.0), shaped) + share) / 3).otherwise((content + share) / 2)
    # What holds most of its pages' words and isn't the same on all is a wrapper: its parts are judged instead.
    wraps = (F.col("share") / F.col("m") > 0.5) & (content >= 0.2)
    mean = F.when(wraps, F.greatest(mean, F.lit(LOW + 2 * SHIFT))).otherwise(mean)
    return sums.select(*by, "path", "m", mean.alias("tree"), (F.col("expected") / F.col("m")).alias("expected"), "flags")


def importance(own_m: Column, own: Column, all_m: Column, over_all: Column, expected: Column, flags: Column) -> Column:
    """How far a container's importance lies above what it needs to stay."""
    blended = F.when(own_m > 1, (own_m * own + BACKED * over_all) / (own_m + BACKED)).otherwise(over_all)
    smooth = (all_m * blended + PRIOR * expected) / (all_m + PRIOR)
    has = lambda flag: flags.bitwiseAND(F.lit(flag)) > 0
    shift = F.when(has(4), SHIFT).when(has(2), -SHIFT).otherwise(0.0) - F.when(has(8), SHIFT).otherwise(0.0)
    return smooth + shift - F.when(flags.bitwiseAND(F.lit(1)) > 0, LOW - HELD).otherwise(LOW)


def low_paths(df: DataFrame, url_col: str, html_col: str, names: Names = NAMES) -> DataFrame:
    """host, low: the paths of low importance of each host that has any."""
    counts = cut(counted(df, url_col, html_col, names))
    by_host = tree(counts, "host")
    merged = counts.groupBy("path", "what", "feature").agg(*[F.sum(c).alias(c) for c in ("pages", "times", "share", "expected")], F.bit_or("flags").alias("flags"))
    over_all = tree(merged).select(F.col("path").alias("of"), F.col("m").alias("all_m"), F.col("tree").alias("over_all"))
    both = by_host.join(over_all, F.col("path") == F.col("of"))
    above = importance(F.col("m"), F.col("tree"), F.col("all_m"), F.col("over_all"), F.col("expected"), F.col("flags"))
    return both.filter(above < 0).groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: Names = NAMES) -> DataFrame:
    """One row per row of df: id, url, text, n_chars."""
    low = cut(low_paths(df, url_col, html_col, names))
    pages = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    pages = pages.join(low.select(F.col("host").alias("_of"), "low"), F.col("_host") == F.col("_of"), "left")

    @F.pandas_udf("string")
    def text(page, low):
        import pandas as pd

        return pd.Series([main_text(p, set(x) if x is not None else set(), names) for p, x in zip(page, low, strict=True)], dtype=object)

    out = pages.select(F.col("_id").alias(id_col), F.col("_url").alias("url"), text("_html", "low").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
