"""Main text of web pages by wrapper induction: the DOM trees of a host's pages are aligned by simple tree matching."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, stored, tidy

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|$)|<[!?][^>]*(?:>|$)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
#: What an open element of this kind is closed by.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"}}
HOLDS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form", "td", "th", "li", "blockquote", "html"}
#: Elements, roles and class or id words that never are main text.
OUT = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "audio", "video", "canvas", "fieldset", "datalist", *RAW}
OUT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
OUT_WORD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|header|masthead|topbar|comments?|commentlist|respond|disqus|replies|share|sharing|social|related|recommended|widget\w*|pagination|pager|toolbar|search|skip|hidden)(?=$|[\s_\d-])", re.I)
MAIN = {"article", "main"}
#: A slot is template if nearly all of at least so many pages that fill it hold the same text. On a host of fewer
#: distinct pages, all that fill it must, two or more.
SHARE, PAGES = 0.9, 12
KEPT = 6
#: Characters of wrappers that are sent to all tasks at most; beyond that they are joined to the pages.
SENT = 16_000_000
#: Elements nested deeper are siblings on this level, as in browsers, which stop at some depth too. No text is lost.
DEEPEST = 200
#: Lists of children whose lengths multiply to more are matched in order of first fit; a wrapper's node keeps the slots that
#: most pages fill, up to WIDEST.
MATCHED, WIDEST = 40_000, 400
#: Sums of parts of pages are off by less.
TINY = 1e-6
#: No element that is one of these, or holds one, is template as a whole.
WHOLE = {"html", "body", *MAIN}


class Node:
    __slots__ = ("label", "tag", "out", "kids", "text")

    def __init__(self, label: str, tag: str, out: bool) -> None:
        self.label, self.tag, self.out, self.kids, self.text = label, tag, out, [], ""


def boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    if tag in OUT or attrs.get("role", "").lower() in OUT_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return tag not in ("html", "body", *MAIN) and bool(OUT_WORD.search(f"{attrs.get('class', '')} {attrs.get('id', '')}"))


def parse(page: str) -> Node:
    """The tree of block elements; runs of text between block boundaries are leaves labelled #text."""
    root = Node("#root", "", False)
    stack, parts, at, end = [root], [], 0, len(page)

    def close_run() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                leaf = Node("#text", "", False)
                leaf.text = text
                stack[-1].kids.append(leaf)

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in ("html",) and len(stack) > 1 and not m[1]:
            continue
        if tag in INLINE:
            if not m[1] and tag in ("a", "span", "label") and m[3] and (hid := "hidden" in m[3] or "none" in m[3]) and boilerplate(tag, attrs_of(m[3])):
                stop = re.compile(f"</{tag}", re.I).search(page, at)
                at = stop.start() if hid and stop else at
            continue
        if tag in VOID:
            parts.append(" ")
            if tag == "hr":
                close_run()
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_run()
                    del stack[k:]
                    break
                if tag in ("p", "li") and stack[k].tag in HOLDS and stack[k].tag != tag:
                    close_run()
                    break
            continue
        close_run()
        if tag in RAW:  # nothing in it is markup
            stop = re.compile(f"</{re.escape(tag)}\\b[^>]*(?:>|$)", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = stop.end() if stop else end
            continue
        if tag not in CLOSED_BY and stack[-1].tag == "p" or tag in ("p", "li", "dd", "dt") and stack[-1].tag == "p":
            stack.pop()
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in HOLDS and stack[k].tag not in ("td", "th", "li"):
                break
        attrs = attrs_of(m[3])
        name = re.sub(r"\d+", "", attrs.get("class", "")).strip()
        node = Node(f"{tag}.{name}" if name else tag, tag, boilerplate(tag, attrs))
        stack[-1].kids.append(node)
        if len(stack) <= DEEPEST and not (m[3].endswith("/") and tag in ("svg", "path")):
            stack.append(node)
    close_run()
    return root


def attrs_of(inside: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in ('"', "'") else v) for k, v in ATTR.findall(inside)} if inside and inside.strip() else {}


def folded(node: Node) -> list[tuple[str, list[Node]]]:
    """The children in order, neighbours of one label together: repeated elements are one slot of the template."""
    out: list[tuple[str, list[Node]]] = []
    for kid in node.kids:
        if out and out[-1][0] == kid.label:
            out[-1][1].append(kid)
        else:
            out.append((kid.label, [kid]))
    return out


# A node of a wrapper: {"l": label, "n": pages, "t": {text: pages}, "k": children}. A page that a host holds m times counts
# 1/m each time, so that pages are distinct pages. Texts are kept as checksums, the KEPT
# most frequent (by the Misra-Gries rule, so that a text of over 1/(KEPT+1) of the pages is never lost).


def text_key(nodes: list[Node]) -> str:
    """A checksum of all that the nodes say, or none if they say nothing."""
    said: list[str] = []
    todo = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x.text:
            said.append(x.text)
        todo.extend(reversed(x.kids))
    return str(crc32("\n".join(said).encode("utf-8", "surrogatepass"))) if said else ""


def note(counts: dict[str, float], key: str, n: float) -> None:
    counts[key] = counts.get(key, 0) + n
    if len(counts) > KEPT:
        least = min(counts.values())
        for k in list(counts):
            counts[k] -= least
            if counts[k] < TINY:
                del counts[k]


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists, by label, in order: the pairs of the largest matching.

    Where the lists are too long for that (MATCHED), each of b takes the first fitting one of a that is left.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    end = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) * len(b) > MATCHED:
        spots: dict[str, list[int]] = {}
        for i, x in enumerate(a):
            spots.setdefault(x, []).append(i)
        at = 0
        for j, x in enumerate(b):
            own = spots.get(x, ())
            k = bisect_left(own, at)
            if k < len(own):
                out.append((own[k] + head, j + head))
                at = own[k] + 1
        return out + end
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i, j = 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i + head, j + head))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + end


def merge_lists(kids: list[dict], others: list[dict]) -> None:
    """Aligns others with kids and adds them in: matched nodes are merged, the rest inserted where they stand."""
    todo = [(kids, others)]
    while todo:
        kids, others = todo.pop()
        pairs = matched([k["l"] for k in kids], [o["l"] for o in others])
        at, put = {j: i for i, j in pairs}, []
        place = 0
        for j, o in enumerate(others):
            if j in at:
                w = kids[at[j]]
                place = at[j] + 1
                w["n"] += o["n"]
                for key, n in o["t"].items():
                    note(w["t"], key, n)
                todo.append((w["k"], o["k"]))
            else:
                put.append((place, o))
        for place, o in reversed(put):
            kids.insert(place, o)
        if len(kids) > WIDEST:
            least = sorted((k["n"] for k in kids), reverse=True)[WIDEST - 1]
            spare = WIDEST - sum(k["n"] > least for k in kids)
            kept = []
            for k in kids:
                if k["n"] > least or k["n"] == least and spare > 0:
                    spare -= k["n"] == least
                    kept.append(k)
            kids[:] = kept


def pattern(nodes: list[Node], label: str, part: float = 1) -> dict:
    """What one page, or a part of one, says of a slot: all nodes of the slot at once, their children folded together."""
    out = {"l": label, "n": part, "t": {}, "k": []}
    if key := text_key(nodes):
        out["t"][key] = part
    for node in nodes:
        own = [pattern(kids, name, part) for name, kids in folded(node)]
        if not out["k"]:
            out["k"] = own
        else:
            for x in own:
                x["t"] = {}
            have = {k["l"] for k in out["k"]}
            out["k"] += [x for x in own if x["l"] not in have]
            for k in out["k"]:  # a slot in a repeated element varies
                k["t"] = {}
    return out


def constant(w: dict, pages: float) -> str:
    """The text that makes the slot template on a host of so many distinct pages, or none."""
    few = pages < PAGES - TINY
    if w["n"] < (2 if few else PAGES) - TINY or not w["t"]:
        return ""
    key = max(w["t"], key=w["t"].get)
    return key if w["t"][key] >= (1 if few else SHARE) * w["n"] - TINY else ""


def whole(node: Node) -> bool:
    return node.tag in WHOLE or any(whole(x) for x in node.kids)


def blocks(page: str, wrapper: dict | None) -> list[str]:
    """The text blocks of the main content, in page order.

    Left out are boilerplate elements, and what the host's wrapper knows as constant. If the page marks its content by
    article or main elements, only what is in them counts, and of that all that isn't boilerplate by its element or
    constant on (nearly) all pages of the host.
    """
    root = parse(page)
    found: list[tuple[str, bool]] = []

    def walk(node: Node, slot: dict | None, inside: bool) -> None:
        groups = folded(node)
        kids = slot["k"] if slot else []
        at = {j: i for i, j in matched([k["l"] for k in kids], [g for g, _ in groups])} if slot else {}
        for j, (_, nodes) in enumerate(groups):
            w = kids[at[j]] if j in at else None
            if w is not None and (key := constant(w, wrapper["n"])) and text_key(nodes) == key and not any(whole(x) for x in nodes):
                continue
            for x in nodes:
                if x.out:
                    continue
                if x.text:
                    found.append((x.text, inside))
                else:
                    walk(x, w, inside or x.tag in MAIN)

    walk(root, wrapper, False)
    marked = [t for t, inside in found if inside]
    return marked or [t for t, _ in found]


def host_of(url_col: str) -> Column:
    """The host of a url in small letters without www., or none."""
    host = F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page.

    Copies of a page on its host count as one page, and no element around the main content is dropped whole; of a slot
    that is template only the text that most pages have is left out. First pass: each task aligns the trees of the pages that it reads, host by host, into a partial wrapper; these are
    small, and are merged by host in two steps. Second pass: each page is aligned with its host's wrapper, and what is
    neither template nor boilerplate is its text.

    Returns a row for each row: the id, the url, text and n_chars. Null and empty pages have empty text; pages with a
    null or unusable url are one host. Other columns are ignored. White space in a block becomes one space, and blocks
    are joined by one newline. Elements may be nested to any depth (see DEEPEST).
    """

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": list(hosts), "wrapper": [json.dumps(w) for w in hosts.values()]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string())]))

        for b in batches:
            for host, page, many in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not page:
                    continue
                one = pattern([parse(page)], "#root", 1 / (many or 1))
                if host in hosts:
                    hosts[host]["n"] += one["n"]
                    merge_lists(hosts[host]["k"], one["k"])
                else:
                    hosts[host] = one
            if len(hosts) > 2000:
                yield out()
                hosts.clear()
        yield out()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by host: wrappers of a host one after another."""
        host, whole = None, None
        for b in batches:
            for h, w in zip(b.column("host").to_pylist(), b.column("wrapper").to_pylist(), strict=True):
                if h != host:
                    if host is not None:
                        yield pa.RecordBatch.from_pydict({"host": [host], "wrapper": [json.dumps(whole)]})
                    host, whole = h, json.loads(w)
                else:
                    more = json.loads(w)
                    whole["n"] += more["n"]
                    merge_lists(whole["k"], more["k"])
        if host is not None:
            yield pa.RecordBatch.from_pydict({"host": [host], "wrapper": [json.dumps(whole)]})

    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    # How often a host holds the same page, where it does so more than once.
    page = rows.select("host", "html", F.xxhash64("host", "html").alias("page"))
    copies = stored(page.groupBy("page").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "copies")
    partial = page.join(copies, "page", "left").select("host", "html", "many").mapInArrow(tidy(induce), "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(16)))
    some = partial.repartition(tasks, "host", "salt").sortWithinPartitions("host", "salt").select("host", "wrapper").mapInArrow(tidy(merged), "host string, wrapper string")
    whole = some.repartition(tasks, "host").sortWithinPartitions("host", "wrapper").mapInArrow(tidy(merged), "host string, wrapper string")
    whole = stored(whole, "wrappers")
    size = whole.agg(F.sum(F.length("wrapper"))).first()[0] or 0

    def text_of(batches: Iterator[pa.RecordBatch], known: dict[str, str] | None) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, dict | None] = {}
        for b in batches:
            texts = []
            given = b.column(4).to_pylist() if known is None else [None] * b.num_rows
            for page, host, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), given, strict=True):
                if host not in wrappers:
                    if len(wrappers) > 500:
                        wrappers.clear()
                    w = own if known is None else known.get(host)
                    wrappers[host] = json.loads(w) if w else None
                texts.append("\n".join(blocks(page, wrappers[host])) if page else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long"
    if size <= SENT:  # few hosts: all wrappers go to all tasks
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in whole.collect()})
        return rows.mapInArrow(lambda it: text_of(it, shared.value), kinds)
    joined = keyed_join(rows, whole, "host").select("id", "url", "html", "host", "wrapper")
    return joined.mapInArrow(lambda it: text_of(it, None), kinds)
