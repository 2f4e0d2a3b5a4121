"""Operator 10: main text of web pages by wrapper induction.

1. Over all pages without an article element, the nodes (labels down to them and whole content) of each host are
   counted. A node that at least half of the host's different pages hold, and four of them, is template.
2. For each host, the DOM trees of ``EXAMPLES`` pages with the smallest seeded hash (the row-number filter is applied
   before the shuffle, so a hot host sends a few rows a task) are aligned by simple tree matching. The
   host's wrapper is the skeleton of the tree down to the slots that hold main text: those whose nodes vary.
3. Every page is joined with its host's wrapper and template, aligned with the skeleton by the same matching,
   and the text of its content slots is read from the whole page, without the template's nodes, wherever they stand.

A slot that is a menu, header, footer, side bar, notice, advert, form, script, style or comment
section by its element or marks is never content, although it varies. On pages without an article,
everything else is content but the template's nodes and, beside a block that holds most of the text, nodes
other than headings that differ from the template's in their digits only; a page's node is dropped only if its own
content is the template's, and a page that would lose all of its text keeps it. Inside an article or main element nothing but marked clutter
is dropped, and headings, paragraphs and other prose elements never by a mark. A class name is a mark as a
whole (``sidebar``, ``ad-box``), not by a word in it (``has-sidebar``). An element around the page's article,
or a form around most of a page's text, is no clutter. A page that its wrapper does not fit, or whose host has no other
page, gets a wrapper of its own.

Defined results: a null html is empty and gives an empty text; a null or odd url belongs to the
host ''; a null page_id stays null; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from episodeflow.llm import dom
from episodeflow.llm.common import land
from episodeflow.llm.dom import Node, is_clutter, nodes, text_blocks, tree_match

#: Example pages of a host whose trees are aligned to find the content slots.
EXAMPLES = 6
#: Share of a host's pages, and number of pages, that hold a node before it counts as template.
SHARE = 0.5
AGREE = 4
#: Share of a node's main text that one child must hold for the search for template to go on inside it.
FOCUS = 0.8
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def _mass(node: Node, inside_article: bool, linked: bool = False) -> int:
    """Characters of main text below a node: no clutter, no link texts."""
    total = 0
    for kid in node.kids:
        if isinstance(kid, str):
            total += 0 if linked else len(kid.strip())
        elif not is_clutter(kid, inside_article):
            total += _mass(kid, inside_article or kid.tag in ("article", "main"), linked or kid.tag == "a")
    return total


def _has_article(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag in ("article", "main"):
            return True
        if not is_clutter(n, False):
            todo += nodes(n)
    return False


def keys_of(page: Node) -> dict[int, tuple[int, int]]:
    """Two 64-bit keys of each node with text outside clutter and articles, by ``id``: of the labels down to it
    and its whole content, and the same with all numbers alike."""
    order: list[tuple[Node, int, str]] = [(page, -1, page.label())]
    for i, (node, _, path) in enumerate(order):
        if node.tag not in ("article", "main"):
            order += [(k, i, f"{path}>{k.label()}") for k in nodes(node) if not is_clutter(k, False)]
    found: dict[int, tuple[int, int]] = {}
    content: list[tuple[bytes, bytes] | None] = [None] * len(order)
    at = {id(node): i for i, (node, _, _) in enumerate(order)}
    for i in range(len(order) - 1, -1, -1):
        node, _, path = order[i]
        parts: tuple[list[bytes], list[bytes]] = ([], [])
        for kid in node.kids:
            if isinstance(kid, str):
                text = " ".join(html.unescape(kid).split())
                both = (text.encode(errors="surrogatepass"), re.sub(r"\d+", "0", text).encode(errors="surrogatepass")) if text else None
            else:
                both = content[at[id(kid)]] if id(kid) in at else None
            if both:
                parts[0].append(both[0])
                parts[1].append(both[1])
        if parts[0] and node.tag not in ("article", "main"):
            content[i] = tuple(_digest(b"\0".join([node.label().encode(), *x])) for x in parts)
            found[id(node)] = tuple(int.from_bytes(_digest(path.encode() + b"\0" + c), "little", signed=True) for c in content[i])
    return found


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def template_of(pages: list[Node]) -> frozenset:
    """Template keys of a few different pages of a host (``templates`` counts all of them)."""
    counts = Counter(k for page in pages for k in {x for pair in keys_of(page).values() for x in pair})
    return frozenset(k for k, n in counts.items() if n >= max(AGREE, SHARE * len(pages)))


def induce(pages: list[Node], template: frozenset | None = None) -> dict:
    """Wrapper of the aligned trees: nested ``{"l": label, "r": role, "k": [...]}``, with its template as ``t`` of the root.

    Roles: c content slot, b template or clutter, t content as a whole, n a node to look inside for
    an article, f content whose template is also looked for deeper. ``template`` holds the keys of the
    host's template nodes; without it they are counted on ``pages``.
    """
    template = template_of(pages) if template is None else template
    keys = keys_of(pages[0])
    base = pages[0]
    seen: dict[int, list[Node]] = {}

    def align(a: Node, b: Node):
        seen.setdefault(id(a), []).append(b)
        if a.tag in ("article", "main"):
            return
        for p, q in tree_match(a, b, 6)[1]:
            align(p, q)

    for page in pages[1:]:
        if page.label() == base.label():
            align(base, page)

    def constant(node: Node, but_digits: bool = False) -> bool:
        return id(node) in keys and keys[id(node)][but_digits] in template

    def fixed(node: Node, but_digits: bool = False) -> dict:
        """Template (with its text) or content."""
        if is_clutter(node, False):
            return {"l": node.label(), "r": "b"}
        if constant(node, but_digits):
            return {"l": node.label(), "r": "b", "x": 1 + but_digits}
        return {"l": node.label(), "r": "t"}

    def beside(node: Node) -> dict:
        """A sibling of the main block."""
        return fixed(node, node.tag not in HEADINGS)

    def over_pages(node: Node) -> int:
        return sum(_mass(x, False) for x in [node, *seen.get(id(node), [])])

    def walk(node: Node) -> dict:
        label = node.label()
        if is_clutter(node, False):
            return {"l": label, "r": "b"}
        if node.tag in ("article", "main"):
            return {"l": label, "r": "c"}
        kids = nodes(node)
        if any(_has_article(k) for k in kids):
            return {"l": label, "r": "n", "k": [walk(k) if _has_article(k) else {"l": k.label(), "r": "b"} for k in kids]}
        mass = {id(k): 0 if constant(k) or is_clutter(k, False) else over_pages(k) for k in kids}
        total = sum(mass.values())
        blocks = [k for k in kids if k.tag in dom.BLOCK and k.tag not in ("p", "li", "tr") and k.tag not in HEADINGS]
        best = max(blocks, key=lambda k: mass[id(k)], default=None)
        if best is not None and total and mass[id(best)] >= FOCUS * max(over_pages(node), 1):
            return {"l": label, "r": "f", "k": [walk(k) if k is best else beside(k) for k in kids]}
        return {"l": label, "r": "c", "k": [fixed(k) for k in kids] if any(constant(k) for k in kids) else []}

    return {**walk(base), "t": sorted(template)}


def _skeleton(spec: dict) -> Node:
    tag, _, marks = spec["l"].partition(".")
    node = Node(tag, frozenset(marks.split(".")) if marks else frozenset())
    node.kids = [_skeleton(k) for k in spec.get("k", ())]
    node.size, node.text = ord(spec["r"]), frozenset(spec["t"]) if "t" in spec else spec.get("x")
    return node


def read(page: Node, wrapper: Node) -> list[str] | None:
    """Text blocks of the page's content slots without template nodes; None if the wrapper does not fit."""
    out: list[str] = []
    fits = False
    template = wrapper.text or frozenset()
    keys = keys_of(page) if template else {}

    def is_template(node: Node, plan: Node) -> bool:
        """Clutter by its label, or a node whose own content is the template's (numbers aside, if the wrapper says so)."""
        if plan.size != ord("b"):
            return False
        return plan.text is None or id(node) in keys and keys[id(node)][plan.text - 1] in template

    def aligned(node: Node, plan: Node, found: set[int]):
        for p, q in tree_match(plan, node, 3 if plan.size == ord("f") else 1)[1]:
            if p.size == ord("b"):
                if is_template(q, p):
                    found.add(id(q))
            elif p.size in (ord("f"), ord("c")) and p.kids:
                aligned(q, p, found)

    def walk(node: Node, plan: Node):
        nonlocal fits
        if plan.size in (ord("f"), ord("c")):
            if plan.size == ord("f") and _has_article(node):  # a page with an article gets its own wrapper
                return
            fits = True
            found = {i for i, (exact, _) in keys.items() if exact in template and i != id(node)}
            if plan.kids:
                aligned(node, plan, found)
            text_blocks(node, out, node.tag in ("article", "main"), frozenset(found))
            return
        matched = {id(q): p for p, q in tree_match(plan, node, 3)[1]}
        for kid in nodes(node):
            p = matched.get(id(kid))
            if p is not None and p.size != ord("b"):
                walk(kid, p)
            elif not is_clutter(kid, False) and _has_article(kid):  # an article that no example had
                walk(kid, _skeleton(induce([kid])))

    if page.label() == wrapper.label():
        walk(page, wrapper)
    return out if fits else None


def extract(source: str | None, wrapper: Node | None) -> str:
    """A page that its host's wrapper does not fit gets one of its own; one that would be template as a whole stays whole."""
    page = dom.parse(source or "")
    blocks = read(page, wrapper) if wrapper is not None else None
    template = wrapper.text if wrapper is not None and wrapper.text else frozenset()
    for known in (template, frozenset()) if template else (template,):
        blocks = blocks or read(page, _skeleton(induce([page], known)))
    return "\n\n".join(blocks or [])


def templates(pages: DataFrame) -> DataFrame:
    """``host, template``: keys of the nodes that at least ``SHARE`` of a host's pages hold, and ``AGREE`` of them.

    Counted over all pages without an article (``host, html``; on the others the article is the content); pages
    with equal html count once. A page has as many keys as it has nodes, so a host keeps at most ``2 / SHARE`` times the mean
    number of nodes of a page.
    """
    plain = pages.select("host", "html").filter(~F.coalesce(F.col("html"), F.lit("")).rlike(r"(?i)<(article|main)[\s/>]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {k for pair in keys_of(dom.parse(source or "")).values() for k in pair}
                name = int.from_bytes(_digest((source or "").encode(errors="surrogatepass")), "little", signed=True)
                marks = [*found, None]  # a null key stands for the page itself
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(marks), pa.string()), pa.array(marks, pa.int64()), pa.array([name] * len(marks), pa.int64())],
                                                 ["host", "key", "page"])

    seen = plain.mapInArrow(run, "host string, key long, page long").distinct()
    counts = land(seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")), "node_counts")
    of_host = counts.filter(F.col("key").isNull()).select("host", F.col("n").alias("pages"))
    often = counts.filter(F.col("key").isNotNull() & (F.col("n") >= AGREE)).join(of_host, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) of ``host, page_id, html``."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("page_id", F.lit(29)), "page_id")
    examples = pages.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= EXAMPLES)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        sources = list(dict.fromkeys(h or "" for h in group["html"]))
        keys = group["template"].iloc[0]
        keys = [] if keys is None else [int(k) for k in keys]
        wrapper = induce([dom.parse(s) for s in sources], frozenset(keys))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})

    known = examples.select("host", "html", "rank").join(templates(pages), "host", "left")
    return known.groupBy("host").applyInPandas(run, "host string, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of each page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    plans = land(wrappers(rows.select("host", "page_id", "html")), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for source, plan in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if plan is not None and plan not in known:
                    if len(known) > 1000:  # hosts of one task; only a store
                        known.clear()
                    known[plan] = _skeleton(json.loads(plan))
                texts.append(extract(source, known.get(plan)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.join(plans, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
