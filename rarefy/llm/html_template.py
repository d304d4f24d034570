"""Op 4: main text of web pages by equivalence-class template deduction.

1. A page is read into tokens: its elements (a hash of the tags and names from
   the root) and its text strings (their element and text).
2. Over all pages of a host, the occurrence vector of a token is its count on
   every page.  A vector is as long as the host has pages, so it is never
   built: an order-free 64-bit hash of (page, count) pairs stands for it, which
   Spark sums up with partial aggregation, however large the host.
3. Tokens of a host with equal vectors form an equivalence class.  A class is
   valid if it is large (two element tokens at least) and frequent (on two
   pages at least; a host of one page is its own evidence).  Valid classes
   nest by their paths: that is the host's template.  A string is template
   only if its class stands on nearly all pages of the host, three at least:
   what a few near copies share is their own text.
4. The elements of valid classes that stand once on a page (on ``SLOT_PERCENT``
   of those that have them) are the template's slots.  The host's main slot is
   the article element (``article``, ``main``) that holds most of the free
   text, or else the lowest container that holds all free text of all pages but
   strings of the template; a page's own article element goes first.  Names of
   elements that stand on under ``NAMED_PERCENT`` of a host's pages are judged
   by the page, the others by the host.  Free text excludes
   links (not linked headings) and the parts that are no article (menus,
   headers, footers, sidebars, notices, adverts, forms, comments, ...): elements
   of such a tag, or of such a class, id or role.  A name alone excludes no
   element around the main slot and none that holds most of the free text of
   the pages it stands on.
5. Each page's blocks in the main slot are its text; blocks that hold nothing
   but strings of the template are left out unless they stand in an article
   element.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, on_workers, with_row_id

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NUMBERED = re.compile(r"\d+")

# HTML element names.
RAW = ("script", "style", "textarea", "iframe", "title")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr br svg math mi mn mo mtext ms mrow mfrac msqrt "
    "mroot msub msup msubsup munder mover munderover mstyle semantics canvas object".split())
OUTSIDE = frozenset("nav footer aside form head script style noscript template button select menu "
                    "dialog iframe svg fieldset".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of a text: the main slot is an element around them.
PARTS = INLINE | HEADINGS | frozenset(
    "p hgroup ul ol li dl dt dd pre blockquote figure figcaption address".split())
# An opening tag ends open elements of these kinds first.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article main section div td th ul ol table dl blockquote nav aside "
                   "header footer form".split())
# Names are whole words of a class, id or role.
OUTSIDE_NAMES = re.compile(
    r"ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert"
    r"|newsletter|subscribe|subscription|sidebar|side|rail|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|header|masthead|comments?|respond|replies|disqus|share|sharing|social|related"
    r"|recommended|widget|popup|modal|login|signup|pagination|pager|complementary|contentinfo"
    r"|search", re.I)
HEADERS = frozenset(["header", "masthead", "banner"])
# Named elements on fewer of a host's pages (in hundredths) are judged on each page.
NAMED_PERCENT = 1
# Strings of the template stand on so many of a host's pages (in hundredths), and on so many at least.
TEMPLATE_PERCENT = 90
TEMPLATE_PAGES = 3
# A slot stands exactly once on so many (in hundredths) of the pages that have it.
SLOT_PERCENT = 80


@dataclass(eq=False, slots=True)
class Node:
    """An open element.  Its token is a hash of its tag and names and of the token around it:
    elements of one path from the root share it, and no path is spelled out."""
    tag: str
    sign: str
    token: int
    number: int
    depth: int
    parent: Node | None
    outside: bool
    article: bool
    link: bool
    heading: bool = False
    named: bool = False  # has a name of OUTSIDE_NAMES


@dataclass(eq=False, slots=True)
class Text:
    """A text string, the element it stands in and its block's number."""
    text: str
    last: Node
    block: int


ROOT_TOKEN = 0


def _token(around: int, sign: str) -> int:
    from xxhash import xxh64_intdigest
    return _signed(xxh64_intdigest(f"{around}>{sign}"))


def _open(parent: Node, tag: str, attributes: str, number: int) -> Node:
    names = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
    article = parent.article or tag in ARTICLE
    outside = parent.outside or tag in OUTSIDE or (tag == "header" and not article)
    # A heading part inside an article belongs to it.
    named = tag not in ("html", "body") and any(
        OUTSIDE_NAMES.fullmatch(x) and not (article and x.lower() in HEADERS) for x in names.split())
    sign = tag + ("." + ".".join(sorted(NUMBERED.sub("0", names).split())) if names else "")
    heading = parent.heading or tag in HEADINGS
    return Node(tag, sign, _token(parent.token, sign), number, parent.depth + 1, parent, outside, article,
                (parent.link or tag == "a") and not heading, heading, named)


def read_page(page: str) -> tuple[list[Text], list[Node]]:
    """The page's text strings and the elements it opens, in order.

    Time and memory follow the page's length, however deep its elements nest.
    """
    texts: list[Text] = []
    root = Node("", "", ROOT_TOKEN, 0, 0, None, False, False, False)
    opened: list[Node] = []
    stack = [root]
    standing: Counter[str] = Counter()  # open elements by tag
    block, at = 0, 0

    def text(part: str) -> None:
        if part:
            texts.append(Text(charrefs.unescape(part), stack[-1], block))

    def close(i: int) -> None:
        for n in stack[i:]:
            standing[n.tag] -= 1
        del stack[i:]

    while at < len(page):
        found = MARKUP.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        tag = (found.group(2) or found.group(5) or "").lower()
        if not tag:
            continue
        if found.group(1) or found.group(4):
            at_tag = 0
            if standing[tag] > 0:
                at_tag = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
            # An inline end tag does not end the block around it.
            if at_tag and not (tag in INLINE and any(n.tag in SCOPES for n in stack[at_tag + 1:])):
                close(at_tag)
            if tag not in INLINE:
                block += 1
            continue
        attributes = found.group(3) or found.group(6) or ""
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text(" ")
        if tag not in INLINE:
            block += 1
            ends = ENDS.get(tag) or ({"p"} if tag not in ("html", "head", "body") else set())
            if any(standing[t] > 0 for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in SCOPES and stack[i].tag not in ends:
                        break
        node = _open(stack[-1], tag, attributes, len(opened) + 1)
        opened.append(node)
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            standing[tag] += 1
    return texts, opened


def _free_size(t: Text) -> int:
    """Characters of free text, whatever the names around it."""
    return 0 if t.last.outside or t.last.link else len(t.text.strip())


def _free_text(texts: list[Text]) -> dict[int, list]:
    """Token -> [characters of free text under it, is an article element, depth, may be a slot].

    In the order of the page; sizes are summed up from the deepest elements to
    the root, an element at a time.
    """
    free: dict[Node, int] = {}
    for t in texts:
        size = _free_size(t)
        if size:
            n = t.last
            free[n] = free.get(n, 0) + size
            while (n := n.parent) is not None and n not in free:
                free[n] = 0
    for n in sorted(free, key=lambda n: -n.depth):
        if n.parent is not None:
            free[n.parent] += free[n]
    mass: dict[int, list] = {}
    for n in sorted(free, key=lambda n: n.number):
        mass.setdefault(n.token, [0, n.tag in ARTICLE, n.depth, n.tag not in PARTS])[0] += free[n]
    return mass


def _below(texts: list[Text], test: Callable[[Node], bool]) -> list[bool]:
    """Whether each text stands in an element that passes ``test``; each element is tested once."""
    known: dict[Node, bool] = {}
    out = []
    for t in texts:
        n, way = t.last, []
        while n is not None and n not in known:
            if test(n):
                known[n] = True
                break
            way.append(n)
            n = n.parent
        found = n is not None and known[n]
        known.update((w, found) for w in way)
        out.append(found)
    return out


def _named(texts: list[Text]) -> set[int]:
    """Tokens of the elements around the texts that have a name of OUTSIDE_NAMES."""
    seen: set[Node] = set()
    out = set()
    for t in texts:
        n = t.last
        while n is not None and n not in seen:
            seen.add(n)
            if n.named:
                out.add(n.token)
            n = n.parent
    return out


def _around(texts: list[Text], slot: int | None) -> set[int]:
    """Tokens of a slot of the page and of all elements around it."""
    out: set[int] = set()
    seen: set[Node] = set()
    for t in texts:
        n = t.last
        while n is not None and n not in seen and n.token != slot:
            seen.add(n)
            n = n.parent
        if n is not None and n.token == slot:
            while n is not None and n.token not in out:
                out.add(n.token)
                n = n.parent
    return out


def excluded(texts: list[Text], slot: int | None, judged: dict[int, bool]) -> set[int]:
    """Tokens whose name excludes them on a page; ``judged``: the host's verdicts."""
    mass = _free_text(texts)
    whole = mass[ROOT_TOKEN][0] if mass else 0
    out = {p for p in _named(texts) if judged.get(p, 2 * mass.get(p, (0,))[0] <= whole)}
    return out - _around(texts, slot) if slot is not None and out else out


def _string_token(t: Text, words: str) -> int:
    return _token(t.last.token, f"\n{words}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and distinct token: count, free text, and for elements depth and kind.

    Elements with a name of OUTSIDE_NAMES have the page's free text, too.
    """
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
    for batch in batches:
        rows, at = [], []
        for i, page in enumerate(batch.column(2)):
            texts, opened = read_page(page.as_py())
            mass = _free_text(texts)
            whole = mass[ROOT_TOKEN][0] if mass else 0
            named = _named(texts)
            count = Counter(n.token for n in opened)
            for token, n in count.items():
                size, article, depth, slot = mass.get(token, (0, False, 0, False))
                rows.append((token, n, True, depth, size, article, slot, whole if token in named else None))
            strings: dict[int, list] = {}
            for t in texts:
                words = " ".join(t.text.split())
                if words:
                    got = strings.setdefault(_string_token(t, words), [0, 0])
                    got[0] += 1
                    got[1] += _free_size(t)
            rows += [(token, n, False, 0, size, False, False, None) for token, (n, size) in strings.items()]
            at += [i] * (len(count) + len(strings))
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
            names=["_row", "host", "token", "n", "element", "depth", "free", "article", "slot", "whole"])


def main_slot(mass: dict[int, list]) -> int | None:
    """The element that holds a page's article, by the rule for hosts."""
    if not mass:
        return None
    articles = {p: m for p, m in mass.items() if m[1]}
    if articles:
        return max(articles, key=lambda p: (articles[p][0], -articles[p][2]))
    # The root holds all; those that do stand in each other.
    return max((p for p, m in mass.items() if m[3] and m[0] == mass[ROOT_TOKEN][0]), key=lambda p: mass[p][2])


def own_container(page: str, template: frozenset[int], judged: dict[int, bool]) -> list[int]:
    """Tokens of the elements that hold all of a page's own free text, outermost first.

    Own: not of the host's template, nor in parts that their name excludes.
    """
    texts = [t for t in read_page(page)[0] if _free_size(t)]
    out = excluded(texts, None, judged)
    if out:
        texts = [t for t, x in zip(texts, _below(texts, lambda n: n.named and n.token in out)) if not x]
    own = [t for t in texts if _string_token(t, " ".join(t.text.split())) not in template]
    mass = _free_text(own)
    return [p for p, m in mass.items() if m[0] == mass[ROOT_TOKEN][0]]


def page_text(page: str, slot: int | None = None, template: frozenset[int] = frozenset(),
              judged: dict[int, bool] | None = None) -> str:
    """The blocks of the main slot, one per line."""
    texts = [t for t in read_page(page)[0] if not t.last.outside]
    judged = judged or {}
    mass = _free_text(texts)
    if any(m[1] for m in mass.values()):
        # A page's own article element is its slot, whatever the host's or the names around it.
        if slot not in mass or not mass[slot][1]:
            slot = main_slot(mass)
    elif slot is not None and not any(_below(texts, lambda n: n.token == slot)):
        slot = None
    out = excluded(texts, slot, judged)
    named = texts
    if out:
        named = [t for t, x in zip(texts, _below(texts, lambda n: n.named and n.token in out)) if not x]
    # A page of which the names or the template leave nothing is kept whole.
    return _slot_text(named, slot, template) or (_slot_text(texts, slot, template) if out else "")


def _slot_text(texts: list[Text], slot: int | None, template: frozenset[int]) -> str:
    if slot is None:
        own = [t for t in texts if not template or t.last.article
               or _string_token(t, " ".join(t.text.split())) not in template]
        slot = main_slot(_free_text(own) or _free_text(texts))
    if slot is None:
        return ""
    inside = [t for t, x in zip(texts, _below(texts, lambda n: n.token == slot)) if x]

    def blocks(skip: frozenset[int]) -> str:
        parts: dict[int, list[str]] = {}
        own: set[int] = set()  # blocks that hold more than template strings
        for t in inside:
            parts.setdefault(t.block, []).append(t.text)
            words = " ".join(t.text.split()) if skip else ""
            if words and (t.last.article or _string_token(t, words) not in skip):
                own.add(t.block)
        lines = (" ".join("".join(p).split()) for k, p in sorted(parts.items()) if k in own or not skip)
        return "\n".join(x for x in lines if x)

    return blocks(template) or blocks(frozenset())


def _verdicts(judged: list | None) -> dict[int, bool]:
    return {x["token"]: x["out"] for x in judged or ()}


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page and element that holds all its own free text."""
    for batch in batches:
        template, judged = (batch.column(k).to_pylist() for k in (2, 3))
        found = [own_container(p.as_py(), frozenset(template[i] or ()), _verdicts(judged[i]))
                 for i, p in enumerate(batch.column(1))]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array([p for f in found for p in f], pa.int64())],
            names=["host", "token"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, template, judged = (batch.column(k).to_pylist() for k in (3, 4, 5))
        found = [page_text(p.as_py(), slots[i], frozenset(template[i] or ()), _verdicts(judged[i]))
                 for i, p in enumerate(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            names=["page", "url", "text", "n_chars"])


def host_templates(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, article_slot, strings, judged`` and the template's slots (``host, token, depth``).

    ``tokens``: the rows of :func:`_tokens`.
    """
    vector = F.bit_xor(F.xxhash64("_row", "n"))
    per_token = materialise(tokens.groupBy("host", "token").agg(
        vector.alias("vector"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") == 1).alias("single"),
        F.max("element").alias("element"), F.max("depth").alias("depth"),
        F.sum("free").alias("free"), F.max("article").alias("article"), F.max("slot").alias("slot"),
        F.sum("whole").alias("whole")))
    classes = per_token.groupBy("host", "vector").agg(
        F.count_if("element").alias("elements"), F.max("pages").alias("pages"))
    hosts = per_token.groupBy("host").agg(F.max("pages").alias("host_pages"))
    valid = (classes.join(hosts, "host")
             .where((F.col("elements") >= 2) & ((F.col("pages") >= 2) | (F.col("host_pages") == 1)))
             .select("host", "vector", "host_pages"))
    inside = materialise(per_token.join(valid, ["host", "vector"]))
    # Slots: elements of valid classes that stand once on nearly every page they stand on.
    slots = inside.where("element and free > 0").where(
        100 * F.col("single") >= SLOT_PERCENT * F.col("pages"))
    articles = slots.where("article").groupBy("host").agg(
        F.max_by("token", F.struct("free", -F.col("depth"), "token")).alias("article_slot"))
    template = (inside.where("NOT element")
                .where((F.col("pages") >= TEMPLATE_PAGES)
                       & (100 * F.col("pages") >= TEMPLATE_PERCENT * F.col("host_pages")))
                .select("host", "token"))
    # Each of these stands on TEMPLATE_PERCENT of the host's pages: there are at most
    # 100 / TEMPLATE_PERCENT times as many as an average page of the host has strings.
    strings = template.groupBy("host").agg(F.collect_list("token").alias("strings"))
    judged = (per_token.where("whole is not null").join(hosts, "host")
              .where(100 * F.col("pages") >= NAMED_PERCENT * F.col("host_pages"))
              .groupBy("host").agg(F.collect_list(F.struct(
                  "token", (2 * F.col("free") <= F.col("whole")).alias("out"))).alias("judged")))
    found = (hosts.select("host").join(articles, "host", "left").join(strings, "host", "left")
             .join(judged, "host", "left"))
    return materialise(found), slots.where("slot").select("host", "token", "depth")


def lowest_containers(pages: DataFrame, templates: DataFrame, slots: DataFrame) -> DataFrame:
    """``host, lowest``: the lowest slot that holds all own free text of all pages of its host.

    Only for hosts without an article element.  ``pages``: (``host, html``).
    """
    asked = templates.where("article_slot is null").select("host", "strings", "judged")
    held = materialise(pages.join(asked, "host").select("host", "html", "strings", "judged")
                       .mapInArrow(on_workers(_containers), "host string, token bigint")
                       .groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages")))
    every = held.where(F.col("token") == ROOT_TOKEN).select("host", F.col("pages").alias("every"))
    return (held.join(every, "host").where("pages = every").join(slots, ["host", "token"])
            .groupBy("host").agg(F.max_by("token", "depth").alias("lowest")))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                      html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null and empty pages have an empty text.  Pages without a url form one
    host.  Repeated rows and null ids are kept; other columns are ignored; an
    empty table gives no rows.  Pages are read whole, twice; pages of hosts
    without an article element once more, for their lowest common container.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][^:/?#]*://([^/?#]*)", 1)), F.lit(""))
    page = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), host.alias("host"),
                        page.alias("html"))
    tokens = with_row_id(rows).select("_row", "host", "html").mapInArrow(
        on_workers(_tokens), "_row bigint, host string, token bigint, n int, element boolean, "
                             "depth int, free bigint, article boolean, slot boolean, whole bigint")
    found, slots = host_templates(tokens)
    lowest = lowest_containers(rows.select("host", "html"), found, slots)
    templates = materialise(found.join(lowest, "host", "left").select(
        "host", F.coalesce("article_slot", "lowest").alias("slot"), "strings", "judged"))
    kinds = dict(rows.dtypes)
    out = (rows.join(templates, "host", "left").select("page", "url", "html", "slot", "strings", "judged")
           .mapInArrow(on_workers(_extract),
                       f"page {kinds['page']}, url {kinds['url']}, text string, n_chars bigint"))
    return out.withColumnsRenamed({"page": page_id, "url": url})
