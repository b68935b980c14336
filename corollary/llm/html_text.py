"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: containers, told apart by the path of containers they stand in (a
token's role, kept as 64 bits of its parent's role and its name), and blocks of text between them. Over the pages of a host each role has an occurrence
vector, how often it occurs in each page; roles with equal vectors form an equivalence class. A vector
is kept as a sum of 64-bit page hashes times counts, so classes come from one hash aggregate, with
partial sums before the shuffle, and no host's pages meet in one task.

A class is valid if it stands in enough of the host's pages, once in a page, and nests: each role's
parent is of a valid class too. Valid classes nest by their roles' paths; together they are the host's
template. What stands between a role and the template roles inside it is its slot. Slots are told by what
all pages of the host have in them:

* the same text in nearly all pages, while the pages differ: template text;
* text that is mostly links: a menu;
* text that is mostly inside of repeated containers, beside a slot of running text: a list, such as
  readers' comments or teasers;
* the rest is content.

From the root the template is descended as long as one role holds nearly all content; that role is the
host's main slot. Where the pages tell nothing (hosts with one page, slots that are content by all
marks), element and class names break the tie (fixed lists below): of what stands beside the main slot
by any word in a name, but never what holds most of the content; inside the main slot only elements and
whole names that are no article text by definition. A page without its host's main slot is its own
template.

The text is the main slot's blocks in page order. Character references are decoded, white space in a
block becomes one space, empty blocks go; blocks are joined by a line feed. Null and empty pages have
an empty text. Repeated rows count as often as they stand there. Pages are parsed whole, twice: for
their roles and for their text, each in time linear in their length, however deep they nest. Rows and
cells of tables and items of lists end where their next one begins, as their end tags are optional.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_right
from collections import Counter
from hashlib import blake2b
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import checkpoint, map_rows

#: Share of a host's pages in which a template role stands; of content that the main slot holds, and of
#: pages with the same text; of content that an article holds; of text in links, and in repeated containers.
SUPPORT, NEARLY_ALL, MOST, LINKED, LISTED = 0.5, 0.9, 0.5, 0.5, 0.8
#: A role of running text that holds so much of all content makes lists beside it no content.
RUNNING = 0.2
#: Slots of so many bytes together are broadcast; more are joined.
SMALL = 32 << 20
#: Pages of a host in one part of the join with its slot.
PART = 2048

# Elements and class words by what they are.
RAW = ("script", "style", "textarea", "title")
#: Left out with all inside them, if they are closed.
EMBEDDED = ("noscript", "template", "iframe", "svg", "math", "object", "select", "canvas", "audio", "video")
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button"}
BOILERPLATE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "popup", "modal", "overlay", "comment", "comments", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "search", "pagination", "pager", "toolbar", "widget"}
#: Inside of the main slot only these elements, and these whole names, are no content.
NO_ARTICLE = {"nav", "footer", "aside", "form", "head", "menu"}
NO_ARTICLE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsored", "navigation", "navbar", "sidebar", "cookie-notice", "cookie-banner", "cookie-consent", "comments", "comment-list", "disqus_thread"}
#: A class with one of these names a place of content, whatever else it names.
CONTENT_WORDS = {"with", "has", "no", "content", "article", "layout"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "button", "ul", "ol", "li", "figure", "fieldset", "details", "center"}
SLOTS = {"html", "body", "div", "section", "article", "main", "td", "center"}
#: What an element's start ends, if it is open, and what keeps that from being reached.
ENDS = {"li": ("li",)} | {t: ("td", "th") for t in ("td", "th")} | {"tr": ("td", "th", "tr")} | {t: ("td", "th", "tr", "thead", "tbody", "tfoot") for t in ("thead", "tbody", "tfoot")}
WALLS = {"li": ("ul", "ol", "menu", "table", "td", "section", "article", "nav", "body")} | {t: ("table",) for t in ("td", "th", "tr", "tbody", "thead", "tfoot")}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_PAIRS = {t: re.compile(rf"<(/?){t}(?=[\s/>])((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*)>", re.I) for t in EMBEDDED}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]{3,}")
_SPACE = re.compile(r"\s+")


def _role(tag: str, rest: str) -> tuple[str, int]:
    """A container's name in a path (element and first class or id, long numbers as one mark), and what its
    names say: 0 nothing, 1 boilerplate beside the main slot, 2 also inside of it."""
    bad, name = (tag in BOILERPLATE) + (tag in NO_ARTICLE), tag
    if "=" in rest:
        for key, *values in _ATTRIBUTE.findall(rest):
            value = (values[0] or values[1] or values[2]).lower()
            if key.lower() == "role":
                bad = max(bad, int(bool(set(_WORDS.findall(value)) & BOILERPLATE_ROLES)))
                continue
            for one in value.split() if tag not in ("html", "body") else ():
                words = set(_WORDS.findall(one))
                if words & BOILERPLATE_WORDS and not words & CONTENT_WORDS:
                    bad = max(bad, 1 + (one in NO_ARTICLE_NAMES))
            if name == tag and value.split():
                name = f"{tag}.{_DIGITS.sub('#', value.split()[0])}"
    return name, bad


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where each closed element of this name begins and ends. One that closes itself, or that nothing
    closes, is no such element: what follows it is the page's."""
    out, opened = {}, []
    for m in _PAIRS[tag].finditer(page):
        if not m.group(1):
            if not m.group(2).endswith("/"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def blocks(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The page's text blocks as (container, text, characters in links), and its containers as
    (parent, name, what names say); container 0 is the page itself. Every piece of text is in one block."""
    nodes: list[tuple[int, str, int]] = [(-1, "", 0)]
    stack: list[tuple[str, int]] = []  # open containers
    open_at: dict[str, list[int]] = {}  # their places in the stack, by element
    out: list[tuple[int, str, int]] = []
    piece: list[str] = []
    here, linked, in_link = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if text:
                out.append((here, text, min(linked, len(text))))
            piece.clear()
            linked = 0

    def last(*names: str) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def close(place: int) -> None:
        for name, _ in stack[place:]:
            open_at[name].pop()
        del stack[place:]

    at, closed = 0, {}
    tokens = _TOKEN.finditer(page)
    while m := next(tokens, None):
        if m.start() > at:
            piece.append(page[at : m.start()])
            linked += in_link * (m.start() - at)
        at = m.end()
        tag = m.group("tag")
        if not tag:
            continue
        tag = tag.lower()
        if tag in _PAIRS:
            if not m.group("end"):
                if tag not in closed:
                    closed[tag] = _closed(page, tag)
                if end := closed[tag].get(m.start()):
                    at, tokens = end, _TOKEN.finditer(page, end)
            continue
        if tag == "br":
            piece.append(" ")
        elif tag == "a":
            in_link = not m.group("end")
        if tag in BLOCKS:
            flush()
        if tag not in CONTAINERS:
            continue
        flush()
        if m.group("end"):
            if (place := last(tag)) > last(*WALLS.get(tag, ())):
                close(place)
        else:
            rest, wall = m.group("rest"), last(*WALLS.get(tag, ()))
            # the outermost of those that end here
            ending = [open_at[n][bisect_right(open_at[n], wall)] for n in ENDS.get(tag, ()) if open_at.get(n) and open_at[n][-1] > wall]
            if ending:
                close(min(ending))
            name, bad = _role(tag, rest)
            parent = stack[-1][1] if stack else 0
            nodes.append((parent, name, max(bad, nodes[parent][2])))
            if not rest.endswith("/"):
                open_at.setdefault(tag, []).append(len(stack))
                stack.append((tag, len(nodes) - 1))
        here = stack[-1][1] if stack else 0
    if at < len(page):
        piece.append(page[at:])
    flush()
    return out, nodes


def role_ids(nodes) -> list[int]:
    """Each container's role: 64 bits of its parent's role and its name; the page itself has 0."""
    out, known = [0], {}
    for parent, name, _ in nodes[1:]:
        key = (out[parent], name)
        if key not in known:
            known[key] = int.from_bytes(blake2b(f"{out[parent]}>{name}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
        out.append(known[key])
    return out


@dataclass
class Role:
    """What the pages of a host have in a role: characters outside of links, in links, outside of links
    and in repeated containers; whether it is the same text in nearly all pages; what its names say; the
    role round it, its element, and how deep it stands."""

    chars: int
    linked: int
    listed: int
    same: bool = False
    bad: int = 0
    parent: int = 0
    tag: str = ""
    depth: int = 0


def _stats(found, nodes, roles) -> list[list[int]]:
    """For each container and all inside it: characters outside of links, in links, in repeated containers."""
    count = Counter(roles)
    repeated = [False] * len(nodes)
    for i, (parent, _, _) in enumerate(nodes):
        repeated[i] = i > 0 and (repeated[parent] or count[roles[i]] > 1)
    out = [[0, 0, 0] for _ in nodes]
    for node, text, linked in found:
        o, n = out[node], len(text) - linked
        o[0] += n
        o[1] += linked
        o[2] += n * repeated[node]
    for i in range(len(nodes) - 1, 0, -1):
        o, p = out[i], out[nodes[i][0]]
        p[0] += o[0]
        p[1] += o[1]
        p[2] += o[2]
    return out


def _depths(nodes) -> list[int]:
    out = [0] * len(nodes)
    for i, (parent, _, _) in enumerate(nodes[1:], 1):
        out[i] = out[parent] + 1
    return out


def choose(roles: dict[int, Role]) -> tuple[int, list[int]]:
    """The main slot among template roles, and the roles that are left out of it. With a role all roles
    round it are there; 0 is the page."""
    order = sorted(roles, key=lambda p: (-roles[p].depth, p))  # what is inside comes first
    inside: dict[int, list[int]] = {p: [] for p in roles}
    for p in order:
        if p:
            inside[roles[p].parent].append(p)
    content: dict[int, int] = {}
    out: set[int] = set()

    def weigh() -> None:
        for p in order:
            r = roles[p]
            content[p] = 0 if p in out else r.chars - sum(roles[k].chars for k in inside[p]) + sum(content[k] for k in inside[p])

    for p in order:
        r = roles[p]
        if p and (r.same or r.linked and r.linked >= LINKED * (r.chars + r.linked)):
            out.add(p)
    weigh()
    total = content[0]
    # lists beside running text
    listed = {p for p in roles if p and roles[p].chars and roles[p].listed >= LISTED * roles[p].chars}
    for kids in inside.values():
        if any(k not in listed and k not in out and content[k] >= RUNNING * total for k in kids):
            out |= {k for k in kids if k in listed and roles[k].tag not in ("article", "main")}
    weigh()
    total = content[0]
    # names break ties, but never take what holds most of the content
    for p in order:
        if p and roles[p].bad and p not in out and 2 * content[p] < total:
            out.add(p)
    weigh()
    best, total = 0, content[0]
    articles = [p for p in roles if total and p and roles[p].tag in ("article", "main") and content[p] >= MOST * total]
    if articles:  # the outermost
        best = min(articles, key=lambda p: (roles[p].depth, -content[p], p))
    while total and not articles:
        kids = [k for k in inside[best] if roles[k].tag in SLOTS and content[k] >= NEARLY_ALL * total]
        if not kids:
            break
        best = kids[0]
    # inside of a content slot only what is no article text by definition goes
    going = out if roles[best].tag in ("", "html", "body") else {p for p in out if roles[p].bad > 1}
    left, below = [], [best]
    while below:  # the outermost of those inside of the slot
        for k in inside[below.pop()]:
            (left if k in going else below).append(k)
    return best, sorted(left)


def own_template(found, nodes, ids) -> tuple[int, list[int]]:
    """The main slot of a page that is its own template: roles that occur once, outside of others."""
    count = Counter(ids)
    own: dict[int, Role] = {}
    for i, (s, n, depth) in enumerate(zip(_stats(found, nodes, ids), nodes, _depths(nodes))):
        if i == 0 or count[ids[i]] == 1 and ids[n[0]] in own:
            own[ids[i]] = Role(*s, bad=n[2], parent=ids[max(n[0], 0)], tag=n[1].partition(".")[0], depth=depth)
    return choose(own)


def extract(page: str | None, slot: int | None, left_out: list[int] | tuple[int, ...] = ()) -> str:
    """The page's main text. slot: its host's main slot, if known; left_out: roles in it without
    content. If nothing would be left, the page is its own template."""
    if not page:
        return ""
    found, nodes = blocks(page)
    ids = role_ids(nodes)
    text = _inside(found, nodes, ids, slot, left_out) if slot is not None else ""
    return text or _inside(found, nodes, ids, *own_template(found, nodes, ids)) or _inside(found, nodes, ids, 0, ())


def _inside(found, nodes, ids, slot, left_out) -> str:
    top = next((n for i, n in zip(ids, nodes) if i == slot), None)
    if top is None:
        return ""
    worst = 0 if top[1].partition(".")[0] in ("", "html", "body") else 1  # what names may say inside of the slot
    inside, out = [False] * len(nodes), set(left_out)
    for i, (parent, _, bad) in enumerate(nodes):
        inside[i] = ids[i] not in out and (bad <= worst or bad <= top[2]) and (ids[i] == slot or (i > 0 and inside[parent]))
    return "\n".join(text for node, text, _ in found if inside[node])


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


_SUMS, _WHAT = ("pages", "chars", "linked", "listed"), ("parent", "tag", "depth")


def _roles(df: DataFrame) -> DataFrame:
    """host, role, what it is (parent, tag, depth), vector, most (occurrences in a page), bad, the sums over a
    batch's pages, and the bounds of the hashes of the role's text (least, greatest)."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            what: dict[int, tuple[int, str, int]] = {}
            for name, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                if not page:
                    continue
                found, nodes = blocks(page)
                ids = role_ids(nodes)
                held: dict[int, list[int]] = {}
                for role, stats, text, node, depth in zip(ids, _stats(found, nodes, ids), _text_hashes(found, nodes), nodes, _depths(nodes)):
                    if role not in held:
                        held[role] = [0, 0, 0, 0, 0, 0]
                        what[role] = (ids[max(node[0], 0)], node[1].partition(".")[0], depth)
                    h = held[role]
                    h[0] += 1
                    h[1] += stats[0]
                    h[2] += stats[1]
                    h[3] += stats[2]
                    h[4] = text
                    h[5] = max(h[5], node[2])
                for role, (count, chars, linked, listed, text, bad) in held.items():
                    s = sums.setdefault((name, role), [0, 0, 0, 0, 0, 0, text, text, 0])
                    s[0] = (s[0] + key * count) & 0xFFFFFFFFFFFFFFFF
                    s[1] = max(s[1], count)
                    for i, v in enumerate((1, chars, linked, listed), 2):
                        s[i] += v
                    s[6], s[7], s[8] = min(s[6], text), max(s[7], text), max(s[8], bad)
            rows = list(sums.items())
            vector = np.array([v[0] for _, v in rows], np.uint64).astype(np.int64)
            told = [pa.array([what[k[1]][i] for k, _ in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), *told, pa.array(vector, pa.int64()), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(1, 9))], names=["host", "role", *_WHAT, "vector", "most", *_SUMS, "least", "greatest", "bad"])

    return df.mapInArrow(run, "host string,role long,parent long,tag string,depth long,vector long,most long,pages long,chars long,linked long,listed long,least long,greatest long,bad long")


def _text_hashes(found, nodes) -> list[int]:
    """A hash of all text in each container and inside it."""
    out = [0] * len(nodes)
    for node, text, _ in found:
        out[node] = zlib.crc32(text.encode("utf-8", "replace"), out[node]) | (len(text) & 0x3FFFFFF) << 32
    for i in range(len(nodes) - 1, 0, -1):
        if out[i]:
            out[nodes[i][0]] = (out[nodes[i][0]] * 31 + out[i]) & 0x7FFFFFFFFFFFFFFF
    return out


def templates(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT) -> DataFrame:
    """host, role, class, of (the host's pages), pages, chars, linked, listed, same, bad, parent, tag, depth: the roles of
    classes that stand in enough of the host's pages, once in a page. A host has at most 1 / support
    times as many as one page has containers."""
    seed = F.xxhash64(F.col(id_col).cast("string"), F.col(html_col))
    roles = _roles(df.select(host(F.col(url_col)).alias("host"), seed.alias("key"), F.col(html_col).alias("html")))
    # vectors are sums modulo 2 ** 64: decimals hold the partial sums exactly
    total = F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.expr("cast('18446744073709551616' as decimal(38,0))"))
    merged = checkpoint(roles.groupBy("host", "role").agg(total.cast("string").alias("class"), F.max("most").alias("most"), *(F.sum(c).alias(c) for c in _SUMS), (F.min("least") == F.max("greatest")).alias("same"), *(F.max(c).alias(c) for c in ("bad", *_WHAT))))
    hosts = merged.where("role = 0").select("host", F.col("pages").alias("of"), F.col("same").alias("alike"))
    often = merged.join(hosts, "host").where((F.col("most") == 1) & (F.col("pages") >= support * F.col("of")) & (F.col("of") > 1))
    constant = F.col("same") & ~F.col("alike") & (F.col("pages") >= NEARLY_ALL * F.col("of")) & (F.col("pages") > 1)
    return often.select("host", "role", "class", "of", "pages", "chars", "linked", "listed", constant.alias("same"), "bad", *_WHAT)


def main_slots(found: DataFrame) -> DataFrame:
    """host, of, slot, left_out (roles without content), size (roles of the template)."""

    def pick(t: pa.Table) -> pa.Table:
        rows = {r["role"]: r for r in t.to_pylist()}
        classes: dict[str, list[int]] = {}
        for p, r in rows.items():
            classes.setdefault(r["class"], []).append(p)
        # a class nests if each of its roles stands in a role of a class that does: of two roles that a page
        # has once each, the inner one cannot be in more pages, so parents come first by their depth
        valid: set[int] = set()
        for members in sorted(classes.values(), key=lambda m: (-rows[m[0]]["pages"], min(rows[p]["depth"] for p in m), min(m))):
            inner = set(members)
            if all(not p or rows[p]["parent"] in valid or rows[p]["parent"] in inner for p in members):
                valid |= inner
        slot, left = choose({p: Role(*(rows[p][c] for c in ("chars", "linked", "listed", "same", "bad", *_WHAT))) for p in valid}) if 0 in valid else (0, [])
        return pa.table({"host": [t.column("host")[0].as_py()], "of": [t.column("of")[0].as_py()], "slot": [slot], "left_out": pa.array([left], pa.list_(pa.int64())), "size": [len(valid)]})

    return found.groupBy("host").applyInArrow(pick, "host string,of long,slot long,left_out array<long>,size long")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = SUPPORT, small: int = SMALL) -> DataFrame:
    """One row per input row: id, url, text, n_chars. support over 1: each page is its own template."""
    slots = checkpoint(main_slots(templates(df, id_col, url_col, html_col, support)))
    size = slots.agg(F.sum(F.length("host") + 8 * F.size("left_out") + 64).alias("bytes"), F.max("of").alias("of")).first()
    pages = df.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host(F.col(url_col)))
    chosen = slots.select("host", "slot", "left_out")
    if (size.bytes or 0) <= small:
        both = pages.join(F.broadcast(chosen), "host", "left")
    else:  # a host may have a third of all pages: they are dealt over parts, its slot goes to each that is there
        pages = pages.withColumn("part", F.pmod(F.xxhash64(id_col, "html"), F.lit(-(-size.of // PART))))
        both = pages.join(pages.select("host", "part").distinct().join(chosen, "host"), ["host", "part"], "left")

    def rows(ids, urls, texts, slot, left_out):
        text = [extract(t, s, f or ()) for t, s, f in zip(texts, slot, left_out)]
        return {id_col: ids, "url": urls, "text": text, "n_chars": [len(t) for t in text]}

    return map_rows(both, [id_col, "url", "html", "slot", "left_out"], f"{id_col} long,url string,text string,n_chars long", rows, by="html")
