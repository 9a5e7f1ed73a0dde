"""Main text of web pages by consensus of their hosts.

1. Each page is read once as a stream of tags and text (malformed markup closes what it has to).
   Text in elements that are never the article (menus, footers, asides, forms, scripts, ...) is
   dropped, and so is that of containers whose class, id or role names such a part, unless they
   hold most of the page's text or an article (see _kept), or nothing else is left. The rest counts for the containers
   around it, text in links not at all. From the root the best container is found by steps into
   a child, as long as nothing beside the child is article content: no text of the parent's own,
   no heading that could be the title, no container named like an article, and at most 1 - SHARE
   of the parent's text. An article or main that is the only one, holds half of the text and has
   no higher heading beside it is stepped into as well; nothing within it is. Lists, tables,
   quotes and figures are never stepped into.
2. Its path of tags and classes, with digits generalised, gets a vote of the page. Votes are
   summed by (host, path) in Spark; the winners are all paths with 1 / VOTES of their host's votes
   or more, best first. The paths beside the way to a winner on half or more of the pages that
   voted for it are known to lie outside of the article.
3. Each page is read again: all containers with the first winning path that the page has, and
   that holds SHARE of what isn't known to lie outside, give the text. A page without any falls
   back on its own best container.

White space inside a block becomes one space, blocks are joined by one space in page order; br
and block tags part words, inline tags don't. Character references are decoded once. A null or
empty page gives an empty text; a null url is a host of its own, and so are all urls without one.
Ties in votes go to the lesser path number; rows that repeat vote and are read again; an empty
table gives an empty result; columns other than page_id, url and html are not read, whatever
their names. A path is a number of 64 bits, made of its parent's and its own tag and classes, so
that time and memory follow the length of a page, however deep it nests. A host may hold any share
of the pages: only sums and winners travel, and winners are broadcast if their bytes are few.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_batches, materialize, with_sums

SHARE = 0.9
#: A path with this part of its host's votes is a winner.
VOTES = 20
#: Bytes of all winners up to which they are broadcast.
MOST_BROADCAST = 32 << 20

_PART = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?:svg|math)\b[^>]*+(?<=/)>"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|svg|math|iframe|object|select|button|noframes|xmp)\b[^>]*+(?:>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

_WORD = re.compile(r"\w")

CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th blockquote figure fieldset details center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption caption legend summary hgroup br option".split())
DROPPED = frozenset("nav footer aside form head dialog menu".split())
#: Words in a class, id or role that name something else than the article.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup "
    "sidebar aside related recommended share sharing social comment comments respond replies disqus breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer popup modal overlay toolbar widget widgets "
    "search login complementary contentinfo alert paywall skip tags".split()
)
HEADS = frozenset({"header", "masthead", "topbar"})
#: Parts of an article at most.
PARTS = frozenset("ul ol dl table tbody thead tfoot tr td th blockquote figure".split())
NO_HEADING = 7
#: Names of parts that may be longer than the article.
TALK = frozenset("comment comments respond replies disqus related recommended".split())
GOOD = frozenset("article content main post entry story body text".split())


class _Node:
    __slots__ = ("all_chars", "all_main", "chars", "children", "dropped", "good", "heading", "main", "named", "own_heading", "parent", "path", "tag")

    def __init__(self, tag: str, label: str, parent, good: bool):
        self.tag, self.parent, self.good, self.children = tag, parent, good, []
        self.path = path_number(parent.path, label) if parent is not None else 0
        # the names for which the container is dropped if it isn't the article, and whether it, or one around it, is
        self.named, self.dropped = frozenset(), False
        # characters, those in article and main, each with and without what is dropped for its name
        self.chars = self.main = self.all_chars = self.all_main = 0
        # the highest headings within and outside of children
        self.heading = self.own_heading = NO_HEADING
        if parent is not None:
            parent.children.append(self)


def path_number(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + label.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _in_order(root: _Node) -> list[_Node]:
    """All containers, each after the one around it."""
    out = [root]
    for node in out:
        out += node.children
    return out


def _words(x: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower()) if w]


def _kept(node: _Node, total: int, elsewhere: int) -> bool:
    """Whether a container stays though its name is another part's: it holds most of the page's text, or an article and there is next to none elsewhere."""
    most = node.all_chars * 2 > total
    if elsewhere * 10 >= node.all_chars:
        return most and TALK.isdisjoint(node.named)
    return most or node.all_main > 0


def read(page: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The tree of containers, and the kept blocks' texts with their containers, in order."""
    root = _Node("", "", None, False)
    stack, dropped, in_article = [root], [], 0
    opened: Counter = Counter()
    blocks: list[tuple[_Node, str, int, int, int]] = []
    block: list[str] = []
    link, rank, chars, main = False, NO_HEADING, 0, 0

    def end_block() -> None:
        nonlocal chars, main
        if block:
            text = " ".join(html_lib.unescape("".join(block)).split())
            if text:
                blocks.append((stack[-1], text, chars, main, rank))
            block.clear()
        chars = main = 0

    def add(text: str) -> None:
        nonlocal chars, main
        if text and not dropped:
            block.append(text)
            if not link and _WORD.search(text):
                n = len(text.strip())
                chars += n
                main += n if in_article else 0

    at = 0
    for m in _PART.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            link = not m["close"] and not m["attrs"].endswith("/")
        if tag not in BLOCKS and tag not in DROPPED:
            continue
        if tag == "br":
            if block:
                block.append(" ")
            continue
        end_block()
        link = False
        rank = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and not m["close"] else NO_HEADING
        if tag not in CONTAINERS and tag not in DROPPED:
            continue
        if m["close"]:
            while opened[tag]:
                end = stack.pop()
                opened[end.tag] -= 1
                in_article -= end.tag in ("article", "main")
                while dropped and dropped[-1] >= len(stack):
                    dropped.pop()
                if end.tag == tag:
                    break
            continue
        classes, names, hidden = [], [], False
        if m["attrs"]:
            for key, *values in _ATTR.findall(m["attrs"]):
                key, value = key.lower(), "".join(values)
                if key == "class":
                    classes = value.split()
                if key in ("class", "id", "role"):
                    names += _words(value)
                hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower())
        # a table's row and list items end those before them
        if tag in ("tr", "td", "th", "tbody"):
            ends = {"tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "tr", "td", "th")}[tag]
            while stack[-1].tag in ends:
                while dropped and dropped[-1] >= len(stack) - 1:
                    dropped.pop()
                opened[stack.pop().tag] -= 1
        label = re.sub(r"\d+", "#", ".".join([tag, *sorted(set(classes))]))
        node = _Node(tag, label, stack[-1], tag in ("article", "main") or not GOOD.isdisjoint(names))
        stack.append(node)
        opened[tag] += 1
        if tag not in ("html", "body", "main", "article"):
            node.named = NAMED & set(names)
        elif tag == "article":
            node.named = {"comment", "related", "ad"} & set(names)
        if tag not in ("body", "header") and not in_article:
            node.named |= HEADS & set(names)
        if hidden or tag in DROPPED or (tag == "header" and not in_article):
            dropped.append(len(stack) - 1)
        in_article += tag in ("article", "main")
    add(page[at:])
    end_block()
    return root, _judged(root, blocks)


def _judged(root: _Node, blocks: list[tuple[_Node, str, int, int, int]]) -> list[tuple[_Node, str]]:
    """The blocks that aren't dropped for a name, of blocks (container, text, characters, those in article and main, heading); counts them for their containers."""
    nodes = _in_order(root)
    for node, _, chars, main, _ in blocks:
        node.all_chars += chars
        node.all_main += main
    # articles outside of all containers with another part's name
    inside, elsewhere = {id(root)} if root.named else set(), 0
    for node in nodes:
        if node.parent is not None and (node.named or id(node.parent) in inside):
            inside.add(id(node))
        elsewhere += 0 if id(node) in inside else node.all_main
    for node in reversed(nodes):
        if node.named and node.tag == "article":
            node.all_main = 0  # an article with another part's name keeps no containers
        if node.parent is not None:
            node.parent.all_chars += node.all_chars
            node.parent.all_main += node.all_main
    for node in nodes:
        above = node.parent is not None and node.parent.dropped
        node.dropped = above or (bool(node.named) and not _kept(node, root.all_chars, elsewhere))
    kept = [x for x in blocks if not x[0].dropped] or blocks
    for node, _, chars, main, rank in kept:
        node.own_heading = min(node.own_heading, rank)
        node.chars += chars
        node.main += main
    for node in reversed(nodes):
        node.heading = min(node.heading, node.own_heading)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.main += node.main
            node.parent.heading = min(node.parent.heading, node.heading)
    return [x[:2] for x in kept]


def best(root: _Node) -> _Node:
    node = root
    while node.children and node.chars and node.tag not in ("article", "main"):
        child = max(node.children, key=lambda x: (x.main > 0, x.chars))
        others = [x for x in node.children if x is not child]
        heading = min([node.own_heading, *(x.heading for x in others)])
        if child.tag in PARTS:
            break
        if node.main:
            if child.main * 2 < node.chars or heading < child.heading or any(x.main for x in others):
                break
        else:
            own = node.chars - sum(x.chars for x in node.children)
            if own or child.chars < node.chars * SHARE or (heading < NO_HEADING and heading <= child.heading) or any(x.good and x.chars for x in others):
                break
        node = child
    return node


def _beside(node: _Node) -> set[int]:
    """The paths of containers with text beside the way from the root to node."""
    out, way = set(), set()
    while node.parent is not None:
        way.add(node.path)
        out |= {x.path for x in node.parent.children if x.all_chars and x.path != node.path}
        node = node.parent
    return out - way


def _text(root: _Node, blocks: list[tuple[_Node, str]], chosen: set[int]) -> str:
    """The blocks within containers of these (by id)."""
    inside = set()
    for node in _in_order(root):
        if id(node) in chosen or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
    return " ".join(text for node, text in blocks if id(node) in inside)


def extract(page: str, winners: list[int], beside: list[list[int]] | None = None) -> str:
    """The text of the first winner that holds the page's article; beside: for each winner, the paths known to lie outside."""
    root, blocks = read(page)
    known = {node.path for node in _in_order(root)} if winners else set()
    for path, others in zip(winners, beside or [[]] * len(winners), strict=True):
        if path not in known:
            continue
        outside, chosen, held, left, todo = set(others), set(), 0, 0, [root]
        while todo:
            node = todo.pop()
            if node.path == path:
                chosen.add(id(node))
                held += node.chars
            elif node.path not in outside:
                left += node.chars - sum(x.chars for x in node.children)
                todo += node.children
        if chosen and held >= SHARE * (held + left) and (text := _text(root, blocks, chosen)):
            return text
    return _text(root, blocks, {id(best(root))})


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """voted_host, winners (paths, best first) and beside (for each the paths known to lie outside) from pages (url, html)."""

    def vote(batches):
        for batch in batches:
            votes: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if page:
                    root, blocks = read(page)
                    if blocks:
                        node = best(root)
                        votes[host, node.path, None] += 1
                        for other in _beside(node):
                            votes[host, node.path, other] += 1
            columns = [pa.array([k[i] for k in votes], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(votes.values(), pa.int64())], ["voted_host", "path", "other", "votes"])

    rows = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), vote, "voted_host string, path long, other long, votes long")
    counted = materialize(rows.groupBy("voted_host", "path", "other").agg(F.sum("votes").alias("n")), "html-votes")
    # at most VOTES winners of a host
    paths = with_sums(counted.where("other is null").drop("other"), "voted_host", {"total": F.sum("n")}).where(F.col("n") * VOTES >= F.col("total"))
    won = paths.select(F.col("voted_host").alias("h"), F.col("path").alias("p"), F.col("n").alias("votes"))
    others = counted.where("other is not null").join(won, (F.col("voted_host") == F.col("h")) & (F.col("path") == F.col("p"))).where(F.col("n") * 2 >= F.col("votes"))
    # what half of the pages of a path have is at most twice what one has
    beside = others.groupBy("h", "p").agg(F.sort_array(F.collect_list("other")).alias("beside")).withColumnsRenamed({"h": "bh", "p": "bp"})
    listed = won.join(beside, (F.col("h") == F.col("bh")) & (F.col("p") == F.col("bp")), "left").select("h", F.struct((-F.col("votes")).alias("place"), "p", F.coalesce("beside", F.array().cast("array<long>")).alias("beside")).alias("x"))
    listed = listed.groupBy(F.col("h").alias("voted_host")).agg(F.sort_array(F.collect_list("x")).alias("all"))
    return listed.select("voted_host", F.transform("all", lambda x: x["p"]).alias("winners"), F.transform("all", lambda x: x["beside"]).alias("beside"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    winners = materialize(winning_paths(pages), "html-winners")
    size = winners.agg(F.sum(F.octet_length("voted_host") + 8 * F.size("winners") + 8 * F.size(F.flatten("beside")) + 64)).first()[0] or 0
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(winners) if size <= MOST_BROADCAST else winners, F.col("host") == F.col("voted_host"), "left").select("page_id", "url", "html", "winners", "beside")

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "winners", "beside"))
            texts = [extract(page, won or [], beside) if page else "" for page, won, beside in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_chars long")
