"""Main text of web pages by the consensus of each host's pages.

Every page is parsed to a tree; boilerplate (menus, headers, footers, forms, adverts, comments, ...) is left out by tag, role and
class. Each page votes for the path of its best container: tags and classes from the root, digits generalised. Votes are counted per
host in Spark; the paths with enough of them are the host's, and the pages are extracted again with these.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import attach_by_size, by_bytes, with_rest
from plumbline.llm.bpe import _schema

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form script style noscript template iframe object svg math canvas button select textarea head title dialog menu".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("article main section div td body html".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("article section div td th table body html blockquote main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "div", "section"))
#: Words of class, id and role that mark boilerplate.
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert
    sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer toolbar share sharing social related
    recommended newsletter subscribe subscription signup login popup modal overlay comment comments commentlist discussion disqus replies
    widget complementary contentinfo search""".split()
)
#: Of these, words that also stand in the names of content.
AMBIGUOUS = frozenset("header discussion related search social notice notices alert comment".split())
#: With these in one name, a header is the site's.
SITE = frozenset("site global top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of readers' comments: such an element goes however much text it holds.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies".split())
#: Names that begin or end with these tell of a state or a lack.
LACKING = frozenset("no not non has have with without hide".split())
STATES = frozenset("open opened closed enabled disabled free hidden active".split())
#: Words that stand beside boilerplate words in the names of boilerplate.
NEUTRAL = frozenset(
    """area bar block body bottom box button buttons container content form group inline inner item items left link links list main outer page post posts right
    section site slot top unit wrap wrapper""".split()
)
#: Classes of inline adverts.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored".split())
HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"[\s\xa0]+")
#: A path is a host's if at least this share of the host's pages voted for it, so a host has at most 1 / share paths.
MIN_SHARE = 0.05
#: A host's path is used on a page if it holds at least this share of the unlinked text of the page's own best container.
PATH_SHARE = 0.9


class Node:
    __slots__ = ("tag", "parent", "path_id", "label", "depth", "skipped", "inside_article", "heading", "holds_article", "own", "linked", "mark")

    def __init__(self, tag, parent, label, path_id, skipped):
        self.tag, self.parent, self.label, self.path_id, self.skipped = tag, parent, label, path_id, skipped
        self.depth = parent.depth + 1 if parent else 0
        self.inside_article = bool(parent) and (parent.inside_article or parent.tag in ("article", "main"))
        self.heading = tag == "h1" or bool(parent) and parent.heading
        self.holds_article = False
        #: characters of text below, and those of them in links
        self.own = self.linked = self.mark = 0

    @property
    def path(self) -> str:
        labels, node = [], self
        while node.parent:
            labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))


def boilerplate_words(names: list[str], strict: bool) -> set[str]:
    """The boilerplate words in names of class, id and role. Names of a state or a lack (has-sidebar, comments-open, ad-free) say nothing of the
    element itself. Where ``strict``, each word of a name has to be boilerplate or neutral, so that market-share or ad-hoc is none."""
    out = set()
    for name in names:
        words = WORD.findall(name)
        if len(words) > 1 and (words[0] in LACKING or words[-1] in STATES):
            continue
        if not strict or all(w in BOILERPLATE or w in NEUTRAL for w in words):
            out.update(w for w in words if w in BOILERPLATE)
    return out


class Page(HTMLParser):
    """Builds blocks: (block element, text pieces) in page order, and the tree of elements. Each step is linear in the page, however deep it is."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.path_ids: dict[tuple[int, str], int] = {}
        self.root = Node("", None, "", 0, False)
        self.stack = [self.root]
        self.open_tags: dict[str, int] = {}
        #: all elements in page order, each after its parent
        self.tree: list[Node] = [self.root]
        self.nodes: list[Node] = []
        #: with the characters of a block and those of them in links
        self.blocks: list[tuple[Node, list[str], list[int]]] = []
        self.open_block: tuple[Node, list[str], list[int]] | None = None
        #: elements with boilerplate words and how they are judged when the page is read: "comment", "marked", "links"
        self.doubtful: list[tuple[Node, str]] = []
        self.feed(html)
        self.close()
        self._settle()

    def _judged_by(self, tag, parent, names) -> str | None:
        inside = parent.inside_article or parent.tag in ("article", "main")
        words = boilerplate_words(names, inside)
        if words & COMMENTS - AMBIGUOUS:
            return "comment"
        if words - AMBIGUOUS:
            return "marked"
        if not words or tag in HEADINGS:
            return None
        if not (inside or tag == "section") and any(n in AMBIGUOUS or "header" in (w := WORD.findall(n)) and not SITE.isdisjoint(w) for n in names):
            return "comment" if words & COMMENTS else "marked"
        return "links"

    def _settle(self):
        """Sums up the text below each element and takes out the doubtful elements.

        Reader comments go. Elements with other marks go unless they hold an article, a main part or the page's heading, or most of the page's
        unlinked text besides comments. Elements whose name may be content's go if they are mostly links."""
        self._sum()
        text = self.root.own - self.root.linked
        out = {id(n) for n, how in self.doubtful if how == "comment"}
        if out:
            inner = {id(n): id(n) in out for n in self.tree}
            for n in self.tree[1:]:
                if inner[id(n.parent)]:
                    inner[id(n)] = True
                elif inner[id(n)]:
                    text -= n.own - n.linked
        for n, how in self.doubtful:
            if how == "links" and 2 * n.linked > n.own or how == "marked" and not n.holds_article and 2 * (n.own - n.linked) <= text:
                out.add(id(n))
        if not out:
            return
        for n in self.tree[1:]:
            n.skipped = n.skipped or n.parent.skipped or id(n) in out
        self.blocks = [b for b in self.blocks if not b[0].skipped]
        self._sum()

    def _sum(self):
        for n in self.tree:
            n.own = n.linked = 0
        for node, _, (size, linked) in self.blocks:
            node.own += size
            node.linked += linked
        for n in reversed(self.tree[1:]):
            n.parent.own += n.own
            n.parent.linked += n.linked

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close({"p"}, SCOPE)
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], LIST_SCOPE)
        if tag not in INLINE:
            self.open_block = None
        if tag in VOID:
            if tag == "br" and self.open_block:
                self.open_block[1].append(" ")
            return
        parent = self.stack[-1]
        values = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        classes = values.get("class", "").lower().split()
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")) is not None
        skipped = parent.skipped or hidden or tag in SKIPPED or tag == "header" and not (parent.inside_article or parent.tag in ("article", "main"))
        how = None
        if tag in INLINE:
            skipped = skipped or not ADVERTS.isdisjoint(classes)
            label = tag
        else:
            label = re.sub(r"\d+", "#", ".".join((tag, *sorted(set(classes)))))
            names = [*classes, *values.get("id", "").lower().split(), *values.get("role", "").lower().split()]
            if names and not skipped and tag not in ("body", "html", "article", "main"):
                how = self._judged_by(tag, parent, names)
        node = Node(tag, parent, label, self.path_ids.setdefault((parent.path_id, label), len(self.path_ids) + 1), skipped)
        if how:
            self.doubtful.append((node, how))
        if tag in ("article", "main", "h1") and not skipped:
            up = parent
            while up and not up.holds_article:
                up.holds_article = True
                up = up.parent
        self.stack.append(node)
        self.tree.append(node)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if tag in CONTAINERS:
            self.nodes.append(node)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.open_block = None
        if tag != "br" and tag not in VOID:
            self._close({tag}, frozenset() if tag not in INLINE else SCOPE)

    def _close(self, tags, scope):
        if not any(self.open_tags.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                for node in self.stack[k:]:
                    self.open_tags[node.tag] -= 1
                del self.stack[k:]
                return
            if self.stack[k].tag in scope:
                return

    def handle_data(self, data):
        node = self.stack[-1]
        if node.skipped:
            return
        if not self.open_block:
            self.open_block = (node, [], [0, 0])
            self.blocks.append(self.open_block)
        self.open_block[1].append(data)
        size = len(data.strip())
        if size:
            self.open_block[2][0] += size
            if self.open_tags.get("a"):
                self.open_block[2][1] += size

    def best(self) -> Node | None:
        """The smallest container that holds every block of the page that is not mostly links, and the first headings."""
        if self.root.own <= self.root.linked:
            return None
        texts = [(node, weight) for node, _, weight in self.blocks if weight[0]]
        wanted = [node for node, (size, linked) in texts if 2 * linked < size or node.heading] or [node for node, _ in texts]
        for n in self.tree:
            n.mark = 0
        for node in wanted:
            node.mark += 1
        for n in reversed(self.tree[1:]):
            n.parent.mark += n.mark
        good = [n for n in self.nodes if not n.skipped and n.mark == len(wanted)]
        return max(good, key=lambda n: n.depth) if good else None

    def at(self, path: str) -> list[Node]:
        """The containers with a path."""
        of = 0
        for label in path.split(">"):
            of = self.path_ids.get((of, label), -1)
        return [n for n in self.nodes if n.path_id == of and not n.skipped] if of > 0 else []

    def text(self, chosen: list[Node] | None) -> str:
        """The blocks below the chosen nodes (of the whole page when None)."""
        wanted = {id(self.root)} if chosen is None else {id(n) for n in chosen}
        for n in self.tree:
            n.mark = id(n) in wanted or n.parent is not None and n.parent.mark
        out = []
        for node, pieces, _ in self.blocks:
            block = SPACE.sub(" ", "".join(pieces)).strip() if node.mark else ""
            if block:
                out.append(block)
        return "\n\n".join(out)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def vote(html: str | None) -> str | None:
    best = Page(html).best() if html else None
    return best.path if best else None


def extract(html: str | None, paths: list[str]) -> tuple[str, str]:
    """Text and the path it was taken from: the first of the host's paths that holds nearly all of the page's own best container,
    else that container, else all that is not boilerplate."""
    if not html:
        return "", ""
    page = Page(html)
    best = page.best()
    whole = best or page.root
    least = PATH_SHARE * (whole.own - whole.linked)
    for path in paths:
        chosen = page.at(path)
        if any(n.own for n in chosen) and sum(n.own - n.linked for n in chosen) >= least:
            return page.text(chosen), path
    return page.text([best] if best else None), best.path if best else ""


def host_paths(pages: DataFrame, url: str = "url", html: str = "html", min_share: float = MIN_SHARE) -> DataFrame:
    """Rows (``host``, ``paths``, ``pages``): per host the paths with a share of votes of at least ``min_share``, most votes first, and its number of votes."""

    def run(batches):
        for batch in by_bytes(batches, html):
            hosts = [host_of(u) for u in batch.column(url).to_pylist()]
            votes = [vote(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(votes, pa.string())], names=["host", "path"])

    votes = pages.select(url, html).mapInArrow(run, "host string, path string").where("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"))
    # no more than 1 / min_share paths of a host pass, so the list is bounded
    passed = counted.join(totals, "host").where(F.col("n") >= F.col("total") * min_share)
    ranked = passed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("p"), F.max("total").alias("pages"))
    return ranked.select("host", F.col("p.path").alias("paths"), "pages")


def main_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: the id, the url, ``text`` (blocks joined by an empty line), ``n_chars`` and ``path``.

    White space inside a block is one space; a line break element is white space. A null or empty html, and a page of
    nothing but boilerplate, have an empty text. Pages with a null or broken url vote together as one host. Repeated rows vote and are
    returned each; an empty table gives no rows.
    """
    paths = host_paths(pages, url, html)

    def run(batches):
        for batch in by_bytes(batches, "html"):
            got = [extract(h, p or []) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            texts = [t for t, _ in got]
            yield with_rest(batch, ["page_id", "url"], {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "path": pa.array([p for _, p in got], pa.string())})

    def with_host(batches):
        for batch in batches:
            yield with_rest(batch, ["page_id", "url", "html"], {"host": pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string())})

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.mapInArrow(with_host, _schema([*rows.schema], "host string"))
    # a frequent host's few paths go to all tasks and its pages are dealt out, so that no host is a single task
    joined = attach_by_size(rows, paths, ["host"], "pages").select("page_id", "url", "html", "paths")
    out = joined.mapInArrow(run, _schema([rows.schema["page_id"], rows.schema["url"]], "text string, n_chars long, path string"))
    return out.select(F.col("page_id").alias(id_column), F.col("url").alias(url), "text", "n_chars", "path")
