"""HTML extraction by tree scoring.

A page becomes a tree, read in one pass. Subtrees that are never article text (scripts, forms, menus, ...) go, by element.
A block whose class, id or role names it as such goes too, whatever its length, unless such blocks are what the page or
article is about: those named as comments, adverts, side bars, notices or menus where they hold more than nine tenths of
its text, those with other names (a promotion, a search box, sharing, ...) where they hold half of it. Each block of text
gives points for length and commas to its ancestors, half of them from each to the next; a container's points are
discounted by its link density. The best container is widened to the article element around it, or to the main element
where that holds several articles; without either, it is kept with the siblings of it and of its ancestors that are not
marked and not mostly links. Their blocks are the page's main text. Outside of an article, a list of short links is a
menu and goes.

Defined cases: a null or empty page has empty text; without any block of text the text is empty; character
references are decoded, broken ones stay as written; a ``<`` that no ``>`` follows is text; after a tag whose quotes never
close, quotes no longer hide a ``>``; white space inside a block, line breaks too, is one blank;
unclosed elements end where their parent ends; equal pages are extracted one by one; extra columns are ignored. Reading,
scoring and printing take time in proportion to the page, whatever is in it.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROP = frozenset(
    "script style noscript template head nav footer aside form button select option input textarea iframe svg canvas object embed applet audio video dialog menu map title link meta".split()
)
#: Names in class, id or role that mark what is not the article.
MARKS = frozenset(
    """ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising adsense leaderboard skyscraper sponsor sponsored promo promotion banner masthead header
    footer nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary contentinfo search
    searchbox toolbar pagination pager share sharing social related recommended recommendations newsletter subscribe
    subscription signup login cookie cookies consent gdpr notice notification alert popup modal overlay dialog widget
    comment comments commentlist disqus respond replies reply skip""".split()
)
#: Words that make the rest of a class a property of the block, not its name.
ASPECTS = frozenset("has have no not non with without is hide show hljs token".split())
#: Those of them that name readers' comments, adverts, side bars, notices and menus.
SURE = frozenset(
    """ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertising adsense leaderboard skyscraper sponsor sponsored nav navbar navigation menu menubar breadcrumb
    breadcrumbs sidebar aside complementary pagination pager newsletter subscribe subscription cookie cookies consent gdpr comment comments commentlist disqus respond replies reply""".split()
)
#: The share of points that a marked block keeps.
MARKED_SHARE = 0.25
#: Least link density of a block of links, and characters below which a link is a menu's, on average.
LINKS, MENU_LINK = 0.5, 15
#: An element ends the open ones named here, up to the boundary elements.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = frozenset("ul ol dl table body html article section main div blockquote td th".split())

#: Parts of tables and lists, which are no containers of their own.
PARTS = frozenset("td th tr tbody thead tfoot table li ul ol dt dd dl".split())

#: A tag's name, and what follows it up to the ``>`` outside of quotes. Both go forward only.
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
#: One attribute: its whole name, then its value with it, so that nothing inside a value or a longer name is taken for one.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "up", "kids", "points", "text", "links", "n_links", "drop", "mark", "commas", "block")

    def __init__(self, tag: str, up: Node | None, drop: bool, mark: int = 0) -> None:
        self.tag, self.up, self.drop, self.mark = tag, up, drop, mark
        self.block = up.block if tag in INLINE and up is not None else self
        self.kids: list = []
        self.clear()

    def clear(self) -> None:
        self.points = 0.0
        self.text = self.links = self.n_links = self.commas = 0


def _marked(tag: str, attrs: str, inside_article: bool) -> tuple[bool, int]:
    """Whether an element goes with all it holds, and how its names mark it: not (0), perhaps (1), surely (2)."""
    if tag in DROP or tag == "header" and not inside_article:
        return True, 0
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, 0
    mark = 0
    seen: set[str] = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name in seen:
            continue  # the first of equal attributes counts
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, 0
        if name in ("class", "id", "role") and tag not in INLINE:
            for token in value.split():
                parts = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                found = MARKS.intersection(("".join(parts), *parts[:1], *parts[-1:]))
                # An article's own header holds its title.
                if found - ({"header"} if inside_article else set()) and ASPECTS.isdisjoint(parts):
                    mark = max(mark, 1 + bool(found & SURE))
    return False, mark


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of all tags and, without a name, comments and declarations. The caller may
    send a place to go on from."""
    pos, n, last, quotes = 0, len(page), page.rfind(">"), True
    while (at := page.find("<", pos)) >= 0:
        found = None
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            found = (at, end + 3 if end >= 0 else n, "", "", "")
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            found = (at, end + 1 if end >= 0 else n, "", "", "")
        elif at < last and (m := _OPEN.match(page, at)):
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:
                quotes = False
                end = page.find(">", m.end())
                found = (at, end + 1, m[1], m[2], page[m.end() : end])
            else:
                found = (at, rest.end(), m[1], m[2], rest[1])
        if found is None:
            pos = at + 1
            continue
        pos = found[1]
        pos = (yield found) or pos


class _Open:
    """The open elements, with counts that say without a walk whether a tag is open: in all, among the inline elements in the
    innermost block, and from the innermost boundary element on."""

    def __init__(self, root: Node) -> None:
        self.at = root
        self.all: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]
        self.near: list[dict[str, int]] = [{}]
        self.articles = 0

    def push(self, node: Node) -> None:
        tag = node.tag
        self.at = node
        self.all[tag] = self.all.get(tag, 0) + 1
        self.articles += tag in ("article", "main")
        if tag in BOUNDARY:
            self.near.append({})
        self.near[-1][tag] = self.near[-1].get(tag, 0) + 1
        if tag in INLINE:
            self.inline[-1][tag] = self.inline[-1].get(tag, 0) + 1
        else:
            self.inline.append({})

    def pop(self) -> str:
        tag = self.at.tag
        self.all[tag] -= 1
        self.articles -= tag in ("article", "main")
        self.near[-1][tag] -= 1
        if tag in BOUNDARY:
            self.near.pop()
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        self.at = self.at.up
        return tag

    def close(self, tag: str) -> None:
        """An end tag: an inline element isn't closed through a block."""
        if (self.inline[-1] if tag in INLINE else self.all).get(tag):
            while self.pop() != tag:
                pass

    def end(self, tags: set[str]) -> None:
        """Close the innermost of *tags* that is no farther than the innermost boundary element."""
        if any(self.near[-1].get(t) for t in tags):
            while self.pop() not in tags:
                pass


def tree(page: str) -> Node:
    """The page as nodes; a kid is a node or a string of decoded text."""
    root = Node("html", None, False)
    held, done = _Open(root), 0
    tags = _tags(page)
    found = next(tags, None)
    while found is not None:
        start, end, closing, tag, attrs = found
        tag, skip_to = tag.lower(), None
        if start > done:
            held.at.kids.append(_html.unescape(page[done:start]))
        done = end
        if tag and closing:
            held.close(tag)
        elif tag:
            over = {"p"} if tag not in INLINE and tag not in RAW else set()
            if over := over | ENDS.get(tag, set()):
                held.end(over)
            if tag not in ("html", "body"):
                node = Node(tag, held.at, *_marked(tag, attrs, held.articles > 0))
                held.at.kids.append(node)
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, end)
                    stop = page.find(">", close.end()) if close else -1
                    done = skip_to = stop + 1 if stop >= 0 else len(page)
                elif tag not in VOID and not attrs.rstrip().endswith("/"):
                    held.push(node)
        try:
            found = tags.send(skip_to)
        except StopIteration:
            found = None
    if done < len(page):
        held.at.kids.append(_html.unescape(page[done:]))
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, Node | None, bool]]:
    """(node or text, parent, entering) in page order, without dropped subtrees."""
    stack: list[tuple[Node | str, Node | None, bool]] = [(root, None, True)]
    while stack:
        x, up, entering = stack.pop()
        yield x, up, entering
        if entering and isinstance(x, Node):
            stack.append((x, up, False))
            stack.extend((k, x, True) for k in reversed(x.kids) if isinstance(k, str) or not k.drop)


def _score(root: Node, again: bool = False) -> None:
    """Text, link and comma counts of all nodes, and points: a block's go to its parent, half of them to the next."""
    link = 0
    blocks: set[Node] = set()
    for x, up, entering in _walk(root):
        if isinstance(x, str):
            size = len("".join(x.split()))
            commas = x.count(",")
            up.text += size
            up.links += size if link else 0
            up.commas += commas
            block = up.block
            if block is not up:
                block.commas += commas
            if size:
                blocks.add(block)
        elif entering:
            if again:
                x.clear()
            link += x.tag == "a"
        else:
            if x.tag == "a":
                link -= 1
                x.n_links += 1
            if x in blocks:
                (up if up is not None else x).points += 1 + x.commas + min(x.text / 100, 3)
            if up is not None:
                up.text, up.links, up.n_links = up.text + x.text, up.links + x.links, up.n_links + x.n_links
                up.points += x.points / 2


def _density(x: Node) -> float:
    return x.links / x.text if x.text else 0.0


def _prune(root: Node) -> None:
    """Score the tree without the marked blocks that are mostly links or aren't what their article is about."""
    _score(root)
    links: list[Node] = []
    marked: list[tuple[Node, Node]] = []  # with the article around it, or the page
    scopes, inside, articles = [root], None, False
    for x, _, entering in _walk(root):
        if not isinstance(x, Node):
            continue
        articles = articles or x.tag in ("article", "main") and x.text > 0
        if x.tag in ("article", "main"):
            scopes.append(x) if entering else scopes.pop()
        if inside is not None:
            inside = None if x is inside and not entering else inside
        elif entering and x.mark and x.text:
            if _density(x) >= LINKS:
                links.append(x)
            else:
                marked.append((x, scopes[-1]))
            inside = x
    held: dict[tuple[Node, int], int] = {}
    for x, scope in marked:
        held[scope, x.mark] = held.get((scope, x.mark), 0) + x.text
    few = lambda x, scope: 10 * held[scope, 2] <= 9 * scope.text if x.mark == 2 else 2 * held[scope, 1] < scope.text
    gone = links + [x for x, scope in marked if few(x, scope) or articles and scope is root]
    if not gone or sum(x.text for x in gone) == root.text:
        return
    for x in gone:
        x.drop = True
    _score(root, again=True)


def main_nodes(root: Node) -> list[Node | str]:
    """The best container, widened to its article, or what is kept beside it and its ancestors, in page order."""
    _prune(root)
    best, most, marks = None, 0.0, 0
    articles: dict[Node, int] = {}  # of each main element, outermost ones that aren't mostly links
    mains: list[Node] = []
    for x, _, entering in _walk(root):
        if isinstance(x, Node):
            marks += bool(x.mark) if entering else -bool(x.mark)
            if x.tag in ("article", "main"):
                if entering and x.tag == "article" and x.text and _density(x) < LINKS and mains and mains[-1].tag == "main":
                    articles[mains[-1]] = articles.get(mains[-1], 0) + 1
                mains.append(x) if entering else mains.pop()
            if entering and x.tag not in INLINE and x.text:
                value = x.points * (1 - _density(x)) * (MARKED_SHARE if marks else 1)
                if value > most:
                    best, most = x, value
    if best is None:  # nothing but links: an article of them is still one
        return next(([x] for x, _, entering in _walk(root) if entering and isinstance(x, Node) and x.tag in ("article", "main") and x.text), [])
    while best.tag in PARTS and best.up is not None and best.up.up is not None:
        best = best.up  # a cell or an item is part of what holds the table or list
    up, wide = best, None
    while up is not None:
        if up.tag == "article" or up.tag == "main" and (wide is None or articles.get(up, 0) > 1):
            wide = up
        up = up.up
    if wide is not None:
        for x in wide.kids if wide.tag == "main" else []:
            if isinstance(x, Node) and x.tag == "article" and _density(x) >= LINKS:
                x.drop = True
        return [wide]
    before: list[list[Node | str]] = []
    after: list[list[Node | str]] = []
    x = best
    while x.up is not None:
        fine = [k is x or isinstance(k, str) or not k.drop and (best.mark or not k.mark) and (_density(k) < LINKS or not k.text) for k in x.up.kids]
        at = next(i for i, k in enumerate(x.up.kids) if k is x)
        before.append([k for k, ok in zip(x.up.kids[:at], fine[:at], strict=True) if ok])
        after.append([k for k, ok in zip(x.up.kids[at + 1 :], fine[at + 1 :], strict=True) if ok])
        x = x.up
    # A rule between levels: what stands beside an ancestor is no part of the block inside it.
    return [k for level in reversed(before) for k in (*level, Node("hr", None, False))] + [best] + [k for level in after for k in (Node("hr", None, False), *level)]


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, joined by line feeds."""
    if not page:
        return ""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        line = " ".join("".join(part).split())
        if line:
            out.append(line)
        part.clear()

    for top in main_nodes(tree(page)):
        skip: Node | None = None
        articles = isinstance(top, Node) and top.tag in ("article", "main")
        for x, _, entering in _walk(top):
            if skip is not None:
                if x is skip and not entering:
                    skip = None
            elif isinstance(x, str):
                part.append(x)
            elif x.tag == "br":
                part.append(" ")
            elif x.tag not in INLINE:
                flush()
                if entering and x is not top and not articles and x.n_links >= 3 and _density(x) >= 0.9 and x.links < MENU_LINK * x.n_links:
                    skip = x  # a list of short links is a menu
    flush()
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    held = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return held.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
