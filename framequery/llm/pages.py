"""Main text of web pages by consensus paths of their hosts.

Every page scores its containers and votes for the generalised tag-class path of the best one. The votes are summed per
host in Spark; each page is then read again with its host's winning path. A page of which that path has clearly less than
the page's own best falls back to its own best.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.llm.token_files import written
from framequery.llm.words import to_batches

NAME = re.compile(r"/?[a-zA-Z]")
#: A tag after its "<". Possessive, so that a tag without an end is read once; UNQUOTED is for pages with a stray quote.
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
UNQUOTED = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names of HTML by their part in a page.
RAW = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in "script style noscript template iframe textarea svg math select object".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head nav footer aside button menu dialog label fieldset title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " html li main nav ol p pre section summary table tbody td tfoot th thead tr ul hr caption".split()
)
CONTAINER = frozenset("article main section div td body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class and id names that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu navbar nav navigation breadcrumb breadcrumbs sidebar"
    " footer header masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal"
    " newsletter subscribe subscription signup login share sharing social related recommended widget widgets toolbar pagination pager skip".split()
)
# Those of MARKS that may also stand on a paragraph of the article.
SOFT = frozenset("banner menu header footer notice notices alert social share sharing related recommended reply replies skip widget widgets toolbar promotion".split())
PROSE = frozenset("p pre blockquote".split())
# Those of MARKS that readers' comments have.
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
# Those of MARKS that boxes beside an article have, never the layout of a page.
BOXES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login".split()
)
#: A marked block is a wrapper of the page, and stays, if it holds an article or a first heading and half of the page's
#: worth, or nearly all of it.
HALF, NEARLY = 0.5, 0.9
#: Where all blocks are marked, one of such a worth stays.
LONG = 500
#: A paragraph with a soft mark stays if it has so many characters, at most half of them in links.
PROSE_CHARS = 40
#: Shares of a block's worth that go to containers further out: halved so often, they no longer count.
LEAST_SHARE = 2.0**-40
#: A host's path serves a page of whose own best container it has at least this share.
HELD = 0.8
WHITE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
#: Elements that a new element of the given kind closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(slots=True)
class Node:
    """An element. step: its part of the path (None: the parent's path). skipped: its text isn't read. container, article,
    block: the innermost such element around it, itself included (0: none). doubtful: a paragraph that its marks alone
    don't decide about. marks: those of its names; judged: whether it stays is settled once the page is read."""

    tag: str
    step: str | None
    skipped: bool
    link: bool
    parent: int
    container: int
    article: int
    block: int
    doubtful: bool = False
    marks: frozenset[str] = frozenset()
    judged: bool = False
    text: int = 0
    linked: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: (innermost node, text) of each block, in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _marked(attributes: str) -> tuple[str, bool, frozenset[str]]:
    """The generalised class part of a path, whether role or style say that it isn't shown or isn't the article, and the
    marks among the names."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "", False, frozenset()
    names: list[str] = []
    classes: list[str] = []
    skipped = False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "class":
            classes = value.split()
            names += classes
        elif key == "id":
            names.append(value)
        elif key == "role":
            skipped |= value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            skipped = True
        elif key == "style":
            skipped |= "display:none" in value.replace(" ", "").lower()
    parts = MARKS & {p for name in names for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())}
    return "".join(f".{c}" for c in sorted(DIGITS.sub("#", c.lower()) for c in classes)), skipped, parts


def tokens(source: str) -> Iterator[tuple[str, str | None, str]]:
    """(text, None, ""), or (slash, name, attributes) of a tag; an element of RAW is ("", its name, "") as a whole. Time
    is linear in the page: what is looked for in vain once isn't looked for again."""
    at, size, last, tag = 0, len(source), source.rfind(">"), TAG
    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            yield source[at:lt], None, ""
        at = lt
        if lt == size:
            break
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = end + 3 if end >= 0 else size
        elif lt < last and source[lt + 1] in "!?":
            at = source.find(">", lt) + 1
        elif lt < last and NAME.match(source, lt + 1):
            found = tag.match(source, lt + 1)
            if found is None:  # a quote that never ends
                tag = UNQUOTED
                found = tag.match(source, lt + 1)
            at, name = found.end(), found[2].lower()
            if found[1] or name not in RAW:
                yield found[1], name, found[3]
            else:
                end = None if found[3].endswith("/") else RAW[name].search(source, at)
                at = at if found[3].endswith("/") else end.end() if end else size
                yield "", name, ""
        else:
            at = lt + 1
            yield "<", None, ""


def parse(source: str) -> Page:
    """Nodes and text blocks of a page, in time linear in its length; unclosed and stray tags are mended as browsers
    mostly do."""
    page = Page([Node("", None, False, False, -1, 0, 0, 0)])
    nodes, stack = page.nodes, [0]
    #: Depths at which elements of a tag are open, so that no stack is searched.
    depths: dict[str, list[int]] = {}
    held: list[str] = []
    owner = 0
    linked = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = WHITE.sub(" ", html_lib.unescape("".join(held))).strip()
            node = nodes[owner]
            if text and not (node.doubtful and (len(text) < PROSE_CHARS or 2 * linked > len(text))):
                page.blocks.append((owner, text))
                node.text += len(text)
                node.linked += min(linked, len(text))
            held, linked = [], 0

    def close_to(depth: int) -> None:
        for k in stack[depth:]:
            depths[nodes[k].tag].pop()
        del stack[depth:]

    def deepest(tag: str) -> int:
        return found[-1] if (found := depths.get(tag)) else 0

    for text, tag, attributes in tokens(source):
        up = nodes[stack[-1]]
        if tag is None:
            if not up.skipped:
                if not held:
                    owner = up.block
                held.append(text)
                if up.link:
                    linked += len(text)
            continue
        if tag in RAW and not text:
            if held:
                held.append(" ")
            continue
        block = tag in BLOCK
        if text:
            if block:
                flush()
            if at := deepest(tag):
                close_to(at)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif held:
                held.append(" ")
            continue
        if block:
            flush()
            if at := deepest("p"):  # a block ends an open paragraph
                close_to(at)
            for other in CLOSES.get(tag, ()):
                if (at := deepest(other)) and at > max(map(deepest, ("ul", "ol", "table", "dl"))):
                    close_to(at)
        up, k = nodes[stack[-1]], len(nodes)
        classes, hidden, marks = _marked(attributes)
        soft = tag in PROSE and bool(marks) and marks <= SOFT
        against = bool(marks) and not soft and tag not in ("html", "body", "article", "main", *HEADINGS)
        judged = block and (against or tag == "form" or tag == "header" and not up.article)
        skipped = up.skipped or hidden or tag in SKIPPED or against and not block
        nodes.append(
            Node(
                tag, f"{tag}{classes}" if block else None, skipped, up.link or tag == "a", stack[-1],
                k if tag in CONTAINER else up.container, k if tag in ("article", "main") else up.article, k if block else up.block, soft, marks, judged,
            )
        )
        if block or not attributes.rstrip().endswith("/"):
            depths.setdefault(tag, []).append(len(stack))
            stack.append(k)
    flush()
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Take out what the judged blocks hold, but for wrappers of the page and headers of an article.

    A wrapper has a mark by chance, as `with-sidebar` or `comments-open`, or is a form around the page. It holds an
    article or main element without marks, or a first heading, none of them inside another marked block, and HALF of the
    page's worth; or NEARLY all of it, unless its names are those of BOXES; with names of comments all of it. A header stays if it has a
    heading and stands beside paragraphs, in one element with them.
    """
    nodes = page.nodes
    if not any(node.judged for node in nodes):
        return
    worth, _, _ = _totals(page)
    # What a node holds outside marked blocks below it: an article or first heading, any heading, paragraphs of its own.
    article, heading, prose = ([False] * len(nodes) for _ in range(3))
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        if node.skipped:
            continue
        article[k] |= node.tag in ("article", "main") and not node.marks or node.tag == "h1"
        heading[k] |= node.tag in HEADINGS
        if node.tag in PROSE and node.text:
            prose[node.parent] = True
        if not node.judged:
            article[node.parent] |= article[k]
            heading[node.parent] |= heading[k]

    def taken(stays: int) -> list[bool]:
        gone = [False] * len(nodes)
        for k, node in enumerate(nodes[1:], 1):
            gone[k] = gone[node.parent]
            if node.judged and not gone[k] and k != stays:
                nearly = worth[k] >= (1.0 if node.marks & COMMENTS else NEARLY) * worth[0] and not node.marks & BOXES
                beside = (node.tag == "header" or node.marks == {"header"}) and heading[k] and prose[node.parent]
                gone[k] = not (article[k] and worth[k] >= HALF * worth[0] or nearly or beside)
        return gone

    gone = taken(0)
    if all(gone[k] for k, _ in page.blocks):  # nothing is left: a long block without comments may be the article
        most = max((k for k, node in enumerate(nodes) if node.judged and not node.marks & COMMENTS), key=lambda k: (worth[k], -k), default=0)
        gone = taken(most) if most and worth[most] >= LONG else gone
    page.blocks = [(k, text) for k, text in page.blocks if not gone[k]]
    for k, node in enumerate(nodes):
        if gone[k]:
            node.text = node.linked = 0


def _worth(node: Node, text: str) -> float:
    return len(text) * (1.0 - node.linked / max(1, node.text)) + 20.0 * (node.tag in ("p", "pre", "blockquote"))


def _path(nodes: list[Node], k: int) -> str:
    """Generalised tag-class steps from the page to a node, parted by blanks (no tag or class has one)."""
    steps = []
    while k > 0:
        if nodes[k].step is not None:
            steps.append(nodes[k].step)
        k = nodes[k].parent
    return " ".join(reversed(steps))


def _totals(page: Page) -> tuple[list[float], list[int], list[int]]:
    """Worth, text and linked text of all blocks under each node."""
    nodes = page.nodes
    worth, text, linked = [0.0] * len(nodes), [node.text for node in nodes], [node.linked for node in nodes]
    for k, block in page.blocks:
        worth[k] += _worth(nodes[k], block)
    for k in range(len(nodes) - 1, 0, -1):  # a parent stands before its children
        up = nodes[k].parent
        worth[up] += worth[k]
        text[up] += text[k]
        linked[up] += linked[k]
    return worth, text, linked


def _best(page: Page) -> tuple[int, float] | None:
    """The container of the whole article, and the worth of its text, links not counted.

    The container whose own paragraphs hold the most text wins. From it, the article is all of the article or main
    element around it, then of each container further out whose added text isn't mostly links; no further than the
    outermost article or main where there is one.
    """
    nodes = page.nodes
    scores: dict[int, float] = {}
    for k, text in page.blocks:
        worth = _worth(nodes[k], text)
        share = 1.0
        k = nodes[k].container
        while k > 0 and share > LEAST_SHARE:  # full worth to the nearest container, half to the next, and so on
            scores[k] = scores.get(k, 0.0) + worth * share * (1.25 if nodes[k].tag in ("article", "main") else 1.0)
            share /= 2
            k = nodes[nodes[k].parent].container
    if not scores:
        return None
    best = max(scores, key=lambda k: (scores[k], -k))
    worths, texts, links = _totals(page)
    last, outer = 0, nodes[best].article
    best = outer or best
    while outer:
        last, outer = outer, nodes[nodes[outer].parent].article
    k = best
    while k > last:
        k = nodes[nodes[k].parent].container
        if k > 0 and texts[k] > texts[best] and 2 * (links[k] - links[best]) <= texts[k] - texts[best]:
            best = k
    return best, worths[best]


def best_container(page: Page) -> tuple[str, float] | None:
    """The path of the container of the whole article (see _best), and the worth of its text."""
    found = _best(page)
    return found and (_path(page.nodes, found[0]), found[1])


def main_text(page: Page, path: str | None) -> str:
    """Blocks under every node of the path, in page order, joined by blank lines. An article or main element around such
    a node counts with it. The page's own best is taken where it has clearly more than the path."""
    nodes = page.nodes

    def under(path: str) -> tuple[list[str], float]:
        steps = path.split(" ")
        chosen: set[int] = set()
        matched = [0] * len(nodes)  # how many steps a node's path has in common, -1 once it parts
        for k, node in enumerate(nodes[1:], 1):
            m = matched[node.parent]
            if node.step is not None and m >= 0:
                m = m + 1 if m < len(steps) and steps[m] == node.step else -1
            matched[k] = m
            if m == len(steps) and node.container == k:
                chosen.add(node.article or k)
        inside = [False] * len(nodes)
        for k, node in enumerate(nodes[1:], 1):
            inside[k] = inside[node.parent] or k in chosen
        blocks = [(k, text) for k, text in page.blocks if inside[k]]
        return [text for _, text in blocks], sum(_worth(nodes[k], text) for k, text in blocks)

    found, worth = under(path) if path else ([], 0.0)
    own = best_container(page)
    if own and (not found or worth < HELD * own[1]):
        found = under(own[0])[0]
    if not found:
        found = [text for _, text in page.blocks]
    return "\n\n".join(found)


def host_of(url) -> F.Column:
    """Lower-case host of a URL without user, port or trailing dot; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+?)\.?(?:[:/?#]|$)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, votes): for each host the path with most votes, then the higher score, then the first by name."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if source and (best := best_container(parse(source))):
                    hosts.append(host)
                    paths.append(best[0])
                    scores.append(best[1])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(vote, "host string, path string, score double")
    summed = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max_by(F.struct("path", "votes"), F.struct("votes", F.round("score", 3), F.col("path"))).alias("w")).select("host", "w.path", "w.votes")


def extract_main_text(
    pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8 << 20
) -> DataFrame:
    """id columns plus text (string, never NULL) of every page. NULL or empty html gives an empty text.

    Repeated pages come out as often as they are there; pages without a host share one vote; NULL ids pass through; other
    columns aren't read; an empty table gives no rows. Only (host, path) rows are shuffled; the winners are written to the
    shared folder and reach the pages by a broadcast join while hosts and paths have at most `broadcast_bytes`, else by a
    shuffle join whose hot hosts AQE splits.
    """
    winners = written(host_paths(pages, url_col, html_col).select(F.col("host").alias("_host"), F.col("path").alias("_path")), "hosts")
    size = winners.agg(F.coalesce(F.sum(F.octet_length("_host") + F.octet_length("_path") + 16), F.lit(0))).first()[0]
    small = size <= broadcast_bytes
    ids = list(dict.fromkeys(id_cols))
    rows = pages.select(*ids, host_of(F.col(url_col)).alias("_host"), F.col(html_col).alias("_html"))
    joined = rows.join(F.broadcast(winners) if small else winners, "_host", "left").select(*ids, "_path", "_html")
    out_schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ids), "text string"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(ids)
            texts = [main_text(parse(source), path) if source else "" for path, source in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield from to_batches(pa.table([*batch.columns[:n], pa.array(texts, pa.string())], names=[*ids, "text"]))

    return joined.mapInArrow(extract, out_schema)
