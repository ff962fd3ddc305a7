"""HTML extraction by consensus host paths: containers are scored per page, paths are voted on per host, pages re-extracted."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.staging import bound_batches, cut
from folioforge.llm.urls import host_of
from folioforge.sources.files import table

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select".split())
SKIPPED = frozenset("head button object canvas audio video map".split()) | RAW
OFF_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article blockquote body center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
) | OFF_TAGS | SKIPPED - {"button"}
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPES = frozenset("table ul ol dl td th article section div main body html".split())
#: Containers that are part of a text's flow, where others divide a page.
FLOW = frozenset("ul ol dl table td th blockquote figure details summary address center dir hgroup".split())
OFF_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager share sharing social related recommended recommendations comment comments disqus "
    "respond reply replies form login signup search widget widgets copyright skip".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))
ARTICLE_WORDS = frozenset("article post entry content story main page title".split())
PLAIN_WORDS = frozenset(("with", "has", "no", "without"))
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Blocks that hold no others, or divide nothing: they are no containers, unless a label tells against them.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt dd tr thead tbody tfoot figcaption caption hr".split())
#: A container is chosen if it holds this part of a page's text and none of its own containers does.
SHARE = 0.75
#: Scores, in thousandths: against a label or tag that tells against main text, and for one that tells for it.
AGAINST, FOR = 2000, 500

_tag = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*)>|<[!?][^>]*>",
    re.DOTALL,
)
_attribute = re.compile(r"(?<![^\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.IGNORECASE)
_digits = re.compile(r"\d+")
_parts = re.compile(r"[^a-z]+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node(NamedTuple):
    """An open element: its name, the container that it is or stands in, whether it is never read or is in an article."""

    name: str
    container: int
    unread: bool
    inside: bool


class Piece(NamedTuple):
    """A block of text: segments (container, linked, text) and the container of the whole."""

    segments: list[tuple[int, bool, str]]
    container: int


class Container:
    """An element that is scored: where it stands, what its tag and labels say, and the range of its pieces."""

    __slots__ = ("name", "parent", "path", "against", "inside", "begin", "end")

    def __init__(self, name: str, parent: int, path: int, against: bool, inside: bool, begin: int):
        self.name, self.parent, self.path, self.against, self.inside, self.begin, self.end = name, parent, path, against, inside, begin, begin


class Page(NamedTuple):
    """Pieces in page order, and containers, each after its parent; the first is the page itself."""

    pieces: list[Piece]
    containers: list[Container]


class Block(NamedTuple):
    """What is left of a piece: its text, the part of it that is no link, and its container."""

    text: str
    plain: int
    container: int


def _is_unread(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is never shown as text."""
    if name in SKIPPED:
        return True
    return name not in ("html", "body") and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(_hidden.search(attributes.get("style", ""))))


def _tells_against(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element's tag, role or labels are those of menus, notices, adverts, forms or comments."""
    if name in OFF_TAGS or name == "header" and not inside:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    if attributes.get("role", "").lower() in OFF_ROLES:
        return True
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for label in value.lower().split():
            words = set(_parts.split(label))
            if words & OFF_WORDS and not words & PLAIN_WORDS or words & HEADER_WORDS and not words & ARTICLE_WORDS:
                return True
    return False


def _path(above: int, name: str, attributes: dict[str, str]) -> int:
    """Number of a generalised path: the number of the path above, the tag, and the first class without digits."""
    label = attributes.get("class", "").lower().split()
    step = f"{above}/{name}.{_digits.sub('N', label[0]) if label else ''}"
    return int.from_bytes(blake2b(step.encode(), digest_size=8).digest(), "little", signed=True)


def read_page(html: str) -> Page:
    """All text that a page may show, in blocks, with the containers that it stands in.

    Nothing is judged here: menus, adverts and the like are pieces as the article is.  Work and memory
    are linear in the page, however deep it nests.
    """
    pieces: list[Piece] = []
    containers = [Container("", 0, 0, False, False, 0)]
    stack = [Node("", 0, False, False)]
    opened: Counter[str] = Counter()
    segments: list[tuple[int, bool, str]] = []
    at = 0

    def flush() -> None:
        nonlocal segments
        if any(not text.isspace() for _, _, text in segments):
            k = stack[-1].container
            while containers[k].name not in BLOCKS and k:  # an inline element with a label ends no block
                k = containers[k].parent
            pieces.append(Piece(segments, k))
        segments = []

    def pop_to(k: int) -> None:
        if any(n.name in BLOCKS for n in stack[k:]):
            flush()
        for i in range(len(stack) - 1, k - 1, -1):
            opened[stack[i].name] -= 1
            if stack[i].container != stack[i - 1].container:
                containers[stack[i].container].end = len(pieces)
        del stack[k:]

    # No tag ends after the last `>`; what looks like one there is text, but for an open comment.
    last = html.rfind(">") + 1
    if (open_comment := html.find("<!--", last)) >= 0:
        html = html[:open_comment]
    while at <= len(html):
        m = _tag.search(html, at, last) if at < last else None
        if not stack[-1].unread:
            words = unescape(html[at : m.start() if m else len(html)])
            if words:
                segments.append((stack[-1].container, opened["a"] > 0, words))
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            at = len(html)
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0) if opened[name] else 0
            if k:
                pop_to(k)
            elif name in BLOCKS and not stack[-1].unread:
                flush()
            continue
        if name == "br":
            segments.append((stack[-1].container, False, " "))
            continue
        block = name in BLOCKS
        if block and opened["p"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name in SCOPES), 0)
            if k and stack[k].name == "p":
                pop_to(k)
        if name in CLOSES and any(opened[c] for c in CLOSES[name]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in CLOSES[name]:
                    pop_to(i)
                elif stack[i].name in SCOPES and stack[i].name not in ("td", "th"):
                    break
        if block:
            flush()
        if name in VOID:
            continue
        top = stack[-1]
        rest = m["rest"] or m["rest2"] or ""
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in _attribute.findall(rest)} if "=" in rest or "hidden" in rest.lower() else {}
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if rest.endswith("/") and not block:
            continue
        unread = top.unread or _is_unread(name, attributes)
        against = not unread and _tells_against(name, attributes, top.inside)
        inside = top.inside or name == "article"
        own = top.container
        if against or block and not unread and name not in PLAIN:
            own = len(containers)
            containers.append(Container(name, top.container, _path(containers[top.container].path, name, attributes), against, inside, len(pieces)))
        stack.append(Node(name, own, unread, inside))
        opened[name] += 1
    pop_to(1)
    flush()
    containers[0].end = len(pieces)
    return Page(pieces, containers)


def scores(page: Page) -> list[int | None]:
    """Score of every container with text, in thousandths; below zero it is no main text.

    It counts its part of the page's unlinked text, and its tag and labels, for or against; a division
    outside articles that is mostly links counts these against itself.
    """
    total = [0] * len(page.containers)
    plain = [0] * len(page.containers)
    for piece in page.pieces:
        for container, linked, text in piece.segments:
            size = len(" ".join(text.split()))
            total[container] += size
            plain[container] += 0 if linked else size
    for k in range(len(page.containers) - 1, 0, -1):
        total[page.containers[k].parent] += total[k]
        plain[page.containers[k].parent] += plain[k]
    out: list[int | None] = []
    for c, size, bare in zip(page.containers, total, plain, strict=True):
        if not size:
            out.append(None)
            continue
        score = 1000 * bare // plain[0] if plain[0] else 0
        linked = 1000 * (size - bare) // size
        if linked > 500 and not c.inside and c.name not in FLOW and c.name not in ("", "html", "body", "main"):
            score -= linked
        out.append(score - AGAINST * c.against + FOR * (c.name in ("article", "main")))
    return out


def left_blocks(page: Page, score: list[int | None], dropped: frozenset[int] = frozenset(), spared: frozenset[int] = frozenset()) -> list[Block]:
    """Every piece without the text of the containers that go: those below zero, but for what the host decided otherwise."""
    off: list[bool] = []
    for k, c in enumerate(page.containers):
        own = c.path in dropped or (score[k] or 0) < 0 and c.path not in spared
        off.append(bool(k) and (own or off[c.parent]))
    out = []
    for piece in page.pieces:
        left = [s for s in piece.segments if not off[s[0]]]
        text = " ".join("".join(s[2] for s in left).split())
        linked = len(" ".join("".join(s[2] for s in left if s[1]).split()))
        out.append(Block(text, max(0, len(text) - linked), piece.container))
    return out


def own_path(page: Page, blocks: list[Block]) -> tuple[int, int]:
    """Path of the innermost container with `SHARE` of the unlinked text, and that text's size; 0 and 0 without one."""
    held = [0] * len(page.containers)
    for b in blocks:
        held[b.container] += b.plain
    for k in range(len(held) - 1, 0, -1):
        held[page.containers[k].parent] += held[k]
    best = max((k for k, size in enumerate(held) if size >= SHARE * held[0]), default=0) if held[0] else 0
    return page.containers[best].path, held[0]


def _widened(page: Page, blocks: list[Block], wanted: list[int]) -> list[bool]:
    """Which blocks belong to the articles that the wanted containers stand in.

    A container widens to the nearest article around it, or else main.  Each ancestor from there on, or
    from the container where there is neither, is taken whole if all that it adds is mostly unlinked;
    of others, and of the body, only the unlinked blocks that stand in no inner division are taken.
    Every block is looked at once.
    """
    containers = page.containers
    article, main, divisions = [0], [0], [0]
    for k, c in enumerate(containers[1:], 1):
        article.append(k if c.name == "article" else article[c.parent])
        main.append(k if c.name == "main" else main[c.parent])
        divisions.append(divisions[c.parent] + (c.name not in FLOW))
    after = list(range(len(blocks) + 1))

    def fresh(k: int) -> list[int]:
        """The blocks of a container that were not looked at before."""
        found, i = [], containers[k].begin
        while True:
            root = i
            while after[root] != root:
                root = after[root]
            while after[i] != root:
                after[i], i = root, after[i]
            if root >= containers[k].end:
                return found
            if blocks[root].text:
                found.append(root)
            after[root] = i = root + 1

    taken = [False] * len(blocks)
    tops = sorted({article[k] or main[k] or k for k in wanted}, reverse=True)
    ahead: set[int] = set()
    for k in tops:
        for i in fresh(k):
            taken[i] = True
        while k and containers[k].parent not in ahead:
            k = containers[k].parent
            ahead.add(k)
    for k in sorted(ahead, reverse=True):  # inner ones first
        more = fresh(k)
        plain = [i for i in more if 2 * blocks[i].plain >= len(blocks[i].text)]
        if len(plain) < len(more) or containers[k].name in ("", "html", "body"):
            plain = [i for i in plain if divisions[blocks[i].container] == divisions[k]]
        for i in plain:
            taken[i] = True
    return taken


def text_at(page: Page, path: int | None, dropped: frozenset[int] = frozenset(), spared: frozenset[int] = frozenset()) -> str:
    """Blocks of the article around the containers of a path; where the page has none of it, around its own best one."""
    blocks = left_blocks(page, scores(page), dropped, spared)
    holds = lambda k: any(b.text for b in blocks[page.containers[k].begin : page.containers[k].end])
    wanted = [k for k, c in enumerate(page.containers) if path is not None and c.path == path]
    if not any(map(holds, wanted)):
        own = own_path(page, blocks)[0]
        wanted = [k for k, c in enumerate(page.containers) if c.path == own]
    whole = _widened(page, blocks, wanted)
    return "\n\n".join(b.text for b, took in zip(blocks, whole, strict=True) if took)


_VOTE = "host string, path long, best boolean, kept long, gone long, score long"
_VOTE_ARROW = pa.schema([("host", pa.string()), ("path", pa.int64()), ("best", pa.bool_()), ("kept", pa.int64()), ("gone", pa.int64()), ("score", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each page, summed over a batch: for its best container's path, and for or against the path of every container."""
    for batch in batches:
        sums: dict[tuple, list[int]] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = read_page(html or "")
            score = scores(page)
            path, size = own_path(page, left_blocks(page, score))
            if size:
                own = sums.setdefault((host, path, True), [0, 0, 0])
                own[0] += 1
                own[2] += size
            for c, value in zip(page.containers, score, strict=True):
                if value is not None and c.path:
                    own = sums.setdefault((host, c.path, False), [0, 0, 0])
                    own[value < 0] += 1
                    own[2] += value
        rows = [(*key, *value) for key, value in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _VOTE_ARROW.types, strict=True)], schema=_VOTE_ARROW)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[tuple, frozenset] = {}
        texts = []
        for html, path, *lists in zip(*(batch.column(c).to_pylist() for c in ("html", "path", "dropped", "spared")), strict=True):
            dropped, spared = (known.setdefault(tuple(x or ()), frozenset(x or ())) for x in lists)
            texts.append(text_at(read_page(html or ""), path, dropped, spared))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _mixed(verdict: str):
    return F.collect_list(F.when(F.expr(f"NOT best AND kept > 0 AND gone > 0 AND {verdict}"), F.col("path")))


def host_paths(pages: DataFrame) -> DataFrame:
    """What the pages (`host`, `html`) of each host decided: host, path, dropped and spared.

    `path` is the winner among the best containers' paths.  A path whose containers all scored alike
    needs no decision; of the others those are dropped whose scores sum to less than zero, and the rest
    are spared.
    """
    votes = pages.mapInArrow(_votes, _VOTE)
    sums = votes.groupBy("host", "path", "best").agg(*(F.sum(c).alias(c) for c in ("kept", "gone", "score")))
    winner = F.min(F.when(F.col("best"), F.struct(-F.col("kept"), -F.col("score"), F.col("path"))))
    return sums.groupBy("host").agg(winner["path"].alias("path"), _mixed("score < 0").alias("dropped"), _mixed("score >= 0").alias("spared"))


def extract_text(pages: DataFrame, held_bytes: int = 32 << 20, vote: bool = True) -> DataFrame:
    """Main text of every row of `pages` (`page_id`, `url`, `html`): page_id, url, text, n_chars.

    First each page's containers are scored (see `scores`).  Every page then votes for the path (tags
    and first classes, digits generalised) of the innermost container that holds most of its text, and
    for or against the path of every container that it has.  Votes are summed per host.  Then every
    page is extracted anew: what stands under paths that the host voted out goes, and the article is
    that around the host's winning path (most votes, then most text, then the least number), or around
    the page's own best container where it lacks that; what stands beside the container in the article
    is taken too (see `_widened`).  Without `vote` each page goes by its own scores, to measure what the
    consensus adds.

    A null html is empty and gives an empty text, as does a page without text; a null url counts as a
    host of its own name, empty; repeated rows are extracted each; an empty table gives no rows; other
    columns are dropped.  A page of any length or depth is read whole in linear work; memory follows
    the longest page.  Hosts' decisions, one short row a host, are broadcast only if they measure up to
    `held_bytes`; else they are joined, by a join that Spark can split at a hot host.
    """
    bound_batches(pages.sparkSession)
    frame = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if not vote:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("path", "long"), ("dropped", "array<long>"), ("spared", "array<long>"))]
        return frame.select("page_id", "url", "html", *nothing).mapInArrow(_extract, _EXTRACTED)
    best = cut(host_paths(frame.select("host", "html")).withColumnRenamed("host", "voted"))
    if (best.agg(F.sum(F.octet_length("voted") + 8 * (F.size("dropped") + F.size("spared")) + 64)).first()[0] or 0) <= held_bytes:
        best = F.broadcast(best)
    return frame.join(best, F.col("host") == F.col("voted"), "left").select("page_id", "url", "html", "path", "dropped", "spared").mapInArrow(_extract, _EXTRACTED)


_EXTRACTED = "page_id long, url string, text string, n_chars long"


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, f"{sf_dir}/pages.parquet"))
