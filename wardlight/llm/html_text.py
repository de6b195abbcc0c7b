"""Main text of web pages: site templates are found by counting element subtrees per host.

Every element of a page has a hash of its tag, texts and child elements.  Spark counts,
for each host, on how many different pages a subtree occurs; common ones are the site's
template and are deleted, with all that they hold.  A block of text inside an article,
or of more than ``BOX_CHARS`` characters anywhere, is common on most pages only, so that
quoted passages and stories told by several pages stay; a short box (a notice, advert or
menu) already on a small share or number of pages.  Elements that never hold an
article's text (menus, scripts, forms, adverts and so on) go by their tag, role, class
or id, unless the page's only text is an article inside; they are counted too, so that the
same block without the class goes as well.  If the page marks its article, only that is
kept; marked teasers beside a far longer text are not the article.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.workspace import Workspace

#: A subtree on more than this share of a host's different pages, and on so many at least, is template.
SHARE = 0.5
LEAST_PAGES = 5
#: The same for boxes, which are all blocks but the paragraphs of an article.
BOX_SHARE = 0.1
#: On so many pages a box needs a tenth of its share only, which bounds the list of a large host.
BOX_PAGES = 50
#: A box has so many characters at most.
BOX_CHARS = 200
#: What articles mark is the main text if it is this share of all text at least.
ARTICLE_SHARE = 0.25
#: Bytes of template hashes that may be broadcast to the pages.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/a-zA-Z][^>]*(?:>|\Z)|([^<]+|<)",
    re.S,
)
_RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg math canvas button select textarea"
    " input dialog menu audio video map xmp noembed noframes".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Elements that hold a paragraph's text, a quotation, a list or a table.
_PARAGRAPHS = frozenset(
    "address blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup legend li ol p pre summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: An opened element closes an open one of these kinds, up to the nearest of the bounds.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
_SCOPE = ("table", "td", "th", "caption", "button", "object", "html")
#: What an opened element may close, and for each tag where it counts as such or as a bound.
_CLOSERS = list(dict.fromkeys([(("p",), _SCOPE), *_SIBLINGS.values()]))
_COUNTED: dict[str, list[tuple[int, bool]]] = {}
for _i, (_tags, _bounds) in enumerate(_CLOSERS):
    for _tag in {*_tags, *_bounds}:
        # A bound that is also closed (a cell in a cell) counts as what is closed.
        _COUNTED.setdefault(_tag, []).append((_i, _tag not in _tags))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation"
    " menu breadcrumb breadcrumbs footer header masthead comment comments disqus cookie cookies consent notice notices gdpr"
    " newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended widget"
    " skip toolbar pagination pager".split()
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Words that may stand beside those names; any other makes the name one of content.
_BESIDE = frozenset(
    "site page article main top bottom left right box block bar list area section wrapper wrap container content inner outer"
    " button buttons link links post posts item items unit slot global primary secondary mobile desktop".split()
)
_NAME_PARTS = re.compile(r"[_\-:]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _names_template(value: str, in_article: bool) -> bool:
    """True if a class or id is made of the listed names, as ``site-footer``, unlike ``no-sidebar`` or ``share-price``."""
    for name in value.split():
        parts = {part for part in _NAME_PARTS.split(name) if part}
        # A headline's header is part of the article.
        if parts <= _NAMES | _BESIDE and not _NAMES.isdisjoint(parts - ({"header"} if in_article else set())):
            return True
    return False


#: Dropped elements that may be wrapped around a whole page.
_WRAPPERS = frozenset(["form", "header"])


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """True for elements that hold no article text, whatever the site."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and value and _names_template(value, in_article):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class Page:
    """One walk over a page; collects blocks of text and the hashes of its subtrees.

    ``template`` holds the hashes of subtrees to delete.  The hashes of boxes are even,
    those of other blocks odd.  ``unwrap`` keeps articles inside elements that would be
    dropped by their name, role or as a form.
    """

    def __init__(self, source: str, template: frozenset[int] = frozenset(), unwrap: bool = False):
        self.hashes: set[int] = set()
        self._template, self._unwrap = template, unwrap
        #: True if an element dropped by name holds an article.
        self.wrapped = False
        #: Place on the stack of the open element that never holds an article.
        self._hard = 0
        self._open: dict[str, int] = {}
        self._counts: list[list[int]] = [[0] for _ in _CLOSERS]
        self._chars = [0]
        self._blocks: list[str] = []
        self._parts: list[str] = []
        self.article: list[str] = []
        # tag, blocks and parts so far, pieces to hash, blocks of the outermost article begin here
        self._stack: list[tuple[str, int, int, list[bytes], bool]] = [("", 0, 0, [], False)]
        self._skip = 0
        #: Hashes below a listed element that is open are not kept, only its own.
        self._listed: list | None = None
        self._depth_article = 0
        self._walk(source)
        while len(self._stack) > 1:
            self._close()
        self._flush()
        self.root = self._hash(self._stack[0][3], "")

    def text(self) -> str:
        marked = sum(map(len, self.article))
        whole = not marked or marked < ARTICLE_SHARE * sum(map(len, self._blocks))
        return "\n".join(self._blocks if whole else self.article)

    def _walk(self, source: str) -> None:
        at, end = 0, len(source)
        match = _TOKEN.match
        while at < end:
            found = match(source, at)
            at = found.end()
            closing, tag, attributes, text = found.groups()
            if text is not None:
                if not self._skip:
                    self._add(text)
                elif self._listed is not None and self._stack[-1][0] not in _RAW:
                    self._note(html.unescape(text) if "&" in text else text)
            elif tag:
                tag = tag.lower()
                if closing:
                    self._end(tag)
                    continue
                self._start(tag, attributes)
                if tag in _RAW:
                    stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                    at = stop.start() if stop else end

    def _add(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._parts.append(text)
        self._note(text)

    def _note(self, text: str) -> None:
        if text.strip():
            text = " ".join(text.split())
            self._chars[-1] += len(text)
            self._stack[-1][3].append(text.encode("utf-8", "surrogatepass"))

    def _flush(self) -> None:
        if self._parts:
            block = " ".join("".join(self._parts).split())
            self._parts.clear()
            if block:
                self._blocks.append(block)

    def _start(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in _CLOSES_P:
            self._close_to(0)
        if tag in _SIBLINGS:
            self._close_to(_CLOSERS.index(_SIBLINGS[tag]))
        if tag in _VOID:
            if not self._skip:
                if tag == "br":
                    self._parts.append(" ")
                elif tag == "hr":
                    self._flush()
            return
        if self._skip and not self._hard and tag in ("article", "main"):
            self.wrapped = True
            if self._unwrap:
                # All that is open around the article becomes a plain element.
                self._skip, self._listed = 0, None
        if self._skip or _dropped(tag, attributes, self._depth_article > 0):
            if not self._skip and tag not in _INLINE and tag not in _RAW:
                # Listed elements are counted as wholes.
                self._listed = []
            if not self._hard and tag in _DROPPED and tag not in _WRAPPERS:
                self._hard = len(stack)
            self._skip += 1
        elif tag not in _INLINE:
            self._flush()
        outermost = tag in ("article", "main") and not self._skip and not self._depth_article
        if tag in ("article", "main") and not self._skip:
            self._depth_article += 1
        stack.append((tag, len(self._blocks), len(self._parts), [], outermost))
        self._chars.append(0)
        self._open[tag] = self._open.get(tag, 0) + 1
        for i, bound in _COUNTED.get(tag, ()):
            if bound:
                self._counts[i].append(0)
            else:
                self._counts[i][-1] += 1

    def _end(self, tag: str) -> None:
        # Each step closes an element, so that a page takes time by its length.
        if self._open.get(tag):
            while self._stack[-1][0] != tag:
                self._close()
            self._close()

    def _close_to(self, closer: int) -> None:
        """Close the innermost open element of a kind, if there is one inside its bounds."""
        if self._counts[closer][-1]:
            tags = _CLOSERS[closer][0]
            while self._stack[-1][0] not in tags:
                self._close()
            self._close()

    def _hash(self, pieces: list[bytes], tag: str) -> int:
        digest = hashlib.blake2b(b"\x00".join([tag.encode(), *pieces]), digest_size=8).digest()
        return int.from_bytes(digest, "little", signed=True)

    def _kind(self, own: int, tag: str, chars: int) -> int:
        return own | 1 if chars > BOX_CHARS or self._depth_article and tag in _PARAGRAPHS else own & ~1

    def _close(self) -> None:
        tag, blocks, parts, pieces, outermost = self._stack.pop()
        chars = self._chars.pop()
        self._chars[-1] += chars
        self._open[tag] -= 1
        if len(self._stack) == self._hard:
            self._hard = 0
        for i, bound in _COUNTED.get(tag, ()):
            if bound:
                self._counts[i].pop()
            else:
                self._counts[i][-1] -= 1
        if self._skip:
            self._skip -= 1
            if self._listed is not None and pieces:
                own = self._hash(pieces, tag)
                if self._skip:
                    self._stack[-1][3].append(b"\x01" + own.to_bytes(8, "little", signed=True))
                else:
                    self.hashes.add(self._kind(own, tag, chars))
            if not self._skip:
                self._listed = None
            return
        if tag not in _INLINE:
            self._flush()
        if pieces:
            own = self._hash(pieces, tag)
            self._stack[-1][3].append(b"\x01" + own.to_bytes(8, "little", signed=True))
            # Inline elements go only with the whole block that holds them.
            if tag not in _INLINE and tag not in ("html", "body", "article", "main"):
                own = self._kind(own, tag, chars)
                self.hashes.add(own)
                if own in self._template:
                    del self._blocks[blocks:]
                    del self._parts[parts:]
        if tag in ("article", "main"):
            self._depth_article -= 1
        if outermost:
            self.article += self._blocks[blocks:]


def read_page(source: str, template: frozenset[int] = frozenset()) -> Page:
    """Walk a page; an article inside a dropped element counts only if there is no other text."""
    page = Page(source, template)
    return Page(source, template, unwrap=True) if page.wrapped and not page.text() else page


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [read_page(source.as_py() or "") for source in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([host_of(u) for u in batch.column("url").to_pylist()]),
                pa.array([p.root for p in pages], pa.int64()),
                pa.array([sorted(p.hashes) for p in pages], pa.list_(pa.int64())),
            ],
            ["host", "page", "subtrees"],
        )


def templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """``host, template, boxes``: the hashes of subtrees that are common on a host's different pages.

    ``template`` has those on more than ``share`` of the pages, ``boxes`` the boxes on fewer.
    """
    found = pages.select("url", "html").mapInArrow(_subtrees, "host string, page long, subtrees array<long>")
    # Copies of a page say nothing about its site: different pages count.
    different = found.groupBy("host", "page").agg(F.first("subtrees").alias("subtrees"))
    # One more "subtree" per page counts the pages.
    entries = different.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "subtrees")).alias("subtree"))
    counts = entries.groupBy("host", "subtree").count()
    sizes = counts.filter("subtree IS NULL").select("host", F.col("count").alias("pages"))
    most = F.col("count") > share * F.col("pages")
    many = (F.col("count") > BOX_SHARE * F.col("pages")) | (
        (F.col("count") >= BOX_PAGES) & (F.col("count") > BOX_SHARE / 10 * F.col("pages"))
    )
    box = F.col("subtree").bitwiseAND(F.lit(1)) == 0
    common = counts.filter(f"subtree IS NOT NULL AND count >= {least}").join(sizes, "host").filter(most | box & many)
    # A page has a bounded number of elements, and each subtree here is on a share of the pages.
    return common.groupBy("host").agg(
        *(F.sort_array(F.collect_list(F.when(c, F.col("subtree")))).alias(n) for n, c in (("template", most), ("boxes", ~most)))
    )


def main_text(source: str, template: frozenset[int], boxes: frozenset[int]) -> str:
    """A page's text without its host's template and boxes; boxes stay if there is nothing else."""
    page = read_page(source, template | boxes)
    if page.article or boxes.isdisjoint(page.hashes):
        return page.text()
    with_boxes = read_page(source, template)
    return with_boxes.text() if with_boxes.article else page.text() or with_boxes.text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
    for batch in batches:
        texts = []
        columns = (batch.column(n) for n in ("html", "template", "boxes"))
        for host, source, template, boxes in zip(batch.column("_host").to_pylist(), *columns):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                known[host] = frozenset(template.as_py() or ()), frozenset(boxes.as_py() or ())
            texts.append(main_text(source.as_py() or "", *known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts), pa.array(np.array([len(t) for t in texts], np.int64))],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(
    pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, workspace: Workspace | None = None
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    A block's white space becomes single spaces; blocks are joined by a line end.  Null
    html is empty and gives an empty text; so does a page without an article's text.
    Pages without a host in their url count as one host.  Repeated rows give repeated
    results.  An empty table gives no rows.
    """
    ws = workspace or Workspace(pages.sparkSession)
    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    known = ws.write(templates(narrow, share, least), "templates").withColumnRenamed("host", "_host")
    size = known.agg(F.coalesce(F.sum(8 * (F.size("template") + F.size("boxes")) + F.length("_host") + 64), F.lit(0)).alias("s")).first()["s"]
    # The same host as host_of(), in the JVM.
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = narrow.withColumn("_host", host).join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "_host", "left")
    return joined.select("page_id", "url", "html", "_host", "template", "boxes").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
