"""Main text of web pages: site templates, with semantic elements as what is known beforehand.

Every page is parsed into blocks of text, each with the elements it stands in. Every container and leaf is hashed with
all that is in it, and Spark counts for each host on how many pages such a subtree is; subtrees that recur on many of
them are deleted, inside articles too. Copies of a page count once (by a hash of the text that they have without
templates), so that copied articles don't become templates.

Beforehand go elements that are navigation, footers, asides, forms, scripts and the like by tag or role, that are hidden,
or whose class or id says nothing but such a thing ("ad", "share-buttons"; not "share-price" or "has-sidebar"). Where a
page has an article (or main) element, only that counts, whatever the class of what stands around it.

Counting pre-aggregates in each task; a host's templates are bounded in number by their least share of its pages.

Defined results: null or empty pages have an empty text; a null url has the empty host; repeated rows count as one page;
elements may nest to any depth and pages be of any length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common

#: A subtree is a template if it is on so many different pages of its host and so large a share of them; in an article, or not.
IN_ARTICLE, ELSEWHERE = (10, 0.5), (5, 0.2)
#: An element with more items than this stands in its parent by their hash, so that deep nests are not read again and again.
MOST_ITEMS = 16
#: Hashes of templates that are broadcast (8 MB), which is checked.
MOST_BROADCAST = 1_000_000

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = {"head", "nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "datalist", "math"} | RAW
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
CONTAINER = set("div section aside ul ol dl table form figure header blockquote".split())
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd pre".split())
MAIN = {"article", "main"}
#: Words that mark what is not main text, where a class or an id holds nothing else but them and PLAIN words.
BAD = set("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup pagination pager promo promotion related reply replies share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: As these do outside an article only.
BAD_OUTSIDE = {"header", "search"}
PLAIN = set("area articles bar block bottom box button buttons col column container content desktop fixed floating form global group holder icon icons inner item items left link links list main message mobile news outer overlay page pane panel post posts primary right row secondary section sign signup site slot sticky stories text thread title toggle top unit up us wrap wrapper zone".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar", "form"}
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: What a start tag ends if it is open: only up to the nearest of the second set.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SPLIT = re.compile(r"[_\-:]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d)")


def says(names: str, words: set[str]) -> bool:
    """Whether one of the `names` (of a class or id) holds one of `words` and, but for PLAIN words and numbers, nothing else."""
    for name in names.split():
        parts = [w.lower() for w in SPLIT.split(name) if w]
        if any(w in words for w in parts) and all(w in words or w in BAD or w in PLAIN or w.isdigit() for w in parts):
            return True
    return False


class Page:
    """blocks: (text, in main, number of the innermost hashed element or -1); trees: hash and in main of each hashed
    element; parents: number of the hashed element around each, or -1."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, int]] = []
        self.trees: list[tuple[int, bool]] = []
        self.parents: list[int] = []
        self.has_main = False
        self._parts: list[str] = []
        # Open elements: tag, whether it is left out, number of its tree or -1, items at its start, whether it is main, and
        # how many elements left out were open around it if it counts in spite of them.
        self._open: list[tuple[str, bool, int, int, bool, int]] = []
        self._places: dict[str, list[int]] = {}  # of the open elements, by tag
        self._tree = -1  # the innermost open one
        self._items: list[str] = []
        self._skips = self._mains = self._sure = 0
        self._parse(source)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts = []
            if text:
                self.blocks.append((text, self._mains > 0, self._tree))
                self._items.append(text)

    def _pop(self) -> None:
        tag, skips, tree, start, main, around = self._open.pop()
        self._places[tag].pop()
        self._skips += around - skips
        self._mains -= main
        if len(self._items) - start > MOST_ITEMS:
            own = "\0".join(self._items[start:])
            self._items[start:] = ["#" + blake2b(own.encode("utf-8", "replace"), digest_size=16).hexdigest()]
        if tree >= 0:
            name, main = self.trees[tree]
            own = "\0".join([str(name), *self._items[start:]])
            self.trees[tree] = (int.from_bytes(blake2b(own.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), main)
            self._tree = self.parents[tree]
        self._items.append(">")

    def _close(self, tags: set[str], within: set[str]) -> None:
        """End the innermost open element of `tags`, unless one of `within` is nearer."""
        last = lambda names: max((self._places[t][-1] for t in names if self._places.get(t)), default=-1)
        k = last(tags)
        if k < 0 or last(within) > k:
            return
        if any(o[0] in BLOCK for o in self._open[k:]):
            self._flush()
        while len(self._open) > k:
            self._pop()

    def _start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"button", "table", "td", "th", "article", "section", "div", "li", "blockquote", "main", "body"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        # By tag, role or style an element is surely left out; by its names unless the first article is in it.
        sure = tag in SKIP or tag == "header" and not self._mains
        named, mark = False, ""
        if attrs and tag not in ("html", "body"):
            for name, *value in ATTRIBUTE.findall(attrs):
                name, text = name.lower(), "".join(value)
                if name in ("class", "id"):
                    mark += text
                    named = named or says(text, BAD) or not self._mains and says(text, BAD_OUTSIDE)
                elif name == "role":
                    mark += text
                    sure = sure or text.strip().lower() in ROLES
                elif name == "style":
                    sure = sure or bool(UNSEEN.search(text))
                else:
                    sure = sure or text == "true"
            if "hidden" in attrs.lower():
                sure = sure or bool(HIDDEN.search(QUOTED.sub('""', attrs)))
        first = tag in MAIN and not self.has_main and not sure and not self._sure
        bad = sure or named and not first
        around = self._skips if first else 0
        self._skips += bad - around
        self._sure += sure
        main = tag in MAIN and not self._skips
        self._mains += main
        self.has_main = self.has_main or main
        tree = -1
        if not self._skips and (tag in CONTAINER or tag in LEAF):
            tree = len(self.trees)
            self.trees.append((f"{tag}.{mark}", self._mains > 0))
            self.parents.append(self._tree)
            self._tree = tree
        self._items.append("<" + tag)
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, bad, tree, len(self._items), main, around))

    def _text(self, text: str) -> None:
        if text and not self._skips:
            self._parts.append(entities.unescape(text) if "&" in text else text)

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            self._text(source[at : m.start()])
            at = m.end()
            end, tag, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
            if not tag:
                if m.group().startswith("<![CDATA["):
                    self._text(m.group()[9:-3])
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self._flush()
            elif tag in ("br", "td", "th"):
                self._parts.append(" ")
            if end:
                if tag == "p" or tag not in VOID:
                    scope = set() if tag in MAIN or tag in ("body", "html", "div", "section") else {"td", "th", *MAIN} - {tag}
                    self._close({tag}, scope)
            elif tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            elif tag not in VOID and not attrs.endswith("/"):
                self._start(tag, attrs)
        self._flush()
        while self._open:
            self._pop()

    def candidates(self) -> set[tuple[int, bool]]:
        """Hashes that may be templates: of elements that would stay."""
        return {t for t in self.trees if t[1] or not self.has_main}

    def text(self, templates: set[int] = frozenset()) -> str:
        gone = [False]  # of each element and, last, of none
        if templates:
            for (h, _), parent in zip(self.trees, self.parents):  # parents come first
                gone.insert(-1, h in templates or parent >= 0 and gone[parent])
        else:
            gone *= len(self.trees) + 1
        kept = [t for t, main, tree in self.blocks if (main or not self.has_main) and not gone[tree]]
        return "\n".join(kept)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to a slash, question mark or hash, A-Z lower-cased; empty without."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def templates(pages: DataFrame) -> DataFrame:
    """(host, hashes): of each host, the subtrees that recur on enough of its pages. `pages` has host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "html"):
            texts, trees = [], []
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                texts.append(int.from_bytes(blake2b(page.text().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
                trees.append([{"h": 0, "main": False}, *({"h": h, "main": main} for h, main in page.candidates())])  # 0: the page itself
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array(texts, pa.int64()), pa.array(trees, pa.list_(pa.struct([("h", pa.int64()), ("main", pa.bool_())])))], names=["host", "page", "trees"]
            )

    each = pages.mapInArrow(run, "host string, page long, trees array<struct<h: long, main: boolean>>").dropDuplicates(["host", "page"])
    counts = each.select("host", F.inline("trees")).groupBy("host", "h", "main").agg(F.count("*").alias("n"))
    counts = _common.stash(counts.where(F.expr(f"h = 0 OR n >= {min(IN_ARTICLE[0], ELSEWHERE[0])}")))
    total = counts.where("h = 0").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("main"), F.greatest(F.lit(IN_ARTICLE[0]), IN_ARTICLE[1] * F.col("pages"))).otherwise(F.greatest(F.lit(ELSEWHERE[0]), ELSEWHERE[1] * F.col("pages")))
    found = counts.where("h <> 0").join(total, "host").where(F.col("n") >= least)
    return found.groupBy("host").agg(F.collect_set("h").alias("hashes"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    pages = pages.withColumn("host", F.coalesce("host", F.lit("")))
    found = _common.stash(templates(pages.select("host", "html")))
    # Pages move only if there are more templates than can be sent to every executor.
    few = found.agg(F.coalesce(F.sum(F.size("hashes") + 8), F.lit(0))).first()[0] <= MOST_BROADCAST
    known = pages.join(F.broadcast(found) if few else found, "host", "left").select("page_id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches, "html"):
            texts = [Page(h or "").text(set(t or ())) for h, t in zip(batch.column("html").to_pylist(), batch.column("hashes").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return known.mapInArrow(run, schema)
