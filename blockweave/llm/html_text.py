"""Main text of web pages, with each site's template taken out.

A page is read once into elements and blocks of text. Every element's subtree gets two hashes with its host: of its tags
and text, and of its structure, the tags and classes on the way to it. Spark counts per host in how many pages of different
main text each stands, and of a structure how much of a page's text it holds and in how many pages this differs. The
structure that holds at least half of its pages' text, different in most, is the host's main place; structures that
recur outside of it with little text are template, whatever they say, and so are subtrees that recur with their text.
Copies of one page count once, so copied articles do not pass for template; inside an article, paragraphs, headings and
list items are content and stay.

Where the counts of a host do not tell (few pages, no main place), and for what stands inside the main text, lists
decide: the text of ``main`` is kept, or else that of articles, with headings and paragraphs right beside either; a page
without both keeps all. Tags and roles say what is menu, header, footer, sidebar, form or dialog; whole class and id names
of boxes say what else is notice, advert or reader comment. Names do not apply to headings, paragraphs, articles and parts
of a sentence, nor to what holds ``main`` or the only article, and a box or form of running text inside the text stays.

Reading is linear in the page whatever its markup: a failed search for an end is never made twice.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, without, written

#: Template hashes that are sent to every worker (8 bytes each); beyond, each page gets its own by a join.
SENT_HASHES = 500_000
# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas select annotation annotation-xml".split())
ENDLESS = frozenset("script style textarea title".split())
HARD = frozenset("nav footer aside menu button head".split())
SOFT = frozenset("form dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mtable mtr mtd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("p li blockquote pre td th dd dt figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words that name boilerplate where they head a class or id name, those of reader comments, words that
# may follow such a word, and words that make a name one of a state.
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored share sharing social skip".split())
WORDS = ADVERTS | frozenset(
    "promo promos promotion banner cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search searchbox"
    " sidebar rail widget widgets related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation topbar footer masthead pagination pager toolbar".split()
)
# Of these words, the ones that name a box of the site wherever it stands; the others may name parts of a text.
FOREIGN = ADVERTS | frozenset("promo promos promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login".split())
CONTROLS = frozenset("input button select textarea".split())
#: Characters of paragraphs that make a form, and a box named as foreign, running text.
RUNNING, LONG_RUNNING = 150, 400
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
PAGE_HEADER = frozenset("header siteheader pageheader topheader".split())
TAIL = frozenset(
    "area articles bar block body bottom box btn button buttons col column container content desktop form group holder icons inner item items left link links list main mobile module news outer panel posts primary reading"
    " region right row secondary section slot stories top unit widget widgets wrap wrapper".split()
)
STATES = frozenset("no not non has have with without is are open opened closed enabled disabled active inactive allowed visible collapsed expanded".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+"""
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:{_VALUE})?+|=)*+)>""")
_ATTR = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_TOLD = frozenset("class id role hidden aria-hidden itemprop".split())
# Why an element goes: its tag, its role or name (given up where it holds the main text), or as reader comments.
STAYS, BY_TAG, BY_NAME, BY_COMMENT = range(4)


@lru_cache(65536)
def named(name: str) -> str:
    """The word that heads a class or id name, if it names boilerplate or a header; otherwise an empty string.

    The name is read as words; trailing words of position or kind do not count, and a name of a state has no head:
    ``site-footer`` and ``footer__inner`` are headed by footer, ``share-article`` by none, nor ``has-banner``.
    """
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or not STATES.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in TAIL or words[-1].isdigit()):
        words.pop()
    head = words[-1]
    if head in WORDS:
        return next((w for w in words if w in FOREIGN), head)
    if head in COMMENTS:
        return head
    return "header" if "".join(words[-2:]) in PAGE_HEADER or words == ["header"] else ""


def _told(attributes: str) -> tuple[int, bool, frozenset]:
    """Why an element of these attributes goes, whether they say that it is the main text, and the heads of its names."""
    why, main, heads = STAYS, False, set()
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name not in _TOLD:
            continue
        value = value[1:-1] if value[:1] in ("'", '"') else value
        if name in ("class", "id"):
            heads.update(named(n) for n in value.split())
        elif name == "role":
            why, main = BY_NAME if value.lower() in ROLES else why, main or value.lower() == "main"
        elif name == "itemprop":
            main = main or value == "articleBody"
        elif name == "hidden" or value.lower() == "true":
            why = BY_TAG
    heads.discard("")
    return why, main, frozenset(heads)


class _Element:
    __slots__ = ("tag", "parent", "why", "gone", "article", "main", "first", "parts", "has", "place", "foreign", "chars", "prose", "links", "controls", "said")

    def __init__(self, tag: str, parent, why: int, article: bool, main: bool, first: int, place: int = 0):
        self.tag, self.parent, self.why, self.article, self.main, self.first, self.place = tag, parent, why, article, main, first, place
        self.gone, self.parts, self.has, self.foreign, self.controls = False, [], set(), False, False
        # Characters of all blocks, of paragraphs and of links in the element, and a sum that tells its text.
        self.chars = self.prose = self.links = self.said = 0


class Page:
    """Blocks of text as [text, element], which of them the lists keep, subtrees as (hash, first block, end, in an article) and
    the structures of boxes as hashes with (share of the page's text in thousandths, hash of its text).

    Hashes are multiples of four; in what the counts tell, a template's structure is its hash plus 1, a main place plus 2.
    ``lists=False`` leaves all to the counts.
    """

    def __init__(self, raw: str | None, host: str, lists: bool = True):
        self.blocks: list[tuple] = []
        self.trees: list[tuple] = []
        self._host, self._lists, self._link = host, lists, False
        root = _Element("", None, STAYS, False, False, 0)
        self._all = [root]
        self._stack = [root]
        self._open: dict[str, int] = {}
        self._stray: set[str] = set()
        self._text: list[str] = []
        self._read(raw or "")
        self._break()
        while len(self._stack) > 1:
            self._pop()
        self.kept = self._choose()

    def _choose(self) -> list[bool]:
        """Which blocks are main text, as far as tags and names tell."""

        def settle():
            for e in self._all[1:]:  # parents come before their children
                e.gone = e.why != STAYS or e.parent.gone
            return [e for e in self._all if not e.gone and e.main == "here"], [e for e in self._all if not e.gone and e.tag == "article"]

        def clear(found) -> None:
            seen = set()
            for e in found:
                while e is not None and id(e) not in seen:
                    seen.add(id(e))
                    e.why, e = STAYS, e.parent

        if not self._lists:
            return [True] * len(self.blocks)
        mains, articles = settle()
        if not mains and not articles:
            # The only article gives up names on it and around it; names on the article itself count for more.
            barred = {id(self._all[0]): False}
            for e in self._all[1:]:
                barred[id(e)] = barred[id(e.parent)] or e.why in (BY_TAG, BY_COMMENT)
            found = [e for e in self._all if e.tag == "article" and not barred[id(e)]]
            clear([x for x in found if x.why == STAYS] or ([] if any(not b[1].gone for b in self.blocks) else found))
            if not found and self.blocks and all(b[1].gone for b in self.blocks):
                for e in self._all:
                    if e.why == BY_NAME and {"h1", "p"} <= e.has:
                        e.why = STAYS
            mains, articles = settle()
        if articles and not mains:  # an article may hold the title alone, and a box beside it the text
            outside = sum(len(t) for t, e in self.blocks if not e.gone and not e.article and e.tag in CONTENT)
            if outside >= RUNNING and 3 * sum(len(t) for t, e in self.blocks if not e.gone and e.article) < outside:
                articles = []
        if not mains and not articles:
            return [not e.gone for _, e in self.blocks]
        beside = {id(e.parent) for e in mains or articles}
        inside = (lambda e: e.main) if mains else (lambda e: e.article)
        return [not e.gone and bool(inside(e) or (e.tag in HEADINGS or e.tag == "p") and id(e.parent) in beside) for _, e in self.blocks]

    def _break(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                e = self._stack[-1]
                self.blocks.append((text, e))
                e.chars += len(text)
                e.said += xxhash.xxh3_64_intdigest(text)
                if e.tag in CONTENT and e.tag not in HEADINGS:
                    e.prose += len(text)

    def _push(self, tag: str, attributes: str) -> None:
        top = self._stack[-1]
        why, main, heads = _told(attributes) if attributes and not attributes.isspace() else (STAYS, False, frozenset())
        if not self._lists:
            why, main, heads = STAYS, False, frozenset()
        elif tag in CONTENT and tag != "li" or tag == "article":
            heads = heads & COMMENTS if tag == "article" else frozenset()
        if tag in ("body", "html") or not self._lists:
            why = STAYS
        elif tag in HARD:
            why = BY_TAG
        elif not COMMENTS.isdisjoint(heads):
            why = why or BY_COMMENT
        elif tag in SOFT or tag == "header" and not (top.article or top.main) or any(h != "header" or not (top.article or top.main) for h in heads):
            why = why or BY_NAME
        here = "here" if tag == "main" or main else top.main and "in"
        place = xxhash.xxh3_64_intdigest(f"{self._host}\0{top.place}\0{tag}\0{_classes(attributes) if attributes else ''}") >> 3 << 2
        e = _Element(tag, top, why, top.article or tag == "article", here, len(self.blocks), place)
        e.foreign = not heads.isdisjoint(FOREIGN)
        self._all.append(e)
        self._stack.append(e)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._stray.clear()

    def _pop(self) -> None:
        e = self._stack.pop()
        self._open[e.tag] -= 1
        self._stray.clear()
        up = self._stack[-1]
        if e.why in (BY_NAME, BY_COMMENT) and ("main" in e.has or e.tag == "form" and not e.has.isdisjoint(("h1", "article"))):
            e.why = STAYS
        if e.why == BY_NAME and e.prose >= RUNNING and 2 * e.links <= e.chars and e.tag == "form":
            e.why = STAYS
        if e.why == BY_NAME and (up.article or up.main) and e.tag not in SOFT:  # a box inside the text
            if e.prose >= LONG_RUNNING if e.foreign else e.prose and not e.controls and 2 * e.links <= e.chars:
                e.why = STAYS
        up.chars += e.chars
        up.said += e.said
        up.links += e.links
        up.controls = up.controls or e.controls
        if e.why == STAYS:
            up.prose += e.prose
        if e.why != BY_TAG:
            if e.main == "here" and e.why == STAYS:
                up.has.add("main")
            if e.tag in ("article", "h1", "p"):
                up.has.add(e.tag)
            up.has |= e.has
        if e.why == STAYS and e.parts:
            h = xxhash.xxh3_64_intdigest(f"{self._host}\0{e.tag}\0" + "\1".join(e.parts)) >> 3 << 2
            up.parts.append(str(h))
            if e.tag not in ("html", "body", "article", "main") and len(self.blocks) > e.first and not (e.article and e.tag in CONTENT):
                self.trees.append((h, e.first, len(self.blocks), e.article))
        e.parts = ()

    def _read(self, raw: str) -> None:
        at, n, low, quotes, endless = 0, len(raw), None, True, set()
        while at < n:
            lt = raw.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self._say(raw[at:lt])
            if lt == n:
                return
            if raw.startswith("<!--", lt):
                end = raw.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if raw.startswith(("<!", "<?"), lt):
                end = raw.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _NAME.match(raw, lt)
            if not m:
                self._say("<")
                at = lt + 1
                continue
            whole = _TAG.match(raw, lt) if quotes else None
            if whole:
                attributes, at = whole[3], whole.end()
            else:
                # Quotes that swallow the rest of the page do not count from here; a tag without an end is text.
                quotes = False
                end = raw.find(">", m.end())
                if end < 0:
                    self._say(raw[lt:])
                    return
                attributes, at = raw[m.end() : end], end + 1
            tag = m[2].lower()
            if m[1]:
                self._link = self._link and tag != "a"
                self._close(tag)
            elif tag in RAW:
                self._stack[-1].controls = self._stack[-1].controls or tag in CONTROLS
                if not attributes.endswith("/") and tag not in endless:
                    low = raw.lower() if low is None else low
                    # Lower-casing may change lengths of odd letters; then the search goes by the text itself.
                    end = low.find(f"</{tag}", at) if len(low) == n else raw.find(f"</{tag}", at)
                    if end >= 0:
                        end = raw.find(">", end)
                        at = n if end < 0 else end + 1
                    elif tag in ENDLESS:
                        at = n
                    else:  # never closed, so it hides nothing
                        endless.add(tag)
                self._text.append(" ")
            elif tag in VOID:
                self._stack[-1].controls = self._stack[-1].controls or tag in CONTROLS
                if tag not in INLINE:
                    self._break()
                elif tag == "br":
                    self._text.append(" ")
            elif tag not in INLINE:
                self._break()
                if tag in CONTENT:  # such an element ends an open one of the kind
                    self._end_open(tag)
                self._push(tag, attributes)
            else:
                self._link = self._link or tag == "a"
                if self._lists and attributes and not attributes.isspace() and not attributes.endswith("/"):
                    why, _, heads = _told(attributes)
                    if why == BY_TAG or not COMMENTS.isdisjoint(heads):
                        self._break()  # an inline element that is hidden or a comment stands as an element
                        self._push(tag, attributes)

    def _say(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self._text.append(text)
        if not text.isspace():
            words = " ".join(text.split())
            self._stack[-1].parts.append(words)
            if self._link:
                self._stack[-1].links += len(words)

    def _end_open(self, tag: str) -> None:
        kind = ("p",) if tag not in ("li", "td", "th", "dd", "dt") else (tag, "p") if tag == "li" else ("td", "th", "dd", "dt", "p")
        while self._stack[-1].tag in kind:
            self._pop()

    def _close(self, tag: str) -> None:
        if self._open.get(tag) and tag not in self._stray:
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k].tag == tag:
                    self._break()
                    while len(self._stack) > k:
                        self._pop()
                    return
                if tag in CONTENT and self._stack[k].tag not in CONTENT:
                    break  # a stray end tag does not close what holds it
            self._stray.add(tag)
        if tag not in INLINE:
            self._break()

    def main_hash(self) -> int:
        return xxhash.xxh3_64_intdigest("\n".join(b[0] for b, k in zip(self.blocks, self.kept, strict=True) if k)) >> 1

    def places(self) -> dict[int, tuple[int, int]]:
        """The structures of boxes, but for those that hold the page's heading."""
        whole, found = max(1, self._all[0].chars), {}
        for e in self._all[1:]:
            if e.chars and e.tag not in CONTENT and e.tag not in ("html", "body"):
                chars, said, h1 = found.get(e.place, (0, 0, False))
                found[e.place] = chars + e.chars, said + e.said, h1 or "h1" in e.has
        return {p: (1000 * min(c, whole) // whole, said & (1 << 62) - 1, h1) for p, (c, said, h1) in found.items()}

    def text(self, told) -> str:
        kept = list(self.kept)
        inside = {id(self._all[0]): False}
        for e in self._all[1:]:
            inside[id(e)] = inside[id(e.parent)] or e.place + 2 in told
        if any(inside.values()):
            out = {id(self._all[0]): False}
            for e in self._all[1:]:  # the counts before the lists: those hold inside the main place, and where the counts do not tell
                if inside[id(e)]:
                    out[id(e)] = inside[id(e.parent)] and (out[id(e.parent)] or e.why != STAYS)
                else:
                    out[id(e)] = out[id(e.parent)] or e.place + 1 in told
            kept = [not out[id(e)] and (k or inside[id(e)]) for (_, e), k in zip(self.blocks, kept, strict=True)]
        for h, first, end, _ in self.trees:
            if h in told:
                kept[first:end] = [False] * (end - first)
        return "\n".join(b[0] for b, k in zip(self.blocks, kept, strict=True) if k)


@lru_cache(65536)
def _classes(attributes: str) -> str:
    """The classes of an element in order, without those that hold a number."""
    found = [v for n, v in _ATTR.findall(attributes) if n.lower() == "class"]
    value = found[0].strip("\"'") if found else ""
    return " ".join(sorted({c for c in value.split() if c.isascii() and not any(x.isdigit() for x in c)}))


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


#: Share of a page's text, in thousandths, from which a structure is the main place, and up to which it may be template.
MAIN_SHARE, TEMPLATE_SHARE = 500, 250
_ROWS = "kind int, host long, tree long, main long, share long, said long"


def _counted(lists: bool):
    """Of each page a row for its host (kind 0), one for each subtree that may be template (kind 1: outside an article, 2:
    inside), and one for each structure of a box (kind 3; 4 where it holds the heading)."""

    def run(batches):
        for batch in batches:
            rows = []
            for url, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                page = Page(raw, host, lists)
                main, h = page.main_hash(), xxhash.xxh3_64_intdigest(host) >> 1
                rows.append((0, h, 0, main, 0, 0))
                rows += [(k, h, t, main, 0, 0) for k, t in {(1 + inside, t) for t, first, end, inside in page.trees if any(page.kept[first:end])}]
                rows += [(3 + h1, h, p, main, share, said) for p, (share, said, h1) in page.places().items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns)], ["kind", "host", "tree", "main", "share", "said"])

    return run


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 5, share: float = 0.1, article_share: float = 0.5, lists: bool = True) -> DataFrame:
    """What the counts tell, as numbers: hashes of subtrees that stand in at least ``min_pages`` pages of different main text of
    their host and in at least ``share`` of them (``article_share`` for subtrees inside an article), and for hosts with a
    main place, its structures (plus 2) and those of template (plus 1)."""
    rows = pages.select(F.col(f"`{url_col}`"), F.col(f"`{html_col}`")).mapInArrow(_counted(lists), _ROWS).distinct()
    # A page's boxes of one structure are one row; copies of a main text count once.
    counts = rows.groupBy("kind", "host", "tree").agg(F.count_distinct("main").alias("count"), F.avg("share").alias("share"), F.count_distinct("said").alias("texts"))
    counts = written(counts.filter(f"kind = 0 or count >= {min_pages}"), "page-subtrees")
    of_host = counts.filter("kind = 0").select("host", F.col("count").alias("pages"))
    found = counts.filter("kind > 0").join(of_host, "host")
    often = F.col("count") >= F.col("pages") * F.when(F.col("kind") == 2, article_share).otherwise(share)
    mains = found.filter((F.col("kind") > 2) & (F.col("share") >= MAIN_SHARE) & (2 * F.col("count") >= F.col("pages")) & (2 * F.col("texts") > F.col("count")))
    boxes = found.filter((F.col("kind") == 3) & often & (F.col("share") <= TEMPLATE_SHARE)).join(mains.select("host").distinct(), "host", "left_semi")
    return found.filter((F.col("kind") < 3) & often).select("tree").union(boxes.select(F.col("tree") + 1)).union(mains.select(F.col("tree") + 2)).distinct()


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", sent_hashes: int = SENT_HASHES, **limits) -> DataFrame:
    """``pages`` with text: the main text, blocks in page order joined by one newline, white space in a block one space.

    Null and empty pages have an empty text. A null or odd url is a host of its own, the empty one. Pages are judged
    one by one given their host's template, so repeated rows get the same text, and there are no ties. Unclosed and
    stray tags are borne: a tag without an end is text, quotes that swallow the rest of a page do not count. Very long
    pages are read whole, in time linear in their length. An empty table gives none; other columns stay, except one
    named text. With ``lists=False`` the counts alone decide.
    """
    found = written(templates(pages, url_col, html_col, **limits), "page-templates")
    lists = limits.get("lists", True)
    base = without(pages, "text")
    schema = T.StructType([*base.schema.fields, T.StructField("text", T.StringType())])
    columns = base.columns
    u, h = columns.index(url_col), columns.index(html_col)

    def texts(batch, template_of):
        out = [Page(raw, host_of(url), lists).text(template_of(k)) for k, (url, raw) in enumerate(zip(batch.column(u).to_pylist(), batch.column(h).to_pylist(), strict=True))]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(columns))], pa.array(out, pa.string())], names=[*columns, "text"])

    if found.count() <= sent_hashes:
        sent = pages.sparkSession.sparkContext.broadcast(np.array([r["tree"] for r in found.collect()], np.int64))

        def run(batches):
            template = set(sent.value.tolist())
            for batch in batches:
                yield texts(batch, lambda k: template)

        return base.mapInArrow(run, schema)

    key = F.xxhash64(F.col("_row")[url_col], F.col("_row")[html_col])
    boxes = boxed(base).withColumn("_key", key)

    def listed(batches):
        for batch in batches:
            keys, hashes = [], []
            for k, url, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                page = Page(raw, host_of(url), lists)
                mine = {t[0] for t in page.trees} | {p + k for p in page.places() for k in (1, 2)}
                keys += [k] * len(mine)
                hashes += mine
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["key", "tree"])

    own = boxes.select("_key", F.col("_row")[url_col].alias("u"), F.col("_row")[html_col].alias("h")).mapInArrow(listed, "key long, tree long").distinct()
    own = own.join(found, "tree").groupBy("key").agg(F.collect_list("tree").alias("_trees"))
    joined = boxes.join(own, F.col("_key") == F.col("key"), "left").select("_row.*", "_trees")

    def run_listed(batches):
        for batch in batches:
            lists = batch.column(len(columns)).to_pylist()
            yield texts(batch, lambda k: set(lists[k] or ()))  # noqa: B023

    return joined.mapInArrow(run_listed, schema)
