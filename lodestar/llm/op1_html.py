"""HTML extraction by the maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import table

#: Elements whose text is never shown, void elements, and elements that don't break a line of text.
HIDDEN = frozenset("script style template noscript svg math iframe object head title select textarea button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that end an open paragraph, as the HTML standard has it.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Words in class, id and role that name what stands beside an article.
ASIDES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header "
    "masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond search share sharing "
    "shared sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets complementary contentinfo modal overlay".split()
)
#: Elements that may hold an article, elements of text, those that are paragraphs, and boxes that frame a page rather than an article.
HOLDERS = frozenset(["", *"html body div section td center".split()])
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table figure figcaption hr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
FRAME = frozenset("nav header footer menu".split())
#: Share of a page's text that the element around its article holds.
MOST = 0.6
BESIDE = frozenset("nav header footer aside form menu dialog fieldset search".split())
#: Parts of a name that make a heading of it an article's own, and what names an article that is a reader's or another one.
OWN_HEADING = frozenset("article post entry story content title main".split())
OTHER_ARTICLE = frozenset("ad ads advert comment comments disqus promo promoted promotion related replies reply respond sponsored teaser".split())
#: A tag: its name and its attributes. Quoted values hold anything, a quote that is never closed is part of an unquoted value; nothing is tried twice.
_TAG = re.compile(r"""</?+([a-zA-Z][^\s/>]*+)((?:[\s/]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|[^\s/>=][^\s/>=]*+)*+)>""")
_LETTER = re.compile(r"</?[a-zA-Z]")
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Labelled pages: (1 if the piece belongs to the article, piece). They are templates, with _ for a word.
LABELLED = (
    ((0, "<header><h1>_ _</h1><nav><ul><li><a>_</a></li><li><a>_</a></li></ul></nav></header>"), (1, "<article><h1>_ _ _</h1><p>_ _ _ _ _ _ _ _ _ _ _ _</p><p>_ _ _ _ _ _ _ _</p></article>"), (0, "<footer><p>_ _ _ _</p></footer>")),
    ((0, "<nav><a>_</a><a>_</a><a>_</a></nav><div class='ad'>_ _ _ _ _</div>"), (1, "<main><h2>_ _</h2><p>_ _ _ <b>_</b> _ _ _ _</p><ul><li>_ _ _</li><li>_ _</li></ul><p>_ _ _ _ _ _</p></main>"), (0, "<aside><h3>_ _</h3><ul><li><a>_ _</a></li></ul></aside><footer>_ _ _</footer>")),
    ((0, "<div id='menu'><ul><li><a>_</a></li><li><a>_</a></li></ul></div>"), (1, "<div class='content'><h1>_ _ _</h1><p>_ _ _ _ _ _ _ _ _</p><blockquote>_ _ _ _</blockquote><p>_ _ _ _ _ _ _</p><pre>_ _</pre></div>"), (0, "<div class='comments'><p>_ _ _ _ _</p><form><input>_ _</form></div><div class='sidebar'><p>_ _ _</p></div>")),
    ((0, "<p>_ _ _</p>"), (1, "<article><h1>_ _</h1><p>_ _ _ _ _ _ _ _ _</p></article>"), (0, "<div>_ _ _ _</div>")),
    ((0, "<div class='cookie notice'><p>_ _ _ _ _ _</p></div><form><label>_</label></form>"), (1, "<section><h1>_ _ _</h1><p>_ _ _ _ _ _ _ _<br>_ _ _ _</p><table><tr><td>_ _</td><td>_</td></tr></table></section>"), (0, "<section class='related'><a>_ _ _</a><a>_ _</a></section><footer><a>_</a> _ _</footer>")),
    ((0, "<nav><a>_</a><a>_</a></nav>"), (1, "<article><h1><a>_ _ _</a></h1><p>_ _ _ _ _ _ <a>_</a> _ _</p><aside><p>_ _ _</p></aside><p>_ _ _ _ _ _ _</p><p><a>_ _</a></p></article>"), (0, "<footer><a>_</a> _ _</footer>")),
    ((0, "<div id='menu'><ul><li><a>_</a></li></ul></div>"), (1, "<div class='content'><h1><a>_ _</a></h1><p>_ _ _ _ _ _ _ _ _</p><div class='ad'>_ _ _ _</div><p>_ _ _ _ _ _ _</p><form><label>_</label></form><p>_ _ _ _ _</p><p><a>_ _</a></p></div>"), (0, "<div class='sidebar'><p>_ _ _</p></div>")),
)


class _Open:
    """An element that is open while a page is read. box is the outermost element around it that stands beside an article."""

    __slots__ = ("name", "parent", "depth", "named", "box", "hidden", "link", "main")

    def __init__(self, name: str, attributes: str, parent: _Open | None):
        given = ["".join(m).lower() for m in _NAMES.findall(attributes)] if attributes else []
        within = parent is not None and parent.main
        words: set[str] = set()
        for parts in (set(_WORD.findall(token)) for g in given for token in g.split()):
            if "header" in parts and (within or not OWN_HEADING.isdisjoint(parts)):  # an article's own heading
                parts.discard("header")
            if not parts.isdisjoint(("free", "less")):  # `ad-free` is no advert
                parts.clear()
            words |= parts
        if name in ("body", "html", "main"):  # a page-wide class says nothing about its text
            own = False
        elif name == "article":
            own = not OTHER_ARTICLE.isdisjoint(words)
        else:
            own = (name in BESIDE and not (name == "header" and within)) or not ASIDES.isdisjoint(words)
        self.main = (name in ("article", "main") and not own) or within
        self.name, self.parent, self.named = name, parent, tuple(given)
        self.depth = 0 if parent is None else parent.depth + 1
        self.box = parent.box if parent is not None and parent.box is not None else self if own else None
        self.hidden = name in HIDDEN or (parent is not None and parent.hidden) or bool(attributes and _UNSEEN.search(attributes))
        self.link = name == "a" or (parent is not None and parent.link)

    def kind(self) -> str:
        if self.box is not None:
            return "inset" if self.main else "beside"
        if self.link:
            return "cited" if self.main else "link"
        return "body" if self.main else "loose"

    def above(self, depth: int) -> _Open:
        """This element or the one around it at the depth."""
        at = self
        while at.depth > depth:
            at = at.parent
        return at

    def within(self, other: _Open) -> bool:
        return self.depth >= other.depth and self.above(other.depth) is other

    def wide(self) -> bool:
        """Whether it is the page rather than a part of it."""
        return self.name in ("", "html", "body")


def _container(found: list[tuple]) -> _Open | None:
    """The innermost element that may hold an article and holds most of the words that are neither links nor beside it."""
    inside: Counter = Counter()
    total = 0
    for text, kind, _, at in found:
        if kind in ("loose", "body"):
            inside[at] += text.count(" ") + 1
            total += text.count(" ") + 1
    for at in list(inside):
        while at.parent is not None and at.parent not in inside:
            at = at.parent
            inside[at] = 0
    for at in sorted(inside, key=lambda at: -at.depth):
        if at.parent is not None:
            inside[at.parent] += inside[at]
    held = [at for at, n in inside.items() if at.name in HOLDERS and total and n >= MOST * total]
    return max(held, key=lambda at: at.depth) if held else None


def _unmarked(found: list[tuple]) -> list[tuple]:
    """The blocks of a page that marks no article: text is body, and so are links of the element that holds most of the text.

    A box is an inset if its parent's text goes on after it: within that element, or between siblings that are alike.
    Where the page itself is that element, its links count if they stand in paragraphs or headings.
    """
    holder = _container(found)
    plain = [i for i, (_, kind, _, _) in enumerate(found) if kind not in ("beside", "inset")]
    known: dict[_Open, bool] = {}

    def inset(box: _Open, i: int) -> bool:
        if box not in known:
            k, parent = bisect_left(plain, i), box.parent
            near = [found[plain[j]][3] for j in (k - 1, k) if 0 <= j < len(plain)]
            goes_on = len(near) == 2 and all(x.within(parent) for x in near)
            if goes_on:
                held = holder is not None and parent.within(holder)
                a, b = (x.above(parent.depth + 1) for x in near)
                level = [x is parent or x.name in TEXTUAL or x.name in INLINE for x in (a, b)]
                alike = all(level) or (not any(level) and (a.name, a.named) == (b.name, b.named))
                goes_on = (held and not parent.wide()) or (alike and (held or box.name not in FRAME))
            known[box] = goes_on
        return known[box]

    def cited(at: _Open) -> bool:
        if holder is None or not at.within(holder):
            return False
        if not holder.wide():
            return True
        names = []
        while at is not holder:
            if at.name not in INLINE:
                names.append(at.name)
            at = at.parent
        return bool(names) and all(n in PARAGRAPHS for n in names)

    out = []
    for i, (text, kind, tags, at) in enumerate(found):
        if kind == "loose":
            kind = "body"
        elif kind == "beside" and inset(at.box, i):
            kind = "inset"
        elif kind == "link" and cited(at):
            kind = "cited"
        out.append((text, kind, [(t, x) for t, x in tags if x.box is None or not inset(x.box, i)], at))
    return out


def blocks(page: str) -> list[tuple[str, str, list[str]]]:
    """(text, kind of the words, tags before them, with a < before their names) of the page's blocks, in order. A block is the text between two tags that break lines.

    Kind is by the open elements: beside the article, an inset within it, cited for links within it, link for others, body, or loose for text outside the article of a page that marks one. Tags of insets and of elements that are never
    shown are left out. Unclosed and stray tags are taken as browsers do, roughly: a new
    paragraph ends an open one, an end tag closes up to its element, and one without an open element is passed over.
    """
    found: list[tuple] = []
    root = _Open("", "", None)
    stack: list[_Open] = []
    opened: Counter = Counter()
    text: list[str] = []
    kinds: Counter = Counter()
    places: dict[str, _Open] = {}
    tags: list[tuple[str, _Open]] = []
    pos, n = 0, len(page)

    def flush() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                kind = kinds.most_common(1)[0][0]
                found.append((" ".join(words), kind, tags.copy(), places[kind]))
                tags.clear()
            text.clear()
            kinds.clear()
            places.clear()

    def add(part: str) -> None:
        at = stack[-1] if stack else root
        if part and not at.hidden:
            text.append(part)
            if not part.isspace():
                kind = at.kind()
                kinds[kind] += len(part)
                places.setdefault(kind, at)

    def mark(tag: str, at: _Open) -> None:
        if not at.hidden and not (at.main and at.box is not None):
            tags.append((tag, at))

    def close(name: str) -> _Open:
        """Take elements off the stack up to the last one of the name."""
        while True:
            at = stack.pop()
            opened[at.name] -= 1
            if at.name == name:
                return at

    while pos < n:
        start = page.find("<", pos)
        if start < 0:
            add(page[pos:])
            break
        add(page[pos:start])
        m = _TAG.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                pos = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                pos = end + 1 if end >= 0 else n
            elif _LETTER.match(page, start):  # a tag that never ends, as the HTML standard has it
                break
            else:
                add("<")
                pos = start + 1
            continue
        pos = m.end()
        name, ending = m[1].lower(), page[start + 1] == "/"
        if name == "br":
            text.append(" ")
            continue
        if name not in INLINE:
            flush()
        if ending:
            at = close(name) if opened[name] else stack[-1] if stack else root
            if name not in INLINE:
                mark("/" + name, at)
            continue
        if name in CLOSES_P and opened["p"]:
            close("p")
        if name == "li" and stack and stack[-1].name == "li":
            close("li")
        at = _Open(name, m[2], stack[-1] if stack else root)
        if name not in INLINE:
            mark(name, at)
        if name not in VOID and not m[2].endswith("/"):
            stack.append(at)
            opened[name] += 1
            if name in ("script", "style", "textarea", "title", "noscript"):  # their content is not markup
                end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
                pos = end.start() if end else n
    flush()
    if not any(kind == "body" for _, kind, _, _ in found):  # no element says where the article is
        found = _unmarked(found)
    return [(text, kind, ["<" + t for t, _ in tags]) for text, kind, tags, _ in found]


def learn(pages: tuple = LABELLED) -> dict[str, float]:
    """Weights from labelled pages: a word's by its kind, the log-odds of lying in the article; a tag's its cost, larger the less it is one of articles."""
    inside, outside = Counter(), Counter()
    for page in pages:
        for good, piece in page:
            for text, kind, tags in blocks(piece):
                kind = {"body": "loose", "cited": "link"}.get(kind, kind) if not good else kind
                (inside if good else outside)[kind] += len(text.split())
                (inside if good else outside).update(tags)
    odds = lambda k: math.log((inside[k] + 0.5) / (outside[k] + 0.5))
    weights = {k: odds(k) for k in ("body", "cited", "link", "beside", "loose")} | {"inset": 0.0}
    share = lambda k: (outside[k] + 0.5) / (inside[k] + outside[k] + 1)
    return weights | {k: -0.2 * share(k) for k in inside | outside if k not in weights} | {"": -0.1}


WEIGHTS = learn()


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The page's main text: the contiguous run of blocks of the largest score, by one linear scan, without blocks that stand beside the article."""
    found = blocks(page or "")
    best, at, score, start = 0.0, (0, 0), 0.0, 0
    for i, (text, kind, tags) in enumerate(found):
        if kind == "inset":  # left out of the text, hence no reason to end the run
            continue
        cost = sum(weights.get(t, weights[""]) for t in tags)
        if score + cost <= 0:
            score, start, cost = 0.0, i, 0.0
        score += cost + weights[kind] * (text.count(" ") + 1)
        if score > best:
            best, at = score, (start, i + 1)
    return " ".join(text for text, kind, _ in found[slice(*at)] if kind not in ("beside", "inset"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty html has an empty text. Repeated rows stay, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, kinds)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null or empty html has an empty text; repeated rows and null ids stay; a page of any length is read in one pass that is
    linear in it; an empty table gives no rows; other columns are ignored.
    """
    return extract(table(spark, sf_dir, "pages"))
