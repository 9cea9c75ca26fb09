"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of items, text runs and tags. A text run scores the weight of its words times their number, a
tag its own weight; words in the main part score positive, tags negative, so the contiguous region with the highest
sum is the article. One linear scan finds it. The weights are log-odds of a kind of item inside against outside of the
regions marked in labelled pages. Words are told apart by where they stand: inside an article element, outside
one although the page has one, in a link; on pages without an article element by their block too: one that is half links
or more, one of fewer than ``FEW`` words in no paragraph, heading or the like, or running text. So neither article elements
nor known names are needed. As sums stop short of an article's last list or first headline,
the region then grows to the article element it lies in, or else to the blocks it begins and ends in.

Menus, page footers, asides and scripts are no article text by their nature. Page headers, forms, and elements whose
class, id or role is the name of an advert, sidebar, notice, comment or the like are none either, unless they hold the
largest article element of the page or, without any, three quarters of its words. A name counts as a whole:
"ad-banner" is one, "share-price" or "has-sidebar" is not. Of an article's own header, headings are text.

Blocks: text between block tags; white space, and a line break tag, becomes one space; blocks are joined by one
newline. Character references are decoded.

Edge cases. Null or empty page, or one without words: empty text. Unclosed or stray tags: closed as the next
block demands, or ignored. Unclosed comment or script: runs to the end. A tag that never ends: text. Runs of equal
sum: the first. Repeated rows: each is extracted. Other columns, whatever their names, are not read. Very long pages:
parsing, scan and growth are linear. Empty table: empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .markup import scan

_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|data-role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text, and those that are none unless they hold the page's article.
_NEVER = frozenset("nav footer aside noscript template svg math canvas object button select option label legend dialog menu audio video map head input datalist output progress meter script style title textarea xmp iframe noembed noframes".split())
_UNLESS_MAIN = frozenset("form fieldset header".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that a region grows to, and open blocks that the start of another one ends (a paragraph ends at any block).
_CONTAINERS = frozenset("html body div section td th center form fieldset article main".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
# Words of a class, id or role that name what is no article text, and words that may stand beside them.
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsors sponsored promo promos promotion promotions banner banners nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs pagination pager sidebar sidebars aside rail widget widgets header masthead topbar toolbar footer foot footnav colophon cookie cookies consent gdpr notice notices alert alerts popup modal overlay toast subscribe subscription newsletter signup login signin paywall comment comments commentlist disqus respond related recommended recommendations suggestions trending share sharing social follow searchbox searchform complementary contentinfo skip tracking".split()
)
_BESIDE = frozenset("box wrap wrapper container block section area list item items bar top bottom left right inner outer site page global primary secondary main post posts entry article articles story stories link links button buttons icons panel content body text unit slot zone row col column group media module region form media message policy law".split())
_MAIN_NAMES = frozenset("main articlebody article-body".split())


#: A block of fewer words that stands in a division, cell or other container directly is no running text.
FEW = 16
_TEXT_BLOCKS = _HEADINGS | frozenset("p li dt dd blockquote pre figcaption caption address".split())


class Item:
    """A text run or a tag: kind (what its weight goes by), words, text, whether it is left out, and its element."""

    __slots__ = ("kind", "noise", "owner", "text", "words")

    def __init__(self, kind: str, owner: int, text: str = "", words: int = 0):
        self.kind, self.owner, self.text, self.words, self.noise = kind, owner, text, words, False


class Element:
    """Name, enclosing element, and its items from first to last; what its tag and its names say of it."""

    __slots__ = ("first", "last", "main", "name", "named", "never", "parent", "state")

    def __init__(self, name: str, parent: int, first: int):
        self.name, self.parent, self.first, self.last = name, parent, first, -1
        self.main = self.never = False
        self.named, self.state = "", 0


def _noise_name(names: list[str]) -> str:
    """What noise the names tell of: "header", "noise" or nothing. Only a name whose every word fits tells."""
    for name in names:
        words = [w for w in map(str.lower, _PART.findall(name)) if len(w) > 1]
        noise = [w for w in words if w in _NOISE_WORDS]
        if noise and all(w in _NOISE_WORDS or w in _BESIDE for w in words):
            return "header" if set(noise) <= {"header", "masthead"} else "noise"
    return ""


def parsed(page: str) -> tuple[list[Item], list[Element]]:
    """The page in order, and its elements, each after the one it lies in. Item kinds: word:…, a tag's name, space,
    and [ or ] for a comment that marks the region of a labelled page."""
    out: list[Item] = []
    elements = [Element("", -1, 0)]
    stack, blocks, scopes, opened = [0], [0], [Counter()], Counter()  # scopes: inline names open in each block
    at = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            e = elements[stack.pop()]
            e.last = len(out)
            opened[e.name] -= 1
            if blocks[-1] == len(stack):
                blocks.pop()
                scopes.pop()
            else:
                scopes[-1][e.name] -= 1

    def text(to: int) -> None:
        if to > at:
            run = page[at:to]
            if run.isspace():
                out.append(Item("space", stack[-1], " "))
            else:
                run = entities.unescape(run) if "&" in run else run
                out.append(Item("word:link" if opened["a"] else "word:other", stack[-1], run, len(run.split())))

    for what, name, inner, start, end in scan(page):
        if what != "raw":
            text(start)
        at = end
        if what == "comment" and inner in ("[", "]"):
            out.append(Item(inner, stack[-1]))
        elif what == "open":
            block = name in _BLOCKS
            if block:
                ends = _ENDS.get(name, ())
                while elements[stack[blocks[-1]]].name == "p" or elements[stack[blocks[-1]]].name in ends:
                    pop(blocks[-1])
            e = Element(name, stack[-1], len(out))
            elements.append(e)
            names = [w for m in _NAMES.finditer(inner) for w in m[1].strip("\"'").split()] if inner else []
            e.main = name in ("article", "main") and "comment" not in names or any(w.lower() in _MAIN_NAMES for w in names)
            e.never = name in _NEVER or name == "article" and not e.main or bool(inner and _HIDDEN.search(inner))
            e.named = "" if e.main or name in _HEADINGS or name in ("html", "body", "") else _noise_name(names) or ("header" if name == "header" else "noise" if name in _UNLESS_MAIN else "")
            out.append(Item(name, len(elements) - 1))
            if name in _VOID or what == "raw" or inner.endswith("/"):
                e.last = len(out)
            else:
                stack.append(len(elements) - 1)
                opened[name] += 1
                if block:
                    blocks.append(len(stack) - 1)
                    scopes.append(Counter())
                else:
                    scopes[-1][name] += 1
        elif what == "raw":
            pop(len(stack) - 1)
        elif what == "close":
            if name in _BLOCKS and opened[name]:
                i = len(blocks) - 1
                while elements[stack[blocks[i]]].name != name:
                    i -= 1
                to = blocks[i]
            elif name not in _BLOCKS and scopes[-1][name]:
                to = len(stack) - 1
                while elements[stack[to]].name != name:
                    to -= 1
            else:
                to = len(stack)
            out.append(Item("/" + name, stack[to] if to < len(stack) else stack[-1]))
            pop(to)
    text(len(page)) if at < len(page) else None
    at = len(page)
    pop(1)
    elements[0].last = len(out)
    _settle(out, elements)
    return out, elements


def _settle(out: list[Item], elements: list[Element]) -> None:
    """What is left out, and which words stand in the main part."""
    never, inside = [False] * len(elements), [False] * len(elements)
    for i, e in enumerate(elements):
        if i:
            never[i], inside[i] = e.never or never[e.parent], e.main or inside[e.parent]
    upto = [0, *accumulate(0 if never[x.owner] else x.words for x in out)]
    words = lambda e: upto[e.last] - upto[e.first]
    mains = [e for i, e in enumerate(elements) if e.main and not never[i]]
    main = max(mains, key=words, default=None)
    for i, e in enumerate(elements):
        if not i:
            continue
        around = elements[e.parent].state  # 0: text, 1: an article's own header, 2: left out
        holds = e.first <= main.first and main.last <= e.last if main else 4 * words(e) >= 3 * upto[-1]
        if around == 2 or e.never:
            e.state = 2
        elif e.named == "header" and inside[i]:
            e.state = 1
        elif e.named and not holds:
            e.state = 2
        else:
            e.state = 0 if around == 1 and e.name in _HEADINGS else around
    for x in out:
        x.noise = elements[x.owner].state != 0
        if x.words and inside[x.owner]:
            x.kind = "word:main"
    if any(x.kind == "word:main" and not x.noise for x in out):
        for x in out:
            if x.kind == "word:other":
                x.kind = "word:outside"
    else:
        _by_blocks(out, elements)


def _by_blocks(out: list[Item], elements: list[Element]) -> None:
    """Of words in no link, which stand in blocks that are half links, and which in loose blocks of few words."""
    block: list[Item] = []
    loose = [True] * len(elements)
    for i, e in enumerate(elements):
        loose[i] = e.name not in _TEXT_BLOCKS if e.name in _BLOCKS else loose[e.parent] if i else True
    for x in [*out, Item("/html", 0)]:
        if x.words and not x.noise:
            block.append(x)
        elif block and x.kind.lstrip("/") in _BLOCKS:
            words, links = sum(y.words for y in block), sum(y.words for y in block if y.kind == "word:link")
            kind = "word:beside" if 2 * links >= words else "word:few" if words < FEW and loose[block[0].owner] else ""
            for y in block:
                if kind and y.kind == "word:other":
                    y.kind = kind
            block = []


def items(page: str) -> list[Item]:
    return parsed(page)[0]


def fitted(pages: list[str]) -> dict[str, float]:
    """Weights from pages whose main region stands between the comments ``<!--[-->`` and ``<!--]-->``.

    A kind's weight is the log-odds of its being inside. Words are held to at least 0.05 in an article, tags to at most -0.05.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        counts = outside
        for x in items(page):
            if x.kind in "[]":
                counts = inside if x.kind == "[" else outside
            elif not x.noise:
                counts[x.kind] += x.words or 1
    n, m = sum(inside.values()) + 1, sum(outside.values()) + 1
    weights = {k: math.log((inside[k] + 0.5) / n) - math.log((outside[k] + 0.5) / m) for k in {*inside, *outside}}
    return {k: max(0.05, w) if k in ("word:main", "word:other") else w if k.startswith("word:") else min(-0.05, w) for k, w in weights.items()}


#: What a tag scores that no labelled page has.
UNSEEN_TAG = -0.5


@lru_cache(maxsize=1)
def default_weights() -> dict[str, float]:
    from .labelled import PAGES

    return fitted(PAGES)


def region(page_items: list[Item], weights: dict[str, float]) -> tuple[int, int]:
    """First and last item + 1 of the contiguous run with the highest sum; (0, 0) if none is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(page_items):
        if x.noise or x.kind == "space":
            continue
        run += weights.get(x.kind, UNSEEN_TAG) * x.words if x.words else weights.get(x.kind, UNSEEN_TAG)
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, found = run, (start, i + 1)
    return found


def grown(found: list[Item], elements: list[Element], first: int, last: int) -> tuple[int, int]:
    """The region, grown to the article element that holds it, or to whole blocks: the one block that holds it if
    that has little else, or those of its children where the region begins and ends, with headings right before."""
    if first >= last:
        return first, last

    def upward(i: int):
        while i > 0:
            yield elements[i]
            i = elements[i].parent

    def words(a: int, b: int) -> int:
        return sum(x.words for x in found[a:b] if not x.noise)

    around = next((e for e in upward(found[first].owner) if e.first <= first and e.last >= last), elements[0])
    own = lambda i: next((e for e in upward(found[i].owner) if e.main), None)
    left, right = own(first), own(last - 1)
    if left or right:
        if left and left is not right and around.first <= left.first:
            whole = next((e for e in [around, *upward(max(around.parent, 0))] if e.main), None)
            if whole:
                return whole.first, whole.last
        return min(first, left.first if left else first), max(last, right.last if right else last)
    while around.name not in _CONTAINERS and around.parent >= 0:
        around = elements[around.parent]
    if around.name not in ("", "html", "body") and 5 * words(first, last) >= 4 * words(around.first, around.last):
        first, last = around.first, around.last
    else:
        child = lambda i: next((e for e in upward(found[i].owner) if e is not around and elements[e.parent] is around), None)
        left, right = child(first), child(last - 1)
        first, last = min(first, left.first if left else first), max(last, right.last if right else last)
    i = first - 1
    while i >= 0 and (not found[i].words or found[i].noise):
        i -= 1
        if i >= 0 and found[i].words and not found[i].noise and (heading := next((e for e in upward(found[i].owner) if e.name in _HEADINGS), None)) and found[i].kind != "word:link":
            first, i = heading.first, heading.first - 1
    return first, last


def main_text(page: str | None, weights: dict[str, float] | None = None) -> str:
    if not page:
        return ""
    found, elements = parsed(page)
    first, last = grown(found, elements, *region(found, weights or default_weights()))
    blocks, now = [], []
    for x in found[first:last]:
        name = x.kind.lstrip("/")
        if name in _BLOCKS:
            blocks.append(now)
            now = []
        elif x.noise:
            continue
        elif x.text:
            now.append(x.text)
        elif name == "br":
            now.append(" ")
    blocks.append(now)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def extracted(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    weights = weights or default_weights()
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
