"""Main text of web pages by the maximum-scoring subsequence.

A page is cut into tags and words by one pattern. Each token has a weight: words score by where they stand (the nearest enclosing
kind of container, inside a link or not), tags have zero or a negative score. The weights are log odds counted on labelled pages,
whose content is marked. A linear scan finds the contiguous run of tokens with the largest sum; inside it, words of containers
with negative weight (notices, forms, sidebars, reader comments) and of scripts and styles are left out, and block tags end blocks.
What stands between two pieces of marked content costs nothing, so a menu or an advert in an article's midst doesn't split it.

Container kinds come from tag names and from words in ``class``, ``id`` and ``role``. Words in no such container weigh above zero,
so an article in plain body, paragraphs, cells or other classes is found. ``main`` outranks every kind it opens in; ``article`` those
whose end tag is missing, and, if it holds more than the rest of the page, closed ones too (comments only if they open before any
content). A form around more words than stand outside of forms, and ten or more for each of its fields, wraps the page and is no container.
A heading below the first level that says "Comments" or the like, after content, opens reader comments up to the end of its container or
a heading as high; a last block that states copyright is a footer. A page that has no text so far is read again with whole words of ``class``, ``id`` and ``role`` only. Every page is handled on
its own, in one narrow pass; it is read up to eight times, each time linear in its length.

Edge cases: null and empty pages, and pages without words, give an empty text; broken, unclosed or cut-off markup is read as far
as it goes; a quote that is never closed ends with its tag, and "<" before what can't be a tag is text; ``head`` ends where a tag opens
that can't stand in it. Of two regions with equal sums the first is taken. Very long pages are read whole; extra columns are ignored;
repeated rows are returned as often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, slices, text_batches

# fixed values: names of the HTML standard, and customary words of class names
SKIPPED = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAG_KIND = {"nav": "nav", "menu": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice", "article": "content", "main": "content"}
HINTS = (
    ("ad", r"ads?|advert\w*|sponsor\w*|promo\w*|banner"),
    ("comment", r"comments?|commentlist|replies|disqus|respond|discussion"),
    ("nav", r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc"),
    ("footer", r"footer|copyright|colophon"),
    ("aside", r"side\w*|widgets?|related|recommend\w*|share|sharing|social"),
    ("notice", r"notices?|cookies?|consent|gdpr|popup|modal|alert|subscribe|newsletter|paywall|overlay"),
    ("header", r"header|masthead|topbar|skip\w*"),
    ("form", r"login|signup|search\w*|form"),
    ("content", r"articles?|content|entry|post|story|main"),
)
_HINT = [(kind, re.compile(rf"(?:^|[\s_-])(?:{p})(?:$|[\s_-])", re.I)) for kind, p in HINTS]
_WHOLE = [(kind, re.compile(rf"(?:^|\s)(?:{p})(?:$|\s)", re.I)) for kind, p in HINTS]
_TOKEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*)((?:\"(?:[^\"<]|<(?![a-z/!]))*\"|'(?:[^'<]|<(?![a-z/!]))*'|[^'\"<>])*+|[^<>]*+)(?:>|\Z)|([^<]+|<)")
_ATTR = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
#: Parts of a compound that make it a phrase ("menu-of-the-day"), which names what a block holds and not its kind.
_PHRASE = re.compile(r"[^\s_-]+(?:[_-][^\s_-]+)*[_-](?:of|the|and|in|for|to|a)[_-][^\s]+", re.I)
#: Text blocks: only whole words of their attributes are hints ("ad", but not "share-price").
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption td th dd dt span b i em strong".split())
#: A heading that opens reader comments; they go on to the end of its container or to a heading as high.
_REPLIES = re.compile(r"(?i)\s*(?:\d+\s+)?(?:(?:reader|user|visitor)s?['’]?s?\s+)?(?:comments?|replies|responses|leave a (?:reply|comment)|join the discussion)\s*(?:\(\d+\)|:|\d+)?\s*")
#: A last block that is a footer without a container.
_RIGHTS = re.compile(r"(?i)(?:©|\(c\)|copyright\b).{0,160}\ball rights reserved\b.{0,40}|(?:©|copyright ©|copyright \(c\))\s*(?:19|20)\d\d\b.{0,80}")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none")
#: Tags before which ``head`` stays open.
IN_HEAD = frozenset("html head title meta link base style script noscript template".split())
#: A tag's score is never above this.
TAG_CAP = -0.01


def kind_of(tag: str, attrs: str, strict: bool = False) -> str | None:
    """The container kind that a tag opens, if any; ``strict``: only whole words of an attribute count, not parts of compounds."""
    if attrs:
        if _HIDDEN.search(attrs):
            return "notice"
        if tag not in ("body", "html"):
            said = " ".join(a or b or c for a, b, c in _ATTR.findall(attrs))
            if said:
                said = _PHRASE.sub(" ", said)
                for kind, pattern in _WHOLE if strict or tag in TEXT_BLOCKS else _HINT:
                    if pattern.search(said):
                        return kind
    return TAG_KIND.get(tag)


class Reading:
    """The tokens of a page: (key of the weight, text): ``w:container`` or ``l:container`` (in a link) with the text of a run,
    ``t:name`` with the tag.

    A run between two tags is one token of as many words. A header inside an article is part of it. ``missing`` has the places of
    containers that may have been left open, as an earlier reading found them; with ``loose``, closed containers are outranked too.
    ``wraps`` has the places of forms around a page's text, which are no containers of their own kind.
    """

    def __init__(self, page: str, missing: frozenset[int] = frozenset(), loose: bool = False, strict: bool = False, wraps: frozenset[int] = frozenset()):
        self.found: list[tuple[str, str]] = []
        self.open: set[int] = set()  # places of containers without an end tag of their own
        self.nested = False  # an article opens in a container of another kind, which it doesn't outrank
        stack: list[tuple[str, str, int, frozenset[int]]] = []  # open containers and links: tag, kind, place, places that it outranks
        late: set[int] = set()  # places of comments after content
        prose: Counter = Counter()  # words of each open form but those of labels and other containers; None: words outside forms
        fields: Counter = Counter()
        label = ""
        heading: tuple[str, int, bool] | None = None  # an open heading, the number of tokens before it, and whether there was text
        forms: list[int] = []
        plain = True  # no container but forms stands around
        where, link, content, over = "page", False, False, frozenset()
        for m in _TOKEN.finditer(page):
            text = m.group(5)
            if text is None and m.group(3) and m.end() == len(page) and page[-1] != ">" and " " in m.group(4) and "=" not in m.group(4):
                text = m.group(0)  # "a <b holds" at the end of a page is no tag
            if text is not None:
                self.found.append((("l:" if link else "w:") + where, text))
                content = content or where == "content"
                if plain and not link and not label:
                    n = len(text.split())
                    for at in forms or (None,):
                        prose[at] += n
                continue
            name = m.group(3)
            if name is None:
                continue
            name = name.lower()
            if name in ("label", "legend", "button", "option"):
                label = "" if m.group(2) else name
            elif name in ("input", "select") and not m.group(2) and "hidden" not in m.group(4):
                for at in forms:
                    fields[at] += 1
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                if not m.group(2):
                    heading = name, len(self.found), content or any(prose.values())
                    stack = [s for s in stack if s[0] != "#replies" or s[1] < name[1]] if any(s[0] == "#replies" for s in stack) else stack
                elif heading and heading[0] == name:
                    if name != "h1" and heading[2] and _REPLIES.fullmatch("".join(t for k, t in self.found[heading[1] :] if k[0] != "t")):
                        stack.append(("#replies", name[1], m.start(), frozenset()))
                        self.found[heading[1] :] = [(k if k[0] == "t" else k[:2] + "comment", t) for k, t in self.found[heading[1] :]]
                    heading = None
            if m.group(2):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        self.open.update(s[2] for s in stack[k + 1 :])
                        del stack[k:]
                        break
            else:
                if stack and name not in IN_HEAD and any(s[0] == "head" for s in stack):
                    stack = [s for s in stack if s[0] != "head"]
                if name not in VOID:
                    kind = kind_of(name, m.group(4), strict)
                    at = m.start()
                    if at in wraps and kind == "form":
                        kind = ""
                    if name == "a":
                        stack = [s for s in stack if s[0] != "a"]
                        stack.append((name, kind or "", at, frozenset()))
                    elif kind or name in TAG_KIND or name == "div" or name == "section" or name in SKIPPED:
                        if kind == "comment" and content:
                            late.add(at)
                        beaten = self._outranked(name, stack, missing, loose, late) if kind == "content" and name in ("article", "main") else frozenset()
                        stack.append((name, "skip" if name in SKIPPED and name not in ("head",) else "header" if name == "head" else kind or "", at, beaten))
            over = frozenset().union(*(s[3] for s in stack)) if any(s[3] for s in stack) else frozenset()
            link = any(s[0] == "a" for s in stack)
            kinds = ["comment" if s[0] == "#replies" else s[1] for s in stack if s[1] and s[2] not in over]
            bad = [k for k in kinds if k != "content"]
            inside = "content" in kinds
            if bad and bad[-1] == "header" and inside and kinds.index("content") < len(kinds) - 1 - kinds[::-1].index("header") and name != "head":
                bad = [k for k in bad if k != "header"]  # an article's own header
            where = bad[-1] if bad else "content" if inside else "page"
            forms = [s[2] for s in stack if s[0] == "form" and s[1] == "form"]
            plain = not bad or all(k == "form" for k in bad)
            self.found.append(("t:" + name, m.group(2)))
        self.open.update(s[2] for s in stack)
        # a form around more words than stand outside of forms, and many for each of its fields, wraps the page
        self.wraps = frozenset(at for at, n in prose.items() if at is not None and n > prose[None] and n >= 10 * fields[at])

    def _outranked(self, name: str, stack: list, missing: frozenset[int], loose: bool, late: set[int]) -> frozenset[int]:
        """Places of the open containers of other kinds that an opening article or main outranks.

        A missing end tag may be that of any container of the same name inside the one that is left without.
        """
        out: set[int] = set()
        lacking: set[str] = set()
        for tag, kind, at, _ in stack:
            if at in missing:
                lacking.add(tag)
            if not kind or kind == "content":
                continue
            if name == "main" or (at not in late and (tag in lacking or (loose and kind != "comment"))):
                out.add(at)
            else:
                self.nested = True
        return frozenset(out)


def tokens(page: str) -> list[tuple[str, str]]:
    """(key of the weight, text) of every token, as an article reads that outranks what was left open before it."""
    got = Reading(page)
    wraps = got.wraps
    if wraps:
        got = Reading(page, wraps=wraps)
    return Reading(page, frozenset(got.open), wraps=wraps).found if got.nested and got.open else got.found


# labelled pages: what stands between [[ and ]] is content
LABELLED = (
    '<html><head><title>River news</title></head><body><header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav></header>[[<article><h1>The river rose at night</h1><p>Water came over the lower fields and the old road was closed.</p><p>By morning <b>all houses</b> had <a href="/w">light</a> again.<br>No one was hurt.</p></article>]]<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten best lakes</a></li></ul></aside><footer>&copy; 2020 River news. All rights reserved.</footer></body></html>',
    '<html><body><div class="cookie-notice">We use cookies to serve you. <button>Accept</button></div><nav><a href="/">Start</a> <a href="/b">Blog</a></nav>[[<main><h2>How to bake bread</h2><p>Mix flour, water and salt and let it rest for an hour.</p><ul><li>Flour</li><li>Water</li></ul><p>Bake it until the crust is dark.</p></main>]]<section id="comments"><h3>Comments</h3><p>Great recipe, thank you so much!</p><p>Mine burned.</p></section><form><label>Name</label><input><label>Message</label></form><footer>Imprint and contact</footer></body></html>',
    '<html><body><div id="header">Daily paper <a href="/login">Log in</a></div><div class="menu"><a href="/p">Politics</a><a href="/s">Sports</a></div><div class="ad">Buy two shirts and pay for one only today.</div>[[<div class="content"><h1>Council votes for the bridge</h1><p>The council voted on Monday after a long debate.</p><blockquote>We waited ten years.</blockquote><p>Work starts in spring and ends next year.</p></div>]]<div class="related"><a href="/2">More on bridges</a><a href="/3">Old bridges</a></div><div class="footer">Terms Privacy Contact</div></body></html>',
    '<html><body><nav><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></nav><div class="ad">Special offer, click now.</div>[[<article><h1>Plain title.</h1><p><b>Plain title.<br><p>First paragraph of this page has words.</p><p>Short.</p></article>]]<footer>&copy; example &middot; some words here.</footer>',
    '<html><body><p>Site of the town library, open daily.</p><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div>[[<div class="post"><h1>New books</h1><p>Forty new books came in this week, among them two atlases.</p><p>Ask at the desk for them.</p><table><tr><td>Atlas</td><td>Room 2</td></tr></table></div>]]<div class="comments">First! I love this library.</div><div class="newsletter">Sign up for our letter. <form><input></form></div></body></html>',
    '<html><body><ul><li><a href="/">Home</a></li><li><a href="/m">Map</a></li></ul>[[<h1>The mill on the hill</h1><p>The mill was built by two brothers and ran for ninety years.</p><p>It is open again since May, as <a href="/p">the parish wrote</a>.</p>]]<div class="footer">Imprint and terms</div></body></html>',
    '<html><body><table><tr><td><a href="/">Index</a><br><a href="/old">Archive</a></td><td>[[<h2>Notes on tides</h2>Tides follow the moon.<br>They come twice a day on most coasts.<p>See <a href="/t">the table of high water</a> for your harbour.</p>]]</td></tr></table><center>Last change in June</center></body></html>',
    '<html><body><div id="top"><a href="/">Start</a> | <a href="/all">All pages</a></div>[[<div class="text"><div>The garden is small but holds forty kinds of roses.</div><div>Most of them flower twice, in June and in <a href="/s">early September</a>.</div><ul><li>Bring water.</li><li>Leave dogs at the gate.</li></ul></div>]]<div id="copyright">Garden club</div></body></html>',
    '[[<p>A plain page without any frame has only its words.<p>They are the whole text, with <b>bold</b> and <i>slanted</i> ones, and <a href="/l">links to other pages</a>.]]',
)


def learn(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Weights by log odds of tokens inside and outside the marked content."""
    good: Counter = Counter()
    bad: Counter = Counter()
    for page in pages:
        inside = False
        for key, text in tokens(page):
            if key[0] == "t":
                (good if inside else bad)[key] += 1
                continue
            for part in re.split(r"(\[\[|\]\])", text):
                if part in ("[[", "]]"):
                    inside = part == "[["
                else:
                    (good if inside else bad)[key] += len(part.split())
    weights = {}
    for key in {*good, *bad}:
        w = math.log((good[key] + 0.5) / (bad[key] + 0.5))
        weights[key] = min(w, TAG_CAP) if key[0] == "t" else w
    for kind in {k for k, _ in HINTS} | {*TAG_KIND.values(), "skip"}:
        for link in "wl":
            if kind == "content":
                weights[f"{link}:{kind}"] = max(weights.get(f"{link}:{kind}", 1.0), 0.5)
            else:
                weights[f"{link}:{kind}"] = min(weights.get(f"{link}:{kind}", -2.0), -0.5)
    return weights


WEIGHTS = learn()


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The blocks of the best region, joined by two line feeds."""
    if not page:
        return ""
    return _read(page, weights, False) or _read(page, weights, True)  # a compound class, as of a layout, may stand around all there is


def _read(page: str, weights: dict[str, float], strict: bool) -> str:
    got = Reading(page, strict=strict)
    wraps = got.wraps
    if wraps:
        got = Reading(page, strict=strict, wraps=wraps)
    if not got.nested:
        return best_region(got.found, weights)
    missing = frozenset(got.open)
    if missing:
        got = Reading(page, missing, strict=strict, wraps=wraps)
    text = best_region(got.found, weights)
    if got.nested:
        other = best_region(Reading(page, missing, True, strict, wraps).found, weights)
        if len(other.split()) > 2 * len(text.split()):  # the article holds more than the rest of the page
            return other
    return text


def best_region(found: list[tuple[str, str]], weights: dict[str, float]) -> str:
    """The text of the run of tokens with the largest sum."""
    best = now = 0.0
    start, span = 0, (0, 0)
    inside = [k for k, (key, text) in enumerate(found) if key[2:] == "content" and key[0] != "t" and not text.isspace()]
    first, last = (inside[0], inside[-1]) if inside else (0, -1)
    for k, (key, text) in enumerate(found):
        weight = weights.get(key, TAG_CAP if key[0] == "t" else 0.0)
        if weight < 0 and first < k < last:
            continue  # between two pieces of marked content
        now += weight if key[0] == "t" else weight * len(text.split())
        if now <= 0:
            now, start = 0.0, k + 1
        elif now > best:
            best, span = now, (start, k + 1)
    blocks: list[list[str]] = [[]]
    for key, text in found[slice(*span)]:
        if key[0] == "t":
            if key[2:] in BLOCKS:
                blocks.append([])
            elif key == "t:br":
                blocks[-1].append(" ")
        elif weights.get(key, 0.0) > 0 or key == "w:page" or key == "l:page":
            blocks[-1].append(text)
    texts = [t for b in blocks if (t := " ".join(_html.unescape("".join(b)).split()))]
    while len(texts) > 1 and _RIGHTS.fullmatch(texts[-1]):
        texts.pop()
    return "\n\n".join(texts)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    text_batches(pages.sparkSession)
    kept = [pages.schema[key], pages.schema[url]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h) for h in column(b, "_h")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(key, url, F.col(source).alias("_h")).mapInArrow(run, schema)
