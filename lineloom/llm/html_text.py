"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: its length, the share of its
characters inside links (link density) and the share of stop words among its words. A block of links is boilerplate, one
that isn't short and has the stop words of running prose is text, the others are left open; a long one without such words
becomes text only where all its neighbours are. Tables, repeated tokens and scripts without listed stop words are judged
by length alone. Where most of a page's blocks lack the listed stop words, its language is another or it has no sentences
(names, figures): then density says nothing there, and a long block that isn't made of links is text.

Sections add evidence: what stands in navigation, footers, sidebars, notices, adverts, forms or comments, by tag, role or
class, is boilerplate, unless that section holds most of the page's prose: then it only wraps the text. Comments are not
asked for their share, as they may be longer than the text.

The second pass gives each open block the label of its nearest decided neighbours. Neighbours count in the innermost
section of the block that has a decided one: inside the block's own section one text neighbour is enough for a heading or
a block with words of prose, further out all must be text. An open block that no decided one shares a section with, but
the page itself, is text inside an article, or where the whole page has no long block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lineloom.llm._common import attach, with_columns

#: Blocks under so many characters are short, those of at least so many are long.
SHORT, LONG = 70, 200
#: Share of characters in links above which a block is boilerplate; shares of stop words of prose, and of what is no prose.
LINKS, PROSE, FEW = 0.5, 0.1, 0.04
#: Share of its commonest token (say, a separator) from which, and share of different tokens up to which, a block is no running text; share of the page's prose that a section may hold and still be boilerplate.
TABULAR, MOST = 0.2, 0.5

# The commonest function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "the of and to in a is that it was for on as with be by this are from at or an have not he his but had they you which one we all their has "
        "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
        "de la le et les des en un du une est pour que qui dans par au il avec sur pas plus ce se ou son sont aux elle "
        "el y los del las con por una su para al lo como más pero sus no fue este ha si porque esta cuando muy sin"
    ).split()
)
# Short lines of a page's own controls, as they begin.
CONTROLS = re.compile(r"(?i)(?:share (?:this|on|via)|read (?:more|next)|continue reading|tags?:|filed under|posted (?:in|by|on)|follow us|sign up|subscribe|log ?in|print this|e-?mail this|skip to|back to top|leave a (?:reply|comment)|related (?:articles|posts)|teilen|mehr lesen|weiterlesen|partager|lire la suite|compartir|leer más)\b|(?:tags?|labels?):")
# Tags that begin or end a block, tags whose content is no text, sections that are never main text.
BLOCK_TAGS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NO_TEXT = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select button head".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
SIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_NAMES = frozenset("ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal newsletter subscribe signup login share sharing social related recommended toolbar pagination pager widget".split())
COMMENT_NAMES = frozenset("comment comments commentlist comment-list disqus disqus_thread respond reply replies".split())
NOT_SIDE = frozenset("no not non has have with without is hide hidden".split())
GROUPS = frozenset("address article aside blockquote body details dialog div dl fieldset figure footer form header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_LATIN = re.compile(r"[A-Za-z\u00aa-\u024f]")
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")


#: The elements of one kind around a place, from the innermost: (what is around it, number, depth); None: none.
Chain = tuple | None
#: Groups and sections count up to this depth, as in browsers; what is deeper belongs to the last one counted.
DEEP = 512


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    sides: Chain  # the sections around it that may be boilerplate
    path: Chain  # the groups around it
    article: int  # groups around it down to the innermost article, 0: none
    heading: bool
    label: bool | None = None


#: What a section's tag, role and class say of it.
TEXT, SIDE, COMMENTS = 0, 1, 2


def _evidence(tag: str, attributes: str, in_article: bool) -> int:
    if tag in SIDE_TAGS or tag == "header" and not in_article:
        return SIDE
    if not attributes or tag in ("html", "body", "main"):
        return TEXT
    found = TEXT
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in SIDE_ROLES:
            found = max(found, SIDE)
        if name in ("class", "id"):
            for token in value.split():
                parts = re.split("[-_]+", token)
                ends = {token} if parts[0] in NOT_SIDE else {token, parts[0], parts[-1]}
                if ends & COMMENT_NAMES:
                    return COMMENTS
                if ends & SIDE_NAMES and tag != "article":
                    found = max(found, SIDE)
    return found


def blocks(html: str) -> tuple[list[Block], dict[int, int]]:
    """The page's blocks in order, and what is said of each section that may be boilerplate; markup that isn't closed is closed where an outer element ends."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool, bool, bool]] = []  # tag, evidence, no text, link, article, group
    sides: Chain = None
    path: Chain = None
    depths: list[int] = []  # groups down to each open article
    said: dict[int, int] = {}
    silent = link = heading = number = 0
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = at = 0

    def close_block() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", "".join(text)).strip()
            if joined:
                out.append(Block(joined, min(linked, len(joined)), sides, path, depths[-1] if depths else 0, heading > 0))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal silent, link, heading, sides, path
        tag, e, n, a, r, g = stack.pop()
        opened[tag] -= 1
        if e:
            sides = sides[0]
        if r:
            depths.pop()
        if g:
            path = path[0]
        silent, link, heading = silent - n, link - a, heading - (tag in HEADINGS)

    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if not silent and not piece.startswith(("<!", "<?")):
                piece = unescape(piece)
                text.append(piece)
                if link:
                    linked += len(piece.strip())
            continue
        tag = tag.lower()
        if tag in BLOCK_TAGS:
            close_block()
        if m[1]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            if tag == "noscript" or tag == "noframes" or tag in NO_TEXT or tag == "xmp":
                at = end.end() if end else len(html)
                continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # an open one of the same kind ends here
            if stack and stack[-1][0] == tag:
                pop()
        e, n, a, r, g = _evidence(tag, m[3], bool(depths)), tag in NO_TEXT and tag not in RAW, tag == "a", tag in ("article", "main"), tag in GROUPS
        number += 1
        e, g = e if _depth(sides) < DEEP else TEXT, g and _depth(path) < DEEP
        stack.append((tag, e, n, a, r, g))
        opened[tag] += 1
        if e:
            said[number] = e
            sides = sides, number, _depth(sides) + 1
        if g:
            path = path, number, _depth(path) + 1
        if r:
            depths.append(_depth(path))
        silent, link, heading = silent + n, link + a, heading + (tag in HEADINGS)
    close_block()
    return out, said


def judged(text: str, linked: int) -> tuple[bool | None, bool, bool]:
    """The first pass for one block: True for prose, False for boilerplate, None for open; whether it has words of prose; whether it is long and lacks them."""
    if linked > LINKS * len(text):
        return False, False, False
    words = _WORD.findall(text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if len(text) < SHORT:
        return (False if linked and not density or CONTROLS.match(text) and text[-1] not in ".!?" else None), density > 0 or text[-1] in ".!?:…。", False
    if density >= PROSE:
        return True, True, False
    tokens = text.split(" ")
    commonest = Counter(tokens).most_common(1)[0][1]
    if commonest >= max(TABULAR * len(tokens), 4) or len(set(tokens)) <= TABULAR * len(tokens) or 2 * len(_LATIN.findall(text)) < sum(map(len, words)):
        return (True if len(text) >= LONG and not linked else None), True, False
    return None, density > 0, density < FEW and len(text) >= LONG


def classify(found: list[Block], said: dict[int, int]) -> list[Block]:
    """Set the label of every block: True for main text."""
    first = [judged(b.text, b.linked) for b in found]
    plain = [(len(b.text), f[0]) for b, f in zip(found, first, strict=True) if f[0] is not False and len(b.text) >= SHORT and not b.sides]
    if 2 * sum(n for n, label in plain if label) < sum(n for n, _ in plain):  # not a page of the listed languages
        first = [(True, True, False) if f[0] is None and len(b.text) >= LONG else f for b, f in zip(found, first, strict=True)]
    prose: Counter[int] = Counter()  # letters of prose in each section that may be boilerplate
    total = 0
    for b, (label, _, _) in zip(found, first, strict=True):
        if label:
            total += len(b.text)
            for s in _numbers(b.sides):
                prose[s] += len(b.text)
    wraps = {s for s, kind in said.items() if kind == SIDE and prose[s] > max(MOST * total, LONG)}
    decided = [False if any(s not in wraps for s in _numbers(b.sides)) else label for b, (label, _, _) in zip(found, first, strict=True)]
    only_short = True not in decided and not any(f[2] for f in first)
    # a page's short controls inside an article say nothing of the lines around them
    votes = [label is True or label is False and not (b.article and len(b.text) < SHORT and not b.sides) for b, label in zip(found, decided, strict=True)]
    before, last = [], None
    for i, vote in enumerate(votes):
        before.append(last)
        last = i if vote else last
    after, last = [], None
    for i in range(len(found) - 1, -1, -1):
        after.append(last)
        last = i if votes[i] else last
    after.reverse()
    for i, b in enumerate(found):
        b.label = decided[i]
        if b.label is not None:
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        shared = [_shared(b.path, found[j].path) for j in near]
        inner = max(shared, default=0)
        labels = [decided[j] for j, d in zip(near, shared, strict=True) if d == inner]
        if first[i][2]:
            b.label = inner == _depth(b.path) and all(labels)
        elif inner < b.article or only_short:
            b.label = True
        elif inner == _depth(b.path) and (b.heading or b.article or first[i][1]):
            b.label = any(labels)
        else:
            b.label = bool(labels) and (any(labels) if b.heading else all(labels))
    return found


def _depth(chain: Chain) -> int:
    return chain[2] if chain else 0


def _numbers(chain: Chain) -> Iterator[int]:
    while chain:
        yield chain[1]
        chain = chain[0]


def _shared(a: Chain, b: Chain) -> int:
    """How many groups two blocks have in common."""
    while a and b and a[1] != b[1]:
        if a[2] >= b[2]:
            a = a[0]
        else:
            b = b[0]
    return _depth(a) if b else 0


def main_text(html: str | None) -> str:
    """Main text of a page: its blocks in order, joined by a space. Null, empty and text-free pages give an empty text."""
    return " ".join(b.text for b in classify(*blocks(html)) if b.label) if html else ""


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text of column ``html``, never null. A column that already has the name is replaced."""
    attach(df.sparkSession)
    return with_columns(df, lambda: lambda pages: ([main_text(p) for p in pages],), [T.StructField(out, T.StringType(), False)], html)
