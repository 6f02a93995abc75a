"""Main text of HTML pages by two passes over text blocks.

A page is read as a run of blocks (text between block-level tags).  Pass one
decides each block on its own: what stands in a menu, header, footer, sidebar,
notice, advert, form or reader comment (by element, role, class or id) is
boilerplate; what else stands in the page's article or main element is content;
elsewhere, what consists mostly of links is boilerplate, length and stop-word density decide,
and short blocks or middling ones stay open.  Pass two gives every open block
the label of its nearest decided neighbour: where both sides agree, theirs,
else the nearer side's (by words between; boilerplate on a tie), and for a heading
that of the next decided block.

A class or id alone does not make a wrapper boilerplate: one that says what state the page is in
(``has-sidebar``, ``comments-open``) says nothing, and an element that is marked by a word of its class but holds the page's largest article, or,
on a page without any, most of its running text, is judged by its blocks; reader comments are never so exempt.

Inside a block character references are decoded and white space becomes one
space; blocks of white space alone go.  Nothing else is dropped or cut.

Defined results: null or empty html, or a page without content, gives an empty
text; a tag, comment or script left open at the end of the page ends with it;
broken nesting closes the nearest open element of that name.  Repeated rows
are read row by row, an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML, words of class names, and frequent words of four languages.
RAW = "script style noscript template svg math iframe object canvas audio video select textarea button"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead title tr ul".split()
)
BAD = frozenset("aside dialog fieldset footer form head menu nav search title".split())
GOOD = frozenset(("article", "main"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = frozenset("dd dt li option p td th tr".split())
BAD_ROLE = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_WORD = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted"
    " related recommended replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENT_WORD = frozenset("comment comments replies reply".split())
STATE_FIRST, STATE_LAST = frozenset("has hasnt have is no not with without".split()), frozenset("active closed disabled enabled inactive off on open".split())
STOP_WORDS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were which with"
    " au aux avec ce dans de des du elle en est et il la le les ne par pas pour que qui se sur un une"
    " auf das dem den der die ein eine für im ist mit nicht sich sie und von vor zu"
    " como con del el es esta la las lo los más no para por que se su una y".split()
)

#: Link share above which a block is boilerplate; words below which it stays open; stop-word share for content, and for boilerplate.
LINKS, SHORT, RICH, POOR = 0.5, 10, 0.25, 0.08

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"  # foreign elements may close themselves
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>]|\Z)(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD_GAP = re.compile(r"[^a-z0-9]+")
WORDS = re.compile(r"[^\W\d_]+")


SHOWN, BY_WORD, COMMENTS, BAD_ELEMENT = range(4)


def class_words(value: str) -> set[str]:
    """Words of a class or id that say what the element is; names of a state are left out."""
    out: set[str] = set()
    for name in value.split():
        words = [w for w in WORD_GAP.split(name) if w]
        if words and not (len(words) > 1 and (words[0] in STATE_FIRST or words[-1] in STATE_LAST)):
            out.update(words)
    return out


def marked(tag: str, attrs: str, in_article: bool) -> int:
    """Whether an element is boilerplate by its name or role, or is not shown (BAD_ELEMENT), or by a word of its class or id (COMMENTS, BY_WORD)."""
    if tag in BAD and not (in_article and tag == "header"):
        return BAD_ELEMENT
    found = SHOWN
    for m in ATTR.finditer(attrs) if attrs else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = class_words(value) & BAD_WORD if tag not in ("html", "body") else set()
            if words:
                found = max(found, COMMENTS if words & COMMENT_WORD else BY_WORD)
        elif name == "role":
            if value.strip() in BAD_ROLE and not (in_article and value.strip() == "banner"):
                return BAD_ELEMENT
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return BAD_ELEMENT
    return found


class Place:
    """What stands open: boilerplate by element, the outermost article, and the elements marked by a word alone."""

    __slots__ = ("article", "bad", "by_word")

    def __init__(self, bad: bool = False, article: int | None = None, by_word: tuple[int, ...] = ()):
        self.bad, self.article, self.by_word = bad, article, by_word


class Block:
    __slots__ = ("heading", "linked", "parts", "place")

    def __init__(self, place: Place, heading: bool = False):
        self.parts: list[str] = []
        self.linked, self.place, self.heading = 0, place, heading


def blocks(html: str) -> Iterator[Block]:
    """Blocks of text in page order, each with where it stands."""
    open_: list[tuple[str, Place]] = []  # what is open, each with what it inherits
    place = outside = Place()
    marks = 0
    link, breaks = 0, 0
    now = Block(place)
    for m in TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            text = m["text"]
            now.parts.append(text)
            if link:
                now.linked += len(text.strip())
            if breaks and not text.isspace():
                breaks = 0
            continue
        tag, end, attrs = (m["tag"] or m["tag2"] or "").lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if not tag:
            continue
        if tag == "a":
            link = 0 if end else 1
        if tag == "br":
            now.parts.append("\n")
            breaks += 1
            if breaks == 2:
                yield now
                now, breaks = Block(place), 0
            continue
        block = tag in BLOCK
        if block:
            yield now
            link = breaks = 0
        if end:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            if tag == "body":
                open_ = [x for x in open_ if x[0] == "html"]
            elif tag in CLOSES_ITSELF and open_ and open_[-1][0] == tag or block and tag != "p" and open_ and open_[-1][0] == "p":
                open_.pop()
            up = open_[-1][1] if open_ else outside
            how = marked(tag, attrs, up.article is not None)
            if block or how != SHOWN:
                new = Place(up.bad or how == BAD_ELEMENT, up.article, up.by_word)
                if how in (BY_WORD, COMMENTS):
                    marks += 1
                    new.by_word = (*up.by_word, -marks if how == COMMENTS else marks)
                if up.article is None and (tag in GOOD or 'role="main"' in attrs):
                    marks += 1
                    new.article = marks
                open_.append((tag, new))
        was = place
        place = open_[-1][1] if open_ else outside
        if block or was is not place:
            if not block:
                yield now
            now = Block(place, not end and tag in HEADING)
    yield now


def exempt(places: list[Place], rich: list[int]) -> set[int]:
    """Elements marked by a word that hold the page's largest article (without any: most of its running text); no reader comments."""
    by_article: dict[int, int] = {}
    for p, n in zip(places, rich, strict=True):
        if p.article is not None and not p.bad and not any(x < 0 for x in p.by_word):
            by_article[p.article] = by_article.get(p.article, 0) + n
    if by_article:
        largest = max(by_article, key=lambda k: (by_article[k], -k))
        # what stands open around that article: the marks that all of its blocks share
        around = [set(p.by_word) for p in places if p.article == largest and not p.bad]
        return {x for x in set.intersection(*around) if 0 < x < largest}
    total = sum(n for p, n in zip(places, rich, strict=True) if not p.bad)
    held: dict[int, int] = {}
    for p, n in zip(places, rich, strict=True):
        for x in () if p.bad else p.by_word:
            held[x] = held.get(x, 0) + n
    return {x for x, n in held.items() if x > 0 and 2 * n > total}


def main_text(html: str | None) -> str:
    if not html:
        return ""
    found: list[Block] = []
    texts: list[str] = []
    words: list[list[str]] = []
    for b in blocks(html):
        text = " ".join(unescape("".join(b.parts)).split()) if b.parts else ""
        if text:
            found.append(b)
            texts.append(text)
            words.append(WORDS.findall(text.lower()))
    density = [sum(w in STOP_WORDS for w in ws) / max(1, len(ws)) for ws in words]
    linked = [b.linked > LINKS * len(t) for b, t in zip(found, texts, strict=True)]
    rich = [len(ws) if len(ws) >= SHORT and d >= RICH and not away else 0 for ws, d, away in zip(words, density, linked, strict=True)]
    places = [b.place for b in found]
    free = exempt(places, rich) if any(p.by_word for p in places) else set()
    labels: list[bool | None] = []
    for p, ws, d, away in zip(places, words, density, linked, strict=True):
        if p.bad or any(x not in free for x in p.by_word):
            labels.append(False)
        elif p.article is not None:
            labels.append(True)
        elif away:
            labels.append(False)
        else:
            labels.append(None if len(ws) < SHORT else True if d >= RICH else False if d < POOR else None)
    good = settle(labels, [len(ws) for ws in words], [b.heading for b in found])
    return "\n".join(t for t, g in zip(texts, good, strict=True) if g)


def settle(labels: list[bool | None], sizes: list[int], headings: list[bool]) -> list[bool]:
    """Open blocks get the label of the nearest decided neighbour; on a page without any, they are content."""
    n = len(labels)
    if all(label is None for label in labels):
        return [True] * n
    before: list[tuple[float, bool]] = []
    far, last = float("inf"), False
    for label, size in zip(labels, sizes, strict=True):
        before.append((far, last))
        far, last = (0, label) if label is not None else (far + size, last)
    out, far, last = [False] * n, float("inf"), False
    for i in range(n - 1, -1, -1):
        label = labels[i]
        if label is None:
            (back, prior), ahead = before[i], (far, last)
            if headings[i] and far < float("inf"):
                back = float("inf")
            out[i] = last if back == float("inf") else prior if prior == ahead[1] else prior if back < ahead[0] else ahead[1] if ahead[0] < back else False
            far += sizes[i]
        else:
            out[i] = label
            far, last = 0, label
    return out


def extract(pages: DataFrame, html: str = "html", keep: tuple[str | Column, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with ``text``, the page's main text, and ``n_chars``, its code points."""
    rows = pages.select(*keep, F.col(html).alias("__html"))
    schema = rows.drop("__html").withColumn("__main", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(h.as_py()) for h in b.column(b.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("__main").cast("long")).withColumnRenamed("__main", "text")
