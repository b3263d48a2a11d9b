"""Main text of HTML pages by block rules in two passes.

Pass one adds up evidence for each block: length, link density and stop-word density of its text, and points for the
elements around it. Pass two gives ambiguous blocks the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textnum import pieces

#: Function words of several languages, fixed values.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so what up "
    "der die und das ist nicht ein eine zu den von mit sich auf für dem des im auch es an als wie oder aus bei nach zum zur wird sind war "
    "le la les et des un une du est que qui dans en pour pas sur au avec ce il elle par plus ne se sont ou mais "
    "el los las y del que en un una por con para es se no lo su al como más pero sus le o fue era este entre".split()
)
#: Elements whose text never shows or isn't the page's own; and those that are never part of an article.
RAW = ("script", "style", "noscript", "template", "title", "textarea", "iframe", "xmp")
BAD = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "datalist"}
BLOCKS = {
    "html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
} | BAD
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in class, id or role that mark an element as no part of the article, fixed values; the second set holds for articles themselves too.
HINTS = frozenset("ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar side rail widget widgets related recommended recommendations share sharing social nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer copyright pagination pager toolbar tags search skip disclaimer paywall".split())
TALK = frozenset("comment comments commentlist disqus discussion reply replies respond responses feedback reviews teaser ad ads advert related sponsored promo".split())
#: Hints that also name what a page is about or how it is laid out; alone in a class they are like a hint in a compound name.
DOUBTFUL = frozenset("search side rail header notice notices alert alerts tags share sharing social skip discussion reply replies respond responses feedback reviews subscription".split())
_TALK_HEAD = re.compile(r"(?i)^\W*(?:\d+\s+)?(?:(?:reader|user)\s+)?(?:comments?|replies|responses|leave a (?:reply|comment)|kommentare?|leserkommentare|commentaires?|comentarios?|related (?:articles|posts|stories))(?:\s*\(?\d+\)?)?\W*$")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
#: Class names with one of these words say what an element has beside it, not what it is.
BESIDE = frozenset("has with without no by".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS, LINKS_MAIN = 70, 200, 0.15, 0.30, 0.33, 0.66
#: Below this share of known function words a text may be in another language: sentences say whether it is prose.
FOREIGN, LOWER, WIDE = 0.05, 0.6, 3
_ENDS = re.compile(r"[.!?…](?=[\s\"'”’»)]|$)|[。！？｡।؟۔։።]")
_LETTER, _LATIN = re.compile(r"[^\W\d_]"), re.compile(r"[A-Za-z\u00AA-\u024F\u1E00-\u1EFF]")
#: Ideographs, kana and hangul: a character says as much as WIDE letters.
_DENSE = re.compile(r"[\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]")
GOOD, UNSURE, NOT = 1, 0, -1
#: Points that markup adds to what a block's text says (-2 to 2): inside a named article, beside one, and in an element that is no part of it.
PRIOR = {"article": 1, "beside": -2, "outside": -3}
_RIGHTS = re.compile(r"©|(?i:copyright|all rights reserved)")
#: How an element is outside the article: by a hint in a compound name, which an article inside it undoes, or for certain.
HINTED, OUTSIDE = 1, 2


@dataclass
class Block:
    text: str
    linked: int
    bad: int
    main: bool
    heading: bool


def _state(tag: str, attributes: str, bad: int, main: bool) -> tuple[int, bool]:
    """Whether an element is outside the article, and whether in one that the page names as such."""
    if tag in BAD or tag == "header" and not main:
        bad = OUTSIDE
    named, hint = tag in ("article", "main"), 0
    if attributes and "=" in attributes or "hidden" in attributes:
        seen = []
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                bad = OUTSIDE
            elif name == "itemprop":
                named |= value.lower() == "articlebody"
            elif name in ("class", "id", "role"):
                seen.extend([x.lower() for x in _PART.findall(v)] for v in value.split())
                named |= name == "role" and value.lower() in ("main", "article")
                if name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
                    bad = OUTSIDE
        if tag not in ("html", "body"):
            for parts in seen:
                found = set(parts) & (TALK if named else HINTS | TALK)
                if found and not BESIDE & set(parts):
                    certain = found - DOUBTFUL if len(parts) == 1 else found & TALK and not named
                    hint = max(hint, OUTSIDE if certain else HINTED)
    bad = max(0 if named and bad == HINTED else bad, hint)
    return bad, main or named and not bad


def blocks(page: str) -> list[Block]:
    """The page's blocks in order: text between block-level tags, references decoded, white space as one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []
    bad, main = 0, False
    text: list[str] = []
    linked = links = 0
    heading = False

    def close() -> None:
        nonlocal linked, heading
        t = " ".join("".join(text).split())
        if t:
            out.append(Block(t, linked, bad, main, heading))
        text.clear()
        linked, heading = 0, False

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        chunk = page[at : m.start() if m else size]
        if chunk:
            t = entities.unescape(chunk) if "&" in chunk else chunk
            text.append(t)
            if links:
                linked += len(t)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not ends:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "a":
            links = max(0, links - 1) if ends else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCKS
        if block:
            close()
            links = 0
        if tag in VOID:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if block or k == len(stack) - 1:
                        if not block:
                            close()
                        del stack[k:]
                    break
            bad, main = stack[-1][1:] if stack else (0, False)
        else:
            if block and stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack and tag == stack[-1][0] and tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
                stack.pop()
                bad, main = stack[-1][1:] if stack else (0, False)
            now = _state(tag, attributes, bad, main)
            if block or now != (bad, main):
                if not block:
                    close()
                stack.append((tag, *now))
                bad, main = now
            heading = tag in HEADINGS
    close()
    return out


def _sentences(text: str, words: list[str]) -> int:
    """What sentences say of a text without known function words: 2 for long prose, 1 for prose, -1 for neither.

    Text mostly in letters that aren't Latin is prose if it holds a sentence's end; Latin text must be long, hold two
    of them, and have mostly words that start with a small letter, as lists of names and titles do not.
    """
    ends = len(_ENDS.findall(text))
    letters = len(_LETTER.findall(text))
    if 2 * len(_LATIN.findall(text)) < letters:
        return (2 if _size(text) > LONG else 1) if ends else -1
    small = sum(x[:1].islower() for x in words) / len(words)
    return 2 if len(text) > LONG and ends >= 2 and small >= LOWER else -1


def _size(text: str) -> int:
    """A text's length in letters, ideographs and the like counted WIDE times."""
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_DENSE.findall(text))


def _text_evidence(b: Block, inside: bool) -> int:
    """What a block's own text says: 2 for long prose, 1 for prose, 0 for a block too short to tell, -1 for words without function words or sentences, -2 for links or a copyright line."""
    if b.linked / len(b.text) > (LINKS_MAIN if inside else LINKS):
        return -2
    if not inside and len(b.text) < LONG and _RIGHTS.search(b.text):
        return -2
    if _size(b.text) < SHORT:
        return 0
    w = [x.strip("\"'.,;:!?()[]%*#$&«»„“”…-–—") for x in b.text.lower().split()]
    stop = sum(x in STOP for x in w) / len(w)
    if stop < FOREIGN:
        return _sentences(b.text, b.text.split())
    return 2 if stop >= STOP_HIGH and len(b.text) > LONG else 1 if stop >= STOP_LOW else -1


def judge(found: list[Block], trust_names: bool = True) -> list[tuple[bool, str]]:
    """For each block whether it is part of the article, and which rule decided: ``text``, ``markup``, ``neighbours`` or ``nothing``.

    Pass one adds what the text says (-2 to 2) and what the markup says: PRIOR points for an article's element, for
    one that the page marks as no part of it, for a block below a heading of reader comments, and for a block outside
    the article that the page names. Such a heading counts only after something that is in, and not for a named
    article that follows it. Sums of 2 and more are in, of -1 and less out. The others are ambiguous and
    take, in pass two, the label of the nearest decided block; those inside a named article look at each other only.
    Where no decided neighbour exists the markup's points decide, and without any the length. If compound class names
    (``page-menu``) and doubtful ones (``side``) leave no long prose at all in a page that has some, they are not believed.
    """
    named = any(b.main and not b.bad for b in found)
    label, rule, prior = [], [], []
    talk = talk_inside = False
    for b in found:
        inside = named and b.main
        if b.heading:
            talk, talk_inside = GOOD in label and bool(_TALK_HEAD.match(b.text)), inside
        says = _text_evidence(b, inside)
        out = b.bad == OUTSIDE or b.bad == HINTED and trust_names or talk and (talk_inside or not inside)
        mark = PRIOR["outside"] if out else PRIOR["article"] if inside else PRIOR["beside"] if named else 0
        total = says + mark
        label.append(GOOD if total >= 2 else NOT if total <= -1 else UNSURE)
        prior.append(mark)
        alone = GOOD if says >= 2 else NOT if says <= -1 else UNSURE
        rule.append("text" if alone == label[-1] else "markup")
    if trust_names and GOOD not in label and any(b.bad == HINTED and _text_evidence(b, False) == 2 for b in found):
        return judge(found, False)
    n = len(found)
    near: list[list[int | None]] = [[None] * n, [None] * n]  # the nearest decided block on either side, for those inside a named article and for the rest
    for side, order in enumerate((range(n), range(n - 1, -1, -1))):
        last: dict[bool, int | None] = {True: None, False: None}
        for k in order:
            inside = prior[k] == PRIOR["article"]
            near[side][k] = last[inside]
            if label[k]:
                last[False] = k
                if inside:
                    last[True] = k
    out = []
    for k in range(n):
        if label[k]:
            out.append((label[k] == GOOD, rule[k]))
            continue
        sides = [j for j in (near[0][k], near[1][k]) if j is not None]
        if not sides:
            out.append((prior[k] > 0 or not prior[k] and _size(found[k].text) >= SHORT, "markup" if prior[k] else "nothing"))
        elif prior[k] > 0:
            out.append((any(label[j] == GOOD for j in sides), "neighbours"))
        else:
            nearest = min(abs(j - k) for j in sides)
            out.append((any(label[j] == GOOD for j in sides if abs(j - k) == nearest), "neighbours"))
    return out


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are part of the article."""
    return [keep for keep, _ in judge(found)]


def main_text(page: str | None) -> str:
    """The article of a page, a line a block; empty for a null or empty page or one without an article."""
    found = blocks(page or "")
    return "\n".join(b.text for b, k in zip(found, classify(found), strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html); n_chars counts code points.

    A map over rows: nothing is shuffled, repeated rows stay, and no page is cut. A null or empty page gives an empty
    text, an empty table an empty result; other columns play no part.
    """
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields if f.name in ("page_id", "url")}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "html"):
            out = [main_text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")
