"""Main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with its path of block tags from the root.
Text length and punctuation are summed per path and divided by the path's blocks;
the two ratios are smoothed along the page and fused, and paths below a threshold
go. Outside landmarks the ratios are taken of logarithms, so one huge block does not
push ordinary paragraphs out, and headings, lists, tables and the like that lie
between or next to kept blocks, under the same element, stay. Blocks in page
furniture (navigation, adverts, forms, comments and the like) count as no content whatever their ratio, but a class or id alone does not outweigh
the landmark or most of the text inside; an ``article`` or ``main`` element, where
there is one, bounds the content and asks less of its paths.

Null and empty html give an empty text. Nothing is cut off or capped. Equal pages
give equal texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeq.llm.common import slices, texts

#: Share of the best block's fused ratio that a path needs, inside and outside an article element.
INSIDE, OUTSIDE = 0.005, 0.4
#: Elements that are judged by the blocks around them on pages without landmarks, and what may stand inside of them.
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption".split())
WITHIN = STRUCTURE | {"p", "div"}
#: Weights of a block and its neighbours.
SMOOTH = np.array([0.25, 0.5, 0.25])

# Fixed values of the markup language and of page furniture.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small "
    "span strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mtable mtr mtd "
    "mstyle mpadded mphantom menclose merror semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object select noframes xmp".split())
FURNITURE = frozenset("head nav footer aside form button fieldset dialog menu audio video canvas".split())
LANDMARK = frozenset(("article", "main"))
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|side-?bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|share|sharing|"
    r"social|related|recommended|comments?|commentlist|disqus|reply|replies|widget|login|signin|signup|search|toolbar|pager|pagination)"
    r"(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: An open element of these kinds ends where one of the named kinds begins.
ENDED_BY = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def furniture(tag: str, attributes: str, in_landmark: bool) -> str:
    """Whether an element holds page furniture: "" for no, "hint" if only a class or id says so."""
    if tag in FURNITURE or (tag == "header" and not in_landmark):
        return "yes"
    if not attributes or tag in LANDMARK or tag in ("html", "body"):
        return ""
    if HIDDEN.search(attributes):
        return "yes"
    hinted = ""
    for m in ATTRIBUTE.finditer(attributes):
        value = unescape(m[2] or m[3] or m[4] or "")
        if m[1].lower() == "role":
            if value.lower() in ROLES:
                return "yes"
        elif HINT.search(value):
            hinted = "hint"
    return hinted


def outweighed(marked: list[tuple], hints: list[tuple], landmarks: list[tuple]) -> set[int]:
    """Hints that the content speaks against.

    ``marked`` are (length, punctuation, hints, landmarks) of the blocks outside certain furniture,
    ``hints`` the hints and landmarks that each hinted element lies in, ``landmarks`` the hints of each landmark.
    """
    freed: set[int] = set()
    held, own = np.zeros((len(landmarks) + 1, 2)), np.zeros((len(hints), 2))  # held: of the page in the last place
    for length, points, under, within in marked:
        held[[*within, -1]] += length, points
        if under:
            own[under[-1]] += length, points
    if landmarks:
        # elements around the largest landmark, unless more text stands outside of it without a hint
        main = int(held[:-1, 0].argmax())
        if held[main, 0] >= sum(b[0] for b in marked if not b[2] and main not in b[3]):
            freed.update(landmarks[main])
    for e in reversed(range(len(hints))):
        # most of the landmark or page it lies in, without what hinted elements inside of it hold
        around, within = hints[e]
        scope = held[within[-1] if within else -1]
        if own[e, 0] and (2 * own[e] > scope)[scope > 0].all():
            freed.add(e)
        if e in freed and around:
            own[around[-1]] += own[e]
    return freed


def blocks(html: str) -> list[tuple[str, str, bool, bool, bool]]:
    """(path, text, in furniture, in an article element, mostly links) of every block with text, in page order."""
    # tag, furniture, hinted elements, landmarks: each holds for what is inside
    stack: list[tuple[str, bool, tuple, tuple]] = []
    out, parts = [], []
    hints: list[tuple] = []  # hinted elements and landmarks that each hinted element lies in
    landmarks: list[tuple] = []  # hinted elements that each landmark lies in
    at, end = 0, len(html)
    in_link, linked = False, 0

    def flush():
        nonlocal linked
        links, linked = linked, 0
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, skip, under, within = stack[-1] if stack else ("", False, (), ())
                out.append(("/".join([s[0] for s in stack]), text, skip, under, within, 2 * links > len(text)))

    def add(text: str):
        nonlocal linked
        parts.append(text)
        linked += len(text) if in_link else 0

    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue  # a comment or declaration
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in RAW and not closing:
            if tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            in_link = not closing if tag == "a" else in_link
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            elif not closing and (m[3] or m[6]) and furniture(tag, m[3] or m[6], True):
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()  # a block begins: the paragraph is over
        enders = [k for k in range(len(stack)) if tag in ENDED_BY.get(stack[k][0], ())]
        if enders and not any(s[0] in ("ul", "ol", "dl", "table") for s in stack[enders[-1] + 1 :]):
            del stack[enders[-1] :]
        _, skip, under, within = stack[-1] if stack else ("", False, (), ())
        if tag in LANDMARK:
            within = (*within, len(landmarks))
            landmarks.append(under)
        kind = furniture(tag, m[3] or m[6] or "", bool(within))
        if kind == "hint":
            hints.append((under, within))
            under = (*under, len(hints) - 1)
        stack.append((tag, skip or kind == "yes", under, within))
    flush()
    freed: set[int] = set()
    if any(b[3] for b in out):
        freed = outweighed([(len(b[1]), len(PUNCTUATION.findall(b[1])), b[3], b[4]) for b in out if not b[2]], hints, landmarks)
    return [(path, text, skip or any(e not in freed for e in under), bool(within), links) for path, text, skip, under, within, links in out]


def main_text(html: str) -> str:
    """The blocks of content of a page, one per line."""
    found = [b for b in blocks(html) if not b[2]]
    landmark = any(b[3] for b in found)
    if landmark:
        found = [b for b in found if b[3]]
    if not found:
        return ""
    paths: dict[str, int] = {}
    of = np.array([paths.setdefault(b[0], len(paths)) for b in found])
    nodes = np.bincount(of)
    lengths, points = [len(b[1]) for b in found], [len(PUNCTUATION.findall(b[1])) for b in found]
    scaled = (lambda x: x) if landmark else np.log1p
    size = scaled(np.bincount(of, lengths) / nodes)
    marks = scaled(np.bincount(of, points) / nodes)
    fused = (size / size.max() + marks / max(marks.max(), scaled(1))) / 2
    around = np.convolve(np.pad(fused[of], 1, mode="edge"), SMOOTH, "valid")
    # a path is content or not as a whole: its blocks' smoothed ratios count together
    score = np.bincount(of, around) / nodes
    kept = score[of] >= (INSIDE if landmark else OUTSIDE) * around.max()
    if not landmark:
        kept = with_structure(found, kept.tolist())
    return "\n".join(b[1] for b, ok in zip(found, kept) if ok)


def with_structure(found: list[tuple], kept: list[bool]) -> list[bool]:
    """``kept``, and runs of headings, lists, tables and the like that belong to kept blocks.

    They belong there if they lie under the parent of a kept block, and between kept blocks or,
    unless they are links, next to one.
    """
    parents = {b[0].rpartition("/")[0] for b, ok in zip(found, kept) if ok}

    def belongs(path: str) -> bool:
        tags = path.split("/")
        for k in range(len(tags)):
            if tags[k] in STRUCTURE and WITHIN.issuperset(tags[k:]) and "/".join(tags[:k]) in parents:
                return True
        return False

    state = ["kept" if ok else "near" if belongs(b[0]) else "out" for b, ok in zip(found, kept)]
    out, at = list(kept), 0
    for kind, run in groupby(state):
        n = len(list(run))
        if kind == "near":
            before, after = at > 0 and kept[at - 1], at + n < len(kept) and kept[at + n]
            if before and after:
                out[at : at + n] = [True] * n
            elif before or after:
                # from the kept block on, up to the first links
                order = range(at, at + n) if before else range(at + n - 1, at - 1, -1)
                for i in order:
                    if found[i][4]:
                        break
                    out[i] = True
        at += n
    return out


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points) of every page; no shuffle."""
    kept = pages.select(*[pages[c].alias(f"k{i}") for i, c in enumerate(keep)], pages[html].cast("string").alias("t"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            got = pa.array([main_text(t) for t in texts(batch, "t")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], got], names=[*names, "text"])

    out = kept.mapInArrow(run, schema).toDF(*keep, "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
