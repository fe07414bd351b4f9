"""Operator 1: main text of web pages by two passes of block rules.

A page is cut into blocks of text.  Pass one looks at each block by itself: its density of stop words, its length and its
share of link text label it as text or boilerplate, or leave it open if it is short or undecided.  Markup is evidence in
that: blocks of elements marked as menus, headers, footers, forms, notices, adverts or reader comments are boilerplate
without further question, and a block in a declared article needs length only, not stop words.  Pass two gives open blocks
the label that their nearest decided neighbours on both sides share, or else that of the nearer one, in one sweep each way.
Marked elements and the borders of a declared article are walls: labels don't pass through them.  An open block
without a decided neighbour is text if it stands in a declared article and is not mostly links, or if the page has no other
text; else if it is long enough.

If less than ``LEAST_STOP`` of the words of a page's unmarked blocks are stop words, its language is none of those
listed, and length and links decide alone.  All steps take time in proportion to the page.

Cases: null and empty pages have an empty text; unclosed and misnested tags end with the element around them (inline tags
are looked for among the ``INLINE_REACH`` innermost elements); elements without text of their own, such as ``svg``, that are
never closed lose their tag only; a page cut off in a tag, a script or a style ends there; character references are
decoded once; rows that repeat a page_id, null ones too, are extracted each; very long pages are extracted whole; further
columns don't matter; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.shared import table

# Frequent function words.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i if in is it its more not of on one or our she so that the
    their there they this to was we were which will with would you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses
    son sur un une vous
    а без бы был была были было быть в во вот все вы где да для до его ее если есть еще же за и из или их к как когда которые который кто ли
    меня мне мы на нас не него нее нет ни но ну о об он она они от по под при с со так также то того тоже только у уже чем что чтобы эта эти это я
    aber als auch auf aus bei bin das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht noch sich sie sind
    und von war wie wir zu zum zur
    al como con de del el ella en es esta este ha la las lo los más no o para pero por que se sin sobre su sus un una y ya
    """.split()
)

_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style noscript template textarea title iframe object svg math noembed noframes canvas audio video select head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav aside form footer button menu dialog".split())
_MAIN = frozenset("article main".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_INLINE = frozenset("span ins label".split())
#: Elements whose ids are places to jump to and say nothing of their kind.
_TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd option tr td th span ins label".split())
# Words of class names that mark boilerplate, and words that may stand beside them: a name marks an element if all its
# words are of these two kinds and one is of the first.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription paywall sidebar widget widgets related recommended share sharing social menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist respond reply replies disqus discussion login "
    "signup search pagination pager copyright disclaimer".split()
)
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
_BESIDE = frozenset(
    "site page main article post top bottom left right global primary secondary mobile desktop js the google box bar list wrap wrapper container "
    "section area block links link inner outer content item items group panel module unit slot zone row col column region body form title "
    "text icons buttons button posts stories news by and of thread sticky fixed small large".split()
)
_NAMES = frozenset("site-header page-header side-bar top-bar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_CLOSERS: dict[str, re.Pattern] = {}

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
MOST_LINKS = 0.2
LEAST_STOP = 0.02
INLINE_REACH = 64
GOOD, BAD, OPEN = "good", "bad", "open"


@dataclass
class Block:
    """One block of a page: its text and what the rules need to know of it."""

    text: str
    link_chars: int = 0
    out: bool = False  # in a menu, a footer, an advert or the like
    declared: int = 0  # the article or main element it is in, counted from 1
    heading: bool = False
    label: str = field(default=OPEN)


@dataclass
class _Open:
    """An open element: what holds inside it."""

    tag: str
    out: bool
    declared: int
    comment: bool  # among readers' comments
    marked: bool = False  # by itself


def _named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether it names readers' comments."""
    found = comment = False
    for name in value.replace("_", "-").split():
        words = [w.rstrip("0123456789") for w in name.split("-")]
        hits = [w for w in words if w in _MARKS]
        if name in _NAMES or (hits and all(not w or w in _MARKS or w in _BESIDE or w == "x" for w in words)):
            found = True
            comment = comment or not _COMMENTS.isdisjoint(hits)
    return found, comment


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes mark boilerplate, and whether they name readers' comments."""
    if not attributes or attributes.isspace():
        return False, False
    out = comment = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out = True
        elif name == "role":
            out |= value in _OUT_ROLES
        elif (name == "class" or (name == "id" and tag not in _TEXT)) and tag not in ("html", "body"):
            marked, among = _named(value)
            out, comment = out or marked, comment or among
    return out, comment


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without scripts, styles and comments."""
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    many: dict[str, int] = {}  # open elements by name
    never: set[str] = set()  # elements that are not closed any more
    parts: list[str] = []
    links = link_depth = articles = 0
    heading = False

    def end() -> None:
        nonlocal parts, links
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, min(links, len(text)), stack[-1].out, stack[-1].declared, heading))
            parts, links = [], 0

    def text(piece: str) -> None:
        nonlocal links
        if piece:
            parts.append(piece)
            if link_depth:
                links += len(piece.strip())

    def enter(tag: str, marked: bool, comment: bool) -> None:
        around = stack[-1]
        stack.append(_Open(tag, around.out or marked, around.declared, around.comment or comment, marked))
        many[tag] = many.get(tag, 0) + 1

    def leave() -> None:
        many[stack.pop().tag] -= 1

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            link_depth = 0 if closing else 1
            continue
        if tag in _RAW and not closing:
            end() if tag in _BLOCKS else None
            if tag == "head":
                # its end tag may be missing: stop before the body
                close = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, at) if tag not in never else None
                never.add(tag)
                at = close.end() if close else at
                continue
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                closer = _CLOSERS.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*>", re.I))
                close = closer.search(page, at) if tag not in never else None
                if close:
                    at = close.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    never.add(tag)
            continue
        if tag not in _BLOCKS:
            if tag in _INLINE:
                if closing:
                    for k in range(len(stack) - 1, max(0, len(stack) - 1 - INLINE_REACH), -1):
                        if stack[k].tag == tag:
                            end() if any(x.marked for x in stack[k:]) else None
                            while len(stack) > k:
                                leave()
                            break
                        if stack[k].tag not in _INLINE:
                            break
                else:
                    marked, comment = _marks(tag, m[3])
                    if marked:
                        end()
                    enter(tag, marked, comment)
            continue
        end()
        if tag in _VOID:
            continue
        if closing:
            if many.get(tag):
                while stack[-1].tag != tag:
                    leave()
                leave()
            heading = heading and not tag[1:].isdigit()
            continue
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        marked, comment = _marks(tag, m[3])
        if tag in _TEXT:
            if stack[-1].tag == tag:
                leave()
            if marked:
                enter(tag, True, comment)
        elif tag in _MAIN and not marked and not stack[-1].comment:
            # an article ends what was left open around it, unless it stands among readers' comments
            enter(tag, False, False)
            stack[-1].out = False
            if not stack[-1].declared:
                articles += 1
                stack[-1].declared = articles
        elif tag == "header":
            enter(tag, marked or not stack[-1].declared, comment)
        else:
            enter(tag, marked or tag in _OUT, comment)
    end()
    return out


_WORD = re.compile(r"\w+")


def _alone(b: Block, stop: float, listed: bool) -> str:
    """Pass one: the label of a block by itself, given its density of stop words; ``listed``: the page's language is known."""
    if b.out:
        return BAD
    n = len(b.text)
    if b.link_chars / n > MOST_LINKS:
        return OPEN if b.declared else BAD
    if n < LENGTH_LOW:
        return BAD if not b.declared and (b.link_chars or b.text[0] == "©") else OPEN
    if b.declared or not listed or stop >= STOP_HIGH or (n > LENGTH_HIGH and stop >= STOP_LOW):
        return GOOD
    return OPEN


def _short_text(b: Block) -> bool:
    """Whether a block stands in a declared article and is not mostly links."""
    return b.declared > 0 and not b.out and b.link_chars / len(b.text) <= MOST_LINKS


def classify(blocks: list[Block]) -> list[Block]:
    """Label blocks: pass one by themselves, pass two by their neighbours."""
    counts = []
    for b in blocks:
        words = [] if b.out else _WORD.findall(b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
    listed = sum(k for k, _ in counts) >= LEAST_STOP * sum(n for _, n in counts)
    first = [_alone(b, k / n if n else 0.0, listed) for b, (k, n) in zip(blocks, counts, strict=True)]
    found = GOOD in first or any(_short_text(b) for b in blocks)

    def sweep(order) -> list[int | None]:
        """The nearest decided block before each in this order, on its side of the walls."""
        out: list[int | None] = [None] * len(blocks)
        near = before = None
        for i in order:
            if before is not None and (blocks[i].out or blocks[i].declared != blocks[before].declared):
                near = None
            out[i] = near
            if not blocks[i].out and first[i] != OPEN:
                near = i
            before = i
        return out

    before, after = sweep(range(len(blocks))), sweep(range(len(blocks) - 1, -1, -1))
    for i, b in enumerate(blocks):
        b.label = first[i]
        if first[i] != OPEN:
            continue
        left, right = before[i], after[i]
        if left is None and right is None:
            b.label = GOOD if _short_text(b) or not found or (len(b.text) >= LENGTH_LOW and not b.declared) else BAD
        elif left is None or right is None:
            b.label = first[right if left is None else left]
        elif first[left] == first[right]:
            b.label = first[left]
        else:
            # a heading belongs to what follows; others to the nearer side, a tie to the text
            near = right if b.heading else left if i - left < right - i else right if right - i < i - left else left if first[left] == GOOD else right
            b.label = first[near]
    return blocks


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks in order, joined by one space."""
    return " ".join(b.text for b in classify(blocks_of(page)) if b.label == GOOD) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text, its length in code points, and the numbers of blocks seen and kept."""

    def run(batches):
        for batch in batches:
            texts, seen, kept = [], [], []
            for page in batch.column(2):
                blocks = classify(blocks_of(page.as_py() or ""))
                good = [b.text for b in blocks if b.label == GOOD]
                texts.append(" ".join(good))
                seen.append(len(blocks))
                kept.append(len(good))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(seen, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
