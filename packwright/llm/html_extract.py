"""HTML extraction: blocks, a first pass of rules, and a second that settles short blocks by their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import bound_batches, map_pandas

#: Frequent short words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """the of and to in is that it for as was with be by on not he his at from are this or have an which you had were but her she they we
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    le la les de des du et un une est que qui dans pour pas sur au avec ce il par plus en ne se son ou
    el los las del y que en por con para una su al lo como más pero sus se no di il che non per sono os as do da em um uma het van een dat
    """.split()
)
#: Elements that end a block; others stand within a line.
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; the first ones hold raw text.
RAW_TAGS = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title", "noembed", "xmp")
DROP_TAGS = frozenset("head nav footer aside button select option menu dialog label object canvas audio video".split())
#: Words of class, id and role that mark what isn't the article.
DROP_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal
    overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar rail widget footer foot header masthead topbar toolbar comment comments commentlist respond reply disqus
    discussion reviews share sharing social follow related recommended recommendations trending popular newsletter subscribe subscription signup login search pagination pager tags
    copyright disclaimer skip complementary contentinfo""".split()
)
KEEP_TAGS = frozenset(("article", "main"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LINK_DENSITY, LENGTH_LOW, LENGTH_HIGH, STOPS_LOW, STOPS_HIGH = 0.33, 70, 200, 0.20, 0.30
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW_TAGS}
_SPLIT = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


def _marks(tag: str, rest: str) -> str:
    """Whether attributes say that the element is not part of the article: "hidden", "word" (of class, id or role) or ""."""
    found = ""
    for m in _ATTR.finditer(rest):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return "hidden"
        if name in ("class", "id", "role") and tag not in ("html", "body", *KEEP_TAGS) and DROP_WORDS & set(_SPLIT.findall(value)):
            found = "word"
    return found


#: Dropped elements that a first article or main within them lifts.
_LIFTS = {"main": ("header", *DROP_TAGS), "article": ()}
_CLOSES_OWN_KIND = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))


class _Open:
    """The open elements, with running counts, so that no question walks through them."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, int, bool]] = []  # tag, dropped ("", tag, hidden), number if marked by a word, before the first article or main
        self.places: list[int] = []  # of block elements in the stack
        self.count: Counter[str] = Counter()
        self.outer: Counter[str] = Counter()  # dropped elements around the first article or main, by tag
        self.hard = 0  # other dropped ones
        self.kept: list[str] = []
        self.marks: list[int] = [0]

    def push(self, tag: str, drop: str, mark: int) -> None:
        outside = not self.kept
        self.stack.append((tag, drop, mark, outside))
        self.count[tag] += 1
        if tag in BLOCK_TAGS:
            self.places.append(len(self.stack) - 1)
        if drop == "tag" and outside:
            self.outer[tag] += 1
        elif drop:
            self.hard += 1
        if mark:
            self.marks.append(mark)
        if tag in KEEP_TAGS:
            self.kept.append(tag)

    def pop(self) -> None:
        tag, drop, mark, outside = self.stack.pop()
        self.count[tag] -= 1
        if self.places and self.places[-1] == len(self.stack):
            self.places.pop()
        if drop == "tag" and outside:
            self.outer[tag] -= 1
        elif drop:
            self.hard -= 1
        if mark:
            self.marks.pop()
        if tag in KEEP_TAGS:
            self.kept.pop()

    def dropped(self) -> bool:
        lifted = _LIFTS[self.kept[0]] if self.kept else ()
        return self.hard > 0 or any(n and tag not in lifted for tag, n in self.outer.items())


def blocks(page: str) -> list[dict]:
    """Blocks in page order: text, characters within links, whether dropped by their element, kept by it, and whether a heading.

    A word of class, id or role, or being a form, doesn't drop what wraps the article: an element around main, or, where no article or main stands outside
    of dropped elements, one around an article or with more than half of the page's text (a form only with more than LENGTH_HIGH characters). A main also stays
    within other dropped elements than hidden ones. The work grows with the page, not with its depth."""
    out: list[dict] = []
    parent, wraps, least = [0], [""], [0]  # of each marked element: the one around it, whether it is around article or main, and the text without which it goes
    text: list[str] = []
    linked = at = 0
    now = _Open()

    def end_block() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append({"text": joined, "linked": linked, "drop": now.dropped(), "mark": now.marks[-1], "keep": bool(now.kept), "heading": any(now.count[t] for t in HEADINGS)})
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            said = html.unescape(raw)
            text.append(said)
            if now.count["a"]:
                linked += len("".join(said.split()))

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in BLOCK_TAGS:
            end_block()
        if m["close"]:
            while now.count[tag]:
                top = now.stack[-1]
                if top[1] or top[2]:
                    end_block()
                now.pop()
                if top[0] == tag:
                    break
            continue
        if tag in _RAW_END and not m["rest"].rstrip().endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in VOID_TAGS or m["rest"].rstrip().endswith("/"):
            continue
        if tag in _CLOSES_OWN_KIND and now.places and now.stack[now.places[-1]][0] == tag:
            for _ in range(len(now.stack) - now.places[-1]):
                now.pop()
        inside = bool(now.kept)
        marks = _marks(tag, m["rest"])
        drop = "hidden" if marks == "hidden" else "tag" if tag in DROP_TAGS or tag == "header" and not inside else ""
        word = tag == "form" or marks == "word" and not (inside and tag in ("header", *HEADINGS))
        if drop or word:
            end_block()
        if tag in KEEP_TAGS and not inside and wraps[now.marks[-1]] != "main":
            wraps[now.marks[-1]] = tag
        if word:
            parent.append(now.marks[-1])
            wraps.append("")
            least.append(LENGTH_HIGH if tag == "form" else 0)
        now.push(tag, drop, len(parent) - 1 if word else 0)
    add(page[at:])
    end_block()
    size = [0] * len(parent)
    for b in out:
        if not b["drop"]:
            size[b["mark"]] += len(b["text"])
    for n in range(len(parent) - 1, 0, -1):  # those within come after those around them
        size[parent[n]] += size[n]
        if wraps[n] and wraps[parent[n]] != "main":
            wraps[parent[n]] = wraps[n]
    outside = any(b["keep"] and not b["drop"] and not b["mark"] for b in out)
    stays = [True] * len(parent)
    for n in range(1, len(parent)):
        stays[n] = stays[parent[n]] and (wraps[n] == "main" or not outside and (bool(wraps[n]) or 2 * size[n] > size[0] and size[n] > least[n]))
    for b in out:
        b["drop"] = b["drop"] or not stays[b.pop("mark")]
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def covered(found: list[dict]) -> bool:
    """Whether the page's language has stop words here: a quarter of its longer text reaches STOPS_LOW."""
    long = [b for b in found if not b["drop"] and len(b["text"]) >= LENGTH_LOW]
    return 4 * sum(len(b["text"]) for b in long if stop_density(b["text"]) >= STOPS_LOW) >= sum(len(b["text"]) for b in long)


def first_pass(b: dict, known: bool = True) -> str:
    """good, bad, near (nearly good) or short, by link density, length and stop-word density.

    Dropped elements start as bad. Within an article or main nothing else is, and blocks that would be short are near.
    Longer blocks with few stop words (tables, code, names) are as undecided as short ones, and short ones with many, without a link, are nearly good;
    in a language that isn't known, length decides."""
    n = len(b["text"])
    links = b["linked"] / max(1, len(b["text"].replace(" ", "")))
    if b["drop"] or links > LINK_DENSITY and not b["keep"]:
        return "bad"
    stops = stop_density(b["text"])
    if n < LENGTH_LOW:
        return "near" if b["keep"] or not b["linked"] and stops >= STOPS_LOW else "short"
    if stops >= STOPS_HIGH or not known:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW or b["keep"] else "short"


def classify(found: list[dict]) -> list[bool]:
    """Whether each block is main text: short and nearly good ones go with the nearest decided blocks on either side.

    Neighbours are those on the same side of the borders of article and main; dropped elements are no neighbours, for where a menu stands says
    nothing of the text beside it. Where both sides differ, a nearly good block is kept; a heading goes with what follows it, a short one with the nearer
    side. At an edge only the decided side counts, at any distance. A block without decided neighbours is kept within article and main, and on pages
    without them. Where all that leaves nothing of a page, all blocks stay that aren't bad."""
    known = covered(found)
    kinds = [first_pass(b, known) for b in found]
    # a short line with a copyright sign before or after all longer text of the page is no part of that
    long = [k for k, b in enumerate(found) if not b["drop"] and len(b["text"]) >= LENGTH_LOW] or [k for k, b in enumerate(found) if not b["drop"]]
    for k, b in enumerate(found):
        if len(b["text"]) < LENGTH_LOW and "©" in b["text"] and not b["keep"] and not (long and long[0] < k < long[-1]):
            kinds[k] = "bad"
    parted = any(b["keep"] and not b["drop"] for b in found)
    before, after = [("edge", 0)] * len(kinds), [("edge", 0)] * len(kinds)
    for side, order in ((before, range(len(kinds))), (after, range(len(kinds) - 1, -1, -1))):
        last = {True: ["edge", 0], False: ["edge", 0]}
        for k in order:
            own = last[found[k]["keep"]]
            side[k] = (own[0], own[1])
            if kinds[k] in ("good", "bad") and not found[k]["drop"]:
                own[:] = [kinds[k], 0]
            own[1] += not found[k]["drop"]
    out = []
    for k, b in enumerate(found):
        if kinds[k] in ("good", "bad"):
            out.append(kinds[k] == "good")
            continue
        (left, far_left), (right, far_right) = before[k], after[k]
        if left == right == "edge":
            out.append(b["keep"] or not parted)
        elif "edge" in (left, right) or kinds[k] == "near":
            out.append("good" in (left, right))
        elif b["heading"]:
            out.append(right == "good")
        else:
            out.append(left == "good" and far_left <= far_right or right == "good" and far_right < far_left)
    return out if any(out) else [kind != "bad" for kind in kinds]


def main_text(page: str | None) -> str:
    """The main blocks of a page, joined by line feeds; empty for a null or empty page or one without any."""
    found = blocks(page or "")
    return "\n".join(b["text"] for b, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages, each from its whole html.

    Null and empty html and pages without main text give "" and 0. Nulls in page_id or url are kept; repeated rows and ids are rows of
    their own. Very long and deeply nested pages are read in one pass. Columns other than these, whatever their names, are left out; an empty table gives no rows."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": said, "n_chars": [len(t) for t in said]})

    return pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("string")).transform(map_pandas, run, "page_id long, url string, text string, n_chars long")
