"""Main text of HTML pages by the distribution of text over lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from wishgrid.llm.common import send_package

#: Lines in a window; a window with this many characters (or half of the fullest window) is a surge.
WINDOW, SURGE = 3, 80

# Fixed values of HTML: elements that end a line, that hold no text of the page, that never have content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "head script style noscript template title iframe object svg canvas audio video nav header footer aside "
    "button select textarea input menu dialog".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSING = frozenset("li td th tr dd dt option".split())
#: Whole names in class, id or role of an element which is not the article, unless it holds most of the page's text.
NOISE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification "
    "popup promo promotion related replies reply share sharing sidebar side social sponsor sponsored subscribe toolbar "
    "widget complementary contentinfo search alert dialog".split()
)

#: Names of them that also count as a part of a longer one (comments-area, share-buttons), and parts that turn it round.
PARTS = NOISE - frozenset("header masthead side search alert dialog notice notices complementary contentinfo".split())
TURNED = frozenset("no not non has have with without is enable enabled disabled allow".split())
COMMENTS = frozenset("comment comments reply replies disqus".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|iframe|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


KEEP, NAMED, LEAVE, PARTLY, REMARKS = range(5)


def _noise(name: str, attributes: str) -> int:
    """What to do with an element: KEEP, LEAVE, or judge it by its text: NAMED, by a part of its name PARTLY, REMARKS."""
    if name in LEFT_OUT:
        return LEAVE
    if not attributes and name != "form" or name in ("html", "body"):
        return KEEP
    own: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        own.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(own.get("style", "")):
        return LEAVE
    if name in ("article", "main"):
        return KEEP
    words = [w for key in ("class", "id", "role") for w in own.get(key, "").split()]
    names = {w.lower() for w in words}
    parts = set()
    for w in words:
        some = {p.lower() for p in _PARTS.split(w)}
        parts |= some if len(some) > 1 and not some & TURNED else set()
    if names & COMMENTS or parts & COMMENTS:
        return REMARKS
    if name == "form" or names & NOISE:
        return NAMED
    return PARTLY if parts & PARTS else KEEP


def lines(html: str) -> list[tuple[str, int, int]]:
    """Lines of the page without markup: text, characters inside links, number of the article (0: outside).

    A line without text is there only for what is left out, not for tags that follow each other. Forms and elements
    left out by name stay if they hold <main> or at least half of the text outside links and other left-out elements;
    beside an article with text, half is not enough if it would not make a surge. Where only a part of the name speaks
    against an element, it goes if most of it is links, if it would not make a surge, or outside an article if it holds less
    than a quarter of that text. Readers' comments go whatever they hold, once text that would make a surge stands before.
    """
    out: list[tuple[list[tuple[str, int, int]], bool, int]] = []
    open_tags: list[str] = []
    doubtful: list[tuple[int, int]] = []  # depth and number of the open elements that are left out by name or as forms
    outer, weight, holds_main = [-1], [0], [True]  # by number; 0 is the page
    linked, kind, before, within, articles = [0], [KEEP], [0], [False], 0
    noise_at = article_at = 1 << 30
    links, pieces, at, left_out, article = 0, [], 0, False, False

    def flush() -> None:
        nonlocal pieces, left_out
        if pieces or left_out:
            out.append((pieces, left_out, articles if article_at < 1 << 30 else 0))
        pieces, left_out = [], False

    def add(piece: str) -> None:
        nonlocal article
        k = doubtful[-1][1] if doubtful else 0
        pieces.append((piece, len(piece) * (links > 0), k))
        weight[k] += len(piece.strip()) * (links == 0)
        linked[k] += len(piece.strip()) * (links > 0)
        article = article or k == 0 and article_at < 1 << 30 and not piece.isspace()

    def pop(to: int) -> None:
        nonlocal noise_at, article_at, links
        links -= open_tags[to:].count("a")
        del open_tags[to:]
        while doubtful and doubtful[-1][0] >= to:
            doubtful.pop()
        noise_at = noise_at if noise_at < to else 1 << 30
        article_at = article_at if article_at < to else 1 << 30

    for m in _TOKEN.finditer(html):
        if m.start() > at and noise_at == 1 << 30:
            add(html[at : m.start()])
        elif m.start() > at:
            left_out = left_out or not html[at : m.start()].isspace()
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            pieces.append((" ", 0, doubtful[-1][1] if doubtful else 0))
        if m[2] or m[5]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k] == name:
                    pop(k)
                    break
            continue
        if name in EMPTY:
            continue
        if name in BLOCKS:  # closes an open paragraph, and an item or cell of its own kind
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k] == "p" or open_tags[k] == name and name in CLOSING:
                    pop(k)
                elif open_tags[k] in BLOCKS:
                    break
        if (m[4] or m[7] or "").rstrip().endswith("/") and name not in BLOCKS:
            continue
        noise = _noise(name, m[4] or m[7] or "") if noise_at == 1 << 30 else KEEP
        if noise == LEAVE:
            noise_at = len(open_tags)
        elif noise != KEEP:
            outer.append(doubtful[-1][1] if doubtful else 0)
            before.append(weight[0])
            within.append(article_at < 1 << 30)
            kind.append(noise)
            linked.append(0)
            weight.append(0)
            holds_main.append(False)
            doubtful.append((len(open_tags), len(outer) - 1))
        elif name == "main" and noise_at == 1 << 30 and doubtful:
            holds_main[doubtful[-1][1]] = True
        if article_at == 1 << 30 and name in ("article", "main") and noise_at == 1 << 30:
            article_at, articles = len(open_tags), articles + 1
        links += name == "a"
        open_tags.append(name)
    if noise_at == 1 << 30:
        add(html[at:])
    flush()
    for k in range(len(outer) - 1, 0, -1):
        weight[outer[k]] += weight[k]
        linked[outer[k]] += linked[k]
        holds_main[outer[k]] |= holds_main[k]
    stays = [True]
    for k in range(1, len(outer)):
        most = weight[k] >= max(weight[0] / 2, SURGE if article else 1)
        if kind[k] == REMARKS and before[k] >= SURGE:
            own = False
        elif kind[k] == PARTLY:
            own = most or not (linked[k] >= weight[k] or weight[k] < SURGE or not within[k] and 4 * weight[k] < weight[0])
        else:
            own = most
        stays.append(stays[outer[k]] and (holds_main[k] or own))
    told = []
    for own, gone, inside in out:
        text = " ".join(unescape("".join(p for p, _, k in own if stays[k])).split())
        if text or gone or any(not stays[k] and p.strip() for p, _, k in own):
            told.append((text, sum(n for _, n, k in own if stays[k]), inside))
    return told


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text in page order.

    Text lengths are summed over windows of lines; lines that are left out (menus, adverts, scripts and so on) count
    as empty, as do lines that are mostly links outside an article. From a surge the text runs back and on to the
    dives, windows without text, and all lines between are kept, as are those between two surges. Tags only weigh:
    lines of an article are one text, kept if it has a surge, be there dives in it or not; and where articles hold at least
    half of the text outside links, lines outside them count as empty.
    """
    found = lines(html)
    plain = [max(len(t) - n, 0) for t, n, _ in found]
    inside = sum(n for n, (_, _, a) in zip(plain, found, strict=True) if a)
    article = any(a and t for t, _, a in found) and 2 * inside >= sum(plain)
    kept = [t if a or not article and 2 * n <= len(t) else "" for t, n, a in found]
    size = [len(t) for t in kept]
    sums = [sum(size[k : k + WINDOW]) for k in range(len(size))]
    surge = min(SURGE, max(sums, default=0) / 2)
    regions: list[tuple[list[int], bool]] = []  # lines between two dives, with a surge or not
    region: list[int] = []
    surged, empty = False, 0
    for k in range(len(kept) + WINDOW):
        if k < len(kept) and kept[k]:
            region.append(k)
            surged, empty = surged or sums[k] >= surge, 0
        else:
            empty += 1
        if empty >= WINDOW and region:
            regions.append((region, surged))
            region, surged = [], False
    main = {found[k][2] for own, high in regions if high for k in own if found[k][2]}
    taken = [high or any(found[k][2] in main for k in own) for own, high in regions]
    first, last = (taken.index(True), len(taken) - 1 - taken[::-1].index(True)) if any(taken) else (0, -1)
    return [kept[k] for own, _ in regions[first : last + 1] for k in own]


def extract_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars.

    The whole html is read; null is empty. ``text`` has the blocks joined by two line breaks, references decoded and
    white space inside a block made one space; it is empty if there is none. Other columns are not read; repeated rows
    give a row each. Row by row in Arrow batches, no shuffle.
    """
    send_package(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                texts = ["\n\n".join(main_blocks(h)) if h else "" for h in some.column(2).to_pylist()]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *new], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
