"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but the text areas are skipped up to their end tag.
RAW = frozenset("script style noscript template iframe svg textarea title object canvas noembed noframes xmp".split())
#: Of a formula the text stays, what repeats it in another notation goes.
DROPPED = RAW | frozenset("head nav footer aside button select input menu dialog audio video label annotation annotation-xml".split())
#: Furniture unless they hold the article: whole sites stand in one form.
SHELLS = frozenset(["form", "fieldset"])
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_LEAF = frozenset("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 td th figcaption caption summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADING = _HEADINGS | {"header", "hgroup"}
#: Words of class and id names of page furniture; a name is split at everything but letters and digits.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar"
    " comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices"
    " alert alerts popup modal overlay pagination pager widget skip copyright disclaimer feedback".split()
)
#: Those of what readers and other articles say, which may be longer than the article.
TALK = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
#: The names of paragraphs, list items, quotes and headings that count inside an article, as classes; there an id is an anchor.
ADVERT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments reply replies".split())
_PROSE = frozenset("p li pre blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary".split())
_HEADER_WORDS = frozenset(["header", "head", "top"])
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar alertdialog".split())
_NEVER = frozenset(["html", "body", "article", "main"])
_CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
#: What an opening tag closes if it is open, up to the given borders.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Paragraphs shorter than this pass no points.
LEAST = 25
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(1 << 13)
def _furniture(tag: str, attrs: str, inside: bool) -> bool | frozenset:
    """True if an element is furniture by itself, else the words of its names that say so.

    inside: within an article or main element, where a header holds the headline.
    """
    if tag in DROPPED:
        return True
    if tag == "header" and not inside:
        return True
    shell = SHELLS & {tag}
    if not attrs or tag in ("html", "body"):
        return shell
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    classes, ids = (frozenset(_WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", found.get(x, "")).lower())) for x in ("class", "id"))
    if tag in _NEVER:
        return (classes | ids) & {"comment", "comments", "reply"} if tag == "article" else frozenset()
    if tag in _PROSE:
        return classes & (ADVERT if inside else FURNITURE)
    if inside and (tag == "section" or "section" in classes):
        return classes & FURNITURE | ids & (ADVERT | TALK)
    return shell | (classes | ids) & (FURNITURE if inside or tag in _HEADING else FURNITURE | _HEADER_WORDS)


def blocks(page: str):
    """Parses a page. Nodes are (tag, parent, dropped, inside, furniture words); blocks (node, parts), parts (text, in a link, node)."""
    nodes = [("#", -1, False, False, frozenset())]
    stack = [0]
    #: The nearest block of each open element, and how many elements of each name are open.
    owners = [0]
    open_tags: dict[str, int] = {}
    out: list[tuple[int, list[tuple[str, bool, int]]]] = []
    parts: list[tuple[str, bool, int]] = []

    def flush():
        if parts:
            out.append((owners[-1], parts.copy()))
            parts.clear()

    def pop_to(depth):
        while len(stack) > depth:
            tag = nodes[stack[-1]][0]
            if tag in BLOCK:
                flush()
            open_tags[tag] -= 1
            stack.pop()
            owners.pop()

    def close(names, borders):
        if not any(open_tags.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[depth]][0]
            if tag in names:
                pop_to(depth)
                return
            if tag in borders:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text and not nodes[stack[-1]][2]:
            parts.append((text, bool(open_tags.get("a")), stack[-1]))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ends, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ends:
            if tag == "br":
                parts.append((" ", bool(open_tags.get("a")), stack[-1]))
            elif tag not in VOID:
                close({tag}, {"table"} if tag not in BLOCK and tag != "a" else ())
            continue
        if tag == "br" or tag == "wbr":
            parts.append((" " if tag == "br" else "", bool(open_tags.get("a")), stack[-1]))
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"table", "td", "th", "li", "div", "article", "section", "blockquote"} if tag != "p" else {"table", "td", "th", "article", "section", "blockquote", "div", "li"})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and nodes[stack[-1]][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop_to(len(stack) - 1)
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag == "a":
            close({"a"}, BLOCK)
        if tag == "body":
            close({"head"}, ())
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        parent = stack[-1]
        _, _, dropped, inside, _ = nodes[parent]
        found = _furniture(tag, attrs, inside)
        nodes.append((tag, parent, dropped or found is True, inside or tag in ("article", "main"), frozenset() if found is True else found))
        if attrs.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(len(nodes) - 1)
        owners.append(stack[-1] if tag in BLOCK else owners[-1])
        open_tags[tag] = open_tags.get(tag, 0) + 1
    pop_to(1)
    flush()
    return nodes, out


def _text(parts) -> str:
    return " ".join(html.unescape("".join(p[0] for p in parts)).split())


def _points(text: str, in_links: int) -> float:
    """What a paragraph passes to its parent."""
    return (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - in_links / len(text)) if len(text) >= LEAST else 0.0


def _measured(parts) -> tuple[str, int]:
    """The text of some parts and how much of it is in links."""
    return _text(parts), len(_text(x)) if (x := [p for p in parts if p[1]]) else 0


def _dead(nodes, found, whole: dict[int, tuple[str, int]]) -> list[bool]:
    """Whether each node is in furniture by name; ``whole`` gets what it measures of blocks of one name.

    An element with such a name is none if it holds the article: an article or main element, or more
    than half of the page's points, while no other article stands. Elements with more points are
    decided first. Comments and related articles need more than half of the points in any case,
    and no points of others beside them unless they hold such an element. A form, and any element
    inside an article, needs more than half of the points too, and then stays whatever else stands.
    """
    named = [0] * len(nodes)
    for i, (_, up, _, _, words) in enumerate(nodes):
        named[i] = i if words else named[up] if i else 0
    if any(named):
        points, own = [0.0] * len(nodes), [0.0] * len(nodes)
        for k, (_, parts) in enumerate(found):
            by_name = {}
            for p in parts:
                by_name.setdefault(named[p[2]], []).append(p)
            for at, some in by_name.items():
                made = _measured(some)
                if len(by_name) == 1:
                    whole[k] = made
                gain = _points(*made) if made[0] else 0.0
                own[at] += gain
                points[at] += gain
        # children come after their parents, so one pass from the end sums up whole trees
        last = list(range(len(nodes)))
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i][1]
            points[up] += points[i]
            last[up] = max(last[up], last[i])
        bodies: dict[int, list[int]] = {}
        holds = set()
        for i, n in enumerate(nodes):
            if n[0] in ("article", "main") and not n[2]:
                bodies.setdefault(named[i], []).append(i)
                while i > 0 and i not in holds:
                    holds.add(i)
                    i = nodes[i][1]
        stay, outside = {0}, own[0]
        # of the articles and main elements that stand: whether any is an article, and what an element around which all others are must span
        stands, first, final = False, -1, len(nodes)

        def admit(own_bodies):
            nonlocal stands, first, final
            for b in own_bodies:
                stands |= nodes[b][0] == "article"
                first, final = max(first, b), min(final, last[b])

        admit(bodies.get(0, ()))
        for i in sorted({*named} - {0}, key=lambda i: (-points[i], i)):
            most = 2 * points[i] > points[0]
            talk = nodes[i][4] <= TALK
            alive = named[nodes[i][1]] in stay
            free = alive and not stands and first < i and final >= i
            if alive and most and (nodes[i][4] <= SHELLS or nodes[i][3] and not talk) or free and ((most or not talk) if i in holds else most and (not talk or not outside)):
                stay.add(i)
                outside += own[i]
                admit(bodies.get(i, ()))
    dead = [False] * len(nodes)
    for i, (_, up, _, _, words) in enumerate(nodes):
        dead[i] = i > 0 and (dead[up] or bool(words) and i not in stay)
    return dead


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by an empty line; empty if there is none."""
    if not page:
        return ""
    nodes, raw = blocks(page)
    whole: dict[int, tuple[str, int]] = {}
    dead = _dead(nodes, raw, whole)
    found = []
    for k, (node, parts) in enumerate(raw):
        alive = [p for p in parts if not dead[p[2]]]
        text, in_links = whole[k] if k in whole and len(alive) == len(parts) else _measured(alive)
        if text:
            found.append((node, text, in_links))
    if not found:
        return ""
    points = [0.0] * len(nodes)
    passed = [0.0] * len(nodes)
    total = [0.0] * len(nodes)
    length = [0] * len(nodes)
    linked = [0] * len(nodes)
    for node, text, in_links in found:
        length[node] += len(text)
        linked[node] += in_links
        gain = _points(text, in_links)
        total[node] += gain
        passed[nodes[node][1] if nodes[node][0] in _LEAF else node] += gain
    # children come after their parents: an element has what paragraphs pass to it, half of what they
    # pass to its children, and two thirds of what these have of their own children
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i][1]
        length[up] += length[i]
        linked[up] += linked[i]
        total[up] += total[i]
        points[up] += 0.5 * passed[i] + points[i] * 2 / 3
        points[i] += passed[i]
    bonus = {"article": 25, "main": 15, "div": 2, "section": 2, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "th": -5}

    def score(i):
        return (points[i] + bonus.get(nodes[i][0], 0)) * (1 - linked[i] / length[i]) if length[i] else 0.0

    candidates = [i for i in range(1, len(nodes)) if length[i] and (points[i] > 0 or nodes[i][0] in ("article", "main"))]
    best = max(candidates, key=lambda i: (score(i), -i), default=0)
    up = best
    while up > 0:
        if nodes[up][0] == "article":
            best = up
        up = nodes[up][1]
    kept = _with_siblings(nodes, best, total, length, linked) if best else {best}

    # where the prose of what is kept begins and ends, and the element before each one below the same parent
    stays = [0 in kept or not best] * len(nodes)
    for i, n in enumerate(nodes):
        stays[i] = i in kept or i > 0 and stays[n[1]]
    prose = [node for node, text, in_links in found if stays[node] and _points(text, in_links) >= 1]
    first, last = (prose[0], prose[-1]) if prose else (0, 0)
    before: dict[int, int] = {}
    for i, (tag, up, _, inside, *_) in enumerate(nodes):
        if i:
            dense = tag in ("ul", "ol", "table", "div", "section") and linked[i] > 0.66 * length[i]
            # links are furniture at the ends of a container that is no article by its name, unless they have a heading
            own = inside or first < i < last or nodes[before.get(up, 0)][0] in _HEADINGS
            stays[i] = i in kept or stays[up] and not (dense and not own)
            if length[i]:
                before[up] = i
    return "\n\n".join(text for node, text, _ in found if stays[node])


def _with_siblings(nodes, best: int, total: list[float], length: list[int], linked: list[int]) -> set[int]:
    """The best container and what of the article stands beside it or beside the elements around it.

    Siblings stay if they have a fifth of its points, and sections beside a section and paragraphs if
    they are text and no links; a heading before it stays too. Further up only elements of the same
    name count, and a headline if there is none yet, up to the body or to what is an article by its name.
    """
    below: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        if i and length[i]:
            below.setdefault(n[1], []).append(i)
    kept, at = {best}, best
    share = 0.2 * total[best] * (1 - linked[best] / length[best])
    titled = False
    while at:
        up, tag = nodes[at][1], nodes[at][0]
        for i in below.get(up, ()):
            own = nodes[i][0]
            if i == at or own not in BLOCK:
                continue
            dense = linked[i] / length[i]
            gain = total[i] * (1 - dense)
            text = dense < 0.25 and length[i] >= LEAST
            if at == best:
                fits = own in _HEADING and i < at or gain > 0 and gain >= share or text and (own == tag == "section" or own == "p" and (length[i] > 80 or not linked[i]))
            else:
                fits = own == tag and gain > 0 and gain >= share or own == "h1" and i < at and not titled
            if fits:
                kept.add(i)
                titled = titled or own == "h1"
        if nodes[at][0] in ("article", "main") or nodes[up][0] in ("#", "html", "body", "article", "main"):
            break
        at = up
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of ``html``.

    Each block-level element with text of its own passes 1 point, 1 for each comma and up to 3 for
    its length to its parent, half of that to the next ancestor and two thirds of the last share
    to each further one; a container's points are cut by the share of its text that is in links.
    The best container, or the article around it, is kept with what stands beside it or beside the
    elements around it and has a fifth of its points, see ``_with_siblings``. A form goes unless most
    of the page's points are in it. Lists of links stay inside an article, in the middle of the text and
    below a heading. Of a formula the text stays. Null, empty and
    broken pages are parsed as far as they go; without text the result is empty. Pages repeated are
    results repeated. Own columns named text or n_chars are replaced; all others pass unchanged.
    """
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    keep = [c for c in rest if c != "html"]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in pages.select(*[f"`{c}`" for c in keep]).schema] + ["text string", "n_chars bigint"])

    def run(batches):
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return small_batches(pages.select(*[f"`{c}`" for c in rest])).mapInArrow(run, schema)


def op9_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
