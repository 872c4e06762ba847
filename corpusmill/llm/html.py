"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text; the text lengths over sliding windows of lines give a
distribution whose surges and dives bound the article.  Link text and the text of boilerplate regions (navigation,
headers and footers of the page, asides, forms, adverts, notices, comments) weighs nothing in the distribution, so a
menu of many lines makes no surge.  Where the page marks its article (`article`, `main` or their roles), the marked lines
carry extra weight, which makes short blocks such as headlines part of the surge.  Between the first and the last line
of the article nothing is dropped but boilerplate, lines of links alone among it only between two surges.

A region is boilerplate by its element, its role, or by a class or id that has no words but those of boilerplate and of
page parts: `comment-list` and `site-footer` are, `long-form` and `popular-science` aren't.

Null or empty html: an empty text.  Pages without any surge: all text outside links and boilerplate.  Broken markup is
read as far as it can be; an unclosed script, style or comment ends with the page, an unclosed quote with its tag.  Very
long pages are read whole, in time that grows with their length.  Repeated rows are read each.  Of equally heavy runs
each is as good as the heaviest.  Nulls in other columns are carried through, other columns, whatever their names, are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel

WINDOW = 3
#: A window of lines with so many characters surges; it dives when a window holds none.
SURGE = 24

#: Elements whose content is no text of the page; one that isn't closed ends with the page.
_RAW = frozenset("script style noscript template svg math iframe object canvas audio video".split())
#: Elements whose content goes with them if they are closed.
_CLOSED = frozenset("head select textarea button".split())
_AFTER = re.compile("[<>\"']")
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAG = frozenset("nav aside footer form menu dialog fieldset label legend option optgroup".split())
_BOILER_WORD = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adsense|adbox|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"nav\w*|menus?|breadcrumbs?|sidebars?|side|aside|related|recommend\w*|trending|popular|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|discussion|footer|masthead|"
    r"topbar|toolbar|pagination|pager|tags|tagcloud|copyright|legal|disclaimer|skip|search\w*|form|toc",
    re.I,
)
#: Words of page parts, which name no content.
_PART_WORD = re.compile(r"\d+|[a-z]|site|page|main|post|posts|primary|secondary|left|right|top|bottom|global|inner|outer|wrap|wrapper|container|content|box|block|bar|area|list|item|items|link|links|widgets?|section|region|slot|unit|thread|form|header|head|foot|col|column|row|group|panel|text|button|buttons|js|is|has|fixed|sticky|mobile|desktop", re.I)
_PART_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_ARTICLE_ROLE = frozenset("main article".split())
#: An open one of these ends where its like begins, as browsers have it.
_IMPLIED = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
#: Elements that close another, and how far up it is looked for.
_CLOSES, DEEP = frozenset().union(*_IMPLIED.values()), 256
_SPACE = re.compile(r"\s+")


def _names_boilerplate(value: str) -> bool:
    """Whether one of the names is made of words of boilerplate, and maybe of page parts."""
    for name in value.split():
        words = _PART_OF_NAME.findall(name)
        boiler = [_BOILER_WORD.fullmatch(w) is not None for w in words]
        if any(boiler) and all(b or _PART_WORD.fullmatch(w) for w, b in zip(words, boiler)):
            return True
    return False


def _boilerplate(name: str, tag: str, within_article: bool) -> bool:
    if name in _BOILER_TAG or name == "header" and not within_article:
        return True
    if "=" not in tag and "hidden" not in tag.lower():
        return False
    for m in _ATTR.finditer(tag, len(name) + 1):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _names_boilerplate(value):
            return True
        if key == "role" and value.lower() in _BOILER_ROLE or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _marks_article(name: str, tag: str) -> bool:
    return name in ("article", "main") or any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").lower() in _ARTICLE_ROLE or m[1].lower() == "itemprop" and (m[2] or m[3] or m[4]) == "articleBody" for m in _ATTR.finditer(tag, len(name) + 1))


def markup(page: str):
    """(from, to, element name or nothing, text it stands for) of each piece of markup, in one pass.

    A quoted value may hold any sign; if a tag doesn't end so, it ends at the first `>`.
    """
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    strict = 16
    while (begin := page.find("<", at)) >= 0:
        at = begin + 1
        following = page[at : at + 1]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "", ""
        elif page.startswith("<![CDATA[", begin):
            end = page.find("]]>", begin + 9)
            at = n if end < 0 else end + 3
            yield begin, at, "", page[begin + 9 : n if end < 0 else end]
        elif following in ("!", "?"):
            if last[">"] > begin:
                at = page.find(">", begin) + 1
                yield begin, at, "", ""
        elif (m := _NAME.match(page, begin)) and last[">"] > begin:
            end = m.end()
            # signs that matter, until one ends the tag; a quote that nothing closes is a sign like others
            while strict and (found := _AFTER.search(page, end)):
                end = found.end()
                if found[0] == ">":
                    break
                if found[0] != "<" and last[found[0]] >= end:
                    end = page.find(found[0], end) + 1
            else:
                # no end in sight: give up on quotes, and for good after some such tags, which keeps this one pass
                strict = max(0, strict - 1)
                end = page.find(">", m.end()) + 1
            name = m[1].lower()
            at = end
            opens = page[begin + 1] != "/" and not page.startswith("/>", end - 2)
            if opens and (name in _RAW or name in _CLOSED):
                closing = re.compile(f"</{name}(?![\\w:-])[^>]*>?", re.I).search(page, end)
                if closing or name in _RAW:
                    at = closing.end() if closing else n
                    yield begin, at, "", ""
                    continue
            yield begin, end, name, ""


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, characters outside links, boilerplate, marked as article) of each block of text in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # name, boilerplate, article
    opened: Counter[str] = Counter()
    bad = good = links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((text, max(0, len(text) - linked), bad > 0, good > 0))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal bad, good, links
        for name, b, g in stack[k:]:
            bad -= b
            good -= g
            links -= name == "a"
            opened[name] -= 1
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    for begin, end, name, literal in markup(page):
        add(page[at:begin])
        at = end
        if not name:
            add(entities.escape(literal))
            continue
        tag = page[begin:end]
        if name in _BLOCK:
            flush()
        if tag[1] == "/":
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    close(k)
                    break
                # an inline tag's end doesn't reach over an open block
                if name not in _BLOCK and stack[k][0] in _BLOCK:
                    break
        elif name not in _VOID and not tag.endswith("/>"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP), -1) if name in _CLOSES else ():
                if name in _IMPLIED.get(stack[k][0], ()):
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "td", "blockquote"):
                    break
            mark = _marks_article(name, tag)
            boiler = _boilerplate(name, tag, good > 0 or mark)
            stack.append((name, boiler, mark and not boiler))
            bad += boiler
            good += mark and not boiler
            links += name == "a"
            opened[name] += 1
    add(page[at:])
    flush()
    return out


def surges(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Runs of lines [from, to) between a surge of the windowed lengths and their dive."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if weights[i] and sums[i] >= surge:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            end = j
            while end > i and not weights[end - 1]:
                end -= 1
            found.append((i, end))
            i = max(j, i + 1)
        else:
            i += 1
    return found


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, in order, joined by line feeds."""
    if not page:
        return ""
    rows = lines(page)
    marked = any(article and not bad for _, _, bad, article in rows)
    inside = [not bad and (article or not marked) for _, _, bad, article in rows]
    weights = [(max(solid, 1) + (surge if article else 0) if solid or article else 0) if own else 0 for (_, solid, _, article), own in zip(rows, inside)]
    runs = surges(weights, window, surge)
    if not runs:
        # nothing surges: a page of a few short lines
        return "\n".join(row[0] for row, w in zip(rows, weights) if w)
    if not marked:
        # without a marked article it goes from the first to the last run that compares with the heaviest
        heavy = max(sum(weights[a:b]) for a, b in runs)
        near = [k for k, (a, b) in enumerate(runs) if sum(weights[a:b]) * 10 >= heavy]
        runs = runs[near[0] : near[-1] + 1]
    begin, end = runs[0][0], runs[-1][1]
    keep = [own and (weights[i] > 0 or begin <= i < end) for i, own in enumerate(inside)]
    if marked:
        return "\n".join(row[0] for row, k in zip(rows, keep) if k)
    return "\n".join(rows[i][0] for i in range(begin, end) if keep[i])


def _run(batches):
    for batch in batches:
        text = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; no shuffle, a page at a time."""
    return pages.select("page_id", "url", "html").mapInArrow(kernel.freed(_run), "page_id long, url string, text string, n_chars long")
