"""Main text of web pages by two-pass block rules (operator 8).

First pass: the page is cut into blocks at block-level tags. Blocks in menus, footers, asides, forms and the like (by element, role or
class name) and blocks full of links are boilerplate. Among the rest, length and stop-word density decide: blocks with the density of
running text are content, long ones without are not, short ones stay open. A block inside the page's article or main element is
content unless its links say otherwise; without running text or length it stays open too.
A class name whose words are not all of that kind, and a form, only dismiss where all elements of that name hold less than half of the page's
running text, or no more than twice that of an article around which nothing of the kind stands; other class names do so too if an article stands below them, and else their text is no part of that whole. A main element below always lifts such a dismissal, and so does a page that would have no text. A dismissal by an element's own name or role ends where
the page's main element begins; that of a header, dialog or fieldset, or of an element that the page leaves open, ends at an article too. A page that
would still have no text is read again without dismissals of elements left open, then without any but of hidden ones.
Where the page declares a language without a stop-word list, or its long blocks hold almost no stop words, length and links decide alone.
Second pass: an open block takes the label of the nearest decided block of its region (article or rest); at equal distance, and in
an article without any decided block, it is content if it stands in the article. Where nothing is content, open blocks are.

Tags are read by a scan that passes every character once; elements that can be dismissed are linked to those around them. So time grows with the page's length alone,
whatever is left open or unmatched.

Scripts, styles, comments, markup and hidden elements give no text. Character references are decoded, white space becomes one blank, nothing
else is dropped or cut. A null or empty page gives ''. Repeated rows are extracted alike; an empty table gives an empty result.
Columns of the input are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, LINKS, DENSE, SPARSE, LONG = 70, 0.5, 0.2, 0.08, 200
#: Stop words among the words of a page's long blocks below which its language has no list.
FOREIGN = 0.1

# Element and class names, and common words of English, French, German and Spanish.
RAW = "script style noscript template svg math iframe object canvas audio video select textarea"
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set("article aside body dialog div dl fieldset figure footer form head header li main menu nav ol p search section span table td title ul button label ins".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("aside button dialog fieldset footer form head label menu nav search title".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = set(
    "ad ads adbox adsbygoogle adsense adslot adunit advert advertisement advertising alert banner breadcrumb breadcrumbs byline-share captcha comment comments commentbox commentform commentlist consent cookie cookiebar cookieconsent cookies copyright discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Words that make a class name tell about the page: no-sidebar, has-sidebar.
STATES = set("has hide is no not show with without".split())
#: Words that say nothing beside one that does: sponsored-content, cookie-box.
NEUTRAL = set("area bar block box container content inner item items link links list module panel section slot unit wrap wrapper".split())
#: Names of side matter whatever stands before them: post-comments, left-sidebar.
SIDE = set("ads advert advertisement breadcrumb breadcrumbs comment comments cookie cookies discussion footer newsletter replies sidebar".split())
#: Elements whose dismissal ends where the page's main element begins, or its article.
LIFTED_BY_ARTICLE = set("dialog fieldset header".split())
#: Elements whose end tag is often missing.
OFTEN_OPEN = set("aside dialog fieldset footer header nav search".split())
#: Elements that end an open paragraph.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Languages with stop words below.
LISTED = set("de en es fr".split())
STOP_WORDS = set(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like may me more most my no not now of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des deux du elle en est et eux fait il ils je la le les leur lui mais même ne nos notre nous on ont ou par pas plus pour qu que qui sa sans se ses son sont sur un une vous y à été "
    "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat hatte haben ich ihr im in ist kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wie wir wird zu zum zur "
    "al algo como con contra cuando de del desde donde el ella en entre era es ese esta este fue ha hay la las lo los me mi muy más ni no o para pero por porque que se sin sobre son su sus también te tiene todo un una y ya".split()
)

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP, _SPACE, _NAME, _BARE = re.compile(r"[\s/]*"), re.compile(r"\s*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
_HTML = re.compile(r"<html(?=[\s/>])", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split()}
_PARTS = re.compile(r"[a-z]+")
#: Characters of scripts that put no blanks between words; each counts as three.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_EDGES = re.compile(r"^\W+|\W+$")


#: How firmly an element is dismissed: not at all, by a part of a class name or as a form, by a whole class name, for good, as hidden.
KEPT, WEAK, FIRM, HARD, HIDDEN = range(5)
#: How far a page is trusted: as it is; not in elements that it leaves open; not in any element but hidden ones.
STRICT, OPEN, LAX = range(3)


def attributes(page: str, at: int, missing: set[str]) -> tuple[list[tuple[str, str]], int] | None:
    """A tag's attributes from behind its name, and where it ends; None if it doesn't. missing: quotes that don't occur any more."""
    found, n = [], len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= n:
            return None
        if page[at] == ">":
            return found, at + 1
        name = _NAME.match(page, at)
        at = name.end()
        value, after = "", _SPACE.match(page, at).end()
        if page[after : after + 1] == "=" and name[0]:
            at = _SPACE.match(page, after + 1).end()
            quote = page[at : at + 1]
            end = page.find(quote, at + 1) if quote in ("'", '"') and quote not in missing else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:  # no quotes, or one that nothing closes; a quote inside a bare value is a part of it
                if quote in ("'", '"'):
                    missing.add(quote)
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.append((name[0].lower(), value))


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, list[tuple[str, str]]]]:
    """(text, None, False, []) and ('', tag, whether it is an end tag, attributes) in page order. Every character is passed once."""
    at, n, missing = 0, len(page), set()
    while at < n:
        start = page.find("<", at)
        if start != at:
            yield page[at : start if start >= 0 else n], None, False, []
        if start < 0:
            return
        nxt = page[start + 1 : start + 2]
        close = nxt == "/"
        name = _TAG.match(page, start + 1 + close)
        if name is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = n if end < 0 else end + 3
            elif nxt in ("!", "?", "/") and start + 2 < n:
                end = page.find(">", start)
                at = n if end < 0 else end + 1
            else:
                yield "<", None, False, []
                at = start + 1
            continue
        tag, read = name[0].lower(), attributes(page, name.end(), missing)
        if read is None:
            return
        own, at = read
        if not close and tag in _RAW_END:
            if not (tag in ("svg", "math") and page[at - 2] == "/"):
                end = _RAW_END[tag].search(page, at)
                at = n if end is None else end.end()
            continue
        yield "", tag, close, own


def _dismissed(tag: str, own: list[tuple[str, str]], in_article: bool) -> tuple[int, str]:
    """How firmly an element's name, role or class names mark it as no part of the main text, and which name does."""
    found = (WEAK, tag) if tag == "form" else (KEPT, "")
    if tag in BOILERPLATE and tag != "form" or tag == "header" and not in_article:
        found = (HARD, tag)
    for name, value in own:
        value = value.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return HIDDEN, name
        if name == "role" and value in ROLES:
            found = max(found, (WEAK if value == "form" else HARD, value), key=lambda f: f[0])
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = _PARTS.findall(word)
                hints = [p in HINTS or p == "header" and not in_article for p in parts]
                if any(hints) and STATES.isdisjoint(parts):
                    whole = all(hints) or parts[-1] in SIDE or all(h or p in NEUTRAL for h, p in zip(hints, parts, strict=True)) and not SIDE.isdisjoint(parts) or parts[0] in ("sponsored", "promoted")
                    found = max(found, (FIRM if whole else WEAK, word), key=lambda f: f[0])
    return found


def blocks(page: str, trust: int = STRICT) -> list[tuple[str, int, bool, bool]]:
    """(text, characters in links, dismissed, in article) of each non-empty block in page order."""
    out: list[tuple[str, int, bool, bool]] = []
    text: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, bool, tuple[int, int], int]] = []  # open containers: name, dismissal for good, article, and what was before: dismissals, those that no article ends, the innermost soft element
    soft: list[list] = []  # elements whose dismissal can be lifted: whether by a part of a name, article below, main below, name, the one around it
    within: list[int] = []  # for each block, the innermost soft element around it, or -1
    open_names: dict[str, int] = {}
    left_open = unclosed(page)
    bad = stuck = hidden = article = in_link = 0
    inner = -1

    def flush() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                linked = len(" ".join(html.unescape(" ".join(links)).split())) if links else 0
                out.append((whole, linked, bad + hidden > 0, article > 0))
                within.append(inner)
            text.clear()
            links.clear()

    def pop() -> None:
        nonlocal bad, stuck, hidden, article, inner
        name, dropped, a, (bad, stuck), inner = stack.pop()
        open_names[name] -= 1
        hidden -= dropped == HIDDEN
        article -= a

    for own_text, tag, close, own in tokens(page):
        if tag is None:
            text.append(own_text)
            if in_link:
                links.append(own_text)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = 0 if close else 1
        if tag in BLOCKS:
            flush()
            in_link = in_link if tag in ("li", "p", "div") and in_link else 0
        if tag in ENDS_P and not close and open_names.get("p"):
            depth = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 9), -1) if stack[k][0] not in ("span", "label")), -1)
            if depth >= 0 and stack[depth][0] == "p":
                while len(stack) > depth:
                    pop()
        if tag not in CONTAINERS:
            continue
        if close:
            if open_names.get(tag):
                if tag not in BLOCKS:
                    flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "li" and stack and stack[-1][0] == "li":  # its end tag may be left out
            pop()
        how, why = _dismissed(tag, own, article > 0)
        if how == HARD and (trust == LAX and tag not in ("title", "head", "button") or trust == OPEN and why in left_open):
            how = KEPT
        if how and tag not in BLOCKS:
            flush()
        own_article, before, around = tag in ("article", "main"), (bad, stuck), inner
        if own_article and bad and not hidden:
            if tag == "main" or trust > STRICT or not stuck:
                bad = stuck = 0
        if own_article and not bad and not hidden and inner >= 0:
            soft[inner][1 if tag == "article" else 2] = True
        if how in (WEAK, FIRM):
            inner = len(soft)
            soft.append([how == WEAK, False, False, why, around])
        stack.append((tag, how if how >= HARD else 0, own_article, before, around))
        open_names[tag] = open_names.get(tag, 0) + 1
        bad += how == HARD
        stuck += how == HARD and why not in LIFTED_BY_ARTICLE and why not in left_open
        hidden += how == HIDDEN
        article += own_article
    flush()
    return _lifted(out, soft, within, foreign(page, out)) if soft else out


def unclosed(page: str) -> set[str]:
    """Names of elements that the page opens more often than it closes."""
    found = page.lower()
    return {t for t in OFTEN_OPEN if f"<{t}" in found and len(re.findall(rf"<{t}(?=[\s/>])", found)) > found.count(f"</{t}")}


def _lifted(found: list, soft: list[list], within: list[int], unlisted: bool) -> list[tuple[str, int, bool, bool]]:
    """The blocks, dismissed where an element around them is and nothing lifts that. Soft elements come after those around them."""
    labels = [first_label(*b, unlisted) for b in found]
    running = [len(b[0]) if label else 0 for b, label in zip(found, labels, strict=True)]
    text = [label or label is None and b[3] for b, label in zip(found, labels, strict=True)]
    for weak, article, main, _, around in reversed(soft):  # what stands below stands below all around
        if around >= 0:
            soft[around][1] |= article
            soft[around][2] |= main
    stays = [not (weak or article or main) for weak, article, main, *_ in soft]

    def below(marks: list[bool]) -> list[bool]:
        """Whether an element or one around it is marked."""
        out: list[bool] = []
        for mark, (*_, around) in zip(marks, soft, strict=True):
            out.append(mark or around >= 0 and out[around])
        return out

    gone, bare = below(stays), below([not (s[1] or s[2]) for s in soft])
    total, whole, core = [0] * len(soft), 0, 0
    for n, at, block in zip(running, within, found, strict=True):
        if n and not (at >= 0 and gone[at]):
            whole += n
            core += n * (block[3] and not (at >= 0 and bare[at]))
            if at >= 0:
                total[at] += n
    held: dict[str, int] = {}
    own, path, times = [], [], {}
    for k, (*_, name, around) in enumerate(soft):  # an element's text is counted once for each name around it
        while path and path[-1] != around:
            times[soft[path.pop()][3]] -= 1
        own.append(not times.get(name))
        path.append(k)
        times[name] = times.get(name, 0) + 1
    for k in range(len(soft) - 1, -1, -1):
        if own[k]:
            held[soft[k][3]] = held.get(soft[k][3], 0) + total[k]
        if soft[k][4] >= 0:
            total[soft[k][4]] += total[k]
    few = lambda name: 2 * held.get(name, 0) < whole or held.get(name, 0) <= 2 * core
    less = [s or not main and few(name) for s, (_, _, main, name, _) in zip(stays, soft, strict=True)]
    for out in (less, stays, [False] * len(soft)):  # the last two for pages that would have no text
        out = below(out)
        bad = [b[2] or at >= 0 and out[at] for b, at in zip(found, within, strict=True)]
        if any(t and not b for t, b in zip(text, bad, strict=True)):
            break
    else:
        out = below(less)
        bad = [b[2] or at >= 0 and out[at] for b, at in zip(found, within, strict=True)]
    return [(t, n, b, a) for (t, n, _, a), b in zip(found, bad, strict=True)]


def _stop_words(words: list[str]) -> int:
    return sum(w in STOP_WORDS or _EDGES.sub("", w) in STOP_WORDS for w in words)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_SPACELESS.findall(text))


def foreign(page: str, found: list[tuple[str, int, bool, bool]]) -> bool:
    """Whether the page's language has no stop-word list, as declared or by the words of its long blocks."""
    if not any(not dismissed and not side and _size(text) >= SHORT for text, _, dismissed, side in found):
        return False  # no label depends on it
    declared = _HTML.search(page)
    lang = dict((attributes(page, declared.end(), set()) or ([], 0))[0]).get("lang", "") if declared else ""
    if lang[:1].isalpha() and _PARTS.match(lang.lower())[0] not in LISTED:
        return True
    words = [w for text, linked, dismissed, _ in found if not dismissed and _size(text) >= SHORT and linked <= LINKS * len(text) for w in text.lower().split()]
    return _stop_words(words) < FOREIGN * len(words)


def first_label(text: str, linked: int, dismissed: bool, in_article: bool, unlisted: bool = False) -> bool | None:
    """Content, boilerplate, or None: open."""
    if dismissed or linked > LINKS * len(text):
        return False
    if _size(text) < SHORT:
        return None
    if in_article or unlisted:
        return True
    words = text.lower().split()
    density = _stop_words(words) / len(words)
    if density >= DENSE:
        return True
    if density >= SPARSE:
        return True if len(text) > LONG else None
    return False


def main_text(page: str) -> str:
    for trust in (STRICT, OPEN, LAX):  # a page that would have no text isn't taken at its word
        found = _chosen(page, trust)
        if found:
            return found
    return ""


def _chosen(page: str, trust: int) -> str:
    found = blocks(page, trust)
    unlisted = foreign(page, found)
    labels = [first_label(*b, unlisted) for b in found]
    if True not in labels and not any(label is None and b[3] for b, label in zip(found, labels, strict=True)):
        labels = [True if label is None else label for label in labels]  # short blocks alone: a poem, a dialogue, a list
    decided = {side: [i for i, b in enumerate(found) if b[3] == side and labels[i] is not None and not b[2]] for side in (True, False)}
    last: dict[bool, int | None] = {True: None, False: None}
    after = {side: iter([*places, None]) for side, places in decided.items()}
    coming = {side: next(it) for side, it in after.items()}
    kept = []
    for i, (text, _, _, side) in enumerate(found):
        while coming[side] is not None and coming[side] <= i:
            last[side], coming[side] = coming[side], next(after[side])
        label = labels[i]
        if label is None:
            near, far = last[side], coming[side]
            if near is None or far is None:
                label = labels[near] if near is not None else labels[far] if far is not None else side
            elif i - near != far - i:
                label = labels[near if i - near < far - i else far]
            else:
                label = labels[near] if labels[near] == labels[far] else side
        if label:
            kept.append(text)
    return " ".join(kept)


def extracted(page: Column) -> Column:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) if isinstance(p, str) else "" for p in batch], dtype=object)

    return F.pandas_udf(each, "string")(page)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text, and n_chars, its code points; columns of these names are replaced."""
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*[F.col(f"`{c}`") for c in kept], extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
