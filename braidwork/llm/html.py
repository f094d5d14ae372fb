"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags), each with its root-to-leaf tag path. Per path the
text length, the punctuation and the number of nodes are summed; length per node and punctuation per node are
smoothed over the page (each block takes a share of its neighbours' ratios), fused by multiplication, and paths
at or over a share of the standard deviation of all paths are content. Text in links counts for nothing, so lists of
links lose. The main text is every block on a content path and every block in the containers of content paths, so
short headings and one-word paragraphs of an article stay; where article or main elements hold a quarter of the
page's text or more, what is beside them loses.

Elements that never hold an article (menus, headers, footers, sidebars, scripts) are cut before the ratios are taken.
Forms, and what a class, id or role tells as boilerplate (reader comments, adverts, bars), stay where they hold an
article or, on a page without one elsewhere, most of the text. Elements to cut that are never closed end at the next
block that isn't a list. Tags are found in one pass over the page, whatever is left open in it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from braidwork.llm import common

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mspace mstyle mpadded mphantom mtable mtr mtd".split())
NEVER = frozenset("head nav header footer aside menu dialog button select option fieldset input object applet audio video canvas map datalist annotation annotation-xml".split()) | RAW
#: What goes on inside an element to cut that is never closed; any other block ends it.
LISTS = frozenset("ul ol li dl dt dd menu select optgroup option button fieldset legend label nav source track param".split()) | INLINE
#: Elements that a start tag of the key closes when one is open.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
#: Where looking for an element to close stops.
SCOPE = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"])}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Words that mark what isn't the article, where a class, id or role consists of them and of words for places (cookie-bar and site-footer, but not has-sidebar).
READER_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
WORDS = READER_WORDS | frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo banner sidebar side-bar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended widget toolbar pagination pager complementary contentinfo search skip".split()
)
PLACES = frozenset("area bar block bottom box column container desktop fixed global group inner item items left link links list mobile outer page panel reader readers region right secondary section site sticky the top user users wrap wrapper".split())
SPLIT = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
#: A start or end tag up to its name, a comment or declaration; and the rest of a tag, where only values in quotes hide a ">".
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|(!--)|(!\[CDATA\[)|[!?/])")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
#: One attribute: its name, and its value in double quotes, single quotes or none.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


class Paths:
    """Tag paths as a tree of numbers: a path is its parent and its last step, so deep nesting costs no copies. 0 is the empty path."""

    def __init__(self):
        self.parent, self.step = [-1], [""]
        self.known: dict[tuple[int, str], int] = {}

    def child(self, path: int, step: str) -> int:
        key = path, step
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(path)
            self.step.append(step)
        return self.known[key]

    def tag(self, path: int) -> str:
        return self.step[path].split(".")[0]

    def wholes(self) -> list[int]:
        """Of each path the innermost article or main element it is in, or -1. Parents have smaller numbers than their children."""
        out = [-1]
        for i in range(1, len(self.parent)):
            out.append(i if self.tag(i) in ("article", "main") else out[self.parent[i]])
        return out

    def containers(self) -> list[int]:
        """Of each path the article or main element it is in, else the element around its last block."""
        whole, out = self.wholes(), [0]
        for i in range(1, len(self.parent)):
            up = self.parent[i]
            out.append(whole[i] if whole[i] >= 0 else up if up and self.tag(i) not in ("body", "html", "div", "section") else i)
        return out


def attributes(source: str) -> tuple[str, bool]:
    """What class, id and role say, and whether the element is hidden (by attribute or style); values of other attributes don't matter."""
    marks, hidden = [], False
    for m in ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            marks.append(value)
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            hidden = True
    return " ".join(marks), hidden


def marked(marks: str, words: frozenset = WORDS) -> bool:
    """Whether one of the classes, ids or roles consists of boilerplate words and words for places, with one of the former at least."""
    for mark in marks.split():
        own = [x.lower() for x in SPLIT.split(mark) if x]
        if any(x in words for x in own) and all(x in words or x in PLACES for x in own):
            return True
    return False


def tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, name, attributes) of every tag; comments and declarations have no name. What a tag that isn't closed by the end of the page holds is no text."""
    out = []
    at, size, last, quoted = 0, len(page), page.rfind(">"), True
    endless: set[str] = set()  # elements of plain text that no end tag closes any more
    while True:
        at = page.find("<", at)
        m = OPENING.match(page, at) if at >= 0 else None
        if at < 0:
            return out
        if not m:
            at += 1
            continue
        if m[3] or m[4]:
            end = page.find("-->" if m[3] else "]]>", m.end())
            end = size if end < 0 else end + 3
            out.append((at, end, False, "", ""))
        elif at > last:
            out.append((at, size, False, "", ""))
            return out
        elif not m[2]:
            end = page.find(">", at) + 1
            out.append((at, end, False, "", ""))
        else:
            rest = REST.match(page, m.end()) if quoted else None
            if quoted and not rest:
                quoted = False  # a quote hides all that is left: from here on tags end at the next ">"
            end = rest.end() if rest else page.find(">", m.end()) + 1
            out.append((at, end, bool(m[1]), m[2].lower(), page[m.end() : end - 1]))
            if m[2].lower() in RAW and not m[1]:
                name = m[2].lower()
                close = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, end)
                if not close:
                    endless.add(name)
                if close or name in ("script", "style"):
                    end = close.end() if close else size
                    out[-1] = (at, end, False, "", "")
        at = end


def left_open(found: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Numbers of the tags of elements to cut that no end tag closes."""
    open_: dict[str, list[int]] = defaultdict(list)
    for i, (_, _, closing, name, _) in enumerate(found):
        if name in NEVER and name not in VOID:
            if not closing:
                open_[name].append(i)
            elif open_[name]:
                open_[name].pop()
    return {i for x in open_.values() for i in x}


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The tag paths, and (path, text, characters in links) of each block that isn't in a cut element, in page order; paths hold block-level tags and the class of each. Time grows with the page, however deep its elements stand and whatever is left open."""
    paths = Paths()
    out: list[tuple[int, list[tuple[int, str, bool]]]] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, cut, path, marked element around
    open_: dict[str, int] = defaultdict(int)
    cut = 0
    text: list[tuple[int, str, bool]] = []  # pieces with the innermost marked element around (which of these are cut is known at the end), and whether in a link
    # marked elements, each with the one around it (-1: none), whether it is reader comments, or inside such, and what it holds
    above: list[int] = []
    readers: list[bool] = []
    among: list[bool] = []
    articles: set[int] = set()
    mains: set[int] = set()
    stays = False  # an article or main that isn't cut

    def flush() -> None:
        if text:
            out.append((stack[-1][2] if stack else 0, text[:]))
            text.clear()

    def pop_to(n: int) -> None:
        nonlocal cut
        if any(tag not in INLINE for tag, *_ in stack[n:]):
            flush()
        for tag, off, *_ in stack[n:]:
            cut -= off
            open_[tag] -= 1
        del stack[n:]
        while ends_at and ends_at[-1] >= n:
            ends_at.pop()

    def close_open(tags: frozenset, stop: frozenset) -> None:
        if not any(open_[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                pop_to(i)
                return
            if stack[i][0] in stop:
                return

    at = 0
    found = tags(page)
    loose = left_open(found)
    ends_at: list[int] = []  # places in the stack of elements to cut that are never closed
    for number, (start, end, closing, name, source) in enumerate([*found, (len(page), len(page), False, "", "")]):
        around = stack[-1][3] if stack else -1
        if not cut and start > at:
            text.append((around, page[at:start], open_["a"] > 0))
        at = end
        if not name:
            continue
        if closing:
            if open_[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                pop_to(i)
            continue
        if ends_at and name not in LISTS and name not in VOID:
            pop_to(ends_at[0])
        if name in ENDS_P:
            close_open(CLOSES["p"], frozenset())
        if name in CLOSES and name != "p":
            close_open(CLOSES[name], SCOPE.get(name, frozenset()))
        around = stack[-1][3] if stack else -1
        if name == "br":
            if not cut:
                text.append((around, " ", False))
            continue
        if name not in INLINE:
            flush()
        if name in VOID or source.endswith("/") and name not in INLINE and name not in ENDS_P or name in RAW:
            continue
        marks, hidden = attributes(source) if source else ("", False)
        whole = name in ("article", "main")
        off = name not in ("html", "body") and (name in NEVER or hidden)
        mark = not off and not cut and name not in ("html", "body") and (name == "form" or bool(marks) and marked(marks, READER_WORDS if whole else WORDS))
        if whole and not (off or cut or mark):
            # articles among reader comments are comments
            if around >= 0:
                (mains if name == "main" else articles).add(around)
            stays = stays or name == "main" or around < 0 or not among[around]
        if mark:
            above.append(around)
            readers.append(bool(marks) and marked(marks, READER_WORDS))
            among.append(readers[-1] or around >= 0 and among[around])
            around = len(above) - 1
        path = stack[-1][2] if stack else 0
        if name not in INLINE:
            path = paths.child(path, f"{name}.{marks.split()[0]}" if marks.split() else name)
        if number in loose:
            ends_at.append(len(stack))
        stack.append((name, off, path, around))
        open_[name] += 1
        cut += off
    if not cut:
        flush()
    return paths, unmarked(out, above, readers, articles, mains, stays)


def unmarked(found: list[tuple[int, list[tuple[int, str, bool]]]], above: list[int], readers: list[bool], articles: set[int], mains: set[int], stays: bool) -> list[tuple[int, str, int]]:
    """The blocks without the pieces in marked elements.

    A marked element stays if it holds an article or main or, where the page has none that stays, over half of
    the page's text; reader comments, often longer than the article, only if they hold a main or all of the text.
    """
    sizes = [0] * len(above)
    total = 0
    if above:
        for _, pieces in found:
            for around, piece, _ in pieces:
                n = len("".join(piece.split()))
                total += n
                if around >= 0:
                    sizes[around] += n
        for k in range(len(above) - 1, -1, -1):  # what is inside counts outside
            if above[k] >= 0:
                sizes[above[k]] += sizes[k]
                for held in (articles, mains):
                    if k in held:
                        held.add(above[k])
    gone: list[bool] = []
    for k, comments in enumerate(readers):
        holds = k in mains or k in articles and not comments
        own = not holds and (stays or (sizes[k] < total if comments else sizes[k] * 2 <= total))
        gone.append(own or above[k] >= 0 and gone[above[k]])
    out = []
    for path, pieces in found:
        kept = [(piece, link) for around, piece, link in pieces if around < 0 or not gone[around]]
        line = " ".join(entities.unescape("".join(piece for piece, _ in kept)).split())
        if line:
            linked = " ".join(entities.unescape("".join(piece for piece, link in kept if link)).split())
            out.append((path, line, len(linked)))
    return out


def content(paths: Paths, found: list[tuple[int, str, int]], smooth: float = 0.25, strength: float = 0.5) -> list[str]:
    """The blocks that tag-path ratios choose, in page order."""
    if not found:
        return []
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    nodes: dict[int, int] = defaultdict(int)
    for path, line, linked in found:
        length[path] += len(line) - linked
        marks[path] += len(PUNCTUATION.findall(line))
        nodes[path] += 1
    ratios = [(length[p] / nodes[p], (1 + marks[p]) / nodes[p]) for p, *_ in found]
    fused: dict[int, float] = defaultdict(float)
    for i, (path, *_) in enumerate(found):
        before, here, after = ratios[max(i - 1, 0)], ratios[i], ratios[min(i + 1, len(found) - 1)]
        text_ratio, mark_ratio = (smooth * a + (1 - 2 * smooth) * b + smooth * c for a, b, c in zip(before, here, after))
        fused[path] += text_ratio * mark_ratio / nodes[path]
    mean = sum(fused.values()) / len(fused)
    spread = math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / len(fused))
    chosen = {p for p, x in fused.items() if x >= strength * spread} or set(fused)
    container = paths.containers()
    votes: dict[int, int] = defaultdict(int)
    for path in chosen:
        votes[container[path]] += length[path]
    depth = [0]
    for up in paths.parent[1:]:
        depth.append(depth[up] + 1)
    best = max(votes, key=lambda p: (votes[p], -depth[p]))
    # beside an article elsewhere, the body itself is the container of its own blocks only
    inside = [0 in votes and (0 == best)]
    for i in range(1, len(paths.parent)):
        inside.append(inside[paths.parent[i]] or i in votes and (i == best or paths.tag(i) not in ("html", "body")))
    stays = [path in chosen or bool(path) and paths.parent[path] in votes or inside[path] for path, *_ in found]
    whole = paths.wholes()
    if 4 * sum(length[p] for p in length if whole[p] >= 0) >= sum(length.values()) and any(whole[p] >= 0 and x for (p, *_), x in zip(found, stays)):
        stays = [x and whole[p] >= 0 for (p, *_), x in zip(found, stays)]
    return [line for (_, line, _), x in zip(found, stays) if x]


def main_text(page: str | None) -> str:
    return "\n".join(content(*blocks(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html; other columns are ignored).

    A null or empty html, or a page without a text block, gives an empty text and 0; repeated rows repeat.
    No shuffle: each page is one row's work, and text of any length is read whole.
    """

    def make():
        def each(rows):
            texts = [main_text(x) for x in rows["html"]]
            return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(x) for x in texts]}

        return each

    return common.map_rows(pages.select("page_id", "url", "html"), make, "page_id bigint, url string, text string, n_chars bigint")


def op1_html(spark, sf_dir: str) -> DataFrame:
    return extract(common.load(spark, sf_dir, "pages"))
