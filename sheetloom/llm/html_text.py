"""Main text of web pages by scores on the element tree.

A page is read into a tree (with the usual omitted end tags), its text into blocks: runs of text between the
starts and ends of block elements. Elements that never hold the article (navigation, forms, scripts, those whose
role, class or id says so) are left out. Every other block passes points for its length and its commas to the
elements above it, all to the nearest, half to the next, less further up; each element's points are discounted by
its link density, the share of its text that stands in links. The element with the most points is the container;
it gives way to the article or main element around it, and takes along siblings that score well beside it. The
text is that of the container and those siblings, without blocks of links.

Null and empty pages give an empty text. Pages of any length and depth are read whole; equal pages give equal
texts; of elements with equal points the first in the page counts. An empty table gives no rows. Columns other than page_id, url and html aren't looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import only

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "select", "option", "head", "svg", "math", "canvas", "object", "audio", "video", "template", "dialog", "menu", "fieldset", "input"} | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOMES = {"article", "main"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"} | HEADINGS
#: An element that starts ends an open one of these, up to the nearest of the others.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "status"}
#: Words of a class or an id that tell what is no part of an article.
AGAINST = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "advertorial", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "rss", "share", "sharing", "shoutbox", "sidebar", "signup", "skip", "skyscraper", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "taboola", "toolbar", "topbar", "widget", "widgets"}
ABOUT = {"with", "has", "no", "without", "is", "not"}


class Page:
    """The tree as lists by element number, parents before children, and the blocks in page order."""

    def __init__(self, text: str):
        self.tag, self.parent, self.out = ["#"], [-1], [False]
        self.blocks: list[tuple[int, str, int, bool]] = []  # element, text, characters in links, left out
        self.read(text)

    def read(self, text: str) -> None:
        stack, names = [0], {"#": 1}
        links, parts, linked = 0, [], 0
        at, size = 0, len(text)
        tag, parent, out = self.tag, self.parent, self.out

        def block_of() -> int:
            for e in reversed(stack):
                if tag[e] not in INLINE:
                    return e
            return 0

        def flush() -> None:
            nonlocal linked
            if parts:
                said = " ".join(entities.unescape("".join(parts)).split())
                if said:
                    e = block_of()
                    # of an article's own header only the headings are part of it
                    beside = bool(names.get("header")) and tag[e] not in HEADINGS
                    self.blocks.append((e, said, linked, out[stack[-1]] or beside))
                parts.clear()
            linked = 0

        def pop() -> None:
            nonlocal links
            e = stack.pop()
            names[tag[e]] -= 1
            links -= tag[e] == "a"

        def end(to: int) -> None:
            """Ends the elements from the stack's place `to` on."""
            if any(tag[e] not in INLINE for e in stack[to:]):
                flush()
            while len(stack) > to:
                pop()

        def open_place(wanted: set[str], until: set[str]) -> int:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] in wanted:
                    return k
                if tag[stack[k]] in until:
                    break
            return 0

        def say(piece: str) -> None:
            nonlocal linked
            parts.append(piece)
            if links:
                linked += len(piece.strip())

        while at < size:
            m = TOKEN.search(text, at)
            if not m:
                say(text[at:])
                break
            if m.start() > at:
                say(text[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    parts.append(" ")
                elif names.get(name):
                    k = len(stack) - 1
                    while tag[stack[k]] != name and (name not in INLINE or tag[stack[k]] in INLINE):
                        k -= 1
                    if tag[stack[k]] == name and (name not in ("p", "li", "div") or not any(tag[e] in HOMES for e in stack[k + 1 :])):
                        end(k)
                elif name == "p":
                    flush()
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name not in INLINE:
                flush()
            if name in VOID:
                continue
            if name in ENDS_P and names.get("p") and (k := open_place({"p"}, {"td", "th", "table", "button", "object"})):
                end(k)
            if name in ENDS and any(names.get(x) for x in ENDS[name][0]):
                while k := open_place(*ENDS[name]):
                    end(k)
            if name == "a" and links:
                end(max(k for k, e in enumerate(stack) if tag[e] == "a"))
            if name in ("body", "html") and names.get(name):
                continue
            if name == "body" and names.get("head"):
                end(next(k for k, e in enumerate(stack) if tag[e] == "head"))
            e = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            out.append(out[stack[-1]] or self.leaves_out(name, m[3], stack))
            if m[3].endswith("/") and name in ("svg", "path", "g", "use"):
                continue
            if name in RAW:
                close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(text, at)
                at = (text.find(">", close.start()) + 1 or size) if close else size
                continue
            stack.append(e)
            names[name] = names.get(name, 0) + 1
            links += name == "a"
        flush()

    def leaves_out(self, name: str, attributes: str, stack: list[int]) -> bool:
        if name in LEFT_OUT:
            return True
        if name == "header":
            return not any(self.tag[e] in HOMES for e in stack)
        if not attributes.strip() or name in ("html", "body"):
            return False
        said: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            said.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", said.get("style", ""), re.I):
            return True
        if said.get("role", "").lower() in ROLES:
            return True
        words = [w.lower() for w in WORDS.findall(f"{said.get('class', '')} {said.get('id', '')}")]
        # with-sidebar or no-comments tell of something else than the element itself
        return name != "main" and any(w in AGAINST and before not in ABOUT for before, w in zip(["", *words], words, strict=False))

    def above(self, e: int) -> Iterator[int]:
        while e >= 0:
            yield e
            e = self.parent[e]

    def main_text(self) -> str:
        kept = [b for b in self.blocks if not b[3]]
        if not kept:
            return ""
        n = len(self.tag)
        points, size, linked = [0.0] * n, [0] * n, [0] * n
        for e, said, in_links, _ in kept:
            size[e] += len(said)
            linked[e] += min(in_links, len(said))
            if len(said) < 25 or self.tag[e] in HEADINGS:
                continue
            score = 1 + said.count(",") + min(len(said) / 100, 3)
            start = e if self.tag[e] not in ("p", "pre", "blockquote", "li", "td", "dd") else self.parent[e]
            for level, x in enumerate(self.above(start)):
                points[x] += score / (1 if level == 0 else 2 if level == 1 else 3 * level)
                if level == 5:
                    break
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
        density = lambda e: linked[e] / size[e] if size[e] else 0.0
        worth = [points[e] * (1 - density(e)) for e in range(n)]
        best = max(range(n), key=lambda e: (worth[e], -e))
        if worth[best] <= 0:
            best = max((e for e in range(n) if self.tag[e] in HOMES and size[e] and not self.out[e]), key=lambda e: size[e], default=0)
        around = [e for e in self.above(best) if self.tag[e] in HOMES]
        if around:
            best = next((e for e in around if self.tag[e] == "article"), around[-1])
        else:  # up while the parent's text is hardly more than the container's
            while self.parent[best] > 0 and self.tag[best] not in ("body", "html") and size[self.parent[best]] <= 1.1 * size[best] and self.tag[self.parent[best]] not in ("body", "html"):
                best = self.parent[best]
        roots, least = {best}, max(10.0, 0.2 * worth[best])
        if self.tag[best] not in ("#", "html", "body"):
            for e in range(1, n):
                if self.parent[e] == self.parent[best] and e != best and size[e]:
                    good = worth[e] >= least or self.tag[e] == "p" and (size[e] > 80 and density(e) < 0.25 or size[e] <= 80 and not linked[e] and size[e] > 25)
                    heading = self.tag[e] == "h1" and e < best
                    if good or heading:
                        roots.add(e)
        inside = [False] * n
        for e in range(n):
            inside[e] = e in roots or self.parent[e] >= 0 and inside[self.parent[e]]
        return "\n\n".join(said for e, said, in_links, _ in kept if inside[e] and not (self.tag[e] in ("li", "div", "td", "p", "ul") and in_links > 0.8 * len(said) and len(said) < 200))


def main_text(page: str | None) -> str:
    return Page(page).main_text() if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    source = only(pages, page_id="long", url="string", html="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
