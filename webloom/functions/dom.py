"""A forgiving HTML tree on the standard library's tokenizer, and the facts of one page that need a tree.

The tree follows HTML's rules for omitted end tags.  Known differences from other tree builders: formatting elements left open when a
paragraph closes aren't opened again, tables don't push out stray text, and a missing ``html``, ``head`` or ``body`` isn't made up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

# Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dt", "dd", "section", "article", "aside", "header", "footer", "main", "figure", "figcaption", "form", "nav", "table", "thead", "tbody", "tfoot", "tr", "ul", "ol", "dl", "caption", "summary", "address", "fieldset", "legend", "body", "html"}
SKIPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "canvas", "object", "embed", "audio", "video", "meta", "link", "select", "textarea", "input", "option"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}
# A start tag closes these open elements, up to the nearest of the second set.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}), "head": (set(), {"html"}), "a": ({"a"}, {"p", "li", "div", "td", "nav", "body", "article"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "body", "button", "object", "template", "ul", "ol", "dl", "div", "section", "article"}
SPACE = re.compile(r"\s+")
NARROW = re.compile("[   ]")
EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
JUNK = ("data:", "blob:", "javascript:", "about:", "vbscript:", "mailto:", "tel:")
WRAPPED = re.compile(r"^\s*<!--|-->\s*$")
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "holds_block")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent, self.holds_block = tag, attrs, [], parent, False

    def elements(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, Node):
                stack.extend(reversed(x.children))
            elif not isinstance(x, Comment):
                yield x


class Comment(str):
    pass


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def _open(self, tags: set[str], until: set[str]) -> Node | None:
        """The nearest open element of ``tags``, looked for no further than ``until``."""
        node = self.at
        while node.parent is not None and node.tag not in until:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and (same := next((n for n in self.root.elements() if n.tag == tag), None)):
            for k, v in attrs:
                same.attrs.setdefault(k, v or "")
            return
        if tag in CLOSES_P and (p := self._open({"p"}, SCOPE - {"ul", "ol", "dl", "div", "section", "article"})):
            self.at = p.parent
        if tag in SIBLINGS:
            tags, until = SIBLINGS[tag]
            while tags and (node := self._open(tags, until)):
                self.at = node.parent
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        node = Node(tag, first, self.at)
        self.at.children.append(node)
        if tag in BLOCKS:
            up = self.at
            while up is not None and not up.holds_block:
                up.holds_block, up = True, up.parent
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "use", "g"):
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows still belongs to the body
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            # Inline end tags don't reach across a block that is still open.
            if node.tag in BLOCKS and tag not in BLOCKS:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append(Comment(data))


def tree(html: str) -> Node:
    t = Tree()
    t.feed(html)
    t.close()
    return t.root


def spaced(text: str) -> str:
    return SPACE.sub(" ", text or "").strip()


def hidden(node: Node) -> bool:
    a = node.attrs
    if "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = a.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return True
    return bool({"hidden", "invisible"} & set(a.get("class", "").lower().split()))


def text_of(node: Node) -> str:
    """Text of a leaf block; a comment within counts as text, an image by its description."""
    parts: list[str] = []
    starts = [0]  # where the texts of the open elements begin in parts
    stack: list = list(reversed(node.children))

    def add(text: str) -> None:
        text = NARROW.sub(" ", text).replace("​", "")
        if text := text if len(parts) > starts[-1] else text.lstrip():
            parts.append(text)

    while stack:
        x = stack.pop()
        if x is None:
            # A nested element's text is trimmed before it's joined.
            start = starts.pop()
            while len(parts) > start:
                parts[-1] = parts[-1].rstrip()
                if parts[-1]:
                    break
                parts.pop()
        elif not isinstance(x, Node):
            add(x)
        elif x.tag == "br":
            add(" ")
        elif x.tag == "img":
            add(x.attrs.get("alt", "").strip())
        elif x.tag not in SKIPPED and not hidden(x):
            starts.append(len(parts))
            stack.append(None)
            stack.extend(reversed(x.children))
    return spaced("".join(parts))


def blocks(root: Node) -> list[tuple[str, str]]:
    """Visible blocks ``(tag, text)`` in reading order; text beside blocks within a container is left out."""
    out: list[tuple[str, str]] = []
    body = next((n for n in root.elements() if n.tag == "body"), root)
    stack = list(reversed(body.children))
    while stack:
        node = stack.pop()
        if not isinstance(node, Node) or node.tag in SKIPPED or hidden(node):
            continue
        inner = node.holds_block if node.tag in BLOCKS else any(isinstance(c, Node) for c in node.children)
        if inner and node.tag not in HEADINGS:
            stack.extend(reversed(node.children))
        elif text := text_of(node):
            out.append((node.tag, text))
    return out


def absolute(base: str, href: str | None) -> str | None:
    h = (href or "").strip()
    if not h or h.startswith("#") or h.lower().startswith(JUNK):
        return None
    try:
        url = urldefrag(urljoin(base, h))[0]
        p = urlparse(url)
    except ValueError:
        return None
    return url if p.scheme in ("http", "https") and p.netloc else None


def _first_candidate(srcset: str) -> str:
    return srcset.split(",")[0].strip().split(" ")[0].strip()


def _images(base: str, a: dict[str, str]) -> list[str]:
    found = [a.get(k, "").strip() for k in ("src", "data-src", "data-lazy-src", "data-original")]
    for k in ("data-srcset", "srcset"):
        found += [piece.strip().split(" ")[0] for piece in a.get(k, "").split(",")]
    return [u for u in (absolute(base, f) for f in found) if u]


def _organisation(item: dict) -> dict[str, str]:
    out = {key: str(item[source]).strip() for key, source in (("name", "name"), ("description", "description"), ("url", "url"), ("founding", "foundingDate"), ("phone", "telephone")) if item.get(source)}
    logo = item.get("logo")
    if isinstance(logo, dict):
        logo = str(logo.get("url") or "").strip()
    if isinstance(logo, str) and logo:
        out["logo"] = logo
    where = item.get("address")
    if not isinstance(where, dict):
        place = item.get("location")
        where = place.get("address") if isinstance(place, dict) else None
    if isinstance(where, dict) and (line := ", ".join(str(where[k]) for k in ADDRESS if where.get(k))):
        out["location"] = line
    return out


def _json_ld(root: Node) -> dict:
    types, org, emails, phones = set(), {}, set(), set()
    for script in root.elements():
        if script.tag != "script" or script.attrs.get("type") != "application/ld+json":
            continue
        raw = "".join(script.strings())
        data = None
        for text in (raw, WRAPPED.sub("", raw.strip())):
            try:
                data = json.loads(text)
                break
            except (ValueError, RecursionError):
                continue
        if data is None:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict):
                t = item.get("@type")
                types.update(str(x) for x in (t if isinstance(t, list) else [t]) if x)
                org = org or _organisation(item)
        stack = [data]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                for k, v in x.items():
                    if isinstance(v, str) and k == "email":
                        emails.update(EMAIL.findall(v.replace("mailto:", "")))
                    elif isinstance(v, str) and k in ("telephone", "phone") and sum(c.isdigit() for c in v) >= 7:
                        phones.add(spaced(v))
                    stack.append(v)
            elif isinstance(x, list):
                stack.extend(x)
    names = ("name", "description", "url", "founding", "phone", "logo", "location")
    return {"types": sorted(types), "emails": sorted(emails), "phones": sorted(phones)} | {k: org.get(k) for k in names}


def page_facts(html: str, base: str) -> dict:
    """What a page's tree holds, as the struct that ``parse.PAGE`` describes."""
    root = tree(html)
    facts: dict = {"metas": [], "links": [], "anchors": [], "images": [], "sources": [], "media": [], "iframes": [], "scripts": [], "forms": 0, "title": None, "lang": "", "meta_charset": None, "error": ""}
    nav: set[int] = set()
    for node in root.elements():
        tag, a = node.tag, node.attrs
        if tag == "nav" or id(node.parent) in nav:
            nav.add(id(node))
        if tag == "title" and facts["title"] is None:
            facts["title"] = spaced(" ".join(s.strip() for s in node.strings() if s.strip()))
        elif tag == "html":
            facts["lang"] = a.get("lang", "").strip()
        elif tag == "meta":
            facts["metas"].append({"name": a.get("name", "").strip().lower(), "property": a.get("property", "").strip().lower(), "content": a.get("content", "").strip()})
            if "charset" in a and facts["meta_charset"] is None:
                facts["meta_charset"] = a["charset"].strip()
        elif tag == "link":
            href = a.get("href", "").strip()
            rels = a.get("rel", "").split()
            facts["links"].append({"rels": [r.lower() for r in rels], "stylesheet": "stylesheet" in rels, "type": a.get("type", "").lower(), "hreflang": a.get("hreflang", ""), "href": href, "url": absolute(base, href)})
        elif tag == "a" and a.get("href", "").strip():
            href = a["href"].strip()
            facts["anchors"].append({"href": href, "url": absolute(base, href), "in_nav": id(node) in nav})
        elif tag == "img":
            facts["images"].append({"alt": a.get("alt", "").strip(), "urls": _images(base, a)})
        elif tag == "source":
            url = absolute(base, _first_candidate((a.get("src") or a.get("srcset") or "").strip()))
            up = node.parent
            while up is not None and up.tag not in ("video", "audio", "picture"):
                up = up.parent
            if url:
                facts["sources"].append({"url": url, "parent": up.tag if up else ""})
        elif tag in ("video", "audio"):
            if url := absolute(base, a.get("src")):
                facts["media"].append(url)
        elif tag == "script":
            facts["scripts"].append({"src": a.get("src", ""), "url": absolute(base, a.get("src"))})
        elif tag == "iframe":
            facts["iframes"].append({"url": absolute(base, a.get("src") or a.get("data-src"))})
        elif tag == "form":
            facts["forms"] += 1
    facts["blocks"] = [{"tag": t, "text": x} for t, x in blocks(root)]
    facts["jsonld"] = _json_ld(root)
    og = next((m["content"] for m in facts["metas"] if m["property"] == "og:image"), "")
    icon = next((x["href"] for rel in ("icon", "apple-touch-icon") for x in [next((l for l in facts["links"] if rel in l["rels"]), {"href": ""})] if x["href"]), "")
    return facts | {"title": facts["title"] or "", "og_image_url": absolute(base, og), "favicon": icon, "favicon_url": absolute(base, icon)}
