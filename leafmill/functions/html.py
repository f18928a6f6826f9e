"""HTML: a small tolerant tree, selectors, Markdown and back.

Parsing needs Python; every function takes a whole text and is wrapped in an
Arrow-batched UDF at the end of the module.  ``page_udf`` gives everything
that a page conversion needs from one parse.

Elements nested deeper than ``DEEPEST`` are kept, in order, as children of
their ancestor at that depth, as browsers do, so no text is too deep.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .url import resolve_one

_BLOCKS = set("p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li pre blockquote table hr figure body html form dl dt dd tr thead tbody".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": set("p h1 h2 h3 h4 h5 h6 ul ol div table pre blockquote section article".split()), "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Places where main content is looked for, in order (fixed values).
CONTENT_PLACES = ["main", "article", '[role="main"]', "#content", ".content", ".main-content", ".post-content", ".article-content", ".page-content", ".docs-content"]
LEAST_CONTENT = 100
# Where a page names its assets.
ASSETS = [("img[src]", "src"), ("link[rel='stylesheet'][href]", "href"), ("script[src]", "src")]
DEEPEST = 200


class Node:
    __slots__ = ("tag", "attrs", "kids", "start", "inner_start", "inner_end", "parent", "holder", "depth", "block")

    def __init__(self, tag, attrs, parent, start, inner):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.start, self.inner_start, self.inner_end = start, inner, None
        # the holder has the node among its children: the parent, or its ancestor at the greatest depth
        self.holder = parent if parent is None or parent.depth < DEEPEST else parent.holder
        self.depth = 0 if parent is None else self.holder.depth + 1
        self.block = False  # a block stands below


class _Builder(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.root = text, Node("", {}, None, 0, 0)
        self.at = self.root
        self.open = Counter()
        self.offsets = [0]
        for m in re.finditer("\n", text):
            self.offsets.append(m.end())

    def here(self) -> int:
        line, col = self.getpos()
        return self.offsets[line - 1] + col

    def handle_starttag(self, tag, attrs):
        while self.at.parent is not None and tag in _CLOSES.get(self.at.tag, ()):
            self._close(self.at, self.here())
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, self.here(), self.here() + len(self.get_starttag_text() or ""))
        node.holder.kids.append(node)
        if tag in _BLOCKS:
            up = node.holder
            while up is not None and not up.block:
                up.block, up = True, up.holder
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1
        else:
            node.inner_end = node.inner_start

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag:
            self._close(self.at, self.at.inner_start)

    def _close(self, node, end):
        while self.at is not node:
            self.at.inner_end = end
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        node.inner_end = end
        self.open[node.tag] -= 1
        self.at = node.parent

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self._close(node, self.here())

    def handle_data(self, data):
        self.at.kids.append(data)

    def handle_entityref(self, name):
        self.at.kids.append(_html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.at.kids.append(_html.unescape(f"&#{name};"))


def parse(text: str) -> Node:
    b = _Builder(text)
    try:
        b.feed(text)
        b.close()
    except (AssertionError, ValueError):
        pass
    while b.at is not None:
        b.at.inner_end = len(text)
        b.at = b.at.parent
    return b.root


def _all(node: Node):
    """Elements and strings below a node in document order."""
    todo = node.kids[::-1]
    while todo:
        k = todo.pop()
        yield k
        if isinstance(k, Node):
            todo += k.kids[::-1]


def walk(node: Node):
    return (k for k in _all(node) if isinstance(k, Node))


def text_of(node: Node) -> str:
    return "".join(k for k in _all(node) if isinstance(k, str))


_PART = re.compile(r"""([\w*-]+)?((?:\#[\w-]+|\.[\w-]+|\[[^\]]+\])*)$""")
_ATTR = re.compile(r"""\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|\#([\w-]+)|\.([\w-]+)""")


def _compile(selector: str):
    steps = []
    for part in re.sub(r"\s*>\s*", " >", selector.strip()).split():
        child = part.startswith(">")
        m = _PART.match(part[1:] if child else part)
        if not m or not (m[1] or m[2]):
            raise ValueError(selector)
        tests = []
        for a in _ATTR.finditer(m[2]):
            if a[6]:
                tests.append(("id", "=", a[6]))
            elif a[7]:
                tests.append(("class", "~=", a[7]))
            else:
                tests.append((a[1].lower(), a[2], next((x for x in (a[3], a[4], a[5]) if x is not None), None)))
        steps.append((child, (m[1] or "*").lower(), tests))
    if not steps:
        raise ValueError(selector)
    return steps


def _fits(node: Node, tag: str, tests) -> bool:
    if tag != "*" and node.tag != tag:
        return False
    for name, op, value in tests:
        have = node.attrs.get(name)
        if have is None or op == "=" and have != value or op == "~=" and value not in have.split() or op == "^=" and not have.startswith(value) or op == "$=" and not have.endswith(value) or op == "*=" and value not in have:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Nodes that match a selector (tag, #id, .class, [attr], descendants, children, comma lists) in document order; an invalid one matches nothing."""
    try:
        options = [_compile(s) for s in selector.split(",")]
    except ValueError:
        return []

    def up(node, steps):
        child, tag, tests = steps[-1]
        if not _fits(node, tag, tests):
            return False
        if len(steps) == 1:
            return True
        p = node.parent
        while p is not None and p.parent is not None:
            if up(p, steps[:-1]):
                return True
            if child:
                return False
            p = p.parent
        return False

    return [n for n in walk(root) if any(up(n, s) for s in options)]


def inner(node: Node, text: str) -> str:
    return text[node.inner_start : node.inner_end]


def _title(root: Node) -> str | None:
    found = select(root, "title")
    return text_of(found[0]).strip() if found else None


def title(text: str | None) -> str | None:
    return None if text is None else _title(parse(text))


def _links(root: Node, base: str | None) -> list[str]:
    out = (resolve_one(base, n.attrs["href"]) for n in select(root, "a[href]"))
    return [u for u in out if u]


def links(text: str | None, base: str | None) -> list[str]:
    """Absolute targets of all anchors in document order, repeats kept, unresolvable ones dropped."""
    return _links(parse(text or ""), base)


def _references(root: Node, base: str | None) -> list[tuple[Node, str, str]]:
    found = [(n, attr, resolve_one(base, n.attrs[attr])) for selector, attr in ASSETS for n in select(root, selector)]
    return [(n, attr, u) for n, attr, u in found if u]


def assets(text: str | None, base: str | None) -> list[str]:
    """Absolute urls of images, then stylesheets, then scripts."""
    return [u for _, _, u in _references(parse(text or ""), base)]


def _chosen(root: Node, text: str, selectors: list[str] | None) -> list[Node]:
    """Nodes of the chosen content; none where the whole page is taken."""
    if selectors:
        return [n for s in selectors for n in select(root, s)]
    for place in CONTENT_PLACES:
        found = select(root, place)
        if found and len(inner(found[0], text).strip().encode()) > LEAST_CONTENT:
            return found[:1]
    return []


def content(text: str | None, selectors: list[str] | None = None) -> str | None:
    """Chosen content: all matches of the selectors in their order, or the first usable place of CONTENT_PLACES; the whole page where there is none."""
    if text is None:
        return None
    nodes = _chosen(parse(text), text, selectors)
    return "\n\n".join(inner(n, text) for n in nodes) if nodes else text


def selected(text: str | None, selectors: list[str]) -> str | None:
    if text is None:
        return None
    root = parse(text)
    parts = [inner(n, text) for s in selectors for n in select(root, s)]
    return "\n\n".join(parts) or None


def rewrite_assets(text: str | None, base: str | None, local: dict[str, str]) -> str | None:
    """References of known assets replaced by local paths in double quotes; others, and those without quotes, are untouched."""
    if text is None:
        return None
    edits = {}
    for n, attr, u in _references(parse(text), base):
        to = local.get(u)
        at = re.compile(rf"""\s{attr}=(["']){re.escape(n.attrs[attr])}\1""", re.I).search(text, n.start, n.inner_start) if to is not None else None
        if at:
            edits[at.start() + 1] = (at.end(), f'{attr}="{to}"')
    out, done = [], 0
    for start in sorted(edits):
        out += [text[done:start], edits[start][1]]
        done = edits[start][0]
    return "".join([*out, text[done:]])


def _inline(node: Node) -> str:
    out = []
    for k in node.kids:
        if isinstance(k, str):
            out.append(re.sub(r"\s+", " ", k))
            continue
        t, s = k.tag, _inline(k)
        if t in ("script", "style", "template", "noscript", "head"):
            continue
        if t in ("strong", "b") and s.strip():
            s = f"**{s.strip()}**"
        elif t in ("em", "i") and s.strip():
            s = f"*{s.strip()}*"
        elif t == "code":
            s = f"`{text_of(k)}`"
        elif t == "a" and "href" in k.attrs:
            s = f"[{s.strip()}]({k.attrs['href']})"
        elif t == "img":
            s = f"![{k.attrs.get('alt', '')}]({k.attrs.get('src', '')})"
        elif t == "br":
            s = "\n"
        out.append(s)
    return "".join(out)


def _blocks(node: Node, depth: int = 0) -> list[str]:
    out: list[str] = []
    run = Node("", {}, None, 0, 0)

    def flush():
        s = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", _inline(run))).strip()
        if s:
            out.append(s)
        run.kids = []

    for k in node.kids:
        if isinstance(k, str) or k.tag not in _BLOCKS and not k.block:
            run.kids.append(k)
            continue
        flush()
        t = k.tag
        if t in ("script", "style", "head", "template"):
            continue
        if re.fullmatch("h[1-6]", t):
            s = re.sub(r"\s+", " ", _inline(k)).strip()
            if s:
                out.append("#" * int(t[1]) + " " + s)
        elif t == "pre":
            code = [n for n in walk(k) if n.tag == "code"]
            lang = re.search(r"(?:language|lang)-([\w+-]+)", code[0].attrs.get("class", "")) if code else None
            out.append(f"```{lang[1] if lang else ''}\n{text_of(k).strip(chr(10))}\n```")
        elif t in ("ul", "ol"):
            items = []
            for i, li in enumerate([n for n in k.kids if isinstance(n, Node) and n.tag == "li"], 1):
                parts = _blocks(li, depth + 1)
                mark = f"{i}. " if t == "ol" else "* "
                body = "\n".join(parts)
                items.append(mark + body.replace("\n", "\n" + " " * len(mark)))
            if items:
                out.append("\n".join(items))
        elif t == "blockquote":
            out.append("\n".join("> " + x if x else ">" for x in "\n\n".join(_blocks(k)).split("\n")))
        elif t == "table":
            rows = [[re.sub(r"\s+", " ", _inline(c)).strip().replace("|", r"\|") for c in r.kids if isinstance(c, Node) and c.tag in ("td", "th")] for r in walk(k) if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                w = max(map(len, rows))
                rows = [r + [""] * (w - len(r)) for r in rows]
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * w, *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        elif t == "hr":
            out.append("---")
        else:
            out += _blocks(k, depth)
    flush()
    return out


def _bare(text: str) -> str:
    """Without scripts, styles and empty links."""
    text = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", "", text)
    return re.sub(r'(?i)<a[^>]*href="[^"]*"[^>]*>\s*</a>', "", text)


def to_markdown(text: str | None) -> str | None:
    """Markdown of a page or fragment: headings, paragraphs, lists, quotes, tables, code, links and images; tags and comments go."""
    return None if text is None else "\n\n".join(_blocks(parse(_bare(text))))


def page(text: str | None, base: str | None, selectors: list[str] | None = None) -> tuple[str | None, list[str], list[str], str | None]:
    """(title, links, assets, Markdown of the chosen content) of a page; it is parsed again only where scripts, styles or empty links had to go."""
    if text is None:
        return None, [], [], None
    root, bare = parse(text), _bare(text)
    clean = root if bare == text else parse(bare)
    nodes = _chosen(clean, bare, selectors) or [clean]
    return _title(root), _links(root, base), [u for _, _, u in _references(root, base)], "\n\n".join(b for n in nodes for b in _blocks(n))


def _spans(s: str) -> str:
    keep: list[str] = []

    def hold(m):
        keep.append(f"<code>{_html.escape(m[1], quote=False)}</code>")
        return f"\0{len(keep) - 1}\0"

    s = _html.escape(re.sub(r"`([^`]+)`", hold, s), quote=False)
    s = re.sub(r"!\[([^\]]*)\]\(([^)\s]*)\)", r'<img src="\2" alt="\1" />', s)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]*)\)", r'<a href="\2">\1</a>', s)
    s = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", s)
    s = re.sub(r"\*(.+?)\*", r"<em>\1</em>", s)
    s = re.sub(r"~~(.+?)~~", r"<del>\1</del>", s)
    return re.sub("\0(\\d+)\0", lambda m: keep[int(m[1])], s)


def to_html(md: str | None) -> str | None:
    """HTML of Markdown: headings of both kinds, paragraphs, lists, quotes, rules, tables, fenced code and inline marks."""
    if md is None:
        return None
    rows, out, i = md.split("\n"), [], 0
    while i < len(rows):
        line = rows[i]
        s = line.strip()
        if not s:
            i += 1
        elif re.match(r"(```|~~~)", s):
            j = i + 1
            while j < len(rows) and not rows[j].strip().startswith(s[:3]):
                j += 1
            lang = s[3:].strip()
            out.append(f"<pre><code{f' class={chr(34)}language-{lang}{chr(34)}' if lang else ''}>" + _html.escape("\n".join(rows[i + 1 : j]) + "\n", quote=False) + "</code></pre>")
            i = j + 1
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", s):
            out.append(f"<h{len(m[1])}>{_spans(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.fullmatch(r"([-*_])(\s*\1){2,}", s):
            out.append("<hr />")
            i += 1
        elif s.startswith(">"):
            j = i
            while j < len(rows) and rows[j].strip().startswith(">"):
                j += 1
            out.append("<blockquote>\n" + to_html("\n".join(re.sub(r"^\s*> ?", "", r) for r in rows[i:j])) + "\n</blockquote>")
            i = j
        elif m := re.match(r"([-*+•]|\d+[.)])\s+", s):
            tag, j, items = ("ol" if m[1][0].isdigit() else "ul"), i, []
            while j < len(rows) and (n := re.match(r"\s*([-*+•]|\d+[.)])\s+(.*)", rows[j])):
                items.append(f"<li>{_spans(n[2])}</li>")
                j += 1
            out.append(f"<{tag}>\n" + "\n".join(items) + f"\n</{tag}>")
            i = j
        elif s.startswith("|") and i + 1 < len(rows) and re.fullmatch(r"\|?[\s:|-]+\|?", rows[i + 1].strip()) and "-" in rows[i + 1]:
            cells = lambda r: [c.strip() for c in r.strip().strip("|").split("|")]
            j = i + 2
            while j < len(rows) and rows[j].strip().startswith("|"):
                j += 1
            row = lambda r, t: "<tr>" + "".join(f"<{t}>{_spans(c)}</{t}>" for c in cells(r)) + "</tr>"
            out.append("<table>\n<thead>" + row(rows[i], "th") + "</thead>\n<tbody>" + "".join(row(r, "td") for r in rows[i + 2 : j]) + "</tbody>\n</table>")
            i = j
        else:
            j = i + 1
            while j < len(rows) and rows[j].strip() and not re.match(r"\s*([#>|]|```|~~~|[-*+•]\s|\d+[.)]\s)", rows[j]) and not re.fullmatch(r"\s*(=+|-+)\s*", rows[j]):
                j += 1
            body = " ".join(r.strip() for r in rows[i:j])
            if j < len(rows) and re.fullmatch(r"\s*(=+|-{2,})\s*", rows[j]):
                level = 1 if "=" in rows[j] else 2
                out.append(f"<h{level}>{_spans(body)}</h{level}>")
                j += 1
            else:
                out.append(f"<p>{_spans(body)}</p>")
            i = j
    return "\n".join(out)


# Fixed value: the page around converted Markdown in exports.
PAGE = """<!DOCTYPE html>
<html>
<head><meta charset="utf-8"><style>
body { font-family: -apple-system, BlinkMacSystemFont, 'Segoe UI', sans-serif; max-width: 800px; margin: 0 auto; padding: 2rem; line-height: 1.6; color: #1a1a1a; }
pre { background: #f5f5f5; padding: 1rem; overflow-x: auto; border-radius: 4px; }
code { background: #f5f5f5; padding: 0.2em 0.4em; border-radius: 3px; font-size: 0.9em; }
pre code { background: none; padding: 0; }
h1, h2, h3 { margin-top: 1.5em; }
hr { border: none; border-top: 1px solid #ddd; margin: 2rem 0; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #ddd; padding: 8px; text-align: left; }
th { background: #f5f5f5; }
</style></head>
<body>{body}</body>
</html>"""


def page_of(md: str | None) -> str | None:
    """A whole page of a Markdown text."""
    return None if md is None else PAGE.replace("{body}", to_html(md) + "\n")


#: Tags and schemes that a preview may show (fixed values).
PREVIEW_TAGS = ["p", "h1", "h2", "h3", "h4", "strong", "em", "code", "pre", "a", "ul", "ol", "li", "blockquote", "hr", "div", "mark"]
PREVIEW_URL = re.compile(r"https?:", re.I)
_MARKS = [(re.compile(r"\*\*\*(.+?)\*\*\*"), "strong em"), (re.compile(r"\*\*(.+?)\*\*"), "strong"), (re.compile(r"\*(.+?)\*"), "em"), (re.compile(r"__(.+?)__"), "strong"), (re.compile(r"(?<!\w)_(.+?)_(?!\w)"), "em")]


def _preview_inline(text: str) -> str:
    """Inline marks of escaped text; code is set aside first, links to other schemes keep their words only."""
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\0{len(held) - 1}\0"

    text = re.sub(r"`([^`]+)`", lambda m: hold(f"<code>{m[1]}</code>"), text)
    text = re.sub(r"\[([^\]]+)\]\(([^)]+)\)", lambda m: hold(f'<a href="{m[2].replace(chr(34), "&quot;")}" target="_blank" rel="noopener">') + m[1] + hold("</a>") if PREVIEW_URL.match(m[2]) else m[1], text)
    for pattern, tags in _MARKS:
        opened, closed = "".join(f"<{t}>" for t in tags.split()), "".join(f"</{t}>" for t in reversed(tags.split()))
        text = pattern.sub(lambda m, a=opened, z=closed: a + m[1] + z, text)
    while "\0" in text:
        text = re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], text)
    return text


def preview_html(md: str | None) -> str | None:
    """Safe HTML of Markdown for a preview: everything is escaped, and only PREVIEW_TAGS and web links come out."""
    if md is None:
        return None
    out: list[str] = []
    group, items = "", []

    def close() -> None:
        nonlocal group
        if group:
            out.append(f"<{group}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{group}>")
            group = ""
            items.clear()

    rows = iter(_html.escape(md.replace("\0", ""), quote=False).split("\n"))
    for row in rows:
        if row.startswith("```"):
            close()
            code = []
            for row in rows:
                if row.startswith("```"):
                    break
                code.append(row)
            out.append("<pre><code>" + "\n".join(code).strip() + "</code></pre>")
        elif m := re.match(r"\s*(?:[-*]|(\d+)\.) (.*)", row):
            kind = "ol" if m[1] else "ul"
            if group != kind:
                close()
                group = kind
            items.append(_preview_inline(m[2]))
        else:
            close()
            if m := re.match(r"(#{1,4}) (.*)", row):
                out.append(f"<h{len(m[1])}>{_preview_inline(m[2])}</h{len(m[1])}>")
            elif row.startswith("&gt; "):
                out.append(f"<blockquote>{_preview_inline(row[5:])}</blockquote>")
            elif row == "---":
                out.append("<hr>")
            elif row.strip():
                out.append(f"<p>{_preview_inline(row)}</p>")
            else:
                out.append("<div></div>")
    close()
    return "\n".join(out)


def _texts(f):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(a) for a in s], dtype=object)

    return run


title_udf, to_markdown_udf, to_html_udf, page_of_udf, preview_udf = map(_texts, (title, to_markdown, to_html, page_of, preview_html))


def _lists(f):
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([f(a, b) for a, b in zip(s, base)], dtype=object)

    return run


links_udf, assets_udf = _lists(links), _lists(assets)


def content_udf(selectors: list[str] | None = None):
    return _texts(lambda a: content(a, selectors))


def selected_udf(selectors: list[str]):
    return _texts(lambda a: selected(a, selectors))


def page_udf(selectors: list[str] | None = None):
    """``page`` of each (text, url) as a struct (title, links, assets, markdown)."""

    @F.pandas_udf("title string, links array<string>, assets array<string>, markdown string")
    def run(s: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(a, b, selectors) for a, b in zip(s, base)], columns=["title", "links", "assets", "markdown"])

    return run


@F.pandas_udf(StringType())
def rewrite_udf(s: pd.Series, base: pd.Series, local: pd.Series) -> pd.Series:
    return pd.Series([rewrite_assets(a, b, dict(m or {})) for a, b, m in zip(s, base, local)], dtype=object)
