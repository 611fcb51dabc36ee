"""A tolerant page tree, and what needs one: main content, cleaning, Markdown, links and selectors, in one parse a page.

The tree is built on the standard library's parser with rules of its own for void and self-closing elements. All outputs
of a page come from one Arrow-batched call; a page that can't be parsed gives an error in its row and stops nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators import html as html_functions

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag that opens closes an open one of these kinds, up to the nearest container.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table select body div article section main td th blockquote".split())
DROPPED = frozenset("script style iframe noscript comment".split())
CHROME = frozenset("nav footer header".split())
KEPT_ATTRS = frozenset("href src alt title class id role type rel target".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in DROPPED:
                todo.extend(reversed(x.children))
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def first(self, test) -> Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def drop(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = CLOSED_BY.get(tag, {"p"} if tag in BLOCKS else set())
        node = self.at
        while closes and node.parent and node.tag not in (SCOPES - closes):
            if node.tag in closes:
                self.at = node.parent
                if tag != "tr":
                    break
            node = node.parent
        new = Node(tag, {}, self.at)
        for k, v in attrs:  # the first of equal names counts
            new.attrs.setdefault(k, v or "")
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _whole_entities(html: str) -> str:
    """Ampersands that no whole entity follows, semicolon and all, as entities of their own: a cut `&amp` stays as it stands."""
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?", lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + (m[1] or ""), html)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(_whole_entities(html))
    builder.close()
    return builder.root


def main_content(root: Node, effective: bool = False) -> Node:
    """main, article, a div named so by id or class, a div of that role; else the longest div or section; else all.

    effective: only the last two, as the rules before them never match there.
    """
    named = lambda a: lambda n: n.tag == "div" and re.search("content|main|article", n.attrs.get(a, ""), re.I)
    tests = [lambda n: n.tag == "main", lambda n: n.tag == "article", named("id"), named("class"), lambda n: n.tag == "div" and n.attrs.get("role") == "main"]
    for test in [] if effective else tests:
        if found := root.first(test):
            return found
    boxes = [n for n in root.walk() if n.tag in ("div", "section")]
    return max(boxes, key=lambda n: len(n.text()), default=root)


def clean(root: Node, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Node:
    """Scripts, frames and page furniture go, but furniture that holds content stays; so do only plain attributes."""
    for node in list(root.walk()):
        furniture = node.tag in CHROME and not node.first(lambda n: n.tag in ("main", "article", "section"))
        if node.tag in DROPPED or furniture or node.tag in exclude:
            node.drop()
    if include:
        kept = [n for n in root.walk() if n.tag in include]
        root = Node("#root", {}, None)
        root.children = kept
    for node in root.walk():
        node.attrs = {k: v for k, v in node.attrs.items() if k in KEPT_ATTRS or k.startswith(("data-", "aria-"))}
    return root


def _escaped(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quote else text


def to_html(node: Node | str) -> str:
    if isinstance(node, str):
        return _escaped(node)
    inner = "".join(map(to_html, node.children))
    if node.tag == "#root":
        return inner
    attrs = "".join(f' {k}="{_escaped(v, True)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def _inline(node: Node) -> str:
    out = []
    for c in node.children:
        out.append(re.sub(r"\s+", " ", c) if isinstance(c, str) else _inline_tag(c))
    return "".join(out)


def _inline_tag(n: Node) -> str:
    if n.tag == "br":
        return "\n"
    if n.tag == "img":
        return _image(n)
    inner = _inline(n) if n.tag != "code" else n.text()
    mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}.get(n.tag)
    if mark and inner.strip():
        return f"{mark}{inner.strip()}{mark}"
    if n.tag == "a" and n.attrs.get("href") and inner.strip():
        return f"[{inner.strip()}]({n.attrs['href']})"
    return inner if n.tag not in DROPPED else ""


def _image(n: Node) -> str:
    src = n.attrs.get("src", "")
    title = n.attrs.get("title") or src.rsplit("/", 1)[-1].split("?")[0]
    return f'![{n.attrs.get("alt") or "Image"}]({src} "{title}")' if src else ""


def _table(n: Node) -> str:
    rows = [[re.sub(r"\s+", " ", _inline(c)).strip().replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    most = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (most - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * most) + " |", *lines[1:]])


def _list(n: Node, depth: int) -> str:
    lines, k = [], 0
    for item in (c for c in n.children if isinstance(c, Node)):
        if item.tag != "li":
            continue
        k += 1
        own, nested = Node("#item", {}, None), []
        for c in item.children:
            (nested if isinstance(c, Node) and c.tag in ("ul", "ol") else own.children).append(c)
        mark = f"{k}. " if n.tag == "ol" else "- "
        lines.append("    " * depth + mark + re.sub(r"\s+", " ", _inline(own)).strip())
        lines += [x for c in nested if (x := _list(c, depth + 1))]
    return "\n".join(lines)


def _blocks(node: Node, out: list[str]) -> None:
    run = Node("#run", {}, None)

    def flush() -> None:
        if text := re.sub(r" *\n *", "\n", _inline(run)).strip():
            out.append(text)
        run.children = []

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCKS and not c.first(lambda n: n.tag in BLOCKS):
            run.children.append(c)
            continue
        flush()
        if re.fullmatch("h[1-6]", c.tag):
            if text := re.sub(r"\s+", " ", _inline(c)).strip():
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag in ("ul", "ol"):
            out.append(_list(c, 0))
        elif c.tag == "pre":
            code = next((n for n in c.walk() if n.tag == "code"), c)
            language = re.search(r"language-([\w+-]+)", code.attrs.get("class", ""))
            raw = "".join(x for n in code.walk() for x in n.children if isinstance(x, str))
            out.append(f"```{language[1] if language else ''}\n{raw.strip(chr(10))}\n```")
        elif c.tag == "table":
            out.append(_table(c))
        elif c.tag == "hr":
            out.append("---")
        elif c.tag == "blockquote":
            inner: list[str] = []
            _blocks(c, inner)
            out.append("\n".join(("> " + x).rstrip() for x in "\n\n".join(inner).split("\n")))
        else:
            _blocks(c, out)
    flush()


def post_process(md: str) -> str:
    """The Markdown rules outside fences: comments and no-break blanks go, headers and items get a blank, lone marks go."""
    parts = re.split(r"(?ms)(^```.*?^```$)", md)
    for i in range(0, len(parts), 2):
        x = re.sub(r"(?s)<!--.*?-->", "", parts[i]).replace("&nbsp;", " ").replace("\u00a0", " ")
        x = re.sub(r"(?m)^(#{1,6})([^#\s])", r"\1 \2", x)
        x = re.sub(r"(?m)^(\s*)-([^\s-])", r"\1- \2", x)
        x = re.sub(r"(?m)[ \t]+$", "", x)
        parts[i] = re.sub(r"(?m)^[ \t]*[*.-][ \t]*$\n?", "", x)
    return re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()


def to_markdown(root: Node) -> str:
    out: list[str] = []
    _blocks(root, out)
    return post_process("\n\n".join(x for x in out if x))


#: Keys of page metadata and the name or property of the meta tag whose content they hold.
META_NAMES = {"description": "description", "viewport": "viewport", "authors": "author", "summary": "summary", "site-id": "site-id", "app-version": "app-version", "docs-boost": "docs-boost"}
#: Open graph names with keys of their own; all others get `og` and a capital, the rest in lower case.
OG_NAMES = {"title": "ogTitle", "description": "ogDescription", "image": "ogImage", "url": "ogUrl", "site_name": "ogSiteName", "locale": "ogLocale", "type": "og:type"}


def metadata(root: Node) -> dict[str, str]:
    """What a page says of itself. The first tag of a kind counts, of open graph and twitter names the last one with a content."""
    out: dict[str, str] = {}
    kinds: dict[str, list[Node]] = {"title": [], "meta": [], "link": [], "html": [], "time": [], "img": []}
    for node in root.walk():
        if (of_kind := kinds.get(node.tag)) is not None:
            of_kind.append(node)
    named: dict[tuple[str, str], Node] = {}
    for node in kinds["meta"]:
        for k in ("name", "property", "http-equiv"):
            if k in node.attrs:
                named.setdefault((k, node.attrs[k]), node)

    def put(key: str, node: Node | None, *names: str) -> None:
        if node is not None:
            out[key] = next((v for n in names if (v := node.attrs.get(n, "").strip())), "")

    first = lambda kind, test: next((n for n in kinds[kind] if test(n.attrs)), None)
    if kinds["title"]:
        out["title"] = kinds["title"][0].text()
    for key, name in META_NAMES.items():
        put(key, named.get(("name", name)), "content")
    for node in kinds["meta"]:
        content, og, card = node.attrs.get("content", "").strip(), node.attrs.get("property", ""), node.attrs.get("name", "")
        if content and og.startswith("og:") and len(og) > 3:
            out[OG_NAMES.get(og[3:], "og" + og[3:].capitalize())] = content
        if content and card.startswith("twitter:") and len(card) > 8:
            out[card] = content
    related = lambda rel: first("link", lambda a: rel in (r := a.get("rel", "")).split() or r == rel)
    put("canonical_url", related("canonical"), "href")
    put("favicon", related("icon") or related("shortcut icon"), "href")
    if kinds["html"] and kinds["html"][0].attrs.get("lang"):
        out["language"] = kinds["html"][0].attrs["lang"]
    put("charset", first("meta", lambda a: "charset" in a), "charset")
    put("contentType", named.get(("http-equiv", "content-type")), "content")
    either = lambda name: named.get(("property", name)) or named.get(("name", name))
    published = either("article:published_time") or first("time", lambda a: "datetime" in a)
    if published and (published.attrs.get("content") or published.attrs.get("datetime")):
        put("published_at", published, "content", "datetime")
    put("categories", either("article:section") or named.get(("property", "article:tag")), "content")
    put("author_images", first("img", lambda a: re.search("author|writer", a.get("alt", ""), re.I)), "src")
    put("fb:app_id", named.get(("property", "fb:app_id")), "content")
    return out


def metadata_map(html: Column) -> Column:
    """What pages say of themselves, as extract() has it in metadata, and nothing else of them; null where a page can't be parsed."""

    def told(page: str | None) -> tuple:
        try:
            return (metadata(parse(page or "")),)
        except Exception:  # noqa: BLE001  a page's failure is its row's result
            return (None,)

    return _of_pages("metadata map<string,string>", told)(html)["metadata"]


#: Selectors of the pages of bot protection, by system.
WALL_SELECTORS = {
    "cloudflare": ("#challenge-form", "#challenge-running", "div[class*='cf-browser-verification']", "#cf-challenge-running", ".cf-browser-verification", "#cf-challenge-stage", ".cf-checking-browser", ".cf-wrapper"),
    "datadome": ("[class*='datadome']", "[id*='datadome']", ".dd-challenge"),
    "incapsula": ("[class*='incap']", "[id*='incap']", ".incap-challenge"),
    "akamai": (),
    "generic_captcha": ("[class*='captcha']", "[class*='challenge']", "[class*='verification']", "[class*='security-check']", "iframe[src*='recaptcha']", "iframe[src*='hcaptcha']", ".g-recaptcha", ".h-captcha"),
}


def selected(root: Node, selector: str) -> bool:
    """Whether a page has an element for a selector: #id, .class, or tag[attribute*='part'] with the tag left out or not."""
    if selector[0] in "#.":
        name, want = ("id", {selector[1:]}) if selector[0] == "#" else ("class", set())
        return any((n.attrs.get(name) in want) if want else selector[1:] in n.attrs.get(name, "").split() for n in root.walk())
    tag, name, part = re.fullmatch(r"(\w*)\[(\w+)\*='([^']*)'\]", selector).groups()
    return any((not tag or n.tag == tag) and part in n.attrs.get(name, "") for n in root.walk())


def _of_pages(schema: str, of_page):
    """A function of page columns to structs of a schema, by of_page; only the pages go to Python, Arrow-batched."""
    names = [x.split()[0] for x in re.split(r", (?=\w+ )", schema)]

    @F.pandas_udf(schema)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of_page(x) for x in pages], columns=names, dtype=object)

    return run


def wall_selectors(html: Column) -> Column:
    """Map of system to the number of its selectors that are found."""

    def count(page: str | None) -> tuple:
        root = parse(page or "")
        return ({system: sum(selected(root, s) for s in wanted) for system, wanted in WALL_SELECTORS.items()},)

    return _of_pages("hits map<string,int>", count)(html)["hits"]


SCHEMA = "title string, main_html string, markdown string, links array<struct<href:string,text:string,rel:string>>, metadata map<string,string>, error string"


def extract(pages: DataFrame, html_col: str = "html", only_main: bool = True, effective: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """pages (without the html) with title, main_html, markdown, links of the whole page, metadata, and error."""

    def of_page(page: str | None) -> tuple:
        try:
            root = parse(page or "")
            title, told = root.first(lambda n: n.tag == "title"), metadata(root)
            links = [{"href": n.attrs.get("href", ""), "text": n.text(), "rel": n.attrs.get("rel", "")} for n in root.walk() if n.tag == "a"]
            body = root.first(lambda n: n.tag == "body") or root
            main = clean(main_content(root, effective) if only_main else body, include, exclude)
            return title.text() if title else "", to_html(main), to_markdown(main), [x for x in links if x["href"]], told, None
        except Exception as e:  # noqa: BLE001  a page's failure is its row's result
            return None, None, None, None, None, f"{type(e).__name__}: {e}"

    kept = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    found = pages.select(*kept, _of_pages(SCHEMA, of_page)(F.col(html_col)).alias("_found"))
    return found.select(*kept, "_found.*")


def records(pages: DataFrame, url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """Scrape results (page columns but the html; success, markdown, html, links, metadata, warning, structured_data).

    Metadata start from title, description and language (null), the address, status and error, and what the page says of
    itself is laid over them. links is null where there are none. A page that is null or can't be taken apart is a failure:
    status 500, its error as the warning, nothing else.
    """
    page = F.col(html_col)
    kept = [c for c in pages.columns if c != html_col]
    told = pages.select(*kept, page.alias("_page"), page.isNull().alias("_missing"), html_functions.structured_record(page).alias("structured_data"))
    found = extract(told, "_page", **how)
    error = F.coalesce(F.col("error"), F.when(F.col("_missing"), "no content"))
    good, none = error.isNull(), F.lit(None).cast("string")
    base = {"title": none, "description": none, "language": none, "sourceURL": F.col(url_col), "statusCode": F.when(good, "200").otherwise("500"), "error": error}
    base = F.create_map(*[x for k, v in base.items() for x in (F.lit(k), v)])
    own = F.when(good, F.col("metadata")).otherwise(F.create_map().cast("map<string,string>"))
    base = F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k))  # no key twice: by default sessions refuse that
    return found.select(
        *kept, good.alias("success"), F.when(good, F.col("markdown")).alias("markdown"), F.when(good, F.col("main_html")).alias("html"),
        F.when(good & (F.size("links") > 0), F.transform("links", lambda x: x["href"])).alias("links"),
        F.map_concat(base, own).alias("metadata"),
        error.alias("warning"), F.when(good, F.col("structured_data")).alias("structured_data"),
    )
