"""HTML to records: text, links, metadata, markdown, code, JSON-LD; typed views of articles and products.

Each page is parsed once, in Arrow batches, by a tolerant parser that builds a small tree (raw text in
script and style, implied ends of p and li, unclosed tags closed at the end). What an expression can say
(titles, links, languages of well-formed heads) also has built-in forms in operators.pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript"}
WORDS_A_MINUTE, LEAST_ARTICLE, TITLE_BYTES, PREVIEW = 200, 500, 100, 500

SCHEMA = (
    "title string, text string, markdown string, links array<string>, images array<string>, description string, keywords array<string>, author string, "
    "published_date string, modified_date string, language string, open_graph map<string,string>, twitter_card map<string,string>, "
    "code_blocks array<struct<language:string,content:string,line_count:int>>, structured_data map<string,string>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order, without recursion (pages may nest deeply)."""
        waiting: list[Node] = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]

    def pieces(self, skip: frozenset[str] | set[str] = frozenset()) -> list[str]:
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in skip:
                waiting += reversed(x.children)
        return out


class _Builder(HTMLParser):
    #: Tags whose start ends an open one of the set.
    ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "pre": {"p"}, "table": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "article": {"p"}}
    #: Where the search for an open tag to end stops.
    WALLS = {"ul", "ol", "table", "div", "article", "section", "body"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.ENDS:
            node: Node | None = self.at
            while node is not None and node.tag not in self.WALLS:
                if node.tag in self.ENDS[tag]:
                    self.at = node.parent or self.root
                    break
                node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def title_from(text: str) -> str:
    """The first line, cut to 97 characters and dots if it has more than 100 bytes; Untitled if there is none."""
    first = text.split("\n", 1)[0].strip()
    if not first:
        return "Untitled"
    return first[: TITLE_BYTES - 3] + "..." if len(first.encode()) > TITLE_BYTES else first


def select(root: Node, css: str) -> list[Node]:
    """Nodes that a small CSS subset names: tags, [attr], [attr=value], [attr^=value], .class, #id and descendants."""
    found = [root]
    for step in css.split():
        tag = re.match(r"[a-zA-Z][a-zA-Z0-9]*|\*", step)
        tests = re.findall(r"\[([\w:-]+)(?:(\^?=)[\"']?([^\"'\]]*)[\"']?)?\]", step)
        tests += [("class", "~", c) for c in re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", step))] + [("id", "=", c) for c in re.findall(r"#([\w-]+)", re.sub(r"\[.*?\]", "", step))]
        name = tag[0].lower() if tag and tag[0] != "*" else None

        def fits(n: Node, name: str | None = name, tests: list = tests) -> bool:
            if name and n.tag != name:
                return False
            for a, op, v in tests:
                have = n.attrs.get(a)
                if have is None or (op == "=" and have != v) or (op == "^=" and not have.startswith(v)) or (op == "~" and v not in have.split()):
                    return False
            return True

        seen: dict[int, Node] = {}
        for top in found:
            for n in top.walk():
                if n is not top and fits(n):
                    seen.setdefault(id(n), n)
        found = list(seen.values())
    return found


INLINE = {"strong", "b", "em", "i", "code", "a", "br", "span"}


def _marked(node: Node, inner: str) -> str:
    word = inner.strip()
    if not word:
        return inner
    if node.tag in ("strong", "b"):
        return f"**{word}**"
    if node.tag in ("em", "i"):
        return f"*{word}*"
    if node.tag == "code":
        return f"`{word}`"
    return f"[{word}]({node.attrs.get('href', '')})" if node.tag == "a" else inner


def _inline(children: list[Node | str]) -> str:
    """Text of children with emphasis, code and links marked, however deeply they nest."""
    open_nodes: list[tuple[Node | None, Iterator, list[str]]] = [(None, iter(children), [])]
    while True:
        node, rest, parts = open_nodes[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag not in SKIPPED:
                open_nodes.append((c, iter(c.children), []))
                break
        else:
            open_nodes.pop()
            if node is None:
                return "".join(parts)
            open_nodes[-1][2].append(_marked(node, "".join(parts)))


def _items(top: Node) -> list[str]:
    """Lines of a list and of those inside its items."""
    is_list = lambda x: isinstance(x, Node) and x.tag in ("ul", "ol")
    lines, open_lists = [], [(iter(top.children), 0)]
    while open_lists:
        rest, depth = open_lists[-1]
        for li in rest:
            if isinstance(li, Node) and li.tag == "li":
                lines.append("  " * min(depth, 20) + "- " + _inline([x for x in li.children if not is_list(x)]).strip())
                nested = [x for x in li.children if is_list(x)]
                if nested:
                    open_lists += [(iter(x.children), depth + 1) for x in reversed(nested)]
                    break
        else:
            open_lists.pop()
    return lines


def markdown(root: Node) -> str:
    """Headings, paragraphs, emphasis, code, links and lists; other tags only pass their content on. Depth has no limit."""
    out: list[str] = []

    def flush(held: list[Node | str]) -> None:
        text = _inline(held).strip()
        if text:
            out.append(text)
        held.clear()

    open_blocks: list[tuple[Iterator, list[Node | str]]] = [(iter(root.children), [])]
    while open_blocks:
        rest, held = open_blocks[-1]
        for c in rest:
            if isinstance(c, str) or c.tag in INLINE:
                held.append(c)
                continue
            flush(held)
            if c.tag in SKIPPED or c.tag in ("head", "title"):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                text = _inline(c.children).strip()
                if text:
                    out.append("#" * int(c.tag[1]) + " " + text)
            elif c.tag == "pre":
                text = "".join(c.pieces()).strip("\n")
                out.append(f"```\n{text}\n```")
            elif c.tag in ("ul", "ol"):
                lines = _items(c)
                if lines:
                    out.append("\n".join(lines))
            else:
                open_blocks.append((iter(c.children), []))
                break
        else:
            flush(held)
            open_blocks.pop()
    return "\n\n".join(out)


def _links(nodes: list[Node], url: str | None) -> list[str]:
    links = []
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs:
            try:
                to = urljoin(url or "", n.attrs["href"].strip())
                if urlsplit(to).scheme:
                    links.append(to)
            except ValueError:
                continue
    return links


def _code(root: Node) -> list[dict]:
    found = (c for n in select(root, "pre code") if (c := "".join(n.pieces()).strip()))
    return [{"language": None, "content": code, "line_count": len(code.splitlines())} for code in found]


def _json_ld(nodes: list[Node]) -> dict[str, str]:
    data = {}
    for i, n in enumerate(x for x in nodes if x.tag == "script" and x.attrs.get("type") == "application/ld+json"):
        try:
            data[f"json_ld_{i}"] = json.dumps(json.loads("".join(n.pieces())), ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser takes
            continue
    return data


def extract(html: str | None, url: str | None, only: frozenset[str] | None = None) -> dict:
    """The record of one page, or the named fields of it; a null page gives an empty one with the title Untitled."""
    root = parse(html or "")
    nodes = list(root.walk())
    metas = [n.attrs for n in nodes if n.tag == "meta"]
    named = {a["name"].lower(): a["content"] for a in metas if a.get("name") and "content" in a}
    graph = {a["property"]: a["content"] for a in metas if not a.get("name") and a.get("property", "").startswith("og:") and "content" in a}
    props = {a["property"]: a["content"] for a in metas if a.get("property") and "content" in a}
    titles = lambda: [t for n in nodes if n.tag == "title" and (t := squeeze(n.pieces()))]
    text = lambda: squeeze(root.pieces(SKIPPED))
    made = {
        "title": lambda: graph.get("og:title") or (titles() or [None])[-1] or title_from(text()),
        "text": text,
        "markdown": lambda: markdown(root),
        "links": lambda: _links(nodes, url),
        "images": lambda: [n.attrs["src"] for n in nodes if n.tag == "img" and "src" in n.attrs],
        "description": lambda: named.get("description"),
        "keywords": lambda: [k for x in named.get("keywords", "").split(",") if (k := x.strip())],
        "author": lambda: named.get("author"),
        "published_date": lambda: props.get("article:published_time") or next((t for n in nodes if n.tag == "time" and "pubdate" in n.attrs and (t := n.attrs.get("datetime"))), None),
        "modified_date": lambda: props.get("article:modified_time"),
        "language": lambda: next((n.attrs["lang"] for n in nodes if n.tag == "html" and n.attrs.get("lang")), None) or named.get("language"),
        "open_graph": lambda: graph,
        "twitter_card": lambda: {k: v for k, v in named.items() if k.startswith("twitter:")},
        "code_blocks": lambda: _code(root),
        "structured_data": lambda: _json_ld(nodes),
    }
    return {k: f() for k, f in made.items() if only is None or k in only}


def extracted(pages: DataFrame, html: str = "html", url: str = "url", fields: tuple[str, ...] | None = None) -> DataFrame:
    """pages without html, with the columns of SCHEMA or the named ones of them; each page is parsed once."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in pages.columns if c != html]
    made_as = T.StructType([f for f in T._parse_datatype_string(SCHEMA).fields if fields is None or f.name in fields])
    schema = T.StructType([*(pages.schema[c] for c in kept), *made_as.fields])
    arrow, only = to_arrow_schema(made_as), None if fields is None else frozenset(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = [extract(h, u, only) for h, u in zip(part.column(0).to_pylist(), part.column(1 + kept.index(url)).to_pylist(), strict=True)]
                made = [pa.array([list(r[f.name].items()) if isinstance(r[f.name], dict) else r[f.name] for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=schema.names)

    return pages.select(html, *kept).mapInArrow(run, schema)


def articles(records: DataFrame) -> DataFrame:
    """Records of at least 500 bytes of text as articles."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    kept = records.filter(F.octet_length("text") >= LEAST_ARTICLE)
    return kept.select(
        *[c for c in ("page_id", "url") if c in records.columns],
        F.coalesce(F.try_element_at("open_graph", F.lit("og:title")), "title").alias("headline"),
        F.coalesce("author", F.try_element_at("open_graph", F.lit("og:article:author"))).alias("author"),
        "published_date",
        words.alias("word_count"),
        F.greatest(F.lit(1), F.floor(words / WORDS_A_MINUTE).cast("int")).alias("reading_time"),
        F.col("keywords").alias("tags"),
        F.col("text").alias("content"),
    )


def products(records: DataFrame) -> DataFrame:
    """One product a record: from JSON-LD of type Product, else from og:type product."""
    ld = F.filter(F.map_values("structured_data"), lambda j: F.get_json_object(j, "$['@type']") == "Product")
    first = F.get(ld, 0)
    at = lambda path: F.get_json_object(first, path)
    og = lambda k: F.try_element_at("open_graph", F.lit(k))
    number = lambda c: c.try_cast("double")
    is_ld = first.isNotNull()
    kept = records.filter(is_ld | (og("og:type") == "product"))
    pick: Column = lambda a, b: F.when(is_ld, a).otherwise(b)
    return kept.select(
        *[c for c in ("page_id", "url") if c in records.columns],
        pick(at("$.name"), F.coalesce(og("og:title"), "title")).alias("name"),
        pick(at("$.description"), og("og:description")).alias("description"),
        pick(number(at("$.offers.price")), number(og("og:price:amount"))).alias("price"),
        pick(at("$.offers.priceCurrency"), og("og:price:currency")).alias("currency"),
        pick(at("$.offers.availability"), og("og:availability")).alias("availability"),
        pick(F.coalesce(at("$.brand.name"), at("$.brand")), og("og:brand")).alias("brand"),
        pick(number(at("$.aggregateRating.ratingValue")), F.lit(None).cast("double")).alias("rating"),
    )


def fenced_blocks(text: str | None) -> list[str]:
    """Contents of closed ``` fences, trimmed; an open one at the end is dropped."""
    out, held = [], None
    for line in (text or "").split("\n"):
        if line.startswith("```"):
            if held is None:
                held = []
            else:
                block = "\n".join(held).strip()
                if block:
                    out.append(block)
                held = None
        elif held is not None:
            held.append(line)
    return out


def fenced(text: Column | str) -> Column:
    """The same with built-in functions: of the parts between fence lines, every second one that a later fence closes."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text) if isinstance(text, str) else text, F.lit("\n")), r"(?m)^```[^\n]*\n?")
    inner = F.filter(parts, lambda p, i: (i % 2 == 1) & (i < F.size(parts) - 1))
    return F.filter(F.transform(inner, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def recipes(records: DataFrame) -> DataFrame:
    """One recipe for each JSON-LD record of type Recipe: an example of a view of one's own over extracted records."""
    each = records.select(*[c for c in ("page_id", "url") if c in records.columns], F.explode(F.map_values("structured_data")).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    steps = F.from_json(at("$.recipeIngredient"), "array<string>")
    return each.filter(at("$['@type']") == "Recipe").select(*[c for c in ("page_id", "url") if c in records.columns], at("$.name").alias("name"), steps.alias("ingredients"), at("$.totalTime").alias("total_time"))


def has_fence(text: Column | str) -> Column:
    """Whether a text has a line that opens a fence; false for null."""
    return F.coalesce(F.regexp_like(F.col(text) if isinstance(text, str) else text, F.lit(r"(?m)^```")), F.lit(False))
