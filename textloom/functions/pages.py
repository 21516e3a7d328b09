"""Reading web pages: text, links, label maps, tables, lists and sections, by the standard HTML parser."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: Elements inside one another.
MAX_DEPTH = 256
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


def cleaned(text: str) -> str:
    """Composed form; runs of blanks to one, of three and more line ends to two; the marker if nothing is left."""
    text = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip() or fixed.MISSING


class Node:
    """An element: its tag, attributes and children (elements and texts)."""

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []

    def parts(self) -> Iterator[Node | str]:
        """This element and all elements and texts in it, in the order of the page."""
        ahead: list[Node | str] = [self]
        while ahead:
            part = ahead.pop()
            yield part
            if isinstance(part, Node):
                ahead += reversed(part.children)

    def walk(self) -> Iterator[Node]:
        return (p for p in self.parts() if isinstance(p, Node))

    def all(self, *tags: str) -> list[Node]:
        found: list[Node] = []
        ahead: list[Node | str] = [self]
        while ahead:
            part = ahead.pop()
            if part.__class__ is not str:
                if part.tag in tags:
                    found.append(part)
                ahead += part.children[::-1]
        return found

    def texts(self) -> list[str]:
        found: list[str] = []
        ahead: list[Node | str] = [self]
        while ahead:
            part = ahead.pop()
            if part.__class__ is not str:
                ahead += part.children[::-1]
            elif text := part.strip():
                found.append(text)
        return found

    def text(self) -> str:
        return cleaned(" ".join(self.texts()))

    @classmethod
    def around(cls, node: Node) -> Node:
        """A tree of this node alone."""
        root = cls("", {})
        root.children = [node]
        return root


class _Open(list):
    """A stack of tags, or of elements, that knows which tags are in it."""

    def __init__(self):
        super().__init__()
        self.tags: Counter[str] = Counter()

    def push(self, item: Node | str) -> None:
        self.append(item)
        self.tags[self._tag(item)] += 1

    def pop_to(self, tag: str) -> None:
        """Takes everything off down to the last one of this tag; nothing if there is none."""
        while self.tags[tag]:
            found = self._tag(self.pop())
            self.tags[found] -= 1
            if found == tag:
                return

    @staticmethod
    def _tag(item: Node | str) -> str:
        return item.tag if isinstance(item, Node) else item


class _Links(HTMLParser):
    """All links of a page, those in navigation too: href, text, rel and class."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            at = dict(attrs)
            # A link without an address ends the one before and is none itself.
            self.inside = at.get("href") is not None
            if self.inside:
                self.found.append({"href": at["href"].strip(), "text": "", "rel": at.get("rel") or "", "class": at.get("class") or ""})

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1]["text"] += data.strip()


class _Builder(HTMLParser):
    """Builds the tree; noise is left out. Tags that are never closed end with their parents. Elements that are nested
    deeper than MAX_DEPTH become children of the one at that depth, as in browsers, so no text is lost."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = _Open()
        self.skipped = _Open()

    @property
    def last(self) -> Node:
        return self.open[-1] if self.open else self.root

    @property
    def parent(self) -> Node:
        """Where the next element goes."""
        return self.open[MAX_DEPTH - 1] if len(self.open) >= MAX_DEPTH else self.last

    def handle_starttag(self, tag, attrs):
        if self.skipped or tag in fixed.NOISE_TAGS:
            if tag not in VOID:
                self.skipped.push(tag)
            return
        if tag in ("p", "li") and self.last.tag == tag:
            self.open.pop_to(tag)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.parent.children.append(node)
        if tag not in VOID:
            self.open.push(node)

    def handle_endtag(self, tag):
        (self.skipped or self.open).pop_to(tag)

    def handle_data(self, data):
        if self.skipped:
            return
        last, parent = self.last, self.parent
        # After an element that became a sibling, text of the one around it goes behind it.
        behind = last is not parent and parent.children[-1] is not last
        (parent if behind else last).children.append(data)


#: A plain tag (small letters, quoted attributes without references) or text.
_PLAIN = re.compile(r"""<(/?)([a-z][a-z0-9]*)((?: [a-z]+=(?:'[^'<>&]*'|"[^"<>&]*"))*)>|([^<>]+)""")
_ATTRIBUTE = re.compile(r"""([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
#: Elements whose content is no markup: those that are left out, and those that the standard parser has to read.
_RAW, _OTHER_RAW = {"script", "style", "iframe", "noscript"}, {"title", "textarea", "xmp", "plaintext", "noembed", "noframes"}


def _built_plainly(html: str) -> Node | None:
    """The tree of a page of plain tags and texts only, else null. The standard parser makes the same one, but takes several times as long."""
    builder = _Builder()
    at, raw = 0, None
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        close, tag, attributes, text = m.groups()
        if text is not None:
            builder.handle_data(unescape(text) if "&" in text else text)
        elif close:
            if attributes or (raw and tag != raw):
                return None
            raw = None
            builder.handle_endtag(tag)
        elif raw or tag in _OTHER_RAW:
            return None
        else:
            raw = tag if tag in _RAW else None
            builder.handle_starttag(tag, [(k, x or y) for k, x, y in _ATTRIBUTE.findall(attributes)] if attributes else ())
    return builder.root if at == len(html) and not raw else None


def parsed(html: str | None) -> Node:
    html = html or ""
    root = _built_plainly(html)
    if root is not None:
        return root
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def labels(root: Node) -> dict[str, str]:
    """Label and value pairs: dt/dd, and table rows of a th and a td. A label's closing colon is dropped."""
    found: dict[str, str] = {}
    for dl in root.all("dl"):
        label = None
        for child in dl.children:
            if isinstance(child, Node) and child.tag == "dt":
                label = child.text().rstrip(":").strip()
            elif isinstance(child, Node) and child.tag == "dd" and label:
                found[label] = child.text()
    for row in root.all("tr"):
        heads, cells = row.all("th"), row.all("td")
        if len(heads) == 1 and len(cells) == 1:
            found[heads[0].text().rstrip(":").strip()] = cells[0].text()
    return found


def headed_sections(root: Node) -> dict[str, str]:
    """Heading to the text up to the next heading."""
    found: dict[str, list[str]] = {}
    at = None
    ahead = list(reversed(root.children))
    while ahead:
        part = ahead.pop()
        if isinstance(part, str):
            if at is not None and part.strip():
                found[at].append(part.strip())
        elif part.tag in ("h2", "h3"):
            at = part.text()
            found.setdefault(at, [])
        else:
            ahead += reversed(part.children)
    return {k: cleaned(" ".join(v)) for k, v in found.items()}


#: A table: the texts of each header cell, and those of each cell of every line.
Table = tuple[list[list[str]], list[list[list[str]]]]


def tables(root: Node) -> list[Table]:
    """All tables, the headers of which are a first line of th alone."""
    found = []
    for table in root.all("table"):
        lines = table.all("tr")
        heads = [c.texts() for c in lines[0].all("th")] if lines and not lines[0].all("td") else []
        found.append((heads, [[c.texts() for c in line.all("td")] for line in lines[1 if heads else 0 :]]))
    return found


_NOTHING = frozenset((fixed.MISSING,))


def named_rows(heads: list[str], lines: list[list[str]]) -> Iterator[dict[str, str]]:
    """Rows by their headers, or by number without headers; rows of missing values are left out."""
    for cells in lines:
        names = heads if len(heads) >= len(cells) else [str(k) for k in range(len(cells))]
        row = dict(zip(names, cells))  # noqa: B905
        if not _NOTHING.issuperset(row.values()):
            yield row


def table_rows(root: Node) -> list[dict[str, str]]:
    """The named rows of all tables."""
    text = lambda cell: cleaned(" ".join(cell))
    return [row for heads, lines in tables(root) for row in named_rows([text(c) for c in heads], [[text(c) for c in line] for line in lines])]


#: The inside of a plain tag, as above; an end tag's name has the slash.
_NAME = re.compile(r"""(/[a-z][a-z0-9]*\Z|[a-z][a-z0-9]*)(?: [a-z]+=(?:'[^'<>&]*'|"[^"<>&]*"))*""")
#: How many tags, forms of pages and short texts a task keeps, and the tags of the longest form; they bound its memory.
TAGS, FORMS, FORM_TAGS, TEXTS, SHORT = 4096, 128, 2048, 1024, 64


@lru_cache(TAGS)
def _tag_name(inside: str) -> str | None:
    m = _NAME.fullmatch(inside) if len(inside) <= FORM_TAGS else None
    return m and m[1]


@lru_cache(FORMS)
def _table_places(tags: tuple[str | None, ...]) -> list[Table] | None:
    """The tables of all pages of plain tags with these names, with places instead of texts (texts have even places, tags odd ones); null where
    the standard parser has to read. What is in a table goes by the tags alone, so pages of one form are read once."""
    builder, raw = _Builder(), None
    for place, tag in enumerate(tags):
        builder.handle_data(str(place))
        if tag is None:
            return None
        if tag[0] == "/":
            if raw and tag[1:] != raw:
                return None
            raw = None
            builder.handle_endtag(tag[1:])
        elif raw or tag in _OTHER_RAW:
            return None
        else:
            raw = tag if tag in _RAW else None
            builder.handle_starttag(tag, ())
        # Where elements become siblings, it matters which texts there are.
        if len(builder.open) > MAX_DEPTH:
            return None
    builder.handle_data(str(len(tags)))
    places = lambda cells: [[2 * int(k) for k in c] for c in cells]
    return None if raw else [(places(heads), [places(line) for line in lines]) for heads, lines in tables(builder.root)]


@lru_cache(TEXTS)
def _short(piece: str) -> str:
    return cleaned(unescape(piece[1:]).strip())


def page_table_rows(html: str | None) -> list[dict[str, str]]:
    """table_rows(parsed(html)), for pages of plain tags by their form."""
    # Texts, all but the first behind a mark, and the insides of tags by turns. If there are as many marks as tags and no tag
    # begins with one, every bracket is that of a tag.
    pieces = (html or "").replace(">", "<>").split("<")
    n = len(pieces) // 2
    if n > FORM_TAGS or len(pieces) % 2 == 0 or html is None or html.count(">") != n:
        return table_rows(parsed(html))
    found = _table_places(tuple(map(_tag_name, pieces[1::2])))
    if found is None:
        return table_rows(parsed(html))

    def text(places: list[int]) -> str:
        there = [piece for k in places if (piece := pieces[k]) != ">"]
        if len(there) == 1 and len(there[0]) <= SHORT:
            only = there[0][1:]
            return only if only.isalnum() and only.isascii() else _short(there[0])
        return cleaned(" ".join(t for piece in there if (t := unescape(piece[1:]).strip())))

    return [row for heads, lines in found for row in named_rows([text(c) for c in heads], [[text(c) for c in line] for line in lines])]


def list_items(root: Node) -> list[str]:
    return [t for t in (li.text() for li in root.all("li")) if t != fixed.MISSING]


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    """The text without noise."""
    return html.map(lambda h: parsed(h).text())


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def page_labels(html: pd.Series) -> pd.Series:
    return html.map(lambda h: labels(parsed(h)))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def page_sections(html: pd.Series) -> pd.Series:
    return html.map(lambda h: headed_sections(parsed(h)))


@F.arrow_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def page_tables(html: pa.Array) -> pa.Array:
    """The named rows of each page's tables."""
    keys, values, row_ends, page_ends = [], [], [0], [0]
    for page in html.to_pylist():
        for row in page_table_rows(page):
            keys += row
            values += row.values()
            row_ends.append(len(keys))
        page_ends.append(len(row_ends) - 1)
    text = lambda x: pa.array(x, pa.string())
    return pa.ListArray.from_arrays(pa.array(page_ends, pa.int32()), pa.MapArray.from_arrays(pa.array(row_ends, pa.int32()), text(keys), text(values)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_list_items(html: pd.Series) -> pd.Series:
    return html.map(lambda h: list_items(parsed(h)))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """The composed form, blanks collapsed, and the marker for nothing."""
    return text.map(lambda t: cleaned(t or ""))


@F.pandas_udf(T.StringType())
def joined_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", x or "") for b, x in zip(base, link, strict=True)])


def next_address(html: str | None, url: str) -> str | None:
    """Where the first link that leads to the next page leads, made absolute and without its fragment; links to the
    page itself lead nowhere."""
    links = _Links()
    links.feed(html or "")
    links.close()
    for link in links.found:
        text, style = link["text"].lower(), link["class"].lower()
        leads = "next" in link["rel"] or any(w in text for w in fixed.NEXT_WORDS) or text in fixed.NEXT_MARKS
        if leads or any(w in style for w in fixed.NEXT_CLASSES):
            target = urldefrag(urljoin(url, link["href"])).url
            if target != url:
                return target
    return None


@F.pandas_udf(T.StringType())
def following(html: pd.Series, url: pd.Series) -> pd.Series:
    """The address of the page after this one; null if there is none."""
    return pd.Series([next_address(h, u or "") for h, u in zip(html, url, strict=True)])


#: A link's start tag, its attributes in any order, and its target in either kind of quotes or none.
LINK = r"""(?is)<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def page_links(html: Column) -> Column:
    """The targets of all links, as they are written, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: F.trim(F.trim(x, F.lit("\"'"))))


def listed_links(pages: DataFrame, pattern: str, dropped: Sequence[str] = fixed.SKIPPED_EXTENSIONS, by_page: bool = False) -> DataFrame:
    """link, with by_page also its page's url: of pages (url, html) the targets that contain the pattern and whose path has no dropped extension, made
    absolute, without fragments, each once."""
    links = pages.select("url", F.explode(page_links(F.col("html"))).alias("link")).where(F.contains("link", F.lit(pattern)))
    path = F.lower(F.regexp_extract("link", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1))
    for extension in dropped:
        links = links.where(~F.endswith(path, F.lit(extension)))
    return links.select(*(["url"] if by_page else []), normalized_url(joined_url("url", "link")).alias("link")).distinct()


def normalized_url(url: Column) -> Column:
    """Without its fragment."""
    return F.regexp_replace(url, "#.*$", "")


def next_page(links: Column) -> Column:
    """Of an array of (href, text, rel, class) structs the first that leads to the next page, else null."""
    # What marks a link to the next page.
    words, marks = "próxima|próximo|next", ("»", ">")
    leads = lambda x: (
        F.contains(F.lower(F.coalesce(x["rel"], F.lit(""))), F.lit("next"))
        | F.lower(x["text"]).rlike(words)
        | F.trim(x["text"]).isin(*marks)
        | F.contains(F.lower(F.coalesce(x["class"], F.lit(""))), F.lit("next"))
    )
    return F.get(F.filter(links, leads), F.lit(0))["href"]
