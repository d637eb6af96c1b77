"""Records of music pages: chart rows, albums, artists, timelines of ratings, discographies.

A page is read once into a tree, by a tolerant reader that never fails on broken markup, and all fields of its records come
from that tree. The readers are small helpers; pages are spread and records exploded by Spark, in Arrow batches.

Defined results: a null or empty page has no records; a field that a chart row lacks is "NA"; a field that another record
lacks is null, or has no entry in its map; numbers lose their thousands commas and stay text; rows keep the page's order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Container, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crateforge.functions.html import VOID
from crateforge.functions.text import HOST

# Tags and classes of the pages.
CHART = {"rank": ("div", "topcharts_position"), "artist": ("div", "topcharts_item_artist"), "album": ("div", "topcharts_item_title"), "date": ("div", "topcharts_item_releasedate")}
CHART_COUNTS = {"rym_rating": ("span", "topcharts_avg_rating_stat"), "ratings": ("span", "topcharts_ratings_stat"), "reviews": ("span", "topcharts_reviews_stat")}
CHART_ROW, CHART_GENRES = "topcharts_itembox", "topcharts_item_genres_container"
CHART_PARTS = {*CHART.values(), *CHART_COUNTS.values(), ("div", CHART_GENRES)}
ALBUM_TITLE, ALBUM_TABLE, COLOURS = "album_title", "album_info", "color_bar"
ARTIST_NAME, ARTIST_INFO, INFO_HEADER, FOLLOWERS = "artist_name_hdr", "artist_info", "info_hdr", "label_num_followers"
CATALOG, CATALOG_LINE, CATALOG_DATE, CATALOG_USER = "catalog_list", "catalog_line", "catalog_date", "catalog_user"
DISCO_COUNTS = {"average_rating": "disco_avg_rating", "ratings": "disco_ratings", "reviews": "disco_reviews"}
DISCO_PARTS, DISCO_DATE = {("a", "album"), *(("div", css) for css in DISCO_COUNTS.values())}, re.compile(r"(^|\s)disco_year_")
LEFT_OUT = "Share"


class Node:
    """An element: its tag, attributes and classes, children (elements and pieces of text) and what it stands in."""

    __slots__ = ("tag", "attrs", "classes", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], classes: tuple[str, ...], parent: Node | None):
        self.tag, self.attrs, self.classes, self.children, self.parent = tag, attrs, classes, [], parent

    def inside(self) -> Iterator[Node | str]:
        """Elements and pieces of text inside, in page order, however deep tags that are never closed have made the page."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            yield child
            if not isinstance(child, str):
                waiting += child.children[::-1]

    def text(self) -> str:
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        return "".join(c for c in self.inside() if isinstance(c, str))

    def all(self, tag: str, css: str | None = None, **attrs: str | re.Pattern) -> Iterator[Node]:
        """Elements inside that match."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            if type(child) is str:
                continue
            if child.tag == tag and (css is None or css in child.classes) and (not attrs or child.has(attrs)):
                yield child
            if child.children:
                waiting += child.children[::-1]

    def has(self, attrs: dict[str, str | re.Pattern]) -> bool:
        return all(p.search(self.attrs.get(k, "")) if isinstance(p, re.Pattern) else self.attrs.get(k) == p for k, p in attrs.items())

    def first(self, tag: str, css: str | None = None, **attrs: str | re.Pattern) -> Node | None:
        return next(self.all(tag, css, **attrs), None)

    def firsts(self, wanted: Container[tuple[str, str]]) -> dict[tuple[str, str], Node]:
        """The first element inside of each of the ``wanted`` (tag, class), found in one walk."""
        found: dict[tuple[str, str], Node] = {}
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            if type(child) is str:
                continue
            for css in child.classes:
                if (child.tag, css) in wanted:
                    found.setdefault((child.tag, css), child)
            if child.children:
                waiting += child.children[::-1]
        return found

    def beside(self) -> list[Node | str]:
        """What follows under the same parent."""
        siblings = self.parent.children if self.parent else [self]
        return siblings[next(i for i, c in enumerate(siblings) if c is self) + 1 :]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, (), None)
        self.hidden = 0

    def _open(self, tag, attrs) -> Node:
        values = {k: v or "" for k, v in attrs}
        node = Node(tag, values, tuple(values.get("class", "").split()), self.at)
        self.at.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._open(tag, attrs)
        self.hidden += tag in ("script", "style")
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent
            self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_data(self, data):
        if not self.hidden:
            self.at.children.append(data)


#: Plain markup: tags in lower case whose attributes stand in double quotes, without references in them, and text; no element with contents of its own kind.
ATTRIBUTE = r'[ \t\n\r\f]+([a-z][a-z0-9-]*)="([^"<>&]*)"'
NAME = r"(?!script|style|text|title|xmp|iframe|noembed|noframes|noscript|plaintext)[a-z][a-z0-9]*"
PLAIN = re.compile(rf"[^<]*+(?:<(?:/{NAME}|{NAME}(?:{ATTRIBUTE})*+)>[^<]*+)*+")
TAG = r"<(/?)([a-z0-9]+)([^>]*)>([^<]*)"
PIECES, VALUES = re.compile(TAG), re.compile(ATTRIBUTE)


@lru_cache(4096)
def _attributes(written: str) -> tuple[dict[str, str], tuple[str, ...]]:
    attrs = dict(VALUES.findall(written))
    return attrs, tuple(attrs.get("class", "").split())


def _plain_tree(page: str) -> Node:
    """The tree that ``_Tree`` makes of plain markup, much faster."""
    root = at = Node("", {}, (), None)
    if lead := page[: page.find("<") if "<" in page else len(page)]:
        root.children.append(unescape(lead))
    for end, tag, written, text in PIECES.findall(page):
        if not end:
            node = Node(tag, *_attributes(written), at)
            at.children.append(node)
            if tag not in VOID:
                at = node
        elif at.tag == tag:
            at = at.parent
        else:
            node = at.parent
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
        if text:
            at.children.append(unescape(text) if "&" in text else text)
    return root


def tree(page: str | None) -> Node:
    if page and PLAIN.fullmatch(page):
        return _plain_tree(page)
    reader = _Tree()
    reader.feed(page or "")
    reader.close()
    return reader.root


def _said(node: Node | None) -> str | None:
    return None if node is None else node.text().strip()


def _one_line(text: str) -> str:
    return " ".join(text.replace("\n", ", ").split())


def _plain_number(text: str | None) -> str | None:
    return None if text is None else text.replace(",", "")


def chart(page: Node) -> list[dict]:
    """A chart page's rows. The three counts stand or fall together."""
    rows = []
    for box in page.all("div", CHART_ROW):
        firsts = box.firsts(CHART_PARTS)
        row = {name: "NA" if (found := _said(firsts.get(where))) is None else found for name, where in CHART.items()}
        row["rank"] = row["rank"].replace(".", "")
        row["date"] = row["date"].replace("(", "").replace(")", "").strip()
        genres = firsts.get(("div", CHART_GENRES))
        row["genres"] = "NA" if genres is None else ", ".join(g.text() for g in genres.all("a", "genre"))
        counts = [_said(firsts.get(where)) for where in CHART_COUNTS.values()]
        row |= dict(zip(CHART_COUNTS, ["NA"] * 3 if None in counts else [counts[0], *map(_plain_number, counts[1:])]))
        rows.append(row)
    return rows


def _table(page: Node, clean: Callable[[str], str]) -> dict[str, str]:
    """Header and value of each line of the album's table; of headers that repeat the last holds."""
    table, info = page.first("table", ALBUM_TABLE), {}
    for line in table.all("tr") if table else ():
        header, value = line.first("th"), line.first("td")
        if header is not None and value is not None:
            info[header.text().strip()] = clean(value.text().strip())
    return info


def album(page: Node) -> list[dict]:
    """One record, or none where the page has no title."""
    title = page.first("div", ALBUM_TITLE)
    if title is None:
        return []
    lines = title.text().split("\n")
    info = _table(page, str)
    info.pop(LEFT_OUT, None)
    listed, bar = page.first("ul", id="tracks"), page.first("table", COLOURS)
    names = [x.first("span", "tracklist_title") for x in (listed.all("li") if listed else ())]
    tracks = [_said(n.first("span", "rendered_text") or n) for n in names if n is not None]
    styles = [re.split("[;:]", x.attrs.get("style", "")) for x in (bar.all("td") if bar else ())]
    return [{"name": lines[0].strip(), "artist": lines[2].strip()[3:] if len(lines) > 2 else None, "info": info, "track_listing": tracks, "colorscheme": [s[1].strip() for s in styles if len(s) > 1]}]


def artist(page: Node) -> list[dict]:
    """One record, or none where the page has no name. A header's value is the element right after it; the last value is the number of followers."""
    name = page.first("h1", ARTIST_NAME)
    if name is None:
        return []
    info = page.first("div", ARTIST_INFO)
    headers = list(info.all("div", INFO_HEADER)) if info else []
    values = [_said(after[0]) for h in headers if (after := h.beside()) and isinstance(after[0], Node)]
    followers = _said(page.first("span", FOLLOWERS))
    if values and followers is not None:
        values[-1] = followers.replace(" followers", "").replace(",", "")
    found = dict(zip([_said(h) for h in headers], values))
    found.pop(LEFT_OUT, None)
    return [{"name": _said(name), "info": found}]


def timeline(page: Node) -> list[dict]:
    """Date and user of each catalog line."""
    listed = page.first("div", CATALOG, id=CATALOG)
    return [{"date": _said(x.first("div", CATALOG_DATE)), "user": _said(x.first("span", CATALOG_USER))} for x in (listed.all("div", CATALOG_LINE) if listed else ())]


def discography(page: Node) -> list[dict]:
    """Every release of every section of an artist's page."""
    name, listed = _said(page.first("h1", ARTIST_NAME)), page.first("div", id="discography")
    rows = []
    for section in listed.all("div", "disco_header_top") if listed else ():
        category = _said(section.first("h3"))
        held = next((x for x in section.beside() if isinstance(x, Node) and x.tag == "div" and x.attrs.get("id", "").startswith("disco_type_")), None)
        for release in held.all("div", "disco_release") if held else ():
            firsts, date = release.firsts(DISCO_PARTS), release.first("span", **{"class": DISCO_DATE})
            title, counts = firsts.get(("a", "album")), {k: _plain_number(_said(firsts.get(("div", css)))) for k, css in DISCO_COUNTS.items()}
            url = None if title is None or "href" not in title.attrs else HOST + title.attrs["href"]
            rows.append({"artist": name, "category": category, "name": _said(title), "url": url, "date": None if date is None else date.attrs.get("title", "").strip(), "year": _said(date), **counts})
    return rows


def details(page: Node) -> list[dict]:
    """What a release's own page adds: its table in single lines."""
    return [{"info": _table(page, _one_line)}] if page.first("table", ALBUM_TABLE) else []


TEXT, TEXTS, ENTRIES = pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
DDL = {TEXT: "string", TEXTS: "array<string>", ENTRIES: "map<string,string>"}
KINDS: dict[str, tuple[Callable[[Node], list[dict]], dict[str, pa.DataType]]] = {
    "chart": (chart, dict.fromkeys(("rank", "artist", "album", "date", "genres", "rym_rating", "ratings", "reviews"), TEXT)),
    "album": (album, {"name": TEXT, "artist": TEXT, "info": ENTRIES, "track_listing": TEXTS, "colorscheme": TEXTS}),
    "artist": (artist, {"name": TEXT, "info": ENTRIES}),
    "timeline": (timeline, dict.fromkeys(("date", "user"), TEXT)),
    "discography": (discography, dict.fromkeys(("artist", "category", "name", "url", "date", "year", "average_rating", "ratings", "reviews"), TEXT)),
    "details": (details, {"info": ENTRIES}),
}
#: Records that are held before they go on as a batch, and pages that are texts at once.
HELD, AT_ONCE = 4096, 64


def records(pages: DataFrame, kind: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, fields): a row for each record of each page; place counts from 1.

    Records leave as they are found, so that a worker holds few, however many pages come in a batch.
    """
    reader, fields = KINDS[kind]

    def flat(keys: pa.Array, of: list[int], places: list[int], found: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([list(r[n].items()) for r in found] if t is ENTRIES else [r[n] for r in found], t) for n, t in fields.items()]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of, pa.int64())), pa.array(places, pa.int32()), *columns], names=[key, "place", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, of, places, found = batch.column(0), batch.column(1), [], [], []
            for start in range(0, batch.num_rows, AT_ONCE):
                for i, page in enumerate(texts.slice(start, AT_ONCE).to_pylist(), start):
                    rows = reader(tree(page))
                    of += [i] * len(rows)
                    places += range(1, len(rows) + 1)
                    found += rows
                    if len(found) >= HELD:
                        yield flat(keys, of, places, found)
                        of, places, found = [], [], []
            if found:
                yield flat(keys, of, places, found)

    rows = pages.select(key, html)
    schema = T.StructType([rows.schema[0], T.StructField("place", T.IntegerType()), *T.StructType.fromDDL(", ".join(f"{n}: {DDL[t]}" for n, t in fields.items()))])
    return rows.mapInArrow(run, schema)


def with_details(disco: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Discography rows with what the releases' own pages (url, html) add: info, rank_overall, rank_year; missing pages leave nulls.

    The ranks are the first word of the first place among ``Ranked`` that names them, without signs.
    """
    found = records(pages.where(F.col(url).isNotNull()).dropDuplicates([url]), "details", url, html).select(F.col(url).alias("url"), "info")
    places = F.split(F.try_element_at("info", F.lit("Ranked")), ", ")

    def rank(wanted: Column) -> Column:
        of = F.get(F.filter(places, lambda p: F.contains(p, wanted)), F.lit(0))
        return F.nullif(F.get(F.split(F.regexp_replace(F.trim(of), "[#,]", ""), r"\s+"), F.lit(0)), F.lit(""))

    return disco.join(found, "url", "left").withColumn("rank_overall", rank(F.lit("overall"))).withColumn("rank_year", rank(F.col("year")))
