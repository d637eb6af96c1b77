"""Text helpers as column expressions: slugs, chart addresses, names, numbers, dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a slug replaces, in order, then what it drops, then what it maps.
SLUG_FIRST = [(" /", ""), ("&", "and"), (" ", "-")]
SLUG_DROP = ",'()[]%:.?"
SLUG_MAP = ("éà", "ea")
HOST = "https://rateyourmusic.com"


def slugify(c: Column) -> Column:
    replaced = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), SLUG_FIRST, F.lower(c))
    return F.translate(replaced, SLUG_MAP[0] + SLUG_DROP, SLUG_MAP[1])


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_list(c: Column) -> Column:
    """Comma list -> trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def chart_url(kind: Column, year: Column, genres: Column, country: Column, page: Column) -> Column:
    """Address of a chart page; parts that are null are left out."""
    part = lambda lead, c: F.coalesce(F.concat(F.lit(lead), c), F.lit(""))
    return F.concat(F.lit(f"{HOST}/charts/top/"), F.coalesce(kind, F.lit("album")), part("/", year), part("/g:", genres), part("/loc:", country), F.lit("/"), page.cast("string"), F.lit("/"))


def artist_and_album(c: Column, separator: str = " - ") -> Column:
    parts = F.split(c, separator, 2)
    return F.struct(strip(F.get(parts, 0)).alias("artist"), strip(F.get(parts, 1)).alias("album"))


def number(c: Column) -> Column:
    """Digits with thousands separators and words around -> number, null if there is none."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def any_date(c: Column) -> Column:
    """'16 June 1997', '13 Aug 2004' or '1993' (its first day); else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("d MMMM yyyy", "d MMM yyyy", "yyyy")])


def rank_among(c: Column, marker: str) -> Column:
    """First word of the first comma part that has ``marker``, without # and thousands separators: '#1,234 overall' gives 1234."""
    part = F.get(F.filter(F.split(c, r",\s+"), lambda x: F.contains(x, F.lit(marker))), 0)
    return F.translate(F.get(F.split(part, " "), 0), "#,", "")


def collapse(c: Column) -> Column:
    """Line breaks to ', ', other runs of white space to one space."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\s*\n\s*", ", "), r"[ \t]+", " ")


def colour(style: Column) -> Column:
    """The value of the first property of a style attribute."""
    return strip(F.get(F.split(style, ";|:"), 1))


def decimals(c: Column, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits}f", c)


def merged(a: Column, b: Column) -> Column:
    """Two maps, the second's values winning; neither's repeated keys raise."""
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two lists, as many as the shorter has."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.least(F.size(a), F.size(b)))


def title_and_artist(c: Column) -> Column:
    """Of a heading's lines, the first as title and the third, without 'By ', as artist."""
    lines = F.split(c, "\n")
    return F.struct(F.get(lines, 0).alias("title"), F.substring(F.get(lines, 2), 4, 2**31 - 1).alias("artist"))


def of_class(classes: Column, prefix: str) -> Column:
    """Those of a list of class names that begin with ``prefix``."""
    return F.filter(classes, lambda x: F.startswith(x, F.lit(prefix)))


def joined(c: Column) -> Column:
    return F.array_join(c, ", ")


def search_keys(artist: Column, album: Column) -> Column:
    """What an album is looked up by, in turn: with the artist, with a dash, with the artist's first five letters."""
    return F.array(F.concat_ws(" ", album, artist), F.concat_ws(" - ", artist, album), F.concat_ws(" ", album, F.substring(artist, 1, 5)))


def search_url(term: Column) -> Column:
    """Address of a search; spaces become plus signs."""
    return F.concat(F.lit(f"{HOST}/search?searchterm="), F.replace(term, F.lit(" "), F.lit("+")))


def export_name(url: Column) -> Column:
    """A file name from an address: its last part that is not empty, spaces as underscores."""
    parts = F.filter(F.split(url, "/"), lambda x: x != "")
    return F.replace(F.try_element_at(parts, F.lit(-1)), F.lit(" "), F.lit("_"))


def export_path(kind: str, at: Column, name: Column | None = None) -> Column:
    """Where an export of a kind goes: the second it is made, the kind, and the name of what it is about, if it has one."""
    parts = [F.lit("Exports/"), F.unix_seconds(at).cast("string"), F.lit(f"_export_{kind}")]
    return F.concat(*parts, *([F.coalesce(F.concat(F.lit("_"), name), F.lit(""))] if name is not None else []))
