"""Column functions over strings: packed metadata, lists, names, keys and display forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The packed metadata format. Clauses follow one another in this order; the date and descriptors are required.
META = (
    r'(?U)#\s*Track:\s*"([^"]+)"\s*by\s*(.+?)\.\s*'
    r"(?:Composer:\s*(.+?)\.\s*)?"
    r"(?:Producer:\s*(.+?)\.\s*)?"
    r"(?:Conductor:\s*(.+?)\.\s*)?"
    r"(?:Writer:\s*(.+?)\.\s*)?"
    r"(?:Lyricist:\s*(.+?)\.\s*)?"
    r"(?:Arranger:\s*(.+?)\.\s*)?"
    r"Released on\s*([\d-]+)\.\s*Descriptors:\s*(.+?)\.?\s*$"
)
MARK = "\x01"
TRACK, CREDIT, COMPOSER, PRODUCER, WRITER, RELEASED, DESCRIPTORS = 1, 2, 3, 4, 6, 9, 10
ARTIST = r""""([^"]+)"\(spotify:artist:([A-Za-z0-9]+)\)|([A-Za-z0-9 .'&]+)\(spotify:artist:([A-Za-z0-9]+)\)"""
# Tokens that mark another version of a title, in the order of the alternation, and the ordered tests of a version's type.
VERSION = r"(?iU)\s*-\s*(?:Live|Live From|Live At|Remaster(?:ed)?|Radio Edit|Remix|Acoustic|Deluxe|A COLORS SHOW|feat\..+)"
VERSION_TYPES = [("live", "live"), ("remaster", "remaster"), ("remix", "remix"), ("radio edit", "radio_edit"), ("acoustic", "acoustic")]
# Separators that an even number of quotes follows, so none in quotes.
OUTSIDE_QUOTES = r'(?:\s*,?\s+and\s+|,)(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Descriptors that name a macro genre, and those that name a mood.
MACRO_GENRES = {
    "country": "country_americana",
    "country blues": "country_americana",
    "americana": "country_americana",
    "folk rock": "country_americana",
    "honky tonk": "country_americana",
    "hip hop": "hip_hop_rap",
    "rap": "hip_hop_rap",
    "pop rap": "hip_hop_rap",
    "trap": "hip_hop_rap",
    "trap latino": "hip_hop_rap",
    "pop": "pop",
    "bubblegum pop": "pop",
    "easy listening": "pop",
    "r&b": "r_and_b_soul",
    "soul": "r_and_b_soul",
    "soul funk": "r_and_b_soul",
    "soulful": "r_and_b_soul",
    "motown": "r_and_b_soul",
    "jazz blues": "r_and_b_soul",
    "indie folk": "indie_folk",
    "folk": "indie_folk",
    "folk pop": "indie_folk",
    "indie pop": "indie_folk",
    "indie": "indie_folk",
    "alternative rock": "alternative_rock",
    "rock": "alternative_rock",
    "grunge": "alternative_rock",
    "britpop": "alternative_rock",
    "garage rock": "alternative_rock",
    "new wave": "alternative_rock",
    "latin": "latin",
    "reggaeton": "latin",
    "salsa": "latin",
    "sierreno": "latin",
    "merengue": "latin",
    "house": "electronic",
    "club": "electronic",
    "electronic": "electronic",
    "ibiza": "electronic",
    "musicals": "classical_musicals",
    "classical": "classical_musicals",
}
MOODS = ["sad", "melancholy", "slow", "romantic", "love", "cozy", "chill", "calm", "nostalgia", "moody", "sensual", "classy", "soulful", "nature", "acoustic"]
# Tags that name no genre.
DENIED_TAGS = [
    "american", "usa", "united states", "british", "uk", "canadian", "male vocalists", "female vocalists",
    "80s", "70s", "60s", "90s", "00s", "2000s", "2010s", "all", "oldies",
]


def packed_fields(packed_name: Column) -> Column:
    """The groups of a packed name's format, an absent one empty, behind what stands before them; null where the name doesn't fit.

    The format is matched once: the match is replaced by its groups with a mark
    before each, then split at the marks (a control character that no name holds).
    """
    at = F.instr(packed_name, "\t")
    meta = F.when(at > 0, F.translate(F.substring(packed_name, at + 1, F.length(packed_name)), MARK, ""))
    groups = F.split(F.regexp_replace(meta, META, "".join(f"{MARK}${k}" for k in range(1, DESCRIPTORS + 1))), MARK, -1)
    return F.when(F.size(groups) == DESCRIPTORS + 1, groups)


def parse_packed(packed_name: Column) -> Column:
    """A packed name as a struct: track_name, artists, composers, producers, release_date, descriptors.

    Composers fall back to writers. The struct is null where the name doesn't parse.
    """

    def parsed(groups: Column) -> Column:
        field = lambda k: F.nullif(F.get(groups, F.lit(k)), F.lit(""))
        return F.struct(
            field(TRACK).alias("track_name"),
            artists(field(CREDIT)).alias("artists"),
            split_names(F.coalesce(field(COMPOSER), field(WRITER))).alias("composers"),
            split_names(field(PRODUCER)).alias("producers"),
            field(RELEASED).alias("release_date"),
            split_quoted(field(DESCRIPTORS)).alias("descriptors"),
        )

    # Within a lambda the groups are a value, not an expression that each field would repeat.
    return F.element_at(F.transform(F.array(packed_fields(packed_name)), lambda g: F.when(g.isNotNull(), parsed(g))), 1)


def artists(credit: Column) -> Column:
    """The artists of a credit as structs (name, uri); a bare name loses a leading "and "."""
    each = F.regexp_extract_all(credit, F.lit(ARTIST), F.lit(0))
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, ARTIST, 1), F.lit("")), F.regexp_replace(F.trim(F.regexp_extract(x, ARTIST, 3)), "(?i)^and\\s+", ""))
    uri = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, ARTIST, 2), F.lit("")), F.regexp_extract(x, ARTIST, 4))
    return F.coalesce(F.transform(each, lambda x: F.struct(name(x).alias("name"), uri(x).alias("uri"))), F.array().cast("array<struct<name:string,uri:string>>"))


def split_names(names: Column) -> Column:
    """Names split at commas and "and", without quotes; quotes protect nothing here."""
    parts = F.transform(F.split(names, r",\s*(?:and\s+)?|\s+and\s+"), lambda x: F.btrim(F.trim(x), F.lit('"')))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def split_quoted(values: Column) -> Column:
    """Values split at commas and "and" outside quotes, in lower case."""
    parts = F.transform(F.split(values, OUTSIDE_QUOTES), lambda x: F.lower(F.trim(F.translate(x, '"', ""))))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def canonical_name(name: Column, strict: bool = False) -> Column:
    """A title without its version token; ``strict`` also drops all that follows the token."""
    return F.trim(F.regexp_replace(name, VERSION + (".*$" if strict else ""), ""))


def version_type(name: Column) -> Column:
    """The first version word that a title contains; else ``original`` if nothing marks a version, else ``other``."""
    low, out = F.lower(name), F.when(name == canonical_name(name), "original").otherwise("other")
    for word, kind in reversed(VERSION_TYPES):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    return out


def release_year(date: Column) -> Column:
    """The first four characters of a date as a number, or null."""
    return F.substring(date, 1, 4).try_cast("int")


def decade(year: Column) -> Column:
    """The decade of a year."""
    return (F.floor(year / 10) * 10).cast("int")


def classify(values: Column, groups: dict[str, str] = MACRO_GENRES, unknown: str | None = "unknown") -> Column:
    """The groups that values belong to, each once, in order; ``[unknown]`` where none does."""
    lookup = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    found = F.array_distinct(F.filter(F.transform(values, lambda v: F.try_element_at(lookup, v)), lambda g: g.isNotNull()))
    return found if unknown is None else F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(unknown)))


def moods(values: Column, names: list[str] = MOODS) -> Column:
    """The values that name a mood, in order."""
    return F.filter(values, lambda v: v.isin(names))


@F.pandas_udf(StringType())
def fold(names: pd.Series) -> pd.Series:
    """Compatibility-composed and case-folded strings; Spark has no function for either."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def loose_key(name: Column, folded: bool = True) -> Column:
    """The key under which spellings of a name meet; without ``folded``, case is lowered by Spark alone (exact for ASCII)."""
    key = F.translate(fold(name) if folded else F.lower(name), "\u2019\u2018'", "")
    return F.trim(F.regexp_replace(F.replace(key, F.lit(" & "), F.lit(", ")), r"\s+", " "))


def punctuation_key(name: Column, folded: bool = True) -> Column:
    """The loose key without full stops."""
    return F.replace(loose_key(name, folded), F.lit("."), F.lit(""))


def is_upper(name: Column) -> Column:
    """Whether a name has cased letters, all of them capitals."""
    return (name == F.upper(name)) & (name != F.lower(name))


def file_name(name: Column) -> Column:
    """A name without the characters that file names can't hold."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "")


def escaped(text: Column) -> Column:
    """Angle brackets as entities; ampersands stay."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def duration(seconds: Column) -> Column:
    """Hours with one place from an hour on, else whole minutes (halves to even)."""
    return F.when(seconds >= 3600, F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" hrs"))).otherwise(F.concat(F.bround(seconds / 60, 0).cast("long").cast("string"), F.lit(" min")))


def primary_tag(tags: Column, denied: list[str] = DENIED_TAGS) -> Column:
    """The first tag whose lower case isn't denied, else ``untagged``."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: ~F.lower(t).isin(denied)), F.lit(1)), F.lit("untagged"))


def node_id(kind: str, label: Column) -> Column:
    """The id of a graph node: ``kind::label``."""
    return F.concat(F.lit(f"{kind}::"), label)


def node_label(node: Column) -> Column:
    """What follows the kind in a node's id."""
    return F.regexp_extract(node, "^[^:]*::(.*)$", 1)
