"""Text functions of the engine, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.model import PREVIEW_CHARS

_EDGES = r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$"


def unicode_trim(text: Column) -> Column:
    """Without white space (of all of Unicode) at both ends."""
    return F.regexp_replace(text, _EDGES, "")


def preview(text: Column) -> Column:
    """The first characters on one line."""
    return F.replace(F.left(text, F.lit(PREVIEW_CHARS)), F.lit("\n"), F.lit(" "))


def escape_markdown(text: Column) -> Column:
    """Backslashes before what would change the structure: some characters anywhere, others only at the start of the run."""
    anywhere = F.regexp_replace(text, r"([\\*_`\[\]])", r"\\$1")
    return F.regexp_replace(anywhere, r"\A([#>+-])", r"\\$1")


def escape_target(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit(")"), F.lit("%29"))


def emphasise(text: Column, marker: str) -> Column:
    """The marker around the trimmed text; white space stays outside, blank text unmarked."""
    core = unicode_trim(text)
    lead = F.regexp_extract(text, r"\A(\p{IsWhite_Space}*)", 1)
    tail = F.regexp_extract(text, r"(\p{IsWhite_Space}*)\z", 1)
    return F.when(core == "", text).otherwise(F.concat(lead, F.lit(marker), core, F.lit(marker), tail))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def path_segments(path: Column, after: str = ".channels") -> Column:
    """The elements of a path that follow an element `after`."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.filter(F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"), F.slice(parts, 2, F.size(parts)).alias("b")), lambda x: x["a"] == after), lambda x: x["b"])


def heading_level(style: Column) -> Column:
    """1 to 6 for `Heading N`, else null."""
    number = F.regexp_extract(unicode_trim(F.regexp_extract(style, r"\AHeading ([\s\S]*)\z", 1)), r"\A\+?([0-9]+)\z", 1)
    level = number.try_cast("int")
    return F.when(level.between(1, 6), level)


def list_depth(reference: Column) -> Column:
    """The number before the first `;`, if it is one of 32 bits without a sign; else null."""
    head = F.regexp_extract(reference, r"\A\+?([0-9]+);", 1)
    value = head.try_cast("long")
    return F.when(value <= 4294967295, value)


def list_id(reference: Column) -> Column:
    """What follows the first `;`; null without one."""
    at = F.instr(reference, ";")
    return F.when(at > 0, F.substring(reference, at + 1, F.length(reference)))


def is_list(reference: Column) -> Column:
    return F.coalesce(reference != "", F.lit(False))


def is_property_attribution(key: Column) -> Column:
    return key.startswith("@") & (F.length(key) > 1)


def is_personal(key: Column) -> Column:
    """Keys whose values name a person."""
    return (key == "attribution") | is_property_attribution(key)


def address(channel: Column, structure: Column) -> Column:
    """channel/structure, channel, or nothing."""
    return F.when(channel.isNull(), F.lit("")).when(structure.isNull(), channel).otherwise(F.concat(channel, F.lit("/"), structure))
