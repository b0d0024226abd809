"""Scalar functions of document text, as Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic ligatures of plain runs, those that begin others' text first.
LIGATURES = (("?`", "¿"), ("!`", "¡"), ("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"), ("`", "‘"), ("'", "’"))
#: File endings and media types; anything else counts as XHTML.
MEDIA_TYPES = {".css": "text/css", ".gif": "image/gif", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".ncx": "application/x-dtbncx+xml", ".opf": "application/oebps-package+xml", ".png": "image/png", ".svg": "image/svg+xml", ".tif": "image/tiff", ".tiff": "image/tiff"}
XHTML = "application/xhtml+xml"


def lit(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def sep_by(a: Column, b: Column, separator: str) -> Column:
    """Both with the separator between them, or the one that isn't empty."""
    return F.concat_ws(separator, F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def sep_end_by(parts: Column, middle: str, end: str) -> Column:
    """All parts; the last pair has a separator of its own."""
    n = F.size(parts)
    return F.when(n < 1, "").when(n == 1, parts[0]).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), middle), F.lit(end), F.element_at(parts, -1)))


def dotted(text: Column) -> Column:
    """A full stop at the end of what isn't empty, unless there is one."""
    return F.when((text == "") | text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def sep_by_dot(a: Column, b: Column) -> Column:
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat(dotted(a), F.lit(" "), b))


def wrapped(text: Column, before: str, after: str) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(before), text, F.lit(after)))


def letters(rank: Column) -> Column:
    """0 a, 25 z, 26 aa, 701 zz, 702 aaa, and so on; nothing below 0."""
    start = F.struct((rank.cast("bigint") + 1).alias("n"), F.lit("").alias("s"))
    # fourteen letters number more than a bigint does

    def step(a: Column, _: Column) -> Column:
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(a["n"] - 1, F.lit(26)).cast("int") + 1, F.lit(1))
        return F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).cast("bigint").alias("n"), F.concat(letter, a["s"]).alias("s"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda a: a["s"])


def section_id(region: Column, path: Column) -> Column:
    """sec-, front- or back- where it isn't the main matter, and the components from the chapter on without trailing zeros."""
    last = F.aggregate(F.sequence(F.lit(1), F.size(path)), F.lit(0), lambda a, i: F.when(F.element_at(path, i) != 0, i).otherwise(a))
    body = F.when(last == 0, F.lit("")).otherwise(F.array_join(F.slice(path, F.lit(1), F.greatest(last, F.lit(1))).cast("array<string>"), "-"))
    return F.concat(F.lit("sec-"), F.when(region == "front", "front-").when(region == "back", "back-").otherwise(""), body)


def xml_escaped(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), text)


def ligated(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), LIGATURES, text)


def accented(text: Column, mark: str) -> Column:
    """The mark after the first character and the marks that it has; a space carries it where there is none."""
    return F.when(text == "", F.lit(" " + mark)).otherwise(F.regexp_replace(text, r"(?s)^(.)(\p{M}*)", "$1$2" + mark))


def white_collapsed(text: Column) -> Column:
    """Comments to the line's end (and the next line's blanks) go, blank lines become one paragraph mark, other white space one space."""
    bare = F.regexp_replace(text, r"(?<!\\)%[^\n]*\n[ \t]*", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^[ \t\n]+", ""), r"[ \t]*\n[ \t]*\n[ \t\n]*", "¶"), r"[ \t\n]+", " ")


def nc_name(text: Column) -> Column:
    """An XML name without colons: odd characters become _, and a leading one that may not begin a name gets _ before it."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")
    return F.when(F.rlike(safe, F.lit("^[A-Za-z_]")), safe).otherwise(F.concat(F.lit("_"), safe))


def media_type(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return reduce(lambda c, p: c.when(ending == p[0], p[1]), list(MEDIA_TYPES.items())[1:], F.when(ending == next(iter(MEDIA_TYPES)), MEDIA_TYPES[next(iter(MEDIA_TYPES))])).otherwise(XHTML)


def user_date(text: Column, today: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD with month and day brought into range; anything else is today, cut to ten characters."""
    year, month, day = (F.regexp_extract(text, r"^([0-9]{4})(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$", i) for i in (1, 2, 3))
    m = F.lpad(F.least(F.greatest(F.try_to_number(month, F.lit("99")).cast("int"), F.lit(1)), F.lit(12)).cast("string"), 2, "0")
    last = F.dayofmonth(F.last_day(F.to_date(F.concat_ws("-", year, m, F.lit("01")))))
    d = F.lpad(F.least(F.greatest(F.try_to_number(day, F.lit("99")).cast("int"), F.lit(1)), last).cast("string"), 2, "0")
    return F.when(year == "", today).when(month == "", year).when(day == "", F.concat_ws("-", year, m)).otherwise(F.concat_ws("-", year, m, d))


def file_name(number: Column) -> Column:
    return F.format_string("section-%03d.xhtml", number)
