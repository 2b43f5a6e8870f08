"""Scalar functions on text, paths and URLs, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode's white space, what (?U)\s matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included (trim alone only takes the ASCII blank). A pattern would look at each character."""
    return F.trim(c, F.lit(WHITE))


def strip_start(c: Column) -> Column:
    """For what only looks at a line's start: trimming the end reads the whole line."""
    return F.ltrim(c, F.lit(WHITE))


def strip_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def cjk(c: Column) -> Column:
    """The CJK ideographs of a text; a title's normal form."""
    return F.regexp_replace(c, r"[^一-鿿]+", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<.*?>", "")


def heading_level(c: Column) -> Column:
    """Signs at the start of a line, 6 at most, 0 if none."""
    line = strip_start(c)
    return F.least(F.lit(6), F.length(line) - F.length(F.ltrim(line, F.lit("#"))))


def is_heading(c: Column) -> Column:
    """A line that starts with a sign and has a text."""
    return c.startswith("#") & c.rlike(r"(?U)^#+\s*[^#\s]")


def heading_text(c: Column) -> Column:
    return strip(F.ltrim(strip_start(c), F.lit("#")))


def heading(title: Column, level: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level))), F.lit(" "), strip(title))


def page_index(c: Column, tolerant: bool = False) -> Column:
    """The number of a page marker; the tolerant form takes a full-width colon or a stray bracket."""
    pattern = r"^<page_idx(?:[:：]*\[|[:：])(\d+)>" if tolerant else r"^<page_idx:(\d+)>"
    line = strip_start(c)
    return F.when(line.startswith("<page_idx"), F.regexp_extract(line, pattern, 1).try_cast("int"))


def is_table_line(c: Column) -> Column:
    line = strip_start(c)
    return line.startswith("<table") | line.startswith("|") | line.startswith("---") | (line.contains("|") & ~line.startswith("#"))


def is_table_pattern(c: Column) -> Column:
    """The wider form, which takes headings with a bar as well."""
    return c.rlike(r"^\s*<table|^\s*\||^\s*---|\|")


def is_image_path(c: Column) -> Column:
    return c.contains("_temp_images/") & c.rlike(r"(?i)\.(jpg|jpeg|png|gif|bmp|webp)$")


def is_image_link(c: Column) -> Column:
    return strip_start(c).startswith("![](") & strip(c).rlike(r"^!\[\]\((.+?)\)$")


def image_path(c: Column) -> Column:
    """The path in ![](...); null without one."""
    return F.when(c.contains("![]("), F.nullif(F.regexp_extract(c, r"(?i)!\[\]\((.*?\.(?:jpg|png|jpeg|bmp|gif|webp))\)", 1), F.lit("")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(basename(c), r".(\.[^.]*)$", 1))


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def quote(c: Column, safe: str = "/") -> Column:
    """Percent-encoding that leaves letters, digits, _.-~ and `safe`."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *[(f"%{ord(x):02X}", x) for x in safe]):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def unquote(c: Column) -> Column:
    """The decoded form; what isn't validly encoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def clean_name(c: Column) -> Column:
    """Word characters, hyphens, dots and ideographs of a name."""
    return F.regexp_replace(c, r"(?U)[^\w\-\.一-鿿]", "")


def megabytes(c: Column) -> Column:
    return F.round(c / 1048576, 2)


def preview(c: Column, most: int = 50) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
