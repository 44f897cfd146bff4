"""Text for reports and files, as column expressions, and the spellings of parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of truth values in parameter files.
TRUE, FALSE = ("T", "TRUE", "true", "True", "1"), ("F", "FALSE", "false", "False", "0")
# IEC units.
UNITS = ("", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi")


def html_escape(value: Column, quotes: bool = True) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#39;")) if quotes else ())):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def safe_filename(value: Column) -> Column:
    """Reserved characters as underscores, without dots and blanks at the end."""
    return F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")


def one_decimal(x: Column) -> Column:
    """Text of a double as C's ``%.1f`` writes it: of its exact value, ties to the even digit. (``format_string`` rounds its shortest spelling, ties up.)"""
    size = F.abs(x)
    whole = F.floor(size)
    bits = F.floor((size - whole) * 2.0**59)  # exact from 1 / 64 on
    tenth, rest = F.shiftright(bits * 10, 59), F.pmod(bits * 10, F.lit(1 << 59))
    up = (rest > 1 << 58) | ((rest == 1 << 58) & (tenth % 2 == 1))
    n = whole * 10 + tenth + up.cast("long")
    plain = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(size < 2.0**49, plain).when(x.isNotNull(), F.format_string("%.1f", x))  # above, and for NaN, nothing is rounded


def human_size(n: Column, suffix: str = "B") -> Column:
    """IEC text of a size: one decimal and the first unit in which it is below 1024; null for null."""
    size, unit = F.lit(1024.0**8), F.lit("Yi" + suffix)
    for k in reversed(range(len(UNITS))):
        below = F.abs(n) < 1024.0 ** (k + 1)
        size, unit = F.when(below, 1024.0**k).otherwise(size), F.when(below, UNITS[k] + suffix).otherwise(unit)
    return F.concat(one_decimal(n / size), unit)


def as_html(fields: Column, title: str = "") -> Column:
    """A map of texts as an HTML list."""
    items = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("<li><b>"), html_escape(e["key"]), F.lit("</b>: "), html_escape(e["value"]), F.lit("</li>")))
    return F.concat(F.lit(f"<h3>{title}</h3><ul>" if title else "<ul>"), F.array_join(items, ""), F.lit("</ul>"))


def as_markdown(fields: Column, title: str = "") -> Column:
    items = F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), e["value"]))
    return F.concat(F.lit(f"### {title}\n" if title else ""), F.array_join(items, "\n"))


def truth(text: str) -> bool:
    if text in TRUE or text in FALSE:
        return text in TRUE
    raise ValueError(f"not a truth value: {text}")


def checksum(stream, block: int = 1 << 20) -> str:
    """MD5 of an open binary stream."""
    digest = hashlib.md5()
    while part := stream.read(block):
        digest.update(part)
    return digest.hexdigest()
