"""Text keys, labels and the clean-up of report markup, all as column expressions."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
          "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
# Entity names and their characters come from the language's own table; the Latin-1 ones and the
# four markup ones also count without a semicolon.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
BARE_ENTITIES = sorted(n for n, code in name2codepoint.items() if code < 256)
SPACE = r"[\s ]+"


def to_ascii(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def norm_name(text: Column) -> Column:
    """Matching key of a place name: no accents, lower case, single spaces."""
    return collapse(F.lower(to_ascii(text)))


def slug(text: Column) -> Column:
    """Plain letters and digits, the rest ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(to_ascii(text), "[^A-Za-z0-9]", "_"), "^_+|_+$", "")


def class_guess(label: Column) -> Column:
    """Crop class of a free-text label."""
    low = F.lower(label)
    return (
        F.when(low.startswith("ma") | low.contains("corn") | low.contains("maize"), "maiz")
        .when(low.startswith("sorg"), "sorgo").otherwise("otros")
    )


def unescape(text: Column) -> Column:
    """Named and numeric character references to characters, one regular expression per ``&``."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")
    pattern = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*)(;?)"

    def decode(piece: Column) -> Column:
        ref, end = F.regexp_extract(piece, pattern, 1), F.regexp_extract(piece, pattern, 2)
        digits = F.when(ref.rlike("^#[0-9]"), F.hex(F.substring(ref, 2, 8).try_cast("bigint"))).when(
            ref.rlike("^#[xX]"), F.substring(ref, 3, 8))
        char = F.when(digits.isNotNull(), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")).when(
            (end == ";") | ref.isin(*BARE_ENTITIES), F.try_element_at(names, ref))
        rest = F.substring(piece, F.length(ref) + F.length(end) + 1, F.length(piece))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decode), ""))


def strip_markup(text: Column) -> Column:
    """Comments out, tags to spaces, entities to characters, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", ""), "<[^>]+>", " ")
    return collapse(unescape(bare))


#: A decimal number; a cast alone would also read type suffixes such as ``1d``.
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """``1,234.50`` to a double; anything else to NULL."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def spanish_date(text: Column) -> Column:
    """``28 de febrero de 2025`` to ISO text, empty when it is no date."""
    pattern = r"(\d{1,2}) de ([\wáéíóúñ]+) de (\d{4})"
    month = F.lower(F.regexp_extract(text, pattern, 2))
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    mm = F.try_element_at(numbers, month)
    return F.when(mm.isNull(), "").otherwise(F.concat_ws(
        "-", F.regexp_extract(text, pattern, 3), F.lpad(mm.cast("string"), 2, "0"),
        F.lpad(F.regexp_extract(text, pattern, 1), 2, "0")))


def whole_percent(share: Column) -> Column:
    """A share as a whole percentage, half to even."""
    return F.bround(100 * share, 0).cast("int").cast("string")
