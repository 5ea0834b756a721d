"""Scalar functions over strings, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from babelyard.functions import lookups as L

#: White space of the sources' language: Java's Unicode set and the byte order mark.
SPACE = r"(?U)[\s\x{FEFF}]"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def words(text: Column) -> Column:
    """Parts between white space of the trimmed text; one empty part for a blank text."""
    return F.split(trim(text), r"(?U)[\s\x{FEFF}]+")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(trim(text), r"(?U)[\s\x{FEFF}]+", " ")


def slug(text: Column, most: int = 4) -> Column:
    """The first words without signs, in camel case; the first word is in small letters
    even where nothing is left of it and it is dropped."""
    def part(word: Column, place: Column) -> Column:
        clean = F.regexp_replace(word, "[^a-zA-Z0-9]", "")
        upper = F.concat(F.upper(F.substring(clean, 1, 1)), F.lower(F.substr(clean, F.lit(2))))
        return F.when(place == 0, F.lower(clean)).otherwise(upper)

    return F.array_join(F.filter(F.transform(F.slice(words(text), 1, most), part), lambda x: x != ""), "")


def text_hash(text: Column) -> Column:
    """The first eight hexadecimal digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 8)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def is_number(text: Column) -> Column:
    """Whether a script would read the whole text as a number: decimal, exponent, hexadecimal,
    octal, binary or Infinity, with white space around it."""
    decimal = r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    other = r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+"
    return trim(text).rlike(f"^(?:{decimal}|{other})$")


def classify(text: Column, unicode_space: bool = True) -> Column:
    """skip, translatable or identifier, by the first rule that fits; null for null.
    unicode_space=False reads ASCII white space only, as engines with another regex dialect do."""
    flag = "(?U)" if unicode_space else ""
    blank = trim(text) == "" if unicode_space else ~text.rlike(r"\S")
    spaced = text.contains(" ")
    listed = text.rlike(flag + r"^\s*[a-z][a-z0-9-]*(?:\s+[a-z][a-z0-9-]+)+\s*$")
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    rules = (
        (blank, "skip"),
        (is_number(text), "skip"),
        (text.isin("true", "false"), "skip"),
        (text.rlike("(?i)^https?://"), "skip"),
        (text.rlike(flag + r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "skip"),
        (text.rlike(r"^[0-9\s()\-+.]+$") & (digits >= 4), "skip"),
        (listed & text.rlike("[-0-9]"), "identifier"),
        (text.rlike(r"(?i)(/|\\|\.[a-z]{2,4}$)") & ~spaced, "skip"),
        (spaced, "translatable"),
        (text.rlike(r"^[$€£¥]\s?[0-9]+(?:\.[0-9]+)?$"), "translatable"),
        (text.rlike("^[A-Z][a-z]+$"), "translatable"),
    )
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for test, name in rules:
        out = out.when(test, name)
    return out.otherwise("identifier")


def locale_dir(code: Column) -> Column:
    return F.when(code.isin(*L.RTL_LOCALES), "rtl").otherwise("ltr")


def locale_label(code: Column) -> Column:
    out = F.when(code.isNull(), F.lit(None).cast("string"))
    for name, label in L.LOCALE_LABELS.items():
        out = out.when(code == name, label)
    return out.otherwise(F.upper(code))


def unescape_html(text: Column) -> Column:
    for entity, sign in L.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def major_version(version: Column) -> Column:
    """The first number of a version range, or null."""
    return F.nullif(F.regexp_extract(version, r"^[^0-9]*([0-9]+)", 1), F.lit("")).try_cast("int")


def relative_import(source: Column, target: Column) -> Column:
    """The import path from one file to another: ../ for each folder up, ./ where there is none, without extension."""
    a, b = F.split(F.regexp_replace(source, "/?[^/]*$", ""), "/"), F.split(F.regexp_replace(target, r"\.(?:jsx?|tsx?)$", ""), "/")
    a = F.filter(a, lambda x: x != "")
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))), lambda n: (n <= F.size(a)) & (F.slice(a, 1, n) == F.slice(b, 1, n))))
    up = F.size(a) - same
    rest = F.array_join(F.slice(b, same + 1, F.greatest(F.lit(0), F.size(b) - same)), "/")
    return F.concat(F.when(up > 0, F.repeat(F.lit("../"), up)).otherwise("./"), rest)


def component_path(path: Column) -> Column:
    """Whether a path is an application's root file."""
    return path.rlike(r"(?:App|_app)\.(?:js|jsx|ts|tsx)$|main\.(?:tsx|jsx|ts)$|index\.(?:js|jsx|tsx)$")


def is_component_name(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def in_data_folder(path: Column) -> Column:
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    out = path.contains(L.DATA_FOLDERS[0])
    for folder in L.DATA_FOLDERS[1:]:
        out |= path.contains(folder)
    return out
