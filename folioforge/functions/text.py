"""Text functions whose white space is that of ECMAScript, which Java's classes do not match."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters one by one, for functions that take no pattern.
_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word that ends a sentence, with closing brackets and quotes after the mark.
SENTENCE_END = r"[.!?。！？][\]})\"'’”]*$"


def collapse(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """All words in order."""
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct lower-case terms of two characters or more; other than letters, digits and space separate."""
    cleaned = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{SPACE}]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, f"[{SPACE}]+"), lambda x: F.length(x) > 1))


def natural_key(text: Column) -> Column:
    """Sort key: lower case without accents, digit runs padded so that they order as numbers."""
    folded = F.lower(F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))
    parts = F.regexp_extract_all(folded, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def like_term(term: str) -> str:
    """Pattern of a case-insensitive contains; only the percent sign of the term is taken literally."""
    return "%" + term.replace("%", r"\%") + "%"


def text_for_index(title: Column, heading_path: Column, text: Column) -> Column:
    """What a chunk is indexed by: title, headings and text on lines of their own, blanks dropped."""
    headings = F.array_join(F.filter(heading_path, lambda h: h.isNotNull()), " › ")
    return F.array_join(F.filter(F.array(title, headings, text), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def passage_text(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def query_text(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def composed(text: Column) -> Column:
    """The text in composed form (NFC); Spark has no function for it, so it goes to Python in Arrow batches."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc(text)
