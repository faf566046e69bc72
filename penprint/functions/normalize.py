"""Text normalization as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split sees it; (?U) alone lacks U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC. Plain ASCII rows skip Python altogether."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def ligatures(c: Column) -> Column:
    for one, many in (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        c = F.replace(c, F.lit(one), F.lit(many))
    return c


def quotes(c: Column) -> Column:
    return F.translate(c, "‘’“”", "''\"\"")


def dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("--")), F.lit("—"), F.lit("---"))


def white_space(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?U)[[\s\x1c-\x1f]&&[^\n]]+", " ")
    return F.regexp_replace(c, r" +\n", "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def normalize(c: Column) -> Column:
    """NFC, ligatures, quotes, dashes, white space, strip, in this order. Null stays null."""
    return strip(white_space(dashes(quotes(ligatures(nfc(c))))))


def document_id(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text's UTF-8."""
    return F.substring(F.sha2(text, 256), 1, 16)


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def strip_book_frame(text: Column) -> Column:
    """The lines after the first start marker and before the last end marker of an e-book, stripped; a missing marker cuts nothing."""

    def marked(what):
        return lambda line: F.upper(line).rlike(rf"\*\*\* ?{what} OF")

    lines = F.split(text, "\n")
    size = F.size(lines)
    first = F.array_position(F.transform(lines, marked("START")), True)
    last = F.array_position(F.reverse(F.transform(lines, marked("END"))), True)
    end = F.when(last > 0, size - last).otherwise(size)
    kept = F.when(end > first, F.slice(lines, (first + 1).cast("int"), (end - first).cast("int"))).otherwise(F.array().cast("array<string>"))
    return strip(F.array_join(kept, "\n"))
