"""News text: headlines, datelines, cleaning, folding and fixed-size features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinoooooouuuuyy"
URL = r"https?://[^ ]+"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE = r"\+?[0-9][0-9() .-]{7,}[0-9]"


def plain_headline(headline: Column) -> Column:
    """Without leading digits."""
    return F.regexp_replace(headline, r"^[0-9]+", "")


def update_number(headline: Column) -> Column:
    """n of ``UPDATE n-``; 0 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(headline, r"UPDATE ([0-9]+)-", 1), F.lit("")), F.lit("999999")).cast("long"), F.lit(0))


def without_update(headline: Column) -> Column:
    return F.regexp_replace(headline, r"UPDATE [0-9]+-", "")


def without_spaces(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def trim_dateline(body: Column, mark: str = "(Reuters)") -> Column:
    """The text from the agency's mark on; all of it without one."""
    at = F.locate(mark, body)
    return F.when(at > 0, F.substring(body, at, F.length(body))).otherwise(body)


def clean_text(text: Column) -> Column:
    """Lower case, no line breaks, placeholders for addresses and numbers, accents folded; digits and punctuation stay."""
    one_line = F.regexp_replace(F.lower(text), r"[\r\n]+", " ")
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(one_line, URL, "<url>"), EMAIL, "<email>"), PHONE, "<phone>")
    return F.translate(masked, ACCENTED, FOLDED)


def summary_prefix(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def text_embedding3(text: Column) -> Column:
    """Length / 1000, sum of code points modulo 997 / 997, line breaks / 100."""
    points = F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.array(F.length(text) / 1000, (points % 997) / 997, breaks / 100)


def padded_id(number: Column, width: int = 10) -> Column:
    return F.lpad(number.cast("string"), width, "0")
