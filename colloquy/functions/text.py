"""Scalar functions over text: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER = "[=]"

# The ranges, patterns and formats that results depend on.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
CJK = r"[一-龥]"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
URL = r"((http|https|ftp)://([\w\-]+\.)+[\w\-]+(/[\w\-\./\?%&\=]*)?)"
#: What Python's float() reads: digits with an optional point and exponent, infinity, not a number.
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?([eE][+-]?[0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*([eE][+-]?[0-9]+(_[0-9]+)*)?|(?i:nan|inf|infinity))$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """F1. Trim all white space at both ends (trim() takes spaces only, unless it is told what to take)."""
    return F.trim(col(x), F.lit(" \t\n\x0b\f\r"))


def split_fields(x: Column | str, delimiter: str = DELIMITER) -> Column:
    """F2. Split on a literal delimiter, trailing empty fields kept."""
    return F.split(col(x), "\\Q" + delimiter + "\\E", -1)


def join_fields(*xs: Column | str, delimiter: str = DELIMITER) -> Column:
    """F2. Join fields; null counts as empty."""
    return F.concat_ws(delimiter, *(F.coalesce(col(x).cast("string"), F.lit("")) for x in xs))


def split_list(x: Column | str) -> Column:
    """A comma list as an array without blanks; null and empty give an empty array (never [''])."""
    return F.filter(F.split(F.coalesce(col(x), F.lit("")), ",", -1), lambda v: F.trim(v) != "")


def trim_comma(x: Column | str) -> Column:
    """P3. Remove one trailing comma."""
    return F.regexp_replace(col(x), ",$", "")


def parse_time(x: Column | str, form: str = TIME_FORMAT) -> Column:
    """F3. Text to timestamp, null where it does not parse."""
    return F.try_to_timestamp(col(x), F.lit(form))


def format_time(x: Column | str, form: str = TIME_FORMAT) -> Column:
    """F17."""
    return F.date_format(col(x), form)


def first_date(x: Column | str) -> Column:
    """F12. The first yyyy-mm-dd in a text, as a date; null if there is none or it isn't one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(col(x), DATE, 0), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def count_cjk(x: Column | str) -> Column:
    """F4. Characters from U+4E00 to U+9FA5."""
    return F.coalesce(F.regexp_count(col(x), F.lit(CJK)), F.lit(0))


def remove_urls(x: Column | str) -> Column:
    """F5. Delete every URL where it stands. (A URL that begins another is not cut out of that other one.)"""
    return F.regexp_replace(col(x), URL, "")


def image_pattern(host: str) -> str:
    return "(http://" + host.replace(".", r"\.") + r"/.*\.jpg)"


def count_images(x: Column | str, host: str, lazy: bool = False) -> Column:
    """F6. Image links of a host. As stated, the pattern is greedy and finds 0 or 1 on a line; lazy counts each."""
    pattern = image_pattern(host)
    return F.coalesce(F.regexp_count(col(x), F.lit(pattern.replace(".*", ".*?") if lazy else pattern)), F.lit(0))


def external_link(x: Column | str, site: str) -> Column:
    """F7. 1 if any URL in the text has a host other than the site, else 0. Hosts compare in lower case."""
    urls = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(URL), F.lit(1))
    return F.exists(urls, lambda u: F.lower(F.regexp_extract(u, r"^\w+://([^/?#:]*)", 1)) != F.lit(site.lower())).cast("int")


def remove_newlines(x: Column | str, by: str = "") -> Column:
    """F14."""
    return F.regexp_replace(col(x), r"\r?\n", by)


def is_number(x: Column | str) -> Column:
    return strip(x).rlike(NUMBER)


def keep_token(t: Column, stop_words: list[str] | None = None) -> Column:
    """F9. Not empty, longer than one character, not a number, not a stop word."""
    kept = (F.length(t) > 1) & ~t.rlike(NUMBER)
    return kept & ~t.isin(*stop_words) if stop_words else kept


def tokens(x: Column | str, stop_words: list[str] | None = None, pattern: str = " ") -> Column:
    """F9. Lower-case, split, and keep what keep_token() keeps."""
    return F.filter(F.split(F.lower(F.coalesce(col(x), F.lit(""))), pattern, -1), lambda t: keep_token(t, stop_words))


def segment(x: Column | str) -> Column:
    """F8. Words of a text joined by spaces: runs of letters and digits, and for CJK runs their overlapping pairs.

    A stand-in where no dictionary segmenter is installed; segmenter() takes any Python callable instead.
    """
    runs = F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(r"[一-龥]+|[\p{L}\p{N}_&&[^一-龥]]+"), F.lit(0))
    pairs = lambda r: F.when(r.rlike("^" + CJK) & (F.length(r) > 2), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.array_join(F.flatten(F.transform(runs, pairs)), " ")


def segmenter(cut):
    """Y1. A Column function from a Python segmenter: a callable from text to words (a user dictionary is its own affair)."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(cut(t)))

    return lambda x: run(col(x))


def distance(a: Column | str, b: Column | str) -> Column:
    """F10. Euclidean distance of two arrays of double; null if their lengths differ."""
    a, b = col(a), col(b)
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def to_number(x: Column | str, kind: str = "double") -> Column:
    """F16. A cast that gives null where text is no number."""
    return strip(x).try_cast(kind)


def fixed(x: Column | str, places: int = 6) -> Column:
    """F18. Round as feature files show numbers."""
    return F.round(col(x).cast("double"), places)


def fold(n: int, seed: int, *keys: Column | str) -> Column:
    """F19. A fold, 0 to n - 1, that follows from keys and seed: the leading digits of their md5."""
    digest = F.md5(F.concat_ws("-", *(F.coalesce(col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def in_window(t: Column | str, start: str | None = None, end: str | None = None) -> Column:
    """P5, P6. start <= t < end; a bound that is None is no bound."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (col(t) >= F.to_timestamp(F.lit(start)))
    if end is not None:
        keep = keep & (col(t) < F.to_timestamp(F.lit(end)))
    return keep


def not_blank(x: Column | str) -> Column:
    """P15."""
    return F.coalesce(F.trim(col(x)) != "", F.lit(False))
