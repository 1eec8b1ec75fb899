"""Names, words and display text."""

import difflib
import unicodedata
from collections import deque

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Characters that part words.
SEPARATORS = r"-_&+():;\[]{}.,<>/?~!@#$*"


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition, for the texts that aren't ASCII."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def decomposed(text: Column) -> Column:
    """The text in canonical decomposition, null as empty; only what isn't ASCII says anything to Python."""
    plain = F.coalesce(text, F.lit(""))
    ascii_ = F.octet_length(plain) == F.char_length(plain)
    return F.when(ascii_, plain).otherwise(nfd(F.when(~ascii_, plain)))


def words(text: Column, ascii_only: bool = False) -> Column:
    """Words of a name. Separators become spaces, marks up to U+037E vanish, the cut is at single spaces; null has none.

    ``ascii_only`` skips the decomposition, which keeps the expression in the JVM.
    """
    plain = F.coalesce(text, F.lit("")) if ascii_only else decomposed(text)
    spaced = F.lower(F.translate(plain, SEPARATORS, " " * len(SEPARATORS)))
    kept = F.regexp_replace(spaced, r"[^A-Za-z0-9\s\x{037F}-\x{10FFFF}]", "")
    return F.filter(F.split(kept, " "), lambda w: w != "")


def fields(text: Column, ascii_only: bool = False) -> Column:
    """Words of each part between " - "; parts without words vanish."""
    plain = F.coalesce(text, F.lit("")) if ascii_only else decomposed(text)
    return F.filter(F.transform(F.split(plain, " - "), lambda part: words(part, ascii_only=True)), lambda w: F.size(w) > 0)


def unpack_fields(parts: Column) -> Column:
    """C3."""
    return F.flatten(parts)


def _count(a: Column, w: Column) -> Column:
    return F.size(F.filter(a, lambda x: x == w))


def common_words(first: Column, second: Column, weighted: bool = False) -> Column:
    """Size of the multiset intersection, in words or characters."""
    zero = F.lit(0)
    times = lambda w: F.least(_count(first, w), _count(second, w))
    return F.aggregate(F.array_distinct(first), zero, lambda acc, w: acc + times(w) * (F.length(w) if weighted else F.lit(1)))


def _in_order(first: Column, second: Column) -> Column:
    """Whether the words of ``first`` that match are the head of ``second``."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"), second.alias("rest"))

    def step(acc: Column, w: Column) -> Column:
        at = F.array_position(acc["rest"], w).cast("int")
        rest = F.concat(F.slice(acc["rest"], F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc["rest"], at + 1, F.size(acc["rest"])))
        return F.when(at > 0, F.struct((acc["n"] + 1).alias("n"), (acc["ok"] & (at == 1)).alias("ok"), rest.alias("rest"))).otherwise(acc)

    return F.aggregate(first, start, step)["ok"]


def compare(first: Column, second: Column, weighted: bool = False, ordered: bool = True) -> Column:
    """C4: percentage of words in common, 0 if either has none; 99 for all in another order."""
    size = (lambda a: F.aggregate(a, F.lit(0), lambda n, w: n + F.length(w))) if weighted else F.size
    total = size(first) + size(second)
    pct = F.bround(F.lit(200.0) * common_words(first, second, weighted) / F.nullif(total, F.lit(0))).cast("int")
    if ordered:
        pct = F.when((pct == 100) & ~_in_order(first, second), 99).otherwise(pct)
    return F.when((F.size(first) == 0) | (F.size(second) == 0), 0).otherwise(pct)


def compare_fields(first: Column, second: Column) -> Column:
    """C5 with fields in order: the least of the fields' percentages; 0 for different numbers of fields or none."""
    least = F.array_min(F.zip_with(first, second, lambda a, b: compare(a, b)))
    return F.when((F.size(first) != F.size(second)) | (F.size(first) == 0), 0).otherwise(least)


def taken_places(first: list, second: list, similar: bool = True) -> list[int]:
    """Which places of ``second`` the words of ``first`` take, one after the other: the first free one of an equal word, else of the closest word."""
    free: dict = {}
    for k, w in enumerate(second):
        free.setdefault(w, deque()).append(k)
    out = []
    for w in first:
        if w not in free and similar:
            w = next(iter(difflib.get_close_matches(w, list(free), 1, 0.8)), None)
        if w in free:
            out.append(free[w].popleft())
            if not free[w]:
                del free[w]
    return out


def words_percentage(first: list, second: list, similar: bool = True, weighted: bool = False) -> int:
    """C4 of two word lists: twice the share that taken words have in all, 99 for all unless they are taken from the front on."""
    if not first or not second:
        return 0
    places = taken_places(first, second, similar)
    size = (lambda ws: sum(map(len, ws))) if weighted else len
    share = round(200 * size([second[k] for k in places]) / (size(first) + size(second)))
    return 99 if share == 100 and places != list(range(len(places))) else share


@F.pandas_udf(IntegerType())
def compare_similar(first: pd.Series, second: pd.Series) -> pd.Series:
    """C4 with close matches of at least 0.8 (Ratcliff-Obershelp) standing in for words that are missing."""
    return pd.Series([words_percentage(list(a), list(b)) if a is not None and b is not None else 0 for a, b in zip(first, second, strict=True)], dtype="int32")


@F.pandas_udf(IntegerType())
def compare_fields_any_order(first: pd.Series, second: pd.Series) -> pd.Series:
    """C5 in any order: each field of the first takes its best unused field of the second; the least of these."""
    out = []
    for a, b in zip(first, second, strict=True):
        a, b = [list(x) for x in a if x is not None], [list(x) for x in b if x is not None]
        if len(a) != len(b) or not a:
            out.append(0)
            continue
        free, least = list(range(len(b))), 100
        for x in a:
            scores = [words_percentage(x, b[k], similar=False) for k in free]
            best = max(scores)
            least = min(least, best)
            if best > 0:
                free.pop(scores.index(best))
        out.append(least)
    return pd.Series(out, dtype="int32")


def file_name(path: Column) -> Column:
    """B1."""
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """B1."""
    return F.regexp_replace(path, r"(?s)/[^/]*$", "")


def extension(name: Column) -> Column:
    """B2: lower-cased text behind the last dot, else empty."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def without_extension(name: Column) -> Column:
    """B3."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def same_with_digit(name: Column, ref: Column) -> Column:
    """Whether the name is the other with a number, bare or in brackets, behind."""
    rest = F.trim(F.substring(name, F.length(ref) + 1, 10_000))
    return F.startswith(name, ref) & rest.rlike(r"^(\d+|\(\d+\)|\[\d+\]|\{\d+\})")


def multi_replace(text: Column, old: str, new: str = "") -> Column:
    """Each character of ``old`` by the one of ``new`` at its place; those beyond the end of ``new`` vanish."""
    return F.translate(text, old, new if len(new) != 1 else new * len(old))


def all_same(values: Column) -> Column:
    """C8."""
    return F.size(F.array_distinct(values)) <= 1


UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def format_size(size: Column, decimals: int = 0, power: int | None = None, unit: bool = True) -> Column:
    """Size by powers of 1024; its amount is rounded up, whatever the sign."""
    p = F.lit(power) if power is not None else F.when(F.abs(size) < 1024, 0).otherwise(F.floor(F.log2(F.abs(size)) / 10)).cast("int")
    if power is None:
        for k in range(1, 7):  # logarithms may miss an exact power by one bit
            p = F.when(F.abs(size) == F.lit(float(1024**k)), k).otherwise(p)
    value = F.ceil(F.abs(size) / F.pow(F.lit(1024.0), p) * 10**decimals) / 10**decimals
    text = F.concat(F.when(size < 0, "-").otherwise(""), F.format_string(f"%.{decimals}f", value.cast("double")))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), p + 1)) if unit else text


def format_time(seconds: Column, with_hours: bool = True) -> Column:
    """C10."""
    s = F.abs(seconds.cast("long"))
    sign = F.when(seconds < 0, "-").otherwise("")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    long_ = lambda x: F.when(x < 100, two(x)).otherwise(x.cast("string"))
    if with_hours:
        return F.concat(sign, long_(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.concat(sign, long_(F.floor(s / 60)), F.lit(":"), two(s % 60))


def plural(number: Column, word: str, decimals: int = 0, many: str | None = None) -> Column:
    """Number and word, the word's plural for anything over one."""
    n = F.round(number, decimals)
    shown = F.format_string(f"%.{decimals}f", n.cast("double"))
    return F.concat(shown, F.lit(" "), F.when(n > 1, F.lit(many or word + "s")).otherwise(F.lit(word)))


def format_time_decimal(seconds: Column) -> Column:
    """In the largest of seconds, minutes, hours and days that it reaches."""
    unit = lambda div, word: plural(seconds / div, word, 1)
    a = F.abs(seconds)
    return F.when(a < 60, unit(1, "second")).when(a < 3600, unit(60, "minute")).when(a < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def format_timestamp(epoch: Column) -> Column:
    """C11: nothing to show before 1970."""
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy/MM/dd HH:mm:ss")).otherwise("---")


def format_percentage(p: Column) -> Column:
    return F.format_string("%.0f", F.bround(p.cast("double")))


def format_words(w: Column) -> Column:
    return F.array_join(w, ", ")


def sort_value(c: Column) -> Column:
    """C12."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def scalar_text(c: Column) -> Column:
    """Characters that XML can't hold become U+FFFD."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "�")


def format_dimensions(d: Column) -> Column:
    """C42."""
    return F.concat(d["w"].cast("string"), F.lit(" x "), d["h"].cast("string"))


def delta_dimensions(d: Column, ref: Column) -> Column:
    return F.struct((d["w"] - ref["w"]).alias("w"), (d["h"] - ref["h"]).alias("h"))


WORDS = ArrayType(StringType())
