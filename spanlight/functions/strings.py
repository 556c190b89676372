"""String and path functions. Places count from 0; -1 where nothing is found."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def find(s: Column, part: str) -> Column:
    return F.instr(s, part) - 1


def reverse_find(s: Column, part: str) -> Column:
    """Start of the last occurrence."""
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at > 0, F.length(s) - at - len(part) + 1).otherwise(-1)


def find_one_of(s: Column, chars: str) -> Column:
    """Place of the first character that is one of these."""
    places = F.array_compact(F.array(*[F.nullif(F.instr(s, c), F.lit(0)) for c in chars]))
    return F.coalesce(F.array_min(places) - 1, F.lit(-1))


def mid(s: Column, start: int, count: int | None = None) -> Column:
    return F.substring(s, start + 1, 1 << 30 if count is None else count)


def left(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def insert(s: Column, at: int, part: str) -> Column:
    return F.overlay(s, F.lit(part), at + 1, 0)


def delete(s: Column, at: int, n: int) -> Column:
    return F.overlay(s, F.lit(""), at + 1, n)


def remove(s: Column, char: str) -> Column:
    return F.translate(s, char, "")


def span_including(s: Column, chars: str) -> Column:
    """The longest start that has only these characters."""
    return F.regexp_extract(s, f"^[{_class(chars)}]*", 0)


def span_excluding(s: Column, chars: str) -> Column:
    return F.regexp_extract(s, f"^[^{_class(chars)}]*", 0)


def _class(chars: str) -> str:
    return "".join("\\" + c if c in r"\^]-[&" else c for c in chars)


def words(s: Column, separator: str = " ") -> Column:
    return F.filter(F.split(s, _class(separator) if len(separator) == 1 and separator in r"|.^$*+?()[]{}\\" else separator), lambda w: w != "")


def count_words(s: Column, separator: str = " ") -> Column:
    return F.size(words(s, separator))


def word(s: Column, i: int, separator: str = " ") -> Column:
    """The i-th word, empty if there is none."""
    return F.coalesce(F.try_element_at(words(s, separator), F.lit(i + 1)), F.lit(""))


def is_number(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))


def trim_number(s: Column) -> Column:
    """A decimal without trailing zeros, and without its point if nothing follows."""
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def compare_versions(a: Column, b: Column, parts: int = 3) -> Column:
    """-1, 0 or 1 by the first ``parts`` dotted numbers; missing ones are 0."""
    number = lambda v, i: F.coalesce(F.try_element_at(F.split(v, r"\."), F.lit(i + 1)).try_cast("int"), F.lit(0))
    out = F.lit(0)
    for i in reversed(range(parts)):
        x, y = number(a, i), number(b, i)
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def csv_numbers(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda v: F.trim(v).try_cast("double"))


def to_csv_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ", ")


def extension(path: Column) -> Column:
    """With its dot; empty if the last part has none."""
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"[/\\]+$", ""), r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+$", ""), r"[/\\]?[^/\\]*$", "")


def joined_path(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, r"/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def relative_path(path: Column, base: str) -> Column:
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def format_bytes(n: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%d B", n)
    for i in range(1, len(units)):
        out = F.when(n >= 1024**i, F.format_string("%.2f " + units[i], n / 1024**i)).otherwise(out)
    return out
