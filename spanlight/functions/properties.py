"""The packed property word of a point: bits 0-7 class, bit 8 highlighted, bit 9 obstacle, bit 10 shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HIGHLIGHT, OBSTACLE, DISPLAY = 8, 9, 10
DEFAULT = 1 << DISPLAY


def pack(seg_type: Column, highlight: Column, obstacle: Column, display: Column) -> Column:
    bit = lambda c, n: F.when(c, 1 << n).otherwise(0)
    return seg_type.bitwiseAND(255).bitwiseOR(bit(highlight, HIGHLIGHT)).bitwiseOR(bit(obstacle, OBSTACLE)).bitwiseOR(bit(display, DISPLAY))


def segment(word: Column) -> Column:
    return word.bitwiseAND(255)


def flag(word: Column, bit: int) -> Column:
    return F.shiftright(word, bit).bitwiseAND(1) == 1


def with_segment(word: Column, seg_type: Column | int, shown_only: bool = True) -> Column:
    """The word with another class; hidden points keep theirs if asked so."""
    new = word.bitwiseAND(~255).bitwiseOR(seg_type if isinstance(seg_type, Column) else F.lit(seg_type))
    return F.when(flag(word, DISPLAY), new).otherwise(word) if shown_only else new


def with_flag(word: Column, bit: int, on: bool) -> Column:
    return word.bitwiseOR(F.lit(1 << bit)) if on else word.bitwiseAND(F.lit(~(1 << bit)))


def hidden(word: Column, hide: list[int] | None = ()) -> Column:
    """The display bit is off or the class is in the list; everything is hidden without a list."""
    if hide is None:
        return F.lit(True)
    return ~flag(word, DISPLAY) | (segment(word).isin(*hide) if hide else F.lit(False))
