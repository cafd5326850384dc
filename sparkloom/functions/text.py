"""Text and number functions: clock times, bout lines, captions, names of the closed vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary

# Patterns of a bout line and of a win caption, and the glyphs that readers confuse.
BOUT_LINE = r"(?iU)^\s*((?:\d{1,2}:)?\d{1,2}:\d{2})\s*[-–—:]?\s+([A-Za-z][\w'\-\.]*)\s+(?:vs?\.?)\s+([A-Za-z][\w'\-\.]*)"
CAPTION = r"(?i)([A-Z0-9][A-Za-z0-9]{2,})\s*WIN5?S?\s*[8B]Y\s*(?:[A4](?=[A-Z]{4}))?([A-Za-z0-9!|\[\]/\\]+)"
CAPTION_WHOLE = r"(?i)([A-Z0-9][A-Za-z0-9]{2,})\s*WIN5?S?\s*[8B]Y\s*([A-Za-z0-9!|\[\]/\\]+)"
GLYPHS = ("1!|[]/\\05862", "IIIIIIIOSBGZ")
FOLD = ("ōūāēī'- _", "ouaei")
GROUP = r"(?is)^(.*?)(?:__|_clip\d+|_seg\d+|_part\d+)"


def to_seconds(clock: Column) -> Column:
    """Seconds of ``[h:]mm:ss``; null if it isn't one."""
    part = F.split(clock, ":")
    digits = F.transform(part, lambda x: x.try_cast("int"))
    return F.when(F.size(part) == 2, digits[0] * 60 + digits[1]).when(F.size(part) == 3, F.get(digits, F.lit(0)) * 3600 + F.get(digits, F.lit(1)) * 60 + F.get(digits, F.lit(2)))


def bout_line(line: Column) -> Column:
    """struct(start, east, west) of a description line; null if it's no bout."""
    field = lambda i: F.regexp_extract(line, BOUT_LINE, i)
    return F.when(line.rlike(BOUT_LINE), F.struct(to_seconds(field(1)).alias("start"), field(2).alias("east"), field(3).alias("west")))


def glyph_repair(token: Column) -> Column:
    return F.translate(token, *GLYPHS)


def fold(name: Column) -> Column:
    """Lower case without long vowels, apostrophes, hyphens and blanks."""
    return F.translate(F.lower(F.trim(name)), *FOLD)


def normalize(name: Column, entries: Sequence[tuple] | None = None) -> Column:
    """The vocabulary's name: kanji, then exact after folding, then the first with a common prefix and at most two
    characters more or less; else null.  The vocabulary is a small fixed list, so it's part of the expression."""
    entries = vocabulary.entries() if entries is None else entries
    kanji = F.create_map(*[F.lit(x) for e in entries for x in (e[2], e[1])])
    names = F.array(*[F.lit(e[1]) for e in entries])

    def found(key: Column) -> Column:
        near = F.filter(names, lambda n: (key.startswith(n) | n.startswith(key)) & (F.abs(F.length(key) - F.length(n)) <= 2))
        return F.coalesce(F.try_element_at(kanji, F.trim(name)), F.when(F.array_contains(names, key), key), F.get(near, F.lit(0)))

    # transform of one element: the name is folded once, not for every entry
    return F.when(F.length(F.trim(name)) > 0, F.transform(F.array(fold(name)), found)[0])


def ocr_readings(token: Column) -> Column:
    """Candidate readings in order: raw, glyphs repaired, first I as T, J or D between vowels as T, first glyph lost."""
    fixed = glyph_repair(token)
    return F.array(token, fixed, F.regexp_replace(fixed, "^([^I]*)I", "$1T"), F.regexp_replace(fixed, "(?<=[AEIOU])[JD](?=[AEIOU])", "T"), F.substr(fixed, F.lit(2)))


def normalize_ocr(token: Column) -> Column:
    """The first reading that is in the vocabulary."""
    return F.get(F.filter(F.transform(ocr_readings(token), lambda c: normalize(c)), lambda x: x.isNotNull()), F.lit(0))


def caption(text: Column, strict: bool = False) -> Column:
    """struct(winner, technique) of a win caption, technique null if unknown.

    A glued glyph before the technique may be noise or its own first letter, so both readings are tried; ``strict``
    keeps only the one that drops it.
    """
    token = lambda p: F.regexp_extract(text, p, 2)
    hit = normalize_ocr(token(CAPTION))
    if not strict:
        hit = F.coalesce(hit, normalize_ocr(token(CAPTION_WHOLE)))
    return F.when(text.rlike(CAPTION), F.struct(title(F.regexp_extract(text, CAPTION, 1)).alias("winner"), hit.alias("technique")))


def title(text: Column) -> Column:
    """Title case where every run of letters starts anew, behind digits and apostrophes too."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)\p{L}+|[^\p{L}]+"), F.lit(0)), lambda x: F.concat(F.upper(F.substr(x, F.lit(1), F.lit(1))), F.substr(x, F.lit(2)))), "")


def group_of(stem: Column) -> Column:
    """The source id of a clip name: what stands before the first clip suffix, else the name."""
    return F.when(stem.rlike(GROUP), F.regexp_extract(stem, GROUP, 1)).otherwise(stem)


def clip_key(video: Column, n: Column) -> Column:
    return F.format_string("%s__%02d", video, n)


def mmss(seconds: Column) -> Column:
    return F.format_string("%dm%02ds", F.floor(seconds / 60), F.floor(seconds % 60))


def listing(line: Column) -> Column:
    """struct(video, duration) of ``id|duration``; null without a bar, duration 0 if it's no number."""
    part = F.split(line, r"\|", 2)
    return F.when(F.size(part) == 2, F.struct(part[0].alias("video"), F.coalesce(part[1].try_cast("double"), F.lit(0.0)).cast("int").alias("duration")))


def round2(x: Column) -> Column:
    """Rounded to two places by the exact binary value, ties to even, as label tables are written (2.675 is 2.67).

    The product with 100 is taken with its rounding error (by splitting x in halves of 26 bits); values of 2^45 or
    more, and what isn't finite, stay as they are.
    """
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    product = x * 100
    error = (high * 100 - product) + (x - high) * 100
    whole = F.floor(product).cast("double")
    part = product - whole  # exact
    up = (part > 0.5) | ((part == 0.5) & (error > 0)) | ((part == 0.5) & (error == 0) & (whole % 2 != 0))
    return F.when(F.abs(x) < float(1 << 45), F.when(up, (whole + 1) / 100).otherwise(whole / 100)).otherwise(x)


def utf8(raw: Column) -> Column:
    """Bytes as text; broken ones become U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def spread(n: Column, k: int) -> Column:
    """``k`` evenly spaced indices of ``n`` rows with both ends, halves to even; repeats if n < k."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max(1, k - 1))).cast("int"))


def upper_median(values: Column) -> Column:
    """Middle value of an array, the upper one of two: not interpolated."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def box_pixels(box: Column, width: Column, height: Column) -> Column:
    """Fractional box (x0, y0, x1, y1) as pixels (x, y, w, h), at least 2 wide and high."""
    px = lambda v: F.floor(v).cast("int")
    return F.struct(px(box["x0"] * width).alias("x"), px(box["y0"] * height).alias("y"), F.greatest(F.lit(2), px((box["x1"] - box["x0"]) * width)).alias("w"), F.greatest(F.lit(2), px((box["y1"] - box["y0"]) * height)).alias("h"))


def mask_filter(boxes: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """Drawing commands that black out boxes, widened by a margin and clamped to the frame."""
    one, none, m = F.lit(1.0), F.lit(0.0), F.lit(margin)

    def draw(b: Column) -> Column:
        x, y = F.greatest(none, b["x0"] - m), F.greatest(none, b["y0"] - m)
        w, h = F.least(one, b["x1"] + m) - x, F.least(one, b["y1"] + m) - y
        return F.format_string("drawbox=x=%d:y=%d:w=%d:h=%d:color=black:t=fill", *(F.floor(v * s) for v, s in ((x, width), (y, height), (w, width), (h, height))))

    return F.array_join(F.transform(boxes, draw), ",")


def standardized(values: Column) -> Column:
    """(x - mean) / population deviation of an array; a deviation of 0 counts as 1."""
    n = F.size(values)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    named = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  computed once, not for every number
    centred = lambda mean: F.transform(values, lambda x: x - mean)

    def scaled(gaps: Column) -> Column:
        dev = F.sqrt(total(F.transform(gaps, lambda x: x * x)) / n)
        return named(F.when(dev > 0, dev).otherwise(F.lit(1.0)), lambda d: F.transform(gaps, lambda x: x / d))

    return named(total(values) / n, lambda mean: named(centred(mean), scaled))
