"""Column functions on flat series: `x` holds step `t`, channel `c` at index `t * n_ch + c`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import bad_parameter

SUM_DIGITS = 9  # window sums are compared at this precision, so float drift cannot break a tie


def _col(value: str | Column | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def format_array(x: str | Column) -> Column:
    """Flat array as text: elements joined by one blank."""
    return F.concat_ws(" ", F.transform(_col(x), lambda v: v.cast("string")))


def text_elements(text: str | Column) -> Column:
    """The blank-separated pieces of a bracketed text; no pieces for a blank text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"[\[\]]", ""), r"\s+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def parse_array(text: str | Column, steps: int, channels: int, strict: bool = True) -> Column:
    """Text to a flat array of `steps * channels` doubles.

    A wrong size or a piece that is no number raises; with `strict=False` such rows become null.
    """
    pieces = text_elements(text)
    values = F.transform(pieces, lambda v: v.try_cast("double"))
    good = (F.size(values) == steps * channels) & F.forall(values, lambda v: v.isNotNull())
    if not strict:
        return F.when(good, values)
    wrong_size = F.raise_error(F.concat(
        F.lit(f"Data does not match expected size ({steps}, {channels}). Found "),
        F.size(values).cast("string"), F.lit(" elements.")))
    return (F.when(good, values)
            .when(F.size(values) != steps * channels, wrong_size.cast("array<double>"))
            .otherwise(F.raise_error(F.lit("Text holds pieces that are no numbers")).cast("array<double>")))


def as_series(nested: str | Column) -> Column:
    """Nested `(T, C)` rows to the flat layout."""
    return F.flatten(_col(nested))


def single_series(batch: str | Column) -> Column:
    """A nested `(1, T, C)` batch to the flat layout; more or fewer than one series raises."""
    batch = _col(batch)
    flat = F.flatten(F.flatten(batch))
    return F.when(F.size(batch) == 1, flat).otherwise(
        F.raise_error(F.lit("expected a batch of exactly one series")).cast("array<double>"))


def nest_steps(x: str | Column, n_ch: str | Column | int) -> Column:
    """Flat layout to nested `(T, C)`."""
    x, n_ch = _col(x), _col(n_ch)
    steps = (F.size(x) / n_ch).cast("int")
    return F.transform(F.sequence(F.lit(0), steps - 1), lambda t: F.slice(x, t * n_ch + 1, n_ch))


def select_channels(x: str | Column, n_ch: str | Column | int, channels: Sequence[int] | None) -> Column:
    """Keep the listed channels in the listed order (`None` keeps all)."""
    x, n_ch = _col(x), _col(n_ch)
    if channels is None:
        return x
    if not channels or any(isinstance(c, bool) or not isinstance(c, int) or c < 0 for c in channels):
        raise bad_parameter("channels must be non-negative integers", got=channels, name="channels")
    steps = (F.size(x) / n_ch).cast("int")
    picked = F.flatten(F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda t: F.array(*[F.get(x, t * n_ch + c) for c in channels])))
    return F.when(F.lit(max(channels)) < n_ch, picked).otherwise(
        F.raise_error(F.lit(f"channel {max(channels)} is out of range")).cast("array<double>"))


def channels_first(x: str | Column, n_ch: str | Column | int) -> Column:
    """`(T, C)` to `(C, T)`, both flat."""
    x, n_ch = _col(x), _col(n_ch)
    steps = (F.size(x) / n_ch).cast("int")
    return F.transform(x, lambda _, i: F.get(x, (i % steps) * n_ch + (i / steps).cast("int")))


def slice_window(x: str | Column, n_ch: str | Column | int, start: str | Column | int,
                 length: str | Column | int) -> Column:
    """Steps `[start, start + length)`, cut off at the end of the series."""
    return F.slice(_col(x), _col(start) * _col(n_ch) + 1, _col(length) * _col(n_ch))


def splice_window(x: str | Column, donor: str | Column, n_ch: str | Column | int,
                  start: str | Column | int, length: str | Column | int) -> Column:
    """Replace the steps of a window by the donor's."""
    x, n_ch, start, length = _col(x), _col(n_ch), _col(start), _col(length)
    head = start * n_ch
    tail = (start + length) * n_ch
    return F.concat(F.slice(x, F.lit(1), head), slice_window(donor, n_ch, start, length),
                    F.slice(x, tail + 1, F.greatest(F.size(x) - tail, F.lit(0))))


def apply_mask(x: str | Column, donor: str | Column, mask: str | Column, n_ch: str | Column | int,
               start: str | Column | int) -> Column:
    """Inside the window covered by `mask` (row-major) take the donor's value where the bit is set."""
    x, donor, mask = _col(x), _col(donor), _col(mask)
    first = _col(start) * _col(n_ch)
    return F.transform(x, lambda v, i: F.when(
        (i >= first) & F.coalesce(F.get(mask, i - first).cast("boolean"), F.lit(False)),
        F.get(donor, i)).otherwise(v))


def minmax_weights(w: str | Column) -> Column:
    """Scale an array into [0, 1]; a constant array becomes zeros."""
    w = _col(w)
    low, high = F.array_min(w), F.array_max(w)
    return F.when(high > low, F.transform(w, lambda v: (v - low) / (high - low))).otherwise(
        F.transform(w, lambda v: F.lit(0.0)))


def argmax_index(p: str | Column) -> Column:
    """Index of the largest element, first on ties."""
    p = _col(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


peak_step = argmax_index
pred_label = argmax_index


def confidence(p: str | Column) -> Column:
    """The largest class probability."""
    return F.array_max(_col(p))


def target_proba(p: str | Column, label: str | Column) -> Column:
    """The probability of one class."""
    return F.get(_col(p), _col(label))


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def euclidean(x: str | Column, y: str | Column) -> Column:
    """Euclidean distance of two equally long arrays."""
    return F.sqrt(total(F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b))))


def manhattan(x: str | Column, y: str | Column) -> Column:
    """Sum of absolute differences of two equally long arrays."""
    return total(F.zip_with(_col(x), _col(y), lambda a, b: F.abs(a - b)))


def violation(g: str | Column) -> Column:
    """Total constraint violation; feasible rows have none."""
    g = _col(g)
    return F.greatest(g, F.lit(0.0))


def max_sum_start(w: str | Column, length: str | Column | int) -> Column:
    """First step of the window with the largest sum, first on ties; 0 if the window covers everything.

    Sums are compared to `SUM_DIGITS` digits of the row's largest weight, so that the scale of the weights is no matter.
    """
    w, length = _col(w), _col(length)
    largest = F.array_max(F.transform(w, lambda v: F.abs(v)))
    unit = F.when(largest > 0, largest).otherwise(F.lit(1.0))
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.size(w) - length),
        lambda s: F.struct(F.round(total(F.slice(w, s + 1, length)) / unit, SUM_DIGITS).alias("sum"),
                           (-s).alias("back"))))
    return F.when(length >= F.size(w), F.lit(0)).otherwise(-best["back"])
