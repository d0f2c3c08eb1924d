"""Binning and rounding expressions. All are JVM-side columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the age groups above 21; up to 21 every year is its own group.
AGE_BOUNDS = (22, 25, 30, 35, 40, 45, 50, 55, 60, 62, 65, 67, 70, 75, 80, 85)
# Block population classes, right-closed and left-closed.
BLOCK_SIZE_RIGHT = ((0, 9, "1-9"), (9, 49, "10-49"), (49, 99, "50-99"), (99, 249, "100-249"), (249, 499, "250-499"), (499, 999, "500-999"), (999, 1_000_000, "1000+"))
BLOCK_SIZE_LEFT = (0, 10, 50, 100, 250, 500, 1000, 100_000)
COUNTY_SIZE = (0, 1000, 5000, 10_000, 50_000, 100_000)
PLACE_SIZE = (0, 500, 1000, 5000, 10_000, 50_000, 100_000)


def age_bin(age: Column) -> Column:
    """Lower bound of the age group; null stays null."""
    out = F.when(age <= 21, age)
    for lo, hi in zip(AGE_BOUNDS, AGE_BOUNDS[1:], strict=False):
        out = out.when(age < hi, F.lit(lo))
    return F.when(age.isNotNull(), out.otherwise(F.lit(AGE_BOUNDS[-1])))


def right_closed(x: Column, classes: Sequence[tuple] = BLOCK_SIZE_RIGHT) -> Column:
    """Label of the class (low, high] that holds x; null outside all."""
    out = None
    for low, high, label in classes:
        cond = (x > low) & (x <= high)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def left_closed(x: Column, edges: Sequence[float], labels: Sequence | None = None, top: float | None = None) -> Column:
    """Label (by default the lower edge) of [edge, next edge); the last class is open unless ``top`` ends it."""
    labels = list(labels) if labels is not None else list(edges)
    out = F.when(x < edges[0], F.lit(None))
    for high, label in zip(edges[1:], labels, strict=False):
        out = out.when(x < high, F.lit(label))
    last = F.lit(labels[len(edges) - 1])
    return out.when(x < top, last) if top is not None else out.when(x.isNotNull(), last)


def significant(x: Column, digits: int = 4, coarsest: int = 9) -> Column:
    """x rounded to so many significant digits, but never coarser than to 10 to the power ``coarsest``; 0 below 1e-8; a ladder of literal scales, as round() takes no column for its scale."""
    a = F.abs(x)
    out = F.when(a >= 10.0 ** (digits - 1 + coarsest), F.round(x, -coarsest))
    for scale in range(1 - coarsest, 12):
        out = out.when(a >= 10.0 ** (digits - 1 - scale), F.round(x, scale))
    return out.when(a.isNotNull(), F.lit(0.0))


def percent_half_even(part: Column, whole: Column) -> Column:
    """100 * part / whole, one digit, ties to even; null where whole is 0."""
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1)


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def with_unit(x: Column, digits: int = 1, units: Sequence[tuple[int, str]] = ((12, "T"), (9, "G"), (6, "M"), (3, "K"))) -> Column:
    """A number with a letter for thousands, millions, billions or trillions, such as 1.5K; smaller ones as they are. ``units`` are powers of ten and their letters, largest first."""
    a = F.abs(x.cast("double"))
    out = None
    for power, letter in units:
        cell = F.concat(F.format_string(f"%.{digits}f", x.cast("double") / 10.0**power), F.lit(letter))
        out = F.when(a >= 10.0**power, cell) if out is None else out.when(a >= 10.0**power, cell)
    return out.otherwise(F.format_string("%.0f", x.cast("double")))


# Group quarters type codes by their first digit.
GQ_MAJOR = ("Correctional", "Juvenile", "Nursing", "OtherInst", "College", "Military", "OtherNoninst")


def gq_institution(code: Column) -> Column:
    """INST for group quarters types 100 to 498, NONINST for 499 to 998, null for others (households have 0)."""
    return left_closed(F.when(code >= 100, code), (100, 499), ("INST", "NONINST"), 999)


def gq_major(code: Column) -> Column:
    """One of seven major types of group quarters by the hundreds of the code, null outside 100 to 998."""
    return left_closed(F.when(code >= 100, code), (100, 200, 300, 400, 500, 600, 700), GQ_MAJOR, 999)


def ordinal(label: Column, order: Sequence[str]) -> Column:
    """Place of a label in a given order, for sorting; labels that are not in it come last."""
    found = F.array_position(F.array(*map(F.lit, order)), label)
    return F.when(found > 0, found.cast("int")).otherwise(F.lit(len(order) + 1))


def relabelled(label: Column, names: dict[str, str]) -> Column:
    """Labels exchanged by a small table; others stay."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), label) if pairs else label


def stars(estimate: Column, error: Column) -> Column:
    """Significance stars by the normal quantiles of 10, 5 and 1 percent."""
    t = F.abs(F.try_divide(estimate.cast("double"), error.cast("double")))
    return F.when(t >= 2.576, "***").when(t >= 1.96, "**").when(t >= 1.645, "*").otherwise("")


def signed_percent_difference(h: Column, m: Column) -> Column:
    """(m - h) / h; 0 where both are 0; over the mean where only h is 0 (so 2)."""
    h, m = h.cast("double"), m.cast("double")
    return F.when((h == 0) & (m == 0), F.lit(0.0)).when(h == 0, (m - h) / ((h + m) / 2)).otherwise(F.try_divide(m - h, h))
