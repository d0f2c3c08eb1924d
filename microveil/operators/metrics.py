"""Accuracy of one file against another over geography and characteristics, suppression, distances of histograms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microveil.functions.bins import percent_half_even, signed_percent_difference
from microveil.operators.tabulate import counted, total


def differences(h: DataFrame, m: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Full outer join of two counts with 0 for what is missing: h, m, diff, abs_diff, perc_diff, abs_perc_diff."""
    both = h.select(*keys, F.col(name).alias("h")).join(m.select(*keys, F.col(name).alias("m")), list(keys), "full").na.fill(0, ["h", "m"])
    p = signed_percent_difference(F.col("h"), F.col("m")) * 100
    return both.withColumns({"diff": F.col("m") - F.col("h"), "perc_diff": p}).withColumns({"abs_diff": F.abs("diff"), "abs_perc_diff": F.abs("perc_diff")})


def _ranks(n: Column, share: float, rule: str) -> tuple[Column, Column, Column]:
    """The two ranks from 0 between which a percentile lies, and how far towards the second.

    "linear" goes to (n - 1) * share, between neighbours in proportion. "averaged" takes the mean of the values in places
    n * share and the next one (from 1) where that is a whole number, else the one in the next place after it.
    """
    if rule == "linear":
        place = (n - 1) * F.lit(float(share))
        return F.floor(place), F.ceil(place), place - F.floor(place)
    if rule != "averaged":
        raise ValueError(f"no such rule: {rule}")
    place = F.round(n * F.lit(float(share)), 9)
    low = F.greatest(F.ceil(place).cast("long") - 1, F.lit(0))
    whole = (place == F.floor(place)) & (place > 0) & (place < n)
    return low, F.when(whole, low + 1).otherwise(low), F.lit(0.5)


def _at(column: str, place: Column) -> Column:
    """The value of the rank ``place`` among counts by value: _c, _v, _f and _upto."""
    return F.max(F.when((F.col("_c") == column) & (F.col("_upto") - F.col("_f") <= place) & (F.col("_upto") > place), F.col("_v")))


def _percentile(column: str, share: float, rule: str) -> Column:
    low, high, part = _ranks(F.col("_n"), share, rule)
    part = F.max(F.when(F.col("_c") == column, part))
    return _at(column, low) + (_at(column, high) - _at(column, low)) * part


def percentiles(d: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]], rule: str = "linear") -> DataFrame:
    """Per group the exact percentiles ``wanted`` (name: column, share) by ``rule`` ("linear" or "averaged").

    Works on counts by value: values are counted with partial aggregation, and a prefix sum
    over a group's distinct values says where a rank lies, so rows are never gathered.
    """
    columns = sorted({c for c, _ in wanted.values()})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_x")
    counts = d.select(*by, each).select(*by, "_x.*").where("_v IS NOT NULL").groupBy(*by, "_c", "_v").agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy(*by, "_c")
    x = counts.withColumns({"_n": F.sum("_f").over(w), "_upto": F.sum("_f").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))})
    return x.groupBy(*by).agg(*[_percentile(c, share, rule).alias(n) for n, (c, share) in wanted.items()])


#: Percentiles of the summary: column and share.
SUMMARY_RANKS = {
    "median_diff": ("diff", 0.5),
    "median_abs": ("abs_diff", 0.5),
    "p90_abs": ("abs_diff", 0.9),
    "p95_abs": ("abs_diff", 0.95),
    "median_perc": ("perc_diff", 0.5),
    "median_abs_perc": ("abs_perc_diff", 0.5),
    "p90_abs_perc": ("abs_perc_diff", 0.9),
    "p95_abs_perc": ("abs_perc_diff", 0.95),
}


def summary(d: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The 27 statistics of differences: those of the difference, of its size, of the percent difference and of its size, RMSE, CV and counts.

    Without groups, an empty input gives 0 throughout. CV is null where the mean of h is 0.
    Exact percentiles, linear between neighbours. ``*_nas`` count differences without a percentage.
    A row counts ``weight`` times (once by default). All statistics come from one count of the four
    columns by value: sums, extremes and shares are those of values times counts.
    """
    columns = ("diff", "abs_diff", "perc_diff", "abs_perc_diff")
    h = F.col("h").cast("double")
    each = [F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v"), (h if c == "diff" else F.lit(None).cast("double")).alias("_h")) for c in columns]
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = d.select(*by, times.alias("_w"), F.explode(F.array(*each)).alias("_x")).select(*by, "_w", "_x.*")
    counts = rows.groupBy(*by, "_c", "_v").agg(F.sum("_w").alias("_f"), F.sum(F.col("_h") * F.col("_w")).alias("_h"))
    w = Window.partitionBy(*by, "_c")
    known = F.when(F.col("_v").isNotNull(), F.col("_f")).otherwise(0)
    x = counts.withColumns({"_n": F.sum(known).over(w), "_upto": F.sum(known).over(w.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))})
    f, v = F.col("_f"), F.col("_v")
    of = lambda c: F.col("_c") == c
    mean = lambda c, y: F.try_divide(F.sum(F.when(of(c), y * f)), F.sum(F.when(of(c) & y.isNotNull(), f)))
    how_many = lambda c, cond: F.coalesce(F.sum(F.when(of(c) & cond, f)), F.lit(0)).cast("long")
    least, most = (lambda c: F.min(F.when(of(c), v))), (lambda c: F.max(F.when(of(c), v)))
    n = how_many("diff", F.lit(True))
    square = mean("diff", v * v)
    mean_h = F.try_divide(F.sum("_h"), F.sum(F.when(of("diff") & F.col("_h").isNotNull(), f)))
    plain = {
        "min_diff": least("diff"),
        "mean_diff": mean("diff", v),
        "max_diff": most("diff"),
        "mae": mean("abs_diff", v),
        "min_perc": least("perc_diff"),
        "mean_perc": mean("perc_diff", v),
        "max_perc": most("perc_diff"),
        "mape": mean("abs_perc_diff", v),
        "max_abs_perc": most("abs_perc_diff"),
        "rmse": F.sqrt(square),
        "mean_h": mean_h,
    }
    ranks = {name: _percentile(c, share, "linear") for name, (c, share) in SUMMARY_RANKS.items()}
    cv = F.when(n == 0, 0.0).otherwise(F.try_divide(F.lit(100.0) * F.sqrt(square), mean_h))
    whole = {
        "n": n,
        "perc_nas": how_many("perc_diff", v.isNull()),
        "abs_perc_nas": how_many("abs_perc_diff", v.isNull()),
        "n_2_to_5": how_many("abs_perc_diff", v.between(2, 5)),
        "n_over_5": how_many("abs_perc_diff", v > 5),
        "n_over_10": how_many("abs_perc_diff", v > 10),
        "n_over_200": how_many("abs_diff", v > 200),
    }
    number = lambda c: F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 6)
    return x.groupBy(*by).agg(*[number(c).alias(k) for k, c in (plain | ranks).items()], F.round(cv, 6).alias("cv"), *[c.alias(k) for k, c in whole.items()])


def metric_cells(h: DataFrame, m: DataFrame, specs: Sequence[dict], name: str = "n") -> DataFrame:
    """One row of statistics per (geography, size class, characteristic) of a list of specs, one after the other; ``catalogue`` does many in one aggregate.

    ``h`` and ``m`` are pre-aggregated counts. A spec has ``name``, ``geo`` (columns), ``by``
    (columns kept apart from the geography), ``where`` (SQL, optional) and ``size`` (a
    function from the h total of the unit to a class label, optional).
    """
    out = None
    for s in specs:
        keys = [*s["geo"], *s.get("by", ())]
        part = lambda x, s=s, keys=keys: (x.where(s["where"]) if s.get("where") else x).groupBy(*keys).agg(F.sum(name).cast("long").alias(name))
        d = differences(part(h), part(m), keys, name)
        label = s["size"](F.col("h")) if s.get("size") else F.lit("all")
        one = summary(d.withColumn("size_class", label.cast("string")), ["size_class"]).withColumn("metric", F.lit(s["name"]))
        out = one if out is None else out.unionByName(one)
    return out


def catalogue(people: DataFrame, side: str, keys: Sequence[str], geographies: dict[str, Column], characteristics: dict[str, Column], sizes: dict) -> DataFrame:
    """Statistics of every (geography, size class, characteristic), from one cube of counts of both files.

    ``side`` is 0 for the true file and 1 for the other; ``keys`` are the columns that all
    expressions use. A characteristic is a label where it applies to a person, else null; the one
    named "total" labels everyone. A geography in ``sizes`` gives classes too: a function from the true
    total of the unit to a label. Cells that are zero in both files are left out; ``complete_catalogue`` counts them.
    """
    cube = people.groupBy(*keys).agg(counted(F.col(side) == 0).alias("h"), counted(F.col(side) == 1).alias("m"))
    # labels first: what is left of the cube has far fewer rows than units times labels of its own
    spine = [c.cast("string").alias(f"_u{i}") for i, c in enumerate(geographies.values())]
    labelled = cube.select(*spine, F.explode(_labels(characteristics)).alias("characteristic"), "h", "m")
    small = labelled.groupBy(*[f"_u{i}" for i in range(len(spine))], "characteristic").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))
    units = F.explode(F.array(*[F.struct(F.lit(n).alias("geography"), F.col(f"_u{i}").alias("unit")) for i, n in enumerate(geographies)])).alias("_u")
    x = small.select(units, "characteristic", "h", "m").select("_u.*", "characteristic", "h", "m")
    cells = x.groupBy("geography", "unit", "characteristic").agg(F.sum("h").cast("long").alias("h"), F.sum("m").cast("long").alias("m"))
    everyone = F.max(F.when(F.col("characteristic").startswith("total"), F.col("h"))).over(Window.partitionBy("geography", "unit"))
    cells = cells.withColumn("_all", everyone)
    d = cells.withColumn("size_class", F.explode(_classes(F.col("geography"), F.col("_all"), sizes)))
    by = ["geography", "size_class", "characteristic"]
    return summary(_with_differences(d.groupBy(*by, "h", "m").agg(F.count(F.lit(1)).alias("_n"))), by, "_n")


def _labels(characteristics: dict[str, Column]) -> Column:
    """The labels that apply to a person, each led by its characteristic's name."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat_ws(" ", F.lit(n), c)) for n, c in characteristics.items()]))


def _classes(geography: Column, everyone: Column, sizes: dict) -> Column:
    """"all" and, where the geography has size classes, that of the unit's true total."""
    of_class = F.lit(None).cast("string")
    for n, f in sizes.items():
        of_class = F.when(geography == n, f(everyone).cast("string")).otherwise(of_class)
    return F.array_compact(F.array(F.lit("all"), of_class))


def _with_differences(d: DataFrame) -> DataFrame:
    p = signed_percent_difference(F.col("h"), F.col("m")) * 100
    d = d.withColumns({"diff": F.col("m") - F.col("h"), "perc_diff": p})
    return d.withColumns({"abs_diff": F.abs("diff"), "abs_perc_diff": F.abs("perc_diff")})


# complete domains

UNIT_BITS = 52  # of a packed membership; the geography's place in the list is above them


@dataclass(frozen=True)
class Geography:
    """A kind of unit: codes of ``width`` upper-case digits to ``base``.

    ``sizes`` maps a unit's true total to its size class. In a complete geography every unit of the domain
    and every category count, also where both files have nobody; else only cells that either file has.
    """

    name: str
    width: int
    base: int = 10
    sizes: Callable[[Column], Column] | None = None
    complete: bool = True

    def __post_init__(self):
        if not 2 <= self.base <= 36 or self.base**self.width > 1 << UNIT_BITS:
            raise ValueError(f"{self.name}: {self.width} digits to base {self.base} are over {UNIT_BITS} bits")


def packed_unit(geographies: Sequence[Geography], geography: Column, unit: Column) -> Column:
    """(geography, unit) as one integer; null for a geography that isn't listed, an error for a unit that isn't a code of it."""
    out = F.lit(None).cast("long")
    for i, g in enumerate(geographies):
        code = F.conv(unit, g.base, 10).cast("long")
        same = F.lpad(F.conv(code.cast("string"), 10, g.base), g.width, "0") == unit
        wrong = F.raise_error(F.concat(F.lit(f"not a code of {g.name}: "), unit)).cast("long")
        packed = F.when(unit.isNull(), F.lit(None).cast("long")).when(same, code + F.lit(i << UNIT_BITS)).otherwise(wrong)
        out = F.when(geography == g.name, packed).otherwise(out)
    return out


def memberships(crosswalk: DataFrame, geographies: Sequence[Geography], block: str) -> DataFrame:
    """One row a block: ``units``, the packed units that it belongs to, any number of each geography. ``crosswalk`` has block, geography, unit."""
    code = packed_unit(geographies, F.col("geography"), F.col("unit"))
    packed = crosswalk.select(block, code.alias("_u")).where(F.col(block).isNotNull() & F.col("_u").isNotNull())
    return packed.groupBy(block).agg(F.collect_set("_u").alias("units"))


def complete_catalogue(
    people: DataFrame,
    side: str,
    block: str,
    crosswalk: DataFrame,
    domain: DataFrame,
    geographies: Sequence[Geography],
    characteristics: dict[str, Column],
    categories: dict[str, Sequence[str]],
) -> DataFrame:
    """Statistics of every (geography, size class, characteristic) over whole domains of units and categories.

    ``crosswalk`` (block, geography, unit) says which units a block belongs to: many to many, on the
    spine or off it. ``domain`` (geography, unit) lists the units there are; others take no part.
    ``categories`` lists every value a characteristic may have, of which "total" is one value that everyone has.

    People are counted by block and label once, those counts meet the packed memberships of their
    block in one join, and one aggregate makes the cells of all geographies. A unit is then one row with
    its cells; cells are counted by their pair of numbers. Cells that are zero in both files are never
    made: how many there are is the number of units of the class less those observed, which enters
    the counts as one row a (geography, size class, characteristic). Nulls: people without a block take no part.
    """
    labels = [" ".join((n, v)) for n, values in categories.items() for v in values]
    everyone = " ".join(("total", categories["total"][0]))
    of_block = people.where(F.col(block).isNotNull()).select(block, F.col(side).alias("_side"), F.explode(_labels(characteristics)).alias("_l"))
    counts = of_block.groupBy(block, "_l").agg(counted(F.col("_side") == 0).alias("h"), counted(F.col("_side") == 1).alias("m"))
    met = counts.join(memberships(crosswalk, geographies, block), block).select(F.explode("units").alias("_u"), "_l", "h", "m")
    cells = met.groupBy("_u", "_l").agg(F.sum("h").alias("h"), F.sum("m").alias("m"))
    of_unit = cells.groupBy("_u").agg(F.collect_list(F.struct("_l", "h", "m")).alias("cells"), F.max(F.when(F.col("_l") == everyone, F.col("h"))).alias("_all"))
    listed = domain.select(packed_unit(geographies, F.col("geography"), F.col("unit")).alias("_u")).where("_u IS NOT NULL").distinct()
    place = F.shiftright("_u", UNIT_BITS)
    name = F.element_at(F.array(*[F.lit(g.name) for g in geographies]), (place + 1).cast("int"))
    units = listed.join(of_unit, "_u", "left").withColumn("geography", name)
    sizes = {g.name: g.sizes for g in geographies if g.sizes}
    size_class = F.explode(_classes(F.col("geography"), F.coalesce("_all", F.lit(0)), sizes)).alias("size_class")
    # the cell without a label stands for the unit itself
    self_ = F.array(F.struct(F.lit(None).cast("string").alias("_l"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("m")))
    every = units.select("geography", size_class, F.concat(self_, F.coalesce("cells", F.slice(self_, 1, 0))).alias("cells"))
    pairs = every.select("geography", "size_class", F.explode("cells").alias("_c")).select("geography", "size_class", "_c.*").groupBy("geography", "size_class", "_l", "h", "m").agg(F.count(F.lit(1)).alias("_n"))
    by = ["geography", "size_class", "characteristic"]
    seen = pairs.where("_l IS NOT NULL").withColumnRenamed("_l", "characteristic")
    seen = seen.where(F.col("characteristic").isin(labels))
    complete = [g.name for g in geographies if g.complete]
    of_class = pairs.where(F.col("_l").isNull() & F.col("geography").isin(complete)).groupBy("geography", "size_class").agg(F.sum("_n").alias("_units"))
    full = of_class.withColumn("characteristic", F.explode(F.array(*[F.lit(x) for x in labels])))
    observed = seen.groupBy(*by).agg(F.sum("_n").alias("_seen"))
    zeros = full.join(observed, by, "left").select(*by, F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("m"), (F.col("_units") - F.coalesce("_seen", F.lit(0))).alias("_n")).where("_n > 0")
    return summary(_with_differences(seen.unionByName(zeros)), by, "_n")


def grouped_median(df: DataFrame, by: Sequence[str], age: str) -> DataFrame:
    """Per group the median of ages grouped in years: upper median m, then m + (n / 2 - below) / equal.

    Works on counts by age, so a hot group is at most one row per age.
    """
    counts = df.where(F.col(age).isNotNull()).groupBy(*by, age).agg(F.count(F.lit(1)).alias("f"))
    w = Window.partitionBy(*by)
    x = counts.withColumns({"n": F.sum("f").over(w), "upto": F.sum("f").over(w.orderBy(age).rowsBetween(Window.unboundedPreceding, 0))})
    at = x.where("upto - f <= n div 2 AND upto > n div 2")
    return at.select(*by, F.round(F.col(age) + (F.col("n") / 2 - (F.col("upto") - F.col("f"))) / F.col("f"), 6).alias("median"), F.col("n").cast("long").alias("n"))


def sex_ratio(df: DataFrame, by: Sequence[str], sex: str = "sex") -> DataFrame:
    """100 * males / females; null where there are no females."""
    return df.groupBy(*by).agg(F.round(F.try_divide(counted(F.col(sex) == 1) * F.lit(100.0), counted(F.col(sex) == 0)), 6).alias("sex_ratio"))


def share_error(h: DataFrame, m: DataFrame, keys: Sequence[str], within: Sequence[str], name: str = "n") -> DataFrame:
    """Sum over units of |h / H - m / M| in each outer area."""
    d = differences(h, m, keys, name)
    sums = d.groupBy(*within).agg(F.sum("h").alias("_h"), F.sum("m").alias("_m"))
    joined = d.join(sums, list(within)) if within else d.crossJoin(F.broadcast(sums))  # a single row
    gap = F.abs(F.coalesce(F.try_divide(F.col("h").cast("double"), F.col("_h")), F.lit(0.0)) - F.coalesce(F.try_divide(F.col("m").cast("double"), F.col("_m")), F.lit(0.0)))
    return joined.groupBy(*within).agg(F.round(F.sum(gap), 6).alias("taes"))


def crossings(d: DataFrame, threshold: int, by: Sequence[str] = ()) -> DataFrame:
    """How many units are over the threshold in one file and under it in the other; one at the threshold has not crossed."""
    h, m = F.col("h"), F.col("m")
    return d.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("units"), counted((h > threshold) & (m < threshold)).alias("fell"), counted((h < threshold) & (m > threshold)).alias("rose"))


def fewer(d: DataFrame, size=None) -> DataFrame:
    """Units that lose count, overall ("all") and by size class of h: units, how many lose, and the median percent difference of those (null if none)."""
    classes = F.array(F.lit("all")) if size is None else F.array_compact(F.array(F.lit("all"), size(F.col("h")).cast("string")))
    x = d.withColumn("size_class", F.explode(classes)).withColumn("_lost", F.when(F.col("m") < F.col("h"), F.col("perc_diff")))
    counts = x.groupBy("size_class").agg(F.count(F.lit(1)).cast("long").alias("units"), counted(F.col("m") < F.col("h")).alias("below"))
    median = percentiles(x, ["size_class"], {"median_perc": ("_lost", 0.5)})
    return counts.join(median, "size_class", "left").withColumn("median_perc", F.round("median_perc", 6))


def unequal(d: DataFrame) -> DataFrame:
    """Units whose counts differ between the files; totals that were held fixed should give 0."""
    return d.agg(F.count(F.lit(1)).cast("long").alias("units"), counted(F.col("h") != F.col("m")).alias("unequal"))


def children_without_women(people: DataFrame, unit: Sequence[str], slices: dict[str, Column], sex: str = "sex", age: str = "age", least: int = 5) -> DataFrame:
    """Per slice of the people: units with ``least`` or more children under 5, and those of them without women of 18 to 44 in the slice."""
    kids, women = F.col(age) < 5, (F.col(sex) == 0) & F.col(age).between(18, 44)
    per = people.groupBy(*unit).agg(*[counted(c & x).alias(f"{k}_{n}") for n, c in slices.items() for k, x in (("k", kids), ("w", women))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(f"k_{n}").alias("kids"), F.col(f"w_{n}").alias("women")) for n in slices])).alias("s")
    x = per.select(rows).select("s.*").where(F.col("kids") >= least)
    return x.groupBy("slice").agg(F.count(F.lit(1)).cast("long").alias("units"), counted(F.col("women") == 0).alias("inconsistent"))


def all_under_18(people: DataFrame, unit: Sequence[str], group_quarters: Column, age: str = "age") -> DataFrame:
    """Populated units without people in group quarters, and those of them where everyone is under 18."""
    per = people.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), counted(F.col(age) < 18).alias("young"), counted(group_quarters).alias("gq")).where("gq = 0")
    return per.agg(F.count(F.lit(1)).cast("long").alias("units"), counted(F.col("young") == F.col("n")).alias("inconsistent"))


def implausible(people: DataFrame, unit: Sequence[str], sex: str = "sex", age: str = "age") -> DataFrame:
    """Per unit flags: children without women of 18 to 44, five or more of one sex, all under 18, a missing year under 18."""
    kids, women = counted(F.col(age) < 5), counted((F.col(sex) == 0) & F.col(age).between(18, 44))
    n, males = F.count(F.lit(1)).cast("long"), counted(F.col(sex) == 1)
    young = counted(F.col(age) < 18)
    x = people.groupBy(*unit).agg(n.alias("n"), kids.alias("kids"), women.alias("women"), males.alias("males"), young.alias("young"), F.count_distinct(F.when(F.col(age) < 18, F.col(age))).alias("years"))
    flag = lambda c: c.cast("int")
    return x.select(*unit, "n", flag((F.col("kids") >= 5) & (F.col("women") == 0)).alias("children_no_women"), flag((F.col("n") >= 5) & ((F.col("males") == 0) | (F.col("males") == F.col("n")))).alias("one_sex"), flag(F.col("young") == F.col("n")).alias("all_under_18"), flag((F.col("young") > 200) & (F.col("years") < 18)).alias("missing_year"))


def median_gap(people: DataFrame, unit: Sequence[str], gap: float = 20, least: int = 5) -> DataFrame:
    """Units whose median ages of men and women differ by ``gap`` or more, with ``least`` or more of each."""
    med = grouped_median(people, [*unit, "sex"], "age")
    both = med.groupBy(*unit).agg(*[F.max(F.when(F.col("sex") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("median", "n")])
    return both.where((F.col("n0") >= least) & (F.col("n1") >= least) & (F.abs(F.col("median0") - F.col("median1")) >= gap)).select(*unit, F.col("median0").alias("women"), F.col("median1").alias("men"))


# suppression


def suppressed_units(people: DataFrame, levels: Sequence[str], under: int = 15) -> DataFrame:
    """Per level of the spine: populated units and those with fewer than ``under`` people. One rollup for all levels."""
    from microveil.operators.tabulate import spine_rollup

    units = spine_rollup(people, levels, {"n": F.count(F.lit(1))})
    x = units.groupBy("depth").agg(F.count(F.lit(1)).cast("long").alias("units"), counted(F.col("n") < under).alias("suppressed"))
    return x.withColumn("percent", percent_half_even(F.col("suppressed"), F.col("units")))


def suppressed_cells(people: DataFrame, geo: Sequence[str], category: Sequence[str], under: int = 3) -> DataFrame:
    """Cells are observed units times observed categories; suppressed ones have 0 < n < ``under``. Empty cells are counted, not made."""
    cells = people.groupBy(*geo, *category).agg(F.count(F.lit(1)).alias("n"))
    # distinct counts over pre-aggregated cells
    x = cells.agg(F.count_distinct(F.struct(*geo)).alias("g"), F.count_distinct(F.struct(*category)).alias("c"), counted(F.col("n") < under).alias("suppressed"))
    return x.select((F.col("g") * F.col("c")).cast("long").alias("cells"), "suppressed").withColumn("percent", percent_half_even(F.col("suppressed"), F.col("cells")))


def suppressed_tables(people: DataFrame, geo: Sequence[str], category: Sequence[str], adult: Column, under: int = 15) -> DataFrame:
    """Adult tables (units with an adult) whose smallest positive cell over all ages is under the limit."""
    low = people.groupBy(*geo, *category).agg(F.count(F.lit(1)).alias("n")).groupBy(*geo).agg(F.min("n").alias("least"))
    tables = people.where(adult).select(*geo).distinct().join(low, list(geo))
    x = tables.agg(F.count(F.lit(1)).cast("long").alias("tables"), counted(F.col("least") < under).alias("suppressed"))
    return x.withColumn("percent", percent_half_even(F.col("suppressed"), F.col("tables")))


# distances


def histogram(df: DataFrame, schema: Sequence[str]) -> DataFrame:
    return df.groupBy(*schema).agg(F.count(F.lit(1)).cast("long").alias("n"))


def l1(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sum of |a - b| over the union of keys."""
    d = differences(a, b, keys)
    return d.groupBy(*by).agg(F.sum("abs_diff").cast("long").alias("l1"))


def earth_mover(a: DataFrame, b: DataFrame, unit: Sequence[str], age: str, low: int = 0, high: int = 110) -> DataFrame:
    """Per unit the sum over low..high of |prefix(a) - prefix(b)|.

    Between two observed ages the prefix difference is constant, so it is multiplied by the gap instead of making a row per age.
    """
    d = differences(a, b, [*unit, age]).where(F.col(age).between(low, high))
    w = Window.partitionBy(*unit).orderBy(age)
    x = d.withColumns({"_d": F.sum("diff").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.coalesce(F.lead(age).over(w), F.lit(high + 1))})
    return x.groupBy(*unit).agg(F.sum(F.abs("_d") * (F.col("_next") - F.col(age))).cast("long").alias("emd"))


def jensen_shannon(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Square root of the divergence (natural log) of the two sides' shares in each unit."""
    d = differences(a, b, keys)
    sums = d.groupBy(*by).agg(F.sum("h").alias("_h"), F.sum("m").alias("_m"))
    x = d.join(sums, list(by)).where("_h > 0 AND _m > 0").withColumns({"p": F.col("h") / F.col("_h"), "q": F.col("m") / F.col("_m")})
    mid = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / mid)).otherwise(0.0)
    return x.groupBy(*by).agg(F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(term("p") + term("q")) / 2)), 6).alias("js"))


def scaled_variability(df: DataFrame, value: str, pop: str, late: str = "TIMEOUT") -> DataFrame:
    """Adds ``scaled``, variability over twice the population as text, and ``label``: 0, >0, the mark of runs that took too long, or NA.

    ``value`` is text: a number, or ``late``, which stays as it is. A population of 0 gives NaN.
    """
    v, n = F.col(value), F.col(value).try_cast("double")
    share = F.when(F.col(pop) == 0, F.lit("NaN")).otherwise(F.round(F.try_divide(n, F.lit(2.0) * F.col(pop)), 6).cast("string"))
    label = F.when(v == late, late).when(n == 0, "0").when(n > 0, ">0").otherwise("NA")
    return df.withColumns({"scaled": F.when(v == late, v).otherwise(share), "label": label})


def commercial_quality(com: DataFrame, truth: DataFrame, block: str, age_group) -> DataFrame:
    """Per block: rows, complete rows, and matches on id, on id, age and sex, and on id, age group and sex. Joins are many to many."""
    rows = com.groupBy(block).agg(F.count(F.lit(1)).cast("long").alias("rows"), counted(F.col("pik").isNotNull()).alias("has_bp"), counted(F.col("pik").isNotNull() & F.col("age").isNotNull() & F.col("sex").isNotNull()).alias("has_bpas"))
    t = truth.select(block, "pik", F.col("age").alias("t_age"), F.col("sex").alias("t_sex"))
    same = com.join(t, [block, "pik"]).groupBy(block).agg(
        F.count(F.lit(1)).cast("long").alias("bp"), counted((F.col("age") == F.col("t_age")) & (F.col("sex") == F.col("t_sex"))).alias("bpas"), counted((age_group(F.col("age")) == age_group(F.col("t_age"))) & (F.col("sex") == F.col("t_sex"))).alias("bpabs")
    )
    return rows.join(same, block, "full").na.fill(0)
