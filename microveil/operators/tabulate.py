"""Block tabulation, uniqueness, modes with ties and hierarchical fall-back, guessers, reindexing."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microveil.sources.writers import kept


def counted(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def total(x: Column | str) -> Column:
    """A sum that is 0, not null, for a group without values."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def uniqueness(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Adds 1 where no other row agrees on ``by``, else 0."""
    return df.withColumn(name, (F.count(F.lit(1)).over(Window.partitionBy(*by)) == 1).cast("int"))


def block_tabulation(people: DataFrame, block: str, attributes: Sequence[str], sex: str = "sex", age: str = "age", pik: str = "pik") -> DataFrame:
    """Per block: population, males, people with id, age, sex and all three, unique people and ages over and up to 21."""
    every = uniqueness(uniqueness(people, [block, sex, age, *attributes], "_all"), [block, sex, age], "_two")
    has = {k: F.col(c).isNotNull() for k, c in (("haspik", pik), ("hasage", age), ("hassex", sex))}
    return every.groupBy(block).agg(
        F.count(F.lit(1)).cast("long").alias("pop"), total(sex).alias("sex"), *[counted(c).alias(k) for k, c in has.items()],
        counted(has["haspik"] & has["hasage"] & has["hassex"]).alias("hasall3"), total("_all").alias("uniall"), total("_two").alias("uniagesex"),
        counted(F.col(age) > 21).alias("popgt21"), counted(F.col(age) <= 21).alias("poplteq21"),
    )


def frequency_pivot(people: DataFrame, block: str, flags: Sequence[str]) -> DataFrame:
    """One column freq<bits> for every combination of the 0/1 flags, null where a block has none; values are fixed, so nothing is looked up first."""
    key = F.concat(*[F.col(f).cast("string") for f in flags])
    names = ["".join(b) for b in product("01", repeat=len(flags))]
    wide = people.withColumn("_key", key).groupBy(block).pivot("_key", names).agg(F.count(F.lit(1)).cast("long"))
    return wide.select(block, *[F.col(n).alias(f"freq{n}") for n in names])


def modes(people: DataFrame, by: Sequence[str], category: str, national: DataFrame | None = None) -> DataFrame:
    """Per group: first category with the largest count, that count, how many share it, and of those the nationally most common.

    Ties go to the smaller category. ``national`` has category and n; by default it is counted from ``people``.
    """
    counts = people.where(F.col(category).isNotNull()).groupBy(*by, category).agg(F.count(F.lit(1)).cast("long").alias("n"))
    nation = national if national is not None else counts.groupBy(category).agg(F.sum("n").cast("long").alias("n"))
    ranked = counts.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("n")))).where("_r = 1")
    joined = ranked.join(nation.withColumnRenamed("n", "_nation"), category)
    top = joined.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_nation"), category)))
    return top.groupBy(*by).agg(F.min(category).alias("mode"), F.max("n").alias("max_n"), F.count(F.lit(1)).cast("long").alias("ties"), F.max(F.when(F.col("_k") == 1, F.col(category))).alias("national_mode"))


def modal_fallback(people: DataFrame, block: str, group: str, category: str) -> DataFrame:
    """Per block: modal category and the level it comes from (block, blockgroup, national), by ordered rules."""
    b = modes(people, [block], category)
    links = people.select(block, group).distinct()
    g = modes(people, [group], category).select(group, F.col("mode").alias("g_mode"), F.col("max_n").alias("g_max"), F.col("ties").alias("g_ties"))
    both = links.join(b, block, "left").join(g, group, "left")
    none = F.lit(None).cast("string")
    code, kind = F.col("mode"), F.when(F.col("mode").isNotNull(), F.lit("block"))
    steps = [
        (code.isNull(), "g"),
        ((F.col("max_n") == 1) & (F.col("g_max") > 1), "g"),
        ((F.col("max_n") == 1) & (F.col("g_max") == 1), None),
        ((F.col("ties") > 1) & (F.col("g_ties") == 1), "g"),
        ((F.col("ties") > 1) & (F.col("g_ties") > 1), None),
    ]
    for cond, to in steps:
        cond = F.coalesce(cond, F.lit(False))
        code = F.when(cond, F.col("g_mode") if to else none).otherwise(code)
        kind = F.when(cond, F.lit("blockgroup") if to else none).otherwise(kind)
    out = both.withColumns({"_code": code, "_kind": kind})
    return out.select(block, F.coalesce("_code", "national_mode").alias("modal"), F.when(F.col("_code").isNull(), "national").otherwise(F.col("_kind")).alias("level"))


def modal_guess(people: DataFrame, block: str, group: str, category: str, default: str) -> DataFrame:
    """Per block: its only mode, else the block group's where that is better founded, else the default."""
    b = modes(people, [block], category)
    links = people.select(block, group).distinct()
    g = modes(people, [group], category).select(group, F.col("mode").alias("g_mode"), F.col("max_n").alias("g_max"), F.col("ties").alias("g_ties"))
    x = links.join(b, block).join(g, group)
    over = ((F.col("max_n") == 1) & (F.col("g_ties") == 1) & (F.col("g_max") > 1)) | ((F.col("ties") > 1) & (F.col("g_ties") == 1))
    return x.select(block, F.when(over, F.col("g_mode")).when(F.col("ties") == 1, F.col("mode")).otherwise(F.lit(default)).alias("guess"))


def proportional_guess(people: DataFrame, block: str, category: str, draw: Column, id_col: str) -> DataFrame:
    """Each person gets the first category whose cumulative share in the block is above the draw in [0, 1).

    Categories go by count, then by code. A range join inside the block, on counts per block only.
    """
    counts = people.groupBy(block, category).agg(F.count(F.lit(1)).cast("long").alias("n"))
    order = Window.partitionBy(block).orderBy("n", category)
    high = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    shares = counts.select(block, F.col(category).alias("guess"), (high - F.col("n")).alias("_low"), high.alias("_high"), F.sum("n").over(Window.partitionBy(block)).alias("_all"))
    drawn = people.select(id_col, block, draw.alias("_u"))
    hit = (F.col("_u") * F.col("_all") >= F.col("_low")) & (F.col("_u") * F.col("_all") < F.col("_high"))
    return drawn.join(shares, block).where(hit).select(id_col, block, "guess")


def person_flags(people: DataFrame, block: str, modal: DataFrame, own: str, age_group: Column, id_col: str) -> DataFrame:
    """modalre, over21 and uniqueness on (sex, age), (sex, age group) and own code, counted over all rows."""
    x = people.withColumn("_bin", age_group).join(modal.select(block, F.col("modal").alias("_modal")), block, "left")
    for name, by in (("sab_oneton", [block, "sex", "age"]), ("sabb_oneton", [block, "sex", "_bin"]), ("ber_oneton", [block, own])):
        x = uniqueness(x, by, name)
    modalre = F.when(F.col("_modal").isNotNull(), F.coalesce((F.col(own) == F.col("_modal")).cast("int"), F.lit(0)))
    return x.select(id_col, block, modalre.alias("modalre"), (F.col("age") > 21).cast("int").alias("over21"), "sab_oneton", "sabb_oneton", "ber_oneton")


def spine_rollup(people: DataFrame, levels: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """One row per observed unit of every level, nation first; level 0 is the nation."""
    out = people.rollup(*levels).agg(*[m.alias(k) for k, m in measures.items()], F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.bit_count(F.col("_g"))
    return out.withColumn("depth", depth.cast("int")).drop("_g")


def reindexed(counts: DataFrame, domains: Sequence[DataFrame], measures: Sequence[str]) -> DataFrame:
    """Counts over the full product of domains, 0 where there are none.

    The first domain may be large; the others are code lists that are sent to every task, so
    more than 10,000 codes in one are an error.
    """
    full = domains[0]
    for d in domains[1:]:
        if d.limit(10_001).count() > 10_000:
            raise ValueError(f"a domain of more than 10,000 codes: {d.columns}")
        full = full.crossJoin(F.broadcast(d))
    on = full.columns
    return full.join(counts, on, "left").select(*on, *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def percentile_classes(df: DataFrame, value: str, shares: Sequence[float] = (0.25, 0.5, 0.75, 0.9), rule: str = "averaged") -> DataFrame:
    """Class 0 for 0, else 1 + the number of percentiles of the positive values that the value is above; null for null.

    The cuts are one row, from counts by value, by the ``rule`` of ``metrics.percentiles``: "averaged" is
    that of statistical packages whose percentile is a value of the data or the mean of two. Without
    positive values there are no cuts, so no class above 0.
    """
    from microveil.operators.metrics import percentiles

    cuts = percentiles(df.where(F.col(value) > 0), (), {f"_p{i}": (value, s) for i, s in enumerate(shares)}, rule)
    above = sum(((F.col(value) > F.col(f"_p{i}")).cast("int") for i in range(len(shares))), F.lit(1))
    return df.crossJoin(F.broadcast(cuts)).withColumn("class", F.when(F.col(value) == 0, 0).when(F.col(value) > 0, above)).drop(*[f"_p{i}" for i in range(len(shares))])


def quantile_table(df: DataFrame, value: str, pop: str, order: Sequence[str]) -> DataFrame:
    """5 % bins of the rank by value (the last is 95 to 105): rows, sums, and cumulative shares 100 * value / (2 * pop).

    The rank over all rows is a two-level prefix sum: counts of a coarse range of the value,
    then ranks inside each range, so no task sees all rows.
    """
    edges = df.select(F.percentile_approx(value, [i / 64 for i in range(1, 64)], 10000).alias("e"))
    ranged = df.crossJoin(F.broadcast(edges)).withColumn("_range", F.size(F.filter("e", lambda x: x < F.col(value)))).drop("e")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(F.lit(1)))})
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(value, *order))
    ranked = ranged.join(F.broadcast(offsets.drop("_n")), "_range").withColumn("_p", F.lit(100.0) * (F.col("_before") + inside) / F.col("_all"))
    bins = ranked.withColumn("bin", F.least(F.floor(F.col("_p") / 5) * 5, F.lit(95)).cast("long")).groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(value).alias("value_sum"), F.sum(pop).cast("long").alias("pop_sum"))
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(1))
    return bins.withColumn("cum_percent", F.round(F.lit(100.0) * F.sum("value_sum").over(running) / (F.lit(2) * F.sum("pop_sum").over(whole)), 6))


def ranked(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the row's place (from 1) in ``order`` among the rows that agree on ``within``, also where one group is most of the table.

    Rows are dealt by ranges of (within, order) and numbered inside their range; how many of the group lie in the ranges before
    comes from one count a range and group. Rows that agree on all of it are in any order. Null is a group of its own.
    """
    keys = [*within, *order]
    here = kept(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = here.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("_before", before).drop("_n").toDF(*[f"_g{i}" for i in range(len(within))], "_r", "_before")
    inside = here.withColumn("_i", F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(within):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inside.join(starts, same).withColumn(name, F.col("_before") + F.col("_i")).select(*df.columns, name)


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], selected: str) -> DataFrame:
    """Adds ``run`` (number of the run of selected rows within the group) and ``place`` in it; null on other rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    start = (F.col(selected) & ~F.coalesce(F.lag(selected).over(w), F.lit(False))).cast("int")
    x = df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_run", selected).orderBy(*order)
    return x.withColumns({"run": F.when(F.col(selected), F.col("_run")), "place": F.when(F.col(selected), F.row_number().over(inside))}).drop("_start", "_run")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows unchanged; an error when run if two rows agree on the keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"keys {list(keys)} are not unique")).cast("boolean")).otherwise(F.lit(True))).drop("_n")
