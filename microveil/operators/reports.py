"""Rates and report tables by slice, indicator sums, and small tools over file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microveil.functions.bins import BLOCK_SIZE_RIGHT, ordinal, right_closed, significant, thousands
from microveil.operators.tabulate import counted, ranked, total

#: Order of report rows by block population.
SIZE_ORDER = ("All", *[label for _, _, label in BLOCK_SIZE_RIGHT])


def indicator_sums(df: DataFrame, by: Sequence[str], dims: dict[str, dict[str, Column]]) -> DataFrame:
    """One column for every combination of named conditions, one from each dimension; a single aggregate over one scan."""
    cells: dict[str, Column] = {"": F.lit(True)}
    for conds in dims.values():
        cells = {(f"{a}_{b}" if a else b): c & d for a, c in cells.items() for b, d in conds.items()}
    return df.groupBy(*by).agg(*[counted(c).alias(name) for name, c in cells.items()])


def match_rates(people: DataFrame, put: DataFrame, conf: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """Per slice: population, putative and confirmed matches, and their rates; null where a base is 0."""
    x = people.join(put.select(F.col("left_id").alias(id_col), F.lit(1).alias("_p")), id_col, "left").join(conf.select(F.col("left_id").alias(id_col), F.lit(1).alias("_c")), id_col, "left")
    out = x.groupBy(*by).agg(F.count(F.lit(1)).cast("long").alias("pop"), total("_p").alias("put"), total("_c").alias("conf"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 6)
    return out.withColumns({"put_rate": rate("put", "pop"), "conf_rate": rate("conf", "pop"), "precision": rate("conf", "put")})


def duplicate_share(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows in all, rows of groups with more than one, and their share in percent; two-level aggregate."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    x = g.agg(F.sum("n").cast("long").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).cast("long").alias(name))
    return x.withColumn("percent", F.round(F.try_divide(F.col(name) * F.lit(100.0), F.col("rows")), 6))


def with_totals(df: DataFrame, label: str, sums: Sequence[str]) -> DataFrame:
    """Rows by label with a row "Total"."""
    return df.rollup(label).agg(*[F.sum(c).cast("long").alias(c) for c in sums], F.grouping(label).alias("_g")).select(F.when(F.col("_g") == 1, "Total").otherwise(F.col(label)).alias(label), *sums)


def pseudonyms(paths: DataFrame, column: str) -> DataFrame:
    """A code P0000001, ... for every distinct part of slash-separated paths, in order of their bytes.

    Numbers come from ranks inside sampled ranges of the parts and the counts of the ranges before, so no task ranks all parts.
    """
    parts = paths.select(F.explode(F.split(column, "/")).alias("part")).where("part <> ''").distinct()
    return ranked(parts, [], ["part"], "_n").select("part", F.format_string("P%07d", F.col("_n").cast("long")).alias("code"))


def silent_changes(old: DataFrame, new: DataFrame, key: str, digest: str, stamps: Sequence[str]) -> DataFrame:
    """Files whose digest changed while no time stamp did."""
    n = new.select(key, F.col(digest).alias("_d"), *[F.col(s).alias(f"_{s}") for s in stamps])
    same = F.lit(True)
    for s in stamps:
        same = same & F.col(s).eqNullSafe(F.col(f"_{s}"))
    return old.join(n, key).where((F.col(digest) != F.col("_d")) & same).select(key)


def files_at(runs: DataFrame, sectors: DataFrame, start: str, length: str, at: str) -> DataFrame:
    """Runs that hold a sector: both sides are dealt by 1,024-sector buckets, so the range condition is an equi-join first."""
    b = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / 1024), F.floor((F.col(start) + F.col(length) - 1) / 1024))))
    s = sectors.withColumn("_b", F.floor(F.col(at) / 1024))
    return b.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(length))).drop("_b")


def sector_digests(files: DataFrame, path: str, content: str, size: int = 512) -> DataFrame:
    """md5 and sha1 of each block of binary content."""
    blocks = F.expr(f"transform(sequence(0, greatest(0, cast(ceil(length({content}) / {size}) as int) - 1)), i -> struct(i as n, substring({content}, i * {size} + 1, {size}) as b))")
    return files.select(path, F.explode(blocks).alias("x")).where("length(x.b) > 0").select(path, F.col("x.n").alias("n"), F.md5("x.b").alias("md5"), F.sha1("x.b").alias("sha1"))


def shown_percent(part: Column, whole: Column) -> Column:
    """A percentage as reports show it: four significant digits, then one decimal; null where the whole is 0."""
    return F.round(significant(F.try_divide(part.cast("double") * 100, whole)), 1)


def by_block_size(blocks: DataFrame, size: Column, base: str, counts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows by population class of the block, in their order, and one for all: sums, percentages of ``base``, and the base in thousands as text.

    ``blocks`` has one row a block (and each of ``by``, such as the release or the kind of people), with ``size`` its
    population; blocks outside all classes count in the row for all only.
    """
    x = blocks.withColumn("block_pop", right_closed(size)).select(*by, F.explode(F.array_compact(F.array(F.lit("All"), F.col("block_pop")))).alias("block_pop"), base, *counts)
    out = x.groupBy(*by, "block_pop").agg(F.count(F.lit(1)).cast("long").alias("blocks"), *[total(c).alias(c) for c in (base, *counts)])
    out = out.withColumns({f"{c}_pct": shown_percent(F.col(c), F.col(base)) for c in counts})
    return out.withColumns({"thousands": thousands(F.round(F.col(base) / 1000)), "place": ordinal(F.col("block_pop"), SIZE_ORDER).cast("long")})


def slice_rates(people: DataFrame, slices: dict[str, Column], put: str, conf: str) -> DataFrame:
    """Per slice of the people: how many, how many were matched and confirmed (1/0 columns), the percentages and the precision. One scan; slices may overlap."""
    rows = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]))).alias("slice")
    x = people.select(rows, put, conf).groupBy("slice").agg(F.count(F.lit(1)).cast("long").alias("denom"), total(put).alias("put"), total(conf).alias("conf"))
    return x.withColumns({"put_pct": shown_percent(F.col("put"), F.col("denom")), "conf_pct": shown_percent(F.col("conf"), F.col("denom")), "precision": shown_percent(F.col("conf"), F.col("put"))})


def flag_sums(people: DataFrame, by: Sequence[str], flags: dict[str, Column], matches: dict[str, Column]) -> DataFrame:
    """Sums of every flag, alone (``<flag>pop``) and with every kind of match (``<flag>_<match>``); a person whose flag is null counts in neither."""
    cells = {f"{n}pop": counted(c) for n, c in flags.items()}
    cells |= {f"{n}_{k}": counted(c & m) for n, c in flags.items() for k, m in matches.items()}
    return people.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])


def table_cells(people: DataFrame, geo: Sequence[str], ages: Sequence[int], sex: str, age: str, groups: dict[str, Column]) -> DataFrame:
    """Published-table cells in long form: geography, group, sex, age class (its lower bound) and count; sex and age null for subtotals.

    ``groups`` are conditions such as the race iterations of a table. One cube instead of a column for each of thousands of cells.
    """
    low = F.lit(None).cast("int")
    for a in sorted(ages):
        low = F.when(F.col(age) >= a, F.lit(a)).otherwise(low)
    names = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))).alias("group")
    leaf = people.select(*geo, names, F.col(sex).alias("sex"), low.alias("age_from")).groupBy(*geo, "group", "sex", "age_from").agg(F.count(F.lit(1)).alias("n"))
    subtotals = F.explode(F.array(F.struct("sex", "age_from"), F.struct("sex", F.lit(None).cast("int").alias("age_from")), F.struct(F.lit(None).cast(leaf.schema["sex"].dataType).alias("sex"), F.lit(None).cast("int").alias("age_from")))).alias("_c")
    return leaf.select(*geo, "group", subtotals, "n").groupBy(*geo, "group", "_c.sex", "_c.age_from").agg(F.sum("n").cast("long").alias("n"))
