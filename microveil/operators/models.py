"""Constraint models as tables: variables, constraints and terms; text form and back; a small exact solver.

A variable is one possible person: its cell, its number in the cell, and one value for
each attribute. A constraint says how many chosen variables may have certain attributes in
a geography. The text form is the usual LP format.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microveil.functions.bins import age_bin
from microveil.operators.lp import contained_terms

FLAGS = ("white", "black", "aian", "asian", "nhopi", "sor", "hisp")
ATTRIBUTES = ("sex", "age", *FLAGS)
FULL = {"sex": (0, 1), "age": tuple(range(111)), **{f: ("N", "Y") for f in FLAGS}}


def expanded(cells: DataFrame, full: dict = FULL) -> DataFrame:
    """Attribute arrays of a cell, the full range where one is missing (null)."""
    return cells.withColumns({k: F.coalesce(k, F.array(*[F.lit(v) for v in r])) for k, r in full.items()})


# The published tables that constraints may come from, and those of them that are about people of two or more races.
TABLES = (
    "P1", "P6", "P7", "P8", "P9", "P10", "P11", "P12", "P12A", "P12B", "P12C", "P12D", "P12E", "P12F", "P12G", "P12H", "P12I", "P14",
    "PCT12", "PCT12A", "PCT12B", "PCT12C", "PCT12D", "PCT12E", "PCT12F", "PCT12G", "PCT12H", "PCT12I", "PCT12J", "PCT12K", "PCT12L", "PCT12M", "PCT12N", "PCT12O",
)
TWO_PLUS_TABLES = ("P12G", "PCT12G", "PCT12O")


def allowed(cells: DataFrame, table: str = "table", tables: Sequence[str] = TABLES, full: dict = FULL) -> DataFrame:
    """Cells of the listed tables with a value, every missing attribute given its full range."""
    return expanded(cells.where(F.col(table).isin(*tables) & F.col("value").isNotNull()), full)


def two_or_more() -> list[tuple[str, ...]]:
    """All 57 combinations of six Y/N flags with two or more Y."""
    return [c for c in product("NY", repeat=6) if c.count("Y") >= 2]


def variables(cells: DataFrame, attributes: Sequence[str] = ATTRIBUTES, races: Sequence[str] = FLAGS[:6]) -> DataFrame:
    """One row per (cell, person number, attribute tuple): cells have geo, cell, value and an array per attribute.

    Cells of value 0 make none; tuples without any race flag are left out.
    """
    x = cells.where("value > 0").withColumn("person", F.explode(F.expr("sequence(0, cast(value as int) - 1)")))
    for a in attributes:
        x = x.withColumn(a, F.explode(a))
    some = F.lit(False)
    for r in races:
        some = some | (F.col(r) == "Y")
    x = x.where(some) if races else x
    name = F.concat_ws("_", F.lit("C"), "geo", "cell", F.col("person").cast("string"), *[F.col(a).cast("string") for a in attributes])
    return x.select("geo", "cell", "person", *attributes, name.alias("variable"))


def terms(cells: DataFrame, vs: DataFrame, attributes: Sequence[str], by_geo: bool = True, full: dict = FULL) -> DataFrame:
    """Constraint x variable: cells with a value meet the variables whose value of every attribute they allow, in their geography or (not ``by_geo``) in all."""
    return contained_terms(cells, vs, attributes, full, ("geo",) if by_geo else ())


def two_plus_terms(cells: DataFrame, vs: DataFrame, attributes: Sequence[str], races: Sequence[str] = FLAGS[:6], by_geo: bool = True, full: dict = FULL) -> DataFrame:
    """Constraint x variable for cells of people of two or more races: any combination with two or more of the flags, whatever the cell says of them."""
    return contained_terms(cells, vs, attributes, full, ("geo",) if by_geo else (), races)


def in_file_order(block_lines: DataFrame, tract_lines: DataFrame, tract: str = "tract") -> DataFrame:
    """Constraint lines of each tract's file: those of its blocks, block by block, then its own; ``place`` counts from 1."""
    both = block_lines.select(tract, F.lit(0).alias("level"), "geo", "place", "line").unionByName(tract_lines.select(tract, F.lit(1).alias("level"), "geo", "place", "line"))
    w = Window.partitionBy(tract).orderBy("level", "geo", "place", "line")
    return both.select(tract, F.row_number().over(w).alias("place"), "line")


def constraints(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Text of each constraint: ordered names joined by plus signs, equal to the value; cells without terms are left out."""
    sums = found.groupBy("geo", "constraint").agg(F.array_join(F.sort_array(F.collect_set("variable")), " + ").alias("sum"))
    rows = sums.join(cells.select("geo", F.col("cell").alias("constraint"), "value"), ["geo", "constraint"])
    n = F.row_number().over(Window.partitionBy("geo").orderBy("constraint"))
    return rows.select("geo", F.concat(F.lit("_C_"), "constraint", F.lit("_"), "geo", F.lit("_"), n.cast("string"), F.lit(": "), "sum", F.lit(" = "), F.col("value").cast("string")).alias("line"), n.alias("place"))


def lp_text(lines: DataFrame, vs: DataFrame) -> DataFrame:
    """(geo, section, place, line) of an LP file for each geography; write with partitions by geo, sorted by section and place."""
    head = lines.select("geo").distinct()
    fixed = lambda section, text: head.select("geo", F.lit(section).alias("section"), F.lit(0).alias("place"), F.lit(text).alias("line"))
    names = vs.select("geo", F.lit(5).alias("section"), F.row_number().over(Window.partitionBy("geo").orderBy("variable")).alias("place"), F.col("variable").alias("line"))
    return fixed(0, "Minimize").unionByName(fixed(1, "  dummy")).unionByName(fixed(2, "Subject To")).unionByName(lines.select("geo", F.lit(3).alias("section"), "place", "line")).unionByName(fixed(4, "Binaries")).unionByName(names).unionByName(fixed(6, "End"))


def parsed_lp(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraint, sense, rhs) and (constraint, variable) of the constraint lines of LP text, one line a row in ``line``."""
    c = text.select(F.regexp_extract("line", r"^\s*(_C_\w+):", 1).alias("constraint"), F.regexp_extract("line", r":(.*?)(<=|>=|=)", 1).alias("sum"), F.regexp_extract("line", r"(<=|>=|=)\s*-?[\d.]+\s*$", 1).alias("sense"), F.regexp_extract("line", r"=\s*(-?[\d.]+)\s*$", 1).alias("rhs")).where("constraint <> ''")
    return c.select("constraint", "sense", F.expr("try_cast(rhs as double)").alias("rhs")), c.select("constraint", F.explode(F.expr(r"regexp_extract_all(sum, '(\\w+)', 1)")).alias("variable"))


def populations(text: DataFrame, table: str = "P0010001", order: str = "n") -> DataFrame:
    """Published population by block in LP text; of repeated blocks the last line counts."""
    x = text.select(F.regexp_extract("line", rf"_C_{table}_(\d{{15}})_\d+:", 1).alias("block"), F.expr(r"try_cast(regexp_extract(line, '=\\s*(\\d+)', 1) as double)").alias("pop"), F.col(order).alias("_n")).where("block <> ''")
    return x.groupBy("block").agg(F.max_by("pop", "_n").alias("pop"))


def start_age_binned(line: str = "line"):
    """Variable names with their start age (third field after the block) replaced by its age group."""
    age = F.regexp_extract(F.col(line), r"^(C_\d+_\w_)(\d+)(_.*)$", 2).try_cast("int")
    return F.when(age.isNotNull(), F.concat(F.regexp_extract(F.col(line), r"^(C_\d+_\w_)(\d+)(_.*)$", 1), age_bin(age).cast("string"), F.regexp_extract(F.col(line), r"^(C_\d+_\w_)(\d+)(_.*)$", 3))).otherwise(F.col(line))


def split_blocks(found: DataFrame, relax: bool) -> DataFrame:
    """Terms of a tract model by block (first 15 digits in the variable's name). Constraints over several blocks are dropped, or relaxed to <=."""
    x = found.withColumn("block", F.regexp_extract("variable", r"^C_(\d{15})_", 1))
    spread = x.groupBy("constraint").agg(F.count_distinct("block").alias("_b"))
    x = x.join(spread, "constraint")
    return (x if relax else x.where("_b = 1")).select("block", "constraint", "variable", F.when(F.col("_b") > 1, "<=").otherwise("=").alias("sense"))


def microdata(solution: DataFrame) -> DataFrame:
    """People of a solver's solution lines ("name value"): ones are emitted, zeros not, other values are an error."""
    x = solution.where(F.col("line").startswith("C_")).select(F.split(F.trim("line"), r"\s+").alias("p"))
    v = F.round(F.expr("try_cast(p[1] as double)")).cast("int")
    ok = F.when(F.coalesce(v.isin(0, 1), F.lit(False)), v).otherwise(F.raise_error(F.lit("a value of the solution is neither 0 nor 1")).cast("int"))
    f = F.split(F.col("p")[0], "_")
    rows = x.withColumns({"_v": ok, "f": f}).where("_v = 1")
    return rows.select(F.substring(F.col("f")[1], 1, 11).alias("geoid_tract"), F.col("f")[1].alias("geoid_block"), F.col("f")[5].alias("sex"), F.col("f")[6].cast("int").alias("age"), *[F.col("f")[7 + i].alias(n) for i, n in enumerate(FLAGS)])


def solution_people(solution: DataFrame) -> DataFrame:
    """Number of chosen people in solution lines; lines that name no person or have no number count as none."""
    value = F.get(F.split(F.trim("line"), r"\s+"), F.lit(1)).try_cast("double")
    return solution.agg(F.coalesce(F.sum(F.when(F.col("line").startswith("C_") & (F.round(value) == 1), 1)), F.lit(0)).cast("long").alias("people"))


def _search(rows: pd.DataFrame, limit: int) -> tuple[str, list[dict[str, int]]]:
    """Feasible 0/1 vectors by depth-first search with bounds, and whether all were seen."""
    names = sorted(rows["variable"].unique())
    cons = [(set(g["variable"]), float(g["rhs"].iloc[0]), g["sense"].iloc[0]) for _, g in rows.groupby("constraint")]
    member = [[j for j, (s, _, _) in enumerate(cons) if n in s] for n in names]
    left = [len(s) for s, _, _ in cons]
    have = [0] * len(cons)
    found, steps = [], 0
    stack: list[tuple[int, int]] = [(0, 1), (0, 0)]
    trail: list[int] = []
    while stack:
        i, v = stack.pop()
        while len(trail) > i:
            k = len(trail) - 1
            w = trail.pop()
            for j in member[k]:
                left[j] += 1
                have[j] -= w
        steps += 1
        if steps > limit:
            return "TIMEOUT", found
        trail.append(v)
        ok = True
        for j in member[i]:
            left[j] -= 1
            have[j] += v
        for j in member[i]:
            _, rhs, sense = cons[j]
            if (sense != ">=" and have[j] > rhs) or (sense != "<=" and have[j] + left[j] < rhs):
                ok = False
        if ok and i + 1 == len(names):
            found.append(dict(zip(names, trail, strict=True)))
        elif ok:
            stack += [(i + 1, 1), (i + 1, 0)]
    return ("OPTIMAL" if found else "INFEASIBLE"), found


def solved(model: DataFrame, by: str = "geo", limit: int = 200_000) -> DataFrame:
    """First feasible solution of each small model (by, constraint, variable, sense, rhs): by, variable, value, status.

    An exact search in place of a commercial solver; a model that takes more than ``limit`` steps is TIMEOUT.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        status, found = _search(p, limit)
        one = found[0] if found else {n: None for n in sorted(p["variable"].unique())}
        return pd.DataFrame({by: p[by].iloc[0], "variable": list(one), "value": pd.array(list(one.values()), dtype="Int32"), "status": status})

    return model.select(by, "constraint", "variable", "sense", "rhs").groupBy(by).applyInPandas(run, f"{by} string, variable string, value int, status string")


def conflicts(model: DataFrame, by: str = "geo", limit: int = 200_000) -> DataFrame:
    """For each small model without a solution an irreducible set of constraints that no choice satisfies: by, constraint.

    Constraints are left out one after the other, in order of their names, as long as the rest has
    no solution. Models with a solution, or that take more than ``limit`` steps, give no rows.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        kept = sorted(p["constraint"].unique()) if _search(p, limit)[0] == "INFEASIBLE" else []
        for c in list(kept):
            rest = [x for x in kept if x != c]
            if rest and _search(p[p["constraint"].isin(rest)], limit)[0] == "INFEASIBLE":
                kept = rest
        return pd.DataFrame({by: pd.Series([p[by].iloc[0]] * len(kept), dtype="object"), "constraint": pd.Series(kept, dtype="object")})

    return model.select(by, "constraint", "variable", "sense", "rhs").groupBy(by).applyInPandas(run, f"{by} string, constraint string")


def _farthest(rows: np.ndarray) -> float:
    """Largest L1 distance between two rows."""
    return float(max((np.abs(rows - r).sum(1).max() for r in rows), default=0))


def variability(model: DataFrame, by: str = "geo", limit: int = 200_000, shapes: int = 5_000) -> DataFrame:
    """Per small model the largest L1 and earth mover's distance between the histograms of two feasible solutions.

    Histograms count by all fields of a variable's name but the person number; the mover's distance runs over
    age, as the L1 distance of running sums in each block. Distances are null on TIMEOUT (more than ``limit`` steps, or more
    than ``shapes`` different histograms), as solutions that were not compared may lie farther apart.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        status, found = _search(p, limit)
        names = sorted(p["variable"].unique())
        fields = [n.split("_") for n in names]
        cells = sorted({"_".join([*f[:4], *f[5:]]) for f in fields})
        blocks = sorted({f[1] for f in fields})
        shape, ages = np.zeros((len(names), len(cells)), np.int32), np.zeros((len(names), len(blocks), 111), np.int32)
        for i, f in enumerate(fields):
            shape[i, cells.index("_".join([*f[:4], *f[5:]]))] = 1
            ages[i, blocks.index(f[1]), int(f[6]) :] = 1
        chosen = np.array([[s[n] for n in names] for s in found], np.int32).reshape(len(found), len(names))
        one, two = np.unique(chosen @ shape, axis=0), np.unique(chosen @ ages.reshape(len(names), -1), axis=0)
        if max(len(one), len(two)) > shapes:
            status = "TIMEOUT"
        late = status == "TIMEOUT"
        return pd.DataFrame({by: [p[by].iloc[0]], "status": [status], "solutions": [len(found)], "l1": [None if late else _farthest(one)], "emd": [None if late else _farthest(two)]})

    return model.select(by, "constraint", "variable", "sense", "rhs").groupBy(by).applyInPandas(run, f"{by} string, status string, solutions long, l1 double, emd double")
