"""One-to-one record linkage inside blocks, in stages, each on what the stages before left over.

Equality stages need no search: inside a block and match key the greedy rule pairs the
left rows, last first, with the right rows, first first. So a row is matched if its rank on
its side is not above the other side's count, all by windows; both sides are dealt out once,
by block and all keys but age (so a large block is many parts), and every such stage reuses
that. Stages whose predicate isn't transitive (ages one year apart, one attribute off) run
the greedy rule itself on the leftovers of blocks that have both sides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microveil.functions.bins import age_bin

FLAGS = {"exact": 1, "fzyage": 2, "binage": 3, "oneoff": 4}


@dataclass
class Spec:
    """What to link on. ``order`` breaks ties on the right after the keys; ``names`` of ids must be unique."""

    block: Sequence[str]
    keys: Sequence[str]
    age: str = "age"
    left_id: str = "id"
    right_id: str = "id"
    right_order: Sequence[str] = ()
    stages: Sequence[str] = ("exact", "binage")
    soft: Sequence[str] = field(default_factory=tuple)  # attributes that oneoff lets differ; by default all keys but age


def _near_ages(left: list[int], right: list[int], age: list) -> list[tuple[int, int]]:
    """Rows as positions; all other keys are equal, and ``right`` goes by age, so the first of a year or less apart is found by bisection."""
    ages = [age[j] for j in right]
    after = list(range(len(right) + 1))  # the first row from here on that is still free

    def free(j: int) -> int:
        while after[j] != j:
            after[j] = after[after[j]]
            j = after[j]
        return j

    out = []
    for i in reversed(left):
        j = free(bisect_left(ages, age[i] - 1))
        if j < len(right) and ages[j] <= age[i] + 1:
            out.append((i, right[j]))
            after[j] = j + 1
    return out


def _one_off(left: list[int], right: list[int], age: list, soft: list[tuple]) -> list[tuple[int, int]]:
    """Rows as positions. Each free right row waits in one queue for every attribute left out; the first fit is the least head of a few queues."""
    names = range(len(soft[0])) if soft and soft[0] else ()
    rest = lambda x, k: (k, *x[:k], *x[k + 1 :])
    queues: dict[tuple, deque] = {}
    for j in right:
        for k in names:
            queues.setdefault((age[j], *rest(soft[j], k)), deque()).append(j)
    used: set[int] = set()
    out = []
    for i in reversed(left):
        best = None
        for a in (age[i] - 1, age[i], age[i] + 1):
            for k in names:
                q = queues.get((a, *rest(soft[i], k)))
                while q and q[0] in used:
                    q.popleft()
                if q and (best is None or q[0] < best):
                    best = q[0]
        if best is not None:
            used.add(best)
            out.append((i, best))
    return out


def _greedy(parts, spec: Spec, stage: str, soft: list[str]):
    """The greedy rule on whole groups; parts are sorted by group (``_group``), then side and sort order. Ages are whole years."""

    def pairs(p: pd.DataFrame) -> pd.DataFrame | None:
        side, ids, age = p["_side"].to_numpy(), p["_id"].tolist(), p[spec.age].tolist()
        left, right = (np.flatnonzero(side == s).tolist() for s in (0, 1))
        found = _near_ages(left, right, age) if stage == "fzyage" else _one_off(left, right, age, list(zip(*[p[k].tolist() for k in soft], strict=True)))
        if not found:
            return None
        a, b = [ids[i] for i, _ in found], [ids[j] for _, j in found]
        return pd.DataFrame({"_side": np.repeat([0, 1], len(a)).astype("int32"), "_id": a + b, "_pair": [f"{x}/{y}" for x, y in zip(a, b, strict=True)] * 2})

    held: list[pd.DataFrame] = []
    for p in parts:
        group = p["_group"].to_numpy()
        if not len(group):
            continue
        head = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for lo, hi in zip(head, head[1:], strict=False):
            if held and held[0]["_group"].iloc[0] != group[lo]:
                if (out := pairs(pd.concat(held, ignore_index=True))) is not None:
                    yield out
                held = []
            held.append(p.iloc[lo:hi])
    if held and (out := pairs(pd.concat(held, ignore_index=True))) is not None:
        yield out


def linked(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """Rows of both sides: _side, _id, the block and key columns, _flag (null if left over) and _pair (equal for the two of a match).

    Null keys never match. Blocks on one side only stay, unmatched.
    """
    keys, block = list(spec.keys), list(spec.block)
    extra = [F.col(c).alias(f"_o{i}") for i, c in enumerate(spec.right_order)]
    blank = [F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(spec.right_order)]
    a = left.select(F.lit(0).alias("_side"), F.col(spec.left_id).alias("_id"), *block, *keys, *blank)
    b = right.select(F.lit(1).alias("_side"), F.col(spec.right_id).alias("_id"), *block, *keys, *extra)
    rows = a.unionByName(b).repartition(*block, *(k for k in keys if k != spec.age)).withColumns({"_flag": F.lit(None).cast("int"), "_pair": F.lit(None).cast("string")})
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    order = [*keys, *[f"_o{i}" for i in range(len(spec.right_order))], "_id"]
    for stage in spec.stages:
        flag = FLAGS[stage]
        free = F.col("_flag").isNull() & whole
        if stage in ("exact", "binage"):
            on = [F.col(k) if stage == "exact" or k != spec.age else F.col("_bin") for k in keys]
            rows = rows.withColumns({"_free": free, "_bin": age_bin(F.col(spec.age))} if stage == "binage" else {"_free": free})
            free = F.col("_free")
            # one sort serves both windows: left rows go last first, right rows first first, and the other keys are equal
            is_left = F.col("_side") == 0
            by_age = [F.desc(F.when(is_left, F.col(spec.age))), F.when(~is_left, F.col(spec.age))] if stage == "binage" else []
            mine = Window.partitionBy(*block, *on, free, "_side").orderBy(*by_age, F.desc(F.when(is_left, F.col("_id"))), *order[len(keys) :])
            rows = rows.withColumn("_rank", F.row_number().over(mine))
            rank = F.col("_rank")
            # a side's last rank is its count
            both = Window.partitionBy(*block, *on, free)
            lefts, rights = (F.coalesce(F.max(F.when(c, rank)).over(both), F.lit(0)) for c in (is_left, ~is_left))
            hit = free & (rank <= F.least(lefts, rights))
            name = F.concat_ws("/", F.lit(str(flag)), *[c.cast("string") for c in on], rank.cast("string"))
            rows = rows.withColumns({"_hit": hit, "_name": name})
            rows = rows.withColumns({"_flag": F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("_flag")), "_pair": F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("_pair"))}).drop("_hit", "_name", "_free", "_bin", "_rank")
        else:
            soft = list(spec.soft) or [k for k in keys if k != spec.age]
            # in the fuzzy stage all keys but age are equal, so a block splits by them
            by = [*block, *(k for k in keys if k != spec.age)] if stage == "fzyage" else block
            group = Window.partitionBy(*by)
            rest = rows.where(free).withColumns({"_l": F.sum(1 - F.col("_side")).over(group), "_r": F.sum("_side").over(group)}).where("_l > 0 AND _r > 0")
            kind = rows.schema["_id"].dataType.simpleString()
            rest = rest.drop("_l", "_r").withColumn("_group", F.to_json(F.struct(*by)))
            dealt = rest.repartition(*by).sortWithinPartitions("_group", "_side", *order)
            found = dealt.mapInPandas(partial(_greedy, spec=spec, stage=stage, soft=soft), f"_side int, _id {kind}, _pair string").withColumnRenamed("_pair", "_new")
            rows = rows.join(found, ["_side", "_id"], "left")
            rows = rows.withColumns({"_flag": F.when(F.col("_new").isNotNull(), F.lit(flag)).otherwise(F.col("_flag")), "_pair": F.coalesce("_pair", F.concat(F.lit(f"{flag}/"), "_new"))}).drop("_new")
    return rows


def matches(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row per match: block columns, left_id, right_id, flag."""
    block = list(spec.block)
    pairs = rows.where(F.col("_flag").isNotNull()).groupBy(*block, F.col("_flag").alias("flag"), "_pair")
    ids = pairs.agg(F.max(F.when(F.col("_side") == 0, F.col("_id"))).alias("left_id"), F.max(F.when(F.col("_side") == 1, F.col("_id"))).alias("right_id"))
    return ids.select(*block, "left_id", "right_id", "flag")


def block_stats(rows: DataFrame, spec: Spec) -> DataFrame:
    """One row per block: n_left, n_right and matches by stage; on a block of one side the missing count and all matches are null."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    stages = {s: count((F.col("_side") == 0) & F.coalesce(F.col("_flag") == FLAGS[s], F.lit(False))) for s in spec.stages}
    out = rows.groupBy(*spec.block).agg(count(F.col("_side") == 0).alias("n_left"), count(F.col("_side") == 1).alias("n_right"), *[c.alias(s) for s, c in stages.items()])
    two = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    return out.select(*spec.block, F.expr("nullif(n_left, 0)").alias("n_left"), F.expr("nullif(n_right, 0)").alias("n_right"), *[F.when(two, F.col(s)).alias(s) for s in stages])


def equal_stats(left: DataFrame, right: DataFrame, spec: Spec) -> DataFrame:
    """``block_stats`` of ``linked`` where all stages are equality stages, from counts by block and keys: no row is ranked or sorted.

    A group of equal keys has as many matches as the smaller of its two counts; what the exact stage leaves over of each age
    adds up to the counts of the age groups. After a stage by age group none of equal age are left on both sides.
    """
    block, keys = list(spec.block), list(spec.keys)
    if not spec.stages or set(spec.stages) - {"exact", "binage"}:
        raise ValueError("only the stages exact and binage can be counted")
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    rows = left.select(F.lit(0).alias("_side"), *block, *keys).unionByName(right.select(F.lit(1).alias("_side"), *block, *keys))
    total = lambda c: F.sum(c).cast("long")
    cells = rows.groupBy(*block, *keys).agg(total(1 - F.col("_side")).alias("n_left"), total(F.col("_side")).alias("n_right"))
    zero = F.lit(0).cast("long")
    first = F.when(whole, F.least("n_left", "n_right")).otherwise(zero) if spec.stages[0] == "exact" else zero
    cells = cells.withColumns({"_whole": whole, "_first": first})
    same = [age_bin(F.col(k)).alias("_bin") if k == spec.age else F.col(k) for k in keys]
    groups = cells.groupBy(*block, *same, "_whole").agg(total("n_left").alias("n_left"), total("n_right").alias("n_right"), total("_first").alias("_first"))
    later = F.when(F.col("_whole"), F.least("n_left", "n_right") - F.col("_first")).otherwise(zero)
    out = groups.groupBy(*block).agg(total("n_left").alias("n_left"), total("n_right").alias("n_right"), total("_first").alias("_first"), total(later).alias("_later"))
    two = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    found = {s: zero for s in spec.stages}
    if spec.stages[0] == "exact":
        found["exact"] = F.col("_first")
    if "binage" in spec.stages:
        found["binage"] = F.col("_later")
    return out.select(*block, F.expr("nullif(n_left, 0)").alias("n_left"), F.expr("nullif(n_right, 0)").alias("n_right"), *[F.when(two, c).alias(s) for s, c in found.items()])


def common_only(left: DataFrame, right: DataFrame, area: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to areas that both have (left semi joins)."""
    a, b = left.select(*area).distinct(), right.select(*area).distinct()
    return left.join(b, list(area), "left_semi"), right.join(a, list(area), "left_semi")


def audit(left: DataFrame, right: DataFrame, spec: Spec, area: Sequence[str] = (), usable: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches and block statistics of one linkage run.

    With ``area``, areas that one side lacks vanish, blocks of one side inside shared areas
    stay. ``usable`` is a condition on right rows; an area without usable right rows then has
    no statistics either.
    """
    right = right.where(usable) if usable else right
    if area:
        left, right = common_only(left, right, area)
    rows = linked(left, right, spec)
    return matches(rows, spec), block_stats(rows, spec)


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str], present: str) -> DataFrame:
    """Adds ``keep``: 1 for the first row of each group, 0 for others and where ``present`` is null."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("keep", F.when(F.col(present).isNotNull() & (F.row_number().over(w) == 1), 1).otherwise(0))


def putative(left: DataFrame, right: DataFrame, block: Sequence[str], draw: str, pik: str = "pik", left_id: str = "id", right_id: str = "id", keep: str | None = "keep") -> DataFrame:
    """Attaches a person identifier: left rows matched on sex and age (exact, then age group) to right rows that may be kept.

    Rows: block columns, left_id, right_id, flag, pik. Right rows without an identifier, or with keep other than 1, take no part.
    """
    usable = right.where(F.col(pik).isNotNull())
    if keep:
        usable = usable.where(F.col(keep) == 1)
    spec = Spec(block, ("sex", "age"), left_id=left_id, right_id=right_id, right_order=(draw,))
    found = matches(linked(left, usable, spec), spec)
    return found.join(usable.select(F.col(right_id).alias("right_id"), F.col(pik).alias("pik")), "right_id").select(*block, "left_id", "right_id", "flag", "pik")


def confirm(attached: DataFrame, truth: DataFrame, block: Sequence[str], attributes: Sequence[str], left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Matches of rows with an attached identifier to the truth on sex, age, identifier and attributes."""
    spec = Spec(block, ("sex", "age", "pik", *attributes), left_id=left_id, right_id=right_id)
    return matches(linked(attached, truth, spec), spec)


def agreement_rates(stats: DataFrame, by: Sequence, middle: str = "fzyage") -> DataFrame:
    """Totals by group with cumulative stage counts and rates over left rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = stats.groupBy(*by).agg(total("n_left").alias("pop"), total("exact").alias("exact"), total(F.coalesce(F.col("exact"), F.lit(0)) + F.coalesce(F.col(middle), F.lit(0))).alias(middle))
    return out.withColumns({"exact_rate": F.round(F.try_divide(F.col("exact").cast("double"), F.col("pop")), 6), f"{middle}_rate": F.round(F.try_divide(F.col(middle).cast("double"), F.col("pop")), 6)})
