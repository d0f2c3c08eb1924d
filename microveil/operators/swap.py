"""Household swapping: noisy keys, pseudo areas, pairs of neighbours in a sorted sequence, exchange, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microveil.operators.tabulate import ranked
from microveil.sources.writers import kept

# Target rate, noise cuts, group shares of the two published settings.
SETTINGS = {"HI": {"target": 0.5, "cuts": (0.5, 0.75), "shares": (0.3, 0.4)}, "LO": {"target": 0.05, "cuts": (1.0, 1.0), "shares": (1.0, 0.0)}}


def noisy_key(size: Column, u: Column, cuts: tuple[float, float]) -> Column:
    """Size, less 1 where cut1 < u <= cut2, plus 1 above cut2."""
    return F.when((u > cuts[0]) & (u <= cuts[1]), size - 1).when(u > cuts[1], size + 1).otherwise(size)


def shuffled(df: DataFrame, column: str, within: Sequence[str], order: Sequence[str], draw: str, name: str) -> DataFrame:
    """A column permuted inside groups: rank in the original order meets rank in the random order. A group may be most of the table."""
    a = ranked(df, within, order, "_r")
    b = ranked(df.select(*dict.fromkeys([*within, draw, *order, column])), within, [draw, *order], "_r")
    return a.join(b.select(*within, "_r", F.col(column).alias(name)), [*within, "_r"], "left").drop("_r")


def pseudo_area(df: DataFrame, area: str, county: Sequence[str], state: Sequence[str], order: Sequence[str], u: str, shares: tuple[float, float], name: str) -> DataFrame:
    """Own area for u below the first share, one permuted in the county up to the second share more, else one permuted in the state."""
    x = shuffled(df, area, county, order, u, "_county")
    x = shuffled(x, area, state, order, u, "_state")
    return x.withColumn(name, F.when(F.col(u) < shares[0], F.col(area)).when(F.col(u) < sum(shares), F.col("_county")).otherwise(F.col("_state"))).drop("_county", "_state")


def selected(df: DataFrame, rate: float, keys: Sequence[str], out: str = "selected") -> DataFrame:
    """Deselects to a target rate by comparing a hash of the keys, as a number in [0, 1), with the rate (capped at 0.99)."""
    u = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn(out, u < min(rate, 0.99))


def eligible(households: DataFrame, key: Sequence[str], block: str, draw: Column) -> DataFrame:
    """All households as swap candidates (``prep`` 3), with ``unique`` (1 where alone with its key in its block) and ``ranno``, a random order kept as a column."""
    alone = (F.count(F.lit(1)).over(Window.partitionBy(*key, block)) == 1).cast("int")
    return households.withColumns({"unique": alone, "ranno": draw, "prep": F.lit(3)})


def swap_estimate(df: DataFrame, key: Sequence[str], order: Sequence[str], chosen: str, rate: float) -> DataFrame:
    """One row: households, how many the runs of chosen neighbours would swap (an odd run takes one more), the target, and how many to deselect.

    A run of one that is alone in its key can't swap and counts for nothing.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    start = (F.col(chosen) & ~F.coalesce(F.lag(chosen).over(w), F.lit(False))).cast("int")
    x = df.withColumns({"_start": start, "_all": F.count(F.lit(1)).over(Window.partitionBy(*key))}).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.where(F.col(chosen)).groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("n"), F.max("_all").alias("_all"))
    swaps = runs.agg(F.coalesce(F.sum(F.when(F.col("_all") > 1, F.col("n") + F.col("n") % 2)), F.lit(0)).cast("long").alias("projected"))
    total = df.agg(F.count(F.lit(1)).cast("long").alias("households"))
    return total.crossJoin(swaps).withColumn("target", F.col("households") * F.lit(rate)).withColumn("deselect", F.greatest(F.lit(0).cast("long"), F.round(F.col("projected") - F.col("target")).cast("long")))


def deselected(df: DataFrame, estimate: DataFrame, chosen: str, draw: Column) -> DataFrame:
    """Leaves out chosen rows until about the target is left: each stays with the same chance.

    With one independent uniform ``draw`` in [0, 1) a row, the number left out of a run of n is
    binomial (n, deselect / projected), as if drawn run by run. ``estimate`` is one row of ``swap_estimate``.
    """
    share = F.coalesce(F.try_divide(F.col("deselect").cast("double"), F.col("projected")), F.lit(0.0))
    one = F.broadcast(estimate.select(share.alias("_share")))  # a single row
    return df.crossJoin(one).withColumn(chosen, F.col(chosen) & (draw >= F.col("_share"))).drop("_share")


def binomial(n: Column, p: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability among ``n`` trials of chance ``p`` is at least ``u``: a draw by inversion of a uniform in [0, 1)."""
    odds = F.ln(p / (F.lit(1.0) - p))
    begin = F.struct(F.lit(0).cast("long").alias("k"), (n * F.ln(F.lit(1.0) - p)).alias("lp"), F.exp(n * F.ln(F.lit(1.0) - p)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        lp = s["lp"] + F.ln((n - k + 1).cast("double") / k) + odds  # in logs, so long runs don't underflow
        more = F.struct(k.cast("long").alias("k"), lp.alias("lp"), (s["cdf"] + F.exp(lp)).alias("cdf"))
        return F.when(s["cdf"] >= u, s).otherwise(more)

    drawn = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), begin, step, lambda s: s["k"])
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("long")).when(p >= 1, n.cast("long")).otherwise(drawn)


def _numbered_runs(df: DataFrame, key: Sequence[str], order: Sequence[str], chosen: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    start = (F.col(chosen) & ~F.coalesce(F.lag(chosen).over(w), F.lit(False))).cast("int")
    return df.withColumn("_start", start).withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def key_targets(df: DataFrame, key: Sequence[str], order: Sequence[str], chosen: str, rate: float) -> DataFrame:
    """Per key: households, how many its runs of chosen neighbours would swap (an odd run takes one more), the target, and how many to deselect.

    A chosen household that is alone in its key can't swap.
    """
    x = _numbered_runs(df, key, order, chosen)
    runs = x.groupBy(*key, "_run").agg(F.sum(F.col(chosen).cast("int")).alias("n"), F.count(F.lit(1)).alias("rows"))
    sums = runs.groupBy(*key).agg(F.sum("rows").cast("long").alias("households"), F.sum(F.col("n") + F.col("n") % 2).cast("long").alias("projected"))
    sums = sums.withColumn("projected", F.when(F.col("households") > 1, F.col("projected")).otherwise(F.lit(0)))
    target = F.col("households") * F.lit(rate)
    return sums.withColumns({"target": target, "deselect": F.greatest(F.lit(0).cast("long"), F.round(F.col("projected") - target).cast("long"))})


def deselected_by_run(df: DataFrame, targets: DataFrame, key: Sequence[str], order: Sequence[str], chosen: str, u: str, draw: str) -> DataFrame:
    """Leaves out chosen rows run by run until about each key's target is left.

    A run of odd length n leaves out as many as a binomial draw from n says, one less where that is even and not none, so that
    what is left has even length; a run of even length twice a draw from n / 2. The chance is deselect / projected of the key (``key_targets``),
    the uniform of a run that of its first row in column ``u``; of a run go the rows with the smallest ``draw`` (ties by ``order``). So
    the choice can be repeated from the stored columns. Keys without a target leave out nothing.
    """
    x = _numbered_runs(df, key, order, chosen)
    first = F.min_by(u, F.struct(*order))
    runs = x.where(F.col(chosen)).groupBy(*key, "_run").agg(F.count(F.lit(1)).alias("_n"), first.alias("_u"))
    p = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("deselect").cast("double"), F.col("projected")), F.lit(0.0)))
    with_p = runs.join(targets.select(*key, p.alias("_share")), list(key), "left").na.fill(0.0, ["_share"])
    odd = binomial(F.col("_n"), F.col("_share"), F.col("_u"))
    even = binomial((F.col("_n") / 2).cast("long"), F.col("_share"), F.col("_u")) * 2
    take = F.when(F.col("_n") % 2 == 0, even).otherwise(odd - F.when((odd > 0) & (odd % 2 == 0), 1).otherwise(0))
    taken = with_p.select(*key, "_run", take.alias("_take"))
    place = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(F.desc(chosen), draw, *order))
    both = x.withColumn("_place", place).join(taken, [*key, "_run"], "left")
    left = F.col(chosen) & ~F.coalesce(F.col("_place") <= F.col("_take"), F.lit(False))
    return both.withColumn(chosen, left).select(*df.columns)


def adjacent_pairs(df: DataFrame, key: Sequence[str], order: Sequence[str], id_col: str) -> DataFrame:
    """Pairs 1-2, 3-4, ... of the selected rows of each key in order; the last of an odd number stays unpaired. Columns a and b."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = df.withColumns({"_n": F.row_number().over(w), "b": F.lead(id_col).over(w)})
    return x.where("_n % 2 = 1 AND b IS NOT NULL").select(*key, F.col(id_col).alias("a"), "b")


def runs_paired(df: DataFrame, key: Sequence[str], order: Sequence[str], chosen: str, id_col: str, before: bool = False, tract: str | None = None) -> DataFrame:
    """Pairs inside runs of chosen neighbours; an odd run borrows the unchosen row after it, with ``before`` else the one before, else leaves its last out.

    With ``before`` and ``tract``, the row before goes first where it alone is in the tract of the run's end that it
    touches. Runs choose in order: a free row between two goes to the run before it if that wants it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    free = lambda f: ~F.coalesce(f(chosen).over(w), F.lit(True))
    same = lambda f: F.col(tract).eqNullSafe(f(tract).over(w)) if tract else F.lit(True)
    start = (F.col(chosen) & ~F.coalesce(F.lag(chosen).over(w), F.lit(False))).cast("int")
    x = df.withColumns({"_at": F.row_number().over(w), "_start": start, "_prev": F.lag(id_col).over(w), "_prev_free": free(F.lag) if before else F.lit(False), "_prev_same": same(F.lag), "_next": F.lead(id_col).over(w), "_next_free": free(F.lead), "_next_same": same(F.lead)})
    x = x.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(chosen))
    run = Window.partitionBy(*key, "_run").orderBy("_at")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = Window.partitionBy(*key).orderBy("_at")
    # shared: one row lies between the run and the one before it
    x = x.withColumns({"_p": F.row_number().over(run), "_n": F.count(F.lit(1)).over(whole), "_b": F.lead(id_col).over(run), "_shared": F.coalesce(F.col("_at") - F.lag("_at").over(line) == 2, F.lit(False))})
    x = x.withColumns({c: f(c).over(whole) for c, f in {"_shared": F.first, "_prev_free": F.first, "_prev_same": F.first, "_next_free": F.last, "_next_same": F.last}.items()})
    # 1 for a run that takes the row after it, null where it does so only if the run before it does
    fit = F.col("_prev_free") & F.col("_prev_same") & ~F.col("_next_same")
    x = x.withColumn("_takes", F.when((F.col("_n") % 2 == 0) | ~F.col("_next_free"), 0).when(~fit, 1).when(~F.col("_shared"), 0))
    x = x.withColumn("_takes", F.last("_takes", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    left = (F.col("_n") % 2 == 1) & (F.col("_takes") == 0) & F.col("_prev_free")
    taken = F.first(F.col("_shared") & (F.coalesce(F.col("_last"), F.lit(0)) == 1)).over(whole)
    x = x.withColumn("_last", F.lag("_takes").over(line)).withColumn("_left", left & ~taken)
    first = F.col("_left") & (F.col("_p") == 1)
    other = F.when(F.col("_p") < F.col("_n"), F.col("_b")).when(F.col("_takes") == 1, F.col("_next"))
    pair = F.when(first, F.col(id_col)).when(F.col("_p") % 2 == F.when(F.col("_left"), 0).otherwise(1), other)
    return x.select(*key, F.when(first, F.col("_prev")).otherwise(F.col(id_col)).alias("a"), pair.alias("b")).where("b IS NOT NULL")


def exchange(households: DataFrame, pairs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Exchanges columns between the two keys of each pair; keys occur in one pair at most. Adds ``swapped``."""
    both = pairs.select(F.col("a").alias(key), F.col("b").alias("_o")).unionByName(pairs.select(F.col("b").alias(key), F.col("a").alias("_o")))
    other = households.select(F.col(key).alias("_o"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    x = households.join(both, key, "left").join(other, "_o", "left")
    moved = {c: F.coalesce(f"_new_{c}", c) for c in columns}
    return x.withColumns(moved).withColumn("swapped", F.col("_o").isNotNull().cast("int")).select(*households.columns, "swapped")


def moves(pairs: DataFrame, order: str, rounds: int = 64) -> DataFrame:
    """(key, to): where what was at ``key`` is after all pairs (a, b) have changed places one after the other, in ``order``.

    Keys may be in any number of pairs; ``order`` numbers the pairs. What enters a pair at one key leaves it at the other
    and meets the next pair of that key, so every (pair, key) points to one other; pointers are doubled
    until all have reached a key without further pairs: as many rounds as the logarithm of the longest chain. Pairs of a key with
    itself, and with null, change nothing.
    """
    p = pairs.where("a <> b").select(F.col(order).alias("e"), "a", "b")
    sides = p.select("e", F.col("a").alias("k"), F.col("b").alias("o")).unionByName(p.select("e", F.col("b").alias("k"), F.col("a").alias("o")))
    w = Window.partitionBy("k").orderBy("e")
    sides = kept(sides.withColumns({"next": F.lead("e").over(w), "first": F.row_number().over(w) == 1}))
    other = sides.select("e", F.col("k").alias("o"), F.col("next").alias("to_e"))
    at = kept(sides.join(other, ["e", "o"]).select("e", "k", "first", "to_e", F.col("o").alias("to_k")))
    for _ in range(rounds):
        if at.where("to_e IS NOT NULL").isEmpty():
            return at.where("first").select(F.col("k").alias("key"), F.col("to_k").alias("to"))
        ends = at.select(F.col("e").alias("to_e"), F.col("k").alias("to_k"), F.col("to_e").alias("_e"), F.col("to_k").alias("_k"))
        moving = at.where("to_e IS NOT NULL").join(ends, ["to_e", "to_k"]).select("e", "k", "first", F.col("_e").alias("to_e"), F.col("_k").alias("to_k"))
        at = kept(at.where("to_e IS NULL").unionByName(moving))
    raise RuntimeError(f"chains of pairs did not end in {rounds} rounds")


def exchange_in_order(households: DataFrame, pairs: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """``exchange`` for keys that may be in several pairs: pairs (a, b) are taken one after the other in ``order``. Adds ``swapped``, 1 for a key in a pair.

    A pair with a key that no household has is left out.
    """
    known = households.select(key)
    real = pairs.join(known.withColumnRenamed(key, "a"), "a", "left_semi").join(known.withColumnRenamed(key, "b"), "b", "left_semi")
    from_ = moves(real, order).select(F.col("key").alias("_o"), F.col("to").alias(key))
    other = households.select(F.col(key).alias("_o"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    x = households.join(from_, key, "left").join(other, "_o", "left")
    moved = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return x.withColumns(moved).withColumn("swapped", F.col("_o").isNotNull().cast("int")).select(*households.columns, "swapped")


def follow(people: DataFrame, households: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """People take their household's columns where it has them."""
    h = households.select(key, *[F.col(c).alias(f"_h_{c}") for c in columns])
    return people.join(h, key, "left").withColumns({c: F.coalesce(f"_h_{c}", c) for c in columns}).select(*people.columns)


def evaluation(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Counts over all subsets of the class columns; null stands for all."""
    return df.cube(*classes).agg(F.count(F.lit(1)).cast("long").alias("n"), F.grouping_id().cast("long").alias("subset"))
