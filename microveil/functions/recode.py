"""Recodes between the encodings of race, sex, dates and identifiers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RACES = ("white", "black", "aian", "asian", "nhopi", "sor")
#: The 63 codes number all non-empty sets of six races, smaller sets first, each size in the order of RACES.
RACE_SETS = [s for size in range(1, 7) for s in combinations(range(6), size)]
# First code of each number of races, and the code after the last.
RACE_COUNT_EDGES = (1, 7, 22, 42, 57, 63, 64)


def race_flags(code: Column) -> dict[str, Column]:
    """Six Y/N flags of a 63-code; null for a code out of range."""
    inside = code.between(1, 63)
    return {r: F.when(inside, F.when(code.isin([i + 1 for i, s in enumerate(RACE_SETS) if j in s]), "Y").otherwise("N")) for j, r in enumerate(RACES)}


def race_code(flags: list[Column]) -> Column:
    """The 63-code of six Y/N flags; null if none is Y."""
    key = F.concat(*[F.coalesce(f, F.lit("N")) for f in flags])
    table = F.create_map(*[x for i, s in enumerate(RACE_SETS) for x in (F.lit("".join("Y" if j in s else "N" for j in range(6))), F.lit(i + 1))])
    return F.try_element_at(table, key)


def race_seven(code: Column) -> Column:
    """Codes 1 to 6 alone, 7 for two or more."""
    return F.when(code.between(1, 6), code).when(code.between(7, 63), F.lit(7))


def race_count(code: Column) -> Column:
    out = F.when(code < 1, F.lit(None))
    for n, high in enumerate(RACE_COUNT_EDGES[1:], 1):
        out = out.when(code < high, F.lit(n))
    return out


def in_combination(code: Column, race: int) -> Column:
    """Whether the race (0 to 5) is one of two or more."""
    return code.isin([i + 1 for i, s in enumerate(RACE_SETS) if race in s and len(s) > 1])


def alone_label(flags: dict[str, Column]) -> Column:
    """'x alone' where x is the only flag of 0/1 columns that is 1, else 'other'."""
    total = sum((F.coalesce(c, F.lit(0)) for c in flags.values()), F.lit(0))
    out = F.when(total != 1, "other")
    for name, c in flags.items():
        out = out.when(c == 1, f"{name} alone")
    return out.otherwise("other")


def birth_date(raw: Column) -> Column:
    """A date of yyyymmdd text; 00000000 is missing, a bare year and month is the 2nd, a bare year is 2 April."""
    filled = F.when(raw == "00000000", F.lit(None)).when(F.length(raw) == 6, F.concat(raw, F.lit("02"))).when(F.length(raw) == 4, F.concat(raw, F.lit("0402"))).otherwise(raw)
    return F.try_to_timestamp(filled, F.lit("yyyyMMdd")).cast("date")


def age_on(born: Column, year: int = 2010, month: int = 4, day: int = 1) -> Column:
    """Full years on a day."""
    later = (F.month(born) > month) | ((F.month(born) == month) & (F.dayofmonth(born) > day))
    return F.lit(year) - F.year(born) - later.cast("int")


def sex_code(raw: Column) -> Column:
    """1 for M, 0 for F, else null; case is ignored."""
    x = F.upper(F.trim(raw))
    return F.when(x == "M", 1).when(x == "F", 0)


def recode(x: Column, pairs: dict, default: Column | None = None) -> Column:
    """First matching value wins; else the default, or the value itself."""
    out = None
    for k, v in pairs.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out.otherwise(default if default is not None else x) if out is not None else x


def rule_value(rules: list[tuple[str, object]], default: object) -> Column:
    """Value of the first SQL condition that holds."""
    out = None
    for cond, v in rules:
        out = F.when(F.expr(cond), F.lit(v)) if out is None else out.when(F.expr(cond), F.lit(v))
    return out.otherwise(F.lit(default))


def recoded(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Columns from SQL expressions over the input's columns; nothing is executed but Spark SQL."""
    return df.withColumns({k: F.expr(v) for k, v in rules.items()})


def geo_parts(df: DataFrame, block: str) -> DataFrame:
    """state, county, tract, block group and block codes of a 15-digit block id; a lost leading zero is restored."""
    b = F.when(F.length(block) == 14, F.concat(F.lit("0"), F.col(block))).otherwise(F.col(block))
    part = lambda a, n: F.substring(b, a, n)
    return df.withColumns({"geoid": b, "state": part(1, 2), "county": part(1, 5), "tract": part(1, 11), "tract6": part(6, 6), "blockgroup": part(1, 12), "block4": part(12, 4), "blockid": F.concat(part(6, 6), part(12, 4))})


def cleaned_int(raw: Column | str) -> Column:
    """An integer of text with blanks, quotes or the word null around it; else null."""
    bare = F.trim(F.regexp_replace(F.col(raw) if isinstance(raw, str) else raw, '[\"“”]', ""))
    return F.nullif(F.nullif(bare, F.lit("")), F.lit("null")).try_cast("bigint")


def validated(df: DataFrame, rules: dict[str, list[str]]) -> DataFrame:
    """Adds ``valid`` and ``reason``: for each column the allowed ranges ("a-b") or values; the first column that fits none is the reason."""
    checks = []
    for name, allowed in rules.items():
        ok = F.lit(False)
        for a in allowed:
            low, dash, high = a.partition("-")
            ok = ok | (F.expr(f"try_cast(`{name}` as double)").between(float(low), float(high)) if dash else F.col(name).cast("string") == a)
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    reason = F.coalesce(*checks)
    return df.withColumns({"valid": reason.isNull(), "reason": reason})


def prefixed(df, prefix: str, keep: tuple = ()):
    """The frame with all columns but ``keep`` renamed with a prefix, so that two frames can be joined without clashes."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def distinct_names(names: list[str]) -> list[str]:
    """Column names with repeated ones numbered x, x.1, x.2, in order; a number that is taken is passed over."""
    taken, out = set(names), []
    count: dict[str, int] = {}
    for n in names:
        new = n
        while n in count and (new in taken or new == n):
            new = f"{n}.{count[n]}"
            count[n] += 1
        count.setdefault(n, 1)
        taken.add(new)
        out.append(new)
    return out


def outside(df: DataFrame, geo: str, prefix: str = "72") -> DataFrame:
    """Rows whose geographic id does not begin with a state's code; null ids stay out."""
    return df.where(~F.col(geo).startswith(prefix))
