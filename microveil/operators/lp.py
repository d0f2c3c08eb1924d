"""Large constraint models: containment joins on bit masks, streamed constraint text, and the whole text format read back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microveil.sources.writers import kept

WORD = 62  # bits used of a mask's integer


class Masks:
    """Bits of attribute values: every value of every attribute has a place; a set of values is one integer per ``WORD`` places."""

    def __init__(self, full: dict[str, Sequence]):
        self.full = {a: list(v) for a, v in full.items()}
        self.first, n = {}, 0
        for a, values in self.full.items():
            self.first[a], n = n, n + len(values)
        self.words = -(-n // WORD)

    def place(self, attribute: str, value: Column) -> Column:
        """The value's bit; an error for a value outside the attribute's range."""
        at = F.array_position(F.array(*[F.lit(v) for v in self.full[attribute]]), value)
        return F.when(at > 0, at - 1 + self.first[attribute]).otherwise(F.raise_error(F.concat(F.lit(f"not a value of {attribute}: "), value.cast("string"))).cast("long"))

    def _bit(self, place: Column, word: int) -> Column:
        return F.when(F.floor(place / WORD) == word, F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))).otherwise(F.lit(0).cast("long"))

    def _mask(self, attribute: str, word: int) -> Column:
        def add(acc: Column, value: Column) -> Column:
            return acc.bitwiseOR(self._bit(self.place(attribute, value), word))

        return F.aggregate(self.set_of(attribute), F.lit(0).cast("long"), add)

    def set_of(self, attribute: str) -> Column:
        """A column that is an array of values, the whole range where it is null."""
        return F.coalesce(F.col(attribute), F.array(*[F.lit(v) for v in self.full[attribute]]))

    def places(self, attribute: str) -> Column:
        def place(value: Column) -> Column:
            return self.place(attribute, value)

        return F.array_distinct(F.transform(self.set_of(attribute), place))

    def of_sets(self, attributes: Sequence[str]) -> list[Column]:
        """Masks of columns that are arrays of values; null stands for the whole range."""
        return [reduce(lambda x, y: x.bitwiseOR(y), [self._mask(a, w) for a in attributes]).alias(f"_m{w}") for w in range(self.words)]

    def of_values(self, attributes: Sequence[str]) -> list[Column]:
        """Masks of columns that are single values."""
        return [reduce(lambda x, y: x.bitwiseOR(y), [self._bit(self.place(a, F.col(a)), w) for a in attributes]).alias(f"_v{w}") for w in range(self.words)]


def contained_terms(
    cells: DataFrame,
    variables: DataFrame,
    attributes: Sequence[str],
    full: dict[str, Sequence],
    on: Sequence[str] = ("geo",),
    two_plus: Sequence[str] | None = None,
) -> DataFrame:
    """(geo, constraint, variable): the variables whose value of every attribute is in the cell's set.

    ``cells`` has geo, cell and an array per attribute (null: its whole range); ``variables`` a value per attribute. ``on`` are
    columns that must be equal too. With ``two_plus``, the flags so named count by how many are Y, at least two, whatever the cell's sets of them say.

    A cell is posted under the values of its rarest attribute only (the one whose set is the smallest share of its range), so its
    tuples of attributes are never made; variables are first reduced to the masks that there are. Where key and value
    meet, a cell takes a mask that its own contains. Rows of a null geography or a missing value match nothing.
    """
    flags = list(two_plus or ())
    tested = [a for a in attributes if a not in flags]
    masks = Masks({a: full[a] for a in tested})
    few = F.lit(0)
    for f in flags:
        few = few + F.when(F.col(f) == "Y", 1).otherwise(0)
    known = reduce(lambda x, y: x & y, [F.col(a).isNotNull() for a in tested], F.lit(True))
    v = variables.where(known & (few >= 2) if flags else known).select(*on, *tested, *masks.of_values(tested), "variable")
    words = [f"_v{w}" for w in range(masks.words)]
    # the masks that occur, each posted under its value of every attribute
    posts = F.explode(F.array(*[F.struct(F.lit(i).alias("_a"), masks.place(a, F.col(a)).alias("_p")) for i, a in enumerate(tested)])).alias("_post")
    shapes = v.select(*on, *tested, *words).distinct().select(*on, *words, posts).select(*on, *words, "_post.*")
    share = {a: F.size(masks.set_of(a)) / float(len(full[a])) for a in tested}
    least = F.least(*share.values()) if len(tested) > 1 else share[tested[0]]
    rarest = reduce(lambda rest, a: F.when(share[a] == least, F.lit(tested.index(a))).otherwise(rest), reversed(tested), F.lit(0))
    c = cells.select("geo", F.col("cell").alias("constraint"), *[x for x in on if x != "geo"], *tested, *masks.of_sets(tested), rarest.alias("_a"))
    at = F.lit(None).cast("array<bigint>")
    for i, a in enumerate(tested):
        at = F.when(F.col("_a") == i, masks.places(a)).otherwise(at)
    c = c.select("geo", "constraint", *[x for x in on if x != "geo"], "_a", *[f"_m{w}" for w in range(masks.words)], F.explode(at).alias("_p"))
    inside = reduce(lambda x, y: x & y, [F.col(f"_v{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_v{w}") for w in range(masks.words)])
    both = c.join(shapes, [*on, "_a", "_p"]).where(inside).select("geo", "constraint", *[x for x in on if x != "geo"], *words)
    return both.join(v.select(*on, *words, "variable"), [*on, *words]).select("geo", "constraint", "variable")


# constraint text in parts


def _chunks(batches, terms: int) -> Iterator[pa.RecordBatch]:
    """Runs of up to ``terms`` names of one constraint, from rows sorted by (geo, constraint, variable)."""
    names = ["geo", "constraint", "first", "last", "sum"]
    key, held, rows = None, [], []
    kinds = [pa.string()] * 5

    def close():
        rows.append((*key, held[0], held[-1], " + ".join(held)))

    for b in batches:
        for geo, constraint, variable in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and ((geo, constraint) != key or len(held) == terms):
                close()
                held = []
            key = (geo, constraint)
            held.append(variable)
            if len(rows) >= 200:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
    if held:
        close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def constraint_lines(cells: DataFrame, found: DataFrame, terms: int = 500) -> DataFrame:
    """(geo, place, first, line): constraints as lines of up to ``terms`` names, the later ones continuing the sum.

    Terms are dealt by ranges of (geo, constraint, variable) and streamed in order, so a constraint of any
    length is spread over tasks and none holds it. Its first line has its name and number, its last the value; lines
    order by geo, place and first. Repeated terms count once; cells without terms are left out.
    """
    key = ["geo", "constraint"]
    dealt = found.select(*key, "variable").where("geo IS NOT NULL AND constraint IS NOT NULL AND variable IS NOT NULL").distinct()
    dealt = dealt.repartitionByRange(*key, "variable").sortWithinPartitions(*key, "variable")
    chunks = dealt.mapInArrow(partial(_chunks, terms=terms), "geo string, constraint string, first string, last string, sum string")
    # which lines are first and last of their constraint: two names a constraint, not the text
    ends = found.where("variable IS NOT NULL").groupBy(*key).agg(F.min("variable").alias("_low"), F.max("variable").alias("_high"))
    numbered = ends.withColumn("place", F.row_number().over(Window.partitionBy("geo").orderBy("constraint")))
    of_cell = cells.select("geo", F.col("cell").alias("constraint"), "value")
    x = chunks.join(numbered, key).join(of_cell, key)
    head = F.when(F.col("first") == F.col("_low"), F.concat(F.lit("_C_"), "constraint", F.lit("_"), "geo", F.lit("_"), F.col("place").cast("string"), F.lit(": "))).otherwise(F.lit("  + "))
    tail = F.when(F.col("last") == F.col("_high"), F.concat(F.lit(" = "), F.col("value").cast("string"))).otherwise(F.lit(""))
    return x.select("geo", "place", "first", F.concat(head, "sum", tail).alias("line"))


def lp_lines(lines: DataFrame, variables: DataFrame) -> DataFrame:
    """(geo, section, place, first, line) of a whole file a geography: objective, constraints, bounds, binaries, end."""
    one = lines.select("geo").distinct()
    texts = [(0, "\\* model *\\"), (1, "Minimize"), (2, "  objective: __dummy"), (3, "Subject To"), (5, "Bounds"), (6, "  __dummy = 0"), (7, "Binaries"), (9, "End")]
    fixed = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(x).alias("line")) for s, x in texts])).alias("_x")
    frame = one.select("geo", fixed).select("geo", "_x.section", F.lit(0).alias("place"), F.lit("").alias("first"), "_x.line")
    sums = lines.select("geo", F.lit(4).alias("section"), "place", "first", "line")
    names = variables.select("geo", F.lit(8).alias("section"), F.lit(0).alias("place"), F.col("variable").alias("first"), F.col("variable").alias("line")).distinct()
    return frame.unionByName(sums).unionByName(names)


def write_lp(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``lp_lines`` as text, a folder a geography whose part files, in the order of their names, make up its file.

    Lines are dealt by ranges of their order, so a large file is written by many tasks.
    """
    order = ["geo", "section", "place", "first"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("geo", "line").write.mode(mode).option("maxRecordsPerFile", 0).partitionBy("geo").text(path)


# reading the text format

#: Headers of sections in the text format, by section, in lower case.
HEADERS = {
    "objective": ("minimize", "minimise", "minimum", "min", "maximize", "maximise", "maximum", "max"),
    "constraints": ("subject to", "such that", "st", "s.t.", "st."),
    "bounds": ("bounds", "bound"),
    "generals": ("generals", "general", "gen", "integers", "integer", "int"),
    "binaries": ("binaries", "binary", "bin"),
    "end": ("end",),
}

NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
NAME = r"[A-Za-z_!#$%&(),;?@{}~][A-Za-z0-9_!#$%&(),.;?@{}~]*"
SENSE = r"<=|>=|=<|=>|<|>|="
VALUE = rf"[-+]?\s*(?:{NUMBER}|inf(?:inity)?)"


def ordered_text(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """(file, block, at, line) of text files: lines order by block and at. A block is what a task reads, a split of a file at most.

    ``by_folder`` takes a folder for one file whose parts, in the order of their names, follow one another.
    """
    at, path_of = F.monotonically_increasing_id(), F.col("_metadata.file_path")
    block = F.struct(path_of.alias("part"), F.col("_metadata.file_block_start").alias("start"))
    file = F.regexp_replace(path_of, r"/[^/]*$", "") if by_folder else path_of
    return spark.read.text(path).select(file.alias("file"), block.alias("block"), at.alias("at"), F.col("value").alias("line"))


def _carried(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each of ``columns`` becomes its last value that isn't null, in the line or before it in its file.

    In two levels: inside a block, and over the last values of the blocks of a file, which are one row a block.
    """
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = x.groupBy("file", "block").agg(*[F.max_by(c, "at").alias(c) for c in columns])
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("file", "block", *[F.last(c, ignorenulls=True).over(before).alias(f"_start_{c}") for c in columns])
    both = x.join(starts, ["file", "block"])
    return both.withColumns({c: F.coalesce(c, f"_start_{c}") for c in columns}).drop(*[f"_start_{c}" for c in columns])


def sections(lines: DataFrame) -> DataFrame:
    """(file, block, at, section, goal, statement, name, text) of the lines of LP text, whose ``lines`` are (file, block, at, line).

    Comments (from a backslash on, or between \\* and *\\ in one line), headers and names of statements are cut off ``text``. ``statement`` is
    where the constraint or objective that the line belongs to begins, ``name`` what it is called. Both go on over lines, blocks and
    splits of a file. What is before the first header or after the end is dropped. Names of statements begin their lines.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace("line", r"\\\*.*?\*\\", " "), r"\\.*$", ""))
    x = lines.select("file", "block", "at", bare.alias("text")).where("text <> ''")
    low = F.regexp_replace(F.lower("text"), r"\s+", " ")
    section, text = F.lit(None).cast("string"), F.col("text")
    for name, words in HEADERS.items():
        pattern = "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in sorted(words, key=len, reverse=True))
        here = low.isin(*words)
        if name in ("objective", "constraints"):  # its first statement may follow on the same line
            here = here | low.rlike(rf"^(?:{pattern}) +[^:=<>]*:")
        section = F.when(here, F.lit(name)).otherwise(section)
        text = F.when(here, F.trim(F.regexp_replace("text", rf"(?i)^\s*(?:{pattern})(?=\s|$)", ""))).otherwise(text)
    x = x.withColumns({"section": section, "goal": F.when(low.startswith("max"), "max").otherwise("min"), "text": text})
    label = F.regexp_extract("text", rf"^({NAME})\s*:", 1)
    # a header ends the statement before it; an objective needs no name
    x = x.withColumns({
        "goal": F.when(F.col("section") == "objective", F.col("goal")),
        "name": F.when(label != "", label).when(F.col("section").isNotNull(), F.lit("")),
        "statement": F.when((label != "") | F.col("section").isNotNull(), F.struct("block", "at")),
        "text": F.when(label != "", F.trim(F.regexp_replace("text", rf"^{NAME}\s*:", ""))).otherwise(F.col("text")),
    })
    x = _carried(x, ["section", "goal", "name", "statement"])
    return x.where("section IS NOT NULL AND section <> 'end' AND text <> ''").withColumn("goal", F.when(F.col("section") == "objective", F.col("goal")))


def _token_list(statement: Column, text: Column) -> Column:
    """The tokens of a line, each with its statement and kind."""

    def token(value: Column) -> Column:
        kind = F.when(value.rlike(f"^(?:{SENSE})$"), "sense").when(value.isin("-", "+"), "sign").when(value.rlike(f"^{NUMBER}$"), "number").otherwise("name")
        return F.struct(statement.alias("statement"), kind.alias("kind"), value.alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"({SENSE}|[-+]|{NUMBER}|{NAME})")), token)


def _tokens(found: DataFrame) -> DataFrame:
    """Every token of the objectives and constraints with what it says: names have a coefficient, numbers after a relation are right-hand sides.

    A token looks at the two before it. At the start of a block those are the last two of the blocks before, taken from
    the last two lines of each; a line has a token at least.
    """
    lines = found.where("section IN ('objective', 'constraints')")
    here = Window.partitionBy("file", "block").orderBy("at")
    pairs = lines.withColumn("_b", F.lag(F.struct("statement", "text")).over(here)).groupBy("file", "block").agg(F.max_by(F.struct("_b", "statement", "text"), "at").alias("e"))
    two = F.concat(F.coalesce(_token_list(F.col("e._b.statement"), F.col("e._b.text")), F.array()), _token_list(F.col("e.statement"), F.col("e.text")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(-2, -1)
    seam = pairs.withColumn("_two", two).select("file", "block", F.flatten(F.collect_list("_two").over(before)).alias("_seam"))
    x = lines.select("file", "block", "at", "section", "goal", "statement", "name", F.posexplode(_token_list(F.col("statement"), F.col("text"))).alias("i", "token"))
    inside = Window.partitionBy("file", "block").orderBy("at", "i")
    x = x.withColumns({"p1": F.lag("token", 1).over(inside), "p2": F.lag("token", 2).over(inside), "_n": F.row_number().over(inside)}).join(seam, ["file", "block"])
    back = lambda k: F.get(F.reverse("_seam"), F.lit(k))
    p2 = F.when(F.col("_n") == 1, back(1)).when(F.col("_n") == 2, back(0)).otherwise(F.col("p2"))
    x = x.withColumns({"p1": F.when(F.col("_n") == 1, back(0)).otherwise(F.col("p1")), "p2": p2})
    is_ = lambda p, kind: F.coalesce((F.col(f"{p}.statement") == F.col("statement")) & (F.col(f"{p}.kind") == kind), F.lit(False))
    sign = F.when(is_("p1", "sign"), F.col("p1.value")).when(is_("p1", "number") & is_("p2", "sign"), F.col("p2.value")).otherwise("+")
    factor = F.when(is_("p1", "number"), F.col("p1.value").try_cast("double")).otherwise(F.lit(1.0))
    side = is_("p1", "sense") | (is_("p1", "sign") & is_("p2", "sense"))
    minus = F.when(sign == "-", -1.0).otherwise(1.0)
    value = F.col("token.value")
    number = F.when(F.col("token.kind") == "number", value.try_cast("double")).when(F.lower(value).isin("inf", "infinity"), F.lit(float("inf")))
    rhs = F.when(side & number.isNotNull(), minus * number)
    return x.select("file", "section", "goal", "statement", "name", F.col("token.kind").alias("kind"), value.alias("value"), rhs.alias("rhs"), (minus * factor).alias("coefficient"))


def read_lp(lines: DataFrame) -> dict[str, DataFrame]:
    """The parts of LP text, whose ``lines`` are (file, block, at, line) as of ``ordered_text``, in tables.

    ``constraints`` (file, constraint, sense, rhs), ``terms`` (file, constraint, coefficient, variable), ``objectives`` (file, goal,
    coefficient, variable), ``bounds`` (file, variable, lower, upper; null where there is none, infinite where the text says so, both for
    a free one) and ``kinds`` (file, variable, kind: binary or general). Sums may be broken between any two tokens. Constraints have
    names; a variable may occur in one more than once and keeps its terms apart. Relations are <=, >= or =; a bound's line holds one bound. Nothing
    but two tokens and the last headers of a block passes between blocks, so files of any size are read in parallel. The lines
    with their sections are materialised, as all tables come from them.
    """
    found = kept(sections(kept(lines)))
    tokens = _tokens(found)
    sense = F.when(F.col("value").isin("<", "=<", "<="), "<=").when(F.col("value").isin(">", "=>", ">="), ">=").otherwise("=")
    of = tokens.where("section = 'constraints' AND name <> ''")
    sides = of.where("kind = 'sense' OR rhs IS NOT NULL").groupBy("file", "statement").agg(
        F.max("name").alias("constraint"), F.max(F.when(F.col("kind") == "sense", sense)).alias("sense"), F.max("rhs").alias("rhs")
    )
    names = tokens.where("kind = 'name' AND rhs IS NULL")
    plain = lambda name: F.regexp_extract("text", name, 1)
    line = found.where("section = 'bounds' AND text <> ''").select("file", "text")
    number = lambda x: F.when(F.lower(x).rlike("inf"), F.when(x.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(F.regexp_replace(x, r"[\s+]", "").try_cast("double"))
    one, turned, two = rf"(?i)^({NAME})\s*({SENSE})\s*({VALUE})$", rf"(?i)^({VALUE})\s*({SENSE})\s*({NAME})$", rf"(?i)^({VALUE})\s*(?:<=|=<|<)\s*({NAME})\s*(?:<=|=<|<)\s*({VALUE})$"
    free = rf"(?i)^({NAME})\s+free$"
    part = lambda p, k: F.regexp_extract("text", p, k)
    is_one, is_turned, is_two, is_free = (F.col("text").rlike(p) for p in (one, turned, two, free))
    relation = F.when(is_one, part(one, 2)).when(is_turned, F.translate(part(turned, 2), "<>", "><"))
    value = F.when(is_one, number(part(one, 3))).when(is_turned, number(part(turned, 1)))
    lower = F.when(is_two, number(part(two, 1))).when(is_free, float("-inf")).when(relation.contains(">") | (relation == "="), value)
    upper = F.when(is_two, number(part(two, 3))).when(is_free, float("inf")).when(relation.contains("<") | (relation == "="), value)
    variable = F.when(is_two, part(two, 2)).when(is_free, plain(free)).when(is_one, part(one, 1)).when(is_turned, part(turned, 3))
    bounds = line.select("file", variable.alias("variable"), lower.alias("lower"), upper.alias("upper")).where("variable IS NOT NULL")
    listed = found.where("section IN ('binaries', 'generals') AND text <> ''")
    kinds = listed.select("file", F.explode(F.split("text", r"\s+")).alias("variable"), F.when(F.col("section") == "binaries", "binary").otherwise("general").alias("kind"))
    return {
        "constraints": sides.select("file", "constraint", "sense", "rhs"),
        "terms": names.where("section = 'constraints' AND name <> ''").select("file", F.col("name").alias("constraint"), "coefficient", F.col("value").alias("variable")),
        "objectives": names.where("section = 'objective'").select("file", "goal", "coefficient", F.col("value").alias("variable")),
        "bounds": bounds,
        "kinds": kinds,
    }
