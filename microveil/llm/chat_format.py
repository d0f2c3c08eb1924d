"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output:

    conversation = turn*
    turn         = "<|" role "|" level "|>" body "<|/|>" newline

Level 0 is plain, level 1 escaped (``\\`` as ``\\\\``, ``<`` as ``\\l``, ``|`` as
``\\p``), so an escaped role or body holds no control string. A turn is rendered plain and
parsed again; where the parser does not give back exactly the turn it is rendered
escaped. Turns delimit themselves, so conversations of such turns parse too; this is
checked on every conversation, and a mismatch raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = r"(?s)<\|([^|]*)\|([01])\|>(.*?)<\|/\|>\n"
CLOSE = "<|/|>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("|"), F.lit("\\p"))


def unescape(x: Column) -> Column:
    plain = lambda y: F.replace(F.replace(y, F.lit("\\l"), F.lit("<")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(x, r"\\\\"), plain), "\\")


def render(role: Column, text: Column, level: int) -> Column:
    if level:
        role, text = escape(role), escape(text)
    return F.concat(F.lit("<|"), role, F.lit(f"|{level}|>"), text, F.lit(CLOSE))


def parse(x: Column) -> Column:
    """Turns (role, text) of a formatted text, unescaped."""
    parts = [F.regexp_extract_all(x, F.lit(TURN), F.lit(i)) for i in (1, 2, 3)]
    read = lambda y, level: F.when(level == "1", unescape(y)).otherwise(y)
    return F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("r", "l", "b"), strict=True)]), lambda t: F.struct(read(t["r"], t["l"]).alias("role"), read(t["b"], t["l"]).alias("text")))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, turns (as parsed from formatted).

    Turns go by number (null first), then role, then text; repeated rows are repeated turns.
    Null roles and texts are empty. Rows with a null conversation form one conversation.
    ``loss_spans`` are start and length, in characters of ``formatted``, and byte and bytes, the
    same in UTF-8, of the bodies of ``learn_role``. Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    plain, safe = render(F.col("role"), F.col("text"), 0), render(F.col("role"), F.col("text"), 1)
    # the parser gives back the turn and nothing else, and what it parsed is all there is
    same = (parse(plain) == F.array(F.struct("role", "text"))) & (F.regexp_replace(plain, TURN, "") == "")
    rows = rows.withColumn("plain", same).withColumn("piece", F.when(F.col("plain"), plain).otherwise(safe))
    rows = rows.withColumn("body", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = {"at": F.row_number().over(order)}
    for name, size in (("start", F.length), ("byte", F.octet_length)):
        places[name] = F.sum(size("piece").cast("long")).over(whole) - size(F.lit(CLOSE)) - size("body")
        places[f"{name}_length"] = size("body").cast("long")
    rows = rows.withColumns(places)
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "piece", "start", "start_length", "byte", "byte_length"))).alias("t"))
    out = grouped.select("conv_id", "t", F.array_join(F.col("t.piece"), "").alias("formatted"))
    out = out.withColumn("turns", parse(F.col("formatted")))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(F.col("turns") == source, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its source")))
    mine = F.filter("t", lambda x: x["role"] == learn_role)
    span = lambda x: F.struct(x["start"].alias("start"), x["start_length"].alias("length"), x["byte"].alias("byte"), x["byte_length"].alias("bytes"))
    return out.select("conv_id", checked.alias("formatted"), F.transform(mine, span).alias("loss_spans"), "turns")


def masked(formatted: Column, spans: Column) -> Column:
    """The text of each span of ``formatted``, unescaped where the level in front of the span says so."""
    # a one-element array binds the bytes once; spans are cut out of them by byte, as finding a character takes a scan
    cut = lambda b, at, n: F.decode(F.substring(b, at, n), "UTF-8")
    read = lambda b, s: F.when(cut(b, (s["byte"] - 2).cast("int"), F.lit(1)) == "1", unescape(cut(b, (s["byte"] + 1).cast("int"), s["bytes"].cast("int")))).otherwise(cut(b, (s["byte"] + 1).cast("int"), s["bytes"].cast("int")))
    return F.flatten(F.transform(F.array(F.encode(formatted, "UTF-8")), lambda b: F.transform(spans, lambda s: read(b, s))))


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted text: of its parsed turns, and of what its loss spans cover."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
