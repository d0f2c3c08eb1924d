"""Benchmark decontamination by spaced-seed hashing, in DataFrame and SQL functions only.

A seed is the hash of the words at the places that a fixed mask keeps; words under its
gaps may differ. Seeds of benchmark items and of documents are joined on all masks.
Each hit puts an item and a document on one alignment; around it their words are
compared, and the document is contaminated where some window of ``window`` aligned words
has ``least`` equal ones. So any word of a passage may have been replaced as long as
enough of a window is left: no choice of replaced words that the rule allows escapes all
masks, at any length of item from ``SPAN`` words on (``escapes`` counts what would). Shorter
items bear no replaced word and have one seed, of all their words.

Words are runs of letters and digits in lower case. Hits refer to texts by two hashes,
not to ids, so copies share their hits and no array of words is copied per position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microveil.llm.shared import cut, numbered

#: Starts of the word pairs that a mask keeps; the gaps between them are ignored. Three replaced
#: words leave four in a row of 16; items of 6, 7 and 11 words need the gap as well.
MASKS = ((0, 2), (0, 3))
#: Words of the shortest mask; shorter items are looked up whole.
SPAN = 4
#: Seeds of a benchmark that are broadcast at most; beyond it the join is shuffled.
SMALL = 200_000
SLOTS = 1 << 19
#: Bits (as a power of two) that say which word pairs occur in the benchmark; only places with one of them make seeds.
PAIR_BITS = 19
#: Places of one text that are compared in one row.
PLACES = 2048
#: Parts in which the copies of a text meet its finding.
SALTS = 16


def word_hashes(text: str) -> str:
    return f"transform(array_remove(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), ''), w -> xxhash64(w))"


def escapes(n: int) -> int:
    """The least number of replaced words among n that leaves no mask a place; a mask at the last words is tried as each word is added."""
    kept = [{x + d for x in m for d in (0, 1)} for m in MASKS]
    back = max(map(max, kept)) + 1
    # fewest replaced words by the last words, 1 for an equal one
    best = {(0,) * back: 0}
    for _ in range(n):
        new: dict[tuple[int, ...], int] = {}
        for last, cost in best.items():
            for x in (0, 1):
                now = (*last[1:], x)
                if not any(all(now[back - 1 - max(k) + y] for y in k) for k in kept):
                    new[now] = min(new.get(now, n), cost + 1 - x)
        best = new
    return min(best.values())


def pairs(w: str) -> str:
    return f"zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> xxhash64(a, b))"


def pair_bits(items: DataFrame, w: str = "w") -> str:
    """An SQL array of longs: the bits of all word pairs of the items. Its size is fixed, whatever the benchmark."""
    h = items.select(F.explode(F.expr(pairs(w))).alias("h")).select(F.shiftrightunsigned("h", 64 - PAIR_BITS + 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    bits = [0] * (1 << PAIR_BITS - 6)
    for r in h.groupBy("i").agg(F.bit_or("bit").alias("bits")).collect():  # at most one row a long
        bits[r["i"]] = r["bits"]
    # the smallest long has no literal of its own
    return f"array({', '.join(f'{b}L' if b > -(1 << 63) else 'shiftleft(1L, 63)' for b in bits)})"


def seeds(words: str, short: Sequence[int], whole: bool, known: str | None = None) -> str:
    """All seeds with their places, mask by mask; a mask has a place wherever its own words fit.

    Words in a row count as a seed too for each number in ``short``, with ``whole`` only if they are all there are.
    ``known`` is an expression for the bits of ``pair_bits``; then a mask is laid only where its first pair is among them.

    Inner functions of one-element arrays bind a value once; the optimizer would copy a
    projected expression into every use.
    """
    parts = []
    for m, mask in enumerate(MASKS):
        kept = ", ".join(f"p[i + {x}]" if x else "p[i]" for x in mask)
        parts.append(f"transform(filter(g, i -> i < size(p) - {mask[-1]}), i -> struct(i as at, xxhash64({kept}, {m}) as seed))")
    for n in short:
        row = ", ".join(f"w[i + {x}]" for x in range(n))
        parts.append(f"transform(if(size(w) {'=' if whole else '>='} {n}, sequence(0, size(w) - {n}), array()), i -> struct(i as at, xxhash64({row}, -{n}) as seed))")
    places = "if(size(p) > 0, sequence(0, size(p) - 1), array())"
    if known:
        places = f"filter({places}, i -> bit_get(known[cast(shiftrightunsigned(p[i], {64 - PAIR_BITS + 6}) as int)], cast(p[i] & 63 as int)) = 1)"
    every = f"flatten(transform(filter(array({words}), w -> size(w) >= {min([SPAN, *short])}), w -> flatten(transform(array({pairs('w')}), p -> flatten(transform(array({places}), g -> concat({', '.join(parts)})))))))"
    return f"flatten(transform(array({known}), known -> {every}))" if known else every


def _seeded(df: DataFrame, keys: list[Column | str], words: str, short: Sequence[int], whole: bool = False, known: str | None = None) -> DataFrame:
    """Rows of (keys..., at, seed)."""
    return df.select(*keys, F.expr(f"inline({seeds(words, short, whole, known)})"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 16, least: int = 13) -> DataFrame:
    """``docs`` with ``contaminated`` and ``items`` (sorted ids of the benchmark items found; empty if none).

    An item of fewer words than ``window`` needs ``least / window`` of all its words, rounded
    up, to be aligned and equal; items of up to 3 words need all. Items without words take no
    part, as do null texts. Settings of ``window`` and ``least`` that allow
    more replaced words than the masks bear are refused. Null or empty documents are clean. Repeated
    rows get equal results. Columns named contaminated or items are replaced; an empty
    benchmark finds nothing.
    """
    lost = [n for n in range(SPAN, window + 1) if escapes(n) <= n - -(-n * least // window)]
    if lost:
        raise ValueError(f"{least} equal words of {window} are too few for the masks, at lengths {lost}")
    kept = docs.drop("contaminated", "items")
    # columns go by number inside, so that none of the caller's can clash
    base, id_col, text_col = numbered(kept, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = base.withColumns({"_k1": F.xxhash64(text), "_k2": F.hash(text, F.lit(7))})
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).distinct()
    items = cut(items.select(F.xxhash64("item", "t").alias("ik"), "item", F.expr(word_hashes("t")).alias("w"))).where("size(w) > 0")
    short = sorted(r["n"] for r in items.where(f"size(w) < {SPAN}").select(F.size("w").alias("n")).distinct().collect())
    targets = cut(_seeded(items, ["ik", (F.size("w") < SPAN).alias("whole")], "w", short, whole=True).withColumnRenamed("at", "item_at"))
    small = targets.count() <= SMALL
    probe = _seeded(keyed, ["_k1", "_k2"], word_hashes(f"coalesce(cast(`{text_col}` as string), '')"), short, known=pair_bits(items))
    hits = probe.join(F.broadcast(targets) if small else targets, "seed")
    # one place of a whole item is enough, and a short one may have as many as a text has words
    shift = F.col("at") - F.col("item_at")
    lines = hits.groupBy("_k1", "_k2", "ik", F.when(~F.col("whole"), shift).alias("line")).agg(F.min(shift).alias("shift"))
    found = cut(lines.drop("line"))

    # aligned stretches are cut out of the texts that have hits; SLOTS rows at most are broadcast to find those
    slot = F.pmod(F.col("_k1"), F.lit(SLOTS))
    wanted = keyed.select("_k1", "_k2", text.alias("t")).join(F.broadcast(found.select(slot.alias("slot")).distinct()), slot == F.col("slot"), "left_semi")
    texts = wanted.groupBy("_k1", "_k2").agg(F.min("t").alias("t")).select("_k1", "_k2", F.expr(word_hashes("t")).alias("dw"))
    sizes = items.select("ik", F.size("w").alias("n"))
    # what is compared for a text comes in rows of a bounded number of places
    many = found.groupBy("_k1", "_k2").agg(F.ceil(F.count("*") / PLACES).cast("int").alias("g")).where("g > 1")
    part = F.pmod(F.xxhash64("ik", "shift"), F.coalesce("g", F.lit(1)))
    aligned = found.join(F.broadcast(sizes) if small else sizes, "ik").join(many, ["_k1", "_k2"], "left").groupBy("_k1", "_k2", part.alias("part")).agg(F.collect_list(F.struct("ik", "shift", "n")).alias("c"))
    cuts = aligned.join(texts, ["_k1", "_k2"]).select("_k1", "_k2", F.expr("transform(c, x -> struct(x.ik as ik, greatest(0, -x.shift) as skip, slice(dw, greatest(x.shift, 0) + 1, x.n) as dw))").alias("c"))
    cuts = cuts.select("_k1", "_k2", F.explode("c").alias("c")).select("_k1", "_k2", "c.*")
    known = items.select("ik", "item", "w")
    both = cuts.join(F.broadcast(known) if small else known, "ik")
    same = "zip_with(slice(w, skip + 1, size(w)), dw, (a, b) -> if(a = b, 1, 0))"
    full = f"exists(transform(array({same}), same -> exists(sequence(0, greatest(0, size(same) - {window})), s -> aggregate(slice(same, s + 1, {window}), 0, (a, b) -> a + coalesce(b, 0)) >= if(size(w) < {SPAN}, size(w), ceil(least(size(w), {window}) * {least} / {window})))), x -> x)"
    bad = both.where(F.expr(full)).groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    kind = bad.schema["items"].dataType.simpleString()
    old = [F.col(c).alias(n) for c, n in zip(base.columns, kept.columns, strict=True)]
    # one text may have very many copies: they are dealt out, its finding goes to every part
    dealt = keyed.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    bad = bad.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(bad, ["_k1", "_k2", "_s"], "left").select(*old, F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.expr(f"cast(array() as {kind})")).alias("items"))
