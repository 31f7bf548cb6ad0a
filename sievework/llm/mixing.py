"""Mixing sources to target weights (operator 12): pivotal dependent rounding by a reduction tree, in DataFrame functions only.

A document of a source is wanted c times, c being the source's target over its
size. Whole copies are given at once; the fractions are rounded together:
of two fractions one hands mass, in words, to the other until one of them is
0 or 1, which of the two by chance, so that no expectation changes and nor do
the words of both. What is left of a group of fractions is one of them, which
goes to a group of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = [5, 2, 1]
MOST = 3  # times a source's size that its target is at most
FAN_IN = 128  # fractions in a group, expected; exact above the first level
WORD = "[^\\x20\\x09-\\x0D]+"
ITEM = "struct<size:long,h:long,doc_id:{0},digest:long,m:long,base:long,p:double>"


def words_of(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of all sizes by weight, each at most `most` times its source's size.

    Weights go round the sources by code point, null last. What is above a
    limit is shared again by weight: sources reach their limit in the order
    of limit over weight, and those that don't share the rest by weight. One
    row stands for a source, so these few rows may be in one order.
    """
    own = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("k", F.row_number().over(own)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights) + 1).cast("long"))
    rows = rows.withColumn("limit", most * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "k")
    before, ahead = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(every))
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("limited", F.col("limit") / F.col("weight") < left / F.sum("weight").over(ahead))
    rest = F.col("total") - F.sum(F.when(F.col("limited"), F.col("limit")).otherwise(0)).over(every)
    free = F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(F.col("weight") * rest / free)
    return rows.select("source", "source_size", target.alias("target"))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _chance(*keys) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _round(items: Column, item: str, seed: int) -> Column:
    """struct(left, done): the items' fractions rounded one against the next, large texts first, until one is left."""
    state = f"struct<left:{item},done:array<struct<item:{item},extra:int>>>"
    fields = [x.split(":")[0] for x in item[len("struct<") : -1].split(",")]

    def step(a, x):
        one = a["left"]
        words = F.struct(
            (one["size"] * one["p"]).alias("has"), (one["size"] * (1 - one["p"])).alias("room"), (x["size"] * x["p"]).alias("x_has"), (x["size"] * (1 - x["p"])).alias("x_room"), _chance(F.lit(seed), one["h"], x["h"]).alias("u")
        )

        def choose(w):
            up, down = F.least(w["room"], w["x_has"]), F.least(w["has"], w["x_room"])
            rises = w["u"] * (up + down) < down
            ends = F.when(rises, w["room"] <= w["x_has"]).otherwise(w["has"] <= w["x_room"])  # the one on the left is whole then, else x
            return F.struct(ends.alias("ends"), (rises == ends).alias("whole"), F.when(rises, up).otherwise(down).alias("moved"))

        def go_on(t):
            stays = F.when(t["ends"], x).otherwise(one)
            goes = F.when(t["ends"], one).otherwise(x)

            def moved(s):
                p = s["p"] + F.when(t["whole"], -1).otherwise(1) * t["moved"] / s["size"]
                return F.struct(*[s[f].alias(f) for f in fields if f != "p"], F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

            done = F.concat(a["done"], F.array(F.struct(goes.alias("item"), t["whole"].cast("int").alias("extra"))))
            return F.struct(_let(stays, moved).alias("left"), done.alias("done"))

        first = F.struct(x.alias("left"), a["done"].alias("done"))
        return F.when(one.isNull(), first.cast(state)).otherwise(_let(_let(words, choose), go_on).cast(state))

    return F.aggregate(F.sort_array(items, asc=False), F.struct(F.lit(None).cast(item).alias("left"), F.array().alias("done")).cast(state), step)


def copies(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 12) -> DataFrame:
    """How often the mix takes each different document: (doc_id, source, digest, size, source_size, target, m, copies).

    Rows that agree in id, source and text are one document, there m times;
    `copies` counts all that the mix takes of it. It is between m times the
    whole part of c = target / source_size and that of the next whole number.

    Level 0 groups the fractions of one source and one power of two of sizes
    by a hash, some FAN_IN in a group, so no source and no size is too large;
    each level leaves one in FAN_IN. One group of each power of two waits for
    the last step, which rounds what is left of a source from its largest
    sizes to its smallest, so that the last fraction is of a small text.
    Everything hangs on hashes of the rows, so reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("digest"), words_of(F.col(f"`{text}`")).alias("size"))
    items = written(rows.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("m")).withColumn("power", F.length(F.bin("size"))), "mix-items")
    item = ITEM.format(items.schema["doc_id"].dataType.simpleString())

    by_power = items.groupBy("source", "power").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("words"))
    targets = source_targets(by_power.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    groups = F.ceil(F.col("n") / FAN_IN).alias("groups")
    known = by_power.select(F.col("source").alias("s"), F.col("power").alias("b"), groups).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    known = written(known, "mix-sources")
    c = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    placed = items.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("power") == F.col("b"))).drop("s", "b")
    placed = placed.withColumn("base", F.floor(F.col("m") * c)).withColumn("p", F.col("m") * c - F.col("base")).withColumn("h", F.xxhash64("doc_id", "source", "digest", "size"))
    placed = placed.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "h"), F.col("groups")))
    placed = written(placed.withColumn("open", (F.col("p") > 0) & (F.col("size") > 0)), "mix-placed")

    fraction = F.struct("size", "h", "doc_id", "digest", "m", "base", "p").cast(item).alias("item")
    waiting = placed.where("open").select("source", "power", "group", fraction)
    level, n, done = waiting.where("group > 0"), known.agg(F.max("groups")).first()[0] or 1, []
    while n > 1:
        folded = level.groupBy("source", "power", "group").agg(F.collect_list("item").alias("items"))
        folded = written(folded.select("source", "power", "group", _round(F.col("items"), item, seed).alias("r")), "mix-level")
        done.append(folded.select("source", F.explode("r.done").alias("d")).select("source", "d.item", "d.extra"))
        level = folded.select("source", "power", F.floor((F.col("group") - 1) / FAN_IN + 1).alias("group"), F.col("r.left").alias("item"))
        n = -(-(n - 1) // FAN_IN)
    # Of each power of two there is one fraction left, and the group that has waited.
    last = waiting.where("group = 0").unionAll(level).select("source", "item")
    ends = last.groupBy("source").agg(F.collect_list("item").alias("items")).select("source", _round(F.col("items"), item, seed).alias("r"))
    # The last fraction has none to hand mass to: the nearest whole number is nearest to the target.
    one = F.struct(F.col("r.left").alias("item"), (F.col("r.left.p") >= 0.5).cast("int").alias("extra"))
    done.append(ends.select("source", F.explode(F.concat("r.done", F.array(one))).alias("d")).select("source", "d.item", "d.extra"))
    rest = placed.where("not open").select("source", fraction, (_chance(F.lit(seed), F.lit("empty"), F.col("h")) < F.col("p")).cast("int").alias("extra"))
    for x in done:
        rest = rest.unionAll(x)
    targets = known.select("s", "source_size", "target").distinct()
    out = rest.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return out.select("item.doc_id", "source", "item.digest", "item.size", "source_size", "target", "item.m", (F.col("item.base") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs; parameters as of copies().

    size is the number of words, 0 of a null or blank text; taken is size times
    copies. Of rows that agree in id, source and text the copies differ by one
    at most. Null ids are ids like others, a null source is a source; further
    columns, of whatever name, are not read. An empty table gives no rows, and
    where no text has words every target is 0.
    """
    found = copies(docs, **how)
    found = found.withColumn("each", F.floor(F.col("copies") / F.col("m"))).withColumn("more", F.col("copies") - F.col("m") * F.col("each"))
    # A document that is there many times has its rows made in two steps, so that no array is long.
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / 4096))))
    first = F.col("part") * 4096
    rows = parts.withColumn("i", F.explode(F.sequence(first, F.least(first + 4095, F.col("m") - 1))))
    own = F.col("each") + (F.col("i") < F.col("more")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"), (F.col("size") * own).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: docs, each row as often as it is taken.

    Of rows that agree in id, source and text one is repeated for all; further
    columns stay, whatever their names, and for such rows are those of any one.
    """
    p = "_mix"
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    own, i = f"{p}_own", f"{p}_i"
    found = copies(docs, doc_id=doc_id, text=text, source=source, **how).where("copies > 0")
    found = found.select(*[F.col(c).alias(f"{p}_{c}") for c in ("doc_id", "source", "digest", "m", "copies")])
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{p}_doc_id")) & F.col(f"`{source}`").eqNullSafe(F.col(f"{p}_source")) & (F.col(own) == F.col(f"{p}_digest"))
    rows = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`").cast("string"))).join(found, same)
    rows = rows.where(F.col(f"{p}_m") == 1).unionByName(rows.where(F.col(f"{p}_m") > 1).dropDuplicates([doc_id, source, own]))
    return rows.withColumn(i, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
