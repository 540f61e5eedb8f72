"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A document of a source has target / size of that source as its expected number of copies. The whole part it gets; what is
left over is a mass in words, from 0 to the document's size. Masses are rounded in pairs: mass goes from one partner
to the other, in a direction drawn so that expectations stay, until one of the two is empty or full. So the mass of a source
is kept but for the one document that is left at the end, which is rounded alone. Documents of a source are dealt into
buckets of about FAN; a bucket is folded from its largest document down, each paired with the pool of those after it,
so that what is left is one of the smallest; what FAN buckets leave makes a bucket of the next level, until each source has one.

Draws come from digests of the row and sums have an order, so that reruns agree. Rows of equal source, doc_id and size are one
document that may be taken more often: they can be a third of all rows and still meet as a count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import ship, spare_names, written

#: What sources weigh in turn, the share of all sizes that is taken, and the most copies of a document.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2

FAN = 64
SEED = "mix"
#: Rows of one document that one task writes out.
RUN = 1 << 16
BLANK = r"\x20\x09-\x0D"


def text_size(text: Column) -> Column:
    """Number of words; no array of them is made. Null has none."""
    marks = F.regexp_replace(text, f"[{BLANK}]*+[^{BLANK}]++[{BLANK}]*+", "x")
    return F.coalesce(F.when(text.rlike(f"[^{BLANK}]"), F.length(marks)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) with the weight and target of each: weights in proportion, none above ``most`` times its size.

    What a source cannot take goes to the others by weight. Sources from the least size per weight on are full while their
    share of what is left exceeds them; the rest have one ratio of target to weight. There is a row per source, so that one
    task ranks them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    full = F.col("source_size") * most
    by_ratio = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = sizes.withColumn("weight", turn.cast("long")).withColumn("full", full)
    left = F.sum("source_size").over(everything) * F.lit(percent / 100) - F.coalesce(F.sum("full").over(before), F.lit(0))
    ratio = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("ratio", ratio).withColumn("is_full", F.col("ratio") * F.col("weight") > F.col("full"))
    level = F.max(F.when(~F.col("is_full"), F.col("ratio"))).over(everything)
    target = F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(level * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _draw(*parts: Column | str) -> Column:
    """A number from 0 to below 1 by the digest of what is given; null is a value of its own."""
    key = F.concat_ws("|", F.lit(SEED), *(F.coalesce(F.col(p).cast("string"), F.lit("-")) if isinstance(p, str) else p for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


_UNIT = "struct<doc_id: {id}, size: bigint, n_rows: bigint, base: bigint, mass: double, draw: double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, kind: str) -> Column:
    """Round the masses of a bucket in pairs, first to last: ``done`` (units with their copies) and ``left``, the one unit whose mass is broken, or null.

    The partner of a unit is the pool of all units after it. Mass goes from one of the two to the other until the unit is empty
    or full, or the pool is. The pool gives in proportion to masses and takes in proportion to room, so that what its units hold
    is ``a`` times their mass and ``b`` times their size, whatever has happened before.
    """

    def settled(unit: Column, up: Column) -> Column:
        return F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["n_rows"].alias("n_rows"), (unit["base"] + up.cast("long")).alias("copies"))

    def step(state: Column, e: Column) -> Column:
        size = e["size"].cast("double")

        def with_mass(mass: Column) -> Column:
            pool = F.greatest(state["pool"] - mass, F.lit(0.0))
            room = F.greatest(state["sizes"] - size - pool, F.lit(0.0))
            gains, loses = F.least(size - mass, pool), F.least(mass, room)
            return _let(F.struct(mass.alias("mass"), pool.alias("pool"), room.alias("room"), gains.alias("gains"), loses.alias("loses")), moved)

        def moved(m: Column) -> Column:
            broken = (m["mass"] > 0) & (m["mass"] < size)
            up = broken & (m["gains"] > 0) & (e["draw"] * (m["gains"] + m["loses"]) < m["loses"])
            down = broken & ~up & (m["loses"] > 0)
            after = F.when(up, m["mass"] + m["gains"]).when(down, m["mass"] - m["loses"]).otherwise(m["mass"])
            # What is moved in full is full, whatever rounding makes of the sum.
            full = (m["mass"] >= size) | (up & (m["gains"] >= size - m["mass"]))
            empty = (m["mass"] <= 0) | (down & (m["loses"] >= m["mass"]))
            whole = (full & (size > 0)) | empty | (size == 0)
            emptied, filled = up & (m["gains"] >= m["pool"]), down & (m["loses"] >= m["room"])
            keeps = F.when(up, 1 - m["gains"] / m["pool"]).when(down, 1 - m["loses"] / m["room"]).otherwise(F.lit(1.0))
            gets = F.when(down, m["loses"] / m["room"]).otherwise(F.lit(0.0))
            return F.struct(
                F.when(whole, F.concat(state["done"], F.array(settled(e, full & ~empty & (size > 0))))).otherwise(state["done"]).alias("done"),
                F.when(whole, state["left"]).otherwise(e.withField("mass", after)).alias("left"),
                F.when(emptied | filled, 0.0).otherwise(state["a"] * keeps).alias("a"),
                F.when(emptied, 0.0).when(filled, 1.0).otherwise(state["b"] * keeps + gets).alias("b"),
                F.when(emptied, 0.0).when(filled, m["pool"] + m["room"]).otherwise(F.when(up, m["pool"] - m["gains"]).when(down, m["pool"] + m["loses"]).otherwise(m["pool"])).alias("pool"),
                (state["sizes"] - size).alias("sizes"),
            )

        return _let(F.greatest(F.lit(0.0), F.least(size, state["a"] * e["mass"] + state["b"] * size)), with_mass)

    def total(field: str) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, e: s + e[field].cast("double"))

    none = F.array().cast(f"array<struct<doc_id: {kind}, size: bigint, n_rows: bigint, copies: bigint>>")
    nothing = F.lit(None).cast(_UNIT.format(id=kind))
    start = F.struct(none.alias("done"), nothing.alias("left"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), total("mass").alias("pool"), total("size").alias("sizes"))
    return F.aggregate(items, start, step)


def _bucket(units: DataFrame, kind: str, level: int) -> DataFrame:
    """Units with source and bucket, folded."""
    drawn = units.withColumn("draw", _draw(F.lit(f"pair{level}"), "source", "doc_id", "size"))
    unit = F.struct("doc_id", "size", "n_rows", "base", "mass", "draw").cast(_UNIT.format(id=kind))
    # From the largest down; the draw breaks ties.
    key = F.struct((-F.col("size")).alias("a"), F.col("draw").alias("b"), F.col("doc_id").alias("c"))
    grouped = drawn.groupBy("source", "bucket").agg(F.collect_list(F.struct(key.alias("at"), unit.alias("unit"))).alias("items"))
    items = F.transform(F.array_sort("items"), lambda x: x["unit"])
    # Written before it is read by field, so that a bucket is folded once.
    return written(grouped.select("source", "bucket", _fold(items, kind).alias("folded")).select("source", "bucket", "folded.done", "folded.left"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_COPIES, fan: int = FAN, run: int = RUN) -> DataFrame:
    """A row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies and taken = copies * size.

    A null text is empty; an empty document is taken the whole part of its ratio. A null source is a source, the last one.
    Rows that repeat source, doc_id (null or not) and size share what their group is taken, none more than once more than
    another, and which of them gets more is open, as they cannot be told apart. An empty table, or one without a word, takes nothing.
    Other columns are not read. The words taken of a source differ from its target by less than the size of one document.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = written(docs.select("doc_id", "source", text_size(F.col("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n_rows")))
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    counts = sizes.select(F.col("source").alias("its"), "n_units")
    aims = targets(sizes.select("source", "source_size"), weights, percent, most)
    # A row per source; Catalyst broadcasts it if its measured size allows.
    aims = written(aims.join(counts, F.col("source").eqNullSafe(F.col("its"))).drop("its"))
    most_units = aims.agg(F.max("n_units")).first()[0] or 0

    named = aims.withColumnRenamed("source", "its")
    units = counted.join(named, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    ratio = F.coalesce(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")), F.lit(0.0))
    units = units.withColumn("whole", F.floor(ratio)).withColumn("extra", F.col("n_rows") * (ratio - F.col("whole")))
    units = units.withColumn("base", F.col("n_rows") * F.col("whole") + F.floor("extra"))
    units = units.withColumn("mass", (F.col("extra") - F.floor("extra")) * F.col("size"))
    place = F.floor(_draw(F.lit("place"), "source", "doc_id", "size") * F.ceil(F.col("n_units") / fan)).cast("long")
    level, held = 0, []
    units = units.select("source", "doc_id", "size", "n_rows", "base", "mass", place.alias("bucket"))
    while True:
        held.append(_bucket(units, kind, level))
        if most_units <= fan:
            break
        most_units = -(-most_units // fan)
        level += 1
        units = held[-1].where("left is not null").select("source", "left.doc_id", "left.size", "left.n_rows", "left.base", "left.mass", F.floor(F.col("bucket") / fan).alias("bucket"))
    done = [h.select("source", F.explode("done").alias("u")).select("source", "u.*") for h in held]
    last = held[-1].where("left is not null").select("source", "left.*")
    up = _draw(F.lit("last"), "source", "doc_id", "size") * F.col("size") < F.col("mass")
    done.append(last.select("source", "doc_id", "size", "n_rows", (F.col("base") + up.cast("long")).alias("copies")))
    all_units = done[0]
    for d in done[1:]:
        all_units = all_units.union(d)
    return _spread(all_units, run).join(named, F.col("source").eqNullSafe(F.col("its"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _spread(units: DataFrame, run: int) -> DataFrame:
    """A row for each of the n_rows of a unit; the first ones get one copy more where ``copies`` of all of them leave a rest."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(run).cast("long"))).alias("begin")
    few, many = units.where(F.col("n_rows") <= run), units.where(F.col("n_rows") > run)
    few = few.select("*", F.lit(0).cast("long").alias("begin"))
    # Runs of a unit of very many rows are dealt out before they are written out.
    many = many.select("*", begin).repartition("source", "doc_id", "size", "begin")
    rows = few.union(many).select("*", F.explode(F.sequence("begin", F.least(F.col("n_rows"), F.col("begin") + run) - 1)).alias("row"))
    share = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("row") < F.col("copies") % F.col("n_rows")).cast("long")
    return rows.select("source", "doc_id", "size", share.alias("copies"))


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``plan`` (of :func:`mixture`) takes it; its columns pass through.

    Rows of equal source, doc_id and size cannot be told apart in the plan: each of them is taken as often as the group is on average, rounded by a draw.
    """
    copies, rows, unit, key, at, n = spare_names(docs, "__copies", "__rows", "__unit", "__key", "__at", "__n")
    per = plan.groupBy("source", "doc_id", "size").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
    per = per.select(F.struct("source", "doc_id", "size").alias(unit), copies, rows)
    sized = docs.withColumn(key, F.struct("source", "doc_id", text_size(F.col("text")).alias("size"))).withColumn(at, F.monotonically_increasing_id())
    joined = sized.join(per, F.col(key).eqNullSafe(F.col(unit)))
    mean = F.col(copies) / F.col(rows)
    rest = _draw(F.lit("row"), at) < mean - F.floor(mean)
    times = F.when(F.col(rows) == 1, F.col(copies)).otherwise(F.floor(mean) + rest.cast("long"))
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*docs.columns)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
