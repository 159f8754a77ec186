"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A document of a source is to be taken target / size times. The whole part is certain; the fractions of a
source's documents are rounded dependently: two documents at a time, mass (fraction times size) moves from
one to the other, at random with the right expectations, until one fraction is 0 or 1. Groups of documents
fold in parallel and leave one open fraction each; those fold on in a tree until one is left in a source.
So a source's taken words differ from its target by less than its largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseplane.llm.common import cut, packed_rows, words_of

#: Documents, and open fractions, that fold in one group.
FAN_IN = 64
#: Up to so many sources their targets are broadcast (under 2 MB with short names); beyond, the join shuffles.
BROADCAST_SOURCES = 10_000
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source: source_size, n (classes), target.

    Sources by code point, null last, get the weights in turn. The targets share `share` of all sizes by
    weight but stop at `cap` times the source's size: target = min(cap * size, level * weight), where the
    level makes them add up. It is found exactly from the running sums of sources by cap * size / weight.
    The window over all sources sees one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap))
    line = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    by = by.withColumns({"level": (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing))})
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(everything)
    return by.withColumn("target", F.least("most", F.coalesce(level * F.col("w"), F.col("most")))).select("source", "source_size", "n", "target")


def _uniform(*of: Column, seed: int) -> Column:
    return F.xxhash64(*of, F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)


_ITEM = "struct<h:bigint,doc_id:{id},size:bigint,m:bigint,whole:bigint,p:double>"
_DONE = "struct<doc_id:{id},size:bigint,m:bigint,copies:bigint>"


def _fold(items: Column, id_type: str, seed: int) -> Column:
    """struct<open: item or null, done: array> of an array of items with 0 < p < 1."""
    item, done = _ITEM.format(id=id_type), _DONE.format(id=id_type)
    state = f"struct<open:{item},done:array<{done}>>"

    def settled(x: Column, one: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), (x["whole"] + one).alias("copies")).cast(done)

    def still(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), x["whole"].alias("whole"), p.alias("p")).cast(item)

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        # mass that can move from a to b, and from b to a
        ab = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        ba = F.least(b["p"] * b["size"], (1 - a["p"]) * a["size"])
        go = _uniform(a["h"], b["h"], seed=seed) * (ab + ba) < ba
        a_empty, b_empty = a["p"] * a["size"] <= (1 - b["p"]) * b["size"], b["p"] * b["size"] <= (1 - a["p"]) * a["size"]
        a_left, b_left = a["p"] - ab / a["size"], b["p"] - ba / b["size"]
        a_more, b_more = a["p"] + ba / a["size"], b["p"] + ab / b["size"]
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        added = lambda x: F.concat(acc["done"], F.array(x))
        as_state = lambda open_, done_: F.struct(open_.alias("open"), done_.alias("done")).cast(state)
        return (
            F.when(a.isNull(), as_state(b, acc["done"]))
            .when(go & a_empty, as_state(still(b, b_more), added(settled(a, zero))))
            .when(go, as_state(still(a, a_left), added(settled(b, one))))
            .when(b_empty, as_state(still(a, a_more), added(settled(b, zero))))
            .otherwise(as_state(still(b, b_left), added(settled(a, one))))
        )

    return F.aggregate(items, F.struct(F.lit(None).alias("open"), F.array().alias("done")).cast(state), step)


def copies_of(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, fan_in: int = FAN_IN, seed: int = 0) -> DataFrame:
    """One row for each class of rows with equal (doc_id, source, size): m rows that take `copies` in all.

    Columns doc_id, source, size, m, copies, source_size, target. size counts words, 0 for null texts; a
    null source is a source of its own; documents of size 0 take the whole part of their copies. Random
    choices are hashes of ids, sizes and seed, so reruns agree. Repeated rows are one class, so a key that
    holds a third of all rows is one item. Other columns of docs are ignored; no rows give no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"))
    classes = cut(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    targets = cut(source_targets(classes, weights, share, cap).withColumn("group_of", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))))
    known = classes.withColumn("group_of", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))).drop("source")
    n_sources, most, longest = targets.agg(F.count("*"), F.max("n"), F.max(F.length("source"))).first()
    small = n_sources <= BROADCAST_SOURCES and (longest or 0) <= 200
    known = known.join(F.broadcast(targets) if small else targets, "group_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = F.floor(rate)
    rest = F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate) - each).otherwise(rate - each) * F.col("m")
    known = known.withColumns({"whole": (each * F.col("m") + F.floor(rest)).cast("long"), "p": rest - F.floor(rest), "h": F.xxhash64("doc_id", "source", "size", F.lit(seed))})
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    carried = ["source", "source_size", "target"]
    out = known.where(~open_).select("doc_id", "size", "m", F.col("whole").alias("copies"), *carried)
    groups = F.greatest(F.ceil(F.col("n") / fan_in), F.lit(1)).cast("long")
    level = known.where(open_).select(
        *carried, groups.alias("groups"), F.pmod(F.xxhash64("h", F.lit(seed + 1)), groups).alias("g"),
        F.struct("h", "doc_id", "size", "m", "whole", "p").cast(_ITEM.format(id=id_type)).alias("item"),
    )
    left = (most or 0) / fan_in
    while True:
        items = F.sort_array(F.collect_list("item"))
        folded = cut(level.groupBy(*carried, "groups", "g").agg(_fold(items, id_type, seed + 2).alias("f")))
        out = out.unionByName(folded.select(*carried, F.explode("f.done").alias("d")).select("d.*", *carried))
        level = folded.where("f.open is not null").select(*carried, F.ceil(F.col("groups") / fan_in).cast("long").alias("groups"), F.floor(F.col("g") / fan_in).cast("long").alias("g"), F.col("f.open").alias("item"))
        if left <= 1:
            break
        left /= fan_in
    last = F.col("item")
    lucky = (_uniform(last["h"], seed=seed + 3) < last["p"]).cast("long")
    return out.unionByName(level.select(last["doc_id"].alias("doc_id"), last["size"].alias("size"), last["m"].alias("m"), (last["whole"] + lucky).alias("copies"), *carried))


def copies_by_row(classes: DataFrame) -> DataFrame:
    """One row for each row of docs: the classes of copies_of with their copies dealt to their m rows evenly."""
    part = 4096  # no array longer than this, however often a row repeats
    blocks = classes.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / part).cast("long"))))
    rows = blocks.withColumn("r", F.explode(F.sequence(F.col("b") * part, F.least((F.col("b") + 1) * part, F.col("m")) - 1)))
    return rows.withColumn("copies", (F.floor(F.col("copies") / F.col("m")) + (F.col("r") < F.pmod("copies", "m")).cast("long")).cast("long")).drop("b", "r")


#: Classes of more than one in so many rows are hot; there are fewer of them than this.
HOT = 1_000
#: Groups of the hashes of a class's rows, by which the places of rows in the class are found.
GROUPS = 4_096


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """docs, each row as often as the mix takes it, with the column `copy` (1, 2, ...); columns else as in docs.

    A column `copy` of docs is replaced. Of rows that share id, source and size those of the least hash get a copy
    more, so reruns agree; equal rows are added up where they are read, so a row that makes up a third of the table
    is one row of the shuffle. Nulls are as in copies_of. No rows give no rows.
    """
    key = [F.col(doc_id).alias("_id"), F.col(source).alias("_source"), words_of(F.col(text)).alias("_size")]
    own = packed_rows(docs, *key)
    classes = cut(copies_of(docs, doc_id, source, text, **options).select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "m", "copies"))
    total = classes.agg(F.sum("m")).first()[0] or 0
    hot = F.col("m") * HOT > F.lit(total)
    same = F.col("_id").eqNullSafe(F.col("i")) & F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z"))
    columns = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() != "copy"]
    once = own.join(classes.where((F.col("m") == 1) & (F.col("copies") > 0)), same).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    several = classes.where((F.col("m") > 1) & (F.col("copies") > 0))
    if several.isEmpty():
        return once.select(*columns, "copy")
    repeated = own.join(several.where(~hot), same).unionByName(own.join(F.broadcast(several.where(hot)), same))  # under HOT rows
    kinds = repeated.withColumn("h", F.xxhash64("_row")).groupBy("i", "s", "z", "m", "copies", "h").agg(F.count("*").alias("n"), F.first("_row").alias("_row"))
    kinds = cut(kinds.withColumns({"g": F.pmod("h", F.lit(GROUPS)), "base": F.floor(F.col("copies") / F.col("m")).cast("long"), "more": F.pmod("copies", "m")}))
    line = Window.partitionBy("i", "s", "z").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = kinds.groupBy("i", "s", "z", "g").agg(F.sum("n").alias("gn")).withColumn("gb", F.coalesce(F.sum("gn").over(line), F.lit(0)))
    groups = groups.select(F.col("i").alias("gi"), F.col("s").alias("gs"), F.col("z").alias("gz"), F.col("g").alias("gg"), "gb")
    placed = kinds.join(groups, F.col("i").eqNullSafe(F.col("gi")) & F.col("s").eqNullSafe(F.col("gs")) & (F.col("z") == F.col("gz")) & (F.col("g") == F.col("gg")))
    inside = Window.partitionBy("i", "s", "z", "g").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("gb") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = placed.withColumn("extra", F.greatest(F.least(F.col("more") - before, F.col("n")), F.lit(0)))
    # n equal rows: copies 1 to base of each, and one more of `extra` of them, in blocks so that no array is long
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("base") + 1)))
    each = each.withColumn("rows", F.when(F.col("copy") <= F.col("base"), F.col("n")).otherwise(F.col("extra"))).where("rows > 0")
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / 4096).cast("long"))))
    rows = each.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(4096).cast("long"), F.col("rows") - F.col("block") * 4096))))
    return once.select(*columns, "copy").unionByName(rows.select(*columns, "copy"))
