"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a share of the words wanted in all, by its weight; none takes more than ``most`` times its size, and
what that leaves over goes to the others by weight (:func:`targets`). A document of a source then has the fractional
number of copies target / size of the source. Its whole part is certain; the fraction is a probability that
pivotal rounding makes whole: two documents meet, and one random transfer of mass, which keeps both expectations and
the sum of *words* (probability times size), leaves at least one of them at 0 or 1. The other goes on. So the words
that a source takes differ from its target by less than one document.

**At scale.** Documents meet in small groups by the bits of a hash; each group leaves at most one fraction, and these
residuals meet in groups again, up a reduction tree with log32(documents) levels. A source with a third of all rows
is so dealt to many groups from the start. Only ids and sizes are rounded, never texts. Rows equal in source, id and
size are rounded as one class first: whole copies are dealt at once, and one fraction of the class goes on, which
is the same rounding with equal partners met first; so a repeated row is no hot key either. Sources are few against documents
and are ranked in one task, 24 bytes each.

Sources sort by code point with null last. Null ids are ids. Documents of one size meet in the order of their hashes. Very long texts
count whole; a document larger than its source's target is taken or left by chance, as any other. Size 0: the number of copies is the whole part, no words.
Empty table: no rows. Extra columns of any name stay as they are, and tell rows apart. Same rows, same seed: same result, in whatever order and partitions they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN = 32
BITS = 5
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources are few against documents; beyond this many they are joined by shuffle and not sent to all.
SMALL = 50_000

CLASS = ("source", "doc_id", "size")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from one row per source with its ``source_size``.

    Where all caps are met, target = min(cap, rate * weight) with one rate for all sources: those with the least cap
    per weight are capped first, so sorted running sums find the rate that no round of resharing would change.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select("source", "source_size", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rows = rows.select(
        "source", "source_size", "w", "cap", F.row_number().over(by_cap).alias("k"),
        ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))).alias("rate"),
    )
    # The first source in this order that stays under its cap fixes the rate for all that follow.
    rows = rows.withColumn("rate", F.min_by("rate", F.when(F.col("rate") * F.col("w") < F.col("cap"), F.col("k"))).over(whole))
    return rows.select("source", "source_size", F.when(F.col("rate").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("rate") * F.col("w"))).alias("target"))


def _uniform(*parts: str) -> str:
    return f"(xxhash64({', '.join(parts)}) & 9007199254740991) / 9007199254740992D"


def _meet(seed: int, level: int) -> str:
    """SQL for one group: fold its units; a unit is (o, h, u, w, p), u what the caller carries.

    They meet by falling size, then hash: a long document takes up the mass of shorter ones until it is whole, and what
    is left over at the end of a group is rarely a long one.
    """
    met = f"""
      transform(array(named_struct('a', acc.cur, 'b', x, 'r', x.w / acc.cur.w,
                                   'u', {_uniform("acc.cur.h", "x.h", str(seed), str(level))})), v ->
      transform(array(named_struct('v', v,
          'up', least(1D - v.a.p, v.b.p * v.r), 'down', least(v.a.p, (1D - v.b.p) * v.r))), m ->
      transform(array(named_struct('a', m.v.a, 'b', m.v.b,
          'pa', CASE WHEN m.v.u * (m.up + m.down) < m.down
                     THEN IF(1D - m.v.a.p <= m.v.b.p * m.v.r, 1D, m.v.a.p + m.v.b.p * m.v.r)
                     ELSE IF(m.v.a.p <= (1D - m.v.b.p) * m.v.r, 0D, m.v.a.p - (1D - m.v.b.p) * m.v.r) END,
          'pb', CASE WHEN m.v.u * (m.up + m.down) < m.down
                     THEN IF(1D - m.v.a.p <= m.v.b.p * m.v.r, greatest(0D, m.v.b.p - (1D - m.v.a.p) / m.v.r), 0D)
                     ELSE IF(m.v.a.p <= (1D - m.v.b.p) * m.v.r, least(1D, m.v.b.p + m.v.a.p / m.v.r), 1D) END)), z ->
      IF(z.pa IN (0D, 1D),
         named_struct('cur', named_struct('o', z.b.o, 'h', z.b.h, 'u', z.b.u, 'w', z.b.w, 'p', z.pb),
                      'done', concat(acc.done, array(named_struct('u', z.a.u, 'bit', CAST(z.pa AS INT))))),
         named_struct('cur', named_struct('o', z.a.o, 'h', z.a.h, 'u', z.a.u, 'w', z.a.w, 'p', z.pa),
                      'done', concat(acc.done, array(named_struct('u', z.b.u, 'bit', CAST(z.pb AS INT))))))
      )[0])[0])[0]"""
    whole = """named_struct('cur', x, 'done', concat(acc.done, array(named_struct('u', acc.cur.u, 'bit', CAST(acc.cur.p AS INT)))))"""
    return f"""aggregate(slice(units, 2, size(units)),
        named_struct('cur', units[0], 'done', slice(array(named_struct('u', units[0].u, 'bit', 0)), 1, 0)),
        (acc, x) -> IF(acc.cur.p IN (0D, 1D), {whole}, {met}))"""


def round_classes(classes: DataFrame, seed: int = 17, key: tuple = CLASS) -> DataFrame:
    """Adds ``low`` (copies of every row of the class) and ``more`` (rows of the class with one copy more).

    ``classes``: distinct ``key`` columns with the number of rows ``n`` and ``copies``, the fractional number
    of copies of each.
    """
    low = F.floor("copies")
    fraction = F.col("copies") - low
    sure = F.floor(F.col("n") * fraction + F.lit(1e-9))
    left = F.greatest(F.lit(0.0), F.col("n") * fraction - sure)
    left = F.when((left < 1e-9) | (F.col("size") <= 0), F.lit(0.0)).otherwise(left)
    units = classes.withColumns({"low": low.cast("long"), "more": F.when(F.col("size") <= 0, F.lit(0)).otherwise(sure).cast("long"), "p": left, "h": F.xxhash64(*key, F.lit(seed))})
    units = materialize(units, "mix-classes")
    carried = [c for c in units.columns if c not in ("p", "h")]
    settled = units.where("p = 0").select(*carried)
    level = units.where("p > 0").select(F.col("source").alias("s"), (F.col("h").bitwiseAND((1 << 62) - 1)).alias("b"), F.struct((-F.col("size")).alias("o"), "h", F.struct(*carried).alias("u"), F.col("size").cast("double").alias("w"), "p").alias("unit"))
    count = level.count()
    bits = 0
    while (1 << bits) * FAN < count:
        bits += BITS
    level = level.withColumn("b", F.col("b").bitwiseAND((1 << bits) - 1))
    step = 0
    while True:
        groups = level.groupBy("s", "b").agg(F.sort_array(F.collect_list("unit")).alias("units"))
        # A round trip through the shared folder: residuals and decisions are both read from it.
        folded = materialize(groups.select("s", "b", F.expr(_meet(seed, step)).alias("f")), "mix-level")
        settled = settled.unionByName(
            folded.select(F.explode("f.done").alias("d")).select("d.u.*", "d.bit").select(*[F.col(c) if c != "more" else (F.col("more") + F.col("bit")).alias("more") for c in carried])
        )
        if bits <= 0:
            break
        bits -= BITS
        step += 1
        level = folded.select("s", F.col("b").bitwiseAND((1 << bits) - 1).alias("b"), F.col("f.cur").alias("unit"))
    last = folded.select(F.col("f.cur").alias("c")).select("c.u.*", F.expr(f"IF({_uniform('c.h', str(seed), '99')} < c.p, 1, 0)").alias("bit"))
    return settled.unionByName(last.select(*[F.col(c) if c != "more" else (F.col("more") + F.col("bit")).alias("more") for c in carried]))


def mix_classes(rows: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, key: tuple = CLASS) -> DataFrame:
    """Classes of rows equal in ``key`` (source, doc_id and size among it) with n, low, more, source_size and target."""
    classes = materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    sources = materialize(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most), "mix-targets")
    few = sources.count() <= SMALL
    side = (F.broadcast(sources) if few else sources).withColumnRenamed("source", "__s")
    joined = classes.join(side, classes["source"].eqNullSafe(F.col("__s"))).drop("__s")
    return round_classes(joined.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))), seed, key)


def expand(classes: DataFrame) -> DataFrame:
    """One row for each row of the classes, with its whole number of ``copies``."""
    chunk = 10_000
    rows = classes.withColumn("__k", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / chunk).cast("long"))))
    rows = rows.withColumn("__i", F.explode(F.sequence(F.col("__k") * chunk, F.least(F.col("n"), (F.col("__k") + 1) * chunk) - 1)))
    return rows.withColumn("copies", F.col("low") + (F.col("__i") < F.col("more")).cast("long")).drop("__k", "__i")


def mix(docs: DataFrame, size: Column, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; its columns stay.

    Rows are told apart by a hash of all their columns, so rows of one class are equal, and it does not matter which of them
    are taken once more: their copies come from one of them. Documents move once, to meet their number of copies.
    """
    names = docs.columns
    key = ("source", "doc_id", "size", "row")
    row = F.struct(*[docs[c] for c in names])
    keyed = docs.select(row.alias("__row"), docs[source_col].alias("__source"), docs[id_col].cast("long").alias("__id"), size.alias("__size"), F.xxhash64(*[docs[c] for c in names]).alias("__hash"))
    keys = keyed.select(*[F.col(f"__{c}").alias(k) for c, k in zip(("source", "id", "size", "hash"), key, strict=True)])
    classes = mix_classes(keys, weights, share, most, seed, key).select(*key, "n", "low", "more")
    same = keyed["__source"].eqNullSafe(classes["source"]) & keyed["__id"].eqNullSafe(classes["doc_id"])
    joined = keyed.join(classes, same & (keyed["__size"] == classes["size"]) & (keyed["__hash"] == classes["row"]))
    single = joined.where("n = 1").select("__row", (F.col("low") + F.col("more")).alias("copies"))
    # Equal rows become one before they move on; a row with very many copies is made by many tasks.
    equal = joined.where("n > 1").groupBy(*key).agg(F.first("__row").alias("__row"), F.first(F.col("n") * F.col("low") + F.col("more")).alias("copies")).where("copies > 0")
    chunk = 10_000
    parts = equal.select("__row", "copies", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / chunk).cast("long"))).alias("__k")).repartition("__k", F.xxhash64("__row"))
    many = parts.select("__row", F.least(F.lit(chunk), F.col("copies") - F.col("__k") * chunk).alias("copies"))
    taken = single.unionByName(many).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")
