"""What the operators share: durable tables, numbering of rows in even pieces, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from torquelog import runtime
from torquelog.runtime import small_batches as small_batches

LEAST_HOT = 1000  # rows of a key that one task may well have
HOT_SHARE = 0.001  # keys above this share of the rows are split; there are at most 1 / share of them


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage, so a lost executor costs the running stage only.
    """
    path = runtime.scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    """The column of that very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores after them as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...; not all names can go through ``mapInArrow``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def numbered(df: DataFrame, group: list[str], number: str, name: str) -> DataFrame:
    """Number the rows 0, 1, ... without gaps within each ``group``.

    The rows are stored first with the piece (input partition) and place they came from, which a
    retry reads again unchanged. No window holds more than the rows of one piece, so a group may
    hold any share of the table; of a group only one count per piece is put in order.
    """
    place = F.monotonically_increasing_id()
    base = stored(df.withColumn("_place", place), name).withColumn(
        "_piece", F.shiftright("_place", 33)
    )
    counts = base.groupBy(*group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *group, "_piece", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy(*group, "_piece").orderBy("_place")) - 1
    ranked = base.withColumn("_within", within)
    same = [ranked[c].eqNullSafe(before[c]) for c in group] + [ranked["_piece"] == before["_piece"]]
    keep = [ranked[c] for c in df.columns]
    return ranked.join(before, same).select(
        *keep, (F.col("_before") + F.col("_within")).cast("long").alias(number)
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    weight: str,
    counts: DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join many rows per ``key`` on the left to one row per key on the right; ``how`` is inner or left.

    The column ``weight`` of the stored table ``counts`` is the number of left rows of each key; by
    default it is in ``right`` itself and is dropped. Keys above ``HOT_SHARE`` of all rows (there can be no more than 1 / HOT_SHARE of them)
    get as many salts as they have shares, and their right row is repeated once per salt. The join is
    a shuffle at every size, as the right side grows with the data: a plan that turns from broadcast
    to shuffle somewhere cannot be tried out small.
    """
    if counts is None:
        counts, right = right, right.drop(weight)
    total, most = counts.agg(F.sum(weight), F.max(weight)).first()
    share = max(1.0, (total or 0) * HOT_SHARE)
    hot = counts.where(F.col(weight) > share).select(
        F.col(key).alias("_hot"), F.ceil(F.col(weight) / share).cast("int").alias("_salts")
    )
    if (most or 0) <= max(share, LEAST_HOT):
        return left.join(right.hint("merge"), key, how)
    few = F.broadcast(left.sparkSession.createDataFrame(hot.collect(), hot.schema))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int"), F.lit(0))
    salted = left.join(few, left[key] == F.col("_hot"), "left").withColumn("_salt", salt)
    salted = salted.drop("_hot", "_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    repeated = right.join(few, right[key] == F.col("_hot"), "left").withColumn("_salt", every)
    repeated = repeated.drop("_hot", "_salts").hint("merge")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def unsigned_unit(h: Column) -> Column:
    """A 64-bit hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) * F.lit(2.0**-53)


def with_fields(schema: T.StructType, drop: list[str], *fields: tuple[str, T.DataType]) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in drop]
    return T.StructType(kept + [T.StructField(n, t) for n, t in fields])
