"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space is exactly U+0020 and U+0009 to U+000D; a word is a maximal run of anything else.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, as in tests) one made here."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            where = own.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives a lost executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """name, or the name with as many underscores as it takes to be none of columns (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key that holds more than one in HOT_SHARE of the rows of a lookup is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """rows (written tables) with the columns of table (unique in key) for their key, null where it has none: a left join that no hot key holds up.

    The rows of hot keys meet theirs in a broadcast, of HOT_SHARE rows at most; the others are dealt by key. Rows with a null key are joined with nothing and not dealt at all.
    """
    of = [c for c in table.columns if c != key]
    total = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__t_n")).where(F.col("__t_n") * HOT_SHARE > total)
    hot = materialize(hot.select(key).join(table, key, "left"), f"{name}-hot")
    first = rows.join(F.broadcast(hot), key)
    rest = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key, "left")
    none = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in of])
    return first.unionByName(rest).unionByName(none)


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows joined with table, which is unique in on and knows in count how many of the total rows each of its rows will meet: those of the hot keys, HOT_SHARE at most, come by
    broadcast, the others by a shuffle. rows is read twice. Rows without a partner are left out; count is dropped."""
    hot = table.where(F.col(count) * HOT_SHARE > total)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.where(F.col(count) * HOT_SHARE <= total), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold).drop(count)


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null, without building the words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WS + "+", "w")
    return F.length(F.regexp_replace(squeezed, WS + "+", "")).cast("long")
