"""Snapshot differences, upserts, merges and other writes, as DataFrame -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.session import materialize


def _plain(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], run_id: str | None = None, detected_at: str | None = None) -> DataFrame:
    """Events (key, change_type, field_name, old_value, new_value): added, deleted, and a modified event for
    each field that differs as trimmed text; null equals ''."""
    a = old.select(F.col(key).alias("__a"), *[_plain(F.col(f)).alias(f"o_{f}") for f in fields])
    b = new.select(F.col(key).alias("__b"), *[_plain(F.col(f)).alias(f"n_{f}") for f in fields])
    event = lambda kind, f, o, n: F.struct(F.lit(kind).alias("change_type"), F.lit(f).cast("string").alias("field_name"), o.alias("old_value"), n.alias("new_value"))
    none = F.lit(None).cast("string")
    changed = F.array_compact(F.array(*[F.when(F.col(f"o_{f}") != F.col(f"n_{f}"), event("modified", f, F.col(f"o_{f}"), F.col(f"n_{f}"))) for f in fields]))
    events = F.when(F.col("__a").isNull(), F.array(event("added", None, none, none))).when(F.col("__b").isNull(), F.array(event("deleted", None, none, none))).otherwise(changed)
    out = a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), F.explode(events).alias("e")).select(key, "e.*")
    if run_id is not None:
        out = out.withColumn("sync_run_id", F.lit(run_id)).withColumn("detected_at", F.lit(detected_at))
    return out


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep_if_empty: bool = True) -> DataFrame:
    """K1/K2/K3: incoming rows replace or join current ones; with keep_if_empty a null or '' keeps what was there.
    Of several incoming rows of a key the whole table must hold one; use keep_first before."""
    columns = current.columns
    had, got = current.withColumn("__had", F.lit(True)), incoming.select(F.col(key).alias("__k"), *[F.col(c).alias(f"n_{c}") for c in columns if c != key and c in incoming.columns])

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("__k")).alias(key)
        if c not in incoming.columns:
            return F.col(c)
        new = F.col(f"n_{c}")
        use = F.col("__k").isNotNull() & ((F.coalesce(new.cast("string"), F.lit("")) != "") if keep_if_empty else F.lit(True))
        return F.when(use | F.col("__had").isNull(), new).otherwise(F.col(c)).alias(c)

    return had.join(got, F.col(key) == F.col("__k"), "full_outer").select(*[pick(c) for c in columns])


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """K4: rows whose keys are new, one per key (the first by all columns); nulls are equal."""
    test = reduce(lambda a, b: a & b, [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    fresh = incoming.alias("i").join(current.select(*keys).distinct().alias("c"), test, "left_anti")
    order = Window.partitionBy(*keys).orderBy(*incoming.columns)
    return fresh.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def diff_write(current: DataFrame, computed: DataFrame, key: str, numbers: list[str], texts: list[str] = (), tolerance: float = 1e-9) -> DataFrame:
    """K6: the computed rows that differ from what is stored."""
    stored = current.select(F.col(key).alias("__k"), *[F.col(c).alias(f"s_{c}") for c in [*numbers, *texts]])
    far = [F.coalesce(F.abs(F.col(c) - F.col(f"s_{c}")) >= tolerance, F.col(c).isNotNull() | F.col(f"s_{c}").isNotNull()) for c in numbers]
    other = [~F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in texts]
    changed = reduce(lambda a, b: a | b, far + other)
    return computed.join(stored, F.col(key) == F.col("__k"), "left").filter(F.col("__k").isNull() | changed).select(*computed.columns)


def update_columns(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of changes where they aren't null."""
    new = changes.select(key, *[F.col(c).alias(f"n_{c}") for c in columns])
    return current.join(new, key, "left").select(*[F.coalesce(F.col(f"n_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def allocate_ids(current: DataFrame, incoming: DataFrame, id_col: str, order: list[str], bin_rows: int = 500_000) -> DataFrame:
    """Ids after the largest one, in order. Rows are dealt into ranges of the order by Spark's range partitioning, about
    bin_rows to a range, and written; ranges are laid end to end by their counts and rows are numbered inside their range. No
    task orders all rows, and as ranges are written, a task that runs again gives the same numbers. Rows with equal order
    columns may come in any order; order by a key."""
    top = current.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    bins = max(1, -(-incoming.count() // bin_rows))
    binned = materialize(incoming.repartitionByRange(bins, *order).withColumn("__bin", F.spark_partition_id()), "id-ranges")
    before = F.sum("c").over(Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = binned.groupBy("__bin").agg(F.count("*").alias("c")).select("__bin", F.coalesce(before, F.lit(0)).alias("__s"))
    numbered = binned.withColumn("__n", F.row_number().over(Window.partitionBy("__bin").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "__bin").crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("top") + F.col("__s") + F.col("__n")).cast("long")).drop("__bin", "__n", "__s", "top")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are absent, with their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def shared_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both in the columns that both have."""
    columns = [c for c in a.columns if c in b.columns]
    return a.select(*columns).unionByName(b.select(*columns))


def replace_bodies(current: DataFrame, extracted: DataFrame, key: str, body: str, least: int = 500) -> DataFrame:
    """Bodies longer than `least` replace the ones that are there."""
    return update_columns(current, extracted.filter(F.length(body) > least), key, [body])


def merge_corpora(base: DataFrame, other: DataFrame, url: str, id_col: str) -> DataFrame:
    """Base plus the rows of other whose address is new (rows without one always), with new ids in the order of the
    addresses; rows that share one or have none follow each other in the order of a hash of the row."""
    known = base.filter(F.coalesce(url, F.lit("")) != "").select(F.col(url).alias("__u")).distinct()
    fresh = other.join(known, F.col(url) == F.col("__u"), "left_anti").drop(id_col)
    ordered = fresh.withColumn("__row", F.xxhash64(*fresh.columns))
    return base.unionByName(allocate_ids(base, ordered, id_col, [url, "__row"]).select(*base.columns))


def run_summary(changes: DataFrame) -> DataFrame:
    """A row per run."""
    count = lambda kind: F.count_if(F.col("change_type") == kind).alias(kind)
    return changes.groupBy("sync_run_id").agg(F.min("detected_at").alias("started"), F.count("*").alias("total"), count("added"), count("modified"), count("deleted"))
