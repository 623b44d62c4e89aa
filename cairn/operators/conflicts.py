"""Key conflicts between ordered files: who owned a key before, grouped, filtered and summed up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.resource_types import codes
from cairn.tables import written

#: The resource types in which keys can conflict, those enabled at first, and the group that is local to a file.
CONFLICT_TYPES = ("BCON", "BHAV", "CTSS", "GLOB", "GZPS", "OBJD", "OBJF", "SLOT", "STR", "TPRP", "TRCN", "TTAB", "TTAS", "VERS")
DEFAULT_ENABLED = tuple(t for t in CONFLICT_TYPES if t not in ("CTSS", "TPRP", "TRCN", "VERS"))
LOCAL_GROUP = 0xFFFFFFFF


#: Rows above which a key's rows go to several tasks, and the most stretches that all such rows are cut into.
HOT_ROWS, STRETCHES = 1_000_000, 10_000


def relevant(rows: DataFrame, type_id: str = "type_id", group_id: str = "group_id", types: Sequence[str] = CONFLICT_TYPES) -> DataFrame:
    """Rows whose keys can conflict at all: of those types, and not of the group that is local to a file."""
    return rows.where(F.col(type_id).isin(codes(types)) & (F.col(group_id) != LOCAL_GROUP))


def previous_owner(rows: DataFrame, keys: Sequence[str], file: str, order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows whose key stood in an earlier row, with `original`, the file of the row just before: a chain, not a star.

    Keys that occur once can't conflict; a count, which combines before its shuffle, drops them, so that only
    conflicting keys are sorted. The repeated keys are written with their counts; if a key has more than hot_rows rows, the
    rows of such keys are cut by key and whole order into stretches that are sorted apart.
    """
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"))
    hot = counts.where(F.col("_n") > hot_rows)
    n_hot = hot.agg(F.sum("_n")).first()[0]
    lag = lambda *by: F.lag(file).over(Window.partitionBy(*keys, *by).orderBy(*order))
    plain = rows.join(counts.where(F.col("_n") <= hot_rows).drop("_n"), list(keys), "left_semi")
    found = plain.withColumn("original", lag()).where("original is not null")
    if n_hot is None:
        return found
    n = min(STRETCHES, 2 * n_hot // hot_rows + 2)
    return found.unionByName(_stitched(rows.join(hot.drop("_n"), list(keys), "left_semi"), keys, file, order, n, lag))


def _stitched(rows: DataFrame, keys: Sequence[str], file: str, order: Sequence[str], n: int, lag) -> DataFrame:
    """previous_owner for rows of hot keys: each stretch is a window of its own, and its first row looks to the last row of the stretch before.

    Stretches are ranges of keys and order together, so that a key's rows are cut also where they stand in one file. They are
    written, since ranges that are drawn anew may differ.
    """
    cut = written(rows.repartitionByRange(n, *keys, *order).withColumn("_stretch", F.spark_partition_id()))
    inside = cut.withColumn("original", lag("_stretch")).where("original is not null").drop("_stretch")
    at = F.struct(*order)
    ends = cut.groupBy(*keys, "_stretch").agg(F.min_by(F.struct(*rows.columns), at).alias("_first"), F.max_by(file, at).alias("_last"))
    between = ends.withColumn("original", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_stretch"))).where("original is not null")
    return inside.unionByName(between.select("_first.*", "original"))


def conflict_groups(rows: DataFrame, keys: Sequence[str], file: str, file_order: Sequence[str], position: str) -> DataFrame:
    """A row for each (original, new) pair: how many keys conflict, and the keys in index order.

    The list is for people to read; of a pair with very many keys, conflict_counts() says all that filters need.
    """
    found = previous_owner(rows, keys, file, [*file_order, position])
    by = ["original", file, *(c for c in file_order if c != file)]
    listed = F.array_sort(F.collect_list(F.struct(F.col(position), *keys)))
    return found.groupBy(*by).agg(F.count("*").alias("n_keys"), listed.alias("keys")).withColumnRenamed(file, "new")


def conflict_counts(rows: DataFrame, keys: Sequence[str], file: str, file_order: Sequence[str], position: str, type_of: str) -> DataFrame:
    """A row for each (original, new) pair: how many keys conflict, and of which types; no list of keys is built."""
    found = previous_owner(rows, keys, file, [*file_order, position])
    return found.groupBy("original", file).agg(F.count("*").alias("n_keys"), F.array_sort(F.collect_set(type_of)).alias("types")).withColumnRenamed(file, "new")


def visible(conflicts: DataFrame, types: Column, enabled: Sequence[str | int] = DEFAULT_ENABLED, known: DataFrame | None = None, show_known: bool = False) -> DataFrame:
    """Conflicts with `is_known` and `shown`: any of their types is enabled, and they are unknown or known ones are shown."""
    if known is None:
        marked = conflicts.withColumn("is_known", F.lit(False))
    else:
        pairs = known.select("original", "new").distinct().withColumn("_known", F.lit(True))
        marked = conflicts.join(pairs, ["original", "new"], "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")
    some = F.exists(types, lambda t: t.isin(list(enabled))) if enabled else F.lit(False)
    return marked.withColumn("shown", some & (F.lit(show_known) | ~F.col("is_known")))


def type_status(shown: DataFrame, types: Column) -> DataFrame:
    """type, status: NotVisible if a hidden, unknown conflict has the type, else FoundVisible if a shown one has it, else NotFound."""
    each = shown.select(F.explode(F.array_distinct(types)).alias("type"), "shown", "is_known")
    hidden = F.bool_or(~F.col("shown") & ~F.col("is_known"))
    status = F.when(hidden, "NotVisible").when(F.bool_or("shown"), "FoundVisible").otherwise("NotFound")
    return each.groupBy("type").agg(status.alias("status"))


def has_hidden(shown: DataFrame) -> DataFrame:
    return shown.agg(F.coalesce(F.bool_or(~F.col("shown") & ~F.col("is_known")), F.lit(False)).alias("has_hidden"))


def only_known(conflicts: DataFrame, known: DataFrame) -> DataFrame:
    return conflicts.join(known, ["original", "new"], "left_semi")


def only_unknown(conflicts: DataFrame, known: DataFrame) -> DataFrame:
    return conflicts.join(known, ["original", "new"], "left_anti")


def add_known(known: DataFrame, more: DataFrame) -> DataFrame:
    """A known list with more pairs, each once."""
    return known.unionByName(more).dropDuplicates(["original", "new"])


def progress(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """files with position (from 1) and total. Positions come from sorted ranges, not from one window over all rows."""
    n = files.agg(F.count("*").alias("total"))
    return positions(files, order, "position").join(F.broadcast(n))


def positions(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows numbered from 1 in an order over all of them.

    The rows are range-partitioned, sorted and written with their place in their partition; a row's number is
    that place and the rows of all partitions before. No task holds all rows, and only the partitions' counts are broadcast.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    # the id's lower 33 bits count a partition's rows, the others are the partition
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part, at = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, (F.col("_before") + at + 1).cast("long")).drop("_part", "_id", "_before")
