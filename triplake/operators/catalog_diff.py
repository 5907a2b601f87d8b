"""Column catalog diff (D1-D10): what vanished, appeared or was renamed, as events, and the snapshot's next state.

Tables are (db_name, table_name, column_name, column_type, ordinal_pos); refs are (db_name, table_name, is_active).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.sources.storage import written

TABLE = ["db_name", "table_name"]
KEY = [*TABLE, "column_name"]
PLACE = [*TABLE, "ordinal_pos", "column_type"]
COLUMNS = [*KEY, "column_type", "ordinal_pos"]
EVENT = ["username", *TABLE, "alter_type", "column_name", "ddl_command"]


def active(refs: DataFrame) -> DataFrame:
    return refs.where("is_active").select(*TABLE).distinct()


def baseline(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """Catalog columns of the actively monitored tables."""
    return catalog.join(active(refs), TABLE, "left_semi").select(*COLUMNS)


def vanished(snapshot: DataFrame, catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """Snapshot columns of active tables that the catalog no longer has."""
    return snapshot.join(active(refs), TABLE, "left_semi").join(catalog.select(*KEY), KEY, "left_anti").select(*COLUMNS)


def appeared(snapshot: DataFrame, catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """D3: catalog columns of active tables that the snapshot doesn't have."""
    return catalog.join(active(refs), TABLE, "left_semi").join(snapshot.select(*KEY), KEY, "left_anti").select(*COLUMNS)


def renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs with the same table, place and type; `ambiguous` where a place has more than one pair. Null types never match."""
    pairs = gone.select(*PLACE, F.col("column_name").alias("old_column")).join(new.select(*PLACE, F.col("column_name").alias("new_column")), PLACE)
    many = pairs.groupBy(*PLACE).agg((F.count("*") > 1).alias("ambiguous"))
    return pairs.join(many, PLACE).select(*TABLE, "ordinal_pos", "column_type", "old_column", "new_column", "ambiguous")


def pure_drops(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Vanished columns without a partner."""
    return gone.join(new.select(*PLACE), PLACE, "left_anti").select(*COLUMNS)


def pure_adds(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Appeared columns without a partner."""
    return new.join(gone.select(*PLACE), PLACE, "left_anti").select(*COLUMNS)


def _statement(action: str, rest) -> object:
    return F.concat(F.lit("ALTER TABLE `"), F.col("db_name"), F.lit("`.`"), F.col("table_name"), F.lit(f"` {action} COLUMN `"), *rest)


def events(renamed: DataFrame, dropped: DataFrame, added: DataFrame, user: str = "event_scheduler") -> DataFrame:
    """One set of rendered events."""
    who = F.lit(user).alias("username")
    kind = lambda k: F.lit(f"{k} COLUMN").alias("alter_type")
    r = renamed.select(who, *TABLE, kind("RENAME"), F.concat("old_column", F.lit(" -> "), "new_column").alias("column_name"), _statement("RENAME", [F.col("old_column"), F.lit("` TO `"), F.col("new_column"), F.lit("`")]).alias("ddl_command"))
    d = dropped.select(who, *TABLE, kind("DROP"), "column_name", _statement("DROP", [F.col("column_name"), F.lit("`")]).alias("ddl_command"))
    a = added.select(who, *TABLE, kind("ADD"), "column_name", _statement("ADD", [F.col("column_name"), F.lit("` "), F.col("column_type")]).alias("ddl_command"))
    return r.unionByName(d).unionByName(a)


def without(snapshot: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshot less the vanished columns."""
    return snapshot.join(gone.select(*KEY), KEY, "left_anti").select(*COLUMNS)


def with_new(snapshot: DataFrame, new: DataFrame, catalog: DataFrame | None = None, refresh: bool = False) -> DataFrame:
    """The snapshot and the appeared columns; rows already there keep their old type and place, unless refresh."""
    fresh = new.dropDuplicates(KEY).join(snapshot.select(*KEY), KEY, "left_anti").select(*COLUMNS)
    if not refresh:
        return snapshot.select(*COLUMNS).unionByName(fresh)
    now = catalog.select(*KEY, F.col("column_type").alias("_type"), F.col("ordinal_pos").alias("_place"))
    kept = snapshot.join(now, KEY, "left").select(*KEY, F.coalesce("_type", "column_type").alias("column_type"), F.coalesce("_place", "ordinal_pos").alias("ordinal_pos"))
    return kept.unionByName(fresh)


@dataclass
class Diff:
    gone: DataFrame
    new: DataFrame
    renamed: DataFrame
    events: DataFrame
    snapshot: DataFrame


def diff(snapshot: DataFrame, catalog: DataFrame, refs: DataFrame) -> Diff:
    """One poll: all events and the next snapshot. The change sets are small beside the catalog; they are written, so that both tables are compared once."""
    gone, new = written(vanished(snapshot, catalog, refs), "gone"), written(appeared(snapshot, catalog, refs), "new")
    renamed = renames(gone, new)
    told = events(renamed, pure_drops(gone, new), pure_adds(gone, new))
    return Diff(gone, new, renamed, told, with_new(without(snapshot, gone), new))


DIGEST = ["n", "sum_a", "sum_b"]


def digests(columns: DataFrame) -> DataFrame:
    """A digest of each table's column names that no order changes: their number and two sums of 64-bit hashes."""
    total = lambda seed, name: F.sum(F.xxhash64(F.lit(seed), "column_name").cast("decimal(20,0)")).alias(name)
    return columns.groupBy(*TABLE).agg(F.count("*").alias("n"), total(17, "sum_a"), total(71, "sum_b"))


def differing(known: DataFrame, now: DataFrame, refs: DataFrame) -> DataFrame:
    """Active tables whose digest is another, or is on one side only."""
    then = known.select(*TABLE, *[F.col(c).alias(f"_{c}") for c in DIGEST])
    met = now.join(then, TABLE, "full").where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("sum_a").eqNullSafe(F.col("_sum_a")) & F.col("sum_b").eqNullSafe(F.col("_sum_b"))))
    return met.join(active(refs), TABLE, "left_semi").select(*TABLE)


@dataclass
class Poll:
    """What a poll found, and what the next one needs: the snapshot and its tables' digests. compared: the tables whose columns were read."""

    events: DataFrame
    snapshot: DataFrame
    known: DataFrame
    compared: DataFrame


def poll(snapshot: DataFrame, known: DataFrame, catalog: DataFrame, refs: DataFrame) -> Poll:
    """D1-D10 for a catalog that seldom changes. The catalog is summed up to a digest a table; columns are compared only for tables whose digest
    isn't the one kept with the snapshot, so a poll that finds nothing reads no row of the snapshot."""
    now = written(digests(catalog.join(active(refs), TABLE, "left_semi")), "digests")
    other = written(differing(known, now, refs), "differing")
    rest = known.join(active(refs), TABLE, "left_anti").select(*TABLE, *DIGEST)
    kept = now.select(*TABLE, *DIGEST).unionByName(rest)
    if other.isEmpty():
        nothing = snapshot.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in EVENT))
        return Poll(nothing, snapshot, kept, other)
    only = lambda df: df.join(other, TABLE, "left_semi")
    found = diff(only(snapshot), only(catalog), refs)
    return Poll(found.events, snapshot.join(other, TABLE, "left_anti").select(*COLUMNS).unionByName(found.snapshot), kept, other)
