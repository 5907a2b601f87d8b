"""DDL events: capture, classification and log rows (L1-L9), reports (R1-R4) and the DDL parse (K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.functions.scalars import identifier

KNOWN = ("ADD COLUMN", "DROP COLUMN", "RENAME COLUMN")


def defaulted(column: Column, default: str) -> Column:
    """L1: a default for null or empty."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def alter_type(column: Column) -> Column:
    """L2: a normalised alter type, null unless known."""
    kind = F.upper(F.trim(column))
    return F.when(kind.isin(*KNOWN), kind)


def captured(events: DataFrame, user: str, db: str) -> DataFrame:
    """L1, L2: captured events with defaults, unknown types dropped."""
    out = events.withColumn("username", defaulted(F.col("username"), user)).withColumn("db_name", defaulted(F.col("db_name"), db))
    return out.withColumn("alter_type", alter_type(F.col("alter_type"))).where("alter_type is not null")


def manual(events: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """L3: accepted and rejected manual captures; strict fails the job on the first unknown type."""
    kind = alter_type(F.col("alter_type"))
    if strict:
        said = F.concat(F.lit("unknown alter type: "), F.coalesce("alter_type", F.lit("null")))
        return events.withColumn("alter_type", F.coalesce(kind, F.raise_error(said))), events.where(F.lit(False))
    return events.where(kind.isNotNull()).withColumn("alter_type", kind), events.where(kind.isNull())


def regulated(events: DataFrame, refs: DataFrame, trim: bool = False) -> DataFrame:
    """L4: is_regulated: whether the table is in the register and active."""
    name = F.trim("table_name") if trim else F.col("table_name")
    on = refs.where("is_active").select("db_name", name.alias("table_name")).distinct().withColumn("_on", F.lit(True))
    return events.drop("is_regulated").join(on, ["db_name", "table_name"], "left").withColumn("is_regulated", F.col("_on").isNotNull()).drop("_on")


def log_rows(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Log rows of captured events."""
    told = regulated(events, refs)
    return told.select("username", "db_name", "table_name", F.concat_ws(".", "db_name", "table_name").alias("object_tag"), F.lit("ALTER TABLE").alias("command_tag"), "alter_type", "column_name", "ddl_command", "is_regulated")


def classified(ddl: Column) -> Column:
    """The alter type a DDL text contains, RENAME before ADD before DROP; null if none."""
    text = F.upper(F.coalesce(ddl, F.lit("")))
    return F.when(text.contains("RENAME COLUMN"), "RENAME COLUMN").when(text.contains("ADD COLUMN"), "ADD COLUMN").when(text.contains("DROP COLUMN"), "DROP COLUMN")


def column_token(ddl: Column, kind: Column) -> Column:
    """The first word after the alter type, which is looked for as written in capitals."""
    flat = F.regexp_replace(F.coalesce(ddl, F.lit("")), r"\s+", " ")
    return F.split_part(F.trim(F.split_part(flat, F.concat(kind, F.lit(" ")), F.lit(2))), F.lit(" "), F.lit(1))


def from_commands(commands: DataFrame) -> DataFrame:
    """Log fields of raw commands (command_tag, object_identity, ddl_command); other commands are dropped."""
    out = commands.where(F.col("command_tag") == "ALTER TABLE").withColumn("alter_type", classified(F.col("ddl_command"))).where("alter_type is not null")
    return out.withColumn("table_name", F.split_part("object_identity", F.lit("."), F.lit(2))).withColumn("column_name", column_token(F.col("ddl_command"), F.col("alter_type")))


def newest(log: DataFrame) -> DataFrame:
    """All events, newest first."""
    return log.orderBy(F.desc("captured_at"), F.desc("id"))


def newest_regulated(log: DataFrame) -> DataFrame:
    """R2: regulated events, newest first."""
    return log.where("is_regulated").select("id", "table_name", "alter_type", "ddl_command", "captured_at").orderBy(F.desc("captured_at"), F.desc("id"))


def by_type(log: DataFrame) -> DataFrame:
    """Events by alter type."""
    return log.groupBy("alter_type").agg(F.count("*").alias("total"))


def in_order(snapshot: DataFrame) -> DataFrame:
    """The snapshot by table and place."""
    return snapshot.orderBy("db_name", "table_name", "ordinal_pos")


#: K6: the three statements in one pattern, tried in this order; and its groups, with a mark between them.
STATEMENT = r"(?is)^ALTER TABLE (\S+) (?:(ADD) COLUMN (\S+) (.+)|(DROP) COLUMN (\S+).*|(RENAME) COLUMN (\S+) TO (\S+).*)$"
MARK, GROUPS = "\x01", "$1 $2$5$7 $3$6 $4 $8 $9"


def matched(events: DataFrame, ddl: str = "ddl_command") -> DataFrame:
    """K6 for all rows: events with parsed_type, parsed_table, parsed_column, column_type, old_column, new_column; null for unknown statements.

    Each text is matched once; a text that holds the mark is unknown.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(ddl), F.lit("")), r"\s+", " "))
    parts = F.split(F.regexp_replace(flat, STATEMENT, MARK + GROUPS.replace(" ", MARK)), MARK)
    cut = events.select("*", F.explode(F.array(parts)).alias("_parts")).withColumn("_parts", F.when((F.size("_parts") == 7) & ~F.contains(F.col(ddl), F.lit(MARK)), F.col("_parts")))
    part = lambda k: F.nullif(F.col("_parts")[k], F.lit(""))
    out = cut.withColumn("parsed_type", F.concat(F.upper(part(2)), F.lit(" COLUMN"))).withColumn("parsed_table", identifier(part(1))).withColumn("parsed_column", identifier(part(3)))
    return out.withColumn("column_type", F.trim(part(4))).withColumn("old_column", identifier(part(5))).withColumn("new_column", identifier(part(6))).drop("_parts")


def parsed(events: DataFrame, ddl: str = "ddl_command") -> DataFrame:
    """K6: the same, unknown statements dropped."""
    return matched(events, ddl).where("parsed_type is not null")
