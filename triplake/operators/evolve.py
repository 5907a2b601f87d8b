"""Schema evolution on metadata tables (P1-P13) and the fold of a stream's events into them (K12; in batch: triplake.operators.fold).

State frames: fed_column(model, table_name, ordinal, name, type); mapping_source(mapping_id, ordinal, physical, logical);
mapping_target(mapping_id, property, binding, xsd); onto_property(property, domain, range, label, deprecated). Event frames
are enriched events (see triplake.streaming.changes), at most one for each table and column; chains go through the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from triplake.functions.scalars import federation_type, label, property_name, xsd_type
from triplake.sources.storage import written

COLUMN = ["model", "table_name", "name"]


def of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("alter_type") == f"{kind} COLUMN")


def _next(events: DataFrame, state: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """events with `ordinal`, after the largest of their group in the state. A group's events are those of one table."""
    last = state.groupBy(*group).agg(F.max("ordinal").alias("_last"))
    ranked = events.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.join(last, group, "left").withColumn("ordinal", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_last")


def add_federated(fed: DataFrame, events: DataFrame) -> DataFrame:
    """New columns come last with their federation type; those that are there already (exact name) are skipped."""
    new = of(events, "ADD").select("model", "table_name", F.col("column_name").alias("name"), federation_type(F.col("column_type")).alias("type")).dropDuplicates(COLUMN)
    new = new.join(fed.select(*COLUMN), COLUMN, "left_anti")
    return fed.unionByName(_next(new, fed, ["model", "table_name"], ["name"]).select(*fed.columns))


def add_mapping_target(target: DataFrame, events: DataFrame) -> DataFrame:
    """A property for each new column."""
    new = of(events, "ADD").select("mapping_id", property_name(F.col("column_name")).alias("property"), F.col("column_name").alias("binding"), xsd_type(F.col("column_type")).alias("xsd")).dropDuplicates(["mapping_id", "property"])
    return target.unionByName(new.join(target.select("mapping_id", "property"), ["mapping_id", "property"], "left_anti").select(*target.columns))


def add_mapping_source(source: DataFrame, events: DataFrame) -> DataFrame:
    """The new column joins the mapping's projection."""
    new = of(events, "ADD").select("mapping_id", F.col("column_name").alias("physical"), F.col("column_name").alias("logical")).dropDuplicates(["mapping_id", "physical"])
    new = new.join(source.select("mapping_id", "physical"), ["mapping_id", "physical"], "left_anti")
    return source.unionByName(_next(new, source, ["mapping_id"], ["physical"]).select(*source.columns))


def add_ontology(onto: DataFrame, events: DataFrame) -> DataFrame:
    """A datatype property with domain, range and label."""
    name = property_name(F.col("column_name"))
    new = of(events, "ADD").select(name.alias("property"), F.col("class").alias("domain"), xsd_type(F.col("column_type")).alias("range"), label(name).alias("label"), F.lit(False).alias("deprecated")).dropDuplicates(["property"])
    return onto.unionByName(new.join(onto.select("property"), "property", "left_anti").select(*onto.columns))


def drop_federated(fed: DataFrame, events: DataFrame) -> DataFrame:
    """Dropped columns go."""
    return fed.join(of(events, "DROP").select("model", "table_name", F.col("column_name").alias("name")), COLUMN, "left_anti").select(*fed.columns)


def dropped_properties(target: DataFrame, source: DataFrame, events: DataFrame) -> DataFrame:
    """P5's finding: (mapping_id, property) of each dropped column, by derived name, else by binding.

    A column that was renamed is dropped under its logical name.
    """
    gone = of(events, "DROP").select("mapping_id", F.col("column_name").alias("physical")).distinct()
    gone = gone.join(source.select("mapping_id", "physical", "logical"), ["mapping_id", "physical"], "left").withColumn("logical", F.coalesce("logical", "physical")).withColumn("derived", property_name(F.col("logical")))
    by_name = target.select("mapping_id", F.col("property").alias("derived"), F.col("property").alias("named"))
    by_binding = target.select("mapping_id", F.col("binding").alias("logical"), F.col("property").alias("bound"))
    met = gone.join(by_name, ["mapping_id", "derived"], "left").join(by_binding, ["mapping_id", "logical"], "left")
    return met.select("mapping_id", F.coalesce("named", "bound").alias("property")).where("property is not null").distinct()


def drop_mapping_target(target: DataFrame, source: DataFrame, events: DataFrame) -> DataFrame:
    """P5: the properties of dropped columns leave the mapping."""
    return target.join(dropped_properties(target, source, events), ["mapping_id", "property"], "left_anti").select(*target.columns)


def drop_mapping_source(source: DataFrame, events: DataFrame) -> DataFrame:
    """P5: dropped columns leave the projection."""
    return source.join(of(events, "DROP").select("mapping_id", F.col("column_name").alias("physical")), ["mapping_id", "physical"], "left_anti").select(*source.columns)


def deprecate(onto: DataFrame, properties: DataFrame) -> DataFrame:
    """Properties are kept and marked, once."""
    gone = properties.select("property").distinct().withColumn("_gone", F.lit(True))
    return onto.join(gone, "property", "left").withColumn("deprecated", F.col("deprecated") | F.coalesce("_gone", F.lit(False))).select(*onto.columns)


def rename_source(source: DataFrame, events: DataFrame) -> DataFrame:
    """The physical name changes, the name that consumers see stays, also after a second rename."""
    new = of(events, "RENAME").select("mapping_id", F.col("old_column").alias("physical"), F.col("new_column").alias("_new")).dropDuplicates(["mapping_id", "physical"])
    return source.join(new, ["mapping_id", "physical"], "left").withColumn("physical", F.coalesce("_new", "physical")).select(*source.columns)


def rename_federated(fed: DataFrame, events: DataFrame) -> DataFrame:
    """The federated column takes the new physical name; type and place stay."""
    new = of(events, "RENAME").select("model", "table_name", F.col("old_column").alias("name"), F.col("new_column").alias("_new")).dropDuplicates(COLUMN)
    return fed.join(new, COLUMN, "left").withColumn("name", F.coalesce("_new", "name")).select(*fed.columns)


def column_lists(fed: DataFrame) -> DataFrame:
    """Each table's columns in order; a table's columns are few."""
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    return fed.groupBy("model", "table_name").agg(F.array_join(F.transform(pairs, lambda p: p["name"]), ",").alias("columns"))


def projection(source: DataFrame, mapping_id: str) -> list[tuple[str, str]]:
    """P7 on data: a mapping's (physical, logical) pairs in order."""
    return [(r[0], r[1]) for r in source.where(F.col("mapping_id") == mapping_id).orderBy("ordinal").select("physical", "logical").collect()]


def through(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """P1, P4, P7 on data: a table read under its logical names; old and new files alike, columns a file lacks are null."""
    have = set(df.columns)
    pick = lambda p, n: F.col(p) if p in have else F.col(n) if n in have else F.lit(None)
    return df.select(*[pick(p, n).alias(n) for p, n in pairs])


def absorb_types(physical: DataFrame, exposed: DataFrame) -> DataFrame:
    """P10: the cast that keeps each exposed type; null where the types agree already."""
    now = physical.select(*COLUMN, F.col("type").alias("physical_type"))
    return exposed.join(now, COLUMN).select(*COLUMN, "type", "physical_type", F.when(F.col("type") != F.col("physical_type"), F.concat_ws("", F.lit("CAST("), "name", F.lit(" AS "), "type", F.lit(")"))).alias("cast"))


def absorbed(column: Column, physical: str, exposed: str) -> Column:
    """P10 on data."""
    return column if physical == exposed else column.cast(exposed)


def placeholder(df: DataFrame) -> DataFrame:
    """A view of a dropped table: its columns, no rows."""
    return df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]).limit(0)


def drop_table(target: DataFrame, tables: DataFrame) -> DataFrame:
    """Mappings of dropped tables (mapping_id) go."""
    return target.join(tables.select("mapping_id"), "mapping_id", "left_anti").select(*target.columns)


def dependents(links: DataFrame, tables: DataFrame) -> DataFrame:
    """Mappings whose links lead to the subjects of dropped tables: links(mapping_id, kind), tables(kind)."""
    return links.join(tables.select("kind"), "kind", "left_semi").select("mapping_id", "kind").distinct()


def all_dependents(links: DataFrame, tables: DataFrame) -> DataFrame:
    """What depends on dropped tables over any number of links: links(mapping_id, subject, kind), tables(kind) to dropped, mapping_id and hops, the fewest links between.

    Semi-naive: each round follows the links that lead to what was found last, and only what wasn't there goes on, so cycles end. Links are
    metadata, one row for a mapping and kind, made distinct first; rounds are written, and there are as many as the longest way.
    """
    to = written(links.select("mapping_id", "subject", "kind").where("mapping_id is not null and kind is not null").distinct(), "links")
    frontier = tables.select(F.col("kind").alias("dropped"), F.col("kind").alias("at")).where("dropped is not null").distinct()
    seen = hops = None
    while True:
        met = to.join(frontier, to["kind"] == frontier["at"]).select("dropped", "mapping_id", "subject").distinct()
        hops = 1 if hops is None else hops + 1
        met = met if seen is None else met.join(seen, ["dropped", "mapping_id"], "left_anti")
        new = written(met.withColumn("hops", F.lit(hops)), "reached")
        if new.isEmpty():
            return (new if seen is None else seen).select("dropped", "mapping_id", "hops")
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.where("subject is not null").select("dropped", F.col("subject").alias("at")).distinct()


def violations(target: DataFrame, source: DataFrame) -> DataFrame:
    """Bindings that the mapping's projection no longer exposes."""
    exposed = source.select("mapping_id", F.col("logical").alias("binding"))
    return target.join(exposed, ["mapping_id", "binding"], "left_anti").select("mapping_id", "property", "binding")


def unsafe_drops(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Drops of columns that a subject template or a link uses: templates(mapping_id, column_name). They aren't applied."""
    return of(events, "DROP").join(templates.select("mapping_id", "column_name"), ["mapping_id", "column_name"], "left_semi")


# ---- K12 ----
_EVENT = ["id", "alter_type", "column_name", "column_type", "old_column", "new_column"]
FOLDED = "table_name string, ordinal int, physical string, logical string, type string, active boolean, last_id long, n_applied long"
_STATE = T.StructType([T.StructField("columns", T.StringType()), T.StructField("last_id", T.LongType()), T.StructField("n_applied", T.LongType())])


def fold_column(columns: list[list], live: dict[str, int], e: tuple) -> None:
    """Applies one event to a table's columns (physical, logical, type, active, id of the ADD); live: the active columns' places by name."""
    number, kind, name, sql_type, old, new = e
    if kind == "ADD COLUMN" and name not in live:
        live[name] = len(columns)
        columns.append([name, name, sql_type, True, number])
    elif kind == "DROP COLUMN" and name in live:
        columns[live.pop(name)][3] = False
    elif kind == "RENAME COLUMN" and old in live and new not in live:
        live[new] = live.pop(old)
        columns[live[new]][0] = new


def _packed(events: DataFrame) -> DataFrame:
    """What the fold needs of events; those without an id or a table have no place in a log."""
    return events.where("table_name is not null and id is not null").select("table_name", F.col("id").cast("long").alias("id"), *_EVENT[1:])


def fold_stream(events: DataFrame) -> DataFrame:
    """K12, stream: the same state kept by table. Repeated ids are dropped by a state of their own, dealt by table and id, whatever their age. An
    id below the last that was never seen is late: its table's row comes out with ordinal -1, and the caller rebuilds that table with `triplake.operators.fold.fold`.

    A micro-batch's events of one table are sorted in one task; the source's rate limit bounds them.
    """
    import json

    def own(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns, last, n = [], -1, 0
        if state.exists:
            text, last, n = state.get
            columns = json.loads(text)
        live = {c[0]: i for i, c in enumerate(columns) if c[3]}
        found = sorted((e for pdf in batches for e in zip(*[pdf[c].tolist() for c in _EVENT], strict=True)), key=lambda e: e[0])
        late = [e[0] for e in found if e[0] < last]
        for e in found[len(late) :]:
            fold_column(columns, live, e)
            last, n = int(e[0]), n + 1
        state.update((json.dumps(columns), last, n))
        told = [[key[0], i + 1, *c[:4], last, n] for i, c in enumerate(columns)] + [[key[0], -1, None, None, None, False, x, n] for x in late]
        yield pd.DataFrame(told, columns=[c.split()[0] for c in FOLDED.split(", ")])

    ready = _packed(events).dropDuplicates(["table_name", "id"])
    return ready.groupBy("table_name").applyInPandasWithState(own, FOLDED, _STATE, "append", "NoTimeout")
