"""The ordered fold of change events into columns, mappings and ontology (K12, batch), with one table's log in many tasks.

Whether an event changes anything depends on which names are live: ADD needs its name dead, DROP live, RENAME the old name live and
the new one dead. A log is cut by id into segments. A segment is run with what is known of its names' liveness before it; a name may be
unknown at first, but every ADD and DROP tells the state after it, and so do many renames: RENAME o TO n leaves o live if both were,
n live if either was. What a segment tells is handed on by name to the next segment that touches it, and segments that met an
unknown are run again. Each time at least the first of each table's unsettled segments is settled; in practice all soon are.

A settled segment's effect is a guarded transition: where each column that came in live leaves it, and which columns were
born. Transitions are composed by doubling: after k joins a column has followed 2^k segments. So no task holds more than a
segment of a table, and what passes between segments are names.

On the columns' histories the three layers follow: the federation's columns, the mapping's projection and properties, and the
ontology's properties, which stay and are marked once their column is gone.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplake.functions.scalars import federation_type, label, property_name, xsd_type
from triplake.sources.storage import written

#: Events of a segment.
SEGMENT = 100_000
_EVENT = ["id", "alter_type", "column_name", "column_type", "old_column", "new_column"]
HISTORY = "table_name string, added long, logical string, type string, physical string, dropped long"
FOLDED = ["table_name", "ordinal", "physical", "logical", "type", "active", "last_id", "n_applied"]


def _segmented(events: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Events with an id and a table, with their segment `part`: lower parts of a table come before higher ones; and the number of parts. Repeats are in one part."""
    rows = events.where("table_name is not null and id is not null").select("table_name", F.col("id").cast("long").alias("id"), *_EVENT[1:])
    rows = written(rows, "events")
    parts = max(1, -(-rows.count() // size))
    if parts == 1:
        return rows.withColumn("part", F.lit(0)), 1
    dealt = rows.repartitionByRange(parts, "table_name", "id").withColumn("part", F.spark_partition_id())
    return written(dealt.dropDuplicates(["table_name", "part", "id"]), "segments"), parts


def after(live: dict[str, bool | None], e: tuple) -> bool | None:
    """Applies an event to what is known of names (True, False, None: unknown); whether it changed something, None if that isn't known."""
    kind, name, old, new = e
    if kind == "ADD COLUMN" and name is not None:
        was, live[name] = live.get(name), True
        return None if was is None else not was
    if kind == "DROP COLUMN" and name is not None:
        was, live[name] = live.get(name), False
        return was
    if kind == "RENAME COLUMN" and old is not None and new is not None and old != new:
        a, b = live.get(old), live.get(new)
        live[old] = False if a is False or b is False else True if a and b else None
        live[new] = True if a or b else False if a is False and b is False else None
        return False if a is False or b is True else True if a is True and b is False else None
    return False


def _names(e: tuple) -> list[str]:
    kind, name, old, new = e
    found = [old, new] if kind == "RENAME COLUMN" else [name]
    return [x for x in found if x is not None]


def _in_order(pdf: pd.DataFrame, *columns: str) -> list[tuple]:
    pdf = pdf.drop_duplicates("id").sort_values("id").astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return list(zip(*[pdf[c].tolist() for c in columns], strict=True))


def _run(key: tuple, events: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """What is known of a segment's names after it."""
    if not len(events):
        return pd.DataFrame({"table_name": [], "part": [], "name": [], "after": []}).astype({"part": "int32", "after": "object"})
    live = dict(zip(known["name"], known["before"].tolist(), strict=True))
    for e in _in_order(events, "alter_type", "column_name", "old_column", "new_column"):
        for n in _names(e):
            live.setdefault(n, None)
        after(live, e)
    return pd.DataFrame({"table_name": key[0], "part": key[1], "name": list(live), "after": pd.Series(list(live.values()), dtype=object)})


def _transition(key: tuple, events: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Of a settled segment: for each column that came in under a live name (start), and each that was born (added), the name it has after (end) or the id of its DROP."""
    live = dict(zip(known["name"], known["before"].tolist(), strict=True))
    columns = [[n, None, None, None, n, None] for n, up in live.items() if up]  # start, added, logical, type, end, dropped
    at = {c[0]: c for c in columns}
    log = _in_order(events, *_EVENT)
    for _, kind, name, _, old, new in log:
        for n in _names((kind, name, old, new)):
            live.setdefault(n, False)
    for number, kind, name, sql_type, old, new in log:
        if not after(live, (kind, name, old, new)):
            continue
        if kind == "ADD COLUMN":
            at[name] = [None, number, name, sql_type, name, None]
            columns.append(at[name])
        elif kind == "DROP COLUMN":
            at.pop(name)[5] = number
        else:
            at[new] = at.pop(old)
            at[new][4] = new
    out = pd.DataFrame(columns, columns=["start", "added", "logical", "type", "end", "dropped"], dtype=object)
    out.insert(0, "part", key[1])
    out.insert(0, "table_name", key[0])
    return out


def histories(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Every column that ever was: when it was added, under which name and type, the name it has last, and the id of its DROP or null."""
    return _histories(*_segmented(events, segment))


_MOVE = "table_name string, part int, start string, added long, logical string, type string, end string, dropped long"


def _whole(key: tuple, events: pd.DataFrame) -> pd.DataFrame:
    """A table whose log is one segment: no name is live before it."""
    out = _transition((key[0], 0), events, pd.DataFrame({"name": [], "before": []}))
    return out.assign(last_id=events["id"].max(), n_applied=events["id"].nunique())


def _small(log: DataFrame) -> DataFrame:
    rows = log.groupBy("table_name").applyInPandas(_whole, _MOVE + ", last_id long, n_applied long")
    return written(rows.select("table_name", "added", "logical", "type", F.col("end").alias("physical"), "dropped", "last_id", "n_applied"), "histories")


def _histories(log: DataFrame, parts: int) -> DataFrame:
    if parts == 1:
        return _small(log).drop("last_id", "n_applied")
    place = ["table_name", "part"]
    by_name = W.partitionBy("table_name", "name").orderBy("part")  # a row for each segment that touches the name
    names = F.array_compact(F.when(F.col("alter_type") == "RENAME COLUMN", F.array("old_column", "new_column")).otherwise(F.array("column_name")))
    told = log.select(*place, F.explode(names).alias("name")).distinct().withColumn("after", F.lit(None).cast("boolean"))
    # a name that no earlier segment touches is dead
    handed = lambda rows: written(rows.withColumn("before", F.when(F.row_number().over(by_name) == 1, F.lit(False)).otherwise(F.lag("after").over(by_name))), "names")
    state = handed(told)
    while True:
        # segments whose names are all known at the start are settled once they have run with that
        ready = log.groupBy(*place).cogroup(state.where("before is not null").groupBy(*place)).applyInPandas(_run, "table_name string, part int, name string, after boolean")
        open_ = state.where("before is null").select(*place).distinct()
        if open_.isEmpty():
            break
        state = handed(written(ready, "ran").select(*place, "name", "after"))
    moves = log.groupBy(*place).cogroup(state.groupBy(*place)).applyInPandas(_transition, _MOVE)
    moves = written(moves, "moves")
    # a column at the end of a segment goes on in the next segment that touches its name
    touched = state.select("table_name", F.col("part").alias("next"), F.col("name").alias("end"))
    follows = moves.where("dropped is null").join(touched, ["table_name", "end"]).where("next > part").groupBy("table_name", "part", "end").agg(F.min("next").alias("next"))
    step = moves.join(follows, ["table_name", "part", "end"], "left").withColumn("next", F.when(F.col("dropped").isNull(), F.col("next")))
    born = written(step.where("added is not null").select("table_name", "added", "logical", "type", F.col("end").alias("physical"), "dropped", "next"), "born")
    jump = written(step.where("start is not null").select("table_name", "part", "start", "end", "dropped", "next"), "jump")
    while not born.where("next is not null").isEmpty():
        way = jump.select(F.col("table_name").alias("_t"), F.col("part").alias("_p"), F.col("start").alias("_s"), F.col("end").alias("_end"), F.col("dropped").alias("_dropped"), F.col("next").alias("_next"))
        on = lambda name: (F.col("table_name") == F.col("_t")) & (F.col("next") == F.col("_p")) & (F.col(name) == F.col("_s"))
        met = lambda name: [F.coalesce("_end", name).alias(name), F.coalesce("_dropped", "dropped").alias("dropped"), F.col("_next").alias("next")]
        born = written(born.join(way, on("physical"), "left").select("table_name", "added", "logical", "type", *met("physical")), "born")
        jump = written(jump.join(way, on("end"), "left").select("table_name", "part", "start", *met("end")), "jump")
    return born.drop("next")


def fold(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Each table's columns after all its events in id order, repeats once. Ordinals come from a window over a table's columns, which are few."""
    log, parts = _segmented(events, segment)
    if parts == 1:
        columns = _small(log)
    else:
        applied = log.groupBy("table_name").agg(F.max("id").alias("last_id"), F.count("*").alias("n_applied"))
        columns = _histories(log, parts).join(applied, "table_name")
    ordinal = F.row_number().over(W.partitionBy("table_name").orderBy("added"))
    return columns.withColumn("ordinal", ordinal).withColumn("active", F.col("dropped").isNull()).select(*FOLDED)


@dataclass(frozen=True)
class Layers:
    """fed_column(model, table_name, ordinal, name, type), mapping_source(mapping_id, ordinal, physical, logical), mapping_target(mapping_id, property, binding, xsd), onto_property(property, domain, range, label, deprecated)."""

    federation: DataFrame
    projection: DataFrame
    mapping: DataFrame
    ontology: DataFrame


def layers(events: DataFrame, tables: DataFrame, columns: DataFrame, properties: DataFrame, segment: int = SEGMENT) -> Layers:
    """K12, whole: the three layers after all events.

    tables(table_name, mapping_id, class, model); columns(table_name, ordinal, name, type): what is there before the first event;
    properties(table_name, property, binding, xsd): what the mappings bind of it, under any names. Event ids are positive.

    A property is added with its column unless the mapping has one of that name, and goes with the column's DROP: by the name derived
    from the column's logical name, or, where the mapping has none of that name then, by its binding. The ontology's property comes
    with the first column of its name, in any table, and is deprecated from the first time it leaves a mapping.
    """
    before = columns.select("table_name", (F.col("ordinal") - 1_000_000).cast("long").alias("id"), F.lit("ADD COLUMN").alias("alter_type"), F.col("name").alias("column_name"), F.col("type").alias("column_type"), F.lit(None).cast("string").alias("old_column"), F.lit(None).cast("string").alias("new_column"))
    every = histories(events.select("table_name", F.col("id").cast("long").alias("id"), *_EVENT[1:]).unionByName(before), segment)
    every = written(every.join(tables, "table_name"), "histories")
    there = every.where("dropped is null")
    place = F.row_number().over(W.partitionBy("table_name").orderBy("added"))
    federation = there.select("model", "table_name", place.alias("ordinal"), F.col("physical").alias("name"), federation_type(F.col("type")).alias("type"))
    projection = there.select("mapping_id", place.alias("ordinal"), "physical", "logical")

    # a property's comings and goings in order: the last decides whether it is there, the first coming since then what it binds
    named = properties.select("table_name", "property", "binding", "xsd").withColumn("at", F.lit(-1_000_000).cast("long")).withColumn("comes", F.lit(True))
    derived = property_name(F.col("logical"))
    kept = properties.select("table_name", F.col("binding").alias("logical"), F.lit(True).alias("_bound"))
    own = every.join(kept, ["table_name", "logical"], "left").where((F.col("added") > 0) | F.col("_bound").isNull())
    comes = own.where("added > 0").select("table_name", derived.alias("property"), F.col("logical").alias("binding"), xsd_type(F.col("type")).alias("xsd"), F.col("added").alias("at"), F.lit(True).alias("comes"))
    goes = every.where("dropped is not null").select("table_name", derived.alias("property"), F.col("logical").alias("binding"), F.lit(None).cast("string").alias("xsd"), F.col("dropped").alias("at"), F.lit(False).alias("comes"))
    line = W.partitionBy("table_name", "property").orderBy("at")
    moves = named.unionByName(comes).unionByName(goes)
    found = moves.withColumn("was", F.coalesce(F.lag("comes").over(line), F.lit(False)))
    # a DROP that finds no property of the derived name takes the one that binds its column
    bound = named.select("table_name", F.col("property").alias("_property"), "binding")
    other = found.where("not comes and not was").join(bound, ["table_name", "binding"]).select("table_name", F.col("_property").alias("property"), "binding", "xsd", "at", "comes")
    moves = written(moves.unionByName(other), "property-moves").join(tables.select("table_name", "mapping_id", "class"), "table_name")
    gone = F.max(F.when(~F.col("comes"), F.col("at"))).over(W.partitionBy("table_name", "property"))
    since = moves.withColumn("gone", gone).where(F.col("comes") & (F.col("gone").isNull() | (F.col("at") > F.col("gone"))))
    first = F.min(F.struct("at", "binding", "xsd"))
    mapping = since.groupBy("mapping_id", "property").agg(first.alias("f")).select("mapping_id", "property", "f.binding", "f.xsd")
    was = moves.withColumn("was", F.coalesce(F.lag("comes").over(line), F.lit(False)))
    ontology = was.groupBy("property").agg(F.min(F.when(F.col("comes"), F.struct("at", "table_name", "class", "xsd"))).alias("f"), F.max(~F.col("comes") & F.col("was")).alias("deprecated"))
    ontology = ontology.where("f is not null").select("property", F.col("f.class").alias("domain"), F.col("f.xsd").alias("range"), label(F.col("property")).alias("label"), "deprecated")
    return Layers(federation, projection, mapping, ontology)
