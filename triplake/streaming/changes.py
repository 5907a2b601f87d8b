"""Change events from batch or stream (K1-K5, K8-K11): decode, unwrap, filter, parse, enrich, plan.

Every function takes and returns a DataFrame and works the same on a streaming one.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from triplake.operators.ddl_events import matched, parsed

_EVENT = "id username db_name schema_name table_name alter_type column_name ddl_command is_regulated captured_at".split()

# The repair rules, and what each monitored table is mapped to.
RULES = (
    ("ADD COLUMN", "P-001", "add_property", "add_datatype_property", "add_column", "AUTOMATIC", "HIGH"),
    ("DROP COLUMN", "P-002", "remove_property", "deprecate_property", "drop_column", "AUTOMATIC", "HIGH"),
    ("RENAME COLUMN", "P-003", "alias_column", None, "rename_column", "AUTOMATIC", "LOW"),
)
TABLES = (
    ("master_penduduk", "MAP-PENDUDUK", "Penduduk", "dukcapil"),
    ("master_keluarga", "MAP-KELUARGA", "KeluargaKependudukan", "dukcapil"),
    ("master_wilayah", "MAP-WILAYAH", "Wilayah", "dukcapil"),
    ("penerima_manfaat", "MAP-PENERIMA", "PenerimaBansos", "kemensos"),
    ("program_bansos", "MAP-PROGRAM", "ProgramBansos", "kemensos"),
    ("transaksi_bansos", "MAP-TRANSAKSI", "TransaksiBansos", "kemensos"),
    ("eligibility_check", "MAP-ELIGIBILITY", "EligibilityCheck", "kemensos"),
)


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "alter_type string, pattern_id string, mapping_action string, ontology_action string, federation_action string, auto_mode string, semantic_impact string")


def table_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLES, "table_name string, mapping_id string, class string, model string")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer doesn't copy it into every later use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


@F.pandas_udf(T.StringType())
def _last_of_repeated_keys(values: pd.Series) -> pd.Series:
    """Objects that a VARIANT refuses, for a key that is repeated (the last counts) or a number such as NaN (null), as plain JSON; null for what is no JSON."""

    def plain(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text, parse_constant=lambda _: None))
        except (ValueError, RecursionError):
            return None

    return values.map(plain)


def _parsed_messages(messages: DataFrame) -> DataFrame:
    """messages with m, the parsed object, a VARIANT, or null. Only what is refused at first is read again, in Python."""
    value = F.col("value").cast("string")
    is_object = F.coalesce(value.rlike(r"^\s*\{"), F.lit(False))
    read = _once(messages, "_m", F.when(is_object, F.try_parse_json(value)))
    again = F.try_parse_json(_last_of_repeated_keys(F.when(is_object & F.col("_m").isNull(), value)))
    return _once(read, "m", F.coalesce("_m", again)).drop("_m")


def decoded(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K1: messages(value) with the parsed message m, a VARIANT, and the malformed ones. A value that is no object counts as malformed; of a key's repeats the last counts."""
    read = _parsed_messages(messages)
    return read.where("m is not null"), read.where("m is null").drop("m")


def unwrapped(messages: DataFrame) -> DataFrame:
    """K2: the event's fields and op. The payload if there is one, else the message; its `after` if the key is there, else itself.

    A key that is there with a JSON null gives a variant null, one that isn't gives none.
    """
    under = lambda v, key: F.coalesce(F.try_variant_get(v, f"$.{key}", "variant"), F.col(v))
    text = lambda v, key: F.try_variant_get(v, f"$.{key}", "string")
    record = _once(messages, "_record", under("m", "payload"))
    event = _once(record, "_event", under("_record", "after"))
    own = [c for c in messages.columns if c not in ("m", "value")]
    fields = [text("_event", n).alias(n) for n in _EVENT if n not in ("db_name", "schema_name")]
    db = F.coalesce(text("_event", "db_name"), text("_event", "schema_name")).alias("db_name")
    return event.select(*own, F.coalesce(text("_record", "op"), F.lit("c")).alias("op"), F.is_variant_null("_event").alias("_null"), *fields, db)


def live(events: DataFrame) -> DataFrame:
    """K3: without deletes and events whose `after` is null."""
    return events.where((F.col("op") != "d") & ~F.col("_null")).drop("_null")


def truthy(flag: str = "is_regulated"):
    """K4: a flag sent as number, boolean or not at all."""
    text = F.lower(F.trim(flag))
    return F.coalesce((text == "true") | (F.coalesce(F.expr(f"try_cast(trim({flag}) as double)"), F.lit(0.0)) != 0), F.lit(False))


def actionable(events: DataFrame) -> DataFrame:
    """K4, K5: regulated events that carry DDL."""
    return events.where(truthy()).where(F.length("ddl_command") > 0)


def enriched(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K6-K9: parsed events with their rule and metadata, and those whose table has no mapping. The lookups are 3 and 7 rows."""
    spark = events.sparkSession
    own = events.drop("table_name", "alter_type", "column_name")
    told = parsed(own).withColumnsRenamed({"parsed_type": "alter_type", "parsed_table": "table_name", "parsed_column": "column_name"})
    met = told.join(F.broadcast(rules(spark)), "alter_type").join(F.broadcast(table_metadata(spark)), "table_name", "left")
    return met.where("mapping_id is not null"), met.where("mapping_id is null").drop("mapping_id", "class", "model")


def plan(events: DataFrame) -> DataFrame:
    """Which layers an event changes and what must be reloaded: all, graph or none."""
    changes = lambda action: F.col(action).isNotNull()
    out = events.withColumn("mapping_changed", changes("mapping_action")).withColumn("ontology_changed", changes("ontology_action"))
    out = out.withColumn("federation_changed", changes("federation_action") & F.col("model").isNotNull())
    scope = F.when(F.col("federation_changed"), "all").when(F.col("mapping_changed") | F.col("ontology_changed"), "graph").otherwise("none")
    return out.withColumn("reload_scope", scope)


def processed(messages: DataFrame) -> DataFrame:
    """messages(value) to planned events."""
    good, _ = decoded(messages)
    return plan(enriched(actionable(live(unwrapped(good))))[0])


PLANNED, SKIPPED, FILTERED, MALFORMED, REPEATED = "planned", "skipped", "filtered", "malformed", "repeated"
#: Seen ids are dealt over so many stripes of each topic.
STRIPES = 64


def tracked(messages: DataFrame) -> DataFrame:
    """K1-K10 without loss: every message with its `outcome` and `reason`, the planned ones with their plan, from one read.

    filtered: deletes, events without a record, not regulated, without or with an unknown statement; skipped: tables without a mapping.
    """
    spark = messages.sparkSession
    read = _parsed_messages(messages).withColumn("message", F.col("value").cast("string")).withColumn("_good", F.col("m").isNotNull())
    told = matched(unwrapped(read).drop("table_name", "alter_type", "column_name"))
    told = told.withColumnsRenamed({"parsed_type": "alter_type", "parsed_table": "table_name", "parsed_column": "column_name"})
    met = told.join(F.broadcast(rules(spark)), "alter_type", "left").join(F.broadcast(table_metadata(spark)), "table_name", "left")
    cases = [
        (~F.col("_good"), MALFORMED, "no object"), (F.col("op") == "d", FILTERED, "delete"), (F.coalesce("_null", F.lit(False)), FILTERED, "no record"), (~truthy(), FILTERED, "not regulated"),
        (F.coalesce(F.length("ddl_command"), F.lit(0)) == 0, FILTERED, "no statement"), (F.col("alter_type").isNull(), FILTERED, "unknown statement"), (F.col("mapping_id").isNull(), SKIPPED, "no mapping"),
    ]
    said = reduce(lambda rest, c: F.when(c[0], F.struct(F.lit(c[1]).alias("outcome"), F.lit(c[2]).alias("reason"))).otherwise(rest), reversed(cases), F.struct(F.lit(PLANNED).alias("outcome"), F.lit(None).cast("string").alias("reason")))
    return plan(_once(met, "_said", said)).select("*", "_said.*").drop("_said", "_good", "_null")


def number(id_text: str = "id") -> Column:
    """An event's id as a number, null where it is none."""
    return F.expr(f"try_cast({id_text} as bigint)")


class Intervals:
    """A set of numbers as sorted runs [low, high], so that a set without gaps is one run however many numbers it has."""

    def __init__(self, lows: list[int], highs: list[int]):
        self.lows, self.highs = lows, highs

    def add(self, x: int) -> bool:
        """Whether x is new."""
        i = bisect_right(self.lows, x) - 1
        if i >= 0 and x <= self.highs[i]:
            return False
        left = i >= 0 and self.highs[i] == x - 1
        right = i + 1 < len(self.lows) and self.lows[i + 1] == x + 1
        if left and right:
            self.highs[i] = self.highs[i + 1]
            del self.lows[i + 1], self.highs[i + 1]
        elif left:
            self.highs[i] = x
        elif right:
            self.lows[i + 1] = x
        else:
            self.lows.insert(i + 1, x)
            self.highs.insert(i + 1, x)
        return True


_SEEN = T.StructType([T.StructField("lows", T.ArrayType(T.LongType())), T.StructField("highs", T.ArrayType(T.LongType()))])


def marked_repeats(events: DataFrame) -> DataFrame:
    """K11 in a stream: planned events of a topic whose id was seen before get the outcome `repeated`; all rows go on.

    Seen ids are state for ever, as runs of numbers: its size is that of the gaps, not of the log. A topic's ids are dealt over STRIPES by
    their remainder, so that neighbouring ids meet in different tasks and a run without gaps stays one in each. Events without a
    number as id can't be told apart and count as new: their statements act on the state as often as they come, in order.
    """

    def own(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = Intervals(*[list(x) for x in state.get]) if state.exists else Intervals([], [])
        for pdf in batches:
            again = [r == PLANNED and n == n and n is not None and not seen.add(int(n) // STRIPES) for r, n in zip(pdf["outcome"], pdf["_n"], strict=True)]
            yield pdf.assign(outcome=[REPEATED if a else o for a, o in zip(again, pdf["outcome"], strict=True)]).drop(columns=["_n", "_stripe", "_topic"])
        if seen.lows:
            state.update((seen.lows, seen.highs))

    n = number()
    spread = F.when((F.col("outcome") == PLANNED) & n.isNotNull(), F.pmod(n, F.lit(STRIPES))).otherwise(-1 - F.pmod(F.xxhash64("message"), F.lit(STRIPES)))
    topic = F.col("topic") if "topic" in events.columns else F.lit("")
    # text keeps the remainder's rows exact in pandas
    ready = events.withColumn("_n", n.cast("string")).withColumn("_stripe", spread.cast("int")).withColumn("_topic", F.coalesce(topic, F.lit("")))
    return ready.groupBy("_topic", "_stripe").applyInPandasWithState(own, events.schema, _SEEN, "append", "NoTimeout")


def once_each(planned: DataFrame) -> DataFrame:
    """K11 in batch: each event of a topic once, by its id; events without one are all kept."""
    key = [*(["topic"] if "topic" in planned.columns else []), "id"]
    return planned.where("id is not null").dropDuplicates(key).unionByName(planned.where("id is null"))


def into(path: str) -> Callable[[DataFrame, int], None]:
    """An idempotent sink of every message: a folder for each micro-batch with one part for each outcome, and a manifest that is written last.

    A micro-batch that runs again replaces its folder and its manifest; one without a manifest isn't read. The manifest has the number of
    messages received, counted on the way, and of each outcome, counted in what was written.
    """

    def write(df: DataFrame, epoch: int) -> None:
        spark, folder = df.sparkSession, f"{path}/epoch={epoch}"
        received = Observation()
        df.observe(received, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("outcome").parquet(folder)
        counts = outcomes_of(spark, df.schema, folder).groupBy("outcome").count()
        told = counts.groupBy().pivot("outcome", [PLANNED, SKIPPED, FILTERED, MALFORMED, REPEATED]).agg(F.sum("count")).na.fill(0)
        told.select(F.lit(epoch).cast("long").alias("epoch"), F.lit(received.get["n"]).alias("received"), "*").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/of={epoch}")

    return write


def outcomes_of(spark: SparkSession, schema: T.StructType, folder: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """epoch, received, and the number of messages of each outcome, of the micro-batches that were written to the end."""
    return spark.read.parquet(f"{path}/manifest").drop("of")


def written_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the micro-batches that have a manifest."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/epoch=*")
    return rows.join(manifests(spark, path).select("epoch"), "epoch", "left_semi")


def run_stream(messages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Processes all waiting messages of a stream, at least once; with an idempotent sink such as `into`, exactly once."""
    return marked_repeats(tracked(messages)).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
