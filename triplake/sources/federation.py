"""Reading the source tables, presenting them as one catalog, and writing."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplake.schemas import BLANK_PADDED, FEDERATED, federated


def jdbc_options(url: str, table: str, user: str, password: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, fetch: int = 10_000) -> dict[str, str]:
    """Reader options; a numeric column with its bounds splits the read."""
    found = {"url": url, "dbtable": table, "user": user, "password": password, "fetchsize": str(fetch)}
    if column and bounds:
        found |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return found


def string_ranges(column: str, cuts: Sequence[str]) -> list[str]:
    """Predicates that split a table by ranges of a string key; together they cover every row, nulls included, once."""
    quoted = ["'" + c.replace("'", "''") + "'" for c in cuts]
    if not quoted:
        return ["1 = 1"]
    inner = [f"{column} >= {a} and {column} < {b}" for a, b in zip(quoted, quoted[1:], strict=False)]
    return [f"{column} < {quoted[0]} or {column} is null", *inner, f"{column} >= {quoted[-1]}"]


def balanced_ranges(sample: Sequence[tuple], parts: int, key: str, second: str | None = None) -> list[str]:
    """Predicates that split a table into about equally many rows each, by a sample of (key, second key); all rows once, nulls included.

    Cuts are the sample's quantiles, of numbers or texts. A value that fills more than one part has parts of its own, cut by the second key.
    """
    keys = sorted(k for k, _ in sample if k is not None)
    if not keys or parts < 2:
        return ["1 = 1"]
    each = len(keys) / parts
    hot = sorted(v for v, n in Counter(keys).items() if n > each) if second else []
    rest = [k for k in keys if k not in set(hot)]
    n_rest = max(1, round(len(rest) / each))
    cuts = sorted({rest[len(rest) * i // n_rest] for i in range(1, n_rest)}) if rest else []
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    apart = "".join(f" and {key} <> {literal(v)}" for v in hot)
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        tests = [f"{key} >= {literal(low)}"] * (low is not None) + [f"{key} < {literal(high)}"] * (high is not None)
        test = " and ".join(tests) or f"{key} is not null"
        out.append(f"({test}{apart})" + (f" or {key} is null" if low is None else ""))
    for v in hot:
        own = [(s, None) for k, s in sample if k == v]
        out += [f"{key} = {literal(v)} and ({p})" for p in balanced_ranges(own, max(2, round(len(own) / each)), second)]
    return out


def sampled_keys(spark: SparkSession, options: dict[str, str], table: str, key: str, second: str | None = None, rows: int = 20_000) -> list[tuple]:
    """About `rows` pairs of key and second key of a database table: the database sends two columns, of which Spark keeps a share."""
    columns = [key] + ([second] if second else [])
    source = options | {"dbtable": f"(select {', '.join(columns)} from {table}) t"}
    df = spark.read.format("jdbc").options(**source).load()
    total = spark.read.format("jdbc").options(**(options | {"dbtable": f"(select count(*) as n from {table}) t"})).load().first()[0]
    found = df.sample(min(1.0, rows / total), seed=7).collect() if total else []
    return [(r[0], r[1] if second else None) for r in found]


def read_source(spark: SparkSession, table: str, path: str | None = None, options: dict[str, str] | None = None, predicates: list[str] | None = None) -> DataFrame:
    """A source table from parquet, or from a database by JDBC options, split by a numeric column or by predicates."""
    if path:
        df = spark.read.parquet(path)
    elif predicates:
        rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        df = spark.read.jdbc(options["url"], table, predicates=predicates, properties=rest)
    else:
        df = spark.read.format("jdbc").options(**options).load()
    return df.select(*[F.rtrim(c).alias(c) if c in BLANK_PADDED else F.col(c) for c in df.columns])


def declared(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order, cast to their declared types; columns that df lacks are null, others are hidden."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def register_catalog(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All federated tables as temp views `model_table`; returns them by table name."""
    out = {}
    for model, names in FEDERATED.items():
        for name in names:
            if name in tables:
                out[name] = declared(tables[name], federated(name))
                out[name].createOrReplaceTempView(f"{model}_{name}")
    return out


def topic_options(servers: str, topics: Sequence[str], limit: int = 100_000, **more: str) -> dict[str, str]:
    """Reader options for topics: from the earliest offset at first, from the checkpoint's position later, at most `limit` messages in a micro-batch.

    Names with an underscore for each dot are handed on to the client, such as kafka_group_id or kafka_security_protocol.
    """
    own = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest", "failOnDataLoss": "true", "maxOffsetsPerTrigger": str(limit)}
    return own | {k.replace("kafka_", "kafka.", 1).replace("_", ".") if k.startswith("kafka_") else k: v for k, v in more.items()}


#: Bytes of files that make one micro-batch of a stream: what its tasks hold at a time follows from it, not from what waits.
MICRO_BATCH = 256 << 20


def change_stream(spark: SparkSession, options: dict[str, str] | None = None, folder: str | None = None, files: int | None = None, size: int = MICRO_BATCH) -> DataFrame:
    """Messages as (topic, value): from topics by topic_options, or from a folder of JSON lines. A micro-batch has so many files at most or, without that number, files of so many bytes together."""
    if folder:
        limit = ("maxBytesPerTrigger", size) if files is None else ("maxFilesPerTrigger", files)
        return spark.readStream.option(*limit).text(folder).select(F.lit("file").alias("topic"), F.col("value"))
    return spark.readStream.format("kafka").options(**options).load().select("topic", F.col("value").cast("string").alias("value"))


def fingerprint(df: DataFrame) -> str:
    """A digest of a bag of rows that no order changes: their number and two sums of 64-bit hashes of whole rows, nulls told apart. One aggregate."""
    cells = [F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in df.columns]), *[F.col(f"`{c}`") for c in df.columns]]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")), F.lit(0)).cast("string")
    n, a, b = df.select(F.count(F.lit(1)), total(17), total(71)).first()
    return f"{df.schema.simpleString()} {n} {a} {b}"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def claimed(spark: SparkSession, path: str) -> bool:
    """Creates an empty file, which of several writers only one can: by the store's exclusive create, on a local disk the operating system's."""
    file, files = _files(spark, path)
    files.mkdirs(file.getParent())
    try:
        if files.getScheme() == "file":
            spark._jvm.java.nio.file.Files.createFile(spark._jvm.java.nio.file.Path.of(file.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)), spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            files.create(file, False).close()
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def _told(spark: SparkSession, path: str, manifest: dict | None = None) -> dict | None:
    """A folder's manifest, read, or written as its last file; None if there is none."""
    file, files = _files(spark, f"{path}/_manifest.json")
    if manifest is not None:
        out = files.create(file, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return manifest
    if not files.exists(file):
        return None
    reader = files.open(file)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(reader, "UTF-8")
    reader.close()
    return json.loads(text)


def append_events(events: DataFrame, path: str, batch: str | None = None) -> bool:
    """Appends log events as the batch of that name, partitioned by date; a batch that is there as a whole isn't written again.

    A batch that was cut off has no manifest and is replaced. Without a name the rows' fingerprint is one, so a retry of the same rows
    changes nothing either. Returns whether it wrote.
    """
    spark, mark = events.sparkSession, fingerprint(events)
    folder = f"{path}/batch={batch or hashlib.sha256(mark.encode()).hexdigest()[:24]}"
    told = _told(spark, folder)
    if told:
        if told["rows"] != mark:
            raise ValueError(f"{folder} holds other rows")
        return False
    events.withColumn("day", F.to_date("captured_at")).write.mode("overwrite").partitionBy("day").parquet(folder)
    _told(spark, folder, {"rows": mark})
    return True


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of the batches that were written to the end, with their day."""
    _, files = _files(spark, path)
    whole = [str(f.getPath()) for f in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")) if _told(spark, str(f.getPath()))]
    return spark.read.option("basePath", path).parquet(*whole).drop("batch")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a registry table in order, from their manifests; a save that failed has none."""
    folder, files = _files(spark, path)
    if not files.exists(folder):
        return []
    found = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().removeprefix("version=")) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_manifest.json")))


def save_if_changed(new: DataFrame, path: str) -> int | None:
    """Writes a new version of a registry table if it differs from the last as a bag of rows; earlier versions stay.

    The last version's fingerprint is in its manifest, so an unchanged save costs one aggregate over the new rows. Several writers
    may save at once: each claims a number by creating a file that only one can create, and a version counts when its manifest, written last, is
    there. Returns the version written, or None. The number of a save that failed isn't used again.
    """
    spark, mark = new.sparkSession, fingerprint(new)
    have = versions(spark, path)
    if have and _told(spark, f"{path}/version={have[-1]}")["rows"] == mark:
        return None
    number = have[-1] + 1 if have else 1
    while not claimed(spark, f"{path}/_claims/{number}") or _files(spark, f"{path}/version={number}")[1].exists(_files(spark, f"{path}/version={number}")[0]):
        number += 1
    new.write.parquet(f"{path}/version={number}")
    _told(spark, f"{path}/version={number}", {"rows": mark})
    return number


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a registry table, the last by default."""
    return spark.read.parquet(f"{path}/version={version if version is not None else versions(spark, path)[-1]}")
