"""DDL events, catalog diff, evolution and streams on small inputs."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from triplake.functions import scalars
from triplake.operators import catalog_diff, ddl_events, evolve, fold
from triplake.streaming import changes

DDL = [
    ("ALTER TABLE `d`.`t` ADD COLUMN `email` VARCHAR(100)", ("ADD COLUMN", "t", "email", "VARCHAR(100)", None, None)),
    ("ALTER TABLE `d`.`t` DROP COLUMN `x`", ("DROP COLUMN", "t", "x", None, None, None)),
    ("ALTER TABLE `d`.`t` RENAME COLUMN `a` TO `b`", ("RENAME COLUMN", "t", None, None, "a", "b")),
    ("ALTER TABLE public.t ADD COLUMN email varchar(100)", ("ADD COLUMN", "t", "email", "varchar(100)", None, None)),
    ("alter  table public.t\n add column a int NOT NULL;", ("ADD COLUMN", "t", "a", "int NOT NULL;", None, None)),
    ("ALTER TABLE public.t DROP COLUMN aktif;", ("DROP COLUMN", "t", "aktif;", None, None, None)),
    ("ALTER TABLE t ADD COLUMN IF NOT EXISTS email varchar(9)", ("ADD COLUMN", "t", "IF", "NOT EXISTS email varchar(9)", None, None)),
    ("ALTER TABLE t ADD COLUMN a int, ADD COLUMN b int", ("ADD COLUMN", "t", "a", "int, ADD COLUMN b int", None, None)),
    ("ALTER TABLE IF EXISTS t ADD COLUMN a int", None),
    ("ALTER TABLE t ADD a int", None),
    ("", None),
    (None, None),
]


def test_ddl_parse(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DDL)], "id int, ddl_command string")
    got = {r.id: (r.parsed_type, r.parsed_table, r.parsed_column, r.column_type, r.old_column, r.new_column) for r in ddl_events.parsed(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(DDL) if want}


def test_command_capture(spark):
    rows = [("ALTER TABLE", "public.t", "ALTER TABLE t  RENAME COLUMN a TO b"), ("ALTER TABLE", "public.t", "alter table t add column a int"), ("CREATE TABLE", "public.t", "ADD COLUMN"), ("ALTER TABLE", "public.t", "ADD CONSTRAINT x"), ("ALTER TABLE", "public.t", None)]
    out = ddl_events.from_commands(spark.createDataFrame(rows, "command_tag string, object_identity string, ddl_command string")).collect()
    assert [(r.alter_type, r.table_name, r.column_name) for r in out] == [("RENAME COLUMN", "t", "a"), ("ADD COLUMN", "t", "")]


def test_manual_capture(spark):
    df = spark.createDataFrame([(" add column ",), ("ADD KEY",), (None,)], "alter_type string")
    good, bad = ddl_events.manual(df)
    assert [r[0] for r in good.collect()] == ["ADD COLUMN"] and bad.count() == 2
    with pytest.raises(Exception, match="unknown alter type"):
        ddl_events.manual(df, strict=True)[0].collect()


def test_scalars(spark):
    df = spark.createDataFrame([("VARCHAR(100)", "tanggal_lahir"), ("int NOT NULL", "nik"), ("decimal(3,2)", "kode_pos"), (None, "A_b_C")], "t string, c string")
    out = df.select(scalars.xsd_type(F.col("t")), scalars.federation_type(F.col("t")), scalars.xsd_type(F.col("t"), lenient=True), scalars.property_name(F.col("c")), scalars.label(scalars.property_name(F.col("c")))).collect()
    assert [tuple(r) for r in out] == [
        ("xsd:string", "string", "xsd:string", "tanggalLahir", "Tanggal Lahir"), ("xsd:string", "string", "xsd:integer", "nik", "Nik"),
        ("xsd:decimal", "bigdecimal", "xsd:decimal", "kodePos", "Kode Pos"), ("xsd:string", "string", "xsd:string", "aBC", "A Bc"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_diff_leads_to_the_new_catalog(spark, seed):
    rng = random.Random(seed)
    old = {(f"t{rng.randrange(4)}", f"c{i}"): (rng.choice(["int", "text", None]), rng.randrange(1, 6)) for i in range(30)}
    new = {k: v for k, v in old.items() if rng.random() < 0.7}
    new |= {(f"t{rng.randrange(4)}", f"n{i}"): (rng.choice(["int", "text"]), rng.randrange(1, 6)) for i in range(12)}
    schema = "db_name string, table_name string, column_name string, column_type string, ordinal_pos int"
    frame = lambda d: spark.createDataFrame([("d", t, c, k, o) for (t, c), (k, o) in d.items()], schema)
    refs = spark.createDataFrame([("d", f"t{i}", True) for i in range(4)] + [("d", "t0", True), ("d", "t9", False)], "db_name string, table_name string, is_active boolean")
    out = catalog_diff.diff(frame(old), frame(new), refs)
    assert {(r.table_name, r.column_name) for r in out.snapshot.collect()} == set(new)
    gone, fresh, pairs = out.gone.collect(), out.new.collect(), out.renamed.collect()
    drops, adds = catalog_diff.pure_drops(out.gone, out.new).count(), catalog_diff.pure_adds(out.gone, out.new).count()
    assert len({(p.table_name, p.old_column) for p in pairs}) + drops == len(gone) and len({(p.table_name, p.new_column) for p in pairs}) + adds == len(fresh)
    assert out.events.count() == len(pairs) + drops + adds
    kept = {(r.table_name, r.column_name): (r.column_type, r.ordinal_pos) for r in out.snapshot.collect()}
    assert all(kept[k] == old[k] for k in old if k in new)


def events(spark, rows):
    schema = "alter_type string, model string, table_name string, mapping_id string, class string, column_name string, column_type string, old_column string, new_column string"
    return spark.createDataFrame([(k, "m", "t", "M", "T", *r) for k, *r in rows], schema)


def test_evolution(spark):
    fed = spark.createDataFrame([("m", "t", 1, "nik", "string"), ("m", "t", 2, "nama", "string"), ("m", "t", 3, "status", "string")], "model string, table_name string, ordinal int, name string, type string")
    source = spark.createDataFrame([("M", i, c, c) for i, c in enumerate(("nik", "nama", "status"), 1)], "mapping_id string, ordinal int, physical string, logical string")
    target = spark.createDataFrame([("M", "nik", "nik", "xsd:string"), ("M", "namaPenduduk", "nama", "xsd:string"), ("M", "status", "status", "xsd:string")], "mapping_id string, property string, binding string, xsd string")
    onto = spark.createDataFrame([("namaPenduduk", "T", "xsd:string", "Nama", False)], "property string, domain string, range string, label string, deprecated boolean")
    add = events(spark, [("ADD COLUMN", "kode_pos", "VARCHAR(10)", None, None), ("ADD COLUMN", "nama", "text", None, None), ("ADD COLUMN", "date", "date", None, None)])
    assert [(r.ordinal, r.name, r.type) for r in evolve.add_federated(fed, add).orderBy("ordinal").collect()][3:] == [(4, "date", "date"), (5, "kode_pos", "string")]
    assert {(r.property, r.binding) for r in evolve.add_mapping_target(target, add).collect()} >= {("kodePos", "kode_pos"), ("nama", "nama")}
    assert evolve.add_mapping_source(source, add).count() == 5
    assert {r.property: r.label for r in evolve.add_ontology(onto, add).collect()}["kodePos"] == "Kode Pos"
    # a second rename keeps the name that consumers see; a drop after a rename finds the property
    once = evolve.rename_source(source, events(spark, [("RENAME COLUMN", None, None, "nama", "nama2")]))
    twice = evolve.rename_source(once, events(spark, [("RENAME COLUMN", None, None, "nama2", "nama3")]))
    assert evolve.projection(twice, "M") == [("nik", "nik"), ("nama3", "nama"), ("status", "status")]
    drop = events(spark, [("DROP COLUMN", "nama3", None, None, None)])
    assert [tuple(r) for r in evolve.dropped_properties(target, twice, drop).collect()] == [("M", "namaPenduduk")]
    assert evolve.deprecate(onto, evolve.dropped_properties(target, twice, drop)).first().deprecated
    left = evolve.drop_mapping_source(twice, drop)
    assert [tuple(r) for r in evolve.violations(target, left).collect()] == [("M", "namaPenduduk", "nama")]
    assert evolve.violations(evolve.drop_mapping_target(target, twice, drop), left).count() == 0
    old, new = spark.createDataFrame([("1", "a", "x")], "nik string, nama string, status string"), spark.createDataFrame([("2", "b")], "nik string, nama3 string")
    pairs = evolve.projection(twice, "M")
    both = evolve.through(old, pairs).unionByName(evolve.through(new, pairs)).orderBy("nik").collect()
    assert [tuple(r) for r in both] == [("1", "a", "x"), ("2", "b", None)]
    assert evolve.placeholder(old).columns == old.columns and evolve.placeholder(old).count() == 0
    templates = spark.createDataFrame([("M", "nama3")], "mapping_id string, column_name string")
    assert evolve.unsafe_drops(drop, templates).count() == 1


MESSAGES = [
    {"payload": {"before": None, "after": {"id": 1, "ddl_command": "ALTER TABLE x.master_wilayah ADD COLUMN kode_pos varchar(9)", "is_regulated": 1}, "op": "c"}},
    {"before": None, "after": {"id": 2, "ddl_command": "ALTER TABLE x.master_wilayah RENAME COLUMN kode_pos TO pos", "is_regulated": True}, "op": "r"},
    {"id": 3, "ddl_command": "ALTER TABLE x.master_penduduk DROP COLUMN nama", "is_regulated": 1},
    {"after": {"id": 4, "ddl_command": "ALTER TABLE x.master_wilayah DROP COLUMN pos", "is_regulated": 1}, "op": "d"},
    {"after": None, "op": "c"},
    {"id": 5, "ddl_command": "ALTER TABLE x.master_wilayah DROP COLUMN pos", "is_regulated": 0},
    {"id": 6, "ddl_command": "ALTER TABLE x.master_wilayah DROP COLUMN pos"},
    {"id": 7, "is_regulated": 1},
    {"id": 8, "ddl_command": "ALTER TABLE x.riwayat DROP COLUMN pos", "is_regulated": 1},
    [1, 2],
]


def message_frame(spark):
    return spark.createDataFrame([("log", json.dumps(m)) for m in MESSAGES] + [("log", "{bad"), ("log", None)], "topic string, value string")


def test_batch_plan(spark):
    out = {int(r.id): r for r in changes.processed(message_frame(spark)).collect()}
    assert set(out) == {1, 2, 3}
    assert (out[1].pattern_id, out[2].pattern_id, out[3].pattern_id) == ("P-001", "P-002".replace("2", "3"), "P-002")
    assert out[2].ontology_changed is False and all(r.reload_scope == "all" for r in out.values())
    assert changes.decoded(message_frame(spark))[1].count() == 3
    skipped = changes.enriched(changes.actionable(changes.live(changes.unwrapped(changes.decoded(message_frame(spark))[0]))))[1]
    assert [r.table_name for r in skipped.collect()] == ["riwayat"]


def test_stream_equals_batch(spark, tmp_path):
    message_frame(spark).select("value").where("value is not null").coalesce(1).write.text(str(tmp_path / "in"))
    from triplake.sources.federation import change_stream

    def sink(df, epoch):
        df.where("outcome = 'planned'").select("id", "pattern_id", "reload_scope").write.mode("append").parquet(str(tmp_path / "out"))

    for _ in range(2):  # a restart from the checkpoint repeats nothing
        changes.run_stream(change_stream(spark, folder=str(tmp_path / "in")), sink, str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r.id, r.pattern_id, r.reload_scope) for r in changes.processed(message_frame(spark)).collect())


LOG = [(1, "ADD COLUMN", "a", "int", None, None), (2, "ADD COLUMN", "b", "text", None, None), (3, "RENAME COLUMN", None, None, "a", "c"), (4, "DROP COLUMN", "b", None, None, None), (5, "RENAME COLUMN", None, None, "c", "d")]
LOG_SCHEMA = "id long, alter_type string, column_name string, column_type string, old_column string, new_column string, table_name string"


def test_fold(spark):
    df = spark.createDataFrame([(*r, "t") for r in LOG] + [(9, *LOG[0][1:], "u")], LOG_SCHEMA)
    want = {("t", 1, "d", "a", True), ("t", 2, "b", "b", False), ("u", 1, "a", "a", True)}
    for frame in (df, df.unionByName(df).repartition(3)):
        out = fold.fold(frame).collect()
        assert {(r.table_name, r.ordinal, r.physical, r.logical, r.active) for r in out} == want
        assert {r.n_applied for r in out if r.table_name == "t"} == {5}


def test_stream_fold(spark, tmp_path):
    src = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame([(*r, "t") for r in rows], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    seen = []

    def run():
        stream = evolve.fold_stream(spark.readStream.schema(LOG_SCHEMA).parquet(src))
        stream.writeStream.outputMode("append").foreachBatch(lambda d, e: seen.append(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return seen[-1]

    write([LOG[0], LOG[1], LOG[3]])
    run()
    write([LOG[0], LOG[4]])  # a repeat and the next
    assert {r.n_applied for r in run()} == {4}
    write([LOG[2]])  # late
    assert [(r.ordinal, r.last_id) for r in run() if r.ordinal < 0] == [(-1, 3)]
    n = len(seen)
    write([LOG[0], LOG[1]])  # repeats of any age tell nothing
    run()
    assert not [r for rows in seen[n:] for r in rows]


def replayed(rows):
    """The fold by its definition: every event in id order on a table's list of columns."""
    tables, last, applied = {}, {}, {}
    for e in sorted(set(rows)):
        number, kind, name, sql_type, old, new, table = e
        columns = tables.setdefault(table, [])
        last[table], applied[table] = number, applied.get(table, 0) + 1
        live = {c[0]: c for c in columns if c[3]}
        if kind == "ADD COLUMN" and name not in live:
            columns.append([name, name, sql_type, True])
        elif kind == "DROP COLUMN" and name in live:
            live[name][3] = False
        elif kind == "RENAME COLUMN" and old in live and new not in live:
            live[old][0] = new
    return {(t, i, *c, last[t], applied[t]) for t, columns in tables.items() for i, c in enumerate(columns, 1)}


def random_log(rng, n):
    out = []
    for i in range(n):
        group = rng.randrange(5)  # names of different groups never meet
        name = lambda: f"g{group}c{rng.randrange(4)}"  # noqa: B023,E731
        kind = rng.choice(["ADD COLUMN", "DROP COLUMN", "RENAME COLUMN"])
        pair = (None, None, name(), name()) if kind == "RENAME COLUMN" else (name(), "int" if kind == "ADD COLUMN" else None, None, None)
        out.append((i, kind, *pair, f"t{rng.randrange(3)}"))
    return out


@pytest.mark.parametrize("segment", [1000, 100, 9])
def test_fold_against_a_replay(spark, segment):
    rows = random_log(random.Random(segment), 200)
    df = spark.createDataFrame(rows + rows[::7], LOG_SCHEMA).repartition(3)
    assert {tuple(r) for r in fold.fold(df, segment).collect()} == replayed(rows)


def test_fold_of_one_table_in_many_tasks(spark):
    """One table has all events and renames connect all its names: no segment holds more than its share."""
    rng, rows = random.Random(5), []
    for i in range(400):
        a, b = (f"c{rng.randrange(12)}" for _ in range(2))
        rows.append([(i, "ADD COLUMN", a, "int", None, None, "t"), (i, "DROP COLUMN", a, None, None, None, "t"), (i, "RENAME COLUMN", None, None, a, b, "t")][rng.choice([0, 1, 2, 2])])
    df = spark.createDataFrame(rows, LOG_SCHEMA)
    sizes = [r["count"] for r in fold._segmented(df, 50)[0].groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 100
    assert {tuple(r) for r in fold.fold(df, 50).collect()} == replayed(rows)


def test_knowledge_of_names_is_never_wrong():
    """Whatever the unknown names are, what is said of the others holds."""
    kinds = [("ADD COLUMN", "a", None, None), ("DROP COLUMN", "b", None, None), ("RENAME COLUMN", None, "a", "b"), ("RENAME COLUMN", None, "b", "c"), ("RENAME COLUMN", None, "c", "a"), ("RENAME COLUMN", None, "a", "a"), ("ADD COLUMN", None, None, None)]
    for seed in range(200):
        rng = random.Random(seed)
        log = [rng.choice(kinds) for _ in range(rng.randrange(1, 8))]
        start = {n: rng.choice([True, False, None]) for n in "abc"}
        live, said = dict(start), []
        for e in log:
            said.append(fold.after(live, e))
        for world in range(8):
            whole = {n: bool(world >> i & 1) if start[n] is None else start[n] for i, n in enumerate("abc")}
            for e, known in zip(log, said, strict=True):
                acted = fold.after(whole, e)
                assert acted is not None and known in (None, acted)
            assert all(v in (None, whole[n]) for n, v in live.items())


def test_redelivery_after_a_restart_writes_nothing_twice(spark, tmp_path):
    from triplake.sources.federation import change_stream

    out = str(tmp_path / "out")
    for part in range(3):  # the same messages again, by another file, after a restart
        message_frame(spark).select("value").where("value is not null").coalesce(1).write.mode("append").text(str(tmp_path / "in"))
        changes.run_stream(change_stream(spark, folder=str(tmp_path / "in")), changes.into(out), str(tmp_path / "ck")).awaitTermination()
    rows = changes.written_outcomes(spark, out).collect()
    got = sorted((r.id, r.pattern_id) for r in rows if r.outcome == "planned")
    assert got == sorted((r.id, r.pattern_id) for r in changes.processed(message_frame(spark)).collect())
    # nothing is lost on the way, in any micro-batch
    told = changes.manifests(spark, out).collect()
    assert sum(r.received for r in told) == len(rows) == 3 * (len(MESSAGES) + 1)
    assert all(r.received == r.planned + r.skipped + r.filtered + r.malformed + r.repeated for r in told)
    assert {(r.reason, r.outcome) for r in rows if r.outcome in ("malformed", "skipped")} == {("no object", "malformed"), ("no mapping", "skipped")}
    assert {r.message for r in rows if r.outcome == "malformed"} == {"{bad", "[1, 2]"}


def test_a_failed_micro_batch_is_written_again_as_a_whole(spark, tmp_path):
    from triplake.sources.federation import change_stream

    message_frame(spark).select("value").where("value is not null").coalesce(1).write.text(str(tmp_path / "in"))
    out, whole, fails = str(tmp_path / "out"), changes.into(str(tmp_path / "out")), [True]

    def sink(df, epoch):
        if fails.pop() if fails else False:  # the rows are there, the manifest is not
            df.limit(2).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/epoch={epoch}")
            raise OSError("lost")
        whole(df, epoch)

    with pytest.raises(Exception, match="lost"):
        changes.run_stream(change_stream(spark, folder=str(tmp_path / "in")), sink, str(tmp_path / "ck")).awaitTermination()
    changes.run_stream(change_stream(spark, folder=str(tmp_path / "in")), sink, str(tmp_path / "ck")).awaitTermination()
    (told,) = changes.manifests(spark, out).collect()
    assert told.received == len(MESSAGES) + 1 == changes.written_outcomes(spark, out).count()


def test_repeated_keys_and_odd_numbers(spark):
    """The last of a key's repeats counts, as in a plain JSON reader; numbers that JSON lacks are null."""
    ddl = "ALTER TABLE x.master_wilayah DROP COLUMN pos"
    texts = [
        f'{{"id": 1, "id": 2, "is_regulated": 0, "is_regulated": 1, "ddl_command": "{ddl}"}}', f'{{"after": {{"id": 3, "id": 4, "ddl_command": "{ddl}", "is_regulated": true}}, "op": "d", "op": "c"}}',
        f'{{"id": 5, "x": NaN, "is_regulated": 1, "ddl_command": "{ddl}"}}', '{"id": 6, "id": }', "[NaN]",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert {r.id for r in changes.processed(df).collect()} == {"2", "4", "5"}
    assert {r.value for r in changes.decoded(df)[1].collect()} == set(texts[3:])


def test_micro_batches_are_bounded(spark, tmp_path):
    """What waits is taken in micro-batches of bounded size, with the outcomes of a single one."""
    from triplake.sources.federation import change_stream

    folder, ddl = str(tmp_path / "in"), "ALTER TABLE x.master_wilayah DROP COLUMN pos"
    for part in range(4):  # ids 0 to 79 and, from the second file on, the ten before again
        rows = [json.dumps({"id": i, "ddl_command": ddl, "is_regulated": 1}) for i in range(max(0, 20 * part - 10), 20 * part + 20)]
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)
    changes.run_stream(change_stream(spark, folder=folder, size=2000), changes.into(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    told = changes.manifests(spark, str(tmp_path / "out")).collect()
    assert len(told) > 1 and max(r.received for r in told) <= 30
    assert (sum(r.planned for r in told), sum(r.repeated for r in told)) == (80, 30)


def test_events_without_an_id_are_kept(spark, tmp_path):
    """ADD, DROP, ADD of one column, flat and without ids: the column is there at the end. Repeats with an id go."""
    from triplake.sources.federation import change_stream

    add, drop = "ALTER TABLE x.master_wilayah ADD COLUMN pos int", "ALTER TABLE x.master_wilayah DROP COLUMN pos"
    rows = [{"ddl_command": s, "is_regulated": 1} for s in (add, drop, add)] + [{"id": 7, "ddl_command": add, "is_regulated": 1}] * 2 + [{"id": "x7", "ddl_command": add, "is_regulated": 1}] * 2
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    assert changes.once_each(changes.processed(df)).count() == 5
    df.coalesce(1).write.text(str(tmp_path / "in"))
    changes.run_stream(change_stream(spark, folder=str(tmp_path / "in")), changes.into(str(tmp_path / "out")), str(tmp_path / "ck")).awaitTermination()
    found = Counter(changes.written_outcomes(spark, str(tmp_path / "out")).select("outcome").toPandas()["outcome"])
    assert found == {"planned": 6, "repeated": 1}


@pytest.mark.parametrize("seed", range(3))
def test_interval_sets(seed):
    rng = random.Random(seed)
    runs, plain = changes.Intervals([], []), set()
    for x in [rng.randrange(-40, 60) for _ in range(300)] + [2**62, 2**62 + 1]:
        assert runs.add(x) == (x not in plain)
        plain.add(x)
        starts = sorted(y for y in plain if y - 1 not in plain)
        assert runs.lows == starts and runs.highs == sorted(y for y in plain if y + 1 not in plain)
    whole = changes.Intervals([], [])
    assert all(whole.add(x) for x in rng.sample(range(5000), 5000)) and (whole.lows, whole.highs) == ([0], [4999])


def test_a_poll_that_finds_nothing_compares_no_columns(spark):
    schema = "db_name string, table_name string, column_name string, column_type string, ordinal_pos int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    old = [("d", t, c, "int", i) for t in ("a", "b", "gone", "off") for i, c in enumerate(("x", "y"), 1)]
    new = [r for r in old if r[1] != "gone" and r[:3] != ("d", "a", "y")] + [("d", "a", "z", "int", 2), ("d", "new", "x", "int", 1), ("d", "off", "q", "int", 3)]
    refs = spark.createDataFrame([("d", t, t != "off") for t in ("a", "b", "gone", "new", "off")], "db_name string, table_name string, is_active boolean")
    first = catalog_diff.poll(frame(old), catalog_diff.digests(frame(old)), frame(new), refs)
    assert {r.table_name for r in first.compared.collect()} == {"a", "gone", "new"}
    whole = catalog_diff.diff(frame(old), frame(new), refs)
    assert {tuple(r) for r in first.events.collect()} == {tuple(r) for r in whole.events.collect()} and first.events.count() == 4
    assert {tuple(r) for r in first.snapshot.collect()} == {tuple(r) for r in whole.snapshot.collect()}
    # the second poll reads no row of its snapshot, which would fail
    unread = frame(old).withColumn("column_name", F.raise_error(F.lit("read")))
    second = catalog_diff.poll(unread, first.known, frame(new), refs)
    assert second.compared.count() == 0 and second.events.count() == 0
    # a table that is monitored from now on is compared
    on = refs.withColumn("is_active", F.lit(True))
    third = catalog_diff.poll(first.snapshot, first.known, frame(new), on)
    assert {(r.table_name, r.column_name) for r in third.events.collect()} == {("off", "q")}


def test_dependents_of_dependents(spark):
    """A chain, a cycle and a diamond, and what depends on nothing dropped."""
    edges = [("m-b", "b", "a"), ("m-c", "c", "b"), ("m-d", "d", "c"), ("m-x", "x", "d"), ("m-d", "d", "x"), ("m-l", "l", "b"), ("m-r", "r", "b"), ("m-t", "t", "l"), ("m-t", "t", "r"), ("m-z", "z", "other"), ("m-z", "z", None), ("m-b", "b", "a")]
    links = spark.createDataFrame(edges, "mapping_id string, subject string, kind string")
    got = {tuple(r) for r in evolve.all_dependents(links, spark.createDataFrame([("a",), ("a",), ("d",), (None,)], "kind string")).collect()}
    assert got == {("a", "m-b", 1), ("a", "m-c", 2), ("a", "m-l", 2), ("a", "m-r", 2), ("a", "m-d", 3), ("a", "m-t", 3), ("a", "m-x", 4), ("d", "m-x", 1), ("d", "m-d", 2)}
    assert evolve.all_dependents(links, spark.createDataFrame([("nothing",)], "kind string")).count() == 0


def test_stored_properties_join_without_an_exchange(spark):
    from tests.conftest import SF
    from triplake.plans import queries

    df = queries.QUERIES["m9_stored_properties"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "Bucketed: true" in plan


def test_keyed_fold_settles_and_tells_late_ids(spark, tmp_path):
    """Events within the delay fall into place whatever their order; with no delay they settle, and an older id comes out as late."""
    from triplake.streaming import fold as keyed

    def run(name, delay, batches):
        src, seen = str(tmp_path / name), []
        with keyed.settings(spark):
            for rows in batches:  # each after a restart
                spark.createDataFrame([(*r, "t") for r in rows], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(src)
                stream = keyed.fold_keyed(spark.readStream.schema(LOG_SCHEMA).parquet(src), delay)
                stream.writeStream.outputMode("append").foreachBatch(lambda d, e: seen.append(d.collect())).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start().awaitTermination()
        return seen

    within = run("within", 600_000, [[LOG[4], LOG[1], LOG[0]], [LOG[3], LOG[0]], [LOG[2]]])
    assert {(r.ordinal, r.physical, r.logical, r.active) for r in within[-1]} == {(1, "d", "a", True), (2, "b", "b", False)} and {r.n_applied for r in within[-1]} == {5}
    settled = [r for rows in run("settled", 0, [LOG[:2], [LOG[3]], [LOG[4], LOG[2]], [(6, "ADD COLUMN", "z", "int", None, None), LOG[1]]]) for r in rows]
    assert {(-1, 2)} <= {(r.ordinal, r.last_id) for r in settled if r.ordinal < 0} <= {(-1, 2), (-1, 3)}  # 4 may have settled before 3 came
    assert "spark.sql.streaming.noDataMicroBatches.enabled" not in {k for k, _ in spark.sparkContext.getConf().getAll()}


class _State:
    """A processor's handle with states in memory that counts the calls to them."""

    def __init__(self, calls, kept=None):
        self.calls, self.kept, self.timers = calls, {} if kept is None else kept, []

    def getMapState(self, name, *_):
        return _State(self.calls, self.kept.setdefault(name, {}))

    getValueState = getMapState

    def called(self, value=None):
        self.calls.append(1)
        return value

    exists = lambda self: self.called(bool(self.kept))
    get = lambda self: self.called(self.kept["v"])
    update = lambda self, v: self.called(self.kept.update(v=v))
    keys = lambda self: list(self.called(self.kept))
    iterator = lambda self: list(self.called(self.kept).items())
    getValue = lambda self, k: self.called(self.kept[k])
    containsKey = lambda self, k: self.called(k in self.kept)
    updateValue = lambda self, k, v: self.called(self.kept.__setitem__(k, v))
    removeKey = lambda self, k: self.called(self.kept.pop(k))
    listTimers = lambda self: self.timers
    registerTimer = lambda self, t: self.timers.append(t)


def test_keyed_fold_calls_the_state_for_chunks_of_events():
    """Shuffled ids, repeats and settling in parts give the columns of a replay, with a few calls to the state for many events."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from triplake.streaming import fold as keyed

    rng, names = random.Random(5), ["a", "b", "c", "é\ud800", "d'"]
    pick = lambda: rng.choice(names)
    log = [(i, k, *((pick(), "int", None, None) if k == "ADD COLUMN" else (pick(), None, None, None) if k == "DROP COLUMN" else (None, None, pick(), pick()))) for i in range(20_000) for k in [rng.choice(["ADD COLUMN", "DROP COLUMN", "RENAME COLUMN"])]]
    want: list[list] = []
    live: dict[str, int] = {}
    for e in log:
        evolve.fold_column(want, live, e)
    calls: list[int] = []
    handle, fold = _State(calls), keyed.TableFold(100)
    fold.init(handle)
    at = lambda t: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: t)
    send = lambda t, rows: list(fold.handleInputRows(("t",), iter([pd.DataFrame(rows[a : a + 4_000], columns=keyed._EVENT) for a in range(0, len(rows), 4_000)]), at(t)))[-1]
    first, second = [e for e in log[:9_000] if e[0] % 5], [e for e in log if e[0] % 5 == 0 or e[0] >= 9_000]
    rng.shuffle(first)
    rng.shuffle(second)
    send(0, [*first, first[0]])
    got = send(50, [*second, *first[:30]])
    told = lambda df: [tuple(r) for r in df[["physical", "logical", "type", "active"]].itertuples(index=False)]
    assert told(got) == [tuple(c[:4]) for c in want] and set(got["n_applied"]) == {20_000} and set(got["last_id"]) == {19_999}
    list(fold.handleExpiredTimer(("t",), at(120), None))  # what came at 0 settles, with what is before it in order
    last, n = handle.kept["settled"]["v"]
    assert last == max(e[0] for e in first) and n == last + 1
    got = send(130, [log[7]])
    assert told(got[got["ordinal"] > 0]) == [tuple(c[:4]) for c in want] and got[got["ordinal"] < 0]["last_id"].tolist() == [7] and set(got["n_applied"]) == {20_000}
    assert len(calls) - len(want) < 100
