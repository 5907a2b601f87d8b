"""The three layers after an ordered log, against a replay of every event by definition."""

from __future__ import annotations

import random

import pytest

from triplake.operators import fold

TABLES = [("ta", "MAP-A", "A", "m1"), ("tb", "MAP-B", "B", "m2")]
COLUMNS = [("ta", 1, "nik", "char(16)"), ("ta", 2, "nama", "varchar(9)"), ("tb", 1, "kode", "int")]
PROPERTIES = [("ta", "nik", "nik", "xsd:string"), ("ta", "namaPenduduk", "nama", "xsd:string"), ("tb", "kode", "kode", "xsd:integer")]
LOG = "id long, alter_type string, column_name string, column_type string, old_column string, new_column string, table_name string"
XSD = {"int": "xsd:integer", "text": "xsd:string", "date": "xsd:date", "char": "xsd:string", "varchar": "xsd:string"}
FED = {"int": "integer", "text": "string", "date": "date", "char": "string", "varchar": "string"}


def camel(name):
    first, *rest = name.lower().split("_")
    return first + "".join(w[:1].upper() + w[1:] for w in rest)


def replayed(rows):
    columns, mapping, onto = {t: [] for t, *_ in TABLES}, {t: {} for t, *_ in TABLES}, {}
    cls, kind = {t: c for t, _, c, _ in TABLES}, lambda t: t.split("(")[0]
    for t, _, c, sql in COLUMNS:
        columns[t].append([c, c, sql, True])
    for t, p, b, x in PROPERTIES:
        mapping[t][p] = (b, x)
        onto.setdefault(p, [cls[t], x, False])
    for _, what, name, sql, old, new, t in sorted(rows):
        live = {c[0]: c for c in columns[t] if c[3]}
        if what == "ADD COLUMN" and name not in live:
            columns[t].append([name, name, sql, True])
            mapping[t].setdefault(camel(name), (name, XSD[kind(sql)]))
            onto.setdefault(camel(name), [cls[t], XSD[kind(sql)], False])
        elif what == "DROP COLUMN" and name in live:
            live[name][3] = False
            logical = live[name][1]
            gone = camel(logical) if camel(logical) in mapping[t] else next((p for p, (b, _) in mapping[t].items() if b == logical), None)
            if gone:
                del mapping[t][gone]
                onto[gone][2] = True
        elif what == "RENAME COLUMN" and old in live and new not in live:
            live[old][0] = new
    of = {t: (m, model) for t, m, _, model in TABLES}
    there = {t: [c for c in cs if c[3]] for t, cs in columns.items()}
    return (
        {(of[t][1], t, i, c[0], FED[kind(c[2])]) for t, cs in there.items() for i, c in enumerate(cs, 1)}, {(of[t][0], i, c[0], c[1]) for t, cs in there.items() for i, c in enumerate(cs, 1)},
        {(of[t][0], p, b, x) for t, ps in mapping.items() for p, (b, x) in ps.items()}, {(p, d, r, gone) for p, (d, r, gone) in onto.items()},
    )


def run(spark, rows, segment=1000):
    out = fold.layers(
        spark.createDataFrame(rows, LOG), spark.createDataFrame(TABLES, "table_name string, mapping_id string, class string, model string"), spark.createDataFrame(COLUMNS, "table_name string, ordinal int, name string, type string"),
        spark.createDataFrame(PROPERTIES, "table_name string, property string, binding string, xsd string"), segment,
    )
    named = out.ontology.select("property", "domain", "range", "deprecated")
    return tuple({tuple(r) for r in df.collect()} for df in (out.federation, out.projection, out.mapping, named))


def test_a_chain_on_one_column(spark):
    """ADD, RENAME, RENAME, DROP and ADD again: the column is back, its property bound anew, the ontology's stays deprecated."""
    rows = [(1, "ADD COLUMN", "kode_pos", "int", None, None, "ta"), (2, "RENAME COLUMN", None, None, "kode_pos", "b", "ta"), (3, "RENAME COLUMN", None, None, "b", "c", "ta"), (4, "DROP COLUMN", "c", None, None, None, "ta")]
    federation, projection, mapping, ontology = run(spark, rows[:3])
    assert ("m1", "ta", 3, "c", "integer") in federation and ("MAP-A", 3, "c", "kode_pos") in projection and ("MAP-A", "kodePos", "kode_pos", "xsd:integer") in mapping and ("kodePos", "A", "xsd:integer", False) in ontology
    again = [*rows, (5, "ADD COLUMN", "kode_pos", "text", None, None, "ta"), (6, "DROP COLUMN", "nama", None, None, None, "ta")]
    federation, projection, mapping, ontology = run(spark, again)
    assert {r[3] for r in federation if r[1] == "ta"} == {"nik", "kode_pos"} and ("MAP-A", "kodePos", "kode_pos", "xsd:string") in mapping
    assert ("kodePos", "A", "xsd:integer", True) in ontology and ("namaPenduduk", "A", "xsd:string", True) in ontology and "namaPenduduk" not in {r[1] for r in mapping}
    assert run(spark, again) == replayed(again)


@pytest.mark.parametrize("seed, segment", [(0, 1000), (1, 25)])
def test_layers_against_a_replay(spark, seed, segment):
    rng = random.Random(seed)
    names = ["nik", "nama", "kode", "no_kk", "kode_pos", "kodepos", "tgl", "x_y"]
    rows = []
    for i in range(1, 160):
        what, a, b = rng.choice(["ADD COLUMN", "DROP COLUMN", "RENAME COLUMN"]), rng.choice(names), rng.choice(names)
        rows.append((i, what, *((None, None, a, b) if what == "RENAME COLUMN" else (a, rng.choice(["int", "varchar(20)", "date"]) if what == "ADD COLUMN" else None, None, None)), rng.choice(["ta", "ta", "tb"])))
    assert run(spark, rows, segment) == replayed(rows)
