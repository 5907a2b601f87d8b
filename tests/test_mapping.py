from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from triplake.functions import scalars
from triplake.operators import entailment, mapping
from triplake.operators.patterns import Pattern, pattern_join
from triplake.plans import analytics
from triplake.schemas import SOURCES, struct

DAY = datetime.date(1990, 1, 2)


@pytest.fixture(scope="module")
def seed(spark):
    """As many rows as the small reference database has, none null."""
    data = {
        "program_bansos": [(i, f"programme {i % 4}", "T", 100 * i, None, None) for i in range(1, 6)],
        "penerima_manfaat": [(i, f"n{i}", "Ani" if i == 1 else f"name {i}", DAY, "low", f"k{i}", True) for i in range(1, 11)],
        "transaksi_bansos": [(i, i % 5 + 1, i % 10 + 1, "2024-01", "TERSALURKAN" if i % 3 else "GAGAL", None) for i in range(1, 16)],
        "eligibility_check": [(i, i % 5 + 1, i, "TIDAK ELIGIBLE" if i in (3, 6) else "ELIGIBLE", "why", None, None) for i in range(1, 11)],
        "master_wilayah": [(i, "Sulawesi Selatan", "a", "b", "c") for i in range(1, 11)],
        "master_keluarga": [(f"k{i}", i, None) for i in range(1, 11)],
        "master_penduduk": [(f"n{i}", f"k{i % 10 + 1}", "ANI" if i == 1 else "other" if i == 2 else f"name {i}", DAY, "farmer", 5, "HIDUP", None) for i in range(1, 16)],
    }
    declared = {t: columns for model in SOURCES.values() for t, columns in model.items()}
    typed = lambda r, t: tuple(Decimal(v) if k.startswith("decimal") else v for v, k in zip(r, declared[t].values(), strict=True))
    return {t: spark.createDataFrame([typed(r, t) for r in rows], struct(**declared[t])) for t, rows in data.items()}


def test_number_of_triples(seed):
    graph = mapping.triples(seed)
    assert graph.count() == 465
    assert mapping.triples({k: v.unionByName(v) for k, v in seed.items()}).count() == 465  # set semantics


def test_nulls_give_no_triples(seed):
    rows = seed["eligibility_check"].withColumn("alasan", F.when(F.col("check_id") > 4, F.col("alasan"))).withColumn("check_id", F.when(F.col("check_id") != 9, F.col("check_id")))
    found = Counter(r.p.rsplit("/", 1)[-1] for r in mapping.triples_of(rows, mapping.BY_ID["MAP-ELIGIBILITY"]).collect())
    assert found["alasan"] == 5 and found["statusEligible"] == 9


def test_iris_are_encoded(spark):
    df = spark.createDataFrame([("a b/ü+",), (None,)], "k string").select(scalars.resource("x", F.col("k")).alias("s"))
    assert [r.s for r in df.collect()] == [scalars.RESOURCE + "x/a%20b%2F%C3%BC%2B", None]


def test_questions(seed):
    t = seed
    assert analytics.recipients_with_residents(t["penerima_manfaat"], t["master_penduduk"]).count() == 10
    region = lambda p: analytics.recipients_in_province(t["penerima_manfaat"], t["master_penduduk"], t["master_keluarga"], t["master_wilayah"], p).count()
    assert (region("Jawa Barat"), region("Sulawesi Selatan")) == (0, 10)
    assert analytics.rejected_checks(t["eligibility_check"], t["penerima_manfaat"], t["program_bansos"]).count() == 2
    assert [r.nik for r in analytics.name_audit(t["penerima_manfaat"], t["master_penduduk"]).collect()] == ["n2"]
    totals = {r.nama_program: int(r.total_nominal) for r in analytics.programme_totals(t["transaksi_bansos"], t["program_bansos"]).collect()}
    want = Counter()
    for i in range(1, 16):
        if i % 3:
            p = i % 5 + 1
            want[f"programme {p % 4}"] += 100 * p
    assert totals == dict(want)


def test_patterns_give_a_bag(seed):
    out = pattern_join(seed, [Pattern("t", "terdaftarPadaProgram", "g", "MAP-TRANSAKSI"), Pattern("g", "namaProgram", "name", "MAP-PROGRAM")], ["name"])
    assert out.count() == 15
    with pytest.raises(ValueError):
        pattern_join(seed, [Pattern("t", "periodeTransaksi", "x", "MAP-TRANSAKSI"), Pattern("g", "namaProgram", "name", "MAP-PROGRAM")], ["name"])


def test_entailment(spark, seed):
    graph = mapping.triples(seed)
    sub = spark.createDataFrame([("x", scalars.RDF_TYPE, scalars.ONTOLOGY + "ProgramPKH", "iri", None)], graph.schema)
    out = entailment.entailed(graph.unionByName(sub))
    got = {tuple(r[:3]) for r in out.collect()}
    assert ("x", scalars.RDF_TYPE, scalars.ONTOLOGY + "ProgramBansos") in got
    assert (scalars.RESOURCE + "penerima/2", scalars.ONTOLOGY + "menerimaBansos", scalars.RESOURCE + "transaksi/1") in got
    # all rows have their class asserted, so domains and ranges add nothing here: 15 inverses and the two types of x
    assert len(got) == 465 + 15 + 2
    assert entailment.closure({"a": "b", "b": ["c", "d"], "c": "a"}) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("b", "a"), ("b", "b"), ("b", "c"), ("b", "d"), ("c", "a"), ("c", "b"), ("c", "c"), ("c", "d")]


def _set(df):
    got = Counter(tuple(r) for r in df.select("s", "p", "o", "o_kind", "o_type").collect())
    assert set(got.values()) <= {1}
    return set(got)


def test_entailment_from_rows_equals_that_of_the_graph(seed):
    """Also with repeated rows, null values and objects that no row describes."""
    tables = {k: v.unionByName(v.limit(3)) for k, v in seed.items()}
    tables["eligibility_check"] = tables["eligibility_check"].withColumn("alasan", F.when(F.col("check_id") > 4, F.col("alasan"))).withColumn("penerima_id", F.col("penerima_id") + 5)
    for mappings in (mapping.MAPPINGS, tuple(m for m in mapping.MAPPINGS if m.id not in ("MAP-PENERIMA", "MAP-KELUARGA")), (*mapping.MAPPINGS, mapping.Mapping("X", "penerima_manfaat", "penduduk", "nik", None, (("nik", "nik", "xsd:string"),)))):
        graph = mapping.triples(tables, mappings)
        base, inverse = _set(graph), _set(graph.unionByName(entailment.inverses(graph)))
        linked = graph.unionByName(entailment.inverses(graph))
        want = inverse | _set(entailment.domains(linked)) | _set(entailment.ranges(linked))
        assert _set(entailment.entailed(graph)) == _set(entailment.entailed_tables(tables, mappings)) == want and base < want


def test_parents_reach_types_from_rows(seed):
    parents = {"PenerimaBansos": "Orang", "Penduduk": "Orang", "Orang": ["Makhluk"]}
    out = _set(entailment.entailed_tables(seed, parents=parents))
    assert out == _set(entailment.entailed(mapping.triples(seed), parents))
    assert len([t for t in out if t[2] == scalars.ONTOLOGY + "Makhluk"]) == 25


def test_plan_of_the_entailed_graph(seed):
    """A table's rows are dealt once, narrow; only types are shuffled besides."""
    plan = entailment.entailed_tables(seed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(kind") == 1 and plan.count("hashpartitioning(s#") == 0
    assert mapping.triples(seed)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") == 7


def test_parts_of_a_table_grow_in_number_not_in_size(spark, monkeypatch):
    """Adaptive execution leaves the parts as they are, and repeats of a key still meet."""
    monkeypatch.setattr(mapping, "VALUES", 100)
    df = spark.range(200).selectExpr("CAST(id % 150 AS INT) AS penerima_id", "CAST(id AS STRING) AS nik", "'x' AS nama_lengkap")
    (key, terms), *_ = [(k[2], t) for k, t in mapping.terms_by_subject({"penerima_manfaat": df}, mapping.MAPPINGS).items()]
    rows = mapping.told(df, key, terms)
    parts = rows.groupBy(F.spark_partition_id()).count().collect()
    assert rows.rdd.getNumPartitions() == -(-200 * len(terms) // 100) == 10 and max(r["count"] for r in parts) < 60
    assert mapping.said_once(rows).count() == 150 * 3 + 200 * 2
