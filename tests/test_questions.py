"""Questions without mappings' names: rows equal those of the same patterns over the whole entailed graph."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_mapping import seed  # noqa: F401
from triplake.functions.scalars import ONTOLOGY, RDF_TYPE
from triplake.operators import entailment, mapping
from triplake.operators.mapping import BY_ID, MAPPINGS, Mapping
from triplake.operators.questions import CLASS, Triple, accesses, answer
from triplake.plans.queries import QUESTIONS


def by_graph(graph, patterns, select):
    """Solutions over (s, p, o, kind, type) tuples by plain nested loops."""
    of = {}
    for r in graph:
        of.setdefault(r.p, []).append(((r.s, "iri", None), (r.o, r.o_kind, r.o_type)))
    found = [{}]
    for t in patterns:
        pairs = of.get(RDF_TYPE if t.p == CLASS else ONTOLOGY + t.p, [])
        nxt = []
        for have in found:
            for s, o in pairs:
                new, ok = dict(have), True
                for term, got in ((t.s, s), (t.o, o)):
                    if isinstance(term, str) and term.startswith("?"):
                        ok = ok and new.setdefault(term, got) == got
                    else:
                        ok = ok and got[0] == (ONTOLOGY + term if t.p == CLASS else str(term).lower() if isinstance(term, bool) else str(term))
                if ok:
                    nxt.append(new)
        found = nxt
    return Counter(tuple(h["?" + v][0] for v in select) for h in found)


def shown(df):
    plain = lambda v: format(v, "f") if isinstance(v, Decimal) else str(v).lower() if isinstance(v, bool) else str(v)
    return Counter(tuple(map(plain, r)) for r in df.collect())


@pytest.fixture(scope="module")
def graph(seed):  # noqa: F811
    return entailment.entailed_tables(seed).collect()


MORE = {
    "programmes": ([Triple("?x", CLASS, "ProgramBansos"), Triple("?t", "terdaftarPadaProgram", "?x")], ["x", "t"]),
    "subclass": ([Triple("?x", CLASS, "ProgramPKH")], ["x"]),
    "unknown": ([Triple("?x", "nothing", "?y")], ["x"]),
    "both ways": ([Triple("?p", "menerimaBansos", "?t"), Triple("?t", "disalurkanKepada", "?p"), Triple("?t", CLASS, "TransaksiBansos")], ["p", "t"]),
    "by value": ([Triple("?p", "aktif", True), Triple("?p", "namaLengkap", "?n"), Triple("?p", "penerimaId", 3)], ["p", "n"]),
    "kinds apart": ([Triple("?x", "nik", "?v"), Triple("?y", "noKK", "?v")], ["x"]),
    "region": ([Triple("?x", CLASS, "Wilayah")], ["x"]),
}


@pytest.mark.parametrize("name", [*QUESTIONS, *MORE])
def test_questions_over_mappings_equal_those_over_the_graph(seed, graph, name):  # noqa: F811
    patterns, select = (QUESTIONS[name][0], QUESTIONS[name][1].split()) if name in QUESTIONS else MORE[name]
    want = by_graph(graph, patterns, select)
    assert shown(answer(seed, patterns, select)) == want
    assert want or name in ("q2", "subclass", "unknown", "kinds apart")
    doubled = {k: v.unionByName(v) for k, v in seed.items()}
    if name in ("q1", "received", "twins", "residents", "both ways"):
        assert shown(answer(doubled, patterns, select, unique=False)) == want


def test_subclasses_and_shared_properties(seed):  # noqa: F811
    """Two mappings of one kind that give the same property, and one that asserts a subclass: each triple still counts once."""
    more = (
        *MAPPINGS, Mapping("MAP-PKH", "program_bansos", "program", "program_id", "ProgramPKH", (("namaProgram", "nama_program", "xsd:string"),)),
        Mapping("MAP-RECEIVED", "transaksi_bansos", "penerima", "penerima_id", None, (), (("menerimaBansos", "transaksi", "transaksi_id"),)),
    )
    whole = entailment.entailed_tables(seed, more).collect()
    for patterns, select in (
        ([Triple("?x", "namaProgram", "?n"), Triple("?x", CLASS, "ProgramPKH")], ["x", "n"]), ([Triple("?x", CLASS, "ProgramBansos")], ["x"]),
        ([Triple("?p", "menerimaBansos", "?t")], ["p", "t"]), ([Triple("?t", "disalurkanKepada", "?p"), Triple("?p", "namaLengkap", "?n")], ["t", "n"]),
    ):
        assert shown(answer(seed, patterns, select, mappings=more, unique=False)) == by_graph(whole, patterns, select)
    assert {a.kinds for a in accesses(Triple("?x", "nik", "?y"), seed)} == {("penerima", "xsd:string"), ("penduduk", "xsd:string")}


def test_plans_have_no_more_joins_than_tables(seed):  # noqa: F811
    """Entailed class patterns and patterns of one row add no join; `nik` is read from the one mapping its subject's kind allows."""
    patterns, select, _ = QUESTIONS["q1"]
    text = answer(seed, patterns, select.split())._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join ") == 2 or text.count("Join ") == 1  # the recipients' own row and the link's, and the residents
    assert "Union" not in text and "Distinct" not in text and "Aggregate" not in text
    with pytest.raises(ValueError):
        answer(seed, [Triple("?t", "periodeTransaksi", "?x"), Triple("?g", "namaProgram", "?name")], ["x"])


def test_solutions_without_a_key_are_none(seed):  # noqa: F811
    rows = {**seed, "penerima_manfaat": seed["penerima_manfaat"].withColumn("nik", F.when(F.col("penerima_id") > 4, F.col("nik")))}
    assert answer(rows, QUESTIONS["q1"][0], ["nik"]).count() == 6
    assert mapping.triples_of(rows["penerima_manfaat"], BY_ID["LINK-PENERIMA-KE-DUKCAPIL"]).count() == 6
