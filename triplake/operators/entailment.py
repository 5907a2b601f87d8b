"""Entailment over the ontology (E1-E4): subclasses, inverses, domains and ranges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplake.functions.scalars import ONTOLOGY, RDF_TYPE, RESOURCE, encoded, resource
from triplake.operators.mapping import MAPPINGS, Mapping, Term, clash, picked, said_once, terms_by_subject, told, whole_triple

# The ontology's classes and object properties.
SUBCLASSES = {"ProgramPKH": "ProgramBansos", "ProgramBPNT": "ProgramBansos", "ProgramBST": "ProgramBansos"}
INVERSES = {"menerimaBansos": "disalurkanKepada"}
#: Property: domain, range.
OBJECT_PROPERTIES = {
    "menerimaBansos": ("PenerimaBansos", "TransaksiBansos"), "disalurkanKepada": ("TransaksiBansos", "PenerimaBansos"), "terdaftarPadaProgram": ("TransaksiBansos", "ProgramBansos"),
    "divalidasiDalam": ("EligibilityCheck", "ProgramBansos"), "validasiPenerima": ("EligibilityCheck", "PenerimaBansos"), "memilikDataKependudukan": ("PenerimaBansos", "Penduduk"),
    "tergabungDalamKeluarga": ("Penduduk", "KeluargaKependudukan"), "berdomisiliDi": ("KeluargaKependudukan", "Wilayah"), "memilikiRiwayatPerubahan": ("Penduduk", "RiwayatPerubahan"),
}
#: Class: datatype properties with that single domain. A union of classes as domain types nothing.
DATATYPE_DOMAINS = {
    "ProgramBansos": "programId namaProgram tipeProgram nominal periodeMulai periodeSelesai", "PenerimaBansos": "penerimaId namaLengkap tglLahir statusEkonomi noKartuKeluarga aktif",
    "TransaksiBansos": "transaksiId periodeTransaksi statusTransaksi", "EligibilityCheck": "checkId statusEligible alasan validatedAt validatedBy",
    "Penduduk": "namaPenduduk tanggalLahir pekerjaan penghasilan statusHidup", "Wilayah": "wilayahId provinsi kabupaten kecamatan desa", "RiwayatPerubahan": "riwayatId kolomDiubah nilaiLama nilaiBaru diubahPada diubahOleh",
}


def closure(parents: dict[str, str | list[str]]) -> list[tuple[str, str]]:
    """Pairs (class, ancestor) of a class hierarchy; it is metadata of a few rows."""
    out = set()
    for cls in parents:
        todo, seen = [cls], set()
        while todo:
            up = parents.get(todo.pop(), [])
            for p in [up] if isinstance(up, str) else up:
                if p not in seen:
                    seen.add(p)
                    out.add((cls, p))
                    todo.append(p)
    return sorted(out)


def _pairs(spark: SparkSession, rows: list[tuple[str, str]], names: list[str]) -> DataFrame:
    """Ontology rows as a frame of full IRIs; small by construction, so joins broadcast it."""
    return F.broadcast(spark.createDataFrame([tuple(ONTOLOGY + x for x in r) for r in rows], ", ".join(f"{n} string" for n in names)))


def _typed(s, cls) -> list:
    return [s.alias("s"), F.lit(RDF_TYPE).alias("p"), cls.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type")]


def superclasses(graph: DataFrame, parents: dict = SUBCLASSES) -> DataFrame:
    """Types of instances by their classes' ancestors."""
    up = _pairs(graph.sparkSession, closure(parents), ["o", "ancestor"])
    return graph.where(F.col("p") == RDF_TYPE).join(up, "o").select(*_typed(F.col("s"), F.col("ancestor")))


def inverses(graph: DataFrame, pairs: dict = INVERSES) -> DataFrame:
    """Each pair of inverse properties, both ways."""
    both = [*pairs.items(), *((b, a) for a, b in pairs.items())]
    of = _pairs(graph.sparkSession, both, ["p", "inverse"])
    found = graph.where(F.col("o_kind") == "iri").join(of, "p")
    return found.select(F.col("o").alias("s"), F.col("inverse").alias("p"), F.col("s").alias("o"), "o_kind", "o_type")


def domains(graph: DataFrame) -> DataFrame:
    """The subject's type by the property's domain."""
    rows = [(p, d) for p, (d, _) in OBJECT_PROPERTIES.items()] + [(p, c) for c, ps in DATATYPE_DOMAINS.items() for p in ps.split()]
    return graph.join(_pairs(graph.sparkSession, rows, ["p", "class"]), "p").select(*_typed(F.col("s"), F.col("class"))).distinct()


def ranges(graph: DataFrame) -> DataFrame:
    """The object's type by the object property's range."""
    rows = [(p, r) for p, (_, r) in OBJECT_PROPERTIES.items()]
    return graph.where(F.col("o_kind") == "iri").join(_pairs(graph.sparkSession, rows, ["p", "class"]), "p").select(*_typed(F.col("o"), F.col("class"))).distinct()


def _types_of_tables(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...], said_of: Callable[[Term, str, str], list[tuple[str, Column, Column, str]]]) -> DataFrame:
    """Types that rows tell: said_of gives, for a term and its subject's kind, what is typed (kind, key, whether the value must be there, class).

    Rows are made distinct as kind, key and class, before any IRI is built; each table is read once.
    """
    found = []
    for (table, kind, key), terms in terms_by_subject(tables, mappings).items():
        said = [F.when(there & k.isNotNull(), F.struct(F.lit(of).alias("kind"), k.cast("string").alias("key"), F.lit(cls).alias("class"))) for t in terms if t.column for of, k, there, cls in said_of(t, kind, key)]
        if said:
            rows = tables[table].where(F.col(key).isNotNull())
            found.append(rows.select(F.explode(F.array_compact(F.array(*said))).alias("t")).select("t.*"))
    once = reduce(DataFrame.unionByName, found).dropDuplicates(["kind", "key", "class"])
    return once.select(*_typed(F.concat(F.lit(RESOURCE), "kind", F.lit("/"), encoded(F.col("key"))), F.concat(F.lit(ONTOLOGY), "class")))


def domains_of_tables(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """E3 of all mappings' triples, from the rows."""
    of = {p: d for p, (d, _) in OBJECT_PROPERTIES.items()} | {p: c for c, ps in DATATYPE_DOMAINS.items() for p in ps.split()}
    return _types_of_tables(tables, mappings, lambda t, kind, key: [(kind, F.col(key), F.col(t.column).isNotNull(), of[p]) for p in [t.prop.removeprefix(ONTOLOGY)] if p in of])


def ranges_of_tables(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """E4 of all mappings' triples, from the rows."""
    to = {p: r for p, (_, r) in OBJECT_PROPERTIES.items()}
    return _types_of_tables(tables, mappings, lambda t, kind, key: [(t.link, F.col(t.column), F.lit(True), to[p]) for p in [t.prop.removeprefix(ONTOLOGY)] if t.link and p in to])


def implied(parents: dict = SUBCLASSES) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[str, str]]:
    """By property: the classes of its subjects, those of its objects, both with ancestors and by way of inverses, and its inverse."""
    up: dict[str, set[str]] = {}
    for c, ancestor in closure(parents):
        up.setdefault(c, set()).add(ancestor)
    inverse = INVERSES | {b: a for a, b in INVERSES.items()}
    of, to = {p: {d} for p, (d, _) in OBJECT_PROPERTIES.items()}, {p: {r} for p, (_, r) in OBJECT_PROPERTIES.items()}
    for p, q in inverse.items():
        of[p], to[p] = of.get(p, set()) | to.get(q, set()), to.get(p, set()) | of.get(q, set())
    of |= {p: {c} for c, ps in DATATYPE_DOMAINS.items() for p in ps.split()}
    whole = lambda classes: sorted(classes.union(*[up.get(c, set()) for c in classes]))
    return {p: whole(c) for p, c in of.items()}, {p: whole(c) for p, c in to.items()}, inverse


def entailed(graph: DataFrame, parents: dict = SUBCLASSES) -> DataFrame:
    """The graph with all that E1-E4 add, each triple once: every triple tells what follows from it, in one pass."""
    of, to, inverse = implied(parents)
    ancestors: dict[str, list[str]] = {}
    for c, a in closure(parents):
        ancestors.setdefault(c, []).append(a)
    iri = lambda name: F.lit(ONTOLOGY + name)
    by = lambda names, value, key: F.try_element_at(F.create_map(*[x for k, v in names.items() for x in (iri(k), value(v))]), F.col(key))
    classes = lambda names, key: by(names, lambda v: F.array(*map(iri, v)), key)
    triple = lambda s, p, o, kind, t: F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), t.alias("o_type"))
    none, is_iri = F.lit(None).cast("string"), F.col("o_kind") == "iri"
    typed = lambda s, found: F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda c: triple(F.col(s), F.lit(RDF_TYPE), c, F.lit("iri"), none))
    other = F.array_compact(F.array(F.when(is_iri & by(inverse, iri, "p").isNotNull(), triple(F.col("o"), by(inverse, iri, "p"), F.col("s"), F.col("o_kind"), F.col("o_type")))))
    literal = {p: c for p, c in of.items() if p not in OBJECT_PROPERTIES and p not in inverse}
    alone = {p: [d, *ancestors.get(d, [])] for p, (d, _) in OBJECT_PROPERTIES.items()}  # where the object is no IRI, only the domain says something
    own = F.coalesce(classes(literal, "p"), F.when(is_iri, classes({p: c for p, c in of.items() if p not in literal}, "p")).otherwise(classes(alone, "p")))
    found = F.concat(
        F.array(triple(*map(F.col, ("s", "p", "o", "o_kind", "o_type")))), other, typed("s", own), typed("o", F.when(is_iri, classes(to, "p"))),
        typed("s", F.when(F.col("p") == RDF_TYPE, classes(ancestors, "o"))),
    )
    return graph.select(F.explode(found).alias("t")).select("t.*").dropDuplicates(["s", "p", "o", "o_type"])


def entailed_tables(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...] = MAPPINGS, parents: dict = SUBCLASSES) -> DataFrame:
    """The entailed graph of all mappings' triples, from the rows: each table is read and dealt by key once.

    Values and their inverses are distinct by the subject's key. What classes follow for a row's subject and for its objects is known
    from its mapping, so types are made distinct as narrow rows of kind, key and class.
    """
    of, to, inverse = implied(parents)
    up = closure(parents)
    name = lambda prop: prop.removeprefix(ONTOLOGY)
    groups = terms_by_subject(tables, mappings)
    data, types = [], []
    for (table, kind, key), every in groups.items():
        terms = [t for t in every if not t.cls]
        rows = told(tables[table], key, terms)
        back = picked([f"{RESOURCE}{t.link}/" if t.link and name(t.prop) in inverse else None for t in terms])
        prop = picked([ONTOLOGY + inverse[name(t.prop)] if t.link and name(t.prop) in inverse else None for t in terms])
        turned = F.struct(F.concat(back, encoded(F.col("o"))).alias("s"), prop.alias("p"), resource(kind, F.col("key")).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))
        both = F.array_compact(F.array(whole_triple(kind, terms), F.when(back.isNotNull(), turned)))
        data.append(said_once(rows).select(F.explode(both).alias("t")).select("t.*"))
        always = {t.cls for t in every if t.cls}
        always |= {a for c, a in up if c in always}
        is_ = lambda k, value, cls: F.struct(F.lit(k).alias("kind"), value.alias("key"), F.lit(cls).alias("class"))
        said = [is_(kind, F.col("key"), c) for c in sorted(always)]
        for i, t in enumerate(terms):
            value = F.col("v")[i]
            said += [F.when(value.isNotNull(), is_(kind, F.col("key"), c)) for c in of.get(name(t.prop), []) if c not in always]
            said += [F.when(value.isNotNull(), is_(t.link, value, c)) for c in to.get(name(t.prop), [])] if t.link else []
        if said:
            if len(said) == len(always):  # no value tells more: the keys alone are read
                rows = tables[table].select(F.col(key).cast("string").alias("key")).where("key is not null")
            types.append(rows.select(F.explode_outer(F.array(*said)).alias("t")).where("t is not null").select("t.*"))
    graph = reduce(DataFrame.unionByName, data)
    mapped = {name(t.prop) for ts in groups.values() for t in ts}
    if clash(groups) or any(p in mapped and q in mapped for p, q in inverse.items()):
        graph = graph.dropDuplicates(["s", "p", "o", "o_type"])
    if not types:
        return graph
    once = reduce(DataFrame.unionByName, types).dropDuplicates(["kind", "key", "class"])
    return graph.unionByName(once.select(*_typed(F.concat(F.lit(RESOURCE), "kind", F.lit("/"), encoded(F.col("key"))), F.concat(F.lit(ONTOLOGY), "class"))))
