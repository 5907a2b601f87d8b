"""Rows to triples (M1-M9): subject IRIs, class assertions, literals, object links, one graph with set semantics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplake.functions.scalars import ONTOLOGY, RDF_TYPE, RESOURCE, encoded, resource

#: Spark types of typed literals.
SPARK_TYPE = {"xsd:string": "string", "xsd:integer": "bigint", "xsd:decimal": "decimal(38,2)", "xsd:date": "date", "xsd:boolean": "boolean", "xsd:dateTime": "timestamp", "xsd:double": "double", "xsd:float": "float"}


#: Values of a part of a table's rows.
VALUES = 1 << 19


@dataclass(frozen=True)
class Mapping:
    """How one source's rows become triples. literals: property, column, RDF type; links: property, kind and key column."""

    id: str
    table: str
    kind: str
    key: str
    cls: str | None = None
    literals: tuple[tuple[str, str, str], ...] = ()
    links: tuple[tuple[str, str, str], ...] = ()
    columns: tuple[str, ...] | None = None  # an explicit projection, or all (M8)


# The mappings.
_S, _I, _D, _T, _B = "xsd:string", "xsd:integer", "xsd:decimal", "xsd:date", "xsd:boolean"
MAPPINGS = (
    Mapping("MAP-PROGRAM", "program_bansos", "program", "program_id", "ProgramBansos", (("programId", "program_id", _I), ("namaProgram", "nama_program", _S), ("tipeProgram", "tipe_program", _S), ("nominal", "nominal", _D)), (), ("program_id", "nama_program", "tipe_program", "nominal")),
    Mapping("MAP-PENERIMA", "penerima_manfaat", "penerima", "penerima_id", "PenerimaBansos", (("penerimaId", "penerima_id", _I), ("nik", "nik", _S), ("namaLengkap", "nama_lengkap", _S), ("tglLahir", "tgl_lahir", _T), ("statusEkonomi", "status_ekonomi", _S), ("aktif", "aktif", _B))),
    Mapping("MAP-TRANSAKSI", "transaksi_bansos", "transaksi", "transaksi_id", "TransaksiBansos", (("transaksiId", "transaksi_id", _I), ("periodeTransaksi", "periode", _S), ("statusTransaksi", "status", _S)), (("terdaftarPadaProgram", "program", "program_id"), ("disalurkanKepada", "penerima", "penerima_id"))),
    Mapping("MAP-ELIGIBILITY", "eligibility_check", "check", "check_id", "EligibilityCheck", (("checkId", "check_id", _I), ("statusEligible", "status_eligible", _S), ("alasan", "alasan", _S)), (("divalidasiDalam", "program", "program_id"), ("validasiPenerima", "penerima", "penerima_id"))),
    Mapping("MAP-PENDUDUK", "master_penduduk", "penduduk", "nik", "Penduduk", (("nik", "nik", _S), ("namaPenduduk", "nama", _S), ("tanggalLahir", "tanggal_lahir", _T), ("pekerjaan", "pekerjaan", _S), ("penghasilan", "penghasilan", _D), ("statusHidup", "status_hidup", _S)), (("tergabungDalamKeluarga", "keluarga", "no_kk"),)),
    Mapping("MAP-KELUARGA", "master_keluarga", "keluarga", "no_kk", "KeluargaKependudukan", (("noKK", "no_kk", _S),), (("berdomisiliDi", "wilayah", "wilayah_id"),)),
    Mapping("MAP-WILAYAH", "master_wilayah", "wilayah", "wilayah_id", "Wilayah", (("wilayahId", "wilayah_id", _I), ("provinsi", "provinsi", _S), ("kabupaten", "kabupaten", _S), ("kecamatan", "kecamatan", _S), ("desa", "desa", _S))),
    Mapping("LINK-PENERIMA-KE-DUKCAPIL", "penerima_manfaat", "penerima", "penerima_id", None, (), (("memilikDataKependudukan", "penduduk", "nik"),), ("penerima_id", "nik")),
)
BY_ID = {m.id: m for m in MAPPINGS}


def lexical(column: Column, kind: str) -> Column:
    """A value's canonical text (M4)."""
    if kind == "xsd:integer":
        return column.cast("bigint").cast("string")
    return column.cast(SPARK_TYPE[kind]).cast("string")


def source(df: DataFrame, m: Mapping) -> DataFrame:
    """The mapping's source rows (M8): only the columns that it binds are read."""
    used = {m.key, *(c for _, c, _ in m.literals), *(c for *_, c in m.links)}
    return df.select(*[c for c in (m.columns or df.columns) if c in used and c in df.columns])


def _terms(m: Mapping, have: list[str]) -> list[Column]:
    """The row's triples as structs of p, o, o_kind, o_type."""
    term = lambda p, o, kind, t: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(t).cast("string").alias("o_type"))
    found = [term(RDF_TYPE, F.lit(ONTOLOGY + m.cls), "iri", None)] if m.cls else []
    found += [term(ONTOLOGY + p, lexical(F.col(c), t), "literal", t) for p, c, t in m.literals if c in have]
    return found + [term(ONTOLOGY + p, resource(kind, F.col(c)), "iri", None) for p, kind, c in m.links if c in have]


def triples_of(df: DataFrame, m: Mapping) -> DataFrame:
    """(s, p, o, o_kind, o_type) of one mapping: one scan, null columns give no triple (M1-M7)."""
    rows = source(df, m)
    out = rows.select(resource(m.kind, F.col(m.key)).alias("s"), F.explode(F.array(*_terms(m, rows.columns))).alias("t")).select("s", "t.*")
    return out.where(F.col("s").isNotNull() & F.col("o").isNotNull())


@dataclass(frozen=True)
class Term:
    """What a row says by one property: a typed literal, a link to a subject of another kind, or its class."""

    prop: str
    column: str | None = None
    xsd: str | None = None
    link: str | None = None
    cls: str | None = None


def terms_by_subject(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...]) -> dict[tuple[str, str, str], list[Term]]:
    """(table, kind, key) to the terms of all mappings that give its subjects, so that a table is read once for all of them."""
    found: dict[tuple[str, str, str], list[Term]] = {}
    for m in mappings:
        if m.table not in tables:
            continue
        have = source(tables[m.table], m).columns
        own = found.setdefault((m.table, m.kind, m.key), [])
        own += [Term(RDF_TYPE, cls=m.cls)] if m.cls else []
        own += [Term(ONTOLOGY + p, c, xsd=t) for p, c, t in m.literals if c in have]
        own += [Term(ONTOLOGY + p, c, link=kind) for p, kind, c in m.links if c in have]
    return found


def dealt(rows: DataFrame, width: int, *by: str) -> DataFrame:
    """rows dealt by columns into as many parts as keep a part at about VALUES values, `width` a row, whatever the input: adaptive execution doesn't join
    parts of a given number, which it would up to a size of packed rows that are many times larger once they are taken apart. Two at least: Spark deals one part by no key."""
    return rows.repartition(max(2, -(-rows.count() * width // VALUES)), *by)


def told(df: DataFrame, key: str, terms: list[Term]) -> DataFrame:
    """key and v, each term's value as text, of the rows with a key. Rows are dealt by key: the one shuffle of a table's triples, and a narrow one."""
    value = lambda t: F.lit("") if t.cls else lexical(F.col(t.column), t.xsd) if t.xsd else F.col(t.column).cast("string")
    rows = df.where(F.col(key).isNotNull())
    return dealt(rows.select(F.col(key).cast("string").alias("key"), F.array(*[value(t) for t in terms]).alias("v")), len(terms), "key")


def said_once(rows: DataFrame) -> DataFrame:
    """key, at, o: each subject's values by the place of their term, once. Repeated rows meet in one task already, so nothing is shuffled.

    The outer form keeps the optimizer from putting a filter below the shuffle, which another use of the rows would then not share.
    """
    return rows.select("key", F.posexplode_outer("v").alias("at", "o")).where("o is not null").dropDuplicates(["key", "at", "o"])


def picked(values: list, kind: str = "string") -> Column:
    """The value at the term's place."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("at") + 1)


def whole_triple(kind: str, terms: list[Term]) -> Column:
    """s, p, o, o_kind and o_type of a row of said_once; the IRIs are built here, after the distinct."""
    there = picked([f"{RESOURCE}{t.link}/" if t.link else None for t in terms])
    cls = picked([ONTOLOGY + t.cls if t.cls else None for t in terms])
    o = F.coalesce(cls, F.when(there.isNotNull(), F.concat(there, encoded(F.col("o")))), F.col("o"))
    named = [resource(kind, F.col("key")).alias("s"), picked([t.prop for t in terms]).alias("p"), o.alias("o")]
    return F.struct(*named, picked(["literal" if t.xsd else "iri" for t in terms]).alias("o_kind"), picked([t.xsd for t in terms]).alias("o_type"))


def clash(groups: dict[tuple[str, str, str], list[Term]]) -> bool:
    """Whether two terms can give one triple, as no term of the fixed mappings can: subjects of one kind with one property."""
    seen = [(kind, t.prop, t.cls) for (_, kind, _), terms in groups.items() for t in terms]
    return len(seen) > len(set(seen))


def triples(tables: dict[str, DataFrame], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """M9: all mappings as one graph, each triple once.

    A subject's rows meet by its key and its triples are made distinct there. Only mappings that share both the kind of subject
    and a property need a distinct over whole triples.
    """
    groups = terms_by_subject(tables, mappings)
    found = [said_once(told(tables[table], key, terms)).select(whole_triple(kind, terms).alias("t")).select("t.*") for (table, kind, key), terms in groups.items()]
    graph = reduce(DataFrame.unionByName, found)
    return graph.dropDuplicates(["s", "p", "o", "o_type"]) if clash(groups) else graph


def property_table(df: DataFrame, m: Mapping, prop: str, subject: str, value: str) -> DataFrame:
    """One predicate's pairs with raw keys: subject key and typed value or object key, nulls dropped. IRIs are built last."""
    for p, c, t in m.literals:
        if p == prop:
            return df.select(F.col(m.key).alias(subject), F.col(c).cast(SPARK_TYPE[t]).alias(value)).where(f"`{subject}` is not null and `{value}` is not null")
    for p, _, c in m.links:
        if p == prop:
            return df.select(F.col(m.key).alias(subject), F.col(c).alias(value)).where(f"`{subject}` is not null and `{value}` is not null")
    raise KeyError(f"{m.id} has no property {prop}")


def stored_properties(tables: dict[str, DataFrame], wanted: list[tuple[str, str]], folder: str, prefix: str, buckets: int = 64) -> dict[tuple[str, str], str]:
    """Property tables (subject, value) for (mapping id, property), stored bucketed and sorted by the subject's key as text: joins on subjects need no exchange.

    Returns each table's name in the session's catalog; their files are below the folder.
    """
    names = {}
    for i, (mapping_id, prop) in enumerate(wanted):
        m = BY_ID[mapping_id]
        rows = property_table(tables[m.table], m, prop, "subject", "value").withColumn("subject", F.col("subject").cast("string"))
        names[mapping_id, prop] = f"{prefix}_{i}"
        # rows are dealt by the buckets' own hash first, so that each bucket is one file
        rows.repartition(buckets, "subject").write.bucketBy(buckets, "subject").sortBy("subject").option("path", f"{folder}/{i}").mode("overwrite").saveAsTable(names[mapping_id, prop])
    return names


def star(spark: SparkSession, names: list[str], values: list[str]) -> DataFrame:
    """Subjects that have all of the stored properties, with their values: sort-merge joins on buckets."""
    frames = [spark.table(n).withColumnRenamed("value", v) for n, v in zip(names, values, strict=True)]
    return reduce(lambda a, b: a.join(b.hint("merge"), "subject"), frames)
