"""The registered queries of this library, each over its whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplake.functions import scalars
from triplake.operators import catalog_diff, ddl_events, entailment, evolve, fold, mapping
from triplake.operators.patterns import Pattern, pattern_join
from triplake.operators.questions import CLASS, Triple, answer
from triplake.plans import analytics
from triplake.schemas import FEDERATED, federated
from triplake.sources.bindings import bound, cte
from triplake.sources.federation import append_events, balanced_ranges, change_stream, declared, jdbc_options, load_version, read_log, read_source, sampled_keys, save_if_changed, versions
from triplake.sources.storage import fresh, written
from triplake.streaming import changes
from triplake.streaming import fold as keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PROVINCE = "ASIA"


def register(name: str, query: Query, tables: tuple[str, ...] = (), sql: str | None = None, more: str = "") -> None:
    """A query and, if SQL expresses it, its oracle: the tables' bindings, further expressions, then the statement."""
    QUERIES[name] = query
    if sql:
        ORACLES[name] = cte(*tables) + more + "\n" + sql


def on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Makes a query of a function over domain tables."""
    return lambda f: lambda spark, sf_dir: f(*[bound(spark, sf_dir, n) for n in names])


def domain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: bound(spark, sf_dir, n) for n in ("program_bansos", "penerima_manfaat", "transaksi_bansos", "eligibility_check", "master_wilayah", "master_keluarga", "master_penduduk")}


DOMAIN = ("program_bansos", "penerima_manfaat", "transaksi_bansos", "eligibility_check", "master_wilayah", "master_keluarga", "master_penduduk")

# ---- S3, V1-V3 ----
_DUCK = {"int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
for _t in DOMAIN:
    _have = {"program_bansos": "program_id nama_program tipe_program nominal", "penerima_manfaat": "penerima_id nik nama_lengkap status_ekonomi no_kartu_keluarga aktif", "transaksi_bansos": "transaksi_id program_id penerima_id periode status", "eligibility_check": "check_id program_id penerima_id status_eligible alasan", "master_wilayah": "wilayah_id provinsi kabupaten kecamatan desa", "master_keluarga": "no_kk wilayah_id", "master_penduduk": "nik no_kk nama pekerjaan penghasilan status_hidup"}[_t].split()
    _cols = [(f.name, f.dataType.simpleString()) for f in federated(_t)]
    # decimals are cut, not rounded, on the way to integers
    _expr = lambda c, t, have=_have: f"CAST({f'trunc({c})' if c in ('nominal', 'penghasilan') else c if c in have else 'NULL'} AS {_DUCK[t]}) AS {c}"
    register(f"s3_federated_{_t}", on(_t)(lambda df, t=_t: declared(df, federated(t))), (_t,), f"SELECT {', '.join(_expr(c, t) for c, t in _cols)} FROM {_t}")
for _v, (_t, _c) in analytics.PASS_THROUGH.items():
    register(f"v1_{_v}", lambda spark, d, v=_v, t=_t: analytics.view(v, {t: bound(spark, d, t)}), (_t,), f"SELECT {', '.join(_c)} FROM {_t}")
register("v2_v_keluarga", lambda spark, d: analytics.view("v_keluarga", domain(spark, d)), ("master_keluarga", "master_wilayah"), "SELECT k.no_kk, k.wilayah_id, w.provinsi, w.kabupaten, w.kecamatan, w.desa FROM master_keluarga k JOIN master_wilayah w USING (wilayah_id)")
register("v3_v_program", lambda spark, d: analytics.view("v_program", domain(spark, d)), ("program_bansos",), "SELECT program_id, nama_program, tipe_program, CAST(trunc(nominal) AS BIGINT) AS nominal FROM program_bansos")

# ---- Q0-Q6 ----
Q_SQL = {
    "q1": "SELECT p.penerima_id, p.nama_lengkap, d.pekerjaan, d.penghasilan FROM penerima_manfaat p JOIN master_penduduk d USING (nik) WHERE d.penghasilan IS NOT NULL",
    "q2": f"SELECT p.penerima_id, p.nama_lengkap, w.kabupaten, w.kecamatan FROM penerima_manfaat p JOIN master_penduduk d USING (nik) JOIN master_keluarga k ON d.no_kk = k.no_kk JOIN master_wilayah w ON k.wilayah_id = w.wilayah_id WHERE w.provinsi = '{PROVINCE}'",
    "q3": "SELECT c.check_id, p.nama_lengkap, g.nama_program, c.alasan FROM eligibility_check c JOIN penerima_manfaat p USING (penerima_id) JOIN program_bansos g ON c.program_id = g.program_id WHERE c.status_eligible = 'TIDAK ELIGIBLE' AND c.alasan IS NOT NULL",
    "q4": "SELECT p.nik, p.nama_lengkap, d.nama AS nama_penduduk FROM penerima_manfaat p JOIN master_penduduk d USING (nik) WHERE lower(p.nama_lengkap) <> lower(d.nama)",
    "q5": "SELECT g.nama_program, CAST(sum(g.nominal) AS DECIMAL(38,2)) AS total_nominal FROM transaksi_bansos t JOIN program_bansos g USING (program_id) WHERE t.status = 'TERSALURKAN' GROUP BY g.nama_program",
}
Q_TABLES = {
    "q1": ("penerima_manfaat", "master_penduduk"), "q2": ("penerima_manfaat", "master_penduduk", "master_keluarga", "master_wilayah"), "q3": ("eligibility_check", "penerima_manfaat", "program_bansos"),
    "q4": ("penerima_manfaat", "master_penduduk"), "q5": ("transaksi_bansos", "program_bansos"),
}
register("q1_recipients_with_residents", on(*Q_TABLES["q1"])(analytics.recipients_with_residents), Q_TABLES["q1"], Q_SQL["q1"])
register("q2_recipients_in_province", on(*Q_TABLES["q2"])(lambda *t: analytics.recipients_in_province(*t, PROVINCE)), Q_TABLES["q2"], Q_SQL["q2"])
register("q3_rejected_checks", on(*Q_TABLES["q3"])(analytics.rejected_checks), Q_TABLES["q3"], Q_SQL["q3"])
register("q4_name_audit", on(*Q_TABLES["q4"])(analytics.name_audit), Q_TABLES["q4"], Q_SQL["q4"])
register("q5_program_totals", on(*Q_TABLES["q5"])(analytics.programme_totals), Q_TABLES["q5"], Q_SQL["q5"])
register("q6_case_folding", on("master_penduduk")(lambda p: p.groupBy(analytics.folded(F.col("nama")).alias("folded")).agg(F.count("*").alias("n"), F.sum((F.col("nama") == F.upper("nama")).cast("int")).cast("bigint").alias("n_upper"))), ("master_penduduk",), "SELECT lower(nama) AS folded, count(*) AS n, CAST(sum(CASE WHEN nama = upper(nama) THEN 1 ELSE 0 END) AS BIGINT) AS n_upper FROM master_penduduk GROUP BY 1")

_P, _D, _K, _W, _E, _G, _T, _L = "MAP-PENERIMA", "MAP-PENDUDUK", "MAP-KELUARGA", "MAP-WILAYAH", "MAP-ELIGIBILITY", "MAP-PROGRAM", "MAP-TRANSAKSI", "LINK-PENERIMA-KE-DUKCAPIL"
PATTERNS = {
    "q1": [Pattern("a", "penerimaId", "penerima_id", _P), Pattern("a", "namaLengkap", "nama_lengkap", _P), Pattern("a", "memilikDataKependudukan", "b", _L), Pattern("b", "pekerjaan", "pekerjaan", _D), Pattern("b", "penghasilan", "penghasilan", _D)],
    "q2": [Pattern("a", "penerimaId", "penerima_id", _P), Pattern("a", "namaLengkap", "nama_lengkap", _P), Pattern("a", "memilikDataKependudukan", "b", _L), Pattern("b", "tergabungDalamKeluarga", "c", _D), Pattern("c", "berdomisiliDi", "d", _K), Pattern("d", "provinsi", None, _W, PROVINCE), Pattern("d", "kabupaten", "kabupaten", _W), Pattern("d", "kecamatan", "kecamatan", _W)],
    "q3": [Pattern("c", "checkId", "check_id", _E), Pattern("c", "statusEligible", None, _E, "TIDAK ELIGIBLE"), Pattern("c", "alasan", "alasan", _E), Pattern("c", "divalidasiDalam", "g", _E), Pattern("c", "validasiPenerima", "a", _E), Pattern("a", "namaLengkap", "nama_lengkap", _P), Pattern("g", "namaProgram", "nama_program", _G)],
    "q4": [Pattern("a", "nik", "nik", _P), Pattern("a", "namaLengkap", "nama_lengkap", _P), Pattern("a", "memilikDataKependudukan", "b", _L), Pattern("b", "namaPenduduk", "nama_penduduk", _D)],
    "q5": [Pattern("t", "statusTransaksi", None, _T, "TERSALURKAN"), Pattern("t", "terdaftarPadaProgram", "g", _T), Pattern("g", "namaProgram", "nama_program", _G), Pattern("g", "nominal", "nominal", _G)],
}
_SELECT = {"q1": "penerima_id nama_lengkap pekerjaan penghasilan", "q2": "penerima_id nama_lengkap kabupaten kecamatan", "q3": "check_id nama_lengkap nama_program alasan", "q4": "nik nama_lengkap nama_penduduk", "q5": "nama_program nominal"}


def pattern_query(spark: SparkSession, sf_dir: str, q: str) -> DataFrame:
    where = F.lower("nama_lengkap") != F.lower("nama_penduduk") if q == "q4" else None
    out = pattern_join(domain(spark, sf_dir), PATTERNS[q], _SELECT[q].split(), where)
    return out.groupBy("nama_program").agg(F.sum("nominal").cast("decimal(38,2)").alias("total_nominal")) if q == "q5" else out


for _q in PATTERNS:
    register(f"q0_pattern_{_q}", lambda spark, d, q=_q: pattern_query(spark, d, q), Q_TABLES[_q], Q_SQL[_q])

# ---- M1-M9, E1-E4 ----
_XSD = {"xsd:integer": "CAST(CAST({c} AS BIGINT) AS VARCHAR)", "xsd:decimal": "CAST(CAST({c} AS DECIMAL(38,2)) AS VARCHAR)", "xsd:string": "{c}", "xsd:boolean": "CAST({c} AS VARCHAR)"}
_MISSING = {("penerima_manfaat", "tgl_lahir"), ("master_penduduk", "tanggal_lahir")}  # the bindings have no dates of birth


def triples_sql(m: mapping.Mapping) -> str:
    s = f"'{scalars.RESOURCE}{m.kind}/' || CAST({m.key} AS VARCHAR)"
    row = lambda p, o, kind, t, c: f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {t} AS o_type FROM {m.table} WHERE {c} IS NOT NULL"
    out = [row(scalars.RDF_TYPE, f"'{scalars.ONTOLOGY}{m.cls}'", "iri", "CAST(NULL AS VARCHAR)", m.key)] if m.cls else []
    out += [row(scalars.ONTOLOGY + p, _XSD[t].format(c=c), "literal", f"'{t}'", c) for p, c, t in m.literals if (m.table, c) not in _MISSING]
    out += [row(scalars.ONTOLOGY + p, f"'{scalars.RESOURCE}{kind}/' || CAST({c} AS VARCHAR)", "iri", "CAST(NULL AS VARCHAR)", c) for p, kind, c in m.links]
    return "\nUNION ALL ".join(out)


GRAPH_SQL = "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join(triples_sql(m) for m in mapping.MAPPINGS) + ")"
for _m in mapping.MAPPINGS:
    register(f"m1_m8_{_m.id.lower().replace('-', '_')}", on(_m.table)(lambda df, m=_m: mapping.triples_of(df, m)), (_m.table,), triples_sql(_m))
register("m9_graph", lambda spark, d: mapping.triples(domain(spark, d)), DOMAIN, GRAPH_SQL)


def _with_subclass(spark: SparkSession, d: str) -> DataFrame:
    """The graph, with one type of programme asserted as a subclass, which the mappings never do."""
    tables = domain(spark, d)
    named = mapping.triples({"program_bansos": tables["program_bansos"]}).where((F.col("p") == scalars.ONTOLOGY + "programId") & F.col("o").endswith("7"))
    sub = named.select("s", F.lit(scalars.RDF_TYPE).alias("p"), F.lit(scalars.ONTOLOGY + "ProgramPKH").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"))
    return mapping.triples(tables).unionByName(sub)


_O = scalars.ONTOLOGY
_DOMAIN_OF = [(p, d) for p, (d, _) in entailment.OBJECT_PROPERTIES.items()] + [(p, c) for c, ps in entailment.DATATYPE_DOMAINS.items() for p in ps.split()]
_values = lambda rows: "(VALUES " + ", ".join(f"('{_O}{a}', '{_O}{b}')" for a, b in rows) + ")"
_GRAPH = f", graph AS ({GRAPH_SQL}), dom(p, cls) AS {_values(_DOMAIN_OF)}, ran(p, cls) AS {_values([(p, r) for p, (_, r) in entailment.OBJECT_PROPERTIES.items()])}"
_TYPE = f"'{scalars.RDF_TYPE}' AS p, cls AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type"
_INV = f"SELECT o AS s, '{_O}menerimaBansos' AS p, s AS o, o_kind, o_type FROM {{g}} WHERE p = '{_O}disalurkanKepada' UNION ALL SELECT o, '{_O}disalurkanKepada', s, o_kind, o_type FROM {{g}} WHERE p = '{_O}menerimaBansos'"
_SUB = f"SELECT s, '{scalars.RDF_TYPE}' AS p, '{_O}ProgramBansos' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type FROM {{g}} WHERE p = '{scalars.RDF_TYPE}' AND o IN ('{_O}ProgramPKH', '{_O}ProgramBPNT', '{_O}ProgramBST')"
register("e1_superclasses", lambda spark, d: entailment.superclasses(_with_subclass(spark, d)), DOMAIN, _SUB.format(g="g"), f", base AS ({GRAPH_SQL}), g AS (SELECT * FROM base UNION ALL SELECT s, '{scalars.RDF_TYPE}', '{_O}ProgramPKH', 'iri', NULL FROM base WHERE p = '{_O}programId' AND o LIKE '%7')")
register("e2_inverses", lambda spark, d: entailment.inverses(mapping.triples(domain(spark, d))), DOMAIN, _INV.format(g="graph"), _GRAPH)
register("e3_domains", lambda spark, d: entailment.domains_of_tables(domain(spark, d)), DOMAIN, f"SELECT DISTINCT s, {_TYPE} FROM graph JOIN dom USING (p)".replace("'iri' AS o_kind", "'iri' AS o_kind"), _GRAPH)
register("e4_ranges", lambda spark, d: entailment.ranges_of_tables(domain(spark, d)), DOMAIN, f"SELECT DISTINCT graph.o AS s, '{scalars.RDF_TYPE}' AS p, cls AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_type FROM graph JOIN ran USING (p) WHERE o_kind = 'iri'", _GRAPH)
register(
    "e1_e4_entailed", lambda spark, d: entailment.entailed_tables(domain(spark, d)), DOMAIN, f"SELECT DISTINCT * FROM (SELECT * FROM linked UNION ALL SELECT s, {_TYPE} FROM linked JOIN dom USING (p) UNION ALL SELECT linked.o, '{scalars.RDF_TYPE}', cls, 'iri', NULL FROM linked JOIN ran USING (p) WHERE o_kind = 'iri')",
    _GRAPH + f", linked AS (SELECT * FROM graph UNION ALL {_INV.format(g='graph')})",
)


# ---- Q0: the questions as they are written, over mappings and ontology; the SQL asks the whole entailed graph ----
_asked = lambda *rows: [Triple(*r) for r in rows]
_ON_RECIPIENT = (("?penerima", CLASS, "PenerimaBansos"), ("?penerima", "nik", "?nik"), ("?penerima", "memilikDataKependudukan", "?penduduk"))
#: Name to patterns, variables selected, and the types of those that are no text.
QUESTIONS = {
    "q1": (_asked(*_ON_RECIPIENT, ("?penerima", "namaLengkap", "?namaLengkap"), ("?penduduk", "pekerjaan", "?pekerjaan"), ("?penduduk", "penghasilan", "?penghasilan")), "nik namaLengkap pekerjaan penghasilan", {"penghasilan": "DECIMAL(38,2)"}),
    "q2": (
        _asked(*_ON_RECIPIENT, ("?penerima", "namaLengkap", "?nama"), ("?penduduk", "tergabungDalamKeluarga", "?kk"), ("?kk", "berdomisiliDi", "?wilayah"), ("?wilayah", "provinsi", PROVINCE), ("?wilayah", "desa", "?desa"), ("?wilayah", "kecamatan", "?kecamatan")),
        "nama nik desa kecamatan", {},
    ),
    "q3": (
        _asked(
            ("?check", CLASS, "EligibilityCheck"), ("?check", "statusEligible", "?status"), ("?check", "alasan", "?alasan"), ("?check", "validasiPenerima", "?penerima"), ("?check", "divalidasiDalam", "?prog"),
            ("?penerima", "namaLengkap", "?nama"), ("?prog", "namaProgram", "?program"),
        ),
        "nama program status alasan", {},
    ),
    "q4": (_asked(*_ON_RECIPIENT, ("?penerima", "namaLengkap", "?namaLengkap"), ("?penduduk", "namaPenduduk", "?namaDukcapil")), "nik namaLengkap namaDukcapil", {}),
    "q5": (
        _asked(("?transaksi", CLASS, "TransaksiBansos"), ("?transaksi", "terdaftarPadaProgram", "?prog"), ("?transaksi", "statusTransaksi", "TERSALURKAN"), ("?prog", "namaProgram", "?namaProgram"), ("?prog", "nominal", "?nominal")),
        "namaProgram nominal", {"nominal": "DECIMAL(38,2)"},
    ),
    # one property of two mappings; a property that only the ontology gives; a class that links give too; a class and a property apart
    "nik": (_asked(("?x", "nik", "?nik")), "x nik", {}),
    "received": (_asked(("?penerima", "menerimaBansos", "?t"), ("?t", "periodeTransaksi", "?periode"), ("?penerima", "statusEkonomi", "?status")), "penerima t periode status", {}),
    "residents": (_asked(("?x", CLASS, "Penduduk")), "x", {}),
    "twins": (_asked(("?x", CLASS, "Penduduk"), ("?x", "nik", "?nik"), ("?y", CLASS, "PenerimaBansos"), ("?y", "nik", "?nik")), "x y nik", {}),
}
_FILTERS = {"q3": ("status = 'TIDAK ELIGIBLE'", "status = 'TIDAK ELIGIBLE'"), "q4": ("lower(namaLengkap) != lower(namaDukcapil)",) * 2}


def question(spark: SparkSession, d: str, q: str) -> DataFrame:
    patterns, select, _ = QUESTIONS[q]
    out = answer(domain(spark, d), patterns, select.split(), F.expr(_FILTERS[q][0]) if q in _FILTERS else None)
    return out.groupBy("namaProgram").agg(F.sum("nominal").cast("decimal(38,2)").alias("totalDana")) if q == "q5" else out


def question_sql(q: str) -> str:
    """The patterns as self-joins of the entailed graph."""
    patterns, select, types = QUESTIONS[q]
    place: dict[str, tuple[str, ...]] = {}
    tests = []
    for i, t in enumerate(patterns):
        tests.append(f"t{i}.p = '{scalars.RDF_TYPE if t.p == CLASS else _O + t.p}'")
        for term, cols in ((t.s, (f"t{i}.s", "'iri'", "''")), (t.o, (f"t{i}.o", f"t{i}.o_kind", f"coalesce(t{i}.o_type, '')"))):
            if t.p == CLASS and term is t.o:
                tests.append(f"t{i}.o = '{_O}{term}'")
            elif not str(term).startswith("?"):
                tests.append(f"t{i}.o = '{term}' AND t{i}.o_kind = 'literal'")
            elif term in place:
                tests += [f"{a} = {b}" for a, b in zip(place[term], cols, strict=True)]
            else:
                place[term] = cols
    shown = ", ".join(f"CAST({place['?' + v][0]} AS {types.get(v, 'VARCHAR')}) AS {v}" for v in select.split())
    sql = f"SELECT {shown} FROM {', '.join(f'ent t{i}' for i in range(len(patterns)))} WHERE {' AND '.join(tests)}"
    sql = f"SELECT * FROM ({sql}) WHERE {_FILTERS[q][1]}" if q in _FILTERS else sql
    return f"SELECT namaProgram, CAST(sum(nominal) AS DECIMAL(38,2)) AS totalDana FROM ({sql}) GROUP BY 1" if q == "q5" else sql


_ENT = ORACLES["e1_e4_entailed"].rsplit("\nSELECT DISTINCT", 1)
for _q in QUESTIONS:
    register(f"q0_question_{_q}", lambda spark, d, q=_q: question(spark, d, q))
    ORACLES[f"q0_question_{_q}"] = f"{_ENT[0]}, ent AS MATERIALIZED (SELECT DISTINCT{_ENT[1]})\n{question_sql(_q)}"

# ---- D1-D10 ----
_CAT = ("captured_tables_ref", "ddl_column_snapshot", "catalog_columns")
_COLS = "db_name, table_name, column_name, column_type, ordinal_pos"
_on = lambda a, b, *cs: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cs)
_KEYS, _PLACE = ("db_name", "table_name", "column_name"), ("db_name", "table_name", "ordinal_pos", "column_type")
_DIFF = f""", act AS (SELECT DISTINCT db_name, table_name FROM captured_tables_ref WHERE is_active),
gone AS (SELECT s.* FROM ddl_column_snapshot s JOIN act USING (db_name, table_name) WHERE NOT EXISTS (SELECT 1 FROM catalog_columns c WHERE {_on("s", "c", *_KEYS)})),
fresh AS (SELECT c.* FROM catalog_columns c JOIN act USING (db_name, table_name) WHERE NOT EXISTS (SELECT 1 FROM ddl_column_snapshot s WHERE {_on("s", "c", *_KEYS)})),
pairs AS (SELECT g.db_name, g.table_name, g.ordinal_pos, g.column_type, g.column_name AS old_column, f.column_name AS new_column FROM gone g JOIN fresh f ON {_on("g", "f", *_PLACE)}),
drops AS (SELECT * FROM gone g WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE {_on("g", "f", *_PLACE)})),
adds AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {_on("g", "f", *_PLACE)}))"""


def _diff(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    refs, snapshot, catalog = (bound(spark, d, n) for n in _CAT)
    return refs, snapshot, catalog, catalog_diff.vanished(snapshot, catalog, refs), catalog_diff.appeared(snapshot, catalog, refs)


def _events(spark: SparkSession, d: str) -> DataFrame:
    *_, gone, new = _diff(spark, d)
    return catalog_diff.events(catalog_diff.renames(gone, new), catalog_diff.pure_drops(gone, new), catalog_diff.pure_adds(gone, new))


_HEAD = "'ALTER TABLE `' || db_name || '`.`' || table_name || '`"
_EVENTS_SQL = f"""SELECT 'event_scheduler' AS username, db_name, table_name, 'RENAME COLUMN' AS alter_type, old_column || ' -> ' || new_column AS column_name, {_HEAD} RENAME COLUMN `' || old_column || '` TO `' || new_column || '`' AS ddl_command FROM pairs
UNION ALL SELECT 'event_scheduler', db_name, table_name, 'DROP COLUMN', column_name, {_HEAD} DROP COLUMN `' || column_name || '`' FROM drops
UNION ALL SELECT 'event_scheduler', db_name, table_name, 'ADD COLUMN', column_name, {_HEAD} ADD COLUMN `' || column_name || '` ' || column_type FROM adds"""
register("d1_baseline", on("catalog_columns", "captured_tables_ref")(catalog_diff.baseline), _CAT, f"SELECT {_COLS} FROM catalog_columns JOIN act USING (db_name, table_name)", _DIFF)
register("d2_vanished", lambda s, d: _diff(s, d)[3], _CAT, f"SELECT {_COLS} FROM gone", _DIFF)
register("d3_appeared", lambda s, d: _diff(s, d)[4], _CAT, f"SELECT {_COLS} FROM fresh", _DIFF)
register("d4_renames", lambda s, d: catalog_diff.renames(*_diff(s, d)[3:]), _CAT, "SELECT db_name, table_name, ordinal_pos, column_type, old_column, new_column, count(*) OVER (PARTITION BY db_name, table_name, ordinal_pos, column_type) > 1 AS ambiguous FROM pairs", _DIFF)
register("d5_pure_drops", lambda s, d: catalog_diff.pure_drops(*_diff(s, d)[3:]), _CAT, f"SELECT {_COLS} FROM drops", _DIFF)
register("d6_pure_adds", lambda s, d: catalog_diff.pure_adds(*_diff(s, d)[3:]), _CAT, f"SELECT {_COLS} FROM adds", _DIFF)
register("d7_d8_events", _events, _CAT, _EVENTS_SQL, _DIFF)
register("d9_without_vanished", lambda s, d: catalog_diff.without(_diff(s, d)[1], _diff(s, d)[3]), _CAT, f"SELECT {_COLS} FROM ddl_column_snapshot s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {_on('s', 'g', *_KEYS)})", _DIFF)


def _next_snapshot(s: SparkSession, d: str) -> DataFrame:
    _, snapshot, _, gone, new = _diff(s, d)
    return catalog_diff.with_new(catalog_diff.without(snapshot, gone), new)


register("d10_next_snapshot", _next_snapshot, _CAT, f"SELECT {_COLS} FROM ddl_column_snapshot s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE {_on('s', 'g', *_KEYS)}) UNION ALL SELECT {_COLS} FROM fresh", _DIFF)

# ---- L1-L9, R1-R4 ----
_LOG = ("ddl_event_log",)
_RAW = ", raw AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE 'user' END AS username, CASE WHEN id % 2 = 0 THEN 'db0' ELSE '' END AS db_name, 't_' || CAST(id % 40 AS VARCHAR) AS table_name, ' ' || lower(alter_type) || ' ' AS alter_type, 'col' AS column_name, ddl_command FROM ddl_event_log)"


def _raw(s: SparkSession, d: str) -> DataFrame:
    """Captured events with gaps: no user, no database, types in lower case with blanks."""
    return bound(s, d, "ddl_event_log").select(
        "id", F.expr("CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN NULL ELSE 'user' END").alias("username"), F.expr("CASE WHEN id % 2 = 0 THEN 'db0' ELSE '' END").alias("db_name"),
        F.expr("'t_' || CAST(id % 40 AS STRING)").alias("table_name"), F.expr("' ' || lower(alter_type) || ' '").alias("alter_type"), F.lit("col").alias("column_name"), "ddl_command",
    )


_CAPTURED = "SELECT id, coalesce(nullif(username, ''), 'system') AS username, coalesce(nullif(db_name, ''), 'db1') AS db_name, table_name, upper(trim(alter_type)) AS alter_type, column_name, ddl_command FROM raw WHERE upper(trim(alter_type)) IN ('ADD COLUMN', 'DROP COLUMN', 'RENAME COLUMN')"
_CAPTURE = lambda s, d: ddl_events.captured(_raw(s, d), "system", "db1")
_REF = "LEFT JOIN (SELECT DISTINCT db_name, table_name FROM captured_tables_ref WHERE is_active) r ON c.db_name = r.db_name AND c.table_name = r.table_name"
register("l1_l2_captured", _CAPTURE, _LOG, _CAPTURED, _RAW)
register("l3_manual_rejected", lambda s, d: ddl_events.manual(_raw(s, d))[1].select("id", "alter_type"), _LOG, "SELECT id, alter_type FROM raw WHERE upper(trim(alter_type)) NOT IN ('ADD COLUMN', 'DROP COLUMN', 'RENAME COLUMN')", _RAW)
register("l4_regulated", lambda s, d: ddl_events.regulated(_CAPTURE(s, d), bound(s, d, "captured_tables_ref")).select("id", "db_name", "table_name", "is_regulated"), (*_LOG, "captured_tables_ref"), f"SELECT c.id, c.db_name, c.table_name, r.table_name IS NOT NULL AS is_regulated FROM captured c {_REF}", _RAW + f", captured AS ({_CAPTURED})")
register("l5_log_rows", lambda s, d: ddl_events.log_rows(_CAPTURE(s, d), bound(s, d, "captured_tables_ref")), (*_LOG, "captured_tables_ref"), f"SELECT c.username, c.db_name, c.table_name, c.db_name || '.' || c.table_name AS object_tag, 'ALTER TABLE' AS command_tag, c.alter_type, c.column_name, c.ddl_command, r.table_name IS NOT NULL AS is_regulated FROM captured c {_REF}", _RAW + f", captured AS ({_CAPTURED})")


def _commands(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "ddl_event_log").select("id", F.expr("CASE WHEN id % 6 = 0 THEN 'CREATE TABLE' ELSE 'ALTER TABLE' END").alias("command_tag"), F.expr("'public.' || table_name").alias("object_identity"), F.expr("CASE WHEN id % 4 = 0 THEN lower(ddl_command) ELSE ddl_command END").alias("ddl_command"))


_COMMANDS = ", commands AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'CREATE TABLE' ELSE 'ALTER TABLE' END AS command_tag, 'public.' || table_name AS object_identity, CASE WHEN id % 4 = 0 THEN lower(ddl_command) ELSE ddl_command END AS ddl_command FROM ddl_event_log), kinds AS (SELECT *, CASE WHEN contains(upper(ddl_command), 'RENAME COLUMN') THEN 'RENAME COLUMN' WHEN contains(upper(ddl_command), 'ADD COLUMN') THEN 'ADD COLUMN' WHEN contains(upper(ddl_command), 'DROP COLUMN') THEN 'DROP COLUMN' END AS alter_type FROM commands)"
register(
    "l6_l9_from_commands", lambda s, d: ddl_events.from_commands(_commands(s, d)).select("id", "alter_type", "table_name", "column_name"), _LOG,
    "SELECT id, alter_type, split_part(object_identity, '.', 2) AS table_name, split_part(trim(split_part(regexp_replace(ddl_command, '\\s+', ' ', 'g'), alter_type || ' ', 2)), ' ', 1) AS column_name FROM kinds WHERE command_tag = 'ALTER TABLE' AND alter_type IS NOT NULL", _COMMANDS,
)
_LOG_COLS = "id, captured_at, table_name, alter_type, is_regulated, op, ddl_command"
register("r1_newest", on(*_LOG)(ddl_events.newest), _LOG, f"SELECT {_LOG_COLS} FROM ddl_event_log ORDER BY captured_at DESC, id DESC")
register("r2_newest_regulated", on(*_LOG)(ddl_events.newest_regulated), _LOG, "SELECT id, table_name, alter_type, ddl_command, captured_at FROM ddl_event_log WHERE is_regulated ORDER BY captured_at DESC, id DESC")
register("r3_by_type", on(*_LOG)(ddl_events.by_type), _LOG, "SELECT alter_type, count(*) AS total FROM ddl_event_log GROUP BY alter_type")
register("r4_snapshot_in_order", on("ddl_column_snapshot")(ddl_events.in_order), ("ddl_column_snapshot",), f"SELECT {_COLS} FROM ddl_column_snapshot ORDER BY db_name, table_name, ordinal_pos")

# ---- K1-K12, F1-F5 ----


def messages(s: SparkSession, d: str) -> DataFrame:
    """The event log as messages: wrapped, bare and flat by turns, some malformed, some with a null `after`."""
    log = bound(s, d, "ddl_event_log")
    event = F.struct(F.col("id"), F.col("table_name"), F.col("ddl_command"), F.col("is_regulated"))
    number = F.struct(F.col("id"), F.col("table_name"), F.col("ddl_command"), F.col("is_regulated").cast("int").alias("is_regulated"))
    record = F.struct(event.alias("after"), F.col("op"))
    text = F.when(F.col("id") % 23 == 0, F.lit("{bad")).when(F.col("id") % 29 == 0, F.lit('{"after": null, "op": "c"}')).when(F.col("id") % 3 == 0, F.to_json(F.struct(record.alias("payload")))).when(F.col("id") % 3 == 1, F.to_json(record)).otherwise(F.to_json(number))
    return log.select(F.lit("log").alias("topic"), text.alias("value"))


_MSG = ", msg AS (SELECT *, CASE WHEN id % 3 = 2 THEN 'c' ELSE op END AS mop FROM ddl_event_log WHERE id % 23 <> 0 AND id % 29 <> 0), live AS (SELECT * FROM msg WHERE mop <> 'd'), act AS (SELECT * FROM live WHERE is_regulated)"
_FLAT = "regexp_replace(ddl_command, '\\s+', ' ', 'g')"
_PARSED = f""", parsed AS (SELECT id, mop, ddl_command, table_name AS tbl,
 CASE WHEN regexp_matches(f, '^ALTER TABLE (\\S+) ADD COLUMN (\\S+) (.+)$') THEN 'ADD COLUMN' WHEN regexp_matches(f, '^ALTER TABLE (\\S+) DROP COLUMN (\\S+)') THEN 'DROP COLUMN' WHEN regexp_matches(f, '^ALTER TABLE (\\S+) RENAME COLUMN (\\S+) TO (\\S+)') THEN 'RENAME COLUMN' END AS alter_type, f
 FROM (SELECT *, {_FLAT} AS f FROM act)),
 cut AS (SELECT id, mop, alter_type, regexp_extract(replace(f, '`', ''), '^ALTER TABLE [^. ]+[.](\\S+) ', 1) AS table_name,
 CASE WHEN alter_type IN ('ADD COLUMN', 'DROP COLUMN') THEN regexp_extract(replace(f, '`', ''), ' COLUMN (\\S+)', 1) END AS column_name,
 CASE WHEN alter_type = 'ADD COLUMN' THEN regexp_extract(f, ' ADD COLUMN \\S+ (.+)$', 1) END AS column_type,
 CASE WHEN alter_type = 'RENAME COLUMN' THEN regexp_extract(replace(f, '`', ''), ' RENAME COLUMN (\\S+)', 1) END AS old_column,
 CASE WHEN alter_type = 'RENAME COLUMN' THEN regexp_extract(replace(f, '`', ''), ' TO (\\S+)', 1) END AS new_column FROM parsed WHERE alter_type IS NOT NULL),
 meta(table_name, mapping_id, class, model) AS (VALUES {", ".join(str(r) for r in changes.TABLES)})"""
register("k1_malformed", lambda s, d: changes.decoded(messages(s, d))[1].select("topic", "value"), _LOG, "SELECT 'log' AS topic, '{bad' AS value FROM ddl_event_log WHERE id % 23 = 0")
register("k1_k3_live", lambda s, d: changes.live(changes.unwrapped(changes.decoded(messages(s, d))[0])).select(F.col("id").cast("bigint").alias("id"), "op", "table_name", "ddl_command"), _LOG, "SELECT id, mop AS op, table_name, ddl_command FROM live", _MSG)
register("k4_k5_actionable", lambda s, d: changes.actionable(changes.live(changes.unwrapped(changes.decoded(messages(s, d))[0]))).select(F.col("id").cast("bigint").alias("id"), "ddl_command"), _LOG, "SELECT id, ddl_command FROM act", _MSG)
_K_COLS = ["alter_type", "table_name", "column_name", "column_type", "old_column", "new_column"]


def planned(s: SparkSession, d: str) -> DataFrame:
    return changes.processed(messages(s, d)).withColumn("id", F.col("id").cast("bigint"))


register("k6_k7_parsed", on(*_LOG)(lambda log: ddl_events.parsed(log.select("id", "ddl_command")).select("id", *[F.col(f"parsed_{c.split('_')[1] if c == 'alter_type' else c.split('_')[0]}" if c in ("alter_type", "table_name", "column_name") else c).alias(c) for c in _K_COLS])), _LOG, f"SELECT id, {', '.join(_K_COLS)} FROM cut", _MSG.replace("WHERE is_regulated)", ")").replace("WHERE id % 23 <> 0 AND id % 29 <> 0", "").replace("WHERE mop <> 'd'", "") + _PARSED)
register("k8_k9_enriched", lambda s, d: planned(s, d).select("id", *_K_COLS, "pattern_id", "mapping_id", "class", "model", "semantic_impact"), _LOG, f"SELECT id, {', '.join(_K_COLS)}, CASE alter_type WHEN 'ADD COLUMN' THEN 'P-001' WHEN 'DROP COLUMN' THEN 'P-002' ELSE 'P-003' END AS pattern_id, mapping_id, class, model, CASE alter_type WHEN 'RENAME COLUMN' THEN 'LOW' ELSE 'HIGH' END AS semantic_impact FROM cut JOIN meta USING (table_name)", _MSG + _PARSED)
register("k9_skipped", lambda s, d: changes.enriched(changes.actionable(changes.live(changes.unwrapped(changes.decoded(messages(s, d))[0]))))[1].select(F.col("id").cast("bigint").alias("id"), "table_name", "alter_type"), _LOG, "SELECT id, table_name, alter_type FROM cut WHERE table_name NOT IN (SELECT table_name FROM meta)", _MSG + _PARSED)
register("k10_plan", lambda s, d: planned(s, d).select("id", "mapping_changed", "ontology_changed", "federation_changed", "reload_scope"), _LOG, "SELECT id, true AS mapping_changed, alter_type <> 'RENAME COLUMN' AS ontology_changed, true AS federation_changed, 'all' AS reload_scope FROM cut JOIN meta USING (table_name)", _MSG + _PARSED)
register("k11_deduplicated", lambda s, d: planned(s, d).unionByName(planned(s, d)).dropDuplicates(["topic", "id"]).groupBy("mapping_id").agg(F.count("*").alias("n"), F.max("id").alias("last_id")), _LOG, "SELECT mapping_id, count(*) AS n, max(id) AS last_id FROM cut JOIN meta USING (table_name) GROUP BY mapping_id", _MSG + _PARSED)
_STEP = "{'physical': %s, 'logical': c.logical, 'type': c.type, 'active': %s}"
_HAS = "len(list_filter(cols, lambda c: c.active AND c.physical = ev.%s)) > 0"
_FOLD = _PARSED + f""", ev AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY id) AS k FROM cut JOIN meta USING (table_name)),
 st AS (SELECT DISTINCT table_name, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(physical VARCHAR, logical VARCHAR, type VARCHAR, active BOOLEAN)[]) AS cols FROM ev
 UNION ALL SELECT st.table_name, ev.k, CASE WHEN alter_type = 'ADD COLUMN' AND {_HAS % 'column_name'} OR alter_type = 'RENAME COLUMN' AND {_HAS % 'new_column'} THEN cols
 WHEN alter_type = 'ADD COLUMN' THEN list_append(cols, {{'physical': ev.column_name, 'logical': ev.column_name, 'type': ev.column_type, 'active': true}})
 WHEN alter_type = 'DROP COLUMN' THEN list_transform(cols, lambda c: {_STEP % ('c.physical', 'c.active AND c.physical <> ev.column_name')})
 ELSE list_transform(cols, lambda c: {_STEP % ('CASE WHEN c.active AND c.physical = ev.old_column THEN ev.new_column ELSE c.physical END', 'c.active')}) END
 FROM st JOIN ev ON st.table_name = ev.table_name AND ev.k = st.k + 1),
 whole AS (SELECT table_name, count(*) AS n_applied, max(id) AS last_id FROM ev GROUP BY 1),
 cols AS (SELECT table_name, unnest(cols) AS c, generate_subscripts(cols, 1) AS i, last_id, n_applied FROM st JOIN whole USING (table_name) WHERE k = n_applied)"""
register("k12_fold", lambda s, d: fold.fold(planned(s, d)), _LOG, "SELECT table_name, CAST(i AS INTEGER) AS ordinal, c.physical, c.logical, c.type, c.active, last_id, n_applied FROM cols", _MSG + _FOLD)
ORACLES["k12_fold"] = ORACLES["k12_fold"].replace("WITH ", "WITH RECURSIVE ", 1)

#: What the seven mapped tables have before the first event: columns with source types, and the properties that bind them.
_SOURCE_TYPE = {"string": "varchar(255)"}
BASE_COLUMNS = [(t, i, c, _SOURCE_TYPE.get(k, k)) for t, _, _, model in changes.TABLES for i, (c, k) in enumerate(FEDERATED[model][t].items(), 1)]
BASE_PROPERTIES = [(t, p, c, x) for t, m, _, _ in changes.TABLES for p, c, x in mapping.BY_ID[m].literals]


def _layers(s: SparkSession, d: str) -> DataFrame:
    """Federation, projection, mapping and ontology after all events, one below the other."""
    columns = s.createDataFrame(BASE_COLUMNS, "table_name string, ordinal int, name string, type string")
    properties = s.createDataFrame(BASE_PROPERTIES, "table_name string, property string, binding string, xsd string")
    out = fold.layers(planned(s, d), changes.table_metadata(s), columns, properties)
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, layer, owner, place, name, value, kind, gone: df.select(F.lit(layer).alias("layer"), owner.alias("owner"), place.alias("place"), F.col(name).alias("name"), value.alias("value"), kind.alias("kind"), gone.alias("deprecated"))
    parts = [
        row(out.federation, "federation", F.concat_ws(".", "model", "table_name"), F.col("ordinal"), "name", none("string"), F.col("type"), none("boolean")),
        row(out.projection, "projection", F.col("mapping_id"), F.col("ordinal"), "physical", F.col("logical"), none("string"), none("boolean")),
        row(out.mapping, "mapping", F.col("mapping_id"), none("int"), "property", F.col("binding"), F.col("xsd"), none("boolean")),
        row(out.ontology, "ontology", F.col("domain"), none("int"), "property", F.col("label"), F.col("range"), F.col("deprecated")),
    ]
    return reduce(DataFrame.unionByName, parts)


_sql_rows = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_COL = "{'physical': %s, 'logical': c.logical, 'type': c.type, 'added': c.added, 'dropped': %s}"
_LIVE = "len(list_filter(cols, lambda c: c.dropped IS NULL AND c.physical = ev.%s)) > 0"
# scalars.property_name, label and the type maps over names such as col_3 and col_12_kode_pos
_CAMEL = "array_to_string(list_transform(string_split({0}, '_'), lambda w, i: CASE WHEN i = 1 THEN w ELSE upper(left(w, 1)) || substr(w, 2) END), '')"
_KIND = "CASE trim(split_part(lower({0}), '(', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.XSD.items()) + " ELSE 'xsd:string' END"
_FED_KIND = "CASE trim(split_part(lower({0}), '(', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalars.FEDERATION.items()) + " ELSE 'string' END"
_LAYERS = _PARSED + f""", base(table_name, ordinal, name, type) AS (VALUES {_sql_rows(BASE_COLUMNS)}), bound(table_name, property, binding, xsd) AS (VALUES {_sql_rows(BASE_PROPERTIES)}),
 ev AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY id) AS k FROM cut JOIN meta USING (table_name)),
 st AS (SELECT table_name, CAST(0 AS BIGINT) AS k, list({{'physical': name, 'logical': name, 'type': type, 'added': (ordinal - 1000000)::BIGINT, 'dropped': NULL::BIGINT}} ORDER BY ordinal) AS cols FROM base GROUP BY table_name
 UNION ALL SELECT st.table_name, ev.k, CASE WHEN alter_type = 'ADD COLUMN' AND {_LIVE % 'column_name'} OR alter_type = 'RENAME COLUMN' AND {_LIVE % 'new_column'} THEN cols
 WHEN alter_type = 'ADD COLUMN' THEN list_append(cols, {{'physical': ev.column_name, 'logical': ev.column_name, 'type': ev.column_type, 'added': ev.id::BIGINT, 'dropped': NULL::BIGINT}})
 WHEN alter_type = 'DROP COLUMN' THEN list_transform(cols, lambda c: {_COL % ('c.physical', 'CASE WHEN c.dropped IS NULL AND c.physical = ev.column_name THEN ev.id::BIGINT ELSE c.dropped END')})
 ELSE list_transform(cols, lambda c: {_COL % ('CASE WHEN c.dropped IS NULL AND c.physical = ev.old_column THEN ev.new_column ELSE c.physical END', 'c.dropped')}) END
 FROM st JOIN ev ON st.table_name = ev.table_name AND ev.k = st.k + 1),
 ends AS (SELECT base.table_name, coalesce(max(ev.k), 0) AS k FROM (SELECT DISTINCT table_name FROM base) base LEFT JOIN ev USING (table_name) GROUP BY 1),
 h AS (SELECT table_name, model, mapping_id, class, unnest(cols) AS c FROM st JOIN ends USING (table_name, k) JOIN meta USING (table_name)),
 live_ AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY c.added)::INTEGER AS place FROM h WHERE c.dropped IS NULL),
 moves AS (SELECT table_name, property, binding, xsd, -1000000 AS moment, true AS comes FROM bound UNION ALL SELECT table_name, {_CAMEL.format('c.logical')}, c.logical, {_KIND.format('c.type')}, c.added, true FROM h WHERE c.added > 0
 UNION ALL SELECT table_name, {_CAMEL.format('c.logical')}, c.logical, NULL, c.dropped, false FROM h WHERE c.dropped IS NOT NULL),
 seen AS (SELECT *, max(CASE WHEN NOT comes THEN moment END) OVER (PARTITION BY table_name, property) AS gone FROM moves JOIN meta USING (table_name)),
 map_ AS (SELECT mapping_id, property, arg_min(binding, moment) AS binding, arg_min(xsd, moment) AS xsd FROM seen WHERE comes AND (gone IS NULL OR moment > gone) GROUP BY ALL),
 onto AS (SELECT property, arg_min(class, {{'m': moment, 't': table_name}}) FILTER (comes) AS class, arg_min(xsd, {{'m': moment, 't': table_name}}) FILTER (comes) AS xsd, bool_or(NOT comes) AS deprecated FROM seen GROUP BY property)"""
_LABELLED = "array_to_string(list_transform(string_split(regexp_replace(property, '([a-z])([A-Z])', '\\1 \\2', 'g'), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
register(
    "k12_layers", _layers, _LOG, f"""SELECT 'federation' AS layer, model || '.' || table_name AS owner, place, c.physical AS name, CAST(NULL AS VARCHAR) AS value, {_FED_KIND.format('c.type')} AS kind, CAST(NULL AS BOOLEAN) AS deprecated FROM live_
UNION ALL SELECT 'projection', mapping_id, place, c.physical, c.logical, NULL, NULL FROM live_ UNION ALL SELECT 'mapping', mapping_id, NULL, property, binding, xsd, NULL FROM map_
UNION ALL SELECT 'ontology', class, NULL, property, {_LABELLED}, xsd, deprecated FROM onto""", _MSG + _LAYERS,
)
ORACLES["k12_layers"] = ORACLES["k12_layers"].replace("WITH ", "WITH RECURSIVE ", 1)
_TYPES = ", t AS (SELECT DISTINCT column_type FROM catalog_columns UNION SELECT * FROM (VALUES ('VARCHAR(9)'), ('double precision'), ('BOOLEAN'), ('Timestamp (3)'), ('int unsigned')))"


def _types(s: SparkSession, d: str) -> DataFrame:
    return bound(s, d, "catalog_columns").select("column_type").distinct().unionByName(s.createDataFrame([("VARCHAR(9)",), ("double precision",), ("BOOLEAN",), ("Timestamp (3)",), ("int unsigned",)], "column_type string"))


_case = lambda names, default: "CASE trim(split_part(lower(column_type), '(', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{default}' END"
register("f1_f2_types", lambda s, d: _types(s, d).select("column_type", scalars.xsd_type(F.col("column_type")).alias("xsd"), scalars.federation_type(F.col("column_type")).alias("federation")), ("catalog_columns",), f"SELECT column_type, {_case(scalars.XSD, 'xsd:string')} AS xsd, {_case(scalars.FEDERATION, 'string')} AS federation FROM t", _TYPES)
register("f3_f5_names", on("catalog_columns")(lambda c: c.select("column_name", scalars.property_name(F.col("column_name")).alias("property"), scalars.full_iri(scalars.property_name(F.col("column_name"))).alias("iri"), scalars.label(scalars.property_name(F.regexp_replace("column_name", "[0-9]", ""))).alias("label")).distinct()), ("catalog_columns",), f"SELECT DISTINCT column_name, p AS property, '{_O}' || p AS iri, CASE WHEN column_name LIKE '%_new' THEN upper(left(column_name, 1)) || ' New' ELSE upper(left(column_name, 1)) END AS label FROM (SELECT column_name, CASE WHEN column_name LIKE '%_new' THEN replace(replace(column_name, '_new', 'New'), '_', '') ELSE replace(column_name, '_', '') END AS p FROM catalog_columns)")

# ---- P1-P13 ----


def state(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The metadata tables of all snapshot columns: a mapping for each table, a property for each column."""
    c = bound(s, d, "ddl_column_snapshot").withColumn("mapping_id", F.concat_ws(".", "db_name", "table_name")).withColumn("property", scalars.property_name(F.col("column_name")))
    kind = F.col("column_type")
    return {
        "fed": c.select(F.col("db_name").alias("model"), "table_name", F.col("ordinal_pos").alias("ordinal"), F.col("column_name").alias("name"), scalars.federation_type(kind).alias("type")),
        "source": c.select("mapping_id", F.col("ordinal_pos").alias("ordinal"), F.col("column_name").alias("physical"), F.col("column_name").alias("logical")),
        "target": c.select("mapping_id", "property", F.col("column_name").alias("binding"), scalars.xsd_type(kind).alias("xsd")),
        "onto": c.select("property", F.col("table_name").alias("domain"), scalars.xsd_type(kind).alias("range"), scalars.label(F.col("property")).alias("label"), F.lit(False).alias("deprecated")),
    }


def changes_of(s: SparkSession, d: str) -> DataFrame:
    """The catalog diff as enriched events; ambiguous renames are left to a person."""
    *_, gone, new = _diff(s, d)
    none = F.lit(None).cast("string")
    one = lambda df, kind, c, t, old, fresh: df.select(F.lit(f"{kind} COLUMN").alias("alter_type"), F.col("db_name").alias("model"), "table_name", F.concat_ws(".", "db_name", "table_name").alias("mapping_id"), F.col("table_name").alias("class"), c.alias("column_name"), t.alias("column_type"), old.alias("old_column"), fresh.alias("new_column"))
    col = F.col("column_name")
    out = one(catalog_diff.pure_adds(gone, new), "ADD", col, F.col("column_type"), none, none).unionByName(one(catalog_diff.pure_drops(gone, new), "DROP", col, none, none, none))
    return out.unionByName(one(catalog_diff.renames(gone, new).where("not ambiguous"), "RENAME", none, none, F.col("old_column"), F.col("new_column")))


def on_state(f: Callable[..., DataFrame], *frames: str) -> Query:
    return lambda s, d: f(*[state(s, d)[n] for n in frames], changes_of(s, d))


_FED = "CASE column_type WHEN 'varchar(100)' THEN 'string' WHEN 'int' THEN 'integer' WHEN 'bigint' THEN 'long' ELSE 'bigdecimal' END"
_XS = "CASE column_type WHEN 'varchar(100)' THEN 'xsd:string' WHEN 'int' THEN 'xsd:integer' WHEN 'bigint' THEN 'xsd:integer' ELSE 'xsd:decimal' END"
_PROP = "CASE WHEN column_name LIKE '%_new' THEN replace(replace(column_name, '_new', 'New'), '_', '') ELSE replace(column_name, '_', '') END"
_LABEL = "CASE WHEN column_name LIKE '%_new' THEN upper(left(column_name, 1)) || replace(substr(column_name, 3), '_new', '') || 'New' ELSE upper(left(column_name, 1)) || substr(column_name, 3) END"
_MORE = _DIFF + f""", snap AS (SELECT *, db_name || '.' || table_name AS mapping_id, {_PROP} AS property FROM ddl_column_snapshot),
uniq AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY db_name, table_name, ordinal_pos, column_type) AS n FROM pairs) WHERE n = 1),
newc AS (SELECT *, db_name || '.' || table_name AS mapping_id, {_PROP} AS property FROM adds),
last AS (SELECT db_name, table_name, max(ordinal_pos) AS top FROM ddl_column_snapshot GROUP BY 1, 2),
placed AS (SELECT n.*, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY n.db_name, n.table_name ORDER BY n.column_name) AS INTEGER) AS ordinal FROM newc n LEFT JOIN last USING (db_name, table_name))"""
_DROPPED = "EXISTS (SELECT 1 FROM drops d WHERE d.db_name = s.db_name AND d.table_name = s.table_name AND d.column_name = s.column_name)"
_FED_ROW, _SRC_ROW = f"db_name AS model, table_name, ordinal_pos AS ordinal, column_name AS name, {_FED} AS type", "mapping_id, ordinal_pos AS ordinal, column_name AS physical, column_name AS logical"
_ONTO_ROW = f"property, table_name AS domain, {_XS} AS range, {_LABEL} AS label"
register("p1_add_federated", on_state(evolve.add_federated, "fed"), _CAT, f"SELECT {_FED_ROW} FROM snap UNION ALL SELECT db_name, table_name, ordinal, column_name, {_FED} FROM placed", _MORE)
register("p2_add_mapping_target", on_state(evolve.add_mapping_target, "target"), _CAT, f"SELECT mapping_id, property, column_name AS binding, {_XS} AS xsd FROM snap UNION ALL SELECT mapping_id, property, column_name, {_XS} FROM newc", _MORE)
register("p2_add_mapping_source", on_state(evolve.add_mapping_source, "source"), _CAT, f"SELECT {_SRC_ROW} FROM snap UNION ALL SELECT mapping_id, ordinal, column_name, column_name FROM placed", _MORE)
register("p3_add_ontology", on_state(evolve.add_ontology, "onto"), _CAT, f"SELECT {_ONTO_ROW}, false AS deprecated FROM snap UNION ALL SELECT {_ONTO_ROW}, false FROM newc", _MORE)
register("p4_drop_federated", on_state(evolve.drop_federated, "fed"), _CAT, f"SELECT {_FED_ROW} FROM snap s WHERE NOT {_DROPPED}", _MORE)
register("p5_drop_mapping_target", on_state(evolve.drop_mapping_target, "target", "source"), _CAT, f"SELECT mapping_id, property, column_name AS binding, {_XS} AS xsd FROM snap s WHERE NOT {_DROPPED}", _MORE)
register("p5_drop_mapping_source", on_state(evolve.drop_mapping_source, "source"), _CAT, f"SELECT {_SRC_ROW} FROM snap s WHERE NOT {_DROPPED}", _MORE)
register("p6_deprecate", lambda s, d: evolve.deprecate(state(s, d)["onto"], evolve.dropped_properties(state(s, d)["target"], state(s, d)["source"], changes_of(s, d))), _CAT, f"SELECT {_ONTO_ROW}, {_DROPPED} AS deprecated FROM snap s", _MORE)
_RENAMED = "LEFT JOIN uniq u ON s.db_name = u.db_name AND s.table_name = u.table_name AND s.column_name = u.old_column"
register("p7_rename_source", on_state(evolve.rename_source, "source"), _CAT, f"SELECT s.mapping_id, s.ordinal_pos AS ordinal, coalesce(u.new_column, s.column_name) AS physical, s.column_name AS logical FROM snap s {_RENAMED}", _MORE)
register("p8_rename_federated", on_state(evolve.rename_federated, "fed"), _CAT, f"SELECT s.db_name AS model, s.table_name, s.ordinal_pos AS ordinal, coalesce(u.new_column, s.column_name) AS name, {_FED.replace('column_type', 's.column_type')} AS type FROM snap s {_RENAMED}", _MORE)
register("p9_column_lists", lambda s, d: evolve.column_lists(state(s, d)["fed"]), _CAT, "SELECT db_name AS model, table_name, string_agg(column_name, ',' ORDER BY ordinal_pos, column_name) AS columns FROM snap GROUP BY 1, 2", _MORE)
register(
    "p10_absorb_types", lambda s, d: evolve.absorb_types(state(s, d)["fed"].withColumn("type", F.when(F.col("ordinal") % 4 == 0, F.lit("long")).otherwise(F.col("type"))), state(s, d)["fed"]), _CAT,
    f"SELECT model, table_name, name, type, p AS physical_type, CASE WHEN type <> p THEN 'CAST(' || name || ' AS ' || type || ')' END AS \"cast\" FROM (SELECT {_FED_ROW}, CASE WHEN ordinal_pos % 4 = 0 THEN 'long' ELSE {_FED} END AS p FROM snap)", _MORE,
)


def _gone_tables(s: SparkSession, d: str) -> DataFrame:
    """Tables of the register that aren't active, as if they were dropped."""
    return bound(s, d, "captured_tables_ref").where("not is_active").select(F.concat_ws(".", "db_name", "table_name").alias("mapping_id"), F.col("table_name").alias("kind"))


_INACTIVE = ", off AS (SELECT DISTINCT db_name || '.' || table_name AS mapping_id, table_name AS kind FROM captured_tables_ref WHERE NOT is_active)"
register("p11_drop_table", lambda s, d: evolve.drop_table(state(s, d)["target"], _gone_tables(s, d)), _CAT, f"SELECT mapping_id, property, column_name AS binding, {_XS} AS xsd FROM snap WHERE mapping_id NOT IN (SELECT mapping_id FROM off)", _MORE + _INACTIVE)
register("p11_dependents", lambda s, d: evolve.dependents(state(s, d)["source"].select("mapping_id", F.expr("'t_' || CAST(CAST(substring(physical, 3) AS INT) % 50 AS STRING)").alias("kind")), _gone_tables(s, d)), _CAT, "SELECT DISTINCT mapping_id, kind FROM (SELECT mapping_id, 't_' || CAST(CAST(substr(column_name, 3) AS INTEGER) % 50 AS VARCHAR) AS kind FROM snap) WHERE kind IN (SELECT kind FROM off)", _MORE + _INACTIVE)
register("p12_violations", lambda s, d: evolve.violations(state(s, d)["target"], evolve.drop_mapping_source(state(s, d)["source"], changes_of(s, d))), _CAT, f"SELECT mapping_id, property, column_name AS binding FROM snap s WHERE {_DROPPED}", _MORE)
register("p13_unsafe_drops", lambda s, d: evolve.unsafe_drops(changes_of(s, d), state(s, d)["source"].where("ordinal <= 3").select("mapping_id", F.col("physical").alias("column_name"))).select("mapping_id", "column_name"), _CAT, "SELECT mapping_id, column_name FROM snap s WHERE ordinal_pos <= 3 AND " + _DROPPED, _MORE)

# ---- S1, S2, S4-S6, K11, and a poll as a whole ----
def _database(s: SparkSession, d: str, name: str) -> dict[str, str]:
    """JDBC options of a domain table: of the database of `triplake.jdbc.url`, `.user`, `.password` and `.driver`, if the session names one, which all executors must reach.

    A local session without one puts the table into an embedded database of its own on disk, a new one for each call.
    """
    names = ("url", "user", "password", "driver")
    if s.conf.get("triplake.jdbc.url", None):
        return {k: s.conf.get(f"triplake.jdbc.{k}", "") for k in names} | {"dbtable": name}
    if not s.sparkContext.master.startswith("local"):
        raise ValueError("triplake.jdbc.url must name a database that all executors reach")
    url = f"jdbc:derby:{fresh(s, 'database').removeprefix('file:')};create=true"
    options = dict(zip(names, (url, "app", "app", "org.apache.derby.jdbc.EmbeddedDriver"), strict=True))
    df = bound(s, d, name)
    kinds = ", ".join(f"{f.name} VARCHAR(100)" for f in df.schema if f.dataType.simpleString() == "string")
    df.write.mode("overwrite").option("createTableColumnTypes", kinds).jdbc(url, name, properties={k: v for k, v in options.items() if k != "url"})
    return options | {"dbtable": name}


def _by_number(s: SparkSession, d: str) -> DataFrame:
    options = _database(s, d, "penerima_manfaat")
    ends = options | {"dbtable": '(select min("penerima_id") as low, max("penerima_id") as high from penerima_manfaat) t'}
    low, high = s.read.format("jdbc").options(**ends).load().first()
    return read_source(s, "penerima_manfaat", options=jdbc_options(options["url"], "penerima_manfaat", options["user"], options["password"], "penerima_id", (low, high + 1), 4) | {"driver": options["driver"]})


def _by_text(s: SparkSession, d: str) -> DataFrame:
    """Split by quantiles of a sample of the key."""
    options = _database(s, d, "master_penduduk")
    cuts = balanced_ranges(sampled_keys(s, options, "master_penduduk", '"nik"'), 3, '"nik"')
    return read_source(s, "master_penduduk", options=options, predicates=cuts)


def _by_hot_number(s: SparkSession, d: str) -> DataFrame:
    """Transactions split by programme and, where a programme has more than a part, by recipient; and how even the parts are."""
    options = _database(s, d, "transaksi_bansos")
    cuts = balanced_ranges(sampled_keys(s, options, "transaksi_bansos", '"program_id"', '"penerima_id"'), 6, '"program_id"', '"penerima_id"')
    return read_source(s, "transaksi_bansos", options=options, predicates=cuts)


register("s1_jdbc_by_number", _by_number, ("penerima_manfaat",), "SELECT * FROM penerima_manfaat")
register("s2_jdbc_by_text", _by_text, ("master_penduduk",), "SELECT * FROM master_penduduk")
register("s1_jdbc_balanced", _by_hot_number, ("transaksi_bansos",), "SELECT * FROM transaksi_bansos")


def _log_by_day(s: SparkSession, d: str) -> DataFrame:
    """The log appended in two parts, one of them twice as a retry would, and read back by its days."""
    log, path = bound(s, d, "ddl_event_log"), fresh(s, "log")
    for part in (0, 1, 1):
        append_events(log.where(F.col("id") % 2 == part), path, f"half-{part}")
    return read_log(s, path).groupBy("day").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


register("s5_log_by_day", _log_by_day, _LOG, "SELECT CAST(captured_at AS DATE) AS day, count(*) AS n, max(id) AS last_id FROM ddl_event_log GROUP BY 1")


def _versions(s: SparkSession, d: str) -> DataFrame:
    """A registry table saved, saved again as it is, and saved with the catalog's new columns: two versions, each read back."""
    fed, path = state(s, d)["fed"], fresh(s, "registry")
    for table in (fed, fed, evolve.add_federated(fed, changes_of(s, d))):
        save_if_changed(table, path)
    found = [load_version(s, path, v).withColumn("version", F.lit(v)) for v in versions(s, path)]
    return reduce(DataFrame.unionByName, found)


register("s6_versions", _versions, _CAT, f"SELECT {_FED_ROW}, 1 AS version FROM snap UNION ALL SELECT {_FED_ROW}, 2 FROM snap UNION ALL SELECT db_name, table_name, ordinal, column_name, {_FED}, 2 FROM placed", _MORE)


def _streamed(s: SparkSession, d: str) -> str:
    """S4, K1-K11 as a stream: all messages, then, after a restart, all of them again. Returns the folder of its outputs."""
    folder, out, position = fresh(s, "topic"), fresh(s, "outcomes"), fresh(s, "position")
    for _ in range(2):
        messages(s, d).select("value").write.mode("append").option("maxRecordsPerFile", 400_000).text(folder)  # well below a micro-batch
        changes.run_stream(change_stream(s, folder=folder), changes.into(out), position).awaitTermination()
    return out


def _stream_once(s: SparkSession, d: str) -> DataFrame:
    """The planned events of the stream, each once."""
    rows = changes.written_outcomes(s, _streamed(s, d)).where(F.col("outcome") == changes.PLANNED)
    return rows.groupBy("mapping_id").agg(F.count("*").alias("n"), F.max(F.col("id").cast("bigint")).alias("last_id"))


def _stream_outcomes(s: SparkSession, d: str) -> DataFrame:
    """K1, K9 in the stream: what became of every message, by outcome and reason."""
    rows = changes.written_outcomes(s, _streamed(s, d))
    return rows.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


register("k11_stream", _stream_once, _LOG, "SELECT mapping_id, count(*) AS n, max(id) AS last_id FROM cut JOIN meta USING (table_name) GROUP BY mapping_id", _MSG + _PARSED)
_KINDS = """SELECT id, CASE WHEN id % 23 = 0 THEN 'malformed' WHEN id % 29 = 0 OR mop = 'd' OR NOT is_regulated OR alter_type IS NULL THEN 'filtered' WHEN known IS NULL THEN 'skipped' ELSE 'planned' END AS outcome,
 CASE WHEN id % 23 = 0 THEN 'no object' WHEN id % 29 = 0 THEN 'no record' WHEN mop = 'd' THEN 'delete' WHEN NOT is_regulated THEN 'not regulated' WHEN alter_type IS NULL THEN 'unknown statement' WHEN known IS NULL THEN 'no mapping' END AS reason
 FROM (SELECT l.id, CASE WHEN l.id % 3 = 2 THEN 'c' ELSE l.op END AS mop, l.is_regulated, parsed.alter_type, meta.table_name AS known
 FROM ddl_event_log l LEFT JOIN parsed ON l.id = parsed.id LEFT JOIN meta ON l.table_name = meta.table_name)"""
register(
    "k1_k11_stream_outcomes", _stream_outcomes, _LOG, f"SELECT CASE WHEN i = 2 AND outcome = 'planned' THEN 'repeated' ELSE outcome END AS outcome, reason, count(*) AS n FROM ({_KINDS}), (VALUES (1), (2)) twice(i) GROUP BY ALL", _MSG + _PARSED,
)


def _keyed_fold(s: SparkSession, d: str) -> DataFrame:
    """K12 as a stream on keyed state: three micro-batches, the second after a restart, with ids that come late and repeats."""
    folder, out, position = fresh(s, "log"), fresh(s, "folded"), fresh(s, "position")
    log = written(planned(s, d).select("table_name", "id", "alter_type", "column_name", "column_type", "old_column", "new_column"), "planned")
    with keyed.settings(s):
        # every seventh id comes a micro-batch late; the last brings some of the first again
        for part in ("id % 3 = 0 and id % 7 <> 0", "id % 3 = 1 and id % 7 <> 0 or id % 7 = 0 and id % 2 = 0", "id % 3 = 2 and id % 7 <> 0 or id % 7 = 0 and id % 2 = 1 or id % 30 = 0"):
            log.where(part).write.mode("append").parquet(folder)
            stream = keyed.fold_keyed(s.readStream.schema(log.schema).parquet(folder))
            put = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
            stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", position).trigger(availableNow=True).start().awaitTermination()
    return keyed.latest(s.read.parquet(out).drop("epoch"))


register("k12_keyed_stream", _keyed_fold, _LOG)
ORACLES["k12_keyed_stream"] = ORACLES["k12_fold"]


def _polls(s: SparkSession, d: str) -> DataFrame:
    """D1-D10 as a job: a poll, and another one on what it leaves, which finds nothing and compares no columns."""
    refs, snapshot, catalog = (bound(s, d, n) for n in _CAT)
    first = catalog_diff.poll(snapshot, catalog_diff.digests(snapshot), catalog, refs)
    second = catalog_diff.poll(written(first.snapshot, "snapshot"), written(first.known, "known"), catalog, refs)
    return first.events.withColumn("poll", F.lit(1)).unionByName(second.events.withColumn("poll", F.lit(2)))


register("d1_d10_polls", _polls, _CAT, f"SELECT *, 1 AS poll FROM ({_EVENTS_SQL})", _DIFF)


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Tables whose digest differs, the only ones that a poll compares."""
    refs, snapshot, catalog = (bound(s, d, n) for n in _CAT)
    return catalog_diff.differing(catalog_diff.digests(snapshot), catalog_diff.digests(catalog), refs)


register("d2_d3_differing_tables", _compared, _CAT, "SELECT db_name, table_name FROM gone UNION SELECT db_name, table_name FROM fresh", _DIFF)


def _reached(s: SparkSession, d: str) -> DataFrame:
    source = state(s, d)["source"]
    links = source.select("mapping_id", F.split_part("mapping_id", F.lit("."), F.lit(2)).alias("subject"), F.expr("'t_' || CAST(CAST(substring(physical, 3) AS INT) % 50 AS STRING)").alias("kind"))
    return evolve.all_dependents(links.where("ordinal = 1"), _gone_tables(s, d))


register(
    "p11_all_dependents", _reached, _CAT, "SELECT dropped, mapping_id, CAST(min(hops) AS INTEGER) AS hops FROM way GROUP BY ALL",
    _MORE + _INACTIVE + """, links AS (SELECT DISTINCT mapping_id, table_name AS subject, 't_' || CAST(CAST(substr(column_name, 3) AS INTEGER) % 50 AS VARCHAR) AS kind FROM snap WHERE ordinal_pos = 1),
 way AS (SELECT DISTINCT kind AS dropped, mapping_id, subject, 1 AS hops FROM links JOIN (SELECT DISTINCT kind FROM off) USING (kind)
 UNION SELECT way.dropped, l.mapping_id, l.subject, way.hops + 1 FROM way JOIN links l ON l.kind = way.subject WHERE way.hops < 60)""",
)
ORACLES["p11_all_dependents"] = ORACLES["p11_all_dependents"].replace("WITH ", "WITH RECURSIVE ", 1)


def _stored(s: SparkSession, d: str) -> DataFrame:
    """M9, Q0 over stored property tables: recipients' names, status and resident record, without an exchange below the joins."""
    wanted = [("MAP-PENERIMA", "namaLengkap"), ("MAP-PENERIMA", "statusEkonomi"), ("LINK-PENERIMA-KE-DUKCAPIL", "memilikDataKependudukan")]
    folder = fresh(s, "properties")
    names = mapping.stored_properties({"penerima_manfaat": bound(s, d, "penerima_manfaat")}, wanted, folder, "p" + folder.rsplit("-", 1)[1], 16)
    return mapping.star(s, [names[w] for w in wanted], ["nama", "status", "penduduk"])


register("m9_stored_properties", _stored, ("penerima_manfaat",), "SELECT CAST(penerima_id AS VARCHAR) AS subject, nama_lengkap AS nama, status_ekonomi AS status, nik AS penduduk FROM penerima_manfaat WHERE nama_lengkap IS NOT NULL AND status_ekonomi IS NOT NULL AND nik IS NOT NULL")
