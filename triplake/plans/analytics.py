"""The questions over the federated tables (Q1-Q6) and the federated views (V1-V3), by joins on raw keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISBURSED, NOT_ELIGIBLE = "TERSALURKAN", "TIDAK ELIGIBLE"
#: Pass-through views: name, table, columns.
PASS_THROUGH = {
    "v_penduduk": ("master_penduduk", ("nik", "no_kk", "nama", "pekerjaan", "penghasilan", "status_hidup")),
    "v_wilayah": ("master_wilayah", ("wilayah_id", "provinsi", "kabupaten", "kecamatan", "desa")),
    "v_eligibility": ("eligibility_check", ("check_id", "program_id", "penerima_id", "status_eligible", "alasan")),
    "v_transaksi": ("transaksi_bansos", ("transaksi_id", "program_id", "penerima_id", "periode", "status")),
}


def folded(column: Column) -> Column:
    """Q6: a string for case-insensitive comparison."""
    return F.lower(column)


def recipients_with_residents(penerima: DataFrame, penduduk: DataFrame) -> DataFrame:
    """Q1: recipients and their resident records, across sources. Null keys never match and are dropped before the shuffle."""
    left = penerima.select("nik", "penerima_id", "nama_lengkap").where("nik is not null and nama_lengkap is not null")
    right = penduduk.select("nik", "pekerjaan", "penghasilan").where("nik is not null and pekerjaan is not null and penghasilan is not null")
    return left.join(right, "nik").select("penerima_id", "nama_lengkap", "pekerjaan", "penghasilan")


def recipients_in_province(penerima: DataFrame, penduduk: DataFrame, keluarga: DataFrame, wilayah: DataFrame, province: str) -> DataFrame:
    """Q2: recipients whose family lives in a province. The region filter comes first and shrinks the families."""
    region = wilayah.where(F.col("provinsi") == province).select("wilayah_id", "kabupaten", "kecamatan")
    families = keluarga.select("no_kk", "wilayah_id").where("no_kk is not null").join(region, "wilayah_id")
    people = penduduk.select("nik", "no_kk").where("nik is not null and no_kk is not null").join(families, "no_kk")
    return penerima.select("nik", "penerima_id", "nama_lengkap").where("nik is not null and nama_lengkap is not null").join(people, "nik").select("penerima_id", "nama_lengkap", "kabupaten", "kecamatan")


def rejected_checks(check: DataFrame, penerima: DataFrame, program: DataFrame, status: str = NOT_ELIGIBLE) -> DataFrame:
    """Q3: checks of a status that have a reason, with recipient and programme."""
    rows = check.where((F.col("status_eligible") == status) & F.col("alasan").isNotNull()).select("check_id", "penerima_id", "program_id", "alasan")
    people = penerima.select("penerima_id", "nama_lengkap").where("nama_lengkap is not null")
    named = program.select("program_id", "nama_program").where("nama_program is not null")
    return rows.join(named, "program_id").join(people, "penerima_id").select("check_id", "nama_lengkap", "nama_program", "alasan")


def name_audit(penerima: DataFrame, penduduk: DataFrame) -> DataFrame:
    """Q4: one id, two names that differ beyond case. Two columns of each side are shuffled."""
    left = penerima.select("nik", "nama_lengkap").where("nik is not null and nama_lengkap is not null")
    right = penduduk.select("nik", F.col("nama").alias("nama_penduduk")).where("nik is not null and nama is not null")
    return left.join(right, "nik").where(folded(F.col("nama_lengkap")) != folded(F.col("nama_penduduk"))).select("nik", "nama_lengkap", "nama_penduduk")


def programme_totals(transaksi: DataFrame, program: DataFrame, status: str = DISBURSED) -> DataFrame:
    """Q5: amount of the disbursed transactions by programme name.

    Transactions are counted by programme before the join, so the fact table is shuffled as one row for each programme and task at
    most, and a hot programme is one addend of its count times its amount.
    """
    counted = transaksi.where(F.col("status") == status).groupBy("program_id").agg(F.count("*").alias("n"))
    priced = counted.join(program.select("program_id", "nama_program", "nominal").where("nama_program is not null and nominal is not null"), "program_id")
    return priced.groupBy("nama_program").agg(F.sum(F.col("nominal") * F.col("n")).cast("decimal(38,2)").alias("total_nominal"))


def view(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """V1-V3: a federated view by name."""
    if name in PASS_THROUGH:
        table, columns = PASS_THROUGH[name]
        return tables[table].select(*columns)
    if name == "v_keluarga":
        return tables["master_keluarga"].select("no_kk", "wilayah_id").join(tables["master_wilayah"], "wilayah_id").select("no_kk", "wilayah_id", "provinsi", "kabupaten", "kecamatan", "desa")
    if name == "v_program":
        return tables["program_bansos"].select("program_id", "nama_program", "tipe_program", F.col("nominal").cast("bigint").alias("nominal"))
    raise KeyError(name)


def register_views(tables: dict[str, DataFrame]) -> None:
    """All views whose tables are there, as temp views."""
    need = {**{n: {t} for n, (t, _) in PASS_THROUGH.items()}, "v_keluarga": {"master_keluarga", "master_wilayah"}, "v_program": {"program_bansos"}}
    for name, used in need.items():
        if used <= set(tables):
            view(name, tables).createOrReplaceTempView(name)
