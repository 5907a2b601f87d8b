"""Declared schemas: source tables, federated tables, change events. Nullability is unenforced metadata and left open."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "decimal(15,2)": T.DecimalType(15, 2)}


def struct(**columns: str) -> T.StructType:
    """A StructType from names and type names."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns.items()])


# Source tables, as their databases declare them.
SOURCES = {
    "kemensos": {
        "program_bansos": dict(program_id="int", nama_program="string", tipe_program="string", nominal="decimal(15,2)", periode_mulai="date", periode_selesai="date"),
        "penerima_manfaat": dict(penerima_id="int", nik="string", nama_lengkap="string", tgl_lahir="date", status_ekonomi="string", no_kartu_keluarga="string", aktif="boolean"),
        "transaksi_bansos": dict(transaksi_id="int", program_id="int", penerima_id="int", periode="string", status="string", created_at="timestamp_ntz"),
        "eligibility_check": dict(check_id="int", program_id="int", penerima_id="int", status_eligible="string", alasan="string", validated_at="timestamp_ntz", validated_by="string"),
    },
    "dukcapil": {
        "master_wilayah": dict(wilayah_id="int", provinsi="string", kabupaten="string", kecamatan="string", desa="string"),
        "master_keluarga": dict(no_kk="string", wilayah_id="int", created_at="timestamp_ntz"),
        "master_penduduk": dict(nik="string", no_kk="string", nama="string", tanggal_lahir="date", pekerjaan="string", penghasilan="decimal(15,2)", status_hidup="string", created_at="timestamp_ntz"),
        "riwayat_perubahan_data": dict(riwayat_id="int", nik="string", kolom_diubah="string", nilai_lama="string", nilai_baru="string", diubah_pada="timestamp_ntz", diubah_oleh="string"),
    },
}
# What the federation exposes of them.
FEDERATED = {
    "kemensos": {
        "program_bansos": dict(program_id="int", nama_program="string", tipe_program="string", nominal="int"),
        "penerima_manfaat": dict(penerima_id="int", nik="string", nama_lengkap="string", tgl_lahir="date", status_ekonomi="string", no_kartu_keluarga="string", aktif="boolean"),
        "transaksi_bansos": dict(transaksi_id="int", program_id="int", penerima_id="int", periode="string", status="string"),
        "eligibility_check": dict(check_id="int", program_id="int", penerima_id="int", status_eligible="string", alasan="string"),
    },
    "dukcapil": {
        "master_wilayah": dict(wilayah_id="int", provinsi="string", kabupaten="string", kecamatan="string", desa="string"),
        "master_keluarga": dict(no_kk="string", wilayah_id="int"),
        "master_penduduk": dict(nik="string", no_kk="string", nama="string", tanggal_lahir="date", pekerjaan="string", penghasilan="int", status_hidup="string"),
    },
}
#: Columns whose type pads with blanks, trimmed on read.
BLANK_PADDED = {"nik", "no_kk", "no_kartu_keluarga"}

EVENT = struct(id="bigint", username="string", db_name="string", schema_name="string", table_name="string", object_tag="string", command_tag="string", alter_type="string", column_name="string", ddl_command="string", is_regulated="string", captured_at="string")
CHANGE = struct(smo_type="string", source_id="string", table="string", old_column="string", new_column="string", timestamp="timestamp")
TRIPLE = struct(s="string", p="string", o="string", o_kind="string", o_type="string")


def federated(table: str) -> T.StructType:
    return next(struct(**m[table]) for m in FEDERATED.values() if table in m)


def model_of(table: str) -> str:
    return next(k for k, m in FEDERATED.items() if table in m)
