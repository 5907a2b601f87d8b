"""Domain tables derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of the driver that the bindings read.
BASE = ("part", "customer", "orders", "nation", "region", "events")

KEY16 = "lpad(CAST({0} AS STRING), 16, '0')"
FAMILY = "lpad(CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING), 16, '0')"
TABLE_OF_PART = "'t_' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING)"
TYPE_OF_PART = "CASE WHEN p_size % 3 = 0 THEN 'varchar(100)' WHEN p_size % 3 = 1 THEN 'int' ELSE 'decimal(15,2)' END"
DB_OF_PART = "'db' || CAST(p_partkey % 2 AS STRING)"
ORDINAL_OF_PART = "CAST(floor((p_partkey % 20) / 2) AS INT) + 1"

#: Table name to its SQL; {part} and the like stand for the driver's tables.
BINDINGS = {
    "program_bansos": """
        SELECT CAST(p_partkey AS INT) AS program_id, p_name AS nama_program, p_type AS tipe_program,
               CAST(p_retailprice AS DECIMAL(15,2)) AS nominal
        FROM {part}""",
    "penerima_manfaat": f"""
        SELECT CAST(c_custkey AS INT) AS penerima_id, {KEY16.format("c_custkey")} AS nik, c_name AS nama_lengkap,
               c_mktsegment AS status_ekonomi, {FAMILY} AS no_kartu_keluarga, c_acctbal > 0 AS aktif
        FROM {{customer}}""",
    "transaksi_bansos": """
        SELECT CAST(o_orderkey AS INT) AS transaksi_id, CAST(o_orderkey % 200 AS INT) AS program_id,
               CAST(o_custkey AS INT) AS penerima_id,
               CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS periode,
               CASE o_orderstatus WHEN 'F' THEN 'TERSALURKAN' WHEN 'P' THEN 'PENDING' ELSE 'GAGAL' END AS status
        FROM {orders}""",
    "eligibility_check": """
        SELECT CAST(event_id AS INT) AS check_id, CAST(event_id % 200 AS INT) AS program_id, CAST(user_id AS INT) AS penerima_id,
               CASE WHEN event_type IN ('error', 'signup') THEN 'TIDAK ELIGIBLE' ELSE 'ELIGIBLE' END AS status_eligible,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS alasan
        FROM {events}""",
    "master_wilayah": """
        SELECT n_nationkey AS wilayah_id, r_name AS provinsi, n_name AS kabupaten, n_name || '-KEC' AS kecamatan,
               n_name || '-DESA' AS desa
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "master_keluarga": f"""
        SELECT DISTINCT {FAMILY} AS no_kk, CAST(floor(c_custkey / 4) AS INT) % 25 AS wilayah_id
        FROM {{customer}}""",
    "master_penduduk": f"""
        SELECT {KEY16.format("c_custkey")} AS nik, {FAMILY} AS no_kk,
               CASE WHEN c_custkey % 11 = 0 THEN c_name || ' X' WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS nama,
               c_mktsegment AS pekerjaan,
               CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(15,2)) END AS penghasilan,
               'HIDUP' AS status_hidup
        FROM {{customer}} WHERE c_custkey % 13 <> 0""",
    "captured_tables_ref": f"""
        SELECT DISTINCT {DB_OF_PART} AS db_name, {TABLE_OF_PART} AS table_name,
               CAST(floor(p_partkey / 20) AS BIGINT) % 9 <> 0 AS is_active
        FROM {{part}}""",
    "ddl_column_snapshot": f"""
        SELECT {DB_OF_PART} AS db_name, {TABLE_OF_PART} AS table_name, 'c_' || CAST(p_partkey AS STRING) AS column_name,
               {TYPE_OF_PART} AS column_type, {ORDINAL_OF_PART} AS ordinal_pos
        FROM {{part}}""",
    "catalog_columns": f"""
        SELECT {DB_OF_PART} AS db_name, {TABLE_OF_PART} AS table_name,
               'c_' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 17 = 0 THEN '_new' ELSE '' END AS column_name,
               {TYPE_OF_PART} AS column_type, {ORDINAL_OF_PART} AS ordinal_pos
        FROM {{part}} WHERE p_partkey % 13 <> 0
        UNION ALL
        SELECT {DB_OF_PART}, {TABLE_OF_PART}, 'x_' || CAST(p_partkey AS STRING), 'bigint', 11
        FROM {{part}} WHERE p_partkey % 19 = 0""",
    "ddl_event_log": """
        SELECT event_id AS id, ts AS captured_at, tbl AS table_name, alter_type, event_id % 7 <> 0 AS is_regulated,
               CASE event_id % 10 WHEN 0 THEN 'd' WHEN 1 THEN 'r' WHEN 2 THEN 'u' ELSE 'c' END AS op,
               'ALTER TABLE `db`.`' || tbl || '` ' || alter_type || ' `col_' || CAST(user_id % 9 AS STRING) || '`' ||
               CASE alter_type WHEN 'ADD COLUMN' THEN CASE WHEN event_id % 2 = 0 THEN ' VARCHAR(100)' ELSE ' int NOT NULL' END
                               WHEN 'RENAME COLUMN' THEN ' TO `col_' || CAST(event_id % 50 AS STRING) || '_kode_pos`'
                               ELSE '' END AS ddl_command
        FROM (SELECT event_id, ts, user_id,
                     CASE user_id % 8 WHEN 0 THEN 'master_penduduk' WHEN 1 THEN 'master_keluarga' WHEN 2 THEN 'master_wilayah'
                          WHEN 3 THEN 'penerima_manfaat' WHEN 4 THEN 'program_bansos' WHEN 5 THEN 'transaksi_bansos'
                          WHEN 6 THEN 'eligibility_check' ELSE 'riwayat_perubahan_data' END AS tbl,
                     CASE event_type WHEN 'click' THEN 'ADD COLUMN' WHEN 'view' THEN 'DROP COLUMN'
                          WHEN 'purchase' THEN 'RENAME COLUMN' WHEN 'signup' THEN 'ADD CONSTRAINT' ELSE 'ADD COLUMN' END AS alter_type
              FROM {events}) e""",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's parquet files; only the files it needs are read."""
    sql = BINDINGS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in sql}
    return spark.sql(sql, **tables)


def cte(*names: str) -> str:
    """The named domain tables as common table expressions for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({BINDINGS[n].format(**{t: t for t in BASE})})" for n in names)
