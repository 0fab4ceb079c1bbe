"""File namespaces derived from the star-schema test tables: entries, journal and small side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "drive string, mft_ref long, parent_ref long, name string, is_dir boolean, hidden_system boolean, size long, modified timestamp"
ROOT_REF = 5


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _rows(df: DataFrame, drive: str, ref: str, parent: str, name: str, is_dir: bool, hidden: str = "false", size: str = "0", modified: str = "null") -> DataFrame:
    return df.selectExpr(f"'{drive}' drive", f"cast({ref} as bigint) mft_ref", f"cast({parent} as bigint) parent_ref", f"{name} name", f"{str(is_dir).lower()} is_dir", f"{hidden} hidden_system", f"cast({size} as bigint) size", f"cast({modified} as timestamp) modified")


#: Every form of name the search must tell apart, by order key modulo 8.
_NAMES = """case o_orderkey % 8 when 0 then concat('IMG_', o_orderkey, '_edit.jpg') when 1 then concat('report_', o_orderkey, '_final.docx')
 when 2 then concat('photo_', o_orderkey % 100, '.png') when 3 then concat('vacation photo ', o_orderkey, '.JPG')
 when 4 then concat('draft report ', o_orderkey, '.txt') when 5 then concat('보고서_', o_orderkey, '.hwp')
 when 6 then concat('archive_', o_orderkey, '.tar.gz') else concat('README', o_orderkey) end"""


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drive C: holds region, nation and customer folders with order files; drive D: source folders with documents."""
    one = lambda *a: _rows(spark.range(1), *a)
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    documents = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    customer = _table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region", "r_regionkey", "r_name")
    file = dict(size="floor(o_totalprice * 1000)", modified="o_orderdate")
    folder = "100 + cast(substr(source, 4) as bigint)"
    parts = [
        one("C:", "5", "5", "'.'", True, "true"),
        one("C:", "11", "5", "'$Recycle.Bin'", True, "true"),
        _rows(region, "C:", "100 + r_regionkey", "5", "r_name", True),
        _rows(nation, "C:", "1000 + n_nationkey", "100 + n_regionkey", "case when n_nationkey = 4 then 'WinSxS' else n_name end", True, "n_nationkey in (7, 13)"),
        _rows(customer, "C:", "1000000 + c_custkey", "case when c_custkey % 50 = 0 then 11 else 1000 + c_nationkey end", "case when c_custkey % 50 = 0 then concat('$R', lpad(cast(c_custkey as string), 6, '0')) else c_name end", True),
        _rows(orders, "C:", "100000000 + o_orderkey", "case when o_orderkey % 1000 = 999 then 999999999 else 1000000 + o_custkey end", _NAMES, False, **file),
        _rows(orders.where("o_orderkey % 500 = 1"), "C:", "100000000 + o_orderkey", "1000000 + ((o_custkey + 1) % 100)", "concat('link_', o_orderkey, '.docx')", False, **file),
        one("D:", "5", "5", "'.'", True, "true"),
        _rows(documents.select("source").distinct(), "D:", folder, "5", "source", True),
        _rows(documents, "D:", "1000000 + doc_id", folder, "concat('doc_', doc_id, '.', lang)", False, "false", "n_chars"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log over drive C:, in the order of usn; ``ts`` is declared but orders nothing."""
    return _table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts").selectExpr(
        "event_id usn",
        "'C:' drive",
        "case when event_type = 'signup' or event_id % 2 = 1 then 200000000 + event_id div 40 else 100000000 + (event_id * 7) % 1500 end mft_ref",
        "1000000 + user_id parent_ref",
        "cast(case event_type when 'signup' then 256 when 'error' then 512 when 'view' then 8192 when 'click' then 768 else 1 end as bigint) reason",
        "cast(0 as bigint) file_attributes",
        "concat('new_', event_id, '.log') name",
        "cast(ts as timestamp) ts",
    )


def drives(spark: SparkSession) -> DataFrame:
    rows = [
        ("C:\\", "Fixed", "NTFS", True, 0x1234, 77, 10_000, 0, True, None),
        ("D:\\", "Removable", "ntfs", True, 0x5678, 0, 0, 0, True, None),
        ("E:\\", "Fixed", "FAT32", True, 0x9ABC, 0, 0, 0, False, "not NTFS"),
        ("F:\\", "Fixed", "NTFS", False, 0, 0, 0, 0, False, "not ready"),
    ]
    return spark.createDataFrame(rows, "root string, type string, fs string, ready boolean, volume_serial long, journal_id long, next_usn long, lowest_valid_usn long, index_ready boolean, error string")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events", "event_type", "event_id", "value").where("value > 5").selectExpr("event_type query", "event_id used_at")


def delete_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a bulk deletion of all order files."""
    cause = F.expr("case o_orderkey % 7 when 0 then 'Locked' when 1 then 'AccessDenied' when 2 then 'BadName' when 3 then 'Protected' else 'None' end")
    code = F.expr("case o_orderkey % 7 when 0 then 32 when 1 then 5 when 2 then 123 else 0 end")
    return _table(spark, sf_dir, "orders", "o_orderkey").select(
        F.concat(F.lit("C:\\bulk\\"), F.expr(_NAMES)).alias("path"), (cause == "None").alias("success"), (F.expr("o_orderkey % 14 = 4")).alias("permanent"),
        cause.alias("cause"), code.alias("win32_error"), F.when(cause == "Locked", F.concat(F.lit("C:\\bulk\\"), F.expr(_NAMES))).alias("blocking_path"),
        F.when(cause == "Locked", F.transform(F.sequence(F.lit(1), F.expr("cast(1 + o_orderkey % 9 as int)")), lambda i: F.concat(F.lit("proc"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("locking_processes"),
    )


def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sizes and dates by path, for the documents of drive D:."""
    documents = _table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    return documents.selectExpr(r"concat('D:\\', source, '\\doc_', doc_id, '.', lang) path", "n_chars + 7 size", "timestamp '2020-01-02 03:04:05' modified", "doc_id % 10 <> 0 found")
