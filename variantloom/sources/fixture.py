"""A deterministic genotype cube derived from the relational tables, for tests and queries.

Variants come from parts, samples from suppliers, calls from line items by (part,
supplier). A pair without a call is 0/0, unphased, without depth. The definition is
one SQL prefix that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..dataset import VariantDataset
from ..session import ship, tasks

CUBE = """
WITH samples AS (
  SELECT CAST(s_suppkey + 1 AS INT) AS sample_index, s_name AS sample_id, CONCAT('F', CAST(s_nationkey AS VARCHAR(10))) AS family,
         CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex
  FROM supplier),
v0 AS (
  SELECT p_partkey, p_size, p_retailprice, CAST(p_partkey % 24 AS INT) AS c,
         CAST(1000 + FLOOR(FLOOR(p_partkey / 24e0) / 3e0) * 1250 AS INT) AS position,
         CAST(CASE WHEN p_size % 10 = 0 THEN 1 WHEN p_size % 10 IN (1, 2) THEN 3 WHEN p_size % 10 = 3 THEN 4 ELSE 2 END AS INT) AS num_allele
  FROM part),
variants AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY c, position, p_partkey) AS INT) AS variant_index, p_partkey + 1 AS variant_id, p_partkey,
         CASE WHEN c = 22 THEN 'X' WHEN c = 23 THEN 'Y' ELSE CAST(c + 1 AS VARCHAR(10)) END AS chromosome, position, num_allele,
         CASE num_allele WHEN 1 THEN 'A' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'G,A' ELSE 'CT,C' END
              WHEN 3 THEN 'T,C,G' ELSE 'A,C,G,T' END AS allele,
         CASE WHEN p_size % 7 = 0 THEN '' ELSE CONCAT('rs', CAST(p_partkey AS VARCHAR(20))) END AS id,
         CASE WHEN p_size = 1 THEN NULL ELSE p_retailprice / 16e0 END AS qual,
         CASE WHEN p_size <= 40 THEN 'PASS' WHEN p_size <= 48 THEN 'q10' ELSE NULL END AS filter,
         CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'A' ELSE 'C' END AS aa, CAST(p_size AS INT) AS ac
  FROM v0),
info_bn AS (
  SELECT v.variant_index, n.k, CAST(v.ac * n.k AS INT) AS v
  FROM variants v JOIN (SELECT CAST(n_nationkey + 1 AS INT) AS k FROM nation WHERE n_nationkey < 3) n ON n.k <= v.ac % 4),
pair AS (
  SELECT l_partkey, l_suppkey, MIN(CONCAT(l_returnflag, l_linestatus)) AS m, MAX(l_linenumber) AS ln, CAST(SUM(l_quantity) AS INT) AS dp
  FROM lineitem GROUP BY l_partkey, l_suppkey),
calls AS (
  SELECT v.variant_index, CAST(p.l_suppkey + 1 AS INT) AS sample_index,
         CAST(CASE WHEN m IN ('RF', 'RO') THEN NULL WHEN m = 'AF' THEN 0 ELSE p.ln % v.num_allele END AS INT) AS a1,
         CAST(CASE WHEN m = 'RF' THEN NULL WHEN m = 'NF' THEN 0 ELSE (p.ln + 1) % v.num_allele END AS INT) AS a2,
         p.ln % 2 = 1 AS phase, p.dp, CASE WHEN m = 'RF' THEN NULL ELSE (p.dp % 33) / 16e0 END AS ds
  FROM pair p JOIN variants v ON v.p_partkey = p.l_partkey)
"""
_TABLES = ("supplier", "part", "nation", "lineitem")


#: The same numbering for Spark without a window over all rows: within each chromosome, after the chromosomes before it.
_NUMBER = "ROW_NUMBER() OVER (ORDER BY c, position, p_partkey)"
_NUMBER_BY_PARTS = "ROW_NUMBER() OVER (PARTITION BY v0.c ORDER BY position, p_partkey) + o.below"
_PARTS = "FROM v0 JOIN (SELECT c, SUM(n) OVER (ORDER BY c) - n AS below FROM (SELECT c, COUNT(*) AS n FROM v0 GROUP BY c)) o ON o.c = v0.c)"


def call_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of a wide step over the calls, from the number of line items that their files tell."""
    return tasks(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())


def cube_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the cube.

    Line items are dealt by part to tasks of a bounded size: their pairs and the join with variants need no other shuffle.
    """
    source = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    if name == "calls":
        source["lineitem"] = source["lineitem"].repartition(call_tasks(spark, sf_dir), "l_partkey")
    sql = CUBE.replace(_NUMBER, _NUMBER_BY_PARTS).replace("CASE WHEN c = 22 THEN 'X' WHEN c = 23 THEN 'Y' ELSE CAST(c + 1 AS VARCHAR(10)) END", "CASE WHEN v0.c = 22 THEN 'X' WHEN v0.c = 23 THEN 'Y' ELSE CAST(v0.c + 1 AS VARCHAR(10)) END").replace("AS ac\n  FROM v0)", "AS ac\n  " + _PARTS)
    for t in _TABLES:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql + f"SELECT * FROM {name}", **source)


def load(spark: SparkSession, sf_dir: str, info: bool = False) -> VariantDataset:
    """The cube as a dataset; with ``info``, the variable-length field BN as an array column ``bn``."""
    ship(spark)
    v = cube_table(spark, sf_dir, "variants")
    if info:
        from pyspark.sql import functions as F

        bn = cube_table(spark, sf_dir, "info_bn").groupBy("variant_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("bn"))
        v = v.join(bn, "variant_index", "left").withColumn("bn", F.coalesce("bn", F.array().cast("array<int>")))
    return VariantDataset(v, cube_table(spark, sf_dir, "samples"), cube_table(spark, sf_dir, "calls"), {"file_format": "variantloom", "version": "1"})
