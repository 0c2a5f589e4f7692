"""An extension: VCF lines dropped into a folder, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vcf_text as T


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """(chromosome, position, allele, id, qual, filter) of new files in a folder as they come."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    c = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    alt = c[4]
    return rows.select(T.strip_prefix(c[0]).alias("chromosome"), c[1].cast("int").alias("position"), F.when(alt == ".", c[3]).otherwise(F.concat(c[3], F.lit(","), alt)).alias("allele"), F.when(c[2] == ".", "").otherwise(c[2]).alias("id"), T.value(c[5], "Float").alias("qual"), F.when(c[6] == ".", F.lit(None)).otherwise(c[6]).alias("filter"))
