"""Resource logs: text with a title, a line of column names, and a line of numbers per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the speed, in bits a second, that traffic columns are a share of.
LINK_BITS = 56 * 1000 * 1000 * 1000


def samples(lines: DataFrame) -> DataFrame:
    """From lines (node, n, line; n from 0): node, sample, name, value.  Columns in KB become shares of the link, and are named Gbps."""
    words = lines.select("node", "n", F.posexplode(F.split("line", " ")).alias("i", "word"))
    names = words.where("n = 1").select("node", "i", F.col("word").alias("name"))
    values = words.where("n > 1").select("node", (F.col("n") - 2).alias("sample"), "i", F.col("word").try_cast("double").alias("value"))
    kb = F.col("name").contains("KB")
    both = values.join(names, ["node", "i"])
    return both.select("node", "sample", F.when(kb, F.expr("concat(left(name, length(name) - 2), 'Gbps')")).otherwise(F.col("name")).alias("name"), F.when(kb, F.col("value") * 8192 / F.lit(float(LINK_BITS))).otherwise(F.col("value")).alias("value"))
