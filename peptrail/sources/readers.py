"""Tables from files. Schemas are declared, never inferred; every row gets a key in the order of files.

Files are in the order of their names, and rows in the order of their file. A file that is read in blocks by
several tasks gets its numbers from the counts of the blocks before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import INPUT_ONLY, REGISTRY

#: Header names of assay files and the engine's names for them.
ASSAY_HEADER = {
    "类别": "category", "序列": "seq", "作用位点": "target_site", "MIC": "mic", "疏水性": "hydrophobicity", "电荷数": "charge", "等电点": "isoelectric_point", "穿透深度": "penetration_depth",
    "倾斜角度": "tilt_angle", "无序构象倾向": "disorder_tendency", "线性力矩": "linear_moment", "体外聚集倾向": "aggregation_tendency", "疏水性残留物掩盖的角度": "hydrophobic_angle", "两亲性指数": "amphipathic_index", "PPII线圈的倾向": "ppii_tendency",
}

ASSAY = T.StructType([T.StructField(c, T.StringType()) for c in ("category", "seq", "target_site")] + [T.StructField(c, T.DoubleType()) for c in ("mic", *REGISTRY, *INPUT_ONLY)])
EMBEDDINGS = T.StructType([T.StructField("seq", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


#: How CSV is read: a quote is doubled and a backslash plain, and a quoted empty field is an empty text where a bare one is missing.
#: The mark is no character of any text; Spark would take both for missing if its mark were the empty one.
CSV = {"header": True, "escape": '"', "nullValue": "\uffff"}


def csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, as `sinks.write_csv` writes it. Texts with line breaks need multi_line, by which a file is read by one task."""
    more = {"multiLine": True, "lineSep": "\n"} if multi_line else {}
    return spark.read.schema(schema).options(**CSV, **more).csv(path)


#: Blocks of files whose counts may be broadcast; more are joined.
BROADCAST_BLOCKS = 100_000


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """Add name: 0 .. n - 1 in the order of files' names and of rows within them, to a frame just read from files.

    A task numbers the rows of a block as it reads them; what is added to a block's numbers follows from the
    counts of the blocks before it, of which there are as many as tasks."""
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    counts = placed.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    few = rows.rdd.getNumPartitions() + len(rows.inputFiles()) <= BROADCAST_BLOCKS
    # Every row has its block's counts; a left join tells Spark so, which then drops it where no number is asked for.
    numbered = placed.join(F.broadcast(shifts) if few else shifts, ["_file", "_start"], "left")
    return numbered.select((F.col("_row") + F.col("_shift")).alias(name), *rows.columns)


def assay(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """An assay CSV with a header in any column order: declared types, engine names, and src_ord in file order. multi_line as in `csv`."""
    names = spark.read.option("header", True).csv(path).columns  # reads the first line only
    kinds = {f.name: f.dataType for f in ASSAY.fields}
    schema = T.StructType([T.StructField(n, kinds.get(ASSAY_HEADER.get(n, n), T.StringType())) for n in names])
    rows = csv(spark, path, schema, multi_line)
    return in_file_order(rows, "src_ord").select("src_ord", *(F.col(f"`{n}`").alias(ASSAY_HEADER.get(n, n)) for n in names))


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """One sequence a line: seq_id in file order, seq."""
    return in_file_order(spark.read.text(path), "seq_id").withColumnRenamed("value", "seq")


def structure_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV keyed by seq with numeric columns; src_ord keeps file order."""
    schema = T.StructType([T.StructField("seq", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
    return in_file_order(csv(spark, path, schema), "src_ord").select("seq", *columns, "src_ord")


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache of embeddings, or an empty one where there is none yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.read.schema(EMBEDDINGS).parquet(path)
    return spark.createDataFrame([], EMBEDDINGS)


#: Literal training rows, sequence and multiplicity, all with MIC 0.01.
LITERAL_ROWS = {"VRVVRVRVRVVRVR": 8, "LRLLRLRLRLLRLR": 8, "LRLLRLRRLRLLRL": 8, "IRIIRIRIRIIRIR": 5, "WRWWRWRWRWWRWR": 5, "FKFFKFKFKFFKFK": 1}


def literal_rows(spark: SparkSession) -> DataFrame:
    """seq, mic of the literal rows."""
    few = spark.createDataFrame(list(LITERAL_ROWS.items()), "seq string, n int")
    return few.select(F.explode(F.array_repeat("seq", F.col("n"))).alias("seq"), F.lit(0.01).alias("mic"))
