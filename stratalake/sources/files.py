"""Parquet and ORC files: scans, row groups, footers, and units that may hold a value."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Expr, keep
from ..plans.stats import unit_stats


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, filter: Expr | None = None, format: str = "parquet") -> DataFrame:
    """Rows of files; Spark prunes row groups and stripes, probes Bloom filters and reads only the columns that are needed."""
    df = spark.read.format(format).load(path)
    df = keep(df, filter) if filter is not None else df
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, format: str = "parquet", codec: str | None = None, bloom: dict[str, int] | None = None, rows: int = 1_000_000, dictionary: bool = True, partition_by: list[str] | None = None) -> None:
    """Writes files of at most ``rows`` rows each; ``bloom`` gives columns a Bloom filter for so many distinct values."""
    w = df.write.option("maxRecordsPerFile", rows)
    if codec:
        w = w.option("compression", codec)
    if format == "parquet":
        w = w.option("parquet.enable.dictionary", str(dictionary).lower())
        for c, n in (bloom or {}).items():
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(n))
    elif bloom:
        w = w.option("orc.bloom.filter.columns", ",".join(bloom))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(format).save(path)


def concatenate(spark: SparkSession, parts: list, target) -> None:
    """Makes one Parquet file of the row groups of several with the same schema, all given as Hadoop paths. Their bytes are copied as they are, by the driver through a small buffer; only footers are held."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.parquet.hadoop
    inputs = [parquet.util.HadoopInputFile.fromPath(p, conf) for p in parts]
    reader = parquet.ParquetFileReader.open(inputs[0])
    meta = reader.getFooter().getFileMetaData()
    reader.close()
    writer = parquet.ParquetFileWriter(parquet.util.HadoopOutputFile.fromPath(target, conf), meta.getSchema(), parquet.ParquetFileWriter.Mode.CREATE, 128 << 20, 8 << 20)
    writer.start()
    for i in inputs:
        writer.appendFile(i)
    writer.end(meta.getKeyValueMetaData())


def _each(spark: SparkSession, path: str, suffix: str, one: Callable) -> list[tuple]:
    """The rows that ``one`` gives of each file, called with its Hadoop path and the configuration: by the driver, for what footers say, so that no file is read whole. Each begins with the file's uri, as `_metadata.file_path` has it, and path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path).select("_metadata.file_path", "path").collect()
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    with ThreadPoolExecutor(16) as pool:
        return [(r["file_path"], r["path"], *x) for r, rows in zip(found, pool.map(lambda r: one(make(r["path"]), conf), found), strict=True) for x in rows]


def _row_groups(spark: SparkSession, path: str) -> list[tuple]:
    """Uri, path, number, rows and bytes of the row groups of Parquet files."""
    jvm = spark._jvm

    def one(p, conf) -> list[tuple]:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
        try:
            return [(i, b.getRowCount(), b.getTotalByteSize()) for i, b in enumerate(reader.getFooter().getBlocks())]
        finally:
            reader.close()

    return _each(spark, path, "parquet", one)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_group, num_rows, total_bytes`` of Parquet files. Only footers are read, by the driver."""
    return spark.createDataFrame([r[1:] for r in _row_groups(spark, path)], "file string, row_group int, num_rows long, total_bytes long")


def row_group(spark: SparkSession, path: str, number: int, columns: list[str] | None = None) -> DataFrame:
    """The rows of one row group of each file, found by their position in the file in a scan of the columns."""
    spans, at = [], {}
    for uri, _, i, n, _ in _row_groups(spark, path):  # in order within a file
        start = at.get(uri, 0)
        at[uri] = start + n
        if i == number:
            spans.append((uri, start, start + n))
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    rows = df.select(*(columns or df.columns), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    own = spark.createDataFrame(spans, "_file string, _start long, _end long")
    return rows.join(F.broadcast(own), "_file").where("_at >= _start and _at < _end").drop("_file", "_at", "_start", "_end")


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_stripes, num_rows, codec`` of ORC files. Only footers are read, by the driver."""
    orc = spark._jvm.org.apache.orc.OrcFile

    def one(p, conf) -> list[tuple]:
        reader = orc.createReader(p, orc.readerOptions(conf))
        try:
            codec = reader.getCompressionKind().toString()
            return [(reader.getStripes().size(), reader.getNumberOfRows(), "UNCOMPRESSED" if codec == "NONE" else codec)]
        finally:
            reader.close()

    return spark.createDataFrame([r[1:] for r in _each(spark, path, "orc", one)], "file string, n_stripes int, num_rows long, codec string")


def file_stats(df: DataFrame) -> DataFrame:
    """Statistics of the files that a scan reads."""
    names = df.columns
    return unit_stats(df.select("*", F.col("_metadata.file_path").alias("_file")), "_file", names)
