"""Avro bytes, transforms and files."""

import decimal
import io

import pytest
import pyarrow.parquet as pq
from pyarrow import orc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions import transforms
from stratalake.sources import avro, files

RECORD = {
    "type": "record", "name": "r", "namespace": "n",
    "fields": [
        {"name": "b", "type": "boolean"}, {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "d", "type": "double"}, {"name": "s", "type": "string"}, {"name": "raw", "type": "bytes"},
        {"name": "e", "type": {"type": "enum", "name": "e", "symbols": ["A", "B"]}}, {"name": "a", "type": {"type": "array", "items": "int"}}, {"name": "m", "type": {"type": "map", "values": "string"}}, {"name": "x", "type": {"type": "fixed", "name": "x", "size": 2}},
        {"name": "dec", "type": {"type": "bytes", "logicalType": "decimal", "precision": 10, "scale": 2}}, {"name": "u", "type": ["null", "int", "string"]},
    ],
}
ROW = {"b": True, "i": -7, "l": None, "d": 1.5, "s": "ü", "raw": b"\x00", "e": "B", "a": [1, -2], "m": {"k": "v"}, "x": b"ab", "dec": decimal.Decimal("-12.34"), "u": {"tag": 1, "m0": None, "m1": "t"}}


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy", "zstandard"])
def test_container(codec):
    out = io.BytesIO()
    avro.write_container(iter([ROW] * 5), RECORD, out, codec, block_rows=2)
    schema, rows = avro.read_container(io.BytesIO(out.getvalue()))
    got = list(rows)
    assert len(got) == 5 and got[0] | {"m": dict(got[0]["m"])} == ROW
    assert avro.spark_type(schema)["dec"].dataType == T.DecimalType(10, 2)
    with pytest.raises(ValueError):
        list(avro.read_container(io.BytesIO(out.getvalue()[:-1] + b"\x00"))[1])


def test_fingerprints_and_frames():
    assert avro.rabin(b'"null"') == 0x63DD24E7CC258F8A and avro.rabin(b'"int"') == 0x7275D51A3F395C8F  # of the specification's test table
    assert avro.canonical(avro.parse({"type": "int", "doc": "x"})) == '"int"'
    assert len(avro.fingerprint(RECORD, "MD5")) == 16 and len(avro.fingerprint(RECORD, "SHA-256")) == 32
    for kind, key in (("single", b"12345678"), ("registry", 7), ("registry8", 8), ("raw", None)):
        assert avro.unframe(avro.frame(b"xyz", kind, key), kind) == (key, b"xyz")
    with pytest.raises(ValueError):
        avro.unframe(b"zz", "single")


def test_resolution():
    p = avro.parse
    assert avro.resolve(p("int"), p("double"), 3) == 3.0 and avro.resolve(p("string"), p("bytes"), "a") == b"a"
    assert avro.resolve(p(["null", "int"]), p(["null", "long"]), None) is None
    with pytest.raises(TypeError):
        avro.resolve(p("long"), p("int"), 3)
    with pytest.raises(TypeError):
        avro.resolve(p(["null", "int"]), p("int"), None)
    enum = lambda *s, **more: p({"type": "enum", "name": "e", "symbols": list(s)} | more)
    assert avro.resolve(enum("A", "B"), enum("A", default="A"), "B") == "A"


def test_bucket_hash(spark):
    one = spark.createDataFrame([(34,)], "x long").select(transforms.bucket_hash(F.col("x"), T.LongType())).first()[0]
    day = spark.sql("select date'2017-11-16' as x").select(transforms.bucket_hash(F.col("x"), T.DateType())).first()[0]
    signed = lambda x: x - 2**32 if x >= 2**31 else x
    assert signed(one) == 2017239379 and signed(day) == -653330422  # published test vectors


def test_truncate(spark):
    df = spark.createDataFrame([(-1, "abcd")], "x long, s string")
    assert df.select(transforms.truncate(F.col("x"), 10, T.LongType()), transforms.truncate(F.col("s"), 3, T.StringType())).first() == (-10, "abc")


def test_files(spark, tmp_path):
    df = spark.range(1000).withColumn("s", F.col("id").cast("string")).coalesce(1)
    files.write(df, f"{tmp_path}/p", codec="zstd", bloom={"s": 1000}, rows=400)
    assert files.footers(spark, f"{tmp_path}/p").agg(F.sum("num_rows")).first()[0] == 1000
    assert files.row_group(spark, f"{tmp_path}/p", 0, ["id"]).count() == 1000
    assert files.file_stats(spark.read.parquet(f"{tmp_path}/p")).count() == 3
    files.write(df, f"{tmp_path}/o", "orc")
    assert files.stripes(spark, f"{tmp_path}/o").agg(F.sum("num_rows")).first()[0] == 1000


def test_footers_are_read_without_the_files(spark, tmp_path):
    path = f"{tmp_path}/a b%+"
    df = spark.range(0, 60_000, 1, 1).select("id", F.hash("id").alias("h"))
    df.write.option("parquet.block.size", 100_000).option("parquet.block.size.row.check.max", 1000).parquet(path)
    rows = files.footers(spark, path).orderBy("row_group").collect()
    made = pq.read_metadata(rows[0]["file"].removeprefix("file:"))
    assert len(rows) == made.num_row_groups > 2
    assert [(r["num_rows"], r["total_bytes"]) for r in rows] == [(made.row_group(i).num_rows, made.row_group(i).total_byte_size) for i in range(len(rows))]
    own = files.row_group(spark, path, 1, ["id"])
    first = rows[0]["num_rows"]
    assert sorted(r["id"] for r in own.collect()) == list(range(first, first + rows[1]["num_rows"])) and own.columns == ["id"]
    assert files.row_group(spark, path, 1).columns == ["id", "h"] and files.row_group(spark, path, len(rows)).count() == 0
    for frame in (files.footers(spark, path), own):
        assert "content" not in frame._jdf.queryExecution().analyzed().toString()


def test_stripes_as_their_files_say(spark, tmp_path):
    for codec in ("none", "snappy", "zstd"):
        files.write(spark.range(0, 1000, 1, 1), f"{tmp_path}/{codec}", "orc", codec=codec)
        r = files.stripes(spark, f"{tmp_path}/{codec}").first()
        f = orc.ORCFile(r["file"].removeprefix("file:"))
        assert (r["n_stripes"], r["num_rows"], r["codec"]) == (f.nstripes, f.nrows, str(f.compression))
