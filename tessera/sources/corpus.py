"""Readers of a corpus: chunks, vectors, meta data, clauses; and the mapping from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

_S = lambda *names: [StructField(n, StringType()) for n in names]
CHUNKS = StructType([*_S("id", "spec_id", "release", "series", "series_desc", "doc_type", "title", "chunk_index"), StructField("total_chunks", IntegerType()), StructField("text", StringType())])
VECTORS = StructType([StructField("chunk_id", StringType()), StructField("embedding", ArrayType(FloatType()))])
META = StructType(_S("key", "value"))
CLAUSES = StructType(_S("spec_id", "release", "series", "clause_id", "ie_name", "text"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def resolve(spark: SparkSession, configured: str | None, default: str | None, name: str = "CORPUS") -> str:
    """The configured folder if it has chunks, else the default one, else an error that names the setting."""
    for p in (configured, default):
        if p and exists(spark, f"{p}/chunks.parquet"):
            missing = {f.name for f in CHUNKS if f.name != "total_chunks"} - set(spark.read.parquet(f"{p}/chunks.parquet").columns)
            if not missing:
                return p
    raise FileNotFoundError(f"no corpus: set {name} to a folder with chunks.parquet")


def parse_index(c):
    """Blank or non-numeric: -1."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("int"), F.lit(-1))


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sources in order, tagged with their number; chunk_key is unique over all of them, load_ord orders rows as loaded."""
    out = None
    for i, p in enumerate(paths):
        raw = spark.read.parquet(f"{p}/chunks.parquet")
        df = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS])
        df = df.withColumn("db_idx", F.lit(i)).withColumn("load_ord", F.monotonically_increasing_id() + F.lit(i) * F.lit(1 << 55))
        out = df if out is None else out.unionByName(df)
    return out.withColumn("chunk_key", F.concat_ws(":", "db_idx", "id")).withColumn("chunk_index", parse_index(F.col("chunk_index")))


def decode_blob(c):
    """Little-endian 32-bit floats as an array, by way of their bits; all in the JVM."""
    n = (F.octet_length(c) / 4).cast("int")

    def one(i):
        h = F.concat(*[F.substring(F.hex(c), i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)])
        bits = F.conv(h, 16, 10).cast("long")
        e, m = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
        sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
        value = F.when(e == 0, m * F.lit(2.0**-149)).otherwise((F.lit(1.0) + m / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), e - 127))
        return (sign * value).cast("float")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<float>"))


def read_vectors(spark: SparkSession, paths: list[str], dim: int) -> DataFrame:
    """Vectors of all sources whose vectors have the expected length; a source of another length takes no part in the dense leg."""
    out = None
    for i, p in enumerate(paths):
        if not exists(spark, f"{p}/embeddings.parquet"):
            continue
        raw = spark.read.parquet(f"{p}/embeddings.parquet")
        col = "embedding" if "embedding" in raw.columns else "vector"
        v = decode_blob(F.col(col)) if dict(raw.dtypes)[col] == "binary" else F.col(col)
        first = raw.select(F.size(v).alias("n")).first()
        if first is None or first.n != dim:
            continue
        df = raw.select(F.concat_ws(":", F.lit(i), "chunk_id").alias("chunk_key"), v.alias("embedding")).where(F.size("embedding") == dim)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], "chunk_key string, embedding array<float>")


def read_clauses(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The clause units of all sources that have any; None where no source has a table of them."""
    out = None
    for i, p in enumerate(paths):
        if exists(spark, f"{p}/clauses.parquet"):
            raw = spark.read.parquet(f"{p}/clauses.parquet")
            df = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLAUSES], F.lit(i).alias("db_idx"))
            out = df if out is None else out.unionByName(df)
    return out


def dimension(metas: DataFrame, key: str = "embed_dim") -> DataFrame:
    """(value, mismatch): the first source's number under a key that is one, 0 if none is, and whether sources disagree."""
    own = metas.where(F.col("key") == key).select("db_idx", F.trim("value").try_cast("int").alias("value")).where("value is not null")
    return own.agg(F.coalesce(F.min_by("value", "db_idx"), F.lit(0)).alias("value"), (F.countDistinct("value") > 1).alias("mismatch"))


def meta_value(metas: DataFrame, key: str) -> DataFrame:
    """The value of the first source that has one, and whether sources disagree. metas: db_idx, key, value."""
    own = metas.where((F.col("key") == key) & F.col("value").isNotNull())
    return own.agg(F.min_by("value", "db_idx").alias("value"), (F.countDistinct("value") > 1).alias("mismatch"))


def clause_units(df: DataFrame, least: int = 120, most: int = 1200, overlap: int = 60, heading: str = r"(?m)^\s*(\d+(?:\.\d+)+)\s+[A-Z]") -> DataFrame:
    """Texts cut at clause headings into units of bounded length; long ones again into overlapping pieces, short ones dropped. df: key, text."""
    marked = F.regexp_replace("text", heading, "\u0001$0")
    units = df.select("key", F.posexplode(F.split(marked, "\u0001")).alias("unit", "body")).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    starts = F.expr(f"sequence(0, greatest(length(body) - {overlap} - 1, 0), {most - overlap})")
    cut = units.select("key", "unit", "body", F.explode(starts).alias("at"))
    return cut.select("key", "unit", "at", F.substring("body", F.col("at") + 1, F.lit(most)).alias("text")).where(F.length("text") >= least)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: source is the specification, lang the series; type, release and source number are derived."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sizes = d.groupBy(F.col("source").alias("s")).agg(F.count("*").cast("int").alias("total_chunks"))
    return (
        d.join(labels.select("doc_id", "quality"), "doc_id", "left").join(sizes, F.col("source") == F.col("s"), "left")
        .select(
            F.col("doc_id").alias("chunk_key"), F.col("source").alias("spec_id"), F.col("lang").alias("series"), F.col("lang").alias("series_desc"), F.expr("cast(doc_id div 20 as int)").alias("chunk_index"), "total_chunks",
            F.concat(F.lit("Rel-"), F.lit(15) + F.col("doc_id") % 4).alias("release"), F.when(F.col("quality") == 1, "TS").when(F.col("quality") == 0, "TR").alias("doc_type"),
            F.when(F.col("lang") == "en", 0).otherwise(1).alias("db_idx"), F.substring_index(F.ltrim("text"), "\n", 1).alias("title"), "text", F.col("doc_id").alias("load_ord"),
        )
    )


def vectors_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


def queries_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as queries, each with the vector of the same number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q")).join(v, "query_id", "left")
