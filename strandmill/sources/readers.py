"""Text, CSV, JSON lines, dumps, matrices, XML and workbooks as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.gates import GateError, require_columns


def tsv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A tab-separated file with a header: every column text, empty cells kept as empty text, no quoting."""
    df = spark.read.options(sep="\t", header=True, quote="").csv(path).na.fill("")
    return require_columns(df, required, path)


def table_header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a tab-separated file, from its first line."""
    return tsv(spark, path).columns


def csv_with_charset(spark: SparkSession, path: str, required: Sequence[str] = (), charset: str = "gb18030", fallback: str | None = None) -> DataFrame:
    """A CSV file with quoted, multi-line cells in a charset of the platform.

    Charsets beyond Spark's own list need ``spark.sql.legacy.javaCharsets``, which is set for the session, as the file
    is read later than this call. With a ``fallback``, the first charset is tried on the file's bytes and the other one
    taken if they don't decode.
    """
    if fallback:
        charset = _decodes(spark, path, charset, fallback)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.options(header=True, multiLine=True, encoding=charset, quote='"', escape='"').csv(path)
    return require_columns(df, required, path)


def _decodes(spark: SparkSession, path: str, first: str, second: str) -> str:
    """``first`` if all bytes of the files decode by it, else ``second``: each file is tried where it is read, on any file system."""

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = 0
            for content in pdf["content"]:
                try:
                    bytes(content).decode(first)
                except UnicodeDecodeError:
                    bad += 1
            yield pd.DataFrame({"bad": [bad]})

    bad = spark.read.format("binaryFile").load(path).select("content").mapInPandas(tried, "bad long").agg(F.sum("bad")).first()[0]
    return second if bad else first


ARTICLE = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "name", "id", "db")]))),
    ]
)


def articles(spark: SparkSession, path: str, ids: Sequence[str] = ()) -> DataFrame:
    """Articles from JSON lines; with ``ids``, those annotated with one of them (letter case ignored)."""
    df = spark.read.schema(ARTICLE).json(path)
    if ids:
        wanted = F.array(*[F.lit(i.upper()) for i in ids])
        df = df.where(F.exists("annotations", lambda a: F.array_contains(wanted, F.upper(a["id"]))))
    return df


_END = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "mention", "category")])
VOTE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("pmid", "sentence", "evidence", "predicate", "status", "polarity")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("subject", _END), T.StructField("object", _END), T.StructField("votes", T.ArrayType(T.StringType())), T.StructField("judge", T.StructType([T.StructField("verdict", T.StringType())]))]
)


def vote_lines(spark: SparkSession, paths: Sequence[str], key: Sequence[str] = ("pmid", "sentence", "predicate")) -> DataFrame:
    """Relation votes of several batches: malformed lines are left out, and of equal keys the row of the later batch is kept."""
    out = None
    for batch, path in enumerate(paths):
        df = spark.read.schema(VOTE).option("mode", "DROPMALFORMED").json(path).withColumn("batch", F.lit(batch)).withColumn("line", F.monotonically_increasing_id())
        out = df if out is None else out.unionByName(df)
    keep = F.struct(*[c for c in out.columns if c not in key])
    last = out.groupBy(*key).agg(F.max_by(keep, F.struct("batch", "line")).alias("r"))
    return last.select(*key, "r.*").drop("line")


def dump_lines(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Lines with fields parted by tab, bar, tab and ended by tab, bar."""
    parts = F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t")
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def ncbi_names(spark: SparkSession, path: str) -> DataFrame:
    return dump_lines(spark, path, ["taxid", "name", "unique_name", "name_class"])


def ncbi_nodes(spark: SparkSession, path: str) -> DataFrame:
    return dump_lines(spark, path, ["taxid", "parent", "rank"])


def long_matrix(spark: SparkSession, path: str, cohort: str) -> DataFrame:
    """``cohort, feature, sample, value`` of a wide tab-separated matrix; empty and ``NA`` cells are 0, of repeated features the last row counts."""
    df = tsv(spark, path).withColumn("__line", F.monotonically_increasing_id())
    first, samples = df.columns[0], df.columns[1:-1]
    if not samples:
        raise GateError(f"{path}: a matrix without samples")
    last = df.withColumn("__r", F.row_number().over(Window.partitionBy(first).orderBy(F.desc("__line")))).where("__r = 1")
    long = last.select(F.col(f"`{first}`").alias("feature"), F.explode(F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").alias("v")) for s in samples])).alias("c"))
    number = F.when(F.col("c.v").isNull() | F.trim("c.v").isin("", "NA"), 0.0).otherwise(F.col("c.v").cast("double"))
    return long.select(F.lit(cohort).alias("cohort"), "feature", F.col("c.sample").alias("sample"), number.alias("value"))


def header_ids(spark: SparkSession, path: str, stratified: bool = False) -> DataFrame:
    """``sample``: the ids in a matrix header; of stratified ones the part before the bar."""
    ids = [c.split("|")[0] if stratified else c for c in table_header(spark, path)[1:]]
    return spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "sample string")


def lineages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """``source, lineage`` of a profile whose first column is the lineage; comment lines are left out."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t")[0].alias("lineage"))
    return rows.where(F.col("lineage").rlike("(^|\\|)[sg]__")).select(F.lit(source).alias("source"), "lineage")


def feature_list(spark: SparkSession, path: str) -> DataFrame:
    """``token, name, family`` of an external finding list; a missing file is an empty list (the empty-evidence arm)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "token string, name string, family string")
    last = F.element_at(F.split("feature", r"\|"), -1)
    token = F.when(F.substring(last, 1, 3).isin("s__", "g__"), F.substring(last, 1, 3)).otherwise("")
    return tsv(spark, path, ["feature", "family"]).select(token.alias("token"), F.translate(F.when(token != "", F.substring(last, 4, 10000)).otherwise(last), "_", " ").alias("name"), "family")


def mesh_trees(spark: SparkSession, path: str, row_tag: str = "DescriptorRecord") -> DataFrame:
    """``id, path``: descriptors of an XML dump (also compressed) with each of their tree numbers."""
    schema = T.StructType([T.StructField("DescriptorUI", T.StringType()), T.StructField("TreeNumberList", T.StructType([T.StructField("TreeNumber", T.ArrayType(T.StringType()))]))])
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return df.select(F.col("DescriptorUI").alias("id"), F.explode_outer("TreeNumberList.TreeNumber").alias("path"))


def workbook_pairs(spark: SparkSession, path: str, literature: str = "Literature", association: str = "Association", columns: Sequence[int] = (0, 1, 3, 8, 9)) -> DataFrame:
    """Two sheets of a workbook joined by their index: literature rows by position with the association rows that name them.

    Needs ``openpyxl``, which is loaded here only; a workbook holds a million rows at most, so it is read on the driver.
    """
    try:
        import openpyxl
    except ImportError as e:
        raise GateError("reading workbooks needs openpyxl; convert the sheets to parquet instead") from e
    book = openpyxl.load_workbook(path, read_only=True)
    text = lambda v: None if v is None else str(v)
    lit = [tuple(text(r[i]) if i < len(r) else None for i in columns) for r in book[literature].iter_rows(min_row=2, values_only=True)]
    ass = [tuple(text(v) for v in r[:3]) for r in book[association].iter_rows(min_row=2, values_only=True)]
    a = spark.createDataFrame(lit, ", ".join(f"c{i} string" for i in columns))
    b = spark.createDataFrame(ass, "idx string, taxid string, alteration string")
    return b.join(a, F.col("idx") == F.col(f"c{columns[0]}"), "left")
