"""Round trips through the readers: driver tables written as text and read back, with their oracles over the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import sources
from strandmill.plans.registry import Registry, load
from strandmill.session import folder

REG = Registry()
Spark = SparkSession


def _clean(c: str) -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n|]", " ")


@REG.query(oracle="SELECT category, count(*) AS n, count(DISTINCT id) AS ids, sum(length(coalesce(name, '')))::BIGINT AS letters FROM merged_nodes GROUP BY category")
def read_tsv(spark: Spark, sf: str) -> DataFrame:
    """Nodes through a tab-separated file with a header."""
    path = folder(spark, "tsv")
    load(spark, sf, "merged_nodes").select(*[_clean(c).alias(c) for c in ("id", "name", "category")]).write.options(sep="\t", header=True, quote="", escape="").csv(path)
    t = sources.tsv(spark, path, ["id", "name", "category"])
    return t.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.length("name")).alias("letters"))


@REG.query(oracle="SELECT row_index::VARCHAR AS row_index, metabolite FROM metabolite_host_gene WHERE metabolite IS NOT NULL AND trim(metabolite) <> ''")
def read_csv_charset(spark: Spark, sf: str) -> DataFrame:
    """Curated names through a quoted CSV file in a charset of the platform."""
    path = folder(spark, "csv")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    load(spark, sf, "metabolite_host_gene").where("metabolite is not null and trim(metabolite) <> ''").select("row_index", "metabolite").write.options(header=True, encoding="gb18030", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return sources.csv_with_charset(spark, path, ["row_index", "metabolite"])


@REG.query(oracle="SELECT pmid, count(*) AS n, max(length(text))::INT AS longest FROM documents WHERE text IS NOT NULL AND pmid IS NOT NULL GROUP BY pmid")
def read_articles(spark: Spark, sf: str) -> DataFrame:
    """Documents as articles in JSON lines."""
    path = folder(spark, "articles")
    d = load(spark, sf, "documents").where("text is not null and pmid is not null")
    d.select("pmid", F.lit("t").alias("title"), F.col("text").alias("abstract"), F.array(F.struct(F.lit("d").alias("type"), F.col("source").alias("name"), F.col("source").alias("id"), F.lit("x").alias("db"))).alias("annotations")).write.json(path)
    return sources.articles(spark, path).groupBy("pmid").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("abstract")).alias("longest"))


@REG.query(oracle="SELECT edge_id AS sentence, arg_max(predicate, retrieved_at) AS predicate, count(*) > 1 AS repeated FROM merged_edges WHERE edge_id IS NOT NULL GROUP BY edge_id")
def read_votes(spark: Spark, sf: str) -> DataFrame:
    """Edges as vote lines of two batches: of equal keys the later batch counts."""
    e = load(spark, sf, "merged_edges").where("edge_id is not null")
    last = e.groupBy("edge_id").agg(F.max("retrieved_at").alias("m"), F.count(F.lit(1)).alias("k"))
    e = e.join(last, "edge_id")
    paths = []
    for late in (False, True):
        path = folder(spark, "votes")
        e.where((F.col("retrieved_at") == F.col("m")) == late).select(F.lit("1").alias("pmid"), F.col("edge_id").alias("sentence"), F.col("predicate").alias("evidence"), F.lit("p").alias("predicate"), (F.col("k") > 1).cast("string").alias("status")).write.json(path)
        paths.append(path)
    v = sources.vote_lines(spark, paths)
    return v.select("sentence", F.col("evidence").alias("predicate"), (F.col("status") == "true").alias("repeated"))


@REG.query(oracle="SELECT n_nationkey::VARCHAR AS taxid, n_name AS name, n_regionkey::VARCHAR AS parent FROM nation")
def read_dumps(spark: Spark, sf: str) -> DataFrame:
    """Nations as names and parents of a taxonomy dump."""
    n = load(spark, sf, "nation")
    names, nodes = folder(spark, "names"), folder(spark, "nodes")
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    n.select(line(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit(""), F.lit("scientific name"))).write.text(names)
    n.select(line(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.lit("species"))).write.text(nodes)
    return sources.ncbi_names(spark, names).join(sources.ncbi_nodes(spark, nodes), "taxid").select("taxid", "name", "parent")


@REG.query(oracle="SELECT event_type AS feature, 'd' || day(ts) AS sample, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def read_matrix(spark: Spark, sf: str) -> DataFrame:
    """Events as a wide matrix of kinds by days, read as long rows."""
    path = folder(spark, "matrix")
    e = load(spark, sf, "events").select("event_type", F.concat(F.lit("d"), F.dayofmonth("ts")).alias("d"), "value")
    days = sorted(r.d for r in e.select("d").distinct().collect())  # 31 at most
    e.groupBy("event_type").pivot("d", days).agg(F.round(F.sum("value"), 4)).coalesce(1).write.options(sep="\t", header=True).csv(path)
    return sources.long_matrix(spark, path, "c").where("value <> 0").select("feature", "sample", F.round("value", 4).alias("value"))


@REG.query(oracle="SELECT DISTINCT 'k__x|s__' || replace(name, ' ', '_') AS lineage FROM merged_nodes WHERE category = 'Species' AND name IS NOT NULL")
def read_lineages(spark: Spark, sf: str) -> DataFrame:
    """Species as lineages of a profile."""
    path = folder(spark, "lineages")
    n = load(spark, sf, "merged_nodes").where("category = 'Species' and name is not null").select(F.concat(F.lit("k__x|s__"), F.translate("name", " ", "_"), F.lit("\t1"))).distinct()
    n.write.text(path)
    return sources.lineages(spark, path, "p").select("lineage").distinct()


@REG.query(oracle="SELECT 'C' || c_custkey AS id, n_regionkey || '.' || n_nationkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey")
def read_trees(spark: Spark, sf: str) -> DataFrame:
    """Customers as descriptors of an XML dump with one tree number each."""
    path = folder(spark, "xml")
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.struct(F.array(F.concat_ws(".", "n_regionkey", "n_nationkey")).alias("TreeNumber")).alias("TreeNumberList")
    c.select(F.concat(F.lit("C"), "c_custkey").alias("DescriptorUI"), number).write.format("xml").options(rootTag="DescriptorRecordSet", rowTag="DescriptorRecord").save(path)
    return sources.mesh_trees(spark, path)
