"""Tables, and pairs of a request and a query assembled from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import qlang
from ..functions.vocab import RETRIEVAL_STOPWORDS


#: Tables whose rows take long to work on.
HEAVY = ("documents", "orders", "pages")
#: Rows of a task that works on assembled queries; each row takes some 0.1 ms.
PAIRS_PER_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. One of long texts that comes in fewer pieces than there are cores (a single small
    file) is dealt out first; a large one is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in HEAVY and df.rdd.getNumPartitions() < cores else df


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


STOP_SQL = sql_list(dict.fromkeys(RETRIEVAL_STOPWORDS))


def tokens_sql(text: str) -> str:
    """X1 in DuckDB's SQL."""
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w))"


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured request for each order: author, topic, years, operator, closed values (some wrong).

    Rows are few bytes and much work, so joins that go by bytes leave them in as many tasks as there are cores; they are
    dealt out by their number, and a larger table has more tasks, not longer ones."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tasks = max(spark.sparkContext.defaultParallelism, -(-o.count() // PAIRS_PER_TASK))
    o = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_custkey"), "p_name", "p_type", "p_size")
    x = o.join(c, "o_custkey").join(p, "o_custkey").repartition(tasks, "o_orderkey")
    # A filter on an assembled query would be moved below the dealing, into few tasks; it stays above a generator.
    x = x.select(F.inline(F.array(F.struct("o_orderkey", "c_name", "p_name", "p_type", "p_size", "y"))))
    k = F.col("o_orderkey")
    doctypes = F.when(k % 5 == 0, F.array(F.lit("article"))).when(k % 5 == 1, F.array(F.lit("journal"), F.lit("eprint"))).when(k % 5 == 2, F.array(F.lit("PhDThesis"), F.lit("article"))).when(k % 5 == 3, F.array(F.lit("memo"))).otherwise(F.expr("cast(array() as array<string>)"))
    properties = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Refereed"))).otherwise(F.expr("cast(array() as array<string>)"))
    op = F.when(k % 8 == 0, "citations").when(k % 8 == 1, "references").when(k % 8 == 2, "trending").when(k % 8 == 3, "similar")
    return x.select(k.alias("id"), F.col("c_name").alias("author"), F.col("p_name").alias("topic"), F.lower("p_type").alias("category"), "y", op.alias("operator"), doctypes.alias("doctype"), properties.alias("property"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, natural_language, ads_query, category`` assembled from the intents."""
    x = intents(spark, sf_dir)
    body = qlang.join_clauses(
        qlang.author_clause(F.array("author")),
        qlang.abstract_clause(F.array("topic")),
        qlang.year_clause(F.col("y"), F.col("y") + 2),
        qlang.enum_clause("doctype", F.col("doctype")),
        qlang.enum_clause("property", F.col("property")),
    )
    nl = F.concat(F.lit("papers by "), F.col("author"), F.lit(" about "), F.col("topic"), F.lit(" since "), F.col("y").cast("string"))
    return x.select("id", nl.alias("natural_language"), qlang.wrap(body, F.col("operator")).alias("ads_query"), "category")


PAIRS_SQL = """
intents AS (
  SELECT o_orderkey AS id, c_name AS author, p_name AS topic, lower(p_type) AS category, year(o_orderdate)::INTEGER AS y,
    CASE o_orderkey % 8 WHEN 0 THEN 'citations' WHEN 1 THEN 'references' WHEN 2 THEN 'trending' WHEN 3 THEN 'similar' END AS operator,
    CASE o_orderkey % 5 WHEN 0 THEN ' doctype:article' WHEN 1 THEN ' doctype:eprint' WHEN 2 THEN ' doctype:(article OR phdthesis)' ELSE '' END AS d,
    CASE WHEN p_size % 3 = 0 THEN ' property:refereed' ELSE '' END AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON o_custkey = p_partkey
), pairs AS (
  SELECT id, 'papers by ' || author || ' about ' || topic || ' since ' || y AS natural_language,
    CASE WHEN operator IS NULL THEN '' ELSE operator || '(' END || 'author:"' || author || '" abs:"' || topic || '" pubdate:[' || y || ' TO ' || (y + 2) || ']' || d || p || CASE WHEN operator IS NULL THEN '' ELSE ')' END AS ads_query, category
  FROM intents
)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with a fault put into most queries, by the id."""
    q, k = F.col("ads_query"), F.col("id")
    bad = (
        F.when(k % 11 == 0, F.concat(q, F.lit(" AND")))
        .when(k % 11 == 1, F.concat(F.lit("OR "), q))
        .when(k % 11 == 2, F.concat(q, F.lit(" foo:bar")))
        .when(k % 11 == 3, F.concat(q, F.lit(' "open')))
        .when(k % 11 == 4, F.concat(q, F.lit(" pubdate:[2000]")))
        .when(k % 11 == 5, F.concat(q, F.lit(" doctype:memo")))
        .when(k % 11 == 6, F.concat(q, F.lit(" (abs:x")))
        .when(k % 11 == 7, F.concat(q, F.lit(" AND OR property:(refereed OR nonsense)")))
        .otherwise(q)
    )
    return pairs(spark, sf_dir).withColumn("ads_query", bad)


FAULTY_SQL = (
    PAIRS_SQL
    + """, faulty AS (
  SELECT id, natural_language, category, CASE id % 11 WHEN 0 THEN ads_query || ' AND' WHEN 1 THEN 'OR ' || ads_query WHEN 2 THEN ads_query || ' foo:bar'
    WHEN 3 THEN ads_query || ' "open' WHEN 4 THEN ads_query || ' pubdate:[2000]' WHEN 5 THEN ads_query || ' doctype:memo'
    WHEN 6 THEN ads_query || ' (abs:x' WHEN 7 THEN ads_query || ' AND OR property:(refereed OR nonsense)' ELSE ads_query END AS ads_query
  FROM pairs
)"""
)
