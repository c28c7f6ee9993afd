"""Views derived from the given tables that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.catalog.registry import table
from gleaner.functions import urls as U
from gleaner.operators.dedupe import uniq_by

# concat(x, '') hands the engine plain strings where it would keep dictionaries
POSTINGS_SQL = """
postings AS MATERIALIZED (
  SELECT o.o_orderkey AS seq, concat(p.p_name, '') AS title, concat(s.s_name, '') AS company,
    CASE WHEN o.o_orderkey % 5 = 0 THEN 'Remote' ELSE n.n_name END AS location,
    CASE WHEN o.o_orderkey % 31 = 0 THEN ''
         WHEN o.o_orderkey % 7 = 0 THEN concat('https://ats.example.com/careers/', CAST(o.o_custkey AS VARCHAR), '/')
         ELSE concat('https://jobs.example.com/view/', replace(p.p_name, ' ', '-'), '-',
                     CAST(100000 + o.o_custkey AS VARCHAR), '?position=', CAST(o.o_orderkey % 25 AS VARCHAR))
    END AS job_url,
    CAST(o.o_orderdate AS date) AS date_posted, o.o_totalprice AS salary, concat(o.o_orderstatus, '') AS job_type,
    substr(o.o_orderpriority, 1, 1) AS experience,
    CASE o.o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '1' END AS remote_code,
    o.o_orderkey % 2 = 0 AS verified, o.o_custkey % 30 AS applicants, concat(d.text, '') AS description
  FROM (SELECT * REPLACE (concat(o_orderstatus, '') AS o_orderstatus,
                          concat(o_orderpriority, '') AS o_orderpriority) FROM orders) o
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN (SELECT n_nationkey, concat(n_name, '') AS n_name FROM nation) n
    ON n.n_nationkey = c.c_nationkey
  JOIN (SELECT p_partkey, concat(p_name, '') AS p_name FROM part) p
    ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
  JOIN (SELECT s_suppkey, concat(s_name, '') AS s_name FROM supplier) s
    ON s.s_suppkey = o.o_custkey % (SELECT count(*) FROM supplier)
  JOIN (SELECT doc_id, concat(text, '') AS text FROM documents) d
    ON d.doc_id = o.o_orderkey % (SELECT count(*) FROM documents)
)"""

DETAILS_SQL = """
details AS (
  SELECT CAST(100000 + doc_id AS VARCHAR) AS job_id, text AS description FROM documents
)"""

CARDS_SQL = POSTINGS_SQL + """,
cards AS MATERIALIZED (
  SELECT seq, title AS position, company, location, CAST(date_posted AS VARCHAR) AS date,
    CAST(CAST(salary AS DECIMAL(18, 2)) AS VARCHAR) AS salary, job_url AS "jobUrl",
    concat(CAST(applicants AS VARCHAR), ' days ago') AS "agoTime"
  FROM postings
)"""


def _slot(key: str, dim: DataFrame):
    """Remainder of a key by the size of a table, worked out inside the plan."""
    return F.col(key) % dim.select(F.count(F.lit(1))).scalar()


def bare_postings(spark: SparkSession, folder: str) -> DataFrame:
    """One posting per order, with the document ``doc_slot`` that holds its text."""
    def read(name: str) -> DataFrame:
        return table(spark, folder, name)

    c = F.col
    order, cust = c("o_orderkey"), c("o_custkey").cast("string")
    part, supplier, documents = read("part"), read("supplier"), read("documents")
    # place and company depend on the customer alone, so they are settled there;
    # one customer may own many orders, which the adaptive skew join splits
    customers = (
        read("customer").withColumn("supp_slot", _slot("c_custkey", supplier))
        .join(read("nation"), c("n_nationkey") == c("c_nationkey"))
        .join(supplier, c("s_suppkey") == c("supp_slot"))
        .select("c_custkey", "n_name", "s_name")
    )
    orders = read("orders")
    narrow = (
        orders.withColumns({"part_slot": _slot("o_orderkey", part),
                            "doc_slot": _slot("o_orderkey", documents)})
        .join(customers, c("c_custkey") == c("o_custkey"))
        .join(part, c("p_partkey") == c("part_slot"))
    )
    board_url = F.concat(
        F.lit("https://jobs.example.com/view/"), F.replace("p_name", F.lit(" "), F.lit("-")),
        F.lit("-"), (c("o_custkey") + 100000).cast("string"),
        F.lit("?position="), (order % 25).cast("string"))
    return narrow.select(
        "doc_slot", order.alias("seq"), c("p_name").alias("title"), c("s_name").alias("company"),
        F.when(order % 5 == 0, "Remote").otherwise(c("n_name")).alias("location"),
        F.when(order % 31 == 0, "")
        .when(order % 7 == 0, F.concat(F.lit("https://ats.example.com/careers/"), cust, F.lit("/")))
        .otherwise(board_url).alias("job_url"),
        c("o_orderdate").cast("date").alias("date_posted"), c("o_totalprice").alias("salary"),
        c("o_orderstatus").alias("job_type"),
        F.substring("o_orderpriority", 1, 1).alias("experience"),
        F.when(order % 5 == 0, "2").when(order % 5 == 1, "3").otherwise("1").alias("remote_code"),
        (order % 2 == 0).alias("verified"), (c("o_custkey") % 30).alias("applicants"),
    )


def with_texts(spark: SparkSession, folder: str, rows: DataFrame, name: str = "description") -> DataFrame:
    """Postings with the text of their document as the last column, in place of ``doc_slot``.

    The text comes after all that is worked out from the other columns, so that a filter or a
    semi-join on those is done before any text is looked up.
    """
    texts = table(spark, folder, "documents").select("doc_id", F.col("text").alias(name))
    # Both sides grow with the data, so they are always dealt out by the document: no plan that holds one of them whole.
    return rows.join(texts.hint("merge"), F.col("doc_id") == F.col("doc_slot")).drop("doc_id", "doc_slot")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """One posting per order; the text comes from the documents table."""
    return with_texts(spark, folder, bare_postings(spark, folder))


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """The postings as board cards, without description."""
    c = F.col
    return postings(spark, folder).select(
        "seq", c("title").alias("position"), "company", "location",
        c("date_posted").cast("string").alias("date"),
        c("salary").cast("decimal(18,2)").cast("string").alias("salary"),
        c("job_url").alias("jobUrl"),
        F.concat(c("applicants").cast("string"), F.lit(" days ago")).alias("agoTime"))


def details(spark: SparkSession, folder: str) -> DataFrame:
    """Description by posting number, one row per document."""
    return table(spark, folder, "documents").select(
        (F.col("doc_id") + 100000).cast("string").alias("job_id"),
        F.col("text").alias("description"))


def unique_postings(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    return uniq_by(postings(spark, folder),
                   U.posting_key(c("job_url"), c("company"), c("title")))
