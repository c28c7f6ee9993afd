"""Text expressions over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.catalog import registry as Q
from gleaner.catalog.registry import query, table
from gleaner.functions import rules as R
from gleaner.functions import text as X
from gleaner.operators.dictionary import match_substrings, match_vocab
from gleaner.session import scratch_path
from gleaner.sources.tables import CSV_OPTIONS, write_postings_csv


def _documents(spark, folder):
    return table(spark, folder, "documents")


@query("slug", f"SELECT doc_id, {Q.sql_slug('text')} AS slug FROM documents")
def slug(spark, folder):
    return _documents(spark, folder).select("doc_id", X.slug(F.col("text")).alias("slug"))


_FLAT = Q.sql_collapse("text")


@query("clean_text", f"""
SELECT doc_id, CASE WHEN length({_FLAT}) > 1500 THEN left({_FLAT}, 1499) || '…' ELSE {_FLAT} END
  AS cleaned FROM documents""")
def clean_text(spark, folder):
    return _documents(spark, folder).select("doc_id", X.cleaned(F.col("text")).alias("cleaned"))


@query("emails", f"SELECT doc_id, {Q.sql_sorted(Q.sql_emails('text'))} AS emails FROM documents")
def emails(spark, folder):
    found = F.array_sort(X.emails(F.col("text")))
    return _documents(spark, folder).select("doc_id", X.listed(found).alias("emails"))


@query("phones", f"SELECT doc_id, {Q.sql_sorted(Q.sql_phones('text'))} AS phones FROM documents")
def phones(spark, folder):
    found = F.array_sort(X.phones(F.col("text")))
    return _documents(spark, folder).select("doc_id", X.listed(found).alias("phones"))


@query("skills", f"SELECT doc_id, {Q.sql_skills('text')} AS skills FROM documents")
def skills(spark, folder):
    found = X.vocabulary_hits(F.col("text"), Q.SKILLS)
    return _documents(spark, folder).select("doc_id", X.listed(found).alias("skills"))


@query("contacts", f"""
WITH found AS (
  SELECT 'email' AS kind, unnest({Q.sql_emails('text')}) AS value FROM documents
  UNION ALL
  SELECT 'phone' AS kind, unnest({Q.sql_phones('text')}) AS value FROM documents)
SELECT kind, value, count(*) AS documents FROM found GROUP BY kind, value""")
def contacts(spark, folder):
    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    both = F.concat(tagged("email", X.emails(F.col("text"))),
                    tagged("phone", X.phones(F.col("text"))))
    return (
        _documents(spark, folder).select(F.inline(both))
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("documents"))
    )


@query("token_filter", f"""
SELECT doc_id FROM documents
WHERE {Q.sql_any('text', Q.INCLUDE)} AND NOT {Q.sql_any('text', Q.EXCLUDE)}""")
def token_filter(spark, folder):
    keep = R.tokens_ok(F.lit(""), F.col("text"), Q.INCLUDE, Q.EXCLUDE)
    return _documents(spark, folder).filter(keep).select("doc_id")


_TERMS = ("rest", "license", "c", "c++", "the", "mit license")
_TERM_ROWS = ", ".join(
    "({}, {})".format(Q.quoted(t), Q.quoted(r"\b" + t.replace("+", r"\+") + r"\b")) for t in _TERMS)


@query("skill_counts", f"""
WITH vocab(term, pattern) AS (
  SELECT * FROM (VALUES {_TERM_ROWS}) v(term, pattern)
  UNION SELECT DISTINCT p_name, '\\b' || p_name || '\\b' FROM part
  UNION SELECT DISTINCT lower(event_type), '\\b' || lower(event_type) || '\\b' FROM events)
SELECT term, count(*) AS documents FROM documents JOIN vocab
  ON regexp_matches(lower(text), pattern) GROUP BY term""")
def skill_counts(spark, folder):
    """Documents per dictionary term; the dictionary is itself read from tables."""
    listed = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    vocab = (
        listed.union(table(spark, folder, "part").select("p_name"))
        .union(table(spark, folder, "events").select(F.lower("event_type"))).distinct()
    )
    pairs = match_vocab(_documents(spark, folder), "doc_id", "text", vocab)
    return pairs.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


@query("part_mentions", """
WITH words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
vocab AS (SELECT p_name AS term FROM part UNION SELECT word FROM words UNION SELECT right(word, 3) FROM words)
SELECT doc_id, term FROM documents JOIN vocab ON contains(lower(text), lower(term))""")
def part_mentions(spark, folder):
    """Names of parts, their words and the words' last three letters, wherever they occur in a document."""
    names = table(spark, folder, "part").select("p_name")
    words = names.select(F.explode(F.split("p_name", " ")).alias("word"))
    vocab = names.union(words).union(words.select(F.right("word", F.lit(3)))).withColumnRenamed("p_name", "term")
    return match_substrings(_documents(spark, folder), "doc_id", "text", vocab)


@query("csv_round_trip", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, md5(text) AS text_md5 FROM documents""")
def csv_round_trip(spark, folder):
    """Documents through the CSV sink and back; texts hold quotes and line breaks."""
    path = scratch_path(spark, "csv")
    columns = ("doc_id", "lang", "text")
    write_postings_csv(_documents(spark, folder), path, columns)
    back = (
        spark.read.options(**CSV_OPTIONS).option("multiLine", True).option("lineSep", "\n")
        .schema(", ".join(f"{c} string" for c in columns)).csv(path)
    )
    return back.select("doc_id", "lang", F.md5(X.text(F.col("text"))).alias("text_md5"))
