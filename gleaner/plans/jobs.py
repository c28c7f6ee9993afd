"""Feeds run on landed files: read, curate, write, remember.

Each job writes its rows to a Parquet table first.  Later steps read that
table, so nothing is computed twice and row numbers stay fixed.  Its stages are kept under
the run's name until it is done: a run that failed goes on where it stopped.  The tables are
versioned, so readers, and the run after a failed one, see a whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner import schema as S
from gleaner.config import Config
from gleaner.functions import text as X
from gleaner.functions import urls as U
from gleaner.operators.dedupe import greedy_dedupe, uniq_by
from gleaner.operators.enrich import only_new
from gleaner.operators.shape import as_place
from gleaner.plans.feeds import accepted_hits, board_feed, combined_feed, likely_cards, web_feed
from gleaner.sources.hits import read_hits
from gleaner.sources.pages import extract_cards, extract_detail, extract_jsonld
from gleaner.sources.state import append_seen, load_seen
from gleaner.sources.tables import BOARD_FILE_NAME, read_latest, read_postings_csv, write_postings_csv
from gleaner.sources.versions import Journal, Versions

def numbered(cards: DataFrame, page: str = "page_id") -> DataFrame:
    """``seq`` from page and place on the page; the page's id may be a number or a text."""
    return cards.withColumn("seq", as_place(cards, page).withField("item", F.col("item_pos").cast("long")))


def first_filled(rows: DataFrame, key: str, body: str, order: list[str]) -> DataFrame:
    """One row per key: the first in ``order`` whose ``body`` says anything, else the first."""
    blank = (X.text(F.col(body)) == "").cast("int")
    return uniq_by(rows.withColumn("_order", F.struct(blank, *order)), F.col(key), "_order").drop("_order")


def landing_order(rows: DataFrame) -> list[str]:
    """The columns that tell when a page landed; without any, the text settles ties."""
    return [c for c in ("landed_at", "seq") if c in rows.columns]


def run_board(spark: SparkSession, pages: DataFrame, detail_pages: DataFrame, out: str,
              day: str, run: str, config: Config = Config()) -> DataFrame | None:
    """``pages(page_id, html)`` and ``detail_pages(job_id, html)`` to CSV and seen keys.

    Detail pages of the cards that pass the cheap tests are parsed, and no
    others.  Several pages of one job: the first that has a text counts, in
    order of ``landed_at`` or ``seq`` where the table has them.  The seen keys
    grow even when there is nothing new to write; a run without any row leaves
    the table and the file of the run before as they are.  Returns the rows
    written, or None.
    """
    journal = Journal(spark, out, "board", day, run)

    def curated() -> DataFrame:
        cards = journal.keep("cards", lambda: likely_cards(numbered(extract_cards(pages)), config))
        wanted = cards.select(U.job_id(F.col("jobUrl")).alias("job_id")).filter("job_id is not null").distinct()
        landed = detail_pages.join(wanted, "job_id", "left_semi")
        order = landing_order(landed)
        texts = extract_detail(landed.select(F.struct("job_id", *order).alias("page"), "html"), "page")
        details = first_filled(texts.select("page.*", "description"), "job_id", "description", order or ["description"])
        return board_feed(cards, details, config)

    rows = journal.keep("rows", curated)
    written = None
    if not rows.isEmpty():
        fresh = rows
        if config.incremental:
            # a repeated run must not see the keys its first attempt remembered
            earlier = load_seen(spark, f"{out}/board_seen").filter(F.col("run") != run)
            fresh = journal.keep("fresh", lambda: only_new(rows, earlier, "li_job_id"))
        if not fresh.isEmpty():
            written = Versions(spark, f"{out}/board_table").write(fresh)
            write_postings_csv(written, f"{out}/{BOARD_FILE_NAME}")
        append_seen(rows.select("li_job_id"), f"{out}/board_seen", day, run)
    journal.finish()
    return written


def run_web(spark: SparkSession, hits_path: str, landed: DataFrame, out: str, day: str, run: str,
            config: Config = Config()) -> DataFrame:
    """Response pages and ``landed(url, html)`` to CSV and today's seen links.

    Only pages that an accepted, new hit links to are looked at; of several the
    first that is not empty counts.
    """
    seen = load_seen(spark, f"{out}/web_seen", day).filter(F.col("run") != run)
    journal = Journal(spark, out, "web", day, run)

    def curated() -> DataFrame:
        hits = journal.keep("hits", lambda: only_new(accepted_hits(read_hits(spark, hits_path), config), seen, "link"))
        wanted = hits.select(F.col("link").alias("url"))
        linked = landed.join(wanted, "url", "left_semi")
        order = landing_order(linked)
        found = extract_jsonld(first_filled(linked, "url", "html", order or [F.xxhash64("html"), "html"]))
        return web_feed(hits, found, config)

    rows = Versions(spark, f"{out}/web_table").write(journal.keep("rows", curated))
    write_postings_csv(rows, f"{out}/{config.out_csv}", S.WEB_COLUMNS)
    append_seen(rows.select("job_url"), f"{out}/web_seen", day, run)
    journal.finish()
    return rows


def write_audit_and_clean(web: DataFrame, board: DataFrame, out: str) -> DataFrame:
    """Raw union and deduped union, each as a table and as CSV; returns the clean one."""
    spark = web.sparkSession
    audit = Versions(spark, f"{out}/combined_all_table").write(combined_feed(web, board))
    write_postings_csv(audit, f"{out}/combined_results_all.csv")
    clean = Versions(spark, f"{out}/combined_table").write(greedy_dedupe(audit))
    write_postings_csv(clean, f"{out}/combined_results.csv")
    return clean


def run_merge(spark: SparkSession, folder: str, out: str, multi_line: bool = True) -> DataFrame:
    """Newest web file and the board file of a folder, merged; either may be a folder of part files."""
    web = read_latest(spark, folder)
    board = read_postings_csv(spark, f"{folder}/{BOARD_FILE_NAME}", multi_line=multi_line)
    return write_audit_and_clean(web, board, out)


def run_all(spark: SparkSession, pages: DataFrame, detail_pages: DataFrame, hits_path: str,
            landed: DataFrame, out: str, day: str, run: str,
            config: Config = Config()) -> DataFrame:
    """Web, board, then the merge of what stands in both tables.

    The board table holds the rows last written, as the board's file does: the
    new ones of an incremental run, or those of the run before if there were none.
    """
    web = run_web(spark, hits_path, landed, out, day, run, config)
    board = run_board(spark, pages, detail_pages, out, day, run, config)
    if board is None:
        board = Versions(spark, f"{out}/board_table").read()
    if board is None:
        board = spark.createDataFrame([], T.StructType([*S.UNIFIED.fields, T.StructField("seq", S.PLACE)]))
    return write_audit_and_clean(web, board, out)
