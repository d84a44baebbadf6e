"""A report of matches as HTML: one page a query file, and index pages of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escaped
from ..session import materialise
from .rules import numbered

HEAD = "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Matches</title></head><body>"
TAIL = "</body></html>"


def match_piece(rank, label, distance, structure, trusted) -> Column:
    """One match: its rank, label, trust, distance (three digits) and structural score in percent (one digit, marked above 60)."""
    rank, label, distance, structure, trusted = (F.col(c) if isinstance(c, str) else c for c in (rank, label, distance, structure, trusted))
    tag = F.when(trusted, "trusted").otherwise("doubtful")
    mark = F.when(structure > 60, " class=\"high\"").otherwise("")
    first = F.when(rank == 1, " class=\"first\"").otherwise("")
    return F.concat(
        F.lit("<li"), first, F.lit("><b>"), rank.cast("string"), F.lit("</b> "), escaped(label), F.lit(" <i>"), tag, F.lit("</i> "),
        F.format_string("%.3f", F.round(distance, 3)), F.lit(" <span"), mark, F.lit(">"), F.format_string("%.1f%%", F.round(structure, 1)), F.lit("</span></li>"),
    )


def match_pages(files: DataFrame, matches: DataFrame) -> DataFrame:
    """(filename, trusted, html): the page of each file (filename), with its matches (filename, rank, label, vector_dist, structure_score, trusted) by rank.

    A page is trusted if its first match is; one without matches isn't. Pages hold the few matches that a search
    gives, so a page is folded in one row.
    """
    piece = match_piece("rank", "label", "vector_dist", "structure_score", "trusted")
    folded = matches.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("rank", piece.alias("piece")))).alias("m"), F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("trusted"))), F.lit(False)).alias("trusted"))
    joined = files.select("filename").join(folded, "filename", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    items = F.coalesce(F.concat_ws("", F.col("m.piece")), F.lit(""))
    title = F.concat(F.lit("<h1>"), F.when(F.col("trusted"), "+ ").otherwise("? "), escaped(F.col("filename")), F.lit("</h1><ol>"))
    return joined.select("filename", "trusted", F.concat(F.lit(HEAD), title, items, F.lit("</ol>" + TAIL)).alias("html"))


def index_pages(pages: DataFrame, entries: int = 1000) -> DataFrame:
    """(page, html): lists of the files of ``pages`` (filename, trusted) by name, ``entries`` a page, each naming the page after it.

    Files are numbered by a distributed sort, so that no task holds more than a page's entries at a time.
    """
    placed = numbered(pages.select("filename", "trusted"), ["filename"], 0, "place").withColumn("page", F.floor(F.col("place") / entries))
    line = F.concat(F.lit("<li>"), F.when(F.col("trusted"), "+ ").otherwise("? "), escaped(F.col("filename")), F.lit("</li>"))
    folded = placed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("m"))
    last = folded.select((F.col("page") - 1).alias("page"), F.lit(True).alias("more"))
    joined = folded.join(last, "page", "left")
    after = F.when(F.col("more"), F.concat(F.lit("<a href=\"index-"), (F.col("page") + 1).cast("string"), F.lit(".html\">more</a>"))).otherwise("")
    return joined.select("page", F.concat(F.lit(HEAD + "<ol>"), F.concat_ws("", F.col("m.line")), F.lit("</ol>"), after, F.lit(TAIL)).alias("html"))


def write_report(queries: DataFrame, answers: DataFrame, path: str, entries: int = 1000) -> None:
    """``path``/pages: one folder a query file (filename) with its page; ``path``/index: one folder an index page.

    ``answers`` are the rows of ``service.batch_response``. Former pages are replaced.
    """
    found = answers.select("filename", F.posexplode("results").alias("at", "r"))
    matches = found.select("filename", (F.col("at") + 1).alias("rank"), "r.label", "r.vector_dist", "r.structure_score", "r.trusted")
    pages = materialise(match_pages(queries.select("filename").distinct(), matches), "pages")
    pages.select(F.col("filename").alias("file"), "html").write.mode("overwrite").partitionBy("file").text(f"{path}/pages")
    index_pages(pages, entries).write.mode("overwrite").partitionBy("page").text(f"{path}/index")
