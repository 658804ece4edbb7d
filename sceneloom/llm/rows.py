"""Taking a stage's decisions back to whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.shared import null_safe_join, stored, with_lookup


def keyed(docs: DataFrame) -> DataFrame:
    """``doc, row``: all columns of each row, and what tells it from all others, its file and place in it.

    A table that is read from files as it is has both already; any other (a table of a database, say) is stored first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        docs = stored(docs, "rows")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), place.alias("row"))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 as lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, whose id and text ``decided(doc_id, text_sha256, kept)`` keeps.

    Decisions are taken by id and text together, null ids included, so a repeated id with another text and a null id
    each go by their own text. Of rows that share id and text one stays, the first by its place, whatever columns of any type there are. An empty
    table gives an empty result.
    """
    rows = keyed(docs)
    rows = rows.select("doc", "row", F.col(f"doc.`{id_col}`").alias("doc_id"), text_digest(F.col(f"doc.`{text_col}`")).alias("text_sha256"))
    gone = stored(decided.where("not kept").select("doc_id", "text_sha256").distinct(), "dropped")
    again = decided.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id", "text_sha256")
    again = stored(again, "repeats")
    on = ["doc_id", "text_sha256"]
    left = with_lookup(rows, gone, on, "left_anti")
    if again.isEmpty():
        return left.select("doc.*")
    places = with_lookup(rows.select("row", *on), again, on, "left_semi")
    first = places.groupBy(*on).agg(F.min("row").alias("first"))
    later = stored(null_safe_join(places, first, on).where("row <> first").select("row"), "later")
    return with_lookup(left, later, ["row"], "left_anti").select("doc.*")
