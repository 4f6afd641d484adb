"""Backfill (Q3): recompute the metadata block of stored notes, keep the
body, count candidates / eligible / changed (A7), optionally write, or merge the
result into the note store (K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions.text import yaml_quote
from ..operators.notes import ARCHIVE_FOLDER, INBOX_FOLDER, backfill_counts, backfill_metadata, list_value
from ..session import stage
from ..sinks.notes import write_backfill
from ..sinks.store import NoteStore


def backfill(note_files: DataFrame, as_of, out_path: str | None = None,
             folders=(INBOX_FOLDER, ARCHIVE_FOLDER), overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns (per-note rows, counts). Writes to ``out_path`` when given."""
    rows = backfill_metadata(note_files, as_of, folders, overwrite)
    if out_path:
        write_backfill(rows, out_path)
    return rows, backfill_counts(note_files, rows, folders)


def _fields(meta) -> dict:
    """The metadata block as rendered frontmatter values, in note order."""
    quoted = {k: yaml_quote(meta[k]) for k in ("title", "publication", "publication_date", "author", "summary")}
    return {"note_id": meta["note_id"], "title": quoted["title"], "publication": quoted["publication"],
            "publication_date": quoted["publication_date"], "author": quoted["author"],
            "topics": list_value(meta["topics"]), "entities": list_value(meta["entities"]), "summary": quoted["summary"],
            "claims": list_value(meta["claims"], quote=True), "relevance": list_value(meta["relevance"]),
            "time_sensitivity": meta["time_sensitivity"]}


def backfill_merge(store: NoteStore, as_of, batch: str | None = None, folders=(INBOX_FOLDER, ARCHIVE_FOLDER),
                   overwrite: bool = False) -> int:
    """K4: recompute the metadata of the store's notes (columns ``path``, the
    key, and ``value``, the Markdown text) and put the changed frontmatter into
    them, body kept. Only the texts of changed notes are staged, and only partitions
    that hold one are written anew; a run that finds nothing to change commits nothing.
    Returns the number of partitions written."""
    table = store.rows()
    if table is None:
        return 0
    # One pass, without a join of the table with itself. Nothing is filtered before it is
    # staged: a filter pushed below the metadata would work them out again for every field.
    rows = backfill_metadata(table, as_of, folders, overwrite, keep=("value", store.partition_by))
    merged = rows.select("path", store.partition_by, "value", "changed",
                         FM.replace_fields("value", _fields(F.col("meta"))).alias("merged"))
    new = stage(merged.select("path", store.partition_by, F.when(F.col("changed") & (F.col("merged") != F.col("value")), F.col("merged"))
                              .alias("value")), how="table").where(F.col("value").isNotNull())
    return store.update(new, batch or f"backfill:{as_of}", ["value"])
