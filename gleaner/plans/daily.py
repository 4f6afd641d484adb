"""Daily run (Q2), dry run (K3) and run summary (A1).

union sources -> drop blank URLs (F1) -> drop stored URLs (J1, before the
funnel: T3) -> relevance funnel (Q1) -> keep-first dedup in run order (X3,
T30) -> enrichment (U2) -> quarantine (K5) -> interest threshold (F3) ->
rendered notes (K2) and, given their paths, append to the note table (K1) and
the quarantine log (K5).

A source or the funnel may fail: a source that cannot be read contributes no rows
and a funnel that fails lets its items pass ungated, each with a row in the
quarantine (stage ``adapter`` or ``funnel``), and the run goes on with the rest (U3).

An item is known by its ``item_key`` in all of J1, X3 and K1 (a chart track is
more than its page's URL, T1) and within the run by ``item_no``, which is unique
whatever the sources' own positions. Every item ends with exactly one ``fate``;
the run summary is one aggregate over that ledger (T2: separate counters plus
their sum).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_per_key, known_keys
from ..operators.enrich import enrich_prompt_columns, interest_filter, parse_enrichment, split_quarantine
from ..operators.gate import run_order
from ..operators.infer import Backend, infer_distinct
from ..operators.items import drop_blank_url, item_key, union_sources
from ..operators.lenses import first_lens_col, lens_library, lookup_col, summary_col
from ..operators.notes import render_note
from ..schemas import QUARANTINE, RAW_ITEM
from ..session import stage
from ..sinks.notes import write_notes, write_quarantine
from ..sinks.store import NoteStore
from .funnel import run_funnel

FATES = ("blank_url", "already_stored", "rejected", "dup_in_run", "failed", "below_threshold", "written")

# Columns of the note table (K1).
NOTE_COLUMNS = ("item_no", "seq", "item_key", "adapter", "source", "source_url", "note_id", "date", "observation",
                "tags", "interest_level", "lenses", "bucket", "meta", "markdown")


@dataclass
class RunResult:
    notes: DataFrame        # rendered notes that pass the threshold
    quarantine: DataFrame   # rows whose enrichment could not be used
    ledger: DataFrame       # (item_no, seq, adapter, source_url, fate) for every fetched item
    summary: DataFrame      # one row of counters


def run_summary(ledger: DataFrame) -> DataFrame:
    """A1: fetched, per-fate counters, ``skipped_dedup`` (blank + stored +
    duplicate + rejected, what the reference reports as one number) and
    ``processed`` (enriched, usable or not)."""
    f = F.col("fate")
    cnt = {k: F.count_if(f == k).cast("bigint").alias(k) for k in FATES}
    out = ledger.agg(F.count(F.lit(1)).cast("bigint").alias("fetched"), *cnt.values())
    return out.select(
        "fetched", *FATES,
        (F.col("blank_url") + F.col("already_stored") + F.col("dup_in_run") + F.col("rejected")).alias("skipped_dedup"),
        (F.col("below_threshold") + F.col("written")).alias("processed"))


#: A source: its items, or what makes them when called.
Source = DataFrame | Callable[[], DataFrame]


def _failure(stage_name: str, kind: str, name: str, exc: Exception) -> tuple:
    return (None, stage_name, kind, f"{name}: {type(exc).__name__}: {exc}"[:2000])


def _opened(sources: Sequence[Source], names: Sequence[str], failures: list) -> list[tuple[str, DataFrame]]:
    """The sources that can be made at all (planned, not read yet)."""
    out = []
    for name, source in zip(names, sources):
        try:
            out.append((name, source if isinstance(source, DataFrame) else source()))
        except Exception as exc:  # the source is left out, whatever is wrong with it
            failures.append(_failure("adapter", "adapter_error", name, exc))
    return out


def _staged_items(sources: list[tuple[str, DataFrame]], prepare, staging: str, failures: list) -> DataFrame:
    """The union of the sources, prepared and staged. Only if that fails each source
    is staged by itself, and those that fail are left out."""
    spark = SparkSession.active()
    try:
        if sources:
            return stage(prepare(union_sources(*[df for _, df in sources])), staging)
    except Exception:  # which one it was shows below; an error of all of them is raised there
        pass
    good = []
    for name, df in sources:
        try:
            good.append(stage(union_sources(df), "table"))
        except Exception as exc:
            failures.append(_failure("adapter", "adapter_error", name, exc))
    return stage(prepare(union_sources(*good) if good else spark.createDataFrame([], RAW_ITEM)), staging)


def daily_run(sources: Sequence[Source], *, known: DataFrame | None, lens_files: DataFrame,
              gate_backends: Sequence[Backend], enrich_backends: Sequence[Backend], as_of,
              exemplar_block: Column | None = None, taxonomy=None, triage_threshold: int = 3,
              max_survivors: int | None = None, comments: DataFrame | None = None,
              interest_threshold: int = 2, dedup_keys: Sequence[str] = ("item_key",),
              funnel_enabled: bool = True, purpose: str = "", staging: str = "table",
              model_partitions: int | None = None, out_path: str | None = None,
              quarantine_path: str | None = None, store: NoteStore | None = None, scope: str | None = None,
              memory: str | None = None, source_names: Sequence[str] | None = None) -> RunResult:
    """Q2. ``known`` has the stored notes' ``item_key`` or, of tables without it,
    ``source_url`` (and ``adapter``, ``title``, ``published_date``, without which
    no stored chart track is recognised); None skips the check (dry run, K3).
    ``model_partitions`` sets the number of concurrent model-call tasks. With
    ``out_path`` the notes are appended there, and ``written`` counts those
    that were; a note found there already is ``already_stored``.

    With ``store`` the stored items are looked up in its key index (``known`` is not
    needed; ``scope`` is the folder that counts, all by default) and the notes are
    appended to it as the batch of ``as_of``. ``memory`` is a folder of model
    replies that later runs use again."""
    # staged once, with the run's row numbers: every ledger branch below reads
    # this table instead of re-running the scans
    failures: list[tuple] = []

    def flag(items: DataFrame) -> DataFrame:
        items = items.withColumn("item_key", item_key(items))
        no = F.lit(False).alias("__stored")
        if store is not None:
            k = store.stored_among(items, scope)
        elif known is not None:
            k = known if "item_key" in known.columns else known.select(item_key(known).alias("item_key"))
            k = known_keys(k, "item_key")
        else:
            return items.select("*", no).withColumn("item_no", F.monotonically_increasing_id())
        # items without a key do not meet in the join
        blank = F.col("item_key") == ""
        asked = (items.where(~blank).join(k.withColumn("__stored", F.lit(True)), "item_key", "left")
                 .withColumn("__stored", F.coalesce("__stored", F.lit(False))))
        return asked.unionByName(items.where(blank).select("*", no)).withColumn("item_no", F.monotonically_increasing_id())

    names = list(source_names or [f"source {i}" for i in range(len(sources))])
    flagged = _staged_items(_opened(sources, names, failures), flag, staging, failures)

    def fate_of(rows: DataFrame, fate) -> DataFrame:
        return rows.select("item_no", "seq", "adapter", "source_url", (F.lit(fate) if isinstance(fate, str) else fate).alias("fate"))

    is_blank = F.coalesce(F.col("source_url"), F.lit("")) == ""
    dropped = fate_of(flagged.where(is_blank | F.col("__stored")),
                      F.when(is_blank, "blank_url").otherwise("already_stored"))
    items = drop_blank_url(flagged).where(~F.col("__stored")).drop("__stored")

    lib = lens_library(lens_files)
    # the texts that every prompt shares come from whole tables: worked out once, as one row
    block = exemplar_block if exemplar_block is not None else F.lit("")
    shared = stage(lens_files.sparkSession.range(1).select(summary_col(lib).alias("summary"), block.alias("block")), "table")
    summary = shared.select("summary").scalar()
    funnel = {"backends": gate_backends, "lens_summary": summary, "exemplar_block": shared.select("block").scalar(),
              "taxonomy": taxonomy, "threshold": triage_threshold, "max_survivors": max_survivors, "comments": comments,
              "partitions": model_partitions, "memory": f"{memory}/gate" if memory else None}
    try:
        gated = stage(run_funnel(items, enabled=funnel_enabled, **funnel), staging)
    except Exception as exc:  # fail open: all items pass, ungated
        failures.append(_failure("funnel", "funnel_error", "funnel", exc))
        gated = stage(run_funnel(items, enabled=False, **funnel), staging)
    rejected = fate_of(gated.where(F.col("bucket") == "rejected"), "rejected")
    kept = gated.where(F.col("bucket") != "rejected")
    # first row per key in run order (group-limited window: a hot key sends
    # one row per map task); the rest are found by an anti join on the row number
    unique = first_per_key(kept, list(dedup_keys), [*run_order(), F.col("item_no")], 1)
    dups = fate_of(kept.join(unique.select("item_no"), "item_no", "left_anti"), "dup_in_run")

    replied = stage(infer_distinct(unique, *enrich_prompt_columns(summary, purpose), enrich_backends, model_partitions,
                                   f"{memory}/enrich" if memory else None), staging)
    parsed = parse_enrichment(replied, lookup_col(lib), first_lens_col(lib), as_of)
    good, bad = split_quarantine(parsed)
    if failures:
        bad = bad.unionByName(parsed.sparkSession.createDataFrame(failures, QUARANTINE))
    passed = interest_filter(good, interest_threshold)
    fate = (F.when(F.col("error_kind").isNotNull(), F.lit("failed"))
            .when(F.col("interest_level") < interest_threshold, F.lit("below_threshold"))
            .otherwise(F.lit("written")))
    processed = fate_of(parsed, fate)
    notes = render_note(passed)
    if store is not None or out_path:
        notes = notes.select(*NOTE_COLUMNS)
        if store is not None:
            new = store.append(notes, f"daily:{as_of}", order=["item_no"])
            notes = notes.where("false") if new is None else new
        else:
            notes = write_notes(notes, out_path)
        added = notes.select("item_no", F.lit(True).alias("__added"))
        late = (F.col("fate") == "written") & F.col("__added").isNull()
        processed = (processed.join(added, "item_no", "left")
                     .withColumn("fate", F.when(late, "already_stored").otherwise(F.col("fate"))).drop("__added"))
    if quarantine_path:
        write_quarantine(bad, quarantine_path, as_of)

    ledger = dropped
    for p in (rejected, dups, processed):
        ledger = ledger.unionByName(p)
    return RunResult(notes=notes, quarantine=bad, ledger=ledger, summary=run_summary(ledger))


def fates_by_adapter(ledger: DataFrame) -> DataFrame:
    """A1 per adapter: (adapter, fate, n), so that a source losing all its items shows."""
    return ledger.groupBy("adapter", "fate").agg(F.count(F.lit(1)).alias("n"))


def dry_run_view(result: RunResult) -> DataFrame:
    """K3: what would be written: source, URL, observation, interest,
    lenses, tags; nothing is stored."""
    n = result.notes
    return n.select("source", "source_url", "observation", "interest_level",
                    F.array_join("lenses", ", ").alias("lenses"), F.array_join("tags", ", ").alias("tags"))
