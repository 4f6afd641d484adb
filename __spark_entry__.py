"""

Every query reads the provided tables through ``gleaner.standins`` (row
reshaping only) and runs the library's operators over the whole tables.
Each oracle is DuckDB SQL over the same tables computing the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import standins as S
from gleaner.functions import dates as D
from gleaner.functions import frontmatter as FM
from gleaner.functions import links as L
from gleaner.functions import text as T
from gleaner.operators.dedup import dedup_first, note_collisions, skip_known
from gleaner.operators.items import community_items
from gleaner.plans.digest import feed_digest
from gleaner.functions import replies as R
from gleaner.operators.gate import gate_prompts, survivor_budget, triage_gate
from gleaner.operators.infer import infer_batch
from gleaner.operators.items import listing_items, feed_items, union_sources
from gleaner.operators.lenses import first_lens_col, lens_library, lens_table, lookup_col, match_lenses_table, summary_col
from gleaner.operators.enrich import enrich_prompts, interest_filter, parse_enrichment, split_quarantine
from gleaner.functions.metadata import build_metadata, relevance_by_mode
from gleaner.operators.score import prerank, wire_prerank
from gleaner.operators.aliases import alias_hits
from gleaner.plans.funnel import run_funnel
from gleaner.plans.feedback import feedback_block
from gleaner.plans.backfill import backfill, backfill_merge
from gleaner.plans.daily import daily_run, dry_run_view, fates_by_adapter
from gleaner.operators.notes import render_note
from gleaner.streaming.ingest import dedup_stream, ingest_stream, read_stream_parquet, run_to_parquet
from gleaner.session import staging_path
from gleaner.operators.metrics import adapter_counts
from gleaner.sinks.store import NoteStore
from gleaner.operators.notes import INBOX_FOLDER, harvest_labels, inbox_view, note_table, queue_view, select_exemplars
from gleaner.operators.items import drop_blank_url
from gleaner.sources.charts import chart_items, html_items
from gleaner.sources.files import parse_feed_files
from gleaner.sources.registry import attach_source, classify_fetch, enabled_sources
from gleaner.session import stage

SF_SMOKE = "/root/testdata/sf0.001"


def _spark_session_ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# ---------------------------------------------------------------- queries


def q_feed_digest(spark: SparkSession, d: str) -> DataFrame:
    _spark_session_ready(spark)
    return feed_digest(S.feed_entries(spark, d), S.known_page_urls(spark, d),
                       as_of=S.AS_OF, taxonomy=S.TAXONOMY, top_n=5)


def _docs(spark, d):
    return S.table(spark, d, "documents")


def q_strip_html(spark, d):
    p = S.table(spark, d, "pages")
    return p.select("page_id", T.strip_html("html").alias("text"), T.strip_html("html", 500).alias("body"))


def q_pick_body(spark, d):
    e = S.feed_entries(spark, d)
    return e.select(F.col("pos").alias("page_id"),
                    T.strip_html(T.pick_body("summary", "content"), 500).alias("rss_body"),
                    T.strip_html(T.pick_body(F.lit(""), "summary", default=F.col("feed")), 500).alias("alt_body"))


def q_item_date(spark, d):
    e = S.dated_entries(spark, d)
    return e.select("event_id", D.item_date("published", "updated", S.AS_OF).cast("string").alias("item_date"))


def q_item_tags(spark, d):
    e = S.feed_entries(spark, d)
    return e.select(F.col("pos").alias("page_id"),
                    F.array_join(L.feed_tags("categories"), "|").alias("rss_tags"),
                    F.array_join(L.community_tags("feed", "categories"), "|").alias("community_tags"),
                    L.first_flair("feed", "categories").alias("flair"))


def q_link_meta(spark, d):
    e = S.community_entries(spark, d)
    m = L.link_meta("content")
    return e.select(F.col("link").alias("source_url"), m["is_self"].alias("is_self"), m["domain"].alias("domain"))


def q_slugify(spark, d):
    r = S.note_rows(spark, d)
    return r.select("doc_id", T.slugify(F.concat_ws(" ", "source", "lang", F.lit("News!"))).alias("slug"),
                    T.slugify(F.regexp_extract("text", r"^(\S*)", 1)).alias("word_slug"))


def q_note_id(spark, d):
    r = S.note_rows(spark, d)
    return r.select("doc_id", T.note_id("date", "source", "source_url").alias("note_id"))


def q_yaml_quote(spark, d):
    return _docs(spark, d).select("doc_id", T.yaml_quote("text").alias("quoted"))


def q_sentences(spark, d):
    s = T.sentences("text")
    return _docs(spark, d).select(
        "doc_id", F.size(s).cast("bigint").alias("n_sentences"), F.get(s, 0).alias("first"),
        F.try_element_at(s, F.lit(-1)).alias("last"), F.md5(F.array_join(s, "\n")).alias("digest"))


def q_clean_list(spark, d):
    c = T.clean_list(F.split("text", ","))
    return _docs(spark, d).select("doc_id", F.size(c).cast("bigint").alias("n_items"),
                                  F.md5(F.array_join(c, "|")).alias("digest"))


def q_time_sensitivity(spark, d):
    r = S.note_rows(spark, d)
    return r.select("doc_id", D.time_sensitivity("date", S.AS_OF).alias("time_sensitivity"),
                    D.time_sensitivity(F.concat(F.lit("x"), "date"), S.AS_OF).alias("bad_date"))


def q_frontmatter(spark, d):
    n = S.note_files(spark, d)
    m = FM.frontmatter_map("value")
    return n.select("path", FM.fm_get(m, "title").alias("title"), FM.fm_get(m, "status").alias("status"),
                    FM.fm_get(m, "source_url").alias("source_url"), FM.fm_get(m, "date").alias("date"),
                    F.array_join(FM.inline_list(FM.fm_get(m, "tags")), "|").alias("tags"),
                    F.size(F.map_keys(m)).cast("bigint").alias("n_keys"))


def q_observation_text(spark, d):
    n = S.note_files(spark, d)
    o = T.observation_text(FM.note_body("value"))
    return n.select("path", F.md5(o).alias("digest"), F.length(o).cast("bigint").alias("n_chars"))


def q_first_sentence(spark, d):
    return _docs(spark, d).select("doc_id", T.first_sentence("text").alias("first_sentence"))


def q_url_segment(spark, d):
    r = S.note_rows(spark, d)
    return r.select("doc_id", T.url_segment("source_url").alias("community"))


def q_dedup_first(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    return dedup_first(docs, ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


def q_skip_known(spark, d):
    r = S.note_rows(spark, d)
    known = r.where(F.col("status") != "inbox").select("source_url")
    return skip_known(r.select("doc_id", "source_url"), known)


def q_skip_known_index(spark, d):
    """J1 through the store's key buckets: the labelled notes are stored, all notes are asked."""
    r = S.note_rows(spark, d)
    stored = r.where(F.col("status") != "inbox").select("source_url", "folder", F.substring("date", 1, 4).alias("year"))
    store = NoteStore(spark, staging_path(spark, "note-store"), key="source_url", partition_by="year")
    store.append(stored, "labelled")
    return store.skip_known(r.select("doc_id", "source_url"))


def q_skip_known_scope(spark, d):
    """J1 with the inbox as its scope (T4): notes moved to the archive are not known."""
    r = S.note_rows(spark, d)
    known = r.where(F.col("status") != "inbox").select("source_url", "folder")
    return skip_known(r.select("doc_id", "source_url"), known, scope=INBOX_FOLDER)


def q_top_n_per_source(spark, d):
    items = community_items(S.community_entries(spark, d), S.AS_OF, top_n=5)
    return items.select("source", "source_url", "title", "body", F.col("published_date").cast("string").alias("published_date"),
                        F.array_join("raw_tags", "|").alias("raw_tags"), F.col("wire.feed_rank").alias("feed_rank"),
                        F.col("wire.is_self").alias("is_self"), F.col("wire.domain").alias("domain"),
                        F.col("wire.permalink").alias("permalink"))


def q_note_collisions(spark, d):
    r = S.note_rows(spark, d).select(F.substring(F.md5("source_url"), 1, 4).alias("url_hash"), "source_url")
    return note_collisions(r, "url_hash", "source_url").withColumn("n_urls", F.col("n_urls").cast("bigint"))



def _listing(spark, d):
    return listing_items(S.listing_children(spark, d), S.AS_OF)


def _lib(spark, d):
    return lens_library(S.lens_files(spark, d))


def _replied(spark, d):
    """Listing items with gate prompts and model replies (staged once)."""
    items = wire_prerank(_listing(spark, d), S.LISTING_TAXONOMY)
    p = gate_prompts(items, summary_col(_lib(spark, d)), F.lit(""))
    return stage(infer_batch(p, S.gate_backends()))


def q_wire_score(spark, d):
    return wire_prerank(_listing(spark, d), S.LISTING_TAXONOMY).select("source_url", "wire_pre_score")


def q_wire_prerank(spark, d):
    r = prerank(_listing(spark, d), S.LISTING_TAXONOMY)
    return r.select("source_url", F.col("wire.subreddit").alias("subreddit"), "wire_pre_score", F.col("prerank").cast("int").alias("prerank"))


def q_infer_batch(spark, d):
    return _replied(spark, d).select("source_url", "backend", "error")


def q_parse_reply(spark, d):
    v = R.parse_reply(F.col("reply"))
    return _replied(spark, d).select("source_url", F.coalesce(R.kind(v), F.lit("UNPARSABLE")).alias("reply_kind"))


def q_clamp_int(spark, d):
    v = R.parse_reply(F.col("reply"))
    return _replied(spark, d).select("source_url", R.clamp_int(v, "reaction_worthiness", 0, 5, 0).alias("rw"))


def q_triage_gate(spark, d):
    g = triage_gate(_replied(spark, d), threshold=3, maybe_band=1)
    return g.select("source_url", "triage_score", "bucket", F.col("triage.best_lens").alias("best_lens"),
                    F.col("triage.why").alias("why"), F.col("triage.error").isNotNull().alias("failed"))


def q_survivor_budget(spark, d):
    g = survivor_budget(triage_gate(_replied(spark, d), 3, 1), 5)
    return g.select("source_url", "bucket", "overflow")


def q_deep_dive(spark, d):
    from gleaner.operators.gate import deep_dive
    g = deep_dive(triage_gate(_replied(spark, d), 3, 1), S.comments(spark, d), 12)
    return g.select("source_url", "deep_dived", F.md5("body").alias("body_digest"),
                    F.length("body").cast("bigint").alias("body_chars"))


def _funnel(spark, d):
    items = union_sources(feed_items(S.feed_entries(spark, d), S.AS_OF), _listing(spark, d))
    return run_funnel(items, backends=S.gate_backends(), lens_summary=summary_col(_lib(spark, d)),
                      exemplar_block=F.lit(""), taxonomy=S.LISTING_TAXONOMY, threshold=3,
                      comments=S.comments(spark, d))


def q_funnel(spark, d):
    return _funnel(spark, d).select("source_url", "bucket", "triage_score", "wire_pre_score", "deep_dived")


def q_funnel_stats(spark, d):
    from gleaner.operators.metrics import funnel_stats
    return funnel_stats(_funnel(spark, d))


def q_gate_prompt(spark, d):
    items = _listing(spark, d)
    p = gate_prompts(items, summary_col(_lib(spark, d)), F.lit(""))
    return p.select("source_url", F.md5("system").alias("system_digest"), F.md5("user").alias("user_digest"),
                    F.length("user").cast("bigint").alias("user_chars"))



def q_lens_summary(spark, d):
    lib = _lib(spark, d)
    rows = lib.select(F.explode("lenses").alias("l")).select("l.*")
    return rows.select(F.col("ord").cast("bigint").alias("ord"), "name", "first_sentence",
                       summary_col(lib).alias("lens_summary"))


def _enriched(spark, d):
    """Feed items -> enrichment prompts -> model (staged) -> parsed rows."""
    items = feed_items(S.feed_entries(spark, d), S.AS_OF).withColumn("bucket", F.lit("ungated"))
    lib = _lib(spark, d)
    p = enrich_prompts(items, summary_col(lib), purpose="Notice what changes in music culture.")
    replied = stage(infer_batch(p, S.enrich_backends()))
    return parse_enrichment(replied, lookup_col(lib), first_lens_col(lib), S.AS_OF)


def _j(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("<none>"))), "|")


def q_lens_names(spark, d):
    v = R.parse_reply(F.col("reply"))
    return _enriched(spark, d).select("source_url", _j(R.lens_names(v)).alias("names"))


def q_match_lenses(spark, d):
    return _enriched(spark, d).where(F.col("error_kind").isNull()).select("source_url", _j(F.col("lenses")).alias("lenses"))


def q_match_lenses_join(spark, d):
    """J2 / P15 with the library as a table."""
    e = _enriched(spark, d).where(F.col("error_kind").isNull()).drop("lenses")
    e = e.withColumn("names", R.lens_names(R.parse_reply(F.col("reply"))))
    m = match_lenses_table(e.select("source_url", "names"), ["source_url"], "names", lens_table(S.lens_files(spark, d)))
    return m.select("source_url", _j(F.col("lenses")).alias("lenses"))


def q_alias_join(spark, d):
    """J3 with the aliases as a table: the words of the documents against the notes' title lines."""
    titles = S.note_rows(spark, d).select("doc_id", "title")
    hits = alias_hits(titles, S.alias_table(spark, d), "doc_id", "title")
    return hits.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n_hits"), F.md5(F.array_join(F.array_sort(F.collect_list("alias")), "|")).alias("digest"))


def q_item_sources(spark, d):
    """Feed items with their (enabled) source definition."""
    items = feed_items(S.feed_entries(spark, d), S.AS_OF)
    reg = S.registry(spark, d).withColumnRenamed("url", "source_url").withColumn("url", F.col("source_url"))
    return attach_source(items.select("source_url", "source"), reg.select("adapter", "name", "slug", "url", "enabled", "source_url"),
                         "source_url").select("source_url", "source", "name", "slug")


def q_scope_questions(spark, d):
    q = F.col("questions")
    return _enriched(spark, d).where(F.col("error_kind").isNull()).select(
        "source_url", F.array_join(F.map_keys(q), "|").alias("question_lenses"),
        F.aggregate(F.map_values(q), F.lit(0), lambda a, x: a + F.size(x)).cast("bigint").alias("n_questions"))


def q_enrich(spark, d):
    e = _enriched(spark, d)
    return e.select("source_url", "error_kind", "interest_level", "observation", _j(F.col("tags")).alias("tags"),
                    _j(F.col("lenses")).alias("lenses"), F.array_join(F.map_keys("questions"), "|").alias("question_lenses"),
                    F.col("meta.time_sensitivity").alias("time_sensitivity"),
                    F.array_join("meta.relevance", "|").alias("relevance"),
                    F.size("meta.claims").cast("bigint").alias("n_claims"),
                    F.array_join("meta.topics", "|").alias("topics"), "backend")


def q_quarantine(spark, d):
    good, bad = split_quarantine(_enriched(spark, d))
    return bad.select("source_url", "stage", "error_kind")


def q_interest_threshold(spark, d):
    good, bad = split_quarantine(_enriched(spark, d))
    return interest_filter(good, 2).select("source_url", "interest_level")


def q_fail_open(spark, d):
    g = triage_gate(_replied(spark, d), 3, 1).where(F.col("triage.error").isNotNull()).select(
        "source_url", F.lit("gate").alias("stage"), F.col("bucket").alias("routed_to"))
    e = _enriched(spark, d).where(F.col("error").isNotNull()).select(
        "source_url", F.lit("enrich").alias("stage"), F.lit("quarantine").alias("routed_to"))
    return g.unionByName(e)


def q_derive_relevance(spark, d):
    topics = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    r = _docs(spark, d).select("doc_id", relevance_by_mode(topics).alias("r"))
    return r.select("doc_id", F.array_join("r.substring", "|").alias("relevance"), F.array_join("r.token", "|").alias("relevance_token"))


def q_build_metadata(spark, d):
    r = S.note_rows(spark, d)
    m = build_metadata(as_of=S.AS_OF, title="title", source="source", source_url="source_url",
                       published_date="date", raw_tags=F.array("lang", "source"),
                       p_observation=F.lit(None).cast("string"), p_expanded_context="text")
    r = r.select("doc_id", m.alias("m"))
    return r.select("doc_id", F.col("m.title").alias("title"), F.col("m.publication").alias("publication"),
                    F.col("m.publication_date").alias("publication_date"), F.col("m.summary").alias("summary"),
                    F.size("m.claims").cast("bigint").alias("n_claims"), F.md5(F.array_join("m.claims", "\n")).alias("claims_digest"),
                    F.array_join("m.topics", "|").alias("topics"), F.array_join("m.relevance", "|").alias("relevance"),
                    F.col("m.time_sensitivity").alias("time_sensitivity"))



_CHART_HTML = {"row_pattern": S.CHART_ROW, "artist": S.CHART_ARTIST, "title": S.CHART_TITLE}


def _charts(spark, d):
    return chart_items(S.chart_pages(spark, d), S.AS_OF, 10, html_kw=_CHART_HTML)


def q_html_items(spark, d):
    h = html_items(S.chart_pages(spark, d), S.AS_OF, 10, **_CHART_HTML)
    return h.select("source_url", "title", F.col("chart_pos").cast("int").alias("chart_pos"), "body",
                    F.array_join("raw_tags", "|").alias("raw_tags"))


def q_html_items_default(spark, d):
    """S4 by classes: the default selectors over rows in any quoting, with nested elements of the same name."""
    h = html_items(S.marked_chart_pages(spark, d), S.AS_OF, 10)
    return h.select("source_url", "title", F.col("chart_pos").cast("int").alias("chart_pos"))


def q_json_items(spark, d):
    c = _charts(spark, d).where(F.col("via") == "json")
    return c.select("source_url", "title", F.col("chart_pos").cast("int").alias("chart_pos"))


def q_feed_files(spark, d):
    """Landed feed files entry by entry, broken entries to quarantine."""
    entries, bad = parse_feed_files(S.feed_files(spark, d))
    good = entries.select("feed", "pos", "link", "title", F.lit(None).cast("string").alias("error_kind"))
    return good.unionByName(bad.select(F.regexp_extract("path", r"([^/]*)\.xml$", 1).alias("feed"), "pos",
                                       F.lit(None).cast("string").alias("link"), F.lit(None).cast("string").alias("title"), "error_kind"))


def q_enabled_sources(spark, d):
    return enabled_sources(S.registry(spark, d)).select("name", "slug", "url")


def q_drop_blank_url(spark, d):
    return drop_blank_url(S.registry(spark, d), "url").select("name", "slug", "url")


def q_classify_fetch(spark, d):
    return classify_fetch(S.responses(spark, d)).select("url", "attempt", "status", "outcome")


def _all_items(spark, d):
    return union_sources(feed_items(S.feed_entries(spark, d), S.AS_OF), _listing(spark, d), _charts(spark, d))


def q_union_sources(spark, d):
    return _all_items(spark, d).select("seq", "adapter", "source", "source_url", "title")


def q_adapter_counts(spark, d):
    return adapter_counts(_all_items(spark, d))


def q_harvest_labels(spark, d):
    return harvest_labels(S.note_files(spark, d)).select("path", "title", "subreddit", "source_url", "status", "positive")


def q_select_exemplars(spark, d):
    ex = select_exemplars(harvest_labels(S.note_files(spark, d)), 4, 4)
    return ex.select("path", "positive", F.col("grp").cast("int").alias("grp"), "date")


def q_feedback_block(spark, d):
    fb = feedback_block(S.note_files(spark, d))
    return fb.totals.select("positives", "negatives", fb.block.alias("block"))


def q_inbox_view(spark, d):
    v = inbox_view(note_table(S.note_files(spark, d)))
    return v.select("date", "source", "observation", "interest_level", F.array_join("lenses", "|").alias("lenses"), "status")


def q_queue_view(spark, d):
    v = queue_view(note_table(S.note_files(spark, d)))
    return v.select("date", "source", "observation", F.array_join("lenses", "|").alias("lenses"), "notes")


def q_backfill(spark, d):
    rows, counts = backfill(S.note_files(spark, d), S.AS_OF)
    m = F.col("meta")
    return rows.select("path", "changed", m["note_id"].alias("note_id"), m["title"].alias("title"),
                       m["summary"].alias("summary"), F.array_join(m["topics"], "|").alias("topics"),
                       F.array_join(m["relevance"], "|").alias("relevance"),
                       F.size(m["claims"]).cast("bigint").alias("n_claims"), m["time_sensitivity"].alias("time_sensitivity"))



def q_backfill_merge(spark, d):
    """K4 into the store: the note table after the merge."""
    month = F.substring(FM.fm_get(FM.frontmatter_map("value"), "date"), 1, 7)
    store = NoteStore(spark, staging_path(spark, "note-store"), key="path", partition_by="month")
    store.append(S.note_files(spark, d).withColumn("month", month), "load")
    backfill_merge(store, S.AS_OF)
    return store.rows().select("path", "month", F.md5("value").alias("digest"), F.length("value").cast("bigint").alias("n_chars"))


def q_render_note(spark, d):
    good, bad = split_quarantine(_enriched(spark, d))
    r = render_note(good)
    return r.select("source_url", "note_id", F.md5("markdown").alias("digest"),
                    F.length("markdown").cast("bigint").alias("n_chars"))


def _known(spark, d):
    notes = note_table(S.note_files(spark, d)).select("source_url")
    return notes.unionByName(S.known_page_urls(spark, d))


def _daily(spark, d, known=True):
    fb = feedback_block(S.note_files(spark, d))
    return daily_run(
        [feed_items(S.feed_entries(spark, d), S.AS_OF), _listing(spark, d), _charts(spark, d)],
        known=_known(spark, d) if known else None, lens_files=S.lens_files(spark, d),
        gate_backends=S.gate_backends(), enrich_backends=S.enrich_backends(), as_of=S.AS_OF,
        exemplar_block=fb.block, taxonomy=S.LISTING_TAXONOMY, triage_threshold=3,
        comments=S.comments(spark, d), interest_threshold=2, purpose="Notice what changes in music culture.")


def q_daily_run(spark, d):
    r = _daily(spark, d)
    return r.notes.select("source_url", "note_id", "interest_level", "bucket")


def q_run_summary(spark, d):
    return _daily(spark, d).summary


def q_fates_by_adapter(spark, d):
    return fates_by_adapter(_daily(spark, d).ledger)


def q_dry_run(spark, d):
    return dry_run_view(_daily(spark, d, known=False))



def q_stream_ingest(spark, d):
    """R1 over the pages table landed as a file stream (available-now)."""
    pages = S.table(spark, d, "pages")
    stream = read_stream_parquet(spark, f"{d.rstrip('/')}/pages*.parquet", pages.schema)
    sink = staging_path(spark, "ingest-sink")
    q = ingest_stream(stream, sink, as_of=S.AS_OF, to_entries=S.pages_as_entries)
    q.awaitTermination()
    return NoteStore(spark, sink, key="source_url", partition_by="published_date").rows().select("source", "source_url", "title")


def q_stream_dedup(spark, d):
    """R2 over the events table landed as a file stream: keys kept once."""
    ev = S.table(spark, d, "events")
    stream = read_stream_parquet(spark, f"{d.rstrip('/')}/events*.parquet", ev.schema)
    sink = staging_path(spark, "dedup-sink")
    run_to_parquet(dedup_stream(stream, ["user_id", "event_type"], "ts", "1 hour"), sink)
    return spark.read.parquet(sink).select("user_id", "event_type")



def q_exemplar_block(spark, d):
    """The few-shot block built from the selected exemplars."""
    from gleaner.operators.notes import exemplar_block
    ex = select_exemplars(harvest_labels(S.note_files(spark, d)), 4, 4)
    return ex.agg(F.count(F.lit(1)).cast("bigint").alias("n_lines")).select("n_lines", exemplar_block(ex).alias("block"))



_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "exemplar_block": q_exemplar_block,
    "stream_ingest": q_stream_ingest,
    "stream_dedup": q_stream_dedup,
    "render_note": q_render_note,
    "daily_run": q_daily_run,
    "run_summary": q_run_summary,
    "fates_by_adapter": q_fates_by_adapter,
    "dry_run": q_dry_run,
    "html_items": q_html_items,
    "html_items_default": q_html_items_default,
    "match_lenses_join": q_match_lenses_join,
    "alias_join": q_alias_join,
    "item_sources": q_item_sources,
    "json_items": q_json_items,
    "enabled_sources": q_enabled_sources,
    "feed_files": q_feed_files,
    "drop_blank_url": q_drop_blank_url,
    "classify_fetch": q_classify_fetch,
    "union_sources": q_union_sources,
    "adapter_counts": q_adapter_counts,
    "harvest_labels": q_harvest_labels,
    "select_exemplars": q_select_exemplars,
    "feedback_block": q_feedback_block,
    "inbox_view": q_inbox_view,
    "queue_view": q_queue_view,
    "backfill": q_backfill,
    "lens_summary": q_lens_summary,
    "lens_names": q_lens_names,
    "match_lenses": q_match_lenses,
    "scope_questions": q_scope_questions,
    "enrich": q_enrich,
    "quarantine": q_quarantine,
    "interest_threshold": q_interest_threshold,
    "fail_open": q_fail_open,
    "derive_relevance": q_derive_relevance,
    "build_metadata": q_build_metadata,
    "wire_score": q_wire_score,
    "wire_prerank": q_wire_prerank,
    "infer_batch": q_infer_batch,
    "parse_reply": q_parse_reply,
    "clamp_int": q_clamp_int,
    "triage_gate": q_triage_gate,
    "survivor_budget": q_survivor_budget,
    "deep_dive": q_deep_dive,
    "funnel": q_funnel,
    "funnel_stats": q_funnel_stats,
    "gate_prompt": q_gate_prompt,
    "feed_digest": q_feed_digest,
    "strip_html": q_strip_html,
    "pick_body": q_pick_body,
    "item_date": q_item_date,
    "item_tags": q_item_tags,
    "link_meta": q_link_meta,
    "slugify": q_slugify,
    "note_id": q_note_id,
    "yaml_quote": q_yaml_quote,
    "sentences": q_sentences,
    "clean_list": q_clean_list,
    "time_sensitivity": q_time_sensitivity,
    "frontmatter": q_frontmatter,
    "observation_text": q_observation_text,
    "first_sentence": q_first_sentence,
    "url_segment": q_url_segment,
    "dedup_first": q_dedup_first,
    "skip_known": q_skip_known,
    "skip_known_index": q_skip_known_index,
    "skip_known_scope": q_skip_known_scope,
    "backfill_merge": q_backfill_merge,
    "top_n_per_source": q_top_n_per_source,
    "note_collisions": q_note_collisions,
}


def entry(spark: SparkSession) -> DataFrame:
    return _utc(q_feed_digest)(spark, SF_SMOKE)


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Dates are UTC calendar dates (epoch seconds, feed offsets): pin the
    session time zone whatever the caller's session uses."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


try:  # the corpus operators are optional: the library works without that subpackage
    from gleaner.llm import registry as _corpus
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("gleaner.llm", "corpus_pipeline")):
        raise
    _corpus = None


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of the library itself; each has an oracle."""
    return {k: _utc(v) for k, v in _QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return library_queries() | ({k: _utc(v) for k, v in _corpus.queries().items()} if _corpus else {})


# ---------------------------------------------------------------- oracles
# Shared SQL pieces (DuckDB). They mirror gleaner.standins row for row.

HOST_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"

FEED_ENTRIES = r"""
fe AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS feed, 0 AS feed_ord,
         CAST(page_id AS INTEGER) AS pos, url AS link,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS summary,
         html AS content, CAST(NULL AS VARCHAR) AS published, CAST(NULL AS VARCHAR) AS updated,
         regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS categories
  FROM pages)"""

STRIP = r"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"

FEED_ITEMS = FEED_ENTRIES + r""",
fi AS (
  SELECT (CAST(feed_ord AS BIGINT) << 32) + pos AS seq, 'rss' AS adapter, feed AS source,
         link AS source_url, coalesce(title, '(no title)') AS title,
         substring(""" + STRIP.format(x="coalesce(nullif(summary, ''), nullif(content, ''), '')") + r""", 1, 500) AS body,
         DATE '2024-03-01' AS published_date,
         list_filter(categories, lambda t: coalesce(t, '') <> '') AS raw_tags
  FROM fe WHERE coalesce(link, '') <> ''
  QUALIFY row_number() OVER (PARTITION BY feed, link ORDER BY pos) = 1)"""

TAXONOMY_SQL = "['the', 'and', 'des', 'der', 'que']"

RSS_SCORE = ("round(0.0 + 0.0 + (0.0 - 0.5) * 2.0 + least(len(list_filter(" + TAXONOMY_SQL
             + ", lambda k: instr(lower(coalesce(title, '')), k) > 0)), 3) * 1.5 + log10(1.0), 4)")

_SQL: dict[str, str] = {}

_SQL["feed_digest"] = "WITH " + FEED_ITEMS + r""",
k AS (
  SELECT *, lower(regexp_extract(source_url, '""" + HOST_RE + r"""', 1))
            || regexp_extract(source_url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*((?:/[^/?#]*){0,1})', 1) AS dedup_key
  FROM fi),
d AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq) = 1),
known AS (SELECT p.url AS source_url FROM pages p WHERE p.page_id IN (SELECT doc_id FROM labels)),
a AS (SELECT * FROM d WHERE source_url NOT IN (SELECT source_url FROM known WHERE source_url IS NOT NULL)),
s AS (SELECT *, """ + RSS_SCORE + r""" AS wire_pre_score FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY wire_pre_score DESC, seq) AS rank FROM s)
SELECT source, source_url, dedup_key, title, published_date, wire_pre_score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 5"""


def TRIMWS(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def STRIPH(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def UNQ(x: str) -> str:
    return f"regexp_replace(regexp_replace({TRIMWS(x)}, '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')"


def SLUG(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"(CASE WHEN {s} = '' THEN 'src' ELSE {s} END)"


def TSENS(x: str, as_of: str = "DATE '2024-03-01'") -> str:
    dd = (f"(CASE WHEN regexp_matches(substr(coalesce({x}, ''), 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') "
          f"THEN try_cast(substr({x}, 1, 10) AS DATE) END)")
    return (f"(CASE WHEN {dd} IS NULL THEN 'unknown' WHEN date_diff('day', {dd}, {as_of}) <= 30 THEN 'high' "
            f"WHEN date_diff('day', {dd}, {as_of}) <= 365 THEN 'medium' ELSE 'low' END)")


def LINKMETA(html: str) -> tuple[str, str]:
    cand = (f"list_filter(list_transform(regexp_extract_all(coalesce({html}, ''), 'href=\"([^\"]+)\"', 1), "
            f"lambda h: {{'h': h, 'host': lower(regexp_extract(h, '{HOST_RE}', 1))}}), "
            f"lambda x: instr(x.h, '/comments/') = 0 AND x.host <> '')[1]")
    is_self = f"(CASE WHEN {cand} IS NULL THEN NULL ELSE instr(({cand}).host, 'reddit.com') > 0 END)"
    domain = f"(CASE WHEN {cand} IS NULL OR instr(({cand}).host, 'reddit.com') > 0 THEN '' ELSE ({cand}).host END)"
    return is_self, domain


NL = "chr(10)"

NOTE_ROWS = r"""
nr AS (
  SELECT d.doc_id, d.source, d.lang, d.text,
    CASE WHEN l.quality IS NULL THEN 'inbox' WHEN l.toxic = 1 THEN 'queued'
         WHEN l.quality = 1 THEN 'reacted' ELSE 'archived' END AS status,
    CASE WHEN d.lang = 'en' THEN 'https://www.reddit.com/r/' || d.source || '/comments/' || CAST(d.doc_id AS VARCHAR) || '/'
         ELSE 'https://' || d.source || '.example.org/a/' || CAST(d.doc_id AS VARCHAR) END AS source_url,
    regexp_extract(d.text, '^([^\n]*)', 1) AS title,
    CAST(DATE '2023-01-01' + CAST(d.doc_id % 500 AS INTEGER) AS VARCHAR) AS date
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
nr2 AS (SELECT *, CASE WHEN status = 'archived' THEN 'Archived' ELSE 'Observation Inbox' END AS folder FROM nr)"""

NOTE_FILES = NOTE_ROWS + """,
nf AS (
  SELECT '/vault/' || folder || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
    '---' || chr(10) || 'title: ' || title || chr(10) || 'date: ' || date || chr(10)
    || 'source: ' || source || chr(10) || 'source_url: ' || source_url || chr(10)
    || 'tags: [' || lang || ', ' || source || ']' || chr(10)
    || 'observation: "' || title || '"' || chr(10)
    || 'interest_level: ' || CAST(doc_id % 5 + 1 AS VARCHAR) || chr(10)
    || 'lenses: [NATION_' || CAST(doc_id % 25 AS VARCHAR) || ']' || chr(10)
    || 'status: ' || status || chr(10) || 'notes: ""' || chr(10)
    || '---' || chr(10) || chr(10) || '## Observation' || chr(10) || chr(10) || text
    || chr(10) || chr(10) || '**Source:** [' || source || '](' || source_url || ')' || chr(10) || chr(10)
    || '## Questions' || chr(10) AS value
  FROM nr2)"""

FM_TEXT = ("(CASE WHEN starts_with(value, '---') AND strpos(substr(value, 4), '---') > 0 "
           "THEN substr(value, 4, strpos(substr(value, 4), '---') - 1) END)")
NOTE_BODY = ("(CASE WHEN starts_with(value, '---') AND strpos(substr(value, 4), '---') > 0 "
             "THEN substr(value, strpos(substr(value, 4), '---') + 6) ELSE value END)")


def FM_ENTRIES(fm: str) -> str:
    return (f"list_transform(list_filter(string_split_regex(coalesce({fm}, ''), '\\r\\n|[\\n\\r]'), "
            f"lambda l: instr(l, ':') > 0), lambda l: {{'k': {TRIMWS('split_part(l, chr(58), 1)')}, "
            f"'v': {UNQ('substr(l, instr(l, chr(58)) + 1)')}}})")


def FM_GET(entries: str, key: str) -> str:
    return f"list_filter({entries}, lambda fe_: fe_.k = '{key}')[-1].v"


def OBS_TEXT(body: str) -> str:
    a = (f"(CASE WHEN strpos({body}, '## Observation') > 0 "
         f"THEN substr({body}, strpos({body}, '## Observation') + 14) ELSE {body} END)")
    b = f"(CASE WHEN strpos({a}, '**Source:**') > 0 THEN substr({a}, 1, strpos({a}, '**Source:**') - 1) ELSE {a} END)"
    c = f"(CASE WHEN strpos({b}, '## Questions') > 0 THEN substr({b}, 1, strpos({b}, '## Questions') - 1) ELSE {b} END)"
    return TRIMWS(c)


LISTING = r"""
ev AS (
  SELECT user_id,
    count(*) FILTER (WHERE event_type = 'view') AS views,
    count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
    count(*) FILTER (WHERE event_type = 'error') AS errors,
    count(*) FILTER (WHERE event_type = 'signup') AS signups,
    min(event_id) AS first_event, min(ts) AS first_ts,
    arg_min(event_type, (ts, event_id)) AS first_type,
    arg_max(event_type, (ts, event_id)) AS last_type
  FROM events GROUP BY user_id),
lc AS (
  SELECT 'sub' || CAST(user_id % 7 AS VARCHAR) AS community,
    '/r/sub' || CAST(user_id % 7 AS VARCHAR) || '/comments/' || CAST(user_id AS VARCHAR) || '/' AS permalink,
    concat_ws(' ', first_type, 'then', last_type, 'by user', CAST(user_id AS VARCHAR)) AS title,
    CASE WHEN signups > errors THEN 'Signed up ' || CAST(signups AS VARCHAR) || ' times.' ELSE '' END AS selftext,
    views AS score, clicks AS num_comments,
    CASE WHEN purchases + errors = 0 THEN NULL
         ELSE CAST(purchases AS DOUBLE) / CAST(purchases + errors AS DOUBLE) END AS upvote_ratio,
    CAST(floor(epoch(first_ts)) AS DOUBLE) AS created_utc,
    first_type AS link_flair_text,
    (user_id % 11) = 0 AS stickied,
    signups > errors AS is_self,
    errors > purchases AS is_video,
    CASE WHEN signups > errors THEN 'self.sub' || CAST(user_id % 7 AS VARCHAR)
         WHEN user_id % 3 = 0 THEN 'v.redd.it'
         WHEN user_id % 3 = 1 THEN 'news' || CAST(user_id % 5 AS VARCHAR) || '.example.com'
         ELSE '' END AS domain,
    first_event AS rank
  FROM ev)"""

COMMUNITY_ENTRIES = LISTING + r""",
ce AS (
  SELECT community AS feed, CAST(substr(community, 4, 3) AS INTEGER) AS feed_ord, CAST(rank AS INTEGER) AS pos,
    'https://www.reddit.com' || permalink AS link, title, '' AS summary,
    '<div><a href="https://www.reddit.com' || permalink || '">[comments]</a>'
      || coalesce(' <a href="' || (CASE WHEN domain LIKE 'self.%' THEN 'https://old.reddit.com/r/' || community || '/'
                                        WHEN domain <> '' THEN 'https://' || domain || '/story/' || CAST(rank AS VARCHAR) END)
                  || '">[link]</a>', '')
      || '<p>' || selftext || '</p></div>' AS content,
    strftime(make_timestamp(CAST(created_utc * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S+00:00') AS published,
    CAST(NULL AS VARCHAR) AS updated,
    [community, link_flair_text] AS categories
  FROM lc)"""

_SQL["strip_html"] = f"SELECT page_id, {STRIPH('html')} AS text, substring({STRIPH('html')}, 1, 500) AS body FROM pages"

_SQL["pick_body"] = "WITH " + FEED_ENTRIES + f"""
SELECT pos AS page_id,
  substring({STRIPH("coalesce(nullif(summary, ''), nullif(content, ''))")}, 1, 500) AS rss_body,
  substring({STRIPH("coalesce(nullif(summary, ''), feed)")}, 1, 500) AS alt_body
FROM fe"""

_SQL["item_date"] = r"""
WITH de AS (
  SELECT event_id,
    CASE WHEN event_type = 'purchase' THEN strftime(ts, '%a, %d %b %Y %H:%M:%S +0000') END AS published,
    CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS updated
  FROM events)
SELECT event_id, CAST(coalesce(
    CAST(timezone('UTC', try_strptime(published, '%a, %d %b %Y %H:%M:%S %z')) AS DATE),
    CAST(try_strptime(updated, '%Y-%m-%dT%H:%M:%SZ') AS DATE),
    DATE '2024-03-01') AS VARCHAR) AS item_date
FROM de"""

_FLAIR = "coalesce(list_filter(categories, lambda t: coalesce(t, '') <> '' AND lower(t) <> lower(coalesce(feed, '')))[1], '')"
_SQL["item_tags"] = "WITH " + FEED_ENTRIES + f""",
t AS (SELECT pos, feed, categories, {_FLAIR} AS flair FROM fe)
SELECT pos AS page_id,
  array_to_string(list_filter(categories, lambda t: coalesce(t, '') <> ''), '|') AS rss_tags,
  array_to_string(list_concat([feed], CASE WHEN flair <> '' THEN [replace(lower(flair), ' ', '-')] ELSE []::VARCHAR[] END), '|') AS community_tags,
  flair
FROM t"""

_LM = LINKMETA("content")
_SQL["link_meta"] = "WITH " + COMMUNITY_ENTRIES + f"""
SELECT link AS source_url, {_LM[0]} AS is_self, {_LM[1]} AS domain FROM ce"""

_SQL["slugify"] = "WITH " + NOTE_ROWS + f"""
SELECT doc_id, {SLUG("concat_ws(' ', source, lang, 'News!')")} AS slug,
  {SLUG("regexp_extract(text, '^(\\S*)', 1)")} AS word_slug FROM nr"""

_SQL["note_id"] = "WITH " + NOTE_ROWS + f"""
SELECT doc_id, concat_ws('-', date, substring({SLUG('source')}, 1, 8), substring(md5(coalesce(source_url, '')), 1, 4)) AS note_id
FROM nr"""

_YQ_INNER = TRIMWS("replace(replace(text, chr(13), ''), chr(10), ' ')")
_SQL["yaml_quote"] = f"""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '""'
  ELSE '"' || replace(replace({_YQ_INNER}, '\\', '\\\\'), '"', '\\"') || '"' END AS quoted
FROM documents"""

_SENT = (f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
         f"lambda x: {TRIMWS('x')}), lambda x: x <> '')")
_SQL["sentences"] = f"""
WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, s[1] AS first, s[-1] AS last,
  md5(array_to_string(s, chr(10))) AS digest FROM s"""

_CL = f"list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: {TRIMWS('x')}), lambda x: x <> '')"
_SQL["clean_list"] = f"""
WITH c AS (SELECT doc_id, {_CL} AS c FROM documents)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_items, md5(array_to_string(c, '|')) AS digest FROM c"""

_SQL["time_sensitivity"] = "WITH " + NOTE_ROWS + f"""
SELECT doc_id, {TSENS('date')} AS time_sensitivity, {TSENS("'x' || date")} AS bad_date FROM nr"""

_FME = FM_ENTRIES(FM_TEXT)
_TAGV = TRIMWS(f"coalesce({FM_GET('e', 'tags')}, '')")
_SQL["frontmatter"] = "WITH " + NOTE_FILES + f""",
f AS (SELECT path, {_FME} AS e FROM nf),
g AS (SELECT path, e, {_TAGV} AS tv FROM f)
SELECT path, {FM_GET('e', 'title')} AS title, {FM_GET('e', 'status')} AS status,
  {FM_GET('e', 'source_url')} AS source_url, {FM_GET('e', 'date')} AS date,
  array_to_string(CASE WHEN regexp_matches(tv, '^\\[.*\\]$')
      THEN list_filter(list_transform(string_split(regexp_extract(tv, '^\\[(.*)\\]$', 1), ','), lambda x: {UNQ('x')}), lambda x: x <> '')
      WHEN tv <> '' THEN [{UNQ('tv')}] ELSE []::VARCHAR[] END, '|') AS tags,
  CAST(len(list_distinct(list_transform(e, lambda x: x.k))) AS BIGINT) AS n_keys
FROM g"""

_SQL["observation_text"] = "WITH " + NOTE_FILES + f""",
o AS (SELECT path, {OBS_TEXT('b')} AS o FROM (SELECT path, {NOTE_BODY} AS b FROM nf))
SELECT path, md5(o) AS digest, CAST(length(o) AS BIGINT) AS n_chars FROM o"""

_FS_BODY = TRIMWS("regexp_replace(coalesce(text, ''), '(?m)^#+.*$', '', 'g')")
_SQL["first_sentence"] = f"""
SELECT doc_id, {TRIMWS(f"regexp_extract({_FS_BODY}, '^([^.!?]+[.!?])', 1)")} AS first_sentence FROM documents"""

_SQL["url_segment"] = "WITH " + NOTE_ROWS + r"""
SELECT doc_id, CASE WHEN instr(source_url, 'reddit.com/r/') > 0
  THEN regexp_extract(source_url, 'reddit\.com/r/([^/]+)/', 1) ELSE '' END AS community FROM nr"""

_SQL["dedup_first"] = """
SELECT doc_id, md5(text) AS digest FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""

_SQL["skip_known"] = "WITH " + NOTE_ROWS + """
SELECT doc_id, source_url FROM nr a
WHERE NOT EXISTS (SELECT 1 FROM nr b WHERE b.status <> 'inbox' AND b.source_url = a.source_url)"""

_SQL["skip_known_index"] = _SQL["skip_known"]
_SQL["skip_known_scope"] = "WITH " + NOTE_ROWS + """
SELECT doc_id, source_url FROM nr2 n
WHERE NOT EXISTS (SELECT 1 FROM nr2 k WHERE k.status <> 'inbox' AND k.folder = 'Observation Inbox' AND k.source_url = n.source_url)"""

_CE_HTML = "coalesce(nullif(content, ''), nullif(summary, ''), '')"
_LM2 = LINKMETA("html")
_SQL["top_n_per_source"] = "WITH " + COMMUNITY_ENTRIES + f""",
i1 AS (SELECT * FROM ce WHERE coalesce(link, '') <> '' QUALIFY row_number() OVER (PARTITION BY feed, link ORDER BY pos) = 1),
i2 AS (SELECT * FROM i1 QUALIFY row_number() OVER (PARTITION BY feed ORDER BY pos) <= 5),
i3 AS (SELECT *, {_CE_HTML} AS html, {_FLAIR} AS flair FROM i2
       QUALIFY row_number() OVER (PARTITION BY link ORDER BY feed_ord, pos) = 1)
SELECT 'Reddit/r/' || feed AS source, link AS source_url, coalesce(title, '(no title)') AS title,
  coalesce(nullif(substring({STRIPH('html')}, 1, 500), ''), 'Posted in r/' || feed || '.') AS body,
  CAST(coalesce(CAST(timezone('UTC', try_strptime(published, '%Y-%m-%dT%H:%M:%S%z')) AS DATE), DATE '2024-03-01') AS VARCHAR) AS published_date,
  array_to_string(list_concat([feed], CASE WHEN flair <> '' THEN [replace(lower(flair), ' ', '-')] ELSE []::VARCHAR[] END), '|') AS raw_tags,
  CAST(pos AS INTEGER) AS feed_rank, coalesce({_LM2[0]}, false) AS is_self, {_LM2[1]} AS domain,
  replace(link, 'https://www.reddit.com', '') AS permalink
FROM i3"""

_SQL["note_collisions"] = "WITH " + NOTE_ROWS + """
SELECT url_hash, CAST(count(*) AS BIGINT) AS n_urls
FROM (SELECT DISTINCT substring(md5(source_url), 1, 4) AS url_hash, source_url FROM nr)
GROUP BY url_hash HAVING count(*) > 1"""


def _sql_text(t: str) -> str:
    """A SQL string expression for literal text (newlines via chr(10))."""
    parts = t.split("\n")
    lit = [("'" + x.replace("'", "''") + "'") for x in parts]
    return "(" + " || chr(10) || ".join(lit) + ")"


def _sql_fill(template: str, **exprs) -> str:
    """SQL concat for a gleaner prompt template with {name} placeholders."""
    import re as _re
    out, pos = [], 0
    for m in _re.finditer(r"\{\{|\}\}|\{([a-zA-Z_][a-zA-Z0-9_]*)\}", template):
        if m.start() > pos:
            out.append(_sql_text(template[pos:m.start()]))
        tok = m.group(0)
        if tok in ("{{", "}}"):
            out.append(_sql_text(tok[0]))
        else:
            out.append(f"coalesce(CAST({exprs[m.group(1)]} AS VARCHAR), '')")
        pos = m.end()
    if pos < len(template):
        out.append(_sql_text(template[pos:]))
    return "(" + " || ".join(out) + ")"


LISTING_ITEMS = LISTING + f""",
li AS (
  SELECT (CAST(1 AS BIGINT) << 56) + CAST(rank AS BIGINT) AS seq,
    'Reddit/r/' || community AS source,
    'https://www.reddit.com' || coalesce(permalink, '') AS source_url,
    coalesce(title, '') AS title,
    CASE WHEN {TRIMWS("coalesce(selftext, '')")} <> '' THEN substring({TRIMWS("coalesce(selftext, '')")}, 1, 500)
         ELSE 'Posted in r/' || community || ' with ' || CAST(coalesce(score, 0) AS VARCHAR) || ' upvotes.' END AS body,
    community AS subreddit, CAST(coalesce(score, 0) AS BIGINT) AS score,
    CAST(coalesce(num_comments, 0) AS BIGINT) AS num_comments,
    CAST(coalesce(upvote_ratio, 0.0) AS DOUBLE) AS upvote_ratio, coalesce(is_video, false) AS is_video,
    coalesce(is_self, false) AS is_self, coalesce(domain, '') AS domain, coalesce(permalink, '') AS permalink
  FROM lc WHERE NOT coalesce(stickied, false))"""

_PASSIVE = " OR ".join(f"instr(lower(domain), '{x}') > 0" for x in
                       ("i.redd.it", "v.redd.it", "i.imgur.com", "imgur.com", "gfycat.com", "youtube.com", "youtu.be"))
WIRE_SCORE = f"""round(least(CAST(greatest(num_comments, 0) AS DOUBLE) / (CAST(greatest(score, 0) AS DOUBLE) + 10.0), 1.0) * 5.0
  + ((CASE WHEN is_self THEN 2.0 ELSE 0.0 END) + (CASE WHEN is_video THEN -1.5 ELSE 0.0 END)
     + (CASE WHEN {_PASSIVE} THEN -1.0 WHEN lower(domain) <> '' AND NOT starts_with(lower(domain), 'self.') THEN 1.0 ELSE 0.0 END))
  + (upvote_ratio - 0.5) * 2.0
  + CAST(least(len(list_filter(['view', 'purchase', 'signup', 'user 1'], lambda k: instr(lower(coalesce(title, '')), k) > 0)), 3) AS DOUBLE) * 1.5
  + log10(CAST(greatest(score, 0) AS DOUBLE) + 1.0), 4)"""

GATED = LISTING_ITEMS + f""",
g0 AS (SELECT li.*, {WIRE_SCORE} AS wire_pre_score, length(title) AS n FROM li),
g1 AS (SELECT *, n % 13 AS r, n % 6 AS s FROM g0),
g2 AS (SELECT *,
  CAST(CASE WHEN r = 0 THEN 2 WHEN r IN (1, 4, 6, 12) THEN s WHEN r = 9 THEN 5 ELSE 0 END AS INTEGER) AS triage_score,
  CASE WHEN r IN (1, 4, 7, 12) THEN 'NATION_' || CAST(n % 25 AS VARCHAR) END AS best_lens,
  CASE WHEN r = 0 THEN NULL WHEN r IN (2, 3, 5, 8, 11) THEN 'unparsable' WHEN r = 1 THEN 'fenced'
       WHEN r = 6 THEN 'float' WHEN r = 9 THEN 'over' WHEN r = 12 THEN 'plain' END AS why,
  r = 0 AS failed,
  CAST(CASE r WHEN 1 THEN s WHEN 4 THEN s WHEN 6 THEN s WHEN 7 THEN 0 WHEN 9 THEN 5 WHEN 10 THEN 0 WHEN 12 THEN s END AS INTEGER) AS rw,
  CASE WHEN r IN (0, 2) THEN 'UNPARSABLE' WHEN r = 3 THEN 'ARRAY' WHEN r = 11 THEN 'VOID' ELSE 'OBJECT' END AS reply_kind
  FROM g1),
g3 AS (SELECT *, CASE WHEN failed THEN 'maybe' WHEN triage_score >= 3 THEN 'survivor'
                      WHEN triage_score >= 2 THEN 'maybe' ELSE 'rejected' END AS bucket FROM g2)"""

COMMENTS_TOP = r"""
cm AS (SELECT '/r/sub' || CAST(conv_id % 7 AS VARCHAR) || '/comments/' || CAST(conv_id AS VARCHAR) || '/' AS permalink,
              CAST(turn AS INTEGER) AS pos, text FROM conversations WHERE role <> 'system'),
tc AS (SELECT permalink, string_agg(text, ' | ' ORDER BY pos, text) AS top
       FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY permalink ORDER BY pos, text) <= 12)
       GROUP BY permalink)"""

DEEP = GATED + "," + COMMENTS_TOP + """,
dd AS (
  SELECT g3.*, (g3.bucket = 'survivor' AND g3.permalink <> '' AND tc.top IS NOT NULL) AS deep_dived,
    CASE WHEN g3.bucket = 'survivor' AND g3.permalink <> '' AND tc.top IS NOT NULL
         THEN substring(g3.body || chr(10) || chr(10) || 'Top comments: ' || tc.top, 1, 1500) ELSE g3.body END AS body2
  FROM g3 LEFT JOIN tc ON g3.permalink = tc.permalink)"""

LENS_FILES = r"""
lf AS (SELECT '/vault/lenses/' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '.md' AS path,
  '---' || chr(10) || 'name: ' || n_name || chr(10) || '---' || chr(10) || '# ' || n_name || chr(10)
  || 'Reads an item through region ' || CAST(n_regionkey AS VARCHAR) || '. Asks who gains!' || chr(10) AS value
  FROM nation)"""

_LENS_BODY = "(CASE WHEN strpos(substr(value, 4), '---') > 0 THEN substr(value, strpos(substr(value, 4), '---') + 6) ELSE value END)"
_LENS_FS = TRIMWS(f"regexp_extract({TRIMWS(f'regexp_replace({_LENS_BODY}, {chr(39)}(?m)^#+.*${chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, '^([^.!?]+[.!?])', 1)")
LENSES = LENS_FILES + f""",
lr AS (SELECT path,
  coalesce({UNQ("substr(list_filter(string_split_regex(coalesce(" + FM_TEXT + ", ''), '\\r\\n|[\\n\\r]'), lambda l: starts_with(l, 'name:'))[1], 6)")}, '') AS name,
  {_LENS_FS} AS first_sentence FROM lf),
lo AS (SELECT *, row_number() OVER (ORDER BY path) AS ord FROM lr),
lsum AS (SELECT coalesce(string_agg(CAST(ord AS VARCHAR) || '. ' || name || ': ' || coalesce(first_sentence, ''), chr(10) ORDER BY ord)
                         FILTER (WHERE coalesce(name, '') <> ''), '(No lenses available.)') AS lens_summary FROM lo)"""

_SQL["wire_score"] = "WITH " + LISTING_ITEMS + f"\nSELECT source_url, {WIRE_SCORE} AS wire_pre_score FROM li"

_SQL["wire_prerank"] = "WITH " + LISTING_ITEMS + f""",
w AS (SELECT *, {WIRE_SCORE} AS wire_pre_score FROM li)
SELECT source_url, subreddit, wire_pre_score,
  CAST(row_number() OVER (PARTITION BY subreddit ORDER BY wire_pre_score DESC, seq) AS INTEGER) AS prerank FROM w"""

_SQL["infer_batch"] = "WITH " + GATED + """
SELECT source_url, CASE WHEN r = 0 THEN NULL ELSE 'rule-model' END AS backend,
  CASE WHEN r = 0 THEN 'RuntimeError: model unavailable' END AS error FROM g3"""

_SQL["parse_reply"] = "WITH " + GATED + "\nSELECT source_url, reply_kind FROM g3"
_SQL["clamp_int"] = "WITH " + GATED + "\nSELECT source_url, rw FROM g3"
_SQL["triage_gate"] = "WITH " + GATED + "\nSELECT source_url, triage_score, bucket, best_lens, why, failed FROM g3"

_SQL["survivor_budget"] = "WITH " + GATED + """,
b AS (SELECT *, CASE WHEN bucket = 'survivor' THEN row_number() OVER (PARTITION BY bucket = 'survivor'
      ORDER BY triage_score DESC, wire_pre_score DESC, seq) END AS rk FROM g3)
SELECT source_url, CASE WHEN bucket = 'survivor' AND rk > 5 THEN 'maybe' ELSE bucket END AS bucket,
  coalesce(bucket = 'survivor' AND rk > 5, false) AS overflow FROM b"""

_SQL["deep_dive"] = "WITH " + DEEP + """
SELECT source_url, deep_dived, md5(body2) AS body_digest, CAST(length(body2) AS BIGINT) AS body_chars FROM dd"""

FUNNEL = DEEP + ",\n" + FEED_ITEMS.lstrip() + """,
fn AS (
  SELECT source_url, 'ungated' AS bucket, CAST(NULL AS INTEGER) AS triage_score, CAST(NULL AS DOUBLE) AS wire_pre_score,
         false AS deep_dived FROM fi
  UNION ALL
  SELECT source_url, bucket, triage_score, wire_pre_score, deep_dived FROM dd)"""

_SQL["funnel"] = "WITH " + FUNNEL + "\nSELECT * FROM fn"
_SQL["funnel_stats"] = "WITH " + FUNNEL + """
SELECT CAST(count(*) FILTER (WHERE bucket <> 'ungated') AS BIGINT) AS n_in,
  CAST(count(*) FILTER (WHERE bucket = 'survivor') AS BIGINT) AS survivors,
  CAST(count(*) FILTER (WHERE bucket = 'maybe') AS BIGINT) AS maybe,
  CAST(count(*) FILTER (WHERE bucket = 'rejected') AS BIGINT) AS rejected,
  CAST(count(*) FILTER (WHERE bucket = 'ungated') AS BIGINT) AS ungated FROM fn"""


def _gate_prompt_sql():
    from gleaner.functions.prompts import GATE_SYSTEM, GATE_USER
    system = _sql_fill(GATE_SYSTEM, lens_summary="(SELECT lens_summary FROM lsum)")
    item = ("json_object('subreddit', coalesce(subreddit, ''), 'title', coalesce(title, ''), "
            "'body', substring(coalesce(body, ''), 1, 500), 'score', score, 'num_comments', num_comments, "
            "'upvote_ratio', upvote_ratio)")
    user = _sql_fill(GATE_USER, exemplar_block="''", item=item)
    return ("WITH " + LISTING_ITEMS + "," + LENSES + f"""
SELECT source_url, md5({system}) AS system_digest, md5({user}) AS user_digest,
  CAST(length({user}) AS BIGINT) AS user_chars FROM li""")


_SQL["gate_prompt"] = _gate_prompt_sql()


def _aliases_sql():
    from gleaner.functions.metadata import RELEVANCE_TAXONOMY, TAXONOMY_ALIASES
    al = "[" + ", ".join(f"{{'k': '{k}', 'v': '{v}'}}" for k, v in TAXONOMY_ALIASES) + "]"
    tax = "[" + ", ".join(f"'{t}'" for t in RELEVANCE_TAXONOMY) + "]"
    return al, tax


def DERIVE(t: str, mode: str = "substring") -> str:
    al, tax = _aliases_sql()
    direct = f"list_transform({t}, lambda x_: coalesce(list_filter({al}, lambda al_: al_.k = replace(lower(x_), '-', ' '))[1].v, x_))"
    blob = f"lower(array_to_string({t}, ' '))"
    if mode == "token":
        hit = f"list_contains(string_split_regex({blob}, '\\s+'), al_.k)"
    else:
        hit = f"instr({blob}, al_.k) > 0"
    found = f"list_transform(list_filter({al}, lambda al_: {hit}), lambda al_: al_.v)"
    rel = f"list_filter(list_concat({direct}, {found}), lambda x_: list_contains({tax}, x_))"
    dist = f"list_filter({rel}, lambda x_, i_: list_position({rel}, x_) = i_)"
    return f"(CASE WHEN len({dist}) > 0 THEN {dist} ELSE ['music_production'] END)"


def CLEAN(t: str) -> str:
    item = TRIMWS("coalesce(x, 'None')")
    return f"coalesce(list_filter(list_transform({t}, lambda x: {item}), lambda x: x <> ''), []::VARCHAR[])"


def JNONE(t: str) -> str:
    return f"array_to_string(list_transform({t}, lambda x: coalesce(x, '<none>')), '|')"


_SQL["lens_summary"] = "WITH " + LENSES + """
SELECT CAST(ord AS BIGINT) AS ord, name, first_sentence, (SELECT lens_summary FROM lsum) AS lens_summary FROM lo"""

_RAW_TAGS = "list_filter(categories, lambda t: coalesce(t, '') <> '')"
ENRICHED = "WITH " + FEED_ENTRIES + r""",
fi AS (
  SELECT link AS source_url, coalesce(title, '(no title)') AS title, """ + _RAW_TAGS + r""" AS raw_tags
  FROM fe WHERE coalesce(link, '') <> '' QUALIFY row_number() OVER (PARTITION BY feed, link ORDER BY pos) = 1),
en AS (
  SELECT source_url, title, raw_tags, length(title) AS m, length(title) % 9 AS r,
    'NATION_' || CAST(length(title) % 25 AS VARCHAR) AS a, 'NATION_' || CAST((length(title) + 1) % 25 AS VARCHAR) AS b
  FROM fi),
e2 AS (
  SELECT *, r IN (0, 2, 3) AS no_obj,
    CASE r WHEN 0 THEN 'inference_error' WHEN 2 THEN 'unparsable' WHEN 3 THEN 'not_object'
           WHEN 4 THEN 'bad_observation' WHEN 5 THEN 'bad_interest_level' END AS error_kind,
    CAST(CASE WHEN r IN (1, 4) THEN greatest(least(m % 6, 5), 1) WHEN r = 6 THEN 5 WHEN r = 7 THEN 1
              WHEN r = 8 THEN 4 END AS INTEGER) AS interest_level,
    CASE WHEN r IN (0, 2, 3, 7) THEN substring(title, 1, 120) WHEN r = 4 THEN NULL
         ELSE 'Item of length ' || CAST(m AS VARCHAR) || '.' END AS observation,
    CASE WHEN r IN (0, 2, 3) THEN raw_tags
         ELSE ['len-' || CAST(m % 5 AS VARCHAR), ' Techno Mixing ', '', 'bandcamp'] END AS tags,
    CASE WHEN r IN (0, 2, 3) THEN []::VARCHAR[] WHEN r = 7 THEN [lower(a), b] WHEN r = 8 THEN [NULL, NULL]::VARCHAR[]
         ELSE [a, b] END AS names,
    CASE WHEN r IN (0, 2, 3, 8) THEN ['NATION_0'] ELSE [a, b] END AS lenses,
    CASE WHEN r IN (0, 2, 3) THEN '' WHEN r = 8 THEN (CASE WHEN a = 'NATION_0' THEN 'NATION_0' ELSE '' END)
         ELSE a END AS question_lenses,
    CASE WHEN r IN (0, 2, 3) THEN 'unknown' WHEN m % 2 = 0 THEN 'high' ELSE 'medium' END AS time_sensitivity,
    CAST(CASE WHEN r IN (0, 2, 3) THEN 0 WHEN m % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_claims,
    CASE WHEN r = 0 THEN NULL ELSE 'rule-model' END AS backend
  FROM en),
e3 AS (SELECT *, """ + CLEAN("tags") + """ AS topics FROM e2)"""

_SQL["lens_names"] = ENRICHED + f"\nSELECT source_url, {JNONE('names')} AS names FROM e3"
_SQL["match_lenses"] = ENRICHED + f"\nSELECT source_url, {JNONE('lenses')} AS lenses FROM e3 WHERE error_kind IS NULL"
_SQL["scope_questions"] = ENRICHED + """
SELECT source_url, question_lenses, CAST(CASE WHEN question_lenses = '' THEN 0 ELSE 2 END AS BIGINT) AS n_questions
FROM e3 WHERE error_kind IS NULL"""
_SQL["enrich"] = ENRICHED + f"""
SELECT source_url, error_kind, interest_level, observation, {JNONE('tags')} AS tags, {JNONE('lenses')} AS lenses,
  question_lenses, time_sensitivity, array_to_string({DERIVE('topics')}, '|') AS relevance, n_claims,
  array_to_string(topics, '|') AS topics, backend
FROM e3"""
_SQL["quarantine"] = ENRICHED + "\nSELECT source_url, 'enrich' AS stage, error_kind FROM e3 WHERE error_kind IS NOT NULL"
_SQL["interest_threshold"] = ENRICHED + "\nSELECT source_url, interest_level FROM e3 WHERE error_kind IS NULL AND interest_level >= 2"
_SQL["fail_open"] = (ENRICHED + ",\n" + GATED.lstrip() + """
SELECT source_url, 'gate' AS stage, bucket AS routed_to FROM g3 WHERE failed
UNION ALL
SELECT source_url, 'enrich' AS stage, 'quarantine' AS routed_to FROM e3 WHERE r = 0""")

_TOPICS = "list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_SQL["derive_relevance"] = f"""
WITH t AS (SELECT doc_id, {_TOPICS} AS topics FROM documents)
SELECT doc_id, array_to_string({DERIVE('topics')}, '|') AS relevance,
  array_to_string({DERIVE('topics', 'token')}, '|') AS relevance_token FROM t"""

_SENT2 = (f"list_filter(list_transform(string_split(regexp_replace({TRIMWS('coalesce(text, chr(39)||chr(39))')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
          f"lambda x: {TRIMWS('x')}), lambda x: x <> '')")
_SQL["build_metadata"] = "WITH " + NOTE_ROWS + f""",
bm AS (SELECT doc_id, title, source, date, {_SENT2} AS claims, {CLEAN('[lang, source]')} AS topics FROM nr)
SELECT doc_id, {TRIMWS("coalesce(nullif(title, ''), '')")} AS title, {TRIMWS("coalesce(nullif(source, ''), '')")} AS publication,
  {TRIMWS("coalesce(nullif(date, ''), '')")} AS publication_date, {TRIMWS("coalesce(nullif(title, ''), '')")} AS summary,
  CAST(len(claims) AS BIGINT) AS n_claims, md5(array_to_string(claims, chr(10))) AS claims_digest,
  array_to_string(topics, '|') AS topics, array_to_string({DERIVE('topics')}, '|') AS relevance,
  {TSENS('date')} AS time_sensitivity
FROM bm"""


def NODE(x: str) -> str:
    return TRIMWS(f"regexp_replace(coalesce({x}, ''), '\\s*<[^>]*>\\s*', '', 'g')")


def LABEL(a: str, t: str) -> str:
    return (f"(CASE WHEN coalesce({a}, '') <> '' AND coalesce({t}, '') <> '' THEN {a} || ' — ' || {t} "
            f"WHEN coalesce({a}, '') <> '' THEN {a} WHEN coalesce({t}, '') <> '' THEN {t} END)")


_LI = "'<li><a href=\"/([^\"]*)\">([^<]*)</a></li>'"
CHARTS = f"""
cp0 AS (SELECT page_id, url, html, regexp_extract_all(html, {_LI}, 2) AS its, regexp_extract_all(html, {_LI}, 1) AS pths,
          regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS genre FROM pages),
cp AS (SELECT url, genre, regexp_replace(genre, '[^a-z0-9]+', '-', 'g') AS slug, CAST(page_id AS INTEGER) AS ord,
  CASE WHEN page_id % 2 = 1 THEN replace(html, '<li>', '<span>')
    || '<script id="__NEXT_DATA__" type="application/json">{{"props":{{"pageProps":{{"chart":{{"tracks":'
    || CAST(to_json(list_transform(generate_series(1, len(its)), lambda i_: {{'name': its[i_], 'artists': [{{'name': pths[i_]}}]}})) AS VARCHAR)
    || '}}}}}}}}</script>' ELSE html END AS html FROM cp0),
hr AS (SELECT url, genre, slug, ord, unnest(rws) AS row, unnest(generate_series(0, len(rws) - 1)) AS pos
       FROM (SELECT *, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS rws FROM cp)),
hl AS (SELECT *, {LABEL(NODE("regexp_extract(row, 'href=\"/([^\"]*)\"', 1)"), NODE("regexp_extract(row, '>([^<]*)</a>', 1)"))} AS label
       FROM hr WHERE pos < 10),
hi AS (SELECT * FROM hl WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url, lower(label) ORDER BY pos) = 1),
jp AS (SELECT url, genre, slug, ord, regexp_extract(html, '(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1) AS blob
       FROM cp WHERE url NOT IN (SELECT url FROM hi)),
jt AS (SELECT url, genre, slug, ord, CAST(json_extract(blob, '$.props.pageProps.chart.tracks') AS JSON[]) AS tracks
       FROM jp WHERE json_valid(blob) AND blob <> ''),
ju AS (SELECT url, genre, slug, ord, unnest(tracks) AS t, unnest(generate_series(0, len(tracks) - 1)) AS pos FROM jt),
jl AS (SELECT url, genre, slug, ord, pos, {LABEL(
    "array_to_string(list_filter(list_transform(CAST(json_extract(t, '$.artists') AS JSON[]), lambda a_: json_extract_string(a_, '$.name')), lambda x_: coalesce(x_, '') <> ''), ', ')",
    "coalesce(json_extract_string(t, '$.name'), '')")} AS label FROM ju WHERE pos < 10),
ji AS (SELECT * FROM jl WHERE label IS NOT NULL),
ci AS (SELECT (CAST(2 AS BIGINT) << 56) + (CAST(ord AS BIGINT) << 32) + pos AS seq, 'beatport' AS adapter, 'Beatport Charts' AS source,
         url AS source_url, label AS title FROM hi
       UNION ALL
       SELECT (CAST(2 AS BIGINT) << 56) + (CAST(ord AS BIGINT) << 32) + pos, 'beatport', 'Beatport Charts', url, label FROM ji)"""

_SQL["html_items"] = "WITH " + CHARTS + """
SELECT url AS source_url, label AS title, CAST(pos AS INTEGER) AS chart_pos, 'Track charting in Beatport ' || genre || ' Top 100.' AS body,
  slug || '|chart|beatport' AS raw_tags FROM hi"""
_SQL["html_items_default"] = f"""
WITH p AS (SELECT url, regexp_extract_all(html, {_LI}, 2) AS names, regexp_extract_all(html, {_LI}, 1) AS paths FROM pages),
r AS (SELECT url, unnest(names) AS name, unnest(paths) AS path, unnest(generate_series(0, len(names) - 1)) AS pos FROM p),
l AS (SELECT url, pos, {LABEL(TRIMWS("path"), TRIMWS("name") + " || 'mix'")} AS label FROM r WHERE pos < 10)
SELECT url AS source_url, label AS title, CAST(pos AS INTEGER) AS chart_pos FROM l WHERE label IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY url, lower(label) ORDER BY pos) = 1"""
_SQL["match_lenses_join"] = _SQL["match_lenses"]
_SQL["alias_join"] = "WITH " + NOTE_ROWS + r""",
w AS (SELECT DISTINCT unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS alias FROM documents),
a AS (SELECT alias FROM w WHERE length(alias) >= 7)
SELECT doc_id, count(*) AS n_hits, md5(string_agg(alias, '|' ORDER BY alias)) AS digest
FROM nr JOIN a ON contains(lower(nr.title), a.alias) GROUP BY doc_id"""
_SQL["feed_files"] = f"""
WITH p AS (SELECT page_id, url, regexp_extract_all(html, {_LI}, 2) AS names FROM pages),
e AS (SELECT page_id, url, unnest(names) AS name, unnest(generate_series(0, len(names) - 1)) AS i FROM p)
SELECT CAST(page_id AS VARCHAR) AS feed, CAST(i AS INTEGER) AS pos,
  CASE WHEN (page_id + i) % 5 <> 3 THEN url || '#' || CAST(i AS VARCHAR) END AS link,
  CASE WHEN (page_id + i) % 5 <> 3 THEN name END AS title,
  CASE WHEN (page_id + i) % 5 = 3 THEN 'unparsable_entry' END AS error_kind FROM e"""
_SQL["json_items"] = "WITH " + CHARTS + "\nSELECT url AS source_url, label AS title, CAST(pos AS INTEGER) AS chart_pos FROM ji"

REGISTRY = r"""
rg AS (SELECT 'rss' AS adapter, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS name, CAST(page_id AS VARCHAR) AS slug,
  CASE WHEN page_id % 7 = 3 THEN '' ELSE url END AS url, page_id % 4 <> 1 AS enabled FROM pages)"""
_SQL["item_sources"] = "WITH " + FEED_ITEMS + ",\n" + REGISTRY.lstrip() + """
SELECT fi.source_url, fi.source, rg.name, rg.slug FROM fi JOIN rg ON rg.url = fi.source_url
WHERE coalesce(rg.enabled, false) AND nullif(rg.url, '') IS NOT NULL"""
_SQL["enabled_sources"] = "WITH " + REGISTRY + "\nSELECT name, slug, url FROM rg WHERE coalesce(enabled, false) AND nullif(url, '') IS NOT NULL"
_SQL["drop_blank_url"] = "WITH " + REGISTRY + "\nSELECT name, slug, url FROM rg WHERE coalesce(url, '') <> ''"

_HD = "lower(substring(regexp_replace(coalesce(body, ''), '^\\s+', ''), 1, 200))"
_SQL["classify_fetch"] = f"""
WITH rs AS (
  SELECT url, CAST(page_id % 4 AS INTEGER) AS attempt,
    CAST(CASE WHEN page_id % 10 = 0 THEN 429 WHEN page_id % 10 = 1 THEN 503 WHEN page_id % 10 = 2 THEN 403 ELSE 200 END AS INTEGER) AS status,
    CASE WHEN page_id % 3 = 0 THEN html ELSE '  <?xml version="1.0"?><feed><title>' || regexp_extract(html, '<title>([^<]*)</title>', 1)
      || '</title></feed>' END AS body FROM pages)
SELECT url, attempt, status, CASE WHEN status = 429 OR status >= 500 THEN 'retry' WHEN status <> 200 THEN 'give_up'
  WHEN starts_with({_HD}, '<!doctype html') OR starts_with({_HD}, '<html') OR instr({_HD}, '<head') > 0
       OR instr({_HD}, 'theme-beta') > 0 THEN 'retry' ELSE 'ok' END AS outcome FROM rs"""

ALL_ITEMS = "WITH " + FEED_ITEMS + ",\n" + LISTING_ITEMS.lstrip() + "," + CHARTS + """,
ai AS (SELECT seq, 'rss' AS adapter, source, source_url, title FROM fi
       UNION ALL SELECT seq, 'reddit', source, source_url, title FROM li
       UNION ALL SELECT seq, adapter, source, source_url, title FROM ci)"""
_SQL["union_sources"] = ALL_ITEMS + "\nSELECT * FROM ai"
_SQL["adapter_counts"] = ALL_ITEMS + "\nSELECT adapter, source, CAST(count(*) AS BIGINT) AS n_items FROM ai GROUP BY adapter, source"

_FOLDER = "regexp_extract(path, '([^/]*)/[^/]*$', 1)"
_FNAME = "regexp_extract(path, '([^/]*)$', 1)"
NOTES_PARSED = "WITH " + NOTE_FILES + f""",
np AS (SELECT path, value, {_FOLDER} AS folder, {FM_ENTRIES(FM_TEXT)} AS e, {NOTE_BODY} AS body, {FM_TEXT} IS NOT NULL AS has_fm
       FROM nf WHERE instr(path, '/lenses/') = 0 AND lower({_FNAME}) <> 'readme.md')"""

LABELS = NOTES_PARSED + f""",
lb0 AS (SELECT path, coalesce({FM_GET('e', 'source_url')}, '') AS url, lower(coalesce({FM_GET('e', 'status')}, '')) AS status,
          coalesce(nullif({FM_GET('e', 'title')}, ''), {FM_GET('e', 'observation')}, '') AS title,
          coalesce({FM_GET('e', 'date')}, '') AS date FROM np),
lb AS (SELECT path, title, CASE WHEN instr(url, 'reddit.com/r/') > 0 THEN regexp_extract(url, 'reddit\\.com/r/([^/]+)/', 1) ELSE '' END AS subreddit,
         url AS source_url, status,
         CASE WHEN status IN ('reacted', 'queued', 'published', 'posted') THEN true
              WHEN status IN ('archived', 'ignored', 'skipped') THEN false END AS positive, date
       FROM lb0 WHERE instr(url, 'reddit.com/r/') > 0),
lab AS (SELECT * FROM lb WHERE positive IS NOT NULL),
ex AS (SELECT *, CASE WHEN positive THEN 0 ELSE 1 END AS grp FROM lab
       QUALIFY row_number() OVER (PARTITION BY positive ORDER BY date DESC, source_url, path) <= 4)"""

_SQL["harvest_labels"] = LABELS + "\nSELECT path, title, subreddit, source_url, status, positive FROM lab"
_SQL["select_exemplars"] = LABELS + "\nSELECT path, positive, CAST(grp AS INTEGER) AS grp, date FROM ex"
_EXLINE = "'- [' || CASE WHEN positive THEN 'WORTH A LOOK' ELSE 'PASSED OVER' END || '] r/' || coalesce(subreddit, '?') || ': ' || substring(coalesce(title, ''), 1, 120)"
_SQL["feedback_block"] = LABELS + f"""
SELECT CAST((SELECT count(*) FILTER (WHERE positive) FROM lab) AS BIGINT) AS positives,
  CAST((SELECT count(*) FILTER (WHERE NOT positive) FROM lab) AS BIGINT) AS negatives,
  (SELECT CASE WHEN count(*) = 0 THEN '' ELSE 'Examples of past verdicts:' || chr(10)
     || string_agg({_EXLINE}, chr(10) ORDER BY grp, date DESC, source_url, path) || chr(10) || chr(10) END FROM ex) AS block"""

def INLINE(v: str) -> str:
    tv = TRIMWS(f"coalesce({v}, '')")
    return (f"(CASE WHEN regexp_matches({tv}, '^\\[.*\\]$') THEN list_filter(list_transform(string_split(regexp_extract({tv}, '^\\[(.*)\\]$', 1), ','), "
            f"lambda x_: {UNQ('x_')}), lambda x_: x_ <> '') WHEN {tv} <> '' THEN [{UNQ(tv)}] ELSE []::VARCHAR[] END)")


NOTE_TABLE = NOTES_PARSED + f""",
nt AS (SELECT path, folder, {FM_GET('e', 'date')} AS date, {FM_GET('e', 'source')} AS source,
         {FM_GET('e', 'observation')} AS observation, try_cast({FM_GET('e', 'interest_level')} AS INTEGER) AS interest_level,
         array_to_string({INLINE(FM_GET('e', 'lenses'))}, '|') AS lenses, lower(coalesce({FM_GET('e', 'status')}, '')) AS status,
         coalesce({FM_GET('e', 'notes')}, '') AS notes FROM np)"""
_SQL["inbox_view"] = NOTE_TABLE + """
SELECT date, source, observation, interest_level, lenses, status FROM nt WHERE folder = 'Observation Inbox' AND status = 'inbox'"""
_SQL["queue_view"] = NOTE_TABLE + """
SELECT date, source, observation, lenses, notes FROM nt WHERE folder IN ('Observation Inbox', 'Reaction Queue') AND status = 'queued'"""

_BF_SENT = (f"list_filter(list_transform(string_split(regexp_replace(ctx, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda x_: {TRIMWS('x_')}), lambda x_: x_ <> '')")


def _g(k):
    return FM_GET('e', k)


_SQL["backfill"] = NOTES_PARSED + f""",
b0 AS (SELECT path, e, {TRIMWS("coalesce(nullif(coalesce(" + _g('id') + ", regexp_replace(" + _FNAME + ", '\\.md$', '')), ''), '')")} AS note_id,
         {TRIMWS("coalesce(nullif(coalesce(nullif(" + _g('title') + ", ''), " + _g('observation') + "), ''), '')")} AS title,
         {TRIMWS("coalesce(nullif(" + _g('source') + ", ''), '')")} AS publication,
         {TRIMWS("coalesce(nullif(" + _g('date') + ", ''), '')")} AS publication_date,
         {TRIMWS("coalesce(nullif(" + _g('author') + ", ''), '')")} AS author,
         {INLINE(_g('tags'))} AS tags, {INLINE(_g('entities'))} AS old_entities,
         {TRIMWS(OBS_TEXT('body'))} AS ctx
       FROM np WHERE folder IN ('Observation Inbox', 'Archived') AND has_fm),
b1 AS (SELECT *, {CLEAN("CASE WHEN len(tags) > 0 THEN tags ELSE tags END")} AS topics,
         {TRIMWS("coalesce(nullif(coalesce(nullif(" + _g('observation') + ", ''), title), ''), '')")} AS summary,
         {_BF_SENT} AS claims, {TSENS('publication_date')} AS time_sensitivity FROM b0),
b2 AS (SELECT *, {DERIVE('topics')} AS relevance, CASE WHEN len(old_entities) > 0 THEN old_entities ELSE []::VARCHAR[] END AS entities FROM b1)
SELECT path,
  ({_g('note_id')} IS DISTINCT FROM note_id OR {_g('title')} IS DISTINCT FROM title
   OR {_g('publication')} IS DISTINCT FROM publication OR {_g('publication_date')} IS DISTINCT FROM publication_date
   OR {_g('author')} IS DISTINCT FROM author
   OR array_to_string({INLINE(_g('topics'))}, '|') IS DISTINCT FROM array_to_string(topics, '|')
   OR array_to_string({INLINE(_g('entities'))}, '|') IS DISTINCT FROM array_to_string(entities, '|')
   OR {_g('summary')} IS DISTINCT FROM summary
   OR array_to_string({INLINE(_g('claims'))}, '|') IS DISTINCT FROM array_to_string(claims, '|')
   OR array_to_string({INLINE(_g('relevance'))}, '|') IS DISTINCT FROM array_to_string(relevance, '|')
   OR {_g('time_sensitivity')} IS DISTINCT FROM time_sensitivity) AS changed,
  note_id, title, summary, array_to_string(topics, '|') AS topics, array_to_string(relevance, '|') AS relevance,
  CAST(len(claims) AS BIGINT) AS n_claims, time_sensitivity
FROM b2"""


_BF_HEAD, _BF_TAIL = _SQL["backfill"].split("\nSELECT path,", 1)
# The metadata fields of a note, in the order they are written.
_BF_FIELDS = ("note_id", "title", "publication", "publication_date", "author", "topics", "entities", "summary", "claims",
              "relevance", "time_sensitivity")


def _bf_line(field: str) -> str:
    if field in ("topics", "entities", "relevance"):
        value = f"'[' || array_to_string({field}, ', ') || ']'"
    elif field == "claims":
        value = f"'[' || array_to_string(list_transform(claims, lambda c: {YQ('c')}), ', ') || ']'"
    else:
        value = field if field in ("note_id", "time_sensitivity") else YQ(field)
    return f"'{field}: ' || {value}"


def _backfill_merge_sql() -> str:
    names = "|".join(_BF_FIELDS)
    kept = f"regexp_replace({FM_TEXT}, '(?m)^(?:{names}):[^\\n]*(?:\\n[ \\t-][^\\n]*)*(?:\\n|\\z)', '', 'g')"
    lines = " || chr(10) || ".join(map(_bf_line, _BF_FIELDS))
    return _BF_HEAD + f""",
bf AS (SELECT path, {_BF_TAIL}),
bm AS (
  SELECT np.path, substring({FM_GET('np.e', 'date')}, 1, 7) AS month,
    CASE WHEN bf.changed THEN '---' || regexp_replace({kept}, '\\n+\\z', '') || chr(10) || {lines}
         || chr(10) || '---' || np.body ELSE np.value END AS value
  FROM np LEFT JOIN b2 USING (path) LEFT JOIN (SELECT path, changed FROM bf) bf USING (path))
SELECT path, month, md5(value) AS digest, CAST(length(value) AS BIGINT) AS n_chars FROM bm"""


def ENRICH_FROM(src: str) -> str:
    """en/e2/e3 CTEs: the enrichment verdict for every row of ``src``
    (needs source_url, title, raw_tags)."""
    return f""",
en AS (
  SELECT *, length(title) AS m, length(title) % 9 AS r,
    'NATION_' || CAST(length(title) % 25 AS VARCHAR) AS a, 'NATION_' || CAST((length(title) + 1) % 25 AS VARCHAR) AS b
  FROM {src}),
e2 AS (
  SELECT *,
    CASE r WHEN 0 THEN 'inference_error' WHEN 2 THEN 'unparsable' WHEN 3 THEN 'not_object'
           WHEN 4 THEN 'bad_observation' WHEN 5 THEN 'bad_interest_level' END AS error_kind,
    CAST(CASE WHEN r IN (1, 4) THEN greatest(least(m % 6, 5), 1) WHEN r = 6 THEN 5 WHEN r = 7 THEN 1
              WHEN r = 8 THEN 4 END AS INTEGER) AS interest_level,
    CASE WHEN r IN (0, 2, 3, 7) THEN substring(title, 1, 120) WHEN r = 4 THEN NULL
         ELSE 'Item of length ' || CAST(m AS VARCHAR) || '.' END AS observation,
    CASE WHEN r IN (0, 2, 3) THEN raw_tags
         ELSE ['len-' || CAST(m % 5 AS VARCHAR), ' Techno Mixing ', '', 'bandcamp'] END AS tags,
    CASE WHEN r IN (0, 2, 3, 8) THEN ['NATION_0'] ELSE [a, b] END AS lenses,
    CASE WHEN r IN (0, 2, 3) THEN '' WHEN r = 8 THEN (CASE WHEN a = 'NATION_0' THEN 'NATION_0' ELSE '' END)
         ELSE a END AS question_lenses
  FROM en)"""


def YQ(x: str) -> str:
    inner = TRIMWS(f"replace(replace({x}, chr(13), ''), chr(10), ' ')")
    return f"(CASE WHEN coalesce({x}, '') = '' THEN '\"\"' ELSE '\"' || replace(replace({inner}, '\\', '\\\\'), '\"', '\\\"') || '\"' END)"


_SQL["backfill_merge"] = _backfill_merge_sql()


def NOTE_ID(date: str, source: str, url: str) -> str:
    return f"concat_ws('-', {date}, substring({SLUG(source)}, 1, 8), substring(md5(coalesce({url}, '')), 1, 4))"


_RN_SRC = "WITH " + FEED_ENTRIES + """,
fi AS (
  SELECT feed AS source, link AS source_url, coalesce(title, '(no title)') AS title,
    list_filter(categories, lambda t: coalesce(t, '') <> '') AS raw_tags, '2024-03-01' AS date
  FROM fe WHERE coalesce(link, '') <> '' QUALIFY row_number() OVER (PARTITION BY feed, link ORDER BY pos) = 1)"""

_CTX = "'First point here. Second point!'"
_MD = f"""'---' || chr(10) || 'id: ' || {NOTE_ID('date', 'source', 'source_url')} || chr(10)
  || 'title: ' || {YQ(TRIMWS("coalesce(title, '')"))} || chr(10)
  || 'date: ' || date || chr(10)
  || 'source: ' || {YQ('source')} || chr(10)
  || 'source_url: ' || {YQ('source_url')} || chr(10)
  || 'publication: ' || {YQ(TRIMWS("coalesce(source, '')"))} || chr(10)
  || 'publication_date: ' || {YQ('date')} || chr(10)
  || 'author: ""' || chr(10)
  || 'observation: ' || {YQ('observation')} || chr(10)
  || 'tags: [' || array_to_string(tags, ', ') || ']' || chr(10)
  || 'topics: [' || array_to_string(topics, ', ') || ']' || chr(10)
  || 'entities: [E' || CAST(m % 3 AS VARCHAR) || ']' || chr(10)
  || 'summary: ' || {YQ(TRIMWS("coalesce(nullif(observation, ''), title, '')"))} || chr(10)
  || 'claims: [' || (CASE WHEN m % 2 = 0 THEN '"First point here.", "Second point!"' ELSE '"Claim ' || CAST(m AS VARCHAR) || '."' END) || ']' || chr(10)
  || 'relevance: [' || array_to_string({DERIVE('topics')}, ', ') || ']' || chr(10)
  || 'time_sensitivity: ' || (CASE WHEN m % 2 = 0 THEN 'high' ELSE 'medium' END) || chr(10)
  || 'interest_level: ' || CAST(interest_level AS VARCHAR) || chr(10)
  || 'lenses: [' || array_to_string(lenses, ', ') || ']' || chr(10)
  || 'status: inbox' || chr(10) || 'notes: ""' || chr(10) || '---' || chr(10) || chr(10)
  || '## Observation' || chr(10) || chr(10) || {_CTX} || chr(10) || chr(10)
  || '**Source:** [' || source || '](' || source_url || ')' || chr(10) || chr(10) || '## Questions'
  || (CASE WHEN question_lenses <> '' THEN chr(10) || chr(10) || '### ' || question_lenses || chr(10) || '- Who gains?' || chr(10) || '- Why now?' ELSE '' END)
  || chr(10)"""

_SQL["render_note"] = _RN_SRC + ENRICH_FROM("fi") + f""",
e3 AS (SELECT *, {CLEAN('tags')} AS topics FROM e2 WHERE error_kind IS NULL),
md AS (SELECT source_url, {NOTE_ID('date', 'source', 'source_url')} AS note_id, {_MD} AS markdown FROM e3)
SELECT source_url, note_id, md5(markdown) AS digest, CAST(length(markdown) AS BIGINT) AS n_chars FROM md"""


def _daily_sql(known: bool = True) -> str:
    base = ("WITH " + FEED_ENTRIES + """,
fi AS (
  SELECT (CAST(feed_ord AS BIGINT) << 32) + pos AS seq, feed AS source, link AS source_url,
    coalesce(title, '(no title)') AS title, list_filter(categories, lambda t: coalesce(t, '') <> '') AS raw_tags,
    '2024-03-01' AS date
  FROM fe WHERE coalesce(link, '') <> '' QUALIFY row_number() OVER (PARTITION BY feed, link ORDER BY pos) = 1),
""" + GATED.lstrip() + "," + CHARTS + "," + NOTE_ROWS + """,
known AS (SELECT source_url FROM nr UNION ALL SELECT url FROM pages WHERE page_id IN (SELECT doc_id FROM labels)),
lc2 AS (SELECT *, 'https://www.reddit.com' || permalink AS url2 FROM lc),
ai AS (
  SELECT seq, source, source_url, title, raw_tags, date, 'ungated' AS bucket, CAST(NULL AS INTEGER) AS triage_score,
         CAST(NULL AS DOUBLE) AS wire_pre_score, 'rss' AS adapter FROM fi
  UNION ALL
  SELECT g3.seq, g3.source, g3.source_url, g3.title,
    list_concat([g3.subreddit], CASE WHEN coalesce(lc2.link_flair_text, '') <> '' THEN [replace(lower(lc2.link_flair_text), ' ', '-')] ELSE []::VARCHAR[] END),
    CAST(CAST(make_timestamp(CAST(lc2.created_utc * 1000000 AS BIGINT)) AS DATE) AS VARCHAR),
    g3.bucket, g3.triage_score, g3.wire_pre_score, 'reddit'
  FROM g3 JOIN lc2 ON g3.source_url = lc2.url2
  UNION ALL
  SELECT (CAST(2 AS BIGINT) << 56) + (CAST(ord AS BIGINT) << 32) + pos, 'Beatport Charts', url, label, [slug, 'chart', 'beatport'],
         '2024-03-01', 'ungated', NULL, NULL, 'beatport' FROM hi
  UNION ALL
  SELECT (CAST(2 AS BIGINT) << 56) + (CAST(ord AS BIGINT) << 32) + pos, 'Beatport Charts', url, label, [slug, 'chart', 'beatport'],
         '2024-03-01', 'ungated', NULL, NULL, 'beatport' FROM ji),""")
    stored = "adapter <> 'beatport' AND source_url IN (SELECT source_url FROM known)" if known else "false"
    return base + f"""
led0 AS (SELECT *, CASE WHEN {stored} THEN 'already_stored' WHEN bucket = 'rejected' THEN 'rejected' END AS fate0 FROM ai),
kept AS (SELECT *, row_number() OVER (PARTITION BY source_url, CASE WHEN adapter = 'beatport' THEN title END ORDER BY
           CASE bucket WHEN 'ungated' THEN 0 WHEN 'survivor' THEN 1 WHEN 'maybe' THEN 2 ELSE 3 END,
           coalesce(triage_score, 99) DESC, coalesce(wire_pre_score, 0.0) DESC, seq) AS rn
         FROM led0 WHERE fate0 IS NULL),
uq AS (SELECT * FROM kept WHERE rn = 1)""" + ENRICH_FROM("uq") + """,
led AS (
  SELECT adapter, fate0 AS fate FROM led0 WHERE fate0 IS NOT NULL
  UNION ALL SELECT adapter, 'dup_in_run' FROM kept WHERE rn > 1
  UNION ALL SELECT adapter, CASE WHEN error_kind IS NOT NULL THEN 'failed' WHEN interest_level < 2 THEN 'below_threshold'
                        ELSE 'written' END FROM e2)"""


_SQL["daily_run"] = _daily_sql() + f"""
SELECT source_url, {NOTE_ID('date', 'source', 'source_url')} AS note_id, interest_level, bucket
FROM e2 WHERE error_kind IS NULL AND interest_level >= 2"""

_FATES = ("blank_url", "already_stored", "rejected", "dup_in_run", "failed", "below_threshold", "written")
_SQL["run_summary"] = _daily_sql() + """,
c AS (SELECT CAST(count(*) AS BIGINT) AS fetched, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE fate = '{f}') AS BIGINT) AS {f}" for f in _FATES) + """ FROM led)
SELECT *, blank_url + already_stored + dup_in_run + rejected AS skipped_dedup, below_threshold + written AS processed FROM c"""

_SQL["fates_by_adapter"] = _daily_sql() + """
SELECT adapter, fate, CAST(count(*) AS BIGINT) AS n FROM led GROUP BY adapter, fate"""

_SQL["dry_run"] = _daily_sql(known=False) + """
SELECT source, source_url, observation, interest_level, array_to_string(lenses, ', ') AS lenses,
  array_to_string(tags, ', ') AS tags
FROM e2 WHERE error_kind IS NULL AND interest_level >= 2"""


_SQL["stream_ingest"] = "WITH " + FEED_ITEMS + """
SELECT source, source_url, title FROM fi QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY seq) = 1"""
_SQL["stream_dedup"] = "SELECT DISTINCT user_id, event_type FROM events"


_SQL["exemplar_block"] = LABELS + f"""
SELECT CAST(count(*) AS BIGINT) AS n_lines,
  CASE WHEN count(*) = 0 THEN '' ELSE 'Examples of past verdicts:' || chr(10)
    || string_agg({_EXLINE}, chr(10) ORDER BY grp, date DESC, source_url, path) || chr(10) || chr(10) END AS block
FROM ex"""


def oracle_sql() -> dict[str, str]:
    own = {k: v for k, v in _SQL.items() if k in _QUERIES}
    return own | (_corpus.oracle_sql() if _corpus else {})
