"""The note table: parse stored notes, labels and exemplars, render Markdown,
views, backfill (S6 row logic, V1-V3, F5-F7, X4, P28, K2, K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions.metadata import build_metadata, first_truthy_str
from ..functions.prompts import exemplar_block_from_lines, exemplar_line
from ..functions.text import nonblank, note_id as note_id_col, observation_text, url_segment, yaml_quote
from ..functions._util import empty_str_array, let

# Status words that label a note (reference status chain).
REACTED_STATES = ("reacted", "queued", "published", "posted")
IGNORED_STATES = ("archived", "ignored", "skipped")

INBOX_FOLDER = "Observation Inbox"
QUEUE_FOLDER = "Reaction Queue"
ARCHIVE_FOLDER = "Archived"


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)


def parse_notes(files: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """S6 + P23: note files (path, value) -> frontmatter map, body, folder, and
    the columns in ``also``. Lens files and READMEs are left out (F5)."""
    p = F.col("path")
    keep = (F.instr(p, "/lenses/") == 0) & (F.lower(_file_name(p)) != "readme.md")
    return files.where(keep).select(
        "path", _folder(p).alias("folder"), FM.frontmatter_map("value").alias("fm"),
        FM.note_body("value").alias("body"), FM.frontmatter_text("value").isNotNull().alias("has_fm"), *also)


def harvest_labels(files: DataFrame, reddit_only: bool = True, min_score: float | None = None,
                   score_key: str = "wire_pre_score") -> DataFrame:
    """Label notes from their status: reacted/queued/published/
    posted -> positive, archived/ignored/skipped -> negative, others none.
    Only community URLs unless ``reddit_only=False``.

    T6: by default every ignored note is a negative (the reference never
    checks the score); with ``min_score`` only ignored notes whose
    ``score_key`` frontmatter value is at least that are kept as (hard)
    negatives."""
    n = parse_notes(files)
    fm = F.col("fm")
    url = F.coalesce(FM.fm_get(fm, "source_url"), F.lit(""))
    is_reddit = F.instr(url, "reddit.com/r/") > 0
    status = F.lower(F.coalesce(FM.fm_get(fm, "status"), F.lit("")))
    positive = (F.when(status.isin(*REACTED_STATES), F.lit(True))
                .when(status.isin(*IGNORED_STATES), F.lit(False)))
    out = n.select(
        "path",
        F.coalesce(nonblank(FM.fm_get(fm, "title")), FM.fm_get(fm, "observation"), F.lit("")).alias("title"),
        F.when(is_reddit, url_segment(url)).otherwise(F.lit("")).alias("subreddit"),
        url.alias("source_url"), status.alias("status"), positive.alias("positive"),
        F.coalesce(FM.fm_get(fm, "date"), F.lit("")).alias("date"), is_reddit.alias("is_reddit"),
        FM.fm_get(fm, score_key).try_cast("double").alias("__score"))
    out = out.where(F.col("positive").isNotNull())
    if min_score is not None:
        out = out.where(F.col("positive") | (F.coalesce(F.col("__score"), F.lit(float("-inf"))) >= min_score))
    if reddit_only:
        out = out.where(F.col("is_reddit"))
    return out.drop("is_reddit", "__score")


def select_exemplars(labels: DataFrame, n_pos: int = 4, n_neg: int = 4) -> DataFrame:
    """The ``n_pos`` most recent positives and ``n_neg`` most recent
    negatives (date desc, url asc -- T7 fix: the reference takes file-system
    order). One pass: ``row_number() <= k`` over the two-valued label is
    planned with a partial WindowGroupLimit, so each map task sends at most
    k rows per label and the hot groups never gather in one task."""
    from .dedup import first_per_key

    order = [F.col("date").desc(), F.col("source_url").asc(), F.col("path").asc()]
    k = max(n_pos, n_neg)
    top = first_per_key(labels, ["positive"], order, k, rank_col="__rk")
    keep = F.when(F.col("positive"), F.col("__rk") <= n_pos).otherwise(F.col("__rk") <= n_neg)
    return top.where(keep).withColumn("grp", F.when(F.col("positive"), F.lit(0)).otherwise(F.lit(1))).drop("__rk")


def exemplar_block(exemplars: DataFrame, max_lines: int = 8) -> Column:
    """P28 over the selected exemplars (positives first, each group in the
    ``select_exemplars`` order), as a scalar subquery column; '' when there
    are none. The input is bounded by ``n_pos + n_neg`` rows."""
    line = exemplar_line(F.col("positive"), F.col("subreddit"), F.col("title"))
    e = F.struct(F.col("grp").alias("g"), F.col("date").alias("d"), F.col("source_url").alias("u"),
                 F.col("path").alias("p"), line.alias("line"))

    def cmp(a, b):
        return (F.when(a["g"] < b["g"], -1).when(a["g"] > b["g"], 1)
                .when(a["d"] > b["d"], -1).when(a["d"] < b["d"], 1)
                .when(a["u"] < b["u"], -1).when(a["u"] > b["u"], 1)
                .when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0))

    lines = F.transform(F.array_sort(F.collect_list(e), cmp), lambda x: x["line"])
    return exemplars.agg(exemplar_block_from_lines(F.slice(lines, 1, max_lines)).alias("b")).scalar()


def note_table(files: DataFrame) -> DataFrame:
    """Typed note rows from stored files (frontmatter fields as columns)."""
    n = parse_notes(files)
    fm = F.col("fm")

    def g(k):
        return FM.fm_get(fm, k)

    return n.select(
        "path", "folder",
        F.coalesce(g("note_id"), g("id")).alias("note_id"),
        g("title").alias("title"), g("date").alias("date"), g("source").alias("source"),
        g("source_url").alias("source_url"), g("observation").alias("observation"),
        FM.inline_list(g("tags")).alias("tags"), FM.inline_list(g("lenses")).alias("lenses"),
        g("interest_level").try_cast("int").alias("interest_level"),
        F.lower(F.coalesce(g("status"), F.lit(""))).alias("status"),
        F.coalesce(g("notes"), F.lit("")).alias("notes"), "body", "has_fm")


def inbox_view(notes: DataFrame, folder: str = INBOX_FOLDER) -> DataFrame:
    """V1: inbox notes of the inbox folder, interest desc then date desc."""
    return (notes.where((F.col("folder") == folder) & (F.col("status") == "inbox"))
            .select("date", "source", "observation", "interest_level", "lenses", "status")
            .orderBy(F.col("interest_level").desc_nulls_last(), F.col("date").desc_nulls_last()))


def queue_view(notes: DataFrame, folders=(INBOX_FOLDER, QUEUE_FOLDER)) -> DataFrame:
    """V2: queued notes of the inbox and queue folders, date desc."""
    return (notes.where(F.col("folder").isin(*folders) & (F.col("status") == "queued"))
            .select("date", "source", "observation", "lenses", "notes")
            .orderBy(F.col("date").desc_nulls_last()))


def list_value(arr: Column, quote: bool = False) -> Column:
    """A list as it is written in frontmatter: ``[a, b]``."""
    a = F.coalesce(arr, empty_str_array())
    if quote:
        a = F.transform(a, yaml_quote)
    return F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))


def _list_line(name: str, arr: Column, quote: bool = False) -> Column:
    return F.concat(F.lit(f"{name}: "), list_value(arr, quote))


def render_note(obs: DataFrame, status: str = "inbox") -> DataFrame:
    """K2: add ``note_id`` and ``markdown`` (frontmatter in fixed order, an
    Observation section, a source line, question sections only for lenses
    that have questions). Expects the observation columns (``meta`` struct
    from ``build_metadata``)."""
    m = F.col("meta")
    nid = F.coalesce(nonblank(m["note_id"]), note_id_col("date", "source", "source_url"))
    fm = F.concat_ws(
        "\n", F.lit("---"),
        F.concat(F.lit("id: "), nid),
        F.concat(F.lit("title: "), yaml_quote(m["title"])),
        F.concat(F.lit("date: "), F.col("date").cast("string")),
        F.concat(F.lit("source: "), yaml_quote(F.col("source"))),
        F.concat(F.lit("source_url: "), yaml_quote(F.col("source_url"))),
        F.concat(F.lit("publication: "), yaml_quote(m["publication"])),
        F.concat(F.lit("publication_date: "), yaml_quote(m["publication_date"])),
        F.concat(F.lit("author: "), yaml_quote(m["author"])),
        F.concat(F.lit("observation: "), yaml_quote(F.col("observation"))),
        _list_line("tags", F.col("tags")),
        _list_line("topics", m["topics"]),
        _list_line("entities", m["entities"]),
        F.concat(F.lit("summary: "), yaml_quote(m["summary"])),
        _list_line("claims", m["claims"], quote=True),
        _list_line("relevance", m["relevance"]),
        F.concat(F.lit("time_sensitivity: "), m["time_sensitivity"]),
        F.concat(F.lit("interest_level: "), F.col("interest_level").cast("string")),
        _list_line("lenses", F.col("lenses")),
        F.lit(f"status: {status}"),
        F.lit('notes: ""'),
        F.lit("---"),
    )
    q = F.coalesce(F.col("questions"), F.create_map().cast("map<string,array<string>>"))
    sections = F.filter(F.transform(F.coalesce(F.col("lenses"), empty_str_array()), lambda l: F.when(
        F.coalesce(F.size(F.try_element_at(q, l)), F.lit(0)) > 0,
        F.concat(F.lit("\n### "), l, F.lit("\n"),
                 F.array_join(F.transform(F.try_element_at(q, l), lambda x: F.concat(F.lit("- "), x)), "\n")))),
        lambda x: x.isNotNull())
    url = F.coalesce(F.col("source_url"), F.lit(""))
    src = F.coalesce(F.col("source"), F.lit(""))
    source_line = F.when(url != "", F.concat(F.lit("["), src, F.lit("]("), url, F.lit(")"))).otherwise(src)
    body = F.concat_ws(
        "\n", F.lit("## Observation"), F.lit(""),
        first_truthy_str(F.col("expanded_context"), F.col("observation")),
        F.lit(""), F.concat(F.lit("**Source:** "), source_line), F.lit(""), F.lit("## Questions"),
        let(sections, lambda sc: F.when(F.size(sc) > 0, F.array_join(sc, "\n"))))
    return obs.withColumn("note_id", nid).withColumn(
        "markdown", F.concat(fm, F.lit("\n\n"), body, F.lit("\n")))


def backfill_metadata(files: DataFrame, as_of, folders=(INBOX_FOLDER, ARCHIVE_FOLDER),
                      overwrite: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """K4: recompute the metadata block of stored notes in ``folders``; columns
    of ``files`` named in ``keep`` are passed on.

    Per note: title <- title or observation; claims <- sentences of the
    Observation section; topics <- tags. Only parsable notes are eligible.
    Existing author/entities are kept unless ``overwrite`` (T18: the
    reference wipes them). ``changed`` is true only when a field differs
    (T19). The body is kept as is; the caller writes a new version.
    """
    n = parse_notes(files, keep).where(F.col("folder").isin(*folders) & F.col("has_fm"))
    # every field is read out of the frontmatter once, before the many places that use it
    fields = ("id", "note_id", "title", "source", "source_url", "date", "author", "observation", "publication",
              "publication_date", "summary", "time_sensitivity")
    lists = ("tags", "topics", "entities", "claims", "relevance")
    fm = F.col("fm")
    stem = F.regexp_replace(_file_name(F.col("path")), r"\.md$", "")
    n = n.select("path", "folder", "fm", "body", *keep, stem.alias("__stem"), observation_text(F.col("body")).alias("__context"),
                 *[FM.fm_get(fm, k).alias(f"__{k}") for k in fields], *[FM.inline_list(FM.fm_get(fm, k)).alias(f"__{k}") for k in lists])

    def g(k):
        return F.col(f"__{k}")

    tags = g("tags")
    meta = build_metadata(
        as_of=as_of, note_id=F.coalesce(g("id"), g("stem")), title=F.coalesce(nonblank(g("title")), g("observation")),
        source=g("source"), source_url=g("source_url"), published_date=g("date"), raw_tags=tags,
        p_observation=g("observation"), p_expanded_context=g("context"), p_tags=tags)
    out = n.withColumn("meta", meta)
    if not overwrite:
        # override from the computed column (a separate projection, so the
        # metadata expression is not re-inlined into every field access)
        m0 = F.col("meta")
        old_entities = g("entities")
        out = out.withColumn("meta", m0.withField("author", F.coalesce(nonblank(g("author")), m0["author"]))
                             .withField("entities", F.when(F.size(old_entities) > 0, old_entities)
                                        .otherwise(m0["entities"])))
    old = F.struct(
        g("note_id").alias("note_id"), g("title").alias("title"), g("publication").alias("publication"),
        g("publication_date").alias("publication_date"), g("author").alias("author"),
        F.array_join(g("topics"), "|").alias("topics"), F.array_join(g("entities"), "|").alias("entities"),
        g("summary").alias("summary"), F.array_join(g("claims"), "|").alias("claims"),
        F.array_join(g("relevance"), "|").alias("relevance"),
        g("time_sensitivity").alias("time_sensitivity"))
    m = F.col("meta")
    new = F.struct(
        m["note_id"].alias("note_id"), m["title"].alias("title"), m["publication"].alias("publication"),
        m["publication_date"].alias("publication_date"), m["author"].alias("author"),
        F.array_join(m["topics"], "|").alias("topics"), F.array_join(m["entities"], "|").alias("entities"),
        m["summary"].alias("summary"), F.array_join(m["claims"], "|").alias("claims"),
        F.array_join(m["relevance"], "|").alias("relevance"), m["time_sensitivity"].alias("time_sensitivity"))
    return out.select("path", "folder", "fm", "body", "meta", (~F.coalesce(old.eqNullSafe(new), F.lit(False))).alias("changed"), *keep)


def backfill_counts(files: DataFrame, backfilled: DataFrame, folders=(INBOX_FOLDER, ARCHIVE_FOLDER)) -> DataFrame:
    """Candidates / eligible / changed (one row)."""
    cand = files.where(_folder(F.col("path")).isin(*folders) & F.col("path").endswith(".md"))
    eligible = backfilled.agg(F.count(F.lit(1))).scalar()
    changed = backfilled.agg(F.count_if("changed")).scalar()
    return cand.agg(F.count(F.lit(1)).alias("candidates")).select(
        "candidates", eligible.alias("eligible"), changed.alias("changed"))
