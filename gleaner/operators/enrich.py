"""Enrichment (U2, P17, K5 split, F3).

prompts -> model call (U1) -> staged -> reply parsed per row -> observation
columns; rows whose reply cannot be used go to quarantine with a reason
instead of stopping the run (T10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions.metadata import build_metadata
from ..functions.prompts import ENRICH_SYSTEM, ENRICH_USER, fill, item_json
from ..functions._util import empty_str_array
from .lenses import match_lenses


def enrich_prompt_columns(lens_summary: Column, purpose: str = "", system_template: str = ENRICH_SYSTEM,
                          user_template: str = ENRICH_USER) -> tuple[Column, Column]:
    """P27 (enrich): the ``system`` and ``user`` prompts over item columns.
    Templates may use ``{item}`` (all fields as JSON) or the single fields; the
    system prompt is the same for all items."""
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit(""))
              for c in ("source", "source_url", "title", "body", "published_date")}
    return (fill(system_template, purpose=F.lit(purpose.strip()), lens_summary=lens_summary),
            fill(user_template, item=item_json(**fields), **fields))


def enrich_prompts(items: DataFrame, lens_summary: Column, purpose: str = "",
                   system_template: str = ENRICH_SYSTEM, user_template: str = ENRICH_USER) -> DataFrame:
    """``items`` with ``system`` and ``user`` prompt columns."""
    system, user = enrich_prompt_columns(lens_summary, purpose, system_template, user_template)
    return items.withColumns({"system": system, "user": user})


def _str_list_or(v: Column, key: str, fallback: Column) -> Column:
    """``parsed.get(key, fallback)`` for a list of strings: absent ->
    fallback; present list -> its items as text; present non-list -> []."""
    arr = R.get_array(v, key)
    return (F.when(R.field(v, key).isNull(), fallback)
            .when(arr.isNotNull(), R.variant_str_list(arr))
            .otherwise(empty_str_array()))


def error_kind(v: Column, error: str = "error") -> Column:
    """Why a parsed reply ``v`` cannot be used, NULL when it can."""
    obs = R.field(v, "observation")
    return (F.when(F.col(error).isNotNull(), F.lit("inference_error"))
            .when(v.isNull(), F.lit("unparsable"))
            .when(~R.is_object(v), F.lit("not_object"))
            .when(R.clamp_int(v, "interest_level", 1, 5, 1).isNull(), F.lit("bad_interest_level"))
            .when(obs.isNotNull() & (R.kind(obs) != "STRING"), F.lit("bad_observation")))


def parse_enrichment(replied: DataFrame, lookup: Column, first_lens: Column, as_of,
                     observation_chars: int = 120) -> DataFrame:
    """P12-P17 + P22 over replied rows: typed observation columns and the
    metadata struct, plus ``error_kind`` (NULL for usable rows).

    Defaults follow "absent" semantics (observation <- title, tags <- item
    tags, time_sensitivity <- 'unknown'); a present but wrong-typed value is
    an error, not a default.
    """
    # scalar subqueries cannot sit inside lambdas: project them first
    replied = replied.withColumns({"__lens_map": lookup, "__first_lens": first_lens})
    lookup, first_lens = F.col("__lens_map"), F.col("__first_lens")
    # parse the reply once; every field below reads the VARIANT column
    replied = replied.withColumn("__v", R.parse_reply(F.col("reply")))
    v = F.col("__v")
    title = F.coalesce(F.col("title"), F.lit(""))
    tags = _str_list_or(v, "tags", F.coalesce(F.col("raw_tags"), empty_str_array()))
    obs_present = R.field(v, "observation").isNotNull()
    observation = F.substring(F.when(obs_present, R.get_string(v, "observation")).otherwise(title), 1, observation_chars)
    names = R.lens_names(v)
    lenses = match_lenses(names, lookup, first_lens)
    ts_field = R.field(v, "time_sensitivity")
    p_ts = F.when(ts_field.isNull(), F.lit("unknown")).otherwise(
        F.coalesce(R.get_string(v, "time_sensitivity"), F.to_json(ts_field)))
    ctx_field = R.field(v, "expanded_context")
    ctx = F.when(ctx_field.isNull(), F.lit("")).otherwise(F.coalesce(R.get_string(v, "expanded_context"), F.lit("")))
    out = replied.withColumns({
        "error_kind": error_kind(v),
        "date": F.coalesce(F.col("published_date"), F.lit(as_of).cast("date")).cast("string"),
        "observation": observation,
        "tags": tags,
        "interest_level": R.clamp_int(v, "interest_level", 1, 5, 1),
        "lenses": lenses,
        "expanded_context": ctx,
        "p_entities": _str_list_or(v, "entities", empty_str_array()),
        "p_claims": _str_list_or(v, "claims", empty_str_array()),
        "p_time_sensitivity": p_ts,
    }).withColumns({
        "questions": R.scope_questions(R.questions_map(v), F.col("lenses")),
        "p_topics": _str_list_or(v, "topics", F.col("tags")),
    })
    meta = build_metadata(
        as_of=as_of, title=None, p_title="title", source="source", source_url="source_url",
        published_date="date", author="author", raw_tags="tags", p_observation="observation",
        p_expanded_context="expanded_context", p_claims="p_claims", p_topics="p_topics", p_tags="tags",
        p_entities="p_entities", p_time_sensitivity="p_time_sensitivity")
    return out.withColumn("meta", meta).drop("p_topics", "p_entities", "p_claims", "p_time_sensitivity",
                                             "__lens_map", "__first_lens", "__v")


def split_quarantine(parsed: DataFrame, stage_name: str = "enrich") -> tuple[DataFrame, DataFrame]:
    """K5: (good rows, quarantine rows). Quarantine keeps the URL, the stage,
    the reason and the error text or reply."""
    bad = parsed.where(F.col("error_kind").isNotNull()).select(
        F.col("source_url"), F.lit(stage_name).alias("stage"), F.col("error_kind"),
        F.coalesce(F.col("error"), F.col("reply")).alias("payload"))
    good = parsed.where(F.col("error_kind").isNull())
    return good, bad


def interest_filter(obs: DataFrame, threshold: int = 2) -> DataFrame:
    """keep rows with ``interest_level >= threshold``."""
    return obs.where(F.col("interest_level") >= threshold)
