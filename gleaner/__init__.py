"""gleaner: signal curation as Spark DataFrame operators.

Landed feed, listing, page and note files become typed DataFrames; column
expressions clean and score them; windows and joins rank and deduplicate them;
one Arrow-batched Python stage calls the (pluggable) model; the result is a
queryable note table with run metrics and quarantine.

Layout:
  functions/  column expressions (text, dates, links, replies, metadata, prompts)
  sources/    scans of landed files (feeds, listings, chart pages, notes, lenses)
  operators/  DataFrame -> DataFrame steps (dedup, scoring, gate, inference, ...)
  sinks/      note table, quarantine, backfill output
  plans/      pipelines composed from the operators (funnel, daily run, ...)
  streaming/  Structured Streaming ingest and dedup
"""

__version__ = "0.1.0"
