"""Personal data: patterns, then information-theoretic sanitisation.

Patterns find the protected entities (an e-mail address, IP address, card or
phone number). How much a term tells about an entity is estimated from corpus
co-occurrence: among all occurrences of the term, the share ``p`` that stand
within ``REACH`` characters of the entity (both counted by occurrence in
every row, copies included), against the entity's own frequency ``q`` among all
different contexts. The term discloses ``1 - log p / log q`` of the
entity's information content (1: it always stands beside it). A term that stands
beside an entity in at least ``MIN_CONTEXTS`` different contexts (copies of a
passage are one context) and discloses ``GENERALISE_AT`` or more is generalised,
at ``REMOVE_AT`` or more removed, wherever in the corpus it occurs.

All counts cover the whole corpus. Occurrences are looked for with a hash filter
of fixed size, whatever the number of terms, and joined with the exact terms.

Cases: null and empty texts have no span; rows that repeat are judged alike; rows
without doc_id are treated like others; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_filter, staged, table

KINDS = ("email", "ip", "card", "phone")
REACH = 60
MIN_CONTEXTS = 3
GENERALISE_AT = 0.9
REMOVE_AT = 0.99
#: Terms: runs of three letters or more.
_TERM = re.compile(r"[^\W\d_]{3,}")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A number that starts inside a run of digits matches only if the whole run does.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str):
    """Matches of local part, @ and dotted domain, found from the @ so that long
    runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), kinds in their order, then by start."""
    out = [("email", a, z) for a, z in _emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _NOT_DIGIT.sub('', value)}"


def _terms(text: str, spans) -> list[tuple[str, int, int]]:
    """Terms of a text outside the given spans."""
    inside = sorted((a, z) for _, a, z in spans)
    out, at = [], 0
    for m in _TERM.finditer(text):
        while at < len(inside) and inside[at][1] <= m.start():
            at += 1
        if at == len(inside) or m.end() <= inside[at][0]:
            out.append((m.group().lower(), m.start(), m.end()))
    return out


_SPAN = "array<struct<kind: string, start: long, stop: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def _as_structs(spans):
    return [{"kind": k, "start": a, "stop": z} for k, a, z in spans]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, contexts): base spans, and for each of them the
    entity, a hash of its context, the context's terms and how many of their
    occurrences no earlier context of the entity in the text holds (``times``)."""
    context = pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string())),
                         ("times", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            spans, contexts = [], []
            for t in b.column(2):
                text = t.as_py() or ""
                found = base_spans(text)
                spans.append(_as_structs(found))
                near, counted = [], {}
                for kind, a, z in found:
                    lo = max(0, a - REACH)
                    part = text[lo:z + REACH]
                    # Words cut by the edge of the stretch are left out.
                    cut_l = lo > 0 and text[lo - 1].isalpha()
                    cut_r = z + REACH < len(text) and text[z + REACH].isalpha()
                    own = [(k, x - lo, y - lo) for k, x, y in found if y > lo and x < z + REACH]
                    terms = [(w, x) for w, x, y in _terms(part, own)
                             if not (cut_l and x == 0) and not (cut_r and y == len(part))]
                    entity = _entity(kind, text[a:z])
                    # Spans of an entity come by start: what stands up to the last term counted was counted.
                    last, times = counted.get(entity, -1), dict.fromkeys(sorted({w for w, _ in terms}), 0)
                    for w, x in terms:
                        times[w] += lo + x > last
                    if terms:
                        counted[entity] = max(last, lo + terms[-1][1])
                    near.append({"entity": entity, "terms": list(times), "times": list(times.values()),
                                 "context": xxhash.xxh64_intdigest(" ".join(w for w, _ in terms).encode()) - (1 << 63)})
                contexts.append(near)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(spans, _SPANS), pa.array(contexts, pa.list_(context))],
                ["doc_id", "text_hash", "spans", "contexts"])

    return docs.mapInArrow(run, f"doc_id long, text_hash long, spans {_SPAN}, "
                                "contexts array<struct<entity: string, context: long, terms: array<string>, times: array<long>>>")


def _occurrences(docs: DataFrame, terms: DataFrame, positions: bool) -> DataFrame:
    """Occurrences outside base spans of words whose hash is that of a term:
    (word, n) by slice, or (doc_id, text_hash, word, start, stop)."""
    wanted = docs.sparkSession.sparkContext.broadcast(hash_filter(terms, "term"))
    names = ["doc_id", "text_hash", "word", "start", "stop"] if positions else ["word", "n"]

    def run(batches):
        bits, known = wanted.value.tobytes(), {}
        size = len(bits) * 8
        for b in batches:
            counts: dict[str, int] = {}
            rows = []
            for i, t in enumerate(b.column(2)):
                text = t.as_py() or ""
                words = _TERM.findall(text)
                if len(known) > 300_000:
                    known.clear()  # only remembers lookups
                hit = False
                for w in set(words):
                    if w not in known:
                        cell = zlib.crc32(w.lower().encode()) % size
                        known[w] = bits[cell >> 3] >> (cell & 7) & 1 == 1
                    hit = hit or known[w]
                if not hit:
                    continue
                for w, a, z in _terms(text, base_spans(text)):
                    if known.get(text[a:z], False):
                        if positions:
                            rows.append((i, w, a, z))
                        else:
                            counts[w] = counts.get(w, 0) + 1
            if positions and rows:
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows]),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], names)
            elif counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names)

    schema = ("doc_id long, text_hash long, word string, start long, stop long" if positions else "word string, n long")
    return docs.mapInArrow(run, schema)


def disclosing_terms(docs: DataFrame, scanned: DataFrame, min_contexts: int = MIN_CONTEXTS,
                     generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """(term, entity, disclosure, action) of terms at or over the threshold, by the entity they tell most about."""
    every = staged(scanned.select(F.inline("contexts")).groupBy("entity", "context", "terms", "times")
                   .agg(F.count(F.lit(1)).alias("copies")), "pii-contexts")
    near = every.select("entity", "context", "terms").distinct()
    # Rows are (entity, context): unique, whatever the number of copies.
    pairs = staged(near.select("entity", F.explode("terms").alias("term"))
                   .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"))
                   .where(F.col("together") >= min_contexts), "pii-pairs")
    terms = pairs.select("term").distinct()
    if not terms.head(1):
        return terms.select("term", F.lit("").alias("entity"), F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    counts = _occurrences(docs, terms, positions=False).groupBy("word").agg(F.sum("n").alias("n"))
    # Occurrences beside the entity in all rows, as ``n`` counts them.
    beside = (every.select("entity", "copies", F.explode(F.arrays_zip("terms", "times")).alias("t"))
              .select("entity", F.col("t.terms").alias("term"), (F.col("t.times") * F.col("copies")).alias("times"))
              .groupBy("entity", "term").agg(F.sum("times").alias("beside")))
    pairs = staged(pairs.join(beside, ["entity", "term"]), "pii-beside")
    entities = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = entities.agg(F.sum("n_entity")).first()[0]
    p = F.col("beside") / F.col("n")
    q = F.col("n_entity") / F.lit(float(total + 1))
    scored = (pairs.join(counts, F.col("term") == F.col("word")).join(entities, "entity")
              .where("beside > 0")
              .withColumn("disclosure", 1 - F.log(p) / F.log(q)).where(F.col("disclosure") >= generalise_at))
    best = F.max(F.struct("disclosure", "entity")).alias("b")
    return staged(scored.groupBy("term").agg(best).select(
        "term", "b.entity", "b.disclosure",
        F.when(F.col("b.disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")), "pii-terms")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc_id, text_hash, base, added) per row: spans by pattern, and the spans
    of disclosing terms (kind ``generalise`` or ``remove``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text"))
    scanned = staged(scan(rows), "pii")
    terms = disclosing_terms(rows, scanned, **thresholds)
    none = F.array().cast(_SPAN)
    if not terms.head(1):
        return scanned.select("doc_id", "text_hash", F.col("spans").alias("base"), none.alias("added"))
    found = (_occurrences(rows, terms, positions=True).join(terms, F.col("word") == F.col("term"))
             .groupBy(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"))
             .agg(F.array_sort(F.collect_set(F.struct(F.col("action").alias("kind"), "start", "stop"))).alias("added")))
    return (scanned.join(found, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
            .select("doc_id", "text_hash", F.col("spans").alias("base"), F.coalesce("added", none).alias("added")))


def sanitised(text: str, base, added) -> str:
    """The text with entities and generalised terms replaced by their class and removed terms left out."""
    marks = {**{k: f"[{k.upper()}]" for k in KINDS}, "generalise": "[TERM]", "remove": ""}
    out, at = [], 0
    for a, z, k in sorted((s["start"], s["stop"], s["kind"]) for s in [*base, *added]):
        if a >= at:
            out += [text[at:a], marks[k]]
        at = max(at, z)
    return "".join([*out, text[at:]])


def op2_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select("doc_id", *map(n, KINDS), F.sha2(name("base").cast("binary"), 256).alias("base_sha256"),
                        name(F.concat("base", "added")).alias("spans"))
