"""The stages over the small tables, each against plain Python on its own input."""

from __future__ import annotations

from collections import Counter

import _brute as B
import corpus_pipeline as P

from gleaner.llm.secrets import redacted


def test_stages(spark, small):
    folder, _, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols = docs.columns
    key = lambda rows: Counter((r["doc_id"], r["text"], r["source"]) for r in rows)

    kept = P.quality_rules(spark, docs, folder)
    assert kept.columns == cols
    want = Counter({k: n for k, n in key(docs.collect()).items() if not B.quality(k[1])[5]})
    assert key(kept.collect()) == want  # too few labels here to certify a cutoff

    one = P.simhash_dedup(spark, docs, folder)
    assert one.columns == cols
    rows = docs.collect()
    comp = B.components([B.fingerprint(r["text"]) for r in rows])
    best = {}
    for r, c in zip(rows, comp):
        best[c] = min(best.get(c, (True, 0)), (r["doc_id"] is None, r["doc_id"] or 0))
    got = one.collect()
    assert len(got) == len(set(comp))
    assert Counter(r["doc_id"] for r in got) == Counter(None if no else i for no, i in best.values())

    clean = P.benchmark_decontamination(spark, docs, folder)
    assert clean.columns == cols
    bad = {t for (_, t, _), hit in zip([(r["doc_id"], r["text"], 0) for r in rows],
                                       B.contaminated([(r["doc_id"], r["text"]) for r in rows], items)) if hit[5]}
    assert key(clean.collect()) == Counter({k: n for k, n in key(rows).items() if k[1] not in bad})

    masked = P.secret_scan(spark, docs, folder)
    assert masked.columns == cols
    assert Counter(r["text"] for r in masked.collect()) == Counter(redacted(r["text"]) for r in rows)

    mixed = P.source_mix(spark, docs, folder).collect()
    assert all(r["mix_copies"] in (1, 2) for r in mixed)


def test_run_applies_the_stages(spark, small):
    folder = small[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    got = Counter((r["doc_id"], r["text"], r["mix_copies"]) for r in P.run(spark, folder).collect())
    assert got == Counter((r["doc_id"], r["text"], r["mix_copies"]) for r in docs.collect())
