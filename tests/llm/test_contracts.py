"""Every opN query over small tables with nulls, empties, repeats and clashing
columns, against plain Python; and every query over empty tables."""

from __future__ import annotations

from collections import Counter

import _brute as B
import duckdb
import pytest

from gleaner.llm import registry
from gleaner.llm.mixing import OP6_SQL

Q = registry.queries()


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_op6_sql_splits_at_every_blank_of_the_contract(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(1, "a\rb\x0bc", "s"), (2, "d\x0ce\tf g\nh", "s"), (3, "i-j", "t"), (4, "\x00 \x1f", "t")]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}),
                   tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    want = Counter(con.execute(f"SELECT doc_id, size, source_size, taken FROM ({OP6_SQL})").fetchall())
    got = rows_of(Q["op6_pareto_mix"](spark, str(tmp_path)), "doc_id", "size", "source_size", "taken")
    assert got == want and {k[:2] for k in got} == {(1, 3), (2, 5), (3, 1), (4, 2)}


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


def test_op1_rules_and_walk(spark, small):
    got = {r["page_id"]: r for r in Q["op1_link_trust"](spark, small[0]).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("shop.example.com", "/x", "com/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/en/", "block")
    assert (got[3]["rule"], got[3]["verdict"]) == ("www.example.com/en/", "allow")
    assert (got[4]["rule"], got[4]["verdict"]) == ("net/es/", "block")
    assert (got[5]["host"], got[5]["path"], got[5]["rule"], got[5]["verdict"]) == ("", "", None, "allow")
    assert got[6]["host"] == "" and got[10]["host"] == "com" and got[10]["path"] == "" and got[10]["rule"] is None
    assert got[7]["verdict"] == "allow" and got[7]["trust"] > 0  # linked from a trusted shop
    assert got[8]["verdict"] == "block" and got[8]["distrust"] > 0  # links to a bad host
    assert got[9]["verdict"] == "block" and got[9]["rule"] is None


def test_op1_walk_matches_power_iteration(spark):
    from gleaner.llm.url_filter import propagate

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 3), ("c", "e", 1)]
    seeds = spark.createDataFrame([("trust", "a", 2.0), ("trust", "d", 1.0)], "walk string, host string, weight double")
    e = spark.createDataFrame([("trust", *x) for x in edges], "walk string, src string, dst string, n long")
    got = {r["host"]: r["mass"] for r in propagate(seeds, e, tolerance=1e-10, max_iterations=200).collect()}
    nodes, v = "abcde", {"a": 2 / 3, "d": 1 / 3}
    x = {n: v.get(n, 0.0) for n in nodes}
    out = Counter()
    for s, _, n in edges:
        out[s] += n
    for _ in range(300):  # mass of hosts without links goes back to the seeds
        lost = sum(x[n] for n in nodes if not out[n])
        x = {n: (0.15 + 0.85 * lost) * v.get(n, 0.0) + 0.85 * sum(x[s] * k / out[s] for s, d, k in edges if d == n) for n in nodes}
    assert all(abs(got.get(n, 0.0) - x[n]) < 1e-6 for n in nodes)


def test_op1_walk_has_no_round_limit(spark):
    from gleaner.llm.url_filter import propagate, url_verdicts

    n = 60
    page = lambda i: f'<a href="http://h{i}.test/">' if i <= n else ""
    pages = spark.createDataFrame([(i, f"http://h{i}.test/", page(i + 1)) for i in range(n + 1)]
                                  + [(900, "http://alone.test/", "")], "page_id long, url string, html string")
    rules = spark.createDataFrame([(f"h{n}.test", "/", "block")], "rule_host string, rule_path string, verdict string")
    got = {r["page_id"]: r for r in url_verdicts(pages, rules).collect()}
    assert all(got[i]["verdict"] == "block" and got[i]["distrust"] > 0 for i in range(n + 1))
    assert got[900]["verdict"] == "allow"
    want = [0.85 ** (n - i) for i in range(n + 1)]
    assert all(abs(got[i]["distrust"] - w / sum(want)) < 1e-6 for i, w in enumerate(want))

    seeds = spark.createDataFrame([("trust", "a", 1.0)], "walk string, host string, weight double")
    loop = spark.createDataFrame([("trust", "a", "b", 1), ("trust", "b", "a", 1)], "walk string, src string, dst string, n long")
    with pytest.raises(RuntimeError):
        propagate(seeds, loop, max_iterations=40)


def test_op2_base(spark, small):
    got = rows_of(Q["op2_sanitise"](spark, small[0]), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == Counter((i, *B.patterns(t, B.PII, False)) for i, t, *_ in small[1])


def test_op2_discloses(spark):
    from gleaner.llm.pii import personal_data, sanitised

    rows = [(i, f"note {'xyzw'[i % 4]}qq{chr(97 + i)}rs from Zanthor boss@corp.example.com today fine") for i in range(12)]
    rows += [(20 + i, "plain words from today fine and note more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data(docs).collect()}
    for i, t in rows[:12]:
        marked = {t[s["start"]:s["stop"]] for s in got[i]["added"]}
        assert "Zanthor" in marked and "today" not in marked
        assert "Zanthor" not in sanitised(t, got[i]["base"], got[i]["added"])
    assert all(not got[i]["added"] for i, _ in rows[12:])


def test_op2_discloses_with_copies(spark):
    from gleaner.llm.pii import disclosing_terms, personal_data, scan

    one = [f"note {'xyzw'[i % 4]}qq{chr(97 + i)}rs from Zanthor boss@corp.example.com today Zanthor fine" for i in range(12)]
    one.append("Zanthor boss@corp.example.com and Zanthor boss@corp.example.com")  # beside both: counted once
    rows = [(100 * i + k, t) for i, t in enumerate(one) for k in range(20)]
    rows += [(10_000 + i, "plain words from today fine and note more") for i in range(40 * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data(docs).collect()}
    for i, t in rows[:260]:
        marked = [t[s["start"]:s["stop"]] for s in got[i]["added"]]
        assert marked.count("Zanthor") == 2 and "today" not in marked

    # Half of its occurrences stand far from the entity: p is a half, not more or less.
    far = [(i, f"Zanthor qq{chr(97 + i % 4)}rs boss@corp.example.com" + " .. " * 40 + "Zanthor") for i in range(40)]
    docs = spark.createDataFrame(far + [(90, "a@b.example.com")], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "xxhash64(text) text_hash", "text")
    terms = {r["term"]: r for r in disclosing_terms(rows, scan(rows), generalise_at=-9.0).collect()}
    import math
    assert abs(terms["zanthor"]["disclosure"] - (1 - math.log(1 / 2) / math.log(4 / 6))) < 1e-9


def test_op3(spark, small):
    got = rows_of(Q["op3_positional_index"](spark, small[0]), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == Counter(B.contaminated([(i, t) for i, t, *_ in small[1]], small[2]))


def test_op3_blocks_segments_and_proximity(spark, small):
    from pyspark.sql import functions as F

    from gleaner.llm.decontaminate import build_index, item_windows, search

    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    phrases = item_windows(spark.read.parquet(f"{small[0]}/benchmark.parquet"))

    def hits(segment, block):
        i = build_index(docs, segment_words=segment)
        ids = i.select("segment", F.posexplode("doc_ids").alias("nth", "doc_id"))
        found = search(i, phrases, block_phrases=block).join(ids, ["segment", "nth"])
        return Counter((r["doc_id"], tuple(sorted(set((s["start"], s["stop"]) for s in r["spans"])))) for r in found.collect())

    assert hits(100, 3) == hits(500_000, 50_000)

    near = spark.createDataFrame([(1, ["oak", "elm", "oak"])], "item_id long, words array<string>")
    texts = ["elm x oak y oak z", "oak elm", "oak a b c elm d oak", "oak oak elm"]
    i = build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    ids = i.select("segment", F.posexplode("doc_ids").alias("nth", "doc_id"))
    got = {r["doc_id"]: {(s["start"], s["stop"]) for s in r["spans"]} for r in search(i, near, slop=2).join(ids, ["segment", "nth"]).collect()}
    want = {}
    for k, t in enumerate(texts):
        w = t.split()
        ok = lambda a, z: Counter(w[a:z])["oak"] >= 2 and Counter(w[a:z])["elm"] >= 1
        s = {(a, z) for a in range(len(w)) for z in range(a + 1, min(len(w), a + 5) + 1) if ok(a, z)}
        s = {(a, z) for a, z in s if not ok(a + 1, z) and not ok(a, z - 1)}
        if s:
            want[k] = s
    assert got == want


def test_op4_learns_misspellings(spark):
    import random

    from gleaner.llm.toxicity import toxicity_scores

    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 3 == 0:  # a stem with ever new endings
            for _ in range(3):
                w[rng.randrange(40)] = "grumbu" + "".join(rng.choice("xyzkq") for _ in range(3))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000, None), (1001, ""), (None, "abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    right = sum((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held) / len(held)
    assert right >= 0.9


def test_op4_scores_and_gradient():
    """Probabilities against plain Python over the n-grams of each word, and the
    gradient by bucket against finite differences of the loss."""
    import math

    import numpy as np
    import pyarrow as pa

    from gleaner.llm import toxicity as T

    texts = ["ab Abc abc dé", "", "x", "longerword ab ab", "zzz zzzz"]
    rng = np.random.default_rng(1)
    weight = rng.normal(0, 1, T.BUCKETS)

    def grams(word):
        w = "\n" + word + "\n"
        return [w[a:a + n] for n in T.GRAMS for a in range(len(w) - n + 1)]

    def one(word):
        buckets, _ = T.word_grams(pa.array([word.encode()]))
        assert len(buckets) == len(grams(word)), word
        return sum(weight[b] for b in buckets) / max(len(buckets), 1)

    # The same n-gram has one bucket wherever it stands, in words known and unknown.
    a, b = (T.word_grams(pa.array([w]))[0].tolist() for w in (b"xabcy", b"zabcw"))
    assert set(a) & set(b)
    got = T.probabilities([t.encode() for t in texts], weight, 0.3)
    for t, p in zip(texts, got):
        ws = B.words(t.translate(B.LOW))
        logit = (sum(map(one, ws)) / len(ws) if ws else 0.0) + 0.3
        assert abs(p - 1 / (1 + math.exp(-logit))) < 1e-9
    bags = T._Bags([t.encode() for t in texts])
    toxic = np.array([1, 0, 1, 0, 1.0])

    def loss(w):
        z = bags.logits(w, 0.3)
        return float((np.log1p(np.exp(z)) - toxic * z).sum())

    grad = bags.back(1 / (1 + np.exp(-bags.logits(weight, 0.3))) - toxic)
    for bucket in sorted(set(bags.grams.tolist())):
        step = np.zeros(T.BUCKETS)
        step[bucket] = 1e-5
        assert abs((loss(weight + step) - loss(weight - step)) / 2e-5 - grad[bucket]) < 1e-6


def test_op5(spark, small):
    rows = Q["op5_decoding_worklist"](spark, small[0])
    got = rows_of(rows, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert got == Counter((i, *B.patterns(t, B.SECRETS, True)) for i, t, *_ in small[1])
    spans = {r["doc_id"]: r["spans"] for r in rows.collect()}
    text = {r[0]: r[1] for r in small[1]}
    blob = text[49].split()[1]
    assert any(s.startswith("base64/assign:4:") and int(s.split(":")[2]) <= 4 + len(blob) for s in spans[49].split(","))
    assert "url/assign:" in spans[50] and "unicode/assign:" in spans[50]
    assert f"base64/zlib/assign:0:{len(text[51])}" in spans[51]


def test_op5_layers():
    import base64

    from gleaner.llm.secrets import find_secrets, redacted

    t = "token=abcdefgh1"
    for _ in range(4):
        t = base64.b64encode(t.encode()).decode()
    spans, over = find_secrets(f"x {t} y")
    assert spans and spans[0][0].startswith("base64/base64/base64/base64") and over == 0
    assert redacted(f"x {t} y").startswith("x [SECRET]")
    assert find_secrets("%2525252520 100%25 sure")[0] == []
    big = base64.b64encode(__import__("zlib").compress(b"0" * 100_000)).decode()
    assert find_secrets(big, limit=1000) == ([("base64/zlib/hex", 0, len(big))], 1)
    assert redacted(None) is None and redacted("") == ""


def test_op5_glued_wrapped_and_members():
    import base64
    import bz2
    import gzip
    import lzma
    import zlib

    from gleaner.llm.secrets import find_secrets, redacted

    enc = lambda b: base64.b64encode(b).decode()
    wrap = lambda t, n, br="\n": br.join(t[i:i + n] for i in range(0, len(t), n))
    blob = enc(b"password: hunter2hunter2")
    for prefix in ("host/cb/", "id-", "id_", "v", "ab", "abc", "abcd", "x/", "a-b_c/"):
        spans, over = find_secrets(f"see {prefix}{blob}, {prefix}{blob}/end")
        at = 4 + len(prefix)
        for a in (at, at + len(blob) + 2 + len(prefix)):
            assert any(k == "base64/assign" and x <= a + 12 and y >= a + len(blob) for k, x, y in spans), prefix
        assert over == 0 and "yMmh1bnRlcj" not in redacted(f"see {prefix}{blob}/end")
    body = b"".join(b"line %d of nothing\n" % i for i in range(9))
    for n in (64, 76):
        for br in ("\n", "\r\n", "\n    "):
            for shift in range(0, 90, 7):  # so that the break falls on every part of the secret
                t = wrap(enc(body[:shift] + b" token=abcdefgh1 " + body), n, br)
                assert any(k == "base64/assign" for k, _, _ in find_secrets(t)[0])
    noise = b"".join(zlib.crc32(b"%d" % i).to_bytes(4, "big").hex().encode() + b"\n" for i in range(400))
    for kind, pack in (("gzip", gzip.compress), ("bzip2", bz2.compress), ("xz", lzma.compress), ("zlib", zlib.compress)):
        t = f"<\n{wrap(enc(pack(noise + b'token=abcdefgh1')), 76)}\n>"
        assert find_secrets(t)[0] == [(f"base64/{kind}/assign", 2, len(t) - 2)]
        two = enc(pack(b"nothing in here") + pack(b"tok") + pack(b"en=abcdefgh1"))
        assert find_secrets(two)[0] == [(f"base64/{kind}/assign", 0, len(two))]
        assert find_secrets(enc(pack(b"-" * 600) + pack(b"-" * 600)), limit=1000) == ([], 1)
        glued = "id-" + enc(pack(pack(b"token=abcdefgh1")))
        assert any(k.endswith("/assign") and (a, z) == (3, len(glued)) for k, a, z in find_secrets(glued)[0])


def test_redacted_masks_oversized():
    import base64
    import zlib

    from gleaner.llm.secrets import find_secrets, redacted

    big = base64.b64encode(zlib.compress(b"-" * 5000 + b"token=abcdefgh1")).decode()
    text = f"see {big}, then {big} end"
    at = [(4, 4 + len(big)), (11 + len(big), 11 + 2 * len(big))]
    assert find_secrets(text, limit=1000) == ([("base64/zlib/assign", a, z) for a, z in at], 2)
    assert redacted(text, limit=1000) == "see [SECRET], then [SECRET] end"
    assert redacted(f"%41 {big}.", limit=1000) == "%41 [SECRET]."


def test_op5_layers_read_in_windows(monkeypatch):
    """A layer far over the limit is read to its end, a secret on a window's edge and packed data inside found."""
    import base64
    import bz2
    import gzip
    import lzma
    import zlib

    from gleaner.llm import secrets

    monkeypatch.setattr(secrets, "WINDOW", 4096)
    monkeypatch.setattr(secrets, "OVERLAP", 512)
    secret = b'password="hunter2hunter2"'
    for pack, kind in ((gzip.compress, "gzip"), (zlib.compress, "zlib"), (bz2.compress, "bzip2"), (lzma.compress, "xz")):
        for at in (0, 4090, 4100, 8190, 20_000, 39_900):
            body = bytearray(b"lorem ipsum dolor " * 2300)[:40_000]
            body[at:at + len(secret)] = secret
            t = base64.b64encode(pack(bytes(body[:15_000])) + pack(bytes(body[15_000:]))).decode()
            found, over = secrets.find_secrets(f"x {t} y", limit=1000)
            assert (f"base64/{kind}/assign", 2, 2 + len(t)) in found and over >= 1, (kind, at)
        inner = pack(b"x " * 90_000 + base64.b64encode(gzip.compress(secret)) + b" " + gzip.compress(b"api_key: other99"))
        found, _ = secrets.find_secrets(base64.b64encode(inner).decode(), limit=1000)
        assert {f"base64/{kind}/base64/gzip/assign", f"base64/{kind}/gzip/assign"} <= {k for k, _, _ in found}


def test_op5_unicode_forms():
    from gleaner.llm.secrets import find_secrets

    for text in (r"\U00000074oken=qqqqqqq", r"\u{74}oken=qqqqqqq", "&#X74;oken=qqqqqqq", "&#116;oken=qqqqqqq"):
        assert find_secrets(text) == ([("unicode/assign", 0, len(text))], 0)


def test_op5_repeated_blob():
    import base64

    from gleaner.llm.secrets import find_secrets, redacted

    blob = base64.b64encode(b"password: hunter2hunter2").decode()
    spans, _ = find_secrets(f"x {blob} y {blob}")
    n = len(blob)
    assert [(a, z) for _, a, z in spans] == [(2, 2 + n), (5 + n, 5 + 2 * n)]
    assert redacted(f"x {blob} y {blob}") == "x [SECRET] y [SECRET]"
    assert redacted(f"%41 {blob},\n{blob}.") == "%41 [SECRET],\n[SECRET]."
    assert redacted(f"%41 {blob}\n{blob}.") == "%41 [SECRET]."  # may be one wrapped value


def test_op6(spark, small):
    got = Q["op6_pareto_mix"](spark, small[0]).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small[0]}/documents.parquet'")
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    want = Counter(map(key, con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({OP6_SQL})").fetchall()))
    assert Counter(key((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in got) == want
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_op6_weights_and_bins(spark):
    from gleaner.llm.mixing import mix

    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 2}", 1.0 + 3 * (i % 4 == 0)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    for bins in (2, 64):
        got = mix(docs, weights=(1, 9), total_share=0.5, weight_col="weight", bins=bins).collect()
        for s in ("s0", "s1"):
            part = [r for r in got if r["row"]["source"] == s]
            assert abs(sum(r["copies"] * r["size"] for r in part) - part[0]["target"]) <= 23
    heavy = [r["copies"] for r in got if r["row"]["weight"] > 1 and r["row"]["source"] == "s0"]
    light = [r["copies"] for r in got if r["row"]["weight"] == 1 and r["row"]["source"] == "s0"]
    assert sum(heavy) / len(heavy) > 2 * sum(light) / len(light)


def test_op7(spark, small):
    from gleaner.llm.substring_dedup import substring_dedup
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t, *_ in small[1]]
    want = Counter(B.repeated(rows))
    assert rows_of(Q["op7_substring_dedup"](spark, small[0]), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    tight = substring_dedup(docs, cells=1 << 16).withColumn("s", F.sha2(F.col("kept").cast("binary"), 256))
    assert rows_of(tight, "doc_id", "n_words", "n_removed", "s") == want  # a crowded sketch loses nothing


def test_op8(spark, small):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = Q["op8_risk_controlled"](spark, small[0])
    assert rows_of(got, *cols) == Counter((i, *B.quality(t)) for i, t, *_ in small[1])
    assert all(not r["kept"] for r in got.collect() if r["base_failed"])


def test_op8_binomial_and_cutoffs(spark):
    from math import comb

    from gleaner.llm._common import staged
    from gleaner.llm.quality import binomial_at_most, certified_cutoffs, with_features
    from pyspark.sql import functions as F

    cases = [(x, n) for n in (1, 10, 500, 4000) for x in (0, 1, 3, 20) if x <= n]
    got = spark.createDataFrame(cases, "x int, n int").select("x", "n", binomial_at_most(F.col("x"), F.col("n"), 0.01).alias("p")).collect()
    for r in got:
        exact = sum(comb(r["n"], k) * 0.01 ** k * 0.99 ** (r["n"] - k) for k in range(r["x"] + 1))
        assert abs(r["p"] - (exact if r["x"] < 0.01 * r["n"] else 1.0)) < 1e-9
    good = " ".join(f"word{i}" for i in range(70))
    rows = [(i, good + (" ###" * 60 if i % 500 == 0 else "")) for i in range(4000)]
    f = with_features(spark.createDataFrame(rows, "q_id long, t string").withColumn("stratum", F.lit("s")), "t").drop("t")
    labels = spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id long, quality int")
    f = staged(f, "features")  # as the operator does: its features are columns, not expressions
    cuts = {r["rule"]: r["cutoff"] for r in certified_cutoffs(f, labels).collect()}
    assert cuts["symbols"] == 0.01  # 8 of 4000 good ones over it is surely below the share allowed
    few = certified_cutoffs(f.where("q_id < 50"), labels).collect()
    assert few == []  # too few labels certify nothing


def test_op9(spark, small):
    got = {}
    for r in Q["op9_log_bilinear"](spark, small[0]).collect():
        got.setdefault((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), []).append(r["base_score"])
    want = {}
    for i, h, n, k, total, s in B.unigram([(i, t) for i, t, *_ in small[1]]):
        want.setdefault((i, h, n, k, total), []).append(s)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-6 for k in want for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True))


def _softmax(xs):
    import math

    top = max(xs)
    total = sum(math.exp(x - top) for x in xs)
    return [math.exp(x - top) / total for x in xs]


def test_op9_score_follows_the_model(spark, small):
    """Every score recomputed in plain Python from the parameters, with softmaxes written out."""
    import math
    import zlib

    from pyspark.sql import functions as F

    from gleaner.llm import lm_score as L

    rows = [(i, t) for i, t, *_ in small[1]]
    words = [[w.encode() for w in B.words((t or "").translate(B.LOW))] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = (docs.where(L.id_remainder(F.col("doc_id"), 7) != 2).withColumn("share", F.xxhash64("doc_id", "text")))
    learned = L.learn(train, head=20, own=60)
    vocabulary, m, layer = learned.vocabulary, learned.model, learned.layer
    named = vocabulary.words.to_pylist()
    assert len(named) == min(len(count), 60)
    place = {w: k for k, w in enumerate(named)}
    classes = {w: 1 + k for k, w in enumerate(named[:vocabulary.head])}
    tail_of = lambda w: zlib.crc32(w[-3:]) % L.TAIL_CLASSES
    cls = lambda w: classes.get(w, vocabulary.first_tail + tail_of(w))
    assert any(vocabulary.slot_of >= 0), "some words outside the head have vectors"
    rest = {}
    for w, n in count.items():
        if w not in place:
            rest[tail_of(w)] = rest.get(tail_of(w), 0) + n + 1
    assert rest, "some known words have none"
    cache = {}

    def token(one, two, w):
        if (one, two) not in cache:
            ctx = m.R[one].astype(float) * m.c[0] + m.R[two].astype(float) * m.c[1]
            cache[one, two] = _softmax((m.Q.astype(float) @ ctx + m.bias).tolist())
        if w is None:
            return cache[one, two][0]
        p = cache[one, two][cls(w)]
        if w in classes:
            return p
        k = tail_of(w)
        a, b = vocabulary.first[k], vocabulary.first[k + 1]
        inside = _softmax((layer.Q[a:b, :-1].astype(float) @ layer.U[one].astype(float) + layer.Q[a:b, -1]).tolist())
        if w in place:
            return p * inside[vocabulary.slot_of[place[w]] - a]
        return p * inside[0] * (count[w] + 1) / (rest.get(k, 0) + 1)

    want = {}
    for (i, _), ws in zip(rows, words):
        one = two = 0
        total = 0.0
        for w in [*ws, None]:
            total += math.log10(token(one, two, w))
            one, two = (cls(w) if w is not None else 0), one
        want.setdefault((i, len(ws) + 1), []).append(total)
    got = {}
    for r in L.lm_scores(docs, learned=learned).collect():
        got.setdefault((r["doc_id"], r["n_tokens"]), []).append(r["score"])
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert abs(a - b) <= 1e-4 * k[1] + 1e-6, (k, a, b)


def test_op9_word_layer():
    """Inside every class the slots' probabilities sum to one, and training learns
    which word of a class follows which class."""
    import numpy as np

    from gleaner.llm import lm_score as L

    vocabulary = L.Vocabulary([f"w{i}abc".encode() for i in range(6)] + [f"v{i}xyz".encode() for i in range(9)], head=3, tails=2)
    assert vocabulary.first[-1] == 2 + 12 and len(set(vocabulary.slot_of[3:])) == 12
    classes, slots = vocabulary.of(vocabulary.words)
    assert (classes == vocabulary.class_of).all() and (slots == vocabulary.slot_of).all()
    layer = L.WordLayer(vocabulary, np.ones(14), dim=8)
    rng = np.random.default_rng(3)
    one = rng.integers(0, 4, 6000)
    tail = np.full(6000, classes[-1] - vocabulary.first_tail)
    members = np.arange(vocabulary.first[tail[0]], vocabulary.first[tail[0] + 1])
    slot = members[one % len(members)]
    before = layer.log_p(layer.log_norm(), one, tail, slot).mean()
    squares = None
    for _ in range(8):
        squares = layer.train(one, tail, slot, rng, rate=0.3, squares=squares)
    norm = layer.log_norm()
    assert layer.log_p(norm, one, tail, slot).mean() > before + 0.5
    for i in range(vocabulary.size):
        for k in range(2):
            every = np.arange(vocabulary.first[k], vocabulary.first[k + 1])
            p = np.exp(layer.log_p(norm, np.full(len(every), i), np.full(len(every), k), every))
            assert abs(p.sum() - 1) < 1e-4


def test_op9_vocabulary_grows():
    from gleaner.llm.lm_score import own_words

    sizes = [own_words(n) for n in (0, 4 * 10**5, 4 * 10**6, 10**8, 10**13)]
    assert sizes == sorted(set(sizes)) and sizes[-1] < 4 * 10**6


def test_op9_probabilities_sum_to_one():
    import numpy as np

    from gleaner.llm.lm_score import Model

    rng = np.random.default_rng(0)
    m = Model(np.full(12, 1 / 12), dim=4)
    one, two = rng.integers(0, 12, 4000), rng.integers(0, 12, 4000)
    target = (one + 1) % 12
    before = _loss(m, one, two, target)
    for _ in range(5):
        m.train(one, two, target, np.full(12, 1 / 12), rng, noise=16)
    assert _loss(m, one, two, target) < before - 0.5
    a, b, z = m.log_tables(block=5)
    assert np.allclose(np.exp(a[:, None, :] + b[None, :, :] - z[:, :, None]).sum(axis=2), 1, atol=1e-4)


def _loss(m, one, two, target):
    a, b, z = m.log_tables()
    return -(a[one, target] + b[two, target] - z[one, two]).mean()


def test_op10(spark, small):
    from gleaner.llm.simhash import fingerprints, links
    from gleaner.llm._common import connected_components

    rows = [(i, t) for i, t, *_ in small[1]]
    prints = [B.fingerprint(t) for _, t in rows]
    comp = B.components(prints)
    lowest = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            lowest[c] = min(lowest.get(c, i), i)
    want = Counter((i, f"{p:016x}", lowest.get(c)) for (i, _), p, c in zip(rows, prints, comp))
    assert rows_of(Q["op10_simhash"](spark, small[0]), "doc_id", "fingerprint", "component_id") == want
    # Crowded cells cut into parts give the same components.
    fps = fingerprints(spark.read.parquet(f"{small[0]}/documents.parquet")).select("fp").distinct()
    whole, parts = (Counter(map(tuple, connected_components(links(fps, part=p)).collect())) for p in (4096, 2))
    assert whole == parts


def test_links_lose_none_on_dense_fingerprints(spark):
    import random

    from gleaner.llm._common import connected_components
    from gleaner.llm.simhash import links

    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    comp = B.components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    # One grid with parts, and a second grid inside every cell of two parts or more.
    for how in ({}, {"part": 1, "grid_parts": 1}, {"part": 4, "grid_parts": 1}):
        got = {r["node"]: r["root"] for r in connected_components(links(fps, **how)).collect()}
        assert all(got.get(s, s) == signed[c] for s, c in zip(signed, comp)), how
