from __future__ import annotations

import base64
import os
import random
import tempfile
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = ["alder", "birch", "cedar", "elm", "fir", "gum", "hazel", "iris", "juniper", "kelp", "larch", "maple", "nettle",
         "oak", "pine", "quince", "rowan", "sorrel", "thyme", "umbel", "Vetch", "WILLOW", "yew", "zinnia", "é", "ñandú", "—", "#"]


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def small_rows():
    """(doc_id, text, lang, source): nulls, empties, copies, repeats, a long text, ties."""
    rng = random.Random(3)
    passage, bench = _text(rng, 70), _text(rng, 30)
    rows = [(i, _text(rng, rng.choice([1, 2, 9, 60, 200])), rng.choice(["en", "de", None]), rng.choice(["b", "a", "", None]))
            for i in range(40)]
    key = "AKIA" + "Q7" * 9
    rows += [(40, None, "en", "a"), (41, "", None, None), (42, " \n\t ", "en", "a"), (43, rows[3][1], "en", "b"),
             (3, rows[3][1], "en", "b"), (3, _text(rng, 12), "en", "b"), (None, passage, "en", "a"), (None, None, None, None),
             (44, _text(rng, 30) + " " + passage + " " + bench, "en", "a"), (45, passage + "\n" + passage + "\n" + passage, "de", "c"),
             (46, _text(rng, 6000) + " " + passage, "en", "c"),
             (47, f'token = "abcDEF123" x {key} deadbeefdeadbeefdeadbeef0 a@b.example.com', "en", "a"),
             (48, "mail x.y+z@mail.example.org, 10.0.0.1 999.1.1.1 4111 1111 1111 1111 +1 (555) 010-9999 1.2.3.4.5", "en", "a"),
             (49, "see " + base64.b64encode(b'password: hunter2hunter2').decode() + " end", "en", "c"),
             (50, "go token%3D%22zzzzzz99%22 and \\u0074oken=qqqqqqq", "en", "c"),
             (51, base64.b64encode(zlib.compress(f"api_key={key}".encode() * 3)).decode(), "en", "c"),
             (52, "@" * 500 + "a" * 3000 + "@x " + "1" * 300 + "." * 50, "en", "c"),
             (53, "10." + "0" * 5000 + ".0.1 and 0." + "0" * 5000 + "7.0.300", "en", "c"), (54, "a\rb\x0bc\x0c d\te\nf", "en", "b")]
    rows += [(100 + i, passage + f" tail{i % 3}", "en", "hot") for i in range(30)]
    items = [(0, bench), (1, "maple oak"), (2, None), (3, ""), (1, "maple oak"), (None, "yew yew zinnia")]
    return rows, items


def vector_rows():
    """(vec_id, embedding, label): near copies, exact copies, nulls, zeros, other lengths, ties."""
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.12) for x in base[i % 6]], i % 2) for i in range(90)]
    rows += [(100 + i, base[0], 0) for i in range(25)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 64, 0), (203, [float("nan")] + [1.0] * 63, 0),
             (204, [float("inf")] + [1.0] * 63, 1), (205, [None] + [1.0] * 63, 1), (206, base[1], None), (207, base[1][:32], 1),
             (208, base[1][:32], 1), (None, base[1], 1), (None, [3.0] * 64, 7), (3, base[2], 0), (3, base[2], 0),
             (209, [-x for x in base[0]], 0), (210, [2 * x for x in base[0]], 0), (211, [1e-30] * 64, 3), (212, [1e30] * 64, 3)]
    return rows


def write_vectors(folder, rows):
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()),
                             "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                             "label": pa.array([r[2] for r in rows], pa.int32()),
                             "cluster": pa.array(["x"] * len(rows)), "key": pa.array([None] * len(rows), pa.int32()),
                             "rank": pa.array([0] * len(rows))}), f"{folder}/embeddings.parquet")


def write(folder, rows, items, labels, pages):
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]
    cols = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)}
    # Columns whose names clash with results and helpers.
    cols |= {n: pa.array([None] * len(rows), pa.int64()) for n in ("n_chars", "size", "copies", "fp", "row", "n_words", "kept")}
    pq.write_table(pa.table(cols), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}),
                   f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()),
                             "toxic": pa.array([x[2] for x in labels], pa.int32())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()),
                             "html": pa.array([p[2] for p in pages], pa.string()), "verdict": pa.array([1] * len(pages))}), f"{folder}/pages.parquet")


PAGES = [(1, "https://Shop.example.com/x?y", '<a href="http://friend.example.org/a">f</a>'), (2, "http://a.example.com/en/1#t", None),
         (3, "http://www.example.com/en/2", ""), (4, "http://bad.example.net/es/1", "<a href='/local'>l</a>"), (5, None, None),
         (6, "no-scheme", ""), (7, "http://friend.example.org/q", ""), (8, "ftp://lost.example.org", '<a href=//bad.example.net/es/2>b</a>'),
         (9, "http://bad.example.net/en/1", ""), (9, "http://bad.example.net/en/1", ""), (10, "http://com", "")]


@pytest.fixture(scope="session")
def small():
    rows, items = small_rows()
    labels = [(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(60)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    folder = tempfile.mkdtemp(prefix="corpus-small-")
    write(folder, rows, items, labels, PAGES)
    write_vectors(folder, vector_rows())
    return folder, rows, items


@pytest.fixture(scope="session")
def empty():
    folder = tempfile.mkdtemp(prefix="corpus-empty-")
    write(folder, [], [], [], [])
    write_vectors(folder, [])
    assert os.path.exists(f"{folder}/pages.parquet")
    return folder
