"""Replies and responses that are not what they should be."""

from __future__ import annotations

from gleaner.operators.infer import call_batch
from gleaner.sources.registry import classify_fetch, fetch_result


class _Fixed:
    def __init__(self, name, replies):
        self.name, self.replies = name, replies

    def generate_batch(self, systems, users):
        return [self.replies[u] for u in users]


def test_reply_that_is_no_string_goes_to_the_next_backend():
    first = _Fixed("first", {"p": 7, "q": "fine"})
    second = _Fixed("second", {"p": "rescued"})
    assert call_batch([first, second], [None, None], ["p", "q"]) == [("rescued", "second", None), ("fine", "first", None)]
    reply, backend, error = call_batch([first], [None], ["p"])[0]
    assert reply is None and backend is None and "int" in error


def test_no_response_is_tried_again(spark):
    rows = [("u", 0, None, None), ("u", 1, 200, "body"), ("v", 0, None, None)]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, body string")
    assert {r["outcome"] for r in classify_fetch(df).collect() if r["status"] is None} == {"retry"}
    got = {r["url"]: (r["body"], r["outcome"]) for r in fetch_result(df).collect()}
    assert got == {"u": ("body", "ok"), "v": (None, "exhausted")}
