"""Secret scan with a recursive decoding worklist.

A text is scanned, then unwrapped: URL escapes, Unicode escapes, base64 runs and
the compressed data inside them each give a new layer, which is scanned and
unwrapped in turn, until no layer gives a new one. A layer is put on the
worklist once (by its text or a digest of it, and the stretch of the original it came from, so a
blob that repeats counts at every place), so encodings that lead back to
themselves end.
Every layer carries, for each of its characters, the stretch of the original
text it came from; a secret found in a layer is reported at that stretch with
the names of the layers, e.g. ``base64/url/assign``.

Base64 is looked for in every run of its characters, from each of four phases (a
value may be glued to a path or prefix), in the parts between ``-``, ``_`` and
``/``, and in runs joined over line breaks and the blanks beside them. Of the
bytes, all ASCII stretches long enough for a secret are read, and compressed data
is unpacked wherever it starts, all members of it.

Cases: a null or empty text has no span; rows that repeat are scanned row by row;
very long texts are scanned whole. Data that unpacks to more than
``MAX_UNPACKED`` bytes (a decompression bomb) is read window by window, of which two
share more than a secret needs; only compressed data inside such a layer that itself
reaches over several windows is not read to its end. Such layers are counted in
``n_oversized``, and ``redacted`` masks the whole run that holds one. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Bytes of unpacked data that are looked at as a whole; a layer that unpacks to
#: more is read in windows of ``WINDOW`` bytes that share ``OVERLAP`` with the next.
MAX_UNPACKED = 64 << 20
WINDOW = 16 << 20
OVERLAP = 1 << 20
KINDS = ("assign", "access", "hex")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
_ASSIGN = re.compile(r"(%s|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % _EITHER)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
                      r"|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_PART = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
_BREAK = re.compile(r"(?<![ \t\r\n])[ \t]*+[\r\n][ \t\r\n]*+")
_PACKED = {"gzip": rb"\x1f\x8b\x08", "bzip2": rb"BZh[1-9]", "xz": rb"\xfd7zXZ\x00", "zlib": rb"\x78[\x01\x5e\x9c\xda]"}
_MAGIC = re.compile(b"|".join(b"(?P<%s>%s)" % (k.encode(), magic) for k, magic in _PACKED.items()), re.S)
#: Secrets are ASCII and have 12 characters or more (``token=`` and six), encoded ones more.
_ASCII = re.compile(rb"[\t\r\n\x20-\x7e]{12,}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain secrets of one text."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text with the stretch of the original that each character came from: two
    arrays, or two numbers if it is the same for all (unpacked data); ``None`` for
    the original itself."""

    __slots__ = ("text", "frm", "to", "names")

    def __init__(self, text: str, frm, to, names: tuple[str, ...]):
        self.text, self.frm, self.to, self.names = text, frm, to, names

    def span(self, a: int, z: int) -> tuple[int, int]:
        if self.frm is None:
            return a, z
        return (self.frm, self.to) if isinstance(self.frm, int) else (int(self.frm[a:z].min()), int(self.to[a:z].max()))


def _replaced(layer: Layer, found: list, name: str) -> Layer:
    """The layer with matches (start, end, new text) replaced."""
    if isinstance(layer.frm, int):
        cuts = [0, *(x for a, z, _ in found for x in (a, z)), len(layer.text)]
        news = [*(new for _, _, new in found), ""]
        whole = "".join(x for a, z, new in zip(cuts[::2], cuts[1::2], news) for x in (layer.text[a:z], new))
        return Layer(whole, layer.frm, layer.to, layer.names + (name,))
    text, frm, to, at = [], [], [], 0
    src_f = np.arange(len(layer.text)) if layer.frm is None else layer.frm
    src_t = src_f + 1 if layer.frm is None else layer.to
    for a, z, new in found:
        text += [layer.text[at:a], new]
        f, t = layer.span(a, z)
        frm += [src_f[at:a], np.full(len(new), f)]
        to += [src_t[at:a], np.full(len(new), t)]
        at = z
    text.append(layer.text[at:])
    frm.append(src_f[at:])
    to.append(src_t[at:])
    return Layer("".join(text), np.concatenate(frm), np.concatenate(to), layer.names + (name,))


def _char(m: re.Match) -> str:
    u, x, hx, dec, long, braced = m.groups()
    point = int(dec) if dec else int(u or x or hx or long or braced, 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else m.group()


_DECODERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor,
             "xz": lzma.LZMADecompressor}


def _unpack(data, kind: str, limit: int) -> tuple[bytes, int, bool] | None:
    """The bytes of all members that ``data`` starts with, the bytes read and if the
    last member is whole; raises OverflowError beyond ``limit``."""
    new = _DECODERS[kind]
    out, rest, size, ended = [], data, 0, True
    while ended and (not out or re.match(_PACKED[kind], rest, re.S)):
        d = new()
        try:
            part = d.decompress(rest, limit + 1 - size)
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        out.append(part)
        size += len(part)
        if size > limit:
            raise OverflowError
        ended, rest = d.eof, d.unused_data
        if kind in ("gzip", "xz"):  # zeros may stand between members
            rest = rest.lstrip(b"\0")
    return (b"".join(out), len(data) - len(rest), ended) if out else None


def _windows(data, kind: str, read: list[int]) -> Iterator[bytes]:
    """What ``data`` unpacks to, in windows; never more than two of them in memory.
    ``read`` gets the bytes of the whole members read so far."""
    held, rest = b"", data
    while re.match(_PACKED[kind], rest, re.S):
        d = _DECODERS[kind]()
        feed, ended = rest, False
        while not ended:
            try:
                part = d.decompress(feed, WINDOW)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                break
            # zlib hands back what it has not read yet, the others keep it.
            feed = getattr(d, "unconsumed_tail", b"")
            ended = d.eof or not part and not feed
            held += part
            while len(held) >= WINDOW + OVERLAP:
                yield held[:WINDOW + OVERLAP]
                held = held[WINDOW:]
        if not d.eof:
            break
        rest = d.unused_data
        if kind in ("gzip", "xz"):
            rest = bytes(rest).lstrip(b"\0")
        read[0] = len(data) - len(rest)
    if held:
        yield held


def _unpacked(data: bytes, limit: int, above: tuple[bytes, ...] = ()) -> Iterator[tuple]:
    """(kinds, start, stop, bytes, whole) of the compressed data at any place in
    ``data`` and, one in the other, inside it. Data that unpacks to more than
    ``limit`` comes in windows (``whole`` is false)."""
    at = 0
    while m := _MAGIC.search(data, at):
        kind, a = m.lastgroup, m.start()
        at = a + 1
        try:
            got = _unpack(memoryview(data)[a:], kind, limit)
        except OverflowError:
            read = [0]
            for out in _windows(memoryview(data)[a:], kind, read):
                yield (kind,), a, len(data), out, False
                for kinds, _, _, inner, _ in _unpacked(out, limit, (*above, data)):
                    yield (kind, *kinds), a, len(data), inner, False
            at = max(at, a + read[0])
            continue
        if got is None:
            continue
        out, used, ended = got
        if ended:
            at = max(at, a + used)
        if out and out != data and out not in above:  # data may unpack to itself
            yield (kind,), a, a + used, out, True
            for kinds, _, _, inner, whole in _unpacked(out, limit, (*above, data)):
                yield (kind, *kinds), a, a + used, inner, whole


def _ascii(data: bytes) -> tuple[str, list] | None:
    """The long ASCII stretches, parted by NUL, and where they are in ``data``."""
    found = [m.span() for m in _ASCII.finditer(data)]
    return ("\0".join(data[a:z].decode("ascii") for a, z in found), found) if found else None


def _places(found: list, size: int) -> np.ndarray:
    """The place of each character of ``_ascii``'s text in its data."""
    return np.minimum(np.concatenate([np.arange(a, z + 1) for a, z in found])[:-1], size - 1)


def _base64_runs(text: str) -> Iterator[tuple]:
    """(run, phases to decode it from, place in ``text`` of its characters by index)."""
    for m in _BASE64.finditer(text):
        run, start = m.group(), m.start()
        yield run, 4, lambda i, start=start: start + i
        if "-" in run or "_" in run or "/" in run:
            for part in _PART.finditer(run):
                yield part.group(), 1, lambda i, start=start + part.start(): start + i
    breaks = [m.span() for m in _BREAK.finditer(text)] if "\n" in text or "\r" in text else []
    if breaks:
        cut = np.array(breaks)
        gone = np.concatenate(([0], np.cumsum(cut[:, 1] - cut[:, 0])))
        joints = cut[:, 0] - gone[:-1]  # in the joined text
        for m in _BASE64.finditer(_BREAK.sub("", text)):
            nth = np.searchsorted(joints, m.start(), "right")
            if nth < len(joints) and joints[nth] < m.end():
                yield m.group(), 4, lambda i, start=m.start(): start + i + gone[np.searchsorted(joints, start + i, "right")]


def _base64_bytes(run: str, phase: int) -> bytes:
    body = run.rstrip("=")[phase:].replace("-", "+").replace("_", "/")
    body = body[:len(body) - (len(body) % 4 == 1)]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def unwrapped(layer: Layer, limit: int = MAX_UNPACKED) -> Iterator[Layer | tuple[int, int]]:
    """The layers one step below; the original's stretch also for one that is read in windows."""
    text = layer.text
    if "%" in text:
        found = [(m.start(), m.end(), bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "replace"))
                 for m in _URL.finditer(text)]
        if found:
            yield _replaced(layer, found, "url")
    if "\\" in text or "&#" in text:
        found = [(m.start(), m.end(), new) for m in _UNICODE.finditer(text) if (new := _char(m)) != m.group()]
        if found:
            yield _replaced(layer, found, "unicode")
    for run, phases, place in _base64_runs(text):
        for phase in range(phases):
            data = _base64_bytes(run, phase)

            def stretch(first, last):
                """Where bytes come from: each came from a group of four characters."""
                if isinstance(layer.frm, int):
                    return layer.frm, layer.to
                a = place(phase + first // 3 * 4)
                z = place(np.minimum(phase + last // 3 * 4 + 4, len(run)) - 1) + 1
                return (a, z) if layer.frm is None else (layer.frm[a], layer.to[z - 1])

            if plain := _ascii(data):
                at = 0 if isinstance(layer.frm, int) else _places(plain[1], len(data))
                yield Layer(plain[0], *stretch(at, at), layer.names + ("base64",))
            for kinds, a, z, out, whole in _unpacked(data, limit):
                f, t = map(int, stretch(np.int64(a), np.int64(z - 1)))
                if not whole:
                    yield f, t
                if plain := _ascii(out):
                    yield Layer(plain[0], f, t, layer.names + ("base64", *kinds))


def _mark(text: str) -> str | bytes:
    """The text, or a digest of it if it is longer."""
    return text if len(text) <= 64 else blake2b(text.encode("utf-8", "surrogatepass"), digest_size=24).digest()


def find_secrets(text: str, limit: int = MAX_UNPACKED) -> tuple[list[tuple[str, int, int]], int]:
    """All (kind, start, end) of one text, plain ones first, and the number of oversized layers."""
    spans, oversized = _find(text, limit)
    return spans, len(oversized)


def _find(text: str, limit: int) -> tuple[list[tuple[str, int, int]], dict[int, int]]:
    """As ``find_secrets``, with the end by start of the stretches of oversized layers."""
    seen, spans, oversized = set(), {}, {}
    work = [iter([Layer(text, None, None, ())])]  # a layer is finished before the next beside it is made
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
        elif isinstance(new, tuple):
            oversized[new[0]] = max(new[1], oversized.get(new[0], 0))
        elif (key := (_mark(new.text), *new.span(0, len(new.text)))) not in seen:
            seen.add(key)
            for kind, a, z in scan(new.text):
                f, t = new.span(a, z)
                spans.setdefault(("/".join((*new.names, kind)), f, t))
            work.append(unwrapped(new, limit))
    # A secret that a decoded layer only repeats from its surroundings is no new one.
    plain = {(k, a, z) for k, a, z in spans if "/" not in k}
    more = {(k, a, z) for k, a, z in spans if "/" in k and (k.rpartition("/")[2], a, z) not in plain}
    rank = {k: i for i, k in enumerate(KINDS)}
    by_start = lambda s: (s[1], rank[s[0].rpartition("/")[2]], s[0], s[2])
    return sorted(plain, key=by_start) + sorted(more, key=by_start), oversized


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def secret_spans(docs: DataFrame, limit: int = MAX_UNPACKED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, n_oversized) per row; spans count code points, stop exclusive,
    the plain ones first, each group by start."""

    def run(batches):
        for b in batches:
            spans, over = [], []
            for t in b.column(1):
                found, n = find_secrets(t.as_py() or "", limit)
                spans.append([{"kind": k, "start": a, "stop": z} for k, a, z in found])
                over.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS), pa.array(over, pa.int64())],
                                             ["doc_id", "spans", "n_oversized"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, stop: long>>, n_oversized long")


def redacted(text: str | None, limit: int = MAX_UNPACKED, mask: str = "[SECRET]") -> str | None:
    """``text`` with every stretch that a secret came from replaced by ``mask``, and every
    stretch of an oversized layer, which nobody has looked into."""
    found, oversized = _find(text or "", limit)
    spans = sorted([(a, z) for _, a, z in found] + [*oversized.items()])
    if not spans:
        return text
    out, at = [], 0
    for a, z in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, limit: int = MAX_UNPACKED) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars``, where it is, set anew."""
    fields = docs.schema

    def run(batches):
        at = fields.names.index("text")
        for b in batches:
            new = pa.array([redacted(t.as_py(), limit) for t in b.column(at)], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    out = docs.mapInArrow(run, fields)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return out


def op5_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    order = F.transform("spans", lambda s: F.struct(
        s["start"], F.array_position(F.array(*map(F.lit, KINDS)), F.substring_index(s["kind"], "/", -1)).alias("rank"), s["kind"], s["stop"]))
    return found.select("doc_id", *map(n, KINDS), F.sha2(name(base).cast("binary"), 256).alias("base_sha256"),
                        name(F.array_sort(order)).alias("spans"), "n_oversized")
