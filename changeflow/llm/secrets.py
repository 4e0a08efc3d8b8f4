"""Secret scans through nested encodings.

A text is scanned for the base kinds. Then a worklist unwraps what may be encoded in it: percent
escapes, Unicode and character escapes, base64 and compressed bytes, and puts each decoded layer
back on the list until nothing new comes out. Every character of a layer knows which span of the
whole text it came from, so a secret found ten layers down is reported where it stands.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Generator, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import per_row, ready, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{32,}")
SHORTEST = {"assign": 8, "access": 16, "hex": 32}
#: Compressed bytes are held opened up to this many times their size, which no deflate stream exceeds;
#: what another format opens to beyond that is scanned in pieces of that size, each with the end of the
#: one before (a decompression bomb must not take the worker).
GROWTH, FLOOR, OVERLAP = 1100, 1 << 20, 1 << 16
#: Bytes that come out of a decompressor at once.
CHUNK = 1 << 20

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HEX_DIGITS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
BASE64 = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_" else 32 for b in range(256))

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|apos|amp|lt|gt|equals|colon|lowbar|period|sol);")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BLOB = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*"
    r"(?P<tail>[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?![A-Za-z0-9+/_-]))?(?:(?:[ \t]*\r?\n[ \t]*)?={1,2})?"
)
#: Where a run may be cut, and after which cuts text, a mark of UTF-16 or compressed bytes may begin: a first
#: character of more than 61 gives no byte of UTF-8.
SIGN, OPENING = re.compile("[/_-]"), re.compile("[/_-](?=[^/_+-]|[/_](?:[/_]4|v8|Td6))")
#: Text inside bytes: shorter than any secret with its name.
STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
HEX_BLOB = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Za-z])")


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base kinds in one text: leftmost, non-overlapping per kind, by start."""
    found: list[tuple[int, int, int]] = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(w.encode() in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= SHORTEST["assign"]:
                found.append((m.start(), 0, m.end()))
    if b"AKIA" in raw:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= SHORTEST["access"]:
                found.append((m.start(), 1, m.end()))
    if b"x" * SHORTEST["hex"] in raw.translate(HEX_DIGITS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


class Layer:
    """A decoded text whose characters map to spans of the text it was found in.

    ``cuts`` are starts of runs in this layer; a run is either copied character by character
    (``step`` 1) or stands as a whole for the span ``begins[i]`` to ``ends[i]``.
    """

    def __init__(self, text: str, cuts: list[int], begins: list[int], ends: list[int], copied: list[bool], parent: Layer | None):
        self.text, self.cuts, self.begins, self.ends, self.copied, self.parent = text, cuts, begins, ends, copied, parent

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the whole text that characters ``start`` to ``end`` of this layer stand for."""
        layer: Layer | None = self
        while layer is not None and layer.cuts:
            a = bisect.bisect_right(layer.cuts, start) - 1
            b = bisect.bisect_right(layer.cuts, end - 1) - 1
            start = layer.begins[a] + (start - layer.cuts[a] if layer.copied[a] else 0)
            end = layer.begins[b] + (end - layer.cuts[b]) if layer.copied[b] else layer.ends[b]
            layer = layer.parent
        return start, end


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every escape run replaced by what it stands for; None if there is none."""
    parts, cuts, begins, ends, copied, at, size = [], [], [], [], [], 0, 0

    def add(text: str, begin: int, end: int, copy: bool) -> None:
        nonlocal size
        if text:
            for values, v in zip((parts, cuts, begins, ends, copied), (text, size, begin, end, copy), strict=True):
                values.append(v)
            size += len(text)

    for m in pattern.finditer(layer.text):
        for text, a, b in decode(m):
            add(layer.text[at:a], at, a, True)
            add(text, a, b, False)
            at = b
    if not at:
        return None
    add(layer.text[at:], at, len(layer.text), True)
    return Layer("".join(parts), cuts, begins, ends, copied, layer)


def _percent(m: re.Match) -> Iterator[tuple[str, int, int]]:
    text = bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace")
    if text.isascii():
        yield from ((c, m.start() + 3 * i, m.start() + 3 * i + 3) for i, c in enumerate(text))
    else:
        yield text, m.start(), m.end()


def _unicode(m: re.Match) -> Iterator[tuple[str, int, int]]:
    for one in ONE_ESCAPE.finditer(m[0]):
        point = int(next(g for g in one.groups() if g), 16)
        if point < 0x110000 and not 0xD800 <= point < 0xE000:
            yield chr(point), m.start() + one.start(), m.start() + one.end()


def _entity(m: re.Match) -> Iterator[tuple[str, int, int]]:
    yield html.unescape(m[0]), m.start(), m.end()


def _kind(data: bytes) -> str:
    """The compression that bytes begin with, if any."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    starts = {"bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
    return next((k for k, start in starts.items() if data.startswith(start)), "")


def _member(data: bytes, kind: str) -> Generator[bytes, None, bytes]:
    """What the first member opens to, in chunks; returns the bytes after it."""
    if kind == "zstd":
        import zstandard

        opener, at = zstandard.ZstdDecompressor(max_window_size=1 << 24).decompressobj(), 0
        while at < len(data) and not opener.eof:
            yield opener.decompress(data[at : at + 256])
            at += 256
        return opener.unused_data + data[at:] if opener.eof else b""
    if kind in ("gzip", "zlib"):
        opener = zlib.decompressobj(31 if kind == "gzip" else 15)
        more = opener.decompress(data, CHUNK)
        while more:
            yield more
            more = b"" if opener.eof else opener.decompress(opener.unconsumed_tail, CHUNK)
        return opener.unused_data
    opener = bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor(memlimit=1 << 27)
    more = opener.decompress(data, CHUNK)
    while more:
        yield more
        more = b"" if opener.eof or opener.needs_input else opener.decompress(b"", CHUNK)
    return opener.unused_data if opener.eof else b""


def _members(data: bytes, kind: str, left: list[bytes]) -> Iterator[bytes]:
    """What all members of one kind open to; ``left`` receives what follows them or can't be opened."""
    while data and _kind(data) == kind:
        try:
            data = (yield from _member(data, kind)).lstrip(b"\0")
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            break
        except Exception as error:  # zstandard's own error type
            if type(error).__name__ != "ZstdError":
                raise
            break
    if data:
        left.append(data)


def _opened(data: bytes) -> Iterator[bytes]:
    """Bytes with every compression unwrapped; very large ones in overlapping pieces.

    Compression within compression is opened in the first piece.
    """
    kind = _kind(data)
    if not kind:
        yield data
        return
    limit = max(FLOOR, GROWTH * len(data))
    held, left, first = bytearray(), [], True
    for chunk in _members(data, kind, left):
        held += chunk
        if len(held) >= limit + OVERLAP:
            end, begin = (_whole_until(held, at) for at in (len(held) - 1, len(held) - OVERLAP))
            piece = bytes(held[:end])
            yield from _opened(piece) if first else [piece]
            del held[:begin]
            first = False
    if held:
        yield from _opened(bytes(held)) if first else [bytes(held)]
    for rest in left:
        # Bytes that only looked compressed may be text as they are.
        yield from [rest] if _kind(rest) == kind else _opened(rest)


def _whole_until(data: bytearray, at: int) -> int:
    """The last place up to ``at`` where a character of UTF-8 begins."""
    return next((i for i in range(at, max(at - 4, 0), -1) if data[i] & 0xC0 != 0x80), at)


def _clean(data: bytes) -> str | None:
    """Bytes that are text from end to end, in UTF-8 or marked UTF-16."""
    try:
        text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text) else None


def _readable(data: bytes) -> str | None:
    """What of decoded bytes is text, in UTF-8 or UTF-16; bytes between its stretches become one U+FFFD.

    UTF-16 without a mark is known by its zero bytes. Stretches hold as many characters as the shortest
    secret has, so bytes that are no text give None.
    """
    text = _clean(data)
    if text:
        return text
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        wide = data.decode("utf-16", "replace")
    elif 2 * data[1::2].count(0) > len(data[1::2]):
        wide = data.decode("utf-16-le", "replace")
    elif 2 * data[::2].count(0) > len(data[::2]):
        wide = data.decode("utf-16-be", "replace")
    else:
        return "\ufffd".join(m[0].decode("utf-8", "replace") for m in STRETCH.finditer(data)) or None
    return wide if wide and sum(c.isprintable() or c in "\t\r\n" for c in wide) >= 0.5 * len(wide) else None


def _debased(run: str) -> bytes | None:
    """The bytes of a base64 run of either alphabet; None if it can't be one."""
    joined = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(joined) < 16 or len(joined) % 4 == 1:
        return None
    try:
        return base64.b64decode(joined + "=" * (-len(joined) % 4))
    except binascii.Error:
        return None


def _reach(text: str, begin: int, end: int, data: bytes) -> int:
    """Where a run of base64 must end to be text: no later than what spoils it."""
    try:
        data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError as error:
        most = error.start // 3 * 4 + 8
        return next(islice((i for i in range(begin, end) if not text[i].isspace()), most, None), end)
    return end


def _hopeful(run: str) -> bool:
    """Whether the first characters of a base64 run may begin text or compressed bytes."""
    head = _debased(re.sub(r"\s+", "", run)[:16])
    if head is None or _kind(head) or head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return head is not None
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return 3 * sum(c.isprintable() or c in "\t\r\n" for c in text) >= len(text)


def _shifted(text: str, begin: int, end: int) -> Iterator[tuple[int, str]]:
    """Text in a base64 run that begins anywhere in it: each of the four ways to cut it into fours."""
    for shift in range(4):
        joined = re.sub(r"\s+", "", text[begin + shift : end]).rstrip("=").replace("-", "+").replace("_", "/")
        joined = joined[: len(joined) - (len(joined) % 4 == 1)]
        found = _readable(base64.b64decode(joined + "=" * (-len(joined) % 4)))
        if found:
            yield begin + shift, found


def _blobs(layer: Layer) -> Iterator[Layer]:
    """What base64 or hexadecimal runs of a layer hold, if it is text after all unwrapping."""
    for m in BLOB.finditer(layer.text):
        # The short last line may be a word that follows; what stands before / - _ may be a path.
        last, at = [m.end()] + [m.start("tail")] * (m["tail"] is not None), m.start()
        cuts = [c.start() for c in SIGN.finditer(layer.text, m.start(), last[-1])]
        for begin in [m.start(), *(c.end() for c in OPENING.finditer(layer.text, m.start(), last[-1]))]:
            if begin < at or not _hopeful(layer.text[begin : min(begin + 256, last[-1])]):
                continue
            reach = 1 << 62
            for end in [*last, *(i for i in reversed(cuts) if i >= begin + 16)]:
                if end > reach:
                    continue
                data = _debased(layer.text[begin:end])
                for text in filter(None, map(_readable if data and _kind(data) else _clean, _opened(data) if data else ())):
                    yield Layer(text, [0], [begin], [end], [False], layer)
                    at = end
                if at == end or data and _kind(data):
                    # Compressed bytes open as far as they go, whatever follows them.
                    break
                if data and end not in last[1:]:
                    reach = min(reach, _reach(layer.text, begin, end, data))
        if at == m.start():
            for begin, text in _shifted(layer.text, m.start(), m.end()):
                yield Layer(text, [0], [begin], [m.end()], [False], layer)
    for m in HEX_BLOB.finditer(layer.text):
        for text in filter(None, map(_readable, _opened(bytes.fromhex(m[0])))):
            yield Layer(text, [0], [m.start()], [m.end()], [False], layer)


def _layers(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        yield from filter(None, [_replaced(layer, PERCENT, _percent)])
    if "\\u" in text or "\\x" in text or "\\U" in text:
        yield from filter(None, [_replaced(layer, UNICODE, _unicode)])
    if "&" in text:
        yield from filter(None, [_replaced(layer, ENTITY, _entity)])
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(BASE64):
        yield from _blobs(layer)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def find_secrets(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: ``(kind, start, end)`` in code points of the whole text.

    Layers are worked off until none is new; a layer seen before (decoding in circles, or the
    same blob twice at the same place) is not opened again. Every unwrapping shortens what it
    unwraps, except decompression, which is bounded, so the list ends.
    """
    if not text:
        return [], []
    base = scan(text)
    found = dict.fromkeys(base)
    todo, seen = [_layers(Layer(text, [], [], [], [], None))], {(0, len(text), _digest(text))}
    while todo:
        # Depth first, so that pieces of one large layer are not all held at a time.
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        mark = (*layer.origin(0, len(layer.text)), _digest(layer.text))
        if layer.text and mark not in seen:
            seen.add(mark)
            todo.append(_layers(layer))
            for kind, a, b in scan(layer.text):
                found.setdefault((kind, *layer.origin(a, b)))
    covered = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}

    def plain(kind: str, a: int, b: int) -> bool:
        """Whether a decoded span only repeats a base span or a part of one."""
        spans = covered[kind]
        i = bisect.bisect_right(spans, (a, 1 << 62)) - 1
        return i >= 0 and spans[i][1] >= b and (a, b) != spans[i]

    every = [s for s in found if s in set(base) or not plain(*s)]
    return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str | None) -> str | None:
    """The text with every secret's span replaced by a mark that names its kind."""
    if not text:
        return text
    _, spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)`` per row, spans as arrays of ``(kind, start, end)``.

    Null and empty texts have none; repeated rows and null ids stay rows of their own; no rows
    give no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("base", span), ("spans", span)])
    ddl = ", ".join(["id long"] + [f"{n} array<struct<kind: string, start: long, end: long>>" for n in ("base", "spans")])

    def make():
        def one(doc_id, text):
            return doc_id, *([dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in find_secrets(text))

        return one

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return per_row(picked, ["id", "text"], schema, ddl, make)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the text replaced, the length column kept true if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            field, texts = batch.schema.field(at), batch.column(at).to_pylist()
            fresh = [redacted(t) for t in texts]
            batch = batch.set_column(at, field, pa.array(fresh, field.type))
            if length_col in batch.schema.names:
                n = batch.schema.get_field_index(length_col)
                old = batch.column(n).to_pylist()
                same = [o if f is t else len(f) for o, f, t in zip(old, fresh, texts, strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(same, batch.schema.field(n).type))
            yield batch

    ready(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's spans as counts, a digest and text."""
    found = scan_documents(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
