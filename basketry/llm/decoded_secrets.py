"""Secrets in whole texts and in whatever is encoded in them.

Every text is a layer. A layer is scanned for secrets and unwrapped: runs of URL escapes and of
Unicode escapes (``\\uXXXX``, ``\\u{...}``, ``\\UXXXXXXXX``, ``\\xXX``, ``&#...;``) are replaced in
their lines, base64 runs are decoded, and bytes that gzip, zlib, bzip2, xz or zstandard wrote are
decompressed. What comes out is a layer of its own on the worklist, until nothing is left to unwrap.
A layer that equals one it came from isn't taken again, so circles end. Each layer knows the place
in the text of every one of its characters, so what is found in it gets the span of the encoded
characters it came from; in what was compressed, that of the whole base64 run.

No pattern holds a line break, so only the lines with an escape go on, and decompressed data is
taken in pieces that end at a line break.

Defined cases: null and empty texts have no secrets; a span that several layers give counts once;
spans of the text itself are the base and stay; repeated rows are judged each; an empty table
gives no rows. Data that isn't text when decoded has no layer. A text whose layers hold more than
``MOST_CHARACTERS`` in all (a decompression bomb) is not unwrapped further, and says so in
``unfinished``; its base is complete.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import io
import lzma
import re
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# fixed values: the kinds in their order, their patterns, and the least length of what counts
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # shorter runs fail as a whole
LEAST_VALUE, LEAST_ACCESS = 8, 16
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

URL = r"(?:%(?:25)*[0-9A-Fa-f]{2})+"  # %25 stands for % itself, so a chain of it unwraps at once
POINT = r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};"
ESCAPE = re.compile(f"{URL}|(?:{POINT})+")
URL_UNIT, POINT_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})"), re.compile(POINT)
BASE64 = re.compile("[A-Za-z0-9+/_-]{16,}={0,2}")
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
#: Characters of all layers of one text; bytes that decompression hands on at a time.
MOST_CHARACTERS, PIECE = 1 << 28, 1 << 22
SPAN = "array<struct<kind:string,start:int,end:int,depth:int>>"


def scanned(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in a text, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()  # may hold more names than the text does, never fewer
    if any(x in low for x in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


@dataclass
class Layer:
    """``starts`` and ``ends``: where in the text each character comes from; None where it is
    the text itself. ``above``: digests of the layers it came from."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    above: frozenset = field(default_factory=frozenset)
    depth: int = 0

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def origins(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (starts, ends) if self.starts is None else (self.starts[starts], self.ends[ends - 1])

    def digest(self) -> bytes:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def unescaped(run: str) -> tuple[str, list[int], list[int]]:
    """A run of escapes as its characters, and the start and end in the run of each."""
    out, starts, ends = [], [], []
    if run[0] == "%":
        units = list(URL_UNIT.finditer(run))
        at = 0
        for c in bytes(int(u[1], 16) for u in units).decode("utf-8", "surrogateescape"):
            size = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
            out.append(c)
            starts.append(units[at].start())
            ends.append(units[at + size - 1].end())
            at += size
        return "".join(out), starts, ends
    for u in POINT_UNIT.finditer(run):
        body = u[0].strip("\\&#;{}uUxX")
        point = int(body, 10 if u[0][:2] == "&#" and u[0][2] not in "xX" else 16)
        low = 0xDC00 <= point < 0xE000 and out and "\ud800" <= out[-1] < "\udc00"
        if low:
            point = 0x10000 + ((ord(out.pop()) - 0xD800) << 10) + point - 0xDC00
            ends.pop()
        else:
            starts.append(u.start())
        out.append(chr(point) if point < 0x110000 else "�")
        ends.append(u.end())
    return "".join(out), starts, ends


def lines_unescaped(layer: Layer):
    """Layers of the lines that hold an escape, as far as they follow one another."""
    text = layer.text
    if "%" not in text and "\\" not in text and "&#" not in text:
        return
    runs = list(ESCAPE.finditer(text))
    k = 0
    while k < len(runs):
        low = text.rfind("\n", 0, runs[k].start()) + 1
        parts, starts, ends, at = [], [], [], low
        while True:  # all runs of the line
            m = runs[k]
            parts.append(text[at : m.start()])
            between = np.arange(at, m.start())
            own, first, last = unescaped(m[0])
            parts.append(own)
            starts += [between, np.array(first, np.int64) + m.start()]
            ends += [between + 1, np.array(last, np.int64) + m.start()]
            at, k = m.end(), k + 1
            if k == len(runs) or "\n" in text[at : runs[k].start()]:
                break
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        rest = np.arange(at, end)
        own = layer.origins(np.concatenate([*starts, rest]).astype(np.int64), np.concatenate([*ends, rest + 1]).astype(np.int64))
        yield "".join([*parts, text[at:end]]), *own


def packing(data: bytes) -> str | None:
    """How the data is compressed, by its first bytes."""
    for name, first in (("gzip", b"\x1f\x8b"), ("bzip2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("zstd", b"\x28\xb5\x2f\xfd")):
        if data.startswith(first):
            return name
    return "zlib" if len(data) > 6 and data[0] & 0x0F == 8 and int.from_bytes(data[:2], "big") % 31 == 0 else None


def pieces(data: bytes, kind: str):
    """Decompressed data, piece by piece. What breaks off gives what came before."""
    try:
        if kind == "zstd":
            import zstandard

            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)) as reader:
                while own := reader.read(PIECE):
                    yield own
        elif kind in ("gzip", "zlib"):
            step = zlib.decompressobj(31 if kind == "gzip" else 15)
            while own := step.decompress(data, PIECE):
                yield own
                data = step.unconsumed_tail
        else:
            step = bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()
            while not step.eof and (own := step.decompress(data, PIECE)):
                yield own
                data = b""
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        pass
    except Exception as e:  # zstandard's own error, whose class is known only where it is installed
        if type(e).__name__ != "ZstdError":
            raise


def as_text(data: bytes) -> str | None:
    try:
        own = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8")
    except UnicodeDecodeError:
        return None
    return None if CONTROL.search(own) else own


def contents(data: bytes, above: frozenset = frozenset()):
    """(text, digests of the data it came from, compressed) of bytes: themselves if they are
    text, else whatever they hold in layers of compression."""
    own = as_text(data) if data else None
    if own is not None:
        yield own, above, False
        return
    digest = hashlib.blake2b(data, digest_size=16).digest()
    if digest in above:
        return
    above |= {digest}
    kind = packing(data)
    held = b""
    for piece in pieces(data, kind) if kind else ():
        held += piece
        cut = held.rfind(b"\n") + 1
        if cut and len(held) >= PIECE and not packing(held):  # what is compressed again is needed as a whole
            for text, up, _ in contents(held[:cut], above):
                yield text, up, True
            held = held[cut:]
        elif len(held) > MOST_CHARACTERS:
            break
    if held:
        for text, up, _ in contents(held, above):
            yield text, up, True


def base64_decoded(layer: Layer):
    """Layers of base64 runs that hold text, compressed or not."""
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        if len(run) % 4 == 1:
            run = run[:-1]  # no byte ends there
        data = binascii.a2b_base64(run + "=" * (-len(run) % 4))
        for text, above, packed in contents(data):
            if packed:
                low, high = layer.origin(*m.span())
                starts, ends = np.full(len(text), low), np.full(len(text), high)
            else:  # a byte takes eight of the bits, a character has six
                sizes = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
                if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
                    sizes = np.fromiter((len(c.encode("utf-16-le")) for c in text), np.int64, len(text))
                past = sizes.cumsum() + (len(data) - int(sizes.sum()))
                starts, ends = layer.origins(m.start() + (past - sizes) * 8 // 6, m.start() + (past * 8 - 1) // 6 + 1)
            yield text, starts, ends, above


def found(text: str | None) -> tuple[list, list, bool]:
    """(base, added, unfinished): spans (kind, start, end, depth) of a text and of its layers."""
    if not text:
        return [], [], False
    base = [(*s, 0) for s in scanned(text)]
    seen = {s[:3] for s in base}
    added: list[tuple[str, int, int, int]] = []
    work, held = [Layer(text)], 0
    while work:
        layer = work.pop()
        if layer.depth:
            for kind, start, end in scanned(layer.text):
                span = (kind, *layer.origin(start, end))
                if span not in seen:
                    seen.add(span)
                    added.append((*span, layer.depth))
        above = None
        for own, starts, ends, *more in chain(lines_unescaped(layer), base64_decoded(layer)):
            if above is None:
                above = layer.above | {layer.digest()}
            new = Layer(own, starts, ends, above | (more[0] if more else frozenset()), layer.depth + 1)
            if not own or new.digest() in new.above:
                continue  # a circle
            held += len(own)
            if held > MOST_CHARACTERS:
                return base, added, True
            work.append(new)
    return base, added, False


def with_spans(docs: DataFrame, text: str = "text", keep_text: bool = True) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the base spans, the added ones and ``unfinished``, and the names of these
    columns. ``depth`` of a span is the number of layers it was wrapped in; without ``keep_text``
    the text isn't returned from the Python workers."""
    names = tuple(common.free(docs, c) for c in ("secrets", "wrapped_secrets", "unfinished"))
    at = docs.columns.index(text)
    stay = [k for k in range(len(docs.columns)) if keep_text or k != at]
    schema = T.StructType([docs.schema[k] for k in stay] + [T.StructField(names[0], T._parse_datatype_string(SPAN)), T.StructField(names[1], T._parse_datatype_string(SPAN)), T.StructField(names[2], T.BooleanType())])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("depth", pa.int32())]))

    def spans(rows):
        return pa.array([[dict(zip(("kind", "start", "end", "depth"), s, strict=True)) for s in ordered(r)] for r in rows], span)

    def run(batches):
        for batch in batches:
            own = [found(t.as_py()) for t in batch.column(at)]
            cols = [*[batch.column(k) for k in stay], spans(x for x, _, _ in own), spans(x for _, x, _ in own), pa.array([x for _, _, x in own], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return common.mapped(docs, run, schema), names


def ordered(spans: list) -> list:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(*spans: Column) -> Column:
    """kind:start:end of all spans by start, then kind as listed, then end, comma-joined."""
    order = F.array(*map(F.lit, KINDS))
    keyed = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    rows = F.array_sort(F.transform(F.concat(*spans), keyed))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
