"""Secret scans: a worklist that unwraps nested encodings and scans every layer.

The base patterns run over the text itself. The text is then decoded: as a whole with its percent and Unicode escapes
resolved, each run of UTF-16 (ASCII characters and zero bytes by turns), and each run of base64 (from its four offsets,
over line breaks) with compressed data (gzip, zlib, bzip2, xz, lzma) anywhere inside it, or as a whole a raw deflate stream; each decoded layer goes on a worklist, is scanned and searched in turn, until nothing new
decodes. A layer whose content was seen before on its path is not opened again (cycle detection). Every character of a
layer, escaped or not, maps to the span of the source text it came from, so a secret found three layers down is reported
as a span of the original text; what was compressed maps to all of its compressed data. Inflated text is scanned in
pieces, however long it is.

Kinds, in order: ``assign``, ``access`` and ``hex`` in the text itself, then ``decoded`` for spans of the source whose
decoded content holds one of them; what stands unescaped in the text is not given again as ``decoded``.

Edge cases: a null text counts as empty and has no span. Equal spans of one kind are reported once. Bytes that are not
UTF-8 stand as one character each in a base64 or compressed layer and as replacement marks in an escaped one; every layer that decodes is scanned. A compressed layer that is cut short or damaged gives what could be read,
xz and lzma but for its last ``SMALL`` bytes. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from trackengine.llm.common import map_batches, slices

# --- fixed values: what counts as a secret
KINDS = ("assign", "access", "hex", "decoded")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
# ---
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Characters of the shortest secret in base64: a keyword of five letters, a sign and a value.
LEAST_BASE64 = -(-(len("token=") + LEAST_VALUE) * 8 // 6)
#: A run of either alphabet; lines that follow each other directly, indented or not, are one run.
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-](?<![A-Za-z0-9+/_-][A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]*+(?:\r?\n[ \t]*[A-Za-z0-9+/_-]++)+|[A-Za-z0-9+/_-]{{{LEAST_BASE64 - 1},}}+)")
_BREAK = re.compile(r"\r?\n[ \t]*")
_STANDARD = str.maketrans("-_", "+/")
_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*+|\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}")
#: ASCII in UTF-16, of either byte order, as long as the shortest secret.
_UTF16 = re.compile(rf"(?:[\t\n\r\x20-\x7e]\x00){{{len('token=') + LEAST_VALUE},}}|(?:\x00[\t\n\r\x20-\x7e]){{{len('token=') + LEAST_VALUE},}}")
#: Heads of gzip, zlib, bzip2, xz and lzma streams.
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\]\x00\x00..(?:\xff{8}|.{5}\x00{3})", re.DOTALL)
#: What UTF-16 of four characters or more holds; quickly looked for.
_UTF16_HINT = re.compile(r"\x00[^\x00]\x00[^\x00]\x00[^\x00]\x00")
#: Bytes that are inflated at a time, and compressed bytes that are fed at a time.
CHUNK, FED = 1 << 20, 1 << 16
#: Bytes of the longest head, and what an xz or lzma stream gives at a time, of which damage may cost the last.
HEAD, SMALL = 13, 16
#: Characters of inflated text that are scanned at a time; a piece ends at a character that no pattern, escape, base64 or
#: UTF-16 has. A text without one is held up to LONGEST characters, and then cut with an overlap; base64 in it is decoded on.
PIECE, LONGEST, OVERLAP = 4 << 20, 8 << 20, 1 << 20
_TO_SEPARATOR = re.compile(r""".*[^A-Za-z0-9+/_.=~:%\\"'{} \t\r\n\x00-]""", re.DOTALL)
_RUN_TO_END = re.compile(r"[A-Za-z0-9+/_\r\n \t-]+\Z")
_RUN_ON = re.compile(r"[A-Za-z0-9+/_\r\n \t-]*")
#: A stream whose first bytes are those of one that it lies in, and which lies this deep, is taken for a cycle.
SAME, DEEP = 1024, 4
#: Memory that an xz or lzma stream may ask for; the strongest preset takes 65 MB.
LZMA_MEMORY = 256 << 20

Span = tuple[str, int, int]


def base_spans(text: str) -> Iterator[Span]:
    """The base patterns over one layer, leftmost and non-overlapping per kind."""
    lower = text.lower() if ":" in text or "=" in text else ""
    if any(hint in lower for hint in _ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


class Layer:
    """Decoded text; ``place`` maps a span of it to the span of the ``parent`` layer that it came from (None: the source itself).
    ``data`` are the bytes that base64 gave; a ``streamed`` layer's compressed data was opened where it was inflated."""

    def __init__(self, text: str, parent: Layer | None, place: Callable[[int, int], tuple[int, int]] | None, path: frozenset[bytes], unescaped: bool = False, data: bytes | None = None, streamed: bool = False):
        self.text, self.parent, self.place, self.path, self.unescaped, self.data, self.streamed = text, parent, place, path, unescaped, data, streamed

    def source(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.place(start, end)
            layer = layer.parent
        return start, end


def _unescape(text: str) -> tuple[str, Callable[[int, int], tuple[int, int]]] | None:
    """The whole text with its percent and backslash escapes decoded; bytes of consecutive percent escapes join to UTF-8,
    a byte that fits no character stands for itself as a replacement mark. None if there is no escape."""
    out, last, size = [], 0, 0
    places, starts, ends = array("q"), array("q"), array("q")  # of the characters that were escaped

    def add(char: str, start: int, end: int) -> None:
        nonlocal size
        places.append(size)
        starts.append(start)
        ends.append(end)
        out.append(char)
        size += 1

    for m in _ESCAPE.finditer(text):
        piece, at = m[0], m.start()
        out.append(text[last:at])
        size += at - last
        last = m.end()
        if piece[0] == "%":
            for char in bytes.fromhex(piece.replace("%", "")).decode("utf-8", "surrogateescape"):
                known = not 0xDC80 <= ord(char) <= 0xDCFF
                end = at + 3 * (len(char.encode()) if known else 1)
                add(char if known else "\ufffd", at, end)
                at = end
        elif len(piece) == 12 and piece[6] == "\\":
            add(chr(0x10000 + ((int(piece[2:6], 16) & 0x3FF) << 10) + (int(piece[8:], 16) & 0x3FF)), at, last)
        else:
            code = int(piece[2:].strip("{}"), 16)
            add("\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code), at, last)
    if not places:
        return None
    out.append(text[last:])

    def one(at: int) -> tuple[int, int]:
        k = bisect_right(places, at) - 1
        if k >= 0 and places[k] == at:
            return starts[k], ends[k]
        begin = at if k < 0 else ends[k] + at - places[k] - 1
        return begin, begin + 1

    return "".join(out), lambda start, end: (one(start)[0], one(end - 1)[1])


def _decompressor(head: bytes):
    if head[:1] in b"\x1fx":
        return zlib.decompressobj(31 if head[:1] == b"\x1f" else 15)
    return bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(lzma.FORMAT_AUTO, LZMA_MEMORY)


def _fed(stream, piece: bytes, most: int | None = None) -> Iterator[bytes]:
    """All that a decompressor gives for a piece, in chunks."""
    most = most or CHUNK
    while True:
        out = stream.decompress(piece, most)
        if out:
            yield out
        piece = getattr(stream, "unconsumed_tail", b"")
        if stream.eof or (not piece and len(out) < most and getattr(stream, "needs_input", True)):
            return


class _Inflated:
    """Iterates over what the compressed data at ``at`` gives, members that follow each other as one; ``end`` is then the
    byte after the last whole member. Data that is cut short or damaged gives what could be read, and is ``broken``."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.broken = data, at, at, False

    def extent(self) -> int:
        """Where the data ends, that of a broken member taken as the rest; reads it all."""
        whole = _Inflated(self.data, self.at)
        for _ in whole:
            pass
        return len(self.data) if whole.broken else whole.end

    def __iter__(self) -> Iterator[bytes]:
        while (m := _MAGIC.match(self.data, self.end)) and (self.end == self.at or m[0][:1] == self.data[self.at : self.at + 1]):
            yield from self._member(m[0])
            if self.broken:
                return

    def _member(self, head: bytes) -> Iterator[bytes]:
        stream, begin, at, given = _decompressor(head), self.end, self.end, 0
        while at < len(self.data) and not stream.eof:
            before = given
            try:
                for out in _fed(stream, self.data[at : at + FED]):
                    given += len(out)
                    yield out
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                self.broken = True
                yield from self._up_to_damage(head, begin, at, given - before)
                return
            at = min(at + FED, len(self.data))
        self.broken = not stream.eof
        if stream.eof:
            self.end = at - len(stream.unused_data)

    def _up_to_damage(self, head: bytes, begin: int, at: int, skip: int) -> Iterator[bytes]:
        """Byte by byte from ``at``: a call that fails gives nothing of what it had read. ``skip`` bytes were given before."""
        stream = _decompressor(head)
        try:
            for fed in range(begin, at, FED):
                for _ in _fed(stream, self.data[fed : min(fed + FED, at)]):
                    pass
            while at < len(self.data):
                for out in _fed(stream, self.data[at : at + 1]):
                    if len(out) > skip:
                        yield out[skip:]
                    skip = max(0, skip - len(out))
                at += 1
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
            pass


class _Pieces:
    """Takes bytes and hands on decoded text in pieces between which nothing is split that a pattern or a decoder looks for."""

    def __init__(self, out: list[str], path: tuple[bytes, ...]):
        self.out, self.path = out, path
        self.held, self.size, self.wanted, self.run = [], 0, PIECE, None

    def feed(self, data: bytes) -> None:
        text = data.decode("latin-1")  # all that is looked for is ASCII
        if self.run is not None and not self.run.feed(text):
            self.run = None
        self.held.append(text)
        self.size += len(text)
        if self.size < self.wanted:
            return
        text = "".join(self.held)
        cut = _TO_SEPARATOR.match(text)
        if cut:
            self.out.append(cut[0])
            text, self.wanted = text[cut.end() :], PIECE
        elif self.size >= LONGEST:
            if self.run is None and (m := _RUN_TO_END.search(text, max(0, len(text) - OVERLAP))):
                begin = len(text) - len(_RUN_ON.match(text[::-1])[0]) if m.start() == max(0, len(text) - OVERLAP) else m.start()
                self.run = _LongRun(self.out, self.path)
                self.run.feed(text[begin:])
            self.out.append(text)
            text, self.wanted = text[-OVERLAP:], PIECE
        self.held, self.size = [text], len(text)
        while self.wanted <= self.size:
            self.wanted *= 2

    def end(self) -> None:
        text = "".join(self.held)
        if self.run is not None:
            self.run.end()
        if text:
            self.out.append(text)


class _LongRun:
    """A run of base64 that is longer than what is held at once: decoded on from its four offsets."""

    def __init__(self, out: list[str], path: tuple[bytes, ...]):
        self.left, self.rest = [0, 1, 2, 3], [""] * 4
        self.watchers = [_Watcher(out, path) for _ in range(4)]

    def feed(self, text: str) -> bool:
        """Whether the run goes on."""
        run = _RUN_ON.match(text)[0]
        body = re.sub(r"[\r\n \t]", "", run).translate(_STANDARD)
        for k, watcher in enumerate(self.watchers):
            mine = self.rest[k] + body[self.left[k] :]
            self.left[k] = max(0, self.left[k] - len(body))
            whole = len(mine) - len(mine) % 4
            self.rest[k] = mine[whole:]
            watcher.feed(base64.b64decode(mine[:whole]))
        if len(run) < len(text):
            self.end()
            return False
        return True

    def end(self) -> None:
        for watcher, rest in zip(self.watchers, self.rest, strict=True):
            if len(rest) > 1:
                watcher.feed(base64.b64decode(rest + "=" * (-len(rest) % 4)))
            watcher.end()


def _may_begin(data: bytes, at: int) -> bool:
    """Whether what looks like a head of zlib data may be one: by its first block's kind, and length if that is stored."""
    if data[at : at + 1] != b"x" or at + 2 >= len(data):
        return True
    kind = data[at + 2] >> 1 & 3
    if kind == 0 and at + 7 <= len(data):
        return data[at + 3] ^ data[at + 5] == 0xFF == data[at + 4] ^ data[at + 6]
    return kind != 3


class _Watcher:
    """Takes bytes of any length, and hands on their text in pieces, and that of all compressed data inside them, wherever it begins."""

    def __init__(self, out: list[str], path: tuple[bytes, ...]):
        self.out, self.path, self.text = out, path, _Pieces(out, path)
        self.tail, self.at, self.inner, self.members = b"", 0, [], set()

    def feed(self, data: bytes) -> None:
        self.inner = [x for x in self.inner if x.feed(data)]
        joined, begin = self.tail + data, self.at - len(self.tail)
        at = 0
        while m := _MAGIC.search(joined, at):
            at = m.start() + 1
            if m.end() > len(self.tail) and begin + m.start() not in self.members and _may_begin(joined, m.start()):
                one = _Inner(self, m[0], begin + m.start())
                if one.feed(joined[m.start() :]):
                    self.inner.append(one)
        self.members = {x for x in self.members if x >= self.at}
        self.at += len(data)
        self.tail = joined[-(HEAD - 1) :]
        self.text.feed(data)

    def end(self) -> None:
        for x in self.inner:
            x.end()
        self.text.end()


class _Inner:
    """Compressed data inside other data: members that follow each other are one. Damaged data gives what could be read."""

    def __init__(self, around: _Watcher, head: bytes, at: int):
        self.around, self.head, self.at = around, head, at  # at: where what is fed next begins
        self.stream, self.watcher, self.first, self.before = _decompressor(head), None, b"", b""

    def feed(self, data: bytes) -> bool:
        """Whether there may be more."""
        if self.watcher is None:  # what follows is held until it can be told from what it lies in
            self.first += data
            if len(self.first) < SAME:
                return True
            return self._begin()
        return self._read(data)

    def _begin(self) -> bool:
        mark, path = hashlib.sha256(self.first[:SAME]).digest(), self.around.path
        if mark in path and len(path) >= DEEP:
            return False
        self.watcher = _Watcher(self.around.out, (*path, mark))
        data, self.first = self.first, b""
        return self._read(data)

    def _read(self, data: bytes) -> bool:
        if self.stream is None:  # between members
            data, self.before = self.before + data, b""
            return self._next(data)
        for k in range(0, len(data), FED):
            piece = data[k : k + FED]
            saved = self.stream.copy() if hasattr(self.stream, "copy") else None
            given = 0
            try:
                for out in _fed(self.stream, piece, CHUNK if saved or self.head[:1] == b"B" else SMALL):
                    given += len(out)
                    self.watcher.feed(out)
            except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError):
                if saved:
                    self._up_to_damage(saved, piece, given)
                self.watcher.end()
                return False
            if self.stream.eof:
                rest = self.stream.unused_data + data[k + FED :]
                self.at += len(data) - len(rest)
                self.stream = None
                return self._next(rest)
        self.at += len(data)
        return True

    def _next(self, data: bytes) -> bool:
        m = _MAGIC.match(data)
        if m and m[0][:1] == self.head[:1]:
            self.around.members.add(self.at)
            self.stream = _decompressor(m[0])
            return self._read(data)
        if len(data) < HEAD and (not data or data[:1] == self.head[:1]):
            self.before = data
            return True
        self.watcher.end()
        return False

    def _up_to_damage(self, stream, piece: bytes, skip: int) -> None:
        """Byte by byte: a call that fails gives nothing of what it had read. ``skip`` bytes were given before."""
        try:
            for k in range(len(piece)):
                for out in _fed(stream, piece[k : k + 1]):
                    if len(out) > skip:
                        self.watcher.feed(out[skip:])
                    skip = max(0, skip - len(out))
        except zlib.error:
            pass

    def end(self) -> None:
        if self.watcher is None and not self._begin():
            return
        self.watcher.end()


def _pieces(chunks: Iterable[bytes], path: tuple[bytes, ...] = ()) -> Iterator[str]:
    """The text of ``chunks`` and of all compressed data inside, in pieces."""
    out: list[str] = []
    watcher = _Watcher(out, path)
    for chunk in chunks:
        watcher.feed(chunk)
        yield from out
        out.clear()
    watcher.end()
    yield from out


#: Characters from one known byte offset of a decoded layer to the next.
_STRIDE = 4096


def _as_text(data: bytes) -> tuple[str, str]:
    """Text of bytes, and its encoding; bytes that are not UTF-8 as a whole are a character each."""
    try:
        return data.decode(), "utf-8"
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1"


def _byte_offsets(text: str, encoding: str) -> Callable[[int], int]:
    """From a character of decoded text to its byte."""
    if encoding == "latin-1" or text.isascii():
        return lambda at: at
    known = array("q", [0])
    for k in range(0, len(text), _STRIDE):
        known.append(known[-1] + len(text[k : k + _STRIDE].encode()))
    return lambda at: known[at // _STRIDE] + len(text[at - at % _STRIDE : at].encode())


def _unbase64(run: str) -> Iterator[tuple[bytes, str, Callable[[int, int], tuple[int, int]]]]:
    """Bytes and text that a run gives from each of its four offsets, since a path or key before base64 reads like a part of it."""
    body, joints, shifts = run, array("q"), array("q")  # joints: body offsets where a line begins; shifts: break characters up to there
    if "\n" in run:
        lines, at, last, shift = [], 0, 0, 0
        for m in _BREAK.finditer(run):
            lines.append(run[last : m.start()])
            at += m.start() - last
            last = m.end()
            shift += last - m.start()
            joints.append(at)
            shifts.append(shift)
        body = "".join([*lines, run[last:]])
    if len(body) < LEAST_BASE64:
        return
    body = body.translate(_STANDARD)

    def in_run(at: int) -> int:
        k = bisect_right(joints, at) - 1
        return at if k < 0 else at + shifts[k]

    for offset in range(4):
        coded = body[offset:] if (len(body) - offset) % 4 != 1 else body[offset:-1]
        data = base64.b64decode(coded + "=" * (-len(coded) % 4))
        text, encoding = _as_text(data)
        byte_of = _byte_offsets(text, encoding)

        def place(start: int, end: int, offset: int = offset, byte_of: Callable[[int], int] = byte_of) -> tuple[int, int]:
            first, last = offset + byte_of(start) * 8 // 6, min(len(body), offset - (-byte_of(end) * 8 // 6)) - 1
            return in_run(first), in_run(last) + 1

        yield data, text, place


def _raw_deflate(data: bytes) -> Iterator[bytes]:
    """What a deflate stream without a head gives. Any bytes may look like one: it must end by itself where the data ends,
    up to what base64 rounds."""

    def chunks():
        at = 0
        while at < len(data) and not stream.eof:
            yield from _fed(stream, data[at : at + FED])
            at += FED

    stream = zlib.decompressobj(-15)
    try:
        for _ in chunks():
            pass
    except zlib.error:
        return
    if stream.eof and len(stream.unused_data) <= 2:
        stream = zlib.decompressobj(-15)
        yield from chunks()


def _uncompressed(layer: Layer) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    """What compressed data anywhere in a decoded layer gives, in pieces; each stands for the whole of that data."""
    data, at = layer.data if layer.data is not None else layer.text.encode("utf-8", "surrogatepass"), 0
    of_bytes = layer.data is not None and len(layer.text) == len(data)

    def character(byte: int) -> int:
        return byte if of_bytes else len(data[:byte].decode("utf-8", "replace"))

    while m := _MAGIC.search(data, at):
        if not _may_begin(data, m.start()):
            at = m.start() + 1
            continue
        inflated = _Inflated(data, m.start())
        whole = cache(lambda inflated=inflated: (character(inflated.at), character(inflated.extent())))
        for text in _pieces(inflated):
            yield text, lambda start, end, whole=whole: whole()
        at = m.start() + 1 if inflated.broken else inflated.end
    if layer.data is not None and not _MAGIC.match(data):
        for text in _pieces(_raw_deflate(data)):
            yield text, lambda start, end: (0, len(layer.text))


def _from_utf16(text: str) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    for m in _UTF16.finditer(text) if _UTF16_HINT.search(text) else ():
        yield m[0].replace("\0", ""), lambda start, end, base=m.start(): (base + 2 * start, base + 2 * end)


def _decoded(layer: Layer) -> Iterator[Layer]:
    def opened(text: str, place: Callable[[int, int], tuple[int, int]], **kind) -> Iterator[Layer]:
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        if digest not in layer.path:
            yield Layer(text, layer, place, layer.path | {digest}, **kind)

    text = layer.text
    if "%" in text or "\\" in text:
        found = _unescape(text)
        if found:
            yield from opened(*found, unescaped=True)
    if "\0" in text:
        for found, place in _from_utf16(text):
            yield from opened(found, place)
    if layer.parent is not None and not layer.streamed:
        for found, place in _uncompressed(layer):
            yield from opened(found, place, streamed=True)
    for m in _BASE64.finditer(text):
        if layer.unescaped:
            start, end = layer.place(*m.span())
            if layer.parent.text[start:end] == m[0]:
                continue  # no escape in it: opened from the parent
        for data, found, place in _unbase64(m[0]):
            yield from opened(found, lambda start, end, place=place, base=m.start(): tuple(base + at for at in place(start, end)), data=data)


def scan(text: str | None) -> list[Span]:
    """All spans of one text, by start, then kind as listed in ``KINDS``, then end."""
    if not text:
        return []
    found = set(base_spans(text))
    work = [_decoded(Layer(text, None, None, frozenset([hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()])))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        for kind, start, end in base_spans(layer.text):
            span = layer.source(start, end)
            if (kind, *span) not in found:  # else it stands unescaped in the text itself
                found.add(("decoded", *span))
        work.append(_decoded(layer))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[Span], mask: str = "[secret]") -> str | None:
    """The text with each union of overlapping spans replaced by ``mask``."""
    if not spans or text is None:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``: array of (kind, start, end) in code points of the text, end exclusive."""

    def make():
        def each(batch: pa.RecordBatch):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

        return each

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, make, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,`end`:bigint>>")


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every secret in ``text`` masked; ``n_chars``, where there is one, follows."""
    schema = docs.select(*docs.columns).schema

    def make():
        def each(batch: pa.RecordBatch):
            return map(masked, slices(batch))

        def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [redact(t, scan(t)) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(new, pa.string())}
            if "n_chars" in columns:
                changed = [len(b) if a != b else n for a, b, n in zip(batch.column("text").to_pylist(), new, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(changed, columns["n_chars"].type)
            return pa.RecordBatch.from_pydict(columns)

        return each

    return map_batches(docs, make, schema)
