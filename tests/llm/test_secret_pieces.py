"""Secrets in inflated text that is scanned in pieces, at every place of a cut, and an independent decoder."""

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pytest

from test_llm import brute_base
from trackengine.llm import common, secret_scan

SF = "/root/testdata/sf0.001"
SECRET = b"token=abcdefgh12"


def kinds(data):
    return sorted({s[0] for s in secret_scan.scan("x " + base64.b64encode(data).decode() + " y")})


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CHUNK", 7), ("FED", 11), ("PIECE", 64), ("LONGEST", 256), ("OVERLAP", 120)):
        monkeypatch.setattr(secret_scan, name, value)


HIDDEN = {
    "braces": rb"\u{74}oken\u{3d}\u{61}bcdefgh12",
    "utf16": b"\0" + SECRET.decode().encode("utf-16-le"),
    "utf16be": SECRET.decode().encode("utf-16-be"),
    "base64": base64.b64encode(SECRET * 3),
    "gzip": gzip.compress(SECRET * 3),
    "zlib": zlib.compress(b"1234 " + SECRET),
    "bz2": bz2.compress(SECRET),
    "xz": lzma.compress(SECRET + b" and more text"),
    "lzma": lzma.compress(SECRET + b" and more text", lzma.FORMAT_ALONE),
    "gzip in gzip": gzip.compress(b"ab, " * 9 + gzip.compress(SECRET)),
    "base64 of gzip": base64.b64encode(gzip.compress(SECRET * 9 + bytes(range(200)))),
    "members": gzip.compress(b"x tok") + gzip.compress(b"en=abcdefgh12 y"),
}


@pytest.mark.parametrize("name", sorted(HIDDEN))
def test_at_each_offset_around_a_cut(small, name):
    for filler in (b"b, ", b"bbbb"):
        for shift in range(0, 70):
            inner = filler * 20 + b"," * (shift if filler[-1:] == b" " else 0) + b"b" * (0 if filler[-1:] == b" " else shift)
            data = inner + b" " + HIDDEN[name] + b" , " + filler * 60
            assert kinds(gzip.compress(data)) == ["decoded"], (filler, shift)


def test_cycles_end(small):
    """A stream that holds the heads of what it lies in, again and again, comes to an end."""
    data = gzip.compress(b"start")
    for _ in range(12):
        data = gzip.compress(data + b" " + data)
    secret_scan.scan(base64.b64encode(data).decode())
    assert kinds(gzip.compress(gzip.compress(gzip.compress(gzip.compress(gzip.compress(gzip.compress(SECRET))))))) == ["decoded"]


def test_long_inner_streams():
    """Longer than a piece; streams of 40 MB were tried by hand."""
    packed = zlib.compressobj(1, wbits=31)
    inner = packed.compress(random.Random(2).randbytes(5_400_000)) + packed.compress(b" " + SECRET + b" ") + packed.flush()
    assert len(inner) > 5_400_000
    assert kinds(gzip.compress(b"text, " + inner + b" more", 0)) == ["decoded"]


def test_random_bytes_cost_little():
    text = base64.b64encode(random.Random(1).randbytes(1_000_000)).decode()
    began = time.process_time()
    assert secret_scan.scan(text) == []
    assert time.process_time() - began < 4  # some 1.5 on an idle machine


# --- an independent decoder: whole layers at once, without spans, pieces or worklist
def layers(text, depth=0):
    yield text
    if depth > 5:
        return
    found = [urllib.parse.unquote(text)] if "%" in text else []
    found.append(re.sub(r"\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2] or m[3], 16)), text))
    for run in re.findall(r"[A-Za-z0-9+/_-]{19,}", text):
        for k in range(4):
            part = run[k:].replace("-", "+").replace("_", "/")
            part = part[:-1] if len(part) % 4 == 1 else part
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            found.append(data.decode("latin-1"))
            for unpack in (gzip.decompress, zlib.decompress, bz2.decompress, lzma.decompress):
                try:
                    found.append(unpack(data).decode("latin-1"))
                except Exception:
                    continue
    for other in set(found) - {text}:
        yield from layers(other, depth + 1)


def test_decoded_spans_of_real_texts_against_an_independent_decoder(spark):
    texts = [r["text"] for r in common.table(spark, SF, "documents").collect()]
    draw = random.Random(3)
    wraps = [lambda b: base64.b64encode(b), lambda b: base64.b64encode(gzip.compress(b)), lambda b: b"".join(b"%%%02x" % x for x in b), lambda b: base64.urlsafe_b64encode(bz2.compress(b)), lambda b: base64.b64encode(b"some words " + b)]
    planted = []
    for k, t in enumerate(texts[:60]):
        hidden = SECRET if k % 3 else b"no secret here, none"
        for _ in range(1 + k % 3):
            hidden = draw.choice(wraps)(hidden)
        at = draw.randrange(len(t) + 1)
        planted.append(t[:at] + " " + hidden.decode() + " " + t[at:])
    for t in [*texts, *planted]:
        spans = [s for s in secret_scan.scan(t) if s[0] == "decoded"]
        bare = t
        for _, a, b in brute_base(t):
            bare = bare[:a] + "\n" * (b - a) + bare[b:]
        want = any(brute_base(x) for x in layers(bare) if x != bare)
        assert bool(spans) == want, t[:80]
        masked = secret_scan.redact(t, secret_scan.scan(t))
        assert not any(brute_base(x) for x in layers(masked))
