r"""Secret scans with structural confirmation.

Base spans come from three patterns: assign, access, hex. The method adds spans of kinds that patterns alone
can't tell: a candidate is reported only after its structure has been decoded and parsed.

- pem: a PEM block of a private key whose base64 body parses as a key: nested DER, or an OpenSSH key container.
  Line breaks may be written as \n, as in JSON. An END line closes the nearest BEGIN line of its label before it.
- der: base64 or base64url outside a PEM block that decodes to a nested DER key; it may be broken over lines.
- derhex: hex that decodes to a nested DER key.
- jwt: three base64url parts; the header is a JSON object with an alg, the claims are a JSON object, and the
  signature is there unless alg is none. A header may stand behind other characters of the alphabet: of a part the
  first and the last place of `eyJ` are tried.
- ssh: base64 that decodes to an OpenSSH private key container: its length fields must add up to the whole.

A DER key is a SEQUENCE whose length is exactly that of the data and whose members fill it, members of members
too, and whose members have the types of a known private key form (RSA, DSA, EC, PKCS#8, or encrypted PKCS#8).
Public keys are no secrets and aren't reported. Limits: base64 from 40 characters and hex from 48 digits (no known
key form is shorter), members nested up to DEPTH levels (key forms need four).

Positions are code points, end exclusive; spans are sorted by start, then kind in the order of KINDS. Time is
linear in the text: every pattern reads a run once, markers are paired in one pass, each part is decoded at most
a fixed number of times. Defined cases: null and empty texts have no spans (the hash is that of the empty text).
Very long texts are read whole. Repeated rows give repeated rows. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "pem", "der", "derhex", "jwt", "ssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of [0-9a-f]+ that have 24 or more; a run is never cut, so asking for 24 finds the same ones.
HEX = re.compile(r"[0-9a-f]{24,}")
MARKER = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----", re.ASCII)
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,-]|\\[nr])*", re.ASCII)
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
URL64 = re.compile(r"[A-Za-z0-9_-]{40,}={0,2}")
#: Base64 lines of one length or more, then a last line that may be shorter.
LINES = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}+\r?\n)+[A-Za-z0-9+/]*+={0,2}")
HEXES = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
#: Runs that may hold tokens; they are cut at the dots.
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Nesting that is followed; keys need four levels.
DEPTH = 16

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
MAGIC = b"openssh-key-v1\0"


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the members that fill data exactly, or None. Constructed members must be filled too."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 0x80 or size >> 8 * (n - 1) == 0:  # DER lengths are the shortest
                return None
            at += n
        if tag & 0x1F in (0, 0x1F) and tag & 0xC0 == 0 or at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and (depth >= DEPTH or der_items(body, depth + 1) is None):
            return None
        out.append((tag, body))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that fills data and has the members of a private key."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != SEQUENCE:
        return False
    inner = der_items(top[0][1]) or []
    tags = [t for t, _ in inner]
    algorithm = lambda body: bool((x := der_items(body)) and x[0][0] == OID)
    if len(tags) >= 9 and set(tags[:9]) == {INTEGER}:  # RSA private key
        return True
    if tags == [INTEGER] * 6 and inner[0][1] == b"\0":  # DSA private key
        return True
    if tags[:2] == [INTEGER, OCTETS] and inner[0][1] == b"\x01":  # EC private key
        return True
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and algorithm(inner[1][1]):  # PKCS#8
        return True
    return tags == [SEQUENCE, OCTETS] and algorithm(inner[0][1])  # encrypted PKCS#8


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container: length-prefixed fields that add up."""
    if not data.startswith(MAGIC):
        return False
    at = len(MAGIC)

    def skip(n: int) -> bool:
        nonlocal at
        for _ in range(n):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not skip(3):  # cipher, kdf, kdf options
        return False
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return keys > 0 and skip(keys + 1) and at == len(data)


def unbase64(s: str, url: bool = False) -> bytes | None:
    s = s.rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str, needs: bytes = b"") -> object:
    """What a part decodes to; parts without the bytes needed aren't parsed."""
    data = unbase64(part, True)
    if not data or needs not in data:
        return None
    try:
        return json.loads(data)
    except (ValueError, RecursionError):
        return None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens: JSON header with an algorithm, JSON claims, a signature. Leftmost first, without overlaps."""
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, free = run[0].split("."), run.start(), 0
        for i, head in enumerate(parts[:-2]):
            end = at + len(head) + 1 + len(parts[i + 1]) + 1 + len(parts[i + 2])
            if i >= free and (first := head.find("eyJ")) >= 0:
                for start in sorted({first, head.rfind("eyJ")}):
                    h = _json(head[start:], b'"alg"')
                    if isinstance(h, dict) and isinstance(h.get("alg"), str):
                        signed = h["alg"].lower() == "none" or len(unbase64(parts[i + 2], True) or b"") >= 16
                        if signed and isinstance(_json(parts[i + 1]), dict):
                            yield at + start, end
                            free = i + 3
                            break
            at += len(head) + 1


def pem_blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """start, end, a key? of PEM blocks of private keys."""
    begin = None
    for m in MARKER.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin:
            body = text[begin.end() : m.start()]
            if begin[2] == m[2] and BODY.fullmatch(body):
                legacy = "Proc-Type: 4,ENCRYPTED" in body  # headers of encrypted legacy keys
                body = re.sub(r"\\[nr]", "\n", body)
                data = unbase64(re.sub(r"\s", "", re.sub(r"(?m)^[A-Za-z0-9-]+: [^\n]*$", "", body)))
                yield begin.start(), m.end(), bool(data and (is_ssh_key(data) or is_der_key(data) or legacy and len(data) % 8 == 0))
            begin = None


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans, sorted."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    blocks = list(pem_blocks(text)) if "-----BEGIN " in text else []
    out += [(a, 3, b) for a, b, key in blocks if key]
    starts = [a for a, _, _ in blocks]

    def inside(at: int) -> bool:
        k = bisect.bisect_right(starts, at) - 1
        return k >= 0 and at < blocks[k][1]

    if "eyJ" in text:
        out += [(a, 6, b) for a, b in tokens(text)]
    seen = set()
    for pattern in (LINES, BASE64, URL64):
        for m in pattern.finditer(text):
            # a key starts with a SEQUENCE, a container with its magic: nothing else needs decoding
            if m.start() in seen or inside(m.start()) or not m[0].startswith(("M", "b3BlbnNzaC1rZXktdjE")):
                continue
            data = unbase64(re.sub(r"\s", "", m[0]), pattern is URL64)
            if data and (ssh := is_ssh_key(data)) | is_der_key(data):
                seen.add(m.start())
                out.append((m.start(), 7 if ssh else 4, m.start() + len(m[0].rstrip("\r\n"))))
    for m in HEXES.finditer(text):
        if m[0].startswith("30") and is_der_key(bytes.fromhex(m[0])):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, hash of the base spans and all spans of every row of docs."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = ([], [], []), [], []
            for t in b.column(1):
                found = find(t.as_py())
                base = [x for x in found if x[1] < 3]
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], COLUMNS)

    return docs.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
