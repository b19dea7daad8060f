"""Secret scans with structural confirmation.

Three base patterns find assignments, access keys and hex digests. Beyond these, text
that looks like base64 or hex is decoded and reported only if the bytes have the structure
of a key: nested lengths that add up (DER, OpenSSH), a labelled key block around such
bytes, or a signed token whose header and payload are JSON and whose signature has the
length its algorithm demands.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fingerspark.llm.texts import empty, free_name, map_texts, named

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

# Formats of the public key and token encodings that are confirmed.
PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
OPENSSH_MAGIC = b"openssh-key-v1\0"
DER_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{30,}={0,2}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{60,}(?![0-9A-Fa-f])")
SSH_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]+={0,2}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?![A-Za-z0-9_-])")
SIGNATURE_BYTES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES256K": (64,),
                   "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114), "none": (0,)}
RSA_ALGORITHMS = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
RSA_SIGNATURE_BYTES = (128, 192, 256, 384, 512)

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
BASE_KINDS = 3
DEEPEST = 12

FOUND = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("redacted", T.StringType()),
])

Span = tuple[int, int, int]


def decoded(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None where it is neither."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list | None:
    """(tag, start, end) of the values that fill ``data[at:end]`` exactly, nested ones checked.

    None where a length is not minimal, overruns what encloses it, or leaves bytes over.
    """
    if depth > DEEPEST:
        return None
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > end or data[at] == 0:
                return None
            length = int.from_bytes(data[at:at + size], "big")
            if length < 0x80:
                return None
            at += size
        if at + length > end:
            return None
        if tag & 0x20 and der_items(data, at, at + length, depth + 1) is None:
            return None
        items.append((tag, at, at + length))
        at += length
    return items


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one private key: PKCS#1, PKCS#8 plain or encrypted, SEC 1, DSA."""
    outer = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    if outer is None or len(outer) != 1:
        return False
    _, start, end = outer[0]
    inner = der_items(data, start, end)
    tags = [tag for tag, _, _ in inner]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:          # encrypted PKCS#8
        scheme = der_items(data, inner[0][1], inner[0][2])
        return bool(scheme) and scheme[0][0] == 0x06 and inner[1][2] - inner[1][1] >= 16
    if not tags or tags[0] != 0x02:
        return False
    version = int.from_bytes(data[inner[0][1]:inner[0][2]], "big", signed=True)
    if version not in (0, 1):
        return False
    if len(tags) >= 6 and set(tags[:6]) == {0x02}:           # RSA with nine numbers, DSA with six
        return True
    if tags[1:3] == [0x30, 0x04]:                            # PKCS#8
        scheme = der_items(data, inner[1][1], inner[1][2])
        return bool(scheme) and scheme[0][0] == 0x06
    return tags[1:2] == [0x04] and inner[1][2] - inner[1][1] in (28, 32, 48, 66)


def is_openssh_key(data: bytes) -> bool:
    """Whether length-prefixed fields of an OpenSSH private key fill the bytes exactly."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at = len(OPENSSH_MAGIC)

    def number() -> int:
        nonlocal at
        if at + 4 > len(data):
            raise ValueError
        value = struct.unpack_from(">I", data, at)[0]
        at += 4
        return value

    def skip() -> int:
        nonlocal at
        length = number()
        if at + length > len(data):
            raise ValueError
        at += length
        return length

    try:
        for _ in range(3):                                   # cipher, key derivation, its options
            skip()
        keys = number()
        if not 1 <= keys <= 64:
            return False
        for _ in range(keys):
            if skip() == 0:
                return False
        return skip() >= 8 and at == len(data)
    except ValueError:
        return False


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    """Whether three dotted parts are a JSON header, a JSON payload and a fitting signature."""
    head, body, signature = (decoded(p) if p else b"" for p in text.split("."))
    try:
        header, payload = json.loads(head), json.loads(body)
    except (ValueError, TypeError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or signature is None:
        return False
    algorithm = header.get("alg")
    if algorithm in RSA_ALGORITHMS:
        return len(signature) in RSA_SIGNATURE_BYTES
    return isinstance(algorithm, str) and len(signature) in SIGNATURE_BYTES.get(algorithm, ())


def base_spans(text: str) -> list[Span]:
    spans = []
    folded = text.lower()
    if any(word in folded for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def labelled_blocks(text: str) -> list[tuple[int, int, str]]:
    """Start, end and body of what stands between a mark BEGIN and the next mark, if that is its END.

    Marks are found first and paired, so a text full of marks takes no more time than another.
    """
    out, begun = [], None
    for mark in PEM_MARK.finditer(text):
        if mark.group(1) == "BEGIN":
            begun = mark
        elif begun is not None:
            if begun.group(2) == mark.group(2) and PEM_BODY.fullmatch(text, begun.end(), mark.start()):
                out.append((begun.start(), mark.end(), text[begun.end():mark.start()]))
            begun = None
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Spans of decoded and confirmed keys and tokens; none of them inside a labelled block."""
    spans = []
    starts, ends = [], []
    if "-----BEGIN " in text:
        for start, end, body in labelled_blocks(text):
            encrypted = "DEK-Info:" in body
            if encrypted:                                    # headers end at an empty line
                body = re.split(r"\r?\n\r?\n", body, maxsplit=1)[-1]
            data = decoded("".join(body.split()))
            if is_key(data) or encrypted and data and len(data) % 8 == 0:
                starts.append(start)
                ends.append(end)
                spans.append((start, 3, end))

    def free(m: re.Match) -> bool:
        before = bisect_right(starts, m.start())
        return before == 0 or ends[before - 1] <= m.start()

    spans += [(m.start(), 4, m.end()) for m in DER_BASE64.finditer(text)
              if free(m) and (data := decoded(m.group())) and is_der_key(data)]
    spans += [(m.start(), 4, m.end()) for m in DER_HEX.finditer(text)
              if free(m) and len(m.group()) % 2 == 0 and is_der_key(bytes.fromhex(m.group()))]
    if "b3BlbnNzaC1rZXktdjE" in text:
        spans += [(m.start(), 5, m.end()) for m in SSH_BASE64.finditer(text)
                  if free(m) and (data := decoded(m.group())) and is_openssh_key(data)]
    spans += [(m.start(), 6, m.end()) for m in TOKEN.finditer(text)
              if free(m) and is_signed_token(m.group())]
    return spans


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with ``mark`` in place of every stretch covered by spans."""
    parts, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def find(text: str | None, mark: str) -> tuple:
    text = empty(text)
    base = sorted(base_spans(text))
    spans = sorted([*base, *confirmed_spans(text)])
    counts = [sum(kind == k for _, kind, _ in base) for k in range(BASE_KINDS)]
    digest = hashlib.sha256(listed(base).encode()).hexdigest()
    return *counts, digest, listed(spans), redact(text, spans, mark) if spans else None


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets",
                 mark: str = "[secret]", keep: list[str] | None = None) -> DataFrame:
    """Add struct ``into``: counts, digest and list of spans, and the text without its secrets.

    Spans are ``kind:start:end`` in code points, end exclusive. ``redacted`` is null where
    nothing was found. A null text counts as empty and has no spans. Whole texts are
    scanned; rows are independent, so repeated rows give repeated results and an empty
    table an empty one. ``keep`` names the columns to pass on, all by default; a column
    called ``into`` is replaced.
    """
    def start():
        return lambda texts: [find(t, mark) for t in texts]

    return map_texts(df, text, into, FOUND, start, keep)


def without_secrets(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets replaced by a mark and the length column renewed.

    Null and empty texts stay as they are, and so do lengths of texts without secrets, null ones among
    them. Spans that overlap give one mark. Repeated rows are treated alike; very long texts are scanned
    whole; an empty table stays empty. Columns may be called anything.
    """
    into = free_name(df, "secrets")
    redacted = F.col(f"{into}.redacted")
    changed = {text: F.coalesce(redacted, F.col(text))}
    if length in df.columns:
        kind = df.schema[length].dataType
        changed[length] = F.when(redacted.isNotNull(), F.length(redacted).cast(kind)).otherwise(F.col(length))
    return find_secrets(df, text, into).withColumns(changed).select(*named(df))
