"""Secret scans confirmed by structure: candidates are decoded and parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import small_batches

# The patterns and least lengths of the base kinds.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH = 12
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
# Where a key may start inside a run of the alphabet, after a path's slash or another sign.
_INNER = re.compile(r"(?<=[+/_-])(?:M[A-Za-z0-9+/_-]|AAAA[BCE]|b3Bl)")
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])30(?:[0-9a-f]{62,}|[0-9A-F]{62,})(?![0-9A-Fa-f])")
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_MAGIC = b"openssh-key-v1\x00"


def decode64(text: str) -> bytes | None:
    """Base64 in the plain or the URL alphabet, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_parts(data: bytes | memoryview, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """``tag, start, end`` of the values that fill ``data[at:end]`` exactly; None if the lengths don't nest."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size = int.from_bytes(data[at:at + width], "big")
            at += width
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _fills(head: str, size: int) -> bool:
    """Whether a value whose first 12 bytes are ``head`` in base64 is ``size`` bytes long by its own length."""
    data = decode64(head)
    if not data:
        return False
    width = data[1] & 0x7F if data[1] & 0x80 else 0
    return width <= 4 and 2 + width + (int.from_bytes(data[2:2 + width], "big") if width else data[1]) == size


def is_der_key(data: bytes | memoryview) -> bool:
    """A private key: one SEQUENCE that fills the bytes and starts with a version number and goes on as a key does."""
    if data[0] != 0x30:
        return False
    outer = der_parts(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_parts(data, outer[0][1], outer[0][2])
    if not inner or len(inner) < 3 or inner[0][0] != 0x02 or inner[0][2] - inner[0][1] != 1:
        return False
    tags = [t for t, _, _ in inner]
    integers = len(tags) >= 6 and all(t == 0x02 for t in tags[:6])  # RSA and DSA keys are lists of integers
    wrapped = tags[1] == 0x30 and tags[2] == 0x04 and bool(der_parts(data, inner[1][1], inner[1][2]))  # algorithm, key bytes
    curve = tags[1] == 0x04 and tags[2] in (0xA0, 0xA1)
    return integers or wrapped or curve


def is_ssh_key(data: bytes | memoryview) -> bool:
    """Length-prefixed strings that fill the bytes after a known key type, or the private container's mark and strings."""
    if data[:len(_MAGIC)] == _MAGIC:
        at, names = len(_MAGIC), 0
        while names < 3 and at + 4 <= len(data):
            at += 4 + int.from_bytes(data[at:at + 4], "big")
            names += 1
        return names == 3 and at + 4 <= len(data)
    at, parts = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        parts.append(data[at + 4:at + 4 + size])
        if parts[0] not in _SSH:
            return False
        at += 4 + size
    return at == len(data) and len(parts) >= 2 and parts[0] in _SSH


def is_token_header(text: str) -> bool:
    """A signed token's header: JSON with an algorithm."""
    data = decode64(text)
    try:
        header = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _json_object(text: str) -> bool:
    data = decode64(text)
    try:
        return isinstance(json.loads(data), dict) if data else False
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of the base kinds: leftmost, non-overlapping per kind, short ones dropped."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def armoured(text: str) -> list[tuple[int, int, str]]:
    """``start, end, body`` of every BEGIN mark whose next mark is its END, with only letters of an armour between."""
    marks = list(_MARK.finditer(text))
    out = []
    for begin, end in zip(marks, marks[1:]):
        if begin[1] == "BEGIN" and end[1] == "END" and begin[2] == end[2] and _BODY.fullmatch(text, begin.end(), end.start()):
            out.append((begin.start(), end.end(), text[begin.end():end.start()]))
    return out


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans that decode to a key or a signed token; leftmost, non-overlapping per kind."""
    out = []
    if "-----BEGIN" in text:
        for a, b, armour in armoured(text):
            body = "".join(x for x in armour.split("\n") if ":" not in x)
            data = decode64("".join(body.split()))
            if data and (is_der_key(data) or is_ssh_key(data)):
                out.append((a, "pem", b))
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in _TOKEN.finditer(text) if is_token_header(m[1]) and _json_object(m[2])]
    begins, ends = [a for a, kind, _ in out if kind == "pem"], [b for _, kind, b in out if kind == "pem"]
    for m in _BASE64.finditer(text):
        k = bisect_right(begins, m.start()) - 1
        if k >= 0 and m.start() < ends[k]:
            continue
        body = m[0].rstrip("=")
        views: dict[int, memoryview | None] = {}  # by place in a group of four letters, so a run is decoded four times at most
        for at in [0, *(x.start() - m.start() for x in _INNER.finditer(text, m.start() + 1, m.end()))]:
            head = body[at:at + 4]
            if len(m[0]) - at < 40:
                break
            if head[0] not in "MA" and head[:3] != "b3B":  # how 0x30, a length prefix and the container's mark begin
                continue
            if at and head[0] == "M" and not _fills(body[at:at + 16], (len(body) - at) * 3 // 4):
                continue
            shift = at % 4
            if shift not in views:
                whole = decode64(body[shift:])
                views[shift] = None if whole is None else memoryview(whole)
            data = None if views[shift] is None else views[shift][at // 4 * 3:]
            kind = "der" if data and is_der_key(data) else "ssh" if data and is_ssh_key(data) else None
            if kind:
                out.append((m.start() + at, kind, m.end()))
                break
    if "30" in text:
        out += [(m.start(), "der", m.end()) for m in _HEX_KEY.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``n_assign, n_access, n_hex`` (long), ``base_spans`` and ``spans``.

    ``base_spans`` holds the pattern matches, ``spans`` also those confirmed by structure: private keys in PEM armour,
    DER keys in base64 or hex, SSH keys and signed tokens, each decoded and its nested lengths, type names or header
    parsed. Spans are ``kind:start:end`` in code points by start, then kind. A null text counts as empty and has none.
    Every row is scanned by itself, so repeated rows and null ids need no care; earlier columns of these five names go.
    """
    added = ["n_assign", "n_access", "n_hex", "base_spans", "spans"]

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_spans string, spans string")
    def scan(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            base = base_spans(t) if t else []
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), joined(base), joined(base + (confirmed_spans(t) if t else []))))
        return pd.DataFrame(rows, columns=added)

    small_batches(docs.sparkSession)
    own = docs.select(*[c for c in docs.columns if c not in added])
    return own.withColumn("__scan", scan(F.col("text").cast("string"))).select(*[F.col(f"`{c}`") for c in own.columns], "__scan.*")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark`` (overlapping spans by one)."""
    @F.pandas_udf("string")
    def hide(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_hidden(t, s, mark) if s else t for t, s in zip(text, spans)], dtype=object)

    found = scan_secrets(docs)
    return found.withColumn("text", hide(F.col("text").cast("string"), "spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _hidden(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
