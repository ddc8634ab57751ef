"""Secret scan: an Aho-Corasick automaton finds keywords, anchored expressions run only at its hits, and
formats that carry a checksum count only if it holds.

Cases: a null text is an empty one; empty texts have no span; whole texts are scanned whatever their length;
repeated rows give repeated results; an empty table gives an empty one; other columns are not read.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import CHUNK_ROWS, chunks

#: Base kinds, in the order that ties of start follow.
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that the checksum step adds after them.
ADDED_KINDS = ("github", "npm", "xprv")
KINDS = BASE_KINDS + ADDED_KINDS

#: Keywords of the automaton (lower case) and the kind each one announces.
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "xprv": "xprv",
}
#: What must stand at a hit. Texts are searched as bytes read as Latin-1, so "either case" means A-Z.
ANCHORED = {
    "assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
}
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_HEX = re.compile(rb"[0-9a-f]{%d,}" % MIN_HEX)
#: Projects a text on the alphabet {hexadecimal digit, other}: there a long enough run is one keyword.
_HEX_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))
_HEX_WORD = b"h" * MIN_HEX


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def base58_check(word: str) -> bool:
    """Does the base-58 word end in the first four bytes of its double SHA-256?"""
    number = 0
    for c in word:
        number = number * 58 + BASE58.index(c)
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return len(raw) > 4 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= MIN_VALUE
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    if kind == "xprv":
        return base58_check(m[0])
    body = m[0].partition("_")[2]
    return base62_crc(body[:-6]) == body[-6:]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, index of the kind, end) of a text, sorted by start, then kind.

    Per kind they are leftmost and do not overlap; a match that fails its test is dropped but still consumed.
    """
    raw = (text or "").encode()
    spans: list[tuple[int, int, int]] = []
    plain = raw.decode("latin-1")  # one character a byte
    after = dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (size, kind) in automaton().iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        if start >= after[kind] and (m := ANCHORED[kind].match(plain, start)):
            after[kind] = m.end()
            if _valid(kind, m):
                spans.append((start, KINDS.index(kind), m.end()))
    if _HEX_WORD in raw.translate(_HEX_CLASS):
        spans += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(raw)]
    spans.sort()
    if spans and len(plain) != len(text):  # byte offsets become code points
        place, at, n = {}, 0, 0
        for p in sorted({p for a, _, b in spans for p in (a, b)}):
            n += len(raw[at:p].decode())
            place[p], at = n, p
        spans = [(place[a], k, place[b]) for a, k, b in spans]
    return spans


def notation(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mask: str = "[REDACTED {}]") -> str | None:
    """The text with each span replaced by a mark that names its kind; spans that overlap become one."""
    out, at = [], 0
    for a, k, b in find_secrets(text):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask.format(KINDS[k])]
        at = b
    return text if not out else "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, counts of the base kinds, their digest, all spans and the added count."""
    at = docs.schema[key].dataType
    schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_checked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in chunks(batches, "k", "t"):
            rows = []
            for t in texts:
                spans = find_secrets(t)
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                n = [sum(s[1] == i for s in base) for i in range(len(BASE_KINDS))]
                rows.append((*n, hashlib.sha256(notation(base).encode()).hexdigest(), notation(spans), len(spans) - len(base)))
            yield pa.record_batch([pa.array(keys), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema))], names=["k", *schema.names])

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {at.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long")
    return out.withColumnRenamed("k", key)


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text`` masked, all other columns as they were; clean texts stay the same."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                column = pa.array([redact(t) for t in part.column(i).to_pylist()], part.schema.field(i).type)
                yield pa.record_batch([column if k == i else c for k, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema).select(*names)
