"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be joined by a merge, so a text may be cut
there: fragments are encoded on their own (each distinct one once) and the ids put end to end. The pre-tokenizer's
expression must agree with a cut, so of those pairs only such are used at which it provably either breaks as well or
reads both sides as the same class: a space after anything but a space, and two ASCII letters or digits.

Cases: a null text is an empty one and has no ids; whole texts are encoded; repeated rows give repeated results; an
empty table gives an empty one; other columns are not read. The literal of a special token becomes its id, as in the
tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import chunks

#: Bytes of fragments and their ids that a worker remembers before it starts afresh; what an entry takes beside its text.
MEMO_BYTES, MEMO_ENTRY = 48 << 20, 180
#: Fixed value: the expression by which a byte-level pre-tokenizer divides a text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from which a fragment without spaces is cut further.
LONG_FRAGMENT = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary (printable Latin-1 for itself, the rest from U+0100 on)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Codec:
    """Encodes and decodes with one tokenizer file."""

    def __init__(self, path: str, memo: int = MEMO_BYTES):
        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: i for i, c in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(value[c] for c in word) for word, i in spec["model"]["vocab"].items()}
        inside = {(t[i], t[i + 1]) for t in self.bytes_of.values() for i in range(len(t) - 1)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        self.words, self.decimals = Strings(self.bytes_of), Strings({i: b"%d," % i for i in self.bytes_of})
        #: Bytes after which a space is no certain cut, and the expression that cuts where they occur.
        self.unsure = bytes(b for b in range(256) if (b, 32) in inside and b != 32)
        self.unsure_pairs = [bytes((b, 32)) for b in self.unsure]
        sure = b"".join(b"\\x%02x" % b for b in range(256) if b != 32 and b not in self.unsure)
        self.at_space = re.compile(rb"(?<=[" + sure + rb"])(?= [^ ])") if sure else re.compile(rb"(?!)")
        self.fast = self._ranked(spec)
        self.forced = self._between_alnum(inside)
        self.at_special = re.compile("|".join(f"({re.escape(x)})" for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.memo = Memo(self._encode, memo)

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        """Merging by rank, if the ids of the merges' results ascend, so that ids and ranks are the same order."""
        vocab = spec["model"]["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not plain or merged != sorted(merged) or min(merged) < 256:
            return None
        ranks = {token: i for i, token in self.bytes_of.items() if i not in self.special.values()}
        return tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode_fragment(self, fragment: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(fragment)
        return self.library.encode(fragment, add_special_tokens=False).ids

    @staticmethod
    def _between_alnum(inside: set) -> re.Pattern:
        """Where two ASCII letters, or two digits, stand that no token has side by side."""
        both = [range(48, 58), [*range(65, 91), *range(97, 123)]]
        cuts = [(chr(a), "".join(chr(b) for b in kind if (a, b) not in inside)) for kind in both for a in kind]
        return re.compile("|".join(f"(?<={a})(?=[{after}])" for a, after in cuts if after) or "(?!)")

    def fragments(self, text: str) -> list[str]:
        """The text without special tokens, cut at certain boundaries, long fragments further at pairs of letters or digits."""
        raw = text.encode()
        if b"  " in raw or any(pair in raw for pair in self.unsure_pairs):
            parts = [x.decode() for x in self.at_space.split(raw)]  # at a lone space in front of a word
        else:
            first, *rest = text.split(" ")
            parts = [x for x in (first, *(" " + r for r in rest)) if x]
        return [q for p in parts for q in (self.forced.split(p) if len(p) > LONG_FRAGMENT else (p,))]

    def _plain(self, text: str) -> bytes:
        raw = text.encode()
        if b"  " in raw or any(pair in raw for pair in self.unsure_pairs):
            return b"".join(self._packed(f) for f in self.fragments(text))
        first, *rest = text.split(" ")
        return self._packed(first) + b"".join(map(self.memo.__getitem__, rest))

    def _packed(self, part: str) -> bytes:
        """Ids of a part as 32-bit numbers; a part that starts with a space may be remembered."""
        if part.startswith(" "):
            return self.memo[part[1:]]
        return self._encode(part)

    def _encode(self, part: str) -> bytes:
        if len(part) <= LONG_FRAGMENT:
            return array("I", self.encode_fragment(part)).tobytes()
        return array("I", chain.from_iterable(map(self.encode_fragment, self.forced.split(part)))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizers library gives them."""
        if any(s in text for s in self.special):
            own = b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.at_special.split(text) if p)
        else:
            own = self._plain(text)
        return np.frombuffer(own, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.words.of(ids).decode("utf-8", "replace")

    def notation(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by commas."""
        return self.decimals.of(ids)[:-1].decode()


class Memo(dict):
    """Ids of a space and the key, found when first asked for; starts anew beyond ``limit`` bytes."""

    def __init__(self, find, limit: int):
        self.find, self.limit, self.size = find, limit, 0

    def __missing__(self, key: str) -> bytes:
        got = self.find(" " + key)
        self.size += MEMO_ENTRY + 4 * len(key) + len(got)
        if self.size > self.limit:
            self.clear()
            self.size = MEMO_ENTRY + 4 * len(key) + len(got)
        self[key] = got
        return got


class Strings:
    """Byte strings by number; puts many end to end without a step per string."""

    def __init__(self, by_id: dict[int, bytes]):
        own = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(x) for x in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(own), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.start[ids] - (ends - n), n)
        return self.flat[at + np.arange(len(at))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Codec(path)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, digests of the ids and of the text decoded from them, and the ids themselves if asked for."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, texts in chunks(batches, "k", "t"):
            rows = [own.encode(t or "") for t in texts]
            sha = [hashlib.sha256(own.notation(r).encode()).hexdigest() for r in rows]
            back = [hashlib.sha256(own.decode(r).encode()).hexdigest() for r in rows]
            out = {"k": pa.array(keys), "n_tokens": pa.array([len(r) for r in rows], pa.int64()), "ids_sha256": sha, "decoded_sha256": back}
            yield pa.record_batch(out | ({"ids": pa.array(rows, pa.list_(pa.int32()))} if with_ids else {}))

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("k", key)


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Key and text of each row's ids (null ids: null)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for keys, lists in chunks(batches, "k", "i"):
            yield pa.record_batch({"k": pa.array(keys), "text": pa.array([None if x is None else own.decode(np.array(x, np.int64)) for x in lists], pa.string())})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)
