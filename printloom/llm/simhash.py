"""SimHash near-duplicates by multi-index hashing.

Distinct fingerprints are indexed by segments, each under all values within one bit of the segment's own. Two whose
values meet under some key are compared by complete distance. Per key only a spanning forest of the links is kept:
connected classes need no more, and a group of n near copies gives n - 1 rows, not n squared.

``near_duplicates`` has 64 bits in two segments: two fingerprints that differ in at most three bits have a half in
which they differ in at most one, so no link is missed.

``one_of_each`` takes texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such fingerprints
differ in up to 15 % of their bits, so these are wider: segments as long as the logarithm of the number of documents,
so that keys stay selective, and as many that a pair at just 0.8 meets with a chance of 1 - MISS (two balls meet up to
two bits apart). Fingerprints within NEAR_BITS of their first 64 NEAR_LONGS bits tie texts to groups of candidates; within
a group every link is verified exactly on whole shingle sets. Those bits are many enough that texts alike by chance do
not tie groups to each other, however many texts there are.

Cases: a null text is an empty one; texts without words have fingerprint zero and link like any other (they are one
group of equal sets); a text of fewer words than a shingle is one shingle; whole texts are read; exact copies share a
fingerprint and meet before any search; rows whose id is null keep a null component unless others of their class have
ids, and go last where one row stays; an empty table gives an empty one; other columns are not read, and stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import chunks, passing_tables, written
from printloom.llm.graph import components
from printloom.llm.lm import hashes, mixed, words_of

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints of one index value that are compared in memory at once; more are dealt into blocks that meet two at a time.
BUCKET = 4096
#: Index values with more fingerprints than this are compared from leader to leader, fewer all at once.
SMALL = 64
#: Rows of the index that are compared in one step, but for what the last value adds.
STEP_ROWS = 1 << 17
#: A fingerprint is hot if over 1/HOT_SHARE of all rows have it, so there are fewer than HOT_SHARE such.
HOT_SHARE = 1000

#: One row of each group: words of a shingle, least Jaccard similarity as a fraction of whole numbers.
NEAR_WORDS, NEAR = 5, (4, 5)
#: Chance that a bit differs between sets of equal size with a similarity of 0.8: the angle of cosine 8/9 over pi.
FLIP = math.acos(8 / 9) / math.pi
#: 64-bit numbers of a fingerprint by which candidates are told, and bits of them in which candidates may differ: 4.6
#: standard deviations above the mean at 0.8. Of unlike texts that share a key, some 1 in 100 million differ in no more
#: (with 128 bits it would be 1 in 5,000, and each text meets thousands).
NEAR_LONGS = 3
NEAR_BITS = math.ceil(64 * NEAR_LONGS * FLIP + 4.6 * math.sqrt(64 * NEAR_LONGS * FLIP * (1 - FLIP)))
#: Chance that a pair at just 0.8 shares no index value; least bits of a segment.
MISS, LEAST_BITS = 0.01, 12
#: Shingles, and texts, of a group of candidates that are compared in memory at once: more are dealt into blocks.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 18, 2048

_HALF = (1 << 32) - 1
_A = np.uint64(0x9E3779B97F4A7C15)


# --- fingerprints ----------------------------------------------------------------------------------------------------


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many rows of a matrix of 64-bit numbers have each bit set; eight counts are summed in one number."""
    lanes = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").view(np.uint64)
    return np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingles' hashes have it set; bytes fold A-Z only, as does their split at white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):  # whole texts, a bounded part at a time
        ones += bit_sums(h[at : at + (1 << 14), None])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Key, fp (64 bits as a long) and hash (of the text, to tell rows of one key apart) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, marks in chunks(batches, "k", "t", "h"):
            fp = np.array([fingerprint(t, words) for t in texts], np.uint64)
            yield pa.record_batch({"k": pa.array(keys), "fp": pa.array(fp.view(np.int64)), "h": pa.array(marks, pa.int64())})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, f"k {kind}, fp long, h long").withColumnsRenamed({"k": key, "h": "hash"})


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, ascending."""
    h = hashes(words_of(text))
    if not len(h):
        return np.zeros(1, np.uint64)
    n = min(words, len(h))
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = mixed(out * _A + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def wide_fingerprint(own: np.ndarray, width: int) -> np.ndarray:
    """``width`` 64-bit numbers, each bit set if over half of the distinct shingles' hashes have it set."""
    salt = np.arange(1, width + 1, dtype=np.uint64) * _A
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, len(own), 1 << 13):
        ones += bit_sums(mixed(own[at : at + (1 << 13), None] ^ salt))
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, hash (of the text), node (digest of the shingle set), size, and the wide fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, marks in chunks(batches, "k", "t", "h"):
            sets = [shingle_set(t) for t in texts]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch({"key": pa.array(keys), "hash": pa.array(marks, pa.int64()), "node": pa.array(nodes), "size": pa.array([len(s) for s in sets], pa.int64()), "print": pa.array([wide_fingerprint(s, width).tobytes() for s in sets], pa.binary())})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    return rows.mapInArrow(run, f"key {kind}, hash long, node long, size long, print binary")


# --- the index -------------------------------------------------------------------------------------------------------


def names(prints: np.ndarray) -> np.ndarray:
    """One 64-bit name for each row of a matrix of fingerprints: the fingerprint itself if it has 64 bits."""
    out = prints[:, 0]
    for i in range(1, prints.shape[1]):
        out = mixed(mixed(out) * _A + prints[:, i])
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def close_pairs(lengths: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of rows in the same run, at most ``bits`` apart; runs of ``lengths`` rows stand end to end."""
    end = np.repeat(np.cumsum(lengths), lengths)
    first, step, a, b = np.arange(len(prints)), 1, [], []
    while len(first := first[first + step < end[first]]):
        near = first[distances(prints[first], prints[first + step]) <= bits]
        a.append(near)
        b.append(near + step)
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def forest(prints: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of links of at most ``bits`` that connect the same rows as all such links do; at most one less than there are."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = distances(prints[left], prints[at]) <= bits
            if near.any():
                found = left[near]
                a += [at] * len(found)
                b += found.tolist()
                queue += found.tolist()
                left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) form a forest that connects the same as all: each root takes one edge to a lesser one, in rounds."""
    points, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label, kept, left = np.arange(len(points)), [], np.arange(len(a))
    while len(left := left[label[u[left]] != label[v[left]]]):
        x, y = label[u[left]], label[v[left]]
        high, at = np.unique(np.maximum(x, y), return_index=True)
        kept.append(left[at])
        label[high] = np.minimum(x, y)[at]
        while not np.array_equal(further := label[label], label):
            label = further
    return np.concatenate([np.empty(0, np.int64), *kept])


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, f0, ...) sorted by key: links (a, b, null ...) within keys.

    A key with over BUCKET rows is passed on instead, as rows (key, null, f0, ...).
    """

    def passed(key: int, prints: np.ndarray) -> pa.RecordBatch:
        n = len(prints)
        return pa.record_batch({"a": pa.array(np.full(n, key, np.int64)), "b": pa.nulls(n, pa.int64()), **{f"f{i}": pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(prints.shape[1])}})

    def linked(a: np.ndarray, b: np.ndarray, width: int) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), **{f"f{i}": pa.nulls(len(a), pa.int64()) for i in range(width)}})

    def close(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        lengths = np.diff(cuts)
        small = (lengths > 1) & (lengths <= SMALL)
        rows = np.repeat(small, lengths)
        own = prints[rows]
        a, b = close_pairs(lengths[small], own, bits)
        found = [(names(own[a]), names(own[b]))]
        for i in np.flatnonzero(lengths > SMALL).tolist():
            own = np.unique(prints[cuts[i] : cuts[i + 1]], axis=0)
            if len(own) > BUCKET:
                yield passed(int(keys[cuts[i]]), own)
                continue
            a, b = forest(own, bits)
            found.append((names(own[a]), names(own[b])))
        a, b = (np.concatenate(x) for x in zip(*found))
        edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
        edges = edges[spanning(edges[:, 0], edges[:, 1])]
        yield linked(np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1]), prints.shape[1])

    held, size, over = [], 0, None  # over: a key of which rows have passed on already
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append((columns[0], np.stack(columns[1:], 1).view(np.uint64)))
        size += batch.num_rows
        if size >= STEP_ROWS:
            keys, prints = (np.concatenate(x) for x in zip(*held))
            if (more := int(np.searchsorted(keys, over, "right")) if over == keys[0] else 0):
                yield passed(over, prints[:more])
                keys, prints, size = keys[more:], prints[more:], size - more
            if size < STEP_ROWS:
                held = [(keys, prints)] if size else []
                continue
            whole = int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0  # the last key may go on
            if whole:
                yield from close(keys[:whole], prints[:whole])
            elif size > STEP_ROWS + BUCKET:  # one key alone: only its distinct fingerprints are kept, beyond that they pass on
                prints = np.unique(prints, axis=0)
                if len(prints) > BUCKET:
                    over = int(keys[0])
                    yield passed(over, prints)
                    prints = prints[:0]
                keys, whole = keys[: len(prints)], 0
            held, size = [(keys[whole:], prints[whole:])], len(keys) - whole
    if held and size:
        keys, prints = (np.concatenate(x) for x in zip(*held))
        more = int(np.searchsorted(keys, over, "right")) if over == keys[0] else 0
        if more:
            yield passed(over, prints[:more])
        if more < size:
            yield from close(keys[more:], prints[more:])


def _blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows (part, f0, ...) sorted by part, each part two blocks of a key at most: links within each part."""
    part, held = None, []

    def close() -> pa.RecordBatch:
        own = np.unique(np.concatenate(held), axis=0)
        a, b = (names(own[x]) for x in forest(own, bits))
        return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    for batch in batches:
        keys, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        prints = np.stack(columns, 1).view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if s < e:
                if keys[s] != part and held:
                    yield close()
                    held = []
                part = keys[s]
                held.append(prints[s:e])
    if held:
        yield close()


def near_links(looked: DataFrame, bits: int) -> DataFrame:
    """(a, b): names of fingerprints at most ``bits`` apart that share a key, as many as connect all such. looked: key, f0, ..."""
    prints = [c for c in looked.columns if c != "key"]
    shape = ", ".join(f"{c} long" for c in ("a", "b", *prints))
    first = written(looked.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _runs(it, bits), shape))
    found = first.where("b IS NOT NULL").select("a", "b")
    large = first.where("b IS NULL").select(F.col("a").alias("key"), *prints)
    if not large.isEmpty():
        dealt = large.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"))
        own, other = F.pmod(F.xxhash64(*prints), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        met = large.join(dealt, "key").withColumns({"own": own, "other": other})
        part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("part")
        found = found.union(met.select(part, *prints).repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _blocks(it, bits), "a long, b long"))
    return found.distinct()


def links(distinct: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b): links of at most three bits between distinct fingerprints that connect all that are linked."""
    fp = F.col(column)
    low, high = fp.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(fp, 32)
    ball = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    # the ball around each half, and which half it is in bit 32
    keys = F.concat(F.transform(ball, lambda m: low.bitwiseXOR(m)), F.transform(ball, lambda m: high.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32))))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(tasks, column)  # 66 rows come of each: a few small files would give a few large tasks
    return near_links(spread.select(F.explode(keys).alias("key"), fp.alias("f0")), MAX_BITS)


def joined_hot(rows: DataFrame, table: DataFrame, by: str, total: int) -> DataFrame:
    """The rows with what ``table`` (one row for each value of ``by``, held by n of ``total`` rows) says of their value.

    Rows of a hot value find it in a broadcast of fewer than HOT_SHARE rows, all others by a shuffle.
    """
    hot = F.col("n") * HOT_SHARE > total
    marked = rows.join(F.broadcast(table.where(hot).select(by, F.lit(True).alias("is_hot"))), by, "left")
    cold = marked.where("is_hot IS NULL").drop("is_hot").join(table.where(~hot), by)
    return cold.unionByName(marked.where("is_hot").drop("is_hot").join(F.broadcast(table.where(hot)), by))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Key, fingerprint (16 hexadecimal digits) and component_id (the least key that links reach) of each row."""
    with passing_tables(docs.sparkSession) as kept:
        own = kept(fingerprints(docs, key, text, words))
        per = written(own.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
        member = components(links(per))
        least = member.join(per.select("fp", "least"), member.node == F.col("fp")).groupBy("component").agg(F.min("least").alias("reach"))
        other = member.join(least, "component").select(F.col("node").alias("fp"), "reach")
        known = kept(per.join(other, "fp", "left").select("fp", F.coalesce("reach", "least").alias("component_id"), "n"))
        total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = joined_hot(own.select(key, "fp"), known, "fp", total)
    return rows.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the stage that keeps one of each group ---------------------------------------------------------------------------


def reach(bits: int) -> float:
    """Chance that two segments of ``bits`` bits, each of which differs with chance FLIP, differ in at most two."""
    return sum(math.comb(bits, k) * FLIP**k * (1 - FLIP) ** (bits - k) for k in range(3))


def plan_segments(texts: int) -> tuple[int, int]:
    """Bits of a segment and number of segments for so many texts."""
    bits = max(LEAST_BITS, texts.bit_length() - 1)
    return bits, math.ceil(math.log(MISS) / math.log(1 - reach(bits)))


def ball_rows(per: DataFrame, bits: int, segments: int) -> DataFrame:
    """key, f0, f1, ...: a row for each value within one bit of each segment of each fingerprint."""
    ball = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint64)
    weight = (1 << np.arange(bits)).astype(np.uint64)
    mark = (np.arange(segments, dtype=np.uint64) << np.uint64(bits))[None, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (prints,) in chunks(batches, "print"):
            wide = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
            set_bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")[:, : bits * segments]
            value = set_bits.reshape(len(prints), segments, bits).astype(np.uint64) @ weight
            keys = ((value[:, :, None] ^ ball) | mark).reshape(len(prints), -1)
            head = np.repeat(wide[:, :NEAR_LONGS], keys.shape[1], axis=0).view(np.int64)
            yield pa.record_batch({"key": pa.array(keys.ravel().view(np.int64)), **{f"f{i}": pa.array(np.ascontiguousarray(head[:, i])) for i in range(NEAR_LONGS)}})

    return per.select("print").mapInArrow(run, "key long, " + ", ".join(f"f{i} long" for i in range(NEAR_LONGS)))


def named(per: DataFrame) -> DataFrame:
    """The rows with ``head``, the first NEAR_LONGS numbers of their fingerprint, and ``name``, the name of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, prints in chunks(batches, "node", "print"):
            wide = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "name": pa.array(names(wide[:, :NEAR_LONGS]).view(np.int64)), "head": pa.array([p[: 8 * NEAR_LONGS] for p in prints], pa.binary())})

    return per.select("node", "print").mapInArrow(run, "node long, name long, head binary")


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """node and set of the rows (key, hash, node) that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in chunks(batches, "node", "t"):
            yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "set": pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))})

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    met = rows.join(wanted, rows.k.eqNullSafe(wanted["key"]) & (rows.h == wanted["hash"]))
    return met.select("node", "t").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * NEAR[1] >= (len(a) + len(b) - both) * NEAR[0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (part, side, node, label, head, set) sorted by part: links between similar nodes of different labels.

    Sides 0 and 1 are compared with each other, side 2 with itself. Each link joins two labels that were apart, so a
    part gives fewer links than it has rows.
    """

    def close(rows: list[tuple]) -> pa.RecordBatch:
        side, node, label = (np.array(x, np.int64) for x in list(zip(*rows))[:3])
        sets = [r[4] for r in rows]
        size = np.array([len(s) for s in sets], np.int64)
        prints = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), NEAR_LONGS)
        place, a, b = np.arange(len(rows)), [], []
        for i in np.flatnonzero(side != 1).tolist():
            other = place[(label != label[i]) & ((side == 1) if side[i] == 0 else (side == 2) & (place > i))]
            other = other[np.minimum(size[other], size[i]) * NEAR[1] >= np.maximum(size[other], size[i]) * NEAR[0]]
            other = other[distances(prints[other], prints[i]) <= NEAR_BITS]
            for j in other.tolist():
                if label[j] != label[i] and similar(sets[i], sets[j]):
                    a.append(int(node[i]))
                    b.append(int(node[j]))
                    label[label == label[j]] = label[i]
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    part, held = None, []
    for batch in batches:
        sets = batch.column(5)
        for n, (p, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
            if p != part and held:
                yield close(held)
                held = []
            part = p
            held.append((*row, np.array(sets[n].values)))  # a copy: no batch is kept
    if held:
        yield close(held)


def compared(rows: DataFrame) -> DataFrame:
    return rows.select("part", "side", "node", "label", "head", "set").repartition("part").sortWithinPartitions("part").mapInArrow(_compared, "a long, b long")


def verified_links(per: DataFrame, docs: DataFrame, key: str, text: str, bits: int, segments: int) -> DataFrame:
    """(a, b): links between nodes that connect all whose sets are similar. per: node, size, print, first (its key and hash)."""
    own = written(named(per))
    near = written(near_links(ball_rows(per, bits, segments), NEAR_BITS))
    groups = components(near).select(F.col("node").alias("name"), F.col("component").alias("group"))
    tied = own.join(groups, "name", "left").withColumn("group", F.coalesce("group", "name")).join(per.select("node", "size", "first"), "node")
    degrees = near.select(F.col("a").alias("name")).union(near.select("b")).groupBy("name").agg(F.count("*").alias("degree"))
    ranked = written(tied.join(degrees, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    lead = F.max(F.struct("degree", "node"))["node"].alias("leader")
    sizes = ranked.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total"), lead).where("n > 1")
    texts = ranked.count()
    members = joined_hot(ranked.select("group", "node", "size", "head", "first"), written(sizes), "group", texts)
    sets = sets_of(docs, members.select(F.col("first.key").alias("key"), F.col("first.hash").alias("hash"), "node"), key, text)
    whole = written(members.select("group", "node", "size", "head", "n", "total", "leader").join(sets, "node"))
    small = (F.col("total") <= BLOCK_SHINGLES) & (F.col("n") <= BLOCK_TEXTS)
    found = compared(whole.where(small).select(F.col("group").alias("part"), F.lit(2).cast("long").alias("side"), "node", F.col("node").alias("label"), "head", "set"))
    if whole.where(~small).isEmpty():
        return found

    # a large group: first each text against the one with most links, then what is left against all, in blocks
    large = whole.where(~small)
    heads = large.where("node = leader").select("group", "n", F.col("set").alias("lead_set"))
    both = F.size(F.array_intersect("set", "lead_set"))
    is_near = both * NEAR[1] >= (F.size("set") + F.size("lead_set") - both) * NEAR[0]
    led = written(joined_hot(large.drop("n"), heads, "group", texts).withColumn("led", is_near).drop("lead_set"))
    rest = written(led.where("NOT led"))
    blocks = lambda by: F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias(by)
    rest_counts = rest.groupBy("group").agg(blocks("rest_blocks"), F.count("*").alias("rest_n"))
    led_counts = led.where("led").groupBy("group").agg(blocks("led_blocks"), F.count("*").alias("led_n"))
    counts = written(rest_counts.join(led_counts, "group"))  # a row for each large group
    counted = lambda rows, n: joined_hot(rows.drop("n"), counts.select("group", "rest_blocks", "led_blocks", F.col(n).alias("n")), "group", texts)
    alone = counted(rest, "rest_n")
    block = lambda by: F.pmod(F.xxhash64("node"), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    own_part = alone.withColumns({"own": block("rest_blocks"), "other": every("rest_blocks")})
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long")
    among = own_part.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("part"), side.alias("side"), "node", F.col("node").alias("label"), "head", "set")
    across = lambda rows, i, j, side, label: rows.withColumns({"i": i, "j": j}).select(F.xxhash64(F.lit("led"), "group", "i", "j").alias("part"), F.lit(side).cast("long").alias("side"), "node", F.col(label).alias("label"), "head", "set")
    left = across(alone, block("rest_blocks"), every("led_blocks"), 0, "node")
    right = across(counted(led.where("led"), "led_n"), every("rest_blocks"), block("led_blocks"), 1, "leader")
    linked = led.where("led AND node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    return found.union(linked).union(compared(among)).union(compared(left.union(right)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts: that of the least key (null keys last), then the least hash of its text.

    Every column stays. Rows that repeat a key and its text stay once.
    """
    bits, segments = plan_segments(docs.count())
    with passing_tables(docs.sparkSession) as kept:
        own = written(signatures(docs, key, text, max(NEAR_LONGS, math.ceil(bits * segments / 64))))
        first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "hash")).alias("first")
        per = written(own.groupBy("node").agg(first, F.first("size").alias("size"), F.first("print").alias("print")))
        member = components(verified_links(per, docs, key, text, bits, segments))
        label = F.coalesce("component", "node")
        best = per.select("node", "first").join(member, "node", "left").groupBy(label.alias("label")).agg(F.min("first").alias("first"))
        stay = kept(best.select(F.col("first.key").alias("_key"), F.col("first.hash").alias("_hash")))
        repeated = not own.groupBy("key", "hash").count().where("count > 1").isEmpty()
    out = docs.join(stay, docs[key].eqNullSafe(stay["_key"]) & (F.xxhash64(docs[text]) == stay["_hash"]), "left_semi")
    if not repeated:
        return out
    packed = out.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    return packed.dropDuplicates(["key", "hash"]).select("doc.*")
