"""Language-model scores from a log-frequency Bloom filter.

Training tokens are counted exactly. Word pairs and single words enter one Bloom filter with their quantised count:
count class q(c) = 1 + floor(log2 c) puts the n-gram in q times, once per class from 1 on. A count is read back by
probing class 1, 2, ... until one is missing; its estimate is the middle of the class. The filter's size follows the
training tokens. Up to FILTER_BYTES it is broadcast; a larger one stays a written table of parts, and the distinct
n-grams of each step of texts are sent to the parts and their classes back, so no task holds more than a part and a
step. Within its part an n-gram is known by 40 bits: of PART_NGRAMS, 4 in a million share them. The model interpolates the pair's relative frequency with the smoothed single-word probability.

The base score needs exact counts of every word. The HOT_WORDS most frequent ones are broadcast, all other tokens meet
their counts in a join by word.

Cases: a null text is an empty one, whose only token is the end; whole texts are scored; repeated rows give repeated
results (ids need not be unique: rows are told apart by a number of their own); rows with a null id are scored and are
no training rows; without training rows N and V are 0 and each base term is log10(0.1 / 0.1) = 0; an empty table gives
an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from printloom.llm.common import chunks, crc_mod, written

#: Words whose exact counts are broadcast: some 30 bytes each.
HOT_WORDS = 200_000
#: Largest filter that is broadcast, bits for each training token, probes for each class.
FILTER_BYTES, BITS_PER_TOKEN, PROBES = 1 << 27, 8, 4
#: The filter is made in parts by the keys' leading bits: n-grams of a part at most (as a mean), least and most such bits.
PART_NGRAMS, LEAST_BITS, MOST_BITS = 1 << 22, 6, 16
#: Most count classes (counts up to 2 ** CLASSES) and weight of the pair against the single word.
CLASSES, WEIGHT = 40, 0.6
#: Tokens of one counting step, and of one step that asks the filter's parts.
STEP_TOKENS, ASK_TOKENS = 1 << 20, 1 << 20

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Stands for the start, the end, and marks single words in the filter.
_START, _END, _SINGLE = np.uint64(0x5A17), np.uint64(0xE4D), np.uint64(0x51)
END = ""  # no word is empty, so this names the end token


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case, divided at U+0020 and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Keys of a text's word pairs, from the start's pair to the end's: one for each token."""
    before, after = np.concatenate([[_START], h]), np.concatenate([h, [_END]])
    return mixed(before * _A + after)


def single_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h * _A + _SINGLE)


def inner(keys: np.ndarray, lead: int) -> np.ndarray:
    """The 40 bits by which a key is known within its part."""
    return (keys >> np.uint64(24 - lead)) & np.uint64((1 << 40) - 1)


def planes(numbers: np.ndarray, width: int) -> bytes:
    """Whole numbers as ``width`` planes, of their lowest bytes first: ascending or small ones compress well."""
    return numbers.view(np.uint8).reshape(len(numbers), -1)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :width] = rows.T
    return out.view(np.uint64).ravel()


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True)


# --- counting --------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over the column t; the end counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h = hashes(held)
            _, first, n = np.unique(h, return_index=True, return_counts=True) if held else (h, [], [])
            return pa.record_batch({"word": pa.array([held[i].decode() for i in first] + [END], pa.string()), "n": pa.array([*n, ends], pa.int64())})

        held, ends = [], 0
        for (rows,) in chunks(batches, "t"):
            for t in rows:
                held += words_of(t)
                ends += 1
                if len(held) >= STEP_TOKENS:
                    yield flush()
                    held, ends = [], 0
        if ends:
            yield flush()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def leading_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (2 * tokens // PART_NGRAMS).bit_length()))


def ngram_parts(texts: DataFrame, lead: int) -> DataFrame:
    """part, keys, counts: of the n-grams of the column t, packed as planes, combined over a step of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys, n = _counted(held)
            part = (keys >> np.uint64(64 - lead)).astype(np.int64)  # keys ascend, so parts do
            cuts = np.searchsorted(part, np.arange((1 << lead) + 1))
            own = [i for i in range(1 << lead) if cuts[i] < cuts[i + 1]]
            n = np.minimum(n, (1 << 32) - 1).astype(np.uint32)
            return pa.record_batch({"part": pa.array(own, pa.int32()), "keys": pa.array([planes(inner(keys[cuts[i] : cuts[i + 1]], lead), 5) for i in own], pa.binary()), "counts": pa.array([packed(n[cuts[i] : cuts[i + 1]]) for i in own], pa.binary())})

        held, size = [], 0
        for (rows,) in chunks(batches, "t"):
            for t in rows:
                h = hashes(words_of(t))
                held += [pair_keys(h), single_keys(np.append(h, _END))]  # the end is a token of each text
                size += 2 * (len(h) + 1)
                if size >= 4 * STEP_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "part int, keys binary, counts binary")


def packed(n: np.ndarray) -> bytes:
    """Counts as bytes; those from 255 on follow as pairs of place and 32-bit count."""
    big = np.flatnonzero(n >= 255)
    small = np.minimum(n, 255).astype(np.uint8)
    return small.tobytes() + big.astype(np.uint32).tobytes() + n[big].astype(np.uint32).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    rest = np.frombuffer(data[size:], np.uint32)
    n[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return n


# --- the filter ------------------------------------------------------------------------------------------------------


def positions(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """Bit places of one probe for one count class within a part of ``bits`` bits."""
    h = mixed(keys + np.uint64((level * PROBES + probe + 1) * int(_A) & (1 << 64) - 1))
    return (((h >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def part_bits(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """The bit map of one part that holds the n-grams with their classes."""
    out = np.zeros(bits // 8, np.uint8)
    classes = np.minimum(np.frexp(counts.astype(np.float64))[1], CLASSES)
    level = 1
    while len(keys):
        for p in range(PROBES):
            at = positions(keys, level, p, bits)
            np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        level += 1
        keys, classes = keys[classes >= level], classes[classes >= level]
    return out


def probed(keys: np.ndarray, base: np.ndarray, maps: np.ndarray, bits: int) -> np.ndarray:
    """Class of each key: how many classes in a row from 1 on are set in its part, whose map begins at ``base``."""
    out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level in range(1, CLASSES + 1):
        for p in range(PROBES):
            at = positions(keys[left], level, p, bits)
            left = left[maps[base[left] + (at >> 3)] >> (at & 7) & 1 == 1]
        if not len(left):
            break
        out[left] = level
    return out


class Filter:
    """All parts of the filter; counts are read by repeated probes."""

    def __init__(self, maps: np.ndarray, bits: int, lead: int):
        self.maps, self.bits, self.lead = maps, bits, lead
        self.ends = float(self.counts(single_keys(np.array([_END])))[0])

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """Count class of each key: how many classes in a row from 1 on are all set."""
        part = (keys >> np.uint64(64 - self.lead)).astype(np.int64)
        return probed(inner(keys, self.lead), part * (self.bits // 8), self.maps, self.bits)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of each class from 2 ** (q - 1) to 2 ** q - 1, 0 for none. Equal keys are probed once."""
        own, place = np.unique(keys, return_inverse=True)
        return estimates(self.classes(own))[place]


class Answers:
    """Classes that the filter's parts gave for the ascending keys."""

    def __init__(self, keys: np.ndarray, classes: np.ndarray):
        self.keys, self.values = keys, estimates(classes.astype(np.int64))
        self.ends = float(self.counts(single_keys(np.array([_END])))[0])

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.keys, keys)]


def estimates(q: np.ndarray) -> np.ndarray:
    return np.where(q == 0, 0.0, (2.0 ** (q - 1) + 2.0**q - 1) / 2)


def filter_parts(texts: DataFrame, tokens: int) -> tuple[DataFrame, int, int]:
    """The written table of parts (part, map), bits in each, and leading bits; sized by the training tokens."""
    lead = leading_bits(tokens)
    bits = max(1 << 10, BITS_PER_TOKEN * tokens >> lead) // 64 * 64

    def merge(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([part], pa.int32()), "map": pa.array([part_bits(*total, bits).tobytes()], pa.binary())})

        part, total, waiting, size = None, None, [], 0
        for batch in pieces:
            for p, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part is not None and p != part:
                    total = _summed(total, waiting)
                    yield close()
                    total, waiting, size = None, [], 0
                part = p
                own = from_planes(k, 5)
                waiting.append((own, unpacked(c, len(own))))
                size += len(own)
                if size > 2 * STEP_TOKENS:
                    total, waiting, size = _summed(total, waiting), [], 0
        if part is not None:
            total = _summed(total, waiting)
            yield close()

    maps = ngram_parts(texts, lead).repartition(1 << lead, "part").sortWithinPartitions("part").mapInArrow(merge, "part int, map binary")
    return written(maps), bits, lead


def gathered(parts: DataFrame, bits: int, lead: int) -> bytes:
    """Bit maps of all parts end to end."""
    whole, size = bytearray(bits // 8 << lead), bits // 8  # about FILTER_BYTES in all at most
    for r in parts.toLocalIterator():  # a few parts at a time
        whole[r["part"] * size : (r["part"] + 1) * size] = r["map"]
    return bytes(whole)


def _summed(total: tuple | None, more: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    parts = ([total] if total is not None else []) + more
    keys = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


# --- scores ----------------------------------------------------------------------------------------------------------


def followed(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts whose words' hashes stand end to end: at each token its hash and the one before it, where texts start, and which tokens are ends."""
    ends = np.cumsum(sizes + 1) - 1  # where each text's end token is
    starts = ends - sizes
    is_end = np.zeros(len(h) + len(sizes), bool)
    is_end[ends] = True
    then = np.empty(len(is_end), np.uint64)
    then[is_end], then[~is_end] = _END, h
    first = np.concatenate([[_START], then[:-1]])
    first[starts] = _START
    return first, then, starts, is_end


def model_scores(h: np.ndarray, sizes: np.ndarray, counts: Filter | Answers, total: int, distinct: int) -> np.ndarray:
    """log10 probability of each of many texts: ``h`` has their words' hashes end to end, ``sizes`` how many each has.

    At each token, WEIGHT times the pair's relative frequency plus the rest times the smoothed single word. A pair of
    an unseen first word leaves all weight to the single word; an estimate never exceeds its first word's.
    """
    first_hash, then_hash, starts, is_end = followed(h, sizes)
    then = np.empty(len(is_end))
    then[is_end], then[~is_end] = counts.ends, counts.counts(single_keys(h))
    first = np.concatenate([[counts.ends], then[:-1]])
    first[starts] = counts.ends
    pairs = counts.counts(mixed(first_hash * _A + then_hash))
    smooth = (then + 0.1) / (max(total, 0) + 0.1 * (distinct + 1))
    share = np.minimum(pairs / np.maximum(first, 1.0), 1.0)
    p = np.where(first > 0, WEIGHT * share + (1 - WEIGHT) * smooth, smooth)
    return np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts)


def text_keys(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct keys, ascending, that model_scores reads for texts whose words' hashes stand end to end."""
    first, then, _, _ = followed(h, sizes)
    return np.unique(np.concatenate([single_keys(np.append(np.unique(h), _END)), np.unique(mixed(first * _A + then))]))


def step_fields(ids: list[int], held: list[np.ndarray]) -> list[bytes]:
    """A step of texts: their row numbers and sizes, their distinct words' hashes (often used ones first), and each word's place among these."""
    own, at, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    place = np.empty(len(own), np.uint32)
    place[order] = np.arange(len(own), dtype=np.uint32)
    return [np.array(ids, np.int64).tobytes(), planes(np.array([len(x) for x in held], np.int64), 8), own[order].tobytes(), planes(place[at], 4)]


def step_words(sizes: bytes, own: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of a step's texts end to end, and the texts' sizes."""
    return np.frombuffer(own, np.uint64)[from_planes(at, 4).astype(np.int64)], from_planes(sizes, 8).astype(np.int64)


def scores_by_parts(steps: DataFrame, parts: DataFrame, bits: int, lead: int, total: int, distinct: int) -> DataFrame:
    """row and score of the texts of steps (step, rows, sizes, own, at), by a filter that stays a table of parts.

    A step's distinct keys go to their parts, where each part's map comes first, and the classes, a byte each, come
    back to the step.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for steps_, sizes, own, at in chunks(batches, "step", "sizes", "own", "at", rows=1):
            keys = text_keys(*step_words(sizes[0], own[0], at[0]))
            part = (keys >> np.uint64(64 - lead)).astype(np.int64)
            asked, first = np.unique(part, return_index=True)
            cut = np.split(inner(keys, lead), first[1:])
            yield pa.record_batch({"part": pa.array(asked, pa.int32()), "step": pa.array(np.full(len(asked), steps_[0]), pa.int64()), "data": pa.array([planes(k, 5) for k in cut], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filled = None, None
        for ps, ss, ds in chunks(batches, "part", "step", "data", rows=16):
            for part, step, data in zip(ps, ss, ds):
                if step < 0:
                    at, filled = part, np.frombuffer(data, np.uint8)
                    continue
                keys = from_planes(data, 5)
                found = probed(keys, np.zeros(len(keys), np.int64), filled, bits) if at == part else np.zeros(len(keys), np.int64)
                yield pa.record_batch({"step": pa.array([step], pa.int64()), "part": pa.array([part], pa.int32()), "at": pa.array([found.astype(np.uint8).tobytes()], pa.binary()), **{n: pa.nulls(1, pa.binary()) for n in ("rows", "sizes", "own")}})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            h, sizes = step_words(*texts[1:])
            answers = Answers(text_keys(h, sizes), np.frombuffer(b"".join(got), np.uint8))
            return pa.record_batch({"row": pa.array(np.frombuffer(texts[0], np.int64)), "score": pa.array(model_scores(h, sizes, answers, total, distinct))})

        texts, got = None, []
        for part, at, *more in chunks(batches, "part", "at", "rows", "sizes", "own", rows=1):
            if part[0] < 0:
                if texts:
                    yield close()
                texts, got = (more[0][0], more[1][0], more[2][0], at[0]), []
            else:
                got.append(at[0])
        if texts:
            yield close()

    asked = parts.select("part", F.lit(-1).cast("long").alias("step"), F.col("map").alias("data")).union(steps.mapInArrow(ask, "part int, step long, data binary"))
    answers = asked.repartition(1 << lead, "part").sortWithinPartitions("part", "step").mapInArrow(answer, "step long, part int, at binary, rows binary, sizes binary, own binary")
    own = steps.select("step", F.lit(-1).alias("part"), "at", "rows", "sizes", "own")
    return own.union(answers).repartition("step").sortWithinPartitions("step", "part").mapInArrow(finish, "row long, score double")


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, n_tokens, n_known, train_tokens, base_score and score of each row; the rows for which ``training`` holds teach."""
    spark = docs.sparkSession
    texts = docs.where(training).select(F.col(text).alias("t"))
    counts = written(word_counts(texts))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(sums["n"]), int(sums["v"])
    top = counts.orderBy(F.desc("n"), "word").limit(HOT_WORDS).toArrow()
    last = counts.where(F.col("word") == END).first()  # each text's end token, whether it is hot or not
    ends = int(last["n"]) if last else 0
    hot = dict(zip(top["word"].cast(pa.binary()).to_pylist(), top["n"].to_pylist()))
    parts, bits, lead = filter_parts(texts, total)
    small = BITS_PER_TOKEN * total <= FILTER_BYTES * 8
    shared = spark.sparkContext.broadcast((hot, gathered(parts, bits, lead) if small else None))
    below = np.log10(total + 0.1 * (distinct + 1))

    key_type = to_arrow_type(docs.schema[key].dataType)
    shape = pa.schema([("row", pa.int64()), ("k", key_type), ("word", pa.string()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("times", pa.int64()), *((n, pa.binary()) for n in ("rows", "sizes", "own", "at"))])

    def pieces_of(n: int, **columns) -> pa.RecordBatch:
        """Rows of ``shape``; columns that are not given are null."""
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, one for each word of a text that is not hot, and one for each step where the filter is no broadcast."""
        own, maps = shared.value
        filled = Filter(np.frombuffer(maps, np.uint8), bits, lead) if small else None
        step_ids, held, waiting = [], [], 0
        for ids, keys, rows in chunks(batches, "row", "k", "t"):
            split = [words_of(t) for t in rows]
            words = [w for own_words in split for w in own_words]
            sizes, h = np.array([len(w) for w in split], np.int64), hashes(words)
            found = np.fromiter((own.get(w, 0) for w in words), np.int64, len(words))
            logs = np.append(np.where(found > 0, np.log10(found + 0.1) - below, 0.0), 0.0)  # reduceat needs a value after the last
            starts = np.cumsum(sizes) - sizes
            base = np.where(sizes > 0, np.add.reduceat(logs, starts), 0.0)
            known = np.where(sizes > 0, np.add.reduceat(np.append(found > 0, False).astype(np.int64), starts), 0)
            if ends or not distinct:
                base = base + (np.log10(ends + 0.1) - below)
            models = {"score": pa.array(model_scores(h, sizes, filled, total, distinct))} if small else {}
            yield pieces_of(len(rows), row=pa.array(ids, pa.int64()), k=pa.array(keys, key_type), word=pa.array([f" {i}" for i in ids]), n_tokens=pa.array(sizes + 1), n_known=pa.array(known + (ends > 0)), base=pa.array(base), **models)
            cold = np.flatnonzero(found == 0)
            if len(cold):
                of = np.array(ids, np.int64)[np.searchsorted(np.cumsum(sizes), cold, side="right")]
                often = Counter(zip(of.tolist(), map(words.__getitem__, cold.tolist())))  # one row for a text's word
                yield pieces_of(len(often), row=pa.array([r for r, _ in often], pa.int64()), word=pa.array([w for _, w in often], pa.binary()).cast(pa.string()), times=pa.array(list(often.values()), pa.int64()))
            if not small:
                step_ids += ids
                held += np.split(h, np.cumsum(sizes)[:-1])
                waiting += len(h) + len(ids)
                if waiting >= ASK_TOKENS:
                    yield pieces_of(1, row=pa.array(step_ids[:1], pa.int64()), **{n: pa.array([x], pa.binary()) for n, x in zip(("rows", "sizes", "own", "at"), step_fields(step_ids, held))})
                    step_ids, held, waiting = [], [], 0
        if held:
            yield pieces_of(1, row=pa.array(step_ids[:1], pa.int64()), **{n: pa.array([x], pa.binary()) for n, x in zip(("rows", "sizes", "own", "at"), step_fields(step_ids, held))})

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("row", F.monotonically_increasing_id())
    pieces = numbered.mapInArrow(run, f"row long, k {kind}, word string, n_tokens long, n_known long, base double, score double, times long, rows binary, sizes binary, own binary, at binary")
    named = ("row", "k", "word", "n_tokens", "n_known", "base", "score", "times")
    if small:
        pieces = pieces.select(*named)
    else:
        scanned = written(pieces)  # read three times, with the same row numbers
        steps = scanned.where("own IS NOT NULL").select(F.col("row").alias("step"), "rows", "sizes", "own", "at")
        of_parts = scores_by_parts(steps, parts, bits, lead, total, distinct)
        none = {n: F.lit(None).cast(t) for n, t in (("k", kind), ("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("times", "long"))}
        scored = of_parts.withColumns(none).withColumn("word", F.concat(F.lit(" "), F.col("row").cast("string")))
        pieces = scanned.where("own IS NULL").select(*named).union(scored.select(*named))
    c = F.coalesce(F.col("n"), F.lit(0))
    cold = F.col("times") * (F.log10(c + 0.1) - F.lit(float(below)))
    met = pieces.join(counts, "word", "left")
    one = met.groupBy("row").agg(
        F.max("k").alias(key),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("n").isNotNull(), F.col("times")))).alias("n_known"),
        F.sum(F.coalesce("base", cold)).alias("base_score"),
        F.max("score").alias("score"),
    )
    return one.select(key, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def training_rows(key: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(key, 10) != 0, F.lit(False))
