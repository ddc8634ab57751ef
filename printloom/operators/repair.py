"""Repairs: each one is justified by a reference or a dictionary, and logged; nothing is guessed.

Rows are wide (an array of pieces for every column), so all repairs but the windowed re-cut are projections; that one
looks at islands of mismatching rows, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from printloom.functions.text import WS, collapse_cjk, hard, head_letters, join_pieces, lead_identifier, soft, strip, tail_letters, tokens
from printloom.layout import MAX_COMPLETION, MAX_POOL, MAX_WINDOW, TableSpec
from printloom.operators.geometry import PIECE
from printloom.plans.stages import stored

#: Dictionary words up to which lookups are broadcast.
BROADCAST_WORDS = 1_000_000
#: Cells of a windowed re-cut that are Python objects at once, beside those of its windows.
STEP_ROWS = 256
LOG = "doc_id string, row_no long, col int, op string, note string"


@dataclass
class Repaired:
    """Rows after all repairs; what was done; cells completed from the reference; rows re-cut; rows whose evidence may differ."""

    rows: DataFrame
    log: DataFrame
    completions: DataFrame
    reassigned: DataFrame

    @property
    def expected_exceptions(self) -> DataFrame:
        return self.reassigned.union(self.completions.select("doc_id", "row_no")).distinct()

    @property
    def by_operator(self) -> DataFrame:
        return self.log.groupBy("op").agg(F.count("*").alias("n"))


def texts(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: p["text"])


def joined(pieces: Column, kind: str) -> Column:
    return join_pieces(texts(pieces), kind)


def with_text(p: Column, text: Column) -> Column:
    return F.struct(p["page"].alias("page"), p["y"].alias("y"), p["origin"].alias("origin"), text.alias("text"))


def beside(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with their reference in the array ``values``; null where there is none, '' for cells that it lacks."""
    return rows.join(targets.select("doc_id", "row_no", "values"), ["doc_id", "row_no"], "left")


def target(i: int) -> Column:
    return F.coalesce(F.get("values", F.lit(i)), F.lit(""))


def note(op: str, i: int, text: Column) -> Column:
    return F.struct(F.lit(i).alias("col"), F.lit(op).alias("op"), text.alias("note"))


NOTES = "array<struct<col:int,op:string,note:string>>"


def noted(rows: DataFrame, column: str = "_notes") -> DataFrame:
    return rows.select("doc_id", "row_no", F.explode(column).alias("n")).select("doc_id", "row_no", "n.*")


def move_overflow_back(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """R1 on rows beside their reference: an identifier that ran across a boundary goes back to its cell.

    Only where a character straddles the boundary, the next character is not plain ASCII text, and both cells then
    equal the reference. Columns go from left to right, each seeing what the one before left. Adds to ``_notes``.
    """
    out = rows
    for i in range(1, spec.n - 1):
        left, right = F.col(f"c{i}"), F.col(f"c{i + 1}")
        first, last = F.get(right, F.lit(0)), F.element_at(left, -1)
        prefix = lead_identifier(first["text"])
        rest = F.substring(first["text"], F.length(prefix) + 1, F.length(first["text"]))
        plain = rest.rlike(r"^[\x{0}-\x{7f}]") & ~rest.rlike(f"^[{WS}]")
        new_left = F.concat(F.slice(left, 1, F.size(left) - 1), F.array(with_text(last, F.concat(last["text"], prefix))))
        kept = F.when(strip(rest) != "", F.array(with_text(first, strip(rest)))).otherwise(F.array().cast(f"array<{PIECE}>"))
        new_right = F.concat(kept, F.slice(right, 2, F.size(right)))
        flagged = F.col("values").isNotNull() & F.array_contains("boundaries", i + 1) & (F.size(left) > 0) & (F.size(right) > 0)
        moves = F.when(
            flagged,
            (prefix != "") & ~plain & (hard(joined(new_left, spec.columns[i].kind)) == hard(target(i))) & (hard(joined(new_right, spec.columns[i + 1].kind)) == hard(target(i + 1))),
        ).otherwise(F.lit(False))
        out = out.withColumn("_moves", moves)
        said = F.when(F.col("_moves"), F.array(note("move-overflow", i, F.format_string("%s moved left", prefix)))).otherwise(F.array().cast(NOTES))
        out = out.select(
            *[F.when(F.col("_moves"), new_left).otherwise(left).alias(c) if c == f"c{i}" else F.when(F.col("_moves"), new_right).otherwise(right).alias(c) if c == f"c{i + 1}" else F.concat("_notes", said).alias(c) if c == "_notes" else F.col(c) for c in out.columns if c != "_moves"]
        )
    return out


# --- the windowed re-cut ---------------------------------------------------------------------------------------------


def recut(pool: list[tuple], lens: list[int], targets: list[str], origins: list[int], lo: int) -> list[int] | None:
    """Cuts of a pool of pieces into consecutive rows that give the targets, or None.

    White space is noise, so a row's hard form is that of its pieces put end to end: cuts must lie where the summed
    lengths meet. Of several, the one that moves the fewest pieces wins, then the first in order of the cuts.
    """
    if "".join(h for h in pool) != "".join(targets):
        return None
    at = [0]
    for n in lens:
        at.append(at[-1] + n)
    best: dict[int, tuple[int, tuple[int, ...]]] = {0: (0, ())}
    total = 0
    for k, t in enumerate(targets):
        total += len(t)
        last = k == len(targets) - 1
        ends = [e for e in range(len(at)) if at[e] == total and (not last or e == len(lens))]
        step: dict[int, tuple[int, tuple[int, ...]]] = {}
        for e in ends:
            options = [(cost + sum(o != lo + k for o in origins[s:e]), cuts + (e,)) for s, (cost, cuts) in best.items() if s <= e]
            if options:
                step[e] = min(options)
        best = step
        if not best:
            return None
    return list(best[len(lens)][1])


def _windows(i: int, n: int, widest: int) -> Iterator[range]:
    """Runs of rows that hold row i of n: from two rows to the widest, each from its topmost place down."""
    for width in range(2, widest + 1):
        for top in range(max(0, i + 1 - width), min(i, n - width) + 1):
            yield range(top, top + width)


class _Row:
    """A cell's row while windows move over it; pieces are tuples (page, y, origin, text, hard form)."""

    __slots__ = ("changed", "col", "doc_id", "note", "number", "pieces", "target")

    def __init__(self, cell: dict) -> None:
        self.doc_id, self.col, self.number, self.target = cell["doc_id"], cell["col"], cell["row_no"], cell["target"]
        self.pieces = [(p["page"], p["y"], p["origin"], p["text"], h) for p, h in zip(cell["pieces"], cell["hards"])]
        self.changed, self.note = False, None

    def matches(self) -> bool:
        return "".join(p[4] for p in self.pieces) == self.target


def _settle(held: list[_Row], i: int, max_window: int) -> None:
    """If row i mismatches, re-cuts the first window around it that can be."""
    if held[i].matches():
        return
    for span in _windows(i, len(held), max_window):
        own = held[span.start : span.stop]
        if own[-1].number - own[0].number != len(own) - 1 or all(r.matches() for r in own):
            continue
        pool = sorted(((p[0], p[1], j, p[3], p[4], p[2]) for j, r in zip(span, own) for p in r.pieces), key=lambda p: p[:4])
        if not 0 < len(pool) <= MAX_POOL:
            continue
        cuts = recut([p[4] for p in pool], [len(p[4]) for p in pool], [r.target for r in own], [p[2] for p in pool], span.start)
        if cuts is None:
            continue
        for r, s, e in zip(own, [0, *cuts], cuts):
            new = [(p[0], p[1], p[5], p[3], p[4]) for p in pool[s:e]]
            if new != r.pieces:
                r.pieces, r.changed = new, True
        own[0].note = f"rows {own[0].number}-{own[-1].number} re-cut (w={len(own)})"
        return


def settled(rows: Iterable[_Row], max_window: int) -> Iterator[_Row]:
    """The rows of one island, in order, once no window can change them: greedily from the first mismatch on.

    A window around a row reaches max_window - 1 rows to either side, so no more than twice that are held.
    """
    reach = max_window - 1
    held, at = [], 0  # at: the first row that is not settled
    for row in rows:
        held.append(row)
        if len(held) > at + reach:
            _settle(held, at, max_window)
            at += 1
            if at > reach:
                yield held.pop(0)
                at -= 1
    for i in range(at, len(held)):
        _settle(held, i, max_window)
    yield from held


def _recut_islands(batches: Iterable[pa.RecordBatch], max_window: int) -> Iterator[pa.RecordBatch]:
    """Changed or noted rows of cells sorted by island and row; an island of any length passes through in small parts."""
    cells = (c for batch in batches for s in range(0, batch.num_rows, STEP_ROWS) for c in batch.slice(s, STEP_ROWS).to_pylist())
    islands = groupby(cells, key=lambda c: (c["doc_id"], c["col"], c["island"]))
    out = (r for _, island in islands for r in settled(map(_Row, island), max_window) if r.changed or r.note)
    piece = pa.struct([("page", pa.int32()), ("y", pa.float64()), ("origin", pa.int32()), ("text", pa.string())])
    while part := list(islice(out, STEP_ROWS)):
        yield pa.record_batch({
            "doc_id": pa.array([r.doc_id for r in part], pa.string()),
            "row_no": pa.array([r.number for r in part], pa.int64()),
            "col": pa.array([r.col for r in part], pa.int32()),
            "pieces": pa.array([[dict(zip(("page", "y", "origin", "text"), p)) for p in r.pieces] for r in part], pa.list_(piece)),
            "touched": pa.array([r.changed for r in part], pa.bool_()),
            "note": pa.array([r.note for r in part], pa.string()),
        })


def reassign_windows(rows: DataFrame, spec: TableSpec, max_window: int = MAX_WINDOW, keep: Callable[[DataFrame], DataFrame] = stored) -> tuple[DataFrame, DataFrame]:
    """R2 on rows beside their reference: (rows, changes). Changes: doc_id, row_no, col, pieces, touched, note.

    A window holds at most ``max_window`` rows, so mismatches further than twice that apart cannot meet: each island
    of mismatches, with clean rows around it, is settled on its own. Where a reference is shifted against its document,
    an island is a whole column: it streams through one task, which holds two windows of it.
    """
    reach = max_window - 1
    every = F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(f"c{i}").alias("pieces"), F.transform(texts(F.col(f"c{i}")), hard).alias("hards"), hard(target(i)).alias("target"))
        for i in range(spec.n) if i != spec.anchor.column
    ])
    cells = rows.where("values IS NOT NULL").select("doc_id", "row_no", F.explode(every).alias("c")).select("doc_id", "row_no", "c.*").withColumn("bad", F.array_join("hards", "") != F.col("target"))
    # rows near a mismatch, gathered without ordering whole columns: each mismatch names the rows that it reaches
    near = cells.where("bad").select("doc_id", "col", F.explode(F.sequence(F.col("row_no") - reach, F.col("row_no") + reach)).alias("row_no")).distinct()
    around = cells.join(near, ["doc_id", "col", "row_no"], "left_semi")
    order = Window.partitionBy("doc_id", "col").orderBy("row_no")
    islands = around.withColumn("_new", F.when(F.col("row_no") - F.lag("row_no").over(order) > 1, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order))
    out = f"doc_id string, row_no long, col int, pieces array<{PIECE}>, touched boolean, note string"
    by = ["doc_id", "col", "island"]
    dealt = islands.select(*by, "row_no", "pieces", "hards", "target").repartition(*by).sortWithinPartitions(*by, "row_no")
    changes = keep(dealt.mapInArrow(lambda batches: _recut_islands(batches, max_window), out))
    per = [F.first(F.when(F.col("col") == i, F.col("pieces")), ignorenulls=True).alias(f"_n{i}") for i in range(spec.n)]
    new = changes.groupBy("doc_id", "row_no").agg(*per)
    merged = rows.join(new, ["doc_id", "row_no"], "left")
    return merged.select(*[F.coalesce(f"_n{c[1:]}", c).alias(c) if c in {f"c{i}" for i in range(spec.n)} else F.col(c) for c in rows.columns]), changes


# --- dictionary ------------------------------------------------------------------------------------------------------


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Of (keys, word), those in the dictionary (column ``word``, lower case); small dictionaries are broadcast."""
    own = dictionary.select(F.lower(F.col("word")).alias("word")).distinct()
    small = own.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    return words.join(F.broadcast(own) if small else own, "word", "left_semi")


def seam_cells(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """(doc_id, row_no, col, lines) of the cells of ``en`` columns with at least two pieces."""
    own = [i for i, c in enumerate(spec.columns) if c.kind == "en" and i != spec.anchor.column]
    every = F.array(*[F.struct(F.lit(i).alias("col"), texts(F.col(f"c{i}")).alias("lines")) for i in own]) if own else F.array().cast("array<struct<col:int,lines:array<string>>>")
    return rows.select("doc_id", "row_no", F.explode(every).alias("c")).select("doc_id", "row_no", "c.*").where(F.size("lines") > 1)


SEAM = "struct<k:int,sa:string,sb:string>"


def seams(lines: Column) -> Column:
    """Of each pair of neighbouring lines: the letters that end the first's last word and that begin the second's first."""
    def one(k: Column) -> Column:
        a, b = F.try_element_at(tokens(F.get(lines, k)), F.lit(-1)), F.get(tokens(F.get(lines, k + 1)), F.lit(0))
        return F.struct(k.alias("k"), F.lower(tail_letters(F.coalesce(a, F.lit("")))).alias("sa"), F.lower(head_letters(F.coalesce(b, F.lit("")))).alias("sb"))

    return F.transform(F.sequence(F.lit(0), F.size(lines) - 2), one)


def fires(raw: Column, lines: Column) -> Column:
    """Which seams act, from those that would act alone: not after one that acted if the line between is one word."""
    def step(acc: Column, k: Column) -> Column:
        before = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(False))
        alone = F.size(tokens(F.get(lines, k))) == 1
        return F.concat(acc, F.array(F.coalesce(F.get(raw, k), F.lit(False)) & ~(before & alone)))

    return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 2), F.array().cast("array<boolean>"), step)


def _words(x: Column) -> Column:
    return F.array_join(x, " ")


def _moved(lines: Column, fire: Column, head: Callable[[Column, Column], Column], stay: Callable[[Column, Column], Column]) -> Column:
    """Lines after the acting seams: what ``head`` gives of the next line's first word goes up, ``stay`` is left of it."""
    def one(line: Column, k: Column) -> Column:
        gone = F.when(k > 0, F.coalesce(F.get(fire, k - 1), F.lit(False))).otherwise(F.lit(False))
        comes = F.coalesce(F.get(fire, k), F.lit(False))
        own = tokens(line)
        rest = F.slice(own, 2, F.size(own))
        left = stay(F.get(own, F.lit(0)), k - 1)
        base = F.when(gone, _words(F.when(left == "", rest).otherwise(F.concat(F.array(left), rest)))).otherwise(line)
        up = head(F.get(tokens(F.get(lines, k + 1)), F.lit(0)), k)
        return F.when(comes, F.concat(base, up)).otherwise(base)

    return F.transform(lines, one)


def _apply_lines(rows: DataFrame, spec: TableSpec, fixed: DataFrame, op: str) -> DataFrame:
    """Puts new lines (doc_id, row_no, col, new, n, note) in their cells and notes them."""
    per = [F.first(F.when(F.col("col") == i, F.col("new")), ignorenulls=True).alias(f"_n{i}") for i in range(spec.n)]
    said = F.collect_list(F.struct("col", F.lit(op).alias("op"), "note")).alias("_said")
    new = fixed.groupBy("doc_id", "row_no").agg(*per, said)
    merged = rows.join(new, ["doc_id", "row_no"], "left")

    def put(c: str) -> Column:
        lines = F.col(f"_n{c[1:]}")
        changed = F.transform(F.col(c), lambda p, k: with_text(p, F.get(lines, k)))
        return F.when(lines.isNotNull(), changed).otherwise(F.col(c)).alias(c)

    pieces = {f"c{i}" for i in range(spec.n)}
    return merged.select(*[put(c) if c in pieces else F.concat("_notes", F.coalesce("_said", F.array().cast(NOTES))).alias(c) if c == "_notes" else F.col(c) for c in rows.columns])


def split_words(rows: DataFrame, spec: TableSpec, dictionary: DataFrame) -> DataFrame:
    """R3: a word cut by a wrap is put together if its first part is no word and the whole is one."""
    cells = seam_cells(rows, spec).withColumn("seams", seams(F.col("lines")))
    asked = cells.select("doc_id", "row_no", "col", F.explode("seams").alias("s")).where((F.length("s.sa") >= 3) & (F.length("s.sb") > 0)).select("doc_id", "row_no", "col", F.explode(F.array("s.sa", F.concat("s.sa", "s.sb"))).alias("word"))
    known = known_words(asked, dictionary).groupBy("doc_id", "row_no", "col").agg(F.collect_set("word").alias("known"))
    open_ = cells.join(known, ["doc_id", "row_no", "col"])
    raw = F.transform("seams", lambda s: (F.length(s["sa"]) >= 3) & (F.length(s["sb"]) > 0) & ~F.array_contains("known", s["sa"]) & F.array_contains("known", F.concat(s["sa"], s["sb"])))
    acting = open_.withColumn("fire", fires(raw, F.col("lines"))).where(F.exists("fire", lambda f: f))
    new = _moved(F.col("lines"), F.col("fire"), lambda b, k: b, lambda b, k: F.lit(""))
    fixed = acting.select("doc_id", "row_no", "col", new.alias("new"), F.format_string("%d seams closed", F.size(F.filter("fire", lambda f: f))).alias("note"))
    return _apply_lines(rows, spec, fixed, "split-word")


def swallowed_spaces(rows: DataFrame, spec: TableSpec, dictionary: DataFrame) -> DataFrame:
    """R4: two words whose space a wrap swallowed part at the first place that makes two dictionary words.

    What follows the letters of the second line's first word stays with it, so no character is lost.
    """
    cells = seam_cells(rows, spec).withColumn("seams", seams(F.col("lines")))
    fits = lambda s: (F.length(s["sa"]) >= 3) & (F.length(s["sb"]) >= 5)
    places = lambda s: F.sequence(F.lit(1), F.length(s["sb"]) - 3)
    head = lambda s, j: F.concat(s["sa"], F.substring(s["sb"], F.lit(1), j))
    tail = lambda s, j: F.substring(s["sb"], j + 1, F.length(s["sb"]))
    whole = F.array("s.sa", "s.sb")
    s = F.col("s")
    words = F.concat(whole, F.flatten(F.transform(places(s), lambda j: F.array(head(s, j), tail(s, j)))))
    asked = cells.select("doc_id", "row_no", "col", F.explode("seams").alias("s")).where(fits(s)).select("doc_id", "row_no", "col", F.explode(F.array_distinct(words)).alias("word"))
    known = known_words(asked, dictionary).groupBy("doc_id", "row_no", "col").agg(F.collect_set("word").alias("known"))
    open_ = cells.join(known, ["doc_id", "row_no", "col"])

    def cut(x: Column) -> Column:
        """The place of the cut at a seam, or null."""
        good = F.filter(places(x), lambda j: F.array_contains("known", head(x, j)) & F.array_contains("known", tail(x, j)))
        return F.when(fits(x) & ~F.array_contains("known", x["sa"]) & ~F.array_contains("known", x["sb"]), F.get(good, F.lit(0)))

    found = open_.withColumn("cut", F.transform("seams", cut))
    acting = found.withColumn("fire", fires(F.transform("cut", lambda j: j.isNotNull()), F.col("lines"))).where(F.exists("fire", lambda f: f))
    at = lambda k: F.coalesce(F.get("cut", k), F.lit(0))
    new = _moved(F.col("lines"), F.col("fire"), lambda b, k: F.substring(b, F.lit(1), at(k)), lambda b, k: F.substring(b, at(k) + 1, F.length(b)))
    fixed = acting.select("doc_id", "row_no", "col", new.alias("new"), F.format_string("%d spaces restored", F.size(F.filter("fire", lambda f: f))).alias("note"))
    return _apply_lines(rows, spec, fixed, "swallowed-space")


# --- mechanical ------------------------------------------------------------------------------------------------------


def per_piece(rows: DataFrame, spec: TableSpec, columns: list[int], op: str, f: Callable[[Column], Column]) -> DataFrame:
    """Applies a text function to the pieces of some columns and notes the cells that it changed."""
    if not columns:
        return rows
    new = {f"c{i}": F.transform(F.col(f"c{i}"), lambda p: with_text(p, f(p["text"]))) for i in columns}
    changed = [F.when(texts(new[f"c{i}"]) != texts(F.col(f"c{i}")), F.array(note(op, i, F.lit("collapsed")))).otherwise(F.array().cast(NOTES)) for i in columns]
    return rows.select(*[new[c].alias(c) if c in new else F.concat("_notes", *changed).alias(c) if c == "_notes" else F.col(c) for c in rows.columns])


def collapse_cjk_spaces(rows: DataFrame, spec: TableSpec) -> DataFrame:
    return per_piece(rows, spec, [i for i, c in enumerate(spec.columns) if c.kind == "cjk"], "cjk-space", collapse_cjk)


def collapse_double_spaces(rows: DataFrame, spec: TableSpec) -> DataFrame:
    return per_piece(rows, spec, list(range(spec.n)), "double-space", soft)


def complete_from_reference(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """R7 on rows beside their reference: a cell that lacks up to 14 characters of it, all else being there in a row, takes the reference."""
    said = []
    new = {}
    for i, c in enumerate(spec.columns):
        if i == spec.anchor.column:
            continue
        got, ref = hard(joined(F.col(f"c{i}"), c.kind)), hard(target(i))
        fits = F.col("values").isNotNull() & (target(i) != "") & (got != "") & (F.instr(ref, got) > 0) & (F.length(ref) - F.length(got)).between(1, MAX_COMPLETION)
        first = F.get(F.col(f"c{i}"), F.lit(0))
        new[f"c{i}"] = F.when(fits, F.array(with_text(first, target(i)))).otherwise(F.col(f"c{i}")).alias(f"c{i}")
        said.append(F.when(fits, F.array(note("complete", i, joined(F.col(f"c{i}"), c.kind)))).otherwise(F.array().cast(NOTES)))
    return rows.select(*[new[c] if c in new else F.concat("_notes", *said).alias(c) if c == "_notes" else F.col(c) for c in rows.columns])


def repair(rows: DataFrame, spec: TableSpec, targets: DataFrame | None = None, dictionary: DataFrame | None = None, max_window: int = MAX_WINDOW, keep: Callable[[DataFrame], DataFrame] = stored) -> Repaired:
    """All repairs in their order: overflow and windows (with a reference), words and spaces (with a dictionary), spaces, completion.

    ``targets`` has doc_id, row_no and values; ``keep`` stores an intermediate, since
    the log shares its plan with the rows.
    """
    now = rows.withColumn("_notes", F.array().cast(NOTES))
    spark = rows.sparkSession
    reassigned = spark.createDataFrame([], "doc_id string, row_no long")
    windows = None
    now = beside(now, targets) if targets is not None else now.withColumn("values", F.lit(None).cast("array<string>"))
    if targets is not None:
        now = keep(move_overflow_back(now, spec))
        moved = noted(now).where("op = 'move-overflow'").select("doc_id", "row_no")
        now, windows = reassign_windows(now, spec, max_window, keep)
        reassigned = moved.union(windows.where("touched").select("doc_id", "row_no")).distinct()
        now = keep(now)
    if dictionary is not None:
        now = keep(swallowed_spaces(keep(split_words(now, spec, dictionary)), spec, dictionary))
    now = collapse_double_spaces(collapse_cjk_spaces(now, spec), spec)
    if targets is not None:
        now = complete_from_reference(now, spec)
    now = keep(now)
    log = noted(now)
    if windows is not None:
        log = log.union(windows.where("note IS NOT NULL").select("doc_id", "row_no", "col", F.lit("reassign-window").alias("op"), "note"))
    completions = noted(now).where("op = 'complete'").select("doc_id", "row_no", "col", F.col("note").alias("candidate"))
    return Repaired(now.drop("_notes"), log, completions, reassigned)

