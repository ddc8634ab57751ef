"""Pages of PDF files as glyphs and rules, with the standard library alone.

Reads what text exporters write: classic and compressed objects, Flate streams, simple and two-byte fonts with their
widths and ToUnicode maps, text and path operators. Files are taken as hostile: sizes, depths and counts are bounded,
and what cannot be read raises ValueError. Encrypted files are refused. :func:`write_pdf` prints glyphs for tests.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from printloom.functions.typography import OTHER_ADVANCE, advance_map
from printloom.operators.geometry import GLYPH_SCHEMA
from printloom.sources.files import document_name

#: Bounds: bytes of a file, of a stream unpacked, of all streams; objects; depth of nesting; operators of a page.
MAX_FILE, MAX_STREAM, MAX_TOTAL, MAX_OBJECTS, MAX_DEPTH, MAX_OPERATORS = 512 << 20, 64 << 20, 1 << 30, 2_000_000, 64, 5_000_000

_DELIMITERS = b"()<>[]{}/% \t\r\n\f\0"
_TOKEN = re.compile(rb"[^()<>\[\]{}/% \t\r\n\f\0]+")
_SPACE = re.compile(rb"(?:[ \t\r\n\f\0]|%[^\r\n]*)*")


class Name(str):
    pass


class Ref(int):
    pass


class Operator(str):
    pass


class Lexer:
    """Objects of PDF syntax from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def next(self, depth: int = 0):
        """The next object; None at the end or at a closing bracket."""
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        d = self.data
        self.at = _SPACE.match(d, self.at).end()
        if self.at >= len(d):
            return None
        c = d[self.at : self.at + 1]
        if c == b"/":
            m = _TOKEN.match(d, self.at + 1)
            self.at = m.end() if m else self.at + 1
            raw = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes((int(x[1], 16),)), raw).decode("latin-1"))
        if c == b"(":
            return self._string()
        if d.startswith(b"<<", self.at):
            self.at += 2
            out = {}
            while (key := self.next(depth + 1)) is not None:
                out[str(key)] = self.next(depth + 1)
            self.at = d.find(b">>", self.at) + 2
            return out
        if c == b"<":
            end = d.find(b">", self.at)
            if end < 0:
                raise ValueError("an open string")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while (item := self.next(depth + 1)) is not None:
                if item == "R" and isinstance(item, Operator) and len(out) >= 2:
                    out[-2:] = [Ref(out[-2])]
                else:
                    out.append(item)
            self.at = d.find(b"]", self.at) + 1
            return out
        if c in (b"]", b">"):
            return None
        m = _TOKEN.match(d, self.at)
        if not m:
            self.at += 1
            return self.next(depth)
        self.at = m.end()
        word = m[0]
        if re.fullmatch(rb"[+-]?\d+", word):
            if r := re.compile(rb"[ \t\r\n\f\0]+\d+[ \t\r\n\f\0]+R(?![^()<>\[\]{}/% \t\r\n\f\0])").match(d, self.at):
                self.at = r.end()
                return Ref(word)
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def _string(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at]
            if c == 92:
                at += 1
                if m := re.compile(rb"[0-7]{1,3}").match(d, at):
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                e = d[at : at + 1]
                if e not in (b"\n", b"\r"):
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}.get(e, e)
            elif c == 40:
                depth += 1
                out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    self.at = at + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            at += 1
        raise ValueError("an open string")


class Document:
    """Objects of a file, found by their headers; the last one of a number counts."""

    def __init__(self, data: bytes):
        if len(data) > MAX_FILE or not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF, or too large")
        if re.search(rb"/Encrypt[ \t\r\n]+\d+", data):
            raise ValueError("encrypted")
        self.data, self.unpacked = data, 0
        self.objects: dict[int, tuple] = {}
        for m in re.finditer(rb"(?<!\d)(\d{1,9})[ \t\r\n]+\d+[ \t\r\n]+obj\b", data):
            self.objects[int(m[1])] = ("at", m.end())
            if len(self.objects) > MAX_OBJECTS:
                raise ValueError("too many objects")
        self.cache: dict[int, object] = {}
        for n in list(self.objects):
            value = self.get(Ref(n))
            if isinstance(value, tuple) and value[0].get("Type") == "ObjStm":
                self._packed(value)

    def _packed(self, stream: tuple) -> None:
        body, first = self.bytes_of(stream), int(self.get(stream[0].get("First", 0)))
        lexer = Lexer(body)
        heads = [(lexer.next(), lexer.next()) for _ in range(int(self.get(stream[0].get("N", 0))))]
        for n, at in heads:
            if isinstance(n, int) and isinstance(at, int) and n not in self.objects:
                self.objects[n] = ("value", Lexer(body, first + at).next())

    def get(self, x, depth: int = 0):
        if not isinstance(x, Ref):
            return x
        if depth > MAX_DEPTH:
            raise ValueError("references in a circle")
        if x not in self.cache:
            kind, where = self.objects.get(int(x), ("value", None))
            if kind == "value":
                self.cache[x] = where
            else:
                lexer = Lexer(self.data, where)
                value = lexer.next()
                if isinstance(value, dict) and (m := re.compile(rb"[ \t\r\n\f\0]*stream\r?\n").match(self.data, lexer.at)):
                    value = (value, m.end())
                self.cache[x] = value
        return self.get(self.cache[x], depth + 1)

    def bytes_of(self, stream: tuple) -> bytes:
        head, at = stream
        size = self.get(head.get("Length"))
        end = at + size if isinstance(size, int) and self.data[at + size : at + size + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", at)
        raw = self.data[at:end]
        filters = self.get(head.get("Filter"))
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} is not read")
            unpack = zlib.decompressobj()
            raw = unpack.decompress(raw, MAX_STREAM)
            if unpack.unconsumed_tail:
                raise ValueError("a stream is too large")
        self.unpacked += len(raw)
        if self.unpacked > MAX_TOTAL:
            raise ValueError("streams are too large")
        return raw

    def pages(self) -> list[dict]:
        root = next((v for n in self.objects if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Catalog"), None)
        if root is None:
            raise ValueError("no catalogue")
        out: list[dict] = []

        def walk(ref, inherited: dict, depth: int) -> None:
            node = self.get(ref)
            if depth > MAX_DEPTH or not isinstance(node, dict):
                raise ValueError("a broken page tree")
            own = inherited | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            if node.get("Type") == "Pages" or "Kids" in node:
                for kid in self.get(node.get("Kids")) or []:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        walk(root.get("Pages"), {}, 0)
        return out


class Font:
    def __init__(self, doc: Document, spec: dict):
        self.two = spec.get("Subtype") == "Type0"
        base = str(doc.get(spec.get("BaseFont")) or "")
        self.names: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.default = 600.0 if "Courier" in base else float(OTHER_ADVANCE)
        if self.two:
            inner = doc.get((doc.get(spec.get("DescendantFonts")) or [{}])[0]) or {}
            self.default = float(doc.get(inner.get("DW", 1000)))
            items = list(doc.get(inner.get("W")) or [])
            while items:
                first, second = items.pop(0), doc.get(items.pop(0)) if items else []
                if isinstance(second, list):
                    self.widths |= {first + i: float(w) for i, w in enumerate(second)}
                elif items:
                    self.widths |= dict.fromkeys(range(first, min(second, first + 65536) + 1), float(items.pop(0)))
        elif "Widths" in spec:
            first = int(doc.get(spec.get("FirstChar", 0)))
            self.widths = {first + i: float(doc.get(w)) for i, w in enumerate(doc.get(spec["Widths"]))}
        elif "Courier" not in base:
            self.widths = {ord(c): float(w) for c, w in advance_map().items()}
        if isinstance(table := doc.get(spec.get("ToUnicode")), tuple):
            self._map(doc.bytes_of(table))

    def _map(self, body: bytes) -> None:
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                self.names[int(a, 16)] = text(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
                for i in range(low, high + 1):
                    self.names[i] = text(c)[:-1] + chr(ord(text(c)[-1]) + i - low)

    def codes(self, data: bytes) -> Iterator[tuple[int, str]]:
        step = 2 if self.two else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step], "big")
            yield code, self.names.get(code) or (bytes((code,)).decode("cp1252", "replace") if not self.two else "�")


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def page_items(doc: Document, page: dict) -> tuple[list[tuple], list[tuple]]:
    """Glyphs (line_no, seq, ch, x0, y0, x1, y1, line_y) and boxes of paths (x0, y0, x1, y1), y growing downward from the top."""
    box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or (0, 0, 595, 842)]
    left, top = box[0], box[3]
    resources = doc.get(page.get("Resources")) or {}
    fonts = {k: doc.get(v) for k, v in (doc.get(resources.get("Font")) or {}).items()}
    loaded: dict[str, Font] = {}
    contents = doc.get(page.get("Contents"))
    parts = contents if isinstance(contents, list) else [contents]
    body = b"\n".join(doc.bytes_of(v) for p in parts if isinstance(v := doc.get(p), tuple))
    glyphs, boxes, stack = [], [], []
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    state = {"m": unit, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
    text, line, path, start = unit, unit, [], (0.0, 0.0)
    line_no, seq, count, args = -1, 0, 0, []
    line_key = None
    lexer = Lexer(body)

    def show(data: bytes) -> None:
        nonlocal text, line_no, seq, line_key
        if state["font"] is None:
            return
        for code, ch in state["font"].codes(data):
            w = state["font"].widths.get(code, state["font"].default) / 1000
            full = _times(text, state["m"])
            x0, base = full[4], full[5] + state["rise"]
            advance = (w * state["size"] + state["char"] + (state["word"] if code == 32 and not state["font"].two else 0)) * state["scale"]
            x1 = x0 + w * state["size"] * state["scale"] * full[0]
            height = state["size"] * abs(full[3] or 1.0)
            key = (round(base, 3), count if seq == 0 else None)
            if line_key is None or line_key[0] != key[0]:
                line_no, seq, line_key = line_no + 1, 0, key
            y0, y1 = top - base - 0.75 * height, top - base + 0.25 * height
            for c in ch:
                glyphs.append((line_no, seq, c, x0 - left, y0, x1 - left, y1, y0))
                seq += 1
            text = _times((1, 0, 0, 1, advance, 0), text)

    def add_box(points: list[tuple]) -> None:
        spots = [_times((1, 0, 0, 1, x, y), state["m"])[4:] for x, y in points]
        xs, ys = [p[0] - left for p in spots], [top - p[1] for p in spots]
        boxes.append((min(xs), min(ys), max(xs), max(ys)))

    while (item := lexer.next()) is not None or lexer.at < len(body):
        if item is None:
            lexer.at += 1
            continue
        if not isinstance(item, Operator):
            args.append(item)
            continue
        count += 1
        if count > MAX_OPERATORS:
            raise ValueError("too many operators")
        op, a, args = str(item), args, []
        n = [x for x in a if isinstance(x, (int, float))]
        if op == "q":
            stack.append(dict(state))
            if len(stack) > 1000:
                raise ValueError("nested too deeply")
        elif op == "Q" and stack:
            state = stack.pop()
        elif op == "cm" and len(n) == 6:
            state["m"] = _times(tuple(n), state["m"])
        elif op == "BT":
            text = line = unit
            line_key, seq = None, 0
        elif op == "Tf" and len(a) == 2 and isinstance(fonts.get(str(a[0])), dict):
            loaded.setdefault(str(a[0]), Font(doc, fonts[str(a[0])]))
            state["font"], state["size"] = loaded[str(a[0])], float(a[1])
        elif op in ("Tc", "Tw", "TL", "Ts", "Tz") and n:
            state[{"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "scale"}[op]] = n[0] / 100 if op == "Tz" else float(n[0])
        elif op in ("Td", "TD") and len(n) == 2:
            if op == "TD":
                state["lead"] = -n[1]
            text = line = _times((1, 0, 0, 1, n[0], n[1]), line)
        elif op == "Tm" and len(n) == 6:
            text = line = tuple(map(float, n))
        elif op in ("T*", "'", '"'):
            text = line = _times((1, 0, 0, 1, 0, -state["lead"]), line)
            if op != "T*" and a and isinstance(a[-1], bytes):
                show(a[-1])
        elif op == "Tj" and a and isinstance(a[0], bytes):
            show(a[0])
        elif op == "TJ" and a and isinstance(a[0], list):
            for x in a[0]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, (int, float)):
                    text = _times((1, 0, 0, 1, -x / 1000 * state["size"] * state["scale"], 0), text)
        elif op == "re" and len(n) == 4:
            path.append([(n[0], n[1]), (n[0] + n[2], n[1] + n[3])])
        elif op == "m" and len(n) == 2:
            start = (n[0], n[1])
        elif op == "l" and len(n) == 2:
            path.append([start, (n[0], n[1])])
            start = (n[0], n[1])
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            for points in path:
                add_box(points)
            path = []
        elif op == "n":
            path = []
    return glyphs, boxes


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _read(content: bytes, part: int) -> Iterator[tuple[int, list, str | None]]:
    """(page, items, error) of a file; a page or a whole file (page 0) that cannot be read gives an error and no items.

    Files come from anywhere, so whatever a damaged one raises counts.
    """
    try:
        doc = Document(content)
        pages = doc.pages()
    except Exception as e:  # noqa: BLE001
        yield 0, [], f"{type(e).__name__}: {e}"
        return
    for number, page in enumerate(pages, 1):
        try:
            items, error = page_items(doc, page)[part], None
        except Exception as e:  # noqa: BLE001
            items, error = [], f"{type(e).__name__}: {e}"
        yield number, items, error


def read_glyphs(spark: SparkSession, path: str) -> DataFrame:
    """Glyphs of all files under a path; a file is the unit of work and a document. Pages that cannot be read have none: see :func:`read_errors`."""
    def parse(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 5)
        names = ["doc_id", "page", "line_no", "seq", "ch", "x0", "y0", "x1", "y1", "line_y"]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, items, _ in _read(content, 0):
                    rows = [(document_name(file, path), number, *g) for g in items]
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _files(spark, path).mapInArrow(parse, GLYPH_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of painted paths of all files under a path: (doc_id, page, x0, y0, x1, y1)."""
    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for number, items, _ in _read(content, 1):
                    rows = [(document_name(file, path), number, *b) for b in items]
                    if rows:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), *[pa.float64()] * 4))], names=["doc_id", "page", "x0", "y0", "x1", "y1"])

    return _files(spark, path).mapInArrow(parse, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_pages) of all files under a path; 0 pages where a file cannot be read. Pages that cannot be read count, so a probe misses them."""
    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = max((number for number, _, _ in _read(content, 1)), default=0)
                yield pa.record_batch({"doc_id": pa.array([document_name(file, path)], pa.string()), "n_pages": pa.array([last], pa.int32())})

    return _files(spark, path).mapInArrow(parse, "doc_id string, n_pages int")


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, error) of what cannot be read; page 0 stands for a whole file."""
    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(document_name(file, path), number, error) for number, _, error in _read(content, 0) if error]
                yield pa.record_batch([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string()))], names=["doc_id", "page", "error"])

    return _files(spark, path).mapInArrow(parse, "doc_id string, page int, error string")


def write_pdf(path: str, glyphs: list, rules: list = (), advance: float = 4.0, size: tuple[float, float] = (842.0, 1191.0)) -> str:
    """One document's glyphs (rows of the glyph schema, Latin-1 characters) and rules as a file, for tests."""
    font_size = advance / 0.6
    pages: dict[int, dict[int, list]] = {}
    for g in glyphs:
        pages.setdefault(g["page"], {}).setdefault(g["line_no"], []).append(g)
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"}
    kids = []
    for number in sorted(pages):
        out = [f"{r['x0']} {size[1] - r['y1']} {r['x1'] - r['x0']} {r['y1'] - r['y0']} re f".encode() for r in rules if r["page"] == number]
        for line in sorted(pages[number]):
            out.append(b"BT")
            y = None
            for g in sorted(pages[number][line], key=lambda g: g["seq"]):
                char = g["ch"].encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
                y = size[1] - g["line_y"] - 0.75 * font_size
                out.append(f"/F1 {font_size:.6f} Tf 1 0 0 1 {g['x0']} {y:.6f} Tm (".encode() + char + b") Tj")
            out.append(b"ET")
        packed = zlib.compress(b"\n".join(out))
        n = max(objects) + 1
        objects[n] = f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream"
        objects[n + 1] = f"<< /Type /Page /Parent 2 0 R /Contents {n} 0 R >>".encode()
        kids.append(n + 1)
    objects[2] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /MediaBox [0 0 {size[0]} {size[1]}] /Resources << /Font << /F1 3 0 R >> >> >>".encode()
    body = b"%PDF-1.4\n"
    where = {}
    for n in sorted(objects):
        where[n] = len(body)
        body += f"{n} 0 obj\n".encode() + objects[n] + b"\nendobj\n"
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{where[n]:010d} 00000 n \n".encode() for n in sorted(objects))
    with open(path, "wb") as f:
        f.write(body + table + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(body)}\n%%EOF\n".encode())
    return path


__all__ = ["Document", "page_items", "read_errors", "read_glyphs", "read_pages", "read_rules", "write_pdf"]
