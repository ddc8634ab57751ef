"""Operators on documents, against plain versions of the same rules, with nulls, empty and long texts, and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from printloom.llm import bpe, langid, licenses, lm, media, mixing, pii, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "x" * 120_000), (904, "a b " * 30_000), (905, "same text here"), (905, "same text here"), (906, "中文 テスト 😀 é"), (None, "no id")]


def docs(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("k", "t", "h", "_key", "_hash", "fp", "hash", "doc")}).repartition(3)


@pytest.fixture(scope="module")
def sample(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))


# --- personal data -----------------------------------------------------------------------------------------------------

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_pii(text):
    def fits(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PII) for m in re.finditer(p, text or "") if fits(k, m[0]))


def test_pii_base_spans(spark, sample):
    rng = random.Random(3)
    parts = ["@", "a", "b.c", "._", "%", "+1", "+", "12", "3", " ", "-", ".", "(", ")", "255", "0001", "4111 1111 1111 1111", "x@y.zz", "é", "\n", "192.168.0.1", "+1 (555) 123-4567", "_d@e.f"]
    texts = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(800)]
    texts += [(1000 + i, t) for i, t in sample] + ODD[:-3] + [(910, "a@b" + ".c" * 20_000), (911, "+1" + " " * 20_000)]
    want = dict(texts)
    for r in pii.find_pii(docs(spark, texts)).collect():
        spans = plain_pii(want[r["doc_id"]])
        said = ",".join(f"{PII[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert {x for x in said.split(",") if x} <= set(r["spans"].split(","))


def test_pii_patterns_discover_identifiers(spark):
    texts = [(i, f"Please note card number: {n} issued by bank.") for i, n in enumerate(["4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009", "6011 0000 0000 0004"])]
    texts += [(10, "card number: 4999-1234-77 issued later"), (11, "page number 123456 was torn"), (12, "nothing here"), (None, "card number: 4999-1234-77 issued later")]
    got = by_id(pii.find_pii(docs(spark, texts)))
    found = {r["doc_id"]: (r["n_discovered"], r["spans"]) for r in got}
    assert found[10] == (1, "card:13:25") and found[None] == (1, "card:13:25")
    assert found[11][0] == 0 and found[12] == (0, "") and all(found[i][0] == 0 for i in range(4))


# --- media -------------------------------------------------------------------------------------------------------------


def test_media_is_lossless(spark, sample):
    texts = sample[:40] + ODD
    rows = media.digest_texts(docs(spark, texts)).collect()
    want = sorted(((hashlib.sha256(media.padded((t or "").encode())).hexdigest(), zlib.crc32(media.padded((t or "").encode())[-64:]), len((t or "").encode())) for _, t in texts))
    assert sorted((r["payload_sha256"], r["tail_crc32"], r["n_bytes"]) for r in rows) == want
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 905}
    assert len(same) == 1
    assert media.digest_texts(docs(spark, texts).limit(0)).count() == 0


class Writer:
    """A general encoder of progressive scans, with codes of several lengths and runs, for the decoder's general path."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def data(self):
        b = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(b, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def test_general_progressive_files(spark):
    """A grey image whose coefficients have zeros, runs and refinements, written here and read by the operator."""
    rng = np.random.default_rng(5)
    blocks = np.zeros((6, 64), np.int64)
    blocks[:, 0] = rng.integers(-40, 40, 6)
    for b in (0, 1, 3, 5):
        at = rng.choice(np.arange(1, 64), 9, replace=False)
        blocks[b, at] = rng.integers(-9, 10, 9)
    symbols = list(range(256))
    codes = {s: s for s in symbols}  # all codes nine bits long: 0 to 255
    table = lambda kind: media._segment(0xC4, bytes((kind << 4, *[0] * 8, 255, *[0] * 7, *symbols[:255])))
    size = lambda v: int(abs(v)).bit_length()
    extra = lambda v: v if v > 0 else v + (1 << size(v)) - 1
    dc, last = Writer(), 0
    for v in blocks[:, 0] >> 1:
        d = int(v - last)
        last = int(v)
        dc.put(codes[size(d)], 9)
        dc.put(extra(d), size(d))
    refine_dc = Writer()
    for v in blocks[:, 0]:
        refine_dc.put(int(v) & 1, 1)
    first, half = Writer(), np.sign(blocks) * (np.abs(blocks) >> 1)
    run = 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            first.put(codes[n << 4], 9)
            first.put(run - (1 << n), n)
            run = 0

    for b in half:
        zeros = 0
        nonzero = [k for k in range(1, 64) if b[k]]
        for k in range(1, (nonzero[-1] + 1) if nonzero else 1):
            if not b[k]:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                first.put(codes[0xF0], 9)
                zeros -= 16
            first.put(codes[zeros << 4 | size(b[k])], 9)
            first.put(extra(int(b[k])), size(b[k]))
            zeros = 0
        run += not nonzero or nonzero[-1] < 63
    flush()
    refine = Writer()
    for b, old in zip(blocks, half):
        new = [k for k in range(1, 64) if abs(b[k]) == 1]
        k, zeros, pending = 1, 0, []
        end = max(new, default=0)
        while k <= end:
            if old[k]:
                pending.append(int(abs(b[k])) & 1)
            elif abs(b[k]) == 1:
                refine.put(codes[zeros << 4 | 1], 9)
                refine.put(int(b[k] > 0), 1)
                [refine.put(x, 1) for x in pending]
                zeros, pending = 0, []
            else:
                if zeros == 15:
                    refine.put(codes[0xF0], 9)
                    [refine.put(x, 1) for x in pending]
                    zeros, pending = 0, []
                else:
                    zeros += 1
            k += 1
        refine.put(codes[0], 9)
        [refine.put(int(abs(b[j])) & 1, 1) for j in range(end + 1, 64) if old[j]]
    head = b"\xff\xd8" + media._QUANT + media._segment(0xC2, bytes((8, 0, 13, 0, 20, 1, 1, 0x11, 0))) + table(0) + table(1)
    scan = lambda ss, se, ah, al, w: media._segment(0xDA, bytes((1, 1, 0, ss, se, ah << 4 | al))) + w.data()
    file = head + scan(0, 0, 0, 1, dc) + scan(1, 63, 0, 1, first) + scan(0, 0, 1, 0, refine_dc) + scan(1, 63, 1, 0, refine) + b"\xff\xd9"
    image = media.Image(file)
    assert (image.coefs[0] == blocks).all()
    assert image.rgb().shape == (13, 20, 3)
    df = spark.createDataFrame([(1, bytearray(file)), (2, None)], "doc_id long, media binary")
    got = {r["doc_id"]: (r["height"], r["width"], r["rgb"] and len(r["rgb"])) for r in media.decode_media(df).collect()}
    assert got == {1: (13, 20, 780), 2: (None, None, None)}


def test_stored_media_decodes_from_its_column(spark):
    stored = media.store_texts(docs(spark, [(1, "hello " * 100)]))
    assert media.Image(bytes(stored.first()["media"])).stored() == media.padded(b"hello " * 100)
    r = media.decode_media(stored).first()
    assert r["height"] % 16 == 0 and len(r["rgb"]) == r["height"] * r["width"] * 3


# --- secrets -----------------------------------------------------------------------------------------------------------


def plain_secrets(t):
    t = t or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def token(prefix, body):
    return f"{prefix}_{body}{secrets.base62_crc(body)}"


def test_secret_base_spans(spark, sample):
    rng = random.Random(8)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "Secret", '"', "'", " ", "=", ":", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n", "ſecret", "f" * 24]
    texts = [(10_000 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(15)))) for i in range(2000)] + [(5000 + i, t) for i, t in sample] + ODD[:-3]
    want = dict(texts)
    for r in secrets.scan_secrets(docs(spark, texts)).collect():
        spans = plain_secrets(want[r["doc_id"]])
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(said.encode()).hexdigest(), said)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_many_spans_behind_other_letters(spark):
    t = "é token=abcdef12 " * 3000
    assert secrets.find_secrets(t) == [x for i in range(3000) for x in [(17 * i + 2, 0, 17 * i + 16)]]
    assert secrets.scan_secrets(docs(spark, ODD).limit(0)).count() == 0


def test_checksums_decide():
    good = token("ghp", "Ab1" * 10)
    assert [secrets.KINDS[k] for _, k, _ in secrets.find_secrets(f"é {good} x")] == ["github"]
    assert secrets.find_secrets(f"é {good} x")[0][::2] == (2, 42)
    assert not secrets.find_secrets(good[:-1] + ("A" if good[-1] != "A" else "B"))
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    full = raw + hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    number, word = int.from_bytes(full, "big"), ""
    while number:
        number, d = divmod(number, 58)
        word = secrets.BASE58[d] + word
    assert word.startswith("xprv") and [secrets.KINDS[k] for _, k, _ in secrets.find_secrets(word)] == ["xprv"]
    assert not secrets.find_secrets(word[:-1] + ("1" if word[-1] != "1" else "2"))


def test_redaction_keeps_clean_texts(spark):
    texts = [(1, "clean é text"), (2, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'), (3, None), (4, "")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs(spark, texts)).collect()}
    assert got[1] == texts[0][1] and got[3] is None and got[4] == ""
    assert got[2] == 'x [REDACTED assign]" y' and not secrets.find_secrets(got[2])


# --- BPE ---------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, sample):
    import tokenizers

    library, own = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    rng = random.Random(1)
    parts = ["  ", " ", "\n", "\t", "'", "'s", "'re", "'ll", "!", "a", "Z", "jq", "1", "23", "é", "à", "à ", "中", "😀", "  ", "　", "<|endoftext|>", "<|", "the", " the", "\r\n", ".", "_", "zxqj"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["".join(rng.choice("qwertzuiopasdfghjklyxcvbnmQWERTZ0123456789'") for _ in range(rng.randrange(40, 200))) for _ in range(500)] + [t for _, t in sample[:60]]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == want and own.notation(got) == ",".join(map(str, want))
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_a_small_memory_gives_the_same():
    a, b = bpe.Codec(bpe.default_path()), bpe.Codec(bpe.default_path(), memo=2)
    for t in ("one two three four two one", "x" * 5000, "zq" * 300):
        assert a.encode(t).tolist() == b.encode(t).tolist()


def test_bpe_query_and_decoding(spark):
    got = bpe.encode(docs(spark, ODD), with_ids=True)
    rows = got.collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r["doc_id"] in (900, 901)]
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(got).collect()}
    assert all(texts[i] == (t or "") for i, t in ODD)


# --- licences ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def license_model(sample):
    return licenses.train([t.split("\n")[0] for _, t in sample])


def test_statements_are_recognised(license_model):
    for family, own in licenses.STATEMENTS.items():
        assert all(license_model.classify(s)[0] == family for s in own)
    assert all(license_model.classify(s)[0] == licenses.UNKNOWN for s in (*licenses.ALIKE, "", "word " * 5000))


def test_skipping_by_anchors_changes_nothing(spark, license_model, sample):
    import dataclasses

    slow = dataclasses.replace(license_model, anchors=("",))
    for _, t in [*sample[:80], (0, WRAPPED)]:
        assert license_model.scan(t) == slow.scan(t)
    rows = by_id(licenses.scan_licenses(docs(spark, [*ODD, (1, "é\nReleased under the MIT License.\nx")]), license_model))
    assert (rows[0]["families"], rows[0]["spans"]) == ("mit", "mit:2:33") and len(rows) == len(ODD) + 1
    assert licenses.scan_licenses(docs(spark, ODD).limit(0), license_model).count() == 0


WRAPPED = """// Copyright 2020 Somebody
//
// Permission to use, copy, modify, and/or distribute this software for
// any purpose with or without fee is hereby granted, provided that the
// above copyright notice and this permission notice appear in all copies.

Some words of the author.
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""


def test_wrapped_notices_and_short_ones_are_found(license_model):
    got = [(f, WRAPPED[a:b].split()[1], WRAPPED[a:b].split()[-1]) for f, a, b, _ in license_model.scan(WRAPPED)[1]]
    assert got == [("isc", "Permission", "copies."), ("gpl-3.0", "This", "version.")]
    for family, text in [("mit", "MIT License"), ("mit", "The MIT License (MIT)"), ("bsd", "Licensed under the BSD 3-Clause License"), ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("gpl", "GNU GENERAL PUBLIC LICENSE")]:
        assert license_model.classify(text)[0] == family


def test_recall_and_precision_on_notices_kept_apart(license_model, sample):
    """Notices wrapped at other widths, behind marks of comments, with words lost, and statements in other words."""
    import textwrap

    rng, right, found, asked = random.Random(12), 0, 0, 0
    apart = {
        "mit": ["Distributed under the terms of the MIT License", "The code is available under the MIT license."],
        "apache-2.0": ["This library is licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"],
        "bsd": ["This module is released under the BSD 3-Clause License", "Distributed under the BSD license"],
        "gpl-3.0": ["This program is licensed under the GNU General Public License, version 3 or later"],
        "gpl-2.0": ["The kernel is licensed under the GNU General Public License, version 2"],
        "lgpl": ["This software is licensed under the GNU Lesser General Public License, version 2.1"],
        "cc-by": ["This article is licensed under a Creative Commons Attribution 4.0 International License"],
        "mpl-2.0": ["Subject to the terms of the Mozilla Public License, version 2.0"],
    }
    cases = [(f, s) for f, own in apart.items() for s in own]
    for family, own in licenses.STATEMENTS.items():
        for s in own:
            for _ in range(3):
                words = [w for w in s.split() if len(s.split()) < 8 or rng.random() > 0.06]
                cases.append((family, textwrap.fill(" ".join(words), rng.choice((50, 64, 76)), initial_indent=(m := rng.choice(("", "# ", " * ", "// "))), subsequent_indent=m)))
    prose = [t for _, t in sample if t and not license_model.scan(t)[1]]
    for family, s in cases:
        got = [f for f, *_ in license_model.scan(f"{rng.choice(prose)}\n\n{s}\n\n{rng.choice(prose)}")[1]]
        asked, found, right = asked + 1, found + len(set(got)), right + (family in got)
    clean = sum(bool(license_model.scan(x)[1]) for x in licenses.ALIKE)
    print(f"recall {right / asked:.3f}, precision {right / (found + clean):.3f} of {asked}")
    assert right / asked >= 0.9 and right / (found + clean) >= 0.9


# --- languages ---------------------------------------------------------------------------------------------------------


def test_languages_of_documents_kept_apart(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(df, langid.training_rows())
    assert model.languages == ["de", "en", "es", "fr"] and (model.weights == 0).any()
    rows = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(~langid.training_rows()).collect()
    right = sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows)
    assert right > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, ODD), model).collect()}
    assert [odd[i][0] for i in (900, 901, 902)] == ["und"] * 3
    kept = langid.keep_identified(df.union(spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, None, None, None)], df.schema)))
    assert kept.count() >= 0.99 * df.count() and kept.where("doc_id >= 1000000").count() == 0


def test_signs_of_numbers_are_no_letters():
    assert not any(langid.has_letter(t) for t in (None, "", "½", "²", "①", "Ⅷ", "12_", "٣")) and all(map(langid.has_letter, ("a", "1ß", "中", "ª")))


def test_many_languages_and_repeated_rows_keep_the_sample_bounded(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other text", f"l{i % 30}", "s", 1) for i in range(300)] + [(1000, "the same text", "l1", "s", 1)] * 200
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 20)
    model = langid.fit(df, F.lit(True))
    assert len(model.languages) == 20 and "l1" in model.languages
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 2000)
    assert langid.fit(df, F.lit(True)).languages == model.languages
    assert langid.identify(df.limit(0), model).count() == 0 and langid.keep_identified(df.limit(0)).count() == 0


def plain_ftrl(examples, classes):
    """One weight at a time, by the published formulas."""
    import math

    z, n = {}, {}

    def weight(i, k):
        if abs(z.get((i, k), 0.0)) <= langid.L1:
            return 0.0
        v = z[i, k]
        return -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[i, k])) / langid.ALPHA + langid.L2)

    for _ in range(langid.PASSES):
        for at, x, label in examples:
            own = [*zip(at.tolist(), x.tolist()), (langid.BINS, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in own for k in range(classes)}
            logits = [sum(v * w[i, k] for i, v in own) for k in range(classes)]
            top = max(logits)
            total = sum(math.exp(v - top) for v in logits)
            for k in range(classes):
                error = math.exp(logits[k] - top) / total - (k == label)
                for i, v in own:
                    g, old = error * v, n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * w[i, k]
                    n[i, k] = old + g * g
    return weight


def test_ftrl_equals_a_plain_version():
    rng = np.random.default_rng(3)
    examples = []
    for _ in range(60):
        label = int(rng.integers(3))
        at = np.unique(rng.integers(label * 5, label * 5 + 12, 6))
        x = rng.random(len(at))
        examples.append((at, x / np.linalg.norm(x), label))
    weights, bias = langid.train_ftrl(examples, 3)
    plain = plain_ftrl(examples, 3)
    assert all(abs(weights[i, k] - plain(i, k)) < 1e-9 for i in range(25) for k in range(3))
    assert all(abs(bias[k] - plain(langid.BINS, k)) < 1e-9 for k in range(3))


def test_nothing_to_learn_from(spark):
    model = langid.fit(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert model.predict("words") == ("und", 0.0)


def test_parts_of_long_texts_count_the_same(monkeypatch):
    t = "Straße und Wörter, " * 50
    whole = langid.bin_counts(t)
    monkeypatch.setattr(langid, "PART", 37)
    assert (langid.bin_counts(t) == whole).all()


# --- language model ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [1, 100])
def test_base_scores_are_exact(spark, sample, monkeypatch, hot):
    import collections
    import math

    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    texts = [*sample[:120], *ODD]
    rows = lm.score(docs(spark, texts), lm.training_rows()).collect()
    counts = collections.Counter()
    for i, t in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*lm.words_of(t), b""])
    n, v = sum(counts.values()), len(counts)

    def plain(t):
        w = [*lm.words_of(t), b""]
        return len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)

    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == sorted(plain(t) for _, t in texts)
    assert {r["train_tokens"] for r in rows} == {n} and all(r["score"] <= 0 for r in rows)
    none = lm.score(docs(spark, texts[:3]), F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in none)


def test_the_filter_holds_classes_of_counts():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    n = rng.integers(1, 400, 2000)
    bits, lead = 1 << 14, 6
    maps = np.concatenate([lm.part_bits(lm.inner(keys[keys >> np.uint64(58) == p], 6), n[keys >> np.uint64(58) == p], bits) for p in range(64)])
    filled = lm.Filter(maps, bits, lead)
    q = filled.classes(keys)
    want = 1 + np.floor(np.log2(n)).astype(int)
    assert (q >= want).all() and (q == want).mean() > 0.95
    strange = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    assert (filled.classes(strange) > 0).mean() < 0.05


def test_packed_counts_return():
    n = np.array([1, 254, 255, 256, 70_000, 3], np.uint32)
    assert lm.unpacked(lm.packed(n), len(n)).tolist() == n.tolist()


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def plain_components(fps, ids):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            parent[root(int(j))] = root(i)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(groups[root(k)]) for k, i in enumerate(ids)}


def test_components_equal_brute_force(spark, sample):
    near = [(2000 + k, t.replace(" ", "  ", k)) for k, (_, t) in enumerate(sample[:20])] + [(3000 + k, t + f" word{k}") for k, (_, t) in enumerate(sample[:30])]
    texts = [*sample, *near, *[x for x in ODD if x[0] not in (None, 905)]]
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    ids = sorted(got)
    fps = np.array([int(got[i][0], 16) for i in ids], np.uint64)
    want = plain_components(fps, ids)
    assert {i: got[i][1] for i in ids} == want
    assert got[900][0] == got[901][0] == "0" * 16 and len(rows) == len(texts)
    assert [simhash.fingerprint(want_text) for want_text in ("Ab c", "aB  c\n")][0] == simhash.fingerprint("ab c")
    assert simhash.near_duplicates(docs(spark, texts).limit(0)).count() == 0


def test_dense_classes_are_divided_and_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 9))) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")

    def classes(found):
        parent = {x: x for x in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in found.collect():
            assert bin((r["a"] ^ r["b"]) & ((1 << 64) - 1)).count("1") <= 3
            parent[root(r["a"])] = root(r["b"])
        return sorted(sorted(y for y in signed if root(y) == x) for x in signed if root(x) == x)

    whole = classes(simhash.links(df))
    for small, bucket, step in ((2, 20, 50), (8, 5, 1), (300, 400, 1 << 17)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "STEP_ROWS", step)
        assert classes(simhash.links(df)) == whole


def test_fingerprints_equal_a_plain_version(sample):
    import xxhash

    for t in [t for _, t in sample[:30]] + ["", " ", "One", "one two", "A b c", "a b c a b c a b c a b c", "é É ſ K x"]:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = [x for x in re.split("[\x20\x09-\x0D]+", w) if x]
        own = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in own]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# --- mixing ------------------------------------------------------------------------------------------------------------


def test_poisson_counts_have_their_mean(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"))
    for rate in (0.3, 2.5, 11.0, 100.0, 399.0, 401.0, 5000.0):
        own = df if rate < 50 else df.limit(1500)
        n = [r[0] for r in own.select(mixing.poisson_count(F.lit(rate), mixing.uniform(F.lit(1), F.col("doc_id")))).collect()]
        assert abs(np.mean(n) - rate) < 5 * (rate / len(n)) ** 0.5 and abs(np.var(n) / rate - 1) < 0.2
    u = [r[0] for r in df.select(mixing.uniform(F.lit(1), F.col("doc_id"))).collect()]
    import math

    plain = []
    for x in u[:2000]:
        k, p = 0, math.exp(-2.5)
        total = p
        while x >= total:
            k += 1
            p *= 2.5 / k
            total += p
        plain.append(k)
    assert [r[0] for r in df.limit(2000).select(mixing.poisson_count(F.lit(2.5), mixing.uniform(F.lit(1), F.col("doc_id")))).collect()] == plain


def test_large_rates_are_inverted_as_small_ones_are(spark, monkeypatch):
    rates = [(x, u) for x in (50.0, 300.0, 390.0) for u in (0.0, 1e-9, 0.01, 0.5, 0.77, 0.999, 1 - 1e-9)]
    df = spark.createDataFrame(rates, "rate double, u double")
    plain = [r[0] for r in df.select(mixing.poisson_count(F.col("rate"), F.col("u"))).collect()]
    monkeypatch.setattr(mixing, "FROM_ZERO", 49.0)
    monkeypatch.setattr(mixing, "SPREAD", 7)  # 50 - 7 * sqrt(50) is just above 0
    later = [r[0] for r in df.where("u > 0").select(mixing.poisson_count(F.col("rate"), F.col("u"))).collect()]
    assert later == [n for n, (_, u) in zip(plain, rates) if u > 0]


def test_a_rate_of_ten_million(spark):
    rows = [(i, "t" * 1000, "en", "big", 1000) for i in range(100)] + [(1000, "x", "en", "small", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(df, {"small": 1.0}, epochs=100.0, key="doc_id").where("doc_id = 1000")
    assert abs(got.count() / 100 / 100_001 - 1) < 0.002
    huge = spark.createDataFrame([(1e7, 0.5)], "rate double, u double")
    assert abs(huge.select(mixing.poisson_count(F.col("rate"), F.col("u"))).first()[0] / 1e7 - 1) < 1e-6


def test_sources_reach_their_weights(spark):
    rows = [(i, "t" * 10, "en", "big" if i % 10 else "small", 10) for i in range(6000)] + [(None, None, None, None, None), (7000, "", "en", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("clash") for n in ("mix_copy", "mix_source", "rate", "doc", "n", "order")})
    got = mixing.mix_sources(df, {"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] / n["small"] - 1) < 0.1 and None not in n and got.columns == df.columns
    assert mixing.mix_sources(df.limit(0)).count() == 0
    once = mixing.mix_sources(df.drop("mix_copy"), details=True)
    assert {r["mix_copy"] for r in once.where("doc_id = 5").collect()} <= set(range(1, 50))
