"""Toxicity, PII, packing and WARC against brute force, planted cases and round trips."""

import gzip
import hashlib
import itertools
import json
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest

from meshlark.llm import packing, pii, toxicity, warc

# Toxicity


def labelled(n, seed=3):
    rng = random.Random(seed)
    plain, bad = [f"word{i}" for i in range(200)], ["nasty", "vile", "rotten"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(30, 120))]
        if toxic:
            words += [rng.choice(bad) for _ in range(max(1, len(words) // 40))]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = labelled(800)
    docs = spark.createDataFrame([(i, t, "x", 5.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    model = toxicity.learn(docs, labels)
    words = toxicity.WordMargins(model.margin)
    words.learn(["nasttty", "word17"])
    assert words["nasttty"] > words["word17"] + 5


def test_toxicity_edges(spark):
    rows = labelled(100)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "nasty vile"), (900, None), (901, ""), (902, "123 !!")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 104 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", ".", "-", "+", "1", "23", "4", " ", "(", ")", "x@y.z", "4111 1111 1111 1111", "256", "10.0.0.1", "é", "+1 (202) 555-0123", "..", "%", "@@"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


PLANTED = [
    ("mail bob at example dot com now", "email", "bob at example dot com"),
    ("bob [at] mail.example (dot) org.", "email", "bob [at] mail.example (dot) org"),
    ("ｂob＠example.com x", "email", "ｂob＠example.com"),
    ("bоb@examрle.com", "email", "bоb@examрle.com"),
    ("ip one nine two dot one six eight dot one dot two ok", "ip", "one nine two dot one six eight dot one dot two"),
    ("plus one two three, five five five one two one two", "phone", "plus one two three, five five five one two one two"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("bo​b@exam​ple.com", "email", "bo​b@exam​ple.com"),
]


@pytest.mark.parametrize("text, kind, want", PLANTED)
def test_disguises_map_back_to_the_source(text, kind, want):
    assert (kind, want) in [(k, text[s:e]) for k, s, e in pii.all_spans(text)]


ANY_TEXT = [
    ("john at example[.]com", "email", "john at example[.]com"),
    ("john { at } example.com", "email", "john { at } example.com"),
    ("john < at > example.com", "email", "john < at > example.com"),
    ("john [\tat\t] example.com", "email", "john [\tat\t] example.com"),
    ("john (  AT  ) example.com", "email", "john (  AT  ) example.com"),
    ("\u0130stanbul: bob at example dot com now", "email", "bob at example dot com"),
    ("\u0130 bob [at] mail.example (dot) org.", "email", "bob [at] mail.example (dot) org"),
]
NAMES = ["bob", "a_b", "mail", "com+x", "at", "dot", "ex-1", "7"]
SEPARATORS = [".", "@", " at ", " dot ", "[at]", " ( dot ) ", "{@}", " <.>\t", " AT\n", " Dot  "]


def slow_edits(text):
    """Every at of every chain, each with all local parts and domains tried by pattern, the longest taken, left to right."""
    dot = r"(?:\.|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)"
    ats = {"A": r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", "a": r"\s+at\s+", "@": "@"}
    name, part = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
    edits, taken = [], 0
    chain = re.compile(rf"(?<![A-Za-z0-9_%+-]){name}(?:(?:{dot}|{'|'.join(ats.values())}){name})+", re.I)
    for c in chain.finditer(text):
        bounds, pos = [], re.compile(name).match(text, c.start()).end()
        while pos < c.end():
            m = re.compile(rf"({dot}|{'|'.join(ats.values())}){name}", re.I).match(text, pos)
            bounds.append(m.span(1))
            pos = m.end()
        for s, e in bounds:
            kind = next((k for k, p in ats.items() if re.fullmatch(p, text[s:e], re.I)), None)
            if not kind or s <= taken:
                continue
            froms = [f for f in range(max(taken, c.start()), s) if re.fullmatch(rf"{name}(?:{dot}{name})*", text[f:s], re.I) and not re.match(r"[A-Za-z0-9_%+-]", text[f - 1 : f])]
            domain = re.compile(rf"{part}(?:{dot}{part})*", re.I).match(text, e, c.end())
            if not froms or not domain or not (dots := [b for b in bounds if e <= b[0] and b[1] <= domain.end()]):
                continue
            hidden = [b for b in dots if text[b[0] : b[1]] != "."]
            if kind == "A" or hidden:
                edits += [(x, y, "@" if (x, y) == (s, e) else ".") for x, y in bounds if froms[0] <= x and y <= domain.end() and text[x:y] not in (".", "@")]
            if kind == "A" or hidden or kind == "@":
                end = domain.end()
                while end < c.end() and re.match(r"[A-Za-z0-9_%+-]", text[end]):
                    end += 1
                taken = end
    return edits


def test_address_edits_equal_a_slow_search():
    rng = random.Random(12)
    some = 0
    for _ in range(6000):
        text = rng.choice(["", "x ", "see: "]) + rng.choice(NAMES) + "".join(rng.choice(SEPARATORS) + rng.choice(NAMES) for _ in range(rng.randint(1, 7))) + rng.choice(["", ".", " now", "@"])
        want = slow_edits(text)
        got = sorted(e for m in pii._CHAIN.finditer(text) for e in pii.chain_edits(text, m.start(), m.end()))
        assert got == want, text
        some += bool(want)
    assert some > 1500


@pytest.mark.parametrize("piece", ["a dot ", "a at ", "one ", "( ", "1 ", "a@", "a.", "[at]", "plus ", "+1(", "a at b dot c ", "\t(\t", "1.", "one1 ", "a_[at]", "x" * 999 + " "])
def test_a_megabyte_of_disguises_takes_seconds(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 6


ZEROS = [chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0]


@pytest.mark.parametrize("text, kind, want", ANY_TEXT)
def test_disguises_are_found_whatever_else_the_text_holds(text, kind, want):
    assert (kind, want) in [(k, text[s:e]) for k, s, e in pii.all_spans(text)]


def test_digits_of_every_script_are_read():
    assert len(ZEROS) > 60
    for zero in ZEROS:
        card = "".join(chr(ord(zero) + int(d)) for d in "4111111111111111")
        assert ("card", 2, 18) in pii.all_spans(f"a {card} b"), hex(ord(zero))
    assert pii.all_spans("smile \U0001f600 \U0001f600 4") == []


def test_plain_words_are_left_alone():
    for text in ("we met at noon", "one two three", "look at this. dot your i", "Zero tolerance at home", "a dot b at c"):
        assert pii.all_spans(text) == []


def test_pii_rows_and_redaction(spark):
    rows = [(1, "x@y.org and x@z.org 10.1.2.3"), (2, None), (3, ""), (None, "+1 (202) 555-0123"), (1, "x@y.org and x@z.org 10.1.2.3"), (4, "a" * 200000 + " 4111111111111111")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.find_pii(df).collect()), key=repr)
    want = []
    for i, t in rows:
        spans = plain_spans(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((i, *[sum(k == x for k, _, _ in spans) for x in PATTERNS], hashlib.sha256(joined.encode()).hexdigest(), joined, 0))
    assert got == sorted(want, key=repr)
    masked = pii.redact_documents(df).select("text", "spans").collect()
    assert masked[0].text == "[EMAIL] and [EMAIL] [IP]" and masked[1].text is None and masked[0].spans == "clash"
    assert pii.find_pii(df.limit(0)).count() == 0


# Packing


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(6)
    for _ in range(40):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 12))]
        counted = sorted({n: lengths.count(n) for n in lengths}.items())
        for k in (1, 2, 3):
            edges = packing.best_boundaries([n for n, _ in counted], [c for _, c in counted], k)
            distinct = [n for n, _ in counted]
            best = min(padding(lengths, [*c, distinct[-1]]) for m in range(k) for c in itertools.combinations(distinct[:-1], m))
            assert edges[-1] == distinct[-1] and len(edges) <= k and padding(lengths, edges) == best


def test_packed_batches(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([3, 5, 90, 400, 3000, 0]), "x") for i in range(400)] + [(None, None, None), (7, "a b", None), (7, "a b", None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), budget=2000, buckets=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len and r.padding == r.bucket_len - r.n_tokens
        by.setdefault((r.bucket, r.batch), []).append((r.slot, r.bucket_len))
    for (bucket, _), slots in by.items():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
        assert len(slots) * slots[0][1] <= 2000 or len(slots) == 1
    for b in {k for k, _ in by}:
        full = max(1, 2000 // max(1, next(s[0][1] for (k, _), s in by.items() if k == b)))
        sizes = sorted(len(s) for (k, _), s in by.items() if k == b)
        assert sizes.count(full) >= len(sizes) - 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundaries_of_long_documents_are_optimal():
    rng = np.random.default_rng(9)
    for top, n in ((30_000, 400), (2_500, 300), (10**12, 200)):
        lengths = np.unique(rng.integers(0, top, n))
        counts = rng.integers(1, 50, len(lengths))
        edge, upto = [int(x) for x in lengths], [0, *np.cumsum(counts).tolist()]
        cost = [edge[j] * upto[j + 1] for j in range(len(edge))]
        for buckets in range(1, 7):
            edges = packing.best_boundaries(lengths, counts, buckets)
            assert len(edges) <= buckets and edges[-1] == edge[-1]
            spent = sum(min(e for e in edges if e >= x) * c for x, c in zip(edge, counts.tolist(), strict=True))
            assert spent == cost[-1]
            cost = [min([cost[j], *[cost[k] + edge[j] * (upto[j + 1] - upto[k + 1]) for k in range(j)]]) for j in range(len(edge))]


def test_batches_do_not_depend_on_the_order_of_rows(spark):
    rows = [(3 if i % 2 else None, "w " * (i * 31 % 90)) for i in range(200)]
    got = sorted(map(repr, packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), budget=500, buckets=5).collect()))
    again = packing.pack(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), budget=500, buckets=5)
    assert sorted(map(repr, again.collect())) == got


# WARC


def test_round_trip(spark, tmp_path):
    big = "<p>" + "same page " * 20
    rows = [(5, "http://a/1", big), (2, None, big), (9, "http://a\r\nX: 1", big), (3, "u", None), (4, "u", "short"), (1, "u", "short"), (None, "u", big), (2, None, big), (6, "u", "é\r\n\r\nWARC/1.1\r\n" + "x" * 300000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    folder = f"file://{tmp_path}/w"
    got = warc.archive_and_read(df, folder).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        later = h == big and i is not None and i > 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if later else "response", 2 if later else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    whole = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w/whole").glob("*.gz")))
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(rows)
    for p in (tmp_path / "w/members").glob("*.warc.gz"):
        data = p.read_bytes()
        assert gzip.decompress(data).endswith(b"\r\n\r\n")
        for line in open(f"{p}.idx"):
            e = json.loads(line)
            assert zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31).startswith(b"WARC/1.1\r\n")
    assert warc.archive_and_read(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_broken_archives_raise():
    for bad in (b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n", b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            [b"".join(block) for _, block in warc.RecordReader(iter([bad]))]


def test_members_of_any_number_are_inflated(tmp_path):
    p = tmp_path / "x.gz"
    p.write_bytes(gzip.compress(b"one") + gzip.compress(b"two") + b"\0" * 7)
    with warc.reading(str(p)) as f:
        assert b"".join(warc.inflated(f)) == b"onetwo"
