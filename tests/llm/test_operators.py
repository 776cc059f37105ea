"""Every operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward tables."""

import base64
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from platgrid.llm import chat, common, decontam, licences, linededup, mixing, quality, simhash, substring, warc, webp

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "river stone market letter window garden engine silver travel doctor summer winter planet object report simple moment figure street animal number people school bridge".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    if extra:  # names that the operators use inside
        for c in ("row", "drop", "h1", "h2", "key", "first", "later", "n", "s", "k", "fp", "pop", "tile", "node", "u", "v", "want", "pos", "near", "line", "status", "at", "_id", "_y", "block", "slot", "weight"):
            df = df.withColumn(c, df["doc_id"].cast("string"))
    return df


def awkward(spark, extra=True):
    """Nulls in every column, an empty and a very long text, repeated rows, punctuation alone."""
    rng = random.Random(4)
    long = "\n".join(prose(rng, 30) for _ in range(2000))
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (3, long, "a"), (None, long, "b"), (None, None, None), (4, "!!! ...", "b"), (5, "word", "b"), (6, prose(rng, 60), "b"), (6, prose(rng, 60), "b")]
    return table(spark, rows, extra)


def empty(spark):
    return table(spark, [])


# 1


def test_webp_known_file():
    w, h, p = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (w, h, p.tolist()) == (1, 1, [0])


def test_webp_few_bytes_for_many_pixels(spark):
    small = bytearray(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    head = int.from_bytes(small[21:25], "little")
    for side, status in ((1000, "ok"), (16384, "size")):
        small[21:25] = (head & ~((1 << 28) - 1) | (side - 1) | (side - 1) << 14).to_bytes(4, "little")
        got = webp.decode_column(spark.createDataFrame([(bytearray(small),)], "webp binary")).selectExpr("status", "width", "size(pixels) n").first()
        assert got.status == status and (status != "ok" or (got.width, got.n) == (side, side * side))


def test_webp_near_table_is_in_order_of_distance():
    d = [(v >> 4) ** 2 + (8 - (v & 15)) ** 2 for v in webp.NEAR]
    assert len(set(webp.NEAR)) == 120 and d == sorted(d)


@pytest.mark.parametrize("transforms", ["", "p", "c", "g", "pg", "pcg", "gcp", "i", "ip"])
def test_webp_round_trip(transforms):
    rng = np.random.default_rng(len(transforms))
    for t in range(24):
        w, h = int(rng.integers(1, 40)), int(rng.integers(1, 20))
        p = [rng.integers(0, 2**32, w * h), rng.choice(rng.integers(0, 2**32, int(rng.integers(1, 40))), w * h), np.repeat(rng.integers(0, 2**32, w * h // 7 + 1), 7)[: w * h]][1 if "i" in transforms else t % 3].astype(np.uint32)
        f = webp.encode(p, w, transforms, int(rng.integers(0, 12)), [None, 2, 3][t % 3], bool(t % 4))
        assert webp.decode(f)[:2] == (w, h) and (webp.decode(f)[2] == p).all()


def test_webp_column(spark):
    good = webp.encode(np.arange(6, dtype=np.uint32), 3, "g")
    rows = [(1, bytearray(good), "x"), (2, None, "x"), (3, bytearray(b""), None), (4, bytearray(b"RIFF"), "x"), (None, bytearray(good[:-9]), "x"), (1, bytearray(good), "x")]
    got = webp.decode_column(spark.createDataFrame(rows, "width int, webp binary, other string")).collect()
    assert [r.status for r in got] == ["ok", "null", "empty", "container", "truncated", "ok"]
    assert got[0].pixels == list(range(6)) and (got[0].width, got[0].height) == (3, 2) and got[1].pixels is None and got[0].other == "x"
    assert webp.decode_column(spark.createDataFrame([], "id int, webp binary")).count() == 0


def test_webp_broken_data_never_crash():
    rng = random.Random(1)
    good = webp.encode(np.random.default_rng(0).integers(0, 2**32, 200).astype(np.uint32), 20, "pcg", 5)
    for _ in range(300):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(20, len(b))] = rng.randrange(256)
        try:
            webp.decode(bytes(b), 1 << 16)
        except webp.Broken:
            pass


# 2


def test_licences_held_out_and_found(spark):
    m = licences.model()
    assert m.held_out > 0.9
    rng = random.Random(2)
    rows = [(i, "\n".join([prose(rng, 20), line, prose(rng, 5)]), "a") for i, line in enumerate(t for ts in licences.TEMPLATES.values() for t in ts)]
    want = [f for f, ts in licences.TEMPLATES.items() for _ in ts]
    got = {r.doc_id: r for r in licences.scan(table(spark, rows)).where("line = 1").collect()}
    right = sum(i in got and got[i].family == f and got[i].confirmed for i, f in enumerate(want))
    assert right >= 0.95 * len(want)
    # a notice in the middle of a very long line
    one = licences.scan(table(spark, [(1, prose(rng, 500) + " Licensed under the Apache License, Version 2.0. " + prose(rng, 500), "a")])).collect()
    assert [(r.line, r.family, r.confirmed) for r in one] == [(0, "Apache-2.0", True)]


def test_licences_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice([prose(rng, 7), "Released under the MIT License.", "a license for the car", "under the GNU General Public License"]) for _ in range(6)), "a") for i in range(20)]
    m, want = licences.model(), set()
    for i, t, _ in rows:
        for k, line in enumerate(t.split("\n")):
            h = licences._tokens(line).hash
            family = m.judge(h)[0]
            if family < len(licences.FAMILIES) - 1 and m.similarity(h, family) >= licences.LEAST_HINT:
                want.add((i, k, licences.FAMILIES[m.judge(h)[0]]))
    assert {(r.doc_id, r.line, r.family) for r in licences.scan(table(spark, rows)).collect()} == want


def test_licences_two_notices_in_one_line(spark):
    rng = random.Random(4)
    notices = [licences.TEMPLATES["MIT"][1], licences.TEMPLATES["GPL"][3]]
    rows = [(i, " ".join([prose(rng, 30), notices[i % 2], prose(rng, 3000), notices[1 - i % 2], prose(rng, 40)]), "a") for i in range(4)]
    m, want = licences.model(), []
    for i, t, _ in rows:
        h, best = licences._tokens(t).hash, {}
        for k in range(0, len(h) - licences.UNIT + licences.UNIT // 2, licences.UNIT // 2):
            own = h[k : k + licences.UNIT]
            family, p = m.judge(own)
            s = m.similarity(own, family) if family < len(licences.FAMILIES) - 1 else 0
            if s >= licences.LEAST_HINT:
                best.setdefault(licences.FAMILIES[family], []).append((s >= licences.LEAST_SHARE, round(p, 4), round(s, 6)))
        want += [(i, 0, f, p, s, c) for f, (c, p, s) in ((f, max(v, key=lambda x: x[:2])) for f, v in best.items())]
    got = licences.scan(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.line, r.family, round(r.probability, 4), r.similarity, r.confirmed) for r in got) == sorted(want)
    assert all({("MIT", True), ("GPL", True)} <= {(r.family, r.confirmed) for r in got if r.doc_id == i} for i, *_ in rows)


def test_licences_awkward(spark):
    assert licences.scan(awkward(spark)).count() == 0
    notice = "Released under the MIT License."
    rows = [(None, notice, "a"), (1, notice, "a"), (1, notice, "a"), (2, f"\n\n{notice}\n{notice}\n", None), (3, "", "a"), (4, notice + " " + prose(random.Random(1), 9000) + " " + notice, "a")]
    got = sorted(((r.doc_id, r.line) for r in licences.scan(table(spark, rows, True)).where("family = 'MIT' and confirmed").collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, 2), (2, 3), (4, 0), (None, 0)]
    assert licences.scan(empty(spark)).count() == 0


# 3


def test_chat_prefixes(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, None, None), (1, 3, "assistant", None), (2, 0, "assistant", "first"), (None, 0, "assistant", "x"), (3, None, "assistant", "x"), (4, 0, "user", "alone"), (5, 1, "user", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as k", "2 as shown", "3 as t")
    got = sorted((r.conv_id, r.context_turns, r.prompt, r.reply) for r in chat.expand(df).collect())
    u, a, e = "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"
    assert got == [
        (1, 1, f"{u}hi{e}{a}", f"yo{e}"),
        (1, 3, f"{u}hi{e}{a}yo{e}{u}{e}{a}", e),
        (2, 0, a, f"first{e}"),
        (5, 0, a, f"a{e}"),
        (5, 1, f"{a}a{e}{a}", f"a{e}"),
    ]
    for r in chat.expand(df).collect():
        assert (r.prompt + r.reply)[r.train_start : r.train_end] == r.reply
    assert chat.expand(df.where("false")).count() == 0


# 4


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y)))
    return d[-1]


@given(st.binary(max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(97, 99)), max_size=5), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_band(a, edits, t):
    b = bytearray(a)
    for kind, at, c in edits:
        at = min(at, len(b))
        if kind == 0:
            b.insert(at, c)
        elif at < len(b):
            if kind == 1:
                del b[at]
            else:
                b[at] = c
    assert linededup.within([a], [bytes(b)], t)[0] == (edit_distance(a, bytes(b)) <= t)


def line_dedup_brute(rows, short=True):
    seen, out, exact = [], [], set()
    for i, t, *rest in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in t.split("\n"):
            b = line.encode()
            if len(b) >= linededup.LEAST_BYTES:
                if any(abs(len(b) - len(o)) <= linededup.THRESHOLD and edit_distance(b, o) <= linededup.THRESHOLD for o in seen):
                    seen.append(b)
                    continue
                seen.append(b)
            elif short and line in exact:
                continue
            elif short and line:
                exact.add(line)
            kept.append(line)
        out.append((i, "\n".join(kept), *rest))
    return out


def near_lines(rng, n_docs):
    pool = [prose(rng, rng.randrange(2, 9)) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            x = list(rng.choice(pool) if rng.random() < 0.7 else prose(rng, 6))
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(x) + 1)
                x[k : k + rng.randrange(2)] = rng.choice(["", "é", "q"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines), "a"))
    return rows


def test_line_dedup_brute_force(spark):
    rows = near_lines(random.Random(6), 40)
    for short in (True, False):
        got = sorted((r.doc_id, r.text) for r in linededup.line_dedup(table(spark, rows, True), short=short).collect())
        assert got == [(i, t) for i, t, _ in line_dedup_brute(rows, short)]


def dated_lines(rng, n):
    """Every document has the same line, and two log lines that differ in a day and a number alone."""
    rows = []
    for i in range(n):
        dated = [f"2024-03-{rng.randrange(1, 29):02d} INFO request {rng.randrange(10**4):04d} was served by the pool in time{'s' * rng.randrange(2)}" for _ in range(2)]
        rows.append((i, "\n".join(["All pages of this site carry this very line.", *dated]), "a"))
    return rows


def test_line_dedup_hot_keys(spark, monkeypatch):
    rows = dated_lines(random.Random(26), 60)
    want = [(i, t) for i, t, _ in line_dedup_brute(rows)]
    assert 60 < sum(t.count("\n") + 1 for _, t in want if t) < 2 * 60
    for pairs, held in ((100, 1 << 14), (20, 16)):
        monkeypatch.setattr(linededup, "HOT_PAIRS", pairs)
        monkeypatch.setattr(linededup, "HOT_ROWS", held)
        common.forget(spark)
        assert sorted((r.doc_id, r.text) for r in linededup.line_dedup(table(spark, rows, True)).collect()) == want
        assert any("line-finer" in p for p in common._stored)


def meetings(texts, chunk):
    """Rows that meeting() gives, and pairs among them, for the keys of texts that come in chunks of so many."""
    batches = []
    for at in range(0, len(texts), chunk):
        for _, x in linededup._chunked(pa.array(texts[at : at + chunk]), linededup.LEAST_BYTES):
            key, line, *_ = linededup.segment_keys(x, np.unique(x.h1, return_index=True)[1], linededup.THRESHOLD, linededup.LEAST_BYTES)
            batches.append((key.view(np.int64), x.h1[line].view(np.int64)))
    key, h = np.concatenate([k for k, _ in batches]), np.concatenate([h for _, h in batches])
    order = np.argsort(key, kind="stable")
    rows = [pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(h[o])], names=["key", "h1"]) for o in np.array_split(order, 7)]
    got = [r for b in linededup.meeting(linededup.HOT_PAIRS, linededup.HOT_ROWS)(iter(rows)) for r in b.to_pylist()]
    return len(got), {(r["a"], r["b"]) for r in got if not r["hot"]}


def test_line_dedup_meetings_follow_distinct_lines():
    rng = random.Random(27)
    near = ["a line that stands in every single document", "a line that stands in every single documents"]
    texts = [prose(rng, 8) + "\n" + "\n".join(near) for _ in range(800)]
    sizes = [meetings(texts[:n], 2) for n in (400, 800)]
    # however many chunks have the two lines, they meet once for each key that they share
    assert sizes[1][0] <= sizes[0][0] + 40 and sizes[0][0] <= 40 and len(sizes[0][1]) >= 1
    dated = ["\n".join(t for t in r[1].split("\n")) for r in dated_lines(rng, 800)]
    counts = [meetings(dated[:n], 2)[0] for n in (400, 800)]
    assert counts[0] > 400 and counts[1] <= 3 * linededup.HOT_PAIRS + 15 * (2 * 800 + 1)


def test_line_dedup_awkward(spark):
    df = awkward(spark)
    got = linededup.line_dedup(df).collect()
    assert linededup.line_dedup(df).columns == df.columns and len(got) == df.count()
    before = {(r.doc_id, r.text) for r in df.collect()}
    assert {(r.doc_id, r.text) for r in got} == before and all(r.n_chars is None or r.n_chars == len(r.text) for r in got)
    same = table(spark, [(2, "an equal line that is long enough\nrest", "a"), (1, "an equal line that is long enough", "a"), (9, "an equal line that is long enough", "a")])
    assert sorted((r.doc_id, r.text) for r in linededup.line_dedup(same).collect()) == [(1, "an equal line that is long enough"), (2, "rest"), (9, "")]
    assert linededup.line_dedup(empty(spark), count=True).count() == 0


def test_line_dedup_short_lines(spark):
    rows = near_lines(random.Random(16), 40) + [(100 + i, "Les.\n\nLes\n" + "é" * (i % 3) + "\nAll rights reserved.\n\n ", "a") for i in range(5)]
    seen, want = set(), []
    for (i, t, _), (_, kept, _) in zip(rows, line_dedup_brute(rows, False)):
        left, out = kept.split("\n"), []
        for line in t.split("\n"):
            n = len(line.encode())
            if n >= linededup.LEAST_BYTES:
                stays = left[:1] == [line]
            else:
                stays = n == 0 or line not in seen
                seen.add(line)
            if left[:1] == [line]:
                left.pop(0)
            if stays:
                out.append(line)
        want.append((i, "\n".join(out), len(t.split("\n")) - len(out)))
    got = linededup.line_dedup(table(spark, rows, True), count=True, short=True).collect()
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in got) == want


def test_pipeline_lines_lose_short_repeats(spark):
    import corpus_pipeline

    rows = [(1, "Les.\nAll rights reserved.", "a"), (2, "Les.\nmore\nAll rights reserved.", "a")]
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.lines(spark, table(spark, rows), "").collect()) == [(1, rows[0][1]), (2, "more")]


# 5


def leak_brute(rows, items):
    norm = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", t.lower()) if w]
    grams = {}
    for k, t in items:
        w = norm(t)
        if len(w) >= decontam.LEAST_WORDS:
            for j in range(max(1, len(w) - decontam.WINDOW + 1)):
                grams.setdefault(tuple(w[j : j + decontam.WINDOW]), set()).add(k)
    out = set()
    for i, t, _ in rows:
        w = norm(t or "")
        for n in {len(g) for g in grams}:
            for j in range(len(w) - n + 1):
                out |= {(i, k) for k in grams.get(tuple(w[j : j + n]), ())}
    return out


def leaky(rng):
    items = [(k, prose(rng, rng.choice([5, 8, 12, 13, 30, 60]))) for k in range(12)] + [(50, "Größe und Straße sind hier oft schön gebaut und weit bekannt im ganzen Land")]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 120)).split()
        if rng.random() < 0.5:
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            own = own[a : a + rng.randrange(8, 40)] if rng.random() < 0.5 else own
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," if rng.random() < 0.3 else x for x in own]
        rows.append((i, " ".join(w), "a"))
    return rows, items


def test_decontamination_brute_force(spark):
    rows, items = leaky(random.Random(7))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.leaks(table(spark, rows, True), bench).collect()
    want = leak_brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 10
    kept = decontam.decontaminate(table(spark, rows, True), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} - {i for i, _ in want}


def test_decontamination_awkward(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (None, prose(random.Random(1), 20))], "item_id bigint, text string")
    assert decontam.leaks(df, bench).count() == 0 and decontam.decontaminate(df, bench).count() == df.count()
    bench = spark.createDataFrame([(1, df.where("doc_id = 6").first().text)] * 2, "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()] == [(6, 1)]
    assert decontam.leaks(empty(spark), bench).count() == 0 and decontam.decontaminate(df, bench.limit(0)).count() == df.count()


def test_decontamination_short_items(spark):
    docs = table(spark, [(1, "Say, yes! and go", "a"), (2, "yesterday", "a"), (3, "is the\tmoon, far?", "a"), (4, "the moon", "a"), (5, "it is é", "a"), (6, None, "a")])
    bench = spark.createDataFrame([(1, "Yes"), (2, "the moon far"), (3, "É"), (4, "?!"), (5, ""), (6, prose(random.Random(1), 30))], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.first_at) for r in decontam.leaks(docs, bench).collect()) == [(1, 1, 4), (3, 2, 3), (5, 3, 6)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [2, 4, 6]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench, least_words=3).collect()) == [1, 2, 4, 5, 6]


def test_decontamination_in_parts(spark, monkeypatch):
    rng = random.Random(12)
    bench = [(k % 7, prose(rng, rng.choice([3, 20, 40]))) for k in range(12)] + [(None, prose(rng, 20))]
    rows = [(i, prose(rng, 20) + "\n" + (rng.choice(bench)[1] if i % 3 else "") + " " + prose(rng, 9), "a") for i in range(40)]
    docs, bench = table(spark, rows, True), spark.createDataFrame(bench, "item_id bigint, text string")
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    whole = key(decontam.leaks(docs, bench)), key(decontam.decontaminate(docs, bench))
    monkeypatch.setattr(decontam, "PART_BYTES", 300)
    assert whole[0] and (key(decontam.leaks(docs, bench)), key(decontam.decontaminate(docs, bench))) == whole


def test_decontamination_searches_items_without_id(spark):
    text = prose(random.Random(70), 20)
    docs = table(spark, [(1, "before " + text + " after", "a"), (2, "clean", "a")])
    bench = spark.createDataFrame([(None, text)], "item_id bigint, text string")
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2]
    assert decontam.leaks(docs, bench).count() == 0


# 6


def graded(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        w = prose(rng, rng.randrange(5, 80)).split()
        if not good:
            w = [[x.upper() + "!!" for x in w], [x + rng.choice(["###", "%%%"]) for x in w], [w[0]] * len(w)][i % 3]
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = graded(random.Random(8), 900)
    lab = spark.createDataFrame(labels[:600], "doc_id bigint, quality int, toxic int")
    df = table(spark, rows, True)
    w, threshold = quality.fit(df, lab)
    got = {r.doc_id: r for r in quality.classify(df, w, threshold).collect()}
    held = labels[600:]
    assert sum(got[i].quality_keep == bool(q) for i, q, _ in held) / len(held) > 0.97
    assert quality.quality_filter(df, lab).columns == df.columns
    # the same scores one text at a time
    alone = [quality.score_column(pa.array([t]), w, quality.QualityConfig().bits)[0] for _, t, _ in rows[:50]]
    assert np.allclose(alone, [got[i].quality_score for i in range(50)], atol=1e-5)


def quality_brute(texts, labels, config, scored):
    """The classifier with dictionaries and whole numbers in place of arrays: (threshold, scores)."""
    import math

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def vector(text):
        tokens = re.findall(r"[\w\u0080-\uffff]+|[!-/:-@\[-^`{-~]+", text)
        h = [mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(t.encode())) & mask) for t in tokens]
        repeat = int(quality.REPEAT)
        feats = h + [repeat if a == b else mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(h, h[1:])]
        feats += [repeat for i in range(len(h) - 2) if h[i] == h[i + 2] and re.match(r"\w", tokens[i])]
        count = {}
        for f in feats:
            count[f >> (64 - config.bits)] = count.get(f >> (64 - config.bits), 0) + 1
        value = {k: math.log2(1 + c) for k, c in count.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        return {k: v / norm for k, v in value.items()} | {"bias": 1.0}

    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= config.l1:
            return 0.0
        return -(z[k] - math.copysign(config.l1, z[k])) / ((config.beta + math.sqrt(n[k])) / config.alpha + config.l2)

    def probability(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    fit_to = len(labels) - int(len(labels) * config.held_out)
    share = sum(labels[:fit_to]) / fit_to
    xs, order = [vector(t) for t in texts], np.random.default_rng(17)
    for _ in range(config.epochs):
        for i in order.permutation(fit_to):
            p, w = probability(xs[i]), {k: weight(k) for k in xs[i]}
            for k, v in xs[i].items():
                g = (p - labels[i]) * v * (0.5 / share if labels[i] else 0.5 / (1 - share))
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / config.alpha * w[k]
                n[k] = old + g * g
    good = [probability(x) for x, y in zip(xs[fit_to:], labels[fit_to:]) if y]
    return min(0.5, float(np.quantile(good, 1 - config.keep_good))), [probability(vector(t)) for t in scored]


def test_quality_brute_force(spark):
    rows, labels = graded(random.Random(17), 120)
    config = quality.QualityConfig(bits=14, epochs=2)
    train, y = [t for _, t, _ in rows[:90]], [q for _, q, _ in labels[:90]]
    w, threshold = quality.train(train, y, config)
    want, scores = quality_brute(train, y, config, [t for _, t, _ in rows[90:]])
    assert abs(threshold - want) < 1e-4
    got = {r.doc_id: r for r in quality.classify(table(spark, rows[90:], True), w, threshold, config).collect()}
    assert np.allclose([got[i].quality_score for i, *_ in rows[90:]], scores, atol=1e-4)
    assert all(got[i].quality_keep == (got[i].quality_score >= threshold) for i, *_ in rows[90:])


def test_quality_awkward(spark):
    df = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality_filter(df, none).count() == df.count()
    lab = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (6, 0, None)], none.schema)
    got = quality.quality_filter(df.withColumn("quality_score", df["text"]), lab)
    assert {1, 2} <= {r.doc_id for r in got.collect()}
    assert quality.quality_filter(empty(spark), lab).count() == 0


# 7


def test_mixing_shares(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randrange(0, 400)), rng.choice(["big"] * 8 + ["small", None])) for i in range(300)]
    got = sorted(mixing.mix(table(spark, rows, True), {"big": 1, "small": 3}, 64).collect(), key=lambda r: r.slot)
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("big", "small", None)}
    assert [r.slot for r in got] == list(range(sum(-(-n // 64) for n in words.values())))
    for n in (50, 100, len(got)):  # a low-discrepancy schedule keeps to the weights all along
        assert abs(sum(r.source == "small" for r in got[:n]) - 0.75 * n) < 4
    big = {r.block: r for r in got if r.source == "big"}
    assert all(r.n_tokens == 64 == len(r.text.split()) for r in big.values() if r.block < words["big"] // 64)
    epochs = [(r.epoch, r.block) for r in got if r.source == "small"]
    assert epochs == [(k // -(-words["small"] // 64), k % -(-words["small"] // 64)) for k in range(len(epochs))]


def test_mixing_keeps_every_word(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(0, 90)), "ab"[i % 2]) for i in range(80)]
    b, sizes = mixing.blocks(table(spark, rows), 32)
    text = [w for r in b.collect() for w in r.text.split()]
    assert sorted(text) == sorted(w for _, t, _ in rows for w in t.split())
    assert {(r.s, r.blocks) for r in sizes.collect()} == {(s, len({r.block for r in b.where(f"s = '{s}'").collect()})) for s in "ab"}


def test_mixing_awkward(spark):
    df = awkward(spark)
    got = mixing.mix(df, block=512).collect()
    assert {r.source for r in got} <= {"a", "b", None} and len({r.slot for r in got}) == len(got) > 100
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(df, {}).count() == 0


# 8


def simhash_brute(rows):
    f, some = simhash.fingerprints(pa.array([t for _, t, *_ in rows], pa.string()))
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if some[a] and some[b] and np.bitwise_count(f[a] ^ f[b]).sum() <= simhash.RADIUS:
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                up[y] = x
    return {i: top(i) for i in up}


def copies(rng, n):
    base = [prose(rng, rng.randrange(20, 200)) for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 1 + len(w) // 20)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w), "a"))
    return rows


def test_simhash_ids_of_any_type(spark):
    rows = copies(random.Random(33), 40)
    named = table(spark, rows, True).selectExpr("concat('doc-', lpad(cast(doc_id as string), 6, '0')) as doc_id", "text", "source", "n")
    want = {(f"doc-{r.doc_id:06d}", f"doc-{r.group_id:06d}") for r in simhash.groups(table(spark, rows)).collect()}
    assert want and {(r.doc_id, r.group_id) for r in simhash.groups(named).collect()} == want
    assert simhash.near_dedup(named).count() == len(rows) - len([1 for a, b in want if a != b])


def fingerprint_brute(text):
    """Bit by bit, with whole numbers: words and pairs of words hashed, each bit by the majority of the distinct hashes."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    words = [mix(sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w.encode())) & mask) for w in re.findall(r"[\w\u0080-\uffff]+", text.lower())]
    feats = {h >> 21 for h in words} | {mix((a * 0x9E3779B97F4A7C15 + b) & mask) >> 21 for a, b in zip(words, words[1:])}
    out = []
    for w in range(simhash.WORDS):
        own = [mix((h + w * 0xA24BAED4963EE407) & mask) for h in feats]
        out.append(sum((2 * sum(h >> i & 1 for h in own) > len(own)) << i for i in range(64)))
    return out


def test_fingerprint_bit_by_bit():
    rng = random.Random(31)
    texts = [prose(rng, n) for n in (1, 2, 3, 10, 100, 700)] + ["Été, ÉTÉ! deux-mots", "a a a a", "", "..."]
    got, some = simhash.fingerprints(pa.array(texts))
    assert some.tolist() == [True] * 8 + [False] * 2
    assert [list(map(int, g)) for g in got[:8]] == [fingerprint_brute(t) for t in texts[:8]]


def test_fingerprint_is_the_majority():
    t = "one two three two one"
    f, some = simhash.fingerprints(pa.array([t, "", None, "?!"], pa.string()))
    assert some.tolist() == [True, False, False, False] and (f[1:] == 0).all()
    again, _ = simhash.fingerprints(pa.array(["x y z " * 100, t]))
    assert (again[1] == f[0]).all()


def test_pairs_within_brute_force():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, (300, simhash.WORDS), dtype=np.uint64)
    a[100:200] = a[:100] ^ (np.uint64(1) << rng.integers(0, 63, (100, simhash.WORDS)).astype(np.uint64))
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(2)
    for radius in (3, 4, 100):
        i, j = simhash.pairs_within(a, a, radius, True)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(300) for y in range(x + 1, 300) if d[x, y] <= radius}
        i, j = simhash.pairs_within(a[:130], a[130:], radius, False)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(130) for y in range(170) if d[x, y + 130] <= radius}


def prints_near(rng, n, radius):
    """n fingerprints, each pair of neighbours at most 2 bits from the radius; the bits that differ lie anyhow, evenly, or in few words."""
    a = rng.integers(0, 256, (n, 8 * simhash.WORDS), dtype=np.uint8).view(np.uint64)
    for i in range(0, n - 1, 2):
        k = radius - 2 + rng.integers(0, 5)
        where = [rng.permutation(256), (np.arange(256) * 37 + i) % 256, np.roll(np.arange(256), i)][i // 2 % 3][:k]
        bits = np.zeros(256, np.uint8)
        bits[where] = 1
        a[i + 1] = a[i] ^ np.packbits(bits, bitorder="little").view(np.uint64)
    return a


@pytest.mark.parametrize("radius", [2, 17, simhash.RADIUS, 70])
def test_segments_lose_no_pair(radius):
    rng = np.random.default_rng(radius)
    a = prints_near(rng, 600, radius)
    b = np.concatenate([a[rng.permutation(600)[:200]], prints_near(rng, 200, radius), a[1:100] ^ np.uint64(5)])
    for x, y, same in ((a, a, True), (a, b, False)):
        d = np.bitwise_count(x[:, None] ^ y[None]).sum(2)
        want = sorted((i, j) for i, j in np.argwhere(d <= radius).tolist() if i < j or not same)
        assert len(want) > 100
        for cuts, parts in ((0, 1), (0, 3), (4, 1), (5, 4), (6, 3), (7, 1), (8, 2)):
            got = [(i, j) for part in range(parts) for p, q in simhash.near_pairs(x, y, radius, same, part, parts, cuts) for i, j in zip(p.tolist(), q.tolist())]
            assert sorted(got) == want, (cuts, parts)


def test_pairs_within_compares_few(monkeypatch):
    """F1: all pairs of 40,000 fingerprints are 8e8; comparing each of them in three words counts bits 2.4e9 times."""
    rng = np.random.default_rng(4)
    a = rng.permutation(prints_near(rng, 40000, simhash.RADIUS))
    cells, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x, *more, **named: cells.append(np.size(x)) or count(x, *more, **named))
    i, j = simhash.pairs_within(a, a, simhash.RADIUS, True)
    assert (count(a[i] ^ a[j]).sum(1) <= simhash.RADIUS).all() and len(i) > 10000
    assert sum(cells) < 8e8


def test_linked_holds_few_pairs():
    """A cluster of which every pair is near gives one edge for each row, though its pairs come in many lots."""
    pairs = [(np.array([i]), np.array([j])) for i in range(30) for j in range(i + 1, 30)] + [(np.array([41, 40]), np.array([42, 41]))]
    up, node = simhash.linked(50, iter(pairs))
    assert dict(zip(node.tolist(), up.tolist())) == {i: 0 for i in range(1, 30)} | {41: 40, 42: 40}


def test_near_dedup_in_tiles(spark, monkeypatch):
    """Several tiles, tasks and segments give what brute force gives."""
    rows = copies(random.Random(12), 160)
    want = simhash_brute(rows)
    sizes = list(want.values())
    monkeypatch.setattr(simhash, "TILE_ROWS", 30)
    got = {r.doc_id: r.group_id for r in simhash.groups(table(spark, rows)).collect()}
    assert got == {i: g for i, g in want.items() if sizes.count(g) > 1} and len(set(got.values())) > 10


def test_near_dedup_brute_force(spark):
    rows = copies(random.Random(11), 120)
    want = simhash_brute(rows)
    got = {r.doc_id: r.group_id for r in simhash.groups(table(spark, rows, True)).collect()}
    sizes = list(want.values())
    assert got == {i: g for i, g in want.items() if sizes.count(g) > 1} and len(set(got.values())) > 10
    kept = simhash.near_dedup(table(spark, rows, True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(sizes))


def test_near_dedup_awkward(spark):
    df = awkward(spark)
    got = simhash.near_dedup(df)
    assert got.columns == df.columns
    # the long text stands under 3 (twice) and under no id; 6 has two texts of its own
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6]
    assert simhash.near_dedup(empty(spark)).count() == 0 and simhash.groups(empty(spark)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 50), (101, 50)]
    got = {r.node: r.least for r in simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {50: 50, 100: 50, 101: 50}


# 9


def passages_brute(rows):
    first, want = {}, {}
    for i, t in sorted(rows):
        w = [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+", t.lower()) if x]
        for k in range(len(w) - substring.LEAST_WORDS + 1):
            g = tuple(w[k : k + substring.LEAST_WORDS])
            if first.setdefault(g, i) != i:
                want.setdefault(i, set()).update(range(k, k + substring.LEAST_WORDS))
    return want


def covered(df):
    out = {}
    for r in df.collect():
        assert r.source_doc < r.doc_id and r.end_word - r.start_word >= substring.LEAST_WORDS
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_substring_brute_force(spark):
    rng = random.Random(12)
    pool = [prose(rng, n) for n in (49, 50, 51, 60, 75, 130)] + ["again " * 90, "ab cd " * 60]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            w = rng.choice(pool).split()
            a = rng.randrange(0, 12)
            parts += [" ".join(w[a:] if rng.random() < 0.3 else w), prose(rng, rng.randrange(0, 30))]
        rows.append((i, " ".join(parts), "a"))
    want = passages_brute([(i, t) for i, t, _ in rows])
    assert covered(substring.passages(table(spark, rows, True))) == want and len(want) > 20
    assert covered(substring.passages(table(spark, rows), 1)) == want


def test_substring_index_is_opened_again(spark):
    rng = random.Random(14)
    pool = [prose(rng, n) for n in (50, 51, 60, 130)] + ["ab cd " * 60]
    texts = [" ".join(p for _ in range(rng.randrange(0, 4)) for p in (prose(rng, rng.randrange(0, 30)), rng.choice(pool))) for _ in range(40)]
    ids = rng.sample(range(1000), 40)  # batches do not come in order of doc_id
    rows = sorted(((k // 8, i, t) for k, (i, t) in enumerate(zip(ids, texts))))
    want = {rows[k][1]: v for k, v in passages_brute([(k, t) for k, (_, _, t) in enumerate(rows)]).items()}
    got, seen, folder = {}, [], f"test-index-{rng.random()}"
    for k in range(5):
        index = substring.FingerprintIndex(spark, 4, 2, folder)
        assert index.version == (0 if k == 0 else max(index.version, 1)) and index.buckets == 4
        batch = table(spark, [(i, t, "a") for b, i, t in rows if b == k])
        seen = batch if k == 0 else seen.union(batch)
        place = {i: n for n, (_, i, _) in enumerate(rows)}
        for r in index.passages(batch, seen).collect():
            assert place[r.source_doc] < place[r.doc_id]
            got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        for name, _ in index.runs:  # the next session knows nothing of these tables
            spark.sql(f"DROP TABLE {name}")
    assert got == want and len(want) > 15
    assert sorted(level for _, level in index.runs) == [0, 0, 1]
    again = index.passages(table(spark, [(5000, texts[0], "a"), (5001, None, "a")]), seen.union(table(spark, [(5000, texts[0], "a")])))
    assert {r.doc_id for r in again.collect()} <= {5000}
    assert index.passages(empty(spark), seen).count() == 0
    index.remove()
    assert substring.FingerprintIndex(spark, 4, 2, folder).version == 0


def test_substring_awkward(spark):
    df = awkward(spark)
    assert substring.passages(df).count() == 0  # nothing stands under two ids
    rng = random.Random(13)
    t = prose(rng, 80)
    got = substring.passages(table(spark, [(1, t, "a"), (2, t.upper().replace(" ", ", "), "a"), (2, t.upper().replace(" ", ", "), "a"), (None, t, "a"), (3, None, "a")]))
    assert [(r.doc_id, r.start_word, r.end_word, r.source_doc, r.source_start) for r in got.collect()] == [(2, 0, 80, 1, 0)]
    assert substring.passages(empty(spark)).count() == 0
    named = spark.createDataFrame([(f"doc-{k:02d}", prose(rng, 9) + " " + (t if k % 3 == 0 else "") + " " + prose(rng, 9)) for k in range(12)], "doc_id string, text string")
    for n in (1, 3):
        assert sorted((r.doc_id, r.start_word, r.end_word, r.source_doc) for r in substring.passages(named, n).collect()) == [(f"doc-{k:02d}", 9, 89, "doc-00") for k in (3, 6, 9)]


# 10


def test_warc_round_trip(spark):
    rng = random.Random(14)
    pages = [(i, f"http://x/{i}", prose(rng, rng.randrange(0, 900)) + "é") for i in range(40)] + [(99, None, None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.origin_id: r for r in warc.reassemble(warc.to_warc(df)).collect()}
    assert len(got) == 41 and all(r.status == "ok" and r.http_status == 200 for r in got.values())
    for i, _, html in pages:
        assert bytes(got[f"<urn:page:{i}:1>"].body).decode() == (html or "")


def test_warc_faults(spark):
    def record(own, number=None, origin=None, total=None, body=b"", kind="response", length=None):
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}"] + [f"{n}: {v}" for n, v in (("WARC-Segment-Number", number), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Total-Length", total)) if v is not None]
        return bytearray(("WARC/1.0\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n").encode() + body)

    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    c = "continuation"
    rows = [
        record("a", 1, body=http + b"3\r\nab"), record("a2", 2, "a", len(http) + 10 + 6, b"c\r\n0\r\n\r\n\r\n"[:10], c),
        record("b", 1, body=http), record("b3", 3, "b", 9, b"x", c),
        record("d", body=http + b"zz\r\n"), record("e", body=b"no head"), record("f", body=b"abc", kind="resource"), record("f", body=b"abc", kind="resource"),
        record("g", 1, body=b"x", kind="resource"), record("g2", 2, "g", 3, b"y", c), record("g2", 2, "g", 3, b"z", c),
        record("h", body=b"abc", kind="resource", length=9), record("i2", 2, "i", 2, b"y", c), bytearray(b""), None, bytearray(b"junk"),
    ]
    df = spark.createDataFrame([(r, 1) for r in rows], "record binary, payload int")
    got = {r.origin_id: r for r in warc.reassemble(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "length", "b": "gap", "d": "framing", "e": "head", "f": "ok", "g": "conflict", "h": "length", "i": "gap"}
    assert bytes(got["f"].body) == b"abc" and all(r.body is None for k, r in got.items() if k != "f")
    assert warc.reassemble(df.where("false")).count() == 0
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n") is None


def test_warc_damaged_heads_never_crash(spark):
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\n%s\r\nabc"
    odd = [b"WARC-Segment-Number: 99999999999\r\nContent-Length: 3\r\n", "WARC-Segment-Number: ²\r\nContent-Length: ³\r\n".encode(), b"WARC-Segment-Total-Length: 99999999999999999999\r\nContent-Length: 3\r\n", b"Content-Length: 9223372036854775807\r\n", b"Content-Length: -3\r\n", b"\xff\xfe: \xff\r\nContent-Length: 3\r\n"]
    rows = [(bytearray(head % (k, x)),) for k, x in enumerate(odd)] + [(bytearray(b"WARC/1.0\r\n\r\n"),), (bytearray(b"\xff" * 50),), (None,)]
    got = {r.origin_id: r.status for r in warc.reassemble(spark.createDataFrame(rows, "record binary")).collect()}
    assert got == {"<0>": "ok", "<1>": "length", "<2>": "ok", "<3>": "length", "<4>": "length", "<5>": "ok"}
    rng = random.Random(30)
    good = [bytes(r.record) for r in warc.to_warc(spark.createDataFrame([(i, f"http://x/{i}", prose(rng, 300)) for i in range(4)], "page_id bigint, url string, html string")).collect()]
    broken = []
    for _ in range(300):
        b = bytearray(rng.choice(good))
        for _ in range(rng.randrange(1, 5)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        broken.append((b,))
    assert warc.reassemble(spark.createDataFrame(broken, "record binary")).count() > 0


def test_warc_files_with_damage(spark, tmp_path):
    import gzip

    record = lambda k, body, more=b"": b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, more, len(body), body)
    (tmp_path / "a.warc").write_bytes(record(b"1", b"one WARC/ two") + b"WARC/1.0\r\nWARC-Record-ID: <bad>\r\nContent-Length: x\r\n\r\nlost\r\n\r\n" + record(b"2", b"") + b"junk" + record(b"3", b"three")[:-7])
    packed = [gzip.compress(record(b"4", b"four" * 5000)), gzip.compress(record(b"5", bytes(random.Random(1).randbytes(5000))))]
    (tmp_path / "b.warc.gz").write_bytes(packed[0] + packed[1][:-900])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(b"no record at all")
    got = {r.origin_id.rsplit("/", 1)[-1]: r for r in warc.reassemble(warc.read_warc(spark, str(tmp_path))).collect()}
    first = record(b"1", b"one WARC/ two")
    assert {k: r.status for k, r in got.items()} == {
        "<1>": "ok", f"a.warc@{len(first)}": "damaged", "<2>": "ok", "<3>": "length", "<4>": "ok", "<5>": "length", "d.warc@0": "damaged",
        **{k: "damaged" for k in got if k.startswith(("b.warc.gz@", "a.warc@"))},
    }
    assert len(got) == 9 and bytes(got["<1>"].body) == b"one WARC/ two" and bytes(got["<4>"].body) == b"four" * 5000 and got["<2>"].body == b""
    # in time that follows the bytes
    import time

    big = b"".join(record(b"%d" % k, b"x" * 400) for k in range(60000))
    began = time.time()
    assert sum(1 for _ in warc._Records("x", iter([big[i : i + (1 << 20)] for i in range(0, len(big), 1 << 20)]))) == 60000
    assert time.time() - began < 20


def test_warc_files(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(i, "u", "text " * 900) for i in range(3)], "page_id bigint, url string, html string")
    raw = [bytes(r.record) + b"\r\n\r\n" for r in warc.to_warc(df).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(raw[::2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in raw[1::2]))
    got = warc.reassemble(warc.read_warc(spark, str(tmp_path))).collect()
    assert len(got) == 3 and all(r.status == "ok" and bytes(r.body) == b"text " * 900 for r in got)
