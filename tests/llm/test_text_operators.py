"""Operators on single texts: against the tokenizers library, brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import bpe, html_text, licenses, packing, queries, syncmers, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["", "x", "  a  b\n\n c", "'s'll it's don't", "a" * 300, "ab" * 400 + " xyz" * 3, "\n a", "a \n", "\x1c\x1d a\x1e", "中文 字", "a<|endoftext|>b", "é" * 70]


def texts(n=1500, seed=1):
    r = random.Random(seed)
    parts = [*"ab' \n\t.,é–中 \u0085😀'sll12²Ⅳ\x1c", "<|endoftext|>", " the", " "]
    return ODD + ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")  # extra columns whose names clash


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe_is_the_librarys(spark, library):
    ts = texts()
    expected = [e.ids for e in library.encode_batch(ts, add_special_tokens=False)]
    own = bpe.Bpe(queries.vocabulary())
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(ts)] == expected
    assert all(own.decode(ids) == library.decode(ids, skip_special_tokens=False) for ids in expected)


def test_bpe_rows(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(30))] + [(None, None, None, None), (3, "again", None, None), (3, "again", None, None)]
    got = bpe.digests(frame(spark, rows), queries.vocabulary()).collect()
    assert len(got) == len(rows)
    null = next(r for r in got if r.doc_id is None)
    assert null.n_tokens == 0 and null.ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decoded(bpe.encoded(frame(spark, rows), queries.vocabulary()), queries.vocabulary())
    assert sorted(r.text for r in back.collect()) == sorted((t or "") for _, t, _, _ in rows)
    assert bpe.digests(frame(spark, []), queries.vocabulary()).count() == 0


def test_bpe_long_piece_takes_no_square():
    own = bpe.Bpe(queries.vocabulary())
    assert own.merge_long(b"ab" * 30) == own.merge_wide([b"ab" * 30])[0]
    assert len(own.merge_long(b"a" * 200_000)) > 0


def test_packing_fill_is_closest():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(1, 100)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = packing.fill(counts, room)
        assert all(n <= counts[x] for x, n in used.items())
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)


def test_packing(spark, library):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts(200))] + [(900, "word " * 5000, None, None), (901, None, None, None), (None, "a", None, None), (7, "twice", None, None), (7, "twice", None, None)]
    got = packing.packed_documents(frame(spark, rows), queries.vocabulary()).toPandas()
    ids = {t: [*e.ids, 1] for t, e in zip([r[1] or "" for r in rows], library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True)}
    assert got["length"].sum() == sum(len(ids[t or ""]) for _, t, _, _ in rows)
    big = got[got.doc_id == 900].sort_values("start")
    assert big.start.tolist() == [0, *big.length.cumsum().tolist()[:-1]]
    for p in big.astype({"start": int, "length": int}).itertuples():
        part = np.array(ids["word " * 5000][p.start : p.start + p.length], "<u4")
        assert zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids["word " * 5000])
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 2048
    assert packing.packed_documents(frame(spark, []), queries.vocabulary()).count() == 0


def test_html():
    page = """<html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><ul><li><a href=x>Home</a></ul></div>
    <div class=wrap><div class=col><h1>My &eacute;t&#233;</h1><div class="cookie-notice">We use cookies, ok, sure</div><p>First para, which is long enough, to score, and <a href=x>a link</a> &lt;b&gt; goes on
 and on.<br>after<p>Second para, which is also long, with commas, and such.</p><form><label>Email</label></form></div>
    <div class=sidebar><p>Side text, that is long, with commas, many, many, many.</p></div><section id=comments><article class=comment><p>Nice article, I like it, very, very much.</p></article></section></div>
    <footer>&copy; foo</footer><script>if(a<b){x="</p>"}</script></body></html>"""
    assert html_text.main_text(page) == "My été\n\nFirst para, which is long enough, to score, and a link <b> goes on and on. after\n\nSecond para, which is also long, with commas, and such."
    assert [html_text.main_text(x) for x in (None, "", "just text", "<p>a</p><div a='x>y'>b</div>", "<nav>x</nav>")] == ["", "", "just text", "a\n\nb", ""]
    html_text.main_text("<div>" * 20_000 + "x, y" * 20)


def test_html_rows(spark):
    rows = [(1, None, None, "e"), (2, "u", "<article><p>Hi &amp; bye.</p></article>", "e"), (2, "u", "<article><p>Hi &amp; bye.</p></article>", "e"), (None, "u", "", None)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.text for r in got) == ["", "", "Hi & bye.", "Hi & bye."] and sum(r.n_chars for r in got) == 18


def inner_hash(piece):
    h = syncmers.mixed((np.array([ord(c) for c in piece], np.uint64) + np.uint64(1)) * syncmers.ODD)
    while len(h) > 1:
        h = syncmers.mixed(h[0::2] * syncmers.ODD + h[1::2])
    return int(h[0])


def brute_anchors(text):
    inner = [inner_hash(text[i : i + syncmers.S]) for i in range(len(text) - syncmers.S + 1)]
    wide = syncmers.K - syncmers.S + 1
    return [i for i in range(len(text) - syncmers.K + 1) if min(inner[i : i + wide]) in (inner[i], inner[i + wide - 1])]


def test_closed_syncmers():
    r = random.Random(3)
    for _ in range(5):
        text = "".join(r.choices("abcdefé ", k=200))
        assert syncmers.anchors([text])[1].tolist() == brute_anchors(text)


def test_fingerprints(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    docs = [(i, " ".join(r.choices(words, k=120)), "f", "x") for i in range(30)] + [(100, None, None, None), (101, "", None, None), (None, "tiny", None, None), (5, "tie", None, None), (5, "tie", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, fingerprint string, bucket string")
    got = syncmers.compared(df).collect()
    order = sorted(((d, t or "") for d, t, _, _ in docs), key=lambda x: (-(x[0] if x[0] is not None else -(2**63)), x[1]))
    assert len(got) == len(order)
    expected = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *syncmers.fingerprints([t, edited])))
    assert sorted(map(str, expected)) == sorted(str((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint)) for x in got)
    whole = [x for x in got if x.n_chars > 300]
    assert np.mean([x.near_edited for x in whole]) > 0.25 and np.mean([x.near_next for x in whole]) < 0.05
    assert syncmers.compared(df.limit(0)).count() == 0
    runs = syncmers.shared_runs("abc" + docs[0][1], docs[0][1])
    assert max(n for _, _, n in runs) > 300 and all(p - q == 3 for p, q, _ in runs)


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    net = toxicity.Network.fresh(toxicity.NOTHING, toxicity.NOTHING)
    x = r.normal(size=(6, 2 * toxicity.OWN)).astype(np.float32)
    rows = np.array([[0, 1, 2, 5], [3, 4, -1, -1], [1, -1, -1, -1]])
    loss = lambda: float(np.log1p(np.exp(-net.forward(net.projected(x), rows).astype(float))).sum())
    kept: dict = {}
    out = net.forward(net.projected(x), rows, kept)
    g, d_given = net.backward(kept, rows, -toxicity.sigmoid(-out), 6)
    d_x = sum(d_given[:6, k * 3 * toxicity.HIDDEN : (k + 1) * 3 * toxicity.HIDDEN] @ net.p[f"w{s}"].T for k, s in enumerate("fb"))
    for name in ("uf", "ub", "wa", "va", "wo"):
        at = tuple(0 for _ in net.p[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 0.01
        up = loss()
        net.p[name][at] = keep - 0.01
        down = loss()
        net.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 0.02, abs=2e-2)
    keep = x[1, 0]
    x[1, 0] = keep + 0.01
    up = loss()
    x[1, 0] = keep - 0.01
    assert d_x[1, 0] == pytest.approx((up - loss()) / 0.02, abs=2e-2)


def test_windows_cover_the_text():
    for n in (0, 1, 48, 49, 80, 200):
        s = toxicity.spans(n)
        assert {i for a, b in s for i in range(a, b)} == set(range(n)) and all(b - a <= toxicity.WINDOW for a, b in s)


def test_toxicity_learns(spark):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    rows = []
    for i in range(500):
        w = r.choices(words, k=r.randint(5, 150))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilest", "hateful", "zqx" + r.choice(words)]))
        rows.append((i, " ".join(w), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (77_777, 0), (1, None)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.scored(docs, toxicity.trained(docs, labels)).collect()}
    held = [(out[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 502 and out[9000].score == out[9001].score and all(0 <= x.score <= 1 for x in out.values())
    assert np.mean([x.predicted == y for x, y in held]) > 0.9


def test_licences(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    plain = [" ".join(r.choices(words, k=60)) for _ in range(60)]
    cases = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc"}
    rows = [(i, p) for i, p in enumerate(plain)] + [(100 + i, f"{plain[i]}\n{t}\n{plain[i + 1]}") for i, t in enumerate(cases)] + [(200 + i, f"{plain[i]} {t} {plain[i + 1]}") for i, t in enumerate(cases)] + [(300, None), (301, "")]
    got = {x.doc_id: x.licenses for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, family in enumerate(cases.values()):
        assert got[100 + i] == family and got[200 + i] == family
    assert got[300] == got[301] == "" and sum(got[i] != "" for i in range(60)) <= 3


def test_all_licences_of_a_text(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(300)]
    plain = [" ".join(r.choices(words, k=60)) for _ in range(60)]
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
    exotic = "Licensed under the GNU free permission license"
    cases = {
        "Licensed under the MIT License or the Apache License, Version 2.0": "apache-2.0,mit",
        "Released under the MIT License.\nLicensed under CC BY-NC 4.0.": "cc-by-nc,mit",
        f"{exotic}": "unknown",
        f"All rights reserved.\n{exotic}": "proprietary,unknown",
        # those that share wording with others stay alone
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        lgpl: "lgpl",
    }
    rows = [(i, p) for i, p in enumerate(plain)] + [(100 + i, f"{plain[i]}\n{t}\n{plain[i + 1]}") for i, t in enumerate(cases)]
    got = {x.doc_id: x.licenses for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(len(cases))] == list(cases.values())


def test_ordinary_paragraphs_come_from_whole_texts(spark, monkeypatch):
    seen = []
    fit = licenses.fit
    monkeypatch.setattr(licenses, "fit", lambda paragraphs: seen.extend(paragraphs) or fit(paragraphs))
    text = "\n".join([f"line {i} of a long text" for i in range(200)] + ["", "a license"])
    licenses.scanned(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))
    places = [int(p.split()[1]) for p in seen]
    assert len(set(places)) == licenses.LINES and max(places) >= 50
