"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from sheetloom.llm import ann, bpe, html_text, jaccard_join, licenses, line_dedup, packing, queries, suffix_dedup, syncmers, toxicity

from .test_corpus_operators import brute_components, shingles

#: Names that the operators use inside.
CLASH = "rid spans key n hashes at rest fingerprint bucket score licenses component_id lid line pos packed a h role one place low high token root class owner size sequence_id length".split()


def long_text(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(900)]
    return " ".join(r.choices(words, k=n))


LONG = long_text(1, 60_000)
ROWS = [(1, LONG), (2, None), (3, ""), (4, "short"), (5, "short"), (5, "short"), (None, "no id at all"), (6, " \n\t "), (7, long_text(2, 300)), (8, long_text(2, 300) + " more"), (9, "a" * 5000), (10, "é \x00ß" * 50)]


def odd(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, *["c"] * len(CLASH)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH))


def net(spark, docs):
    labels = spark.createDataFrame([(1, 0, "c"), (4, 1, "c"), (4, 0, "c"), (7, None, "c")], "doc_id long, toxic int, text string")
    return toxicity.trained(docs, labels)


OPERATORS = {
    "lines": lambda s, d: line_dedup.line_report(d, exact_chars=1),
    "packing": lambda s, d: packing.packed_documents(d, queries.vocabulary()),
    "syncmers": lambda s, d: syncmers.compared(d),
    "toxicity": lambda s, d: toxicity.scored(d, net(s, d)),
    "passages": lambda s, d: suffix_dedup.digests(d),
    "licences": lambda s, d: licenses.scanned(d),
    "jaccard": lambda s, d: jaccard_join.linked_components(d),
    "bpe": lambda s, d: bpe.digests(d, queries.vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, odd(spark)).collect()
    if name == "packing":
        assert {r.doc_id for r in got} == {d for d, _ in ROWS}
        assert sum(r.length for r in got if r.start == 0) and all(r.length > 0 for r in got)
    else:
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(d) for d, _ in ROWS)
    if name == "passages":
        assert {r.doc_id: r.n_removed for r in got if r.n_removed} == {9: 5000, 7: len(ROWS[8][1]), 8: len(ROWS[8][1])}
    if name == "toxicity":
        assert all(0 <= r.score <= 1 for r in got)
    assert OPERATORS[name](spark, odd(spark, [])).count() == 0


def test_odd_pages(spark):
    page = "<html><body><article>" + "".join(f"<p>{long_text(i, 200)}, and so on.</p>" for i in range(700)) + "</article></body></html>"
    rows = [(1, "u", page, "c"), (None, None, None, "c"), (3, "u", "", "c"), (4, "u", "<p>tie</p>", "c"), (4, "u", "<p>tie</p>", "c")]
    schema = "page_id long, url string, html string, text string"
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == "\n\n".join(f"{long_text(i, 200)}, and so on." for i in range(700)) and got[None] == got[3] == "" and got[4] == "tie"
    assert html_text.extracted(spark.createDataFrame([], schema)).count() == 0


def test_main_text_of_known_articles():
    """Held against what pages were made from: the share of pages whose text is exactly the article's."""
    r = random.Random(4)
    said = lambda n: (lambda w: w[0].upper() + w[1:])(", ".join(long_text(r.random(), r.randint(4, 12)) for _ in range(n))) + "."
    link = lambda: f"<a href='/{r.randint(1, 99)}'>{long_text(r.random(), 2)}</a>"
    right = 0
    for i in range(60):
        paragraphs = [said(r.randint(1, 4)) for _ in range(r.randint(3, 9))]
        inside = "".join(f"<p>{p}</p>" for p in paragraphs)
        home = [f"<article>{inside}</article>", f"<main><div class='content'>{inside}</div></main>", f"<div id='post-body'>{inside}</div>", f"<div class='entry'><div>{inside}</div></div>"][i % 4]
        menu = ["<nav><ul>" + "".join(f"<li>{link()}</li>" for _ in range(8)) + "</ul></nav>", "<div class='menu'>" + " | ".join(link() for _ in range(6)) + "</div>"][i % 2]
        side = f"<aside><p>{said(2)}</p></aside>" if i % 3 else f"<div class='sidebar'><p>{said(2)}</p>{link()}</div>"
        comments = f"<section class='comments'><div class='comment'><p>{said(1)}</p></div><div class='comment'><p>{said(2)}</p></div></section>" if i % 5 else ""
        page = f"<html><head><title>{said(1)}</title><style>p {{ x: y }}</style></head><body><header><p>{long_text(i, 3)}</p></header>{menu}<div class='wrap'>{home}{side}{comments}</div><footer><p>{said(1)}</p></footer><script>var a = '<p>{said(1)}</p>';</script></body></html>"
        right += html_text.main_text(page) == "\n\n".join(paragraphs)
    assert right >= 57, right


def test_likeness_is_near_the_exact_jaccard():
    r = random.Random(8)
    off = []
    for i in range(40):
        a = long_text(i, 400)
        b = a[: int(len(a) * r.random())] + long_text(100 + i, 300)
        x, y = (set(syncmers.anchors([t])[2].tolist()) for t in (a, b))
        off.append(syncmers.likeness(*syncmers.fingerprints([a, b])) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.25


def test_runs_of_many_pairs():
    r = random.Random(3)
    texts = [(long_text(i, r.randint(0, 60)), long_text(i + r.choice([0, 50]), r.randint(0, 60))) for i in range(30)] + [("tiny", "tiny"), ("", "x"), ("ab" * 40, "ab" * 40)]
    a, b = ([t[k] for t in texts] for k in (0, 1))
    got = syncmers.longest_runs(syncmers.anchors(a), syncmers.anchors(b), np.array(list(map(len, a))))
    assert got.tolist() == [max((n for _, _, n in syncmers.shared_runs(x, y)), default=0) for x, y in texts]


def test_stages_on_odd_rows(spark):
    notice = "A line that stands in many documents, word for word, and is long enough."
    passage = long_text(77, 60)
    rows = [(d, t if d != 1 else t[:20_000]) for d, t in ROWS if d is not None] + [(20, f"one\n{notice}"), (21, f"two\n{notice}"), (30, long_text(30, 20) + " " + passage + " " + long_text(31, 20)), (31, long_text(32, 20) + " " + passage + " " + long_text(33, 20))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    left = {r.doc_id: r.text for r in lines.collect()}
    assert left == {**dict(rows), 5: "", 21: "two"}
    alone = corpus_pipeline.drop_near_copies(spark, docs, "")
    groups = {}
    for d, _, c in brute_components(rows, 80):
        groups.setdefault(c if shingles(dict(rows)[d]) else d, set()).add(d)
    assert sorted(r.doc_id for r in alone.collect()) == sorted(min(g) for g in groups.values())
    kept = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_passages(spark, docs, "").collect()}
    assert kept[30][0] == dict(rows)[30] and kept[2] == ("", 0) and passage not in kept[31][0]
    assert len(kept[31][0]) <= len(dict(rows)[31]) - len(passage) and all(n == len(t) for t, n in kept.values())
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.drop_passages):
        assert stage(spark, docs.limit(0), "").count() == 0
    packed = corpus_pipeline.pack(spark, docs, "")
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sheetloom.llm import shared

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_vectors_with_clashing_columns(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, None, 3), (3, [0.0, 0.0], 4), (4, [float("nan"), 1.0], 5)], "vec_id long, embedding array<double>, v int")
    rows = ann.usable(df)
    assert [(x.query_id, x.vec_id, x.rank) for x in ann.nearest(rows, rows.where("vec_id = 100")).collect()] == [(100, 1, 1)]
