"""Operators that compare texts or vectors: against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sheetloom.llm import ann, graph, jaccard_join, line_dedup, queries, suffix_core, suffix_dedup


def rooted(n):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    return par, find


# -- lines -------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, k, least):
    last = line_dedup.LAST
    lines = [(last if d is None else d, line) for d, t in rows for line in (t or "").split("\n") if len(line) >= least]
    all_lines = sorted({x for _, x in lines})
    par, find = rooted(len(all_lines))
    for (i, a), (j, b) in itertools.combinations(enumerate(all_lines), 2):
        if abs(len(a) - len(b)) <= k and edit_distance(a, b) <= k:
            par[find(i)] = find(j)
    number = {x: i for i, x in enumerate(all_lines)}
    owner = {}
    for d, x in lines:
        c = find(number[x])
        owner[c] = min(owner.get(c, d), d)
    out = []
    for d, t in rows:
        seen, kept, n = set(), [], 0
        for x in (t or "").split("\n"):
            c = find(number[x]) if len(x) >= least else None
            if c is None or owner[c] == (last if d is None else d) and c not in seen:
                seen.add(c)
                kept.append(x)
            else:
                n += 1
        out.append((d, len((t or "").split("\n")), n, None if t is None else "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,k,least", [(1, 2, 6), (2, 1, 5), (4, 0, 5)])
def test_lines(spark, seed, k, least):
    r = random.Random(seed)
    base = ["".join(r.choices("abcé ", k=r.randint(3, 40))) for _ in range(30)]

    def changed(s):
        s = list(s)
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            i, what = r.randrange(len(s) + 1), r.random()
            if what < 0.4 and i < len(s):
                s[i] = r.choice("abc")
            elif what < 0.7:
                s.insert(i, r.choice("abc"))
            elif i < len(s):
                del s[i]
        return "".join(s)

    rows = [(i, "\n".join(changed(r.choice(base)) for _ in range(r.randint(0, 7)))) for i in range(80)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "\n".join(base[:4])), (903, "x" * 2000), (904, "\n".join([base[5]] * 70))]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, lid string")
    assert sorted([tuple(x) for x in line_dedup.line_report(df, k, least).collect()], key=str) == brute_lines(rows, k, least)


def test_short_lines_are_deduplicated_where_equal(spark, tmp_path):
    notice, alike = "All rights reserved.", "All rights reserved!"
    rows = [(1, f"one\n{notice}"), (2, f"two\n{notice}\n\n"), (3, notice), (4, f"\n{notice}"), (5, alike), (6, "x\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.n_lines, x.n_removed, x.kept_sha256) for x in queries.op1_line_dedup(spark, str(tmp_path)).collect()}
    kept = [(2, 0, f"one\n{notice}"), (4, 1, "two\n\n"), (1, 1, ""), (2, 1, ""), (1, 0, alike), (2, 1, "x")]
    assert got == {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, (n, gone, t) in enumerate(kept, 1)}
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    left = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {x.doc_id: x.text for x in left.collect()} == {i: t for i, (_, _, t) in enumerate(kept, 1)}


def test_line_dedup_keeps_other_columns(spark):
    line = "a line that is long enough to be looked at by the operator"
    df = spark.createDataFrame([(1, f"x\n{line}", 99, "p"), (2, f"{line}\ny", 99, "q"), (3, None, None, None)], "doc_id long, text string, n_chars long, held string")
    got = {x.doc_id: x for x in line_dedup.removed(df, line_dedup.doomed(df)).collect()}
    assert (got[1].text, got[2].text, got[2].n_chars, got[2].held, got[3].text) == (f"x\n{line}", "y", 1, "q", None)
    assert line_dedup.removed(df.limit(0), line_dedup.doomed(df.limit(0))).count() == 0


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    plan = line_dedup.removed(df, line_dedup.doomed(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- passages ----------------------------------------------------------------------------------------------------


def brute_passages(rows, size, keep):
    seen, count = {}, collections.Counter()
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            count[b[i : i + size]] += 1
            seen.setdefault(b[i : i + size], (d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if count[w] > 1 if keep == "none" else seen[w] != (d, i):
                gone[i : i + size] = True
        out.append((d, len(b), int(gone.sum()), len(suffix_core.runs(gone)), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size,k,limit", [(1, 40, 12, 3), (2, 40, 12, 1000), (3, 25, 25, 5), (4, 40, 20, 1)])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_passages(spark, seed, size, k, limit, keep):
    r = random.Random(seed)
    base = ["".join(r.choices("abcdé", k=r.randint(20, 120))) for _ in range(30)]
    rows = [(i, "".join(r.choice(base) if r.random() < 0.7 else "".join(r.choices("abcdef", k=r.randint(1, 60))) for _ in range(r.randint(0, 6)))) for i in range(100)]
    rows += [(500, "a" * 200), (501, "a" * 60 + "b" + "a" * 50), (502, None), (503, ""), (504, "ab" * 90), (None, "".join(base[:3])), (8, "xyz" + base[0] * 3)]
    if keep == "none":
        rows.append((7, rows[7][1]))  # a row twice
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, rid int")
    got = sorted([(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix_dedup.cleaned(df, size, keep, k, limit).collect()], key=str)
    assert got == brute_passages(rows, size, keep)


def test_longest_previous_factor():
    r = random.Random(1)
    for _ in range(30):
        s = "".join(r.choices("ab", k=40))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(s[a:], s[b:], strict=False)) if x != y), min(len(s) - a, len(s) - b))
        lcp = [0, *[common(a, b) for a, b in zip(order, order[1:], strict=False)]]
        previous, following = suffix_core.longest_factors(np.array(order), np.array(lcp))
        assert previous.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert following.tolist() == [max((common(i, j) for j in range(i + 1, len(s))), default=0) for i in order]


def test_equal_windows_choose_the_same_anchor():
    r = np.random.default_rng(2)
    for h in (r.integers(0, 50, 300).astype(np.uint64), np.zeros(100, np.uint64), r.integers(0, 2**44, 500).astype(np.uint64)):
        place = suffix_core.sampled(h, 17)
        expected = [i + int(np.argmin(h[i : i + 17])) for i in range(len(h) - 16)]
        assert place.tolist() == expected


def test_first_kept_keeps_columns(spark):
    p = "p" * 300 + "q" * 300
    df = spark.createDataFrame([(1, "a" + p, 5, "x"), (2, p + "b", 5, "y"), (3, None, None, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {x.doc_id: x for x in suffix_dedup.first_kept(df).collect()}
    assert (got[1].text, got[2].text, got[2].n_chars, got[2].spans, got[3].text) == ("a" + p, "b", 1, "y", "")


def test_planted_passages_show_in_what_is_left(spark):
    """op6: of 400 bytes up a planted passage of over 50 words is gone from both its texts; shorter ones and clean texts stay whole."""
    r = random.Random(11)
    prose = lambda n, m: " ".join("".join(r.choices("abcdeé", k=r.randint(1, m))) for _ in range(n))
    rows, planted = {}, {}
    for i in range(0, 60, 2):
        passage = prose(r.randint(51, 90), r.choice([6, 12]))
        for d in (i, i + 1):
            rows[d] = f"{prose(60, 9)} {{{passage}}} {prose(60, 9)}"
            planted[d] = passage
    rows |= {d: prose(150, 9) for d in range(100, 120)} | {200: "é" * 400, 201: "ab" + "é" * 400, 202: "é" * 100 + "x", 203: None}
    got = {x.doc_id: x for x in suffix_dedup.digests(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    long = {d for d, p in planted.items() if len(p.encode()) >= suffix_dedup.SIZE}
    assert len(long) > 10 and len(planted) - len(long) > 10
    gone = {d for d, p in planted.items() if p not in got[d].text}
    brute = {x[0]: x for x in brute_passages(list(rows.items()), suffix_dedup.SIZE, "none")}
    assert long <= gone <= {d for d in rows if brute[d][2]} and len(set(planted) - gone) > 10
    assert all(got[d].text == t for d, t in rows.items() if t and not brute[d][2]) and not any(brute[d][2] for d in range(100, 120)) and got[203].text == ""
    assert all((got[d].n_removed, got[d].kept_sha256) == (brute[d][2], brute[d][4]) for d in rows)


def test_cut_characters_show_as_replaced(spark):
    """op6: a cut may go through a character."""
    same = "é" * 50 + "b" * 400
    df = spark.createDataFrame([(1, "ã" + same + "é"), (2, "é" + same + "è"), (3, "whole é")], "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed) for x in suffix_dedup.digests(df).collect()}
    assert got == {1: (b"\xc3\xa3\xa9".decode("utf-8", "replace"), 501), 2: (b"\xc3\xa9\xa8".decode("utf-8", "replace"), 501), 3: ("whole é", 0)}


# -- near copies -------------------------------------------------------------------------------------------------


def shingles(t, w=5):
    x = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset() if not x else frozenset([tuple(x)]) if len(x) < w else frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1))


def brute_components(rows, percent):
    s = [shingles(t) for _, t in rows]
    par, find = rooted(len(rows))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
            par[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted([(d, len(s[i]), best.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("seed,percent,block", [(1, 80, 4), (3, 60, 6)])
def test_near_copies(spark, seed, percent, block):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common, rows = r.choices(words, k=40), []
    for g in range(20):
        base = r.choices(words, k=r.choice([3, 8, 30, 80, 150]))
        base = common + base if g % 3 == 0 else base
        for _ in range(r.choice([1, 2, 5, 14])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(t) if r.random() < 0.9 else "\t".join(x.upper() for x in t) + " "))
    rows += [(9000, None), (9001, ""), (9002, " \n"), (None, rows[5][1]), (9003, "one two"), (2, "One  TWO"), (9004, "É a b c d e"), (9005, "é a b c d e"), (1, rows[0][1])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, key string")
    got = sorted([tuple(x) for x in jaccard_join.linked_components(df, percent, 5, block).collect()], key=str)
    assert got == brute_components(rows, percent)


def test_one_of_each_group_stays(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t + " more", "b"), (3, "other text", "c"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, k string")
    assert sorted(x.doc_id for x in jaccard_join.one_each(df).collect()) == [1, 3, 4, 5]


def test_tree_loses_nothing():
    r = np.random.default_rng(1)
    base = r.integers(0, 12, (20, jaccard_join.GROUPS))
    counts = np.maximum(0, base[r.integers(0, 20, 400)] + r.integers(-1, 2, (400, jaccard_join.GROUPS))).astype(np.int32)
    tree, size = jaccard_join.RTree(counts, 80), counts.sum(axis=1)
    for i in range(0, 400, 17):
        bound = np.minimum(counts, counts[i]).sum(axis=1)
        expected = np.flatnonzero((bound >= jaccard_join.needed(size[i], size, 80)) & (100 * size[i] >= 80 * size))
        assert sorted(tree.near(counts[i])) == expected.tolist()


@pytest.mark.parametrize("many", [0, graph.MANY])
def test_components(spark, many):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    par, find = rooted(2000)
    for a, b in pairs:
        par[max(find(a), find(b))] = min(find(a), find(b))
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a long, b long"), many=many).collect()))
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors -----------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 12))[r.integers(0, 40, 1200)] + r.normal(size=(1200, 12)) * 0.5
    x[100:400] = x[100]  # a frequent vector
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5000, None, "c"), (5001, [0.0] * 12, "c"), (5002, [1.0] * 11 + [None], "c"), (5003, [float("nan")] * 12, "c"), (5004, [float("inf")] * 12, "c"), (5005, [1.0], "c"), (5006, [], "c")]
    df = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, first string"))
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(len(d)), d))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g.score, d[g.vec_id], atol=1e-12)
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))
        hits += len(set(true) & set(g.vec_id)) if d[true[-1]] > 0 else int((g.score == 0).sum())
    assert got.query_id.nunique() == 12 and hits / 120 >= 0.9


def test_repeated_vec_id_hides_no_neighbour(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(300, 8))
    hot = x[0] + r.normal(size=(400, 8)) * 0.01  # one vec_id, many vectors near the query
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7777, v.tolist()) for v in hot]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = [(g.vec_id, g.score) for g in ann.nearest(df, df.where("vec_id = 0"), centroids=8, target=1.0).orderBy("rank").collect()]
    d = {i: float(np.sqrt(((v - x[0]) ** 2).sum())) for i, v in enumerate(x) if i}
    d[7777] = float(np.sqrt(((hot - x[0]) ** 2).sum(axis=1)).min())
    true = sorted(d.items(), key=lambda p: (p[1], p[0]))[:10]
    assert len(got) == 10 and got[0][0] == 7777
    assert len({i for i, _ in got} & {i for i, _ in true}) >= 9 and all(abs(s - d[i]) < 1e-9 for i, s in got)


def test_few_vectors(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, v array<double>")
    assert [(x.vec_id, x.rank) for x in ann.nearest(df, df.where("vec_id = 100")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 1")
    assert ann.nearest(one, one).count() == 0


# -- the pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.staged(stage(spark, df, "/root/testdata/sf0.001"), name)
        assert sorted(df.columns) == sorted(docs.columns), name
    assert 0 < df.count() <= docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, df, "/root/testdata/sf0.001").toPandas()
    assert set(packed.doc_id) == {x.doc_id for x in df.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_only_texts_that_are_asked_for_are_shuffled(spark):
    """op6: a table of bits lets through the rows asked for and hardly any others; the rest pass with what they hold."""
    df = spark.createDataFrame([(i, ("same passage " * 40 if i % 10 == 0 else "") + hashlib.sha256(str(i).encode()).hexdigest() * 8) for i in range(400)], "doc_id long, text string")
    rows = suffix_dedup.keyed(df).drop("rest")
    assert suffix_dedup.among(rows, rows.where("doc_id < 20").select("rid")).count() == 20
    assert suffix_dedup.among(rows, rows.where("doc_id < 0").select("rid")).count() == 0
    out = suffix_dedup.cleaned(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.index("Union") < plan.index("Join LeftOuter")
    assert {x.doc_id for x in out.where("n_removed > 0").collect()} == set(range(0, 400, 10))
    assert out.count() == 400
