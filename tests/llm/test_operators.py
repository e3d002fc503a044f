"""Training-data operators against brute force, exact results and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import ann, common, components, decontaminate, html_text, jaccard_join, langid, licences, mixing, quality, repeated_bytes, sentence_spans
from tablewright.llm.common import NO_ID, Words, crc_rest, load, merged, row_key, shingles, text_buffer
from tablewright.llm.run_length_index import RunLengthIndex, matching_statistics

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in all columns, empty and wordless texts, repeated rows, ties, a long text.
EDGES = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " .,!\n", "en", "a", 5), (4, "One two. Three four five six.\nSeven", "en", None, 1), (4, "One two. Three four five six.\nSeven", "en", None, 1),
         (None, "One two. Three four five six.\nSeven", "de", "b", 1), (5, "é日本 ünï " * 3, "fr", "b", 1), (6, "long words here again and again " * 40_000, "en", "a", 1), (7, "x", "en", "c", 1)]


def low_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def edges(spark):
    # Extra columns, with names that operators use inside.
    return spark.createDataFrame(EDGES, DOC).withColumns({c: F.lit("clash") for c in ("id", "doc", "key", "score", "size", "spans", "__text", "rank", "u")})


def none(spark):
    return edges(spark).where("false")


# ------------------------------------------------------------------ kernels

def test_words_and_shingles():
    texts = ["Ab c1-d É日本", "", None, "a", "--", "a b a b a b"]
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    w = Words(data, offsets)
    said = [bytes(w.low[s:e]).decode() for s, e in zip(w.start, w.end)]
    assert [said[a:b] for a, b in zip(w.first[:-1], w.first[1:])] == [low_words(t) for t in texts]
    h, first = shingles(w, 2)
    assert np.diff(first).tolist() == [3, 0, 0, 1, 0, 5]
    assert len(set(h[first[5]:].tolist())) == 2
    assert merged(np.array([(5, 7), (0, 2), (1, 3), (3, 4)])).tolist() == [[0, 4], [5, 7]]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 3)] + [(300, i) for i in range(301, 330)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and got[329] == 300 and 200 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 1

@pytest.mark.parametrize("group", [4000, 7])
def test_nearest_neighbours(spark, monkeypatch, group):
    monkeypatch.setattr(ann, "GROUP", group)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 16)), rng.normal(size=(5, 16)).repeat(120, 0) + 0.05 * rng.normal(size=(600, 16))])
    x[50] = x[100] = x[101] = x[102]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 3), (None, [1.0] * 16), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9))
    got = {}
    for r in ann.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    norm = np.linalg.norm(x, axis=1)
    hits = total = 0
    for q in range(0, 1200, 50):
        s = x @ x[q] / norm / norm[q]
        s[q] = -2
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        found = [v for _, v, _ in sorted(got[q])]
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5] and all(abs(score - s[v]) < 1e-12 for _, v, score in got[q])
        hits, total = hits + len(set(found) & set(want.tolist())), total + 5
    assert hits / total >= 0.9
    assert [v for _, v, _ in sorted(got[50])][:3] == [100, 101, 102] and 5001 not in got and 5000 not in got
    assert ann.nearest_neighbours(df.where("false"), df).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest_neighbours(few, few).collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]


def test_recall_with_many_lists(spark):
    """1,500 lists: 64 of them hold too few of the true neighbours."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 64)).astype(np.float32).astype(float)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    got = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0"), list_size=8).toPandas()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert hits / (5 * len(range(0, len(x), 50))) >= 0.9


def test_recall_on_the_table(spark):
    e = load(spark, SF, "embeddings").toPandas().sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    ids, norm = e.vec_id.to_numpy(), np.linalg.norm(x, axis=1)
    got = ann.op1_ann(spark, SF).toPandas()
    hits = 0
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        s = x @ x[q] / norm / norm[q]
        s[q] = -2
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(got[got.query_id == ids[q]].vec_id))
    assert hits / (5 * len(queries)) >= 0.9


# ------------------------------------------------------------------ 2

def hit_by_hand(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, found = low_words(text), set(), set()
        for i, t in items:
            b = low_words(t)
            m = min(window, len(b))
            wins = {tuple(b[k: k + m]) for k in range(len(b) - m + 1)} if m else set()
            for k in range(len(w) - m + 1) if m else ():
                if tuple(w[k: k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_decontamination_judges_rows_alone(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    b = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "beta gamma delta"), (2, "zeta eta theta"), (None, "iota kappa lambda")], "item_id long, text string")
    docs = [(1, "x alpha beta gamma delta"), (1, "clean words only"), (None, "zeta eta theta"), (None, "clean as well"), (3, "iota kappa lambda mu"), (4, "iota kappa")]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"]), r.unnamed) for r in got], key=key) == sorted(
        [(1, 5, 4, ["1"], False), (1, 3, 0, [], False), (None, 3, 3, ["2"], False), (None, 3, 0, [], False), (3, 4, 3, [], True), (4, 2, 0, [], False)], key=key)


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    items = [(1, " ".join(words)), (2, "Short, item!"), (3, ""), (4, None), (5, "x"), (10, "beta Gamma " * 8), (None, "short item")]
    docs = [(1, "pre " + ", ".join(words).upper() + " post"), (2, " ".join(words[:9]) + " stop " + " ".join(words[1:11])), (3, "a short item; short"), (4, None), (5, ""), (6, "beta gamma " * 300 + "x"), (7, "short"), (8, "item short"), (8, "item short")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in decontaminate.find_contamination(d, b).collect())
    if block == 60:
        got = sorted({(a, b_, c, tuple(e)) for a, b_, c, e in got})
        want = sorted({(a, b_, c, tuple(e)) for a, b_, c, e in hit_by_hand(docs, [x for x in items if x[0] is not None and x[1] is not None])})
        assert got == want
    else:
        assert got == sorted(hit_by_hand(docs, [x for x in items if x[0] is not None and x[1] is not None]))
    assert decontaminate.find_contamination(d, b.where("false")).where("size(items) > 0").count() == 0
    assert decontaminate.find_contamination(none(spark), b).count() == 0 and decontaminate.find_contamination(edges(spark), b).count() == len(EDGES)


def test_wu_manber_jumps():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 3000).astype(np.uint64)
    patterns = np.unique(rng.integers(0, 4, (30, 5)).astype(np.uint64), axis=0)
    at, which = decontaminate.WuManber(patterns).search(text, np.array([0, 1000, 1003, 3000]))
    want = {(k, p) for lo, hi in ((0, 1000), (1000, 1003), (1003, 3000)) for k in range(lo, hi - 4) for p in range(len(patterns)) if (text[k: k + 5] == patterns[p]).all()}
    assert set(zip(at.tolist(), which.tolist())) == want


# ------------------------------------------------------------------ 3

def test_targets():
    t = mixing.source_targets({"b": 100, "a": 10, None: 50, "c": 1000})
    assert t["a"] == 20 and abs(sum(t.values()) - 1.5 * 1160) < 1e-6 and all(v <= 2 * s + 1e-9 for v, s in zip((t["b"], t[None], t["c"]), (100, 50, 1000)))
    assert mixing.source_targets({}) == {}


def test_flow_repeats_only_where_needed():
    flows = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 10}, {"a": 120.0, "b": 100.0})
    assert abs(sum(flows.values()) - 220) < 1e-3
    assert flows[("a",)] == 100 or flows[("a",)] <= 120
    assert abs(flows[("a",)] + flows[("a", "b")] + flows[("b",)] - 220) < 1e-3 and flows[("a", "b")] >= 100 - 1e-6


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 20)
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", ["hot", "b", "c", None][min(3, int(rng.integers(0, 6)))] if i % 3 else "hot", 0) for i in range(1500)]
    df = spark.createDataFrame(rows, DOC)
    a, b = (mixing.mix_sources(df, keep=("source",)).toPandas().sort_values("doc_id") for _ in range(2))
    assert (a.taken.to_numpy() == b.taken.to_numpy()).all() and len(a) == 1500
    assert (a["size"].to_numpy() == [len(t.split()) for _, t, *_ in rows]).all()
    assert (a.taken <= 2 * a["size"]).all() and ((a.taken % a["size"]) == 0).all()
    for _, g in a.groupby(a.source.fillna("")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60 and g.source_size.iloc[0] == g["size"].sum()
    overlap = df.withColumn("both", F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("b"))).otherwise(F.array("source")))
    assert mixing.mix_sources(overlap, sources=F.col("both")).count() == 1500
    assert mixing.mix_sources(edges(spark)).count() == len(EDGES) and mixing.mix_sources(none(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mixing_fills_behind_long_documents(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "FEW", 20)
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", "a", 0) for i in range(1500)] + [(2000, "w " * 40_000, "en", "a", 0)]
    rows += [(3000 + i, "w " * 3000, "en", "a", 0) for i in range(5)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOC), seed=seed).toPandas()
    assert (got.taken <= 2 * got["size"]).all() and ((got.taken % got["size"]) == 0).all()
    assert abs(got.taken.sum() - got.target.iloc[0]) <= 0.001 * got.target.iloc[0]


# ------------------------------------------------------------------ 4

def cut_by_hand(texts, least=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            w = b[i: i + least]
            if w in seen:
                gone[i: i + least] = b"\1" * least
            else:
                seen.add(w)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_run_length_index():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 100, rng.integers(5, 30)).astype(np.uint8)) for _ in range(60)] + [b"abc" * 9] * 1
    data = np.frombuffer(b"".join(strings), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    index = RunLengthIndex(data, offsets)
    for pattern in (b"a", b"ab", b"cab", b"abcabc", b"bbbbbbbb"):
        lo, hi, place = index.everything(1)
        for byte in reversed(pattern):
            lo, hi, place = index.extend(lo, hi, place, np.array([byte], np.uint8))
        assert hi[0] - lo[0] == sum(s[k:].startswith(pattern) for s in strings for k in range(len(s)))
        if hi[0] > lo[0]:  # the sample leads to an occurrence
            k = int(np.searchsorted(index.begin, place[0], "right")) - 1
            assert strings[k][place[0] - index.begin[k]:].startswith(pattern)
    end = offsets[1:][:60]
    reach, low, _ = matching_statistics(index, data, end, 3, np.minimum(end - offsets[:60] - 3, 6))
    assert (reach >= -1).all() and low.shape[0] == 60


@pytest.mark.parametrize("piece, hot", [(1_000_000, 20), (500, 20), (1_000_000, 3), (500, 1)])
def test_repeated_bytes(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(repeated_bytes, "PIECE", piece)
    monkeypatch.setattr(repeated_bytes, "HOT_LEAST", hot)
    rng = np.random.default_rng(4)

    def noise(n):
        return "".join(map(chr, rng.integers(97, 123, n)))

    base, line = noise(900), noise(70) + "é日本" * 4
    texts = [base, base, base[:400] + "X" + base[400:], noise(50) + line + noise(60), noise(80) + line + noise(90), line + line + line, "ab" * 300, "ab" * 200 + noise(30), None, "", noise(99), noise(120) + base[100:230] + noise(50), "c" * 250]
    texts += [noise(30) + base[k * 37: k * 37 + 180] + noise(30) for k in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(5)
    got = [(r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeated_bytes.remove_repeated_bytes(df).orderBy("doc_id").collect()]
    assert got == cut_by_hand(texts)


def test_repeated_bytes_on_the_table(spark):
    rows = load(spark, SF, "documents").orderBy("doc_id").collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes.op4_repeated_bytes(spark, SF).orderBy("doc_id").collect()]
    assert got == cut_by_hand([r.text for r in rows])


def test_repeated_bytes_edges(spark):
    assert repeated_bytes.remove_repeated_bytes(edges(spark)).count() == len(EDGES) and repeated_bytes.remove_repeated_bytes(none(spark)).count() == 0


# ------------------------------------------------------------------ 5

def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A\n\n" + ".\n".join(re.sub(r"(\S+ \S+ \S+) ", r"\1\n", licences.SENTENCES[k]) for k in ("mit-grant", "mit-condition", "mit-as-is"))
    texts = ["Some text\nLicensed under CC BY-NC 4.0.\nmore", "x. Released under the MIT License.", "it was released under the mit license to all", mit, "Licensed under the Apache License, Version 2.0 (the \"License\");\n" + "\n".join(licences.SENTENCES[k] + "." for k in ("apache2-compliance", "apache2-copy", "apache2-url", "apache2-as-is", "apache2-see")),
             "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.\nReleased under the MIT License.", "All rights reserved.", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("licences", F.lit(0))
    rows = licences.scan_licences(df).orderBy("doc_id").collect()
    assert [list(r.licences) for r in rows] == [["CC-BY-NC-4.0"], ["MIT"], [], ["MIT"], ["Apache-2.0"], ["GPL-3.0-only", "MIT"], [], [], []]
    assert list(rows[6].unmatched) == ["rights-reserved"] and [s.sentence for s in rows[3].sentences] == ["mit-title-short", "mit-grant", "mit-condition", "mit-as-is"]
    s = rows[0].sentences[0]
    assert texts[0][s.start: s.end] == "Licensed under CC BY-NC 4.0"
    assert licences.scan_licences(edges(spark)).count() == len(EDGES) and licences.scan_licences(none(spark)).count() == 0


def test_licences_on_the_table(spark):
    notices = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    got = {r.doc_id: r.licences for r in licences.op5_licences(spark, SF).collect()}
    for r in load(spark, SF, "documents").collect():
        want = list(dict.fromkeys(notices[x] for x in r.text.split("\n") if x in notices))
        assert got[r.doc_id] == ",".join(want)


# ------------------------------------------------------------------ 6

def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op6_quality(spark, sf).join(load(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (6, 0), (6, 0), (7, 2)], "doc_id long, quality int")
    rows = quality.score_quality(edges(spark), labels, keep=("text",)).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score_quality(edges(spark), labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(none(spark), labels).count() == 0
    stats = quality.document_statistics(*text_buffer(pa.array(["", None, "a a a"], pa.large_string())))
    assert not stats[0].any() and not stats[1].any() and np.isfinite(stats).all()


def test_forest_walk_is_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = quality.fit_forest(x, y, trees=30, depth=3)

    def walk(row):
        total = f.base
        for t in range(len(f.feature)):
            n = 0
            while f.feature[t, n] >= 0:
                n = f.left[t, n] + int(row[f.feature[t, n]] > f.threshold[t, n])
            total += f.value[t, n]
        return total

    assert np.allclose(f.raw(x[:50]), [walk(r) for r in x[:50]]) and ((f.score(x) > 0.5) == y).mean() > 0.97


# ------------------------------------------------------------------ 7

def links_by_hand(docs, size=5, threshold=0.8):
    sets = {}
    for d, t in docs:
        w = low_words(t)
        sets[d] = {tuple(w[k: k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links, parent = Counter(), {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            inter = len(sets[a] & sets[b])
            if inter and inter >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


@pytest.mark.parametrize("block", [2000, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]

    def say(n):
        return [str(x) for x in rng.choice(words, n)]

    docs = []
    for _ in range(6):
        base = say(int(rng.integers(30, 160)))
        for _ in range(12):
            other = list(base)
            for _ in range(int(rng.integers(0, 6))):
                other[int(rng.integers(0, len(other)))] = "edit"
            docs.append(" ".join(other))
    docs += [" ".join(say(60)) for _ in range(20)] + ["a b", "A, b!", "a b c", "", None, "x", " ".join(say(3000))] + [" ".join(words[:90])] * 15
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == links_by_hand(rows)


def test_near_duplicates_edges(spark):
    rows = jaccard_join.near_duplicates(edges(spark)).collect()
    assert len(rows) == len(EDGES)
    assert {(r.class_id, r.n_links) for r in rows if r.doc_id in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)} and [r.class_id for r in rows if r.doc_id is None] == [None]
    assert jaccard_join.near_duplicates(none(spark)).count() == 0


def test_pruning_bounds():
    bounds = dict(jaccard_join.least_matches(0.8, 1e-9))
    assert sorted(bounds) == [32, 64, 96, 128] and all(0 < m < 0.8 * k for k, m in bounds.items()) and bounds[128] > 70


# ------------------------------------------------------------------ 8

def test_language(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op8_langid(spark, sf).join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    e = edges(spark)
    got = langid.identify_language(e, e).collect()
    assert len(got) == len(EDGES) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert {r.lang_pred for r in langid.identify_language(e, none(spark)).collect()} == {"und"} and langid.identify_language(none(spark), e).count() == 0


def test_language_of_symbols_beyond_the_basic_plane(spark):
    e = spark.createDataFrame([(1, "one two three four", "en", "a", 0), (2, "un deux trois quatre", "fr", "a", 0), (3, "\U0001F600 \U0001F389\U0001F389", "en", "a", 0)], DOC)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(e, e.where("doc_id < 3")).collect()}
    assert got[3] == ("und", 0) and got[1][0] != "und"
    assert langid.code_points("a\U0001F600b").tolist() == langid.code_points("a b").tolist() and langid.has_letter(langid.code_points("\U00010428"))


# ------------------------------------------------------------------ 9

PAGES = [
    ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; t</h1><p>First <b>bold</b> text\n here, long enough to count.<p>Second one<br>broken line.</article><footer>c</footer></body>", "T & t First bold text here, long enough to count. Second one broken line."),
    ("<body><div id=top class='site-header'>Site</div><div class=content><p>Long article text with many words in it, and more of them.</p><p>Another paragraph of the article, as long as the first one.</p></div><div class=sidebar><ul><li><a>one</a><li><a>two</a></ul></div><div id=comments><p>A reader says a lot of things here, at length, in many words.</p></div></body>", "Long article text with many words in it, and more of them. Another paragraph of the article, as long as the first one."),
    ("<script>var a='<p>no</p>'</script><p>Only&nbsp;this &eacute;</p><form><input value=x><p>Name</p></form>", "Only this é"),
    ("", ""), (None, ""), ("<nav>x</nav>", ""), ("plain", "plain"), ("<div><div><p>unclosed <b>tags <i>here", "unclosed tags here"),
]


ARTICLE = "<h1>A title</h1><p>Long article text with many words in it, and more of them.</p><p>Another paragraph, as long as the first one was.</p>"
SAID = "A title Long article text with many words in it, and more of them. Another paragraph, as long as the first one was."


@pytest.mark.parametrize("name", ["page has-sidebar", "layout no-sidebar", "content share-enabled", "wrapper menu-closed header-fixed"])
def test_main_text_in_named_wrappers(name):
    beside = "<div class=sidebar><ul><li><a>one</a><li><a>two</a></ul></div><div class=comments><p>A reader says things.</p></div>"
    assert html_text.main_text(f"<body><div class='{name}'><div class=text>{ARTICLE}</div></div>{beside}</body>") == SAID
    assert html_text.main_text(f"<body><div class='{name}'><article>{ARTICLE}</article>{beside}</div></body>") == SAID


def test_main_text_keeps_what_belongs_to_an_article():
    assert html_text.main_text(f"<body><form action=/><nav><a>Home</a></nav><div>{ARTICLE}</div></form></body>") == SAID
    assert html_text.main_text(f"<body><div class=overlay><main>{ARTICLE}</main></div><p>Other words.</p></body>") == SAID
    assert html_text.main_text(f"<body><article><div class=section-header>Part one</div>{ARTICLE}</article></body>") == "Part one " + SAID
    assert html_text.main_text(f"<body><article>{ARTICLE}<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article></body>") == SAID + " So x=1 holds."
    assert html_text.main_text("<body><div class=notice><p>All that the page says.</p></div></body>") == "All that the page says."
    comments = "<div class=comments>" + "<article><p>A reader says a lot of things here, at length, in many words.</p></article>" * 9 + "</div>"
    assert html_text.main_text(f"<body><article>{ARTICLE}</article>{comments}</body>") == SAID


def test_main_text(spark):
    assert [html_text.main_text(h) for h, _ in PAGES] == [t for _, t in PAGES]
    df = spark.createDataFrame([(i, "u", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert [r.text for r in html_text.extract_main_text(df).orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert html_text.extract_main_text(df.where("false")).count() == 0
    assert html_text.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_main_text_of_the_table(spark):
    import html
    for r in html_text.op9_html(spark, SF).join(load(spark, SF, "pages"), ["page_id", "url"]).collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", inner))
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


# ------------------------------------------------------------------ 10

def spans_by_hand(rows, run=2, least=12):
    docs = []
    for d, t in rows:
        pieces = re.split(r"(?<=[.!?])(?=[ \t\r\n])|(?<=\n)", t or "")
        said = []
        for p in pieces:
            if low_words(p) or not said:
                said.append([p, low_words(p)])
            elif said:
                said[-1][0] += p
        if len(said) > 1 and not said[0][1]:
            said[1][0] = said[0][0] + said[1][0]
            said.pop(0)
        docs.append((d, said if said and said[0][1] else []))
    places = {}
    for d, said in docs:
        for b in range(len(said)):
            ends = [e for e in range(b + run, len(said) + 1) if sum(len(w) for _, w in said[b:e]) >= least]
            begins = [a for a in range(b - run, -1, -1) if sum(len(w) for _, w in said[a:b]) >= least]
            for x, y in ([(b, ends[0])] if ends else []):
                places.setdefault(tuple(tuple(w) for _, w in said[x:y]), set()).add((d, x, y))
        for e in range(run, len(said) + 1):
            begins = [a for a in range(e - run, -1, -1) if sum(len(w) for _, w in said[a:e]) >= least]
            if begins:
                places.setdefault(tuple(tuple(w) for _, w in said[begins[0]:e]), set()).add((d, begins[0], e))
    gone = set()
    for found in places.values():
        for d, x, y in sorted(found)[1:]:
            gone |= {(d, k) for k in range(x, y)}
    return [(d, len(said), sum((d, k) in gone for k in range(len(said))), "".join(p for k, (p, _) in enumerate(said) if (d, k) not in gone)) for d, said in docs]


def test_sentence_spans(spark):
    rng = np.random.default_rng(8)

    def sentence():
        return " ".join(f"w{x}" for x in rng.integers(0, 50, int(rng.integers(1, 12)))) + str(rng.choice([".", "!", "?!", "...", "\n"]))

    passage = [sentence() for _ in range(8)]
    rows = []
    for i in range(40):
        said = [sentence() for _ in range(int(rng.integers(1, 9)))]
        if i % 3 == 0:
            k = int(rng.integers(0, 4))
            said[1:1] = passage[k: k + int(rng.integers(2, 5))]
        rows.append((i, "  " * (i % 2) + " ".join(said)))
    rows += [(40, rows[3][1]), (41, rows[3][1] + " " + rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).repartition(3)
    got = [(r.doc_id, r.n_sentences, r.n_removed, r.text) for r in sentence_spans.remove_repeated_spans(df).orderBy("doc_id").collect()]
    want = spans_by_hand(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got if g[1]] == [w[3] for w in want if w[1]]


def test_sentence_span_edges(spark):
    rows = sentence_spans.remove_repeated_spans(edges(spark)).collect()
    assert len(rows) == len(EDGES) and [r.text for r in rows if r.doc_id in (1, 2, 3)].count(None) == 1
    assert sentence_spans.remove_repeated_spans(none(spark)).count() == 0
    assert crc_rest("doc_id", 3) is not None


# ------------------------------------------------------------------ ids that are null or repeated

#: Texts of one id differ, rows repeat, and ids are missing.
def _odd_rows(say):
    shared, own = say(3), [say(6) for _ in range(8)]
    return [(1, own[0] + shared), (1, own[1] + shared), (1, own[1] + shared), (2, own[2]), (None, own[3]), (None, own[4]), (None, own[4]), (None, own[5] + shared), (3, own[2])]


def _row_order(spark, rows):
    """The rows in the order of documents, repeated rows once."""
    df = spark.createDataFrame(sorted(set(rows), key=str), "doc_id long, text string")
    doc, tag = row_key("doc_id", "text")
    got = df.select("doc_id", "text", doc.alias("doc"), tag.alias("tag")).collect()
    return [(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r.tag == NO_ID, r.doc, r.tag))]


@pytest.mark.parametrize("most", [10_000, 1])
def test_repeated_bytes_of_odd_ids(spark, monkeypatch, most):
    monkeypatch.setattr(repeated_bytes, "MOST_SEGMENTS", most)
    rng = np.random.default_rng(12)
    rows = _odd_rows(lambda n: "".join(map(chr, rng.integers(97, 123, 90 * n))))
    rows += [(10 + k, "".join(map(chr, rng.integers(97, 123, 60))) + rows[3][1][k * 11: k * 11 + 170]) for k in range(12)]
    order = _row_order(spark, rows)
    want = dict(zip(order, cut_by_hand([t for _, t in order])))
    got = repeated_bytes.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str) == sorted(((d, *want[d, t]) for d, t in rows), key=str)
    assert all(want[r][1] == 0 for r in order if r[0] is None and not r[1].endswith(rows[0][1][-90:]))


def test_index_takes_a_few_anchors_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    o = np.zeros(60, repeated_bytes.OPEN)
    o["anchor"], o["windows"] = rng.integers(0, 9, 60), 3
    data = rng.integers(0, 255, 60 * 102).astype(np.uint8)
    monkeypatch.setattr(repeated_bytes, "INDEX_BYTES", 1500)
    parts = list(repeated_bytes.anchor_groups(o, data, 100))
    assert sorted(np.concatenate([r for r, _ in parts]).tolist()) == list(range(60)) and len(parts) > 3
    assert all((own == data.reshape(60, 102)[rows].reshape(-1)).all() for rows, own in parts)
    assert len({a for rows, _ in parts for a in np.unique(o["anchor"][rows])}) == sum(len(np.unique(o["anchor"][rows])) for rows, _ in parts)


def test_sentence_spans_of_odd_ids(spark):
    rng = np.random.default_rng(13)
    rows = _odd_rows(lambda n: " ".join(" ".join(f"w{x}" for x in rng.integers(0, 900, 8)) + "." for _ in range(n)) + " ")
    order = _row_order(spark, rows)
    want = {row: (n, gone) for row, (_, n, gone, _) in zip(order, spans_by_hand([(k, t) for k, (_, t) in enumerate(order)]))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentence_spans.remove_repeated_spans(df.withColumn("was", F.col("text")).repartition(4)).collect()
    assert sorted(((r.doc_id, r.was, r.n_sentences, r.n_removed) for r in got), key=str) == sorted(((d, t, *want[d, t]) for d, t in rows), key=str)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None and r.was in (rows[4][1], rows[5][1]))


def rows_by_hand(texts, size=5, threshold=0.8):
    """(smallest row that is reached over links, links) of each row."""
    links = links_by_hand(list(enumerate(texts)), size, threshold)
    return [links[k] for k in range(len(texts))]


def _chain(rng, n, length=40):
    """Texts of which each shares most with the next one, and nothing with one far away."""
    words = [f"v{x}" for x in range(length + 2 * n)]
    return [" ".join(words[2 * k: 2 * k + length]) for k in range(n)]


@pytest.mark.parametrize("block, hot", [(2000, 10_000), (5, 10_000), (5, 3)])
def test_near_duplicates_of_odd_ids(spark, monkeypatch, block, hot):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(common, "MOST_HOT", hot)
    monkeypatch.setattr(common, "LEAST_HOT", 2 if hot == 3 else common.LEAST_HOT)
    rng = np.random.default_rng(14)
    a, b, c = (" ".join(f"w{x}" for x in rng.integers(0, 500, 60)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, c), (None, c), (None, c + " end"), (None, "alone " * 9), (3, b + " end"), (None, None), (4, ""), (None, a)]
    rows += [(100 + k, t) for k, t in enumerate(_chain(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    named = [r for r in rows if r[0] is not None]
    want = rows_by_hand([t for _, t in named])
    first = {root: min(d for (d, _), (other, _) in zip(named, want) if other == root) for root, _ in want}
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == sorted((d, first[root], n) for (d, _), (root, n) in zip(named, want))
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, None)] * (len(rows) - len(named))
    want = rows_by_hand([t for _, t in rows])  # the other one takes all rows
    least = {}  # the smallest id of each class
    for (d, _), (root, _) in zip(rows, want):
        least[root] = min((x for x in (d, least.get(root)) if x is not None), default=None)
    kept = jaccard_join.first_of_each_class(df)
    assert kept.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    said = [k for k, (_, t) in enumerate(rows) if low_words(t)]
    assert len([t for _, t in texts if low_words(t)]) == len({want[k][0] for k in said}) and len(texts) == len({want[k][0] for k in said}) + 2
    assert {d for d, t in texts if low_words(t)} == {least[want[k][0]] for k in said}


def test_pairs_share_a_band():
    rng = np.random.default_rng(3)
    bands = rng.integers(0, 6, (80, 5)).astype(np.uint64)
    side = (np.arange(80) >= 40).astype(int)
    for s in (None, side):
        got = [(min(p), max(p)) for x, y in jaccard_join.band_pairs(bands, s) for p in zip(x.tolist(), y.tolist())]
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if (bands[i] == bands[j]).any() and (s is None or side[i] != side[j])}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("across", [False, True])
def test_tiles_and_lists_find_the_same(across):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = []
    for _ in range(90):
        s = base.copy()
        s[rng.integers(0, 60, int(rng.integers(0, 9)))] = rng.integers(0, 1 << 63)
        sets.append(np.unique(s))
    block, comp, side = jaccard_join.Block(sets), np.zeros(90, int), (np.arange(90) >= 30).astype(int)
    decisions = jaccard_join.least_matches(0.8, 1e-9)
    got = [{(min(p), max(p)) for x, y in jaccard_join.compare(block, comp, side if across else None, 0.8, decisions, crowd=c) for p in zip(x.tolist(), y.tolist())} for c in (2, 1000)]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if (not across or side[i] != side[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert got[0] == got[1] == want


# ------------------------------------------------------------------ 1, with many lists

def _points(kind, n, rng):
    if kind == "gaussian":
        return rng.normal(size=(n, 16))
    return rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + 0.3 * rng.normal(size=(n, 32))


@pytest.mark.parametrize("kind, most", [("gaussian", 0.2), ("clustered", 0.2)])
def test_recall_while_little_is_read(spark, kind, most):
    x = _points(kind, 24_000, np.random.default_rng(9))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    report = {}
    got = ann.nearest_neighbours(df, df.where("vec_id % 50 = 0"), list_size=16, report=report).toPandas()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 50):
        s = x @ x[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert hits / (5 * len(range(0, len(x), 50))) >= 0.9 and report["lists"] > 1200
    assert report["scanned"] < most


def test_short_lists_are_read_until_k_are_found(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(1, 8)) + 1e-4 * rng.normal(size=(400, 8)), 50 * np.eye(8)[:4] + rng.normal(size=(4, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.where("vec_id >= 396"), list_size=2, most_probes=1, probe_ratio=1.0).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {5} and len(got) == 8


def test_two_levels_of_centroids(monkeypatch):
    monkeypatch.setattr(ann, "ONE_LEVEL", 16)
    x = np.random.default_rng(11).normal(size=(4000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = ann.fit_router(x, 300)
    assert 250 <= len(r.centroids) <= 350 and np.allclose(np.linalg.norm(r.centroids, axis=1), 1, atol=1e-5)
    size = np.bincount((x @ r.centroids.T).argmax(axis=1), minlength=len(r.centroids))
    assert size.max() <= 6 * len(x) / len(r.centroids)
    found, dist = r.near(x[:200], 8)
    true = np.sort(2 - 2 * x[:200] @ r.centroids.T, axis=1)[:, 0]
    assert (dist[:, 0] <= true + 1e-5).mean() >= 0.9


# ------------------------------------------------------------------ 3, against the exact optimum

def most_words(patterns, targets, copies):
    """The maximum flow as the smallest cut, over all sets of sources."""
    names = list(targets)
    cuts = []
    for bits in range(1 << len(names)):
        inside = {s for k, s in enumerate(names) if bits >> k & 1}
        cuts.append(sum(targets[s] for s in inside) + sum(copies * n for p, n in patterns.items() if not set(p) <= inside))
    return min(cuts)


@pytest.mark.parametrize("seed", range(8))
def test_flow_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", None]
    patterns = {}
    for _ in range(9):
        p = tuple(sorted({names[k] for k in rng.integers(0, 4, int(rng.integers(1, 4)))}, key=str))
        patterns[p] = int(rng.integers(1, 100))
    targets = {s: float(rng.integers(1, 250)) for s in names}
    flows = mixing.route(patterns, targets, 3)
    best = [most_words(patterns, targets, c) for c in range(4)]
    assert abs(sum(flows.values()) - best[3]) < 1e-3 and all(flows[p] <= 3 * n + 1e-6 for p, n in patterns.items())
    cost = sum(max(0, min(flows[p], 2 * n) - n) + 4 * max(0, flows[p] - 2 * n) for p, n in patterns.items())
    assert abs(cost - ((best[2] - best[1]) + 4 * (best[3] - best[2]))) < 1e-3


def test_flow_of_very_many_patterns():
    rng = np.random.default_rng(2)
    names = [f"s{k}" for k in range(60)]
    patterns = {tuple(sorted(names[k] for k in set(rng.integers(0, 60, 5).tolist()))): int(rng.integers(1, 1000)) for _ in range(30_000)}
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    targets = mixing.source_targets(sizes, share=1.5 * sum(patterns.values()) / sum(sizes.values()))
    flows = mixing.route(patterns, targets)
    assert abs(sum(flows.values()) - sum(targets.values())) < 1


def test_mix_of_overlapping_sources_keeps_to_the_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), [["a"], ["a", "b"], ["b", "c"], ["c"]][int(rng.integers(0, 4))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(df, sources=F.col("of"), keep=("size",)).toPandas()
    targets = mixing.source_targets({s: int(sum(len(t.split()) for _, t, of in rows if s in of)) for s in "abc"}, share=1.5 * sum(len(t.split()) for _, t, _ in rows) / sum(len(t.split()) * len(of) for _, t, of in rows))
    assert abs(got.taken.sum() - sum(targets.values())) <= 4 * 40 and (got.taken <= 2 * got["size"]).all()
    only = {p: got[got.sources.map(tuple) == p].taken.sum() for p in [("a",), ("a", "b"), ("b", "c"), ("c",)]}
    assert only["a",] <= targets["a"] + 40 and only["c",] <= targets["c"] + 40 and only["a", "b"] + only["b", "c"] >= targets["b"] - 80


# ------------------------------------------------------------------ 2, rows and columns

@pytest.mark.parametrize("block", [8_000_000, 40])
def test_clean_documents_keep_their_columns(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    b = spark.createDataFrame([(1, "alpha beta gamma"), (2, "zeta eta theta"), (None, "iota kappa lambda")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta", 1), (1, "clean words only", 2), (None, "zeta eta theta", 3), (None, "clean as well", 4), (None, None, 5), (3, "IOTA kappa, lambda", 6), (4, "clean words only", 7), (4, "clean words only", 7)]
    got = decontaminate.clean_documents(spark.createDataFrame(rows, "doc_id long, text string, items int"), b)
    assert got.columns == ["doc_id", "text", "items"] and sorted(r["items"] for r in got.collect()) == [2, 4, 5, 7, 7]
    assert decontaminate.clean_documents(edges(spark), b.where("false")).count() == len(EDGES) and decontaminate.clean_documents(none(spark), b).count() == 0


def test_shift_table_grows_with_the_patterns():
    rng = np.random.default_rng(1)
    few, many = (decontaminate.WuManber(rng.integers(0, 1 << 62, (n, 10)).astype(np.uint64)) for n in (10, 20_000))
    assert few.bits < many.bits and (many.shift == 0).mean() < 0.2


def test_labels_that_disagree_are_not_learnt(spark):
    docs = spark.createDataFrame([(k, f"some words {k} " * (5 + k % 7)) for k in range(60)] + [(3, "another text")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(5, 0), (5, 1)], "doc_id long, quality int")
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_quality(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert a == b and a == sorted((r.doc_id, r.score) for r in quality.score_quality(docs, labels.where("doc_id != 5")).collect())


# ------------------------------------------------------------------ 5, sequences

def test_rules_match_in_order_with_gaps():
    book = ["mit-grant", "rights-reserved", "mit-condition", "mit-as-is"]
    assert licences.match_rules(book) == (["MIT"], ["rights-reserved"])
    assert licences.match_rules(["mit-condition", "mit-grant", "mit-as-is"])[0] == []
    assert licences.match_rules(["mit-grant", *["rights-reserved"] * 4, "mit-condition"])[0] == []
    assert licences.match_rules(["mit-title", "gpl3-later", "mit-grant", "gpl-no-warranty", "mit-condition", "mit-as-is"]) == (["MIT", "GPL-3.0-or-later"], [])
    assert {x for _, rule in licences.RULES for x in rule} <= set(licences.SENTENCES)


def test_licences_are_found_by_their_own_sentences(spark):
    texts = [(name, ".\n".join(licences.SENTENCES[x] for x in rule) + ".\n") for name, rule in licences.RULES]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: list(r.licences) for r in licences.scan_licences(df).collect()}
    assert [got[k] for k in range(len(texts))] == [[name] for name, _ in texts]


# ------------------------------------------------------------------ 9, broken pages and densities

@pytest.mark.parametrize("seed", range(4))
def test_no_page_stops_the_run(seed):
    rng = np.random.default_rng(seed)
    bits = ["<", "</", ">", "!", "[", "]", "--", "<!", "<![", "]]>", "<?", "p", "div", "script", " a=\"", "'", "&", "&#", "&#x", "x;", "article", "\0", "é", "\n", "<textarea>", "<plaintext>", "<title>", "<svg>", "="]
    for _ in range(3000):
        html_text.main_text("".join(bits[k] for k in rng.integers(0, len(bits), int(rng.integers(1, 25)))))
    assert html_text.main_text("<p>a<![foo[x]]>b</p>") == "ab"
    assert html_text.main_text(f"<body><![foo[x]]><article>{ARTICLE}</article></body>").endswith(SAID)


@pytest.mark.parametrize("html, want", [
    (f"<body><div class='layout with-sidebar'><article>{ARTICLE}</article></div></body>", SAID),
    (f"<body><div class='has-header site'><div>{ARTICLE}</div></div></body>", SAID),
    ("<body><article><header class='entry-header'><h1>T</h1></header><p>Words of it.</p></article></body>", "T Words of it."),
    ("<body><article><div class='article-header'><h1>T</h1></div><p>Words of it.</p></article></body>", "T Words of it."),
    (f"<body><article>{ARTICLE}<section id='related-work'><h2>Related work</h2><p>Others said it before.</p></section></article></body>", SAID + " Related work Others said it before."),
    (f"<body><article>{ARTICLE}<div class='related-posts'><a>One other post</a> <a>Another post</a></div><div class='post-comments'><p>A reader says things.</p></div></article></body>", SAID),
    (f"<body><form>{ARTICLE}</form></body>", SAID),
    (f"<body><div id=nav><a>x</a><a>y</a></div><div id=content>{ARTICLE}<div>short</div><p>Tail of it, long as well.</p></div><div id=footer>foot</div></body>", SAID + " short Tail of it, long as well."),
])
def test_main_text_of_hard_pages(html, want):
    assert html_text.main_text(html) == want


def test_density_sums_are_those_of_the_formula():
    import math
    reader = html_text.TreeReader()
    reader.feed("<body><div><p>some words <a>a link</a></p><p>more words of the text</p></div><ul><li><a>one</a></li><li><a>two</a> x</li></ul></body>")
    reader.close()
    body = reader.root.children[0]
    html_text._measure(body)

    def count(n, linked=False):
        """(characters, tags, link characters, link tags) of a subtree."""
        linked = linked or n.tag == "a"
        c = t = lc = lt = 0
        for x in n.children:
            if isinstance(x, str):
                size = len(re.sub(r"\s+", " ", x).strip())
                c, lc = c + size, lc + size * linked
            else:
                a = count(x, linked)
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3] + (x.tag == "a")
        return c, t, lc, lt

    whole = count(body)

    def density(n):
        c, t, lc, lt = count(n)
        if not c:
            return 0.0
        base = max(math.log(c / max(1, c - lc) * lc + whole[2] / max(1, whole[0]) * c + math.e), 1 + 1e-9)
        return c / max(1, t) * math.log(max(1.0, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(base)

    stack = [body]
    while stack:
        n = stack.pop()
        below = [x for x in n.children if not isinstance(x, str)]
        assert math.isclose(n.density, density(n), abs_tol=1e-9) and math.isclose(n.total, sum(density(x) for x in below), abs_tol=1e-9)
        stack += below
    assert html_text._best(body).tag == "div"


# ------------------------------------------------------------------ tables between steps

def test_few_rows_are_few_files(spark):
    """Each file makes an executor fork; tables of known, few rows have a file for each core, not one for each partition."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(0, 300, 2):
        words = [f"w{k}" for k in rng.integers(0, 5000, 60)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words, "more"]))]
    asked = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in asked}
    there = Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(there.rglob("part-*.parquet"))
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        got = {r.doc_id for r in jaccard_join.first_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert got == set(range(0, 300, 2))
    files = Counter(p.parent.name.rsplit("-", 1)[0] for p in set(there.rglob("part-*.parquet")) - old)
    assert {"classes", "hubs", "candidates", "linked", "table"} <= set(files)
    # Two tables are called members; links are as many tasks as their sets of words ask for.
    assert all(n <= 4 * (1 + (label == "members")) for label, n in files.items() if label not in ("described", "links")), files


def test_workers_give_back_what_they_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(1))
    assert list(common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and calls == [1]
    assert common.trimmed_group(lambda table: table + 1)(1) == 2 and calls == [1, 1]
    monkeypatch.undo()
    common._give_back()
