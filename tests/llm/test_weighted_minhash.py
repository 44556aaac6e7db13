import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from baitlens.llm import queries
from baitlens.llm import weighted_minhash as m
from baitlens.llm.common import components

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    found = WORD.findall(text or "")
    return Counter(tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()


def brute_classes(rows, similarity=0.8):
    """Classes by plain pairs of texts; inverse document frequencies clipped as the operator clips them."""
    texts = sorted({r["text"] for r in rows if r["text"] is not None})
    n = len([r for r in rows if shingles(r["text"])])
    df = Counter(s for r in rows for s in shingles(r["text"]))
    weighed = [{s: k * np.log1p(1 / max(df[s] / n, m.RARE_SHARE)) for s, k in shingles(t).items()} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(weighed):
        for j in range(i):
            b = weighed[j]
            common = sum(min(w, b[s]) for s, w in a.items() if s in b)
            if common and common / (sum(a.values()) + sum(b.values()) - common) >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {t: find(i) for i, t in enumerate(texts)}


def check(rows, got):
    classes = brute_classes(rows)
    smallest = {}
    for r in rows:
        if r["text"] is not None and r["doc_id"] is not None:
            c = classes[r["text"]]
            smallest[c] = min(smallest.get(c, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), str(smallest.get(classes[r["text"]]) if r["text"] is not None else r["doc_id"])) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_classes_equal_brute_force(corpus):
    check(corpus.collect(), m.class_report(corpus).collect())


def test_family_with_a_chain_and_strangers_in_its_buckets(spark):
    """Members drift, so far ends are below the threshold; all are one class, and half-copies stay out."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(12):
        text = list(base)
        for k in range(step):
            text[k * 16] = f"changed{k}"
        rows.append((step, " ".join(text)))
    rows += [(100 + i, " ".join(base[:100] + [f"own{i}_{k}" for k in range(100)])) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(frame.collect(), m.class_report(frame).collect())


def test_candidate_links_between_components_are_not_lost(spark, monkeypatch):
    """One bucket holds everything: the comparison alone decides."""
    monkeypatch.setattr(m, "band_keys", lambda s, w, at: np.zeros((len(at) - 1, m.BANDS), np.uint64))
    texts = ["a b c d e f g h", "q r s t u v w x", "a b c d e f g h i", "q r s t u v w x y", "1 2 3 4 5 6 7", "a b c d e f g h i j"]
    keys = spark.createDataFrame([(1, i, i) for i in range(len(texts))], "key long, node long, doc_id long")
    pages = spark.createDataFrame(list(enumerate(texts)), "node long, text string")

    weights = spark.sparkContext.broadcast(m.Weights(np.zeros((m.SKETCH_ROWS, m.SKETCH_COLUMNS), np.int64), len(texts)))
    links = m.near_duplicate_links(keys, pages, weights, 0.6)
    roots = {r["node"]: r["root"] for r in components(links, "test").collect()}
    assert roots == {0: 0, 2: 0, 5: 0, 1: 1, 3: 1}


def test_similar_texts_share_a_prefix_shingle():
    rng = np.random.default_rng(4)
    weights = m.Weights(rng.integers(1, 60, (m.SKETCH_ROWS, m.SKETCH_COLUMNS)), 100)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        a, b = (np.sort(rng.choice(pool, rng.integers(1, 40), replace=False)) for _ in range(2))
        ca, cb = rng.integers(1, 3, len(a)), rng.integers(1, 3, len(b))
        if m.weighted_jaccard((a, weights(a, ca)), (b, weights(b, cb))) >= 0.5:
            last = set(rng.choice(pool, 15).tolist())
            first = [set(x[weights.prefix(x, c, 0.5, np.array([k in last for k in x.tolist()]))].tolist()) for x, c in ((a, ca), (b, cb))]
            assert first[0] & first[1]


def test_draws_agree_as_often_as_the_weighted_jaccard(monkeypatch):
    monkeypatch.setattr(m, "BANDS", 600)
    monkeypatch.setattr(m, "DRAWS", 1)
    rng = np.random.default_rng(3)
    s = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    a, b = np.arange(60), np.arange(20, 90)
    wa, wb = rng.uniform(0.5, 9, 60), rng.uniform(0.5, 9, 70)
    keys = m.band_keys(np.concatenate([s[a], s[b]]), np.concatenate([wa, wb]), np.array([0, 60, 130]))
    low = dict(zip(a, wa)), dict(zip(b, wb))
    union = sum(max(low[0].get(i, 0), low[1].get(i, 0)) for i in range(90))
    want = sum(min(low[0].get(i, 0), low[1].get(i, 0)) for i in range(90)) / union
    assert abs((keys[0] == keys[1]).mean() - want) < 0.07


def test_frequencies_never_undercount(corpus):
    sketch, n = m.document_frequencies(corpus)
    texts = [r["text"] for r in corpus.collect()]
    assert n == len([t for t in texts if shingles(t)])
    found, _, at = m.shingle_counts(pa.array(texts))
    df = Counter(found.tolist())
    values = np.array(list(df), np.uint64)
    low = np.min([sketch[r][p] for r, p in enumerate(m.sketch_places(values))], axis=0)
    assert (low >= np.array(list(df.values()))).all() and (low == np.array(list(df.values()))).mean() > 0.9


def test_one_row_of_each_class_stays(corpus, empty, clashing):
    frame = clashing(corpus, "node", "_rows", "_d", "kept", "class_id")
    kept = m.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    rows, classes = kept.collect(), brute_classes(corpus.collect())
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert len(ids) == len(set(ids))
    texts = [classes[r["text"]] for r in rows if r["text"] is not None]
    assert len(texts) == len(set(texts)) == len(set(classes.values()))
    assert m.class_report(empty).count() == 0 and m.drop_near_duplicates(empty).count() == 0


def test_query_finds_plain_near_copies(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: r["class_id"] for r in queries.op6_weighted_minhash(spark, sf).collect()}
    assert len(got) == len(rows)
    sets = {r["doc_id"]: set(shingles(r["text"])) for r in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and len(a & b) >= 0.9 * len(a | b):
                assert got[i] == got[j]


@pytest.mark.parametrize("edges, want", [
    ([(2, 1), (3, 2), (5, 4), (9, 9)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(i, 50) for i in range(40)] + [(60, 50)], {i: 0 for i in [*range(40), 50, 60]}),
    ([], {}),
])
def test_components(spark, edges, want):
    found = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)
