import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from baitlens.llm import queries
from baitlens.llm import repeated_windows as w


def brute(texts):
    """Covered bytes of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[p:p + w.WINDOW] for b in raw for p in range(len(b) - w.WINDOW + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - w.WINDOW + 1):
            if counts[b[p:p + w.WINDOW]] > 1:
                gone[p:p + w.WINDOW] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in w.removal_report(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges_of_passages_equal_brute_force(spark):
    draw = random.Random(11)

    def noise(n):
        return "".join(draw.choice("abcdefghij é") for _ in range(n))

    passage = noise(900)
    texts = [noise(draw.randrange(0, 500)) + passage[draw.randrange(300):draw.randrange(400, 900)] + noise(draw.randrange(0, 500)) for _ in range(40)]
    texts += [passage, passage[:200], passage[:199], passage[:201], noise(150) + passage[100:300], passage[50:] + passage[50:], noise(1000)]
    check(spark, texts)


def test_repeats_inside_one_text_overlaps_and_short_texts(spark):
    draw = random.Random(12)
    unit = "".join(draw.choice("abcdef") for _ in range(37))
    texts = ["x" * 1000, "y" * 200, "z" * 201, "ab" * 400, unit * 20, "", None, "short", "q" * 199, "é" * 150, unit * 3 + "tail" * 60]
    check(spark, texts)


def test_repeated_rows_nulls_and_long_texts(corpus, monkeypatch):
    monkeypatch.setattr(w, "SEGMENT", 1 << 12)
    w._powers.cache_clear()
    rows = corpus.collect()
    want = Counter((str(r["doc_id"]), *x) for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True))
    got = Counter((str(r["doc_id"]), *tuple(r)[1:]) for r in w.removal_report(corpus).collect())
    assert got == want


@pytest.fixture(autouse=True)
def powers():
    yield
    w._powers.cache_clear()


def test_spans_and_bytes_fit_together(corpus, empty, clashing):
    out = w.remove_repeated(clashing(corpus, "places", "key", "removed_spans", "k"))
    assert out.columns[-2:] == ["removed_spans_", "kept_bytes"]
    for r in out.collect():
        raw, at = (r["text"] or "").encode(), 0
        kept = b""
        for s in r["removed_spans_"]:
            kept += raw[at:s["start"]]
            at = s["end"]
        assert kept + raw[at:] == bytes(r["kept_bytes"])
    assert w.removal_report(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, brute([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op7_repeated_windows(spark, sf).collect()} == want
