import re
from collections import defaultdict

import duckdb
from check_queries import compare, connect

from baitlens.llm import source_mix as m


def levels(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets_sizes_and_copies(corpus):
    rows = m.mix_report(corpus).collect()
    texts = defaultdict(list)
    for r in corpus.collect():
        texts[r["doc_id"]].append((r["source"], len(re.findall("[^\x20\x09-\x0D]+", r["text"] or ""))))
    sizes = defaultdict(int)
    for found in texts.values():
        for source, n in found:
            sizes[source] += n
    want = levels(sizes)
    source_of = {(i, n): s for i, found in texts.items() for s, n in found}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(rows) == corpus.count()
    for r in rows:
        source = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] += r["taken"]
        largest[source] = max(largest[source], r["size"])
    for source, target in want.items():
        assert abs(taken[source] - target) <= 3 * largest[source]


def test_near_target_without_repeated_rows(spark):
    rows = [(i, "w " * (i % 37 + 1), "en", f"s{i % 5}", 1) for i in range(2000)]
    out = m.mix_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source_size"], r["target"]] += r["taken"]
    for (_, target), words in taken.items():
        assert abs(words - target) <= 37 / 2 + 1


def test_equal_ranks_are_divided(spark):
    """Repeated, null and single ids alike come within half a document of the target, and reruns agree."""
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(7, f"w{i} " + "w " * 9, "en", "a", 1) for i in range(100)]
    rows += [(None, "v " * 10 + ("" if i % 2 else "v"), "en", "b", 1) for i in range(333)]
    rows += [(i, "u " * 10, "en", "c", 1) for i in range(100)] + [(5, "same " * 10, "en", None, 1)] * 250
    frame = spark.createDataFrame(rows, schema)
    report = m.mix_report(frame).collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in report)
    mixed = m.mix_documents(frame)
    first = sorted(map(str, mixed.collect()))
    assert first == sorted(map(str, m.mix_documents(frame.repartition(7)).collect()))
    words = defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(r["text"].split())
    sizes = {"a": 1000, "b": sum(len(r[1].split()) for r in rows if r[3] == "b"), "c": 1000, None: 2500}
    want = levels(sizes)
    assert any(t % sizes[s] for s, t in want.items())
    for source, t in want.items():
        assert abs(words[source] - t) <= 11 / 2 + 1e-6
    assert sum(words.values()) == sum(r["taken"] for r in report)
    db = duckdb.connect()
    db.register("documents", frame.toArrow())
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(str(tuple(r[n] for n in names)) for r in report) == sorted(map(str, db.sql(f"SELECT {', '.join(names)} FROM ({m.ORACLE})").fetchall()))


def test_larger_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * (100 if i % 2 else 4), "en", "a", 1) for i in range(3000)]
    out = m.mix_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    part = [r for r in out if 0 < r["target"] / r["source_size"] % 1 < 1]
    extra = {size: sum(r["taken"] // r["size"] - r["target"] // r["source_size"] for r in part if r["size"] == size) for size in (4, 100)}
    assert extra[100] > extra[4]


def test_mix_repeats_rows_and_reruns_agree(corpus, empty, clashing):
    frame = clashing(corpus, "_copies", "_copy", "size", "_last", "whole", "d0")
    mixed = m.mix_documents(frame)
    assert mixed.columns == frame.columns
    first = sorted(map(str, mixed.collect()))
    assert first == sorted(map(str, m.mix_documents(frame.repartition(5)).collect()))
    words = sum(len(re.findall("[^\x20\x09-\x0D]+", r["text"] or "")) for r in mixed.collect())
    assert words == sum(r["taken"] for r in m.mix_report(frame).collect())
    assert m.mix_report(empty).count() == 0 and m.mix_documents(empty).count() == 0


def test_query_equals_sql(spark, sf):
    assert compare(spark, connect(sf), "op3_pareto_mix", sf)[0] == "ok"
