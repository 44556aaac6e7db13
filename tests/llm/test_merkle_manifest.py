import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from baitlens.llm import merkle_manifest as m
from baitlens.llm import queries

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels of a tree and, for each leaf, its siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i // 3 * 3
            path.append((level[run:i], level[i + 1:run + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """Rows ``doc_id text lang source n_chars``."""
    fields = [(i, s, lang, n, t) for i, t, lang, s, n in rows]
    groups = {}
    for f in fields:
        claimed = f
        if f[0] is not None and zlib.crc32(str(f[0]).encode()) % 2 == 0 and f[4] is not None:
            claimed = (*f[:4], f[4].replace("\n", ""))
        groups.setdefault(f[1], []).append((f[0], leaf_of(f), leaf_of(claimed)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in groups[s]])
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (i, leaf, claimed), path in zip(groups[s], trees[s][1], strict=True):
            whole, node = path + above, claimed
            for before, after in whole:
                node = h(*before, node, *after)
            out.append((i, leaf, trees[s][0], root, h(*[x for b, a in whole for x in (*b, *a)]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("every", [1, 2, 4])
def test_equals_a_plain_tree(spark, corpus, every):
    rows = [tuple(r) for r in corpus.collect()]
    got = m.tampered_report(corpus, every)
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n, sources", [(1, 1), (3, 1), (4, 1), (82, 1), (10, 10), (250, 2), (90, 85)])
def test_shapes_of_trees(spark, n, sources):
    rows = [(i, f"t{i}\nx", None, f"é{i % sources}", i) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(map(tuple, m.tampered_report(frame).collect()), key=str) == brute(rows)


def test_only_stored_levels_are_written_and_proofs_are_whole(spark, tmp_path):
    """730 leaves of one group: levels 0, 2, 4 and 6 hold 730, 82, 10 and 2 nodes; proofs come from the files alone."""
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(730)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    built = m.build(frame, folder=str(tmp_path / "manifest"), every=2)
    read = m.read_manifest(spark, str(tmp_path / "manifest"))
    assert [g.agg(F.sum(F.size("items"))).first()[0] for g in read.groups] == [730, 82, 10, 2]
    assert max(g.agg(F.max(F.size("items"))).first()[0] for g in read.groups) <= 9
    assert read.root == built.root == brute(rows)[0][3]
    proofs = m.proofs(read).collect()
    assert len(proofs) == 730 and {len(r["path"]) for r in proofs} == {7}
    for r in proofs:
        assert m.fold(r["node"].hex(), [tuple(s) for s in r["path"]]) == built.root
        assert r["node"].hex() == leaf_of((r["key"], "s", "en", 1, f"text {r['key']}"))


def test_a_changed_leaf_does_not_verify(spark):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(40)]
    got = m.tampered_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 2 == 0}


def test_empty_extra_and_clashing_columns(spark, empty, corpus, clashing):
    got = m.tampered_report(empty)
    assert got.columns == NAMES and got.count() == 0
    assert m.proofs(m.build(empty)).count() == 0
    odd = clashing(corpus, "grp", "pos", "n", "node", "blk", "items", "above", "leaf", "root", "key", "claim")
    assert sorted(map(tuple, m.tampered_report(odd).collect()), key=str) == brute([tuple(r) for r in corpus.collect()])


def test_query_equals_a_plain_tree(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, sf).collect()), key=str) == brute(rows)
