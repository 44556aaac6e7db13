import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline as p
from baitlens.llm import byte_bpe, queries, source_mix
from baitlens.session import materialise
from test_line_templates import brute as brute_lines
from test_line_templates import cleaned
from test_quality_rules import brute as brute_counts
from test_weighted_minhash import brute_classes


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def brute_stage(name, before, after):
    """What the stage's rows must be, from the rows before it."""
    if name == "quality_rules":
        kept = [r for r in before if (c := brute_counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
        assert Counter(after) == Counter(kept)
    elif name == "line_dedup":
        gone = brute_lines(before)
        want = [(r["doc_id"], cleaned(r["text"], gone[r["text"]])) for r in before]
        assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(want)
        assert all(r["n_chars"] == len(r["text"]) for r in after)
    elif name == "near_duplicates":
        classes = brute_classes(before)
        least = {}
        for r in before:
            if r["doc_id"] is not None:
                c = classes[r["text"]]
                least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
        want = {(r["doc_id"], r["text"]) for r in before if r["doc_id"] == least.get(classes[r["text"]])}
        assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(want)
    else:
        assert set(after) <= set(before) and max(Counter(after).values()) <= 2
        total, size = sum(len(words(r["text"])) for r in after), sum(len(words(r["text"])) for r in before)
        largest = {s: max(len(words(r["text"])) for r in before if r["source"] == s) for s in {r["source"] for r in before}}
        assert abs(total - 1.5 * size) <= sum(largest.values())


def test_stages_equal_brute_force(spark, corpus, sf):
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "byte_bpe"]
    docs = materialise(corpus, "test-docs")
    for name, stage in p.STAGES[:-1]:
        out = materialise(stage(spark, docs, sf), f"test-{name}")
        assert out.dtypes == docs.dtypes
        brute_stage(name, docs.collect(), out.collect())
        docs = out
    model = byte_bpe.bpe(public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN)
    want = Counter((r["doc_id"], len(model.encode(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in docs.collect())
    last = p.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in last) == want


def test_stages_take_empty_tables_and_extra_columns(spark, empty, corpus, clashing):
    extra = clashing(corpus, "kept", "key", "node", "copies", "ids", "host")
    for _, stage in p.STAGES:
        assert stage(spark, empty, "").count() == 0
        assert stage(spark, materialise(extra, "test-extra"), "").count() > 0


def test_run_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = docs.select(source_mix.word_count(docs["text"]).alias("n")).groupBy().sum("n").first()[0]
    rows = p.run(spark, sf).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()} and size > 0


def test_entry_has_every_numbered_query():
    names = set(entry_point.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if re.match(rf"op{n}_", q)]) == 1
    assert {"op1_host_quality_rules", "op3_pareto_mix", "op10_warc_archive", "op11_merkle_manifest", "op13_metric_tree_search"} <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("module", ["corpus_pipeline", "baitlens.llm"])
def test_the_rest_works_without_them(module):
    """An import that fails only takes the numbered queries away."""
    import subprocess
    import sys

    code = (f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; n = e.queries(); "
            "assert 'split_audit' in n and 'pipeline' not in n and not [x for x in n if x.startswith('op')]; e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry_point.__file__.rsplit("/", 1)[0], timeout=120)
