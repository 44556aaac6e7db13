import re
from collections import Counter

from check_queries import compare, connect

from baitlens.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    found = WORD.findall(text)
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(corpus):
    rows = q.judge(corpus).collect()
    assert len(rows) == corpus.count()
    for r in rows:
        n_words, _, _, _, repeated = counts = brute(r["text"])
        assert tuple(r[c] for c in q.COUNTS) == counts
        assert r["base_failed"] == (n_words < 50 or 100 * repeated > 50 * n_words)
        assert r["kept"] == (not r["base_failed"] and not r["host_failed"])


def test_bad_host_is_refused_and_small_host_is_shrunk(spark):
    good, junk = " ".join(f"w{i}" for i in range(80)), "a b " * 60
    rows = [(i, good, "en", "good", 1) for i in range(200)] + [(1000 + i, junk, "en", "bad", 1) for i in range(99)]
    rows += [(2000, good, "en", "bad", 1), (3000, junk, "en", "tiny", 1), (3001, good, "en", "tiny", 1)]
    judged = {r["doc_id"]: r for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()}
    assert judged[2000]["host_failed"] and not judged[2000]["kept"]
    assert judged[0]["kept"] and not judged[0]["host_failed"]


def test_priors_follow_the_moments(spark):
    hosts = spark.createDataFrame([("a", 100, 10, 0, 0), ("b", 100, 30, 0, 0), ("c", 100, 50, 0, 100)], "h string, n long, f_base long, f_symbols long, f_lines long")
    alpha, beta = q.beta_priors(hosts)["base"]
    mean, between = 0.3, (0.04 + 0 + 0.04) / 3 - 0.21 * 3 / 300
    assert abs(alpha / (alpha + beta) - mean) < 1e-12
    assert abs(alpha + beta - max(0.21 / between - 1, 1)) < 1e-9
    assert q.beta_priors(hosts)["symbols"] == (0.0, 300.0)


def test_stage_keeps_rows_and_columns(corpus, empty, clashing):
    kept = q.kept_documents(clashing(corpus, "kept", "n_words", "_n_words", "h", "_host", "Host_Failed"))
    assert kept.columns == [*corpus.columns, "kept", "n_words", "_n_words", "h", "_host", "Host_Failed"]
    assert {r["kept"] for r in kept.collect()} == {"mine"}
    ids = [r["doc_id"] for r in q.kept_documents(corpus).collect()]
    assert ids.count(3) == 3 and 300 not in ids and 0 in ids
    assert q.judge(empty).count() == 0 and q.kept_documents(empty).columns == empty.columns


def test_query_equals_sql(spark, sf):
    assert compare(spark, connect(sf), "op1_host_quality_rules", sf)[0] == "ok"
