import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from baitlens.llm import queries
from baitlens.llm import url_filter as u

URLS = ["http://example.org/en/12", "https://a.example.org/es/1", "HTTP://EXAMPLE.ORG/en/2?x=/es/", "https://shop.com/fr/9#a", "http://x.com/de/", "http://org/",
        "http://notorg/", "http://example.org", "http://b.org?x://c.com/de/", "ftp://É.Com/de/1", "no scheme", "", None, "://", "http://a.net/fr/1\nhttp://b.com/de/", "a://b://c.com/de/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def rule_of(host, path):
    found = [(len(text), text, said) for said, text in u.RULES for h, s, p in [text.partition("/")]
             if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
    return max(found)[1:] if found else (None, None)


def brute_segment(counts, name):
    """The best of all ways to cut a name."""
    total = sum(counts.values()) or 1
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(name) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
        words = [name[a:b] for a, b in zip(at, at[1:], strict=False)]
        score = sum(math.log10(counts[w] / total) if w in counts else (-math.log10(total) - 1) * len(w) for w in words)
        best = max(best or -1e9, score)
    return best


@pytest.mark.parametrize("name", ["bigbank", "thebig", "xbankx", "a", "", "bankbankthe", "zzz"])
def test_viterbi_finds_the_best_cut(name):
    counts = {"big": 30, "bank": 20, "the": 90, "ban": 5, "k": 2, "b": 1}
    segment = u.Segmenter(counts)
    words = segment(name)
    assert "".join(words) == name
    score = sum(segment.score.get(w, segment.unknown * len(w)) for w in words)
    assert abs(score - brute_segment(counts, name)) < 1e-9 if name else words == []


def brute_verdicts(pages):
    """Rules, then naive Bayes by hand on the same tokens."""
    words = {}
    for _, _, html in pages:
        for w in re.findall(r"[^\W\d_]+", re.sub(r"(?s)<[^>]*>", " ", html or "").lower()):
            words[w] = words.get(w, 0) + 1
    total = sum(words.values())
    segment = u.Segmenter({w: n for w, n in words.items() if n >= u.MIN_SHARE * total})
    counts, prior = {"allow": {}, "block": {}}, {"allow": 1, "block": 1}
    rows = []
    for page, url, _ in pages:
        host, path = parts(url)
        rule, said = rule_of(host, path)
        found = [u.bucket(t) for t in u.tokens(host, path, segment)]
        rows.append((page, host, path, rule, said, found))
        if said:
            prior[said] += 1
            for b in found:
                counts[said][b] = counts[said].get(b, 0) + 1
    used = max(len(counts["allow"] | counts["block"]), 1)
    size = {c: sum(counts[c].values()) + used for c in counts}
    out = []
    for page, host, path, rule, said, found in rows:
        score = math.log(prior["block"] / prior["allow"]) + sum(
            math.log((counts["block"].get(b, 0) + 1) / size["block"]) - math.log((counts["allow"].get(b, 0) + 1) / size["allow"]) for b in found)
        out.append((page, host, path, rule, said or ("block" if score > 1e-12 else "allow")))
    return sorted(map(str, out))


def test_rules_and_verdicts_equal_brute_force(spark, clashing):
    html = "<html><b>the bank</b> of shop<script>x</script> com de fr</html>"
    pages = [(i, url, html if i % 3 else None) for i, url in enumerate(URLS * 2)] + [(None, "http://bankshop.net/de/1", ""), (3, URLS[3], html)]
    frame = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"), "host", "verdict", "rule", "buckets")
    got = u.filter_urls(frame)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_verdicts(pages)


def test_unknown_letters_and_digits_are_one_word_each():
    segment = u.Segmenter({"bank": 5, "the": 90})
    assert segment("zzqbank12") == ["zzq", "bank", "12"] and segment("xy907the") == ["xy", "907", "the"]


def test_rare_words_cut_hosts(spark):
    """One word in 200,000 cuts the hosts; without it its letters tell nothing apart."""
    html = "filler " * 200_000 + "quokka"
    urls = ["http://quokkaxyz.com/de/", "http://xyzakkouq.com/fr/"] * 3 + ["http://quokka.net/", "http://akkouqquokka.net/"]
    pages = spark.createDataFrame([(i, x, html if i == 0 else "") for i, x in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(pages).collect()}
    assert got[6] == "block" and got[7] == "block"


def test_long_words_cut_hosts(spark):
    """A word of sixty letters is found in a host, another with the same opening is not."""
    word, other = "quokka" * 10, "quokka" * 5 + "wombat" * 5
    counts = spark.createDataFrame([(word, 3), (other, 5), ("bank", 90)], "w string, n long")
    hosts = spark.createDataFrame([(f"bank{word}bank.net",), ("bankquokka.net",)], "host string")
    got = {r["h"]: r["words"] for r in u.host_words(hosts, counts).collect()}
    assert got == {f"bank{word}bank.net": ["bank", word, "bank", "net"], "bankquokka.net": ["bank", "quokka", "net"]}


def test_empty_and_without_labelled_rows(spark):
    schema = "page_id long, url string, html string"
    assert u.filter_urls(spark.createDataFrame([], schema)).count() == 0
    rows = u.filter_urls(spark.createDataFrame([(1, "http://x.net/", None), (2, None, None)], schema)).collect()
    assert {(r["rule"], r["verdict"]) for r in rows} == {(None, "allow")}


def test_long_urls(spark):
    url = "http://" + "ab" * 3000 + ".com/de/" + "x" * 50_000
    row = u.filter_urls(spark.createDataFrame([(1, url, "ab")], "page_id long, url string, html string")).first()
    assert row["rule"] == "com/de/" and len(row["path"]) == 50_004


def test_query_equals_brute_force(spark, sf):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(str(tuple(r)) for r in queries.op8_url_filter(spark, sf).collect()) == brute_verdicts(pages)


def test_held_out_rules_are_learned(spark, sf):
    """Hide the rule from a fifth of the labelled URLs: the classifier mostly says what the rule says."""
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet")
    judged = u.filter_urls(pages).where("rule IS NOT NULL")
    counts = spark.sparkContext.broadcast(u.unigrams(pages, "html"))
    rows = judged.withColumn("buckets", u.token_buckets(F.col("host"), F.col("path"), counts))
    model = spark.sparkContext.broadcast(u.naive_bayes(rows.where("page_id % 5 <> 0")))
    checked = rows.where("page_id % 5 = 0").withColumn("said", u.bayes_verdict(F.col("buckets"), model)).collect()
    right, block = np.mean([r["said"] == r["verdict"] for r in checked]), np.mean([r["verdict"] == "block" for r in checked])
    assert right > max(block, 1 - block) + 0.05
