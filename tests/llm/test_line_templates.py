import re
from collections import Counter, defaultdict

import pyarrow as pa

from baitlens.llm import line_templates as t
from baitlens.llm import queries

WORD = re.compile("[^\x20\x09-\x0D]+")


def masked(line):
    return tuple(None if re.search("[0-9]", w) else w for w in WORD.findall(line))


def code(word):
    """The module's code of a token, only used to settle ties."""
    return 0 if word is None else int(t.parse_lines(pa.array([word]))[5][0])


def brute(rows, min_texts=10, similarity=0.8, depth=4, long=10):
    """Dropped line numbers of every text, with whole tokens."""
    texts = {}
    for r in rows:
        if r["text"] is not None:
            key = (r["doc_id"] is None, r["doc_id"])
            texts[r["text"]] = min(texts.get(r["text"], key), key)
    lines, holders, least = [], defaultdict(set), {}
    for x in texts:
        for i, line in enumerate(x.split("\n")):
            m, raw = masked(line), tuple(WORD.findall(line))
            if raw:
                plain = sum(w is not None for w in m)
                name = ("own", m) if plain else ("raw", raw)
                lines.append((x, i, name))
                holders[name].add(x)
                least[name] = 2 if len(raw) >= long and (not plain or plain >= similarity * len(raw)) else min_texts
    leaves, template = defaultdict(list), {}
    for kind, m in holders:
        if kind == "own":
            leaves[len(m), m[:depth]].append(m)
    for leaf, left in leaves.items():
        turn = 0
        while sum(len(holders["own", m]) for m in left) >= min_texts:
            profile = []
            for p in range(leaf[0]):
                votes = Counter()
                for m in left:
                    votes[m[p]] += len(holders["own", m])
                profile.append(max(votes, key=lambda w: (votes[w], code(w))))
            behind = leaf[0] - depth
            joins = [m for m in left if behind > 0 and (n := sum(a == b for a, b in zip(m[depth:], profile[depth:], strict=True))) >= max(2, similarity * behind) and n]
            if sum(len(holders["own", m]) for m in joins) < min_texts:
                break
            for m in joins:
                template["own", m] = ("template", leaf, turn)
                holders["template", leaf, turn] |= holders["own", m]
            least["template", leaf, turn] = min_texts
            left, turn = [m for m in left if m not in joins], turn + 1
    gone = defaultdict(set)
    for x, i, own in lines:
        for name in (own, template.get(own)):
            if name is not None and len(holders[name]) >= least[name] and x != min(holders[name], key=lambda y: texts[y]):
                gone[x].add(i)
    return gone


def cleaned(text, gone):
    return None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def logs(spark, n=14):
    rows = [(i, f"Session {i} of user u{i} opened from host {'alpha' if i % 5 else 'beta'} today at noon sharp\nown words {'abcdefghijklmnop'[i]} alone {'x' * i}\n\n12 34",
             "en", "s", 1) for i in range(n)]
    rows += [(50, "Session 9 of user went somewhere else by train and came back\n12 34", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


def test_variable_fields_are_one_template(spark):
    rows = {r["doc_id"]: r for r in t.drop_recurring_lines(logs(spark)).collect()}
    assert rows[0]["text"].startswith("Session 0") and rows[0]["dropped"] is None
    for i in range(1, 14):
        assert sorted(rows[i]["dropped"]) == [0, 3] and rows[i]["text"].startswith("own words") and rows[i]["text"].endswith("\n")
    assert rows[50]["dropped"] == [1]


def documents(spark, texts):
    return spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")


def test_long_lines_go_from_the_second_text_on(spark):
    sentence = "this long sentence stands word for word in a few of the texts"
    rows = {r["doc_id"]: r for r in t.drop_recurring_lines(documents(spark, [f"{sentence}\nown part {'abcdefghi'[i]}" for i in range(9)])).collect()}
    assert rows[0]["dropped"] is None and all(rows[i]["dropped"] == [0] for i in range(1, 9))


def test_second_family_of_a_leaf_is_found(spark):
    """Two templates of one length and opening, 24 and 12 texts; the field is a word."""
    names = ["n" + chr(97 + i // 5) + chr(97 + i % 5) for i in range(24)]
    first = [f"the job was started by {n} on the main host" for n in names]
    second = [f"the job was started again {n} nobody told us why" for n in names[:12]]
    rows = {r["doc_id"]: r for r in t.drop_recurring_lines(documents(spark, first + second)).collect()}
    assert sum(r["dropped"] is not None for r in rows.values()) == 23 + 11 and rows[0]["dropped"] is None and rows[24]["dropped"] is None


def test_sentences_with_a_common_opening_stay(spark):
    ends = ["run", "swim", "read", "sing", "dance", "cook", "write", "sleep", "jump", "fly", "ski", "paint"]
    rows = t.drop_recurring_lines(documents(spark, [f"She really wanted to {e}\nShe really wanted to {e} more" for e in ends])).collect()
    assert all(r["dropped"] is None for r in rows)


def test_equal_to_brute_force(corpus, spark):
    for frame in (corpus, logs(spark)):
        rows = frame.collect()
        gone = brute(rows)
        got = Counter((str(r["doc_id"]), r["text"]) for r in t.drop_recurring_lines(frame).collect())
        assert got == Counter((str(r["doc_id"]), cleaned(r["text"], gone[r["text"]])) for r in rows)
    assert any(brute(corpus.collect()).values())


def test_copies_of_a_text_are_one_text(spark):
    rows = [(i, "the same line in every copy of it", "en", "s", 1) for i in range(60)]
    out = t.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int"))
    assert {r["text"] for r in out.collect()} == {rows[0][1]}


def test_lines_of_odd_texts():
    row, number, leaf, _, long, codes, at = t.parse_lines(pa.array(["", "\n\na b\n", None, "7 8", "x 9\ny", "\x0b\n z"]))
    assert list(zip(row.tolist(), number.tolist(), strict=True)) == [(1, 2), (3, 0), (4, 0), (4, 1), (5, 1)]
    assert at.tolist() == [0, 2, 4, 6, 7, 8] and codes[2] == codes[3] == codes[5] == 0 and (codes[:2] > 0).all() and not long.any()
    assert leaf[1] == 0 and (leaf[[0, 2, 3, 4]] != 0).all()


def test_report_columns_clashes_and_empty(corpus, empty, clashing):
    out = t.drop_recurring_lines(clashing(corpus, "dropped", "key", "text_key", "leaf"))
    assert out.columns[-1] == "dropped_" and {r["dropped"] for r in out.collect()} == {"mine"}
    gone = brute(corpus.collect())
    texts = Counter((str(r["doc_id"]), len((r["text"] or "").split("\n")) if r["text"] is not None else 0, len(gone[r["text"]])) for r in corpus.collect())
    assert Counter((str(r["doc_id"]), r["n_lines"], r["n_dropped"]) for r in t.line_report(corpus).collect()) == texts
    assert t.line_report(empty).count() == 0 and t.drop_recurring_lines(empty).count() == 0


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    gone = brute(rows)
    got = {r["doc_id"]: r["n_dropped"] for r in queries.op9_line_templates(spark, sf).collect()}
    assert got == {r["doc_id"]: len(gone[r["text"]]) for r in rows}
