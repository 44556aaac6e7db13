import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baitlens.llm import byte_bpe as b
from baitlens.llm import queries

PATH, PATTERN = public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\r\n", "\t", "'s", "é", "日本", "12", "!?", "　", "\x85", "-" * 9, "aa"])).map("".join) | st.text())
def test_ids_equal_the_library(library, text):
    model = b.bpe(PATH, PATTERN)
    text = text.encode("utf-8", "replace").decode()
    ids = model.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert model.decode_bytes(ids) == text.encode()


def test_byte_table_is_a_bijection():
    assert len(set(b.byte_characters())) == 256 and b.byte_characters()[ord("a")] == "a"


def test_offsets_cover_split_characters():
    model = b.bpe(PATH, PATTERN)
    text = "a 😀𒀀 é"
    ids = model.encode(text)
    starts, ends = model.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    assert all(s < e for s, e in zip(starts, ends, strict=True)) and starts == sorted(starts)
    assert any(s2 < e1 for e1, s2 in zip(ends, starts[1:], strict=False))  # one character over two ids
    assert model.offsets("", []) == ([], [])


def test_remembering_is_bounded(monkeypatch, library):
    monkeypatch.setattr(b, "REMEMBERED", 5)
    monkeypatch.setattr(b, "GROUP", 20)
    model = b.ByteBpe(PATH, PATTERN)
    texts = [f"word{i} other{i} {'z' * 90}{i}" for i in range(30)]
    assert [x.tolist() for x in model.encode_many(texts)] == [library.encode_ordinary(x) for x in texts]


def test_documents_round_trip(corpus, empty, library, clashing):
    out = b.encode_documents(clashing(corpus, "ids"), PATH, PATTERN, offsets=True)
    assert out.columns[-2:] == ["ids_", "token_offsets"]
    back = out.withColumn("back", b.decoded(F.col("ids_"), PATH, PATTERN).cast("string"))
    rows = back.collect()
    assert len(rows) == corpus.count()
    for r in rows:
        assert r["back"] == (r["text"] or "") and r["ids_"] == library.encode_ordinary(r["text"] or "")
        assert len(r["token_offsets"]["starts"]) == len(r["ids_"])
    assert b.encode_documents(empty, PATH, PATTERN).count() == 0


def test_digests(corpus, library):
    want = sorted((str(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((r["text"] or "").encode()).hexdigest())
                  for r in corpus.collect() for ids in [library.encode_ordinary(r["text"] or "")])
    got = sorted((str(r["doc_id"]), *list(r)[1:]) for r in b.token_digests(corpus, PATH, PATTERN).collect())
    assert got == want


def test_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
