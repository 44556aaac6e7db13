"""Delimited files read in blocks equal a multi-line read of the whole file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from baitlens.sources import delimited as d
from baitlens.sources import readers as rd


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(frame):
    return sorted(map(str, map(tuple, frame.collect())))


def made(seed, breaks):
    """A file of random fields: quoted line breaks, separators and quotes, quotes inside plain fields, long records, bad lines."""
    draw = random.Random(seed)

    def field():
        kind = draw.randrange(8)
        plain = "".join(draw.choice("abc é") for _ in range(draw.randrange(1, 8)))
        if kind == 0:
            return ""
        if kind == 1:
            return plain + '"' + draw.choice("xy")
        if kind < 5:
            return plain
        inner = "".join(draw.choice(["a", "b", ",", breaks, '""', " ", "é"]) for _ in range(draw.choice([0, 3, 10, 400])))
        return f'"{inner}"'

    lines = ["id,text,note"]
    for i in range(60):
        lines.append(f"{i},{field()},{field()}" + (",extra" if draw.random() < 0.1 else ""))
        if draw.random() < 0.1:
            lines.append("")
        if draw.random() < 0.1:
            lines.append(f"short{i}")
    return breaks.join(lines) + breaks


def test_ends_of_lines():
    for line, plain, inside in [(b"a,b", False, True), (b'a,"b', True, False), (b'"a",b', False, False), (b'a"', False, False), (b'"a""', True, False),
                                (b'"', True, False), (b'""', False, True), (b'","', False, True), (b'x","y', True, True), (b'a"b,c', False, False)]:
        assert (d.ends_quoted(line, False, b","), d.ends_quoted(line, True, b",")) == (plain, inside), line


@pytest.mark.parametrize(("seed", "breaks"), [(1, "\n"), (2, "\r\n")])
def test_blocks_equal_the_whole_file(spark, tmp_path, small_blocks, seed, breaks):
    path = tmp_path / "a.csv"
    path.write_bytes(made(seed, breaks).encode())
    assert d._lines(spark, str(path)).rdd.getNumPartitions() > 8
    got = d.read_blocks(spark, str(path))
    # the whole-file reader turns the line breaks inside fields to the plain ones, blocks keep them
    plain = got.select(*[F.replace(c, F.lit("\r\n"), F.lit("\n")).alias(c) for c in got.columns])
    assert rows_of(plain) == rows_of(rd.read_csv(spark, str(path)))
    with open(path, newline="", encoding="utf-8") as file:
        want = [r for r in list(csv.reader(file))[1:] if 0 < len(r) <= 3]
    kept = {(r["id"], r["text"] or "", r["note"] or "") for r in got.collect()}
    assert kept == {(*r, "", "")[:3] for r in want}


def test_shuffled_states_give_the_same(spark, tmp_path, small_blocks, monkeypatch):
    path = tmp_path / "a.csv"
    path.write_bytes(made(3, "\n").encode())
    want = rows_of(rd.read_csv(spark, str(path)))
    monkeypatch.setattr(d, "BROADCAST_ROW_LIMIT", 0)
    assert rows_of(d.read_blocks(spark, str(path))) == want


def test_several_files_encodings_and_edges(spark, tmp_path, small_blocks):
    (tmp_path / "u.csv").write_bytes('\ufeffid,text\n1,"caf\u00e9\nau lait"\n'.encode())
    (tmp_path / "l.csv").write_bytes("id,text\n2,caf\u00e9\n".encode("latin-1"))
    (tmp_path / "open.csv").write_bytes(b'id,text\n3,"never\nclosed')
    (tmp_path / "head.csv").write_bytes(b"id,text\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    files = [str(tmp_path / f"{n}.csv") for n in ("u", "l", "open", "head", "empty")]
    got = {r["id"]: r["text"] for r in d.read_blocks(spark, files).collect()}
    assert {k: got[k] for k in "12"} == {"1": "caf\u00e9\nau lait", "2": "caf\u00e9"} and set(got) == {"1", "2", "3"}
    assert "never" in got["3"]
    assert d.read_blocks(spark, files[3]).count() == 0
    assert d.read_blocks(spark, files[0]).columns == ["id", "text"]


def test_states_of_blocks(spark):
    """Any mix of blocks that fix, turn or leave the state, against a walk in order."""
    draw = random.Random(5)
    kinds = [(False, True), (True, False), (False, False), (True, True)]
    rows, want = [], {}
    for name in "abcdefgh":
        state, chain = False, None
        for start in range(0, 200, 10):
            plain, inside = draw.choice(kinds)
            ends = not inside or draw.random() < 0.5
            rows.append((name, start, plain, inside, ends, name != "c" or start != 50))
            want[name, start] = (state, chain if state else None, name != "c")
            after = inside if state else plain
            if after and (not state or ends):
                chain = start
            state = after
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "path string, start long, plain boolean, inside boolean, ends boolean, valid boolean")
    got = {(r["path"], r["start"]): (r["quoted"], r["chain"] if r["quoted"] else None, r["utf8"]) for r in d.block_states(frame).collect()}
    assert got == want
