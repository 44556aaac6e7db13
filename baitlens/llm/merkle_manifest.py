"""Merkle manifest of a dataset by checkpoint and recompute.

Rows are leaves: sha256 over their fields. The leaves of a group ascend by key; every :data:`ARITY` consecutive nodes become
their parent, level by level, up to the group's root, and the groups' roots become the root of the dataset in the same way.
Only every :data:`STORED_EVERY`-th level is written: a stored row is an aligned subtree, its nodes of that level in order (81 at
most, whatever the size of the group), so that building a stored level is one aggregate and a map over subtrees.

Proofs go down the stored levels. For each subtree the missing interior levels are computed again from its stored nodes, the
siblings of every stored node are emitted, joined with the path of the subtree's own root (which the level above has
emitted), and the interior nodes are discarded.

Defined results: a null field counts as ``-``; an empty value is ``0:``. A null group is a group and comes first, as does a
null key; rows of equal key are ordered by their digests, so that equal rows are leaves of their own. An empty table has no
root, and its proofs are empty. Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import with_rank
from ..session import materialise, scratch_path
from .common import bounded_batches, by_shuffle, same
from .grid_order_join import batch_rows

#: Children of a node, and how many levels lie between two stored ones.
ARITY, STORED_EVERY = 3, 4
#: Subtrees handed to Python at once.
SUBTREES = 256
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree over the groups, lowest first; the root of all (None if empty)."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    every: int = STORED_EVERY


def leaf_digest(columns: dict[str, Column]) -> Column:
    """sha256, as lowercase hex, of the fields in their order: ``-`` or the length in bytes, a colon and the value."""
    fields = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")))
              for c in columns.values()]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], total: int, steps: int) -> list[list[str]]:
    """The nodes and up to ``steps`` levels above them; ``total`` counts the whole tree's nodes on the lowest level."""
    levels = [nodes]
    while total > 1 and len(levels) <= steps:
        nodes = [digest(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)]
        total = -(-total // ARITY)
        levels.append(nodes)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """For each level below the last, what stands before and after node ``i`` or its ancestor in the run of both."""
    found = []
    for nodes in levels[:-1]:
        first = i - i % ARITY
        found.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + ARITY])))
        i //= ARITY
    return found


def fold(node: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a node and its path lead to."""
    for before, after in path:
        node = sha256((before + node + after).encode()).hexdigest()
    return node


def proof_digest(path: Sequence[tuple[str, str]]) -> str:
    return digest([s for step in path for s in step])


def _left(span: int) -> Column:
    """How many nodes with ``span`` leaves below them a tree of ``n`` leaves has."""
    return F.expr(f"(n + {span - 1}) div {span}")


def _subtrees(nodes: DataFrame, every: int, carry: Sequence[str] = ()) -> DataFrame:
    """Aligned subtrees ``grp n blk items``: the nodes ``grp n pos node`` of a level, in order."""
    item = F.struct("pos", "node", *carry)
    return nodes.groupBy("grp", "n", F.expr(f"pos div {ARITY ** every}").alias("blk")).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _flat(items: pa.ListArray, names: Sequence[str]) -> list[pa.Array]:
    flat = items.flatten()
    fields = dict(zip([flat.type.field(i).name for i in range(flat.type.num_fields)], flat.flatten(), strict=True))
    return [fields[n] for n in names]


def _each(batch: pa.RecordBatch, span: int) -> Iterator[tuple[int, list[str], int]]:
    """Row, nodes and how many nodes the tree has on this level, for each subtree of a batch; a node has ``span`` leaves."""
    (nodes,) = _flat(batch.column("items"), ["node"])
    nodes = [x.hex() for x in nodes.to_pylist()]
    at, n = batch.column("items").value_lengths().to_pylist(), batch.column("n").to_pylist()
    start = 0
    for row, size in enumerate(at):
        yield row, nodes[start:start + size], -(-n[row] // span)
        start += size


def _parents(subtrees: DataFrame, span: int, every: int) -> DataFrame:
    """``grp n pos node`` of the next stored level; a finished tree's only node is its root."""
    fields = [f for f in subtrees.schema.fields if f.name in ("grp", "n")]
    schema = T.StructType([*fields, T.StructField("pos", T.LongType()), T.StructField("node", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [bytes.fromhex(climb(nodes, total, every)[-1][0]) for _, nodes, total in _each(batch, span)]
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("n"), batch.column("blk"), pa.array(tops, pa.binary())],
                                             names=["grp", "n", "pos", "node"])

    return subtrees.select("grp", "n", "blk", "items").mapInArrow(run, schema)


def _grow(nodes: DataFrame, carry: Sequence[str], every: int, store: Callable[[DataFrame, str], DataFrame],
          name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels of all trees over ``grp n pos node``, and the roots ``grp n node``."""
    levels, roots = [store(_subtrees(nodes, every, carry), f"{name}-0")], None
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while True:
        level, span = len(levels), ARITY ** (every * len(levels))
        above = materialise(_parents(levels[-1], span // ARITY ** every, every), f"merkle-{name}-parents")
        done = above.where(_left(span) == 1).select("grp", "n", "node")
        roots = done if roots is None else roots.union(done)
        if most <= span:
            return levels, roots
        levels.append(store(_subtrees(above.where(_left(span) > 1), every), f"{name}-{level}"))


def leaves_of(rows: DataFrame, columns: Sequence[str], group: str, key: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """``grp key pos n node`` and what is carried along: the leaves with their positions inside their group."""
    made = {c: F.col(f"`{c}`") for c in columns}
    leaves = materialise(rows.select(made.get(group, F.col(f"`{group}`")).alias("grp"), F.col(f"`{key}`").alias("key"),
                                     F.unhex(leaf_digest(made)).alias("node"), *[c.alias(n) for n, c in (carry or {}).items()]), "merkle-leaves")
    ranked = with_rank(leaves, ["key", "node", *(carry or {})], "pos", ["grp"], total="n")
    return ranked.withColumn("pos", F.col("pos") - 1)


def build(rows: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", key: str = "doc_id",
          carry: dict[str, Column] | None = None, folder: str | None = None,
          every: int = STORED_EVERY) -> Manifest:
    """The manifest of a table, written to a folder (by default in the shared scratch folder)."""
    spark = rows.sparkSession
    bounded_batches(spark)
    folder = (folder or scratch_path(spark, "merkle")).rstrip("/")

    def store(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("error").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    with batch_rows(spark, SUBTREES):
        groups, roots = _grow(leaves_of(rows, columns, group, key, carry), ["key", *(carry or {})], every, store, "groups")
        ordered = with_rank(roots.select(F.col("grp").alias("key"), F.col("n").alias("leaves"), "node"), ["key"], "pos", total="n")
        ordered = ordered.select(F.lit(0).alias("grp"), "n", (F.col("pos") - 1).alias("pos"), "node", "key", "leaves")
        top, last = _grow(ordered, ["key", "leaves"], every, store, "top")
        found = last.first()
    root = found["node"].hex() if found else None
    store(spark.createDataFrame([(root, len(groups), len(top), every)], "root string, groups int, top int, every int"), "root")
    return Manifest(groups, top, root, every)


def read_manifest(spark: SparkSession, folder: str) -> Manifest:
    """A manifest that :func:`build` has written."""
    folder = folder.rstrip("/")
    told = spark.read.parquet(f"{folder}/root").first()
    return Manifest(*[[spark.read.parquet(f"{folder}/{name}-{i}") for i in range(told[name])] for name in ("groups", "top")],
                    told["root"], told["every"])


def _above(batch: pa.RecordBatch, row: int) -> list[tuple[str, str]]:
    return [(s["before"], s["after"]) for s in batch.column("above")[row].as_py()]


def _paths(subtrees: DataFrame, span: int, every: int, names: Sequence[str] = ("pos",)) -> DataFrame:
    """``grp``, some fields and the whole ``path`` of each stored node of subtrees that know the path ``above`` their root."""
    fields = [subtrees.schema["grp"], *[f for f in subtrees.schema["items"].dataType.elementType.fields if f.name in names]]
    schema = T.StructType([*fields, T.StructField("path", subtrees.schema["above"].dataType)])
    arrow = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for row, nodes, total in _each(batch, span):
                above, levels = _above(batch, row), climb(nodes, total, every)
                found += [[{"before": a, "after": b} for a, b in (*siblings(levels, i), *above)] for i in range(len(nodes))]
                of += [row] * len(nodes)
            kept = _flat(batch.column("items"), [f.name for f in fields[1:]])
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(of, pa.int64())), *kept, pa.array(found, arrow)], names=schema.names)

    return subtrees.select("grp", "n", "items", "above").mapInArrow(run, schema)


def _descend(levels: list[DataFrame], every: int, ends: DataFrame) -> DataFrame:
    """The lowest stored subtrees, each with the path ``above`` its root; ``ends`` has ``grp n path`` of the trees' roots."""
    spark, below = levels[0].sparkSession, None
    for level in range(len(levels) - 1, -1, -1):
        span = ARITY ** (every * level)
        finished = _left(span * ARITY ** every) == 1
        known = ends.where(finished & (_left(span) > 1) if level else finished).select("grp", F.lit(0).cast("long").alias("pos"), "path")
        if below is not None:
            known = known.union(below)
        known = by_shuffle(known.select(F.col("grp").alias("g"), "pos", F.col("path").alias("above")))
        joined = levels[level].join(known, same(F.col("grp"), F.col("g")) & (F.col("blk") == F.col("pos"))).drop("g", "pos")
        if not level:
            return joined
        with batch_rows(spark, SUBTREES):
            below = materialise(_paths(joined, span, every).select("grp", "pos", "path"), "merkle-paths")
    raise ValueError("a manifest has at least one stored level")


def _lowest(manifest: Manifest) -> DataFrame:
    """The groups' lowest subtrees with the path from their root to the root of all."""
    spark = manifest.groups[0].sparkSession
    nothing = F.from_json(F.lit("[]"), PATH).alias("path")
    one = manifest.top[0].select("grp", "n").distinct().select("grp", "n", nothing)
    with batch_rows(spark, SUBTREES):
        ends = materialise(_paths(_descend(manifest.top, manifest.every, one), 1, manifest.every, ["key", "leaves"]), "merkle-ends")
    return _descend(manifest.groups, manifest.every, ends.select(F.col("key").alias("grp"), F.col("leaves").alias("n"), "path"))


def proofs(manifest: Manifest, carry: Sequence[str] = ()) -> DataFrame:
    """``grp pos node key path`` of every leaf: the siblings from the leaf up to the root of all, before and after each."""
    return _paths(_lowest(manifest), 1, manifest.every, ["pos", "node", "key", *carry])


def tampered_report(docs: DataFrame, every: int = STORED_EVERY) -> DataFrame:
    """Every document's leaf, roots and proof, and whether the text without line breaks (odd checksums: as it is) still verifies."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    made = T.StructType([T.StructField(c, T.BooleanType() if c == "verified" else T.StringType()) for c in names])
    fields = {c: F.col(f"`{c}`") for c in COLUMNS}
    struck = F.coalesce(F.crc32(fields["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = fields | {"text": F.replace(fields["text"], F.lit("\n"), F.lit(""))}
    claim = F.when(struck, F.unhex(leaf_digest(changed)))
    manifest = build(docs, carry={"claim": claim}, every=every)
    if manifest.root is None:
        return spark.createDataFrame([], T.StructType([T.StructField("doc_id", kind), *made.fields]))
    root, every, lowest = manifest.root, manifest.every, _lowest(manifest)
    fields_out = T.StructType([T.StructField("doc_id", kind), *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, claims = _flat(batch.column("items"), ["key", "claim"])
            claims, sizes, found = claims.to_pylist(), batch.column("n").to_pylist(), []
            for row, nodes, total in _each(batch, 1):
                above, levels = _above(batch, row), climb(nodes, total, every)
                # the steps that belong to the group's own tree lead to its root
                steps, left = 0, sizes[row]
                while left > 1:
                    steps, left = steps + 1, -(-left // ARITY)
                subroot = fold(levels[-1][0], above[: steps - len(levels) + 1])
                for i, leaf in enumerate(nodes):
                    path = siblings(levels, i) + above
                    claim = claims[len(found)]
                    folded = fold(leaf if claim is None else claim.hex(), path)
                    found.append((leaf, subroot, root, proof_digest(path), folded, folded == root))
            cells = [*zip(*found, strict=True)] if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, pa.bool_() if x == "verified" else pa.string()) for x, c in zip(names, cells, strict=True)]],
                                             names=fields_out.names)

    return lowest.select("n", "items", "above").mapInArrow(run, fields_out)


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE concat(strlen(CAST({name} AS VARCHAR)), ':', {name}) END"


def _record(text: str = "text") -> str:
    return "sha256(concat(" + ", ".join(_field(text if c == "text" else c) for c in COLUMNS) + "))"


ORACLE = f"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS crc
  FROM documents
), made AS (
  SELECT doc_id, source, {_record()} AS leaf,
    CASE WHEN crc & 1 = 1 THEN {_record("replace(text, chr(10), '')")} END AS claim FROM checked
), base AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claim NULLS FIRST) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS rid FROM made
), tree(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n, leaf FROM base
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3, n
), roots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM roots
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n
), own AS (
  SELECT b.rid, t.lvl, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < b.pos // (3 ** t.lvl)::BIGINT) AS l,
    string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > b.pos // (3 ** t.lvl)::BIGINT) AS r
  FROM base b JOIN tree t ON t.source IS NOT DISTINCT FROM b.source AND t.n > 1 AND t.pos // 3 = b.pos // (3 ** (t.lvl + 1))::BIGINT
  GROUP BY b.rid, t.lvl
), upper_steps AS (
  SELECT s.source, 1000 + t.lvl AS lvl, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (3 ** t.lvl)::BIGINT) AS l,
    string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (3 ** t.lvl)::BIGINT) AS r
  FROM roots s JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // (3 ** (t.lvl + 1))::BIGINT GROUP BY s.source, t.lvl
), steps AS (
  SELECT rid, lvl, coalesce(l, '') AS l, coalesce(r, '') AS r FROM own
  UNION ALL
  SELECT b.rid, u.lvl, coalesce(u.l, ''), coalesce(u.r, '') FROM base b JOIN upper_steps u ON u.source IS NOT DISTINCT FROM b.source
), paths AS (
  SELECT rid, list({{'l': l, 'r': r}} ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS told FROM steps GROUP BY rid
), folded AS (
  SELECT b.doc_id, b.leaf, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(p.told, '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': coalesce(b.claim, b.leaf), 'r': ''}}, coalesce(p.path, [])),
      lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM base b JOIN roots s ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN paths p ON p.rid = b.rid
)
SELECT *, folded_root = root AS verified FROM folded
"""
