"""A Merkle manifest of a dataset: a ternary tree over each source's documents, one over the sources, and a proof for
every document, expanded from multiproofs that are as small as they can be.

A leaf is the digest of a document's columns. The documents of a source, by doc_id, are the leaves of its tree: every
three consecutive nodes become the digest of their digests in hex, until one is left, the subroot; the subroots, by source,
grow the same way into the root. Trees are grown several levels a shuffle, grouped by tree and place, so a source with a
third of all documents is spread like any other.

Leaves are ordered as a whole and cut into parts of ``PART``, whatever source they are of. A part knows its own leaves.
Like an octopus it reaches for the rest at once: going up level by level, it notes which members of its runs it can
neither hold nor derive, in its sources' trees and in the one over the sources; those few coordinates of all parts are
joined with the nodes in one go; and the part then derives all inner nodes it needs, and expands the single proofs.

Cases: null columns are ``-`` in a leaf; a null source is a source of its own, before all others; a null doc_id comes
before the others; rows with equal doc_id are ordered by their leaves, and rows equal in all columns are leaves each; an
empty text is a text of no bytes; a lone leaf is its subroot and a lone subroot the root, with a proof of nothing; an
empty table gives no rows; other columns are no part of a leaf and are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 3
#: Levels that one shuffle grows: a task's group has 3^6 nodes at most.
LEVELS = 6
#: Leaves whose proofs are expanded together.
PART = 20_000
#: Sources that are broadcast, and coordinates, at most; more are joined by a shuffle.
BROADCAST_TREES, BROADCAST_COORDINATES = 100_000, 1_000_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the sources; those of sources begin with "s".
TOP = "t"
_NODES = "tree string, level int, place long, n long, digest binary"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(columns: dict[str, Column] | None = None) -> Column:
    """The digest, in hex, of a document's columns, some of which may be given as other expressions."""
    parts = []
    for name in COLUMNS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def ordered(rows: DataFrame, *by: Column) -> DataFrame:
    """Adds ``at``, each row's place in the order of the whole table, counted from 0. The rows are sorted in ranges, and
    only the ranges' sizes, one number a partition, come to the driver."""
    n = common.shuffle_partitions(rows.sparkSession)
    cut = rows.repartitionByRange(n, *by).sortWithinPartitions(*by)
    cut = common.stored(cut.withColumn("at", F.monotonically_increasing_id()), "ordered")
    here, own = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in cut.groupBy(here.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before.append((p, total))
        total += sizes[p]
    offsets = rows.sparkSession.createDataFrame(before, "range_id long, range_at long")
    cut = cut.withColumn("range_id", here.cast("long")).join(F.broadcast(offsets), "range_id")
    return cut.withColumn("at", F.col("range_at") + own).drop("range_id", "range_at")


def grown(base: DataFrame) -> DataFrame:
    """The inner nodes over ``base`` (tree, level, place, n and digest of the nodes of one level, n being how many the
    tree has there), with the same columns."""
    made, levels = None, LEVELS
    while True:
        below = base.where("n > 1")
        if not below.limit(1).count():
            return base.limit(0) if made is None else made
        runs = below.groupBy("tree", F.expr(f"place div {WIDTH**levels}").alias("block"))
        runs = runs.agg(F.first("n").alias("n"), F.first("level").alias("level"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        new = common.stored(runs.select("tree", "n", "level", "nodes").mapInArrow(lambda b: _folded(b, levels), _NODES), "nodes")
        made = new if made is None else made.unionByName(new)
        top = new.agg(F.max("level")).first()[0]
        base = new.where(F.col("level") == top)


def _folded(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            n, level = row["n"], row["level"]
            nodes = [(x["place"], x["digest"]) for x in row["nodes"]]
            for _ in range(levels):
                if n == 1:
                    break
                runs: dict[int, list[str]] = defaultdict(list)
                for place, d in nodes:
                    runs[place // WIDTH].append(d.hex())
                nodes = [(place, sha256("".join(ds).encode()).digest()) for place, ds in runs.items()]
                n, level = -(-n // WIDTH), level + 1
                out += [(row["tree"], level, place, n, d) for place, d in nodes]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "level", "place", "n", "digest"])


@dataclass(frozen=True)
class Manifest:
    """leaves: part, tree, place, n, rank (of the source), doc_id, leaf and other, the leaf of the document as it is to be
    verified; nodes: tree, level, place, n and digest of every inner node; trees: tree, source, n and rank."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    sources: int
    root: str | None


def manifest(docs: DataFrame, other: Column | None = None) -> Manifest:
    """Grow the trees. ``other`` is a leaf to verify later in place of the document's own."""
    tree = F.concat(F.lit("s"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    own = leaf()
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(own).alias("leaf"), F.unhex(own if other is None else other).alias("other"))
    rows = common.stored(rows, "leaves")
    placed = ordered(rows, F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("leaf"))
    trees = common.stored(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    trees = common.stored(ordered(trees, F.col("tree")).withColumnRenamed("at", "rank"), "ranked_trees")
    sources = trees.count()
    if sources <= BROADCAST_TREES:
        placed = placed.join(F.broadcast(trees), "tree")
    else:
        placed = common.salted(placed, trees, ["tree"], F.xxhash64("leaf"))
    leaves = placed.select(F.expr(f"at div {PART}").alias("part"), "tree", (F.col("at") - F.col("first")).alias("place"), "n", "rank", "doc_id", "leaf", "other")
    leaves = common.stored(leaves, "placed")
    base = leaves.select("tree", F.lit(0).alias("level"), "place", "n", F.col("leaf").alias("digest"))
    inner = grown(base)
    subroots = base.where("n = 1").unionByName(inner.where("n = 1")).join(trees.select("tree", "rank"), "tree")
    tops = common.stored(subroots.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("rank").alias("place"), F.lit(sources).cast("long").alias("n"), "digest"), "subroots")
    above = grown(tops)
    root = above.where("n = 1").first() or tops.where("n = 1").first()
    nodes = inner.unionByName(tops).unionByName(above)
    named = trees.select("tree", F.expr("substring(tree, 3)").alias("source"), "n", "rank").withColumn("source", F.when(F.col("tree") != "s", F.col("source")))
    return Manifest(leaves, nodes, named, sources, root["digest"].hex() if root else None)


def missing(known: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level, the places of the nodes that have to be fetched so that, of a tree of n leaves, the leaves at the
    ``known`` places can be proved: members of their runs that are neither known nor follow from what is known."""
    known, level = np.unique(known), 0
    while n > 1:
        runs = np.unique(known // WIDTH)
        members = (runs[:, None] * WIDTH + np.arange(WIDTH)).ravel()
        yield level, np.setdiff1d(members[members < n], known, assume_unique=True)
        known, n, level = runs, -(-n // WIDTH), level + 1


def coordinates(leaves: DataFrame, sources: int) -> DataFrame:
    """part, tree, level and place: the least union of nodes that each part lacks."""

    def wanted(table: pa.Table) -> pa.Table:
        frame = table.to_pandas()
        part, out = int(frame["part"].iloc[0]), []
        for tree, own in frame.groupby("tree", sort=False):
            out += [(tree, level, place) for level, places in missing(own["place"].to_numpy(), int(own["n"].iloc[0])) for place in places.tolist()]
        out += [(TOP, level, place) for level, places in missing(frame["rank"].to_numpy(), sources) for place in places.tolist()]
        trees, levels, places = zip(*out) if out else ([], [], [])
        columns = [pa.array([part] * len(out), pa.int64()), pa.array(trees, pa.string()), pa.array(levels, pa.int32()), pa.array(places, pa.int64())]
        return pa.Table.from_arrays(columns, ["part", "tree", "level", "place"])

    return leaves.select("part", "tree", "place", "n", "rank").groupBy("part").applyInArrow(wanted, "part long, tree string, level int, place long")


def _paths(known: dict[int, str], n: int, fetched: dict[int, dict[int, str]]) -> tuple[dict[int, list[tuple[str, str]]], str]:
    """From the digests at known places, and the fetched ones by level, to the steps (the siblings before and after, level
    by level) of each place, and the digest at the top. Steps above a run are one list for all its members."""
    levels, own = [], known
    level = 0
    while n > 1:
        have = own | fetched.get(level, {})
        levels.append((own, have))
        own = {run: digest("".join(have[m] for m in range(run * WIDTH, min(n, run * WIDTH + WIDTH)))) for run in {place // WIDTH for place in own}}
        n, level = -(-n // WIDTH), level + 1
    ((_, top),) = own.items()
    steps: dict[int, list[tuple[str, str]]] = {0: []}
    for own, have in reversed(levels):
        below = {}
        for place in own:
            run = place // WIDTH * WIDTH
            around = [have.get(m, "") for m in range(run, run + WIDTH)]
            below[place] = [("".join(around[: place - run]), "".join(around[place - run + 1 :])), *steps[place // WIDTH]]
        steps = below
    return steps, top


def proofs(made: Manifest, *, chosen: DataFrame | None = None, carried: bool = False) -> DataFrame:
    """One row per document, or per document whose doc_id is in ``chosen``: doc_id, leaf, subroot, root, proof_sha256 (of
    its siblings, from the leaf up), folded_root (from the leaf to verify, by the same siblings) and verified; with
    ``carried`` also proof, its steps, which ``folded`` takes."""
    leaves = made.leaves
    if chosen is not None:
        leaves = leaves.join(chosen.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    asked = common.stored(coordinates(leaves, made.sources), "coordinates")
    few = asked.limit(BROADCAST_COORDINATES + 1).count() <= BROADCAST_COORDINATES
    every = made.leaves.select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("digest")).unionByName(made.nodes.select("tree", "level", "place", "digest"))
    fetched = every.join(F.broadcast(asked) if few else asked, ["tree", "level", "place"])
    fetched = common.stored(fetched.select("part", "tree", "level", "place", "digest"), "fetched")
    root, sources = made.root, made.sources
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", proof array<struct<before: string, after: string>>" if carried else ""

    def expanded(mine: pa.Table, others: pa.Table) -> pa.Table:
        around: dict[str, dict[int, dict[int, str]]] = defaultdict(lambda: defaultdict(dict))
        for tree, level, place, d in zip(*(others.column(c).to_pylist() for c in ("tree", "level", "place", "digest"))):
            around[tree][level][place] = d.hex()
        by_tree: dict[str, list[tuple]] = defaultdict(list)
        for tree, *row in zip(*(mine.column(c).to_pylist() for c in ("tree", "place", "n", "rank", "doc_id", "leaf", "other"))):
            by_tree[tree].append(tuple(row))
        trees, subroots = [], {}
        for tree, rows in by_tree.items():
            known = {place: d.hex() for place, _, _, _, d, _ in rows}
            steps, top = _paths(known, rows[0][1], around[tree])
            trees.append((rows, steps))
            subroots[rows[0][2]] = top
        above, _ = _paths(subroots, sources, around[TOP])
        out = []
        for rows, steps in trees:
            rank = rows[0][2]
            for place, _, _, doc_id, own, other in rows:
                path = steps[place] + above[rank]
                d = other.hex()
                for before, after in path:
                    d = digest(before + d + after)
                row = (doc_id, own.hex(), subroots[rank], root, digest("".join(b + a for b, a in path)), d, d == root)
                out.append((*row, [{"before": b, "after": a} for b, a in path]) if carried else row)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()] + ([pa.list_(pa.struct({"before": pa.string(), "after": pa.string()}))] if carried else [])
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + (["proof"] if carried else [])
        columns = list(zip(*out)) if out else [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expanded, schema)


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf leads to by the steps of its proof; a column expression, for whoever keeps proofs."""
    return F.aggregate(proof, own, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256))


def tampered_text() -> Column:
    """The text without its line ends, where 2 divides the checksum of doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """Every document's proof, verified against a copy of the documents in which some have lost their line ends."""
    return proofs(manifest(docs, leaf({"text": tampered_text()})))
