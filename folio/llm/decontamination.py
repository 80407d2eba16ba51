"""Benchmark decontamination by SimHash windows, in Spark's own operators.

Windows are as long as a benchmark item, in words, and lie where a shingle of the document and one of the item are the
same, so that both line up; a window without any common shingle has similarity zero, so none is missed. Equal windows
are taken once. A window's SimHash, weighted by how often it has each shingle, is compared with the item's, and those
within the radius are verified by the exact weighted Jaccard similarity of their shingles.

At similarity 0.8 two 64-bit fingerprints differ in 9.7 bits on average, with a deviation of 2.9; the radius is almost
five deviations beyond that. Where a few repeated shingles carry most of the weight that does not hold, so windows with
fewer than ``FEW_SHINGLES`` different ones are verified whatever their distance. Hamming blocks that guarantee such a
radius have two or three bits each, and unrelated fingerprints share one of them as a rule: a multi-index over them
finds nothing that the shingles have not, so there is none.

Words are runs of letters and digits in lower case; shingles have five, or all words of a shorter item. Cases: null,
empty and wordless texts and items match nothing; repeated rows and repeated doc_ids count as one document; a document
without doc_id is reported with null; very long texts are searched whole; empty tables give no rows; other columns are
not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
#: Up to so many shingles of the benchmark are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 200_000
#: Windows with fewer different shingles are not judged by their fingerprints.
FEW_SHINGLES = 10

_SHINGLES = "transform(sequence(0, greatest(size({w}) - {k}, 0)), i -> array_join(slice({w}, i + 1, {k}), ' '))"
_SIMHASH = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(2 * size(filter(hashes, h -> (shiftright(h, b) & 1L) = 1L)) > size(hashes), shiftleft(1L, b), 0L))"


def words(col: str = "text"):
    return F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """rows with words and k: adds shingles and the fingerprint fp."""
    rows = rows.withColumn("shingles", F.expr(_SHINGLES.format(w="words", k="k")))
    return rows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s))).withColumn("fp", F.expr(_SIMHASH)).drop("hashes")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Pairs of documents and items, with the best window: doc_id, item_id, similarity, word_start and n_words."""
    items = benchmark.select("item_id", words().alias("words")).where(F.size("words") > 0).withColumn("k", F.least(F.lit(shingle), F.size("words")))
    items = common.stored(_fingerprinted(items), "items")
    seeds = items.select("item_id", "k", F.size("words").alias("size"), "words", F.posexplode(F.expr("sequence(0, size(words) - k)")).alias("pos", "_p"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # from 1 to the shingle's length
    few = items.select(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0

    texts = docs.select("doc_id", words().alias("words"))
    found = None
    for k in sizes:
        # Hash the words in place: this runs inside generated code, without building any shingle.
        at = lambda c, p: F.xxhash64(*[F.get(F.col(c), F.col(p) + j) for j in range(k)])  # noqa: B023, E731
        index = seeds.where(F.col("k") == k).select(at("words", "pos").alias("h"), "item_id", "size", "pos").distinct()
        spots = texts.where(F.size("words") >= k).select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("i"))
        spots = spots.withColumn("h", at("words", "i"))
        near = spots.join(F.broadcast(index), "h") if few <= BROADCAST_SHINGLES else common.salted(spots, index, ["h"], F.xxhash64("doc_id", "i"))
        start = F.greatest(F.lit(0), F.least(F.col("i") - F.col("pos"), F.size("words") - F.col("size")))
        near = near.select("doc_id", "item_id", start.alias("word_start"), F.slice("words", start + 1, F.col("size")).alias("window"), F.lit(k).alias("k"))
        found = near if found is None else found.unionByName(near)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, word_start int, n_words int")
    # A shingle more or less gives the same window again and again: one row each.
    places = common.stored(found.groupBy("doc_id", "item_id", "word_start", F.array_join("window", " ").alias("window")).agg(F.min("k").alias("k")), "windows")

    windows = places.groupBy("window", "item_id").agg(F.min("k").alias("k")).withColumn("words", F.split("window", " "))
    windows = _fingerprinted(windows.withColumn("k", F.least("k", F.size("words")))).select("window", "item_id", "shingles", "fp")
    theirs = items.select("item_id", F.col("shingles").alias("theirs"), F.col("fp").alias("their_fp"))
    near = windows.join(F.broadcast(theirs) if few <= BROADCAST_SHINGLES else theirs, "item_id").withColumnsRenamed({"shingles": "a", "theirs": "b"})
    unsure = F.least(F.size(F.array_distinct("a")), F.size(F.array_distinct("b"))) < FEW_SHINGLES
    near = near.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("their_fp"))) <= radius) | unsure)
    shared = F.expr("aggregate(array_intersect(a, b), 0L, (acc, s) -> acc + least(size(filter(a, x -> x = s)), size(filter(b, x -> x = s))))")
    sure = near.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("a") + F.size("b") - F.col("shared")))
    sure = sure.where(F.col("similarity") >= similarity).select("window", "item_id", "similarity")
    # A passage may be in a third of all documents: its places are dealt out.
    best = common.salted(places, sure, ["window", "item_id"], F.xxhash64("doc_id")).groupBy("doc_id", "item_id")
    best = best.agg(F.max(F.struct("similarity", (-F.col("word_start")).alias("before"), F.size(F.split("window", " ")).alias("n_words"))).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).alias("word_start"), "best.n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item. Rows without doc_id cannot be told apart and stay."""
    bad = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
