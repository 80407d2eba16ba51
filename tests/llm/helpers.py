"""Small documents that try every defined case, and plain re-statements to hold results against."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "in", "é", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    """Prose, exact and near copies, shared passages, repeats, nulls, blanks and one very long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 90))
    out: list[str | None] = [None, "", "  \n\t ", "a", "1 2 3", "é", "ab cd ef", "x" * 900, "y z\n" * 400]
    for i in range(n):
        w = words(rng, rng.randint(5, 200))
        if i % 5 == 0:
            w[3:3] = passage.split()
        if i % 7 == 0:
            w = w + w[:40]
        t = " ".join(w)
        out += [t, t] if i % 6 == 0 else [t]
        if i % 6 == 1:
            k = rng.randrange(len(w))
            out.append(" ".join(w[:k] + ["changed"] + w[k + 1 :]))
    out.append(" ".join(words(rng, 30000)))
    return out


def documents(spark, rows=None, extra=False):
    rows = texts() if rows is None else rows
    langs = ["en", "fr", None]
    data = [(i, t, langs[i % 3], "s", len(t or "")) for i, t in enumerate(rows)]
    data += [data[12], (None, "no id here at all", "en", None, None)] if len(data) > 12 else []
    df = spark.createDataFrame(data, DOCS)
    if extra:  # names that an operator might use itself
        from pyspark.sql import functions as F

        for name in ("fp", "score", "kept", "shard", "rank", "label", "length", "words", "start", "h", "n", "secrets", "utf8", "_score", "n_words"):
            df = df.withColumn(name, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
