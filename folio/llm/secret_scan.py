"""Secrets in text: fixed patterns, and a battery of randomness tests for what no pattern names.

All of it is Spark expressions. Long tokens get an encoding by the characters they use, and then

- chi-squared, runs and lag-one serial correlation tests against a uniform, independent source over that alphabet: a
  token that fails one of them (Bonferroni over the three, at ``alpha``) is no random string;
- a p-value against the null of written language, under which chi-squared is non-central, with a non-centrality that
  grows with the token's length: short tokens hardly ever reach a small one.

Benjamini-Hochberg over those p-values, among tokens of one encoding and octave of length, keeps the share of
written language among the reported tokens under ``fdr``. It works on counts per twentieth of a decade, p-values being
rounded up, so what comes to the driver is one threshold for each encoding and octave.

Cases: null text is empty and has no spans; repeated rows are scanned each; very long texts are scanned whole; an empty
table gives no rows; all columns of the input may be kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # whole runs, so the same as runs of any length that are long enough
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"  # the value after a name and = is a token of its own
KINDS = ["assign", "access", "hex", "random"]

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name: (pattern of the whole token, alphabet, non-centrality per character of written language in that alphabet:
#: size times the sum of squared letter shares, less one, rounded down).
ENCODINGS = {
    "hex": (r"[0-9a-f]+", _DIGITS + _LOWER[:6], 0.6),
    "HEX": (r"[0-9A-F]+", _DIGITS + _UPPER[:6], 0.6),
    "lower": (r"[a-z]+", _LOWER, 0.6),
    "upper": (r"[A-Z]+", _UPPER, 0.6),
    "base32": (r"[A-Z2-7]+", _UPPER + _DIGITS[2:8], 1.0),
    "base36": (r"[a-z0-9]+", _LOWER + _DIGITS, 1.2),
    "letters": (r"[A-Za-z]+", _LOWER + _UPPER, 2.0),
    "base62": (r"[A-Za-z0-9]+", _LOWER + _UPPER + _DIGITS, 2.5),
    "base64": (r"[A-Za-z0-9+/]+", _LOWER + _UPPER + _DIGITS + "+/", 2.5),
    "base64url": (r"[A-Za-z0-9_-]+", _LOWER + _UPPER + _DIGITS + "_-", 2.5),
    "base64any": (r"[A-Za-z0-9+/_-]+", _LOWER + _UPPER + _DIGITS + "+/_-", 2.5),  # both alphabets at once, so no token is left out
}
PER_DECADE = 20


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, word) of the leftmost matches; code points, end exclusive. Between the matches stand the
    parts that a split at the same pattern gives."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,word:string>>")
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("word"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["word"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["word"].alias("word")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(none)


def _normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, to about 1e-7."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _log10_normal_cdf(z: Column) -> Column:
    """Of the lower tail too, where the probability itself is too small to tell from zero: below -4 by the asymptotic
    series up to a positive term, which lies above the true value."""
    x2 = z * z
    far = -x2 / 2 - F.log(-z * 2.5066282746310002) + F.log(1 - 1 / x2 + 3 / (x2 * x2))
    return F.when(z < -4, far / 2.302585092994046).otherwise(F.log10(_normal_cdf(z)))


def _with(items: Column, **fields) -> Column:
    """Add fields to each struct of an array; each is a function of the struct."""
    return F.transform(items, lambda x: reduce(lambda s, kv: s.withField(kv[0], kv[1](x)), fields.items(), x))


def _tested(tokens: Column) -> Column:
    """Array of structs with encoding, octave, bin of the p-value against language and whether the token looks random."""
    pick = lambda k: lambda x: reduce(lambda c, kv: c.when(x["core"].rlike(f"^{kv[1][0]}$"), F.lit(kv[1][k] if k is not None else kv[0])), list(ENCODINGS.items())[1:], F.when(x["core"].rlike("^[0-9a-f]+$"), F.lit(ENCODINGS["hex"][k] if k is not None else "hex")))
    tokens = _with(tokens, core=lambda x: F.regexp_replace(x["word"], "=+$", ""))
    tokens = F.filter(tokens, lambda x: (F.length(x["core"]) >= 20) & x["core"].rlike("[A-Za-z]"))
    tokens = F.filter(_with(tokens, encoding=pick(None), alphabet=pick(1), delta=pick(2)), lambda x: x["encoding"].isNotNull())
    tokens = _with(
        tokens,
        n=lambda x: F.length(x["core"]).cast("double"),
        size=lambda x: F.length(x["alphabet"]).cast("double"),
        at=lambda x: F.transform(F.split(x["core"], ""), lambda c: F.instr(x["alphabet"], c).cast("double")),
        squares=lambda x: F.aggregate(F.transform(F.split(x["alphabet"], ""), lambda c: F.length(x["core"]) - F.length(F.replace(x["core"], c, F.lit("")))), F.lit(0.0), lambda a, k: a + k * k.cast("double")),
    )
    tokens = _with(
        tokens,
        chi=lambda x: x["squares"] * x["size"] / x["n"] - x["n"],
        mean=lambda x: F.aggregate(x["at"], F.lit(0.0), lambda a, v: a + v) / x["n"],
        above=lambda x: F.size(F.filter(x["at"], lambda v: v * 2 > x["size"] + 1)).cast("double"),
        runs=lambda x: 1.0 + F.size(F.filter(F.arrays_zip(F.slice(x["at"], 1, F.size(x["at"]) - 1).alias("a"), F.slice(x["at"], 2, F.size(x["at"])).alias("b")), lambda p: (p["a"] * 2 > x["size"] + 1) != (p["b"] * 2 > x["size"] + 1))).cast("double"),
    )
    tokens = _with(
        tokens,
        spread=lambda x: F.aggregate(x["at"], F.lit(0.0), lambda a, v: a + (v - x["mean"]) * (v - x["mean"])),
        cross=lambda x: F.aggregate(F.arrays_zip(F.slice(x["at"], 1, F.size(x["at"]) - 1).alias("a"), F.slice(x["at"], 2, F.size(x["at"])).alias("b")), F.lit(0.0), lambda s, p: s + (p["a"] - x["mean"]) * (p["b"] - x["mean"])),
        runs_mean=lambda x: 2 * x["above"] * (x["n"] - x["above"]) / x["n"] + 1,
    )
    df = lambda x: x["size"] - 1
    wilson = lambda x: (F.pow(F.greatest(x["chi"], F.lit(0.0)) / df(x), F.lit(1 / 3)) - (1 - 2 / (9 * df(x)))) / F.sqrt(2 / (9 * df(x)))
    two_sided = lambda z: 2 * _normal_cdf(-F.abs(z))
    runs_sd = lambda x: F.sqrt(F.greatest((x["runs_mean"] - 1) * (x["runs_mean"] - 2) / (x["n"] - 1), F.lit(1e-9)))
    pull = lambda x: x["n"] * x["delta"]
    tokens = _with(
        tokens,
        p_random=lambda x: 3 * F.least(1 - _normal_cdf(wilson(x)), two_sided((x["runs"] - x["runs_mean"]) / runs_sd(x)), two_sided((x["cross"] / F.greatest(x["spread"], F.lit(1e-9)) + 1 / x["n"]) * F.sqrt(x["n"]))),
        log_p_language=lambda x: _log10_normal_cdf((x["chi"] - df(x) - pull(x)) / F.sqrt(2 * (df(x) + 2 * pull(x)))),
    )
    return F.transform(
        tokens,
        lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.concat_ws(":", x["encoding"], F.floor(F.log2(x["n"])).cast("string")).alias("stratum"),
            F.floor(-x["log_p_language"] * PER_DECADE).cast("int").alias("bin"), x["p_random"].alias("p_random"),
        ),
    )


def thresholds(docs: DataFrame, fdr: float) -> dict[str, int]:
    """Per encoding and octave of length, the least bin that Benjamini-Hochberg rejects language from."""
    tokens = docs.select(F.explode(_tested(_spans(F.coalesce("text", F.lit("")), TOKEN))).alias("t")).select("t.stratum", "t.bin")
    counts = tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    counts = counts.withColumn("k", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    passed = counts.where(-F.col("bin") / PER_DECADE <= F.log10(fdr * F.col("k") / F.col("m")))
    return {r["stratum"]: r["bin"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, *, fdr: float = 0.05, alpha: float = 0.001, out: str = "secrets") -> DataFrame:
    """All columns of docs and ``out``: the spans (start, kind as its place in KINDS, end), in that order."""
    least = thresholds(docs, fdr)
    text = F.coalesce("text", F.lit(""))
    pattern_spans = F.concat(
        F.transform(F.filter(_spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["word"], ASSIGN, 2)) >= 8), lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("kind"), x["end"].alias("end"))),
        F.transform(F.filter(_spans(text, ACCESS), lambda x: F.length(x["word"]) >= 16), lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("kind"), x["end"].alias("end"))),
        F.transform(_spans(text, HEX), lambda x: F.struct(x["start"].alias("start"), F.lit(2).alias("kind"), x["end"].alias("end"))),
    )
    base = docs.withColumn(out, pattern_spans)
    if not least:
        return base.withColumn(out, F.array_sort(out))
    known = F.create_map(*[F.lit(v) for kv in sorted(least.items()) for v in kv])
    tokens = F.filter(_tested(_spans(text, TOKEN)), lambda x: (x["bin"] >= F.try_element_at(known, x["stratum"])) & (x["p_random"] >= alpha))
    fresh = F.filter(tokens, lambda x: ~F.exists(F.col(out), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    more = F.transform(fresh, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return base.withColumn(out, F.array_sort(F.concat(F.col(out), more)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts of the fixed kinds, the hash of their spans, and all spans."""
    found = scan(docs.select("doc_id", "text"), **options)
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every span replaced by the mark, and n_chars to match where they have it."""
    (spans,) = common.unused(docs, "secrets")
    found = scan(docs, out=spans, **options)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    tail = F.length("text") + 1

    def step(acc: Column, x: Column) -> Column:
        # A span inside the one before is gone already; one that overlaps it takes the rest with it.
        inside = x["start"] < acc["at"]
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], kept, F.lit(mark))).alias("out"))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), tail)))
    fixed = found.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        fixed = fixed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return fixed.select(*docs.columns)
