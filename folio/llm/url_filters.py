"""URL filters by association rules: FP-growth over the tokens of labelled urls, matched by an inverted index.

Transactions are all distinct tokens of a url and its label, without those too rare for any rule, and one for all tokens
that are in the same labelled urls. Rules whose consequent is the bad label are kept if they
have the support and the confidence asked for. Each is posted under its rarest token; a url looks up its own tokens in
the postings, and a rule fires if the url has all of its tokens. Listed host and path rules, the longest that fits,
come before. All of it runs in Spark's own operators.

Cases: a null url, or one without ``://``, has empty host and path, no tokens and the verdict allow; repeated rows are
judged each; without labels (or none of the bad kind) no rule is mined and the listed rules decide alone; an empty
table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BAD, GOOD = "label=bad", "label=good"
#: Rules need the support of so many labelled pages at least, however few pages there are.
LEAST_PAGES = 5
#: Up to so many mined rules are broadcast; more are joined by a shuffle. The same for tokens.
BROADCAST_RULES = 5_000
BROADCAST_TOKENS = 200_000


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values.
LISTED = (
    ListedRule("block", "com", "/en/"),
    ListedRule("allow", "example.com", "/en/7"),
    ListedRule("allow", "net", "/de/"),
    ListedRule("block", "example.net", "/de/8"),
    ListedRule("block", "org", "/es/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``, empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(common.lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct runs of letters and digits after the scheme, lower-cased."""
    runs = F.split(F.lower(F.coalesce(after_scheme(url), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(runs, lambda t: t != ""))


def listed(host_col: Column, path_col: Column, rules=LISTED) -> tuple[Column, Column]:
    """The text and verdict of the longest rule that fits; null if none does."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host_col == rule.host) | host_col.endswith("." + rule.host)) & path_col.startswith(rule.path)
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (text, verdict) if text is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def classes(seen: DataFrame, least: int) -> DataFrame:
    """Tokens (token, rep) of at least so many bad rows, with the least token that is in the same rows. A rule with any
    other token has too little support, and tokens of the same rows are interchangeable in rules."""
    each = seen.select("row", "bad", F.explode("own").alias("token"))
    # The rows of a token are told by their number and two sums of hashes.
    tokens_of = each.groupBy("token").agg(
        F.count_if("bad").alias("n_bad"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")
    )
    tokens_of = tokens_of.where(F.col("n_bad") >= least)
    rep = tokens_of.groupBy("n", "x", "y").agg(F.min("token").alias("rep"))
    return common.stored(tokens_of.join(rep, ["n", "x", "y"]).select("token", "rep"), "tokens")


def _broadcast(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def mine(pages: DataFrame, labels: DataFrame, *, support: float, confidence: float, lift: float, least: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, words, anchor, confidence) that tell bad urls, over the representatives of tokens, and those:
    (token, rep). page_id and doc_id name the same thing."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    seen = pages.join(marks, pages["page_id"] == marks["doc_id"]).select(F.monotonically_increasing_id().alias("row"), "bad", tokens(pages["url"]).alias("own"))
    seen = common.stored(seen, "labelled")
    n = seen.count()
    share = min(1.0, max(support, least / max(1, n)))
    reps = classes(seen, math.ceil(share * n))
    own = seen.select("row", F.explode("own").alias("token")).join(_broadcast(reps, BROADCAST_TOKENS), "token")
    own = own.groupBy("row").agg(F.collect_set(F.concat(F.lit("t:"), "rep")).alias("own"))
    items = seen.select("row", "bad").join(own, "row", "left").select(F.array_append(F.coalesce("own", F.array().cast("array<string>")), F.when(F.col("bad"), BAD).otherwise(GOOD)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & ~F.array_contains("antecedent", GOOD) & (F.col("lift") >= lift))
    rules = rules.select(F.transform("antecedent", lambda t: F.substring(t, 3, 1 << 20)).alias("words"), "confidence")
    rules = common.stored(rules.select(F.xxhash64(F.array_join(F.array_sort("words"), " ")).alias("rule_id"), F.array_sort("words").alias("words"), "confidence"), "rules")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.substring(F.element_at("items", 1), 3, 1 << 20).alias("word"), "freq")
    each = rules.select("rule_id", F.explode("words").alias("word")).join(single, "word")
    anchor = each.groupBy("rule_id").agg(F.min(F.struct("freq", "word"))["word"].alias("anchor"))
    return common.stored(rules.join(anchor, "rule_id"), "anchored"), reps


def fired(urls: DataFrame, rules: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct urls (url) with the surest of the mined rules that they meet: url, rule_words and rule_confidence."""
    posted = _broadcast(rules, BROADCAST_RULES)
    exploded = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(_broadcast(reps, BROADCAST_TOKENS), "token")
    held = exploded.groupBy("url").agg(F.collect_list(F.struct("rep", "token")).alias("held"))
    held = held.withColumn("own", F.array_distinct(F.transform("held", lambda h: h["rep"])))
    met = held.select("url", "held", "own", F.explode("own").alias("anchor")).join(posted, "anchor").where(F.size(F.array_except("words", "own")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "words", "held")).alias("best"))
    # Each representative is named by the token of its rows that the url itself has.
    named = F.transform("best.words", lambda w: F.array_min(F.transform(F.filter("best.held", lambda h: h["rep"] == w), lambda h: h["token"])))
    return best.select("url", F.array_join(F.array_sort(named), " ").alias("rule_words"), F.col("best.confidence").alias("rule_confidence"))


def url_filter(pages: DataFrame, labels: DataFrame, *, support: float = 0.0005, confidence: float = 0.6, lift: float = 1.5, rules=LISTED) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the mined rule with its confidence where one fired."""
    rows = pages.select("page_id", "url")
    mined, reps = mine(rows, labels.select("doc_id", "quality", "toxic"), support=support, confidence=confidence, lift=lift)
    hits = fired(rows.where("url is not null").select("url").distinct(), mined, reps)
    out = rows.join(hits, "url", "left").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    text, verdict = listed(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("rule_words").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "rule_words", "rule_confidence")
