"""URL filter: host/path rules first, then a ratio of two character language models.

Two variable-order Markov models (contexts of 0 to 4 characters, Witten-Bell
interpolation) are counted over all URLs that a rule accepts or rejects.  A URL no rule
fits is judged by the length-normalised difference of its log-likelihoods against a
threshold calibrated on a fifth of the ruled URLs held out from counting.

Only DataFrame functions are used.  One aggregate over the corpus counts 5-grams; all
lower orders, probabilities and log-ratios are made from the table of distinct 5-grams.

The models read the whole URL with its host in lower case.  Host and path are for the rules and the output.

Defined cases: a null URL or one without `://` has an empty host and path; the latter is scored
as it is and a null as an empty string; repeated rows are judged and counted each; without ruled URLs both
models are uniform and every score is 0, which allows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

ORDER = 5
PAD, END = "\u0002", "\u0003"
#: Probability of a character below all counts.
UNIFORM = 1.0 / 256

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """`host/path` that fits the host and its subdomains where the path starts alike."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def text_of(url: Column) -> Column:
    """What the models read: the whole URL with its host in lower case."""
    whole = F.concat(F.regexp_extract(url, r"(?s)^(.*?://)", 1), host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)", 1))
    return F.coalesce(F.when(F.contains(url, F.lit("://")), whole).otherwise(url), F.lit(""))


def apply_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds `rule` (the longest that fits) and `ruled` (its verdict) to `host`, `path`."""
    best = sorted(rules, key=lambda r: (-len(r.pattern), r.pattern))
    fits = [(r, (F.lit("." + r.host).eqNullSafe(F.right(F.concat(F.lit("."), "host"), F.lit(len(r.host) + 1)))) & F.col("path").startswith(r.path)) for r in best]

    def pick(value) -> Column:
        out = F.lit(None).cast("string")
        for rule, fit in reversed(fits):
            out = F.when(fit, F.lit(value(rule))).otherwise(out)
        return out

    return urls.withColumns({"rule": pick(lambda r: r.pattern), "ruled": pick(lambda r: r.verdict)})


def grams(text: Column) -> Column:
    """All windows of ORDER characters that end in a character of the text or its end mark."""
    padded = F.concat(F.lit(PAD * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def log_ratios(counted: DataFrame) -> DataFrame:
    """(gram, log P(last | rest, accepted) - log P(last | rest, rejected)) for distinct grams.

    `counted` has gram, a and r: how often it is in accepted and rejected URLs.
    """
    probability = None
    for k in range(1, ORDER + 1):
        level = counted.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        level = level.withColumn("context", F.left("g", F.length("g") - 1))
        context = level.groupBy("context").agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        level = level.join(context, "context")
        if probability is None:
            level = level.withColumns({"la": F.lit(UNIFORM), "lr": F.lit(UNIFORM)})
        else:
            level = level.withColumn("tail", F.right("g", F.length("g") - 1)).join(
                probability.select(F.col("g").alias("tail"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "tail"
            )

        def smoothed(n: str, t: str, c: str, lower: str) -> Column:
            total = F.col(n) + F.col(t)
            return F.when(total == 0, F.col(lower)).otherwise((F.col(c) + F.col(t) * F.col(lower)) / F.when(total == 0, F.lit(1)).otherwise(total))

        probability = level.select("g", smoothed("na", "ta", "a", "la").alias("pa"), smoothed("nr", "tr", "r", "lr").alias("pr"))
    return probability.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def _name() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b")]


def filter_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", holdout: int = 5) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row; score is null where a rule decides."""
    scratch = Scratch(pages.sparkSession, "urls")
    read = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), text_of(F.col(url)).alias("text"))
    judged = apply_rules(read, rules)
    # One row for each distinct text with its number of rows: a hot URL is exploded once.
    texts = scratch.keep(
        judged.groupBy("text", "ruled").agg(F.count("*").alias("rows")).withColumn("held", F.pmod(F.xxhash64("text"), F.lit(holdout)) == 0), "texts"
    )
    every = texts.select("text", "ruled", "rows", "held", F.explode(grams(F.col("text"))).alias("gram"))
    seen = F.when(F.col("held"), 0).otherwise(F.col("rows"))
    counted = scratch.keep(
        every.groupBy("gram").agg(
            F.sum(F.when(F.col("ruled") == "allow", seen).otherwise(0)).alias("a"),
            F.sum(F.when(F.col("ruled") == "block", seen).otherwise(0)).alias("r"),
        ),
        "grams",
    )
    ratios = scratch.keep(log_ratios(counted), "ratios")
    # The grams of a text and their ratios meet by the gram; a hot gram's rows are split by the join.
    needed = texts.filter(F.col("held") | F.col("ruled").isNull()).select(*_name(), "ruled", "rows", F.explode(grams(F.col("text"))).alias("gram"))
    scores = scratch.keep(
        needed.join(ratios.hint("merge"), "gram").groupBy("a", "b", "ruled").agg(F.first("rows").alias("rows"), (F.sum("ratio") / F.count("*")).alias("score")), "scores"
    )
    bins = scores.filter(F.col("ruled").isNotNull()).groupBy(
        F.greatest(F.lit(-2000), F.least(F.lit(2000), F.floor(F.col("score") * 100))).alias("bin"), "ruled"
    ).agg(F.sum("rows").alias("n")).collect()  # at most 4 001 bins of two verdicts
    at = threshold([(r["bin"], r["ruled"] == "allow", r["n"]) for r in bins]) / 100
    unruled = scores.filter(F.col("ruled").isNull()).select("a", "b", "score")
    return judged.withColumns(dict(zip("ab", _name()))).join(unruled.hint("merge"), ["a", "b"], "left").select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= at, "allow").otherwise("block")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("score")).alias("score"),
    )


def threshold(bins: list[tuple[int, bool, int]]) -> int:
    """The lower edge from which allowing gives the best balanced accuracy; ties: nearest 0; one class alone: 0."""
    allowed = reduce(lambda s, b: s + b[2] * b[1], bins, 0)
    blocked = reduce(lambda s, b: s + b[2] * (not b[1]), bins, 0)
    if not allowed or not blocked:
        return 0
    best, missed, rejected = [], 0, 0
    by_bin: dict[int, list[int]] = {}
    for edge, good, n in bins:
        by_bin.setdefault(int(edge), [0, 0])[good] += n
    for edge in sorted(by_bin):
        best.append(((allowed - missed) / allowed + rejected / blocked, -abs(edge), edge))
        rejected += by_bin[edge][0]
        missed += by_bin[edge][1]
    best.append(((allowed - missed) / allowed + rejected / blocked, -abs(max(by_bin) + 1), max(by_bin) + 1))
    return max(best)[2]
