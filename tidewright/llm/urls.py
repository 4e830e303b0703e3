"""URL filters (operator 6): rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path. It fits its host and all subdomains of it if the path of the
URL starts with the rule's; of several the longest wins, of equally long ones the first by
alphabet. What no rule decides goes to boosted trees over the form of the URL: lengths,
depth, digits, entropy, hyphens, parameters, and statistics of its suffixes (how often labelled URLs
under the same last label or last two labels were blocked), never the words of the URL itself. They
are fitted on at most ``SAMPLE`` labelled URLs, those with the smallest hash; the suffix
statistics count all labelled ones.

A URL that is missing or has no ``://`` has an empty host and path, which fit no rule.
Without labels of both kinds the trees are left out and undecided URLs are allowed. Repeated
rows repeat in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import materialize

#: Labelled URLs the trees are fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Labelled URLs that count for the overall rate in the statistics of a suffix.
PRIOR = 10
FEATURES = ("n_chars", "n_host", "n_path", "n_labels", "depth", "digits", "entropy", "hyphens", "n_parameters",
            "n_query", "has_fragment", "rate_last", "rate_two")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return (F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules (``host/path`` to verdict) that fits, or null. A list of settings, so a chain of tests."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = rule.partition("/")
        under = (host == name) | F.endswith(host, F.lit(f".{name}"))
        found = F.when(under & F.startswith(path, F.lit(slash + rest)), rule).otherwise(found)
    return found


def lexical(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, the suffixes ``last`` and ``two``, and all features but their statistics."""
    host, path = host_and_path(url)
    step = df.select(*keep, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), host.alias("h"), path.alias("p"))
    labels, n = F.split("h", r"\."), F.length("u")
    query = F.regexp_extract("u", r"\?([^#]*)", 1)
    step = step.withColumn("shares", F.transform(F.array_distinct(F.split("u", "")), lambda c: F.try_divide(
        F.length("u") - F.length(F.replace(F.col("u"), c, F.lit(""))), F.length("u"))))
    entropy = F.aggregate(F.filter("shares", lambda s: s > 0), F.lit(0.0), lambda a, s: a - s * F.log2(s))
    double = lambda c: c.cast("double")
    return step.select(
        *keep, F.substring_index("h", ".", -1).alias("last"), F.substring_index("h", ".", -2).alias("two"),
        double(n).alias("n_chars"), double(F.length("h")).alias("n_host"), double(F.length("p")).alias("n_path"),
        double(F.size(labels)).alias("n_labels"), double(F.regexp_count("p", F.lit("/[^/]"))).alias("depth"),
        F.when(n > 0, F.regexp_count("u", F.lit("[0-9]")) / n).otherwise(0.0).alias("digits"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"), double(F.regexp_count("h", F.lit("-"))).alias("hyphens"),
        double(F.regexp_count(query, F.lit("[^&=]+="))).alias("n_parameters"), double(F.length(query)).alias("n_query"),
        double(F.contains("u", F.lit("#")).cast("int")).alias("has_fragment"))


def suffix_statistics(labelled: DataFrame, rate: float) -> DataFrame:
    """(suffix, rate): how often labelled URLs under a suffix were blocked, drawn to the overall rate if they are few."""
    both = labelled.select("blocked", F.explode(F.array_distinct(F.array(
        F.concat(F.lit("1 "), "last"), F.concat(F.lit("2 "), "two")))).alias("suffix"))
    return both.groupBy("suffix").agg(((F.sum("blocked") + PRIOR * rate) / (F.count(F.lit(1)) + PRIOR)).alias("rate"))


def with_statistics(features: DataFrame, statistics: DataFrame, rate: float) -> DataFrame:
    out = features
    for mark, suffix in (("1 ", "last"), ("2 ", "two")):
        own = statistics.where(F.startswith("suffix", F.lit(mark))).select(
            F.expr("substring(suffix, 3)").alias(f"of_{suffix}"), F.col("rate").alias(f"rate_{suffix}"))
        out = out.join(own, F.col(suffix) == F.col(f"of_{suffix}"), "left").drop(f"of_{suffix}") \
            .fillna(rate, [f"rate_{suffix}"])
    return out


class UrlModel:
    """Suffix statistics and trees; ``blocked(df)`` adds the probability that a URL is to be blocked."""

    def __init__(self, statistics: DataFrame | None, rate: float, trees: PipelineModel | None):
        self.statistics, self.rate, self.trees = statistics, rate, trees

    def blocked(self, df: DataFrame, url: str, keep: tuple[str, ...]) -> DataFrame:
        if self.trees is None:
            return df.select(*keep, F.lit(0.0).alias("p_block"))
        ready = with_statistics(lexical(df, url, keep), self.statistics, self.rate)
        return self.trees.transform(ready).select(*keep, vector_to_array("probability")[1].alias("p_block"))


def fit(labelled: DataFrame, url: str = "url") -> UrlModel:
    """Fit on ``labelled`` rows (url, blocked 0/1); rows without a label are passed over."""
    known = lexical(labelled.where("blocked IS NOT NULL"), url, (url, "blocked"))
    known = materialize(known.withColumn("blocked", F.col("blocked").cast("double")), "labelled-urls")
    share = known.agg(F.avg("blocked").alias("rate")).collect()[0].rate
    if share is None or share in (0.0, 1.0):
        return UrlModel(None, share or 0.0, None)
    statistics = materialize(suffix_statistics(known, share), "suffixes")
    sample = known.orderBy(F.xxhash64(url), url).limit(SAMPLE)
    ready = materialize(with_statistics(sample, statistics, share).select("blocked", *FEATURES), "url-sample")
    if ready.select("blocked").distinct().count() < 2:
        return UrlModel(None, share, None)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(assembler.transform(ready))
    return UrlModel(statistics, share, PipelineModel([assembler, trees]))


def judge(pages: DataFrame, rules: dict[str, str], model: UrlModel) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``p_block`` of every row with ``page_id`` and ``url``."""
    host, path = host_and_path()
    step = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    step = step.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    scored = model.blocked(step, "url", ("page_id", "host", "path", "rule"))
    of_rule = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules.items()], F.lit(None))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        of_rule, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
