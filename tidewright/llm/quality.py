"""Quality rules with thresholds that follow the corpus (operator 3), in DataFrame functions only.

Every text is measured once. For four measures a quantile sketch is kept per language and
source: counts of values that agree in their five leading binary digits, so a quantile read
from it is at most 1/16 too low. Such sketches merge by adding counts; a language's sketch is
the sum of its sources', the corpus' the sum of all. Fences replace fixed cutoffs, and a join of measures and
fences filters: a fence lies ``SPREAD`` times as far from the median as an outer quantile does, plus one bucket, which
is what the sketch does not resolve. A source with fewer than
``MIN_DOCUMENTS`` documents takes the fences of its language, a language with fewer those of
the corpus.

Letters per word have fences on both sides. Symbols, repeated lines and repeated words have an upper one, and as most texts have none
of them, ``SPARE`` occurrences do not count against a text. Their outer quantile says which share of a source may be junk
without moving the fence: a quarter for symbols, of which junk consists, else a twentieth.

Missing texts count as empty; they fail the base rules and are left out of the sketches, as
all texts without a word are. Missing languages and sources form a group of their own. Every
input row gives one row, also if its id occurs again; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_DOCUMENTS = 50
#: Distance of a fence from the median in units of median to outer quantile; that quantile, in hundredths, per measure.
SPREAD = 4
LEVELS = {"symbols": 75, "letters": 95, "lines": 95, "repeats": 95}
MEASURES = tuple(LEVELS)
#: Occurrences a text without any would have by chance at most, at a rate at which 5 % of such texts have none.
SPARE = 3


def _words(text: str) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the five base counts of every text; ``n_lines`` counts the lines with a word."""
    t, n = F.col("t"), F.size("w")
    step = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    step = step.select(
        *keep, _words("t").alias("w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace(t, BLANKS, "")).alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    step = step.select(
        *keep, n.cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    # One hash per window of eight words, by position.
    step = step.withColumn("g", F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW),
                    lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))))
    # Only texts in which a window comes back are sorted: equal windows then stand side by side.
    step = step.select(*keep, *_COUNTS, F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    again = F.transform(F.filter("s", lambda e, i: F.coalesce(
        (e["h"] == F.get("s", i - 1)["h"]) | (e["h"] == F.get("s", i + 1)["h"]),
        e["h"] == F.get("s", i - 1)["h"], e["h"] == F.get("s", i + 1)["h"], F.lit(False))), lambda e: e["i"])
    step = step.select(*keep, *_COUNTS, F.array_sort(again).alias("p"))
    reach = F.aggregate(
        "p", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["sum"] + p + WINDOW - F.greatest(p, a["end"])).alias("sum"),
                              (p + WINDOW).alias("end")))["sum"]
    return step.select(*keep, *_COUNTS, F.coalesce(reach, F.lit(0)).cast("long").alias("n_repeat_words"))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")


def _ratios(spare: int = 0) -> dict[str, Column]:
    counted = lambda of: F.greatest(F.col(of) - (spare if of != "word_chars" else 0), F.lit(0))
    part = lambda of, by, scale: F.when(F.col("n_words") > 0, F.floor(counted(of) * scale / F.col(by)))
    return {"symbols": part("n_symbols", "n_words", 1000), "letters": part("word_chars", "n_words", 100),
            "lines": part("n_dup_lines", "n_lines", 1000), "repeats": part("n_repeat_words", "n_words", 1000)}


def sketch(measures: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (``by``, measure, bucket, n): the mergeable sketch of each measure; ``n`` adds up over groups."""
    long = measures.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), v.cast("long").alias("v")) for m, v in _ratios().items()])).alias("e"))
    long = long.select(*by, "e.measure", "e.v").where("v IS NOT NULL")
    bucket = F.expr("v - v % shiftleft(1L, greatest(0, length(bin(v)) - 5))")
    return long.groupBy(*by, "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketches: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Rows (``by``, measure, lo, hi, total) from the sketches merged over everything that is not in ``by``."""
    merged = sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    ranked = merged.select(
        *by, "measure", "bucket", F.sum("n").over(group).alias("total"),
        F.sum("n").over(group.orderBy("bucket")).alias("upto"))
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("measure")]
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("bucket")))
    found = ranked.groupBy(*by, "measure").agg(
        F.max("total").alias("total"), at(100 - level).alias("low"), at(F.lit(50)).alias("mid"), at(level).alias("high"))
    bucket = "shiftleft(1L, greatest(0, length(bin({})) - 5))".format
    found = found.withColumn("reach", F.col("mid") + SPREAD * (F.col("high") - F.col("mid")))
    return found.select(
        *by, "measure", "total",
        F.when(F.col("measure") == "letters", F.col("mid") - SPREAD * (F.col("mid") - F.col("low")) - F.expr(bucket("mid")))
        .otherwise(F.lit(0)).cast("long").alias("lo"), (F.col("reach") + F.expr(bucket("reach"))).alias("hi"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row per language and source with ``lo_<measure>`` and ``hi_<measure>``, from the nearest level with enough documents."""
    own, lang, all_ = (fences(sketches, by) for by in (("lang", "source"), ("lang",), ()))
    wide = own.alias("o").join(lang.alias("l"), F.expr("o.lang <=> l.lang AND o.measure = l.measure")) \
        .join(all_.alias("a"), F.expr("o.measure = a.measure"))
    pick = lambda c: F.when(F.col("o.total") >= MIN_DOCUMENTS, F.col(f"o.{c}")).when(
        F.col("l.total") >= MIN_DOCUMENTS, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    chosen = wide.select("o.lang", "o.source", "o.measure", pick("lo").alias("lo"), pick("hi").alias("hi"))
    return chosen.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}") for m in MEASURES for c in ("lo", "hi")])


def apply_rules(df: DataFrame) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row with ``doc_id``, ``text``, ``lang`` and ``source``."""
    measured = materialize(measure(df), "quality")
    limits = thresholds(sketch(measured)).withColumnsRenamed({"lang": "its lang", "source": "its source"})
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("its lang")) & F.col("source").eqNullSafe(F.col("its source")),
                           "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.lit(True)
    for m, ratio in _ratios(SPARE).items():
        within &= F.coalesce(ratio.between(F.col(f"lo_{m}"), F.col(f"hi_{m}")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & within).alias("kept"))
