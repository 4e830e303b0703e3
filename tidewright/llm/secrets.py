"""Secret scans (operator 8), in DataFrame functions only.

Three patterns give the base spans. The method adds tokens that look drawn at random. Of
every token of 16 characters or more with letters and digits, the encoding is inferred
(hexadecimal, base 32, base 64), and a battery asks whether its symbols are uniform
(chi-squared over equal bins of the alphabet), whether symbols of the lower and the upper half of the
alphabet take turns as often as they should (runs test), and whether neighbours are
uncorrelated (serial correlation). A token whose three statistics together are improbable for a random
string is not one. Ordinary tokens keep to one kind of character for long: how improbable a
token's changes between digits, lower case, upper case and signs are for an ordinary token is
bounded by Chernoff's inequality, which sharpens with length. These bounds are p-values;
Benjamini and Hochberg's procedure, run for each band of lengths over all tokens of the table, sets
the least bound at which a token is reported, so the share of false reports stays below ``RATE``.

A missing text counts as empty and gives no span. Positions are code points, the end is
exclusive. Every row gives one row, repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import materialize

KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    # A run that is long enough as a whole is what the shorter pattern with a test of length would give.
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "random": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}",
}
LEAST_VALUE = 12
RATE = 0.01
#: Chance that an ordinary token changes the kind of character from one place to the next.
CHANGES = 0.12
#: Joint deviation, in standard deviations, beyond which a token does not pass for random.
DEVIATION = 3.0
BANDS = (24, 32, 48)
#: Per encoding: symbols in order of value, symbols in a bin, and where a new kind of character begins.
ALPHABETS = (("0123456789abcdef", 1, (10,)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 4, (26,)),
             ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 4, (26, 52, 62)))
_SPANS = "array<struct<start:int,stop:int,at:int>>"


def _spans(kind: str) -> Column:
    """Where the matches ``m_kind`` stand, from the lengths of the texts between them."""
    def step(a, i):
        start = a["pos"] + F.length(F.get(f"g_{kind}", i))
        stop = start + F.length(F.get(f"m_{kind}", i))
        return F.struct(stop.alias("pos"), F.concat(a["out"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"), i.alias("at")))).alias("out"))

    found = F.size(f"m_{kind}")
    return F.when(found > 0, F.aggregate(
        F.sequence(F.lit(0), found - 1),
        F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("out")), step)["out"]).otherwise(F.array().cast(_SPANS))


def _battery() -> list[tuple[str, str]]:
    """SQL for an array of tokens, one step per entry: each maps structs to structs with more fields."""
    by_encoding = lambda pick: "CASE c.enc " + " ".join(f"WHEN {i} THEN {pick(a)}" for i, a in enumerate(ALPHABETS)) + " END"
    kind = lambda a: "CASE " + " ".join(f"WHEN x < {edge} THEN {i}" for i, edge in enumerate(a[2])) + f" ELSE {len(a[2])} END"
    norm = "named_struct('start', c.start, 'stop', c.stop, {})"
    return [("t", f"transform(t, c -> {norm})".format(
        "'enc', CASE WHEN c.token RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 0 WHEN c.token RLIKE '^[A-Z2-7]+=*$' THEN 1 ELSE 2 END, "
        "'chars', filter(split(rtrim('=', translate(c.token, '-_', '+/')), ''), x -> x != '')")),
        ("t", f"transform(t, c -> {norm})".format("'enc', c.enc, 'codes', transform(c.chars, x -> " + by_encoding(
            lambda a: f"instr('{a[0]}', {'lower(x)' if a[1] == 1 else 'x'}) - 1") + ")")),
        ("t", f"transform(t, c -> {norm})".format(
            "'enc', c.enc, 'codes', c.codes, 'n', CAST(size(c.codes) AS DOUBLE), "
            "'kinds', transform(c.codes, x -> " + by_encoding(kind) + "), "
            "'high', transform(c.codes, x -> " + by_encoding(lambda a: f"x >= {len(a[0]) // 2}") + "), "
            "'mean', aggregate(c.codes, 0D, (a, x) -> a + x) / size(c.codes), "
            "'bins', " + by_encoding(lambda a: f"{len(a[0]) / a[1]:.1f}D") + ", "
            "'squares', aggregate(sequence(0, 15), 0D, (a, b) -> a + pow(size(filter(c.codes, x -> "
            + by_encoding(lambda a: f"x div {a[1]}") + " = b)), 2))")),
        ("t", f"transform(t, c -> {norm})".format(
            "'n', c.n, 'bins', c.bins, 'chi', c.bins / c.n * c.squares - c.n, "
            "'changes', size(filter(sequence(1, size(c.codes) - 1), i -> get(c.kinds, i) != get(c.kinds, i - 1))), "
            "'runs', 1 + size(filter(sequence(1, size(c.codes) - 1), i -> get(c.high, i) != get(c.high, i - 1))), "
            "'ups', CAST(size(filter(c.high, x -> x)) AS DOUBLE), "
            "'around', aggregate(c.codes, 0D, (a, x) -> a + pow(x - c.mean, 2)), "
            "'along', aggregate(sequence(1, size(c.codes) - 1), 0D, (a, i) -> a + "
            "(get(c.codes, i) - c.mean) * (get(c.codes, i - 1) - c.mean))")),
        ("t", f"transform(t, c -> {norm})".format(
            "'n', c.n, 'rate', c.changes / (c.n - 1), "
            # Wilson and Hilferty's cube root makes a chi-squared value a standard normal one.
            "'z_chi', (cbrt(c.chi / (c.bins - 1)) - 1 + 2 / (9 * (c.bins - 1))) / sqrt(2 / (9 * (c.bins - 1))), "
            "'z_runs', CASE WHEN c.ups < 1 OR c.ups > c.n - 1 THEN 9D ELSE (c.runs - 1 - 2 * c.ups * (c.n - c.ups) / c.n) / "
            "sqrt(greatest(1e-9D, 2 * c.ups * (c.n - c.ups) * (2 * c.ups * (c.n - c.ups) - c.n) / (c.n * c.n * (c.n - 1)))) END, "
            "'z_serial', CASE WHEN c.around <= 0 THEN 9D ELSE (c.along / c.around + 1 / (c.n - 1)) * sqrt(c.n) END")),
        ("t", f"transform(t, c -> {norm})".format(
            f"'band', CAST({' + '.join(f'CASE WHEN c.n >= {b} THEN 1 ELSE 0 END' for b in BANDS)} AS INT), "
            f"'random', cbrt((pow(greatest(0D, c.z_chi), 2) + pow(c.z_runs, 2) + pow(c.z_serial, 2)) / 3) "
            f"<= 1 - 2 / 27D + {DEVIATION}D * sqrt(2 / 27D), "
            f"'evidence', CASE WHEN c.rate <= {CHANGES}D THEN 0 ELSE least(4000, CAST(floor(4 * (c.n - 1) * ("
            f"c.rate * ln(c.rate / {CHANGES}D) + CASE WHEN c.rate < 1 THEN (1 - c.rate) * ln((1 - c.rate) / {1 - CHANGES}D) ELSE 0D END"
            ")) AS INT)) END"))]


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base spans ``base`` and the tested tokens ``t`` (start, stop, band, random, evidence)."""
    t = F.col("t")
    step = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    step = step.select(*keep, "t", *[
        F.when(t.rlike(p), F.regexp_extract_all("t", F.lit(p), 0)).otherwise(F.array().cast("array<string>")).alias(f"m_{k}")
        for k, p in PATTERNS.items()])
    step = step.select(*keep, *[f"m_{k}" for k in KINDS], F.when(F.size("m_assign") > 0, F.regexp_extract_all(
        "t", F.lit(PATTERNS["assign"]), 2)).alias("values"), *[
        F.when(F.size(f"m_{k}") > 0, F.split("t", p)).alias(f"g_{k}") for k, p in PATTERNS.items()])
    step = step.select(*keep, "values", "m_random", *[_spans(k).alias(k) for k in KINDS])
    step = step.withColumn("assign", F.filter("assign", lambda s: F.length(F.get("values", s["at"])) >= LEAST_VALUE))
    tag = lambda k: F.transform(k, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), s["stop"].alias("stop")))
    step = step.select(
        *keep, F.array_sort(F.concat(*[tag(k) for k in KINDS[:3]])).alias("base"),
        F.transform("random", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"),
                                                 F.get("m_random", s["at"]).alias("token"))).alias("t"))
    step = step.withColumn("t", F.filter("t", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))))
    for name, expression in _battery():
        step = step.withColumn(name, F.when(F.size("t") > 0, F.expr(expression)))
    return step


def least_evidence(scanned: DataFrame) -> dict[int, int]:
    """Per band of lengths the evidence from which on tokens are reported, by false-discovery control.

    At most one row per band and step of evidence reaches the driver.
    """
    tokens = scanned.select(F.explode("t").alias("c")).select("c.*")
    steps = tokens.groupBy("band", F.when(F.col("random"), F.col("evidence")).otherwise(0).alias("evidence")).count()
    found: dict[int, int] = {}
    tested: dict[int, int] = {}
    above: dict[int, int] = {}
    rows = sorted(map(tuple, steps.collect()), key=lambda r: (r[0], -r[1]))
    for band, _, n in rows:
        tested[band] = tested.get(band, 0) + n
    for band, evidence, n in rows:
        above[band] = above.get(band, 0) + n
        if evidence > 0 and math.exp(-evidence / 4) <= RATE * above[band] / tested[band]:
            found[band] = evidence
    return found


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` and ``spans``: arrays of (start, kind, stop) in order, the latter with the method's."""
    scanned = materialize(scan(df, text, keep), "secrets")
    least = least_evidence(scanned)
    clause = " OR ".join(f"(c.band = {b} AND c.evidence >= {e})" for b, e in least.items())
    added = F.expr(f"transform(filter(coalesce(t, array()), c -> c.random AND ({clause})), c -> "
                   f"named_struct('start', c.start, 'kind', {KINDS.index('random')}, 'stop', c.stop))") if least else F.array()
    kind = "array<struct<start:int,kind:int,stop:int>>"
    return scanned.select(*keep, F.col("base").cast(kind).alias("base"),
                          F.array_sort(F.concat(F.col("base").cast(kind), F.coalesce(added, F.array()).cast(kind))).alias("spans"))


def shown(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(df: DataFrame) -> DataFrame:
    found = find_secrets(df)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"),
                        shown("spans").alias("spans"))


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """All columns of ``df``, with every span of ``text`` replaced by ``mask``; overlapping spans give one mask.

    ``length`` names a column with the length of the text, which then follows; rows without a span stay as they are.
    """
    found = find_secrets(df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")), "text", ("row",))
    own = F.col("row").getField(text)
    cut = lambda a, s: F.struct(
        F.when(s["start"] >= a["end"], F.concat(a["out"], F.substring(own, a["end"] + 1, s["start"] - a["end"]), F.lit(mask)))
        .otherwise(a["out"]).alias("out"), F.greatest(a["end"], s["stop"]).alias("end"))
    cleaned = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("end")), cut,
                          lambda a: F.concat(a["out"], F.substring(own, a["end"] + 1, F.length(own))))
    some = F.size("spans") > 0
    changed = {text: cleaned} | ({length: F.length(cleaned).cast(df.schema[length].dataType)} if length else {})
    return found.select(*[(F.when(some, changed[c]).otherwise(F.col("row").getField(c)) if c in changed
                           else F.col("row").getField(c)).alias(c) for c in df.columns])
