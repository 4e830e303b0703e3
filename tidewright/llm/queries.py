"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from tidewright.llm import byte_bpe, codes, decontaminate, histogram, minhash, periodic, quality, secrets, shards, substrings, suffixes, toxicity, urls
from tidewright.llm.registry import query, read

DOCUMENTS = ("doc_id", "text", "lang", "source")


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf):
    return byte_bpe.encode_decode_report(
        read(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


_RATIOS = {"symbols": "n_symbols * 1000 // n_words", "letters": "word_chars * 100 // n_words",
           "lines": "n_dup_lines * 1000 // n_lines", "repeats": "n_repeat_words * 1000 // n_words"}
_LEVELS = (("own", "lang, source, "), ("of_lang", "lang, "), ("of_all", ""))


_JUDGED = {k: e if k == "letters" else f"greatest({e.split(' *')[0]} - {quality.SPARE}, 0) *{e.split(' *', 1)[1]}" for k, e in _RATIOS.items()}


def _fences(name: str, by: str) -> str:
    """DuckDB: fences of every measure at one level, from the sketch merged over the rest."""
    level = "CASE measure " + " ".join(f"WHEN '{m}' THEN {p}" for m, p in quality.LEVELS.items()) + " END"
    at = "min(bucket) FILTER (WHERE upto * 100 >= total * {})".format
    bucket = "(1::BIGINT << greatest(0, length(bin({})) - 5))".format
    return f"""{name} AS (
        SELECT {by}measure, total, CASE WHEN measure = 'letters' THEN mid - {quality.SPREAD} * (mid - low) - {bucket('mid')} ELSE 0 END AS lo,
               reach + {bucket('reach')} AS hi
        FROM (SELECT *, mid + {quality.SPREAD} * (high - mid) AS reach FROM (
            SELECT {by}measure, max(total) AS total, {at(f'(100 - {level})')} AS low, {at(50)} AS mid, {at(level)} AS high
            FROM (SELECT {by}measure, bucket, sum(n) OVER (PARTITION BY {by}measure) AS total,
                         sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto
                  FROM (SELECT {by}measure, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL))
            GROUP BY {by}measure)))"""


QUALITY_SQL = rf"""WITH d AS (
        SELECT doc_id, lang, source, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
        FROM documents),
    windows AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS k
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
    repeats AS (SELECT doc_id, sum(own) AS n FROM (
                SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS own FROM again)
                GROUP BY doc_id),
    m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words,
                 length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                 len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                 coalesce(r.n, 0)::BIGINT AS n_repeat_words
          FROM d LEFT JOIN repeats r USING (doc_id)),
    v AS (SELECT lang, source, u.measure AS measure, u.v AS v FROM (
          SELECT lang, source, unnest([{', '.join(f"{{'measure': '{k}', 'v': ({e})::BIGINT}}" for k, e in _RATIOS.items())}]) AS u
          FROM m WHERE n_words > 0)),
    sketch AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 5)) AS bucket, count(*) AS n
               FROM v GROUP BY ALL),
    {', '.join(_fences(*x) for x in _LEVELS)},
    chosen AS (SELECT o.lang, o.source, o.measure,
                      {', '.join(f"CASE WHEN o.total >= {quality.MIN_DOCUMENTS} THEN o.{c} WHEN l.total >= {quality.MIN_DOCUMENTS} THEN l.{c} ELSE a.{c} END AS {c}" for c in ('lo', 'hi'))}
               FROM own o JOIN of_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure
               JOIN of_all a ON o.measure = a.measure),
    judged AS (SELECT doc_id, bool_and(x BETWEEN lo AND hi) AS fine FROM (
               {' UNION ALL '.join(f"SELECT doc_id, lang, source, '{k}' AS measure, {e} AS x FROM m WHERE n_words > 0" for k, e in _JUDGED.items())}) j
               JOIN chosen c ON j.lang IS NOT DISTINCT FROM c.lang AND j.source IS NOT DISTINCT FROM c.source AND j.measure = c.measure
               GROUP BY doc_id),
    based AS (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce(fine, true) AS kept
    FROM based LEFT JOIN judged USING (doc_id)"""


@query("op3_quality_rules", QUALITY_SQL)
def op3_quality_rules(spark, sf):
    return quality.apply_rules(read(spark, sf, "documents", *DOCUMENTS))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf):
    return secrets.report(read(spark, sf, "documents", "doc_id", "text"))


@query("op4_toxicity")
def op4_toxicity(spark, sf):
    return toxicity.report(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "labels", "doc_id", "toxic"))


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Parts of host names that label a URL as one to be blocked, for fitting; a page's own words are no feature.
SPAM = "ads adult bet bets casino cheap free loan pills poker porn prize track viagra win xxx".split()


def labelled_urls(pages):
    """Labels for URLs with a host: blocked if a part of the host name is on the list above."""
    host, _ = urls.host_and_path()
    parts = F.split(host, "[.-]")
    return pages.where(host != "").select("url", F.arrays_overlap(parts, F.array(*map(F.lit, SPAM))).cast("int").alias("blocked"))


@query("op6_url_filter")
def op6_url_filter(spark, sf):
    pages = read(spark, sf, "pages", "page_id", "url")
    return urls.judge(pages, URL_RULES, urls.fit(labelled_urls(pages)))


@query("op1_decontamination")
def op1_decontamination(spark, sf):
    return decontaminate.find_items(
        read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "benchmark", "item_id", "text"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark, sf):
    return substrings.report(read(spark, sf, "documents", "doc_id", "text"))


@query("op10_minhash")
def op10_minhash(spark, sf):
    return minhash.report(read(spark, sf, "documents", "doc_id", "text"))


@query("op2_suffix_array_dedup")
def op2_suffix_array_dedup(spark, sf):
    return suffixes.report(read(spark, sf, "documents", "doc_id", "text"))


@query("op9_binary_shards")
def op9_binary_shards(spark, sf):
    return shards.report(read(spark, sf, "documents", "text"))


#: Runs by brute force over equal 6-word strings: a run of 12 words or more repeats one at its period.
PERIODIC_SQL = r"""WITH RECURSIVE bits AS (
        SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
        UNION ALL
        SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY byte) AS tab FROM bits WHERE k = 8),
    crc AS (SELECT doc_id, 0 AS k, 4294967295::BIGINT AS c, doc_id::VARCHAR AS s FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
        UNION ALL
        SELECT doc_id, k + 1, xor(c >> 8, tab[1 + (xor(c, ascii(s[k + 1])) & 255)]), s FROM crc, tab WHERE k < length(s)),
    h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE k = length(s)),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, h % 10 = 0 AS planted, h // 10 AS g
          FROM documents LEFT JOIN h USING (doc_id)),
    s AS (SELECT *, len(w) AS n, (CASE WHEN len(w) > 0 THEN g % len(w) END)::BIGINT AS a FROM d),
    o AS (SELECT r, doc_id, n, CASE WHEN planted AND n > 0
                 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END])
                 ELSE w END AS w FROM s),
    grams AS (SELECT r, n, i, hash(list_slice(w, i + 1, i + 6)) AS k FROM (SELECT r, n, w, unnest(range(n - 5)) AS i FROM o WHERE n >= 12)),
    pairs AS (SELECT x.r AS r, y.i - x.i AS q, x.i AS i FROM grams x JOIN grams y ON x.r = y.r AND x.k = y.k AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
    stretches AS (SELECT r, q, min(i) AS a, max(i) + 6 - min(i) + q AS size
                  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
    runs AS (SELECT r, a, size, min(q) AS q FROM stretches WHERE size >= greatest(12, 2 * q) GROUP BY r, a, size),
    listed AS (SELECT r, count(*) AS n_runs, string_agg(a || ',' || size || ',' || q || chr(10), '' ORDER BY a, q) AS runs,
                      min({'x': -size, 'a': a, 'q': q}) AS best FROM runs GROUP BY r),
    gone AS (SELECT DISTINCT r, unnest(range(a + q, a + size)) AS i FROM runs),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text
             FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM o) ANTI JOIN gone USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.a AS "start", -best.x AS length, best.q AS period,
           -1000 * best.x // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
           sha256(coalesce(text, '')) AS collapsed_sha256
    FROM o LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""


@query("op11_periodic_runs", PERIODIC_SQL)
def op11_periodic_runs(spark, sf):
    return periodic.report(periodic.replayed(read(spark, sf, "documents", "doc_id", "text")))


@query("op12_histogram_shards")
def op12_histogram_shards(spark, sf):
    return histogram.report(read(spark, sf, "documents", "doc_id", "text"))


def _round(k: int) -> str:
    """DuckDB: the entries after round k, from the nearest ones before it."""
    return f"""near{k} AS MATERIALIZED (
        SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM (
            SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d
            FROM pieces p JOIN book{k - 1} b ON p.part = b.part AND p.pos = b.pos GROUP BY p.r, p.part, b.entry)
        GROUP BY r, part),
    book{k} AS MATERIALIZED (
        SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x
        FROM book{k - 1} b LEFT JOIN (SELECT p.part, best.entry AS entry, pos, sum(x)::BIGINT AS s, count(*) AS n
                                      FROM pieces p JOIN near{k} USING (r, part) GROUP BY ALL) USING (part, entry, pos))"""


CODES_SQL = f"""WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    pieces AS MATERIALIZED (
        SELECT r, i // (len(v) // {codes.PARTS}) AS part, i % (len(v) // {codes.PARTS}) AS pos, x
        FROM (SELECT r, v, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept)),
    book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM pieces WHERE r <= {codes.ENTRIES}),
    {", ".join(map(_round, range(1, codes.ROUNDS + 2)))},
    coded AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
              FROM near{codes.ROUNDS + 1} GROUP BY r),
    digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{codes.ROUNDS})
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (r), digest"""


@query("op13_vector_codes", CODES_SQL)
def op13_vector_codes(spark, sf):
    return codes.report(read(spark, sf, "embeddings", "vec_id", "embedding", "label"))
