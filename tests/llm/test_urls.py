"""Operator 6: parts and rules against plain Python, the trees by held-out accuracy."""

import random
import zlib

from tidewright.llm import urls
from tidewright.llm.queries import SPAM, URL_RULES, labelled_urls

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/x?q#f", "http://a.example.net/en/", "http://example.net/en", "x://net", "x://net/", "x://NET?a/b",
        "http://notexample.com/de/", "http://example.com/de/", "http://m.example.com/de", "https://org/fr/1", "https://xorg/fr/1", "https://a.org/fr/?x=/#",
        "a://b://c.net/d", "http://É.NET/É", "http://x.net#/frag", "http://x.net/a b\nc", "://net/", "http://example.net/en/" + "y" * 5000]


def parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule_of(host, path):
    fits = []
    for rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule))
    return min(fits)[1] if fits else None


def corpus(n=900):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 9)))
    out = []
    for _ in range(n):
        name = f"{rng.choice(['casino', 'free', 'cheap'])}-{word()}" if rng.random() < 0.3 else word()
        out.append(f"https://{rng.choice(['www.', ''])}{name}.example.{rng.choice(['com', 'org', 'info'])}/{rng.choice(['en', 'es'])}/{rng.randint(1, 999)}")
    return out


def test_parts_rules_and_verdicts(spark):
    rows = [(i, u) for i, u in enumerate(URLS + corpus())] + [(None, URLS[4]), (4, URLS[4])]
    pages = spark.createDataFrame([(i, u, "r") for i, u in rows], "page_id long, url string, rule string").repartition(3)
    got = urls.judge(pages, URL_RULES, urls.fit(labelled_urls(pages))).collect()
    want = [(i, *parts(u), rule_of(*parts(u))) for i, u in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(want, key=key)
    assert all(r.verdict == (URL_RULES[r.rule] if r.rule else "block" if r.p_block >= 0.5 else "allow") for r in got)


def test_held_out_accuracy(spark):
    rows = [(i, u) for i, u in enumerate(corpus(1500))]
    held = lambda u: zlib.crc32(u.encode()) % 4 == 0
    train = spark.createDataFrame([r for r in rows if not held(r[1])], "page_id long, url string")
    test = spark.createDataFrame([r for r in rows if held(r[1])], "page_id long, url string")
    scored = urls.fit(labelled_urls(train)).blocked(test, "url", ("url",)).collect()
    right = [(r.p_block >= 0.5) == any(s in r.url.split("/")[2].replace("-", ".").split(".") for s in SPAM) for r in scored]
    assert sum(right) >= 0.97 * len(right)


def test_without_labels_everything_undecided_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, "http://x.net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(pages, URL_RULES, urls.fit(labelled_urls(pages))).collect()}
    assert got == {1: "allow", 2: "block"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, URL_RULES, urls.fit(labelled_urls(pages))).collect() == []
