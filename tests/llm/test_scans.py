"""Quality rules, license scans and URL filters against plain Python."""

import random
import re

from skein.llm import license_scan, quality_rules, url_filter

from . import brute


def test_quality_counts_and_odd_cases(spark):
    docs = brute.odd_documents()
    rows = quality_rules.judge_quality(spark.createDataFrame(docs, brute.SCHEMA)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = r["text"] or ""
        lines = [x for x in t.split("\n") if brute.words(x)]
        assert r["n_words"] == len(brute.words(t))
        assert r["word_chars"] == sum(map(len, brute.words(t)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == brute.repeated_words(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_rejects_signs_and_keeps_prose(spark):
    prose = "The house of the old man was in the town, and that is where it stood for a long time. " * 1
    text = " ".join(f"{w}{k}" if k % 9 == 0 else w for k, w in enumerate((prose * 12).split()))
    signs = " ".join(f"{w}{'***' if k % 2 else '$$$'}" for k, w in enumerate("some words that mean nothing at all here now".split() * 12))
    df = spark.createDataFrame([(1, text), (2, signs)], "doc_id long, text string")
    kept = {r["doc_id"]: (r["class_distance"], r["base_failed"]) for r in quality_rules.judge_quality(df).collect()}
    assert kept[1][0] < quality_rules.MAX_CLASS_DISTANCE < kept[2][0]


def test_quality_empty_table_and_clashing_columns(spark):
    assert quality_rules.judge_quality(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    df = spark.createDataFrame([("x", "a b", "mine")], "n_words string, text string, other string")
    row = quality_rules.judge_quality(df).first()
    assert row["n_words"] == 2 and row["other"] == "mine"


def test_wrong_word_mix_alone_rejects(spark):
    r = random.Random(4)
    invented = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8)))
    prose = lambda common: ". ".join(" ".join([invented(), *(w for _ in range(5) for w in (r.choice(common), invented()))]).capitalize() for _ in range(40)) + "."
    mix = [w for w, n in quality_rules.WORD_REFERENCES["en"].items() for _ in range(n)]
    df = spark.createDataFrame([(1, prose(mix)), (2, prose("for it with be by on as this are or from at".split()))], "doc_id long, text string")
    good, bad = sorted(quality_rules.judge_quality(df).collect(), key=lambda x: x["doc_id"])
    assert good["kept"] and not bad["kept"] and not bad["base_failed"]
    assert bad["class_distance"] < quality_rules.MAX_CLASS_DISTANCE
    assert good["word_distance"] < 0.5 < 0.55 < bad["word_distance"] < 0.70


def test_common_words_count_with_capitals_and_punctuation(spark):
    r = random.Random(14)
    mix = [w for w, n in quality_rules.WORD_REFERENCES["en"].items() for _ in range(n)]
    text = " ".join(r.choice([w.capitalize(), f"{w},", f'"{w}"', w]) for w in (r.choice(mix) for _ in range(300)))
    row = quality_rules.judge_quality(spark.createDataFrame([(text,)], "text string")).first()
    assert row["word_distance"] < 0.2


def test_references_fitted_on_a_corpus(spark):
    r = random.Random(15)
    docs = [("en", " ".join(r.choice(["The", "of,", "and", "stone", "7", "a#b"]) for _ in range(60))) for _ in range(8)] + [("de", "Der und der"), ("xx", "the the"), ("fr", None), (None, "the")]
    classes, words = quality_rules.fit_references(spark.createDataFrame(docs, "lang string, text string"))
    joined = "".join(t for lang, t in docs if lang == "en")
    plain = [brute.lower(w).strip(quality_rules.PUNCTUATION) for lang, t in docs if lang == "en" for w in t.split()]
    assert words["en"] == {w: plain.count(w) for w in quality_rules.WORD_REFERENCES["en"]} and set(words) == {"en", "de"}
    capitals, digits, spaces, symbols = (sum(test(c) for c in joined) for test in (str.isupper, str.isdigit, str.isspace, "#".__eq__))
    small = sum(c.islower() for c in joined)
    want = [small, capitals, digits, spaces, len(joined) - small - capitals - digits - spaces - symbols, symbols]
    assert set(classes) == {"en", "de"} and all(abs(x - y / len(joined)) < 1e-12 for x, y in zip(classes["en"], want, strict=True))
    df = spark.createDataFrame([(docs[0][1] * 5,)], "text string")
    own = quality_rules.judge_quality(df, class_references=classes, word_references=words).first()
    assert own["class_distance"] < 0.05 and own["word_distance"] < 0.25


def test_license_base_and_templates(spark):
    docs = brute.odd_documents()
    rows = license_scan.scan_licenses(spark.createDataFrame(docs, brute.SCHEMA)).collect()
    assert len(rows) == len(docs)
    shape = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for r in rows:
        low = brute.lower(r["text"])
        w = re.findall(shape, low)
        starts, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            starts += found
            base |= {label} if found else set()
        labels, best = set(base), 1.0 if base else 0.0
        lines = [re.findall(shape, line) for line in low.split("\n")]
        for n in license_scan.RUNS:
            for k in range(max(1, len(lines) - n + 1)):
                found = [w for line in lines[k : k + n] for w in line]
                for label, t in license_scan.TEMPLATES:
                    ws = set(re.findall("[a-z0-9]+", t.lower()))
                    if len(ws & set(found)) >= license_scan.needed(len(ws), 0.8) and (n == 1 or len(found) <= 4 * len(ws)):
                        labels.add(label)
                        best = max(best, len(ws & set(found)) / len(ws))
        assert (r["n_words"], r["n_base"], r["base_labels"], r["labels"]) == (len(w), len(starts), ",".join(sorted(base)), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert abs(r["score"] - best) < 1e-12


def test_license_notices_over_several_lines(spark):
    mit = next(t for label, t in license_scan.TEMPLATES if label == "mit" and "merge" in t)
    wrapped = "Some words first.\n/*\n" + "\n".join(" * " + " ".join(mit.split()[k : k + 9]) for k in range(0, len(mit.split()), 9)) + "\n */\nand code()\n" * 5
    texts = {"apache": "Licensed under the Apache\nLicense, Version 2.0.", "mit": wrapped, "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "": "licensed\n" * 40 + "under a house\n" * 20 + "the apache version\n" + "of 2 and 0\n"}
    rows = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "want string, text string")).collect()
    assert {r["want"]: r["labels"] for r in rows} == {k: k for k in texts}


def test_scans_take_long_gaps(spark):
    import time

    text = "cc by" + " " * 1_000_000 + "all rights reserved" + "\n" * 300_000 + "x"
    df = spark.createDataFrame([(1, text), (2, " " * 1_000_000)], "doc_id long, text string")
    began = time.time()
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    judged = {r["doc_id"]: r for r in quality_rules.judge_quality(df).collect()}
    assert time.time() - began < 60
    assert (rows[1]["n_words"], rows[1]["base_labels"], rows[2]["n_words"]) == (6, "cc-by,reserved", 0)
    assert (judged[1]["n_words"], judged[2]["n_words"], judged[1]["n_dup_lines"]) == (6, 0, 0)


def test_license_empty_table_and_no_templates(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], brute.SCHEMA)).count() == 0
    df = spark.createDataFrame([("cc by", 5)], "text string, labels int")
    row = license_scan.scan_licenses(df, templates=[]).first()
    assert row["labels"] == "cc-by" and row["n_base"] == 1


URLS = [
    (1, "http://a.EXAMPLE.net/en/1"), (2, "https://example.com/de/x?y"), (3, "https://www.b.org/fr/#a"), (4, "http://myexample.com/de/"), (5, None), (6, "no scheme"),
    (7, "https://m.ads-track.example.com/fr/1"), (8, "http://x.net?q=/en/"), (9, "x://"), (10, "https://x.example.org/page?utm_medium=affiliate"), (11, "https://x.example.org/badads-track.html"), (12, ""),
]


def plain_verdict(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = brute.lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hits = [p for p in map(url_filter.compile_pattern, url_filter.PATTERNS) if re.search(p.regex.replace(r"\z", r"\Z"), brute.lower(url))]
    blocked = bool(hits) and not any(p.allow for p in hits)
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "block" if blocked else "allow"


def test_urls(spark):
    rows = url_filter.filter_urls(spark.createDataFrame(URLS, "page_id long, url string")).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"]), r["url"]


def test_rules_are_filed_under_their_rarest_token():
    p = url_filter.compile_pattern("||ads-track.")
    assert p.tokens == ("ads", "track")
    assert list(url_filter.rule_index([p], {"ads": 9, "track": 2})) == ["track"]
    assert url_filter.compile_pattern("*banner*").tokens == ()


def test_urls_empty_table_no_rules_and_clashing_columns(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    df = spark.createDataFrame([("http://a.net/", "mine")], "url string, rule string")
    row = url_filter.filter_urls(df, host_rules=[], patterns=[]).first()
    assert row["rule"] is None and row["verdict"] == "allow"


def test_ten_thousand_url_rules_give_what_each_alone_gives(spark):
    r = random.Random(21)
    words = [f"k{k}" for k in range(6000)] + ["ads", "shop", "www"]
    patterns = [f"||{r.choice(words)}." if k % 3 == 0 else f"/{r.choice(words)}/*/{r.choice(words)}^" if k % 3 == 1 else f"@@||{r.choice(words)}.*/{r.choice(words)}/" for k in range(10_000)]
    hosts = [("block" if k % 2 else "allow", f"h{k % 700}.net", f"/p{k % 5}/") for k in range(3000)]
    urls = [f"http://{r.choice(words)}.h{r.randrange(800)}.net/p{r.randrange(6)}/{r.choice(words)}/x/{r.choice(words)}" + r.choice(["", "/", "?q=1"]) for _ in range(150)]
    rows = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), host_rules=dict.fromkeys(hosts), patterns=list(dict.fromkeys(patterns))).collect()
    compiled = [(p.text, p.allow, re.compile(p.regex.replace(r"\z", r"\Z"))) for p in map(url_filter.compile_pattern, dict.fromkeys(patterns))]
    for row in rows:
        hits = [(text, allow) for text, allow, regex in compiled if regex.search(row["url"])]
        want = None if any(allow for _, allow in hits) else min((text for text, _ in hits), default=None)
        fits = [(len(h + p), h + p, v) for v, h, p in hosts if (row["host"] == h or row["host"].endswith("." + h)) and row["path"].startswith(p)]
        assert row["pattern"] == want
        assert row["rule"] == max(fits, default=(0, None, None))[1]
    assert any(row["pattern"] for row in rows) and any(row["rule"] for row in rows)
