"""The sweep against a comparison of every url with every rule."""

import random

from weirline.llm import urlrules


def judge(url, rules, default):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:k]), rest[k:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    rules = [(h, p or "", v) for h, p, v in rules]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_equals_every_rule(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "FEWEST_RANGES", 9)
    r = random.Random(1)
    labels = ["a", "b", "ab", "org", "com", "example", "x-y"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "/a", "/ab", "/en/1", "/é"]) for _ in range(r.randint(0, 3)))
    rules = [(host(), path(), r.choice(["allow", "block"])) for _ in range(60)] + [("org", "/", "allow"), ("org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("com", None, "block")]
    urls = [f"http{r.choice(['', 's'])}://{r.choice([host(), host().upper()])}{path()}{r.choice(['', '?q=/a', '#/a', '?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http:///path", "x://a://b/c", "http://Example.ORG", "http://org/", "http://" + "a." * 300 + "org/en/1", "a\nb://ORG/x"] + ["http://hot.example.com/ab"] * 300
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(3)
    got = urlrules.apply_rules(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), default="allow").collect()
    assert len(got) == len(urls)
    for row in got:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == judge(urls[row["page_id"]], rules, "allow"), urls[row["page_id"]]


def test_empty_tables_and_repeated_rows(spark):
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    urls = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, "http://a.org/")], "page_id long, url string")
    assert [r["verdict"] for r in urlrules.apply_rules(urls, rules).collect()] == ["block"] * 3
    assert [r["verdict"] for r in urlrules.apply_rules(urls, rules.limit(0), default="block").collect()] == ["block"] * 3
    assert urlrules.apply_rules(urls.limit(0), rules).count() == 0
