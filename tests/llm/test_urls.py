"""Operator 7: parts and rules against brute force, held-out accuracy of the trees."""

import random

from pyspark.sql import functions as F

from pulsegrid.llm import urls

URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1?x=/#y", "https://sub.example.org/en/12", "https://example.org/en/2",
        "http://a.com/fr/", "http://a.com/de/x", "http://com/de/", "http://notcom/de/", "http://x.org", "http://x.org?q=/es/", "a://b://c.org/p",
        "http://b.net/p/q.html?a=1&b=2#f", "http://EXAMPLE.org/ES/", "http://org/", "http://example.org\n/es/"]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = urls.filter_urls(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, best = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r.url
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (best is not None)


def labelled(n, seed):
    rng = random.Random(seed)
    words = "news garden river school music recipe travel market history science".split()
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            path = "/".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
            out.append((f"https://www.{rng.choice(words)}{rng.choice(words)}.{rng.choice(['org', 'com', 'net'])}/{path}.html", 0))
        else:
            junk = "".join(rng.choice("0123456789abcdefxyz") for _ in range(rng.randint(10, 30)))
            query = "&".join(f"{rng.choice('abcdef')}={rng.randint(1, 10 ** 6)}" for _ in range(rng.randint(1, 6)))
            out.append((f"http://{junk}.{rng.choice(['xyz', 'com', 'top'])}/{rng.randint(1, 10 ** 6)}?{query}", 1))
    return out


def test_trees_on_held_out_urls(spark):
    model = urls.train(spark.createDataFrame(labelled(1500, 1), "url string, label int"))
    held = spark.createDataFrame(labelled(600, 2), "url string, label int")
    judged = model.judged(urls.with_features(urls.with_parts(held)))
    right = judged.where((F.col("model_verdict") == "block") == (F.col("label") == 1)).count()
    assert right >= 0.95 * 600
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_model_without_two_classes(spark):
    none = urls.train(spark.createDataFrame([], "url string, label int"))
    one = urls.train(spark.createDataFrame([("http://a/", 1), ("http://b/", None)], "url string, label int"))
    df = urls.with_features(urls.with_parts(spark.createDataFrame([("http://c/",)], "url string")))
    assert none.judged(df).first().model_verdict == "allow" and one.judged(df).first().model_verdict == "block"


def test_entropy_and_empty_table(spark):
    df = urls.with_features(urls.with_parts(spark.createDataFrame([("aabb",), ("aaaa",), ("",), (None,)], "url string")))
    assert [round(r.entropy, 6) for r in df.collect()] == [1.0, 0.0, 0.0, 0.0]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_suffix_statistics_cover_all_labelled_rows(spark):
    rows = labelled(400, 3)
    df = spark.createDataFrame(rows, "url string, label int")
    model = urls.train(df, rows=60, trees=2)
    for kind in ("host_suffix", "path_suffix"):
        want = {r[kind]: (r["n"], r["b"]) for r in urls.with_features(urls.with_parts(df)).groupBy(kind)
                .agg(F.count("*").alias("n"), F.sum("label").alias("b")).collect()}
        got = {r[kind]: r for r in model.suffixes[kind].collect()}
        assert {k: r[f"{kind}_rows"] for k, r in got.items()} == {k: n for k, (n, _) in want.items()}
        rate = sum(label for _, label in rows) / len(rows)
        for k, (n, b) in want.items():
            assert abs(got[k][f"{kind}_rate"] - (b + urls.PRIOR_ROWS * rate) / (n + urls.PRIOR_ROWS)) < 1e-9


def test_repeated_url_leaves_room_for_the_others(spark):
    rows = labelled(300, 4)
    hot = spark.createDataFrame(rows, "url string, label int").orderBy(F.xxhash64("url")).first()
    df = spark.createDataFrame(rows + [tuple(hot)] * 1000, "url string, label int")
    assert urls.train(df, rows=100, trees=2).trees is not None
