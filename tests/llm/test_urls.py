import random

from siftwork.llm import urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith(r[0][r[0].index("/") :])]
    best = max(fits, key=lambda r: (len(r[0]), r[0]), default=(None, "allow"))
    return host, path, best[0], best[1]


def test_equals_brute_force(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["a", "B", "net", "org", "é", "x.y"])
    rules = [("net/", "block"), ("a.net/en/", "allow"), ("org/", "block"), ("org/a", "allow"), ("é/", "block")]
    rules += [(f"h{k}.net/p{k}/", "block") for k in range(500)]
    rows = [None, "", "nothing", "://", "http://", "http://net", "http://NET/", "x://a.net/en/?q#f", "a://b://c.net/"]
    rows += [f"http://{part()}.{part()}{rng.choice(['', '/', '/en/', '/a', '?x=/en/', '#net/'])}{part()}" for _ in range(400)]
    rows += [f"https://www.h{k}.net/p{k}/{k}" for k in range(0, 500, 7)] + ["http://net/"] * 5
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(rows)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, spark.createDataFrame(rules, "rule string, verdict string")).collect()}
    assert got == {k: brute(u, rules) for k, u in enumerate(rows)}


def test_repeated_and_empty(spark):
    rules = spark.createDataFrame([("net/", "block"), ("net/", "allow"), (None, "block")], "rule string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in urls.judge(df, rules).collect()) == [(0, "allow"), (1, "allow"), (1, "allow")]
    assert urls.judge(df.where("false"), rules).collect() == []


def test_without_rules(spark):
    rules = spark.createDataFrame([], "rule string, verdict string")
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge(df, rules).first().verdict == "allow"
