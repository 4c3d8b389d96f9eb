import pytest

from tessera.llm import url_filter

SCHEMA = "page_id long, url string, html string"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[n:]
    k = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), path[:k]


def verdict(host, path):
    best = None
    for said, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, said)
    return best or (None, None)


URLS = [
    None, "", "nothing", "http://A.Example.NET/en/x?q#f", "http://example.net/de/", "https://x.com/de/", "http://www.example.com/de/1", "http://y.org/fr/", "http://y.org/fr", "http://z.net", "http://z.net?x=/", "a://b://c/d", "http://xnet/",
    "http://notexample.com/de/", "HTTP://Ünï.org/fr/é", "http://h.net/" + "a" * 3000, "http://p.org/#x", "://only", "http://dup.net/", "http://dup.net/",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], SCHEMA)
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, said = verdict(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == said if said else rows[i]["verdict"] in ("allow", "block")


def test_models_tell_kinds_apart(spark):
    good = [f"http://news{i}.org/fr/garden-{i}" for i in range(40)]
    bad = [f"http://casino{i}.net/xxx/win{i}" for i in range(40)]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate([*good, *bad, "http://news7.com/garden-3", "http://casino3.com/xxx/win9"])], SCHEMA)
    rows = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert rows[80]["score"] > 0 > rows[81]["score"] and (rows[80]["verdict"], rows[81]["verdict"]) == ("allow", "block")


def test_scores_against_a_direct_model(spark):
    counts = {(0, 1): (2, 1), (0, 2): (1, 3), (1, 2): (0, 2)}  # context, symbol: accepted, rejected
    df = spark.createDataFrame([(c * 32 + s, a, r) for (c, s), (a, r) in counts.items()], "gram int, a long, r long")
    got = {x["gram"]: x["llr"] for x in url_filter.log_ratios(df).collect()}

    def p(k, c, s):
        """Blended from no context to three; contexts of one to three symbols are the same here."""
        own = {}
        for (c2, s2), v in counts.items():
            own.setdefault(c2, {})[s2] = v[k]
        order0 = {}
        for v in own.values():
            for s2, n in v.items():
                order0[s2] = order0.get(s2, 0) + n
        x = 1 / 32
        for table in (order0, own.get(c, {}), own.get(c, {}), own.get(c, {})):
            n, t = sum(table.values()), sum(v > 0 for v in table.values())
            x = (table.get(s, 0) + t * x) / (n + t) if n + t else x
        return x

    import math

    for (c, s), _ in counts.items():
        assert got[c * 32 + s] == pytest.approx(math.log(p(0, c, s) / p(1, c, s)))


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).count() == 0
