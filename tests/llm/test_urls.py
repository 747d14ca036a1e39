"""The URL filter against plain rules and a plain propagation, and its SQL on pages with links."""

import random
import re

import duckdb
import pytest

from stationmine.llm import oracle, queries, urls

SCHEMA = "page_id long, url string, html string"


def plain(pages, rules, rounds=urls.ROUNDS):
    def split(url):
        at = (url or "").find("://")
        if at < 0:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S).groups()
        return host.translate(str.maketrans(urls.UPPER, urls.LOWER)), path

    def rule(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: (len(r.host + r.path), r.verdict == "block"), default=None)

    found = [(i, *split(u), rule(*split(u)), html) for i, u, html in pages]
    edges = {
        (h, to.lower())
        for _, h, _, _, html in found
        for to in re.findall(r"""<a\s(?:[^>]*?\s)?href=["']?(?:[a-z]+:)?//([^/"'?#> ]+)""", html or "", re.I)
        if h and to.lower() != h
    }

    def spread(edges, verdict):
        seed = {}
        for _, h, _, r, _ in found:
            if r and r.verdict == verdict:
                seed[h] = seed.get(h, 0) + urls.UNIT
        nodes = set(seed) | {x for e in edges for x in e}
        base = {h: seed.get(h, 0) * 3 // 20 for h in nodes}
        out = {h: [b for a, b in edges if a == h] for h in nodes}
        score = base
        for _ in range(rounds):
            new = dict(base)
            for h, s in score.items():
                for to in out[h]:
                    new[to] += s * 17 // (20 * len(out[h]))
            score = new
        return score

    trust, distrust = spread(edges, "allow"), spread({(b, a) for a, b in edges}, "block")
    rows = []
    for i, h, p, r, _ in found:
        t, d = trust.get(h, 0), distrust.get(h, 0)
        verdict = r.verdict if r else "block" if d > t else "allow"
        rows.append((i, h, p, r and r.host + r.path, verdict, t, d))
    return sorted(rows, key=repr)


def linked_pages(n, seed):
    draw = random.Random(seed)
    hosts = [f"{draw.choice(['www.', '', 'Blog.'])}h{k}.example.{draw.choice(['com', 'org', 'net', 'net'])}" for k in range(30)]
    rows = []
    for i in range(n):
        to = [draw.choice(hosts) for _ in range(draw.randrange(4))]
        form = ['<A class=x HREF="https://{}/a?b">', "<a href='//{}#t'>", "<a href=http://{}>", "<a data-href='//no.{}' href='/own'>", "<p href='//no.{}'>"]
        html = "".join(draw.choice(form).format(t) + "x</a>" for t in to)
        path = draw.choice(["/en/1x", "/en/2", "/es/", "/fr/3?q#r", "/de/4", "", "?x", "#y", "/"])
        rows.append((i, f"http{draw.choice(['', 's'])}://{draw.choice(hosts)}{path}", html))
    return rows


ODD = [
    (900, None, None), (901, "no scheme", "<a href='//x.org'>"), (902, "", ""), (903, "a://", None), (904, "://h.org/", None),
    (905, "http://ORG/x", None), (906, "http://notexample.org/es/", None), (907, "http://a.example.org/es/", None),
    (908, "http://example.org/ES/", None), (909, "http://x.org?http://y.com/de/", None), (910, "http://u:p@z.com:80/de/1\n2", None),
    (None, "http://q.com/de/", None), (911, "http://q.com/de/", None), (911, "http://q.com/de/", None), (912, "http://é.org/", None),
]


def same(spark, rows, rules=queries.RULES, rounds=6):
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rule", "'x' AS host", "2 AS score").repartition(3)
    got = sorted(map(tuple, urls.judge(frame, table, rounds=rounds).collect()), key=repr)
    assert got == plain(rows, rules, rounds)
    return got


def test_rules_and_propagation(spark):
    got = same(spark, linked_pages(150, 3) + ODD)
    methods = {r[4] for r in got if r[3] is None}
    assert methods == {"allow", "block"}  # links decide both ways


def test_sql_on_pages_with_links(spark):
    rows = linked_pages(150, 5) + ODD
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    rel = con.sql(oracle.oracle_sql()["op11_link_graph_filter"])
    order = [rel.columns.index(c) for c in ("page_id", "host", "path", "rule", "verdict", "trust", "distrust")]
    assert sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr) == plain(rows, queries.RULES)


def test_equal_rules_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(urls, "HUB", 3)
    rules = [urls.Rule("allow", "a.com", "/"), urls.Rule("block", "a.com", "/"), urls.Rule("allow", "hub.net", "")]
    rows = [(i, f"http://h{i}.net/", "<a href='//hub.net/'><a href='//a.com/'>") for i in range(12)]
    rows += [(50, "http://hub.net/x", "".join(f"<a href='//h{i}.net/'>" for i in range(12))), (51, "http://a.com/", None)]
    same(spark, rows, rules)


@pytest.mark.parametrize("rows", [[], [(1, None, "x" * 100)]])
def test_no_pages_or_no_urls(spark, rows):
    same(spark, rows)


def test_very_long_page(spark):
    html = "<a x='" + "y" * 200_000 + "' href='//long.net/'>" + "<a " * 20_000 + "href" * 1000
    same(spark, [(1, "http://b.com/de/", html), (2, "http://long.net/", "")])
