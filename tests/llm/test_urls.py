"""Redirect equivalence on random link graphs against union-find, and against the registered SQL."""

import random

from watchloom.llm import oracle
from watchloom.llm import queries as Q
from watchloom.llm.url_equivalence import judge_urls

HOSTS = ["a.com", "b.example.net", "c.org", "example.com", "d.io", "sub.e.net"]
PATHS = ["/", "/en/x", "/de/y", "/fr/z", "/p/q?r=1", "/p/"]


def _pages(seed):
    rnd = random.Random(seed)
    pages = []
    for i in range(300):
        host, path = rnd.choice(HOSTS), rnd.choice(PATHS) + rnd.choice(["", str(rnd.randrange(40))])
        to_host, to_path = rnd.choice(HOSTS), rnd.choice(PATHS) + str(rnd.randrange(40))
        form = rnd.choice(["abs", "proto", "root", "query", "rel", "none", "none", "none", "bad"])
        folder = path.split("?")[0].rsplit("/", 1)[0] + "/"
        target, absolute = {
            "abs": (f"https://{to_host.upper()}{to_path}#f", to_host + to_path),
            "proto": (f"//{to_host}{to_path}", to_host + to_path),
            "root": (to_path, host + to_path),
            "query": (f"?k={i % 7}", host + path.split("?")[0] + f"?k={i % 7}"),
            "rel": (f"./n{i % 9}", host + folder + f"n{i % 9}"),
            "none": (None, None),
            "bad": (rnd.choice(["#top", "mailto:x@y.z", "../up", "javascript:void(0)"]), None),
        }[form]
        tag = rnd.choice(["<link rel='canonical' href='{}'>", '<META http-equiv=refresh content="0; url={}">'])
        other = rnd.choice(["", "<link rel=stylesheet href=/x.css>"])
        pages.append((i, f"http://{host}{path}", None if target is None and i % 2 else other + (tag.format(target) if target else "") * rnd.choice([1, 2]), host + path, absolute))
    # a second canonical link of one page counts as well
    pages.append((900, "http://two.com/", "<link rel=canonical href=//x1.com/><link rel=canonical href=//x2.com/>", "two.com/", "x1.com/"))
    pages += [(901, "http://x2.com/", '<link rel="canonical" href="http://blocked.net/">', "x2.com/", "blocked.net/"), (902, None, "<link rel=canonical href=//x1.com/>", None, None), (903, "no scheme", "", None, None)]
    return pages + pages[:3]


def _rule(key):
    host, _, path = key.partition("/")
    path = "/" + path.split("?")[0]
    best = None
    for r in Q.URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def _wanted(pages):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, _, _, u, v in pages:
        if u and v and u != v:
            parent[find(u)] = find(v)
    find("two.com/")
    parent[find("two.com/")] = find("x2.com/")
    blocked = {find(x) for x in list(parent) if (r := _rule(x)) and r.verdict == "block"}
    out = []
    for i, _, _, u, _ in pages:
        r = _rule(u) if u else None
        out.append((i, r.name if r else None, r.verdict if r else "block" if u in parent and find(u) in blocked else "allow"))
    return sorted(out, key=str)


def test_random_graphs(spark):
    import duckdb
    import pandas as pd

    for seed in (1, 2):
        pages = _pages(seed)
        want = _wanted(pages)
        rows = [p[:3] for p in pages]
        got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), Q.URL_RULES).collect()
        assert sorted(((r["page_id"], r["rule"], r["verdict"]) for r in got), key=str) == want
        assert {w[2] for w in want if w[1] is None} == {"allow", "block"}
        con = duckdb.connect()
        con.register("frame", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
        con.sql("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM frame")
        sql = con.sql(oracle.oracle_sql()["op4_url_filter"])
        told = [dict(zip(sql.columns, r)) for r in sql.fetchall()]
        assert sorted(((r["page_id"], r["rule"], r["verdict"], r["component"]) for r in told), key=str) == sorted(((r["page_id"], r["rule"], r["verdict"], r["component"]) for r in got), key=str)
