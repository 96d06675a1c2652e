"""The whole judgement of URLs against a plain version: seeds from pages, links from html, both propagations, the threshold."""

import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import urlrank

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [(r, says) for says, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def ranks(seeds, links, hosts):
    """The stationary scores by the definition: what hosts without links hold goes back to the seeds."""
    at = {h: k for k, h in enumerate(hosts)}
    if not seeds:
        return dict.fromkeys(hosts, 0.0)
    start = np.zeros(len(hosts))
    for h, n in seeds.items():
        start[at[h]] = n / sum(seeds.values())
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    rank = start
    for _ in range(3000):
        moved = np.zeros(len(hosts))
        for (a, b), n in links.items():
            moved[at[b]] += 0.85 * rank[at[a]] * n / out[a]
        rank = moved + (1 - moved.sum()) * start
    return {h: rank[at[h]] for h in hosts}


def judged(pages):
    seeds, links = {"allow": Counter(), "block": Counter()}, Counter()
    for _, url, html in pages:
        host, path = parts(url)
        if (says := rule_of(host, path)[1]) is not None:
            seeds[says][host] += 1
        for to in re.findall(r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)", html or ""):
            to = re.sub("[A-Z]", lambda m: m[0].lower(), to)
            if host and host != to:
                links[host, to] += 1
    hosts = sorted({parts(u)[0] for _, u, _ in pages} | {h for pair in links for h in pair})
    trust, distrust = ranks(seeds["allow"], links, hosts), ranks(seeds["block"], Counter({(b, a): n for (a, b), n in links.items()}), hosts)
    out = []
    for page_id, url, _ in pages:
        host, path = parts(url)
        rule, says = rule_of(host, path)
        method = "block" if distrust[host] > trust[host] * (1 + 1e-6) else "allow"
        out.append((page_id, host, path, rule, says or method, trust[host], distrust[host]))
    return out


def link(*hosts):
    return " ".join(f'<a HREF="https://{h}/x">' for h in hosts)


CHAIN = [f"c{k}.com" for k in range(40)]
SHUN = [f"s{k}.com" for k in range(30)]
PAGES = [
    (1, "http://good.org/fr/a", link(CHAIN[0], "Mixed.COM:80", "u@mixed.com")), (2, "http://bad.net/", link("mixed.com:80")), (3, "http://mixed.com:80/", link("bad.net", "good.org")),
    (4, "http://lone.com/", None), (5, None, link("good.org")), (6, "no scheme", link("bad.net")), (7, "http://bad.net/", link("bad.net")), (7, "http://bad.net/", link("bad.net")),
    (8, "http://x.example.com/de/1", "<a href='//mixed.com:80'> <a href=http://tail.com>"), (9, "http://tail.com", "<a href='/relative'>"), (None, "http://good.org/fr/b", ""),
    *[(100 + k, f"http://{h}/", link(CHAIN[k + 1]) if k + 1 < len(CHAIN) else "") for k, h in enumerate(CHAIN)],
    *[(200 + k, f"http://{h}/", link(SHUN[k + 1] if k + 1 < len(SHUN) else "bad.net")) for k, h in enumerate(SHUN)],
]


@pytest.mark.parametrize("pages", [PAGES, PAGES[3:5]])
def test_judge(spark, pages):
    rows = spark.createDataFrame([(*p, "clash", 1.0) for p in pages], "page_id long, url string, html string, host string, trust double")
    found = [tuple(r) for r in urlrank.judge(rows, RULES).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    expected = sorted(judged(pages), key=order)
    found = sorted(found, key=order)
    assert [x[:5] for x in found] == [x[:5] for x in expected]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in expected], rtol=1e-5, atol=0)
    by_id = {x[0]: x for x in found}
    if 139 in by_id:
        assert by_id[139][5] > 0  # 40 links from the trusted seed
        assert by_id[200][4] == "block"  # 30 links before the blocked one


def test_rings_end(spark):
    edges = spark.createDataFrame([("allow", "a", "b", 1.0), ("allow", "b", "a", 1.0)], "kind string, source string, target string, share double")
    seeds = spark.createDataFrame([("allow", "a", 1.0)], "kind string, host string, seed double")
    found = {r["host"]: r["score"] for r in urlrank.propagate(edges, seeds, 0.85).collect()}
    assert np.allclose([found["a"], found["b"]], [1 / 1.85, 0.85 / 1.85], rtol=1e-5)
