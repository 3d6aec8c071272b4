import random
import re

from citeloom.llm import url_templates as ut

SCHEMA = "page_id long, url string, host string, names string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def brute(urls, labels):
    """{(host, path): (template, purity)} by one tree in memory."""
    paths = sorted({parts(u) for u in urls})
    segs = {p: (p[1].split("/")[1:] if p[1].startswith("/") else []) for p in paths}
    segs = {p: s if len(s) <= ut.DEPTH else s[: ut.DEPTH - 1] + ["/".join(s[ut.DEPTH - 1 :])] for p, s in segs.items()}
    names = {p: () for p in paths}
    for level in range(max(map(len, segs.values()), default=0)):
        kids = {}
        for p in paths:
            if len(segs[p]) > level:
                own = kids.setdefault((p[0], names[p]), {})
                own[segs[p][level]] = own.get(segs[p][level], 0) + 1
        before = dict(names)
        for p in paths:
            if len(segs[p]) > level:
                own, s = kids[p[0], before[p]], segs[p][level]
                known = own[s] >= ut.LEAST and own[s] >= sum(own.values()) * ut.SHARE
                ending = re.search(r"\.[A-Za-z]{1,5}$", s)
                names[p] = before[p] + (s if known or s == "" else "*" + (ending.group() if ending else ""),)
    counts = {}
    for p in paths:
        c = counts.setdefault((p[0], names[p]), [0, 0])
        m = re.search(r"([0-9]+)[^0-9/]*/?$", p[1])
        if m and int(m.group(1)) in labels:
            c[labels[int(m.group(1))]] += 1
    merged = {k: k[1] for k in counts}
    for level in range(max((len(k[1]) for k in counts), default=0), 0, -1):
        branch = {}
        for k, name in merged.items():
            if len(name) >= level:
                b = branch.setdefault((k[0], name[: level - 1]), {}).setdefault(name[level - 1], [0, 0, set()])
                b[0], b[1] = b[0] + counts[k][0], b[1] + counts[k][1]
                b[2].add(name[level:])
        new = {}
        for (host, above), own in branch.items():
            kinds = {}
            for name in sorted(own):
                kinds.setdefault(frozenset(own[name][2]), []).append(name)
            for same in kinds.values():
                groups = ut.similar([own[n][0] for n in same], [own[n][1] for n in same])
                for g in set(groups):
                    together = [n for n, h in zip(same, groups) if h == g]
                    for n in together:
                        new[host, above, n] = n if len(together) == 1 else "{" + ",".join(together) + "}"
        merged = {k: n if len(n) < level else n[: level - 1] + (new[k[0], n[: level - 1], n[level - 1]],) + n[level:] for k, n in merged.items()}
    total = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    base = total[1] / sum(total) if sum(total) else 0.0
    out = {}
    for p in paths:
        of_host = [c for k, c in counts.items() if k[0] == p[0]]
        prior = (sum(c[1] for c in of_host) + ut.WEIGHT * base) / (sum(map(sum, of_host)) + ut.WEIGHT)
        own = [c for k, c in counts.items() if k[0] == p[0] and merged[k] == merged[p[0], names[p]]]
        share = (sum(c[1] for c in own) + ut.WEIGHT * prior) / (sum(map(sum, own)) + ut.WEIGHT)
        out[p] = ("/" + "/".join(merged[p[0], names[p]]), share)
    return out


def corpus(n=900):
    rng, rows = random.Random(3), []
    for i in range(n):
        host = rng.choice(["a.example.com", "WWW.B.Example.org", "c.io", "d.example.net", "c.io", "c.io"])
        kind = rng.choice(["news", "tag", "shop", "blog"])
        rows.append((i, f"https://{host}/{kind}/{rng.randrange(5000)}{rng.choice(['', '/', '.html', '?q=1', '#x', '/edit'])}"))
    labels = {j: int(j % 10 < (9 if j % 3 == 0 else 1)) for j in range(0, 5000, 2)}
    return rows, labels


def test_against_brute_force(make):
    rows, labels = corpus()
    rows += [(None, "http://c.io"), (1, None), (2, "no scheme/x"), (3, "http://c.io/"), (3, "http://c.io/"), (4, "x://a.b://c/d//e"), (5, "http://c.io/1/2/3/4/5/6/7/8/9"),
             (6, "http://c.io?x=/y"), (7, "http://c.io/" + "a" * 20000), (8, "http://c.io/news/99999999999999999999999")]
    marks = make([(k, v, "x") for k, v in labels.items()] + [(None, 1, "x"), (2, None, "x")], "number long, bad int, host string")
    got = ut.judge(make([(*r, "x", "y") for r in rows], SCHEMA), marks).collect()
    want = brute([r[1] for r in rows], labels)
    assert len(got) == len(rows)
    assert sorted(((r.page_id, r.host, r.path) for r in got), key=repr) == sorted(((r[0], *parts(r[1])) for r in rows), key=repr)
    for r in got:
        template, share = want[r.host, r.path]
        assert r.template == template and abs(r.purity - share) < 1e-9
        if r.rule is None:
            assert r.verdict == ("block" if share >= ut.REJECT else "allow")


def test_bad_templates_are_rejected(make):
    rows = [(i, f"http://h.io/{'spam' if i % 2 else 'good'}/{i}") for i in range(200)]
    marks = make([(i, i % 2) for i in range(200)], "number long, bad int")
    got = ut.judge(make([(*r, "x", "y") for r in rows], SCHEMA), marks).collect()
    assert all(r.verdict == ("block" if "/spam/" in r.path else "allow") and r.template in ("/spam/*", "/good/*") for r in got)


def test_rules_and_empty(make):
    cases = {
        "http://example.net/en/1": "example.net/en/", "http://a.example.net/en/": "example.net/en/", "http://a.example.net/en": "net/", "http://net/": "net/",
        "http://xnet/": None, "http://a.net": None, "http://EXAMPLE.com/de/x": "example.com/de/", "http://badexample.com/de/x": None, "http://x.org/fr/": "org/fr/", "http://org.x/fr/": None,
    }
    none = make([], "number long, bad int")
    got = {r.page_id: r for r in ut.judge(make([(i, u, "x", "y") for i, u in enumerate(cases)], SCHEMA), none).collect()}
    for i, rule in enumerate(cases.values()):
        assert got[i].rule == rule
        assert got[i].verdict == ("block" if rule in ("net/", "example.com/de/") else "allow")
    assert ut.judge(make([], SCHEMA), none).count() == 0
