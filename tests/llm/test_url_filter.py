import random
import re

import pytest

from slotline.llm import url_filter as uf


def regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 2] == "**":
            out, i = out + "(?s:.*)", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return re.compile(out.encode(), re.S)


def brute(url, rules):
    best = -1
    for k in sorted(range(len(rules)), key=lambda k: (not rules[k].stated, -len(rules[k].name))):
        if any(regex(g).fullmatch(url) for g in rules[k].globs):
            best = k
            break
    return best


@pytest.mark.parametrize("seed", range(5))
def test_automaton_equals_regex(seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("ab./") for _ in range(rng.randrange(n)))
    rules = tuple(uf.Rule("block", part(5) + str(k), tuple("".join(rng.choice(["a", "b", ".", "/", "*", "**", "?"]) for _ in range(rng.randrange(1, 9))) for _ in range(3)), rng.random() < 0.5) for k in range(12))
    urls = [part(12).encode() for _ in range(300)]
    assert uf.Automaton(rules).run(urls).tolist() == [brute(u, rules) for u in urls]


def test_production_rules():
    urls = ["net/", "a.net/x", "net", "xnet/", "example.net/en/1", "m.example.net/en", "example.com/de/", "a.example.com/de/x", "x.org/fr/", "org/fr", "spam-farm.example.org/en/1", "spam-farm.example.org", "a.com/spam-b.c/", "a.com/x.net/", "cheap-x.example.org/fr/2"]
    got = uf.Automaton(uf.RULES).run([u.encode() for u in urls]).tolist()
    assert got == [brute(u.encode(), uf.RULES) for u in urls]
    names = [uf.RULES[k].name if k >= 0 else None for k in got]
    assert names == ["net/", "net/", None, None, "example.net/en/", "net/", "example.com/de/", "example.com/de/", "org/fr/", None, "spam-*", "spam-*", None, None, "org/fr/"]


def test_rules_of_a_table(spark):
    rows = [(r.verdict, r.name, list(r.globs), r.stated) for r in uf.RULES]
    odd = [("block", "none", None, True), (None, "x", [None, "x.com**"], None), ("allow", None, ["**"], True), ("allow", "empty", [], True)]
    rules = spark.createDataFrame(rows + odd, "verdict string, name string, globs array<string>, stated boolean")
    got = uf.rules_of(rules)
    assert sorted(got, key=lambda r: r.name) == sorted([*uf.RULES, uf.Rule("block", "x", ("x.com**",))], key=lambda r: r.name)
    pages = spark.createDataFrame([(1, "http://x.com/a"), (2, "http://a.net/"), (3, "http://spam-x.org/")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.rule, r.glob_rule) for r in uf.judge(pages, got).collect()} == {1: ("block", None, "x"), 2: ("block", "net/", None), 3: ("block", None, "spam-*")}
    assert uf.rules_of(rules.limit(0)) == ()
    with pytest.raises(ValueError):
        uf.rules_of(rules, most=3)


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://EXAMPLE.net/EN/?q"), (6, "x://a://b/c#d"), (7, "http://é.NET/" + "y" * 20_000), (8, "http://a.net?x/y"), (None, "http://a.org/fr/")]
    df = spark.createDataFrame([(*r, "h", "p", "v") for r in rows], "page_id long, url string, host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge(df).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("example.net", "/EN/", "net/", "block") and got[6] == ("a:", "//b/c", None, "allow")
    assert got[7][2] == "net/" and got[8] == ("a.net", "", None, "allow") and got[None][2] == "org/fr/"
    assert uf.judge(df.limit(0)).count() == 0


def test_groups_of_urls(monkeypatch):
    """However few words a group's state may hold, the winners are the same; many rules need many words."""
    rules = uf.RULES + tuple(uf.site_rule("block", f"host{k}.com/") for k in range(600))
    urls = [f"host{k}.com/x{k}".encode() for k in range(0, 700, 7)] + [b"spam-x.org", b"a.net/", b"", b"org/fr/1"]
    automaton = uf.Automaton(rules)
    want = automaton.run(urls).tolist()
    assert automaton.words > 100 and want == [brute(u, rules) for u in urls]
    for state in (1, 3 * automaton.words, 10**9):
        monkeypatch.setattr(uf, "STATE", state)
        assert automaton.run(urls).tolist() == want
    assert automaton.run([]).tolist() == [] and uf.Automaton(()).run([b"x"]).tolist() == [-1]
