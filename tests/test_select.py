"""Selectors: a table of cases, and random trees against brute force."""

import random

from siteloom.functions.selectors import is_supported
from siteloom.operators.select import select_many, select_one

HTML = (
    '<div id=d class="a b"><ul class=x><li>1<b>q</b></li><li class="md:flex k" data-v="Foo bar">2</li><li>3<span><i>z</i></span></li></ul>'
    '<p>t</p><p class=c>u</p></div><p>out</p><a type="X" href="/p">l</a><i lang="en-GB"></i>'
)
CASES = {
    "li": [3, 5, 6], "ul li": [3, 5, 6], "div > li": [], "ul > li": [3, 5, 6], "li + li": [5, 6], "li ~ li": [5, 6], "li:first-child": [3],
    "li:last-child": [6], "li:nth-child(2)": [5], "li:nth-child(odd)": [3, 6], "li:nth-child( 2n + 1 )": [3, 6], "li:nth-child(-n+2)": [3, 5],
    "li:nth-last-child(1)": [6], "p:nth-of-type(2)": [10], "p:first-of-type": [9, 11], "b:only-child": [4], "li:not(.k)": [3, 6],
    "li:not(.k, :first-child)": [6], r".md\:flex": [5], ".md:flex": [], "#d p": [9, 10], "#d > p.c": [10], "div p, a, p": [9, 10, 11, 12],
    "[data-v]": [5], '[data-v="Foo bar"]': [5], "[data-v='foo bar' i]": [5], "[data-v='foo bar']": [], "[data-v~=bar]": [5], "[data-v^=Foo]": [5],
    '[data-v$="bar"]': [5], '[data-v*="o b"]': [5], '[data-v*=""]': [], "[lang|=en]": [13], "li[data-v!=x]": [3, 5, 6], "a[type=x]": [12],
    "UL > LI": [3, 5, 6], "ul *": [3, 4, 5, 6, 7, 8], "div ul li span i": [8], "p ~ a": [12], "p:contains('out')": [11], "i:empty": [13],
    "div .x > li + li b, i": [8, 13], "ul>li:last-child i": [8], "> li": [], "": [], "li,": [], "p::before": [], "a:nth-child(x)": [],
    ":is(a)": [12], "li:has(b)": [3], "li:has(i)": [6], "li:has(> i)": [], "ul:has(> li > span > i)": [2], "li:has(+ li)": [3, 5], "li:has(~ li.k)": [3],
    ":is(ul, p) > :where(li, b)": [3, 5, 6], "li:not(ul > li + li)": [3], "li:not(:has(*))": [5], "*:has(> b, + a)": [3, 11], "div:has(.k ~ li i) > p": [9, 10],
    ":is(#d p, a):not(.c)": [9, 12], "li:has(b, span):not(:last-child)": [3], ":has(> [data-v=':has(x)'])": [], "a:link": [12], ":root": [],
    "li:not(:not(.k))": [5], "p:is(:is(.c), :has(q))": [10], "div:has(> ul:has(> li:nth-child(2).k))": [1], "li:matches(.k, :has(> b))": [3, 5],
    "li:has()": [], "li:is(> b)": [], "li:has(b": [], "li:is(a:foo)": [], "p, li:has(b), i": [3, 8, 9, 10, 11, 13],
}


def test_cases(docs_of):
    found = {}
    for r in select_many(docs_of(HTML), {s: s for s in CASES}).collect():
        found.setdefault(r.selector_id, []).append(r.node)
    assert {s: sorted(found.get(s, [])) for s in CASES} == CASES


def test_unsupported_are_told_apart(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s,) for s in CASES], "s string").select("s", is_supported(F.col("s")).alias("ok")).collect()
    bad = {r.s for r in rows if not r.ok}
    assert bad == {"> li", "", "li,", "p::before", "a:nth-child(x)", ".md:flex", "li:has()", "li:is(> b)", "li:has(b", "li:is(a:foo)"}


def _random_html(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 3)):
        tag = rng.choice(["div", "p", "span"])
        out += f'<{tag} class="{rng.choice(["u", "v", "u v", ""])}">' + (_random_html(rng, depth + 1) if depth < 4 else "") + f"</{tag}>"
    return out


def _brute(elems, parts):
    """Nodes that match ``[(combinator, tag, class)]`` by looking at all pairs."""
    fits = lambda n, tag, cls: n > 0 and tag in ("*", elems[n].tag) and (not cls or cls in elems[n].classes)
    alive = {n for n in range(len(elems)) if fits(n, *parts[0][1:])}
    for comb, tag, cls in parts[1:]:
        related = {
            " ": lambda a, b: a < b <= elems[a].last,
            ">": lambda a, b: elems[b].parent == a,
            "+": lambda a, b: elems[b].prev == a,
            "~": lambda a, b: a < b and elems[a].parent == elems[b].parent,
        }[comb]
        alive = {b for b in range(len(elems)) if fits(b, tag, cls) and any(related(a, b) for a in alive)}
    return sorted(alive)


def test_random_trees_against_brute_force(docs_of):
    rng = random.Random(7)
    docs = docs_of(*[_random_html(rng) for _ in range(12)])
    chains = []
    for _ in range(25):
        parts = [("", rng.choice(["div", "p", "*"]), rng.choice(["u", "v", ""]))]
        for _ in range(rng.randint(1, 3)):
            parts.append((rng.choice([" ", ">", "+", "~"]), rng.choice(["div", "p", "span", "*"]), rng.choice(["u", "v", ""])))
        chains.append(parts)
    text = lambda parts: "".join(f"{c if c in ('', ' ') else f' {c} '}{t}{'.' + k if k else ''}" for c, t, k in parts)
    found = {}
    for r in select_many(docs, {str(i): text(p) for i, p in enumerate(chains)}).collect():
        found.setdefault((r.page_id, r.selector_id), []).append(r.node)
    for d in docs.collect():
        for i, parts in enumerate(chains):
            assert sorted(found.get((d.page_id, str(i)), [])) == _brute(d.elems, parts), text(parts)


def test_first_match_inside_scope(docs_of):
    html = "<div><p>a</p><div><p>b</p></div></div><div></div><p>c</p>"
    rows = select_one(docs_of(html), "div", "p").orderBy("node").collect()
    assert [(r.node, r.hit and r.hit.node) for r in rows] == [(1, 2), (3, 4), (5, None)]


class _Nested:
    """Random selectors with nested lists, and what they match by definition: by recursion over all elements."""

    RELATED = {
        " ": lambda e, a, b: a < b <= e[a].last,
        ">": lambda e, a, b: e[b].parent == a,
        "+": lambda e, a, b: e[b].prev == a,
        "~": lambda e, a, b: a < b and e[a].parent == e[b].parent,
    }

    def __init__(self, rng):
        self.rng = rng

    def compound(self, depth):
        lists = []
        for _ in range(self.rng.choice([0, 1, 1, 2]) if depth else 0):
            kind = self.rng.choice(["is", "not", "has", "where"])
            lists.append((kind, [self.chain(depth - 1, kind == "has") for _ in range(self.rng.randint(1, 2))]))
        return self.rng.choice(["div", "p", "span", "*"]), self.rng.choice(["u", "v", "", ""]), lists

    def chain(self, depth, relative=False):
        lead = self.rng.choice([" ", ">", "+", "~"]) if relative else ""
        return [(lead if not i else self.rng.choice([" ", ">", "+", "~"]), self.compound(depth)) for i in range(self.rng.randint(1, 2))]

    def text(self, chain):
        out = ""
        for i, (sign, (tag, cls, lists)) in enumerate(chain):
            out += (f" {sign} " if sign != " " else " " if i else "") if sign else ""
            out += tag + (f".{cls}" if cls else "") + "".join(f":{k}({', '.join(self.text(c) for c in cs)})" for k, cs in lists)
        return out.strip() if chain[0][0] in ("", " ") else out

    def fits(self, e, n, compound):
        tag, cls, lists = compound
        if n == 0 or tag not in ("*", e[n].tag) or (cls and cls not in e[n].classes):
            return False
        some = lambda k, cs: any(self.below(e, n, c) if k == "has" else self.holds(e, n, c) for c in cs)
        return all(some(k, cs) != (k == "not") for k, cs in lists)

    def holds(self, e, n, chain):
        sign, compound = chain[-1]
        if not self.fits(e, n, compound):
            return False
        return len(chain) == 1 or any(self.RELATED[sign](e, m, n) and self.holds(e, m, chain[:-1]) for m in range(1, len(e)))

    def below(self, e, n, chain):
        sign, compound = chain[0]
        return any(
            self.RELATED[sign](e, n, m) and self.fits(e, m, compound) and (len(chain) == 1 or self.below(e, m, chain[1:])) for m in range(1, len(e))
        )


def test_nested_lists_against_a_recursive_matcher(docs_of):
    rng = random.Random(11)
    docs, made = docs_of(*[_random_html(rng) for _ in range(6)]), _Nested(rng)
    chains = [made.chain(rng.randint(1, 2)) for _ in range(40)]
    found = {}
    for r in select_many(docs, {str(i): made.text(c) for i, c in enumerate(chains)}).collect():
        found.setdefault((r.page_id, r.selector_id), []).append(r.node)
    some = 0
    for d in docs.collect():
        for i, chain in enumerate(chains):
            want = [n for n in range(1, len(d.elems)) if made.holds(d.elems, n, chain)]
            some += bool(want)
            assert sorted(found.get((d.page_id, str(i)), [])) == want, made.text(chain)
    assert some > 60


def test_nested_lists_about_an_element_make_no_candidates_elsewhere(docs_of):
    from siteloom.operators.select import candidates, literal_steps

    docs = docs_of("<div class=x><a>1</a></div><div class=x></div>" + "<p>q</p>" * 100)
    for selector, n in ((".x:is(:has(a), b)", 1), ("body, .x:is(:not(:has(a)), i)", 1), (":is(div:has(a), u)", 1)):
        steps, *_, depth = literal_steps((selector,))
        assert depth > 0 and candidates(docs.withColumn("steps", steps), ["page_id"], depth=depth).count() < 12
        assert select_many(docs, {"s": selector}).count() == n
