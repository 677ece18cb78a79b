"""URL functions: expected values, and resolution against the standard library."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.functions.text import collapse, level_slug, strip, title_case

# url: normalized, label
NORMALIZED = {
    "http://A.com": ("https://a.com/", ""),
    "http://a.com/x//": ("https://a.com/x", "X"),
    "HTTP://u:p@A.com:80/x/?b=2&a=1&c=&d": ("https://u:p@a.com:80/x?a=1&b=2", "X"),
    "https://h/p;x=1": ("https://h/p", "P"),
    "mailto:Foo@x": ("mailto:Foo@x", "Foo@X"),
    "//h/x/": ("//h/x", "X"),
    "http://h/?a=1&a=0#f": ("https://h/?a=0&a=1", ""),
    "http://h?": ("https://h/", ""),
    "ftp://h/x/": ("ftp://h/x", "X"),
    "http://h/a;b/c;d": ("https://h/a;b/c", "C"),
    "http://h/o'neil-3d_x/ß-été": ("https://h/o'neil-3d_x/ß-été", "Ss Été"),
    "https://h/a?x=a b&y=é": ("https://h/a?x=a+b&y=%C3%A9", "A"),
}
# page, link: whether the link leads on, and its score
LINKED = [
    ("http://h/a", "http://h/a/b", True, 1.0),
    ("http://h/a", "http://h/ab", True, 0.3),
    ("http://h/a", "http://h/a", False, 0.3),
    ("http://h/a", "http://h/a?page=2", False, 0.3),
    ("http://h/a", "https://h/z", True, 0.3),
    ("http://h/a", "http://o/a/b", False, 0.0),
    ("http://h/a", "#f", False, 0.0),
    ("http://h/a", "mailto:a", False, 0.0),
    ("http://h/a", "javascript:1", False, 0.0),
    ("http://h/a", "tel:1", False, 0.0),
    ("http://h/a", "", False, 0.0),
    ("http://h/a/", "b", True, 0.0),
    ("https://H:8/x", "https://h:8/x/y", True, 1.0),
]
BASES = ["http://h/a/b/c?q=1#f", "http://h", "http://h/", "http://h/a/", "https://H:8/x;p/y", "http://h/a/../b/", "http://h/a//b", "", "mailto:x"]
LINKS = [
    "x", "/x", "//o/x", "?z", "#f", "../x", "../../x", "../../../../x", "./x", ".", "..", "./", "../", "http://o/a/../b", "https://h/z",
    "mailto:a", "javascript:1", "", "x//y", "/a//b/", "/a/./b/../c", "a?b=c#d", "x;p", "/x/y;p?", "tel:1", "x/..", "x/.", "//o", "/", "é/ü",
    "/:foo", "a:b", " x", "\tx\n", "?", "http:x", "http:/x", "ftp://h/x/", "?page=2", "http://h/a/#x", "http://h/a",
]


def test_normalize_and_label(spark):
    u = F.col("u")
    rows = spark.createDataFrame([(x,) for x in NORMALIZED], "u string").select(
        "u", U.normalize_url(u).alias("n"), U.normalize_url(U.normalize_url(u)).alias("nn"), U.url_label(u).alias("l")
    )
    for r in rows.collect():
        assert (r.n, r.l) == NORMALIZED[r.u], r.u
        assert r.nn == r.n


def test_resolve(spark):
    pairs = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "b string, l string")
    for r in pairs.select("b", "l", U.resolve_url(F.col("b"), F.col("l")).alias("r")).collect():
        assert r.r == urljoin(r.b, r.l), (r.b, r.l)


def test_valid_and_score(spark):
    b, x = F.col("b"), F.col("l")
    rows = spark.createDataFrame(LINKED, "b string, l string, valid boolean, score double")
    for r in rows.select("*", U.is_valid_drill_link(x, b).alias("v"), U.score_drill_link(b, x).alias("s")).collect():
        assert (r.v, r.s) == (r.valid, r.score), (r.b, r.l)


def test_quirks_and_nulls(spark):
    row = spark.range(1).select(
        U.is_valid_drill_link(F.lit("?page=2"), F.lit("https://h/a")).alias("pagination"),
        U.is_valid_drill_link(F.lit("https://h/a/#x"), F.lit("https://h/a")).alias("slash_before_cut"),
        U.normalize_url(F.lit(None).cast("string")).alias("n"),
        U.resolve_url(F.lit("http://h/"), F.lit(None).cast("string")).alias("r"),
        U.url_hash(F.lit("https://h/")).alias("h"),
        level_slug(F.lit("Détail  Page!")).alias("slug"),
        level_slug(F.lit("--")).alias("bare"),
        strip(F.lit("   a b \n")).alias("strip"),
        collapse(F.lit("a \n b")).alias("collapse"),
        title_case(F.lit("o'neil 3d ß")).alias("title"),
    ).first()
    assert (row.pagination, row.slash_before_cut, row.n, row.r) == (False, True, None, None)
    assert row.h == __import__("hashlib").md5(b"https://h/").hexdigest()[:12]
    assert (row.slug, row.bare, row.strip, row.collapse) == ("d_tail_page", "level", "a b", "a b")
    assert row.title == "o'neil 3d ß".title()
