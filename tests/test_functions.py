"""One-row fixtures for the expressions."""

from __future__ import annotations

import html
from html.entities import html5

import duckdb
import pytest
from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.scalars import unescape_sql
from confluo.functions import labels as L
from confluo.functions import predicates as P
from confluo.functions import text as T

c = F.col


def values(spark, rows, schema, **exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(k) for k, e in exprs.items()]).orderBy("i").collect()]


def one(spark, inputs, fn):
    return [r[0] for r in values(spark, [(x,) for x in inputs], "x string", y=fn(c("x")))]


def test_norm_title(spark):
    got = one(
        spark,
        ["Sr Engineer", "SWE", "Eng Manager", "Software Engineer (Backend)", "Full-Stack Engineer", "Engenheiro Sênior", ""],
        T.norm_title,
    )
    assert got == [
        "senior engineer", "software engineer", "engineer manager", "software engineer backend",
        "full-stack engineer", "engenheiro senior", "",
    ]


def test_norm_company(spark):
    names = ["Stripe, Inc.", "OpenAI LLC", "  Acme  Corp  ", "Example GmbH", "Inc", "Foo-Inc", "A Company Co"]
    assert one(spark, names, T.norm_company) == ["stripe", "openai", "acme", "example", "inc", "foo-inc", "a company"]
    assert one(spark, ["Meta Inc"], lambda x: T.norm_company(x, aliases={"meta": "facebook"})) == ["facebook"]


def test_norm_location(spark):
    places = ["SF", "Bay Area", "San Francisco CA", "NYC", "DC", "WFH", "Anywhere", "Portland OR"]
    assert one(spark, places, T.norm_location) == [
        "san francisco", "san francisco", "san francisco", "new york", "washington", "remote", "remote", "portland or",
    ]


def test_canonical_key_and_accents(spark):
    rows = [("Senior Engineer", "Stripe Inc", "Remote"), ("", "", ""), (None, None, None), ("Müller ß", "Ø Ltd", "Ñandú")]
    key = T.canonical_key(c("t"), c("co"), c("l"))
    assert [v[0] for v in values(spark, rows, "t string, co string, l string", k=key)] == [
        "senior engineer|stripe|remote", "||", "||", "muller|ltd|nandu",
    ]


def test_url_functions(spark):
    assert one(spark, [" HTTPS://X.com/A/ ", "https://x.com//"], T.norm_url) == ["https://x.com/a", "https://x.com/"]
    assert one(spark, ["https://www.foo-bar.io", "https://app.acme.com", "acme.com", "", "localhost"], T.url_domain_stem) == [
        "foo-bar", "acme", "acme", None, "localhost",
    ]
    assert one(spark, ["/jobs/123-x", "/x", None], T.url_numeric_id) == ["123", "", ""]
    slugs = values(spark, [("Scale AI", "https://scale.com"), ("", "")], "n string, w string", s=T.slug_candidates(c("n"), c("w")))
    assert [s[0] for s in slugs] == [["scaleai", "scale-ai", "scale"], []]


def test_remote_and_job_type(spark):
    assert one(spark, ["Remote - US", "remotely", None, "Paris"], T.remote_flag) == [True, False, None, False]
    assert one(spark, ["Part-time", "Contractor", "Intern", "Full", "", None], T.job_type_map) == [
        "part_time", "contract", "contract", "full_time", None, None,
    ]


def test_character_references_resolve_as_in_the_standard_library(spark):
    names = [f"&{n}" for n in html5]
    numbers = [f"&#{n};" for n in (0, 1, 9, 13, 38, 127, 128, 129, 150, 159, 160, 255, 256, 55296, 57343, 64976, 65533, 65534, 65535, 128512, 131070, 1114109, 1114111, 1114112, 10**12, 10**30)]
    others = [
        None, "", "&", "&;", "&#;", "&#x;", "a&b", "&amp", "&ampx", "&notit;", "&notin;", "&NotEqualTilde;", "&copycat &copy", "&frac123;", "&#38", "&#x26x", "&#X1F600;", "&#xZ", "&#000000000065;",
        "&#x0000000000041;", "&#xfffffffffffffffffff;", "&amp;lt;", "&lt&gt;&quot", "é&日本;🎉&hearts;", "x" * 50 + "&" + "y" * 40 + ";", "&&amp;&", "&thinspace;&notanentityatall;&nbsp ", "&a\tb;", "&<b>",
    ]
    texts = [*names, *[n[:-1] for n in names if n.endswith(";")], *[n + "z" for n in names], *numbers, *others]
    want = [None if t is None else html.unescape(t) for t in texts]
    assert one(spark, texts, T.html_unescape) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts[-len(others) - len(numbers) :])))
    got = [r[0] for r in con.execute(f"SELECT {unescape_sql('x')} FROM t ORDER BY i").fetchall()]
    assert got == want[-len(got) :]
    plan = spark.createDataFrame([("&amp;",)], "x string").select(T.html_strip(c("x")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_html_strip(spark):
    text = "a &lt;b&gt; &amp;lt; &#x27;q&#x27;<p>line<i>x</i> "
    assert one(spark, [text], T.html_strip) == ["a  &lt; 'q'\nlinex"]
    assert one(spark, ["&eacute;&hearts;<b>"], lambda x: T.html_strip(x, full_entities=True)) == ["é♥"]
    assert one(spark, ["<li class=a>x</li>y<br/>z</p>"], lambda x: T.html_strip(x, mode="post")) == ["\nxy\nz\n"]


def test_ts_coerce(spark):
    got = one(spark, ["2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00Z", "soon", None], T.ts_coerce)
    assert [str(x) if x else x for x in got] == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None]


def test_place_to_text(spark):
    texts = [
        '"Oslo"', '{"address":{"addressLocality":"Oslo","addressCountry":"NO"}}', '{"name":"HQ"}',
        '[{"address":{"addressLocality":"Rome"}},{"name":"x"}]', "[]", '""',
    ]
    assert one(spark, texts, lambda x: T.place_to_text(F.try_parse_json(x))) == ["Oslo", "Oslo, NO", "HQ", "Rome", None, None]


LADDER = [
    ("applied and later got an offer", "applied"), ("We reapplied the patch to production", None),
    ("RECRUITER CALL tomorrow", "phone_screen"), ("final round", "interview"), ("they offered", "offer"),
    ("passed on me", "rejected"), ("withdrawn", "withdrew"), ("", None), ("  ", None),
]


def test_regex_ladder(spark):
    assert one(spark, [t for t, _ in LADDER], L.regex_ladder) == [label for _, label in LADDER]


TITLES = [
    ("Founding FDE @ CiceroAI", r"\bfde\b"), ("OFDE Engineer", None), ("Solution Engineer", r"\bsolutions? engineer\b"),
    ("Fullstack Engineer", r"\bfull[- ]?stack engineer\b"), ("GTM Engineer", None), ("Forward Deployed Engineer", r"\bforward deployed\b"),
]


def test_first_pattern(spark):
    assert one(spark, [t for t, _ in TITLES], P.first_pattern_title) == [p for _, p in TITLES]
    rows = [("GTM Engineer", "Europe only"), ("x", "EU"), ("x", "based in Canada"), ("x", "UK & Ireland"), ("LatAm lead", None)]
    got = values(spark, rows, "t string, l string", p=P.first_pattern_title_location(c("t"), c("l")))
    assert [g[0] for g in got] == [r"\beurope[- ]?only\b", None, None, r"\buk\s*&\s*ireland\b", r"\blatam\b"]


def test_whitelist_and_remote(spark):
    assert one(spark, ["VERCEL", "Vercel Inc", "", None], P.whitelist_exact) == [True, False, False, False]
    rows = [(True, "Hybrid"), (None, "Remote, hybrid"), (False, "Anywhere"), (None, ""), (None, None)]
    got = values(spark, rows, "r boolean, l string", g=P.remote_gate(c("r"), c("l")))
    assert [g[0] for g in got] == [True, False, True, False, False]


def test_geo_and_curated(spark):
    rows = [("Duke lead", "x", "", True), ("a", "industry", "", False), ("a", "Oslo", "zz", True), ("a", "Oslo", "zz", None)]
    gate = P.geo_gate(c("t"), c("l"), c("d"), c("r"))
    assert [v[0] for v in values(spark, rows, "t string, l string, d string, r boolean", g=gate)] == [False, True, True, False]
    strict = P.geo_gate(c("t"), c("l"), c("d"), c("r"), whole_words=True)
    assert [v[0] for v in values(spark, rows, "t string, l string, d string, r boolean", g=strict)] == [True, False, True, False]
    assert one(spark, ["Senior GTM Engineer II", "gtm", "", "nurse"], P.curated_title_hit) == [True, True, True, False]


@pytest.mark.parametrize(
    ("score", "title", "company", "location", "remote", "want"),
    [
        (0.5, "GTM Engineer", "A", "Remote", True, "promoted"),
        (0.5, "GTM Engineer", "A", "SF", False, "shortlisted"),
        (0.1, "GTM Engineer", "A", "Remote", True, "rejected"),
        (0.2, "GTM Engineer", "A", "Remote", True, "promoted"),
        (0.9, "FDE, LatAm", "A", "Remote", True, "rejected_title"),
        (0.9, "GTM", "A", "LatAm", True, "rejected_geo"),
        (0.9, "GTM", "Vercel", "SF", False, "promoted_whitelist_remote"),
        (0.9, "GTM", "Vercel", "Remote", False, "promoted"),
    ],
)
def test_decide(spark, score, title, company, location, remote, want):
    decision, _ = P.decide(c("s"), c("t"), c("co"), c("l"), c("r"))
    rows = [(score, title, company, location, remote)]
    assert values(spark, rows, "s double, t string, co string, l string, r boolean", d=decision) == [(want,)]


def test_blurb_and_media(spark):
    rows = [("Founding GTM Engineer", "Suno", "We use Python, ETL and AI agents", True, "tier_1"), ("X", "Y", None, False, None)]
    text = L.blurb(c("t"), c("co"), c("d"), matched=c("m"), tier=c("p"))
    first, second = (v[0] for v in values(spark, rows, "t string, co string, d string, m boolean, p string", b=text))
    assert "(tier_1 reference company)" in first and "founding" in first and "Python, ETL, AI agents" in first
    assert second.startswith("X at Y aligns") and D.ROLE_PHRASE_DEFAULT in second and "overlap" not in second
    heads = [bytes.fromhex(h) for h in ("89504e470d0a1a0a", "ffd8ff00", "474946383961", "524946460000000057454250", "00")]
    got = values(spark, [(h,) for h in heads], "b binary", m=L.media_sniff(c("b")))
    assert [g[0] for g in got] == ["image/png", "image/jpeg", "image/gif", "image/webp", "image/jpeg"]
