"""Projection operators."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from confluo import defaults as D
from confluo.checks.registry import (
    any_in, any_match, case, lit, mapped, matches, norm_base, query, strip, table,
)
from confluo.checks.views import DOCS, POSTINGS, docs, postings
from confluo.functions import entities as E
from confluo.functions import labels as L
from confluo.functions import text as T

c = F.col


def norm_title_sql(x: str) -> str:
    words = f"string_split({norm_base(x)}, ' ')"
    return f"array_to_string(list_transform({words}, lambda w: {mapped('w', D.TITLE_SYNONYMS, 'w')}), ' ')"


def norm_company_sql(x: str) -> str:
    return f"regexp_replace({norm_base(x)}, ' (?:{'|'.join(D.COMPANY_SUFFIXES)})$', '')"


def norm_location_sql(x: str) -> str:
    return mapped(norm_base(x), D.LOCATION_ALIASES, norm_base(x))


def canonical_key_sql(title: str, company: str, location: str) -> str:
    parts = (
        norm_title_sql(f"coalesce({title}, '')"),
        norm_company_sql(f"coalesce({company}, '')"),
        norm_location_sql(f"coalesce({location}, '')"),
    )
    return " || '|' || ".join(f"({p})" for p in parts)


def norm_url_sql(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '/$', '')"


@query("norm_base", f"SELECT doc_id, md5({norm_base('text')}) AS norm_md5, CAST(length({norm_base('text')}) AS BIGINT) AS n FROM documents")
def _norm_base(spark, sf):
    norm = T.norm_base(c("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(norm).alias("norm_md5"), F.char_length(norm).cast("bigint").alias("n")
    )


@query("norm_title", f"WITH {POSTINGS} SELECT id, {norm_title_sql('title')} AS norm FROM postings")
def _norm_title(spark, sf):
    return postings(spark, sf).select("id", T.norm_title(c("title")).alias("norm"))


@query("norm_company", f"WITH {POSTINGS} SELECT id, {norm_company_sql('company')} AS norm FROM postings")
def _norm_company(spark, sf):
    return postings(spark, sf).select("id", T.norm_company(c("company")).alias("norm"))


@query("norm_location", f"WITH {POSTINGS} SELECT id, {norm_location_sql('location')} AS norm FROM postings")
def _norm_location(spark, sf):
    return postings(spark, sf).select("id", T.norm_location(c("location")).alias("norm"))


@query("canonical_key", f"WITH {POSTINGS} SELECT id, {canonical_key_sql('title', 'company', 'location')} AS k FROM postings")
def _canonical_key(spark, sf):
    return postings(spark, sf).select("id", T.canonical_key(c("title"), c("company"), c("location")).alias("k"))


@query(
    "norm_name_simple",
    "SELECT c_custkey AS id, regexp_replace(lower(trim('  ' || replace(c_name, '#', '   ') || ' ')), '\\s+', ' ', 'g') AS norm FROM customer",
)
def _norm_name_simple(spark, sf):
    name = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("   ")), F.lit(" "))
    return table(spark, sf, "customer").select(c("c_custkey").alias("id"), T.norm_name_simple(name).alias("norm"))


@query("url_key", f"SELECT page_id, {norm_url_sql('url')} AS norm, md5({norm_url_sql('url')}) AS url_hash FROM pages")
def _url_key(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", T.norm_url(c("url")).alias("norm"), T.url_key(c("url")).alias("url_hash")
    )


@query(
    "url_synth",
    "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'urn:opp:web:' || CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) "
    "ELSE left(sha1(html), 12) END ELSE url END AS u FROM pages",
)
def _url_synth(spark, sf):
    n = c("page_id")
    url = F.when(n % 3 == 0, F.when(n % 2 == 0, "  ")).otherwise(c("url"))
    ident = F.when(n % 2 == 0, n.cast("string")).otherwise("")
    return table(spark, sf, "pages").select(n, T.url_synth(url, F.lit("web"), ident, c("html")).alias("u"))


@query(
    "remote_flag",
    f"WITH {DOCS} SELECT id, {matches('location', D.REMOTE_WORD.replace('(?i)', ''))} AS by_location, "
    f"CASE WHEN {matches('location', chr(92) + 'bremote' + chr(92) + 'b')} OR {matches('title', chr(92) + 'bremote' + chr(92) + 'b')} THEN true END AS by_either, "
    "CASE WHEN contains(lower(coalesce(location, '')), 'remote') OR contains(lower(title), 'remote') THEN true END AS by_substring, "
    f"{matches('title', chr(92) + 'b(remote|distributed|work\\s+from\\s+anywhere|wfh|work\\s+from\\s+home)' + chr(92) + 'b')} AS by_phrase FROM docs",
)
def _remote_flag(spark, sf):
    return docs(spark, sf).select(
        "id",
        T.remote_flag(c("location")).alias("by_location"),
        T.remote_flag(c("location"), c("title"), variant="location_or_title").alias("by_either"),
        T.remote_flag(c("location"), c("title"), variant="substring").alias("by_substring"),
        T.remote_flag(c("title"), variant="phrases").alias("by_phrase"),
    )


_COMMIT = "CASE p_size % 5 WHEN 0 THEN 'Part-time' WHEN 1 THEN 'Contractor' WHEN 2 THEN 'INTERN' WHEN 3 THEN '' ELSE p_type END"


@query(
    "job_type_map",
    "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'part_time' WHEN 1 THEN 'contract' WHEN 2 THEN 'contract' "
    "WHEN 3 THEN NULL ELSE 'full_time' END AS job_type FROM part",
)
def _job_type_map(spark, sf):
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), T.job_type_map(F.expr(_COMMIT)).alias("job_type"))


@query("blank_to_null", "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN md5(" + strip("text") + ") END AS m FROM documents")
def _blank_to_null(spark, sf):
    text = F.when(c("doc_id") % 4 == 0, F.when(c("doc_id") % 8 == 0, " \t\n ")).otherwise(
        F.concat(F.lit("\n "), c("text"), F.lit("  "))
    )
    return table(spark, sf, "documents").select("doc_id", F.md5(T.blank_to_null(text)).alias("m"))


@query(
    "ts_coerce",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE date_trunc('second', ts) END AS from_text, "
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS from_epoch, ts AS from_time FROM events",
)
def _ts_coerce(spark, sf):
    n, sec = c("event_id"), F.date_trunc("second", c("ts"))
    iso = F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01', ts)").cast("double")
    return table(spark, sf, "events").select(
        n,
        T.ts_coerce(F.when(n % 3 == 0, "soon").otherwise(iso)).alias("from_text"),
        T.ts_coerce(F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(epoch), kind="epoch").alias("from_epoch"),
        T.ts_coerce(c("ts"), kind="timestamp").alias("from_time"),
    )


def _character_sql(n: str) -> str:
    nothing = " OR ".join([f"{n} % 65536 >= 65534", *[f"{n} BETWEEN {low} AND {high}" for low, high in E.NOTHING]])
    controls = "[" + ", ".join(map(lit, E.CONTROLS)) + "]"
    return case(
        [
            (f"{n} = 0 OR {n} > {E.LAST_POINT} OR {n} BETWEEN 55296 AND 57343", lit(E.UNKNOWN)),
            (f"{n} BETWEEN 128 AND 159", f"{controls}[{n} - 127]"),
            (nothing, "''"),
        ],
        f"chr(CAST({n} AS INTEGER))",
    )


def unescape_sql(x: str) -> str:
    """All character references, by the standard table."""
    table = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in html5.items()) + "}"
    opened = "MAP {" + ", ".join(f"{lit(k)}: {lit(html5[k])}" for k in E.OPEN_NAMES) + "}"
    shorter = ", ".join(f"CASE WHEN length(s) > {n} THEN {opened}[left(s, {n})] || s[{n + 1}:] END" for n in range(E.LONGEST_OPEN, 1, -1))
    number = f"coalesce(TRY_CAST(CASE WHEN s[2] IN ('x', 'X') THEN '0x' || rtrim(s[3:], ';') ELSE rtrim(s[2:], ';') END AS BIGINT), {E.LAST_POINT + 1})"
    numeric = f"list_transform([{number}], lambda n: {_character_sql('n')})[1]"
    one = f"list_transform([r[2:]], lambda s: CASE WHEN s[1] = '#' THEN {numeric} ELSE coalesce({table}[s], {shorter}, '&' || s) END)[1]"
    found = f"list_transform(regexp_extract_all({x}, {lit(E.REFERENCE)}), lambda r: {one})"
    joined = f"list_transform(list_zip(string_split_regex({x}, {lit(E.REFERENCE)}), {found}), lambda z: z[1] || coalesce(z[2], ''))"
    return f"CASE WHEN contains({x}, '&') THEN array_to_string({joined}, '') ELSE {x} END"


def html_strip_sql(x: str) -> str:
    tagged = f"regexp_replace({unescape_sql(x)}, '<p>', chr(10), 'g')"
    return strip(f"regexp_replace({tagged}, '<[^>]+>', '', 'g')")


def html_post_sql(x: str) -> str:
    tagged = f"regexp_replace({x}, '(?i)<br\\s*/?>|<p[^>]*>|</p>|<li[^>]*>', chr(10), 'g')"
    return f"regexp_replace({tagged}, '<[^>]+>', '', 'g')"


@query(
    "html_strip",
    f"SELECT page_id, md5({html_strip_sql('html')}) AS comment_md5, md5({html_post_sql('html')}) AS post_md5 FROM pages",
)
def _html_strip(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.md5(T.html_strip(c("html"))).alias("comment_md5"),
        F.md5(T.html_strip(c("html"), mode="post")).alias("post_md5"),
    )


@query(
    "html_links",
    "SELECT page_id, array_to_string(regexp_extract_all(html, '<a\\s+href=\"([^\"]+)\"', 1), '|') AS links, "
    "array_to_string(regexp_extract_all(html, '<a\\s+href=\"([^\"]+)\"', 1)[1:3], '|') AS first_links FROM pages",
)
def _html_links(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        F.array_join(T.html_links(c("html")), "|").alias("links"),
        F.array_join(T.html_links(c("html"), limit=3), "|").alias("first_links"),
    )


_HOST = "regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]*://)?([^/?#:]*)', 1)), '^www\\.', '')"


@query(
    "url_domain_stem",
    f"SELECT page_id, CASE WHEN len(string_split({_HOST}, '.')) >= 2 THEN string_split({_HOST}, '.')[-2] ELSE {_HOST} END AS stem, "
    f"CASE WHEN len(string_split({_HOST}, '.')) >= 2 THEN string_split({_HOST}, '.')[-2] ELSE {_HOST} END AS bare_stem FROM pages",
)
def _url_domain_stem(spark, sf):
    bare = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select(
        "page_id", T.url_domain_stem(c("url")).alias("stem"), T.url_domain_stem(bare).alias("bare_stem")
    )


@query(
    "slug_candidates",
    "WITH s AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS a, replace(p_name, ' ', '-') AS b, string_split(p_name, ' ')[1] AS f, "
    "lower(replace(p_brand, '#', '')) AS d FROM part) "
    "SELECT id, a || CASE WHEN b <> a THEN ',' || b ELSE '' END || CASE WHEN f <> a AND f <> b THEN ',' || f ELSE '' END || "
    "CASE WHEN d <> a AND d <> b AND d <> f THEN ',' || d ELSE '' END AS slugs FROM s",
)
def _slug_candidates(spark, sf):
    site = F.concat(F.lit("https://www."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".io/x"))
    return table(spark, sf, "part").select(
        c("p_partkey").alias("id"), F.array_join(T.slug_candidates(F.initcap("p_name"), site), ",").alias("slugs")
    )


@query("url_numeric_id", "SELECT page_id, regexp_extract(url, '/(\\d+)', 1) AS num FROM pages")
def _url_numeric_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.url_numeric_id(c("url"), pattern=r"/(\d+)").alias("num"))


@query(
    "place_to_text",
    "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN p_name || ', ' || p_type || ', US' "
    "WHEN 2 THEN p_name WHEN 3 THEN p_brand || ', CA' END AS place FROM part",
)
def _place_to_text(spark, sf):
    n = c("p_size") % 5
    full = F.to_json(F.struct(F.struct(c("p_name").alias("addressLocality"), c("p_type").alias("addressRegion"), F.lit("US").alias("addressCountry")).alias("address")))
    named = F.to_json(F.struct(c("p_name").alias("name")))
    short = F.struct(F.struct(c("p_brand").alias("addressLocality"), F.lit("").alias("addressRegion"), F.lit("CA").alias("addressCountry")).alias("address"))
    json = F.when(n == 0, F.concat(F.lit('"'), c("p_type"), F.lit('"'))).when(n == 1, full).when(n == 2, named)
    json = json.when(n == 3, F.to_json(F.array(short))).otherwise("[]")
    return table(spark, sf, "part").select(
        c("p_partkey").alias("id"), T.place_to_text(F.try_parse_json(json)).alias("place")
    )


@query(
    "json_decode_cols",
    "SELECT event_id, event_id % 7 <> 0 AS decoded, CASE WHEN event_id % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, "
    "CASE WHEN event_id % 7 = 0 THEN 'not json ' || props END AS raw FROM events",
)
def _json_decode_cols(spark, sf):
    text = F.when(c("event_id") % 7 == 0, F.concat(F.lit("not json "), c("props"))).otherwise(c("props"))
    rows = table(spark, sf, "events").select("event_id", text.alias("t"), L.json_decode(text).alias("v"))
    return rows.select(
        "event_id",
        c("v").isNotNull().alias("decoded"),
        F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.when(c("v").isNull(), c("t")).alias("raw"),
    )


_TYPE_PART = "CASE WHEN event_id % 3 = 0 THEN '' ELSE ',\"type\":\"' || event_type || '\"' END"


@query(
    "json_build",
    f"SELECT event_id, '{{\"job\":' || CAST(user_id AS VARCHAR) || {_TYPE_PART} || '}}' AS sparse, "
    "'{\"job\":' || CAST(user_id AS VARCHAR) || ',\"type\":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '\"' || event_type || '\"' END || '}' AS dense FROM events",
)
def _json_build(spark, sf):
    fields = {"job": c("user_id"), "type": F.when(c("event_id") % 3 != 0, c("event_type"))}
    return table(spark, sf, "events").select(
        "event_id", L.json_build(fields).alias("sparse"), L.json_build(fields, keep_nulls=True).alias("dense")
    )


def text_blob_sql() -> str:
    return "lower(coalesce(title, 'None') || ' ' || coalesce(company, 'None') || ' ' || coalesce(location, 'None') || ' ' || coalesce(description, 'None'))"


@query(
    "text_blob",
    f"WITH {DOCS} SELECT id, md5({text_blob_sql()}) AS whole, "
    "md5(lower(title || ' ' || company || ' ' || coalesce(location, 'None') || ' ' || substr(description, 1, 1200))) AS cut FROM docs",
)
def _text_blob(spark, sf):
    cols = (c("title"), c("company"), c("location"), c("description"))
    return docs(spark, sf).select(
        "id",
        F.md5(T.text_blob(*cols, description_chars=None)).alias("whole"),
        F.md5(T.text_blob(*cols, description_chars=1200)).alias("cut"),
    )


_TURN_TEXT = (
    "CASE turn % 6 WHEN 0 THEN 'Submitted application. ' WHEN 1 THEN 'no news ' WHEN 2 THEN 'got GHOSTED ' "
    "WHEN 3 THEN 'the offered onsite ' WHEN 4 THEN 'withdrawn, ' ELSE '' END || text"
)


def ladder_sql(x: str) -> str:
    return case([(matches(x, p), lit(v)) for p, v in D.COMMENT_LADDER])


@query("regex_ladder", f"SELECT conv_id, turn, {ladder_sql(f'({_TURN_TEXT})')} AS label FROM conversations")
def _regex_ladder(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", L.regex_ladder(F.expr(_TURN_TEXT)).alias("label")
    )


@query(
    "label_map",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'applied' WHEN 'view' THEN 'phone_screen' WHEN 'purchase' THEN 'offer' END AS label FROM events",
)
def _label_map(spark, sf):
    mapping = {"click": "applied", "view": "phone_screen", "purchase": "offer"}
    return table(spark, sf, "events").select("event_id", L.label_map(c("event_type"), mapping=mapping).alias("label"))


_WORDS = (("that", r"\bthat\b"), ("with", r"\bwith\b"), ("sich", r"\bsich\b"), ("dans", r"\bdans\b"), ("role", r"\bengineer\b"))


def _keywords_sql(x: str) -> str:
    parts = ", ".join(f"CASE WHEN {matches(x, p)} THEN {lit(n)} END" for n, p in _WORDS)
    return f"list_filter([{parts}], lambda w: w IS NOT NULL)"


@query(
    "keyword_array",
    f"WITH {DOCS} SELECT id, array_to_string(CASE WHEN len({_keywords_sql('description')}) > 0 THEN {_keywords_sql('description')} "
    f"ELSE {_keywords_sql('title')} END, ',') AS words FROM docs",
)
def _keyword_array(spark, sf):
    return docs(spark, sf).select(
        "id", F.array_join(L.keyword_array(c("description"), c("title"), patterns=_WORDS), ",").alias("words")
    )


def phrase_sql(x: str) -> str:
    return case([(f"contains(lower({x}), {lit(k)})", lit(v)) for k, v in D.ROLE_PHRASES])


@query("substring_map_first", f"WITH {DOCS} SELECT id, {phrase_sql('title')} AS phrase FROM docs")
def _substring_map_first(spark, sf):
    return docs(spark, sf).select("id", L.substring_map_first(c("title")).alias("phrase"))


def source_priority_sql(x: str = "source") -> str:
    return case([(any_in(f"lower(coalesce({x}, ''))", names), str(r)) for names, r in D.SOURCE_PRIORITY], str(D.SOURCE_PRIORITY_DEFAULT))


def role_priority_sql(x: str = "title") -> str:
    return case([(any_in(f"lower({x})", names), str(r)) for names, r in D.ROLE_PRIORITY], str(D.ROLE_PRIORITY_DEFAULT))


@query(
    "priority_class",
    f"WITH {DOCS} SELECT id, CAST({source_priority_sql()} AS INTEGER) AS source_class, CAST({role_priority_sql()} AS INTEGER) AS role_class FROM docs",
)
def _priority_class(spark, sf):
    return docs(spark, sf).select(
        "id", L.source_priority(c("source")).alias("source_class"), L.role_priority(c("title")).alias("role_class")
    )




def tier_sql(x: str) -> str:
    return case([(f"{x} >= {floor}", lit(v)) for floor, v in D.SCORE_TIERS], lit(D.SCORE_TIER_DEFAULT))


@query("score_tier", f"SELECT p_partkey AS id, {tier_sql('CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size / 100.0 END')} AS tier FROM part")
def _score_tier(spark, sf):
    score = F.when(c("p_size") % 9 != 0, c("p_size") / 100.0)
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), L.score_tier(score).alias("tier"))


def bonus_sql(x: str = "title") -> str:
    low = strip(f"lower({x})")
    parts = [f"CASE WHEN {any_match(low, D.BONUS_PATTERNS)} THEN {D.PATTERN_BONUS} ELSE 0 END"]
    parts += [f"CASE WHEN contains({low}, {lit(w)}) THEN {b} ELSE 0 END" for w, b in D.SUBSTRING_BONUSES]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


@query("title_bonus", f"WITH {DOCS} SELECT id, round({bonus_sql()}, 6) AS bonus FROM docs")
def _title_bonus(spark, sf):
    return docs(spark, sf).select("id", F.round(L.title_bonus(c("title")), 6).alias("bonus"))


REFERENCE_SQL = "reference AS (SELECT 'src' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'tier_' || CAST(s_nationkey % 3 AS VARCHAR) END AS priority, s_suppkey AS pos FROM supplier)"


def reference(spark, sf):
    n = c("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("src"), n.cast("string")).alias("name"),
        F.when(n % 2 == 0, F.concat(F.lit("tier_"), (c("s_nationkey") % 3).cast("string"))).alias("priority"),
        n.alias("position"),
    )


def _skills_sql(x: str) -> str:
    parts = ", ".join(f"CASE WHEN {matches(x, p)} THEN {lit(n)} END" for n, p in D.SKILL_PATTERNS)
    return f"array_to_string(list_filter([{parts}], lambda w: w IS NOT NULL), ', ')"


@query(
    "blurb",
    f"WITH {DOCS}, {REFERENCE_SQL}, j AS (SELECT d.id, trim(d.title) AS t, trim(d.company) AS co, d.description AS de, r.name IS NOT NULL AS hit, r.priority AS pr "
    "FROM docs d LEFT JOIN reference r ON lower(trim(d.company)) = lower(r.name)) "
    "SELECT id, md5(t || ' at ' || co || ' ' || CASE WHEN hit THEN 'is a' || CASE WHEN pr IS NOT NULL THEN ' (' || pr || ' reference company)' ELSE ' (reference company)' END || ' match' "
    f"ELSE 'aligns with the target profile' END || ' ' || CASE WHEN {matches('t', D.FOUNDING_PATTERN)} THEN 'and this is a founding/early-stage role' "
    "ELSE 'where technical and commercial instincts are assets' END || '. ' || "
    f"coalesce({phrase_sql('t')}, {lit(D.ROLE_PHRASE_DEFAULT)}) || '.' || "
    f"CASE WHEN {_skills_sql('de')} <> '' THEN ' Direct stack overlap: ' || {_skills_sql('de')} || '.' ELSE '' END) AS blurb_md5 FROM j",
)
def _blurb(spark, sf):
    from confluo.operators.joins import enrich_reference

    rows = enrich_reference(docs(spark, sf), reference(spark, sf))
    text = L.blurb(c("title"), c("company"), c("description"), matched=c("is_reference"), tier=c("priority"))
    return rows.select("id", F.md5(text).alias("blurb_md5"))


@query(
    "card_text",
    f"WITH {POSTINGS} SELECT id, title || ' @ ' || company AS card, lower(title || ' @ ' || company) AS card_key, "
    "'**💡 Why Interesting**' || chr(10) || chr(10) || name || chr(10) || chr(10) || '---' || chr(10) || '**Score:** ' || CAST(size AS VARCHAR) || chr(10) || '**Source:** ' || source || chr(10) || "
    "'**Location:** ' || coalesce(location, '') || chr(10) || '**Remote:** ' || CASE WHEN size % 2 = 0 THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || '**URL:** ' || url || chr(10) || chr(10) || "
    "'_Auto-pushed from the ranked list_' AS body FROM postings",
)
def _card_text(spark, sf):
    remote = F.when(c("size") % 2 == 0, True)
    return postings(spark, sf).select(
        "id",
        L.card_title(c("title"), c("company")).alias("card"),
        L.card_key(c("title"), c("company")).alias("card_key"),
        L.card_body(c("name"), c("size"), c("source"), c("location"), remote, c("url")).alias("body"),
    )


@query(
    "media_sniff",
    "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM part",
)
def _media_sniff(spark, sf):
    magic = ("89504E470D0A1A0A", "FFD8FF", "474946383761", "474946383961", "524946460000000057454250", "00")
    head = F.element_at(F.array(*[F.lit(m) for m in magic]), (c("p_size") % 6 + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode("p_name", "utf-8"))
    return table(spark, sf, "part").select(c("p_partkey").alias("id"), L.media_sniff(content).alias("mime"))


