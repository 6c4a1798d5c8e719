"""The weighted string ratio and the sequential resolution rule as SQL, for comparison only."""

from __future__ import annotations


def lcs(x: str, y: str) -> str:
    """Length of the longest common subsequence: a bit per character of ``x`` (up to 120), a fold
    over the characters of ``y``."""
    full = "((1::HUGEINT << t.n) - 1)"
    mask = "list_sum([CASE WHEN t.cs[i] = c THEN 1::HUGEINT << (i - 1) ELSE 0::HUGEINT END FOR i IN range(1, t.n + 1)])::HUGEINT"
    found = f"map(list_distinct(t.cs), [{mask} FOR c IN list_distinct(t.cs)])"
    step = f"((r + (r & m)) | (r - (r & m))) & {full}"
    fold = f"list_reduce([{full}] || list_transform(string_split({y}, ''), lambda ch: coalesce(u.m[ch], 0::HUGEINT)), lambda r, m: {step})"
    inner = f"list_transform([{{'m': {found}}}], lambda u: t.n - bit_count({fold}))[1]"
    folded = f"list_transform([{{'cs': string_split({x}, ''), 'n': length({x})}}], lambda t: {inner})[1]"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 ELSE {folded} END"


def ratio(x: str, y: str) -> str:
    return f"CASE WHEN {x} = '' AND {y} = '' THEN 100e0 ELSE 200e0 * ({lcs(x, y)}) / (length({x}) + length({y})) END"


def window(x: str, y: str) -> str:
    """Best ratio of the shorter text against any window of the longer, full or cut at an end."""
    short, long = (f"(CASE WHEN length({x}) <= length({y}) THEN {p} ELSE {q} END)" for p, q in ((x, y), (y, x)))
    piece = "w.l[greatest(0, e - length(w.s)) + 1 : e]"
    best = f"list_max([200e0 * ({lcs('w.s', piece)}) / (length(w.s) + length({piece})) FOR e IN range(1, length(w.l) + length(w.s))])"
    return f"list_transform([{{'s': {short}, 'l': {long}}}], lambda w: CASE WHEN w.s = '' THEN CASE WHEN w.l = '' THEN 100e0 ELSE 0e0 END ELSE {best} END)[1]"


def parts_sql(pairs: str) -> str:
    """CTE ``parts``: the columns of ``pairs`` (with texts ``a`` and ``b``) and what the score needs."""
    words = "list_sort(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
    return (
        f"w1 AS (SELECT *, length(a) AS la, length(b) AS lb, {words.format('a')} AS wa, {words.format('b')} AS wb FROM {pairs}), "
        "w2 AS (SELECT *, array_to_string(wa, ' ') AS ja, array_to_string(wb, ' ') AS jb, list_sort(list_distinct(wa)) AS sa, list_sort(list_distinct(wb)) AS sb FROM w1), "
        "w3 AS (SELECT *, array_to_string(list_filter(sa, lambda w: NOT list_contains(sb, w)), ' ') AS ta, array_to_string(list_filter(sb, lambda w: NOT list_contains(sa, w)), ' ') AS tb, "
        "list_filter(sa, lambda w: list_contains(sb, w)) AS sh FROM w2), "
        f"parts AS (SELECT *, length(array_to_string(sh, ' ')) AS base, CAST(len(sh) > 0 AS INTEGER) AS gap, greatest(la, lb) < 1.5e0 * least(la, lb) AS near, "
        f"CASE WHEN greatest(la, lb) <= 8e0 * least(la, lb) THEN 0.9e0 ELSE 0.6e0 END AS scale, {lcs('a', 'b')} AS common FROM w3)"
    )


_RATIO = "200e0 * common / (la + lb)"
_SET = (
    "CASE WHEN ta = '' OR tb = '' THEN CASE WHEN gap = 1 THEN 100e0 ELSE 0e0 END ELSE greatest("
    f"100e0 - 100e0 * (length(ta) + length(tb) - 2 * ({lcs('ta', 'tb')})) / (2 * base + 2 * gap + length(ta) + length(tb)), "
    "CASE WHEN gap = 1 THEN 200e0 * base / (2 * base + 1 + length(ta)) ELSE 0e0 END, "
    "CASE WHEN gap = 1 THEN 200e0 * base / (2 * base + 1 + length(tb)) ELSE 0e0 END) END"
)
#: Scores of pairs of similar length, and of others.
NEAR = f"greatest({_RATIO}, 0.95e0 * greatest({ratio('ja', 'jb')}, {_SET}))"
FAR = (
    f"greatest({_RATIO}, scale * ({window('a', 'b')}), 0.95e0 * scale * CASE WHEN gap = 1 THEN 100e0 ELSE greatest({window('ja', 'jb')}, "
    f"CASE WHEN len(wa) <> len(sa) OR len(wb) <> len(sb) THEN {window('ta', 'tb')} ELSE 0e0 END) END)"
)
#: Bounds of the latter from subsequences of the whole texts.
FAR_LOW = f"greatest({_RATIO}, CASE WHEN gap = 1 THEN 0.95e0 * scale * 100e0 ELSE 0e0 END)"
FAR_HIGH = (
    f"greatest({_RATIO}, scale * 200e0 * common / (least(la, lb) + common), 0.95e0 * scale * CASE WHEN gap = 1 OR len(wa) <> len(sa) OR len(wb) <> len(sb) THEN 100e0 "
    f"ELSE 200e0 * ({lcs('ja', 'jb')}) / greatest(least(length(ja), length(jb)) + ({lcs('ja', 'jb')}), 1) END)"
)


def best_match_sql(pairs: str) -> str:
    """CTE ``best(block, a, id, b, score)`` of ``pairs(block, a, id, b)``: the best ``b`` at any score.

    Windows are looked at only where their bound reaches what another candidate has for certain.
    """
    return (
        f"{parts_sql(pairs)}, sure AS (SELECT *, CASE WHEN near THEN {NEAR} ELSE {FAR_LOW} END AS low, CASE WHEN near THEN NULL ELSE {FAR_HIGH} END AS high FROM parts), "
        "kept AS (SELECT * FROM sure QUALIFY near OR high >= max(low) OVER (PARTITION BY block, a) - 1e-6), "
        f"scored AS (SELECT block, a, id, b, CASE WHEN near THEN low ELSE {FAR} END AS score FROM kept), "
        "best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY block, a ORDER BY score DESC, id) = 1)"
    )


def resolve_sql(duplicate_at: float, review_at: float) -> str:
    """CTE ``resolved`` of ``fresh(arrival, source, block, key)``, ``old(id, block, key)`` and
    ``old_sources(job_id, source_name, source_trust)``, for rows whose URLs meet no other's.

    Row by row: a key is inserted unless an old or inserted one equals it or, in its block, is
    alike to ``duplicate_at``. Only keys with such a neighbour have to be walked one by one.
    """
    return (
        "firsts AS (SELECT block, key, min(arrival) AS arrival FROM fresh GROUP BY ALL), "
        "stored AS (SELECT block, key, min(id) AS id FROM old GROUP BY ALL), "
        "names AS (SELECT block, key, 0 AS gen, -1 AS arrival, id FROM stored UNION ALL "
        "SELECT block, key, 1, arrival, NULL FROM firsts WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.block = firsts.block AND s.key = firsts.key)), "
        "close AS (SELECT f.block, f.key AS a, n.key AS b, n.gen, n.arrival, n.id FROM firsts f JOIN names n ON n.block = f.block AND n.key <> f.key "
        "WHERE greatest(length(f.key), length(n.key)) < 1.5e0 * least(length(f.key), length(n.key))), "
        f"{parts_sql('close')}, alike AS (SELECT block, a, b, gen, arrival, id, {NEAR} AS score FROM parts), "
        f"edges AS (SELECT * FROM alike WHERE score >= {review_at}), "
        # keys that an old one equals, or is alike to, are never inserted; without an earlier neighbour a key always is
        "cand AS (SELECT n.block, n.key, n.arrival, "
        f"coalesce((SELECT bool_or(e.gen = 0) FROM edges e WHERE e.block = n.block AND e.a = n.key AND e.score >= {duplicate_at}), false) AS gone, "
        f"coalesce((SELECT list(e.arrival) FROM edges e WHERE e.block = n.block AND e.a = n.key AND e.score >= {duplicate_at} AND e.gen = 1 AND e.arrival < n.arrival), []) AS before "
        "FROM names n WHERE n.gen = 1), "
        "hard AS (SELECT *, row_number() OVER (ORDER BY arrival) AS n FROM cand WHERE NOT gone AND len(before) > 0), "
        "sure_in AS (SELECT list(arrival) AS a FROM cand WHERE NOT gone AND len(before) = 0), "
        "walk AS (SELECT 0::BIGINT AS n, coalesce((SELECT a FROM sure_in), []) AS ins UNION ALL "
        "SELECT h.n, CASE WHEN list_has_any(h.before, walk.ins) THEN walk.ins ELSE list_append(walk.ins, h.arrival) END FROM walk JOIN hard h ON h.n = walk.n + 1), "
        "born AS (SELECT unnest(ins) AS arrival FROM (SELECT ins FROM walk ORDER BY n DESC LIMIT 1)), "
        "jobs AS (SELECT * FROM names WHERE gen = 0 OR arrival IN (SELECT arrival FROM born)), "
        "near AS (SELECT f.arrival AS at, e.b, e.gen, e.arrival, e.id, e.score FROM fresh f JOIN edges e ON e.block = f.block AND e.a = f.key "
        "JOIN jobs j ON j.block = e.block AND j.key = e.b WHERE e.arrival < f.arrival QUALIFY row_number() OVER (PARTITION BY f.arrival ORDER BY e.score DESC, e.gen, e.arrival, e.id) = 1), "
        "met AS (SELECT f.*, f.arrival IN (SELECT arrival FROM born) AS is_born, k.gen AS kgen, k.arrival AS karrival, k.id AS kid, k.key IS NOT NULL AS by_key, "
        "n.score AS nscore, n.b AS nkey, n.gen AS ngen, n.arrival AS narrival, n.id AS nid FROM fresh f "
        "LEFT JOIN jobs k ON k.block = f.block AND k.key = f.key AND k.arrival < f.arrival LEFT JOIN near n ON n.at = f.arrival), "
        # a job is named by its old id, or by minus the arrival that inserted it
        "matched AS (SELECT *, CASE WHEN is_born THEN -arrival WHEN by_key THEN coalesce(kid, -karrival) ELSE coalesce(nid, -narrival) END AS job, "
        f"is_born AND coalesce(nscore >= {review_at}, false) AS flagged FROM met), "
        "opened AS (SELECT m.job, m.source, min(m.arrival) AS first FROM matched m WHERE NOT EXISTS "
        "(SELECT 1 FROM old_sources s WHERE s.job_id = m.job AND s.source_name = m.source) GROUP BY ALL), "
        "flips AS (SELECT job, min(first) AS at FROM opened WHERE job IN (SELECT job_id FROM old_sources WHERE source_trust = 'untrusted') GROUP BY job), "
        "resolved AS (SELECT m.arrival, m.source AS source_name, m.key AS canonical_key, CASE WHEN m.flagged THEN 'review_flagged' WHEN m.is_born THEN 'new_job' "
        "WHEN o.first = m.arrival THEN 'new_source' ELSE 'duplicate' END AS outcome, m.job, min(m.arrival) OVER (PARTITION BY m.job) AS job_first, "
        "CASE WHEN m.is_born THEN CASE WHEN m.flagged THEN m.nscore END WHEN m.by_key THEN 100e0 ELSE m.nscore END AS fuzzy_score, "
        "CASE WHEN m.is_born THEN CASE WHEN m.flagged THEN m.nkey END WHEN m.by_key THEN m.key ELSE m.nkey END AS matched_canonical_key, "
        "coalesce(f.at = m.arrival, false) AND NOT m.is_born AS trust_flipped FROM matched m "
        "LEFT JOIN opened o ON o.job = m.job AND o.source = m.source LEFT JOIN flips f ON f.job = m.job)"
    )
