"""Secret scans against a plain scanner."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import pytest
from cases import awkward, empty, rows, SCHEMA
from confluo.llm import secrets as S

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(part):
    return math.log2(len(part)) - sum(c * math.log2(c) for c in Counter(part).values()) / len(part)


def plain_more(text, taken):
    text, out = text or "", []
    for order, cls in enumerate(S.CLASSES, 3):
        found = []
        for m in re.finditer(cls.candidate, text):
            c = m[0]
            if any(a in c.lower() for a in S.ALLOWED) or not re.search("[0-9]", c) or not re.search("[A-Za-z]", c):
                continue
            low = c.lower() if "A" not in cls.alphabet else c
            hot = [i for i in range(len(c) - S.WINDOW + 1) if entropy(low[i : i + S.WINDOW]) >= cls.threshold - 1e-9]
            if hot:
                found.append((m.start() + hot[0], order, m.start() + hot[-1] + S.WINDOW, cls.kind))
        out += [s for s in found if not any(t[0] < s[2] and s[0] < t[2] for t in taken + out)]
    return out


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def texts():
    draw = random.Random(4)
    alphabet = string.ascii_letters + string.digits + "+/_.=-"
    word = lambda n, a=alphabet: "".join(draw.choice(a) for _ in range(n))
    keys = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "tokens"]
    out = ["é🎉 token=abc", "secret=token:abcdefgh", 'api_key": "' + word(12) + '"', "AKIA" + "A" * 15, "AKIA" + "A1" * 10 + "xAKIAAKIA", "a" * 23, "b" * 24 + "g" + "c" * 25]
    for _ in range(120):
        parts = []
        for _ in range(draw.randrange(1, 12)):
            kind = draw.randrange(7)
            parts.append(
                [
                    draw.choice(keys) + draw.choice(["=", " : ", '"= "', "   ="]) + word(draw.randrange(3, 12)), "AKIA" + word(draw.randrange(14, 20), string.ascii_uppercase + "1é"),
                    word(draw.randrange(20, 30), "0123456789abcdef"), word(draw.randrange(18, 60)), word(draw.randrange(20, 40), "0123456789ABCDEF"), "wörd " * 3, "example" + word(20),
                ][kind]
            )
        out.append(draw.choice([" ", "\n", "", "é"]).join(parts))
    return out


@pytest.fixture(scope="module")
def table(spark):
    # many matches in one text: offsets cross blocks
    return awkward(spark, [*texts(), ("token=abcdef123 " + "f0" * 13 + " ") * 900])


def test_spans(table):
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in S.secret_scan(table).collect())
    want = []
    for r in table.collect():
        base = plain_base(r.text)
        n = Counter(s[3] for s in base)
        want.append((r.doc_id if r.doc_id is not None else -1, n["assign"], n["access"], n["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(base + plain_more(r.text, base))))
    assert got == sorted(want)
    assert any("entropy_hex" in w[5] for w in want) and any("entropy_base64" in w[5] for w in want)


def test_empty_table(spark):
    assert S.secret_scan(empty(spark)).collect() == []


def test_mask(spark, table):
    before = {r.doc_id: r for r in table.collect()}
    out = S.mask_secrets(table)
    assert out.columns == table.columns
    for r in out.collect():
        if not plain_base(before[r.doc_id].text) and not plain_more(before[r.doc_id].text, []):
            assert r == before[r.doc_id]
        else:
            assert not plain_base(r.text) and S.MASK in r.text and r.n_chars == len(r.text)


def test_repeats_share_one_plan_without_python(spark):
    docs = spark.createDataFrame(rows(["token=abcdef1"]), SCHEMA)
    text = S.secret_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text
