from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from sievework.llm.queries import ORACLES
from sievework.llm.secret_scan import KINDS, SecretSettings, redacted, secret_spans, term, with_digests
from tests.llm.common import documents, odd_rows, prose, with_clashes

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
SETTINGS = SecretSettings()


def plainly(text):
    """All spans as (kind, start, stop), window by window."""
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m.group()) >= 24]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text):
        if any(re.search(p, m.group()) for p in SETTINGS.allowed):
            continue
        if any(a <= m.start() and m.end() <= b for _, a, b in base):
            continue
        body = m.group().rstrip("=")
        kind = next(c for c in SETTINGS.classes if re.search(c.pattern, body))
        runs = []
        for at in range(len(body) - kind.window + 1):
            window = body[at : at + kind.window]
            counts = Counter(window.lower() if kind.name == "hex" else window)
            if sum(map(term, counts.values())) <= kind.most:
                if runs and at <= runs[-1][1]:
                    runs[-1][1] = at + kind.window
                else:
                    runs.append([at, at + kind.window])
        for a, b in runs:
            span = "entropy", m.start() + a, m.start() + b
            if not any(x < span[2] and y > span[1] for _, x, y in base):
                more.append(span)
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def texts_of_all_kinds():
    rng = random.Random(4)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    parts = [
        "password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "AKIA", "\n", ".",
        "\U0001f642", "é", "\x01", "\x02", "abc", "==", "token:abc", "ſecret=abcdefgh", "toKen: abcdefgh",
    ]
    texts = []
    for _ in range(250):
        made = [rng.choice(parts) for _ in range(rng.randint(1, 25))]
        for _ in range(rng.randint(0, 3)):
            found = rng.choice([
                key(alnum, rng.randint(15, 60)), key("0123456789abcdef", rng.randint(20, 50)), key("ABCDEF0123456789", 40),
                key(alnum + "+/", 44) + "=", "AKIA" + key("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", rng.randint(10, 20)),
                key("ab1", 40), key("ab1", 30) + key(alnum, 25) + key("xy2", 45) + key(alnum, 30),
            ])
            made.insert(rng.randint(0, len(made)), found)
        texts.append("".join(made))
    return texts + [
        "password=token=abcdef", "secret:token:abcdefgh", "token = \"" + "a" * 5 + "\"", "AKIA" * 8, "f" * 23, "f" * 24,
        "9b2f6c1e-7d3a-4f58-8c41-0a1b2c3d4e5f and 9B2F6C1E-7D3A-4F58-8C41-0A1B2C3D4E5F", "sha256-" + key(alnum, 43) + "=",
        "https://host.org/one/path/With_some-words/2024/and/More", "Donaudampfschifffahrtsgesellschaft" * 2,
        "EXAMPLE" + key(alnum, 30), "x" + "password:abcdef " * 1000, key(alnum, 5000), prose(1, 500) + " " + key(alnum, 32),
        key("ab1", 50) + key(alnum, 20) + key("ab1", 50) + key(alnum, 20),
    ]


@pytest.fixture(scope="module")
def rows(spark):
    return documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts_of_all_kinds())])


def test_against_windows_counted_one_by_one(rows):
    out = {r["doc_id"]: r for r in with_digests(secret_spans(with_clashes(rows))).collect()}
    entropy = 0
    for i, text in enumerate(texts_of_all_kinds()):
        expected = plainly(text)
        assert out[i]["spans"] == written(expected), text
        base = [s for s in expected if s[0] != "entropy"]
        assert out[i]["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        for kind in KINDS[:3]:
            assert out[i][f"n_{kind}"] == sum(s[0] == kind for s in base)
        entropy += len(expected) - len(base)
    assert entropy > 100


def test_values_and_redaction(spark):
    text = "é \U0001f642 token = 'abcdef12', password=0123456789abcdef0123456789 end"
    row = documents(spark, [(1, text, "en", "a", 1)]).join(secret_spans(documents(spark, [(1, text, "en", "a", 1)])), "doc_id")
    spans = row.first()["spans"]
    assert all(s["value"] == text[s["start"] : s["stop"]] for s in spans) and len(spans) == 3
    cleaned = row.select(redacted(F.col("text"), F.col("spans")).alias("t")).first()["t"]
    assert cleaned == "é \U0001f642 [secret]', [secret] end"


def test_odd_rows_and_no_rows(spark):
    out = with_digests(secret_spans(with_clashes(documents(spark)))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["spans"]) for r in out), key=key) == sorted(
        ((row[0], written(plainly(row[1]))) for row in odd_rows()), key=key
    )
    assert secret_spans(documents(spark, [])).collect() == []


def test_sql_of_the_query_says_the_same(rows, tmp_path):
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = duck.execute(ORACLES["op13_secret_scan"])
    names = [c[0] for c in result.description]
    theirs = sorted(tuple(dict(zip(names, row)).items()) for row in result.fetchall())
    ours = sorted(tuple((n, r[n]) for n in names) for r in with_digests(secret_spans(rows)).collect())
    assert ours == theirs
