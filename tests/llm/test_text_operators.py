"""Chat formatting, secret scan, quality rules, mixing: against brute force and SQL, and on odd inputs."""

import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from topoprofile.llm import chat_format, mixing, quality, secret_scan, simhash, suffix_dedup
from topoprofile.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TABLES", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "palabra " * 30_000


def docs(spark, texts, extra=False):
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({"kept": F.lit(1), "secrets": F.lit(2), "copy": F.lit(3), "ids": F.lit(4), "_row": F.lit(5)}) if extra else frame


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(got.columns)
    canonical = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert columns == sorted(expected.columns) and canonical(got) == canonical(expected)


TURNS = [
    (1, 1, "user", "a\\b [INST]\\[/INST] \\\\"),
    (1, 2, "assistant", "hi</s>[OUT]"),
    (1, 3, "tool\n[OUT]", None),
    (2, 1, None, "x\\\\<s>"),
    (3, 2, "assistant", "two"),
    (3, 1, "assistant", ""),
    (3, 3, "user", "[ROLE]"),
    (None, 1, "system", "[SYS]é"),
    (4, 1, "user", LONG),
    (4, 1, "user", LONG),
    (4, 2, "assistant", LONG),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat_format.prefix_target_examples(table)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    order = lambda t: (t[1], t[2] or "", t[3] or "")
    for conv in {t[0] for t in TURNS}:
        turns = sorted((t for t in TURNS if t[0] == conv), key=order)
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # an example ends with its reply, and holds no raw control string of a text
    for r in examples.where("loss_length > 0").collect():
        assert r.formatted.endswith("</s>") and r.loss_start + r.loss_length + 4 == len(r.formatted)
    assert chat_format.read_back(chat_format.prefix_target_examples(table.where("false"))).collect() == []


def spans_by_definition(text):
    text, spans = text or "", []
    for m in re.finditer(secret_scan.ASSIGN, text, re.A):
        if len(m[2]) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    size = secret_scan.WINDOW
    for m in re.finditer(secret_scan.CANDIDATE, text):
        run = m[0]
        if any(re.search(p, run) for p in secret_scan.ALLOW):
            continue
        kind = next(k for k, (p, _) in secret_scan.CLASSES.items() if re.search(p, run))
        cover = []
        for i in range(len(run) - size + 1):
            bits = -sum(v / size * math.log2(v / size) for v in Counter(run[i : i + size]).values())
            if bits >= secret_scan.CLASSES[kind][1] - 1e-12:
                at = m.start() + i
                if cover and cover[-1][1] >= at:
                    cover[-1][1] = at + size
                else:
                    cover.append([at, at + size])
        spans += [(a, secret_scan.KINDS.index(kind), b) for a, b in cover]
    return sorted(spans)


SECRETS = [
    None,
    "",
    "é token = secret:abcdefghijklmno PASSWORD='hunter2hunter2' api-key=abcdefghijkl",
    "token=password=abcdefghijklmnop API_KEY : \"Zx9+/=_.-Zx9+/\"",
    "AKIAABCDEFGHIJKLMN AKIASHORT xAKIA12345678901234",
    "deadbeefdeadbeef 0123456789abcde 漢字0123456789abcdef",
    "k=Qm7xTz81LpWv03RbYcKd92Hs_aaaaaaaaaaaaaaaaaaaaaaaaa and internationalizations-of-things",
    "aGVsbG8gd29ybGQhIT8_Zz09QmFzZTY0IQ==/Xy7Kp2 9f8e7d6c5b4a39281706f5e4d3c2b1a0ABCDEF",
    "550e8400-e29b-41d4-a716-446655440000 EXAMPLEKEYabcdefgh1234567",
    LONG + "secret: 0123456789abcdefABCD",
]


def test_secrets(spark):
    found = secret_scan.find_secrets(docs(spark, SECRETS, extra=True)).collect()
    for r in found:
        assert [tuple(s) for s in r.secrets] == spans_by_definition(r.text)
    assert sum(len(r.secrets) for r in found) > 10


def test_secret_digests(spark, tmp_path):
    docs(spark, SECRETS, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.op2_secret_scan(spark, str(tmp_path)).collect()}
    for k, text in enumerate(SECRETS):
        spans = [(secret_scan.KINDS[kind], a, b) for a, kind, b in spans_by_definition(text)]
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        counts = Counter(kind for kind, _, _ in base)
        joined = lambda found: ",".join(f"{kind}:{a}:{b}" for kind, a, b in found)
        expected = (k, counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
        r = got[k]
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == expected
    assert len(got) == len(SECRETS)


CLASHING = ["_text", "hex_m", "cand_m", "_base", "_cand", "parts", "rate", "cdf", "_source", "_id", "_n", "mass", "tid", "_row", "_doc", "a", "x", "symbols_high", "_group"]


@pytest.mark.parametrize("operator", [secret_scan.find_secrets, mixing.poisson_mix, quality.filter_quality, simhash.keep_one, suffix_dedup.with_spans], ids=lambda f: f.__name__)
def test_clashing_names(spark, operator):
    plain = docs(spark, [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(8)] + [None, "", "token: 0123456789abcdefABCD"])
    table = plain.withColumns({c: F.col("doc_id") * 10 + k for k, c in enumerate(CLASHING)})
    out, expected = operator(table), operator(plain)
    rows = out.collect()
    assert [c for c in out.columns if c in table.columns] == table.columns
    assert all(r[c] == r.doc_id * 10 + k for r in rows for k, c in enumerate(CLASHING))
    assert sorted(map(repr, out.select(*expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_redaction(spark):
    table = docs(spark, SECRETS)
    clean = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.find_secrets(table)).collect()}
    assert clean[0] is None and clean[1] == ""
    assert "hunter2" not in clean[2] and clean[2].startswith("é token = secret:")
    assert clean[9] == LONG + "<assign>"


def features_by_definition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_features():
    block = " ".join(f"w{k}" for k in range(12))
    for text in [None, "", " \n\t", "a\x1cb\x85c d", f"{block}\n{block}\nx {block}", "a " * 40, "#|é<\n#|é<\n\n \n", LONG]:
        assert quality.features_of(text) == features_by_definition(text)


def test_quality_filter(spark):
    good = [" ".join(f"word{(k * 7 + j * 13) % 997}" for j in range(40)) for k in range(120)]
    bad = ["$$$ ### %%% " * 30, "few words", None, " ".join(f"w{k}#|%&$" for k in range(60))]
    table = docs(spark, good + bad, extra=True)
    kept = quality.filter_quality(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == set(range(120))
    assert quality.filter_quality(table.where("false")).collect() == []


def test_groups_have_their_own_cutoffs(spark):
    text = lambda k, n, length: " ".join(["#" * n, *(("a" if j % 2 else "b") * (length + (k + j) % 3) + str(k * 40 + j) for j in range(40))])
    rows = [(k, text(k, 0, 4), "x", "plain", 1) for k in range(400)] + [(1000 + k, text(k, 4 + k % 8, 11), "y", "code", 1) for k in range(400)]
    rows += [(5000, text(5000, 6, 4), "x", "plain", 1), (5001, text(5000, 6, 11), "y", "code", 1), (5002, text(5000, 6, 4), "y", "code", 1), (5003, text(5000, 0, 11), "x", "plain", 1), (5004, text(5000, 0, 4), "x", "plain", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("symbols_high", "word_length_low", "n_words", "_lang", "_f")})
    kept = quality.filter_quality(table)
    assert kept.columns == table.columns
    got = {r.doc_id for r in kept.collect()}
    assert {k for k in got if k >= 5000} == {5001, 5004} and len(got) == 802


def test_features_are_computed_once(spark):
    table = quality.with_features(docs(spark, ["few words", "a " * 40]))
    plan = quality.sketch(table.where("NOT base_failed"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_merged_sketches_equal_one_sketch(spark):
    table = quality.with_features(docs(spark, [" ".join("x" * (1 + (j + k) % 9) for j in range(30)) for k in range(60)]))
    parts = quality.sketch(table.where("doc_id < 25")).unionByName(quality.sketch(table.where("doc_id >= 25")))
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select("_group", "metric", "bucket", "n").collect())))
    assert rows(quality.merge(parts, ["_group"])) == rows(quality.merge(quality.sketch(table), ["_group"]))


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u and k < mixing.TERMS + 1:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixture(spark):
    table = docs(spark, [f"text {k}" * (k % 5) for k in range(300)], extra=True)
    weights = {"s1": 1.0, "s2": 90.0, None: 1.0}
    rates = {r._source: r for r in mixing.source_rates(table, weights, 3.0).collect()}
    out = mixing.poisson_mix(table, weights, 3.0)
    got = Counter(r.doc_id for r in out.collect())
    for r in table.collect():
        rate = rates.get("\x00null" if r.source is None else r.source)
        n = 0
        for j in range(1, rate.parts + 1) if rate else []:
            u = int(hashlib.md5(f"17|{r.doc_id}|{j}".encode()).hexdigest()[:13], 16) / 2**52
            n += poisson(u, rate.rate / rate.parts)
        assert got[r.doc_id] == n
    assert set(table.columns) <= set(out.columns) and out.count() == mixing.poisson_mix(table, weights, 3.0).count()
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    assert mixing.poisson_mix(table.where("false")).collect() == []


def test_rates_reach_targets(spark):
    table = spark.createDataFrame([(k, "x" * 10, "en", "big" if k % 10 else "small", 10) for k in range(4000)], DOCS)
    shares = Counter(r.source for r in mixing.poisson_mix(table, {"big": 0.5, "small": 0.5}).select("source").collect())
    assert abs(shares["small"] / sum(shares.values()) - 0.5) < 0.05
