"""Secret scans: keyed patterns, and sliding-window entropy, in built-in SQL functions only.

Pattern spans (kinds ``assign``, ``access``, ``hex``) are the leftmost
non-overlapping matches of each pattern, those that are too short dropped.

Entropy spans (kinds ``ent_hex``, ``ent_alnum``, ``ent_base64``): a candidate is
a maximal run of the widest class; its own class is the narrowest that holds all
its characters. A window of ``WINDOW`` characters slides over it while an
accumulator keeps one count per character code: each step takes one count down
and one up and corrects the sum of c*log2(c), from which the entropy follows.
Windows at or over the class's threshold are merged into spans. Candidates on
the allow-list are not looked at; pattern spans are never suppressed.

Defined cases. Null text: empty, no spans. Offsets are code points, ends
exclusive. Texts of any length are scanned whole. Repeated rows are scanned
each; extra columns are kept by ``find_secrets`` and ``redact``, whatever their
names; a column named ``secrets`` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, condition on a match x, or none)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": (ASSIGN, "length(regexp_extract(x.m, {re}, 2)) >= 12"),
    "access": ("AKIA[A-Z0-9]+", "length(x.m) >= 18"),
    "hex": ("[0-9a-f]{16,}", "true"),
}
KINDS = ("assign", "access", "hex", "ent_hex", "ent_alnum", "ent_base64")
WINDOW = 20
#: Candidates: runs of the widest class, a window long at least.
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: class: (pattern of a whole candidate, least bits). The most for a window of 20 is 4.32.
CLASSES = {"ent_hex": ("^[0-9a-fA-F]+$", 3.0), "ent_alnum": ("^[0-9A-Za-z]+$", 3.75), "ent_base64": ("", 3.85)}
#: Candidates that are suppressed: words in one case, slugs and paths of words, UUIDs, placeholders, long runs of one character.
ALLOW = (
    "^[A-Za-z]?[a-z]+$",
    "^[A-Z]+$",
    "^[/_=+-]*[A-Za-z]?[a-z]*(?:[/_=+-]+[A-Za-z]?[a-z]*)+$",
    "^[0-9]+$",
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|changeme|your[_-]?(?:api|token|key|secret)",
    r"(.)\1{9,}",
)

_SPAN = "array<struct<start:int,kind_no:int,stop:int>>"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positions(name: str, pattern: str, what: str) -> str:
    """SQL: for all matches of the pattern, ``what`` (of a.at, x.p, x.m) collected in order."""
    return f"""CASE WHEN size({name}_m) = 0 THEN cast(array() AS {_SPAN}) ELSE
        aggregate(zip_with(split({name}_t, {_lit(pattern)}, -1), {name}_m, (p, m) -> named_struct('p', p, 'm', m)),
          named_struct('at', 0, 'out', cast(array() AS {_SPAN})),
          (a, x) -> named_struct('at', a.at + length(x.p) + coalesce(length(x.m), 0), 'out', {what})).out END"""


def _pattern_spans(kind: str) -> str:
    pattern, condition = PATTERNS[kind]
    new = f"named_struct('start', a.at + length(x.p), 'kind_no', {KINDS.index(kind)}, 'stop', a.at + length(x.p) + length(x.m))"
    what = f"CASE WHEN x.m IS NOT NULL AND {condition.format(re=_lit(pattern))} THEN array_append(a.out, {new}) ELSE a.out END"
    return _positions(kind, pattern, what).replace(f"{kind}_t", "_text")


def _gain(c: str, by: int) -> str:
    """Change of c*log2(c) when a count goes from c to c+by (0*log2(0) is 0)."""
    term = lambda x: f"(({x}) * log2(greatest({x}, 1)))"
    return f"({term(f'{c} + ({by})')} - {term(c)})"


def _bump(counts: str, code: str, by: int) -> str:
    return f"concat(slice({counts}, 1, {code}), array({counts}[{code}] + ({by})), slice({counts}, {code} + 2, 128))"


def _windows() -> str:
    """SQL over x (struct of m, at): the merged spans of windows whose entropy reaches the class's least bits.

    State: counts by character code, s = sum of c*log2(c), the open span (b, e)
    and the closed ones. Step i adds character i and, once the window is full,
    takes character i - WINDOW away.
    """
    new, old = "ascii(substring(x.m, i, 1))", f"ascii(substring(x.m, i - {WINDOW}, 1))"
    shed = f"""CASE WHEN i > {WINDOW} THEN named_struct('n', {_bump('a.n', old, -1)}, 's', a.s + {_gain(f'a.n[{old}]', -1)}) ELSE named_struct('n', a.n, 's', a.s) END"""
    # one step: shed the old character, take the new one, then look at the entropy
    took = f"""transform(array({shed}), q -> named_struct('n', {_bump('q.n', new, 1)}, 's', q.s + {_gain(f'q.n[{new}]', 1)}))[0]"""
    full = f"i >= {WINDOW} AND {float(__import__('math').log2(WINDOW))!r}D - r.s / {WINDOW} >= x.least"
    start = f"x.at + i - {WINDOW}"
    step = f"""transform(array({took}), r -> named_struct('n', r.n, 's', r.s,
        'b', CASE WHEN {full} AND (a.e < {start}) THEN {start} ELSE a.b END,
        'e', CASE WHEN {full} THEN x.at + i ELSE a.e END,
        'out', CASE WHEN {full} AND a.e >= 0 AND a.e < {start}
               THEN array_append(a.out, named_struct('start', a.b, 'kind_no', x.kind_no, 'stop', a.e)) ELSE a.out END))[0]"""
    zero = f"named_struct('n', array_repeat(0, 128), 's', 0.0D, 'b', -1, 'e', -1, 'out', cast(array() AS {_SPAN}))"
    last = f"CASE WHEN z.e >= 0 THEN array_append(z.out, named_struct('start', z.b, 'kind_no', x.kind_no, 'stop', z.e)) ELSE z.out END"
    return f"aggregate(sequence(1, length(x.m)), {zero}, (a, i) -> {step}, z -> {last})"


def _candidates(allow: Sequence[str]) -> str:
    """SQL: the candidates' start and end, allow-listed ones dropped, with the class as kind."""
    kind = "CASE " + " ".join(f"WHEN x.m RLIKE {_lit(p)} THEN {KINDS.index(k)}" for k, (p, _) in CLASSES.items() if p) + f" ELSE {KINDS.index('ent_base64')} END"
    allowed = " OR ".join(f"x.m RLIKE {_lit(p)}" for p in allow) or "false"
    new = f"named_struct('start', a.at + length(x.p), 'kind_no', {kind}, 'stop', a.at + length(x.p) + length(x.m))"
    what = f"CASE WHEN x.m IS NOT NULL AND NOT ({allowed}) THEN array_append(a.out, {new}) ELSE a.out END"
    return _positions("cand", CANDIDATE, what).replace("cand_t", "_text")


def find_secrets(docs: DataFrame, text: str = "text", allow: Sequence[str] = ALLOW) -> DataFrame:
    """``docs`` with ``secrets``: array of (start, kind_no, stop), by start and then kind. No shuffle."""
    docs = docs.drop("secrets")
    found = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, (pattern, _) in PATTERNS.items():
        found = found.withColumn(f"{kind}_m", F.expr(f"regexp_extract_all(_text, {_lit(pattern)}, 0)"))
    found = found.withColumn("cand_m", F.expr(f"regexp_extract_all(_text, {_lit(CANDIDATE)}, 0)"))
    spans = [_pattern_spans(kind) for kind in PATTERNS]
    found = found.withColumn("_base", F.expr(f"concat({', '.join(spans)})")).withColumn("_cand", F.expr(_candidates(allow)))
    least = "CASE c.kind_no " + " ".join(f"WHEN {KINDS.index(k)} THEN {b}D" for k, (_, b) in CLASSES.items()) + " END"
    runs = f"transform(_cand, c -> named_struct('m', substring(_text, c.start + 1, c.stop - c.start), 'at', c.start, 'kind_no', c.kind_no, 'least', {least}))"
    entropy = f"CASE WHEN size(_cand) = 0 THEN cast(array() AS {_SPAN}) ELSE flatten(transform({runs}, x -> {_windows()})) END"
    found = found.withColumn("secrets", F.expr(f"array_sort(concat(_base, {entropy}))"))
    return found.select("_row.*", "secrets")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``secrets`` (overlapping ones as one) by ``<kind>`` of its first; drops ``secrets``."""
    names = "array(" + ", ".join(f"'<{k}>'" for k in KINDS) + ")"
    merged = """aggregate(secrets, named_struct('at', 0, 'out', ''),
        (a, x) -> CASE WHEN x.stop <= a.at THEN a
                       WHEN x.start < a.at THEN named_struct('at', x.stop, 'out', a.out)
                       ELSE named_struct('at', x.stop, 'out', concat(a.out, substring({t}, a.at + 1, x.start - a.at), {n}[x.kind_no])) END,
        z -> concat(z.out, substring({t}, z.at + 1)))""".format(t=f"`{text}`", n=names)
    return found.withColumn(text, F.expr(f"CASE WHEN size(secrets) = 0 THEN `{text}` ELSE {merged} END")).drop("secrets")


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind_no], ':', x.start, ':', x.stop)), ',')")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, with counts and spans by kind."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.expr(f"cast(size(filter(secrets, x -> x.kind_no = {KINDS.index(k)})) AS bigint)")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in PATTERNS),
        F.sha2(_joined(f"filter(secrets, x -> x.kind_no < {len(PATTERNS)})"), 256).alias("base_sha256"),
        _joined("secrets").alias("spans"),
    )
