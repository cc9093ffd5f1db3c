"""Secrets in texts: three patterns, and tokens that pass a battery of randomness tests.

Base spans are the leftmost non-overlapping matches of three patterns. Other
tokens of 20 or more characters that mix letters and digits, or letters of
both cases, are candidates. Their encoding is inferred (hex, base32, base62,
base64, letters) and three tests ask whether their characters could be drawn at random from its alphabet:

* chi-squared: are all characters equally frequent?
* runs: how often does the sequence cross the middle of the alphabet?
* serial correlation: does a character tell the next one?

Fisher's method joins the three p-values. Within each class of length the
procedure of Benjamini and Hochberg picks the tokens that are *not* random,
so that at most ``FALSE_RATE`` of those it rejects are random in truth; short
and long tokens, for which the tests have different power, do not share a
threshold. This bounds the random tokens that are lost, not the tokens among
the added ones that are no secrets. Tokens that are not rejected are added as
kind ``random``, unless they touch or overlap a base span. Ties of p-values
share a step of the histogram and fall on the same side. The work grows with
the length of a text.

An empty table gives an empty one. Null and empty texts have no spans. Offsets are code points, ends exclusive.
Repeated rows get equal results; each counts in the rejection thresholds.
Everything is DataFrame and SQL expressions; the driver sees one histogram of
at most ``BINS`` steps per class of length.
"""

from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.arrays import bound, matches

FALSE_RATE = 0.05
BINS = 300
KINDS = ("assign", "access", "hex", "random")
# fixed values: patterns of the base spans
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# base spans are filled with U+0001 before tokens are looked for: a token that touches one is none
FILL = "\u0001"
TOKEN = r"(?<![\x01A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?!\x01)"
DIGITS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
          "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
DIGITS["letters"] = DIGITS["base62"][10:]
DIGITS["base64"] = DIGITS["base62"] + "+/"
CLASSES = (24, 32, 48, 64, 128)


def _alphabet(m: str) -> str:
    """Alphabet of the inferred encoding of a token; null where nothing is inferred."""
    return (f"case when {m} rlike '^[A-Za-z]+=*$' and {m} rlike '[A-Z]' and {m} rlike '[a-z]' then '{DIGITS['letters']}' "
            f"when not ({m} rlike '[0-9]' and {m} rlike '[A-Za-z]') then null "
            f"when {m} rlike '^([0-9a-f]+|[0-9A-F]+)$' then '{DIGITS['hex']}' "
            f"when {m} rlike '^[A-Z2-7]+=*$' then '{DIGITS['base32']}' "
            f"when {m} rlike '^[A-Za-z0-9]+$' then '{DIGITS['base62']}' else '{DIGITS['base64']}' end")


def _tail(z: str) -> str:
    """Upper tail of the normal distribution, logistic form."""
    return f"1 / (1 + exp(least(700D, 1.5976D * ({z}) + 0.070565992D * pow({z}, 3))))"


def _p_value(m: str, alphabet: str) -> str:
    """Joined p-value of the battery for a token."""
    folded = f"if({alphabet} = '{DIGITS['hex']}', lower({m}), translate(rtrim('=', {m}), '-_', '+/'))"
    codes = f"transform(split({folded}, ''), c -> locate(c, {alphabet}) - 1)"
    n, k = "cast(size(c) as double)", f"cast(length({alphabet}) as double)"
    # counts of equal codes from the sorted codes: the square sum of the run lengths
    squares = ("aggregate(array_sort(c), named_struct('x', -1, 'r', 0D, 's', 0D), (a, y) -> if(a.x = y, "
               "named_struct('x', y, 'r', a.r + 1D, 's', a.s), named_struct('x', y, 'r', 1D, 's', a.s + a.r * a.r)), a -> a.s + a.r * a.r)")
    chi = f"(pow(greatest({k} / {n} * {squares} - {n}, 0D) / ({k} - 1), 1 / 3D) - (1 - 2 / (9 * ({k} - 1)))) / sqrt(2 / (9 * ({k} - 1)))"
    sides = f"transform(c, x -> if(x * 2 >= {k}, 1, 0))"
    runs = bound("h", sides, bound("u", "aggregate(h, 0D, (a, x) -> a + x)", (
        f"if(u = 0 or u = {n}, 9D, {bound('w', f'1 + 2 * u * ({n} - u) / {n}', _runs_z(n))})")))
    mean = f"(aggregate(c, 0D, (a, x) -> a + x) / {n})"
    products = "aggregate(c, named_struct('p', cast(null as double), 's', 0D, 'q', 0D), (a, x) -> named_struct('p', x - e, " \
               "'s', a.s + coalesce(a.p * (x - e), 0D), 'q', a.q + (x - e) * (x - e)), a -> if(a.q = 0, 1D, a.s / a.q))"
    serial = f"abs({bound('e', mean, products)} * sqrt({n}) + 1 / sqrt({n}))"
    logs = " + ".join(f"ln(greatest({p}, 1e-300D))" for p in (_tail(chi), f"2 * ({_tail(runs)})", f"2 * ({_tail(serial)})"))
    fisher = bound("x", f"greatest(-({logs}), 0D)", "exp(-x) * (1 + x + x * x / 2)")
    return bound("c", codes, fisher)


def _runs_z(n: str) -> str:
    crossings = "aggregate(h, named_struct('p', -1, 'r', 0D), (a, x) -> named_struct('p', x, 'r', a.r + if(x = a.p, 0D, 1D)), a -> a.r)"
    return f"abs({crossings} - w) / sqrt(greatest((w - 1) * (w - 2) / ({n} - 1), 1e-9D))"


def _kind(spans: str, kind: int) -> str:
    return f"transform({spans}, s -> named_struct('start', s.start, 'kind', {kind}, 'end', s.end))"


def _written(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def length_class(n: str) -> str:
    return " + ".join(f"if({n} >= {c}, 1, 0)" for c in CLASSES)


def _filled(text: str, pattern: str, counts: str = "true") -> str:
    """The text with each match ``m`` that counts replaced by as many fill characters, put together from the cuts."""
    p = f"'{_quoted(pattern)}'"
    fill = f"transform(regexp_extract_all({text}, {p}, 0), m -> if({counts}, repeat('{FILL}', length(m)), m))"
    joined = f"array_join(zip_with(split({text}, {p}, -1), {fill}, (g, m) -> concat(g, coalesce(m, ''))), '')"
    return f"if({text} rlike {p}, {joined}, {text})"


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans and candidates with their p-values. One pass over the texts."""
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    assign = f"filter({matches('text', ASSIGN)}, s -> length(regexp_extract(s.m, '{_quoted(ASSIGN)}', 2)) >= 12)"
    found = texts.selectExpr("doc_id", f"{assign} as _a", f"{matches('text', ACCESS)} as _k", f"{matches('text', HEX)} as _h", "text")
    # one kind after the other, in the same order: what is left of a span that overlaps another one touches its fill
    long = f"length(regexp_extract(m, '{_quoted(ASSIGN)}', 2)) >= 12"
    for pattern, counts in ((ASSIGN, long), (ACCESS, "true"), (HEX, "true")):
        found = found.withColumn("text", F.expr(_filled("text", pattern, counts)))
    found = found.selectExpr("doc_id", "_a", "_k", "_h", f"{matches('text', TOKEN)} as _t")
    base = found.selectExpr(
        "doc_id", "cast(size(_a) as bigint) as n_assign", "cast(size(_k) as bigint) as n_access", "cast(size(_h) as bigint) as n_hex",
        f"concat({_kind('_a', 0)}, {_kind('_k', 1)}, {_kind('_h', 2)}) as base", "_t")
    fresh = f"filter(transform(_t, s -> named_struct('start', s.start, 'end', s.end, 'm', s.m, 'a', {_alphabet('s.m')})), s -> s.a is not null)"
    rated = ("transform(_t, s -> named_struct('start', s.start, 'end', s.end, "
             f"'cls', {length_class('(s.end - s.start)')}, 'p', {_p_value('s.m', 's.a')}))")
    return (base.withColumn("_t", F.expr(fresh))
            .selectExpr("doc_id", "n_assign", "n_access", "n_hex", "base", f"{rated} as candidates"))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def thresholds(scanned: DataFrame, rate: float = FALSE_RATE) -> list[float]:
    """For each class of length, the p-value up to which a token counts as not random."""
    steps = f"least({BINS}, cast(ceil(-ln(greatest(c.p, 1e-120D)) * 1.25D) as int))"
    counts = (scanned.selectExpr("explode(candidates) as c").selectExpr("c.cls", f"{steps} as step")
              .groupBy("cls", "step").agg(F.count("*").alias("n")).collect())
    out = []
    for cls in range(len(CLASSES) + 1):
        mine = sorted(((r["step"], r["n"]) for r in counts if r["cls"] == cls), reverse=True)
        total, seen, limit = sum(n for _, n in mine), 0, 0.0
        for step, n in mine:
            seen += n
            top = 2.718281828459045 ** (-(step - 1) / 1.25)  # all p-values of the step are below this
            if top <= rate * seen / total:
                limit = top
        out.append(limit)
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """Per row: doc_id, base counts per kind, digest of the base spans, all spans, number of added spans."""
    scanned = store.write(scan(docs))
    limits = "array(" + ", ".join(f"{x!r}D" for x in thresholds(scanned, rate)) + ")"
    added = f"filter(candidates, c -> c.p > {limits}[c.cls])"
    return scanned.selectExpr(
        "doc_id", "n_assign", "n_access", "n_hex", f"sha2({_written('base')}, 256) as base_sha256",
        f"{_written(f'concat(base, {_kind(added, 3)})')} as spans", f"cast(size({added}) as bigint) as n_added")
