"""Quality rules: counts per text and a learned list of decisions.

Counts are SQL expressions. Rules are learned by sequential covering: a rule
is a conjunction of threshold conditions, grown greedily by information gain on
two thirds of the labelled documents and pruned from its end on the rest; what
it covers is set aside and the next rule is grown. The list becomes one ``CASE``
expression: the first rule that holds drops a text, and a text no rule holds
for is kept.

The learner never sees rows. Each feature is cut at ``CUTS`` values (quantiles
within each label); documents are counted per combination of intervals, at most
``(CUTS + 1) ** 6`` rows whatever the size of the corpus, and rules are grown
on these counts. All labelled documents are counted.

Null texts have no words. Labels that are null or whose document is missing are
not counted; several labels of one document each count. Without labels of both
values there are no rules and only the base test decides. Repeated rows get
equal results. Ties between conditions go to the first feature and lowest cut.
An empty table of documents gives no rows.
"""

from math import log2

from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.arrays import bound

CUTS = 8
PURE = 0.99
PRECISION = 0.9
LEAST = 5
MAX_RULES = 12
MAX_CONDITIONS = 4
SPACE = r"\x20\x09-\x0D"
_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / word_chars",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "capitals": "n_capitals / word_chars",
}


def _repeat_words(words: str) -> str:
    """Words in three-word windows that stand twice or more in the text.

    Windows are sorted by hash; neighbours with equal hashes repeat. Their
    places, in order, each cover three words.
    """
    hashes = "transform(sequence(0, n - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))"
    ordered = "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    places = ("array_sort(filter(transform(s, (x, k) -> if((k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < n - 3 and "
              "s[least(k + 1, n - 3)].h = x.h), x.i, null)), p -> p is not null))")
    covered = (f"aggregate({places}, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), "
               "'last', p), a -> a.n)")
    some = bound("h", hashes, f"if(size(array_distinct(h)) = size(h), 0L, {bound('s', ordered, covered)})")
    return bound("ws", words, bound("n", "size(ws)", f"if(n < 3, 0L, {some})"))


def counts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed."""
    split = rf"filter(split(_text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    lines = f"filter(split(_text, '\\n', -1), l -> translate(l, {_BLANKS}, '') <> '')"
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = texts.selectExpr(
        "doc_id",
        bound("ws", split, f"named_struct('n', cast(size(ws) as bigint), 'r', {_repeat_words('ws')})") + " as _w",
        f"cast(length(translate(_text, {_BLANKS}, '')) as bigint) as word_chars",
        "cast(length(_text) - length(translate(_text, '#*$%&|<>', '')) as bigint) as n_symbols",
        bound("ls", lines, "named_struct('n', cast(size(ls) as bigint), 'd', cast(size(ls) - size(array_distinct(ls)) as bigint))") + " as _l",
        f"cast(length(_text) - length(translate(_text, '{capitals}', '')) as bigint) as n_capitals")
    return found.selectExpr(
        "doc_id", "_w.n as n_words", "word_chars", "n_symbols", "_l.d as n_dup_lines", "_w.r as n_repeat_words", "_l.n as n_lines",
        "n_capitals", "_w.n < 50 or 100 * _w.r > 50 * _w.n as base_failed")


def features(counted: DataFrame) -> DataFrame:
    """The counts with one column per feature; shares of nothing are 0."""
    return counted.selectExpr("*", *[f"coalesce(try_divide({e.replace(' / ', ', ')}), 0D) as f_{k}" if " / " in e else f"{e} as f_{k}"
                                     for k, e in FEATURES.items()])


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gain of a condition that leaves p of p0 and n of n0."""
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0))) if p else 0.0


def learn(cells: list[tuple], names: list[str], cuts: dict[str, list[float]]) -> list[list[tuple[str, str, float]]]:
    """Ordered rules (feature, operator, threshold) from cells (intervals..., bad grown, good grown, bad pruned, good pruned).

    Interval ``i`` of a feature holds the values from its cut ``i - 1`` up to,
    not including, cut ``i``.
    """
    width = len(names)
    options = [(k, op, i) for k, name in enumerate(names) for i in range(len(cuts[name])) for op in ("<", ">=")]

    def holds(cell, condition):
        k, op, i = condition
        return cell[k] <= i if op == "<" else cell[k] > i

    def total(part, column):
        return sum(c[width + column] for c in part)

    rules, left = [], cells
    while len(rules) < MAX_RULES:
        rule, part = [], left
        while len(rule) < MAX_CONDITIONS:
            bad, good = total(part, 0), total(part, 1)
            if not bad or bad / (bad + good) >= PURE:
                break
            best, gain = None, 1e-9
            for option in options:
                inside = [c for c in part if holds(c, option)]
                g = _gain(bad, good, total(inside, 0), total(inside, 1))
                if g > gain:
                    best, gain = option, g
            if best is None:
                break
            rule.append(best)
            part = [c for c in part if holds(c, best)]
        pruned, score = rule, -2.0
        for k in range(len(rule), 0, -1):
            inside = [c for c in left if all(holds(c, x) for x in rule[:k])]
            bad, good = total(inside, 2), total(inside, 3)
            if bad + good and (bad - good) / (bad + good) >= score:  # of equals the shorter
                pruned, score = rule[:k], (bad - good) / (bad + good)
        inside = [c for c in left if all(holds(c, x) for x in pruned)]
        bad, good = total(inside, 0) + total(inside, 2), total(inside, 1) + total(inside, 3)
        if not pruned or bad < LEAST or (bad + 1) / (bad + good + 2) < PRECISION:
            break
        rules.append([(names[k], op, cuts[names[k]][i]) for k, op, i in pruned])
        left = [c for c in left if not all(holds(c, x) for x in pruned)]
    return rules


def learn_rules(featured: DataFrame, labels: DataFrame) -> list[list[tuple[str, str, float]]]:
    """Rules that tell documents of quality 0 from those of quality 1."""
    names = list(FEATURES)
    marked = featured.join(labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality"))
                           .filter("_quality in (0, 1)"), F.col("doc_id") == F.col("_id"))
    marked = store.write(marked.select("_quality", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).alias("_prune"),
                                       *[f"f_{k}" for k in names]))
    shares = ", ".join(f"{(i + 0.5) / (CUTS / 2)}D" for i in range(CUTS // 2))
    found = marked.groupBy("_quality").agg(*[F.expr(f"percentile_approx(f_{k}, array({shares}), 10000) as f_{k}") for k in names]).collect()
    if len(found) < 2:
        return []
    cuts = {k: sorted({v for row in found for v in row[f"f_{k}"]}) for k in names}
    interval = [" + ".join(f"if(f_{k} >= {c!r}D, 1, 0)" for c in cuts[k]) + f" as i_{k}" for k in names]
    cells = (marked.selectExpr("_quality", "_prune", *interval).groupBy(*[f"i_{k}" for k in names]).agg(
        *[F.expr(f"count_if({'not ' * (1 - p)}_prune and _quality = {q}) as c{p}{q}") for p in (0, 1) for q in (0, 1)]).collect())
    return learn(sorted(tuple(r) for r in cells), names, cuts)


def decision(rules: list[list[tuple[str, str, float]]]) -> str:
    """The list of rules as one ordered SQL expression: true keeps."""
    if not rules:
        return "true"
    arms = " ".join("when " + " and ".join(f"f_{k} {op} {v!r}D" for k, op, v in rule) + " then false" for rule in rules)
    return f"case {arms} else true end"


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept."""
    counted = store.write(counts(docs))
    featured = features(counted)
    rules = learn_rules(featured, labels)
    return featured.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                               f"not base_failed and {decision(rules)} as kept")
