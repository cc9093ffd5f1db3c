"""Dispersion of ratings on an ordered scale, as SQL expressions on level counts.

* consensus: Tastle & Wierman (2007), 1 = all in one level, 0 = split between the ends
* agreement: van der Eijk (2001), 1 = all in one level, 0 = uniform, -1 = split between the ends
"""

from itertools import combinations


def consensus(counts: list[str]) -> str:
    """Null when all counts are 0."""
    width = len(counts) - 1
    total = f"({' + '.join(counts)})"
    mean = f"try_divide({' + '.join(f'{i}e0 * {c}' for i, c in enumerate(counts))}, {total})"
    terms = " + ".join(
        f"if({c} > 0, {c} / {total} * log2(1 - abs({i} - {mean}) / {width}e0), 0e0)" for i, c in enumerate(counts))
    return f"if({total} > 0, 1e0 + {terms}, null)"


def pattern_agreement(pattern: tuple[int, ...]) -> float:
    """Agreement of a 0/1 pattern: unimodality of its triples, scaled by how wide it is."""
    k, ones = len(pattern), sum(pattern)
    if ones in (0, 1, k):
        unimodality = 1.0
    else:
        triples = [(pattern[a], pattern[b], pattern[c]) for a, b, c in combinations(range(k), 3)]
        fits = sum(t in ((1, 1, 0), (0, 1, 1)) for t in triples)
        breaks = sum(t == (1, 0, 1) for t in triples)
        unimodality = ((k - 2) * fits - (k - 1) * breaks) / ((k - 2) * (fits + breaks))
    return unimodality * (1 - (ones - 1) / (k - 1)) if ones else 0.0


def agreement(counts: list[str]) -> str:
    """Weighted mean of the agreement of the layers of the count profile.

    Layer j keeps the levels whose count reaches the j-th smallest count. Its
    0/1 pattern indexes a constant table with 2**k entries. Null when all
    counts are 0.
    """
    k = len(counts)
    table = ", ".join(f"{pattern_agreement(tuple(code >> i & 1 for i in range(k)))!r}D" for code in range(2 ** k))
    ordered = f"sort_array(array({', '.join(counts)}))"
    layers = []
    for j in range(k):
        height = f"{ordered}[{j}]"
        below = f"{ordered}[{j - 1}]" if j else "0"
        pattern = " + ".join(f"if({c} >= {height}, {1 << i}, 0)" for i, c in enumerate(counts))
        # k - j levels reach this height unless it ties with the one below, where the weight is 0
        layers.append(f"({height} - {below}) * {k - j} * array({table})[{pattern}]")
    return f"try_divide({' + '.join(layers)}, {' + '.join(counts)})"
