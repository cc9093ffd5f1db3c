"""SQL text for regular-expression matches with their places, inside one row."""

BLOCK = 256


def bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sums(values: str) -> str:
    """Running sums of an array of numbers.

    Sums of blocks come first, so that the work grows with the length of the
    array and not with its square.
    """
    blocks = f"transform(sequence(0, cast((size(v) - 1) div {BLOCK} as int)), b -> slice(v, b * {BLOCK} + 1, {BLOCK}))"
    totals = "transform(p, part -> aggregate(part, 0L, (s, x) -> s + x))"
    offsets = "aggregate(t, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    inner = "transform(part, (x, i) -> o[b] + aggregate(slice(part, 1, i + 1), 0L, (s, y) -> s + y))"
    sums = bound("p", blocks, bound("t", totals, bound("o", offsets, f"flatten(transform(p, (part, b) -> {inner}))")))
    return bound("v", values, f"if(size(v) = 0, array(), {sums})")


def matches(text: str, pattern: str) -> str:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches of a pattern in a text column.

    The text is cut at the matches; lengths of the cuts and of the matches add
    up to the places. Code points, ends exclusive.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"regexp_extract_all({text}, {p}, 0)"
    steps = f"zip_with(ms, slice(split({text}, {p}, -1), 1, size(ms)), (m, g) -> cast(length(m) + length(g) as bigint))"
    spans = "zip_with(ms, e, (m, x) -> named_struct('start', x - length(m), 'end', x, 'm', m))"
    none = "cast(array() as array<struct<start: bigint, end: bigint, m: string>>)"
    return f"if({text} rlike {p}, {bound('ms', found, bound('e', running_sums(steps), spans))}, {none})"
