"""Row-level expressions as Spark SQL text.

Each function takes column names (or other expressions) and returns SQL text
for ``F.expr``, ``selectExpr`` and ``filter``. A whole expression is parsed in
one call, and Catalyst sees the same tree as with column objects; everything
here is covered by generated code.
"""

import re

from acuity import schema as S


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(expression: str, values: list[str]) -> str:
    return f"({expression}) in ({', '.join(map(literal, values))})"


def not_in(expression: str, values: list[str]) -> str:
    """NOT IN that keeps null values."""
    return f"coalesce(not {one_of(expression, values)}, true)"


def hours_between(later: str, earlier: str) -> str:
    """Fractional hours, so that 24 h and 24.01 h fall on different sides of an edge."""
    return f"(unix_micros(cast({later} as timestamp)) - unix_micros(cast({earlier} as timestamp))) / 3.6e9"


def booking_period(hours: str) -> str:
    return (f"case when {hours} <= 24 then '{S.SAME_DAY}' when {hours} <= 168 then '{S.SAME_WEEK}' "
            f"when {hours} > 168 then '{S.OVER_WEEK}' end")


def collapse_priority(raw: str, mapping: dict[str, list[str]] = S.PRIORITY_LEVELS) -> str:
    """Raw priority text to an urgency level; text that is not listed gives null."""
    return "case " + " ".join(f"when {one_of(raw, texts)} then {literal(level)}" for level, texts in mapping.items()) + " end"


def level_rank(level: str, levels: list[str] = S.LEVELS) -> str:
    """1-based position of a level, for sorting; null for a null or unknown level."""
    return f"cast(nullif(array_position(array({', '.join(map(literal, levels))}), {level}), 0) as int)"


def fold_top_level(level: str) -> str:
    return f"if({level} = {literal(S.LEVELS[0])}, {literal(S.LEVELS[1])}, {level})"


def rater_pseudonym(name: str) -> str:
    """A missing name is hashed as well, so it counts as one rater."""
    return f"md5(coalesce(cast({name} as string), 'NA'))"


def code_stem(code: str) -> str:
    """Leading character and two digits; the empty string if the code has another form."""
    return rf"regexp_extract({code}, r'^.\d\d', 0)"


def is_injury(code: str) -> str:
    return f"coalesce({one_of(f'left({code}, 1)', S.INJURY_LETTERS)}, false)"


def is_mechanism(code: str) -> str:
    return f"coalesce({one_of(f'left({code}, 1)', S.MECHANISM_LETTERS)}, false)"


def remove_first(text: str, piece: str) -> str:
    """Drop the first occurrence of ``piece`` only."""
    return f"regexp_replace({text}, r'(?s)^(.*?){re.escape(piece)}', '$1')"


def specialty_group(specialty: str) -> str:
    name = remove_first(specialty, S.SPECIALTY_SUFFIX)
    groups = " ".join(f"when {one_of(name, members)} then {literal(group)}" for group, members in S.SPECIALTY_GROUPS.items())
    return f"case {groups} else {name} end"


def age_group(age: str) -> str:
    paeds, adult, elderly = S.AGE_GROUPS
    return (f"case when {age} < {S.ADULT_FROM} then '{paeds}' when {age} < {S.ELDERLY_FROM} then '{adult}' "
            f"when {age} >= {S.ELDERLY_FROM} then '{elderly}' end")


def urgent_outcome(level: str) -> str:
    """A missing level counts as not urgent."""
    return f"if(coalesce({one_of(level, S.LEVELS[:2])}, false), '{S.URGENT}', '{S.NOT_URGENT}')"


def percent(part: str, whole: str, digits: int | None = 1) -> str:
    """100 * part / whole, half-even to ``digits`` decimals; exact if ``digits`` is None.

    Rounding happens on the scaled integer ratio, so ties are true ties. Null
    when ``whole`` is 0.
    """
    if digits is None:
        return f"try_divide(({part}) * 1e2, {whole})"
    return f"bround(try_divide(({part}) * 1e{2 + digits}, {whole}), 0) / 1e{digits}"
