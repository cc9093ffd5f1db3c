"""The registered queries once more, as ANSI SQL over the same tables.

Written from the definitions, not from the Spark plans: cohort rules as numeric
ranges, agreement layer by layer, the interval by bisection of binomial sums.
"""

# --- shared table expressions ------------------------------------------------
_LEVEL_OF_PRIORITY = """CASE o_orderpriority WHEN '1-URGENT' THEN '<1hr' WHEN '2-HIGH' THEN '<4hrs'
    WHEN '3-MEDIUM' THEN '<8hrs' WHEN '4-NOT SPECIFIED' THEN '<24hrs' WHEN '5-LOW' THEN '<72hrs' END"""


def _diagnosis(k, prime):
    code = (f"chr(65 + CAST((o_orderkey * {prime} + o_custkey) % 26 AS INT)) || "
            f"lpad(CAST((o_orderkey + {k} * 37 * o_custkey) % 100 AS VARCHAR), 2, '0')")
    if k == 2:
        return f"CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 0 THEN '' ELSE {code} END"
    return code


ADM = f"""adm AS (SELECT o_orderkey AS study_id, CAST((o_custkey * 7) % 97 AS DOUBLE) AS age,
    CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, o_orderstatus AS asa, o_custkey AS patient,
    o_orderdate AS admitted, o_orderpriority, {_LEVEL_OF_PRIORITY} AS base_level FROM orders)"""

_LABEL = "CASE WHEN ({0}) % 11 = 0 THEN NULL WHEN ({0}) % 4 = 0 THEN 'no' ELSE 'yes' END"

RAT = f"""{ADM}, rat AS (SELECT l_orderkey AS study_id, l_partkey AS booked_procedure,
    l_suppkey AS procedural_consultant, l_linenumber, l_extendedprice, l_shipdate, adm.* EXCLUDE (study_id),
    CASE WHEN (l_orderkey * 31 + l_linenumber * 17) % 100 < l_partkey % 100
         THEN CASE WHEN l_orderkey % 3 = 0 THEN '<1hr' ELSE '<4hrs' END ELSE base_level END AS lvl,
    l_shipdate <= admitted + INTERVAL 24 HOUR AS same_day, l_linenumber = 1 AS primary_proc,
    {_LABEL.format('l_partkey + l_orderkey')} AS correct
    FROM lineitem JOIN adm ON l_orderkey = adm.study_id)"""

DIAG = "diag AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS study_id, o_custkey AS patient, {k} AS position, lower({_diagnosis(k, p)}) AS code FROM orders"
    for k, p in ((1, 3), (2, 5), (3, 7), (4, 11))) + ")"


def _kept(padded=False):
    low = "num IN (6, 7) OR " if padded else ""
    low_u = "num IN (4, 6, 7) OR " if padded else ""
    return f"""{DIAG}, parts AS (SELECT *, substr(code, 1, 1) AS letter, TRY_CAST(substr(code, 2, 2) AS INT) AS num
    FROM diag WHERE code <> ''),
kept AS (SELECT * FROM parts WHERE NOT coalesce(
    (letter = 't' AND (num BETWEEN 36 AND 65 OR num IN (74, 78) OR num BETWEEN 80 AND 88 OR num BETWEEN 90 AND 98))
    OR (letter = 'y' AND ({low}num BETWEEN 10 AND 19 OR num IN (36, 37) OR num BETWEEN 40 AND 98))
    OR (letter = 'u' AND ({low_u}num BETWEEN 78 AND 92))
    OR (letter = 'x' AND num BETWEEN 40 AND 49), false))"""


_IS_TRAUMA = "letter IN ('s', 't', 'u', 'v', 'w', 'x')"
FIRST = f"""{_kept()}, firsts AS (SELECT study_id FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY position) AS rn
    FROM kept) WHERE rn = 1 AND {_IS_TRAUMA})"""
ANY = f"{_kept()}, anys AS (SELECT DISTINCT study_id FROM kept WHERE {_IS_TRAUMA})"

EXC = """exc AS (SELECT DISTINCT p_partkey AS code FROM part
    WHERE p_type LIKE '%SMALL%' OR p_type LIKE '%PROMO%' OR p_size BETWEEN 41 AND 50
    UNION SELECT unnest(CAST([7, 11, 13, 1000000000000] AS BIGINT[])))"""

EPI = f"""{RAT}, epi AS (SELECT rat.*, booked_procedure AS p0, procedural_consultant AS p1,
    CASE WHEN l_linenumber % 3 <> 0 THEN procedural_consultant * 20 + l_linenumber END AS p2 FROM rat),
long AS (SELECT *, p0 AS code, 0 AS place FROM epi UNION ALL SELECT *, p1, 1 FROM epi
    UNION ALL SELECT *, p2, 2 FROM epi WHERE p2 IS NOT NULL),
lab AS (SELECT study_id, code, {_LABEL.format('code + study_id')} AS correct, bool_or(place = 0) AS is_primary
    FROM long GROUP BY study_id, code),
att AS (SELECT long.* EXCLUDE (correct, primary_proc), lab.correct, lab.is_primary AS primary_proc
    FROM long LEFT JOIN lab USING (study_id, code))"""


def _pct(k, n):
    return f"(round_even(1e3 * ({k}) / ({n}), 0) / 1e1)"


N = ["n_1", "n_4", "n_8", "n_24", "n_72"]
LEVELS = ["<1hr", "<4hrs", "<8hrs", "<24hrs", "<72hrs"]


def _count(source, keys="booked_procedure", trauma="true"):
    counts = ", ".join(f"count(*) FILTER (lvl = '{lv}') AS {n}" for lv, n in zip(LEVELS, N))
    return (f"cnt AS (SELECT {keys}, {counts}, bool_or({trauma}) AS trauma, bool_or(coalesce(primary_proc, false)) AS primary_proc "
            f"FROM {source} GROUP BY ALL HAVING count(lvl) > 0)")


_V = ["(n_1 + n_4)", "n_8", "n_24", "n_72"]
_MU = "((n_8 + 2e0 * n_24 + 3e0 * n_72) / (n_1 + n_4 + n_8 + n_24 + n_72))"
CONSENSUS = "(1e0 + " + " + ".join(
    f"CASE WHEN {v} > 0 THEN ({v} / CAST(n_1 + n_4 + n_8 + n_24 + n_72 AS DOUBLE)) * log2(1 - abs({i} - {_MU}) / 3e0) ELSE 0 END"
    for i, v in enumerate(_V)) + ")"


def _agreement(keys):
    """Agreement per row of ``cnt``, summed over the layers of the count profile."""
    k = ", ".join(keys)
    return f"""cells AS (SELECT {k}, {_V[0]} AS a, n_8 AS b, n_24 AS c, n_72 AS d, n_1 + n_4 + n_8 + n_24 + n_72 AS total FROM cnt),
heights AS (SELECT DISTINCT {k}, h FROM (SELECT {k}, unnest([a, b, c, d]) AS h FROM cells) WHERE h > 0),
layers AS (SELECT {k}, h, h - coalesce(lag(h) OVER (PARTITION BY {k} ORDER BY h), 0) AS thick FROM heights),
pats AS (SELECT {k}, thick, total, CAST(a >= h AS INT) AS a, CAST(b >= h AS INT) AS b, CAST(c >= h AS INT) AS c,
    CAST(d >= h AS INT) AS d FROM layers JOIN cells USING ({k})),
tri AS (SELECT *, a + b + c + d AS s,
    CAST(a=1 AND b=1 AND c=0 OR a=0 AND b=1 AND c=1 AS INT) + CAST(a=1 AND b=1 AND d=0 OR a=0 AND b=1 AND d=1 AS INT)
    + CAST(a=1 AND c=1 AND d=0 OR a=0 AND c=1 AND d=1 AS INT) + CAST(b=1 AND c=1 AND d=0 OR b=0 AND c=1 AND d=1 AS INT) AS tu,
    CAST(a=1 AND b=0 AND c=1 AS INT) + CAST(a=1 AND b=0 AND d=1 AS INT) + CAST(a=1 AND c=0 AND d=1 AS INT)
    + CAST(b=1 AND c=0 AND d=1 AS INT) AS tdu FROM pats),
agr AS (SELECT {k}, sum(thick * s * (CASE WHEN s IN (1, 4) THEN 1e0 ELSE (2e0 * tu - 3 * tdu) / (2e0 * (tu + tdu)) END)
    * (1 - (s - 1) / 3e0)) / CAST(any_value(total) AS DOUBLE) AS agreement FROM tri GROUP BY {k})"""


def _interval(hits):
    """Text of the exact 95 % interval per distinct (k, n): 45 halvings of the two tail equations."""
    def tail(p, low, high):
        return (f"list_sum(list_transform(range({low}, {high}), lambda i: exp(lgamma(n + 1e0) - lgamma(i + 1e0) "
                f"- lgamma(n - i + 1e0) + i * ln({p}) + (n - i) * ln(1 - {p}))))")
    low_mid, high_mid = "((llo + lhi) / 2)", "((hlo + hhi) / 2)"
    under = f"({tail(low_mid, 'k', 'n + 1')} < 0.025)"
    over = f"({tail(high_mid, '0', 'k + 1')} > 0.025)"
    return f"""pairs AS (SELECT DISTINCT {hits} AS k, n_1 + n_4 + n_8 + n_24 + n_72 AS n FROM cnt),
bis AS (SELECT 0 AS step, k, n, 0e0 AS llo, 1e0 AS lhi, 0e0 AS hlo, 1e0 AS hhi FROM pairs WHERE k > 0 AND k < n
    UNION ALL SELECT step + 1, k, n,
        CASE WHEN {under} THEN {low_mid} ELSE llo END, CASE WHEN {under} THEN lhi ELSE {low_mid} END,
        CASE WHEN {over} THEN {high_mid} ELSE hlo END, CASE WHEN {over} THEN hhi ELSE {high_mid} END
    FROM bis WHERE step < 45),
lims AS (SELECT k, n, (llo + lhi) / 2 AS lo, (hlo + hhi) / 2 AS hi FROM bis WHERE step = 45
    UNION ALL SELECT k, n, 0e0, 1 - pow((1 - 0.95e0) / 2, 1e0 / n) FROM pairs WHERE k = 0
    UNION ALL SELECT k, n, pow((1 - 0.95e0) / 2, 1e0 / n), 1e0 FROM pairs WHERE k = n),
ci AS (SELECT k, n, CAST(CAST(round_even(lo * 100, 0) AS BIGINT) AS VARCHAR) || ' to '
    || CAST(CAST(round_even(hi * 100, 0) AS BIGINT) AS VARCHAR) AS txt FROM lims)"""


def _list(keys=("booked_procedure",), urgency=2, exact=False, a_th=75, c_th=0.7):
    """``lst``: the finished list from ``cnt``."""
    total = "(n_1 + n_4 + n_8 + n_24 + n_72)"
    pct = (lambda n: f"(1e2 * {n} / {total})") if exact else (lambda n: _pct(n, total))
    levels = ", ".join(f'{pct(n)} AS "{lv}"' for lv, n in zip(LEVELS, N))
    share = " + ".join(f'"{lv}"' for lv in LEVELS[:urgency])
    hits = " + ".join(N[:urgency])
    using = ", ".join(keys)
    return f"""{_agreement(keys)}, {_interval(hits)},
pre AS (SELECT cnt.*, {levels}, agreement, {CONSENSUS} AS consensus, {total} AS proc_n, txt
    FROM cnt JOIN agr USING ({using}) JOIN ci ON ci.k = {hits} AND ci.n = {total}),
lst AS (SELECT {using}, "<1hr", "<4hrs", "<8hrs", "<24hrs", "<72hrs", agreement AS "Agreement", consensus AS "Consensus",
    {share} AS urgent_total_pcnt, txt AS "urgent_total_pcnt_CI", {share} >= {a_th} AS urgent_surgery_by_agmnt,
    {share} < {a_th} AND {share} > 50 AND consensus < {c_th} AS urgent_surgery_by_cnsus, proc_n, trauma, primary_proc FROM pre)"""


_SHOWN = ", ".join(f'round("{c}", 6) AS "{c}"' for c in [*LEVELS, "Agreement", "Consensus", "urgent_total_pcnt"])
_LIST_OUT = f"""SELECT * REPLACE ({_SHOWN}) FROM lst"""

# the rating view restricted as the list function does by default
INSIDE = f"{RAT}, inside AS (SELECT * FROM rat WHERE same_day AND age < (SELECT max(age) FROM rat))"
FLAGGED = f"{RAT}, {FIRST}, flagged AS (SELECT rat.*, rat.study_id IN (SELECT study_id FROM firsts) AS is_trauma FROM rat)"
FULL = (f"{FLAGGED}, inside AS (SELECT * FROM flagged WHERE same_day AND age < (SELECT max(age) FROM rat)), "
        f"{_count('inside', trauma='is_trauma')}, {_list()}")
EXACT = f"{FLAGGED}, inside AS (SELECT * FROM flagged WHERE same_day AND age < (SELECT max(age) FROM rat)), {_count('inside', trauma='is_trauma')}, {_list(exact=True)}"
CHAIN = f"""{EPI}, {EXC}, {FIRST},
    yes AS (SELECT study_id, code AS booked_procedure, age, sex, lvl, primary_proc, same_day FROM att
        WHERE correct = 'yes' AND study_id IN (SELECT study_id FROM firsts) AND code NOT IN (SELECT code FROM exc)
        QUALIFY row_number() OVER (PARTITION BY study_id, code ORDER BY l_linenumber, place, procedural_consultant, l_extendedprice) = 1)"""
_IN_FULL = "same_day AND age < (SELECT max(age) FROM yes)"
AGED = f"""{CHAIN}, aged AS (
    SELECT 'full' AS list_name, * FROM yes WHERE {_IN_FULL}
    UNION ALL SELECT 'paeds', * FROM yes WHERE same_day AND age < 16
    UNION ALL SELECT 'adult', * FROM yes WHERE same_day AND age >= 16 AND age < 65
    UNION ALL SELECT 'elderly', * FROM yes WHERE age >= 65 AND {_IN_FULL}),
{_count('aged', 'list_name, booked_procedure')}, {_list(('list_name', 'booked_procedure'))}"""
SEXED = f"""{CHAIN}, sexed AS (SELECT 'full' AS list_name, * FROM yes WHERE {_IN_FULL}
    UNION ALL SELECT CASE sex WHEN 'M' THEN 'male' ELSE 'female' END, * FROM yes WHERE {_IN_FULL}),
{_count('sexed', 'list_name, booked_procedure')}, {_list(('list_name', 'booked_procedure'))}"""
RATED = f"{RAT}, {_count('rat')}"

_PUBLISHED = """booked_procedure AS achi_code, p_name AS procedure_text, p_type AS block_text, trauma, primary_proc,
    round(urgent_total_pcnt, 6) AS urgent_total_pcnt, "urgent_total_pcnt_CI" """
_TEXT = "LEFT JOIN part ON p_partkey = booked_procedure"
_GROUPS = (("adult", "not specific to adults", "adult patients only"),
           ("elderly", "not specific to elderly", "elderly patients only"),
           ("paeds", "not specific to paediatrics", "paediatric patients only"))


def _one_diff(group, not_specific, only):
    def side(mine, other, label):
        return (f"SELECT lst.*, 'diff proc bw {group} and full' AS diff_name, '{label}' AS procedure_list FROM lst "
                f"WHERE list_name = '{mine}' AND urgent_surgery_by_agmnt AND booked_procedure NOT IN "
                f"(SELECT booked_procedure FROM lst WHERE list_name = '{other}' AND urgent_surgery_by_agmnt)")
    return side(group, "full", only) + " UNION ALL " + side("full", group, not_specific)


_SEXES = tuple((g, f"not specific to {g} patients", f"{g} patients only") for g in ("male", "female"))
SEX_DIFF = f"{SEXED}, diffs AS ({' UNION ALL '.join(_one_diff(*g) for g in _SEXES)})"
DIFF = f"{AGED}, diffs AS ({' UNION ALL '.join(_one_diff(*g) for g in _GROUPS)})"
_NAMES = {"full": ("full list by agreement", "addiional proc by consensus"),
          "adult": ("adult list by agreement", "adult addit proc by consensus"),
          "paeds": ("paeds list by agreement", "paeds addit proc by consensus"),
          "elderly": ("elderly list by agreement", "elderly addit proc by consensus")}


def _published(differences, names):
    stated = " UNION ALL ".join(
        f"SELECT lst.* REPLACE ('{name}' AS list_name), CAST(NULL AS VARCHAR) AS procedure_list FROM lst "
        f"WHERE list_name = '{group}' AND urgent_surgery_by_{flag}"
        for group, pair in names.items() for flag, name in zip(("agmnt", "cnsus"), pair))
    return f"""WITH RECURSIVE {differences}, stated AS ({stated}),
        every AS (SELECT * FROM stated UNION ALL SELECT * EXCLUDE (diff_name) REPLACE (diff_name AS list_name) FROM diffs)
        SELECT list_name, procedure_list, {_PUBLISHED} FROM every {_TEXT}"""


_SEX_NAMES = {"full": _NAMES["full"], **{g: (f"{g} list by agreement", f"{g} addit proc by consensus") for g in ("male", "female")}}


def _freq(source, *columns):
    """Counts and percent; with several columns within all but the last."""
    cols = ", ".join(columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    over = f"PARTITION BY {', '.join(columns[:-1])}" if len(columns) > 1 else ""
    return (f"SELECT {cols}, n, {_pct('n', f'sum(n) OVER ({over})')} AS prop FROM "
            f"(SELECT {cols}, count(*) AS n FROM {source} WHERE {known} GROUP BY {cols})")


_TRIM = "regexp_replace(specialty, ' SN', '')"
_SPECIALTY = f"""CASE WHEN {_TRIM} IN ('Obs/Gynae', 'Gynaecology') THEN 'Obs/Gynae'
    WHEN {_TRIM} IN ('Colorectal', 'Upper GI', 'Breast/Endo', 'Liver Surgery', 'Paediatric') THEN 'General Surgery' ELSE {_TRIM} END"""
SPEC = """spec AS (SELECT c_custkey AS patient, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Gynaecology' WHEN 'MACHINERY' THEN 'Colorectal SN'
    WHEN 'BUILDING' THEN 'Upper GI SN SN' WHEN 'AUTOMOBILE' THEN 'Orthopaedics SN' ELSE c_mktsegment END AS specialty FROM customer)"""


def _demo(inside):
    return f"""{RAT}, {FIRST}, {ANY.split('), anys AS')[1].join(['anys AS', ''])}, {SPEC},
cohort AS (SELECT DISTINCT study_id FROM rat WHERE correct = 'yes' AND study_id IN (SELECT study_id FROM firsts)),
frame AS (SELECT rat.*, specialty, row_number() OVER (PARTITION BY study_id
    ORDER BY l_linenumber, booked_procedure, procedural_consultant, l_extendedprice) AS rn
    FROM rat JOIN spec USING (patient) WHERE study_id {'' if inside else 'NOT '}IN (SELECT study_id FROM cohort)),
one AS (SELECT * FROM frame WHERE rn = 1),
demo AS (SELECT study_id, age, booked_procedure IN (SELECT booked_procedure FROM one WHERE study_id IN (SELECT study_id FROM anys)) AS trauma,
    sex, asa, specialty, lvl AS emerg_priority_collapse FROM one)"""


DEMO, DEMO_TRAUMA = _demo(False), _demo(True)
_DEMO_FREQS = """u AS (SELECT 'asa' AS variable, asa AS value FROM demo
    UNION ALL SELECT 'trauma', CAST(trauma AS VARCHAR) FROM demo UNION ALL SELECT 'sex', sex FROM demo
    UNION ALL SELECT 'emerg_priority_collapse', emerg_priority_collapse FROM demo)"""


def _age_profile(source):
    return f"""SELECT 'age' AS "Variable", count(age) AS "N", 1 - count(age) / CAST(count(*) AS DOUBLE) AS missing,
        round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS sd, round(median(age), 6) AS median,
        round(quantile_cont(age, 0.75) - quantile_cont(age, 0.25), 6) AS "IQR", round(quantile_cont(age, 0.25), 6) AS "25 centile",
        round(quantile_cont(age, 0.75), 6) AS "75 centile", min(age) AS min, max(age) AS max FROM {source}"""


_TOKENS = """list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN
    ('', 'a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'with')))"""
WORDS = f"""size AS (SELECT count(*) AS n FROM benchmark),
recorded AS (SELECT DISTINCT doc_id AS study_id, unnest([doc_id % n, (doc_id * 7 + 3) % n, (doc_id * 13 + 5) % n]) AS code
    FROM documents, size),
docs AS (SELECT doc_id AS study_id, {_TOKENS.format('text')} AS doc_words FROM documents),
items AS (SELECT item_id AS code, {_TOKENS.format('text')} AS item_words FROM benchmark),
common AS (SELECT study_id, code, CAST(len(item_words) AS INT) AS code_words,
    CAST(len(list_intersect(item_words, doc_words)) AS INT) AS common_words
    FROM recorded JOIN docs USING (study_id) JOIN items USING (code))"""

_ITEM_WORDS = _TOKENS.format("text")
MATCHED = f"""items_{{name}} AS (SELECT item_id AS code, unnest({_ITEM_WORDS.replace("{", "{{").replace("}", "}}")}) AS word FROM benchmark),
words_{{name}} AS (SELECT row_id, study_id, unnest({_ITEM_WORDS.replace("{", "{{").replace("}", "}}")}) AS word
    FROM (SELECT row_number() OVER () AS row_id, {{id}} AS study_id, text FROM {{source}})),
{{name}} AS (SELECT study_id, booked_procedure, common_words FROM (SELECT row_id, study_id, code AS booked_procedure, count(*) AS common_words
    FROM words_{{name}} JOIN items_{{name}} USING (word) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY common_words DESC, booked_procedure) = 1)"""

BOOKED = f"""{EPI}, {EXC}, booked AS (SELECT DISTINCT study_id, booked_procedure FROM
    (SELECT study_id, p0 AS booked_procedure FROM epi UNION ALL SELECT study_id, p2 FROM epi)
    WHERE booked_procedure IS NULL OR booked_procedure NOT IN (SELECT code FROM exc))"""


def _age_gp(age="age"):
    return f"CASE WHEN {age} < 16 THEN 'paeds' WHEN {age} < 65 THEN 'adult' ELSE 'elderly' END"


_URGENT_YN = "CASE WHEN lvl IN ('<1hr', '<4hrs') THEN 'urgent' ELSE 'not urgent' END"
def _eligible(source, least):
    return f"""eligible AS (SELECT booked_procedure, count(*) AS num_of_raters, count(*) FILTER (sex = 'M') AS male_count,
    count(*) FILTER (sex = 'F') AS female_count FROM {source} GROUP BY 1
    HAVING count(*) >= {least} AND count(*) FILTER (sex = 'M') >= 1 AND count(*) FILTER (sex = 'F') >= 1),
mcells AS (SELECT booked_procedure, sex, {_age_gp()} AS age_gp, count(*) AS n, count(*) FILTER ({_URGENT_YN} = 'not urgent') AS y
    FROM {source} WHERE booked_procedure IN (SELECT booked_procedure FROM eligible) GROUP BY ALL)"""


ELIGIBLE_ALL = f"{RAT}, {_eligible('rat', 8)}"
ELIGIBLE = f"{CHAIN}, {_eligible('yes', 8)}"

_UNPIVOTED = " UNION ALL ".join(f"""SELECT booked_procedure, '{lv}' AS urgency, "{lv}" AS pcnt FROM lst""" for lv in LEVELS)
_Q = "quantile_cont(pcnt, {})"
CUT = f"""{FULL}, cut AS (SELECT lst.*, cons_cutoff FROM lst, (SELECT unnest([0.6e0, 0.65e0, 0.7e0, 0.75e0]) AS cons_cutoff)
    WHERE urgent_total_pcnt < 80 AND urgent_total_pcnt > 50 AND "Consensus" < cons_cutoff),
cutl AS ({' UNION ALL '.join(f"""SELECT booked_procedure, cons_cutoff, '{lv}' AS urgency, "{lv}" AS pcnt FROM cut""" for lv in LEVELS)})"""

# Plain logistic model by coordinate-wise Newton steps on the six cell totals; the variance
# matrix by elimination of the two age columns, which never overlap.
_ETA = "(b0 + b1 * m[i] + b2 * e[i] + b3 * p[i])"
_PROB = f"(1 / (1 + exp(-{_ETA})))"


def _cell_sum(expression):
    return f"list_sum(list_transform(range(1, len(n) + 1), lambda i: {expression}))"


_PICK = "CASE step % 4 WHEN 0 THEN 1 WHEN 1 THEN m[i] WHEN 2 THEN e[i] ELSE p[i] END"
_MOVE = f"""({_cell_sum(f'({_PICK}) * (y[i] - n[i] * {_PROB})')}
    / {_cell_sum(f'({_PICK}) * n[i] * {_PROB} * (1 - {_PROB})')})"""
_W = {name: _cell_sum(f"{x} * n[i] * {_PROB} * (1 - {_PROB})") for name, x in
      (("s", "1"), ("sm", "m[i]"), ("se", "e[i]"), ("sp", "p[i]"), ("sme", "m[i] * e[i]"), ("smp", "m[i] * p[i]"))}
LOGIT = f"""{ELIGIBLE}, tot AS (SELECT CAST(sex = 'M' AS INT) AS m, CAST(age_gp = 'elderly' AS INT) AS e,
    CAST(age_gp = 'paeds' AS INT) AS p, sum(n) AS n, sum(y) AS y FROM mcells GROUP BY ALL),
obs AS (SELECT list(m) AS m, list(e) AS e, list(p) AS p, list(CAST(n AS DOUBLE)) AS n, list(CAST(y AS DOUBLE)) AS y FROM tot),
fit AS (SELECT 0 AS step, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2, 0e0 AS b3 UNION ALL
    SELECT step + 1, b0 + CASE WHEN step % 4 = 0 THEN move ELSE 0 END, b1 + CASE WHEN step % 4 = 1 THEN move ELSE 0 END,
        b2 + CASE WHEN step % 4 = 2 THEN move ELSE 0 END, b3 + CASE WHEN step % 4 = 3 THEN move ELSE 0 END
    FROM (SELECT fit.*, {_MOVE} AS move FROM fit, obs WHERE step < 800)),
info AS (SELECT b0, b1, b2, b3, {', '.join(f'{x} AS {name}' for name, x in _W.items())} FROM fit, obs WHERE step = 800),
half AS (SELECT *, s - se - sp AS a11, sm - sme - smp AS a12, sm - sme * sme / se - smp * smp / sp AS a22 FROM info),
var AS (SELECT *, a11 * a22 - a12 * a12 AS det FROM half),
coef AS (SELECT '(Intercept)' AS "Variable", b0 AS b, a22 / det AS v FROM var UNION ALL SELECT 'sexM', b1, a11 / det FROM var
    UNION ALL SELECT 'age_gpelderly', b2, 1 / se + (a22 - 2 * (sme / se) * a12 + (sme / se) * (sme / se) * a11) / det FROM var
    UNION ALL SELECT 'age_gppaeds', b3, 1 / sp + (a22 - 2 * (smp / sp) * a12 + (smp / sp) * (smp / sp) * a11) / det FROM var)"""

WHOLE = f"""{FLAGGED}, mcells AS (SELECT booked_procedure, sex, {_age_gp()} AS age_gp, is_trauma AS trauma, count(*) AS n,
    count(*) FILTER ({_URGENT_YN} = 'not urgent') AS y FROM flagged WHERE booked_procedure IN
    (SELECT booked_procedure FROM rat GROUP BY 1 HAVING count(*) >= 20) GROUP BY ALL)"""


# Random-intercept model with covariates: the Laplace likelihood itself, climbed one parameter at a time with
# three-point parabolas; curvature by differences; the covariance by elimination.
_H = "1e-3"


def _laplace(source, k, steps=12):
    """Value of each row of ``source`` (n, y, x lists over cells; bb: coefficients, then the deviation)."""
    p = "(1 / (1 + exp(-(v + t * u))))"
    slope = f"list_sum(list_transform(f, lambda v, c: y[c] - n[c] * {p}))"
    curve = f"list_sum(list_transform(f, lambda v, c: n[c] * {p} * (1 - {p})))"
    mode = f"list_reduce(range(0, {steps}), lambda u, s: u + greatest(-2, least(2, (t * {slope} - u) / (1 + t * t * {curve}))), 0e0)"
    return f"""SELECT *, list_sum(list_transform(f, lambda v, c: y[c] * (v + t * u) - n[c] * ln(1 + exp(v + t * u)))) - u * u / 2
        - ln(1 + t * t * {curve}) / 2 AS value FROM (SELECT *, {mode} AS u FROM (SELECT *,
        list_transform(x, lambda r: list_dot_product(r, bb[1:{k}])) AS f, bb[{k + 1}] AS t FROM ({source})))"""


def _mixed_fit(columns, name="m", sweeps=60):
    """``{name}_best``: coefficients and deviation ``b`` at the optimum and the log-likelihood ``value`` there."""
    k = len(columns) + 1
    m = k + 1
    moved = f"list_transform(b, lambda v, i: v + CASE WHEN i = step % {m} + 1 THEN d * {_H} ELSE 0 END)"
    points = f"SELECT step, b, d, n, y, x, {moved} AS bb FROM {name}_fit, {name}_obs, (SELECT unnest([-1, 0, 1]) AS d) WHERE step < {m * sweeps}"
    move = f"greatest(-0.5, least(0.5, CASE WHEN c < 0 THEN -{_H} * g / (2 * c) WHEN g < 0 THEN -0.1 ELSE 0.1 END))"
    return f"""{name}_obs AS (SELECT list(CAST(n AS DOUBLE)) AS n, list(CAST(y AS DOUBLE)) AS y,
        list([1e0{''.join(f', CAST({c} AS DOUBLE)' for c in columns)}]) AS x FROM mcells GROUP BY booked_procedure),
    {name}_fit AS (SELECT 0 AS step, [{', '.join(['0e0'] * k)}, 1e0] AS b UNION ALL
        SELECT step + 1, list_transform(b, lambda v, i: v + CASE WHEN i = step % {m} + 1 THEN {move} ELSE 0 END)
        FROM (SELECT step, b, hi - lo AS g, hi - 2 * mid + lo AS c FROM (SELECT step, b, sum(value) FILTER (d = 1) AS hi,
            sum(value) FILTER (d = 0) AS mid, sum(value) FILTER (d = -1) AS lo FROM ({_laplace(points, k)}) GROUP BY step, b))),
    {name}_best AS (SELECT b, sum(value) AS value FROM ({_laplace(f"SELECT n, y, x, b, b AS bb FROM {name}_fit, {name}_obs WHERE step = {m * sweeps}", k, 25)}) GROUP BY b)"""


def _mixed_odds(cells, terms):
    names, columns = list(terms), list(terms.values())
    k = len(columns) + 1
    m = k + 1
    shifted = f"list_transform(b, lambda v, q: v + {_H} * (CASE WHEN q = i THEN di ELSE 0 END + CASE WHEN q = j THEN dj ELSE 0 END))"
    points = f"""SELECT i, j, di * dj AS sgn, n, y, x, {shifted} AS bb FROM m_best, m_obs, (SELECT unnest(range(1, {m + 1})) AS i),
        (SELECT unnest(range(1, {m + 1})) AS j), (SELECT unnest([-1, 1]) AS di), (SELECT unnest([-1, 1]) AS dj)"""
    labels = ", ".join(f"'{v}'" for v in ("(Intercept)", *names))
    return f"""WITH RECURSIVE {cells}, {_mixed_fit(columns)},
    hess AS (SELECT i, j, -sum(sgn * value) / (4 * {_H} * {_H}) AS v FROM ({_laplace(points, k, 25)}) GROUP BY i, j),
    half AS (SELECT i, list(v ORDER BY j) || list_transform(range(1, {m + 1}), lambda q: CAST(q = i AS DOUBLE)) AS r FROM hess GROUP BY i),
    gj AS (SELECT 1 AS p, list(r ORDER BY i) AS a FROM half UNION ALL SELECT p + 1, list_transform(a, lambda r, i: CASE WHEN i = p
        THEN list_transform(r, lambda v: v / a[p][p]) ELSE list_transform(r, lambda v, c: v - r[p] / a[p][p] * a[p][c]) END) FROM gj WHERE p <= {m}),
    coef AS (SELECT unnest([{labels}]) AS "Variable", unnest(b[1:{k}]) AS b, unnest(list_transform(range(1, {k + 1}), lambda q: a[q][{m} + q])) AS v
        FROM m_best, gj WHERE p = {m + 1})
    SELECT "Variable", round_even(exp(b), 2) AS "OddsRatio", round_even(exp(b - 1.96e0 * sqrt(v)), 2) AS "LL",
        round_even(exp(b + 1.96e0 * sqrt(v)), 2) AS "UL" FROM coef"""


_MAIN = {"sexM": "sex = 'M'", "age_gpelderly": "age_gp = 'elderly'", "age_gppaeds": "age_gp = 'paeds'"}
_CROSS = {"sexM:age_gpelderly": "(sex = 'M' AND age_gp = 'elderly')", "sexM:age_gppaeds": "(sex = 'M' AND age_gp = 'paeds')"}

def _mixed_icc(cells):
    return f"""WITH RECURSIVE {cells}, {_mixed_fit([], 'z', 40)}, v AS (SELECT b[2] * b[2] AS t2 FROM z_best)
        SELECT round(t2, 3) AS variance, round(t2 / (t2 + 1), 3) AS icc, round(t2 / (t2 + pi() * pi() / 3), 3) AS icc_latent FROM v"""


_WHOLE_MAIN = {**_MAIN, "traumaTRUE": "trauma"}


def _mixed_test(cells, terms):
    """Null model against the model with ``terms``; the chi-square tail by Simpson's rule over its square root."""
    k = len(terms)
    z = "(sqrt(chisq) + 12e0 * i / 2000)"
    density = {3: f"sqrt(2 / pi()) * {z} * {z} * exp(-{z} * {z} / 2)", 4: f"{z} * {z} * {z} / 2 * exp(-{z} * {z} / 2)"}[k]
    tail = (f"list_sum(list_transform(range(0, 2001), lambda i: {density} * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END))"
            " * 12e0 / 2000 / 3")
    return f"""WITH RECURSIVE {cells}, {_mixed_fit([], 'z', 40)}, {_mixed_fit(list(terms.values()))},
    two AS (SELECT 'm_null' AS model, 2 AS npar, value AS ll, CAST(NULL AS DOUBLE) AS chisq FROM z_best
        UNION ALL SELECT 'm1', {k + 2}, m_best.value, 2 * (m_best.value - z_best.value) FROM m_best, z_best),
    size AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM mcells)
    SELECT model, CAST(npar AS INT) AS npar, round(2 * npar - 2 * ll, 3) AS "AIC", round(ln(total) * npar - 2 * ll, 3) AS "BIC",
        round(ll, 3) AS log_lik, round(-2 * ll, 3) AS deviance, round(chisq, 3) AS chisq,
        CAST(CASE WHEN model = 'm1' THEN {k} END AS INT) AS df, round(CASE WHEN model = 'm1' THEN {tail} END, 3) AS p_value FROM two, size"""



def _bins(value, width, source):
    """Bins at multiples of ``width`` from the least to the largest value, closed above; the first one on both sides."""
    return f"""ends AS (SELECT floor(min({value}) / {width}) AS a, greatest(ceil(max({value}) / {width}), floor(min({value}) / {width}) + 1) AS b FROM {source}),
        k AS (SELECT unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT))) AS bin FROM ends),
        f AS (SELECT CASE WHEN {value} = a * {width} THEN a ELSE ceil({value} / {width}) - 1 END AS bin FROM {source}, ends)
        SELECT CAST(k.bin * {width} AS DOUBLE) AS bin_from, CAST(k.bin * {width} + {width} AS DOUBLE) AS bin_to, count(f.bin) AS n
        FROM k LEFT JOIN f ON k.bin = f.bin GROUP BY k.bin
        UNION ALL SELECT NULL, NULL, count(*) FROM f WHERE bin IS NULL HAVING count(*) > 0"""


ORACLE = {
    "booking_period_freq": f"""WITH h AS (SELECT ts - min(ts) OVER (PARTITION BY user_id) AS d FROM events),
        b AS (SELECT CASE WHEN d <= INTERVAL 24 HOUR THEN 'same day' WHEN d <= INTERVAL 168 HOUR THEN 'same week'
            ELSE 'over 1 week' END AS admit_to_book_pd FROM h)
        {_freq('b', 'admit_to_book_pd')}""",
    "first_case_per_admission": f"""WITH {RAT} SELECT study_id, age, CAST(l_shipdate AS DATE) AS case_date,
        CAST(l_linenumber AS BIGINT) AS episode_number, booked_procedure, md5(CAST(procedural_consultant AS VARCHAR)) AS procedural_consultant,
        base_level AS emerg_priority_collapse FROM rat WHERE same_day
        QUALIFY row_number() OVER (PARTITION BY study_id, age, admitted ORDER BY CAST(l_shipdate AS DATE), l_linenumber,
            booked_procedure, procedural_consultant, l_extendedprice) = 1""",
    "priority_collapse_counts": f"""WITH {ADM}, c AS (SELECT base_level AS emerg_priority_collapse FROM adm)
        SELECT *, CAST(list_position(['<1hr', '<4hrs', '<8hrs', '<24hrs', '<72hrs'], emerg_priority_collapse) AS INT) AS level_rank
        FROM ({_freq('c', 'emerg_priority_collapse')})""",
    "rater_pseudonym": "SELECT s_suppkey, md5(s_name) AS rater FROM supplier",
    "excluded_codes": f"WITH {EXC} SELECT code AS achi_proc_code FROM exc",
    "null_out_excluded": f"""WITH {EPI}, {EXC} SELECT study_id, CAST(l_linenumber AS BIGINT) AS episode_number,
        CASE WHEN p0 NOT IN (SELECT code FROM exc) THEN p0 END AS coded_primary_procedure,
        CASE WHEN p1 NOT IN (SELECT code FROM exc) THEN p1 END AS additional_procedure_1,
        CASE WHEN p2 NOT IN (SELECT code FROM exc) THEN p2 END AS additional_procedure_2 FROM epi""",
    "diagnosis_codes_long": f"""WITH {_kept()} SELECT study_id, position, code, code AS short_idc,
        letter IN ('s', 't') AS trauma_by_inj, letter IN ('u', 'v', 'w', 'x') AS trauma_by_mech FROM kept""",
    "trauma_first_code": f"WITH {FIRST} SELECT study_id FROM firsts",
    "trauma_any_code": f"WITH {ANY} SELECT study_id FROM anys",
    "trauma_any_code_padded": f"WITH {_kept(True)} SELECT DISTINCT study_id FROM kept WHERE {_IS_TRAUMA}",
    "trauma_first_code_by_patient": f"""WITH {_kept()} SELECT study_id FROM (SELECT patient AS study_id, letter,
        row_number() OVER (PARTITION BY patient ORDER BY study_id, position) AS rn FROM kept) WHERE rn = 1 AND {_IS_TRAUMA}""",
    "trauma_cohort_ties": f"""WITH {DIAG}, w AS (SELECT study_id AS k, patient, {', '.join(
            f"coalesce(max(code) FILTER (position = {i}), '') AS d{i}" for i in range(1, 5))} FROM diag GROUP BY ALL),
        {_kept().split('), parts AS', 1)[1].join(['parts AS', ''])},
        o AS (SELECT w.patient, letter, position, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 2 END AS ord, d1, d2, d3, d4
            FROM kept JOIN w ON kept.study_id = w.k)
        SELECT patient AS study_id FROM (SELECT *, row_number() OVER (PARTITION BY patient
            ORDER BY ord NULLS LAST, d1, d2, d3, d4, position) AS rn FROM o) WHERE rn = 1 AND {_IS_TRAUMA}""",
    "trauma_cohort_semi": f"""WITH {FIRST} SELECT l_orderkey AS study_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        true AS trauma_pt FROM lineitem WHERE l_orderkey IN (SELECT study_id FROM firsts)""",
    "cohort_flag_freq": f"""WITH {FIRST}, f AS (SELECT l_orderkey IN (SELECT study_id FROM firsts) AS trauma FROM lineitem) {_freq('f', 'trauma')}""",
    "folded_level_freq": f"""WITH {ADM}, f AS (SELECT CASE base_level WHEN '<1hr' THEN '<4hrs' ELSE base_level END AS level FROM adm)
        {_freq('f', 'level')}""",
    "study_from_csv": f"""WITH {DIAG}, {ADM}, d AS (SELECT study_id, max(upper(code)) FILTER (position = 1) AS d1,
            nullif(max(upper(code)) FILTER (position = 2), '') AS d2 FROM diag GROUP BY 1)
        SELECT CAST(study_id AS VARCHAR) AS study_id, age, sex, CASE WHEN sex = 'F' THEN CAST(admitted AS DATE) END AS admit_dt_tm,
            d1 AS principle_diagnosis, CASE WHEN sex = 'F' THEN d2 END AS additional_diagnosis_1 FROM adm JOIN d USING (study_id)""",
    "procedure_codes_from_csv": """SELECT CAST(p_partkey AS VARCHAR) AS achi_proc_code, p_name AS procedure_text, CAST(p_size AS INT) AS block_number,
        CAST(NULL AS VARCHAR) AS block_text, CAST(NULL AS VARCHAR) AS procedure_chapter, CAST(NULL AS VARCHAR) AS procedure_sub_chapter,
        CAST(NULL AS VARCHAR) AS icd10_ver FROM part""",
    "diagnosis_codes_from_parquet": """SELECT CAST(NULL AS VARCHAR) AS four_dgt_no, CAST(NULL AS VARCHAR) AS four_dgt_text,
        CAST(n_nationkey AS VARCHAR) AS three_dgt_no, n_name AS three_dgt_text, CAST(NULL AS VARCHAR) AS diagnosis_chapter,
        CAST(NULL AS VARCHAR) AS diagnosis_subchapter FROM nation""",
    "label_sheet_round_trip": f"""WITH {EPI} SELECT CAST(study_id AS VARCHAR) AS study_id, CAST(code AS VARCHAR) AS achi_proc_code,
        {_LABEL.format('code + study_id')} AS correct, place = 0 AS primary_proc FROM long""",
    "stage_hand_off": f"""WITH {EPI} SELECT study_id, code AS booked_procedure, CAST(l_linenumber AS BIGINT) AS episode_number,
        place AS proc_no, correct, primary_proc, 3 AS site FROM att""",
    "procedure_check_sheet": f"""WITH {EPI} SELECT study_id, asa || ' ' || o_orderpriority AS planned_procedure, code AS achi_proc_code,
        place = 0 AS primary_proc, CAST(NULL AS VARCHAR) AS correct, p_name AS procedure_text
        FROM long LEFT JOIN part ON p_partkey = code""",
    "labels_attached": f"""WITH {EPI} SELECT study_id, code AS booked_procedure, CAST(l_linenumber AS BIGINT) AS episode_number,
        place AS proc_no, correct, primary_proc FROM att""",
    "label_primary_freq": f"WITH {EPI} {_freq('att', 'primary_proc')}",
    "label_correct_freq": f"WITH {EPI} {_freq('att', 'primary_proc', 'correct')}",
    "label_recapture": f"""WITH {EPI}, wrong AS (SELECT DISTINCT study_id FROM att WHERE primary_proc AND correct = 'no'),
        rec AS (SELECT study_id, CASE WHEN bool_or(coalesce(correct = 'yes', false)) THEN true WHEN count(correct) < count(*) THEN NULL
            ELSE false END AS pri_capt FROM att WHERE NOT primary_proc AND study_id IN (SELECT study_id FROM wrong) GROUP BY 1)
        {_freq('rec', 'pri_capt')}""",
    "labelled_procedures": f"""WITH {EPI} SELECT study_id, code AS booked_procedure, CAST(l_linenumber AS BIGINT) AS episode_number,
        place AS proc_no, correct, primary_proc FROM att WHERE correct = 'yes'
        QUALIFY row_number() OVER (PARTITION BY study_id, code ORDER BY l_linenumber, place) = 1""",
    "unique_row_ids": f"""WITH {EPI} SELECT study_id, code AS booked_procedure, CAST(l_linenumber AS BIGINT) AS episode_number,
        place AS proc_no, concat_ws('_', study_id, l_linenumber, place, code, row_number() OVER (PARTITION BY study_id, l_linenumber, place, code))
        AS study_id_unique FROM att""",
    "text_common_words": f"WITH {WORDS} SELECT * FROM common",
    "text_best_match": f"""WITH {WORDS} SELECT study_id, code AS booked_procedure, common_words FROM common WHERE common_words > 0
        QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY common_words DESC, code) = 1""",
    "booked_set_union": f"WITH {BOOKED} SELECT * FROM booked",
    "procedures_per_study": f"WITH {BOOKED} SELECT study_id, count(booked_procedure) AS n_procedures FROM booked GROUP BY 1",
    "most_procedures": f"""WITH {BOOKED} SELECT max(n) AS max_procedures, count(*) AS n_studies FROM
        (SELECT study_id, count(booked_procedure) AS n FROM booked GROUP BY 1)""",
    "missing_booked": f"""WITH {BOOKED} SELECT count(*) AS n_rows, count(*) FILTER (booked_procedure IS NULL) AS n_missing,
        {_pct('count(*) FILTER (booked_procedure IS NULL)', 'count(*)')} AS pct_missing FROM booked""",
    "booked_not_missing": f"WITH {BOOKED} SELECT * FROM booked WHERE booked_procedure IS NOT NULL",
    "rater_counts": f"""WITH {RAT} SELECT booked_procedure, count(*) AS num_of_raters,
        count(DISTINCT procedural_consultant) AS num_of_unique_raters, median(age) AS age FROM rat GROUP BY 1""",
    "rater_count_of_counts": f"""WITH {RAT}, r AS (SELECT booked_procedure, count(DISTINCT procedural_consultant) AS num_of_unique_raters
        FROM rat GROUP BY 1) SELECT num_of_unique_raters, count(*) AS count_of_num_unique_raters FROM r GROUP BY 1""",
    "distinct_sizes": f"""WITH {RAT} SELECT count(DISTINCT booked_procedure) AS n_procedures,
        count(DISTINCT procedural_consultant) AS n_raters, count(DISTINCT study_id) AS n_studies FROM rat""",
    "level_freq": f"""WITH {RAT}, r AS (SELECT booked_procedure, lvl AS emerg_priority_collapse FROM rat)
        {_freq('r', 'booked_procedure', 'emerg_priority_collapse')}""",
    "level_counts_wide": f"WITH {RATED} SELECT * EXCLUDE (trauma) FROM cnt",
    "level_percent_wide": f"""WITH {RATED} SELECT booked_procedure, n_1 + n_4 + n_8 + n_24 + n_72 AS proc_n, {', '.join(
        f'{_pct(n, "n_1 + n_4 + n_8 + n_24 + n_72")} AS "{lv}"' for lv, n in zip(LEVELS, N))} FROM cnt""",
    "ordinal_consensus": f'WITH {RATED} SELECT booked_procedure, round({CONSENSUS}, 6) AS "Consensus" FROM cnt',
    "ordinal_agreement": f"""WITH {RATED}, {_agreement(['booked_procedure'])}
        SELECT booked_procedure, round(agreement, 6) AS "Agreement" FROM agr""",
    "urgent_percent_by_window": f"""WITH {RATED}, p AS (SELECT booked_procedure, {', '.join(
        f'{_pct(n, "n_1 + n_4 + n_8 + n_24 + n_72")} AS {n.replace("n_", "p_")}' for n in N)} FROM cnt)
        SELECT booked_procedure, round(p_1, 6) AS within_1, round(p_1 + p_4, 6) AS within_4, round(p_1 + p_4 + p_8, 6) AS within_8,
        round(p_1 + p_4 + p_8 + p_24, 6) AS within_24, round(p_1 + p_4 + p_8 + p_24 + p_72, 6) AS within_72 FROM p""",
    "exact_binomial_ci": f"""WITH RECURSIVE {RATED}, {_interval('n_1 + n_4')} SELECT booked_procedure, txt AS "urgent_total_pcnt_CI"
        FROM cnt JOIN ci ON k = n_1 + n_4 AND n = n_1 + n_4 + n_8 + n_24 + n_72""",
    "procedure_urgency": f"""WITH RECURSIVE {FULL} SELECT lst.* REPLACE ({_SHOWN}), p_name AS procedure_text, p_type AS block_text
        FROM lst {_TEXT}""",
    "procedure_urgency_8h_exact": f"""WITH RECURSIVE {FLAGGED}, inside AS (SELECT * FROM flagged WHERE same_day),
        {_count('inside', trauma='is_trauma')}, {_list(urgency=3, exact=True)} {_LIST_OUT}""",
    "all_patients_trauma_flag": f"WITH RECURSIVE {FULL} {_freq('lst', 'trauma')}",
    "all_patients_primary_freq": f"WITH RECURSIVE {FULL} {_freq('lst', 'primary_proc')}",
    "trauma_urgency": f"""WITH RECURSIVE {CHAIN},
        inside AS (SELECT * FROM yes WHERE same_day AND age >= 0 AND age < 110), {_count('inside')}, {_list()} {_LIST_OUT}""",
    "class_cross_table": f"WITH RECURSIVE {FULL} {_freq('lst', 'urgent_surgery_by_agmnt', 'urgent_surgery_by_cnsus')}",
    "level_distribution": f"""WITH RECURSIVE {FULL}, u AS ({_UNPIVOTED}) SELECT urgency, round({_Q.format(0.5)}, 6) AS median_pct,
        round({_Q.format(0.75)} - {_Q.format(0.25)}, 6) AS "IQR_pct", round({_Q.format(0.25)}, 6) AS one_quantile_pcnt,
        round({_Q.format(0.75)}, 6) AS three_quantile_pcnt FROM u GROUP BY urgency""",
    "level_boxplot_stats": f"""WITH RECURSIVE {FULL}, u AS ({_UNPIVOTED}),
        q AS (SELECT urgency, {_Q.format(0.25)} AS q25, {_Q.format(0.5)} AS median, {_Q.format(0.75)} AS q75 FROM u GROUP BY 1),
        w AS (SELECT *, pcnt BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS inside FROM u JOIN q USING (urgency))
        SELECT urgency, round(min(pcnt) FILTER (inside), 6) AS whisker_low, round(any_value(q25), 6) AS q25,
        round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75, round(max(pcnt) FILTER (inside), 6) AS whisker_high,
        count(*) FILTER (NOT inside) AS n_outliers FROM w GROUP BY urgency""",
    "level_distribution_exact": f"""WITH RECURSIVE {EXACT}, u AS ({_UNPIVOTED}) SELECT urgency, round({_Q.format(0.5)}, 6) AS median_pct,
        round({_Q.format(0.75)} - {_Q.format(0.25)}, 6) AS "IQR_pct", round({_Q.format(0.25)}, 6) AS one_quantile_pcnt,
        round({_Q.format(0.75)}, 6) AS three_quantile_pcnt FROM u GROUP BY urgency""",
    "level_boxplot_exact": f"""WITH RECURSIVE {EXACT}, u AS ({_UNPIVOTED}),
        q AS (SELECT urgency, {_Q.format(0.25)} AS q25, {_Q.format(0.5)} AS median, {_Q.format(0.75)} AS q75 FROM u GROUP BY 1),
        w AS (SELECT *, pcnt BETWEEN q25 - 1.5e0 * (q75 - q25) AND q75 + 1.5e0 * (q75 - q25) AS inside FROM u JOIN q USING (urgency))
        SELECT urgency, round(min(pcnt) FILTER (inside), 6) AS whisker_low, round(any_value(q25), 6) AS q25,
        round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75, round(max(pcnt) FILTER (inside), 6) AS whisker_high,
        count(*) FILTER (NOT inside) AS n_outliers FROM w GROUP BY urgency""",
    "level_density_exact": f"""WITH RECURSIVE {EXACT}, u AS ({_UNPIVOTED}), s AS (SELECT urgency, count(*) AS n, coalesce(stddev_samp(pcnt), 0) AS sd,
            (quantile_cont(pcnt, 0.75) - quantile_cont(pcnt, 0.25)) / 1.34e0 AS robust FROM u GROUP BY 1),
        b AS (SELECT urgency, n, pow(n, -0.2e0) * 0.9e0 * CASE WHEN least(sd, robust) > 0 THEN least(sd, robust)
            WHEN sd > 0 THEN sd ELSE 1 END AS bw FROM s),
        g AS (SELECT CAST(unnest(range(0, 101)) AS DOUBLE) AS x)
        SELECT urgency, x, round(sum(exp(-(x - pcnt) * (x - pcnt) / (2 * bw * bw)) / (bw * sqrt(2 * pi()))) / any_value(n), 6) AS density
        FROM u JOIN b USING (urgency), g GROUP BY urgency, x""",
    "written_lists": _published(DIFF, _NAMES),
    "urgent_list_agreement": f"WITH RECURSIVE {FULL} SELECT {_PUBLISHED} FROM lst {_TEXT} WHERE urgent_surgery_by_agmnt",
    "urgent_list_consensus": f"WITH RECURSIVE {FULL} SELECT {_PUBLISHED} FROM lst {_TEXT} WHERE urgent_surgery_by_cnsus",
    "age_range_default_bounds": f"""WITH {RAT} SELECT count(*) AS n_inside, max(age) AS oldest_inside,
        (SELECT min(age) FROM rat) AS age_min, (SELECT max(age) FROM rat) AS age_max FROM rat WHERE age < (SELECT max(age) FROM rat)""",
    "age_group_lists": f"WITH RECURSIVE {AGED} {_LIST_OUT}",
    "age_group_diff": f"WITH RECURSIVE {DIFF} SELECT diff_name, procedure_list, {_PUBLISHED} FROM diffs {_TEXT}",
    "age_group_compare": f"""WITH RECURSIVE {DIFF} SELECT procedure_list, {_PUBLISHED} FROM diffs {_TEXT}
        WHERE diff_name = 'diff proc bw elderly and full'""",
    "age_group_diff_trauma_freq": f"WITH RECURSIVE {DIFF} {_freq('diffs', 'diff_name', 'procedure_list', 'trauma')}",
    "age_group_diff_primary_freq": f"WITH RECURSIVE {DIFF} {_freq('diffs', 'diff_name', 'procedure_list', 'primary_proc')}",
    "sex_lists": f"WITH RECURSIVE {SEXED} {_LIST_OUT}",
    "published_lists": _published(DIFF, _NAMES),
    "published_sex_lists": _published(SEX_DIFF, _SEX_NAMES),
    "sex_group_compare": f"""WITH RECURSIVE {SEX_DIFF} SELECT procedure_list, {_PUBLISHED} FROM diffs {_TEXT}
        WHERE diff_name = 'diff proc bw female and full'""",
    "threshold_sweep": f"""WITH RECURSIVE {FULL}, a AS (SELECT unnest([75e0, 80e0, 90e0]) AS a_th),
        c AS (SELECT unnest([0.6e0, 0.65e0, 0.7e0, 0.9e0]) AS c_th)
        SELECT a_th, c_th, count(*) FILTER (urgent_total_pcnt >= a_th) AS n_by_agreement,
        count(*) FILTER (urgent_total_pcnt < a_th AND urgent_total_pcnt > 50 AND "Consensus" < c_th) AS n_by_consensus
        FROM lst, a, c GROUP BY a_th, c_th""",
    "consensus_cutoffs_long": f"WITH RECURSIVE {CUT} SELECT * REPLACE (round(pcnt, 6) AS pcnt) FROM cutl",
    "cutoff_density": f"""WITH RECURSIVE {CUT}, s AS (SELECT cons_cutoff, urgency, count(*) AS n, coalesce(stddev_samp(pcnt), 0) AS sd,
            (quantile_cont(pcnt, 0.75) - quantile_cont(pcnt, 0.25)) / 1.34e0 AS robust FROM cutl GROUP BY 1, 2),
        b AS (SELECT cons_cutoff, urgency, n, pow(n, -0.2e0) * 0.9e0 * CASE WHEN least(sd, robust) > 0 THEN least(sd, robust)
            WHEN sd > 0 THEN sd ELSE 1 END AS bw FROM s),
        g AS (SELECT CAST(unnest(range(0, 101)) AS DOUBLE) AS x)
        SELECT cons_cutoff, urgency, x, round(sum(exp(-(x - pcnt) * (x - pcnt) / (2 * bw * bw)) / (bw * sqrt(2 * pi()))) / any_value(n), 6) AS density
        FROM cutl JOIN b USING (cons_cutoff, urgency), g GROUP BY cons_cutoff, urgency, x""",
    "age_profile": f"WITH {ADM} {_age_profile('adm')}",
    "age_histogram": f"""WITH {ADM}, {_bins('age', 5, 'adm')}""",
    "hours_histogram": f"""WITH {ADM}, d AS (SELECT CASE WHEN l_linenumber <> 3 THEN
        trunc(date_diff('microsecond', admitted, CAST(l_shipdate AS TIMESTAMP)) / 86400e6) END AS days FROM lineitem JOIN adm ON l_orderkey = study_id),
        {_bins('days', 7, 'd')}""",
    "price_profile": " UNION ALL ".join(f"""SELECT '{name}' AS "Variable", count(v) AS "N", 1 - count(v) / CAST(count(*) AS DOUBLE) AS missing,
        round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS sd, round(median(v), 2) AS median,
        round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 2) AS "IQR", round(quantile_cont(v, 0.25), 2) AS "25 centile",
        round(quantile_cont(v, 0.75), 2) AS "75 centile", min(v) AS min, max(v) AS max FROM (SELECT CAST({column} AS DOUBLE) AS v FROM lineitem)"""
        for name, column in (("price", "l_extendedprice"), ("quantity", "l_quantity"))),
    "demographics": f"WITH {DEMO} SELECT * FROM demo",
    "trauma_demographics": f"WITH {DEMO_TRAUMA} SELECT * FROM demo",
    "demographic_freqs": f"WITH {DEMO}, {_DEMO_FREQS} {_freq('u', 'variable', 'value')}",
    "trauma_demographic_freqs": f"WITH {DEMO_TRAUMA}, {_DEMO_FREQS} {_freq('u', 'variable', 'value')}",
    "demographic_age_profile": f"WITH {DEMO} {_age_profile('demo')}",
    "demographic_age_histogram": f"WITH {DEMO}, {_bins('age', 5, 'demo')}",
    "demographic_specialty_freq": f"""WITH {DEMO}, s AS (SELECT {_SPECIALTY} AS specialty FROM demo) {_freq('s', 'specialty')}""",
    "text_code_match": f"WITH {MATCHED.format(name='m', id='doc_id', source='documents')} SELECT * FROM m",
    "booked_set_from_text": f"""WITH {MATCHED.format(name='m', id='doc_id', source='documents')},
        {MATCHED.format(name='p', id='conv_id', source='conversations')}
        SELECT study_id, booked_procedure FROM (SELECT study_id, booked_procedure FROM m UNION SELECT study_id, booked_procedure FROM p)
        WHERE booked_procedure NOT IN (SELECT item_id FROM benchmark WHERE text LIKE '%q%')""",
    "specialty_freq": f"""WITH {ADM}, {SPEC}, s AS (SELECT {_SPECIALTY} AS specialty FROM adm JOIN spec USING (patient))
        {_freq('s', 'specialty')}""",
    "urgent_specialty_freq": f"""WITH RECURSIVE {FULL}, {SPEC}, pairs2 AS (SELECT DISTINCT booked_procedure, specialty
        FROM rat JOIN spec USING (patient) WHERE booked_procedure IN (SELECT booked_procedure FROM lst WHERE urgent_surgery_by_agmnt)),
        s AS (SELECT {_SPECIALTY} AS specialty FROM pairs2) {_freq('s', 'specialty')}""",
    "urgent_list_freqs": f"""WITH RECURSIVE {FULL}, c AS (SELECT 'urgent_surgery_by_agmnt' AS class, trauma, primary_proc FROM lst
        WHERE urgent_surgery_by_agmnt UNION ALL SELECT 'urgent_surgery_by_cnsus', trauma, primary_proc FROM lst
        WHERE urgent_surgery_by_cnsus) {_freq('c', 'class', 'trauma', 'primary_proc')}""",
    "sex_list_compare": f"WITH RECURSIVE {SEX_DIFF} {_freq('diffs', 'diff_name', 'procedure_list', 'primary_proc')}",
    "specialty_lists": f"""WITH RECURSIVE {FULL}, {SPEC}, pairs2 AS (SELECT DISTINCT booked_procedure, specialty
        FROM rat JOIN spec USING (patient) WHERE booked_procedure IN (SELECT booked_procedure FROM lst WHERE urgent_surgery_by_agmnt)),
        s1 AS (SELECT {_SPECIALTY} AS specialty FROM pairs2), s2 AS (SELECT {_SPECIALTY} AS specialty FROM adm JOIN spec USING (patient))
        SELECT *, 'urgent speciality list' AS list_name FROM ({_freq('s1', 'specialty')})
        UNION ALL SELECT *, 'study db specialty list' FROM ({_freq('s2', 'specialty')})""",
    "model_eligibility": f"WITH {ELIGIBLE_ALL} SELECT * FROM eligible",
    "model_frame_freq": f"""WITH {RAT}, f AS (SELECT {_age_gp()} AS age_gp, {_URGENT_YN} AS urgent_yn FROM rat WHERE booked_procedure IN
        (SELECT booked_procedure FROM rat GROUP BY 1 HAVING count(*) >= 20)) {_freq('f', 'age_gp', 'urgent_yn')}""",
    "model_cells": f"WITH {ELIGIBLE} SELECT * FROM mcells",
    "model_cells_whole_cohort": f"WITH {WHOLE} SELECT * FROM mcells",
    "model_sample_size": f"""WITH {ELIGIBLE} SELECT (SELECT count(*) FROM eligible) AS n_procedures,
        (SELECT CAST(sum(num_of_raters) AS BIGINT) FROM eligible) AS n_ratings, CAST(sum(n) AS BIGINT) AS n_modelled FROM mcells""",
    "fixed_effect_odds": f"""WITH RECURSIVE {LOGIT} SELECT "Variable", round_even(exp(b), 2) AS "OddsRatio",
        round_even(exp(b - 1.96e0 * sqrt(v)), 2) AS "LL", round_even(exp(b + 1.96e0 * sqrt(v)), 2) AS "UL" FROM coef""",
    "icc": _mixed_icc(ELIGIBLE),
    "random_intercept_odds": _mixed_odds(ELIGIBLE, _MAIN),
    "interaction_odds": _mixed_odds(ELIGIBLE, {**_MAIN, **_CROSS}),
    "whole_cohort_odds": _mixed_odds(WHOLE, _WHOLE_MAIN),
    "whole_cohort_interaction_odds": _mixed_odds(WHOLE, {**_WHOLE_MAIN, **_CROSS}),
    "model_lrt": _mixed_test(ELIGIBLE, _MAIN),
    "whole_cohort_lrt": _mixed_test(WHOLE, _WHOLE_MAIN),
    "whole_cohort_icc": _mixed_icc(WHOLE),
}
