"""The same results in plain SQL, for comparison on another engine.

Written from the definitions, not from the Spark plans: distances are two-sided, the
entropy is the textbook sum, the generator is stepped by recursion.
"""

from __future__ import annotations

import hashlib

from voilage import fixed_values as fixed
from voilage.workload.settings import CHECK_SEED, NAME_PREFIXES, THRESHOLDS, WORD_BREAK

SALT = "change-me-salt"
STRICT_JSON = (
    '{"epsilon":2.0,"kAnon":10,"lDiv":3,"tClose":0.3,"zip3":true,"yearOnly":true,'
    '"hashIds":true,"maskPII":true,"suppressExtras":true,"noiseRevenue":true}'
)


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- inputs ---------------------------------------------------------------------------

CLIENTS = """clients AS (
SELECT CAST(o_orderkey AS VARCHAR) AS id_client,
       concat(lower(replace(c_name,'#','.')),'@bnc.example') AS email,
       concat('418-555-', lpad(CAST(o_orderkey % 10000 AS VARCHAR),4,'0')) AS telephone,
       concat(CASE c_nationkey % 3 WHEN 0 THEN 'G7H' WHEN 1 THEN 'H2X' ELSE 'J4K' END,
              CAST(o_orderkey % 10 AS VARCHAR), 'B', CAST(c_custkey % 10 AS VARCHAR)) AS code_postal,
       substr(CAST(o_orderdate AS VARCHAR),1,10) AS date_naissance,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS revenu_annuel,
       c_mktsegment AS type_compte, o_orderpriority AS statut
FROM orders JOIN customer ON o_custkey = c_custkey)"""

CATALOG = f"""words AS (
SELECT doc_id, regexp_split_to_array(text, {text(WORD_BREAK)}) AS ws FROM documents),
catalog AS (
SELECT CAST(doc_id AS VARCHAR) AS table_name, ordinal,
       concat(list_extract([{', '.join(text(p) for p in NAME_PREFIXES)}],
              CAST(1 + (doc_id + ordinal) % {len(NAME_PREFIXES)} AS BIGINT)), w) AS column_name
FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS ordinal FROM words)),
names AS (SELECT DISTINCT column_name, lower(column_name) AS n FROM catalog)"""

AMOUNTS = """amounts AS (
SELECT l_orderkey, l_linenumber,
  CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN units WHEN 1 THEN units || ' $' WHEN 2 THEN '-' || units
    WHEN 3 THEN units || '.' || CAST(l_linenumber AS VARCHAR)
    WHEN 4 THEN units || '-5' WHEN 5 THEN units || '.2.3' WHEN 6 THEN 'abc'
    ELSE 'CAD ' || cents END AS amount
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS units,
             CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM lineitem))"""

# --- scalar treatments ------------------------------------------------------------------


def year_or_empty(x: str) -> str:
    return rf"regexp_extract({x}, '\b((19|20)\d{{2}})\b', 1)"


def only_year(x: str) -> str:
    return f"coalesce(nullif({year_or_empty(x)}, ''), substr({x}, 1, 4))"


def area(x: str) -> str:
    blanks = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    return f"substr(upper(replace(regexp_replace({x}, '{blanks}', '', 'g'), 'ß', 'SS')), 1, 3)"


def masked_area(x: str) -> str:
    return f"(CASE WHEN {area(x)} = '' THEN '' ELSE {area(x)} || '***' END)"


def number(x: str, kept: str = "0-9.-") -> str:
    left = f"regexp_replace({x}, '[^{kept}]', '', 'g')"
    return f"(CASE WHEN {left} = '' THEN CAST(0 AS DOUBLE) ELSE TRY_CAST({left} AS DOUBLE) END)"


def long_text(x: str) -> str:
    """A whole number of 1e22 or more: its shortest digits, then zeros."""
    shown = f"CAST(abs({x}) AS VARCHAR)"
    digits = f"replace(split_part({shown}, 'e', 1), '.', '')"
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || rpad({digits}, CAST(split_part({shown}, 'e', 2) AS INTEGER) + 1, '0')"


def whole_text(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e37 THEN format('{{:.0f}}', {x}) ELSE {long_text(x)} END"


def income_bin(x: str) -> str:
    low = f"CAST(floor({number(x)} / 10000) * 10 AS BIGINT)"
    label = f"CAST({low} AS VARCHAR) || '–' || CAST({low} + 10 AS VARCHAR) || 'k'"
    return f"coalesce({label}, '')"


def band(x: str) -> str:
    n = number(x, "0-9.")
    return (
        f"(CASE WHEN {n} IS NULL THEN {x} WHEN {n} < 40000 THEN '<40k' WHEN {n} < 60000 THEN '40-60k' "
        f"WHEN {n} < 80000 THEN '60-80k' ELSE '>=80k' END)"
    )


def below(x: str) -> str:
    whens = " ".join(f"WHEN {number(x)} < {t} THEN '<{t}'" for t in THRESHOLDS)
    return f"(CASE WHEN {number(x)} IS NULL THEN '' {whens} ELSE '≥{THRESHOLDS[-1]}' END)"


def mask(x: str) -> str:
    lines = (
        f"array_to_string(list_transform(string_split({x}, chr(10)), lambda p: CASE WHEN length(p) > 2 "
        f"THEN repeat('*', length(p) - 2) || right(p, 2) ELSE p END), chr(10))"
    )
    return (
        f"(CASE WHEN contains({x}, '@') THEN substr(split_part({x},'@',1),1,2) || '***@' || split_part({x},'@',2) "
        f"WHEN length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 8 THEN substr({x},1,2) || '****' || right({x},2) "
        f"ELSE {lines} END)"
    )


def hmac12(x: str) -> str:
    key = SALT.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({x})))), 1, 12)"


def draw(*parts: str) -> str:
    digits = f"substr(sha256(concat_ws(chr(31), {', '.join([text(CHECK_SEED), *parts])})), 1, 13)"
    return f"((CAST(CAST(('0x' || {digits}) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0)"


def laplace(x: str, u01: str, scale: int = 250) -> str:
    u = f"({u01} - 0.5e0)"
    return f"({x} - {scale}e0 * sign({u}) * ln(1e0 - 2e0 * abs({u})))"


def noised(x: str, *parts: str) -> str:
    value = laplace(number(x), draw(*parts, x))
    return f"coalesce(CAST(CAST(floor({value} + 0.5e0) AS BIGINT) AS VARCHAR), {x})"


CLIENT_NAMES = (
    "id_client", "email", "telephone", "code_postal", "date_naissance", "revenu_annuel", "type_compte", "statut",
)
# --- tables of treated rows ----------------------------------------------------------------

HELPED = f"""helped AS (
SELECT *, {only_year('date_naissance')} AS y, {masked_area('code_postal')} AS f, {income_bin('revenu_annuel')} AS b
FROM clients)"""

TREATED = f"""switched AS (
SELECT sha256(id_client) AS id_client, {mask('email')} AS email, {mask('telephone')} AS telephone,
       {masked_area('code_postal')} AS code_postal, {only_year('date_naissance')} AS date_naissance,
       {noised('revenu_annuel', "'revenue'", 'id_client')} AS revenu_annuel, type_compte, statut
FROM clients),
treated AS (
SELECT *, date_naissance AS "_year", code_postal AS "_fsa", {income_bin('revenu_annuel')} AS "_revBin" FROM switched)"""

_DATE_RULE = year_or_empty("date_naissance")
_AREA_RULE = area("code_postal")
_NOISE_RULE = noised("revenu_annuel", "'rule:revenu_annuel'", "id_client")
AUTO_TREATED = f"""ruled AS (
SELECT id_client AS record, id_client, {mask('email')} AS email, {mask('telephone')} AS telephone,
       {_AREA_RULE} AS code_postal, {_DATE_RULE} AS date_naissance, {_NOISE_RULE} AS revenu_annuel, type_compte, statut
FROM clients),
switched AS (
SELECT sha256(id_client) AS id_client, {mask('email')} AS email, {mask('telephone')} AS telephone,
       {masked_area('code_postal')} AS code_postal, {only_year('date_naissance')} AS date_naissance,
       {noised('revenu_annuel', "'revenue'", 'record')} AS revenu_annuel, type_compte, statut
FROM ruled),
treated AS (
SELECT *, date_naissance AS "_year", code_postal AS "_fsa", {income_bin('revenu_annuel')} AS "_revBin" FROM switched)"""


def judged(source: str, keys: tuple[str, ...], s: str = "statut") -> str:
    """CTEs up to ``stats``: (keys, n, l, tvd) per class of ``source``, with distances over all values."""
    k = ", ".join(keys)
    on = " AND ".join(f"g.{c} = p.{c}" for c in keys)
    return f"""pairs AS (SELECT {k}, {s} AS s, count(*) AS c FROM {source} GROUP BY ALL),
sizes AS (SELECT {k}, sum(c) AS n, count(*) AS l FROM pairs GROUP BY ALL),
overall AS (SELECT s, sum(c) AS cc, sum(sum(c)) OVER () AS nn FROM pairs GROUP BY s),
grid AS (SELECT sizes.*, s, cc, nn FROM sizes CROSS JOIN overall),
stats AS (
SELECT {', '.join('g.' + c for c in keys)}, max(g.n) AS n, max(g.l) AS l,
       CAST(sum(abs(coalesce(p.c, 0) * g.nn - g.cc * g.n)) AS DOUBLE) / (2e0 * max(g.n) * max(g.nn)) AS tvd
FROM grid g LEFT JOIN pairs p ON {on} AND g.s = p.s GROUP BY ALL)"""


HELPED_KEYS = ("y", "f", "b")
TREATED_KEYS = ('"_year"', '"_fsa"', '"_revBin"')


def kept_ids(where: str) -> str:
    return (
        f"WITH {CLIENTS}, {HELPED}, {judged('helped', HELPED_KEYS)} "
        f"SELECT id_client FROM helped JOIN stats USING (y, f, b) WHERE {where}"
    )


def kept_rows(treated: str, s: str = "statut", keys: tuple[str, ...] = TREATED_KEYS) -> str:
    return (
        f"WITH {CLIENTS}, {treated}, {judged('treated', keys, s)}, "
        f'kept AS (SELECT {", ".join("treated." + c for c in CLIENT_NAMES)} FROM treated '
        f"JOIN stats USING ({', '.join(keys)}) WHERE n >= 10 AND l >= 3 AND tvd <= 0.3e0)"
    )


def evaluated(source: str, keys: str, k: int) -> str:
    return f"""sized AS (SELECT count(*) AS n, count(DISTINCT statut) AS d FROM {source} GROUP BY {keys})
SELECT round(coalesce(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) * 100e0 / sum(n), 0), 6) AS individualisation,
       round(coalesce(sum(CASE WHEN n < {k} THEN n ELSE 0 END) * 100e0 / sum(n), 0), 6) AS correlation,
       round(coalesce(sum((CASE WHEN d <= 1 THEN 100e0 ELSE (1 - 1e0 / d) * 100 END) * n) / sum(n), 0), 6) AS inference
FROM sized"""


def scored(source: str, key: str, s: str, pii: str) -> str:
    """One scalar row of the three scores, as a subquery."""
    return f"""(WITH r AS (SELECT {key} AS k, {s} AS s, {pii} AS p FROM {source}),
g AS (SELECT k, s, count(*) AS c FROM r GROUP BY k, s),
q AS (SELECT k, sum(c) AS n, max(c) AS top FROM g GROUP BY k),
v AS (SELECT s, sum(c) AS c FROM g GROUP BY s),
h AS (SELECT -sum((c * 1e0 / t) * log2(c * 1e0 / t)) AS bits FROM v, (SELECT sum(c) AS t FROM v)),
a AS (SELECT avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END) AS alone, avg(top * 1e0 / n) AS share FROM q),
b AS (SELECT avg(CASE WHEN p THEN 1e0 ELSE 0e0 END) AS pii FROM r)
SELECT 100 * (0.6e0 * pii + 0.4e0 * alone) AS individualization, 100 * alone AS correlation,
       100 * share * (0.6e0 + 0.4e0 * (1 - least(1e0, bits / 4))) AS inference FROM a, b, h)"""


RAW_SCORES = scored("clients", "concat_ws('|', date_naissance, code_postal, revenu_annuel)", "statut", "true")
HELPED_SCORES = scored("helped", "concat_ws('|', y, f, b)", "statut", "true")
STAGES = f"""scores AS (
SELECT 'before' AS stage, * FROM {RAW_SCORES} UNION ALL SELECT 'after' AS stage, * FROM {HELPED_SCORES})"""


def compliance(before: str, after: str) -> str:
    parts = [
        f"SELECT '{name}' AS criterion, b.{name} AS before, a.{name} AS after, {limit} AS threshold FROM {before} b, {after} a"
        for name, limit in (("individualization", 20), ("correlation", 30), ("inference", 35))
    ]
    return f"""SELECT criterion, round(before, 6) AS before, round(after, 6) AS after, threshold,
CASE WHEN after IS NULL THEN 'N/A' WHEN after <= threshold THEN 'Conforme' ELSE 'À améliorer' END AS verdict,
greatest(0, CAST(floor(before - after + 0.5e0) AS BIGINT)) AS reduction FROM ({' UNION ALL '.join(parts)})"""


# --- policy ---------------------------------------------------------------------------------


def hit(pattern: str, n: str = "n") -> str:
    return f"regexp_matches({n}, {text(pattern)})"


def first_match(rules: tuple, default: object) -> str:
    def lit(v: object) -> str:
        return text(v) if isinstance(v, str) else str(v)

    return "(CASE " + " ".join(f"WHEN {hit(r[0])} THEN {lit(r[1])}" for r in rules) + f" ELSE {lit(default)} END)"


TYPE = first_match(fixed.TYPE_RULES, fixed.TYPE_DEFAULT)
CAT = first_match(fixed.CATEGORY_RULES, fixed.CATEGORY_DEFAULT)
RISK = first_match(fixed.RISK_RULES, fixed.RISK_DEFAULT)
CLASSIFIED = f"""classified AS (
SELECT *, CASE WHEN risk >= 70 THEN 'Élevé' WHEN risk >= 40 THEN 'Moyen' ELSE 'Faible' END AS bucket FROM (
SELECT column_name, n, {TYPE} AS type, {CAT} AS cat, {hit(fixed.PERSONAL)} AS pii, {RISK} AS risk FROM names))"""
MONEY = "(type = 'Numérique' OR cat = 'Finance')"
DEFAULT_ACTION = (
    f"CASE WHEN type = 'Identifiant' THEN 'pseudonymize' WHEN {MONEY} OR type IN ('Date', 'Géoloc') "
    "THEN 'generalize' ELSE 'none' END"
)
DEFAULT_GRAIN = (
    f"CASE WHEN type = 'Identifiant' THEN NULL WHEN {MONEY} THEN 'bin' WHEN type = 'Date' THEN 'year' "
    "WHEN type = 'Géoloc' THEN 'postal_fsa' END"
)
ACTIONS = (
    "concat('none', CASE WHEN type = 'Identifiant' THEN ',pseudonymize,mask' ELSE '' END, "
    f"CASE WHEN {MONEY} THEN ',generalize,noise' ELSE '' END, "
    f"CASE WHEN type IN ('Date', 'Géoloc') AND NOT {MONEY} THEN ',generalize' ELSE '' END, "
    "CASE WHEN type = 'Texte' THEN ',mask' ELSE '' END, ',suppress')"
)


def chosen(scores: str) -> str:
    high = "(SELECT individualization >= 70 FROM m)"
    linked = "(SELECT correlation >= 60 FROM m)"
    told = "(SELECT inference >= 60 FROM m)"
    noise = f"type NOT IN ('Identifiant') AND NOT {high} AND NOT ({linked} AND type IN ('Date','Géoloc')) AND {told} AND {MONEY}"
    return f"""m AS (SELECT * FROM {scores})
SELECT column_name,
 CASE WHEN type = 'Identifiant' OR {high} THEN 'pseudonymize'
      WHEN {linked} AND type IN ('Date','Géoloc') THEN 'generalize'
      WHEN {noise} THEN 'noise' ELSE {DEFAULT_ACTION} END AS action,
 CASE WHEN type = 'Identifiant' OR {high} THEN NULL
      WHEN {linked} AND type = 'Date' THEN 'year' WHEN {linked} AND type = 'Géoloc' THEN 'postal_fsa'
      WHEN {noise} THEN NULL ELSE {DEFAULT_GRAIN} END AS granularity,
 CASE WHEN {noise} THEN 2e0 END AS epsilon, CASE WHEN {noise} THEN 10 END AS round
FROM classified"""


def reduction(n: str, ids: bool, dates: bool, postal: bool, money: int) -> str:
    terms = [
        f"CASE WHEN {hit(p, n)} THEN {points} ELSE 0 END"
        for on, (p, points) in (
            (ids, fixed.REDUCTION_IDS), (dates, fixed.REDUCTION_DATES), (postal, fixed.REDUCTION_POSTAL),
            (True, (fixed.REDUCTION_MONEY, money)),
        )
        if on
    ]
    return f"least(50, {' + '.join(terms)})"


def role(name: str) -> str:
    n = "lower(column_name)"
    return f"arg_min(column_name, ordinal) FILTER (WHERE {hit(fixed.ROLE_PATTERNS[name], n)}) AS {name}"


# --- generator -----------------------------------------------------------------------------


def _profile(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS colonne, count(DISTINCT coalesce(CAST({c} AS VARCHAR), '')) AS "distinct",
count(*) FILTER (WHERE coalesce(CAST({c} AS VARCHAR), '') = '') AS vides, count(*) AS total,
{len(columns)} AS colonnes FROM {source}"""
        for c in columns
    )


FIXED_ROWS = f"""SELECT {hmac12('id_client')} AS id_client, email, telephone,
substr(code_postal, 1, 3) || '***' AS code_postal, substr(date_naissance, 1, 4) AS date_naissance,
{band('revenu_annuel')} AS revenu_annuel, type_compte, statut FROM clients"""


def _audit(columns: str, source: str, k: int) -> str:
    return f"""SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS groupes, count(*) FILTER (WHERE n < {k}) AS "nonConformes",
count(*) FILTER (WHERE n < {k}) = 0 AS conforme FROM (SELECT {columns}, count(*) AS n FROM {source} GROUP BY ALL)"""


def statements() -> dict[str, str]:
    first = "split_part(text, chr(10), 1)"

    def marks(d: str) -> str:
        return f"(length({first}) - length(replace({first}, {d}, '')))"

    comma, semicolon, tab = marks("','"), marks("';'"), marks("chr(9)")
    year = "CAST(page_id % 300 + 1850 AS VARCHAR)"
    page = f"CASE WHEN page_id % 3 = 0 THEN {year} || '-' || html ELSE html || ' le ' || {year} END"
    report = [
        ("dataset", "file", "clients&lt;1&gt;.csv"), ("dataset", "delimiter", ","), ("parameters", "k", "10"),
        ("parameters", "l", "3"), ("parameters", "t", "0.3"), ("parameters", "epsilon", "2"),
        ("mapping", "id", "id_client"), ("mapping", "postal", "code_postal"), ("mapping", "date1", "date_naissance"),
        ("mapping", "date2", "—"), ("mapping", "revenue", "revenu_annuel"), ("mapping", "sensitive", "statut"),
        ("mapping", "QI", "date_naissance, code_postal, revenu_annuel"),
    ]
    clients = f"WITH {CLIENTS} "
    documents = "documents LEFT JOIN labels USING (doc_id)"
    published = kept_rows(TREATED).replace("treated.revenu_annuel", 'treated."_revBin" AS revenu_annuel')
    accounts = scored("clients", "type_compte", "statut", "true")
    return {
        "src_client_records": clients + "SELECT * FROM clients",
        "src_csv_scan": clients + "SELECT * FROM clients",
        "src_csv_scan_multiline": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents",
        "src_delimiter": f"""SELECT doc_id, CASE WHEN {comma} >= {semicolon} AND {comma} >= {tab} THEN ','
WHEN {semicolon} >= {tab} THEN ';' ELSE chr(9) END AS delimiter FROM documents""",
        "src_delimiter_record": """SELECT chr(9) AS delimiter, true AS has_header, 'conv_id|turn|role' AS columns,
count(*) AS rows FROM conversations""",
        "src_header": f"""SELECT doc_id, regexp_matches(replace({first}, '|', ''), '[A-Za-z_]') AS has_header,
CASE WHEN regexp_matches(replace({first}, '|', ''), '[A-Za-z_]') THEN replace({first}, '|', '/')
ELSE array_to_string(list_transform(range(1, len(string_split({first}, '|')) + 1), lambda i: 'Col ' || CAST(i AS VARCHAR)), '/')
END AS names FROM documents""",
        "src_sampled_scan": """SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS conv_id, coalesce(CAST(turn AS VARCHAR), '') AS turn,
coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations""",
        "src_row_count": " UNION ALL ".join(
            f"SELECT '{t}' AS name, count(*) AS total FROM {t}" for t in ("orders", "lineitem", "documents", "events")
        ),
        "src_csv_quoted_header": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, 3 AS n_columns FROM documents",
        "src_csv_many_headers": """SELECT CAST(doc_id AS VARCHAR) AS id, lang, text, NULL AS source, NULL AS role FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, source, NULL FROM documents
UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, NULL, NULL, role FROM conversations""",
        "src_delimiter_record_text": """SELECT chr(9) AS delimiter, true AS has_header, 'conv_id|turn|role|text' AS columns,
count(*) AS rows FROM conversations""",
        "src_csv_carriage_returns": "SELECT CAST(doc_id AS VARCHAR) AS id, translate(text, chr(13), ' ') AS texte, lang, source FROM documents",
        "src_csv_latin1": r"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS text, lang FROM documents""",
        "prj_sha256": "SELECT doc_id, sha256(text) AS digest FROM documents",
        "prj_hmac": f"SELECT doc_id, {hmac12('text')} AS pseudonym FROM documents",
        "prj_years": f"""SELECT page_id, {only_year('t')} AS only_year, {year_or_empty('t')} AS date_year,
substr(t, 1, 4) AS leading_year FROM (SELECT page_id, {page} AS t FROM pages)""",
        "prj_postal": f"""SELECT doc_id, {masked_area('text')} AS area_masked, {area('text')} AS area,
substr(text, 1, 3) || '***' AS area_short FROM documents""",
        "prj_amount": f"""WITH {AMOUNTS} SELECT l_orderkey, l_linenumber, amount, {number('amount')} AS parsed,
{number('amount', '0-9.')} AS "unsigned" FROM amounts""",
        "prj_income_bins": f"""WITH {AMOUNTS} SELECT l_orderkey, l_linenumber, amount, {income_bin('amount')} AS bin,
{below('amount')} AS below, {band('amount')} AS band FROM amounts""",
        "prj_large_amounts": """WITH large AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '' END
|| CAST(l_orderkey + 1000000 AS VARCHAR) || '7' || repeat('0', CAST(l_linenumber + 7 AS INTEGER)) AS amount FROM lineitem),
low AS (SELECT *, CAST(amount AS HUGEINT) AS v, ((CAST(amount AS HUGEINT) % 10000) + 10000) % 10000 AS rest FROM large)
SELECT l_orderkey, l_linenumber, amount, CAST((v - rest) // 10000 * 10 AS VARCHAR) || '–'
|| CAST((v - rest) // 10000 * 10 + 10 AS VARCHAR) || 'k' AS bin, CAST(CAST(CAST(amount AS DOUBLE) AS HUGEINT) AS VARCHAR) AS whole FROM low""",
        "prj_huge_amounts": f"""WITH huge AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS below, l_orderkey + 1000000 AS head,
CAST(l_linenumber * 7 + l_orderkey % 5 AS INTEGER) AS zeros FROM lineitem),
written AS (SELECT *, CASE WHEN below THEN '-' ELSE '' END || head || '7' || repeat('0', zeros) AS amount FROM huge),
read AS (SELECT *, CAST(amount AS DOUBLE) AS x FROM written WHERE zeros >= 16)
SELECT l_orderkey, l_linenumber, amount, CASE WHEN abs(x) >= 1e31 THEN {long_text('x / 1e4 * 1e1')} || '–' || {long_text('(x / 1e4 + 1e0) * 1e1')} || 'k'
WHEN below THEN '-' || head || '7' || repeat('0', zeros - 3) || '–-' || head || '6' || repeat('9', zeros - 4)
|| '0k' ELSE head || '7' || repeat('0', zeros - 3) || '–' || head || '7' || repeat('0', zeros - 5) || '10k' END AS bin,
{whole_text('x')} AS whole, {whole_text('x')} AS noised FROM read""",
        "prj_rule_options": f"""{clients}, ruled AS (SELECT *, CAST(floor({laplace(number('revenu_annuel'), draw("'rule:revenu_annuel'", 'id_client', 'revenu_annuel'), 100)} + 0.5e0) AS BIGINT) AS noisy
FROM clients) SELECT {hmac12('id_client')} AS id_client, email, telephone, {area('code_postal')} AS code_postal,
{year_or_empty('date_naissance')} AS date_naissance, CAST(CAST(floor(noisy / 10e0 + 0.5e0) * 10 AS BIGINT) AS VARCHAR) AS revenu_annuel,
type_compte, statut, id_client AS numero FROM ruled""",
        "udf_registered_action": f"""{clients} SELECT id_client, substr(email, 1, 1) || '.' AS email, right(telephone, 4) AS telephone, code_postal,
date_naissance, revenu_annuel, type_compte, {mask('statut')} AS statut FROM clients""",
        "pol_chosen_rules_applied": f"""WITH {CLIENTS}, {HELPED}, m AS (SELECT individualization >= 70 AS high, inference >= 60 AS told FROM {HELPED_SCORES})
SELECT sha256(id_client) AS id_client, sha256(email) AS email,
CASE WHEN high THEN sha256(code_postal) ELSE {area('code_postal')} END AS code_postal,
CASE WHEN high THEN sha256(date_naissance) ELSE {year_or_empty('date_naissance')} END AS date_naissance,
CASE WHEN high THEN sha256(revenu_annuel) WHEN told THEN CAST(CAST(floor(CAST({noised('revenu_annuel', "'rule:revenu_annuel'", 'id_client', 'email', 'code_postal', 'date_naissance', 'revenu_annuel', 'statut')} AS BIGINT) / 10e0 + 0.5e0) * 10 AS BIGINT) AS VARCHAR)
ELSE {income_bin('revenu_annuel')} END AS revenu_annuel,
CASE WHEN high THEN sha256(statut) ELSE statut END AS statut FROM clients, m""",
        "prj_default_rules_applied": f"""{clients} SELECT sha256(id_client) AS id_client, {area('code_postal')} AS code_postal,
{year_or_empty('date_naissance')} AS date_naissance, {income_bin('revenu_annuel')} AS revenu_annuel, statut FROM clients""",
        "prj_mask": f"""{clients}, cells AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS key, text AS v FROM documents
UNION ALL SELECT 'e' || id_client, email FROM clients UNION ALL SELECT 't' || id_client, telephone FROM clients
UNION ALL SELECT 's' || id_client, type_compte FROM clients) SELECT key, {mask('v')} AS masked FROM cells""",
        "prj_laplace": f"""{clients} SELECT id_client, round({draw('id_client')}, 9) AS draw,
round({laplace('CAST(revenu_annuel AS DOUBLE)', draw('id_client'))}, 6) AS noised,
CAST(revenu_annuel AS DOUBLE) AS without_budget,
CAST(CAST(floor({laplace('CAST(revenu_annuel AS DOUBLE)', draw('id_client'))} + 0.5e0) AS BIGINT) AS VARCHAR) AS rounded
FROM clients""",
        "prj_apply_rules": f"""{clients} SELECT sha256(id_client) AS id_client, {mask('email')} AS email, '' AS telephone,
{area('code_postal')} AS code_postal, {year_or_empty('date_naissance')} AS date_naissance,
{below('revenu_annuel')} AS revenu_annuel, type_compte, statut, id_client AS numero FROM clients""",
        "prj_noise_rule": f"""{clients} SELECT id_client,
{noised('revenu_annuel', "'rule:revenu_annuel'", 'id_client')} AS revenu_annuel,
{noised('telephone', "'rule:telephone'", 'id_client')} AS telephone FROM clients""",
        "prj_role_switches": f"WITH {CLIENTS}, {TREATED} SELECT * FROM treated",
        "prj_role_switches_off": f"""WITH {CLIENTS}, {HELPED} SELECT * EXCLUDE (y, f, b), y AS "_year", f AS "_fsa",
b AS "_revBin" FROM helped""",
        "prj_risk_helpers": f"""WITH {CLIENTS}, {HELPED} SELECT id_client, y AS "_year", f AS "_fsa", b AS "_revBin" FROM helped""",
        "prj_class_key": f"""WITH {CLIENTS}, {HELPED} SELECT id_client, statut || '|' || f || '|' || y || '|' || b AS cle FROM helped""",
        "prj_fixed_rules": clients + FIXED_ROWS,
        "prj_unaccent": "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents",
        "prj_column_search": f"WITH {CATALOG} SELECT column_name FROM names WHERE contains(n, 'tion')",
        "prj_escape_markup": "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages",
        "flt_pii_rows": clients + "SELECT id_client FROM clients WHERE type_compte <> 'BUILDING'",
        "flt_k_anonymity": kept_ids("n >= 10"),
        "flt_l_diversity": kept_ids("n >= 2 AND l >= 4"),
        "flt_t_closeness": kept_ids("n >= 12 AND l >= 5 AND tvd <= 0.25e0"),
        "jn_class_size": f"""WITH {CLIENTS}, {HELPED}, sizes AS (SELECT y, f, b, count(*) AS n FROM helped GROUP BY ALL)
SELECT id_client, n FROM helped JOIN sizes USING (y, f, b)""",
        "jn_kept_rows": f"""WITH {CLIENTS}, {HELPED}, {judged('helped', HELPED_KEYS)}
SELECT id_client, statut FROM helped JOIN stats USING (y, f, b) WHERE n >= 10 AND l >= 3 AND tvd <= 0.3e0""",
        "agg_class_sizes": f"""WITH {CLIENTS}, {HELPED}
SELECT y AS annee, f AS secteur, b AS tranche, count(*) AS n FROM helped GROUP BY ALL""",
        "agg_class_stats": f"""WITH {CLIENTS}, {HELPED}, {judged('helped', HELPED_KEYS)}
SELECT y AS annee, f AS secteur, b AS tranche, CAST(n AS BIGINT) AS n, l, round(tvd, 9) AS tvd FROM stats""",
        "agg_class_stats_many_values": f"""WITH days AS (SELECT o_orderstatus, substr(CAST(o_orderdate AS VARCHAR),1,10) AS jour FROM orders),
{judged('days', ('o_orderstatus',), 'jour')}
SELECT o_orderstatus, CAST(n AS BIGINT) AS n, l, round(tvd, 9) AS tvd FROM stats""",
        "agg_distribution": clients + """SELECT type_compte AS value, count(*) AS c, (SELECT count(*) FROM clients) AS n
FROM clients GROUP BY type_compte""",
        "agg_tvd": f"""{clients}, a AS (SELECT date_naissance AS v, count(*) AS c FROM clients WHERE type_compte = 'FURNITURE' GROUP BY 1),
b AS (SELECT date_naissance AS v, count(*) AS c FROM clients GROUP BY 1)
SELECT round(0.5e0 * sum(abs(coalesce(a.c, 0) * 1e0 / (SELECT sum(c) FROM a) - coalesce(b.c, 0) * 1e0 / (SELECT sum(c) FROM b))), 9) AS tvd
FROM a FULL JOIN b ON a.v = b.v""",
        "agg_risk_metrics": f"""WITH {CLIENTS}, {HELPED}, {STAGES} SELECT stage, round(individualization, 6) AS individualization,
round(correlation, 6) AS correlation, round(inference, 6) AS inference FROM scores""",
        "agg_risk_metrics_other_roles": f"""{clients} SELECT round(individualization, 6) AS individualization,
round(correlation, 6) AS correlation, round(inference, 6) AS inference
FROM {scored('clients', 'type_compte', 'statut', 'false')}""",
        "agg_evaluate": f"WITH {CLIENTS}, {TREATED}, {evaluated('treated', 'date_naissance, code_postal', 60)}",
        "agg_kept_counts": f"""WITH {CLIENTS}, {HELPED}, {judged('helped', HELPED_KEYS)}
SELECT CAST(coalesce(sum(n) FILTER (WHERE n >= 10 AND l >= 3 AND tvd <= 0.3e0), 0) AS BIGINT) AS kept, CAST(sum(n) AS BIGINT) AS total FROM stats""",
        "agg_profile": clients + _profile("clients", CLIENT_NAMES),
        "agg_profile_documents": _profile(documents, ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")),
        "agg_row_audit": _audit("l_returnflag, l_linestatus, l_quantity, l_suppkey", "lineitem", 3),
        "agg_row_audit_whole_rows": _audit("*", "lineitem", 2),
        "agg_class_audit": f"""WITH {CLIENTS}, {HELPED}, sizes AS (SELECT y, f, b, count(*) AS n FROM helped GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS classes, min(n) AS smallest, count(*) FILTER (WHERE n < 10) AS below_k,
count(*) FILTER (WHERE n < 10) = 0 AS conforming FROM sizes""",
        "agg_row_audit_documents": _audit("text, lang", "documents", 2),
        "sink_csv": f"""WITH {CLIENTS}, {HELPED}, {judged('helped', HELPED_KEYS)}
SELECT statut, id_client, email, revenu_annuel FROM helped JOIN stats USING (y, f, b) WHERE n >= 10 AND l >= 3 AND tvd <= 0.3e0""",
        "sink_job_definitions": f"""WITH {CATALOG}, found AS (SELECT table_name, {', '.join(role(r) for r in fixed.ROLE_PATTERNS)}
FROM catalog GROUP BY table_name)
SELECT table_name, ';' AS delimiter, 10 AS k_anon, 2e0 AS epsilon, true AS zip3, id, date1, sensitive,
concat_ws('|', date1, postal, revenue) AS qids FROM found""",
        "sink_whole_definitions": f"""WITH {CATALOG}, found AS (SELECT table_name, {', '.join(role(r) for r in fixed.ROLE_PATTERNS)}
FROM catalog GROUP BY table_name), firsts AS (SELECT table_name, column_name, lower(column_name) AS n, min(ordinal) AS o FROM catalog GROUP BY ALL),
ruled AS (SELECT table_name, column_name, o, {first_match(fixed.RECOMMENDATION_RULES, 'none')} AS action,
CASE WHEN {hit('email|courriel|phone|tel|tél')} THEN NULL WHEN {hit('date')} THEN 'date-year'
WHEN {hit('postal|zip|fsa')} THEN 'postal-fsa' END AS param_type FROM firsts),
folded AS (SELECT table_name, sha256(string_agg(column_name, '|' ORDER BY o)) AS columns,
sha256(coalesce(string_agg(column_name || ':' || action || ':' || coalesce(param_type, ''), '|' ORDER BY o) FILTER (action <> 'none'), '')) AS transforms,
count(*) AS n_columns, count(*) FILTER (action <> 'none') AS n_transforms FROM ruled GROUP BY table_name)
SELECT table_name, ';' AS delimiter, {text(STRICT_JSON)} AS settings, id, postal, date1, date2, revenue, sensitive,
concat_ws('|', date1, postal, revenue) AS qids, columns, transforms, n_columns, n_transforms FROM found JOIN folded USING (table_name)""",
        "sink_one_csv": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, 1 AS n_files FROM documents",
        "sink_journal_order": """SELECT strftime(ts, '%Y-%m-%d %H:%M') AS at, event_type AS action, props AS data, CAST(event_id AS BIGINT) AS entry,
row_number() OVER (ORDER BY date_trunc('minute', ts) DESC, event_id DESC) AS position FROM events""",
        "sink_audit_report": _audit("user_id, event_type", "events", 3),
        "sink_run_report": f"""{clients} SELECT * FROM (VALUES {', '.join(f'({text(a)}, {text(b)}, {text(c)})' for a, b, c in report)})
AS r(section, key, value) UNION ALL SELECT 'dataset', 'rows', CAST(count(*) AS VARCHAR) FROM clients""",
        "sink_journal": """SELECT strftime(ts, '%Y-%m-%d %H:%M') AS at, event_type AS action, props AS data FROM events""",
        "pol_guess_mapping": f"""WITH {CATALOG}, found AS (SELECT table_name, {', '.join(role(r) for r in fixed.ROLE_PATTERNS)}
FROM catalog GROUP BY table_name)
SELECT *, concat_ws('|', date1, postal, revenue) AS qids FROM found""",
        "pol_classify": f"WITH {CATALOG}, {CLASSIFIED} SELECT column_name, type, cat, pii, risk, bucket FROM classified",
        "pol_allowed_actions": f"WITH {CATALOG}, {CLASSIFIED} SELECT column_name, {ACTIONS} AS actions FROM classified",
        "pol_default_rules": f"""WITH {CATALOG}, {CLASSIFIED} SELECT column_name, {DEFAULT_ACTION} AS action, {DEFAULT_GRAIN} AS granularity,
CAST(NULL AS DOUBLE) AS epsilon, CAST(NULL AS INTEGER) AS round FROM classified""",
        "pol_choose_rules": f"WITH {CATALOG}, {CLIENTS}, {CLASSIFIED}, {chosen(RAW_SCORES)}",
        "pol_auto_rules": f"""WITH {CATALOG}, {CLIENTS}, {CLASSIFIED}, {chosen(scored('clients', 'telephone', 'type_compte', 'true'))}""",
        "pol_recommend": f"""WITH {CATALOG} SELECT column_name, {first_match(fixed.RECOMMENDATION_RULES, 'none')} AS action,
CASE WHEN {hit('email|courriel|phone|tel|tél')} THEN NULL WHEN {hit('date')} THEN 'date-year'
WHEN {hit('postal|zip|fsa')} THEN 'postal-fsa' END AS param_type FROM names""",
        "pol_risk_reduction": f"""WITH {CATALOG} SELECT *, greatest(0, risk - reduction) AS risk_after FROM (
SELECT column_name, {RISK} AS risk, {reduction('n', True, True, False, 5)} AS reduction FROM names)""",
        "pol_table_scores": f"""WITH {CATALOG}, scored AS (SELECT table_name, {RISK} AS risk, {reduction('n', True, True, True, 10)} AS gain
FROM (SELECT table_name, lower(column_name) AS n FROM catalog))
SELECT table_name, CAST(floor(sum(risk) * 1e0 / count(*) + 0.5e0) AS BIGINT) AS before,
CAST(floor(sum(greatest(0, risk - gain)) * 1e0 / count(*) + 0.5e0) AS BIGINT) AS after,
CAST(35 AS BIGINT) AS target FROM scored GROUP BY table_name""",
        "pol_target": """SELECT p_partkey, CAST(greatest(15, floor(55 - least(25, greatest(0, p_size - 5))
- least(20, greatest(0, 8 - (p_partkey % 21) / 2e0) * 2.5e0) + 0.5e0)) AS BIGINT) AS target FROM part""",
        "pol_compliance": f"WITH {CLIENTS}, {HELPED} {compliance(RAW_SCORES, HELPED_SCORES)}",
        "pol_data_dictionary": f"""WITH {CATALOG}, {CLASSIFIED} SELECT column_name, type, cat, pii, bucket, {ACTIONS} AS actions,
{DEFAULT_ACTION} AS action FROM classified""",
        "str_fixed_rules": clients + FIXED_ROWS,
        "str_mixed_dialects": """SELECT CAST(doc_id AS VARCHAR) AS id, lang, sha256(text) AS text, NULL AS source, NULL AS role FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, source, NULL FROM documents
UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, sha256(text), NULL, '' FROM conversations""",
        "str_count_over_restarts": "SELECT count(*) AS total, count(*) AS written, count(DISTINCT event_id) AS distinct FROM events",
        "str_row_count": "SELECT count(*) AS total FROM events",
        "job_anonymize": kept_rows(TREATED) + " SELECT * FROM kept",
        "job_anonymize_by_year_and_area": kept_rows(TREATED, keys=TREATED_KEYS[:2]) + " SELECT * FROM kept",
        "job_anonymize_in_order": f"""WITH {CLIENTS}, {TREATED.replace('SELECT sha256(id_client)', 'SELECT id_client AS came, sha256(id_client)', 1)},
{judged('treated', TREATED_KEYS)}, kept AS (SELECT treated.* FROM treated JOIN stats USING ({', '.join(TREATED_KEYS)})
WHERE n >= 10 AND l >= 3 AND tvd <= 0.3e0), firsts AS (SELECT *, min(came) OVER (PARTITION BY {', '.join(TREATED_KEYS)}) AS first FROM kept)
SELECT {', '.join(CLIENT_NAMES)}, row_number() OVER (ORDER BY first, came) AS place FROM firsts""",
        "job_anonymize_counts": f"""{kept_rows(TREATED)} SELECT (SELECT count(*) FROM kept) AS kept, count(*) AS total FROM treated""",
        "job_anonymize_metrics": f"{kept_rows(TREATED)}, {evaluated('kept', 'date_naissance, code_postal, revenu_annuel', 10)}",
        "job_auto_anonymize": kept_rows(AUTO_TREATED, "type_compte") + " SELECT * FROM kept",
        "job_profile_and_anonymize": f"""{kept_rows(AUTO_TREATED, 'type_compte')} SELECT *, (SELECT count(*) FROM kept) AS kept FROM ({_profile('clients', CLIENT_NAMES)})""",
        "job_fixed_file": clients + FIXED_ROWS,
        "job_fixed_file_multiline": f"""SELECT {hmac12('CAST(doc_id AS VARCHAR)')} AS id_client, text AS adresse,
{band('CAST(n_chars AS VARCHAR)')} AS revenu_annuel FROM documents""",
        "job_anonymize_generalized": published + " SELECT * FROM kept",
        "job_anonymize_generalized_audit": published + """, published_sizes AS (SELECT date_naissance, code_postal, revenu_annuel, count(*) AS n
FROM kept GROUP BY ALL) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) AS classes, min(n) AS smallest,
count(*) FILTER (n < 10) AS below_k, count(*) FILTER (n < 10) = 0 AS conforming FROM published_sizes""",
        "job_risk_preview": f"WITH {CLIENTS} {compliance(accounts, accounts)}",
    }
