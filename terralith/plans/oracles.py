"""SQL oracles for the registered queries, written for DuckDB over the given tables."""

from __future__ import annotations

from terralith import config, vocab
from terralith.sources import derived as d

AS_OF = d.AS_OF


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {source}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


# ------------------------------------------------------------------ shared inputs
_FACTORS = vocab.UNIT_HECTARES
_USED = {"acre": "acre", "hectare": "hectare", "decimal": "decimal", "bigha": "bigha", "guntha": "guntha",
         "kanal": "kanal", "Acres.": "acres", "sq m": "sq m", "katha": "katha", "marla": "marla"}


def _factor(unit: str) -> str:
    cases = " ".join(f"WHEN {_text(u)} THEN {_FACTORS[k]!r}::DOUBLE" for u, k in _USED.items())
    return f"CASE {unit} {cases} ELSE NULL END"


RECORDS = (
    "rec0 AS (" + _select(d.RECORD_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
    + f"), records AS (SELECT *, coalesce(round(area_value * ({_factor('area_unit')}) + 1e-9::DOUBLE, 6), 0) AS area_hectare, "
      "CASE WHEN khasra_no LIKE '%/%' THEN split_part(khasra_no, '/', 1) ELSE '' END AS parent_khasra_no, "
      "'Odisha' AS state, array_to_string(list_sort(string_split(lower(trim(owner_name)), ' ')), ' ') AS sorted FROM rec0)")
DOCS = "docs AS (" + _select({**d.DOCUMENT_COLUMNS, "file_hash": "sha256(text)"}, "documents") + ")"
BOXES = "boxes AS (" + _select(d.BOX_COLUMNS, "lineitem") + ")"
AUDIT = "audit AS (" + _select(d.AUDIT_COLUMNS, "events") + ")"
PLOTS0 = "plots0 AS (" + _select(d.PLOT_COLUMNS, "part") + ")"
_M = "111320.0::DOUBLE"
PLOTS = PLOTS0 + f""", plots1 AS (
  SELECT *, round(lon, 7) AS x1, round(lat, 7) AS y1,
    round(lon + area_ha * 10000 / sqrt(area_ha * 10000 / 1.25::DOUBLE) / ({_M} * cos(radians(lat))), 7) AS x2,
    round(lat + sqrt(area_ha * 10000 / 1.25::DOUBLE) / {_M}, 7) AS y2 FROM plots0
), plots AS (
  SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
    round((x2 - x1) * (y2 - y1) * {_M} * {_M} * cos(radians((y1 + y2) / 2)) / 10000 + 1e-9::DOUBLE, 6) AS polygon_area_ha FROM plots1
)"""
KEYS = """keys AS (
  SELECT key_type, key, min(ord) AS ord FROM (
    SELECT 'khasra_no' AS key_type, khasra_no AS key, ord FROM plots UNION ALL
    SELECT 'survey_no', survey_no, ord FROM plots UNION ALL SELECT 'plot_no', plot_no, ord FROM plots)
  WHERE key <> '' GROUP BY 1, 2)"""
LINKS = KEYS + """, links AS (
  SELECT r.*, CASE WHEN k1.ord IS NOT NULL THEN 'khasra_no' WHEN k2.ord IS NOT NULL THEN 'survey_no'
                   WHEN k3.ord IS NOT NULL THEN 'plot_no' ELSE 'none' END AS match_type,
    coalesce(p.plot_key, '') AS plot_key, coalesce(p.polygon_area_ha, 0) AS polygon_area_ha,
    CASE WHEN p.ord IS NOT NULL AND area_hectare > 0 THEN (p.polygon_area_ha - area_hectare) / area_hectare * 100 ELSE 0 END AS delta
  FROM records r LEFT JOIN keys k1 ON k1.key_type = 'khasra_no' AND k1.key = r.khasra_no
    LEFT JOIN keys k2 ON k2.key_type = 'survey_no' AND k2.key = r.survey_no
    LEFT JOIN keys k3 ON k3.key_type = 'plot_no' AND k3.key = r.plot_no
    LEFT JOIN plots p ON p.ord = coalesce(k1.ord, k2.ord, k3.ord))"""
SUBS = """subs AS (SELECT concat('LR-', cast(l_orderkey AS string)) AS record_id,
  round(sum(round(l_quantity * 0.00404686::DOUBLE + 1e-9::DOUBLE, 6)) + 1e-9::DOUBLE, 6) AS declared_sum, count(*) AS declared_count FROM lineitem GROUP BY 1)"""
LEDGER = "ledger AS (" + _select(d.LEDGER_COLUMNS, "customer") + ")"
DEEDS = ("deeds AS (SELECT deed_key, arg_min([party_1, party_2], ord) AS parties, arg_min(year, ord) AS year FROM ("
         + _select(d.DEED_COLUMNS, "orders WHERE o_orderkey % 2 = 1") + ") GROUP BY 1)")

_INDEX = {v: t for t, vs in vocab.TEHSIL_VILLAGES.items() for v in vs}
_INDEX.update({a: _INDEX[v] for a, v in vocab.VILLAGE_ALIASES.items()})
MASTER = (
    "master AS (SELECT * FROM " + _values([(v, t, i) for i, (v, t) in enumerate(_INDEX.items())]) + " AS m(known, m_tehsil, ord)), "
    "tal AS (SELECT * FROM " + _values(list(vocab.TEHSIL_ALIASES.items())) + " AS t(alias, latin)), "
    "looked AS (SELECT r.*, m.m_tehsil AS exact, pre.m_tehsil AS near, coalesce(tal.latin, r.tehsil) AS said FROM records r "
    "LEFT JOIN master m ON lower(m.known) = lower(trim(r.village)) "
    "LEFT JOIN (SELECT lower(substr(known, 1, 5)) AS p, arg_min(m_tehsil, ord) AS m_tehsil FROM master GROUP BY 1) pre "
    "ON pre.p = lower(substr(trim(r.village), 1, 5)) AND length(trim(r.village)) >= 4 "
    "LEFT JOIN tal ON tal.alias = trim(r.tehsil)), "
    "villages AS (SELECT *, CASE WHEN village = '' THEN 'missing' WHEN exact IS NULL AND near IS NOT NULL THEN 'partial' "
    "WHEN exact IS NULL THEN 'not_in_master' WHEN tehsil <> '' AND lower(trim(said)) <> lower(exact) THEN 'hierarchy_mismatch' "
    "ELSE 'ok' END AS v_status, coalesce(exact, near, '') AS expected_tehsil FROM looked)")

_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"
DATED = f"""dated AS (SELECT *, coalesce(
    CASE WHEN regexp_matches(mutation_date, '^\\d{{1,2}}([/-])\\d{{1,2}}[/-]\\d{{4}}$') THEN try_cast(concat(string_split_regex(mutation_date, '[/-]')[3], '-', lpad(string_split_regex(mutation_date, '[/-]')[2], 2, '0'), '-', lpad(string_split_regex(mutation_date, '[/-]')[1], 2, '0')) AS date) END,
    CASE WHEN regexp_matches(mutation_date, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2}}$') THEN try_cast(concat(CASE WHEN right(mutation_date, 2) >= '69' THEN '19' ELSE '20' END, right(mutation_date, 2), '-', lpad(string_split_regex(mutation_date, '[/-]')[2], 2, '0'), '-', lpad(string_split_regex(mutation_date, '[/-]')[1], 2, '0')) AS date) END,
    CASE WHEN regexp_matches(mutation_date, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN try_cast(mutation_date AS date) END,
    CASE WHEN regexp_matches(mutation_date, '^\\d{{1,2}} [A-Za-z]+ \\d{{4}}$') THEN try_cast(concat(split_part(mutation_date, ' ', 3), '-', lpad(cast(list_position({_MONTHS}, lower(substr(split_part(mutation_date, ' ', 2), 1, 3))) AS string), 2, '0'), '-', lpad(split_part(mutation_date, ' ', 1), 2, '0')) AS date) END
  ) AS day,
  CASE WHEN regexp_matches(registration_no, '(?i)\\bof\\s*\\d{{4}}\\b') THEN cast(regexp_extract(registration_no, '(?i)\\bof\\s*(\\d{{4}})\\b', 1) AS int)
       ELSE cast(list_last(regexp_extract_all(registration_no, '\\b(1[89]\\d{{2}}|20\\d{{2}}|21\\d{{2}})\\b', 1)) AS int) END AS reg_year
  FROM records)"""

# bit-parallel LCS over a CTE pairs(a, b): one step per character of b, all pairs at once
LCS = """lcs(a, b, j, v) AS (
  SELECT a, b, 0, (1::BIGINT << length(a)::INT) - 1 FROM pairs
  UNION ALL
  SELECT a, b, j + 1, ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(a)::INT) - 1) FROM (
    SELECT a, b, j, v, list_sum(list_transform(range(1, length(a) + 1), lambda i:
      CASE WHEN a[i] = b[j + 1] THEN 1::BIGINT << (i - 1)::INT ELSE 0 END))::BIGINT AS m FROM lcs WHERE j < length(b))
), scores AS (SELECT a, b, 2.0::DOUBLE * (length(a) - bit_count(v)) / (length(a) + length(b)) AS ratio FROM lcs WHERE j = length(b))"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "


# ------------------------------------------------------------------ findings of each rule as SQL
_TITLES = {f: t for f, t in vocab.FIELD_TITLES.items()}


def _missing(fields: list[str]) -> str:
    return "[" + ", ".join(f"CASE WHEN {'area_raw' if f == 'area' else f} = '' THEN '{_TITLES[f]}' END" for f in fields) + "]"


BR1 = f"""br1 AS (SELECT id, 'BR-1' AS rule_id,
  CASE WHEN list_contains(m, 'Owner name') OR list_contains(m, 'Khasra number') THEN 'critical' ELSE 'high' END AS severity,
  'all mandatory fields present' AS expected, array_to_string(m, ', ') AS actual,
  concat(cast(len(m) AS string), ' mandatory field(s) missing: ', array_to_string(m, ', ')) AS message, 1::BIGINT AS occurrences
  FROM (SELECT id, list_filter(CASE WHEN document_type_label = '{vocab.FORM_39A}' THEN {_missing(vocab.REQUIRED_39A)}
     ELSE {_missing(vocab.REQUIRED_GENERIC)} END, lambda x: x IS NOT NULL) AS m FROM records) WHERE len(m) > 0)"""
CHILDREN = """children AS (SELECT parent_khasra_no AS khasra_no, sum(area_hectare) AS child_sum, count(*) AS child_count
  FROM records WHERE parent_khasra_no <> '' AND status <> 'rejected' GROUP BY 1)"""
_OFF = "round(area_hectare, 6) > 0 AND abs({s} - round(area_hectare, 6)) > greatest(round(area_hectare, 6) * 0.02::DOUBLE, 0.0005::DOUBLE)"
BR2_CHILD = f"""br2c AS (SELECT id, 'BR-2' AS rule_id, 'high' AS severity, concat(printf('%.4f', area_hectare), ' ha') AS expected,
  concat(printf('%.4f', round(child_sum, 6)), ' ha') AS actual,
  printf('Digitised sub-plots of khasra %s sum to %.4f ha against a parent area of %.4f ha.', khasra_no, round(child_sum, 6), area_hectare) AS message,
  1::BIGINT AS occurrences FROM records JOIN children USING (khasra_no) WHERE {_OFF.format(s='round(child_sum, 6)')})"""
# same-plot names: every name of a key against every other name of the key (distinct names only)
PLOT_NAMES = """probe AS (SELECT id, sorted, CASE WHEN khasra_no <> '' THEN 'k' ELSE 's' END AS kind,
    CASE WHEN khasra_no <> '' THEN khasra_no ELSE survey_no END AS key FROM records WHERE khasra_no <> '' OR survey_no <> ''),
  pool AS (SELECT 'k' AS kind, khasra_no AS key, sorted FROM records WHERE khasra_no <> ''
    UNION ALL SELECT 's', survey_no, sorted FROM records WHERE survey_no <> ''),
  names AS (SELECT kind, key, sorted, count(*) AS n FROM pool GROUP BY ALL),
  pairs AS (SELECT DISTINCT x.sorted AS a, y.sorted AS b FROM names x JOIN names y USING (kind, key)
    WHERE x.sorted <> y.sorted AND x.sorted <> '' AND y.sorted <> '')"""
BR3 = """same AS (SELECT x.kind, x.key, x.sorted, x.n - 1 + coalesce(sum(y.n), 0) AS n FROM names x
    LEFT JOIN scores s ON s.a = x.sorted AND s.a <> s.b AND s.ratio >= 0.92 - 1e-9
    LEFT JOIN names y ON y.kind = x.kind AND y.key = x.key AND y.sorted = s.b WHERE x.sorted <> '' GROUP BY x.kind, x.key, x.sorted, x.n),
  totals AS (SELECT kind, key, sum(n) AS total FROM names GROUP BY ALL),
  dups AS (SELECT p.id, p.key, t.total - 1 AS total, coalesce(s.n, 0) AS same FROM probe p JOIN totals t USING (kind, key)
    LEFT JOIN same s USING (kind, key, sorted)),
  br3 AS (SELECT id, 'BR-3' AS rule_id, 'critical' AS severity, (total - same)::BIGINT AS occurrences, key AS identifier FROM dups WHERE total > same
    UNION ALL SELECT id, 'BR-3', 'medium', same::BIGINT, key FROM dups WHERE same > 0)"""
BR4 = f"""br4 AS (
  SELECT id, 'BR-4' AS rule_id, 'high' AS severity, 'a valid DD/MM/YYYY date' AS expected, mutation_date AS actual,
    concat('Mutation date ''', mutation_date, ''' is not a parseable date.') AS message, 1::BIGINT AS occurrences
    FROM dated WHERE mutation_date <> '' AND day IS NULL
  UNION ALL SELECT id, 'BR-4', 'high', 'on or before {AS_OF[:10]}', cast(day AS string), concat('Mutation date ', cast(day AS string), ' is in the future.'), 1
    FROM dated WHERE day > date '{AS_OF[:10]}'
  UNION ALL SELECT id, 'BR-4', 'high', concat('registration year <= ', cast(year(day) AS string)), cast(reg_year AS string),
    concat('Registration reference year ', cast(reg_year AS string), ' is later than the mutation year ', cast(year(day) AS string), '; mutation cannot precede its registration.'), 1
    FROM dated WHERE reg_year > year(day))"""
_UNIT = "regexp_extract(area_raw, '\\d+(?:\\.\\d+)?\\s*([A-Za-z]+)', 1)"
_RAW_FACTOR = f"CASE {_UNIT} " + " ".join(
    f"WHEN {_text(u.rstrip('.'))} THEN {_FACTORS[k]!r}::DOUBLE" for u, k in _USED.items() if " " not in u) + " ELSE NULL END"
BR6 = f"""units AS (SELECT id, area_raw, {_UNIT} AS unit, {_RAW_FACTOR} AS factor,
    round(try_cast(regexp_extract(area_raw, '\\d+(?:\\.\\d+)?') AS double) * ({_RAW_FACTOR}) + 1e-9::DOUBLE, 6) AS ha FROM records WHERE area_raw <> ''),
  br6 AS (SELECT id, 'BR-6' AS rule_id, 'medium' AS severity, 'a known unit (acre, hectare, decimal, bigha, katha, guntha, kanal...)' AS expected,
    unit AS actual, concat('Area unit ''', unit, ''' is not a known land measurement unit; area cannot be standardised.') AS message, 1::BIGINT AS occurrences
    FROM units WHERE unit <> '' AND factor IS NULL
  UNION ALL SELECT id, 'BR-6', 'medium', 'value with an explicit unit', area_raw, concat('Area ''', area_raw, ''' has no unit; standardised area cannot be computed.'), 1
    FROM units WHERE unit = ''
  UNION ALL SELECT id, 'BR-6', 'low', '< 50 ha for a typical plot', printf('%.4f ha', ha), printf('Standardised area %.4f ha is unusually large for a single plot.', ha), 1
    FROM units WHERE ha > 50)"""
BR7 = """br7 AS (SELECT id, 'BR-7' AS rule_id, 'medium' AS severity, expected_tehsil AS expected, tehsil AS actual,
    concat('Village ''', village, ''' belongs to tehsil ''', expected_tehsil, ''' in the administrative master, but the record states ''', tehsil, '''.') AS message, 1::BIGINT AS occurrences
    FROM villages WHERE v_status = 'hierarchy_mismatch'
  UNION ALL SELECT id, 'BR-7', 'medium', 'a village listed in the LGD master', village,
    concat('Village ''', village, ''' is not present in the Khordha administrative master.'), 1 FROM villages WHERE v_status = 'not_in_master'
  UNION ALL SELECT id, 'BR-7', 'low', 'Khordha', district, concat('District ''', district, ''' is outside the configured scope (Khordha).'), 1
    FROM records WHERE district NOT IN ('', 'Khordha', 'खुर्दा', 'ଖୋର୍ଦ୍ଧା'))"""
BR10 = """br10 AS (SELECT id, 'BR-10' AS rule_id, 'medium' AS severity, 'e.g. ''1234 of 2019'', ''BBSR-2311-2019'' or ''OR-1234567890''' AS expected,
    registration_no AS actual, concat('Registration reference ''', registration_no, ''' does not match the expected pattern (book no / year, SRO code-deed-year, or ROR reference like OR-1234567890).') AS message,
    1::BIGINT AS occurrences FROM records WHERE registration_no <> ''
    AND NOT regexp_full_match(registration_no, '(?i)(no\\.?\\s*)?\\d{1,5}\\s*(of\\s*)?\\d{4}(\\s*[-/]\\s*\\d{2,4})?')
    AND NOT regexp_full_match(upper(registration_no), '[A-Z]{2,5}[/-]\\d{2,5}[/-]\\d{4}')
    AND NOT regexp_full_match(upper(registration_no), '[A-Z]{2,5}[/-]\\d{6,12}'))"""
_BRIEF = "id, rule_id, severity, expected, actual, message, occurrences"
LOCAL_PARTS = [RECORDS, DATED, MASTER, BR1, BR4, BR6, BR7, BR10]
LOCAL = "local AS (" + " UNION ALL ".join(f"SELECT {_BRIEF} FROM {b}" for b in ("br1", "br4", "br6", "br7", "br10")) + ")"
_RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
_NAME = "CASE max(rank) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' ELSE '' END"
ROLL = f"roll AS (SELECT id, sum(occurrences)::BIGINT AS discrepancy_count, {_NAME} AS highest_severity FROM (SELECT *, {_RANK} AS rank FROM {{src}}) GROUP BY id)"


_SORTED = "array_to_string(list_sort(string_split(lower({c}), ' ')), ' ')"
MOVED = (f"moved AS (SELECT *, {_SORTED.format(c='new_owner')} AS ns, {_SORTED.format(c='previous_owner')} AS ps FROM records "
         "WHERE new_owner <> '' OR previous_owner <> '')")
MOVED_PAIRS = ("SELECT ns AS a, sorted AS b FROM moved WHERE ns <> '' AND sorted <> '' "
               "UNION SELECT ps, ns FROM moved WHERE ns <> '' AND ps <> ''")
BR5 = """br5 AS (
  SELECT id, 'BR-5' AS rule_id, 'high' AS severity, concat('new owner == record holder (''', owner_name, ''')') AS expected, new_owner AS actual, 1::BIGINT AS occurrences
    FROM moved JOIN scores ON a = ns AND b = sorted WHERE ratio < 0.85 - 1e-9
  UNION ALL SELECT id, 'BR-5', 'high', 'previous owner != new owner', previous_owner, 1 FROM moved JOIN scores ON a = ps AND b = ns WHERE ratio > 0.95 + 1e-9
  UNION ALL SELECT id, 'BR-5', 'medium', 'a prior record naming the previous owner for the same plot', 'no prior record found', 1 FROM moved m
    WHERE previous_owner <> '' AND khasra_no <> '' AND NOT EXISTS (SELECT 1 FROM records o WHERE o.khasra_no = m.khasra_no AND lower(o.owner_name) = lower(m.previous_owner) AND o.id <> m.id))"""
BR9 = """br9 AS (SELECT id, 'BR-9' AS rule_id, CASE WHEN abs(round(delta + 1e-5::DOUBLE, 2)) > 25 THEN 'high' ELSE 'medium' END AS severity,
  plot_key, round(delta + 1e-5::DOUBLE, 2) AS delta_pct, 1::BIGINT AS occurrences FROM links WHERE match_type <> 'none' AND abs(round(delta + 1e-5::DOUBLE, 2)) > 15)"""
BR2_DECLARED = f"br2d AS (SELECT id, 'BR-2' AS rule_id, 'high' AS severity, 1::BIGINT AS occurrences FROM records JOIN subs USING (record_id) WHERE {_OFF.format(s='declared_sum')})"
# owner variants: distinct names of a village, each against each; Levenshtein bounds (never above the Indel distance) leave few
# names, and few windows of the longer name, to the LCS
_LOW, _HIGH = f"{config.VARIANT_LOW!r}::DOUBLE", f"{config.VARIANT_HIGH!r}::DOUBLE"
_WINDOW = f"({config.VARIANT_LOW!r}::DOUBLE / {config.PARTIAL_WEIGHT!r}::DOUBLE)"
VARIANT_NAMES = f"""vnames AS (SELECT village, lower(trim(owner_name)) AS name, any_value(sorted) AS sorted, min(id) AS first_id,
    arg_min(record_id, id) AS first_record FROM records WHERE village <> '' AND trim(owner_name) <> '' GROUP BY 1, 2),
  vpairs AS (SELECT x.village, x.name AS a, y.name AS b, x.sorted AS sa, y.sorted AS sb FROM vnames x JOIN vnames y USING (village)
    WHERE x.name <> y.name AND x.sorted <> y.sorted AND length(x.name) <= length(y.name)),
  vwhole AS (SELECT DISTINCT sa AS a, sb AS b FROM vpairs
    WHERE levenshtein(sa, sb) <= (1 - {_LOW}) * (length(sa) + length(sb)) + 1e-9),
  vwindows AS (SELECT DISTINCT a, b, w FROM (SELECT a, b, unnest(list_concat(
      list_transform(range(1, length(b) - length(a) + 2), lambda i: substr(b, i, length(a))),
      list_concat(list_transform(range(1, length(a)), lambda i: substr(b, 1, i)),
                  list_transform(range(1, length(a)), lambda i: substr(b, length(b) - i + 1, i))))) AS w
    FROM (SELECT DISTINCT a, b FROM vpairs
      WHERE levenshtein(a, b) <= length(a) + length(b) - 2 * length(a) * {_WINDOW} / (2 - {_WINDOW}) + 1e-9))
    WHERE levenshtein(a, w) <= (1 - {_WINDOW}) * (length(a) + length(w)) + 1e-9)"""
VARIANT_PAIRS = "SELECT a, b FROM vwhole UNION SELECT a, w FROM vwindows"
BR8 = f"""vbest AS (SELECT a, b, max(ratio) AS ratio FROM (SELECT v.a, v.b, s.ratio FROM vwindows v JOIN scores s ON s.a = v.a AND s.b = v.w) GROUP BY 1, 2),
  vscored AS (SELECT village, least(p.a, p.b) AS a, greatest(p.a, p.b) AS b,
      max(greatest(coalesce(s.ratio, 0), {config.PARTIAL_WEIGHT!r}::DOUBLE * coalesce(t.ratio, 0))) AS score
    FROM vpairs p LEFT JOIN scores s ON s.a = p.sa AND s.b = p.sb LEFT JOIN vbest t ON t.a = p.a AND t.b = p.b GROUP BY 1, 2, 3),
  vnear AS (SELECT * FROM vscored WHERE score >= {_LOW} - 1e-9 AND score < {_HIGH} - 1e-9),
  vranked AS (SELECT e.village, e.a AS name, e.score, n.first_record, row_number() OVER (PARTITION BY e.village, e.a ORDER BY n.first_id) AS place
    FROM (SELECT village, a, b, score FROM vnear UNION ALL SELECT village, b, a, score FROM vnear) e
    JOIN vnames n ON n.village = e.village AND n.name = e.b WHERE length(e.a) >= 4),
  br8 AS (SELECT id, 'BR-8' AS rule_id, 'medium' AS severity, first_record AS other_record, round(score, 3) AS similarity, 1::BIGINT AS occurrences
    FROM records r JOIN vranked v ON v.village = r.village AND v.name = lower(trim(r.owner_name)) WHERE place <= 3)"""
#: All ten rules under one name.
EVERY_PARTS = [*LOCAL_PARTS, LOCAL, CHILDREN, BR2_CHILD, SUBS, BR2_DECLARED, PLOT_NAMES.replace("pairs AS", "plot_pairs AS"), MOVED, VARIANT_NAMES,
               f"pairs AS (SELECT a, b FROM plot_pairs UNION {MOVED_PAIRS} UNION {VARIANT_PAIRS})", LCS, BR3, BR5, BR8, PLOTS, LINKS, BR9,
               "every AS (" + " UNION ALL ".join(f"SELECT id, rule_id, severity, occurrences FROM {t}" for t in (
                   "local", "br2c", "br2d", "br3", "br5", "br8", "br9")) + ")"]


def _every(*extra: str, records: str = RECORDS) -> str:
    return _with(records, *EVERY_PARTS[1:], *extra, recursive=True)


def _fields() -> str:
    """Long field table: (id, record_id, field_name, value, confidence)."""
    parts = []
    for position, field in enumerate(vocab.LABELS):
        source = {"area": "area_raw", "boundaries": "address"}.get(field, field)
        parts.append(f"SELECT id, record_id, document_type_label, '{field}' AS field_name, {source} AS value, "
                     f"CASE WHEN {source} <> '' THEN (50 + (id * 7 + {position * 13}) % 50)::DOUBLE ELSE 0 END AS confidence FROM records")
    return "fields AS (" + " UNION ALL ".join(parts) + ")"


WORDS = """words AS (SELECT doc_id, u.seq - 1 AS seq, u.w AS text, (40 + (length(u.w) * 7 + u.seq - 1) % 60)::DOUBLE AS confidence
  FROM (SELECT doc_id, unnest(list_zip(string_split(text, ' '), range(1, len(string_split(text, ' ')) + 1))) AS z FROM documents),
  LATERAL (SELECT z[1] AS w, z[2] AS seq) u WHERE u.w <> '')"""
LINES = """lines AS (SELECT doc_id, z[2] - 1 AS line_no, trim(z[1], ' ') AS line FROM (SELECT doc_id, unnest(list_zip(
  string_split_regex(text, '\\r\\n|\\n|\\r'), range(1, len(string_split_regex(text, '\\r\\n|\\n|\\r')) + 1))) AS z FROM documents)
  WHERE trim(z[1], ' ') <> '')"""

ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------ queue and search
ORACLES["review_queue"] = _every(ROLL.format(src="every")) + """
SELECT record_id, khasra_no, village, coalesce(discrepancy_count, 0) AS discrepancy_count, coalesce(highest_severity, '') AS highest_severity,
  record_confidence, CASE highest_severity WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' ELSE 'normal' END AS priority
FROM records LEFT JOIN roll USING (id) WHERE status IN ('pending_review', 'escalated')
ORDER BY coalesce(discrepancy_count, 0) DESC, record_confidence, record_id LIMIT 200"""
ORACLES["record_search"] = _with(RECORDS) + """SELECT record_id, owner_name, village, created_at FROM records
WHERE lower(concat_ws(chr(1), owner_name, khasra_no, khata_no, survey_no, plot_no, village, tehsil, district, record_id)) LIKE '%sahoo%'
ORDER BY created_at DESC, record_id LIMIT 500"""
ORACLES["search_filters"] = _with(RECORDS) + """SELECT record_id, village, khata_no, record_confidence FROM records
WHERE status = 'pending_review' AND record_confidence < 70 AND village ILIKE '%mouza%' AND khata_no LIKE '%1%'"""
ORACLES["search_by_rule"] = _with(RECORDS, BR10) + """SELECT record_id, registration_no FROM records
WHERE id IN (SELECT id FROM br10) ORDER BY created_at DESC, record_id LIMIT 500"""
ORACLES["confidence_bands"] = _with(RECORDS, _fields()) + """SELECT field_name,
  CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 70 THEN 'medium' ELSE 'low' END AS band, count(*) AS n,
  count(*) FILTER (value <> '' AND confidence < 70) AS low_confidence FROM fields GROUP BY 1, 2"""
ORACLES["document_list"] = _with(DOCS) + "SELECT doc_id, batch_id, created_at FROM docs WHERE status = 'completed' ORDER BY created_at DESC, doc_id LIMIT 200"
ORACLES["audit_trail"] = _with(AUDIT) + "SELECT id, actor_label, created_at FROM audit WHERE action = 'error' AND actor_label ILIKE '%user1%' ORDER BY created_at DESC, id DESC LIMIT 1000"
ORACLES["batch_listing"] = _with(DOCS) + "SELECT batch_id, count(*) AS file_count, array_to_string(list_sort(list_distinct(list(status))), ',') AS statuses FROM docs GROUP BY 1"

# ------------------------------------------------------------------ documents
ORACLES["file_dedup"] = _with(DOCS, """live AS (SELECT file_hash, min(doc_id) AS live_doc FROM docs WHERE doc_id % 2 = 0 AND status <> 'failed' AND record_status <> 'rejected' GROUP BY 1)""",
    "ranked AS (SELECT d.doc_id, live_doc, row_number() OVER (PARTITION BY d.file_hash ORDER BY d.doc_id) AS rn, min(d.doc_id) OVER (PARTITION BY d.file_hash) AS first_doc FROM docs d LEFT JOIN live USING (file_hash))") + """
SELECT doc_id, CASE WHEN rn = 1 AND live_doc IS NULL THEN 'accepted' ELSE 'skipped' END AS outcome,
  CASE WHEN rn = 1 AND live_doc IS NULL THEN NULL ELSE coalesce(live_doc, first_doc) END AS existing_doc_id FROM ranked"""
ORACLES["page_lines"] = _with(LINES) + "SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars, max(line_no)::BIGINT AS last_line FROM lines GROUP BY 1"
ORACLES["script_tags"] = _with(WORDS) + """SELECT CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'Devanagari' WHEN regexp_matches(text, '[଀-୿]') THEN 'Odia'
  WHEN regexp_matches(text, '[ঀ-৿]') THEN 'Bengali' ELSE 'Latin' END AS script, count(*) AS words, count(DISTINCT doc_id) AS documents FROM words GROUP BY 1"""
ORACLES["word_stats"] = _with(WORDS) + """SELECT doc_id, count(*) AS word_count, round(avg(confidence), 4) AS mean_confidence, min(confidence) AS min_confidence,
  count(*) FILTER (confidence < 70) AS low_confidence_words FROM words GROUP BY 1"""
ORACLES["union_box"] = _with(WORDS) + """SELECT doc_id, min(bx)::INT AS x, min(ry)::INT AS y, (max(bx + bw) - min(bx))::INT AS w, (max(ry + 16) - min(ry))::INT AS h
  FROM (SELECT doc_id, seq % 50 * 12 AS bx, (seq // 50) * 20 AS ry, length(text) * 8 AS bw FROM words) GROUP BY 1"""


_CLASS_CASES = " ".join(
    "WHEN " + " OR ".join([f"contains(head, {_text(w)})" for w in heads] + [f"contains(body, {_text(w)})" for w in bodies]
                          + [f"(contains(head, {_text(h)}) AND contains(body, {_text(b)}))" for h, b in both])
    + f" THEN '{label}|{score}'" for label, score, heads, bodies, both in vocab.DOCUMENT_CLASSES)
ORACLES["classify_docs"] = _with(LINES, "texts AS (SELECT doc_id, lower(string_agg(line, ' ' ORDER BY line_no)) AS body, lower(string_agg(line, ' ' ORDER BY line_no) FILTER (rn <= 4)) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM lines) GROUP BY 1)",
    f"classed AS (SELECT CASE {_CLASS_CASES} ELSE '{vocab.UNCLASSIFIED[0]}|{vocab.UNCLASSIFIED[1]}' END AS c FROM texts)") + \
    "SELECT split_part(c, '|', 1) AS document_type_label, cast(split_part(c, '|', 2) AS double) AS score, count(*) AS documents FROM classed GROUP BY 1, 2"
ORACLES["second_pass_lines"] = _with(LINES, "low AS (SELECT doc_id, line_no, lower(line) AS line FROM lines)",
    "kept AS (SELECT doc_id, line FROM lines UNION ALL SELECT l.doc_id, l.line FROM low l WHERE NOT EXISTS (SELECT 1 FROM lines x WHERE x.doc_id = l.doc_id AND x.line = l.line))") + \
    "SELECT doc_id, count(*)::BIGINT AS lines, (sum(length(line)) + count(*) - 1)::BIGINT AS chars FROM kept GROUP BY 1"
ORACLES["best_reading"] = _with(WORDS, "readings AS (SELECT doc_id, (seq % 3)::INT AS candidate, round(avg(confidence), 6) AS m FROM words GROUP BY 1, 2)") + \
    "SELECT doc_id, candidate, m AS mean_confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, candidate) AS rn FROM readings) WHERE rn = 1"
ORACLES["layout_counts"] = _with(BOXES) + "SELECT doc_id, page, " + ", ".join(
    f"count(*) FILTER (label = '{x}') AS \"{x}\"" for x in ("table", "printed_text", "handwritten_text", "stamp", "map")) + " FROM boxes GROUP BY 1, 2"
ORACLES["box_containment"] = _with(BOXES) + """SELECT label, count(*) AS n FROM boxes t WHERE NOT (label IN ('printed_text', 'handwritten_text') AND EXISTS (
  SELECT 1 FROM boxes b WHERE b.label = 'table' AND b.doc_id = t.doc_id AND b.page = t.page AND
  greatest(0, least(b.x + b.w, t.x + t.w) - greatest(b.x, t.x)) * greatest(0, least(b.y + b.h, t.y + t.h) - greatest(b.y, t.y)) >= 0.75 * t.w * t.h)) GROUP BY 1"""

# ------------------------------------------------------------------ rules
ORACLES["br1_mandatory"] = _with(RECORDS, BR1) + f"SELECT {_BRIEF} FROM br1"
ORACLES["br2_sub_plots"] = _with(RECORDS, CHILDREN, SUBS) + f"""
SELECT id, 'BR-2' AS rule_id, 'high' AS severity, area_hectare AS parent_area_ha, round(abs(round(child_sum, 6) - area_hectare) + 1e-7::DOUBLE, 4) AS difference_ha, child_count AS children
  FROM records JOIN children USING (khasra_no) WHERE {_OFF.format(s='round(child_sum, 6)')}
UNION ALL SELECT id, 'BR-2', 'high', area_hectare, round(abs(declared_sum - area_hectare) + 1e-7::DOUBLE, 4), declared_count FROM records JOIN subs USING (record_id) WHERE {_OFF.format(s='declared_sum')}"""
ORACLES["br3_duplicates"] = _with(RECORDS, PLOT_NAMES, LCS, BR3, recursive=True) + "SELECT id, rule_id, severity, occurrences, identifier FROM br3"
ORACLES["br4_chronology"] = _with(RECORDS, DATED, BR4) + f"SELECT {_BRIEF} FROM br4"
ORACLES["br5_chain"] = _with(RECORDS, MOVED, f"pairs AS ({MOVED_PAIRS})", LCS, BR5, recursive=True) + "SELECT * FROM br5"
ORACLES["br6_units"] = _with(RECORDS, BR6) + f"SELECT {_BRIEF} FROM br6"
ORACLES["br7_admin"] = _with(RECORDS, MASTER, BR7) + f"SELECT {_BRIEF} FROM br7"
ORACLES["br8_variants"] = _with(RECORDS, VARIANT_NAMES, f"pairs AS ({VARIANT_PAIRS})", LCS, BR8, recursive=True) + \
    "SELECT id, rule_id, severity, other_record, similarity FROM br8"
ORACLES["br9_boundary"] = _with(RECORDS, PLOTS, LINKS, BR9) + "SELECT id, rule_id, severity, plot_key, delta_pct FROM br9"
ORACLES["br10_registration"] = _with(RECORDS, BR10) + f"SELECT {_BRIEF} FROM br10"
ORACLES["rule_matrix"] = _every("ids AS (SELECT * FROM " + _values([(r,) for r in vocab.RULE_NAMES]) + " AS t(rule_id))",
    "per AS (SELECT r.id, i.rule_id, coalesce(sum(l.occurrences), 0) AS n FROM records r CROSS JOIN ids i LEFT JOIN every l ON l.id = r.id AND l.rule_id = i.rule_id GROUP BY 1, 2)") + \
    "SELECT rule_id, n = 0 AS passed, count(*) AS records, sum(n)::BIGINT AS findings FROM per GROUP BY 1, 2"
#: Records whose area is no number have none that SQL sums could take in.
_FAULTY = RECORDS.replace("records AS (", "before AS (") + ", records AS (SELECT * REPLACE (CASE WHEN id % 101 = 0 THEN NULL ELSE area_hectare END AS area_hectare) FROM before)"
ORACLES["rule_outcomes"] = _every("ids AS (SELECT * FROM " + _values([(r,) for r in vocab.RULE_NAMES]) + " AS t(rule_id))",
    """per AS (SELECT r.id, i.rule_id, coalesce(sum(l.occurrences), 0) AS n,
      CASE WHEN r.id % 101 = 0 AND i.rule_id IN ('BR-2', 'BR-9') THEN 'rule error: the area is not a finite number: NaN' ELSE '' END AS detail
    FROM records r CROSS JOIN ids i LEFT JOIN every l ON l.id = r.id AND l.rule_id = i.rule_id GROUP BY ALL)""", records=_FAULTY) + \
    "SELECT rule_id, n = 0 AND detail = '' AS passed, detail, count(*) AS records, sum(n)::BIGINT AS findings FROM per GROUP BY 1, 2, 3"
ORACLES["finding_rollup"] = _every(ROLL.format(src="every")) + "SELECT id, record_id, discrepancy_count, highest_severity FROM roll JOIN records USING (id)"
ORACLES["duplicate_scan"] = _with(
    RECORDS, "knames AS (SELECT khasra_no AS k, sorted, count(*) AS n FROM records WHERE khasra_no <> '' GROUP BY ALL)",
    "vnames AS (SELECT village AS k, sorted, count(*) AS n FROM records WHERE village <> '' AND sorted <> '' GROUP BY ALL)",
    """pairs AS (SELECT x.sorted AS a, y.sorted AS b FROM knames x JOIN knames y USING (k) WHERE x.sorted <> y.sorted AND x.sorted <> '' AND y.sorted <> ''
    UNION SELECT x.sorted, y.sorted FROM vnames x JOIN vnames y USING (k) WHERE x.sorted <> y.sorted
      AND abs(length(x.sorted) - length(y.sorted)) <= 0.2 * (length(x.sorted) + length(y.sorted)) + 1e-9
      AND levenshtein(x.sorted, y.sorted) <= 0.2 * (length(x.sorted) + length(y.sorted)) + 1e-9)""", LCS,
    "ksame AS (SELECT x.k, x.sorted, x.n - 1 + coalesce(sum(y.n), 0) AS n FROM knames x LEFT JOIN scores s ON s.a = x.sorted AND s.ratio >= 0.92 - 1e-9 LEFT JOIN knames y ON y.k = x.k AND y.sorted = s.b WHERE x.sorted <> '' GROUP BY x.k, x.sorted, x.n)",
    "ktot AS (SELECT k, sum(n) AS total FROM knames GROUP BY 1)",
    "near AS (SELECT x.k, x.sorted, sum(y.n) AS n FROM vnames x JOIN scores s ON s.a = x.sorted AND s.ratio >= 0.8 - 1e-9 AND s.ratio < 0.98 - 1e-9 JOIN vnames y ON y.k = x.k AND y.sorted = s.b GROUP BY ALL)",
    recursive=True) + """
SELECT id, 'duplicate_khasra' AS type, 'critical' AS severity, (total - 1 - coalesce(s.n, 0))::BIGINT AS n FROM records r JOIN ktot t ON t.k = r.khasra_no LEFT JOIN ksame s ON s.k = r.khasra_no AND s.sorted = r.sorted WHERE total - 1 - coalesce(s.n, 0) > 0
UNION ALL SELECT id, 'repeat_digitisation', 'medium', s.n::BIGINT FROM records r JOIN ksame s ON s.k = r.khasra_no AND s.sorted = r.sorted WHERE s.n > 0
UNION ALL SELECT id, 'duplicate_survey', 'high', total - 1 FROM records JOIN (SELECT survey_no, count(*) AS total FROM records WHERE survey_no <> '' GROUP BY 1) USING (survey_no) WHERE total > 1
UNION ALL SELECT id, 'owner_name_variant', 'medium', near.n::BIGINT FROM records r JOIN near ON near.k = r.village AND near.sorted = r.sorted"""
ORACLES["mutation_chain"] = _with(RECORDS, DATED,
    "moves AS (SELECT *, lag(new_owner) OVER (PARTITION BY khasra_no ORDER BY day, id) AS p FROM dated WHERE khasra_no <> '' AND day IS NOT NULL AND (previous_owner <> '' OR new_owner <> ''))") + """
SELECT record_id, khasra_no, day, previous_owner, new_owner, p AS prior_new_owner,
  CASE WHEN p IS NULL THEN 'first' WHEN lower(p) = lower(previous_owner) THEN 'continuous' ELSE 'broken' END AS link FROM moves"""
ORACLES["chain_gap"] = _with(RECORDS) + """SELECT record_id, khasra_no, previous_owner FROM records m WHERE previous_owner <> '' AND khasra_no <> ''
  AND NOT EXISTS (SELECT 1 FROM records o WHERE o.khasra_no = m.khasra_no AND lower(o.owner_name) = lower(m.previous_owner) AND o.id <> m.id)"""
ORACLES["sub_plot_sum"] = _with(SUBS) + "SELECT record_id, declared_sum, declared_count FROM subs"
ORACLES["child_sum"] = _with(RECORDS, CHILDREN) + "SELECT khasra_no, round(child_sum + 1e-7::DOUBLE, 4) AS child_sum, child_count FROM children"
ORACLES["parent_area"] = _with(RECORDS) + """SELECT c.parent_khasra_no, c.record_id, c.area_hectare, p.area AS parent_area_hectare FROM records c
  LEFT JOIN (SELECT khasra_no, arg_min(area_hectare, id) AS area FROM records WHERE khasra_no <> '' GROUP BY 1) p ON p.khasra_no = c.parent_khasra_no WHERE c.parent_khasra_no <> ''"""

# ------------------------------------------------------------------ parcels
ORACLES["parcel_link"] = _with(RECORDS, PLOTS, LINKS) + "SELECT record_id, match_type, plot_key, round(delta + 1e-5::DOUBLE, 2) AS area_delta_pct, abs(delta) > 15 AS spatial_mismatch FROM links"
ORACLES["parcel_area"] = _with(PLOTS) + "SELECT plot_key, round(polygon_area_ha + 1e-7::DOUBLE, 4) AS polygon_area_ha, round(cx + 1e-8::DOUBLE, 5) AS lon, round(cy + 1e-8::DOUBLE, 5) AS lat FROM plots"
ORACLES["parcel_neighbours"] = _with(PLOTS, f"""near AS (SELECT a.plot_key, b.plot_key AS neighbour,
  sqrt(power((b.cx - a.cx) * {_M} * cos(radians(a.cy)), 2) + power((b.cy - a.cy) * {_M}, 2)) AS dist
  FROM plots a JOIN plots b ON a.plot_key <> b.plot_key AND abs(a.cy - b.cy) < 0.004 AND abs(a.cx - b.cx) < 0.005)""") + \
    "SELECT plot_key, neighbour, round(dist, 1) AS distance_m FROM near WHERE dist <= 400"
ORACLES["map_summary"] = _with(RECORDS, PLOTS, LINKS) + """SELECT 'feature_count' AS metric, count(*) AS value FROM plots UNION ALL SELECT 'villages', count(DISTINCT village) FROM plots
UNION ALL SELECT 'indexed_keys', count(*) FROM keys UNION ALL SELECT 'records', count(*) FROM links UNION ALL SELECT 'linked_records', count(*) FROM links WHERE match_type <> 'none'"""

# ------------------------------------------------------------------ external registers
_LEDGER_CHECK = """lc AS (SELECT r.record_id, 'bhulekh' AS source_system, CASE WHEN l.khasra_no IS NULL THEN 'not_found'
    WHEN (r.owner_name <> '' AND lower(l.owner) <> lower(r.owner_name)) OR (r.khata_no <> '' AND l.khata <> r.khata_no)
      OR (r.area_hectare <> 0 AND abs(l.area_ha - r.area_hectare) > greatest(r.area_hectare * 0.05::DOUBLE, 0.005::DOUBLE)) THEN 'mismatch' ELSE 'matched' END AS match_status,
    concat('bhulekh://ror/', CASE WHEN r.khasra_no = '' THEN 'unknown' ELSE r.khasra_no END) AS external_reference FROM records r LEFT JOIN ledger l USING (khasra_no))"""
_MAP_CHECK = """mc AS (SELECT r.record_id, 'bhunaksha' AS source_system, CASE WHEN p.ord IS NULL THEN 'not_found' ELSE 'matched' END AS match_status,
    concat('bhunaksha://plot/', coalesce(p.plot_key, CASE WHEN r.khasra_no = '' THEN 'unknown' ELSE r.khasra_no END)) AS external_reference,
    CASE WHEN p.ord IS NULL THEN 'No cadastral polygon is available for this plot.' ELSE concat('Cadastral polygon available (matched on khasra_no); village ', p.village, ', tehsil ', p.tehsil, '.') END AS detail
    FROM records r LEFT JOIN (SELECT key, ord FROM keys WHERE key_type = 'khasra_no') k ON k.key = r.khasra_no LEFT JOIN plots p ON p.ord = k.ord)"""
_DEED_CHECK = """deed0 AS (SELECT *, replace(replace(replace(replace(upper(registration_no), 'NO.', ''), 'OF', '/'), ' ', ''), '//', '/') AS dk FROM records),
  dc AS (SELECT r.record_id, 'igr' AS source_system, CASE WHEN e.deed_key IS NULL THEN 'not_found'
    WHEN len(list_filter([previous_owner, new_owner, owner_name], lambda p: p <> '' AND len(list_filter(e.parties, lambda q: contains(lower(q), lower(p)))) = 0)) > 0 THEN 'mismatch' ELSE 'matched' END AS match_status,
    concat('igr://deed/', CASE WHEN e.deed_key IS NOT NULL THEN dk WHEN registration_no = '' THEN 'unknown' ELSE registration_no END) AS external_reference
    FROM deed0 r LEFT JOIN deeds e ON e.deed_key = r.dk)"""
_ADMIN_CHECK = """ac AS (SELECT record_id, 'lgd' AS source_system, CASE v_status WHEN 'ok' THEN 'matched' WHEN 'hierarchy_mismatch' THEN 'mismatch' ELSE 'not_found' END AS match_status,
    concat('lgd://village/', CASE WHEN village = '' THEN 'unknown' ELSE village END) AS external_reference,
    CASE WHEN v_status = 'ok' THEN concat('Village ''', village, ''' resolves to tehsil ''', expected_tehsil, ''' in the Khordha master.')
      ELSE concat('Master-data check failed for village ''', CASE WHEN village = '' THEN '(blank)' ELSE village END, ''' (status ', v_status, ').') END AS detail FROM villages)"""
_SEV = "CASE WHEN match_status = 'matched' THEN 'low' WHEN match_status = 'mismatch' AND source_system <> 'lgd' THEN 'high' ELSE 'medium' END AS severity"
_ALL_CHECKS = [RECORDS, PLOTS, KEYS, LEDGER, DEEDS, MASTER, _LEDGER_CHECK, _MAP_CHECK, _DEED_CHECK, _ADMIN_CHECK,
               f"every AS (SELECT *, {_SEV} FROM (" + " UNION ALL ".join(f"SELECT record_id, source_system, match_status FROM {t}" for t in ("lc", "mc", "dc", "ac"))
               + " UNION ALL SELECT record_id, 'lrms', 'matched' FROM records))"]
ORACLES["ledger_check"] = _with(RECORDS, LEDGER, _LEDGER_CHECK) + f"SELECT *, {_SEV} FROM lc"
ORACLES["map_check"] = _with(RECORDS, PLOTS, KEYS, _MAP_CHECK) + f"SELECT *, {_SEV} FROM mc"
ORACLES["deed_check"] = _with(RECORDS, DEEDS, _DEED_CHECK) + f"SELECT *, {_SEV} FROM dc"
ORACLES["admin_check"] = _with(RECORDS, MASTER, _ADMIN_CHECK) + f"SELECT *, {_SEV} FROM ac"
ORACLES["cross_checks"] = _with(*_ALL_CHECKS) + "SELECT source_system, match_status, severity, count(*) AS n FROM every GROUP BY ALL"
ORACLES["cross_status"] = _with(*_ALL_CHECKS) + """SELECT record_id, CASE WHEN n = 0 THEN 'all_matched' ELSE concat(cast(n AS string), '_mismatch') END AS cross_db_status
FROM (SELECT record_id, count(*) FILTER (match_status <> 'matched') AS n FROM every GROUP BY 1)"""

# ------------------------------------------------------------------ metrics
ORACLES["rule_severity"] = _every() + "SELECT rule_id, severity, sum(occurrences)::BIGINT AS n FROM every GROUP BY 1, 2"
ORACLES["all_rules"] = ORACLES["rule_severity"]
ORACLES["district_rollup"] = _with(RECORDS, "named AS (SELECT state, CASE WHEN district = '' THEN '(unmapped)' ELSE district END AS district, CASE WHEN tehsil = '' THEN '(unmapped)' ELSE tehsil END AS tehsil FROM records)") + \
    "SELECT state, district, tehsil, count(*) AS records, grouping(state, district, tehsil)::BIGINT AS level FROM named GROUP BY ROLLUP (state, district, tehsil)"
ORACLES["tehsil_counts"] = _with(RECORDS) + "SELECT CASE WHEN tehsil = '' THEN '(unmapped)' ELSE tehsil END AS tehsil, count(*) AS records FROM records GROUP BY 1"
ORACLES["record_status_counts"] = _with(RECORDS) + "SELECT status, count(*) AS n FROM records GROUP BY 1"
ORACLES["workload"] = _with(RECORDS) + "SELECT assigned_to_id AS user_id, count(*) AS pending FROM records WHERE status = 'pending_review' GROUP BY 1"
ORACLES["daily_throughput"] = _with(DOCS) + "SELECT cast(created_at AS date) AS day, count(*) AS documents FROM docs WHERE created_at >= timestamp '2024-01-24 00:00:00' GROUP BY 1"
ORACLES["pending_alerts"] = _with(RECORDS) + f"""SELECT record_id, village, khasra_no, round((epoch_us(timestamp '{AS_OF}') - epoch_us(created_at)) / 3.6e9::DOUBLE, 1) AS hours_pending
FROM records WHERE status = 'pending_review' AND created_at <= timestamp '{AS_OF}' - interval 48 hour"""
ORACLES["headline"] = "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'records', count(*) FROM orders UNION ALL SELECT 'audit', count(*) FROM events"

# ------------------------------------------------------------------ audit
_PAYLOAD = "concat_ws('|', log_id, user_id, actor_label, action, entity_type, entity_id, field_name, old_value, new_value, '0.0000', detail, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'))"
_CHAIN = f"""ranked AS (SELECT *, id // 100 AS segment, row_number() OVER (PARTITION BY id // 100 ORDER BY id) AS pos, {_PAYLOAD} AS payload FROM audit),
  chain(id, segment, pos, prev_hash, entry_hash) AS (
    SELECT id, segment, pos, repeat('0', 64), sha256(concat(payload, '|', repeat('0', 64))) FROM ranked WHERE pos = 1
    UNION ALL SELECT r.id, r.segment, r.pos, c.entry_hash, sha256(concat(r.payload, '|', c.entry_hash)) FROM chain c JOIN ranked r ON r.segment = c.segment AND r.pos = c.pos + 1),
  heads AS (SELECT segment, count(*) AS entries, max(id) AS last_id, arg_max(entry_hash, id) AS head_hash FROM chain GROUP BY 1),
  placed AS (SELECT *, concat_ws('|', segment, entries, last_id, head_hash) AS payload, row_number() OVER (ORDER BY segment) AS pos FROM heads),
  sealed(segment, pos, prev_hash, entry_hash) AS (
    SELECT segment, pos, repeat('0', 64), sha256(concat(payload, '|', repeat('0', 64))) FROM placed WHERE pos = 1
    UNION ALL SELECT p.segment, p.pos, s.entry_hash, sha256(concat(p.payload, '|', s.entry_hash)) FROM sealed s JOIN placed p ON p.pos = s.pos + 1)"""
_STORED_LOG = "log AS (SELECT r.* EXCLUDE (segment, pos, payload), prev_hash, entry_hash FROM ranked r JOIN chain USING (id))"
#: A log and what is wrong with it, worked out again from its columns; the heads are those of the log as it was written.
_REPORT = f"""checked AS (SELECT *, id // 100 AS segment, sha256(concat({_PAYLOAD}, '|', prev_hash)) = entry_hash AS hash_ok,
    prev_hash = coalesce(lag(entry_hash) OVER (PARTITION BY id // 100 ORDER BY id), repeat('0', 64)) AS link_ok FROM {{log}}),
  there AS (SELECT segment, count(*) AS found, max(id) AS last_found, arg_max(entry_hash, id) AS hash_found,
    min(id) FILTER (NOT link_ok OR NOT hash_ok) AS first_broken, count(*) FILTER (NOT link_ok) AS links_broken,
    count(*) FILTER (NOT hash_ok) AS hashes_broken FROM checked GROUP BY 1),
  kept AS (SELECT h.*, s.prev_hash = coalesce(lag(s.entry_hash) OVER (ORDER BY segment), repeat('0', 64))
    AND s.entry_hash = sha256(concat_ws('|', segment, entries, last_id, head_hash, s.prev_hash)) AS link_ok FROM heads h JOIN sealed s USING (segment)),
  report AS (SELECT segment, entries AS sealed, found, first_broken, coalesce(links_broken, 0) AS links_broken, coalesce(hashes_broken, 0) AS hashes_broken,
    entries = coalesce(found, 0) AND coalesce(last_id = last_found, false) AND coalesce(head_hash = hash_found, false) AS head_ok, link_ok
    FROM kept FULL JOIN there USING (segment)),
  bad AS (SELECT * FROM report WHERE first_broken IS NOT NULL OR NOT head_ok OR NOT link_ok)"""
_DAMAGED = """damaged AS (SELECT * REPLACE (
    CASE WHEN id // 100 % 7 = 1 AND id % 100 = 20 THEN id + 1 WHEN id // 100 % 7 = 1 AND id % 100 = 21 THEN id - 1 ELSE id END AS id,
    CASE WHEN id // 100 % 7 = 2 AND id % 100 = 30 THEN 'changed' ELSE new_value END AS new_value)
  FROM log WHERE id // 100 % 7 <> 3 AND NOT (id // 100 % 7 = 5 AND id % 100 >= 90))"""
_VERDICT = """SELECT (SELECT sum(found) FROM report)::BIGINT AS entries_checked, (SELECT count(*) FROM bad) = 0 AS chain_intact,
  (SELECT min(first_broken) FROM report) AS broken_at, (SELECT arg_max(entry_hash, segment) FROM sealed) AS head_hash,
  (SELECT count(*) FROM report) AS segments_checked, (SELECT min(segment) FROM bad) AS broken_segment,
  (SELECT sum(greatest(sealed - coalesce(found, 0), 0)) FROM report)::BIGINT AS entries_missing"""
ORACLES["audit_verify"] = _with(AUDIT, _CHAIN, _STORED_LOG, _REPORT.format(log="log"), recursive=True) + _VERDICT
ORACLES["audit_damage"] = _with(AUDIT, _CHAIN, _STORED_LOG, _DAMAGED, _REPORT.format(log="damaged"), recursive=True) + _VERDICT
ORACLES["audit_deleted"] = _with(AUDIT, _CHAIN, _STORED_LOG, _DAMAGED, _REPORT.format(log="damaged"), recursive=True) + "SELECT * FROM bad"
ORACLES["audit_tampered"] = _with(AUDIT, _CHAIN, _STORED_LOG, """altered AS (SELECT * REPLACE (CASE WHEN id % 97 = 0 THEN 'changed' ELSE new_value END AS new_value) FROM log)""",
    _REPORT.format(log="altered"), recursive=True) + "SELECT id, link_ok, hash_ok FROM checked WHERE NOT link_ok OR NOT hash_ok"
ORACLES["audit_heads"] = _with(AUDIT, _CHAIN, recursive=True) + "SELECT h.*, prev_hash, entry_hash FROM heads h JOIN sealed USING (segment)"
ORACLES["audit_stats"] = _with(AUDIT) + """SELECT 'total' AS kind, 'total_events' AS name, count(*) AS n FROM audit UNION ALL SELECT 'total', 'corrections_logged', count(*) FROM audit WHERE action = 'field_corrected'
UNION ALL SELECT 'action', action, count(*) FROM audit GROUP BY action
UNION ALL SELECT 'actor', actor_label, n FROM (SELECT actor_label, count(*) AS n FROM audit GROUP BY 1 ORDER BY n DESC, actor_label LIMIT 12)"""

# ------------------------------------------------------------------ changes
_CHANGED = """hit AS (SELECT *, id % 3 = 0 AND village <> 'Balarampur' AS v_new, id % 5 = 0 AS a_new FROM records),
  score AS (SELECT record_id, round(avg(CASE WHEN (f.field_name = 'village' AND v_new) OR (f.field_name = 'area' AND a_new) THEN greatest(confidence, 95) ELSE confidence END), 2) AS s
    FROM fields f JOIN hit USING (record_id) WHERE value <> '' OR (f.field_name = 'area' AND a_new) GROUP BY 1)"""
ORACLES["apply_corrections"] = _with(RECORDS, _fields(), _CHANGED) + """SELECT record_id, CASE WHEN v_new THEN 'Balarampur' ELSE village END AS village,
  round(CASE WHEN a_new THEN 1.5 ELSE area_value END, 2) AS area_value, CASE WHEN a_new THEN 'acre' ELSE area_unit END AS area_unit,
  CASE WHEN a_new THEN round(1.5::DOUBLE * 0.404686::DOUBLE + 1e-9::DOUBLE, 6) ELSE area_hectare END AS area_hectare, s AS record_confidence
  FROM hit JOIN score USING (record_id) WHERE v_new OR a_new"""
ORACLES["correction_pairs"] = _with(RECORDS, _fields(), _CHANGED) + """SELECT record_id, 'village' AS field_name, 'Balarampur' AS corrected_value, f.confidence AS ai_confidence
  FROM hit JOIN fields f USING (record_id) WHERE v_new AND f.field_name = 'village' UNION ALL SELECT record_id, 'area', '1.5 acre', 0.0::DOUBLE FROM hit WHERE a_new"""
ORACLES["corrections_per_field"] = _with(RECORDS, _fields(), _CHANGED) + "SELECT 'village' AS field_name, count(*) AS n FROM hit WHERE v_new UNION ALL SELECT 'area', count(*) FROM hit WHERE a_new"
ORACLES["rejected_corrections"] = "SELECT 'status' AS field_name, 'non-correctable field' AS reason, count(*) AS n FROM orders WHERE o_orderkey % 11 = 0"
#: The records after the corrections, under the name that the rules read.
_CORRECTED = RECORDS.replace("records AS (", "before AS (") + """, records AS (SELECT * REPLACE (
    CASE WHEN id % 3 = 0 THEN 'Balarampur' ELSE village END AS village,
    CASE WHEN id % 5 = 0 THEN '1.5 acre' ELSE area_raw END AS area_raw, CASE WHEN id % 5 = 0 THEN 1.5::DOUBLE ELSE area_value END AS area_value,
    CASE WHEN id % 5 = 0 THEN 'acre' ELSE area_unit END AS area_unit,
    CASE WHEN id % 5 = 0 THEN round(1.5::DOUBLE * 0.404686::DOUBLE + 1e-9::DOUBLE, 6) ELSE area_hectare END AS area_hectare) FROM before)"""
ORACLES["revalidate"] = _every(records=_CORRECTED) + "SELECT rule_id, severity, sum(occurrences)::BIGINT AS n FROM every GROUP BY 1, 2"
ORACLES["revalidated_rollup"] = _every(ROLL.format(src="every"), records=_CORRECTED) + "SELECT id, record_id, discrepancy_count, highest_severity FROM roll JOIN records USING (id)"
_DECIDED = "dec AS (SELECT record_id, id, status, ['approve', 'reject', 'escalate'][id % 4 + 1] AS decision, coalesce(c.n, 0) AS critical FROM records LEFT JOIN (SELECT id, sum(occurrences) AS n FROM every WHERE severity = 'critical' GROUP BY 1) c USING (id))"
ORACLES["decide"] = _every(_DECIDED) + """SELECT record_id, CASE WHEN ok = 'approve' THEN 'approved' WHEN ok = 'reject' THEN 'rejected' WHEN ok = 'escalate' THEN 'escalated' ELSE status END AS status,
  CASE WHEN ok IN ('approve', 'reject') THEN 'completed' WHEN ok = 'escalate' THEN 'needs_review' END AS document_status
  FROM (SELECT *, CASE WHEN decision = 'approve' AND critical > 0 THEN NULL ELSE decision END AS ok FROM dec)"""
ORACLES["refused_approvals"] = _every(_DECIDED) + "SELECT record_id, decision, critical::BIGINT AS open_critical FROM dec WHERE decision = 'approve' AND critical > 0"
_BARRED = "document_type_label = '" + vocab.FORM_39A + "' AND field_name IN (" + ", ".join(map(_text, vocab.PROHIBITED_39A)) + ")"
ORACLES["merge_suggestions"] = _with(RECORDS, _fields()) + f"""SELECT record_id, field_name, CASE field_name WHEN 'village' THEN 'Balarampur' WHEN 'khata_no' THEN '77' ELSE 'Sunita Pradhan' END AS normalized_value,
  round(0.45 * least(75, greatest(confidence, 55)) + 22.5 + 4.5 + 7.0, 2) AS confidence FROM fields
  WHERE field_name IN ('village', 'khata_no', 'owner_name') AND NOT (value <> '' AND confidence >= 70) AND NOT ({_BARRED}) AND (field_name <> 'khata_no' OR id % 2 = 0)"""
ORACLES["notify_fanout"] = _every(ROLL.format(src="every")) + """SELECT s_suppkey AS user_id, n AS unread FROM supplier CROSS JOIN
  (SELECT count(*) AS n FROM roll WHERE highest_severity IN ('high', 'critical')) WHERE s_suppkey % 4 = 0 AND n > 0"""

# ------------------------------------------------------------------ extraction round trip
ORACLES["sub_plot_rows"] = _with(RECORDS) + """SELECT record_id, concat(khasra_no, '/1') AS khasra_no, 0.5::DOUBLE AS area_value, 'acre' AS area_unit, 0.202343::DOUBLE AS area_hectare
  FROM records WHERE khasra_no <> '' AND parent_khasra_no = '' AND length(khasra_no) <= 4"""

# ------------------------------------------------------------------ streams
ORACLES["stream_ingest"] = "SELECT count(DISTINCT sha256(text)) AS stored, count(DISTINCT sha256(text)) AS hashes FROM documents"
ORACLES["stream_daily"] = _with(DOCS) + "SELECT cast(created_at AS date) AS day, count(*) AS documents FROM docs GROUP BY 1"
ORACLES["stream_pending"] = """WITH changes AS (SELECT 'LR-' || user_id AS record_id, event_type NOT IN ('signup', 'purchase') AS pending,
    date_trunc('milliseconds', ts) AS ts, event_id FROM events),
  runs AS (SELECT *, count(*) FILTER (NOT pending) OVER (PARTITION BY record_id ORDER BY ts, event_id) AS run FROM changes),
  waits AS (SELECT record_id, run, min(ts) FILTER (pending) AS since,
    lead(min(ts)) OVER (PARTITION BY record_id ORDER BY run) AS until FROM runs GROUP BY record_id, run)
SELECT record_id, since AS pending_since FROM waits
WHERE since IS NOT NULL AND coalesce(until, (SELECT max(ts) - interval 1 hour FROM changes)) >= since + interval 48 hour"""
ORACLES["stream_alerts"] = ORACLES["notify_fanout"]


def _metric(section: str, metric: str, value: str, source: str, where: str = "") -> str:
    return f"SELECT '{section}' AS section, '{metric}' AS metric, CAST({value} AS VARCHAR) AS value FROM {source}{where and ' WHERE ' + where}"


def _parts(section: str, prefix: str, name: str, source: str, value: str = "count(*)", where: str = "") -> str:
    return (f"SELECT '{section}', '{prefix}.' || {name}, CAST({value} AS VARCHAR) FROM {source}{where and ' WHERE ' + where} GROUP BY 2")


def _pct(part: str, whole: str = "count(*)") -> str:
    return f"coalesce(round({part} / nullif({whole}, 0)::DOUBLE * 100, 1), 0.0::DOUBLE)"


_LINKED = "links LEFT JOIN (SELECT id AS fid, discrepancy_count FROM roll) f ON f.fid = links.id"
_CONF = "avg(record_confidence) FILTER (record_confidence > 0)"
_PROCESSED = "count(*) FILTER (status IN ('completed', 'needs_review'))"
_WHO = "coalesce(CAST(assigned_to_id AS VARCHAR), '(unassigned)')"
_MAPPED = "CASE WHEN {c} = '' THEN '(unmapped)' ELSE {c} END"
_ACTIONS = "(SELECT 'village' AS field_name FROM records WHERE id % 3 = 0 UNION ALL SELECT 'area' FROM records WHERE id % 5 = 0 UNION ALL SELECT 'owner_name' FROM records WHERE id % 7 = 0 UNION ALL SELECT 'status' FROM records WHERE id % 11 = 0)"
_SEVERE = "coalesce(sum(occurrences), 0)::BIGINT"
ORACLES["mis_snapshot"] = _every(ROLL.format(src="every"), DOCS) + " UNION ALL ".join([
    _metric("records", "total", "count(*)", "records"),
    *[_metric("records", s, "count(*)", "records", f"status = '{s}'") for s in ("pending_review", "approved", "rejected", "escalated")],
    _metric("records", "flagged", "count(*)", _LINKED, "discrepancy_count > 0"),
    _parts("records", "by_status", "status", "records"),
    _metric("extraction", "average_record_confidence", f"round({_CONF}, 2)", "records"),
    _metric("extraction", "estimated_accuracy_pct", f"round({_CONF}, 1)", "records"),
    _metric("extraction", "low_confidence_records", "count(*)", "records", "record_confidence < 70"),
    _metric("extraction", "gis_linked_records", "count(*)", "links", "match_type <> 'none'"),
    _metric("extraction", "gis_link_rate_pct", _pct("count(*) FILTER (match_type <> 'none')"), "links"),
    _metric("progress", "review_completion_pct", _pct("count(*) FILTER (status IN ('approved', 'rejected'))"), "records"),
    _parts("progress", "by_district", _MAPPED.format(c="district"), "records"),
    _parts("progress", "by_tehsil", _MAPPED.format(c="tehsil"), "records"),
    _parts("progress", "reviewer_workload", _WHO, "records", where="status = 'pending_review'"),
    _metric("documents", "uploaded", "count(*)", "docs"), _metric("documents", "processed", _PROCESSED, "docs"),
    _metric("documents", "failed", "count(*)", "docs", "status = 'failed'"), _parts("documents", "by_status", "status", "docs"),
    _metric("performance", "average_pipeline_latency_ms", "round(avg(total_latency_ms) FILTER (total_latency_ms > 0), 1)", "docs"),
    _metric("performance", "slowest_document_ms", "max(total_latency_ms)", "docs"),
    _metric("performance", "average_ocr_latency_ms", "round(avg(ocr_latency_ms) FILTER (ocr_latency_ms > 0), 1)", "docs"),
    _metric("performance", "budget_ms", "10000", "(SELECT 1)"),
    _metric("performance", "within_budget", "avg(total_latency_ms) FILTER (total_latency_ms > 0) <= 10000", "docs"),
    _metric("progress", "digitisation_pct", _pct(_PROCESSED), "docs"),
    _parts("progress", "last_7_days", "CAST(CAST(created_at AS DATE) AS VARCHAR)", "docs", where="created_at >= timestamp '2024-01-24 00:00:00'"),
    _metric("validation", "discrepancies_total", _SEVERE, "every"), _metric("validation", "discrepancies_open", _SEVERE, "every"),
    _metric("validation", "high_and_critical", _SEVERE, "every", "severity IN ('high', 'critical')"),
    _parts("validation", "by_severity", "severity", "every", _SEVERE), _parts("validation", "rule_wise", "rule_id", "every", _SEVERE),
    _metric("learning", "corrections_captured", "count(*)", _ACTIONS), _metric("learning", "distinct_fields_corrected", "count(DISTINCT field_name)", _ACTIONS),
    _metric("audit", "events", "count(*)", "events")])

_SIDES = ", ".join(f"'{side} of ' || address AS {side}" for side in vocab.BOUNDARY_MARKS)
ORACLES["form_records"] = _with(RECORDS) + f"""SELECT record_id, owner_name, guardian_name, '{vocab.FORM_39A}' AS document_type_label,
  (1 + (new_owner <> '' AND NOT (new_owner = owner_name AND guardian_name = ''))::INT)::INT AS persons, owner_name AS first_person, guardian_name AS father, {_SIDES}
FROM records WHERE owner_name <> ''"""
ORACLES["form_parcels"] = _with(RECORDS) + """SELECT record_id, round(0.25 * 0.00404686 + 1e-9, 6) + round(1.5 * 0.00404686 + 1e-9, 6) AS declared_sum, 2::BIGINT AS declared_count
FROM records WHERE owner_name <> ''"""
# a page without an area line shows the area of its child plot, if it lists one; of "sq m" a page gives the word before the blank
_CHILD_ONLY = "area_raw = '' AND khasra_no <> '' AND parent_khasra_no = ''"
ORACLES["extract_records"] = _with(RECORDS) + f"""SELECT record_id, khasra_no, khata_no, survey_no, owner_name, district, mutation_no,
  CASE WHEN {_CHILD_ONLY} THEN 0.5::DOUBLE WHEN area_raw = '' THEN 0.0::DOUBLE ELSE area_value END AS area_value,
  CASE WHEN {_CHILD_ONLY} THEN 0.202343::DOUBLE WHEN area_raw = '' OR area_unit = 'sq m' THEN 0.0::DOUBLE ELSE area_hectare END AS area_hectare FROM records"""
