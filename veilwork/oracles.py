"""DuckDB SQL for the registered queries, put together from common table expressions.

RE2 has no look-around: digits runs are wrapped in a mark first, so that a guard against further digits is a mark in the
pattern; letters-and-digits guards are whole words that must match in full.
"""

from __future__ import annotations

from .functions import checks as K
from .functions import constants as C

_O, _C, _M = "chr(57344)", "chr(57345)", "chr(57346)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


FIXTURES = _values([("benchmark", "benchmark", f"benchmark#p{k}", k, b[0]) for k, b in enumerate(C.BENCHMARK, 1)] + [("samples", "samples", f"samples#p{k}", k, t) for k, t in enumerate(C.SAMPLES, 1)])
LINES = f"""lines AS (SELECT CAST(doc_id AS VARCHAR) AS document, unnest(string_split(translate(text, {_O} || {_C}, ''), chr(10))) AS text,
  generate_subscripts(string_split(translate(text, {_O} || {_C}, ''), chr(10)), 1) - 1 AS paragraph_index FROM documents)"""
TEXT_BLOCKS = f"""{LINES}, text_blocks AS (SELECT 'text' AS document_part, document, document || '#p' || paragraph_index AS block_id,
  CAST(paragraph_index AS INTEGER) AS paragraph_index, text FROM lines WHERE trim(text) <> '')"""
BLOCKS = f"{TEXT_BLOCKS}, blocks AS (SELECT *, replace(lower(text), 'ß', 'ss') AS low FROM text_blocks)"
FIXTURE_BLOCKS = f"blocks AS (SELECT *, replace(lower(text), 'ß', 'ss') AS low FROM ({FIXTURES}) AS f(document_part, document, block_id, paragraph_index, text))"


def on_fixtures(sql: str) -> str:
    """The same SQL over the fixture blocks instead of the lines of documents."""
    return sql.replace(BLOCKS, FIXTURE_BLOCKS)


def _found(name: str, pattern: str, where: str, marked: bool = False) -> str:
    """CTE name(block_id, text, low, s, e, v): all matches of an RE2 pattern, M standing for the digit mark."""
    text = f"regexp_replace(text, '([0-9]+)', {_M} || '\\1' || {_M}, 'g')" if marked else "text"
    bare = lambda x: f"replace({x}, {_M}, '')"
    pat = f"replace({q(pattern)}, '<M>', {_M})"
    return f"""{name}_l AS (SELECT block_id, text, low, string_split(regexp_replace({text}, {pat}, {_O} || '\\0' || {_C}, 'g'), {_O}) AS parts FROM blocks WHERE {where}),
{name}_p AS (SELECT block_id, text, low, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM {name}_l),
{name}_s AS (SELECT block_id, text, low, i, {bare(f"split_part(part, {_C}, 1)")} AS v, sum(length({bare(f"replace(part, {_C}, '')")})) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM {name}_p),
{name} AS (SELECT block_id, text, low, CAST(s AS INTEGER) AS s, CAST(s + length(v) AS INTEGER) AS e, v FROM {name}_s WHERE i > 1)"""


def _near(before: int, after: int, terms) -> str:
    w = f"substr(low, greatest(0, s - {before}) + 1, e + {after} - greatest(0, s - {before}))"
    return "(" + " OR ".join(f"contains({w}, {q(t)})" for t in terms) + ")"


DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def luhn_sum(d: str, first: int = 1) -> str:
    x = f"CAST(substr(reverse({d}), CAST(i AS BIGINT), 1) AS INTEGER)"
    return f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (i + {first - 1}) % 2 = 0 THEN CASE WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END ELSE {x} END))"


def luhn(d: str) -> str:
    return f"(length({d}) BETWEEN 13 AND 19 AND {luhn_sum(d)} % 10 = 0)"


def verhoeff(d: str) -> str:
    table = "[" + ", ".join(str(x) for row in K.DIHEDRAL for x in row) + "]"
    moved = "[" + ", ".join(str(x) for row in K.PERMUTED for x in row) + "]"
    x = f"({moved})[(i % 8) * 10 + CAST(substr(reverse({d}), CAST(i + 1 AS BIGINT), 1) AS INTEGER) + 1]"
    return f"(length({d}) = 12 AND list_reduce(list_transform(range(0, length({d})), lambda i: {x}), lambda a, b: ({table})[a * 10 + b + 1], 0) = 0)"


PUBLIC = "(" + ", ".join(q(x) for x in C.PUBLIC_AUTHORITIES) + ")"
NORM = "trim(regexp_replace(lower(v), '\\s+', ' ', 'g'))"
_SUFFIXED = "regexp_matches(text, 'Limited|Ltd|LLP|Inc|Corp')"
_ADDRESS = " + ".join(f"CAST(contains(low, {q(t)}) AS INTEGER)" for t in C.ADDRESS_TERMS)
_KNOWN = "(?i)" + "|".join(C.KNOWN_PERSONS)

#: name -> (CTEs, score expression, type, source, recognizer)
_code = lambda t: (_found(f"c_{t.lower()}", "[A-Za-z0-9]+", "regexp_matches(text, '[0-9]{4}')"), f"regexp_full_match(v, '(?i){C.CODES[t]}')")
_D: list[tuple] = [
    ("email", _found("email", C.EMAIL, "contains(text, '@')"), "0.95", "EMAIL", "PATTERN", "email"),
    ("ssn", _found("ssn", "<M>[0-9]{3}<M>-<M>[0-9]{2}<M>-<M>[0-9]{4}<M>", "contains(text, '-')", True), "CASE WHEN NOT (substr(v, 1, 3) IN ('000', '666') OR substr(v, 1, 1) = '9' OR substr(v, 5, 2) = '00' OR substr(v, 8, 4) = '0000') THEN 0.95 END", "SSN", "PATTERN", "us_ssn"),
    ("ipv4", _found("ipv4", "[0-9.]+", "contains(text, '.')"), r"CASE WHEN regexp_full_match(v, '(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])') THEN 0.95 END", "IPV4", "PATTERN", "ipv4"),
    ("pan", _code("PAN")[0].replace("c_pan", "pan"), f"CASE WHEN {_code('PAN')[1]} THEN 0.85 END", "PAN", "PATTERN", "india_pan"),
    ("aadhaar", _found("aadhaar", "<M>[0-9]{4}(?:<M>[ -]<M>)?[0-9]{4}(?:<M>[ -]<M>)?[0-9]{4}<M>", "regexp_matches(text, '[0-9]{4}')", True), f"CASE WHEN {verhoeff(DIGITS)} THEN 0.98 WHEN contains(low, 'aadhaar') THEN 0.70 END", "AADHAAR", "PATTERN", "aadhaar"),
    ("passport", _code("PASSPORT")[0].replace("c_passport", "passport"), f"CASE WHEN {_code('PASSPORT')[1]} AND {_near(40, 40, ('passport',))} THEN 0.93 END", "PASSPORT", "PATTERN", "india_passport"),
    ("gstin", _code("GSTIN")[0].replace("c_gstin", "gstin"), f"CASE WHEN {_code('GSTIN')[1]} THEN 0.85 END", "GSTIN", "PATTERN", "gstin"),
    ("cin", _code("CIN")[0].replace("c_cin", "cin"), f"CASE WHEN {_code('CIN')[1]} THEN 0.85 END", "CIN", "PATTERN", "cin"),
    ("ifsc", _code("IFSC")[0].replace("c_ifsc", "ifsc"), f"CASE WHEN NOT {_code('IFSC')[1]} THEN NULL WHEN {_near(60, 60, ('ifsc',))} AND {_near(60, 60, C.BANK_CONTEXT)} THEN 0.93 ELSE 0.60 END", "IFSC", "PATTERN", "ifsc"),
    ("phone", _found("phone", C.PHONE, "regexp_matches(text, '[0-9]')"), f"CASE WHEN {_near(35, 35, C.NOT_A_NUMBER)} THEN NULL WHEN (v LIKE '+%' AND length({DIGITS}) BETWEEN 8 AND 15) OR regexp_full_match({DIGITS}, '[6-9][0-9]{{9}}') THEN 0.95 WHEN length({DIGITS}) BETWEEN 7 AND 15 AND {_near(35, 35, C.PHONE_CONTEXT)} THEN 0.72 END", "PHONE", "VALIDATOR", "phone_number"),
    ("credit_card", _found("card", "<M>(?:[0-9](?:<M>[ -]<M>)?){12,18}[0-9]<M>", "regexp_matches(text, '[0-9]')", True) + """,
credit_card AS (SELECT block_id, text, low, s, CAST(s + length(w) AS INTEGER) AS e, w AS v FROM (SELECT *, CASE WHEN substr(text, e + 1, 1) IN (' ', '-') AND NOT regexp_matches(substr(text, e + 2, 1), '[0-9]') THEN v || substr(text, e + 1, 1) ELSE v END AS w FROM card))""", f"CASE WHEN NOT {_near(40, 40, C.NOT_A_NUMBER)} AND {luhn(DIGITS)} THEN 0.98 END", "CREDIT_CARD", "VALIDATOR", "luhn_card"),
    ("dob", _found("dob", f"(?i)<M>[0-9]{{1,2}}<M>[/-]<M>[0-9]{{1,2}}<M>[/-]<M>[0-9]{{2,4}}<M>|<M>[0-9]{{1,2}}<M>\\s+(?:{C.MONTHS})\\s+<M>[0-9]{{4}}<M>", "regexp_matches(text, '[0-9]')", True), f"CASE WHEN {_near(55, 30, C.DOB_CONTEXT)} THEN 0.93 END", "DOB", "CONTEXT", "dob_context"),
    ("company", _found("company", C.COMPANY, _SUFFIXED), f"CASE WHEN {NORM} NOT IN {PUBLIC} THEN 0.93 END", "COMPANY", "GAZETTEER", "company_suffix"),
    ("person", _found("person", _KNOWN, f"regexp_matches(text, {q(_KNOWN)})"), "0.93", "PERSON", "GAZETTEER", "known_person"),
    ("address", f"""address_c AS (SELECT *, instr(text, ':') AS colon, {_ADDRESS} AS n FROM blocks WHERE length(text) <= 350),
address_t AS (SELECT *, CASE WHEN colon BETWEEN 1 AND 80 THEN regexp_replace(substr(text, colon + 1), '^\\s+', '') ELSE text END AS trimmed FROM address_c WHERE n >= 2 OR (n >= 1 AND regexp_matches(text, '(^|[^0-9])[1-9][0-9]{{5}}($|[^0-9])'))),
address_b AS (SELECT *, length(text) - length(trimmed) AS s, regexp_replace(string_split_regex(trimmed, {q('(?i)' + C.ADDRESS_END)})[1], '\\s+$', '') AS v FROM address_t),
address AS (SELECT block_id, text, low, CAST(s AS INTEGER) AS s, CAST(s + length(v) AS INTEGER) AS e, v FROM address_b WHERE length(trim(v)) >= 12)""", "0.85", "ADDRESS", "CONTEXT", "address_context"),
    ("named", _found("named_f", C.NAMED + C.NAME, "contains(text, ':')") + f""",
named AS (SELECT block_id, text, low, CAST(e - length(w) AS INTEGER) AS s, e, w AS v FROM (SELECT *, regexp_replace(v, {q('^' + C.NAMED)}, '') AS w FROM named_f))""", "0.82", "PERSON", "NER", "named_person"),
    ("organisation", "organisation AS (SELECT * FROM company)", f"CASE WHEN {NORM} IN {C.PUBLIC_AUTHORITIES + C.NO_COMPANIES} THEN NULL WHEN {' OR '.join(f'contains(lower(v), {q(t)})' for t in C.COMMERCIAL)} THEN 0.85 ELSE 0.60 END", "COMPANY", "NER", "organisation"),
]


def _row(k: int) -> str:
    name, _, score, kind, source, recognizer = _D[k]
    return f"SELECT block_id, '{kind}' AS pii_type, s AS start_offset, e AS end_offset, v AS value, CAST({score} AS DOUBLE) AS score, '{source}' AS source, '{recognizer}' AS recognizer, {k} AS ord FROM {name}"


def detect(name: str) -> str:
    k = next(i for i, d in enumerate(_D) if d[0] == name)
    need = [d for d in _D if d[0] == name or (name == "organisation" and d[0] == "company")]
    return f"WITH {BLOCKS}, {', '.join(d[1] for d in need)} SELECT * EXCLUDE (ord) FROM ({_row(k)}) WHERE score IS NOT NULL"


FOUND = f"WITH {BLOCKS}, {', '.join(d[1] for d in _D)}, found AS (SELECT * FROM ({' UNION ALL '.join(_row(k) for k in range(len(_D)))}) WHERE score IS NOT NULL)"
MERGED = FOUND + f""", merged AS (SELECT *, CASE WHEN final_confidence >= {C.AUTO} THEN 'AUTO_APPROVED' WHEN final_confidence >= {C.REVIEW} THEN 'NEEDS_REVIEW' ELSE 'LOW_CONFIDENCE' END AS review_status FROM (
  SELECT block_id, pii_type, start_offset, end_offset, any_value(value) AS value, least(0.99::DOUBLE, max(score) + 0.08::DOUBLE * (count(DISTINCT source) - 1)) AS final_confidence, count(*) AS n_evidence, count(DISTINCT source) AS n_sources, min(ord) AS ord, string_agg(source, ',' ORDER BY ord) AS sources FROM found GROUP BY ALL))"""
_PRIORITY = "CASE pii_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.PRIORITY.items()) + " END"
_ROW = "STRUCT(t VARCHAR, s INTEGER, e INTEGER, v VARCHAR, c DOUBLE, st VARCHAR, src VARCHAR)"
RESOLVED = MERGED + f""", listed AS (SELECT block_id, list(CAST({{'t': pii_type, 's': start_offset, 'e': end_offset, 'v': value, 'c': final_confidence, 'st': review_status, 'src': sources}} AS {_ROW})
  ORDER BY final_confidence DESC, {_PRIORITY} DESC, end_offset - start_offset DESC, start_offset, ord) AS l FROM merged GROUP BY block_id),
folded AS (SELECT block_id, unnest(list_reduce(l, lambda a, x: CASE
  WHEN len(list_filter(a, lambda y: x.s < y.e AND x.e > y.s)) = 0 THEN list_append(a, x)
  WHEN x.t = 'ADDRESS' AND x.c >= 0.85 AND len(list_filter(a, lambda y: x.s < y.e AND x.e > y.s AND NOT (x.s <= y.s AND x.e >= y.e))) = 0 THEN list_append(list_filter(a, lambda y: NOT (x.s < y.e AND x.e > y.s)), x)
  ELSE a END, CAST([] AS {_ROW}[]))) AS x FROM listed),
recs0 AS (SELECT b.document_part, b.document, f.block_id, x.t AS pii_type, x.s AS start_offset, x.e AS end_offset, x.v AS original_text, {NORM.replace('(v)', '(x.v)')} AS normalized_text, x.c AS final_confidence, x.st AS review_status, x.src AS sources FROM folded f JOIN blocks b USING (block_id)),
recs AS (SELECT *, left(sha256(block_id || '|' || pii_type || '|' || start_offset || '|' || end_offset || '|' || normalized_text), 20) AS record_id FROM recs0)"""
_CORP = "('COMPANY', 'CIN', 'GSTIN', 'IFSC')"


def policy(scope: str) -> str:
    corp = "" if scope == "redact" else f"WHEN pii_type IN {_CORP} THEN '{scope.upper()}'"
    return f"CASE WHEN review_status = 'REJECTED' THEN 'IGNORE' {corp} WHEN review_status IN ('NEEDS_REVIEW', 'LOW_CONFIDENCE') THEN 'REVIEW' ELSE 'REDACT' END"


_ONE = lambda t, p: f"CASE WHEN count(*) FILTER (pii_type = '{t}') OVER b = 1 THEN max(CASE WHEN pii_type = '{t}' THEN '{p}' || left(sha256(normalized_text), 12) END) OVER b END"
LINKED = RESOLVED + f""", linked AS (SELECT *, {policy('protect')} AS policy_action, CASE
  WHEN pii_type = 'PERSON' THEN 'person-' || left(sha256(normalized_text), 12) WHEN pii_type = 'COMPANY' THEN 'org-' || left(sha256(normalized_text), 12)
  ELSE coalesce(CASE WHEN pii_type IN {C.PERSONAL_LINKS} THEN {_ONE('PERSON', 'person-')} END,
    CASE WHEN pii_type IN {C.CORPORATE_LINKS} THEN {_ONE('COMPANY', 'org-')} END,
    CASE WHEN pii_type IN {_CORP} THEN 'org-' ELSE 'entity-' END || left(sha256(pii_type || '|' || normalized_text), 12)) END AS identity_id
  FROM recs WINDOW b AS (PARTITION BY block_id))"""
SEED = b"test-secret"


def hmac(message: str) -> str:
    pad = lambda v: "'" + "".join(f"\\x{x ^ v:02X}" for x in SEED.ljust(64, b"\0")) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


def _num(h: str, start: int, n: int) -> str:
    return f"CAST(('0x' || substr({h}, {start + 1}, {n})) AS BIGINT)"


def _pick(names, n: str) -> str:
    return f"([{', '.join(q(x) for x in names)}])[{n} % {len(names)} + 1]"


_TWELVE = "('00000000' || lpad(CAST(idx % 10000 AS VARCHAR), 4, '0'))"
_BODY = "substr('411111' || lpad(CAST(idx AS VARCHAR), 12, '0'), 1, least(19, greatest(13, length(regexp_replace(original_text, '[^0-9]', '', 'g')))) - 1)"
_FULL = f"(cbody || CAST((10 - {luhn_sum('cbody', 2)} % 10) % 10 AS VARCHAR))"
_CARD = f"list_aggregate(list_transform(range(1, length(original_text) + 1), lambda i: CASE WHEN regexp_matches(substr(original_text, CAST(i AS BIGINT), 1), '[0-9]') THEN substr({_FULL}, length(regexp_replace(substr(original_text, 1, CAST(i AS BIGINT)), '[^0-9]', '', 'g')), 1) ELSE substr(original_text, CAST(i AS BIGINT), 1) END), 'string_agg', '')"
_DATE = "CASE WHEN regexp_full_match(original_text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') THEN strftime(bday, '%d/%m/%Y') WHEN regexp_full_match(original_text, '[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}') THEN strftime(bday, '%d-%m-%Y') ELSE strftime(bday, '%d %B %Y') END"
MASK = "('[' || pii_type || '_' || lpad(CAST(idx AS VARCHAR), 4, '0') || ']')"
_TAIL = "right(regexp_replace(original_text, '[^A-Za-z0-9]', '', 'g'), 4)"
PARTIAL = f"""CASE WHEN pii_type IN ('PHONE', 'AADHAAR', 'PAN', 'CREDIT_CARD') THEN repeat('*', greatest(4, length(original_text) - length({_TAIL}))) || {_TAIL}
  WHEN pii_type = 'EMAIL' AND contains(original_text, '@') THEN left(original_text, 1) || '***@' || substr(original_text, instr(original_text, '@') + 1)
  WHEN pii_type = 'IPV4' THEN split_part(original_text, '.', 1) || '.' || split_part(original_text, '.', 2) || '.x.x' ELSE {MASK} END"""
SYNTHETIC = f"""CASE pii_type WHEN 'PERSON' THEN given || ' ' || surname WHEN 'EMAIL' THEN lower(given) || '.' || lower(surname) || '.' || lpad(CAST(num AS VARCHAR), 5, '0') || '@example.test'
  WHEN 'PHONE' THEN '+91 00000 ' || lpad(CAST(num AS VARCHAR), 5, '0') WHEN 'ADDRESS' THEN (num % 199 + 1) || ' Sample Road, Test City 000001'
  WHEN 'COMPANY' THEN stem || ' ' || descriptor || ' ' || lpad(CAST(idx AS VARCHAR), 4, '0') || ' ' || CASE WHEN regexp_extract(original_text, {q('(?i)' + C.SUFFIX)}, 1) = '' THEN 'Private Limited' ELSE regexp_extract(original_text, {q('(?i)' + C.SUFFIX)}, 1) END
  WHEN 'DOB' THEN {_DATE} WHEN 'IPV4' THEN '198.51.100.' || (idx % 253 + 1) WHEN 'SSN' THEN '000-00-' || lpad(CAST(idx % 10000 AS VARCHAR), 4, '0')
  WHEN 'CREDIT_CARD' THEN {_CARD} WHEN 'PAN' THEN 'TESTX' || lpad(CAST(idx % 10000 AS VARCHAR), 4, '0') || 'Z'
  WHEN 'AADHAAR' THEN substr(aad, 1, 4) || ' ' || substr(aad, 5, 4) || ' ' || substr(aad, 9, 4) WHEN 'PASSPORT' THEN 'Z' || lpad(CAST(idx AS VARCHAR), 7, '0')
  WHEN 'GSTIN' THEN '00TESTX' || lpad(CAST(idx AS VARCHAR), 4, '0') || 'Z0Z0' WHEN 'CIN' THEN 'U00000ZZ1900ZZZ' || lpad(CAST(idx AS VARCHAR), 6, '0') WHEN 'IFSC' THEN 'TEST9' || lpad(CAST(idx AS VARCHAR), 6, '0') ELSE {MASK} END"""
PROFILE = LINKED + f""", hashed AS (SELECT *, {hmac("pii_type || '|' || coalesce(identity_id, normalized_text)")} AS h1, {hmac("coalesce(identity_id, record_id)")} AS h2 FROM linked),
numbered AS (SELECT *, {_num('h1', 0, 8)} % 9999 + 1 AS idx, {_pick(C.GIVEN, _num('h2', 0, 4))} AS given, {_pick(C.SURNAMES, _num('h2', 4, 4))} AS surname, {_pick(C.STEMS, _num('h2', 8, 4))} AS stem, {_pick(C.DESCRIPTORS, _num('h2', 12, 4))} AS descriptor, {_num('h2', 16, 8)} % 100000 AS num FROM hashed),
profiled AS (SELECT *, {_BODY} AS cbody, DATE '1900-01-01' + CAST(idx % 365 AS INTEGER) AS bday, CASE WHEN {verhoeff(_TWELVE)} THEN substr({_TWELVE}, 1, 11) || ((CAST(substr({_TWELVE}, 12, 1) AS INTEGER) + 1) % 10) ELSE {_TWELVE} END AS aad FROM numbered)"""


def valued(mode: str) -> str:
    raw = {"mask": MASK, "partial": PARTIAL, "synthetic": SYNTHETIC}[mode]
    return PROFILE + f""", valued AS (SELECT *, CASE WHEN contains(lower(raw), lower(original_text)) OR contains(lower(original_text), lower(raw)) THEN {MASK} ELSE raw END AS value FROM (SELECT *, {raw} AS raw FROM profiled))"""


REPLACED = valued("synthetic") + """, replaced AS (SELECT *, CASE WHEN policy_action = 'REDACT' THEN first_value(value) OVER (PARTITION BY pii_type, normalized_text, policy_action ORDER BY document_part, block_id, start_offset, pii_type) END AS replacement_value FROM valued)"""
REDACTED = REPLACED + """, spliced AS (SELECT block_id, list({'s': start_offset, 'e': end_offset, 'r': replacement_value} ORDER BY start_offset) AS l FROM replaced WHERE replacement_value IS NOT NULL GROUP BY block_id),
redacted AS (SELECT b.block_id, b.text, CASE WHEN l IS NULL THEN b.text ELSE list_aggregate(list_transform(range(1, len(l) + 1), lambda i: substr(b.text, CASE WHEN i = 1 THEN 1 ELSE l[i - 1].e + 1 END, l[i].s - CASE WHEN i = 1 THEN 0 ELSE l[i - 1].e END) || l[i].r), 'string_agg', '') || substr(b.text, l[len(l)].e + 1) END AS redacted FROM blocks b LEFT JOIN spliced USING (block_id))"""
GOLD = "gold AS (SELECT * FROM (" + _values([(b[1], "benchmark", f"benchmark#p{k}", b[2], b[3]) for k, b in enumerate(C.BENCHMARK, 1) if b[1]]) + ") AS g(pii_type, document_part, block_id, start_offset, end_offset))"

#: records whose original stands, bounded by words, in its block of `written` (block_id, redacted) after the block's replacements are taken out
_EDGE = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
_ALNUM = r"'[\p{L}\p{N}]'"
RESIDUAL = rf"""taken AS (SELECT block_id, string_agg(regexp_escape(v), '|' ORDER BY length(v) DESC, v DESC) AS pattern FROM (SELECT DISTINCT block_id, lower(replacement_value) AS v FROM replaced WHERE replacement_value <> '') GROUP BY block_id),
rest AS (SELECT block_id, CASE WHEN pattern IS NULL THEN lower(redacted) ELSE regexp_replace(lower(redacted), pattern, chr(10), 'g') END AS rest FROM written LEFT JOIN taken USING (block_id)),
residual AS (SELECT DISTINCT record_id, block_id, original_text FROM replaced JOIN rest USING (block_id) WHERE replacement_value IS NOT NULL AND length(trim(original_text)) >= 4
  AND regexp_matches(rest, CASE WHEN regexp_full_match(left(original_text, 1), {_ALNUM}) THEN '(^|{_EDGE})' ELSE '' END || regexp_escape(lower(original_text)) || CASE WHEN regexp_full_match(right(original_text, 1), {_ALNUM}) THEN '($|{_EDGE})' ELSE '' END))"""
