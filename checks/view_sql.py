"""The SQL side: the same views, and the features over them, written for DuckDB."""

from __future__ import annotations

import re

from funcrisk import constants as C
from checks.views import LEXICON


def strings(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


LEX = strings(LEXICON)
NL = "chr(10)"


def word(index: str) -> str:
    return f"({LEX})[CAST(({index}) % 16 + 1 AS INTEGER)]"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def in_list(items: str, words, lower: bool = False) -> str:
    """Some element holds some word."""
    x = "lower(x)" if lower else "x"
    return f"(len(list_filter({items}, lambda x: {any_in(x, words)})) > 0)"


def count_list(items: str, words) -> str:
    return f"CAST(len(list_filter({items}, lambda x: {any_in('lower(x)', words)})) AS BIGINT)"


def bit(condition: str) -> str:
    return f"CAST(({condition}) AS BIGINT)"


def rules_values() -> str:
    rows = []
    for n, (i, name, signals, rule) in enumerate(C.DEFAULT_RULES):
        quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in (i, name, signals, rule))
        rows.append(f"({n}, {quoted})")
    return ", ".join(rows)


V: dict[str, str] = {}

V["v_docs"] = f"""
SELECT *, source AS firmware_id, doc_id + 1 AS func_ordinal, printf('func_%03d', doc_id + 1) AS func_id,
       {word('doc_id')} || '_' || lang AS name
FROM documents"""

V["v_asm_lines"] = f"""
SELECT firmware_id, func_id, doc_id, k AS line_no,
  CASE WHEN line = '' THEN ''
       WHEN (doc_id + 2 * k) % 5 = 0 THEN 'call8 40081290 <' || {word('doc_id * 7 + (k % (1 + doc_id % 5)) * 3')} || '> ; ' || line
       WHEN (doc_id + 2 * k) % 5 = 1 THEN 'jal ' || {word('doc_id * 7 + (k % (1 + doc_id % 5)) * 3')} || ' ; ' || line
       WHEN (doc_id + 2 * k) % 5 = 2 THEN 'CALL0 0x4000 ; ' || line
       WHEN (doc_id + 2 * k) % 5 = 3 THEN 'callx8 a5 ; ' || line
       ELSE '.word ' || line END AS text
FROM (SELECT firmware_id, func_id, doc_id, unnest(string_split(text, {NL})) AS line,
             unnest(range(len(string_split(text, {NL})))) AS k FROM v_docs)"""

V["v_asm"] = f"""
SELECT firmware_id, func_id, string_agg(text, {NL} ORDER BY line_no) AS disassembly,
       CAST(greatest(1, count(*) FILTER (regexp_matches(text, '\\S') AND NOT regexp_matches(text, '^\\s*\\.'))) AS BIGINT) AS instructions
FROM v_asm_lines GROUP BY 1, 2"""

V["v_calls"] = f"""
SELECT firmware_id, func_id, list_sort(list_distinct(list_filter(list_concat(list_concat(
    list_filter(list_transform(regexp_extract_all(disassembly, '(?i)\\bcall\\d*\\s+([^\\s,]+)', 1), lambda x: trim(x, '<>')), lambda x: NOT starts_with(x, '0x')),
    list_transform(regexp_extract_all(disassembly, '(?i)\\bjal\\s+([^\\s,]+)', 1), lambda x: trim(x, '<>'))), list_concat(
    flatten(list_transform(list_filter(string_split(disassembly, {NL}), lambda l: regexp_matches(l, '(?i)\\bcall\\d*\\b')),
            lambda l: regexp_extract_all(l, '<([A-Za-z_][\\w.]*)>', 1))),
    list_filter({strings(C.PLAIN_CALL_TOKENS)}, lambda t: contains(lower(disassembly), t)))), lambda x: x <> ''))) AS asm_calls
FROM v_asm"""

V["v_functions"] = f"""
SELECT d.firmware_id, d.func_id, d.func_ordinal, d.name, d.doc_id, 1073741824 + d.doc_id * 64 AS address_int,
  printf('0x%08X', 1073741824 + d.doc_id * 64) AS address, d.n_chars AS size, a.instructions,
  list_concat(c.asm_calls, list_filter({strings(C.NAME_HINT_TOKENS)}, lambda t: contains(lower(d.name), t) AND NOT list_contains(c.asm_calls, t))) AS calls,
  list_filter(list_transform(string_split(d.text, '.'), lambda x: trim(x)), lambda x: x <> '') AS strings,
  5.5::DOUBLE + (d.doc_id % 30) / 10.0::DOUBLE AS entropy, a.disassembly,
  CASE WHEN d.doc_id % 3 <> 0 THEN 'main/' || d.lang || (d.doc_id % 37) || '.c' END AS source_file,
  CASE WHEN d.doc_id % 3 <> 0 THEN d.doc_id % 200 + 1 END AS line_start,
  CASE WHEN d.doc_id % 3 <> 0 THEN d.doc_id % 200 + 1 + d.n_chars % 50 END AS line_end,
  d.doc_id % 3 <> 0 AS has_source_mapping
FROM v_docs d JOIN v_asm a USING (firmware_id, func_id) JOIN v_calls c USING (firmware_id, func_id)"""

V["v_extended"] = f"""
SELECT *, lower(name) AS lname, list_concat(calls, list_filter({strings(C.EXTENSION_TOKENS)},
    lambda t: contains(lower(disassembly), t) AND NOT list_contains(list_transform(calls, lambda x: lower(x)), t))) AS c
FROM v_functions"""

_WORDS_IN = lambda words: f"{any_in('lname', words)} OR {in_list('strings', words, True)}"

V["v_structural"] = f"""
SELECT *, least(cyclomatic_complexity // 3, 5)::BIGINT AS nesting_depth, {bit('num_allocations > 0')} AS has_memory_management FROM (
SELECT firmware_id, func_id, size::BIGINT AS function_size, instructions::BIGINT AS instruction_count,
  size::DOUBLE / greatest(instructions, 1) AS bytes_per_instruction,
  len(c)::BIGINT AS num_calls, len(list_distinct(c))::BIGINT AS num_unique_calls,
  len(list_filter(c, lambda x: list_contains({strings(C.DANGEROUS_CALLS)}, x)))::BIGINT AS num_dangerous_calls,
  {bit("list_contains(c, 'strcpy')")} AS has_strcpy, {bit("list_contains(c, 'sprintf')")} AS has_sprintf,
  {bit("list_contains(c, 'memcpy')")} AS has_memcpy,
  len(strings)::BIGINT AS num_strings,
  CASE WHEN len(strings) > 0 THEN list_sum(list_transform(strings, lambda x: length(x)))::DOUBLE / len(strings) ELSE 0.0 END AS avg_string_length,
  entropy,
  CAST(floor(1 + len(calls) * 0.5::DOUBLE + instructions // 15) AS BIGINT) AS cyclomatic_complexity,
  greatest(instructions // 10, 1)::BIGINT AS num_branches, greatest(instructions // 20, 0)::BIGINT AS num_loops,
  CAST(CASE WHEN len(c) = 0 THEN 0 WHEN len(c) < 3 THEN 1 WHEN len(c) < 6 THEN 2 WHEN len(c) < 10 THEN 3 ELSE 4 END AS BIGINT) AS call_graph_depth,
  {bit(_WORDS_IN(C.INPUT_VALIDATION_WORDS))} AS has_input_validation,
  {bit(_WORDS_IN(C.OUTPUT_SANITIZATION_WORDS))} AS has_output_sanitization,
  {bit(in_list('strings', C.FORMAT_INDICATORS) + ' OR ' + in_list('c', C.FORMAT_INDICATORS))} AS has_format_strings,
  {bit(in_list('strings', C.SECRET_WORDS, True))} AS has_hardcoded_secrets,
  {count_list('c', C.CONDITIONAL_WORDS)} AS num_conditionals, {count_list('c', C.BUFFER_CALLS)} AS num_buffer_ops,
  {count_list('c', C.ALLOCATION_CALLS)} AS num_allocations
FROM v_extended)"""

_CALLS = {p: count_list("calls", words) for p, words in C.PERIPHERAL_CALLS.items()}
V["v_peripheral"] = f"""
SELECT firmware_id, func_id,
  {", ".join(f"{bit(f'contains(lname, {chr(39)}{p}{chr(39)})')} AS name_contains_{p}" for p in C.IO_PATTERNS)},
  {", ".join(f"{bit(in_list('strings', [p], True))} AS string_contains_{p}" for p in C.IO_PATTERNS)},
  {", ".join(f"{v} AS calls_{p}" for p, v in _CALLS.items())},
  {" + ".join(_CALLS.values())} AS io_intensity,
  {bit(_WORDS_IN(C.NETWORK_WORDS) + ' OR ' + in_list('calls', C.NETWORK_WORDS, True))} AS is_network_function,
  {bit(_WORDS_IN(C.INPUT_WORDS))} AS is_input_function, {bit(_WORDS_IN(C.OUTPUT_WORDS))} AS is_output_function
FROM v_extended"""


def _pattern(words) -> str:
    hits = " + ".join(f"CAST((contains(lname, '{w}') OR {in_list('calls', [w], True)}) AS INTEGER)" for w in words)
    return f"least(({hits}) / {float(len(words))}::DOUBLE, 1.0::DOUBLE)"


def _gauss() -> str:
    out = []
    for b in range(4):
        h = f"md5(name || '#{b}')"
        u = [f"((('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)" for i in range(4)]
        for x, y in ((u[0], u[1]), (u[2], u[3])):
            out += [f"sqrt(-2 * ln({x})) * cos(2 * pi() * {y})", f"sqrt(-2 * ln({x})) * sin(2 * pi() * {y})"]
    out[0] += " + size / 1000.0::DOUBLE"
    out[1] += " + instructions / 100.0::DOUBLE"
    out[2] += " + len(calls) / 10.0::DOUBLE"
    return ", ".join(f"{e} AS e{i}" for i, e in enumerate(out))


V["v_embedding"] = f"""
SELECT firmware_id, func_id, {", ".join(f"e{i} / (sqrt({' + '.join(f'e{j} * e{j}' for j in range(16))}) + 1e-8::DOUBLE) AS embedding_{i}" for i in range(16))},
  {", ".join(f"similarity_{p}" for p in C.PATTERN_KEYWORDS)}, semantic_complexity
FROM (SELECT firmware_id, func_id, {_gauss()},
  {", ".join(f"{_pattern(w)} AS similarity_{p}" for p, w in C.PATTERN_KEYWORDS.items())},
  len(calls) * 0.1::DOUBLE + len(strings) * 0.05::DOUBLE AS semantic_complexity FROM v_extended)"""

V["v_cwe"] = """
SELECT d.firmware_id, d.func_id, CASE WHEN toxic = 1 AND quality = 0 THEN ['CWE-120', 'CWE-787', 'CWE-79']
  WHEN toxic = 1 THEN ['CWE-120', 'CWE-79'] WHEN quality = 0 THEN ['CWE-787'] ELSE CAST([] AS VARCHAR[]) END AS cwe
FROM v_docs d LEFT JOIN labels USING (doc_id)"""

_W = ["num_dangerous_calls", "entropy", "cyclomatic_complexity"]


def rule_total(source: str, partition: str = "firmware_id") -> str:
    """Weighted sum over min-max scaled features, in the order of the weights."""
    terms = []
    for f, w in C.RULE_WEIGHTS.items():
        lo, hi = (f"{g}({f}) OVER (PARTITION BY {partition})" for g in ("min", "max"))
        terms.append(f"CASE WHEN {hi} > {lo} THEN ({f}::DOUBLE - {lo}) / nullif({hi} - {lo}, 0) ELSE {f}::DOUBLE END * {w}::DOUBLE")
    total = "0.0::DOUBLE"
    for t in terms:
        total = f"({total} + {t})"
    return f"{total} + CASE WHEN entropy > 7 AND num_dangerous_calls > 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"


V["v_rule_score"] = f"""
SELECT firmware_id, func_id, least(1.0, greatest(0.0, 1 / (1 + exp(-2 * total)))) AS score
FROM (SELECT firmware_id, func_id, {rule_total('v_structural')} AS total FROM v_structural)"""

V["v_predictions"] = """
SELECT firmware_id, func_id, score, cwe, score >= 0.7 AS is_vulnerable FROM (
SELECT firmware_id, func_id, cwe, round(CASE WHEN len(cwe) > 0 THEN least(round(score, 6) + 0.3::DOUBLE, 0.95::DOUBLE) ELSE round(score, 6) END, 6) AS score
FROM v_rule_score JOIN v_cwe USING (firmware_id, func_id))"""

V["v_label_rows"] = """
SELECT doc_id AS row_idx, name AS function_name, toxic = 1 AS vulnerable,
  CASE WHEN toxic = 1 THEN ['CWE-120', 'CWE-79'] WHEN quality = 0 THEN ['CWE-787'] ELSE CAST([] AS VARCHAR[]) END AS cwe_list,
  CASE WHEN doc_id % 2 = 0 THEN source END AS firmware,
  CASE WHEN doc_id % 3 = 0 THEN func_id END AS func_id,
  CASE WHEN doc_id % 5 = 0 THEN 1073741824 + doc_id * 64 END AS address,
  CASE WHEN doc_id % 7 = 0 THEN 'x/' || upper(lang) || (doc_id % 37) || '.c' END AS source_file,
  CASE WHEN doc_id % 7 = 0 THEN doc_id % 200 + 20 END AS line
FROM v_docs JOIN labels USING (doc_id)"""

V["v_responses"] = """
SELECT firmware_id, func_id, style, a, b, CASE style
  WHEN 0 THEN '["' || a || '", "' || lower(b) || '", 79]' || chr(10) || text
  WHEN 1 THEN text || chr(10) || '```json' || chr(10) || '["' || a || '"]' || chr(10) || '``` and ' || b
  WHEN 2 THEN text || ' see ' || lower(a) || ' or ' || b || '.'
  WHEN 3 THEN '[] ' || text || ' ' || a
  ELSE '[''' || a || ''', broken] ' || text || ' ' || b END AS answer
FROM (SELECT *, (doc_id // 25) % 5 AS style, (['CWE-120', 'CWE-787', 'CWE-416', 'CWE-79', 'CWE-999'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS a,
  (['CWE-120', 'CWE-787', 'CWE-416', 'CWE-79', 'CWE-999'])[CAST((doc_id // 5) % 5 + 1 AS INTEGER)] AS b FROM v_docs)"""

V["v_rules"] = f"""
SELECT * FROM (VALUES {rules_values()}) t(rule_ordinal, cwe_id, cwe_name, detection_signals, llm_labeling_rule)"""

V["v_rule_tokens"] = """
SELECT cwe_id, list_filter(string_split_regex(lower(detection_signals), '[,;|\\s]+'), lambda t: length(t) >= 3) AS signal,
  list_filter(string_split_regex(lower(detection_signals || ' ' || llm_labeling_rule), '[,;|\\s]+'), lambda t: length(t) >= 3) AS broad
FROM v_rules"""

V["v_haystack"] = """
SELECT firmware_id, func_id, lower(name || ' ' || array_to_string(calls, ' ') || ' ' || array_to_string(strings, ' ') || ' ' || disassembly) AS haystack,
  lower(name || ' ' || array_to_string(calls, ' ') || ' ' || array_to_string(strings, ' ') || ' ' || substr(disassembly, 1, 400)) AS cut,
  lower(name || ' ' || array_to_string(calls, ' ') || ' ' || array_to_string(strings, ' ') || ' ' || disassembly) AS whole
FROM v_functions"""


def matched(tokens: str, hay: str = "haystack") -> str:
    """firmware_id, func_id, ids: sorted ids of the rules that have a token in the text."""
    return f"""SELECT h.firmware_id, h.func_id, coalesce(list_sort(list(r.cwe_id) FILTER (
        len(list_filter(r.{tokens}, lambda t: contains(h.{hay}, t))) > 0)), CAST([] AS VARCHAR[])) AS ids
    FROM v_haystack h, v_rule_tokens r GROUP BY ALL"""


V["v_hints"] = f"SELECT firmware_id, func_id, ids FROM ({matched('signal').replace('GROUP BY ALL', 'GROUP BY 1, 2')})"
V["v_matches"] = f"SELECT firmware_id, func_id, ids FROM ({matched('broad').replace('GROUP BY ALL', 'GROUP BY 1, 2')})"

V["v_parsed"] = """
SELECT firmware_id, func_id, answer, list_sort(list_distinct(CASE style WHEN 0 THEN [a, b] WHEN 1 THEN [a] WHEN 2 THEN [a, b]
  WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE [a, b] END)) AS ids FROM v_responses"""

V["v_symbols"] = f"""
SELECT 'fw' || l_suppkey AS firmware_id, 10 * l_orderkey + l_linenumber AS ordinal,
  CASE WHEN l_returnflag = 'R' THEN 'STT_OBJECT' ELSE 'STT_FUNC' END AS sym_type,
  CASE WHEN l_discount = 0 THEN 'SHN_UNDEF' ELSE '1' END AS shndx, 4096 + 64 * l_partkey AS address,
  CAST(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_quantity END AS BIGINT) AS size,
  CASE WHEN l_linenumber = 6 THEN '' ELSE {word('l_partkey')} || '_' || l_partkey || '_' || l_linenumber END AS name,
  l_partkey, l_suppkey
FROM lineitem"""

V["v_sections"] = """
SELECT 'fw' || s_suppkey AS firmware_id, x.name, x.address, x.size FROM supplier, (VALUES
  ('.text', 4096, 76800), ('.rodata', 80896, 19200), ('.flash.text', 100096, 6400000), ('.iram0.text', 64, 0)) x(name, address, size)
UNION ALL SELECT 'fw' || s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '.debug_line' ELSE '.bss' END, 0, 10 FROM supplier"""

V["v_good_symbols"] = """
SELECT * FROM v_symbols WHERE sym_type = 'STT_FUNC' AND shndx <> 'SHN_UNDEF' AND size > 0 AND name <> ''"""

V["v_code_symbols"] = """
SELECT s.* FROM v_good_symbols s WHERE EXISTS (SELECT 1 FROM v_sections x WHERE x.firmware_id = s.firmware_id
  AND x.name IN ('.text', '.flash.text', '.iram0.text') AND x.size > 0 AND s.address >= x.address AND s.address < x.address + x.size)"""

V["v_dedup"] = """
SELECT DISTINCT firmware_id, address, size, name, ordinal FROM v_code_symbols
QUALIFY rank() OVER (PARTITION BY firmware_id, address ORDER BY size DESC, ordinal) = 1"""

V["v_numbered"] = """
SELECT firmware_id, printf('func_%03d', n) AS func_id, n AS func_ordinal, name, printf('0x%08X', address) AS address, address AS address_int, size
FROM (SELECT *, row_number() OVER (PARTITION BY firmware_id ORDER BY address) AS n FROM v_dedup) """

V["v_line_table"] = """
SELECT 'fw' || user_id AS firmware_id, event_id AS ordinal, 4096 + 64 * (event_id // 5) + 4 * (user_id % 16) AS address,
  'main/' || (event_id % 997) || '.c' AS file, CAST(floor(value) AS BIGINT) AS line FROM events"""

V["v_line_last"] = """
SELECT firmware_id, address, arg_max(file, ordinal) AS file, arg_max(line, ordinal) AS line FROM v_line_table GROUP BY 1, 2"""

V["v_samples"] = """
SELECT DISTINCT firmware_id, func_id, unnest([address_int, address_int + greatest(4, size) // 2, address_int + greatest(0, greatest(4, size) - 4)]) AS address
FROM v_numbered"""

V["v_asof"] = """
SELECT s.firmware_id, s.func_id, s.address, l.file, l.line
FROM v_samples s ASOF LEFT JOIN v_line_last l ON s.firmware_id = l.firmware_id AND s.address >= l.address"""

V["v_span"] = """
SELECT n.*, b.file AS source_file, b.line_start, b.line_end, b.file IS NOT NULL AS has_source_mapping
FROM v_numbered n LEFT JOIN (
  SELECT * FROM (SELECT firmware_id, func_id, file, count(*) AS c, min(address) AS first, min(line) AS line_start, max(line) AS line_end
    FROM v_asof WHERE file IS NOT NULL AND line <> 0 GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY firmware_id, func_id ORDER BY c DESC, first) = 1) b USING (firmware_id, func_id)"""

V["v_files"] = """
SELECT source || '/' || doc_id || '.c' AS path, text FROM documents"""

V["v_file_lines"] = f"""
SELECT path, CAST(n AS BIGINT) AS line_no, t[n] AS text FROM (SELECT path, t, unnest(range(1, len(t) + 1)) AS n FROM (
  SELECT path, CASE WHEN ends_with(text, {NL}) THEN string_split(text, {NL})[1:-2] ELSE string_split(text, {NL}) END AS t FROM v_files WHERE text <> ''))"""

V["v_roots"] = """
SELECT 'fw' || s_suppkey AS firmware_id, ['src' || (s_suppkey % 20), 'src' || ((s_suppkey + 7) % 20), '/none'] AS roots FROM supplier"""

V["v_resolved"] = """
SELECT s.*, r.path AS resolved_source_path FROM v_span s LEFT JOIN (
  SELECT firmware_id, source_file, arg_min(c.path, c.p) AS path FROM (
    SELECT DISTINCT firmware_id, source_file, unnest([0, 1, 2, 3, 4, 5, 6]) AS p, unnest([source_file,
      roots[1] || '/' || source_file, roots[1] || '/' || split_part(source_file, '/', -1), roots[1] || '/' || source_file,
      roots[2] || '/' || source_file, roots[2] || '/' || split_part(source_file, '/', -1), roots[2] || '/' || source_file]) AS path
    FROM v_span JOIN v_roots USING (firmware_id) WHERE source_file IS NOT NULL) c
  JOIN (SELECT DISTINCT path FROM v_files) f ON c.path = f.path GROUP BY 1, 2) r USING (firmware_id, source_file)"""

V["v_disassembly"] = f"""
SELECT firmware_id, address, string_agg('call8 40081290 <' || {word('l_partkey * 7 + j * 3 + l_suppkey')} || '>', {NL} ORDER BY j) AS disassembly,
  count(*) AS n_lines, list_sort(list_distinct(list({word('l_partkey * 7 + j * 3 + l_suppkey')}))) AS syms
FROM (SELECT *, unnest(range(l_partkey % 6 + 1)) AS j FROM (SELECT DISTINCT firmware_id, address, l_partkey, l_suppkey FROM v_symbols)) GROUP BY 1, 2"""


# The functions as the jobs extract them, with features over them.
V["v_job_functions"] = f"""
SELECT firmware_id, func_id, func_ordinal, name, size, n_lines AS instructions, CAST([] AS VARCHAR[]) AS strings, 6.5::DOUBLE AS entropy, disassembly, syms,
  list_concat(a, list_filter(h, lambda t: NOT list_contains(a, t))) AS calls
FROM (SELECT n.*, d.syms, d.n_lines, d.disassembly,
    list_sort(list_distinct(list_concat(syms, list_concat(['40081290'], list_filter({strings(C.PLAIN_CALL_TOKENS)}, lambda t: contains(disassembly, t)))))) AS a,
    list_filter({strings(C.NAME_HINT_TOKENS)}, lambda t: contains(lower(name), t)) AS h
  FROM v_numbered n JOIN v_disassembly d ON n.firmware_id = d.firmware_id AND n.address_int = d.address)"""
_JOB_VIEWS = ("functions", "extended", "structural", "peripheral", "embedding", "rule_score")
for _v in _JOB_VIEWS[1:]:
    V[f"v_job_{_v}"] = re.sub(r"\bv_(" + "|".join(_JOB_VIEWS) + r")\b", r"v_job_\1", V[f"v_{_v}"])

V["v_job_manifest"] = """
SELECT 'fw' || s_suppkey AS firmware_id, s_suppkey AS seq, 'Board-' || s_suppkey AS stem, 'p' || (s_suppkey % 7) AS parent, s_suppkey % 5 <> 0 AS is_elf,
  CASE WHEN s_suppkey % 3 <> 1 THEN 'src' || (s_suppkey % 20) END AS own FROM supplier"""

V["v_job_images"] = """
SELECT firmware_id, stem, coalesce(own, theirs) AS root, CASE WHEN NOT is_elf THEN 'not an ELF file'
  WHEN firmware_id NOT IN (SELECT firmware_id FROM v_sections WHERE starts_with(name, '.debug_')) THEN 'no debug sections'
  WHEN coalesce(own, theirs) IS NULL THEN 'no source folder' END AS reason
FROM v_job_manifest LEFT JOIN (SELECT parent, arg_max(own, seq) AS theirs FROM v_job_manifest WHERE own IS NOT NULL GROUP BY 1) USING (parent)"""

V["v_job_roots"] = """
SELECT firmware_id, [root] AS roots FROM v_job_images WHERE reason IS NULL"""
V["v_job_resolved"] = V["v_resolved"].replace("v_roots", "v_job_roots")

V["v_job_sheet"] = f"""
SELECT row_idx, CASE WHEN row_idx % 2 = 1 THEN {word('part')} || '_' || part || '_' || (row_idx // 7 % 5 + 1) END AS function_name,
  CASE WHEN row_idx % 2 = 0 THEN part * 64 + 4096 END AS address, CASE WHEN row_idx % 3 <> 1 THEN 'BOARD-' || (cust % 100) END AS firmware,
  CASE WHEN row_idx % 5 = 0 THEN ['CWE-416'] WHEN row_idx % 5 = 1 THEN ['CWE-120', 'CWE-362'] WHEN row_idx % 4 = 0 THEN ['CWE-UNKNOWN'] ELSE CAST([] AS VARCHAR[]) END AS cwe
FROM (SELECT o_orderkey AS row_idx, o_orderkey % 997 + 1 AS part, o_custkey AS cust FROM orders)"""

V["v_job_taken"] = """
SELECT firmware_id, func_id, arg_min(cwe, row_idx) AS cwe FROM (
  SELECT n.firmware_id, n.func_id, m.stem, r.* FROM v_numbered n JOIN v_job_images m USING (firmware_id) JOIN v_job_sheet r ON r.address = n.address_int
  UNION ALL SELECT n.firmware_id, n.func_id, m.stem, r.* FROM v_numbered n JOIN v_job_images m USING (firmware_id) JOIN v_job_sheet r ON r.function_name = n.name)
WHERE firmware IS NULL OR contains(lower(stem), lower(firmware)) OR contains(lower(firmware), lower(stem)) GROUP BY 1, 2"""

V["v_job_answers"] = f"""
SELECT firmware_id, func_id, list_filter(CASE WHEN k % 3 = 0 THEN ['CWE-787', 'CWE-79'] WHEN k % 3 = 2 THEN ['CWE-190'] ELSE CAST([] AS VARCHAR[]) END,
  lambda x: list_contains({strings([r[0] for r in C.DEFAULT_RULES])}, x)) AS ids
FROM (SELECT 'fw' || (o_custkey % 100) AS firmware_id, printf('func_%03d', o_orderkey % 499 + 1) AS func_id, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)"""


def job_labels(resolved: str) -> str:
    """firmware_id, func_id, cwe: what the rules find in the functions and their source lines."""
    return f"""SELECT h.firmware_id, h.func_id, coalesce(list_sort(list(r.cwe_id) FILTER (len(list_filter(r.broad, lambda t: contains(h.hay, t))) > 0)), CAST([] AS VARCHAR[])) AS cwe
FROM (SELECT e.firmware_id, e.func_id, lower(e.name || ' ' || array_to_string(e.calls, ' ') || '  ' || e.disassembly || coalesce(' ' || s.lines, '')) AS hay
  FROM v_job_functions e LEFT JOIN (SELECT r.firmware_id, r.func_id, string_agg(l.text, ' ' ORDER BY l.line_no) AS lines FROM {resolved} r JOIN v_file_lines l
    ON l.path = r.resolved_source_path AND l.line_no BETWEEN greatest(1, greatest(1, r.line_start) - 8) AND greatest(greatest(1, r.line_start), r.line_end) + 8
    GROUP BY 1, 2) s USING (firmware_id, func_id)) h, v_rule_tokens r GROUP BY 1, 2"""


V["v_job_matches"] = job_labels("v_resolved")
V["v_gated_matches"] = job_labels("v_job_resolved")
V["v_gated_labels"] = """
SELECT m.firmware_id, m.func_id, CASE WHEN len(t.cwe) > 0 THEN t.cwe WHEN len(a.ids) > 0 THEN a.ids ELSE m.cwe END AS cwe
FROM v_gated_matches m JOIN v_job_roots USING (firmware_id) LEFT JOIN v_job_taken t USING (firmware_id, func_id) LEFT JOIN v_job_answers a USING (firmware_id, func_id)"""


def boosted(labels: str) -> str:
    """firmware_id, func_id, cwe, score of the jobs, from a view of label lists."""
    return f"""SELECT firmware_id, func_id, cwe, CASE WHEN len(cwe) > 0 THEN least(score + 0.3::DOUBLE, 0.95::DOUBLE) ELSE score END AS score
FROM v_job_rule_score JOIN {labels} USING (firmware_id, func_id)"""


V["v_job_scores"] = boosted("v_job_matches")
V["v_gated_scores"] = boosted("v_gated_labels")
V["v_job_shown"] = """
SELECT DISTINCT r.firmware_id, r.func_id FROM v_resolved r JOIN v_file_lines l
  ON l.path = r.resolved_source_path AND l.line_no BETWEEN greatest(1, greatest(1, r.line_start) - 8) AND greatest(greatest(1, r.line_start), r.line_end) + 8"""


def with_views(sql: str) -> str:
    """The statement with every view it needs, in order, in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+\b", text):
            if name in V and name not in order:
                need(V[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({V[n].strip()})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
