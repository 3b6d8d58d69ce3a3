"""Calls, features, scores and findings over the functions made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import plain, query
from checks.view_sql import NL, matched, strings
from funcrisk import constants as C
from funcrisk.functions import calls as K
from funcrisk.functions import features as X
from funcrisk.functions.answers import parse_cwe_answer
from funcrisk.functions.risk import evidence, risk_tier
from funcrisk.functions.text import signal_tokens
from funcrisk.operators import findings as R
from funcrisk.operators import labels as L
from funcrisk.operators import matrix as M
from funcrisk.operators import model as T
from funcrisk.operators import rules as U
from funcrisk.operators import split as H
from funcrisk.operators import symbols as Y
from funcrisk.operators.scoring import rule_score
from funcrisk.sources.catalog import default_catalog

ID = "firmware_id, func_id"
INT = lambda cols: ", ".join(cols)


def rounded(cols) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in cols)


S_FLOATS = ["bytes_per_instruction", "avg_string_length", "entropy"]
S_COLS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" if c in S_FLOATS else c for c in X.STRUCTURAL)
E_COLS = rounded(X.EMBEDDING)


# Calls and disassembly text.

@query("F1", f"SELECT {ID}, array_to_string(asm_calls, ',') AS calls FROM v_calls")
def calls_from_asm(spark, sf):
    return plain(V.v_asm(spark, sf).select(*C.KEY, K.calls_from_asm(F.col("disassembly")).alias("calls")))


@query("F2", f"""SELECT {ID}, array_to_string(list_filter({strings(C.NAME_HINT_TOKENS)}, lambda t: contains(lower(name), t)), ',') AS hints FROM v_functions""")
def name_hints(spark, sf):
    return plain(V.keyed_documents(spark, sf).select(*C.KEY, K.name_hints(F.col("name")).alias("hints")))


@query("F3", f"""SELECT {ID}, CAST(regexp_matches(lower(disassembly), '{"|".join(C.DANGER_LABEL_TOKENS)}') AS BIGINT) AS danger FROM v_asm""")
def asm_danger_label(spark, sf):
    return plain(V.v_asm(spark, sf).select(*C.KEY, K.asm_danger_label(F.col("disassembly")).alias("danger")))


@query("U2", f"SELECT {ID}, array_to_string(calls, ',') AS calls FROM v_functions")
def all_calls(spark, sf):
    return plain(V.v_asm(spark, sf).select(*C.KEY, K.all_calls(F.col("disassembly"), F.col("name")).alias("calls")))


@query("U3", f"SELECT {ID}, array_to_string(c, ',') AS calls FROM v_extended")
def extend_calls(spark, sf):
    return plain(V.v_functions(spark, sf).select(*C.KEY, K.extend_calls(F.col("calls"), F.col("disassembly")).alias("calls")))


@query("A12", f"SELECT {ID}, instructions FROM v_asm")
def instruction_count(spark, sf):
    return plain(V.v_asm(spark, sf).select(*C.KEY, K.instruction_count(F.col("disassembly")).alias("instructions")))


@query("A12", f"SELECT {ID}, instructions FROM v_asm")
def instruction_counts_of_lines(spark, sf):
    return plain(Y.instruction_counts(V.v_asm_lines(spark, sf)))


def _cap_sql(n: int) -> str:
    return f"""SELECT {ID}, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY line_no) AS r FROM v_asm_lines) WHERE r <= {n}
    UNION ALL SELECT {ID}, max(line_no) + 1, '... (' || (count(*) - {n}) || ' more lines truncated)' FROM v_asm_lines GROUP BY 1, 2 HAVING count(*) > {n}"""


@query("W2", _cap_sql(260))
def cap_lines(spark, sf):
    return plain(Y.cap_lines(V.v_asm_lines(spark, sf)))


@query("W2", _cap_sql(12))
def cap_lines_at_twelve(spark, sf):
    return plain(Y.cap_lines(V.v_asm_lines(spark, sf), 12))


@query("W2", f"""SELECT {ID}, md5(CASE WHEN n > 12 THEN array_to_string(l[1:12], {NL}) || {NL} || '... (' || (n - 12) || ' more lines truncated)' ELSE disassembly END) AS text_md5,
  md5(CASE WHEN n > 8 THEN array_to_string(l[1:8], {NL}) || {NL} || {NL} || '... (' || (n - 8) || ' more lines omitted)' ELSE disassembly END) AS report_md5
  FROM (SELECT *, len(l) AS n FROM (SELECT *, string_split(CASE WHEN ends_with(disassembly, {NL}) THEN left(disassembly, length(disassembly) - 1) ELSE disassembly END, {NL}) AS l FROM v_asm))""")
def cap_asm_text(spark, sf):
    asm = F.col("disassembly")
    return V.v_asm(spark, sf).select(
        *C.KEY, F.md5(K.cap_asm_text(asm, 12).cast("binary")).alias("text_md5"),
        F.md5(K.omit_asm_text(asm, 8).cast("binary")).alias("report_md5"),
    )


# Features.

@query("F4", f"SELECT {ID}, {S_COLS} FROM v_structural")
def structural_features(spark, sf):
    return plain(M.structural_features(V.v_functions(spark, sf)))


@query("F5", f"""SELECT {ID}, round(least(3.5::DOUBLE + 0.5 * least(size / 1000.0::DOUBLE, 2) + 0.3 * least(instructions / 100.0::DOUBLE, 2) + 0.2 * least(len(calls) / 10.0::DOUBLE, 1), 8), 6) + 0.0 AS entropy FROM v_functions""")
def entropy_estimate(spark, sf):
    functions = V.v_functions(spark, sf).withColumn("entropy", F.lit(None).cast("double"))
    return plain(M.structural_features(functions).select(*C.KEY, "entropy"))


@query("F6", f"SELECT {ID}, {INT(X.PERIPHERAL)} FROM v_peripheral")
def peripheral_features(spark, sf):
    return plain(M.peripheral_features(V.v_functions(spark, sf)))


@query("F7", f"SELECT {ID}, {rounded([c for c in X.EMBEDDING if not c.startswith('embedding')])} FROM v_embedding")
def pattern_scores(spark, sf):
    columns = [c for c in X.EMBEDDING if not c.startswith("embedding")]
    return plain(M.embedding_features(V.v_functions(spark, sf)).select(*C.KEY, *columns))


@query("F8", f"SELECT {ID}, {rounded([c for c in X.EMBEDDING if c.startswith('embedding')])} FROM v_embedding")
def name_embedding(spark, sf):
    columns = [c for c in X.EMBEDDING if c.startswith("embedding")]
    return plain(M.embedding_features(V.v_functions(spark, sf)).select(*C.KEY, *columns))


LABEL_COLS = """CAST(list_contains(cwe, 'CWE-120') AS BIGINT) AS "CWE-120", CAST(list_contains(cwe, 'CWE-787') AS BIGINT) AS "CWE-787",
  CAST(list_contains(cwe, 'CWE-79') AS BIGINT) AS "CWE-79", len(cwe)::BIGINT AS num_cwe_labels, CAST(len(cwe) > 0 AS BIGINT) AS has_cwe"""
IDS = ["CWE-120", "CWE-787", "CWE-79"]
PRODUCTS = """round(entropy * num_dangerous_calls, 6) + 0.0 AS entropy_dangerous, cyclomatic_complexity * num_dangerous_calls AS complexity_dangerous"""
CWE_PRODUCTS = ", ".join(
    (f"round(b.h * {c}, 6) + 0.0 AS {n}" if c == "entropy" else f"b.h * {c} AS {n}")
    for n, c in {"cwe_entropy": "entropy", "cwe_dangerous": "num_dangerous_calls", "cwe_complexity": "cyclomatic_complexity",
                 "cwe_size": "function_size", "cwe_instructions": "instruction_count", "cwe_calls": "num_calls"}.items()
)
HAS = f"(SELECT {ID}, CAST(len(cwe) > 0 AS BIGINT) AS h FROM v_cwe) b USING ({ID})"


@query("F9", f"SELECT {ID}, {CWE_PRODUCTS}, {PRODUCTS} FROM v_structural JOIN {HAS}")
def interactions(spark, sf):
    matrix = M.add_labels(M.structural_features(V.v_functions(spark, sf)), V.v_cwe(spark, sf), IDS)
    return plain(matrix.select(*C.KEY, *X.interaction_columns()))


ALL_FEATURES = f"{S_COLS}, {INT(X.PERIPHERAL)}, {E_COLS}"
_JOINED = f"v_structural JOIN v_peripheral USING ({ID}) JOIN v_embedding USING ({ID}) JOIN v_cwe USING ({ID}) JOIN {HAS}"


@query("J11", f"SELECT {ID}, {ALL_FEATURES}, {LABEL_COLS}, {CWE_PRODUCTS}, {PRODUCTS} FROM {_JOINED}")
def feature_matrix(spark, sf):
    functions = V.v_functions(spark, sf)
    return plain(M.matrix_from_functions(functions, V.v_cwe(spark, sf), IDS))


_GAPS = {"p": "doc_id % 4 <> 1", "e": "doc_id % 6 <> 2"}


@query("J11", f"""SELECT coalesce(s.firmware_id, p.firmware_id) AS firmware_id, coalesce(s.func_id, p.func_id) AS func_id,
  coalesce(num_calls, 0) AS num_calls, round(coalesce(entropy, 0.0), 6) + 0.0 AS entropy, coalesce(io_intensity, 0) AS io_intensity,
  round(coalesce(similarity_injection, 0.0), 6) + 0.0 AS similarity_injection
  FROM (SELECT s.* FROM v_structural s JOIN v_docs d USING ({ID}) WHERE d.lang <> 'fr') s
  FULL JOIN (SELECT p.*, v.similarity_injection FROM v_peripheral p JOIN v_docs d USING ({ID})
     LEFT JOIN (SELECT e.* FROM v_embedding e JOIN v_docs x USING ({ID}) WHERE x.lang <> 'de') v USING ({ID})) p USING ({ID})""")
def merge_families(spark, sf):
    """Three frames from different loads, two of which lack the functions of one language."""
    functions = V.v_functions(spark, sf)
    s = M.structural_features(functions.filter(~F.endswith("name", F.lit("_fr")))).select(*C.KEY, "num_calls", "entropy")
    p = M.peripheral_features(functions).select(*C.KEY, "io_intensity")
    e = M.embedding_features(functions.filter(~F.endswith("name", F.lit("_de")))).select(*C.KEY, "similarity_injection")
    return plain(M.feature_matrix(s, p, e))


@query("P5", f"SELECT {ID}, {ALL_FEATURES}, {PRODUCTS} FROM {_JOINED}")
def drop_label_columns(spark, sf):
    matrix = M.matrix_from_functions(V.v_functions(spark, sf), V.v_cwe(spark, sf), IDS)
    return plain(M.drop_label_columns(matrix))


@query("P6", f"SELECT {ID}, round(entropy, 6) + 0.0 AS entropy, 0::BIGINT AS not_there, num_calls FROM v_structural")
def align_features(spark, sf):
    return plain(M.align_features(M.structural_features(V.v_functions(spark, sf)), ["entropy", "not_there", "num_calls"]))


@query("U1", f"""SELECT {ID}, num_calls, CASE WHEN lang = 'en' THEN io_intensity END AS io_intensity
  FROM v_structural JOIN v_peripheral USING ({ID}) JOIN v_docs USING ({ID})""")
def union_frames(spark, sf):
    """Two loads with different columns."""
    functions = V.v_functions(spark, sf)
    english = F.endswith("name", F.lit("_en"))
    a = M.wide_features(functions.filter(english), ("structural", "peripheral")).select(*C.KEY, "num_calls", "io_intensity")
    b = M.structural_features(functions.filter(~english)).select(*C.KEY, "num_calls")
    return plain(M.union_frames(a, b))


@query("W6", "SELECT source AS firmware_id, lang AS func_id, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1, 2")
def keep_first(spark, sf):
    rows = V.table(spark, sf, "documents").select(F.col("source").alias("firmware_id"), F.col("lang").alias("func_id"), "doc_id", "n_chars")
    return plain(M.keep_first(rows, ["doc_id"]))


# Rules and answers.

@query("F10", f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ',')) AS tokens FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[,;|\\s]+'), lambda t: length(t) >= 3) AS t FROM documents)")
def signal_token_lists(spark, sf):
    tokens = V.table(spark, sf, "documents").select("doc_id", signal_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", ",").cast("binary")).alias("tokens"))


@query("F11", f"SELECT {ID}, length(cut)::BIGINT AS n, md5(cut) AS haystack_md5, md5(whole) AS whole_md5 FROM v_haystack")
def haystack(spark, sf):
    functions = V.v_functions(spark, sf).drop("source_snippet")
    both = U.with_haystack(functions, 400).withColumnRenamed("haystack", "cut")
    both = U.with_haystack(both, None)
    return plain(both.select(*C.KEY, F.length("cut").alias("n"), F.md5(F.col("cut").cast("binary")).alias("haystack_md5"),
                             F.md5(F.col("haystack").cast("binary")).alias("whole_md5")))


@query("J6", f"SELECT {ID}, array_to_string(ids, ',') AS hints FROM v_hints")
def signal_hints(spark, sf):
    return plain(U.signal_hints(V.v_functions(spark, sf), default_catalog(spark)).select(*C.KEY, "hints"))


@query("J6", f"SELECT {ID}, array_to_string(ids, ',') AS hints FROM ({matched('signal', 'cut')})")
def signal_hints_limited(spark, sf):
    """The limit as a feature: the first 400 characters of the disassembly."""
    return plain(U.signal_hints(V.v_functions(spark, sf), default_catalog(spark), 400).select(*C.KEY, "hints"))


@query("J6", f"SELECT {ID}, array_to_string(ids, ',') AS hints FROM ({matched('signal', 'whole')})")
def signal_hints_whole_text(spark, sf):
    return plain(U.signal_hints(V.v_functions(spark, sf), default_catalog(spark), None).select(*C.KEY, "hints"))


@query("J6", f"SELECT {ID}, array_to_string(ids, ',') AS hints FROM ({matched('signal', 'cut')})")
def signal_hints_limited(spark, sf):
    """The limit as a feature: the first 400 characters of the disassembly."""
    return plain(U.signal_hints(V.v_functions(spark, sf), default_catalog(spark), 400).select(*C.KEY, "hints"))


@query("J6", f"SELECT {ID}, array_to_string(ids, ',') AS hints FROM ({matched('signal', 'whole')})")
def signal_hints_large_catalog(spark, sf):
    """The way taken when a catalog is too large to ride along."""
    rows = U.with_haystack(V.v_functions(spark, sf), None).select(*C.KEY, "haystack")
    return plain(U.rule_matches(rows, U.signal_rules(default_catalog(spark)), "hints", method="index").select(*C.KEY, "hints"))


@query("J7", f"SELECT {ID}, array_to_string(ids, ',') AS matches FROM v_matches")
def signal_matches(spark, sf):
    return plain(U.signal_matches(V.v_functions(spark, sf), default_catalog(spark)).select(*C.KEY, "matches"))


_BLOCK = f"""(SELECT 'Rules, by id. Compare each with what the function calls, its strings and its code; answer with no other ids.' || {NL} || {NL} ||
  string_agg('- ' || cwe_id || ' ' || cwe_name || {NL} || '  Rule: ' || llm_labeling_rule || {NL} || '  Signals: ' || detection_signals, {NL} ORDER BY cwe_id) || {NL} || {NL} || 'Allowed IDs: ' || string_agg(cwe_id, ', ' ORDER BY cwe_id) FROM v_rules)"""


@query("F15", f"""SELECT {ID}, length(prompt)::BIGINT AS n, md5(prompt) AS prompt_md5 FROM (SELECT {ID}, 'Which of the weaknesses below does this firmware function show?' || {NL} || {NL} || {_BLOCK} ||
  CASE WHEN len(ids) > 0 THEN {NL} || 'Consider: ' || array_to_string(ids, ', ') || {NL} ELSE '' END || {NL} || 'Function: ' || name || {NL} || 'Calls: ' ||
  CASE WHEN len(calls) > 0 THEN array_to_string(calls, ', ') ELSE '(none)' END || {NL} || 'Strings: ' || CASE WHEN len(strings) > 0 THEN array_to_string(strings, ', ') ELSE '(none)' END ||
  CASE WHEN source_file IS NOT NULL THEN {NL} || 'Source: ' || source_file || ' lines ' || line_start || '-' || line_end ELSE '' END || {NL} || {NL} || 'Disassembly:' || {NL} ||
  CASE WHEN disassembly <> '' THEN disassembly ELSE '(none)' END || {NL} || {NL} || 'Allowed: ' || (SELECT string_agg(cwe_id, ', ' ORDER BY rule_ordinal) FROM v_rules) || {NL} || 'Answer with a JSON array of ids and nothing else.' AS prompt
  FROM v_functions JOIN v_hints USING ({ID}))""")
def build_prompts(spark, sf):
    rows = U.build_prompts(V.v_functions(spark, sf), default_catalog(spark))
    return plain(rows.select(*C.KEY, F.length("prompt").alias("n"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5")))


@query("F16", f"""SELECT {ID}, array_to_string(ids, ',') AS free, array_to_string(list_filter(ids, lambda x: x IN (SELECT cwe_id FROM v_rules)), ',') AS allowed FROM v_parsed"""
       .replace("x IN (SELECT cwe_id FROM v_rules)", f"list_contains({strings([r[0] for r in C.DEFAULT_RULES])}, x)"))
def parse_cwe_answer_lists(spark, sf):
    rows = V.v_responses(spark, sf)
    return plain(rows.select(*C.KEY, parse_cwe_answer(F.col("answer")).alias("free"),
                             parse_cwe_answer(F.col("answer"), [r[0] for r in C.DEFAULT_RULES]).alias("allowed")))


# Labels.

@query("A3", f"SELECT {ID}, {LABEL_COLS} FROM v_cwe")
def cwe_onehot(spark, sf):
    return plain(L.cwe_onehot(V.v_cwe(spark, sf), IDS))


@query("A3", f"""SELECT {ID}, array_to_string(list_transform(list_filter(range(len(d.ids)), lambda i: list_contains(cwe, d.ids[i + 1])), lambda i: CAST(i AS VARCHAR)), ',') AS ones,
  len(cwe)::BIGINT AS num_cwe_labels, CAST(len(cwe) > 0 AS BIGINT) AS has_cwe
  FROM v_cwe, (SELECT list(c ORDER BY c) AS ids FROM (SELECT DISTINCT unnest(cwe) AS c FROM v_cwe)) d""")
def cwe_vectors(spark, sf):
    """All ids in use, as positions in a dictionary table."""
    labels = V.v_cwe(spark, sf)
    rows = L.cwe_vectors(labels, L.cwe_dictionary(labels))
    return plain(rows.select(*C.KEY, F.col("cwe_positions").cast("array<string>").alias("ones"), "num_cwe_labels", "has_cwe"))


@query("A3", f"SELECT {ID}, unnest(cwe) AS cwe FROM v_cwe")
def cwe_long(spark, sf):
    return plain(L.cwe_long(V.v_cwe(spark, sf)))


@query("A4", f"SELECT {ID}, CAST(len(cwe) > 0 AS BIGINT) AS label FROM v_cwe")
def binary_labels(spark, sf):
    return plain(L.binary_labels(V.keyed_documents(spark, sf), V.v_cwe(spark, sf)))


_FW = "(r.firmware IS NULL OR contains(lower(f.firmware_id), lower(r.firmware)) OR contains(lower(r.firmware), lower(f.firmware_id)))"
_LINE = """(lower(split_part(f.source_file, '/', -1)) = lower(split_part(r.source_file, '/', -1))
   AND (r.line BETWEEN f.line_start AND f.line_end OR abs(r.line - f.line_start) <= 2))"""


@query("J8", f"""SELECT f.firmware_id, f.func_ordinal, f.func_id, count(*) FILTER (r.func_id = f.func_id) AS by_id, count(*) FILTER (r.function_name = f.name) AS by_name,
  count(*) FILTER (r.address = f.address_int) AS by_addr, count(*) FILTER ({_LINE}) AS by_line, min(r.row_idx) AS first_row
  FROM v_functions f JOIN v_label_rows r ON {_FW} AND (r.func_id = f.func_id OR r.function_name = f.name OR r.address = f.address_int OR {_LINE}) GROUP BY 1, 2, 3""")
def label_candidates(spark, sf):
    functions = V.v_functions(spark, sf)
    return plain(L.label_candidates(functions, V.v_label_rows(spark, sf, all_keys=True)))


_SHEET = f"""(SELECT f.firmware_id, f.func_id, r.row_idx, r.cwe_list AS cwe FROM
  (SELECT firmware_id, func_id, name, row_number() OVER (PARTITION BY firmware_id, name ORDER BY func_ordinal) AS n FROM v_docs) f
  JOIN (SELECT i.firmware_id, r.*, row_number() OVER (PARTITION BY i.firmware_id, r.function_name ORDER BY r.row_idx) AS n
    FROM v_label_rows r JOIN (SELECT DISTINCT source AS firmware_id FROM documents) i
    ON r.firmware IS NULL OR contains(i.firmware_id, r.firmware) OR contains(r.firmware, i.firmware_id)) r
  ON f.firmware_id = r.firmware_id AND f.name = r.function_name AND f.n = r.n)"""


@query("J9", f"SELECT {ID}, row_idx, array_to_string(cwe, ',') AS cwe FROM {_SHEET}")
def assign_labels(spark, sf):
    return plain(L.assign_labels(V.v_functions(spark, sf), V.v_label_rows(spark, sf)))


# The functions of an image one after the other: each takes the lowest of its rows that none before it took.
@query("J9", f"""WITH RECURSIVE c AS (SELECT f.firmware_id, f.func_ordinal, f.func_id, list(DISTINCT r.row_idx ORDER BY r.row_idx) AS cand,
    row_number() OVER (PARTITION BY f.firmware_id ORDER BY f.func_ordinal) AS n
  FROM v_functions f JOIN v_label_rows r ON {_FW} AND (r.func_id = f.func_id OR r.function_name = f.name OR r.address = f.address_int OR {_LINE}) GROUP BY 1, 2, 3),
  w(firmware_id, func_id, n, used, got) AS (
    SELECT firmware_id, func_id, n, cand[:1], cand[1] FROM c WHERE n = 1 UNION ALL
    SELECT firmware_id, func_id, n, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
      SELECT c.firmware_id, c.func_id, c.n, w.used, list_filter(c.cand, lambda x: NOT list_contains(w.used, x))[1] AS got
      FROM w JOIN c ON c.firmware_id = w.firmware_id AND c.n = w.n + 1))
  SELECT w.firmware_id, w.func_id, w.got AS row_idx, array_to_string(r.cwe_list, ',') AS cwe FROM w JOIN v_label_rows r ON r.row_idx = w.got""")
def assign_labels_all_keys(spark, sf):
    """Rows that carry several keys at once, so that functions compete for rows over several keys."""
    return plain(L.assign_labels(V.v_functions(spark, sf), V.v_label_rows(spark, sf, all_keys=True)))


@query("J10", f"SELECT {ID} FROM v_docs ANTI JOIN (SELECT * FROM {_SHEET} WHERE len(cwe) > 0) USING ({ID})")
def label_gaps(spark, sf):
    sheet = L.assign_labels(V.v_functions(spark, sf), V.v_label_rows(spark, sf))
    return plain(L.label_gaps(V.keyed_documents(spark, sf).select(*C.KEY), sheet))


_AUTO = f"""(SELECT {ID}, answer, p, CASE WHEN len(p) > 0 THEN p WHEN len(m) > 0 THEN m ELSE h END AS cwe FROM (
  SELECT {ID}, answer, list_filter(ids, lambda x: list_contains({strings([r[0] for r in C.DEFAULT_RULES])}, x)) AS p FROM v_parsed)
  JOIN (SELECT {ID}, ids AS m FROM v_matches) USING ({ID}) JOIN (SELECT {ID}, ids AS h FROM v_hints) USING ({ID}))"""


@query("J13", f"""SELECT {ID}, array_to_string(cwe, ',') AS cwe, md5(answer || CASE WHEN len(p) = 0 AND len(cwe) > 0
  THEN {NL} || '[catalog fallback: ' || array_to_string(cwe, ', ') || ']' ELSE '' END) AS raw_md5, 'llama3.2' AS model FROM {_AUTO}""")
def auto_labels(spark, sf):
    rows = L.auto_labels(V.v_functions(spark, sf), V.v_responses(spark, sf), default_catalog(spark))
    return plain(rows.select(*C.KEY, "cwe", F.md5(F.col("llm_trace.raw_response").cast("binary")).alias("raw_md5"),
                             F.col("llm_trace.model").alias("model")))


@query("J10", f"""SELECT {ID}, array_to_string(CASE WHEN len(s.cwe) > 0 THEN s.cwe ELSE a.cwe END, ',') AS cwe
  FROM v_docs LEFT JOIN {_SHEET} s USING ({ID}) JOIN {_AUTO} a USING ({ID})""")
def merge_labels(spark, sf):
    functions = V.v_functions(spark, sf)
    sheet = L.assign_labels(functions, V.v_label_rows(spark, sf))
    auto = L.auto_labels(L.label_gaps(functions, sheet), V.v_responses(spark, sf), default_catalog(spark))
    return plain(L.merge_labels(functions, sheet, auto))


# Scores and findings.

@query("W3", f"SELECT {ID}, round(score, 6) + 0.0 AS score FROM v_rule_score")
def rule_scores(spark, sf):
    return plain(rule_score(M.structural_features(V.v_functions(spark, sf))).select(*C.KEY, "score"))


@query("F14", f"SELECT {ID}, round(score, 6) + 0.0 AS score, array_to_string(cwe, ',') AS cwe, is_vulnerable FROM v_predictions")
def boost_and_flag_scores(spark, sf):
    return plain(V.v_predictions(spark, sf))


@query("M4", f"SELECT {ID}, round(score, 6) + 0.0 AS score, array_to_string(cwe, ',') AS cwe, score >= 0.4 AS is_vulnerable FROM v_predictions")
def predict_without_model(spark, sf):
    matrix = M.matrix_from_functions(V.v_functions(spark, sf), V.v_cwe(spark, sf), IDS)
    return plain(T.predict(matrix, V.v_cwe(spark, sf), threshold=0.4))


@query("F13", f"SELECT {ID}, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.7 THEN 'above_threshold' WHEN score >= 0.49 THEN 'medium' ELSE 'low' END AS tier FROM v_predictions")
def risk_tiers(spark, sf):
    return V.v_predictions(spark, sf).select(*C.KEY, risk_tier(F.col("score"), 0.7).alias("tier"))


def _evidence_sql() -> str:
    q = lambda s: s.replace("'", "''")
    lit = lambda s: f"'{q(s)}'"
    head, tail = C.EVIDENCE_DANGEROUS.split("%.0f")
    e1, e2 = C.EVIDENCE_ENTROPY.split("%.2f")
    c1, c2 = C.EVIDENCE_COMPLEXITY.split("%.1f")
    items = [f"CASE WHEN num_dangerous_calls > 0 THEN {lit(head)} || num_dangerous_calls || {lit(tail)} END"]
    items += [f"CASE WHEN has_{n} = 1 THEN {lit(C.EVIDENCE_SIGNAL.replace('%s', n))} END" for n in ("strcpy", "sprintf", "memcpy")]
    items += [
        f"CASE WHEN entropy > 7 THEN {lit(e1)} || printf('%.2f', entropy) || {lit(e2)} END",
        f"CASE WHEN cyclomatic_complexity > 12 THEN {lit(c1)} || cyclomatic_complexity || '.0' || {lit(c2)} END",
        f"CASE WHEN has_input_validation = 0 THEN {lit(C.EVIDENCE_VALIDATION)} END",
        f"CASE WHEN has_output_sanitization = 0 AND has_sprintf = 1 THEN {lit(C.EVIDENCE_SANITIZATION)} END",
    ]
    found = f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"
    return f"SELECT {ID}, len(e)::BIGINT AS n, array_to_string(e, '|') AS evidence FROM (SELECT {ID}, CASE WHEN len({found}) > 0 THEN {found} ELSE [{lit(C.EVIDENCE_DEFAULT)}] END AS e FROM v_structural)"


@query("F12", _evidence_sql())
def evidence_lists(spark, sf):
    rows = M.structural_features(V.v_functions(spark, sf)).select(*C.KEY, evidence().alias("e"))
    return plain(rows.select(*C.KEY, F.size("e").alias("n"), F.array_join("e", "|").alias("evidence")))


_RANKED = f"""(SELECT p.*, f.* EXCLUDE ({ID}), row_number() OVER (PARTITION BY {ID.split(',')[0]} ORDER BY (source_file IS NOT NULL) DESC, score DESC, func_ordinal) AS rank
  FROM v_predictions p JOIN v_functions f USING ({ID}))"""


@query("T1, J12", f"SELECT {ID}, rank, name, round(score, 6) + 0.0 AS score, is_vulnerable, source_file FROM {_RANKED}")
def rank_findings(spark, sf):
    ranked = R.rank_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf))
    return plain(ranked.select(*C.KEY, "rank", "name", "score", "is_vulnerable", "source_file"))


@query("T1", f"SELECT {ID}, rank, name FROM {_RANKED} WHERE rank <= 7")
def rank_findings_limited(spark, sf):
    ranked = R.rank_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf), 7)
    return plain(ranked.select(*C.KEY, "rank", "name"))


@query("P7", f"SELECT {ID}, md5(substr(disassembly, 1, 200)) AS asm_md5 FROM v_predictions JOIN v_functions USING ({ID})")
def to_findings_limited(spark, sf):
    rows = R.to_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf), 200)
    return plain(rows.select(*C.KEY, F.md5(F.col("disassembly").cast("binary")).alias("asm_md5")))


@query("P4", f"""SELECT {ID}, rank, name FROM (SELECT p.*, f.name, row_number() OVER (PARTITION BY firmware_id ORDER BY score DESC, func_ordinal) AS rank
  FROM v_predictions p JOIN v_functions f USING ({ID}) WHERE has_source_mapping)""")
def rank_findings_source_only(spark, sf):
    ranked = R.rank_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf), source_only=True)
    return plain(ranked.select(*C.KEY, "rank", "name"))


@query("P7", f"""SELECT {ID}, name, address, source_file, line_start, line_end, md5(disassembly) AS asm_md5, is_vulnerable
  FROM v_predictions JOIN v_functions USING ({ID})""")
def to_findings(spark, sf):
    rows = R.to_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf))
    return plain(rows.select(*C.KEY, "name", "address", "source_file", "line_start", "line_end",
                             F.md5(F.col("disassembly").cast("binary")).alias("asm_md5"), "is_vulnerable"))


@query("P8", f"""SELECT {ID}, printf('%.3f', score) AS score, CASE WHEN is_vulnerable THEN 'VULN' ELSE 'ok' END AS status, name, 'no' AS source,
  coalesce(substr(split_part(source_file, '/', -1), 1, 40), '—') AS file,
  coalesce(CASE WHEN line_end <> line_start THEN line_start || '-' || line_end ELSE CAST(line_start AS VARCHAR) END, '—') AS line,
  CASE WHEN len(cwe) > 0 THEN array_to_string(cwe[1:3], ', ') ELSE '—' END AS cwe FROM v_predictions JOIN v_functions USING ({ID})""")
def findings_grid(spark, sf):
    return R.findings_grid(R.to_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf)))


def _top(n: int, where: str = "TRUE") -> str:
    return f"""(SELECT {ID}, score, func_ordinal, row_number() OVER (PARTITION BY firmware_id ORDER BY score DESC, func_ordinal) AS rank
      FROM v_predictions JOIN v_functions USING ({ID}) WHERE {where} QUALIFY rank <= {n})"""


@query("T2", f"SELECT {ID}, round(score, 6) + 0.0 AS score, rank AS score_rank FROM {_top(25)}")
def top_by_score(spark, sf):
    findings = R.to_findings(V.v_predictions(spark, sf), V.v_functions(spark, sf))
    return plain(R.top_by_score(findings).select(*C.KEY, "score", "score_rank"))


@query("T3", f"SELECT {ID}, round(score, 6) + 0.0 AS score, rank FROM {_top(15, 'NOT is_vulnerable AND score >= 0.7 * 0.85')}")
def near_threshold(spark, sf):
    rows = V.v_predictions(spark, sf).join(V.keyed_documents(spark, sf).select(*C.KEY, "func_ordinal"), C.KEY)
    return plain(R.near_threshold(rows, 0.7).select(*C.KEY, "score", "rank"))


@query("T4", f"""SELECT {ID}, name, round(score, 6) + 0.0 AS score, address, size, instructions, array_to_string(calls, ', ') AS calls,
  array_to_string(strings, ', ') AS strings, array_to_string(cwe, ', ') AS cwe, evidence
  FROM v_predictions JOIN v_functions USING ({ID}) JOIN ({_evidence_sql()}) USING ({ID}) WHERE is_vulnerable""")
def flagged_detail(spark, sf):
    functions = V.v_functions(spark, sf)
    rows = R.flagged_detail(V.v_predictions(spark, sf), functions, M.structural_features(functions), 0.7)
    return plain(rows.withColumn("evidence", F.array_join("evidence", "|")).drop("threshold", "func_ordinal", "disassembly"))


_DESCRIBED = "CASE cwe " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.CWE_DESCRIPTIONS.items()) + " ELSE '' END"


@query("A5", f"SELECT firmware_id, cwe, functions, {_DESCRIBED} AS description FROM (SELECT firmware_id, cwe, count(*) AS functions FROM (SELECT firmware_id, unnest(cwe) AS cwe FROM v_predictions) GROUP BY 1, 2)")
def cwe_rollup(spark, sf):
    return plain(R.cwe_rollup(V.v_predictions(spark, sf)))


@query("A6", """SELECT firmware_id, cwe, functions, rank FROM (SELECT *, row_number() OVER (PARTITION BY firmware_id ORDER BY functions DESC, cwe) AS rank
  FROM (SELECT firmware_id, cwe, count(*) AS functions FROM (SELECT firmware_id, unnest(cwe) AS cwe FROM v_predictions) GROUP BY 1, 2)) WHERE rank <= 15""")
def top_cwe(spark, sf):
    return plain(R.top_cwe(V.v_predictions(spark, sf)))


_TIER = "CASE WHEN score >= 0.7::DOUBLE + 0.2::DOUBLE THEN 'high' WHEN score >= 0.7 THEN 'above_threshold' WHEN score >= 0.7::DOUBLE * 0.7::DOUBLE THEN 'medium' ELSE 'low' END"


@query("A7", f"SELECT {ID}, {_TIER} AS tier, list_position({strings(C.TIERS)}, {_TIER})::BIGINT AS tier_order, round(score, 6) + 0.0 AS score FROM v_predictions")
def tier_lists(spark, sf):
    rows = R.tier_lists(V.v_predictions(spark, sf), V.keyed_documents(spark, sf), 0.7)
    return plain(rows.drop("func_ordinal"))


@query("A7", f"SELECT firmware_id, {_TIER} AS tier, count(*) AS functions FROM v_predictions GROUP BY 1, 2")
def tier_counts(spark, sf):
    return plain(R.tier_counts(V.v_predictions(spark, sf), 0.7))


@query("A8", f"""SELECT firmware_id, count(*) AS functions_total, count(*) FILTER (has_source_mapping) AS functions_with_source, 0::BIGINT AS functions_with_snippet,
  count(*) FILTER (is_vulnerable) AS vulnerable_count FROM v_functions JOIN v_predictions USING ({ID}) GROUP BY 1""")
def analysis_summary(spark, sf):
    return plain(R.analysis_summary(V.v_functions(spark, sf), V.v_predictions(spark, sf)))


# Splits, weights and the rule model.

V_LABEL = f"(SELECT {ID}, CAST(len(cwe) > 0 AS BIGINT) AS label FROM v_cwe)"


def labels_of(spark, sf):
    return L.binary_labels(V.keyed_documents(spark, sf), V.v_cwe(spark, sf))


_HASH_SPLIT = "(SELECT firmware_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || firmware_id)) <= ceil(round(count(*) OVER () * 0.2, 9)) THEN 'validation' ELSE 'train' END AS split FROM (SELECT DISTINCT firmware_id FROM v_cwe))"


@query("W4", f"SELECT {ID}, label, split FROM {V_LABEL} JOIN {_HASH_SPLIT} USING (firmware_id)")
def split_by_firmware(spark, sf):
    return plain(H.split_by_firmware(labels_of(spark, sf)))


@query("W4", """SELECT firmware_id, CASE WHEN row_number() OVER (ORDER BY firmware_id) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.2)) THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT DISTINCT 'fw' || l_suppkey AS firmware_id FROM lineitem)""")
def split_tail(spark, sf):
    return plain(H.image_split(V.v_symbols(spark, sf), method="tail"))


@query("W4", f"SELECT {ID}, firmware_id AS image FROM v_docs")
def firmware_id_from_key(spark, sf):
    keys = V.keyed_documents(spark, sf).select(*C.KEY, F.concat_ws("_", *C.KEY).alias("k"))
    return keys.select(*C.KEY, H.firmware_id_from_key(F.col("k")).alias("image"))


@query("W5", f"""SELECT {ID}, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|one|' || k)) <= ceil(round(count(*) OVER (PARTITION BY label) * 0.2, 9)) THEN 'validation' ELSE 'train' END AS split, label
  FROM (SELECT 'one' AS firmware_id, firmware_id || func_id AS func_id, label, firmware_id || func_id AS k FROM {V_LABEL})""")
def split_single_image(spark, sf):
    one = labels_of(spark, sf).select(F.lit("one").alias("firmware_id"), F.concat("firmware_id", "func_id").alias("func_id"), "label")
    return plain(H.split_by_firmware(one).select(*C.KEY, "split", "label"))


@query("A9", f"""SELECT {ID}, label, round(CASE WHEN label = 1 THEN 5.0 * neg / pos ELSE 1.0 END::DOUBLE, 6) + 0.0 AS weight FROM {V_LABEL},
  (SELECT sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {V_LABEL})""")
def class_weights(spark, sf):
    return plain(T.class_weights(labels_of(spark, sf)))


@query("A10", f"""SELECT split, round(avg(CAST((score > 0.5) = (label = 1) AS DOUBLE)), 6) + 0.0 AS accuracy, count(*) AS samples
  FROM v_predictions JOIN {V_LABEL} USING ({ID}) JOIN {_HASH_SPLIT} USING (firmware_id) GROUP BY 1""")
def accuracy_metrics(spark, sf):
    split = H.split_by_firmware(labels_of(spark, sf))
    return plain(T.accuracy_metrics(V.v_predictions(spark, sf).select(*C.KEY, "score").join(split, C.KEY)))


@query("A13", f"SELECT split, count(DISTINCT firmware_id) AS firmwares, count(*) AS functions, sum(label)::BIGINT AS vulnerable FROM {V_LABEL} JOIN {_HASH_SPLIT} USING (firmware_id) GROUP BY 1")
def training_summary(spark, sf):
    from funcrisk.plans.jobs import training_summary as summary

    return plain(summary(H.split_by_firmware(labels_of(spark, sf))))


_FIT = [c for c in X.STRUCTURAL]
_UNION = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, CASE WHEN min({c}) < max({c}) THEN abs(corr({c}::DOUBLE, label::DOUBLE)) END AS r, avg({c}::DOUBLE) FILTER (label = 1) AS v, avg({c}::DOUBLE) FILTER (label = 0) AS s, avg({c}::DOUBLE) AS m, avg(label::DOUBLE) AS l FROM v_structural JOIN {V_LABEL} USING ({ID})"
    for i, c in enumerate(_FIT)
)
_RULES = f"(SELECT row_number() OVER (ORDER BY r DESC NULLS LAST, pos) AS rank, * FROM ({_UNION}) QUALIFY rank <= 10)"


@query("A11", f"SELECT rank, feature, round(r, 5) + 0.0 AS correlation, CASE WHEN rank <= 5 THEN round((v + s) / 2, 5) + 0.0 END AS threshold, round(m, 5) + 0.0 AS mean, round(l, 5) + 0.0 AS mean_label FROM {_RULES}")
def rule_table(spark, sf):
    train = M.structural_features(V.v_functions(spark, sf)).join(labels_of(spark, sf), C.KEY)
    return plain(T.rule_table(train), 5)


@query("A11", f"SELECT feature, round(m, 5) + 0.0 AS mean FROM ({_UNION})")
def feature_means(spark, sf):
    """The means of all features that a rule model keeps."""
    train = M.structural_features(V.v_functions(spark, sf)).join(labels_of(spark, sf), C.KEY)
    return plain(T.feature_moments(train).select("feature", "mean"), 5)


@query("M3", f"""SELECT {ID}, round(1 / (1 + exp(-total)), 6) + 0.0 AS score FROM (SELECT {ID}, sum(CASE WHEN x > t THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS total FROM
  (UNPIVOT (SELECT {ID}, {", ".join(f"{c}::DOUBLE AS {c}" for c in _FIT)} FROM v_structural) ON {", ".join(_FIT)} INTO NAME feature VALUE x)
  JOIN (SELECT feature, (v + s) / 2 AS t FROM {_RULES} WHERE rank <= 5) USING (feature) GROUP BY 1, 2)""")
def predict_rule_model(spark, sf):
    features = M.structural_features(V.v_functions(spark, sf))
    model = T.fit_rule_model(features.join(labels_of(spark, sf), C.KEY))
    return plain(T.predict_rule_model(features, model).select(*C.KEY, "score"))
