"""Sources, symbols, source mapping and the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as V
from checks.registry import plain, query
from checks.queries_functions import ALL_FEATURES, CWE_PRODUCTS, ID, IDS, PRODUCTS, S_COLS, labels_of
from checks.view_sql import NL, rule_total, strings
from funcrisk import constants as C
from funcrisk.config import Config
from funcrisk.operators import findings as R
from funcrisk.operators import matrix as M
from funcrisk.operators import model as T
from funcrisk.operators import rules as U
from funcrisk.operators import sourcemap as S
from funcrisk.operators import symbols as Y
from funcrisk.plans import jobs as J
from funcrisk.scale import cut_lineage, keep_table, shared_folder
from funcrisk.sources import catalog, datasets, files, label_sheet


# Sources and sinks.

@query("S1", """SELECT path, split_part(path, '/', -1) AS name, replace(split_part(path, '/', -1), '.elf', '') AS stem, split_part(path, '/', -2) AS parent,
  'web' AS source, octet_length(encode(c))::BIGINT AS size, md5(c) AS md5, sha256(c) AS sha256, page_id % 3 <> 0 AS is_elf, 'xtensa' AS architecture, 'little' AS endianness, 32::BIGINT AS bitness,
  sha256(path || '|' || sha256(c)) AS firmware_id
  FROM (SELECT *, '/fleet/p' || (page_id % 7) || '/img' || page_id || '.elf' AS path, CASE WHEN page_id % 3 <> 0 THEN chr(127) || 'ELF' || html ELSE html END AS c FROM pages)""")
def firmware_manifest(spark, sf):
    page = F.col("page_id")
    body = F.when(page % 3 != 0, F.concat(F.lit("\x7fELF"), F.col("html"))).otherwise(F.col("html"))
    rows = V.table(spark, sf, "pages").select(
        F.concat(V.text_of("/fleet/p", page % 7), V.text_of("/img", page), F.lit(".elf")).alias("path"),
        body.cast("binary").alias("content"),
    )
    return plain(files.firmware_manifest(rows, "web"))


_CATALOG = """(SELECT k AS rule_ordinal, CASE k % 6 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'CWE-' || k END AS cwe_id, p_name AS cwe_name,
  CASE WHEN k % 7 IN (1, 2) THEN FALSE ELSE TRUE END AS use_as_label,
  CASE k % 4 WHEN 0 THEN p_size WHEN 1 THEN 12 ELSE 100 END::BIGINT AS priority,
  replace(p_name, ' ', ', ') || '; ' || p_type || '|ab' AS detection_signals, 'Assign if ' || p_brand || ' is seen.' AS llm_labeling_rule
  FROM (SELECT *, p_partkey AS k FROM part))"""


@query("S2", f"SELECT * FROM {_CATALOG} WHERE cwe_id IS NOT NULL")
def load_catalog(spark, sf):
    rows = catalog.load_catalog(spark, V.v_raw_catalog(spark, sf), order="row no")
    return plain(rows.select("rule_ordinal", "cwe_id", "cwe_name", "use_as_label", "priority", "detection_signals", "llm_labeling_rule"))


@query("P3", f"SELECT cwe_id, priority FROM {_CATALOG} WHERE cwe_id IS NOT NULL AND use_as_label")
def labelable(spark, sf):
    rows = catalog.load_catalog(spark, V.v_raw_catalog(spark, sf), order="row no")
    return plain(U.labelable(rows).select("cwe_id", "priority"))


_SHEET_ROWS = """(SELECT k AS row_idx, 'fn_' || c AS function_name, o_orderstatus AS firmware,
  CASE k % 9 WHEN 0 THEN ['CWE-' || c] WHEN 1 THEN list_sort(list_distinct(['CWE-' || c, 'CWE-79'])) WHEN 2 THEN ['CWE-' || c]
    WHEN 6 THEN list_sort(list_distinct(['CWE-' || c, 'CWE-7'])) WHEN 8 THEN list_sort(['CWE-9', 'CWE-10']) ELSE CAST([] AS VARCHAR[]) END AS ids,
  CASE k % 8 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE WHEN 6 THEN FALSE WHEN 7 THEN TRUE END AS vulnerable,
  CASE k % 6 WHEN 0 THEN k WHEN 1 THEN k WHEN 3 THEN 5 WHEN 5 THEN 15 END::BIGINT AS address,
  CASE k % 4 WHEN 0 THEN o_custkey WHEN 3 THEN o_custkey END::BIGINT AS line
  FROM (SELECT *, o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c FROM orders))"""


@query("S3", f"""SELECT row_idx, function_name, firmware, array_to_string(CASE WHEN vulnerable AND len(ids) = 0 THEN ['CWE-UNKNOWN'] ELSE ids END, ',') AS cwe_list, vulnerable, address, line
  FROM {_SHEET_ROWS} WHERE len(ids) > 0 OR vulnerable IS NOT NULL""")
def load_label_rows(spark, sf):
    kind, rows = label_sheet.load_sheet(spark, V.v_raw_labels(spark, sf), order="row no")
    assert kind == "labels"
    return plain(rows.select("row_idx", "function_name", "firmware", "cwe_list", "vulnerable", "address", "line"))


@query("S4", "SELECT path, line_no, text FROM v_file_lines")
def source_lines(spark, sf):
    return plain(files.source_lines(V.v_files(spark, sf)))


@query("S5", f"SELECT {ID}, {S_COLS}, CAST(len(cwe) > 0 AS BIGINT) AS label, array_to_string(cwe, ',') AS cwe FROM v_structural JOIN v_cwe USING ({ID})")
def dataset_round_trip(spark, sf):
    functions = V.v_functions(spark, sf)
    folder = shared_folder(spark, "dataset")
    datasets.save_dataset(M.structural_features(functions), labels_of(spark, sf), V.v_cwe(spark, sf), folder)
    matrix, labels, cwe = datasets.load_dataset(spark, folder)
    return plain(matrix.join(labels, C.KEY).join(cwe, C.KEY))


@query("S6", f"SELECT {ID}, name, round(score, 6) + 0.0 AS score, array_to_string(cwe, ',') AS cwe, source_file, line_start, md5(disassembly) AS asm_md5 FROM v_predictions JOIN v_functions USING ({ID})")
def findings_round_trip(spark, sf):
    predictions, functions = V.v_predictions(spark, sf), V.v_functions(spark, sf)
    findings = R.to_findings(predictions, functions)
    folder = shared_folder(spark, "findings")
    datasets.write_findings(findings, R.top_by_score(findings), R.analysis_summary(functions, predictions), folder)
    back = datasets.read_findings(spark, folder, findings.schema)
    return plain(back.select(*C.KEY, "name", "score", "cwe", "source_file", "line_start",
                             F.md5(F.col("disassembly").cast("binary")).alias("asm_md5")))


# Symbols.

@query("P1", "SELECT firmware_id, address AS lo, address + size AS hi FROM v_sections WHERE name IN ('.text', '.flash.text', '.iram0.text') AND size > 0")
def code_ranges(spark, sf):
    return plain(Y.code_ranges(V.v_sections(spark, sf)))


_SYM = "firmware_id, ordinal, address, size, name"


@query("P2", f"SELECT {_SYM} FROM v_good_symbols")
def function_symbols(spark, sf):
    return plain(Y.function_symbols(V.v_symbols(spark, sf)).select(*_SYM.split(", ")))


@query("P9", """SELECT 'fw' || s_suppkey AS firmware_id, s_suppkey % 5 <> 0 AS is_elf,
  CASE WHEN s_suppkey % 5 = 0 THEN 'not an ELF file' WHEN s_suppkey % 2 <> 0 THEN 'no debug sections' END AS reason FROM supplier""")
def debug_images(spark, sf):
    return Y.debug_images(V.v_manifest(spark, sf), V.v_sections(spark, sf)).select("firmware_id", "is_elf", "reason")


def _in_code(spark, sf):
    ranges = Y.code_ranges(V.v_sections(spark, sf))
    return Y.symbols_in_code(Y.function_symbols(V.v_symbols(spark, sf)), ranges)


@query("J1", f"SELECT {_SYM} FROM v_code_symbols")
def symbols_in_code(spark, sf):
    return plain(_in_code(spark, sf).select(*_SYM.split(", ")))


@query("A1", "SELECT firmware_id, address, size, name, ordinal FROM v_dedup")
def dedup_symbols(spark, sf):
    return plain(Y.dedup_symbols(_in_code(spark, sf)))


def _numbered(spark, sf):
    return Y.number_functions(Y.dedup_symbols(_in_code(spark, sf)))


def _kept(spark, sf):
    """The narrow function list, kept once as the jobs do before their lookups."""
    return cut_lineage(_numbered(spark, sf))


@query("W1", "SELECT firmware_id, func_id, func_ordinal, name, address, address_int, size FROM v_numbered")
def number_functions(spark, sf):
    return plain(_numbered(spark, sf))


# Source mapping.

@query("J2", "SELECT firmware_id, func_id, address, file, line FROM v_asof")
def asof_line(spark, sf):
    return plain(S.asof_line(S.sample_addresses(_kept(spark, sf)), V.v_line_table(spark, sf)).drop("sample"))


@query("J2", """SELECT c.firmware_id, c.ordinal, c.address, CASE WHEN c.address - l.address <= 128 THEN l.file END AS file, CASE WHEN c.address - l.address <= 128 THEN l.line END AS line
  FROM v_good_symbols c ASOF LEFT JOIN v_line_last l ON c.firmware_id = l.firmware_id AND c.address >= l.address""")
def asof_line_max_gap(spark, sf):
    """Every symbol row looked up, equal addresses and all, no further than 128 bytes back."""
    symbols = Y.function_symbols(V.v_symbols(spark, sf)).select("firmware_id", "ordinal", "address", "size")
    return plain(S.asof_line(symbols, V.v_line_table(spark, sf), max_gap=128).drop("size"))


@query("A2", f"SELECT {ID}, source_file, line_start, line_end, has_source_mapping FROM v_span")
def source_span(spark, sf):
    spans = S.source_span(_kept(spark, sf), V.v_line_table(spark, sf))
    return plain(spans.select(*C.KEY, "source_file", "line_start", "line_end", "has_source_mapping"))


def _resolved(spark, sf):
    spans = S.source_span(_kept(spark, sf), V.v_line_table(spark, sf))
    return S.resolve_source(spans, V.v_roots(spark, sf), V.v_files(spark, sf))


@query("J3", f"SELECT {ID}, source_file, resolved_source_path FROM v_resolved")
def resolve_source(spark, sf):
    return plain(_resolved(spark, sf).select(*C.KEY, "source_file", "resolved_source_path"))


@query("J4", f"""SELECT {ID}, highlight_start, highlight_end, array_to_string(list(l.line_no || ':' || l.text ORDER BY l.line_no) FILTER (l.line_no IS NOT NULL), {NL}) AS lines,
  count(*) FILTER (l.line_no BETWEEN highlight_start AND highlight_end) AS inside, CASE WHEN any_value(resolved_source_path) IS NULL THEN 'source_file_not_found' END AS error
  FROM (SELECT *, greatest(1, line_start) AS highlight_start, greatest(greatest(1, line_start), line_end) AS highlight_end FROM v_resolved WHERE source_file IS NOT NULL) s
  LEFT JOIN v_file_lines l ON l.path = s.resolved_source_path AND l.line_no BETWEEN greatest(1, highlight_start - 8) AND highlight_end + 8
  GROUP BY firmware_id, func_id, highlight_start, highlight_end""")
def snippets(spark, sf):
    rows = S.snippets(_resolved(spark, sf), V.v_source_files(spark, sf)).filter(F.col("source_snippet").isNotNull())
    s = F.col("source_snippet")
    lines = F.transform(s["lines"], lambda r: F.concat(r["number"].cast("string"), F.lit(":"), r["text"]))
    return plain(rows.select(
        *C.KEY, s["highlight_start"].alias("highlight_start"), s["highlight_end"].alias("highlight_end"),
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("lines"),
        F.size(F.filter(s["lines"], lambda r: r["in_function"])).alias("inside"), s["error"].alias("error"),
    ))


@query("J5", """SELECT firmware_id, root AS roots FROM (SELECT 'fw' || s_suppkey AS firmware_id, s_suppkey AS seq, 'p' || (s_suppkey % 7) AS parent,
    CASE WHEN s_suppkey % 3 = 0 THEN '/src/' || s_suppkey WHEN s_suppkey % 11 = 5 THEN NULL WHEN s_suppkey % 3 = 1 THEN '/lib/' || s_suppkey END AS own FROM supplier) m
  LEFT JOIN (SELECT parent, arg_max(own, seq) AS theirs FROM (SELECT s_suppkey AS seq, 'p' || (s_suppkey % 7) AS parent,
    CASE WHEN s_suppkey % 3 = 0 THEN '/src/' || s_suppkey WHEN s_suppkey % 11 = 5 THEN NULL WHEN s_suppkey % 3 = 1 THEN '/lib/' || s_suppkey END AS own FROM supplier) WHERE own IS NOT NULL GROUP BY 1) p USING (parent),
  LATERAL (SELECT coalesce(own, theirs) AS root)""")
def roots_for_images(spark, sf):
    images = V.v_manifest(spark, sf)
    root_map = S.build_root_map(images.select("path", "root", "seq"))
    return plain(S.roots_for_images(images, root_map).select("firmware_id", "roots"))


# Jobs.

_E1_FEATURES = f"""
v_e1 AS (SELECT n.*, d.syms, d.n_lines, d.disassembly FROM v_numbered n JOIN v_disassembly d ON n.firmware_id = d.firmware_id AND n.address_int = d.address),
v_e1_calls AS (SELECT *, list_sort(list_distinct(list_concat(syms, list_concat(['40081290'], list_filter({strings(C.PLAIN_CALL_TOKENS)}, lambda t: contains(disassembly, t)))))) AS a,
  list_filter({strings(C.NAME_HINT_TOKENS)}, lambda t: contains(lower(name), t)) AS h FROM v_e1),
v_e1_ext AS (SELECT *, list_concat(a, list_filter(h, lambda t: NOT list_contains(a, t))) AS calls FROM v_e1_calls),
v_e1_all AS (SELECT *, list_concat(calls, list_filter({strings(C.EXTENSION_TOKENS)}, lambda t: contains(disassembly, t) AND NOT list_contains(calls, t))) AS c FROM v_e1_ext),
v_e1_feat AS (SELECT firmware_id, func_id, CAST(list_contains(c, 'strcpy') AS BIGINT) AS has_strcpy, CAST(list_contains(c, 'sprintf') AS BIGINT) AS has_sprintf,
  CAST(list_contains(c, 'memcpy') AS BIGINT) AS has_memcpy, len(list_filter(c, lambda x: list_contains({strings(C.DANGEROUS_CALLS)}, x)))::BIGINT AS num_dangerous_calls,
  6.5::DOUBLE AS entropy, CAST(floor(1 + len(calls) * 0.5::DOUBLE + n_lines // 15) AS BIGINT) AS cyclomatic_complexity FROM v_e1_all),
v_e1_score AS (SELECT firmware_id, func_id, round(1 / (1 + exp(-2 * ({rule_total('v_e1_feat')}))), 6) AS base FROM v_e1_feat)"""


@query("E1", f"WITH {_E1_FEATURES} SELECT {ID}, num_dangerous_calls, cyclomatic_complexity, base AS score FROM v_e1_feat JOIN v_e1_score USING ({ID})")
def run_static_scores(spark, sf):
    """From raw symbols to rule scores before the label boost, for every image at once."""
    functions = J.extract_functions(V.job_tables(spark, sf))
    matrix = M.matrix_from_functions(functions)
    scored = T.score_matrix(matrix)
    return plain(matrix.select(*C.KEY, "num_dangerous_calls", "cyclomatic_complexity").join(scored, C.KEY))


@query("E1", f"""WITH {_E1_FEATURES},
v_e1_hay AS (SELECT e.firmware_id, e.func_id, lower(e.name || ' ' || array_to_string(e.calls, ' ') || '  ' || e.disassembly || coalesce(' ' || s.lines, '')) AS hay
  FROM v_e1_ext e LEFT JOIN (SELECT r.firmware_id, r.func_id, string_agg(l.text, ' ' ORDER BY l.line_no) AS lines FROM v_resolved r JOIN v_file_lines l
    ON l.path = r.resolved_source_path AND l.line_no BETWEEN greatest(1, greatest(1, r.line_start) - 8) AND greatest(greatest(1, r.line_start), r.line_end) + 8 GROUP BY 1, 2) s USING ({ID})),
v_e1_cwe AS (SELECT h.firmware_id, h.func_id, coalesce(list_sort(list(r.cwe_id) FILTER (len(list_filter(r.broad, lambda t: contains(h.hay, t))) > 0)), CAST([] AS VARCHAR[])) AS cwe
  FROM v_e1_hay h, v_rule_tokens r GROUP BY 1, 2)
SELECT {ID}, round(CASE WHEN len(cwe) > 0 THEN least(base + 0.3::DOUBLE, 0.95::DOUBLE) ELSE base END, 6) + 0.0 AS score, array_to_string(cwe, ',') AS cwe FROM v_e1_score JOIN v_e1_cwe USING ({ID})""")
def run_static(spark, sf):
    """The whole static stage: symbols, sources, labels by rules, features and scores."""
    scored = J.run_static(V.job_tables(spark, sf))
    return plain(scored.predictions.select(*C.KEY, "score", "cwe"))


@query("E1", "SELECT firmware_id, root AS roots, reason FROM v_job_images")
def admit_images(spark, sf):
    """The gate in front of the jobs: ELF, debug sections, source folder by key."""
    return plain(J.admit_images(V.gated_tables(spark, sf)).select("firmware_id", "roots", "reason"))


@query("E1, J8, J9, J10, J13", f"SELECT {ID}, round(score, 6) + 0.0 AS score, array_to_string(cwe, ',') AS cwe FROM v_gated_scores")
def run_static_labelled(spark, sf):
    """The static stage over usable images, with a label sheet that names images and with answers."""
    scored = J.run_static(V.gated_tables(spark, sf))
    return plain(scored.predictions.select(*C.KEY, "score", "cwe"))


@query("E2", """SELECT firmware_id, coalesce(reason, CASE WHEN n IS NULL THEN 'no functions' WHEN mapped = 0 THEN 'no function maps to source lines' END) AS why
  FROM v_job_images LEFT JOIN (SELECT firmware_id, count(*) AS n, count(*) FILTER (has_source_mapping) AS mapped FROM v_span GROUP BY 1) USING (firmware_id) WHERE why IS NOT NULL""")
def analyze_rejects(spark, sf):
    """Images that an analysis leaves out, with the reason."""
    return plain(J.analyze(V.gated_tables(spark, sf)).rejects.select("firmware_id", F.col("reason").alias("why")))


@query("E2", f"""WITH v_a AS (SELECT {ID}, n.name, s.score, s.cwe, n.source_file, n.line_start, n.line_end, h.func_id IS NOT NULL AS shown, n.func_ordinal, n.has_source_mapping
    FROM v_job_scores s JOIN v_span n USING ({ID}) LEFT JOIN (SELECT firmware_id, func_id FROM v_job_shown) h USING ({ID})
    WHERE firmware_id IN (SELECT firmware_id FROM v_span WHERE has_source_mapping)),
  v_b AS (SELECT firmware_id, count(*) AS functions_total, count(*) FILTER (has_source_mapping) AS functions_with_source, count(*) FILTER (shown) AS functions_with_snippet,
    count(*) FILTER (score >= 0.7) AS vulnerable_count FROM v_a GROUP BY 1)
  SELECT {ID}, row_number() OVER (PARTITION BY firmware_id ORDER BY shown DESC, coalesce(source_file <> '', false) DESC, score DESC, func_ordinal) AS rank, name,
    round(score, 6) + 0.0 AS score, score >= 0.7 AS is_vulnerable, array_to_string(cwe, ',') AS cwe, source_file, line_start, line_end,
    functions_total, functions_with_source, functions_with_snippet, vulnerable_count FROM v_a JOIN v_b USING (firmware_id)""")
def analyze(spark, sf):
    result = J.analyze(V.job_tables(spark, sf))
    findings = result.findings.select(*C.KEY, "rank", "name", "score", "is_vulnerable", "cwe", "source_file", "line_start", "line_end")
    return plain(findings.join(result.summary, "firmware_id"))


@query("E4", f"SELECT count(*) AS functions, count(DISTINCT firmware_id) AS firmwares FROM v_numbered")
def build_dataset(spark, sf):
    matrix, labels, _ = J.build_dataset(V.job_tables(spark, sf))
    joined = matrix.join(labels, C.KEY)
    per_image = joined.groupBy("firmware_id").agg(F.count(F.lit(1)).alias("n"))
    return plain(per_image.agg(F.sum("n").alias("functions"), F.count(F.lit(1)).alias("firmwares")))


@query("E4, J11, A3, A4", f"""SELECT {ID}, {ALL_FEATURES}, len(cwe)::BIGINT AS num_cwe_labels, b.h AS has_cwe, {CWE_PRODUCTS}, {PRODUCTS}, b.h AS label,
  array_to_string(list_transform(list_filter(range(len(d.ids)), lambda i: list_contains(cwe, d.ids[i + 1])), lambda i: CAST(i AS VARCHAR)), ',') AS ones, array_to_string(cwe, ',') AS cwe
  FROM v_job_structural JOIN v_job_peripheral USING ({ID}) JOIN v_job_embedding USING ({ID}) JOIN v_job_matches USING ({ID})
  JOIN (SELECT {ID}, CAST(len(cwe) > 0 AS BIGINT) AS h FROM v_job_matches) b USING ({ID}), (SELECT list(c ORDER BY c) AS ids FROM (SELECT DISTINCT unnest(cwe) AS c FROM v_job_matches)) d""")
def build_dataset_rows(spark, sf):
    """All columns of the data set that the jobs build."""
    matrix, labels, cwe = J.build_dataset(V.job_tables(spark, sf))
    ones = F.col("cwe_positions").cast("array<string>").alias("ones")
    rows = matrix.select(*[c for c in matrix.columns if c != "cwe_positions"], ones)
    return plain(rows.join(labels, C.KEY).join(cwe, C.KEY))


@query("E3, A13", """SELECT split, firmwares, functions, vulnerable, functions AS samples FROM (
  SELECT split, count(DISTINCT firmware_id) AS firmwares, count(*) AS functions, sum(CAST(len(cwe) > 0 AS BIGINT))::BIGINT AS vulnerable
  FROM v_gated_labels JOIN (SELECT firmware_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || firmware_id)) <= ceil(round(count(*) OVER () * 0.2, 9)) THEN 'validation' ELSE 'train' END AS split
    FROM (SELECT DISTINCT firmware_id FROM v_gated_labels)) USING (firmware_id) GROUP BY 1)""")
def train_summary(spark, sf):
    """Training over usable images with sheet and answers: who is held out, and what was measured on whom."""
    training = J.train(V.gated_tables(spark, sf), Config(model_kind="rule"), shared_folder(spark, "train"))
    return plain(training.summary.join(training.metrics.select("split", "samples"), "split"))


@query("S5, U1, W6", f"SELECT {ID}, {S_COLS}, CAST(len(cwe) > 0 AS BIGINT) AS label, array_to_string(cwe, ',') AS cwe FROM v_structural JOIN v_cwe USING ({ID})")
def incremental_dataset(spark, sf):
    """A data set built image by image in two runs is the one that a full build gives."""
    folder = shared_folder(spark, "images")
    content = F.md5(F.concat("firmware_id", F.lit("|v1")))
    rows = V.v_functions(spark, sf).withColumn("sha256", content)
    images = rows.select("firmware_id", "sha256").distinct()
    matrix, labels, cwe = M.structural_features(rows), labels_of(spark, sf), V.v_cwe(spark, sf)
    for part in (images.filter(F.col("sha256") < "8"), images):
        new = cut_lineage(datasets.new_images(spark, part, folder))
        mine = lambda df: df.join(new.select("firmware_id"), "firmware_id", "left_semi")  # noqa: E731, B023
        datasets.add_images(mine(matrix), mine(labels), mine(cwe), new, folder)
    matrix, labels, cwe = datasets.load_images(spark, folder)
    return plain(matrix.join(labels, C.KEY).join(cwe, C.KEY))


def _training_rows(spark, sf):
    functions = V.v_functions(spark, sf)
    return M.drop_label_columns(M.matrix_from_functions(functions, V.v_cwe(spark, sf), IDS)).join(labels_of(spark, sf), C.KEY)


def _train(spark, sf, kind):
    # Training and each scoring read the rows; their features are worked out once.
    rows = keep_table(_training_rows(spark, sf), "training")
    config = Config(model_kind=kind)
    return rows, J.train_on(rows.drop("label"), rows.select(*C.KEY, "label"), config)


_FACTS = "SELECT count(*) AS n_rows, true AS in_range, true AS flags_follow FROM v_functions"


def _facts(predictions):
    """What SQL can state of fitted trees: one score a row, in 0..1, and flags that follow the threshold."""
    return plain(predictions.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bool_and(F.col("score").between(0.0, 1.0)), F.lit(False)).alias("in_range"),
        F.coalesce(F.bool_and(F.col("is_vulnerable").cast("boolean") == (F.col("score") >= 0.7)), F.lit(False)).alias("flags_follow")))


@query("M1, M4", _FACTS)
def fit_boosted(spark, sf):
    rows, training = _train(spark, sf, "boosted")
    return _facts(T.predict(rows.drop("label"), V.v_cwe(spark, sf), training.model))


@query("M2, M4", _FACTS)
def fit_forest(spark, sf):
    rows, training = _train(spark, sf, "forest")
    return _facts(T.predict(rows.drop("label"), V.v_cwe(spark, sf), training.model))


@query("M5", "SELECT count(*) AS n_rows, 0.0::DOUBLE AS largest_difference FROM v_functions")
def model_round_trip(spark, sf):
    rows, training = _train(spark, sf, "forest")
    folder = shared_folder(spark, "model")
    T.save_model(spark, training.model, folder)
    again = T.load_model(spark, folder)
    before = T.score_matrix(rows, training.model).select(*C.KEY, F.col("score").alias("before"))
    after = T.score_matrix(rows, again).join(before, C.KEY)
    return plain(after.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("score") - F.col("before"))).alias("largest_difference")))


@query("E3")
def train(spark, sf):
    tables = V.job_tables(spark, sf)
    training = J.train(tables, Config(model_kind="forest"), shared_folder(spark, "train"))
    return plain(training.metrics.join(training.summary, "split"))
