"""The end-to-end jobs: score, analyse, train, export. All images go through one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funcrisk import constants as C
from funcrisk.config import Config
from funcrisk.functions.calls import all_calls, instruction_count
from funcrisk.functions.text import empty_strings
from funcrisk.operators import findings as R
from funcrisk.operators import labels as L
from funcrisk.operators import matrix as X
from funcrisk.operators import model as M
from funcrisk.operators import sourcemap as S
from funcrisk.operators import split as H
from funcrisk.operators import symbols as Y
from funcrisk.scale import Workspace, join_per_key, require_rows
from funcrisk.sources import datasets


@dataclass(frozen=True)
class Tables:
    """What a job reads. asm, labels and responses are optional.

    With a manifest only its usable images take part: ELF files that have debug sections and a source folder. The folder
    comes from root_map (key, roots, seq), where given, by path, name, stem or parent, else from roots.
    """

    symbols: DataFrame
    sections: DataFrame
    line_table: DataFrame
    source_files: DataFrame
    roots: DataFrame | None
    catalog: DataFrame
    asm: DataFrame | None = None
    label_rows: DataFrame | None = None
    responses: DataFrame | None = None
    manifest: DataFrame | None = None
    root_map: DataFrame | None = None


@dataclass(frozen=True)
class Scored:
    """images: the manifest's, as admit_images gives them, if there is one. work holds the tables that the results read."""

    functions: DataFrame
    matrix: DataFrame
    labels: DataFrame
    predictions: DataFrame
    images: DataFrame | None
    work: Workspace


@dataclass(frozen=True)
class Analysis:
    findings: DataFrame
    summary: DataFrame
    rejects: DataFrame
    scored: Scored


@dataclass(frozen=True)
class Training:
    model: M.Model
    metrics: DataFrame
    summary: DataFrame
    images: DataFrame


def admit_images(tables: Tables) -> DataFrame:
    """(firmware_id, stem, roots, reason): the manifest's images; reason is null for those a job can use."""
    flagged = Y.debug_images(tables.manifest, tables.sections)
    if tables.root_map is not None:
        rooted = S.roots_for_images(flagged, tables.root_map)
    else:
        rooted = flagged.join(tables.roots.select("firmware_id", "roots"), "firmware_id", "left")
    lacking = F.when(F.coalesce(F.size("roots"), F.lit(0)) <= 0, "no source folder")
    return rooted.select("firmware_id", "stem", "roots", F.coalesce("reason", lacking).alias("reason"))


def admitted(tables: Tables, work: Workspace) -> tuple[Tables, DataFrame | None]:
    """The tables of the usable images, and the images; without a manifest all tables and None."""
    if tables.manifest is None:
        return tables, None
    images = work.keep(admit_images(tables), "images")
    good = images.filter("reason IS NULL")
    cut = lambda df: None if df is None else df.join(good.select("firmware_id"), "firmware_id", "left_semi")
    return replace(
        tables, symbols=cut(tables.symbols), sections=cut(tables.sections), line_table=cut(tables.line_table),
        asm=cut(tables.asm), roots=good.select("firmware_id", "roots"),
    ), images


def numbered_functions(tables: Tables, config: Config = Config()) -> DataFrame:
    """The functions of every image in address order: ids, names, addresses and sizes only."""
    ranges = Y.code_ranges(tables.sections)
    symbols = Y.symbols_in_code(Y.function_symbols(tables.symbols), ranges)
    return Y.number_functions(Y.dedup_symbols(symbols), config.max_functions)


def with_disassembly(functions: DataFrame, asm: DataFrame | None) -> DataFrame:
    """Adds disassembly, calls, instructions and the extractor's fixed values.

    asm(firmware_id, address, disassembly) joins after the cut to max_functions per image, so
    only texts that are kept travel on.
    """
    if asm is None:
        functions = functions.withColumn("disassembly", F.lit(""))
    else:
        asm = asm.select("firmware_id", F.col("address").alias("address_int"), "disassembly")
        functions = functions.join(asm, ["firmware_id", "address_int"], "left").withColumn(
            "disassembly", F.coalesce("disassembly", F.lit(""))
        )
    return functions.withColumns(
        {
            "calls": all_calls(F.col("disassembly"), F.col("name")),
            "instructions": instruction_count(F.col("disassembly")),
            "strings": empty_strings(),
            "entropy": F.lit(C.EXTRACTED_ENTROPY),
        }
    )


def extract_functions(tables: Tables, config: Config = Config()) -> DataFrame:
    """Functions as the symbols and disassembly give them, without sources."""
    return with_disassembly(numbered_functions(tables, config), tables.asm)


def mapped_functions(tables: Tables, config: Config, work: Workspace) -> DataFrame:
    """Functions with disassembly and sources, written once.

    The narrow function list feeds the lookups several times and is kept first; texts join last. With a manifest the
    functions carry their image's stem, by which sheets name it.
    """
    numbered = numbered_functions(tables, config)
    if tables.manifest is not None:
        stems = tables.manifest.select("firmware_id", F.col("stem").alias("firmware_stem")).dropDuplicates(["firmware_id"])
        numbered = join_per_key(numbered, stems, ["firmware_id"], "left")
    numbered = work.keep(numbered, "numbered")
    return work.keep(with_disassembly(map_sources(numbered, tables, config, work), tables.asm), "functions")


def map_sources(functions: DataFrame, tables: Tables, config: Config = Config(), work: Workspace | None = None) -> DataFrame:
    """The functions with spans, paths and snippets.

    Resolving reads the spans twice, and snippets read the paths and the files' lines twice; in a workspace each is worked
    out once, so that addresses are looked up once and texts are cut into lines once.
    """
    keep = work.keep if work is not None else lambda df, name: df
    spans = keep(S.source_span(functions, tables.line_table), "spans")
    resolved = keep(S.resolve_source(spans, tables.roots, tables.source_files), "resolved")
    blocks = keep(S.line_blocks(tables.source_files), "files")
    return S.snippets(resolved, tables.source_files, config.snippet_context, blocks)


def label_functions(functions: DataFrame, tables: Tables, config: Config = Config()) -> DataFrame:
    """(firmware_id, func_id, cwe): sheet labels first, automatic ones in the gaps."""
    spark = functions.sparkSession
    responses = tables.responses
    if responses is None:
        responses = spark.createDataFrame([], "firmware_id string, func_id string, answer string")
    sheet = None
    gaps = functions
    if tables.label_rows is not None:
        sheet = L.assign_labels(functions, tables.label_rows).select(*C.KEY, "cwe")
        gaps = L.label_gaps(functions, sheet)
    auto = L.auto_labels(gaps, responses, tables.catalog, config.answer_provider, config.answer_model)
    return L.merge_labels(functions, sheet, auto)


def run_static(
    tables: Tables, config: Config = Config(), model: M.Model | None = None, work: Workspace | None = None
) -> Scored:
    """Functions, matrix, labels and scores.

    The function table feeds labels, features and findings alike, so it is a Parquet table of the job's workspace, of
    which each reads its own columns. No label becomes a column here, as no score may read one.
    """
    work = work or Workspace(tables.symbols.sparkSession)
    tables, images = admitted(tables, work)
    functions = mapped_functions(tables, config, work)
    labels = work.keep(label_functions(functions, tables, config), "labels")
    matrix = X.matrix_from_functions(functions, labels)
    predictions = M.predict(matrix, labels, model, config.threshold, config.cwe_boost)
    return Scored(functions, matrix, labels, predictions, images, work)


def image_states(scored: Scored, require_source_mapping: bool = True) -> DataFrame:
    """(firmware_id, reason): all images known, reason null where the analysis stands."""
    counts = scored.functions.groupBy("firmware_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("has_source_mapping", F.lit(False))).alias("mapped")
    )
    if scored.images is None:
        known = counts.withColumn("reason", F.lit(None).cast("string"))
    else:
        known = scored.images.select("firmware_id", "reason").join(counts, "firmware_id", "left")
    found = F.when(F.col("n").isNull(), "no functions").when(
        F.lit(require_source_mapping) & (F.col("mapped") == 0), "no function maps to source lines"
    )
    return known.select("firmware_id", F.coalesce("reason", found).alias("reason"))


def analyze(
    tables: Tables, model: M.Model | None = None, config: Config = Config(),
    source_only: bool = False, require_source_mapping: bool = True, work: Workspace | None = None,
) -> Analysis:
    """Ranked findings and the summary per image; images that cannot be analysed are rejects with a reason.

    An image fails alone: with require_source_mapping one without any mapped function is a reject, and the others go on.
    """
    scored = run_static(tables, config, model, work)
    states = scored.work.keep(image_states(scored, require_source_mapping), "states")
    good = states.filter("reason IS NULL").select("firmware_id")
    cut = lambda df: df.join(good, "firmware_id", "left_semi")
    predictions = scored.work.keep(cut(scored.predictions), "predictions")
    functions = cut(scored.functions)
    findings = R.rank_findings(predictions, functions, config.max_findings, source_only)
    return Analysis(findings, R.analysis_summary(functions, predictions), states.filter("reason IS NOT NULL"), scored)


def build_dataset(
    tables: Tables, config: Config = Config(), work: Workspace | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, binary labels, label lists) of all images, without scoring; the matrix holds ids by their position."""
    work = work or Workspace(tables.symbols.sparkSession)
    tables, _ = admitted(tables, work)
    functions = mapped_functions(tables, config, work)
    cwe = work.keep(label_functions(functions, tables, config), "labels")
    dictionary = work.keep(L.cwe_dictionary(cwe), "dictionary")
    return X.matrix_from_functions(functions, cwe, dictionary=dictionary), L.binary_labels(functions, cwe), cwe


def training_summary(split_labels: DataFrame) -> DataFrame:
    """(split, firmwares, functions, vulnerable) from (firmware_id, func_id, label, split)."""
    per_image = split_labels.groupBy("split", "firmware_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("v")
    )
    return per_image.groupBy("split").agg(
        F.count(F.lit(1)).alias("firmwares"), F.sum("n").alias("functions"), F.sum("v").alias("vulnerable")
    )


def train_on(
    matrix: DataFrame, labels: DataFrame, config: Config = Config(), method: str = "hash", work: Workspace | None = None
) -> Training:
    """Split by image, fit on one part, measure on both."""
    work = work or Workspace(matrix.sparkSession)
    split = H.split_by_firmware(labels, config.validation_split, config.seed, method)
    # Trees pass over the rows many times; features are worked out once.
    rows = work.keep(X.drop_label_columns(matrix).join(split, C.KEY), "rows")
    train = rows.filter(F.col("split") == "train")
    model = M.fit(train, config.model_kind, config.model_params, config.fn_cost_multiplier, config.scale_pos_weight)
    scored = M.score_matrix(rows, model).join(rows.select(*C.KEY, "split", "label"), C.KEY)
    told = rows.select(*C.KEY, "split", "label")
    return Training(model, M.accuracy_metrics(scored), training_summary(told), told.select("firmware_id", "split").distinct())


def train(
    tables: Tables, config: Config = Config(), folder: str | None = None, method: str = "hash", work: Workspace | None = None
) -> Training:
    """Dataset, split, fit, metrics; with a folder the dataset and the model are kept there."""
    work = work or Workspace(tables.symbols.sparkSession)
    matrix, labels, cwe = build_dataset(tables, config, work)
    require_rows(labels, "no features were extracted")
    if folder is not None:
        datasets.save_dataset(matrix, labels, cwe, f"{folder}/dataset")
    training = train_on(matrix, labels, config, method, work)
    if folder is not None:
        M.save_model(matrix.sparkSession, training.model, f"{folder}/model")
    return training
