"""Runs from parameter files: read, resolve, and write the link index, captures, report and log.

Paths in a parameter file are relative to its folder. A run's outputs lie in a folder of its own
(`<base>_<tag>` in the output folder, where base is the input's name), so that files of a batch
don't overwrite each other:

    link_index          lines of refID, clusterID and, with addRefsToLinkIndex, the tokens
    refs, token_freq    references and token frequencies after corrections
    link                clusters of all references
    report, log         the report's row (header and values), and what was counted
    profile             sizes of the clusters; metrics: against the truth, where there is one
    global_edits, block_edits   with globalCorrectionDetail, blockCorrectionDetail
    variants            a JSON object, with learnTokenVariants
    rounds/             with resume: tables by iteration=NN, and a manifest for each whole round
    iteration_NN/       block_pairs, pairs_before_correction, linked_pairs, comparison, token_matches
                        (matrix of greedy matches only), clusters, cluster_json, link and,
                        with runIterationProfile, profile and metrics

All but link_index and variants are CSV files with a header, or JSON lines. Beside those folders,
report.xlsx has the report rows of all runs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillmatch.functions.text import base_name
from quillmatch.operators.metrics import er_metrics
from quillmatch.operators.stats import tokenize
from quillmatch.plans import reports
from quillmatch.plans.params import Params, load, parameter_files
from quillmatch.plans.resolve import Resolution, resolve
from quillmatch.plans.staging import staged
from quillmatch.sources.readers import read_aliases, read_references, read_truth, read_variants, read_word_list, resolve_duplicates


def run(spark: SparkSession, params_path: str, out: str, words_path: str | None = None, aliases_path: str | None = None, variants_path: str | None = None, tag: str = "run", resume: bool = False) -> Resolution:
    """Resolve what a parameter file names. `out`: a folder that Spark can write, for the outputs;
    word list, aliases and variants are optional files. With `resume`, rounds are kept in the run's
    folder, and one that was lost goes on after its last whole round."""
    result, row = _run(spark, params_path, out, words_path, aliases_path, variants_path, tag, resume)
    reports.append_workbook(row, f"{out.rstrip('/')}/report.xlsx")
    return result


def _run(spark, params_path, out, words_path=None, aliases_path=None, variants_path=None, tag="run", resume=False) -> tuple[Resolution, DataFrame]:
    p = load(params_path)
    near = Path(params_path).parent
    refs = resolve_duplicates(tokenize(read_references(spark, _beside(near, p.inputFileName), p.delimiter, p.hasHeader), p))
    truth = read_truth(spark, _beside(near, p.truthFileName)) if p.truthFileName else None
    words = read_word_list(spark, words_path) if words_path else None
    aliases = read_aliases(spark, aliases_path) if aliases_path else None
    variants = read_variants(spark, variants_path) if variants_path else None
    folder = reports.capture_path(out, base_name(p.inputFileName), tag)
    result = resolve(refs, p, words=words, aliases=aliases, variants=variants, truth=truth, folder=f"{folder}/rounds" if resume else None)
    return result, write(result, folder, truth)


@dataclass
class Outcome:
    """What became of a parameter file of a batch: its result, or the error that ended its run."""

    path: str
    result: Resolution | None = None
    error: Exception | None = None


def batch(spark: SparkSession, list_path: str, out: str, at_once: int = 2, **settings) -> list[Outcome]:
    """Run the parameter files that a list names, `at_once` of them at a time in one session, each in
    a scheduler pool and a job group of its own (with spark.scheduler.mode=FAIR pools share the
    cluster). A run that fails doesn't end the others. Files of one base name get the place in the
    list as part of their tag; the spreadsheet gets the report rows in the list's order."""
    near, tag, context = Path(list_path).parent, settings.pop("tag", "run"), spark.sparkContext
    rows: dict[int, DataFrame] = {}

    def one(number: int, path: str) -> Outcome:
        context.setLocalProperty("spark.scheduler.pool", f"{tag}{number}")
        context.setJobGroup(f"{tag}{number}", path)
        try:
            result, rows[number] = _run(spark, _beside(near, path), out, tag=f"{tag}{number}", **settings)
            return Outcome(path, result)
        except Exception as e:  # noqa: BLE001  it is reported, and the others go on
            return Outcome(path, error=e)

    with ThreadPoolExecutor(at_once) as pool:
        found = list(pool.map(one, *zip(*enumerate(parameter_files(list_path), 1), strict=True))) if parameter_files(list_path) else []
    for number in sorted(rows):
        reports.append_workbook(rows[number], f"{out.rstrip('/')}/report.xlsx")
    return found


def _beside(folder: Path, path: str) -> str:
    """A path as it is where it is absolute or names a store, else one in the folder."""
    return path if "://" in path or Path(path).is_absolute() else str(folder / path)


def write(result: Resolution, folder: str, truth: DataFrame | None = None) -> DataFrame:
    """The outputs of a run; returns its report row."""
    p, refs = result.params, result.refs
    reports.write_link_index(result.link, f"{folder}/link_index", refs if p.addRefsToLinkIndex else None)
    reports.write_csv(result.link, f"{folder}/link")
    reports.write_csv(reports.ref_capture(refs), f"{folder}/refs")
    reports.write_csv(reports.token_capture(result.freq), f"{folder}/token_freq")
    reports.write_csv(result.profile, f"{folder}/profile")
    metrics = None
    if truth is not None:
        metrics = er_metrics(result.link, truth)
        reports.write_csv(metrics, f"{folder}/metrics")
    row = staged(reports.report_row(result, metrics))
    reports.append_report(row, f"{folder}/report")
    reports.write_csv(reports.run_log(result), f"{folder}/log")
    if p.globalCorrectionDetail and result.global_edits is not None:
        reports.write_csv(result.global_edits, f"{folder}/global_edits")
    if p.blockCorrectionDetail and result.block_edits is not None:
        reports.write_csv(result.block_edits, f"{folder}/block_edits")
    if result.variants is not None:
        reports.write_variants(result.variants, f"{folder}/variants")
    for step in result.iterations:
        _write_iteration(result, step, f"{folder}/iteration_{step.number:02d}", truth, p.with_(mu=step.mu, epsilon=step.epsilon))
    return row


def _write_iteration(result: Resolution, step, folder: str, truth: DataFrame | None, p: Params) -> None:
    refs, freq = result.refs, result.freq
    reports.write_csv(reports.pair_capture(step.pairs, refs, truth), f"{folder}/block_pairs")
    if step.blocked is not None:
        reports.write_csv(reports.pair_capture(step.blocked, step.refs_blocked, truth), f"{folder}/pairs_before_correction")
    if step.links is None:
        return
    reports.write_csv(reports.pair_capture(step.links.select("refID1", "refID2"), refs, truth), f"{folder}/linked_pairs")
    reports.write_csv(reports.pair_comparison(step.pairs, refs, freq, p, truth), f"{folder}/comparison")
    if p.comparator == "ScoringMatrixKris":
        reports.write_csv(reports.token_matches(step.pairs, refs, freq, p), f"{folder}/token_matches")
    if step.clusters is None:
        return
    reports.write_csv(reports.cluster_capture(step.clusters, refs, truth), f"{folder}/clusters")
    reports.write_json(reports.cluster_json(step.clusters, refs), f"{folder}/cluster_json")
    reports.write_csv(step.link, f"{folder}/link")
    for name, df in (("profile", step.profile), ("metrics", step.metrics)):
        if df is not None:
            reports.write_csv(df, f"{folder}/{name}")
