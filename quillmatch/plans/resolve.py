"""Resolution of references into clusters: the loop over blocking, scoring, closure and quality."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.block_correction import correct_blocks
from quillmatch.operators.blocking import candidate_pairs, comparison_tokens
from quillmatch.operators.closure import components
from quillmatch.operators.correction import apply_corrections, corrections, learned_variants, replaced, with_variants
from quillmatch.operators.metrics import blocking_metrics, cluster_profile, er_metrics, quality_counters
from quillmatch.operators.quality import entropy_quality
from quillmatch.operators.scoring import linked, score
from quillmatch.operators.stats import frequency_statistics, token_frequency
from quillmatch.plans.params import Params
from quillmatch.plans.rounds import Rounds
from quillmatch.plans.staging import staged


#: Comparators whose scores depend on mu.
BY_MU = ("ScoringMatrixStd",)


@dataclass
class Iteration:
    """What one round made; the frames are staged, so they can be read again."""

    number: int
    mu: float
    epsilon: float
    pairs: DataFrame
    #: the pairs before block correction, in the round that has it
    blocked: DataFrame | None = None
    refs_blocked: DataFrame | None = None
    links: DataFrame | None = None
    clusters: DataFrame | None = None
    quality: DataFrame | None = None
    link: DataFrame | None = None
    profile: DataFrame | None = None
    metrics: DataFrame | None = None
    blocking: DataFrame | None = None
    #: what was counted while the frames were staged, by frame
    seen: dict[str, dict] = field(default_factory=dict)


@dataclass
class Resolution:
    """link: refID, clusterID for every reference; refs and freq as the loop left them, refs_read and
    freq_read as it got them. Edits are old, new, n: of global and of block correction."""

    params: Params
    link: DataFrame
    refs: DataFrame
    freq: DataFrame
    iterations: list[Iteration] = field(default_factory=list)
    ended: str = ""
    variants: DataFrame | None = None
    refs_read: DataFrame | None = None
    freq_read: DataFrame | None = None
    global_edits: DataFrame | None = None
    #: references that global correction changed
    refs_changed: int = 0
    block_edits: DataFrame | None = None
    #: rounds that block correction took
    block_rounds: int = 0
    #: scores of all pairs of this session's first round, where they don't depend on mu
    scored: DataFrame | None = None
    #: sizes of the final clusters
    profile: DataFrame | None = None
    #: what was counted while the frames were staged, by frame
    seen: dict[str, dict] = field(default_factory=dict)


def one_iteration(refs: DataFrame, freq: DataFrame, p: Params, restricted: bool = True) -> DataFrame:
    """refID1, refID2, score of the pairs that one round links."""
    pairs = candidate_pairs(refs, freq, p)
    return linked(score(pairs, comparison_tokens(refs, freq, p), p, restricted), p.mu)


def clusters_of(links: DataFrame) -> DataFrame:
    """clusterID, refID of links (refID1, refID2)."""
    return components(links, "refID1", "refID2").select(F.col("component").alias("clusterID"), F.col("node").alias("refID"))


def upsert(link: DataFrame, new: DataFrame) -> DataFrame:
    """link with the clusterID of `new` where it has one."""
    fresh = new.select(F.col("refID").alias("_id"), F.col("clusterID").alias("_c"))
    return link.join(fresh, F.col("refID") == F.col("_id"), "left").select("refID", F.coalesce("_c", "clusterID").alias("clusterID"))


def _open(pairs: DataFrame, resolved: DataFrame, mu: float | None = None) -> DataFrame:
    """Pairs, or those with a score of mu or more, whose references are both unresolved."""
    rows = pairs if mu is None else linked(pairs, mu)
    for i in ("refID1", "refID2"):
        rows = rows.join(resolved.select(F.col("refID").alias(i)), i, "left_anti")
    return rows.select(*pairs.columns)


def _frequencies(refs: DataFrame, seen: dict[str, dict], name: str) -> DataFrame:
    """The staged frequencies of staged references; their statistics go to seen."""
    freq = staged(token_frequency(refs), **frequency_statistics())
    seen[name] = refs.seen | freq.seen
    return freq


def _edits(df: DataFrame) -> DataFrame:
    return staged(df, edits=F.coalesce(F.sum("n"), F.lit(0)), distinct_edits=F.count("*"))


def resolve(refs: DataFrame, p: Params, words: DataFrame | None = None, aliases: DataFrame | None = None, variants: DataFrame | None = None, truth: DataFrame | None = None, restricted: bool = True, folder: str | None = None) -> Resolution:
    """Resolve tokenized references (refID unique, tokens, ord).

    Each round blocks the references that are still open, links, closes and keeps the clusters of
    quality epsilon or more; mu and epsilon then grow. The loop ends where nothing is left to pair
    or to link, where mu passes 1, or where a round resolved nothing and neither threshold moves.
    References that stay open become clusters of their own.

    `folder`: where rounds are kept (a folder that all executors share); a later call with the same
    parameters and folder goes on after the last whole round, on the references as they were read
    then."""
    p.checked()
    store = Rounds(refs.sparkSession, folder, p)
    if done := store.found():
        return _rounds(_resumed(store, done, p), store, truth, aliases, restricted, done[-1])
    rows, seen = {"refs": F.count("*")}, {}
    refs = staged(refs.select("refID", "tokens", "ord"), **rows)
    freq = _frequencies(refs, seen, "tokens_read")
    learned = global_edits = None
    refs_read, freq_read, refs_changed = refs, freq, 0
    if p.runGlobalCorrection:
        found = corrections(freq, p, words)
        known = variants if variants is not None else refs.sparkSession.createDataFrame([], "std string, variant string")
        found = staged(with_variants(found, known))
        if p.learnTokenVariants:
            learned = staged(learned_variants(known, found))
        global_edits = _edits(replaced(freq, found))
        seen["global_correction"] = global_edits.seen
        fixed = staged(apply_corrections(refs, found), changed=F.count_if(F.col("n_changed") > 0), **rows)
        refs_changed = fixed.seen["changed"]
        refs = fixed.drop("n_changed")
        refs.seen = {"refs": fixed.seen["refs"]}
        freq = _frequencies(refs, seen, "tokens_corrected")
    link = staged(refs.select("refID", F.lit(None).cast("string").alias("clusterID")))
    out = Resolution(p, link, refs, freq, variants=learned, refs_read=refs_read, freq_read=freq_read, global_edits=global_edits, refs_changed=refs_changed, seen=seen)
    return _rounds(out, store, truth, aliases, restricted)


#: Tables of a run that are kept with its first round, beside references and frequencies.
_OF_RUN = ("refs_read", "freq_read", "variants", "global_edits", "block_edits")
#: Tables of a round.
_OF_ROUND = ("pairs", "blocked", "refs_blocked", "links", "clusters", "quality", "link", "metrics", "blocking")


def _resumed(store: Rounds, done: list[dict], p: Params) -> Resolution:
    """What a run had after its last whole round."""
    first, last = done[0], done[-1]
    own = {name: store.table(name, 1) for name in first["of_run"]}
    out = Resolution(p, store.table("link", last["number"]), store.table("refs", 1), store.table("freq", 1), seen=last["run_seen"], refs_changed=first["refs_changed"], block_rounds=first["block_rounds"], **own)
    for m in done:
        tables = {name: store.table(f"round_{name}", m["number"]) for name in m["of_round"]}
        step = Iteration(m["number"], m["mu"], m["epsilon"], seen=m["seen"], **tables)
        if p.runIterationProfile and step.link is not None:
            step.profile = cluster_profile(step.link)
        out.iterations.append(step)
    return out


def _rounds(out: Resolution, store: Rounds, truth: DataFrame | None, aliases: DataFrame | None, restricted: bool, last: dict | None = None) -> Resolution:
    """The rounds that are left, and the end."""
    p = out.params
    mu, epsilon = (last["next_mu"], last["next_epsilon"]) if last else (p.mu, p.epsilon)
    out.ended = last["ended"] if last else ""
    while not out.ended:
        step = _round(out, store, len(out.iterations) + 1, mu, epsilon, truth, aliases, restricted)
        mu, epsilon = round(mu + p.muIterate, 2), round(epsilon + p.epsilonIterate, 2)
        if not out.ended and mu > 1.0:
            out.ended = "mu above 1"
        if store.folder:
            if step.number == 1:
                out.refs, out.freq = store.keep(out.refs, "refs", 1), store.keep(out.freq, "freq", 1)
                for name in _OF_RUN:
                    if getattr(out, name) is not None:
                        setattr(out, name, store.keep(getattr(out, name), name, 1))
            out.link = store.keep(out.link, "link", step.number)
            store.end(
                step.number, mu=step.mu, epsilon=step.epsilon, next_mu=mu, next_epsilon=epsilon, ended=out.ended, seen=step.seen, run_seen=out.seen, refs_changed=out.refs_changed, block_rounds=out.block_rounds,
                of_run=[n for n in _OF_RUN if getattr(out, n) is not None], of_round=[n for n in _OF_ROUND if getattr(step, n) is not None],
            )
    out.link = out.link.select("refID", F.coalesce("clusterID", "refID").alias("clusterID"))
    out.profile = staged(cluster_profile(out.link), clusters=F.coalesce(F.sum("clusters"), F.lit(0)), refs=F.coalesce(F.sum("refs"), F.lit(0)), largest=F.max("size"))
    out.seen["clusters"] = out.profile.seen
    return out


def _round(out: Resolution, store: Rounds, number: int, mu: float, epsilon: float, truth: DataFrame | None, aliases: DataFrame | None, restricted: bool) -> Iteration:
    """One round: what it made, and in `out` what it changed; out.ended says if it was the last."""
    p, seen = out.params, out.seen
    now, many = p.with_(mu=mu, epsilon=epsilon), {"n": F.count("*")}
    resolved = out.link.where("clusterID IS NOT NULL").select("refID")
    # pairs and scores follow from the two references and all frequencies, which change no more after
    # the first round: later rounds go on with those whose references are both still open
    before = out.iterations[-1].pairs if out.iterations else None

    def keep(df: DataFrame, name: str, **counts) -> DataFrame:
        return store.keep(df, f"round_{name}", number, **counts)

    def blocked(name: str) -> DataFrame:
        return keep(candidate_pairs(out.refs.join(resolved, "refID", "left_anti"), out.freq, now), name, **many)

    def row(df: DataFrame, name: str) -> DataFrame:
        kept = keep(df, name, **{c: F.max(c) for c in df.columns})  # one row
        step.seen[name] = kept.seen
        return kept

    correct, edited = p.blockCorrection and number == 1, False
    pairs = blocked("blocked" if correct else "pairs") if before is None else keep(_open(before, resolved), "pairs", **many)
    step = Iteration(number, mu, epsilon, pairs)
    step.seen["pairs"] = pairs.seen
    out.iterations.append(step)
    if correct and pairs.seen["n"]:
        edits, refs_now, out.block_rounds = correct_blocks(out.refs, out.freq, pairs, aliases)
        out.block_edits = edits = _edits(edits)
        seen["block_correction"] = edits.seen | {"rounds": out.block_rounds}
        step.blocked, step.refs_blocked = pairs, keep(out.refs, "refs_blocked")
        step.seen["pairs_before_correction"] = pairs.seen
        edited = bool(edits.seen["edits"])
        if edited:
            out.refs = staged(refs_now, refs=F.count("*"))
            out.freq = _frequencies(out.refs, seen, "tokens_corrected")
        else:
            seen["tokens_corrected"] = seen.get("tokens_corrected", seen["tokens_read"])
    if correct:
        pairs = step.pairs = blocked("pairs") if edited else keep(pairs, "pairs", **many)
        step.seen["pairs"] = pairs.seen
    if truth is not None:
        step.blocking = row(blocking_metrics(pairs, out.refs, truth), "blocking")
    if not pairs.seen["n"]:
        out.ended = "no candidate pairs"
        return step
    scored = _open(out.scored, resolved, mu) if out.scored is not None else score(pairs, comparison_tokens(out.refs, out.freq, now), now, restricted)
    if out.scored is None and p.comparator not in BY_MU:
        scored = out.scored = staged(scored)
    links = step.links = keep(linked(scored, mu), "links", **many)
    step.seen["links"] = links.seen
    if not links.seen["n"]:
        out.ended = "no linked pairs"
        return step
    clusters = step.clusters = keep(clusters_of(links), "clusters", **many)
    quality = step.quality = keep(entropy_quality(clusters, out.refs), "quality", **quality_counters(epsilon))
    step.seen |= {"clustered": clusters.seen, "quality": quality.seen}
    good = clusters.join(quality.where(F.col("quality") >= epsilon).select("clusterID"), "clusterID", "left_semi")
    step.link = keep(upsert(out.link, clusters), "link")
    if p.runIterationProfile:
        step.profile = cluster_profile(step.link)
        if truth is not None:
            step.metrics = row(er_metrics(step.link, truth), "metrics")
    out.link = staged(upsert(out.link, good))
    if not quality.seen["good_clusters"] and not p.muIterate and not p.epsilonIterate:
        out.ended = "nothing resolved, thresholds fixed"
    return step
