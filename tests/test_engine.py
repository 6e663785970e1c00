import random
import threading
import zipfile
from collections import Counter
from itertools import combinations
from math import log2
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.functions.similarity import damerau
from quillmatch.operators import blocking, closure, correction, metrics, quality, stats
from quillmatch.operators.block_correction import Fold, Places, correct_blocks, cut_slabs
from quillmatch.operators.closure import components
from quillmatch.plans import queries, reports, run
from quillmatch.plans import resolve as resolving
from quillmatch.plans.params import ParameterError, Params, parse
from quillmatch.plans.resolve import resolve
from quillmatch.plans.run import batch
from quillmatch.sources import workbook
from quillmatch.sources.readers import numbered_lines, parse_lines, read_aliases, read_references, read_truth, read_variants, read_word_list, resolve_duplicates


def refs_of(spark, lists):
    return spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(lists.items())], "refID string, tokens array<string>, ord long")


def test_parameters():
    p = parse("# c\ninputFileName=people.txt\ndelimiter=,\nbeta=6\nsigma=12\nmu=0.6\nblockByPairs=False\nrunClusterMetrics=True\n\nbeta=1\n")
    assert (p.inputPrefix, p.beta, p.mu, p.blockByPairs) == ("people", 6, 0.6, False)
    assert parse("delimiter=\t\n").delimiter == "\t"
    with pytest.raises(ParameterError) as e:
        parse("nonsense\nfoo=1\nbeta=x\ndelimiter=#\nmu=2\n")
    assert len(str(e.value).splitlines()) == 5


def test_readers(spark, tmp_path):
    (tmp_path / "r.txt").write_bytes(b"RecID,a\rX1,JO SMITH\rX2,\rbad\rX1,AN SMITH")
    rows = read_references(spark, str(tmp_path / "r.txt"), ",", True)
    assert [(r["refID"], r["body"], r["malformed"]) for r in rows.orderBy("ord").collect()] == [("X1", "JO SMITH", False), ("X2", "", False), ("ba", "bad", True), ("X1", "AN SMITH", False)]
    unique = resolve_duplicates(stats.tokenize(rows, Params()))
    assert {r["refID"]: r["tokens"] for r in unique.collect()} == {"X1": ["AN", "SMITH"], "X2": [], "ba": ["BAD"]}
    (tmp_path / "w.txt").write_text("A\nB\n\nC\n")
    assert {r[0] for r in read_word_list(spark, str(tmp_path / "w.txt")).collect()} == {"A", "B"}
    (tmp_path / "a.dat").write_text("ROBERT\tBOB\n!!x\ty\nBOBBY\tBOB\n")
    assert {tuple(r) for r in read_aliases(spark, str(tmp_path / "a.dat")).collect()} == {("BOB", "BOBBY"), ("y", "!!x")}
    (tmp_path / "t.csv").write_text("RecID,truth,z\nX1, T1,9\nX2,T2\n\nX3,T3\n")
    assert {tuple(r) for r in read_truth(spark, str(tmp_path / "t.csv")).collect()} == {("X1", "T1"), ("X2", "T2")}
    (tmp_path / "v.json").write_text('{"A": ["B", "C"], "D": 1}')
    assert {tuple(r) for r in read_variants(spark, str(tmp_path / "v.json")).collect()} == {("A", "B"), ("A", "C")}
    assert read_variants(spark, str(tmp_path / "none.json")).count() == 0


def test_empty_line_is_malformed(spark):
    row = parse_lines(spark.createDataFrame([("", 0)], "value string, ord long")).first()
    assert (row["refID"], row["body"], row["malformed"]) == ("", "", True)


def literal_pairs(lists, freq, p):
    """Pairs by spelling out every key."""
    keys = {}
    for r, tokens in lists.items():
        own = [t for t in tokens if 2 <= freq[t] <= p.beta and len(t) >= p.minBlkTokenLen and not (p.excludeNumericBlocks and t.isdigit())]
        for key in [("" if p.strictBlockKeys else " ").join(sorted(x)) for x in combinations(own, 2)] if p.blockByPairs else own:
            keys.setdefault(key, []).append(r)
    return {tuple(sorted(x)) for rs in keys.values() for x in combinations(rs, 2)}


@pytest.mark.parametrize(("by_pairs", "strict"), [(True, False), (False, False), (True, True)])
def test_blocking_against_spelt_out_keys(spark, by_pairs, strict):
    rnd = random.Random(7)
    lists = {f"r{i:03d}": [rnd.choice(["AAAA", "AAAAB", "BBBBB", "BBBB", "CCCC", "DDDD", "EEEE", "1234", "ZZ", *(f"T{k:04d}" for k in range(60))]) for _ in range(rnd.randint(0, 6))] for i in range(120)}
    p = Params(beta=8, sigma=12, blockByPairs=by_pairs, strictBlockKeys=strict)
    lists |= {"x1": ["AAAAA", "BBBBX"], "x2": ["AAAA", "ABBBBX"], "x3": ["AAAAA", "ABBBBX", "BBBBX"]}
    freq = Counter(t for ts in lists.values() for t in ts)
    refs = refs_of(spark, lists)
    found = {tuple(r) for r in blocking.candidate_pairs(refs, stats.token_frequency(refs), p).collect()}
    assert found == literal_pairs(lists, freq, p)


def test_self_pair(spark):
    refs = refs_of(spark, {"X": ["FOO1", "FOO1", "BAR1"], "Y": ["BAR1"]})
    found = blocking.candidate_pairs(refs, stats.token_frequency(refs), Params(beta=6))
    assert [tuple(r) for r in found.collect()] == [("X", "X")]


def test_closure(spark):
    assert {tuple(r) for r in components(spark.createDataFrame([("B", "C"), ("A", "B"), ("D", "E"), ("F", "F"), (None, "A")], "a string, b string")).collect()} == {("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D"), ("F", "F")}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("name", [str, lambda i: i])
def test_closure_of_many_chunks_and_hubs(spark, name):
    """A hub of many links, above and below them in order, paths and random links, in small chunks."""
    rnd = random.Random(12)
    ids = rnd.sample(range(1000, 9000), 900)
    hub_low, hub_high = min(ids) - 1, max(ids) + 1
    edges = [(hub_low, x) for x in ids[:300]] + [(hub_high, x) for x in ids[300:600]] + list(zip(ids[600:700], ids[601:701], strict=True)) + [tuple(rnd.sample(ids[700:], 2)) for _ in range(120)] + [(ids[0], hub_low)] * 50
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in edges:
        p, q = sorted((find(name(x)), find(name(y))))
        root[q] = p
    kind = "string" if name is str else "long"
    links = spark.createDataFrame([(name(x), name(y)) for x, y in edges], f"a {kind}, b {kind}")
    assert {tuple(r) for r in components(links, chunk=40, hub=25).collect()} == {(x, find(x)) for x in list(root)}


def test_no_hub_is_shuffled_to(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 200)] + [(500, 499)], "u long, v long")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumnRenamed("u", "k")
    hot, rest = closure._with_lowest(both, low, 50)
    assert hot.count() == 199 and {r["u"] for r in hot.collect()} == {0} and rest.where("u = 0").count() == 0 and rest.count() == 201
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("isnull(_hub") > plan.index("Join Inner")  # hubs are filtered below the join that shuffles


def test_closure_against_union_find(spark):
    rnd = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 40) if i % 13] + [(rnd.randrange(100, 180), rnd.randrange(100, 180)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges for x in e}


def slow_entropy(lists):
    """Each occurrence is matched with one in every later member."""
    n, total = len(lists), sum(map(len, lists))
    base = total * log2(n) / n if n else 0
    if not total or not base:
        return 1.0
    rest, entropy = [list(x) for x in lists], 0.0
    for i, own in enumerate(rest):
        for t in own:
            c = 1
            for other in rest[i + 1 :]:
                if t in other:
                    other.remove(t)
                    c += 1
            entropy -= c / n * log2(c / n)
    return 1 - entropy / base


def test_entropy(spark):
    rnd = random.Random(3)
    lists, clusters = {}, []
    for c in range(25):
        for m in range(rnd.randint(1, 5)):
            r = f"{c:02d}-{m}"
            lists[r] = [rnd.choice("ABC") for _ in range(rnd.randint(0, 4))] + [rnd.choice(["1", "D", "2"]) for _ in range(rnd.randint(0, 3))]
            clusters.append((f"{c:02d}-0", r))
    found, whole = ({r["clusterID"]: r["quality"] for r in quality.entropy_quality(spark.createDataFrame(clusters, "clusterID string, refID string"), refs_of(spark, lists), halves).collect()} for halves in (True, False))
    for cid in found:
        members = [lists[r] for c, r in clusters if c == cid]
        cut = [next((i for i, t in enumerate(m) if any(ch.isdigit() for ch in t)), len(m)) for m in members]
        name, address = [m[:k] for m, k in zip(members, cut)], [m[k:] for m, k in zip(members, cut)]
        if len(members) == 1:
            want = 1.0
        elif any(name) and any(address):
            want = 0.76 * slow_entropy(name) + 0.24 * slow_entropy(address)
        else:
            want = slow_entropy(name if any(name) else address)
        assert found[cid] == pytest.approx(want), cid
        assert whole[cid] == pytest.approx(slow_entropy(members) if len(members) > 1 else 1.0), cid


def test_corrections(spark):
    tokens = ["FIRST"] * 9 + ["SECOND"] * 8 + ["SMITH"] * 5 + ["SMIHT", "SMITT", "SMTIH", "JONES", "SECONDX"] + ["LASTONE"]
    refs = refs_of(spark, {"r": tokens})
    freq = stats.token_frequency(refs)
    words = spark.createDataFrame([("SMITT",)], "word string")
    found = {r["bad"]: r["std"] for r in correction.corrections(freq, Params(), words).collect()}
    assert found == {"SMIHT": "SMITH", "SMTIH": "SMITH", "SECONDX": "SECOND"}
    fixed = correction.apply_corrections(refs, spark.createDataFrame(list(found.items()), "bad string, std string")).first()
    assert fixed["n_changed"] == 3 and fixed["tokens"].count("SMITH") == 7
    known = spark.createDataFrame([("SMITH", "SMIHT"), ("A", "B")], "std string, variant string")
    learned = {r["std"]: r["variants"] for r in correction.learned_variants(known, spark.createDataFrame(list(found.items()), "bad string, std string")).collect()}
    assert learned == {"SMITH": ["SMIHT", "SMTIH"], "A": ["B"], "SECOND": ["SECONDX"]}


def test_a_long_token_is_corrected(spark):
    rnd = random.Random(13)
    long = "".join(rnd.choice("ABCDEFGH") for _ in range(20_000))
    typo = long[:5000] + long[5001] + long[5000] + long[5002:] if long[5000] != long[5001] else long[:5000] + "X" + long[5001:]
    refs = refs_of(spark, {"r": ["FIRST"] * 9 + ["SECOND"] * 8 + [long] * 5 + [typo, "LASTONE"]})
    assert {(r["bad"], r["std"]) for r in correction.corrections(stats.token_frequency(refs), Params()).collect()} == {(typo, long)}


def test_frequent_tokens_are_not_shuffled(spark):
    """They go where the rows are made; what is blocked and compared stays the same."""
    refs = refs_of(spark, {f"r{i}": ["COMMON", "COMMON", f"RARE{i // 2}", "1234"] for i in range(30)})
    freq = stats.token_frequency(refs)
    p = Params(beta=3, sigma=12)
    for rows, count in ((blocking.blocking_tokens(refs, freq, p), 30), (blocking.comparison_tokens(refs, freq, p), 30)):
        assert rows.count() == count
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" in plan and plan.index("LeftAnti") > plan.rindex("Join Inner" if "Join Inner" in plan else "Join LeftOuter, (t")
    kept = stats.without_heaviest(stats.token_rows(refs), freq, 12, most=1)
    assert {r["token"] for r in kept.select("token").distinct().collect()} == {f"RARE{i}" for i in range(15)} | {"1234"}


def test_corrections_are_broadcast_or_joined(spark):
    refs = refs_of(spark, {"a": ["X", "Y", "X"], "b": [], "c": ["Z"]})
    found = spark.createDataFrame([("X", "XX"), ("Z", "ZZ")], "bad string, std string")
    few, many = correction.apply_corrections(refs, found), correction.apply_corrections(refs, found, rows=1)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and {r["refID"]: r["n_changed"] for r in few.collect()} == {"a": 2, "b": 0, "c": 1}
    assert ["ResolvedHint" in x._jdf.queryExecution().analyzed().toString() for x in (few, many)] == [True, False]


def test_keys_of_corrections_are_not_broadcast(spark):
    """However small the files are that the tokens come from: their keys are many times as large."""
    tokens = ["FIRST"] * 9 + ["SECOND"] * 8 + ["SMITH"] * 5 + ["SMIHT", "LASTONE"]
    found = correction.corrections(stats.token_frequency(refs_of(spark, {"r": tokens})), Params())
    assert [tuple(r) for r in found.collect()] == [("SMIHT", "SMITH")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key#" in plan and "BroadcastHashJoin [key#" not in plan


def test_only_frequencies_that_drop_a_token_are_compared(spark):
    refs = refs_of(spark, {"a": ["OFTEN", "SELDOM", "UNKNOWN"], "b": []})
    freq = spark.createDataFrame([("OFTEN", 12), ("SELDOM", 11)], "token string, n long")
    rows = blocking.comparison_tokens(refs, freq, Params(sigma=12))
    assert {r["refID"]: r["tokens"] for r in rows.collect()} == {"a": ["SELDOM", "UNKNOWN"], "b": []}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">= 12") >= 2  # the most frequent tokens', and all others'


def fold(j, k, freq=None, aliases=None):
    f = Fold({"J": list(j), "K": list(k)}, dict(freq or {}), dict(aliases or {}))
    f.pair("J", "K")
    return f.lists["J"], f.lists["K"]


def test_block_rules():
    assert fold("A JONSON C".split(), "A JOHNSON C".split(), {"JONSON": 1, "JOHNSON": 4}) == ("A JOHNSON C".split(), "A JOHNSON C".split())
    assert fold("A JONSON C".split(), "A JOHNSON C".split(), {"JONSON": 2, "JOHNSON": 2}) == ("A JONSON C".split(), "A JOHNSON C".split())
    assert fold("A BO C".split(), "A ROBERT C".split(), aliases={"BO": "Robert"})[0] == "A ROBERT C".split()
    assert fold("MARTEN B C".split(), "MARTIN B C".split(), {"MARTEN": 3, "MARTIN": 3})[1][0] == "MARTEN"
    j, k = fold("DONALD AARON DWIGHT 6965".split(), "AARON DONALD DWIGHT 6965".split())
    assert k[:5] == "AARON DONALD AARON DWIGHT 6965".split()


def test_profile_and_metrics(spark):
    link = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", None), ("e", None)], "refID string, clusterID string")
    assert {tuple(r) for r in metrics.cluster_profile(link).collect()} == {(2, 2, 4), (1, 1, 1)}
    truth = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "refID string, truthID string")
    row = metrics.er_metrics(link, truth).first()
    assert (row["true_pairs"], row["expected_pairs"], row["linked_pairs"], row["precision"], row["recall"], row["f_measure"]) == (2, 4, 2, 1.0, 0.5, 0.6667)
    none = metrics.er_metrics(link.limit(0), truth).first()
    assert (none["precision"], none["recall"], none["f_measure"]) == (1.0, 1.0, 1.0)


def test_statistics_of_nothing(spark):
    row = stats.token_statistics(refs_of(spark, {"x": []})).first()
    assert (row["refs"], row["tokens"], row["unique_ratio"], row["std_len"]) == (1, 0, None, None)


def test_resolution(spark, tmp_path):
    lists = {
        "A1": "JOHN SMITH 12 MAPLE STREET".split(),
        "A2": "JOHN SMITH 12 MAPLE STREET".split(),
        "B1": "ALICE WONDER 7 HARBOUR LANE".split(),
        "B2": "ALICE WONDER 7 HARBOUR LANE".split(),
        "C1": "NOBODY KNOWS".split(),
    }
    p = Params(beta=4, sigma=6, mu=0.6, epsilon=0.5, comparator="ScoringMatrixKris", blockCorrection=True, runGlobalCorrection=True, runIterationProfile=True)
    truth = spark.createDataFrame([(r, r[0]) for r in lists], "refID string, truthID string")
    result = resolve(refs_of(spark, lists), p, truth=truth)
    assert {tuple(r) for r in result.link.collect()} == {("A1", "A1"), ("A2", "A1"), ("B1", "B1"), ("B2", "B1"), ("C1", "C1")}
    row = reports.report_row(result, metrics.er_metrics(result.link, truth)).first()
    assert len(row) == 41 and row["F-meas"] == 1.0
    assert len(reports.report_row(result, None).first()) == 41
    assert reports.run_log(result).count() > 3
    reports.write_link_index(result.link, str(tmp_path / "l"), result.refs)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert "RefID, ClusterID, Tokens" in lines and "A2, A1, JOHN SMITH 12 MAPLE STREET" in lines
    records = {r["clusterID"]: r["records"] for r in reports.cluster_json(result.link.select("clusterID", "refID"), result.refs).collect()}
    assert [tuple(x) for x in records["A1"]] == [("A1, A2", "JOHN SMITH", "12 MAPLE STREET")]


def test_comparators_end(spark):
    for c in ("ScoringMatrixStd", "MongeElkan", "Cosine"):
        lists = {"A": ["SMITH", "MAPLE"], "B": ["SMITH", "MAPLE"]}
        out = resolve(refs_of(spark, lists), Params(beta=2, comparator=c))
        assert {tuple(r) for r in out.link.collect()} == {("A", "A"), ("B", "A")}


def test_captures(spark):
    refs = refs_of(spark, {"A": ["X", "Y"], "B": ["X"], "C": []})
    truth = spark.createDataFrame([("A", "1"), ("B", "1")], "refID string, truthID string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "refID1 string, refID2 string")
    assert {(r["refID2"], r["tokens1"], r["truth"]) for r in reports.pair_capture(pairs, refs, truth).collect()} == {("B", "X, Y", 1), ("C", "X, Y", 0)}
    clusters = spark.createDataFrame([("C", "A"), ("C", "B"), ("C", "C")], "clusterID string, refID string")
    assert {(r["refID"], r["truth"]) for r in reports.cluster_capture(clusters, refs, truth).collect()} == {("A", 1), ("B", 1), ("C", 0)}
    assert [r["token"] for r in reports.token_capture(stats.token_frequency(refs)).collect()] == ["X", "Y"]
    assert reports.capture_path("out/", "people", "t", 3) == "out/people_t/iteration_03"
    assert [r[0] for r in reports.link_index_lines(spark.createDataFrame([("B", None), ("A", "A")], "refID string, clusterID string")).collect()] == ["A, A", "B, B"]
    assert reports.ref_capture(refs).where(F.col("refID") == "A").first()["tokens"] == "X, Y"


def test_scoring_over_turns(spark, tmp_path):
    """Every turn takes part in scoring and resolution; the SQL tells the results."""
    duckdb = pytest.importorskip("duckdb")
    texts = ["Alpha beta gamma delta", "alpha betta gamma zulu", "omega sigma kappa", "omega sigma kapa lambda", "nothing here", None, "sigma omega", "delta gamma beta"]
    rows = [(i // 3, i % 3, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("cosine_pairs", "kris_pairs", "std_pairs", "monge_pairs", "token_match_trace", "er_one_iteration", "er_clusters"):
        got = sorted(map(tuple, queries.QUERIES[f"{name}_turns"](spark, str(tmp_path)).collect()))
        want = sorted(con.execute(queries.turns_sql(name)).fetchall())
        assert len(want) > 2 and len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == (pytest.approx(y) if isinstance(y, float) else y) for x, y in zip(a, b, strict=True)), name
    for name in ("global_edits", "token_capture", "linked_pair_capture", "pair_comparison_cosine"):
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(con.execute(queries.ORACLES[name]).fetchall()), name
    assert {r["refID"] for r in queries.QUERIES["er_full"](spark, str(tmp_path)).collect()} >= {"000000000000", "000000020001"}


class SlowFold(Fold):
    """Looks at every two places of two lists, and measures distances in full."""

    @staticmethod
    def _typo(a, b):
        return len(a) > 2 and len(b) > 2 and int(damerau([a], [b])[0]) == 1

    def pair(self, first, second):
        j, k = self.lists[first], self.lists[second]
        if first == second or j == k:
            return
        seen_j, at = None, 0
        while at < len(j):
            lead, seen_k, other = j[at], None, 0
            while other < len(k):
                if lead == k[other]:
                    seen_j, seen_k = self._same_lead(j, at, k, other, lead, seen_j, seen_k)
                else:
                    self._other_lead(j, at, k, other, lead)
                other += 1
            at += 1


def slow_correction(lists, freq, pairs, aliases):
    f = SlowFold({r: list(t) for r, t in lists.items()}, dict(freq), dict(aliases))
    for a, b in sorted(set(pairs)):
        f.pair(a, b)
    return f.lists, sorted((old, new, n) for (old, new), n in f.edits.items())


@pytest.mark.parametrize(("seed", "tokens"), [(1, 150), (3, 100_000)])
def test_block_correction_equals_the_fold_over_all_pairs(spark, seed, tokens):
    rnd = random.Random(seed)
    words = ["SMITH", "SMYTH", "SMITT", "JONES", "JONS", "BOB", "ROBERT", "AB", "CD", "ABCD", "12", "34", "1234", "1243", "ROAD", "ROADS", "LANE", "X"]
    phrase = [rnd.choice(words) for _ in range(12)]
    lists = {}
    for i in range(60):
        t = list(phrase[rnd.randrange(4) : rnd.randrange(7, 13)])
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randrange(2)] = rnd.choice([[rnd.choice(words)], ["AB", "CD"], []])
            t = t or ["X"]
        lists[f"r{i:02d}"] = t
    freq = Counter(w for t in lists.values() for w in t)
    pairs = [tuple(sorted(rnd.sample(sorted(lists), 2))) for _ in range(150)] + [("r01", "r01")]
    aliases = {"BOB": "Robert", "X": "Lane"}
    refs = refs_of(spark, lists)
    out = correct_blocks(refs, stats.token_frequency(refs), spark.createDataFrame([*pairs, pairs[0]], "refID1 string, refID2 string").repartition(3), spark.createDataFrame(list(aliases.items()), "alias string, value string"), unit_tokens=tokens)
    want, edits = slow_correction(lists, freq, pairs, aliases)
    assert {r["refID"]: r["tokens"] for r in out.refs.collect()} == want
    assert sorted(map(tuple, out.edits.collect())) == edits and len(edits) > 5
    assert (out.rounds > 2) == (tokens < 1000)  # edits depended on those of other units


def test_fold_equals_the_slow_one_on_longer_lists():
    rnd = random.Random(8)
    for _ in range(300):
        words = ["AAA", "AAB", "ABA", "BAA", "AA", "A", "11", "12", "1112"][: rnd.randint(2, 9)]
        lists = {r: [rnd.choice(words) for _ in range(rnd.randrange(25))] for r in "JK"}
        freq = {w: rnd.randrange(4) for w in words}
        fast = Fold({r: list(t) for r, t in lists.items()}, dict(freq), {"AAA": "aa"})
        fast.pair("J", "K")
        slow, edits = slow_correction(lists, freq, [("J", "K")], {"AAA": "aa"})
        assert fast.lists == slow and sorted((*e, n) for e, n in fast.edits.items()) == edits


def test_slabs_hold_units_that_share_nothing_and_are_few():
    rnd = random.Random(2)
    for most, refs in ((60, 300), (100, 40), (5, 40)):
        size = {f"r{i:03d}": rnd.randint(1, 8) for i in range(refs)}
        pairs = sorted({tuple(sorted(rnd.sample(sorted(size), 2))) for _ in range(400)})
        rows = [(i, a, b, size[a], size[b]) for i, (a, b) in enumerate(pairs)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 90], strict=True)], names=list("sabnm")) for i in range(0, len(rows), 90)]
        out = [tuple(r.values()) for b in cut_slabs(most)(iter(batches)) for r in b.to_pylist()]
        assert [(a, b) for _, _, _, a, b in out] == pairs and [s for s, *_ in out] == sorted(s for s, *_ in out)
        units: dict = {}
        of: dict = {}
        for slab, unit, _, a, b in out:
            units.setdefault((slab, unit), set()).update((a, b))
            for x in (a, b):
                assert of.setdefault((slab, x), unit) == unit
        pair_of = Counter((s, u) for s, u, *_ in out)
        assert all(sum(size[x] for x in held) <= most or pair_of[key] == 1 for key, held in units.items())
        # of a sparse graph most units are small and stand beside others
        assert refs < 300 or len({s for s, _ in units}) < len(units) / 3


def test_places_after_edits_are_those_of_the_edited_list():
    rnd = random.Random(4)
    for gap in (Places.GAP, 4):
        for _ in range(200):
            p = Places([rnd.choice("ABC") for _ in range(rnd.randrange(12))])
            p.GAP = gap
            p._number()
            for _ in range(12):
                low = rnd.randrange(len(p.tokens) + 1)
                p.leads(("A", "B"))
                p.put(low, min(len(p.tokens), low + rnd.randrange(2)), [rnd.choice("ABC") for _ in range(rnd.randrange(3))])
                fresh = Places(list(p.tokens))
                for mine, want in ((p.of, fresh.of), (p.followed, fresh.followed), (p.leads(("A", "B")), fresh.leads(("A", "B")))):
                    assert {t: [p.at(x) for x in keys] for t, keys in mine.items()} == {t: [fresh.at(x) for x in keys] for t, keys in want.items()}


def test_block_correction_counts_what_units_beside_it_wrote(spark):
    # two units of one slab: the first writes SMYTH twice, so that in the second SMYTH outnumbers SMITH
    lists = {"a1": ["ONE", "SMYTT", "TWO"], "a2": ["ONE", "SMYTH", "TWO"], "a3": ["SIX", "SMYTT", "TEN"], "a4": ["SIX", "SMYTH", "TEN"], "b1": ["RED", "SMITH", "BLUE"], "b2": ["RED", "SMYTH", "BLUE"]}
    pairs = [("a1", "a2"), ("a3", "a4"), ("b1", "b2")]
    refs = refs_of(spark, lists)
    freq = spark.createDataFrame([("SMYTT", 1), ("SMYTH", 3), ("SMITH", 4)], "token string, n long")
    out = correct_blocks(refs, freq, spark.createDataFrame(pairs, "refID1 string, refID2 string"))
    want, edits = slow_correction(lists, {"SMYTT": 1, "SMYTH": 3, "SMITH": 4}, pairs, {})
    assert {r["refID"]: r["tokens"] for r in out.refs.collect()} == want and want["b1"][1] == "SMYTH"
    assert sorted(map(tuple, out.edits.collect())) == edits and out.rounds == 2


def test_block_correction_of_nothing(spark):
    refs = refs_of(spark, {"A": ["X"], "B": []})
    freq = stats.token_frequency(refs)
    for pairs in ([], [("A", "A")], [("A", "B")], [("A", "gone")]):
        out = correct_blocks(refs, freq, spark.createDataFrame(pairs, "refID1 string, refID2 string"))
        assert out.edits.count() == 0 and out.rounds == 1 and {r["refID"]: r["tokens"] for r in out.refs.collect()} == {"A": ["X"], "B": []}


def sheet_of(path):
    """The cells of a spreadsheet's first sheet."""
    name = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as z:
        assert set(z.namelist()) >= {"[Content_Types].xml", "_rels/.rels", "xl/workbook.xml", "xl/styles.xml"}
        root = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    assert [p.attrib["state"] for p in root.iter(f"{name}pane")] == ["frozen"]
    rows = []
    for number, row in enumerate(root.iter(f"{name}row"), 1):
        assert row.attrib["r"] == str(number)
        cells = []
        for c in row:
            v = c.find(f"{name}v")
            kind = c.attrib.get("t")
            cells.append("".join(t.text or "" for t in c.iter(f"{name}t")) if kind == "inlineStr" else None if v is None else v.text == "1" if kind == "b" else float(v.text))
        rows.append(cells)
    return rows


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "r.xlsx")
    df = spark.createDataFrame([("a <b> & \x01c", 1, 0.5, True), (None, None, float("nan"), None)], "s string, n long, x double, f boolean")
    reports.append_workbook(df.coalesce(1), path)
    reports.append_workbook(df.limit(1), path)
    first = ["a <b> &  c", 1.0, 0.5, True]
    assert sheet_of(path) == [["s", "n", "x", "f"], first, [None, None, "nan", None], first]
    df.limit(1).write.format("workbook").mode("overwrite").save(path)
    assert sheet_of(path) == [["s", "n", "x", "f"], first]
    with pytest.raises(Exception, match="at most"):
        reports.append_workbook(spark.range(workbook.ROWS).coalesce(1), path)
    assert len(sheet_of(path)) == 2


def test_runs_of_a_batch_overlap_and_fail_apart(spark, tmp_path, monkeypatch):
    (tmp_path / "list.txt").write_text("a.txt\nb.txt\nbad.txt\n")
    both, pools = threading.Barrier(2, timeout=60), []

    def one(spark, path, out, tag, **settings):
        if path.endswith("bad.txt"):
            raise ValueError("no such run")
        both.wait()  # passes only while two runs are going on
        pools.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return path, spark.createDataFrame([(tag,)], "Sample string")

    monkeypatch.setattr(run, "_run", one)
    found = batch(spark, str(tmp_path / "list.txt"), str(tmp_path / "out"), tag="t")
    assert [o.result and o.result[-5:] for o in found] == ["a.txt", "b.txt", None] and str(found[2].error) == "no such run" and sorted(pools) == ["t1", "t2"]
    assert sheet_of(tmp_path / "out/report.xlsx") == [["Sample"], ["t1"], ["t2"]]


def test_the_log_starts_no_job(spark):
    lists = {"A1": "JOHN SMITHE 12 MAPLE".split(), "A2": "JOHN SMITHE 12 MAPLE".split(), "A3": "JOHN SMITHEE 12 MAPLE".split(), "B1": ["LONELY"]}
    truth = spark.createDataFrame([("A1", "1"), ("A2", "1"), ("B1", "2")], "refID string, truthID string")
    p = Params(beta=4, sigma=6, mu=0.6, comparator="ScoringMatrixKris", blockCorrection=True, runGlobalCorrection=True, runIterationProfile=True)
    result = resolve(refs_of(spark, lists), p, truth=truth)
    spark.sparkContext.setJobGroup("the log", "")
    log = reports.run_log(result)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("the log")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {(r["stage"], r["iteration"], r["name"]): r["value"] for r in log.collect()}
    want = stats.token_statistics(result.refs_read).first().asDict()
    assert {k[2]: v for k, v in found.items() if k[0] == "tokens_read"} == pytest.approx({k: None if v is None else float(v) for k, v in want.items()})
    step = result.iterations[0]
    assert found["iteration", 1, "pairs"] == step.pairs.count() and found["iteration", 1, "links"] == step.links.count() and found["iteration", 1, "clustered"] == step.clusters.count()
    assert found["quality", 1, "clusters"] == step.quality.count() and found["clusters", 0, "refs"] == 4 and found["blocking", 1, "expected_pairs"] == 1
    assert ("end", len(result.iterations), result.ended) in found


def test_a_lost_run_goes_on_after_its_last_round(spark, tmp_path, monkeypatch):
    lists = {f"A{i}": ["JOHN", "SMITHE", "MAPLE", f"X{i // 2}YZ"] for i in range(4)} | {"B1": ["ALICE", "WONDER", "LANE"], "B2": ["ALICE", "WONDAR", "LANE"], "B3": ["ALICE", "WONDER", "ROAD"], "C": ["NOBODY"]}
    refs = refs_of(spark, lists)
    truth = spark.createDataFrame([("A0", "1"), ("A1", "1"), ("B1", "2"), ("B2", "2")], "refID string, truthID string")
    p = Params(beta=6, sigma=9, mu=0.5, muIterate=0.2, epsilon=0.9, blockCorrection=True, runIterationProfile=True, comparator="ScoringMatrixKris", removeExcludedBlkTokens=False)
    whole = resolve(refs, p, truth=truth)
    assert len(whole.iterations) > 1
    folder, before = str(tmp_path / "rounds"), resolving._round

    def lost(out, store, number, *rest):
        if number == 2:
            before(out, store, number, *rest)  # a round without a manifest
            raise RuntimeError("the driver is lost")
        return before(out, store, number, *rest)

    monkeypatch.setattr(resolving, "_round", lost)
    with pytest.raises(RuntimeError, match="lost"):
        resolve(refs, p, truth=truth, folder=folder)
    monkeypatch.setattr(resolving, "_round", before)
    for again in (resolve(refs.limit(0), p, truth=truth, folder=folder), resolve(refs.limit(0), p, truth=truth, folder=folder)):
        assert sorted(map(tuple, again.link.collect())) == sorted(map(tuple, whole.link.collect())) and again.ended == whole.ended
        assert sorted(map(str, reports.run_log(again).collect())) == sorted(map(str, reports.run_log(whole).collect()))
        for a, b in zip(again.iterations, whole.iterations, strict=True):
            assert [sorted(map(str, x.collect())) if x is not None else None for x in (a.pairs, a.links, a.clusters, a.quality, a.link, a.metrics, a.profile, a.blocked)] == [sorted(map(str, x.collect())) if x is not None else None for x in (b.pairs, b.links, b.clusters, b.quality, b.link, b.metrics, b.profile, b.blocked)]
    other = resolve(refs, p.with_(mu=0.9), truth=truth, folder=folder)  # other parameters start anew
    assert other.iterations[0].mu == 0.9


def test_lines_are_numbered_over_files_and_blocks(spark, tmp_path):
    """Small blocks, so that each file is read by several tasks; every file has its header."""
    folder, want = tmp_path / "refs", []
    folder.mkdir()
    for name, n, end in (("b.txt", 300, "\r\n"), ("a.txt", 500, "\n"), ("c.txt", 0, "\n"), ("d.txt", 200, "\r")):
        lines = ["RecID,text"] + [f"{name[0]}{i % 70},\tBODY {i} \t" for i in range(n)]
        (folder / name).write_bytes(end.join(lines).encode())
    for name, n in (("a", 500), ("b", 300), ("d", 200)):
        want += [(f"{name}{i % 70}", f"\tBODY {i}") for i in range(n)]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        rows = read_references(spark, str(folder), ",", True)
        few, many = (numbered_lines(spark, str(folder), few=n).orderBy("ord").collect() for n in (0, 100))
        assert few == many and [r["ord"] for r in few] == list(range(1004)) and sum(r["first"] for r in few) == 4
        assert [(r["refID"], r["body"]) for r in rows.orderBy("ord").collect()] == want
        last = {}
        for ref, body in want:
            last[ref] = body.split()
        assert {r["refID"]: r["tokens"] for r in resolve_duplicates(stats.tokenize(rows, Params())).collect()} == last
    finally:
        spark.conf.set(key, before)


def test_totals(spark):
    link = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", None), ("e", None)], "refID string, clusterID string")
    assert {tuple(r) for r in metrics.profile_with_total(link).collect()} == {(2, 2, 4), (1, 1, 1), (None, 3, 5)}
    truth = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "refID string, truthID string")
    assert {tuple(r) for r in metrics.pair_sets(link, truth).collect()} == {("cluster", 3, 5, 2, 2), ("truth", 2, 5, 3, 4), ("both", 3, 5, 2, 2)}


def test_batch_of_parameter_files(spark, tmp_path):
    """Two files are run; every capture, report and log can be read."""
    lines = ["RecID,name,street", "A1,JOHN SMITHE,12 MAPLE STREET", "A2,JOHN SMITHE,12 MAPLE STREET", "B1,ALICE WONDER,7 HARBOUR LANE", "B2,ALICE WONDEER,7 HARBOUR LANE", "C1,NOBODY KNOWS,"]
    lines += [f"D{i},WONDER PARK,{i}{i} X{i}" for i in range(5)]
    (tmp_path / "people.txt").write_text("\n".join(lines))
    (tmp_path / "truth.csv").write_text("RecID,truth\nA1,1\nA2,1\nB1,2\nB2,2\nC1,3\n")
    shared = "inputFileName=people.txt\nhasHeader=True\nbeta=4\nsigma=9\nmu=0.6\nmuIterate=0.2\n"
    (tmp_path / "one.txt").write_text(shared + "truthFileName=truth.csv\naddRefsToLinkIndex=True\nrunIterationProfile=True\nrunGlobalCorrection=True\nglobalCorrectionDetail=True\nlearnTokenVariants=True\nblockCorrection=True\nblockCorrectionDetail=True\ncomparator=ScoringMatrixKris\n")
    (tmp_path / "two.txt").write_text(shared + "comparator=Cosine\n")
    (tmp_path / "list.txt").write_text("one.txt\ntwo.txt\n\nnone.txt\n")
    results = batch(spark, str(tmp_path / "list.txt"), str(tmp_path / "out"), tag="t")
    assert [(r.path, r.error) for r in results] == [("one.txt", None), ("two.txt", None)]
    sheet = sheet_of(tmp_path / "out/report.xlsx")
    assert sheet[0] == list(reports.REPORT_COLUMNS) and [r[0] for r in sheet[1:]] == ["people.txt"] * 2 and sheet[2][1] is None and sheet[1][1] == 1.0
    one, two = tmp_path / "out/people_t1", tmp_path / "out/people_t2"

    def table(folder, name):
        return [r.asDict() for r in spark.read.option("header", True).csv(str(folder / name)).collect()]

    text = [r[0] for r in spark.read.text(str(one / "link_index")).collect()]
    assert "RefID, ClusterID, Tokens" in text and "B2, B1, ALICE WONDER 7 HARBOUR LANE" in text
    assert "RefID, ClusterID" in [r[0] for r in spark.read.text(str(two / "link_index")).collect()]
    assert table(one, "global_edits") == [{"old": "WONDEER", "new": "WONDER", "n": "1"}]
    assert {tuple(r) for r in read_variants(spark, str(one / "variants")).collect()} == {("WONDER", "WONDEER")}
    assert spark.read.csv(str(one / "block_edits")).count() == 0 or table(one, "block_edits") == []
    log = {(r["stage"], r["iteration"], r["name"]): r["value"] for r in table(one, "log")}
    assert float(log["global_correction", "0", "edits"]) == 1 and float(log["global_correction", "0", "refs_changed"]) == 1
    assert float(log["tokens_read", "0", "refs"]) == 10 and ("tokens_corrected", "0", "tokens") in log and ("quality", "1", "good_clusters") in log and ("blocking", "1", "precision") in log and ("metrics", "1", "f_measure") in log
    assert table(one, "report")[0]["Sample"] == "people.txt" and table(two, "report")[0]["precision"] is None
    first = one / "iteration_01"
    assert {(r["refID1"], r["refID2"], r["truth"]) for r in table(first, "linked_pairs")} >= {("A1", "A2", "1"), ("B1", "B2", "1")}
    assert {r["refID"] for r in table(first, "clusters")} >= {"A1", "A2"}
    for name in ("block_pairs", "pairs_before_correction", "comparison", "token_matches", "link", "profile", "metrics"):
        assert table(first, name), name
    assert spark.read.json(str(first / "cluster_json")).count() and not (two / "iteration_01" / "token_matches").exists() and not (two / "global_edits").exists()
    assert table(one, "refs") and table(one, "token_freq") and table(one, "profile") and table(one, "metrics")


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    from quillmatch.plans.staging import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert shared_folder(spark)


def test_pairs_are_scored_once_for_all_rounds(spark, monkeypatch):
    """Later rounds go on with the pairs and scores of the first whose references are still open."""
    from quillmatch.plans import resolve as plan

    calls = Counter()

    def seen(name, f):
        def run(*args, **kwargs):
            calls[name] += 1
            return f(*args, **kwargs)

        monkeypatch.setattr(plan, name, run)

    seen("score", plan.score)
    seen("candidate_pairs", plan.candidate_pairs)
    tokens = {f"r{i}": [f"ANNA{i // 2}", f"SMITH{i // 2}", f"STREET{i // 2}", *(["ODD", "EVEN"][i % 2] + str(i) for _ in range(i // 2))] for i in range(8)}
    p = Params(beta=6, sigma=12, minBlkTokenLen=4, comparator="ScoringMatrixKris", mu=0.5, muIterate=0.2, epsilon=0.9, blockCorrection=False)
    out = resolve(refs_of(spark, tokens), p)
    assert len(out.iterations) > 1 and calls == {"score": 1, "candidate_pairs": 1}
    for step in out.iterations:
        assert step.pairs.columns == ["refID1", "refID2"] and step.links.where(f"score < {step.mu}").count() == 0
