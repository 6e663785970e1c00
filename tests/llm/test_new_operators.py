"""Quality by attention, divergence of sources and whitening against slow versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmatch.llm import bottom_k, decontamination, language_id, passage_attention, source_divergence, suffix_tree, token_counts, toxicity, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# --- op11 ----------------------------------------------------------------------------------------


def prose(rnd, n):
    return " ".join("".join(rnd.choice(["ka", "lo", "mi", "tu", "ré", "sch", "ön", "e"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def junk(rnd, n):
    return " ".join(w + rnd.choice(["&&&", "%%%", "###"]) for w in prose(rnd, n).split())


def slow_score(model, text):
    """A text's score passage by passage and byte by byte."""
    if not text or not text.strip():
        return model.prior
    raw, size = bytes(48 if 48 <= b <= 57 else b for b in text), passage_attention.PASSAGE
    hidden = []
    for piece in (raw[i : i + size * passage_attention.PIECE] for i in range(0, len(raw), size * passage_attention.PIECE)):
        many = max((len(piece) + size // 2) // size, 1)
        padded = b"\n\n" + piece
        counts, kinds = [[0] * (2 * passage_attention.BUCKETS) for _ in range(many)], [[0] * passage_attention.KINDS for _ in range(many)]
        for i in range(len(piece)):
            p = min(i // size, many - 1)
            c, b, a = padded[i], padded[i + 1], padded[i + 2]
            counts[p][((b * 257 + a) * 0x9E3779B1 & 0xFFFFFFFF) >> 22] += 1
            counts[p][passage_attention.BUCKETS + ((c * 66049 + b * 257 + a + 7) * 0x85EBCA77 & 0xFFFFFFFF) % (1 << 32) // (1 << 22)] += 1
            kinds[p][passage_attention._KIND[a]] += 1
        for x, k in zip(counts, kinds, strict=True):
            x = np.minimum(x, 255)
            n, half = max(sum(k), 1), passage_attention.BUCKETS
            own = [v / n for v in k] + [np.log1p(n), (x[:half] > 0).sum() / n, (x[half:] > 0).sum() / n, x[half:].max() / n]
            f = np.sqrt(x) / np.sqrt(x.sum())
            w = model.net.w
            hidden.append(np.tanh(np.concatenate([f, (np.array(own) - model.mean) / model.scale * 0.3]) @ w["encode"] + w["shift"]))
    weights = np.array([np.exp((np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"]) for h in hidden])
    z = sum(a * h for a, h in zip(weights / weights.sum(), hidden, strict=True))
    return 1 / (1 + np.exp(-(model.slope * (z @ w["score"] + w["bias"][0]) + model.offset)))


def bags(n=80):
    rnd = random.Random(5)
    return [((junk if i % 3 == 0 else prose)(rnd, rnd.randint(5, 300)), int(i % 3 > 0)) for i in range(n)]


def test_quality_model_equals_a_slow_one():
    model = passage_attention.Model([(t.encode(), y) for t, y in bags()])
    rnd = random.Random(6)
    texts = [prose(rnd, 400), junk(rnd, 90), "A1 b2", " ", "", None, "x" * 3000, prose(rnd, 30) + " 2024 " + junk(rnd, 100)]
    raw = [None if t is None else t.encode() for t in texts]
    assert np.allclose(model(raw), [slow_score(model, t) for t in raw], atol=1e-4)
    assert model(raw[:1]) == [pytest.approx(model(raw)[0], abs=1e-5)]  # whatever is scored beside it


def test_quality_of_a_text_of_many_pieces(monkeypatch):
    monkeypatch.setattr(passage_attention, "PIECE", 3)
    model = passage_attention.Model([(t.encode(), y) for t, y in bags(30)])
    long = prose(random.Random(7), 2000).encode()
    assert model([long, b"a b"])[0] == pytest.approx(slow_score(model, long), abs=1e-4)


def test_gradient():
    rng = np.random.default_rng(1)
    net = passage_attention.Attention(7)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, size, y, weight = rng.normal(size=(9, 7)), np.array([4, 1, 4]), np.array([1.0, 0.0, 0.0]), np.array([0.5, 1.0, 2.0])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(net.encode(x), size)))
        return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

    for k, g in net.gradient(x, size, y, weight).items():
        flat = net.w[k].reshape(-1)
        for i in range(0, flat.size, 5):
            own = flat[i]
            flat[i] = own + 1e-5
            up = loss()
            flat[i] = own - 1e-5
            assert g.reshape(-1)[i] == pytest.approx((up - loss()) / 2e-5, abs=1e-4), k
            flat[i] = own


def test_quality(spark):
    known = bags(150)
    texts = [t for t, _ in known] + [None, "", " \n", known[0][0], "word " * 200_000]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a b c", None, None, None)]
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(known)] + [(150, None, 1), (0, 0, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, score int")
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(1))
    held = F.col("doc_id") % 4 == 1
    got = {r["doc_id"]: r for r in passage_attention.score(docs, labels, held).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    test = [i for i in range(150) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == known[i][1] for i in test) >= 0.95 * len(test)
    assert [got[i]["predicted"] for i in (150, 151, 152)] == [0, 0, 0] and got[153]["score"] == pytest.approx(got[0]["score"], abs=1e-6)
    assert got[None]["held_out"] is False
    assert {r["score"] for r in passage_attention.score(docs, labels.limit(0), held).collect()} == {0.0}
    assert passage_attention.score(docs.limit(0), labels, held).count() == 0


def test_a_sample_is_bounded_for_either_label(spark):
    docs = spark.createDataFrame([(i, "ab" * (i % 5 + 1), "en", "s", 0) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    toxic, quality = (toxicity.sample(docs, labels, F.lit(True), 7, 1000, c) for c in ("toxic", "quality"))
    assert sorted((t, 1 - y) for t, y in toxic) == sorted(quality) and Counter(y for _, y in quality) == {0: 7, 1: 7}


# --- op12 ----------------------------------------------------------------------------------------


def slow_divergence(rows, least, top):
    docs = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for text, lang, source in docs]
    df, groups = defaultdict(Counter), {(lang, s) for lang, s, _ in found}
    for lang, _, ws in found:
        df[lang].update(set(ws))
    kept = {lang: [t for t, k in df[lang].items() if k >= least] for lang, _ in groups}
    n = defaultdict(Counter)
    for lang, s, ws in found:
        n[lang, s].update(w for w in ws if w in set(kept[lang]))
        n[lang].update(w for w in ws if w in set(kept[lang]))

    def shares(key, lang):
        total, v = sum(n[key].values()), len(kept[lang])
        return {t: 1 + 1_000_000_000 * (n[key][t] + 5) // (total + 5 * v) for t in kept[lang]}

    out = []
    for lang, s in groups:
        p, q = shares((lang, s), lang), shares(lang, lang)
        pairs = [(sum(abs(p[t] - o[t]) for t in p), x) for g, x in groups if g == lang and x != s for o in [shares((lang, x), lang)]]
        terms = [(p[t] - q[t], t) for t in p if n[lang, s][t] > 0 and p[t] > q[t]]
        for part, ranked in (("pair", pairs), ("term", terms)):
            ranked = sorted(ranked, key=lambda r: (-r[0], r[1].encode()))
            out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("chunk", [400_000, 20])
def test_divergence(spark, chunk):
    rnd = random.Random(9)
    words = ["Alpha", "beta", "é", "ÉA", "gamma", "x", "zeta", "eta", "日本", "iota"]
    rows = [(" ".join(rnd.choice(words[: 4 + i % 7]) + rnd.choice(["", ".", "1"]) for _ in range(rnd.randint(0, 30))), rnd.choice(["de", "en", None]), rnd.choice(["s1", "s2", "s3", None])) for i in range(120)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("12 +", "xx", "only"), ("beta " * 20_000, "en", "s1"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i // 2, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").withColumn("item", F.lit("clash")).withColumn("rank", F.lit(0))
    got = source_divergence.divergence(docs.repartition(5), least_docs=6, top=3, chunk=chunk)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == slow_divergence(rows, 6, 3)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert source_divergence.divergence(docs.limit(0)).count() == 0


# --- op13 ----------------------------------------------------------------------------------------


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 20)) * np.linspace(0.2, 3, 20)
    vectors = [r.tolist() for r in base] + [base[0].tolist(), base[0].tolist()]
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    bad = [(100, None, 1), (101, [None] + [0.0] * 19, 1), (102, [float("nan")] + [0.0] * 19, 1), (103, [float("inf")] + [0.0] * 19, 1), (104, [], 1), (105, [1.0, 2.0], 1), (106, [1e300] + [0.0] * 19, 1)]
    table = spark.createDataFrame(rows + [(None, vectors[1], 1), (7, vectors[2], 1)] + bad, "vec_id long, embedding array<double>, n int").withColumn("component", F.lit("clash"))
    got = whitening.whiten(table.repartition(3)).collect()
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    c = (n * fit - total) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 64 * 16 and {r["n"] for r in got} == {60} and {r["component"] for r in got} == set(range(1, 17))
    sign = {}
    for r in got:
        i = r["vec_id"] if r["vec_id"] is not None else 1
        if i == 7:
            continue  # an id with two vectors
        k = r["component"] - 1
        want = (n * x[i] - total) / n @ u[:, k] / np.sqrt(e[k])
        sign.setdefault(k, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] == pytest.approx(sign[k] * want, abs=1e-9)
        assert r["deviation"] == ((n * x[i] - total) ** 2).sum()
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9 and r["residual"] <= whitening.TOLERANCE


def test_whitening_of_few_and_of_equal_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 3.0]), (3, [3.0, 4.0])], kind)).orderBy("vec_id").collect()
    assert [r["component"] for r in got] == [1, 1, 1] and [round(r["whitened"], 6) for r in got] == [-1.224745, 0.0, 1.224745] and [r["deviation"] for r in got] == [2 * 192**2, 0, 2 * 192**2]


def test_deviations_beyond_machine_words():
    x, n, total = np.array([[1 << 61, 3], [5, 6]]), 3, [7, 9]
    assert whitening._deviations(x, n, total).to_pylist() == [None, (15 - 7) ** 2 + (18 - 9) ** 2]
    assert whitening._deviations(x[1:], n, total).to_pylist() == [145]


@pytest.mark.parametrize("spectrum", [np.linspace(1, 2, 150), 1 / np.arange(1, 151.0), np.r_[np.ones(30), np.full(120, 0.5)], np.r_[5.0, np.zeros(149)]])
def test_lobpcg_finds_leading_eigenvectors(spectrum):
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(150, 150)))[0]
    a = (q * spectrum) @ q.T
    e, u, _, residual = whitening.lobpcg(lambda b: a @ b, 150, 8, 4)
    assert np.allclose(e, np.sort(spectrum)[::-1][:8], atol=1e-11) and residual.max() <= whitening.TOLERANCE
    assert np.abs(a @ u - u * e).max() < 1e-11 and np.allclose(u.T @ u, np.eye(8), atol=1e-12)


# --- op5: any number of languages ------------------------------------------------------------------


def tongue(seed):
    """A made-up language: a function that writes a text of so many words."""
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 3))) for _ in range(14)]
    return lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def slow_machine(x, y, cost=10.0, steps=150):
    """The same descent, row by row, in double precision."""
    share = {1.0: sum(v > 0 for v in y), -1.0: sum(v < 0 for v in y)}
    w = v = np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        g = np.append(1e-3 * v[:-1], 0.0)
        for row, side in zip(x, y, strict=True):
            short = max(0.0, 1 - side * (row @ v[:-1] + v[-1])) * 0.5 * cost / share[side] * side
            g -= 2 * short * np.append(row, 1.0)
        new = v - g / (1e-3 + 4 * cost)
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def slow_identify(step, families_below, x):
    """Language and score of features x by counting votes one by one, down the steps."""
    wins, margins, lead = Counter(), Counter(), {}
    k = 0
    for i in range(step.votes.count):
        for j in range(i + 1, step.votes.count):
            m = sum(float(a) * float(b) for a, b in zip(x, step.votes.weights[:-1, k], strict=True) if a) + float(step.votes.weights[-1, k])
            wins[i if m >= 0 else j] += 1
            margins[i] += m
            margins[j] -= m
            lead[i, j], lead[j, i] = m, -m
            k += 1
    best = max(range(step.votes.count), key=lambda c: (wins[c], margins[c]))
    p = min((1 / (1 + np.exp(-4 * np.clip(lead[best, c], -10, 10))) for c in range(step.votes.count) if c != best), default=1.0)
    below = step.below[best]
    if isinstance(below, str):
        return below, p
    lang, q = slow_identify(below, families_below, x)
    return lang, p * q


def test_machines_and_votes_equal_slow_ones(monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(20, 9)).astype(np.float32), np.repeat([1.0, -1.0], [8, 12])
    found = language_id.machine(x, y, steps=40)
    monkeypatch.setattr(language_id, "FEW", 0)
    assert np.allclose(found, language_id.machine(x, y, steps=40), atol=1e-3) and np.allclose(found, slow_machine(x, y, steps=40), atol=1e-3)


def test_language_of_many_codes_step_by_step():
    tongues = {f"q{i:02d}": tongue(i) for i in range(40)}
    texts = [(lang, write(60).encode()) for lang, write in tongues.items() for _ in range(6)]
    model = language_id.Model(texts)
    machines = 0
    steps = [model.first]
    while steps:
        s = steps.pop()
        machines += s.votes.weights.shape[1]
        assert s.votes.count <= language_id.MOST
        steps += [b for b in s.below if not isinstance(b, str)]
    assert machines <= 5 * len(tongues)
    fresh = [(lang, write(50).encode()) for lang, write in tongues.items()]
    assert sum(model(t)[0] == lang for lang, t in fresh) >= 0.95 * len(fresh)
    for _, t in fresh[:6]:
        lang, score = slow_identify(model.first, None, language_id.features(t))
        assert model(t) == (lang, pytest.approx(score, abs=1e-4))


def test_language_sample_is_bounded_in_all(spark):
    rows = [(i, f"q{i % 50}", "x" * 1000) for i in range(500)]
    found = language_id.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True), total=100, least=1, total_bytes=150_000)
    assert {n for n in Counter(lang for lang, _ in found).values()} == {2}
    few = language_id.sample(spark.createDataFrame(rows, "doc_id long, lang string, text string"), F.lit(True), total=1000, total_bytes=150_000)
    assert sum(len(t) for _, t in few) <= 150_000


# --- op1: a long item ------------------------------------------------------------------------------


def test_a_long_item_is_spread_over_blocks(spark):
    rnd = random.Random(1)
    w = [f"w{rnd.randrange(3000)}" for _ in range(20_000)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "a b c"), (3, " ".join(w[500:600])), (4, None), (5, "")], "item_id long, text string")
    sizes = [i.size for i in decontamination.blocks(bench, 10, 7000)]
    assert max(sizes) <= 7000 and len(sizes) == 3
    docs = spark.createDataFrame([(1, " ".join(["x", *w[495:620], "y"])), (2, " ".join(w[6990:7020])), (3, " ".join(w[:9])), (4, "z a b c z")], "doc_id long, text string")
    few, many = ({r["doc_id"]: r for r in decontamination.decontaminate(docs, bench, block_windows=n).collect()} for n in (7000, 100_000))
    assert few == many and [few[i]["n_hit"] for i in (1, 2, 3, 4)] == [125, 30, 0, 3] and [few[i]["n_items"] for i in (1, 2, 3, 4)] == [2, 1, 0, 1]


# --- very long texts, null and repeated ids ----------------------------------------------------------


def long_texts(spark):
    """A text of 200,000 words, one word of a megabyte, and small ones, with null and repeated ids."""
    rnd = random.Random(14)
    many = prose(rnd, 200_000)
    rows = [(1, many), (2, "x" * 1_000_000), (3, "ka lo mi"), (3, "ka lo mi"), (3, "tu ré"), (None, "ka lo"), (4, None), (5, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_long_texts_in_toxicity(spark):
    rows, docs = long_texts(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    found = toxicity.score(docs, labels, F.col("doc_id") == 5).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    same = [r["score"] for r in found if r["doc_id"] == 3]
    assert len(same) == 3 and len(set(same)) <= 2


def test_long_texts_in_the_suffix_tree(spark):
    rows, docs = long_texts(spark)
    found = suffix_tree.score(docs, F.col("doc_id") == 5).collect()
    assert sorted((r["n_tokens"] for r in found), reverse=True)[0] == 200_001 and len(found) == len(rows)
    assert all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in found)


def test_long_texts_in_fingerprints(spark):
    rows, docs = long_texts(spark)
    found = bottom_k.fingerprints(docs).collect()
    assert sorted(r["n_chars"] for r in found) == sorted(len(t or "") for _, t in rows)
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 3}) == 2


def test_long_texts_in_token_counts(spark):
    """Edits of a long text, of a megabyte of one letter, and of rows that share an id or have none,
    against encoding the edited text anew."""
    rows, docs = long_texts(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    edits = spark.createDataFrame([(1, [(600_000, 4, " new ")]), (2, [(500_000, 2, "y")]), (3, [(0, 2, "")]), (None, [(0, 0, "a")]), (9, [(0, 0, "b")])], "doc_id long, edits array<struct<at:long,removed:long,inserted:string>>")
    found = token_counts.count_edited(docs, edits, path).collect()
    tokenizer = Tokenizer.from_file(path)
    known = {1: (600_000, 4, " new "), 2: (500_000, 2, "y"), 3: (0, 2, "")}
    want = []
    for i, t in rows:
        t = t or ""
        at, removed, inserted = known.get(i, (0, 0, ""))
        want.append((i is None, i or 0, len(tokenizer.encode(t, add_special_tokens=False).ids), len(tokenizer.encode(t[:at] + inserted + t[at + removed :], add_special_tokens=False).ids)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["edited_tokens"]) for r in found) == sorted(want)
    assert token_counts.count_edited(docs.limit(0), edits, path).count() == 0


def test_words_that_are_remembered_are_bounded():
    e = toxicity.Evidence(Counter({b"bad": 3}), Counter({b"good": 3}))
    words = [f"w{i}".encode() for i in range(50)] + [b"x" * 100, b"bad"]
    want = e.of_words(words).tolist()
    for _ in range(3):
        for i in range(0, len(words), 7):
            assert e(words[i : i + 7], room=10).tolist() == pytest.approx(want[i : i + 7])
        assert len(e.known) <= 10 + 7 and max(map(len, e.known)) <= 64
