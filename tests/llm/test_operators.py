"""The training-data operators against brute force, on small fixtures with nulls, empty texts, ties,
repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import bottom_k, chosen_path, decontamination, language_id, packing, sentence_spans, suffix_tree, token_counts, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def vocabulary(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["ka", "lo", "mi", "tu", "ré", "sch", "ön", "e"]) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def prose(rnd, words, n):
    out = []
    while len(out) < n:
        s = [rnd.choice(words) for _ in range(rnd.randint(3, 9))]
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n])


# --- op1 -----------------------------------------------------------------------------------------


def slow_hits(doc, items, window=10):
    w = decontamination.words(doc.encode()) if doc else []
    hit, found = set(), set()
    for item, text in items:
        x = decontamination.words(text.encode()) if text else []
        m = min(window, len(x))
        runs = {tuple(x[i : i + m]) for i in range(len(x) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in runs:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(w), len(hit), found


@pytest.mark.parametrize("block", [10_000, 3])
def test_decontamination(spark, block):
    rnd = random.Random(2)
    words = ["a", "b", "ç", "d1"]
    docs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) for _ in range(40)] + [None, "", "A-B  Ç,D1", "A-B  Ç,D1"]
    items = [(str(i), " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([12, 14, 3, 2, 11, 0])] + [("9", None), ("9", "a b")]
    bench = spark.createDataFrame([(int(i), t, 1) for i, t in items], "item_id long, text string, n_hit int")
    df = frame(spark, docs).withColumn("n_words", F.lit("clash"))
    got = {(r["doc_id"]): r for r in decontamination.decontaminate(df, bench, block_windows=block).collect()}
    for i, d in enumerate(docs):
        n, hit, found = slow_hits(d, items)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontamination.decontaminate(df.limit(0), bench).count() == 0
    assert decontamination.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


# --- op2, op5 --------------------------------------------------------------------------------------


def test_toxicity(spark):
    rnd = random.Random(4)
    words, bad = vocabulary(300), ["grumbul", "grumbach", "zyxer"]
    texts, labels = [], []
    for i in range(240):
        t = prose(rnd, words, rnd.randint(20, 80)).split()
        y = int(i % 3 == 0)
        for _ in range(3 if y else 0):
            t[rnd.randrange(len(t))] = rnd.choice(bad)
        texts.append(" ".join(t))
        labels.append((i, y))
    texts += [None, "", "...", texts[0]]
    labels += [(241, None), (0, 1), (0, 0), (None, 1), (999, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.col("doc_id") % 4 == 1
    rows = toxicity.score(frame(spark, texts).withColumn("score", F.lit("clash")), lab, held).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["doc_id"] < 240 and r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in test) >= 0.95 * len(test)
    assert [rows[i]["predicted"] for i in (240, 241, 242)] == [0, 0, 0] and rows[243]["score"] == rows[0]["score"]
    assert {r["score"] for r in toxicity.score(frame(spark, texts[:3]), lab.limit(0), held).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), lab, held).count() == 0


def slow_evidence(toxic, ordinary, word):
    """Toxic less ordinary log-likelihood of a word's spelling, by definition: n-grams of bytes over
    padded words, a discounted class count at the highest order, below it continuation counts."""
    order = toxicity.ORDER

    def grams(w):
        x = b" " * (order - 1) + w + b" "
        return [x[i : i + order] for i in range(len(w) + 1)]

    levels = [{g for w in {*toxic, *ordinary} for g in grams(w)}]
    for _ in range(order - 1):
        levels.append({g[1:] for g in levels[-1]})

    def shared(g):
        if not g:
            return 1 / 256
        above = levels[order - len(g) - 1]
        same = Counter(x[1:] for x in above)
        ctx = {k: c for k, c in same.items() if k[:-1] == g[:-1]}
        if not ctx:
            return shared(g[1:])
        return (max(ctx.get(g, 0) - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(ctx) * shared(g[1:])) / sum(ctx.values())

    def logp(counts, g):
        c = Counter()
        for w, n in counts.items():
            for x in grams(w):
                c[x] += n
        total = sum(n for x, n in c.items() if x[:-1] == g[:-1])
        own = {x: max(n - toxicity.CLASS_DISCOUNT, 0) / total for x, n in c.items() if x[:-1] == g[:-1]} if total else {}
        return np.log(own.get(g, 0) + (1 - sum(own.values())) * shared(g[1:]))

    return sum(logp(toxic, g) - logp(ordinary, g) for g in grams(word))


def test_evidence_against_definition():
    """Every likelihood ratio of words that are seen, in part or not at all, is the slow one."""
    rnd = random.Random(36)
    some = [w.encode() for w in vocabulary(40, seed=5)]
    toxic, ordinary = (Counter({w: rnd.randint(1, 9) for w in rnd.sample(sorted(set(some)), 12)}) for _ in range(2))
    fast = toxicity.Evidence(toxic, ordinary)
    words = [*toxic, *ordinary, b"qqq", *(w + b"x" for w in toxic), b"k"]
    assert fast.of_words(words).tolist() == pytest.approx([slow_evidence(toxic, ordinary, w) for w in words], abs=1e-9)
    text = b" ".join([*list(toxic)[:5], b"qqq"])
    assert fast.features(text)[0] == pytest.approx(np.mean([slow_evidence(toxic, ordinary, w) for w in text.split()]), abs=1e-9)
    assert toxicity.Evidence(Counter(), Counter()).features(b"a b")[0] == 0.0


def test_toxicity_sample_is_bounded(spark):
    """Repeated rows count once; an id with many texts brings no more than the bound."""
    docs = spark.createDataFrame([(1, f"t{i % 4} words") for i in range(80)] + [(2, "same words")] * 50 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    found = toxicity.sample(docs, labels, F.lit(True))
    assert Counter(y for _, y in found) == {1: 4, 0: 2}
    assert len(toxicity.sample(docs, labels, F.lit(True), per_class=1)) <= 4


def test_language(spark):
    rnd = random.Random(5)
    stems = {"en": ["the", "and", "thing", "ofwh", "ing"], "de": ["der", "und", "schung", "keit", "ä"], "fr": ["le", "et", "tion", "eaux", "ç"], "es": ["el", "y", "ción", "ando", "ñ"]}
    rows = []
    for i in range(200):
        lang = rnd.choice(list(stems))
        rows.append((i, " ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 50))), lang))
    rows += [(200, None, "en"), (201, "12 !", "de"), (202, "the and", None), (203, "", None), (None, "der und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in language_id.identify(df, F.col("doc_id") % 4 == 2).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows[:200]) >= 196
    assert [got[i]["lang_pred"] for i in (200, 201, 203)] == ["und"] * 3 and got[200]["score"] == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), F.col("doc_id") % 4 == 2).collect()} == {"und"}
    assert language_id.identify(df.limit(0), F.col("doc_id") % 4 == 2).count() == 0


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 45 % 26) * 4}{chr(98 + i % 45 // 26) * 3} zq", f"x{i % 45:02d}") for i in range(45 * 3)]
    found = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {lang for lang, _ in found} == {lang for _, _, lang in rows} and len(found) == len(rows)


def test_language_sample_is_bounded(spark):
    """Repeated rows and rows of one doc_id don't widen the sample."""
    rows = [(i % 3, f"aaa bbb {i % 7}", "en") for i in range(500)] + [(i, f"ccc ddd {i}", "de") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(lang for lang, _ in language_id.sample(df, F.lit(True), per_language=30, total=60, least=5))
    assert 18 <= found["en"] <= 21 and found["de"] == 30
    few = language_id.sample(df, F.lit(True), language_bytes=25)
    assert Counter(lang for lang, _ in few) == {"en": 2, "de": 2}


# --- op3 -----------------------------------------------------------------------------------------


def test_suffix_tree(spark):
    rnd = random.Random(6)
    words = vocabulary(40)
    texts = [prose(rnd, words, rnd.randint(5, 60)) + " x y z" * rnd.randint(0, 3) for _ in range(60)] + [None, "", "unseenword", "unseenword"]
    held = [i % 5 == 2 for i in range(len(texts))]
    s = suffix_tree.Settings(min_symbol=0.02, min_context=0.01)
    rows = {r["doc_id"]: r for r in suffix_tree.score(frame(spark, texts).withColumn("row", F.lit(0)), F.col("doc_id") % 5 == 2, s).collect()}
    tokens = [suffix_tree.tokens(None if t is None else t.encode()) for t in texts]
    c = Counter(w for i, ts in enumerate(tokens) if not held[i] for w in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in enumerate(tokens):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ts), sum(c[w] > 0 for w in ts), n, held[i])
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ts))
    assert sum(rows[i]["score"] for i in rows if held[i]) > sum(rows[i]["base_score"] for i in rows if held[i])
    assert suffix_tree.score(frame(spark, []), F.lit(False)).count() == 0


def test_suffix_tree_distributions_sum_to_one(spark):
    rnd = random.Random(8)
    words = ["p", "q", "r", "s", "t", *vocabulary(30)]
    df = frame(spark, [prose(rnd, words, 30) + " p q r" for _ in range(80)])
    counts = suffix_tree.word_counts(df)
    tree = suffix_tree.fit(df, counts, suffix_tree.Settings(min_symbol=0.01, min_context=0.01, divergence=0.0))
    known = {bytes(r["word"]): r["c"] for r in counts.collect()}
    assert len(tree.states) == 2 and all(len(x[0]) for x in tree.states)
    names = {v: k for k, v in tree.symbols.items()}
    for context, _ in zip(tree.states[1][0][:20].tolist(), range(20), strict=False):
        history = [context >> 21, context & ((1 << 21) - 1)]
        if tree.start in history:
            continue
        total = 0.0
        for w, c in [*known.items(), (None, 0)]:
            ids = np.array([*history, tree.symbols.get(w, 0)], dtype=np.int64)
            value, rest = tree.score(ids)
            p = value[2]
            if rest[2]:
                p += np.log10((c - tree.discount) / tree.n) if w else np.log10(tree.discount * tree.types / tree.n)
            total += 10**p
        assert total == pytest.approx(1.0, abs=1e-6), (context, names)


def slow_suffix_tree(train, held, s):
    """Scores by definition, contexts as tuples of words."""
    c, start = Counter(w for t in train for w in t), (b" ",)
    n = sum(c.values())
    levels, p = [], {(w,): (c[w] - s.discount) / n for w in c}
    total = {(w,): k for w, k in c.items()} | {start: len(train)}
    for order in (2, 3):
        g = Counter(x[i : i + order] for t in train for x in [(*start, *t)] for i in range(len(x) - order + 1))
        by = defaultdict(dict)
        for gram, k in g.items():
            if k >= s.min_symbol:
                by[gram[:-1]][gram] = k
        left, explicit = {}, {}
        for ctx, own in by.items():
            if total.get(ctx, 0) < s.min_context:
                continue
            rest = max(1 - sum(k - s.discount for k in own.values()) / total[ctx], 1e-12)
            q = {x: (k - s.discount) / total[ctx] + rest * p[x[1:]] for x, k in own.items()}
            gain = sum(k * np.log(q[x] / p[x[1:]]) for x, k in own.items()) + (total[ctx] - sum(own.values())) * np.log(rest)
            if gain >= s.divergence * len(own):
                left[ctx], explicit = rest, explicit | q
        levels.append((left, explicit))
        p, total = explicit, {x: g[x] for x in explicit}

    def prob(history, w):
        factor = 1.0
        for order in (3, 2):
            left, explicit = levels[order - 2]
            ctx = tuple(history[1 - order :])
            if ctx in left:
                if (*ctx, w) in explicit:
                    return factor * explicit[(*ctx, w)]
                factor *= left[ctx]
        return factor * ((c[w] - s.discount) if w in c else s.discount * len(c)) / n

    return [sum(np.log10(prob([*start, *t[:i]], w)) for i, w in enumerate(t)) for t in [*train, *held]], levels


@pytest.mark.parametrize("head", [0, 200, 500_000])
def test_suffix_tree_against_definition(spark, head):
    rnd = random.Random(21)
    words = vocabulary(300)
    lines = [prose(rnd, words, 12) for _ in range(12)]
    texts = [prose(rnd, words, rnd.randint(0, 30)) + " " + rnd.choice(lines) for _ in range(150)] + [None, "", "unseenword"]
    s = suffix_tree.Settings(head=head)
    tokens = [suffix_tree.tokens(None if t is None else t.encode()) for t in texts]
    held = [i for i in range(len(texts)) if i % 5 == 2]
    train = [i for i in range(len(texts)) if i % 5 != 2]
    want, levels = slow_suffix_tree([tokens[i] for i in train], [tokens[i] for i in held], s)
    assert len(levels[0][0]) > 20 and len(levels[1][0]) > 20
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(frame(spark, texts), F.col("doc_id") % 5 == 2, s).collect()}
    assert [got[i] for i in [*train, *held]] == pytest.approx(want)


def test_suffix_tree_grows_with_the_corpus(spark):
    """Contexts of a fixed count stay contexts, however large the rest of the corpus is."""
    rnd = random.Random(22)
    rare = ["alpha beta gamma delta"] * 12
    states = []
    for other in (20, 5000):
        df = frame(spark, rare + [" ".join(f"w{rnd.randrange(40)}" for _ in range(30)) for _ in range(other)])
        tree = suffix_tree.fit(df, suffix_tree.word_counts(df))
        names = {v: k for k, v in tree.symbols.items()}
        states.append({names.get(x) for x in tree.states[0][0].tolist()})
    assert all({b"alpha", b"beta", b"gamma"} <= x for x in states)


# --- op4 -----------------------------------------------------------------------------------------


def test_sentences_join_to_the_text():
    for t in ["", "A b. C!  D?\nE\n\n f", "x " * 50, "no end", "。あ。い", 'He said "Go." Then left.', " .\n"]:
        assert "".join(sentence_spans.sentences(t)) == t


def slow_dedup(texts):
    """Spans by definition, first places by a dictionary."""
    first, out = {}, []
    for d, t in enumerate(texts):
        parts = sentence_spans.sentences(t or "")
        keys = [tuple(p.encode().translate(sentence_spans._KEY).split()) for p in parts]
        spans = set()
        for i in range(len(parts)):
            for j in range(i + 3, len(parts) + 1):
                if sum(map(len, keys[i:j])) >= 20:
                    spans.add((i, j))
                    break
            for k in range(i - 2, -1, -1):
                if sum(map(len, keys[k : i + 1])) >= 20:
                    spans.add((k, i + 1))
                    break
        gone = set()
        for i, j in sorted(spans):
            key = tuple(keys[i:j])
            if first.setdefault(key, (d, i)) != (d, i):
                gone |= set(range(i, j))
        out.append(None if t is None else "".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def test_substring_dedup(spark):
    rnd = random.Random(9)
    words = vocabulary(200)
    shared = [prose(rnd, words, n) for n in (60, 55, 25, 10)]
    texts = []
    for i in range(30):
        t = prose(rnd, words, rnd.randint(0, 60))
        texts.append(rnd.choice([t, t + "\n" + rnd.choice(shared) + "\n" + prose(rnd, words, 20), shared[0] + " " + t]))
    texts += [None, "", texts[3], "Yes.", "Yes.", shared[1] + "\n" + shared[1]]
    df = frame(spark, texts).withColumn("n_removed", F.lit("clash"))
    got = {r["doc_id"]: r for r in sentence_spans.dedup_spans(df).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == slow_dedup(texts)
    assert sentence_spans.dedup_spans(frame(spark, [])).count() == 0


def test_spans_of_a_null_doc_id_come_first(spark):
    text = prose(random.Random(24), vocabulary(200), 60).rstrip(".") + "."
    df = spark.createDataFrame([(1, text), (None, text), (None, text), (2, text + " Other words.")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"].strip()) for r in sentence_spans.dedup_spans(df).collect())
    assert got == [(0, text), (0, text), (1, ""), (2, "Other words.")]


def test_cuts_realign_after_a_difference(spark):
    """A passage inside of a long sentence is found whatever number of words stands before it."""
    rnd = random.Random(23)
    words = [f"w{i}" for i in range(5000)]
    texts, passages = [], []
    for n in range(40):
        passage = [rnd.choice(words) for _ in range(60)]
        passages.append(" ".join(passage[12:48]))
        for before in (7, 7 + n % 15 + 1):
            texts.append(" ".join([*(rnd.choice(words) for _ in range(before)), *passage, *(rnd.choice(words) for _ in range(9))]))
    got = {r["doc_id"]: r["text"] for r in sentence_spans.dedup_spans(frame(spark, texts)).collect()}
    assert all(got[2 * n] == texts[2 * n] for n in range(40))
    assert sum(passages[n] in got[2 * n + 1] for n in range(40)) == 0


# --- op6 -----------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rnd = random.Random(10)
    words = vocabulary(100)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 40, 90]))) for _ in range(60)] + [None, "", "a<|endoftext|>b", "x " * 63, "y " * 200]
    df = frame(spark, texts).withColumn("length", F.lit("clash")).repartition(3)
    rows = packing.pack(df, path, length=64, width=2).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    # bins of two tokens waste one a document at most, and rounding less than a sequence
    assert len(by_seq) <= (sum(r["length"] for r in rows) + len(texts)) / 64 + 1
    assert packing.pack(df.limit(0), path).count() == 0


def test_word_encoder_against_whole_texts():
    """Words parted and lower-cased outside of the tokenizer give its ids, whatever the characters;
    what is forgotten comes again."""
    rnd = random.Random(31)
    encode = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 2, room=300)
    assert encode.simple
    alpha = "abcXYZ äöüÄÖß éÉ 0123 ²³½ '’\"`.,;:!?-_()\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\x00\x7f\xad İıʰˆˇĲŉǅ's't're'LL ªº×÷<|>“一ά\u0301"
    texts = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) + "<|endoftext|>" * (i % 9 == 0) for i in range(1500)]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for text, ids in zip(part, encode([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    assert len(encode.known.young) <= 300 and encode([None, b""]) == [encode.closing] * 2 and encode([]) == []
    other = packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert not other.simple


def test_column_generation():
    demand = {3: 40, 5: 30, 7: 20, 2: 3}
    found = packing.generate(demand, 10)
    used = Counter()
    for pattern, x in found:
        assert sum(s * n for s, n in pattern.items()) <= 10
        for s, n in pattern.items():
            used[s] += n * x
    assert all(used[s] == pytest.approx(n) for s, n in demand.items())
    # 20 of (7, 3), 15 of (5, 5), 20 threes and 3 twos in 6.6 sequences
    assert sum(x for _, x in found) == pytest.approx((20 * 3 + 3 * 2) / 10 + 35, abs=0.9)
    patterns = packing.rounded(demand, 10)
    total = Counter()
    for pattern, times in patterns:
        for s, n in pattern.items():
            total[s] += n * times
    assert total == demand and packing.rounded({}, 10) == []


def test_rounded_patterns_are_few():
    """Every demand is met, by at most two sequences more than the relaxed program uses."""
    rnd = random.Random(32)
    for _ in range(60):
        capacity = rnd.randint(5, 60)
        demand = {rnd.randint(1, capacity): rnd.randint(1, 40) for _ in range(rnd.randint(1, 25))}
        found, total = packing.rounded(demand, capacity), Counter()
        for pattern, times in found:
            assert sum(s * n for s, n in pattern.items()) <= capacity
            total.update({s: n * times for s, n in pattern.items()})
        assert total == Counter(demand)
        assert sum(times for _, times in found) <= sum(x for _, x in packing.generate(demand, capacity)) + 2


# --- op7 -----------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rnd = random.Random(11)
    words = vocabulary(400)
    texts = [prose(rnd, words, rnd.randint(0, 400)) for _ in range(25)] + [None, "", "one two", "one two", "x"]
    got = {r["doc_id"]: r for r in bottom_k.fingerprints(frame(spark, texts).withColumn("n_chars", F.lit("clash"))).collect()}
    clean = [t or "" for t in texts]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def likeness(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, t in enumerate(clean):
        after, half = clean[(i + 1) % len(clean)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert abs(r["near_edited"] - likeness(t, edited)) < 0.2 and abs(r["near_next"] - likeness(t, after)) < 0.2
    assert got[27]["fingerprint"] == got[28]["fingerprint"] and got[25]["fingerprint"] == "" and got[26]["near_edited"] == 1.0
    assert bottom_k.fingerprints(frame(spark, [])).count() == 0


def test_fingerprints_over_buckets(spark):
    df = frame(spark, [f"t{i} a b c d e f" for i in range(50)]).where("doc_id % 3 <> 1")
    ids = [i for i in range(50) if i % 3 != 1]
    rows, order = bottom_k.with_next(df, rows_per_bucket=7)
    rows = rows.withColumn("n", F.lead("doc_id").over(order)).where("not _extra").collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {a: ids[(k + 1) % len(ids)] for k, a in enumerate(ids)}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_fingerprints_of_other_ids_and_repeated_ones(spark, kind):
    """Ids of any type; rows of one id are dealt out too, by a hash of their text."""
    texts = [f"t{i} a b c d e f {i * i}" for i in range(60)]
    df = spark.createDataFrame([(7 if i > 20 else i, t) for i, t in enumerate(texts)] + [(None, "z")], "doc_id int, text string").select(F.col("doc_id").cast(kind), "text")
    rows, order = bottom_k.with_next(df, rows_per_bucket=5)
    got = {r["text"]: r["n"] for r in rows.withColumn("n", F.lead("text").over(order)).where("not _extra").collect()}
    tie = {r["text"]: r["x"] for r in df.select("text", F.xxhash64("text").alias("x")).collect()}
    line = [r["text"] for r in sorted(df.where("doc_id IS NOT NULL").collect(), key=lambda r: (r["doc_id"], tie[r["text"]]))] + ["z"]
    assert got == {a: b for a, b in zip(line, [*line[1:], line[0]], strict=True)}
    assert rows.groupBy("_bucket").count().count() > 5
    assert bottom_k.fingerprints(df).count() == 61


def test_fingerprint_strings_against_sorting(spark):
    """The strings hold the 128 smallest distinct hashes of shingles of five words, in order."""
    rnd = random.Random(33)
    texts = [prose(rnd, vocabulary(300), n) for n in (1, 4, 5, 6, 90, 130, 400)]
    got = {r["doc_id"]: r["fingerprint"] for r in bottom_k.fingerprints(frame(spark, texts)).collect()}
    shingles = []
    for i, t in enumerate(texts):
        w = t.lower().split()
        shingles += [(i, len(w) >= 5, w[j : j + max(1, min(5, len(w)))]) for j in range(max(1, len(w) - 4))]
    df = spark.createDataFrame(shingles, "i int, full boolean, w array<string>").withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    full = df.where("full").select("i", F.xxhash64(*(F.col("h")[j] for j in range(5))).alias("x"))
    by = defaultdict(set)
    for r in full.collect():
        by[r["i"]].add(r["x"])
    for i, xs in by.items():
        assert got[i] == "".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(xs)[:128]), i
    assert len(by) == 5 and all(len(got[i]) == 16 for i in (0, 1))


def test_sketches_merge(spark):
    parts = spark.createDataFrame([("g", " ".join(f"w{i}" for i in range(a, a + 300))) for a in (0, 200, 400)] + [("h", "")], "g string, t string")
    merged = bottom_k.merge(bottom_k.with_sketch(parts, "t", "sketch"), ["g"])
    whole = bottom_k.with_sketch(spark.createDataFrame([(" ".join(f"w{i}" for i in range(700)),)], "t string"), "t", "s")
    n = merged.where("g = 'g'").select(bottom_k.distinct_shingles(F.col("sketch"))).first()[0]
    assert 500 < n < 900
    a, b = merged.where("g = 'g'").first()["sketch"], whole.first()["s"]
    assert a == b
    inside = bottom_k.with_sketch(bottom_k.with_sketch(spark.createDataFrame([(" ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(400)))], "a string, b string"), "a", "x"), "b", "y")
    row = inside.select(bottom_k.containment(F.col("x"), F.col("y")), bottom_k.resemblance(F.col("x"), F.col("y"))).first()
    assert row[0] > 0.8 and 0.35 < row[1] < 0.65


# --- op8 -----------------------------------------------------------------------------------------


def test_edits_against_encoding_anew(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rnd = random.Random(12)
    letters = "ab  \n'st1é.! lre"
    counter = token_counts.Counter(path)
    for _ in range(300):
        t = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 40, 900])))
        doc = token_counts.Document(t, counter)
        for _ in range(3):
            at, gone, new = rnd.randint(-2, len(t) + 2), rnd.choice([0, 1, 3, 10, 200]), "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 2, 9])))
            a = min(max(at, 0), len(t))
            t = t[:a] + new + t[min(a + gone, len(t)) :]
            doc.edit(at, gone, new)
            assert doc.text == t and doc.n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
    texts = ["hello world, it's", None, "", "x y"]
    edits = spark.createDataFrame([(0, [(5, 1, " brave "), (None, 1, "x")]), (3, [])], "doc_id long, edits array<struct<at:long,removed:long,inserted:string>>")
    got = {r["doc_id"]: r for r in token_counts.count_edited(frame(spark, texts).withColumn("edits", F.lit(1)), edits, path).collect()}
    assert got[0]["edited_tokens"] == len(tok.encode("hello brave world, it's", add_special_tokens=False).ids)
    assert (got[1]["n_tokens"], got[2]["edited_tokens"], got[3]["n_encoded"]) == (0, 0, 0) and got[3]["n_tokens"] == got[3]["edited_tokens"]


def test_token_counts_query(spark, tmp_path):
    """The registered query's edits, applied to each text by hand and encoded as a whole."""
    from tokenizers import Tokenizer

    from quillmatch.llm import q08_token_counts

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rnd = random.Random(37)
    texts = [prose(rnd, vocabulary(90), n) for n in (1, 3, 20, 300)] + [None, "", "ü" * 7, "x " * 30_000]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in q08_token_counts.query(spark, str(tmp_path)).collect():
        t = texts[r["doc_id"]] or ""
        assert r["n_tokens"] == len(tok.encode(t, add_special_tokens=False).ids)
        n = len(t)
        for at, removed, inserted in ((n // 3, 7, ""), (n // 2, 0, " edit2 "), (n, 5, "'ll end.")):
            at = min(at, len(t))
            t = t[:at] + inserted + t[min(at + removed, len(t)) :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(t), len(tok.encode(t, add_special_tokens=False).ids)), r["doc_id"]


# --- op9 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_url_filter(spark, most):
    urls = [None, "", "nothing", "http://a.NET/x", "http://a.net", "https://example.net/en/1?q", "http://example.com/de/", "http://x.example.com/de/1", "http://notexample.com/de/1", "http://b.org/fr/1#y", "http://www.c.org/p/?utm_x=1&a=2#f", "https://c.org/p?a=2", "http://c.org:80/p?a=2", "http://d.org/q", "http://d.org/q"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("http://c.org/p?a=2",), ("http://c.org/p?a=2",), (None,), ("",), ("http://a.net/x",)], "url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, listed, max_broadcast_slots=most).collect()}
    assert len(got) == len(urls)
    rules = {i: got[i]["rule"] for i in got if got[i]["rule"]}
    assert rules == {3: "net/", 5: "example.net/en/", 6: "example.com/de/", 7: "example.com/de/", 9: "org/fr/"}
    assert [i for i in sorted(got) if got[i]["verdict"] == "block"] == [3, 6, 7, 10, 11, 12]
    assert (got[3]["host"], got[3]["path"], got[0]["host"], got[5]["path"]) == ("a.net", "/x", "", "/en/1")
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("verdict = 'block'").count() == 3


# --- op10 ----------------------------------------------------------------------------------------


def slow_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = min(comp[i], comp[j]), max(comp[i], comp[j])
                comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


@pytest.mark.parametrize(("block", "k", "percent"), [(512, 3, 85), (4, 3, 85), (512, 5, 80)])
def test_near_duplicates(spark, block, k, percent):
    rnd = random.Random(13)
    words = vocabulary(300)
    texts = []
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 120))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", "a b", "A b", "b a", "x", texts[0], texts[0].replace(" ", "\n")]
    df = frame(spark, texts).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: r for r in chosen_path.near_duplicates(df, k=k, percent=percent, block=block).collect()}
    sizes, comp = slow_components(texts, k, percent)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == comp
    assert all(got[i]["kept"] == (comp[i] == i) for i in got)


def test_leaves_hold_a_row_once():
    sig = np.random.default_rng(3).integers(0, 1 << 32, (40, 4), dtype=np.uint64).astype(np.uint32)
    for row in range(len(sig)):
        keys = [int(key[0]) for key, has in chosen_path.leaves(sig[row : row + 1], 16, 4, 0.6) if has[0]]
        assert len(keys) == len(set(keys))


def test_near_duplicates_edge_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    rows = chosen_path.near_duplicates(df).collect()
    assert len(rows) == 4 and sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]


def test_near_duplicates_of_repeated_ids(spark):
    """Texts of one doc_id are one node, so that what is like either of them is linked."""
    x, y = "a b c d e f", "p q r s t u"
    df = spark.createDataFrame([(1, x), (1, y), (2, x), (3, y), (0, y), (4, "other words here")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(df).collect())
    assert rows == [(0, 0, True), (1, 0, False), (1, 0, False), (2, 0, False), (3, 0, False), (4, 4, True)]


def test_large_nodes_are_branched_on(spark):
    """Leaves of more than a few classes are branched until they are small; what a plain comparison
    of all sets links is found all the same."""
    rnd = random.Random(35)
    words = vocabulary(120, seed=2)
    base = [rnd.choice(words) for _ in range(60)]
    texts = []
    for _ in range(90):  # many that are alike to some degree, in several groups
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 9])):
            w[rnd.randrange(60)] = rnd.choice(words)
        texts.append(" ".join(w))
    rows = chosen_path.near_duplicates(frame(spark, texts), percent=85, block=4).collect()
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for t in texts)]
    parent = list(range(90))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(90):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: root(i) for i in range(90)}


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert chosen_path.near_duplicates(df.limit(0)).count() == 0
