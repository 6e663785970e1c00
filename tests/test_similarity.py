import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmatch.functions.similarity import Cells, Matrices, cosine, damerau, edit_keys, neighbours, one_edit, similarities


def slow_distance(a, b, restricted):
    """Shortest path over edits for short strings: restricted by the usual recurrence, else by the
    definition with the last matching positions."""
    if restricted:
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]
    seen, front, letters = {a}, [a], sorted(set(a + b))
    for n in itertools.count():
        if b in front:
            return n
        new = []
        for s in front:
            for i in range(len(s) + 1):
                tries = [s[:i] + c + s[i:] for c in letters]
                if i < len(s):
                    tries += [s[:i] + s[i + 1 :], *(s[:i] + c + s[i + 1 :] for c in letters)]
                if i + 1 < len(s):
                    tries.append(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
                for t in tries:
                    if t not in seen and len(t) <= max(len(a), len(b)) + 1:
                        seen.add(t)
                        new.append(t)
        front = new


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_restricted_distance(a, b):
    assert damerau([a], [b])[0] == slow_distance(a, b, True)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=4), st.text("abc", max_size=4))
def test_full_distance(a, b):
    assert damerau([a], [b], False)[0] == slow_distance(a, b, False)


def test_variants_differ():
    assert damerau(["CA"], ["ABC"]).tolist() == [3] and damerau(["CA"], ["ABC"], False).tolist() == [2]


def test_one_edit_and_neighbours(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("AB") for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    rows = [(a, b) for a in words for b in words]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", one_edit(F.col("a"), F.col("b")), F.arrays_overlap(neighbours(F.col("a")), neighbours(F.col("b")))).collect()
    for a, b, near, shared in found:
        assert near == (slow_distance(a, b, True) == 1), (a, b)
        assert not near or shared


def test_cosine(spark):
    df = spark.createDataFrame([(["A", "A", "B"], ["A", "C"]), ([], ["A"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [round(1 / 6**0.5, 6), 0.0]


def matrices(*pairs, **rules):
    c = Cells(**rules)
    c.prepare(list(pairs))
    return c.of(list(pairs))


def test_weighted_matrix():
    found = matrices((["AAA", "BBB"], ["AAA", "BBB"]), (["AAA", "BBB"], ["AAA", "CCC"])).weighted()
    assert found.tolist() == [pytest.approx(1.0), pytest.approx(2 / 3)]


def test_mean_matrix_stops_below_mu():
    assert matrices((["AAA", "BBB"], ["AAA", "CCC"])).means(0.5).tolist() == [pytest.approx(0.5)]
    assert matrices((["AAA", "BBB", "DDD"], ["AAA", "CCC", "EEE"])).means(0.9).tolist() == [pytest.approx(0.5)]


def test_rules():
    assert matrices((["12"], ["13"]), number_rule=True).values.tolist() == [0] and matrices((["12"], ["13"])).values.tolist() == [0.5]
    assert matrices((["A"], ["AB"]), initial_rule=True).values.tolist() == [0]


def slow_greedy(m):
    """The largest cell of a matrix again and again, the first by row and column of equal ones."""
    left, out = {(i, j): v for i, row in enumerate(m) for j, v in enumerate(row)}, []
    while left:
        i, j = min(left, key=lambda k: (-left[k], k))
        out.append((i, j, left[i, j]))
        left = {k: v for k, v in left.items() if k[0] != i and k[1] != j}
    return out


def test_greedy_picks_of_many_matrices():
    rnd = random.Random(2)
    for _ in range(40):
        tables = [[[rnd.choice([0.0, 0.25, 0.5, 0.5, 1.0, rnd.random()]) for _ in range(n)] for _ in range(m)] for m, n in ((rnd.randint(1, 7), rnd.randint(1, 7)) for _ in range(rnd.randint(1, 6)))]
        m = Matrices(np.array([len(t) for t in tables]), np.array([len(t[0]) for t in tables]), np.array([v for t in tables for row in t for v in row]))
        cells, step = m.picks()
        want = [(k, n, i, j, v) for k, t in enumerate(tables) for n, (i, j, v) in enumerate(slow_greedy(t))]
        assert list(zip(*(x.tolist() for x in (m.of[cells], step, m.row[cells], m.col[cells], m.values[cells])), strict=True)) == want
        for mu in (0.0, 0.3, 0.6, 1.0):
            means = []
            for t in tables:
                values = [v for _, _, v in slow_greedy(t)]
                prefix = [sum(values[: n + 1]) / (n + 1) for n in range(len(values))]
                means.append(next((p for p in prefix if p < mu), prefix[-1]))
            assert m.means(mu).tolist() == pytest.approx(means)
        assert m.weighted().tolist() == pytest.approx([sum(v * (len(t) - i) for i, _, v in slow_greedy(t)) / (len(t) * (len(t) + 1) / 2) for t in tables])
        assert m.best_of_rows().tolist() == pytest.approx([sum(map(max, t)) / len(t) for t in tables])


def test_no_matrices():
    m = matrices()
    assert m.picks()[0].tolist() == m.means(0.5).tolist() == m.weighted().tolist() == m.best_of_rows().tolist() == []


def edited(rnd, w):
    at, c = rnd.randrange(len(w) - 1), rnd.choice("abc")
    return rnd.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1] + w[at] + w[at + 2 :], w + c, c + w, w[1:], w[:-1]])


def test_edit_keys(spark):
    """Tokens one edit apart share a key whatever their lengths; the keys of long ones are few."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdéf") for _ in range(n)) for n in [*range(2, 60), *[23, 24, 25] * 30]]
    rows = [(w, edited(rnd, w)) for w in words for _ in range(6)] + [(w, w) for w in words]
    keys = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.arrays_overlap(edit_keys(F.col("a"), True), edit_keys(F.col("b"), False)))
    assert [r[:2] for r in keys.collect() if not r[2]] == []
    long = "".join(rnd.choice("abcdefgh") for _ in range(100_000))
    row = spark.createDataFrame([(long, long[:70_000] + "x" + long[70_000:])], "a string, b string").select(edit_keys(F.col("a"), True).alias("p"), edit_keys(F.col("b"), False).alias("q")).first()
    assert len(row["p"]) <= 15 and len(row["q"]) == 3 and set(row["p"]) & set(row["q"])


def test_long_tokens_in_bounded_blocks():
    """One token of 5,000 characters, against itself with edits and against short ones."""
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcd") for _ in range(5000))
    edited = long[:100] + "x" + long[100:2000] + "y" + long[2001:]
    found = similarities([long, long, "ab", ""], [edited, "abc", "ba", ""])
    assert found.tolist() == pytest.approx([1 - 2 / 5001, 1 - 4997 / 5000, 0.5, 1.0], abs=1e-9)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    pairs = list(zip(words, words[1:], strict=False))
    whole = similarities(*map(list, zip(*pairs, strict=True)))
    assert similarities(*map(list, zip(*pairs, strict=True)), cells=64).tolist() == whole.tolist()


def test_cells_forget():
    cells = Cells(room=5)
    lists = [(["AB", "CD", "AB"], ["CD", "AX"]), (["EF"], ["EG", "EF"]), (["AB"], ["AX"])]
    for a, b in lists * 2:
        cells.prepare([(a, b), ([], b)])
        assert cells.of([(a, b)]).values.tolist() == [1.0 if p == q else similarities([p], [q])[0] for p in a for q in b]
    assert len(cells.keys) <= 5 + 6
