"""Corrections within candidate pairs, in the order of the pairs.

Two references that share a token, or its next two, hint at each other's errors: a misspelt middle
token, a nickname, a missing token, a token that the other writes apart, a misspelt leading token.
Every edit changes what later pairs see, and how often a token occurs, which decides between two
spellings. The result is that of one fold over all pairs, sorted by their ids; it is found without
one task that folds them all.

The order of pairs is cut into slabs, which follow one another, and the pairs of a slab into units that
share no reference: a slab ends before its largest unit's references would have more than
`UNIT_TOKENS` tokens together. A unit folds its pairs in order on the lists that the slab before left,
all units at once. A list goes from the slab that had it to the next one that needs it, so it moves
once for each slab that it is in, packed, and most units of a sparse graph are few references. As pairs per
reference, not references, make the slabs, their number does not grow with the table.

What units of a slab share are counts. Each comparison is kept with its place; after a slab was folded,
the counts are made up from all edits before that place, and units of which a comparison comes out
otherwise are folded again, with the edits of others that its tokens need. The first comparison in the
order that was wrong is then right and all before it stay, so this ends, with what the fold over all
pairs would have done; then the slab is never folded again.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.operators.stats import HEAVIEST, LETTERS
from quillmatch.plans.staging import staged, unstage

#: Tokens of all references of a unit, as they were before any edit, but for one pair's; a task holds those of one unit.
UNIT_TOKENS = 2_000_000
#: Pairs that one task cuts into slabs.
CUT_PAIRS = 500_000
#: Kinds of rows that units read: where references go next, counts to add, lists, pairs; and that they write.
NEXT, ADDED, LIST, PAIR, EDIT, COMPARED = 0, 1, 2, 3, 4, 5

_WRITES = "unit long, kind int, seq long, old string, new string, n long, low int, high int, ref string, slab long, next long, edited boolean, list binary, tokens array<string>"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in _WRITES.split(", "))])


def one_edit(a: str, b: str) -> bool:
    """Whether one letter changed, added, dropped or two neighbours swapped make a into b."""
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        return len(at) == 1 or (len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]])
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


class Places:
    """Where a list has each token, and where each two tokens follow which token. Places are keys that
    rise along the list, so that an edit moves none but its own."""

    GAP = 1 << 40

    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self._number()

    def _number(self) -> None:
        self.keys = list(range(0, len(self.tokens) * self.GAP, self.GAP))
        self.of: dict[str, list[int]] = {}
        self.followed: dict[tuple[str, str], list[int]] = {}
        self.before: dict[tuple[str, str], dict[str, list[int]]] = {}
        for key, t in zip(self.keys, self.tokens, strict=True):
            if t in self.of:
                self.of[t].append(key)
            else:
                self.of[t] = [key]
        for key, two in zip(self.keys, zip(self.tokens[1:], self.tokens[2:])):  # noqa: B905  the first are longer
            if two in self.followed:
                self.followed[two].append(key)
            else:
                self.followed[two] = [key]

    def at(self, key: int) -> int:
        return bisect_left(self.keys, key)

    def leads(self, two: tuple[str, str]) -> dict[str, list[int]]:
        """The places of the tokens that these two follow, by token."""
        if two not in self.followed:
            return {}
        if two not in self.before:
            found: dict[str, list[int]] = {}
            for key in self.followed[two]:
                found.setdefault(self.tokens[self.at(key)], []).append(key)
            self.before[two] = found
        return self.before[two]

    @staticmethod
    def _drop(places: dict, what, key: int) -> None:
        keys = places[what]
        if len(keys) == 1:
            del places[what]
        else:
            del keys[bisect_left(keys, key)]

    def put(self, low: int, high: int, new: list[str]) -> None:
        """Has `new` in place of the tokens from low up to high."""
        tokens, keys = self.tokens, self.keys
        first = max(0, low - 2)
        for i in range(first, min(high, len(tokens) - 2)):
            two = tokens[i + 1], tokens[i + 2]
            self._drop(self.followed, two, keys[i])
            self.before.pop(two, None)
        for i in range(low, high):
            self._drop(self.of, tokens[i], keys[i])
        before = keys[low - 1] if low else -self.GAP
        after = keys[high] if high < len(keys) else (keys[-1] if keys else 0) + self.GAP * (len(new) + 1)
        step = (after - before) // (len(new) + 1)
        tokens[low:high] = new
        if not step:
            self._number()
            return
        keys[low:high] = [before + step * i for i in range(1, len(new) + 1)]
        for i in range(low, low + len(new)):
            insort(self.of.setdefault(tokens[i], []), keys[i])
        for i in range(first, min(low + len(new), len(tokens) - 2)):
            two = tokens[i + 1], tokens[i + 2]
            insort(self.followed.setdefault(two, []), keys[i])
            self.before.pop(two, None)


class Fold:
    """Edits token lists pair by pair. freq and aliases hold what is known of tokens, common the counts
    of those that freq doesn't hold."""

    def __init__(self, lists: dict[str, list[str]], freq: dict[str, int], aliases: dict[str, str], common: dict[str, int] | None = None):
        self.lists, self.freq, self.aliases, self.common = lists, freq, aliases, common or {}
        self.edits: Counter[tuple[str, str]] = Counter()
        self.compared: list[tuple[str, str, int, int, int]] = []
        self._now: dict[str, int] = {}
        self._places: Places | None = None

    def _record(self, old: str, new: str) -> None:
        self.edits[old, new] += 1
        self._now[new] = self._now.get(new, 0) + 1
        self.freq[new] = self.count(new) + 1

    def count(self, token: str) -> int:
        return self.freq[token] if token in self.freq else self.common.get(token, 0)

    def _compare(self, a: str, b: str, ties: bool) -> int:
        """Less than 0, 0 or more by which of two tokens is rarer. What was found is kept: the tokens,
        how often each was written by this pair so far, and the signs that lead to the same edit.
        ties: whether equal counts do what a more frequent first token does."""
        n = self.count(a) - self.count(b)
        sign = (n > 0) - (n < 0)
        self.compared.append((a, b, self._now.get(a, 0) - self._now.get(b, 0), sign if sign < 0 or not ties else 0, 1 if ties and sign >= 0 else sign))
        return sign

    def _put(self, k: list[str], low: int, high: int, new: list[str]) -> None:
        """Edits the second list, whose places are looked up."""
        if self._places is None:
            k[low:high] = new
        else:
            self._places.put(low, high, new)

    def _is_alias(self, a: str, b: str) -> bool:
        return a in self.aliases and self.aliases[a].lower() == b.lower()

    @staticmethod
    def _typo(a: str, b: str) -> bool:
        return len(a) > 2 and len(b) > 2 and abs(len(a) - len(b)) < 2 and one_edit(a, b)

    def pair(self, first: str, second: str) -> None:
        """Correct the two references by each other; a reference never corrects itself."""
        j, k = self.lists[first], self.lists[second]
        if first == second or j == k:
            return
        self._places, self._now = None, {}
        seen_j = None
        at = 0
        while at < len(j):  # lists grow and shrink on the way, as later positions see
            lead = j[at]
            if (passed := self._passes(j, at, k, lead, seen_j)) is not None:
                seen_j = passed
                at += 1
                continue
            seen_k = None
            other = self._next(j, at, k, 0, lead, seen_j)
            while other is not None:
                if lead == k[other]:
                    seen_j, seen_k = self._same_lead(j, at, k, other, lead, seen_j, seen_k)
                else:
                    self._other_lead(j, at, k, other, lead)
                other = self._next(j, at, k, other + 1, lead, seen_j)
            at += 1

    def _passes(self, j, at, k, lead, seen_j):
        """What seen_j becomes at a place where no rule changes anything, as is so nearly everywhere;
        None where one may. Of places with the same token only the first that it isn't repeated at
        counts, as all others find this token and its next two handled."""
        if at + 2 >= len(j):
            return seen_j or ()
        if self._places is None:
            self._places = Places(k)
        j1, j2 = j[at + 1], j[at + 2]
        if any(t != lead for t in self._places.leads((j1, j2))):
            return None
        if lead == j1 or (tri := (lead, j1, j2)) == seen_j:
            return seen_j or ()
        for key in self._places.of.get(lead, ()):
            i = self._places.at(key)
            if i + 2 < len(k) and k[i + 1] != lead:
                k1, k2 = k[i + 1], k[i + 2]
                same = j2 == k2 and j1 == k1 and j1 not in self.aliases
                return tri if same or not (j2 == k2 or j1 == k2 or j2 == k1 or j1.startswith(k1)) else None
        return seen_j or ()

    def _next(self, j, at, k, start, lead, seen_j) -> int | None:
        """The next place of k from `start` on where a rule can apply: it has the same token, which
        was not handled with these two behind it just before, or a misspelling of it before the
        same two tokens."""
        if at + 2 >= len(j):
            return None
        if self._places is None:
            self._places = Places(k)
        two = j[at + 1], j[at + 2]
        found = []
        if lead != two[0] and (lead, *two) != seen_j:
            found.append(self._places.of.get(lead, ()))
        found += [places for t, places in self._places.leads(two).items() if t != lead and not (lead.isnumeric() and t.isnumeric()) and self._typo(lead, t)]
        if start >= len(k):
            return None
        start = self._places.keys[start]
        nexts = [x[i] for x in found if (i := bisect_left(x, start)) < len(x)]
        return self._places.at(min(nexts)) if nexts else None

    def _same_lead(self, j, at, k, other, lead, seen_j, seen_k):
        """Rules for a shared token that both follow by two more."""
        if at + 2 >= len(j) or other + 2 >= len(k):
            return seen_j, seen_k
        tri_j, tri_k = (lead, j[at + 1], j[at + 2]), (lead, k[other + 1], k[other + 2])
        if tri_j[0] == tri_j[1] or tri_k[0] == tri_k[1] or tri_j == seen_j:
            return seen_j, seen_k
        seen_j = tri_j
        if tri_k == seen_k:
            return seen_j, seen_k
        seen_k = tri_k
        (_, j1, j2), (_, k1, k2) = tri_j, tri_k
        if j2 == k2:
            self._middle(j, at, k, other, j1, k1)
        elif j1 == k2 and j2 != k1:
            if len(j2) > 2 and len(k1) > 2:
                j.insert(at + 1, k1)
                self._record("", k1)
        elif j2 == k1 and j1 != k2:
            if len(j1) > 2 and len(k2) > 2:
                self._put(k, other + 1, other + 1, [j1])
                self._record("", j1)
        else:
            self._apart(j, at, k, other, j1, j2)
        return seen_j, seen_k

    def _middle(self, j, at, k, other, j1, k1):
        """The middle tokens differ between equal neighbours: the rarer spelling gives way, or a
        nickname to the formal name."""
        if j1 != k1 and len(j1) > 2 and len(k1) > 2:
            if self._typo(j1, k1):
                sign = self._compare(j1, k1, False)
                if sign < 0:
                    j[at + 1] = k1
                    self._record(j1, k1)
                elif sign > 0:
                    self._put(k, other + 1, other + 2, [j1])
                    self._record(k1, j1)
        elif self._is_alias(j1, k1):
            j[at + 1] = k1
            self._record(j1, k1)
        elif self._is_alias(k1, j1):
            self._put(k, other + 1, other + 2, [j1])
            self._record(k1, j1)

    def _apart(self, j, at, k, other, j1, j2):
        """k writes in several tokens what j writes as one before the next shared token: numbers
        are joined in k, words are parted in j. A run needs three tokens behind it in k."""
        limit = len(k)
        parts, places = [k[other + 1]], [other + 1]
        end, size = other + 2, len(k[other + 1])
        following = k[end]
        while end + 3 < limit and j1.startswith(parts[-1], size - len(parts[-1])):  # else no more parts can help
            parts.append(following)
            places.append(end)
            end, size = end + 1, size + len(following)
            following = k[end]
            if following == j2 and "".join(parts) == j1:
                if j1.isdigit():
                    self._put(k, places[0], places[0] + 1, [j1])
                    for i in places[1:]:  # one by one, each from the list as it then is
                        if i < len(k):
                            self._put(k, i, i + 1, [])
                else:
                    j[at + 1 : at + 2] = parts
                self._record("".join(parts), j1)
                return

    def _other_lead(self, j, at, k, other, lead):
        """A misspelt leading token before two equal ones; the rarer gives way, k on a tie."""
        mine = k[other]
        if (lead.isnumeric() and mine.isnumeric()) or at + 2 >= len(j) or other + 2 >= len(k):
            return
        if j[at + 1] != k[other + 1] or j[at + 2] != k[other + 2] or not self._typo(lead, mine):
            return
        if self._compare(lead, mine, True) < 0:
            j[at] = mine
            self._record(lead, mine)
        else:
            self._put(k, other, other + 1, [lead])
            self._record(mine, lead)


def pack(value) -> bytes:
    """Lists as they move between tasks: an array of strings takes 16 bytes and more for each token."""
    return zlib.compress(json.dumps(value, ensure_ascii=False).encode(), 1)


def unpack(value: bytes):
    return json.loads(zlib.decompress(value))


def pack_tokens(it):
    """refID, list of batches of refID, tokens."""
    for rows in it:
        packed = [pack(x.as_py()) for x in rows.column(1)]
        yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.string()), pa.array(packed, type=pa.binary())], names=["refID", "list"])


def pack_lists(it):
    """ref, slab, next, edited, list of batches of ref, slab, next, packed tokens, and their rare ones
    with counts and formal names."""
    for rows in it:
        packed = []
        for tokens, rare, counts, formal in zip(*rows.columns[3:], strict=True):
            rare, counts, formal = rare.as_py() or [], counts.as_py() or [], formal.as_py() or []
            packed.append(pack([unpack(tokens.as_py()), rare, counts, [0] * len(rare), formal]))
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([False] * rows.num_rows), pa.array(packed, type=pa.binary())], names=["ref", "slab", "next", "edited", "list"])


def cut_slabs(most: int):
    """A function of batches of pairs in order (seq, the two ids, their numbers of tokens) that names
    each pair's slab and unit, both by the place of their first pair: slab, unit, seq, refID1, refID2."""
    schema = pa.schema([("slab", pa.int64()), ("unit", pa.int64()), ("seq", pa.int64()), ("refID1", pa.string()), ("refID2", pa.string())])

    def run(it):
        held: list[tuple[int, str, str]] = []
        up: dict[str, str] = {}
        size: dict[str, int] = {}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def close():
            first: dict[str, int] = {}
            for s, x, _ in held:
                first.setdefault(top(x), s)
            seq, a, b = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([seq[0]] * len(seq)), pa.array([first[top(x)] for x in a]), pa.array(seq), pa.array(a), pa.array(b)], schema=schema)

        for batch in it:
            for s, x, y, nx, ny in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (top(r) if r in up else r for r in (x, y))
                if held and one != two and size.get(one, nx) + size.get(two, ny) > most:
                    yield close()
                    held, up, size = [], {}, {}
                    one, two = x, y
                for r, n in ((x, nx), (y, ny)):
                    if r not in up:
                        up[r], size[r] = r, n
                if one != two:
                    if size[one] < size[two]:
                        one, two = two, one
                    up[two] = one
                    size[one] += size.pop(two)
                held.append((s, x, y))
        if held:
            yield close()

    return run


def fold_units(common: dict[str, tuple[int, str | None]]):
    """A function that folds units, whose rows stand together: where references go next, then counts to
    add, lists, and pairs in order. common: count and formal name of tokens that no list brings."""

    def run(it):
        out: list[dict] = []
        room = 200_000
        counts_of = {t: n for t, (n, _) in common.items()}
        formal_of = {t: name for t, (_, name) in common.items() if name is not None}
        unit = fold = None
        nexts, base, edited, added, pending = {}, {}, set(), [], []

        def close():
            nonlocal out, room
            if fold is None:
                return
            for ref, tokens in fold.lists.items():
                slab, following = nexts.get(ref, (None, None))
                if slab is None and ref not in edited:
                    continue
                row = {"unit": unit, "kind": LIST, "ref": ref, "slab": slab, "next": following, "edited": ref in edited}
                if slab is None:
                    row["tokens"] = tokens
                else:
                    rare = [t for t in dict.fromkeys(tokens) if t not in common]
                    row["list"] = pack([tokens, rare, [base.get(t, 0) for t in rare], [fold.freq.get(t, 0) - base.get(t, 0) for t in rare], [fold.aliases.get(t) for t in rare]])
                out.append(row)
                room -= len(tokens)
                if room < 0:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, room = [], 200_000

        for row in (row for rows in it for i in range(0, rows.num_rows, 16) for row in rows.slice(i, 16).to_pylist()):
            kind = row["kind"]
            if row["unit"] != unit:
                yield from close()
                unit, fold = row["unit"], Fold({}, {}, dict(formal_of), counts_of)
                nexts, base, edited, added, pending, exact = {}, {}, set(), [], [], set()
                same: dict[str, str] = {}
            if kind == NEXT:
                nexts[row["ref"]] = row["slab"], row["next"]
            elif kind == ADDED:
                exact.add(row["ref"])
                pending.append((row["seq"], row["ref"], row["n"]))
            elif kind == LIST:
                tokens, *known = unpack(row["list"])
                for t, n, more, name in zip(*known, strict=True):
                    t = same.setdefault(t, t)
                    base[t] = n
                    # of several guesses of what other units added the largest is the latest
                    fold.freq[t] = n if t in exact else max(n + more, fold.freq.get(t, 0))
                    if name is not None:
                        fold.aliases[t] = name
                fold.lists[row["ref"]] = [same.setdefault(t, t) for t in tokens]
                if row["edited"]:
                    edited.add(row["ref"])
            elif row["ref"] in fold.lists and row["other"] in fold.lists:
                if pending and not added:
                    added, pending = sorted(pending, reverse=True), []
                while added and added[-1][0] < row["seq"]:
                    _, t, n = added.pop()
                    fold.freq[t] = fold.count(t) + n
                one, two = row["ref"], row["other"]
                fold.edits, fold.compared = Counter(), []
                before = [list(fold.lists[x]) for x in (one, two)]
                fold.pair(one, two)
                if fold.edits:
                    edited.update(x for x, was in zip((one, two), before, strict=True) if fold.lists[x] != was)
                out += [{"unit": unit, "kind": EDIT, "seq": row["seq"], "old": old, "new": new, "n": n} for (old, new), n in fold.edits.items()]
                # the counts that all knew at first and this pair's own edits; what others before it added is found later
                out += [{"unit": unit, "kind": COMPARED, "seq": row["seq"], "old": a, "new": b, "n": own + base.get(a, counts_of.get(a, 0)) - base.get(b, counts_of.get(b, 0)), "low": low, "high": high} for a, b, own, low, high in fold.compared]
        yield from close()
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return run


class Corrected(NamedTuple):
    """edits: old, new, n (how often; old is empty where a token was put in). refs: refID, tokens, ord
    after them. rounds: how many times units were folded, one after another."""

    edits: DataFrame
    refs: DataFrame
    rounds: int


def _ordered(pairs: DataFrame, refs: DataFrame, most: int) -> DataFrame:
    """slab, unit, seq, refID1, refID2."""
    size = [refs.where(F.size("tokens") > 0).select(F.col("refID").alias(f"_{i}"), F.size("tokens").alias(f"n{i}")) for i in (1, 2)]
    rows = staged(pairs.join(size[0], F.col("refID1") == F.col("_1")).join(size[1], F.col("refID2") == F.col("_2")).select("refID1", "refID2", "n1", "n2"), n=F.count("*"))
    parts = max(1, -(-rows.seen["n"] // CUT_PAIRS))
    rows = rows.repartitionByRange(parts, "refID1", "refID2").sortWithinPartitions("refID1", "refID2")
    rows = rows.select(F.monotonically_increasing_id().alias("seq"), "refID1", "refID2", "n1", "n2")
    return rows.mapInArrow(cut_slabs(most), "slab long, unit long, seq long, refID1 string, refID2 string")


def _where(order: DataFrame) -> DataFrame:
    """ref, slab, unit, and the slab and unit that have ref next, or null."""
    reads = order.select("slab", "unit", F.explode(F.array("refID1", "refID2")).alias("ref")).distinct()
    following = F.lead(F.struct("slab", "unit")).over(Window.partitionBy("ref").orderBy("slab"))
    first = F.row_number().over(Window.partitionBy("ref").orderBy("slab")) == 1
    return reads.select("ref", "slab", "unit", following.alias("f"), first.alias("first")).select("ref", "slab", "unit", F.col("f.slab").alias("next_slab"), F.col("f.unit").alias("next_unit"), "first")


def _base(refs: DataFrame, freq: DataFrame, where: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, dict[str, tuple[int, str | None]]]:
    """The list of each reference that is read with the slab and unit that has it first, its rare
    tokens, their counts and formal names; and the same of the `HEAVIEST` most frequent tokens, which
    lists don't bring."""
    names = None if aliases is None else aliases.groupBy(F.col("alias").alias("_a")).agg(F.max("value").alias("value"))

    def named(rows):
        return rows.withColumn("value", F.lit(None).cast("string")) if names is None else rows.join(names, F.col("token") == F.col("_a"), "left").drop("_a")

    heavy = staged(named(freq.where(F.char_length("token") <= LETTERS).orderBy(F.desc("n"), "token").limit(HEAVIEST).select("token", "n")))
    common = {r["token"]: (r["n"], r["value"]) for r in heavy.collect()}  # so many at most
    first = where.where("first").select(F.col("ref").alias("_r"), "slab", F.col("unit").alias("next"))
    read = refs.select("refID", "tokens").join(first.select("_r"), F.col("refID") == F.col("_r"), "left_semi")
    tokens = read.select(F.col("refID").alias("ref"), F.explode("tokens").alias("token")).join(F.broadcast(heavy.select("token")), "token", "left_anti").distinct()
    tokens = named(tokens.join(freq.select("token", "n"), "token", "left"))
    rare = tokens.groupBy(F.col("ref").alias("_ref")).agg(F.collect_list(F.struct("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "value")).alias("t"))
    # packed before they are dealt out
    lists = refs.select("refID", "tokens").mapInArrow(pack_tokens, "refID string, list binary")
    rows = lists.join(first, F.col("refID") == F.col("_r")).join(rare, F.col("refID") == F.col("_ref"), "left")
    rows = rows.select(F.col("refID").alias("ref"), "slab", "next", "list", F.col("t.token").alias("rare"), F.col("t.n").alias("counts"), F.col("t.value").alias("formal"))
    return rows.mapInArrow(pack_lists, "ref string, slab long, next long, edited boolean, list binary"), common


def _folded(order: DataFrame, where: DataFrame, lists: DataFrame, added: DataFrame | None, common) -> DataFrame:
    """What the units of a slab write: order are their pairs, where their references."""
    kinds = {"unit": "long", "kind": "int", "seq": "long", "ref": "string", "other": "string", "n": "long", "slab": "long", "next": "long", "edited": "boolean", "list": "binary"}

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        columns["kind"] = F.lit(kind)
        return df.select(*(columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    own = {c: F.col(c) for c in kinds}
    lists = rows(lists, LIST, **{c: own[c] for c in ("ref", "edited", "list")}, unit=F.col("next"))
    every = lists.unionByName(rows(where, NEXT, unit=own["unit"], ref=own["ref"], slab=F.col("next_slab"), next=F.col("next_unit")))
    every = every.unionByName(rows(order, PAIR, unit=own["unit"], seq=own["seq"], ref=F.col("refID1"), other=F.col("refID2")))
    if added is not None:
        every = every.unionByName(rows(added, ADDED, unit=own["unit"], seq=own["seq"], ref=F.col("token"), n=own["n"]))
    return every.repartition("unit").sortWithinPartitions("unit", "kind", "seq").mapInArrow(fold_units(common), _WRITES)


def _wrong(now: DataFrame, before: DataFrame) -> DataFrame:
    """unit, token: of comparisons that come out otherwise if all edits before them count. before: how
    often slabs before have written a token."""
    compared = now.where(F.col("kind") == COMPARED).select("unit", "seq", "old", "new", "n", "low", "high", F.monotonically_increasing_id().alias("id"))
    compared = staged(compared)
    sides = [compared.select(F.col(c).alias("token"), "seq", "unit", "id", F.lit(sign).alias("sign")) for c, sign in (("old", 1), ("new", -1))]
    asked = sides[0].unionByName(sides[1])
    none = {"unit": F.lit(None).cast("long"), "id": F.lit(None).cast("long"), "sign": F.lit(0)}
    written = now.where(F.col("kind") == EDIT).groupBy(F.col("new").alias("token"), "seq").agg(F.sum("n").alias("k"))
    written = written.unionByName(before.select("token", F.lit(-1).cast("long").alias("seq"), F.col("n").alias("k")))
    written = written.join(asked.select("token").distinct(), "token", "left_semi")
    events = asked.withColumn("k", F.lit(0).cast("long")).unionByName(written.withColumns(none))
    total = F.coalesce(F.sum("k").over(Window.partitionBy("token").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = events.withColumn("extra", total).where("id IS NOT NULL").groupBy("id").agg(F.sum(F.col("sign") * F.col("extra")).alias("extra"))
    sign = F.signum(F.col("n") + F.col("extra"))
    bad = compared.join(extra, "id").where((sign < F.col("low")) | (sign > F.col("high")))
    return bad.select("unit", F.explode(F.array("old", "new")).alias("token")).distinct()


def _added(now: DataFrame, before: DataFrame, exact: DataFrame) -> DataFrame:
    """unit, token, seq, n: what other units of the slab, and the slabs before (seq -1), have written of
    the tokens that units are to count exactly; a token has a row even if nobody wrote it."""
    written = now.where(F.col("kind") == EDIT).groupBy(F.col("new").alias("token"), F.col("unit").alias("by"), "seq").agg(F.sum("n").alias("n"))
    own = exact.join(written, "token").where("by <> unit").select("unit", "token", "seq", "n")
    start = exact.join(before, "token", "left").select("unit", "token", F.lit(-1).cast("long").alias("seq"), F.coalesce("n", F.lit(0)).alias("n"))
    return own.unionByName(start)


def correct_blocks(refs: DataFrame, freq: DataFrame, pairs: DataFrame, aliases: DataFrame | None = None, unit_tokens: int = UNIT_TOKENS) -> Corrected:
    """References corrected by their candidate pairs (refID1, refID2). aliases: alias, value.

    Repeated pairs count once; a pair of a reference with itself or with an unknown one, and a
    reference without tokens, corrects nothing; a token that freq doesn't hold has count 0."""
    order = staged(_ordered(pairs.where("refID1 <> refID2").select("refID1", "refID2").distinct(), refs, unit_tokens))
    where = staged(_where(order))
    rows, common = _base(refs, freq, where, aliases)
    base = staged(rows, by="slab")
    slabs = [r["slab"] for r in order.select("slab").distinct().orderBy("slab").collect()]  # a slab holds many pairs
    kept: list[DataFrame] = []  # what the folds of slabs before have written and later ones didn't replace
    before: DataFrame | None = None
    rounds = 0
    lists_of = ("ref", "next", "edited", "list")
    for slab in slabs:
        mine, own = order.where(F.col("slab") == slab), where.where(F.col("slab") == slab)
        lists = base.where(F.col("slab") == slab).select(*lists_of)
        for x in kept:
            lists = lists.unionByName(x.where((F.col("slab") == slab) & (F.col("kind") == LIST)).select(*lists_of))
        layers = [staged(_folded(mine, own, lists, None, common), by="slab")]
        exact = None
        rounds += 1
        if before is None:
            before = order.sparkSession.createDataFrame([], "token string, n long")
        while True:
            wrong = staged(_wrong(_union(layers), before), n=F.count("*"))
            if not wrong.seen["n"]:
                break
            exact = staged(wrong if exact is None else exact.unionByName(wrong).distinct())
            units = F.broadcast(staged(wrong.select("unit").distinct()))
            added = staged(_added(_union(layers), before, exact.join(units, "unit", "left_semi")))
            again = [x.join(units, "unit", "left_semi") for x in (mine, own)]
            only = lists.join(units, F.col("next") == F.col("unit"), "left_semi")
            fresh = staged(_folded(*again, only, added, common), by="slab")
            layers = [*(x.join(units, "unit", "left_anti") for x in layers), fresh]
            rounds += 1
        kept += layers
        written = _union(layers).where(F.col("kind") == EDIT).select(F.col("new").alias("token"), "n")
        before = staged(before.unionByName(written).groupBy("token").agg(F.sum("n").alias("n")))
    if not kept:
        none = order.sparkSession.createDataFrame([], "old string, new string, n long")
        return Corrected(none, refs.select("refID", "tokens", "ord"), 1)
    unstage(base)
    done = _union(kept)
    edits = done.where(F.col("kind") == EDIT).groupBy("old", "new").agg(F.sum("n").alias("n"))
    new = done.where((F.col("kind") == LIST) & F.col("slab").isNull() & F.col("edited")).select(F.col("ref").alias("_id"), F.col("tokens").alias("_t"))
    whole = refs.join(new.select("_id"), F.col("refID") == F.col("_id"), "left_anti").select("refID", "tokens", "ord")
    fixed = refs.select("refID", "ord").join(new, F.col("refID") == F.col("_id")).select("refID", F.col("_t").alias("tokens"), "ord")
    return Corrected(edits, whole.unionByName(fixed), rounds)


def _union(layers: list[DataFrame]) -> DataFrame:
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out
