"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds its distinct shingles of `k` words (A-Z lower-cased, parted by ASCII white
space); a text of fewer words is one shingle as a whole. Documents of equal sets form a class, and
classes are joined. Each class has `tokens` minwise tokens of its set. A tree branches it from the
root down: a node chooses one or two of the token positions, 1/similarity on average, and the
values there name the children. Two classes of the wanted similarity meet in a leaf of a tree of
depth 4 with probability 0.64, and `trees` independent trees miss them all with probability
0.36^trees (1e-7 for 16); more similar ones meet more often.

Each class carries a digest of 64 of its tokens, four bits of each, with which a pair that is far
below the wanted similarity is told at once; a pair of the wanted similarity is five standard
errors away from that. Leaves are compared in two steps, so that a large group of near copies is
neither gathered in one task nor spelled out as pairs:
1. Each leaf links its classes to its smallest one where the digests allow it; links are confirmed
   on full sets, and components are formed of them.
2. Leaves that still hold several components, each set of classes once, are compared exhaustively:
   classes that have a partner in another component by the digests are brought together with their
   full sets, and those that are similar enough are linked, one link for each two components that
   it joins. A leaf beyond `block` classes is a node that is not small yet: it is branched on, up
   to `deeper` levels further, until its children are small or hold one component, or a level parts
   little of what is left (near copies stay together, and their number grows on the way). A pair of the
   wanted similarity meets there still with probability 0.46 (at 8 levels) to 0.36 (at 12) a tree,
   and all trees miss it with probability 5e-5 to 8e-4. What doesn't part by then, such as nodes
   of much the same texts, is dealt out as pairs of blocks, so that no task holds more than two.

The sets are not kept: those of the classes that meet are made anew from their texts.

Defined results: a null text or one without words has an empty set and links with nothing; a null
doc_id links with nothing and is kept; rows of equal doc_id are one node of the link graph,
so that their texts' classes are linked, and each gets a row (one without words has its own id as
component); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.operators.closure import components
from quillmatch.plans.staging import staged, unstage

from .common import arrow_schema, bounded_batches, columns_of, hashed_words, id_type, mix, slices, texts, trimmed

K = 3
SIMILARITY = 85  # percent
TOKENS = 128
TREES = 16
DEPTH = 4
BLOCK = 512
#: Levels below DEPTH that nodes of more than BLOCK classes are branched on.
DEEPER = 8
#: Branching ends where a level leaves more than this share of the classes in large nodes.
PARTING = 0.75
#: Tokens in a digest, and how many of a digest fit one long.
DIGEST, PER_LONG = 64, 16
#: Up to so many ids of meeting classes are broadcast (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint64).astype(np.uint32)
_MUL = _RNG.integers(0, 1 << 31, 1024, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingled(batch: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    h, n = hashed_words(batch)
    first = np.cumsum(n) - n
    width = np.minimum(n, k)  # a text of fewer words is one shingle
    s = np.repeat(width, n).astype(np.uint64)
    for j in range(k):
        more = np.repeat(width > j, n)
        s = np.where(more, mix(s * _STEP + np.append(h[j:], np.zeros(min(j, len(h)), dtype=np.uint64))), s)
    return [np.unique(s[a : a + m - w + 1]) if m else s[:0] for a, m, w in zip(first.tolist(), n.tolist(), width.tolist(), strict=True)]


def minwise(shingles: np.ndarray, tokens: int) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty(tokens, dtype=np.uint32)
    for at in range(0, len(x), 1 << 14):  # a part that stays in the cache
        part = x[at : at + (1 << 14)]
        for i in range(tokens):
            low = ((part ^ _XOR[i]) * _MUL[i]).min()
            out[i] = low if not at else min(low, out[i])
    return out


def children(sig: np.ndarray, key: np.ndarray, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first and the second child of each row's node, and whether the node has it."""
    n, tokens = sig.shape
    more = np.uint64(min(int((1 / similarity - 1) * 2**64), 2**64 - 1))

    def place(salt: int) -> np.ndarray:
        return (mix(key + np.uint64(salt)) >> np.uint64(33)) % np.uint64(tokens)

    def child(at: np.ndarray) -> np.ndarray:
        return mix(mix(key * _STEP + at) + sig[np.arange(n), at.astype(np.int64)])

    one, two = place(1), place(3)
    # a second choice of the same place would be the first child again
    return [(child(one), np.ones(n, dtype=bool)), (child(two), (mix(key + np.uint64(2)) < more) & (one != two))]


def leaves(sig: np.ndarray, trees: int, depth: int, similarity: float):
    """For each leaf slot of each tree, the leaf of every row of sig and whether the row has it."""
    n = len(sig)
    for tree in range(trees):
        nodes = [(mix(np.full(n, tree + 1, dtype=np.uint64)), np.ones(n, dtype=bool))]
        for _ in range(depth):
            below = [(k, h & has) for key, has in nodes for k, h in children(sig, key, similarity)]
            nodes = [(key, has) for key, has in below if has.any()]
        yield from nodes


def sketch(docs: DataFrame, k: int = K, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles, hi and lo (a 128-bit digest of the set), sig (the minwise tokens)."""
    ddl = f"doc_id {id_type(docs, 'doc_id')}, n_shingles long, hi long, lo long, sig binary"
    schema = arrow_schema(ddl)

    def run(it):
        for batch in slices(trimmed(it)):
            n, hi, lo, sig = [], [], [], []
            for s in shingled(texts(batch), k):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                hi.append(int.from_bytes(digest[:8], "big", signed=True))
                lo.append(int.from_bytes(digest[8:], "big", signed=True))
                sig.append(minwise(s, tokens).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=f.type) for c, f in zip((n, hi, lo, sig), list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def _digests(sig: np.ndarray) -> np.ndarray:
    """The low four bits of the first tokens, PER_LONG of them in each long."""
    low = (sig[:, :DIGEST] & np.uint32(15)).astype(np.uint64)
    out = np.zeros((len(sig), DIGEST // PER_LONG), dtype=np.uint64)
    for i in range(low.shape[1]):
        out[:, i // PER_LONG] |= low[:, i] << np.uint64(4 * (i % PER_LONG))
    return out.view(np.int64)


_MINI = [f"m{i}" for i in range(DIGEST // PER_LONG)]


def _nibbles(columns: list) -> np.ndarray:
    """Digest columns of a batch as a matrix of tokens' low bits."""
    longs = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).view(np.uint64)
    shift = np.uint64(4) * np.arange(PER_LONG, dtype=np.uint64)
    return ((longs[:, :, None] >> shift) & np.uint64(15)).astype(np.uint8).reshape(len(longs), -1)


def leaf_rows(reps: DataFrame, similarity: float, trees: int, depth: int, digests: bool) -> DataFrame:
    """leaf, rep and, if asked for, the digest's columns."""
    extra = [f"{m} long" for m in _MINI] if digests else []
    ddl = ", ".join(["leaf long", f"rep {id_type(reps, 'rep')}", *extra])
    schema = arrow_schema(ddl)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)
            mini = _digests(sig) if digests else None
            for key, has in leaves(sig, trees, depth, similarity):
                rest = [pa.array(np.ascontiguousarray(mini[has, i])) for i in range(len(_MINI))] if digests else []
                yield pa.RecordBatch.from_arrays([pa.array(key[has].view(np.int64)), batch.column(0).take(pa.array(np.flatnonzero(has))), *rest], schema=schema)

    return reps.select("rep", "sig").mapInArrow(run, ddl)


def star_links(members: DataFrame, least: float) -> DataFrame:
    """a, b: each class of a leaf with the leaf's smallest, where their digests agree enough. Rows
    are sorted by leaf and class, and no leaf is held: only its first row."""
    kind = id_type(members, "rep")
    ddl = f"a {kind}, b {kind}"
    schema = arrow_schema(ddl)

    def run(it):
        last = None  # leaf, rep and digest of the open leaf's first row
        for batch in it:
            if not batch.num_rows:
                continue
            leaf, rep = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            bits = _nibbles(batch.columns[2:])
            new = np.ones(len(leaf), dtype=bool)
            new[1:] = leaf[1:] != leaf[:-1]
            reps, at = rep, np.maximum.accumulate(np.where(new, np.arange(len(leaf)), 0))
            first = bits[at]
            if last is not None and last[0] == leaf[0]:  # the leaf goes on from the batch before
                to = int(np.argmax(new[1:])) + 1 if new[1:].any() else len(leaf)
                first[:to] = last[2]
                reps = pa.concat_arrays([rep, pa.array([last[1]], type=rep.type)])
                at[:to] = len(leaf)
            near = ((bits == first).mean(axis=1) >= least) & (at != np.arange(len(leaf)))
            keep = np.flatnonzero(near)
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(at[keep])), rep.take(pa.array(keep))], schema=schema)
            last = (leaf[-1], reps[int(at[-1])].as_py(), first[-1].copy())

    rows = members.select("leaf", "rep", *_MINI).repartition("leaf").sortWithinPartitions("leaf", "rep")
    return rows.mapInArrow(run, ddl).where("a <> b").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, bag: the sets of the documents in ids (a column id), as sorted 64-bit hashes."""
    few = ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    ddl = f"id {id_type(ids, 'id')}, bag binary"
    schema = arrow_schema(ddl)

    def run(it):
        for batch in slices(trimmed(it)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingled(texts(batch), k)], type=pa.binary())], schema=schema)

    return rows.mapInArrow(run, ddl)


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = staged(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    bags = staged(full_sets(docs, ids, k))
    left, right = bags.select(F.col("id").alias("_a"), F.col("bag").alias("bag_a")), bags.select(F.col("id").alias("_b"), F.col("bag").alias("bag_b"))
    rows = pairs.join(right, pairs["b"] == right["_b"]).select("a", "b", "bag_b")
    rows = rows.join(left, rows["a"] == left["_a"]).select("a", "b", "bag_a", "bag_b")
    ddl = f"a {id_type(pairs, 'a')}, b {id_type(pairs, 'b')}"
    schema = arrow_schema(ddl)

    def run(it):
        for batch in trimmed(it):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if min(len(p), len(q)) * 100 < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], schema=schema) if keep else pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema)

    out = staged(rows.mapInArrow(run, ddl))
    unstage(ids)
    unstage(bags)
    return out


def _grouped(it, keys: int):
    """Groups of consecutive rows that agree in their first columns, as lists of rows."""
    group: list[tuple] = []
    for batch in it:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[0][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _other(group: list[tuple], p: int, comp: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which later rows of a block pair (leaf, i, j) are to be compared with row p: those of another
    component and, as a block meets itself in a group of its own, of the other block."""
    out = comp != comp[p]
    out[: p + 1] = False
    if group[0][1] != group[0][2]:
        out &= own != own[p]
    return out


def with_partner(blocks: DataFrame, least: float) -> DataFrame:
    """leaf, i, j, rep, comp, own of the classes with a partner by the digests."""
    kind = id_type(blocks, "rep")
    ddl = f"leaf long, i int, j int, rep {kind}, comp {kind}, own int"
    schema = arrow_schema(ddl)

    def run(it):
        out: list[tuple] = []
        shift = np.uint64(4) * np.arange(PER_LONG, dtype=np.uint64)
        for group in _grouped(it, 3):
            longs = np.array([r[6:] for r in group], dtype=np.int64).view(np.uint64)
            bits = ((longs[:, :, None] >> shift) & np.uint64(15)).astype(np.uint8).reshape(len(group), -1)
            comp, own = np.unique([str(r[4]) for r in group], return_inverse=True)[1], np.array([r[5] for r in group])
            found = np.zeros(len(group), dtype=bool)
            for p in range(len(group)):
                at = np.flatnonzero(_other(group, p, comp, own))
                if len(at):
                    at = at[(bits[at] == bits[p]).mean(axis=1) >= least]
                    if len(at):
                        found[p] = True
                        found[at] = True
            out += [r[:6] for r, f in zip(group, found.tolist(), strict=True) if f]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_of(out, 6), schema, strict=True)], schema=schema)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_of(out, 6), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, ddl)


def similar(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: for each two components in a block pair that have a pair of similar full sets, such a
    pair; rows are leaf, i, j, rep, comp, own, bag."""
    kind = id_type(rows, "rep")
    ddl = f"a {kind}, b {kind}"
    schema = arrow_schema(ddl)

    def links(group: list[tuple]) -> list[tuple]:
        bags = [np.frombuffer(r[6], dtype=np.uint64) for r in group]
        size = np.array([len(x) for x in bags])
        ids, flat = np.unique(np.concatenate(bags), return_inverse=True)
        end = np.cumsum(size)
        comp, own = np.unique([str(r[4]) for r in group], return_inverse=True)[1], np.array([r[5] for r in group])
        out = []
        for p in range(len(group)):
            other = _other(group, p, comp, own)
            if not other.any():
                continue
            mark = np.zeros(len(ids), dtype=np.int64)
            mark[flat[end[p] - size[p] : end[p]]] = 1
            total = np.concatenate([[0], np.cumsum(mark[flat])])
            both = total[end] - total[end - size]
            for q in np.flatnonzero(other & (100 * both >= percent * (size[p] + size - both))).tolist():
                if comp[p] != comp[q]:
                    out.append((min(group[p][3], group[q][3]), max(group[p][3], group[q][3])))
                    comp[comp == comp[q]] = comp[p]
        return out

    def run(it):
        out: list[tuple] = []
        for group in _grouped(it, 3):
            out += links(group)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_of(out, 2), schema, strict=True)], schema=schema)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_of(out, 2), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl).distinct()


def near_duplicates(docs: DataFrame, k: int = K, percent: int = SIMILARITY, tokens: int = TOKENS, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK, deeper: int = DEEPER, least_agreement: float | None = None) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id, kept."""
    similarity = percent / 100
    # five standard errors of the agreement of a digest's tokens below the wanted similarity
    least = similarity - 5 * (similarity * (1 - similarity) / DIGEST) ** 0.5 if least_agreement is None else least_agreement
    bounded_batches(docs.sparkSession)
    rows = staged(sketch(docs, k, tokens))
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    reps = staged(classes)

    live = leaf_rows(reps, similarity, trees, depth, False).groupBy("leaf").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("kind"), F.min("rep").alias("low"), F.max("rep").alias("top")).where("low < top").select(F.col("leaf").alias("_leaf"), "size", "kind")
    spread = leaf_rows(reps, similarity, trees, depth, True)
    members = staged(spread.join(live, spread["leaf"] == live["_leaf"]).drop("_leaf"))

    stars = staged(star_links(members, least))
    links = confirmed(docs, stars, k, percent).unionByName(_several(rows, reps))
    unstage(stars)
    found = staged(components(links))

    mixed = staged(_mixed(members, found))
    unstage(members)
    before = None
    for _ in range(deeper):
        large = mixed.where(F.col("size") > block)
        n = large.count()
        if not n or (before is not None and n > PARTING * before):
            break
        before = n
        below = staged(_several_components(_below(large, reps, similarity)).unionByName(mixed.where(F.col("size") <= block)))
        unstage(mixed)
        mixed = below
    if not mixed.isEmpty():
        near = staged(with_partner(_blocks(mixed, block), least))
        bags = full_sets(docs, staged(near.select(F.col("rep").alias("id")).distinct()), k).withColumnRenamed("id", "_id")
        sets = near.join(bags, near["rep"] == bags["_id"]).select("leaf", "i", "j", "rep", "comp", "own", "bag")
        more = staged(similar(sets.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j"), percent))
        if not more.isEmpty():
            found = staged(components(links.unionByName(more)))
    unstage(mixed)

    named = reps.select("hi", "lo", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.join(named, (rows["hi"] == named["_hi"]) & (rows["lo"] == named["_lo"]), "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _several(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b: each doc_id that has texts of several classes, with those classes' representatives."""
    own = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "hi", "lo")
    both = own.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("p"), F.max(F.struct("hi", "lo")).alias("q")).where("p <> q").select("doc_id")
    names = reps.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "rep")
    found = own.join(both, "doc_id", "left_semi").distinct()
    return found.join(names, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo"))).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """leaf, rep, comp, size and digest, in leaves of three or more classes that hold several
    components; of leaves that hold the same classes one is enough."""
    found = found.select(F.col("node").alias("_node"), "component")
    rows = members.where("size > 2").join(found, members["rep"] == found["_node"], "left").select("leaf", "rep", F.coalesce("component", "rep").alias("comp"), *_MINI)
    return _several_components(rows)


def _several_components(rows: DataFrame) -> DataFrame:
    """rows (leaf, rep, comp and digest) of leaves that hold several components, with the leaf's
    size; of leaves that hold the same classes one is enough."""
    several = rows.groupBy("leaf").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("kind"), F.min("comp").alias("p"), F.max("comp").alias("q")).where("p < q")
    one = several.groupBy("size", "kind").agg(F.min("leaf").alias("_leaf")).select("_leaf", "size")
    return rows.join(one, rows["leaf"] == one["_leaf"]).select("leaf", "rep", "comp", "size", *_MINI)


def _below(nodes: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """leaf, rep, comp and digest of the nodes' children."""
    kind = id_type(reps, "rep")
    ddl = ", ".join(["leaf long", f"rep {kind}", f"comp {kind}", *(f"{m} long" for m in _MINI)])
    schema = arrow_schema(ddl)

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1)
            for key, has in children(sig, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), similarity):
                at = pa.array(np.flatnonzero(has))
                yield pa.RecordBatch.from_arrays([pa.array(key[has].view(np.int64)), *(c.take(at) for c in batch.columns[2:])], schema=schema)

    own = reps.select(F.col("rep").alias("_rep"), "sig")
    return nodes.join(own, nodes["rep"] == own["_rep"]).select("sig", "leaf", "rep", "comp", *_MINI).mapInArrow(run, ddl)


def _blocks(mixed: DataFrame, block: int) -> DataFrame:
    """leaf, i, j, rep, comp, own and digest: each class in all pairs of its own block."""
    rows = mixed.withColumn("n", F.ceil(F.col("size") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "comp", "own", *_MINI)
    return rows.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
