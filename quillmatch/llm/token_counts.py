"""Edit-aware token counts.

A document's text is parted into pre-tokens by the tokenizer's pattern; no merge crosses one, so
the text's count is the sum of theirs. Leaves of up to `LEAF` pre-tokens hang under a segment tree
of sums (code points and tokens). An edit descends the tree to the pre-token at its place, starts
two pre-tokens before it (the pattern looks one character past a run of white space, and a
contraction joins what stood apart), and parts the new text anew until a boundary falls on an old
one behind the edit. From there on the parting is as it was, since the pattern never looks back.
Only the pre-tokens between are encoded again, and only the touched leaves' paths are summed again.

Edits are (at, removed, inserted) in code points of the text as the edits before it left it; a
place beyond the text's end is its end, a negative one its begin.

Defined results: a null text is empty and has no tokens; a document without edits has equal counts
before and after; an edit whose place is null is skipped, a null `removed` removes nothing and a
null `inserted` inserts nothing; repeated rows are counted one by one; edits of a doc_id hold for
each of its rows; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_of, id_type

LEAF = 64

#: Fixed value: the pattern that parts text before merges, as the vocabulary was made with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Tokens of pre-tokens; those of a bounded number are remembered."""

    def __init__(self, path: str, room: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.room = room

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        new = [p for p in set(parts) if p not in known]
        if new:
            if len(known) > self.room:
                known.clear()
                new = list(set(parts))
            for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[p] = len(e.ids)
        return [known[p] for p in parts]


class Document:
    """A text with the segment tree of its pre-tokens."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        parts = counter.pattern.findall(text)
        self.n_parts = len(parts)
        self.encoded = 0  # pre-tokens encoded again by edits
        self._build(list(map(len, parts)), counter.counts(parts))

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.leaves = [(chars[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(chars), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, dtype=np.int64)
        self.tokens = np.zeros(2 * self.size, dtype=np.int64)
        for i, (c, t) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(c), sum(t)
        level = self.size
        while level > 1:
            half = level // 2
            self.chars[half:level] = self.chars[level : 2 * level].reshape(-1, 2).sum(axis=1)
            self.tokens[half:level] = self.tokens[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level = half

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, index within it, and first code point of the pre-token that holds code point `at`
        (the last one, for the text's end)."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        leaf = node - self.size
        for i, c in enumerate(self.leaves[leaf][0]):
            if at < start + c or i == len(self.leaves[leaf][0]) - 1:
                return leaf, i, start
            start += c
        return leaf, 0, start

    def edit(self, at: int, removed: int, inserted: str) -> None:
        n = len(self.text)
        at = min(max(at, 0), n)
        end = min(at + max(removed, 0), n)
        leaf, i, start = self._find(at)
        for _ in range(2):  # pre-tokens before it, the boundary context
            if i == 0:
                before = leaf - 1
                while before >= 0 and not self.leaves[before][0]:
                    before -= 1
                if before < 0:
                    break
                leaf, i = before, len(self.leaves[before][0])
            i -= 1
            start -= self.leaves[leaf][0][i]
        self.text = self.text[:at] + inserted + self.text[end:]
        shift = len(inserted) - (end - at)

        # old boundaries from `start` on, one by one, as far as they are needed
        old_leaf, old_i, old_at = leaf, i, start

        def advance() -> bool:
            nonlocal old_leaf, old_i, old_at
            while old_leaf < len(self.leaves) and old_i >= len(self.leaves[old_leaf][0]):
                old_leaf, old_i = old_leaf + 1, 0
            if old_leaf >= len(self.leaves):
                return False
            old_at += self.leaves[old_leaf][0][old_i]
            old_i += 1
            return True

        parts: list[str] = []
        pos = start
        more = True
        for m in self.counter.pattern.finditer(self.text, start):
            parts.append(m.group())
            pos = m.end()
            while more and (old_at < end or old_at + shift < pos):
                more = advance()
            if old_at >= end and old_at + shift == pos:
                break
        else:
            while advance():  # nothing of the old parting is left behind
                pass
        self._replace(leaf, i, old_leaf, old_i, parts)

    def _replace(self, leaf: int, i: int, to_leaf: int, to_i: int, parts: list[str]) -> None:
        """Put parts where the pre-tokens from (leaf, i) up to (to_leaf, to_i) were."""
        self.encoded += len(parts)
        tokens = self.counter.counts(parts)
        chars = list(map(len, parts))
        if to_leaf >= len(self.leaves):
            to_leaf, to_i = len(self.leaves) - 1, len(self.leaves[-1][0])
        head_c, head_t = self.leaves[leaf]
        tail_c, tail_t = self.leaves[to_leaf]
        gone = sum(len(self.leaves[k][0]) for k in range(leaf, to_leaf + 1)) - i - (len(tail_c) - to_i)
        self.leaves[leaf] = (head_c[:i] + chars + tail_c[to_i:], head_t[:i] + tokens + tail_t[to_i:])
        self.n_parts += len(parts) - gone
        for k in range(leaf + 1, to_leaf + 1):
            self.leaves[k] = ([], [])
        if len(self.leaves[leaf][0]) > 4 * LEAF:
            self._build([c for p, _ in self.leaves for c in p], [t for _, p in self.leaves for t in p])
            return
        for k in range(leaf, to_leaf + 1):
            self._update(k)


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row for each document: doc_id, n_pretokens and n_tokens of the text, edited_tokens and
    edited_chars of the text after its edits, n_encoded (pre-tokens that the edits had encoded).

    edits: doc_id, edits (array of struct at, removed, inserted), a row for each doc_id."""
    kind = id_type(docs, "doc_id")
    own = edits.select(F.col("doc_id").alias("_id"), "edits")
    rows = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "edits")
    return _counted(rows, kind, tokenizer_path)


def count_with(docs: DataFrame, edits, tokenizer_path: str) -> DataFrame:
    """count_edited() where the edits are a column expression of docs: no join."""
    return _counted(docs.select("doc_id", "text", edits.alias("edits")), id_type(docs, "doc_id"), tokenizer_path)


def _counted(rows: DataFrame, kind: str, tokenizer_path: str) -> DataFrame:
    bounded_batches(rows.sparkSession)
    ddl = f"doc_id {kind}, n_pretokens long, n_tokens long, edited_tokens long, edited_chars long, n_encoded long"

    def run(it):
        counter = Counter(tokenizer_path)
        for batch in it:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc = Document(text or "", counter)
                n, parts = doc.n_tokens, doc.n_parts
                for e in edits or []:
                    if e is not None and e["at"] is not None:
                        doc.edit(e["at"], e["removed"] or 0, e["inserted"] or "")
                out.append((parts, n, doc.n_tokens, len(doc.text), doc.encoded))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.int64()) for c in columns_of(out, 5))], names=["doc_id", "n_pretokens", "n_tokens", "edited_tokens", "edited_chars", "n_encoded"])

    return rows.mapInArrow(run, ddl)
