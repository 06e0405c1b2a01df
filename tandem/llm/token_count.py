"""Token counts: greedy longest-match pieces counted by a linear automaton.

The vocabulary is a trie. For each node the automaton holds a failure link and how many pieces
are popped on taking it: if the walk cannot go on from a node, the longest
pieces of what was read are taken off its front until a node remains that spells
the rest. Both are computed once from the parent's, so a word of n bytes is counted in
O(n) steps, and no piece is ever built.

A text's words are its runs without ASCII white space; every word is matched with a
blank before it, as byte-level vocabularies spell it. A word that the vocabulary cannot
spell counts as one unknown piece. Counts of words already met are remembered in a table
of bounded size.

Edge cases: null and empty texts, and texts of white space, have no tokens; equal rows
give equal counts; texts of any length are counted whole; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words remembered by a worker.
MEMO = 1 << 19
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces with ranks, a line each."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links; node 0 is the root, -1 no link."""

    def __init__(self, pieces: Iterable[bytes]) -> None:
        nodes: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for b in piece:
                nxt = nodes[at].get(b)
                if nxt is None:
                    nxt = nodes[at][b] = len(nodes)
                    nodes.append({})
                    whole.append(False)
                at = nxt
            if at:
                whole[at] = True
        fail, pops = [-1] * len(nodes), [0] * len(nodes)
        level = [0]
        while level:
            below = []
            for u in level:
                for b, v in nodes[u].items():
                    below.append(v)
                    if whole[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    # What stands before v's last byte is popped until that byte can follow.
                    z, n = fail[u], pops[u]
                    while z >= 0 and b not in nodes[z]:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = nodes[z][b], n
            level = below
        self.nodes, self.fail, self.pops = nodes, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; 1 if some byte cannot be spelled, 0 for no bytes."""
        nodes, fail, pops = self.nodes, self.fail, self.pops
        at = total = 0
        for b in word:
            nxt = nodes[at].get(b)
            while nxt is None:
                total += pops[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = nodes[at].get(b)
            at = nxt
        while at > 0:
            total += pops[at]
            at = fail[at]
        return total if at == 0 else 1


@lru_cache(maxsize=2)
def _automaton(path: str) -> Automaton:
    return Automaton(read_vocabulary(path))


def count_text(text: str | None, automaton: Automaton, memo: dict[bytes, int]) -> int:
    total = 0
    count, get = automaton.count, memo.get
    for word in (text or "").encode("utf-8", "replace").split():
        n = get(word)
        if n is None:
            n = count(b" " + word)
            if len(memo) < MEMO:
                memo[word] = n
        total += n
    return total


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row. ``vocabulary`` is a path that each machine has."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = _automaton(vocabulary), {}
        for batch in batches:
            counts = [count_text(x, automaton, memo) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
