"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Words whose counts a task remembers.
CACHE = 1 << 18
START = "▁"


class Automaton:
    """Trie of a vocabulary with failure links and, for each link, the number of tokens that taking it pops.

    The trie holds the pieces that may begin a word below node 0 and those that may continue one below node 1. Where no
    child matches, the failure link leads to the node for what is left after the longest pieces matched so far have
    been split off; only their number is kept. Reading a word takes time linear in its length and builds no piece.
    """

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        ends = {self._add(root, piece) for root, pieces in ((0, initial), (1, continuing)) for piece in pieces if piece}
        queue = [(root, c, v) for root in (0, 1) for c, v in self.children[root].items()]
        for parent, c, v in queue:
            if v in ends:
                self.fail[v], self.pops[v] = 1, 1
            else:
                z, popped = self.fail[parent], self.pops[parent]
                while z >= 0 and c not in self.children[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.children[z][c], popped
            queue.extend((v, d, w) for d, w in self.children[v].items())

    def _add(self, root: int, piece: str) -> int:
        v = root
        for c in piece:
            w = self.children[v].get(c)
            if w is None:
                w = self.children[v][c] = len(self.children)
                self.children.append({})
                self.fail.append(-1)
                self.pops.append(0)
            v = w
        return v

    def count(self, word: str) -> int:
        """Tokens of greedy longest-match word pieces; 0 where some part of the word matches no piece."""
        children, fail, pops = self.children, self.fail, self.pops
        v = n = 0
        for c in word:
            w = children[v].get(c)
            while w is None:
                if fail[v] < 0:
                    return 0
                n += pops[v]
                v = fail[v]
                w = children[v].get(c)
            v = w
        while v != 1:
            if fail[v] < 0:
                return 0
            n += pops[v]
            v = fail[v]
        return n


def vocabulary(path: str = "/opt/tokenizers/piece_bpe_32k.model") -> tuple[set[str], set[str]]:
    """Initial and continuing pieces of a sentence-piece vocabulary file: those after its word mark begin words, the
    others continue them; single characters do both."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    initial = {p[1:] for p in pieces if p.startswith(START)} | {p for p in pieces if len(p) == 1 and p != START}
    return {p for p in initial if p and START not in p}, {p for p in pieces if START not in p}


def token_counts(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_tokens, n_unknown) for every row, over its whole text.

    A word that can't be split into pieces of the vocabulary is one unknown token, as long as it may be. Null and
    empty texts count zero; equal rows give equal counts, one row each. One narrow pass, no shuffle. The automaton is
    broadcast: its size is that of the vocabulary, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = shared.value.count, {}
        for batch in batches:
            columns: tuple[list[int], ...] = ([], [], [])
            for text in batch.column(1):
                found = words(text.as_py())
                if len(known) > CACHE:
                    known.clear()
                tokens = unknown = 0
                for word in found:
                    n = known.get(word)
                    if n is None:
                        n = count(word.decode())
                        if len(word) < 256:
                            known[word] = n
                    tokens += n or 1
                    unknown += not n
                for column, value in zip(columns, (len(found), tokens, unknown)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
