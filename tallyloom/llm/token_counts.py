"""Token counts by a linear longest-match automaton (Song et al., Fast WordPiece Tokenization, 2021).

Greedy longest match over a fixed vocabulary: a word's first piece comes from the pieces that start a word, the
rest from those that continue one. The automaton is a trie of both with failure links; instead of the pieces
that a failure pops it keeps their number, so a word's token count is found in time linear in its bytes
without building a piece.

A byte-level vocabulary is used: pieces with a leading space start a word, others continue it. All single
bytes are pieces, so every word has a count; with another vocabulary, a word without a match counts 1.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import slices, spare

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words of which a Python worker keeps the counts, and the longest such word in bytes.
KEPT_WORDS, KEPT_BYTES = 100_000, 48


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: a line has a piece in base64 and its rank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Counts the greedy longest-match pieces of words. Node 0 starts a word, node 1 continues one."""

    def __init__(self, pieces: list[bytes]):
        go: dict[int, int] = {}
        final, size = set(), 2
        for piece in pieces:
            starts = piece[:1] == b" "
            if not piece or len(piece[starts:].split()) != (len(piece) > starts) or piece[starts:].strip() != piece[starts:]:
                continue  # white space inside: no word has that
            u = 0 if starts else 1
            for c in piece:
                v = go.get(u << 8 | c)
                if v is None:
                    v = go[u << 8 | c] = size
                    size += 1
                u = v
            final.add(u)
        children: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for k, v in go.items():
            children[k >> 8].append((k & 255, v))
        fail, pops = [-1] * size, [0] * size
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in children[u]:
                queue.append(v)
                if v in final:
                    fail[v], pops[v] = 1, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and (z << 8 | c) not in go:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = go[z << 8 | c], n
        self.go, self.fail, self.pops = go, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of one word (no white space in it), 1 if it can't be matched."""
        get, fail, pops, u, n = self.go.get, self.fail, self.pops, 0, 0
        for c in b" " + word:
            while (v := get(u << 8 | c)) is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = v
        while u != 1:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class Counts(dict):
    """word -> pieces; a bounded memory of what the automaton has found."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", keep: list[str] | None = None, words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """The columns `keep` (None: all) of docs and two bigint columns more: words and their pieces, over the whole text.

    Null and empty texts count 0. Rows, ties and repeated rows stay as they are; an empty table stays empty.
    Columns of docs that have the new columns' names are replaced. The automaton is broadcast; the vocabulary
    file, which no data grows, bounds it.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Automaton(read_vocabulary(vocabulary)))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (words, tokens)]
    last = spare(docs, "words_of")
    docs = docs.select(*keep, F.col(text).cast("binary").alias(last))
    schema = docs.drop(last).schema.add(words, "long").add(tokens, "long")

    def run(batches):
        counts = Counts(held.value)
        for batch in slices(batches):
            n_words, n_tokens = [], []
            for t in batch.column(len(keep)):
                w = t.as_py().split() if t.is_valid else []
                n_words.append(len(w))
                n_tokens.append(sum(map(counts.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, words, tokens])

    return docs.mapInArrow(run, schema)
