"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens of a batch go into a trie. Each node holds the best
forward score of its prefix and the number of tokens on the best path; a node
looks back along its own path, so a shared prefix is scored once. A pre-token's
count is stored at its last node.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import trie_walk

#: Pre-tokens whose counts a worker keeps before it starts anew, and the longest kept, so that bytes are bounded too.
KEEP, KEEP_LENGTH = 400_000, 64
#: Bytes from which on a pre-token is no part of the trie.
LONG = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64-token rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class UnigramCounter:
    """Counts tokens of texts.

    The vocabulary carries ranks, no probabilities: a token's log probability is
    taken from its rank by Zipf's law, -ln(rank + 1) less a constant that a path
    pays once a token. Every byte is a token, so every pre-token has a path.
    Equal scores go to the longer last token.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        norm = math.log(sum(1.0 / (r + 1) for r in ranks.values()))
        self.score = {t: -math.log(r + 1) - norm for t, r in ranks.items()}
        self.endings = {t[i:] for t in self.score for i in range(len(t))}
        self.longest = max(map(len, self.score))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def enter(self, path: list[int], states: list[tuple[float, int]]) -> tuple[float, int]:
        n, best, count = len(path), -math.inf, 0
        word, score, endings = bytes(path[-self.longest :]), self.score, self.endings  # no token is longer
        skipped = n - len(word)
        for i in range(len(word) - 1, -1, -1):
            tail = word[i:]
            if tail not in endings:
                break
            s = score.get(tail)
            if s is not None:
                before = states[skipped + i]
                s += before[0]
                if s >= best:
                    best, count = s, before[1] + 1
        return best, count

    def alone(self, word: bytes) -> int:
        """Tokens of one very long word, by the same steps with the last states only."""
        states, path = [(0.0, 0)], []
        for symbol in word:
            path.append(symbol)
            states.append(self.enter(path, states))
            if len(path) > 4 * self.longest:
                del path[: -self.longest]
                del states[: -self.longest - 1]
        return states[-1][1]

    def learn(self, words) -> None:
        """Stores the tokens of distinct words, by one walk of their trie; those of over LONG bytes, which would hold as many states, go alone."""
        back = {w.encode(): w for w in words}
        for word in [w for w in back if len(w) > LONG]:
            self.known[back.pop(word)] = self.alone(word)
        for word, states in trie_walk(back, self.enter, (0.0, 0)):
            self.known[back[word]] = states[-1][1]

    def count_batch(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        if len(self.known) > KEEP:
            self.known.clear()
        rows = [self.pattern.findall(t) for t in texts]
        get = self.known.get
        found = [list(map(get, row)) for row in rows]
        fresh = [k for k, f in enumerate(found) if None in f]
        if fresh:
            new = {w for k in fresh for w, f in zip(rows[k], found[k], strict=True) if f is None}
            self.learn(new)
            for k in fresh:
                found[k] = list(map(get, rows[k]))
            for w in new:
                if len(w) > KEEP_LENGTH:
                    del self.known[w]
        return [(sum(f), len(f)) for f in found]


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_pretokens), one row for each row of ``docs``.

    ``vocabulary`` is a rank file on the driver, about 1 MB, whose contents travel with the
    task. Null and empty texts count 0; whole texts are counted. Repeated rows
    and extra columns do not matter; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        counter = UnigramCounter(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = counter.count_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["id", "n_tokens", "n_pretokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, n_pretokens long").withColumnRenamed("id", id_col)
