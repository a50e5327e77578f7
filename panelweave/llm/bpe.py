"""BPE encoding and decoding over a trie of the distinct words.

Two tokens stand next to each other in an encoding only if their strings joined
encode to just those two. So a prefix's encoding is known from its last token:
the encoding of what comes before it, then that token. Words that share a prefix
share its states; each state is the last token of the prefix's encoding and is
found once, in a depth-first walk of the trie of the words seen for the first
time. Words are lists of byte symbols of which the last carries the word end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import trie_walk

#: Encodings that a task keeps in its newer half; when that is full it becomes the older half, from which those met
#: again return, so that frequent ones stay.
KEEP = 120_000
#: The longest run that is kept, in characters, so that KEEP bounds bytes too; longer ones are encoded anew.
KEEP_LENGTH = 64
#: Texts, and characters of them, whose new words are walked together; a longer text is walked alone.
BATCH, BATCH_LENGTH = 512, 1 << 20
#: What a token without a merge is made of.
BASE = (-1, "", "")
#: A vocabulary entry not yet looked at.
UNSEEN = "?"
#: Characters that Python splits at and the vocabulary file's pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(more)
            more += 1
    return [names[b] for b in range(256)]


class WordBPE:
    """Encoder and decoder of a vocabulary file (JSON) of the kind BPE with word ends, NFC, lower case, white space dropped."""

    def __init__(self, definition: str):
        import unicodedata

        d = json.loads(definition)
        model = d["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        steps = [s["type"] for s in d["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or d["decoder"] is not None or model["unk_token"] is not None:
            raise ValueError("a vocabulary file of another kind")
        self.nfc = lambda t: t if t.isascii() else unicodedata.normalize("NFC", t)
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.added_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        if any(self.vocab.get(t, i) != i for t, i in self.added.items()):
            raise ValueError("an added token with two ids")
        self.id_text = {t: str(i) for t, i in [*self.vocab.items(), *self.added.items()]}
        self.symbol = dict(enumerate(byte_symbols()))
        self.same = {t: t for t in self.id_text}
        #: what a vocabulary entry may end with, each with the entry it is itself, or "" if none; a run that is not here ends no entry
        self.entry = {t[i:]: "" for t in self.vocab for i in range(len(t) - len(self.end) * t.endswith(self.end))}
        self.entry.update(dict.fromkeys(self.vocab, UNSEEN))
        #: how each entry is made: the rank of its merge, and its two halves
        self.made: dict[str, tuple[int, str, str]] = {}
        for pair, i in self.rank.items():
            self.made.setdefault(pair[0] + pair[1], (i, *pair))
        self.size_of = {t: len(self.split(t)) for t in self.vocab}
        self.pair_ok: dict[tuple[str, str], bool] = {}
        #: the encodings of runs and of words, a word being a run of one piece
        self.known: dict[str | tuple[str], tuple[str, ...]] = {}
        self.known_older: dict[str | tuple[str], tuple[str, ...]] = {}

    def forget(self) -> None:
        """Drops all that was kept from texts; what comes from the vocabulary stays."""
        self.pair_ok, self.known, self.known_older = {}, {}, {}

    def symbols(self, word: str) -> tuple[str, ...]:
        s = word.encode().decode("latin-1").translate(self.symbol)
        return (*s[:-1], s[-1] + self.end)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the lowest-ranked pair first, the leftmost of equals."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            pair, out, i = (parts[best[1]], parts[best[1] + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def split(self, token: str) -> list[str]:
        body, tail = (token[: -len(self.end)], self.end) if token.endswith(self.end) else (token, "")
        return [*body[:-1], body[-1] + tail]

    def looked_at(self, token: str) -> str:
        """A vocabulary entry, or "" if its own symbols do not encode to it."""
        found = self.entry[token] = self.same[token] if len(self.merged(self.split(token))) == 1 else ""
        return found

    def adjacent(self, left: str, right: str) -> bool:
        """Whether two tokens stay two when joined: undoing their merges from the last back, no merge across the seam comes earlier."""
        if len(self.pair_ok) > KEEP:
            self.pair_ok.clear()
        found = self.pair_ok[left, right] = self.seam(left, right)
        return found

    def seam(self, left: str, right: str) -> bool:
        rank, made = self.rank, self.made
        limit = len(rank) + 1
        while True:
            if rank.get((left, right), limit) < limit:
                return False
            (r, _, tail), (q, head, _) = made.get(left, BASE), made.get(right, BASE)
            if r < 0 and q < 0:
                return True
            if r > q:
                limit, left = r, tail
            else:  # of equal merges the left one comes first, so the seam wins a tie with the right side
                limit, right = q + 1, head

    def enter(self, path: list[str], states: list) -> str:
        """The last token of the path's encoding: the one that may follow the encoding of what is before it."""
        i, text = len(path) - 1, path[-1]
        entry, choices = self.entry.get, []
        while (token := entry(text)) is not None:
            if token is UNSEEN:
                token = self.looked_at(text)
            if token:
                choices.append((i, token))
            if i == 0:
                break
            i -= 1
            text = path[i] + text
        kept = self.pair_ok.get
        for i, token in reversed(choices):
            if i == 0:
                return token
            fits = kept((states[i], token))
            if fits is None:
                fits = self.adjacent(states[i], token)
            if fits:
                return token
        raise ValueError("a byte without a token")

    def learn(self, words) -> None:
        """Encodes distinct words that are not known, all in one walk."""
        back = {self.symbols(w): w for w in words}
        size_of, known = self.size_of, self.known
        for symbols, states in trie_walk(back, self.enter, None):
            tokens, i = [], len(symbols)
            while i:
                tokens.append(states[i])
                i -= size_of[states[i]]
            tokens.reverse()
            known[back[symbols]] = tuple(tokens)

    def chunks(self, text: str) -> list:
        """Runs of a text between white space, which no piece crosses, as strings; an added token as a tuple of one."""
        out, at = [], 0
        if "<|" in text:
            for m in self.added_pattern.finditer(text):
                out += [*self.runs(text[at : m.start()]), (m.group(),)]
                at = m.end()
        return out + self.runs(text[at:])

    def runs(self, text: str) -> list[str]:
        low = lowered(self.nfc(text))
        if ODD_SPACE.search(low):  # white space to Python only
            return self.pattern.findall(low)
        return low.split()

    def learn_runs(self, runs) -> list[str]:
        """Makes runs known: from the older half, as added tokens, or from their words; returns what is too long to keep."""
        known, older, pieces = self.known, self.known_older.get, {}
        for r in runs:
            found = older(r)
            if found is not None:
                known[r] = found
            elif r.__class__ is tuple:
                known[r] = r
            else:
                pieces[r] = self.pattern.findall(r)
        fresh = set(chain.from_iterable(pieces.values())) - known.keys()
        kept = {w: found for w in fresh if (found := older(w)) is not None}
        known.update(kept)
        self.learn(fresh - kept.keys())
        for r, ws in pieces.items():
            known[r] = known[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable([known[w] for w in ws]))
        return list({x for r, ws in pieces.items() if len(r) > KEEP_LENGTH for x in (r, *ws) if len(x) > KEEP_LENGTH})

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by blanks, their number, decoded text) of each text."""
        if len(self.known) > KEEP:
            self.known, self.known_older = {}, self.known
        rows = [self.chunks(t) for t in texts]
        get, id_text = self.known.get, self.id_text.__getitem__
        found = [list(map(get, row)) for row in rows]
        fresh = [k for k, f in enumerate(found) if None in f]
        if fresh:
            too_long = self.learn_runs({r for k in fresh for r, f in zip(rows[k], found[k], strict=True) if f is None})
            for k in fresh:
                found[k] = list(map(get, rows[k]))
            for r in too_long:
                del self.known[r]
        for f in found:
            tokens = list(chain.from_iterable(f))
            yield " ".join(map(id_text, tokens)), len(tokens), " ".join(tokens)


def lowered(text: str) -> str:
    """Lower case letter by letter, without the rule for a final sigma."""
    return text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)


def portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts that hold BATCH texts and BATCH_LENGTH bytes at most, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo == BATCH or held + n > BATCH_LENGTH):
            yield lo, i - lo
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes) - lo


#: Encoders of a worker, with what they took from the vocabulary only: between tasks they hold nothing of the texts.
_ENCODERS: dict[str, WordBPE] = {}


def encoder(definition: str) -> WordBPE:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordBPE(definition)
    return _ENCODERS[key]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a document: id_col, n_tokens, ids_sha256, decoded_sha256; with ``keep_text`` also ids and decoded.

    ``vocabulary`` is the path of the vocabulary file on the driver; its
    contents (about 2 MB) travel with the task. Whole texts are encoded, null as
    empty: no tokens, hashes of the empty string. Repeated rows and extra columns
    do not matter; an empty table gives an empty table. A task holds one Arrow
    batch and encodings of words met, bounded in number and length, and drops these at its end.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        coder = encoder(shared.value)
        try:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for lo, n in portions(texts):
                    rows = []
                    for joined, count, decoded in coder.encode_batch([t or "" for t in texts.slice(lo, n).to_pylist()]):
                        rows.append((count, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), joined if keep_text else None, decoded if keep_text else None))
                    cols = list(zip(*rows, strict=True))
                    out = [ids.slice(lo, n), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if keep_text:
                        out += [pa.array(cols[3]), pa.array(cols[4])]
                        names += ["ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(out, names)
        finally:
            coder.forget()
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if keep_text else "")
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
