"""Language identification by words first, then ever shorter character n-grams.

A word seen in training scores by its log frequency in each language. A word
never seen is covered from its start by the longest known n-gram at each place,
from ``longest`` letters down to one; a letter never seen adds nothing. A text's
score for a language is the sum over its words, weighted by how often they occur.

A letter is what Unicode puts in the categories L; words are runs of letters. A
run of over ``WORD`` letters, as scripts without blanks have them, is no word
but teaches and scores by its n-grams, all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: The most letters of a run that counts as a word.
WORD = 40
SPLIT = r"[^\p{L}]+"
#: Runs of letters, and of the numerals other than decimal digits, which Python counts among them.
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(False))


def runs_of(text: str) -> Counter:
    """The runs of letters of a text in lower case, with their numbers."""
    found = Counter(LETTERS.findall(text.lower()))
    for mixed in [w for w in found if not w.isalpha()]:  # with numerals, such as the sign of a half
        n = found.pop(mixed)
        for w in "".join(c if c.isalpha() else " " for c in mixed).split():
            found[w] += n
    return found


def _gram_counts(runs: DataFrame, longest: int) -> DataFrame:
    """(g, lang, n) of all n-grams of up to ``longest`` letters of (lang, w, n): prefixes of the windows that begin at each letter."""
    windows = F.regexp_extract_all("w", F.lit(rf"(?=(\p{{L}}{{1,{longest}}}))\p{{L}}"), F.lit(1))
    windows = runs.select("lang", "n", F.explode(windows).alias("window")).groupBy("lang", "window").agg(F.sum("n").alias("n"))
    prefixes = F.array_distinct(F.array(*[F.substring("window", 1, k) for k in range(1, longest + 1)]))
    return windows.select("lang", "n", F.explode(prefixes).alias("g")).groupBy("g", "lang").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, docs_per_lang: int = 3000, least_seen: int = 2, longest: int = 4, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> dict:
    """A model from the labelled rows of ``docs``; without languages if there is none.

    About ``docs_per_lang`` documents of a language are learned from (by a hash
    of id and text; all where there are fewer), which bounds the model
    whatever the input. A word is known if it is seen ``least_seen`` times in
    these documents; n-grams are taken from all runs of letters. The model is made of flat arrays.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "longest": longest}
    ring = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(ring * min(1.0, docs_per_lang / n)))])
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    some = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(ring)) < F.element_at(share, F.col("lang"))).select(F.element_at(place, F.col("lang")).alias("lang"), "text")
    runs = some.select("lang", F.explode(F.split(F.lower("text"), SPLIT)).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        words = _entries(runs.where(F.length("w") <= WORD).withColumnRenamed("w", "entry"), least_seen)
        grams = _entries(_gram_counts(runs, longest).withColumnRenamed("g", "entry"), 1)
    finally:
        runs.unpersist()
    base, parts = [], {"sizes": [], "lang": [], "gain": []}
    for table in (words, grams):
        lang, n = (table.column(c).combine_chunks() for c in ("lang", "n"))
        place_of, counts = lang.flatten().to_numpy(), n.flatten().to_numpy()
        total = np.bincount(place_of, weights=counts, minlength=len(langs)) + 0.5 * table.num_rows + 0.5
        base.append(np.log(0.5 / total))  # the log frequency of an entry that a language never has; others are kept by what they have above it
        parts["sizes"].append(np.diff(lang.offsets.to_numpy()))
        parts["lang"].append(place_of.astype(np.int64))
        parts["gain"].append(np.log((counts + 0.5) / 0.5))
    joined = {k: np.concatenate(v) for k, v in parts.items()}
    starts = np.concatenate([[0], np.cumsum(joined["sizes"])]).astype(np.int64)
    return {"langs": langs, "longest": longest, "words": words.column("entry").combine_chunks(), "grams": grams.column("entry").combine_chunks(), "starts": starts, "lang": joined["lang"], "gain": joined["gain"], "base": np.array(base)}


def _entries(counts: DataFrame, least: int) -> pa.Table:
    """(entry, lang list, n list) of (entry, lang, n), of the entries seen ``least`` times."""
    rows = counts.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("of"), F.sum("n").alias("seen")).where(F.col("seen") >= least)
    return rows.select("entry", "of.lang", "of.n").toArrow()


class Scorer:
    """Scores texts by a model; keeps what covers ``keep`` unseen words at most, none of over WORD letters."""

    def __init__(self, model: dict, keep: int = 60_000):
        self.langs, self.longest, self.keep = model["langs"], model["longest"], keep
        if self.langs:
            n = len(model["words"])
            self.words = dict(zip(model["words"].to_pylist(), range(n), strict=True))
            self.grams = dict(zip(model["grams"].to_pylist(), range(n, n + len(model["grams"])), strict=True))
            self.starts, self.lang, self.gain, self.base = model["starts"], model["lang"], model["gain"], model["base"]
        self.unseen: dict[str, tuple[int, ...]] = {}

    def backed_off(self, word: str) -> tuple[int, ...]:
        """The n-grams that cover a word."""
        out, i, n, get = [], 0, len(word), self.grams.get
        while i < n:
            for k in range(min(self.longest, n - i), 0, -1):
                got = get(word[i : i + k])
                if got is not None:
                    out.append(got)
                    i += k
                    break
            else:
                i += 1
        return tuple(out)

    def sums(self, text: str) -> np.ndarray | None:
        """One sum for each language, None if the text has no letter."""
        found = runs_of(text)
        if not found:
            return None
        words, unseen = self.words.get, self.unseen
        known = list(map(words, found))
        entries = [e for e in known if e is not None]
        times = [n for e, n in zip(known, found.values(), strict=True) if e is not None]
        n_words = sum(times)
        if len(entries) < len(found):
            for word, e in zip(found, known, strict=True):
                if e is None:
                    got = unseen.get(word)
                    if got is None:
                        got = self.backed_off(word)
                        if len(word) <= WORD:
                            if len(unseen) >= self.keep:
                                unseen.clear()
                            unseen[word] = got
                    entries += got
                    times += [found[word]] * len(got)
        ids, n = np.array(entries, np.int64), np.array(times, np.float64)
        first = self.starts[ids]
        sizes = self.starts[ids + 1] - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)
        seen = np.bincount(self.lang[at], weights=self.gain[at] * np.repeat(n, sizes), minlength=len(self.langs))
        return seen + n_words * self.base[0] + (n.sum() - n_words) * self.base[1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share of the posterior); undetermined with 0 for null or no letter. Ties go to the first by name."""
        sums = self.sums(text) if text and self.langs else None
        if sums is None:
            return UNDETERMINED, 0.0
        top = int(sums.argmax())
        return self.langs[top], float(1.0 / np.exp(np.maximum(sums - sums[top], -700.0)).sum())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score), one row for each row of ``docs``.

    ``und`` with score 0 where the text is null, has no letter, or there was
    nothing to learn from. A null id is never held out. Whole texts are read, and
    nothing but the text decides. Repeated rows each keep their row; extra
    columns do not matter. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train()'s parameters

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that are not held out, and predicts all."""
    return identify(docs, train(docs.where(~held_out(F.col("doc_id")))))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is told with a score of ``min_score`` at least, and is one of ``languages`` if given.

    Learns from the labelled documents that are not held out. Null texts and
    those without a letter go, as do texts between languages. Where no document
    is labelled there is nothing to tell languages by: those with a letter stay.
    Repeated rows stay or go together; an empty table gives an empty table. Only
    the text goes to Python.
    """
    model = train(docs.where(~held_out(F.col(id_col))))
    if not model["langs"]:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            found = [scorer.predict(t.as_py()) for t in texts]
            yield pa.array([score >= min_score and (languages is None or lang in languages) for lang, score in found], pa.bool_())

    return docs.where(kept(F.col(text_col)))
