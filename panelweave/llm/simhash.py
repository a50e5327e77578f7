"""SimHash near-dedup by pigeonring filtering.

A fingerprint's first 64 bits lie on a ring of ``bits`` + 1 segments. Two
that differ in at most ``bits`` bits have a segment from which on every chain
of l consecutive segments differs in at most l * bits / (bits + 1) bits, rounded
down: 0, 1, 2 and so on. The index makes use of the first two terms: the segment is
equal, and of the next one's three parts at least two are; for very many
fingerprints of the first three: of six parts of the next two segments four are.
Fingerprints that share such a key are candidates; longer chains are checked on them, and only
then the full distance. Further words of 64 bits, where asked for, take no part
in the index and sharpen the last check: the more bits, the closer does their
distance follow the similarity of the shingles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

#: Parts into which the segments behind the equal one are cut, by their number.
PARTS = {1: 3, 2: 6}
#: Fingerprints from which on keys cover two further segments, so that a key stays rare.
MANY = 1 << 27
SEED = 42
#: Shingles whose bits are counted at a time, so that a very long text takes bounded memory.
CHUNK = 1 << 16
#: Candidates compared at a time, as rows by columns.
CELLS = 1 << 21
#: Odd constants that turn a shingle's hash into those of further words (the 64-bit finaliser of a public mixer).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Scheme:
    """What links: shingles of ``shingle`` words, each once if ``distinct``; at most ``bits`` of the first 64 bits and ``total`` of all ``words`` * 64 differ."""

    shingle: int = 4
    bits: int = 4
    words: int = 1
    total: int | None = None
    distinct: bool = False
    ahead: int = 1

    @staticmethod
    def similar(at_least: float, shingle: int = 5, bits: int = 10, words: int = 4) -> Scheme:
        """For a Jaccard similarity of the shingles: sets of equal size have the cosine 2j / (1 + j), and a bit differs with the share of its angle in pi."""
        share = math.acos(2 * at_least / (1 + at_least)) / math.pi
        return Scheme(shingle, bits, words, round(64 * words * share), True)

    @cached_property
    def masks(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """(bits that the key covers, [(bits, most differing)] of the chains from one segment on up to the whole ring) of each kind of key."""
        n = self.bits + 1
        edges = [64 * i // n for i in range(n + 1)]
        span = lambda lo, hi: (1 << hi) - (1 << lo)
        out = []
        for i in range(n):
            chains, ring = [], 0
            for length in range(n):
                at = (i + length) % n
                ring |= span(edges[at], edges[at + 1])
                chains.append((ring, (length + 1) * self.bits // n))
            behind = [b for k in range(self.ahead) for b in range(edges[(i + 1 + k) % n], edges[(i + 1 + k) % n + 1])]
            parts = PARTS[self.ahead]
            cuts = [len(behind) * j // parts for j in range(parts + 1)]
            for kept in combinations(range(parts), parts - self.ahead):
                out.append((span(edges[i], edges[i + 1]) | sum(1 << b for j in kept for b in behind[cuts[j] : cuts[j + 1]]), chains))
        return out

    @property
    def keys(self) -> int:
        """The most keys that there can be."""
        return sum(1 << mask.bit_count() for mask, _ in self.masks)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes of shingles for a further word of the fingerprint."""
    x = hashes + np.uint64(word * GOLDEN % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: str | None, scheme: Scheme) -> list[int]:
    """The fingerprint in words of 64 bits: a bit is 1 if it is set in more than half of the shingles' hashes; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return [0] * scheme.words
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(scheme.shingle, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    all_hashes = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), CHUNK):
        all_hashes[lo : lo + CHUNK] = [digest(joined[a:b], SEED) for a, b in zip(first[lo : lo + CHUNK].tolist(), last[lo : lo + CHUNK].tolist(), strict=True)]
    if scheme.distinct:
        all_hashes = np.unique(all_hashes)
    ones = np.zeros((scheme.words, 64), np.int64)
    for lo in range(0, len(all_hashes), CHUNK):
        hashes = all_hashes[lo : lo + CHUNK]
        for w in range(scheme.words):
            bits = np.unpackbits((_mixed(hashes, w) if w else hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[w] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(all_hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """A fingerprint of 64 bits over all shingles, repeats included."""
    return fingerprint_words(text, Scheme(shingle))[0]


def _names(scheme: Scheme) -> list[str]:
    return [f"f{w}" for w in range(scheme.words)]


def fingerprints(docs: DataFrame, scheme: Scheme, key: list, text_col: str = "text") -> DataFrame:
    """The columns of ``key`` and the fingerprint's words f0, f1 ... as signed longs; null texts count as empty."""
    names = _names(scheme)
    rows = docs.select(*key, F.col(text_col).alias("text"))
    given = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint_words(t.as_py(), scheme) for t in batch.column(len(given))], np.uint64).reshape(-1, scheme.words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[:, w]) for w in range(scheme.words)]], [*given, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, kinds + "".join(f", {n} long" for n in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(left: np.ndarray, right: np.ndarray | None, kind: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join whatever the pigeonring chains and the full distance join: a forest, not all pairs.

    Within ``left``, or between ``left`` and ``right``; both have a row of words a fingerprint.
    """
    both = left if right is None else np.concatenate([left, right])
    chains = [(np.uint64(bits), most) for bits, most in scheme.masks[kind][1]]
    middle = chains[len(chains) // 2]
    label = np.arange(len(both))
    heads, tails = [], []
    strip = max(1, CELLS // len(both))
    for lo in range(0, len(left), strip):
        base = lo if right is None else len(left)
        near = np.bitwise_count((left[lo : lo + strip, 0][:, None] ^ both[base:, 0][None, :]) & middle[0]) <= middle[1]
        a, b = np.nonzero(near)
        a, b = a + lo, b + base
        if right is None:
            a, b = a[b > a], b[b > a]
        diff = both[a, 0] ^ both[b, 0]
        for bits, most in chains[1:]:
            keep = np.bitwise_count(diff & bits) <= most
            a, b, diff = a[keep], b[keep], diff[keep]
        if scheme.words > 1 and len(a):
            keep = np.bitwise_count(both[a] ^ both[b]).sum(axis=1, dtype=np.int64) <= scheme.total
            a, b = a[keep], b[keep]
        for at, end in _runs(a):
            own, met = label[a[at]], b[at:end]
            others, first = np.unique(label[met], return_index=True)
            new = others != own
            if new.any():
                heads.append(np.full(int(new.sum()), a[at]))
                tails.append(met[first[new]])
                label[np.isin(label, others[new])] = own
    if not heads:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(heads), np.concatenate(tails)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(keys):
        return []
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:], strict=False))


#: The most keys whose counts are broadcast, about 24 bytes each.
BROADCAST_KEYS = 1 << 19


def near_links(fps: DataFrame, scheme: Scheme, node: str, block: int = 8192) -> DataFrame:
    """(a, b): links between the nodes of distinct fingerprints (node, f0, ...) with the same components as all linking pairs.

    A key with more than ``block`` fingerprints is dealt into blocks by hash, and
    each pair of blocks is a task's share of its own, so no task holds a key whole.
    """
    names = _names(scheme)
    own = list(dict.fromkeys([node, *names]))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("f0").bitwiseAND(F.lit(_signed(m[0]))).alias("key")) for k, m in enumerate(scheme.masks)])
    keyed = fps.select(*own, F.explode(kinds).alias("k")).select("k.kind", "k.key", *own)
    shared = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(F.broadcast(shared) if scheme.keys <= BROADCAST_KEYS else shared, ["kind", "key"])
    parts = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64(node), parts).cast("int")
    rows = rows.select("kind", "key", *own, mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("kind", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).alias("high"), *own)
    dealt = rows.repartition("kind", "key", "lo", "hi").sortWithinPartitions("kind", "key", "lo", "hi")

    def run(batches):
        carried = None
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
                carried = cols if carried is None else [np.concatenate(x) for x in zip(carried, cols, strict=True)]
            if carried is None:
                return
            kind, key, lo, hi = carried[:4]
            new = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cut = len(kind) if batch is None else int(new[-1]) if len(new) else 0
            if not cut:
                continue
            bounds = [0, *new[new < cut].tolist(), cut]
            high, nodes = carried[4].astype(bool), carried[5]
            fp = np.stack([carried[5 + own.index(n)] for n in names], axis=1).astype(np.int64).view(np.uint64)
            ha, hb = [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                if lo[s] == hi[s]:
                    a, b = spanning_links(fp[s:e], None, int(kind[s]), scheme)
                    pool = nodes[s:e]
                else:
                    up = high[s:e]
                    pool = np.concatenate([nodes[s:e][~up], nodes[s:e][up]])
                    a, b = spanning_links(fp[s:e][~up], fp[s:e][up], int(kind[s]), scheme)
                if len(a):
                    ha.append(pool[a])
                    hb.append(pool[b])
            carried = [x[cut:] for x in carried]
            if ha:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ha).astype(np.int64)), pa.array(np.concatenate(hb).astype(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _groups(prints: DataFrame, scheme: Scheme, scratch: Scratch, least) -> DataFrame:
    """(f0, ..., root, least): each distinct fingerprint with its group and the least ``least`` of the group."""
    names = _names(scheme)
    classes = prints.groupBy(*names).agg(F.min(least).alias("own"))
    classes = scratch.save(classes if scheme.words == 1 else classes.withColumn("node", F.monotonically_increasing_id()))
    node = "f0" if scheme.words == 1 else "node"
    if scheme.bits > 1 and classes.count() > MANY:
        scheme = replace(scheme, ahead=2)
    linked = connected_components(near_links(classes, scheme, node), scratch)
    member = classes.join(linked.withColumnRenamed("node", node), node, "left").select(*names, "own", F.coalesce("component", node).alias("root"))
    out = scratch.save(member.join(member.groupBy("root").agg(F.min("own").alias("least")), "root").select(*names, "root", "least"))
    scratch.drop(classes, linked)
    return out


def _with_end(batches):
    yield from batches
    yield None


def simhash_dedup(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id
    reachable over links of at most ``bits`` differing bits, its own included. Null,
    empty and wordless texts have fingerprint zero and link like any other.
    Documents of one fingerprint are one node, so copies give no pairs. A null
    id is reachable but is no component id, unless its fingerprint holds no other
    and links to none: then it is null. Repeated rows each keep their row; an
    empty table gives an empty table; extra columns do not matter.
    """
    scratch, scheme = Scratch(docs.sparkSession, "simhash"), Scheme(shingle, bits)
    prints = scratch.save(fingerprints(docs, scheme, [F.col(id_col).alias("id")], text_col))
    groups = _groups(prints, scheme, scratch, F.col("id"))
    return prints.join(groups, "f0").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_representatives(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bits: int = 10, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, one of each near-duplicate group: that of the least id.

    Two texts link where the fingerprints of their distinct shingles, ``words``
    times 64 bits, differ by no more than the share of bits that stands for a Jaccard
    similarity of ``similarity``, and by ``bits`` at most in the first word, which
    the index needs. Null, empty and wordless texts are one group. Of rows with
    one id the text decides by hash, a null id comes last, and of rows equal in id and text one stays.
    An empty table gives an empty table; any further columns stay as they are.
    """
    scratch, scheme = Scratch(docs.sparkSession, "simhash"), Scheme.similar(similarity, shingle, bits, words)
    of_text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    prints = scratch.save(fingerprints(docs, scheme, [F.col(id_col).alias("id"), of_text.alias("h")], text_col))
    groups = _groups(prints, scheme, scratch, F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    keep = scratch.save(groups.select("least.id", "least.h").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), of_text.alias("h"))
    kept = rows.alias("r").join(keep.alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.h") == F.col("k.h")), "left_semi")
    if not prints.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "h"])
    return kept.select("doc.*")
