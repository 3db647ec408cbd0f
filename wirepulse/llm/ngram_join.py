"""Similarity join of documents on word shingles with a token-group matrix.

Documents whose shingle sets are equal are one set. Similar sets are brought into groups: the space
of shingles is cut into sections, more of them than two linked sets can differ in, so that linked
sets agree on whole sections (the pigeonhole principle), and the sets that agree on a section form a
group. The group's token union bounds the overlap of a set with every member at once, and only groups
whose bound reaches the overlap that a link needs are opened and compared member by member.

Only links that join different components matter, so the comparisons come in two rounds: each set
with the pivots of its groups, then the sets of a group that are still in other components than its
pivot with the members of the group, in blocks.

Sections that many sets agree on, because they are empty or lie inside a shared passage, say little.
There are ``1 + spare`` more sections than linked sets can differ in, so linked sets agree on more
than ``spare`` of them, and every set leaves out its largest groups up to that number, in each of its
schemes, without losing a link. Nothing is capped: the groups that stay are compared whatever their size.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepulse.llm.common import Words, blocks, in_slices, mix, shingles, stored, whole_groups
from wirepulse.operators.components import connected_components

BUCKETS = 4096
# Bytes of entries that a task groups at once.
_ENTRY_BYTES = 1 << 23
# A section with more sets in a task is hot.
HOT = 64
# Tokens of the sets of a block (8 bytes each), a small set counted as LEAST_TOKENS: at most 512 sets.
BLOCK_TOKENS, LEAST_TOKENS = 1 << 17, 1 << 8
_ENTRIES = "bucket int, low binary, high binary, docs binary, frequent binary, sig binary, doc binary"
_AGREED = "sig long, doc long, size long, n long, scheme int"
# A signature holds the class of its scheme in these 7 of its bits.
_CLASS_BIT = np.uint64(41)
_CLASS_MASK = np.uint64(127 << 41)
_LARGE = 1 << 40  # stands for the size of a large group
_CLASS_RATIO = 1.5
_SIZES = [1]
while _SIZES[-1] < 1 << 40:
    _SIZES.append(max(_SIZES[-1] + 1, int(_SIZES[-1] * _CLASS_RATIO)))


@dataclass(frozen=True)
class JoinRule:
    """Sets of ``size``-word shingles link when 100 * intersection >= ``percent`` * union."""

    size: int = 3
    percent: int = 90

    def linked(self, common, a, b):
        return 100 * common >= self.percent * (a + b - common)

    def needed(self, a, b):
        """Smallest intersection of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def may_link(self, n, least, most):
        """Whether a set of ``n`` can link with any of a size from ``least`` to ``most``: of numbers or columns."""
        return (100 * most >= self.percent * n) & (100 * n >= self.percent * least)

    def differ(self, c: int) -> int:
        """Most tokens that linked sets differ in, if the larger one is of size class ``c``."""
        return 2 * (_SIZES[c + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def spare(self, c: int) -> int:
        """Sections that a set may leave out in the scheme of a class."""
        return (self.differ(c) + 1) // 2

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, sections, spare) of the size classes of the larger set in a link of a set of
        ``n``. All sets that can link meet in the class of the larger one."""
        own = bisect_right(_SIZES, n) - 1
        most = bisect_right(_SIZES, n * 100 // self.percent) - 1
        return [(c, self.differ(c) + 1 + self.spare(c), self.spare(c)) for c in range(own, most + 1)]


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    hashes, ends = shingles(Words(data, offsets), size)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(hashes[a:b])


def _set_id(tokens: np.ndarray) -> int:
    """A 64-bit digest that names a set; equal sets have the same name."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(df: DataFrame, rule: JoinRule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, set): size and name of each document's shingle set."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, text):
            sets = list(_sets(data, offsets, rule.size))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(key).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_set_id(x) for x in sets], pa.int64()),
                ],
                ["doc", "n", "set"],
            )

    return df.select(key, text).mapInArrow(measure, "doc long, n long, set long")


def _sections(tokens: np.ndarray, rule: JoinRule) -> np.ndarray:
    """Signatures of the sections of a set in its schemes."""
    signatures = []
    mixed = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    for c, count, _ in rule.schemes(len(tokens)):
        section = ((tokens >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
        starts = np.searchsorted(section, np.arange(count + 1))  # tokens are sorted, so sections are
        name = np.uint64(c << 32) + np.arange(count, dtype=np.uint64)
        mixed_sums = mix(sums[starts[1:]] - sums[starts[:-1]] ^ mix(name + np.uint64(1)))
        signatures.append(mixed_sums & ~_CLASS_MASK | np.uint64(c) << _CLASS_BIT)
    return np.concatenate(signatures)


def _pack(signatures: np.ndarray, docs: np.ndarray, frequent: np.ndarray) -> Iterator[dict]:
    """A row for each bucket with its entries: signature bits as 4 and 2 bytes, the set, and whether
    it stands for others."""
    bucket = (signatures >> np.uint64(52)).astype(np.int64)
    order = np.lexsort((docs, bucket))
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    for b in np.flatnonzero(np.diff(ends)):
        own = order[ends[b] : ends[b + 1]]
        sig = signatures[own]
        yield {
            "bucket": int(b), "low": (sig & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            "high": (sig >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16).tobytes(),
            "docs": docs[own].tobytes(), "frequent": frequent[own].tobytes(), "sig": None, "doc": None,
        }


def _unpack(bucket: int, low: bytes, high: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    lows = np.frombuffer(low, np.uint32).astype(np.uint64)
    sig = lows | np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)
    sig |= np.uint64(bucket) << np.uint64(48)
    return sig, np.frombuffer(docs, np.int64)


def agreed_sections(df: DataFrame, rule: JoinRule, text: str = "text") -> DataFrame:
    """(sig, doc, size, n, scheme): the sets that agree with another on a section, and the number of sets
    that do. Sections of a scheme that the same few sets agree on are one group, of ``n`` sections.

    A section that more than ``HOT`` sets of one task share is summed there: its smallest set stands
    for the others in the exchange, and they go to tasks of their own.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = ("low", "high", "docs", "frequent", "sig", "doc")
        schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in binary)])
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate([x[0] for x in pending]) & np.uint64((1 << 48) - 1 | 4095 << 52)
            doc = np.concatenate([x[1] for x in pending])
            pending.clear()
            seen.clear()
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
            counts = np.diff(np.append(first, len(sig)))
            place = np.arange(len(sig)) - np.repeat(first, counts)
            away = np.repeat(counts, counts) > HOT
            here = ~away | (place == 0)
            rows = list(_pack(sig[here], doc[here], away[here]))
            narrow = (sig >> np.uint64(52)) << np.uint64(48) | sig & np.uint64((1 << 48) - 1)
            at = np.flatnonzero(away)
            for i in range(0, len(at), 4096):
                some = at[i : i + 4096]
                rows.append(
                    {
                        "bucket": BUCKETS + int(doc[some[0]] % BUCKETS),
                        "sig": narrow[some].tobytes(), "doc": doc[some].tobytes(),
                    }
                )
            return pa.RecordBatch.from_pylist(rows, schema)

        for _, data, offsets in blocks(batches, text):
            for tokens in _sets(data, offsets, rule.size):
                doc = _set_id(tokens)
                if len(tokens) and doc not in seen:
                    seen.add(doc)
                    sig = _sections(tokens, rule)
                    pending.append((sig, np.full(len(sig), doc, np.int64)))
                    held += len(sig)
            if held > 500_000:
                yield from in_slices(flush())
                held = 0
        if pending:
            yield from in_slices(flush())

    def scheme_of(sig: np.ndarray) -> np.ndarray:
        return ((sig.view(np.uint64) & _CLASS_MASK) >> _CLASS_BIT).astype(np.int32)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, "bucket", _ENTRY_BYTES):
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in part:
                for row in batch.to_pylist():
                    if row["sig"] is not None:
                        sig, doc = np.frombuffer(row["sig"], np.int64), np.frombuffer(row["doc"], np.int64)
                        sizes = np.full(len(sig), _LARGE)
                        yield pa.RecordBatch.from_pydict(
                            {"sig": sig, "doc": doc, "size": sizes, "n": np.ones_like(sig), "scheme": scheme_of(sig)}
                        )
                    else:
                        entries = _unpack(row["bucket"], row["low"], row["high"], row["docs"])
                        found.append((*entries, np.frombuffer(row["frequent"], bool)))
            if not found:
                continue
            sig, doc, frequent = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((doc, sig))
            sig, doc, frequent = sig[order], doc[order], frequent[order]
            new = np.ones(len(sig), bool)  # the same set from several tasks is one
            new[1:] = (np.diff(sig) != 0) | (np.diff(doc) != 0)
            frequent = np.maximum.reduceat(frequent, np.flatnonzero(new))
            sig, doc = sig[new], doc[new]
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
            counts = np.diff(np.append(first, len(sig)))
            large = (counts > HOT) | np.maximum.reduceat(frequent, first)
            scheme = scheme_of(sig[first])
            members = mix(np.add.reduceat(mix(doc.view(np.uint64)), first) ^ mix(scheme.astype(np.uint64) + np.uint64(1)))
            members = members >> np.uint64(2) | np.uint64(1 << 62)
            name = np.where(large, sig[first], members)
            _, once, times = np.unique(name, return_index=True, return_counts=True)
            sections = np.zeros(len(first), np.int64)
            sections[once] = times
            kept = np.repeat((sections > 0) & (large | (counts > 1)), counts)
            name, size = np.repeat(name, counts), np.repeat(np.where(large, _LARGE, counts), counts)
            agreed = pa.RecordBatch.from_pydict(
                {
                    "sig": name[kept].view(np.int64), "doc": doc[kept], "size": size[kept],
                    "n": np.repeat(sections, counts)[kept], "scheme": np.repeat(scheme, counts)[kept],
                }
            )
            yield from in_slices(agreed)

    entries = df.select(text).mapInArrow(emit, _ENTRIES)
    return (
        entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(group, _AGREED)
        # A set that several tasks met on a large section is one member of it.
        .groupBy("sig", "doc", "scheme").agg(
            F.max("size").alias("size"), F.when(F.max("size") == _LARGE, F.max("n")).otherwise(F.sum("n")).alias("n")
        )
    )


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """The places that the tokens of a set take, as words of 64: two to four places a token, 64 at least."""
    level = max(6, (2 * len(tokens) - 1).bit_length())
    places = np.zeros(1 << level, np.uint8)
    places[tokens >> np.uint64(20) & np.uint64((1 << level) - 1)] = 1
    return np.packbits(places, bitorder="little").view("<u8")


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (along the last axis) over fewer places."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _most_common(x: np.ndarray, nx, y: np.ndarray, ny):
    """An upper bound of the intersection of sets of nx and ny tokens: the places that both take, and
    the tokens that share a place with others of their set."""
    words = min(x.shape[-1], y.shape[-1])
    x, y = _fold(x, words), _fold(y, words)
    bound = _ones(x & y) + np.minimum(nx - _ones(x), ny - _ones(y))
    return np.minimum(bound, np.minimum(nx, ny))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


# Up to this many keys a list of documents is sent to every executor (some 40 bytes each).
MOST_KEYS = 1_000_000


def _tokens_of(df: DataFrame, docs: DataFrame, rule: JoinRule, key: str, text: str) -> DataFrame:
    """(doc, n, bitmap, tokens): the sets of the documents whose keys are in ``docs``."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in blocks(batches, text):
            sets = list(_sets(data, offsets, rule.size))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_bitmap(x).tobytes() for x in sets], pa.binary()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                ["doc", "n", "bitmap", "tokens"],
            )

    docs = stored(docs, "asked")
    if docs.count() <= MOST_KEYS:
        docs = F.broadcast(docs)
    named = df.select(key, text).join(docs, key, "left_semi")
    return named.mapInArrow(collect, "doc long, n long, bitmap binary, tokens binary")


def _compared(pairs: DataFrame, tokens: DataFrame, column: str, same) -> DataFrame:
    """The pairs (u, v) for which ``same`` holds of their sizes and a column of ``tokens``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("a", "an", "b", "bn"))
            good = [same(*x) for x in zip(*sides, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def side(end: str, name: str) -> DataFrame:
        own = tokens.select(F.col("doc").alias(end), F.col(column).alias(name), F.col("n").alias(f"{name}n"))
        return own.join(pairs.select(end).distinct(), end, "left_semi")

    joined = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    return joined.select("u", "v", "a", "an", "b", "bn").mapInArrow(compare, "u long, v long")


def _verified(pairs: DataFrame, tokens: DataFrame, rule: JoinRule) -> DataFrame:
    """The linked ones of the pairs (u, v). Whole sets move only for pairs whose bound, from the
    bitmaps, reaches the overlap that a link needs."""

    def may(a: bytes, an: int, b: bytes, bn: int) -> bool:
        return _most_common(np.frombuffer(a, "<u8"), an, np.frombuffer(b, "<u8"), bn) >= rule.needed(an, bn)

    def are(a: bytes, an: int, b: bytes, bn: int) -> bool:
        return rule.linked(_common(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), an, bn)

    likely = stored(_compared(pairs, tokens, "bitmap", may), "likely-pairs")
    return _compared(likely, tokens, "tokens", are)


class TokenGroups:
    """The matrix of some sets with bitmaps of one width: a row for each group, here the sets of a
    component, with the union of their tokens."""

    def __init__(self, rows: np.ndarray, comps: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        order = np.argsort(comps, kind="stable")
        self.rows, self.sizes, self.bits = rows[order], sizes[order], bits[order]
        starts = np.flatnonzero(np.diff(comps[order], prepend=~comps[order][:1]))
        self.comps, self.counts = comps[order][starts], np.diff(np.append(starts, len(rows)))
        self.smallest = np.minimum.reduceat(self.sizes, starts)
        self.least, self.most = int(sizes.min()), int(sizes.max())
        self.union = np.bitwise_or.reduceat(self.bits, starts, axis=0)
        self._folded: dict[int, TokenGroups] = {}

    @classmethod
    def of(cls, comps: np.ndarray, sizes: np.ndarray, bitmaps: list[np.ndarray]) -> list[TokenGroups]:
        """One matrix for each width."""
        widths = np.array([len(x) for x in bitmaps])
        alike = [np.flatnonzero(widths == w) for w in np.unique(widths)]
        return [cls(at, comps[at], sizes[at], np.stack([bitmaps[i] for i in at])) for at in alike]

    def folded(self, words: int) -> TokenGroups:
        if words >= self.bits.shape[1]:
            return self
        if words not in self._folded:
            comps = np.repeat(self.comps, self.counts)
            self._folded[words] = TokenGroups(self.rows, comps, self.sizes, _fold(self.bits, words))
        return self._folded[words]

    def open(self, bits: np.ndarray, n: int, comp: int, rule: JoinRule) -> np.ndarray:
        """Rows of the sets of other components that a set of ``n`` tokens may be linked with. A group is
        opened only if the overlap with its union reaches what a link with its smallest set needs."""
        bits = _fold(bits, self.bits.shape[1])
        spare = n - _ones(bits)
        reach = np.minimum(_ones(self.union & bits) + spare, n)
        opened = np.repeat((self.comps != comp) & (reach >= rule.needed(n, self.smallest)), self.counts)
        at = np.flatnonzero(opened)
        likely = _most_common(bits, n, self.bits[at], self.sizes[at]) >= rule.needed(n, self.sizes[at])
        return self.rows[at[likely]]


_COLUMNS = ["doc", "comp", "n", "tokens"]


def _candidates(sets: pd.DataFrame, rule: JoinRule, bitmap) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each query of some sets with the sets that the bounds don't rule out, as (doc, comp, n, tokens).
    The sets are rows of these and query (a set to compare with the others, or one of the others)."""
    asked = sets["query"].astype(bool)
    members = list(sets.loc[~asked, _COLUMNS].itertuples(index=False, name=None))
    if not members:
        return
    comps, sizes = (np.array([m[i] for m in members], np.int64) for i in (1, 2))
    matrices = TokenGroups.of(comps, sizes, [bitmap(m[3]) for m in members])
    for query in sets.loc[asked, _COLUMNS].itertuples(index=False, name=None):
        _, comp, n, tokens = query
        bits = bitmap(tokens)
        near = [m for m in matrices if rule.may_link(n, m.least, m.most)]
        likely = [members[i] for m in near for i in m.folded(len(bits)).open(bits, n, comp, rule)]
        if likely:
            yield query, likely


def qualifying(sets: pd.DataFrame, rule: JoinRule) -> list[tuple[int, int, bool]]:
    """(doc, comp, query): the rows of some sets, given as bitmaps, that a link may need."""
    kept = set()
    for (doc, comp, *_), likely in _candidates(sets, rule, lambda raw: np.frombuffer(raw, "<u8")):
        kept.add((doc, comp, True))
        kept.update((d, c, False) for d, c, *_ in likely)
    return sorted(kept)


def open_groups(sets: pd.DataFrame, rule: JoinRule) -> list[tuple[int, int]]:
    """Links that join the components of some sets."""
    parent = {c: c for c in sets["comp"]}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    for (d, c, n, t), likely in _candidates(sets, rule, lambda raw: _bitmap(np.frombuffer(raw, np.uint64))):
        for e, ec, m, u in likely:
            if root(ec) != root(c) and rule.linked(
                _common(np.frombuffer(t, np.uint64), np.frombuffer(u, np.uint64)), n, m
            ):
                links.append((d, e))
                parent[root(ec)] = root(c)
    return links


def _mixed_groups(agreed: DataFrame, comps: DataFrame, tokens: DataFrame, rule: JoinRule) -> DataFrame:
    """(group, doc, comp, query): the sets that are still to be compared, and with which.

    In a group of sections whose sets are in several components, those outside the component of its pivot
    are queries. The sets of all such groups of one pivot are one row each, however many sections they agree
    on, cut by hash into blocks of about ``BLOCK_TOKENS``. A query meets the blocks of its pivots that hold
    a set of another component, of a size that can link; the queries of a block are cut into parts.
    """
    rows = agreed.join(comps, "doc")
    weights = tokens.select("doc", "n", F.greatest("n", F.lit(LEAST_TOKENS)).alias("weight"))
    mixed = (
        rows.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        .filter("_lo <> _hi").select("sig")
    )
    rows = rows.join(mixed, "sig").select("pivot", "doc", "comp").distinct().join(weights, "doc")
    mains = comps.toDF("pivot", "main")
    sizes = rows.groupBy("pivot").agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).alias("blocks"))
    # Hashes of an int and of a long differ: numbers of blocks and of parts are longs on both sides.
    block = lambda number: F.xxhash64("pivot", number).alias("block")
    rows = stored(
        rows.join(sizes, "pivot").join(mains, "pivot").withColumn("block", block(F.pmod(F.xxhash64("doc"), F.col("blocks")))), "blocks"
    )
    held = rows.groupBy("block").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.min("n").alias("_least"), F.max("n").alias("_most")
    )
    queries = rows.filter("comp <> main").drop("block")
    queries = queries.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = (
        queries.select("doc", "comp", "n", "weight", block(F.col("_number"))).join(held, "block")
        .filter("_lo <> comp or _hi <> comp").filter(rule.may_link(F.col("n"), F.col("_least"), F.col("_most")))
        .select("doc", "comp", "weight", "block")
        .withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(1 << 20)))
    )
    counts = met.groupBy("block").agg(F.ceil(F.sum("weight") / (2 * BLOCK_TOKENS)).cast("int").alias("parts"))
    named = lambda part: F.xxhash64("block", part.cast("long")).alias("group")
    asked = met.join(counts, "block").select(named(F.col("part") % F.col("parts")), "doc", "comp", F.lit(True).alias("query"))
    members = rows.join(counts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return asked.unionByName(members.select(named(F.col("part")), "doc", "comp", F.lit(False).alias("query")))


def _opened(groups: DataFrame, tokens: DataFrame, rule: JoinRule) -> DataFrame:
    """Links that join components. Bitmaps move for every query and block that it meets, whole sets only
    for those rows that the bounds leave."""

    def qualify(sets: pd.DataFrame) -> pd.DataFrame:
        kept = pd.DataFrame(qualifying(sets, rule), columns=["doc", "comp", "query"])
        return kept.astype({"doc": "int64", "comp": "int64", "query": "bool"}).assign(group=np.int64(sets["group"].iloc[0]))

    def compare(sets: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(open_groups(sets, rule), columns=["u", "v"]).astype("int64")

    # Little data, much work: as many tasks as a shuffle has, whatever the size.
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def with_sets(asked: DataFrame, column: str) -> DataFrame:
        own = tokens.select("doc", "n", F.col(column).alias("tokens"))
        own = own.join(asked.select("doc").distinct(), "doc", "left_semi")
        return asked.join(own, "doc").repartition(tasks, "group")

    kept = with_sets(groups, "bitmap").groupBy("group").applyInPandas(qualify, "doc long, comp long, query boolean, group long")
    opened = stored(kept, "open-groups")
    return with_sets(opened, "tokens").groupBy("group").applyInPandas(compare, "u long, v long")


def similarity_components(
    df: DataFrame, rule: JoinRule = JoinRule(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) for each document: size of its shingle set, and the smallest
    key reachable by links, its own included.

    A-Z is lower-cased and white space parts words. A text with fewer words than a shingle has its
    whole sequence as the only one; without words it has none and links with nothing. Null texts are
    empty. Keys are whole numbers; rows with a null key keep it and have no component, rows that repeat
    a key each have the component of their own text. Sets are told apart by 64-bit digests.
    """
    sets = stored(shingle_sets(df, rule, key, text), "shingle-sets")
    named = sets.filter("n > 0 and doc is not null").groupBy("set").agg(F.min("doc").alias("rep"))
    agreed = stored(_section_groups(agreed_sections(df.filter(F.col(key).isNotNull()), rule, text), rule), "sections")
    nodes = agreed.select(F.col("doc").alias("id")).union(agreed.select("pivot")).distinct()
    asked = named.join(nodes, F.col("set") == F.col("id"), "left_semi").select(F.col("rep").alias(key))
    tokens = stored(_tokens_of(df, asked, rule, key, text), "shingle-tokens")

    stars = stored(agreed.filter("doc <> pivot").select("doc", "pivot").distinct().toDF("u", "v"), "pairs")
    edges = stored(_verified(stars, tokens, rule), "links")

    def components(found: DataFrame) -> DataFrame:
        return stored(connected_components(nodes, found.toDF("src", "dst")).toDF("doc", "comp"), "set-components")

    comps = components(edges)
    groups = stored(_mixed_groups(agreed, comps, tokens, rule), "mixed-groups")
    if not groups.isEmpty():
        comps = components(edges.union(stored(_opened(groups, tokens, rule), "more-links")))
    member = named.join(comps.toDF("set", "comp"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    smallest = member.groupBy("comp").agg(F.min("rep").alias("smallest"))
    found = sets.join(member.join(smallest, "comp").select("set", "smallest"), "set", "left")
    return found.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc").isNotNull(), F.col("smallest"))).otherwise(F.col("doc")).alias("component_id"),
    )


def _section_groups(agreed: DataFrame, rule: JoinRule) -> DataFrame:
    """(sig, doc, pivot): the groups of sets left when each set leaves out its largest groups of each scheme,
    as many sections as are spare there; the pivot is the group's smallest set.

    Sizes and names order all groups alike, so of two sets the one that leaves out more leaves out
    everything that the other does. It leaves out no more sections than are spare, and linked sets
    agree on more than that in the scheme of the larger one: one of them stays in both.
    """
    spare = F.array(*(F.lit(rule.spare(c)).cast("long") for c in range(len(_SIZES) - 1)))
    largest = Window.partitionBy("doc", "scheme").orderBy(F.desc("size"), "sig").rowsBetween(Window.unboundedPreceding, 0)
    kept = (
        agreed.withColumn("_out", F.sum("n").over(largest))
        .filter(F.col("_out") > F.get(spare, F.col("scheme"))).select("sig", "doc")
    )
    kept = stored(kept, "kept-sections")
    groups = kept.groupBy("sig").agg(F.min("doc").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    return kept.join(groups.drop("c"), "sig").select("sig", "doc", "pivot")
