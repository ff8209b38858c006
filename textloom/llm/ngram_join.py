"""Jaccard self-join of documents on word shingles, by prefixes of token combinations.

A document's tokens are its distinct shingles of five words, as 64-bit hashes; documents with
equal token sets are one class. Two classes of n and m tokens can only reach a similarity of 3/4
if they share 3/4 of the larger set, so every class is indexed by a prefix of its tokens under one
global order: lone tokens before rare ones before frequent ones.

* All tokens of all documents are counted. A token is frequent if more than a threshold of
  documents hold it, the least power of two from RARE on that leaves at most FREQUENT tokens. It is
  lone if at most a second threshold of documents hold it, the least power of two that leaves at
  most REPEATED others; for up to some billions of tokens this is 1. Both kinds travel as bitmaps
  of fixed size; a token that meets a bit set by another one moves to the later kind, which changes
  the order of the tokens but not the result.
* Lone tokens need no index if their threshold is 1, for nothing else holds them. Rare tokens of
  the prefix are indexed one by one. Frequent tokens are dealt into groups and a
  group is indexed by pairs: sets that share no pair share at most one token of the group, so the
  prefix is extended until every token beyond the first of each group, and every rare token, have
  made up for the dissimilarity that is allowed. The number of groups follows the size of the
  smaller set of a pair (a power of two, the "band"), so a prefix of p tokens makes of the order
  of p pairs, never p squared. Sets near the border of a band are indexed for both bands.
* Every signature that is in two classes or more is a bucket. A task links the members it sees of
  a bucket to the lead among them and passes only that one on, so a bucket that holds a third of all
  rows reaches its place as one entry for each task buffer.

Candidates are verified on whole sets. Within a bucket members are first held against its lead, the
member with the fewest lone and rare tokens (an original rather than an altered copy); connected
components of the links found are formed; then buckets whose members are already one component
need nothing more, and in all others every pair of members of different components is looked at.
Links within a component cannot change the components, so these are exact. Links are counted after
that: similar sets are in one component, so within every component all sets of sizes that allow a
link are held against each other, in blocks of bounded size. Before sets are read a
pair must pass a bound: two sets share at most the tokens that are not lone in either, less those
whose place in a small bitmap of one set is empty in that of the other.

Result: one row per input row. Null, empty and blank texts have no tokens and link with nothing;
texts with fewer than five words have their whole word sequence as one token. Rows without an id
belong to their component like others but never name it. Repeated rows are members of one class.
Very long texts are used whole. Two different sets are taken for one only if their 64-bit
fingerprints agree (2e-9 for a million classes).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import BITMAP_BITS, as_bytes, bitmap_of, in_bitmap
from textloom.llm.graph import members, star_edges
from textloom.session import stored

SHINGLE = 5
#: A token in up to so many documents is rare, whatever the size of the corpus.
RARE = 32
#: So many tokens can be frequent, and so many more than lone, at most.
FREQUENT, REPEATED = 1 << 21, 1 << 24
#: Bits of a token that are counted by.
COUNTED_BITS = 38
#: A set's small bitmap, in words of 64 bits.
SKETCH = 16
#: Tokens or signatures a task sorts at once.
BUFFER = 1 << 19
#: Tokens of a block of sets that are held against each other; a set counts as LEAST_SET at least.
JOINED, LEAST_SET = 1 << 18, 256
#: The sizes of a band differ by less than this factor, which is more than 4/3: links are within a band or between neighbours.
BAND = 1.4
#: Bytes of text whose tokens meet in one group of the counting shuffle.
SLOT_BYTES = 8 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def tokens_of(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. A-Z is lower-cased, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(words) - width + 1
    out = h[:size].copy()
    for k in range(1, width):
        out = mix(out) + h[k : k + size]
    return np.unique(mix(out))


def fingerprint(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def needed(n: int) -> int:
    """The least overlap by which a set of n tokens can have a similarity of 3/4 with any set."""
    return (3 * n + 3) // 4


# --- sorted numbers as planes of bytes, which a shuffle compresses well --------------------


def planes(numbers: np.ndarray, first: int) -> bytes:
    steps = np.diff(numbers, prepend=numbers.dtype.type(first))
    return steps.view(np.uint8).reshape(len(numbers), 8).T.tobytes()


def from_planes(data: bytes, first: int) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first)


def slots_of(numbers: np.ndarray, bits: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted numbers of so many bits: the slots that occur, and where each begins and the last ends."""
    slot = ((numbers >> np.uint64(bits - 30)) * np.uint64(slots)) >> np.uint64(30)
    edge = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    return slot[edge].astype(np.int64), np.r_[edge, len(numbers)]


def slot_start(slot: int, bits: int, slots: int) -> int:
    return -(-(slot << 30) // slots) << (bits - 30)


# --- how frequent tokens are ---------------------------------------------------------------


def token_frequencies(docs: DataFrame, slots: int) -> DataFrame:
    """(at, documents): the bitmap places of all tokens in more than one document, and in how many they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            numbers = np.sort(np.concatenate(parts))
            slot, edge = slots_of(numbers, COUNTED_BITS, slots)
            data = [planes(numbers[a:b], slot_start(int(s), COUNTED_BITS, slots)) for s, a, b in zip(slot, edge, edge[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(data, pa.binary())], names=["slot", "data"])

        held, parts = 0, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                parts.append(tokens_of(text) >> np.uint64(64 - COUNTED_BITS))
                held += len(parts[-1])
                if held >= BUFFER:
                    yield flush(parts)
                    held, parts = 0, []
        if held:
            yield flush(parts)

    def merge(group: pa.Table) -> pa.Table:
        slot = group.column("slot")[0].as_py()
        first = slot_start(slot, COUNTED_BITS, slots)
        numbers = np.sort(np.concatenate([from_planes(d, first) for d in group.column("data").to_pylist()]))
        edge = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
        found = np.diff(np.r_[edge, len(numbers)])
        many = found > 1
        at = numbers[edge[many]] >> np.uint64(COUNTED_BITS - BITMAP_BITS)
        return pa.table({"at": at.astype(np.int32), "documents": np.minimum(found[many], (1 << 31) - 1).astype(np.int32)})

    counted = docs.select(as_bytes("text").alias("text")).mapInArrow(count, "slot long, data binary")
    return counted.groupBy("slot").applyInArrow(merge, "at int, documents int")


class Kinds:
    """Which tokens are lone, rare and frequent."""

    def __init__(self, repeated: np.ndarray, frequent: np.ndarray, lone_is_single: bool):
        self.repeated, self.frequent, self.lone_is_single = repeated, frequent, lone_is_single

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = tokens >> np.uint64(64 - BITMAP_BITS)
        many, hot = in_bitmap(self.repeated, at), in_bitmap(self.frequent, at)
        return tokens[~many], tokens[many & ~hot], tokens[hot]

    def oddness(self, tokens: np.ndarray) -> int:
        """From 0, all tokens frequent, over 127, all rare, to 254, all lone."""
        lone, rare, _ = self.of(tokens)
        return 127 * (2 * len(lone) + len(rare)) // len(tokens)

    def shared(self, tokens: np.ndarray) -> tuple[int, list[int]]:
        """How many tokens other sets can hold too, and the small bitmap of these."""
        if self.lone_is_single:
            tokens = tokens[in_bitmap(self.repeated, tokens >> np.uint64(64 - BITMAP_BITS))]
        bits = np.zeros(64 * SKETCH, np.uint8)
        bits[(tokens & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = 1
        return len(tokens), np.packbits(bits).view(np.int64).tolist()


def token_kinds(docs: DataFrame, slots: int) -> Kinds:
    found = stored(token_frequencies(docs, slots))
    sizes = {r["power"]: r["n"] for r in found.groupBy(F.ceil(F.log2("documents")).alias("power")).agg(F.count("*").alias("n")).collect()}

    def threshold(least: int, most: int) -> int:
        return next(1 << p for p in range(least.bit_length() - 1, 64) if sum(n for q, n in sizes.items() if q > p) <= most)

    def above(limit: int) -> np.ndarray:
        return bitmap_of(found.filter(F.col("documents") > limit).select(F.col("at").cast("long")), "at")

    lone = threshold(1, REPEATED)
    return Kinds(above(lone), above(max(lone, threshold(RARE, FREQUENT))), lone == 1)


# --- signatures -----------------------------------------------------------------------------


def signatures(tokens: np.ndarray, kinds: Kinds) -> np.ndarray:
    """The distinct signatures of a set of sorted tokens."""
    n = len(tokens)
    if n < 2:
        return np.empty(0, np.uint64)  # a set of one token is similar to itself alone
    allowed = n - needed(n) + 1
    lone, rare, hot = kinds.of(tokens)
    lone = lone[:allowed]
    rare = rare[: allowed - len(lone)]
    single = rare if kinds.lone_is_single else np.concatenate([lone, rare])
    allowed -= len(lone) + len(rare)
    if not allowed:
        return single
    parts = [single]
    for band in range(needed(n).bit_length() - 1, n.bit_length()):
        groups = max(1, (1 << band) // 4)
        group = (mix(hot) & np.uint64(groups - 1)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        ranked = group[order]
        beyond = np.empty(len(hot), bool)  # beyond the first token of its group
        beyond[order] = np.r_[False, ranked[1:] == ranked[:-1]]
        end = np.searchsorted(np.cumsum(beyond), allowed) + 1
        order = order[order < end]
        ranked, member = group[order], hot[order]
        for step in range(1, len(member)):
            same = ranked[step:] == ranked[:-step]
            if not same.any():
                break
            a, b = member[:-step][same], member[step:][same]
            parts.append(mix(mix(a + np.uint64(band)) + b))
    return np.unique(np.concatenate(parts))


def buckets(docs: DataFrame, kinds: Kinds, slots: int) -> DataFrame:
    """(signature, member, lead): classes that share a signature, and the lead of their bucket.

    A lead is the first by oddness and then class of the members that a task, or the
    place where the tasks' leads meet, has seen of the bucket.
    """
    shared = docs.sparkSession.sparkContext.broadcast(kinds)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slot", "kind", "signature", "member", "share", "lead"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def flush(held: dict[int, tuple[int, np.ndarray]]):
            ranked = sorted((share, key) for key, (share, _) in held.items())
            keys, shares = np.array([k for _, k in ranked], np.int64), np.array([s for s, _ in ranked], np.uint8)
            found = [held[k][1] for _, k in ranked]
            signature = np.concatenate(found)
            owner = np.repeat(np.arange(len(keys)), [len(f) for f in found])
            order = np.argsort(signature, kind="stable")  # within a signature by rank
            signature, owner = signature[order], owner[order]
            first = np.r_[True, signature[1:] != signature[:-1]]
            lead = owner[first][np.cumsum(first) - 1]
            rows, led, leading = [], signature[first], owner[first]
            slot, edge = slots_of(led, 64, slots)
            for s, a, b in zip(slot.tolist(), edge, edge[1:], strict=False):
                docs, place = np.unique(leading[a:b], return_inverse=True)
                rows.append((s, 0, planes(led[a:b], slot_start(s, 64, slots)), keys[docs].tobytes(), shares[docs].tobytes(), place.astype(np.uint32).tobytes()))
            # The others are known to be in a bucket; they only pass through, in pieces dealt over all slots.
            for part in np.array_split(np.flatnonzero(~first), max(1, min(slots, int((~first).sum()) // 20_000))):
                if len(part):
                    rows.append((int(signature[part[0]] % np.uint64(slots)), 1, signature[part].tobytes(), keys[owner[part]].tobytes(), b"", keys[lead[part]].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        size, held = 0, {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = tokens_of(text)
                found = signatures(tokens, shared.value)
                if len(found):
                    held[fingerprint(tokens)] = (shared.value.oddness(tokens), found)
                    size += len(found)
                if size >= BUFFER:
                    yield flush(held)
                    size, held = 0, {}
        if held:
            yield flush(held)

    def meet(group: pa.Table) -> pa.Table:
        slot = group.column("slot")[0].as_py()
        start = slot_start(slot, 64, slots)
        signature, member, share, passed = [], [], [], [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for row in group.select(["kind", "signature", "member", "share", "lead"]).to_pylist():
            keys = np.frombuffer(row["member"], np.int64)
            if row["kind"]:
                passed.append((np.frombuffer(row["signature"], np.uint64), keys, np.frombuffer(row["lead"], np.int64)))
            else:
                place = np.frombuffer(row["lead"], np.uint32)
                signature.append(from_planes(row["signature"], start))
                member.append(keys[place])
                share.append(np.frombuffer(row["share"], np.uint8)[place])
        if signature:
            signature, member = np.concatenate(signature), np.concatenate(member)
            order = np.lexsort((member, np.concatenate(share), signature))
            signature, member = signature[order], member[order]
            head = np.r_[True, signature[1:] != signature[:-1]]
            lead = member[head][np.cumsum(head) - 1]
            new = np.r_[True, (signature[1:] != signature[:-1]) | (member[1:] != member[:-1])]
            size = np.bincount(np.cumsum(head) - 1, weights=new)[np.cumsum(head) - 1]
            keep = new & (size > 1)
            passed.append((signature[keep], member[keep], lead[keep]))
        columns = [np.concatenate(c) for c in zip(*passed, strict=True)]
        return pa.table({"signature": columns[0].view(np.int64), "member": columns[1], "lead": columns[2]})

    indexed = docs.select(as_bytes("text").alias("text")).mapInArrow(index, "slot long, kind int, signature binary, member binary, share binary, lead binary")
    return indexed.groupBy("slot").applyInArrow(meet, "signature long, member long, lead long")


# --- classes and links ------------------------------------------------------------------------


def classes_of(docs: DataFrame, kinds: Kinds, wanted: np.ndarray) -> DataFrame:
    """(doc_id, class, n_shingles, shared, sketch, tokens): every row; the last three only where the class is wanted.

    ``shared``: how many tokens are not lone; ``sketch``: their small bitmap.
    """
    known = docs.sparkSession.sparkContext.broadcast((kinds, wanted))
    source = docs.select("doc_id", as_bytes("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (kinds, bits), told = known.value, set()
        for batch in batches:
            keys, sizes, shared, sketch, sets = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = tokens_of(text)
                key = fingerprint(tokens) if len(tokens) else None
                at = np.array([(key or 0) & ((1 << BITMAP_BITS) - 1)], np.int64)
                new = key is not None and key not in told and in_bitmap(bits, at)[0]
                if new:
                    told.add(key)
                keys.append(key)
                sizes.append(len(tokens))
                many, small = kinds.shared(tokens) if new else (None, None)
                shared.append(many)
                sketch.append(small)
                sets.append(tokens.tobytes() if new else None)
            if len(told) > 100_000:
                told.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["doc_id", "class", "n_shingles", "shared", "sketch", "tokens"])

    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, class long, n_shingles long, shared long, sketch array<long>, tokens binary"
    return source.mapInArrow(run, schema)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            found.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(found, pa.bool_()))


def possible(x: str, y: str) -> str:
    """Whether sizes, shared tokens and sketches of two sets allow a similarity of 3/4.

    n + m tokens with c in common need 7 c >= 3 (n + m). A bit that only one sketch has set stands
    for a token at least that only this set holds.
    """
    missed = {(p, q): " + ".join(f"bit_count({p}.b{i} & ~{q}.b{i})" for i in range(SKETCH)) for p, q in ((x, y), (y, x))}
    common = ", ".join(f"{p}.shared - ({missed[p, q]})" for p, q in ((x, y), (y, x)))
    return f"7 * least({x}.shared, {y}.shared) >= 3 * ({x}.n + {y}.n) and 7 * least({common}) >= 3 * ({x}.n + {y}.n)"


def bounds(sets: DataFrame, key: str) -> DataFrame:
    """What ``possible`` needs of each class, its name in the column ``key``."""
    return sets.select(F.col("class").alias(key), "n", "shared", *(F.col("sketch")[i].alias(f"b{i}") for i in range(SKETCH)))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets have a similarity of 3/4 or more."""
    x, y = bounds(sets, "a").alias("x"), bounds(sets, "b").alias("y")
    left, right = (sets.select(F.col("class").alias(key), F.col("tokens").alias(f"set_{key}")) for key in "ab")
    near = pairs.join(y, "b").join(x, "a").filter(possible("x", "y")).select("a", "b")
    joined = near.join(right, "b").join(left, "a")
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a long, b long")


class Classes(NamedTuple):
    """``rows``: (doc_id, class, n_shingles, ..) of every row; ``sets``: (class, n, shared, sketch, tokens) of classes in a
    bucket; ``components``: (class, component) of linked classes; ``named``: (class, least_id, component) of all."""

    rows: DataFrame
    sets: DataFrame
    components: DataFrame
    named: DataFrame
    slots: int

    def least_ids(self) -> DataFrame:
        """(component, component_id)"""
        return self.named.groupBy("component").agg(F.min("least_id").alias("component_id"))


def linked_classes(docs: DataFrame) -> Classes:
    """The classes of ``docs`` (doc_id, text) and their components."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(64, size // SLOT_BYTES)
    kinds = token_kinds(docs, slots)
    found = stored(buckets(docs, kinds, slots))
    low = (1 << BITMAP_BITS) - 1
    wanted = found.select(F.explode(F.array("member", "lead")).alias("class")).select(F.col("class").bitwiseAND(low).alias("at"))
    classes = stored(classes_of(docs, kinds, bitmap_of(wanted, "at")))
    sets = classes.filter("tokens is not null").select("class", F.col("n_shingles").alias("n"), "shared", "sketch", "tokens")
    sets = stored(sets.dropDuplicates(["class"]))
    first = linked(found.filter("lead <> member").select(F.col("lead").alias("a"), F.col("member").alias("b")).distinct(), sets)
    stars = star_edges(first, "a", "b")
    across = _across(found, members(stars), sets)
    if across is not None:  # the stars stand for the links they were made of
        stars = star_edges(stars.select(F.col("u").alias("a"), F.col("v").alias("b")).union(across), "a", "b")
    component = members(stars).withColumnsRenamed({"node": "class"})
    by_class = classes.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"))
    named = by_class.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return Classes(classes, sets, component, named, slots)


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, class, component_id and links for every row of ``docs``.

    ``class``: equal for equal token sets, null without tokens. ``component_id``: the smallest id
    reachable by links. ``links``: how many other classes the class is similar to; left out unless
    ``counted``.
    """
    found = linked_classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    of_class = found.named.join(found.least_ids(), "component").select("class", "component_id")
    if counted:
        of_class = of_class.join(link_counts(found.components, found.sets, found.slots), "class", "left")
    by_row = found.rows.select("doc_id", "class", "n_shingles").join(of_class, "class", "left")
    name = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return by_row.select("doc_id", "n_shingles", "class", name, *([F.coalesce("links", F.lit(0)).alias("links")] if counted else []))


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``x`` shares with each of ``y``."""
    out, width = np.zeros((len(x), len(y)), np.int64), 4096
    parts = []
    for sets in (x, y):
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        parts.append((flat, owner))
    common = np.intersect1d(parts[0][0], parts[1][0])
    placed = []
    for flat, owner in parts:
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        here = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[here], kind="stable")
        placed.append((at[here][order], owner[here][order]))
    for low in range(0, len(common), width):
        matrices = []
        for (at, owner), sets in zip(placed, (x, y), strict=True):
            part = slice(*np.searchsorted(at, [low, low + width]))
            matrix = np.zeros((len(sets), min(width, len(common) - low)), np.float32)
            matrix[owner[part], at[part] - low] = 1
            matrices.append(matrix)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def link_counts(components: DataFrame, sets: DataFrame, slots: int) -> DataFrame:
    """(class, links): with how many classes each class of ``components`` has a similarity of 3/4 or more.

    A component of more than JOINED tokens is divided by bands of sizes, and bands into blocks by
    a hash. Each pair of blocks of one band or of neighbouring bands meets once, so a set travels
    once for each block it meets. Smaller components meet whole, many in one group.
    """
    weight = F.greatest("n", F.lit(LEAST_SET))
    placed = components.withColumnsRenamed({"node": "class"}).join(sets.select("class", "n"), "class")
    placed = stored(placed.withColumn("band", F.floor(F.log("n") / float(np.log(BAND))).cast("int")))
    bands = placed.groupBy("component", "band").agg(F.sum(weight).alias("tokens"))
    large = bands.groupBy("component").agg(F.sum("tokens").alias("tokens")).filter(F.col("tokens") > JOINED).select("component")
    bands = stored(bands.join(large, "component").select("component", "band", F.ceil(F.col("tokens") / JOINED).cast("int").alias("blocks")))

    def beside(step: int, name: str) -> DataFrame:
        return bands.select("component", (F.col("band") + step).alias("band"), F.col("blocks").alias(name))

    plan = bands.join(beside(-1, "above"), ["component", "band"], "left").join(beside(1, "below"), ["component", "band"], "left")
    dealt = placed.join(plan, ["component", "band"], "left").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))

    def each(count: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(0))), lambda j: F.when(j < F.col(count), make(j)))

    def met(band, apart: int, low, high, side) -> Column:
        return F.struct(F.xxhash64("component", band, F.lit(apart), low, high).alias("task"), side.cast("int").alias("side"), (F.lit(apart == 1) | (low != high)).alias("two"))

    block, band = F.col("block"), F.col("band")
    own = each("blocks", lambda j: met(band, 0, F.least(block, j), F.greatest(block, j), block > j))
    above = each("above", lambda j: met(band, 1, block, j, F.lit(0)))
    below = each("below", lambda j: met(band - 1, 1, j, block, F.lit(1)))
    alone = F.array(F.struct(F.col("component").alias("task"), F.lit(0).alias("side"), F.lit(False).alias("two")))
    meetings = F.when(F.col("blocks").isNull(), alone).otherwise(F.filter(F.concat(own, above, below), lambda m: m.isNotNull()))
    rows = dealt.select("class", F.col("blocks").isNull().alias("small"), F.explode(meetings).alias("m"))
    slot = F.when(F.col("small"), F.pmod(F.xxhash64("m.task"), F.lit(slots))).otherwise(F.col("m.task"))
    rows = rows.select("class", slot.alias("slot"), "m.task", "m.side", "m.two").join(sets.select("class", "tokens"), "class")

    def count(group: pa.Table) -> pa.Table:
        keys, task, side, two = (np.array(group.column(c).to_pylist()) for c in ("class", "task", "side", "two"))
        column = group.column("tokens").to_pylist()
        order = np.argsort(task, kind="stable")
        out = np.zeros(len(keys), np.int64)
        for part in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            x, y = (part[side[part] == 0], part[side[part] == 1]) if two[part[0]] else (part, part)
            if not len(x) or not len(y):
                continue
            a, b = ([np.frombuffer(column[i], np.uint64) for i in of.tolist()] for of in (x, y))
            both, n, m = overlaps(a, b), np.array([len(s) for s in a]), np.array([len(s) for s in b])
            near = 100 * both >= 75 * (n[:, None] + m - both)
            if two[part[0]]:
                out[y] += near.sum(axis=0)
            else:
                np.fill_diagonal(near, False)
            out[x] += near.sum(axis=1)
        return pa.table({"class": group.column("class"), "links": out})

    return rows.groupBy("slot").applyInArrow(count, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))


def _across(found: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links between members of one bucket that are in different components so far; None if there is no such bucket.

    A bucket seen by several tasks has several leads; they are members too.
    """
    members = found.select("signature", F.explode(F.array("member", "lead")).alias("member")).distinct()
    of = components.withColumnsRenamed({"node": "member"})
    placed = members.join(of, "member", "left").withColumn("component", F.coalesce("component", "member"))
    mixed = placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    rest = stored(placed.join(mixed.select("signature"), "signature", "left_semi").join(bounds(sets, "member"), "member").filter("4 * shared >= 3 * n"))
    if rest.isEmpty():
        return None
    one, two = rest.alias("x"), rest.alias("y")
    near = f"x.signature = y.signature and x.member < y.member and x.component <> y.component and {possible('x', 'y')}"
    pairs = one.join(two, F.expr(near)).select(F.col("x.member").alias("a"), F.col("y.member").alias("b")).distinct()
    return linked(pairs, sets)


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest id.

    Of repeated rows with that id one stays. Rows without an id are all kept.
    """
    found = linked_classes(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    alone = found.rows.filter("class is null").select(F.col("doc_id").alias("__kept"))
    kept = found.least_ids().select(F.col("component_id").alias("__kept")).union(alone)
    chosen = docs.join(kept, F.col(doc_id) == F.col("__kept"), "left_semi")
    # Ids are unique but for repeated rows, so a group of this window is one document.
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(*docs.columns))
    once = chosen.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")
    return once.unionByName(docs.filter(F.col(doc_id).isNull()))
