"""Similarity join on word shingles by parity sketches (operator 9).

Texts are lower-cased (A-Z), cut into words and turned into the set of hashes of their shingles of five words. Two sets
of sizes a and b link when 100 * intersection >= 75 * union, which holds exactly when their symmetric difference has at
most (a + b) / 7 members, so at most a third of either set's size.

Parity sketches: a sketch XORs all members into parts (by a hash of the member) of a size band's number of parts. A
member in one set only changes one part at most, so the Hamming distance of two sketches (parts, or single bits)
never exceeds the symmetric difference. Pigeonhole: if a set fills more parts than the difference can change, a similar
set has at least one filled part equal. Of all filled parts in any fixed order, the first (size / 3 + 1) suffice: all
parts before the first shared one have been changed. The order puts parts of frequent members last, so passages that
very many texts share seldom bring texts together. A set whose members fill too few parts (a few small sets do) also
puts out each member as a key, which brings it together with other such sets. So no linked pair is missed.

Sizes: bands are [2^j, 2^(j+1)) and a set near a band's end takes part in the next band too.

Equal sets are one class from the start. Classes that share a key are checked exactly, in three rounds that together
cover every pair of classes in different components: against one pivot of each key's classes, then against three
others, then, block by block, all pairs that are still in different components and whose bit sketches lie near enough.

Defined cases: nulls, empty texts and texts without words have the empty set and link with nothing; fewer than five
words are one shingle; a row without id gets no component (null) and links nothing; rows that repeat an id are one
document, of whose texts, should their sets differ, the least stands for all, while each row counts its own shingles;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.components import connected_components
from shoebox.llm.hashing import mix64, shingle_sets
from shoebox.llm.tables import discard, materialize

#: A task names members that more than 1 in FREQUENT of its sets hold, FREQUENT_MOST at most; it only affects order.
FREQUENT, FREQUENT_MOST = 200, 5_000
#: Masks that give each round other pivots, and the classes in one block of the last round.
PIVOTS = (0, 0x5555_5555_5555_5555, 0x3333_3333_3333_3333, 0x0F0F_0F0F_0F0F_0F0F)
BLOCK = 256


def texts_of(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and UTF-8 texts (null: empty) of runs of rows with about `most` bytes, so that memory stays small."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
        group = np.cumsum(lengths) // most
        for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                at, n = int(part[0]), len(part)
                yield ids.slice(at, n), [t or b"" for t in texts.slice(at, n).to_pylist()]


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: the XOR and the sum of differently mixed members."""
    return int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0xA5A5)))), int(np.add.reduce(mix64(s + np.uint64(0x1234567)), dtype=np.uint64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (id, n, s1, s2, sketch) for each text, and rows (member, -count, ...) for a task's frequent members."""
    seen: set[tuple[int, int]] = set()
    counts: dict[int, int] = {}

    def rows(ids, n, s1, s2, sketches):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(_signed(s1)), pa.array(_signed(s2)), pa.array(sketches, pa.binary())], ["id", "n", "s1", "s2", "sketch"])

    for ids, texts in texts_of(batches):
        sets = shingle_sets(texts)
        signs = [_signature(s) for s in sets]
        fresh = [s for s, k in zip(sets, signs) if k not in seen and not seen.add(k)]
        if fresh:
            members, found = np.unique(np.concatenate(fresh), return_counts=True)
            often = found >= 2
            for m, c in zip(members[often].tolist(), found[often].tolist()):
                counts[m] = counts.get(m, 0) + c
            if len(counts) > 20 * FREQUENT_MOST:  # keep the heavier ones
                counts = dict(sorted(counts.items(), key=lambda x: -x[1])[: 5 * FREQUENT_MOST])
        yield rows(ids, [len(s) for s in sets], [k[0] for k in signs], [k[1] for k in signs], [bit_sketch(s) for s in sets])
    often = sorted(((c, m) for m, c in counts.items() if c >= 3 and c * FREQUENT >= len(seen)), reverse=True)[:FREQUENT_MOST]
    yield rows(_signed([m for _, m in often]), [-c for c, _ in often], [0] * len(often), [0] * len(often), [None] * len(often))


def part_keys(s: np.ndarray, band: int, members: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The keys that a set puts out in a band: see the module's docstring."""
    salt = np.uint64(band * 0x9E3779B97F4A7C15 % 2**64)
    mixed = mix64(s ^ salt)
    parts = mixed & np.uint64((1 << band) - 1)
    order = np.argsort(parts, kind="stable")
    parts, starts = np.unique(parts[order], return_index=True)
    keys = mix64(np.bitwise_xor.reduceat(mix64(mixed[order] + np.uint64(1)), starts) ^ mix64(parts ^ salt))
    differing = len(s) // 3
    if len(parts) <= differing:
        return np.concatenate((keys, mix64(mixed ^ np.uint64(0xFEED))))
    if len(members):
        at = np.minimum(np.searchsorted(members, s), len(members) - 1)
        heavy = np.where(members[at] == s, weights[at], 0)[order]
        return keys[np.lexsort((keys, np.minimum.reduceat(heavy, starts)))[: differing + 1]]
    return np.sort(np.partition(keys, differing)[: differing + 1]) if differing < len(keys) else keys


def bands(n: int) -> tuple[int, ...]:
    """The band of size n, and the next one if a similar set can lie there."""
    band = n.bit_length() - 1
    return (band, band + 1) if 4 * n >= 3 << (band + 1) else (band,)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity of the members at each of 2 to 4 places a member, so that differences seldom cancel."""
    n_bits = 1 << max(6, len(s).bit_length() + 1)
    bits = np.bincount((mix64(s ^ np.uint64(0xB175)) & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of `docs`; the threshold is 0.75 on shingles of five words."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = materialize(texts.mapInArrow(_describe, "id long, n long, s1 long, s2 long, sketch binary"), "shingle-sets")
    sets = rows = described.where("n >= 0")
    mark = F.struct("n", "s1", "s2")
    several = sets.where("id is not null").groupBy("id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select("id")
    several = materialize(several, "several-texts")
    if not several.isEmpty():  # of ids with several texts all but one text go
        one = texts.join(several, "id").groupBy("id").agg(F.min("text").alias("text"))
        texts = materialize(texts.join(several, "id", "left_anti").unionByName(one), "one-text")
        sets = materialize(texts.mapInArrow(_describe, "id long, n long, s1 long, s2 long, sketch binary"), "one-set").where("n >= 0")
    # at most FREQUENT_MOST members, whatever the size of the input
    often = described.where("n < 0").groupBy("id").agg(F.sum(-F.col("n")).alias("c")).orderBy(F.desc("c"), "id").limit(FREQUENT_MOST).collect()
    members = np.array([r.id for r in often], np.int64).view(np.uint64)
    by = np.argsort(members)
    sent = spark.sparkContext.broadcast((members[by], np.array([int(r.c).bit_length() for r in often], np.int64)[by] if often else np.zeros(0, np.int64)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, weights = sent.value
        seen: set[tuple[int, int]] = set()
        for ids, texts in texts_of(batches):
            out_ids, out_keys, counts = [], [np.zeros(0, np.uint64)], [0]
            for i, s in zip(ids.to_pylist(), shingle_sets(texts)):
                if i is not None and len(s) and (k := _signature(s)) not in seen:  # one of equal sets stands for a task's others
                    seen.add(k)
                    own = [part_keys(s, b, members, weights) for b in bands(len(s))]
                    out_ids.append(i)
                    out_keys += own
                    counts.append(sum(map(len, own)))
            keys = pa.ListArray.from_arrays(np.cumsum(counts).astype(np.int32), pa.array(np.concatenate(out_keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), keys], ["id", "keys"])

    keyed = materialize(texts.mapInArrow(emit, "id long, keys array<bigint>"), "shingle-keys")
    keys = keyed.select(F.explode("keys").alias("key"), "id")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    classes = materialize(sets.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")), "set-classes")
    class_of = materialize(sets.where("n > 0 and id is not null").join(classes, ["n", "s1", "s2"]).select("id", "rep").distinct(), "set-class-of")
    met = materialize(keys.join(shared, "key"), "keys-shared")
    all_held = materialize(met.join(class_of, "id").select("key", "rep").distinct(), "keys-held")
    discard(keyed, shared, met)
    masks = [F.min(F.col("rep").bitwiseXOR(F.lit(m))).alias(f"p{i}") for i, m in enumerate(PIVOTS)]
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"x{i}") for i in range(2)]
    grouped = all_held.groupBy("key").agg(F.count("*").alias("c"), *masks, *marks).where("c > 1")
    # keys with the same classes say the same: one of them is enough
    names = ["c", *(f"p{i}" for i in range(len(PIVOTS))), "x0", "x1"]
    grouped = materialize(grouped.groupBy(*names).agg(F.min("key").alias("key")), "key-groups")
    held = materialize(all_held.join(grouped.select("key"), "key"), "keys-grouped")
    discard(all_held)
    sketches = materialize(sets.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "class-sketches")
    near = F.arrow_udf(_near, "boolean")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link: those whose sketches lie near enough, by exact intersection."""
        pairs = materialize(pairs.distinct(), "pairs")
        for side in "ab":
            pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        pairs = materialize(pairs.where("4 * n_a >= 3 * n_b and 4 * n_b >= 3 * n_a").where(near("n_a", "n_b", "sketch_a", "sketch_b")).select("a", "b"), "near-pairs")
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        whole = texts.join(materialize(wanted, "near-ids"), "id").groupBy("id").agg(F.first("text").alias("text"))
        whole = materialize(whole.mapInArrow(_whole_sets, "id long, n long, members array<bigint>"), "near-sets")
        for side in "ab":
            pairs = pairs.join(whole.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("members").alias(f"members_{side}")), side)
        same = F.size(F.array_intersect("members_a", "members_b"))
        return materialize(pairs.withColumn("same", same).where("100 * same >= 75 * (n_a + n_b - same)").select("a", "b"), "links")

    def pair(x, y):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def pivot(i: int):
        return F.col(f"p{i}").bitwiseXOR(F.lit(PIVOTS[i]))

    links = linked(held.join(grouped, "key").where(F.col("rep") != pivot(0)).select(*pair(F.col("rep"), pivot(0))))
    components = connected_components(links)

    def now(ids: DataFrame, column: str, name: str) -> DataFrame:
        """`ids` with the present component of a column of classes."""
        found = components.select(F.col("node").alias(column), F.col("component").alias(name))
        return ids.join(found, column, "left").withColumn(name, F.coalesce(name, column))

    def open_groups(least: int) -> DataFrame:
        """Groups of at least so many classes that still lie in several components."""
        own = now(held.join(grouped.where(F.col("c") >= least).select("key"), "key"), "rep", "own")
        return materialize(own.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo < hi").select("key"), "open-groups")

    # two classes have met their pivot already; pairs within a component need no check
    opened = open_groups(3)
    if not opened.isEmpty():
        others = F.explode(F.array_distinct(F.array(*[pivot(i) for i in range(1, len(PIVOTS))])))
        stars = held.join(materialize(opened.join(grouped, "key"), "open-pivots"), "key").withColumn("pivot", others).where("pivot != rep")
        stars = now(now(materialize(stars.select("pivot", "rep").distinct(), "stars"), "rep", "own"), "pivot", "other").where("own != other")
        links = materialize(links.unionByName(linked(stars.select(*pair(F.col("rep"), F.col("pivot"))))), "links")
        components = connected_components(links)
        # a group of no more classes than one beyond its different pivots is done
        done = F.size(F.array_distinct(F.array(*[pivot(i) for i in range(len(PIVOTS))]))) + 1
        rest = materialize(open_groups(3).join(grouped.where(F.col("c") > done).select("key"), "key"), "open-rest")
        if not rest.isEmpty():
            last = linked(_far_pairs(now(held.join(rest, "key"), "rep", "own"), sketches))
            components = connected_components(links.unionByName(last))
    # a class's rep is its least id, so the least rep of a component is its least id
    final = now(class_of, "rep", "component_id").groupBy("id").agg(F.min("component_id").alias("component_id"))
    final = materialize(final, "jaccard-of")
    discard(classes, class_of, held, grouped, sketches, links)
    return rows.join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in texts_of(batches):
        sets = shingle_sets(texts)
        members = pa.ListArray.from_arrays(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), members], ["id", "n", "members"])


def _far_pairs(still: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs (a, b) of classes that share a key, lie in different components and pass the bit sketches' bound.

    A key's classes are dealt to blocks of about BLOCK; every two blocks of a key meet in a cell of their own.
    """
    still = materialize(still, "open-classes")
    sizes = materialize(still.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "open-sizes")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = still.join(sizes, "key").select("key", "rep", "own", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", "rep", "own", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), "block").join(sketches.withColumnRenamed("id", "rep"), "rep")
    cells = cells.select("key", "c1", "c2", "rep", "own", "n", "block", "sketch")
    return cells.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2").mapInArrow(_near_in_cells, "a long, b long")


def _fold(sketch: bytes, to: int) -> np.ndarray:
    """A sketch of `to` bytes: places are the low bits of a hash, so the halves of a longer sketch XOR together."""
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > to:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _near(n_a: pa.Array, n_b: pa.Array, sketch_a: pa.Array, sketch_b: pa.Array) -> pa.Array:
    """Whether sketches differ at no more places than linked sets of these sizes may."""
    out = []
    for size, a, b in zip(pa.compute.add(n_a, n_b).to_pylist(), sketch_a.to_pylist(), sketch_b.to_pylist()):
        width = min(len(a), len(b))
        out.append(7 * int(np.bitwise_count(_fold(a, width) ^ _fold(b, width)).sum()) <= size)
    return pa.array(out, pa.bool_())


def _near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each cell; a cell's rows follow each other, perhaps over the end of a batch."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
        starts = _cell_starts(table)
        rest = table.slice(int(starts[-1]))
        if len(starts) > 1:
            yield _near_rows(table, starts)
    if rest is not None:
        yield _near_rows(rest, np.array([0, len(rest)]))


def _cell_starts(table: pa.Table) -> np.ndarray:
    key, c1, c2 = (table.column(i).to_numpy() for i in range(3))
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]))))


def _near_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    c1, c2, rep, own, n, block = (table.column(i).to_numpy() for i in range(1, 7))
    sketch = table.column(7).to_pylist()
    left_out, right_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, end in zip(starts[:-1], starts[1:]):
        width = min(map(len, sketch[at:end]))
        bits = np.stack([_fold(s, width) for s in sketch[at:end]])
        rows = np.arange(at, end)
        left, right = rows[block[at:end] == c1[at]], rows[block[at:end] == c2[at]]
        step = max(1, 4_000_000 // max(1, len(right) * width))
        for some in (left[i : i + step] for i in range(0, len(left), step)):
            differ = np.bitwise_count(bits[some - at][:, None] ^ bits[right - at][None]).sum(2, dtype=np.int64)
            near = (7 * differ <= n[some][:, None] + n[right][None]) & (own[some][:, None] != own[right][None])
            if c1[at] == c2[at]:
                near &= rep[some][:, None] < rep[right][None]
            i, j = np.nonzero(near)
            left_out.append(rep[some[i]])
            right_out.append(rep[right[j]])
    x, y = np.concatenate(left_out), np.concatenate(right_out)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
