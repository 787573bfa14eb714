"""Phrase collocation mining by stripes (operator 12).

Texts are lower-cased (A-Z) and cut at BREAKS into pieces and those at spaces and tabs into words; a word of a language
is a 64-bit number. A stripe is a prefix of one to three words with an associative counter of the words that follow it;
what isn't counted word by word (the end of a piece, and followers that can't be frequent) is one more entry, so a
stripe's sum is its prefix's frequency. Each task counts its own stripes, a shuffle by prefix brings the stripes of a
prefix together, and they are merged elementwise. From the merged stripes come the extensions of a prefix with their
counts, the prefix totals, and the largest count that continues a phrase to the right (a stripe's maximum) or to the
left (over the stripes that hold its suffix).

Four passes read the texts: words, and stripes of one, two and three words. Between them goes a filter of 2**FILTER_BITS
bits, whatever the corpus: the places of the frequent words, pairs and triples that the pass before found. A prefix that
is not in it has no frequent extension, and a follower that makes no phrase of it isn't counted apart; a wrong hit costs
work only. A word that makes more than one in HEAVY_PART of all words has its stripes dealt to slices by the following
word, as many as it has such parts, so no task holds the stripe of a very common word. Stripes travel in bundles, dealt
by prefix and slice, which hold BUNDLE words' worth of stripes over all tasks.

Defined cases: a null text has no words; a null language is `und`; repeated rows and ids count each; ties go by the
phrase's bytes; arithmetic is in decimals; an empty table gives an empty result; columns other than the text and the
language are not read. Two words with one number (odds of n**2 / 2**65 for n distinct words) would be taken for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoebox.llm.hashing import PIECE, mix64, span_hashes
from shoebox.llm.tables import discard, materialize

BREAKS, LONGEST = b".,;:!?\n\v\f\r", 4
LEAST, PER_LANGUAGE, SUBSUMED = 30, 2_000, 80
FILTER_BITS, HEAVY_PART, HELD, BUNDLE, BUNDLES_MOST = 26, 4_096, 1_000_000, 1 << 16, 1 << 22

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP[[9, 32, *BREAKS]] = True


def _segments(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, ends, own) of a text's words, PIECE bytes or so at a time; where `own` is false a word only stands
    behind the words that the segment counts, as those of the next segment do."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        end = upto = _word_end(data, min(at + PIECE, len(data)))
        for _ in range(LONGEST - 1):
            while upto < len(data) and _GAP[data[upto]]:
                upto += 1
            upto = _word_end(data, upto)
        part = data[at:upto]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _GAP[part], [True])).view(np.int8)))
        yield part, edge[::2], edge[1::2], edge[::2] < end - at
        at = end


def _word_end(data: np.ndarray, at: int) -> int:
    """The first place from `at` on where no word goes on."""
    while at < len(data):
        gap = np.flatnonzero(_GAP[data[at : at + 4096]])
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return min(at, len(data))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, data, starts, ends, own, piece numbers, word numbers) of many short texts, or a part of a long one."""
    for batch in batches:
        languages = np.asarray(batch.column("lang").to_pylist(), object)
        texts = batch.column("text")
        for lang in dict.fromkeys(languages):
            seed = np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest()))
            joined: list[bytes] = []
            size = 0
            picked = np.flatnonzero(languages == lang)
            for k, i in enumerate(picked):
                text = (texts[int(i)].as_py() or "").encode()
                joined.append(text)
                size += len(text)
                if size >= PIECE or k == len(picked) - 1:
                    for data, starts, ends, own in _segments(b"\n".join(joined)):
                        if len(starts):
                            piece = np.cumsum(_BREAK[data])[starts]
                            number = mix64(span_hashes(data, starts, ends) ^ seed).view(np.int64)
                            number[number == 0] = 1  # 0 stands for what isn't counted word by word
                            yield lang, data, starts, ends, own, piece, number
                    joined, size = [], 0


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Equal keys as one, in order, with their sums and a place where each stood."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, n, order
    starts = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
    return [k[starts] for k in keys], np.add.reduceat(n[order], starts), order[starts]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, lang, word, n): the entries of the empty prefix's stripe, of which each task gives a word once or a few times."""
    held: dict[int, list] = {}
    for lang, data, starts, ends, own, _, number in _words(batches):
        (ids,), n, first = _summed([number[own]], np.ones(np.count_nonzero(own), np.int64))
        for i, c, at in zip(ids.tolist(), n.tolist(), first.tolist()):
            if i in held:
                held[i][2] += c
            else:
                held[i] = [lang, data[starts[at] : ends[at]].tobytes(), c]
        if len(held) >= HELD // 4:  # strings and lists, about 300 bytes each
            yield _word_batch(held)
            held = {}
    yield _word_batch(held)


def _word_batch(held: dict[int, list]) -> pa.RecordBatch:
    words = [w.translate(_LOWER).decode("utf-8", "replace") for _, w, _ in held.values()]
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([x[0] for x in held.values()], pa.string()), pa.array(words, pa.string()), pa.array([x[2] for x in held.values()], pa.int64())], ["id", "lang", "word", "n"])


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _place(*words: np.ndarray) -> np.ndarray:
    """The filter's bit of a word, a pair or a triple, counted from 1."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w.view(np.uint64))
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64) + 1


def _filter(frequent: DataFrame, *columns: str) -> Broadcast:
    """The places of frequent words or phrases as one string of bits, of the same size for any corpus."""
    place = F.arrow_udf(lambda *words: pa.array(_place(*[np.asarray(w.to_numpy(), np.int64) for w in words])), "long")(*columns)
    bits = frequent.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(2**FILTER_BITS // 8, np.uint8)
    for r in bits.toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(out)


def _has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[(place - 1) >> 3] >> ((place - 1) & 7).astype(np.uint8) & 1).astype(bool)


BUNDLES = "bundle int, p1 array<bigint>, p2 array<bigint>, p3 array<bigint>, size array<int>, next array<bigint>, n array<int>"


def _stripes(m: int, bits: Broadcast, heavy: Broadcast, bundles: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's stripes of prefixes of `m` words that are in the filter, in bundles. A follower is counted apart if the `m` words
    that end with it are in the filter too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for _, _, _, _, own, piece, number in _words(batches):
            total = len(number)
            words = [np.concatenate((number[k:], np.zeros(min(k, total), np.int64)))[:total] for k in range(m + 1)]
            goes_on = [np.concatenate((piece[k:] == piece[: max(total - k, 0)], np.zeros(min(k, total), bool)))[:total] for k in (m - 1, m)]
            frequent = goes_on[0] & _has(bits.value, _place(*words[:m]))
            at = np.flatnonzero(own & frequent)
            extends = goes_on[1] & np.concatenate((frequent[1:], [False]))
            held.append([*(w[at] for w in words[:m]), np.where(extends[at], words[m][at], 0), np.ones(len(at), np.int64)])
            size += len(at)
            if size >= 2 * HELD:
                rows = _compact(held)
                held, size = [rows], len(rows[0])
                if size >= HELD:
                    yield _batch(rows, heavy.value, bundles)
                    held, size = [], 0
        if held:
            yield _batch(_compact(held), heavy.value, bundles)

    return count


def _compact(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*held)]
    keys, n, _ = _summed(columns[:-1], columns[-1])
    return [*keys, n]


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where rows begin whose keys are not those of the row before."""
    return np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))) if len(keys[0]) else np.zeros(0, np.int64)


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate((starts, [len(values)])), pa.int32()), pa.array(values, kind))


def _batch(rows: list[np.ndarray], heavy: tuple[np.ndarray, np.ndarray], bundles: int) -> pa.RecordBatch:
    """Rows (words of a prefix, next, n) as stripes, those of heavy words in slices, in bundles."""
    *prefix, following, n = rows
    ids, slices = heavy
    deal = np.zeros(len(n), np.uint64)
    if len(ids):
        place = np.minimum(np.searchsorted(ids, prefix[0]), len(ids) - 1)
        deal = (mix64(following.view(np.uint64)) >> np.uint64(8)) % np.where(ids[place] == prefix[0], slices[place], 1).astype(np.uint64)
    for p in prefix:
        deal = mix64(deal * np.uint64(0x9E3779B97F4A7C15) + p.view(np.uint64))
    bundle = ((deal >> np.uint64(16)) % np.uint64(bundles)).astype(np.int64)
    order = np.lexsort((following, *prefix[::-1], bundle))
    bundle, following, n, *prefix = (c[order] for c in (bundle, following, n, *prefix))
    stripe = _starts([bundle, *prefix])
    first = _starts([bundle[stripe]])  # the first stripe of each bundle
    none = np.zeros(len(stripe), np.int64)
    sizes = np.diff(np.concatenate((stripe, [len(n)])))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bundle[stripe][first], pa.int32()), *[_lists(first, p[stripe], pa.int64()) for p in prefix], *[_lists(first, none, pa.int64())] * (LONGEST - 1 - len(prefix)),
            _lists(first, sizes, pa.int32()), _lists(stripe[first], following, pa.int64()), _lists(stripe[first], n, pa.int32()),
        ],
        ["bundle", "p1", "p2", "p3", "size", "next", "n"],
    )


def _merge(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bundles in order as one stripe (or a few, for slices) for each prefix: its total, and the entries of `least` or more.

    Only the last bundle of a batch is held over to the next, already merged.
    """

    def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy().astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            size = flat(batch, "size")
            bundle = np.repeat(batch.column("bundle").to_numpy().astype(np.int64), batch.column("size").value_lengths().to_numpy())
            columns = [np.repeat(c, size) for c in (bundle, flat(batch, "p1"), flat(batch, "p2"), flat(batch, "p3"))]
            *keys, n = [np.concatenate((r, c)) for r, c in zip(rest, [*columns, flat(batch, "next"), flat(batch, "n")])]
            run = np.cumsum(np.concatenate(([False], keys[0][1:] != keys[0][:-1]))) if len(n) else np.zeros(0, np.int64)
            (run, *others), n, first = _summed([run, *keys[1:]], n)
            merged = [keys[0][first], *others, n]
            last = int(np.searchsorted(run, run[-1])) if len(run) else 0
            yield _merged([c[:last] for c in merged[1:]], least)
            rest = [c[last:] for c in merged]
        yield _merged(rest[1:], least)

    return merge


MERGED = "p1 long, p2 long, p3 long, total long, next array<bigint>, n array<bigint>"


def _merged(rows: list[np.ndarray], least: int) -> pa.RecordBatch:
    *prefix, following, n = rows
    stripe = _starts(prefix)
    kept = (n >= least) & (following != 0)
    before = np.concatenate(([0], np.cumsum(kept)))[stripe]
    return pa.RecordBatch.from_arrays(
        [*[pa.array(p[stripe]) for p in prefix], pa.array(np.add.reduceat(n, stripe) if len(n) else n), _lists(before, following[kept], pa.int64()), _lists(before, n[kept], pa.int64())],
        ["p1", "p2", "p3", "total", "next", "n"],
    )


def collocations(docs: DataFrame, least: int = LEAST, per_language: int = PER_LANGUAGE, subsumed: int = SUBSUMED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two to four words that occur `least` times or more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = materialize(texts.mapInArrow(_count_words, "id long, lang string, word string, n long").groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "phrase-words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    everything = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where(F.col("n") >= least)
    # fewer than HEAVY_PART words can be as common as that
    common = sorted((r.id, r.n * HEAVY_PART // everything + 1) for r in frequent.where(F.col("n") * HEAVY_PART > everything).select("id", "n").collect())
    sent = spark.sparkContext.broadcast((np.array([i for i, _ in common], np.int64), np.array([k for _, k in common], np.int64)))

    bundles = int(min(everything // BUNDLE + 1, BUNDLES_MOST))

    def merged(m: int, bits: Broadcast) -> DataFrame:
        counted = texts.mapInArrow(_stripes(m, bits, sent, bundles), BUNDLES)
        return materialize(counted.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(_merge(least), MERGED), "phrase-stripes")

    one = merged(1, _filter(frequent, "id"))
    two = merged(2, _filter(one.select("p1", F.explode("next").alias("p2")), "p1", "p2"))
    three = merged(3, _filter(two.select("p1", "p2", F.explode("next").alias("p3")), "p1", "p2", "p3"))

    stripes = one.unionByName(two).unionByName(three).withColumn("prefix", F.filter(F.array("p1", "p2", "p3"), lambda p: p != 0))
    totals = materialize(stripes.groupBy("prefix").agg(F.sum("total").alias("total")).where(F.col("total") >= least), "phrase-totals")
    entries = stripes.select("prefix", F.explode(F.arrays_zip("next", "n")).alias("entry"))
    phrases = materialize(entries.select(F.concat("prefix", F.array("entry.next")).alias("phrase"), F.col("entry.n").alias("a")), "phrase-candidates")
    discard(one, two, three)

    # the largest count of a phrase that goes one word further to the right or to the left
    further = phrases.where(F.size("phrase") > 2)
    size = F.size("phrase")
    sides = further.select(F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"), F.col("a").alias("longest"))
    longest = sides.groupBy("phrase").agg(F.max("longest").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    standing = phrases.join(longest, "phrase", "left").where(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * subsumed)).drop("longest")

    cut = standing.select("phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cut = cut.select("phrase", "a", "k", F.slice("phrase", F.lit(1), F.col("k")).alias("first"), F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")).alias("rest"))
    cut = cut.join(totals.select(F.col("prefix").alias("first"), F.col("total").alias("l")), "first").join(totals.select(F.col("prefix").alias("rest"), F.col("total").alias("r")), "rest")
    cut = cut.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    scored = cut.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least")).select("phrase", "a", "least.l", "least.r", "least.score")

    spelled = scored.select("phrase", F.posexplode("phrase").alias("at", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("phrase").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("words"))
    named = scored.join(spelled, "phrase").select("lang", F.col("words").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= per_language)
    out = materialize(best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-result")
    discard(words, totals, phrases)
    return out
