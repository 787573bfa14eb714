"""BPE encoding and decoding by prefix-sharing trie traversal (operator 4).

Each task numbers the distinct words of a run of texts, about an Arrow batch, and walks the trie of those that it has not
met before depth first (words in byte order, keeping the states of the prefix shared with the word before, so each
shared prefix is worked out once). The state of a prefix is the last token of its encoding: the longest token that ends
the prefix and that byte-pair merging leaves standing next to the last token of what is before it. The encoding of a
prefix is that of the part before its last token, and that token, so last tokens are followed back from a word's end.

Defined cases: a null text encodes as the empty text, to no ids; null ids decode to the empty text; the special
tokens of the vocabulary file are found in a text as the tokenizers library finds them; whole texts of any length are
encoded. Repeated rows and all other columns are untouched, as these are column expressions.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The pre-tokenisation pattern of byte-level BPE, and the bytes that stand for themselves in its files.
#: No letters or numbers begin as a contraction does, so the contractions may come after them, which is faster.
WORD_PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Bounds of what a worker keeps between batches, about 70 MB: twice WORDS_KEPT words, pairs of tokens, steps off the trie.
#: Longer words than LONGEST_KEPT are not kept. Emptying the stores costs time only.
WORDS_KEPT, PAIRS_KEPT, STEPS_KEPT, LONGEST_KEPT = 60_000, 170_000, 70_000, 40
#: Bytes of text whose words are held apart at once, and how many words, new ones and all, make a run, whose trie is walked at once.
PIECE_BYTES, RUN_NEW, RUN_WORDS = 250_000, 30_000, 1_000_000
#: Ids that are decoded at once.
PART_IDS = 100_000


def byte_of_character() -> dict[str, int]:
    """Byte-level files write the bytes outside PRINTABLE as the characters from 256 on, in order."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Filled(dict):
    """A dict that works out a missing entry from its key and keeps it."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key: int):
        found = self[key] = self.work(key)
        return found


class _Words(dict):
    """The number of each word met. Words of an older store keep theirs, others (`new`) get the next from `size` on."""

    def __init__(self, older: dict[str | int, int], size: int):
        super().__init__()
        self.older, self.size = older, size
        self.new: list[str | int] = []

    def __missing__(self, word: str | int) -> int:
        number = self.older.get(word)
        if number is None:
            number = self.size
            self.size += 1
            self.new.append(word)
        self[word] = number
        return number


def _runs(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of `count` entries from `start` on, one run after the other, and where each run begins and ends among these."""
    borders = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=borders[1:])
    return np.repeat(start - borders[:-1], count) + np.arange(borders[-1], dtype=np.int32), borders


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: bytes):
        model = json.loads(content)
        byte = byte_of_character()
        self.tokens: dict[bytes, int] = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        #: the bytes of each id in a row; those in no vocabulary, -1 as well, have none
        own = {i: t for t, i in self.tokens.items()} | {i: t.encode() for t, i in self.special.items()}
        in_order = [own.get(i, b"") for i in range(max(own) + 1)] + [b""]
        self.size = list(map(len, in_order))
        self.bytes_start, self.bytes_count = np.cumsum([0, *self.size[:-1]]).astype(np.int32), np.array(self.size, np.int32)
        self.bytes = np.frombuffer(b"".join(in_order), np.uint8)
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.word_pattern = regex.compile(WORD_PATTERN)
        ids = {t: i for t, i in model["model"]["vocab"].items()}
        #: left << 20 | right -> rank of the merge; for each token the rank and the parts of the merge that makes it, -1 if none does
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = (array("i", [-1]) * len(self.size) for _ in range(3))
        for rank, merge in enumerate(model["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            token = ids[left + right]
            self.rank[ids[left] << 20 | ids[right]] = rank
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = rank, ids[left], ids[right]
        self.step: _Filled | None = None  # made with the first word; decoding does without
        #: left << 20 | right -> whether the two tokens stand side by side
        self.pairs = _Filled(lambda pair: self._stands(pair >> 20, pair & 0xFFFFF))
        #: words met of late and those met before them; the ids of word number i are the `count[i]` from `start[i]` on
        self.older: dict[str | int, int] = {}
        self.words = _Words(self.older, 0)
        self.ids, self.start, self.count = (np.zeros(0, np.int32) for _ in range(3))

    def _link_suffixes(self) -> None:
        """An automaton that holds, for all bytes read so far, their longest end that begins a token (a node), and for
        each node the longest token that ends there; `shorter` has the next one that ends where a token does."""
        begins = {b"": 0}
        #: node << 8 | byte -> the node after that byte: the `edges` of tokens, then others as they are met
        self.step = _Filled(self._next)
        for token in self.tokens:
            for end in range(1, len(token) + 1):
                if token[:end] not in begins:
                    node = begins[token[:end]] = len(begins)
                    self.step[begins[token[: end - 1]] << 8 | token[end - 1]] = node
        self.edges = len(self.step)
        self.back, self.ends = array("i", [0]) * len(begins), [-1] * len(begins)
        self.shorter = [-1] * len(self.size)
        for prefix in sorted(begins, key=len)[1:]:
            node, parent = begins[prefix], begins[prefix[:-1]]
            self.back[node] = self._next(self.back[parent] << 8 | prefix[-1]) if parent else 0
            self.ends[node] = longest = self.ends[self.back[node]]
            if (token := self.tokens.get(prefix)) is not None:
                self.shorter[token], self.ends[node] = longest, token

    def _next(self, key: int) -> int:
        node, byte = key >> 8, key & 0xFF
        while (found := self.step.get(node << 8 | byte)) is None and node:
            node = self.back[node]
        return found or 0

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens: one would need to come when both its parts lie at the
        border, after they are made and before they are taken up. Of equal ranks the merge further left comes first."""
        x, y, x_taken, y_taken, made = left, right, len(self.rank), len(self.rank), self.made
        while True:  # back in time: the later made of the two that lie at the border gives way to its part there
            rank = self.rank.get(x << 20 | y)
            if rank is not None and made[x] < rank < x_taken and made[y] < rank <= y_taken:
                return False
            if made[x] > made[y]:
                x, x_taken = self.right[x], made[x]
            elif made[y] >= 0:
                y, y_taken = self.left[y], made[y]
            else:
                return True

    def encode_words(self, words: list[str]) -> tuple[list[int], array, list[int]]:
        """The token ids of distinct words, by one depth-first walk of their trie: places of the words in the order
        of the walk, all ids, and where those of each word end."""
        if self.step is None:
            self._link_suffixes()
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs.clear()
        while len(self.step) > self.edges + STEPS_KEPT:
            self.step.popitem()
        pairs, step, ends, shorter, size = self.pairs, self.step, self.ends, self.shorter, self.size
        # for each prefix of the word at hand: its node and its last token, shifted
        before, nodes, last, room = b"", [0], [0], 0
        order, out, borders = sorted(range(len(words)), key=words.__getitem__), array("i"), []  # code points order as their UTF-8 bytes do
        for place in order:
            data, shared = words[place].encode(), 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            if len(data) > room:
                nodes += [0] * (len(data) - room)
                last += [0] * (len(data) - room)
                room = len(data)
            node, end = nodes[shared], shared
            for byte in data[shared:]:
                end += 1
                node = step[node << 8 | byte]
                token = ends[node]
                start = end - size[token]
                while start and not pairs[last[start] | token]:
                    token = shorter[token]
                    start = end - size[token]
                nodes[end] = node
                last[end] = token << 20
            before, back = data, []
            while end:
                token = last[end] >> 20
                back.append(token)
                end -= size[token]
            out.extend(back[::-1])
            borders.append(len(out))
        return order, out, borders

    def split(self, text: str) -> list[str | int]:
        """Words, and ids for special tokens."""
        if not self.special_pattern or not self.special_pattern.search(text):
            return self.word_pattern.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self.word_pattern.findall(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.word_pattern.findall(text[at:])

    def pack(self, pieces: Iterable[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts the token ids of all of them, and where those of each text begin and end."""
        run: list[tuple[np.ndarray, list[int]]] = []
        for texts in pieces:
            if not run and (len(self.words) > WORDS_KEPT or len(self.ids) > 32 * WORDS_KEPT):
                self._forget()
            numbers, borders = [], [0]
            for text in texts:
                split = self.split(text)
                numbers.append(np.fromiter(map(self.words.__getitem__, split), np.int32, len(split)))
                borders.append(borders[-1] + len(split))
            run.append((np.concatenate(numbers), borders))
            if len(self.words.new) > RUN_NEW or sum(len(n) for n, _ in run) > RUN_WORDS:
                yield from self._packed(run)
                run = []
        yield from self._packed(run)

    def _packed(self, run: list[tuple[np.ndarray, list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `pack` gives, from the numbers of words and the places where texts begin and end among them."""
        self._encode_new()
        for numbers, borders in run:
            places, ends = _runs(self.start[numbers], self.count[numbers])
            yield self.ids[places], ends[borders]

    def _encode_new(self) -> None:
        """The ids of the words that have a number only."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        order, out, borders = self.encode_words([w if isinstance(w, str) else "" for w in new])
        start, count, held = np.zeros(len(new), np.int32), np.zeros(len(new), np.int32), len(self.ids)
        start[order] = held + np.array([0, *borders[:-1]])
        count[order] = np.diff(borders, prepend=0)
        for number, word in enumerate(new):
            if isinstance(word, int):
                start[number], count[number] = held + len(out), 1
                out.append(word)
            elif len(word) > LONGEST_KEPT:
                del self.words[word]
        self.ids, self.start, self.count = (np.concatenate(x) for x in ((self.ids, out), (self.start, start), (self.count, count)))

    def _forget(self) -> None:
        """The words that were not met since the last time go, and the others are numbered anew."""
        kept = np.fromiter(self.words.values(), np.int32, len(self.words))
        places, borders = _runs(self.start[kept], self.count[kept])
        self.ids, self.start, self.count = self.ids[places], borders[:-1].copy(), np.diff(borders)
        self.older = dict(zip(self.words, range(len(kept))))
        self.words = _Words(self.older, len(kept))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [ids[a:b].tolist() for ids, borders in self.pack([texts]) for a, b in zip(borders, borders[1:])]

    def decode(self, ids: np.ndarray, borders: Sequence[int]) -> list[str]:
        """The texts of ids in a row, each between two borders."""
        known = np.where((ids >= 0) & (ids < len(self.size)), ids, -1)
        parts = np.split(known, range(PART_IDS, len(known), PART_IDS))
        found = b"".join([self.bytes[_runs(self.bytes_start[p], self.bytes_count[p])[0]].tobytes() for p in parts])
        at = np.append(0, np.cumsum(self.bytes_count[known]))[borders].tolist()
        return [found[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(name: str, sent: Broadcast) -> Vocabulary:
    """A worker builds each vocabulary once."""
    if name not in _loaded:
        _loaded.clear()
        pa.default_memory_pool().release_unused()  # what a worker's stages before this one left
        _loaded[name] = Vocabulary(sent.value)
    return _loaded[name]


def _pieces(batch: pa.Array, size: int = 1_000, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Runs of a batch with `size` rows or fewer and, if of more than one row, `most` bytes or fewer."""
    at, lengths = 0, pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_pylist()
    while at < len(batch):
        end, held = at + 1, lengths[at]
        while end < len(batch) and end - at < size and held + lengths[end] <= most:
            held += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


class ByteBPE:
    """Column expressions that encode and decode with one vocabulary file, read on the driver and sent as it is."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            content = f.read()
        sent, name = spark.sparkContext.broadcast(content), sha256(content).hexdigest()

        def encoded(own: Vocabulary, batch: pa.Array, decoded: list[str] | None = None) -> pa.Array:
            """The ids of a batch; what they decode to is added to `decoded`, if given."""
            parts, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int32)]
            for ids, borders in own.pack([t or "" for t in piece.to_pylist()] for piece in _pieces(batch)):
                parts.append(ids)
                offsets.append(offsets[-1][-1] + borders[1:])
                if decoded is not None:
                    decoded += own.decode(ids, borders)
            return pa.ListArray.from_arrays(np.concatenate(offsets), np.concatenate(parts))

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _vocabulary(name, sent)
            for batch in batches:
                yield encoded(own, batch)

        def round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _vocabulary(name, sent)
            for batch in batches:
                texts: list[str] = []
                ids = encoded(own, batch, texts)
                yield pa.StructArray.from_arrays([ids, pa.array(texts, pa.string())], ["ids", "decoded"])

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = _vocabulary(name, sent)
            for batch in batches:
                at, ids = batch.offsets.to_pylist(), batch.values.fill_null(-1).to_numpy()
                yield pa.array([own.decode(ids[a:b], [0, b - a])[0] for a, b in zip(at, at[1:])], pa.string())

        self._encode = F.arrow_udf(encode, T.ArrayType(T.IntegerType()))
        self._decode = F.arrow_udf(decode, T.StringType())
        self._round_trip = F.arrow_udf(round_trip, "struct<ids: array<int>, decoded: string>")

    def encode(self, text: Column | str) -> Column:
        """array<int> of token ids."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)

    def round_trip(self, text: Column | str) -> Column:
        """struct<ids, decoded>: the ids of a text, and what they decode to, in one pass through one worker."""
        return self._round_trip(text)
