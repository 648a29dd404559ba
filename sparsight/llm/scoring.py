"""Language-model scores from Elias-Fano n-gram tries, sharded by n-gram so that no task holds the model.

The model is a word bigram model with a Dirichlet prior on each context: P(w|v) = (c(v,w) + M p(w)) / (c(v) + M) with
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), all counts taken over every training document. Documents go to blocks once. A
block asks for each distinct word and pair of its texts, with its own training counts, in packed sorted arrays by shard
of the n-gram's hash. A shard adds up the counts of all blocks, lays them out as a trie and answers every block from it;
answers return to the blocks, whose texts are then scored. Volumes follow the input at every step, shards are even
whatever the words are, and nothing but N and V reaches the driver.

A trie has two levels of monotone integers in Elias-Fano form: contexts, pointers to each context's successors, and the
successors, numbered relative to the end of the context before so that they rise across contexts; a level of two-byte
codes holds the pairs' joint probabilities (as multiples of 1/N, on a logarithmic grid); a block smooths them with p(w) and
c(v), which other shards send. The blob lies in one memory map and is queried there: places are selected in the unary high
bits, low bits are read from their packed words, and a successor is found among those of its context. Nothing is unpacked.
"""

from __future__ import annotations

import mmap
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, table, text_of
from .languages import in_fold

#: Words that a context's prior counts for.
PRIOR = 60.0
#: Bytes of text that a block is meant to hold; a row counts for 16 more.
BYTES_PER_BLOCK = 16_000_000
SHARDS_PER_BLOCK = 2
#: The two-byte grid of counts: 0, then exact, then geometric up to 2^62 by steps of 0.07 %.
_EXACT = 16384
LEVELS = np.concatenate([np.arange(_EXACT + 1.0), np.exp(np.linspace(np.log(_EXACT), np.log(2.0**62), 65536 - _EXACT))[1:]])
_MIDDLES = (LEVELS[1:] + LEVELS[:-1]) / 2
_LOWER = bytes(range(256)).lower()
#: No word is empty, so the empty one stands for a document's end, which is also what comes before its first word.
END = b""


#: Place of the k-th one (row) among the eight bits of a byte (column).
_SELECT_IN_BYTE = np.array([[([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256)] for k in range(8)], dtype=np.uint8)
_ONE = np.uint64(1)


class _Bits:
    """A bit vector of 64-bit words with a directory of how many ones precede each word."""

    def __init__(self, words_: np.ndarray):
        self.words = words_
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words_), dtype=np.int64)])
        self.zeros = np.arange(len(words_) + 1, dtype=np.int64) * 64 - self.ones

    def select(self, rank: np.ndarray, bit: int = 1) -> np.ndarray:
        """Positions of the ones (or zeros) of these ranks."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, rank, side="right") - 1
        left = rank - before[word]
        held = self.words[word] if bit else ~self.words[word]
        octets = held.astype("<u8").view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.uint8)
        octet = (upto <= left[:, None]).sum(axis=1)
        rows = np.arange(len(rank))
        left = left - np.where(octet > 0, upto[rows, np.maximum(octet - 1, 0)], 0)
        return word * 64 + octet * 8 + _SELECT_IN_BYTE[left, octets[rows, octet]]


class EliasFano:
    """A non-decreasing sequence of unsigned integers in n (2 + log2(u/n)) bits: low bits packed, high bits in unary. Read in place."""

    HEAD = struct.Struct("<QBxxxxxxxQQ")  # items, low bits, 64-bit words of the low part, and of the high part

    def __init__(self, buffer, at: int = 0):
        self.n, bits, low, high = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        self.bits, self.mask = np.uint64(bits), np.uint64((1 << bits) - 1)
        self.low = np.frombuffer(buffer, "<u8", low, at)
        self.high = _Bits(np.frombuffer(buffer, "<u8", high, at + 8 * low))
        self.end = at + 8 * (low + high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        unary = np.zeros(-(-(n + (top >> bits) + 1) // 64) * 64, dtype=np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little")
        low = np.zeros(-(-n * bits // 64) + 1 if bits else 0, dtype="<u8")  # one word more, so that pairs of words can be read
        if bits and n:
            lows = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.bitwise_or.reduceat(lows << shift, first)
            over = shift + np.uint64(bits) > 64
            low[word[over] + 1] |= lows[over] >> (np.uint64(64) - shift[over])
        return cls.HEAD.pack(n, bits, len(low), len(high) // 8) + low.tobytes() + high.tobytes()

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.uint64) * self.bits
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        return (self.low[word] >> shift | (self.low[word + 1] << _ONE) << (np.uint64(63) - shift)) & self.mask

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """The integers at these places."""
        return (self.high.select(index) - index).astype(np.uint64) << self.bits | self._lows(index)

    def search(self, values: np.ndarray) -> np.ndarray:
        """The first place of an integer not below each value; n where there is none."""
        if not self.n:
            return np.zeros(len(values), np.int64)
        high, low = values >> self.bits, values & self.mask
        most = self[np.array([self.n - 1])][0] >> self.bits
        inside = high <= most
        h = np.minimum(high, most).astype(np.int64)
        # those with the same high part lie between two zeros of the unary code
        first = np.where(h > 0, self.high.select(np.maximum(h - 1, 0), 0) - h + 1, 0)
        last = self.high.select(h, 0) - h
        open_ = np.flatnonzero(first < last)
        while len(open_):
            a, b = first[open_], last[open_]
            middle = (a + b) >> 1
            below = self._lows(middle) < low[open_]
            first[open_], last[open_] = np.where(below, middle + 1, a), np.where(below, b, middle)
            open_ = open_[first[open_] < last[open_]]
        return np.where(inside, first, self.n)

    def decode(self) -> np.ndarray:
        return self[np.arange(self.n)]


def quantise(counts: np.ndarray) -> np.ndarray:
    """The nearest grid code of each count; only 0 has code 0."""
    return np.searchsorted(_MIDDLES, counts).astype("<u2")


class Trie:
    """Pairs (context, successor) of 32-bit numbers with a two-byte code each."""

    def __init__(self, buffer):
        self.contexts = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.codes = np.frombuffer(buffer, "<u2", self.successors.n, self.successors.end)

    @staticmethod
    def build(pairs: np.ndarray, counts: np.ndarray) -> bytes:
        """The blob of sorted distinct pairs (context << 32 | successor) and their counts."""
        contexts, first = np.unique(pairs >> np.uint64(32), return_index=True)
        pointers = np.append(first, len(pairs))
        relative = pairs & np.uint64(0xFFFFFFFF)
        lasts = relative[pointers[1:] - 1] + np.uint64(1)
        bases = np.cumsum(lasts, dtype=np.uint64) - lasts
        rising = relative + np.repeat(bases, np.diff(pointers))
        return b"".join([EliasFano.encode(contexts), EliasFano.encode(pointers), EliasFano.encode(rising), quantise(counts).tobytes()])

    def lookup(self, pairs: np.ndarray) -> np.ndarray:
        """The code of each pair (sorted), 0 where there is none: the context first, then its successors by their relative numbers."""
        out = np.zeros(len(pairs), "<u2")
        if not self.contexts.n or not len(pairs):
            return out
        contexts = pairs >> np.uint64(32)
        fresh = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        wanted = contexts[fresh]
        place = self.contexts.search(wanted)
        place = np.where(place < self.contexts.n, place, 0)
        known = self.contexts[place] == wanted
        place = place[known]
        first, last = self.pointers[place].astype(np.int64), self.pointers[place + 1].astype(np.int64)
        # a context's successors are counted from one more than the last number of the context before
        base = np.where(first > 0, self.successors[np.maximum(first - 1, 0)] + _ONE, np.uint64(0))
        group = np.cumsum(fresh) - 1
        asked = np.flatnonzero(known[group])
        mine = (np.cumsum(known) - 1)[group[asked]]
        number = (pairs[asked] & np.uint64(0xFFFFFFFF)) + base[mine]
        j = self.successors.search(number)
        held = j < last[mine]
        asked, j, number = asked[held], j[held], number[held]
        held = self.successors[j] == number
        out[asked[held]] = self.codes[j[held]]
        return out


def mapped(blob: bytes) -> memoryview:
    """The blob in an anonymous memory map: outside of the heap, gone with the last view of it, and no file on a local disk."""
    region = mmap.mmap(-1, max(1, len(blob)))
    region[: len(blob)] = blob
    return memoryview(region)


def words(text: str) -> list[bytes]:
    """A text's words, A-Z lower-cased: bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


class Block:
    """The n-grams of some documents: distinct words and pairs, sorted, and where each token finds its own."""

    def __init__(self, texts: list[str], training: np.ndarray):
        give_memory_back()
        number: dict[bytes, int] = {END: 0}
        ids: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            own = words(text)
            ids += [number.setdefault(w, len(number)) for w in own]
            ids.append(0)
            sizes[i] = len(own) + 1
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        tokens = np.array(ids, dtype=np.int64)
        del ids
        hashes = np.fromiter(map(_hash, number), np.uint64, len(number))
        self.word_keys, place = np.unique(hashes, return_inverse=True)
        self.word_of = place[tokens]
        before = np.concatenate([[0], tokens[:-1]])  # each document but the first follows another's end
        self.context_of = place[before]
        pairs = (hashes[before] & np.uint64(0xFFFFFFFF00000000)) | (hashes[tokens] & np.uint64(0xFFFFFFFF))
        self.pair_keys, self.pair_of = np.unique(pairs, return_inverse=True)
        learned = np.repeat(training, sizes)
        self.word_counts = np.bincount(self.word_of[learned], minlength=len(self.word_keys))
        self.pair_counts = np.bincount(self.pair_of[learned], minlength=len(self.pair_keys))

    def by_shard(self, shards: int):
        """(shard, places of its words, places of its pairs) for each shard that has any; the places rise, so the keys stay sorted."""
        word_shard, pair_shard = _shard(self.word_keys, shards), _shard(self.pair_keys, shards)
        word_order, pair_order = np.argsort(word_shard, kind="stable"), np.argsort(pair_shard, kind="stable")
        edges = np.arange(shards + 1, dtype=np.uint64)
        w, p = np.searchsorted(word_shard[word_order], edges), np.searchsorted(pair_shard[pair_order], edges)
        for s in np.flatnonzero((np.diff(w) > 0) | (np.diff(p) > 0)).tolist():
            yield s, word_order[w[s] : w[s + 1]], pair_order[p[s] : p[s + 1]]


def _total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys that were counted at all, with their sums."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    kept = count > 0
    key, count = key[kept], count[kept].astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    if not len(key):
        return key, count
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


ASKED = "shard int, block int, words binary, word_counts binary, pairs binary, pair_counts binary"
ANSWERED = "block int, shard int, counts binary, codes binary"


def _asks(shards: int):
    def ask(group: pa.Table) -> pa.Table:
        block = Block(group.column("text").to_pylist(), group.column("training").to_numpy())
        rows = {"shard": [], "block": [], "words": [], "word_counts": [], "pairs": [], "pair_counts": []}
        own = group.column("block")[0].as_py()
        for s, w, p in block.by_shard(shards):
            for name, value in zip(rows, (s, own, block.word_keys[w].tobytes(), block.word_counts[w].astype("<u4").tobytes(), block.pair_keys[p].tobytes(), block.pair_counts[p].astype("<u4").tobytes())):
                rows[name].append(value)
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), kinds)})

    return ask


def _answer(group: pa.Table) -> pa.Table:
    give_memory_back()
    array = lambda name, kind: [np.frombuffer(v, kind) for v in group.column(name).to_pylist()]
    asked_words, asked_pairs = array("words", "<u8"), array("pairs", "<u8")
    known, counts = _total(asked_words, array("word_counts", "<u4"))
    trie = Trie(mapped(Trie.build(*_total(asked_pairs, array("pair_counts", "<u4")))))
    answers, codes = [], []
    for w, p in zip(asked_words, asked_pairs):
        at = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
        answers.append((np.where(known[at] == w, counts[at], 0) if len(known) else np.zeros(len(w))).astype("<i8").tobytes())
        codes.append(trie.lookup(p).tobytes())
    return pa.table({"block": group.column("block"), "shard": group.column("shard"), "counts": pa.array(answers, pa.binary()), "codes": pa.array(codes, pa.binary())})


def _scores(shards: int, total: int, distinct: int):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs.column("text").to_pylist(), docs.column("training").to_numpy())
        count, code = np.zeros(len(block.word_keys), np.int64), np.zeros(len(block.pair_keys), "<u2")
        got = {s: (c, k) for s, c, k in zip(*(answers.column(x).to_pylist() for x in ("shard", "counts", "codes")))}
        for s, w, p in block.by_shard(shards):
            count[w], code[p] = np.frombuffer(got[s][0], "<i8"), np.frombuffer(got[s][1], "<u2")
        chance = (count + 0.5) / (total + 0.5 * (distinct + 1))
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        own = count[block.word_of]
        context = count[block.context_of]
        smoothed = (np.minimum(LEVELS[code[block.pair_of]], context) + PRIOR * chance[block.word_of]) / (context + PRIOR)
        return pa.table(
            {
                "id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": block.sizes, "n_known": by_doc((own > 0).astype(np.int64)),
                "train_tokens": pa.array([total] * len(docs), pa.int64()), "base_score": by_doc(np.log10(chance)[block.word_of]), "score": by_doc(np.log10(smoothed)),
            }
        ).select(["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def vocabulary(training: DataFrame, shards: int) -> tuple[int, int]:
    """(tokens, distinct tokens) of all training texts; each partition sends the hashes it has seen to shards of hashes."""

    def seen(batches):
        held: set[int] = set()
        tokens = 0
        for batch in batches:
            distinct: set[bytes] = set()
            for text in batch.column("text").to_pylist():
                own = words(text)
                tokens += len(own) + 1
                distinct.update(own)
            held.update(map(_hash, distinct))
            if batch.num_rows:
                held.add(_hash(END))
            if len(held) > 4_000_000:  # bounds the set; the shards see to repeats
                yield from packed(held, tokens)
                held, tokens = set(), 0
        yield from packed(held, tokens)

    def packed(held, tokens):
        keys = np.fromiter(held, np.uint64, len(held))
        shard = _shard(keys, shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        asked = np.flatnonzero(np.diff(edges)).tolist() or [0]
        parts = [keys[order[edges[s] : edges[s + 1]]].tobytes() for s in asked]
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int32()), pa.array(parts, pa.binary()), pa.array([tokens, *[0] * (len(asked) - 1)], pa.int64())], names=["shard", "keys", "tokens"])

    def distinct(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in group.column("keys").to_pylist()]
        tokens = sum(group.column("tokens").to_pylist())
        return pa.table({"tokens": pa.array([tokens], pa.int64()), "distinct": pa.array([len(np.unique(np.concatenate(keys)))], pa.int64())})

    found = training.select("text").mapInArrow(seen, "shard int, keys binary, tokens bigint").groupBy("shard").applyInArrow(distinct, "tokens bigint, distinct bigint")
    row = found.agg(F.sum("tokens"), F.sum("distinct")).first()
    return (row[0] or 0), (row[1] or 0)


def score_documents(docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    held_out is a boolean Column; all other rows are learned from (a null counts as false). Null texts count as empty:
    their end token alone. Rows that repeat are all counted and all scored. An empty table gives an empty result, and
    with nothing to learn from every word has the same chance. Only the id and the text are read.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    blocks = max(16, -(-size // BYTES_PER_BLOCK))
    shards = SHARDS_PER_BLOCK * blocks
    total, distinct = vocabulary(rows.where(~F.col("held_out")), shards)
    blocked = rows.select("*", (~F.col("held_out")).alias("training"), F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"))
    answers = blocked.groupBy("block").applyInArrow(_asks(shards), ASKED).groupBy("shard").applyInArrow(_answer, ANSWERED)
    kind = rows.schema["id"].dataType
    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(shards, total, distinct), schema)
    return scored.withColumnRenamed("id", id_column)


def op10_trie_scores(spark, sf_dir: str) -> DataFrame:
    """Every whole text scored by the model of the documents in four of five folds; see score_documents for the edge cases."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, in_fold("doc_id", 5, 1))
