"""Language-model scoring with class-based n-grams in the manner of Brown et al.

Words are counted exactly over all training documents. Exchange clustering begins with types: the `head` most frequent words are types of
their own, all others belong to one of `TAIL` types by their ending and length. The bigrams of types over the whole training text are counted
into one table of at most (head + TAIL + 1) squared rows. In a round, Spark tasks find for every type, from its own bigrams and the class
bigrams, the class to which a move gains most likelihood, and half of the types move. Rounds end when the likelihood no longer grows.

Then every other word, however rare, is placed by itself: its neighbours' classes are counted over the whole training text, shuffled by
word, and the word moves from its type's class to the one that gains most likelihood. The class bigrams are counted again with these
classes, which stay if the likelihood grew. A word that was not learned has the class of its type.

A text's probability is the product, over its words and one end token, of the class transition (interpolated with the
class's own frequency) and of the word's emission from its class, (count + 0.1) / (class total + 0.1 (class words + 1)).
Both passes over classes read those of the most frequent words from a table of at most `DIRECT` entries in each task; the counts and
classes of the others, which are spread thin, come by joins on the word.

Words are identified by a 64-bit hash; two of n words share one with probability n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import WHITE, Words, bound_batches, crc_bucket, mix, pieces, slots
from masklake.session import discard, materialize

HEAD = 1024
TAIL = 127
CLASSES = 48
ROUNDS = 12
DIRECT = 1 << 18
ADD = 0.1
PRIOR = 5.0
_FLUSH = 1_500_000
_SLOT_BITS = 20
_ENTRY = np.dtype([("code", "<i4"), ("n", "<i8")])


def tail_types(words: Words, which: np.ndarray | slice = slice(None)) -> np.ndarray:
    """A type from 0 to TAIL - 1 by each word's last two bytes and length."""
    end = words.end[which]
    length = end - words.start[which]
    last = words.mapped[end - 1].astype(np.uint64)
    before = np.where(length > 1, words.mapped[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    return (mix((np.minimum(length, 15).astype(np.uint64) << np.uint64(16)) | (before << np.uint64(8)) | last)
            % np.uint64(TAIL)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, tail, n), summed within the task as far as memory of fixed size holds it."""
    held: list[tuple] = []
    size = 0

    def merged() -> tuple:
        word, at, where = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(where, np.concatenate([h[2] for h in held])).astype(np.int64)
        return word, np.concatenate([h[1] for h in held])[at], n

    def out() -> Iterator[pa.RecordBatch]:
        word, tail, n = merged()
        for a in range(0, len(word), 50_000):
            yield pa.record_batch({"word": pa.array(word[a:a + 50_000].view(np.int64)), "tail": pa.array(tail[a:a + 50_000]),
                                   "n": pa.array(n[a:a + 50_000])})

    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), WHITE, nul_is_word=True)
        if not len(words):
            continue
        word, at, n = np.unique(words.hash, return_index=True, return_counts=True)
        held.append((word, tail_types(words)[at], n))
        size += len(word)
        if size > _FLUSH:
            held = [merged()]
            size = len(held[0][0])
            if size > _FLUSH / 2:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


@dataclass
class Vocabulary:
    """Frequent words for direct look-up: sorted hashes, counts, the type of those in the head (else -1), and classes once they are found."""

    words: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    size: int  # number of head types
    classes: np.ndarray | None = None

    def __post_init__(self) -> None:
        slot = self.words.view(np.uint64) >> np.uint64(64 - _SLOT_BITS)
        self.first = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.first[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot.astype(np.int64), minlength=1 << _SLOT_BITS) > 1

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index among the frequent words, whether it is one) of each word; a slot of several words is searched."""
        keys = words.hash.view(np.int64)
        if not len(self.words):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = words.hash >> np.uint64(64 - _SLOT_BITS)
        at = self.first[slot].astype(np.int64)
        rest = np.flatnonzero(self.crowded[slot])
        at[rest] = np.minimum(np.searchsorted(self.words, keys[rest]), len(self.words) - 1)
        return at, (at >= 0) & (self.words[at] == keys)

    def look_up(self, words: Words) -> np.ndarray:
        """The type of each word; type 0 is the text's boundary."""
        at, known = self.find(words)
        kinds = np.full(len(words), -1, np.int64)
        kinds[known] = self.kinds[at[known]]
        out = 1 + TAIL + kinds
        tail = np.flatnonzero(kinds < 0)
        out[tail] = 1 + tail_types(words, tail)
        return out


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the count, on a fixed scale, that at most `most` words reach."""
    step = F.floor(F.log2("n") * 8)
    left, bound = most, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        left -= row["count"]
        if left < 0:
            break
        bound = row["step"]
    return counts.where(step >= bound) if bound is not None else counts.limit(0)


def _vocabulary(counts: DataFrame, head: int, direct: int) -> Vocabulary:
    table = _frequent(counts, direct).select("word", "n").toArrow()
    word, n = (table.column(c).to_numpy() for c in ("word", "n"))
    order = np.argsort(word)
    word, n = word[order], n[order]
    kinds = np.full(len(word), -1, np.int64)
    top = np.lexsort((word, -n))[:head]
    kinds[top] = np.arange(len(top))
    return Vocabulary(word, n, kinds, len(top))


def _sequence(words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(types of all texts with a boundary before the first, between any two and after the last; positions of each text's end)."""
    rows = len(words.first) - 1
    out = np.zeros(len(kinds) + rows + 1, np.int64)
    out[np.arange(len(kinds)) + words.row + 1] = kinds
    return out, words.first[1:] + np.arange(1, rows + 1)


def _bigrams(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(a, b, n): how often type b follows type a, the boundary being type 0."""
    size = 1 + TAIL + vocabulary.size
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WHITE, nul_is_word=True)
            kinds, _ = _sequence(words, shared.value.look_up(words))
            total += np.bincount(kinds[:-1] * size + kinds[1:], minlength=size * size)
        found = np.flatnonzero(total)
        for a in range(0, len(found), 50_000):
            part = found[a:a + 50_000]
            yield pa.record_batch({"a": pa.array(part // size), "b": pa.array(part % size), "n": pa.array(total[part])})

    return docs.select("text").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes."""
    return float(_phi(table).sum() - _phi(table.sum(0)).sum() - _phi(table.sum(1)).sum())


def best_move(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, now: int) -> tuple[int, float]:
    """(class, gain) of the best class for a type whose successors and predecessors by class are `right` and `left`.

    `own` is how often it follows itself, `now` its class. Class 0 belongs to the boundary alone.
    """
    r, c = right.copy(), left.copy()
    r[now] -= own
    c[now] -= own
    base = table.copy()
    base[now, :] -= r
    base[:, now] -= c
    base[now, now] -= own
    rows, cols = base.sum(1) + c, base.sum(0) + r  # wherever the type goes, its neighbours keep their totals
    diagonal = np.diag(base)
    gain = ((_phi(base + r[None, :]) - _phi(base)).sum(1) - (_phi(diagonal + r) - _phi(diagonal))
            + (_phi(base + c[:, None]) - _phi(base)).sum(0) - (_phi(diagonal + c) - _phi(diagonal))
            + _phi(diagonal + r + c + own) - _phi(diagonal)
            - _phi(rows + r.sum() + own) + _phi(rows) - _phi(cols + c.sum() + own) + _phi(cols))
    gain[0] = -np.inf
    best = int(gain.argmax())
    return best, float(gain[best] - gain[now])


def _class_table(bigrams: DataFrame, classes: np.ndarray, n: int) -> np.ndarray:
    """Class bigrams, summed by Spark; at most n * n rows reach the driver."""
    spark = bigrams.sparkSession
    names = spark.createDataFrame([(k, int(c)) for k, c in enumerate(classes)], "kind bigint, class int")
    rows = (bigrams.join(F.broadcast(names.withColumnsRenamed({"kind": "a", "class": "ca"})), "a")
            .join(F.broadcast(names.withColumnsRenamed({"kind": "b", "class": "cb"})), "b")
            .groupBy("ca", "cb").agg(F.sum("n").alias("n"))).toArrow()
    table = np.zeros((n, n))
    ca, cb, count = (rows.column(c).to_numpy() for c in ("ca", "cb", "n"))
    table[ca, cb] = count
    return table


def exchange(bigrams: DataFrame, kinds: int, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each type, class bigrams) after exchange clustering of the table (a, b, n)."""
    classes = np.concatenate([[0], 1 + np.arange(kinds - 1) % max(1, n_classes - 1)])
    n_classes = max(n_classes, 2)
    sides = bigrams.select(F.col("a").alias("kind"), F.col("b").alias("other"), F.lit(0).alias("side"), "n").unionByName(
        bigrams.select(F.col("b").alias("kind"), F.col("a").alias("other"), F.lit(1).alias("side"), "n"))
    sides = materialize(sides.where("kind > 0").repartition(min(slots(bigrams), 64), "kind"), "type-bigrams")
    table = _class_table(bigrams, classes, n_classes)
    value = likelihood(table)
    for turn in range(rounds):
        shared = bigrams.sparkSession.sparkContext.broadcast((classes, table))

        def moves(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            classes, table = shared.value
            parts = [tuple(np.asarray(b.column(c)) for c in ("kind", "other", "side", "n")) for b in batches]
            if not parts:
                return
            kind, other, side, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            mine, at = np.unique(kind, return_inverse=True)
            vectors = np.zeros((2, len(mine), len(table)))
            np.add.at(vectors, (side, at, classes[other]), n)
            own = np.bincount(at, np.where((other == kind) & (side == 0), n, 0), len(mine))
            out = [(int(k), *best_move(table, vectors[0, i], vectors[1, i], own[i], int(classes[k])))
                   for i, k in enumerate(mine) if (k + turn) % 2]
            if out:
                yield pa.record_batch({c: pa.array(v) for c, v in zip(("kind", "best", "gain"), zip(*out, strict=True), strict=True)})

        found = sides.mapInArrow(moves, "kind bigint, best bigint, gain double").where("gain > 1e-9").collect()
        shared.unpersist()
        fresh = classes.copy()
        for row in found:
            fresh[row.kind] = row.best
        new_table = _class_table(bigrams, fresh, n_classes) if found else table
        new_value = likelihood(new_table)
        if new_value <= value and turn % 2:
            break
        if new_value > value:
            classes, table, value = fresh, new_table, new_value
    return classes, table


def best_moves(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`best_move` of many types, a row of `right` and `left` each, at a cost that follows their different neighbour classes."""
    m, size = right.shape
    every = np.arange(m)
    r, c = right.copy(), left.copy()
    r[every, now] -= own
    c[every, now] -= own

    def side(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros((m, size))
        w, j = np.nonzero(x)
        if not len(w):
            return out
        each, n = np.arange(len(w)), x[w, j]
        base = t.T[j]
        base[each, now[w]] -= n
        same = j == now[w]
        base[same] -= y[w[same]]
        base[each[same], j[same]] -= own[w[same]]
        gain = _phi(base + n[:, None]) - _phi(base)
        gain[each, j] = 0  # the diagonal is settled for both sides at once
        first = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[first]] = np.add.reduceat(gain, first)
        return out

    def less(values: np.ndarray, taken: np.ndarray) -> np.ndarray:
        out = np.tile(values, (m, 1))
        out[every, now] -= taken
        return out

    r_sum, c_sum = r.sum(1) + own, c.sum(1) + own
    diagonal = less(table.diagonal(), r[every, now] + c[every, now] + own)
    rows, cols = less(table.sum(1), r_sum), less(table.sum(0), c_sum)
    gain = (side(table, r, c) + side(table.T, c, r) + _phi(diagonal + r + c + own[:, None]) - _phi(diagonal)
            - _phi(rows + r_sum[:, None]) + _phi(rows) - _phi(cols + c_sum[:, None]) + _phi(cols))
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return best, gain[every, best] - gain[every, now]


def _contexts(docs: DataFrame, vocabulary: Vocabulary, classes: np.ndarray, n_classes: int) -> DataFrame:
    """(word, tail, seen) of all words outside the head, a row for each piece of text; `seen` packs (code, n) pairs: code j counts
    successors of class j, n_classes + j predecessors, and 2 n_classes how often the word follows itself."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, classes))
    width = 2 * n_classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes = shared.value
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WHITE, nul_is_word=True)
            kinds = vocabulary.look_up(words)
            rest = np.flatnonzero(kinds <= TAIL)
            cls = classes[_sequence(words, kinds)[0]]
            here = rest + words.row[rest] + 1
            word, at, of = np.unique(words.hash[rest], return_index=True, return_inverse=True)
            follows = np.zeros(len(rest), bool)
            follows[1:] = (np.diff(rest) == 1) & (of[1:] == of[:-1]) & (np.diff(words.row[rest]) == 0)
            key, n = np.unique(np.concatenate([of * width + cls[here + 1], of * width + n_classes + cls[here - 1], of[follows] * width + 2 * n_classes]),
                               return_counts=True)
            seen = np.empty(len(key), _ENTRY)
            seen["code"], seen["n"] = key % width, n
            bounds = np.searchsorted(key, np.arange(len(word) + 1) * width)
            tail = kinds[rest][at] - 1
            for a in range(0, len(word), 20_000):
                z = min(a + 20_000, len(word))
                offsets = ((bounds[a:z + 1] - bounds[a]) * _ENTRY.itemsize).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(seen[bounds[a]:bounds[z]].tobytes())])
                yield pa.record_batch({"word": pa.array(word[a:z].view(np.int64)), "tail": pa.array(tail[a:z]), "seen": packed})

    return docs.select("text").mapInArrow(run, "word bigint, tail bigint, seen binary")


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns word, tail, code, n of a batch of `_contexts`."""
    seen = batch.column("seen").cast(pa.binary())
    offsets = np.frombuffer(seen.buffers()[1], np.int32)[seen.offset:seen.offset + len(seen) + 1]
    entries = np.frombuffer(seen.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(_ENTRY)
    each = np.diff(offsets) // _ENTRY.itemsize
    return [np.repeat(np.asarray(batch.column(c)), each) for c in ("word", "tail")] + [entries["code"].astype(np.int64), entries["n"]]


def _whole_words(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[list[np.ndarray]]:
    """The columns word, tail, code, n of rows sorted by word, in parts that hold all rows of their words."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(_unpacked(batch))
        if sum(len(h[0]) for h in held) >= most:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            held = [[c[cut:] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def place_words(contexts: DataFrame, classes: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, class, was): the class that gains most for each word of `contexts`, and that of its type."""
    shared = contexts.sparkSession.sparkContext.broadcast((classes, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = shared.value
        size = len(table)
        for word, tail, code, n in _whole_words(batches):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            bounds = np.append(first, len(word))
            for a in range(0, len(first), 4096):
                z = min(a + 4096, len(first))
                part = slice(bounds[a], bounds[z])
                of = np.repeat(np.arange(z - a), np.diff(bounds[a:z + 1]))
                vectors = np.bincount(of * (2 * size + 1) + code[part], n[part], (z - a) * (2 * size + 1)).reshape(z - a, -1)
                was = classes[1 + tail[first[a:z]]]
                best, gain = best_moves(table, vectors[:, :size], vectors[:, size:2 * size], vectors[:, -1], was)
                yield pa.record_batch({"word": pa.array(word[first[a:z]]), "class": pa.array(np.where(gain > 1e-9, best, was).astype(np.int32)),
                                       "was": pa.array(was.astype(np.int32))})

    sorted_ = contexts.repartition(slots(contexts), "word").sortWithinPartitions("word")
    return sorted_.mapInArrow(run, "word bigint, class int, was int")


def _with_classes(vocabulary: Vocabulary, words: DataFrame, direct: int) -> Vocabulary:
    table = _frequent(words, direct).select("word", "class").toArrow()
    word, cls = (table.column(c).to_numpy() for c in ("word", "class"))
    return replace(vocabulary, classes=cls[np.argsort(word)].astype(np.int64))


def _pairs(words: Words, at: np.ndarray, known: np.ndarray, vocabulary: Vocabulary, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all neighbours in the texts, ends of texts included: (first word, its class, second word, its class, whether both classes are certain).

    A class that the frequent words tell is certain and stands as -1 - class beside the word 0; else it is that of the word's type, to be
    looked up by the word.
    """
    here = np.arange(len(words)) + words.row + 1
    size = len(words) + len(words.first)
    key, cls = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    rare = np.flatnonzero(~known)
    key[here[rare]] = words.hash.view(np.int64)[rare]
    cls[here[rare]] = classes[1 + tail_types(words, rare)]
    cls[here[known]] = -1 - vocabulary.classes[at[known]]
    return key[:-1], cls[:-1], key[1:], cls[1:], (cls[:-1] < 0) & (cls[1:] < 0)


def _resolved(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """`pairs` (a, ca, b, cb, ...) with classes in place of ca and cb, and `n_b`, the count of a second word that was looked up."""
    names = [c for c in pairs.columns if c not in ("a", "ca", "b", "cb")]
    left = words.select(F.col("word").alias("wa"), F.col("class").alias("class_a"))
    right = words.select(F.col("word").alias("wb"), F.col("class").alias("class_b"), F.col("n").alias("n_b"))
    # a certain side takes the other side's word as its key, so that it is spread like that
    keyed = pairs.withColumns({"ka": F.when(F.col("ca") < 0, F.col("b")).otherwise(F.col("a")), "kb": F.when(F.col("cb") < 0, F.col("a")).otherwise(F.col("b"))})
    cls = lambda c, found: F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.coalesce(found, c)).cast("int")
    return (keyed.join(left, F.col("ka") == F.col("wa"), "left").join(right, F.col("kb") == F.col("wb"), "left")
            .select(*names, cls("ca", "class_a").alias("ca"), cls("cb", "class_b").alias("cb"), F.when(F.col("cb") >= 0, F.coalesce("n_b", F.lit(0))).alias("n_b")))


def _classed_table(docs: DataFrame, vocabulary: Vocabulary, words: DataFrame, classes: np.ndarray, n: int) -> np.ndarray:
    """Class bigrams of the texts, every word with its own class; at most n * n rows reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WHITE, nul_is_word=True)
            a, ca, b, cb, certain = _pairs(words, *shared.value[0].find(words), *shared.value)
            total += np.bincount((-1 - ca[certain]) * n - 1 - cb[certain], minlength=n * n)
            open_ = np.flatnonzero(~certain)
            for at in range(0, len(open_), 50_000):
                i = open_[at:at + 50_000]
                yield pa.record_batch({"a": pa.array(a[i]), "ca": pa.array(ca[i]), "b": pa.array(b[i]), "cb": pa.array(cb[i]), "n": pa.array(np.ones(len(i), np.int64))})
        found = np.flatnonzero(total)
        none = pa.array(np.zeros(len(found), np.int64))
        yield pa.record_batch({"a": none, "ca": pa.array(-1 - found // n), "b": none, "cb": pa.array(-1 - found % n), "n": pa.array(total[found])})

    pairs = materialize(docs.select("text").mapInArrow(run, "a bigint, ca bigint, b bigint, cb bigint, n bigint"), "class-pairs")
    certain = (F.col("ca") < 0) & (F.col("cb") < 0)
    direct = pairs.where(certain).select((-1 - F.col("ca")).cast("int").alias("ca"), (-1 - F.col("cb")).cast("int").alias("cb"), "n")
    rows = direct.unionByName(_resolved(pairs.where(~certain), words).select("ca", "cb", "n")).groupBy("ca", "cb").agg(F.sum("n").alias("n")).toArrow()
    discard(pairs)
    table = np.zeros((n, n))
    ca, cb, count = (rows.column(c).to_numpy() for c in ("ca", "cb", "n"))
    table[ca, cb] = count
    return table


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: DataFrame  # word, tail, n, class
    classes: np.ndarray  # of types
    transition: np.ndarray  # log10 P(class | class)
    spread: np.ndarray  # log10 of each class's emission denominator
    n_tokens: int
    n_words: int
    n_docs: int


def train(docs: DataFrame, head: int = HEAD, n_classes: int = CLASSES, rounds: int = ROUNDS, direct: int = DIRECT) -> Model:
    """The model of the column text; a null text is an empty one, which still has its end token."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = materialize(docs.mapInArrow(_count_words, "word bigint, tail bigint, n bigint")
                         .groupBy("word", "tail").agg(F.sum("n").alias("n")), "word-counts")
    n_docs = docs.count()
    vocabulary = _vocabulary(counts, head, direct)
    bigrams = materialize(_bigrams(docs, vocabulary), "bigrams")
    classes, table = exchange(bigrams, 1 + TAIL + vocabulary.size, n_classes, rounds)
    discard(bigrams)
    placed = place_words(_contexts(docs, vocabulary, classes, len(table)), classes, table)
    top = np.flatnonzero(vocabulary.kinds >= 0)
    of_head = spark.createDataFrame([(int(vocabulary.words[i]), c, c) for i in top for c in [int(classes[1 + TAIL + vocabulary.kinds[i]])]],
                                    "word bigint, class int, was int")
    words = found = materialize(counts.join(placed.unionByName(of_head), "word"), "word-classes")
    discard(counts)
    vocabulary = _with_classes(vocabulary, words, direct)
    new_table = _classed_table(docs, vocabulary, words, classes, len(table))
    if likelihood(new_table) > likelihood(table):
        table = new_table
    else:
        words = found.withColumn("class", F.col("was"))
        vocabulary = _with_classes(vocabulary, words, direct)
    words = words.drop("was")
    by_class = words.groupBy("class").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()
    per_class = np.zeros(len(table))
    for row in by_class:
        per_class[row["class"]] = row["words"]
    per_class[0] += 1
    total = table.sum(0)
    share = (total + 1) / (total.sum() + len(total))
    transition = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    spread = np.log10(total + ADD * (per_class + 1))
    return Model(vocabulary, words, classes, transition, spread, sum(r["n"] for r in by_class) + n_docs,
                 sum(r["words"] for r in by_class) + (n_docs > 0), n_docs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` but text and any named like the results, with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the words and one end token; score is the model's log10 probability of the
    text, perplexity 10 ** (-score / n_tokens). Null and empty texts hold the end token alone. Each row is scored by itself,
    repeated rows too. With nothing learned, every count is 0. Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    names = [c for c in docs.columns if c not in ("text", *made)]
    own = "_"
    while any(c.startswith(own) for c in names):
        own += "_"
    row_, known_, logs_, steps_, pairs_ = (own + c for c in ("row", "known", "logs", "steps", "pairs"))
    rows = docs.select(*names, F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias(row_))
    steps = model.transition - model.spread[None, :]
    shared = spark.sparkContext.broadcast((model.vocabulary, model.classes, steps, np.log10(model.n_docs + ADD), model.n_docs))
    lists = [f"{pairs_}_{c}" for c in ("a", "ca", "b", "cb")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, classes, steps, log_end, n_docs = shared.value
        log_count = np.log10(vocabulary.counts + ADD)
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), WHITE, nul_is_word=True)
            at, known = vocabulary.find(words)
            a, ca, b, cb, certain = _pairs(words, at, known, vocabulary, classes)
            row = np.repeat(np.arange(len(batch)), np.diff(words.first) + 1)
            step = np.zeros(len(row))
            step[certain] = steps[-1 - ca[certain], -1 - cb[certain]]
            direct = np.zeros(len(words))
            if len(vocabulary.words):
                direct[known] = log_count[at[known]]
            per_row = lambda x, first=words.first: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
            open_ = np.flatnonzero(~certain)
            offsets = np.searchsorted(row[open_], np.arange(len(batch) + 1)).astype(np.int32)
            rest = lambda values, open_=open_, offsets=offsets: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[open_]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], batch.column(row_), pa.array(np.diff(words.first) + 1, pa.int64()),
                 pa.array(per_row(known) + (n_docs > 0), pa.int64()), pa.array(per_row(direct) + log_end), pa.array(np.bincount(row, step, len(batch))),
                 rest(a), rest(ca), rest(b), rest(cb)],
                [*names, row_, "n_tokens", known_, logs_, steps_, *lists])

    from pyspark.sql import types as T

    kept = [f for f in rows.schema.fields if f.name in names or f.name == row_]
    long, double = T.LongType(), T.DoubleType()
    schema = T.StructType([*kept, T.StructField("n_tokens", long), T.StructField(known_, long), T.StructField(logs_, double),
                           T.StructField(steps_, double), *[T.StructField(c, T.ArrayType(long)) for c in lists]])
    part = materialize(rows.mapInArrow(run, schema), "scored")
    rare = part.select(F.col(row_).alias("row"), F.explode(F.arrays_zip(*lists)).alias("p")).select(
        "row", *[F.col("p")[c].alias(c.removeprefix(f"{pairs_}_")) for c in lists])
    size = len(steps)
    by_pair = spark.createDataFrame([(i, j, float(steps[i, j])) for i in range(size) for j in range(size)], "ca int, cb int, step double")
    found = (_resolved(rare, model.counts).join(F.broadcast(by_pair), ["ca", "cb"]).groupBy(F.col("row").alias(row_))
             .agg(F.coalesce(F.sum(F.log10(F.col("n_b") + ADD)), F.lit(0.0)).alias(own + "more"), F.sum("step").alias(own + "more_steps"),
                  F.count_if(F.col("n_b") > 0).alias(own + "more_known")))
    logs = F.col(logs_) + F.coalesce(own + "more", F.lit(0.0))
    denominator = float(np.log10(model.n_tokens + ADD * (model.n_words + 1)))
    out = part.drop(*lists).join(found, row_, "left").withColumns({
        "n_known": F.col(known_) + F.coalesce(own + "more_known", F.lit(0)), "train_tokens": F.lit(int(model.n_tokens)).cast("bigint"),
        "base_score": logs - F.col("n_tokens") * denominator, "score": logs + F.col(steps_) + F.coalesce(own + "more_steps", F.lit(0.0))})
    return out.select(*names, "n_tokens", "n_known", "train_tokens", "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, held_out: whether crc32 of the id as text is a multiple of 10."""
    return docs.select(F.col(id_col).alias("doc_id"), "text", (crc_bucket(F.col(id_col), 10) == 0).alias("held_out"))
