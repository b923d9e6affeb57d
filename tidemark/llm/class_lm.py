"""LM scoring with Brown classes: exchange clustering, class transitions and word emissions.

Tokens are a text's words (A-Z lower-cased, parted by ASCII white space) and one end. The model gives a token w after a token v

    P(w | v) = P(class(w) | class(v)) * P(w | class(w)),

and the start of a text counts as after an end.

*Classes.* Every word of the training texts is put into its class by exchange: the class where its own neighbours make the class
bigrams' likelihood greatest.

1. The end and the ``SEED`` most frequent words are clustered first, on the driver (their bigrams are a table of 1024 x 1024),
   until a sweep gains less than ``SETTLED`` of the likelihood. The end keeps a class of its own.
2. Sweeps over the ``HEAD`` most frequent words, from their bigrams with all words that have a class: tasks sum up how often each
   word stands after and before each class (HEAD x CLASSES numbers, whatever the data), and propose moves by the exact gain.
   The first sweep puts all words in. In each further one, every second word may move, so that neighbours don't move at once.
   Sweeps go on as long as each raises the likelihood by ``SETTLED`` of it; the best clustering found is kept.
3. All other words of the vocabulary are put in once, each by its own neighbours of the head, where they gain most (ties: the
   lowest class). This is one shuffle by word.

Only a word that training has not seen has no neighbours to go by: it gets the class that most words seen once with its ending
(a hash of the last three bytes) have.

*Transitions* are class bigram counts over all training tokens, interpolated with class frequencies. *Emissions* are a word's share
of its class, less a mass for unseen words: the share of tokens in the class that are words seen once.

*Plan.* One Arrow pass counts words; a second encodes all texts, as ranks of head words and hashes of others, in compressed
parts of some MB. All that follows reads these: no text is parted again. Counts and classes of head words (``HEAD`` at most) go to
all tasks and are never shuffled, so no word of the training texts is a hot key. A text's other words are joined with their
counts and classes by hash; Spark splits that join where a word that only other texts have is frequent. What is gathered from
the corpus grows with it; what the driver holds does not.

Cases: null texts count as empty, which have one token, the end; a null id's fold is that of the text ''; repeated rows are
trained on and scored each; a very long text is a part of its own; with no training text every word is unknown; other columns
are not looked at; an empty table gives an empty table. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, remainder, table

FOLDS, HELD_OUT = 7, 2
HEAD = 1 << 17
SEED = 1024
CLASSES = 48
SETTLED = 0.002
ENDINGS = 256
BLOCK = 2048  # head words whose tables are summed up in one place
PART_BYTES = 8_000_000
FLUSH = 1_500_000


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as xx

    return np.array([xx(w, 42) for w in words], np.uint64).view(np.int64)


END = -(1 << 63)  # stands for the end among hashes


def _endings(words: list[bytes]) -> np.ndarray:
    from zlib import crc32

    return np.array([crc32(w[-3:]) % ENDINGS for w in words], np.int16)


def _parts(batches: Iterator) -> Iterator:
    """Slices of the batches with some MB of text each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART_BYTES, side="right")))
            yield pa.record_batch(batch.slice(at, to - at))
            at = to


def _tokens(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:  # noqa: ANN001
    """Distinct words, each text's words as numbers of distinct ones in one flat array, and how many each text has."""
    import pyarrow as pa

    lists = [(t or "").encode().lower().split() for t in texts.to_pylist()]  # bytes: A-Z only, ASCII white space only
    flat = pa.array(list(chain.from_iterable(lists)), pa.large_binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.dictionary.to_pylist(), codes, np.fromiter(map(len, lists), np.int64, len(lists))


def _with_ends(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with ends put in, the token before each (an end before the first), and where each text begins."""
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    tokens = np.full(int(sizes.sum() + len(sizes)), end, np.int64)
    inside = np.ones(len(tokens), bool)
    inside[starts + sizes] = False
    tokens[inside] = codes
    return tokens, np.concatenate([[end], tokens[:-1]]), starts


def _count_batches(batches: Iterator) -> Iterator:
    """(word hash, ending, tokens) summed within the task."""
    import pyarrow as pa

    held: list[tuple[np.ndarray, ...]] = []

    def summed() -> pa.RecordBatch:
        h, e, n = (np.concatenate([x[i] for x in held]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h, e, n = h[order], e[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(e[first]), pa.array(np.add.reduceat(n, first))], ["h", "e", "n"])

    for part in _parts(batches):
        words, codes, sizes = _tokens(part.column(0))
        n = np.bincount(codes, minlength=len(words)) if words else np.zeros(0, np.int64)
        some = n > 0
        held.append((_hashes(words)[some], _endings(words)[some], n[some].astype(np.int64)))
        held.append((np.array([END]), np.array([0], np.int16), np.array([len(sizes)], np.int64)))
        if sum(len(x[0]) for x in held) > FLUSH:
            yield summed()
    if held:
        yield summed()


@dataclass(frozen=True)
class Head:
    """The frequent words: hashes in order with ranks; counts by rank. Rank 0 is the end, which has no hash here."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each hash; ``size`` for what is not of the head."""
        if not len(self.hashes):
            return np.full(len(h), self.size, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], self.size).astype(np.int32)


def _pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(a.astype("<u4").reshape(-1, 1).view(np.uint8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


PARTS = "ids array<bigint>, train array<boolean>, n int, ranks binary, hashes binary, endings binary"


def _encode_batches(head: Head):  # noqa: ANN202
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _parts(batches):
            words, codes, sizes = _tokens(part.column(2))
            h = _hashes(words)
            tokens, _, _ = _with_ends(codes, sizes, len(words))
            ranks = np.append(head.find(h), 0).astype(np.int64)[tokens]
            tail = tokens[ranks == head.size]
            lists = [pa.array([part.column(i).to_pylist()], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.bool_())))]
            blobs = [_pack(ranks), h[tail].astype("<i8").tobytes(), _endings(words)[tail].astype(np.uint8).tobytes() if len(words) else b""]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([len(ranks)], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]], ["ids", "train", "n", "ranks", "hashes", "endings"])

    return run


@dataclass(frozen=True)
class Part:
    """Texts one after the other, each with its end: tokens by rank, and hashes and endings of the tokens that are not of the head."""

    ids: list
    train: np.ndarray
    ranks: np.ndarray
    hashes: np.ndarray
    endings: np.ndarray

    def trained(self, head_size: int) -> Part:
        """The training texts alone."""
        of = np.repeat(self.train, np.diff(np.concatenate([[-1], np.flatnonzero(self.ranks == 0)])))
        rare = of[self.ranks == head_size]
        return Part([], self.train[self.train], self.ranks[of], self.hashes[rare], self.endings[rare])


def _read(batches: Iterator) -> Iterator[Part]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, train, n, ranks, hashes, endings = (batch.column(k)[i].as_py() for k in range(6))
            yield Part(ids, np.array(train, bool), _unpack(ranks, n).astype(np.int64), np.frombuffer(hashes, "<i8"), np.frombuffer(endings, np.uint8))


def _shift(x: np.ndarray, first: int) -> np.ndarray:
    """What stands before each."""
    return np.concatenate([[first], x[:-1]])


def _cell_rows(grid: np.ndarray) -> Iterator:
    import pyarrow as pa

    (cell,) = np.nonzero(grid)
    for at in range(0, len(cell), 100_000):
        some = cell[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(grid[some].astype(np.int64))], ["cell", "n"])


def _grid(rows: DataFrame, size: int) -> np.ndarray:
    """The size x size table of summed cells, a bounded number."""
    cells = rows.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(size * size)
    grid[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return grid.reshape(size, size)


def _seed_batches(seed: int, head_size: int):  # noqa: ANN202
    def run(batches: Iterator) -> Iterator:
        grid = np.zeros(seed * seed, np.int64)
        for part in _read(batches):
            x = part.trained(head_size).ranks
            both = (x < seed) & ((before := _shift(x, 0)) < seed)
            grid += np.bincount(before[both] * seed + x[both], minlength=seed * seed)
        yield from _cell_rows(grid)

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """Log likelihood of the class bigrams, and of the classes' words but for a constant."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum())


def gains(left: np.ndarray, right: np.ndarray, same: np.ndarray, own: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """words x classes: how much each word adds to the likelihood in each class, but for what it adds in any.

    left and right: how often each word stands after and before each class; same: after itself; own: its class, whose counts in the
    grid of class bigrams hold the word, or -1. The end's class 0 takes no word.
    """
    at, has, k = np.arange(len(own)), own >= 0, len(grid)
    l, r, s = left.astype(float), right.astype(float), same.astype(float)  # noqa: E741
    l[at[has], own[has]] -= s[has]
    r[at[has], own[has]] -= s[has]
    out = np.zeros((len(own), k))
    for mine, other, cells in ((r, l, grid), (l, r, grid.T)):
        w, c = np.nonzero(mine)
        if not len(w):
            continue
        m = mine[w, c]
        cell = cells.T[c].copy()  # of each neighbour class, with each class that the word may get
        e = np.flatnonzero(has[w])
        cell[e, own[w[e]]] -= m[e]
        e = e[c[e] == own[w[e]]]
        cell[e] -= other[w[e]]
        got = _xlogx(cell + m[:, None]) - _xlogx(cell)
        got[np.arange(len(w)), c] = 0  # the class with itself: below
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        out[w[first]] += np.add.reduceat(got, first)
    mine = l + r + s[:, None]
    cell = np.repeat(np.diag(grid)[None], len(own), axis=0)
    cell[at[has], own[has]] -= mine[at[has], own[has]]
    out += _xlogx(cell + mine) - _xlogx(cell)
    for total, margin, around in ((r.sum(axis=1) + s, grid.sum(axis=1), l), (l.sum(axis=1) + s, grid.sum(axis=0), r)):
        cell = margin[None] + np.where(has[:, None], 0, around)  # neighbours count as such wherever the word goes
        cell[at[has], own[has]] -= total[has]
        out -= _xlogx(cell + total[:, None]) - _xlogx(cell)
    out[:, 0] = -np.inf
    return out


def exchange(n: np.ndarray, classes: int = CLASSES, settled: float = SETTLED) -> np.ndarray:
    """Class of each item from the matrix of item bigrams n[before, after], one move at a time, until a sweep raises the likelihood by
    less than ``settled`` of it. Item 0 stays alone in class 0."""
    size = n.sum(axis=0) + n.sum(axis=1)
    order = [int(i) for i in np.argsort(-size, kind="stable") if i and size[i] > 0]
    cls = np.zeros(len(n), np.int64)
    cls[1:] = 1 + np.arange(len(n) - 1) % (classes - 1)
    for k, i in enumerate(order):
        cls[i] = 1 + k % (classes - 1)
    n = n.astype(float)
    one = np.eye(classes)[cls]
    right, left = n @ one, n.T @ one
    grid = one.T @ right
    now, before = likelihood(grid), -np.inf
    while now > before + settled * abs(now):
        for i in order:
            a = int(cls[i])
            got = gains(left[i : i + 1], right[i : i + 1], n[i, i : i + 1], cls[i : i + 1], grid)[0]
            b = int(got.argmax())
            if b == a or got[b] <= got[a] + 1e-9 * (1 + abs(got[a])):
                continue
            grid[a] -= right[i]
            grid[:, a] -= left[i]
            grid[a, a] += n[i, i]
            cls[i] = b
            right[:, a] -= n[:, i]
            right[:, b] += n[:, i]
            left[:, a] -= n[i]
            left[:, b] += n[i]
            grid[b] += right[i]
            grid[:, b] += left[i]
            grid[b, b] -= n[i, i]
        now, before = likelihood(grid), now
    return cls


CONTEXTS = "block int, cell int, n bigint, l binary, r binary, s binary"
NAMES = ["block", "cell", "n", "l", "r", "s"]


def _context_batches(cls: np.ndarray):  # noqa: ANN202
    """From parts: for each block of head words their counts with classes, and the cells of the class bigrams (block -1)."""
    size = len(cls)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        left, right, same = np.zeros(size * CLASSES, np.int32), np.zeros(size * CLASSES, np.int32), np.zeros(size, np.int32)
        grid, known, any_ = np.zeros(CLASSES * CLASSES, np.int64), np.append(cls, -1).astype(np.int64), False
        for part in _read(batches):
            x = part.trained(size).ranks
            before, any_ = _shift(x, 0), any_ or len(x) > 0
            c0, c1 = known[before], known[x]
            some = (x < size) & (c0 >= 0)
            np.add.at(left, x[some] * CLASSES + c0[some], 1)
            some = (before < size) & (c1 >= 0)
            np.add.at(right, before[some] * CLASSES + c1[some], 1)
            np.add.at(same, x[(x == before) & (x < size)], 1)
            both = (c0 >= 0) & (c1 >= 0)
            grid += np.bincount(c0[both] * CLASSES + c1[both], minlength=CLASSES * CLASSES)
        if not any_:
            return
        for at in range(0, size, BLOCK):
            wide = slice(at * CLASSES, (at + BLOCK) * CLASSES)
            blobs = [pa.array([_pack(x)], pa.binary()) for x in (left[wide], right[wide], same[at : at + BLOCK])]
            yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), *blobs], NAMES)
        for rows in _cell_rows(grid):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, -1, np.int32)), rows.column(0), rows.column(1), *[pa.nulls(rows.num_rows, pa.binary())] * 3], NAMES)

    return run


def _move_batches(cls: np.ndarray, grid: np.ndarray, turn: int):  # noqa: ANN202
    """From summed-up rows of blocks: rank and class of each head word that moves."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column(0)[i].as_py()
                n = min(BLOCK, len(cls) - block * BLOCK)
                got = [_unpack(batch.column(k)[i].as_py(), n * width).astype(np.int64) for k, width in ((3, CLASSES), (4, CLASSES), (5, 1))]
                held[block] = [a + b for a, b in zip(held[block], got, strict=True)] if block in held else got
        for block, (left, right, same) in held.items():
            ranks = np.arange(block * BLOCK, block * BLOCK + len(same))
            own = cls[ranks]
            some = np.flatnonzero((ranks > 0) & ((own < 0) | ((ranks + turn) % 2 == 0)))
            for at in range(0, len(some), 512):
                k = some[at : at + 512]
                got = gains(left.reshape(-1, CLASSES)[k], right.reshape(-1, CLASSES)[k], same[k], own[k], grid)
                best, i = got.argmax(axis=1), np.arange(len(k))
                now = np.where(own[k] >= 0, got[i, own[k]], -np.inf)
                move = got[i, best] > now + 1e-9 * (1 + np.abs(np.where(np.isfinite(now), now, 0)))
                yield pa.RecordBatch.from_arrays([pa.array(ranks[k[move]].astype(np.int32)), pa.array(best[move].astype(np.int16))], ["rank", "cls"])

    return run


def cluster(parts: DataFrame, head_size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Class of each head word by rank, the class bigrams of head words, and how many sweeps were made."""
    some = parts.coalesce(2 * parts.sparkSession.sparkContext.defaultParallelism)  # each task sends its table
    seed = min(SEED, head_size)
    cls = np.full(head_size, -1)
    cls[:seed] = exchange(_grid(some.mapInArrow(_seed_batches(seed, head_size), "cell int, n bigint"), seed))
    best, turn = None, 0
    while True:
        sums = cut(some.mapInArrow(_context_batches(cls), CONTEXTS))
        grid = _grid(sums.where("block < 0"), CLASSES)
        if (cls >= 0).all():
            now = likelihood(grid)
            settled = best is not None and now <= best[0] + SETTLED * abs(best[0])
            if best is None or now > best[0]:
                best = now, cls, grid
            if settled:
                return best[1], best[2], turn
        moves = sums.where("block >= 0").repartition("block").mapInArrow(_move_batches(cls, grid, turn), "rank int, cls smallint").toArrow()  # HEAD rows at most
        cls = cls.copy()
        cls[moves["rank"].to_numpy()] = moves["cls"].to_numpy()
        turn += 1


def _tail_batches(cls: np.ndarray):  # noqa: ANN202
    """Training tokens that are not of the head, with the classes before and after (-1: not of the head either)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = np.append(cls, -1).astype(np.int16)
        for part in _read(batches):
            part = part.trained(len(cls))
            at = np.flatnonzero(part.ranks == len(cls))
            columns = part.hashes, known[_shift(part.ranks, 0)[at]], known[part.ranks[at + 1]], part.endings.astype(np.int16)  # an end follows
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "l", "r", "e"])

    return run


def _insert_batches(grid: np.ndarray):  # noqa: ANN202
    """From rows (h, l, r, n, e) in order of h: each word's count, class and ending, and at last the cells of its bigrams."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells, held = np.zeros(CLASSES * CLASSES, np.int64), None
        names = ["h", "n", "cls", "e", "cell", "m"]

        def placed(h: np.ndarray, l: np.ndarray, r: np.ndarray, n: np.ndarray, e: np.ndarray) -> pa.RecordBatch:  # noqa: E741
            fresh = np.concatenate([[True], h[1:] != h[:-1]])
            first, w = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            left, right = np.zeros((2, len(first), CLASSES), np.int64)
            np.add.at(left, (w[l >= 0], l[l >= 0]), n[l >= 0])
            np.add.at(right, (w[r >= 0], r[r >= 0]), n[r >= 0])
            cls = gains(left, right, np.zeros(len(first), np.int64), np.full(len(first), -1), grid).argmax(axis=1)
            np.add.at(cells, l[l >= 0] * CLASSES + cls[w[l >= 0]], n[l >= 0])
            np.add.at(cells, cls[w[r >= 0]] * CLASSES + r[r >= 0], n[r >= 0])
            made = pa.array(h[first]), pa.array(np.add.reduceat(n, first)), pa.array(cls.astype(np.int16)), pa.array(e[first].astype(np.int16))
            return pa.RecordBatch.from_arrays([*made, pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.int64())], names)

        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last word may go on in the next batch
            held = [x[whole:] for x in rows]
            if whole:
                yield placed(*[x[:whole] for x in rows])
        if held is not None and len(held[0]):
            yield placed(*held)
        for rows in _cell_rows(cells):
            yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int16(), pa.int16())] + rows.columns, names)

    return run


def _pair_batches(head_size: int):  # noqa: ANN202
    """Hashes of neighbours in training texts of which neither is of the head."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in _read(batches):
            part = part.trained(head_size)
            tail = part.ranks == head_size
            number = np.cumsum(tail) - 1
            at = np.flatnonzero(tail[:-1] & tail[1:])
            yield pa.RecordBatch.from_arrays([pa.array(part.hashes[number[at]]), pa.array(part.hashes[number[at + 1]])], ["a", "b"])

    return run


def place_rest(parts: DataFrame, cls: np.ndarray, grid: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(h, n, cls, e) of all training words that are not of the head, and the class bigrams that they take part in."""
    seen = parts.mapInArrow(_tail_batches(cls), "h bigint, l smallint, r smallint, e smallint")
    each = seen.repartition("h").groupBy("h", "l", "r").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e")).select("h", "l", "r", "n", "e").sortWithinPartitions("h")
    made = cut(each.mapInArrow(_insert_batches(grid), "h bigint, n bigint, cls smallint, e smallint, cell int, m bigint"))
    words = made.where("h IS NOT NULL").select("h", "n", "cls", "e")
    with_head = _grid(made.where("h IS NULL").select("cell", F.col("m").alias("n")), CLASSES)
    of = lambda c: words.select(F.col("h").alias(c), F.col("cls").cast("int").alias(f"c{c}"))
    pairs = parts.mapInArrow(_pair_batches(len(cls)), "a bigint, b bigint").join(of("a"), "a").join(of("b"), "b")
    among = _grid(pairs.select((F.col("ca") * CLASSES + F.col("cb")).alias("cell"), F.lit(1).alias("n")), CLASSES)
    return words, with_head + among


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs: the head and its classes by rank, classes by ending for unseen words, log10 transitions, and per class log10 of a
    known word's factor and of an unseen word."""

    head: Head
    classes: np.ndarray
    by_ending: np.ndarray
    step: np.ndarray
    known: np.ndarray
    unseen: np.ndarray
    tokens: int  # N
    types: int  # V
    sweeps: int


def assemble(head: Head, cls: np.ndarray, grid: np.ndarray, once: np.ndarray, tokens: int, types: int, sweeps: int) -> ClassModel:
    """The model from class bigrams and from the number of words seen once by ending and class."""
    freq, single = grid.sum(axis=0), once.sum(axis=0)
    unigram = (freq + 1) / (freq.sum() + CLASSES)
    step = np.log10((grid + CLASSES * unigram) / (grid.sum(axis=1, keepdims=True) + CLASSES))
    unseen = (single + 0.5) / (freq + 1)
    known = np.log10(1 - unseen) - np.log10(np.maximum(freq, 1))
    known[0], unseen[0] = -np.log10(max(freq[0], 1)), 0.5  # no word is in the end's class
    most = int(single[1:].argmax()) + 1
    by_ending = np.where(once.sum(axis=1) > 0, once.argmax(axis=1), most)
    return ClassModel(head, cls, by_ending, step, known, np.log10(unseen), tokens, types, sweeps)


def encode(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Head, np.ndarray, int, int]:
    """All texts as parts, the head and its words' endings by rank, and the number of training tokens and of distinct ones."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), train.alias("train"), F.col(text_col).alias("text"))
    counts = cut(rows.where("train").select("text").mapInArrow(_count_batches, "h bigint, e smallint, n bigint").groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("n")))
    bin_ = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    spectrum = sorted(counts.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect(), reverse=True)  # a thousand rows at most
    tokens, types = sum(r.n for r in spectrum), sum(r.k for r in spectrum)
    least, held = 1 << 30, 0
    for r in spectrum:
        held += r.k
        if held > HEAD - 1:
            break
        least = r.b
    top = counts.where((bin_ >= least) | (F.col("h") == END)).select("h", "n", "e").toArrow()
    h, n, e = (top[c].to_numpy() for c in ("h", "n", "e"))
    ends, words = int(n[h == END].sum()), h != END
    h, n, e = h[words], n[words], e[words]
    order = np.lexsort((h, -n))
    h, n, e = h[order], n[order], e[order]
    by_hash = np.argsort(h)
    head = Head(h[by_hash], by_hash.astype(np.int32) + 1, np.concatenate([[ends], n]).astype(np.int64))
    return cut(rows.mapInArrow(_encode_batches(head), PARTS)), head, np.concatenate([[0], e]).astype(np.int64), tokens, types


def fit(parts: DataFrame, head: Head, head_endings: np.ndarray, tokens: int, types: int) -> tuple[ClassModel, DataFrame]:
    """The model, and the words that are not of its head (h, n, cls, e)."""
    cls, grid, sweeps = cluster(parts, head.size)
    words, more = place_rest(parts, cls, grid)
    once = np.zeros((ENDINGS, CLASSES))
    for r in words.where("n = 1").groupBy("e", "cls").agg(F.count(F.lit(1)).alias("k")).collect():  # ENDINGS x CLASSES at most
        once[r.e, r.cls] = r.k
    single = np.flatnonzero(head.counts[1:] == 1) + 1  # only where the corpus is tiny
    np.add.at(once, (head_endings[single], cls[single]), 1)
    return assemble(head, cls, grid + more, once, tokens, types, sweeps), words


def _score_batches(model: ClassModel):  # noqa: ANN202
    norm, head = math.log10(model.tokens + model.types + 1), model.head
    log_n = np.log10(np.maximum(head.counts, 1))
    emit = np.where(head.counts > 0, log_n + model.known[model.classes], model.unseen[0])  # only the end can have no count
    emit, base_of = np.append(emit, 0.0), np.append(np.log10(head.counts + 1.0), 0.0)
    seen, cls = np.append(head.counts > 0, False), np.append(model.classes, -1).astype(np.int64)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for part in _read(batches):
            x, m = part.ranks, len(part.ids)
            ends = np.flatnonzero(x == 0)
            starts = np.concatenate([[0], ends[:-1] + 1])
            sizes = ends - starts + 1
            c0, c1 = cls[_shift(x, 0)], cls[x]
            total = np.add.reduceat(emit[x] + np.where((c0 >= 0) & (c1 >= 0), model.step[c0, c1], 0.0), starts)
            base = np.add.reduceat(base_of[x], starts) - sizes * norm
            known = np.add.reduceat(seen[x].astype(np.int64), starts)
            ids = row + np.arange(m, dtype=np.int64)
            row += m
            at = np.flatnonzero(x == head.size)
            none = lambda k, t: pa.nulls(k, t)
            # keys of texts are spread like words, so they travel with them
            keys = ids * np.int64(-7046029254386353131)
            rare = np.concatenate([keys, part.hashes]), np.concatenate([ids, ids[np.searchsorted(ends, at)]]), np.concatenate([np.full(m, -1), at]).astype(np.int32)
            around = [pa.concat_arrays([none(m, pa.int16()), pa.array(c.astype(np.int16))]) for c in (c0[at], c1[at + 1], model.by_ending[part.endings])]  # an end follows
            of_text = [pa.array(part.ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(total)]
            columns = [*[pa.array(c) for c in rare], *around, *[pa.concat_arrays([c, none(len(at), c.type)]) for c in of_text]]
            yield pa.RecordBatch.from_arrays(columns, ["h", "row", "pos", "l", "r", "e", "doc_id", "n_tokens", "n_known", "base", "total"])

    return run


def _table(x: np.ndarray, at: Column) -> Column:
    """x[at] for a number at."""
    return F.get(F.expr(f"array({', '.join(f'{float(v)!r}D' for v in x.ravel())})"), at)


def score(parts: DataFrame, model: ClassModel, words: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each text of the parts (log10 probabilities of whole texts)."""
    schema = "h bigint, row bigint, pos int, l smallint, r smallint, e smallint, doc_id bigint, n_tokens bigint, n_known bigint, base double, total double"
    met = parts.mapInArrow(_score_batches(model), schema).join(cut(words.select("h", F.col("n").alias("c"), "cls")), "h", "left")
    l, r, text = F.col("l").cast("int"), F.col("r").cast("int"), F.col("n_tokens").isNotNull()  # noqa: E741
    met = met.withColumn("k", F.coalesce("cls", "e").cast("int"))
    k = F.col("k")
    emit = F.when(F.col("c").isNotNull(), F.log10("c") + _table(model.known, k)).otherwise(_table(model.unseen, k))
    steps = F.when(l >= 0, _table(model.step, l * CLASSES + k)).otherwise(0.0) + F.when(r >= 0, _table(model.step, k * CLASSES + r)).otherwise(0.0)
    met = met.select(
        "row",
        "doc_id",
        "n_tokens",
        F.when(text, F.col("n_known")).otherwise(F.col("c").isNotNull().cast("bigint")).alias("n_known"),
        F.when(text, F.col("base")).otherwise(F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        F.when(text, F.col("total")).otherwise(emit + steps).alias("total"),
        # neighbours that are both not of the head meet by the place of the first
        F.explode(F.filter(F.array(F.lit(-1), F.when(r < 0, F.col("pos")), F.when(l < 0, F.col("pos") - 1)), lambda p: p.isNotNull())).alias("p"),
        F.when(text, -1).otherwise(F.col("pos")).alias("pos"),
        "k",
    )
    own = F.col("p") == -1
    once = lambda c: F.sum(F.when(own, F.col(c)))
    by_place = met.groupBy("row", "p").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        once("n_known").alias("n_known"),
        once("base").alias("base"),
        once("total").alias("total"),
        F.max(F.when(~own & (F.col("p") == F.col("pos")), F.col("k"))).alias("k0"),
        F.max(F.when(~own & (F.col("p") != F.col("pos")), F.col("k"))).alias("k1"),
    )
    total = F.when(own, F.col("total")).otherwise(_table(model.step, F.col("k0") * CLASSES + F.col("k1")))
    out = by_place.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum(total).alias("score"))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, *learned = encode(table(spark, sf_dir, "documents"), remainder("doc_id", FOLDS) != HELD_OUT)
    return score(parts, *fit(parts, *learned)).withColumn("held_out", remainder("doc_id", FOLDS) == HELD_OUT)


QUERIES = {"op7_class_lm": op7_class_lm}
#: A clustered model is not for SQL: tests/llm compares with a brute-force version and checks that probabilities add up.
ORACLES: dict[str, str] = {}
