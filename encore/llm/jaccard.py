"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles (A-Z lower-cased; words are runs without ASCII
white space; a shorter text is one shingle). Equal sets are one class from the start. Shingles have
a global order: those in fuller cells of a hashed count over the whole corpus come last, ties by
hash. If two sets link, the first |x| - ceil(0.8 |x|) + l shingles of each share at least l, for any
l; each document takes the l with the least estimated cost (entries it adds to the index plus
candidates that still need verification), and a pair is a candidate if it shares min(l_x, l_y) and
as many more as the overlap that its two sizes ask for leaves to the prefixes (see `_need`).

Every set also has a sketch: a bit for each of a power of two of cells, about two to four times as
many as the set has shingles, 4096 at most; it is set if the cell holds an odd number of them. Half
a sketch laid over the other half is the sketch of half the cells, so sets of neighbouring sizes are
compared by the smaller number. Two sketches differ in at most as many bits as the sets have
shingles apart, so a pair of a list whose sketches differ in more than its sizes allow is no link
and is not put out.

Lists of the same classes are one list that counts as many times, so the many prefix shingles that
copies of a long text share are met once.

Groups of near copies would still make all pairs, so the join asks for links only where they matter.
First every document of a list meets the leaders of that list, then its nearest neighbour from
another component, and last every pair from two different components that shares enough of its
prefixes is verified. A pair inside one component needs no further link, so no component is lost
and no partner capped. Long lists go in blocks (`_cells`): what is in the list's largest component
meets only what is outside it.

Null or empty texts have no set and are linked with nothing. Repeated rows are equal sets. A null id
never names a component but its text does link others. Long texts are read whole, piece by piece. An
empty table gives an empty result. Of the input only the text and the id are read; the result has
three columns of its own, so other columns cannot clash (`keep_one` gives the input's columns)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.llm.common import released, slices, sum_slices
from encore.staging import drop_staged, free_shuffles, stage

WORDS = 5
PERCENT = 80
CELLS = 1 << 20
#: Bits of a sketch at least and at most, and of the one that pairs of sets over LARGE shingles are
#: compared by before the sets themselves are.
LEAST, SKETCH, WIDE = 256, 4096, 8192
LARGE = 512
#: Pairs (16 MB of ends) up to which the ends are sent to all tasks.
FEW = 1_000_000
MOST_MATCHES = 12
PIECE = 1 << 19
#: Lists of more entries than this are dealt out in blocks.
BLOCK = 4096
#: Turns in which each document asks for its nearest neighbour alone.
NEAREST = 2
_K = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[ \t-\r]")
_IN_WORD = bytes(c not in b" \t\n\x0b\x0c\r" for c in range(256))
#: An odd number whose powers weigh the places of a word.
_R = 0x2545F4914F6CDD1B
_R_INVERSE = pow(_R, -1, 2**64)
_POWERS, _INVERSE = (np.multiply.accumulate(np.full(2 * PIECE, x, np.uint64)) for x in (_R, _R_INVERSE))


def _hash_piece(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word and where it starts. The number sums the word's bytes plus one, each
    times a power of `_R` by its place in the word: sums over the whole text, the powers of the
    word's start divided out."""
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + text.translate(_IN_WORD) + b"\0", np.int8)))
    start, end = edges[0::2], edges[1::2]
    if len(raw) > len(_POWERS):  # one word of this length
        powers, inverse = (np.multiply.accumulate(np.full(len(raw), x, np.uint64)) for x in (_R, _R_INVERSE))
    else:
        powers, inverse = _POWERS, _INVERSE
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * powers[: len(raw)], out=upto[1:])
    found = (upto[end] - upto[start]) * inverse[start]
    return (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93), start


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, in order; long texts go piece by piece."""
    text, found, at = text.lower(), [], 0
    while at < len(text):
        cut = _BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        found.append(_hash_piece(text[at:end])[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, words: int) -> np.ndarray:
    """A number for each run of `words` word hashes."""
    n = len(h) - words + 1
    out = np.full(max(n, 0), np.uint64(words))
    for k in range(words if n > 0 else 0):
        out = out * _K + h[k : k + n]
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def shingle_table(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sets of several texts, one behind the other, each as sorted 64-bit hashes; their sizes."""
    if len(texts) == 1:
        h = word_hashes(texts[0] or b"")
        owner = np.zeros(len(h), np.int64)
    else:
        h, start = _hash_piece(b"\n".join(t or b"" for t in texts).lower())
        first = np.cumsum([0] + [len(t or b"") + 1 for t in texts[:-1]])
        owner = np.searchsorted(first, start, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    out = _rolled(h, words)
    whole = owner[: len(out)] == owner[words - 1 :]
    out, owner = out[whole], owner[: len(out)][whole]
    ends = np.cumsum(count)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        out = np.concatenate([out, *(_rolled(h[ends[d] - count[d] : ends[d]], count[d]) for d in short)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
    for at, end in zip([0, *ends], ends):
        out[at:end].sort()
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[first], np.bincount(owner[first], minlength=len(texts))


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """The texts in groups of about `PIECE` bytes and at most 1000, a longer text alone: (first, past
    the last, texts)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        stop = max(at + 1, min(at + 1000, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right"))))
        yield at, stop, column.slice(at, stop - at).to_pylist()
        at = stop


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return tuple(x - (x >> 63 << 64) for x in (h >> 64, h & (2**64 - 1)))


def _sets_of(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    tokens, sizes = shingle_table(texts)
    ends = np.cumsum(sizes).tolist()
    for at, end in zip([0, *ends], ends):
        yield tokens[at:end]


def sketch_bits(n: np.ndarray | int) -> np.ndarray:
    """How many bits the sketch of a set of n shingles has."""
    return np.clip(1 << np.ceil(np.log2(2 * np.maximum(n, 1))).astype(np.int64), LEAST, SKETCH)


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The sketches of several sets. A cell's number is that of the largest sketch, its upper bits
    left out, so that halves can be laid over each other."""
    bits = sketch_bits(np.array([len(s) for s in sets], np.int64))
    start = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cell = ((tokens * _K) >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64) & (bits[owner] - 1)
    odd = np.bincount(start[owner] + cell, minlength=int(bits.sum())).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[x // 8 : (x + k) // 8] for x, k in zip(start.tolist(), bits.tolist(), strict=True)]


def wide_sketch(tokens: np.ndarray) -> np.ndarray:
    """The sketch of WIDE bits, in 64-bit numbers."""
    odd = np.bincount(((tokens * _K) >> np.uint64(65 - WIDE.bit_length())).astype(np.int64), minlength=WIDE).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - 20)).astype(np.int64)


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))


def _overview(docs: DataFrame) -> DataFrame:
    """One pass over the texts: rows (doc_id, a, b, n, sketch) and the slices of the count over cells."""
    schema = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("slice", pa.int32()), ("cells", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for at, stop, texts in _chunks(batch.column(1)):
                sets = list(_sets_of(texts))
                keys = [class_of(s) if len(s) else (None, None) for s in sets]
                marks = sketches(sets)
                for key, s in zip(keys, sets, strict=True):
                    if len(s) and key not in seen:
                        seen.add(key)
                        np.add.at(total, _cell(s), 1)
                arrays = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at).cast(pa.int64()), *arrays], schema=schema)
        if total.any():
            own = slices(total)
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(own), pa.binary()), own.column(0), own.column(1)], schema=schema)

    return docs.mapInArrow(released(scan), "doc_id long, a long, b long, n long, sketch binary, slice int, cells binary")


def _level_of(counts: np.ndarray) -> np.ndarray:
    """How full a cell is beyond what chance makes of the mean: 0 for usual, then by doublings."""
    mean = float(counts.mean()) if len(counts) else 0.0
    over = counts - mean - 5 * math.sqrt(mean + 1)
    return np.where(over <= 0, 0, 1 + np.log2(np.maximum(over, 1)).astype(np.int64)).astype(np.uint8) if len(counts) else np.zeros(CELLS, np.uint8)


_MATCHES = np.arange(1, MOST_MATCHES + 1)


def prefix(tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int]:
    """The document's prefix and its l, by the least estimated cost."""
    n = len(tokens)
    level = levels[_cell(tokens)]
    order = np.argsort(level, kind="stable")  # the tokens are in order
    base = n - -(-PERCENT * n // 100) + 1
    most = min(MOST_MATCHES, n - base + 1)
    ordered = order[: base + most - 1]
    # a list at level k holds about 2^k others: each is an entry met; one in l^2 is left to verify
    others = np.cumsum(np.where(level[ordered] > 0, np.exp2(level[ordered].astype(float)), 0.02))[base - 1 :]
    costs = base + _MATCHES[:most] + others * (1 + n / (base * _MATCHES[:most] ** 2))
    best = int(np.argmin(costs)) + 1
    return tokens[ordered[: base + best - 1]], best


def _parts(level: np.ndarray) -> np.ndarray:
    """In how many parts the list of a shingle goes, by the fill of its cell."""
    return 1 << np.maximum(level.astype(np.int64) - BLOCK.bit_length(), 0)


def _sized(rows: np.ndarray) -> np.ndarray:
    """The entries (tok, part, a, b, nl) of whole lists, without those whose size lets them link to
    no other entry of their list. A list in parts keeps all, as no task sees it whole."""
    edge = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    own, n = np.cumsum(edge), rows[:, 4] >> 8
    order = np.lexsort((n, own))
    own, n = own[order], n[order]
    fits = (own[1:] == own[:-1]) & (n[1:] * PERCENT <= n[:-1] * 100)
    kept = rows[:, 1] > 0
    kept[order[1:][fits]] = True
    kept[order[:-1][fits]] = True
    return rows[kept]


def _lists(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(tok, part, a, b, n, l, w): the lists of prefix shingles that two or more classes share.

    A class that no other class of a list comes near in size is left out of it. Lists of the same
    classes are one, `w` says of how many shingles, and `tok` is made of the classes. The list of a very common shingle goes in parts, so that none is one task's work; it
    stays one by itself. Parts above 0 may hold a single class, which then meets nothing."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, texts in _chunks(batch.column(1)):
                found = []
                for tokens in _sets_of(texts):
                    # below 4 shingles only equal sets reach 0.8, and those are one class
                    if len(tokens) < 4 or (key := class_of(tokens)) in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    own, best = prefix(tokens, levels)
                    found.append((own, key, len(tokens) << 8 | best))
                if found:
                    sizes = [len(p[0]) for p in found]
                    tok = np.concatenate([p[0] for p in found])
                    a, b, nl = (np.repeat(np.array(x, np.int64), sizes) for x in zip(*((p[1][0], p[1][1], p[2]) for p in found), strict=True))
                    parts = _parts(levels[_cell(tok)])
                    part = np.where(parts > 1, 1 + (b & (parts - 1)), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tok.view(np.int64), part, a, b, nl)], ["tok", "part", "a", "b", "nl"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _by_list(batches, marked=False):
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:, :4] != rows[:-1, :4]).any(1)
            rows = _sized(rows[fresh])
            if not len(rows):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
            size = np.diff(np.append(edge, len(rows)))
            x = (rows[:, 2].view(np.uint64) * _K ^ rows[:, 3].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            name = np.add.reduceat(x ^ (x >> np.uint64(29)), edge).view(np.int64)
            name = np.where(rows[edge, 1] > 0, rows[edge, 0], name)
            shared = np.flatnonzero((size > 1) | (rows[edge, 1] > 0))
            one, times = (np.unique(np.stack([name, rows[edge, 1]], 1)[shared], axis=0, return_index=True, return_counts=True)[k] for k in (1, 2))
            if len(one):
                lists = shared[one]
                own = np.concatenate([np.arange(edge[k], edge[k] + size[k]) for k in lists])
                out = [np.repeat(name[lists], size[lists]), rows[own, 1], rows[own, 2], rows[own, 3], rows[own, 4] >> 8, rows[own, 4] & 255, np.repeat(times, size[lists])]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], ["tok", "part", "a", "b", "n", "l", "w"])

    entries = docs.mapInArrow(released(emit), "tok long, part long, a long, b long, nl long")
    dealt = entries.repartition("tok", "part").sortWithinPartitions("tok", "part", "a", "b")
    lists = dealt.mapInArrow(released(runs), "tok long, part long, a long, b long, n long, l long, w long")
    return lists.groupBy("tok", "part", "a", "b").agg(F.min("n").alias("n"), F.min("l").alias("l"), F.sum("w").alias("w"))


def _least_overlap(total: np.ndarray | Column) -> np.ndarray | Column:
    """What two sets of `total` shingles together share at least if they link, rounded up (NumPy)."""
    return -(-total * PERCENT // (100 + PERCENT))


def _near(n: np.ndarray, marks: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits the sketches of rows `x` and `y` stay below what still allows a link; -1 for
    pairs that cannot link by their sizes or sketches."""
    nx, ny = n[x], n[y]
    spare = np.full(len(x), -1, np.int64)
    fits = np.flatnonzero(np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * PERCENT)
    words = sketch_bits(np.minimum(nx, ny)) // 64
    for w in np.unique(words[fits]).tolist():
        at = fits[words[fits] == w]
        differ = marks[x[at], :w] ^ marks[y[at], :w]
        if 64 * w < SKETCH:  # a sketch of twice the cells has its other half there, a smaller one nothing
            differ ^= marks[x[at], w : 2 * w] ^ marks[y[at], w : 2 * w]
        total = (nx + ny)[at]
        spare[at] = np.maximum(-1, total - 2 * _least_overlap(total) - np.bitwise_count(differ).sum(1, dtype=np.int64))
    return spare


def _by_list(batches: Iterator[pa.RecordBatch], most: int | None = None, marked: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole lists (equal in the first two columns) as numbers and, if `marked`, sketches, the last
    column; with `most`, a longer list is cut there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        width = batch.num_columns - marked
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(width)], 1)
        if not len(rows):
            continue
        full = SKETCH // 8
        marks = np.frombuffer(b"".join(x.ljust(full, b"\0") for x in batch.column(width).to_pylist()), np.uint64).reshape(len(rows), full // 8) if marked else rows
        if held and (held[-1][0][-1, :2] != rows[0, :2]).any():
            yield joined()
            held, size = [], 0
        other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append((rows[:cut], marks[:cut]))
            yield joined()
            held, size = [], 0
        held.append((rows[cut:], marks[cut:]))
        size += len(rows) - cut
        if most and size >= most:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _pair_batch(x: np.ndarray, y: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Pairs of nodes, the columns a and b of `x` and of `y`, and other columns."""
    columns = [x[:, 0], x[:, 1], y[:, 0], y[:, 1], *more]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [f"c{k}" for k in range(len(columns))])


def _leaders(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, ha, hb): each entry of a list with the first one before it that its sketch may link to
    among the list's leaders, which are those without such a one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, marks in _by_list(batches, 1 << 14):
            rest = np.arange(len(rows))
            while len(rest) > 1:
                first = np.ones(len(rest), bool)
                first[1:] = (rows[rest[1:], :2] != rows[rest[:-1], :2]).any(1)
                mine, lead = rest[~first], rest[first][np.cumsum(first) - 1][~first]
                near = _near(rows[:, 4], marks, mine, lead) >= 0
                if near.any():
                    yield _pair_batch(rows[mine[near], 2:4], rows[lead[near], 2:4])
                rest = mine[~near]

    dealt = lists.join(nodes.select("a", "b", "sketch"), ["a", "b"]).select("tok", "part", "a", "b", "n", "sketch").repartition("tok", "part").sortWithinPartitions("tok", "part", "a", "b")
    return dealt.mapInArrow(released(go), "a long, b long, ha long, hb long").distinct()


def _cells(lists: DataFrame, labels: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Lists of two or more components, in cells that a task can hold: rows (tok, cell, a, b, n, l,
    ca, cb, one, within, w, sketch).

    What is in a list's largest component goes to p blocks, what is outside it to q blocks, by
    hash. A block of the first kind meets each of the second (rows with `one` meet those without);
    so do two blocks of the second kind; one of the second kind meets itself where `within` is set.
    So a row of the first kind goes to q cells, and lists of usual length are one cell. A whole list
    of two is left out: its pair has met as leader and follower, and is refuted or verified."""
    entries = _placed(lists, labels)
    sizes = entries.groupBy("tok", "ca", "cb").agg(F.count("*").alias("k"), F.max("part").alias("part"))
    top = sizes.groupBy("tok").agg(F.sum("k").alias("all"), F.max(F.struct("k", "ca", "cb")).alias("m"), F.count("*").alias("parts"), F.max("part").alias("part")).filter("parts > 1 and (all > 2 or part > 0)")
    blocks = top.select("tok", F.col("m.ca").alias("da"), F.col("m.cb").alias("db"), F.ceil(F.col("m.k") / BLOCK).alias("p"), F.ceil((F.col("all") - F.col("m.k")) / BLOCK).alias("q"))
    dealt = entries.join(blocks, "tok").withColumns({"one": (F.col("ca") == F.col("da")) & (F.col("cb") == F.col("db")), "o": F.pmod(F.xxhash64("b"), F.col("q"))})
    cell = "named_struct('cell', {}, 'one', {}, 'within', {})"
    mine = f"transform(sequence(0L, q - 1), j -> {cell.format('pmod(xxhash64(b), p) * q + j', 'true', 'false')})"
    other = f"transform(sequence(0L, p - 1), i -> {cell.format('i * q + o', 'false', 'i = 0')})"
    apart = f"transform(filter(sequence(0L, q - 1), j -> j <> o), j -> {cell.format('-1 - (least(o, j) * q + greatest(o, j))', 'o < j', 'false')})"
    split = dealt.select("tok", "a", "b", "n", "l", "ca", "cb", "w", F.explode(F.expr(f"if(one, {mine}, concat({other}, {apart}))")).alias("x"))
    full = split.join(nodes.select("a", "b", "sketch"), ["a", "b"]).select("tok", "x.cell", "a", "b", "n", "l", "ca", "cb", "x.one", "x.within", "w", "sketch")
    return full.repartition("tok", "cell").sortWithinPartitions("tok", "cell", "n", "a", "b")


def _meetings(rows: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell and different components that may link, and their spare bits."""
    n, comp, one, within = rows[:, 4], rows[:, 6:8], rows[:, 8] == 1, rows[:, 9] == 1
    edge = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1), [True]]))
    end = np.repeat(edge[1:], np.diff(edge))

    def left(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        asked = ((one[x] != one[y]) | (within[x] & ~one[x] & ~one[y])) & (comp[x] != comp[y]).any(1)
        x, y = x[asked], y[asked]
        spare = _near(n, marks, x, y)
        return x[spare >= 0], y[spare >= 0], spare[spare >= 0]

    short = np.repeat(np.diff(edge) <= 64, np.diff(edge))
    x, far = np.flatnonzero(short), 1
    while len(x):  # all short lists at once: each row with the one `far` places behind it
        x = x[x + far < end[x]]
        x = x[n[x + far] * PERCENT <= n[x] * 100]
        if len(x):
            yield left(x, x + far)
        far += 1
    for at, stop in zip(edge[:-1], edge[1:]):
        if stop - at <= 64:
            continue
        mine = at + np.flatnonzero(one[at:stop])
        rest = at + np.flatnonzero(~one[at:stop])
        for k, x in enumerate(rest):
            y = np.concatenate([mine, rest[k + 1 :]]) if within[x] else mine
            y = y[(n[y] * 100 >= n[x] * PERCENT) & (n[x] * 100 >= n[y] * PERCENT)]
            if len(y):
                yield left(np.full(len(y), x), y)


def _nearest(cells: DataFrame) -> DataFrame:
    """(tok, a, b, ha, hb, spare): of each row with candidates in a cell, the nearest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, marks in _by_list(batches):
            best, whom = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
            for x, y, spare in _meetings(rows, marks):
                order = np.argsort(spare)
                for own, to in ((x[order], y[order]), (y[order], x[order])):  # the last one set stays
                    better = spare[order] > best[own]
                    best[own[better]], whom[own[better]] = spare[order][better], to[better]
            found = np.flatnonzero(best >= 0)
            if len(found):
                yield _pair_batch(rows[found, 2:4], rows[whom[found], 2:4], rows[found, 0], best[found])

    return cells.mapInArrow(released(go), "a long, b long, ha long, hb long, tok long, spare long")


def _need(n: Column, l: Column, m: Column, o: Column) -> Column:
    """How many prefix shingles two sets of n and m that link must share, their l being l and o.

    They share at least r = ceil(80 (n + m) / 180). The one whose prefix ends first in the order,
    say the first, has n - p shingles behind its prefix of p; the rest of r lies in both prefixes."""
    r = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    behind = lambda k, x: F.ceil(k * PERCENT / 100) - x  # noqa: E731  sets without their prefix
    return F.greatest(F.least(l, o), r - F.greatest(behind(n, l), behind(m, o)))


def _across(cells: DataFrame) -> DataFrame:
    """Every pair of classes from different components that shares enough prefix shingles."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, marks in _by_list(batches):
            for x, y, _ in _meetings(rows, marks):
                if len(x):
                    swap = (rows[y, 2] < rows[x, 2]) | (rows[y, 2] == rows[x, 2]) & (rows[y, 3] < rows[x, 3])
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    yield _pair_batch(rows[x, 2:4], rows[y, 2:4], rows[x, 4], rows[x, 5], rows[y, 4], rows[y, 5], np.maximum(rows[x, 10], rows[y, 10]))

    met = cells.mapInArrow(released(go), "a long, b long, ha long, hb long, n long, l long, m long, o long, w long")
    pair = met.groupBy("a", "b", "ha", "hb").agg(F.sum("w").alias("k"), *(F.min(c).alias(c) for c in "nlmo"))
    return pair.filter(F.col("k") >= _need(*(F.col(c) for c in "nlmo"))).select("a", "b", "ha", "hb")


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    x = ids.view(np.uint64) * _K
    return [((x ^ (x >> np.uint64(31))) * np.uint64(2 * k + 3) >> np.uint64(65 - size.bit_length())).astype(np.int64) for k in range(3)]


def _member_bits(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter over ids, 16 bits for each but 2^27 (16 MB) at most, and its size. Beyond that
    it lets more ids through that are not members, which costs time only."""
    size = 1 << min(max((16 * ids.count()).bit_length(), 16), 27)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _bits(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64), size):
                bits[at] = True
        yield slices(np.packbits(bits))

    return sum_slices(ids.mapInArrow(released(mark), "slice int, cells binary"), "uint8", either=True), size


def _sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, wide, toks) of the classes in `pairs`, and of a few more.

    A class is read from the document of its least id: a filter over those ids keeps all others
    from being cut into shingles again, and from being shuffled."""
    ends = pairs.select("a", "b").union(pairs.select("ha", "hb")).distinct()
    kinds, none = [*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2], np.zeros(0, np.int64)
    bits, size = _member_bits(stage(ends.join(nodes, ["a", "b"]).select("least"), "ends"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0)
            here = np.ones(len(ids), bool)
            if len(bits):
                for at in _bits(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), size):
                    here &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            here |= ids.is_null().to_numpy(zero_copy_only=False)
            for _, _, texts in _chunks(batch.column(1).filter(pa.array(here))):
                rows = []
                for tokens in _sets_of(texts):
                    if len(tokens) < 4 or (key := class_of(tokens)) in seen:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    wide = wide_sketch(tokens) if len(tokens) > LARGE else none
                    rows.append((key[0], key[1], len(tokens), wide, tokens.view(np.int64)))
                columns = [[r[k] for r in rows] for k in range(5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["a", "b", "n", "wide", "toks"])

    return docs.mapInArrow(released(emit), "a long, b long, n long, wide array<long>, toks array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, ha, hb) whose sets link; a set that comes twice gives its pairs twice.

    Large sets are fetched only for pairs that their wide sketches leave; where those pairs are few,
    their ends go to all tasks, so that no other set is shuffled."""

    def met(pairs: DataFrame, *columns: str, few: bool = False) -> DataFrame:
        one = sets.select("a", "b", *columns).withColumnsRenamed({columns[-1]: "x", "n": "nx"})
        two = sets.select("a", "b", *columns).withColumnsRenamed({"a": "ha", "b": "hb", columns[-1]: "y", "n": "ny"})
        if few:
            one = one.join(F.broadcast(pairs.select("a", "b").distinct()), ["a", "b"], "left_semi")
            two = two.join(F.broadcast(pairs.select("ha", "hb").distinct()), ["ha", "hb"], "left_semi")
        return pairs.join(one, ["a", "b"]).join(two, ["ha", "hb"])

    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.coalesce(F.bit_count(p.bitwiseXOR(q)), F.lit(0))), F.lit(0), lambda s, k: s + k)
    total = F.col("nx") + F.col("ny")
    near = met(pairs, "n", "wide").filter(differ <= total - 2 * F.ceil(total * PERCENT / (100 + PERCENT))).select("a", "b", "ha", "hb").distinct()
    near = stage(near, "near")
    free_shuffles(sets.sparkSession)
    both = met(near, "toks", few=near.count() <= FEW)
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("i", shared).filter(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * PERCENT).select("a", "b", "ha", "hb")


def components(edges: DataFrame) -> DataFrame:
    """(u, c) from links (u, v): every end with the least node it is connected to.

    Each round a node takes the least label among its neighbours', the node that is its label takes
    it too, and then each takes the label of its label, until nothing changes. Labels only fall, so
    that it ends is certain. They are a staged table; nothing but a count reaches the driver."""
    both = stage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "links")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "c": "d"}), "v").groupBy("u").agg(F.min("d").alias("d"))
        less = labels.join(near, "u").filter("d < c")
        offers = less.select("u", "d").unionByName(less.select(F.col("c").alias("u"), "d")).groupBy("u").agg(F.min("d").alias("d"))
        step = labels.join(offers, "u", "left").select("u", "c", F.least("c", "d").alias("d"))
        jump = labels.select(F.col("u").alias("d"), F.col("c").alias("e"))
        new = stage(step.join(jump, "d", "left").select("u", F.col("c").alias("old"), F.least("d", "e").alias("c")), "labels")
        changed = new.filter("old <> c").limit(1).count()
        drop_staged(labels)
        labels = new.select("u", "c")
        if not changed:
            drop_staged(both)
            return labels


def _node(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def _edges(found: DataFrame) -> DataFrame:
    return found.select(_node("a", "b").alias("u"), _node("ha", "hb").alias("v"))


def _placed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` (a, b, ...) with their component (ca, cb); a class without a link is its own."""
    if labels is None:
        return rows.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    flat = labels.select("u.a", "u.b", F.col("c.a").alias("ca"), F.col("c.b").alias("cb"))
    return rows.join(flat, ["a", "b"], "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})


def _contracted(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links between documents as links between the components these have so far."""
    one = _placed(found, labels).selectExpr("ca as x", "cb as y", "ha as a", "hb as b")
    return _placed(one, labels).selectExpr("x as a", "y as b", "ca as ha", "cb as hb").distinct()


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The labels after new links. Only components that a new link touches are joined anew, so a
    turn that finds little takes few and small rounds."""
    if not found.limit(1).count():
        return labels
    merged = components(_edges(_contracted(found, labels)))
    if labels is None:
        return merged
    moved = labels.join(merged.select(F.col("u").alias("c"), F.col("c").alias("to")), "c", "left").select("u", F.coalesce("to", "c").alias("c"))
    new = stage(moved.unionByName(merged.join(labels, "u", "left_anti")), "labels")
    drop_staged(labels, merged)
    return new


def _verified(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among the pairs, by their whole sets."""
    pairs = stage(pairs, "pairs")
    free_shuffles(texts.sparkSession)  # those of lists with their sketches
    sets = stage(_sets(texts, nodes, pairs), "sets")
    found = stage(_linked(pairs, sets), "found")
    drop_staged(pairs, sets)
    return found


def link_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    texts = _texts(docs, text, doc_id)
    seen = stage(_overview(texts), "overview")
    levels = _level_of(sum_slices(seen.filter("slice is not null").select("slice", "cells"), "int32"))
    rows = stage(seen.filter("slice is null").select("doc_id", "a", "b", "n"), "rows")
    nodes = stage(seen.filter("n >= 4").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "nodes")
    drop_staged(seen)
    lists = stage(_lists(texts, levels), "lists")
    free_shuffles(docs.sparkSession)  # those of all prefix shingles are the largest
    labels = _joined(None, _verified(texts, nodes, _leaders(lists, nodes)))
    for turn in range(NEAREST):
        near = stage(_nearest(_cells(lists, labels, nodes)), "nearest")
        best = near.groupBy("a", "b").agg(F.max(F.struct("spare", "ha", "hb")).alias("m")).select("a", "b", "m.ha", "m.hb")
        labels = _joined(labels, _verified(texts, nodes, best))
        # a list without a candidate between components now has none later
        left = stage(lists.join(near.select("tok").distinct(), "tok", "left_semi"), "lists")
        drop_staged(near, lists)
        lists = left
    labels = _joined(labels, _verified(texts, nodes, _across(_cells(lists, labels, nodes))))
    # the least id of each class, then of each component; a document without a set is its own
    classes = _placed(rows.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least")), labels)
    least = classes.groupBy("ca", "cb").agg(F.min("least").alias("component_id"))
    named = classes.join(least, ["ca", "cb"]).select("a", "b", "component_id")
    out = rows.join(named, ["a", "b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group: that of the least id. Columns unchanged.

    Documents without words are groups of their own. Rows that repeat an id stay or go together;
    rows without an id stay, as nothing names them."""
    gone = link_components(docs, text, doc_id).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id] == F.col("__gone"), "left_anti")
