"""SentencePiece vocabularies of the merge type: encoding by an agenda of adjacent pairs, decoding.

A text is normalised as the model says (a space is the mark `▁`, one is put in front), and its
symbols, single characters at first, are merged: the agenda holds adjacent pairs that are pieces,
and the pair of the highest score, of equal ones the leftmost, is merged next. What is no piece in
the end is spelled by its UTF-8 bytes. Short chunks are merged side by side, a row of arrays holding
the agendas of all: each round takes the first pair of each. Long ones have a heap each.

No merge crosses a place where no piece has such characters side by side. Where no piece holds the
mark behind another character, a run of marks opens a chunk; an ASCII character that only ever
stands alone is a chunk. So chunks are encoded once and looked up, and a text is its chunks' ids in
a row; the lookup of a Python worker is bounded. Every chunk that is encoded is compared with the
sentencepiece library's ids of it, many in a call, and the decoding of every whole text with the
library's; `agrees` says whether they are equal. The ids are the agenda's own.

Models must be of the merge type with byte fallback and without a character map, unused or
user-defined pieces; others raise ValueError. Null and empty texts have no pieces, only the begin and
end ids. Nothing is cut, however long: a chunk takes n log n steps. Equal texts get equal ids. Bytes
that aren't UTF-8 count as U+FFFD each. Other columns stay; a column of the result's name is an error."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks that a worker's lookup holds before those go that were not asked for since as many came in.
KEPT = 300_000
#: Chunks of up to so many characters are merged side by side.
SHORT = 64


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields; values are numbers or bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 127) << shift
            shift += 7
            at += 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            length, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + length], at + length
        yield key >> 3, value


class Pieces:
    """A model's pieces, and the chunks encoded so far."""

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = dict(fields(model))  # the last of each; trainer 2, normaliser 3
        trainer, normal = dict(fields(parts.get(2, b""))), dict(fields(parts.get(3, b"")))
        kinds = [dict(fields(v)).get(3, 1) for k, v in fields(model) if k == 1]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if trainer.get(3) != 2 or 6 not in kinds or {4, 5} & set(kinds) or normal.get(2) or not normal.get(5, 1):
            raise ValueError("a merge model with byte fallback, without character map, user-defined or unused pieces is needed")
        self.front, self.squeeze = normal.get(3, 1), normal.get(4, 1)
        self.piece = [sp.id_to_piece(i) for i in range(len(kinds))]
        self.id = {p: i for i, (p, kind) in enumerate(zip(self.piece, kinds, strict=True)) if kind == 1}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in self.id.values()}, reverse=True))}
        self.rank = {p: order[sp.get_score(i)] for p, i in self.id.items()}
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined and c != " ")).encode()
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        self.chunk = re.compile(b"[^%b]+|[%b]" % (alone, alone) if crossing else b" *[^ %b]+| +|[%b]" % (alone, alone))
        #: A character that stands alone in any model: none of its merges is a piece.
        self.sign = next(c for c in "\n\t\x01\x02" if c.encode() in alone)
        self.sign_ids = len(sp.encode(self.sign))
        self.shown = [b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, kind in zip(self.piece, kinds, strict=True)]
        self.plain = np.array([kind == 1 for kind in kinds])
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        halves = sorted((self.id[p[:k]] * len(kinds) + self.id[p[k:]], self.rank[p], i) for p, i in self.id.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id)
        #: Pairs of pieces that make a piece: key (of both ids, in order), rank and id of what they make.
        self.pair, self.pair_rank, self.pair_id = np.array(halves or [(-1, 0, 0)], np.int64).T.copy()
        self.lookup: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.wrong: set[bytes] = set()

    def merge(self, text: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece."""
        symbols, n, rank = list(text), len(text), self.rank.get
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [rank(text[i : i + 2], -1) for i in range(n)]  # of the pair that starts at i; -1: no piece
        now[n - 1] = -1
        agenda = [r * n + i for i, r in enumerate(now) if r >= 0]
        heapify(agenda)
        while agenda:
            r, i = divmod(heappop(agenda), n)
            if now[i] != r:
                continue  # one of the two has been merged with another since
            j = after[i]
            symbols[i] = pair = symbols[i] + symbols[j]
            symbols[j], now[j] = "", -1
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
                now[i] = r = rank(pair + symbols[k], -1)
                if r >= 0:
                    heappush(agenda, r * n + i)
            else:
                now[i] = -1
            k = ahead[i]
            if k >= 0:
                now[k] = r = rank(symbols[k] + pair, -1)
                if r >= 0:
                    heappush(agenda, r * n + k)
        return [s for s in symbols if s]

    def encode_chunk(self, chunk: bytes) -> bytes:
        ids: list[int] = []
        for s in self.merge(chunk.decode(errors="one_each").replace(" ", MARK)):
            if (i := self.id.get(s)) is not None:
                ids.append(i)
            else:
                ids += [self.byte[b] for b in s.encode()]
        return array("I", ids).tobytes()

    def encode_short(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks whose characters are all pieces, each round merging the first pair of every chunk."""
        if not chunks:
            return []
        none = np.iinfo(np.int64).max
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ids = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")].astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), sizes)

        def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and id of what the symbols at `at` and behind it make; `none` where that is no piece."""
            after = np.minimum(at + 1, len(ids) - 1)
            key = np.where((at < after) & (owner[at] == owner[after]), ids[at] * len(self.piece) + ids[after], -1)
            place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            found = (self.pair[place] == key) & (key >= 0)
            return np.where(found, self.pair_rank[place], none), self.pair_id[place]

        rank, made = look(np.arange(len(ids)))
        done_ids, done_owner = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            width = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least < none, width)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_owner.append(owner[~open_])
                ids, owner, rank, made = ids[open_], owner[open_], rank[open_], made[open_]
                continue
            first = np.flatnonzero(rank == np.repeat(least, width))
            at = first[np.r_[True, owner[first[1:]] != owner[first[:-1]]]]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol of every chunk before is gone
            ids, owner, rank, made = ids[keep], owner[keep], rank[keep], made[keep]
            before = np.maximum(at - 1, 0)
            for some in (at, before):
                rank[some], made[some] = look(some)
        owners = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        packed = np.concatenate(done_ids)[order].astype("<u4").tobytes() if done_ids else b""
        ends = 4 * np.cumsum(np.bincount(owners, minlength=len(chunks)))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def chunks(self, text: bytes) -> list[bytes]:
        text = text.replace(MARK.encode(), b" ")
        if self.squeeze:
            text = re.sub(b" +", b" ", text.strip(b" "))
        return self.chunk.findall(b" " + text if text and self.front else text)

    def fill(self, chunks: set[bytes]) -> None:
        """Look chunks up or encode them, and compare what is new with the library's ids, in one call.

        The library puts a mark in front: a chunk that opens with one goes without it, another
        behind a character that stands alone."""
        if len(self.lookup) + len(chunks) > KEPT:
            self.old, self.lookup = self.lookup, {}
        chunks = chunks - self.lookup.keys()
        kept = chunks & self.old.keys()
        self.lookup.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        if not (new := list(chunks - kept)):
            return
        texts = [c.decode(errors="one_each").replace(" ", MARK) for c in new]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        known = np.minimum.reduceat(self.of_char[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")], np.cumsum(sizes) - sizes) >= 0
        short = (known & (sizes <= SHORT)).tolist()
        many = iter(self.encode_short([t for t, s in zip(texts, short, strict=True) if s]))
        own = [next(many) if s else self.encode_chunk(c) for c, s in zip(new, short, strict=True)]
        self.lookup.update(zip(new, own, strict=True))
        own_mark = [bool(self.front) and t[0] == MARK and len(t) > 1 for t in texts]
        theirs = self.library.encode([t[1:] if o else self.sign + t for t, o in zip(texts, own_mark, strict=True)], num_threads=1)
        self.wrong.update(c for c, ids, x, o in zip(new, own, theirs, own_mark, strict=True) if array("I", x if o else x[self.sign_ids :]).tobytes() != ids)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: marks are spaces, bytes that are no UTF-8 count as U+FFFD each."""
        shown = self.shown
        found = b"".join([shown[i] for i in ids.tolist()])
        first = next((i for i in ids.tolist() if shown[i]), None)
        if first is not None and self.plain[first] and self.piece[first][0] == MARK and (self.front or self.squeeze):
            found = found[1:]
        try:
            return found.decode()
        except UnicodeDecodeError:
            return found.decode(errors="one_each")


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    import codecs

    codecs.register_error("one_each", _one_each)
    return Pieces(model)


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Some values at a time, `most` bytes unless one alone has more; null is empty."""
    some, size = [], 0
    for value in column:
        some.append(bytes(value.as_buffer() or b"") if value.is_valid else b"")
        size += len(some[-1])
        if size > most:
            yield some
            some, size = [], 0
    yield some


def _udf(run: Callable, returns: str):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns).asNondeterministic()


def _encoder(own: Pieces, begin: bool, end: bool) -> Callable[[list[bytes]], tuple[list[bytes], list[bool]]]:
    first = array("I", [own.library.bos_id()] if begin else []).tobytes()
    last = array("I", [own.library.eos_id()] if end else []).tobytes()

    def run(texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        cut = [own.chunks(t) for t in texts]
        own.fill(set(chain.from_iterable(cut)))
        return [b"".join([first, *map(own.lookup.__getitem__, chunks), last]) for chunks in cut], [not own.wrong or own.wrong.isdisjoint(chunks) for chunks in cut]

    return run


def _decoded(own: Pieces, packed: list[bytes]) -> tuple[list[str], list[bool]]:
    each = [np.frombuffer(ids, "<u4") for ids in packed]
    texts = [own.decode(ids) for ids in each]
    return texts, [text == own.library.decode(ids.tolist()) for text, ids in zip(texts, each, strict=True)]


def _free(docs: DataFrame, out: str) -> None:
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")


def encode_pieces(docs: DataFrame, model: str, text: str = "text", out: str = "pieces", begin: bool = True, end: bool = True) -> DataFrame:
    """`docs` with a struct `out`: ids as token shards hold them (little-endian unsigned 32-bit
    integers in one binary), and `agrees`. `model` is a file the driver reads; its bytes go along."""
    _free(docs, out)
    proto = Path(model).read_bytes()
    _pieces(proto)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(_pieces(proto), begin, end)
        for batch in batches:
            found = [encode(some) for some in _slices(batch)]
            yield pa.StructArray.from_arrays([pa.array(chain.from_iterable(x), kind) for x, kind in zip(zip(*found, strict=True), (pa.binary(), pa.bool_()), strict=True)], ["ids", "agrees"])

    return docs.withColumn(out, _udf(run, "struct<ids: binary, agrees: boolean>")(F.col(text)))


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with a struct `out`: the text of packed ids (null: empty), and whether the library's is equal."""
    _free(rows, out)
    proto = Path(model).read_bytes()
    _pieces(proto)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _pieces(proto)
        for batch in batches:
            found = [_decoded(own, some) for some in _slices(batch)]
            yield pa.StructArray.from_arrays([pa.array(chain.from_iterable(x), kind) for x, kind in zip(zip(*found, strict=True), (pa.string(), pa.bool_()), strict=True)], ["text", "agrees"])

    return rows.withColumn(out, _udf(run, "struct<text: string, agrees: boolean>")(F.col(ids)))


def round_trip(docs: DataFrame, model: str, text: str = "text", out: str = "pieces", begin: bool = True, end: bool = True) -> DataFrame:
    """`docs` with a struct `out`: ids, the text they decode to, and whether both are the library's.
    Encoding and decoding share one Python worker and one pass."""
    _free(docs, out)
    proto = Path(model).read_bytes()
    _pieces(proto)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _pieces(proto)
        encode = _encoder(own, begin, end)
        for batch in batches:
            parts = []
            for some in _slices(batch):
                ids, fine = encode(some)
                texts, same = _decoded(own, ids)
                parts.append(pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array([a and b for a, b in zip(fine, same, strict=True)], pa.bool_())], ["ids", "text", "agrees"]))
            yield pa.concat_arrays(parts)

    return docs.withColumn(out, _udf(run, "struct<ids: binary, text: string, agrees: boolean>")(F.col(text)))
