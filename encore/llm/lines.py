"""Line dedup through a sharded minimal perfect hash.

The key of a line is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
least 10 code points that at least two documents hold are collected as 128-bit hashes and dealt to
shards; each shard becomes a minimal perfect hash (levels of bit arrays, as in BBHash) over an
array of fingerprints, one of counts and one of owners (the smallest doc_id). Documents then probe
those arrays line by line: nothing is joined on lines. A 64-bit fingerprint beside the 64 bits that
place a key makes a false match as unlikely as a collision of 128-bit hashes.

Arrays of up to `max_broadcast` bytes (a measured sum) travel to every task. Beyond that the
probing goes by shard: lines are packed for each document and shard, meet their shard's arrays in
one task of that shard (hot shards are salted), and only the hashes to drop come back.

A null or empty text is one empty line. A null doc_id counts as one document, larger than any
other. Repeated rows of a doc_id are one document, and lose or keep their lines alike. Ids are
numbers. A column named as the result is replaced, all others stay, whatever they are called; very
long texts go line by line; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import give_back, own_name, released, utf8
from encore.staging import stage

MIN_CHARS = 10
NO_ID = 2**63 - 1
SHARD_KEYS = 200_000
MAX_BROADCAST = 96 << 20
#: Lines that a task probes a shard with at a time, about.
PROBES = 4_000_000
#: Documents whose lines a task holds as Python values at a time.
AT_ONCE = 512
_MASK = 2**64 - 1


def key_of(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The line's key, or None if it is too short to count."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return key


def hash_of(key: bytes) -> tuple[int, int]:
    """128 bits as two signed 64-bit numbers."""
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & _MASK
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _place(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
    seed = np.uint64((level * 0x9E3779B97F4A7C15 + 1) & _MASK)
    return (_mix(b ^ _mix(a + seed)) % np.uint64(cells)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash: level by level, keys alone in their cell take it; the rest go on."""

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.ranks = levels, ranks

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64)
        levels, ranks, base = [], [], 0
        while len(a):
            cells = -(-2 * len(a) // 64) * 64
            at = _place(a, b, len(levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(np.packbits(alone))
            ranks.append((base + np.concatenate([[0], np.cumsum(alone)[:-1]])).astype(np.int32)[:: 64])
            base += int(alone.sum())
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(levels, ranks)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number from 0; any number or -1 for a key that wasn't built in."""
        a, b = a.view(np.uint64), b.view(np.uint64)
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            at = _place(a[todo], b[todo], k, len(bits) * 8)
            here = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            cell = at[here]
            block = cell >> 6
            within = np.unpackbits(np.concatenate([bits, np.zeros(8, np.uint8)])[(block * 8)[:, None] + np.arange(8)], axis=1) if len(cell) else np.zeros((0, 64), np.uint8)
            before = (within * (np.arange(64) < (cell & 63)[:, None])).sum(1)
            out[todo[here]] = rank[block] + before
            todo = todo[~here]
        return out

    def pack(self) -> tuple[list[bytes], list[bytes]]:
        return [x.tobytes() for x in self.levels], [x.tobytes() for x in self.ranks]

    @classmethod
    def unpack(cls, levels: list[bytes], ranks: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(x, np.uint8) for x in levels], [np.frombuffer(x, np.int32) for x in ranks])


class Shard:
    """One shard's arrays: fingerprint, count and owner at each key's number."""

    def __init__(self, row):
        self.hash = PerfectHash.unpack(row["levels"], row["ranks"])
        self.prints, self.counts, self.owners = (np.frombuffer(row[c], t) for c, t in (("prints", np.int64), ("counts", np.uint32), ("owners", np.int64)))

    def drop(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which keys of documents are held by two or more documents, an earlier one among them."""
        at = self.hash.index(a, b)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == a[ok]
        ok[ok] = (self.counts[at[ok]] >= 2) & (self.owners[at[ok]] != doc[ok])
        return ok


SHARD_SCHEMA = "shard int, levels array<binary>, ranks array<binary>, prints binary, counts binary, owners binary"


def repeated_lines(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(a, b, owner, n): hashes of keys that two or more documents hold. Batches combine first, so
    a line that all documents share leaves a task as few rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for doc, body in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                for line in {key_of(x, least) for x in body.split(b"\n")} - {None} if body else ():
                    if (own := seen.get(line)) is None:
                        seen[line] = [doc, doc, 1]
                    else:
                        own[0], own[1], own[2] = min(own[0], doc), max(own[1], doc), own[2] + 1
            hashes = [hash_of(x) for x in seen]
            cols = [[h[0] for h in hashes], [h[1] for h in hashes], *(([v[i] for v in seen.values()]) for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "low", "high", "n"])

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.col(text).cast("binary").alias("t"))
    found = rows.mapInArrow(released(scan), "a long, b long, low long, high long, n long")
    return found.groupBy("a", "b").agg(F.min("low").alias("owner"), F.max("high").alias("high"), F.sum("n").alias("n")).filter("owner <> high").drop("high")


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """One row of arrays for each shard of about `SHARD_KEYS` keys."""

    def build(part):
        import pandas as pd

        a, b = part["a"].to_numpy(np.int64), part["b"].to_numpy(np.int64)
        mph = PerfectHash.build(a, b)
        at = mph.index(a, b)
        arrays = [np.zeros(len(a), t) for t in (np.int64, np.uint32, np.int64)]
        for array, values in zip(arrays, (a, np.minimum(part["n"].to_numpy(np.int64), 2**32 - 1), part["owner"].to_numpy(np.int64)), strict=True):
            array[at] = values
        levels, ranks = mph.pack()
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "levels": [levels], "ranks": [ranks], "prints": [arrays[0].tobytes()], "counts": [arrays[1].tobytes()], "owners": [arrays[2].tobytes()]})

    return repeated.withColumn("shard", F.pmod(F.col("a"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, SHARD_SCHEMA)


_KIND = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.large_string())])
_RETURNS = "struct<n_lines: bigint, n_dropped: bigint, kept: string>"


def _kept(body: bytes, gone: set[tuple[int, int]] | None, hashes: list) -> dict:
    lines = body.split(b"\n")
    if not gone:
        return {"n_lines": len(lines), "n_dropped": 0, "kept": body.decode()}
    left = [x for x, h in zip(lines, hashes, strict=True) if h not in gone]
    return {"n_lines": len(lines), "n_dropped": len(lines) - len(left), "kept": b"\n".join(left).decode()}


def _hashes(body: bytes, least: int) -> list[tuple[int, int] | None]:
    return [None if (k := key_of(x, least)) is None else hash_of(k) for x in body.split(b"\n")]


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "lines", least: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`docs` with a struct column `out`: n_lines, n_dropped, kept (the text that stays)."""
    repeated = stage(repeated_lines(docs, text, doc_id, least), "lines")
    keys = repeated.count()
    shards = max(1, -(-keys // shard_keys))
    arrays = stage(build_shards(repeated, shards), "shards")
    size = arrays.agg(F.sum(sum(F.length(c) for c in ("prints", "counts", "owners")) * F.lit(1.3))).first()[0] or 0
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col(text), F.lit(""))
    if size <= max_broadcast:
        return docs.withColumn(out, _probe_all([r.asDict() for r in arrays.collect()], shards, least)(doc, body))
    return _probe_by_shard(docs, arrays, shards, doc, body, out, least)


def _probe_all(rows: list[dict], shards: int, least: int):
    sent = None if not rows else rows

    def probed(own: dict[int, Shard], ids: pa.Array, bodies: pa.Array) -> pa.Array:
        docs, texts = ids.to_pylist(), bodies.cast(pa.large_binary()).to_pylist()
        each = [_hashes(t, least) for t in texts]
        flat = [(h[0], h[1], k) for k, hs in enumerate(each) for h in hs if h]
        gone: list[set] = [set() for _ in docs]
        if flat and own:
            a, b, k = (np.array(x, np.int64) for x in zip(*flat, strict=True))
            d = np.array(docs, np.int64)[k]
            which = np.mod(a, shards)
            for s, shard in own.items():
                here = np.flatnonzero(which == s)
                for i in here[shard.drop(a[here], b[here], d[here])].tolist():
                    gone[k[i]].add((flat[i][0], flat[i][1]))
        return pa.array([_kept(t, g, h) for t, g, h in zip(texts, gone, each, strict=True)], _KIND)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = {r["shard"]: Shard(r) for r in sent or ()}
        for ids, bodies in batches:
            some = [probed(own, ids.slice(at, AT_ONCE), bodies.slice(at, AT_ONCE)) for at in range(0, len(ids), AT_ONCE)]
            yield pa.concat_arrays(some) if some else pa.array([], _KIND)
        del own
        give_back()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _RETURNS).asNondeterministic()


def _probe_by_shard(docs: DataFrame, arrays: DataFrame, shards: int, doc, body, out: str, least: int, probes_at_once: int = PROBES) -> DataFrame:
    """The same answer without a broadcast: documents' hashes go to the shards, drops come back.

    A shard's probes go in as many parts as keep each at about `probes_at_once` lines, by a count of
    all lines. Drops come back by id and text, so rows that share an id, or have none, don't meet."""
    lines = docs.agg(F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    salts = max(8, -(-int(lines) // (shards * probes_at_once)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(batches):
            by: dict[int, list] = {}
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for d, h, t in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                    for x in set(_hashes(t, least)) - {None}:
                        by.setdefault(x[0] % shards, []).append((x[0], x[1], d, h))
            rows = [(s, hash((n, s, v[0])) % salts, np.array(v, np.int64).tobytes()) for s, v in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "salt", "probe"])

    def probe(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"d": [], "h": [], "a": [], "b": []}).astype("int64")
        x = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 4) for p in right["probe"]])
        ok = Shard(left.iloc[0]).drop(x[:, 0].copy(), x[:, 1].copy(), x[:, 2].copy())
        return pd.DataFrame({"d": x[ok, 2], "h": x[ok, 3], "a": x[ok, 0], "b": x[ok, 1]})

    d, h, gone = own_name("d"), own_name("h"), own_name("gone")
    rows = docs.select(doc.alias("d"), F.xxhash64(body).alias("h"), body.cast("binary").alias("t"))
    probes = rows.mapInArrow(pack, "shard int, salt int, probe binary")
    dealt = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    drops = dealt.groupBy("shard", "salt").cogroup(probes.groupBy("shard", "salt")).applyInPandas(probe, "d long, h long, a long, b long")
    found = drops.groupBy(F.col("d").alias(d), F.col("h").alias(h)).agg(F.collect_set(F.struct("a", "b")).alias(gone))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bodies, drop in batches:
            texts = bodies.cast(pa.large_binary()).to_pylist()
            yield pa.array([_kept(t, {(g["a"], g["b"]) for g in x or ()}, _hashes(t, least) if x else []) for t, x in zip(texts, drop.to_pylist(), strict=True)], _KIND)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    keep = F.arrow_udf(run, _RETURNS).asNondeterministic()
    joined = docs.withColumns({d: doc, h: F.xxhash64(body)}).join(found, [d, h], "left")
    return joined.withColumn(out, keep(body, F.col(gone))).drop(d, h, gone)
