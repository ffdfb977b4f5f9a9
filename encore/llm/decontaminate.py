"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A word is a maximal run of digits, letters a-z (after A-Z are lower-cased) and non-ASCII
characters. Every 10 consecutive words of an item form a pattern; a shorter item is one pattern.
Patterns of one length share a table: blocks of two words give the shift, a block that ends a
pattern selects its bucket, and direct comparison confirms the occurrence.

Nulls and empty texts have no words: such documents are never hit, such items give no pattern. An
item without an id still marks words but is counted in no list of items. Repeated rows are judged
row by row. Other columns of the documents, whatever their names, are kept as they are."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.llm.common import own_name, per_value

WINDOW = 10
#: Patterns that are searched at once; more go through further passes over the same rows.
MAX_PATTERNS = 200_000

#: One byte to one byte: what is no word character becomes a space, A-Z become a-z.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WuManber:
    """Occurrences of word sequences; `patterns` maps each to the ids it stands for."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.groups = []
        by_length = defaultdict(list)
        for p in patterns:
            by_length[len(p)].append(p)
        for m, group in sorted(by_length.items()):
            b = min(2, m)
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, list] = defaultdict(list)
            for p in group:
                for end in range(b, m + 1):
                    block = b" ".join(p[end - b : end])
                    shift[block] = min(shift.get(block, m), m - end)
                bucket[b" ".join(p[m - b :])].append((list(p), patterns[p]))
            self.groups.append((m, b, m - b + 1, shift, dict(bucket)))

    def search(self, text: list[bytes], hit: set[int], ids: set[str]) -> None:
        """Adds the positions of words inside an occurrence, and the ids, of all patterns."""
        for m, b, most, shift, bucket in self.groups:
            at, n = m - 1, len(text)
            while at < n:
                block = text[at - 1] + b" " + text[at] if b == 2 else text[at]
                step = shift.get(block, most)
                if step:
                    at += step
                    continue
                start = at - m + 1
                found = text[start : at + 1]
                for p, own in bucket[block]:
                    if p == found:
                        hit.update(range(start, at + 1))
                        ids |= own
                at += 1


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The distinct rows (window, id) of the items; `id` is a string."""

    def cut():
        def one(text: bytes | None) -> list[str]:
            w = words(text)
            return list({b" ".join(w[i : i + WINDOW]).decode() for i in range(max(1, len(w) - WINDOW + 1))}) if w else []

        return one

    cut_up = per_value(cut, "array<string>", pa.list_(pa.string()))
    return items.select(F.col(item_id).cast("string").alias("id"), F.explode(cut_up(F.col(text))).alias("window")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "hits", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """`docs` with a struct column `out`: n_words, hit (positions of hit words), items (sorted ids).

    The patterns are dealt by hash into blocks of about `max_patterns`, each a search table of
    bounded size; the rows stream through one search per block, without a shuffle. A column named
    `out` is replaced, all others stay, whatever they are called. Without items nothing is hit."""
    patterns = windows(items)
    blocks = max(1, -(-patterns.count() // max_patterns))
    names = [own_name("hits") for _ in range(blocks)]
    for k, name in enumerate(names):
        part = patterns if blocks == 1 else patterns.filter(F.pmod(F.xxhash64("window", "id"), F.lit(blocks)) == k)
        table: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for row in part.collect():
            table[tuple(row["window"].encode().split(b" "))] |= {row["id"]} - {None}
        docs = docs.withColumn(name, _searcher(dict(table))(F.col(text)))
    union = {c: F.array_sort(F.array_distinct(F.flatten(F.array(*(F.col(f"{n}.{c}") for n in names))))) for c in ("hit", "items")}
    found = F.col(names[0]) if blocks == 1 else F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), *(v.alias(c) for c, v in union.items()))
    return docs.withColumn(out, found).drop(*names)


def _searcher(table: dict):
    def start():
        search = WuManber(table).search

        def one(text: bytes | None) -> dict:
            w, hit, ids = words(text), set(), set()
            search(w, hit, ids)
            return {"n_words": len(w), "hit": sorted(hit), "items": sorted(ids)}

        return one

    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    return per_value(start, "struct<n_words: bigint, hit: array<int>, items: array<string>>", kind, release=True)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """The documents without any occurrence of a benchmark window, columns unchanged."""
    mark = own_name("hits")
    return find_hits(docs, items, text, mark, max_patterns).filter(F.size(f"{mark}.hit") == 0).drop(mark)
