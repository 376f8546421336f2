"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of digits, letters a-z (A-Z lowered) and anything beyond ASCII.  A benchmark item is the set of its
windows of ``WINDOW`` words (all its words, if fewer); a document word inside any occurrence of a window is hit.
A window occurs where all its shingles (``SHINGLE`` words; the whole window, if shorter) stand one after the other,
so a window is joined as a set of m shingles that must be contained whole: of m tokens that must all be there, any
m - m + 1 = 1 is a sufficient prefix, and the rarest one gives the fewest candidates.

1. Documents are scanned once.  Word places are found on the bytes, words and shingles get rolling hashes, and
   shingles that stand in some window are kept with their place after their words are compared byte by byte: a shingle
   number means those very words.
2. Rarity is the number of places of a shingle in all documents, one aggregate of what step 1 wrote.  Each window is
   ordered by it; its rarest shingle (ties: the first) is its prefix, with its place in the window.
3. Prefix places of a document give candidate windows.  Positional bound: the window may not begin before the document;
   length bound: its last shingle must not begin after the document's last one.  Candidates are verified exactly,
   shingle by shingle, against what step 1 found at the places of the item-sized window.

The benchmark is a stated query set: its distinct windows are handled in blocks of about ``BLOCK_WINDOWS``, which bound what
is sent to the tasks whatever the benchmark's size; with more than one block the hits of a document are put together by
one aggregate.  Documents are never joined with each other, and no text moves.

Defined results: null text has no words; items without words have no windows; an item whose id is null is named by the
empty text; items with equal ids count once; a null document id stays null and repeated rows give repeated results; an
empty benchmark leaves all clean; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, SHINGLE = 10, 5
#: Distinct windows per pass over the documents.
BLOCK_WINDOWS = 200_000
#: Bytes of text handled at once (a longer text alone), and the length from which words are hashed one by one.
CHUNK, LONG_WORD = 1 << 22, 64
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bits of the table that says which shingle hashes are worth looking up.
_TABLE_BITS = 20


# ---- words and hashes of many texts at once ----------------------------------------------------

def word_places(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in lowered bytes; ``begins`` are the starts of the texts laid end to end."""
    inside = _IS_WORD[text]
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = begins[(begins > 0) & (begins < len(text))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits per word, equal for equal words."""
    sizes = ends - starts
    out = sizes.astype(np.uint64)
    order = np.argsort(-np.minimum(sizes, LONG_WORD + 1), kind="stable")
    long_ = int(np.searchsorted(-sizes[order], -LONG_WORD, "left"))
    for w in order[:long_].tolist():
        out[w] = xxhash.xxh64_intdigest(text[starts[w]:ends[w]].tobytes())
    rest = order[long_:]
    begin, size, h = starts[rest], sizes[rest], out[rest]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))  # words of more than k bytes stand first
        h[:n] = (h[:n] ^ text[begin[:n] + k]) * _MULTIPLY
    h ^= h >> np.uint64(29)
    out[rest] = h * _MIX
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64 bits for every k words in a row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j:j + n]) * _MULTIPLY
        h ^= h >> np.uint64(31)
    return h


class Scan:
    """Words of some texts (lowered UTF-8 laid end to end) with their hashes and the text each stands in."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        self.text = _LOWERED[text]
        self.starts, self.ends = word_places(self.text, offsets[:-1])
        self.hashes = word_hashes(self.text, self.starts, self.ends)
        #: Words before each text.
        self.before = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.before)
        self.of = np.repeat(np.arange(len(offsets) - 1), self.n_words)

    def words(self, first: int, k: int) -> bytes:
        return b" ".join(self.text[s:e].tobytes() for s, e in zip(self.starts[first:first + k].tolist(), self.ends[first:first + k].tolist()))


def scan_of(texts: list[bytes]) -> Scan:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    return Scan(np.frombuffer(b"".join(texts), np.uint8), offsets)


# ---- a block of windows --------------------------------------------------------------------------

class Windows:
    """Shingles of a block of distinct windows (words joined by a space)."""

    def __init__(self, windows: list[str], shingle: int = SHINGLE):
        words = [w.encode().split(b" ") for w in windows]
        self.sizes = [len(w) for w in words]
        numbers: dict[bytes, int] = {}
        #: Shingle numbers of each window, in order.
        self.shingles = []
        for w in words:
            k = min(shingle, len(w))
            self.shingles.append([numbers.setdefault(b" ".join(w[i:i + k]), len(numbers)) for i in range(len(w) - k + 1)])
        self.texts = list(numbers)
        self.lengths = np.array([t.count(b" ") + 1 for t in self.texts], np.int64)
        scan = scan_of(self.texts)
        hashes = np.zeros(len(self.texts), np.uint64)
        #: Shingle length -> (sorted hashes, their shingle numbers, table of first bits).
        self.lookup = {}
        for k in sorted(set(self.lengths.tolist())):
            at = np.flatnonzero(self.lengths == k)
            hashes[at] = shingle_hashes(scan.hashes, k)[scan.before[at]]
            order = at[np.argsort(hashes[at], kind="stable")]
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[hashes[at] >> np.uint64(64 - _TABLE_BITS)] = True
            self.lookup[k] = (hashes[order], order, table)

    def find(self, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        """(word, shingle number) wherever a shingle of the block stands in the texts of ``scan``, in order."""
        words, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (sorted_, order, table) in self.lookup.items():
            h = shingle_hashes(scan.hashes, k)
            at = np.flatnonzero(table[h >> np.uint64(64 - _TABLE_BITS)])
            at = at[scan.of[at] == scan.of[at + k - 1]]
            low, high = (np.searchsorted(sorted_, h[at], side) for side in ("left", "right"))
            at, low, high = at[high > low], low[high > low], high[high > low]
            found = [(w, n) for w, l, r in zip(at.tolist(), low.tolist(), high.tolist())
                     for n in order[l:r].tolist() if scan.words(w, k) == self.texts[n]]
            if found:
                w, n = zip(*found)
                words.append(np.array(w, np.int64))
                numbers.append(np.array(n, np.int64))
        word, number = np.concatenate(words), np.concatenate(numbers)
        order = np.lexsort((number, word))
        return word[order], number[order]

    def prefixes(self, places: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Shingle number -> (window, place in it) of the windows whose rarest shingle it is; ``places`` are the corpus's counts."""
        out: dict[int, list[tuple[int, int]]] = {}
        for w, shingles in enumerate(self.shingles):
            rarest = min(range(len(shingles)), key=lambda i: places[shingles[i]])
            if places[shingles[rarest]]:
                out.setdefault(shingles[rarest], []).append((w, rarest))
        return out


def occurrences(n_words: int, places: list[int], numbers: list[int], windows: Windows, prefixes: dict) -> list[tuple[int, int]]:
    """(first word, window) of every window that stands in a document, given the shingles at its places."""
    out, found = [], set(zip(places, numbers))
    for at, number in zip(places, numbers):
        for w, offset in prefixes.get(number, ()):
            start, shingles = at - offset, windows.shingles[w]
            if start < 0 or start + windows.sizes[w] > n_words:
                continue
            if all((start + i, s) in found for i, s in enumerate(shingles)):
                out.append((start, w))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of (start, end) spans, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


# ---- Spark ---------------------------------------------------------------------------------------

def item_windows(benchmark: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(window, items): every distinct window of the benchmark (words joined by a space) with the ids of its items."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"),
                             F.regexp_extract_all(lowered, F.lit(f"({WORD})")).alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, window), " "))
    windows = words.where(F.size("words") > 0).select("item", F.explode(each).alias("window"))
    return windows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _texts_of(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _found(docs: DataFrame, windows: Windows) -> DataFrame:
    """Step 1: the columns of ``docs`` but the last (its text), n_words, places, shingles."""
    *kept, _ = docs.columns

    def batches(found):
        for batch in found:
            texts, at = _texts_of(batch.column(len(kept))), 0
            n_words, places, shingles = [], [], []
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= CHUNK:
                    size += len(texts[end])
                    end += 1
                scan = scan_of(texts[at:end])
                word, number = windows.find(scan)
                cut = np.searchsorted(word, scan.before)
                n_words += scan.n_words.tolist()
                places += [(word[a:b] - w).tolist() for a, b, w in zip(cut[:-1], cut[1:], scan.before)]
                shingles += [number[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
                at = end
            yield pa.record_batch([*batch.columns[:len(kept)], pa.array(n_words, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                                   pa.array(shingles, pa.list_(pa.int32()))], [*kept, "n_words", "places", "shingles"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return small_batches(docs).mapInArrow(batches, schema + ", n_words long, places array<int>, shingles array<int>")


def _verified(found: DataFrame, windows: Windows, items: list[list[str]], prefixes: dict) -> DataFrame:
    """Step 3: ``found`` with ``hits`` (spans of hit words) and ``items`` for ``places`` and ``shingles``."""
    kept = found.columns[:-2]

    def batches(parts):
        for batch in parts:
            n_words, places, numbers = (batch.column(len(kept) + i).to_pylist() for i in (-1, 0, 1))
            hits, held = [], []
            for n, p, s in zip(n_words, places, numbers):
                at = occurrences(n, p, s, windows, prefixes) if p else []
                hits.append([{"start": a, "end": b} for a, b in merged([(w, w + windows.sizes[x]) for w, x in at])])
                held.append(sorted({i for x in {x for _, x in at} for i in items[x]}))
            yield pa.record_batch([*batch.columns[:len(kept)], pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                                   pa.array(held, pa.list_(pa.string()))], [*kept, "hits", "items"])

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in kept)
    return found.mapInArrow(batches, schema + ", hits array<struct<start:int,end:int>>, items array<string>")


def _one_block(docs: DataFrame, block: list) -> DataFrame:
    windows, items = Windows([r["window"] for r in block]), [list(r["items"]) for r in block]
    found = materialize(_found(docs, windows), "decontaminate")
    counts = found.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    places = np.zeros(len(windows.texts), np.int64)
    for r in counts.collect():  # one row per shingle of the block at most
        places[r["shingle"]] = r["count"]
    return _verified(found, windows, items, windows.prefixes(places))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
                  item_key: str = "item_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: key, n_words, hits (merged spans of hit words, end exclusive), items (sorted ids)."""
    windows = materialize(item_windows(benchmark, item_text, item_key), "benchmark-windows")
    blocks = max(1, -(-windows.count() // block_windows))
    if blocks == 1:
        return _one_block(docs.select(F.col(key), F.col(text)), windows.collect())
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.col(text))
    number = F.pmod(F.xxhash64("window"), F.lit(blocks))
    parts = [_one_block(rows, windows.where(number == b).collect()) for b in range(blocks)]
    together = parts[0]
    for p in parts[1:]:
        together = together.unionAll(p)
    # Rows of equal key and text have equal results: one per block and copy.
    together = together.groupBy("_key", "_hash").agg(
        F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count(F.lit(1)).alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"_n div {blocks}")))
    return together.select(F.col("_key").alias(key), "n_words", union_of(F.col("hits")).alias("hits"), "items", copies.alias("_copy")).drop("_copy")


def union_of(spans: Column) -> Column:
    """Sorted spans (start, end) with overlapping and touching ones merged."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), grown).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(spans, none, add)


def hit_words(hits: Column) -> Column:
    """Words inside the spans of ``hits``."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
