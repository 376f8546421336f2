"""Cross-tokenizer alignment: which tokens of vocabulary A and of vocabulary B cover the same bytes.

A text (a space before it) is encoded with both tokenizers; each gives an ascending list of the byte
places where its tokens end.  Merging the two lists gives the links and groups: between two
neighbouring ends lies exactly one A and one B token, which overlap there; where both lists hold
the same end, a group of tokens closes.

Texts are cut into words where neither tokenizer's tokens can cross, and a word that comes again is not
encoded or merged again: a text's links and groups are those of its words one after the other.  The
merge works on the ends of many words (whole texts, where nothing can be cut) laid end to end.

The merge is cut by merge-path partitioning: these ends form one long merge of |A| + |B|
steps; binary searches along evenly spaced diagonals give the place (i, j) in both lists after every
``PIECE`` steps, so pieces carry equal work whatever the words are like and need nothing of each
other.  Each piece emits its overlaps and the groups that close in it; the group left open at the
end of a piece is stitched to the next by adding up how many groups closed before.

An id pair's count is the number of documents that hold it linked.  Documents are handled in blocks of
about ``BLOCK`` bytes of text.  A block keeps its distinct pairs once, with the number of its documents for
each, and a document refers to them by position, so what is shuffled for the counts are distinct pairs of
blocks, not links.  The counts come back to a block as one sorted list, met with its documents in a
cogroup; a group is one block, whose size is bounded (a longer text is a block of its own).

Defined results: a text that is null or empty, or that the joined bytes of either tokenizer do not give back, has
no tokens: zeros and an empty list of groups; a null id stays null; repeated rows are documents of their own
and count as often; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Steps of the merge per piece.
PIECE = 1 << 16
#: Bytes of text per block, and per call of a tokenizer.
BLOCK, CALL = 1 << 21, 1 << 19
#: Places that neither a byte-level split nor a piece ever crosses, whatever stands around them: a space with a
#: character other than a space after it begins behind a plain sign or letter.  (Other characters may be white
#: space themselves; at the end of a text the model would drop a space that stands alone.)
WORD_CUT = re.compile("(?<=[!-~\u00C0-\u024F])(?= +[^ ])")
#: How byte-level files split a text (a fixed value of the format), and texts in whose characters all
#: libraries see the same letters, digits and white space.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = re.compile("[\n\x20-\x7E\xA1-\u024F]*").fullmatch
#: Aligned words that a worker keeps, in each of two generations (a memory bound only).
KEPT_WORDS = 100_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts that begin with a space, the bytes of every id, whether words may be encoded apart."""

    def __init__(self, encode, spelled: list[bytes], cuts: bool):
        self.encode, self.spelled, self.cuts = encode, spelled, cuts
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self._signed: dict[str, np.ndarray] = {}

    def signed(self, sign: str) -> np.ndarray:
        """Every id as text with ``sign`` behind it."""
        if sign not in self._signed:
            self._signed[sign] = np.array([f"{i}{sign}" for i in range(len(self.spelled))], object)
        return self._signed[sign]


@cache
def byte_level(path: str) -> Side:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    signs = byte_alphabet()
    spelled = [b""] * t.get_vocab_size(with_added_tokens=True)
    for name, i in t.get_vocab(with_added_tokens=True).items():
        spelled[i] = bytes(signs[c] for c in name) if all(c in signs for c in name) else name.encode()
    form = json.loads(t.to_str())
    split = form["pre_tokenizer"] or {}
    added = any(not x["special"] for x in form["added_tokens"])
    cuts = not form["normalizer"] and not added and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    def encode(texts):
        return [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    quick = _by_ranks(form, spelled) if cuts else None
    if quick is None:
        return Side(encode, spelled, cuts)

    def encode_mixed(texts):
        ids = [quick(x) if LATIN(x) else None for x in texts]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(rest, encode([texts[k] for k in rest])):
            ids[k] = x
        return ids
    return Side(encode_mixed, spelled, cuts)


def _by_ranks(form: dict, spelled: list[bytes]):
    """The file's vocabulary as an encoder by ranks (some times faster on short texts), if its merges are
    numbered in the order they are made; None otherwise."""
    import tiktoken
    vocab, merges = form["model"]["vocab"], form["model"]["merges"]
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in merges]
    plain = {i for i in vocab.values() if len(spelled[i]) == 1}
    if made != sorted(set(made) - {None}) or len(plain) != 256 or plain | set(made) != set(vocab.values()) or max(plain) > made[0]:
        return None
    ranks = {spelled[i]: i for i in vocab.values()}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@cache
def piece_level(path: str) -> Side:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    crossing = re.compile(f"[^{MARK}]{MARK}")
    # The model puts the space in front itself.
    return Side(lambda texts: sp.encode([t[1:] for t in texts], num_threads=1), spelled, not any(crossing.search(p) for p in names))


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) after every ``piece`` steps of merging ``a`` and ``b`` (at equal values ``a`` goes first), both ends included."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:  # the smallest i on the diagonal whose a[i] comes after b[d - i - 1]
        open_ = low < high
        if not open_.any():
            return low, d - low
        mid = (low + high) >> 1
        m, k = mid[open_], d[open_]
        further = a[m] <= b[k - m - 1]
        low[open_] = np.where(further, m + 1, low[open_])
        high[open_] = np.where(further, high[open_], m)


def merge_piece(a, b, i0, i1, j0, j1):
    """One piece: (A index, B index) of its overlaps in order, and (A index, B index) behind each group it closes."""
    ea, eb = a[i0:i1], b[j0:j1]
    ja = j0 + np.searchsorted(eb, ea, "left")   # B tokens that ended before this A end
    ib = i0 + np.searchsorted(ea, eb, "right")  # A tokens that ended up to this B end
    # A B end equal to the A end before it closes a group and has no bytes of its own.  That A end may
    # belong to the piece before: the list itself is looked at.
    closes = (ib > 0) & (a[np.maximum(ib, 1) - 1] == eb)
    own = np.flatnonzero(~closes)
    place = np.concatenate([np.arange(len(ea)) + (ja - j0), own + (ib[own] - i0)])
    order = np.argsort(place, kind="stable")
    link_a = np.concatenate([np.arange(i0, i1), ib[own]])[order]
    link_b = np.concatenate([ja, j0 + own])[order]
    shut = np.flatnonzero(closes)
    return link_a, link_b, ib[shut], j0 + shut + 1


def align_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE):
    """Links (A index, B index) and group ends (tokens of A and of B before each) of two ascending lists of ends."""
    i, j = diagonals(a, b, piece)
    parts = [merge_piece(a, b, *x) for x in zip(i[:-1], i[1:], j[:-1], j[1:])]
    if not parts:
        parts = [(np.zeros(0, np.int64),) * 4]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _laid_out(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens before each word) of words laid end to end."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _whole(side: Side, ids: list[list[int]], raw: list[bytes]) -> list[bool]:
    """Whether the joined bytes of its tokens are the word."""
    flat, before = _laid_out(ids)
    sizes = np.diff(np.concatenate([[0], np.cumsum(side.lengths[flat])])[before])
    if sizes.tolist() == list(map(len, raw)) and b"".join(map(side.spelled.__getitem__, flat.tolist())) == b"".join(raw):
        return [True] * len(raw)
    return [b"".join(map(side.spelled.__getitem__, x)) == w for x, w in zip(ids, raw)]


class Word(NamedTuple):
    """What a word adds to every text it stands in."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes       # of every link: A id * 2^32 + B id as 64 bits (an array, or a view of one, takes some times as much)
    whole: bool        # the joined bytes of both tokenizers are the word


def align_words(words: list[str], a: Side, b: Side, piece: int = PIECE) -> list[Word]:
    """Encode words with both tokenizers and merge their ends, all words in one merge."""
    raw = [w.encode() for w in words]
    ids_a, ids_b = a.encode(words), b.encode(words)
    whole = [x and y for x, y in zip(_whole(a, ids_a, raw), _whole(b, ids_b, raw))]
    if not all(whole):
        ids_a, ids_b = ([x if k else [] for x, k in zip(ids, whole)] for ids in (ids_a, ids_b))
    (flat_a, before_a), (flat_b, before_b) = _laid_out(ids_a), _laid_out(ids_b)
    # Every word ends with an end of both, so no link or group reaches over to the next.
    link_a, link_b, shut_a, shut_b = align_ends(np.cumsum(a.lengths[flat_a]), np.cumsum(b.lengths[flat_b]), piece)
    pairs = ((flat_a[link_a] << 32) | flat_b[link_b]).tobytes()
    links = (8 * np.searchsorted(link_a, before_a)).tolist()
    shut = np.searchsorted(shut_a, before_a, "right")
    shut[0] = 0  # words without tokens before the first group

    # Groups as text: A ids, a bar, B ids, a semicolon; each id is written with the sign behind it.
    sizes_a, sizes_b = np.diff(shut_a, prepend=0), np.diff(shut_b, prepend=0)
    signed_a, signed_b = a.signed(",")[flat_a], b.signed(",")[flat_b]
    signed_a[shut_a - 1] = a.signed("|")[flat_a[shut_a - 1]]
    signed_b[shut_b - 1] = b.signed(";")[flat_b[shut_b - 1]]
    text = np.empty(len(flat_a) + len(flat_b), object)
    text[np.arange(len(flat_a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = signed_a
    text[np.arange(len(flat_b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = signed_b
    text, cuts = text.tolist(), (before_a + before_b).tolist()
    return [Word(n_a, n_b, n_groups, "".join(text[c0:c1])[:-1], pairs[p0:p1], k) for n_a, n_b, n_groups, c0, c1, p0, p1, k in zip(
        np.diff(before_a).tolist(), np.diff(before_b).tolist(), np.diff(shut).tolist(), cuts, cuts[1:], links, links[1:], whole)]


class Aligner:
    """Aligns blocks of texts; words that come again are not encoded again."""

    def __init__(self, a: Side, b: Side, piece: int = PIECE):
        self.a, self.b, self.piece = a, b, piece
        self.cut = WORD_CUT.split if a.cuts and b.cuts else lambda t: [t]
        self.new: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def words(self, wanted: set[str]) -> dict[str, Word]:
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        missing = wanted - self.new.keys()
        known = missing & self.old.keys()
        self.new.update((w, self.old[w]) for w in known)
        missing = list(missing - known)
        at = 0
        while at < len(missing):
            end, size = at, 0
            while end < len(missing) and (end == at or size + len(missing[end]) <= CALL):
                size += len(missing[end])
                end += 1
            self.new.update(zip(missing[at:end], align_words(missing[at:end], self.a, self.b, self.piece)))
            at = end
        return self.new

    def block(self, texts: list[str | None]) -> dict:
        """All about one block: per text n_a, n_b, n_groups, n_links, groups, its distinct pairs (places in the block's list,
        ascending, and how often each is linked), and the block's list of pairs with the number of texts that hold each."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        names = list(set().union(*cut))
        kept = self.words(set(names))
        own = [kept[w] for w in names]
        # A text is aligned if all its words are.
        bad = {w for w, x in zip(names, own) if not x.whole}
        if bad:
            cut = [[] if not bad.isdisjoint(c) else c for c in cut]
        n, sizes = len(texts), np.fromiter(map(len, cut), np.int64, len(texts))
        number = dict(zip(names, range(len(names))))
        word = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(n), sizes)
        groups = {w: x.groups for w, x in zip(names, own)}
        out = {"groups": [";".join(map(groups.__getitem__, c)) for c in cut]}
        counts = {"n_a": [x.n_a for x in own], "n_b": [x.n_b for x in own], "n_groups": [x.n_groups for x in own],
                  "n_links": [len(x.pairs) >> 3 for x in own]}
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for c, of_word in counts.items():
            out[c] = np.diff(np.concatenate([[0], np.cumsum(np.array(of_word, np.int64)[word])])[ends])
        # Words of a text once each with their repeats, then their pairs.
        pairs, places = np.unique(np.frombuffer(b"".join([x.pairs for x in own]), np.int64), return_inverse=True)
        per_word = np.array(counts["n_links"], np.int64)
        starts = np.concatenate([[0], np.cumsum(per_word)])
        held, times = np.unique(text * len(names) + word, return_counts=True)
        text, word = np.divmod(held, max(len(names), 1))
        reach = per_word[word]
        inside = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
        place = places[np.repeat(starts[word], reach) + inside]
        key = np.repeat(text, reach) * max(len(pairs), 1) + place
        order = np.argsort(key, kind="stable")
        key, uses = key[order], np.repeat(times, reach)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        text, place = np.divmod(key[first], max(len(pairs), 1))
        return out | {"offsets": np.searchsorted(text, np.arange(n + 1)).astype(np.int32), "place": place.astype(np.int32),
                      "uses": (np.add.reduceat(uses, first) if len(first) else uses).astype(np.int32),
                      "pairs": pairs, "docs": np.bincount(place, minlength=len(pairs))}


@cache
def aligner(a_file: str, b_file: str) -> Aligner:
    """One per worker process."""
    return Aligner(byte_level(a_file), piece_level(b_file))


def alignments(docs: DataFrame, text: str = "text", key: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE,
               block: int = BLOCK) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``), ``block`` and what
    :func:`with_pair_counts` needs: ``place`` and ``uses`` (distinct pairs as places in the block's list, and their
    links), and, on the block's first row only, ``pairs`` (A id * 2^32 + B id) and ``docs`` (documents of the block)."""
    kind = docs.schema[key].dataType.simpleString()

    def one_block(ids: list, texts: list, number: int):
        # A block makes many small objects and no cycles: looking for some costs a sixth of the time.
        looking = gc.isenabled()
        gc.disable()
        try:
            found = aligner(a_file, b_file).block(texts)
        finally:
            if looking:
                gc.enable()
        none = [None] * (len(ids) - 1)
        lists = [pa.ListArray.from_arrays(pa.array(found["offsets"]), pa.array(found[c])) for c in ("place", "uses")]
        heads = [pa.array([found[c], *none], pa.list_(pa.int64())) for c in ("pairs", "docs")]
        return pa.record_batch(
            [pa.array(ids, arrow_key[0]), *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
             pa.array(found["groups"], pa.string()), pa.array([number] * len(ids), pa.int64()), *lists, *heads],
            [key, "n_a", "n_b", "n_groups", "n_links", "groups", "block", "place", "uses", "pairs", "docs"])

    arrow_key = [pa.int64()]

    def blocks(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            arrow_key[0] = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = len(t or "")
                if ids and size + here > block:
                    yield one_block(ids, texts, number)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += here
        if ids:
            yield one_block(ids, texts, number)

    schema = (f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, block long, "
              "place array<int>, uses array<int>, pairs array<long>, docs array<long>")
    return small_batches(docs.select(F.col(key), F.col(text))).mapInArrow(blocks, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold the pair linked, and whether no pair of the same A id has more."""
    rows = aligned.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "docs")).alias("_p"))
    counts = rows.groupBy(F.col("_p.pairs").alias("pair")).agg(F.sum("_p.docs").alias("count"))
    # At most one row per B id and A id: a group is bounded by the vocabulary.
    same = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("count") == F.max("count").over(same))


def with_pair_counts(aligned: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of :func:`alignments` with n_best and count_sum.

    ``aligned`` must be a written table (:func:`fraudframe.session.materialize`): it is read three times.
    """
    listed = aligned.where(F.col("pairs").isNotNull()).select("block", F.posexplode("pairs").alias("at", "pair"))
    counted = listed.join(pair_counts(aligned), "pair").select("block", "at", "count", "best")
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}

    def met(docs: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at] = counts.column("count").to_numpy()
        best[at] = counts.column("best").to_numpy(zero_copy_only=False)
        docs = docs.combine_chunks()
        place, uses = docs.column("place"), docs.column("uses")
        sizes = place.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        place = place.combine_chunks().flatten().to_numpy()
        uses = uses.combine_chunks().flatten().to_numpy().astype(np.int64)
        out = docs.select(keep)
        for name, value in (("n_best", best), ("count_sum", count)):
            total = np.zeros(len(sizes), np.int64)
            np.add.at(total, of, uses * value[place])
            out = out.append_column(name, pa.array(total))
        return out

    left = aligned.select(F.col("block").alias("_block"), *keep, "place", "uses").groupBy("_block")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_best long, count_sum long"
    return left.cogroup(counted.groupBy("block")).applyInArrow(met, schema)


def align(docs: DataFrame, text: str = "text", key: str = "doc_id", a_file: str = A_FILE, b_file: str = B_FILE,
          digest: dict | None = None) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    ``digest`` maps names to columns made of ``groups``; given, they are kept instead of ``groups`` itself, which is
    the larger part of what is written between the passes.
    """
    found = alignments(docs, text, key, a_file, b_file)
    last = ["groups"]
    if digest is not None:
        found, last = found.withColumns(digest).drop("groups"), list(digest)
    return with_pair_counts(materialize(found, "align"), [key, "n_a", "n_b", "n_groups", "n_links", *last])
