"""Fill-in-middle: every text is cut at two unit boundaries and its parts are written in another order.

A unit is a run of white space with the word behind it (white space at the end is a unit of its
own).  Both cuts are unit numbers drawn from the document's id.  To find a cut's place, the text's
UTF-8 bytes are divided into blocks of ``BLOCK`` bytes; a Fenwick tree over the blocks stores how
many units end in a block and how many code points begin in it.  A binary-lifting descent finds the
block where the wanted unit ends, with the units and code points before it, and only that block is
searched for the boundary.  Byte places cut the text, code points are what is reported.

Drawn per document from the SHA-256 of ``seed:doc_id`` (four numbers h1..h4): the prefix ends after the
smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger; the text stays plain if
h3 % 100 >= ``rate``, and has the suffix first (spm) if h4 % 100 < ``spm_rate``, else the prefix (psm).
A text that holds one of the marks stays plain, so :func:`restore` is exact: no mark may overlap the
end of another, hence the first mark found is the one that was written.

Defined results: null text is empty and plain with n = 0; a null id draws as the empty id; equal ids
draw alike, so repeated rows give repeated results; texts of any length are cut whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SEED = 42
#: Percent of the texts that are transformed, and of those the percent with the suffix first.
RATE, SPM_RATE = 50, 80
#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text per leaf of the tree.
BLOCK = 4096
PLAIN, PSM, SPM = "plain", "psm", "spm"


class BlockTree:
    """Fenwick tree over fixed blocks of a UTF-8 text, with two counts per node: unit ends and code points."""

    def __init__(self, raw: bytes, block: int = BLOCK):
        text = np.frombuffer(raw, np.uint8)
        space = (text == 32) | ((text >= 9) & (text <= 13))
        #: A unit ends where a word ends; what white space is left at the end of the text is one more unit.
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        if len(text):
            self.ends[-1] = True
        self.begins = (text & 0xC0) != 0x80
        self.block = block
        starts = np.arange(0, len(text), block)
        self.leaves = len(starts)
        self.units = self._tree(self.ends, starts)
        self.points = self._tree(self.begins, starts)
        self.n = int(np.count_nonzero(self.ends))

    @staticmethod
    def _tree(flags: np.ndarray, starts: np.ndarray) -> list[int]:
        leaf = np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(leaf)])
        node = np.arange(1, len(leaf) + 1)
        # Node i covers the last (i & -i) leaves up to i.
        return [0, *(before[node] - before[node - (node & -node)]).tolist()]

    def boundary(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before the end of the ``unit``-th unit (0: the beginning of the text)."""
        if unit <= 0:
            return 0, 0
        at, points = 0, 0
        step = 1 << (self.leaves.bit_length() - 1)
        while step:
            there = at + step
            if there <= self.leaves and self.units[there] < unit:
                at, unit, points = there, unit - self.units[there], points + self.points[there]
            step >>= 1
        start = at * self.block
        end = start + int(np.flatnonzero(self.ends[start:start + self.block])[unit - 1]) + 1
        return end, points + int(np.count_nonzero(self.begins[start:end]))


def draws(doc_id, seed: int = SEED) -> tuple[int, ...]:
    """h1..h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4))


def transform_text(text: bytes, doc_id, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   marks: tuple[bytes, ...] = tuple(m.encode() for m in MARKS), block: int = BLOCK):
    """(n, form, prefix_chars, middle_chars, output) of one UTF-8 text."""
    tree = BlockTree(text, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return tree.n, PLAIN, None, None, text
    first, second = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (cut, prefix_chars), (end, points) = tree.boundary(first), tree.boundary(second)
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    p, s, m = marks
    if h4 % 100 < spm_rate:
        form, parts = SPM, (s, suffix, p, prefix, m, middle)
    else:
        form, parts = PSM, (p, prefix, s, suffix, m, middle)
    return tree.n, form, prefix_chars, points - prefix_chars, b"".join(parts)


def _checked(marks) -> None:
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"the end of mark {a!r} is the beginning of {b!r}, or one holds the other")


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per document: key, n, form, prefix_chars, middle_chars, output (the transformed text)."""
    _checked(marks)
    coded = tuple(m.encode() for m in marks)
    kind = docs.schema[key].dataType.simpleString()

    def batches(found):
        for batch in found:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            rows = [transform_text(t.as_py() or b"", i.as_py(), seed, rate, spm_rate, coded) for i, t in zip(ids, texts)]
            n, form, prefix, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                                   pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                                  [key, "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return small_batches(docs.select(F.col(key), F.col(text))).mapInArrow(batches, schema)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`transform` made ``output`` of."""
    p, s, m = marks

    def between(after: str, before: str) -> Column:
        return F.substring_index(F.substring_index(output, after, -1), before, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
