"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The text is marked (a leading mark, spaces become marks) and cut where no piece can cross: before
a mark that follows a non-mark, and around line ends.  The distinct words of a batch are sorted, which lays them out as
a trie, and walked depth-first: the forward state of a position depends on the prefix before it
only, so a word starts from the states of the prefix it shares with the word before.

The forward state of a prefix is its last piece and the position that piece starts at.  The given file is
a merge model, for which the best segmentation is the one the merges give, and a segmentation is
exactly that if each two neighbouring pieces would be merged into themselves; so a state holds the one piece
that ends there and passes this test against the state at its start, and no score.  The ids are those of the reference
implementation of the model file, which the tests compare.  Only merge models are supported: a unigram
file would need scores in its states.

Words, not texts, are the unit of work, and no text is ever cut short.  What stands between two spaces is
looked up whole before it is cut further, and ids are kept as packed bytes, so a text's ids are
one join of what its parts have.  Decoding joins pieces, byte pieces through UTF-8, and drops the
leading mark.

Defined results: null and empty text encode to no ids and decode to the empty text; a null id stays
null; repeated rows give repeated results; an empty table gives an empty result; other columns are
kept by :func:`encode` and ignored by the query.  A mark character in the text decodes to a space,
as the model file defines it.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
SIGNS = ".,;:!?*$#%&"
#: Encoded words and their characters a worker keeps between batches, in each of two generations (a memory bound only).
KEPT_WORDS, KEPT_CHARS = 300_000, 12_000_000


class Pieces:
    """Vocabulary of a model file and the trie walk over it."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.byte = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_ids = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(n) if i not in self.special and i not in self.byte_ids and not model.is_unused(i)]
        self.ids = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: model.get_score(i) for i in plain}
        self.unknown = model.unk_id()
        crossing = re.compile(f"[^{MARK}]{MARK}")
        # Further exact cuts: around control characters that stand in no longer piece, and between a
        # letter and a sign that no piece holds side by side.
        lone = "".join(c for c in "\t\n\r" if not any(c in p for p in self.ids if len(p) > 1))
        after = {m for p in self.ids for m in re.findall(f"(?<={LETTER})[{re.escape(SIGNS)}]", p)}
        signs = re.escape("".join(c for c in SIGNS if c not in after))
        rest = f"{MARK}*[^{MARK}{lone}]+|{MARK}+" + (f"|[{lone}]+" if lone else "")
        self.word = re.compile((f"{MARK}*{LETTER}++(?=[{signs}])|" if signs else "") + rest)
        #: Where single spaces stand between parts, each part (a mark in front) may be cut by itself.
        self.apart = not any(crossing.search(p) for p in self.ids)
        if not self.apart:
            self.word = re.compile(".+", re.S)  # a piece may cross a mark: the text is one word
        #: Pieces as a trie of characters read backwards: character -> (next, the piece that ends
        #: there, what is known of its left neighbours: left piece -> fits).
        ending = {p[::-1] for p in self.ids}
        inner = {p[:k] for p in ending for k in range(1, len(p) + 1)}
        nodes: dict[str, tuple] = {p: ({}, p[::-1] if p in ending else "", {}) for p in inner}
        self.trie: dict[str, tuple] = {}
        for p, node in nodes.items():
            (nodes[p[:-1]][0] if len(p) > 1 else self.trie)[p[-1]] = node
        #: Texts of ids: ASCII bytes are themselves, special ids nothing; other bytes need UTF-8.
        self.texts = ["" if i in self.special else chr(self.byte_ids[i]) if i in self.byte_ids else
                      self.names[i].replace(MARK, " ") for i in range(n)]
        self.high = frozenset(i for i, v in self.byte_ids.items() if v >= 128)
        #: Packed ids of words and of whole parts between spaces.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals; used for pairs of pieces only."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def pair_fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def walk(self, words) -> dict[str, list[int]]:
        """Ids of distinct words: sorted, then depth-first over their shared prefixes."""
        out, before, trie, known = {}, "", self.trie, self.ids
        last, since = [""], [0]  # forward states: the last piece of each prefix and where it starts
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], since[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                children, at = trie, end
                while at:
                    at -= 1
                    node = children.get(word[at])
                    if node is None:
                        at = 0
                        break
                    children, piece, fits = node
                    if piece:
                        left = last[at]
                        ok = fits.get(left)
                        if ok is None:
                            ok = fits[left] = self.pair_fits(left, piece)
                        if ok:
                            break
                else:
                    ok = False
                if node is not None and ok:
                    last.append(piece)
                    since.append(at)
                else:  # not in the vocabulary: one character by itself
                    last.append(word[end - 1])
                    since.append(end - 1)
            ids, at = [], len(word)
            while at:
                piece, at = last[at], since[at]
                got = known.get(piece)
                if got is not None:
                    ids.append(got)
                elif self.byte:
                    ids.extend(self.byte[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
                else:
                    ids.append(self.unknown)
            ids.reverse()
            out[word], before = ids, word
        return out

    def cut(self, text: str) -> list[str]:
        """The marked text in parts that no piece crosses: between single spaces, else in words."""
        if not text:
            return []
        if not self.apart or text[0] == " " or "  " in text or MARK in text:
            return self.word.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK)).split(" ")

    def encode_packed(self, texts) -> list[bytes]:
        """The ids of every text as 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        if len(self.kept) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.older, self.kept, self.chars = self.kept, {}, 0
        kept, older = self.kept, self.older
        fresh = self._known(set().union(*cut) - kept.keys())
        if self.apart:  # a word is cut into itself
            words = {p: self.word.findall(p) for p in fresh}
            inner = {w for own in words.values() if len(own) > 1 for w in own}
            inner.update(own[0] for own in words.values() if len(own) == 1)
            fresh = self._known(inner - kept.keys())
        else:
            words = {}
        for w, ids in self.walk(fresh).items():
            kept[w] = array("i", ids).tobytes()
        self.chars += sum(map(len, fresh))
        for p, own in words.items():
            if p not in kept:
                kept[p] = b"".join(map(kept.__getitem__, own))
                self.chars += len(p)
        return [b"".join(map(kept.__getitem__, c)) for c in cut]

    def _known(self, missing: set[str]) -> set[str]:
        """Those that the generation before does not have either; the others are taken over."""
        known = missing & self.older.keys()
        self.kept.update((w, self.older[w]) for w in known)
        self.chars += sum(map(len, known))
        return missing - known

    def encode_batch(self, texts) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.encode_packed(texts)]

    def decode(self, ids) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
        else:
            out, pending = [], bytearray()
            for i in ids:
                if i in self.high:
                    pending.append(self.byte_ids[i])
                    continue
                out += [pending.decode("utf-8", "replace"), self.texts[i]]
                pending.clear()
            out.append(pending.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if text[:1] == " " else text


@cache
def pieces(path: str) -> Pieces:
    """One vocabulary per worker process."""
    return Pieces(path)


def encoded(text: Column, model: str = MODEL) -> Column:
    @F.arrow_udf("array<int>")
    def piece_ids(s: pa.Array) -> pa.Array:
        # A batch makes many small objects and no cycles: looking for some costs an eighth of the time.
        looking = gc.isenabled()
        gc.disable()
        try:
            packed = pieces(model).encode_packed([t or "" for t in s.to_pylist()])
        finally:
            if looking:
                gc.enable()
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) >> 2)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))
    # Said to vary, so that Spark does not run it once more for every column made of the ids.
    return piece_ids.asNondeterministic()(text)


def decoded(ids: Column, model: str = MODEL) -> Column:
    @F.arrow_udf("string")
    def piece_text(s: pa.Array) -> pa.Array:
        ids = s.flatten().to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
        decode = pieces(model).decode
        return pa.array([decode(ids[a:b]) for a, b in zip([0, *ends], ends)], pa.string())
    return piece_text(ids)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """All columns and ``token_ids``, ``n_tokens``."""
    out = small_batches(docs).withColumn("token_ids", encoded(F.col(text), model))
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


def decode(coded: DataFrame, ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """All columns and ``decoded``, the text of ``ids``."""
    return small_batches(coded).withColumn("decoded", decoded(F.col(ids), model))
