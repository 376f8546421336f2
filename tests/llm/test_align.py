"""Cross-tokenizer alignment against a brute-force version that walks over bytes."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fraudframe.llm import align, queries

from .test_tables import SF, frame, odd_rows


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(align.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)


def plain_alignment(text, encoders):
    """(A ids, B ids, groups as text, linked id pairs with repeats) of one text, token by token."""
    a, b = encoders
    want = (" " + text).encode() if text else b""
    signs = align.byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], [], "", []
    own_a = [k for k, s in enumerate(bytes_a) for _ in s]
    own_b = [k for k, s in enumerate(bytes_b) for _ in s]
    links = sorted(set(zip(own_a, own_b)))
    groups, at_a, at_b = [], 0, 0
    for x in range(len(want)):
        last = x + 1 == len(want)
        if last or (own_a[x] != own_a[x + 1] and own_b[x] != own_b[x + 1]):
            to_a, to_b = own_a[x] + 1, own_b[x] + 1
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            at_a, at_b = to_a, to_b
    return ids_a, ids_b, ";".join(groups), [(ids_a[i], ids_b[j]) for i, j in links]


def plain_query(rows, encoders):
    found = [(i, *plain_alignment(t, encoders)) for i, t in rows]
    docs = Counter(p for *_, pairs in found for p in set(pairs))
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [(i, len(a), len(b), groups.count("|"), len(pairs), sum(docs[p] == best[p[0]] for p in pairs),
             sum(docs[p] for p in pairs), groups) for i, a, b, groups, pairs in found]


ends = st.sets(st.integers(1, 60), max_size=40).map(lambda s: sorted(s | {61}))


@settings(max_examples=300, deadline=None)
@given(ends, ends, st.integers(1, 30))
def test_pieces_equal_brute_force(a, b, piece):
    starts_a, starts_b = [0, *a], [0, *b]
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]
    groups = [(a.index(e) + 1, b.index(e) + 1) for e in a if e in b]
    la, lb, ga, gb = align.align_ends(np.array(a), np.array(b), piece)
    assert list(zip(la.tolist(), lb.tolist())) == links
    assert list(zip(ga.tolist(), gb.tolist())) == groups


def test_pieces_are_equal_work():
    a, b = np.arange(1, 50_001) * 3, np.array([150_000])
    i, j = align.diagonals(a, b, 1000)
    assert set(np.diff(i + j).tolist()[:-1]) == {1000} and i[-1] == len(a) and j[-1] == 1


def test_word_cuts_do_not_change_ids(encoders):
    rng = random.Random(3)
    bits = [" ", "  ", " ", "\n", "\t", "a", "é", "Word", "'s", "!", "\x1c", "\xa0", "12", "<|endoftext|>", "ß", "日本", "\x85", "٣", "ⅷ", "\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    side = align.Aligner(align.byte_level(align.A_FILE), align.piece_level(align.B_FILE))
    assert side.a.cuts and side.b.cuts and sum(len(side.cut(" " + t)) > 2 for t in texts) > 500
    for t in texts:
        cut = side.cut(" " + t)
        assert [i for ids in side.a.encode(cut) for i in ids] == encoders[0].encode(" " + t, add_special_tokens=False).ids
        assert [i for ids in side.b.encode(cut) for i in ids] == encoders[1].encode(t)


def test_blocks_equal_plain_alignment_with_and_without_cuts(encoders):
    texts = [r[1] for r in odd_rows()[:-4]] + ["one two  two one", "日本語 text", "a", " ", "  lead and trail  "]
    a, b = align.byte_level(align.A_FILE), align.piece_level(align.B_FILE)
    for cuts in (True, False):
        one = align.Aligner(a, align.Side(b.encode, b.spelled, cuts), piece=7)
        found = one.block(texts)
        for i, t in enumerate(texts):
            ids_a, ids_b, groups, pairs = plain_alignment(t, encoders)
            assert (found["n_a"][i], found["n_b"][i], found["n_links"][i], found["groups"][i]) == (len(ids_a), len(ids_b), len(pairs), groups)
            at = slice(found["offsets"][i], found["offsets"][i + 1])
            got = {(p >> 32, p & 0xFFFFFFFF): u for p, u in zip(found["pairs"][found["place"][at]].tolist(), found["uses"][at].tolist())}
            assert got == Counter(pairs)


def test_kept_words_hold_on_to_nothing_else(encoders, monkeypatch):
    """A word that stays does not keep the arrays of all words it was first aligned with."""
    monkeypatch.setattr(align, "KEPT_WORDS", 400)
    side = align.Aligner(align.byte_level(align.A_FILE), align.piece_level(align.B_FILE))
    held = []
    tracemalloc.start()
    try:
        for k in range(60):
            # One word of every block before, and many that never come again.
            side.block([" ".join([*(f"stays{i}" for i in range(k + 1)), *(f"once{k}x{i}" for i in range(1000))])])
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert len(side.new) + len(side.old) < 2400 and held[-1] < 1.25 * held[9]


def test_query_on_odd_rows(spark, encoders):
    texts = odd_rows() + [(20, "special <|endoftext|> and <s> </s> <unk> strings", "a"), (21, "a ▁mark is no space", "a"),
                          (22, "zero\x00byte and \U0001F600 日本語", "a"), (23, "ﬁ ligature", "b"), (24, " two  spaces ", "b"),
                          (25, "<0x41>", "c")]
    docs = frame(spark, texts)
    for block in (1 << 24, 40):
        aligned = align.with_pair_counts(
            align.materialize(align.alignments(docs.repartition(3), block=block), "t"),
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
        got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in aligned.collect()]
        assert sorted(got, key=str) == sorted(plain_query([(i, t) for i, t, _ in texts], encoders), key=str)
    assert align.align(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, encoders):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in plain_query(rows, encoders))
    got = sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                 for r in queries.op12_tokenizer_alignment(spark, SF).collect())
    assert got == want
