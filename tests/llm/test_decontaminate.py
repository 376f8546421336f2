"""Benchmark decontamination against a brute-force version over all windows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fraudframe.llm import decontaminate as dc

from .test_tables import frame, odd_rows

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(dc.UPPER, dc.LOWER)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_result(text, items, window=10):
    words, hit, held = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        for i in range(max(1, len(own) - window + 1)) if own else ():
            w = own[i:i + window]
            for at in range(len(words) - len(w) + 1):
                if words[at:at + len(w)] == w:
                    hit.update(range(at, at + len(w)))
                    held.add("" if name is None else str(name))
    return len(words), len(hit), sorted(held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é日.\x00\n_", max_size=40), max_size=5))
def test_words(texts):
    scan = dc.scan_of([t.encode() for t in texts])
    want = [w.encode() for t in texts for w in words_of(t)]
    assert [scan.words(i, 1) for i in range(len(scan.starts))] == want
    assert scan.n_words.tolist() == [len(words_of(t)) for t in texts]
    by_hash = dict(zip(scan.hashes.tolist(), want))
    assert len(by_hash) == len(set(want)) and all(by_hash[h] == w for h, w in zip(scan.hashes.tolist(), want))


def test_long_words_have_hashes_of_their_own():
    texts = [b"a" * n for n in (1, 63, 64, 65, 66, 5000)] + [b"a" * 64 + b"b", b"b" + b"a" * 64]
    assert len(set(dc.scan_of(texts).hashes.tolist())) == len(texts)


def fixture(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 11, 14, 30])))) for i in range(25)]
    items = [x for x in items if len(words_of(x[1])) > 2 or x[0] == 3] + [
        (100, "same words as item 101 but in another row of it yes"), (101, "Same words, as item 101 but in another ROW of it: yes"),
        (None, "an item without any name but with eleven words in it ok"), (102, None), (103, "... !!"), (104, ""), (104, "one more text of item 104")]
    docs = odd_rows()
    for i in range(20, 60):
        name, text = rng.choice(items)
        own = words_of(text)
        k = rng.randrange(len(own) + 1)
        parts = own[max(0, k - rng.choice([4, 9, 10, 12])):k + rng.choice([0, 5, 10])]
        noise = [rng.choice("a b c d e f x y z".split()) for _ in range(rng.randrange(30))]
        docs.append((i, "; ".join(noise[:7] + parts + noise[7:] + own * (i % 3 == 0)).upper() if i % 2 else " ".join(noise + parts), "s"))
    return docs, items


def results(found):
    rows = found.select("doc_id", "n_words", dc.hit_words(found["hits"]).alias("n"), "items").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n"], list(r["items"])) for r in rows), key=str)


def test_equals_brute_force_in_one_and_in_many_blocks(spark):
    docs, items = fixture(7)
    want = sorted(((i, *plain_result(t, items)) for i, t, _ in docs), key=str)
    assert sum(bool(w[3]) for w in want) > 10
    left = frame(spark, docs).repartition(3)
    right = spark.createDataFrame([(i, t, 1, [2]) for i, t in items], "item_id long, text string, doc_id int, words array<int>")
    assert results(dc.decontaminate(left, right)) == want
    assert results(dc.decontaminate(left, right, block_windows=20)) == want


def test_empty_tables(spark):
    docs, items = fixture(1)
    right = spark.createDataFrame(items, "item_id long, text string")
    assert dc.decontaminate(frame(spark, docs).limit(0), right).count() == 0
    clean = results(dc.decontaminate(frame(spark, docs), right.limit(0)))
    assert clean == sorted(((i, len(words_of(t)), 0, []) for i, t, _ in docs), key=str)


def test_prefix_is_the_rarest_shingle():
    windows = dc.Windows(["a b c d e f g h i j", "x y"])
    places = np.array([5, 3, 9, 3, 7, 8, 2])
    assert windows.prefixes(places) == {1: [(0, 1)], 6: [(1, 0)]}
    places[6] = 0  # a window whose shingles are not all in the corpus has no candidates
    assert windows.prefixes(places) == {1: [(0, 1)]}
