"""Fill-in-middle: the block tree against a plain scan, the transform against a plain restatement."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fraudframe.llm import fim, queries

from .test_tables import SF, frame, odd_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_transform(text, doc_id):
    text, units = text or "", UNIT.findall(text or "")
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or any(m in text for m in fim.MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é日\U0001F600\t\n\x0b\xa0 <P>", max_size=80), st.integers(1, 9))
def test_boundaries(text, block):
    units, tree = UNIT.findall(text), fim.BlockTree(text.encode(), block)
    assert tree.n == len(units)
    for k in range(len(units) + 1):
        before = "".join(units[:k])
        assert tree.boundary(k) == (len(before.encode()), len(before))


def test_transform_equals_plain_restatement():
    rng = random.Random(4)
    seen = set()
    for doc_id in [None, *range(400)]:
        text = "".join(rng.choice(["a", "é", " ", "\n", "word", "日本", "<", "<P>" if doc_id and doc_id % 9 == 0 else "x"])
                       for _ in range(rng.randrange(40)))
        n, form, prefix, middle, out = fim.transform_text(text.encode(), doc_id, block=5)
        assert (n, form, prefix, middle, out.decode()) == plain_transform(text, doc_id)
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_very_long_text():
    text = "wört  " * 700_000
    ids = [i for i in range(40) if plain_transform("a b", i)[1] != "plain"][:2]
    for i in ids:
        n, form, prefix, middle, out = fim.transform_text(text.encode(), i)
        assert (n, form, prefix, middle, out.decode()) == plain_transform(text, i)


def test_query_on_odd_rows(spark):
    rows = odd_rows() + [(i, "The <S> mark\nstays" if i % 2 else " two  words é ", "a") for i in range(20, 60)]
    made = fim.transform(frame(spark, rows)).select("*", fim.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    want = sorted(((i, *plain_transform(t, i), t or "") for i, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in made), key=str) == want
    assert fim.transform(frame(spark, rows).limit(0)).count() == 0


def test_other_marks_and_rates(spark):
    marks = ("[pre]", "[suf]", "[mid]")
    docs = frame(spark, [(i, f"some <P> words [ of text {i}", "a") for i in range(50)])
    made = fim.transform(docs, rate=100, spm_rate=0, marks=marks)
    rows = made.join(docs.select("doc_id", "text"), "doc_id").select(
        "*", fim.restore(F.col("output"), F.col("form"), marks).alias("restored")).collect()
    assert len(rows) == 50 and all(r["restored"] == r["text"] and r["form"] == "psm" and r["output"].startswith("[pre]") for r in rows)
    with pytest.raises(ValueError):
        fim.transform(docs, marks=("ab", "bc", "cd"))


def test_query_round_trip(spark):
    rows = queries.op11_fill_in_middle(spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, out = plain_transform(docs[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(out.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
