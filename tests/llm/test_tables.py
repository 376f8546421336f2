"""Training-data operators over tables: brute force on small fixtures and the defined edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fraudframe.llm import (common, cws, embeddings, html_text, licenses, mixing, pieces, pii, queries, secrets, simhash,
                            toxicity)

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, row string, id string, fp string, v string, k int, "
          "size int, target string, _pid int")


def frame(spark, rows):
    """Documents with a good many columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "i", "f", "v", 1, 2, "t", 3) for i, t, s in rows], SCHEMA)


def odd_rows():
    long = "lorem ipsum dolor " * 20_000
    return [(1, "the quick brown fox jumps over the lazy dog again", "a"), (2, "the quick brown fox jumps over the lazy dog again", "b"),
            (2, "the quick brown fox jumps over the lazy dog again", "b"), (3, None, None), (4, "", "a"), (5, "  \n", None),
            (None, "the quick brown fox jumps over the lazy dog again", "a"), (None, None, None), (7, long, "c"), (8, long + "x", "c"),
            (9, "one", "c"), (10, "password=abcdefghijkl mail a@b.co All rights reserved.", "a")]


def groups_by_brute_force(fps, distance):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


# ---- components ------------------------------------------------------------------------------

def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [
        (2000, i) for i in range(2001, 2080)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- 1 SimHash -------------------------------------------------------------------------------

def near_copies():
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base[: 120 + i % 3])
        for at in rng.integers(0, 120, i % 5):
            words[at] = "changed"
        rows.append((i, " ".join(words), "a"))
    rows += [(100 + i, " ".join(rng.choice(base, 30)), "b") for i in range(40)]
    return rows + odd_rows()


@pytest.mark.parametrize("segments", [simhash.SEGMENTS, simhash.TWO_SEGMENTS])
def test_simhash_groups(spark, segments):
    rows = near_copies()
    got = simhash.simhash_groups(frame(spark, rows), segments=segments).collect()
    want_fp = [simhash.fingerprint(t) & (2 ** 64 - 1) for _, t, _ in rows]
    roots = groups_by_brute_force(want_fp, 4)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = Counter((i, f"{f:016x}", least.get(r)) for (i, _, _), f, r in zip(rows, want_fp, roots))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert max(Counter(roots).values()) > 10  # the fixture does hold groups


def test_simhash_dedup_keeps_one_of_each_group(spark):
    rows = near_copies()
    docs = frame(spark, rows)
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    roots = groups_by_brute_force([simhash.fingerprint(t) & (2 ** 64 - 1) for _, t, _ in rows], 4)
    least = defaultdict(list)
    for (i, _, _), r in zip(rows, roots):
        least[r].append((i is None, i))
    assert Counter(got) == Counter(min(v, key=lambda x: (x[0], x[1] or 0))[1] for v in least.values())


# ---- 2 licenses ------------------------------------------------------------------------------

def test_license_scan(spark):
    notes = licenses.TEMPLATES
    noise = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(100 + k, noise * k + t + " " + noise * (k % 3), "a") for k, t in enumerate(notes.values())]
    rows += [(200 + k, noise * 7 + t.upper().replace(" ", "\n ") + " " + noise, "a") for k, t in enumerate(notes.values())]
    changed = notes["mit-grant"].replace("without restriction", "without limits")
    rows += [(300, noise + changed, "a"), (301, notes["mit-grant"][:60], "a"), (302, "rights all reserved", "a")] + odd_rows()
    got = defaultdict(list)
    for r in licenses.scan(frame(spark, rows)).collect():
        got[r["doc_id"]].append((r["n_licenses"], r["licenses"]))
    names = list(notes)
    for k, n in enumerate(names):
        for base in (100, 200):
            assert n in got[base + k][0][1].split(","), n
    # Longer notices may hold shorter ones word for word, nothing else may be added.
    plain = {n: " ".join(re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", t.lower())) for n, t in notes.items()}
    for k, n in enumerate(names):
        assert set(got[100 + k][0][1].split(",")) == {m for m in names if plain[m] in plain[n]}, n
    assert got[300] == [(1, "mit-grant")] and got[301] == got[302] == [(0, "")]
    assert got[10] == [(1, "all-rights-reserved")] and sum(map(len, got.values())) == len(rows)


# ---- 3, 5, 7, 10: row by row ------------------------------------------------------------------

def test_row_wise_queries_equal_their_row_functions(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, SF).collect():
        base, found = pii.find_pii(docs[r["doc_id"]])
        text = [",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (base, found)]
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(text[0].encode()).hexdigest(), text[1])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
    assert queries.op3_pii(spark, SF).agg(F.sum("n_email")).first()[0] > 0
    for r in queries.op7_secret_scan(spark, SF).collect():
        found = secrets.find_secrets(docs[r["doc_id"]])
        text = [",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in ([s for s in found if s[2] in secrets.BASE], found)]
        assert (r["base_sha256"], r["spans"]) == (hashlib.sha256(text[0].encode()).hexdigest(), text[1])
    assert queries.op7_secret_scan(spark, SF).agg(F.sum("n_hex")).first()[0] > 0
    coded = queries.op5_sentencepiece(spark, SF)
    assert coded.where("not round_trip").count() == 0 and coded.where("n_tokens > 0").count() == len(docs)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op10_html_text(spark, SF).collect():
        assert r["text"] == html_text.main_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        assert r["text"].count("\n") < len(re.split(r"</?(?:p|h1)>", article))


def test_row_wise_edge_cases(spark):
    docs = frame(spark, odd_rows())
    none = docs.limit(0)
    for op in (lambda d: pii.scan(d), lambda d: secrets.scan(d), lambda d: pieces.decode(pieces.encode(d)), secrets.redact):
        assert op(docs).count() == len(odd_rows()) and op(none).count() == 0
    red = secrets.redact(docs)
    assert red.columns == docs.columns
    r = red.where("doc_id = 10").first()
    assert r["text"].startswith(secrets.MARK + " mail") and r["n_chars"] == len(r["text"])
    assert red.where("doc_id = 3").first()["text"] is None and red.where("doc_id = 7").first()["n_chars"] == 360_000
    back = pieces.decode(pieces.encode(docs)).where("doc_id is null or doc_id <> 3")
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    pages = spark.createDataFrame([(1, "u", None, 5), (None, None, "<p>a", 6), (2, "u", "", 7), (2, "u", "", 7)],
                                  "page_id long, url string, html string, text int")
    got = html_text.extract(pages)
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), ("", 0), ("", 0), ("a", 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


# ---- 4 mixing --------------------------------------------------------------------------------

def plain_targets(sizes):
    """The rule as stated: stop at the cap, share the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            out.update((s, weight[s] * level) for s in open_)
            break
        out.update((s, 2.0 * sizes[s]) for s in full)
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def mix_rows():
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", "é", "Z"], 300, p=[
        .4, .2, .2, .1, .05, .05]))]
    odd = [(i if i is None else i + 1000, t, s) for i, t, s in odd_rows()[:-4]]
    return rows + odd + [(900, "", "empty"), (901, None, "empty")]


def test_mix_schedule(spark):
    rows = mix_rows()
    got = mixing.schedule(frame(spark, rows)).collect()
    words = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, words):
        sizes[s] += n
    goal = plain_targets(sizes)
    source = {}
    for i, _, s in rows:
        source.setdefault(i, s)
    taken, most = Counter(), defaultdict(int)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
            taken[s] += r["taken"]
            most[s] = max(most[s], r["size"])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, words))
    for s in ("b", "c", "d", "é", "Z"):
        assert abs(taken[s] - goal[s]) <= 2 * most[s]
    total = sum(r["taken"] for r in got)
    assert total <= 1.5 * sum(words) < total + 2 * max(words)
    again = mixing.schedule(frame(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_emits_documents_as_often_as_taken(spark):
    rows = mix_rows()
    docs = frame(spark, rows)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in out.collect())
    plan = Counter()
    for r in mixing.schedule(docs).collect():
        plan[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert times == +plan
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.schedule(docs.limit(0)).count()
    blank = frame(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.mix(blank).count() == 0 and {r["taken"] for r in mixing.schedule(blank).collect()} == {0}


# ---- 6 embeddings ----------------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 48))
    y = [x[i % 40] + 0.25 * rng.standard_normal(48) * rng.random() for i in range(500)]
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate([*x, *y, *[x[0] * s for s in (1, 1, 1, 2.5, 1e-3)]])]
    rows += [(None, [float(c) for c in x[1]], 1), (2000, None, 1), (2001, [0.0] * 48, 1), (2002, [float("nan")] * 48, 1),
             (2003, [None] * 48, 1), (2004, [float("inf")] * 48, 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1),
             (2005, [1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("cell", [embeddings.CELL, 16])
def test_embedding_links(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    got = embeddings.embedding_links(df).collect()
    ok = [i for i, (_, v, _) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, parent = Counter(), list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for i in ok:
        for j in ok:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    want = Counter((k, links[i], least.get(find(i)), k == least.get(find(i))) for i, (k, _, _) in enumerate(rows))
    found = Counter(map(tuple, got))
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(links.values()) > 0
    assert sum((want & found).values()) >= 0.97 * len(rows) and len(got) == len(rows)
    assert embeddings.embedding_links(df.limit(0)).count() == 0


# ---- 5 pieces --------------------------------------------------------------------------------

def test_texts_are_encoded_once(spark):
    """Decoding reads the ids, it does not encode the text again."""
    coded = pieces.decode(pieces.encode(frame(spark, odd_rows() + [(30, " a  b ", "s"), (31, "a \n b.c,d ", "s"), (32, "x\u2581y z", "s")])))
    plan = coded.select("doc_id", "n_tokens", F.md5("decoded"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("piece_ids(") == 1
    model = pieces.pieces(pieces.MODEL)
    for r in coded.collect():
        assert r["token_ids"] == model.encode_batch([r["text"] or ""])[0] and r["n_tokens"] == len(r["token_ids"])
        assert r["decoded"] == (r["text"] or "").replace("\u2581", " ")


# ---- 8 fingerprints --------------------------------------------------------------------------

def test_fingerprints(spark):
    rows = [(r["doc_id"], r["text"], "s") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows = [r for r in rows if r[0] > 20] + odd_rows()
    got = cws.neighbour_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    single = Counter(i for i, _, _ in rows)
    distinct = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    by_id = {(None if m else i): k for k, (m, i, _) in enumerate(distinct) if single[None if m else i] == 1}

    def bag(t):
        return Counter(WORD.findall(t))

    def jaccard(a, b):
        return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
    errors, seen = [], defaultdict(set)
    for r in got:
        if r["doc_id"] not in by_id:
            continue
        k = by_id[r["doc_id"]]
        text, after = distinct[k][2], distinct[(k + 1) % len(distinct)]
        if after[0]:
            continue  # the order of equal (null) ids is by hash
        n = len(text)
        edited = text[: n - n // 2] + after[2][: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r["near_edited"] - jaccard(bag(text), bag(edited)), r["near_next"] - jaccard(bag(text), bag(after[2]))]
        seen[text].add(r["fingerprint"])
    assert all(len(v) == 1 for v in seen.values())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09
    assert cws.neighbour_fingerprints(frame(spark, []).limit(0)).count() == 0
    one = cws.neighbour_fingerprints(frame(spark, [(1, "a b c d", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest() and one["near_next"] == 1.0


def test_weighted_collision_rate(spark):
    texts = [(1, "a " * 30 + "b " * 10 + "c"), (2, "a " * 10 + "b " * 30 + "d"), (3, "a " * 30 + "b " * 10 + "c")]
    df = spark.createDataFrame(texts, "id long, text string")
    s = {r["id"]: r["signature"] for r in cws.signatures(df, ["id"], samples=96).collect()}
    same = sum(x == y for x, y in zip(s[1], s[2])) / 96
    assert s[1] == s[3] and abs(same - 20 / 62) < 0.15  # unweighted Jaccard would be 0.5


def test_fingerprints_are_whole(spark):
    """64 samples of 32 bits each, over words with A-Z lowered; both sides as if signed alone."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words).upper(), "s"), (2, " ".join(words), "s"), (3, "É " + " ".join(words[:9]), "s"), (4, "é " + " ".join(words[:9]), "s"),
            (5, "   ", "s"), (6, "a b c d", "s")]
    got = {r["doc_id"]: r for r in cws.neighbour_fingerprints(frame(spark, rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[1]["near_next"] == 1.0 > got[1]["near_edited"]
    assert re.fullmatch("[0-9a-f]{512}", got[1]["fingerprint"]) and got[3]["near_next"] < 1.0
    samples = {got[1]["fingerprint"][i:i + 8] for i in range(0, 512, 8)}
    assert len(samples) == 64 and len({s[:4] for s in samples}) > 55 and len({s[4:] for s in samples}) > 55
    assert got[5]["fingerprint"] == "-" and got[5]["near_next"] == 0.0 and got[6]["near_edited"] < 1.0
    texts = spark.createDataFrame([(1, " ".join(words[:120]), "w3 " * 4 + " ".join(words[50:])), (2, "x", " "), (3, " ", "x y")],
                                  "id long, text string, edited string")
    both = {r["id"]: r for r in cws.side_signatures(texts, ["id"], {"own": F.col("text"), "edit": F.col("edited")}).collect()}
    for column, side in (("text", "own"), ("edited", "edit")):
        alone = {r["id"]: r["signature"] for r in cws.signatures(texts, ["id"], column).collect()}
        assert {i: r[side] for i, r in both.items() if r[side] is not None} == alone


def test_fingerprints_are_drawn_without_python(spark):
    """DataFrame functions only, and likeness by weight also where words repeat; keys may repeat."""
    pairs = [("a a b", "a b b"), ("a a a a b c", "a c c c"), ("x " * 7 + "y", "x " * 5 + "y z"), ("p q r s t", "p q r u v")]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)] + [(0, "a  A b"), (0, "other"), (99, " "), (98, None)]
    signed = cws.signatures(spark.createDataFrame(rows, "id long, text string"), ["id"], samples=1000)
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Arrow|Python|Pandas", plan)
    got = defaultdict(list)
    for r in signed.collect():
        got[r["id"]].append(r["signature"])
    assert 98 not in got and 99 not in got and all(len(s) == 1000 for v in got.values() for s in v)
    assert len(got[0]) == 3 and len(set(map(tuple, got[0]))) == 2
    got[0] = sorted(got[0], key=got[0].count)
    for i, p in enumerate(pairs):
        a, b = (Counter(t.split()) for t in p)
        same = np.mean(np.array(got[2 * i][-1]) == np.array(got[2 * i + 1][0]))
        assert abs(same - sum((a & b).values()) / sum((a | b).values())) < 0.07


# ---- 9 toxicity ------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
    english = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").collect()]
    held = [i for i in english if got[i]["held_out"] and i in labels]
    hits = sum(got[i]["predicted"] and labels[i] for i in held)
    assert hits >= 0.8 * sum(labels[i] for i in held) > 0
    assert sum(got[i]["predicted"] and not labels[i] for i in held) <= 0.02 * len(held)


def test_toxicity_edges(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1), (4, 0, 0), (77, 1, 1)], "doc_id long, toxic int, text int")
    out = toxicity.score(docs, labels)
    assert out.count() == len(odd_rows()) and out.where("score is null or predicted is null").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0
    clean = toxicity.keep_clean(docs, labels.limit(0))
    assert clean.columns == docs.columns and clean.count() == len(odd_rows())


# ---- pipeline --------------------------------------------------------------------------------

def test_pipeline_against_brute_force(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r["doc_id"] for r in queries.op9_toxicity(spark, SF).where("predicted = 1").collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.orderBy("doc_id").collect() if r["doc_id"] not in toxic]
    roots = groups_by_brute_force([simhash.fingerprint(t) & (2 ** 64 - 1) for _, t, _ in rows], 4)
    first = {}
    for k, r in enumerate(roots):
        first.setdefault(r, k)
    kept = [(i, secrets.redact_text(t), s) for i, t, s in (rows[k] for k in sorted(first.values()))]
    plan = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0
            for r in mixing.schedule(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    own = pieces.pieces(pieces.MODEL)
    want = Counter()
    for i, t, s in kept:
        ids = tuple(own.encode_batch([t])[0])
        want[(i, s, ids, len(ids))] = plan[i]
    assert Counter((r["doc_id"], r["source"], tuple(r["token_ids"]), r["n_tokens"]) for r in got) == +want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
