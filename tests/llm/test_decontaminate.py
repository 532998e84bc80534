import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.decontaminate import clean, leaks, simhash


def bag(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(docs, items, threshold=0.8):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            b = bag(v)
            if not b:
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s : s + len(v)])
                c = sum((a & b).values())
                best = max(best, c / (sum(a.values()) + sum(b.values()) - c))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def got(df):
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in df.collect()}


def test_edge_cases(spark):
    item = " ".join(f"w{i}" for i in range(40))
    near = item.replace("w39", "other")
    docs = [(1, "a b c " + item + " d e"), (2, near + " tail"), (3, item.replace("w20", "z")), (4, None), (5, ""), (6, "x " * 9000 + item.upper()), (None, item), (7, item[:150]), (8, "same " * 60)]
    items = [(1, item), (2, None), (3, "a b"), (4, "same " * 12), (5, item)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    assert got(leaks(d, b)) == brute(docs, items)
    assert {r["doc_id"] for r in clean(d, b).collect()} == {x for x, _ in docs} - {k for k, _ in brute(docs, items)}
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0


def test_table(spark, sf_dir):
    d, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert got(leaks(d, b)) == brute(docs, [(r["item_id"], r["text"]) for r in b.collect()])


def test_null_item_ids(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "pq")
    docs = [(1, "x " + one + " y"), (2, two), (3, "clean text of no item at all"), (4, one + " " + two)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(None, one), (None, two), (None, None), (7, two)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in leaks(d, b).collect()) == [(1, 0), (2, 0), (2, 7), (4, 0), (4, 0), (4, 7)]
    assert {r["doc_id"] for r in clean(d, b.where("item_id is null")).collect()} == {3}


def test_few_distinct_shingles(spark):
    items = [(n, " ".join("ab"[i % 2] for i in range(n))) for n in (13, 21)]
    docs = [(1, "b " + items[0][1][:-2]), (2, "b " + items[1][1][:-2]), (3, "b b a a " * 9)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert (1, 13) in brute(docs, items) and got(leaks(d, b)) == brute(docs, items)


def test_best_window_between_diagonals(spark):
    """Words inserted in the middle and changed ends: the best window starts on no diagonal of a shared shingle."""
    w = [f"w{i}" for i in range(200)]
    text = [f"a{i}" for i in range(8)] + w[8:100] + [f"n{i}" for i in range(16)] + w[100:192] + [f"z{i}" for i in range(8)]
    docs, items = [(1, " ".join(text))], [(1, " ".join(w))]
    assert (1, 1) in brute(docs, items)
    assert got(leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_random_edits(spark):
    """Every pair and best similarity of brute force, over random insertions, deletions and changes."""
    rng = random.Random(11)
    docs, items = [], []
    for i in range(12):
        item = [f"v{i % 5}_{rng.randrange(60 if i % 3 else 9)}" for _ in range(rng.choice((8, 14, 30, 60, 110)))]
        items.append((i, " ".join(item)))
        for _ in range(6):
            text = list(item)
            for _ in range(rng.randrange(0, max(2, len(item) // 12))):
                at, kind = rng.randrange(len(text)), rng.randrange(3)
                text[at : at + (kind > 0)] = [f"e{rng.randrange(99)}"] * (kind < 2) * rng.randrange(1, 4)
            docs.append((len(docs), " ".join([f"p{rng.randrange(50)}" for _ in range(rng.randrange(20))] + text + [f"q{rng.randrange(50)}" for _ in range(rng.randrange(20))])))
    want = brute(docs, items)
    assert 20 < len(want) < len(docs)
    docs += docs[:3]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "_th", "row", "s", "starts", "len")})
    b = spark.createDataFrame(items + items[:2], "item_id long, text string")
    assert got(leaks(d, b)) == want
    kept = clean(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_simhash_by_hand(spark):
    rng = random.Random(2)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (0, 1, 2, 3, 8, 31, 64)]
    want = [sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in r) * 2 > len(r)) for (r,) in rows]
    assert [r[0] & (2**64 - 1) for r in spark.createDataFrame(rows, "s array<long>").select(simhash("s", 64)).collect()] == want
