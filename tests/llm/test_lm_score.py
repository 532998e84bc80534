import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import contract, lm_score

WORD = re.compile("[^\x20\x09-\x0d]+")
END, START = object(), object()


def brute(rows, learn):
    """Direct counts and estimates under the given mixture weights."""
    tokens = [(d, zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0, [*WORD.findall(x or ""), END]) for d, x in rows]
    uni, bi = Counter(), Counter()
    for _, held, w in tokens:
        if not held:
            uni.update(w), bi.update(zip([START, *w], w))
    starts = sum(not held for _, held, _ in tokens)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for d, held, w in tokens:
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = 0.0
        for p, x in zip([START, *w], w):
            cv = starts if p is START else uni[p]
            a, b, c = learn[int(math.log2(max(cv, 1)))]
            rest = b * uni[x] / max(1, n) + c / (v + 1)
            score += math.log10(a * bi[p, x] / cv + rest if cv else rest / (b + c))
        out[d] = (held, len(w), sum(uni[x] > 0 for x in w), n, base, score)
    return out


def em(bins, n, v):
    """Weights of each context bucket by expectation-maximisation, one bin at a time, written apart from the product's."""
    weight = defaultdict(lambda: [1 / 3] * 3)
    estimates = {}
    for k, a, b in bins:
        known, twice = b > lm_score.EMPTY, a > lm_score.EMPTY
        estimates[k, a, b] = (min(1.0, 2 ** ((a + b) / 8)) if twice else 0.0, 2 ** (b / 8) / max(1, n - 1) if known else 0.0, 1 / (v + 1))
    for _ in range(30):
        sums = defaultdict(lambda: [1e-3] * 3)
        for key, count in bins.items():
            parts = [w * p for w, p in zip(weight[key[0]], estimates[key])]
            for i, x in enumerate(parts):
                sums[key[0]][i] += count * x / sum(parts)
        weight.update({k: [x / sum(xs) for x in xs] for k, xs in sums.items()})
    return weight


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")
    got = {r["doc_id"]: tuple(r)[1:] for r in lm_score.lm_scores(docs).collect()}
    # The same bins, counted directly and learned by another program, give the weights for the direct computation.
    tokens = [[*WORD.findall(x or ""), END] for d, x in rows if zlib.crc32(str(d if d is not None else "").encode()) % 10]
    uni, bi = Counter(x for w in tokens for x in w), Counter(p for w in tokens for p in zip([START, *w], w))
    n, v, bins = sum(uni.values()), len(uni), Counter()
    for w in tokens:
        for p, x in zip([START, *w], w):
            cv, c, c2 = (len(tokens) if p is START else uni[p]), uni[x], bi[p, x]
            a = round(8 * math.log2((c2 - 1) / ((cv - 1) * (c - 1)))) if c2 > 1 else lm_score.EMPTY
            bins[int(math.log2(cv)), a, round(8 * math.log2(c - 1)) if c > 1 else lm_score.EMPTY] += 1
    want = brute(rows, em(bins, n, v))
    for d, x in want.items():
        assert got[d][:4] == x[:4]
        assert got[d][4:] == pytest.approx(x[4:], rel=1e-6)
    return got


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 200)
    rows = [(i, f"the cat sat on the mat number {i % 5} and the dog {i} ran") for i in range(40)] + [(100, None), (101, ""), (None, "the cat"), (102, "new words only"), (103, "x " * 500)]
    check(spark, rows)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_scores(docs).count() == 0


def test_table(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    held = [x for x in got.values() if x[0]]
    assert sum(x[5] for x in held) > sum(x[4] for x in held)


def contract_rows(rows):
    """The columns that the contract of op8 fixes, counted directly."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(d, zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0, [*WORD.findall((x or "").translate(low)), END]) for d, x in rows]
    count = Counter(x for _, held, w in tokens if not held for x in w)
    n, v = sum(count.values()), len(count)
    return [(d, held, len(w), sum(count[x] > 0 for x in w), n, math.fsum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for d, held, w in tokens]


def order(r):
    return r[0] is not None, r[0] or 0, r[2], r[5]


def test_query_lowers_ascii(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 200)
    rows = [(i, x) for i, x in enumerate(["The Cat SAT", "the cat sat", "[At] @Z `z {z Z", "École éCOLE école", "KELVIN kelvin Kelvin", "İ I i ı", "A\x0bB\x0cC D E\x85F\x1cG", None, "", " \t\r\n"] * 6)]
    rows += [(-1, "THE end"), (-1, "the END"), (-7, "Twice"), (-7, "Twice"), (None, "Unseen Words"), (None, None), (200, "Z" * 3000 + " " + "z" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in contract.QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()), key=order)
    want = sorted(contract_rows(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    # The model's score too is that of the lower-cased texts.
    low = spark.createDataFrame([(d, x and re.sub("[A-Z]", lambda m: m[0].lower(), x)) for d, x in rows], "doc_id long, text string")
    assert [r[6] for r in got] == pytest.approx([r[6] for r in sorted((tuple(r) for r in lm_score.lm_scores(low).collect()), key=order)], rel=1e-9)
    # Without it, the operator keeps the case: 6 is held out and only its end is known.
    docs = spark.createDataFrame([(1, "word"), (6, "Word")], "doc_id long, text string")
    known = [{r["doc_id"]: r["n_known"] for r in lm_score.lm_scores(docs, lower=x).collect()} for x in (False, True)]
    assert known == [{1: 2, 6: 1}, {1: 2, 6: 2}]
