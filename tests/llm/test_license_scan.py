import re

from pyspark.sql import functions as F

from tidemark.llm.license_scan import BASE, NOTICES, TEMPLATES, license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    pos = [i for i, _ in at]
    return len(w), len(at), min(pos, default=None), max(pos, default=None), ",".join(sorted({x for _, x in at}))


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in df.collect()}


def test_edge_cases(spark):
    rows = [
        (1, "CC BY cc-by, CC  BY"), (2, None), (3, ""), (4, "GNU General Public\nLicense. All rights reserved!"), (5, "x " * 3000 + "all RIGHTS reserved"), (6, "É cc by ç"),
        (7, "Licensed under the Apache License, Version 2.0."), (8, "licensed under the new apache license version 2.0"), (None, "cc by"), (9, "ccby cc byx"), (10, "cc by cc by cc"),
    ]
    out = license_scan(spark.createDataFrame([(d, t, "q", 1) for d, t in rows], "doc_id long, text string, label string, pos int"))
    assert got(out) == {d: brute(t) for d, t in rows}
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in out.collect()}
    assert labels[7] == ("apache-2.0", 1.0) and "apache-2.0" in labels[8][0] and labels[2] == ("", 0.0) and labels[10][1] == 1.0
    assert license_scan(out.sparkSession.createDataFrame([], "doc_id long, text string")).count() == 0


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(license_scan(docs)) == {r["doc_id"]: brute(r["text"]) for r in docs.collect()}


def brute_labels(text, cover=0.6, drift=3):
    """Labels by comparing every word of every template at every offset; runs of four words count, as do whole notices."""
    w = WORD.findall((text or "").translate(LOWER))
    found = {x for x in brute(text)[4].split(",") if x}
    found |= {label for label, texts in NOTICES.items() for n in map(str.split, texts) if any(w[i : i + len(n)] == n for i in range(len(w)))}
    for label, template in TEMPLATES.items():
        v, runs = template.split(), {}
        for j in range(len(v) - 3):
            for i in range(len(w) - 3):
                if w[i : i + 4] == v[j : j + 4]:
                    runs.setdefault(i - j, set()).update(range(j, j + 4))
        last, words = None, set()
        for d in sorted(runs):
            words = runs[d] | (words if last is not None and d - last <= drift else set())
            last = d
            if len(words) >= cover * len(v):
                found.add(label)
    return ",".join(sorted(found))


def test_short_notices(spark):
    rows = {
        1: ("Released under the MIT License.", "mit"), 2: ("licensed under the terms of the MIT licence", "mit"), 3: ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), 4: ("Released under the BSD License.", "bsd"),
        5: ("Licensed under the ISC license", "isc"), 6: ("Mozilla Public License, v. 2.0", "mpl-2.0"), 7: ("Mozilla Public License 1.1", ""), 8: ("Released under the MIT", ""), 13: ("unter der License mit Quelle", ""), 9: ("a summit license", ""),
        10: ("Released under the MIT License. Released under the BSD License. All rights reserved.", "bsd,mit,reserved"), 11: ("Licensed under CC BY-NC 4.0.", "cc-by"), 12: (" ".join(TEMPLATES["mit"].split()[:14]) + " MIT License", "mit"),
    }
    out = {r["doc_id"]: r for r in license_scan(spark.createDataFrame([(d, x) for d, (x, _) in rows.items()], "doc_id long, text string")).collect()}
    assert {d: r["labels"] for d, r in out.items()} == {d: want for d, (_, want) in rows.items()}
    assert out[1]["score"] == 1.0 and [(s["label"], s["start"], s["end"], s["cover"]) for s in out[1]["spans"]] == [("mit", 3, 5, 1.0)]
    assert out[1]["n_base"] == 0 and out[1]["base_labels"] == "" and out[8]["score"] == 0.0


def test_table_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()}
    assert labels == {d: brute_labels(x) for d, x in texts.items()}
    assert any("Released under the MIT License." in (x or "") for x in texts.values()) and all("mit" in labels[d] for d, x in texts.items() if "Released under the MIT License." in (x or ""))


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "cc by x"), (1, "cc by x"), (1, "cc by cc by"), (None, None), (None, None), (2, "mit license " * 3000)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "copies", "gram", "words")})
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["labels"]) for r in license_scan(docs).collect()))
    assert got == [(0, 0, 0, ""), (0, 0, 0, ""), (1, 3, 1, "cc-by"), (1, 3, 1, "cc-by"), (1, 4, 2, "cc-by"), (2, 6000, 0, "mit")]
