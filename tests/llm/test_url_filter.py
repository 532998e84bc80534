import fnmatch
import random

from oracle import compare

from tidemark.llm.contract import ORACLE, QUERIES
from tidemark.llm.url_filter import ShiftAnd, url_filter


def test_query(spark, sf_dir):
    compare(spark, sf_dir, QUERIES["op2_url_filter"], ORACLE["op2_url_filter"])


def test_automaton_against_fnmatch():
    import numpy as np

    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "?", "**", "ab"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    raw = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    got = ShiftAnd(globs).match(np.frombuffer(raw, dtype=np.uint8), off)
    for i, x in enumerate(texts):
        assert [fnmatch.fnmatchcase(x, g) for g in globs] == list(got[i])


def test_edge_cases(spark):
    urls = [None, "", "net/", "http://NET/", "http://net", "https://a.Example.net/en/x?q", "http://a.example.net/en", "x://example.com/de/#a", "http://evil.com/x.net/", "http://xorg/fr/", "a://b.org/fr/://c.net/", "http://u.org?/fr/", "http:///"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("net", "/", "net/", "block") and got[4] == ("net", "", None, "allow")
    assert got[5] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[6][2:] == ("net/", "block")
    assert got[7] == ("example.com", "/de/", "example.com/de/", "block") and got[8][2] is None and got[9][2] is None
    assert got[10] == ("b.org", "/fr/://c.net/", "org/fr/", "allow") and got[11] == ("u.org", "", None, "allow") and got[12] == ("", "/", None, "allow")
    assert url_filter(df.limit(0)).count() == 0
