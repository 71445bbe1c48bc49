import random
from difflib import SequenceMatcher

import numpy as np

from fiduciary.operators import spelling


def made(n, seed):
    rnd = random.Random(seed)
    words = ["capital", "partners", "fund", "global", "asset", "mgmt", "jp", "morgan", "iv", "aa", "abab", "x"]
    names = [" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(n)]
    return sorted({"".join(c for c in x if rnd.random() > 0.15) or "z" for x in names} | {"".join(rnd.choices("ab c", k=rnd.randint(1, 12))).strip() or "q" for _ in range(n)})


def test_the_bound_is_no_less_than_the_common_blocks():
    a, b = made(120, 1), made(120, 2)
    bound = spelling.most_common(a, b)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert bound[i, j] >= sum(m.size for m in SequenceMatcher(a=x, b=y).get_matching_blocks())


def test_pairs_are_those_of_brute_force(spark, monkeypatch):
    a, b = made(150, 3), made(150, 4)
    expected = sorted((x, y, r) for x in a for y in b if x != y and (r := SequenceMatcher(a=x, b=y).ratio()) >= 0.72)
    assert any(r < 0.74 for *_, r in expected) and any(0.70 <= SequenceMatcher(a=x, b=y).ratio() < 0.72 for x in a for y in b)
    left, right = (spark.createDataFrame([(x,) for x in side] * 2, "name string") for side in (a, b))
    assert sorted(map(tuple, spelling.spelling_pairs(left, right).collect())) == expected
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert sorted(map(tuple, spelling.spelling_pairs(left, right).collect())) == expected
    assert spelling.spelling_pairs(left.limit(0), right).collect() == []


def test_tiers_and_decisions(spark):
    entities = [("e1", "JP Morgan Asset Management"), ("e2", "Alpha Beta Gamma Delta Eps Zeta Eta"), ("e2", "ABG"), ("e3", "Same Name"), ("e4", "same-name"), ("e5", "...")]
    sources = ["JPMorgan Asset Mgmt", "JP MORGAN, asset management", "zeta Alpha Beta Gamma Delta Eps Eta", "same name", "nothing like it 123", "!!", None]
    s, e = spark.createDataFrame([(x,) for x in sources], "source_name string"), spark.createDataFrame(entities, "stable_id string, alias string")
    found = spelling.tiered_candidates(s, e)
    rows = {(r.source_name, r.stable_id): (r.strategy, r.confidence) for r in found.collect()}
    ratio = round(SequenceMatcher(a="jpmorgan asset mgmt", b="jp morgan asset management").ratio(), 4)
    assert rows == {("JPMorgan Asset Mgmt", "e1"): ("fuzzy", ratio), ("JP MORGAN, asset management", "e1"): ("exact", 1.0), ("zeta Alpha Beta Gamma Delta Eps Eta", "e2"): ("normalized", 1.0), ("same name", "e3"): ("exact", 1.0), ("same name", "e4"): ("exact", 1.0)}
    got = {r.source_name: (r.status, r.stable_id, r.review_priority, r.reason) for r in spelling.alias_decisions(s, found).collect()}
    assert got["JPMorgan Asset Mgmt"] == ("review", None, "medium" if ratio >= 0.78 else "high", "confidence below auto-link threshold")
    assert got["JP MORGAN, asset management"] == ("auto_link", "e1", "none", "high-confidence exact match")
    assert got["zeta Alpha Beta Gamma Delta Eps Eta"] == ("auto_link", "e2", "none", "high-confidence normalized match")
    assert got["same name"] == ("review", None, "medium", "ambiguous top candidates")
    assert got["!!"] == got["nothing like it 123"] == got[None] == ("review", None, "high", "no viable candidates")


def test_sure_spelling_alone_never_links(spark):
    e = spark.createDataFrame([("e", "Northern Lights Infrastructure Partners")], "stable_id string, alias string")
    s = spark.createDataFrame([("Northern Lights Infrastructure Partner",)], "source_name string")
    found = spelling.tiered_candidates(s, e)
    assert [(r.strategy, r.confidence > 0.92) for r in found.collect()] == [("fuzzy", True)]
    assert [(r.status, r.review_priority) for r in spelling.alias_decisions(s, found).collect()] == [("review", "medium")]


def test_shared_letters():
    assert (spelling.shared(["aab", ""], ["ab", "aaa"], 1) == np.array([[2, 2], [0, 0]])).all()
    assert (spelling.shared(["abab"], ["ab", "babab"], 2) == np.array([[1, 3]])).all()
