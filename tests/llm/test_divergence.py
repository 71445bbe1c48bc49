import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fiduciary.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms_of(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(rows, least, top):
    rows = [(x or "", lang or "", source or "") for x, lang, source in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms_of(text)
        held[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = sorted(s for x, s in counts if x == lang)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            most = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", most, top)):
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n])]
    return sorted(out)


def made(n, sources, seed):
    rnd = random.Random(seed)
    words = ["a", "ab", "Abc", "abcd", "abcdé", "éé", "漢字", "x" * 40, "x" * 41, "y" * 300, "the", "THE", "ſ", "İ"] + [f"word{c}" for c in "abcdefghijklmnop"]
    rows = []
    for _ in range(n):
        source = rnd.choice(sources)
        use = words if source is None else words[len(source) % 5 :: 1 + len(source) % 2]
        rows.append((rnd.choice([" ", "\n", "-", "1", "_"]).join(rnd.choices(use, k=rnd.randint(0, 30))), rnd.choice(["en", "de", None, ""]), source))
    return rows


def listed(texts):
    """Words of documents, as the operator sees them."""
    out = []
    for words in divergence.pieces([t.encode() for t in texts]):
        size = -(-int(words.length.max(initial=1)) // 8) * 8
        out += list(zip(words.doc.tolist(), [t.decode() for t in divergence.terms_of(words.keys(size)).to_pylist()], strict=True))
    return out


def test_terms_of_bytes(monkeypatch):
    texts = ["Aé-Ünder_x\u0080 Ȁ　z0q\nÀB", "", "1 2", "word", "ab " * 900 + "c" * 3000 + " d"]
    expected = [(i, w) for i, t in enumerate(texts) for w in terms_of(t)]
    assert listed(texts) == expected
    monkeypatch.setattr(divergence, "PIECE", 10)
    assert listed(texts) == expected and listed([]) == listed([""]) == []


def test_bits_are_those_of_words(spark):
    rows = [(b"en", b"abc"), (b"", b"abcdefgh"), ("漢".encode(), "é".encode() * 9)]
    for lang, term in rows:
        size = [8, 16, 32][(len(term) >= 8) + (len(term) >= 16)]
        bitmap = divergence.bitmap_of(spark.createDataFrame([(lang, term)], "lang binary, term binary"), [8, 16, 32], 1 << 16)
        words = next(divergence.pieces([term + b" other"]))
        assert divergence.bit_mask(words, divergence.seeds([lang]), size, np.frombuffer(bitmap, np.uint8)).tolist() == [True, False]


def test_keys_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(divergence, "hashes", lambda keys, seed=0: np.zeros(len(keys), np.uint64))
    keys = np.array([[1, 2], [1, 3], [1, 2]], np.uint64)
    rows, code = divergence.distinct(keys)
    assert rows.tolist() == [[1, 2], [1, 3]] and code.ravel().tolist() == [0, 1, 0]


def test_divergence_equals_brute_force(spark, monkeypatch):
    rows = made(400, ["s1", "s22", "src", "other", None, ""], 1) + [("", "zz", "only"), (None, "en", "empty"), ("lone words here", "zz", "only")] + [("copies of it", "en", "s1")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(c) for c in ("doc_id", "term", "n", "total", "number", "value", "rank", "p_none")})
    expected = brute(rows, 8, 3)
    assert {r[2] for r in expected} == {"pair", "term"}
    assert sorted(map(tuple, divergence.source_divergence(docs.repartition(5), 8, 3).collect())) == expected
    for name, value in {"SOURCES": 2, "TERMS": 3, "HELD": 10}.items():  # several blocks, buckets and hand-overs
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.source_divergence(docs, 8, 3, bits=64).collect())) == expected  # and colliding bits


def test_refinement_discards_rare_prefixes(spark):
    rows = [(f"commons rarerarely{c}zzzz", "en", "s") for c in "abcdefghij"] + [(f"unique{c}q" * 3, "en", "s") for c in "xyz"]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    left = divergence.document_counts(docs, 8, None).where("n >= 5")
    assert {bytes(r.term): r.n for r in left.collect()} == {b"commons": 10, b"rarerare": 10}
    bitmap = spark.sparkContext.broadcast(divergence.bitmap_of(left.where("length(term) = 8"), [8], 1 << 20))
    after = {bytes(r.term): r.n for r in divergence.document_counts(docs, 16, bitmap).collect()}
    assert after == {f"rarerarely{c}zzzz".encode(): 1 for c in "abcdefghij"}


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(docs).collect() == []
    bare = spark.createDataFrame([("1 2 3", "en", "a"), (None, "en", "b"), ("few words", None, None)], docs.schema)
    assert sorted(map(tuple, divergence.source_divergence(bare).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
