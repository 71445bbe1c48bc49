import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiduciary.llm import ann, components, extraction, langid, lines, mixing, sentencepieces, simhash, suffixes, topk, toxicity, vectorblocks

DOCS = "doc_id long, text string, lang string, source string, score string"
ODD = [(1, None, None, None, "x"), (2, "", "en", "a", "x"), (2, "", "en", "a", "x"), (3, "One two three four five.\nOne", "en", "a", None), (None, "no id 漢字 🙂", "fr", "b", None), (4, "word " * 5000, "en", "a", None), (5, "12 %%", None, "b", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepieces_equal_the_library(spark, odd, none):
    m = sentencepieces.PieceModel(path())
    rnd = random.Random(3)
    made = ["".join(rnd.choice("ab .,\n▁t\té漢🙂'\"%-_x0the ") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    found, agrees = m.encode(made)
    assert all(agrees)
    for text, (ids, decoded) in zip(made, found, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == m.library.encode(text)
        assert decoded == m.library.decode(m.library.encode(text)) == m.decode(m.library.encode(text))
    units = sorted({u for x in made for u in m.unit.findall("▁" + x.replace(" ", "▁"))} | {"▁indivisible", "▁▁▁ab", "x", "▁" + "a" * 90})
    assert [np.frombuffer(x, np.int32).tolist() for x in m.encode_many(units)] == [m.encode_unit(u) for u in units]
    m._known.clear()
    m.merge_many = lambda units: (np.full(len(units), 5), np.ones(len(units), int))  # a wrong agenda shows
    assert m.encode(["some words"])[1] == [False] and np.frombuffer(m.encode(["some words"])[0][0][0], np.int32).tolist() == m.library.encode("some words")
    assert sentencepieces.sentencepieces(odd, path()).count() == len(ODD)
    assert sentencepieces.sentencepieces(none, path()).count() == 0


def test_lines(spark, odd, none):
    rows = [(i, f" Common \nown {i}\n") for i in range(3)] + [(9, "common")]
    out = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert out[0]._kept == "own 0\n" and out[0]._n_lines == 3 and out[0]._n_dropped == 1 and out[9]._kept == ""
    first = {r.doc_id: r._kept for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 4, keep_first=True).collect()}
    assert first == {0: " Common \nown 0\n", 1: "own 1\n", 2: "own 2\n", 9: ""}
    clash = odd.withColumns({c: F.lit(c) for c in ("_hash", "_id", "_text", "_keeps", "_pos")})
    out = lines.line_dedup(clash, 2).collect()
    assert sorted((r.doc_id or 0, r._n_lines, r._n_dropped, r._kept, r._hash, r._id, r._text, r._keeps) for r in out) == sorted(
        (i or 0, (x or "").count("\n") + 1, 0, x or "", "_hash", "_id", "_text", "_keeps") for i, x, *_ in ODD)
    twice = spark.createDataFrame([(1, "a\n\na"), (1, "a\n\na"), (None, "b\na"), (None, "b\na")], "doc_id long, text string")
    assert sorted((r._kept, r._n_dropped) for r in lines.line_dedup(twice, 4).collect()) == [("", 2), ("", 2), ("b", 1), ("b", 1)]
    assert lines.line_dedup(none).count() == 0


def test_lines_are_streamed_by_range_and_position(spark):
    docs = spark.createDataFrame([(i, f"common\nown {i}") for i in range(20)], "doc_id long, text string")
    plan = lines.repeated_hashes(lines.line_stream(docs), 10)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_h" in plan and plan.count("Exchange") == 2
    assert re.search(r"Window \[rank\(_pos", plan) and re.search(r"Sort \[_h#\d+L ASC NULLS FIRST, _g#\d+ ASC NULLS FIRST, _id#\d+L ASC NULLS FIRST, _text#\d+L ASC NULLS FIRST, _pos#", plan)


def test_mixing(spark, odd, none):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 5 == 0]) for i in range(400)], "doc_id long, text string, source string")
    plan = mixing.mixing_plan(docs).collect()
    for r in plan:
        assert r._copies <= 2
    total = sum(r._copies * r._size for r in plan)
    assert abs(total - 6000) < 600 and mixing.mix(docs).count() == sum(r._copies for r in plan)
    assert mixing.mixing_plan(odd).count() == len(ODD) and mixing.mixing_plan(none).count() == 0


def test_language_families(spark, odd, none):
    texts = {"en": "the and of that this with", "de": "der und nicht die ein für", "fr": "le des une avec pour dans", "es": "el los una con para que"}
    rows = [(i, " ".join(random.Random(i).choices(texts[c].split(), k=12)), c) for i, c in enumerate(list(texts) * 30)]
    machines = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, scores = machines.predict([r[1] for r in rows])
    assert np.mean([a == r[2] for a, r in zip(langs, rows, strict=True)]) > 0.97 and ((scores >= 0) & (scores <= 1)).all()
    out = {r.doc_id: r.lang_pred for r in langid.identify(odd, machines).collect()}
    assert out[1] == out[2] == out[5] == "und" and out[3] != "und"
    assert langid.identify(none, machines).count() == 0 and langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, odd, none):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices("sun moon tree lake bird".split(), k=20) + (["vileword"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert model.score("a Vileword here") > 0.3 > model.score("sun and moon") and 0 <= model.score("") < 0.3
    assert toxicity.toxicity(odd, model).count() == len(ODD) and toxicity.toxicity(none, None).count() == 0


def test_vector_searches(spark):
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((600, 16))
    x[100:300] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (900, None), (950, [float("nan")] * 16), (1000, [None] * 16), (1050, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = np.floor(256 * x).astype(np.int64)
    found = {}
    for r in topk.top_inner_products(df, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, 600, 50))
    for q, got in found.items():
        s = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        assert sorted(got) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    near = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).collect()
    hits = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        bound = sorted((s[i] for i in range(600) if i != q), reverse=True)[19]
        hits += sum(r.score >= bound - 1e-9 for r in near if r.query_id == q)
    assert hits >= 0.9 * 30 * 20
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_blocks_of_equal_length_meet_once(spark, monkeypatch):
    monkeypatch.setattr(vectorblocks, "CANDIDATES", 64)
    copies = spark.createDataFrame([(0, [1.0, 0.0])] + [(7, [2.0, 0.0])] * 200, "vec_id long, embedding array<double>")
    signs = np.random.default_rng(3).choice([-1.0, 1.0], (500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(signs)], "vec_id long, embedding array<double>")
    for search in (topk.top_inner_products, ann.nearest_neighbours):
        assert search(copies, F.col("vec_id") == 0, 150).where("vec_id = 7").count() == 150
        got = search(df, F.col("vec_id") % 100 == 0, 20).collect()
        for q in range(0, 500, 100):
            found = [r.vec_id for r in got if r.query_id == q]
            assert len(found) == len(set(found)) == 20
            if search is topk.top_inner_products:
                s = signs @ signs[q]
                assert sorted(found) == sorted([i for i in np.lexsort((np.arange(500), -s)) if i != q][:20])


def test_vectors_of_any_length_take_part(spark):
    rows = [(50, [1e6, 0.0]), (1, [1.0, 1.0]), (2, [3e5, 1.0]), (100, [2.0, 1.0]), (150, [4e7, 4e7 + 1]), (3, [4e7, -4e7]), (4, [1e200, 5.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(256 * x) for x in v] for i, v in rows}
    got = {}
    for r in topk.top_inner_products(df, F.col("vec_id") % 50 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [50, 100, 150, 200]
    for q, found in got.items():
        s = {i: max(min(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), (1 << 63) - 1), 1 - (1 << 63)) for i in whole if i != q}
        assert sorted(found) == [(n + 1, i, s[i]) for n, i in enumerate(sorted(s, key=lambda i: (-s[i], i)))]
    near = {(r.query_id, r.vec_id): r.score for r in ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, 7).collect()}
    assert {q for q, _ in near} == {50, 100, 150} and near[50, 4] == 1e206 and near[100, 1] == 3.0 and len(near) == 18


def test_codes_estimate_inner_products():
    rnd = np.random.default_rng(8)
    x, q = rnd.standard_normal((3000, 96)) + 0.3, rnd.standard_normal((20, 96))
    centre, turn = x[:500].mean(0), ann.rotation(96)
    guess, off = ann.Asked(q, centre, turn).estimates(ann.encode(np.arange(3000), x, centre, turn))
    assert abs((guess - q @ x.T).mean()) < 0.1 and 0.8 < (np.abs(guess - q @ x.T) <= off).mean() < 0.98
    assert ann.code_type(96).itemsize == 64  # of 768 bytes


def test_suffix_order_and_repeated_bytes(spark, odd, none):
    rnd = random.Random(5)
    for trial in range(60):
        t = np.array([rnd.randrange((2, 3, 250)[trial % 3]) + trial % 2 for _ in range(rnd.randint(1, 200))], np.uint8)
        order = suffixes.suffix_order(t, 50)
        assert [t[i : i + 50].tolist() for i in order] == sorted(t[i : i + 50].tolist() for i in range(len(t)))
    words = "ab cd ef gh ij kl".split()
    shared = [" ".join(rnd.choices(words, k=30)) for _ in range(4)]
    rows = [(i, " ".join([rnd.choice(shared)[: rnd.randint(20, 80)], *rnd.choices(words, k=20), rnd.choice(shared)])) for i in range(40)] + [(99, "a" * 500), (100, "a" * 60), (101, None)]
    first = {}
    for i, x in rows:
        b = (x or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 1 << 60), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffixes.frequent_grams(docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.col("text").cast("binary")), 50, 10**4, 3)
    for r in suffixes.repeated_bytes(docs).union(suffixes.repeated_bytes(docs, frequent=3)).collect():  # also with windows dealt by longer grams
        b = (dict(rows)[r._id] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r._id:
                gone[p : p + 50] = True
        assert bytes(r._kept) == bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert sum(s["to"] - s["from"] for s in r._spans) == gone.sum()
    assert suffixes.repeated_bytes(odd).count() == len(ODD) and suffixes.repeated_bytes(none).count() == 0


def test_simhash_groups(spark, odd, none):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(9999)}" for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base) if i % 2 else [f"v{rnd.randrange(9999)}" for _ in range(40)]
        words[rnd.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = {r._id: (r._print, r._component) for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted(got)
    name = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            for j in ids:
                if (got[i][0] ^ got[j][0]).bit_count() <= 4 if (got[i][0] ^ got[j][0]) >= 0 else ((got[i][0] ^ got[j][0]) & (1 << 64) - 1).bit_count() <= 4:
                    name[i] = name[j] = min(name[i], name[j])
        if all(name[i] == got[i][1] for i in ids):
            break
    assert all(name[i] == got[i][1] for i in ids)
    assert simhash.fingerprint("") == 0 and simhash.simhash_groups(odd).count() == len(ODD) and simhash.simhash_groups(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80), (80, 80)], "a long, b long")
    out = {r.node: r.root for r in components.components(edges).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[90] == out[80] == 80


def test_extraction(spark):
    head = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a>Home</a></nav>"
    plain = "all rights of this fine site belong to its many owners"
    rows = [(i, f"http://h.example/{i}", f"{head}<div>{plain}</div><div><p>Own text number {i} &amp; more<p>Second  part</div></body>") for i in range(4)]
    rows += [(9, "http://h.example/a", f"{head}<article><header><h1>T</h1></header><p>Body</p><div class='comments'>me too</div></article><aside>x</aside><footer>f</footer>"), (10, None, None), (11, "::", "no markup & more")]
    out = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2] == "Own text number 2 & more\n\nSecond part" and out[9] == "T\n\nBody" and out[10] == "" and out[11] == "no markup & more"


@pytest.mark.parametrize(
    "page, text",
    [
        *[(f"<body><div class='{c}'><article><p>Body</p></article></div><footer>f</footer>", "Body") for c in ("page has-sidebar", "no-sidebar", "with-header", "widget", "nav-menu")],
        *[(f"<article><p>Body</p><div class='{c}'>more</div></article>", "Body\n\nmore") for c in ("elementor-widget-text-editor", "related-work", "section-header")],
        ("<div id='sidebar'><main>Body</main></div><div class='sidebar'>x</div>", "Body"),
        ("<main>Body<div class='widget'><article>more</article></div></main>", "Body\n\nmore"),
        ("<form id='aspnetForm'><input><main>Body</main></form>", "Body"),
        ("<div role='main'>Body</div><div>x</div>", "Body"),
        ("<main><article>Body</article><div id=comments><article class=comment>me too</article></div></main>", "Body"),
        ("<article>Body<div class='comments'><article>me too</article></div></article>", "Body"),
        ("<article><p title='The hidden river' data-role=menu data-style='display:none'>Body</article>", "Body"),
        ("<article><p title='class=ad'>Body</p><p hidden>x</p><p class=AD>y</p><p class='nav-menu'>z</p></article>", "Body"),
        *[(f"<body><{t}/><article>Body</article>", "Body") for t in ("svg class='x' ", "iframe src='a'", "script src='a' ", "canvas", "object data='a'")],
        *[(f"<body><{t}>a</{t}><article>Body</article>", "Body") for t in ("title-bar", "button-group", "select-box")],
        ("<body><button>Menu<article>Body <button>x</button>end</article>", "Body end"),
        ("<body><object>a<object>b</object>c</object><article>Body</article><script>var a = '<p>x'", "Body"),
        ("<article>Body<hr class='ad'>more<hr hidden>end</article>", "Body\n\nmore\n\nend"),
        ("<article>Body<img class='ad' hidden>more<div class=ad data-u=a/>x</div>end</article>", "Bodymore\n\nend"),
    ],
)
def test_extraction_of_ordinary_markup(page, text):
    assert extraction.main_text(page, None, "") == text


@pytest.mark.parametrize("host_tokens", [1 << 20, 60])
def test_strings_that_a_host_repeats(spark, monkeypatch, host_tokens):
    monkeypatch.setattr(extraction, "HOST_TOKENS", host_tokens)  # 60: hosts are dealt out in parts
    rnd = random.Random(6)
    runs = [" ".join(rnd.choices("ab cd ef gh".split(), k=rnd.randint(6, 14))) for _ in range(5)]
    rows = [(i, f"http://h{i % 3}.example/{i}", "".join(f"<div>{x}</div>" for x in [rnd.choice(runs), f"own{i} " * rnd.randint(1, 9), rnd.choice(runs)])) for i in range(60)]
    rows += [(100, "http://h0.example/a", rows[0][2]), (101, "http://h0.example/b", None), (102, None, rows[0][2])]
    pages: dict[int, set] = {}
    for _, url, page in rows:
        words = extraction.stream(extraction.blocks_of(page or ""))[1]
        tokens = tuple(t for w in words for t in [*w, "\n"])
        for i, h in enumerate(extraction.window_hashes(extraction.host_of(url or ""), words).tolist()):
            pages.setdefault((h, tokens[i : i + 8]), set()).add(tokens)
    got = sorted(r.h for r in extraction.repeated_windows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got and got == sorted(h for (h, _), found in pages.items() if len(found) >= extraction.PAGES)


def test_extraction_with_windows_joined(spark, monkeypatch):
    rows = [(i % 7 and i, f"http://h.example/{i}", f"<div>all rights of this fine site belong to its many owners</div><p>Own text {i}</p>", "x") for i in range(8)]
    rows += [rows[0], (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, windows string")
    few = sorted(map(str, extraction.extract(df).collect()))
    monkeypatch.setattr(extraction, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, extraction.extract(df).collect())) == few and len(few) == 10 and "Own text 3" in str(few) and "rights" not in str(few)
    assert extraction.extract(df.limit(0)).count() == 0


def test_near_copies_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(None, words[0], "x"), (None, words[0], "y"), (None, words[1], "x"), (None, words[2], "x"), (4, words[2], "x"), (7, words[3], "x"), (7, words[4], "x"), (7, words[4], "y"), (7, words[4], "y"), (2, words[5], None), (3, words[5], "x")]
    kept = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        kept.append(sorted(map(str, corpus_pipeline.drop_near_copies(spark, docs, "").collect())))
        out = corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id", "text").collect()
        assert sorted((r.doc_id or 0, r.text[0]) for r in out) == [(0, "a"), (0, "b"), (2, "f"), (4, "c"), (7, "d"), (7, "e")]
    assert kept[0] == kept[1]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:4] + (0,) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "ids_sha256"} <= set(out.columns) and re.fullmatch("[0-9a-f]{64}", out.first().ids_sha256)
    assert hashlib.sha256(b"").hexdigest()
