import random

import corpus_pipeline as P
from plumbline.llm import simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: "\n".join(" ".join("".join(rng.choice(["the", "ing", "and", "er", "on"]) for _ in range(3)) for _ in range(12)) for _ in range(n))
    clean = [(i, text(5), "en", f"s{i % 4}", 1) for i in range(40)]
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    extra = [
        (100, clean[3][1], "en", "s0", 1), (101, clean[4][1] + "\n" + passage, "en", "s0", 1), (102, text(4) + "\n" + passage, "en", "s1", 1), (103, None, None, None, None),
        (104, "", "en", "s0", 0), (105, "12 34 !!", "en", "s0", 8), (None, "no identity but plain english words", None, None, None),
    ]
    spark.createDataFrame(clean + extra, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] == {*range(40), 100, 101, 102, None}
    assert set(range(40)) <= seen[1] and 100 not in seen[1]
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "lines")).collect()}
    assert passage in left[101] and passage not in left[102] and all(left[i] == t for i, t, *_ in clean)
    kept = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "near_duplicates")))
    assert kept.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).count() == 0
    assert seen[3] == seen[2]
    assert P.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("".join(rng.choice(["the", "ing", "and", "er", "on"]) for _ in range(3)) for _ in range(30)), "en", f"s{i}", 9) for i in range(6)]
    names = ["n_lines", "n_dropped", "lang_pred", "lang_score", "lang_spans", "others", "__doc", "__th", "doc", "gone"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("own") for c in names})
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 6, name
        assert out.where(" or ".join(f"`{c}` <> 'own' or `{c}` is null" for c in names)).count() == 0, name
    assert P.packed(spark, docs, "").count() == 6


def test_near_copies_go(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdeghilmnorstu") for _ in range(6)) for _ in range(n)]
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    texts = []
    for n, changed in [(100, 1)] * 15 + [(300, 3)] * 15 + [(300, 6)] * 15 + [(1000, 10)] * 10 + [(60, 20)] * 10:
        a = words(n)
        b = list(a)
        for i in rng.sample(range(n), changed):
            b[i] = "changed"
        texts += [" ".join(a), " ".join(b)]
    base = words(200)  # a group of copies, some alike and some not
    for _ in range(60):
        b = list(base)
        for i in rng.sample(range(200), rng.randint(1, 9)):
            b[i] = "".join(rng.choice("xyz") for _ in range(6))
        texts.append(" ".join(b))
    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(up)) and len(kept) <= len(texts) - 55
    assert P.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_take_the_links_of_fingerprints(spark, monkeypatch):
    rng = random.Random(14)
    base = ["".join(rng.choice("abcdeghilmnorstu") for _ in range(6)) for _ in range(600)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(["other", *base[100:]]), " ".join(reversed(base)), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    prints = {int(simhash.majority(P.similar.shingles(t).astype(">u8"))) for t in texts[:2]}
    assert len(prints) == 1 or (min(prints) ^ max(prints)).bit_count() <= 2
    kept = lambda: sorted(r["doc_id"] for r in P.near_duplicates(spark, docs, "").collect())
    assert kept() == [0, 3, 4]  # 5 is like 4; 2 is farther than two bits, and found in the bands
    monkeypatch.setattr(P.similar, "bands", lambda own: P.similar.np.zeros(0, P.similar.np.int64))
    assert kept() == [0, 2, 3, 4]
    assert simhash.majority(P.similar.np.zeros(0, ">u8")) == 0
