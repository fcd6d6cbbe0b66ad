"""Each operator against a brute-force version on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import itertools
import pathlib
import random
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bpe, graph, langid, licences, line_templates, media, neighbours, packing, simhash, token_counts, token_files
from plumbline.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 200)) for _ in range(40)]
    near = texts[0].split()
    near[3] = "changed"
    texts += [texts[0], texts[0].upper(), " ".join(near), "", None, None, "  \n ", "a", "ÀÉ ß ﬁ", "x" * 5000, prose(rng, 6000), "tab\tsep\x0bodd\x1cchar"]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "no id here at all", None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names the operators use inside must not matter
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("fp", "rid", "shard", "digest", "start", "leaf")})


def empty(docs):
    return docs.limit(0)


def test_media_round_trip(docs, rows):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media(docs).collect())
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((-1 if i is None else i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    assert got == sorted(want)
    assert media.media(empty(docs)).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = media.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    pieces = lambda d: {d[a:b] for a, b in itertools.pairwise([0, *media.cuts(d)])}
    assert len(pieces(data) & pieces(b"inserted" + data)) >= len(ends) - 3
    slow, out = 0, []
    for b in data[:300]:
        slow = ((slow << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        out.append(slow)
    assert media.gear(data[:300]).tolist() == out


def test_damaged_media_raises():
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"x" * 64)[:-1])


def reference_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_against_all_pairs(docs, rows):
    got = {(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, reference_simhash(t)) for i, t, *_ in rows]
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            up[top(a)] = top(b)
    groups = {}
    for k in range(len(prints)):
        groups.setdefault(top(k), []).append(prints[k][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    assert got == {(i, fp, least[top(k)]) for k, (i, fp) in enumerate(prints)}
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_links_of_dense_groups(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    prints = {base} | {rng.getrandbits(64) for _ in range(50)}
    while len(prints) < 300:  # all within a few bits of one another
        prints.add(base ^ sum(1 << rng.randrange(12) for _ in range(3)) & 0xFFF)
    own = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in own], "fp long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df)).collect()}
    for a, b in itertools.combinations(own, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            assert roots[a] == roots[b]
    assert len(set(roots.values())) <= len(roots)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[500] == got[501] != got[0] and len(got) == 203


@pytest.mark.parametrize("few", [0, 40, 1 << 17])
def test_components_by_joins_and_on_the_driver(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(90)] + [(rng.randrange(200, 500), rng.randrange(200, 500)) for _ in range(130)] + [(-5, 2**62), (None, 3), (7, None), (8, 8)]
    parent = {x: x for pair in edges for x in pair}
    top = lambda x: x if parent[x] == x else top(parent[x])
    for x, y in edges:
        if None not in (x, y):
            parent[top(x)] = top(y)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == {x for pair in edges if None not in pair and pair[0] != pair[1] for x in pair}
    groups = {}
    for x, root in got.items():
        assert top(x) == top(root)
        groups.setdefault(top(x), set()).add(root)
    assert all(len(x) == 1 for x in groups.values())
    assert graph.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def test_simhash_writes_few_files_over_many_partitions(spark, tmp_path):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    shared = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], f"other{i}", *words[i + 1 :]])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    try:
        for k, v in zip(held, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        simhash.query(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    tables = [*(set(shared.iterdir()) - before), tmp_path / "out"]
    assert max(len(list(x.glob("part-*"))) for x in tables) <= 4 and len(tables) <= 6
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300


def test_tables_of_ids_are_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    shared = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    line = lambda i: " ".join(f"a{chr(97 + (i * 7 + j * j) % 26)}{chr(97 + (i + j) % 26)}" for j in range(12))
    docs = spark.createDataFrame([(i, line(i) + "\n" + line(i // 2)) for i in range(60)], "doc_id long, text string")
    try:
        for k, v in zip(held, ("16", "false"), strict=True):
            spark.conf.set(k, v)
        assert line_templates.recurring(docs).count() > 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = {x.name.split("-")[0]: len(list(x.glob("part-*"))) for x in set(shared.iterdir()) - before}
    assert files["variants"] <= 4 and files["leaves"] <= 4 and files["kept"] <= 4


def test_links_of_an_unlike_block_hold_nothing_for_pairs_that_fail():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.int64)).view(np.uint64)
    tracemalloc.start()
    u, _ = simhash.links_within(prints, np.array([0, len(prints)]), simhash.BITS, simhash.pivot_values())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not len(u) and peak < 1_000_000


def test_one_of_each_keeps_one(docs, rows):
    clash = docs.withColumns({c: F.lit(1) for c in ("__doc", "component_id", "kept")})
    assert simhash.one_of_each(clash).count() == simhash.one_of_each(docs).count()
    kept = [r["doc_id"] for r in simhash.one_of_each(docs).collect()]
    members = simhash.near_duplicates(docs).collect()
    assert sorted(x for x in kept if x is not None) == sorted({r["component_id"] for r in members if r["component_id"] is not None})
    assert simhash.one_of_each(docs).columns == docs.columns


def library(text):
    c = bpe.codec(bpe.default_path())
    ids = c.library.encode(text or "", add_special_tokens=False).ids
    return ids, c.library.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(docs, rows):
    got = sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.encode_decode(docs).collect())
    assert got == sorted((str(i), *library(t)) for i, t, *_ in rows)
    assert bpe.encode_decode(empty(docs)).count() == 0


@pytest.mark.parametrize("letters", ["ab", "etaoinshrdlu", "a", "éèça", "日本語ab", "!?-.", "th e"])
def test_tree_concatenation_of_long_words(letters):
    rng = random.Random(letters)
    c = bpe.Codec(bpe.default_path(), leaf=16)
    for n in (15, 17, 33, 200, 2000):
        s = "".join(rng.choice(letters) for _ in range(n))
        assert np.frombuffer(c.encode(s), "<u4").tolist() == library(s)[0]


@pytest.mark.parametrize("text", ["x<|endoftext|>y", "<|startoftext|><|endoftext|> <|ENDOFTEXT|>", "e\u0301" * 400 + "<|endoftext|>" + "Σ" * 300, "a\x1fb\x1c \x1d", "\u200b \u2028 x\x85", "ΣΑΣ Σ", "é ñ", "it's we'RE 12 3½ ²", "a\x1cb \x85 c", "İ ŉ ǰ"])
def test_bpe_odd_texts(text):
    c = bpe.codec(bpe.default_path())
    ids, decoded = library(text)
    assert np.frombuffer(c.encode(text), "<u4").tolist() == ids and c.decode(c.encode(text)) == decoded


def test_token_files(spark, docs, rows, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path / "ids"))
    got = token_files.read_token_files(manifest).collect()
    assert len(got) == len(rows)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order if r["doc_id"] is not None] == sorted(i for i, *_ in rows if i is not None)
    start = 0
    for r in order:
        assert r["start"] == start
        start += r["n_tokens"]
    by_id = {i: t for i, t, *_ in rows}
    for r in order:
        if r["doc_id"] is not None:
            ids = np.array([*library(by_id[r["doc_id"]])[0], 1], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    path = manifest.first()["path"]
    index = token_files.read_index(path)
    back = [(int(x["offset"]), int(x["bytes"])) for x in index[::-1]]
    assert list(token_files.read_frames(path, back)) == list(token_files.read_frames(path))[::-1]
    data = bytearray(open(path, "rb").read())
    data[14] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(ValueError):
        list(token_files.read_frames(path))
    assert token_files.read_token_files(token_files.write_token_files(empty(docs), str(tmp_path / "none"))).count() == 0


def test_token_files_that_are_cut_short_raise(docs, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path / "ids"))
    path = manifest.first()["path"]
    index = open(path + ".idx", "rb").read()
    for damaged in (index[:-20], index[:-7], index[:5] + bytes([index[5] ^ 1]) + index[6:]):
        open(path + ".idx", "wb").write(damaged)
        with pytest.raises(Exception, match="index|manifest"):
            token_files.read_token_files(manifest).collect()
    open(path + ".idx", "wb").write(index)
    with pytest.raises(Exception, match="manifest"):
        token_files.read_token_files(manifest.withColumn("docs", F.col("docs") + 1)).collect()


def test_token_counts_under_edits():
    count = token_counts.counter(token_counts.default_path())
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["the ", "ab", "c ", "\n", "  ", "é", "'s ", "1", "\x1c", ".", " xyz"]) for _ in range(n))
    for _ in range(60):
        text = make(rng.choice([0, 1, 5, 50, 800]))
        tree = token_counts.CountTree(text, count)
        for _ in range(6):
            a = rng.randrange(len(text) + 2)
            b, new = a + rng.choice([0, 1, 5, 100, 5000]), make(rng.choice([0, 1, 3, 40]))
            got = tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert got == len(count.encoding.encode_ordinary(text))
    for big in (token_counts.CountTree("word " * 50_000, count), token_counts.CountTree("a1-" * 50_000, count)):
        before = big.encoded
        big.edit(1000, 1004, "x")
        assert 0 < big.encoded - before < 6 * token_counts.LEAF


def test_kept_trees_take_edits(docs, rows):
    trees = token_counts.plant(docs)
    edits = token_counts.standard_edits(docs)
    told = {r["doc_id"]: r["edits"] for r in edits.collect()}
    count = token_counts.counter(token_counts.default_path())
    plain = lambda t: len(count.encoding.encode_ordinary(t))
    want, grafted = [], token_counts.graft(docs, trees, edits)
    for i, t, *_ in rows:
        new = t or ""
        for e in told.get(i, []):
            new = new[: e["at"]] + e["put"] + new[e["until"] :]
        want.append((str(i), plain(t or ""), len(count.split(t or "")), 3 if i is not None else 0, plain(new), len(count.split(new)), new))
    names = ("n_tokens_before", "n_segments_before", "n_edits", "n_tokens", "n_segments", "text")
    got = [(str(r["doc_id"]), *(r[c] for c in names)) for r in grafted.collect()]
    assert sorted(got) == sorted(want)
    assert all(r["segments_encoded"] < 18 * token_counts.LEAF for r in grafted.where("n_segments_before > 300").collect())
    # what comes out is texts and trees again
    again = token_counts.graft(grafted.select("doc_id", "text"), grafted, edits.limit(0), grown=False).collect()
    assert sorted(r["n_tokens"] for r in again) == sorted(w[4] for w in want) and not any(r["segments_encoded"] for r in again)
    assert token_counts.graft(empty(docs), token_counts.plant(empty(docs)), edits).count() == 0
    with pytest.raises(ValueError, match="another text"):
        token_counts.CountTree("abc", count, ([2], [1], [1]))


def test_line_templates_drop_recurring_lines(spark):
    long = "this passage stands in several documents and says the very same thing each time " * 5
    texts = [
        (1, f"first own line of the one document\n{long}\n\nshort one"), (2, f"{long}\nsecond own line of another document\nshort one"), (3, "took 15 ms to answer the request\nalpha"),
        (4, "took 97 ms to answer the request\nbeta"), (5, "took 3 ms to answer that request\ngamma"), (6, None), (7, ""), (8, "one line of five words\none line of five words"), (None, f"{long}\nnull ids are one document"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("leaf", F.lit(1))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(docs).collect()}
    assert got[None].split("\n")[0] == long and got[1] == "first own line of the one document\n\nshort one"
    assert got[2] == "second own line of another document\nshort one" and got[3] == texts[2][1] and got[4] == "beta" and got[5] == "gamma"
    assert got[6] is None and got[7] == "" and got[8] == texts[7][1]
    assert line_templates.drop_lines(docs.limit(0)).count() == 0 and line_templates.drop_lines(docs).columns[:3] == docs.columns


def test_a_leaf_holds_several_templates(spark):
    texts = [
        (1, "user login was made by alpha from home today\nrow of 3 4 5 6 7 8\nshared words with 7 and 8 fields"),
        (2, "user login was seen near gate one by bob\nrow of 3 4 5 6 7 9\nshared words with 9 and 10 fields"),
        (3, "user login was seen near gate two by bob\n1 2 3 4 5"), (4, "user login was made by beta from home today\n1 2 3 4 6\nalpha"), (5, "1 2 3 4 5"),
    ]
    clash = {c: F.lit("x") for c in ("__doc", "__lines", "doc", "TH", "gone", "lines", "size", "h1", "first")}
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns(clash)
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_lines(docs).collect()}
    assert got == {1: texts[0][1], 2: "user login was seen near gate one by bob\nrow of 3 4 5 6 7 9", 3: "1 2 3 4 5", 4: "1 2 3 4 6\nalpha", 5: ""}


def test_alike_lines_against_all_pairs(spark):
    rng = random.Random(21)
    lines = []
    for n in (5, 6, 9, 10, 14, 15, 19, 20, 33, 70, 2000):
        for _ in range(4):
            base = [rng.choice("abc") for _ in range(3)] + [word(rng) for _ in range(n - 3)]
            for _ in range(12):
                own = list(base)
                for i in rng.sample(range(3, n), min(n - 3, rng.randint(0, n // 5 + 2))):
                    own[i] = rng.choice(["x", "y", "z"]) + own[i]
                lines.append(" ".join(own))
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in line_templates.drop_lines(docs).where("n_dropped = 0").collect())
    ts = [t.split() for t in lines]
    up = list(range(len(ts)))
    for j in range(len(ts)):
        for i in range(j):
            if len(ts[i]) == len(ts[j]) and ts[i][:3] == ts[j][:3] and 5 * sum(a == b for a, b in zip(ts[i], ts[j], strict=True)) >= 4 * len(ts[i]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert got == sorted(set(up))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(4)
    kinds = {"aa": "the and ing ion ther wh", "bb": "que ado ción los ente ar", "cc": "привет мир как дела ово ение"}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [(i, text(k, 60), k) for i, k in enumerate(list(kinds) * 40)]
    mixed = text("aa", 40) + " " + text("bb", 40)
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), mixed


def test_language_id(spark, languages):
    docs, mixed = languages
    model = langid.fit(docs)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "123 !! 45"), (903, "漢字だけ"), (904, mixed), (None, "the wh and")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (900, 901, 902))
    assert (got[903]["lang_pred"], got[903]["lang_score"], got[903]["lang_spans"]) == (model.languages[int(model.prior.argmax())], 0.0, [])
    assert got[None]["lang_pred"] == "aa"
    (half,) = langid.Labeller(model).label(["the ing wh and 漢字 漢 字 かな"])
    assert half[:2] == ("aa", 0.5)
    assert [s["lang"] for s in got[904]["lang_spans"]] == ["aa", "bb"] and got[904]["lang_spans"][-1]["end"] == len(mixed)
    held = langid.identify(docs.where(langid.held_out()), model)
    assert held.where("lang_pred <> lang").count() == 0 and held.count() > 5
    assert langid.identify(odd, langid.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def plain_label(labeller, text):
    """(language, score) by plain Viterbi, word by word."""
    words = [w for w in langid.find_words(text.lower()) if langid.has_letter(w)]
    (every,) = labeller.numbers([text])
    assert len(every) == len(words)
    e = labeller.scores[every[every > 1]].astype(float)
    languages = labeller.model.languages
    if not len(words):
        return "und", 0.0, None
    if not len(e):
        return languages[int(labeller.model.prior.argmax())], 0.0, None
    best, back = e[0], []
    for row in e[1:]:
        to = np.where(best >= best.max() - labeller.switch, np.arange(len(best)), best.argmax())
        back.append(to)
        best = np.maximum(best, best.max() - labeller.switch) + row
    at = [int(best.argmax())]
    for to in reversed(back):
        at.append(int(to[at[-1]]))
    n = np.bincount(at, minlength=len(languages))
    top = sorted(np.flatnonzero(n == n.max()), key=lambda k: (-e.sum(axis=0)[k], k))[0]
    return languages[top], n[top] / len(words), best.max()


@pytest.mark.parametrize("room", [1, 64 * 9 * 3, langid.ROOM])
def test_language_against_plain_viterbi(languages, room):
    docs, mixed = languages
    model = langid.fit(docs)
    labeller = langid.Labeller(model, switch=3.0, room=room)
    rng = random.Random(6)
    own = [r["text"] for r in docs.limit(12).collect()]
    texts = [mixed, prose(rng, 200), mixed * 3, "the", "", "漢字", mixed + " 漢字 " + own[2], " ".join(own) * 2, *own]
    numbers = [x[x > 1] for x in labeller.numbers(texts)]
    for text, own, path, got in zip(texts, numbers, labeller.paths(numbers), labeller.label(texts), strict=True):
        lang, score, value = plain_label(labeller, text)
        if value is not None:
            e = labeller.scores[own].astype(float)
            assert e[np.arange(len(path)), path].sum() - 3.0 * (np.diff(path) != 0).sum() == pytest.approx(value, abs=0.05)
        assert got[0] == lang and got[1] == pytest.approx(score, abs=0.02)


def test_many_languages_and_marks(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{k:03d}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(4)] for k in range(140)}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k, 40), k) for i, k in enumerate(list(kinds) * 3)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    own = list(model.languages)
    texts = [text(k, 30) for k in own] + [text(own[-1], 3000) + " " + text(own[0], 3000)]
    got = langid.Labeller(model).label(texts)
    assert sum(g[0] == k for g, k in zip(got, own, strict=False)) >= 0.95 * len(own)
    spans = got[-1][2]
    assert len(spans) < 8 and max(spans, key=lambda x: x[1] - x[0])[2] in (own[-1], own[0]) and (spans[0][2], spans[-1][2]) == (own[-1], own[0])
    assert langid.find_words("e\u0301te\u0301 हिन्दी ก็") == ["été", "हिन्दी", "ก็"]


def test_packing_respects_conflicts(spark, docs, rows):
    got = packing.pack(docs, packing.words(), packing.same_text(), capacity=64, shard=20).collect()
    again = packing.pack(docs.repartition(3), packing.words(), packing.same_text(), capacity=64, shard=20).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    size = sorted((str(i), max(1, len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")))) for i, t, *_ in rows)
    total = {}
    for r in got:
        total[str(r["doc_id"])] = total.get(str(r["doc_id"]), 0) + r["length"]
    want = {}
    for i, n in size:
        want[i] = want.get(i, 0) + n
    assert total == want
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    sources = {i: s for i, _, _, s, _ in rows if s}
    for own in bins.values():
        assert sum(r["length"] for r in own) <= 64
        s = [sources[r["doc_id"]] for r in own if r["doc_id"] in sources]
        assert len(s) == len(set(s))
        assert sorted(r["place"] for r in own) == list(range(len(own)))
    assert packing.pack(empty(docs), packing.words(), packing.same_text()).count() == 0


def test_packing_keeps_ids_and_deals_out_repeats(spark):
    big = 1 << 53
    rows = [(big + 1, "a b c", "s"), (big + 3, "d e", None), (None, "f", "s"), (None, None, None), (-(1 << 63), "g h i", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("n", "low", "number", "piece", "tokens", "cluster")})
    got = sorted((str(r["doc_id"]), r["length"]) for r in packing.pack(docs, packing.words(), packing.same_text()).collect())
    assert got == sorted([(str(big + 1), 3), (str(big + 3), 2), ("None", 1), ("None", 1), (str(-(1 << 63)), 3)])
    equal = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    out = packing.pack(equal, packing.words(), packing.same_text(), shard=1000)
    sizes = [r["count"] for r in out.groupBy(F.split("bin_id", "-")[0].alias("shard")).count().collect()]
    assert sum(sizes) == 100_000 and len(sizes) == 100 and max(sizes) < 1300
    assert out.groupBy("bin_id").count().where("count > 1").count() == 0


def test_packing_over_shards_against_a_plain_version(spark, docs, rows):
    got = packing.pack(docs, packing.words(), packing.same_text(), capacity=64, shard=20).collect()
    clusters = {r["doc_id"]: r["c"] for r in docs.select("doc_id", packing.same_text().alias("c")).collect() if r["doc_id"] is not None}
    sources = {i: s for i, _, _, s, _ in rows}
    null_first = lambda x: (x is not None, x or 0)
    shards = {}
    for r in got:
        shards.setdefault(r["bin_id"].split("-")[0], []).append(r)
    for own in shards.values():
        if any(r["doc_id"] is None for r in own):
            continue  # two texts without an id can't be told apart here
        own = sorted(own, key=lambda r: (-r["length"], null_first(r["doc_id"]), r["piece"], r["bin_id"], r["place"]))
        room, held, want = [], [], []
        for r in own:
            s, c = sources[r["doc_id"]], clusters[r["doc_id"]]
            fit = [(room[b], b) for b in range(len(room)) if room[b] >= r["length"] and ("s", s) not in held[b] and ("c", c) not in held[b]]
            if not fit:
                room.append(64)
                held.append(set())
            b = min(fit)[1] if fit else len(room) - 1
            room[b] -= r["length"]
            held[b] |= {x for x in (("s", s), ("c", c)) if x[1] is not None}
            want.append((r["doc_id"], b))
        assert sorted(want) == sorted((r["doc_id"], int(r["bin_id"].split("-")[1])) for r in own)


def test_best_fit_against_a_plain_version():
    rng = random.Random(8)
    pieces = sorted(((rng.randint(1, 40), rng.choice("abcdefgh"), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(400)), key=lambda p: -p[0])
    bins, want = [], []
    for n, s, c in pieces:
        fit = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= n and s not in b["s"] and (c is None or c not in b["c"])]
        if not fit:
            bins.append({"room": 64, "s": set(), "c": set(), "n": 0})
        i = min(fit)[1] if fit else len(bins) - 1
        b = bins[i]
        want.append((i, b["n"]))
        b["room"] -= n
        b["s"].add(s)
        b["c"].add(c)
        b["n"] += 1
    assert list(packing.pack_shard(pieces, 64)) == want


WRAPPED = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
CLEAN = [
    None, "", "nothing of the kind", "She lost her driving license in May and walked.", "The permission slip was signed by both parents.",
    "The warranty covers the software of the car, provided that the above conditions are met by the owner.", "Copyright and public domain were the topics of the licence course, free of charge for any person.",
    "The General Public was told of the License by the Foundation, under the terms of the meeting.", "Mozilla and GNU have to be named in any copy of the warranty.",
]


def test_licences(spark):
    rng = random.Random(31)
    negatives = [[word(rng) for _ in range(30)] for _ in range(20)] + [re.findall("[a-z]+", t.lower()) for t in CLEAN[3:5]]
    model = licences.fit(negatives)
    filler = lambda: prose(rng, rng.randint(5, 150)).capitalize() + "."
    docs = []
    for f, t in WRAPPED.items():
        for width in (60, 78, 1000):
            docs.append((f, f"{filler()}\n\n{textwrap.fill(t, width)}\n\n{filler()}"))
            docs.append((f, filler() + "\n" + "\n".join("# " + x for x in textwrap.wrap(t, width)) + f"\n{filler()}"))
        docs.append((f, prose(rng, 5000) + " " + t + " " + prose(rng, 3000)))
    docs += [(f, f"{filler()}\n{t}\n{filler()}") for f, own in licences.TEMPLATES.items() for t in own]
    docs += [(None, t) for t in CLEAN] + [(None, filler()) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, (_, t) in enumerate(docs)] + [(None, None, "x", "y")], "doc_id long, text string, found string, paragraph string")
    got = {r["doc_id"]: [tuple(x) for x in r["found"]] for r in licences.scan(df, model).collect()}
    for i, (f, t) in enumerate(docs):
        assert {x[1] for x in got[i] if x[3]} == ({f} if f else set()), (f, t and t[:300], got[i])
        # a plain second version: every window is scored, without the gate
        want = {}
        for k, p in enumerate(licences.paragraphs(t or "")):
            for w in licences.windows(licences.words(p)):
                ((family, score),) = model.predict([w])
                if family != licences.UNKNOWN and licences.confirmed(family, w):
                    want[k, family] = max(want.get((k, family), 0), round(score, 5))
        assert {(x[0], x[1]): round(x[2], 5) for x in got[i] if x[3]} == want
    assert got[None] == [] and licences.scan(df.limit(0), model).count() == 0


def test_licences_fit_on_a_corpus(spark):
    texts = [*WRAPPED.values(), *[t for t in CLEAN if t], "in case of the loss of the copy, the software is to be sold. " * 40] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = licences.fit_on(docs, negatives=50)
    assert {x[1] for x in licences.judged(WRAPPED["MIT"], model) if x[3]} == {"MIT"} and not [x for t in CLEAN if t for x in licences.judged(t, model) if x[3]]


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:80] = x[50]  # a group of copies
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (1004, [None] * 16), (1005, []), (None, x[0].tolist())]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 600, 50):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        s = np.round(u @ u[q], 12)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:5]
        hits += len(set(want) & {r["vec_id"] for r in own})
        if q == 50:
            assert [r["vec_id"] for r in own] == [51, 52, 53, 54, 55]
        assert all(abs(r["score"] - u[q] @ u[r["vec_id"]]) < 1e-9 for r in own)
    assert hits >= 0.9 * 60 and len(got) == 60
    few = neighbours.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_in_a_tight_group(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x[:2000] = x[0] + 0.004 * rng.standard_normal((2000, 64))  # cosines above 0.9999 that all differ
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, (F.col("vec_id") < 2000) & (F.col("vec_id") % 50 == 0)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        s = u @ u[q]
        s[q] = -2
        hits += len({*np.argsort(-s)[:5].tolist()} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 200, hits / 200


def test_neighbours_of_many_clusters(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))[rng.integers(0, 400, 12_000)] + 0.15 * rng.standard_normal((12_000, 64))
    x[3000:7000] = x[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, asked = 0, [q for q in range(0, 12_000, 50) if not 3000 <= q < 7000]
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        worst = np.partition(s, -5)[-5]
        hits += sum(s[r["vec_id"]] >= worst - 1e-12 for r in got if r["query_id"] == q)
    assert hits >= 0.9 * 5 * len(asked), hits / len(asked) / 5
    copies = [r["vec_id"] for r in got if r["query_id"] == 3050]
    assert sorted(copies) == [0, 3000, 3001, 3002, 3003]
