"""Each operator against brute force on small rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import components, decontamination, language_id, lm_scoring, pieces, sentencepiece_codec, shared, sharding, simhash_dedup, suffix_dedup, token_counts, topk_threshold, warc

PASSAGE = "one common passage of words that many of the texts have in them, and which is longer than a hundred bytes by far"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = ["the cat sat on the mat", "the cat sat on the mat", None, "", "Zwölf Boxkämpfer jagen Viktor", PASSAGE, "before " + PASSAGE + " after", LONG, LONG[:5000], "a" * 400, "1234 !!", "漢字 😀 é\n\n\tx"]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated ids, a null id, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en" if i % 2 else "de", i) for i, t in enumerate(TEXTS)] + [(3, "", "en", 1), (None, PASSAGE, None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long").withColumns({"id": F.lit(1), "rest": F.lit("x"), "part": F.lit(2), "spans": F.lit(3), "none": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_token_counts_and_codec(docs, empty):
    library = pieces.pieces_of(pieces.read_model(None)).processor
    want = sorted((t or "", len(library.encode(t or ""))) for t in [r["text"] for r in docs.collect()])
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(docs, limit=100).collect()) == sorted(n for _, n in want)
    got = sentencepiece_codec.encode(docs).collect()
    assert all(r["checked"] for r in got)
    assert sorted(tuple(r["ids"]) for r in got) == sorted((*library.encode(t), library.eos_id()) for t, _ in want)
    assert sorted(r["decoded"] for r in got) == sorted(library.decode(library.encode(t)) for t, _ in want)
    assert token_counts.count_tokens(empty).count() == 0 and sentencepiece_codec.encode_digest(empty).count() == 0


def test_random_strings_tokenise_as_the_library_does():
    p = pieces.pieces_of(pieces.read_model(None))
    merger, rng = token_counts.RankMerger(p), random.Random(1)
    parts = ["a", " ", "  ", "the", "ing", "\n", "é", "漢", "😀", "▁", "<s>", "<0x0A>", "\x00", "aaaa", "    ", ".", "²", "'s", "ﬁ"]
    for _ in range(2_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = p.processor.encode(text)
        assert [i for s in p.stretches(text) for i in sentencepiece_codec.agenda_encode(s, p)] == want
        assert sum(merger.count(p.stretches(text))) == len(want)


def test_language(spark, docs, empty, monkeypatch):
    train = spark.createDataFrame([("en", "the quick brown fox and the dog " * 5), ("de", "der schnelle braune Fuchs und der Hund " * 5), (None, "x y z")], "lang string, text string")
    model = language_id.fit(train)
    assert list(model) == ["de", "en"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model, carry=["doc_id", "rest"]).collect()}
    assert got[0][0] == "en" and got[2] == got[3] == got[10] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(empty, model, carry=["doc_id"]).count() == 0
    assert language_id.fit(empty) == {} and language_id.predict(docs, {}, carry=["doc_id"]).where("lang_pred <> 'und'").isEmpty()
    # bundling by counts is the sum of the grams' own vectors
    grams = language_id.trigrams("der Hund")
    assert np.array_equal(language_id.bundle([grams], np.array([0]), 1, 512, 1)[0], language_id.gram_vectors(grams, 512, 1).astype(int).sum(axis=0))
    # every letter has its own vector: cut up, with few letters and with many, sums are the same
    texts = ["漢字仮名交じり文 привет Ελλάδα", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))]
    many = [language_id.trigrams(t) for t in texts]
    want = [language_id.gram_vectors(g, 512, 1).astype(int).sum(axis=0) for g in many]
    monkeypatch.setattr(language_id, "GRAMS_AT_ONCE", 7)
    assert np.array_equal(language_id.bundle(many, np.arange(2), 2, 512, 1), want)
    vectors = language_id.letter_vectors(np.arange(0x400, 0x500), 512, 1)
    assert set(np.unique(vectors)) == {-1, 1} and np.abs(vectors.astype(int) @ vectors.T - 512 * np.eye(256, dtype=int)).max() < 150


def test_sharding(docs, empty):
    rows = sharding.shuffle_to_shards(docs, shards=5, rows_per_part=3).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and {len(x) for x in slots.values()} <= {2, 3} and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shuffle_to_shards(docs.repartition(3), shards=5, rows_per_part=3).collect()))
    assert sharding.shuffle_to_shards(empty).count() == 0


def test_sharding_of_one_row_many_times(spark):
    """Equal rows are spread over partitions as others are, whatever the layout."""
    rows = [(1, "same")] * 600 + [(None, None)] * 200 + [(i, "x") for i in range(100)]
    found = []
    for parts in (2, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sharding.shuffle_to_shards(df, shards=6, rows_per_part=50).collect()
        sizes = Counter(r["shard"] for r in got)
        assert set(sizes.values()) == {150} and sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(6) for k in range(150)]
        assert all(75 <= n <= 125 for n in Counter(r["shard"] for r in got if r["doc_id"] == 1 and r["size"] == 12).values())
        found.append(sorted(map(str, got)))
    assert found[0] == found[1]


def test_communication_matrix():
    matrix = sharding.communication_matrix([5, 0, 7, 9], [7, 7, 7], 3)
    assert [sum(r) for r in matrix] == [5, 0, 7, 9] and [sum(c) for c in zip(*matrix, strict=True)] == [7, 7, 7]
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 10**12, 10**12, 10_000) for _ in range(200)]
    assert abs(np.mean(draws) - 5_000) < 20 and 35 < np.std(draws) < 65


def test_simhash(docs, empty):
    got = simhash_dedup.near_duplicates(docs).collect()
    prints = {r["fingerprint"] for r in got}
    ids = defaultdict(list)
    for r in docs.collect():
        ids[f"{simhash_dedup.fingerprint(r['text']):016x}"].append(r["doc_id"])
    assert prints == set(ids) and simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0
    assert {r["doc_id"]: r["component_id"] for r in got}[1] == 0 and {r["component_id"] for r in got if int(r["fingerprint"], 16) == 0} == {2}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r["component_id"] for r in got})


def test_links_of_hot_keys(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(300)}
    u = sorted(values)
    signed = np.array(u, np.uint64).view(np.int64).tolist()
    links = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), group_rows=16)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(u):
        for j in range(i):
            if (a ^ u[j]).bit_count() <= 3:
                parent[find(signed[i])] = find(signed[j])
    groups = lambda f: sorted(sorted(g) for g in _classes(signed, f) if len(g) > 1)
    assert groups(find) == groups(lambda x: roots.get(x, x))


def test_pivots_prune_before_pairs_are_formed():
    rng = np.random.default_rng(6)
    fps = rng.integers(0, 2**64, 400, np.uint64)
    fps[200:] = fps[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    same, formed = np.zeros(400, int), []
    found = simhash_dedup.links_within(same, same, same, fps, 3, formed=formed)
    assert {frozenset(x) for x in found} == {frozenset((i, i + 200)) for i in range(200)}
    assert sum(formed) < 400 * 399 / 2 * 0.6


def _classes(items, f):
    out = defaultdict(list)
    for x in items:
        out[f(x)].append(x)
    return out.values()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    rows = components.connected_components(links).collect()
    assert len(rows) == 203 and len({r["root"] for r in rows}) == 2
    assert components.connected_components(links.where("false")).count() == 0


def _repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        data, spans = (t or "").encode(), []
        for k in range(len(data) - length + 1):
            w = data[k : k + length]
            if w in seen:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
            seen.add(w)
        out.append([tuple(s) for s in spans])
    return out


def test_suffix_dedup(spark, docs, empty):
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted((r["text"] or "", s) for r, s in zip(rows, _repeats([r["text"] for r in rows], 100), strict=True))
    found = suffix_dedup.repeated_spans(docs, carry=["doc_id", "spans"], kept="text").drop("spans")
    assert found.columns[:2] == ["doc_id", "text"]
    got = suffix_dedup.repeated_spans(docs, carry=["doc_id"], kept="text").collect()
    assert sorted((r["text"] or "", [(s["start"], s["end"]) for s in r["spans"]]) for r in got) == want
    assert suffix_dedup.repeated_spans(empty, carry=["doc_id"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_random(spark, seed):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randint(3, 30))) for _ in range(12)]
    texts = ["".join(rng.choice(blocks) for _ in range(rng.randint(0, 20))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.repeated_spans(df, carry=["doc_id"], length=20, gram=8, hot_contexts=seed).collect()}
    assert [got[i] for i in range(60)] == _repeats(texts, 20)


def _morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("hot", [512, 4])
def test_suffix_dedup_of_shared_edges_and_regular_strings(spark, hot):
    """A passage in every document between other words, strings in which simple hashes collide, and runs of one letter."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(140))
    texts = [f"{rng.random()} {passage}{'!' * (i % 3)} {rng.random()}" * (1 + i % 2) for i in range(60)]
    morse = _morse(1 << 12)
    texts += [morse, "".join("ba"[c == "b"] for c in morse), morse[100:900] + "c" + morse[2000:2300], "a" * 700 + "b" + "a" * 300, "ab" * 400, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in suffix_dedup.repeated_spans(df, carry=["doc_id"], hot_contexts=hot).collect()}
    assert [got[i] for i in range(len(texts))] == _repeats(texts, 100)


def test_sort_suffixes():
    rng = np.random.default_rng(3)
    data = np.r_[rng.integers(97, 99, 600), np.zeros(30, int)].astype(np.uint8)
    places, bucket = rng.permutation(580), rng.integers(0, 2, 580)
    order, equal = suffix_dedup.sort_suffixes(data, suffix_dedup.PrefixHashes(data), places, bucket, 12)
    keys = [(bucket[i], bytes(data[places[i] : places[i] + 12])) for i in order]
    assert keys == sorted(keys) and equal.tolist() == [False] + [a == b for a, b in zip(keys, keys[1:], strict=False)]


def test_decontamination(spark, docs, empty, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, "the cat"), (3, None), (4, "!!"), (None, "before ONE common"), (2, PASSAGE)], "item_id long, text string")
    got = {r["text"]: r for r in decontamination.with_verdict(decontamination.find(docs, items, carry=["doc_id"])).collect()}
    n = len(PASSAGE.split())
    assert (got[PASSAGE]["n_hit"], got[PASSAGE]["items"], got[PASSAGE]["contaminated"]) == (n, ["1", "2"], True)
    assert got["before " + PASSAGE + " after"]["items"] == ["", "1", "2"] and got["before " + PASSAGE + " after"]["n_hit"] == n + 1
    assert got["the cat sat on the mat"]["n_hit"] == 2 and got[LONG]["n_hit"] == 0 and got[LONG]["n_words"] == 30_000
    one = sorted(str(r) for r in decontamination.find(docs, items, carry=["doc_id"]).collect())
    assert one == sorted(str(r) for r in decontamination.find(docs, items, carry=["doc_id"], block_bytes=40, shard_words=10).collect())
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 2)
    assert [p.split() for p in decontamination.pieces("a b c d e", 3, 2)] == [["a", "b", "c", "d"], ["c", "d", "e"]] and decontamination.pieces("!", 3) == [""]
    assert one == sorted(str(r) for r in decontamination.find(docs, items, carry=["doc_id"]).collect())
    assert decontamination.find(empty, items, carry=[]).count() == 0 and decontamination.find(docs, items.where("false"), carry=["doc_id"]).where("size(spans) > 0").isEmpty()
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(decontamination.find(docs, items, carry=["doc_id"])).collect()}
    assert cut[6] == " after" and cut[0] == " sat on the mat"


def test_fm_index():
    rng = np.random.default_rng(4)
    symbols = np.r_[0, rng.integers(0, 5, 400), 0]
    index = decontamination.Index(symbols, 3)
    for symbol in range(5):
        at = rng.integers(0, len(symbols), 30)
        assert index.rank(np.full(30, symbol), at).tolist() == [int((index.before[:a] == symbol).sum()) for a in at]


def test_lm_scores(spark, docs, empty):
    rows = docs.collect()
    words = [(r["text"] or "").encode().lower().split() for r in rows]
    one, two = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:], strict=False))
    total, want = sum(one.values()), []
    for x in words:
        own, pairs, s = Counter(x), Counter(zip(x, x[1:], strict=False)), 0.0
        for i, w in enumerate(x):
            v = max(one[w] - own[w], 1) / max(total - len(x), 1)
            if i:
                c = two[x[i - 1], w] - pairs[x[i - 1], w]
                v = c / (one[x[i - 1]] - own[x[i - 1]]) if c > 0 else 0.4 * v
            s += np.log(v)
        want.append(s)
    scored = lm_scoring.score(docs)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # other splits for the pass that runs now
    got = scored.collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert np.allclose(sorted(r["log_score"] for r in got), sorted(want)) and sorted(r["n_words"] for r in got) == sorted(map(len, words))
    assert lm_scoring.score(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(300, 6)), 2)
    vectors[100:140] = vectors[100]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(1000, None, 0), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (1002, [float("nan")] * 6, 0), (None, [9.0] * 6, 0), (1003, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = defaultdict(list)
    for r in topk_threshold.top_k(df.where("vec_id % 100 = 0"), df, k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    q = np.floor(1024 * vectors).astype(int)
    for i in (0, 100, 200):
        scores = q @ q[i]
        assert got[i] == [(int(j), int(scores[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-scores[j], j))[:10]]
    assert set(got) == {0, 100, 200} and topk_threshold.top_k(df.where("false"), df).count() == 0 and topk_threshold.top_k(df, df.where("false")).count() == 0
    small = topk_threshold.top_k(df.where("vec_id % 100 = 0"), df, k=10, query_block=1)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in small.collect()) == sorted((q, v, s) for q, x in got.items() for v, s in x)
    big = spark.createDataFrame([(1, [3e12, 1.0]), (2, [3e12, -1.0]), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_threshold.top_k(big.where("vec_id = 100"), big, k=5).orderBy("rank").collect()] == [(100, 1, 1, 1024 * (1024 * 3 * 10**12 + 1024)), (100, 2, 2, 1024 * (1024 * 3 * 10**12 - 1024))]
    with pytest.raises(Exception, match="64 bits"):
        topk_threshold.top_k(big, spark.createDataFrame([(5, [1e17])], big.schema)).collect()


def test_warc(spark):
    rows = [(5, "u", "x" * 200), (2, "http://a b/é", "x" * 200), (9, None, "x" * 200), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (None, "u", "é" * 200), (7, "u", "é" * 200), (7, "u", "é" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = warc.round_trip(df).collect()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (7, "response", None), (7, "response", None), (9, "revisit", 2)]
    by = {r["page_id"]: r for r in got}
    assert by[5]["payload_bytes"] == 200 and by[5]["payload_digest"] == hashlib.sha256(b"x" * 200).hexdigest() and bytes(by[2]["payload"]) == b"x" * 200
    assert by[4]["payload_bytes"] == 0 and warc.round_trip(df.where("false")).count() == 0


def test_normaliser_reads_a_single_stream():
    import gzip
    import io

    rows = [{"kind": "response", "id": i, "url": "u", "digest": "d", "n_bytes": 1, "payload": "p" * i, "refers_to": None} for i in range(40)]
    data = b"".join(map(warc.record, rows))
    for blob in (gzip.compress(data), gzip.compress(data[:999]) + gzip.compress(data[999:])):
        assert [x for _, x in warc.records(warc.inflate(io.BytesIO(blob)))] == [warc.record(r) for r in rows]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(data[:-3])))))


def _edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def _similar_classes(texts, shingle, similarity):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle, 0) + 1)} if w else set() for w in words]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) >= similarity * len(a | b) - 1e-9 and a and b:
                root = [root[j] if r == root[i] else r for r in root]
    return {frozenset(g) for g in _classes(range(len(texts)), root.__getitem__)}


def test_similar_is_jaccard(spark, monkeypatch):
    """Near copies with a few words changed, a hundred bits and more texts a group than a piece holds, against all pairs."""
    rng, texts = random.Random(7), [None, "", " \n", "one two", "ONE  two", "one two three"]
    for _ in range(40):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(words), *(" ".join(_edited(rng, words, max(1, len(words) * share // 1_000))) for share in (5, 10, 15, 60, 100))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = _similar_classes(texts, 5, 0.8)
    near = {g for g in want if len(g) > 1}
    for size in (simhash_dedup.GROUP_ROWS, 2):
        monkeypatch.setattr(simhash_dedup, "GROUP_ROWS", size)
        rows = shared.numbered(df, "n", "rows")
        names = {r["n"]: r["doc_id"] for r in rows.collect()}
        of = {names[r["n"]]: r["component_id"] for r in simhash_dedup.similar(rows, id_col="n", shingle=5, similarity=0.8).collect()}
        found = _classes(of, of.get)
        got = {frozenset(g) for g in found}
        assert len(near) > 30 and len(near - got) <= len(near) // 20
        assert all(any(g <= w for w in want) for g in got)
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(df, shingle=5, similarity=0.8).collect()}
    assert kept == {min(g) for g in got}
    assert simhash_dedup.keep_one(df.where("false"), shingle=5, similarity=0.8).count() == 0


def test_candidates_of_hot_bands(spark):
    """Texts of one band are connected over all parts of it, a text without bands is in no link, and links are no more than rows."""
    rng = random.Random(3)
    rows = [(n, [7, rng.getrandbits(40)]) for n in range(1_000)] + [(n, [rng.getrandbits(40), rng.getrandbits(40)]) for n in range(1_000, 2_000)] + [(2_000, []), (2_001, [8, 7])]
    found = simhash_dedup.candidates(spark.createDataFrame(rows, "n long, bands array<long>")).collect()
    got = components.connected_components(spark.createDataFrame(found, "a long, b long")).collect()
    # the same number in another band is another key
    assert {frozenset(g) for g in _classes([r["node"] for r in got], {r["node"]: r["root"] for r in got}.get)} == {frozenset(range(1_000))}
    assert len(found) == 999


def test_candidates_of_a_text_dont_grow_with_the_table(spark):
    rng = random.Random(4)
    words = ["the", "of", "and", "to", "in", "that", "it", "was", "for", "on", "are", "as", "with", "his", "they", "at"]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(8_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    drawn = shared.materialised(simhash_dedup.prints(df, id_col="id", text_col="text", shingle=5), "prints")
    links = [simhash_dedup.candidates(drawn.where(f"n < {n}").select("n", "bands")).count() for n in (500, 2_000, 8_000)]
    assert all(x <= 0.02 * n for x, n in zip(links, (500, 2_000, 8_000), strict=True)), links


def test_chance_of_a_shared_band():
    """Sets of Jaccard 0.8 share a band nearly always, sets of 0.3 rarely."""
    masks, factors = simhash_dedup.band_hashes()
    rng, met = random.Random(6), Counter()
    for _ in range(300):
        for both, apart in ((80, 20), (30, 70)):
            words = [f"{rng.getrandbits(60):x}" for _ in range(both + apart)]
            sides = words[: both + apart // 2], words[:both] + words[both + apart // 2 :]
            drawn = []
            for side in sides:
                joined = " ".join(side).encode()
                stops = np.cumsum([len(w) + 1 for w in side]) - 1
                drawn.append(simhash_dedup.sketch(joined, [0, *(stops[:-1] + 1).tolist()], stops.tolist(), masks, factors)[1])
            met[both] += any(x == y for x, y in zip(*drawn, strict=True))
    assert met[80] >= 298 and met[30] <= 60
