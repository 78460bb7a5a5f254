import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import edge_rows
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, language_id, line_dedup, linking, minhash, mixing, ngram_join, packing, paragraph_dedup, quality_fm, quality_rules, url_filter

PAIRS = [(r[0], r[1]) for r in edge_rows()]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(docs, none):
    got = by_id(exact_dedup.identities(docs, block=64, window_bytes=4096), "keep_id", "group_size", "text_sha256")
    assert got == brute.same_texts(PAIRS)
    assert exact_dedup.identities(none).count() == 0
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v[0] for v in got.values()}


def test_exact_dedup_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.identities(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, 2, True), (1, 1, 2, True), (None, None, 1, True), (None, 2, 2, False), (2, 2, 2, True)], key=str)


def test_quality_rules_base(docs, none, labels):
    got = by_id(quality_rules.judged(docs, labels.where("quality = 1")), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in PAIRS:
        want = brute.base_rules(t)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i][:6] == (*want, failed) and not (failed and got[i][6]), i
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.judged(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_log_ratio_separates(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 40}" for k in range(60))) for i in range(60)]
    junk = [(100 + i, " ".join(f"word{(i * 7 + k) % 40}***" for k in range(60))) for i in range(20)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    got = by_id(quality_rules.judged(df, df.where("doc_id < 30")), "log_ratio")
    assert min(got[i][0] for i, _ in clean) > quality_rules.THRESHOLD > max(got[i][0] for i, _ in junk)


def test_ngram_components(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(docs).collect()}
    assert got == brute.ngram_components(PAIRS)
    assert ngram_join.components_of(none).count() == 0


def test_frequent_tokens_use_combinations(spark, monkeypatch):
    """All tokens in frequent classes and no stars: the combinations alone must find every link."""
    import random

    r = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "FREQUENT", -1e9)
    monkeypatch.setattr(linking, "CAP", 1)
    monkeypatch.setattr(linking, "WIDE", 1)
    monkeypatch.setattr(linking, "COMMON", 10)
    monkeypatch.setattr(linking, "STARS", 0)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(df).collect()}
    assert got == brute.ngram_components(texts)


def random_pairs(rng, most=80):
    """Sets of tokens, the larger first, many of them similar."""
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, most))).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.random() * 0.2]
        b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, len(a) // 8 + 2))).astype(np.uint64)]))
        x, y = sorted((a, b), key=len, reverse=True)
        k = len(np.intersect1d(x, y))
        if len(y) and 100 * k >= 80 * (len(x) + len(y) - k):
            yield x, y


@pytest.mark.parametrize("level", [-1.0, 4.0, 20.0])
@pytest.mark.parametrize("long", [None, 0.3])
def test_similar_sets_share_a_prefix_token(level, long):
    """Rare ones meet; else both have others and go to the prefix join. Sketches leave room for them."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 12, ngram_join.BUCKETS)
    places = None if long is None else rng.random(linking.LONG_PLACES) < long
    for x, y in random_pairs(rng, 300):
        (sx, bx), (sy, by) = ngram_join.prefix(x, counts, level, places), ngram_join.prefix(y, counts, level, places)
        assert linking.alike(linking.sketch(x), linking.sketch(y), len(x), len(y), 80)
        assert set(sx.tolist()) & set(sy.tolist()) or (bx and by)


@pytest.mark.parametrize("common", [0, 6, 20])
def test_similar_sets_share_a_combination(common, monkeypatch):
    """The smaller set's index and the larger's probe always meet, with or without tokens that no other set has."""
    monkeypatch.setattr(linking, "COMMON", common)
    rng = np.random.default_rng(5)
    for x, y in random_pairs(rng):
        alone = rng.random() < 0.5
        some = np.intersect1d(x, y)
        of = {t: int(rng.integers(1, 13)) for t in np.union1d(x, y).tolist()}
        made = []
        for s in (x, y):
            t = np.array(sorted((some if alone else s).tolist(), key=lambda t: (of[t], t)), np.uint64)
            made.append(linking.combined(t.view(np.int64), np.array([of[i] for i in t.tolist()]), len(s), 80))
        (probe, _), (index, n) = made
        assert set(probe) & set(index[:n]), (len(x), len(y), len(some))


def test_sketches_of_unlike_sets():
    rng = np.random.default_rng(12)
    draw = lambda n: linking.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
    assert not any(linking.alike(draw(n), draw(int(n * 0.9)), n, int(n * 0.9), 80) for n in (30, 100, 1000))


@pytest.mark.parametrize(("wide", "base"), [(3, False), (20, True), (4096, False), (4096, True)])
def test_long_lists_give_the_same_components(spark, monkeypatch, wide, base):
    """Near copies of a text that is among them or not, with shared and with single edits, against all pairs."""
    import random

    monkeypatch.setattr(linking, "CAP", 3)
    monkeypatch.setattr(linking, "WIDE", wide)
    monkeypatch.setattr(linking, "COMMON", 20)
    r = random.Random(11)
    texts = []
    for i in range(70):
        w = [f"w{k}" for k in range(60 + i % 3)]
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(4 if i % 2 else 4000)}"
        texts.append((i, " ".join(w)))
    if base:
        texts.append((99, " ".join(f"w{k}" for k in range(60))))
    texts += [(100 + i, " ".join(f"y{r.randrange(400)}" for _ in range(30))) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components_of(df).collect()}
    assert got == brute.ngram_components(texts)


def test_rows_that_share_a_doc_id_keep_all_links(spark):
    from conftest import prose

    a, b = prose(31, 40), prose(32, 40)
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b + " more"), (None, b), (9, ""), (9, "x y z")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (None, None), (9, 9)}


def test_fuzzy_lines(docs, none):
    got = by_id(line_dedup.deduplicated(docs), "n_lines", "removed_lines")
    assert {i: (n, list(x)) for i, (n, x) in got.items()} == brute.fuzzy_lines(PAIRS, size=line_dedup.SHINGLE)
    assert line_dedup.deduplicated(none).count() == 0


def test_band_recall():
    n, r = minhash.tuned(0.8, 0.995, 48)
    assert minhash.recall(0.8, n, r) >= 0.995
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in "ab")
        keys = minhash.bands(np.concatenate([a, b]), np.array([0, 90, 180]), n, r)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 295


def test_fuzzy_lines_of_49_characters(spark):
    """One changed inner character: similar by shingles of five characters, not by longer ones."""
    line = "the quick brown fox jumps over the lazy dogs home"
    docs = [(1, line), (2, line[:24] + "#" + line[25:]), (3, "an unrelated line that stands in a text by itself")]
    got = by_id(line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")), "n_lines", "removed_lines")
    assert len(line) == 49 and {i: (n, list(x)) for i, (n, x) in got.items()} == brute.fuzzy_lines(docs, size=5) == {1: (1, []), 2: (1, [0]), 3: (1, [])}


@pytest.mark.parametrize("union", [25, 50, 200])
def test_bands_of_short_sets(union):
    """Sets with fewer hashes than bins: similar ones meet, unlike ones seldom do."""
    rng = np.random.default_rng(8)

    def share(similarity):
        k = int(np.ceil(similarity * union))
        sets = []
        for _ in range(600):
            x = rng.integers(0, 2**63, union).astype(np.uint64)
            half = (union + k) // 2
            sets += [x[:half], np.concatenate([x[:k], x[half:]])]
        keys = minhash.bands(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), *line_dedup.BANDS)
        return (keys[0::2] == keys[1::2]).any(1).mean()

    assert share(0.8) >= 0.99 and share(0.25) <= 0.06


def test_repeated_passages(docs, none):
    rows = paragraph_dedup.repeated(docs).collect()
    text = dict(PAIRS)
    runs: dict = {}
    for i, t in PAIRS:
        w = brute.words(brute.lower(t or ""))
        for k in range(len(w) - 48):
            runs.setdefault(tuple(w[k : k + 49]), set()).add(i)
    must = {i for v in runs.values() if len(v) > 1 for i in v}
    assert must <= {r.doc_id for r in rows}
    assert {r.doc_id for r in rows} <= {4, 5, 6, 7, 8, 9, 10, 11}
    for r in rows:
        assert 0 <= r.start and r.start + r.n_words <= len(brute.words(text[r.doc_id]))
        assert r.cluster_id <= r.doc_id and (r.n_removed == 0) == (r.doc_id in (4, 8, 10)), r
    assert paragraph_dedup.repeated(none).count() == 0


def test_a_passage_twice_in_a_document(spark):
    """Both occurrences are for removal, as another document keeps the passage."""
    from conftest import prose

    passage = prose(21, 100)
    texts = [(1, prose(22, 60) + " " + passage), (2, " ".join([prose(23, 60), passage, prose(24, 60), passage, prose(25, 60)]))]
    got = paragraph_dedup.repeated(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    second = sorted((r.start, r.n_removed) for r in got if r.doc_id == 2)
    assert len(second) == 2 and 60 <= second[0][0] < 160 and 220 <= second[1][0] < 320 and min(n for _, n in second) >= 62


def test_packing_is_an_exact_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_json())
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in PAIRS}
    rows = packing.packed(docs, window=512, shard_bytes=20_000).collect()
    for i, x in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(x), i
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 512 and sum(v < 512 for v in sequences.values()) <= len({s >> 32 for s in sequences})
    assert packing.packed(none).count() == 0


def test_packing_retrieves_neighbours():
    rng = np.random.default_rng(2)
    kinds = [rng.integers(k * 100, k * 100 + 100, 30).astype("<u4") for k in (0, 1, 0, 1, 0, 1)]
    first = packing.windows_of(kinds, 90)[0]
    assert {d for d, _, _ in first} == {0, 2, 4}


def test_all_terms_of_a_seed_are_looked_up():
    """The neighbour shares the 40 of a seed's 100 terms that weigh least; 40 others share one each of those that weigh most."""
    seed = np.concatenate([np.repeat(np.arange(60), 3), np.arange(60, 100)]).astype("<u4")
    others = [np.concatenate([[k], np.arange(1000 + 40 * k, 1039 + 40 * k)]).astype("<u4") for k in range(40)]
    neighbour = np.arange(60, 100).astype("<u4")
    first = packing.windows_of([seed, *others, neighbour], len(seed) + 40)[0]
    assert first == [(0, 0, len(seed)), (41, 0, 40)]


def test_weights_are_those_of_the_corpus():
    """Term 1 is rare in the shard and common in the corpus, term 2 the other way round."""
    docs = [np.array(d, "<u4") for d in ([1, 2], [1, 8], [2, 9], [2, 10], [2, 11])]
    df = np.ones(12, np.int64)
    df[[1, 2]] = 900, 5
    best = lambda corpus: int(packing.Index(docs, corpus).scores(0)[1:].argmax()) + 1
    assert best(None) == 1 and best((1000, 2.0, df)) == 2


def test_large_cells_are_split_by_content(spark):
    """Pairs of near copies that all begin with one least hash stay together, whatever their ids are."""
    words = [f"w{k}" for k in range(4000)]
    w = packing.words_of(pa.array(words))
    h = packing.locality(w, packing.lower_hashes(w))[0]
    raw = packing.hash_spans(*(lambda w: (w.data, w.starts, w.ends))(packing.words_of(pa.array(words), lower=True)))
    least = words[int(raw.argmin())]
    assert h.shape == (4000, packing.LEVELS)
    rng = np.random.default_rng(6)
    texts = [" ".join([least, *(words[i] for i in rng.integers(0, 4000, 60))]) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + 7 * i, t + " and") for i, t in enumerate(texts)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), window=256, shard_bytes=4000).collect()
    shard = {r.doc_id: r.sequence_id >> 32 for r in got}
    assert len(set(shard.values())) >= 8
    assert sum(shard[i] == shard[1000 + 7 * i] for i in range(150)) >= 130


def test_encoder_agrees_with_the_tokenizer(monkeypatch):
    """Words known and new, places that several words share, and a table that is emptied."""
    encoder = packing.Encoder(packing.tokenizer_json())
    words = ["Hello", "the***", "it's", "É", "ﬁ", "<|endoftext|>", "a<|startoftext|>b", "12ab3", "×", "ª", "x\x01y", "İ", "ß,"]
    of = lambda x: np.array(encoder.tokenizer.encode(x, add_special_tokens=False).ids, "<u4")
    assert encoder.words(words) == [of(x).tobytes() for x in words]
    monkeypatch.setattr(packing, "PLACES", 8)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    monkeypatch.setattr(packing, "MOST_IDS", 60)
    encoder.forget()
    rng = np.random.default_rng(9)
    for _ in range(6):
        texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(5)] + [None, "", " \n"]
        w = packing.words_of(pa.array(texts))
        ids, rows = encoder.texts(w, packing.lower_hashes(w))
        for i, x in enumerate(texts):
            assert ids[rows[i] : rows[i + 1]].tolist() == of(x or "").tolist()


def test_mixing(docs, none):
    rows = [(r[0], r[1], ("other" if r[3] is None else f"domain{int(r[3][3:]) % 4}", r[2], r[3])) for r in edge_rows()]
    tokens: dict = {}
    for _, t, leaf in rows:
        tokens[leaf] = tokens.get(leaf, 0) + len(brute.words(t))
    plan = mixing.budgets(tokens, 0.5 * sum(tokens.values()), epochs=2)
    want = {(i, leaf, e, n) for i, leaf, e, n in brute.mixed(rows, plan, 2, mixing.SEED)}
    got = {(r.doc_id, (r.domain, r.lang, r.source), r.epoch, r.taken) for r in mixing.prefixes(docs, 0.5).collect()}
    assert got == want
    assert mixing.prefixes(none).count() == 0 and mixing.selected(none).columns == none.columns
    kept = mixing.selected(docs, 0.5)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()


def test_shortages_go_to_siblings_first():
    tokens = {("a", "en", "s1"): 10, ("a", "en", "s2"): 1000, ("b", "en", "s3"): 1000}
    got = mixing.budgets(tokens, 400, epochs=1)
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("b", "en", "s3"): 200}
    assert mixing.budgets({("a", "x", "p"): 50, ("b", "x", "q"): 500}, 400, epochs=1) == {("a", "x", "p"): 50, ("b", "x", "q"): 350}
    weighted = mixing.budgets(tokens, 400, lambda path: {("a",): 3.0}.get(path, 1.0), epochs=1)
    assert weighted == {("a", "en", "s1"): 10, ("a", "en", "s2"): 290, ("b", "en", "s3"): 100}


def test_factorisation_machine(docs, none, labels):
    got = by_id(quality_fm.scored(docs, labels), "held_out", "score", "predicted")
    assert set(got) == {i for i, _ in PAIRS}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, (h, s, p) in got.items())
    assert quality_fm.scored(none, labels).count() == 0
    assert by_id(quality_fm.scored(docs.select("doc_id", "text"), labels.where("false")), "score")[4] == (0.5,)
    assert quality_fm.kept(docs, labels.where("false")).columns == docs.columns


def test_machine_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    d = quality_fm.WORD_BUCKETS + 3
    m = quality_fm.Machine(0.1, rng.normal(0, 1, d), rng.normal(0, 0.3, (d, 4)), np.zeros(3), np.ones(3))
    bucket, weight, stats = np.array([5, 9, 5000]), np.array([0.3, 0.4, 0.2]), rng.normal(0, 1, (1, 3))
    index, x = np.concatenate([bucket, [d - 3, d - 2, d - 1]]), np.concatenate([weight, stats[0]])
    z = m.bias + m.weights[index] @ x + sum(m.factors[i] @ m.factors[j] * x[a] * x[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    assert np.isclose(m.score(bucket, weight, np.array([0, 3]), stats)[0], 1 / (1 + np.exp(-z)))


def test_url_rules_and_model(spark):
    urls = [None, "no scheme", "http://", "https://A.Example.ORG/es/1?x", "https://example.org/en/12", "https://example.org/en/2", "http://x.com/fr/casino", "http://x.com/de/", "http://org", "http://casino-win.example.net/en/1", "http://m.thereof.net/en/1#f", "notexample.org://example.org.net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df).collect()}
    assert [got[i][0:2] for i in range(3)] == [("", "")] * 3 and got[0][2:] == (None, "allow")
    assert got[3] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4][2:] == ("example.org/en/1", "block") and got[5][2:] == ("org/", "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2] is None
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][0] == "example.org.net"
    assert url_filter.judged(df.where("false")).count() == 0


def test_language_network(spark, docs, none):
    got = by_id(language_id.identified(docs, 30), "held_out", "lang_pred", "score")
    assert [got[i][1:] for i in range(4)] == [("und", 0.0)] * 4
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, (h, _, _) in got.items())
    assert language_id.identified(none).count() == 0


def test_language_accuracy_and_gradients():
    rng = np.random.default_rng(0)
    make = lambda letters, n: rng.choice(list(letters.encode()), n).astype(np.uint8).tobytes()
    texts = [make("abcd efgh", 200) if k % 2 else make("mnop qrst", 200) for k in range(60)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(61) * 200
    windows, count = language_id.cut(data, offsets)
    label = np.repeat(np.arange(60) % 2, 4)
    net = language_id.fit(windows, count, label, ["x", "y"], epochs=3)
    p = net.documents(pa.array([make("abcd efgh", 150).decode(), make("mnop qrst", 30).decode(), ""]))
    assert p[0, 1] > 0.8 and p[1, 0] > 0.8 and p[2].sum() == 0
    # Backpropagation through time against differences.
    d = language_id.Direction(*(rng.normal(0, 0.5, s).astype(np.float64) for s in ((12, 256), (8, 4), (4, 4))))
    steps, w = windows[:3, :6].T, rng.normal(0, 1, (6, 4, 3))
    loss = lambda: float((d.states(steps) * w).sum())
    _, kept = d.states(steps, True)
    grads = d.backward(steps, kept, w)
    for array, grad in zip((d.inputs, d.update, d.candidate), grads):
        spot = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = array[spot]
        array[spot] = old + 1e-2
        up = loss()
        array[spot] = old - 1e-2
        assert np.isclose((up - loss()) / 2e-2, grad[spot], rtol=2e-2, atol=1e-3)
        array[spot] = old


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in now.select("doc_id").collect()}
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in now.select("doc_id").collect()}
        assert after <= before
        seen.append((before, after))
    text = dict(PAIRS)
    before, after = seen[1]
    same = brute.same_texts([(i, text[i]) for i in before])
    assert after == {v[0] for v in same.values()}
    before, after = seen[2]
    assert after == {c for _, _, c in brute.ngram_components([(i, text[i]) for i in before])}
    assert seen[4][0] == seen[4][1]


@pytest.mark.parametrize("together", [0, 2])
def test_paragraphs_of_many_documents_are_dealt_out(spark, docs, monkeypatch, together):
    """Whether a key's paragraphs meet at its place or come by themselves changes nothing."""
    from conftest import prose

    passage = prose(41, 70)
    more = spark.createDataFrame([(50 + i, f"{prose(60 + i, 20 + i)} {passage} {prose(90 + i, 12)} {passage if i == 3 else ''}") for i in range(9)] + [(70, f"{passage} x {passage}")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(more)
    rows = lambda: {tuple(r) for r in paragraph_dedup.repeated(df).collect()}
    want = rows()
    assert sum(r[3] == 50 for r in want) >= 11
    monkeypatch.setattr(paragraph_dedup, "TOGETHER", together)
    assert rows() == want
    for r in want:  # a planted passage is covered whole
        if 50 <= r[0] < 59:
            assert r[2] >= 70
