"""Packing, token counts, fingerprints, embeddings, scores and classifiers against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, documents, normal, odd_rows
from pyspark.sql import functions as F

from gneiss.llm import embeddings, fingerprints, mixing, packing, scoring, subword, tokens, toxicity, trie
from gneiss.llm.text import range_hashes, slices

public_tokenizers = pytest.importorskip("public_tokenizers")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- best-fit packing


def test_packing_is_exact(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = odd_rows() + [(950, "Hi, there. A.B, c.. don't x1, É. <|endoftext|> <|STARTOFTEXT|>"), (951, "x , . y")]
    got = packing.pack(documents(spark, rows), path, capacity=64).toPandas()
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    for i, ids in want.items():
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids)
        assert list(mine.start) == [64 * k for k in range(len(mine))] and list(mine.piece) == list(range(len(mine)))
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, one in got.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.length.sum() <= 64 and list(one.offset) == [0, *one.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= 1.05 * math.ceil(got.length.sum() / 64)


def test_packing_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack(documents(spark, []), path).count() == 0
    got = packing.pack(documents(spark, [(1, None), (1, None), (None, "a")]), path, capacity=8).toPandas()
    assert len(got) == 3 and got.sequence_id.nunique() == 1 and sorted(got.offset) == [0, 2, 3]


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_place_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 400) for _ in range(40)}
    room, taken = {}, {}
    for length, a, b, each, seq, at in packing.best_fit_sweeps(counts, 100):
        for rank in range(a, b + 1):
            assert (length, rank) not in taken
            s, o = seq + (rank - a) // each, at + (rank - a) % each * length
            taken[length, rank] = s
            assert room.get(s, 0) == o  # gapless, in order
            room[s] = o + length
    assert len(taken) == sum(counts.values()) and max(room.values()) <= 100
    assert len(room) <= math.ceil(sum(k * v for k, v in counts.items()) / 100 * 11 / 9) + 1


def plain_best_fit(lengths, capacity):
    """Sequences that best fit, longest first, one document at a time, opens."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sweeps_open_no_more_sequences_than_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(1 / 18)) + 1) for _ in range(1500)]
    sweeps = packing.best_fit_sweeps(dict(Counter(lengths)), 64)
    opened = {seq + k for _, a, b, each, seq, _ in sweeps for k in range((b - a) // each + 1)}
    assert len(opened) == plain_best_fit(lengths, 64)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


# --- token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rows = odd_rows() + [(960, "a\n\n\n\nb  \n\n c\n"), (961, "\n\n"), (962, "naïve\n<|endoftext|>\nπ\n\n\n\n\n"), (963, "日本\n語ü\r\n\u00a0\n😀😀\n\n ю")]
    got = tokens.section_token_counts(documents(spark, rows), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).toPandas()
    for i, text in rows:
        text = text or ""
        mine = got[got.id == i].sort_values("section")
        cuts = [*mine.start, len(text)]
        assert "".join(text[a : a + n] for a, n in zip(mine.start, mine.length)) == text
        encoded = whole.encode(text, add_special_tokens=False)
        assert mine.n_tokens.sum() == len(encoded.ids)
        # A byte-level vocabulary writes each byte as one character, so a token's length is its bytes.
        edges = np.cumsum([0, *(len(whole.id_to_token(t)) for t in encoded.ids)]).tolist()
        assert edges[-1] == len(text.encode())
        marks = [len(text[:c].encode()) for c in cuts]
        want = Counter()
        for a, b in zip(edges[:-1], edges[1:]):
            want[max(range(len(mine)), key=lambda s: (min(b, marks[s + 1]) - max(a, marks[s]), -s))] += 1
        assert [want[s] for s in mine.section] == list(mine.n_tokens)
    assert got.n_crossing.sum() > 0


def test_attribution_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert tokens.attribute(starts, ends, bounds, "first").tolist() == [0, 0, 1]
    assert tokens.attribute(starts, ends, bounds, "last").tolist() == [0, 1, 1]
    assert tokens.attribute(starts, ends, bounds, "most").tolist() == [0, 1, 1]
    assert tokens.attribute(np.array([2]), np.array([4]), bounds, "most").tolist() == [0]


def test_token_counts_edges(spark):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert tokens.section_token_counts(documents(spark, []), *args).count() == 0
    with pytest.raises(ValueError):
        tokens.section_token_counts(documents(spark, []), *args, rule="none")


# --- fingerprints


def test_edited_texts_and_likeness(spark):
    rows = sorted(odd_rows(), reverse=True)
    got = {r.id: r for r in fingerprints.edited_fingerprints(documents(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(rows)]
        m = len(text) // 3
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - m] + following[:m]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = {}
    for (i, _), text in zip(rows, texts):
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
    long = [i for (i, _), t in zip(rows, texts) if 300 < len(t) and len(set(t.split())) > 20]
    assert np.mean([got[i].near_edited for i in long]) > 0.5
    assert got[901].fingerprint == "" and got[900].fingerprint == ""


def test_syncmers_are_context_free_and_match_definition():
    text = "the quick brown fox jumps over the lazy dog again and again"
    part = next(slices(pa.array([text, "x" + text, "tiny"])))
    row, pos, h = fingerprints.syncmers(part)
    first, second = set(zip(pos[row == 0], h[row == 0])), set(zip(pos[row == 1] - 1, h[row == 1]))
    assert first <= second and len(first) > 5
    assert not (row == 2).any() and len(fingerprints.fingerprints(part)[2][0]) == 1


def test_closed_syncmers_equal_the_definition():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["ü" * 40, "aaaaaaaaaaaaaaaaaaaaaaa", "short"]
    part = next(slices(pa.array(texts)))
    row, pos, h = fingerprints.syncmers(part)
    k, s = fingerprints.K, fingerprints.S

    def smer(x):
        return fingerprints._smer_hashes(np.frombuffer(x, np.uint8))[0]

    for i, text in enumerate(texts):
        raw = text.encode()
        want = []
        for p in range(len(raw) - k + 1):
            inner = [smer(raw[p + j : p + j + s]) for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                want.append(p)
        assert pos[row == i].tolist() == want
        kmers = {}
        for p, x in zip(pos[row == i].tolist(), h[row == i].tolist()):
            assert kmers.setdefault(raw[p : p + k], x) == x
        # The fingerprint is the smallest distinct hashes with their first places.
        first = {}
        for p, x in zip(pos[row == i].tolist(), h[row == i].tolist()):
            first.setdefault(x, p)
        smallest = sorted(first.items())[: fingerprints.ANCHORS]
        mine = fingerprints.fingerprints(part)[i]
        if smallest:
            assert list(zip(*(a.tolist() for a in mine))) == [(x >> 32, p) for x, p in smallest]


def test_likeness_equals_plain_count_and_survives_inserted_passages():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(400))
    moved = text[: len(text) // 2] + " ".join(rng.choice(words) for _ in range(150)) + text[len(text) // 2 :]
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(400))
    a, b, c = fingerprints.fingerprints(next(slices(pa.array([text, moved, other]))))

    def plain(x, y):
        one, two = dict(zip(*(v.tolist() for v in x))), dict(zip(*(v.tolist() for v in y)))
        union = sorted(set(one) | set(two))[: fingerprints.ANCHORS]
        shifts = [two[h] - one[h] for h in union if h in one and h in two]
        agreed = sum(sum(abs(s - t) <= fingerprints.DRIFT for t in shifts) >= min(fingerprints.AGREE, len(shifts)) for s in shifts)
        j = agreed / len(union)
        return 2 * j / (1 + j)

    for x, y in ((a, b), (b, a), (a, c), (a, a)):
        assert abs(fingerprints.likeness(x, y) - plain(x, y)) < 1e-12
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, b) > 0.6 and fingerprints.likeness(a, c) == 0


def test_fingerprint_edges(spark):
    assert fingerprints.edited_fingerprints(documents(spark, [])).count() == 0
    one = fingerprints.edited_fingerprints(documents(spark, [(5, "abc"), (None, "q")])).collect()
    assert [(r.id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"aba").hexdigest())]


# --- embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, "x") for i, v, l in rows], "vec_id long, embedding array<float>, label int, id int, n string")


def brute_links(rows, threshold):
    good = {}
    for k, (i, v, l) in enumerate(rows):
        if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[k] = (i, np.array(v, np.float32).astype(float), l)
    return [(a, b) for a in good for b in good if a != b and good[a][2] == good[b][2] and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= threshold]


@pytest.mark.parametrize("tile", [7, 512])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        center = rng.normal(size=24) if i % 4 == 0 or not rows else np.array(rows[rng.integers(len(rows))][1])
        rows.append((i, [float(np.float32(x)) for x in center + rng.normal(size=24) * 0.2], int(i % 3)))
    rows += [(200 + k, rows[0][1], 0) for k in range(20)] + [(230, [2 * x for x in rows[0][1]], 0)]
    rows += [(300, None, 0), (301, [0.0] * 24, 0), (302, [float("nan")] * 24, 0), (303, [None] * 24, 0), (304, rows[0][1], None), (305, [float("inf")] * 24, 1)]
    links = brute_links(rows, 0.9)
    degree = Counter(rows[a][0] for a, _ in links)
    root = {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(rows[a][0]), find(rows[b][0])
        root[max(a, b)] = min(a, b)
    got = {r.id: r for r in embeddings.embedding_near_duplicates(vectors(spark, rows), 0.9).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: degree[i] for i in got} and len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in got}


def test_embedding_lengths_are_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "AXES", 2, raising=False)
    rng = np.random.default_rng(4)
    rows = [(0, [float("nan")], 0), (1, [1.0, 2.0, 3.0], 0)]
    for size in (24, 7, 40):
        for i in range(30):
            base = rng.normal(size=size) if i % 3 == 0 else np.array(rows[-1][1])
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=size) * 0.05], i % 2))
    rows += [(len(rows), [2.0, 4.0, 6.0], 0), (len(rows) + 1, [5.0], 0), (len(rows) + 2, [7.0], 0)]
    degree = Counter()
    for size in {len(r[1]) for r in rows}:
        same = [r for r in rows if len(r[1]) == size]
        degree.update(same[a][0] for a, _ in brute_links(same, 0.9))
    got = {r.id: r.n_links for r in embeddings.embedding_near_duplicates(vectors(spark, rows), 0.9).collect()}
    assert got == {i: degree[i] for i, _, _ in rows} and all(any(degree[r[0]] for r in rows if len(r[1]) == size) for size in (1, 3, 7, 24, 40))


def test_pairs_at_the_threshold_are_linked(spark):
    # cos((3, 4), (4, 3)) is 24 / 25; whatever axes are turned to, each pair at exactly 0.96 is linked and (3, 4) with (3.999, 2.999) too.
    rng = np.random.default_rng(5)
    rows = []
    for label in range(60):
        at = rng.permutation(16)[:2]
        for k, xy in enumerate([(3.0, 4.0), (4.0, 3.0), (4.0, 2.99)]):
            v = np.zeros(16)
            v[at] = np.array(xy) * 2.0 ** rng.integers(-3, 4)
            rows.append((3 * label + k, v.tolist(), label))
    got = {r.id: r.n_links for r in embeddings.embedding_near_duplicates(vectors(spark, rows), 0.96).collect()}
    assert [got[3 * label] for label in range(60)] == [1] * 60
    assert [got[3 * label + 1] for label in range(60)] == [2] * 60


def test_embedding_edges(spark):
    assert embeddings.embedding_near_duplicates(vectors(spark, [])).count() == 0
    got = embeddings.embedding_near_duplicates(vectors(spark, [(1, None, 1), (None, [1.0], 1)])).collect()
    assert [(r.id, r.n_links, r.component_id, r.kept) for r in got] == [(1, 0, 1, True)]


# --- language model


def brute_scores(rows, learnt):
    lines = [(i, [*WORD.findall(lower(t)), "<end>"]) for i, t in rows]
    count, pair, triple = Counter(), Counter(), Counter()
    for i, x in lines:
        if learnt(i):
            count.update([*x, "<start>"])
            for u, v, w in zip(["<start>", "<start>", *x], ["<start>", *x], x):
                pair[v, w] += 1
                triple[u, v, w] += 1
    texts = count.pop("<start>", 0)
    n, total = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    follows = {**count, "<start>": texts}
    out = {}
    for i, x in lines:
        score = 0.0
        for u, v, w in zip(["<start>", "<start>", *x], ["<start>", *x], x):
            p = (count[w] + 0.5) / total
            context = texts if v == "<start>" else pair[u, v]
            up = triple[u, v, w] + scoring.PAIR * pair[v, w] + scoring.BASE * p
            score += math.log10(up / (context + scoring.PAIR * follows.get(v, 0) + scoring.BASE))
        base = sum(math.log10((count[w] + 0.5) / total) for w in x)
        out[i] = (len(x), sum(count[w] > 0 for w in x), n, base, score)
    return out


@pytest.mark.parametrize("hot", [1, 20, 1000])
@pytest.mark.parametrize("frequent", [2, 9, 1 << 16])
def test_scores_equal_brute_force(spark, monkeypatch, hot, frequent):
    monkeypatch.setattr(scoring, "LEAST_HOT", hot)
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    rows = odd_rows()  # one text repeats a word 3,000 times: a hot word, pair and triple
    want = brute_scores(rows, lambda i: i % 5 != 1)
    got = {r.id: r for r in scoring.language_model_scores(documents(spark, rows), "id % 5 <> 1").collect()}
    assert set(got) == set(want)
    for i, (tokens_, known, n, base, score) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learnt) == (tokens_, known, n, i % 5 != 1)
        assert abs(r.base_score - base) < 1e-6 * max(1, tokens_)
        assert abs(r.score - score) < tokens_ * 2 * trie.NgramTrie.STEP


def test_every_word_has_ngrams_of_its_own(spark):
    # More distinct words than the table of frequent ones holds, nearly all met once.
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(10_000))) for i in range(30)] + [(100, "rara avis"), (101, "rara avis"), (102, "rara avis")]
    want = brute_scores(rows, lambda i: i != 101)
    got = {r.id: r.score for r in scoring.language_model_scores(documents(spark, rows), "id <> 101").collect()}
    for i in (101, 100, 3):
        assert abs(got[i] - want[i][4]) < want[i][0] * 2 * trie.NgramTrie.STEP


def test_score_edges(spark):
    assert scoring.language_model_scores(documents(spark, []), "id % 5 <> 1").count() == 0
    got = scoring.language_model_scores(documents(spark, [(1, "a b"), (6, None), (None, "c")]), "id % 5 <> 1").collect()
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(1, 3, 0, 0), (6, 1, 0, 0)]


def test_elias_fano_finds_successors():
    rng = np.random.default_rng(1)
    for top, n in ((50, 200), (10**6, 70_000), (10**13, 1000)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = trie.EliasFano(values, trie.Mapped())
        assert (np.concatenate([ef.block(i) for i in range(len(ef.bits))]) == values).all()
        queries = np.sort(np.concatenate([values[::3], rng.integers(0, top + 5, 500).astype(np.uint64)]))
        at, hit = ef.successor(queries)
        assert (at == np.searchsorted(values, queries)).all()
        assert (hit == np.isin(queries, values)).all()
    at, hit = trie.EliasFano(np.zeros(0, np.uint64), trie.Mapped()).successor(np.array([1, 2], np.uint64))
    assert at.tolist() == [0, 0] and not hit.any()


# --- classifiers and mixing


def labelled(spark, n=400, seed=2):
    """Texts of neutral words; toxic ones hold words with a common stem, some forms only ever held out."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "mip", "dol", "sit", "ame") for b in ("an", "um", "es", "iv", "o")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        if toxic:
            held = zlib.crc32(str(i).encode()) % 4 == 2
            for _ in range(3):
                text.insert(rng.randrange(len(text)), "grumbl" + (rng.choice(["ing", "est"]) if held else rng.choice(["e", "er", "ed", "y"])))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), int(i % 2)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_knows_unseen_forms(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows + [(1000, None), (1001, "")])
    model = toxicity.train_toxicity(docs, labels.filter(toxicity.learns_from()))
    scored = toxicity.with_toxicity(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"]
    got = {r.doc_id: r.score for r in scored.collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95
    assert len(got) == len(rows) + 2 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]


def plain_grams(word, buckets):
    """Buckets of a word: itself between its marks, and every run of 3 to 6 of those characters."""
    marks = np.array([300, *word.encode(), 301], np.uint16)
    spans = [(0, len(marks))] + [(i, i + n) for n in range(3, 7) for i in range(len(marks) - n + 1)]
    h = range_hashes(marks, np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    return [int(x) & (buckets - 1) for x in h]


def plain_probability(model, text):
    """The class probabilities of a text by the definition, word by word and window by window."""
    words = WORD.findall(lower(text))
    means = [np.mean([model.scores[g] for g in plain_grams(w, len(model.scores))], 0, dtype=float) for w in words]
    z = np.array(model.bias, float)
    if words:
        width = model.window if model.pool == "max" else len(words)
        windows = [np.mean(means[i : i + width], 0) for i in range(0, len(means), width)]
        z = z + (np.array([0.0, max(w[1] - w[0] for w in windows)]) if model.pool == "max" else windows[0])
    e = np.exp(z - z.max())
    return e / e.sum()


@pytest.mark.parametrize("pool", ["max", "mean"])
def test_scores_equal_their_definition(pool):
    rng = np.random.default_rng(2)
    model = subword.Model(rng.normal(size=(1 << 10, 2)).astype(np.float32), np.array([0.1, -0.7]), 3, pool)
    texts = ["", " ", "One two THREE four five", "naïve café", "a", "x " * 500 + "last", "same same same"]
    got = model.probabilities(next(slices(pa.array(texts))))
    assert np.allclose(got, [plain_probability(model, t) for t in texts], atol=1e-6)


def plain_training(texts, labels, pool, buckets, size, window, epochs, batch, rate, seed):
    """The same descent written gram by gram, with the gradients by the chain rule of the loss below."""
    rng = np.random.default_rng(seed)
    E, W = rng.normal(0, 1 / size, (buckets, size)).astype(np.float32).astype(float), rng.normal(0, 1 / np.sqrt(size), (size, 2)).astype(np.float32).astype(float)
    bias = np.array([0.0, np.log(0.1 / 0.9)]) if pool == "max" else np.zeros(2)
    gE, gW, gb = np.full(buckets, 1e-6), np.full_like(W, 1e-6), np.full(2, 1e-6)
    steps, done = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = [i for i in order[at : at + batch] if WORD.findall(texts[i])]
            if not pick:
                continue
            dE, dW, db = np.zeros_like(E), np.zeros_like(W), np.zeros(2)
            met = set()
            present = Counter(labels[i] for i in pick)
            for i in pick:
                words = WORD.findall(lower(texts[i]))
                width = window if pool == "max" else len(words)
                spans = [words[k : k + width] for k in range(0, len(words), width)]
                grams = [[plain_grams(w, buckets) for w in span] for span in spans]
                x = np.array([np.mean([np.mean(E[g], 0) for g in span], 0) * 20.0 for span in grams])
                z = x @ W
                if pool == "max":
                    m = z[:, 1] - z[:, 0]
                    share = np.exp(2 * (m - m.max()))
                    logit = np.array([0.0, m.max() + np.log(share.sum()) / 2]) + bias
                    share /= share.sum()
                else:
                    logit = z[0] + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                g = p - np.eye(2)[labels[i]]
                g *= (len(pick) / (len(present) * present[labels[i]]) if pool == "mean" else 1.0) / len(pick)
                db += g
                for k, span in enumerate(grams):
                    gz = np.array([-g[1], g[1]]) * share[k] if pool == "max" else g
                    dW += np.outer(x[k], gz)
                    for word in span:
                        for b in word:
                            dE[b] += W @ gz * 20.0 / len(span) / len(word)
                            met.add(b)
            now = rate * (1 - 0.9 * done / steps)
            ids = sorted(met)
            gE[ids] += (dE[ids] ** 2).mean(1)
            E[ids] -= now * dE[ids] / np.sqrt(gE[ids])[:, None]
            gW += dW**2
            W -= now * dW / np.sqrt(gW)
            if pool == "mean":
                gb += db**2
                bias -= now * db / np.sqrt(gb)
            done += 1
    E[gE <= 1e-6] = 0
    return E @ W * 20.0, bias


@pytest.mark.parametrize("pool", ["max", "mean"])
def test_training_equals_a_plain_descent(pool):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "bad", "fine", "worse", "ugly"]) for _ in range(rng.randint(1, 9))) for _ in range(24)] + ["", "good"]
    labels = np.array([int("ugly" in t) for t in texts])
    args = dict(buckets=1 << 9, size=3, window=3, epochs=2, batch=8, rate=0.1, seed=5)
    model = subword.train(texts, labels, 2, pool=pool, **args)
    scores, bias = plain_training(texts, labels, pool, **args)
    assert np.abs(model.scores - scores).max() < 2e-3 * max(1, np.abs(scores).max()) and np.abs(model.bias - bias).max() < 1e-3


def test_toxicity_on_odd_rows(spark):
    # Very long, repeated, tied and empty rows, and a null id: every row keeps its place and equal texts equal scores.
    rows = odd_rows() + [(5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (990, "grumble " * 200_000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40)] + [(5, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    got = toxicity.with_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert 0 <= r.score <= 1 and abs(by_text.setdefault(lower(r.text), r.score) - r.score) < 1e-9


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "a b")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.with_toxicity(docs, toxicity.train_toxicity(docs, none)).collect()] == [0.5]
    assert toxicity.with_toxicity(documents(spark, []), toxicity.train_toxicity(docs, none)).count() == 0


def test_max_pool_takes_the_worst_window():
    model = subword.Model(np.zeros((1 << 10, 2), np.float32), np.zeros(2), 3, "max")
    part = next(slices(pa.array(["aaa bbb ccc ddd"])))
    b = subword.bag(part, 1 << 10)
    model.scores[b.grams[b.word == b.token[3]], 1] = 8.0
    alone = model.logits(next(slices(pa.array(["ddd"]))))[0, 1]
    assert abs(model.logits(part)[0, 1] - alone) < 0.5


def test_mixing_meets_targets(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 4 else ["bad", "poor", "junk"]) for _ in range(rng.randint(5, 60)))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 300, 3)], "doc_id long, quality int")
    docs = documents(spark, rows + [(999, None)])
    members, model, steps = mixing.mix_to_targets(docs, labels, "quality", [0.1, 0.9])
    m = members.toPandas()
    assert len(m) == 301 and (m.rate >= 0).all()
    p = np.stack(m.posterior.values)
    total = (m.tokens * m.rate).values @ p / m.tokens.sum()
    assert np.abs(total - [0.1, 0.9]).max() < 1e-3
    out = mixing.mixed(docs, model, steps)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(copies[i] == n for i, n in zip(m.id, m.copies))
    assert (m.copies[(m.id % 4 != 0) & (m.id < 300)] >= 1).all()
    with pytest.raises(ValueError):
        mixing.fit_rates(members, [0.0, 0.0])


def test_mixing_equals_a_plain_descent(spark):
    rows, labels = labelled(spark, 120)
    rows = rows + [(5, rows[5][1]), (700, "mip " * 150_000), (701, None)]
    members, model, steps = mixing.mix_to_targets(documents(spark, rows), labels, "toxic", [0.7, 0.3])
    m = members.toPandas()
    assert len(m) == len(rows)
    texts = dict(rows)
    for r in m.itertuples():
        assert r.tokens == len(WORD.findall(texts[r.id] or ""))
        if r.id != 700:
            assert np.allclose(r.posterior, plain_probability(model, texts[r.id]), atol=1e-6)
    # Projected gradient on the squared relative misses, and a pull towards 1, on the whole table at once.
    p, t = np.stack(m.posterior.values), m.tokens.values.astype(float)
    target, rate = np.array([0.7, 0.3]), np.ones(len(m))
    share = np.maximum(t @ p / t.sum(), 1e-6)
    for _ in range(len(steps)):
        now = (t * rate) @ p / t.sum()
        assert np.abs(now - target).max() >= 1e-4
        rate = np.maximum(0, rate - p @ (mixing.STEP * (now - target) / share) - mixing.STEP * mixing.PULL * (rate - 1))
    # One text holds nearly all words here: the rounds may end before the targets are met, and say so.
    assert np.allclose(rate, m.rate.values, atol=1e-9) and (np.abs((t * rate) @ p / t.sum() - target).max() < 1e-4 or len(steps) == 60)
    assert ((m.copies == np.floor(m.rate)) | (m.copies == np.floor(m.rate) + 1)).all()


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    members, _, steps = mixing.mix_to_targets(documents(spark, [(1, None), (None, "a b")]), none, "quality", [0.5, 0.5])
    assert sorted((r.tokens, round(sum(r.posterior), 9)) for r in members.collect()) == [(0, 1.0), (2, 1.0)]
    members, _, steps = mixing.mix_to_targets(documents(spark, []), none, "quality", [0.5, 0.5])
    assert members.count() == 0 and steps == []
