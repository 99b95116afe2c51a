"""Operators that SQL cannot express, against brute force on whole small tables."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import brute
from flowtide.llm import hidden_markov, jaccard, mixing, ordinal, substrings, token_counts, toxicity
from flowtide.llm.common import stored, table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def shared_passages(spark, seed, n=60, words=7):
    """Documents over a small vocabulary, so that windows repeat within and across them."""
    random.seed(seed)
    passages = [[random.choice("abcdefg") * random.randint(1, 3) for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(random.randint(0, 5)):
            a = random.randint(0, 20)
            text += random.choice(passages)[a : a + random.randint(5, 40)] if random.random() < 0.6 else ["xy"] * random.randint(1, 60)
            text += [f"u{random.randint(0, 99)}" for _ in range(random.randint(0, words))]
        rows.append((random.choice([i, i, i, 7, None]), random.choice([" ", "\n", " \t"]).join(text)))
    return stored(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "passages")


def digests(df):
    return sorted(((r[0], *r[1:]) for r in map(tuple, df.collect())), key=repr)


@pytest.mark.parametrize(("seed", "shard", "hot"), [(1, 2048, 4096), (2, 2048, 0), (3, 1, 4096), (3, 1, 2)])
def test_substrings(spark, monkeypatch, seed, shard, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    docs = shared_passages(spark, seed)
    got = substrings.remove_repeated(docs, 20, shard=shard)
    want = brute.substring_digest(rows_of(docs))
    assert digests(got.select("doc.doc_id", "n_words", "n_removed", "kept_words_sha256")) == sorted(want, key=repr)


def test_kept_text(spark):
    docs = shared_passages(spark, 4)
    rows = rows_of(docs)
    want = [brute.cut_text(t or "", f) for (_, t), f in zip(rows, brute.removed_words(rows))]
    assert sorted(r.kept_text for r in substrings.remove_repeated(docs).collect()) == sorted(want)


def test_suffix_automaton_matching():
    random.seed(9)
    for _ in range(60):
        references = [[random.choice("abc") for _ in range(random.randint(1, 25))] for _ in range(3)]
        text = [random.choice("abcd") for _ in range(40)]
        automaton = substrings.SuffixAutomaton()
        for reference in references:
            automaton.add(reference)
        known = {tuple(r[i:j]) for r in references for i in range(len(r)) for j in range(i, len(r) + 1)}
        want = [max(k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in known) for i in range(len(text))]
        assert automaton.matching(text) == want


@needs_tables
def test_substrings_of_the_table(spark):
    docs = table(spark, SF_DIR, "documents")
    assert digests(substrings.op2_substring_dedup(spark, SF_DIR)) == sorted(brute.substring_digest(rows_of(docs)), key=repr)


@needs_tables
def test_near_duplicates_of_the_table(spark):
    want, _ = brute.near_duplicates(rows_of(table(spark, SF_DIR, "documents")))
    assert digests(jaccard.op9_jaccard_join(spark, SF_DIR)) == sorted(want, key=repr)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group beyond one block: the same links, without a row a pair."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(random.randint(0, 3)):
            words[random.randrange(120)] = f"v{random.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string"), "copies")
    want, _ = brute.near_duplicates(rows)
    got = jaccard.near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies", "n_grams")
    assert digests(got) == sorted(want, key=repr)


def chained(seed, n=90):
    """Small clusters of near copies, whose texts share half of their words with others."""
    random.seed(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        shared = random.choice([20, 25, 30])
        own = [f"c{i // 3}x{k}" for k in range(60 - shared)]
        words = base[:shared] + own
        if i % 3:
            words[30 + i % 30] = f"edit{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("docs_in_block", [2, 7, 512])
def test_chained_components_as_blocks_and_as_buckets(spark, monkeypatch, docs_in_block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", docs_in_block)
    docs = stored(spark.createDataFrame(chained(6), "doc_id long, text string"), "chained")
    got = jaccard.near_duplicates(docs)
    assert digests(got.select("doc_id", "class_id", "n_links", "n_copies", "n_grams")) == sorted(brute.near_duplicates(rows_of(docs))[0], key=repr)


def test_units_of_a_chain_are_buckets_and_of_copies_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 4)
    rows = [(h, 0, 10, [b * 100 + (h // 2 if b else h // 3) for b in range(3)]) for h in range(24)]
    rows += [(100 + h, 100, 10, [7001, 7002, 7003]) for h in range(24)]
    classes = stored(spark.createDataFrame([(h, g, b) for h, _, g, b in rows], "head long, n_grams long, bands array<long>"), "classes")
    candidates = stored(spark.createDataFrame([(h, r, g) for h, r, g, _ in rows], "node long, root long, n_grams long"), "candidates")
    units = jaccard._units(classes, candidates).collect()
    assert {r.band >= 0 for r in units if r.component == 0} == {True}
    assert {(r.band, r.blocks) for r in units if r.component == 100} == {(-1, 6)}


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_and_rows(threshold, 0.999, 400)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_forward_is_exact_and_rounds_gain():
    random.seed(2)
    texts = [np.array([random.randrange(4) if i % 2 else 4 + random.randrange(3) for _ in range(random.randint(1, 6))], np.uint16) for i in range(30)]
    p = hidden_markov.Parameters.initial(np.full(7, 1 / 7), 3)
    for text, got in zip(texts, hidden_markov.log_likelihoods(texts, p)):
        total = 0.0
        for path in np.ndindex(*[3] * len(text)):
            chance = p.start[path[0]] * p.emits[text[0], path[0]]
            for t in range(1, len(text)):
                chance *= p.moves[path[t - 1], path[t]] * p.emits[text[t], path[t]]
            total += chance
        assert got == pytest.approx(math.log10(total), abs=1e-9)
    before = hidden_markov.log_likelihoods(texts, p).sum()
    emitted, rest = np.zeros_like(p.emits), np.zeros((5, 3))
    some = sorted(texts, key=len, reverse=True)
    hidden_markov.expected_counts(some, np.ones(len(some), bool), p, emitted, rest)
    assert emitted.sum() == pytest.approx(sum(map(len, texts))) and rest[0].sum() == pytest.approx(len(texts))
    better = hidden_markov.Parameters(rest[0] / rest[0].sum(), p.carry, rest[2:] / rest[2:].sum(1, keepdims=True), emitted / emitted.sum(0))
    assert hidden_markov.log_likelihoods(texts, better).sum() > before


def test_training_over_tasks_equals_one_machine(spark):
    """Rounds over many tasks, in which most blocks of classes are not seen, against one batch."""
    rng = np.random.default_rng(4)
    classes = 3 * hidden_markov.BLOCK + 17
    texts = [rng.integers(low, low + 9, rng.integers(1, 40)).astype(np.uint16) for low in rng.integers(0, classes - 9, 60)]
    shares = np.bincount(np.concatenate(texts), minlength=classes) + 1.0
    shares /= shares.sum()
    want = hidden_markov.Parameters.initial(shares, 3)
    for _ in range(3):
        emitted, rest = np.zeros_like(want.emits), np.zeros((5, 3))
        hidden_markov.expected_counts(sorted(texts, key=len, reverse=True), np.ones(len(texts), bool), want, emitted, rest)
        blocks = {-1: np.vstack([rest, np.zeros((hidden_markov.BLOCK - 5, 3))])}
        for low in range(0, classes, hidden_markov.BLOCK):
            blocks[low // hidden_markov.BLOCK] = emitted[low : low + hidden_markov.BLOCK]
        want = hidden_markov.Parameters.estimated(blocks, shares, 3)
    hidden_markov.python_tasks(spark)
    for rows in (texts, texts[:0]):
        encoded = spark.createDataFrame([(bytearray(t.tobytes()),) for t in rows], "classes binary").repartition(12)
        got = hidden_markov.fit(encoded, shares, 3, 3)
        if not rows:
            want = hidden_markov.Parameters.estimated({}, shares, 3)
        for name in ("start", "carry", "moves", "emits"):
            np.testing.assert_allclose(getattr(got, name), getattr(want, name), rtol=1e-9)


@needs_tables
def test_language_model_of_the_table(spark):
    rows = [(d, (t or "").encode().lower().split() + [b""]) for d, t in rows_of(table(spark, SF_DIR, "documents"))]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, words in rows if not held[d] for w in words)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hidden_markov.op1_hidden_markov(spark, SF_DIR).collect()}
    for d, words in rows:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_edits_equal_counting_anew():
    enc = token_counts.encoder(token_counts.TOKENIZER)
    random.seed(5)
    pieces = ["a", "b", " ", "  ", "\n", "'s", "'", "l", "1", "22", ".", "!!", "é", "ß ", "the ", "don't ", "\t", " \n ", "😀"]
    for k in range(1500):
        text = "".join(random.choices(pieces, k=random.choice([0, 1, 3, 10, 60, 400])))
        tree = token_counts.Tree(*enc.pieces(text), leaf=random.choice([1, 2, 4, 32]))
        for _ in range(random.choice([1, 3, 8])):
            new = "".join(random.choices(pieces, k=random.choice([0, 1, 2, 9, 200 if k % 50 == 0 else 3])))
            start, length = random.randint(0, len(text) + 2), random.choice([0, 1, 2, 5, 50])
            want = text[:start] + new + text[start + length :]
            text, _ = token_counts.edit(text, tree, start, length, new, enc)
            assert text == want and tree.pieces() == enc.pieces(text)
            assert tree.total == (len(text), sum(enc.pieces(text)[1]))
        # What is stored and read again is the same tree, sums of all nodes included.
        same = token_counts.Tree.stored(*map(np.array, (*tree.arrays(), tree.chars, tree.tokens)))
        assert same.pieces() == tree.pieces() and same.n_leaves == tree.n_leaves
        ends = [0, *map(int, tree.arrays()[2])]
        sums = [sum(tree.pieces()[0][a:b]) for a, b in zip(ends, ends[1:])]
        assert sums == same.chars[same.size : same.size + len(sums)].tolist()
        assert all(same.chars[i] == same.chars[2 * i] + same.chars[2 * i + 1] for i in range(1, same.size))


def test_an_edit_reads_its_leaves_only():
    enc = token_counts.encoder(token_counts.TOKENIZER)
    text = "some words of a long text, " * 5000
    made = token_counts.Tree(*enc.pieces(text))
    tree = token_counts.Tree.stored(*map(np.array, (*made.arrays(), made.chars, made.tokens)))
    for start in (0, 60_000, len(text) - 3):
        token_counts.edit(text, tree, start, 2, "x", enc)
    assert 0 < len(tree.fresh) <= 9 < tree.n_leaves


@needs_tables
def test_edit_counts_of_the_table(spark):
    enc = token_counts.encoder(token_counts.TOKENIZER)
    docs = table(spark, SF_DIR, "documents").select("doc_id", "text")
    trees = token_counts.build_trees(docs, token_counts.sample_edits())
    for r in token_counts.apply_edits(trees).collect():
        assert r.n_tokens == len(enc.encoding.encode_ordinary(r.text))
        assert r.n_tokens_before == len(enc.encoding.encode_ordinary(r.doc.text or ""))
        assert r.n_pieces_cut <= 60


def test_decoder_restores_disguised_words(spark):
    words = "idiot stupid moron worthless pathetic clown loser scum the and of thing that ered ing"
    docs = spark.createDataFrame([(1, words)] * 20, "doc_id long, text string")
    table_of = toxicity.Words(toxicity.Decoder(toxicity.character_model(docs)), list)
    for disguised, plain in (("1d1ot", "idiot"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("cl0wn!!", "clown"), ("p@thetic", "pathetic"), ("$cum", "scum")):
        assert plain in table_of.readings(disguised.encode())
    _, values = table_of.of(b"you i d i o t and s-c-u-m now")
    assert any("idiot" in v for v in values) and any("scum" in v for v in values)
    assert table_of.readings(b"thing,***") == ["thing"]


def test_long_runs_long_words_and_any_mix_of_look_alikes_are_decoded(spark, monkeypatch):
    words = "you are an idiot stupid moron worthless pathetic clown loser scum the and of thing that ered ing boss"
    docs = spark.createDataFrame([(1, words)] * 20, "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.character_model(docs))
    table_of = toxicity.Words(decoder, list)
    for disguised, plain in ((b"1d107", "idiot"), (b"5cu" + b"m" * 100, "scum"), (b"st" + b"u" * 5000 + b"pid", "stupid"), (b"i-d-" + b"-" * 50 + b"i-o-t", "idiot"), (b"id1ot" * 20, "idiot" * 20)):
        assert plain in table_of.readings(disguised), disguised[:20]
    assert {"boss", "bos"} & set(table_of.readings(b"bo$$"))
    weights = {"idiot": 3.0, "scum": 2.0, "stup-": 2.5}
    score = toxicity.Words(
        decoder, lambda found: max((weights.get(f, 0.0) for f in toxicity.features(found)), default=0.0), inside=toxicity.known_inside(weights)
    )
    assert sum(score.of(b"y o u i d i o t")[1]) == 3
    assert sum(score.of(b"y o u  i d i o t  a n d  s c u m")[1]) == 5
    # Pieces with carried state give what one pass over the whole run gives.
    run = b" ".join(bytes([c]) for c in b"thatthingandtheidiot" * 500)
    assert sum(score.of(run)[1]) == 1500
    parted = decoder.spelled(run)
    monkeypatch.setattr(toxicity, "PIECE", 1 << 40)
    assert decoder.spelled(run) == parted and sum("idiot" in word for word in parted) == 500


def test_viterbi_against_all_paths():
    """On short words, the decoder's path is the best of all that there are."""
    random.seed(11)
    counts = np.random.default_rng(3).gamma(0.3, 1.0, (29, 29, 29)) + 1e-3
    decoder = toxicity.Decoder(np.log(counts / counts.sum(2, keepdims=True)))
    model = decoder.model

    def paths(word, at=0, state=(0, 0), cost=0.0, text=""):
        if at == len(word):
            yield cost + model[state[0]][state[1]][0], text
            return
        char, (a, b) = word[at], state
        options = decoder._options(char)
        for letter, channel in options:
            c = ord(letter) - 96
            yield from paths(word, at + 1, (b, c), cost + channel + model[a][b][c], text + letter)
        if b and (at and char == word[at - 1] or any(ord(letter) - 96 == b for letter, _ in options)):
            yield from paths(word, at + 1, state, cost + decoder.REPEAT, text)
        elif not options or not char.isalpha():
            stays = decoder.DIGIT if char.isdigit() else decoder.DROP if options else 0.0
            yield from paths(word, at + 1, state, cost + stays, text)

    for _ in range(300):
        word = "".join(random.choices("abcs01345!$*@.-", k=random.randint(1, 5)))
        assert decoder.decode(word) == max(paths(word))[1], word


def test_ordinal_gradient_and_fit(spark):
    """The gradient against finite differences, and the fit against one on a single machine."""
    random.seed(8)
    words = ["good", "fine", "bad", "junk!!", "x", "###"]
    rows = [(random.choice(words[: 2 + 2 * (2 - g)]) + " ", g) for g in (0, 1, 2) for _ in range(30)]
    texts = [(" ".join(random.choices(t.split(), k=random.randint(1, 9))), g) for t, g in rows]
    vectors = [(g, *ordinal._vector(t.encode().split(), ordinal.Buckets())) for t, g in texts]
    batch = pa.RecordBatch.from_pydict(
        {
            "grade": pa.array([g for g, _, _ in vectors], pa.int32()),
            "numbers": [n.astype(np.int32).tobytes() for _, n, _ in vectors],
            "values": [v.astype(np.float32).tobytes() for _, _, v in vectors],
        }
    )

    def parts(weights, cuts):
        (out,) = ordinal._gradient([batch], weights, cuts)
        return out.column("loss")[0].as_py(), *(np.frombuffer(out.column(c)[0].as_py()) for c in ("by_weight", "by_cut"))

    weights, cuts = np.random.default_rng(4).normal(0, 0.2, ordinal.BUCKETS), np.array([-0.4, 0.9])
    _, by_weight, by_cut = parts(weights, cuts)
    for values, gradient, places in ((weights, by_weight, [int(n[0]) for _, n, _ in vectors[::20]]), (cuts, by_cut, [0, 1])):
        for place in places:
            old, ends = values[place], []
            for shift in (1e-5, -1e-5):
                values[place] = old + shift
                ends.append(parts(weights, cuts)[0])
            values[place] = old
            assert gradient[place] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-4)

    df = stored(spark.createDataFrame(batch.to_pandas()).repartition(3), "vectors")
    shares = np.array([1, 1, 1]) / 3
    model = ordinal.fit(df, shares, rounds=15)
    # The same steps over all rows at once.
    theta = np.concatenate([np.zeros(ordinal.BUCKETS), [-np.log(2)], [np.log(2 * np.log(2))]])
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 16):
        w, c = theta[: ordinal.BUCKETS], ordinal._cuts(theta[ordinal.BUCKETS :])
        _, dw, dc = parts(w, c)
        g = np.concatenate([dw / 90 + ordinal.RIDGE * w, [dc.sum() / 90], [dc[1] / 90 * np.exp(theta[-1])]])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g**2
        theta = theta - ordinal.STEP * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(model.weights, theta[: ordinal.BUCKETS], atol=1e-6) and np.allclose(model.cuts, ordinal._cuts(theta[ordinal.BUCKETS :]), atol=1e-6)


def test_mix_takes_documents_at_their_chances(spark):
    """Unequal chances of a fixed size: classes are included as often as expected, the words meet the target."""
    random.seed(12)
    rows = [(i, " ".join(["w"] * random.choice([2, 6, 30, 200])), "abc"[i % 3]) for i in range(9000)] + [(None, None, "a"), (9001, "", None)]
    mix = mixing.mix_sources(stored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "mix-in")).collect()
    assert len(mix) == len(rows)
    chances = set()
    for source in "abc":
        own = [r for r in mix if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 100
        for size in (2, 6, 30, 200):
            some = [r for r in own if r.size == size]
            expected = some[0].expected
            chances.add((source, expected))
            assert {r.expected for r in some} == {expected} and expected <= 2
            assert all(r.copies in (int(expected), int(expected) + (expected < 2)) for r in some)
            # Within five standard deviations of a binomial count.
            chance = expected - int(expected)
            assert abs(sum(r.copies for r in some) / len(some) - expected) <= 5 * math.sqrt(chance * (1 - chance) / len(some)) + 0.02
    assert len(chances) >= 8


@pytest.fixture(scope="module")
def larger():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


def test_toxicity_on_held_out_labels(spark, larger):
    got = {r.doc_id: r for r in toxicity.op7_toxicity(spark, larger).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    unseen = [(got[d], y) for d, y in labels.items() if got[d].held_out]
    hits = [y for r, y in unseen if r.predicted]
    assert sum(hits) / len(hits) > 0.8 and sum(hits) / sum(y for _, y in unseen) > 0.5


def test_quality_on_held_out_ratings(spark, larger):
    docs = table(spark, larger, "documents").select("doc_id", "text")
    ratings = ordinal.ratings_of(table(spark, larger, "labels"))
    model = ordinal.train(docs, ratings.where("crc32(cast(doc_id as string)) % 3 <> 1"), 3)
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc.doc_id: r for r in ordinal.grade(docs, model).collect()}
    unseen = [(got[r.doc_id], r.grade) for r in ratings.where("crc32(cast(doc_id as string)) % 3 = 1").collect()]
    right = [(r.p_ge_1 >= 0.5) == (g >= 1) for r, g in unseen]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.p_ge_2 <= r.p_ge_1 <= 1 and abs(r.expected_grade - r.p_ge_1 - r.p_ge_2) < 1e-12 for r in got.values())
