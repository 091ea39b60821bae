import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import language_id, lm_scoring, quality_rules, sharding
from hirelake.llm.queries import op4_language_id, op5_quality_cascade, op10_stupid_backoff
from hirelake.llm.tokens import public_vocabulary
from tests.llm import brute
from tests.llm.conftest import SF

PATH = public_vocabulary("byte_bpe_50k.json")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_quality_of_the_whole_table(spark, documents):
    rows = {r["doc_id"]: tuple(r[m] for m in MEASURES) for r in op5_quality_cascade(spark, SF).collect()}
    assert rows == {d: brute.quality(t) for d, t in documents}


def test_good_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = op5_quality_cascade(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("n_words >= 20")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0
    assert counts[0, False] > 0.9 * (counts[0, False] + counts.get((0, True), 0))


def odd_texts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a " * 7, "a " * 8, "a " * 9, "x\n" * 40, "A!! B!! " * 20, "é\x0bü\x0cß \r\n" * 10, "# | $ " * 9]
    for n in (3, 30):
        texts += [" ".join(rng.choice("abcdef"[:n] if n < 9 else [f"w{i}" for i in range(n)]) for _ in range(rng.randint(15, 400))) for _ in range(20)]
    return list(enumerate([*texts, "word " * 20000, " ".join(f"w{i}" for i in range(20000))]))


def test_quality_edge_cases(make_docs):
    docs = odd_texts()
    frame = make_docs(docs + docs[:3])
    rows = quality_rules.judge(frame).collect()
    assert len(rows) == len(docs) + 3
    assert {r["doc_id"]: tuple(r[m] for m in MEASURES) for r in rows} == {d: brute.quality(t) for d, t in docs}
    kept = quality_rules.keep_good(frame)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in docs if brute.quality(t)[-1]}
    assert quality_rules.judge(make_docs([])).count() == quality_rules.keep_good(make_docs([])).count() == 0


def test_any_order_of_rules_keeps_the_same(make_docs):
    frame = make_docs(odd_texts())
    measure = quality_rules.of_text(F.col("text"))
    rules = quality_rules.base_rules(measure) | quality_rules.further_rules(measure)
    wanted = None
    for order in (list(rules), list(rules)[::-1]):
        kept = {r[0] for r in frame.filter(quality_rules.first_failed(rules, order).isNull()).select("doc_id").collect()}
        wanted = kept if wanted is None else wanted
        assert kept == wanted
    assert sorted(quality_rules.best_order(quality_rules.sample_of(frame), rules, 1)) == sorted(rules)


def test_shards_follow_weights_and_growth(spark):
    keys = spark.range(20000).withColumnsRenamed({"id": "doc_id"}).withColumn("text", F.lit("a"))
    placed = sharding.place(keys, [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0]).collect()
    share = Counter(r["shard"] for r in placed)
    assert abs(share[1] / 20000 - 0.5) < 0.02 and abs(share[0] / 20000 - 0.25) < 0.02
    moved = [r for r in placed if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {3} and abs(len(moved) / 20000 - 0.2) < 0.02


def test_repeated_rows_and_long_texts_take_a_slot_each(make_docs):
    long = "é " * 700_000
    docs = [(7, long)] * 2 + [(7, "a")] * 600 + [(i, None) for i in range(300)]
    rows = sharding.with_slots(sharding.place(make_docs(docs).repartition(6), [1.0] * 3, [1.0] * 4)).collect()
    assert len(rows) == len(docs) and sorted(r["size"] for r in rows)[-2:] == [2_100_001] * 2
    for shard in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1


def test_slots_are_gapless(make_docs):
    docs = [(None, None), (None, "é"), (1, "a"), (1, "a"), *((i, "x" * i) for i in range(2, 60))]
    frame = make_docs(docs).repartition(5)
    rows = sharding.with_slots(sharding.place(frame, [1.0] * 4, [1.0] * 5)).collect()
    assert len(rows) == len(docs) and {r["size"] for r in rows if r["doc_id"] is None} == {1, 3}
    for shard in range(4):
        own = sorted((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1) for r in rows if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert sharding.with_slots(sharding.place(make_docs([]), [1.0], [1.0, 1.0])).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [1.0, 0.0])


def test_language_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op4_language_id(spark, folder).join(truth, "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows if r["lang_pred"] != "und")
    assert len(rows) > 200 and right >= 0.98 * len(rows)


def test_every_label_and_score_of_the_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    expected = brute.language([tuple(r) for r in table.collect()], language_id.SWITCH_PENALTY)
    rows = op4_language_id(spark, SF).collect()
    assert len(rows) == len(expected)
    for r in rows:
        label, share = expected[r["doc_id"]]
        assert r["lang_pred"] == label and math.isclose(r["score"], share, abs_tol=1e-12), r["doc_id"]


def test_a_hundred_labels_and_long_texts_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(6)
    names = [f"l{i:03}" for i in range(100)]
    vocabulary = {x: ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(40)] for x in names}
    counts = {x: Counter(g for w in vocabulary[x] for g in language_id.grams(w)) for x in names}
    model = language_id.Model(counts, {x: {"latin": 200} for x in names})
    scores = language_id._WordScores(model)
    texts = [[f"{w}{i}".replace("0", "z") for w in vocabulary[x]] for i in range(2) for x in names]
    monkeypatch.setattr(scores, "_most", 500)
    for own in texts:
        words = scores.rows_of([[w.rstrip("1") for w in own]])
        assert len(scores.table) <= 1024 and np.array_equal(scores.table[words[0]], model.word(own[0].rstrip("1")))
    assert language_id.SCORE_BYTES // (8 * 100) * 100 * 8 <= 64_000_000
    groups = list(language_id._grouped(["a" * 3_000_000, None, "b" * 2_000_000, "c" * 9_000_000, ""]))
    assert groups == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_equal_scores_go_to_the_first_label_and_repeated_rows_agree(spark, make_docs):
    rows = [(4 * i, "same words here", lang) for i in range(20) for lang in ("xx", "aa")]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    docs = [(1, "same words"), (1, "same words"), (2, "words " * 300_000)]
    found = language_id.label(make_docs(docs), model).collect()
    assert [r["lang_pred"] for r in found] == ["aa"] * 3 and {r["score"] for r in found} == {1.0}


def test_viterbi_against_every_path():
    rng = np.random.default_rng(1)
    from itertools import product

    lengths = np.array([4, 0, 1, 5, 3])
    scores = rng.normal(size=(int(lengths.sum()), 3)) * 3
    path, at = language_id.viterbi(scores, lengths, 2.0), 0
    for n in lengths.tolist():
        own = scores[at : at + n]
        value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in product(range(3), repeat=n)) if n else 0
        assert math.isclose(value(path[at : at + n]), best)
        at += n


def test_spans_of_mixed_text(spark, make_docs):
    rows = []
    for i in range(30):
        rows += [(4 * i, "the quick brown fox jumps over the lazy dog and then sleeps", "en"), (4 * i + 1, "быстрая лиса прыгает через ленивую собаку", "ru")]
        rows += [(4 * i + 3, "der schnelle fuchs springt über den faulen hund und schläft", "de"), (None, "x", "en"), (4 * i, "y", None)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(learned, F.lit(True))
    assert model.languages == ["de", "en", "ru"]
    docs = [(1, "the lazy dog jumps and then der faule hund springt über den fuchs"), (2, "лиса и собака"), (3, None), (4, " 12 ?! "), (None, "the dog"), (6, "日本")]
    out = {r["doc_id"]: r for r in language_id.label(make_docs(docs), model).collect()}
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "de"] and out[1]["lang_pred"] == "de" and 0.5 < out[1]["score"] < 0.7
    assert out[2]["lang_pred"] == "ru" and out[2]["score"] == 1.0 and out[None]["lang_pred"] == "en"
    assert out[3]["lang_pred"] == out[4]["lang_pred"] == "und" and out[3]["score"] == 0.0 and out[6]["lang_pred"] in model.languages
    nothing = language_id.learn(learned.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.label(make_docs(docs), nothing).collect()} == {"und"}
    assert language_id.label(make_docs([]), model).count() == 0


def backoff(docs, alpha, least):
    """(doc_id, tokens, bigrams backed off from, score) by counts of all other documents."""
    tokens = [(d, brute.ids(t)) for d, t in docs]
    one, two = Counter(), Counter()
    for _, own in tokens:
        one.update(own)
        two.update(zip(own, own[1:]))
    total, out = sum(one.values()), []
    for d, own in tokens:
        held, pairs = Counter(own), Counter(zip(own, own[1:]))
        rest, s, off = max(total - len(own), 1), 0.0, 0
        for i, w in enumerate(own):
            alone = max(one[w] - held[w], alpha) / rest
            left = two[own[i - 1], w] - pairs[own[i - 1], w] if i else 0
            if i == 0:
                s += math.log10(alone)
            elif left >= least:
                s += math.log10(left / (one[own[i - 1]] - held[own[i - 1]]))
            else:
                s += math.log10(alpha * alone)
                off += 1
        out.append((d, len(own), off, s))
    return out


def close(rows, expected):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[3])
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_unseen"], r["log10_score"]) for r in rows), key=key)
    assert len(found) == len(expected)
    for a, b in zip(found, sorted(expected, key=key)):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=2e-6, rel_tol=1e-9)


def test_scores_of_the_whole_table(spark, documents):
    close(op10_stupid_backoff(spark, SF).collect(), backoff(documents, 0.4, 1))


@pytest.mark.parametrize("share", [1, 64])
def test_rare_bigrams_of_the_whole_table_are_joined(spark, documents, share):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    close(lm_scoring.score(table, PATH, share=share).collect(), backoff(documents, 0.4, 1))


@pytest.mark.parametrize("share", [1, 8, 1 << 20])
@pytest.mark.parametrize("least", [1, 3])
def test_scores_do_not_depend_on_the_frequent_share(make_docs, share, least):
    docs = [(1, None), (2, ""), (3, "a b a b a c"), (3, "a b a b a c"), (None, "z"), (5, "a b " * 9000), (6, "a b c a")]
    rows = lm_scoring.score(make_docs(docs), PATH, 0.3, least, share).collect()
    close(rows, backoff(docs, 0.3, least))
    assert [r["log10_per_token"] for r in rows if r["doc_id"] == 1] == [None]
    assert lm_scoring.score(make_docs([]), PATH).count() == 0


@pytest.mark.parametrize("share", [1, 1 << 20])
def test_alpha_changes_scores_of_bigrams_that_no_other_document_holds(make_docs, share):
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat on the cat"), (3, "sat the mat on dog cat"), (4, "the cat")]
    low, high = ({r["doc_id"]: r for r in lm_scoring.score(make_docs(docs), PATH, a, share=share).collect()} for a in (0.1, 0.4))
    for d, row in high.items():
        unseen = row["n_unseen"]
        gain = row["log10_score"] - low[d]["log10_score"]
        assert (unseen == 0) == (d == 4) and gain >= unseen * math.log10(4) - 1e-5


def test_a_text_that_occurs_twice_backs_off_nowhere(make_docs):
    docs = [(1, "one strange text of its own"), (2, "one strange text of its own"), (3, "another very odd piece of prose")]
    found = {r["doc_id"]: r for r in lm_scoring.score(make_docs(docs), PATH).collect()}
    assert found[1]["n_unseen"] == found[2]["n_unseen"] == 0 and found[3]["n_unseen"] > 0
    assert found[1]["log10_per_token"] > found[3]["log10_per_token"]


def test_ids_beyond_16_bits_keep_their_width(make_docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "id_bound", lambda path: 1 << 20)
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat on the cat")]
    close(lm_scoring.score(make_docs(docs), PATH, share=4).collect(), backoff(docs, 0.4, 1))


def test_numeric_signs_part_words():
    assert language_id.letters("H₂O, x² Ⅳ 12ab Straße_3") == ["h", "o", "x", "ab", "straße"]
    assert language_id.letters(None) == language_id.letters("²₂ 12") == []
