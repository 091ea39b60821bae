import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hirelake.llm import components as components_module
from hirelake.llm import decontamination, simhash, substring_dedup
from hirelake.llm.automaton import SuffixAutomaton
from hirelake.llm.components import components
from hirelake.llm.queries import ORACLES, op3_benchmark_decontamination, op8_substring_dedup, op9_simhash_near_dedup
from hirelake.sources.staging import stage
from tests.llm import brute
from tests.llm.conftest import SF


def report(frame, window=20):
    return {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup_report(frame, window).collect()}


def test_substrings_of_the_whole_table(spark, documents):
    assert {r["doc_id"]: tuple(r)[1:] for r in op8_substring_dedup(spark, SF).collect()} == brute.removed(documents)


def repetitive(seed, n, alphabet):
    """Texts that share passages with each other and within themselves."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(alphabet)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(8)]
    texts = []
    for _ in range(n):
        body = []
        for _ in range(rng.randint(0, 8)):
            body += rng.choice(passages) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(body))
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed, window, alphabet", [(1, 20, 40), (2, 20, 2), (3, 6, 5), (4, 9, 300)])
def test_substrings_against_brute_force(make_docs, monkeypatch, seed, window, alphabet):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 200)
    monkeypatch.setattr(substring_dedup, "SPLIT_WORDS", 300)
    docs = repetitive(seed, 60, alphabet)
    assert report(make_docs(docs), window) == brute.removed(docs, window)


def test_substring_edge_cases(make_docs):
    long = " ".join(f"a{i % 700}" for i in range(3000))
    docs = [(1, None), (2, ""), (3, long), (4, long), (5, " ".join("x" for _ in range(19))), (6, " ".join("x" for _ in range(21)))]
    assert report(make_docs(docs)) == brute.removed(docs)
    assert report(make_docs([])) == {}


def test_repeated_and_missing_ids(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring_dedup.dedup_report(make_docs([(None, text), (7, text), (7, text), (7, "other " + text)])).collect()
    found = sorted((r["doc_id"] is not None, r["n_words"], r["n_removed"]) for r in rows)
    assert found == [(False, 30, 0), (True, 30, 30), (True, 30, 30), (True, 31, 30)]


def test_texts_keep_their_layout(make_docs):
    shared = " ".join(f"s{i}" for i in range(25))
    docs = [(1, "Head\n\n" + shared + "\n tail  end"), (2, "New\tline\n" + shared + "\nafter it\n"), (3, shared), (4, None)]
    out = substring_dedup.without_repeats(make_docs(docs))
    assert out.columns == make_docs(docs).columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == docs[0][1] and rows[2]["text"] == "New\tline after it" and rows[2]["n_chars"] == 17
    assert 3 not in rows and rows[4]["text"] is None and rows[1]["key"] == "key"
    assert substring_dedup.without_repeats(make_docs([])).count() == 0


def test_automaton_finds_first_places():
    rng = random.Random(5)
    for _ in range(200):
        held = [[rng.choice("ab") for _ in range(rng.randint(0, 12))] for _ in range(3)]
        automaton, first = SuffixAutomaton(), {}
        for key, symbols in enumerate(held):
            automaton.add(symbols, key, 100)
            for i in range(len(symbols) - 3):
                first.setdefault(tuple(symbols[i : i + 4]), (key, 100 + i))
        text = [rng.choice("abc") for _ in range(20)]
        found = dict(automaton.first_places(text, 4))
        assert found == {i: first[tuple(text[i : i + 4])] for i in range(17) if tuple(text[i : i + 4]) in first}


def test_simhash_of_the_whole_table(spark, documents):
    rows = {r["doc_id"]: tuple(r)[1:] for r in op9_simhash_near_dedup(spark, SF).collect()}
    assert rows == brute.near_duplicates(documents)


@pytest.mark.parametrize("bits, largest", [(2, 256), (2, 2), (3, 2), (1, 3), (4, 4), (0, 1)])
def test_close_pairs_lose_none(spark, bits, largest):
    rng = random.Random(bits * 10 + largest)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(30)}
    values |= {c ^ (rng.getrandbits(32) << 32) for c in centres[:2] for _ in range(20)} | {0, simhash.ALL}
    signed = [simhash._signed(v) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "value long")
    found = {tuple(sorted(r)) for r in simhash.close_pairs(frame, bits, largest).collect()}
    distance = lambda a, b: ((a ^ b) & simhash.ALL).bit_count()
    assert found == {(a, b) for a in signed for b in signed if a < b and distance(a, b) <= bits}


@pytest.fixture
def staged_plans(monkeypatch):
    """(label, plan as Spark made it from its estimates) of all that is staged in a test."""
    plans = []

    def noted(df, label, *session):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label, *session)

    for module in (simhash, components_module, decontamination):
        monkeypatch.setattr(module, "stage", noted)
    return plans


def test_variants_are_never_broadcast(spark, tmp_path, staged_plans):
    rng = random.Random(8)
    values = [rng.getrandbits(63) for _ in range(500)]
    values += [v ^ 5 for v in values[:50]] + [v ^ (1 << 40) for v in values[50:80]]
    spark.createDataFrame([(v,) for v in values], "value long").write.parquet(f"{tmp_path}/values")
    found = simhash.close_pairs(spark.read.parquet(f"{tmp_path}/values"), 2, 8)
    assert {tuple(sorted(r)) for r in found.collect()} >= {tuple(sorted((v, v ^ 5))) for v in values[:50]}
    # The files are of a few kB, but each value has 34 variants and a bucket's pairs are many.
    assert [label for label, _ in staged_plans[:2]] == ["buckets", "pairs"]
    assert all("SortMergeJoin" in plan and "Broadcast" not in plan for _, plan in staged_plans)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_links_are_joined_by_shuffle(spark, monkeypatch, staged_plans):
    links = [(a, b) for a in range(40) for b in range(a)] + [(100 + i, 101 + i) for i in range(20)]
    frame = spark.createDataFrame(links, "a long, b long")
    expected = {n: 0 for n in range(40)} | {n: 100 for n in range(100, 121)}
    assert {r["node"]: r["root"] for r in components(frame).collect()} == expected
    assert any("Broadcast" in plan for _, plan in staged_plans)
    staged_plans.clear()
    monkeypatch.setattr(components_module, "BROADCAST_EDGES", 30)
    assert {r["node"]: r["root"] for r in components(frame).collect()} == expected
    joined = [plan for _, plan in staged_plans if "Join" in plan]
    assert joined and not any("Broadcast" in plan for plan in joined)


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    order = list(range(200))
    rng.shuffle(order)
    links = list(zip(order[:120], order[1:120])) + [(150, 150), (order[130], order[131])]
    frame = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in components(frame).collect()}
    assert {found[n] for n in order[:120]} == {min(order[:120])} and len(found) == 122
    assert components(frame.limit(0)).count() == 0


def test_simhash_edge_cases(make_docs):
    docs = [(5, None), (3, ""), (9, " \n"), (8, "one two"), (7, "ONE two"), (2, "É b c d"), (1, "long " * 30000)]
    rows = simhash.near_duplicates(make_docs(docs)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute.near_duplicates(docs)
    loose = simhash.near_duplicates(make_docs([(None, "a b c"), (4, "a b c"), (None, "x y z w")])).collect()
    assert sorted((r["component_id"] or 0) for r in loose) == [0, 4, 4]
    assert simhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 100])
def test_one_of_each_group_stays(make_docs, broadcast_rows):
    docs = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "q r s t"), (2, "q r s t"), (None, "a b c d"), (None, "v w x y")]
    kept = simhash.keep_one(make_docs(docs), broadcast_rows=broadcast_rows)
    assert kept.columns == make_docs(docs).columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(found, key=repr) == sorted([(1, "a b c d"), (1, "q r s t"), (None, "v w x y")], key=repr)
    assert simhash.keep_one(make_docs([])).count() == 0


def test_contained_items_of_the_whole_table(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = op3_benchmark_decontamination(spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in rows} == brute.contained(documents, items)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_containment_at_the_threshold(spark, make_docs, broadcast_rows):
    rng = random.Random(2)
    items, docs = [], [(900, None), (901, ""), (902, "Short, item!"), (903, "a short item")]
    for i, n in enumerate([1, 4, 5, 6, 12, 24, 40, 67, 130]):
        own = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(own)))
        for j, share in enumerate((1.0, 0.9, 0.8, 0.75, 0.5)):
            noise = [f"n{rng.randrange(50)}" for _ in range(rng.choice([0, 30, 4000]))]
            docs.append((10 * i + j, "\n".join([*noise, *(w.upper() + "," for w in own[: round(n * share)]), *noise])))
    items += [(50, items[5][1]), (51, "short item"), (52, "... !"), (53, None), (None, items[6][1])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_contained(make_docs(docs), frame, broadcast_rows=broadcast_rows).collect()
    found = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in rows}
    assert len(rows) == len(found) and found == brute.contained(docs, [x for x in items if x[0] is not None])
    kept = decontamination.remove_contaminated(make_docs(docs), frame, broadcast_rows)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}
    assert kept.columns == make_docs(docs).columns
    assert decontamination.find_contained(make_docs([]), frame).count() == 0
    assert decontamination.remove_contaminated(make_docs(docs), frame.limit(0)).count() == len(docs)


def test_missing_and_repeated_ids_in_decontamination(spark, make_docs):
    text = "one two three four five six seven"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    docs = make_docs([(None, text), (4, text), (4, text), (5, "nothing of it here at all")])
    rows = decontamination.find_contained(docs, items).collect()
    assert sorted((r["doc_id"] or 0, r["n_shared"]) for r in rows) == [(0, 3), (4, 3)]
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs, items).collect()] == [5]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_items_are_told_by_their_texts(spark, make_docs, broadcast_rows):
    texts = [" ".join(f"{x}{i}" for i in range(20)) for x in "abcd"]
    items = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (None, texts[2]), (None, texts[0])], "item_id long, text string")
    docs = make_docs([(i, f"before {t} after") for i, t in enumerate(texts)])
    rows = decontamination.find_contained(docs, items, broadcast_rows=broadcast_rows).collect()
    assert sorted(tuple(r)[:4] for r in rows) == [(0, 0, 16, 16), (1, 0, 16, 16), (2, None, 16, 16)]
    assert [r["doc_id"] for r in decontamination.remove_contaminated(docs, items, broadcast_rows).collect()] == [3]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_clean_rows_stay_beside_contaminated_ones_of_the_same_id(spark, make_docs, broadcast_rows):
    own = [f"w{i}" for i in range(24)]
    items = spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    leak, clean = "x " + " ".join(own), "nothing of it here at all"
    halves = [(8, " ".join(own[:14])), (8, " ".join(own[10:]))]
    docs = make_docs([(None, leak), (None, clean), (None, None), (7, leak), (7, leak), (7, clean), *halves])
    rows = decontamination.find_contained(docs, items, broadcast_rows=broadcast_rows).collect()
    assert sorted((r["doc_id"] or 0, r["n_shared"]) for r in rows) == [(0, 20), (7, 20)]
    kept = [(r["doc_id"], r["text"]) for r in decontamination.remove_contaminated(docs, items, broadcast_rows).collect()]
    assert sorted(kept, key=repr) == sorted([(None, clean), (None, None), (7, clean), *halves], key=repr)


def test_repeated_rows_are_searched_once(make_docs, monkeypatch):
    searched, search = [], substring_dedup.repeated_ranges

    def watched(docs, *args, **named):
        searched.append(docs.count())
        return search(docs, *args, **named)

    monkeypatch.setattr(substring_dedup, "repeated_ranges", watched)
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring_dedup.dedup_report(make_docs([(None, text)] * 5 + [(7, text)] * 5)).collect()
    assert searched == [2]
    assert sorted((r["doc_id"] is not None, r["n_removed"]) for r in rows) == [(False, 0)] * 5 + [(True, 30)] * 5


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_short_items_are_found_inside_documents(spark, make_docs, broadcast_rows):
    items = [(1, "Purple monkey dishwasher"), (2, "so"), (3, "two words"), (4, "one two three four"), (5, "one two three four five six")]
    docs = [
        (1, "the secret is purple, MONKEY dishwasher is it not so"), (2, "purple monkey"), (3, "monkey purple dishwasher"),
        (4, "two words"), (5, "two  words. two"), (6, "one two three four five six"), (7, "one two three"), (8, "sow"), (9, "x " * 5000 + "so"),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = decontamination.find_contained(make_docs(docs), frame, broadcast_rows=broadcast_rows).collect()
    found = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in rows}
    assert found == brute.contained(docs, items) and {d for d, i in found if i == 1} == {1}
    connection = duckdb.connect()
    for name, columns, values in (("documents", "doc_id BIGINT, text VARCHAR", docs), ("benchmark", "item_id BIGINT, text VARCHAR", items)):
        connection.execute(f"CREATE TABLE {name} ({columns})")
        connection.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    sql = connection.execute(ORACLES["op3_benchmark_decontamination"]).fetchall()
    assert {(d, i): (shared, of) for d, i, shared, of, _ in sql} == found
    kept = decontamination.remove_contaminated(make_docs(docs), frame, broadcast_rows).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 3, 7, 8]


def test_a_lead_that_many_items_share_makes_no_pairs(spark, make_docs, monkeypatch):
    lead = "please read this passage and answer"
    items = [(i, f"{lead} " + " ".join(f"q{i}w{k}" for k in range(12))) for i in range(1000)]
    docs = [(d, f"{lead} d{d} e{d} f{d}") for d in range(200)] + [(500, "before " + items[7][1] + " after")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    pairs, real = [], decontamination.stage

    def watched(df, label):
        staged = real(df, label)
        if label == "candidate-pairs":
            pairs.append(staged.count())
        return staged

    monkeypatch.setattr(decontamination, "stage", watched)
    rows = decontamination.find_contained(make_docs(docs), frame).collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(500, 7)] and pairs == [1]


def test_clashing_names_and_very_long_texts_in_decontamination(spark, make_docs):
    words = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, words)], "item_id long, text string").withColumns(
        {n: F.lit(n) for n in "doc_id hash item shingle n_item found_id own often".split()}
    )
    docs = make_docs([(1, "x y z " * 200_000 + words), (2, "x y z " * 200_000), (3, words[:60])])
    assert [r["doc_id"] for r in decontamination.find_contained(docs, frame).collect()] == [1]
    assert sorted(r["doc_id"] for r in decontamination.remove_contaminated(docs, frame).collect()) == [2, 3]


def test_a_long_document_fills_no_automaton(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    again = text.split()
    sizes, real = [], substring_dedup.stage

    def watched(df, label):
        staged = real(df, label)
        if label == "segments":
            sizes.extend(r["words"] for r in staged.filter("role = 0").groupBy("shard").agg(F.sum("words").alias("words")).collect())
        return staged

    monkeypatch.setattr(substring_dedup, "stage", watched)
    docs = [(1, text), (2, text), (3, " ".join(["x", *again[1000:200_000], "y"])), (4, " ".join(again[:10]))]
    assert report(make_docs(docs, extra=False)) == brute.removed(docs)
    assert max(sizes) <= substring_dedup.SHARD_WORDS + 2 * substring_dedup.WINDOW and len(sizes) > 7


def test_repeats_within_the_first_document(spark, make_docs):
    rng = random.Random(9)
    pool = [[f"p{i}w{k}" for k in range(30)] for i in range(6)]
    docs = []
    for d in range(5):
        words = []
        for _ in range(120):
            words += rng.choice(pool)[rng.randrange(5) :] + [f"u{rng.randrange(4)}"] * rng.randrange(3)
        docs.append((d, " ".join(words)))
    assert report(make_docs(docs, extra=False)) == brute.removed(docs)


def test_words_of_many_texts_are_hashed_as_one_column():
    texts = ["", "a b", " a", "  ", "b\ta\u00a0c\n", "\u00e9", "x" * 300 + " y", "b"]
    column = pa.array(texts)
    borders = np.frombuffer(column.buffers()[1], np.int32)[: len(texts)].astype(np.int64)
    hashes = substring_dedup._Hashes(0)
    found, starts = hashes.of_bytes(np.frombuffer(column.buffers()[2], np.uint8), borders)
    words = [w for t in texts for w in t.encode().split()]
    assert len(found) == len(starts) == len(words)
    assert len(set(found.tolist())) == len(set(words)) == len(set(zip(words, found.tolist())))
    assert [h for own in hashes.of_each(column) for h in own.tolist()] == found.tolist()
    assert [len(own) for own in hashes.of_each(column.slice(1))] == [len(t.encode().split()) for t in texts[1:]]
    values = np.array([3, 1, 1, 2, 1, 5, 5, 5, 0], np.uint64)
    for width in (1, 2, 3, 4, 7, 9):
        least = [i + int(values[i : i + width].argmin()) for i in range(len(values) - width + 1)]
        assert substring_dedup._least_places(values, width).tolist() == least


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_shingles_of_documents_are_never_broadcast(spark, make_docs, tmp_path, staged_plans, broadcast_rows):
    text = " ".join(f"w{i}" for i in range(40))
    make_docs([(1, text), (2, "before it " + text), (3, text[:60]), (None, None)], extra=False).write.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(7, text), (8, text[100:])], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = decontamination.remove_contaminated(docs, items, broadcast_rows)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3]
    plans = dict(staged_plans)
    assert "SortMergeJoin" in plans["item-sketches"] and "Broadcast" not in plans["item-sketches"]
    assert ("Broadcast" in plans["candidate-pairs"]) == (broadcast_rows > 0)
    # Words of the documents are on the left here; what is broadcast is counted and on the right.
    assert "SortMergeJoin" in plans["leaks"] and "BuildLeft" not in plans["leaks"]
