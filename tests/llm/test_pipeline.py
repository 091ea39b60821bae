import re

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_tokens_and_packing import check


def expected(documents, items):
    """What is left for packing, stage by stage."""
    docs = [(d, t) for d, t in documents if brute.quality(t)[-1]]
    near = brute.near_duplicates(docs)
    docs = [(d, t) for d, t in docs if near[d][1] == d]
    out = []
    kept = brute.stays(docs)
    for d, t in docs:
        words, keep = kept[d]
        if all(keep):
            out.append((d, t))
        elif any(keep):
            spans = [m.span() for m in brute.WORD.finditer(t)]
            text, last = "", None
            for (a, b), k in zip(spans, keep):
                if k:
                    text += (t[last:a] if last is not None else " " if text else "") + t[a:b]
                last = b if k else None
            out.append((d, text))
    leaks = {d for d, _ in brute.contained(out, items)}
    return [(d, t) for d, t in out if d not in leaks]


def test_pipeline_equals_brute_force(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = expected(documents, items)
    assert 50 < len(left) < len(documents)
    check(corpus_pipeline.run(spark, SF).collect(), left, 2048, 1)


def test_stages_keep_the_columns(spark, make_docs):
    text = " ".join(f"word{i}" for i in range(60)) + ".\n"
    docs = make_docs([(1, text), (2, text), (3, None), (4, ""), (5, re.sub("word", "other", text)), (None, re.sub("word", "third", text))])
    columns = docs.columns
    for name, function in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            out = function(spark, frame, SF)
            assert name == "packing" or out.columns == columns
        if name != "packing":
            docs = function(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 1, 5]


def test_pipeline_on_repeated_rows_and_a_very_long_text(spark, make_docs, tmp_path):
    long = " ".join(f"term{i % 99_991} of" + "." * (i % 9 == 0) for i in range(250_000))
    plain = " ".join(f"word{i}" for i in range(60)) + "."
    docs = make_docs([(1, plain), (1, plain), (2, long), (3, None), (None, " ".join(f"other{i}" for i in range(60)))])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add((r["start"], r["length"], r["doc_tokens"]))
    assert {d for d in by_doc} <= {1, 2, None} and {1, None} <= set(by_doc)
    for spans in by_doc.values():
        assert sum(length for _, length, _ in spans) == next(iter(spans))[2]
