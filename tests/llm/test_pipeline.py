"""Each stage of the pipeline on odd tables."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from evenstep.llm import queries

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with operators' names."""
    rng = random.Random(0)
    prose = lambda n: " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))
    a, b, c, d = (prose(80) for _ in range(4))
    rows = [
        (1, a, "en"), (1, b, "en"), (1, b, "en"), (None, c, None), (None, d, "de"), (None, d, "de"), (2, a, "fr"), (3, None, "en"), (4, "", None), (5, " \n", "es"),
        (6, prose(60_000), "en"), (7, c.upper(), "en"), (None, None, None), (8, "few words", "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id long, text_sha256 string, stratum string, least int, toxic int"
    return spark.createDataFrame([(*r, None, None, None, 0.5, 1, None, "x", 1, 0) for r in rows], schema).repartition(3)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_and_empty_tables(name, odd, spark, sf):
    out = STAGES[name](spark, odd, sf)
    assert out.schema == odd.schema and 0 < out.count() <= odd.count()
    empty = STAGES[name](spark, odd.where("false"), sf)
    assert empty.schema == odd.schema and not empty.collect()


def test_what_stays(odd, spark, sf):
    rows = odd.select("doc_id", "text").collect()
    count = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
    every = Counter(map(tuple, rows))
    assert count(STAGES["toxicity"](spark, odd, sf)) == every
    assert count(STAGES["quality"](spark, odd, sf)) == Counter({k: n for k, n in every.items() if len((k[1] or "").split()) >= 50})
    first = count(STAGES["exact_dedup"](spark, odd, sf))
    texts = {" ".join((t or "").split()) for _, t in rows}
    assert Counter(" ".join((t or "").split()) for _, t in first.elements())[""] == 2  # empty, and one space
    assert {" ".join((t or "").split()) for _, t in first} == texts and sum(first.values()) == len(texts) + 1
    assert all(n == 1 for n in first.values())
    near = count(STAGES["near_dedup"](spark, odd, sf))
    folded = {" ".join((t or "").lower().split()) for _, t in rows}
    assert Counter(" ".join((t or "").lower().split()) for _, t in near.elements()) == dict.fromkeys(folded, 1)
    assert {d for d, t in near if (t or "").lower() == rows[0].text.lower()} <= {1, 2, None, 3, 4, 5, 6, 7, 8}


def test_last_stage(odd, spark, sf):
    out = STAGES["packing"](spark, odd, sf)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert not STAGES["packing"](spark, odd.where("false"), sf).collect()
    sizes = Counter()
    for r in out.collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


def test_pipeline_packs_what_the_stages_kept(spark, sf):
    docs = queries.table(spark, sf, "documents")
    for name in list(STAGES)[:-1]:
        docs = STAGES[name](spark, docs, sf).cache()
    want = Counter({(r.doc_id, r.doc_tokens): 1 for r in queries.packed(docs).collect()})
    assert Counter(set((r.doc_id, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect())) == want


def test_empty_tables_of_copies(odd):
    from evenstep.llm import block_naming, simhash

    none = odd.where("false")
    assert block_naming.exact_duplicates(none).columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert not block_naming.exact_duplicates(none).collect()
    assert simhash.near_duplicates(none).columns == ["doc_id", "fingerprint", "component_id"]
    assert not simhash.near_duplicates(none).collect() and not simhash.survivors(none).collect()
