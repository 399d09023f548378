"""The pipeline's rows against a brute-force version, stage by stage."""

import zlib

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from shopstream.llm import bpe

from .test_near import brute_lines, components, shingles
from .test_texts import brute_hits, brute_prototypes, letter_vector

SF = "/root/testdata/sf0.001"


def without_lines(docs):
    gone = set().union(*brute_lines(docs.items()))
    out = {}
    for i, t in docs.items():
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if left == t or left.strip(" \t\n\x0b\x0c\r"):
            out[i] = left
    return out


def recognised(docs, langs):
    """In plain Python: letters, and a large enough cosine with a prototype if there are 200 of them."""
    learnt = brute_prototypes([(t, langs[i]) for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5])
    score = lambda t: max(float(letter_vector(t) @ v) for v in learnt.values())
    letters = {i: sum(c.isalpha() for c in t or "") for i, t in docs.items()}
    return {i: t for i, t in docs.items() if letters[i] and (letters[i] < 200 or score(t) >= 0.15)}


def first_of_each(docs):
    sets = {i: shingles(t, 5) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: docs[i] for i, c in components(ids, links).items() if i == c}


def test_pipeline_equals_brute_force(spark):
    import tiktoken

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = recognised(docs, {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()})
    docs = first_of_each(without_lines(docs))
    docs = {i: t for i, t in docs.items() if not brute_hits(t, items, 10)[1]}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in rows} == {i: (len(own.encode_ordinary(t)), own.encode_ordinary(t), t) for i, t in docs.items()}
    assert len(rows) == len(docs) > 100


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and stage(spark, docs.limit(0), SF).collect() == []
        docs = kept


def test_stages_with_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and columns of clashing names pass every stage."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = rows[0][1] + " tail" * 40_000
    odd = [(None, rows[1][1], "en", "x", 1), (900, None, None, None, None), (901, "", "en", "x", 0), (902, long, "en", "x", len(long)), (903, " \n\t\n", "en", "x", 4), rows[2], rows[2], (rows[3][0], "another text under an id that is there already", "en", "x", 9)]
    names = ["_removed_in", "_places", "places", "kept", "own", "h", "g", "first", "n_words", "same", "hits", "tie", "component_id", "a.b"]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(k) for k, n in enumerate(names)}).repartition(3)
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept[name] = stage(spark, docs, SF)
        assert kept[name].columns == docs.columns
        assert {tuple(r)[5:] for r in kept[name].collect()} == {tuple(range(len(names)))}
    assert 900 not in ids(kept["language"]) and 901 not in ids(kept["language"]) and None in ids(kept["language"])
    assert {900, 901, 903} <= set(ids(kept["line_dedup"])) and {900, 901, 903} <= set(ids(kept["near_dedup"]))
    assert {900, 901, 903} <= set(ids(kept["decontamination"]))
    near = ids(kept["near_dedup"])
    assert None in near and near.count(rows[2][0]) == 3  # a null id links with nothing; repeated rows are one document
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id", "n_tokens", "decoded").collect()
    assert len(tokens) == len(rows) + len(odd) and [r.n_tokens for r in tokens if r.doc_id == 900] == [0]
    assert [r.decoded == long for r in tokens if r.doc_id == 902] == [True]
