"""Near-duplicate operators against brute force on small fixtures."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopstream.llm import arrays, near, substring, vectors
from shopstream.llm.components import connected_components
from shopstream.llm.lines import dedupe_lines, without_repeated_lines
from shopstream.llm.scratch import Scratch
from shopstream.llm.vectors import near_vectors

SPACED = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string, kept string, n_words int"


def documents(spark, texts):
    """Extra columns clash with names of results."""
    return spark.createDataFrame([(i, t, None, "x", -1) for i, t in texts], DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{x}" for x in rng.integers(0, words, n))


def near_copies(seed, groups=6, copies=6, words=150, edits=1):
    rng, out = np.random.default_rng(seed), []
    for _ in range(groups):
        base = prose(rng, words).split()
        for k in range(copies):
            own = list(base)
            for at in rng.integers(0, len(own), edits if k else 0):
                own[at] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(own))
    out += [prose(rng, 30) for _ in range(10)] + [None, "", "   ", "one two", "ONE two", "one  two", "one"]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[i]) for i in order]


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def shingles(text, width):
    words = re.findall(SPACED, (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("blocks", [{}, {"block_docs": 3, "block_shingles": 10**6}])
@pytest.mark.parametrize("percent", [80, 85])
def test_minhash(spark, blocks, percent):
    docs = near_copies(1)
    sets = {i: shingles(t, 5) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    found = near.near_duplicates(documents(spark, docs), percent=percent, **blocks).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(links) > 20


def test_minhash_large_groups(spark):
    """Blocks of five: a group of near copies, chains whose ends are unlike, a family that is alike but not linked, a very long text."""
    rng = np.random.default_rng(21)
    base = prose(rng, 120).split()
    docs = [(k, " ".join(w if i != 7 + k else f"e{k}" for i, w in enumerate(base))) for k in range(60)]
    for c in range(2):
        words = prose(rng, 150).split()
        for k in range(25):
            docs.append((100 + 50 * c + k, " ".join(words)))
            words[5 * k : 5 * k + 2] = [f"c{c}k{k}a", f"c{c}k{k}b"]
    family = prose(rng, 90)
    docs += [(300 + k, f"{family} {prose(rng, 22)}") for k in range(30)]
    docs += [(400, prose(rng, 150_000)), (401, None)]
    docs.append((402, docs[-2][1] + " tail"))
    sets = {i: shingles(t, 5) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    found = near.near_duplicates(documents(spark, docs), percent=85, block_docs=5).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert len(set(want.values())) > 30 and len({want[k] for k in range(100, 125)}) == 1 == len({want[k] for k in range(60)})


def test_minhash_odd_rows(spark):
    text = prose(np.random.default_rng(3), 50)
    rows = near.near_duplicates(documents(spark, [(5, text), (2, text), (2, text), (None, text), (7, None)])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [(2, 2, True), (2, 2, True), (5, 2, False), (7, 7, True), (None, None, True)]
    assert near.near_duplicates(documents(spark, [])).collect() == []
    kept = near.first_of_each(documents(spark, [(5, text), (2, text), (None, text)]))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "n_words"] and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long")
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()} == want
    assert connected_components(df.limit(0), Scratch(spark, "t")).collect() == []


def removed_words(docs, window):
    words = {i: re.findall(SPACED, t or "") for i, t in docs}
    starts = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            starts.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for i, w in words.items():
        gone = {k + x for k in range(len(w) - window + 1) if min(starts[tuple(w[k : k + window])]) < i for x in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [1, 4, 13, 16])
def test_substring(spark, window):
    docs = near_copies(7)
    rng = np.random.default_rng(8)
    passage = prose(rng, 55)
    docs += [(900 + k, f"{prose(rng, 20)} {passage} {prose(rng, int(rng.integers(0, 30)))}") for k in range(6)] + [(990, "a " * 40), (991, "a " * 12), (992, "b " * 13)]
    want = removed_words(docs, window)
    found = substring.dedupe(documents(spark, docs), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == want
    digest = substring.dedupe(documents(spark, docs), window, digest=True).collect()
    assert {r.doc_id: r.kept_sha256 for r in digest} == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}


def test_substring_of_very_long_texts(spark):
    rng = np.random.default_rng(22)
    long, other = prose(rng, 200_000), prose(rng, 1_000)
    rows = substring.dedupe(documents(spark, [(1, long), (2, f"{other} {long}"), (3, "a " * 100_000), (4, "a " * 100_000)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in rows) == [(1, 200_000, 0), (2, 201_000, 200_000), (3, 100_000, 0), (4, 100_000, 100_000)]


def test_substring_odd_rows(spark):
    text = prose(np.random.default_rng(9), 20)
    rows = substring.dedupe(documents(spark, [(2, text), (2, text), (4, text), (None, text), (1, None)])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in rows), key=str) == [(1, 0), (2, 0), (2, 0), (4, 20), (None, 0)]
    assert substring.dedupe(documents(spark, [])).collect() == []


def edit_distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_lines(docs):
    """Places of lines that equal an earlier line, and of those that are near one that is the first of its kind."""
    flat = sorted((i, k, x.split()) for i, t in docs for k, x in enumerate((t or "").split("\n")))
    first = {}
    exact = {(i, k) for i, k, w in flat if w and first.setdefault(tuple(w), (i, k)) != (i, k)}
    units = [(at, w, list(" ".join(w))) for w, at in first.items()]

    def close(a, b):  # by words if one line has ten, else by characters if one has ten
        (_, v, x), (_, w, y) = a, b
        v, w = (v, w) if max(len(v), len(w)) >= 10 else (x, y)
        return max(len(v), len(w)) >= 10 and edit_distance_one(list(v), list(w))

    near = {b[0] for b in units if any(a[0] < b[0] and abs(len(a[1]) - len(b[1])) <= 1 and close(a, b) for a in units)}
    return exact, near


def test_lines(spark):
    rng = np.random.default_rng(11)
    lines = [prose(rng, int(n)) for n in [*rng.integers(1, 45, 50), *rng.integers(1, 12, 30)]]
    lines += ["".join(chr(0x4E00 + int(k)) for k in rng.integers(0, 900, n)) for n in (3, 9, 10, 11, 30)]
    for line in list(lines):
        w = line.split()
        for _ in range(2):
            k, own = int(rng.integers(0, len(w))), list(w)
            own[k : k + 1] = [[], ["new"], ["new", own[k]]][int(rng.integers(0, 3))]
            lines.append(" ".join(own))
        own, k = list(line), int(rng.integers(0, len(line)))
        own[k : k + 1] = [[], ["\u6c34"], ["\U0001f600", own[k]]][int(rng.integers(0, 3))]
        lines.append("".join(own))
    for n in (9, 10, 11):  # across the bounds, in both directions
        w = prose(rng, n).split()
        lines += [" ".join(w), " ".join(w[:4] + w[5:]), " ".join([*w[:2], "put", *w[2:]]), "x".join(w)[: n + 30]]
        c = "".join(chr(0x5E00 + int(k)) for k in rng.integers(0, 900, n))
        lines += [c, c[:3] + c[4:], c[:7] + "\u6c34" + c[7:]]
    lines += lines[:20] + ["", "  ", "a\tb  c d e", "a b c d e", " a b \r c\x0bd e ", "OK", "abcdefghij", "a b c d e f g h i j", "a b c d e f g h i"]
    docs = [(i, "\n".join(lines[int(k)] for k in rng.integers(0, len(lines), 9))) for i in range(70)]
    exact, near = brute_lines(docs)
    short = {(i, k) for i, t in docs for k, x in enumerate(t.split("\n")) if len(x.split()) < 5}
    assert len(exact) > 50 and len(near) > 50 and len(exact & short) > 5 and len(near & short) > 2
    found = {r.doc_id: r for r in dedupe_lines(documents(spark, docs)).collect()}
    for i, t in docs:
        own = t.split("\n")
        r = found[i]
        assert (r.n_lines, r.n_exact, r.n_near) == (len(own), sum(x[0] == i for x in exact), sum(x[0] == i for x in near))
        assert r.kept == "\n".join(x for k, x in enumerate(own) if (i, k) not in exact | near)


def test_long_lines_and_documents(spark):
    rng = np.random.default_rng(12)
    words = prose(rng, 100_000).split()
    other = [*words[:70_000], "new", *words[70_000:]]
    many = "\n".join(f"line {k % 9_000} of many {k % 9_000}" for k in range(20_000))
    docs = [(1, " ".join(words)), (2, "head\n" + " ".join(other)), (3, many), (4, "\u6c34" * 30_000), (5, "\u6c34" * 30_001), (6, "a" * 300_000)]
    found = {r.doc_id: r for r in dedupe_lines(documents(spark, docs)).collect()}
    assert [(found[k].n_exact, found[k].n_near) for k in (1, 2, 4, 5, 6)] == [(0, 0), (0, 1), (0, 0), (0, 1), (0, 0)]
    assert found[2].kept == "head" and found[3].n_exact == 11_000 and found[3].n_lines == 20_000


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 1000, 9000])
def test_running_hashes(spark, n):
    values = np.random.default_rng(n).integers(-(2**62), 2**62, n)
    found = spark.createDataFrame([(values.tolist(),)], "x array<long>").select(arrays.running(F.col("x"), lambda x, y: x.bitwiseXOR(y), F.lit(0).cast("long"))).first()[0]
    assert found == [0, *np.bitwise_xor.accumulate(values).tolist()]


def test_an_id_with_several_texts_keeps_all_links(spark):
    a, b, c, d = (prose(np.random.default_rng(30 + k), 80) for k in range(4))
    rows = [(1, a), (2, b), (3, a), (3, b), (4, a), (4, c), (5, c + " tail"), (6, d), (7, d), (8, prose(np.random.default_rng(40), 80))]
    found = {r.doc_id: r.component_id for r in near.near_duplicates(documents(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8}


def test_bands_follow_from_bits():
    assert vectors.bands_for(12) == vectors.BANDS == 24
    for bits in (8, 12, 16, 20):
        assert vectors.missed(0.93, bits, vectors.bands_for(bits)) <= 0.003 < vectors.missed(0.93, bits, vectors.bands_for(bits) - 1)
    assert vectors.missed(0.96, 12, 24) == pytest.approx(0.00009, abs=5e-6)


def test_lines_odd_rows(spark):
    line = "one two three four five six seven"
    rows = [(1, line), (2, line + "\nother"), (3, line), (None, line), (4, None), (4, ""), (1, line)]
    found = [(r.doc_id, r.n_lines, r.n_exact, r.kept) for r in dedupe_lines(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(1, 1, 0, line), (1, 1, 0, line), (2, 2, 1, "other"), (3, 1, 1, ""), (None, 1, 0, line), (4, 0, 0, None), (4, 1, 0, "")], key=str)
    kept = without_repeated_lines(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "n_words"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "4", "4", "None"]
    assert dedupe_lines(documents(spark, [])).collect() == []
    clash = documents(spark, rows).selectExpr("doc_id", "text", "1 _removed_in", "2 _places", "3 places", "4 own", "5 `a.b`", "6 line")
    kept = without_repeated_lines(clash)
    assert kept.columns == clash.columns and kept.count() == 6
    other = clash.withColumnRenamed("doc_id", "id").withColumnRenamed("text", "kept")
    assert without_repeated_lines(other, id_col="id", text_col="kept").columns == other.columns


def test_a_word_less_or_more_counts_alike(spark):
    words = "one two three four five six seven eight nine ten".split()
    more, less = " ".join([*words, "eleven"]), " ".join(words[:3] + words[4:])
    for first, second in ((" ".join(words), more), (" ".join(words), less), (less, " ".join(words))):
        rows = dedupe_lines(documents(spark, [(1, first), (2, second)])).collect()
        assert {r.doc_id: r.n_near for r in rows} == {1: 0, 2: 1}


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block):
    rng = np.random.default_rng(13)
    base = rng.standard_normal((40, 64))
    hot = base[:1] + 0.02 * rng.standard_normal((70, 64))
    rows = np.concatenate([base, base[:10] + 0.1 * rng.standard_normal((10, 64)), base[:30] + 0.35 * rng.standard_normal((30, 64)), hot, np.repeat(base[5:6], 8, axis=0)]).astype(np.float32)
    data = [(i, [float(x) for x in v], int(i) % 2) for i, v in enumerate(rows)]
    data += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None] + [1.0] * 63, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1), (1006, data[0][1], None), (1007, [], 1)]
    units = {i: np.array(v, np.float64) / np.linalg.norm(v) for i, v, _ in data if i < 1000 or i in (1004, 1005)}
    label = {i: x for i, _, x in data}
    links = [(a, b) for a in units for b in units if a < b and label[a] == label[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93]
    want = components(label, links)
    n = {i: sum(i in pair for pair in links) for i in label}
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()}
    assert found == {i: (n[i], want[i], want[i] == i) for i in label}
    assert len(links) > 1000


def test_vectors_odd_rows(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id int, embedding array<double>, label int")
    rows = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()]
    assert sorted(rows, key=str) == [(3, 1, 3, True), (3, 1, 3, True), (5, 1, 3, False), (None, 0, None, True)]
    assert near_vectors(df.limit(0)).collect() == []


def test_vectors_of_any_scale(spark):
    rng = np.random.default_rng(19)
    base = rng.standard_normal((20, 48))
    rows = [v * s for v, s in zip(np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape)]), [1e200, 1e-200, 1e-310, 1.0] * 10)]
    df = spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()} == {k: (1, k % 20) for k in range(40)}


@pytest.mark.parametrize("bits", [12, 14])
def test_bits_follow_from_the_largest_label(spark, monkeypatch, bits):
    monkeypatch.setattr(vectors, "bits_for", lambda n: bits)
    rng = np.random.default_rng(20)
    base = rng.standard_normal((150, 64))
    rows = np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape)])
    units = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    assert found == {k: int((units @ units[k] >= 0.93).sum()) - 1 for k in range(300)} and sum(found.values()) > 200


def test_bits_grow_with_labels():
    assert [vectors.bits_for(n) for n in (0, 10**4, 10**6, 10**8, 10**10)] == [12, 12, 14, 20, 27]


def test_codes_estimate_without_bias():
    from shopstream.llm.vectors import CONFIDENCE, _rotation

    rng = np.random.default_rng(17)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((3000, 64)), rng.standard_normal((3000, 64))))
    y = x + 0.3 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    a, b = x @ _rotation(64, 0), y @ _rotation(64, 0)
    signs, factor = np.sign(b) / 8, np.abs(b).sum(axis=1) / 8
    error = (a * signs).sum(axis=1) / factor - (x * y).sum(axis=1)
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) < CONFIDENCE * np.sqrt(1 - factor**2) / factor / np.sqrt(63)).all()
