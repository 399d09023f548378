"""Text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from shopstream.llm import bpe, decontaminate, langid, licenses, resample, urls
from shopstream.llm.scratch import Scratch

from .test_near import documents, prose

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(ALNUM, (text or "").translate(LOWER))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.load_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", " ", "a", "  lead", "don't'll", "x" * 5000, "é" * 300, "日本語 テキスト", "😀😀", "\x00\x01", "tab\t\n\n  end  ", "<|endoftext|>", "1234567890" * 9, "ab" * 200 + "c"]


def test_encoding_equals_the_library(spark, library):
    rng = np.random.default_rng(1)
    alphabet = [chr(c) for c in [*range(32, 127), 233, 252, 0x4E2D, 0x1F600, 10, 9]]
    texts = ODD + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 60, 300)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = {r.doc_id: r for r in bpe.encode(documents(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN).collect()}
    digests = {r.doc_id: r for r in bpe.encode(documents(spark, list(enumerate(texts))), path, public_tokenizers.PATTERN, digest=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert (rows[i].ids, bytes(rows[i].decoded).decode(), rows[i].n_tokens) == (want, t or "", len(want))
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(documents(spark, []), path, public_tokenizers.PATTERN).collect() == []


def test_appends_and_edits_are_exact(ranks):
    rng, v = np.random.default_rng(2), bpe.Vocabulary(ranks)
    for _ in range(60):
        data = bytes(rng.choice(list("theaniongr é".encode()), int(rng.integers(1, 40))).tolist())
        cut = int(rng.integers(0, len(data)))
        grown = bpe.Encoding(v, data[:cut])
        grown.append(data[cut:])
        assert grown.tokens() == bpe.Encoding(v, data).tokens()
        a, b = sorted(rng.integers(0, len(data) + 1, 2).tolist())
        grown.edit(a, b, b"tion")
        assert grown.tokens() == bpe.Encoding(v, data[:a] + b"tion" + data[b:]).tokens()


# ---- decontamination


def brute_hits(text, items, width):
    own, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        for k in range(max(1, len(w) - width + 1)) if w else ():
            g = w[k : k + width]
            for i in range(len(own) - len(g) + 1):
                if own[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 700])
def test_contamination(spark, block):
    rng = np.random.default_rng(3)
    items = [(k, prose(rng, int(n), 200)) for k, n in enumerate(rng.integers(1, 40, 14))] + [(50, None), (51, ""), (52, "Tiny item"), (10, "w1 w2")]
    docs = [(k, prose(rng, int(n), 200)) for k, n in enumerate(rng.integers(0, 200, 25))]
    for k in range(12):
        w = (items[k][1] or "").upper().split()
        at = int(rng.integers(0, max(1, len(w) - 12)))
        docs.append((100 + k, f"{prose(rng, 9)} {'. '.join(w[at : at + 14])} {prose(rng, 5)} " * 2))
    docs += [(200, None), (201, "a tiny,item b"), (202, "tiny items"), (203, items[3][1]), (203, items[3][1])]
    table = spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.contamination(documents(spark, docs), table, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items) for r in rows) == sorted((i, *brute_hits(t, items, 10)) for i, t in docs)
    longest = {m.n_words for r in rows if r.doc_id == 203 for m in r.matches if m.item == "3"}
    assert max(longest) == len(words_of(items[3][1]))
    own = [*docs, (None, items[3][1]), (None, "plain"), (203, "a clean text under an id that has another one")]
    kept = decontaminate.clean(documents(spark, own), table, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "lang", "kept", "n_words"]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in own if not brute_hits(t, items, 10)[1])


def test_a_large_benchmark_and_a_very_long_text(spark):
    """Eight MB of items, the most that are sent at once, and a document of 300,000 words with one of them inside."""
    import resource

    rng = np.random.default_rng(4)
    items = [(k, " ".join(f"b{x}" for x in rng.integers(0, 50_000, 200))) for k in range(6_000)]
    assert decontaminate.BLOCK_BYTES * 0.8 < sum(len(t) for _, t in items) < decontaminate.BLOCK_BYTES
    text = f"{prose(rng, 150_000)} {items[77][1]} {prose(rng, 150_000)}"
    table = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.contamination(documents(spark, [(1, text), (2, "b1 b2")]), table).collect()
    assert sorted((r.doc_id, r.n_hit, r.items) for r in found) == [(1, 200, ["77"]), (2, 0, [])]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    decontaminate.Windows([(str(k), t) for k, t in items], 10)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id int, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(documents(spark, [(1, "a b"), (None, None)]), none).collect()] == [(1, 2, 0, []), (None, 0, 0, [])]
    assert decontaminate.contamination(documents(spark, []), none).collect() == []


# ---- language identification


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.learn(docs.where(~langid.held_out())))
    rows = found.join(docs, "doc_id").where(langid.held_out()).where("text rlike '[a-zA-Z]'").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) > 150
    assert all(0 <= r.score <= 1 for r in rows)


def test_close_languages_and_short_texts(spark):
    """Three languages that share most words and syllables: as right, held out, as plain trigram profiles without random vectors."""
    rng = np.random.default_rng(44)
    syllables = ["ka", "to", "ri", "ne", "sul", "mo", "per", "an", "ti", "ro", "es", "la", "vin", "du", "ser", "ol"]
    more = {"aa": ["ij", "oe", "eu"], "bb": ["ae", "sk", "od"], "cc": ["ch", "ei", "pf"]}
    word = lambda from_: "".join(rng.choice(from_, int(rng.integers(2, 4))))
    shared = [word(syllables) for _ in range(120)]
    own = {lang: shared + [word(syllables + more[lang]) for _ in range(60)] for lang in more}
    rows = [(i, " ".join(rng.choice(own[lang], int(rng.integers(4, 40)))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(docs.where(~langid.held_out()))).where(langid.held_out()).collect()}

    def plain(text):
        grams = Counter(f" {text} "[i : i + 3] for i in range(len(text)))
        norm = sum(n * n for n in grams.values()) ** 0.5
        return {g: n / norm for g, n in grams.items()}

    profiles = {lang: Counter() for lang in own}
    for i, text, lang in rows:
        if i not in found:
            profiles[lang].update(plain(text))
    norms = {k: sum(x * x for x in p.values()) ** 0.5 for k, p in profiles.items()}
    best = lambda text: max(profiles, key=lambda k: sum(x * profiles[k][g] for g, x in plain(text).items()) / norms[k])
    for least, most in ((4, 15), (15, 99)):
        own = [(lang == found[i], lang == best(text)) for i, text, lang in rows if i in found and least <= len(text.split()) < most]
        right, exact = np.mean(own, axis=0)
        assert len(own) > 80 and right > exact - 0.04 and exact > 0.65


def test_labels_that_are_no_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = spark.range(10).selectExpr("id doc_id", "'a text' text", "cast(id as string) lang")
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.learn(docs)


def test_blocks_of_ngrams_change_nothing(monkeypatch):
    texts = ["".join(map(chr, np.random.default_rng(k).integers(0x4E00, 0x4E30, 400))) for k in range(3)] + ["", "plain"]
    want = [v for _, v, _ in langid.vectors(texts)]
    monkeypatch.setattr(langid, "GRAMS", 50)
    assert np.allclose(np.concatenate(want), np.concatenate([v for _, v, _ in langid.vectors(texts)]), atol=1e-5)


def letter_vector(text):
    """A text's vector in plain Python, from its distinct trigrams; None without letters."""
    letter = lambda c: np.random.default_rng([7, ord(c) if c != " " else 0]).integers(0, 2, langid.DIMENSIONS, dtype=np.int8).astype(int) * 2 - 1
    t = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    t = re.sub(" +", " ", t)
    if t == " ":
        return None
    times, made = Counter(t[i : i + 3] for i in range(len(t) - 2)), {c: letter(c) for c in set(t)}
    out = sum(n * np.prod([np.roll(made[c], 2 - k) for k, c in enumerate(g)], axis=0) for g, n in times.items())
    return out / np.linalg.norm(out)


def brute_prototypes(rows):
    """``rows`` are (text, lang)."""
    sums = {}
    for text, lang in rows:
        if lang is not None and (v := letter_vector(text)) is not None:
            sums[lang] = sums.get(lang, 0) + v
    return {k: v / np.linalg.norm(v) for k, v in sums.items()}


def test_prototypes_equal_brute_force(spark):
    texts = [(1, "the house of the king", "en"), (2, "The garden, 12!", "en"), (3, "das Haus", "de"), (4, "der \u00dcberfluss", "de"), (5, "x", "rare")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    want = brute_prototypes([(t, lang) for _, t, lang in texts])
    found = langid.learn(df)
    assert set(found) == set(want) and all(np.allclose(found[k], want[k], atol=1e-4) for k in want)
    for r in langid.predict(df, found).collect():
        cosines = {k: float(letter_vector(texts[r.doc_id - 1][1]) @ v) for k, v in want.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and r.score == pytest.approx(max(cosines.values()), abs=1e-4)
    many = spark.range(700).selectExpr("id doc_id", "'text' text", "'l' || id lang")
    assert len(langid.learn(many, train_docs=1)) == 700  # no language is too rare


def test_language_odd_rows(spark):
    texts = [(1, "the house and the garden of the king"), (2, "das Haus und der Garten des Königs"), (3, None), (4, "12 34 !!"), (5, ""), (None, "the the"), (6, "x"), (7, "the garden " * 40_000), (8, "中文")]
    docs = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "de"))
    rows = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3, 4, 5, None, 7)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert rows[3].score == 0 and rows[6].lang_pred in ("de", "en") and rows[8].lang_pred != "und"
    none = langid.learn(docs.limit(0))
    assert none == {} and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    kept = langid.keep_recognised(docs, langid.learn(docs))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "7", "8", "None"]
    rng = np.random.default_rng(32)
    strange = ["".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, n)) for n in (199, 200, 5000)]
    more = documents(spark, [(50 + k, t) for k, t in enumerate([*strange, "the house and the garden of the king " * 9])])
    assert sorted(r.doc_id for r in langid.keep_recognised(more, langid.learn(docs)).collect()) == [50, 53]
    held = docs.select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


# ---- licenses


def test_licenses(spark):
    texts = {
        1: "Released under the GNU  General-Public\nLICENSE, version 2. See the MIT License.",
        2: "mit licenses; submit license; cc by; CC-BY-SA 4.0", 3: None, 4: "", 5: "plain words",
        6: "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0", 7: "Éa cc by é cc by " * 300,
        8: "the gnu lesser general public license v2.1 and gnu general public license",
    }
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, list(texts.items()))).collect()}
    for i, t in texts.items():
        w, places, labels = words_of(t), [], set()
        for p, label in licenses.BASE.items():
            own = p.split()
            at = [k for k in range(len(w)) if w[k : k + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), sorted(labels))
        assert set(r.base_labels) <= set(r.labels) and (r.score > 0) == bool(r.labels) and r.score < 1
    # the versioned name contains the plain one and suppresses it, but the base label stays
    assert rows[1].labels == ["GPL-2.0", "MIT", "gpl", "mit"]
    assert "CC-BY-SA-4.0" in rows[2].labels and rows[6].labels == ["Apache-2.0", "apache"]
    assert rows[8].labels == ["GPL", "LGPL-2.1", "gpl"]
    assert len(licenses.rules()) > 300
    assert licenses.scan(documents(spark, [])).collect() == []


#: Notices as they are written, with a label that the signatures give them.
LABELLED = {
    "Licensed under either of the Apache License, Version 2.0 or the MIT license": "Apache-2.0 OR MIT", "Dual licensed under the MIT or GPL Version 2 licenses.": "GPL OR MIT", "Dual BSD/GPL": "BSD OR GPL",
    "***** MPL 1.1/GPL 2.0/LGPL 2.1 *****": "GPL-2.0 OR LGPL-2.1 OR MPL-1.1", "under the same terms as Perl itself": "Artistic OR GPL", "CDDL + GPLv2 or CDDL and GPL v2": "CDDL OR GPL-2.0",
    "with the Classpath exception": "Classpath-exception", "GCC Runtime Library Exception": "GCC-exception", "Apache License v2.0 with LLVM Exceptions": "LLVM-exception", "GPL-2.0 WITH Linux-syscall-note": "Linux-syscall-note",
    "the GNU General Public License, version 2 only": "GPL-2.0-only", "GNU General Public License version 3 or (at your option) any later version": "GPL-3.0-or-later",
    "the GNU Lesser General\nPublic License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "LGPL-2.1-or-later",
    "You should have received a copy of the GNU Affero General Public License": "AGPL", "# Use of this source code is governed by a BSD-style license": "BSD", "Released under the terms of the MIT licence": "MIT",
    "If a copy of the MPL was not distributed with this\n# file, You can obtain one at": "MPL-2.0", "made available under the terms of the Eclipse Public License v2.0": "EPL", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "The Software shall be used for Good, not Evil.": "JSON", "you can buy me a beer in return": "Beerware", "Open Data Commons Public Domain Dedication and License": "PDDL", "Llama 2 Community License Agreement": "community", "CreativeML OpenRAIL-M": "OpenRAIL",
    "licensed GPLv2": "GPL-2.0", "BSD 2-clause? the two-clause BSD license": "BSD-2-Clause", "CC0 1.0 Universal": "CC0-1.0", "WTFPL": "WTFPL", "Tcl/Tk license": "TCL", "released into the public domain": "public-domain", "For non-commercial use only": "noncommercial", "Unauthorized copying of this file": "proprietary",
}
NOTICES = list(LABELLED)


def test_signatures(spark):
    texts = dict(enumerate(NOTICES))
    found = {r.doc_id: r.labels for r in licenses.scan(documents(spark, list(texts.items()))).collect()}
    assert {t: LABELLED[t] in found[k] for k, t in texts.items()} == dict.fromkeys(NOTICES, True)
    assert len(licenses.SIGNATURES) > 90 and all(licenses.always(x) for _, _, x in licenses.SIGNATURES)
    clean = "the terms of trade under which a user may copy a program; public domains, ruby licence plates and a license to drive"
    assert licenses.scan(documents(spark, [(1, clean)])).first().labels == []


def brute_detections(text):
    """Every rule with Python's regexes on every text; of overlapping ones all pairs are compared."""
    found = []
    for r in licenses.rules():
        found += [(m.start(), m.end(), r.priority, r.label) for m in re.finditer(r.regex, text, re.ASCII)]
    better = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and e[1] - e[0] > d[1] - d[0])
    left = sorted({(d[0], d[1], d[3]) for d in found if not any(better(d, e) for e in found)})
    places = [d for d in found if d[3] in licenses.BASE.values()]
    n = len(places) + sum(d[2] not in licenses.BASE.values() for d in left)
    return left, sorted({d[2] for d in left} | {d[3] for d in places}), n / (n + 1)


def test_licenses_equal_brute_force(spark):
    rng = np.random.default_rng(31)
    parts = [f"{name} {v}" for name, versions in list(licenses.FAMILIES.values())[:14] for v in ("", *(f"version {x}" for x in versions.split()))]
    parts += [*licenses.SENTENCES.values(), *licenses.BASE, "SPDX-License-Identifier: GPL-2.0-or-later", "spdx license identifier: MIT", "CC BY-SA 4.0", "creative commons attribution", "creativecommons.org/licenses/by-nc/2.0", "license", "plain", "\u00e9t\u00e9", "mit", "all rights reserved"]
    parts += NOTICES
    texts = [str(rng.choice([" ", "\n", ", "])).join(str(x) if rng.random() < 0.7 else str(x).upper() for x in rng.choice(parts, int(rng.integers(0, 9)))) for _ in range(150)]
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        left, labels, score = brute_detections(t)
        assert ([tuple(d) for d in rows[k].detections], rows[k].labels, rows[k].score) == (left, labels, pytest.approx(score)), t
    assert sum(len(r.detections) > 2 for r in rows.values()) > 50


def test_long_texts_with_many_licenses(spark):
    n = 80_000
    rows = licenses.scan(documents(spark, [(1, "mit license " * n), (2, "x" * 2_000_000 + " apache license"), (3, "word " * 300_000)])).collect()
    found = {r.doc_id: r for r in rows}
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].last_word, found[1].labels) == (2 * n, n, 0, 2 * n - 2, ["MIT", "mit"])
    assert len(found[1].detections) == 2 * n and found[2].labels == ["Apache", "apache"] and found[2].first_word == 1 and found[3].labels == []


# ---- urls


def test_hosts_paths_and_rules(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    cases = {
        "http://a.Example.COM/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/2": ("notexample.com", "/en/2", "com/", "allow"), "http://x.net/es/3#a": ("x.net", "/es/3", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"), "http://x.com?/a": ("x.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://É.com/a\nb": ("É.com", "/a\nb", "com/", "allow"),
    }
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(cases)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in urls.filter_urls(df, rules).collect()}
    for k, want in enumerate(cases.values()):
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == want
    assert urls.filter_urls(df.limit(0), rules).collect() == []
    assert urls.filter_urls(df.unionAll(df), rules).count() == 2 * len(cases)


def brute_templates(rows, depth=3):
    """leaf to (template, purity): the tree in plain Python; ``rows`` are (host, segments, blocked or None)."""

    def totals(own):
        return len(own), sum(x[2] is not None for x in own), sum(x[2] is True for x in own)

    def smooth(own, above):
        return (totals(own)[2] + 5 * above) / (totals(own)[1] + 5)

    def sides(branches):
        side = dict.fromkeys(branches, "")
        while True:
            step = {}
            for v, own in branches.items():
                others = [x for w in branches if w != v and side[w] == side[v] for x in branches[w]]
                (_, m, h), (_, om, oh) = totals(own), totals(others)
                if not m or not om:
                    continue
                share = (h + oh) / (m + om)
                error = (share * (1 - share) * (1 / m + 1 / om)) ** 0.5
                apart = h / m - oh / om
                if apart and abs(apart) >= 1.96 * error:
                    step[v] = "+" if apart > 0 else "-"
            if not step:
                return side
            side = {v: x + step.get(v, "") for v, x in side.items()}

    _, labelled, hits = totals(rows)
    nodes = {}
    for x in rows:
        nodes.setdefault(x[0], []).append(x)
    nodes = {h: (own, smooth(own, (hits + 1) / (labelled + 2))) for h, own in nodes.items()}
    out, k = {}, 0
    while nodes:
        below = {}
        for node, (own, purity) in nodes.items():
            n, m, h = totals(own)
            if k >= depth and not (0 < h < m and any(len(x[1]) > k for x in own)):
                out |= {"/".join([x[0], *x[1]]): (node, purity) for x in own}
                continue
            values, branches = {}, {}
            for x in own:
                values.setdefault(x[1][k] if k < len(x[1]) else "", []).append(x)
            for v, part in values.items():
                rare = len(part) < 0.02 * n and totals(part)[1] < 5
                branches.setdefault("*" if rare else v, []).extend(part)
            side = sides(branches)
            for s in set(side.values()):
                alike = [v for v in branches if side[v] == s]
                part = [x for v in alike for x in branches[v]]
                name = alike[0] if len(alike) == 1 and alike[0] != "*" else "*" + s
                below[f"{node}/{name}"] = (part, purity if totals(part)[1] == m else smooth(part, purity))
        nodes, k = below, k + 1
    return out


def random_urls(seed, hosts=8, n=400):
    """Hosts with sections that are bad or fine, labelled at random, some sections not at all."""
    rng, rows = np.random.default_rng(seed), []
    for h in range(hosts):
        bad = {(a, b): bool(rng.random() < (0.9 if h % 4 == 0 else 0.3)) for a in range(4) for b in range(3)}
        for k in range(n if h else 4 * n):
            a, b = int(rng.integers(0, 4)), int(rng.integers(0, 3))
            known = rng.random() < 0.6 and (a, b) != (0, h % 3)
            deep = [f"t{int(rng.integers(0, 40))}"] if b == 2 else []
            label = bool(bad[a, b] ^ (rng.random() < 0.03)) if known else None
            rows.append((f"h{h}", [f"a{a}", f"b{b}", *deep, "*" if rng.random() < 0.9 else f"x{int(rng.integers(0, 5))}"], label, bad[a, b]))
    return rows


def test_templates_equal_brute_force(spark):
    rows = random_urls(1)
    data = [(h, *(s + ["", ""])[:3], s[3:], x) for h, s, x, _ in rows]
    df = spark.createDataFrame(data, "host string, s0 string, s1 string, s2 string, rest array<string>, blocked boolean")
    found = {r.leaf: (r.template, round(r.purity, 9)) for r in urls.templates(df, Scratch(spark, "t")).collect()}
    want = brute_templates([(h, (s + ["", ""])[: max(3, len(s))], x) for h, s, x, _ in rows])
    assert found == {k: (t, round(p, 9)) for k, (t, p) in want.items()}
    unknown = [(found["/".join([h, *(s + ["", ""])[: max(3, len(s))]])][1] >= 0.9, truth) for h, s, x, truth in rows if x is None]
    caught = [truth for rejected, truth in unknown if rejected]
    assert len(caught) > 100 and np.mean(caught) > 0.85, (len(caught), np.mean(caught))


def test_urls_without_a_rule_follow_their_host(spark):
    rules = [("allow", "com/"), ("block", "net/es/"), ("block", "net/fr/"), ("block", "a.com/en/")]
    rows = [(f"{h}/{lang}/{k}", want) for h, lang, want in [("x.net", "es", "block"), ("x.net", "fr", "block"), ("x.net", "de", "block"), ("y.org", "de", "allow"), ("a.com", "en", "block"), ("a.com", "fr", "allow")] for k in range(60)]
    rows += [(f"z.net/{lang}/{k}", want) for lang, want in [("es", "block"), ("de", "allow")] for k in range(3)]
    df = spark.createDataFrame([(k, f"http://{u}") for k, (u, _) in enumerate(rows)], "page_id long, url string")
    found = {r.page_id: r for r in urls.filter_urls(df, rules).collect()}
    assert [found[k].verdict for k in range(len(rows))] == [want for _, want in rows]
    assert {r.rule for r in found.values() if r.host == "x.net" and "/de/" in r.path} == {None}
    strict = urls.filter_urls(df, rules, purity=1.0).collect()
    assert {r.verdict for r in strict if r.rule is None} == {"allow"}
    # rows that repeat, null ids, long urls; two rules of one length
    odd = spark.createDataFrame([(None, "http://ab.net/q/1"), (None, None), (1, "http://ab.net/q/1"), (1, "http://ab.net/q/1"), (2, "http://h.net/" + "s/" * 30_000)], "page_id long, url string")
    found = urls.filter_urls(odd, [("allow", "ab.net/q/"), ("block", "b.net/q/1"), ("block", "ab.net/q/")]).collect()
    assert sorted((str(r.page_id), r.verdict) for r in found) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "allow"), ("None", "block")]
    tied = urls.filter_urls(spark.createDataFrame([(1, "http://x.yy.net/abc")], "page_id long, url string"), [("block", "yy.net/ab"), ("allow", "x.yy.net/")]).first()
    assert (tied.rule, tied.verdict) == ("yy.net/ab", "block")


def test_templates(spark):
    rows = [("h", "shop", f"item{k}", "", True) for k in range(200)] + [("h", "news", f"story{k}", "", False) for k in range(200)] + [("h", "blog", "x", "", None)] * 100
    rows += [("g", f"{s}", "*", "", k % 10 != 0) for s in ("a", "b") for k in range(100)]
    df = spark.createDataFrame(rows, "host string, s0 string, s1 string, s2 string, blocked boolean")
    found = {r.leaf: r for r in urls.templates(df, Scratch(spark, "t")).collect()}
    assert found["h/shop/item7/"].template == "h/shop/*/"
    assert found["h/shop/item7/"].rejected and not found["h/news/story7/"].rejected and not found["h/blog/x/"].rejected
    assert found["g/a/*/"].template == found["g/b/*/"].template  # alike, so merged


def test_templates_of_deep_and_wide_hosts(spark):
    paths = [(f"deep/{a}/{b}/x{k}", b == "spam") for a in ("p", "q") for b in ("spam", "good") for k in range(60)]
    paths += [(f"far/a/b/c/{d}/{k}/end", d == "bad") for d in ("bad", "fine") for k in range(60)]
    paths += [(f"wide/s{k % 100}/y{k}", k % 100 == 7) for k in range(6000)]
    rules = [("block", "h.com/deep/p/spam/"), ("block", "h.com/far/a/b/c/bad/"), ("block", "h.com/wide/s7/"), ("allow", "h.com/")]
    rows = [(k, f"http://h.com/{p}", bad) for k, (p, bad) in enumerate(paths)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    found = {r.page_id: r for r in urls.filter_urls(df, rules).collect()}
    own = lambda begin: {found[k].template for k, u, _ in rows if u.startswith(f"http://h.com/{begin}/")}
    for one, other in (("deep/p/spam", "deep/p/good"), ("far/a/b/c/bad", "far/a/b/c/fine"), ("wide/s7", "wide/s8")):
        assert own(one) and not own(one) & own(other), one
    parts = spark.createDataFrame([("h", *u.split("/")[3:6], u.split("/")[6:], bad) for _, u, bad in rows], "host string, s0 string, s1 string, s2 string, rest array<string>, blocked boolean")
    rejected = {r.leaf: r.rejected for r in urls.templates(parts, Scratch(spark, "t")).collect()}
    assert all(rejected["h/" + u.split("h.com/")[1]] == bad for _, u, bad in rows)


# ---- resampling


def test_resampling(spark):
    rng = np.random.default_rng(5)
    good = [(k, prose(rng, 60, 80)) for k in range(100)]
    junk = [(1000 + k, " ".join(f"j{x}" for x in rng.integers(0, 30, 60))) for k in range(50)]
    rows = good + junk + [(5000, None), (5001, ""), (5002, good[0][1]), (None, good[1][1])]
    docs, targets = documents(spark, rows), spark.createDataFrame([(k,) for k in [*range(0, 100, 2), None, 0]], "doc_id long")
    weights = {r.doc_id: r.log_weight for r in resample.weigh(docs, targets).collect()}
    assert min(weights[i] for i, _ in good) > max(weights[i] for i, _ in junk)
    assert weights[5000] is None and weights[5001] is None and weights[5002] == pytest.approx(weights[0])
    found = resample.select(docs, targets, keep=0.5).collect()
    assert len(found) == len(rows)
    keys = sorted((r.key for r in found if r.key is not None), reverse=True)
    border = keys[round(0.5 * len(rows)) - 1]
    assert {r.doc_id for r in found if r.selected} == {r.doc_id for r in found if r.key is not None and r.key >= border}
    assert not any(r.selected for r in found if r.doc_id in (5000, 5001, None))
    assert found == resample.select(docs, targets, keep=0.5).collect()
    none = resample.select(docs, targets.limit(0)).collect()
    assert {r.log_weight for r in none} == {0.0, None}
    assert resample.select(docs.limit(0), targets).collect() == []


def test_weights_equal_brute_force(spark):
    from shopstream.llm.words import SPACED, chunks
    import pyarrow as pa

    rng = np.random.default_rng(6)
    texts = [prose(rng, int(n), 50) for n in rng.integers(1, 80, 30)] + ["W1 w1", "long " * 60_000]
    df, targets = documents(spark, list(enumerate(texts))), spark.createDataFrame([(k,) for k in range(10)], "doc_id long")
    # a bucket is the hash of a word or of a pair of words; counting and weighing is done in plain Python
    grams = []
    for t in texts:
        (c,) = chunks(pa.array([t]), SPACED, lower=True)
        grams.append([int(h) % resample.BUCKETS for h in [*c.hashes, *c.windows(2)[0]]])
    raw, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for k, own in enumerate(grams):
        for g in own:
            raw[g] += 1
            target[g] += k < 10
    want = {k: sum(np.log(target[g] / target.sum()) - np.log(raw[g] / raw.sum()) for g in own) for k, own in enumerate(grams)}
    found = {r.doc_id: r.log_weight for r in resample.weigh(df, targets).collect()}
    assert found == pytest.approx(want)
    mean = {r.doc_id: r.log_weight for r in resample.weigh(df, targets, per_grams=100).collect()}
    assert mean == pytest.approx({k: 100 * x / len(grams[k]) for k, x in want.items()})


@pytest.mark.parametrize("k", [0, 1, 17, 3000, 4999, 5000, 9000])
def test_kth_largest(spark, k):
    values = np.round(np.random.default_rng(7).standard_normal(5000) ** 3, 2).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "key double")
    assert resample._kth_largest(df, k) == (None if k == 0 else sorted(values, reverse=True)[min(k, 5000) - 1])


def test_planted_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = resample.select(docs, labels.where("quality = 1 and toxic = 0")).join(labels, "doc_id").collect()
    bad = [r.selected for r in found if r.quality == 0]
    good = [r.selected for r in found if r.quality == 1 and r.key is not None]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5
