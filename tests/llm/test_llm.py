"""Operators of the llm subpackage against brute force on small fixtures and odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import chat, decontaminate, language, licenses, packing, quality, segments, simhash, token_counts, token_files, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, fp string, doc string, kept boolean, word string"


def texts(n=60, seed=1):
    rng = np.random.default_rng(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "re", "su") for b in ("x", "ya", "zo", "", "tu")]
    out = [" ".join(rng.choice(vocab, int(rng.integers(1, 120)))) for _ in range(n)]
    return [*out, out[0], out[0], out[1] + " tail", "", "   ", "é ü " * 40, "Line one\nLine one\n\nx", "a" * 5000, " ".join(out[:20])]


@pytest.fixture(scope="module")
def docs(spark):
    ts = texts()
    rows = [(k, t, "aa" if k % 2 else "bb", f"s{k % 3}", len(t), "x", "y", "z", True, "w") for k, t in enumerate(ts)]
    rows += [(900, None, None, None, None, None, None, None, None, None), (None, ts[0], None, "s1", 1, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_segments_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(segments.default_path())
    t.encode_special_tokens = True
    e = segments.SegmentEncoder(segments.default_path(), cached=50, together=300)
    odd = ["", " ", "a  b", " a", "a ", "a\nb", "a\n b", "don't, it's. x!?", "\r\n x", "é ñ, ", "<|endoftext|> a", "x\x1c y", "1,2. 3", "b, \nc d", "漢字 かな, x", "a​ b"]
    for text in [*odd, *texts(), *texts(seed=3)]:
        assert e.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert e.encode(None).tolist() == []
    # plain and odd texts of one call, in order
    many = [None, *odd, "a  b", *texts(seed=4), "", "x, y", "\n", "q\u2003r, s.", "'s 't,", "ñ, Éa. ×, 5, a5, _a."]
    for whole in (1 << 23, 40):
        e = segments.SegmentEncoder(segments.default_path(), cached=30, together=whole)
        for _ in range(2):
            got = [x.tolist() for x in e.encode_many(many)]
            assert got == [t.encode(x or "", add_special_tokens=False).ids for x in many]


def test_packing(spark, docs, empty):
    got = packing.pack(docs).collect()
    e = segments.SegmentEncoder(segments.default_path())
    want = {(d, t): np.r_[e.encode(t), 0].astype("<u4") for d, t in rows_of(docs)}
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    unique = {d: ids for (d, _), ids in want.items() if d not in (0,)}
    for d, ids in unique.items():
        at = 0
        for p in sorted((r for r in got if r.doc_id == d), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert packing.pack(empty).count() == 0


def test_token_files(docs, empty):
    got = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    e, at = segments.SegmentEncoder(segments.default_path()), 0
    want = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (d, t) in zip(got, want, strict=True):
        ids = np.r_[e.encode(t), 2].astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.round_trip(empty).count() == 0


def test_blocks_decode_at_random():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 9, int(n)).astype("<u4") for n in rng.integers(1, 400, 50)] + [np.array([7] * 1000, "<u4"), np.array([1], "<u4")]
    b = token_files.Shard(token_files.to_shard(list(range(len(ids))), ids, before=3, least=4))
    assert len(b.left) and b.before == 3
    for k in (51, 0, 17, 50, 3):
        assert b.ids(k).tolist() == ids[k].tolist()
    assert b.ids(0, len(ids)).tolist() == np.concatenate(ids).tolist()


def test_token_counts(docs, empty):
    scores = token_counts.piece_scores(token_counts.default_path())
    floor = min(scores.values()) - 10

    def brute(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            options = [(best[i - 1][0] + n * floor, best[i - 1][1] + n)]
            options += [(best[j][0] + scores[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in scores]
            best.append(max(options, key=lambda o: (o[0], -o[1])))
        return best[-1][1]

    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in token_counts.token_counts(docs).collect()}
    for d, t in rows_of(docs):
        words = (t or "").split()
        if all(len(w) < 200 for w in words):
            assert got[d, len(words)] == sum(brute("▁" + w) for w in words)
    assert token_counts.token_counts(empty).count() == 0


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(n, links):
    label = list(range(n))
    for a, b in links:
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    return label


def test_simhash(docs, empty):
    rows = rows_of(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    label = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {c: min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label)}
    want = sorted((str(rows[k][0]), f"{fps[k]:016x}", least[label[k]]) for k in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("shard_size", [5, 20_000])
def test_links_lose_nothing(spark, shard_size, monkeypatch):
    monkeypatch.setattr(simhash, "SEARCH_BYTES", 1 << 9 if shard_size == 5 else 1 << 22)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    fps = np.unique(np.concatenate([base, flip(base), flip(flip(base)), flip(flip(flip(base)))]))
    label = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if int(fps[a] ^ fps[b]).bit_count() <= 2])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df, 2, shard_size)).collect()}
    signed = fps.view(np.int64).tolist()
    got = [root.get(x, x) for x in signed]
    assert all((got[a] == got[b]) == (label[a] == label[b]) for a in range(len(fps)) for b in range(a))


def jaccard(a, b):
    x, y = (({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, int(n))] for n in rng.integers(60, 900, 25)]
    ts = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 2, len(w) // 60, len(w) // 8):
            other = list(w)
            for at in rng.integers(0, len(w), edits):
                other[at] = "new"
            ts.append(" ".join(other))
    ts.append(ts[0] + " " + " ".join(base[1]) + " " + " ".join(base[2]))
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    near = [(a, b, jaccard(ts[a], ts[b])) for a in range(len(ts)) for b in range(a)]
    assert all(got[a] == got[b] for a, b, j in near if j >= 0.83)
    apart = components(len(ts), [(a, b) for a, b, j in near if j >= 0.55])
    assert all(apart[a] == apart[b] for a in range(len(ts)) for b in range(a) if got[a] == got[b])
    # odd rows: equal words are one group, each row is returned, a null id never is the least
    odd = [(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()]
    assert len(odd) == docs.count() and (None, 0) in odd and (60, 0) in odd and (64, 63) in odd and (900, 63) in odd
    assert simhash.near_copies(empty).count() == 0


def test_rows_that_stay(spark):
    w = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcde"]
    rows = [(5, w[0]), (3, w[0]), (3, w[0]), (3, w[1]), (None, w[1]), (None, w[2]), (None, w[2]), (9, w[3] + " x"), (9, w[3]), (7, w[4]), (8, None), (None, None), (2, "")]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.first) for r in got) == sorted(
        [("5", "3", False), ("3", "3", True), ("3", "3", True), ("3", "3", True), ("None", "3", False), ("None", "None", True), ("None", "None", True), ("7", "7", True), ("8", "2", False), ("None", "2", False), ("2", "2", True)]
        + [("9", "9", got_first) for got_first in (True, False)]
    )


def test_candidates_in_parts(spark):
    rng = np.random.default_rng(12)
    base, ts = [f"w{x}" for x in range(200)], []
    for k in range(120):
        other = list(base)
        # two families within a candidate component, and copies of each
        for at in ([0, 50, 100, 150] if k % 2 else []) + [int(rng.integers(200))]:
            other[at] = f"n{k % 2}" if at in (0, 50, 100, 150) else f"m{rng.integers(1 << 30)}"
        ts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(ts)), "id long, text string")
    keys = docs.withColumn("txt", simhash.text_key(F.col("text")))
    made = [(k, *simhash.long_fingerprint(t)) for k, t in enumerate(ts)]
    names = ", ".join(["id long", "same long", *[f"f{k} long" for k in range(simhash.WORDS)]])
    rows = [(k, *np.r_[np.uint64(s), f].astype(np.uint64).view(np.int64).tolist()) for k, s, f, _ in made]
    classes = spark.createDataFrame(rows, names).join(keys.select("id", "txt"), "id").withColumn("least", F.struct("id", "txt")).selectExpr("same", "named_struct('doc_id', least.id, 'txt', least.txt) least", *[f"f{k}" for k in range(simhash.WORDS)])
    least = min(r[1] for r in rows)
    roots = spark.createDataFrame([(r[1], least) for r in rows if r[1] != least], "same long, root long")
    found = {}
    for group in (16, 4096):
        edges = simhash._verified(keys, classes, roots, 5, 0.8, group)
        root = {r.node: r.root for r in simhash.components(edges).collect()}
        found[group] = [root.get(r[1], r[1]) for r in rows]
    label = components(len(ts), [(a, b) for a in range(len(ts)) for b in range(a) if jaccard(ts[a], ts[b]) >= 0.8])
    for got in found.values():
        assert all((got[a] == got[b]) == (label[a] == label[b]) for a in range(len(ts)) for b in range(a))


def test_large_group_of_near_copies_hangs_together(spark):
    rng = np.random.default_rng(6)
    base, ts = [f"w{x}" for x in range(200)], []
    for _ in range(400):
        other = list(base)
        other[int(rng.integers(200))] = f"n{rng.integers(1 << 30)}"
        ts.append(" ".join(other))
    names = ", ".join(["same long", *[f"f{k} long" for k in range(simhash.WORDS)], *[f"k{k} long" for k in range(simhash.KEYS)]])
    made = [simhash.long_fingerprint(t) for t in ts]
    rows = [tuple(np.r_[np.uint64(s), f, k].astype(np.uint64).view(np.int64).tolist()) for s, f, k in made]
    edges = simhash.copy_links(spark.createDataFrame(rows, names), piece=40, leaders=16)
    assert edges.count() <= 6 * 12 * 60
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({root.get(r[0], r[0]) for r in rows}) == 1


def test_pairs_within_a_frequent_passage(spark):
    rng = np.random.default_rng(8)
    passage, ts = [f"p{x}" for x in range(150)], []
    for k in range(300):
        own = [f"o{k}w{x}" for x in range(150)]
        ts.append(" ".join(passage + own))
        if k % 10 == 0:
            ts.append(" ".join(passage + own[:-8] + [f"e{x}" for x in rng.integers(1 << 30, size=8)]))
    names = ", ".join(["same long", *[f"f{k} long" for k in range(simhash.WORDS)], *[f"k{k} long" for k in range(simhash.KEYS)]])
    # all of the least shingles are in the passage
    made = [(s, f) for s, f, _ in map(simhash.long_fingerprint, ts)]
    rows = [tuple(np.r_[np.uint64(s), f, np.arange(simhash.KEYS, dtype=np.uint64)].astype(np.uint64).view(np.int64).tolist()) for s, f in made]
    edges = simhash.copy_links(spark.createDataFrame(rows, names), piece=20, leaders=2)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    got = [root.get(r[0], r[0]) for r in rows]
    label = components(len(ts), [(a + 1, a) for a in range(len(ts) - 1) if jaccard(ts[a], ts[a + 1]) >= 0.8])
    assert len(ts) - len(set(label)) == 30 and all((got[a] == got[b]) == (label[a] == label[b]) for a in range(len(ts)) for b in range(a))


def test_near_copies_are_linked_by_their_exact_similarity(spark):
    rng, ts = np.random.default_rng(9), []
    for k in range(60):
        w = [f"b{k}w{x}" for x in range(150)]
        # runs of changed words: similarities from 0.9 to 0.6
        ts += [" ".join(w), " ".join(w[: 150 - 4 - k // 2] + [f"n{x}" for x in rng.integers(1 << 30, size=4 + k // 2)])]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")).collect()}
    wrong = [k for k in range(60) if (got[2 * k] == got[2 * k + 1]) != (jaccard(ts[2 * k], ts[2 * k + 1]) >= 0.8)]
    assert not wrong


def test_quality(docs, empty):
    import re

    got = {}
    for r in quality.quality_rules(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows_of(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[d][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_bad_hosts_go(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good, "good") for k in range(50)] + [(100 + k, "short", "bad") for k in range(95)] + [(300, good, "bad")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] and not got[300]


def test_licenses(spark, empty):
    s = licenses.SENTENCES
    full = f"{s['mit-grant']}:\n{s['mit-notice']}. {s['as-is']}."
    rows = [(1, full), (2, "Intro. Released under the MIT License. Licensed under the Apache License, Version 2.0."), (3, "nothing"), (4, None), (5, ""), (6, "x " * 50_000 + "\n" + s["gpl-3-short"]), (6, full)]
    got = sorted((r.doc_id, r.n_sentences, r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 3, ["MIT"]), (2, 2, ["MIT", "Apache-2.0"]), (3, 0, []), (4, 0, []), (5, 0, []), (6, 1, ["GPL-3.0-only"]), (6, 3, ["MIT"])]
    assert licenses.license_scan(empty).count() == 0


def test_true_license_texts(spark):
    mit = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"""
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software"""
    bsd = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
    bsd3 = bsd + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version %d of the License, or
 * (at your option) any later version.
 *"""
    want = [(mit, ["MIT"]), (apache, ["Apache-2.0"]), (bsd, ["BSD-2-Clause"]), (bsd3, ["BSD-3-Clause"]), (gpl % 3, ["GPL-3.0-or-later"]), (gpl % 2, ["GPL-2.0-or-later"]), ("A page. All rights reserved.", ["all-rights-reserved"]), ("all rights\r\nreserved", ["all-rights-reserved"]), ("all rights. reserved all rights\n\nreserved", []), ("a line\nLicensed under\nCC BY 4.0\nmore", ["CC-BY-4.0"])]
    lgpl = """// This library is free software; you can redistribute it and/or
// modify it under the terms of the GNU Lesser General Public
// License as published by the Free Software Foundation; either
// version 2.1 of the License, or (at your option) any later version.
//
// All rights reserved. Licensed under the MIT License."""
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
    agpl = gpl.replace("General Public License", "Affero General Public License") % 3
    want += [(lgpl, ["LGPL-2.1-or-later", "MIT", "all-rights-reserved"]), (mpl, ["MPL-2.0"]), (isc, ["ISC"]), (agpl, ["AGPL-3.0-or-later"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike\n4.0 International License.", ["CC-BY-SA-4.0"])]
    want += [(t.replace("\n", "\r\n"), found) for t, found in want[:6]]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(df).collect()}
    assert [got[k] for k in range(len(want))] == [found for _, found in want]
    # the registered SQL reads the same texts
    import duckdb

    from siftlake.llm import sql

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, t) for k, (t, _) in enumerate(want)])
    names = con.execute(sql.ORACLE_SQL["op3_license_scan"]).fetchall()
    assert {r[0]: r[3] for r in names} == {k: ",".join(found) for k, found in got.items()}


def test_urls(spark):
    rows = [(1, "http://A.example.com/en/1"), (2, "https://www.example.com/en/x?q"), (3, "http://x.net/es/1#a"), (4, "http://x.net/en/1"), (5, None), (6, "no scheme"), (7, "http://b.com"), (8, "http://b.com/"), (None, "http://x.net/fr/2"), (1, "http://A.example.com/en/1")]
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1, "a.example.com"] == ("/en/1", "example.com/en/", "block") and got[2, "www.example.com"] == ("/en/x", "www.example.com/en/", "allow")
    assert got[3, "x.net"] == ("/es/1", "net/es/", "block") and got[7, "b.com"][:2] == ("", None) and got[8, "b.com"] == ("/", "com/", "allow")
    assert got[5, ""][:2] == ("", None) and got[6, ""][:2] == ("", None) and got[None, "x.net"][1] == "net/fr/"
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0


def test_tree_rejects_by_purity(spark):
    rows = [(k, f"http://h.org/bad/{k}", True) for k in range(30)] + [(100 + k, f"http://h.org/good/{k}", False) for k in range(30)] + [(200, "http://h.org/bad/999", None), (201, "http://h.org/good/999", None)]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, label boolean"), label_col="label").collect()}
    assert got[200] == "block" and got[201] == "allow"


def test_labelled_branches_stay_apart_at_any_fan_out(spark):
    rows = [(k, f"http://a.com/x/{k}") for k in range(200)] + [(1000 + k, f"http://x.net/{x}/{k}") for k in range(30) for x in ("es", "fr")]
    rows += [(2000 + k, f"http://x.net/{chr(97 + k)}{chr(97 + k)}/{k}") for k in range(25)]
    got = {r.page_id: (r.verdict, r.template) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[2000 + k][0] == "allow" and got[2000 + k][1] not in (got[1000][1], got[1001][1]) for k in range(25))
    assert len({got[2000 + k][1] for k in range(25)}) == 1


def test_verdicts_back_off_where_there_are_no_labels(spark):
    # labelled: /ads/ of many hosts is bad and /news/ good; every host of bad.org is bad; the rest is good
    rows = [(k, f"http://h{k % 7}.{'info' if k % 2 else 'org'}/{'ads' if k % 3 == 0 else 'news'}/{k}", k % 3 == 0) for k in range(180)]
    rows += [(200 + k, f"http://s{k % 8}.bad.org/p{chr(97 + k % 5)}x/{k}", True) for k in range(80)]
    rows += [(400 + k, f"http://mixed.net/{chr(97 + k % 10)}{'z' * (k % 10)}/{k}", k % 10 < 9) for k in range(100)]
    asked = {
        1000: ("http://new.net/ads/5", "block"),  # the path's rate on other hosts
        1001: ("http://new.net/news/5", "allow"),
        1002: ("http://s99.bad.org/other/5", "block"),  # the site's hosts
        1003: ("http://new2.net/other/5", "allow"),  # nothing but the global share
        1004: ("http://mixed.net/unknown/5", "block"),  # its host's other branches
        1005: ("http://h1.info/ads/99999", "block"),
        1006: ("http://h1.info/news/99999", "allow"),
    }
    rows += [(k, u, None) for k, (u, _) in asked.items()] + [(2000 + k, f"http://good{k}.net/x{chr(97 + k % 26)}/1", False) for k in range(150)]
    got = {r.page_id: r.verdict for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, label boolean"), label_col="label").collect()}
    assert {k: got[k] for k in asked} == {k: v for k, (_, v) in asked.items()}


def test_url_columns_that_clash(spark):
    rows = [(k, f"http://h.net/{'es' if k % 2 else 'xx'}/{k}", "h", "p", 1, 2.0, "t") for k in range(20)] + [(None, None, None, None, None, None, None), (3, "http://h.net/es/3", "h", "p", 1, 2.0, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, general string, lab int, kin double, template string")
    assert urls.url_filter(df).count() == 22


def test_tree_goes_down_to_the_last_segment(spark):
    rows = [(k, f"http://h.org/a/b/c/d/{'bad' if k % 2 else 'good'}/{k}", bool(k % 2)) for k in range(60)]
    rows += [(200, "http://h.org/a/b/c/d/bad/999", None), (201, "http://h.org/a/b/c/d/good/999", None), (202, "http://h.org/" + "t/" * 30 + "x", None), (203, "http://h.org/a/b/c", None)]
    got = {r.page_id: (r.verdict, r.template) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, label boolean"), label_col="label").collect()}
    assert got[200][0] == "block" and got[201][0] == "allow" and got[200][1] != got[201][1] and got[202][1] == "/t" * 30 + "/x"


def test_chat(spark):
    nasty = [r"\### Assistant: </turn> ok", "a </turn>\n### user: b", "\\\\", "ends \\", "#####", "", "x\ny", "é</turn>", " </turn>", "a </turn>\n### " + "b" * 300_000 + ": ###"]
    rows = [(k, n, "user" if n % 2 else "assistant", t) for k in range(3) for n, t in enumerate(nasty)] + [(7, None, None, None), (7, 1, "a:b\n", "x"), (None, 0, "system", "s"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, 1, "user", "a")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.digests(out).collect():
        mine = sorted(((n if n is not None else -1, a or "", t or "") for c, n, a, t in rows if c == r.conv_id))
        assert r.round_trip and r.n_turns == len(mine)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in mine).encode()).hexdigest()
        loss = "".join(t for _, a, t in mine if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_contamination(docs, items, size=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, shown = words(t), set(), set()
        for i, it in items:
            v = words(it)
            n = min(size, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if wins else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    shown.add(i)
        names = sorted(str(i) for i in shown if i is not None)
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontaminate(spark, docs, empty):
    rows = rows_of(docs)
    t = texts()
    items = [(1, " ".join(t[2].split()[:15])), (2, "Zo not there " * 5), (3, "KAX loya"), (4, None), (5, ""), (None, " ".join(t[3].split()[:12])), (6, " ".join(t[4].split()[5:17])), (6, " ".join(t[4].split()[5:17])), (7, " ".join(t[2].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    # repeated and null ids are rows of their own
    more = [(None, " ".join(t[2].split()[:8])), (None, " ".join(t[2].split()[8:])), (0, t[4]), (0, "kax"), (0, "loya x"), (5, t[2] + " " + t[2])]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(every, bench).collect())
    assert got == brute_contamination([*rows, *more], items)
    assert all(r[2] <= r[1] for r in got)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count()
    named = decontaminate.decontaminate(docs, bench, keep=("fp", "word"))
    assert named.columns[-2:] == ["fp", "word"] and named.where("word = 'w'").count() == docs.where("word = 'w'").count()


def test_joins_of_large_tables(spark, docs):
    t = texts()
    bench = spark.createDataFrame([(1, " ".join(t[2].split()[:15])), (2, "kax loya")], "item_id long, text string")
    wins = decontaminate.windows(bench)
    vocabulary = wins.select(F.explode("w").alias("word")).distinct()
    found = []
    for most in (0, 1000):
        index = decontaminate.build_index(docs, vocabulary, broadcast_rows=most)
        found.append(sorted(tuple(r) for r in decontaminate.phrase_matches(index, wins, 1, broadcast_rows=most).collect()))
    assert found[0] == found[1] and found[0]


def brute_near(text, window, slop):
    w, out = text.split(), set()
    count = lambda x: w.count(x)
    rare = min(range(len(window)), key=lambda k: (count(window[k]), k))
    for at in range(len(w)):
        start = at - rare
        if w[at] == window[rare] and all(any(0 <= start + k + d < len(w) and w[start + k + d] == x for d in range(-slop, slop + 1)) for k, x in enumerate(window)):
            out.add((start, all(0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(window))))
    return out


def test_proximity(spark):
    window = "aa bb cc dd ee".split()
    ts = ["aa bb qq cc dd ee", "aa bb cc dd ee", "bb aa cc dd ee", "aa bb q q cc dd ee", "ee dd cc bb aa", "x aa bb cc ee dd x aa bb cc dd ee", "aa bb cc dd", "q aa cc bb dd ee aa bb"]
    # each text has words of its own, so that the rarest term is the text's
    mine = lambda t, k: " ".join(f"{w}{k}" for w in t.split())
    own = [(k, mine(t, k)) for k, t in enumerate(ts)]
    wins = decontaminate.windows(spark.createDataFrame([(k, mine(" ".join(window), k)) for k in range(len(ts))], "item_id long, text string"))
    numbers = {r.win: r.item_id for r in wins.collect()}
    index = decontaminate.build_index(spark.createDataFrame(own, "doc_id long, text string").coalesce(1), wins.select(F.explode("w").alias("word")).distinct())
    rows = {r.row: r.of.doc_id for r in index.where("of is not null").collect()}
    for slop in (0, 1, 2):
        got = [set() for _ in ts]
        for r in decontaminate.phrase_matches(index, wins, slop).collect():
            assert rows[r.row] == numbers[r.win]
            got[rows[r.row]].add((r.start, r.exact))
        assert got == [brute_near(t, window, slop) for t in ts], slop
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, " ".join(window))], "item_id long, text string")).collect()}
    assert got[1] == (True, 0) and got[2] == (False, 1) and got[6] == (False, 0) and got[5] == (True, 0)


def test_language(spark, docs, empty):
    rng = np.random.default_rng(0)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["ch", "ei", "ung", "sch"], "cc": ["ció", "os", "que", "ñ"]}
    rows = [(k, make(kinds[lang]), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 5 <> 0"), per_language=50)
    held = language.predict(df.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97 and all(0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "x" * 600_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] in kinds
    assert language.predict(docs, language.fit(empty)).count() == docs.count() and language.predict(empty, model).count() == 0


def brute_subwords(text, buckets):
    """Bucket counts character by character."""
    out, c, mask = {}, [x if x.isalpha() else " " for x in text.lower()], (1 << 64) - 1
    for n in range(1, 5):
        for k in range(len(c) - n + 1):
            part, h = c[k : k + n], 0
            if part[0] == " " and part[-1] == " ":
                continue
            for m, x in enumerate(part):
                h = (h * 0x100000001B3 + ord(x) + m + 1) & mask
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
            out[(h >> 40) % buckets] = out.get((h >> 40) % buckets, 0) + 1
    return out


def test_predictions_by_brute_force(spark):
    rng = np.random.default_rng(4)
    ts = ["the ring on it, the er", "eine Schule und chß", "que ció, ñ os 12", "a", "é é é, ü", "x" * 50, "Tab\tand\nline"]
    rows = []
    for k, t in enumerate(ts * 6):
        for index, share, whole in language.views(t, 512):
            rows.append((index, share, k % 3, whole))
    embedding, weights, bias = language.learn(rows, 3, 512, 6, 3, 5.0, 4, 1)
    model = language.Model(["aa", "bb", "cc"], (embedding @ weights).astype(np.float32), bias, 0.7, 0.4)
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    for k, t in enumerate(ts):
        counts = brute_subwords(t, 512)
        mean = sum(embedding[b].astype(float) * n for b, n in counts.items()) / sum(counts.values())
        raw = (mean @ weights + bias) / 0.7
        p = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        assert got[k].lang_pred == model.languages[int(p.argmax())] and abs(got[k].score - p.max()) < 1e-4 and got[k].rejected == (p.max() < 0.4)


def test_sample_is_bounded_whatever_the_ids(spark):
    rows = [(None, "same text", "aa")] * 400 + [(7, f"t {k}", "bb") for k in range(400)] + [(k, None, "aa") for k in range(5)] + [(1, "the end " * 10 + "zz", None)]
    sample = language.labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50, 4000, "text", "lang", "doc_id", 512)
    counts = [sum(lang == x for lang, _ in sample) for x in ("aa", "bb")]
    assert all(35 <= n <= 50 for n in counts)
    # a text is learnt from whole
    long = "ab " * 30_000 + "ñç"
    whole = language.views(long, 512)[0]
    assert len(whole[0]) == len(brute_subwords(long, 512))


def test_subwords_across_chunks(monkeypatch):
    text = "aé ñb" * 700
    whole = language.subwords(text, 1 << 12)
    monkeypatch.setattr(language, "CHUNK", 100)
    cut = language.subwords(text, 1 << 12)
    assert (whole[0] == cut[0]).all() and whole[1] == cut[1] and math.isfinite(whole[0].sum())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    ts = [" ".join(f"{a}{k}w{j}" for j, a in enumerate("abcdefghij" * 6)) for k in range(30)]
    bench = [(1, " ".join(ts[3].split()[10:30]))]
    rows = [(k, t, "aa" if k % 2 else "bb", "s", len(t)) for k, t in enumerate(ts)] + [(100, ts[0], "aa", "s", 1), (101, "12 34", None, "s", 1), (102, "too short", "aa", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {3, 100, 101, 102} and len(ids) >= 27
    pieces = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert pieces == ids


def test_stages_tell_rows_apart(spark, tmp_path):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    bench = spark.createDataFrame([(1, " ".join(a.split()[5:25]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (None, a), (None, d), (None, d), (7, None), (8, "")]
    docs = spark.createDataFrame([(k, t, "aa", "s", n) for n, (k, t) in enumerate(rows)], schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("3", a), ("5", b), ("9", c), ("None", d)]
    assert [r.doc_id for r in kept.collect() if not r.text] == [7]
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert sorted(r.n_chars for r in clean.collect()) == [2, 3, 4, 6, 7, 8, 9] and clean.columns == docs.columns
    empty = docs.limit(0)
    assert not corpus_pipeline.near_duplicates(spark, empty, str(tmp_path)).count() and not corpus_pipeline.decontamination(spark, empty, str(tmp_path)).count()
