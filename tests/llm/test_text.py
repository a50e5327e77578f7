import hashlib
import math
import random
import time
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import regex as re
from tokenizers import Tokenizer

from panelweave.llm import bpe as B
from panelweave.llm import language_id as L
from panelweave.llm import license_scan as N
from panelweave.llm.bpe import WordBPE, bpe_round_trip
from panelweave.llm.token_counts import UnigramCounter, read_ranks, token_counts
from panelweave.llm.words import trie_walk

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens long"
ODD = ["", " ", "Hello <|endoftext|> World's <|startoftext|>x", "İstanbul ΑΣ σΣ. ǅ", "日本語 テスト😀😀 á ²½ ‍﻿", "x" * 3000, "ab" * 500 + "!!!???", "\x00\x01 \x85\xa0nb \x1c!\x1d? a\x1eb", "don't I'LL we'Ve", "e\u0301a\u0300 ẞ ﬃ Ⅷ ٣٤", "<|endoftext|><|ENDOFTEXT|>"]


def made(n=120, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabbccddeeiiooth'sre .,!éèüß0Σ\n") for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_trie_walk_enters_shared_prefixes_once():
    entered = []
    got = {w: s[-1] for w, s in trie_walk({"ab", "abc", "abd", "b", ""}, lambda p, s: entered.append("".join(p)) or len(p), 0)}
    assert got == {"ab": 2, "abc": 3, "abd": 3, "b": 1, "": 0}
    assert sorted(entered) == ["a", "ab", "abc", "abd", "b"]


def test_bpe_equals_library():
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordBPE(open(path, encoding="utf-8").read())
    texts = ODD + made()
    for _ in range(2):  # the second time from what is kept
        for text, (ids, n, decoded), enc in zip(texts, own.encode_batch(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids == " ".join(map(str, enc.ids)), text
            assert n == len(enc.ids) and decoded == lib.decode(enc.ids, skip_special_tokens=False)


def test_bpe_query_shape(spark):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    data = [(1, "Some text, twice.", "en", "s", 9), (1, "Some text, twice.", "en", "s", 9), (2, None, None, None, None), (None, "", None, None, None)]
    got = sorted(map(tuple, bpe_round_trip(spark.createDataFrame(data, SCHEMA), path).fillna(-1).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = lib.encode("Some text, twice.", add_special_tokens=False).ids
    one = (1, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert got == [(-1, 0, sha(""), sha("")), one, one, (2, 0, sha(""), sha(""))]
    assert bpe_round_trip(spark.createDataFrame([], SCHEMA), path).count() == 0


def viterbi(word: bytes, score: dict) -> int:
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j - 1, -1, -1):
            s = score.get(word[i:j])
            if s is not None and best[i][0] + s >= best[j][0]:
                best[j] = (best[i][0] + s, best[i][1] + 1)
    return best[-1][1]


def test_token_counts_against_plain_viterbi(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    counter = UnigramCounter(read_ranks(path), P.PATTERN)
    texts = ODD + made(40, 2)
    got = counter.count_batch(texts)
    for t, (n, m) in zip(texts, got, strict=True):
        words = counter.pattern.findall(t)
        assert (n, m) == (sum(viterbi(w.encode(), counter.score) for w in words), len(words))
    df = spark.createDataFrame([(1, "a b", None, None, 3), (2, None, None, None, None)], SCHEMA)
    assert sorted(map(tuple, token_counts(df, path, P.PATTERN).collect())) == [(1, 2, 2), (2, 0, 0)]
    assert token_counts(df.where("doc_id = 9"), path, P.PATTERN).count() == 0


def test_token_counts_of_a_very_long_word_take_linear_time():
    counter = UnigramCounter(read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    rng = random.Random(2)
    word = "".join(rng.choices("etaoinshr", k=1_000_000))
    began = time.process_time()
    [(n, m)] = counter.count_batch([word])
    assert time.process_time() - began < 30 and m == 1 and not counter.known
    assert counter.count_batch([word[:3000]])[0][0] == viterbi(word[:3000].encode(), counter.score)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    data = [(i, "the cat and the dog", "en", "s", 0) for i in range(40)] + [(100 + i, "le chat et le chien", "fr", "s", 0) for i in range(40)] + [(900, None, "en", "s", 0), (901, "12 !?", "en", "s", 0), (902, "", None, "s", 0), (903, "the the chien" * 5000, None, "s", 0), (904, "thecat", None, "s", 0)]
    got = {r["doc_id"]: r for r in L.identify_documents(spark.createDataFrame(data, SCHEMA)).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert got[3]["lang_pred"] == "en" and got[103]["lang_pred"] == "fr" and got[904]["lang_pred"] == "en"
    assert got[903]["lang_pred"] in ("en", "fr")
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify_documents(empty).count() == 0
    kept = L.keep_identified(spark.createDataFrame(data, SCHEMA))
    assert kept.count() == 82 and kept.columns == spark.createDataFrame(data, SCHEMA).columns
    assert L.keep_identified(spark.createDataFrame(data, SCHEMA), languages=("fr",)).count() in (40, 41)
    unlabelled = spark.createDataFrame([(1, "abc", None, None, 1)], SCHEMA)
    assert L.identify_documents(unlabelled).first()["lang_pred"] == "und"


def brute_language(docs):
    """(lang_pred, score) of each text, by plain counting over all labelled documents that are not held out."""
    runs = lambda t: re.findall(r"\p{L}+", t.lower())
    words, grams = {}, {}
    for i, t, lang, *_ in docs:
        if lang is None or t is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in runs(t):
            if len(w) <= 40:
                words.setdefault(lang, Counter())[w] += 1
            grams.setdefault(lang, Counter()).update(w[i : i + k] for i in range(len(w)) for k in range(1, 5) if i + k <= len(w))
    langs = sorted(grams)
    seen = Counter()
    for table in words.values():
        seen.update(table)
    words = {k: Counter({w: n for w, n in table.items() if seen[w] > 1}) for k, table in words.items()}
    logs = []
    for table in (words, grams):
        entries = set().union(*[table.get(k, {}) for k in langs])
        total = {k: sum(table.get(k, {}).values()) + 0.5 * len(entries) + 0.5 for k in langs}
        logs.append({e: [math.log((table.get(k, {}).get(e, 0) + 0.5) / total[k]) for k in langs] for e in entries})
    out = []
    for _, t, *_ in docs:
        sums = [0.0] * len(langs)
        for w in runs(t or ""):
            cover = [logs[0][w]] if w in logs[0] else []
            i = 0
            while not (w in logs[0]) and i < len(w):
                k = next((k for k in (4, 3, 2, 1) if i + k <= len(w) and w[i : i + k] in logs[1]), 0)
                cover += [logs[1][w[i : i + k]]] if k else []
                i += k or 1
            for x in cover:
                sums = [a + b for a, b in zip(sums, x, strict=True)]
        best = max(range(len(langs)), key=lambda j: sums[j])
        out.append((langs[best], 1 / sum(math.exp(max(s - sums[best], -700)) for s in sums)) if runs(t or "") else ("und", 0.0))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(4)
    some = {"en": "the cat and dog house running over there", "fr": "le chat et chien maison où ça élève", "zh": "猫和狗在房子里跑了很远的路今天天气很好", "ja": "猫と犬は家の中を走っていますきょうはいい天気"}
    data = []
    for lang in ("en", "fr"):
        data += [(len(data) + i, " ".join("".join(rng.sample(w, len(w))) if rng.random() < 0.3 else w for w in rng.choices(some[lang].split(), k=9)) + " ½ Ⅷ x2y", lang, "s", 0) for i in range(40)]
    for lang in ("zh", "ja"):  # runs of 60 letters and more, which are no words
        data += [(len(data) + i, "".join(rng.choices(some[lang], k=rng.randrange(60, 200))) + " 12", lang, None, None) for i in range(40)]
    data += [(900 + i, t, None, "s", 0) for i, t in enumerate(["½ ² 12", "Ⅷ", None, "", "zzzz qqq", "İstanbul ÇA ÉLÈVE", "猫" * 30_000, "the " * 20_000, "½the²cat"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify_documents(spark.createDataFrame(data, SCHEMA)).collect()}
    for (i, text, *_), (lang, score) in zip(data, brute_language(data), strict=True):
        assert got[i][0] == lang or abs(score - got[i][1]) < 1e-9, text
        assert got[i][1] == pytest.approx(score, abs=1e-9)
    assert [got[900 + i] for i in range(4)] == [("und", 0.0)] * 4
    assert all(got[i][0] == lang for i, _, lang, *_ in data if lang in ("zh", "ja"))


def test_language_stage_keeps_lettered_documents_without_labels(spark):
    data = [(i, "abc def", None, None, 1) for i in range(5)] + [(7, "12", None, None, 1), (8, None, None, None, 1)]
    assert L.keep_identified(spark.createDataFrame(data, SCHEMA)).count() == 5


def test_license_rules_in_order(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind."
    data = [(1, mit, None, None, 0), (2, "x. Licensed under the Apache License, Version 2.0. y", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, "licensed under the apache licens", None, None, 0), (6, "a. " * 50_000 + "Released under the MIT License.", None, None, 0), (6, "All rights reserved! Licensed under CC BY-NC 4.0.", None, None, 0)]
    got = {(r["doc_id"], r["n_sentences"]): r for r in N.license_scan(spark.createDataFrame(data, SCHEMA)).collect()}
    by = {k[0]: v for k, v in got.items() if k[0] != 6}
    assert by[1]["licenses"] == "MIT" and by[1]["sentence_ids"] == "mit.title mit.grant mit.notice as_is"
    assert by[2]["licenses"] == "Apache-2.0" and by[2]["n_sentences"] == 3
    assert [by[i]["licenses"] for i in (3, 4, 5)] == ["", "", ""] and by[3]["n_sentences"] == 0
    assert got[6, 50_001]["licenses"] == "MIT" and got[6, 2]["licenses"] == "CC-BY-NC-4.0|proprietary"
    assert N.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


MIT_TEXT = """The MIT License (MIT)

Copyright (c) 2020 Some Holder

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
APACHE_TEXT = """/*
 * Copyright 2020 Some Holder
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 */
"""
BSD_TEXT = """Copyright (c) 2020, Some Holder
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of Some Holder, Inc nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL3_TEXT = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
GPL2_TEXT = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""


def test_license_wrapped_and_abridged_texts(spark):
    texts = [MIT_TEXT, APACHE_TEXT, BSD_TEXT, GPL3_TEXT, GPL2_TEXT]
    texts += [t.replace("\n", "\r\n") for t in texts] + ["a line without a stop\n" * 300 + "All rights reserved"]
    got = {r["doc_id"]: r for r in N.license_scan(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i]["licenses"] for i in range(11)] == ["MIT", "Apache-2.0", "BSD-3-Clause|BSD-2-Clause", "GPL-3.0", "GPL-2.0|GPL"] * 2 + ["proprietary"]
    assert got[0]["sentence_ids"] == "mit.title2 mit.grant mit.notice as_is" and got[1]["sentence_ids"] == "apache.short apache.may_not apache.as_is"
    assert got[2]["sentence_ids"] == "bsd.grant bsd.no_endorse" and got[10]["n_sentences"] == 301


def test_license_headers_of_more_licences(spark):
    texts = {
        "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
        "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "Zlib": "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented;",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License.\n\n# SPDX-License-Identifier: GPL-3.0-or-later\n",
        "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "AGPL-3.0": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright",
        "CC-BY-NC-SA-4.0": "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "BSD-3-Clause": "// SPDX-License-Identifier: BSD-3-Clause\nint main();",
    }
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts.values())], SCHEMA)
    got = {r["doc_id"]: r["licenses"] for r in N.license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_pieces_of_a_very_long_word_and_batches():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        coder = WordBPE(f.read())
    word = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    texts = [word, word + " a", "a " * 1000, ""]
    want = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for (joined, n, _), t in zip(coder.encode_batch(texts), texts, strict=True):
        ids = want.encode(t, add_special_tokens=False).ids if len(t) < 5000 else None
        assert ids is None or (joined, n) == (" ".join(map(str, ids)), len(ids))
    assert all(len(k) <= B.KEEP_LENGTH for k in coder.known)
    coder.forget()
    assert not coder.known and not coder.known_older
    import pyarrow as pa

    column = pa.array(["x" * n for n in (10, B.BATCH_LENGTH, B.BATCH_LENGTH + 5, 0, 3)] + [None] * 1000)
    cuts = list(B.portions(column))
    assert [i for lo, n in cuts for i in range(lo, lo + n)] == list(range(len(column))) and max(n for _, n in cuts) <= B.BATCH
