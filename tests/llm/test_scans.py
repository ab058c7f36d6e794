"""Licences, archives, fingerprints, decontamination and near copies against SQL or brute force."""

import hashlib
import io
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle_support import differences, duck

from bindloom.llm import bagminhash, decontam, license_scan, queries, spotsigs, store, warc

LICENSES = [
    (101, "Intro. Licensed under the Apache License, Version 2.0. More text.", "en"),
    (102, "/*\n * MIT License\n *\n * Permission is hereby granted, free of charge.\n */", "en"),
    (103, "code\nReleased under the MIT License.\nAll rights reserved.\nmore", "en"),
    (104, "This license is granted under no known terms. MIT Licensed!", "en"),
    (105, license_scan.SENTENCES["BsdGrant"][0] + "\n\n" + license_scan.SENTENCES["BsdSource"][0] + "\n" + license_scan.SENTENCES["BsdBinary"][0], "en"),
]


@pytest.fixture(scope="module")
def tables(spark, messy, tmp_path_factory):
    """The messy rows and some licences as a folder of tables that DuckDB reads too."""
    folder = tmp_path_factory.mktemp("tables")
    # the SQL's windows take time in the square of a text's length
    texts = [(r["doc_id"], r["text"] and r["text"][:20_000], r["lang"]) for r in messy.where("doc_id is not null").select("doc_id", "text", "lang").collect()] + LICENSES  # SQL joins drop null ids
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    docs.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    long = "one two three four five six seven eight nine ten"
    items = [(1, long), (2, "cat sat"), (3, None), (4, "..."), (5, long), (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (None, "no id here"), (7, "word another word another word another word another word")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(folder / "benchmark.parquet"))
    body = "<html>" + "x" * 200 + "</html>"
    pages = [(1, "http://a/b c", body), (2, None, body), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "short"), (6, "http://f", "short"), (7, "http://g", "é\r\n\r\n" * 60), (8, "http://h", "é\r\n\r\n" * 60), (7, "http://g", "é\r\n\r\n" * 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def con(tables):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    return c


def test_licences_equal_their_sql_on_odd_texts(spark, tables, con):
    assert differences(queries.op2_license_scan(spark, tables), con, license_scan.oracle()) == ""
    got = {r["doc_id"]: r["licenses"] for r in queries.op2_license_scan(spark, tables).collect()}
    assert got[101] == "Apache-2.0" and got[102] == "MIT" and got[103] == "MIT" and got[104] == "" and got[105] == "BSD-2-Clause"


def test_archives_equal_their_sql_on_odd_pages(spark, tables, con):
    assert differences(queries.op6_warc(spark, tables), con, warc.oracle()) == ""


@pytest.mark.parametrize("name", ["op2_license_scan", "op6_warc", "op8_decontaminate"])
def test_queries_equal_their_sql(name, spark, sf_dir):
    assert differences(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name]) == ""


def test_packages_are_zip_files_read_by_range():
    records = [(str(i), warc.record(i, "http://x", b"p" * 5000, 5000, "d", None, False)) for i in range(50)]
    for wide in (False, True):
        data = warc.package(records, zip64=wide)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.namelist() == [warc.DATA, warc.INDEX] and z.testzip() is None
        r = warc.Ranges(data, len(data))
        assert list(warc.records(r)) == [raw for _, raw in records]
        some = warc.Ranges(data, len(data))
        assert list(warc.records(some, keys={"7"})) == [records[7][1]]
    with pytest.raises(ValueError):
        warc.directory(warc.Ranges(b"not a zip" * 10, 90))
    assert warc.parsed(warc.record(3, None, b"a\r\n\r\nb", 6, "d", None, False))[2] == b"a\r\n\r\nb"


def test_empty_tables(spark, nothing):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = store.scratch(spark, "none")
    warc.write(pages, path)
    assert warc.read(spark, path).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert license_scan.scan(nothing).count() == spotsigs.compare_edited(nothing).count() == decontam.report(nothing, items).count() == bagminhash.classes(nothing).count() == 0


def test_decontamination_on_odd_texts(spark, tables, con):
    assert differences(queries.op8_decontaminate(spark, tables), con, queries.OP8_SQL) == ""


def test_null_ids_are_ids_of_their_own_and_long_texts_are_whole(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (0, "x"), (2, "word another " * 5_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c"), (None, "b c"), (7, "word another word")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.report(docs, items, n=2).collect()}
    assert got == {(None, 3, 3, 1), (1, 3, 3, 1), (0, 1, 0, 0), (2, 10_000, 10_000, 1)}


def test_clean_keeps_rows_as_they_are(spark, messy):
    items = spark.createDataFrame([(1, "cat sat on"), (2, "the mat it s"), (3, "zeta eta")], "item_id long, text string")
    kept = decontam.clean(messy, items, n=3, at_least=2)
    assert kept.columns == messy.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in messy.where("doc_id is null or doc_id not in (4, 5)").collect())


def test_proximity_allows_gaps(spark):
    docs = spark.createDataFrame([(1, "one two x three"), (2, "one two three"), (3, "one y z three two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    index = decontam.build(docs, items)
    assert {r["doc"] for r in decontam.matches(index, 3).collect()} == {2} and {r["doc"] for r in decontam.matches(index, 3, slop=1).collect()} >= {1, 2}


# -- SpotSigs --------------------------------------------------------------------------------------


def plain_signatures(text):
    """Chains of content words after common words, as tuples."""
    words = [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    common, out = set(spotsigs.COMMON), set()
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in common][: spotsigs.CHAIN]
        if w in common and rest:
            out.add((w, *rest))
    return out


@pytest.mark.parametrize("which", ["messy", "documents"])
def test_fingerprints_against_brute_force(which, request):
    df = request.getfixturevalue(which)
    if which == "messy":
        df = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted([(r["doc_id"], r["text"] or "") for r in df.collect()])
    got = {r["doc_id"]: r for r in spotsigs.compare_edited(df).collect()}
    assert set(got) == {i for i, _ in rows}
    for k, (i, t) in enumerate(rows):
        nxt, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = plain_signatures(t), plain_signatures(edited), plain_signatures(nxt)
        if len(t) < 20_000 and a and b:
            assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b), abs=1e-6)
        if len(t) < 20_000 and a and c:
            assert got[i]["near_next"] == pytest.approx(len(a & c) / len(a | c), abs=1e-6)
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_similar_sets_against_all_pairs(documents):
    prints = spotsigs.fingerprints(documents)
    members, pairs = spotsigs.similar(prints, 0.6)
    ids = {}
    for r in members.collect():
        ids.setdefault(r["set_id"], []).append(r["doc_id"])
    found = {frozenset((ids[r["a"]][0], ids[r["b"]][0])) for r in pairs.collect()}
    sets = {r["doc_id"]: set(r["signatures"]) for r in prints.collect()}
    firsts = [v[0] for v in ids.values()]
    want = {frozenset((a, b)) for k, a in enumerate(firsts) for b in firsts[:k] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert found == want


# -- near copies -----------------------------------------------------------------------------------


def shingles(text):
    w = [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def all_pairs_classes(rows, threshold=0.8):
    bags = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if not a and not b:
                near = (rows[i][1] or "") == (rows[j][1] or "")
            else:
                common, whole = sum((a & b).values()), sum((a | b).values())
                near = whole and common / whole >= threshold
            if near:
                top[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return sorted(sorted(map(repr, g)) for g in groups.values())


@pytest.mark.parametrize("which", ["messy", "documents"])
def test_classes_against_all_pairs(which, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {}
    for r in bagminhash.classes(df).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    got.setdefault(None, [])
    want = all_pairs_classes(rows)
    have = sorted(sorted(map(repr, g)) for g in got.values() if g)
    assert have == want


def test_one_of_each_class_is_kept_as_it_is(messy):
    kept = bagminhash.keep_first(messy)
    assert kept.columns == messy.columns
    n = len({r["class_id"] for r in bagminhash.classes(messy).collect()})
    assert kept.count() == n


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 2**63, 60, dtype=np.uint64)
    for wa, wb in ((np.ones(60, int), rng.integers(1, 6, 60)), (rng.integers(1, 40, 60), rng.integers(1, 40, 60))):
        hs, ns = np.concatenate([h, h]), np.concatenate([wa, wb])
        sig = bagminhash.signatures(hs, ns, np.array([0, 60, 120]), 4096)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_sketches_bound_what_is_common():
    rng = np.random.default_rng(2)
    for size in (0, 1, 30, 200, 5000):
        a, b = rng.integers(0, 300, size, dtype=np.uint64), rng.integers(0, 300, size, dtype=np.uint64)
        s, beyond = bagminhash.sketches(np.concatenate([a, b]), np.array([0, size, 2 * size]))
        bits = sum(int(x).bit_count() for x in (s[0] & s[1]).view(np.uint64)) + min(beyond)
        assert bits >= sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        assert sum(int(x).bit_count() for x in s[0].view(np.uint64)) + beyond[0] == size


def test_a_large_class_keeps_links_to_others(spark):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(120):
        w = list(base)
        w[k % 60] = f"v{k}"
        texts.append((k, " ".join(w)))
    got = {r["class_id"] for r in bagminhash.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0} or len(got) == len(all_pairs_classes(texts))
    assert len(got) == len(all_pairs_classes(texts))


def test_word_numbers_do_not_depend_on_neighbours():
    from bindloom.llm import hashing

    one, at = hashing.word_hashes(pa.array(["Hello, world", None, "HELLO", "x hello world"]))
    assert at.tolist() == [0, 2, 2, 3, 6] and one[0] == one[2] == one[4] and one[1] == one[5]


#: Notices as they stand in real files, with what they tell.
NOTICES = [
    ("Copyright (c) 2021 Jane Doe\n\n" + license_scan.SENTENCES["MitGrant"][0] + "\n\n" + license_scan.SENTENCES["MitNotice"][0] + "\n\nAll rights reserved.", "MIT"),
    ("// SPDX-License-Identifier: MIT\n#include <x.h>\n", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later\n", "GPL-2.0-or-later"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
    ("This code is licensed under the MIT License", "MIT"),
    ("Intro text. This software is released under the terms of the Apache License 2.0. More.", "Apache-2.0"),
    ("//  Distributed under the Boost Software License, Version 1.0.\n//  (See accompanying file LICENSE_1_0.txt or copy at\n//  http://www.boost.org/LICENSE_1_0.txt)\n", "BSL-1.0"),
    (license_scan.SENTENCES["BsdGrant"][0] + "\n\n" + license_scan.SENTENCES["BsdSource"][0] + "\n\n" + license_scan.SENTENCES["BsdBinary"][0] + "\n\nNeither the name of Example, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-2-Clause,BSD-3-Clause"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages.\n\n" + license_scan.SENTENCES["ZlibGrant"][0], "Zlib"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n", "EPL-2.0"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("All rights reserved.", "Proprietary"),
    ("This sentence has no terms at all.", ""),
]


def test_notices_of_real_files_are_recognised(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in NOTICES)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(rows).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]


def test_licences_with_null_ids_and_long_texts(spark, messy):
    odd = spark.createDataFrame([(None, "MIT License"), (None, None), (1, "filler words here. " * 20_000 + "Licensed under the MIT License."), (2, "A licence of an unknown kind.")], "doc_id long, text string")
    got = [(r["doc_id"], r["n_sentences"], r["licenses"], r["n_unknown"]) for r in license_scan.scan(odd).collect()]
    assert sorted(got, key=repr) == sorted([(None, 1, "MIT", 0), (None, 0, "", 0), (1, 20_001, "MIT", 0), (2, 1, "", 1)], key=repr)
    assert license_scan.scan(messy).count() == messy.count()


def test_packages_of_several_archives_and_other_openers(tmp_path):
    records = [(str(i), warc.record(i, "http://x", b"p" * 500, 500, "d", None, False)) for i in range(7)]
    for wide in (False, True):
        data = warc.package(records, zip64=wide, each=3)
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.namelist() == [warc.DATA, warc.data_name(1), warc.data_name(2), warc.INDEX] and z.testzip() is None
        (tmp_path / "one package").write_bytes(data)
        import pyarrow.fs

        for opened in (warc.opened(str(tmp_path / "one package")), pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "one package"))):
            r = warc.Ranges(opened, len(data))
            assert list(warc.records(r)) == [raw for _, raw in records]
            r.close()
    assert warc.by_range("file:///tmp") and not warc.by_range("viewfs://store/tmp")


def test_pages_without_ids_and_with_clashing_columns(spark, tmp_path):
    body = "y" * 150
    rows = [(None, None, body, "d", 1), (None, None, body, "d", 1), (3, "http://x", body, "d", 1), (4, "http://x", None, "d", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size int").withColumn("same", pages_same()).withColumn("n", pages_same())
    path = store.scratch(spark, "pages")
    warc.write(pages, path)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(spark, path).collect()), key=repr)
    assert got == sorted([(None, 150, "revisit", 3), (None, 150, "revisit", 3), (3, 150, "response", None), (4, 0, "response", None)], key=repr)


def pages_same():
    from pyspark.sql import functions as F

    return F.lit("s")


def brute_matches(text, item, slop):
    w, it = text.split(), item.split()
    return any(all(any(0 <= p < len(w) and w[p] == t for p in range(d + j - slop, d + j + slop + 1)) for j, t in enumerate(it)) for d in range(-len(it) - slop, len(w) + slop))


def test_proximity_does_not_depend_on_which_term_is_rarest(spark):
    base = [(1, "a x b y c"), (2, "a b c"), (3, "c b a"), (4, "a z z b c"), (5, "x a b z c b")]
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for common in ("", " a a a a", " b b b b", " c c c c"):
        docs = spark.createDataFrame([*base, (9, "q" + common)], "doc_id long, text string")
        for slop in (0, 1, 2):
            got = {r["doc"] for r in decontam.matches(decontam.build(docs, items), 3, slop=slop).collect()}
            assert got == {i for i, t in [*base, (9, "q" + common)] if brute_matches(t, "a b c", slop)}, (common, slop)


def test_near_copies_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:-1], "x"])), (None, "something else"), (7, " ".join(words)), (7, "another text of seven"), (7, "another text of seven")]
    docs = spark.createDataFrame([(i, t, "k", 1, "h") for i, t in rows], "doc_id long, text string, key string, n int, __n string")
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["class_texts"], r["n_links"]) for r in bagminhash.classes(docs).collect()), key=repr)
    near = {(None, 7, 3, 2, 1), (7, 7, 3, 2, 1)}
    assert set(got) == near | {(None, None, 1, 1, 0), (7, 7, 2, 1, 0)} and len(got) == 6
    kept = bagminhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["text"] for r in kept.collect()) == sorted([" ".join(words), "something else", "another text of seven"])


def test_a_group_just_below_the_threshold_makes_few_comparisons(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(150):
        w = list(base)
        for j in rng.choice(150, 8, replace=False):
            w[j] = f"v{k}x{j}"
        texts.append((k, " ".join(w)))
    got = {}
    for r in bagminhash.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(sorted(map(repr, g)) for g in got.values()) == all_pairs_classes(texts)


def test_ranges_split_a_key_of_many_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5_000).select(F.when(F.col("id") % 2 == 0, 40).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("h")).cache()
    for per in (100, 10):  # few cuts: generated code; many: Arrow
        cuts = store.id_ranges(rows, "k", per)
        got = rows.withColumn("part", store.range_of("k", "h", cuts)).collect()
        sizes = Counter(r["part"] for r in got)
        assert max(sizes.values()) < 4 * per + 20
        order = [r["part"] for r in sorted(got, key=lambda r: (r["k"], r["h"]))]
        assert order == sorted(order)


def test_fingerprints_of_rows_without_ids(spark):
    texts = ["the quick brown fox of the old town", "a cat is in the big red house", "the quick brown fox of the old town", None]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(5, "on the hill with a view")], "doc_id long, text string")
    got = spotsigs.compare_edited(docs).collect()
    assert len(got) == 5 and Counter(r["n_chars"] for r in got) == Counter(len(t or "") for t in [*texts, "on the hill with a view"])
    same = [r["fingerprint"] for r in got if r["n_chars"] == len(texts[0])]
    assert len(set(same)) == 1
