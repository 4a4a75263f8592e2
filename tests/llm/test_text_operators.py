import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import SF, check
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import queries
from weft.llm.byte_bpe import Codec, decode, encode, read_ranks, round_trip
from weft.llm.exact_dedup import exact_dedup
from weft.llm.language_id import bins, document_frequencies
from weft.llm.language_id import fit as fit_language
from weft.llm.language_id import language_id
from weft.llm.license_scan import BASE, license_scan, signatures
from weft.llm.mix_sources import mix_sources
from weft.llm.preference_format import preference_format
from weft.llm.quality_classifier import features as quality_features
from weft.llm.quality_classifier import fit as fit_quality
from weft.llm.quality_classifier import fit_weights, moments, prior_of, quality_classifier, risk
from weft.llm.quality_rules import quality_rules, text_statistics
from weft.llm.simhash_dedup import Forest, components, fingerprint, fingerprints, links, masks, simhash_dedup
from weft.llm.token_attribution import attribute, token_attribution

#: Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, id string, size long, score double, rank long"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30000))
ROWS = [
    (1, "the cat sat on the mat and ran to the far hill at noon", "en", "a"),
    (2, "the cat sat on the mat and ran to the far hill at noon", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (5, LONG, "de", "b"),
    (6, "Under the MIT License.\nUnder the MIT license under the mit license", "en", "c"),
    (6, "Under the MIT License.\nUnder the MIT license under the mit license", "en", "c"),
    (7, "cc by nc 4.0 \x00 \n\n  apache license, version 2.0", None, ""),
    (8, "a b c d e f a b c d e a b c d e", "fr", "a"),
    (9, "  !!! ### 123 ", "fr", "c"),
    (None, "no id here", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 5, "x", 7, 0.5, 1) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (5, 1, 0), (8, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name])


def test_exact_dedup(docs, empty):
    got = exact_dedup(docs, n_runs=32, fan_in_bits=2).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        group = [x[0] for x in ROWS if (x[1] or "") == texts[r.doc_id]]
        known = [x for x in group if x is not None]
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(known, default=None), len(group), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(empty).count() == 0


def test_quality_statistics(docs, empty, labels):
    for r in text_statistics(docs).collect():
        text = next(x[1] for x in ROWS if x[0] == r.id) or ""
        w = text.split()
        at = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if at[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip()]
        if r.id != 7:  # \x00 and other odd spaces: Python's split differs
            assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(w), len(hit), len(lines) - len(set(lines)), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
    got = quality_rules(docs, labels).collect()
    assert len(got) == len(ROWS) and not any(r.kept for r in got if r.n_words < 10)
    assert quality_rules(empty, labels.limit(0)).count() == 0


def _brute_components(prints, distance=4):
    least = {p: min((i for i in ids if i is not None), default=None) for p, ids in prints.items()}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance and find(a) != find(b):
                root[find(a)] = find(b)
    named = {}
    for p in prints:
        named.setdefault(find(p), []).append(least[p])
    return {p: min((x for x in named[find(p)] if x is not None), default=None) for p in prints}


def test_fingerprint_by_hand():
    import xxhash

    text = "The Cat sat\ton the mat"
    w = [x.lower() for x in text.split()]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert fingerprint(text.encode()) == want and fingerprint(b"  \n") == 0 == fingerprint(None)
    assert fingerprint(b"one two") == xxhash.xxh64_intdigest("one two", 42)


def test_simhash_dedup_against_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-1, None), (-2, "")] + [r[:2] for r in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {}
    for i, t in rows:
        prints.setdefault(fingerprint((t or "").encode()), []).append(i)
    want = _brute_components(prints)
    got = simhash_dedup(df).collect()
    assert len(got) == len(rows) and all(r.component_id == want[int(r.fingerprint, 16)] for r in got)
    assert simhash_dedup(empty).count() == 0 and simhash_dedup(docs).count() == len(ROWS)


def test_links_lose_none_when_nodes_are_hot(spark):
    random_ = random.Random(3)
    centre = random_.getrandbits(64)
    prints = {centre}
    for _ in range(300):  # a dense group, and strangers
        p = centre
        for b in random_.sample(range(64), random_.randint(1, 5)):
            p ^= 1 << b
        prints |= {p, random_.getrandbits(64)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = _brute_components({p: [s] for p, s in zip(prints, signed)})
    for hot in (1 << 14, 40):
        root = {r.node: r.root for r in components(links(df, hot=hot)).collect()}
        groups, brute = {}, {}
        for p, s in zip(prints, signed):
            groups.setdefault(root.get(s, s), set()).add(s)
            brute.setdefault(want[p], set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def _in_gray_order(fps):
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return fps[np.argsort(rank.view(np.int64))]


def test_index_search_of_several_nodes():
    random_ = np.random.default_rng(5)
    top = masks(1 << 20)[3]
    assert len(masks(1 << 20)) == 5 and len(masks(1 << 30)) == 15 and masks(100) == [0]
    parts = []
    for size in (12, 5, 700):
        base = random_.integers(0, 2**63, max(1, size // 10), dtype=np.uint64)
        near = np.concatenate([base ^ (np.uint64(1) << random_.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(10)])
        parts.append(_in_gray_order(np.unique(near & ~np.uint64(top))))
    first = np.cumsum([0, *map(len, parts)])[:-1]
    label = Forest(np.concatenate(parts), first, np.full(3, top, dtype=np.uint64)).search(4)
    for at, fps in zip(first, parts):
        want = _brute_components({int(p): [i] for i, p in enumerate(fps)})
        assert [label[at + i] - at for i in range(len(fps))] == [want[int(p)] for p in fps]


def test_the_index_finds_the_links_of_a_whole_table(spark):
    """At sf0.1 every fingerprint goes down from the top of one hierarchy, which prunes most of it; the links are those of all pairs."""
    rows = fingerprints(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("fp").distinct().collect()
    fps = _in_gray_order(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64))
    index = Forest(fps, np.array([0]), np.array([0], dtype=np.uint64))
    label = index.search(4)
    assert len(index.visited) >= 4 and index.visited[-1] == len(fps) and min(index.visited) > 0
    assert sum(index.visited) < len(fps) ** 2 and index.pruned[2] > 0 < index.pruned[1]
    for i, p in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps ^ p) <= 4)
        assert (label[near] == label[i]).all()
    linked = np.flatnonzero(label != np.arange(len(fps)))
    assert len(linked) and all(min((int(fps[i]) ^ int(fps[j])).bit_count() for j in np.flatnonzero(label == label[i]) if j != i) <= 4 for i in linked)


def test_masks_lose_no_link(spark):
    """Five and fifteen masks, and hot top nodes cut into stretches, give the components of all pairs."""
    random_ = random.Random(8)
    prints = set()
    for _ in range(60):
        p = random_.getrandbits(64)
        for _ in range(12):
            prints.add(p)
            for b in random_.sample(range(64), random_.randint(1, 4)):
                p ^= 1 << b
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    want = _brute_components({p: [s] for p, s in signed.items()})
    for n, hot in ((1 << 20, 1 << 14), (1 << 30, 1 << 14), (0, 50), (1 << 20, 3)):
        root = {r.node: r.root for r in components(links(df, hot=hot, n=n)).collect()}
        groups, brute = {}, {}
        for p, s in signed.items():
            groups.setdefault(root.get(s, s), set()).add(s)
            brute.setdefault(want[p], set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


@pytest.fixture(scope="module")
def vocabulary():
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, docs, empty, vocabulary):
    ranks, library = vocabulary
    random_ = random.Random(1)
    texts = ["", None, "<|endoftext|>", "aaaaaaaaaaa" * 500, "ab" * 20000, "\U0001f600é日本 \n\n  x's"]
    texts += ["".join(random_.choice(["a", "b", "the", "\n", " ", "é", "日", "1", "'s", "ing", "zz", "==", "-"]) for _ in range(random_.randint(0, 80))) for _ in range(500)]
    codec = Codec(ranks, public_tokenizers.PATTERN)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == library.encode_ordinary(text or "") and codec.decode(ids) == (text or "").encode()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(points[i : i + 997]) for i in range(0, len(points), 997)]
    assert all(ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode() for text, ids in zip(every, codec.encode(every)))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: library.encode_ordinary(t) for i, t in rows}
    for r in queries.QUERIES["op2_byte_bpe"](spark, SF).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest())
    back = decode(encode(docs)).collect()
    assert sorted(bytes(r.data) for r in back) == sorted((r[1] or "").encode() for r in ROWS)
    assert round_trip(docs).count() == len(ROWS) and round_trip(empty).count() == 0


def test_mix(docs, empty):
    pieces, verdict = mix_sources(docs, block=7)
    got = verdict.collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), 0)
        by[r.source_size, r.target] += r.taken
    assert all(target - 1 < taken <= target <= 2 * size for (size, target), taken in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(s for s, _ in by)) < 1e-6
    slots = pieces.groupBy("slot").agg({"n_words": "sum"}).collect()
    assert max(r[1] for r in slots) <= 7 and sum(r[1] for r in slots) == sum(r.taken for r in got)
    assert mix_sources(empty)[1].count() == 0


def test_attribution(docs, empty):
    ends, bounds = np.array([2, 5, 9, 10]), np.array([3, 4, 10])
    assert [attribute(ends, bounds, rule)[0].tolist() for rule in ("start", "majority", "split")] == [[2, 0, 2], [2, 0, 2], [1 + 1 / 3, 1 / 3, 2 + 1 / 3]]
    assert attribute(ends, bounds, "start")[1] == 1
    got = token_attribution(docs, rule="split").collect()
    assert len(got) == len(ROWS) and all(abs(sum(r.section_tokens) - r.n_tokens) < 1e-6 and len(r.section_tokens) == r.n_sections and r.outside_tokens == 0 for r in got)
    assert token_attribution(empty).count() == 0
    gaps = token_attribution(docs, section=rb"the [a-z]+", rule="split").collect()
    assert all(abs(sum(r.section_tokens) + r.outside_tokens - r.n_tokens) < 1e-6 for r in gaps) and max(r.outside_tokens for r in gaps) > 0


def test_attribution_byte_by_byte():
    """The three rules against one that looks at each byte, with gaps, empty sections and a tail that is of none."""
    random_ = random.Random(2)
    for _ in range(400):
        ends = np.cumsum([random_.randint(1, 4) for _ in range(random_.randint(1, 12))])
        total = int(ends[-1])
        cuts = sorted(random_.choices(range(total + 1), k=2 * random_.randint(0, 4)))
        spans = list(zip(cuts[::2], cuts[1::2]))
        at = np.array(spans, dtype=np.int64).reshape(-1, 2)
        # what each byte belongs to; the bytes between two sections are of a gap of their own
        of, gap = [], 0
        for b in range(total):
            inside = [k for k, (lo, hi) in enumerate(spans) if lo <= b < hi]
            gap = sum(hi <= b for _, hi in spans)
            of.append(("s", inside[0]) if inside else ("g", gap))
        for rule in ("start", "majority", "split"):
            want, outside, across, start = [0.0] * len(spans), 0.0, 0, 0
            for end in ends:
                owners = of[start:end]
                share = Counter(owners)
                if rule == "start":
                    share = {owners[0]: 1.0}
                elif rule == "majority":
                    most = max(share.values())
                    share = {next(o for o in owners if share[o] == most): 1.0}
                else:
                    share = {o: n / len(owners) for o, n in share.items()}
                across += len(set(owners)) > 1
                for (kind, k), n in share.items():
                    if kind == "s":
                        want[k] += n
                    else:
                        outside += n
                start = end
            got = attribute(ends, at[:, 1], rule, at[:, 0])
            assert np.allclose(got[0], want) and abs(got[2] - outside) < 1e-9, (ends, spans, rule)
            assert got[1] >= across  # a token over an empty section or gap crosses boundaries too
    assert attribute(np.array([2, 5, 9, 10]), np.array([3, 4]), "start")[2] == 2


def test_licenses_against_brute_force(spark, docs, empty):
    import re

    assert len(signatures()) > 200
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [r[:2] for r in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(df).collect()}
    want = set()
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want.add((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == want
    by = {r.doc_id: r for r in license_scan(docs).collect()}
    assert by[7].labels == "apache-2,cc-by-nc" and by[6].labels == "mit" and by[3].labels == "" and by[3].score == 0
    one = spark.createDataFrame([(1, "SPDX-License-Identifier: GPL-3.0 and see the BSD 3-Clause License")], "doc_id long, text string")
    assert license_scan(one).first().labels == "bsd-3,gpl-3" and license_scan(empty).count() == 0


def _shortest(pattern):
    """The shortest text of a signature's pattern, by its first alternatives."""
    import re

    def of(parsed):
        out = ""
        for op, x in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(x)
            elif name == "SUBPATTERN":
                out += of(x[-1])
            elif name == "BRANCH":
                out += of(x[1][0])
            elif name == "MAX_REPEAT":
                out += of(x[2]) * x[0]
            elif name == "IN":
                out += chr(x[0][1])
            elif name == "NOT_LITERAL":
                out += "x"
            elif name == "ASSERT_NOT":
                pass
            else:
                raise ValueError(name)
        return out

    return of(re._parser.parse(pattern))


def test_every_signature_alone_in_a_document(spark):
    """No gate closes before a signature: each is found in a text that holds nothing else."""
    cases = [(_shortest(pattern), label, confidence) for _, label, _, confidence, pattern in signatures()]
    cases += [(phrase, label, 1.0) for phrase, label in BASE.items()]
    for text, label in (("Released under MIT", "mit"), ("distributed under Apache 2.0", "apache-2"), ("available under EUPL 1.2", "eupl-1.2"), ("published under ODbL", "odbl"), ("released under MPL 2.0", "mpl-2"), ("provided under ISC", "isc")):
        cases.append((f"This work is {text}.", label, 0.95))
    cases.append(("see Artistic 2.0", "artistic-2", 0.6))
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    lost = [case for i, case in enumerate(cases) if case[1] not in got[i].labels.split(",") or got[i].score < case[2]]
    assert not lost


def _scan(text, rules):
    """What the scan of one text has to find: every signature tried on the whole of it, with no gate."""
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    found = []
    for order, (label, priority, confidence, pattern) in enumerate(rules):
        for m in pattern.finditer(words):
            first = words.count(" ", 0, m.start()) - 1
            found.append((first, first + m[0].count(" "), priority, order, label, confidence))
    found.sort(key=lambda x: (x[0], -x[1], -x[2], x[3]))
    stay = [x for i, x in enumerate(found) if not any(b[0] <= x[0] and b[1] >= x[1] and b[2] >= x[2] for b in found[:i])]
    base = {label for p, label in BASE.items() if f" {p} " in words}
    labels = base | {x[4] for x in stay}
    return sorted((x[4], x[0], x[1]) for x in stay), ",".join(sorted(labels)), max([1.0 if base else 0.0, *(x[5] for x in stay)])


def test_license_scan_against_one_without_gates(spark):
    """Labels, places, priority and containment on all documents, on every signature, and on texts mixed of these."""
    import re

    rules = [(label, priority, confidence, re.compile(f"(?<= )(?:{pattern})(?= )")) for _, label, priority, confidence, pattern in signatures()]
    random_ = random.Random(4)
    alone = [_shortest(pattern) for *_, pattern in signatures()]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + alone[::3]
    filler = "the river ran under the old bridge by the mill see there".split()
    texts += [" ".join(random_.choice([random_.choice(alone), *random_.choices(filler, k=3)]) for _ in range(random_.choice([3, 12, 40, 300]))) for _ in range(120)]
    texts += ["MIT " * 40, "under the mit license " * 200, "by mit under bsd license gpl v2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in license_scan(df).collect():
        places, labels, score = _scan(texts[r.doc_id], rules)
        assert sorted((d.label, d.first, d.last) for d in r.detections) == places, texts[r.doc_id][:200]
        assert (r.labels, r.score) == (labels, score)


def test_notices_and_ordinary_words(spark):
    """Sentences of license texts have labels; names that are ordinary words have none without `license`."""
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3-or-later",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
        "a song by ruby under the bridge": "",
        "we see python and vim by boost every day": "",
        "the study by MIT": "",
        "available under the Ruby license": "ruby",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan(df).collect()}
    lost = [(text, label, got[i]) for i, (text, label) in enumerate(cases.items()) if (label not in got[i] if label else got[i] != [""])]
    assert not lost
    assert license_scan(spark.createDataFrame([(1, "mit license " * 50_000)], "doc_id long, text string")).first().n_words == 100_000


def test_preferences(spark):
    kind = "array<struct<turn: bigint, role: string, text: string>>"
    a = [(0, "user", "hi"), (1, "assistant", "yes")]
    none = [(0, "user", "hi"), (1, "assistant", None)]
    pairs = spark.createDataFrame([(1, a, [(0, "user", "hi"), (1, "assistant", "no")]), (2, a, a), (3, a, None), (4, None, None), (5, a, a[:1]), (6, none, a), (7, none, [*none, None, (2, None, "x")]), (8, none, [a[0], (1, None, None)])], f"pair_id long, chosen {kind}, rejected {kind}")
    by = {r.pair_id: r for r in preference_format(pairs).collect()}
    assert [by[i].n_prefix for i in range(1, 9)] == [1, 2, 0, 0, 1, 1, 2, 1] and by[2].chosen == by[2].rejected == by[4].prompt == ""
    s = by[1].chosen_mask[0]
    assert by[1].chosen[s.start : s.end] == "yes<|im_end|>\n" and by[5].rejected == "" and by[1].prompt.endswith("hi<|im_end|>\n")
    # a null text is an empty one: it is rendered, and learnt as the mark that ends the turn
    s = by[6].chosen_mask[0]
    assert by[6].chosen[s.start : s.end] == "<|im_end|>\n" and by[6].rejected.endswith("yes<|im_end|>\n")
    assert by[7].chosen == "" and by[7].rejected == "<|im_start|>\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n" and by[7].rejected_mask == []
    long = spark.createDataFrame([(1, [(i, "assistant", "y") for i in range(3000)], [(0, "user", "n")])], f"pair_id long, chosen {kind}, rejected {kind}")
    r = preference_format(long).first()
    assert len(r.chosen_mask) == 3000 and all(r.chosen[m.start : m.end] == "y<|im_end|>\n" for m in r.chosen_mask)


def test_preferences_part_at_all_turns(spark):
    got = queries.QUERIES["op3_preference_format"](spark, SF).collect()
    assert {0, 1, 2, 3} <= {r.n_prefix for r in got} and any("," in r.chosen_mask for r in got)


def test_language_held_out(spark, docs, empty):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in queries.QUERIES["op1_language_id"](spark, SF).collect() if r.held_out]
    assert got and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    model = fit_language(docs)
    by = {r.doc_id: r.lang_pred for r in language_id(docs, model).collect()}
    assert by[3] == by[4] == by[9] == "und" and by[1] in model.langs
    assert language_id(empty, fit_language(empty)).count() == 0 and language_id(docs, fit_language(empty)).first().lang_pred == "und"


def test_quality_held_out(spark, docs, empty, labels):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op9_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) >= 0.9
    none = labels.select("doc_id").limit(0)
    assert quality_classifier(docs, fit_quality(docs, none)).count() == len(ROWS) and quality_classifier(empty, fit_quality(empty, none)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out[name] = (before, [r.asDict() for r in docs.collect()])
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = out["exact dedup"]
    best = {}
    for r in before:
        best[r["text"]] = max(best.get(r["text"], r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(best.values())
    before, after = out["simhash near-dedup"]
    prints = {}
    for r in before:
        prints.setdefault(fingerprint(r["text"].encode()), []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(set(_brute_components(prints).values()))
    before, after = out["mixing"]
    size = lambda rows: sum(len(r["text"].encode().split()) for r in rows)
    assert 1.49 * size(before) < size(after) <= 1.5 * size(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = out["byte-level BPE"]
    assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in before) == sorted((r["doc_id"], r["decoded_sha256"]) for r in after)
    final = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert final == sorted((r["doc_id"], r["ids_sha256"]) for r in after)


def test_pipeline_judges_rows_not_ids(spark):
    """An id that many rows share loses no distinct text and keeps no rejected one; rows without an id stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    random_ = random.Random(11)
    texts = [" ".join("".join(random_.choice("abcdefghijklmnopqrst") for _ in range(6)) for _ in range(40)) for _ in range(24)]
    row = lambda i, t, lang="en", source="a": (i, t, lang, source, len(t))
    good = [row(7, t) for t in texts[:12]] + [row(None, t) for t in texts[12:18]] + [row(100 + k, t) for k, t in enumerate(texts[18:])]
    pairs = lambda df: sorted((r.doc_id or -1, r.text) for r in df.collect())
    want = sorted((r[0] or -1, r[1]) for r in good)

    kept = corpus_pipeline.quality(spark, spark.createDataFrame(good + [row(7, "too short"), row(None, "short too")], schema), SF)
    assert pairs(kept) == want
    again = [row(7, texts[0], "de"), row(7, texts[0]), row(3, texts[1]), row(None, texts[2]), row(None, texts[12])]
    once = corpus_pipeline.exact(spark, spark.createDataFrame(good + again, schema), SF)
    assert pairs(once) == want and [r.lang for r in once.where(F.col("text") == texts[0]).collect()] == ["de"]
    copies = [row(9, texts[0]), row(None, texts[1]), row(9, texts[12])]
    alone = corpus_pipeline.near(spark, spark.createDataFrame(good + copies, schema), SF)
    assert pairs(alone) == sorted([x for x in want if x != (-1, texts[12])] + [(9, texts[12])])
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(good, schema), SF).collect()
    n = Counter((r.doc_id or -1, r.text) for r in mixed if len(r.text.split()) == 40)
    assert sum(len(r.text.split()) for r in mixed) == 1.5 * 40 * len(good) and set(n) == set(want) and max(n.values()) <= 2


def test_certified_levels_follow_the_exact_bound(spark):
    """The chosen severity is the last of those whose binomial tail is small enough, from the first on."""
    from math import comb

    from weft.llm.quality_rules import ALPHA, DELTA, SEVERITIES, certified

    rows = [("a", 11)] * 200 + [("a", 8)] * 3 + [("a", 9)] * 30 + [("b", 11)] * 10 + [("c", 1)] * 50 + [("c", 11)] * 50
    got = {r.stratum: r.limit for r in certified(spark.createDataFrame(rows, "stratum string, severity int")).collect()}
    for s in "abc":
        n, limit = sum(x == s for x, _ in rows), 0
        for j in range(1, SEVERITIES + 1):
            k = sum(x == s and v <= j for x, v in rows)
            if 3 * sum(comb(n, i) * ALPHA**i * (1 - ALPHA) ** (n - i) for i in range(k + 1)) > DELTA:
                break
            limit = j
        assert got[s] == limit
    assert (got["a"], got["b"], got["c"]) == (8, 0, 0)


def test_models_are_learnt_from_a_bounded_number_of_rows(spark):
    """A third of all rows with one id count as one document; the sample still has as many others as it may."""
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en") for i in range(60)]
    many = spark.createDataFrame(rows + [(7, f"noch ein hund {k}", "de") for k in range(30)], "doc_id long, text string, lang string")
    model = fit_language(many, sample=20)
    assert model.langs == ["de", "en"] and {r.lang_pred for r in language_id(many.where("doc_id = 7"), model).collect()} == {"de"}
    positives = many.where("lang = 'en'").select("doc_id")
    got = quality_classifier(many, fit_quality(many, positives, n_positive=10, n_unlabelled=10)).collect()
    assert len(got) == 90 and all(0 <= r.score <= 1 for r in got)


def test_the_ladder_is_certified_on_what_the_base_rules_pass(spark):
    """Good documents that the base rules reject prove nothing: with them alone there is no rule of the method."""
    words = [f"word{i}" for i in range(40)]
    short = [(i, "too short", "en") for i in range(300)]
    marked = [(1000 + i, " ".join(f"{w}###" for w in words[:30]), "en") for i in range(30)]
    df = spark.createDataFrame(short + marked, "doc_id long, text string, lang string")
    good = spark.createDataFrame([(i, 1) for i, *_ in short], "doc_id long, quality int")
    assert {r.kept for r in quality_rules(df, good).where("doc_id >= 1000").collect()} == {True}
    fine = spark.createDataFrame(short + marked + [(2000 + i, " ".join(random.Random(i).sample(words, 30)), "en") for i in range(120)], "doc_id long, text string, lang string")
    named = spark.createDataFrame([(2000 + i, 1) for i in range(120)], "id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules(fine, named, label_id_col="id").collect()}
    assert all(got[2000 + i] for i in range(120)) and not any(got[1000 + i] for i in range(30))


def test_risk_and_its_gradient():
    """The non-negative risk by its definition, and its gradient by differences."""
    random_ = np.random.default_rng(1)
    p, u, w, prior = random_.normal(1, 1, (30, 4)), random_.normal(0, 1, (50, 4)), random_.normal(0, 1, 5), 0.4
    loss = lambda x, sign: np.mean([np.log(1 + np.exp(-sign * (sum(a * b for a, b in zip(row, w)) + w[-1]))) for row in x])
    positive, negative, of_p, of_n = risk(w, p, u, prior)
    assert abs(positive - prior * loss(p, 1)) < 1e-9 and abs(negative - (loss(u, -1) - prior * loss(p, -1))) < 1e-9
    for k in range(5):
        e = np.eye(5)[k] * 1e-6
        a, b = risk(w + e, p, u, prior), risk(w - e, p, u, prior)
        assert abs((a[0] - b[0]) / 2e-6 - of_p[k]) < 1e-5 and abs((a[1] - b[1]) / 2e-6 - of_n[k]) < 1e-5
    # the model tells the two kinds apart though it has no negative labels
    mixed = np.concatenate([random_.normal(1, 0.5, (400, 4)), random_.normal(-1, 0.5, (600, 4))])
    v = fit_weights(random_.normal(1, 0.5, (300, 4)), mixed, 0.4, 300)
    sure = mixed @ v[:-1] + v[-1] > 0
    assert sure[:400].mean() > 0.95 and sure[400:].mean() < 0.05


def test_prior_and_moments(spark):
    random_ = np.random.default_rng(3)
    positive, unlabelled = random_.normal(2, 1, 5000), np.concatenate([random_.normal(2, 1, 3000), random_.normal(-2, 1, 7000)])
    at = np.quantile(positive, np.linspace(0, 0.8, 41))
    got = prior_of(np.array([(positive >= t).mean() for t in at]), 5000, np.array([(unlabelled >= t).mean() for t in at]), 10000)
    assert 0.29 < got < 0.33
    texts = ["The cat.\nA dog!", "", None, "x" * 500, "one two one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    x = np.stack([quality_features((t or "").encode()) for t in texts])
    mean, spread = moments(df)
    assert np.allclose(mean, x.mean(axis=0), atol=1e-4) and np.allclose(spread, x.std(axis=0) + 1e-3, atol=2e-3)


def test_ftrl_against_one_weight_at_a_time():
    """Follow the regularised leader with one scalar update after the other."""
    from weft.llm import language_id as m

    random_ = np.random.default_rng(0)
    rows = []
    for i in range(12):
        at = np.sort(random_.choice(40, 6, replace=False))
        rows.append((at, random_.random(6), i % 3))
    z, n = {}, {}
    weight = lambda k, j: 0.0 if abs(z.get((k, j), 0.0)) <= m.L1 else -(z[k, j] - np.sign(z[k, j]) * m.L1) / ((m.BETA + n[k, j] ** 0.5) / m.ALPHA + m.L2)
    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = [[weight(k, j) for j in at] for k in range(3)]
            logit = [sum(a * b for a, b in zip(r, x)) for r in w]
            e = [np.exp(v - max(logit)) for v in logit]
            for k in range(3):
                g0 = e[k] / sum(e) - (k == y)
                for j, xj, wj in zip(at, x, w[k]):
                    g, was = g0 * xj, n.get((k, j), 0.0)
                    z[k, j] = z.get((k, j), 0.0) + g - ((was + g * g) ** 0.5 - was**0.5) / m.ALPHA * wj
                    n[k, j] = was + g * g
    got = m.ftrl(rows, 3, epochs=2)
    want = np.array([[weight(k, j) for j in range(40)] for k in range(3)])
    assert np.allclose(got[:, :40], want) and not got[:, 40:].any() and (want == 0).any()


def test_document_frequencies_and_rare_languages(spark):
    texts = ["der hund", "the dog", None, "", "123", "the the dog"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got, n = document_frequencies(df, "text")
    want = Counter(b for t in texts if (f := bins(t)) is not None for b in set(f.tolist()))
    assert n == 3 and {int(b): int(c) for b, c in zip(np.flatnonzero(got), got[got > 0])} == want
    rows = [(i, f"the dog and the cat {i}", "en") for i in range(400)] + [(1000 + i, "le chien et le chat", "fr") for i in range(5)]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40, least=5)
    assert model.langs == ["en", "fr"] and model.predict("le chat")[0] == "fr"
