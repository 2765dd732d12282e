"""The operators against brute-force versions, on small tables with nulls, ties, repeated rows, empty and long texts, and clashing columns."""

import hashlib
import io
import itertools
import math
import random
import re
import time
import wave
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, media, mixing, near_dedup, packing, quality, substrings, tokens, toxicity
from tessera.llm.html_text import extract_text, main_text
from tessera.llm.queries import tokenizer
from tessera.llm.words import NOT_ALNUM, Words

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows], DOC)


def prose(r, n):
    return " ".join(r.choice("the of and to a in that it was for on are as with his they at be this from".split()) + r.choice(["", "s", "ed", "er", "x"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = [prose(r, 60) for _ in range(12)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(12, 40):
        w = base[i % 5].split()
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            w[r.randrange(len(w))] = f"new{r.randrange(99)}"
        out.append((i, " ".join(w), ["s0", "s1", None][i % 3]))
    passage = prose(r, 25)
    out += [(i, prose(r, 30) + "\n" + passage + "\t " + prose(r, 10), "s9") for i in range(40, 46)]
    out += [(46, None, "s0"), (47, "", None), (48, "   \n ", "s1"), (49, "one", "s1"), (50, "ONE", "s1"), (51, "é " * 3000, "s2"), (52, "spam spam " * 400, "s2"), (None, base[0], "s1"), (3, base[3], "s0")]
    return out


def words(t):
    return (t or "").encode().split()


def test_substring_dedup(spark, rows):
    got = {}
    for r in substrings.substring_dedup(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]))
        assert r["lang"] == "en"
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    first, expected = {}, {}
    for i, t, _ in order:
        key = (i is None, i or 0)
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            seen = first.setdefault(tuple(w[p : p + 20]), (key, p))
            if seen < (key, p):
                gone[p : p + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.setdefault(i, []).append((len(w), sum(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_substring_dedup_rows(spark):
    """Null ids with different texts and exact copies; different texts under one id; windows that only later rows share."""
    r = random.Random(11)
    a, b, c, d, e = (" ".join(f"{x}{r.randrange(10**9)}" for _ in range(50)) for x in "abcde")
    many = [(None, " ".join(f"n{k}x{j}" for j in range(40)), "s") for k in range(30)]
    docs = [(1, a, "s"), (7, f"{b} {c}", "s"), (7, f"{d} {a}", "s"), (7, f"{b} {e}", "s"), (7, f"{b} {e}", "s"), (None, f"x {a}", "s"), (None, d + " own", "s"), (None, c, "s"), *[(None, "copy " + e.upper(), "s")] * 3, *many]
    for parts in (1, 5):
        got = Counter((x["doc_id"], x["kept"], x["n_removed"]) for x in substrings.substring_dedup(table(spark, docs).repartition(parts)).collect())
        assert got == Counter([
            (1, a, 0), (7, f"{b} {c}", 0), (7, d, 50), (7, f"{b} {e}", 0), (7, f"{b} {e}", 0), (None, "x", 50), (None, "own", 50), (None, "", 50),
            (None, "copy " + e.upper(), 0), *[(None, "", 51)] * 2, *[(None, t, 0) for _, t, _ in many],
        ])
    tied = [(3, f"{a} {b}", "s"), (3, f"{a} {c}", "s"), (2, f"{d} {a}", "s")]  # each row under id 3 loses a, from whichever task
    for parts in (1, 3):
        got = Counter((x["doc_id"], x["kept"]) for x in substrings.substring_dedup(table(spark, tied).repartition(parts)).collect())
        assert got == Counter([(3, b), (3, c), (2, f"{d} {a}")])
    longest = Counter((x["doc_id"], x["longest"]) for x in substrings.longest_repeats(table(spark, docs)).collect())
    assert longest == Counter([(1, 40), (7, 80)] + [(None, 40)] * 6)


def test_longest_repeats(spark, rows):
    plain = [(i, t, s) for i, t, s in rows if i is not None][:46]
    got = {r["doc_id"]: r["longest"] for r in substrings.longest_repeats(table(spark, plain)).collect()}
    expected, n = {}, 20
    while True:
        c = Counter(tuple(w[p : p + n]) for _, t, _ in plain for w in [words(t)] for p in range(len(w) - n + 1))
        here = {i for i, t, _ in plain for w in [words(t)] if any(c[tuple(w[p : p + n])] > 1 for p in range(len(w) - n + 1))}
        if not here:
            break
        expected |= {i: n for i in here}
        n *= 2
    assert got == expected


def test_mix(spark, rows):
    got = mixing.mix(table(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:  # share, cap, share the excess again
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        free = free - over if over else set()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * max(len(words(t)) for _, t, x in rows if x == s) + 1
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mixed(table(spark, rows)).count() == sum(r["copies"] for r in got)


def test_mix_ties(spark):
    """Rows of equal source, size and id, null ids too: the same texts are taken whatever the order of rows."""
    tied = [(k, f"{c} {c}", s) for k in (None, 4) for c in "abcdefghij" for s in ("p", "q", None)]
    runs = [Counter((r["doc_id"], r["text"], r["source"], r["kept"]) for r in mixing.mixed(table(spark, random.Random(n).sample(tied, len(tied))).repartition(n)).collect()) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) == 90


def test_quality(spark, rows):
    got = quality.quality(table(spark, rows), spark.createDataFrame([(0,), (1,), (None,)], "doc_id long"), buckets=512).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = [x.decode() for x in words(t)]
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed)
        assert r["kept"] == (not failed and r["score"] >= quality.LEAST)


def test_quality_score_is_the_mean_log_ratio(spark):
    rows = [(1, "a b", "s"), (2, "a c", "s"), (3, "b b b", "s")]
    df = table(spark, rows)
    got = {r["doc_id"]: r["score"] for r in quality.quality(df, df.where("doc_id = 1"), buckets=64).collect()}
    bucket = {r["g"]: r["b"] for r in spark.sql("select x as g, cast(pmod(xxhash64(x), 64) as int) b from values 'a', 'b', 'c' t(x)").collect()}
    pair = {(r["x"], r["y"]): r["b"] for r in spark.sql("select x, y, cast(pmod(xxhash64(xxhash64(x), xxhash64(y)), 64) as int) b from values ('a','b'), ('a','c'), ('b','b') t(x, y)").collect()}
    grams = {i: [bucket[x] for x in t.split()] + [pair[p] for p in itertools.pairwise(t.split())] for i, t, _ in rows}
    raw, own = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    ratio = lambda g: round(1e6 * (math.log((own[g] + 0.5) / (sum(own.values()) + 32)) - math.log((raw[g] + 0.5) / (sum(raw.values()) + 32))))
    for i, x in grams.items():
        assert math.isclose(got[i], sum(map(ratio, x)) / len(x) / 1e6, abs_tol=2e-6)


def test_near_duplicates(spark, rows):
    for shingle in (2, 5):
        got = near_dedup.near_duplicates(spark, table(spark, rows), shingle, 80).collect()
        lower = lambda t: [x.lower() for x in words(t)]
        make = lambda w: {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
        sets = {i: make(lower(t)) for i, t, _ in rows if i is not None}
        parent = {i: i for i in sets}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]), root(r["doc_id"]) == r["doc_id"])


def _components(texts, shingle, percent=80):
    """Per place of texts the least place that links lead to."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)})
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            comp[b] = a
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("blocks", [(2048, 512), (16, 8)])
def test_near_duplicates_of_many_under_the_similarity(spark, monkeypatch, blocks):
    """A group whose members are mostly less alike than 0.8 to its centre, some of them alike to one another; also dealt in small blocks."""
    monkeypatch.setattr(near_dedup, "BITS_BLOCK", blocks[0])
    monkeypatch.setattr(near_dedup, "SETS_BLOCK", blocks[1])
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in range(8):
            w[(7 * (i // 2) + k) % 60] = f"x{i // 2}_{k}"
        if i % 2:
            w[r.randrange(60)] = "y"
        texts.append(" ".join(w))
    texts += [" ".join(w if r.random() > 0.04 else f"z{r.randrange(10**6)}" for w in base) for _ in range(60)]
    expected = _components(texts, 2)
    assert 10 < len(set(expected)) < len(texts)
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark, table(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(5), 2, 80).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_near_duplicates_rows(spark):
    """Different texts under one id are placed each by its own; null ids, empty texts and exact copies; long texts; clashing columns."""
    a, b, long = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 40), ("b", 40), ("c", 30_000)))
    docs = [(3, a, "s"), (3, b, "s"), (5, a + " x", "s"), (6, b + " y", "s"), (7, long, "s"), (8, long + " z", "s"), (9, "", "s"), (10, "", "s"), (None, a, "s"), (11, a.upper(), "s"), (11, a.upper(), "s")]
    got = near_dedup.near_duplicates(spark, table(spark, docs), 2, 80, with_key=True).collect()
    assert Counter((x["doc_id"], x["component_id"], x["kept"]) for x in got) == Counter([(3, 3, True), (3, 3, True), (5, 3, False), (6, 3, False), (7, 7, True), (8, 7, False), (9, 9, True), (10, 10, True), (None, None, True), (11, 3, False), (11, 3, False)])
    assert len({x["group"] for x in got if x["doc_id"] == 3}) == 2


def test_shared_counts():
    import numpy as np

    r = random.Random(2)
    sets = [np.unique(np.array([r.randrange(300) for _ in range(r.randrange(1, 120))], np.uint64)) for _ in range(25)]
    for width in (7, 4096):
        assert near_dedup.shared_counts(sets, width).tolist() == [[len(set(x.tolist()) & set(y.tolist())) if i != j else near_dedup.shared_counts(sets)[i][i] for j, y in enumerate(sets)] for i, x in enumerate(sets)]


def test_token_records(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    manifest = tokens.write_records(table(spark, rows), tokenizer("byte_bpe_50k.json"), 2, f"file://{tmp_path}/records")
    got = tokens.read_records(manifest).orderBy("start").collect()
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x, _ in rows}
    assert [r["doc_id"] for r in got] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        own = ids[r["doc_id"]] if r["doc_id"] != 3 else ids[3]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)))
        start += len(own)
    path = got[0]["path"]
    last = [r for r in got if r["path"] == path][-1]
    key, found = next(tokens.read_shard(path, [last["record"]]))
    assert key == last["doc_id"] and found.tolist() == ids[key]
    record = tokens.framed(b"abc")
    assert tokens.unframed(memoryview(record)) == b"abc"
    with pytest.raises(ValueError):
        tokens.unframed(memoryview(record[:-5] + b"x" + record[-4:]))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_equals_the_library(name):
    r = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "'s", "'ll", "1", "23", "<|endoftext|>", " ", "\x1c", "!?", "日本", "́", "ß", "Σ", "İ", "\r\n", "\x85", "abc.", "q's.", "̸", "<", "\0", "\u2003", "\u201c", "\n\n", " \n", "word", " word", " word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(r.choice([" ", " ", "\n", "a", "bc", "é", ".", "'s", " w"]) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    m = tokens.Memo(tokenizer(name), most=500)
    assert [x for i in range(0, 3000, 100) for x in m.encode(texts[i : i + 100])] == [m.whole(t) for t in texts]


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.encode_special_tokens = True
    many = rows + [(100 + i, prose(random.Random(i), 40 + 7 * (i % 50)), "s") for i in range(200)]
    df = table(spark, many).repartition(40)
    got = packing.pack_documents(spark, df, tokenizer("word_bpe_49k.json"), 1, length=256, most_open=4, with_ids=True).collect()
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, _ in many]
    by_doc = {}
    for r in got:
        own = [int.from_bytes(r["ids"][k : k + 2], "little") for k in range(0, len(r["ids"]), 2)]
        assert len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        by_doc.setdefault(r["doc_id"], Counter())[r["start"], tuple(own), r["doc_tokens"]] += 1
    expected = {}
    for i, x in ids:  # each piece is the ids from its start on, in their order
        for at in range(0, len(x), 256):
            expected.setdefault(i, Counter())[at, tuple(x[at : at + 256]), len(x)] += 1
    assert by_doc == expected
    per = {}
    for r in got:
        per.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in per.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(n for x in per.values() for _, n in x) / (256 * len(per)) > 0.9


def test_media(spark, rows):
    got = media.document_media(spark, table(spark, rows)).collect()
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t or "")
    assert len(got) == len(rows)
    for r in got:
        data = texts[r["doc_id"]][0].encode()
        pay = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        made = io.BytesIO()
        with wave.open(made, "wb") as f:  # the standard library's form of the same samples
            f.setnchannels(1)
            f.setsampwidth(1)
            f.setframerate(8000)
            f.writeframes(pay)
        assert r["media_bytes"] == len(pay) + 44 and r["media_sha256"] == hashlib.sha256(made.getvalue()).hexdigest() and media.samples_of(media.wave(pay)) == pay
        rms = math.sqrt(sum((x - 128) ** 2 for x in pay) / len(pay))
        crossings = sum((x >= 128) != (y >= 128) for x, y in itertools.pairwise(pay))
        assert r["feature"] == f"mean={sum(pay) / len(pay):.3f};rms={rms:.3f};zcr={1000 * crossings / len(pay):.3f}"
        assert r["caption"] == f"payload of document {r['doc_id']}" and r["position"] == (1 if texts[r["doc_id"]][0].split() else 0)


def test_media_sequences():
    html = '<p>one &amp; two</p><figure><img src="sha256:ab" alt="alt"><figcaption>the <b>caption</b></figcaption></figure><p>three<img src="u" alt="x">four</p>'
    assert [(e["position"], e["kind"], e["text"], e["ref"], e["caption"]) for e in media.sequence_of(html)] == [
        (0, "text", "one & two", None, None), (1, "image", None, "sha256:ab", "the caption"), (2, "text", "three", None, None), (3, "image", None, "u", "x"), (4, "text", "four", None, None),
    ]


def test_licenses(spark, rows):
    notices = [(200, "x MIT License y mit license", "s"), (201, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute", "s"),
               (202, "Licensed under the Apache License, Version 2.0.", "s"), (203, "license " * 5000, "s"), (204, "GNU GENERAL-PUBLIC license", "s")]
    got = {}
    every = rows + notices
    for r in licenses.license_scan(table(spark, every)).collect():
        got[r["doc_id"]] = r
    for i, t, _ in every:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(p, label) for phrase, label in licenses.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        base = ",".join(sorted({x for _, x in places}))
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), base)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(base.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[201]["labels"] == "mit" and got[201]["n_base"] == 0 and got[204]["labels"] == "gpl" and got[203]["labels"] == ""


def _scan(text):
    return licenses.Index().scan(licenses._hashes(licenses.words_of(text)))


def test_licenses_all_rare_words():
    index = licenses.Index()
    names = {int(licenses._hashes([w])[0]): w for n in licenses.NOTICES for w in licenses.words_of(n[2])}
    rare = [names[h] for h in index.words[index.rare].tolist()]
    for label, _, notice in licenses.NOTICES:  # a long text that holds each other rare word, before a notice
        own = licenses.words_of(notice)
        assert label in _scan(" ".join([*(w for w in rare if w not in own), "filler " * 90, notice]))[0]
    assert set(_scan(" ".join(n[2] for n in licenses.NOTICES))[0]) == {n[0] for n in licenses.NOTICES}


def test_licenses_each_alignment():
    """Against each place of each notice: notices after similar or damaged ones, and texts of their words alone."""
    index, r = licenses.Index(), random.Random(5)
    texts = {label: notice for label, _, notice in licenses.NOTICES}
    affero = "under the terms of the gnu affero general public license as published by the free software foundation, version 3 of the license"
    assert set(_scan(f"{licenses.NOTICES[5][2]} {'x ' * 90} {affero}")[0]) == {"gpl", "agpl"}
    assert "isc" in _scan(texts["isc"].replace("copy", "x") + " x" * 90 + " " + texts["isc"])[0]
    names = sorted({w for n in licenses.NOTICES for w in licenses.words_of(n[2])})
    for _ in range(60):
        made = [licenses.words_of(r.choice(licenses.NOTICES)[2])[r.choice([0, 0, 3]) :] if r.random() < 0.7 else r.choices([*names, "x"], k=30) for _ in range(r.randrange(5))]
        words = [w for x in made for w in x if r.random() < 0.95]
        found, most = {}, 0.0
        for (label, phrases, notice), own in zip(licenses.NOTICES, index.notices, strict=True):
            n, rare = licenses.words_of(notice), set(index.words[index.rare].tolist())
            doc = licenses._hashes(words).tolist() if words else []
            gaps = Counter(p - i for p, h in enumerate(doc) for i, k in enumerate(own.tolist()) if h == k and h in rare)
            for g in gaps if len(rare & set(doc)) > 1 else ():
                if sum(gaps[g + d] for d in range(licenses.SLACK + 1)) > 1:
                    text = words[max(0, g) : g + licenses.SLACK + len(n)]
                    share = sum(w in text for w in n) / len(n)
                    keys = all(f" {' '.join(licenses.words_of(p))} " in f" {' '.join(text)} " for p in phrases)
                    if keys and share >= licenses.LEAST:
                        found[label] = max(found.get(label, 0), share)
                    most = max(most, share if keys else share / 2)
        assert _scan(" ".join(words)) == (found, most)


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>Home</a></nav><header>Site</header><div class='cookie-notice'>We use cookies</div><article><header><h1>Title&nbsp;here</h1></header><p>First <b>bold</b>\n text &amp; more of it, long enough.</p><aside>related</aside><p>Short.</p><form>search</form></article><div id=comments><p>A long comment by a reader of this very page, indeed.</p></div><footer>&copy; x</footer></body></html>"
    assert main_text(page)[0] == "Title here First bold text & more of it, long enough. Short."
    plain = "<body><div class='menu'><a>1</a><a>2</a></div><div><p>" + "word " * 60 + "</p><p>tail</p></div></body>"
    assert main_text(plain)[0] == ("word " * 60).strip() + " tail"
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (2, "u", page), (None, None, "<p>x")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract_text(df).collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, main_text(page)[0], len(main_text(page)[0]))]


def _page(r, landmark, hinted):
    """A page of known main text: an article of paragraphs and short lines among what isn't."""
    say = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet tempor magna aliqua".split()) for _ in range(n))
    blocks, main, tag = [], [], r.choice(["article", "main"]) if landmark else "div"
    for _ in range(r.randrange(3, 9)):
        t = say(r.choice([1, 3, 40, 60, 80]))
        main.append(t)
        blocks.append(r.choice(["<p>{}</p>", "<p><b>{}</b></p>", "<section><p>{}</p></section>", "<ul><li>{}</li></ul>", "<h2>{}</h2>"]).format(t))
    main.append(long := say(90))
    blocks.append(f"<p>{long}</p>")
    if hinted:
        blocks.insert(r.randrange(len(blocks)), f"<div class='ad box'>{say(30)}</div>")
    links = "".join(f"<li><a href='{k}'>{say(1)}</a></li>" for k in range(r.randrange(3, 9)))
    return f"<html><body><nav><ul>{links}</ul></nav><div class='menu'>{links}</div><{tag} id=text>{''.join(blocks)}</{tag}><div id='comments'><p>{say(40)}</p></div><footer>{say(12)}</footer></body></html>", " ".join(main)


def test_html_of_known_text():
    r = random.Random(9)
    for _ in range(300):
        page, text = _page(r, r.random() < 0.5, r.random() < 0.5)
        assert main_text(page)[0] == text


def test_html_clusters_choose():
    """Without landmarks or hints: the container of the long lines, not those of link lists and short ones. A threshold that
    admits every line takes other text."""
    links = "".join(f"<li><a href=x>word {k}</a></li>" for k in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><p>{'long text ' * 40}</p><p>Short.</p><p>{'more text ' * 30}</p></div><div><ul>{links}</ul></div></body>"
    text = f"Title {('long text ' * 40).strip()} Short. {('more text ' * 30).strip()}"
    assert main_text(page)[0] == text and main_text(page, deviations=99)[0] != text


def test_html_long_pages():
    began = time.time()
    for page in ("<div>" * 100_000 + "deep", "<div>" * 50_000 + "</section>" * 50_000 + "x", "<article><p>one two</p></article>" * 16_000, "<svg>" * 50_000 + "</title>" * 50_000, "<!--" * 50_000, "<a " * 50_000, "<p>" + "word " * 200_000):
        main_text(page)
    assert time.time() - began < 40
    assert main_text("<p>text <a href='unfinished")[0] == "text" and main_text("<p>" + "word " * 200_000)[0] == ("word " * 200_000).strip()


def test_toxicity_is_noisy_or(spark):
    """Scores against sentences and words taken one by one, and training against its likelihood's slope."""
    import numpy as np

    known = sorted(zip(Words(pa.array(["zork blim"])).hashes.tolist(), [3.0, 1.5], strict=True))
    model = toxicity.Model(np.array([h for h, _ in known], np.uint64), np.array([w for _, w in known]), -2.0)
    texts = ["zork blim. plain words", "Zork! zork? ZORK", "none here", "", None, "blim\nblim blim"]
    got = [x["score"] for x in toxicity.scored(table(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(1).orderBy("doc_id"), model, names=("h", "_score", "p")).select("doc_id", F.col("_score").alias("score"), F.col("score").alias("own")).orderBy("doc_id").collect()]
    weight = {"zork": 3.0, "blim": 1.5}
    for t, s in zip(texts, got, strict=True):
        none = 1.0
        for x in re.split(r"[.!?\n]", (t or "").lower()):
            if x.split():
                none *= 1 - 1 / (1 + math.exp(2.0 - sum(weight.get(w, 0) for w in set(x.split()))))
        assert math.isclose(s, 1 - none, abs_tol=1e-12)


def test_toxicity_sample_is_bounded(spark):
    """By rows and by bytes; texts of any length are learned from, whole."""
    df = table(spark, [(i, ("long " * 20_000 if i % 3 == 0 else "short") + f" {i}", "s") for i in range(60)] + [(61, None, "s")])
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(62)] + [(2, 1, 1)], "doc_id long, quality int, toxic int")
    free = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    every = toxicity.sample(df, known).toArrow().to_pylist()
    assert len(every) == len(free) and sum(len(x["text"]) > 90_000 for x in every) == sum(i % 3 == 0 for i in free)
    assert all(x["toxic"] == (int(x["text"].split()[-1]) % 2 or x["text"] == "short 2") for x in every)
    assert toxicity.sample(df, known, rows=7).count() == 7
    assert 0 < sum(len(x["text"]) for x in toxicity.sample(df, known, most_bytes=300_000).toArrow().to_pylist()) <= 300_000


def test_toxicity_rarest_word():
    """An offending word is fitted although 45,000 other words are in more documents than it."""
    r, docs = random.Random(3), [[] for _ in range(100)]
    for k in range(45_000):
        for i in r.sample(range(100), 8):
            docs[i].append(f"{k:05d}")
    made = [(" ".join(d) + (". vile." if i < 6 else "."), int(i < 6)) for i, d in enumerate(docs)]
    model = toxicity.train(pa.table({"text": [t for t, _ in made], "toxic": [y for _, y in made]}))
    chance, _ = toxicity.chances(model, Words(pa.array(["vile", "other"]), NOT_ALNUM, lower=True))
    assert Words(pa.array(["vile"])).hashes[0] in model.features and chance[0] > chance[1]


def test_toxicity(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(900):
        s = [prose(r, 8) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            s[r.randrange(6)] += " " + r.choice(["zork", "blimpo", "grunthead"])
        docs.append((i, ". ".join(s), "s"))
        labels.append((i, 1, int(bad)))
    docs += [(None, "zork", "s"), (901, None, "s"), (902, "", "s"), (902, "", "s"), (903, "nice " * 20000, "s")]
    df, known = table(spark, docs), spark.createDataFrame(labels + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(toxicity.sample(df, known))
    got = toxicity.scored(df, model).collect()
    assert len(got) == len(docs) and set(got[0].asDict()) >= {"lang", "held_out", "score", "predicted"}
    toxic = dict((i, t) for i, _, t in labels)
    held = [(toxic[x["doc_id"]], x["predicted"]) for x in got if x["held_out"] and x["doc_id"] in toxic]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in got if x["doc_id"] is not None)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert {x["score"] for x in got if x["doc_id"] in (901, 902)} == {0.0}
    found = toxicity.offending_sentences(df.where("doc_id = 0"), model).collect()
    assert len(found) == 1 and re.search("zork|blimpo|grunthead", found[0]["text"])


def test_empty_tables(spark):
    e = spark.createDataFrame([], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substrings.substring_dedup(e).count() == mixing.mix(e).count() == quality.quality(e, none).count() == licenses.license_scan(e).count() == 0
    assert near_dedup.near_duplicates(spark, e).count() == packing.pack_documents(spark, e, tokenizer("word_bpe_49k.json"), 1).count() == media.document_media(spark, e).count() == 0
    assert tokens.token_records(spark, e, tokenizer("byte_bpe_50k.json"), 2).count() == 0
    assert toxicity.scored(e, toxicity.fitted(toxicity.sample(e, none))).count() == 0
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert substrings.longest_repeats(e).count() == 0 and F is not None
