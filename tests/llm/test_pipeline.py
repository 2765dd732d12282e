"""The pipeline against a brute-force version of its stages, on a small table."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from tessera.llm.mixing import SEED
from tessera.llm.queries import tokenizer

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(11)
    word = lambda: r.choice("the of and to a in that it was for on are as with his they at be".split()) + r.choice(["", "s", "ed", "er", "xo", "mi"])
    prose = lambda n: ". ".join(" ".join(word() for _ in range(8)) for _ in range(n))
    docs, labels = [], []
    for i in range(420):
        t = prose(6)
        bad = i % 6 == 0
        if bad:
            t += ". " + word() + " " + r.choice(["zork", "blimpo"]) + " " + word()
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, 1, int(bad)))
    passage = prose(4)
    for i in range(420, 430):  # near copies
        t = docs[i - 419][1] + (" tail" if i % 2 else "")
        docs.append((i, t, "en", "s1", len(t)))
    for i in range(430, 440):  # a shared passage
        t = prose(5) + "\n" + passage + "\n" + prose(5)
        docs.append((i, t, "en", None, len(t)))
    return docs, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels = fixture()
    at = f"file://{tmp_path}"
    spark.createDataFrame(docs, DOC).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")

    df = spark.read.parquet(f"{at}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, df, at)
    assert clean.columns == df.columns
    toxic = {i for i, _, t in labels if t}
    kept = {r["doc_id"]: r for r in clean.collect()}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 3 == 1}
    assert len(toxic & set(kept)) <= 1 and len(held - set(kept)) >= 0.9 * len(held)
    assert len(kept) >= 0.99 * (len(docs) - len(toxic))

    sets = {}
    for i, row in kept.items():
        w = row["text"].lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    stay = sorted(i for i in sets if root(i) == i)
    assert len(stay) < len(sets)

    seen, text = {}, {}
    for i in stay:
        w = kept[i]["text"].split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) < (i, k):
                gone[k : k + 20] = [True] * 20
        text[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else kept[i]["text"]
    assert any(text[i] != kept[i]["text"] for i in stay)

    size, by_source = {i: len(text[i].split()) for i in stay}, defaultdict(list)
    for i in stay:
        by_source[kept[i]["source"]].append(i)
    total = {s: sum(size[i] for i in ids) for s, ids in by_source.items()}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        left = 1.5 * sum(total.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} or share
        free = free - over if over else set()
    copies = {}
    for s, ids in by_source.items():
        import hashlib

        shift = int(hashlib.md5(f"{SEED}:{'s' + s if s is not None else 'null'}".encode()).hexdigest()[:8], 16) / 2**32
        each = target[s] / total[s]
        for k, i in enumerate(sorted(ids, key=lambda i: (size[i], i))):
            copies[i] = math.floor((k + 1) * each + shift) - math.floor(k * each + shift)

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    t.encode_special_tokens = True
    expected = Counter()
    for i in stay:
        for start in range(0, n := len(t.encode(text[i], add_special_tokens=False).ids) + 1, 2048):
            expected[i, start, min(2048, n - start), n] += copies[i]
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in got) == +expected
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048


EDGES = DOC + ", score double, kept string, id string, row int, copy string, rest string, text_key int, component_id string, size string, target string, part string, n_removed string"


def edge_rows(rows):
    return [(*r, 9.25, "k", "i", 1, "c", "r", 2, "d", "z", "t", "p", "n") for r in rows]


def test_stages_keep_rows_and_columns(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, ties, a long text and clashing column names; then empty tables."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    plain = [(1, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (2, a, "en", "s", len(a)), (3, "", "en", None, 0), (3, "", "en", None, 0), (4, None, None, None, None), (None, a + " q", "en", "s", 5), (None, None, None, None, None)]
    plain += [(5, b + " " + a, "en", "t", 7), (6, "long " * 50_000, "en", "t", 250_000), (7, "x", "en", "t", 1), (7, "y", "en", "t", 1)]
    rows = edge_rows(plain)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    at = f"file://{tmp_path}"

    def got(stage, docs):
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        return Counter(map(tuple, out.collect()))

    assert got(corpus_pipeline.toxicity, df) == Counter(rows)
    kept = got(corpus_pipeline.near_dedup, df)
    assert kept == Counter(edge_rows([plain[0], plain[3], *plain[5:]]))
    cut = got(corpus_pipeline.substrings, df)
    assert Counter((r[0], r[1], r[4]) for r in cut.elements()) == Counter([(1, a, len(a)), (2, "", 0), (2, "", 0), (3, "", 0), (3, "", 0), (4, None, None), (None, "q", 1), (None, None, None), (5, b, len(b)), (6, "long", 4), (7, "x", 1), (7, "y", 1)])
    assert {r[5:] for r in cut} == {r[5:] for r in rows}
    mixed = got(corpus_pipeline.mixing, df)
    assert set(mixed) <= set(rows) and max(mixed[r] / rows.count(r) for r in mixed) <= 2
    assert {r["doc_id"] for r in corpus_pipeline.packing(spark, df, at).collect()} == {r[0] for r in rows}
    none = spark.createDataFrame([], EDGES)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0
    bare = df.drop("n_chars")
    assert corpus_pipeline.substrings(spark, bare, at).columns == bare.columns
