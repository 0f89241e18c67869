"""Small tests of every operator: against brute force, SQL or an exact round trip, and their edge cases."""

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import ann, bpe, components, langid, line_dedup, lm, mixing, queries, simhash, sketch, toxicity, warc
from tests.conftest import DATA, assert_same

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")
CLASH = ["size", "h", "__th", "__id", "__drop", "__l", "__text_hash", "__n_removed", "__hash", "__source", "__epochs", "__cut", "__epoch", "run", "fp"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
#: Nulls in any column, empty and long texts, ties, repeated rows, columns that clash with inner names.
ODD = [
    (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a b c d e f", "de", None, 11),
    (4, "   \n\n\n\n ", None, "t", 8), (5, "wort " * 30000, "de", "t", 150000), (6, "!!! 123", "en", "t", 7), (7, "\x00é日本<|endoftext|>", "ja", "t", 5), (8, "one\ntwo\nthree\nfour", "en", "t", 18),
    (9, "zero\none\ntwo\nthree\nfour", "en", "u", 23), (1, "quite another text that has the same id", "en", "s", 39), (None, None, None, None, None),
]
ODD = [(*r, *["c"] * len(CLASH)) for r in ODD]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def test_every_operator_on_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    for df, n in ((odd, len(ODD)), (none, 0)):
        runs = [
            langid.predict(df, langid.fit(df)), sketch.fingerprints(df), bpe.encode_digests(df, TOKENIZER), toxicity.score(df, toxicity.fit(df, labels)), mixing.mix(df),
            simhash.link(df), lm.Trained(df.select("text"), 1000).score(df), line_dedup.dedup_lines(df),
        ]
        for out in runs:
            assert len(out.collect()) == n
    assert {r["lang_pred"] for r in langid.predict(odd.where("doc_id IN (2, 3, 4, 6)"), langid.fit(odd)).collect()} == {"und"}


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 0), (3, 0), (4, None), (None, 1), (99, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for df in (odd, none):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert name == "bpe" or docs.columns == df.columns, name
        assert (docs.count() > 0) == (df is odd)
    lines = {(r["doc_id"], r["text"], r["n_chars"], r["__drop"]) for r in corpus_pipeline.dedup_lines(spark, odd, "").where("doc_id > 7").collect()}
    assert lines == {(8, "one\ntwo\nthree\nfour", 18, "c"), (9, "zero", 4, "c")}
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(odd).collect())
    assert kept[1, "a b c d e f"] == kept[1, "quite another text that has the same id"] == kept[None, "a b c d e f"] == 1
    assert kept[2, None] == 1 and (3, "") not in kept and (4, ODD[5][1]) not in kept and set(kept.values()) == {1}


def test_mixed_documents_are_those_that_the_mix_takes(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["doc_id"]: r["epochs"] + r["in_last_pass"] for r in mixing.mix(df).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(df).collect())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_language_model_is_a_distribution(spark):
    rows = [("en", "the cat sat on the mat " * 5), ("de", "die katze sitzt auf der matte " * 5)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "doc_id long, lang string, text string")
    m = langid.fit(df)
    p = np.exp2(-m.bits.astype(float)).reshape(-1, m.symbols, 2)
    p[:, -1] *= 256 - (m.symbols - 1)
    assert np.allclose(p[1:].sum(1), 1, atol=1e-4)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, m).collect()}
    assert got == {0: "en", 1: "de"}


def test_language_model_against_brute_force(spark):
    rng = random.Random(21)
    rows = [(i, "xy"[i % 2], "".join(rng.choices("abcd" if i % 2 else "abce", [4, 3, 2, 1], k=rng.randint(1, 60)))) for i in range(12)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    after: dict = {}
    known = set()
    for _, lang, t in rows:
        for i in range(len(t)):
            for d in range(min(i, 3) + 1):
                known.add(t[i - d : i])
                after.setdefault((lang, t[i - d : i]), Counter())[t[i]] += 1
        known |= {t[-d:] for d in range(1, 4) if len(t) >= d}

    def chances(lang, context):
        shorter = chances(lang, context[1:]) if context else dict.fromkeys(map(chr, range(256)), 1 / 256)
        c = after.get((lang, context), {})
        if not c:
            return shorter
        unseen = sum(p for x, p in shorter.items() if x not in c)
        whole = sum(c.values()) + len(c)
        return {x: c[x] / whole if x in c else len(c) / whole * p / unseen for x, p in shorter.items()}

    texts = ["abacabad", "d", "eeee", "abcdzabc", "".join(rng.choices("abcdez", k=80))]
    got = m.code_lengths([t.encode() for t in texts])
    for t, bits in zip(texts, got, strict=True):
        for lang, b in zip(m.langs, bits, strict=True):
            want = 0.0
            for i, x in enumerate(t):
                context = next(t[i - d : i] for d in range(min(i, 3), -1, -1) if t[i - d : i] in known or d == 0)
                want -= math.log2(chances(lang, context)[x])
            assert math.isclose(b, want, rel_tol=1e-5)


def test_language_model_keeps_within_its_cells(spark):
    rng = random.Random(22)
    rows = [(i, "xy"[i % 2], "".join(rng.choices("abcdefgh", k=200))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    full, small = langid.fit(df), langid.fit(df, cells=2 * 9 * 60)
    assert full.bits.size > small.bits.size <= 2 * 9 * 60
    p = np.exp2(-small.bits.astype(float)).reshape(-1, small.symbols, 2)
    p[:, -1] *= 256 - (small.symbols - 1)
    assert np.allclose(p[1:].sum(1), 1, atol=1e-4)


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(23)
    w = [f"w{rng.randint(0, 9**9)}" for _ in range(3000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:1000])), (3, " ".join(w[996:])), (4, " ".join(w[:60])), (5, "")]
    d = {r["doc_id"]: r["s"] for r in sketch.with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s").collect()}
    pair = spark.createDataFrame([(i, j, d[i], d[j]) for i in d for j in d], "i long, j long, a array<long>, b array<long>")
    a, b = F.col("a"), F.col("b")
    got = {(r["i"], r["j"]): r for r in pair.select("i", "j", sketch.merge(a, b).alias("m"), sketch.containment(a, b).alias("c"), sketch.resemblance(a, b).alias("r")).collect()}
    assert got[2, 3]["m"] == d[1]  # the parts' shingles are all of the whole's
    assert got[4, 5]["m"] == d[4] and got[5, 5]["r"] == 1 and got[5, 4]["r"] == 0
    assert got[4, 2]["c"] > 0.8 and got[2, 1]["c"] > 0.8 and abs(got[1, 2]["c"] - 1 / 3) < 0.15 and got[2, 3]["c"] < 0.1


def test_sketch_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 40, 900]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    for r in sketch.fingerprints(df).collect():
        i = r["doc_id"]
        t, nxt = texts[i], texts[(i - 1) % len(texts)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r["near_edited"] - true) <= (1e-9 if len(a | b) <= sketch.K else 0.2)
        assert abs(r["distinct_shingles"] - len(a)) <= (0 if len(a) < sketch.K else 0.4 * len(a))


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, c, rng = Tokenizer.from_file(TOKENIZER), bpe.Codec(TOKENIZER), random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "日本", "'s", "1", "½", "!", "<|endoftext|>", "\x1c", "\x85", " ", "　", "😀", "the", "\r\n", "\x00", "aaaa"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["a" * 3000, " ", ""]
    for got, want in zip(c.encode_batch(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert c.ids(got) == want.ids
        assert c.decode_text(got) == c.decode(want.ids) == t.decode(want.ids, skip_special_tokens=False)


def test_bpe_gives_ids_and_text(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for r in bpe.encode(odd, TOKENIZER, keep=("doc_id", "text", "run")).collect():
        assert r["ids"] == t.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == t.decode(r["ids"], skip_special_tokens=False) and r["run"] == "c"
    for r in bpe.encode_digests(odd, TOKENIZER, with_ids=True).collect():
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()


def test_bpe_gives_out_short_runs_of_a_large_batch():
    from tokenizers import Tokenizer

    class Frame:
        select, mapInArrow = lambda self, *_: self, lambda self, run, _: run

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(2, 9))) for _ in range(500)]
    texts = [None, "", *(" ".join(rng.choices(words, k=150)) for _ in range(1500)), " ".join(rng.choices(words, k=90_000)), "end", None]
    run = bpe.encode_digests(Frame(), TOKENIZER, with_ids=True)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    got = list(run(iter([batch.slice(0, 0), batch, batch.slice(1, 3)])))
    # a run ends with the text that fills it
    assert all(sum(len(texts[i] or "") for i in b["doc_id"].to_pylist()[:-1]) < 250_000 for b in got) and len(got) > 6
    rows = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), 1, 2, 3]
    t = Tokenizer.from_file(TOKENIZER)
    for r in rows:
        ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_learns_a_pair(spark):
    rng, rows = random.Random(2), []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(["word", *["zork"] * insult, *["blim"] * group, f"u{i}"]), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] >= 0.7 for r in toxicity.score(df, m).collect()}
    assert all(got[i] == bool(y) for i, _, y in rows)
    assert toxicity.keep_clean(df, m).count() == sum(1 - y for *_, y in rows)


def test_mixing_targets(spark):
    rng = random.Random(4)
    for _ in range(3):
        size = {("s%d" % i if i else None): rng.choice([0, 5, 1000, 100000]) + rng.randint(0, 9) for i in range(rng.randint(1, 9))}
        names = sorted(size, key=lambda x: (x is None, x))
        weight, left, want, free = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, sum(size.values()), {}, set(names)
        while free:
            level = left / sum(weight[n] for n in free)
            over = [n for n in free if level * weight[n] > 3 * size[n]]
            want.update({n: 3 * size[n] for n in over} if over else {n: level * weight[n] for n in free})
            left -= sum(want[n] for n in over)
            free = free - set(over) if over else set()
        got = mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()
        assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"]) for r in got)


def test_simhash_components(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(60)) for _ in range(25)]
    texts = base + [t.replace(t.split()[7], "zz", 1) for t in base] + base[:5] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = np.array([int.from_bytes(simhash.fingerprint(t, 3), "little") for t in texts], np.uint64)
    w = (texts[0]).encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert int(v[0]) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    label = list(range(len(v)))
    for _ in range(len(v)):
        for i in range(len(v)):
            near = np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 3)
            low = min(label[j] for j in near)
            for j in near:
                label[j] = min(label[j], low)
    assert {r["doc_id"]: r["component_id"] for r in simhash.link(df).collect()} == dict(enumerate(label))
    # chunked comparison of a hot key finds the same forest's components
    few = spark.createDataFrame([(i, bytearray(simhash.fingerprint(t, 3))) for i, t in enumerate(base + texts[25:50])], "id long, fp binary").dropDuplicates(["fp"])
    keys = simhash.pigeonhole_keys(5, 3)
    pairs = lambda chunk: {r["node"]: r["root"] for r in simhash.components(simhash.close_edges(few, keys, 30, chunk)).collect()}
    a, b = pairs(2048), pairs(2)
    assert {frozenset(k for k in a if a[k] == r) for r in a.values()} == {frozenset(k for k in b if b[k] == r) for r in b.values()}
    assert simhash.keep_one(df).count() < len(texts)


def test_near_copies_are_linked_by_simhash_and_checked_on_the_sets(spark):
    rng = random.Random(5)
    texts = ["", "one", "two words"]
    for n in (60, 300, 900):
        for _ in range(10):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
            texts.append(" ".join(base))
            for k in (1, 2):
                texts.append(" ".join([*base[:-k], *(f"x{rng.randint(0, 9999)}" for _ in range(k))]))
    sets = [simhash.shingle_set(t, 5) for t in texts]
    ids, fps = [simhash.set_id(s) for s in sets], [simhash.majority(s[:, None]) for s in sets]
    bits = [int.from_bytes(f, "little") for f in fps]
    alike = lambda a, b: len(both := set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) and both
    want = {(ids[i], ids[j]) for i in range(len(texts)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3 and alike(sets[i], sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # no minima: the fingerprints alone name the candidates
    prints = spark.createDataFrame([(i, n, [], bytearray(f)) for i, (n, f) in enumerate(zip(ids, fps, strict=True))], "doc_id long, id long, keys array<bigint>, fp binary")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_edges(docs, prints, 5, 0.8)).collect()}
    assert len(want) > 20 and all(roots[a] == roots[b] for a, b in want)
    of = dict(zip(ids, sets, strict=True))
    assert all(alike(of[r["a"]], of[r["b"]]) for r in simhash.near_edges(docs, prints, 5, 0.8).collect())
    # fingerprints that link and sets that don't resemble each other
    false = spark.createDataFrame([(i, n, [], bytes(8)) for i, n in enumerate(ids[:13:3])], "doc_id long, id long, keys array<bigint>, fp binary")
    assert simhash.near_edges(docs, false, 5, 0.8).count() == 0


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "one two"]
    for n in (40, 60, 120, 300):
        for _ in range(12):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 2, 3, 5, 7, 9):
                copy = list(base)
                for at in rng.sample(range(n), min(edits * n // 300 + 1, n)):
                    copy[at] = f"x{rng.randint(0, 9999)}"
                texts.append(" ".join(copy))
    shared = [f"s{i}" for i in range(104)]
    texts += [" ".join(shared[: 104 - 10 * (k % 2)] + [f"t{k}-{i}" for i in range(4 + k % 7)]) for k in range(30)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    close = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) / len(a | b) >= 0.8]
    assert sum(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.84 for i, j in close if sets[i]) > 20
    name = list(range(len(texts)))
    while any(name[i] != name[j] for i, j in close):
        for i, j in close:
            name[i] = name[j] = min(name[i], name[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (2048, 4):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, chunk=chunk).collect()} == dict(enumerate(name))


def test_components_of_paths_stars_and_extreme_ids(spark):
    ids = [0, -1, 1, 2**63 - 1, -(2**63), 2**33, 2**33 + 1, 5 << 33]
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    for seed in (0, 1, 7):
        got = [(r["v"], r["x"], r["y"]) for r in df.withColumn("x", components.shuffled(F.col("v"), seed)).withColumn("y", components.unshuffled(F.col("x"), seed)).collect()]
        assert all(v == y for v, _, y in got) and len({x for _, x, _ in got}) == len(ids)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(-(2**63), 2**63 - 1), (7000, 7000)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    sizes = Counter(r["root"] for r in got)
    assert sorted(sizes.values()) == [2, 200, 301] and len({r["node"] for r in got}) == 503


def test_close_edges_connect_keys_of_every_size(spark):
    rng = np.random.default_rng(9)
    fps = []
    for size in (2, 3, 4, 5, 9, 40):
        centre = rng.integers(0, 2, 64)
        for _ in range(size):
            bits = centre.copy()
            bits[rng.choice(64, 2, replace=False)] ^= 1
            fps.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    fps = sorted(set(fps))
    v = np.array([int.from_bytes(f, "little") for f in fps], np.uint64)
    close = {(i, j) for i in range(len(v)) for j in range(i) if np.bitwise_count(v[i] ^ v[j]) <= 3}

    def sets(edges):
        name = list(range(len(fps)))
        for _ in fps:
            for a, b in edges:
                name[a] = name[b] = min(name[a], name[b])
        return name

    classes = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(fps)], "id long, fp binary")
    for chunk in (2048, 4):
        edges = {(r["a"], r["b"]) for r in simhash.close_edges(classes, simhash.pigeonhole_keys(5, 3), 3, chunk).collect()}
        assert all((max(e), min(e)) in close for e in edges)
        assert sets(edges) == sets(close)


def lm_counts(texts):
    rows = [[*(t or "").lower().split(), " "] for t in texts]
    return Counter(w for r in rows for w in r), Counter(p for r in rows for p in zip([" ", *r[:-1]], r, strict=True))


@pytest.mark.parametrize("size", [1000, 1 << 30])
def test_lm_scores_against_brute_force(spark, size):
    rng = random.Random(6)
    texts = [" ".join(f"W{int(rng.expovariate(0.02))}" for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = lm_counts([t for i, t in enumerate(texts) if i % 3])
    total, space = sum(one.values()), sum(one.values()) + len(one) + 1

    def stands_for(counts):
        by: dict = {}
        for c in counts.values():
            by.setdefault(int(lm.level_of(np.array([c]))[0]), []).append(c)
        return lambda c: float(np.mean(by[int(lm.level_of(np.array([c]))[0])])) if c else 0.0

    word, pair = stands_for(one), stands_for(two)
    alike = 0
    for r in lm.Trained(df.where("doc_id % 3 <> 0"), size).score(df).collect():
        w = [*(texts[r["doc_id"]] or "").lower().split(), " "]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 1) / space) for x in w), rel_tol=1e-9)
        want = 0.0
        for v, x in zip([" ", *w[:-1]], w, strict=True):
            p = (word(one[x]) + 1) / space
            if one[v]:
                p = lm.LAMBDA * min(1, pair(two[v, x]) / word(one[v])) + (1 - lm.LAMBDA) * p
            want += math.log10(p)
        alike += math.isclose(r["score"], want, rel_tol=1e-9)
        assert math.isclose(r["score"], want, rel_tol=0.02)
    assert alike >= 0.75 * len(texts)  # of some hundred n-grams a text, one in 1700 that is unseen is found all the same


def test_lm_probabilities_add_up_to_one(spark):
    rng = random.Random(16)
    texts = [" ".join(f"w{min(799, int(rng.paretovariate(0.7)))}" for _ in range(400)) for _ in range(100)]
    m = lm.Trained(spark.createDataFrame([(t,) for t in texts], "text string"), 1000)
    one, _ = lm_counts(texts)
    parts = {(r["n"], r["seg"]): lm.Filter(np.frombuffer(r["bits"], np.uint8), r["size"]) for r in m.counts.collect()}

    def looked_up(h, n):
        seg = lm.segment(h, m.segments)
        out = np.zeros(len(h))
        for i in np.unique(seg):
            at = seg == i
            out[at] = m.totals.values[n][parts[n, int(i)].levels(h[at], n)]
        return out

    words = list(one)
    h = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    seen = looked_up(h, 1)
    for v in [w for w, _ in one.most_common(10)] + [w for w, c in one.items() if 20 < c < 40][:3] + ["never"]:
        before = np.full(len(h), xxhash.xxh64_intdigest(v.encode()), np.uint64)
        p = m.totals.probability(looked_up(before, 1), seen, looked_up(lm.pair_hash(before, h), 2))
        mass = p.sum() + m.totals.probability(looked_up(before[:1], 1), np.zeros(1), np.zeros(1))[0]  # and an unseen word
        assert 0.98 < mass < 1.03, (v, mass)


def test_filter_recalls_levels():
    h = xxhash.xxh64_intdigest
    keys = np.sort(np.array([h(str(i)) for i in range(5000)], np.uint64))
    counts = np.random.default_rng(1).zipf(1.6, 5000).clip(1, 10**9)
    q = lm.level_of(counts)
    f = lm.Filter.build(keys, 1, q)
    got = f.levels(keys, 1)
    assert (got >= q).all() and (got > q).mean() < 0.005
    assert (f.levels(np.array([h(f"x{i}") for i in range(20000)], np.uint64), 1) > 0).mean() < 0.002
    assert (f.levels(keys, 2) > 0).mean() < 0.005
    low = np.r_[0, lm.BOUNDS][q]
    assert (low <= counts).all() and (counts < low * 1.051 + 1).all() and (lm.level_of(np.arange(1, 21)) == np.arange(1, 21)).all()
    assert (lm.unpack(lm.pack(keys)) == keys).all() and (lm.unplanes(lm.planes(counts.astype(np.int64)), np.int64) == counts).all()


def test_lm_filter_grows_with_what_is_counted(spark, monkeypatch):
    counts = lambda texts: lm.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), 4).select(F.aggregate("grams", F.lit(0).cast("long"), lambda a, x: a + x).alias("types"), "size").collect()
    small, large = (counts([" ".join(f"w{i}" for i in range(n))] * 2) for n in (2000, 40000))
    for r in (*small, *large):
        assert r["size"] >= r["types"] * lm.ENTRY_BITS
    assert sum(r["size"] for r in large) >= 10 * sum(r["size"] for r in small)
    # runs of many texts or of one, and any number of segments, give the same scores
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i}") for i in range(50)], "doc_id long, text string")
    m = lm.Trained(df.where("doc_id % 3 > 0").select("text"), 1000)
    scores = lambda: {r["doc_id"]: r["score"] for r in m.score(df).collect()}
    want = scores()
    monkeypatch.setattr(lm, "RUN_BYTES", 20)
    assert len(want) == 50 and scores() == want


def test_lm_knows_what_was_seen_once(spark):
    train = spark.createDataFrame([("once upon a b",), ("x y x y x y x q",)], "text string")
    df = spark.createDataFrame([(1, "once upon"), (2, "once never"), (3, "never upon"), (4, "upon once")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lm.Trained(train, 1000).score(df).collect()}
    assert s[1] > s[2] > s[4] > s[3]


def test_line_dedup_keeps_one_copy(spark):
    p = "one line\ntwo line\nthree line\nfour line"
    df = spark.createDataFrame([(1, "x\n" + p), (2, p + "\ny"), (3, "one line\ntwo line"), (4, "a\na\na\na\na")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "x\n" + p, 2: "y", 3: "one line\ntwo line", 4: "a\na\na"}


def test_line_dedup_of_very_long_documents(spark):
    lines = [f"line {i}" for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[:60_000], "other", *lines[60_000:]]))]
    got = {r["doc_id"]: (r["text"], r["__n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("new\nother", 100_000)}


def neighbours_of(df, **options):
    got: dict[int, list] = {}
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:] = x[:300] + 0.3 * rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (650, [0.0] * 16), (700, [float("nan")] * 16), (750, [None] * 16), (800, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for chunk, block in ((20_000, 16384), (5, 100)):
        monkeypatch.setattr(ann, "QUERY_CHUNK", chunk)
        monkeypatch.setattr(ann, "BLOCK", block)
        got = neighbours_of(df)
        hits = 0
        for q in range(0, 600, 50):
            s = u @ u[q]
            s[q] = -2
            hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:5].tolist()))
            assert all(abs(score - s[i]) < 1e-12 for i, score in got[q]) and len(got[q]) == 5
        assert hits >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert ann.nearest(df.where("vec_id < 0")).count() == 0


def test_neighbours_that_repeat_the_query(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.1], [0.0, 1.0]
    got = neighbours_of(spark.createDataFrame([(0, a), (0, a), (0, c), (3, b), (4, a)], "vec_id long, embedding array<double>"), k=3)
    # two queries have vector a and one has c; each bars its own row alone
    assert sorted(v for v, _ in got[0]) == sorted([0, 3, 4, 0, 3, 4, 0, 0, 3]) or sorted(v for v, _ in got[0]) == sorted([0, 4, 3, 0, 4, 3, 3, 0, 0])
    few = neighbours_of(spark.createDataFrame([(50, a), (1, b)], "vec_id long, embedding array<double>"))
    assert [v for v, _ in few[50]] == [1]


def test_neighbours_verifies_few_vectors():
    rng = np.random.default_rng(18)
    x = rng.normal(size=(8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index, q = ann.Index(x), x[::100]
    found = [set(f[np.argsort(-c)[:6]].tolist()) for f, c in index.search(q, 6, np.full(len(q), -2.0))]
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert sum(len(f & set(w.tolist())) - 1 for f, w in zip(found, want, strict=True)) >= 0.9 * 5 * len(q)
    assert index.verified <= 0.07 * len(q) * len(x)


def page(i, size=50):
    payload = b"payload %d " % i * size
    return warc.page_record(i, "http://x/é\n", payload, hashlib.sha256(payload).hexdigest(), None, False)


def salvaged(data):
    out = list(warc.salvage(warc.Source(warc._Memory(data), len(data))))
    return [int(r[4]["warc-record-id"][10:-1]) for r in out if r[0] == "record"], [r[1:] for r in out if r[0] == "gap"]


def test_warc_salvage(spark, tmp_path):
    records = [gzip.compress(page(i), mtime=0) for i in range(6)]
    broken = bytearray(records[1])
    broken[len(broken) // 2] ^= 0xFF
    data = records[0] + bytes(broken) + b"noise\x1f\x8b\x08noise" + records[2] + gzip.decompress(records[3]) + records[4] + records[5][:-20]
    ids, gaps = salvaged(data)
    assert ids == [0, 2, 3, 4]
    assert [g[:2] for g in gaps] == [(len(records[0]), data.index(records[2])), (len(data) - len(records[5]) + 20, len(data))]
    (tmp_path / "a.warc.gz").write_bytes(data)
    back = warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")).collect()
    assert Counter(r["kind"] for r in back) == {"record": 4, "gap": 2}


def test_warc_salvage_within_members():
    rng = random.Random(19)
    noise = lambda i: warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:page:{i}>")], rng.randbytes(30_000))
    one, two, three = page(1), page(2), page(3)
    after = gzip.compress(page(4), mtime=0)
    bad = two.replace(b"payload 2", b"payload X", 1)
    assert salvaged(gzip.compress(bad + one + three) + after) == ([1, 3, 4], [(0, len(gzip.compress(bad + one + three)), 0, "block digest differs")])
    ids, gaps = salvaged(gzip.compress(one + bad + three) + after)
    assert ids == [1, 3, 4] and [g[2] for g in gaps] == [len(one)]
    ids, gaps = salvaged(gzip.compress(one + two + bad) + after)
    assert ids == [1, 2, 4] and [g[2] for g in gaps] == [len(one + two)]
    no_version = b"JUNK" + two[4:]
    assert salvaged(gzip.compress(one + no_version + three))[0] == [1, 3]
    wrong_length = two.replace(b"Content-Length: ", b"Content-Length: 9", 1) if two.rindex(b"Content-Length") else two
    assert salvaged(gzip.compress(one + wrong_length + three) + after)[0][0] == 1
    # a whole archive as one member, cut or damaged in its trailer or its middle
    parts = [noise(i) for i in range(20)]
    whole = gzip.compress(b"".join(parts), 6)
    for level in (0, 6):
        whole = gzip.compress(b"".join(parts), level)
        ids, gaps = salvaged(whole[:-4] + after)
        assert ids == [*range(20), 4] and len(gaps) == 1, level
        ids, gaps = salvaged(whole[: len(whole) // 2])
        assert ids == list(range(9 if level == 6 else len(ids))) and len(ids) in (9, 10) and len(gaps) == 1, (level, ids)
        flipped = bytearray(whole)
        flipped[len(whole) // 2] ^= 0x55
        ids, gaps = salvaged(bytes(flipped) + after)
        assert ids[-1] == 4 and len(ids) >= 10 and len(set(ids[:-1])) == len(ids) - 1 and gaps, level
    # records longer than a step of inflating
    long = [page(i, 9000 * (1 + i % 3)) for i in range(8)]
    assert salvaged(b"".join(gzip.compress(x, mtime=0) for x in long) + gzip.compress(b"".join(long))) == ([*range(8)] * 2, [])
    # plain records
    assert salvaged(one + b"junk" + two + bad + three)[0] == [1, 2, 3]
    assert salvaged(b"") == ([], []) and salvaged(b"no archive") == ([], [(0, 10, None, "no version line")])


def test_warc_round_trip_of_odd_pages(spark, monkeypatch):
    schema = "page_id long, url string, html string, digest string, first string, kind string"
    rows = [(None, None, None), (2, None, "x" * 200), (1, "u", "x" * 200), (1, "u", "x" * 200), (3, "u", ""), (None, "u", "x" * 200), (7, "http://" + "y" * 3_000_000, "long url"), (8, "a\r\nb", "é" * 60)]
    odd = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], schema)
    got = sorted((tuple(r) for r in warc.round_trip(spark, odd).collect()), key=repr)
    want = [(1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 0, "response", None), (7, 8, "response", None), (8, 120, "response", None), (None, 0, "response", None), (None, 200, "revisit", 1)]
    assert [(r[0], r[1], r[3], r[4]) for r in got] == want
    assert warc.round_trip(spark, odd.where("page_id = 9")).count() == 0


def test_warc_round_trip_raises_where_a_record_is_lost(spark, monkeypatch):
    real = warc.page_record
    monkeypatch.setattr(warc, "page_record", lambda i, *rest: real(i, *rest).replace(b"WARC-Block", b"WARC Block\r\n", 1) if i == 2 else real(i, *rest))
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    with pytest.raises(ValueError, match="read back differ"):
        warc.round_trip(spark, pages)


def test_toxicity_scores_against_brute_force():
    rng = np.random.default_rng(4)
    m = toxicity.Machine({}, 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [], [1], [0, 1, 2, 3, 4, 5]]
    got = m.raw(np.repeat(np.arange(4), list(map(len, rows))), np.array(sum(rows, []), np.int64), 4)
    want = [m.w0 + sum(m.w[i] for i in r) + sum(m.v[i] @ m.v[j] for i in r for j in r if i < j) for r in rows]
    assert np.allclose(got, want)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    out = queries.remainder("doc_id", 3) == 1
    s = toxicity.score(docs.where(out), toxicity.fit(docs, labels.where(~out))).join(labels, "doc_id").groupBy("toxic").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("hit"))
    hit = {r["toxic"]: r["hit"] for r in s.collect()}
    assert hit[1] > 0.7 and hit[0] < 0.01


def test_entry_without_the_subpackages_libraries():
    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e; assert len(e.queries()) > 60 and 'pipeline' not in e.queries()"
    import subprocess, sys  # noqa: E401

    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.split("/tests/")[0])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, DATA).count() > 0
