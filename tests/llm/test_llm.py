"""The training-data operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from bayesloom.llm import common, decontaminate, exchange, fingerprints, langid, perplexity, pieces, queries, simhash, sst, substrings, suffixes, tokencounts, wordcache

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
public_tokenizers = pytest.importorskip("public_tokenizers")


def docs_of(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, langs[k] if langs else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    # names that operators use inside, and a table in several parts
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"k1": F.lit(1), "told": F.lit("x"), "row": F.lit(2), "dkey": F.lit(3), "size": F.lit(0)})


def prose(seed, n, words=("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))


ODD = [None, "", " ", "\n\n", "x", "ÄÖ ß é", "a\u0000b", "same text here", "same text here", "🙂 👍🏽", "…" * 50]


def test_difference_cover_and_ragged():
    for n in (1, 2, 3, 10, 57, 199, 200, 250, 399, 400, 1000):
        v, r = suffixes.difference_cover(n)
        assert v <= n and {(a - b) % v for a in r for b in r} == set(range(v))
    assert [len(suffixes.difference_cover(n)[1]) for n in (200, 400)] == [12, 17]
    assert common.ragged(np.array([5, 0, 9]), np.array([2, 0, 1])).tolist() == [5, 6, 9]
    x = np.arange(20, dtype=np.uint64)
    h = common.Rolling(np.concatenate([x, x]))
    assert (h.windows(7)[:14] == h.windows(7)[20:34]).all() and len(set(h.windows(7)[:14].tolist())) == 14


def test_language_id(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.95 and out.score.between(0, 1).all()
    langs = ["en", "fr", None] * 4
    odd = langid.identify(docs_of(spark, ["the cat sat on the mat", "le chat est sur la table", "?"] * 3 + [None, "12 %", ""], langs=langs)).collect()
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (2, 5, 8, 9, 10, 11)} == {"und"} and len(odd) == 12
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in odd)
    assert langid.identify(docs_of(spark, ["a"]).limit(0)).count() == 0
    w = langid.fit([("a", np.array([1, 2], np.int32), np.array([0.5, 0.5], np.float32)), ("b", np.array([3], np.int32), np.array([1.0], np.float32))] * 10, 4, 0.3, 1.0, 0.02, 0.01, 2)
    assert (w.weights == 0).sum() >= 13 * 2  # L1 keeps unseen slots at zero


def test_language_scores_by_definition():
    """A text's scores are the means of its n-grams' weights, n-gram by n-gram; ties go to the first language."""
    r = np.random.Generator(np.random.PCG64(1))
    m = langid.Model(["a", "b"], r.normal(size=(1 << 10, 2)).astype(np.float32), np.array([0.1, -0.1]), 2.0, 10)
    texts = ["The cat", "x", "", "Ünïcode 日本", "12 %", "aaaa aaaa"]

    def slot(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * ((0x01000193 + 0x9E3779B0) & 0xFFFFFFFF)) & 0xFFFFFFFF
            h ^= h >> 15
        return h >> 22

    got, spoken = m.scores(texts)
    for t, row, ok in zip(texts, got, spoken, strict=True):
        padded = f" {t.lower()} "
        grams = [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]
        assert row == pytest.approx(np.mean([m.weights[slot(g)] for g in grams], axis=0) + m.bias, abs=1e-5) and ok == any(c.isalpha() for c in t)
        assert langid.features([t], 10)[0][1].sum() == pytest.approx(1)
    even = langid.Model(["a", "b"], np.zeros((4, 2), np.float32), np.zeros(2), 1.0, 2)
    assert even.predict(["xy"])[0] == ["a"] and even.predict(["xy"])[1][0] == 0.5


def kneser_ney(texts):
    """ln p of a 5-gram of characters by definition."""
    grams = Counter()
    for t in texts:
        s = "\x02" * 4 + t.lower() + "\x03"
        grams.update(s[i : i + 5] for i in range(len(s) - 4))
    tables = {5: grams}
    for k in (4, 3, 2, 1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    ds = {}
    for k, t in tables.items():
        n = [sum(v == j for v in t.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        ds[k] = [0] + [min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) if n[j] else 0 for j in (1, 2, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        own = {x: c for x, c in tables[k].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        c = own.get(g, 0)
        weight = sum(ds[k][min(v, 3)] for v in own.values()) / total
        return max(c - ds[k][min(c, 3)], 0) / total + weight * p(g[1:])

    return p


def test_perplexity(spark):
    trusted = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog"]
    tests = ["the cat and the dog", "zzz qqq", "", None, "the mat"]
    docs, labels = docs_of(spark, trusted + tests), spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    p = kneser_ney(trusted)
    for rows in (10**6, 40):  # one block, several blocks
        got = {r["doc_id"]: r for r in perplexity.classify(docs, labels, block_rows=rows).collect()}
        for i, t in enumerate(trusted + tests):
            s = "\x02" * 4 + (t or "").lower() + "\x03"
            want = np.exp(-np.mean([np.log(p(s[j : j + 5])) for j in range(len(s) - 4)]))
            assert got[i]["perplexity"] == pytest.approx(want, rel=1e-4) and got[i]["n_grams"] == len(t or "") + 1
    assert not got[4]["keep"] and got[0]["keep"]
    twice = perplexity.classify(docs.unionAll(docs.where("doc_id in (0, 5)")), labels, block_rows=40).collect()  # repeated rows
    assert len(twice) == 10 and len({r["perplexity"] for r in twice if r["doc_id"] == 0}) == 1
    nulls = perplexity.classify(docs_of(spark, ["abc", "abd", "xyz"], [0, 1, None], [None, "", None]), labels).collect()
    assert len(nulls) == 3 and perplexity.classify(docs.limit(0), labels).count() == 0
    none = perplexity.classify(docs, labels.limit(0)).collect()
    assert len(none) == 8 and all(r["keep"] and r["perplexity"] is None for r in none)


def test_perplexity_symbols(spark, monkeypatch):
    """Characters of any script have symbols of their own, as long as there are symbols; rare ones share some."""
    texts = ["đầy đủ", "日本語と中文", "한국어", "\x02\x03"]
    table = perplexity.alphabet(docs_of(spark, texts))
    own = {ord(c) for t in texts for c in t}
    assert len(set(table[sorted(own)].tolist())) == len(own) and table[sorted(own)].min() >= perplexity.OWN
    data, at = perplexity.symbols(["日a", ""], table)
    assert data[:4].tolist() == [0] * 4 and data[4] == table[ord("日")] and data[6] == 1 and at.tolist() == [0, 7, 12]
    assert 2 <= table[ord("z")] < perplexity.OWN and table.max() < 1 << perplexity.BITS


def simhash_by_definition(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_definition(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


@pytest.mark.parametrize("split", [4096, 3])
def test_simhash_components(spark, split, monkeypatch):
    r = random.Random(5)
    fps = []
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(8):
            fps.append(base)
            base ^= 1 << r.randrange(64) | (1 << r.randrange(64) if r.random() < 0.6 else 0)
    fps += [0, 0, 1, 7, 15]
    monkeypatch.setattr(simhash.edges, "__defaults__", (split,))
    rows = spark.createDataFrame([(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(rows).collect()}
    assert [got[i] for i in range(len(fps))] == components_by_definition(fps, list(range(len(fps))))


def test_bit_planes():
    r = np.random.Generator(np.random.PCG64(3))
    fps = r.integers(0, 1 << 63, 200, np.uint64)
    fps[100:] = fps[:100] ^ (np.uint64(1) << r.integers(0, 64, 100, np.uint64))
    for radius in (0, 1, 2, 3, 20, 31):
        for own in (None, np.arange(7)):
            got = np.unpackbits(simhash.BitPlanes(fps).within(fps[:7], radius, own).view(np.uint8), axis=1, bitorder="little")[:, :200]
            assert got.tolist() == [[int(bin(int(a ^ b)).count("1") <= radius and (own is None or i != k)) for k, b in enumerate(fps)] for i, a in enumerate(fps[:7])]


def test_bit_planes_abandon_far_blocks():
    """A query that is itself in the planes keeps no block alive: far blocks are read to a third of their planes at most."""
    fps = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 2000, np.uint64)
    planes = simhash.BitPlanes(fps)
    assert not planes.within(fps[:256], 2, np.arange(256)).any()
    assert planes.visited < 256 * 32 * 64 / 3


def test_simhash_query(spark):
    texts = [*ODD, "A b c d", "a B c d", prose(1, 60), prose(1, 60)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [simhash_by_definition(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == components_by_definition(fps, list(range(len(texts))))
    nulls = simhash.near_duplicates(docs_of(spark, ["q w e", "q w e", "r"], [None, 5, None])).collect()
    assert sorted((r["component_id"] is None, r["component_id"]) for r in nulls if r["doc_id"] is None) == [(False, 5), (True, None)]
    assert simhash.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [*ODD, "One. Two. Three.\nFour.", "One. Two. Three.\nFive. Six. Seven.", " ".join(f"Sentence {i}." for i in range(400))]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs_of(spark, texts)).collect()}
    units = lambda t: {p for p in re.split(r"\n+|(?<=[.!?])[ \t]+", t) if p}
    alike = lambda a, b: len(units(a) & units(b)) / len(units(a) | units(b)) if units(a) | units(b) else 1.0
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1 if i else len(texts) - 1] or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(t, edited)) and r["near_next"] == pytest.approx(alike(t, nxt))
        assert (r["fingerprint"] == r["edited_fingerprint"]) or t != edited
    assert got[7]["fingerprint"] == got[8]["fingerprint"]
    assert fingerprints.fingerprints(docs_of(spark, ["a b. c d."], [None])).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(docs_of(spark, ["a"]).limit(0)).count() == 0
    plan = fingerprints.fingerprints(docs_of(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_ranges(spark, monkeypatch):
    """The next text is found over many ranges: clustered, repeated and null ids, in any number of parts."""
    r = random.Random(8)
    ids = [*range(20), *(10**15 + k for k in range(20)), *[7] * 25, *[None] * 9, -5, 2**62]
    texts = [f"One {r.random()}. Two {i}." for i in range(len(ids))]
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").withColumn("h", F.xxhash64("text")).collect()
    order = sorted(rows, key=lambda x: (x["doc_id"] is None, -(x["doc_id"] or 0), -x["h"]))
    want = Counter()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        t, cut = a["text"], len(a["text"]) // 3
        want[hashlib.sha256((t[: len(t) - cut] + b["text"][:cut]).encode()).hexdigest()] += 1
    for size, ranges in ((10, 4096), (200, 4), (1 << 20, 4096)):
        monkeypatch.setattr(fingerprints, "RANGES", ranges)
        monkeypatch.setattr(fingerprints.in_order, "__defaults__", (size,))
        got = fingerprints.fingerprints(docs_of(spark, texts, ids)).select("edited_sha256").collect()
        assert Counter(x[0] for x in got) == want
    bounds = sorted(r.sample(range(1000), 57))
    for x in spark.range(1000).select("id", fingerprints.place(bounds, F.col("id")).alias("at")).collect():
        assert x["at"] == sum(b < x["id"] for b in bounds)


def test_sst_file():
    out = io.BytesIO()
    w = sst.Writer(out, 2)
    ids = [None, -5, 0, 0, 7, 300, *range(1000, 9000, 3)]
    last, n = object(), 0
    for i in ids:
        n = n + 1 if i == last else 0
        last = i
        w.add(sst.key_of(i, n), np.arange((i or 0) % 50))
    w.close()
    s = sst.Shard(out)
    assert [i for i, _ in s.scan()] == ids and s.n == len(ids) and len(s.index) > 1
    assert [len(x) for x in s.get(0)] == [0, 0] and s.get(1003)[0].tolist() == list(range(3)) and s.get(1001) == [] and len(s.get(None)) == 1
    with pytest.raises(ValueError, match="ascend"):
        w.add(sst.key_of(0), np.arange(1))


def test_sst_query(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    texts = [*ODD, "It's I'LL don't <|endoftext|> ΑΣ Σ é 12a", "word. word, Word"]
    ids = [*range(len(texts) - 2, -1, -1), None]
    got = sst.digests(sst.token_shards(docs_of(spark, texts, ids), path, end_id=2)).collect()
    full = wordcache.encoder(path).full
    start, by = 0, {r["doc_id"]: r for r in got}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        want = [*full.encode(t or "", add_special_tokens=False).ids, 2]
        assert (by[i]["start"], by[i]["n_tokens"], by[i]["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(got) == len(texts)
    assert sst.token_shards(docs_of(spark, ["a"]).limit(0), path).count() == 0


def test_sst_look_up(spark):
    path = queries.vocabulary("word_bpe_49k.json")
    ids = [*range(0, 300, 3), None, 30, 30]
    texts = [f"number {i} of {len(ids)}" for i in range(len(ids))]
    manifest = sst.write_shards(docs_of(spark, texts, ids), path, common.fresh_dir(spark, "sst"))
    asked = spark.createDataFrame([(i,) for i in (0, 30, 31, 297, None, 5000, 30)], "doc_id bigint")
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in sst.find(manifest, asked).collect())
    full = wordcache.encoder(path).full
    assert got == Counter((i, tuple(full.encode(t, add_special_tokens=False).ids)) for i, t in zip(ids, texts, strict=True) if i in (0, 30, 297, None))
    assert sst.find(manifest, asked.limit(0)).count() == 0


def test_long_texts(spark):
    """Two equal texts of 2.5 MB and a short one: longer than any piece of work, and whole in every result."""
    r = random.Random(3)
    words = [f"w{r.randrange(4000)}" for _ in range(400_000)]
    text = ". ".join(" ".join(words[k : k + 40]) for k in range(0, len(words), 40))
    docs = docs_of(spark, [text, text, "short one"])
    n = len(text)
    assert n > 2 * common.CHUNK_BYTES
    rows = lambda df: {x["doc_id"]: x for x in df.collect()}
    assert len(rows(langid.identify(docs))) == 3
    quality = rows(perplexity.classify(docs, spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int")))
    assert quality[0]["n_grams"] == n + 1
    prints = rows(simhash.near_duplicates(docs))
    assert prints[0]["fingerprint"] == f"{simhash_by_definition(text):016x}" and prints[1]["component_id"] == 0
    assert len(set(parts_by(spark, [text, text[:-3], "short one"]))) == 2
    sketch = rows(fingerprints.fingerprints(docs))
    assert sketch[0]["n_chars"] == n and sketch[1]["near_next"] == 1.0
    path = queries.vocabulary("word_bpe_49k.json")
    want = [*wordcache.encoder(path).full.encode(text, add_special_tokens=False).ids, 2]
    shards = rows(sst.digests(sst.token_shards(docs, path)))
    assert shards[1]["start"] == len(want) == shards[0]["n_tokens"] and shards[0]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    encoded = rows(pieces.compare(docs, queries.vocabulary("piece_bpe_32k.model")))
    assert encoded[0]["same_ids"] and encoded[0]["decoded_ok"]
    counted = [x for x in tokencounts.section_counts(docs, queries.vocabulary("byte_bpe_50k.json"), tokencounts.thirds(F.col("text"))).collect() if x["doc_id"] == 0]
    assert sum(x["n_tokens"] for x in counted) == counted[0]["doc_tokens"] and counted[2]["end"] == n
    bench = spark.createDataFrame([(0, " ".join(words[200_000:200_030]))], "item_id bigint, text string")
    assert {x["doc_id"] for x in decontaminate.contaminated(docs, bench).collect()} == {0, 1}
    cut = rows(suffixes.removal_digests(docs))
    assert [cut[i]["n_removed"] for i in (0, 1, 2)] == [n, n, 0] and cut[0]["n_spans"] == 1
    gone = rows(substrings.removal_digests(docs))
    assert [gone[i]["n_removed"] for i in (0, 1, 2)] == [0, len(text.split()), 0]


def test_word_memory_is_bounded():
    import pyarrow as pa

    e = wordcache.WordEncoder(queries.vocabulary("word_bpe_49k.json"), max_words=50)
    for k in range(5):
        t = prose(k, 60)
        ids, at = e.encode(pa.array([t, ""], pa.large_string()))
        assert ids.tolist() == e.full.encode(t, add_special_tokens=False).ids and at.tolist() == [0, len(ids), len(ids)]


def test_sentencepiece(spark):
    path = queries.vocabulary("piece_bpe_32k.model")
    texts = [*ODD, "two  blanks", " lead and trail ", "mark ▁ inside", "日本語 текст", "tab\tnewline\n x"]
    got = pieces.compare(docs_of(spark, texts), path).collect()
    assert len(got) == len(texts) and all(r["same_ids"] for r in got)
    assert all(r["decoded_ok"] for r in got if "▁" not in (texts[r["doc_id"]] or ""))
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(docs_of(spark, texts), path), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    coder = pieces.piece_encoder(path)
    assert coder.cuttable and coder.full.decode(coder.full.encode("Hello 日本").ids) == "Hello 日本"
    unigram = pieces.Spec([("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -2.0, 1), ("b", -2.0, 1)])
    assert pieces.backend(unigram).encode("ab a").tokens == ["▁ab", "▁", "a"]
    assert pieces.compare(docs_of(spark, ["a"]).limit(0), path).count() == 0


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts(spark, rule):
    path = queries.vocabulary("byte_bpe_50k.json")
    texts = [*ODD, "Boundary crossing tokens, everywhere\n\nand here  too.", "<|endoftext|> naïve café 🙂🙂 x" * 3]
    got = {(r["doc_id"], r["name"]): r for r in tokencounts.section_counts(docs_of(spark, texts), path, tokencounts.thirds(F.col("text")), rule).collect()}
    full = tokencounts.Tokenizer.from_file(path)
    full.encode_special_tokens = True
    for i, t in enumerate(texts):
        t = t or ""
        n, want, spans = len(t), [0.0] * 3, full.encode(t, add_special_tokens=False).offsets
        bounds = [(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]
        for s, e in spans:
            shares = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
            if rule == "split":
                want = [w + x / (e - s) for w, x in zip(want, shares, strict=True)]
            else:
                want[max(range(3), key=lambda k: (shares[k], -k)) if rule == "most" else next(k for k in range(3) if bounds[k][0] <= s < bounds[k][1])] += 1
        have = [got[i, name] for name in ("head", "middle", "tail")]
        assert [r["n_tokens"] for r in have] == pytest.approx(want) and all(r["doc_tokens"] == len(spans) for r in have)
    assert tokencounts.section_counts(docs_of(spark, ["a b"]), path, F.lit(None).cast("array<struct<name:string,start:bigint,end:bigint>>"), rule).count() == 0
    assert tokencounts.section_counts(docs_of(spark, ["a\nb"]), path, tokencounts.lines(F.col("text")), rule).count() == 2


def test_decontamination(spark):
    item, short = prose(3, 30), "only four words here"
    swapped = item.split()
    for k in (4, 11, 18, 25):
        swapped[k] = "zzz"
    texts = [*ODD, f"{prose(9, 40)} {item} {prose(10, 20)}", f"pre {' '.join(swapped)} post", prose(11, 200), f"x {short} y", " ".join(item.split()[:8]), item.upper()]
    bench = spark.createDataFrame([(0, item), (1, short), (2, None), (3, "")], "item_id bigint, text string")
    n = len(ODD)
    for block in (10**6, 20):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs_of(spark, texts), bench, block_words=block).collect()}
        assert set(got) == {(n, 0), (n + 1, 0), (n + 3, 1), (n + 5, 0)}
        assert got[n, 0]["n_equal"] == 30 and got[n + 1, 0]["n_equal"] == 26 and got[n, 0]["start_word"] == 40
    clean = decontaminate.decontaminate(docs_of(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {n, n + 1, n + 3, n + 5}
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.longest(np.array([1, 0, 0, 1, 1, 1, 1, 0, 1, 1, 0, 0], bool), 0.8) == (3, 10)
    nulls = docs_of(spark, [item, item, None], [None, 4, 4])
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in decontaminate.contaminated(nulls.unionAll(nulls), bench).collect()) == [(False, 4)] * 2 + [(True, None)] * 2
    assert decontaminate.contaminated(docs_of(spark, texts).limit(0), bench).count() == 0


def longest_by_definition(equal, identity):
    n, found = len(equal), (0, 0)
    for s in range(n):
        for e in range(s + 1, n + 1):
            if equal[s] and equal[e - 1] and 1000 * sum(equal[s:e]) >= round(identity * 1000) * (e - s) and e - s > found[1] - found[0]:
                found = (s, e)
    return found


def test_hits_in_slices():
    import pyarrow as pa

    seeds = decontaminate.Seeds([0, 1], [" ".join(["same"] * 40), prose(2, 30)])
    docs = decontaminate.Words.of(pa.array(["same " * 60, prose(2, 30), "", "same " * 15], pa.large_string()))
    whole = seeds.hits(docs)
    assert len(whole) > 100 and seeds.hits(docs, 7).tolist() == whole.tolist()


def test_allocation_of_overlapping_sections():
    """Each rule against a look at every token and section."""
    r = random.Random(12)
    for _ in range(60):
        ends = np.cumsum([r.randrange(1, 5) for _ in range(20)])
        starts = np.concatenate([[0], ends[:-1]])
        sections = [tuple(sorted((r.randrange(ends[-1]), r.randrange(ends[-1] + 1)))) for _ in range(r.randrange(6))]
        for rule in tokencounts.RULES:
            want = [0.0] * len(sections)
            for a, b in zip(starts, ends, strict=True):
                inside = [k for k, (s, e) in enumerate(sections) if s <= a and b <= e and e > s]
                shares = {k: min(b, e) - max(a, s) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s) and k not in inside}
                for k in inside:
                    want[k] += 1
                for k, n in shares.items():
                    want[k] += n / (b - a) if rule == "split" else (sections[k][0] <= a < sections[k][1]) if rule == "start" else 0
                if rule == "most" and shares and not inside:
                    want[max(shares, key=lambda k: (shares[k], -sections[k][0], -k))] += 1
            assert tokencounts.allocate(starts, ends, sections, rule).tolist() == pytest.approx(want)


def test_longest_stretch():
    r = random.Random(9)
    for _ in range(400):
        equal = [r.random() < 0.75 for _ in range(r.randrange(1, 45))]
        assert decontaminate.longest(np.array(equal), 0.8) == longest_by_definition(equal, 0.8)
    assert decontaminate.longest(np.zeros(0, bool), 0.8) == (0, 0)


def overlaps_by_definition(texts, items, least, identity):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    out = {}
    for d, t in enumerate(texts):
        for i, x in items:
            a, b = words(t), words(x)
            for shift in range(-len(a) + 1, len(b)):
                lo, hi = max(0, shift), min(len(b), len(a) + shift)
                s, e = longest_by_definition([a[k - shift] == b[k] for k in range(lo, hi)], identity)
                if e > s and e - s >= min(least, len(b)):
                    n = sum(a[k - shift] == b[k] for k in range(lo + s, lo + e))
                    row = (e - s, n, -(lo - shift + s))
                    out[d, i] = max(out.get((d, i), row), row)
    return out


def test_decontamination_against_all_alignments(spark):
    """Every stretch that counts is found, also beside a longer one that doesn't; a naive aligner gives the same rows."""
    r = random.Random(10)
    items = [(k, " ".join(f"w{r.randrange(12)}" if k % 2 else f"q{k}x{j}" for j in range(n))) for k, n in enumerate((4, 9, 13, 20, 31, 60))]
    texts = []
    for k in range(60):
        own = r.choice(items)[1].split()
        s = r.randrange(len(own))
        part = own[s : s + r.randrange(1, len(own) + 1)]
        for _ in range(r.randrange(6)):
            part[r.randrange(len(part))] = f"z{r.randrange(99)}"
        texts.append(" ".join([*(f"u{r.randrange(9)}" for _ in range(r.randrange(6))), *part, *(f"w{r.randrange(12)}" for _ in range(r.randrange(9)))]))
    long = items[5][1].split()
    texts.append(" ".join([*(w if j not in (4, 9) else "zz" for j, w in enumerate(long[:13])), *["yy"] * 17, *long[30:42], *["yy"] * 18]))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]): (x["n_words"], x["n_equal"], -x["start_word"]) for x in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    want = overlaps_by_definition(texts, items, 13, 0.8)
    assert got == want and (60, 5) in want


def layouts(n, wrong):
    """Every way in which ``wrong`` inner words of n differ."""
    for hurt in combinations(range(1, n - 1), wrong):
        yield "".join("01"[k not in hurt] for k in range(n))


def parts_by(spark, texts, **options):
    """The components of ``simhash.similar`` as a list, in the order of the texts."""
    rows = docs_of(spark, texts).select("doc_id", F.xxhash64("text").alias("hash"))
    got = {r["doc_id"]: r["component"] for r in rows.join(simhash.similar(docs_of(spark, texts), **options), F.col("hash") == F.col("row")).collect()}
    return [got[k] for k in range(len(texts))]


def test_similar_repeated_lines(spark):
    """A line said many times over changes the set of shingles little, and so the verdict not at all."""
    texts = []
    for k in range(12):
        body, line = prose(100 + k, 300), prose(500 + k, 10 if k % 2 else 6)
        texts += [f"{body}\n{line}", "\n".join([body, *[line] * 41])]
    got = parts_by(spark, texts)
    assert all(a == b for a, b in zip(got[::2], got[1::2], strict=True))
    assert len(set(got)) == 12


def links_by_estimate(fps, sigs, sets):
    return simhash._similar_links(np.array(fps, np.uint64), sigs, [np.array(x, np.uint64) for x in sets], np.zeros(len(fps), int), 0.8, 1e-5).tolist()


def test_similar_over_the_radius():
    """Pairs of many equal bins are settled by their sets whatever their SimHashes say, far ones not at all."""
    sigs = np.ones((3, simhash.SLOTS), np.uint8)
    sigs[2, :200] = 2
    same = [range(10), range(9), range(10)]
    assert links_by_estimate([0, 2**64 - 1, 0], sigs, same) == [0, 0, 2]
    assert links_by_estimate([0, 2**64 - 1, 0], sigs, [range(10), range(7), range(10)]) == [0, 1, 2]


def test_similar_limits():
    """The estimate alone drops, or links, a pair at the threshold once in 100,000 at most; of nearer pairs the sets decide."""
    low, high = simhash.limits(0.8, 1e-5)
    p = 0.8 + 0.2 / 255
    for m in (3, 20, 100, 256):
        maybe, sure = int(low[m]), int(high[m])
        tail = lambda ks, m=m: sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in ks)
        assert tail(range(maybe)) <= 1e-5 < tail(range(maybe + 1))
        assert tail(range(sure, m + 1)) <= 1e-5 and (sure > m or tail(range(sure - 1, m + 1)) > 1e-5)
        for equal, asked in ((maybe - 1, False), (maybe, True), (sure - 1, True), (sure, False)):
            if 0 <= equal <= m:
                sigs = np.zeros((2, simhash.SLOTS), np.uint8)
                sigs[:, :m] = 1
                sigs[1, equal:m] = 2
                for sets in ([[1], [1]], [[1], [2]]):  # alike or not, which counts only if the sets are asked
                    assert links_by_estimate([5, 7], sigs, sets) == [0, 0 if (sets[0] == sets[1] if asked else equal >= sure) else 1]


def test_exact_similarities_in_slices():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(60), r.randrange(40))), np.uint64) for _ in range(30)] + [np.zeros(0, np.uint64)] * 2
    for size in (1, 50, 10**6):
        for q in (0, 7, 31):
            others = np.array([k for k in range(32) if k != q])
            want = [len(set(sets[q]) & set(sets[k])) / len(set(sets[q]) | set(sets[k])) if len(set(sets[q]) | set(sets[k])) else 1.0 for k in others]
            assert simhash.Sets(sets).similarities(q, others, size).tolist() == want


def similar_by_definition(texts, n=5, least=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] | sets[j])
        if not both or len(sets[i] & sets[j]) / both >= least:
            root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("tile", [4096, 5])
def test_similar_against_all_pairs(spark, tile, monkeypatch):
    """Texts of 1 to 900 words with 0 to 12 changed words: components of all pairs by definition, in one tile or several."""
    monkeypatch.setattr(simhash, "TILE_TEXTS", tile)
    r = random.Random(4)
    texts = [*(t for t in ODD if t is not None)]
    for k in range(40):
        base = prose(k, r.choice((1, 3, 6, 20, 60, 150, 400, 900))).split()
        for _ in range(4):
            own = base[:]
            for _ in range(r.randrange(13)):
                own[r.randrange(len(own))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(own))
    got, want = parts_by(spark, texts), similar_by_definition(texts)
    as_sets = lambda parts: {frozenset(i for i, x in enumerate(parts) if x == p) for p in parts}
    assert as_sets(got) == as_sets(want)


@pytest.mark.parametrize(("n", "wrong"), [(n, n // 5) for n in (*range(1, 22), 25)])
def test_decontamination_seeds_by_enumeration(n, wrong):
    masks = decontaminate.short_masks(n) if n < 13 else decontaminate.long_masks()
    for lay in layouts(n, wrong):
        equal = int(lay, 2)
        assert any(equal >> k & int(m, 2) == int(m, 2) for m in masks for k in range(n - len(m) + 1)), lay


def test_decontamination_seeds_at_any_length():
    assert decontaminate.complete(decontaminate.MASKS)
    assert not decontaminate.complete(("11101100111", "1101010110101", "111010010111"))  # 26 of 55 layouts of 13 words
    for limits in ((8, 0.8), (13, 0.6), (20, 0.9), (3, 0.5)):
        assert decontaminate.complete(decontaminate.long_masks(*limits), *limits)


def test_decontamination_light_changes(spark):
    """All layouts of 13 and short words that the rule allows are found in whole texts."""
    items = {n: [f"w{n}x{k}" for k in range(n)] for n in (5, 8, 12, 13, 15)}
    texts, want = [], set()
    for n, words in items.items():
        for lay in layouts(n, n // 5):
            want.add((len(texts), n))
            texts.append("before " + " ".join(w if c == "1" else "zzz" for w, c in zip(words, lay, strict=True)) + " after")
        worse = [w if k % 3 else "zzz" for k, w in enumerate(words)]
        texts.append(" ".join(worse))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got == want


def removal_by_definition(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return out


def variants(seed, n, words):
    """Texts with shared, cut, repeated and edited passages."""
    r = random.Random(seed)
    base = [prose(seed + k, words).split() for k in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            part = b[a : a + r.randrange(1, len(b))]
            if part and r.random() < 0.5:
                part[r.randrange(len(part))] = f"new{r.randrange(10**6)}"
            parts += part + [f"u{r.randrange(10**9)}"] * r.randrange(2)
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize(("length", "words"), [(20, 40), (57, 60), (250, 200), (400, 300)])
def test_repeated_bytes(spark, length, words, monkeypatch):
    texts = [*ODD, *variants(length, 40, words), "ab" * 300, "ab" * 300 + "c"]
    monkeypatch.setattr(exchange, "BUCKET_NAMES", 500)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.removal_digests(docs_of(spark, texts), length).collect()}
    want = removal_by_definition(texts, length)
    assert [got[i] for i in range(len(texts))] == want and len(got) == len(texts)


@pytest.mark.parametrize("mode", ["twice", "answer"])
def test_verdicts_tell_names_of_equal_first_bits_apart(mode):
    """Two strings whose hashes differ only in the last 16 bits aren't repeats of each other."""
    keys, names = np.array([1, 2, 3, 4], np.uint64), np.array([7 << 60 | 5 << 16 | 1, 7 << 60 | 5 << 16 | 2, 9 << 59 | 1, 9 << 59 | 1], np.uint64)
    told = {}
    for size in (6, suffixes.VERDICT):
        sent = [b for k in range(4) for b in exchange.sent(keys[k : k + 1], names[k : k + 1], np.ones(1, bool), 1, mode, size)]
        answers = exchange._tell(iter(sent), mode, 1, size)
        told[size] = {k: exchange.told_names([n], size).tolist() for b in exchange._merge(answers, size) for k, n in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert set(told[6]) == {1, 2, 3, 4}
    assert told[8] == {3: [9 << 59 | 1], 4: [9 << 59 | 1]}


def test_repeated_bytes_same_rows(spark):
    t = prose(1, 100)
    got = suffixes.removal_digests(docs_of(spark, [t, t, "z"], [4, 4, None]), 50).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, len(t)), (False, len(t)), (True, 0)]
    kept = suffixes.without_repeats(docs_of(spark, ["é" * 40 + "x", "é" * 40 + "y", None], [1, 2, 3]), 21).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(1, "x"), (2, "y"), (3, None)} and "told" in kept[0].asDict()
    assert suffixes.removal_digests(docs_of(spark, ["a"]).limit(0), 5).count() == 0


def words_by_definition(texts, ids, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    order = [float("inf") if i is None else i for i in ids]
    least = {}
    for i, w in zip(order, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(order, words, strict=True):
        gone = [0] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [1] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "words"), [(3, 20), (12, 60), (50, 200)])
def test_repeated_words(spark, window, words, monkeypatch):
    texts = [*ODD, *variants(window, 40, words), "a b c d e f " * 20, "a b c d e f  " * 20, prose(2, 80), prose(2, 80)]
    ids = random.Random(window).sample(range(1000), len(texts))
    monkeypatch.setattr(substrings, "BLOCK", 30)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.removal_digests(docs_of(spark, texts, ids), window).collect()}
    want = words_by_definition(texts, ids, window)
    assert [got[i] for i in ids] == want
    assert substrings.removal_digests(docs_of(spark, ["a"]).limit(0), window).count() == 0


def test_repeated_words_nulls_and_ties(spark):
    t = prose(1, 30)
    got = substrings.removal_digests(docs_of(spark, [t, t, t, t], [None, None, 7, 7]), 10).collect()
    assert sorted((r["doc_id"] is not None, r["n_removed"]) for r in got) == [(False, 30), (False, 30), (True, 0), (True, 0)]


def test_repeated_words_sql(spark):
    import duckdb

    docs = f"create view documents as select * from '{SF}/documents.parquet'"
    con = duckdb.connect()
    con.execute(docs)
    want = con.sql(queries.ORACLE_SQL["op10_repeated_words"]).fetchall()
    got = queries.op10_repeated_words(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and any(r["n_removed"] for r in got)


def test_automaton():
    r = random.Random(2)
    for _ in range(50):
        refs = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(3)]
        a = substrings.Automaton()
        for x in refs:
            a.extend(x)
        q = [r.randrange(3) for _ in range(20)]
        subs = {tuple(x[i:j]) for x in refs for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(q[i + 1 - n : i + 1]) in subs), default=0) for i in range(len(q))]
        assert a.statistics(q).tolist() == want


def test_pipeline_stages(spark):
    base, item = prose(21, 200), prose(3, 30)
    near = base.split()
    near[50] = "changed"
    half = base.split()
    half[::4] = ["other"] * len(half[::4])
    passage = prose(33, 90)
    texts = [base, base, " ".join(near), " ".join(half), f"{prose(41, 80)} {passage}", f"{passage} {prose(42, 80)}", f"{prose(43, 60)} {item}", None, "12 34", prose(44, 50)]
    clash = ("lang_pred", "score", "kept", "bad", "k1", "k2", "new", "row", "component", "told")
    docs = docs_of(spark, texts).select(*(c.split()[0] for c in SCHEMA.split(", "))).withColumns({c: F.lit(c) for c in clash})
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    spoken = corpus_pipeline.language_id(spark, docs, SF)
    assert ids(spoken) == [0, 1, 2, 3, 4, 5, 6, 9] and spoken.columns == docs.columns
    single = corpus_pipeline.simhash_dedup(spark, spoken, SF)
    assert ids(single) == [0, 3, 4, 5, 6, 9] and single.columns == docs.columns
    cut = {r["doc_id"]: r for r in corpus_pipeline.suffix_dedup(spark, single, SF).collect()}
    assert passage[5:-5] not in cut[4]["text"] + cut[5]["text"] and cut[9]["text"] == texts[9] and cut[4]["n_chars"] == len(cut[4]["text"])
    clean = decontaminate.decontaminate(single, bench)
    assert ids(clean) == [0, 3, 4, 5, 9] and clean.columns == docs.columns and clean.first()["kept"] == "kept"
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, SF).count() > 50
