"""WARC, SimHash, token files, suffix dedup, neighbours, pieces and the pipeline against brute force."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from topoprofile.llm import ann, joins, pieces, simhash, suffix_dedup, token_files, warc

DOCS = "doc_id long, text string"
ODD = [None, "<|STARTOFTEXT|> AB\x01CD \x01 x", "", " ", "a", "A b\x1cc\x85d  e\n'll I'M don't <|endoftext|> x<|startoftext|>y", "É́ ﬁ Σς ΑΣ", "漢字 テスト　全角", "x" * 70_000]


def write(frame, folder, name):
    frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def odd_docs(spark):
    rows = list(enumerate(ODD)) + [(None, "b b"), (3, "a"), (3, "a"), (9, "b b")]
    return spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "ids": F.lit("x"), "spans": F.lit(0)})


def test_warc(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x"), (9, "c", "x"), (4, "c", "x"), (None, "q", "x"), (9, "c", "x"), (7, "z", "ÿ" * 1_500_000), (8, "z", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("frame", F.lit(0))
    got = [tuple(r) for r in warc.op3_warc(spark, write(pages, tmp_path, "pages")).collect()]
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        response = i == first[h or ""]
        expected.append((i, len(raw), digest, "response" if response else "revisit", None if response else first[h or ""]))
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    index = warc.write_bundles(pages, str(tmp_path / "small"), min_bytes=2)
    place = index.where("page_id = 7").first()
    head, payload = warc.read_record(place.bundle, place.frame, place.offset)
    assert payload.decode() == "ÿ" * 1_500_000 and head["WARC-Type"] == "response"
    assert {r.record_type for r in warc.read_bundles(index).collect()} == {"response"}
    assert warc.read_bundles(warc.write_bundles(pages.where("false"), str(tmp_path / "none"))).collect() == []


def fingerprint(text, width=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(2)
    base = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(12)]
    out = []
    for words in base:
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(120)] = "edit"
            out.append(" ".join(copy))
    return out


def test_simhash(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(near_texts(), 100)] + [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    got = simhash.op4_simhash(spark, write(spark.createDataFrame(rows, DOCS), tmp_path, "documents")).collect()
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    expected = [(i, f"{fps[k]:016x}", min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("bucket, agree, forests", [(50_000, 1, 1), (60, 1, 1), (50_000, 2, 3), (60, 2, 2)])
def test_trie_join(spark, bucket, agree, forests):
    rng = np.random.default_rng(0)
    fps = set()
    for b in rng.integers(0, 2**64, 30, dtype=np.uint64):
        for _ in range(30):
            v = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 7)):
                v ^= 1 << int(k)
            fps.add(v)
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    expected = simhash._stars(len(x), *np.nonzero(near))
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    links = [(place[r.src], place[r.dst]) for r in simhash.hamming_links(frame, 4, bucket, agree, forests).collect()]
    assert all(near[i, j] for i, j in links)
    assert np.array_equal(simhash._stars(len(x), *np.array(links).T), expected)


def test_links_between_known_sets(spark):
    rng = np.random.default_rng(3)
    fps = {0, *(int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 4)))) for b in rng.integers(0, 2**64, 20, dtype=np.uint64) for _ in range(20))}
    x = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    place = {int(v): k for k, v in enumerate(x.view(np.int64))}
    few = np.array([(place[r.src], place[r.dst]) for r in simhash.hamming_links(frame, 4, agree=2, disjoint=True).collect()])
    label = simhash._stars(len(x), *few.T)
    known = np.where(np.bincount(label, minlength=len(x))[label] > 1, label + 1, 0)
    frame = spark.createDataFrame([(int(v), int(k)) for v, k in zip(x.view(np.int64), known, strict=True)], "fp long, known long")
    found = {(r.src, r.dst) for r in simhash.hamming_links(frame, 4, agree=2).collect()}
    nodes = {int(k): int(np.flatnonzero(known == k)[0]) for k in set(known[known > 0].tolist())} | {v: k for v, k in place.items() if not known[k]}
    i, j = (np.array([nodes[p[e]] for p in found] + few[:, e].tolist(), np.int64) for e in (0, 1))
    assert all(a != b for a, b in found) and len(found) < len(few)
    assert np.array_equal(simhash._stars(len(x), i, j), simhash._stars(len(x), *np.nonzero(near)))


def test_frontier_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    links = simhash.trie_links(np.zeros(len(x), np.int64), x, 4, 0)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert np.array_equal(simhash._stars(len(x), *links), simhash._stars(len(x), *np.nonzero(near)))


def test_keep_one(spark):
    clean = [" ".join(f"c{k}x{j}" for j in range(60)) for k in range(20)]
    base = " ".join(f"b{j}" for j in range(200))
    copies = [base, base, base + " more", base.replace("b7 ", "edit ")]
    rows = [(k, t) for k, t in enumerate(clean + copies)] + [(0, clean[0]), (None, None), (None, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "fp"]
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([*range(21), None])
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def templates(n, pairs, repeats, words=60):
    """Texts near in Hamming distance (a repeated template outweighs the rest) that share half their shingles; ``pairs`` of them share more."""
    head = [f"t{j}" for j in range(words)] * repeats
    own = [[f"o{k}x{j}" for j in range(50)] for k in range(n)]
    for k in range(pairs):
        own[n - 1 - k] = [*own[k][:-8], *(f"e{k}x{j}" for j in range(8))]
    return [" ".join(head + o) for o in own]


def shares(a, b, width=5):
    a, b = (set(zip(*(t.split()[k:] for k in range(width)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_true_pairs_in_a_template_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 40_000)
    n, texts = 1200, templates(1200, 100, 3)
    fps = np.array([[simhash._majority(simhash._mixed(simhash._shingle_hashes(t, 5), s)) for s in range(4)] for t in texts], np.uint64)
    single = set(np.unique(fps[:, 0], return_index=True)[1].tolist())  # one text of each fingerprint
    pairs = [(k, n - 1 - k) for k in range(100) if {k, n - 1 - k} <= single and np.bitwise_count(fps[k] ^ fps[n - 1 - k]).min() <= 8]
    assert shares(texts[0], texts[1]) < 0.8 <= min(shares(texts[a], texts[b]) for a, b in pairs) and len(pairs) > 90
    kept = simhash.keep_one(spark.createDataFrame([(k, texts[k]) for k in single], DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(single - {b for _, b in pairs})


def test_keep_one_by_component(spark):
    texts = [" ".join(f"c{k}x{j}" for j in range(60)) for k in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:7]] + [(None, texts[4]), (3, texts[7]), (2, texts[7] + " more"), (None, texts[0])]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    expected = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:7]] + [(2, texts[7] + " more")]
    assert Counter(tuple(r) for r in kept) == Counter(expected)


def test_equal_fingerprints_are_tested_too(spark):
    texts = templates(8, 1, 200, 61)
    assert len({fingerprint(t, 5) for t in texts}) == 1 and shares(texts[0], texts[1]) < 0.8 < shares(texts[0], texts[7])
    rows = [*enumerate(texts), (8, texts[1].upper())]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(7))


def test_similar_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 40)
    sets = [np.unique(np.r_[base[rng.random(40) < 0.95], rng.integers(0, 60, 3)]) for _ in range(150)] + [base[:0], base[:0]]
    fps = rng.integers(0, 2, (len(sets), 2), dtype=np.uint64) * np.uint64(0xFFFF)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]).min(axis=2) <= 8
    shared = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    sizes = np.array([len(s) for s in sets])
    links = near & (shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared))
    got = simhash._similar_pairs(fps, sizes, np.concatenate(sets), 8, 0.8)
    assert links[got].all()
    assert np.array_equal(simhash._stars(len(sets), *got), simhash._stars(len(sets), *np.nonzero(links)))


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_tokenizer())
    table = odd_docs(spark).unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(near_texts())], DOCS), allowMissingColumns=True)
    got = [tuple(r) for r in token_files.op5_token_files(spark, write(table, tmp_path, "documents")).orderBy("start").collect()]
    hashed = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = sorted(((r.doc_id, r.text, r.h) for r in hashed.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    start, expected = 0, []
    for i, t, _ in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert got == expected


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), token_files.RunEncoder(path)
    texts = [*(t or "" for t in ODD), "hello brave new world", " two  spaces\n\nand lines ", "It's A Mixed CASE"]
    expected = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(raw, encoder.kind).tolist() for raw in encoder.encode(texts)] == expected
    assert encoder.splits == (name == "word_bpe_49k.json")


def test_words_and_marks_by_the_model_alone():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(token_files.default_tokenizer()), token_files.RunEncoder(token_files.default_tokenizer())
    draw = random.Random(7)
    letters, marks = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ", [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "", "", "'s", "1", "\u0301", "É"]
    runs = ["".join(draw.choices(letters, k=draw.randint(1, 12))) + "".join(draw.choices(marks, k=draw.randint(0, 3))) for _ in range(4000)]
    got = [np.frombuffer(raw, encoder.kind).tolist() for raw in encoder.encode([" ".join(runs), *runs])]
    assert encoder.plain and got == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in [" ".join(runs), *runs]]


def test_tables_of_the_run_cache_stay_small(monkeypatch):
    encoder = token_files.RunEncoder(token_files.default_tokenizer())
    monkeypatch.setattr(encoder, "_learn", lambda new: [encoder.known.__setitem__(run, b"") for run in new])
    most = 0
    for start in range(0, 2_000_000, 50_000):
        encoder.encode([" ".join(map(str, range(start, start + 50_000)))])
        most = max(most, sys.getsizeof(encoder.known) + sys.getsizeof(encoder.older))
    assert encoder.older and most < 45_000_000


def test_files_of_attempts_differ(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    index = [warc.write_bundles(pages, str(tmp_path / "same")) for _ in range(2)]
    assert len({i.first().bundle for i in index}) == 2
    assert [r.page_id for i in index for r in warc.read_bundles(i).collect()] == [1, 1]
    wrong = index[0].withColumn("page_id", F.lit(2).cast("long"))
    with pytest.raises(Exception, match="another record"):
        warc.read_bundles(wrong).collect()


def test_blocks_follow_the_count():
    assert [simhash.blocks_to_agree(n) for n in (0, 10**6, 10**7, 10**8, 10**10)] == [1, 1, 1, 2, 2]


def test_short_document_access(spark, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(near_texts())] + [(None, "x")], DOCS)
    path = token_files.default_tokenizer()
    dictionary = token_files.train_dictionary(docs, path)
    manifest = token_files.write_token_files(docs, path, dictionary, str(tmp_path / "ids"))
    encoder = token_files.RunEncoder(path)
    files = [r.path for r in manifest.collect()]
    for k in (0, 5, 95):
        found = [x for f in files if (x := token_files.read_document(f, k, dictionary)) is not None]
        assert [x.tolist() for x in found] == [np.frombuffer(encoder.encode([near_texts()[k]])[0], encoder.kind).tolist()]
    assert all(token_files.read_document(f, 999, dictionary) is None for f in files)
    if dictionary:
        with pytest.raises(ValueError):
            token_files.read_document(files[0], 0, b"other")


def removed_by_definition(rows, n=200):
    count = Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        spans = []
        for i in range(len(raw) - n + 1):
            if count[raw[i : i + n]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + n
                else:
                    spans.append([i, i + n])
        kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
        out.append((d, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("strings", [suffix_dedup.STRINGS, 5])
def test_suffix_dedup(spark, tmp_path, monkeypatch, strings):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé \n\x00") for _ in range(n))
    shared = [text(n) for n in (150, 200, 201, 260, 700)]
    parts = lambda: "".join(rng.choice([text(rng.randrange(300)), rng.choice(shared), "ab" * rng.randint(90, 200), "z" * rng.randint(150, 320)]) for _ in range(rng.randrange(5)))
    rows = [(k, parts()) for k in range(80)]
    rows += [(200, None), (201, ""), (None, "x" * 250), (5, rows[5][1]), (300, rows[7][1]), (None, rows[9][1]), (301, "yz" * 5000)]
    whole = suffix_dedup.with_spans
    monkeypatch.setattr(suffix_dedup, "with_spans", lambda d: whole(d, strings))
    table = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1))
    got = [tuple(r) for r in suffix_dedup.op6_suffix_dedup(spark, write(table, tmp_path, "documents")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, removed_by_definition(rows)))


def test_remove_repeats_and_nothing(spark):
    table = spark.createDataFrame([(1, "é" * 150), (2, "é" * 150 + "end"), (3, None)], DOCS)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(table).collect()} == {1: b"", 2: b"end", 3: b""}
    assert suffix_dedup.remove_repeats(table.where("false")).collect() == []


def test_suffix_arrays_and_prefixes():
    rng = random.Random(4)
    for _ in range(25):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.choice((0, 1, 3, 9, 230)))) for _ in range(rng.randint(1, 6))] + [b"a" * rng.randint(1, 300)]
        shard, data = suffix_dedup.Shard(strings), b"".join(strings)
        suffixes = [(data[i : int(e)], i) for i, e in enumerate(shard.end)]
        order = [i for _, i in sorted(suffixes)]
        assert shard.order.tolist() == order
        shared = [0]
        for a, b in zip(order, order[1:], strict=False):
            x, y = suffixes[a][0], suffixes[b][0]
            shared.append(min(200, next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))))
        assert suffix_dedup.common_prefixes(shard.words, shard.end, shard.order).tolist() == shared


def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(scale=0.5, size=(1500, 16)), np.tile(centres[0], (300, 1))]).astype(np.float32)
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] * 16), (2080, [1.0] * 3), (None, [1.0] * 16), (2100, [float("inf")] * 16), (7, x[7].tolist())]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("leaf", F.lit("x")), x


@pytest.mark.parametrize("block, part", [(ann.BLOCK, ann.SLICE), (64, 16)])
def test_nearest(spark, tmp_path, monkeypatch, block, part):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "SLICE", part)
    table, x = vectors(spark)
    found = {}
    for r in ann.op7_nearest(spark, write(table, tmp_path, "embeddings")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 1800, 20))
    full, ids = np.concatenate([x, x[7:8]]).astype(float), np.r_[np.arange(1800), 7]
    hits = total = 0
    for q, got in found.items():
        scores = (full * full[q]).sum(axis=1)
        scores[ids == q] = -np.inf
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert [s for _, _, s in got] == [(full[v] * full[q]).sum() for _, v, _ in got]
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        least = np.sort(scores)[-20]
        hits += sum(s >= least - 1e-12 for _, _, s in got)
        total += 20
    assert hits / total >= 0.9


def test_nearest_of_one_repeated_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 3)
    table = spark.createDataFrame([(20, [1.0, 2.0])] * 300 + [(7, [0.5, 1.0])], "vec_id long, embedding array<float>")
    for seed in range(6):
        monkeypatch.setattr(ann, "SEED", seed)
        assert [tuple(r) for r in ann.nearest(table, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 7, 2.5)]


def test_nearest_of_few_and_none(spark, tmp_path):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None)], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.op7_nearest(spark, write(table, tmp_path, "embeddings")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.op7_nearest(spark, write(table.where("vec_id = 3"), tmp_path, "embeddings")).collect() == []


def test_pieces_equal_the_library(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(1)
    signs = ["▁", " ", "  ", "    ", "a", "t", "th", "e", "er", "in", "ing", "\n", "\r", "é", "漢", "1", "00", "(", ")", ";", "{", "'", "<s>", "====", "的"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(800)] + ODD + near_texts()[:20]
    table = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash"))
    for r in pieces.op8_pieces(spark, write(table, tmp_path, "documents")).collect():
        expected = library.encode(texts[r.doc_id] or "")
        assert list(r.ids) == expected and r.n_tokens == len(expected)
        assert r.text_sha256 == hashlib.sha256(library.decode(expected).encode()).hexdigest()
    ids = pieces.encode(table.where("doc_id >= 800"), pieces.default_model())
    assert {r.doc_id for r in ids.where("ids IS NULL").collect()} == {800}
    assert {r.doc_id: r.decoded for r in pieces.decoded(ids, pieces.default_model()).collect()}[805] == ODD[5]


def test_unigram_search_is_best():
    with open(pieces.default_model(), "rb") as f:
        raw = f.read()
    at = raw.index(b"\x18\x02", raw.index(b"tok_v0"))  # the model kind
    model = pieces.PieceModel(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    assert model.kind == pieces.UNIGRAM
    for word in sorted(pieces.MARK + w for w in ("internationalization", "theers", "aaaa", "ingthe", "")):
        best = [0.0] + [-1e300] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, len(word) + 1):
                if word[i:j] in model.ids:
                    best[j] = max(best[j], best[i] + model.scores[model.ids[word[i:j]]])
        ids = model.search([word])[0]
        assert "".join(model.pieces[k] for k in ids) == word
        assert sum(model.scores[k] for k in ids) == pytest.approx(best[-1])


def test_shared_prefixes_change_nothing():
    with open(pieces.default_model(), "rb") as f:
        model = pieces.PieceModel(f.read())
    words = sorted(pieces.MARK + w for t in near_texts() for w in t.split())
    assert model.search(words) == [model.search([w])[0] for w in words]


def test_hot_keys_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = left.groupBy("k").count()
    got = joins.join_lookup(left, right, "k", counts, 2000)
    expected = left.join(right, "k", "left").select("k", "id", "v")
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    assert rows(got) == rows(expected)


def test_pipeline(spark, tmp_path):
    texts = near_texts()
    good = [" ".join(f"k{k}v{j}" for j in range(50)) for k in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(good + texts[:8] + ["token = abcdefghijkl0123 " + good[0][::-1], None, "", "short"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    folder = write(table, tmp_path, "documents")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    quality, near, secrets, mixture, _ = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, folder)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == set(range(39))
    one = near(spark, kept, folder)
    ids = {r.doc_id for r in one.collect()}
    assert set(range(31)) <= ids and len(ids & set(range(30, 38))) <= 3 and 38 in ids
    clean = secrets(spark, one, folder)
    assert "<assign>" in next(r.text for r in clean.collect() if r.doc_id == 38)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert mixture(spark, clean, folder).columns == columns
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts_left = {r.doc_id: r.text for r in clean.collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(list(r.ids) == library.encode(texts_left[r.doc_id]) for r in out)
