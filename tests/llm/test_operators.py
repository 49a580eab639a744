"""The corpus operators against libraries and brute force, on texts that are null, empty, long, tied or repeated."""

import base64
import hashlib
import json
import os
import random
import re
import time
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearken.llm import op1_packing, op2_toxicity, op3_lattice, op4_word_bpe, op5_simhash, op6_token_counts, op7_warc, op8_line_dedup, op9_chat, op10_topk

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, length string, ids string, n_dropped string"
WORDS = "river stone amber quiet lantern meadow copper winter harbor signal marble violet timber orchard beacon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(1, 60)) for _ in range(40)]
    texts = [None, "", " ", "\n\n", "<|endoftext|> x <s>", "don't ΣΑΣ Ǆ é é 漢字😀\x1c\x85", "a" * 30_000, sentence(rng, 9_000), *base, *base[:8], *(b.replace(b.split()[0], "zephyr", 1) for b in base[:8])]
    texts += [base[0] + "\n" + base[1], base[2] + "\n" + base[3].replace("a", "A", 1) + "\n\n" + base[0]]
    out = [(i, t, "x", None, "y") for i, t in enumerate(texts)]
    return [*out, out[9], (None, base[5], None, None, None), (None, "lonely words here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_encoding_is_the_librarys(spark, docs, rows):
    lib = Tokenizer.from_file(WORD)
    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op4_word_bpe.encode_digests(docs, WORD).collect())))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))))
    assert got == sorted(want)
    assert op4_word_bpe.encode_documents(docs.limit(0), WORD).count() == 0


def test_encoding_of_random_strings():
    rng, bpe, lib = random.Random(1), op4_word_bpe.WordBpe(WORD, cached_words=50), Tokenizer.from_file(WORD)
    for _ in range(3000):
        t = "".join(rng.choice("aeiouthrsnd'<|>Σσ \n\t\x1c0123é́ñAB.,!?-_漢") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_packing_encodes_new_words_cheaply(spark, docs):
    """Words that a worker hasn't met before were a large part of packing's CPU seconds."""
    same = SimpleNamespace(mapInArrow=lambda run, _: run)
    run = op1_packing.tokenized_pieces(SimpleNamespace(sparkSession=spark, schema=docs.schema, select=lambda *_: same), WORD)
    made = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "t"])
    rng, dp, lib, cpu = random.Random(5), op4_word_bpe.WordBpe(WORD), Tokenizer.from_file(WORD), time.process_time
    syllables, ends = "th an ing ñad éou sch ö ère tion o qu ä heit ble ver ll um con ped ra zu ich ê ción mo gl ump esk".split(), ["", "", "", ".", "***", ",'s", "'s", "!!", "?'", "-9"]
    list(run([made(["a"])]))
    spent = [0.0, 0.0]
    for _ in range(5):
        texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(3, 6))) + rng.choice(ends) for _ in range(200)) for _ in range(25)]
        at = cpu()
        got = [r for b in run([made(texts)]) for r in b.to_pylist()]
        spent[0] += cpu() - at
        at = cpu()
        ids = [dp.encode(t) for t in texts]
        spent[1] += cpu() - at
        want = [np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
        assert [i + (1).to_bytes(4, "little") for i in ids] == want
        assert [(r["doc_id"], r["length"], r["ids_crc32"]) for r in got] == [(k, len(w) // 4, zlib.crc32(w)) for k, w in enumerate(want)]
    assert spent[0] < 0.8 * spent[1], spent


def test_packing_encoding_of_random_strings():
    rng, bpe, lib = random.Random(6), op4_word_bpe.LibraryBpe(WORD, cached_words=50), Tokenizer.from_file(WORD)
    for _ in range(3000):
        t = "".join(rng.choice("aeiouthrsnd'<|>Σσ \n\t\x1c0123é́ñAB.,!?-_漢ªß²\u0558") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_counts_are_the_librarys(docs, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(str, (tuple(r) for r in op6_token_counts.count_tokens(docs, PIECE, limit=100).collect())))
    n = lambda t: len(lib.encode(t or ""))
    assert got == sorted(str((i, len((t or "").encode()), n(t), n(t) > 100)) for i, t, *_ in rows)
    rng, own = random.Random(2), op6_token_counts.PieceCounter(PIECE, cached=50)
    for _ in range(3000):
        t = "".join(rng.choice("aeiouthrs<|>▁   \n\t\x00é́ñAB.,!?-_漢😀") for _ in range(rng.randint(0, 40)))
        assert own.count(t) == n(t), ascii(t)


def test_packing(docs, rows):
    lib = Tokenizer.from_file(WORD)
    got = op1_packing.pack_documents(docs, WORD, limit=64).collect()
    want = []
    for i, t, *_ in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k, 64 * k, len(p := ids[64 * k : 64 * k + 64]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(-(-len(ids) // 64))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 1
    assert op1_packing.pack_documents(docs.limit(0), WORD).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        limit = rng.choice([7, 30, 100])
        counts = {rng.randint(1, limit): rng.randint(1, 50) for _ in range(8)}
        room = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = [r for r in room if r >= n]
                r = min(fit, default=limit)
                if fit:
                    room.remove(r)
                room.append(r - n)
        slots = op1_packing.plan_best_fit(counts, limit)
        assert len({s + j for _, _, k, s, _ in slots for j in range(k)}) == len(room)
    with pytest.raises(ValueError):
        op1_packing.plan_best_fit({8: 1}, 7)


def test_simhash_against_brute_force(docs, rows):
    def of(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(s))

    prints = {t: of(t) for _, t, *_ in rows}
    group = {t: t for t in prints}
    changed = True
    low = {t: min((i for i, x, *_ in rows if x == t and i is not None), default=10**9) for t in prints}
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and low[b] < low[a]:
                    low[a], changed = low[b], True
    got = op5_simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for i, t, *_ in rows:
        by[i].add((prints[t], None if low[t] == 10**9 else low[t]))
    assert all((r.f0 & (1 << 64) - 1, r.component_id) in by[r.doc_id] for r in got)
    assert group and op5_simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = op5_simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 8 in ids and 48 not in ids


def test_keys_of_fingerprints_are_never_broadcast(spark, tmp_path):
    spark.range(2000).select(F.xxhash64("id").alias("n"), F.xxhash64("id").alias("f0")).write.parquet(f"{tmp_path}/p")
    keyed = spark.read.parquet(f"{tmp_path}/p").withColumn("key", F.explode(op5_simhash._variants(1)))
    plan = op5_simhash._in_company(keyed, F.struct("n", "f0"), "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_similar_documents_against_brute_force(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(n)]
    texts = ["", None, "one two three four five six", "one two three four"]
    for n in (40, 120, 300):
        for edits in (0, 1, 2, 3, 4, 5, 7):
            for _ in range(6):
                a = fresh(n)
                b = list(a)
                for at in rng.sample(range(n), edits * n // 120 + (edits > 0)):
                    b[at] = fresh(1)[0]
                texts += [" ".join(a), " ".join(b)]
    texts = [t if t is None or k % 5 else t + " this passage stands in many of the texts" for k, t in enumerate(texts)]
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    links = 0
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1) >= 0.8 or sets[a] == sets[b]:
                links += 1
                root = [root[a] if r == root[b] else r for r in root] if root[a] < root[b] else [root[b] if r == root[a] else r for r in root]
    assert 30 < links < 126
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op5_simhash.similar_documents(d).collect()}
    assert got == dict(enumerate(root))
    assert {r.doc_id for r in op5_simhash.one_of_each(d).collect()} == set(root)
    assert op5_simhash.one_of_each(d.limit(0)).count() == 0


def test_pipelines_near_dedup_links_by_simhash_and_by_similarity(spark):
    """Some pairs are within 4 bits but below 0.8, some the other way round, some both; each must hang together."""
    import corpus_pipeline

    rng = random.Random(36)
    texts = ["", "one two three four five", None]
    for _ in range(150):
        a = [f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(rng.choice((30, 60, 200)))]
        b = list(a)
        for at in rng.sample(range(len(a)), rng.choice((1, 1, len(a) // 50 + 1))):
            b[at] = "other"
        texts += [" ".join(a), " ".join(b)]
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    prints = [op5_simhash.fingerprints_of(t or "")[0] & (1 << 64) - 1 for t in texts]
    root, kinds = list(range(len(texts))), set()
    for b in range(len(texts)):
        for a in range(b):
            similar = len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1) >= 0.8 or sets[a] == sets[b]
            near = (prints[a] ^ prints[b]).bit_count() <= 4
            if similar or near:
                kinds.add((similar, near))
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert kinds == {(True, True), (True, False), (False, True)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, d, "").collect()} == set(root)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    rng = random.Random(13)
    a, b, c = (sentence(rng, 30) for _ in range(3))
    d = spark.createDataFrame([(1, a), (2, b), (2, c), (2, c), (3, a), (3, b), (2, c + " end"), (None, a)], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in op5_simhash.one_of_each(d).collect()]
    assert len(got) == 4 and {(1, a), (2, b), (None, a)} <= set(got) and {t for i, t in got if i == 2} - {b} <= {c, c + " end"}


def test_lines_against_brute_force(docs, rows):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < op8_line_dedup.MIN_WORDS:
            return False
        p = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    order = sorted({(i is None, i or 0, k, tuple(w)) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n")) if (w := re.split(r"[\t-\r ]+", line.strip("\t\n\r\x0b\x0c "))) != [""]})
    gone = {(n, i, k, w) for j, (n, i, k, w) in enumerate(order) if any(x == w or near(x, w) for *_, x in order[:j])}
    got = {(r.doc_id, r.text): r.n_dropped for r in op8_line_dedup.dedup_lines(docs.drop("n_dropped"), counts=True).collect()}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        drop = [k for k, x in enumerate(lines) if (i is None, i or 0, k, tuple(x.split())) in gone]
        want = t if not drop else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        assert got[i, want] == len(drop), (i, want)
    assert op8_line_dedup.without_repeated_lines(docs).columns == docs.columns
    assert op8_line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_a_long_document_do_not_each_cost_its_whole_text(spark):
    """Neither are a text's lines parted anew for each line kept, nor is the text hashed or carried along for each."""
    rng = random.Random(43)
    lines = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(9)) for _ in range(12_000)]
    d = spark.createDataFrame([(1, "\n".join([*lines, "\t" + lines[0].replace(" ", " \x0b ")]))], "doc_id long, text string")
    plan = op8_line_dedup._raw_lines(d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")
    began = time.time()
    (r,) = op8_line_dedup.dedup_lines(d, counts=True).collect()
    assert (r.n_lines, r.n_dropped, r.text) == (12_001, 1, "\n".join(lines)) and time.time() - began < 40


def test_line_dedup_lets_go_of_its_tables_and_shuffles(spark, monkeypatch):
    """When the last tables are read, those of near lines are gone, and no shuffle of finished jobs is kept."""
    seen, release = [], op8_line_dedup.release
    count = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def watched(spark, *done):
        before, files = count(), [f.removeprefix("file:").replace("//", "/") for t in done for f in t.inputFiles()]
        release(spark, *done)
        time.sleep(2)  # the cleaner has a thread of its own
        seen.append((before, count(), len(files), sum(map(os.path.exists, files))))

    monkeypatch.setattr(op8_line_dedup, "release", watched)
    rng = random.Random(41)
    texts = ["\n".join(sentence(rng, 9) for _ in range(20)) for _ in range(40)]
    d = spark.createDataFrame([*enumerate(texts), (99, texts[0].replace(texts[0].split()[3], "other", 1))], "doc_id long, text string")
    assert op8_line_dedup.dedup_lines(d, counts=True).where("n_dropped > 0").count() >= 1
    assert len(seen) == 2 and seen[0][1] < seen[0][0] / 4 and seen[1][1] <= seen[1][0] and seen[1][2] > 0 == seen[1][3], seen


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    tight = base[0] + 0.03 * rng.standard_normal((40, 16))
    loose = base[1] + 0.22 * rng.standard_normal((60, 16))
    x = [*map(list, map(lambda v: [float(a) for a in v], [*base, *tight, *loose, base[2], base[2] * 3]))]
    data = [(i, v, int(i % 2 if i < 30 else 0)) for i, v in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, x[0], None), (None, x[0], 0), (904, [None] + [1.0] * 15, 0), (905, [float("inf")] * 16, 0), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame([*data, *odd], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in op3_lattice.link_vectors(df, tables=12, probes=12).collect()}
    m = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    links = (m @ m.T >= 0.93) & (np.array([d[2] for d in data])[:, None] == np.array([d[2] for d in data]))
    np.fill_diagonal(links, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= links[i].sum() for i in range(len(x)))
    assert found >= 0.97 * links.sum() > 1000
    assert all(got[i].component_id == 0 for i in range(30, 70)) and got[0].kept and not got[31].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, *_ in odd)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)).round(2)
    x[100:110] = x[50]
    odd = [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [1.0, 2.0])]
    df = spark.createDataFrame([*((i, [float(a) for a in v]) for i, v in enumerate(x)), *odd], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in op10_topk.top_k(df).collect()]
    q = np.floor(256 * x)
    want = []
    for i in range(0, 400, 50):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == want


def test_top_k_of_large_components_copies_and_nothing(spark):
    rng = random.Random(14)
    x = [(i, [float(rng.randint(-3, 3)) * 10.0 ** rng.choice([0, 3, 6, 7]) for _ in range(4)]) for i in range(200)]
    x += [(50, [1e6, 1.0, 0.0, 0.0]), (7, x[7][1]), (7, x[7][1]), (300, [1e300, 0.0, 0.0, 0.0]), (301, [1.0, 2.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("clash"), "score": F.lit(1), "d": F.lit(2)})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op10_topk.top_k(df, every=100).collect())
    want = []
    for q, v in [(0, x[0][1]), (100, x[100][1]), (300, [1e300, 0.0, 0.0, 0.0])]:
        long = lambda s: max(-(2**63), min(s, 2**63 - 1))
        of = sorted((-long(sum(int(256 * a) * int(256 * b) for a, b in zip(v, w, strict=True))), i) for i, w in x if i != q and len(w) == 4)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(of)]
    assert got == sorted(want)
    assert op10_topk.top_k(df.limit(0)).count() == 0


def test_m_tree_spares_products():
    rng = np.random.default_rng(15)
    x = np.floor(256 * np.concatenate([c + 0.01 * rng.standard_normal((300, 6)) for c in 3 * rng.standard_normal((30, 6))]))
    tree = op10_topk.MTree(np.arange(len(x)), x)
    assert not tree.members[tree.top][0] and any(not tree.members[k][0] for k in tree.members[tree.top][1])
    seen = []
    scores = tree._scores
    tree._scores = lambda q, norm, x, norms: seen.append(len(x)) or scores(q, norm, x, norms)
    for i in range(0, len(x), 900):
        best = sorted((-int(x[i] @ r), j) for j, r in enumerate(x) if j != i)[:5]
        assert tree.search(x[i], i, 5) == [(-s, j) for s, j in best]
    assert sum(seen) < 0.1 * 10 * len(x)


def test_warc_round_trip(spark):
    pages = [(5, "http://a", "same"), (3, "http://b", "same"), (9, "u\r\nv", None), (8, None, ""), (None, "http://c", "same"), (7, "x", "é" * 50_000), (5, "http://a", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = op7_warc.write_archives(df)
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op7_warc.read_records(index).collect())))
    assert got == sorted(map(str, [(3, 4, "response", None), (5, 4, "revisit", 3), (5, 4, "revisit", 3), (8, 0, "response", None), (9, 0, "revisit", 8), (None, 4, "response", None), (7, 100_000, "response", None)]))
    some = {r.page_id: bytes(r.payload) for r in op7_warc.read_records(index.where("page_id in (3, 7)"), keep_payload=True).collect()}
    assert some == {3: b"same", 7: ("é" * 50_000).encode()}
    digest = {r.payload_digest for r in op7_warc.round_trip(df.where("page_id = 3")).collect()}
    assert digest == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert op7_warc.round_trip(df.limit(0)).count() == 0


def test_warc_copies_have_one_response(spark, tmp_path):
    rows = [(1, "a", "x" * 500)] * 4 + [(2, "b", "x" * 500), (7, "c", "other")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("offset", F.lit(1)).repartition(4).write.parquet(f"{tmp_path}/pages")
    got = op7_warc.round_trip(spark.read.parquet(f"{tmp_path}/pages")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(1, "response", 0), *[(1, "revisit", 1)] * 3, (2, "revisit", 1), (7, "response", 0)]
    least = op7_warc.read_records(op7_warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), min_bytes=501))
    assert {r.record_type for r in least.collect()} == {"response"}


def test_long_chats_take_time_in_proportion(spark):
    took = []
    for n in (1_000, 4_000, 16_000):
        turns = spark.createDataFrame([(1, i, "assistant" if i // 3 % 2 else "user", f"text {i} of ### it") for i in range(n)], "conv_id long, turn long, role string, text string").coalesce(1)
        begin = time.time()
        r = op9_chat.digests(turns).first()
        took.append(time.time() - begin)
        assert r.n_turns == n and r.loss_chars == sum(len(f"text {i} of ### it") for i in range(n) if i // 3 % 2)
    assert took[2] < 8 * took[1] + 5


def test_odd_chats(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 1, "assistant", "\ufeffa\ufeff"), (1, 1, "assistant", "\ufeffa\ufeff"), (1, 1, "assistant", None), (2, 0, None, "😀" * 5_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2)})
    got = {r.conv_id: r for r in op9_chat.read_back(op9_chat.format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("assistant", "b"), ("user", "a")]
    assert got[1].loss_texts == ["", "\ufeffa\ufeff", "\ufeffa\ufeff"] and got[2].turns[0].text == "😀" * 5_000 and got[2].loss_texts == []


def test_chat_round_trip(spark):
    parts = ["", "\\", "###", "</turn>\n", "<part>", "\\h\\\\t", ": ", "é😀", "</tur"]
    rng = random.Random(7)
    turns = [(c, t, rng.choice(["user", "assistant", None, "as: ###"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(4))])) for c in range(30) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.conv_id: r for r in op9_chat.read_back(op9_chat.format_conversations(df)).collect()}
    for c in range(30):
        own = [(r or "", x or "") for k, _, r, x in turns if k == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss_texts == [x for r, x in own if r == "assistant"]
    assert op9_chat.digests(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        docs.append((i, sentence(rng, 40) + (" " + rng.choice(["grotblat", "vexmur", "skornik"]) * 1 + " vexmurish" if bad else ""), None))
        labels.append((i, 1, int(bad)))
    docs += [(2000, None, "c"), (2001, "", None), (None, "quiet river", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3000, 1, None)], "doc_id long, quality int, toxic int")
    got = op2_toxicity.score(d, op2_toxicity.fit(d, lab)).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, *_ in docs if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.predicted == int(r.doc_id < 900 and r.doc_id % 5 == 0) for r in held]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in got)
    none = op2_toxicity.fit(d, lab.limit(0))
    assert {r.predicted for r in op2_toxicity.score(d, none).collect()} == {0}
    assert op2_toxicity.without_toxic(d, lab).columns == d.columns


def test_toxicity_learns_from_no_held_out_row_and_flags_nothing_without_evidence(spark):
    rng = random.Random(16)
    rows = [(i, sentence(rng, 30) + (" grotblat vexmur" if i % 4 == 0 else "")) for i in range(400)]
    d = spark.createDataFrame([*rows, (1000, "grotblat " * 40_000), (1001, None), (1001, None)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "predicted": F.lit(7)})
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    told = lambda lie: spark.createDataFrame([(i, 1, int(i % 4 == 0) if not (lie and held(i)) else int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    a, b = op2_toxicity.fit(d, told(False)), op2_toxicity.fit(d, told(True))
    assert a.features == b.features and a.bias == b.bias and (a.weights == b.weights).all() and {"grotblat", "vexmur"} <= set(a.features)
    got = op2_toxicity.score(d, a, keep=True)
    assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    by = {r.doc_id: r.predicted for r in got.collect()}
    assert by[1000] == 1 and by[1001] == 0 and got.where("doc_id = 1001").count() == 2
    noise = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(1, 400, 4)] + [(i, 1, 1) for i in range(2, 400, 4)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in op2_toxicity.score(d.limit(0).unionByName(d.where("doc_id % 4 <> 0")), op2_toxicity.fit(d, noise.where("doc_id % 4 <> 0"))).collect()} <= {0, 1}
    assert {r.predicted for r in op2_toxicity.score(d, op2_toxicity.fit(d, told(False).withColumn("toxic", F.lit(1)))).collect()} == {0}
    assert op2_toxicity.score(d.limit(0), a).count() == 0


def test_toxicity_of_few_labels(spark):
    """On two thirds of 60 rows no word passes any bound, on all of them one does."""
    rng = random.Random(21)
    rows = [(i, sentence(rng, 30) + (" grotblat" if i % 3 == 0 else "")) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = op2_toxicity.fit(d, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(80)], "doc_id long, quality int, toxic int"))
    assert "grotblat" in model.features
    assert {r.doc_id for r in op2_toxicity.score(d, model).collect() if r.predicted} == set(range(0, 80, 3))


def test_label_model_sees_accuracies_and_correlations():
    rng = np.random.default_rng(9)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, e, f, c = vote(0.9), vote(0.8), vote(0.85), vote(0.75), vote(0.7)
    p, means, corr = op2_toxicity.label_model(np.stack([a, b, c, c, e, f], 1), 0.3)
    assert ((p > 0.5) == y).mean() > 0.94  # the best voter alone is right on 0.9
    gap = means[1] - means[0]
    assert gap[0] > gap[1] > gap[2] and corr[2, 3] > 0.9 > abs(corr[0, 1])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    clean = [sentence(rng, 80) for _ in range(60)]
    texts = [*clean, *(c + " grotblat vexmur" for c in (sentence(rng, 80) for _ in range(40))), clean[0], clean[1].replace(clean[1].split()[0], "zephyr", 1)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert ids >= set(range(2, 60)) and not ids & set(range(60, 102))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    assert json.dumps(sorted(ids))
