"""Operators over pairs, archives, models and the pipeline, against plain implementations."""

from __future__ import annotations

import itertools
import os
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import common, decontaminate, hmm, jaccard_join, knn_quality, langid, pieces, queries, secret_scan, warc
from sluice.llm.common import Stage, fold, shared_dir
from tests.llm.test_scans import EDGE, MODEL, edge_docs, empty_docs

SF = "/root/testdata/sf0.001"


def crc(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


# ---- op5 ----


def plain_join(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    classes: dict[str, list[int]] = {}
    for i, t in rows:
        classes.setdefault(t, []).append(i)
    sets = {}
    for t, ids in classes.items():
        w = t.encode().split()
        sets[min(ids)] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (min(ids), len(ids), links[min(ids)], find(min(ids))) for ids in classes.values() for i in ids}


def near_copies(n: int, groups: int, edits: int, seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    bases = [[word() for _ in range(rng.randint(60, 90))] for _ in range(groups)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("config", [jaccard_join.Config(), jaccard_join.Config(block_docs=7), jaccard_join.Config(block_bytes=2000)])
def test_join_equals_all_pairs(spark, config):
    rows = near_copies(150, 12, 3, 1) + [(900 + k, t) for k, t in enumerate(["a b c", "a b c", "a b", "", "", " \n", "one two three four five", "one two three four five "])]
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
    assert got == plain_join(rows)


def test_a_large_near_group_keeps_every_link(spark):
    rows = near_copies(400, 1, 1, 2)
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Config(block_docs=64)).collect()}
    assert got == plain_join(rows)


def test_a_long_chain_is_dealt_by_buckets(spark):
    """Texts that share some windows with the next ones only: one component, few pairs in a bucket. All links are found, and
    no text is sent more often than it has bands."""
    rng = random.Random(6)
    word = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(word[4 * k : 4 * k + 60])) for k in range(600)] + [(1000 + k, f"{t} {rng.choice(word)}") for k, t in near_copies(60, 1, 1, 8)]
    c = jaccard_join.Config(block_docs=8, bands=60, rows=2, step=24)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in jaccard_join.join(frame, c).collect()}
    assert got == plain_join(rows)
    stage = common._stages[-1].path
    extent = spark.read.parquet(f"{stage}/extent")
    assert extent.filter("by_bucket").count() >= 1


def test_of_equal_rows_one_stays(spark):
    rows = [(1, "a b c d e f g", "z", 1.0), (1, "a b c d e f g", "a", 2.0), (1, "a b c d e f g", "a", 2.0), (2, "a b c d e f g", "a", 0.0), (3, "other", None, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, Key string, `__id` double"))
    assert kept.columns == ["doc_id", "text", "Key", "__id"] and sorted(map(tuple, kept.collect())) == [(1, "a b c d e f g", "a", 2.0), (3, "other", None, None)]


def test_intersections_are_the_same_by_either_way():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)]
    left, right = np.triu_indices(40, 1)
    many = jaccard_join.common_counts(sets, np.tile(left, 2), np.tile(right, 2))
    assert many[: len(left)].tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]
    assert jaccard_join.common_counts(sets, left[:9], right[:9]).tolist() == many[:9].tolist()


def test_pruning_follows_the_posterior():
    c = jaccard_join.Config()
    need = jaccard_join.least_matches(c)
    assert sorted(need) == [25, 50, 75, 100, 125] and all(0 < m < 0.8 * n for n, m in need.items())
    grid = np.linspace(0, 1, 200_001)
    for n, m in need.items():
        def above(k, n=n):
            w = grid**k * (1 - grid) ** (n - k)
            return w[grid >= 0.8].sum() / w.sum()

        assert above(m) >= c.tolerance * 0.9 and above(m - 1) < c.tolerance * 1.1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    names = list(range(300))
    rng.shuffle(names)
    frame = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in jaccard_join.components(Stage(spark, "test"), frame, "c").collect()}
    for part in (range(41), range(100, 140), range(200, 203)):
        assert {got[names[k]] for k in part} == {min(names[k] for k in part)}
    assert jaccard_join.components(Stage(spark, "test"), frame.limit(0), "c").count() == 0


def test_join_edges(spark):
    rows = jaccard_join.join(edge_docs(spark)).collect()
    assert len(rows) == len(EDGE) + 3
    by = {(r.doc_id, r.n_copies): r for r in rows}
    assert by[(4, 2)].class_id == 4 and (0, 1) in by and by[(0, 1)].group_id == 0
    assert jaccard_join.join(empty_docs(spark)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "other words in this one here"), (7, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in jaccard_join.join(twice).collect()), key=str)
    assert got == sorted([(5, 5, 3), (5, 5, 1), (7, 5, 3), (None, 5, 3), (None, None, 1)], key=str)
    kept = jaccard_join.keep_one(twice).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, "a b c d e f"), (5, "other words in this one here"), (None, None)], key=str)


# ---- op2 ----


def pages(spark, extra=()):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", big, "t"), (2, "http://a/2", big, "t"), (9, "http://a/\r\n9 9", big, None), (3, None, "small", "t"), (4, "u", "small", "t"), (5, "u", None, "t"), (6, "u", "", "t"), (7, "é", "é" * 600, "t"), *extra]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")


def test_archive_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    frame = pages(spark)
    warc.write(frame, path)
    rows = {r.page_id: r for r in warc.read(spark, path).collect()}
    html = {r.page_id: (r.html or "").encode() for r in frame.collect()}
    assert {k: bytes(r.payload) for k, r in rows.items()} == html
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None), **{k: ("response", None) for k in (3, 4, 5, 6, 7)}}
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # the big one, small, empty, é
    for k, r in rows.items():
        (header, content), = warc.split(bytes(r.record))
        assert f"WARC-Type: {r.record_type}\r\n".encode() in header
        assert content.split(b"\r\n\r\n", 1)[1] == (b"" if r.record_type == "revisit" else html[k])
    assert b"%0D%0A9%209" in bytes(rows[9].record)


def test_warc_files_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(pages(spark, [(8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n", "t")]), path)
    records = warc.read(spark, path)
    warc.export(records, f"file://{tmp_path}/files")
    got = warc.parse(spark, f"file://{tmp_path}/files").collect()
    assert sorted(bytes(r.header) + bytes(r.content) + b"\r\n\r\n" for r in got) == sorted(bytes(r.record) for r in records.collect())


def test_archive_refuses_changed_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write(pages(spark), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"{path}/changed")
    import shutil

    shutil.rmtree(f"{tmp_path}/a/payloads")
    shutil.move(f"{tmp_path}/a/changed", f"{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, path).select("payload_bytes").collect()


def test_archive_edges(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    warc.write(pages(spark).limit(0), path)
    assert warc.read(spark, path).count() == 0
    big = "y" * 1000
    warc.write(pages(spark, [(11, "u", big, ""), (11, "u", big, ""), (10, "u", big, ""), (None, "u", big, "")]), path + "2")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, path + "2").collect() if r.payload_bytes == 1000), key=str)
    assert got == sorted([(11, "response", None), (11, "response", None), (10, "revisit", 11), (None, "revisit", 11)], key=str)


# ---- op4 ----


def test_base_score_counts_and_known(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    split = lambda t: [*hmm.words_of(t.translate(low).encode()), b""]
    seen = Counter(x for i, t in docs if crc(i, 7) != 2 for x in split(t))
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in queries.op4_hidden_markov(spark, SF).collect()}
    assert len(got) == len(docs)
    held = [0.0, 0.0]
    for i, t in docs:
        r, x = got[i], split(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 7) == 2, len(x), sum(seen[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((seen[w] + 1) / (n + v + 1)) for w in x))
        held = [held[0] + r.base_score * r.held_out, held[1] + r.score * r.held_out]
    assert held[1] > held[0]


def plain_likelihood(m: hmm.Model, seq) -> float:
    a = m.first * m.emit[seq[0]]
    for x in seq[1:]:
        a = (a @ m.move) * m.emit[x]
    return float(np.log10(a.sum()))


def small_model(c, symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(c.states), 0), norm(rng.random((c.states, c.states)), 1), norm(rng.random((symbols, c.states)), 0))


@pytest.mark.parametrize("block, cells, every", [(1024, 10_000, 8), (3, 20, 2), (1, 1, 1)])
def test_recursions_are_exact_in_blocks(block, cells, every):
    c = hmm.Config(states=3, block=block, cells=cells, every=every)
    m, rng = small_model(c, 6), np.random.default_rng(1)
    seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 5, 2, 9, 7, 9)]
    assert np.allclose(hmm.likelihood(m, seqs, c), [plain_likelihood(m, s) for s in seqs])
    want_first, want_move, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    short = [s for s in seqs if len(s) <= 7]
    for s in short:  # all paths
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.first[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            p /= 10 ** plain_likelihood(m, s)
            want_first[path[0]] += p
            for t, k in enumerate(path):
                want_emit[s[t], k] += p
                if t:
                    want_move[path[t - 1], k] += p
    for kind, near in ((np.float64, 1e-12), (np.float32, 1e-5)):
        first, move, emit = hmm.expect(m, short, c, kind)
        assert np.allclose(first, want_first, near) and np.allclose(move, want_move, near) and np.allclose(emit, want_emit, near)


def test_blocks_hold_the_sequences_that_reach_them(monkeypatch):
    """One long sequence beside many short ones: the blocks beyond these hold the long one alone."""
    c, sizes, given = hmm.Config(states=3, block=4, cells=100), [], hmm.Recursion.given
    m, rng = small_model(c, 6), np.random.default_rng(2)
    seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (40, *[4] * 9, 1)]
    monkeypatch.setattr(hmm.Recursion, "given", lambda self, part: sizes.append(part.shape) or given(self, part))
    assert np.allclose(hmm.likelihood(m, seqs, c), [plain_likelihood(m, s) for s in seqs])
    assert sizes == [(4, 11)] + [(4, 1)] * 9
    sizes.clear()
    assert hmm.expect(m, seqs, c)[2].sum() == pytest.approx(sum(map(len, seqs)))
    assert sizes == [(4, 11)] + [(4, 1)] * 8 + [(4, 1)] * 9 + [(4, 11)]


def test_training_raises_likelihood():
    c = hmm.Config(states=2, smooth=0.0)
    rng = np.random.default_rng(2)
    seqs = [np.repeat(rng.integers(0, 2, 8), 5).astype(np.int32) * 3 + rng.integers(0, 3, 40).astype(np.int32) for _ in range(60)]
    shares = np.bincount(np.concatenate(seqs), minlength=6) / 2400
    m, last = hmm.initial(shares, c), -np.inf
    for _ in range(8):
        total = hmm.likelihood(m, seqs, c).sum()
        assert total >= last - 1
        last, m = total, hmm.improve(*hmm.expect(m, seqs, c), shares, c)
    assert last > sum(np.log10(shares[s]).sum() for s in seqs)


def plain_scores(rows, teach, c: hmm.Config) -> list[float]:
    """Every text's score, by the definition alone: dictionaries, one sequence at a time, no blocks, no scaling."""
    tokens = [[*hmm.words_of((t or "").encode()), b""] for _, t in rows]
    taught = [x for x, (i, _) in zip(tokens, rows, strict=True) if teach(i)]
    seen = Counter(w for x in taught for w in x)
    order = sorted((w for w in seen if w), key=lambda w: (-seen[w], w))
    head, tail = order[: c.head], order[c.head :]
    kind = lambda w: zlib.crc32(w[-3:]) % c.classes
    place = {w: k for k, w in enumerate(head)} | {b"": len(head) + c.classes}
    symbol = lambda w: place.get(w, len(head) + kind(w))
    n_class, v_class = Counter(), Counter(map(kind, tail))
    for w in tail:
        n_class[kind(w)] += seen[w]
    shares = np.array([*(seen[w] for w in head), *(n_class[k] + 1 for k in range(c.classes)), seen[b""]], float)
    shares /= shares.sum()
    m = hmm.initial(shares, c)
    for _ in range(c.rounds):
        first, move, emit, own = np.zeros(c.states), np.zeros((c.states, c.states)), np.zeros_like(m.emit), {}
        for x in taught:
            e = m.emit[[symbol(w) for w in x]]
            alpha, beta = [m.first * e[0]], [np.ones(c.states)]
            for t in range(1, len(x)):
                alpha.append((alpha[-1] @ m.move) * e[t])
                beta.append(m.move @ (e[-t] * beta[-1]))
            beta, p = beta[::-1], alpha[-1].sum()
            for t, w in enumerate(x):
                g = alpha[t] * beta[t] / p
                emit[symbol(w)] += g
                own[w] = own.get(w, 0) + g
                first += g * (t == 0)
                if t:
                    move += alpha[t - 1][:, None] * m.move * (e[t] * beta[t]) / p
        m = hmm.improve(first, move, emit, shares, c)
    part, sums = {}, {}
    for w in tail:
        steps = np.round((hmm.LEVELS - 1) * own[w] / own[w].sum()) + 1
        part[w] = seen[w] * steps / steps.sum()
        sums[kind(w)] = sums.get(kind(w), 0) + part[w]

    def emission(w):
        if w in place:
            return m.emit[place[w]]
        k = kind(w)
        share = sums[k] / sums[k].sum() if k in sums else np.full(c.states, 1 / c.states)
        return m.emit[symbol(w)] * (part.get(w, 0) / share + 1) / (n_class[k] + v_class[k] + 1)

    out = []
    for x in tokens:
        a = m.first * emission(x[0])
        for w in x[1:]:
            a = (a @ m.move) * emission(w)
        out.append(float(np.log10(a.sum())))
    return out


@pytest.mark.parametrize("common", [0, 9, 100])
def test_scores_equal_plain_recursions(spark, common):
    """Also where common words are looked up by broadcast and where by join, which changes nothing."""
    c = hmm.Config(states=3, head=4, common=common, classes=4, rounds=2, flush=5, block=7, together=40)
    rng = random.Random(3)
    say = "the cat and a dog ran THE end of Day two three four five six seven eight nine ten".split()
    rows = [(k, " ".join(rng.choice(say) + "x" * (rng.random() < 0.1) for _ in range(rng.randrange(14)))) for k in range(40)]
    rows += [(40, None), (41, "new words only é"), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in hmm.score(docs, F.col("doc_id") < 30, F.col("doc_id") >= 30, c).collect()}
    assert len(got) == len(rows) and got[40].n_tokens == 1 and got[41].n_known == 1
    for (i, _), want in zip(rows, plain_scores(rows, lambda i: i < 30, c), strict=True):
        assert got[i].score == pytest.approx(want, rel=1e-4)


class Task:
    """Stands for the DataFrame and the session of a pass; keeps what a task runs."""

    sparkSession = sparkContext = property(lambda self: self)
    broadcast = staticmethod(lambda x: SimpleNamespace(value=x))

    def mapInArrow(self, run, schema):
        self.run = run
        raise StopIteration


def last_pass(groups: int) -> tuple[int, int]:
    """Rows that a task of the last pass sends, and the most bytes that it holds beside its input."""
    c, task = hmm.Config(states=8, head=2, classes=16, cells=2000, together=8000), Task()
    v = hmm.Vocabulary([b"a", b"b", b"c"], c, 2)
    m = hmm.initial(np.full(19, 1 / 19), c)
    with pytest.raises(StopIteration):
        hmm._round(task, m, None, task.broadcast(hmm.Ranks(v.symbol, 2, pa.array([b"c"], pa.binary()))), c, object())

    def batches():
        for g in range(groups):
            seqs, own, kinds = v.encode([b"a b c " + b" ".join(b"w%dx%d" % (g, k) for k in range(d, d + 96)) for d in range(0, 4000, 100)])
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int16())), pa.array(own, pa.list_(pa.binary()))], ["seq", "kinds", "words"])

    tracemalloc.start()
    rows = sum(b.num_rows - b.column("word").null_count for b in task.run(batches()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


def test_the_last_pass_holds_one_group_of_rows():
    """A task that meets ever new words holds no more for more rows, and sends each word and its count."""
    last_pass(1)
    (rows, few), (more_rows, many) = last_pass(3), last_pass(24)
    assert (rows, more_rows) == (3 * 40 * 96 + 1, 24 * 40 * 96 + 1)
    assert many < 1.25 * few


def test_sums_take_rows_by_word_then_symbol():
    """Symbols' rows come before words'; a key's rows may lie in several batches, and one batch may hold both kinds."""
    of = lambda symbols, words, rows: hmm._sent(symbols, words, np.array(rows, float))
    two = [of([3, 5], None, [[1, 2], [3, 4]]), of([5], None, [[10, 20]]), of(None, [b"a"], [[2, 1, 1]]), of(None, [b"a", b"b"], [[4, 3, 1], [1, 1, 0]])]
    mixed = pa.Table.from_batches(two[1:3]).combine_chunks().to_batches()
    out = pa.Table.from_batches(hmm._summed(2)(iter([two[0], *mixed, two[3]]))).to_pylist()
    assert [(r["symbol"], r["word"], r["c"]) for r in out] == [(3, None, None), (5, None, None), (None, b"a", 6), (None, b"b", 1)]
    assert np.frombuffer(out[1]["v"]).tolist() == [13, 24]


def test_words_are_cut_counted_and_coded_by_column():
    """Whole columns at once give what `words_of` and `class_of` give for one text; numbers go to Spark as bytes."""
    rng = random.Random(5)
    texts = [b"", None, b" \n", b"A b a\x0bB ", b"\xff\xfe \xc3\x89X\xc2\xa0y \x1cz\x85", b"q qq qqq qqqq qqqqq q qqq"]
    texts += [bytes(rng.choices(b"aB \t\n\x0b\x0c\r\x1c\x00\xe9z", k=rng.randrange(30))) for _ in range(300)]
    cut = [hmm.words_of(t or b"") for t in texts]
    seen = Counter(w for x in cut for w in x)
    column = pa.array([b"left out", *texts], pa.binary()).slice(1)
    n = hmm.counted(column)
    assert dict(zip(n["word"].to_pylist(), n["n"].to_pylist(), strict=True)) == seen | {b"": len(texts)}
    c = hmm.Config(head=2)
    for top in ([], [w for w, _ in seen.most_common(5)]):
        seqs, words, kinds = hmm.Vocabulary(top, c, min(2, len(top))).encode(column)
        tokens, at = hmm._lists(hmm._bytes(seqs).slice(3))
        assert tokens.tolist() == [x for t in seqs.to_pylist()[3:] for x in t] and len(at) == len(texts) - 2
        for x, seq, own, kind in zip(cut, seqs.to_pylist(), words.to_pylist(), kinds.to_pylist(), strict=True):
            assert [own[-1 - k] if k < 0 else [*top, b"end"][k] for k in seq] == [*x, b"end"]
            assert len(set(own)) == len(own) and not {*own} & {*top} and kind == [hmm.class_of(w, c.classes) for w in own]
    assert "seq binary" in hmm.CODED and "kinds binary" in hmm.CODED
    assert [len(x) for x in hmm.Vocabulary([], c, 0).encode([])] == [0, 0, 0]


def test_emissions_are_distributions():
    """The words of a class and one unseen word have probability 1 together in every state."""
    rng = np.random.default_rng(4)
    steps = rng.integers(1, 249, (20, 8)).astype(np.uint8)
    count = rng.integers(1, 50, 20).astype(float)
    own = count[:, None] * steps / steps.sum(axis=1, keepdims=True)
    by = hmm.Classes(np.ones((1, 8)), own.sum(axis=0, keepdims=True) / count.sum(), np.array([count.sum()]), np.array([20.0]))
    q = steps.view("<i8").ravel()
    zero = np.zeros(1, np.int64)
    whole = by.emissions(np.zeros(20, np.int64), count, q).sum(axis=0) + by.emissions(zero, zero.astype(float), zero)[0]
    assert np.allclose(whole, 1)


def test_language_model_edges(spark):
    assert hmm.score(empty_docs(spark), F.lit(True), F.lit(False)).count() == 0
    rows = hmm.score(edge_docs(spark), fold("doc_id", 7) != 2, fold("doc_id", 7) == 2, hmm.Config(rounds=1)).collect()
    assert len(rows) == len(EDGE) + 3 and all(np.isfinite([r.base_score, r.score]).all() for r in rows)
    none = hmm.score(edge_docs(spark), F.lit(False), F.lit(True)).collect()
    assert all(r.base_score == 0 == r.score and r.train_tokens == 0 and r.n_known == 0 for r in none)


# ---- op8 ----


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_predictions_equal_plain_scores(spark):
    """Counts of n-grams one by one, and the softmax of their mean score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(docs, fold("doc_id", 5) != 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs.select("doc_id", "text"), m).collect():
        text = b" " + b" ".join((texts[r.doc_id] or "").encode().lower().split()) + b" "
        z, n = np.zeros(len(m.langs)), 0
        for order in langid.ORDERS:
            for k in range(len(text) - order + 1):
                code = 0
                for x in text[k : k + order]:
                    code = (code * 0x01000193 + x) & 0xFFFFFFFF
                z, n = z + m.scores[((code * 0x9E3779B1) & 0xFFFFFFFF) >> (33 - len(m.scores).bit_length())], n + 1
        p = np.exp((z / (n + m.neutral) + m.bias) / m.temperature)
        p /= p.sum()
        if any(x.isalpha() for x in texts[r.doc_id] or ""):
            assert r.lang_pred == m.langs[int(p.argmax())] and r.score == pytest.approx(p.max(), rel=1e-4) and r.rejected == (r.score < m.floor)


def test_copies_and_many_languages_are_sampled_within_the_bound(spark):
    rows = [(k % 3 or None, f"the same words in a text {k % 2}", "en") for k in range(400)] + [(k, f"text {k} of a language", f"l{k % 40}") for k in range(800)]
    c = langid.Config(examples=80, steps=20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs, F.lit(True), c)
    assert len(m.langs) == 41 and "en" in m.langs
    out = langid.predict(docs.withColumns({"Lang_Pred": F.lit(1), "__raw": F.lit(2), "letter": F.lit(3)}), m)
    assert out.columns == ["doc_id", "text", "lang", "__raw", "letter", "lang_pred", "score", "rejected"] and out.count() == 1200


def test_language_edges(spark):
    docs = edge_docs(spark).withColumn("lang", F.lit("en"))
    model = langid.train(docs, F.lit(True))
    rows = langid.predict(docs, model).collect()
    assert len(rows) == len(EDGE) + 3
    for r in rows:
        wordless = r.text is None or not any(x.isalpha() for x in r.text)
        assert (r.lang_pred == "und") == wordless and 0 <= r.score <= 1 and r.rejected >= wordless
    none = langid.train(docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty_docs(spark), model).count() == 0


def test_grams_do_not_depend_on_slices(monkeypatch):
    text = ("The quick brown fox é " * 40).encode()
    whole, terms = langid.grams(text, 256), knn_quality.terms(text, knn_quality.Config())
    monkeypatch.setattr(langid, "SLICE_BYTES", 17)
    assert (langid.grams(text, 256) == whole).all()
    assert langid.grams(b"", 256).sum() == 1 and whole.sum() > 0 and terms.any()


# ---- op10 ----


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_knn_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.93


def test_votes_equal_plain_neighbours():
    rng = np.random.default_rng(5)
    c = knn_quality.Config(word_buckets=16, shape_buckets=32, dim=6, neighbours=5)
    x = rng.random((40, 49)).astype(np.float32)
    y = (rng.random(40) < 0.6).astype(float)
    m = knn_quality.fit(x, y, np.full(40, 2.0), c)
    for row in rng.random((10, 49)).astype(np.float32):
        v = (row * m.idf) @ m.basis
        near = m.vectors @ (v / np.linalg.norm(v))
        best = np.argsort(-near)[:5]
        w = np.maximum(near[best], 0) ** 4
        want = (w @ y[best] + 0.5 * m.base) / (w.sum() + 0.5)
        assert knn_quality.vote(row[None], m)[0] == pytest.approx(want, rel=1e-4)


def test_quality_edges(spark):
    docs = edge_docs(spark).select("doc_id", "text", "score")
    labels = spark.createDataFrame([(4, 1), (5, 0), (4, 1), (7, 1), (77, 0), (8, None)], "doc_id long, label int")
    rows = knn_quality.score(docs, knn_quality.train(docs, labels)).collect()
    assert len(rows) == len(EDGE) + 3 and all(0 <= r.score <= 1 for r in rows)
    hot = docs.unionByName(spark.createDataFrame([(4, f"hot {k % 2}", "s") for k in range(500)], "doc_id long, text string, score string"))
    assert len(knn_quality.train(hot, labels).vectors) == 3  # ids 4, 5 and 7; 4 is there hundreds of times, with several texts
    assert knn_quality.score(docs.withColumn("Predicted", F.lit(1)), None).columns == ["doc_id", "text", "score", "predicted"]
    assert knn_quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in knn_quality.score(docs, None).collect()} == {0.5}
    assert knn_quality.score(empty_docs(spark), None).count() == 0


# ---- pipeline ----


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = Stage(spark, "test-pipeline")
    one = stage.write(corpus_pipeline.language_id(spark, docs, SF), "one")
    assert one.columns == docs.columns
    first = {r.doc_id: r for r in one.collect()}
    assert len(first) > 0.98 * docs.count()

    two = stage.write(corpus_pipeline.near_duplicates(spark, one, SF), "two")
    plain = plain_join([(i, r.text) for i, r in first.items()])
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {g for *_, g in plain.values()}

    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(list(enumerate(items)), 0.05)
    three = stage.write(corpus_pipeline.decontamination(spark, two, SF), "three")
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect() if not matcher.find(decontaminate.normalise(r.text))}

    four = stage.write(corpus_pipeline.secret_scans(spark, three, SF), "four")
    before = {r.doc_id: r for r in three.collect()}
    for r in four.collect():
        old, found = before[r.doc_id], [x for x in secret_scan.scan(before[r.doc_id].text.encode()) if secret_scan.KINDS[x[1]] != "hex"]
        assert r == old if not found else "[SECRET]" in r.text and r.n_chars == len(r.text)
        assert all(secret_scan.KINDS[k] == "hex" for _, k, _ in secret_scan.scan(r.text.encode()))

    five = corpus_pipeline.sentencepiece_ids(spark, four, SF).collect()
    with open(MODEL, "rb") as file:
        lib = pieces.codec(file.read()).whole
    texts = {r.doc_id: r.text for r in four.collect()}
    assert {r.doc_id: r.ids for r in five} == {k: [*lib.encode(t), 2] for k, t in texts.items()} and all(r.round_trip for r in five)
    assert corpus_pipeline.run(spark, SF).count() == len(five)


def test_pipeline_stages_take_odd_rows(spark):
    extra = edge_docs(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), "score")
    for rows in (extra, extra.limit(0)):
        docs = rows
        for _, step in corpus_pipeline.STAGES:
            before, docs = docs, step(spark, docs, SF)
            assert docs.count() <= before.count()


def test_stage_tables_go_when_released(spark):
    at = common.mark()
    one, two = Stage(spark, "one"), Stage(spark, "two")
    for s in (one, two):
        s.write(spark.range(3).toDF("x"), "t")
    common.release(at, at + 1)
    assert not os.path.exists(one.path.removeprefix("file://")) and spark.read.parquet(f"{two.path}/t").count() == 3
    common.release(at)
    assert not os.path.exists(two.path.removeprefix("file://"))


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_archive_query_rebuilds_every_record(spark, tmp_path, monkeypatch):
    write = warc.write

    def shortened(rows, path):
        """An archive whose records state a content that is a byte too short."""
        write(rows, f"{path}/whole")
        spark.read.parquet(f"{path}/whole/payloads").write.parquet(f"{path}/payloads")
        records = spark.read.parquet(f"{path}/whole/records")
        n = F.regexp_extract(F.col("header").cast("string"), r"\r\nContent-Length: (\d+)\r\n", 1)
        less = F.concat(F.lit("\r\nContent-Length: "), (n.cast("long") - 1).cast("string"), F.lit("\r\n\r\n"))
        old = F.concat(F.lit("\r\nContent-Length: "), n, F.lit("\r\n\r\n"))
        header = F.replace(F.col("header").cast("string"), old, less).cast("binary")
        records.select("key", header.alias("header")).write.parquet(f"{path}/records")

    spark.createDataFrame([(1, "u", "abc"), (2, "u\u00e9", "x" * 1500), (3, "u", "x" * 1500)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op2_warc_archive(spark, str(tmp_path)).count() == 3
    assert sorted(r.payload_bytes for r in queries.op2_warc_archive(spark, str(tmp_path)).collect()) == [3, 1500, 1500]
    monkeypatch.setattr(warc, "write", shortened)
    with pytest.raises(Exception, match="as long as it states"):
        queries.op2_warc_archive(spark, str(tmp_path)).collect()
    monkeypatch.setattr(warc, "write", write)
    export = warc.export
    monkeypatch.setattr(warc, "export", lambda rows, path: export(rows.withColumn("record", F.encode(F.replace(F.decode("record", "UTF-8"), F.lit("abc"), F.lit("abd")), "UTF-8")), path))
    with pytest.raises(Exception, match="not what its header states"):
        queries.op2_warc_archive(spark, str(tmp_path)).collect()
