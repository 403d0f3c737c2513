"""Search and near-duplicates against brute force, and their edge cases."""

import itertools
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sitelens.llm import op10_lines
from sitelens.llm.common import settled, stored
from sitelens.llm.components import connected_components
from sitelens.llm.op01_vptree import Tree, nearest
from sitelens.llm.op04_cdc import GEAR, PLAN, cuts, gear, remove_spans, repeated_documents, repeated_spans
from sitelens.llm.op08_simhash import Sets, _bucket_links, fingerprint, keep_one, position_sets, simhash_groups, wide_links_of, wide_sets
from sitelens.llm.op10_lines import _crowded, dedup_lines, line_report

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def clusters(n, pairs):
    s = Sets(n)
    if pairs:
        i, j = map(np.array, zip(*pairs, strict=True))
        s.link(i, j)
    return s.roots()


def test_components(spark):
    pairs = [(int(a), int(b)) for a, b in RNG.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    root = clusters(300, pairs)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: int(root[n]) for p in pairs if p[0] != p[1] for n in p}
    assert connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


# --- vantage-point trees


def left_to_right(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def test_search_is_exact_at_factor_one(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    base = e.where("vec_id = 0").first().embedding
    odd = [(600 + i, base) for i in range(60)] + [(700, None), (720, [0.0] * 64), (740, [float("nan")] * 64), (760, [1.0, 2.0]), (761, [1.0, 3.0]), (None, base), (780, []), (600, base)]
    v = e.union(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).withColumnRenamed("vec_id", "vec_id").selectExpr("vec_id", "embedding", "1 as shard", "'x' as block")
    got = {}
    for r in nearest(v, v.where("vec_id % 20 = 0"), shard_rows=100, block=16, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = {(r.vec_id, tuple(r.embedding)) for r in v.collect() if r.vec_id is not None and r.embedding and all(np.isfinite(r.embedding)) and any(r.embedding)}
    for q, a in rows:
        if q % 20 == 0:
            want = sorted((-left_to_right(a, b), i) for i, b in rows if i != q and len(a) == len(b))[:20]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert nearest(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_vptree", "op9_warc"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_queries_against_sql(spark, name, sf):
    import duckdb

    from sitelens.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, f"/root/testdata/{sf}").select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, result.fetchall()))


def test_recall_with_pruning():
    x = RNG.normal(size=(4000, 64)) + 2 * RNG.normal(size=(20, 64))[RNG.integers(0, 20, 4000)]
    q = x[:100]
    want = np.argsort(-(q @ x.T), 1)[:, :20]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        found, _ = Tree(x).search(q, 28, factor)
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want.tolist(), found.tolist(), strict=True)]) >= least


@pytest.mark.parametrize("norms", ["one outlier", "lognormal"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(20, 32))[rng.integers(0, 20, 3000)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    if norms == "lognormal":
        x *= rng.lognormal(0, 0.8, 3000)[:, None]
    else:
        x[1] *= 3
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        recall.append(len(got.get(q, set()) & set(np.argsort(-score)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("spread, most", [(None, 0.95), (0.25, 0.3)])
def test_share_that_is_scored(spark, spread, most):
    """Unit vectors, at random or around centres, in several shards: what pruning leaves, at a recall of 0.9 and more."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 48)) if spread is None else rng.normal(size=(60, 48))[rng.integers(0, 60, 9000)] + spread * rng.normal(size=(9000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = nearest(v, v.where("vec_id % 20 = 0"), shard_rows=4000, counters=True).collect()
    got, scored = {}, {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
        scored[r.query_id, r.shard] = r.scored
    score = x[::20] @ x.T
    score[np.arange(450), np.arange(0, 9000, 20)] = -np.inf
    want = np.argsort(-score, 1)[:, :20]
    assert np.mean([len(got[20 * i] & set(w)) / 20 for i, w in enumerate(want.tolist())]) >= 0.9
    assert len({s for _, s in scored}) == 3 and np.mean(list(scored.values())) < most * 3000


# --- fingerprints


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_five_positions_hold_a_set():
    assert all(any(set(s) <= set(c) for s in position_sets()) for c in itertools.combinations(range(8), 5))


@pytest.mark.parametrize("text", ["", "  \t", "One", "A b", "ÀB c d E", "x y z " * 400, "\x0bA\x0cb\x1fc d"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash_groups(spark, docs):
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, docs.first().text), (-4, docs.first().text), (None, docs.first().text)]
    all_ = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as fp", "2 as component_id")
    rows = simhash_groups(all_).collect()
    source = all_.collect()
    assert len(rows) == len(source)
    v = np.array([plain_fingerprint(r.text or "") for r in source], np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    root = clusters(len(v), list(zip(i.tolist(), j.tolist(), strict=True)))
    low = {}
    for r, s in zip(root.tolist(), source, strict=True):
        if s.doc_id is not None:
            low[r] = min(low.get(r, s.doc_id), s.doc_id)
    want = sorted(((s.doc_id, f"{f:016x}", low.get(r)) for s, f, r in zip(source, v.tolist(), root.tolist(), strict=True)), key=repr)
    assert sorted((tuple(r) for r in rows), key=repr) == want
    assert simhash_groups(all_.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, docs):
    """Ids that come with several texts are several documents; rows that repeat both are one."""
    a, b = (r.text for r in docs.where("length(text) > 500").orderBy("doc_id").limit(2).collect())
    rows = [(7, a), (7, b), (7, b), (3, a), (9, None), (9, ""), (8, None), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _doc", "2 as _key", "3 as k", "4 as fp")
    assert sorted(((r.doc_id, r.text) for r in keep_one(table).collect()), key=str) == sorted([(3, a), (7, b), (8, None), (None, a)], key=str)
    assert keep_one(table.limit(0)).count() == 0


def word_sets(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_similar_texts_keep_one(spark):
    """Copies with a part of their words changed: found by similarity, against pairs of shingle sets; unrelated texts stay."""
    rng = np.random.default_rng(12)
    words = np.array(["".join(map(chr, rng.integers(97, 113, rng.integers(2, 9)))) for _ in range(3000)])
    rows, pairs = [], []
    for i in range(250):
        own = rng.choice(words, rng.integers(80, 600))
        rows.append((2 * i, " ".join(own)))
        other = own.copy()
        at = rng.choice(len(own), max(1, int(len(own) * (0.004, 0.01, 0.02, 0.06, 0.2)[i % 5])), replace=False)
        other[at] = "changed"
        rows.append((2 * i + 1, " ".join(other)))
        a, b = word_sets(rows[-2][1]), word_sets(rows[-1][1])
        pairs.append((2 * i + 1, len(a & b) / len(a | b)))
    big = rng.choice(words, 300)  # a family larger than a block of a list
    rows += [(1000 + i, " ".join([*big[: 3 * i % 290], f"own{i}", *big[3 * i % 290 + 1 :]])) for i in range(600)]
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {2 * i for i in range(250)} <= kept
    close = [d for d, j in pairs if j >= 0.85]
    assert len(close) > 80 and np.mean([d in kept for d in close]) <= 0.05
    assert not [d for d, j in pairs if j < 0.7 and d not in kept]
    assert {d for d in kept if d >= 1000} == {1000}


def test_wide_lists_link_as_all_pairs():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, (12, 8)).astype(np.uint64)
    prints = np.concatenate([base[rng.integers(0, 12, 700)] ^ (np.uint64(1) << rng.integers(0, 64, (700, 8)).astype(np.uint64)) * (rng.random((700, 8)) < 0.9) for _ in range(2)]).astype(np.uint64)
    i, j = wide_links_of(prints, block=64)
    x = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(2)
    every = np.nonzero(x <= 78)
    assert (clusters(len(prints), list(zip(i.tolist(), j.tolist(), strict=True))) == clusters(len(prints), list(zip(every[0].tolist(), every[1].tolist(), strict=True)))).all()
    sets = wide_sets()
    assert len(sets) == 128 and max(len(set(a) & set(b)) for k, a in enumerate(sets.tolist()) for b in sets.tolist()[:k]) == 1


def test_dense_lists_link_as_others():
    base = 0x1234567890ABCDEF
    f = np.unique(np.array([base ^ int(z) for z in RNG.integers(0, 1 << 22, 1500)], np.uint64))
    a, b = _bucket_links(f, (0, 1, 2, 3), 10**9), _bucket_links(f, (0, 1, 2, 3), 1)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# --- chunks


def test_gear_and_cuts():
    d = RNG.integers(0, 256, 500).astype(np.uint8)
    h = gear(d)
    assert all(int(h[i]) == sum(int(GEAR[d[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(500))
    a = RNG.integers(97, 123, 3000).astype(np.uint8)
    b = np.concatenate([a[:700], RNG.integers(97, 123, 7).astype(np.uint8), a[700:]])
    ca, cb = cuts(a, *PLAN), cuts(b, *PLAN)
    assert ca[-1] == 3000 and max(np.diff([0, *ca])) <= PLAN[2]
    assert len({x + 7 for x in ca if x > 900} - set(cb)) == 0  # in step again after the insertion


def test_repeated_passages(spark, docs):
    rows = {r.doc_id: r for r in repeated_documents(repeated_spans(docs)).collect()}
    seen = {}
    for r in docs.collect():
        w = r.text.split()
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(r.doc_id)
    truth = set().union(*(v for v in seen.values() if len(v) > 1))
    assert truth <= set(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x" * 500), (3, "plain text only once"), (3, "plain text only once")], "doc_id long, text string").selectExpr("*", "0 as start", "1 as run")
    assert repeated_spans(odd).count() == 0 and repeated_spans(odd.limit(0)).count() == 0
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    two = spark.createDataFrame([(1, "begin of one " + passage + " end"), (2, "another way to begin " + passage + " and end")], "doc_id long, text string")
    spans = repeated_spans(two)
    out = {r.doc_id: r.text for r in remove_spans(two, spans).collect()}
    assert set(out) == {2} and len(out[2]) < 300 and out[2].startswith("another way")


def test_passages_of_two_texts_under_one_id(spark):
    """One of the texts repeats a passage, the other one stays whole; rows that repeat an id and a text repeat nothing."""
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    other = " ".join(f"other{i * 104729 % 1000}" for i in range(120))
    docs = spark.createDataFrame([(1, "begin " + passage), (2, "here " + passage + " end"), (2, other), (3, "alone " + other[:40]), (4, "x " * 10), (4, "x " * 10)], "doc_id long, text string").selectExpr("*", "1 as k", "2 as high")
    spans = repeated_spans(docs)
    found = {(r.doc_id, r.start, r.length, r.again) for r in spans.collect()}
    assert {(d, again) for d, _, _, again in found} == {(1, False), (2, True)}
    data = ("here " + passage + " end").encode()
    assert all(data[s : s + n].decode() in passage for d, s, n, _ in found if d == 2)
    out = [(r.doc_id, len(r.text)) for r in remove_spans(docs, spans).collect()]
    assert len(out) == 1 and out[0][0] == 2 and out[0][1] < 250


def test_very_long_texts_repeat(spark):
    """Two megabytes with a passage in the middle that another text begins with, and a text of one repeated sign."""
    rng = np.random.default_rng(21)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(3, 9)))) for _ in range(5000)]
    own = [words[k] for k in rng.integers(0, 5000, 300_000)]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(own[150_000:150_060]) + " and an end of its own"), (3, "z" * 500_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in repeated_documents(repeated_spans(docs)).collect()}
    assert set(rows) == {1, 2, 3} and rows[2].removed_bytes > 200 and rows[1].repeated_bytes < 1000 and rows[3].removed_bytes > 490_000
    kept = keep_one(docs)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3}


def test_chunks_against_brute_force(spark, docs):
    """Spans, first occurrences and removals as a plain count of chunks gives them, on documents of one text an id."""
    texts = {r.doc_id: r.text.encode() for r in docs.dropDuplicates(["doc_id"]).collect()}
    every, places = {}, {}
    for d in sorted(texts):
        at = 0
        for end in cuts(np.frombuffer(texts[d], np.uint8), *PLAN):
            every.setdefault(texts[d][at:end], []).append((d, at))
            places.setdefault(d, []).append((at, end))
            at = end
    want = set()
    for d, own in places.items():
        run = []
        for at, end in [*own, (None, None)]:
            hit = at is not None and len(every[texts[d][at:end]]) > 1
            if hit:
                run.append((at, end))
            elif run:
                if run[-1][1] - run[0][0] >= 80:
                    want |= {(d, p, every[texts[d][s:e]][0] != (d, s)) for s, e in run for p in range(s, e)}
                run = []
    got = {(r.doc_id, p, r.again) for r in repeated_spans(docs.dropDuplicates(["doc_id"])).collect() for p in range(r.start, r.start + r.length)}
    assert want and got == want


# --- lines


def line_sets(line):
    """Character shingles from every position."""
    return frozenset(line[i : i + 5] for i in range(max(1, len(line) - 4)))


def test_lines_against_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    first = docs.first().text.split("\n")[0].split()
    variants = []
    for i in range(60):  # one line with a few words changed
        w = list(first)
        for k in rng.integers(0, len(w), rng.integers(0, 3)):
            w[k] = f"changed{rng.integers(0, 9)}"
        variants.append((5000 + i, " ".join(w) + "\n\nsame line here"))
    all_ = docs.select("doc_id", "text").union(spark.createDataFrame(variants, "doc_id long, text string"))
    lines = {}
    for r in sorted(all_.collect(), key=lambda r: r.doc_id):
        for p, x in enumerate(r.text.split("\n")):
            if x.strip():
                lines.setdefault(x, []).append((r.doc_id, p))
    sets = [line_sets(x) for x in lines]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root, groups = clusters(len(sets), pairs), {}
    for r, places in zip(root.tolist(), lines.values(), strict=True):
        groups.setdefault(r, []).extend(places)
    want = {x for g in groups.values() for x in set(g) - {min(g)}}
    got = {(r.doc_id, int(p)) for r in line_report(all_).collect() for p in r.removed.split()}
    assert len(got - want) == 0 and len(want - got) <= 0.01 * len(want)


def test_lines_of_families_on_one_template(spark):
    """Families that differ in a slot of one long template: every band is crowded, and few lines resemble its commonest one."""
    word = lambda k: "".join(chr(97 + k * 7919 // 26**i % 26) for i in range(5))
    template, rows = [word(k) for k in range(40)], []
    for f in range(80):
        for v in range(3):  # eight words of the family's own, in which its variants differ by one
            own = [word(1000 + 10 * f + k) for k in range(8)]
            own[v] = word(5000 + 3 * f + v)
            rows.append((len(rows), " ".join(template[: f % 40] + own + template[f % 40 :])))
    sets = [line_sets(x) for _, x in rows]
    root = clusters(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]).tolist()
    assert len(set(root)) == 80
    got = {r.doc_id for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_removed}
    assert got == {i for i, r in enumerate(root) if i != r}


@pytest.mark.parametrize("shared, own", [(30, 14), (40, 12), (20, 20)])
def test_lines_of_thousands_on_one_template(spark, shared, own):
    """Many centres behind one prefix of common words, each with variants by one word; recall against all pairs."""
    rng = np.random.default_rng(shared)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000)]
    head, rows = " ".join(words[:shared]), []
    for _ in range(700):
        centre = [words[k] for k in rng.integers(0, 3000, own)]
        for _ in range(rng.integers(1, 5)):
            w = list(centre)
            w[rng.integers(0, own)] = words[rng.integers(0, 3000)]
            rows.append(head + " " + " ".join(w))
    rows = list(dict.fromkeys(rows))
    sets = [line_sets(x) for x in rows]
    column = {t: i for i, t in enumerate(set().union(*sets))}
    from_, to = zip(*((i, column[t]) for i, s in enumerate(sets) for t in s), strict=True)
    shown = np.zeros((len(sets), len(column)), np.float32)
    shown[list(from_), list(to)] = 1
    both, size = shown @ shown.T, shown.sum(1)
    i, j = np.nonzero(both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-6)
    root = clusters(len(sets), [p for p in zip(i.tolist(), j.tolist(), strict=True) if p[0] < p[1]]).tolist()
    want = {i for i, r in enumerate(root) if i != r}
    got = {r.doc_id for r in line_report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect() if r.n_removed}
    assert len(want) > 100 and not got - want and len(got) >= 0.98 * len(want)


def lines_of_six_words():
    """Families behind one template, in a language so small that every window and shingle is in many lines."""
    rng = np.random.default_rng(3)
    words, head = ["baro", "ceti", "dolu", "fima", "gesh", "hank"], " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(8))
    rows = []
    for _ in range(400):
        own = [words[k] for k in rng.integers(0, 6, 16)]
        rows += [head + " " + " ".join(own), head + " " + " ".join([*own[:-1], words[(words.index(own[-1]) + 1) % 6]])]
    return list(dict.fromkeys(rows))


def test_lines_of_large_bands_against_all_pairs(spark):
    """All similar pairs of one band are found."""
    rows = lines_of_six_words()
    sets = [line_sets(x) for x in rows]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    texts = spark.createDataFrame(list(enumerate(rows)), "id long, line string")
    bands = texts.select(F.lit(1).cast("long").alias("band"), "id", F.col("id").alias("root"))
    got = [tuple(sorted(r)) for r in _crowded(bands, texts, 0.8).collect()]
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("whole", [None, 32])
def test_lines_of_large_bands_that_are_not_similar_make_no_rows(spark, monkeypatch, whole):
    """Else the rows grow with the square of the band. Both ways (all lines of a band, those that share a rare shingle) find all pairs."""
    made, write = {}, op10_lines.stored
    monkeypatch.setattr(op10_lines, "stored", lambda df, name: (out := write(df, name), made.update({name: out[0].count()}))[0])
    if whole:
        monkeypatch.setattr(op10_lines, "WHOLE", whole)
        monkeypatch.setattr(op10_lines, "BLOCK", whole)
    rows = lines_of_six_words()
    sets = [line_sets(x) for x in rows]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}
    texts = spark.createDataFrame(list(enumerate(rows)), "id long, line string")
    bands = texts.select(F.explode(F.expr("array(1L, 2L)")).alias("band"), "id", F.col("id").alias("root"))
    got = [tuple(sorted(r)) for r in _crowded(bands, texts, 0.8).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) <= made["line-pairs"] <= 3 * len(want)


def test_large_bands_in_the_pipeline(spark):
    """All pairs leave 304 of these 800 lines; signatures miss some pairs, but not the limits of large bands, by which 388 stayed."""
    docs = spark.createDataFrame(list(enumerate(lines_of_six_words())), "doc_id long, text string")
    kept = corpus_pipeline.lines(spark, docs, "").count()
    assert 304 <= kept <= 370


def test_lines_of_two_texts_under_one_id(spark):
    a, b = "alpha line of the first text\nbeta line that is here once\nalpha line of the first text", "gamma line of the second\ndelta 4711 unlike others\nunique epsilon sentence five"
    docs = spark.createDataFrame([(3, a), (3, b), (4, "zeta words alone"), (4, a)], "doc_id long, text string")
    assert sorted(r.text for r in dedup_lines(docs).collect()) == sorted(["\n".join(a.split("\n")[:2]), b, "zeta words alone"])


def test_lines_without_spaces(spark):
    """Lines of one run, one character put in or taken out, against Jaccard of windows at every character."""
    rng = np.random.default_rng(11)
    run = lambda n, low, high: "".join(map(chr, rng.integers(low, high, n)))
    url = "http://site.example/" + run(150, 97, 123)
    latin, chinese, thai, brief = run(120, 97, 123), run(60, 0x4E00, 0x9FA5), run(80, 0x0E01, 0x0E2F), run(20, 0x4E00, 0x9FA5)
    pairs = [(latin, "x" + latin), (latin[:60] + "y" + latin[60:], latin), (url, url.replace("http", "https")), (chinese, "\u4e00" + chinese), (thai[:40] + thai[41:], thai), (brief, "\u4e00" + brief), (latin, run(60, 97, 123) + latin[60:]), (url, "http://site.example/" + run(150, 97, 123))]
    every = lambda x: {x[i : i + 5] for i in range(len(x) - 4)}
    for at, (a, b) in enumerate(pairs):
        similar = len(every(a) & every(b)) >= 0.8 * len(every(a) | every(b))
        assert similar == (at < 6)
        docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
        assert sum(r.n_removed for r in line_report(docs).collect()) == similar


def test_shuffles_go_once_their_table_is_written(spark):
    """Else the shuffle files of the many tables of op10 add up on disk until the driver happens to collect its garbage."""
    held = lambda: {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, numbers = held(), spark.range(100_000)
    made, _ = stored(numbers.groupBy((numbers.id % 5_000).alias("k")).count().orderBy("k"), "shuffled")
    settled(lambda: made.groupBy((made.k % 7).alias("m")).count(), "shuffled")
    for _ in range(50):  # executors remove them after the write returns
        if not (left := held() - before):
            break
        time.sleep(0.2)
    assert not left and made.count() == 5_000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lines_edges(spark):
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "x\ny", 3), (3, "a b c\n\na b c\nq", 4), (3, "a b c\n\na b c\nq", 4), (4, "q", 5), (5, "x" * 60_000, 6)], "doc_id long, text string, h1 int")
    rows = {(r.doc_id, r.n_lines, r.n_removed, r.removed) for r in line_report(odd).collect()}
    assert rows == {(1, 0, 0, ""), (2, 0, 0, ""), (None, 2, 0, ""), (3, 3, 1, "2"), (4, 1, 1, "0"), (5, 1, 0, "")}
    kept = dedup_lines(odd).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, 2, None, 3, 3, 5], key=str)
    assert {r.text for r in kept if r.doc_id == 3} == {"a b c\n\nq"}
    assert line_report(odd.limit(0)).count() == 0
