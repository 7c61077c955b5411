"""The operators that compare documents, vectors and replicas, against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("zstandard")

from vicinity.llm import components, jaccard_join, suffix_blocks, suffix_dedup, vector_search, warc_fixity  # noqa: E402

DOCS = "doc_id long, text string, block long, bytes string, class string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], DOCS).repartition(3)


def cut_by_hand(rows, window=50):
    first, out = {}, []
    rank = lambda d: 1 << 62 if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first[b[i:i + window]] = min(first.get(b[i:i + window], 1 << 62), rank(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < rank(d):
                gone[i:i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    r = random.Random(3)
    base, rows = "".join(r.choice("ab cdé") for _ in range(400)), []
    for i in range(60):
        text = "".join(r.choice("abcdefg ") for _ in range(r.randint(0, 300)))
        a = r.randint(0, 300)
        text = text[:50] + base[a:a + r.randint(20, 150)] + text[50:]
        text = "xyz " * r.randint(5, 60) if i % 7 == 0 else "a" * r.randint(40, 120) if i % 11 == 0 else text
        rows.append((i, text))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (70, None), (71, ""), (72, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("block_bytes", [100, 3000, 2_000_000])
def test_cut_digests(spark, block_bytes):
    got = suffix_dedup.cut_digests(frame(spark, passages()), block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut_by_hand(passages())


@pytest.mark.parametrize("hot_runs, block_bytes", [(0, 3000), (0, 2_000_000), (30, 3000)])
def test_cut_digests_where_keys_are_hot(spark, monkeypatch, hot_runs, block_bytes):
    monkeypatch.setattr(suffix_dedup, "BUCKET_WINDOWS", 100)
    r = random.Random(8)
    around = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    line = around(40)
    rows = passages() + [(100 + i, around(60) + (r.choice("xyz") * 8 + line + r.choice("xyz") * 8) + around(60)) for i in range(60)]
    got = suffix_dedup.cut_digests(frame(spark, rows), block_bytes=block_bytes, hot_runs=hot_runs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut_by_hand(rows)


def test_runs_around_a_hot_key_are_spread():
    import pandas as pd
    import zstandard
    r = random.Random(9)
    around = lambda n: bytes(r.choice(b"abcdefghijklmnop") for _ in range(n))
    line = around(30)
    texts = [around(60) + line + around(60) for _ in range(400)]
    row = {"block": 0, "bytes": 1, "ids": np.arange(400).tobytes(), "lengths": np.full(400, 150).tobytes(),
           "payload": zstandard.ZstdCompressor().compress(b"".join(texts))}

    def fullest(hot_runs):
        block = suffix_dedup.Block(row, 4, 50, 16)
        def answers(ask, schema, answer):
            asked = pd.DataFrame(list(ask(block)), columns=[c.split()[0] for c in schema.split(", ")])
            found = pd.concat([answer(part) for _, part in asked.groupby("bucket")]).to_dict("records")
            return found, asked
        row["first"], _ = answers(suffix_dedup.ask_keys, suffix_dedup.KEYS, suffix_dedup.answer_keys(hot_runs))
        row["second"], entries = answers(suffix_dedup.ask_entries, suffix_dedup.ENTRIES, suffix_dedup.answer_entries(4))
        _, details = answers(suffix_dedup.ask_details, suffix_dedup.DETAILS, suffix_dedup.answer_details(50))
        return max(len(s) // 8 for s in entries["shapes"]), max(sum(w) for w in details["windows"])

    together, apart = fullest(10 ** 9), fullest(100)
    assert together[0] >= 100 and together[1] >= 400
    assert apart[0] < together[0] / 4 and apart[1] < together[1] / 3


def test_cut_texts_keeps_columns_and_signs(spark):
    rows = passages()
    got = suffix_dedup.cut_texts(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    found = got.collect()
    suffix_dedup.release()
    assert len(found) == len(rows) and all(r["bytes"] == "x" and r["block"] == 1 for r in found)
    first = min((r for r in found if r["doc_id"] == 1), key=str)
    assert first["text"] == rows[1][1] or len(first["text"]) < len(rows[1][1])
    assert suffix_dedup.cut_texts(frame(spark, rows).limit(0)).count() == 0


def test_pieces_give_every_window_once():
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 400))).encode() for _ in range(20)] + [b"abc " * 80]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    starts = {}
    for piece in (64, 1 << 20):
        runs = suffix_blocks.PieceRuns(data, lengths, 50, piece)
        starts[piece] = sorted((i, int(k)) for f, s, k in zip(runs.first, runs.stop, runs.key) for i in range(f, s))
    ends = np.cumsum(lengths)
    assert starts[64] == starts[1 << 20]
    assert [i for i, _ in starts[64]] == [i for n, e in zip(lengths, ends) for i in range(e - n, e - 49)]


def test_sorted_classes_are_the_windows():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 4000, dtype=np.uint8)
    text[1300:2300] = text[:1000]   # 1300 is divisible by the cycle
    starts = np.r_[0:900, 1300:2200]
    got = suffix_blocks.sorted_classes(text, starts, 50)
    order = {}
    for g, s in zip(got.tolist(), starts.tolist()):
        order.setdefault(g, set()).add((bytes(text[s:s + 50]), s % suffix_blocks.CYCLE))
    assert all(len(v) == 1 for v in order.values())
    assert len(order) == len({(bytes(text[s:s + 50]), s % suffix_blocks.CYCLE) for s in starts.tolist()})


def near_copies():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(120)], []
    for i in range(45):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(40)]
    return rows + [(200, None), (201, ""), (202, " \n"), (203, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (204, "two words"), (205, "two  words")]


def links_by_hand(rows):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    near = [[j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    changed = True
    while changed:
        least = [min([group[i], *(group[j] for j in near[i])]) for i in range(len(rows))]
        changed, group = least != group, least
    return sets, near, group


@pytest.mark.parametrize("blocks", [(512, 256), (7, 5)])
def test_jaccard_groups(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard_join, "NODE_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard_join, "SET_BLOCK", blocks[1])
    rows = near_copies()
    sets, near, group = links_by_hand(rows)
    key = lambda d: (d is None, d or 0)
    want = []
    for i, (d, _) in enumerate(rows):
        members = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        same = [rows[j][0] for j in range(len(rows)) if sets[j] and sets[j] == sets[i]] or [d]
        others = {sets[j] for j in near[i]} - {sets[i]}
        want.append((d, min(members, key=key), min(same, key=key), len(same), len(near[i]), len(others)))
    got = [tuple(r) for r in jaccard_join.jaccard_groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_prefixes_shorten_until_the_target():
    assert jaccard_join.prefix_length(0.8, 24, 6, 0.99999) == 4
    assert jaccard_join.prefix_length(0.8, 24, 6, 0.9) == 6
    assert jaccard_join.prefix_length(0.8, 2, 6, 0.999) == 1


def test_filter_follows_the_arguments(spark):
    assert 0.55 - 1 / 96 < jaccard_join.may_be_near(0.8, 96) <= 0.55
    for similarity, labels in ((0.5, 96), (0.6, 96), (0.8, 24)):
        least = jaccard_join.may_be_near(similarity, labels)
        equal = np.random.default_rng(1).binomial(labels, similarity, 100_000) / labels
        assert (equal >= least).all()
    assert jaccard_join.may_be_near(0.2, 10) == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_groups(frame(spark, near_copies()), similarity=0.3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in x[i]], 1, "q") for i in range(900)]
    rows += [(2000, None, 1, ""), (2050, [0.0] * 8, 1, ""), (2100, [1.0] * 7 + [None], 1, ""), (2150, [float("nan")] * 8, 1, ""),
             (2200, [1.0, float("inf")] + [0.0] * 6, 1, ""), (2250, [1.0], 1, ""), (2300, [], 1, ""), (None, [1.0] * 8, 1, ""), (0, rows[0][1], 1, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query string").repartition(3)
    got = vector_search.search(table, sample_vectors=300, leaf_sample=20).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    found, hits = {}, 0
    for r in got:
        assert r["query_id"] != r["vec_id"] and abs(r["score"] - unit[r["query_id"]] @ unit[r["vec_id"]]) < 1e-12
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 900, 50))
    for q, rows_ in found.items():
        rows_.sort()
        assert [r[0] for r in rows_] == [1, 2, 3, 4, 5] and [(-r[2], r[1]) for r in rows_] == sorted((-r[2], r[1]) for r in rows_)
        score = np.round(unit @ unit[q], 10)
        score[q] = -9
        hits += len({r[1] for r in rows_} & set(np.lexsort((np.arange(900), -score))[:5].tolist()))
    assert hits >= 0.9 * 5 * len(found)
    assert [r[1] for r in sorted(found[100])] == [101, 102, 103, 104, 105] and [r[1] for r in sorted(found[150])] == [100, 101, 102, 103, 104]
    assert vector_search.search(table.limit(0)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r[0], r[1], r[2]) for r in vector_search.search(few).collect()] == [(0, 1, 1)]


def test_audit(spark):
    pages = [(i, f"http://x/{i}", None if i % 13 == 0 else "é body " * (i % 40), "z") for i in range(-3, 1500)] + [(None, "u", "b", "z"), (5, "again", "b", "z")]
    records = warc_fixity.warc_records(spark.createDataFrame(pages, "page_id long, url string, html string, number string").repartition(3))
    second = warc_fixity.aged_replica(records).union(spark.createDataFrame([(9999, 9, "new")], "number long, file long, record string"))
    def side(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["number"], []).append(r["record"])
        return {n: sorted(x) for n, x in out.items()}

    a, b = side(records), side(second)
    want = {n: "missing" if n not in b else "surplus" if n not in a else "damaged" for n in a.keys() | b.keys() if a.get(n) != b.get(n)}
    got = warc_fixity.audit(records, second).collect()
    assert {r["number"]: r["status"] for r in got} == want and len(got) == len(want)
    for r in got:
        if r["number"] in a:
            before = sum(len(t.encode()) for n in a for t in a[n] if n >> 10 == r["file"] and n < r["number"])
            assert r["offset"] == before and r["bytes"] == sum(len(t.encode()) for t in a[r["number"]])
    assert warc_fixity.audit(records, records).collect() == []
    assert warc_fixity.audit(records.limit(0), records.limit(0)).collect() == []


def test_moved_records_are_found(spark):
    """The same records in another order or file differ, though every digest is there."""
    rows = [(n, n >> 10, f"record {n}", 100 * n) for n in range(200)] + [(n, n >> 10, f"record {n}", n) for n in range(1024, 1100)]
    schema = "number long, file long, record string, offset long"
    first = spark.createDataFrame(rows, schema).repartition(3)

    def found(change):
        second = spark.createDataFrame([change(*r) for r in rows], schema).repartition(2)
        return {r["number"]: r["status"] for r in warc_fixity.audit(first, second).collect()}

    assert found(lambda n, f, t, o: (n, f, t, o)) == {}
    assert found(lambda n, f, t, o: (n, f, t, o + 7)) == {}                      # shifted as a whole, in the same order
    assert found(lambda n, f, t, o: (n, f, t, {40: 4100, 41: 4000}.get(n, o))) == {40: "moved", 41: "moved"}
    across = found(lambda n, f, t, o: (n, f, t, {63: 6400, 64: 6300}.get(n, o)))   # between two nodes
    assert across and set(across.values()) == {"moved"} and across.keys() <= {63, 64, 65}
    assert found(lambda n, f, t, o: (n, 1 if n == 70 else f, t, 5000 if n == 70 else o)) == {70: "moved"}
    assert found(lambda n, f, t, o: (n, f, t + "!" if n == 1030 else t, o)) == {1030: "damaged"}
    short = first.where("number <> 80")
    assert [(r["number"], r["status"]) for r in warc_fixity.audit(first, short).collect()] == [(80, "missing")]
    assert [(r["number"], r["status"]) for r in warc_fixity.audit(short, first).collect()] == [(80, "surplus")]
    none = first.withColumn("file", F.lit(None).cast("long"))
    assert warc_fixity.audit(none, none).collect() == []
    assert {r["file"] for r in warc_fixity.audit(none, none.where("number <> 3")).collect()} == {None}


def test_only_differing_branches_are_read(spark):
    rows = [(n, n >> 10, f"record {n}") for n in range(5000)]
    first = spark.createDataFrame(rows, "number long, file long, record string").repartition(3)
    second = first.withColumn("record", F.when(F.col("number") == 2500, "x").otherwise(F.col("record")))
    levels = warc_fixity.trees(first, second)
    assert all(lv.count() == 1 for lv in levels[-1])
    assert [(r["file"], r["node"]) for r in warc_fixity.suspect_nodes(levels).collect()] == [(2, 2500 >> 5)]
    assert warc_fixity.suspect_nodes(warc_fixity.trees(first, first)).count() == 0
