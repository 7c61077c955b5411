"""Every stage of the pipeline against a brute-force version of its own input."""

import random

import pytest

pytest.importorskip("zstandard")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from test_pair_operators import links_by_hand  # noqa: E402
from test_text_operators import written  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, written(r, i % 4 == 0) if i < 160 else " ".join(word() for _ in range(70)).capitalize() + ".") for i in range(220)]
    rows += [(300 + i, rows[161 + i][1]) for i in range(6)]
    for i in range(5):
        near = rows[170][1].split()
        near[10 + 12 * i] = word()
        rows.append((320 + i, " ".join(near)))
    rows += [(340 + i, f"{' '.join(word() for _ in range(30)).capitalize()} é{passage}é {word()}.") for i in range(4)]
    return [(i, t, "en", f"host{i % 3}", len(t)) for i, t in rows]


def cut(rows, window=50):
    first = {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - window + 1):
            first[b[i:i + window]] = min(d, first.get(b[i:i + window], d))
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                gone[i:i + window] = [True] * window
        kept, at = [], 0
        for sign in t:
            size = len(sign.encode())
            kept += [] if all(gone[at:at + size]) else [sign]
            at += size
        out[d] = "".join(kept)
    return out


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    from vicinity.llm.common import tokenizer_path
    rows = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns or number == 4
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        outs.append(docs.collect())
    good, exact, near, short, packed = outs
    assert {r["doc_id"] for r in good} == {i for i, *_ in rows if i >= 160 or i % 4}
    last = {}
    for r in good:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in exact} == set(last.values()) and len(exact) == len(last)
    pairs = sorted((r["doc_id"], r["text"]) for r in exact)
    _, _, group = links_by_hand(pairs)
    assert {r["doc_id"] for r in near} == {pairs[g][0] for g in group} and len(near) < len(exact)
    want = cut([(r["doc_id"], r["text"]) for r in near])
    assert {r["doc_id"]: r["text"] for r in short} == want and all(r["n_chars"] == len(r["text"]) for r in short)
    assert sum(map(len, want.values())) < sum(len(r["text"]) for r in near) - 3 * 300
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in packed} == {
        d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    whole = corpus_pipeline.run(spark, folder)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, packed))


EDGES = "doc_id long, text string, lang string, source string, keep string, evidence long, posterior string, site_docs int, first string"


def edge_rows():
    """Without n_chars, with clashing names, null and repeated ids, empty and very long texts, repeated rows."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(80)]
    near = lambda k: " ".join(base[:10 + 9 * k] + [word()] + base[11 + 9 * k:])
    clean = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [(5, " ".join(base)), (7, near(0)), (7, clean[0]), (None, near(1)), (None, near(2)), (None, clean[1]), (None, clean[1]),
             (9, None), (10, ""), (11, " \n "), (12, clean[2]), (12, clean[2]), (13, "long " * 60_000 + clean[3]), (5, " ".join(base)), (5, "  ".join(base))]
    return [(i, t, None, "h", "k", 4, "p", 6, "f") for i, t in texts], {"clean": clean, "base": " ".join(base)}


@pytest.fixture
def edges(spark, tmp_path):
    spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, texts = edge_rows()
    return spark.createDataFrame(rows, EDGES).repartition(3), str(tmp_path), rows, texts


def test_every_stage_on_edge_rows(spark, edges):
    docs, folder, rows, _ = edges
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        found = out.collect()
        assert number == 4 or out.columns == docs.columns
        if number < 4:
            assert all((r["keep"], r["evidence"], r["posterior"], r["site_docs"], r["first"]) == ("k", 4, "p", 6, "f") for r in found)
        assert stage(spark, docs.limit(0), folder).collect() == []
    assert len({(r["doc_id"], r["start"]) for r in found}) > 1


def test_quality_rejects_rows_one_by_one(spark, edges):
    docs, folder, rows, _ = edges
    judged = corpus_pipeline.quality.judge(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(corpus_pipeline.quality.VERDICTS) <= set(judged.columns) and len(judged.columns) == len(set(judged.columns))
    kept = corpus_pipeline.keep_good(spark, docs, folder).collect()
    assert len(kept) == judged.where("keep").count()


def test_near_copies_are_rows_not_ids(spark, edges):
    docs, folder, rows, texts = edges
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    # One row of the near copies stays, that with the least (id, hash): id 5 has two forms with the same words.
    of_group = [r for r in kept if (r["text"] or "").split()[:5] == texts["base"].split()[:5]]
    assert len(of_group) == 1 and of_group[0]["doc_id"] == 5
    ids = [(r["doc_id"], r["text"]) for r in kept if r not in of_group]
    want = [(7, texts["clean"][0]), (None, texts["clean"][1]), (9, None), (10, ""), (11, " \n "), (12, texts["clean"][2])]
    assert sorted(map(str, ids)) == sorted(map(str, want + [(13, rows[12][1])]))


def test_exact_copies_on_edge_rows(spark, edges):
    docs, folder, rows, _ = edges
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()]
    assert len(kept) == len({t or "" for _, t, *_ in rows}) and sum(not t for _, t in kept) == 1


def test_many_rows_without_ids(spark):
    """Rows without ids meet only the rows with their text."""
    r = random.Random(3)
    rows = [(None, " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(30)), "", "s", 1) for _ in range(400)]
    docs = spark.createDataFrame(rows + rows, DOCS).repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["text"] for r in kept) == sorted(t for _, t, *_ in rows)
