"""The operators on single texts and on equal texts, against brute force and the libraries themselves."""

import base64
import hashlib
import random
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from vicinity.llm import byte_bpe, exact_dedup, language, packing, quality, token_counts  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, sequence_id long, fingerprint string, group string"


def texts():
    r = random.Random(5)
    signs = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "!", "é", "漢", " of", "ing", "😀", "<|endoftext|>", " "]
    out = ["", None, " ", "same text", "same text", "x" * 5000, "word " * 9000, "A" * 300 + " " * 300 + "1" * 300]
    return out + ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(60)]


def docs(spark, rows=None):
    """Rows with clashing extra columns, a repeated row and a null id."""
    found = [(i, t) for i, t in enumerate(texts())] + [(3, "same text"), (None, "same text"), (None, None)] if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", 7, "x", "y") for i, t in found], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact_groups(spark):
    rows = [(r[0], r[1] or "") for r in docs(spark).select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_groups(docs(spark)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(known, default=None)
    for sha, ids in by_sha.items():
        kept = [r for r in got if r["text_sha256"] == sha and r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"]


def test_filters_merge_without_loss():
    import numpy as np
    rng = np.random.default_rng(1)
    rest = 60
    parts = [np.unique(rng.integers(0, 1 << rest, 500, dtype=np.uint64)) for _ in range(3)]
    for p in parts:
        q, runs, rem, counts = exact_dedup.filter_of(p, np.ones(len(p), np.int64), rest)
        assert (exact_dedup.entries(q, runs, rem, rest) == p).all()
        assert np.frombuffer(runs, np.uint32).sum() == len(p) and len(counts) == 8 * len(p)


def test_drop_copies_keeps_columns(spark):
    got = exact_dedup.drop_copies(docs(spark))
    assert got.columns == docs(spark).columns
    kept = got.collect()
    assert len(kept) == len({r[1] or "" for r in docs(spark).select("doc_id", "text").collect()})
    assert [r["doc_id"] for r in kept if r["text"] == "same text"] == [4]


def test_packing(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = docs(spark, [(i, t) for i, t in enumerate(texts())])
    got = packing.pack(whole, window=64, group_pieces=50).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts()):
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and rows[0]["padding"] == (0 if at & (at - 1) == 0 else 64 - at)


def test_equal_pieces_are_dealt_over_groups(spark):
    rows = [(None, "same text")] * 2000
    got = packing.pack(docs(spark, rows), window=64, group_pieces=50).collect()
    sizes = {}
    for r in got:
        sizes[r["sequence_id"] % 40] = sizes.get(r["sequence_id"] % 40, 0) + 1
    assert len(got) == 2000 and max(sizes.values()) < 150


def test_best_fit_takes_the_tightest_window():
    import numpy as np
    numbers, offsets, used = packing.best_fit_decreasing(np.array([6, 5, 4, 3, 2]), 10)
    assert numbers.tolist() == [0, 1, 0, 1, 1] and used.tolist() == [10, 10] and offsets.tolist() == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("leaf,long", [(16, 12), (40, 2048)])
def test_tree_codec_is_the_library(leaf, long):
    codec = byte_bpe.TreeCodec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf, 8, long)
    r = random.Random(2)
    signs = ["a", "b", "th", "e", " ", "  ", "\n", "'s", "'", "'re", "1", "23", "!", "é", "漢", "\x1c", " ", "ing", "s", "r"]
    for n in range(1500):
        text = "".join(r.choice(signs[:r.randint(1, len(signs))]) for _ in range(r.randint(0, 120)))
        text = r.choice("ab e'1!") * r.randint(0, 90) + text if n % 3 == 0 else text
        ids = codec.encode(text)
        assert ids == codec.library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_round_trip(spark):
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs(spark).select("doc_id", "text").collect():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(byte_bpe.round_trip(docs(spark), leaf_chars=64)) == sorted(want, key=str)
    encoded = byte_bpe.encode_texts(docs(spark))
    assert {(r[0], bytes(r[1])) for r in byte_bpe.decode_ids(encoded).collect()} == {(i, (t or "").encode()) for i, t in docs(spark).select("doc_id", "text").collect()}


def test_token_counts(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 50) for i, t in docs(spark).select("doc_id", "text").collect()]
    got = token_counts.count_tokens(docs(spark), limit=50, long_text=20, call_chars=100)
    assert plain(got) == sorted(want, key=str)


def written(r, bad):
    words = ["river", "stone", "walked", "slowly", "house", "green", "while", "people", "spoke", "night", "garden", "letter"]
    prose = " ".join(r.choice(words) for _ in range(r.randint(20, 90))).capitalize() + "."
    return r.choice([prose.upper().replace(" ", "!! "), "### | " * 40, "Buy " * 60]) if bad else prose


def test_quality(spark):
    r = random.Random(3)
    rows = [(i, written(r, i % 5 == 0), "en", f"host{i % 3}", 1, "", "") for i in range(300)] + [(900, None, None, None, 1, "", "")]
    whole = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.judge(whole, labels).collect()}
    assert len(got) == 301 and all(got[i]["keep"] == (i % 5 != 0) for i in range(300))
    assert set(whole.columns) < set(quality.judge(whole, labels).columns)
    assert got[0]["site_docs"] == 100 and 0.7 < got[0]["host_prior"] < 0.9
    few = quality.judge(whole, labels.limit(0))
    assert few.where("keep and posterior = 1").count() == 301
    assert quality.judge(empty(spark), labels).count() == 0
    thin = quality.judge(whole, labels, carry=False)
    assert thin.columns == ["doc_id", "evidence", "site_docs", "host_prior", "site_prior", "posterior", "keep"]


def test_sparse_sites_lean_on_what_is_above(spark):
    rows = [("big", "a", 4.0)] * 200 + [("bad", "a", -4.0)] * 100 + [("new", "a", -4.0)]
    scored = spark.createDataFrame(rows, "h string, p string, e double")
    prior = {r["h"]: r["site_prior"] for r in quality.site_priors(scored, "h", "p", "e", 0.0).collect()}
    assert prior["bad"] < prior["new"] < prior["big"]


def test_language(spark):
    r = random.Random(4)
    words = {"aa": ["kala", "mila", "soto", "nuri"], "bb": ["krst", "brzn", "vlck", "zmrz"], "cc": ["ouai", "eaux", "iere", "ment"]}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randint(3, 40))), x if i % 9 else None, "s", 1, "", "")
            for i, x in enumerate(r.choice(list(words)) for _ in range(400))]
    truth = {row[0]: next(x for x, w in words.items() if row[1].split()[0] in w) for row in rows}
    rows += [(1000, None, "aa", "s", 1, "", ""), (1001, "123 !", "aa", "s", 1, "", ""), (None, "krst brzn", "bb", "s", 1, "", "")]
    got = language.identify(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == 403
    for x in got:
        assert x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)
        assert x["lang_pred"] == ("und" if x["doc_id"] in (1000, 1001) else truth.get(x["doc_id"], "bb"))
        assert 0 <= x["score"] <= 1
    assert {x["lang_pred"] for x in language.identify(spark.createDataFrame(rows[:5], DOCS).withColumn("lang", language.F.lit(None))).collect()} == {"und"}


def test_rare_languages_are_learned_at_every_size(spark):
    r = random.Random(6)
    words = {"aa": ["kala", "mila", "soto"], "bb": ["krst", "brzn", "vlck"], "cc": ["ouai", "eaux", "iere"]}
    say = lambda x: " ".join(r.choice(words[x]) for _ in range(20))
    rare = [(i, say("bb"), "bb", "s", 1, "", "") for i in range(40)] + [(50, "123", "dd", "s", 1, "", "")]
    for hot in (10, 4000):
        rows = rare + [(100 + i, say("aa"), "aa", "s", 1, "", "") for i in range(hot)]
        rows += [(None, "ouai eaux iere", "cc", "s", 1, "", "")] * (hot // 10)
        table = spark.createDataFrame(rows, DOCS).repartition(3)
        drawn = language.sampled(table, 60).groupBy("lang").count().collect()
        assert {x["lang"]: x["count"] for x in drawn if x["lang"] != "aa"} == {"bb": 40, "cc": 1}
        assert next(x["count"] for x in drawn if x["lang"] == "aa") < 1000
        assert language.learn(table, 60).languages == ["aa", "bb", "cc"]
        assert {x["lang_pred"] for x in language.identify(table, sample_docs=60).where("doc_id < 40").collect()} == {"bb"}


def test_sample_is_stored_before_it_is_read_by_few_tasks(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    rows = [(i, "kala mila" if i % 2 else "krst brzn", "ab"[i % 2], "s", 1, "", "") for i in range(50)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    assert language.learn(table.mapInArrow(counted, table.schema)).languages == ["a", "b"]
    assert read.value == 2 * 50


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 9, 40):
        code = language.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert len({tuple(c) for c in code}) == n and min(apart) >= (1 if n == 2 else 2)


def test_empty_tables(spark):
    for run in (exact_dedup.exact_groups, exact_dedup.drop_copies, packing.pack, byte_bpe.round_trip, token_counts.count_tokens, language.identify):
        assert run(empty(spark)).collect() == []
