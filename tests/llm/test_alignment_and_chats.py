"""Token alignment and chat formatting, against brute force and comparison SQL."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import oracle  # noqa: E402
from vicinity.llm import chat_format, queries, token_alignment  # noqa: E402

DOCS = "doc_id long, text string, book long, pair string, row string, links long"
TURNS = "conv_id long, turn long, role string, text string, turns string, slices long, formatted string"


def documents():
    r = random.Random(8)
    signs = ["a", "the", " ", "  ", "\n", "'s", "'", "12", "!", "é", "漢", " of", "ing", "😀", "<s>", "</s>", "<|endoftext|>",
             "\x00", "<0x41>", " ", "　", " ", "á", "ation"]
    fixed = ["", None, " ", "same text", "same text", "x" * 3000, "▁", "a ▁ b", "some words " * 700, "ab▁", " lead", "tail ",
             "some ▁ " + "words " * 600]
    return fixed + ["".join(r.choice(signs) for _ in range(r.randint(0, 90))) for _ in range(120)]


def aligned_by_hand(rows):
    """The contract read plainly: whole texts by the libraries, every pair of tokens compared."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pair = token_alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = [], {}
    for doc_id, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        data = [b"".join(pair.a_bytes[i] for i in x), b"".join(pair.b_bytes[i] for i in y)]
        if not text or data != [(" " + text).encode()] * 2:
            x, y = [], []
        spans = []
        for ids, size in ((x, pair.a_bytes), (y, pair.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size[i])))
                at += len(size[i])
            spans.append(out)
        links, low = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while low < len(y) and spans[1][low][1] <= s:
                low += 1
            j = low
            while j < len(y) and spans[1][j][0] < e:
                links.append((x[i], y[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, s = [], 0
        for e in cuts:
            groups.append([",".join(str(i) for i, (p, q) in zip(ids, span) if s <= p and q <= e) for ids, span in zip((x, y), spans)])
            s = e
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        found.append((doc_id, x, y, groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted([(d, len(x), len(y), len(g), len(ls), sum(counts[k] == most[k[1]] for k in ls), sum(counts[k] for k in ls),
                    hashlib.sha256(";".join("|".join(p) for p in g).encode()).hexdigest() if x else "") for d, x, y, g, ls in found], key=str), counts, most


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], DOCS).repartition(3)


def numbered():
    return [*enumerate(documents()), (3, "same text"), (None, "same text"), (None, None)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark):
    want, counts, most = aligned_by_hand(numbered())
    got = token_alignment.alignment(frame(spark, numbered())).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in token_alignment.pair_counts(frame(spark, numbered())).collect()}
    assert pairs == {k: (n, n == most[k[1]]) for k, n in counts.items()}


def test_small_books(monkeypatch):
    """The function of a task by itself, with texts over many books."""
    import pyarrow as pa
    import pyspark
    monkeypatch.setattr(token_alignment, "BOOK_GROUPS", 60)
    monkeypatch.setattr(token_alignment, "PART_CHARS", 20)
    monkeypatch.setattr(token_alignment, "ROW_PARTS", 3)
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 2})()))
    r = random.Random(4)
    words = ["w" + "".join(r.choice("abcdef") for _ in range(4)) for _ in range(200)]
    rows = numbered() + [(500 + k, " ".join(r.choice(words) for _ in range(90))) for k in range(6)]
    batch = pa.RecordBatch.from_pylist([{"row": k, "doc_id": d, "text": t or ""} for k, (d, t) in enumerate(rows)],
                                       pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())]))
    notes = [n for out in token_alignment.take_notes(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))(
        iter([batch])) for n in out.to_pylist()]
    books = [n for n in notes if n["row"] is None]
    assert len(books) > 10 and len({n["book"] for n in books}) == len(books)
    want, counts, most = aligned_by_hand(rows)
    totals, parts = {}, {}
    for n in books:
        for code, t in zip(n["pairs"], n["totals"]):
            if t:
                key = divmod(code, token_alignment.PAIR)
                totals[key] = totals.get(key, 0) + t
    assert totals == counts
    for n in books:
        pairs = [divmod(code, token_alignment.PAIR) for code in n["pairs"]]
        n["answers"] = [{"count": counts.get(p, 0), "best": counts.get(p, 0) == most.get(p[1])} for p in pairs]
    schema = pa.schema([("book", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.binary()),
                        ("starts", pa.binary()), ("links", pa.binary()),
                        ("answers", pa.list_(pa.struct([("count", pa.int64()), ("best", pa.bool_())])))])
    ordered = sorted(notes, key=lambda n: (n["book"], n["row"] is not None, n["row"] or 0))
    fields = [{k: n.get(k) for k in schema.names} for n in ordered]
    for out in token_alignment.add_up(iter([pa.RecordBatch.from_pylist(fields, schema)])):
        for o in out.to_pylist():
            old = parts.setdefault(o["row"], [o["doc_id"], 0, 0, 0, 0, 0, 0, ""])
            for k, c in enumerate(COLUMNS[1:-1], 1):
                old[k] += o[c]
            old[-1] = max(old[-1], o["groups_sha256"])
    assert sorted((tuple(p) for p in parts.values()), key=str) == want


def test_groups_give_the_text_back(spark):
    rows = [(i, t) for i, t in enumerate(documents()) if t and "▁" not in t]
    got = {}
    for r in sorted(token_alignment.token_groups(frame(spark, rows)).collect(), key=lambda r: (r["doc_id"], r["number"])):
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["text"])
    assert got == {i: (" " + t).encode() for i, t in rows}


def test_no_documents(spark):
    assert token_alignment.alignment(frame(spark, [])).count() == 0


# -- chats

def chats():
    r = random.Random(6)
    marks = ["</s>", "[INST]", "[/INST]", "<s>", "[AND]", "<\\/s>", "[\\\\INST]", "\\", "\n", "text", "é", "漢😀", "<", "[", "$1", " "]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", None, "</s>"]),
             r.choice([None, ""]) if r.random() < 0.1 else "".join(r.choice(marks) for _ in range(r.randint(0, 12))))
            for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(70, t, "user" if t % 3 else "assistant", f"turn {t} [AND]") for t in range(chat_format.SLICE * 2 + 5)]
    rows += [(71, t, "assistant", f"{t}") for t in range(chat_format.SLICE + 1)]
    rows += [(72, None, "user", "b"), (72, None, "user", "a"), (72, 1, "user", "a"), (72, 1, "user", "a"), (None, 0, "assistant", "no id")]
    return rows


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(3)


def test_chats_come_back(spark):
    turns = {}
    for c, t, role, text in chats():
        turns.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    chats_of = chat_format.format_chats(chat_frame(spark, chats()))
    rows = chats_of.select("*", chat_format.read_turns(chats_of.formatted).alias("back")).collect()
    assert len(rows) == len(turns)
    for r in rows:
        want = [(role, text) for *_, role, text in sorted(turns[r["conv_id"]], key=lambda t: (t[0], t[1] or 0, t[2], t[3]))]
        assert [(b["role"], b["text"]) for b in r["back"]] == want
        blocks = sum(1 for k, (role, _) in enumerate(want) if not k or want[k - 1][0] != role)
        assert r["formatted"].count("[INST]") == r["formatted"].count("</s>") == blocks
        data = r["formatted"].encode()
        masked = [data[s["start"]:s["start"] + s["length"]].decode() for s in r["loss_spans"]]
        trained = [text for role, text in want if role == "assistant"]
        assert len(masked) == len(trained) and all(("\\" in m) or m == t for m, t in zip(masked, trained))
    digests = {r["conv_id"]: r for r in chat_format.read_back(chats_of).collect()}
    for c, found in turns.items():
        want = [(role, text) for *_, role, text in sorted(found, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))]
        loss = "".join(text for role, text in want if role == "assistant")
        assert digests[c]["n_turns"] == len(want) and digests[c]["loss_chars"] == len(loss)
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chats_by_sql(spark, tmp_path):
    chat_frame(spark, chats()).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert oracle.differences(queries.op13_chat_format(spark, str(tmp_path)), con, queries.OP13) is None


def test_chats_use_no_python(spark):
    plan = chat_format.read_back(chat_format.format_chats(chat_frame(spark, chats())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_marks_must_be_told_apart():
    with pytest.raises(ValueError):
        chat_format.Template(begin="<s>", end="<s>x")
    with pytest.raises(ValueError):
        chat_format.Template(more="\\m")


def test_no_chats(spark):
    assert chat_format.read_back(chat_format.format_chats(chat_frame(spark, []))).count() == 0
