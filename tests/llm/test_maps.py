import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import edge

from vacanta.llm import bpe, chat, decontaminate, line_dedup, text, token_output
from vacanta.llm.shared import shared_path

WORD = P.path("word_bpe_49k.json")
BYTE = P.path("byte_bpe_multi_50k.tiktoken")


def test_words_and_hashes():
    texts = [r["text"] for r in []] + ["a bb  ccc", "", None, "\tx", "a bb  ccc"]
    w = text.words(pa.array(texts), text.NOT_SPACE, False)
    assert [[w.word(i) for i in range(a, b)] for a, b in zip(w.of[:-1], w.of[1:])] == [[b"a", b"bb", b"ccc"], [], [], [b"x"], [b"a", b"bb", b"ccc"]]
    assert (w.hash[:3] == w.hash[-3:]).all() and len(set(w.hash.tolist())) == 4
    h = text.whole(w, 1)
    assert h[0] == h[4] and h[1] == h[2] != h[3]
    value, at = text.shingles(w, 2)
    assert np.diff(at).tolist() == [2, 0, 0, 1, 2]


def test_pieces_keep_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 3]})
    parts = list(text.pieces(iter([b]), "text", 12))
    assert [x for p in parts for x in p.column("text").to_pylist()] == b.column("text").to_pylist()
    assert len(parts) >= 3


def test_token_output(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    docs = edge.documents(spark)
    path = shared_path(spark, "t")
    token_output.write(token_output.encode(docs, WORD, 2), path)
    got = sorted(map(tuple, token_output.digest(token_output.read(spark, path)).collect()))
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["text"] or "")):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    plan = token_output.read(spark, path).filter("doc_id = 5")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan


def test_token_lookup_reads_few_rows(spark):
    """A document is found through the statistics and Bloom filters of doc_id: most row groups are not read."""
    docs = spark.range(20_000).selectExpr("(id * 7919) % 20011 as doc_id", "concat('word ', id) as text").coalesce(1)
    path = shared_path(spark, "t")
    token_output.write(token_output.encode(docs, WORD, 2), path, stride=1000)

    def scanned(condition):
        found = token_output.read_rows(spark, path).filter(condition)
        execution = found._jdf.queryExecution()
        n, node = execution.toRdd().count(), execution.executedPlan()
        while node.children().size():
            node = node.children().apply(0)
        return n, node.metrics().apply("numOutputRows").value()

    some = docs.first()["doc_id"]
    n, read = scanned(f"doc_id = {some}")
    assert n == 1 and read <= 2000
    n, read = scanned("doc_id = -5")
    assert n == 0 and read == 0


def test_token_output_empty(spark):
    path = shared_path(spark, "t")
    token_output.write(token_output.encode(edge.empty(spark), WORD, 2), path)
    assert token_output.read(spark, path).count() == 0


def test_token_output_forgets_no_word(monkeypatch):
    monkeypatch.setattr(token_output, "KNOWN_WORDS", 3)
    monkeypatch.setattr(token_output, "KNOWN_UNITS", 2)
    token_output._known.clear()
    a = token_output.encode_texts(WORD, ["one two three", "four five one", "six"], 2)
    token_output._known.clear()
    monkeypatch.setattr(token_output, "KNOWN_WORDS", 10**6)
    assert a == token_output.encode_texts(WORD, ["one two three", "four five one", "six"], 2)


def test_bpe(spark):
    docs = edge.documents(spark)
    enc = bpe.encoder(BYTE, P.PATTERN)
    got = Counter(map(tuple, bpe.digest(bpe.decode(bpe.encode(docs, BYTE, P.PATTERN), BYTE, P.PATTERN)).collect()))
    want = Counter()
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(edge.empty(spark), BYTE, P.PATTERN).count() == 0
    clash = bpe.encode(docs, BYTE, P.PATTERN).withColumns({"decoded": F.lit("x"), "a b:c": F.lit(1)})
    assert {bytes(r["decoded"]) for r in bpe.decode(clash, BYTE, P.PATTERN).collect()} == {(r["text"] or "").encode() for r in docs.collect()}


@pytest.mark.parametrize("x", ["ab cd  ef\n\n gh 12's x", "word" * 50, "a b c d e", "it's we'll  \t x9 9x", "é ü\n ß "])
def test_safe_parts(x):
    enc = bpe.encoder(BYTE, P.PATTERN)
    for size in range(1, 12):
        parts = bpe.safe_parts(x, size)
        assert "".join(parts) == x
        assert sum((enc.encode_ordinary(p) for p in parts), []) == enc.encode_ordinary(x)


def brute_contamination(docs, items, window):
    out = Counter()
    for r in docs:
        w = edge.LETTERS.findall(edge.lower(r["text"] or ""))
        hit, found = set(), set()
        for item, x in items:
            v = edge.LETTERS.findall(edge.lower(x or ""))
            size = min(window, len(v))
            for i in range(len(v) - size + 1) if size else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[i : i + size]:
                        hit.update(range(j, j + size))
                        found.add(item)
        out[r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontaminate(spark):
    items = [(1, "Three FOUR five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (4, "short, one!"), (12, "x x x x x x x x x x x"), (13, "x x x x x x x x x x x"), (14, "no such words"), (15, "!!")]
    docs = edge.documents(spark, [(20, "a b short.one two three four five six seven eight nine ten eleven"), (21, "one")])
    small = docs.filter("doc_id <> 7")
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(small.collect(), items, 10)
    assert Counter(map(tuple, decontaminate.digest(decontaminate.decontaminate(small, frame)).collect())) == want
    nameless = small.union(spark.createDataFrame([(None, "alpha one two three four five six seven eight nine ten eleven x", "", "", 1, 1)] * 2, small.schema))
    want = brute_contamination(nameless.collect(), items, 10)
    for size in (10, 60, 2 << 20):
        assert Counter(map(tuple, decontaminate.digest(decontaminate.decontaminate(nameless, frame, block_bytes=size)).collect())) == want
    seven = decontaminate.digest(decontaminate.decontaminate(docs.filter("doc_id = 7"), frame)).first()
    assert (seven["n_words"], seven["n_hit"], seven["n_items"]) == (30001, 30000, 2)
    assert decontaminate.decontaminate(edge.empty(spark), frame).count() == 0
    none = decontaminate.digest(decontaminate.decontaminate(small, frame.limit(0)))
    assert none.filter("contaminated or n_items > 0").count() == 0


def test_decontaminate_ids_of_items(spark):
    docs = edge.documents(spark)
    for kind, ids in (("string", ["b", None, "b", None, "aa"]), ("long", [10, None, 9, None, 9])):
        items = list(zip(ids, ["one two three four five six seven eight nine ten", "short one", "eleven twelve", "two three four five six seven eight nine ten eleven", "thirteen"], strict=True))
        frame = spark.createDataFrame(items, f"item_id {kind}, text string")
        for size in (1, 2 << 20):
            found = decontaminate.decontaminate(docs, frame, block_bytes=size)
            assert dict(found.dtypes)["items"] == f"array<{'bigint' if kind == 'long' else kind}>"
            named = sorted({i for i in ids if i is not None}, key=str)
            assert found.filter("doc_id = 1").first()["items"] == [*named, None]
            got = decontaminate.digest(found).filter("doc_id = 1").first()
            assert (got["n_items"], got["items_sha256"]) == (len(named) + 1, hashlib.sha256(",".join(map(str, named)).encode()).hexdigest())


def test_token_output_by_another_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = token_output.encode(edge.documents(spark), P.path("byte_bpe_50k.json"), 7).collect()
    texts = {r["doc_id"]: r["text"] for r in edge.documents(spark).collect()}
    assert len(rows) == 11 and all(r["ids"] == [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 7] for r in rows)


def test_chat_fold(spark):
    events = [
        (1, 0, 0, "user", "delta", "he"),
        (1, 0, 1, None, "delta", "llo"),
        (1, 1, 2, "assistant", "delta", "bad"),
        (1, 1, 3, None, "regenerate", "go"),
        (1, 1, 4, None, "delta", "od"),
        (1, 2, 5, "user", "delta", "one"),
        (1, 3, 6, "assistant", None, "two"),
        (1, 1, 7, None, "regenerate", "best"),
        (1, 4, 8, "user", "delta", "x"),
        (1, 4, 9, None, "edit", "y"),
        (1, 4, 10, None, "delta", None),
        (2, 0, 0, None, "delta", None),
    ]
    log = spark.createDataFrame(events, "conv_id long, message int, seq int, role string, kind string, text string")
    ties = [(3, 0, 1, "user", "edit", "A"), (3, 0, 1, None, "edit", "B"), (3, 1, 4, "user", "delta", "D"), (3, 1, 4, None, "edit", "E"), (3, 2, None, "user", "delta", "old"), (3, 2, 6, None, "delta", " new"), (3, 3, 5, "user", "edit", "E"), (3, 3, 5, None, "edit", "E")]
    tied = spark.createDataFrame(ties, log.schema)
    assert sorted(map(tuple, chat.fold(tied).collect())) == [(3, 0, "user", "B"), (3, 1, "user", "E"), (3, 2, "user", "old new"), (3, 3, "user", "E")]
    got = sorted(map(tuple, chat.fold(log).collect()))
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "best"), (1, 4, "user", "y"), (2, 0, "", "")]


def test_chat_round_trip(spark):
    nasty = ["long <|im_end|> 😀 text\n" * 60, "<|im_end|>\n<|im_start|>assistant\nx", "\\", "<\\|", "\\<|", "", None, "a\\\\<|b", "<", "😀"]
    rows = [(i // 4, i, ("user", "assistant", None, "a\nb\\")[i % 4], x) for i, x in enumerate(nasty)] + [(9, 0, "assistant", "twin"), (9, 0, "assistant", "twin")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.rows_as_events(turns)
    assert {"delta", "edit", "regenerate"} == {r["kind"] for r in log.select("kind").distinct().collect()}
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold(chat.rows_as_events(turns)))).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", x or "") for c, _, r, x in sorted(rows, key=lambda r: r[:2]) if c == conv]
        loss = "".join(x for r, x in own if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.render(chat.fold(chat.rows_as_events(turns.limit(0))))).count() == 0


def test_line_dedup(spark):
    rows = [(i, "h", f"menu\nown line {i}\n menu \n\nfoot", "z") for i in range(6)] + [(6, "h", "own line 0", "z"), (7, "h", None, "z"), (8, "h", "", "z"), (9, None, "menu", "z"), (10, "few", "menu", "z"), (11, "", "menu", "z"), (0, "h", "menu\nown line 0\n menu \n\nfoot", "z")]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string, _host string").withColumns({c: F.lit(5) for c in ("_drop", "drop", "row", "n_lines", "total")})
    got = line_dedup.drop_boilerplate(pages, "host", ratio=0.5).collect()
    by = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got}
    assert len(got) == len(rows)
    assert by[1] == (4, 3, "own line 1\n")
    assert by[6] == (1, 0, "own line 0") and by[7] == (0, 0, None) and by[8] == (0, 0, "")
    assert by[9][2] == by[10][2] == by[11][2] == "menu"
    assert line_dedup.drop_boilerplate(pages.limit(0), "host").count() == 0
