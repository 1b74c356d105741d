"""Operators 2, 4, 8, 9 and 10 against brute force and the libraries they agree with."""

import hashlib
import random
import re
import string
import sys
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagesmelt.llm import common, decontaminate, queries, secrets, shards
from pagesmelt.llm.merges import Merges
from pagesmelt.llm.token_counts import TokenCounter, count_tokens
from pagesmelt.llm.trie_bpe import TrieEncoder, encode_decode

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts_of(spark, sf_dir):
    return {row.doc_id: row.text or "" for row in spark.read.parquet(
        f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def fuzz():
    draw = random.Random(7)
    pools = [string.printable, "aàáâãäåÀÁÇéèÊñÑöü ßΣσςİı'", "<|endoftext|> <|startoftext|>",
             "".join(map(chr, range(0x80, 0x3000))), "日本語한국어😀👍🏽̀́   "]
    made = ["".join(draw.choices(draw.choice(pools), k=draw.randrange(80))) for _ in range(2_000)]
    return [*made, "ab" * 600, " " * 300, "<|endoftext|>a<|startoftext|>", "", "it's I'll\n\n  x"]


def test_encoder_agrees_with_the_library(fuzz):
    library, encoder = Tokenizer.from_file(WORD_BPE), TrieEncoder(Merges(WORD_BPE))
    expected = [e.ids for e in library.encode_batch(fuzz, add_special_tokens=False)]
    for text, ids, (n_tokens, found, decoded) in zip(fuzz, expected, encoder.rows(fuzz)):
        assert found == " ".join(map(str, ids)), text
        assert n_tokens == len(ids)
        assert decoded == library.decode(ids, skip_special_tokens=False)


def test_kept_words_take_four_bytes_a_token(fuzz):
    encoder = TrieEncoder(Merges(WORD_BPE))
    for (ids, decoded), row in zip(encoder.encoded(fuzz), encoder.rows(fuzz)):
        assert (len(ids), " ".join(map(str, ids.tolist())), decoded) == row
    for word, entry in encoder.kept.items():
        assert len(entry) == 4 * encoder.rows([word])[0][0] and sys.getsizeof(entry) < 40 + len(entry)


def test_memory_goes_back_after_each_arrow_batch(spark, monkeypatch):
    class Frame:
        def mapInArrow(self, run, schema):
            return run

    seen, done = [], []
    monkeypatch.setattr(common, "give_back", lambda: seen.append(len(done)))
    run = common.per_batch(Frame(), "n long", lambda batch: {"n": [2 * n for n in batch["n"]]}, rows=2)
    batches = [pa.RecordBatch.from_pydict({"n": pa.array(range(k), pa.int64())}) for k in (5, 0, 3)]
    for out in run(iter(batches)):
        done += out["n"].to_pylist()
    assert done == [0, 2, 4, 6, 8, 0, 2, 4] and seen == [5, 5, 8]
    monkeypatch.undo()
    held = pa.allocate_buffer(1 << 26)
    del held
    common.give_back()
    assert pa.total_allocated_bytes() < 1 << 26


def test_counter_agrees_with_the_library(fuzz):
    library, counter = Tokenizer.from_file(BYTE_BPE), TokenCounter(Merges(BYTE_BPE))
    assert len(counter.single) > 40_000
    expected = [len(e.ids) for e in library.encode_batch(fuzz, add_special_tokens=False)]
    assert [counter.count(text) for text in fuzz] == expected


def test_heap_and_scan_merge_alike():
    table, draw = Merges(BYTE_BPE), random.Random(3)
    for _ in range(300):
        symbols = [table.ids[c] for c in draw.choices("etaoinshr", k=draw.randrange(1, 60))]
        assert table._heap(symbols) == table._scan(symbols)


def test_op2_whole_table(spark, sf_dir):
    library = Tokenizer.from_file(WORD_BPE)
    texts = texts_of(spark, sf_dir)
    rows = queries.op2_trie_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha(" ".join(map(str, ids)))
        assert row.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_op9_whole_table(spark, sf_dir):
    library = Tokenizer.from_file(BYTE_BPE)
    texts = texts_of(spark, sf_dir)
    for row in queries.op9_token_counts(spark, sf_dir).collect():
        count = len(library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (
            len(texts[row.doc_id].encode()), count, count > 1024)


def test_odd_rows_keep_their_place(odd_docs, no_docs):
    for frame in (encode_decode(odd_docs, WORD_BPE), count_tokens(odd_docs, BYTE_BPE)):
        rows = {row.doc_id: row for row in frame.collect()}
        assert frame.count() == odd_docs.count()
        assert rows[0].n_tokens == rows[1].n_tokens == rows[None].n_tokens == 0
        assert rows[9].n_tokens > 100
    assert encode_decode(no_docs, WORD_BPE).collect() == []
    assert count_tokens(no_docs, BYTE_BPE).collect() == []
    decoded = {row.doc_id: row for row in encode_decode(odd_docs, WORD_BPE).collect()}
    assert decoded[5].ids and decoded[1].ids == [] and decoded[1].decoded == ""


def test_shards_law(spark, make_docs, odd_docs, no_docs):
    tree = shards.even_tree(2, 2, 2)
    docs = make_docs([f"text {k}" * (k % 9) for k in range(4_000)])
    rows = shards.assign_shards(docs, tree, shards.grown_tree(tree)).collect()
    counts = [sum(row.shard == s for row in rows) for s in range(8)]
    assert all(abs(count - 500) < 120 for count in counts)
    for shard in range(8):
        assert sorted(row.slot for row in rows if row.shard == shard) == list(range(counts[shard]))
    moved = [row for row in rows if row.grown_shard != row.shard]
    assert 250 < len(moved) < 650 and {row.grown_shard for row in moved} == {8}
    for row in rows[:200]:
        text = f"text {row.doc_id}" * (row.doc_id % 9)
        assert row.size == len(text) + 1 and row.text_crc32 == zlib.crc32(text.encode())
    odd = shards.assign_shards(odd_docs, tree).collect()
    assert len(odd) == odd_docs.count() and {row.grown_shard for row in odd} == {None}
    for shard in {row.shard for row in odd}:
        slots = sorted(row.slot for row in odd if row.shard == shard)
        assert slots == list(range(len(slots)))
    assert {row.size for row in odd if row.doc_id in (None, 0, 1)} == {1}
    assert shards.assign_shards(no_docs, tree).collect() == []


def test_weights_move_rows_only_where_they_change(make_docs):
    docs = make_docs(["x"] * 3_000)
    light = {"a": {"r": {0: 1.0, 1: 1.0}}, "b": {"r": {2: 1.0}}}
    heavy = {"a": {"r": {0: 1.0, 1: 1.0}}, "b": {"r": {2: 2.0}}}
    before = {r.doc_id: r.shard for r in shards.assign_shards(docs, light).collect()}
    after = {r.doc_id: r.shard for r in shards.assign_shards(docs, heavy).collect()}
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {2} and 300 < len(moved) < 700


def brute_leaks(text, items, window=10):
    words = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, item in items:
        path = decontaminate.words_of(item)
        size = min(window, len(path))
        runs = {tuple(path[k:k + size]) for k in range(len(path) - size + 1)} if size else set()
        for at in range(len(words) - size + 1 if size else 0):
            if tuple(words[at:at + size]) in runs:
                hit.update(range(at, at + size))
                names.add(name)
    return len(words), hit, names


def test_automaton_agrees_with_brute_force():
    draw = random.Random(11)
    for _ in range(150):
        alphabet = [chr(97 + k) for k in range(draw.randrange(1, 5))]
        items = [(str(k), " ".join(draw.choices(alphabet, k=draw.randrange(14))))
                 for k in range(draw.randrange(1, 8))]
        window = draw.randrange(1, 6)
        automaton = decontaminate.Automaton(items, window)
        text = " ".join(draw.choices([*alphabet, "?z"], k=draw.randrange(60)))
        count, hit, names = brute_leaks(text, items, window)
        spans, found = automaton.hits(decontaminate.words_of(text))
        assert {place for span in spans for place in range(*span)} == hit
        assert sum(end - start for start, end in spans) == len(hit)
        assert found == names


def test_leaks_in_blocks_and_removed(spark, make_docs, odd_docs, no_docs):
    leak = " ".join(f"Leak{k}" for k in range(24))
    bench = spark.createDataFrame(
        [(1, leak), (2, "tiny item"), (3, None), (4, ""), (5, leak), (None, "no id at all"), (1, leak)],
        "item_id long, text string")
    clean = " ".join(f"fine{k}" for k in range(50))
    docs = make_docs([f"{clean} {leak.upper()}! {clean}", clean, f"a tiny, ITEM b. {clean}", leak,
                      f"no id at all {clean}", None, "", f"{clean} {leak[:40]}"])
    for size in (10_000, 20):
        rows = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench, block_bytes=size).collect()}
        assert [rows[k].n_hit for k in range(8)] == [24, 0, 2, 24, 4, 0, 0, 0]
        assert rows[0]["items"] == ["1", "5"] and rows[2]["items"] == ["2"] and rows[4]["items"] == []
        kept = {r.doc_id: r for r in decontaminate.remove_leaks(docs, bench, block_bytes=size).collect()}
        assert set(kept) == {0, 1, 2, 4, 5, 6, 7}
        assert kept[0].text == f"{clean} ! {clean}" and kept[0].n_chars == len(kept[0].text)
        assert kept[1].text == clean and kept[5].text is None and kept[6].text == ""
    assert decontaminate.remove_leaks(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.remove_leaks(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.find_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert decontaminate.find_leaks(no_docs, bench).collect() == []


def test_size_of_blocks_never_changes_what_is_removed(spark, make_docs):
    passage = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(passage[k:k + 6 + k % 7])) for k in range(0, 48, 2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    draw, clean = random.Random(6), [f"fine{k}" for k in range(30)]
    texts = [" ".join(clean[:7] + passage[at:at + draw.randrange(5, 40)] + clean[7:])
             for at in range(40)]
    texts += [" ".join(passage[:5] + passage[4:19] + passage[5:30] + clean[:k]) for k in range(16)]
    found = []
    for size in (10_000, 400, 250):
        kept = decontaminate.remove_leaks(make_docs(texts), bench, 6, block_bytes=size)
        found.append(sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect()))
        assert not any(brute_leaks(text, items, 6)[1] for _, text, _ in found[-1])
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < len(texts)


KIND_PATTERNS = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def brute_spans(text):
    spans = []
    for place, (kind, pattern) in enumerate(KIND_PATTERNS):
        for hit in re.finditer(pattern, text):
            length = len(hit.group(2)) if kind == "assign" else len(hit.group())
            if length >= (8, 16, 32)[place]:
                spans.append((hit.start(), place, hit.end()))
    return ",".join(f"{KIND_PATTERNS[k][0]}:{start}:{end}" for start, k, end in sorted(spans))


def test_op10_whole_table(spark, sf_dir):
    texts = texts_of(spark, sf_dir)
    rows = queries.op10_secret_scan(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = brute_spans(texts[row.doc_id])
        assert row.base_sha256 == sha(expected)
        assert row.n_assign == expected.count("assign:")
        assert row.n_access == expected.count("access:") and row.n_hex == expected.count("hex:")


def test_secrets_fuzz():
    draw, automaton = random.Random(5), secrets.keyword_automaton()
    parts = ["password", "PassWd", "secret", "toKEN", "api_key", "APIKEY", "ſecret", "toKen", "=", ":",
             " ", "   ", '"', "'", "abcDEF12", "x", "AKIA", "AKIAABCDEFGHIJKL", "akia", "0123456789abcdef",
             "deadbeef" * 4, "İ", "é", "😀", ".", "\n"]
    for _ in range(4_000):
        text = "".join(draw.choices(parts, k=draw.randrange(14)))
        spans = secrets.find_spans(text, automaton)
        base = [span for span in spans if span[1] in secrets.BASE_KINDS]
        assert ",".join(f"{k}:{s}:{e}" for s, k, e in base) == brute_spans(text), text


def test_texts_are_masked_in_portions():
    texts = [None, "", "password = hunter2hunter2 ok", "plain"] * 200
    found = list(secrets.mask_batches(iter([pa.array(texts, pa.string()), pa.array([], pa.string())])))
    assert [len(part) for part in found] == [256, 256, 256, 32]
    assert pa.concat_arrays(found).to_pylist() == [None, "", "[REDACTED] ok", "plain"] * 200


def test_checksums_and_redaction(make_docs, odd_docs, no_docs):
    body = "a1B2" * 7 + "zz"
    number, check = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        check = secrets.BASE62[digit] + check
    good, bad = f"ghp_{body}{check}", f"ghp_{body}{check[::-1]}x"
    docs = make_docs([f"é {good} end", f"é {bad} end", "password = hunter2hunter2 ok", None, "", "plain"])
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert [(s.start, s.kind, s.end) for s in rows[0].spans] == [(2, "token", 2 + len(good))]
    assert rows[1].spans == [] and rows[3].spans == [] and rows[4].spans == []
    cut = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert cut[0].text == "é [REDACTED] end" and cut[0].n_chars == len(cut[0].text)
    assert cut[2].text == "[REDACTED] ok" and cut[3].text is None and cut[5].text == "plain"
    assert secrets.redact(odd_docs).columns == odd_docs.columns
    assert secrets.redact(odd_docs).count() == odd_docs.count()
    assert secrets.scan_secrets(no_docs).collect() == []
