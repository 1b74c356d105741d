"""Operators 11, 12 and 13 against plain Python, SQL and the tokenizers library."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagesmelt.llm import divergence, phrases, queries, token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def by_sql(name, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = connection.execute(queries.ORACLES[name])
    return [column[0] for column in found.description], sorted(found.fetchall())


# --- phrases ------------------------------------------------------------------------------------

def plain_phrases(docs, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k:k + size])] += 1
    out = []
    for lang, found in counts.items():
        frequent = {phrase: a for phrase, a in found.items() if a >= least}
        kept = []
        for phrase, a in frequent.items():
            if len(phrase) < 2:
                continue
            longer = any(
                len(other) > len(phrase) and b >= a
                and any(other[k:k + len(phrase)] == phrase for k in range(len(other)))
                for other, b in frequent.items())
            if longer:
                continue
            score, cut = min((
                1000 * a * totals[lang] // (frequent[phrase[:k]] * frequent[phrase[k:]]), k)
                for k in range(1, len(phrase)))
            kept.append((-score, -a, " ".join(phrase).encode(), " ".join(phrase),
                         frequent[phrase[:cut]], frequent[phrase[cut:]]))
        out += [(lang, rank, phrase, -a, left, right, totals[lang], -score) for
                rank, (score, a, _, phrase, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def chatter(spark):
    draw = random.Random(5)
    vocabulary = ["a", "B", "c", "É", "new", "York", "city", "\x01", "\x1cx", "x y", "😀"]
    texts = ["".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"])
                     for _ in range(draw.randrange(60))) for _ in range(150)]
    texts += [None, "", " \t ", "...", "new york city " * 400, "same same same same same same"]
    docs = [(draw.choice(["en", "de", None]), text) for text in texts + texts[:20]]
    frame = spark.createDataFrame(docs, "lang string, text string")
    return docs, frame.selectExpr("*", "'mine' AS phrase", "1 AS id", "2 AS `w1`", "3 AS `a.b`")


def test_phrases_are_those_of_plain_counting(chatter):
    docs, frame = chatter
    for least, top in ((5, 40), (12, 2_000)):
        assert rows(phrases.mine_phrases(frame, least=least, top=top)) == plain_phrases(docs, least, top)


def test_small_holds_change_nothing(chatter, monkeypatch):
    docs, frame = chatter
    for name in ("HELD_COUNTS", "HELD_GROUPS", "BATCH_DOCS"):
        monkeypatch.setattr(phrases, name, 7)
    assert rows(phrases.mine_phrases(frame, least=5)) == plain_phrases(docs, 5, 2_000)


def test_a_full_map_changes_nothing(chatter, monkeypatch):
    docs, frame = chatter
    monkeypatch.setattr(phrases, "_map_of", lambda *_: np.full(phrases.MAP_BITS // 8, 255, np.uint8))
    assert rows(phrases.mine_phrases(frame, least=5)) == plain_phrases(docs, 5, 2_000)


def test_equal_word_numbers_start_again_with_another_seed(chatter, monkeypatch):
    docs, frame = chatter
    seeds = []

    def crowded(lang, word, seed):
        return len(word) + 1 if seed == 0 else real(lang, word, seed)

    real = phrases.word_id
    monkeypatch.setattr(phrases, "word_id", crowded)
    levels = phrases._frequent_words
    monkeypatch.setattr(phrases, "_frequent_words", lambda *a: seeds.append(levels(*a)) or seeds[-1])
    assert rows(phrases.mine_phrases(frame, least=12)) == plain_phrases(docs, 12, 2_000)
    assert seeds[0][2] == 1


def test_equal_batch_hashes_are_told_apart(monkeypatch):
    columns = [np.array([1, 2, 1, 3], np.int64), np.array([5, 5, 5, 5], np.int64)]
    monkeypatch.setattr(phrases, "_mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    found, counts = phrases._distinct(columns)
    assert dict(zip(zip(*map(list, found)), counts)) == {(1, 5): 2, (2, 5): 1, (3, 5): 1}
    summed, counts = phrases._merged([(columns, np.array([1, 2, 3, 4])), (columns, np.arange(4))])
    assert dict(zip(zip(*map(list, summed)), counts)) == {(1, 5): 6, (2, 5): 3, (3, 5): 7}


def test_rare_candidates_stay_in_their_tasks(spark):
    """No frequent candidate is lost, and next to no rare one is moved to be counted."""
    draw = np.random.default_rng(5)
    docs = [np.concatenate([[1, 2, 3, 4], draw.integers(10, 1 << 60, 60)]) for _ in range(200)]
    pairs = [(list(range(len(doc) - 1)), doc[:-1].tolist(), doc[1:].tolist()) for doc in docs]
    relation = spark.createDataFrame(pairs, "at array<int>, w1 array<long>, w2 array<long>").repartition(5)
    for least in (100, 150, 200):
        bits = phrases._may_reach(relation, 3, least)
        triples = [np.concatenate(one) for one in zip(*((doc[:-2], doc[1:-1], doc[2:]) for doc in docs))]
        shown = phrases._shown(bits, triples)
        frequent = (triples[0] < 3) & (triples[2] < 5)
        assert shown[frequent].all() and frequent.sum() == 400
        assert (shown & ~frequent).sum() <= 5
        batch = pa.RecordBatch.from_arrays(
            [pa.array(one) for one in zip(*pairs)], names=["at", "w1", "w2"])
        moved = list(phrases._group_counts([batch], 3, SimpleNamespace(value=bits)))
        counted = {group[:3]: group[3] for group in zip(*(moved[0][name].tolist() for name in (
            "w1", "w2", "w3", "n")))}
        assert counted[1, 2, 3] == counted[2, 3, 4] == 200 and len(counted) <= 7
    assert not phrases._may_reach(relation.limit(0), 3, 1).any()


def test_a_full_table_of_places_changes_nothing(chatter, monkeypatch):
    docs, frame = chatter
    monkeypatch.setattr(
        phrases, "_may_reach", lambda *_: np.full(phrases.FOLD_PLACES // 8, 255, np.uint8))
    assert rows(phrases.mine_phrases(frame, least=5)) == plain_phrases(docs, 5, 2_000)


def test_phrases_of_no_rows(spark, no_docs):
    assert phrases.mine_phrases(no_docs).collect() == []


def test_op11_whole_table(spark, sf_dir):
    found = queries.op11_setm_phrases(spark, sf_dir)
    names, expected = by_sql("op11_setm_phrases", sf_dir)
    assert rows(found.select(*names)) == expected


# --- audit --------------------------------------------------------------------------------------

def plain_audit(docs, least, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        group = (lang or "", source or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[group].update(terms)
        seen[group[0]].update(set(terms))
    out = []
    for lang in {group[0] for group in counts}:
        groups = {group[1]: found for group, found in counts.items() if group[0] == lang}
        kept = [term for term, n in seen[lang].items() if n >= least]
        whole = sum(groups.values(), Counter())

        def shares(found):
            total = sum(found[term] for term in kept) + 5 * len(kept)
            return {term: 1 + 10**9 * (found[term] + 5) // total for term in kept}

        own, every = {source: shares(found) for source, found in groups.items()}, shares(whole)
        for source, found in groups.items():
            pairs = [(other, sum(abs(own[source][t] - own[other][t]) for t in kept))
                     for other in groups if other != source]
            terms = [(t, own[source][t] - every[t]) for t in kept
                     if found[t] and own[source][t] > every[t]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(listed, key=lambda one: (-one[1], one[0].encode()))[:most]
                out += [(lang, source, part, item, value, rank)
                        for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced(spark):
    draw = random.Random(9)
    vocabulary = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "中文", "x1y", "don't", "😀", "z"]
    docs = [(draw.choice(["en", "fr", None, ""]), draw.choice(["s1", "s2", "s3", None, "ß", "z.z"]),
             " ".join(draw.choices(vocabulary, k=draw.randrange(12)))) for _ in range(200)]
    docs += [("en", "s9", None), ("en", "s8", "\x00 12 --"), ("xx", "s1", "rare words"),
             ("xx", None, ""), ("fr", "s1", "long text " * 9_000), *docs[:9]]
    frame = spark.createDataFrame(docs, "lang string, source string, text string")
    return docs, frame.selectExpr("*", "'mine' AS term", "1 AS n", "2 AS `a.b`", "3 AS value")


def test_audit_is_that_of_plain_counting(sourced):
    docs, frame = sourced
    found = divergence.audit_sources(frame, least_docs=4, top_terms=3)
    assert rows(found) == plain_audit(docs, 4, 3)


def test_blocks_of_pairs_do_not_change_the_audit(sourced, monkeypatch):
    docs, frame = sourced
    monkeypatch.setattr(divergence, "SOURCES_A_BLOCK", 2)
    monkeypatch.setattr(divergence, "TERMS_A_BLOCK", 3)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    assert rows(divergence.audit_sources(frame, least_docs=2)) == plain_audit(docs, 2, 50)


def test_audit_without_kept_terms_and_without_rows(sourced, no_docs):
    docs, frame = sourced
    found = divergence.audit_sources(frame, least_docs=10_000)
    assert rows(found) == plain_audit(docs, 10_000, 50)
    assert {row.value for row in found.collect()} == {0}
    assert divergence.audit_sources(no_docs).collect() == []


def test_op12_whole_table(spark, sf_dir):
    found = queries.op12_source_audit(spark, sf_dir)
    names, expected = by_sql("op12_source_audit", sf_dir)
    assert rows(found.select(*names)) == expected


# --- token files --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def plain_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_text_encoder_agrees_with_the_library(library):
    draw = random.Random(11)
    pools = [" \t\n\x0b\x0c\r\x1c\x1f\x85  ​　ab.", "ab c'sd 12!!\x00 ",
             "".join(map(chr, range(0x20, 0x600))) + "  ", "中文 かな 😀👍🏽 ̀"]
    texts = ["".join(draw.choices(draw.choice(pools), k=draw.randrange(60))) for _ in range(3_000)]
    texts += ["", " ", "\0a \0a a", "a <|endoftext|> b", "x " * 3_000, "it's I'll  ok \n\n y"]
    encoder = token_files.TextEncoder(BYTE_BPE)
    assert encoder.ranked is not None
    for text in texts:
        found = np.frombuffer(encoder.encode(text), encoder.dtype).tolist()
        assert found == plain_ids(library, text)[:-1], text


def test_slots_are_minimal_and_perfect():
    draw = np.random.default_rng(3)
    for count in (0, 1, 2, 5_000):
        one, two = draw.integers(-2**63, 2**63 - 1, (2, count))
        slots, levels = token_files.perfect_slots(one, two)
        assert sorted(slots.tolist()) == list(range(count))
        assert token_files.find_slots(one, two, levels).tolist() == slots.tolist()
        assert sum(map(len, levels)) <= 8 * count + 64
    with pytest.raises(ValueError, match="same hashes"):
        token_files.perfect_slots(np.array([1, 1]), np.array([2, 2]))


def expected_documents(library, docs):
    """By id, the documents' start, length and checksum; rows of one id in any order."""
    found, start = {}, 0
    for key, text in docs:
        ids = plain_ids(library, text)
        found.setdefault(key, []).append(
            (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return found


def test_op13_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = expected_documents(library, sorted(map(tuple, docs), key=lambda row: row[0]))
    found = queries.op13_token_files(spark, sf_dir).collect()
    assert len(found) == len(docs)
    for row in found:
        assert [(row.start, row.n_tokens, row.ids_crc32)] == expected[row.doc_id]


def test_odd_documents_and_keyed_access(spark, odd_docs, library):
    files = token_files.write_token_files(odd_docs, BYTE_BPE, shard_bytes=60_000)
    found = token_files.token_documents(odd_docs, BYTE_BPE, shard_bytes=60_000).collect()
    docs = [(row.doc_id, row.text) for row in odd_docs.select("doc_id", "text").collect()]
    assert len(found) == len(docs)
    assert Counter((row.doc_id, row.n_tokens, row.ids_crc32) for row in found) == Counter(
        (key, n_tokens, crc) for key, text in docs
        for _, n_tokens, crc in expected_documents(library, [(key, text)])[key])
    # Starts leave no gap, and ids ascend with them; the row without id comes first.
    ordered = sorted(found, key=lambda row: row.start)
    ends = np.cumsum([row.n_tokens for row in ordered]).tolist()
    assert [row.start for row in ordered] == [0, *ends[:-1]]
    keys = [-1 if row.doc_id is None else row.doc_id for row in ordered]
    assert keys == sorted(keys) and keys[0] == -1
    asked = spark.createDataFrame([("4",), ("13",), ("5",), ("none",), (None,)], "key string")
    got = {row.key: row.ids for row in files.fetch(asked).collect()}
    assert got == {str(k): plain_ids(library, docs[k][1]) for k in (4, 5, 13)}
    assert {row.key: row.n_rows for row in files.look_up(asked).collect()} == {
        "4": 1, "13": 1, "5": 2}


def test_one_id_over_many_shards(spark, library):
    docs = [("hot", f"text {k} " * 20) for k in range(60)] + [("a", "x"), ("z", None)]
    frame = spark.createDataFrame(docs, "id string, body string").repartition(8)
    found = token_files.token_documents(
        frame, BYTE_BPE, id_column="id", text_column="body", shard_bytes=1_000).collect()
    assert Counter(row.id for row in found) == Counter(key for key, _ in docs)
    ordered = sorted(found, key=lambda row: row.start)
    assert [row.id for row in ordered] == ["a"] + ["hot"] * 60 + ["z"]
    ends = np.cumsum([row.n_tokens for row in ordered]).tolist()
    assert [row.start for row in ordered] == [0, *ends[:-1]]


def test_token_files_of_no_rows(no_docs):
    assert token_files.token_documents(no_docs, BYTE_BPE).collect() == []
