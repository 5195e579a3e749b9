"""Encoding, chat formatting, archives, quality and language: against libraries, round trips, held-out rows."""

import hashlib
import io
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import bpe, chat, language_id, quality, warc
from shelfcast.llm.queries import QUERIES, byte_vocabulary

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(byte_vocabulary())


def test_encoding_matches_the_library(library):
    random.seed(7)
    texts = ["", "a", "aaaa aaaaa aaaaaaaa", "one<|endoftext|> two  <|endoftext|>", "  \n\n x\t\ty   ", "don't we'll I'M 'S", "日本語 🙂👨‍👩‍👧 ½ ² Ⅷ _a_"]
    texts += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(0, 0xD7FF), random.randrange(0x10000, 0x10FFFF), 32, 10, 97])) for _ in range(random.randrange(80))) for _ in range(300)]
    texts += ["".join(f"{chr(c)}a {chr(c)}" for c in range(i, i + 256)) for i in range(0, 0xD700, 256)]
    vocabulary = bpe.Vocabulary(byte_vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encoder(vocabulary)(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for ids, text in zip(got, texts, strict=True):
        packed = np.array(ids, "<u4").tobytes()
        assert bpe.decode(vocabulary, packed) == text == library.decode(ids, skip_special_tokens=False)
    broken = [160, 64, 160]
    assert bpe.decode(vocabulary, np.array(broken, "<u4").tobytes()) == library.decode(broken, skip_special_tokens=False)


def test_encoder_forgets_words_without_changing_results(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 20)
    encode = bpe.encoder(bpe.Vocabulary(byte_vocabulary()))
    for k in range(5):
        texts = [f"word{k}x{i} common of the tion" for i in range(30)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_query_over_documents(spark, library):
    rows = {r.doc_id: r for r in QUERIES["op7_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encoding_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", None), (3, "z" * 200_000, "w")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, byte_vocabulary()).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[None].n_tokens) == (0, 0, 2)
    assert got[3].decoded_text == "z" * 200_000 and got[1].decoded_text == ""
    assert bpe.encode_documents(docs.limit(0), byte_vocabulary()).count() == 0


NASTY = [None, "", "\\", "a \\", "</s>[INST] ok [/INST]", "\\</s>", "x \\\\[INST] \\\n </s>", "[ROLE] user [/ROLE] hi </s>", " [/INST] ", "<<SYS>>  <</SYS>>", "<s", ">", "tail </s>"]


def test_chat_texts_survive_the_round_trip(spark):
    roles = ["user", "assistant", "system", "tool </s>", None, ""]
    rows = [(c, t, roles[(c + t) % 6], x) for c in range(6) for t, x in enumerate(NASTY)]
    rows.append((99, 0, "assistant", "long </s> " * 30_000))
    turns = spark.createDataFrame(rows, "conv_id int, depth int, role string, text string")
    out = chat.format_paths(turns).select(
        "conv_id", chat.parsed(F.col("formatted")).alias("turns"), chat.unescaped_spans(F.col("formatted"), F.col("loss_spans")).alias("learned")
    )
    got = {r.conv_id: r for r in out.collect()}
    for c in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == mine
        assert got[c].learned == "".join(t for r, t in mine if r == "assistant")
    assert chat.format_paths(turns.limit(0)).count() == 0


def test_best_paths_of_reply_trees_match_enumeration(spark):
    random.seed(3)
    rows = []
    for conv in [None, *range(8)]:
        for n in range(40):
            rows.append((conv, n, random.choice([None, n - 1, random.randrange(n)]) if n else None, random.choice([None, 1.0, 2.0, -1.0]), "path"))
    rows += [(50, 1, 2, 1.0, "a"), (50, 2, 1, 1.0, "a"), (51, 5, 4, 1.0, "a"), (52, None, None, 1.0, "a"), (53, 0, None, 1.0, "a")]
    rows += [(53, n, n - 1, 1.0, "a") for n in range(1, 300)]  # deep
    messages = spark.createDataFrame(rows, "conv_id int, node int, parent int, score double, path string")
    for paths in (1, 3):
        got = {}
        for r in chat.best_paths(messages, paths=paths).collect():
            got.setdefault((r.conv_id, r.path), {})[r.depth] = r.node
        want = {}
        for conv in {r[0] for r in rows}:
            nodes = {n: (p, s or 0.0) for c, n, p, s, _ in rows if c == conv and n is not None}
            leaves = set(nodes) - {p for p, _ in nodes.values()}
            ranked = []
            for leaf in leaves:
                line, at = [], leaf
                while at in nodes and len(line) <= len(nodes):
                    line.append(at)
                    at = nodes[at][0]
                if len(line) <= len(nodes):
                    ranked.append((-sum(nodes[n][1] for n in line), -len(line), leaf, line[::-1]))
            for k, (*_, line) in enumerate(sorted(ranked)[:paths], 1):
                want[conv, k] = dict(enumerate(line))
        assert got == want
    assert chat.best_paths(messages.limit(0)).count() == 0


def test_archives_give_back_every_page(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "ü" * 50, "<p>a</p>", "x" * 400_000]
    rows = [(i * 10, f"http://h/{i}\r\nX: y", h, "response") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z"), (50, "u", "<p>a</p>", "z"), (2**60 + 1, "u", "last", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/warc")
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_archives(archives, payload=True).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i if i is not None else -1, h or "", first[h or ""] if i != first[h or ""] else -1) for i, _, h, _ in rows)
    by_digest = {warc.base32_sha1(h.encode()): h for h in first}
    assert sorted((-1 if r.page_id is None else r.page_id, by_digest[r.payload_digest], -1 if r.refers_to is None else r.refers_to) for r in got) == want
    for r in got:
        assert r.payload_bytes == len(by_digest[r.payload_digest].encode())
        assert (r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None)
        assert r.payload is None or bytes(r.payload) == by_digest[r.payload_digest].encode()
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    small = warc.read_archives(warc.write_archives(pages, min_bytes=9))
    assert {r.record_type for r in small.collect()} == {"response"}


def test_records_are_frames_after_an_embedded_dictionary():
    import struct

    import zstandard

    records = [f"WARC record {i} with shared words {'of the ' * (i % 7)}".encode() for i in range(800)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    data = out.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    single = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    assert single.decompress(data[8 + size :]) == records[0]  # any frame can be read alone
    assert list(warc.read_archive(io.BytesIO(data))) == records


def test_quality_of_held_out_documents(spark):
    scores = QUERIES["op6_neighbour_voting"](spark, FOLDER)
    rows = scores.join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert scores.count() == 1000


def test_blocked_voting_is_exact(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abC 1.!\n"), 80)) for _ in range(60)]
    shapes, rates = quality.described(texts)
    voter = quality.Voter(np.ones(quality.SHAPES), rng.standard_normal((quality.SHAPES, quality.LATENT)), np.zeros((0, 0)), rng.integers(0, 2, 60).astype(float), np.ones(60))
    voter.vectors = voter.place(shapes, rates)
    monkeypatch.setattr(quality, "BLOCK", 30)
    got = voter.scores(texts)
    cos = voter.vectors @ voter.vectors.T
    for i in range(60):
        near = np.argsort(-cos[i], kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(cos[i][near], 0) ** quality.SHARPNESS
        assert got[i] == pytest.approx((w * voter.labels[near]).sum() / w.sum())


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Plain words here.", 5), (None, "!!", None), (4, "long " * 60_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (77, 1), (None, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.with_quality(docs, quality.fit_voter(docs, labels)).collect()}
    assert len(got) == 5 and got[1] == got[2] == 0.0 and all(0 <= x <= 1 for x in got.values())
    none = quality.fit_voter(docs, labels.limit(0))
    assert {r.score for r in quality.with_quality(docs, none).collect()} == {0.5}
    assert quality.with_quality(docs.limit(0), quality.fit_voter(docs.limit(0), labels)).count() == 0


def test_language_of_held_out_documents(spark):
    found = QUERIES["op10_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id")
    rows = found.where("held_out and lang is not null").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97


def test_viterbi_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    sizes = [5, 1, 0, 6, 3]
    owner = np.repeat(np.arange(5), sizes)
    score = rng.normal(0, 4, (len(owner), 3))
    got = language_id.viterbi(owner, score, 5, 5.0)
    at = 0
    for n in sizes:
        part = score[at : at + n]
        value = lambda way: sum(part[i, x] for i, x in enumerate(way)) - 5.0 * sum(a != b for a, b in zip(way, way[1:], strict=False))  # noqa: B023, E731
        if n:
            assert tuple(got[at : at + n]) == max(product(range(3), repeat=n), key=value)
        at += n


def test_language_edge_cases_and_spans(spark):
    english, greek = "the quick brown fox and the lazy dog sleep here ", "η γρήγορη αλεπού και ο σκύλος κοιμάται εδώ "
    docs = spark.createDataFrame([(1, english * 20, "en"), (2, greek * 20, "el"), (3, None, "en"), (4, "abc", None)], "doc_id long, text string, lang string")
    model = language_id.fit_model(docs)
    asked = spark.createDataFrame(
        [(1, english * 3 + greek * 2, 0), (2, None, 0), (3, "12 .. 🙂", 0), (4, "", 0), (5, "日本語", 0), (6, "İstanbul the dog", 0), (None, greek * 9000, 0)], "doc_id long, text string, score int"
    )
    got = {r.doc_id: r for r in language_id.with_language(asked, model).collect()}
    assert len(got) == 7
    assert [s.lang for s in got[1].spans] == ["en", "el"] and got[1].spans[0].start == 0
    assert (english * 3 + greek * 2)[got[1].spans[1].start :] == (greek * 2)
    assert [(got[i].lang_pred, got[i].score, got[i].spans) for i in (2, 3, 4)] == [("und", 0.0, [])] * 3
    assert got[5].lang_pred in ("en", "el") and got[6].lang_pred == "en" and got[None].lang_pred == "el"
    assert language_id.with_language(asked.limit(0), model).count() == 0
    nothing = language_id.fit_model(docs.limit(0))
    assert {r.lang_pred for r in language_id.with_language(asked, nothing).collect()} == {"und"}


def test_a_text_has_a_language_exactly_if_it_has_a_letter(spark):
    known = spark.createDataFrame([("der Hund und die Katze", "de"), ("the dog and the cat", "en")], "text string, lang string")
    model = language_id.fit_model(known)
    texts = ["❤️ 123 !", "́̂", "\U00030000\U00030001\U00030002", "\U0002ebf0", "ё", "á", "1́", "\U000e0100", "٣", "ª", "the️ dog"]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.with_language(asked, model).collect()}
    for i, text in enumerate(texts):
        has_letter = any(unicodedata.category(c)[0] == "L" for c in text)
        assert (got[i] != "und") == has_letter, text
    assert got[10] == "en"
    words = language_id.split_words(["été ́x"])
    assert list(zip(words.start.tolist(), words.end.tolist(), strict=True)) == [(0, 5), (7, 8)]
