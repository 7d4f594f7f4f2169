import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.support import SMALL

from folio.llm import bpe, pretokens, tokenbin
from folio.llm.registry import QUERIES

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(1)
    letters = list("abrevlmstd''''   \n\t\r 123é漢字!?.… 　 \x1c\x1f\x85​😀́Ⅷ²")
    return ["", " ", "'s it's we'll 'tis ''s", "x" * 1000 + " " + "ab" * 700] + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]


def test_split_equals_the_pattern(random_texts):
    import regex

    pattern, i = regex.compile(P.PATTERN), 0
    for found, counts in pretokens.split_texts(random_texts):
        at = 0
        for n in counts:
            assert found[at : at + n] == pattern.findall(random_texts[i])
            at, i = at + n, i + 1
    assert i == len(random_texts)


def test_ids_equal_the_reference(reference, random_texts):
    ranks, cached = bpe._worker(P.path("byte_bpe_50k.tiktoken"))
    for text, raw in zip(random_texts, cached.ids(random_texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == reference.encode_ordinary(text) and ranks.decode(ids) == text.encode()


def test_cache_forgets_but_stays_right(random_texts):
    ranks = bpe._worker(P.path("byte_bpe_50k.tiktoken"))[0]
    tiny = pretokens.WordCache(lambda ws: [np.array(ranks.encode_piece(w.encode()), "<u4").tobytes() for w in ws], most=50)
    full = bpe._worker(P.path("byte_bpe_50k.tiktoken"))[1]
    assert list(tiny.ids(random_texts[:300])) == list(full.ids(random_texts[:300]))
    assert len(tiny.known) <= 50 + 70_000


def test_append_and_replace_equal_encoding_anew():
    ranks, rng = bpe._worker(P.path("byte_bpe_50k.tiktoken"))[0], random.Random(2)
    for _ in range(60):
        piece = "".join(rng.choices("abcdetionsth", k=rng.randint(0, 40))).encode()
        e = bpe.PieceEncoding(ranks, piece)
        more = "".join(rng.choices("tionsing", k=5)).encode()
        e.append(more)
        assert e.ids() == ranks.walk(ranks.last_tokens(piece + more))
        a = rng.randint(0, len(piece))
        e.replace(a, a + 2, b"re")
        assert e.ids() == bpe.PieceEncoding(ranks, e.piece).ids()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_files_contract(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    rows = sorted(map(tuple, QUERIES["op8_token_binary"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start = 0
    for (key, _), row, ids in zip(docs, rows, library_ids([x for _, x in docs]), strict=True):
        raw = np.array([*ids, 2], "<u4")
        assert row == (key, start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)


def test_special_strings_equal_the_library(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext", "plain", "", None, " <|endoftext|>\n\nit's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenbin.read_token_files(*tokenbin.write_token_files(df, "doc_id", "text")).collect()}
    for i, ids in enumerate(library_ids(texts)):
        assert got[i] == (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))


def test_edits_of_a_text_equal_encoding_anew(reference):
    ranks, rng = bpe._worker(P.path("byte_bpe_50k.tiktoken"))[0], random.Random(5)
    letters = list("abdeilnorst'      \n\t12é!?.") + ["'ll", "'s", "   ", " the"]
    for _ in range(40):
        text = "".join(rng.choices(letters, k=rng.randint(0, 80)))
        e = bpe.TextEncoding(ranks, text)
        for _ in range(12):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            new = "".join(rng.choices(letters, k=rng.randint(0, 5)))
            if rng.random() < 0.3:
                e.append(new)
                text += new
            else:
                e.replace(a, b, new)
                text = text[:a] + new + text[b:]
            assert e.text == text and e.ids() == reference.encode_ordinary(text)


def test_an_edit_redoes_only_what_is_near(monkeypatch):
    ranks = bpe._worker(P.path("byte_bpe_50k.tiktoken"))[0]
    monkeypatch.setattr(ranks, "longest", max(map(len, ranks.rank)))
    piece = "".join(random.Random(3).choices("abcdetionsth", k=5000)).encode()
    e, done = bpe.PieceEncoding(ranks, piece), []
    find = ranks.last_token
    monkeypatch.setattr(ranks, "last_token", lambda p, i, last: done.append(i) or find(p, i, last))
    e.replace(2000, 2003, b"re")
    monkeypatch.undo()
    assert len(done) < 400 and e.ids() == bpe.PieceEncoding(ranks, e.piece).ids()


def test_bpe_contract(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op10_byte_bpe"](spark, SMALL).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd, none, reference):
    rows = bpe.encode_texts(odd, "doc_id", "text", with_ids=True).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    assert len(rows) == odd.count() and all(r.ids == reference.encode_ordinary(texts[r.doc_id] or "") for r in rows if r.doc_id is not None)
    assert bpe.encode_texts(none, "doc_id", "text").count() == 0
    files = tokenbin.read_token_files(*tokenbin.write_token_files(odd, "doc_id", "text")).collect()
    assert len(files) == odd.count()
    ends = sorted((r.start, r.start + r.n_tokens) for r in files)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    in_order = [r.doc_id for r in sorted(files, key=lambda r: r.start)]
    assert in_order[:2] == [None, None] and in_order[2:] == sorted(in_order[2:])
    folder, manifest = tokenbin.write_token_files(none, "doc_id", "text")
    assert tokenbin.read_token_files(folder, manifest).count() == 0
