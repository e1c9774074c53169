"""Encoding against the tokenizer, files against a plain round trip."""

import random
import zlib

import numpy as np
import pytest

from ratecraft.llm import token_files as tf

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tok():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("values", [[0], [5], [1, 1, 1], [0, 0, 7, 900, 900, 100000], list(range(1, 400)),
                                    sorted(random.Random(1).sample(range(10 ** 6), 3000))])
def test_elias_fano_round_trip(values):
    ef = tf.EliasFano.of(np.array(values), values[-1])
    assert ef.all().tolist() == values
    assert [ef[i] for i in range(len(values))] == values
    assert len(ef.low) + len(ef.high) <= len(values) * (2 + max(1, values[-1] // len(values)).bit_length()) / 8 + 16


def test_pieces_give_the_ids_of_whole_texts(tok):
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab'sé  \n\t 　 .!1中​\x85ñ<|endoftext|>") for _ in range(rng.randint(0, 30)))
           for _ in range(2000)]
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tf._Encoder(f.read())
    odd += ["".join(rng.choice(["the ", "it's", "'ll", " x", "É.", "12", ", ", "\n", " \n", "\n ", "'", "!'s", " '", "ñ×", "²"])
                    for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text in odd:
        ids = encoder(text)
        assert np.frombuffer(ids, np.uint16).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_report_matches_plain_encoding(docs, tok, monkeypatch):
    rng = random.Random(5)
    rows = [(i * 3, "".join(rng.choice(["some words ", "é\n", "  x", "tab\t"]) for _ in range(rng.randint(0, 60))))
            for i in range(60)] + [(1, None), (2, ""), (4, "long " * 5000)]
    monkeypatch.setattr(tf, "SEGMENT_DOCS", 7)
    got = {r.doc_id: r for r in tf.token_report(docs(rows), public.path("byte_bpe_50k.json")).collect()}
    at = 0
    for i, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [tf.END_ID]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_ties_nulls_and_no_rows(docs):
    path = public.path("byte_bpe_50k.json")
    rows = [(None, "b"), (5, "same"), (5, "same"), (5, "other"), (1, "a")]
    got = sorted((r.start, r.doc_id) for r in tf.token_report(docs(rows), path).collect())
    assert [d for _, d in got] == [None, 1, 5, 5, 5] and got[0][0] == 0
    assert tf.token_report(docs(rows).where("doc_id = 77"), path).collect() == []


def test_added_tokens_keep_their_ids(docs):
    path = public.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "a<|endoftext|>b"), (2, "some words"), (3, "<|endoftext|><|endoftext|> and\n\nmore é中"), (4, "<|endoftext"),
            (5, "a<|endoftext|>b")]
    assert plain.encode(rows[0][1], add_special_tokens=False).ids == [64, 50256, 65]
    got = {r.doc_id: r for r in tf.token_report(docs(rows), path).collect()}
    at = 0
    for i, text in rows:
        ids = plain.encode(text, add_special_tokens=False).ids + [tf.END_ID]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_a_worker_makes_one_encoder(monkeypatch):
    """Tasks of one worker share the broadcast variable, and with it the encoder."""
    from types import SimpleNamespace

    import pyarrow as pa

    made = []

    class Counted(tf._Encoder):
        def __init__(self, tokenizer_json):
            made.append(1)
            super().__init__(tokenizer_json)

    monkeypatch.setattr(tf, "_Encoder", Counted)
    monkeypatch.setattr(tf, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shipped = SimpleNamespace(value=f.read())
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two", "two  three"]})
    out = [[b.to_pylist() for b in tf._encode(shipped)([rows])] for _ in range(3)]
    assert out[0] == out[1] == out[2] and len(made) == 1
