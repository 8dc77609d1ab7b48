"""What the tokenizers library has to do: each word once, in short runs."""

import random

import numpy as np

from chronoweave.llm import tokenfile
from chronoweave.llm.common import tokenizer_path


class Listening:
    """A tokenizer that notes the texts it gets."""

    def __init__(self, own):
        self.own, self.heard = own, []

    def encode_batch_fast(self, texts, **more):
        self.heard += texts
        return self.own.encode_batch_fast(texts, **more)

    def __getattr__(self, name):
        return getattr(self.own, name)


def test_words_reach_the_library_once_and_in_short_runs(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    listening = Listening(own)
    monkeypatch.setitem(tokenfile._tokenizers, path, listening)
    monkeypatch.setattr(tokenfile, "_known", {})
    r = random.Random(4)
    words = ["".join(r.choice("abcdéöЖ") for _ in range(9)) for _ in range(3000)]
    texts = [" ".join([words[n], *[w + e for w in words for e in ("", ".", ",")], "end"]) for n in range(2)] + [None, "", "\n", "a\nb", "x ."]
    got = list(tokenfile.tokenize(texts, path))
    assert [x.tolist() for x in got] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    heard = " ".join(listening.heard).split()
    assert max(map(len, listening.heard)) < 20_000  # one text of all words
    assert sum(len(x) for x in heard) < 1.4 * sum(map(len, words))
    assert np.concatenate(got).max() < 50_257


def test_pieces_cut_together_encode_as_the_whole(monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, r = Tokenizer.from_file(path), random.Random(5)
    letters = ["a", "b", " ", " ", ".", ",", "\n", "\t", "'", "s", "1", "é", "×", "÷", "Ж", "\xa0", "\0", "<|endoftext|>", "中", "\x1c", "　", " ", "’", "\x85"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    for most in (600_000, 50):  # what is remembered is forgotten now and then
        monkeypatch.setattr(tokenfile, "REMEMBER", most)
        for t, ids in zip(texts, tokenfile.tokenize(texts, path), strict=True):
            assert ids.tolist() == own.encode(t, add_special_tokens=False).ids


def test_pieces_of_blocks_are_read_back_as_written():
    import pyarrow as pa

    ids = np.array([3, 9, 70_000, 200_000_000], "<u4")
    for own in (ids[:3], ids):  # entries of four and of eight bytes
        codec = tokenfile.Codec(own.tobytes(), tokenfile.code_lengths(own, np.arange(1, len(own) + 1)).tobytes())
        whole = np.random.default_rng(2).choice(own, 300).astype(np.uint32)
        payload, marks = codec.encode(whole)
        docs = [{"doc": None, "continued": True, "n": 120}, {"doc": 7, "continued": False, "n": 180}]
        row = {"part": 1, "block": 2, "n_tokens": 300, "payload": payload, "checkpoints": marks, "docs": docs}
        blocks = pa.RecordBatch.from_pylist([row | {"block": n} for n in range(3)], schema=tokenfile.SCHEMA).slice(1)
        got = [r for b in tokenfile.decoded(blocks, codec) for r in b.to_pylist()]
        assert got == [{"part": 1, "block": n, "place": i, "ids": whole[120 * i : 120 + 180 * i].astype("<u4").tobytes(), **d} for n in (1, 2) for i, d in enumerate(docs)]
