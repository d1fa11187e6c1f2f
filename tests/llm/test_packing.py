import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from slotline.llm import packing as pk
from tests.conftest import TESTDATA

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_sequences(pieces, limits):
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    pad = total = 0
    for own in by.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *[p["length"] for p in own[:-1]]]).tolist()
        n = sum(p["length"] for p in own)
        assert 0 < n <= limits.tokens and len(own) <= limits.segments and sum(p["loss_tokens"] for p in own) <= limits.loss
        total += n
        pad += 0 if n & (n - 1) == 0 else limits.tokens - n
    return pad, total


@pytest.mark.parametrize("limits", [pk.Limits(64, 4, 64), pk.Limits(64, 16, 20), pk.Limits(64, 3, 10), pk.Limits()])
def test_every_id_once_within_limits(limits):
    rng = random.Random(3)
    packer, whole = pk.Packer(limits, 1000), {}
    for k in range(800):
        n = rng.choice([1, 2, 5, 30, 64, 200, 5000 if limits.tokens > 64 else 70])
        whole[k] = np.arange(n, dtype="<u4").tobytes()
        packer.add(k, whole[k], rng.randrange(n + 1))
    packer.finish()
    names = [c.split()[0] for c in pk.PIECES.split(", ")]
    pieces = [dict(zip(names, row, strict=True)) for row in packer.out]
    by = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    assert set(by) == set(whole)
    for k, own in by.items():
        own.sort(key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == whole[k] and [p["start"] for p in own] == np.cumsum([0, *[p["length"] for p in own[:-1]]]).tolist()
    assert check_sequences(pieces, limits)[0] == 0


@pytest.mark.parametrize("most", [1, 3, 9])
def test_short_texts_need_no_padding(most):
    rng, packer = random.Random(5), pk.Packer(pk.Limits(), 0)
    for k in range(20_000):
        packer.add(k, b"\1\0\0\0" * rng.randint(1, most))
    packer.finish()
    names = [c.split()[0] for c in pk.PIECES.split(", ")]
    pieces = [dict(zip(names, row, strict=True)) for row in packer.out]
    pad, total = check_sequences(pieces, pk.Limits())
    assert pad == 0 and total >= 20_000 and len({p["doc_id"] for p in pieces}) == 20_000


def test_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    pieces = [r.asDict() for r in pk.pack(pk.tokenise(docs, PATH)).collect()]
    pad, total = check_sequences(pieces, pk.Limits())
    assert pad <= 0.001 * total
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    assert sum(p["length"] for p in pieces) * 4 == sum(map(len, ids.values()))
    assert all(ids[p["doc_id"]][p["start"] * 4 : (p["start"] + p["length"]) * 4] == p["ids"] for p in pieces)
    query = {(r.doc_id, r.start): r.ids_crc32 for r in pk.pack_documents(docs, PATH).collect()}
    assert query == {(p["doc_id"], p["start"]): zlib.crc32(p["ids"]) for p in pieces}


def examples_of(rows, encode):
    """(conv_id, position) to ids and loss flags, by a plain loop over turns in order."""
    from slotline.llm import chat_format as cf

    out, prompt, last = {}, [], None
    for conv, position, role, text in rows:
        if last is not None and last[0] != conv and prompt:
            out[last] = (prompt, [0] * len(prompt))
        if last is None or last[0] != conv:
            prompt = []
        last = (conv, position)
        if role == "assistant":
            own = [*encode(text), 2]
            out[last] = (prompt + own, [0] * len(prompt) + [1] * len(own))
            prompt = []
        else:
            prompt = prompt + encode(cf.render(role, text)[0])
    if prompt:
        out[last] = (prompt, [0] * len(prompt))
    return out


@pytest.mark.parametrize("odd", [False, True])
def test_instructions(spark, odd):
    """Every id and every loss-bearing token lies in exactly one piece, and all three limits bind."""
    from slotline.llm import chat_format as cf

    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", ""), (1, 2, "assistant", "again </s>"), (None, 0, "user", None), (None, None, None, "x"), (3, 0, "system", "s"), (3, 0, "system", "s"), (4, 0, "assistant", "word " * 9000)]
    df = spark.createDataFrame([(*r, 5, "y") for r in rows], "conv_id long, turn long, role string, text string, part int, ids string") if odd else spark.read.parquet(f"{TESTDATA}/sf0.01/conversations.parquet")
    turns = cf.format_turns(df)
    w = pk.words(PATH)
    want = examples_of([(r.conv_id, r.position, r.role, r.text) for r in turns.collect()], lambda t: np.frombuffer(w.encode(t), "<u4").tolist())
    pieces = [r.asDict() for r in pk.pack(pk.instructions(turns, PATH), pk.INSTRUCTIONS).collect()]
    assert check_sequences(pieces, pk.INSTRUCTIONS)[0] == 0
    by, sequences = defaultdict(list), defaultdict(lambda: np.zeros(3, int))
    for p in pieces:
        by[p["doc_id"], p["part"]].append(p)
        sequences[p["sequence_id"]] += (p["length"], 1, p["loss_tokens"])
    assert by.keys() == want.keys()
    for k, own in by.items():
        ids, loss = want[k]
        own.sort(key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == np.array(ids, "<u4").tobytes()
        assert [p["loss_tokens"] for p in own] == [sum(loss[p["start"] : p["start"] + p["length"]]) for p in own]
    if not odd:
        full = np.array(list(sequences.values())) == (pk.INSTRUCTIONS.tokens, pk.INSTRUCTIONS.segments, pk.INSTRUCTIONS.loss)
        assert full.any(axis=0).all(), np.array(list(sequences.values()))
    assert pk.pack_instructions(cf.format_turns(df.limit(0)), PATH).count() == 0


@pytest.mark.parametrize("text", ["", " ", "It's THE ÉCOLE's <|endoftext|> x", "a.,b ,.. don't 12.5 ß.", "İstanbul ΣΑΣ ﬁn\u0301 e\u0301.", "a\u00a0b\u2003c\x1cd\x85e", "\u0301x y\u0301", "Ⅷ ² ½ _a_ 日本語. ª.", "K\u212a \u00c5\u212b."])
def test_words_equal_the_whole_text(text):
    w = pk.words(PATH)
    assert w.of(text) == w.encode(text) and w.of(f"the {text} {text}, end.") == w.encode(f"the {text} {text}, end.")


def test_odd_rows(odd_docs, no_docs):
    rows = pk.pack(pk.tokenise(odd_docs, PATH)).collect()
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert sorted(r.doc_tokens for r in rows if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert pk.pack_documents(no_docs, PATH).count() == 0
