"""Token files: ids as the tokenizer gives them, framing, index, order and read-back."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import _text as t
from claimlens.llm import record_files
from claimlens.llm.queries import tokenizer_path
from tests.llm import cases

ODD = ["J̌ jř ÅngstrÖm H̱ İ İstanbul ẞ ΣίσυφοΣ", "don't DON'T !'s 's'ts it'll''d x'S", "<|endoftext|> a<|startoftext|>b <|STARTOFTEXT|>",
       "\x01 a\x01b \x01", "1234 a1b2 ٣٤ ½", "a—!b !́x ×÷ é,É! (Àla) café.Paris", "  wide　space \x85 \x1c\x1d", "日本語, 文。!", "A" * 300 + " " + "É" * 90 + " \U0001F600!!", "é̂ É. Ã̃ Ã̰!"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_whole_texts(tokenizer):
    texts = ODD + [s or "" for _, s in cases.awkward_texts()]
    for group in ([x] for x in texts), [texts]:
        enc = record_files.WordEncoder(tokenizer_path())
        for own in group:
            data, off = t.bytes_of(pa.array(own, pa.string()))
            data, off = record_files.simplified(data, off)
            raw = data.tobytes()
            ids, begin = enc.encode([raw[a:b] for a, b in zip(off, off[1:])])
            for k, text in enumerate(own):
                assert ids[begin[k]:begin[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_memo_is_bounded_and_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(record_files, "MEMO_WORDS", 20)
    enc = record_files.WordEncoder(tokenizer_path())
    for _, text in cases.awkward_texts():
        ids, _ = enc.encode([(text or "").encode()])
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def expected(texts, tokenizer):
    out, before = [], 0
    for i, s in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(s or "", add_special_tokens=False).ids, 2]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def test_round_trip_in_order(spark, tokenizer):
    texts = [*cases.awkward_texts(), (None, "no id"), (8, "again"), (8, "again")] + [(1000 + i, x) for i, x in enumerate(ODD)]
    manifest = record_files.write(cases.documents(spark, texts), tokenizer_path())
    got = sorted((tuple(r) for r in record_files.read(manifest).collect()), key=lambda r: r[1])
    assert got == expected(texts, tokenizer)


def test_index_takes_any_record_and_checksums_guard(spark, tokenizer, tmp_path):
    texts = cases.awkward_texts()
    manifest = record_files.write(cases.documents(spark, texts), tokenizer_path(), root=str(tmp_path)).collect()
    by_id = dict(texts)
    for row in manifest:
        f = record_files.RecordFile(row["path"])
        assert len(f.index) == row["records"] and f.index["ids"].sum() == row["ids"]
        for k in reversed(range(len(f.index))):
            assert f.record(k).tolist() == [*tokenizer.encode(by_id[int(f.index["doc_id"][k])] or "", add_special_tokens=False).ids, 2]
    path = manifest[0]["path"]
    raw = bytearray(open(path, "rb").read())
    size = int.from_bytes(raw[:8], "little")
    assert record_files.masked(bytes(raw[:8])) == int.from_bytes(raw[8:12], "little")
    assert record_files.masked(bytes(raw[12:12 + size])) == int.from_bytes(raw[12 + size:16 + size], "little")
    raw[13] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="broken record"):
        record_files.RecordFile(path).record(0)


def test_empty_table(spark):
    assert record_files.read(record_files.write(cases.documents(spark, []), tokenizer_path())).count() == 0
