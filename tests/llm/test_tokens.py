import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from orderloom.llm.tokens import WordEncoder, find_document, ids_digest, read_tokens, tokenizer_path, write_tokens
from tests.llm.helpers import DOCS, corpus, frame

ODD = ["<|endoftext|> a", "x<|startoftext|>y", "it's we've I'LL", "a b c", "é ́ é", "İstanbul ŉ ΣΑΣ", "日本語 テスト 12345", "a.b,,c... d!!", "\x1c\x1d x\x85y", "ﬁ ² ½", "한국어", "​", "😀😀 ok", ",", "..", "a\x0bb\x0cc\rd"]


def test_round_trip(spark, tmp_path):
    rows = corpus(8) + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    path = f"file://{tmp_path}/t"
    write_tokens(frame(spark, rows), path, tokenizer_path(), file_bytes=4000)
    plain, start = Tokenizer.from_file(tokenizer_path()), 0
    back = {r.doc_id: r for r in read_tokens(spark, path).collect()}
    sums = {r.doc_id: r for r in ids_digest(read_tokens(spark, path)).collect()}
    assert len(back) == len(rows)
    for doc_id, text, *_ in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        r = back[doc_id]
        assert (r.ids, r.n_tokens, r.start) == (ids, len(ids), start), text
        assert sums[doc_id].ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    assert [r.doc_id for r in find_document(spark, path, 7).collect()] == [7]
    files = spark.read.orc(f"{path}/manifest").orderBy("part").collect()
    assert all(a.last_id <= b.first_id for a, b in zip(files, files[1:], strict=False))


SIGNS = ["heat*** A$$$ x|> a|b c<d e<|endoftext|> don't. rock'n'roll ,,, ### (a) [b] a-b- x\u0338 =\u0338", "WORD... word... Word! wörter?! ſt. ÿŸ"]


def test_cache_that_forgets(monkeypatch):
    from orderloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PARTS", 5)
    enc, plain = WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert enc.cuts
    for text in [*ODD, *SIGNS, "some other words here", "", "and more of them again", *SIGNS]:
        ids, n = enc.encode(pa.array([text, "", "x"]).slice(0, 2))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [1, 1] and n.tolist() == [len(ids) - 1, 1]
    assert enc.encode(pa.array([], pa.string()))[0].tolist() == []


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, plain = WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.cuts
    texts = [*ODD, *SIGNS, ""]
    ids, n = enc.encode(pa.array(texts), 7)
    want = [plain.encode(t, add_special_tokens=False).ids + [7] for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_empty_table_and_repeated_ids(spark, tmp_path):
    write_tokens(spark.createDataFrame([], DOCS), f"file://{tmp_path}/e", tokenizer_path())
    assert read_tokens(spark, f"file://{tmp_path}/e").count() == 0
    write_tokens(spark.createDataFrame([(1, "a", None, None, 1), (1, "b c", None, None, 1), (None, "d", None, None, 1)], DOCS), f"file://{tmp_path}/r", tokenizer_path())
    rows = sorted(read_tokens(spark, f"file://{tmp_path}/r").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1] and rows[0].start == 0
