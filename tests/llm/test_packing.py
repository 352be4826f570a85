import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hushwin.llm import packing
from hushwin.llm.common import table
from tests.conftest import SF001
from tests.llm.cases import edge_docs, empty_docs, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="aÀÉİßΣς'ſ.,!<|endoftx> \n\ṯ́ẖHK ​\x1c7")), min_size=1, max_size=5))
def test_word_encoding_equals_whole_text_encoding(texts):
    starts, ids = packing.encode_texts(pa.array(texts, pa.string()), PATH)
    got = [ids[starts[i]:starts[i + 1]].tolist() for i in range(len(texts))]
    assert got == whole(texts)


def test_cut():
    for n in (1, 2, 3, 4095, 4096, 4097, 8192, 10000):
        got = packing.cut(n)
        assert [s for s, _ in got] == np.concatenate(([0], np.cumsum([x for _, x in got])))[:-1].tolist()
        assert sum(x for _, x in got) == n and all(x & (x - 1) == 0 and x <= 4096 for _, x in got)


def check(docs):
    texts = docs.select("doc_id", "text").collect()
    got = rows(packing.pack(docs, PATH))
    assert len({r["sequence_id"] for r in got}) == len(got)
    want = []
    for d, ids in zip(texts, whole([x.text for x in texts])):
        for start, length in packing.cut(len(ids)):
            part = ids[start:start + length]
            want.append((d.doc_id, start, length, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids), part))
    key = lambda x: (str(x[0]), x[1:])
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["offset"] == 0 for r in got)


def test_pieces_equal_brute_force(spark):
    check(table(spark, SF001, "documents"))


def test_edges(spark):
    check(edge_docs(spark))
    assert rows(packing.pack(empty_docs(spark), PATH)) == []


def test_reruns_agree(spark):
    docs = table(spark, SF001, "documents")
    a = packing.pack(docs, PATH, keep_ids=False).collect()
    b = packing.pack(docs.repartition(5), PATH, keep_ids=False).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
