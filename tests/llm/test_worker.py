import re

import numpy as np
import public_tokenizers
import pyarrow as pa

from meridion.llm import byte_bpe, pii
from meridion.llm.byte_bpe import codec
from meridion.llm.simhash import _cross, _pairs, described
from meridion.llm.worker import drop_caches, lean

from .fixtures import prose


def anonymous_mb():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024


def test_near_dedup_begins_without_other_operators_caches(spark):
    """A worker that has encoded texts holds a vocabulary and pieces until near-dedup uses it; tasks after that fill them again."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(byte_bpe._codecs) + len(pii._ready)] * len(batch), pa.int64())], ["n"])

    rows = spark.createDataFrame([(k, prose(k, 60)) for k in range(40)], "doc_id long, text string").coalesce(1).cache()
    first = byte_bpe.encode_documents(rows, path, pattern).collect()
    assert rows.select("text").mapInArrow(held, "n long").groupBy().max("n").first()[0] >= 1
    described(rows.selectExpr("struct(doc_id) AS _row", "text")).collect()
    assert rows.select("text").mapInArrow(held, "n long").groupBy().max("n").first()[0] == 0
    assert byte_bpe.encode_documents(rows, path, pattern).collect() == first


def test_lean_work_gives_back_what_it_freed():
    drop_caches()
    own = codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    own.cache.update((f" piece{k}", (k, k + 1, k + 2)) for k in range(byte_bpe.CACHE_PIECES))
    del own
    full = anonymous_mb()
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    assert [b.num_rows for b in lean(lambda batches: batches)(iter([batch]))] == [1]
    assert anonymous_mb() < full - 40


def test_pairs_are_handed_on_before_all_are_held():
    """Rows of one token, each a group of its own: all pairs come, in parts."""
    n = 600
    same = np.zeros(n, np.int64)
    parts = [*_pairs(np.arange(n) * 7, _cross(same, same, np.arange(n), same + 100, same, 1000), 5000)]
    got = np.concatenate([np.stack(p, axis=1) for p in parts])
    i, j = np.triu_indices(n, 1)
    assert len(got) == len(i) and {*map(tuple, got.tolist())} == {*zip((7 * i).tolist(), (7 * j).tolist())}
    assert len(parts) > 10 and max(len(u) for u, _ in parts) < 7000
