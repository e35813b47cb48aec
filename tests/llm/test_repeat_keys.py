"""Only stretches that more than one document may have are sent, whatever the number of keys."""

import random

import numpy as np

from chronoframe.llm import repeats


def test_unique_stretches_stay_at_home(spark, monkeypatch):
    r = random.Random(5)
    passage = r.randbytes(300).hex()
    docs = [(i, r.randbytes(60_000).hex() + (passage if i in (3, 40) else "")) for i in range(60)]
    sent = []
    kept = repeats._answers
    monkeypatch.setattr(repeats, "_answers", lambda rows, shards: sent.append(rows) or kept(rows, shards))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.n_removed for x in repeats.remove_repeats(frame, with_bytes=False).collect()}
    assert got == {i: len(passage) if i == 40 else 0 for i, _ in docs}
    stretches = sum(len(repeats._unpack(x.blob)[1]) for x in sent[0].where("kind = 0").collect())
    of_passage = len(np.unique(repeats.stretches(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]))[3]))
    assert stretches < 2 * of_passage + 40  # the two copies, and clashes of 32 bits
