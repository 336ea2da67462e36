import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from basewright.llm import packing
from basewright.llm.subwords import tokenizer_path


def brute(places, prices, window):
    best = {0: 0}
    for p, price in zip(places, prices):
        best[p] = min(
            best[q] + price + packing.OPEN + (0 if p - q >= packing.LEAST_POWER and packing.padded(p - q, window) == p - q else window - (p - q))
            for q in best if p - q <= window
        )
    return best[places[-1]]


def cost(ends, places, prices, window):
    by, total = dict(zip(places, prices)), 0
    for a, b in zip([0, *ends], ends):
        assert 0 < b - a <= window
        total += by[b] + packing.OPEN + (0 if b - a >= packing.LEAST_POWER and packing.padded(b - a, window) == b - a else window - (b - a))
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(60):
        window = rng.choice([64, 100, 128, 256])
        places = sorted(rng.sample(range(1, 900), rng.randint(1, 200)) + list(range(60, 900, 60)))
        places = sorted(set(places))
        prices = [rng.choice([0, 16, 256]) for _ in places]
        ends = packing.best_cuts(places, prices, window)
        assert ends[-1] == places[-1] and cost(ends, places, prices, window) == brute(places, prices, window)


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["ab", "stone.", "river", "cold,", "ß!", "x"], k=rng.choice([0, 3, 50, 400, 3000]))) for _ in range(150)]
    texts += ["nostop " * 30_000, "", " \n"]
    rows = [(i * 3, t, "a", 1) for i, t in enumerate(texts)] + [(30, "a repeated id.", "b", 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, ids int")
    whole = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] or -1, r[1] or "")):
        want[doc].append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    got = packing.pack(docs, files=3).collect()
    assert packing.pack(docs, with_ids=False, files=3).columns == list(packing.NAMES[:-1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, found in pieces.items():
        found.sort(key=lambda r: (r.sequence_id, r.offset))
        assert [i for r in found for i in r.ids] == [i for w in want[doc] for i in w.tolist()]
        assert {r.doc_tokens for r in found} == {len(w) for w in want[doc]}
    stored = used = 0
    assert len(sequences) > 10
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        stored, used = stored + packing.padded(at), used + at
    assert (stored - used) / stored < 0.05
    assert packing.pack(docs.limit(0)).count() == 0
