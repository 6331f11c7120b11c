import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer as Loaded

from fleetgauge.llm.packing import Tokenizer, pack, patterns, slots
from fleetgauge.llm.queries import op8_packing, vocabulary
from tests.llm.frames import ODD_TEXTS, documents

ODD = [
    "", "'", "it's'll x'ree 'tis ''d ' s", "a\x1cb", "日本語 café İ", "x<|endoftext|>y", "ſŉǰ", " 12 ½ ³", "'sé", "é's",
    "Á decomposed", "\xa0nbsp\x85nel",
]


@pytest.fixture(scope="module")
def plain():
    return Loaded.from_file(vocabulary())


def test_ids_equal_the_library(plain):
    mine = Tokenizer(vocabulary())
    assert mine.by_word
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("'strevmld 1é.A\n½-") for _ in range(40)) for _ in range(2000)]
    for _ in range(2):  # the second time all words are known
        assert [ids.tolist() for ids in mine.ids(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_use_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([64, rng.randint(1, 64), rng.randint(1, 9)]) for _ in range(5000))
    packed = patterns(dict(histogram), 64)
    used = Counter()
    for count, pack_ in packed:
        assert sum(pack_) <= 64
        for length in pack_:
            used[length] += count
    assert used == histogram
    ranks = defaultdict(int)
    for slot in slots(packed):
        assert slot.rank == ranks[slot.length]
        ranks[slot.length] += next(c for c, p in _runs(packed) if p == slot.sequence)
    assert ranks == histogram


def _runs(packed):
    start = 0
    for count, _ in packed:
        yield count, start
        start += count


def check(rows, texts, plain, length):
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    wanted = Counter()
    for own in ids:
        for start in range(0, len(own), length):
            part = own[start : start + length]
            wanted[start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(own)] += 1
    assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences)


def test_pieces_of_odd_rows(spark, plain):
    rows = pack(documents(spark), vocabulary(), length=64).collect()
    check(rows, [t for _, t in ODD_TEXTS], plain, 64)
    assert pack(documents(spark, []), vocabulary()).collect() == []


def test_query_packs_all_documents_tightly(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op8_packing(spark, sf).collect()
    count = check(rows, texts, plain, 4096)
    assert (count - 1) * 4096 < sum(r.length for r in rows) * 1.01
